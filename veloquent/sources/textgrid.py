"""Word and phone intervals of TextGrid files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veloquent.functions.udf import per_row

_TIER = re.compile(r'name\s*=\s*"((?:[^"]|"")*)"')
_INTERVAL = re.compile(r'xmin\s*=\s*([-\d.eE]+)\s+xmax\s*=\s*([-\d.eE]+)\s+text\s*=\s*"((?:[^"]|"")*)"')
KINDS = {"word": "words", "words": "words", "phone": "phones", "phones": "phones", "phoneme": "phones", "phonemes": "phones"}


def parse(text: str | None) -> list[dict]:
    """Labelled intervals of the first word tier and the first phone tier; blank labels are left out."""
    out, seen = [], set()
    parts = re.split(r"(?=name\s*=\s*\")", text or "")
    for part in parts[1:]:
        kind = KINDS.get(_TIER.match(part).group(1).strip().lower())
        if kind is None or kind in seen:
            continue
        seen.add(kind)
        for a, b, label in _INTERVAL.findall(part):
            if label.strip():
                out.append({"tier": kind, "label": label.strip().replace('""', '"'), "start": float(a), "end": float(b)})
    return out


intervals = per_row(parse, "array<struct<tier:string,label:string,start:double,end:double>>")


def read_textgrids(spark: SparkSession, path: str) -> DataFrame:
    """(path, tier, label, start, end) of all files below a folder."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    rows = files.select(F.input_file_name().alias("path"), intervals("value").alias("x"))
    return rows.select("path", F.inline("x"))
