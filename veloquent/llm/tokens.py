"""Encoding of texts by a public byte-level BPE vocabulary, exactly, with a lexicon of the corpus's frequent words."""

from __future__ import annotations

import base64
import heapq
import importlib.util
import os
import tempfile
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veloquent import session
from veloquent.llm.lexicon import Lexicon, write

TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
LEXICON_WORDS = 50_000
LEXICON_BYTES = 64  # longer words are left to merging, which bounds the lexicon's size


def pattern(folder: str = TOKENIZERS) -> str:
    """The expression that parts texts into words, as the vocabularies' package states it."""
    spec = importlib.util.spec_from_file_location("_tokenizer_files", os.path.join(folder, "__init__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module.PATTERN


def read_ranks(name: str, folder: str = TOKENIZERS) -> dict[bytes, int]:
    with open(os.path.join(folder, name + ".tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: the adjacent pair of the lowest rank, the leftmost of equals, is merged until none is left.

    A heap of pairs over a linked list keeps very long words (a line without spaces) at n log n.
    """
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    part: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i] if part[i] is a else n
        if j >= n or part[j] is not b:
            continue  # one side has been merged since
        part[i], part[j] = a + b, None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get(part[i] + part[k])) is not None:
                heapq.heappush(heap, (r, i, part[i], part[k]))
        if (h := before[i]) >= 0 and (r := ranks.get(part[h] + part[i])) is not None:
            heapq.heappush(heap, (r, h, part[h], part[i]))
    return [ranks[p] for p in part if p is not None]


def frequent_words(texts: DataFrame, text_col: str, pat: str, most: int = LEXICON_WORDS) -> list[bytes]:
    """The ``most`` most frequent words of all texts, by a count over the whole corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, seen = regex.compile(pat).findall, Counter()

        def out():
            return pa.record_batch([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    seen.update(find(t))
            if len(seen) > 200_000:  # a partial count: the sum below does not care how often it is cut
                yield out()
                seen.clear()
        if seen:
            yield out()

    counts = texts.select(text_col).mapInArrow(count, "word string, n long").filter(F.octet_length("word") <= LEXICON_BYTES)
    top = counts.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most)
    return [r[0].encode() for r in top.select("word").collect()]


class Encoder:
    """One worker's encoder: words known to the lexicon by its automaton, all others by merging."""

    CACHE = 200_000

    def __init__(self, path: str, pat: str) -> None:
        self.lexicon = Lexicon(path)
        self.find = regex.compile(pat).findall
        self.cache: dict[str, list[int]] = {}
        self._ranks: dict[bytes, int] | None = None

    @property
    def ranks(self) -> dict[bytes, int]:
        if self._ranks is None:
            a = self.lexicon.arrays
            ends, data = a["piece_ends"].tolist(), a["piece_bytes"].tobytes()
            self._ranks = {data[s:e]: int(i) for s, e, i in zip([0, *ends], ends, a["piece_ids"].tolist())}
        return self._ranks

    def _words(self, texts: list[str | None]) -> list[list[str]]:
        """The texts' words, all of which the cache then knows: new ones are looked up together, once each."""
        words = [self.find(t) if t else [] for t in texts]
        if len(self.cache) > self.CACHE:
            self.cache.clear()
        new = list(set(chain.from_iterable(words)).difference(self.cache))
        if new:
            raw = [w.encode() for w in new]
            for w, r, place in zip(new, raw, self.lexicon.places(raw).tolist()):
                self.cache[w] = self.lexicon.output(place) if place >= 0 else merge(r, self.ranks)
        return words

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        """The ids of each text, written one after another into one flat array."""
        ids_of, flat, ends = self.cache.__getitem__, array("i"), [0]
        for ws in self._words(texts):
            flat.extend(chain.from_iterable(map(ids_of, ws)))
            ends.append(len(flat))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32)))

    def lengths(self, texts: list[str | None]) -> pa.Array:
        ids_of = self.cache.__getitem__
        return pa.array([sum(map(len, map(ids_of, ws))) for ws in self._words(texts)], pa.int32())


_ENCODERS: dict[str, Encoder] = {}


def _encoder(name: str, pat: str) -> Encoder:
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(SparkFiles.get(name), pat)
    return _ENCODERS[name]


def ship_lexicon(texts: DataFrame, text_col: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS, most: int = LEXICON_WORDS) -> tuple[str, str]:
    """Build the lexicon of a corpus and send its file to all executors: (file name, pattern).

    At most ``most`` words of ``LEXICON_BYTES`` bytes, and the vocabulary itself, so a few MB at any corpus size.
    Which words are in it changes speed only, never ids. The file lies in the shared folder until the driver
    ends, so that executors which join later find it too.
    """
    pat, ranks = pattern(folder), read_ranks(name, folder)
    words = frequent_words(texts, text_col, pat, most)
    pieces = sorted(ranks, key=ranks.__getitem__)
    extra = {"piece_bytes": np.frombuffer(b"".join(pieces), np.uint8), "piece_ends": np.cumsum([len(p) for p in pieces]).astype(np.int64), "piece_ids": np.array([ranks[p] for p in pieces], np.int32)}
    with tempfile.TemporaryDirectory() as here:  # the driver's own, while the file is put together
        name = os.path.join(here, "lexicon")
        write(name, words, [merge(w, ranks) for w in words], extra)
        with open(name, "rb") as f:
            file = session.add_file(texts.sparkSession, f"lexicon-{uuid.uuid4().hex}.bin", f.read())
    return file, pat


def spread(df: DataFrame) -> DataFrame:
    """More partitions for tables in fewer files than there are cores; the rows stay the same."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def encode(docs: DataFrame, id_col: str, text_col: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS, lengths_only: bool = False) -> DataFrame:
    """(id, ids array<int>), or (id, n_tokens int) with ``lengths_only``, of every document.

    Null and empty texts have the empty list. Strings of special tokens in a text are ordinary text. Texts are
    encoded whole; each Arrow batch looks its distinct words up together.
    """
    rows = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")))
    file, pat = ship_lexicon(docs, text_col, name, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(file, pat)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                out = (e.lengths if lengths_only else e.encode)(part.column(1).to_pylist())
                yield pa.record_batch([part.column(0), out], names=["id", "n_tokens" if lengths_only else "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, " + ("n_tokens int" if lengths_only else "ids array<int>")).withColumnRenamed("id", id_col)
