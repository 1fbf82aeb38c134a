"""Audio files as arrays of samples. Only PCM WAV is decoded here; other formats need a decoder outside."""

from __future__ import annotations

import io
import wave

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veloquent.functions.udf import per_row

RATE = 16_000


def decode_wav(data: bytes | None, rate: int = RATE) -> list[float] | None:
    """Mono samples at ``rate`` with their peak at 0.9; null for what is no PCM WAV."""
    try:
        with wave.open(io.BytesIO(bytes(data or b""))) as w:
            width, channels, own, raw = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.readframes(w.getnframes())
    except (wave.Error, EOFError):
        return None
    if width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8) / 2**23
    elif width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]) / 2 ** (8 * width - 1)
    x = x.reshape(-1, channels).mean(1)
    if own != rate and len(x):
        x = np.interp(np.arange(int(len(x) * rate / own)) * own / rate, np.arange(len(x)), x)
    top = np.abs(x).max() if len(x) else 0
    return (x * 0.9 / top if top > 0 else x).tolist()


samples = per_row(decode_wav, "array<float>")


def read_audio(spark: SparkSession, path: str) -> DataFrame:
    """(path, md5, estimated_ms, samples): the files below a folder, one row each."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.md5("content").alias("md5"), F.floor(F.col("length") / 32).alias("estimated_ms"), samples("content").alias("samples"))
