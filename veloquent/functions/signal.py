"""Signals and vectors as arrays: scaling, gating, intervals, similarity, spectra."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from veloquent.functions.udf import let, per_row

RATE = 16_000


def peak(x: Column) -> Column:
    return F.array_max(F.transform(x, lambda v: F.abs(v)))


def peak_normalized(x: Column, to: float = 0.9) -> Column:
    """Scaled to the given peak; silence stays silence."""
    whole = F.transform(x, lambda v: v.cast("double"))
    scaled = lambda s: F.when(s["p"] > 0, F.transform(s["x"], lambda v: v * to / s["p"])).otherwise(s["x"])
    return let(whole, lambda w: let(F.struct(w.alias("x"), peak(w).alias("p")), scaled))


def noise_gated(x: Column, floor: float = 0.02, to: float = 0.9) -> Column:
    """Scaled by the peak, values under the floor silenced, scaled to the given peak."""
    cut = lambda v, p: F.when(F.abs(v.cast("double") / p) < floor, F.lit(0.0)).otherwise(v.cast("double") / p)
    gated = let(peak(x).cast("double") + 1e-8, lambda p: F.transform(x, lambda v: cut(v, p)))
    return peak_normalized(gated, to)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine_percent(a: Column, b: Column) -> Column:
    """Cosine mapped from [-1, 1] to [0, 100]; null for a zero vector."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norm)) + 1) / 2 * 100)


def voiced(x: Column, floor: float) -> Column:
    """Places of the values whose size reaches the floor, in order."""
    return F.filter(F.transform(x, lambda v, i: F.when(F.abs(v) >= floor, i)), lambda i: i.isNotNull())


def pauses(intervals: Column, least: float = 1.0) -> Column:
    """Gaps of at least ``least`` between consecutive intervals (start, end), as (start, duration)."""
    gap = lambda v, i, xs: F.when(i > 0, F.struct(F.get(xs, i - 1)["end"].alias("start"), (v["start"] - F.get(xs, i - 1)["end"]).alias("duration")))
    gaps = let(intervals, lambda xs: F.transform(xs, lambda v, i: gap(v, i, xs)))
    return F.filter(gaps, lambda g: g["duration"] >= least)


def speech_pauses(x: list[float] | None, rate: int | None = RATE, least: float = 1.0, below_db: float = 20.0, frame: int = 2048, hop: int = 512) -> list[dict]:
    """Silences of at least ``least`` seconds between two stretches of speech.

    Speech is where the power of a frame (centred, ``hop`` apart) is less than ``below_db`` under the loudest one's. A
    pause has a place in the text, a twentieth of the sample at which it begins, and its duration to a tenth of a second.
    """
    x = np.asarray(x if x is not None else [], float)
    if not len(x) or not rate:
        return []
    padded = np.concatenate((np.zeros(frame // 2), x, np.zeros(frame // 2)))
    total = np.concatenate(([0.0], np.cumsum(padded**2)))
    starts = np.arange(0, len(padded) - frame + 1, hop)
    power = np.maximum(total[starts + frame] - total[starts], 0.0) / frame
    top = max(power.max(), 1e-10)
    on = 10 * np.log10(np.maximum(power, 1e-10) / top) > -below_db
    edges = np.flatnonzero(np.diff(np.concatenate(([0], on.astype(int), [0]))))
    spans = np.minimum(edges * hop, len(x)).reshape(-1, 2)
    out = []
    for (_, end), (start, _) in zip(spans[:-1].tolist(), spans[1:].tolist()):
        seconds = (start - end) / rate
        if seconds >= least:
            out.append({"start_index": int(end * 0.05), "end_index": int(end * 0.05), "duration": round(seconds, 1)})
    return out


def equal_spans(n: Column, seconds: Column) -> Column:
    """``n`` spans (start, end) of equal length over the seconds: where words lie while no alignment tells."""
    part = seconds / F.greatest(n, F.lit(1))
    return F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.struct((i * part).alias("start"), F.least(seconds, i * part + part).alias("end")))


def word_spans(aligned: Column, n: Column, seconds: Column) -> Column:
    """Spans of ``n`` words: those aligned (array of start, end), and equal parts of the whole for words beyond them."""
    even = equal_spans(n, seconds)
    both = let(even, lambda e: F.transform(F.slice(e, F.lit(1), F.greatest(n, F.lit(0))), lambda s, i: F.coalesce(F.get(aligned, i), s)))
    return both


def segment_bounds(start: Column, end: Column, length: Column, pad: float = 0.05, least: float = 0.1) -> Column:
    """Sample bounds of a time span with padding, inside the signal, and never empty where the signal is not."""
    a = F.greatest(F.lit(0), F.floor(F.greatest(F.lit(0.0), start - pad) * RATE))
    b = F.least(length, F.floor(F.least(length / RATE, end + pad) * RATE))
    return F.struct(a.cast("bigint").alias("from"), F.when(b <= a, F.least(length, a + int(least * RATE))).otherwise(b).cast("bigint").alias("to"))


def voiced_intervals(x: list[float] | None, floor: float = 0.1, frame: int = 1) -> list[dict]:
    """Runs of frames whose mean square reaches ``floor`` of the loudest, as (start, end) samples."""
    x = np.asarray(x if x is not None else [], float)
    if not len(x):
        return []
    starts = np.arange(0, len(x), frame)
    power = np.add.reduceat(x**2, starts) / np.diff(np.append(starts, len(x)))
    n = len(power)
    on = power >= floor * power.max() if power.max() > 0 else np.zeros(n, bool)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], on.astype(int), [0]))))
    return [{"start": float(a * frame), "end": float(min(b * frame, len(x)))} for a, b in zip(edges[::2], edges[1::2])]


def rate_over_time(x: list[float] | None, words: int | None, rate: int = RATE, chunk: float = 2.0, below_db: float = 20.0) -> list[float]:
    """Estimated words per minute in each whole chunk (one at least): activity times energy times a slow wave."""
    x = np.asarray(x if x is not None else [], float)
    size = int(chunk * rate)
    n = max(1, int(len(x) / rate / chunk))
    out = []
    for i in range(n):
        part = np.abs(x[i * size : (i + 1) * size])
        loud = np.flatnonzero(part > part.max() * 10 ** (-below_db / 20)) if len(part) and part.max() > 0 else []
        if not len(loud):
            out.append(0.0)
            continue
        heard = part[loud[0] : loud[-1] + 1]
        energy = min(1.5, max(0.5, float(heard.mean()) * 1000))
        out.append(float(max(0, round((words or 0) / n * (len(heard) / rate / chunk) * energy / chunk * 60 * (1 + 0.1 * math.sin(i * 0.5))))))
    return out


def spectral_summary(x: list[float] | None, rate: int = RATE, bands: int = 40, kept: int = 13, frame: int = 400, hop: int = 160) -> list[float] | None:
    """Mean and deviation of ``kept`` mel cepstral coefficients; null under 0.05 s."""
    x = np.asarray(x if x is not None else [], float)
    if len(x) < 0.05 * rate:
        return None
    starts = range(0, max(1, len(x) - frame + 1), hop)
    frames = np.stack([np.pad(x[s : s + frame], (0, max(0, frame - len(x[s : s + frame])))) for s in starts]) * np.hanning(frame)
    power = np.abs(np.fft.rfft(frames)) ** 2
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    points = 700 * (10 ** (np.linspace(mel(0), mel(rate / 2), bands + 2) / 2595) - 1)
    freqs = np.linspace(0, rate / 2, power.shape[1])
    left, mid, right = points[:-2, None], points[1:-1, None], points[2:, None]
    bank = np.maximum(0, np.minimum((freqs - left) / (mid - left), (right - freqs) / (right - mid)))
    logs = 10 * np.log10(np.maximum(power @ bank.T, 1e-10))
    k = np.arange(bands)
    basis = np.cos(np.pi / bands * (k[:, None] + 0.5) * np.arange(kept)) * math.sqrt(2 / bands)
    basis[:, 0] /= math.sqrt(2)
    c = logs @ basis
    return [*c.mean(0).tolist(), *c.std(0).tolist()]


pauses_udf = per_row(speech_pauses, "array<struct<start_index:int,end_index:int,duration:double>>")
voiced_udf = per_row(voiced_intervals, "array<struct<start:double,end:double>>")
summary_udf = per_row(spectral_summary, "array<double>")
rate_udf = per_row(rate_over_time, "array<double>")
