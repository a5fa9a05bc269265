"""Vectors and signals in arrays, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
EMOTIONS = ["happy", "angry", "sad", "afraid", "disgusted", "melancholic", "surprised", "calm"]
MELANCHOLIC = [
    "低落", "melancholy", "melancholic", "depression", "depressed", "gloomy",
    "üzgün", "kederli", "hüzünlü", "depresif", "melankolik", "karanlık", "çaresiz", "mutsuz",
]
BIAS = [0.9375, 0.875, 1.0, 1.0, 0.9375, 0.9375, 0.6875, 0.5625]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def emotion_vector(v: Column, biased: bool = True) -> Column:
    """Scaled by the bias, and down to a sum of 1 if it is more."""
    scaled = F.zip_with(v, F.array(*map(F.lit, BIAS)), lambda x, b: x.cast("double") * b) if biased else v
    return F.transform(scaled, lambda x: F.when(total(scaled) > 1, x / total(scaled)).otherwise(x))


def blend(weighted: Column, weights: Column, base: Column) -> Column:
    """weighted + (1 - sum of weights) * base."""
    return F.zip_with(weighted, base, lambda a, b: a + (1 - total(weights)) * b)


def strength(v: Column, scale: float) -> Column:
    """Scaled by 0 to 1 and cut after four decimals."""
    scale = min(max(scale, 0.0), 1.0)
    return F.transform(v, lambda x: (x.cast("double") * scale * 10000).cast("int") / 10000)


def clamped_scores(v: Column) -> Column:
    """Scores within 0 and 1.2; calm if there is none."""
    held = F.transform(v, lambda x: F.greatest(F.lit(0.0), F.least(x.cast("double"), F.lit(1.2))))
    return F.when(F.exists(held, lambda x: x > 0), held).otherwise(F.array(*(F.lit(1.0 if e == "calm" else 0.0) for e in EMOTIONS)))


def trimmed(wave: Column, rate: int, db: float = 30.0) -> Column:
    """Without the silence at the end, but for a tenth of a second; a silent wave stays."""
    loudest = F.array_max(F.transform(wave, F.abs))
    limit = loudest * 10 ** (-db / 20)
    last = F.array_max(F.transform(wave, lambda x, i: F.when(F.abs(x) > limit, i).otherwise(-1)))
    return F.when(loudest > 0, F.slice(wave, F.lit(1), F.least(last + 1 + int(rate * 0.1), F.size(wave)))).otherwise(wave)


def silence(rate: int, ms: int | Column) -> Column:
    return F.array_repeat(F.lit(0.0), F.floor(rate * ms / 1000).cast("int") if isinstance(ms, Column) else int(rate * ms / 1000))


def peak_normalized(wave: Column, ceiling: float = 0.675, dry: float = 0.25) -> Column:
    loudest = F.array_max(F.transform(wave, F.abs))
    return F.transform(wave, lambda x: x / loudest * ceiling + x * dry)


def pcm(wave: Column) -> Column:
    return F.transform(wave, lambda x: F.greatest(F.lit(-32767.0), F.least(x * 32767, F.lit(32767.0))))


def coarse_pitch(hz: Column, low: float = 50.0, high: float = 1100.0, bins: int = 256) -> Column:
    """The mel bin of a frequency, 1 to 255, halves to even."""
    import math

    mel = lambda f: 1127 * math.log(1 + f / 700)
    m = F.lit(1127.0) * F.log(1 + hz / 700)
    scaled = F.when(m > 0, (m - mel(low)) * (bins - 2) / (mel(high) - mel(low)) + 1).otherwise(m)
    return F.bround(F.greatest(F.lit(1.0), F.least(scaled, F.lit(float(bins - 1))))).cast("int")


def ivf_lists(n: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.floor(16 * F.sqrt(n)), F.floor(n / 39))).cast("int")


def high_pass(order: int = 5, cut: float = 48.0, rate: int = 16000) -> tuple[list[float], list[float]]:
    """Coefficients (b, a) of a Butterworth high-pass by the bilinear transform."""
    import numpy as np

    warped = 2 * rate * np.tan(np.pi * cut / rate)
    poles = warped / np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    z = (2 * rate + poles) / (2 * rate - poles)
    gain = np.real(np.prod(2 * rate / (2 * rate - poles)))
    return list(np.real(gain * np.poly(np.ones(order)))), list(np.real(np.poly(z)))


def filtered(wave: Column, b: list[float], a: list[float]) -> Column:
    """The recursive filter (b, a) over an array, direct form II transposed."""
    n = len(b) - 1
    start = F.struct(F.expr("cast(array() as array<double>)").alias("out"), F.array(*[F.lit(0.0)] * n).alias("z"))

    def step(acc: Column, x: Column) -> Column:
        z = lambda i: F.element_at(acc["z"], i + 1)
        y = x.cast("double") * b[0] + z(0)
        nxt = [x * b[i + 1] - y * a[i + 1] + (z(i + 1) if i + 1 < n else F.lit(0.0)) for i in range(n)]
        return F.struct(F.concat(acc["out"], F.array(y)).alias("out"), F.array(*nxt).alias("z"))

    return F.aggregate(wave, start, step, lambda acc: acc["out"])


def melancholic(scores: Column, text: Column) -> Column:
    """Scores in the order of EMOTIONS; where the text names melancholy, sad and melancholic change places."""
    sad, low = EMOTIONS.index("sad"), EMOTIONS.index("melancholic")
    said = F.lower(text)
    named = F.lit(False)
    for word in MELANCHOLIC:
        named = named | F.contains(said, F.lit(word))
    other = F.array(*(F.lit({sad: low, low: sad}.get(i, i)) for i in range(len(EMOTIONS))))
    return F.when(named, F.transform(other, lambda i: F.element_at(scores, i + 1))).otherwise(scores)


def mono(channels: Column) -> Column:
    """The mean of an array of channels, sample by sample."""
    n = F.size(channels)
    sums = F.aggregate(F.slice(channels, F.lit(2), F.greatest(n - 1, F.lit(0))), F.element_at(channels, 1), lambda s, c: F.zip_with(s, c, lambda a, b: a + b))
    return F.transform(sums, lambda x: x / n)


def truncated(wave: Column, rate: int, seconds: float) -> Column:
    return F.slice(wave, F.lit(1), F.lit(int(seconds * rate)))


def usable(wave: Column, rate: int, seconds: float = 1.5, peak: float = 2.5) -> Column:
    """Long enough, and nowhere louder than a recording can be."""
    return (F.size(wave) >= int(rate * seconds)) & (F.array_max(F.transform(wave, F.abs)) <= peak)


def silent_frames(frames: int | Column, size: int) -> Column:
    return F.array_repeat(F.array_repeat(F.lit(0.0), size), frames)
