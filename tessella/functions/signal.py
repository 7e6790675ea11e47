"""Numeric functions over sample and frame arrays."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ACOUSTICS = T.StructType([T.StructField(n, T.DoubleType()) for n in ("rms", "db", "peak", "centroid_hz", "energy_p95")])


def semitones(a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), 12 * F.log2(a / b))


def clamped(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def reconciled(a: Column, b: Column, c: Column, within: float = 1.5) -> Column:
    """Mean of the closest pair of three estimates, if they are within so many semitones; else the median."""
    pair = lambda x, y: F.struct(F.abs(semitones(x, y)).alias("gap"), ((x + y) / 2).alias("mean"))
    best = F.array_min(F.filter(F.array(pair(a, b), pair(a, c), pair(b, c)), lambda p: p["gap"].isNotNull()))
    ordered = F.array_sort(F.array_compact(F.array(a, b, c)))
    return F.when(best["gap"] <= within, best["mean"]).otherwise(F.get(ordered, F.floor(F.size(ordered) / 2).cast("int")))


def crossfaded(tail: Column, head: Column) -> Column:
    """Squared-cosine fade from one array to another of its length."""
    n = F.size(tail)
    return F.transform(F.arrays_zip(tail.alias("a"), head.alias("b")), lambda p, k: p["a"] * F.pow(F.cos(k / n * np.pi / 2), 2) + p["b"] * F.pow(F.sin(k / n * np.pi / 2), 2))


def joined_with_silence(a: Column, b: Column, silence: int) -> Column:
    """Two sample arrays with silence between, the second at the loudness of the first."""
    loud = lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v) / F.size(x))
    gain = F.coalesce(loud(a) / F.nullif(loud(b), F.lit(0.0)), F.lit(1.0))
    return F.concat(a, F.array_repeat(F.lit(0.0), silence), F.transform(b, lambda v: v * gain))


def mono(samples: np.ndarray) -> np.ndarray:
    return samples.mean(axis=1) if samples.ndim == 2 else samples


def resampled(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation to another rate."""
    n = round(len(samples) * to / rate)
    return np.interp(np.arange(n) * rate / to, np.arange(len(samples)), samples) if n else np.zeros(0)


def peak_guarded(samples: np.ndarray, most: float = 0.99) -> np.ndarray:
    top = np.abs(samples).max(initial=0.0)
    return samples * (most / top) if top > most else samples


def acoustics(rate: int) -> object:
    """UDF: loudness, peak, spectral centroid and frame energy of sample arrays."""

    @F.pandas_udf(ACOUSTICS)
    def run(rows: pd.Series) -> pd.DataFrame:
        out = []
        for row in rows:
            x = np.asarray(row if row is not None else [], float)
            rms = float(np.sqrt(np.mean(x * x))) if len(x) else 0.0
            spectrum = np.abs(np.fft.rfft(x)) if len(x) else np.zeros(1)
            weight = spectrum.sum()
            frames = x[: len(x) // 160 * 160].reshape(-1, 160)
            energy = np.sqrt((frames**2).mean(axis=1)) if len(frames) else np.zeros(1)
            centroid = float((np.fft.rfftfreq(len(x), 1 / rate) * spectrum).sum() / weight) if weight else 0.0
            out.append((rms, 20 * float(np.log10(rms + 1e-12)), float(np.abs(x).max(initial=0.0)), centroid, float(np.percentile(energy, 95))))
        return pd.DataFrame(out, columns=ACOUSTICS.names)

    return run


def pitch_autocorrelation(x: np.ndarray, rate: int, low: float = 60.0, high: float = 500.0) -> float:
    """Rate over the lag of the largest autocorrelation in range; 0 for silence."""
    if len(x) < 2:
        return 0.0
    x = x - x.mean()
    r = np.fft.irfft(np.abs(np.fft.rfft(x, 2 * len(x))) ** 2)[: len(x)]
    a, b = int(rate / high), min(int(rate / low), len(r) - 1)
    return rate / (a + int(np.argmax(r[a : b + 1]))) if b > a and r[0] > 0 else 0.0


def pitch_cepstrum(x: np.ndarray, rate: int, low: float = 60.0, high: float = 500.0) -> float:
    if len(x) < 2:
        return 0.0
    cepstrum = np.fft.irfft(np.log(np.abs(np.fft.rfft(x)) + 1e-9))
    a, b = int(rate / high), min(int(rate / low), len(cepstrum) // 2)
    return rate / (a + int(np.argmax(cepstrum[a : b + 1]))) if b > a else 0.0


def augmented(x: np.ndarray, seed: int) -> tuple[np.ndarray, dict[str, float]]:
    """Seeded gain, noise and speed change, with what was applied."""
    r = np.random.Generator(np.random.PCG64(seed))
    gain, noise, speed = float(r.uniform(0.7, 1.2)), float(r.uniform(0, 0.005)), float(r.uniform(0.9, 1.1))
    y = np.interp(np.arange(0, len(x), speed), np.arange(len(x)), x) if len(x) else x
    return peak_guarded(y * gain + r.normal(0, noise, len(y))), {"gain": gain, "noise": noise, "speed": speed}


def wav_bytes(samples: np.ndarray, rate: int) -> bytes:
    """16-bit mono WAV."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((np.clip(samples, -1, 1) * 32767).round().astype("<i2").tobytes())
    return out.getvalue()


def wav_encoded(samples: Column, rate: int) -> Column:
    """WAV bytes of sample arrays; null for null."""

    @F.pandas_udf(T.BinaryType())
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: None if x is None else wav_bytes(np.asarray(x, float), rate))

    return run(samples)


PROBE = T.StructType([T.StructField("rate", T.IntegerType()), T.StructField("channels", T.IntegerType()), T.StructField("seconds", T.DoubleType())])


def wav_probe(content: Column) -> Column:
    """Rate, channels and duration from the header alone, as of binaryFile's content; nulls where it is no WAV."""

    def one(data: bytes | None) -> tuple:
        try:
            with wave.open(io.BytesIO(data or b"")) as f:
                return f.getframerate(), f.getnchannels(), f.getnframes() / f.getframerate()
        except (wave.Error, EOFError):
            return None, None, None

    @F.pandas_udf(PROBE)
    def run(contents: pd.Series) -> pd.DataFrame:
        found = pd.DataFrame([one(x) for x in contents], columns=PROBE.names)
        return found.astype({"rate": "Int32", "channels": "Int32", "seconds": "Float64"})

    return run(content)


ACTIVITY = T.StructType([T.StructField(n, T.DoubleType()) for n in ("voiced_share", "lead_seconds", "tail_seconds", "low_share")] + [T.StructField("truncated", T.BooleanType())])


def activity_of(x: np.ndarray, rate: int, below_peak_db: float = 35.0, low_hz: float = 100.0, frame_seconds: float = 0.02) -> tuple:
    """Share of voiced frames, silence before and after them, share of energy below low_hz, and whether the samples end
    in a voiced frame. A frame is voiced within below_peak_db of the loudest; silence has none."""
    n = max(1, int(rate * frame_seconds))
    frames = x[: len(x) // n * n].reshape(-1, n)
    loud = np.sqrt((frames**2).mean(axis=1)) if len(frames) else np.zeros(0)
    top = loud.max(initial=0.0)
    voiced = np.flatnonzero(loud > top * 10 ** (-below_peak_db / 20)) if top > 0 else np.zeros(0, int)
    power = np.abs(np.fft.rfft(x)) ** 2 if len(x) else np.zeros(1)
    low = float(power[np.fft.rfftfreq(len(x), 1 / rate) < low_hz].sum() / power.sum()) if power.sum() else 0.0
    if not len(voiced):
        return 0.0, len(x) / rate, 0.0, low, False
    return len(voiced) / len(frames), float(voiced[0] * n / rate), float((len(frames) - 1 - voiced[-1]) * n / rate), low, bool(voiced[-1] == len(frames) - 1)


def activity(samples: Column, rate: int) -> Column:
    """activity_of of sample arrays; null as empty."""

    @F.pandas_udf(ACTIVITY)
    def run(rows: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([activity_of(np.asarray([] if x is None else x, float), rate) for x in rows], columns=ACTIVITY.names)

    return run(samples)


def conditioned(samples: Column, rate: int, to: int) -> Column:
    """Sample arrays at another rate, with their peak guarded; null for null."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: None if x is None else peak_guarded(resampled(np.asarray(x, float), rate, to)))

    return run(samples)


def pitch(samples: Column, rate: int) -> Column:
    """Struct of the pitch by autocorrelation and by cepstrum; null as empty."""

    @F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("autocorrelation", "cepstrum")]))
    def run(rows: pd.Series) -> pd.DataFrame:
        arrays = [np.asarray([] if x is None else x, float) for x in rows]
        return pd.DataFrame({"autocorrelation": [float(pitch_autocorrelation(x, rate)) for x in arrays], "cepstrum": [float(pitch_cepstrum(x, rate)) for x in arrays]})

    return run(samples)


def augmented_samples(samples: Column, seed: Column) -> Column:
    """Struct of the augmented samples and what was applied; null as empty."""
    kind = T.StructType([T.StructField("samples", T.ArrayType(T.DoubleType())), T.StructField("gain", T.DoubleType()), T.StructField("noise", T.DoubleType()), T.StructField("speed", T.DoubleType())])

    @F.pandas_udf(kind)
    def run(rows: pd.Series, seeds: pd.Series) -> pd.DataFrame:
        made = [augmented(np.asarray([] if x is None else x, float), int(s)) for x, s in zip(rows, seeds, strict=True)]
        return pd.DataFrame([{"samples": y, **applied} for y, applied in made], columns=kind.names)

    return run(samples, seed)
