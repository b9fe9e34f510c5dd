"""Signals: relational operators on long tables ``id, pos, v`` and Arrow-batch kernels on arrays.

The long forms aggregate with map-side partial results and salt the joins back to the samples, so one
signal may hold a large share of all samples. The array forms treat one recording per row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlas.operators.arrow import wave_udf
from atlas.operators.skew import positions, salted_join

# Fixed values of the signal front end.
SAMPLE_RATE = 48_000
N_FFT = 1024
HOP = 480
N_MELS = 64
CLIP_SAMPLES = 480_000
FLOOR_POWER = 1e-10
HALF_WIDTH = 32
PHASES = 512
SHORT = 256
GAIN_RANGE = (0.5, 1.6)
NOISE_SIGMA = 0.003
FRAMES_AT_ONCE = 32
SAMPLES_AT_ONCE = 512  # of a resampled wave: few enough for their windows to stay in the cache
STRETCH_WEIGHTS = 1 << 18  # that a table of a stretch between two rates holds at most
SLIDE = 32  # places of a window that share one transform
BLOCKS_AT_ONCE = 16
SHARED = 4  # frames that a transform serves at least, on average, for sharing it to pay
BANDS_AT_ONCE = 16
HANN = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(N_FFT) / N_FFT)


# ---- long form ------------------------------------------------------------------------------------

def signal_stats(df: DataFrame) -> DataFrame:
    """``id, n, peak``."""
    return df.groupBy("id").agg((F.max("pos") + 1).alias("n"), F.max(F.abs("v")).alias("peak"))


def with_stats(df: DataFrame) -> DataFrame:
    return salted_join(df, signal_stats(df), ["id"], spread=["pos"])


def trim_bounds(df: DataFrame, db: float = 60.0, frame: int = 1024) -> DataFrame:
    """``id, n, start, stop``: first and last loud frame, on grids anchored at either end.

    Both grids come from one aggregation over their common refinement; a signal with no loud frame, or
    whose bounds cross, is kept whole.
    """
    ahead, back = F.floor(F.col("pos") / frame), F.floor((F.col("n") - 1 - F.col("pos")) / frame)
    cells = with_stats(df).groupBy("id", "n", "peak", ahead.alias("ahead"), back.alias("back")).agg(
        F.sum(F.col("v") * F.col("v")).alias("power"), F.count(F.lit(1)).alias("size"))
    limit = F.col("peak") * 10 ** (-db / 20)

    def loud(side: str) -> DataFrame:
        frames = cells.groupBy("id", "n", "peak", side).agg(
            F.sum("power").alias("power"), F.sum("size").alias("size"))
        return frames.where(F.sqrt(F.col("power") / F.col("size")) > limit).groupBy("id").agg(
            (F.min(side) * frame).alias(side))

    start, stop = F.coalesce("ahead", F.lit(0)), F.col("n") - F.coalesce("back", F.lit(0))
    return (
        signal_stats(df).join(loud("ahead"), "id", "left").join(loud("back"), "id", "left")
        .select("id", "n", F.when(start < stop, start).otherwise(F.lit(0)).alias("start"),
                F.when(start < stop, stop).otherwise(F.col("n")).alias("stop"))
    )


def trim_silence(df: DataFrame, db: float = 60.0, frame: int = 1024) -> DataFrame:
    """Samples between the bounds, renumbered from 0."""
    bounds = trim_bounds(df, db, frame)
    inside = (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("stop"))
    return salted_join(df, bounds, ["id"], spread=["pos"]).where(inside).select(
        "id", (F.col("pos") - F.col("start")).alias("pos"), "v")


def envelope(df: DataFrame, bars: int = 64) -> DataFrame:
    """``id, bar, level``: peak per bucket over the signal's peak; buckets without samples are 0."""
    per = F.greatest(F.col("n") / F.lit(bars), F.lit(1.0))
    bar = (F.ceil((F.col("pos") + 1) / per) - 1).cast("int")
    peaks = with_stats(df).groupBy("id", bar.alias("bar")).agg(F.max(F.abs("v")).alias("top"))
    grid = signal_stats(df).select("id", "peak", F.explode(F.sequence(F.lit(0), F.lit(bars - 1))).alias("bar"))
    return grid.join(peaks, ["id", "bar"], "left").select(
        "id", "bar", (F.coalesce("top", F.lit(0.0)) / F.greatest("peak", F.lit(1e-6))).alias("level"))


def repeat_pad(df: DataFrame, length: int = CLIP_SAMPLES, short: int = SHORT) -> DataFrame:
    """Whole repeats of the signal up to ``length``, then zeros; longer signals are cut to the head.

    Signals below ``short`` samples first gain ``short`` zeros.
    """
    stats = signal_stats(df).withColumn(
        "span", F.when(F.col("n") < short, F.col("n") + short).otherwise(F.col("n"))).withColumn(
        "reps", F.greatest(F.floor(F.lit(length) / F.col("span")), F.lit(1)))
    tiled = salted_join(df, stats.drop("peak"), ["id"], spread=["pos"]).where(F.col("pos") < length)
    copies = tiled.select(
        "id", F.explode(F.transform(F.sequence(F.lit(0), F.col("reps") - 1),
                                    lambda r: F.col("pos") + r * F.col("span"))).alias("pos"), "v")
    gaps = F.filter(
        F.sequence(F.lit(0), F.lit(length - 1)).cast("array<bigint>"),
        lambda p: (p >= F.col("reps") * F.col("span")) | (p % F.col("span") >= F.col("n")))
    zeros = stats.where(F.col("span") < length).select("id", F.explode(gaps).alias("pos"), F.lit(0.0).alias("v"))
    return copies.unionByName(zeros)


def reflect_pad(df: DataFrame, pad: int = N_FFT // 2) -> DataFrame:
    """Mirror ``pad`` samples around either end point without repeating it."""
    pos, n = F.col("pos"), F.col("n")
    spots = F.array_compact(F.array(
        pos + pad,
        F.when((pos >= 1) & (pos <= pad), pad - pos),
        F.when((pos <= n - 2) & (pos >= n - 1 - pad), pad + n + (n - 2 - pos)),
    ))
    return with_stats(df).select("id", F.explode(spots).alias("pos"), "v")


def to_mono(df: DataFrame, channels: int = 2) -> DataFrame:
    """Mean over the interleaved channels of each frame."""
    return df.groupBy("id", F.floor(F.col("pos") / channels).alias("pos")).agg(
        (F.sum("v") / F.lit(channels)).alias("v"))


def from_arrays(df: DataFrame, samples: str = "samples") -> DataFrame:
    return df.select("id", F.posexplode(samples).alias("pos", "v")).withColumn("v", F.col("v").cast("double"))


def to_arrays(df: DataFrame, max_samples: int = CLIP_SAMPLES) -> DataFrame:
    """One array per signal. Only for clips: a signal beyond ``max_samples`` fails instead of filling a task."""
    sizes = df.groupBy("id").agg(F.max("pos").alias("last"))
    too_long = F.raise_error(F.lit("signal too long for one row")).cast("boolean")
    fits = sizes.where(F.when(F.col("last") >= max_samples, too_long).otherwise(F.lit(True))).select("id")
    rows = df.join(fits, "id").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("s"))
    return rows.select("id", F.transform("s", lambda e: e["v"].cast("float")).alias("samples"))


# ---- array kernels --------------------------------------------------------------------------------

def trim_array(wave: np.ndarray, db: float = 60.0, frame: int = 1024) -> np.ndarray:
    n = len(wave)
    peak = np.abs(wave).max() if n else 0.0
    if peak == 0:
        return wave
    power = np.concatenate([[0.0], np.cumsum(wave.astype(np.float64) ** 2)])

    def loud(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.sqrt(np.maximum(power[hi] - power[lo], 0) / (hi - lo)) > peak * 10 ** (-db / 20))

    lo = np.arange(0, n, frame)
    hi = np.arange(n, 0, -frame)
    first, last = loud(lo, np.minimum(lo + frame, n)), loud(np.maximum(hi - frame, 0), hi)
    start = lo[first[0]] if len(first) else 0
    stop = hi[last[0]] if len(last) else n
    return wave[start:stop] if start < stop else wave


def envelope_array(wave: np.ndarray, bars: int = 64) -> np.ndarray:
    level = np.zeros(bars)
    if len(wave):
        per = max(len(wave) / bars, 1.0)
        bar = np.ceil((np.arange(len(wave)) + 1) / per).astype(int) - 1
        first = np.flatnonzero(np.diff(bar, prepend=-1))
        level[bar[first]] = np.maximum.reduceat(np.abs(wave), first)
    return level / max(level.max(initial=0.0), 1e-6)


def pad_array(wave: np.ndarray, length: int = CLIP_SAMPLES) -> np.ndarray:
    out = np.zeros(length)
    if len(wave) >= length:
        return wave[:length].astype(np.float64)
    if len(wave):
        tiled = np.tile(wave, length // len(wave))
        out[: len(tiled)] = tiled
    return out


def _alike(length: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Frames of a clip to transform, and for each of the ``count`` frames which of those it equals.

    A short wave is repeated, so frames at the same place of it are the same, as are frames of the zeros after it. Frames
    that meet an end of the clip or of its repeats are like no other.
    """
    same, half = np.arange(count), N_FFT // 2
    if 0 < length < CLIP_SAMPLES:
        end = CLIP_SAMPLES // length * length
        low, high = -(-half // HOP), (end - half) // HOP + 1
        if high > low:
            same[low:high] = low + np.arange(high - low) % (length // math.gcd(length, HOP))
        low, high = -(-(end + half) // HOP), (CLIP_SAMPLES - half) // HOP + 1
        same[low:max(low, high)] = low
    kept = same == np.arange(count)
    return np.flatnonzero(kept), (np.cumsum(kept) - 1)[same]


@dataclass(frozen=True)
class Mel:
    """A filterbank, and what its frames share.

    A window that moves by a few samples loses some and gains as many, so its spectrum is that of the window it moved
    from (``SLIDE`` places share one) and the spectra of the changed samples. ``turns``: real and imaginary parts of the
    spectrum of a sample at each place; ``moved``: by places moved, what the Hann window weighs each changed
    sample with, and then the spectrum moved from, the sum and the difference of the bins beside each bin.
    """

    low: int  # bins from low to high are heard
    high: int
    bands: int
    parts: list[tuple[slice, slice, np.ndarray]]  # bands that lie together, the bins they hear, and their weights
    moved: np.ndarray
    known: np.ndarray
    room: np.ndarray

    @staticmethod
    def of(filters: np.ndarray) -> Mel:
        heard = np.flatnonzero(filters.any(axis=1))
        low, high = (int(heard[0]), int(heard[-1]) + 1) if len(heard) else (0, 0)
        parts = []
        for at in range(0, filters.shape[1], BANDS_AT_ONCE):
            bands = slice(at, min(at + BANDS_AT_ONCE, filters.shape[1]))
            some = np.flatnonzero(filters[low:high, bands].any(axis=1))
            bins = slice(int(some[0]), int(some[-1]) + 1) if len(some) else slice(0, 0)
            parts.append((bands, bins, np.ascontiguousarray(filters[low:high, bands][bins], dtype=np.float64)))
        place = np.arange(SLIDE)
        angle = 2 * np.pi / N_FFT * (place[:, None] * np.arange(low, high)[None, :] % N_FFT)
        turn = 2 * np.pi / N_FFT * place[:, None]
        weight = np.where(place[None, :] < place[:, None], HANN[(place[None, :] - place[:, None]) % N_FFT], 0.0)
        known = np.vstack([np.hstack([np.cos(angle), -np.sin(angle)]), np.zeros((3, 2 * (high - low)))])
        return Mel(low, high, filters.shape[1], parts,
                   np.hstack([weight, np.full((SLIDE, 1), 0.5), -0.25 * np.cos(turn), -0.25 * np.sin(turn)]),
                   known, np.empty((BLOCKS_AT_ONCE * SLIDE, 2 * (high - low))))

    def decibels(self, power: np.ndarray) -> np.ndarray:
        levels = np.empty((len(power), self.bands))
        for bands, bins, weights in self.parts:
            np.matmul(power[:, bins], weights, out=levels[:, bands])
        np.maximum(levels, FLOOR_POWER, out=levels)
        np.log10(levels, out=levels)
        levels *= 10
        return levels

    def plain(self, frames: np.ndarray) -> np.ndarray:
        """Levels of frames, each transformed by itself."""
        spectrum = np.fft.rfft(frames * HANN, axis=1)[:, self.low:self.high]
        return self.decibels(spectrum.real ** 2 + spectrum.imag ** 2)

    def slid(self, frames: np.ndarray, gained: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Levels of the frames at the ascending places. ``gained``: of each sample, the one a window later less it."""
        wide, block = self.high - self.low, place // SLIDE
        first = np.flatnonzero(np.diff(block, prepend=-1))
        origin, stop = block[first] * SLIDE, np.append(first[1:], len(place))
        weights, levels = self.moved[place % SLIDE], np.empty((len(place), self.bands))
        weights[:, :SLIDE] *= np.repeat(gained[origin[:, None] + np.arange(SLIDE)], stop - first, axis=0)
        base = np.empty((BLOCKS_AT_ONCE, 3, 2 * wide))
        for at in range(0, len(first), BLOCKS_AT_ONCE):  # few enough to stay in the cache
            some = slice(at, at + BLOCKS_AT_ONCE)
            spectrum = np.fft.rfft(frames[origin[some]], axis=1)
            spectrum = np.concatenate([spectrum[:, 1:2].conj(), spectrum, spectrum[:, -2:-1].conj()], axis=1)
            here, before, after = (spectrum[:, self.low + step:self.high + step] for step in (1, 0, 2))
            total, apart = before + after, before - after
            for row, (real, imaginary) in enumerate(((here.real, here.imag), (total.real, total.imag), (apart.imag, -apart.real))):
                base[:len(here), row, :wide], base[:len(here), row, wide:] = real, imaginary
            rows = slice(first[at], stop[some][-1])
            found = self.room[:rows.stop - rows.start]
            for own, begin, end in zip(base, first[some].tolist(), stop[some].tolist()):
                self.known[SLIDE:] = own
                np.matmul(weights[begin:end], self.known, out=found[begin - rows.start:end - rows.start])
            np.multiply(found, found, out=found)
            levels[rows] = self.decibels(found[:, :wide] + found[:, wide:])
        return levels


def _clip_frames(wave: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Frames that begin at ``start`` in the padded clip, which is mirrored at its ends."""
    at = np.abs(start[:, None] + np.arange(N_FFT)[None, :])
    at = np.minimum(at, 2 * (CLIP_SAMPLES - 1) - at)
    end = CLIP_SAMPLES // len(wave) * len(wave)
    return np.where(at < end, wave[at - at // len(wave) * len(wave)], 0.0)


def mel_levels(wave: np.ndarray, mel: Mel) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel levels of the different frames of one clip, and for each of its frames which of those it is.

    Neither the clip nor its frames are written out: a frame is looked up in the wave.
    """
    count = CLIP_SAMPLES // HOP + 1
    if not len(wave):
        return np.full((1, mel.bands), 10 * np.log10(FLOOR_POWER)), np.zeros(count, np.int64)
    wave = np.asarray(wave, dtype=np.float64)[:CLIP_SAMPLES]
    first, which = _alike(len(wave), count)
    start, end = first * HOP - N_FFT // 2, CLIP_SAMPLES // len(wave) * len(wave)
    inside = (start >= 0) & (start + N_FFT <= end)
    levels = np.empty((len(first), mel.bands))
    levels[~inside] = mel.plain(_clip_frames(wave, start[~inside]))
    rows, period = np.flatnonzero(inside), len(wave)
    place = start[rows] % period
    order = np.argsort(place)
    rows, place = rows[order], place[order]
    ring = np.resize(wave, period + 2 * N_FFT) if period < CLIP_SAMPLES else wave
    frames = np.lib.stride_tricks.as_strided(ring, (len(ring) - N_FFT + 1, N_FFT), ring.strides * 2, writeable=False)
    if len(place) >= SHARED * np.count_nonzero(np.diff(place // SLIDE, prepend=-1)):
        levels[rows] = mel.slid(frames, ring[N_FFT:] - ring[:-N_FFT], place)
        return levels, which
    for at in range(0, len(place), FRAMES_AT_ONCE):
        levels[rows[at:at + FRAMES_AT_ONCE]] = mel.plain(frames[place[at:at + FRAMES_AT_ONCE]])
    return levels, which


def mel_frames(wave: np.ndarray, filters: np.ndarray) -> np.ndarray:
    """Log-mel frames of one clip: Hann window, power spectrum, filterbank, decibels."""
    levels, which = mel_levels(wave, Mel.of(filters))
    return levels[which]


def mel_mean(wave: np.ndarray, mel: Mel) -> np.ndarray:
    """Mean over the frames of :func:`mel_frames`, band by band."""
    levels, which = mel_levels(wave, mel)
    return np.bincount(which, minlength=len(levels)) @ levels / len(which)


def mel_filterbank(sr: int = SAMPLE_RATE, n_fft: int = N_FFT, n_mels: int = N_MELS, low: float = 50.0,
                   high: float = 14_000.0) -> np.ndarray:
    """Area-normalised triangular filters on the Slaney mel scale, ``[n_fft / 2 + 1, n_mels]``."""

    def to_mel(hz):
        hz = np.asarray(hz, dtype=float)
        return np.where(hz < 1000, hz / (200 / 3), 15 + np.log(np.maximum(hz, 1e-9) / 1000) * 27 / np.log(6.4))

    def to_hz(mel):
        return np.where(mel < 15, mel * 200 / 3, 1000 * np.exp((mel - 15) * np.log(6.4) / 27))

    edges = to_hz(np.linspace(to_mel(low), to_mel(high), n_mels + 2))
    bins = np.arange(n_fft // 2 + 1)[:, None] * sr / n_fft
    rise = (bins - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - bins) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)) * 2 / (edges[2:] - edges[:-2])


def sinc_table(in_sr: int, out_sr: int) -> np.ndarray:
    """Polyphase table ``[phase, tap]`` of a Blackman-windowed sinc; the cutoff follows the lower rate."""
    cutoff = min(1.0, out_sr / in_sr)
    tau = np.arange(PHASES)[:, None] / PHASES - (np.arange(2 * HALF_WIDTH)[None, :] - (HALF_WIDTH - 1))
    turn = np.pi * tau / HALF_WIDTH
    window = 0.42 + 0.5 * np.cos(turn) + 0.08 * np.cos(2 * turn)
    return cutoff * np.sinc(cutoff * tau) * window


@dataclass(frozen=True)
class Resampler:
    """What all waves of one rate share on their way to another.

    After ``step`` samples (``outs`` results) the places between samples come again, so the results of all such
    stretches are one product with ``weights``: a column for each result of a stretch, its taps at its place.
    Rounding puts some places into the phase before their own; these few results are weighed one by one.
    """

    ratio: float
    table: np.ndarray
    sums: np.ndarray  # of the first taps of each phase
    step: int
    outs: int
    centre: np.ndarray  # of each result of a stretch: the sample before it, and its phase
    phase: np.ndarray
    weights: np.ndarray | None

    @staticmethod
    def of(in_sr: int, out_sr: int, table: np.ndarray | None = None) -> Resampler:
        table = sinc_table(in_sr, out_sr) if table is None else table
        sums, common = np.pad(np.cumsum(table, axis=1), ((0, 0), (1, 0))), math.gcd(in_sr, out_sr)
        step, outs = in_sr // common, out_sr // common
        if in_sr == out_sr or (step + 2 * HALF_WIDTH) * outs > STRETCH_WEIGHTS:
            return Resampler(out_sr / in_sr, table, sums, step, outs, np.zeros(0, np.int64), np.zeros(0, np.int64), None)
        centre, rest = np.divmod(np.arange(outs) * step, outs)
        phase = rest * PHASES // outs
        weights = np.zeros((step + 2 * HALF_WIDTH, outs))
        weights[centre[:, None] + np.arange(2 * HALF_WIDTH)[None, :], np.arange(outs)[:, None]] = table[phase]
        return Resampler(out_sr / in_sr, table, sums, step, outs, centre, phase, weights)

    def __call__(self, wave: np.ndarray) -> np.ndarray:
        if self.step == self.outs or not len(wave):
            return wave
        count, taps = int(np.floor(len(wave) * self.ratio + 0.5)), 2 * HALF_WIDTH
        t = np.arange(count) / self.ratio
        centre = np.floor(t).astype(np.int64)
        phase = np.minimum(((t - centre) * PHASES).astype(np.int64), PHASES - 1)
        start = centre - (HALF_WIDTH - 1)
        stretches = -(-count // self.outs)
        # silence around the wave, so that every window lies inside
        padded = np.zeros(taps + max(len(wave), stretches * self.step) + self.step + 2 * taps)
        padded[taps:taps + len(wave)] = wave
        windows = np.lib.stride_tricks.sliding_window_view(padded, taps)
        if self.weights is None:
            value, single = np.empty(count), np.arange(count)
        else:
            size = padded.itemsize
            pieces = np.lib.stride_tricks.as_strided(
                padded[taps - (HALF_WIDTH - 1):], (stretches, self.step + taps), (self.step * size, size), writeable=False)
            value = (pieces @ self.weights).ravel()[:count]
            at = np.arange(stretches)[:, None]
            same = (at * self.step + self.centre).ravel()[:count] == centre
            single = np.flatnonzero(~(same & (np.tile(self.phase, stretches)[:count] == phase)))
        for at in range(0, len(single), SAMPLES_AT_ONCE):
            some = single[at:at + SAMPLES_AT_ONCE]
            value[some] = np.einsum("ij,ij->i", windows[start[some] + taps], self.table[phase[some]])
        total = self.sums[:, -1][phase]
        edge = np.flatnonzero((start < 0) | (start + taps > len(wave)))
        first, last = np.maximum(-start[edge], 0), np.clip(len(wave) - start[edge], 0, taps)
        total[edge] = self.sums[phase[edge], last] - self.sums[phase[edge], np.minimum(first, last)]
        faint = edge[np.abs(total[edge]) < 1e-3]  # too small for a difference of sums
        place = start[faint, None] + np.arange(taps)[None, :]
        total[faint] = (self.table[phase[faint]] * ((place >= 0) & (place < len(wave)))).sum(axis=1)
        return np.where(np.abs(total) > 1e-12, value / np.where(total == 0, 1, total), 0.0)


def resample_array(wave: np.ndarray, in_sr: int, out_sr: int, table: np.ndarray | None = None) -> np.ndarray:
    return Resampler.of(in_sr, out_sr, table)(wave)


# ---- Arrow-batch operators on arrays -----------------------------------------------------------------

def _floats(waves) -> list[np.ndarray]:
    return [np.asarray(w, dtype=np.float32) for w in waves]


def resample(df: DataFrame, out_sr: int = SAMPLE_RATE, sr: str = "sr", samples: str = "samples") -> DataFrame:
    """Every row at ``out_sr``; one table per batch and input rate."""

    @wave_udf("array<float>")
    def convert(rates: pd.Series, waves: pd.Series) -> pd.Series:
        tables = {int(r): Resampler.of(int(r), out_sr) for r in rates.unique()}
        return pd.Series([tables[int(r)](np.asarray(w, dtype=np.float64)).astype(np.float32) for r, w in zip(rates, waves)])

    return df.withColumn(samples, convert(sr, samples)).withColumn(sr, F.lit(out_sr))


def trim_rows(df: DataFrame, db: float = 60.0, frame: int = 1024, samples: str = "samples") -> DataFrame:
    @wave_udf("array<float>")
    def trim(waves: pd.Series) -> pd.Series:
        return pd.Series([trim_array(w, db, frame) for w in _floats(waves)])

    return df.withColumn(samples, trim(samples))


def envelope_rows(df: DataFrame, bars: int = 64, samples: str = "samples", out: str = "envelope") -> DataFrame:
    @wave_udf("array<float>")
    def draw(waves: pd.Series) -> pd.Series:
        return pd.Series([envelope_array(w, bars).astype(np.float32) for w in _floats(waves)])

    return df.withColumn(out, draw(samples))


def log_mel(df: DataFrame, filters: np.ndarray | None = None, id_col: str = "id",
            samples: str = "samples") -> DataFrame:
    """``id, frame, mel``: 1001 frames of 64 decibel values per clip; the filterbank is broadcast."""
    bank = mel_filterbank() if filters is None else np.asarray(filters, dtype=np.float64)
    held = df.sparkSession.sparkContext.broadcast(bank)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Mel.of(held.value)
        for batch in batches:
            for row in range(batch.num_rows):
                levels, which = mel_levels(batch.column(1)[row].values.to_numpy(zero_copy_only=False), tables)
                mel = levels.astype(np.float32)[which]
                n = len(mel)
                keys = batch.column(0).take(pa.array(np.full(n, row)))
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(n + 1, dtype=np.int32) * mel.shape[1]), pa.array(mel.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(np.arange(n, dtype=np.int32)), lists], [id_col, "frame", "mel"])

    return df.select(id_col, samples).mapInArrow(run, f"{id_col} {kind}, frame int, mel array<float>")


def log_mel_stats(df: DataFrame, filters: np.ndarray | None = None, id_col: str = "id", samples: str = "samples",
                  first: int = 0, last: int | None = None) -> DataFrame:
    """``id, frames, bands, level, band, db``: one row for each clip, from its log-mel frames: their number and size,
    the mean of all values, and the highest value of the frames ``first`` to ``last`` with its band (the lowest such).

    The frames of a clip are some hundred times larger than the clip, so they are summed up where they arise.
    """
    bank = mel_filterbank() if filters is None else np.asarray(filters, dtype=np.float64)
    held = df.sparkSession.sparkContext.broadcast(bank)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Mel.of(held.value)
        for batch in batches:
            found = []
            for row in range(batch.num_rows):
                levels, which = mel_levels(batch.column(1)[row].values.to_numpy(zero_copy_only=False), tables)
                mel, often = levels.astype(np.float32), np.bincount(which, minlength=len(levels))
                highest = mel[np.unique(which[first:None if last is None else last + 1])].max(axis=0)
                level = float(often @ mel.mean(axis=1, dtype=np.float64) / len(which))
                found.append((len(which), mel.shape[1], level, int(highest.argmax()), float(highest.max())))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *[pa.array(c, t) for c, t in zip(zip(*found), (
                        pa.int64(), pa.int32(), pa.float64(), pa.int32(), pa.float32()))]],
                    [id_col, "frames", "bands", "level", "band", "db"])

    return df.select(id_col, samples).mapInArrow(
        run, f"{id_col} {kind}, frames long, bands int, level double, band int, db float")


def augment_gain_noise(df: DataFrame, variants: int = 4, seed: int = 0, id_col: str = "id",
                       samples: str = "samples") -> DataFrame:
    """``variants`` copies per row with random gain and noise, clipped to +-1.

    The generator is seeded by (seed, id, variant), so the result does not depend on partitions or retries.
    """

    @wave_udf("array<float>")
    def change(keys: pd.Series, ks: pd.Series, waves: pd.Series) -> pd.Series:
        out = []
        for key, k, wave in zip(keys, ks, _floats(waves)):
            rng = np.random.default_rng([seed, int(key) & 0xFFFFFFFFFFFFFFFF, int(k)])
            gain = rng.uniform(*GAIN_RANGE)
            out.append(np.clip(wave * gain + rng.normal(0, NOISE_SIGMA, len(wave)), -1, 1).astype(np.float32))
        return pd.Series(out)

    copies = df.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))))
    return copies.withColumn(samples, change(F.col(id_col), F.col("k"), F.col(samples)))


def sample_positions(df: DataFrame, by: str, slice_expr, order, out: str = "pos") -> DataFrame:
    """0-based position of each sample within its signal; ``slice_expr`` cuts long signals into pieces."""
    return positions(df, [by], [slice_expr], order, out).withColumn(out, F.col(out) - 1)

