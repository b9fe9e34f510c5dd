"""Media files: scan, archives, durations, decoded signals."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atlas.functions import paths as P
from atlas.operators.arrow import batch_udf, wave_udf
from atlas.operators.intake import union_roots
from atlas.operators.signals import SAMPLE_RATE, Resampler

# Suffixes of recordings, and of archives that are reported but not opened.
MEDIA_SUFFIXES = ("wav", "aif", "aiff", "flac", "mp3", "ogg", "m4a")
CLOSED_ARCHIVES = (".rar", ".7z")
HEAD_BYTES = 4096


def scan_media(spark: SparkSession, roots: str | Sequence[str], suffixes: Sequence[str] = MEDIA_SUFFIXES,
               content: bool = False) -> DataFrame:
    """``path, modificationTime, length[, content]`` of all media files below the roots, sorted by path.

    A root may be a single file. The bytes are not read unless asked for.
    """
    names = [roots] if isinstance(roots, str) else list(roots)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    columns = ["path", "modificationTime", "length"] + (["content"] if content else [])
    wanted = P.suffix(F.col("path")).isin([f".{s}" for s in suffixes])
    return union_roots(*[reader.load(n).select(*columns).where(wanted) for n in names])


def explode_archives(df: DataFrame) -> DataFrame:
    """``archive, member, content, status`` of zip rows (``path, content``).

    Members stream out one by one. Zips inside zips stay packed. Other archive kinds are reported as
    unsupported, broken ones as bad; neither stops the job.
    """
    kind = P.suffix(F.col("path"))
    archives = df.where(kind.isin(".zip", *CLOSED_ARCHIVES)).select("path", "content", kind.alias("kind"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def row(*values):
            return pd.DataFrame([values], columns=["archive", "member", "content", "status"])

        for pdf in frames:
            for path, content, suffix in zip(pdf["path"], pdf["content"], pdf["kind"]):
                if suffix != ".zip":
                    yield row(path, None, None, "unsupported")
                    continue
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for info in z.infolist():
                            if not info.is_dir():
                                yield row(path, info.filename, z.read(info), "ok")
                except Exception:
                    yield row(path, None, None, "bad")

    return archives.mapInPandas(run, "archive string, member string, content binary, status string")


def wav_layout(head: bytes, total: int):
    """``(code, channels, rate, bits, start, size)`` of a RIFF/WAVE head; None if it is none, and
    ``"more"`` if the head ends before the sample data begins."""
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= total:
        if at + 8 > len(head):
            return "more"
        name, size = head[at:at + 4], struct.unpack("<I", head[at + 4:at + 8])[0]
        if name == b"fmt ":
            if at + 24 > len(head):
                return "more" if len(head) < total else None
            code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", head[at + 8:at + 24])
            if code == 0xFFFE and at + 34 <= len(head):
                code = struct.unpack("<H", head[at + 32:at + 34])[0]
            form = (code, channels, rate, bits)
        elif name == b"data":
            if form is None or not form[1] or form[3] not in (8, 16, 24, 32, 64):
                return None
            return (*form, at + 8, min(size, total - at - 8))
        at += 8 + size + (size & 1)
    return None


def header_seconds(head: bytes, total: int) -> float | str | None:
    """Seconds that a WAVE head tells; None and ``"more"`` as :func:`wav_layout`."""
    found = wav_layout(bytes(head), int(total))
    if not isinstance(found, tuple):
        return found
    return found[5] // (found[1] * found[3] // 8) / found[2] if found[2] else None


def _durations(heads: pd.Series, totals: pd.Series) -> pd.DataFrame:
    seconds, more = [], []
    for head, total in zip(heads, totals):
        found = header_seconds(head, total) if head is not None else None
        more.append(found == "more")
        seconds.append(None if found == "more" else found)
    return pd.DataFrame({"seconds": pd.Series(seconds, dtype="float64"), "more": more})


def probe_duration(df: DataFrame, content: str = "content", out: str = "duration") -> DataFrame:
    """Seconds from the WAV header, null when unreadable.

    Python receives the first bytes only. Files whose header is longer are probed again in full.
    """
    _duration = batch_udf("struct<seconds:double,more:boolean>")(_durations)
    total = F.length(F.col(content))
    first = df.withColumn("_d", _duration(F.substring(content, 1, HEAD_BYTES), total))
    rest = F.when(F.col("_d.more"), F.col(content))
    again = first.withColumn("_e", _duration(rest, F.coalesce(total, F.lit(0))))
    return again.withColumn(out, F.coalesce("_d.seconds", "_e.seconds")).drop("_d", "_e")


def decode_wav(content: bytes) -> tuple[int, np.ndarray] | None:
    """Sample rate and mono samples (mean over channels) of a PCM or float WAV; None if unreadable."""
    form = wav_layout(content, len(content))
    if not isinstance(form, tuple):
        return None
    code, channels, rate, bits, start, size = form
    width = bits // 8
    size -= size % (width * channels)
    raw = content[start:start + size]
    if code == 3 and bits in (32, 64):
        flat = np.frombuffer(raw, dtype=f"<f{width}").astype(np.float32)
    elif code == 1 and bits == 8:
        flat = (np.frombuffer(raw, dtype=np.uint8).astype(np.float32) - 128) / 128
    elif code == 1 and bits == 24:
        parts = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 3).astype(np.int32)
        value = parts[:, 0] | (parts[:, 1] << 8) | (parts[:, 2] << 16)
        flat = (value - ((value & 0x800000) << 1)).astype(np.float32) / 8388608
    elif code == 1 and bits in (16, 32):
        flat = (np.frombuffer(raw, dtype=f"<i{width}").astype(np.float64) / 2 ** (bits - 1)).astype(np.float32)
    else:
        return None
    return rate, flat.reshape(-1, channels).mean(axis=1, dtype=np.float32)


def _longer(content: bytes, limit: float) -> bool:
    seconds = header_seconds(content, len(content))
    return isinstance(seconds, float) and seconds > limit


def load_signals(df: DataFrame, sr: int = SAMPLE_RATE, keep: Sequence[str] = ("path",),
                 content: str = "content", longest: float | None = None,
                 change: Callable[[np.ndarray], np.ndarray | None] | None = None,
                 also: Mapping[str, Callable[[np.ndarray], np.ndarray]] | None = None) -> DataFrame:
    """``keep..., sr, samples, also...``: mono signals at ``sr``. Undecodable rows drop out, as do those whose header says
    that they last longer than ``longest`` seconds; these are not decoded.

    Decoding, resampling, what ``change`` makes of a wave (None: the row drops out) and the arrays that ``also`` takes
    from the changed wave are one pass, so a waveform leaves Python once.
    """
    also = dict(also or {})

    @wave_udf(f"struct<{','.join(f'{name}:array<float>' for name in ('samples', *also))}>")
    def decode(contents: pd.Series) -> pd.DataFrame:
        tables: dict[int, Resampler] = {}

        def one(content):
            if content is None or (longest is not None and _longer(content, longest)):
                return None
            found = decode_wav(bytes(content))
            if found is None:
                return None
            rate, wave = found
            if rate not in tables:
                tables[rate] = Resampler.of(rate, sr)
            wave = tables[rate](np.asarray(wave, dtype=np.float64)).astype(np.float32)
            return wave if change is None else change(wave)

        waves = [one(c) for c in contents]
        arrays = {"samples": waves} | {
            name: [None if w is None else take(w).astype(np.float32) for w in waves] for name, take in also.items()}
        return pd.DataFrame({name: pd.Series(values, dtype=object) for name, values in arrays.items()})

    rows = df.select(*keep, F.lit(sr).alias("sr"), decode(content).alias("_w"))
    return rows.where(F.col("_w.samples").isNotNull()).select(*keep, "sr", "_w.*")
