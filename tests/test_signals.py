"""Signal operators against numpy, on long tables and on arrays."""

import io
import struct
import wave
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from atlas.operators import arrow as A
from atlas.operators import head as H
from atlas.operators import signals as G
from atlas.plans import corpus
from atlas.plans import signal_queries as S
from atlas.plans.vector_queries import wave_head
from atlas.sources import media as M


def tone(seconds, sr, lead=0.0, hz=440.0):
    t = np.arange(int(seconds * sr)) / sr
    return np.concatenate([np.zeros(int(lead * sr)), 0.5 * np.sin(2 * np.pi * hz * t), np.zeros(int(lead * sr))])


def wav_bytes(samples, sr, channels=1):
    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(sr)
        pcm = (np.clip(samples, -1, 1) * 32767).astype("<i2")
        w.writeframes(np.repeat(pcm, channels).tobytes())
    return buffer.getvalue()


def long_table(spark, signals):
    rows = [(i, p, float(v)) for i, s in enumerate(signals) for p, v in enumerate(s)]
    return spark.createDataFrame(rows, "id long, pos long, v double")


def arrays(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["id"], {})[r["pos"]] = r["v"]
    return {i: np.array([s[p] for p in range(len(s))]) for i, s in out.items()}


@pytest.fixture(scope="module")
def shapes():
    rng = np.random.default_rng(2)
    quiet = 1e-6 * rng.normal(size=40)
    burst = np.concatenate([quiet, rng.normal(size=35), quiet[:23]])
    return [burst, np.zeros(30), rng.normal(size=5), np.concatenate([np.zeros(17), [1.0], np.zeros(64)])]


def test_trim_long_equals_array(spark, shapes):
    got = arrays(G.trim_silence(long_table(spark, shapes), 60, 16))
    for i, s in enumerate(shapes):
        np.testing.assert_allclose(got[i], G.trim_array(s, 60, 16))
    assert len(got[0]) < len(shapes[0]) and len(got[1]) == 30


def test_trim_uses_a_grid_from_either_end():
    s = np.concatenate([np.zeros(10), np.ones(3), np.zeros(9)])
    # forward frames of 4 start at 8; backward frames end at 14
    assert len(G.trim_array(s, 60, 4)) == 14 - 8


def test_envelope_long_equals_array(spark, shapes):
    rows = G.envelope(long_table(spark, shapes), 16).collect()
    for i, s in enumerate(shapes):
        got = [r["level"] for r in sorted((r for r in rows if r["id"] == i), key=lambda r: r["bar"])]
        np.testing.assert_allclose(got, G.envelope_array(s, 16))


def test_padding(spark, shapes):
    df = long_table(spark, shapes)
    padded = arrays(G.repeat_pad(df, 90, 8))
    for i, s in enumerate(shapes):
        base = np.concatenate([s, np.zeros(8)]) if len(s) < 8 else s
        want = np.zeros(90)
        tiles = np.tile(base, max(1, 90 // len(base)))[:90]
        want[: len(tiles)] = tiles
        np.testing.assert_allclose(padded[i], want)
    mirrored = arrays(G.reflect_pad(df.where("id <> 2"), 9))
    for i in (0, 1, 3):
        np.testing.assert_allclose(mirrored[i], np.pad(shapes[i], 9, mode="reflect"))


def test_to_mono(spark):
    got = arrays(G.to_mono(long_table(spark, [np.array([1.0, 3.0, 5.0, 7.0])]), 2))
    np.testing.assert_allclose(got[0], [2, 6])


def test_resample_keeps_a_tone():
    for sr in (22_050, 44_100, 96_000):
        out = G.resample_array(tone(0.5, sr), sr, 48_000)
        want = tone(0.5, 48_000)
        assert abs(len(out) - len(want)) <= 1
        n = min(len(out), len(want))
        assert np.abs(out[200:n - 200] - want[200:n - 200]).max() < 5e-3


def test_resample_removes_what_the_lower_rate_cannot_hold():
    out = G.resample_array(tone(0.5, 48_000, hz=20_000.0), 48_000, 16_000)
    assert np.abs(out[200:-200]).max() < 0.02


def test_log_mel_equals_a_plain_transform(spark):
    s = tone(0.3, 48_000).astype(np.float32)
    rows = G.log_mel(spark.createDataFrame([(1, s.tolist())], "id long, samples array<float>")).collect()
    got = np.array([r["mel"] for r in sorted(rows, key=lambda r: r["frame"])])
    assert got.shape == (1001, 64)
    full = np.zeros(480_000)
    tiles = np.tile(s.astype(float), 480_000 // len(s))
    full[: len(tiles)] = tiles
    x = np.pad(full, 512, mode="reflect")
    bank = G.mel_filterbank()
    for frame in (0, 1, 500, 1000):
        part = x[frame * 480:frame * 480 + 1024] * np.hanning(1025)[:-1]
        want = 10 * np.log10(np.maximum((np.abs(np.fft.rfft(part)) ** 2) @ bank, 1e-10))
        assert np.abs(got[frame] - want).max() < 0.5


def test_augmentation_does_not_depend_on_partitions(spark):
    rows = [(i, [0.1] * 50) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, samples array<float>")

    def run(n):
        out = G.augment_gain_noise(df.repartition(n), seed=9).collect()
        return {(r["id"], r["k"]): r["samples"] for r in out}

    a = run(1)
    assert a == run(7) and len(a) == 160
    assert a[(0, 0)] != a[(0, 1)] and max(abs(v) for v in a[(3, 2)]) <= 1


def test_decode_formats():
    s = tone(0.05, 44_100)
    sr, mono = M.decode_wav(wav_bytes(s, 44_100, 2))
    assert sr == 44_100 and np.abs(mono - s).max() < 1e-3

    def riff(code, bits, data, rate=8000):
        fmt = struct.pack("<HHIIHH", code, 1, rate, rate * bits // 8, bits // 8, bits)
        body = b"WAVEfmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(data)) + data
        return b"RIFF" + struct.pack("<I", len(body)) + body

    np.testing.assert_allclose(M.decode_wav(riff(3, 32, np.array([0.5, -1], "<f4").tobytes()))[1], [0.5, -1])
    np.testing.assert_allclose(M.decode_wav(riff(1, 8, bytes([128, 255])))[1], [0, 127 / 128])
    np.testing.assert_allclose(M.decode_wav(riff(1, 24, b"\x00\x00\x40\x00\x00\xc0"))[1], [0.5, -0.5])
    assert M.decode_wav(b"RIFFxxxxWAVE") is None and M.decode_wav(b"") is None


def test_durations(spark):
    plain = wav_bytes(tone(0.25, 8000), 8000)
    filler = b"junk" + struct.pack("<I", 9000) + bytes(9000)
    late = plain[:12] + filler + plain[12:]
    rows = [("a", bytearray(plain)), ("late", bytearray(late)), ("bad", bytearray(b"nothing here")), ("empty", bytearray())]
    df = spark.createDataFrame(rows, "path string, content binary")
    got = {r["path"]: r["duration"] for r in M.probe_duration(df).collect()}
    assert got == {"a": 0.25, "late": 0.25, "bad": None, "empty": None}


def write_tree(root):
    (root / "kit" / "deep").mkdir(parents=True)
    (root / "kit" / "a.WAV").write_bytes(wav_bytes(tone(0.2, 22_050, 0.1), 22_050))
    (root / "kit" / "deep" / "b.wav").write_bytes(wav_bytes(tone(0.3, 48_000), 48_000, 2))
    (root / "kit" / "long.wav").write_bytes(wav_bytes(tone(3.5, 8000), 8000))
    (root / "kit" / "broken.wav").write_bytes(b"not a recording")
    (root / "kit" / "notes.txt").write_text("x")


def test_scan_union_of_roots(spark, tmp_path):
    write_tree(tmp_path)
    root, nested, single = str(tmp_path), str(tmp_path / "kit" / "deep"), str(tmp_path / "kit" / "a.WAV")

    def paths(*roots):
        return [r["path"] for r in M.scan_media(spark, list(roots)).collect()]

    assert len(paths(root)) == 4 and paths(root) == sorted(paths(root))
    assert paths(root, nested, root) == paths(root)
    assert len(paths(nested, single)) == 2
    assert "content" not in M.scan_media(spark, root).columns


def test_archives(spark):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep.wav", b"1")
    outer = io.BytesIO()
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("x/a.wav", b"22")
        z.writestr("nested.zip", inner.getvalue())
    rows = [("ok.ZIP", bytearray(outer.getvalue())), ("bad.zip", bytearray(b"zz")), ("c.rar", bytearray(b"r")),
            ("d.wav", bytearray(b"w"))]
    got = M.explode_archives(spark.createDataFrame(rows, "path string, content binary")).collect()
    assert {(r["archive"], r["member"], r["status"]) for r in got} == {
        ("ok.ZIP", "x/a.wav", "ok"), ("ok.ZIP", "nested.zip", "ok"), ("bad.zip", None, "bad"),
        ("c.rar", None, "unsupported")}


def make_loader():
    def loader():
        def model(waves):
            return np.stack([np.abs(np.fft.rfft(np.asarray(w, dtype=float), 126)) for w in waves])

        return model

    return loader


def test_analyze_files(spark, tmp_path):
    write_tree(tmp_path)
    files = M.scan_media(spark, str(tmp_path), content=True).select("path", "content")
    rows = {r["filename"]: r for r in corpus.analyze(files, make_loader(), wave_head()).collect()}
    assert set(rows) == {"a.WAV", "b.wav"}  # too long and unreadable files are gone
    assert abs(rows["a.WAV"]["duration"] - 0.2) < 0.05 and len(rows["a.WAV"]["envelope"]) == 64
    assert abs(np.linalg.norm(rows["b.wav"]["embedding"]) - 1) < 1e-5 and len(rows["b.wav"]["tags"]) == 3


def test_build_corpus(spark, tmp_path):
    import hashlib

    root = tmp_path / "lib"
    root.mkdir()
    names = [("Kick 1.wav", "_unsorted"), ("thing.wav", "_unsorted"), ("Snare.wav", "Clap"), ("x.wav", "Tom")]
    rows = []
    for i, (name, label) in enumerate(names):
        data = wav_bytes(tone(0.1 + i / 50, 48_000), 48_000)
        digest = hashlib.md5(data).hexdigest()
        (root / f"{digest[:12]}.wav").write_bytes(data)
        rows.append((digest, label, name))
    rows.append(("f" * 32, "Tom", "gone.wav"))
    manifest = spark.createDataFrame(rows, "hash string, label string, orig_name string")
    files = M.scan_media(spark, str(root), content=True)
    got = sorted(r["label"] for r in corpus.build_corpus(manifest, files, make_loader()).collect())
    assert got == ["Kick", "Snare", "Tom"]


def test_failed_embeddings_drop_out(spark):
    def bad_loader():
        def model(texts):
            return np.array([[np.nan, 1.0] if t == "bad" else [3.0, 4.0] for t in texts])

        return model

    df = spark.createDataFrame([("ok",), ("bad",)], "text string")
    rows = H.embed(df, bad_loader).collect()
    assert [r["text"] for r in rows] == ["ok"] and np.allclose(rows[0]["embedding"], [0.6, 0.8])


def test_head_scores_match_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(20, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    head = wave_head(min_confidence=0.13)
    rows = {r["id"]: r for r in H.score(df, head).collect()}
    w = {k: np.array(v) for k, v in head.items() if k not in ("labels", "min_confidence")}
    p = H.probabilities(x, w)
    assert np.allclose(p.sum(axis=1), 1)
    for i in range(20):
        best = p[i].argmax()
        assert abs(rows[i]["confidence"] - p[i, best]) < 1e-9
        assert rows[i]["section"] == (f"L{best}" if p[i, best] >= 0.13 else "Unsorted")


def test_fitted_head_separates_planted_classes(spark):
    rng = np.random.default_rng(4)
    truth = np.array([0] * 90 + [1] * 20 + [2] * 10)
    x = np.eye(3)[truth] * 2 + 0.1 * rng.normal(size=(120, 3))
    df = spark.createDataFrame([(f"c{t}", v.tolist()) for t, v in zip(truth, x)], "label string, embedding array<double>")
    model, names = H.fit_head(df)
    assert names == ["c0", "c1", "c2"]
    scores = x @ model.coefficientMatrix.toArray().T + model.interceptVector.toArray()
    assert (scores.argmax(axis=1) == truth).all()


def test_long_form_of_arrays(spark):
    df = spark.createDataFrame([(1, [0.5, 0.25]), (2, [1.0])], "id long, samples array<float>")
    back = {r["id"]: r["samples"] for r in G.to_arrays(G.from_arrays(df)).collect()}
    assert back == {1: [0.5, 0.25], 2: [1.0]}
    with pytest.raises(Exception, match="signal too long"):
        G.to_arrays(G.from_arrays(df), max_samples=1).agg(F.sum(F.size("samples"))).collect()


@pytest.mark.parametrize("length", [0, 1, 40, 777, 1200, 2500, 479_999, 480_001])
def test_frames_of_a_repeated_wave_equal_a_plain_transform(length):
    wave, bank = np.random.default_rng(length).normal(size=length), G.mel_filterbank()
    x = np.pad(G.pad_array(wave), 512, mode="reflect")
    frames = np.lib.stride_tricks.sliding_window_view(x, 1024)[::480] * np.hanning(1025)[:-1]
    want = 10 * np.log10(np.maximum(np.abs(np.fft.rfft(frames, axis=1)) ** 2 @ bank, 1e-10))
    np.testing.assert_allclose(G.mel_frames(wave, bank), want, atol=1e-6)
    if 0 < length < 2000:
        assert len(G._alike(length, 1001)[0]) < 1001


@pytest.mark.parametrize("rates", [(22_050, 48_000), (44_100, 48_000), (48_000, 16_000), (8_000, 11_025)])
@pytest.mark.parametrize("length", [1, 31, 64, 3_000])
def test_resampler_equals_its_definition(rates, length):
    (a, b), wave = rates, np.random.default_rng(length).normal(size=length)
    table, got = G.sinc_table(a, b), G.resample_array(wave, a, b)
    for k in {0, 1, len(got) // 2, len(got) - 1} & set(range(len(got))):
        t = k / (b / a)
        weights = table[min(int((t - np.floor(t)) * G.PHASES), G.PHASES - 1)]
        at = int(np.floor(t)) + np.arange(64) - 31
        ok = (at >= 0) & (at < length)
        assert abs(got[k] - weights[ok] @ wave[at[ok]] / weights[ok].sum()) < 1e-9


def test_mel_sums_equal_the_frames(spark):
    waves = spark.createDataFrame([(1, tone(0.01, 48_000).tolist()), (2, [0.1] * 7), (3, [])], "id long, samples array<float>")
    stats = {r["id"]: r for r in G.log_mel_stats(waves, first=100, last=900).collect()}
    for i, rows in G.log_mel(waves).toPandas().groupby("id"):
        mel = np.stack(rows.sort_values("frame")["mel"])
        got = stats[i]
        assert (got["frames"], got["bands"]) == mel.shape and abs(got["level"] - mel.mean(dtype=float)) < 1e-4
        amid = mel[100:901].max(axis=0)
        assert got["db"] == amid.max() and got["band"] == amid.argmax()
    assert len(stats) == 3


def test_a_batch_of_waveforms_is_passed_on_in_pieces(spark):
    rows = spark.range(0, 5000, 1, 1).select("id", F.array_repeat(F.lit(1.0), 3000).alias("samples"))

    @A.piece_udf("struct<id:long,rows:int>")
    def seen(ids, waves):
        return pd.DataFrame({"id": ids.to_numpy(), "rows": np.full(len(ids), len(ids), np.int32)})

    got = rows.select("id", seen("id", "samples").alias("s")).collect()
    assert all(r["id"] == r["s"]["id"] for r in got) and len(got) == 5000
    assert max(r["s"]["rows"] for r in got) <= A.PIECE_ITEMS // 3000  # before: thousands at once
    assert list(A.pieces((pd.Series([None, "x"], dtype=object),))) == [(0, 2)] and not list(A.pieces((pd.Series([]),)))


def test_too_long_recordings_are_not_decoded(spark):
    files = [("a", wav_bytes(tone(0.2, 8000), 8000)), ("b", wav_bytes(tone(0.5, 8000), 8000)), ("c", b"none"), ("d", None)]
    df = spark.createDataFrame(files, "path string, content binary")
    assert [r["path"] for r in M.load_signals(df, longest=0.3).collect()] == ["a"]
    assert sorted(r["path"] for r in M.load_signals(df).collect()) == ["a", "b"]


def test_levels_next_to_half_a_hundredth_equal_the_closed_form(spark, tmp_path):
    # amplitude 0.7 at 3400 Hz: the level is 0.494975, and 0.495012 with the resampler's ripple
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.limit(1).withColumn("doc_id", F.lit(246).cast("long")).write.parquet(str(tmp_path / "documents.parquet"))
    assert S.resample_tones(spark, str(tmp_path)).first()["rms"] == 0.49


@pytest.mark.parametrize("length", [997, 1001, 2003])
def test_frames_of_a_clip_share_transforms(length, monkeypatch):
    wave, rows, plain = np.random.default_rng(length).normal(size=length), [], np.fft.rfft
    wave[length // 2:] = 0  # silence beside noise, so that what one frame leaves behind would show in the next
    monkeypatch.setattr(np.fft, "rfft", lambda x, axis: rows.append(len(x)) or plain(x, axis=axis))
    levels, which = G.mel_levels(wave, G.Mel.of(G.mel_filterbank()))
    monkeypatch.undo()
    assert len(which) == 1001 and sum(rows) < 100  # before: one for each of some 1000 different frames
    x = np.pad(G.pad_array(wave), 512, mode="reflect")
    frames = np.lib.stride_tricks.sliding_window_view(x, 1024)[::480] * np.hanning(1025)[:-1]
    want = 10 * np.log10(np.maximum(np.abs(plain(frames, axis=1)) ** 2 @ G.mel_filterbank(), 1e-10))
    np.testing.assert_allclose(levels[which], want, atol=1e-6)
    np.testing.assert_allclose(G.mel_mean(wave, G.Mel.of(G.mel_filterbank())), want.mean(axis=0), atol=1e-6)


def test_rows_of_a_corpus_are_spread_before_they_are_decoded(spark):
    data = wav_bytes(tone(0.01, 48_000), 48_000)
    rows = [(f"{i:012x}", "Tom", "x.wav", f"{i:012x}.wav", data) for i in range(40)]
    every = spark.createDataFrame(rows, "hash string, label string, orig_name string, path string, content binary")
    files = every.groupBy("path").agg(F.min_by("content", "hash").alias("content"))  # dealt by path already
    done = corpus.build_corpus(every.select("hash", "label", "orig_name"), files, make_loader())
    assert done.count() == 40
    assert done.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism  # before: merged by its few bytes


def test_results_of_a_stretch_are_one_product(monkeypatch):
    wave, rows, plain = np.random.default_rng(1).normal(size=4000), [], np.einsum
    monkeypatch.setattr(np, "einsum", lambda how, a, b: rows.append(len(a)) or plain(how, a, b))
    for rates in ((22_050, 48_000), (44_100, 48_000), (48_000, 16_000)):
        got = G.Resampler.of(*rates)(wave)
        assert sum(rows) < len(got) / 4  # before: each by itself
        rows.clear()
        one_by_one = G.Resampler.of(*rates)
        object.__setattr__(one_by_one, "weights", None)
        np.testing.assert_allclose(got, one_by_one(wave), atol=1e-12)
        rows.clear()


def test_waves_are_changed_where_they_are_decoded(spark):
    files = [("a", wav_bytes(tone(0.2, 48_000, 0.1), 48_000)), ("b", wav_bytes(tone(3.5, 8000), 8000)), ("c", b"none"),
             ("e", wav_bytes(np.zeros(0), 8000))]
    df = spark.createDataFrame(files, "path string, content binary")
    done = corpus.analyze(df, make_loader(), wave_head())
    apart = G.envelope_rows(G.trim_rows(M.load_signals(df).where("path = 'a'"))).first()
    row, = done.collect()
    assert row["path"] == "a" and row["envelope"] == apart["envelope"]
    assert abs(row["duration"] - len(apart["samples"]) / 48_000) < 1e-9
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") <= 3  # before: 4, one more with all samples going in and out


def test_waves_leave_as_whole_arrays(spark):
    @A.wave_udf("struct<samples:array<float>,ends:array<float>>", rows=2)
    def waves(n):
        made = [None if v is None or np.isnan(v) else np.arange(int(v), dtype=np.float64) for v in n]
        ends = [None if w is None else w[-1:] for w in made]
        return pd.DataFrame({"samples": pd.Series(made, dtype=object), "ends": pd.Series(ends, dtype=object)})

    rows = spark.createDataFrame([(0, 3), (1, None), (2, 0), (3, 2), (4, 1)], "id int, n int").coalesce(1)
    got = {r["id"]: (r["w"]["samples"], r["w"]["ends"]) for r in rows.withColumn("w", waves("n")).collect()}
    assert got == {0: ([0, 1, 2], [2]), 1: (None, None), 2: ([], []), 3: ([0, 1], [1]), 4: ([0], [0])}
    assert A._lists(pd.Series([], dtype=object)).to_pylist() == []


def test_missing_files_are_spread_before_they_are_decoded(spark, tmp_path, monkeypatch):
    files = spark.range(40).select(F.concat("id", F.lit(".wav")).alias("path"), F.col("id").cast("string").alias("fingerprint"),
                                   F.lit(wav_bytes(tone(0.01, 48_000), 48_000)).alias("content"))
    seen, plain = [], corpus.analyze

    def watched(wanted, *args, **named):
        wanted.count()
        seen.append(wanted.rdd.getNumPartitions())
        return plain(wanted, *args, **named)

    monkeypatch.setattr(corpus, "analyze", watched)
    # a broadcast needs no exchange, and a plan of its own would hide what a larger table meets
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = corpus.analyze_cached(files, make_loader(), wave_head(), str(tmp_path / "cache"), 1)
        assert rows.count() == 40
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert seen[0] >= 2 * spark.sparkContext.defaultParallelism  # before: merged by their few bytes
