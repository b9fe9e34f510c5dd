"""Operators 3 and 4: held-out accuracy, gradients, edge cases."""

import zlib

import numpy as np
import pytest

from atlas.llm import quality, toxicity

FOLDER = "/root/testdata/sf0.01"


def area(scores, labels):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(len(order))
    ones = labels.sum()
    return (rank[labels == 1].sum() - ones * (ones - 1) / 2) / (ones * (len(labels) - ones))


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")


def held(tables, scored, column):
    rows = scored.where("held_out").join(tables[1], "doc_id").select("score", column, "predicted").collect()
    return tuple(np.array(x) for x in zip(*rows))


def test_quality_held_out(tables):
    scored = quality.score_quality(*tables)
    score, label, predicted = held(tables, scored, "quality")
    assert area(score, label) > 0.98 and (predicted == label).mean() > 0.95
    assert (predicted[label == 1] == 1).mean() > 0.95
    for row in scored.limit(50).collect():
        assert row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0)


def test_toxicity_held_out(spark):
    """All languages. Bars lie below what four runs with other seeds and row orders reached (README)."""
    folder = "/root/testdata/sf0.1"
    tables = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    scored = toxicity.score_toxicity(*tables)
    rows = scored.where("held_out").join(tables[1], "doc_id").join(tables[0].select("doc_id", "lang"), "doc_id").collect()
    score, label, predicted = (np.array([r[c] for r in rows]) for c in ("score", "toxic", "predicted"))
    lang = np.array([r["lang"] for r in rows])
    assert area(score, label) > 0.93
    found = {g: predicted[(lang == g) & (label == 1)].mean() for g in ("de", "en", "es", "fr")}
    assert found["de"] > 0.6 and found["en"] > 0.85 and found["fr"] > 0.8 and found["es"] > 0.2, found
    assert predicted[label == 0].mean() < 0.03
    for row in scored.limit(50).collect():
        assert row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 4 == 2)


def test_known_words_change_no_score():
    model = toxicity.BiGRU(1)
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 300, 90)) for _ in range(6)] + [None, "", "one"]
    small = toxicity.WordTable(model, most=50)  # starts anew again and again
    one_by_one = [toxicity.text_scores(model, [t], small)[0] for t in texts]
    assert np.allclose(one_by_one, toxicity.text_scores(model, texts), atol=1e-5) and len(small.places) < 400


def test_statistics_are_finite():
    for text in (None, "", " \n", "a", "|", "A" * 100_000, "x " * 50_000, "\n\n\n", "é日本😀\x00", "!!! ### 12"):
        row = quality.statistics(text)
        assert len(row) == len(quality.STATISTICS) and np.isfinite(row).all()


def test_discriminant_equals_the_densities():
    rng = np.random.default_rng(0)
    dims = len(quality.STATISTICS)
    parts = {c: rng.standard_normal((400, dims)) @ rng.standard_normal((dims, dims)) + c for c in (0, 1)}
    moments = {c: (float(len(x)), x.sum(axis=0), x.T @ x) for c, x in parts.items()}
    model = quality.fit(moments, diagonal=0, pooled=0, floor=0)
    x = np.concatenate(list(parts.values()))
    dens = []
    for c in (0, 1):
        cov, mean = np.cov(parts[c].T, bias=True), parts[c].mean(axis=0)
        z = x - mean
        dens.append(np.log(0.5) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,ij->i", z @ np.linalg.inv(cov), z))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(np.clip(dens[0] - dens[1], -500, 500))), atol=1e-6)


def test_quality_edges(spark, tables):
    docs = spark.createDataFrame(
        [(1, None, 0.0), (2, "", 0.0), (3, "word " * 100_000, 0.0), (None, "no id", 0.0), (4, "same", 0.0), (4, "same", 0.0)],
        "doc_id long, text string, score double")
    none = tables[1].limit(0)
    rows = quality.score_quality(docs, none).collect()
    assert len(rows) == 6 and all(r["score"] == 0.5 and r["predicted"] == 1 for r in rows)
    odd = spark.createDataFrame([(1, None), (2, 7), (3, 1), (3, 1), (9, 0)], "doc_id long, quality int")
    rows = quality.score_quality(docs, odd).collect()  # one class only
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert quality.score_quality(docs.limit(0), tables[1]).count() == 0
    good = quality.keep_good(docs, none)
    assert good.columns == docs.columns and good.count() == 6


def test_gradients_equal_differences():
    model = toxicity.BiGRU(3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    texts = [[b"alpha", b"be", b"gamma", b"be"], [b"x"]]
    table = {}
    ids = np.array([table.setdefault(w, len(table)) for t in texts for w in t])
    at, mask = toxicity.window_index(ids, np.array([0, 4, 5]), np.array([0, 1]), np.array([0, 0]), len(table))
    target, weight = np.array([1, 0]), np.array([1.0, 2.0])

    def loss():
        score = model.logits(model.inputs(list(table))[0], at, mask).astype(float)
        return (weight * (np.logaddexp(0, score) - target * score)).sum() / weight.sum()

    g = model.gradients(list(table), at, mask, target, weight)
    rng = np.random.default_rng(0)
    for name, value in model.p.items():
        spots = np.argwhere(np.abs(g[name]) > 1e-3)
        for spot in spots[rng.permutation(len(spots))[:4]]:
            spot, step = tuple(spot), 1e-2
            was = value[spot]
            value[spot] = was + step
            up = loss()
            value[spot] = was - step
            down = loss()
            value[spot] = was
            assert abs((up - down) / (2 * step) - g[name][spot]) < 2e-3 + 0.03 * abs(g[name][spot]), name


def test_gram_sums():
    rng = np.random.default_rng(4)
    counts = np.array([0, 3, 64, 65, 700, 1, 0, 9])
    vectors, grams = rng.standard_normal((50, 5)).astype(np.float32), rng.integers(0, 50, counts.sum())
    want = [vectors[part].sum(axis=0) for part in np.split(grams, np.cumsum(counts)[:-1])]
    assert np.allclose(toxicity.gram_sums(vectors, grams, counts), want, atol=1e-4)


def test_all_windows_are_scored():
    """Against the masked network, window by window."""
    model = toxicity.BiGRU(3)
    model.p = {k: 3 * v for k, v in model.p.items()}
    rng = np.random.default_rng(0)
    sizes = (0, 1, toxicity.WINDOW - 1, toxicity.WINDOW, toxicity.WINDOW + 1, 40, 0, 5000, 2)
    texts = [[b"w%d" % i for i in rng.integers(0, 300, n)] for n in sizes]
    known = toxicity.WordTable(model)
    for words, got in zip(texts, model.window_scores(texts)):
        starts = range(max(1, len(words) - toxicity.WINDOW + 1)) if words else range(0)
        assert len(got) == len(starts) and list(toxicity.windows_of(len(words))) == list(starts)
        if words:
            at, mask = toxicity.window_index(known.ids(words), np.array([0, len(words)]), np.zeros(len(starts), int),
                                             np.array(starts), 0)
            assert np.allclose(got, model.logits(None, at, mask, gates=known.gates), atol=1e-4)


def test_long_texts_score_as_the_best_window(monkeypatch):
    model = toxicity.BiGRU(1)
    rng = np.random.default_rng(1)
    text = " ".join(f"w{i}" for i in rng.integers(0, 500, 700))
    whole = toxicity.text_scores(model, [text, None, "", "...", "one"])
    monkeypatch.setattr(toxicity, "CHUNK_WORDS", 160)
    cut = toxicity.text_scores(model, [text, None, "", "...", "one"])
    assert np.allclose(whole, cut, atol=1e-5) and (whole[1:4] == 0).all() and whole[4] > 0


def test_toxicity_edges(spark, tables):
    docs = spark.createDataFrame(
        [(1, None, 0.0), (2, "", 0.0), (3, "word " * 100_000, 0.0), (None, "no id", 0.0), (4, "same", 0.0), (4, "same", 0.0)],
        "doc_id long, text string, label double")
    assert toxicity.score_toxicity(docs, tables[1].limit(0)).count() == 6
    odd = spark.createDataFrame([(1, None), (2, 7), (4, 1), (4, 1)], "doc_id long, toxic int")
    rows = toxicity.score_toxicity(docs, odd).collect()
    assert len(rows) == 6 and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 4}) == 1
    assert toxicity.score_toxicity(docs.limit(0), tables[1]).count() == 0
