"""Operator 6, against brute force."""

import math
import random
import re
import time

from pyspark.sql import functions as F

from atlas.llm import disclosure

BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in value.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def plain_spans(text):
    return [(k, m.start(), m.end(), m.group()) for k, p in BASE for m in re.finditer(p, text or "") if passes(k, m.group())]


def terms(text):
    rest = text or ""
    for _, p in BASE:
        rest = re.sub(p, " ", rest)
    return {w for w in re.findall(r"[^\W\d_]+", rest.lower()) if len(w) >= 4}


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(3)
    pool = ["a@b.c", "a@b.c_d@e.f", "x.y@z-1.co.uk.", "1.2.3.4", "256.1.1.1", "001.02.3.4.5.6.7.8", "4111 1111 1111 1111",
            "4111-1111-1111-1112", "+1 (386) 555-3733", "+49 30 1234567890123", "+1", "é", "日本 ", ".", "@", "-", " ",
            "  ", "12", "+", "(", ")", "foo", "😀", "\n", "_", "%", "378282246310005"]
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 14))) for _ in range(1500)] + [None, ""]
    long = ["a." * 20_000 + "@x", "1" * 50_000, "1 " * 30_000, "+" + "1 " * 30_000]
    frame = spark.createDataFrame(list(enumerate(texts + long)), "i long, text string")
    got = {r["i"]: r["s"] for r in frame.select("i", disclosure.base_spans(F.coalesce("text", F.lit(""))).alias("s")).collect()}
    for i, text in enumerate(texts):
        assert [tuple(s) for s in got[i]] == plain_spans(text), text
    assert all(got[len(texts) + i] == [] for i in range(len(long)))


def corpus():
    rng = random.Random(1)
    words = ["common", "words", "everyone", "writes", "about", "weather", "today", "again"]
    rows = []
    for i in range(40):
        rows.append((i, " ".join(rng.choices(words, k=12))))
    for i in range(40, 45):  # "zeppelin" occurs only with the entity, "harbour" nearly so
        rows.append((i, f"number {i} zeppelin harbour ann.smith@mail.example {' '.join(rng.choices(words, k=5))}"))
    rows += [(45, "harbour alone today"), (46, "Zeppelin, ZEPPELIN ann.smith@mail.example zeppelins harbour common"),
             (47, None), (48, ""), (49, rows[41][1]), (49, rows[41][1]), (None, "call +1 (386) 555-3733 now")]
    return rows


def brute_pairs(rows, t):
    texts = {x or "" for _, x in rows}
    entities = {x: {f"{k}:{v}" for k, _, _, v in plain_spans(x)} for x in texts}
    found = {}
    for e in {e for s in entities.values() for e in s}:
        with_e = [x for x in texts if e in entities[x]]
        if len(with_e) < t.support:
            continue
        for term in {w for x in with_e for w in terms(x)}:
            joint = sum(term in terms(x) for x in with_e)
            all_t = sum(term in terms(x) for x in texts)
            info = math.log2(len(texts) / len(with_e))
            value = math.log2(joint * len(texts) / (len(with_e) * all_t)) / info if info > 0 else 0
            if joint >= t.support and value >= t.generalise:
                found[e, term] = (joint, len(with_e), all_t, round(value, 9))
    return found


def test_disclosure_equals_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, x, "k", "t") for i, x in rows], "doc_id long, text string, key string, terms string")
    t = disclosure.Thresholds()
    _, pairs = disclosure.revealing_terms(docs, thresholds=t)
    got = {(r["entity"], r["term"]): (r["joint"], r["entity_texts"], r["term_texts"], round(r["disclosure"], 9))
           for r in pairs.collect()}
    assert got == brute_pairs(rows, t) and ("email:ann.smith@mail.example", "zeppelin") in got
    spans = disclosure.all_spans(docs)
    assert spans.columns == [*docs.columns, "_spans", "_levels"] and spans.count() == len(rows)
    flagged = {term for _, term in got}
    for r in spans.collect():
        text = r["text"] or ""
        base = plain_spans(text)
        words = [("term", m.start(), m.end(), m.group()) for m in re.finditer(r"[^\W\d_]+", text)
                 if m.group().lower() in flagged and any(v == "ann.smith@mail.example" for _, _, _, v in base)]
        words = [w for w in words if not any(w[1] < b[2] and b[1] < w[2] for b in base)]
        assert [tuple(s) for s in r["_spans"]] == base + words


def test_sanitise(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in disclosure.sanitise(docs).collect()}
    assert clean[None] == "call [PHONE] now" and clean[47] is None and clean[48] == "" and clean[45] == "harbour alone today"
    assert "zeppelin " not in clean[42].lower() and "[EMAIL]" in clean[42] and "[TERM]" in clean[42]
    assert clean[46] == ",  [EMAIL] zeppelins [TERM] common"
    assert disclosure.sanitise(docs.limit(0)).count() == 0


def test_overlapping_spans_are_covered(spark):
    docs = spark.createDataFrame([(1, "x +41 111 111 111 1111 1.2.3.4@a.bc é")], "doc_id long, text string")
    text = disclosure.sanitise(docs).first()["text"]
    assert not re.search("[0-9@]", text) and text.startswith("x +[CARD") and text.endswith(" é")


def test_revealing_terms_go_everywhere(spark):
    rows = corpus() + [(60 + i, f"zep ann.smith@mail.example number {i}") for i in range(8)] + [(70, "Zep alone, zeppelins")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, pairs = disclosure.revealing_terms(docs, everywhere=True)
    flagged = {r["term"] for r in pairs.collect()}
    assert "zep" in flagged
    clean = {r["doc_id"]: r["text"] for r in disclosure.sanitise(docs, everywhere=True).collect()}
    assert "Zep " not in clean[70] and clean[70].endswith("alone, zeppelins")
    for text in clean.values():
        assert not flagged & set(re.findall(r"[^\W\d_]+", (text or "").lower().replace("[term]", "")))
    assert clean[47] is None and disclosure.sanitise(docs.limit(0), everywhere=True).count() == 0


def test_many_matches_take_linear_time(spark):
    hard = "".join(f"10.0.{i // 250}.{i % 250} né x{i}@a.de; " for i in range(50_000))
    some = [hard] + ["".join(f"a{i}@b.c +49 123 4567{i % 10:02d} é" for i in range(n)) for n in (0, 1, 63, 64, 65, 128, 129, 200)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(some)], "doc_id long, text string")
    spans = disclosure.base_spans(F.col("text"))
    start = time.time()
    got = {r["doc_id"]: r for r in docs.select("doc_id", F.size(spans).alias("n"),
           disclosure.sanitised(F.col("text"), spans, F.create_map().cast("map<string,string>")).alias("clean")).collect()}
    assert time.time() - start < 60
    assert got[0]["n"] == 100_000
    assert got[0]["clean"] == "[IP] né [EMAIL]; " * 50_000
    for i, n in enumerate((0, 1, 63, 64, 65, 128, 129, 200), 1):
        assert got[i]["clean"] == "[EMAIL] [PHONE] é" * n
