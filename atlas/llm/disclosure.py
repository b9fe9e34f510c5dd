"""Personal data and the terms that reveal it (operator 6), in DataFrame and SQL functions only.

Base spans are e-mail addresses, IP addresses, card and phone numbers, by pattern and check. Their values are
the protected entities. Co-occurrence over the whole corpus, counted in distinct texts, says how much a term
tells about an entity: with ``p`` a share of texts, the information of the entity is ``-log p(e)`` and the
pointwise mutual information ``log p(e, t) / (p(e) p(t))``; their ratio, 1 for a term that occurs only with
the entity, is the disclosure of ``e`` by ``t``. Terms beyond ``generalise`` become their kind, terms beyond
``remove`` go: with ``everywhere`` in all texts, else in those that mention the entity. Counts below ``support``
texts say nothing.

The patterns of the contract are written so that matching takes linear time: a run of characters is entered
at its start or where the last match ended, and taken whole. That finds the same leftmost matches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atlas.llm.names import shielded
from atlas.session import cut_lineage

LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
TERM = r"\p{L}+"  # a term is a run of letters, lower-cased
SPAN = "struct<kind:string,start:int,end:int,value:string>"
PIECE = "struct<from:int,to:int,mark:string>"
CHUNK = 64  # items that one inner fold appends
FEW_ROWS = 100_000  # rows of a narrow table that is broadcast, some megabytes


@dataclass(frozen=True)
class Thresholds:
    """``support``: least number of distinct texts; the two others: least disclosure."""

    support: int = 3
    generalise: float = 0.9
    remove: float = 0.97


def few(df: DataFrame, limit: int = FEW_ROWS) -> DataFrame:
    """``df``, to be broadcast if it has at most ``limit`` rows, else joined by shuffling."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def bound(value: Column, use: Callable) -> Column:
    """``use(value)`` with ``value`` worked out once, however often a function of items mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def chunked(items: Column, size: int = CHUNK) -> Column:
    """Array of arrays of at most ``size`` items; one empty array if there are none."""
    def cut(held: Column) -> Column:
        last = F.greatest(F.ceil(F.size(held) / size).cast("int") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(held, i * size + 1, F.lit(size)))

    return bound(items, cut)


def running(items: Column, zero: Column, advance: Callable, emit: Callable, kind: str) -> Column:
    """Array of ``emit(state, item)`` of type ``kind``, with the state that the items before ``item`` lead to.

    A fold that appends copies what it has at every step. Here the states at chunk starts are found first, and
    each chunk appends to a list of its own.
    """
    def starts(chunks: Column) -> Column:
        return F.aggregate(
            chunks, F.struct(zero.alias("state"), F.slice(F.array(zero), 1, 0).alias("starts")),
            lambda a, part: F.struct(F.aggregate(part, a["state"], advance).alias("state"),
                                     F.concat(a["starts"], F.array(a["state"])).alias("starts")),
            lambda a: a["starts"])

    def within(part: Column, state: Column) -> Column:
        begin = F.struct(state.alias("state"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.aggregate(
            part, begin,
            lambda a, item: F.struct(advance(a["state"], item).alias("state"),
                                     F.concat(a["out"], F.array(emit(a["state"], item))).alias("out")),
            lambda a: a["out"])

    return bound(chunked(items), lambda chunks: F.flatten(F.zip_with(chunks, starts(chunks), within)))


def found_at(text: Column, pattern: Column | str, kind: str) -> Column:
    """Array of (kind, start, end, value) of the leftmost non-overlapping matches, offsets in code points.

    Texts between matches and matches alternate, so offsets are running sums of their lengths.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    values = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(values))

    def span(pos: Column, pair: Column) -> Column:
        at = pos + F.length(pair["gap"])
        return F.struct(F.lit(kind).alias("kind"), at.alias("start"), (at + F.length(pair["value"])).alias("end"),
                        pair["value"].alias("value"))

    pairs = F.arrays_zip(gaps.alias("gap"), values.alias("value"))
    return running(pairs, F.lit(0), lambda pos, pair: pos + F.length(pair["gap"]) + F.length(pair["value"]), span, SPAN)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _small_part(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+", "")
    return F.when(F.length(bare) == 0, True).when(F.length(bare) > 3, False).otherwise(bare.try_cast("int") <= 255)


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), _small_part),
    "card": lambda v: F.length(_digits(v)).between(13, 19) & F.call_function("luhn_check", _digits(v)),
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
}
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}  # a text without it has no match


def base_spans(text: Column) -> Column:
    """Spans of all kinds, by kind in the order of ``KINDS``, then start."""
    none = F.array().cast(f"array<{SPAN}>")
    parts = []
    for kind, pattern in PATTERNS.items():
        valid = VALID[kind]
        spans = F.filter(found_at(text, pattern, kind), lambda s: valid(s["value"]))
        may = F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else F.lit(True)
        if kind != "email":
            may = may & text.rlike("[0-9]")
        parts.append(F.when(may, spans).otherwise(none))
    return F.concat(*parts)


def terms_of(text: Column) -> Column:
    """Distinct terms of a text without whatever matches a base pattern."""
    rest = text
    for pattern in PATTERNS.values():
        rest = F.regexp_replace(rest, pattern, " ")
    return F.array_distinct(F.regexp_extract_all(F.lower(rest), F.lit(TERM), F.lit(0)))


def entity_of(span: Column) -> Column:
    return F.concat(span["kind"], F.lit(":"), span["value"])


def revealing_terms(docs: DataFrame, text_col: str = "text",
                    thresholds: Thresholds = Thresholds(), everywhere: bool = False) -> tuple[DataFrame, DataFrame]:
    """``key, terms`` (key: md5 of a text; terms: array of (term, level)) for texts with revealing terms, and
    ``entity, term, joint, entity_texts, term_texts, disclosure`` for all revealing pairs.

    With ``everywhere`` a revealing term is listed for every text that holds it, at its highest level. Only texts
    with personal data teach terms. Texts are counted once however often they appear:
    the repeated ones are found by key, and a row of a text with ``n`` copies counts ``1 / n``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = docs.select(F.md5(text).alias("key"), F.transform(base_spans(text), entity_of).alias("entities"),
                         text.alias("text"))
    narrow = cut_lineage(marked.select("key", F.array_distinct("entities").alias("entities"),
                                       F.when(F.size("entities") > 0, terms_of(F.col("text"))).alias("terms")))
    copies = cut_lineage(narrow.groupBy("key").agg(F.count(F.lit(1)).alias("copies")))
    texts = copies.count()
    personal = cut_lineage(narrow.where(F.size("entities") > 0).groupBy("key").agg(
        F.first("entities").alias("entities"), F.first("terms").alias("terms")))
    mentions = personal.select("key", F.explode("entities").alias("entity"), "terms")
    known = mentions.groupBy("entity").agg(F.count(F.lit(1)).alias("entity_texts")).where(
        F.col("entity_texts") >= thresholds.support)
    unfolded = cut_lineage(mentions.join(known, "entity").select(
        "key", "entity", "entity_texts", F.explode("terms").alias("term")))
    information = F.log2(F.lit(float(texts)) / F.col("entity_texts"))
    mutual = F.log2(F.col("joint") * F.lit(float(texts)) / (F.col("entity_texts") * F.col("term_texts")))
    disclosure = F.when(information > 0, mutual / information).otherwise(0.0)

    # texts with personal data alone give the least number of texts that hold a term, and so the most that it
    # can disclose: common words need no count over the whole corpus
    least = personal.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("term_texts"))
    pairs = unfolded.groupBy("entity", "term").agg(
        F.count(F.lit(1)).alias("joint"), F.first("entity_texts").alias("entity_texts")
    ).where(F.col("joint") >= thresholds.support)
    pairs = cut_lineage(pairs.join(least, "term").where(disclosure >= thresholds.generalise).drop("term_texts"))

    asked = few(pairs.select("term").distinct())
    repeated = few(copies.where("copies > 1"))
    spread = docs.select(F.md5(text).alias("key"), text.alias("text")).join(repeated, "key", "left").select(
        F.coalesce("copies", F.lit(1)).alias("copies"), F.explode(terms_of(F.col("text"))).alias("term"))
    term_texts = spread.join(asked, "term", "left_semi").groupBy("term").agg(
        F.round(F.sum(1 / F.col("copies"))).cast("long").alias("term_texts"))

    pairs = cut_lineage(
        pairs.join(term_texts, "term").withColumn("disclosure", disclosure)
        .where(F.col("disclosure") >= thresholds.generalise)
        .select("entity", "term", "joint", "entity_texts", "term_texts", "disclosure"))
    level = F.when(F.max("disclosure") >= thresholds.remove, "remove").otherwise("generalise")
    if everywhere:
        flagged = few(cut_lineage(pairs.groupBy("term").agg(level.alias("level"))))
        listed = (docs.select(F.md5(text).alias("key"), F.explode(terms_of(text)).alias("term")).join(flagged, "term")
                  .groupBy("key").agg(F.sort_array(F.collect_set(F.struct("term", "level"))).alias("terms")))
        return cut_lineage(listed), pairs
    listed = (unfolded.join(few(pairs.select("entity", "term", "disclosure")), ["entity", "term"])
              .groupBy("key", "term").agg(level.alias("level"))
              .groupBy("key").agg(F.sort_array(F.collect_list(F.struct("term", "level"))).alias("terms")))
    return cut_lineage(listed), pairs


def all_spans(docs: DataFrame, text_col: str = "text", thresholds: Thresholds = Thresholds(),
              everywhere: bool = False) -> DataFrame:
    """``docs`` with ``_spans`` (base spans, then ``term`` spans by start) and ``_levels`` (term: level).

    Null texts are empty. Term spans that overlap a base span are left out. Repeated rows have the same spans.
    An empty table gives no rows. Columns of ``docs`` are kept; they must not be called ``_spans``, ``_levels``,
    ``_key`` or ``_terms``.
    """
    listed, _ = revealing_terms(docs, text_col, thresholds, everywhere)
    text = F.coalesce(docs[text_col], F.lit(""))
    joined = (docs.withColumn("_key", F.md5(text))
              .join(few(listed.select(F.col("key").alias("_key"), F.col("terms").alias("_terms"))), "_key", "left"))
    base = base_spans(text)
    words = F.array_join(F.transform("_terms", lambda t: t["term"]), "|")  # letters only, nothing to quote
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), words, F.lit(r")(?!\p{L})"))
    terms = F.when(F.col("_terms").isNotNull(), found_at(text, pattern, "term")).otherwise(
        F.array().cast(f"array<{SPAN}>"))
    return (joined.withColumn("_base", base).withColumn("_found", terms)
            .withColumn("_spans", F.concat("_base", F.filter("_found", lambda t: ~F.exists(
                "_base", lambda b: (t["start"] < b["end"]) & (b["start"] < t["end"])))))
            .withColumn("_levels", F.coalesce(F.map_from_entries("_terms"), F.create_map().cast("map<string,string>")))
            .select(*[docs[c] for c in docs.columns], "_spans", "_levels"))


def spans_of(kind: str) -> Column:
    return F.filter("_spans", lambda s: s["kind"] == kind)


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def sanitised(text: Column, spans: Column, levels: Column) -> Column:
    """The text with base spans and generalised terms replaced by their kind in brackets, removed terms gone.

    Where spans overlap, the first by start (the longer one of equal starts) is replaced and the others are
    covered by it as far as they reach.
    """
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"), s["value"].alias("value"))))

    def mark(s: Column) -> Column:
        return F.when((s["kind"] == "term") & (levels[F.lower(s["value"])] == "remove"), F.lit("")).otherwise(
            F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))

    def piece(pos: Column, s: Column) -> Column:
        """The stretch before a span and its mark; of a covered span, nothing."""
        free = s["start"] >= pos
        return F.struct(F.when(free, pos).alias("from"), F.when(free, s["start"]).alias("to"),
                        F.when(free, mark(s)).alias("mark"))

    pieces = F.filter(running(ordered, F.lit(0), lambda pos, s: F.greatest(pos, -s["back"]), piece, PIECE),
                      lambda p: p["from"].isNotNull())

    def written(part: Column) -> Column:
        """A chunk of pieces, cut from its own stretch of the text: counting starts there, not at the text's start."""
        first = F.get(part, F.lit(0))["from"]
        stretch = F.substring(text, first + 1, F.get(part, F.size(part) - 1)["to"] - first)
        return bound(stretch, lambda held: F.array_join(F.transform(part, lambda p: F.concat(
            F.substring(held, p["from"] - first + 1, p["to"] - p["from"]), p["mark"])), ""))

    end = F.array_max(F.transform(spans, lambda s: s["end"]))
    whole = F.concat(F.array_join(F.transform(chunked(pieces), written), ""), F.substring(text, end + 1, F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(whole)


def sanitise(docs: DataFrame, text_col: str = "text", thresholds: Thresholds = Thresholds(),
             everywhere: bool = False) -> DataFrame:
    """``docs`` with sanitised texts, same columns, whatever their names; null texts stay null."""
    def run(rows: DataFrame) -> DataFrame:
        found = all_spans(rows, text_col, thresholds, everywhere)
        clean = F.when(F.col(text_col).isNotNull(), sanitised(F.col(text_col), F.col("_spans"), F.col("_levels")))
        return found.select(*[clean.alias(c) if c == text_col else F.col(c) for c in rows.columns])

    return shielded(docs, (text_col,), run)
