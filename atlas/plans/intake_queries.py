"""Queries on names, pages, manifests and intake."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atlas.functions import labels as L
from atlas.functions import paths as P
from atlas.operators import intake, tally
from atlas.plans.registry import query, r6, table
from atlas.session import fresh_path, spread_scan
from atlas.sources import tables as S
from atlas.streaming import flows

SOURCE_RULES = [("Alpha", r"src1\b"), ("Beta", r"src[2-5]\b"), ("Gamma", r"src[6-9]\b")]
GRAB_BAG = r"src1[0-4]\b"
PART_RULES = [("Ring", r"\bring\b"), ("Gear", r"\bgear\b"), ("Bolt", r"\bbolt\b"), ("Rod", r"\brod\b"),
              ("Plate", r"plate")]
PART_LABELS = ["Ring", "Gear", "Bolt", "Rod", "Plate", "Flange"]
URL_FOLDER, URL_QUERY, URL_FILE = r"/(en)/", r"page=([a-zA-Z0-9_-]+)", r"/([0-9]+)"
URL_HOSTS = {"spam": "spam-farm", "blog": "blog.", "mobile": "//m."}
ENTRY = r'<a href="/([^"]+)">([^<]+)</a>'


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """documents as a manifest: content hash, seconds, source folder, label from the source."""
    path = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".TXT"))
    duration = F.when(F.col("toxic") == 1, F.lit(None)).otherwise(F.col("n_chars") / 1000.0)
    marked = documents(spark, folder).join(table(spark, folder, "labels"), "doc_id", "left")
    return marked.select(
        "doc_id", path.alias("path"), P.content_hash(F.col("text")).alias("hash"), duration.alias("duration"),
        F.col("source").alias("folder"), F.col("lang").alias("link"),
        L.path_label(F.col("source"), SOURCE_RULES, GRAB_BAG).alias("label"),
    )


MANIFEST_SQL = """manifest AS (
  SELECT d.doc_id, source || '/' || d.doc_id || '.TXT' AS path, md5(text) AS hash,
    CASE WHEN toxic = 1 THEN NULL ELSE n_chars / 1000.0::DOUBLE END AS duration, source AS folder, lang AS link,
    CASE WHEN source = 'src1' THEN 'Alpha' WHEN source IN ('src2','src3','src4','src5') THEN 'Beta'
         WHEN source IN ('src6','src7','src8','src9') THEN 'Gamma'
         WHEN source IN ('src10','src11','src12','src13','src14') THEN '_unsorted' END AS label
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
early AS (SELECT *, CASE WHEN label IS NULL THEN 'unlabeled' WHEN duration IS NULL THEN 'bad'
    WHEN duration > 3 THEN 'long' END AS early FROM manifest),
gated AS (SELECT *, CASE WHEN early IS NOT NULL THEN early
    WHEN row_number() OVER (PARTITION BY early IS NULL, hash ORDER BY path) = 1 THEN 'kept' ELSE 'dupe' END AS reason
  FROM early)"""


@query("content_hash", "SELECT doc_id, md5(text) AS hash, substr(md5(text), 1, 12) AS hash_key FROM documents")
def content_hash(spark, folder):
    digest = P.content_hash(F.col("text"))
    return documents(spark, folder).select("doc_id", digest.alias("hash"), P.hash_key(digest).alias("hash_key"))


@query("fingerprint", """SELECT event_id, 'v6|' || event_type || '.wav|' || user_id || '|' || (epoch_us(ts) // 1000) AS fingerprint
FROM events""")
def fingerprint(spark, folder):
    name = F.concat("event_type", F.lit(".wav"))
    return table(spark, folder, "events").select(
        "event_id", P.fingerprint(name, F.col("user_id"), F.col("ts")).alias("fingerprint"))


@query("path_parts", r"""WITH p AS (SELECT page_id, string_split(url, '/') AS parts FROM pages)
SELECT page_id, parts[-1] AS basename, regexp_replace(parts[-1], '^(.+)\.[^.]+$', '\1') AS stem,
  lower(regexp_extract(parts[-1], '^.+(\.[^.]+)$', 1)) AS suffix, parts[-2] AS parent FROM p""")
def path_parts(spark, folder):
    url = F.col("url")
    return table(spark, folder, "pages").select(
        "page_id", P.basename(url).alias("basename"), P.stem(url).alias("stem"), P.suffix(url).alias("suffix"),
        P.parent_folder(url).alias("parent"))


@query("clean_name", r"""SELECT doc_id, md5(lower(regexp_replace(text, '[\[\(].*?[\]\)]', ' ', 'g'))) AS cleaned,
  length(lower(regexp_replace(text, '[\[\(].*?[\]\)]', ' ', 'g'))) AS n FROM documents""")
def clean_name(spark, folder):
    cleaned = P.clean_name(F.col("text"))
    return documents(spark, folder).select(
        "doc_id", F.md5(cleaned).alias("cleaned"), F.length(cleaned).cast("long").alias("n"))


def _re2(pattern: str) -> str:
    """A keyword pattern with its word boundaries spelled out, since the twin's engine knows ASCII only."""
    start, end = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
    return re.sub(r"(?<=\w)\\b(?!\w)", lambda _: end, re.sub(r"\\b(?=\w)", lambda _: start, pattern))


def _rules_sql(text: str, rules) -> str:
    whens = []
    for label, pattern in rules:
        if "(?!" in pattern:
            # Occurrences the look-ahead forbids are blotted out first.
            whens.append(
                "WHEN regexp_matches(regexp_replace({t}, 'roll\\s*(with|on|the|me|in|up)', 'x', 'g'), '{s}roll') "
                "OR regexp_matches({t}, 'buzz roll') THEN '{l}'".format(t=text, s=r"(?:^|[^\p{L}\p{N}_])", l=label))
        else:
            whens.append(f"WHEN regexp_matches({text}, '{_re2(pattern)}') THEN '{label}'")
    return "CASE " + " ".join(whens) + " END"


@query("keyword_label_documents", f"""WITH c AS (SELECT doc_id,
  lower(regexp_replace(text, '[\\[\\(].*?[\\]\\)]', ' ', 'g')) AS name FROM documents)
SELECT doc_id, {_rules_sql('name', L.KEYWORD_RULES)} AS label FROM c""")
def keyword_label_documents(spark, folder):
    docs = spread_scan(documents(spark, folder), "doc_id")
    return docs.select("doc_id", L.keyword_label(P.clean_name(F.col("text"))).alias("label"))


@query("keyword_label_parts", f"SELECT p_partkey, {_rules_sql('lower(p_name)', PART_RULES)} AS label FROM part")
def keyword_label_parts(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey", L.keyword_label(F.lower("p_name"), PART_RULES).alias("label"))


@query("path_label", r"""SELECT page_id, CASE WHEN regexp_matches(lower(url), '/de/') THEN 'German'
  WHEN regexp_matches(lower(url), '/(fr|es)/') THEN 'Romance'
  WHEN regexp_matches(lower(url), 'blog\.|ref=x') THEN '_unsorted' END AS label FROM pages""")
def path_label(spark, folder):
    rules = [("German", r"/de/"), ("Romance", r"/(fr|es)/")]
    return table(spark, folder, "pages").select(
        "page_id", L.path_label(F.col("url"), rules, r"blog\.|ref=x").alias("label"))


@query("relabelled_parts", """WITH p AS (SELECT p_partkey,
    CASE WHEN p_type = 'PROMO' THEN '_unsorted' ELSE p_type END AS folder_label, CASE
    WHEN regexp_matches(p_name, '(^|[^a-z])ring($|[^a-z])') THEN 'Ring'
    WHEN regexp_matches(p_name, '(^|[^a-z])gear($|[^a-z])') THEN 'Gear'
    WHEN regexp_matches(p_name, '(^|[^a-z])bolt($|[^a-z])') THEN 'Bolt'
    WHEN regexp_matches(p_name, '(^|[^a-z])rod($|[^a-z])') THEN 'Rod'
    WHEN regexp_matches(p_name, 'plate') THEN 'Plate' END AS name_label FROM part)
SELECT p_partkey, folder_label, coalesce(name_label, folder_label) AS label FROM p
WHERE NOT (folder_label = '_unsorted' AND name_label IS NULL)""")
def relabelled_parts(spark, folder):
    rows = table(spark, folder, "part").select(
        "p_partkey", F.when(F.col("p_type") == "PROMO", L.UNSORTED).otherwise(F.col("p_type")).alias("folder_label"),
        L.keyword_label(P.clean_name(F.col("p_name")), PART_RULES).alias("name_label"))
    return rows.where(L.recoverable(F.col("folder_label"), F.col("name_label"))).select(
        "p_partkey", "folder_label", L.overlay_label(F.col("folder_label"), F.col("name_label")).alias("label"))


@query("clean_reference", r"""WITH r AS (
  SELECT conv_id, turn, 0 AS form, '  "' || text || '" ' AS raw FROM conversations UNION ALL
  SELECT conv_id, turn, 1, replace(text, ' ', '\ ') FROM conversations UNION ALL
  SELECT page_id, 0, 2, 'see ' || url || ' please' FROM pages),
t AS (SELECT *, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS s FROM r),
u AS (SELECT *, CASE WHEN (starts_with(s, '"') AND ends_with(s, '"')) OR (starts_with(s, '''') AND ends_with(s, ''''))
  THEN regexp_replace(substr(s, 2, greatest(length(s) - 2, 0)), '^\s+|\s+$', '', 'g') ELSE s END AS inner_s FROM t)
SELECT conv_id, CAST(turn AS BIGINT) AS turn, CAST(form AS BIGINT) AS form,
  CASE WHEN contains(lower(s), 'http://') OR contains(lower(s), 'https://')
    THEN coalesce(nullif(regexp_extract(s, 'https?://\S+'), ''), s) ELSE replace(inner_s, '\ ', ' ') END AS ref FROM u""")
def clean_reference(spark, folder):
    chat, pages = table(spark, folder, "conversations"), table(spark, folder, "pages")
    text = F.col("text")
    raw = chat.select("conv_id", "turn", F.lit(0).cast("long").alias("form"),
                      F.concat(F.lit('  "'), text, F.lit('" ')).alias("raw")).unionByName(
        chat.select("conv_id", "turn", F.lit(1).cast("long").alias("form"),
                    F.replace(text, F.lit(" "), F.lit("\\ ")).alias("raw"))).unionByName(
        pages.select(F.col("page_id").alias("conv_id"), F.lit(0).cast("long").alias("turn"),
                     F.lit(2).cast("long").alias("form"),
                     F.concat(F.lit("see "), "url", F.lit(" please")).alias("raw")))
    return raw.select("conv_id", "turn", "form", P.clean_reference(F.col("raw")).alias("ref"))


@query("cloud_id", r"""WITH m AS (SELECT page_id, url, nullif(regexp_extract(url, '/(en)/', 1), '') AS f,
  nullif(regexp_extract(url, 'page=([a-zA-Z0-9_-]+)', 1), '') AS q,
  nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS d FROM pages)
SELECT page_id, coalesce(f, q, d) AS id,
  CASE WHEN f IS NOT NULL THEN true WHEN q IS NOT NULL THEN contains(lower(url), 'folder') ELSE false END AS is_folder
FROM m""")
def cloud_id(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id", P.cloud_id(F.col("url"), URL_FOLDER, URL_QUERY, URL_FILE).alias("c")).select(
        "page_id", "c.id", "c.is_folder")


@query("ref_kind", """SELECT CASE WHEN contains(lower(url), 'spam-farm') THEN 'spam'
  WHEN contains(lower(url), 'blog.') THEN 'blog' WHEN contains(lower(url), '//m.') THEN 'mobile' ELSE 'local' END AS kind,
  count(*) AS n FROM pages GROUP BY 1""")
def ref_kind(spark, folder):
    return table(spark, folder, "pages").groupBy(
        P.ref_kind(F.col("url"), URL_HOSTS).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("extract_link", r"""WITH m AS (SELECT page_id, html,
  regexp_extract(html, '(?i)<a\b[^>]*\bhref\s*=\s*["'']([^"'']*tion[^"'']*)["'']', 1) AS by_href,
  regexp_extract(html, 'href="(https?://tion[^"]+)"', 1) AS quoted,
  regexp_extract(html, 'https?://tion[^''"]+') AS bare FROM pages)
SELECT page_id, coalesce(nullif(by_href, ''), nullif(quoted, ''), nullif(bare, '')) AS link FROM m""")
def extract_link(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id", P.extract_link(F.col("html"), needle="tion").alias("link"))


@query("extract_entries", r"""WITH m AS (SELECT page_id, html,
  regexp_extract_all(html, '<a href="/([^"]+)">([^<]+)</a>', 1) AS ids,
  regexp_extract_all(html, '<a href="/([^"]+)">([^<]+)</a>', 2) AS names FROM pages),
e AS (SELECT page_id, unnest(ids) AS id, unnest(names) AS name, generate_subscripts(ids, 1) AS spot FROM m)
SELECT page_id, id, name FROM (SELECT *, row_number() OVER (PARTITION BY page_id, id ORDER BY spot) AS rn FROM e)
WHERE rn = 1 AND id <> 'the'""")
def extract_entries(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id", F.inline(P.extract_entries(F.col("html"), ENTRY, F.lit("the"))))


@query("file_name", r"""WITH m AS (SELECT page_id, url, 'attachment; filename="doc+' || page_id || '%20a.zip"' AS header
  FROM pages),
n AS (SELECT page_id, regexp_extract(header, 'filename="?([^";]+)"?', 1) AS h,
  string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/')[-1] AS b FROM m)
SELECT page_id, url_decode(h) AS from_header,
  url_decode(coalesce(nullif(b, ''), 'downloaded_file.zip')) AS from_url FROM n""")
def file_name(spark, folder):
    header = F.concat(F.lit('attachment; filename="doc+'), F.col("page_id").cast("string"), F.lit('%20a.zip"'))
    return table(spark, folder, "pages").select(
        "page_id", P.file_name(header, F.col("url")).alias("from_header"),
        P.file_name(F.lit(None).cast("string"), F.col("url")).alias("from_url"))


@query("union_roots", """SELECT doc_id, source || '/' || doc_id AS path FROM documents""")
def union_roots(spark, folder):
    docs = documents(spark, folder).select("doc_id", F.concat_ws("/", "source", "doc_id").alias("path"))
    nested = docs.where(F.col("path").startswith("src1"))
    return intake.union_roots(docs, nested, docs)


@query("gate", f"WITH {MANIFEST_SQL} SELECT doc_id, path, label, reason FROM gated")
def gate(spark, folder):
    return intake.gate(manifest(spark, folder)).select("doc_id", "path", "label", "reason")


@query("one_shot", "SELECT event_id, value / 60 AS duration FROM events WHERE value / 60 > 0 AND value / 60 <= 3")
def one_shot(spark, folder):
    return intake.one_shot(table(spark, folder, "events").select(
        "event_id", (F.col("value") / 60).alias("duration")))


@query("route", f"""WITH {MANIFEST_SQL} SELECT doc_id,
  CASE WHEN label = '_unsorted' THEN 'unsorted' ELSE 'labeled' END AS split, substr(hash, 1, 12) || '.txt' AS target
FROM gated WHERE reason = 'kept'""")
def route(spark, folder):
    kept = intake.gate(manifest(spark, folder)).where(F.col("reason") == "kept")
    return intake.route(kept).select("doc_id", "split", "target")


@query("dedup_content", """WITH d AS (SELECT doc_id, md5(text) AS hash, lang FROM documents),
seen AS (SELECT DISTINCT hash FROM d WHERE lang = 'de')
SELECT min(doc_id) AS doc_id, hash FROM d WHERE hash NOT IN (SELECT hash FROM seen) GROUP BY hash""")
def dedup_content(spark, folder):
    docs = documents(spark, folder).select("doc_id", P.content_hash(F.col("text")).alias("hash"), "lang")
    seen = docs.where(F.col("lang") == "de").select("hash")
    return intake.dedup_content(docs, seen, path="doc_id").select("doc_id", "hash")


@query("run_summary", f"""WITH {MANIFEST_SQL} SELECT link,
  count(*) FILTER (reason = 'kept' AND label <> '_unsorted') AS added,
  count(*) FILTER (reason = 'kept' AND label = '_unsorted') AS added_unsorted,
  count(*) FILTER (reason = 'unlabeled') AS skipped_unlabeled, count(*) FILTER (reason = 'bad') AS skipped_bad,
  count(*) FILTER (reason = 'long') AS skipped_long, count(*) FILTER (reason = 'dupe') AS skipped_dupe
FROM gated GROUP BY link""")
def run_summary(spark, folder):
    return intake.run_summary(intake.gate(manifest(spark, folder)))


@query("kept_per_label", f"""WITH {MANIFEST_SQL} SELECT link, label, count(*) AS n FROM gated
WHERE reason = 'kept' GROUP BY ALL""")
def kept_per_label(spark, folder):
    return intake.kept_per_label(intake.gate(manifest(spark, folder)))


@query("folder_labels", f"""WITH {MANIFEST_SQL} SELECT folder, arg_min(label, doc_id) AS label FROM gated
WHERE reason = 'kept' GROUP BY folder""")
def folder_labels(spark, folder):
    kept = intake.gate(manifest(spark, folder)).where(F.col("reason") == "kept")
    return intake.folder_labels(kept, seq="doc_id")


@query("attach_files", """WITH f AS (SELECT substr(md5(text), 1, 12) AS key, min(lang || '/' || substr(md5(text), 1, 12)
    || '.' || source) AS path FROM documents GROUP BY 1)
SELECT l.doc_id, path FROM labels l JOIN documents d ON l.doc_id = d.doc_id JOIN f ON f.key = substr(md5(d.text), 1, 12)""")
def attach_files(spark, folder):
    docs = documents(spark, folder)
    digest = P.content_hash(F.col("text"))
    files = docs.select(F.concat("lang", F.lit("/"), P.hash_key(digest), F.lit("."), "source").alias("path"))
    listed = table(spark, folder, "labels").join(docs, "doc_id").select("doc_id", digest.alias("hash"))
    return intake.attach_files(listed, files).select("doc_id", "path")


@query("flag_processed", """WITH ledger AS (SELECT DISTINCT url FROM pages WHERE contains(url, 'page='))
SELECT page_id, p.url AS link, l.url IS NOT NULL AS already_processed FROM pages p LEFT JOIN ledger l ON p.url = l.url""")
def flag_processed(spark, folder):
    links = table(spark, folder, "pages").select("page_id", F.col("url").alias("link"))
    return intake.flag_processed(links, links.where(F.col("link").contains("page=")))


@query("pending_review", """SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def pending_review(spark, folder):
    return intake.pending(documents(spark, folder).select("doc_id"), table(spark, folder, "labels"), "doc_id")


@query("review_progress", """SELECT count(*) AS queued, (SELECT count(DISTINCT doc_id) FROM labels) AS done,
  count(*) - (SELECT count(DISTINCT doc_id) FROM labels) AS remaining FROM documents""")
def review_progress(spark, folder):
    return intake.review_progress(documents(spark, folder).select("doc_id"), table(spark, folder, "labels"), "doc_id")


@query("manifest_roundtrip", f"""WITH {MANIFEST_SQL} SELECT hash, label, round(duration, 3) AS duration, path AS orig_name,
  folder AS source_folder, link AS source_link FROM gated WHERE reason = 'kept'""")
def manifest_roundtrip(spark, folder):
    kept = intake.gate(manifest(spark, folder)).where(F.col("reason") == "kept").select(
        "hash", "label", "duration", F.col("path").alias("orig_name"), F.col("folder").alias("source_folder"),
        F.col("link").alias("source_link"))
    out = fresh_path(spark, "manifest")
    S.append_manifest(kept, out, "csv")
    return S.read_manifest(spark, out, "csv")


@query("original_names", """SELECT substr(md5(text), 1, 12) AS hash12, arg_max(source, doc_id) AS orig_name
FROM documents GROUP BY 1""")
def original_names(spark, folder):
    rows = documents(spark, folder).select(
        P.content_hash(F.col("text")).alias("hash"), F.col("source").alias("orig_name"), F.col("doc_id").alias("seq"))
    return S.original_names(rows)


def _part_labels(spark, folder) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, folder, "part").select(
        F.when(F.col("p_type") == "PROMO", F.lit(L.UNSORTED)).otherwise(
            F.coalesce(L.keyword_label(F.lower("p_name"), PART_RULES), F.lit("Other"))).alias("label"))
    dim = spark.createDataFrame([(n, i) for i, n in enumerate(PART_LABELS)], "label string, position long")
    return rows, dim


PART_LABEL_SQL = f"""rows AS (SELECT CASE WHEN p_type = 'PROMO' THEN '_unsorted'
  ELSE coalesce({_rules_sql('lower(p_name)', PART_RULES)}, 'Other') END AS label FROM part),
dim AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {i})" for i, n in enumerate(PART_LABELS))}) t(label, position)),
counts AS (SELECT d.label, position, count(r.label) AS n FROM dim d LEFT JOIN rows r ON d.label = r.label GROUP BY ALL)"""


@query("tally", f"""WITH {PART_LABEL_SQL} SELECT label, CAST(position AS BIGINT) AS position, n,
  round(least(n / 150.0, 1), 6)::DOUBLE AS progress, n >= 150 AS done FROM counts""")
def tally_parts(spark, folder):
    rows, dim = _part_labels(spark, folder)
    return tally.tally(rows, dim).withColumn("progress", r6("progress"))


@query("tally_totals", f"""WITH {PART_LABEL_SQL} SELECT CAST(sum(n) AS BIGINT) AS labelled,
  (SELECT count(*) FROM rows WHERE label = '_unsorted') AS held_out, count(*) FILTER (n >= 150) AS at_target FROM counts""")
def tally_totals(spark, folder):
    rows, dim = _part_labels(spark, folder)
    return tally.tally_totals(rows, dim)


@query("section_counts", "SELECT 'L' || label AS section, count(*) AS n FROM embeddings GROUP BY 1")
def section_counts(spark, folder):
    return tally.section_counts(table(spark, folder, "embeddings").select(
        F.concat(F.lit("L"), "label").alias("section")))


@query("class_weights", """WITH c AS (SELECT event_type AS label, count(*) AS n FROM events GROUP BY 1)
SELECT label, n, round((SELECT sum(n) FROM c)::DOUBLE / ((SELECT count(*) FROM c) * n), 6) AS weight,
  round((SELECT max(n) FROM c) / (SELECT min(n) FROM c)::DOUBLE, 6) AS imbalance FROM c""")
def class_weights(spark, folder):
    rows = table(spark, folder, "events").select(F.col("event_type").alias("label"))
    return tally.class_weights(rows).withColumns({"weight": r6("weight"), "imbalance": r6("imbalance")})


@query("search_weight", """SELECT p_partkey, CASE WHEN contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring')
  THEN 1.0::DOUBLE ELSE 0.12::DOUBLE END AS weight FROM part""")
def search_weight(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey", L.search_weight("RING", F.col("p_name"), F.col("p_type")).alias("weight"))


COLOUR_NAMES = {"STANDARD": "Kick", "ECONOMY": "Snare", "MEDIUM": "Closed Hat", "LARGE": "Vocal", "SMALL": "Ride"}


def _drum(p_type: Column) -> Column:
    pairs = [F.lit(v) for kv in COLOUR_NAMES.items() for v in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), p_type), p_type)


@query("label_colour", """WITH c(p_type, label, hex) AS (VALUES ('STANDARD','Kick','ff5e62'), ('ECONOMY','Snare','3ad2e2'),
  ('MEDIUM','Closed Hat','fd9644'), ('LARGE','Vocal','79cca3'), ('SMALL','Ride','c982ed'), ('PROMO','PROMO','888888'))
SELECT p_partkey, label, round(('0x' || substr(hex, 1, 2))::BIGINT / 255.0::DOUBLE, 6) AS r,
  round(('0x' || substr(hex, 3, 2))::BIGINT / 255.0::DOUBLE, 6) AS g,
  round(('0x' || substr(hex, 5, 2))::BIGINT / 255.0::DOUBLE, 6) AS b FROM part JOIN c ON part.p_type = c.p_type""")
def label_colour(spark, folder):
    label = _drum(F.col("p_type"))
    return table(spark, folder, "part").select(
        "p_partkey", label.alias("label"), L.label_colour(label).alias("c")).select(
        "p_partkey", "label", r6("c.r").alias("r"), r6("c.g").alias("g"), r6("c.b").alias("b"))


@query("label_id", """SELECT p_partkey, ('0x' || substr(md5(p_type), 1, 8))::BIGINT AS label_id FROM part""")
def label_id(spark, folder):
    return table(spark, folder, "part").select("p_partkey", L.label_id(F.col("p_type")).alias("label_id"))


@query("section_slot", """WITH s AS (SELECT p_partkey, CASE p_type WHEN 'STANDARD' THEN 0.0 WHEN 'ECONOMY' THEN 3.0
  WHEN 'MEDIUM' THEN 7.0 WHEN 'LARGE' THEN 17.0 ELSE 18.0 END::DOUBLE AS i FROM part)
SELECT p_partkey, round(30 * sqrt(i + 0.5) * cos(i * 2.399963), 6) AS x,
  round(30 * sqrt(i + 0.5) * sin(i * 2.399963), 6) AS y FROM s""")
def section_slot(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey", L.section_slot(_drum(F.col("p_type"))).alias("s")).select(
        "p_partkey", r6("s.x").alias("x"), r6("s.y").alias("y"))


@query("sunflower", """WITH t AS (SELECT count(*) AS n FROM part), p AS (SELECT p_partkey, p_partkey AS i, n,
  0.62 * sqrt(n) * 4.2 AS radius FROM part, t)
SELECT p_partkey, round(radius * sqrt((i + 0.5) / n) * cos(i * 2.399963), 6) AS x,
  round(radius * sqrt((i + 0.5) / n) * sin(i * 2.399963), 6) AS y FROM p""")
def sunflower(spark, folder):
    rows = table(spark, folder, "part").select("p_partkey")
    n = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    spot = L.sunflower(F.col("p_partkey"), F.col("n"), L.blob_disc_radius(F.col("n")))
    return rows.withColumn("n", n).select("p_partkey", spot.alias("s")).select(
        "p_partkey", r6("s.x").alias("x"), r6("s.y").alias("y"))


@query("cache_reuse", """SELECT vec_id AS id, 'hit' AS origin, CAST(length(embedding) AS BIGINT) AS dims FROM embeddings
  WHERE label < 5 UNION ALL SELECT vec_id, 'fresh', CAST(length(embedding) AS BIGINT) FROM embeddings
  WHERE label >= 5 AND label <> 9""")
def cache_reuse(spark, folder):
    vectors = table(spark, folder, "embeddings")
    key = F.concat(F.lit("v6|"), F.col("vec_id").cast("string")).alias("fingerprint")
    cache = vectors.where("label < 5").select(key, "embedding", F.lit("hit").alias("origin"))

    def compute(missing):
        # Label 9 stands for files that cannot be decoded.
        return missing.where("label <> 9").join(vectors, "vec_id").select(
            key, "embedding", F.lit("fresh").alias("origin"))

    wanted = vectors.select(F.col("vec_id"), key, "label")
    rows, _ = intake.incremental(wanted, cache, compute)
    return rows.select(F.col("vec_id").alias("id"), "origin", F.size("embedding").cast("long").alias("dims"))


@query("apply_corrections", """WITH c AS (SELECT user_id, arg_max(event_type, event_id) AS section FROM events GROUP BY 1)
SELECT vec_id AS id, coalesce(c.section, 'L' || label) AS section FROM embeddings LEFT JOIN c ON vec_id = user_id""")
def apply_corrections(spark, folder):
    items = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("path"), F.concat(F.lit("L"), "label").alias("section"))
    moves = table(spark, folder, "events").groupBy(F.col("user_id").alias("path")).agg(
        F.max_by("event_type", "event_id").alias("section"))
    return intake.apply_corrections(items, moves).withColumnRenamed("path", "id")


@query("attach_embeddings", """SELECT p_partkey AS path, CAST(length(embedding) AS BIGINT) AS dims
FROM part LEFT JOIN embeddings ON p_partkey = vec_id""")
def attach_embeddings(spark, folder):
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("path"), "embedding")
    rows = intake.attach_embeddings(table(spark, folder, "part").select(F.col("p_partkey").alias("path")), vectors)
    return rows.select("path", F.when(F.col("embedding").isNotNull(), F.size("embedding")).cast("long").alias("dims"))


@query("cache_versions", """SELECT CAST(sum((doc_id % 7 = 6)::INT) AS BIGINT) AS kept,
  CAST(sum((doc_id % 7 <> 6)::INT) AS BIGINT) AS removed FROM documents""")
def cache_versions(spark, folder):
    entries = documents(spark, folder).select(
        F.concat(F.lit("v"), (F.col("doc_id") % 7).cast("string"), F.lit("|"), "source").alias("fingerprint"))
    return flows.invalidate(entries, 6)
