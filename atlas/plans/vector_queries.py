"""Queries on embeddings: neighbours, triage, centroids, groups, evaluation, heads."""

from __future__ import annotations

import math

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atlas.functions import vectors as V
from atlas.operators import centroids as C
from atlas.operators import evaluate as E
from atlas.operators import groups as R
from atlas.operators import head as H
from atlas.operators import neighbours as N
from atlas.operators import triage as T
from atlas.plans import corpus
from atlas.plans.registry import TWINS, query, r6, table
from atlas.session import cut_lineage, fresh_path, spread_scan
from atlas.sources import tables as S

K = 15
STRENGTH = 0.30  # the test vectors carry little class signal
PAIR_LIMIT = 0.45
BLOCK = 128  # rows of a block in the queries that exercise many blocks
CUTS = [0.1, 0.25, 0.5, 0.75, 0.9]
OWN_GRID, STRENGTH_GRID = [0.2, 0.45, 0.6], [0.2, 0.3, 0.4]
WIDE = [32, 16]  # hidden sizes of the generated head
CLASSES = 10


def items(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), F.concat(F.lit("L"), "label").alias("label"),
        (F.col("vec_id") % 20).alias("group_id"), F.floor(F.col("vec_id") / 4).alias("folder"), "embedding")


ITEMS_SQL = """items AS (SELECT vec_id AS id, 'L' || label AS label, vec_id % 20 AS group_id, vec_id // 4 AS folder,
  embedding::DOUBLE[] AS v FROM embeddings),
unit AS (SELECT id, label, group_id, folder, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM items)"""
KNN_SQL = f"""{ITEMS_SQL},
knn AS (SELECT * FROM (SELECT a.id AS src, b.id AS dst, a.label AS src_label, b.label AS dst_label,
    round(list_dot_product(a.u, b.u), 9) AS score,
    row_number() OVER (PARTITION BY a.id ORDER BY round(list_dot_product(a.u, b.u), 9) DESC, b.id) AS rank
  FROM unit a JOIN unit b ON a.group_id <> b.group_id) WHERE rank <= 15)"""
SCORED_SQL = f"""{KNN_SQL},
votes AS (SELECT src, dst_label, count(*) AS n FROM knn GROUP BY ALL),
ballot AS (SELECT src, dst_label, n, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst_label) AS place FROM votes),
scored AS (SELECT i.id, i.label, (SELECT dst_label FROM ballot b WHERE b.src = i.id AND place = 1) AS consensus,
  (SELECT n FROM ballot b WHERE b.src = i.id AND place = 1) / 15.0::DOUBLE AS strength,
  o.own FROM items i JOIN (SELECT src, avg((dst_label = src_label)::INT) AS own FROM knn GROUP BY src) o ON o.src = i.id)"""
TRIAGE_SQL = f"""{SCORED_SQL},
decided AS (SELECT *, CASE WHEN consensus = label THEN 'keep' WHEN own < 0.45 AND strength >= 0.30 THEN 'fix'
  WHEN own < 0.45 THEN 'review' ELSE 'keep' END AS decision FROM scored)"""
CENTROID_SQL = f"""{ITEMS_SQL},
scaled AS (SELECT id, label, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-9)) AS u FROM items),
flat AS (SELECT label, unnest(u) AS x, generate_subscripts(u, 1) AS dim FROM scaled),
mean AS (SELECT label, dim, avg(x) AS m FROM flat GROUP BY ALL),
cent AS (SELECT label, list(m / (len_ + 1e-9) ORDER BY dim) AS c FROM (
  SELECT label, dim, m, sqrt(sum(m * m) OVER (PARTITION BY label)) AS len_ FROM mean) GROUP BY label)"""


def scored(spark, folder) -> DataFrame:
    rows = items(spark, folder)
    near = T.label_neighbours(rows, K)
    return T.consensus(rows.drop("embedding"), near, K)


@query("l2_normalize", f"""WITH {ITEMS_SQL} SELECT id, CAST(generate_subscripts(u, 1) - 1 AS BIGINT) AS dim,
  round(unnest(u), 6) AS value FROM unit""")
def l2_normalize(spark, folder):
    return items(spark, folder).select("id", F.posexplode(V.l2_normalize(F.col("embedding"))).alias("dim", "x")).select(
        "id", F.col("dim").cast("long").alias("dim"), r6("x").alias("value"))


@query("vector_similarity", f"""WITH {ITEMS_SQL} SELECT a.id, round(list_dot_product(a.v, b.v), 6) AS dot,
  round(list_cosine_similarity(a.v, b.v), 6) AS cosine, round(power(list_distance(a.v, b.v), 2), 6) AS sqdist
FROM items a JOIN items b ON b.id = a.id + 1""")
def vector_similarity(spark, folder):
    a = items(spark, folder).select("id", "embedding")
    b = a.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("other"))
    x, y = F.col("embedding"), F.col("other")
    return a.join(b, "id").select("id", r6(V.dot(x, y)).alias("dot"), r6(V.cosine(x, y)).alias("cosine"),
                                  r6(V.sqdist(x, y)).alias("sqdist"))


@query("embedding_set", """SELECT vec_id AS id, 'L' || label AS label, CAST(length(embedding) AS BIGINT) AS dims,
  round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings""")
def embedding_set(spark, folder):
    out = fresh_path(spark, "embeddings")
    S.write_embeddings(items(spark, folder).select("id", "label", "embedding"), out)
    total = F.aggregate(V.as_double(F.col("embedding")), F.lit(0.0), lambda acc, x: acc + x)
    return S.read_embeddings(spark, out).select(
        "id", "label", F.size("embedding").cast("long").alias("dims"), r6(total).alias("total"))


@query("class_centroids", f"""WITH {CENTROID_SQL} SELECT label, CAST(generate_subscripts(c, 1) - 1 AS BIGINT) AS dim,
  round(unnest(c), 6) AS value FROM cent""")
def class_centroids(spark, folder):
    cents = C.centroids(items(spark, folder))
    return cents.select("label", F.posexplode("centroid").alias("dim", "x")).select(
        "label", F.col("dim").cast("long").alias("dim"), r6("x").alias("value"))


NEAREST_SQL = f"""{CENTROID_SQL},
near AS (SELECT u.id, u.label, arg_min(c.label, (-round(list_dot_product(u.u, c.c), 9), c.label)) AS nearest
  FROM scaled u, cent c GROUP BY ALL)"""


@query("nearest_centroid", f"WITH {NEAREST_SQL} SELECT id, label, nearest FROM near")
def nearest_centroid(spark, folder, block_rows=None):
    rows = items(spark, folder)
    return C.nearest_centroid(rows, C.centroids(rows), block_rows=block_rows).select("id", "label", "nearest")


@query("centroid_metrics", f"""WITH {NEAREST_SQL}, per AS (SELECT label, count(*) AS n,
  avg((label = nearest)::INT) AS recall FROM near GROUP BY label)
SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(n * recall) / sum(n), 6) AS accuracy,
  round(avg(recall), 6) AS balanced FROM per""")
def centroid_metrics(spark, folder):
    rows = items(spark, folder)
    judged = C.nearest_centroid(rows, C.centroids(rows)).withColumnRenamed("nearest", "pred")
    return E.overall(judged).select("n", r6("accuracy").alias("accuracy"), r6("balanced").alias("balanced"))


@query("knn_cross_group", f"WITH {KNN_SQL} SELECT src, dst, rank, round(score, 6) AS score FROM knn")
def knn_cross_group(spark, folder, block_rows=None):
    near = N.top_k(items(spark, folder), k=K, exclude="group_id", block_rows=block_rows)
    return near.select("src", "dst", F.col("rank").cast("long").alias("rank"), r6("score").alias("score"))


@query("knn_section_graph", """WITH raw AS (SELECT vec_id AS id, label, generate_subscripts(embedding, 1) AS dim,
  unnest(embedding::DOUBLE[]) AS x FROM embeddings),
stat AS (SELECT label, dim, avg(x) AS m, stddev_pop(x) AS s FROM raw GROUP BY ALL),
z AS (SELECT id, r.label, list((x - m) / (CASE WHEN s < 1e-6 THEN 1 ELSE s END) ORDER BY r.dim) AS z
  FROM raw r JOIN stat t ON r.label = t.label AND r.dim = t.dim GROUP BY ALL),
pair AS (SELECT a.id AS src, b.id AS dst,
  round(list_dot_product(a.z, a.z) + list_dot_product(b.z, b.z) - 2 * list_dot_product(a.z, b.z), 9) AS d
  FROM z a JOIN z b ON a.label = b.label AND a.id <> b.id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS rank FROM pair)
SELECT src, dst, rank, round(d, 6) AS distance FROM ranked WHERE rank <= 15""")
def knn_section_graph(spark, folder, block_rows=None):
    rows = items(spark, folder)
    scaled = C.scaler_apply(rows, C.scaler_fit(rows, by=["label"]), by=["label"])
    graph = N.top_k(scaled, k=K, metric="sqeuclid", by=["label"], block_rows=block_rows)
    return graph.select("src", "dst", F.col("rank").cast("long").alias("rank"), r6("score").alias("distance"))


@query("near_dup_pairs", f"""WITH {ITEMS_SQL} SELECT a.id AS src, b.id AS dst,
  round(list_dot_product(a.u, b.u), 6) AS score FROM unit a JOIN unit b ON a.id < b.id
WHERE round(list_dot_product(a.u, b.u), 9) >= {PAIR_LIMIT}""")
def near_dup_pairs(spark, folder, block_rows=None):
    return N.near_dup_pairs(items(spark, folder), PAIR_LIMIT, block_rows=block_rows).withColumn("score", r6("score"))


@query("consensus", f"""WITH {SCORED_SQL} SELECT s.id, label, round(own, 6) AS own, consensus, round(strength, 6) AS strength,
  (SELECT string_agg(dst_label || '=' || n, ',' ORDER BY place) FROM ballot b WHERE b.src = s.id AND place <= 4) AS top4
FROM scored s""")
def consensus(spark, folder):
    top = F.transform(F.slice("votes", 1, T.HISTOGRAM),
                      lambda v: F.concat(v["label"], F.lit("="), v["n"].cast("string")))
    return scored(spark, folder).select("id", "label", r6("own").alias("own"), "consensus",
                                        r6("strength").alias("strength"), F.array_join(top, ",").alias("top4"))


@query("label_triage", f"""WITH {TRIAGE_SQL} SELECT id, label, consensus, round(own, 6) AS own,
  round(strength, 6) AS strength, decision FROM decided""")
def label_triage(spark, folder, block_rows=None):
    rows = corpus.label_triage(items(spark, folder), K, strength=STRENGTH, block_rows=block_rows)
    return rows.select("id", "label", "consensus", r6("own").alias("own"), r6("strength").alias("strength"), "decision")


@query("auto_fixes", f"""WITH {TRIAGE_SQL} SELECT id, label AS old, consensus AS new, round(own, 2) AS own
FROM decided WHERE decision = 'fix'""")
def auto_fixes(spark, folder):
    return T.auto_fixes(T.triage(scored(spark, folder), strength=STRENGTH))


@query("review_queue", f"""WITH {TRIAGE_SQL} SELECT id, label AS current, round(own, 2) AS own
FROM decided WHERE decision = 'review'""")
def review_queue(spark, folder):
    queue = T.review_queue(T.triage(scored(spark, folder), strength=STRENGTH))
    return queue.select("id", F.col("label").alias("current"), F.round("own", 2).alias("own"))


@query("exemplars", f"""WITH {SCORED_SQL} SELECT label, id, round(own, 6) AS own FROM (SELECT *,
  row_number() OVER (PARTITION BY label ORDER BY own DESC, id) AS rn FROM scored) WHERE rn = 1""")
def exemplars(spark, folder):
    return T.exemplars(scored(spark, folder)).withColumn("own", r6("own"))


@query("knn_purity", f"WITH {SCORED_SQL} SELECT label, round(avg(own), 6) AS purity, count(own) AS n FROM scored GROUP BY 1")
def knn_purity(spark, folder):
    return T.purity(scored(spark, folder)).withColumn("purity", r6("purity"))


@query("suggestions", f"""WITH {SCORED_SQL} SELECT src AS id, string_agg(dst_label, ',' ORDER BY place) AS suggested
FROM ballot WHERE place <= 3 GROUP BY src""")
def suggestions(spark, folder):
    return scored(spark, folder).select("id", F.array_join(T.suggestions(), ",").alias("suggested"))


@query("triage_sweep", f"""WITH {SCORED_SQL}, o(own_limit) AS (VALUES (0.2::DOUBLE), (0.45), (0.6)),
st(min_strength) AS (VALUES (0.2::DOUBLE), (0.3), (0.4))
SELECT own_limit, min_strength, CAST(coalesce(sum((consensus <> label AND own < own_limit
  AND strength >= min_strength)::INT), 0) AS BIGINT) AS fixed FROM scored, o, st GROUP BY ALL""")
def triage_sweep(spark, folder):
    return T.triage_sweep(scored(spark, folder), OWN_GRID, STRENGTH_GRID)


@query("triage_artifacts")
def triage_artifacts(spark, folder):
    """The four written artefacts, counted after reading them back."""
    done = T.triage(scored(spark, folder), strength=STRENGTH).withColumn(
        "hash", F.substring(F.md5(F.col("id").cast("string")), 1, 12)).withColumn(
        "path", F.concat(F.lit("/media/"), "hash", F.lit(".wav")))
    review = T.review_queue(done).select("hash", "path", F.col("label").alias("current"),
                                         T.histogram().alias("neighbors"), F.round("own", 2).alias("own"))
    best = done.join(T.exemplars(done).select("id"), "id", "left_semi").select("label", "hash", "path")
    out = fresh_path(spark, "triage")
    S.write_triage(T.auto_fixes(done, "hash"), review, best, out)
    parts = [spark.read.json(f"{out}/{n}").agg(F.count(F.lit(1)).alias("n")).withColumn("artefact", F.lit(n))
             for n in ("auto_corrections", "review_queue", "examples", "audio_map")]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


AUG_SQL = f"""{CENTROID_SQL},
aug AS (SELECT id AS source_id, k, label, group_id, u AS src,
  list_transform(range(64), lambda d: u[d + 1] + 0.05 * sin(id + d + k)) AS a FROM (
  SELECT i.id, i.label, i.group_id, i.v AS u, k FROM items i, range(4) t(k))),
judged AS (SELECT source_id, k, aug.label, group_id, round(list_cosine_similarity(a, src), 9) AS cos_source,
  arg_min(c.label, (-round(list_dot_product(a, c.c) / (sqrt(list_dot_product(a, a)) + 1e-9), 9), c.label)) AS nearest
  FROM aug, cent c GROUP BY ALL),
verdict AS (SELECT *, cos_source >= 0.7 AND nearest = label AS passed FROM judged)"""


def augmented(rows: DataFrame) -> DataFrame:
    """Four shifted copies of every vector, standing in for re-embedded effects."""
    copies = rows.select(F.col("id").alias("source_id"), "embedding",
                         F.explode(F.sequence(F.lit(0), F.lit(C.VARIANTS - 1))).alias("k"))
    shifted = F.transform(V.as_double(F.col("embedding")),
                          lambda x, d: x + 0.05 * F.sin((F.col("source_id") + d + F.col("k")).cast("double")))
    return copies.select("source_id", F.col("k").cast("long").alias("k"), shifted.alias("embedding"))


@query("augment_gate", f"""WITH {AUG_SQL} SELECT source_id, k, label, group_id, round(cos_source, 6) AS cos_source, nearest,
  passed, true AS is_aug FROM verdict""")
def augment_gate(spark, folder, block_rows=None):
    rows = items(spark, folder)
    gated = C.augment_gate(augmented(rows), rows, C.centroids(rows), block_rows=block_rows)
    return gated.select("source_id", "k", "label", "group_id", r6("cos_source").alias("cos_source"), "nearest",
                        "passed", "is_aug")


@query("augment_report", f"""WITH {AUG_SQL} SELECT label, count(*) AS tried, count(*) FILTER (passed) AS kept,
  round(avg(passed::INT), 6) AS pass_rate FROM verdict WHERE label IN ('L1', 'L3', 'L7') GROUP BY label""")
def augment_report(spark, folder):
    rows = items(spark, folder)
    thin = C.thin_sources(rows, ["L1", "L3", "L7"])
    report = C.gate_report(C.augment_gate(augmented(thin), rows, C.centroids(rows)))
    return report.withColumn("pass_rate", r6("pass_rate"))


@query("vector_parity", """WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS a,
  list_transform(embedding::DOUBLE[], lambda x, i: x + 0.011 * sin(vec_id + i - 1)) AS b FROM embeddings),
g AS (SELECT *, list_transform(range(64), lambda i: abs(a[i + 1] - b[i + 1])) AS gap FROM e)
SELECT id, round(list_max(gap), 6) AS max_diff, CAST(list_position(gap, list_max(gap)) - 1 AS BIGINT) AS max_at,
  round(list_avg(gap), 6) AS mean_diff, round(list_cosine_similarity(a, b), 6) AS cosine,
  list_cosine_similarity(a, b) > 0.996 AND list_max(gap) < 0.011 AS passed FROM g""")
def vector_parity(spark, folder):
    a = items(spark, folder).select("id", "embedding")
    b = a.select("id", F.transform(V.as_double(F.col("embedding")),
                                   lambda x, i: x + 0.011 * F.sin((F.col("id") + i).cast("double"))).alias("embedding"))
    return C.parity(a, b, 0.011, 0.996).select(
        "id", r6("max_diff").alias("max_diff"), F.col("max_at").cast("long").alias("max_at"),
        r6("mean_diff").alias("mean_diff"), r6("cosine").alias("cosine"), "passed")


SCALER_SQL = """raw AS (SELECT vec_id AS id, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding::DOUBLE[]) AS x
  FROM embeddings),
stat AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS s FROM raw GROUP BY dim)"""


@query("scaler_fit", f"WITH {SCALER_SQL} SELECT CAST(dim AS BIGINT) AS dim, round(m, 6) AS mean, round(s, 6) AS scale FROM stat")
def scaler_fit(spark, folder):
    fitted = C.scaler_fit(items(spark, folder))
    return fitted.select(F.posexplode(F.arrays_zip("mean", "scale")).alias("dim", "z")).select(
        F.col("dim").cast("long").alias("dim"), r6("z.mean").alias("mean"), r6("z.scale").alias("scale"))


@query("scaler_apply", f"""WITH {SCALER_SQL} SELECT id, round(sum(abs((x - m) / s)), 6) AS spread
FROM raw JOIN stat ON raw.dim = stat.dim GROUP BY id""")
def scaler_apply(spark, folder):
    rows = items(spark, folder)
    scaled = C.scaler_apply(rows, C.scaler_fit(rows))
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + F.abs(x))
    return scaled.select("id", r6(total).alias("spread"))


# ---- groups and folds -----------------------------------------------------------------------------

GROUP_SQL = f"""RECURSIVE {ITEMS_SQL},
edge AS (SELECT a.folder AS f, b.folder AS g FROM unit a JOIN unit b ON a.id <> b.id AND a.folder <> b.folder
  AND round(list_dot_product(a.u, b.u), 9) >= {PAIR_LIMIT}),
reach(f, g) AS (SELECT DISTINCT folder, folder FROM items UNION SELECT r.f, e.g FROM reach r JOIN edge e ON e.f = r.g),
root AS (SELECT r.f, min(i.lead) AS group_id FROM reach r JOIN (SELECT folder, min(id) AS lead FROM items GROUP BY 1) i
  ON i.folder = r.g GROUP BY r.f),
grouped AS (SELECT id, group_id, label FROM (SELECT id, label, folder FROM items) i JOIN root ON f = folder),
sizes AS (SELECT group_id, count(*) AS n FROM grouped GROUP BY 1),
ranked AS (SELECT group_id, row_number() OVER (ORDER BY n DESC, md5(group_id::VARCHAR), group_id) - 1 AS z FROM sizes),
folds AS (SELECT group_id, CASE WHEN (z // 5) % 2 = 0 THEN z % 5 ELSE 4 - z % 5 END AS fold FROM ranked)"""


def grouped(spark, folder, block_rows=None) -> DataFrame:
    rows = items(spark, folder)
    return R.leakage_groups(rows, N.near_dup_links(rows, PAIR_LIMIT, block_rows=block_rows))


def folded(spark, folder) -> DataFrame:
    return R.group_kfold(grouped(spark, folder), 5)


@query("leakage_groups", f"WITH {GROUP_SQL} SELECT id, group_id FROM grouped")
def leakage_groups(spark, folder, block_rows=None):
    return grouped(spark, folder, block_rows)


@query("group_kfold", f"WITH {GROUP_SQL} SELECT id, g.group_id, CAST(fold AS BIGINT) AS fold FROM grouped g JOIN folds f ON g.group_id = f.group_id")
def group_kfold(spark, folder):
    return folded(spark, folder).select("id", "group_id", F.col("fold").cast("long").alias("fold"))


@query("document_folds", """WITH g AS (SELECT source, count(*) AS n FROM documents GROUP BY 1),
z AS (SELECT source, row_number() OVER (ORDER BY n DESC, md5(CAST(substr(source, 4) AS INT)::VARCHAR)) - 1 AS z FROM g)
SELECT doc_id, CAST(CASE WHEN (z // 4) % 2 = 0 THEN z % 4 ELSE 3 - z % 4 END AS BIGINT) AS fold
FROM documents d JOIN z ON d.source = z.source""")
def document_folds(spark, folder):
    docs = table(spark, folder, "documents").select(
        "doc_id", F.substring("source", 4, 10).cast("long").alias("group_id"))
    return R.group_kfold(docs, 4).select("doc_id", F.col("fold").cast("long").alias("fold"))


@query("train_test_view", f"""WITH {GROUP_SQL},
rows AS (SELECT g.id, label, fold, k, CASE WHEN k IS NULL THEN label ELSE label END AS own_label
  FROM (SELECT *, unnest([NULL, 0]) AS k FROM grouped) g JOIN folds f ON g.group_id = f.group_id)
SELECT CASE WHEN fold = 0 THEN 'test' ELSE 'train' END AS side, count(*) AS n,
  CAST(count(k) AS BIGINT) AS n_aug FROM rows WHERE fold <> 0 OR k IS NULL GROUP BY 1""")
def train_test_view(spark, folder):
    real = folded(spark, folder).join(items(spark, folder).select("id", "label"), "id").withColumns(
        {"train_label": F.col("label"), "is_aug": F.lit(False)})
    rows = real.unionByName(real.withColumn("is_aug", F.lit(True)))
    train = R.train_view(rows, 0).withColumn("side", F.lit("train"))
    test = R.test_view(rows, 0).withColumn("side", F.lit("test"))
    return train.unionByName(test).groupBy("side").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_aug").alias("n_aug"))


@query("shuffled_labels", """WITH a AS (SELECT doc_id AS id, quality AS label, row_number() OVER (ORDER BY md5(doc_id::VARCHAR), doc_id) AS z FROM labels),
b AS (SELECT quality AS shuffled, row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) AS z FROM labels)
SELECT id, label::BIGINT AS label, shuffled::BIGINT AS shuffled FROM a JOIN b ON a.z = b.z""")
def shuffled_labels(spark, folder):
    rows = table(spark, folder, "labels").select(
        F.col("doc_id").alias("id"), F.col("quality").cast("long").alias("label"))
    return R.shuffle_labels(rows, 7)


AUDIT_SQL = f"""SELECT count(*) AS groups, CAST(count(*) FILTER (lo <> hi) AS BIGINT) AS crossing_groups,
  (SELECT count(*) FROM unit a JOIN unit b ON a.id < b.id AND round(list_dot_product(a.u, b.u), 9) >= {PAIR_LIMIT}
   JOIN placed x ON x.id = a.id JOIN placed y ON y.id = b.id WHERE x.fold <> y.fold) AS crossing_pairs
FROM (SELECT group_id, min(fold) AS lo, max(fold) AS hi FROM placed GROUP BY 1)"""


def grouped_with_pairs(spark, folder) -> tuple[DataFrame, DataFrame]:
    """The groups and all near-duplicate pairs they come from, so that an audit compares the vectors once."""
    rows = items(spark, folder)
    pairs = cut_lineage(N.near_dup_pairs(rows, PAIR_LIMIT).select("src", "dst"))
    return R.leakage_groups(rows, N.links_of_pairs(pairs)), pairs


@query("leakage_audit", f"""WITH {GROUP_SQL},
placed AS (SELECT id, g.group_id, fold FROM grouped g JOIN folds f ON g.group_id = f.group_id) {AUDIT_SQL}""")
def leakage_audit(spark, folder):
    groups, pairs = grouped_with_pairs(spark, folder)
    return R.leakage_audit(R.group_kfold(groups, 5), pairs)


@query("leakage_audit_careless", f"""WITH {GROUP_SQL},
placed AS (SELECT id, group_id, id % 5 AS fold FROM grouped) {AUDIT_SQL}""")
def leakage_audit_careless(spark, folder):
    """The audit of folds that ignore the groups."""
    groups, pairs = grouped_with_pairs(spark, folder)
    return R.leakage_audit(groups.withColumn("fold", F.col("id") % 5), pairs)


# ---- metrics --------------------------------------------------------------------------------------

def predictions(spark, folder) -> DataFrame:
    """Quality labels against a length rule, with a score from the length."""
    docs = table(spark, folder, "documents")
    return table(spark, folder, "labels").join(docs, "doc_id").select(
        "doc_id", F.col("quality").cast("long").alias("label"),
        (F.col("n_chars") > 1000).cast("long").alias("pred"), (F.col("n_chars") % 1000 / 1000).alias("score"))


PRED_SQL = """pred AS (SELECT l.doc_id, quality::BIGINT AS label, (n_chars > 1000)::BIGINT AS pred,
  (n_chars % 1000) / 1000.0::DOUBLE AS score FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


@query("confusion", f"WITH {PRED_SQL} SELECT label AS truth, pred, count(*) AS n FROM pred GROUP BY ALL")
def confusion(spark, folder):
    return E.confusion(predictions(spark, folder))


@query("per_class_recall", f"""WITH {PRED_SQL} SELECT label, count(*) AS support, count(*) FILTER (label = pred) AS correct,
  round(avg((label = pred)::INT), 6) AS recall FROM pred GROUP BY label""")
def per_class_recall(spark, folder):
    return E.per_class(predictions(spark, folder)).withColumn("recall", r6("recall"))


@query("overall_metrics", f"""WITH {PRED_SQL}, per AS (SELECT label, avg((label = pred)::INT) AS recall FROM pred GROUP BY 1)
SELECT count(*) AS n, round(avg((label = pred)::INT), 6) AS accuracy,
  (SELECT round(avg(recall), 6) FROM per) AS balanced FROM pred""")
def overall_metrics(spark, folder):
    return E.overall(predictions(spark, folder)).withColumns(
        {"accuracy": r6("accuracy"), "balanced": r6("balanced")})


@query("reject_sweep", f"""WITH {PRED_SQL}, c(cutoff) AS (VALUES {', '.join(f'({c}::DOUBLE)' for c in CUTS)})
SELECT cutoff, round(avg((score < cutoff)::INT), 6) AS rejected,
  round(avg((label <> pred)::INT) FILTER (score < cutoff), 6) AS deserved,
  round(avg((label = pred)::INT) FILTER (score >= cutoff), 6) AS accuracy_kept FROM pred, c GROUP BY cutoff""")
def reject_sweep(spark, folder):
    swept = E.reject_sweep(predictions(spark, folder), CUTS)
    return swept.select("cutoff", *[r6(c).alias(c) for c in ("rejected", "deserved", "accuracy_kept")])


# ---- heads ----------------------------------------------------------------------------------------

def wave_head(dim: int = 64, classes: int = CLASSES, min_confidence: float = 0.12) -> dict:
    """A head whose weights follow a formula."""

    def grid(rows, cols):
        return [[math.sin(i * 31 + j * 17) / 8 for j in range(cols)] for i in range(rows)]

    return {
        "labels": [f"L{i}" for i in range(classes)], "scaler_mean": [0.0] * dim, "scaler_scale": [0.125] * dim,
        "proj_w1": grid(WIDE[0], dim), "proj_b1": [0.01] * WIDE[0], "proj_w2": grid(WIDE[1], WIDE[0]),
        "proj_b2": [0.0] * WIDE[1], "coef": [[8 * w for w in row] for row in grid(classes, WIDE[1])],
        "intercept": [0.0] * classes, "min_confidence": min_confidence,
    }


HEAD_SQL = """x AS (SELECT vec_id AS id, generate_subscripts(embedding, 1) - 1 AS j, unnest(embedding::DOUBLE[]) / 0.125 AS x
  FROM embeddings),
h1 AS (SELECT id, i, greatest(sum(sin(i * 31 + j * 17) / 8 * x) + 0.01, 0) AS h FROM x, range(32) r(i) GROUP BY ALL),
h2 AS (SELECT id, r.i, sum(sin(r.i * 31 + h1.i * 17) / 8 * h) AS h FROM h1, range(16) r(i) GROUP BY ALL),
z AS (SELECT id, i, h / greatest(sqrt(sum(h * h) OVER (PARTITION BY id)), 1e-9) AS z FROM h2),
logit AS (SELECT id, r.i AS c, sum(sin(r.i * 31 + z.i * 17) * z) AS l FROM z, range(10) r(i) GROUP BY ALL),
prob AS (SELECT id, c, exp(l) / sum(exp(l)) OVER (PARTITION BY id) AS p FROM logit),
place AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p DESC, c) AS place FROM prob)"""


@query("head_score", f"""WITH {HEAD_SQL} SELECT id, CASE WHEN max(p) >= 0.12 THEN 'L' || arg_min(c, place) ELSE 'Unsorted' END AS section,
  round(max(p), 6) AS confidence FROM place GROUP BY id""")
def head_score(spark, folder):
    return H.score(items(spark, folder).select("id", "embedding"), wave_head()).select(
        "id", "section", r6("confidence").alias("confidence"))


@query("head_tags", f"""WITH {HEAD_SQL} SELECT id, place, 'L' || c AS tag, round(p, 3) AS p FROM place WHERE place <= 3""")
def head_tags(spark, folder):
    out = fresh_path(spark, "head")
    S.write_head(spark, wave_head(), out)
    tagged = H.score(items(spark, folder).select("id", "embedding"), S.read_head(spark, out))
    return tagged.select("id", F.posexplode("tags").alias("at", "t")).select(
        "id", (F.col("at") + 1).cast("long").alias("place"), F.col("t.label").alias("tag"), F.col("t.p").alias("p"))


@query("head_fit")
def head_fit(spark, folder):
    """Accuracy of a fitted linear head on its own training rows."""
    rows = items(spark, folder)
    model, names = H.fit_head(rows, c=1.0)
    index = F.array(*[F.lit(n) for n in names])
    judged = model.transform(rows.withColumn("features", array_to_vector(F.col("embedding"))))
    return E.overall(judged.withColumn("pred", index[F.col("prediction").cast("int")]))


@query("head_fit_planted", "SELECT count(*) AS n, 1.0::DOUBLE AS accuracy, 1.0::DOUBLE AS balanced FROM embeddings")
def head_fit_planted(spark, folder):
    """A head fitted to vectors that carry their class along one axis each: it must find all of them."""
    axis = F.substring("label", 2, 9).cast("int")
    rows = items(spark, folder).withColumn("embedding", F.transform(
        "embedding", lambda x, i: (x * 0.05 + F.when(i == axis, 1.0).otherwise(0.0)).cast("float")))
    model, names = H.fit_head(rows, c=1.0)
    index = F.array(*[F.lit(n) for n in names])
    judged = model.transform(rows.withColumn("features", array_to_vector(F.col("embedding"))))
    return E.overall(judged.withColumn("pred", index[F.col("prediction").cast("int")])).select("n", "accuracy", "balanced")


@query("text_embedding", r"""WITH words AS (SELECT doc_id, unnest(regexp_extract_all(text, '\w+')) AS word FROM documents),
codes AS (SELECT doc_id, CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) AS code FROM words),
sums AS (SELECT doc_id, code % 64 AS bucket, sum(CASE WHEN code // 65536 % 2 = 1 THEN 1.0 ELSE -1.0 END)::DOUBLE AS v FROM codes GROUP BY ALL),
unit AS (SELECT doc_id, bucket, CASE WHEN sum(v * v) OVER w > 0 THEN v / sqrt(sum(v * v) OVER w) ELSE 0 END AS v FROM sums
  WINDOW w AS (PARTITION BY doc_id))
SELECT d.doc_id, 64::BIGINT AS dims, round(coalesce(sum(v * sin(bucket)), 0), 6) AS mixed, round(coalesce(sum(v * v), 0), 6) AS norm
FROM documents d LEFT JOIN unit u ON u.doc_id = d.doc_id GROUP BY d.doc_id""")
def text_embedding(spark, folder):
    """Hashed word embeddings of all documents: size, a fixed mixture of the values, squared norm."""
    docs = spread_scan(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    mixed = F.aggregate(F.transform("embedding", lambda v, i: v * F.sin(i.cast("double"))), F.lit(0.0), lambda a, v: a + v)
    square = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v * v)
    return H.hashed_words(docs, "doc_id").select("doc_id", F.size("embedding").cast("long").alias("dims"),
                                                 r6(mixed).alias("mixed"), r6(square).alias("norm"))


@query("training_set", """WITH i AS (SELECT vec_id, 'L' || label AS label FROM embeddings),
d AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 'notdrum' WHEN 'assistant' THEN 'L' || (length(text) % 10)
  ELSE CASE WHEN length(text) % 2 = 0 THEN 'keep' ELSE 'skip' END END AS label FROM conversations),
r AS (SELECT conv_id, arg_max(label, turn) FILTER (label NOT IN ('notdrum', 'keep', 'skip')) AS human,
  bool_or(label = 'notdrum') AS dropped FROM d GROUP BY 1)
SELECT vec_id AS id, coalesce(human, CASE WHEN vec_id % 5 = 0 THEN 'L0' END, i.label) AS label, false AS is_aug
FROM i LEFT JOIN r ON vec_id = conv_id WHERE NOT coalesce(dropped, false)
UNION ALL SELECT vec_id + 1000000, 'L' || label, true FROM embeddings WHERE label IN (1, 3)""")
def training_set(spark, folder):
    rows = items(spark, folder).select("id", "label")
    fixes = rows.where("id % 5 = 0").select("id", F.lit("L0").alias("new"))
    copies = rows.where(F.col("label").isin("L1", "L3")).select(
        (F.col("id") + 1000000).alias("id"), "label", F.lit(True).alias("is_aug"))
    marks = decisions(spark, folder).withColumnRenamed("hash", "id")
    return corpus.training_set(rows, fixes, marks, copies, key="id")


def decisions(spark: SparkSession, folder: str) -> DataFrame:
    """conversations as a decision log: hash, seq, label."""
    size = F.length("text")
    label = (
        F.when(F.col("role") == "system", "notdrum")
        .when(F.col("role") == "assistant", F.concat(F.lit("L"), (size % 10).cast("string")))
        .otherwise(F.when(size % 2 == 0, "keep").otherwise("skip")))
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("hash"), F.col("turn").alias("seq"), label.alias("label"))


# ---- the same answers from many blocks -------------------------------------------------------------

def in_blocks(name: str, fn) -> None:
    def run(spark, folder):
        return fn(spark, folder, block_rows=BLOCK)

    query(f"{name}_blocks", TWINS[name])(run)


for _fn in (nearest_centroid, knn_cross_group, knn_section_graph, near_dup_pairs, label_triage, leakage_groups,
            augment_gate):
    in_blocks(_fn.__name__, _fn)


@query("near_dup_pairs_copies", f"""WITH {ITEMS_SQL}, more AS (SELECT id, u FROM unit
  UNION ALL SELECT id + 1000000 * (c + 1), u FROM unit, range(3) t(c) WHERE id % 50 = 0)
SELECT a.id AS src, b.id AS dst, round(list_dot_product(a.u, b.u), 6) AS score FROM more a JOIN more b ON a.id < b.id
WHERE round(list_dot_product(a.u, b.u), 9) >= {PAIR_LIMIT}""")
def near_dup_pairs_copies(spark, folder):
    """All pairs where some vectors occur four times."""
    rows = items(spark, folder).select("id", "embedding")
    copies = rows.where("id % 50 = 0").select(
        "id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("c"), "embedding").select(
        (F.col("id") + 1000000 * F.col("c")).alias("id"), "embedding")
    return N.near_dup_pairs(rows.unionByName(copies), PAIR_LIMIT, block_rows=BLOCK).withColumn("score", r6("score"))


# ---- from leakage groups to the training set, on content keys --------------------------------------

KEYED_SQL = GROUP_SQL.replace("vec_id AS id", "md5(vec_id::VARCHAR) AS id")


@query("keyed_chain", f"""WITH {KEYED_SQL},
knn AS (SELECT * FROM (SELECT a.id AS src, a.label AS src_label, b.label AS dst_label,
    row_number() OVER (PARTITION BY a.id ORDER BY round(list_dot_product(a.u, b.u), 9) DESC, b.id) AS rank
  FROM unit a JOIN grouped x ON x.id = a.id JOIN unit b ON a.id <> b.id JOIN grouped y ON y.id = b.id
  WHERE x.group_id <> y.group_id) WHERE rank <= 15),
votes AS (SELECT src, dst_label, count(*) AS n FROM knn GROUP BY ALL),
ballot AS (SELECT src, arg_min(dst_label, (-n, dst_label)) AS consensus, max(n) / 15.0::DOUBLE AS strength FROM votes GROUP BY src),
own AS (SELECT src, avg((dst_label = src_label)::INT) AS own FROM knn GROUP BY src),
fixed AS (SELECT CASE WHEN consensus <> label AND own < 0.45 AND strength >= {STRENGTH} THEN consensus ELSE label END AS label
  FROM items JOIN ballot b ON b.src = items.id JOIN own o ON o.src = items.id)
SELECT label, count(*) AS n FROM fixed GROUP BY label""")
def keyed_chain(spark, folder):
    """Rows per label of the training set: groups, cross-group neighbours, triage and fixes on hash keys."""
    rows = items(spark, folder).drop("group_id").withColumn("id", F.md5(F.col("id").cast("string")))
    groups = R.leakage_groups(rows, N.near_dup_links(rows, PAIR_LIMIT, block_rows=BLOCK))
    judged = corpus.label_triage(rows.join(groups, "id"), K, strength=STRENGTH, block_rows=BLOCK)
    fixes = judged.where("decision = 'fix'").select("id", F.col("consensus").alias("new"))
    none = spark.createDataFrame([], "id string, seq long, label string")
    return corpus.training_set(rows.select("id", "label"), fixes, none, key="id").groupBy("label").agg(
        F.count(F.lit(1)).alias("n"))
