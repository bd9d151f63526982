"""The registered queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

import sys

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ann, bpe, lloyd, lm, mixing, order_minhash, pii, quality, repair, rules, simhash, toxicity, urlfilter
from tessera.llm.common import fold_of, read, staged

# Place of the tokenizer vocabulary (never copied into the repository).
TOKENIZER = str(public_tokenizers.path("byte_bpe_50k.json"))

# The rules of the URL query.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = order_minhash.classes(read(spark, sf_dir, "documents"))
    return named.select("doc_id", "class_id", "class_size", "n_links")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.learn(docs, read(spark, sf_dir, "labels"), "toxic", folds=4, held_out=2)
    return toxicity.score_texts(docs, lexicon).select(
        "doc_id",
        (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.learn(docs, read(spark, sf_dir, "labels"), "quality", folds=5, held_out=0)
    return quality.score_texts(docs, model).select(
        "doc_id",
        (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode(docs, TOKENIZER).select("doc_id", "ids")
    decoded = bpe.decode(encoded, TOKENIZER)
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = urlfilter.judge(read(spark, sf_dir, "pages").select("page_id", "url"), listed)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    forest = rules.learn(docs, read(spark, sf_dir, "labels"), "quality")
    return rules.judge(docs, forest).select("doc_id", *rules.COUNTS, "base_failed", "kept", "anomaly")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    # strict: a word found nowhere in the corpus but beside an entity discloses it
    found = pii.detect(read(spark, sf_dir, "documents"), threshold=0.25)
    base, terms = pii.span_list(F.col("base")), pii.span_list(F.col("terms"))
    both = F.array(base, terms)
    return found.select(
        "doc_id",
        *[pii.count_of(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(base, 256).alias("base_sha256"),
        F.array_join(F.filter(both, lambda x: x != ""), ",").alias("spans"),
    )


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(read(spark, sf_dir, "documents"), folds=5, held_out=1)


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(base, base.filter(F.col("vec_id") % 20 == 0), k=20)


def _damaged(conversations: DataFrame) -> DataFrame:
    """The damage of op11's contract; nulls are one space."""
    space = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    dealt = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("d"))
    copies = F.when(F.col("d") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("d") == 4, "user").otherwise(F.col("role"))
    return (
        dealt.filter("d != 0")
        .select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))
        .drop("copy")
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    found = repair.summary(repair.edits(_damaged(rows))).withColumnRenamed("conv_id", "found_id")
    every = rows.select("conv_id").distinct()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("found_id")), "left").select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lloyd.cluster(read(spark, sf_dir, "embeddings"), clusters=40, rounds=5, dims=64, scale=256, salt="2:")
    if found is None:
        return spark.createDataFrame(
            [], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        )
    rows = staged(found.rows(), "clusters")
    # at most 40 rows
    sums = {r.cluster: r.total for r in rows.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    named = spark.createDataFrame(
        [(c, t, found.digest(c)) for c, t in sums.items()], "cluster int, cluster_inertia long, centroid_sha256 string"
    )
    return rows.join(F.broadcast(named), "cluster").select(
        "vec_id",
        "cluster",
        "distance",
        "cluster_inertia",
        F.lit(sum(sums.values())).cast("long").alias("inertia"),
        "centroid_sha256",
    )


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "class_size")


def _clusters_sql(clusters: int, rounds: int, dims: int, scale: int) -> str:
    """The rounds of op12 written one after the other."""
    parts = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id,
         list_transform(embedding, lambda v: CAST(floor({scale} * CAST(v AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE len(embedding) = {dims}
    AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = {dims})""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')), x) - 1 AS c, x FROM kept
  ORDER BY 1 LIMIT {clusters})""",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT * FROM (
    SELECT k.r, k.vec_id, k.x, c.c, list_sum(list_transform(list_zip(k.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d
    FROM kept k, c{i} c)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT old.c, coalesce(new.x, old.x) AS x FROM c{i} old LEFT JOIN (
    SELECT c, list(CAST(floor(total / n) AS BIGINT) ORDER BY dim) AS x FROM (
      SELECT c, dim, sum(v) AS total, count(*) AS n
      FROM (SELECT c, unnest(x) AS v, generate_subscripts(x, 1) AS dim FROM a{i}) GROUP BY c, dim) GROUP BY c) new
  ON old.c = new.c)""")
    return f"""WITH {", ".join(parts)}
SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance,
       CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.c = c.c"""


QUERIES = {name: fn for name, fn in vars(sys.modules[__name__]).items() if name.startswith("op")}

ORACLE_SQL = {
    "op12_centroid_clusters": _clusters_sql(clusters=40, rounds=5, dims=64, scale=256),
    "op2_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, md5(concat('mix:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS k,
         md5(coalesce(text, '')) AS tie,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w,
         3 * source_size AS cap, sum(source_size) OVER () AS total
  FROM sources),
filled AS (
  SELECT *, row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS turn,
         (total - coalesce(sum(cap) OVER (ORDER BY source_size / w, source NULLS LAST
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY source_size / w, source NULLS LAST
                    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted),
cut AS (SELECT min(turn) AS t FROM filled WHERE level * w <= cap),
targets AS (
  SELECT f.source, f.source_size,
         CASE WHEN f.turn >= cut.t THEN (SELECT level FROM filled, cut c WHERE turn = c.t) * f.w
              ELSE CAST(f.cap AS DOUBLE) END AS target
  FROM filled f, cut),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.size, s.tie
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
passes AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs
  FROM placed)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size
            + least(greatest(CAST(floor(target) AS BIGINT) - epochs * source_size - before, 0), size) AS BIGINT) AS taken
FROM passes""",
    "op6_url_filters": r"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(.*?)://([^/?#]*)([^?#]*)', 2, 's'),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(.*?)://([^/?#]*)([^?#]*)', 3, 's') AS path
  FROM pages),
rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fits AS (
  SELECT DISTINCT host, path, h, p, v FROM parts JOIN rules
    ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
best AS (
  SELECT *, row_number() OVER (PARTITION BY host, path ORDER BY length(h) + length(p) DESC, length(h) DESC) AS r
  FROM fits)
SELECT parts.page_id, parts.host, parts.path, best.h || best.p AS rule, coalesce(best.v, 'allow') AS verdict
FROM parts LEFT JOIN best ON parts.host = best.host AND parts.path = best.path AND best.r = 1""",
}
