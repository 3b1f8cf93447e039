"""Registered queries of the training-data operators. Each applies one operator with production parameters to
its whole table and derives the digest columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ebbmark.llm import bpe, chat, decontam, hardneg, langid, lexical, nndescent, ppm, quality, secrets, simhash, toxicity, urlrules
from ebbmark.llm.common import id_remainder, prepared, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = lambda spark, folder: build(prepared(spark), folder)
    return build


@query
def op8_forced_boundary_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return bpe.round_trip_digests(docs, bpe.default_path(), doc_id=F.col("doc_id"))


@query
def op3_compression_bands(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.judge(docs, doc_id=F.col("doc_id"))


@query
def op2_hierarchical_svm(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = id_remainder(F.col("doc_id"), 4) == 2
    model = langid.fit(docs.where(~held_out), "text", "lang", "doc_id")
    return langid.predict(docs, model, doc_id=F.col("doc_id"), held_out=held_out)


@query
def op5_bk_tree_simhash(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return simhash.near_duplicates(docs).select(
        "doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op7_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    found = decontam.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        decontam.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


SQL["op7_winnowing"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (
    SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i
    FROM b WHERE len(w) > 0)),
ln AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (
    SELECT r, w, n, unnest(range(1, greatest(len(w) - n, -1) + 2)) AS i FROM d, ln)),
hit AS (SELECT r, dw.n, i, item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.n = bw.n),
cov AS (SELECT r, count(DISTINCT p) AS n_hit FROM (
    SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, n, i FROM hit)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS l FROM (
    SELECT DISTINCT r, item_id::VARCHAR AS k FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(l, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (r) LEFT JOIN its USING (r)
"""


@query
def op6_ownership_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan(table(spark, folder, "documents"))
    base = F.filter("found", lambda x: x["base"])

    def count(keep):
        return F.size(F.filter("found", keep)).cast("long")

    def of_kind(i):
        return count(lambda x: x["kind"] == i)
    return found.select(
        "doc_id", *[of_kind(i).alias(f"n_{k.name}") for i, k in enumerate(secrets.KINDS)],
        count(lambda x: x["live"]).alias("n_live"),
        F.sha2(secrets.labels(base).cast("binary"), 256).alias("base_sha256"), secrets.labels(F.col("found")).alias("spans"))


@query
def op1_ppm(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = id_remainder(F.col("doc_id"), 5) == 1
    return ppm.score(docs, ~held_out, doc_id=F.col("doc_id"), held_out=held_out)


@query
def op10_noisy_channel_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = id_remainder(F.col("doc_id"), 5) == 0
    model = toxicity.fit(docs.where(~held_out), table(spark, folder, "labels"), corpus=docs)
    return toxicity.score(docs, model, doc_id=F.col("doc_id"), held_out=held_out)


@query
def op9_association_rules(spark: SparkSession, folder: str) -> DataFrame:
    return urlrules.judge(table(spark, folder, "pages"))


@query
def op4_token_assembly(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    trap = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", trap), (-7, 1, "assistant", trap)], rows.schema)
    path = bpe.default_path()
    return chat.digests(chat.format_turns(rows.unionByName(extra), path), path)


SQL["op4_token_assembly"] = r"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(role) + length(text) + length('<turn>### : </turn>') + 1
    + length(regexp_replace(text, '\\|<turn>|</turn>|###|<\|endoftext\|>', '\\\0', 'g')) - length(text)
    + length(regexp_replace(role, '\\|<turn>|</turn>|###|<\|endoftext\|>|:', '\\\0', 'g')) - length(role) AS chars FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


@query
def op11_threshold_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(rows, F.col("vec_id") % 100 == 0, label=label)


SQL["op11_threshold_negatives"] = """
WITH e AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, e.vec_id AS id, a.label = e.label AS same, list_inner_product(a.q, e.q)::BIGINT AS score
    FROM e AS a JOIN e ON a.vec_id <> e.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
        AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


@query
def op12_bag_classes(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.rank(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


SQL["op12_bag_classes"] = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
d AS (SELECT r, doc_id, t, len(t)::BIGINT AS n FROM w WHERE len(t) > 0),
g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM d),
b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark WHERE item_id IS NOT NULL),
f AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM b) GROUP BY ALL),
v AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM f, g GROUP BY term, docs),
s AS (SELECT item_id, doc_id, r, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score
    FROM f JOIN v USING (term) JOIN b USING (term) JOIN d USING (r), g GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 10
"""


@query
def op13_nn_descent(spark: SparkSession, folder: str) -> DataFrame:
    index = nndescent.build(table(spark, folder, "embeddings"))
    return nndescent.search(index, F.col("id") % 50 == 0)
