"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, clusters, html, langid, lm, mixing, negatives, pii, quality, secret, simhash, topk, vectors
from .common import is_fold, not_fold, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    net = quality.train(documents, table(spark, sf_dir, "labels"), usable="crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")
    scored = quality.classify_documents(documents, net)
    return scored.select("doc_id", is_fold(scored.doc_id, 5, 0).alias("held_out"), "score", "predicted")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_documents(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
        carry=["doc_id"],
        with_ids=False,
    )


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"), with_text=False)
    counts = [f"n_{kind}" for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken, _ = mixing.mix(table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", "taken")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    models = langid.train(documents.where(not_fold(documents.doc_id, 4, 2)))
    found = langid.identify(documents, models)
    return found.select("doc_id", is_fold(found.doc_id, 4, 2).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = lm.score_documents(documents, not_fold(documents.doc_id, 7, 2))
    held_out = is_fold(scored.doc_id, 7, 2).alias("held_out")
    return scored.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    found = secret.find_secrets(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, with_text=False)
    counts = [f"n_{kind}" for kind in secret.KINDS]
    return found.select("doc_id", *counts, F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(table(spark, sf_dir, "embeddings"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    relabelled = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.hard_negatives(relabelled, F.col("vec_id") % 100 == 0)


def queries() -> dict[str, Query]:
    return {name: function for name, function in globals().items() if name.startswith("op") and callable(function)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def clustering_sql(k: int = 40, rounds: int = 5) -> str:
    """The statement of op12: each round's assignments and centroids are tables of their own."""
    steps = [
        """WITH kept AS (
            SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) - 1 AS c, v FROM kept QUALIFY c < {k})",
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
            SELECT n, any_value(vec_id) AS vec_id, any_value(v) AS v, min((d, c)) AS best
            FROM (SELECT k.n, k.vec_id, k.v, c.c, list_inner_product(k.v, k.v) - 2 * list_inner_product(k.v, c.v) + list_inner_product(c.v, c.v) AS d FROM kept k CROSS JOIN c{i} c) GROUP BY n)""")
        if i < rounds:
            steps.append(f"""m{i} AS (SELECT c, j, floor(sum(x) / count(*)) AS x FROM (SELECT best[2] AS c, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{i}) GROUP BY c, j)""")
            steps.append(f"""c{i + 1} AS MATERIALIZED (
            SELECT o.c, coalesce(m.v, o.v) AS v FROM c{i} o LEFT JOIN (SELECT c, list(x ORDER BY j) AS v FROM m{i} GROUP BY c) m ON m.c = o.c)""")
    return ",\n        ".join(steps) + f"""
        SELECT a.vec_id, CAST(best[2] AS INTEGER) AS cluster, CAST(best[1] AS BIGINT) AS distance, CAST(sum(best[1]) OVER (PARTITION BY best[2]) AS BIGINT) AS cluster_inertia,
            CAST(sum(best[1]) OVER () AS BIGINT) AS inertia, sha256(list_aggregate(list_transform(f.v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), 'string_agg', ',')) AS centroid_sha256
        FROM a{rounds} a JOIN c{rounds} f ON f.c = best[2]"""


ORACLES = {
    # Targets by the rising level; of its shuffled stream a source gives whole epochs and then the words up to its target.
    "op4_mixing": r"""
        WITH docs AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                CAST('0x' || substr(md5('5|' || coalesce(CAST(doc_id AS VARCHAR), 'none') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS ord
            FROM documents),
        sizes AS (SELECT source, sum(size) AS source_size FROM docs GROUP BY source),
        weighed AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, source_size * 3.0 AS most FROM sizes),
        levels AS (
            SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
                / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
            FROM weighed),
        plan AS (
            SELECT source, CAST(source_size AS BIGINT) AS source_size, least(most, weight * max(CASE WHEN level * weight <= most THEN level END) OVER ()) AS target FROM levels),
        takes AS (SELECT *, CAST(round(target) AS BIGINT) // nullif(source_size, 0) AS epochs, CAST(round(target) AS BIGINT) AS take FROM plan),
        placed AS (
            SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY ord % greatest(512, (SELECT (count(*) + 999999) // 1000000 FROM docs)), ord, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at
            FROM docs)
        SELECT p.doc_id, p.size, t.source_size, t.target,
            CAST(CASE WHEN p.size = 0 THEN 0 ELSE t.epochs * p.size + greatest(0, least(p.size, t.take - t.epochs * t.source_size - p.at)) END AS BIGINT) AS taken
        FROM placed p JOIN takes t ON t.source IS NOT DISTINCT FROM p.source""",
    # All pairs, and all that links reach. The operator finds a pair right at the threshold with a probability just under 1.
    "op9_vectors": """
        WITH RECURSIVE usable AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS MATERIALIZED (
            SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
            WHERE list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) >= 0.9),
        reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
        least AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
        counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT e.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(l.m, e.vec_id)) AS component_id, e.vec_id <= coalesce(l.m, e.vec_id) AS kept
        FROM embeddings e LEFT JOIN counts c ON c.a = e.vec_id LEFT JOIN least l ON l.a = e.vec_id""",
    # Every round over all pairs of a vector and a centroid.
    "op12_clusters": clustering_sql(),
    # Brute force over all pairs of an anchor and another row.
    "op13_negatives": """
        WITH usable AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        anchors AS (SELECT DISTINCT vec_id, label, v FROM usable WHERE vec_id % 100 = 0),
        pairs AS MATERIALIZED (
            SELECT a.vec_id AS anchor_id, a.v AS anchor, o.vec_id, o.label = a.label AS same, CAST(list_inner_product(a.v, o.v) AS BIGINT) AS score
            FROM anchors a JOIN usable o ON o.vec_id <> a.vec_id AND len(o.v) = len(a.v)),
        positives AS (
            SELECT *, row_number() OVER (PARTITION BY anchor_id, anchor ORDER BY score DESC, vec_id) AS n FROM pairs WHERE same QUALIFY n <= 5),
        ranked AS (
            SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.anchor, p.n ORDER BY o.score DESC, o.vec_id) AS INTEGER) AS rank,
                o.vec_id AS negative_id, p.score AS positive_score, o.score AS negative_score
            FROM positives p JOIN pairs o ON o.anchor_id = p.anchor_id AND o.anchor = p.anchor AND NOT o.same AND 80 * p.score <= 100 * o.score AND 100 * o.score <= 100 * p.score)
        SELECT * FROM ranked WHERE rank <= 5""",
    # Brute force over all pairs of a query and a candidate.
    "op5_topk": """
        WITH usable AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM usable q JOIN usable c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
        ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10""",
}
