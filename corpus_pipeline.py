"""A corpus pipeline over ``documents``: each stage is one operator, written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from panelforge.llm import bpe, mixing, pii, quality, simhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents with a score under 0.3 go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    net = quality.train(docs, labels, usable="crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")
    return quality.classify_documents(docs, net, carry=docs.columns).where("predicted = 1").select(docs.columns)


def written(column: Column, kind: T.DataType) -> Column:
    """Text that differs wherever the values differ; null of a null."""
    if isinstance(kind, T.BinaryType):
        return F.hex(column)
    if isinstance(kind, T.ArrayType):
        return F.to_json(F.transform(column, lambda x: written(x, kind.elementType)))
    if isinstance(kind, T.StructType):
        return F.when(column.isNotNull(), F.to_json(F.array(*[written(column.getField(f.name), f.dataType) for f in kind])))
    if isinstance(kind, T.MapType):
        return written(F.array_sort(F.map_entries(column)), T.ArrayType(T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])))
    return column.cast("string")


def keyed(docs: DataFrame) -> DataFrame:
    """Each whole ``row``, with what stages read of it and keys by which equal rows meet; other columns may have any name.

    ``row_key`` is the SHA-256 of all columns as a JSON array, where a null is told from every value and from a null of another column.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    texts = [written(column, field.dataType) for column, field in zip(columns, docs.schema, strict=True)]
    own_id = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    return docs.select(F.struct(*columns).alias("row"), "doc_id", "text", "source", F.sha2(F.to_json(F.array(*texts)), 256).alias("row_key"), own_id.alias("id_key"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: of each group the document with the least id stays.

    Of several rows with that id, or of a group whose ids are all null, one stays: the first by the hash of its columns.
    An id that repeats in several groups stays in each.
    """
    marked = keyed(docs)
    groups = simhash.near_duplicates(marked, carry=["row_key", "id_key"])
    least = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "id_key", "row_key")).alias("first")
    first = groups.groupBy("group_print").agg(least).select("first.id_key", "first.row_key")
    # Rows that are equal in all columns have one key; the join's partitioning serves to keep one of them.
    return marked.join(first, ["id_key", "row_key"], "left_semi").dropDuplicates(["id_key", "row_key"]).select("row.*")


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: entities become their kind's name, terms that disclose them are generalised or removed."""
    found = pii.find_personal_data(docs, carry=docs.columns)
    clean = found.withColumn("text", F.col("sanitised"))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: a document stands once for each epoch in which the mix takes words of it, whole.

    Rows that are equal in all columns stand together as often as the mix takes words of any of them.
    """
    marked = keyed(docs)
    taken, _ = mixing.mix(marked, doc_id="row_key")
    times = taken.where("taken > 0").groupBy(F.col("doc_id").alias("row_key")).agg(F.sum(F.ceil(F.col("taken") / F.col("size"))).cast("int").alias("times"))
    # The join's partitioning serves to keep one of equal rows.
    chosen = marked.join(times, "row_key").dropDuplicates(["row_key"])
    return chosen.select("row", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE: the ids of every text, and proof that they decode to it."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    # The workers of other stages' tasks are there, too, so this one remembers less.
    return bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN, carry=["doc_id", "lang", "source"], memory=0.25)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", keep_one_of_each_group),
    ("PII", sanitise),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode),
]

#: SQL expresses neither the network nor the dynamic programming; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Stages are written to the folder that executors share.

    Null and empty texts are documents like any other, but the mix takes none that has no word. Columns beyond those of
    ``documents`` are carried by all stages but the last. An empty table gives an empty one.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import atexit
        import shutil
        import tempfile

        folder = tempfile.mkdtemp(prefix="pipeline-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    own = f"{folder.rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{own}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
