"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame operations only.

Targets: sources share the words of all documents by weight; a source takes at most ``epochs`` times its own
words, and what is over is shared again by weight among the rest until nothing is. That is: every source
takes the lesser of its limit and a level times its weight, with the one level that uses up all words.

Blocks: a source's documents are shuffled by a hash and laid end to end, and the stream is cut into blocks of equal
numbers of words. A source that takes more than its own words goes through its blocks again.

Schedule: slot n of the mix has the point frac(n * golden ratio). The points are mapped through the sources'
cumulative numbers of needed blocks, so every stretch of the mix has the sources in their proportions. A slot's rank
among its source's slots says which block it takes. The schedule gives a source a few slots more or less than it
needs; surplus ones are dropped, missing ones stand at the end, and the last block is cut so that a
source's words come to its target exactly.

Ranks and places in a stream come from sums over fixed buckets and a window within a bucket, so a source with a
third of all documents is spread over all tasks. The only single-task windows run over one row for each source
or for each source and bucket.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_PATTERN, shared_checkpoint

#: Least number of buckets, and the rows above which there are more, so that a window's rows stay bounded.
BUCKETS = 512
BUCKET_ROWS = 1_000_000
#: The mix has about this many slots, more if a block would then have over BLOCK_WORDS words.
SLOTS = 65_536
BLOCK_WORDS = 65_536
#: Slots that are ranked in one window.
SLOT_RUN = 4096
#: Places of the schedule that one row is spread to.
PLACE_RUN = 65_536
#: Fractional part of the golden ratio in units of 2**-32, so that points are exact integers.
GOLDEN = 2_654_435_769


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def shuffle_order(doc_id: Column, text: Column, seed: int) -> Column:
    """60 bits of the MD5 of the id and the text, by which a source's documents are shuffled."""
    key = F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("none")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def cyclic_weights(source_rank: Column) -> Column:
    """1, 2, 3 and again, by the place of a source."""
    return (F.pmod(source_rank - 1, F.lit(3)) + 1).cast("double")


def source_targets(sizes: DataFrame, epochs: int = 3, weights: Callable[[Column], Column] = cyclic_weights) -> DataFrame:
    """For each ``source`` (null is one of its own, and the last): ``source_size``, ``weight`` and ``target``.

    ``sizes`` has ``source`` and ``source_size``, one row for each source.
    """
    # UTF-8 sorts by code point, as the default collation does.
    ranked = sizes.withColumn("weight", weights(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))))
    ranked = ranked.withColumn("most", F.col("source_size") * F.lit(float(epochs)))
    # Sources in the order in which a rising level takes them to their limits; each one's level supposes that all before
    # it are at theirs. The first source that its level leaves within its limit has the right one, and that is the
    # highest of those that do.
    upward = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = upward.rowsBetween(Window.unboundedPreceding, -1)
    after = upward.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    levels = ranked.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    levels = levels.withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    levels = levels.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))).over(everything))
    target = F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least("most", F.col("level") * F.col("weight")))
    return levels.select("source", "source_size", "weight", target.alias("target"))


def mix(
    df: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    source: str = "source",
    epochs: int = 3,
    seed: int = 5,
    weights: Callable[[Column], Column] = cyclic_weights,
    block_words: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Two tables: the documents with what the mix takes of them, and the scheduled pieces.

    Documents: ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``taken``; one row for each input row,
    repeated rows included. A text that is null or has no word has size 0 and nothing of it is taken. Pieces:
    ``slot`` (their order in the mix), ``doc_id``, ``source``, ``epoch``, ``begin`` (words into the document) and
    ``words``. Runs agree, as order comes from hashes of the rows alone. An empty table gives empty ones.
    """
    docs = df.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.col(f"`{source}`").alias("source"),
        word_count(F.col(f"`{text}`")).alias("size"),
        shuffle_order(F.col(f"`{doc_id}`"), F.col(f"`{text}`"), seed).alias("order"),
    )
    key = F.when(F.col("source").isNull(), F.lit("none")).otherwise(F.concat(F.lit("is "), F.col("source").cast("string")))
    docs = shared_checkpoint(docs.withColumn("key", key))
    n_buckets = max(BUCKETS, -(-docs.count() // BUCKET_ROWS))
    docs = docs.withColumn("bucket", F.pmod("order", F.lit(n_buckets)))
    buckets = shared_checkpoint(docs.groupBy("key", "source", "bucket").agg(F.sum("size").alias("words")))
    targets = source_targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), epochs, weights)
    per_block = F.lit(block_words) if block_words else F.least(F.lit(BLOCK_WORDS), F.greatest(F.lit(1), F.ceil(F.sum("source_size").over(Window.partitionBy()) / SLOTS)))
    plan = targets.withColumn("block", per_block.cast("long")).withColumn("take", F.round("target").cast("long"))
    ceil_div = lambda a, b: F.expr(f"({a} + {b} - 1) div {b}")
    plan = plan.withColumn("blocks", ceil_div("source_size", "block"))
    plan = plan.withColumn("full", F.expr("if(source_size = 0, 0, take div source_size)"))
    plan = plan.withColumn("rest", F.col("take") - F.col("full") * F.col("source_size"))
    plan = plan.withColumn("needed", F.col("full") * F.col("blocks") + ceil_div("rest", "block"))
    up = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    plan = plan.withColumn("high", F.sum("needed").over(up)).withColumn("slots", F.sum("needed").over(Window.partitionBy()))
    plan = plan.withColumn("name", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    plan = shared_checkpoint(plan.withColumn("key", key))

    # Places of documents in their source's stream. The key and the bucket together spread a large source.
    starts = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("start", F.coalesce(F.sum("words").over(starts), F.lit(0))).drop("words", "source")
    known = buckets.join(plan.select("key", "name", "source_size", "target", "block"), "key")
    inner = Window.partitionBy("key", "bucket").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = docs.withColumn("before", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(known, ["key", "bucket"])
    placed = placed.withColumn("at", F.col("start") + F.col("before")).select("name", "doc_id", "source", "size", "source_size", "target", "block", "at")
    placed = shared_checkpoint(placed)

    # Pieces of documents in blocks.
    cut = placed.where("size > 0").select("*", F.explode(F.expr("sequence(at div block, (at + size - 1) div block)")).alias("in_block"))
    cut = cut.withColumn("from", F.greatest("at", F.col("in_block") * F.col("block")))
    cut = cut.withColumn("words", F.least(F.col("at") + F.col("size"), (F.col("in_block") + 1) * F.col("block")) - F.col("from"))
    cut = cut.withColumn("begin", F.col("from") - F.col("at")).withColumn("inside", F.col("from") - F.col("in_block") * F.col("block"))

    joined = cut.join(schedule(plan), ["name", "in_block"], "left")
    joined = joined.withColumn("words", F.greatest(F.lit(0), F.least("words", F.coalesce("limit", F.lit(0)) - F.col("inside"))))
    pieces = joined.where("words > 0").select("slot", "doc_id", "source", "epoch", "begin", "words")
    # A document with words has a place of its own in its source's stream.
    taken = joined.groupBy("name", "at", "doc_id", "source", "size", "source_size", "target").agg(F.sum("words").cast("long").alias("taken"))
    columns = ["doc_id", "source", "size", "source_size", "target", "taken"]
    empty = placed.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return taken.select(columns).unionByName(empty.select(columns)), pieces


def schedule(plan: DataFrame) -> DataFrame:
    """``slot``, ``name``, ``in_block``, ``epoch`` and ``limit``, the words that are taken of the block.

    ``plan`` has for each source its number ``name``, the slots ``needed``, their running total ``high``, all
    ``slots``, its ``blocks``, words ``block`` of one, ``full`` epochs and ``rest`` words.
    """
    total = plan.agg(F.max("slots")).first()[0] or 0
    if not total:
        return plan.select(F.lit(0).cast("long").alias("slot"), "name", F.lit(0).cast("long").alias("in_block"), F.lit(0).cast("long").alias("epoch"), F.lit(0).cast("long").alias("limit")).where("false")
    sources = plan.where("needed > 0").select("name", (F.col("high") - F.col("needed")).alias("low"), "needed")
    # slot * GOLDEN and a point times the total stay under 2**63 for up to 2**31 slots.
    slots = plan.sparkSession.range(total).select(F.col("id").alias("slot"))
    slots = slots.withColumn("place", F.shiftright(F.pmod(F.col("slot") * GOLDEN, F.lit(1 << 32)) * F.lit(total), 32))
    # A large source's places are made run by run in many tasks, not from one row.
    runs = sources.select("*", F.explode(F.expr(f"sequence(low div {PLACE_RUN}, (low + needed - 1) div {PLACE_RUN})")).alias("run"))
    runs = runs.repartition(int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions")), "name", "run")
    begin, end = F.greatest("low", F.col("run") * PLACE_RUN), F.least(F.col("low") + F.col("needed"), (F.col("run") + 1) * PLACE_RUN)
    places = runs.select("name", F.explode(F.sequence(begin, end - 1)).alias("place"))
    dealt = slots.join(places, "place").select("slot", "name").withColumn("run", F.expr(f"slot div {SLOT_RUN}"))
    # Ranks: slots of earlier runs, and the place in the own run.
    sums = dealt.groupBy("name", "run").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("name").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    ranked = dealt.withColumn("in_run", F.row_number().over(Window.partitionBy("name", "run").orderBy("slot")) - 1)
    ranked = ranked.join(sums.drop("n"), ["name", "run"]).select("slot", "name", (F.col("earlier") + F.col("in_run")).alias("rank"))
    given = sums.groupBy("name").agg(F.sum("n").alias("given"))
    missing = sources.join(given, "name", "left").withColumn("given", F.coalesce("given", F.lit(0))).where("given < needed")
    missing = missing.select("name", "low", F.explode(F.expr("sequence(given, needed - 1)")).alias("rank"))
    ranked = ranked.unionByName(missing.select((F.lit(total) + F.col("low") + F.col("rank")).alias("slot"), "name", "rank"))
    own = plan.select("name", "needed", "blocks", "block", "full", "rest")
    ranked = ranked.join(own, "name").where("rank < needed")
    ranked = ranked.withColumn("epoch", F.expr("rank div blocks")).withColumn("in_block", F.expr("rank % blocks"))
    limit = F.when(F.col("epoch") < F.col("full"), F.col("block")).otherwise(F.least("block", F.col("rest") - F.col("in_block") * F.col("block")))
    return ranked.select("slot", "name", "in_block", "epoch", limit.alias("limit"))
