"""A table of latest rows as a log: base files by bucket, batches on top, and commits that no two writers can overwrite.

A batch is written as files of its own and then named by one small commit file, which is put in place by a rename. Commit files have names of
their own, so writers never meet: the state of the table is what all commit files say together, and a batch is there once its commit
is, whole or not at all. Batches have a number one above the highest that their writer saw; of rows with one key that of the
highest number counts, and of equal numbers that of the greater batch name, so all readers agree.

Compacting merges batches into new files of the buckets that they touch and commits where each bucket's rows now are, and which batches are
in them. Of several compactions the one with the most batches in it counts, by name if they are even; batches that are in none are read on
top, so a batch that is committed meanwhile, or that another compaction alone has merged, is not lost. Files that no state needs are
removed by :meth:`LatestLog.vacuum` only.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import drop, hadoop_path

#: Batches on top of the base after which an append compacts.
BATCHES = 16
BUCKETS = 32


class LatestLog:
    """Rows of ``schema`` of which the latest one of each ``key`` counts, under ``path``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = BUCKETS, batches: int = BATCHES):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key
        self.buckets, self.batches = buckets, batches

    # Commits

    def commits(self) -> list[dict]:
        """All commit files, in the order of their names."""
        folder, files = hadoop_path(self.spark, f"{self.path}/commits")
        if not files.exists(folder):
            return []
        names = sorted(s.getPath().getName() for s in files.listStatus(folder))
        names = [n for n in names if n.endswith(".json")]
        if not names:
            return []
        # A few dozen between two vacuums: they are as many as the batches since, whatever is in these.
        rows = self.spark.read.schema("value string").text([f"{self.path}/commits/{n}" for n in names], wholetext=True).collect()
        return sorted((json.loads(r["value"]) for r in rows), key=lambda c: c["name"])

    def _commit(self, entry: dict) -> None:
        name = entry["name"]
        temporary, files = hadoop_path(self.spark, f"{self.path}/commits/.{name}.tmp")
        out = files.create(temporary, False)
        out.write(json.dumps(entry).encode())
        out.close()
        final, _ = hadoop_path(self.spark, f"{self.path}/commits/{name}.json")
        if not files.rename(temporary, final):
            raise OSError(f"commit {name} could not be put in place")

    def state(self) -> tuple[dict[str, str], list[dict]]:
        """Where each bucket of the base is, and the batches on top of it, in their order."""
        commits = self.commits()
        bases = [c for c in commits if "base" in c]
        best = max(bases, key=lambda c: (len(c["merged"]), c["name"]), default={"base": {}, "merged": []})
        merged = set(best["merged"])
        top = [c for c in commits if "batch" in c and c["batch"] not in merged]
        return best["base"], sorted(top, key=lambda c: (c["number"], c["batch"]))

    # Writing

    def append(self, rows: DataFrame) -> None:
        """Add a batch; compacts once there are ``batches`` on top of the base."""
        commits = self.commits()
        name = uuid.uuid4().hex
        made = self._declared(rows).withColumn("_bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))
        made.write.parquet(f"{self.path}/batch-{name}")
        number = max((c["number"] for c in commits), default=0) + 1
        self._commit({"name": f"{number:012d}-{name}", "number": number, "batch": name})
        if len(self.state()[1]) >= self.batches:
            self.compact()

    def compact(self) -> None:
        """Merge the batches on top into the buckets that they touch; the other buckets' files stay."""
        base, top = self.state()
        if not top:
            return
        batches = self._batches(top)
        touched = sorted(r["_bucket"] for r in batches.select("_bucket").distinct().collect())  # at most as many as buckets
        old = [base[str(b)] for b in touched if str(b) in base]
        merged = self._merged(self._files(old) if old else None, batches)
        name = uuid.uuid4().hex
        folder = f"{self.path}/base-{name}"
        # One task a bucket, or more for a large one: rows of a bucket are dealt out by their key.
        merged.select(*self._names(), "_bucket").repartition("_bucket", F.pmod(F.hash(self.key), F.lit(4))).write.partitionBy("_bucket").parquet(folder)
        new = base | {str(b): f"base-{name}/_bucket={b}" for b in touched}
        number = max(c["number"] for c in top)
        known = next((c["merged"] for c in self.commits() if "base" in c and c["base"] == base), [])
        self._commit({"name": f"{number:012d}-base-{name}", "number": number, "base": new, "merged": [*known, *[c["batch"] for c in top]]})

    def vacuum(self) -> None:
        """Remove files that the present state does not need. Not while others read an older state or write."""
        base, top = self.state()
        needed = {x.split("/")[0] for x in base.values()} | {f"batch-{c['batch']}" for c in top}
        folder, files = hadoop_path(self.spark, self.path)
        if not files.exists(folder):
            return
        for status in files.listStatus(folder):
            name = status.getPath().getName()
            if name.startswith(("batch-", "base-")) and name not in needed:
                drop(self.spark, f"{self.path}/{name}")
        # The commits of batches that are merged, and of older bases, say nothing more.
        best = max((c for c in self.commits() if "base" in c), key=lambda c: (len(c["merged"]), c["name"]), default=None)
        for c in self.commits():
            if best and c["name"] != best["name"] and ("base" in c or c["batch"] in set(best["merged"])):
                drop(self.spark, f"{self.path}/commits/{c['name']}.json")

    # Reading

    def read(self) -> DataFrame:
        """The latest row of each key. The base is scanned once and not shuffled; batches on top are few."""
        base, top = self.state()
        whole = self._files(sorted(base.values())) if base else None
        if not top:
            return (whole if whole is not None else self.spark.createDataFrame([], self.schema)).select(*self._names())
        return self._merged(whole, self._batches(top)).select(*self._names())

    def _names(self) -> list[str]:
        return self.spark.createDataFrame([], self.schema).columns

    def _declared(self, rows: DataFrame) -> DataFrame:
        """The declared columns: absent ones are NULL, so files of an older schema load like others, and are rewritten when they are merged."""
        fields = self.spark.createDataFrame([], self.schema).schema
        return rows.select(*[(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields])

    def _files(self, folders: list[str]) -> DataFrame:
        read = self.spark.read.option("mergeSchema", True).parquet(*[f"{self.path}/{x}" for x in folders])
        return self._declared(read).withColumn("_bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def _batches(self, top: list[dict]) -> DataFrame:
        """The latest row of each key among the batches; of several in one batch the greatest as text."""
        placed = [self._files([f"batch-{c['batch']}"]).withColumn("_place", F.lit(i)) for i, c in enumerate(top)]
        every = reduce(DataFrame.unionByName, placed)
        row = F.struct(*self._names())
        order = F.struct("_place", F.to_json(row, {"ignoreNullFields": "false"}))
        last = every.groupBy(F.col(self.key).alias("_key"), "_bucket").agg(F.max_by(row, order).alias("row"))
        return last.select("row.*", "_bucket")

    def _merged(self, base: DataFrame | None, batches: DataFrame) -> DataFrame:
        if base is None:
            return batches
        newer = batches.select(F.col(self.key).alias("_newer"))
        return base.join(newer, F.col(self.key).eqNullSafe(F.col("_newer")), "left_anti").unionByName(batches)
