"""Signals that mature as the benchmark's sessions arrive, with what is pending kept in state.

Signals and sessions are two streams. Signals are dealt into shards by their id; a new session goes to every shard once. A shard keeps
the sessions so far, the signals whose creation day is not over (by that day), and the others by the number of the session that ends their
horizon. A batch thus touches what arrives and what it releases, never all that is pending. A signal is released once, with the session on
which its horizon ends; after a restart from the checkpoint the state goes on from where it was.
"""

from __future__ import annotations

import bisect
import contextlib
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def state_in_rocksdb(spark: SparkSession):
    """The state store that such a stream needs, for streams that are started meanwhile."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class Shard(StatefulProcessor):
    """Rows have ``id``, ``day`` and ``horizon_days``; a session's row has only its day."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sessions = handle.getListState("sessions", "day date")
        self.waiting = handle.getMapState("waiting", "day date", "ids array<bigint>, horizons array<int>")
        self.due = handle.getMapState("due", "number int", "ids array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        days = [row[0] for row in self.sessions.get()] if self.sessions.exists() else []
        known, arrived = len(days), set()
        by_day: dict = defaultdict(list)
        for frame in rows:
            signals = frame[frame["id"].notna() & frame["day"].notna() & frame["horizon_days"].notna()]
            for day, own in signals.groupby("day"):
                by_day[day] += zip(own["id"].astype("int64").tolist(), own["horizon_days"].astype("int64").tolist(), strict=True)
            arrived.update(frame.loc[frame["id"].isna() & frame["day"].notna(), "day"])
        new = sorted(d for d in arrived if not days or d > days[-1])
        if new:
            days += new
            self.sessions.appendList([(d,) for d in new])
            # Creation days that are over now; those in state are few, as signals are created about today.
            for (day,) in [k for k in self.waiting.keys() if k[0] <= days[-1]]:  # noqa: SIM118
                ids, horizons = self.waiting.getValue((day,))
                by_day[day] += zip(ids, horizons, strict=True)
                self.waiting.removeKey((day,))
        released: list[tuple[int, object]] = []
        due: dict[int, list[int]] = defaultdict(list)
        for day, own in by_day.items():
            if not days or day > days[-1]:
                ids, horizons = self.waiting.getValue((day,)) if self.waiting.containsKey((day,)) else ((), ())
                self.waiting.updateValue((day,), ([*ids, *[i for i, _ in own]], [*horizons, *[h for _, h in own]]))
                continue
            passed = bisect.bisect_right(days, day)
            for i, horizon in own:
                if 1 <= passed + horizon <= len(days):
                    released.append((i, days[passed + horizon - 1]))
                elif passed + horizon >= 1:
                    due[passed + horizon].append(i)
        for number, ids in due.items():
            held = list(self.due.getValue((number,))[0]) if self.due.containsKey((number,)) else []
            self.due.updateValue((number,), ([*held, *ids],))
        for number in range(known + 1, len(days) + 1):
            if self.due.containsKey((number,)):
                released += [(i, days[number - 1]) for i in self.due.getValue((number,))[0]]
                self.due.removeKey((number,))
        if released:
            yield pd.DataFrame(released, columns=["id", "horizon_end"])

    def close(self) -> None:
        pass


def track(signals: DataFrame, sessions: DataFrame, shards: int | None = None) -> DataFrame:
    """A stream of ``id`` and ``horizon_end`` of the signals that mature.

    ``signals`` is a stream of ``id``, ``created_at`` and ``horizon_days``, ``sessions`` one of ``session_date``. The streams may run ahead of each
    other. Sessions arrive in order: one that is not after the last is taken for a repeated row. A signal without id, time or
    horizon never matures and is not kept; a repeated row of a signal is a signal of its own. The number of shards is the session's
    number of shuffle partitions and must stay the same for a checkpoint.
    """
    shards = shards or int(signals.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = signals.where("id is not null").select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.col("id").cast("long").alias("id"), F.to_date("created_at").alias("day"), F.col("horizon_days").cast("int").alias("horizon_days"))
    days = sessions.select(F.to_date("session_date").alias("day")).where("day is not null").dropDuplicates(["day"])
    every = days.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(None).cast("long").alias("id"), "day", F.lit(None).cast("int").alias("horizon_days"))
    return own.unionByName(every).groupBy("shard").transformWithStateInPandas(Shard(), outputStructType="id long, horizon_end date", outputMode="append", timeMode="none")
