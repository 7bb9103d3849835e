"""Calls of an outside client, such as a language model, from executors: bounded, paced, retried, and remembered.

Requests are told apart by the SHA-256 of their text, and each is asked once, however many rows have it. Answers are kept as a
table by that hash and are not asked for again. Calls run in a set number of tasks, each of which calls one after another within its
share of the rate; a call that fails with one of the errors to retry waits twice as long each time. What still fails gives a row with
its error and is asked again by the next run.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .feeds import resolve
from .shared import fresh_path, hadoop_path

#: Errors of the network, after which a call may succeed.
RETRIED = (OSError, TimeoutError)


def with_retry(call: Callable, attempts: int, first_wait: float, retried: tuple[type[BaseException], ...] = RETRIED, sleep: Callable[[float], None] = time.sleep):
    """What ``call()`` gives, tried up to ``attempts`` times; the wait doubles and varies by a half, so that tasks don't come back together."""
    for attempt in range(1, attempts + 1):
        try:
            return call()
        except retried:
            if attempt == attempts:
                raise
            sleep(first_wait * 2 ** (attempt - 1) * (0.75 + random.random() / 2))


class Pace:
    """At most ``rate`` calls a second, evenly spread; None is no limit."""

    def __init__(self, rate: float | None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap = 1 / rate if rate else 0.0
        self.clock, self.sleep, self.next = clock, sleep, 0.0

    def wait(self) -> None:
        now = self.clock()
        if now < self.next:
            self.sleep(self.next - now)
        self.next = max(now, self.next) + self.gap


ANSWERS = "hash string, answer string, error string, attempts int"


def ask(requests: DataFrame, client: str | Callable[[str], str], text: str = "prompt", cache: str | None = None, tasks: int = 8, rate: float | None = None, attempts: int = 4, first_wait: float = 0.5) -> DataFrame:
    """``requests`` with ``answer`` and ``error``; columns of these names are replaced.

    ``client`` is a function of a text, or its name as ``module:function``. ``cache`` is the folder of the answers, by default one of this call's
    own. ``tasks`` bounds the calls at a time and ``rate`` those a second, all tasks together. The calls are made here, once, and the
    result reads what they gave. A null text is not asked and has a null answer; an empty table asks nothing. A task that is lost
    asks again for what it had not handed on.
    """
    spark = requests.sparkSession
    folder = (cache or fresh_path(spark, "answers")).rstrip("/")
    hashed = requests.drop("answer", "error").withColumn("_hash", F.sha2(F.col(f"`{text}`"), 256))
    wanted = hashed.where("_hash is not null").groupBy(F.col("_hash").alias("hash")).agg(F.first(F.col(f"`{text}`")).alias("text"))
    known = answers(spark, folder).where("error is null").select("hash").distinct()
    new = wanted.join(known, "hash", "left_anti")
    share = rate / tasks if rate else None

    def call_all(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        function, pace = resolve(client), Pace(share)
        for frame in frames:
            rows = []
            for key, value in zip(frame["hash"], frame["text"], strict=True):
                made = 0

                def once(value=value):
                    nonlocal made
                    made += 1
                    pace.wait()
                    return function(value)

                try:
                    rows.append((key, str(with_retry(once, attempts, first_wait)), None, made))
                except Exception as error:  # noqa: BLE001  it is the row's result
                    rows.append((key, None, f"{type(error).__name__}: {error}", made))
            yield pd.DataFrame(rows, columns=["hash", "answer", "error", "attempts"])

    new.repartition(tasks, "hash").mapInPandas(call_all, ANSWERS).write.mode("append").parquet(folder)
    found = answers(spark, folder).groupBy("hash").agg(F.max("answer").alias("answer"), F.max("error").alias("error"))
    joined = hashed.join(found.withColumnRenamed("hash", "_h"), F.col("_hash") == F.col("_h"), "left")
    # An error of an earlier run says nothing once there is an answer.
    return joined.withColumn("error", F.when(F.col("answer").isNull(), F.col("error"))).drop("_hash", "_h")


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """All answers that are kept, and the errors."""
    path, files = hadoop_path(spark, folder)
    return spark.read.schema(ANSWERS).parquet(folder) if files.exists(path) else spark.createDataFrame([], ANSWERS)
