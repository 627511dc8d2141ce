"""Table functions for SQL, for what neither a window nor an aggregate says well."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="owner bigint, events bigint, bursts bigint")
class Bursts:
    """Over one partition's rows (owner, at in microseconds, apart), in order of time: how many rows and how many bursts, a
    burst being what begins more than `apart` microseconds after the row before. Holds three numbers."""

    def __init__(self):
        self.owner, self.events, self.bursts, self.before = None, 0, 0, None

    def eval(self, row):
        self.owner = row["owner"]
        self.events += 1
        self.bursts += self.before is None or row["at"] - self.before > row["apart"]
        self.before = row["at"]

    def terminate(self):
        if self.events:
            yield self.owner, self.events, self.bursts


def register(spark: SparkSession) -> None:
    """Makes `bursts(TABLE(...) PARTITION BY owner ORDER BY at)` known to SQL."""
    spark.udtf.register("bursts", Bursts)
