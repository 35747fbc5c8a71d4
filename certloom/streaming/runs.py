"""What a stream remembers, as a log of runs in a shared folder.

Each batch writes only what it changes, as a run of level 0. Every `fan` runs of a level are merged into one run of
the next, so a row is written again once per level, whose number grows with the logarithm of the number of batches;
a small batch doesn't rewrite a large table. Runs that were merged are overwritten by later ones: a level never holds
more than `fan` folders.

A batch that is run again writes the same folders with the same rows and reads none of them, so nothing has to be
looked up to tell whether it had ended.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FAN = 8


class Runs:
    """The runs below a folder; merge brings rows of several runs to one row per key."""

    def __init__(self, folder: str, schema: T.StructType, merge: Callable[[DataFrame], DataFrame], fan: int = FAN) -> None:
        self.folder, self.schema, self.merge, self.fan = folder.rstrip("/"), schema, merge, fan

    def _at(self, level: int, number: int) -> str:
        return f"{self.folder}/level={level}/run={number % self.fan}"

    def _read(self, spark: SparkSession, paths: list[str]) -> DataFrame:
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def before(self, spark: SparkSession, batch: int) -> DataFrame:
        """Rows of the runs that hold all batches before one, not merged with each other."""
        live, level, left = [], 0, batch
        while left:
            live += [self._at(level, left - 1 - back) for back in range(left % self.fan)]
            level, left = level + 1, left // self.fan
        return self._read(spark, live)

    def write(self, batch: int, changes: DataFrame) -> None:
        """Writes what a batch changes, and merges the levels that it fills."""
        spark, level, number = changes.sparkSession, 0, batch
        changes.select(*self.schema.names).write.mode("overwrite").parquet(self._at(0, batch))
        while (number + 1) % self.fan == 0:
            full = self._read(spark, [self._at(level, number - back) for back in range(self.fan)])
            level, number = level + 1, number // self.fan
            self.merge(full).select(*self.schema.names).write.mode("overwrite").parquet(self._at(level, number))

    def everything(self, spark: SparkSession) -> DataFrame:
        """Rows of all runs, merged ones included: for merges that may see a row twice."""
        return spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(self.folder)
