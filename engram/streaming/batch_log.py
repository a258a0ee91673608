"""Append-only tables of micro-batch results, one folder per batch id, and logs of them kept in tiers.

Writing a batch again replaces its folder, so a replayed batch counts once.
"""

import re
from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FAN = 8


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_batches(
    spark: SparkSession, path: str, schema: T.StructType | str, before: int | None = None
) -> DataFrame:
    """Rows of all batches, or of those before a batch id; a log not yet written is empty."""
    whole = with_batch(schema)
    try:
        rows = spark.read.schema(whole).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], whole)
    return rows if before is None else rows.where(F.col("batch_id") < before)


def with_batch(schema: T.StructType | str) -> T.StructType:
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return T.StructType(fields.fields + [T.StructField("batch_id", T.LongType())])


class TieredLog:
    """A log whose finished batches are folded into runs of ``fan``, ``fan ** 2``, ... batches.

    A run of tier t covers the batches from ``i * fan ** t`` on; it is written
    once all of them are followed by a later batch, for then none of them can
    be replayed. A reader takes the widest finished run at each point, so it
    opens about ``fan * log(batches)`` folders however long the stream has run,
    and at most ``fan`` batches are read one by one. A run counts only when its
    write has been committed, and writing it again gives the same rows, so a
    job lost in between starts over.

    ``fold`` maps rows (``schema`` and batch_id) to fewer rows of the same
    columns, such that folding parts first changes nothing. Folders that a
    finished run covers stay until ``retire`` removes them.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, fold: Callable[[DataFrame], DataFrame], fan: int = FAN):
        self.spark, self.path, self.fold, self.fan = spark, path.rstrip("/"), fold, fan
        self.schema = with_batch(schema)

    def name(self, tier: int, first: int) -> str:
        return f"tier-{tier}-from-{first:012d}"

    def finished(self) -> dict[tuple[int, int], str]:
        """(tier, first batch) of every committed folder; tier 0 are single batches."""
        pattern = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/tier-*/_SUCCESS")
        files = pattern.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        found = {}
        for status in files.globStatus(pattern) or []:
            folder = status.getPath().toString().removesuffix("/_SUCCESS")
            match = re.fullmatch(r"tier-(\d+)-from-(\d+)", folder.rsplit("/", 1)[1])
            if match:
                found[int(match[1]), int(match[2])] = folder
        return found

    def cover(self, before: int | None = None, found: dict | None = None) -> Iterator[tuple[int, int]]:
        """The widest finished folders, one after the other, with all batches before ``before``."""
        found = self.finished() if found is None else found
        firsts = sorted({first for _, first in found})
        done = -1
        for first in firsts:
            if first <= done:
                continue
            fitting = [t for t, f in found if f == first and (before is None or first + self.fan**t <= before)]
            if fitting:
                tier = max(fitting)
                done = first + self.fan**tier - 1
                yield tier, first

    def read(self, before: int | None = None) -> DataFrame:
        found = self.finished()
        paths = [found[key] for key in self.cover(before, found)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def totals(self, before: int | None = None) -> DataFrame:
        return self.fold(self.read(before)).drop("batch_id")

    def write(self, df: DataFrame, batch_id: int) -> None:
        """A batch as its own folder; runs that it completes are folded before."""
        self.compact(batch_id)
        rows = df.withColumn("batch_id", F.lit(batch_id).cast("bigint")).select(*self.schema.fieldNames())
        rows.write.mode("overwrite").parquet(f"{self.path}/{self.name(0, batch_id)}")

    def compact(self, before: int) -> None:
        """Writes the runs, narrow ones first, that end with the batch ``before - 1``."""
        tier, width = 1, self.fan
        while before and before % width == 0:
            found = self.finished()
            first = before - width
            if (tier, first) not in found:
                parts = [p for (t, f), p in found.items() if t == tier - 1 and first <= f < before]
                rows = self.spark.read.schema(self.schema).parquet(*parts) if parts else self.spark.createDataFrame([], self.schema)
                self.fold(rows).select(*self.schema.fieldNames()).write.mode("overwrite").parquet(f"{self.path}/{self.name(tier, first)}")
            tier, width = tier + 1, width * self.fan

    def retire(self) -> int:
        """Removes folders that a finished wider run covers; for a time when no reader holds an older listing."""
        found = self.finished()
        jvm = self.spark._jvm
        covered = [
            path for (t, f), path in found.items()
            if any(t2 > t and f2 <= f and f + self.fan**t <= f2 + self.fan**t2 for t2, f2 in found)
        ]
        for path in covered:
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
        return len(covered)
