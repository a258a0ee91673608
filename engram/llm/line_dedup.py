"""Line dedup: levelled sorted runs of line hashes; a new batch is merge-anti-joined with the runs and adds its own."""

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.common import OTHER_SPACE
from engram.sources.shared import shared_folder

MIN_CHARS = 10
BATCHES = 4
# A key of more than one in so many lines of a batch is hot; there are fewer of them than this.
HOT_KEYS = 1024
HASHES = ("h1", "h2")


@contextmanager
def sorted_scans(spark: SparkSession):
    """Scans of bucketed tables with one file a bucket keep the files' order, so that merge joins need no sort."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


class LineRuns:
    """Runs of (h1, h2, owner), each a table bucketed and sorted by the hash; no hash stands in two runs.

    Two runs of one level are merged into one of the next, so that after b
    batches there are log2(b) + 1 runs at most and each hash has been written
    as often. Runs are joined bucket by bucket: no exchange and no sort.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = shared_folder(spark, "line-runs")
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[str | None] = []
        self.tables: list[str] = []

    def write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        writer = rows.write.bucketBy(self.buckets, *HASHES).sortBy(*HASHES)
        writer.option("path", f"{self.folder}/{name}").saveAsTable(name)
        self.tables.append(name)
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for name in self.levels if name]

    def add(self, batch: str) -> str:
        """Those hashes of a sorted batch that no run has, as a run of their own; returns its table."""
        new = self.spark.table(batch).select(*HASHES, "owner")
        runs = self.runs()
        for run in runs:
            new = new.join(run.select(*HASHES).hint("merge"), list(HASHES), "left_anti")
        own = self.write(new) if runs else batch
        carried, level = own, 0
        while level < len(self.levels) and self.levels[level]:
            carried = self.merged(self.levels[level], carried)
            self.levels[level] = None
            level += 1
        self.levels += [None] * (level + 1 - len(self.levels))
        self.levels[level] = carried
        return own

    def merged(self, left: str, right: str) -> str:
        a, b = (self.spark.table(t).select(*HASHES, "owner") for t in (left, right))
        both = a.join(b.withColumnRenamed("owner", "other").hint("merge"), list(HASHES), "full_outer")
        return self.write(both.select(*HASHES, F.coalesce("owner", "other").alias("owner")))

    def close(self) -> None:
        """Takes the names out of the session's catalog; the files stay in the shared folder."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def line_key(line: Column) -> Column:
    """The line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(" " + OTHER_SPACE)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def batch_of(owner: Column, bounds: list) -> Column:
    """The batch of an id by ascending bounds; rows without id come last."""
    number = F.lit(0)
    for bound in bounds:
        number = number + (owner > bound).cast("int")
    return F.coalesce(number, F.lit(len(bounds)))


def dropped_lines(lines: DataFrame, new: DataFrame, keys: DataFrame) -> DataFrame:
    """Lines of a batch that the batch's own run does not grant to their document.

    An owner is the least id of its batch that has the key, so ``id <= owner``
    holds for the owner alone. Lines of hot keys meet a broadcast table of
    fewer than HOT_KEYS rows and are not moved.
    """
    total = keys.agg(F.sum("n")).first()[0] or 0
    granted = new.select(*HASHES, "owner", F.lit(True).alias("granted"))
    hot = keys.where(F.col("n") * HOT_KEYS > total).select(*HASHES)
    own = (F.col("id") <= F.col("owner")) | F.col("owner").isNull()
    known = F.broadcast(hot.join(granted, list(HASHES), "left"))
    of_hot = lines.join(known, list(HASHES)).where(F.col("granted").isNull() | ~F.coalesce(own, F.lit(False)))
    cold = lines.join(F.broadcast(hot), list(HASHES), "left_anti").alias("l")
    run = granted.alias("r").hint("merge")
    same = (F.col("l.h1") == F.col("r.h1")) & (F.col("l.h2") == F.col("r.h2"))
    of_cold = cold.join(run, same & own, "left_anti")
    place = ["id", "text_hash", "pos"]
    return of_cold.select(*place).unionByName(of_hot.select(*place))


def dedup_lines(
    df: DataFrame, key: str = "doc_id", text: str = "text", batches: int = BATCHES, min_chars: int = MIN_CHARS
) -> DataFrame:
    """key, n_lines, n_dropped and kept_text of each row: lines found in several documents stay in the first alone.

    A whole text is split at ``\\n``; null and empty texts are one empty line.
    Lines whose key (``line_key``) has at least ``min_chars`` code points and
    stands in at least two documents are dropped except in the least ``key``
    that has it, where all of them stay. Rows of one ``key`` are one document,
    each given back on its own; rows without key are one document that comes
    last. ``key`` is a number. Other columns are not looked at; an empty table
    gives no rows.

    Documents are taken in ``batches`` by ascending key. Each batch's keys are
    written as one sorted run, anti-joined with the runs so far and added to
    them; what the own run does not grant is dropped. Keys are told apart by
    128 bits. Lines carry a hash of their text besides the id, so that the
    positions dropped find their row again where ids repeat.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    rows = rows.withColumn("text_hash", F.xxhash64("body"))
    quantiles = [k / batches for k in range(1, batches)]
    found = rows.agg(F.percentile_approx("id", quantiles, 10_000)).first()[0] if quantiles else None
    bounds = sorted(set(found or []))

    split = rows.select("id", "text_hash", F.posexplode(F.split("body", "\n")).alias("pos", "line"))
    keyed = split.select("id", "text_hash", "pos", line_key(F.col("line")).alias("line")).where(F.length("line") >= min_chars)
    hashed = keyed.select(
        F.xxhash64(F.lit(1), "line").alias("h1"), F.xxhash64(F.lit(2), "line").alias("h2"), "id", "text_hash", "pos",
        batch_of(F.col("id"), bounds).alias("batch"),
    )
    path, gone = shared_folder(spark, "lines"), shared_folder(spark, "dropped-lines")
    hashed.write.partitionBy("batch").parquet(path)
    stored = spark.read.schema(hashed.schema).parquet(path)

    runs = LineRuns(spark)
    with sorted_scans(spark):
        for number in range(len(bounds) + 1):
            lines = stored.where(F.col("batch") == number).drop("batch")
            counted = lines.groupBy(*HASHES).agg(F.min("id").alias("owner"), F.count("*").alias("n"))
            batch = runs.write(counted)
            own = runs.add(batch)
            dropped_lines(lines, spark.table(own), spark.table(batch)).write.mode("append").parquet(gone)
    runs.close()

    dropped = spark.read.schema(f"id {kind}, text_hash long, pos int").parquet(gone)
    places = dropped.groupBy("id", "text_hash").agg(F.collect_set("pos").alias("places")).alias("d").hint("shuffle_hash")
    same = F.col("t.id").eqNullSafe(F.col("d.id")) & (F.col("t.text_hash") == F.col("d.text_hash"))
    met = rows.alias("t").join(places, same, "left").select("t.id", "body", "places")
    listed = F.split("body", "\n")
    with_lines = met.select("id", "body", "places", listed.alias("lines"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "places")
    kept = F.array_join(F.transform(left, lambda i: F.get(F.col("lines"), i)), "\n")
    return with_lines.select(
        F.col("id").alias(key),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("places").isNull(), F.col("body")).otherwise(kept).alias("kept_text"),
    )
