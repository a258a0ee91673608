"""Reading tables, filling defaults, upserts and snapshots."""

from collections.abc import Mapping, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions.values import ntz
from engram.schemas import DEFAULTS, SCHEMAS


def read_table(spark: SparkSession, name: str, path: str, file_format: str = "parquet") -> DataFrame:
    """Rows of a known table with its declared schema; nothing is inferred."""
    return spark.read.format(file_format).schema(SCHEMAS[name]).load(path)


def read_jdbc_table(
    spark: SparkSession,
    name: str,
    url: str,
    partition_column: str,
    lower: str,
    upper: str,
    partitions: int,
    properties: Mapping[str, str] | None = None,
) -> DataFrame:
    """The same table out of a relational database, read in parallel ranges."""
    return spark.read.jdbc(
        url,
        name,
        column=partition_column,
        lowerBound=lower,
        upperBound=upper,
        numPartitions=partitions,
        properties=dict(properties or {}),
    ).select(*[F.col(f.name) for f in SCHEMAS[name].fields])


def _default(value, kind, as_of: datetime) -> Column:
    if value == "now":
        return ntz(as_of)
    if value == {}:
        return F.map_from_arrays(F.array(), F.array()).cast(kind)
    return F.lit(value).cast(kind)


def with_defaults(df: DataFrame, table: str, as_of: datetime) -> DataFrame:
    """All columns of the table in order: given, else its default, else null."""
    defaults = DEFAULTS.get(table, {})
    columns = []
    for field in SCHEMAS[table].fields:
        given = F.col(field.name).cast(field.dataType) if field.name in df.columns else None
        default = _default(defaults[field.name], field.dataType, as_of) if field.name in defaults else None
        if given is None and default is None:
            value = F.lit(None).cast(field.dataType)
        elif given is None or default is None:
            value = default if given is None else given
        else:
            value = F.coalesce(given, default)
        columns.append(value.alias(field.name))
    return df.select(*columns)


def apply_defaults(df: DataFrame, table: str, as_of: datetime) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): rows with defaults filled, and rows missing a required value."""
    filled = with_defaults(df, table, as_of)
    missing = [f.name for f in SCHEMAS[table].fields if not f.nullable]
    broken = F.lit(False)
    for name in missing:
        broken = broken | F.col(name).isNull()
    return filled.where(~broken), filled.where(broken)


def split_by_dimension(df: DataFrame, vector: str, dimension: int) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by vector size; a null vector is accepted."""
    fits = F.col(vector).isNull() | (F.size(vector) == dimension)
    return df.where(fits), df.where(~fits)


def latest_changes(changes: DataFrame, key: str, order: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(one whole row per key, rejected rows).

    With ``order`` the row with the greatest values of these columns counts, of
    equally late ones the greatest as JSON, and the others are not rejects.
    Without it nothing says which of several rows came last: all rows of a
    repeated key are rejected. Rows without key are rejects.
    """
    rest = [c for c in changes.columns if c != key]
    row = F.struct(*rest)
    latest = F.any_value(row) if order is None else F.max_by(row, F.struct(*order, F.to_json(row)))
    grouped = changes.where(F.col(key).isNotNull()).groupBy(key).agg(latest.alias("_row"), F.count(F.lit(1)).alias("_n"))
    single = grouped if order is not None else grouped.where("_n = 1")
    accepted = single.select(*[F.col(key) if c == key else F.col(f"_row.{c}").alias(c) for c in changes.columns])
    broken = changes.where(F.col(key).isNull())
    if order is None:
        broken = broken.unionByName(changes.join(grouped.where("_n > 1").select(key), key, "left_semi").select(*changes.columns))
    return accepted, broken


def upsert(
    base: DataFrame,
    changes: DataFrame,
    key: str,
    as_of: datetime,
    stamp: str | None = "updated_at",
    order: Sequence[str] | None = None,
) -> DataFrame:
    """Base with changed rows replaced and new rows added.

    A null in a changed row leaves the old value. Of several changed rows of a
    key the latest by ``order`` counts as a whole; without an order such keys
    are left as they were (``latest_changes`` gives the rejects). ``stamp`` is
    set to ``as_of`` on rows that were there before and matched; new rows keep
    their own value.
    """
    changes, _ = latest_changes(changes, key, order)
    b, c = base.alias("b"), changes.alias("c")
    old, new = F.col(f"b.{key}").isNotNull(), F.col(f"c.{key}").isNotNull()
    columns = []
    for name in base.columns:
        if name == stamp:
            given = F.col(f"c.{name}") if name in changes.columns else F.lit(None)
            value = F.when(old & new, ntz(as_of)).otherwise(F.coalesce(F.col(f"b.{name}"), given))
        elif name in changes.columns:
            value = F.coalesce(F.col(f"c.{name}"), F.col(f"b.{name}"))
        else:
            value = F.col(f"b.{name}")
        columns.append(value.alias(name))
    return b.join(c, F.col(f"b.{key}") == F.col(f"c.{key}"), "full_outer").select(*columns)


def snapshot_tables(tables: Mapping[str, DataFrame], path: str, run_id: str) -> None:
    """One parquet folder per table under ``path/run_id``; an existing run is an error."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{run_id}/{name}")


def read_snapshot(spark: SparkSession, path: str, run_id: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{run_id}/{name}")


def table_stats(tables: Mapping[str, DataFrame], with_bytes: bool = False) -> DataFrame:
    """Row count per table; for tables read from files also the size of those files."""
    parts = []
    for name, df in tables.items():
        if with_bytes:
            per_file = df.groupBy("_metadata.file_path", "_metadata.file_size").agg(
                F.count(F.lit(1)).alias("n")
            )
            size = F.coalesce(F.sum("file_size"), F.lit(0)).cast("bigint")
            counted = per_file.agg(
                F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
                size.alias("size_bytes"),
                (size / (1024 * 1024)).alias("size_mb"),
            )
        else:
            counted = df.agg(F.count(F.lit(1)).alias("n_rows"))
        parts.append(counted.select(F.lit(name).alias("table_name"), "*"))
    return reduce(DataFrame.unionByName, parts)
