"""Every registered query: its name, the Spark job and the equivalent SQL."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.plans.sql_views import with_views

Job = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Job] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, reads: list[str] | None = None) -> Callable[[Job], Job]:
    """Register a job under a name; ``reads`` are the SQL views its SQL needs."""

    def add(job: Job) -> Job:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = job
        if sql is not None:
            SQL[name] = with_views(reads or [], sql)
        return job

    return add


def r6(value) -> Column:
    """Rounded to six places, without a negative zero."""
    return F.round(value, 6) + F.lit(0.0)


def stamp(ts):
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def sql_stamp(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"
