"""Recent conversations as JSON, one object per line."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from engram.schemas import MESSAGES, STR

ENTRY = T.StructType(
    [
        T.StructField("conversation_id", STR),
        T.StructField("user_id", STR),
        T.StructField("summary", STR),
        T.StructField("messages", MESSAGES),
        T.StructField("timestamp", STR),
    ]
)
CORRUPT = "_corrupt_record"


def write_recent_entries(entries: DataFrame, path: str) -> None:
    """One JSON object per line; the folder is replaced."""
    entries.select(*[F.col(f.name).cast(f.dataType) for f in ENTRY.fields]).write.mode("overwrite").json(path)


def read_recent_entries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entries, corrupt lines); a missing folder gives two empty frames."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        lines = spark.createDataFrame([], "value string")
    schema = T.StructType(ENTRY.fields + [T.StructField(CORRUPT, STR)])
    parsed = lines.select(F.from_json("value", schema, {"columnNameOfCorruptRecord": CORRUPT}).alias("e"))
    broken = F.col(f"e.{CORRUPT}")
    good = parsed.where(broken.isNull()).select(*[f"e.{name}" for name in ENTRY.fieldNames()])
    return good, parsed.where(broken.isNotNull()).select(broken.alias(CORRUPT))
