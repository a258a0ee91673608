"""How far hot groups are spread."""

from pyspark.sql import DataFrame


def salts_for(df: DataFrame) -> int:
    """As many salts as the session has shuffle partitions: a hot group can then use them all."""
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
