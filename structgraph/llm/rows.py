"""Row helpers of the text operators."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_by(df: DataFrame, key: str) -> DataFrame:
    """``df`` with one row per ``key``, where rows of one key are exact repeats.

    Texts are not shuffled to find repeats: when no key comes twice
    (one cheap pass over the key column tells) the rows are passed on as they are.
    """
    repeated = df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").limit(1)
    return df if repeated.isEmpty() else df.dropDuplicates([key])
