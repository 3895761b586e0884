"""Joins that hold when one key has a third of all rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that one reducer may have, at least, before the key is split.
HOT_ROWS = 100_000
#: Pieces of a key at most: that many times the other side of a join is repeated.
MOST_SALTS = 256


def salts_for(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> int:
    """Pieces in which the most frequent key of ``df`` is to be cut so that none is above ``hot_rows``, or above an even share of the
    reducers if that is more; 1 where no key is hot. One aggregation, combined before its shuffle; one number comes to the driver."""
    return salts_of(df.groupBy(*keys).count(), hot_rows)


def salts_of(counted: DataFrame, hot_rows: int = HOT_ROWS) -> int:
    """:func:`salts_for` where the rows of each key are counted already, in ``count``."""
    top = counted.agg(F.max("count").alias("most"), F.sum("count").alias("rows")).first()
    if not top["most"]:
        return 1
    share = max(hot_rows, top["rows"] // int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return min(MOST_SALTS, -(-top["most"] // share))


def salted_lookup(left: DataFrame, right: DataFrame, keys: list[str], salts: int | None = None, how: str = "left") -> DataFrame:
    """Join rows of ``left`` to a ``right`` that has at most one row per key. ``salts`` are counted from ``left`` where none are given.

    Every key is spread over ``salts`` reducers: left rows take a salt from a hash of the row, so a recomputed task sends them
    to the same reducer again; right rows are repeated once per salt. The right side must be the small one, such as one row per distinct key; a key that holds a third of ``left`` then
    loads a reducer with a third divided by ``salts``. Rows with a null key find nothing; ``left`` keeps them.
    """
    if salts is None:
        salts = salts_for(left, keys)
    if salts == 1:
        return left.join(right, keys, how)
    salt = "_salt"
    while salt in left.columns or salt in right.columns:
        salt += "_"
    salted = left.withColumn(salt, F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    spread = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(spread, [*keys, salt], how).drop(salt)
