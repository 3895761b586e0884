"""Search by name: substring and approximate."""

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structgraph.model import CodeGraph


def search_by_name(g: CodeGraph, pattern: str, limit: int = 50) -> DataFrame:
    """Entities whose name contains ``pattern`` in any case, the first ``limit`` by name: a top-k, so no global sort."""
    return g.entities.where(F.lower("name").contains(pattern.lower())).select("uri", "name", "kind").orderBy("name", "uri").limit(limit)


def fuzzy_search(g: CodeGraph, pattern: str, threshold: float = 0.5, limit: int = 20) -> DataFrame:
    """Entities by similarity of names: the share of matching blocks, plus 1 where the name contains the pattern; those at or above
    ``threshold``, the best ``limit``.

    Scores are computed once per distinct name, in Arrow batches, and only for names that can reach the threshold: no more letters can
    match than name and pattern have in common, counted letter by letter in the JVM.
    """
    low = pattern.lower()
    name = F.lower("name")
    shared = F.lit(0)
    for c in sorted(set(low)):
        shared = shared + F.least(F.length(name) - F.length(F.replace(name, F.lit(c), F.lit(""))), F.lit(low.count(c)))
    # lower case may change the length of a text; the bound is that of the text that is compared
    bound = F.when(F.length(name) + len(low) > 0, 2.0 * shared / (F.length(name) + len(low))).otherwise(1.0)
    hopeful = F.contains(name, F.lit(low)) | (bound >= threshold - 1e-9)

    @F.pandas_udf("double")
    def ratio(names: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, low, n.lower()).ratio() + (1.0 if low in n.lower() else 0.0) for n in names], dtype="float64")

    scored = g.entities.where("name IS NOT NULL").select("name").distinct().where(hopeful).withColumn("raw", ratio("name")).where(F.col("raw") >= threshold)
    hits = g.entities.select("uri", "name", "kind", "file").join(scored, "name")
    return hits.select("uri", "name", "kind", "file", F.round("raw", 3).alias("score")).orderBy(F.desc("score"), "name", "uri").limit(limit)


def suggest(g: CodeGraph, name: str) -> DataFrame:
    """Suggestions for a name that was not found: up to five similar names with their files in one text."""
    near = fuzzy_search(g, name, threshold=0.4, limit=5)
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("k"), "name", "file"))), lambda x: F.concat(x["name"], F.lit(" ("), x["file"], F.lit(")"))), ", ")
    return near.agg(F.when(F.count("*") > 0, F.concat(F.lit("Did you mean: "), listed)).otherwise("No similar entities").alias("suggestion"))
