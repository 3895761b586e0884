"""Frequency of every distinct value or term, in occurrences and in records (problem 2)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structgraph.functions.text import non_blank, strip


def occurrences(df: DataFrame, field: str, term: Column, record: Column, row_id: Column) -> DataFrame:
    """One row (field, term, record, row_id) per usable value of ``df``; null and blank terms and null records fall away."""
    return df.select(F.lit(field).alias("field"), term.alias("term"), record.alias("record"), row_id.cast("string").alias("row_id")).where(
        F.col("term").isNotNull() & F.col("record").isNotNull()
    )


def code_terms(calls: DataFrame, imports: DataFrame, decorators: DataFrame) -> DataFrame:
    """Occurrences of call targets, imported names and decorators. Surrounding white space is cut, of decorators also leading ``@``.

    A repeated row (same key) counts once: row_id names the row, and decorators have (uri, seen_at) for it.
    """
    deco = F.nullif(strip(F.regexp_replace(strip(F.col("decorator")), r"^@+", "")), F.lit(""))
    return (
        occurrences(calls, "call", non_blank(F.col("target")), F.col("caller"), F.col("call_id"))
        .unionByName(occurrences(imports, "import", non_blank(F.col("imported")), F.col("module"), F.col("import_id")))
        .unionByName(occurrences(decorators, "decorator", deco, F.col("uri"), F.col("seen_at")))
    )


def term_frequencies(terms: DataFrame, min_records: int = 2, max_share: float = 0.05) -> DataFrame:
    """Occurrences and records of every (field, term), with a mark.

    ``terms`` has field, term, record and row_id (rows of one record and term with the same row_id are repeats). The result has
    one row (field, term, occurrences, records, mark) per term: mark is 'rare' below ``min_records`` records, 'common' above
    ``max_share`` of the field's records, else 'useful'. An empty input gives an empty result.

    Plan: hash-partial counts per (field, record, term, row) collapse on the map side, the first shuffle is by that whole
    tuple and so cannot be hot; per-term sums are again combined before their shuffle. A term that a third of all records
    hold costs each mapper one row. The record totals, one row per field, are counted on distinct (field, record) pairs straight from
    ``terms``: a second scan of four columns, but pairs combine before their shuffle to a fraction of the per-record counts, which
    would have to be shuffled again.
    """
    per_record = terms.groupBy("field", "record", "term").agg(F.count_distinct("row_id").alias("n"))
    per_term = per_record.groupBy("field", "term").agg(F.sum("n").cast("bigint").alias("occurrences"), F.count("*").alias("records"))
    totals = terms.select("field", "record").distinct().groupBy("field").agg(F.count("*").alias("total"))
    # totals has one row per field, a number fixed by the caller's union, so the broadcast does not grow with the data
    return per_term.join(F.broadcast(totals), "field").select(
        "field",
        "term",
        "occurrences",
        "records",
        F.when(F.col("records") < min_records, "rare").when(F.col("records") > F.col("total") * max_share, "common").otherwise("useful").alias("mark"),
    )
