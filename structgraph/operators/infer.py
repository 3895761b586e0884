"""Derived types: the part of RDFS that the vocabulary needs, to a fixpoint."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structgraph.model import INFERRED, RDF_TYPE, VOCAB

#: Axioms of the vocabulary: subclasses, domains and object ranges; fixed values.
SUBCLASS = [("Method", "Function")]
DOMAIN = [("filePath", "Module"), ("resolvedCalls", "Function"), ("inheritsFrom", "Class"), ("imports", "Module"), ("hasParameter", "Function")]
RANGE = [("resolvedCalls", "Function"), ("inheritsFrom", "Class"), ("hasParameter", "Parameter")]


def _pairs(df: DataFrame, pairs: list[tuple[str, str]], a: str, b: str) -> DataFrame:
    return df.sparkSession.createDataFrame([(VOCAB + x, VOCAB + y) for x, y in pairs], f"{a} string, {b} string")


def superclasses(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Transitive closure of a list of subclass axioms."""
    done = set(pairs)
    while True:
        more = {(a, d) for a, b in done for c, d in done if b == c and a != d} - done
        if not more:
            return sorted(done)
        done |= more


def infer_types(quads: DataFrame, subclass: list[tuple[str, str]] = SUBCLASS, domain: list[tuple[str, str]] = DOMAIN, range_: list[tuple[str, str]] = RANGE) -> DataFrame:
    """Types that follow from the axioms and are not stated: quads of the inferred graph.

    Domains type subjects, ranges type objects that are no literals, and subclasses lift types. The axioms are closed on the
    driver first (they are schema, not data), so one pass over the data reaches the fixpoint: a type that a rule adds is lifted
    by the closed subclass list at once.
    """
    up = superclasses(subclass)
    stated = quads.where(F.col("p") == RDF_TYPE).select("s", "o").distinct()
    by_domain = quads.join(F.broadcast(_pairs(quads, domain, "p", "t")), "p").select("s", F.col("t").alias("o"))
    by_range = quads.where("o_kind <> 'lit'").join(F.broadcast(_pairs(quads, range_, "p", "t")), "p").select(F.col("o").alias("s"), F.col("t").alias("o"))
    base = stated.unionByName(by_domain).unionByName(by_range).distinct()
    lifted = base.join(F.broadcast(_pairs(quads, up or [("", "")], "o", "t")), "o").select("s", F.col("t").alias("o"))
    new = base.unionByName(lifted).distinct().join(stated, ["s", "o"], "left_anti")
    none = F.lit(None).cast("string")
    return new.select(F.lit(INFERRED).alias("g"), "s", F.lit(RDF_TYPE).alias("p"), "o", F.lit("iri").alias("o_kind"), none.alias("o_dt"), none.alias("o_lang"))
