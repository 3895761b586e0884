"""Shape validation: violations of required properties, datatypes and classes as rows."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structgraph.model import RDF_TYPE, VOCAB, XSD

#: Required properties with their datatypes, by class; fixed values of the shapes.
REQUIRED = [
    ("Module", [("name", "string"), ("filePath", "string")]),
    ("Function", [("name", "string"), ("startLine", "integer"), ("endLine", "integer")]),
    ("Method", [("name", "string"), ("startLine", "integer"), ("endLine", "integer")]),
    ("Class", [("name", "string"), ("startLine", "integer"), ("endLine", "integer")]),
    ("Parameter", [("name", "string")]),
]
#: Classes that subjects or objects of a property must have (any of several).
SUBJECTS = [("filePath", ["Module"]), ("inheritsFrom", ["Class"]), ("hasParameter", ["Function", "Method"])]
OBJECTS = [("hasParameter", ["Parameter"])]


def violations(quads: DataFrame) -> DataFrame:
    """(shape, focus, path, message) of every violation, each once; a valid graph has none. Without inference: a Method is no
    Function, except that resolvedCalls accept both.

    Plan: everything that concerns a subject is decided in one aggregation by subject (its types, and of each property whether
    it is there and whether a value has the wrong datatype), combined before the one shuffle. Only the two rules about objects
    join objects with the types that subjects have.
    """
    q = quads.select("s", "p", "o", "o_kind", "o_dt")
    props = sorted({p for _, ps in REQUIRED for p, _ in ps} | {p for p, _ in SUBJECTS})
    datatype = {p: dt for _, ps in REQUIRED for p, dt in ps}
    is_ = lambda p: F.col("p") == VOCAB + p
    wrong = lambda p: is_(p) & ((F.col("o_kind") != "lit") | (F.coalesce("o_dt", F.lit("")) != XSD + datatype[p]))
    kinds = F.collect_set(F.when((F.col("p") == RDF_TYPE) & F.col("o").startswith(VOCAB), F.substring(F.col("o"), len(VOCAB) + 1, 1 << 16)))
    facts = q.groupBy("s").agg(
        kinds.alias("kinds"), *[F.max(F.coalesce(is_(p), F.lit(False))).alias(f"has_{p}") for p in props], *[F.max(F.coalesce(wrong(p), F.lit(False))).alias(f"bad_{p}") for p in datatype]
    )

    def row(test: Column, shape: str, path: str, message: str) -> Column:
        return F.when(test, F.struct(F.lit(shape).alias("shape"), F.lit(path).alias("path"), F.lit(message).alias("message")))

    of = lambda names: reduce(lambda a, b: a | b, [F.array_contains("kinds", n) for n in names])
    rules = []
    for kind, ps in REQUIRED:
        for p, dt in ps:
            rules.append(row(of([kind]) & ~F.col(f"has_{p}"), f"{kind}Shape", p, f"{kind} needs {p}"))
            rules.append(row(of([kind]) & F.col(f"bad_{p}"), f"{kind}Shape", p, f"{p} of {kind} must be {dt}"))
    for p, names in SUBJECTS:
        rules.append(row(F.col(f"has_{p}") & ~of(names), f"{p}DomainShape", p, f"only {' or '.join(names)} may have {p}"))
    own = facts.select("s", F.explode(F.array_compact(F.array(*rules))).alias("v")).select("v.shape", F.col("s").alias("focus"), "v.path", "v.message")

    typed = facts.select(F.col("s").alias("o"), "kinds")
    edges = q.where(is_("resolvedCalls") | reduce(lambda a, b: a | b, [is_(p) for p, _ in OBJECTS])).select("s", "p", "o", "o_kind").distinct()
    ends = edges.join(typed, "o", "left").withColumn("kinds", F.coalesce("kinds", F.array().cast("array<string>")))
    call = is_("resolvedCalls")
    tests = [row(call & (F.col("o_kind") != "iri"), "ResolvedCallsShape", "resolvedCalls", "resolvedCalls must link to an IRI"), row(call & (F.col("o_kind") == "iri") & ~of(["Function", "Method"]), "ResolvedCallsShape", "resolvedCalls", "resolvedCalls must link to a Function")]
    tests += [row(is_(p) & ~of(names), f"{p}RangeShape", p, f"objects of {p} must be {' or '.join(names)}") for p, names in OBJECTS]
    focus = F.when(call, F.col("s")).otherwise(F.col("o"))
    far = ends.select(focus.alias("focus"), F.explode(F.array_compact(F.array(*tests))).alias("v")).select("v.shape", "focus", "v.path", "v.message").distinct()
    return own.unionByName(far)


def validate(quads: DataFrame, raise_on_violation: bool = False) -> tuple[bool, DataFrame]:
    """Whether a graph conforms, and the violations; on demand an error if it does not."""
    found = violations(quads)
    conforms = found.isEmpty()
    if raise_on_violation and not conforms:
        raise ValueError("the graph violates its shapes:\n" + "\n".join(f"{r['shape']}: {r['focus']}: {r['message']}" for r in found.limit(20).collect()))
    return conforms, found
