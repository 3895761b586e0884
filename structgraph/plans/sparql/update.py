"""SPARQL updates: each gives a new quad table."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from structgraph.model import QUADS, XSD
from structgraph.operators.store import load_quads
from structgraph.plans.lineage import cut
from structgraph.plans.sparql.compile import Compiler, Rel, instantiate
from structgraph.plans.sparql.parser import Iri, Parser, Var

#: Graph of triples that an update names no graph for.
DEFAULT_GRAPH = ""


def _ground(c: Compiler, template: list[tuple], graph: str) -> DataFrame:
    if any(isinstance(t, Var) for q in template for t in q if t is not None):
        raise ValueError("DATA blocks have no variables")
    rows = [(g.value if g else graph, s.value, p.value, o.value, "iri" if isinstance(o, Iri) else "lit", getattr(o, "dt", None), getattr(o, "lang", None)) for g, s, p, o in template]
    return c.spark.createDataFrame(rows, QUADS)


def _without(quads: DataFrame, gone: DataFrame, any_graph: bool) -> DataFrame:
    """``quads`` without those of ``gone``; where no graph was named, from all graphs (the default graph is their union)."""
    keys = ["s", "p", "o", "o_kind"] + ([] if any_graph else ["g"])
    return quads.join(gone.select(keys).distinct(), keys, "left_anti").select(quads.columns)


_TERM = r"(<[^>]*>|_:[^\s]+)"
_TRIPLE = rf'^\s*{_TERM}\s*(<[^>]*>)\s*(?:{_TERM}|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?)\s*\.\s*(?:#.*)?$'
#: Escapes of a literal with what they stand for; a backslash itself comes last.
_ESCAPES = (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ('\\"', '"'))


def triples_of_file(spark: SparkSession, source: str, graph: str) -> DataFrame:
    """Quads of N-Triples files (a path or url that Spark can read), all in one graph; a line that is neither triple, comment nor
    blank is an error. Read and parsed by line, in parallel."""
    lines = spark.read.text(source).where("trim(value) <> '' AND NOT trim(value) LIKE '#%'")
    part = lambda i: F.regexp_extract("value", _TRIPLE, i)
    bare = lambda c: F.when(c.startswith("<"), F.regexp_replace(c, "^<|>$", "")).otherwise(c)
    iri, lang, kind = part(3), F.nullif(part(5), F.lit("")), F.nullif(part(6), F.lit(""))
    text = F.replace(part(4), F.lit("\\\\"), F.lit("\x00"))
    for a, b in _ESCAPES:
        text = F.replace(text, F.lit(a), F.lit(b))
    for width in (4, 8):
        # the pieces behind each code point escape begin with its digits
        mark = "\\u" if width == 4 else "\\U"
        pieces = F.split(text, "\\" + mark)
        text = F.when(
            F.contains(text, F.lit(mark)),
            F.concat(F.element_at(pieces, 1), F.array_join(F.transform(F.slice(pieces, 2, F.size(pieces)), lambda x: F.concat(_character(F.substring(x, 1, width)), F.substring(x, width + 1, 1 << 30))), "")),
        ).otherwise(text)
    text = F.replace(text, F.lit("\x00"), F.lit("\\"))
    ok = F.when(F.col("value").rlike(_TRIPLE), True).otherwise(F.raise_error(F.concat(F.lit("no triple: "), "value")).cast("boolean"))
    return lines.where(ok).select(
        F.lit(graph).alias("g"), bare(part(1)).alias("s"), bare(part(2)).alias("p"), F.when(iri != "", bare(iri)).otherwise(text).alias("o"),
        F.when(iri.startswith("_:"), "bnode").when(iri != "", "iri").otherwise("lit").alias("o_kind"),
        F.when((iri == "") & lang.isNull(), F.coalesce(kind, F.lit(XSD + "string"))).alias("o_dt"), lang.alias("o_lang"),
    ).select(QUADS.names)


def _character(digits: Column) -> Column:
    """The character of a code point in hexadecimal digits, through its UTF-32 bytes."""
    return F.decode(F.unhex(F.lpad(digits, 8, "0")), "utf-32")


def update(quads: DataFrame, text: str) -> DataFrame:
    """The quad table after a sequence of updates: INSERT and DELETE in all forms, CLEAR, DROP, CREATE, COPY, MOVE, ADD and LOAD of N-Triples.

    WHERE is answered over the table before its own operation; a template quad with an unbound part is skipped. Deleting or
    clearing what is not there changes nothing. Every operation is cut from its predecessors.
    """
    for op in Parser(text).updates():
        match op:
            case ("modify", delete, insert, where, with_graph):
                c = Compiler(quads)
                home = with_graph.value if with_graph else DEFAULT_GRAPH
                if where is None:
                    make = lambda t: _ground(c, t, home)
                else:
                    rel = c.group(where, with_graph)
                    rel = Rel(rel.df if rel.df is not None else c.unit(), rel.vars, rel.maybe)
                    make = lambda t: instantiate(c, rel, t, home)
                out = quads
                for named in (False, True):
                    part = [q for q in delete if (q[0] is not None or with_graph is not None) is named]
                    if part:
                        out = _without(out, make(part), not named)
                if insert:
                    out = load_quads(out, make(insert))
                quads = cut(out)
            case ("clear", g):
                quads = quads.limit(0) if g == "ALL" else quads.where(F.col("g") == DEFAULT_GRAPH) if g == "NAMED" else quads.where(F.col("g") != (DEFAULT_GRAPH if g == "DEFAULT" else g))
            case ("copy" | "move" | "add" as how, a, b):
                a, b = (DEFAULT_GRAPH if x == "DEFAULT" else x for x in (a, b))
                if a != b:
                    new = quads.where(F.col("g") == a).withColumn("g", F.lit(b)).select(quads.columns)
                    kept = quads if how == "add" else quads.where(F.col("g") != b)
                    quads = load_quads(kept if how != "move" else kept.where(F.col("g") != a), new)
            case ("load", source, g):
                quads = load_quads(quads, triples_of_file(quads.sparkSession, source, DEFAULT_GRAPH if g == "DEFAULT" else g))
            case ("nothing",):
                pass
    return quads
