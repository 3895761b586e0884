"""Parsed files as wide views and quads."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structgraph.model import RDF_TYPE, VOCAB, XSD, CodeGraph, entity_iri, graph_iri, module_iri, quads_of
from structgraph.plans.lineage import stored


def graph_from_parsed(parsed: DataFrame, repo: str = "") -> CodeGraph:
    """The wide views of :data:`structgraph.model.PARSED` rows; all of them belong to one codebase named ``repo``.

    Every list is exploded once; nothing is shuffled but for the set semantics of the views. A file that failed whole still is a
    module. A row with a null path is dropped.
    """
    p = parsed.where("path IS NOT NULL AND language IS NOT NULL").withColumn("repo", F.lit(repo)).withColumn("mod", module_iri(F.col("path")))
    none = F.lit(None).cast("string")
    f = p.select("repo", "path", "mod", F.explode("functions").alias("f")).select("repo", "path", F.col("mod").alias("parent"), F.lit("Function").alias("kind"), F.col("f.name").alias("qualified"), "f")
    classes = p.select("repo", "path", "mod", F.explode("classes").alias("c")).withColumn("uri", entity_iri(F.col("path"), "Class", F.col("c.name")))
    m = classes.select("repo", "path", F.col("uri").alias("parent"), F.lit("Method").alias("kind"), "c.name", F.explode("c.methods").alias("f")).select(
        "repo", "path", "parent", "kind", F.concat_ws(".", "name", "f.name").alias("qualified"), "f"
    )
    functions = f.unionByName(m).withColumn("uri", entity_iri(F.col("path"), F.col("kind"), F.col("qualified")))
    v = p.select("repo", "path", "mod", F.explode("variables").alias("v")).withColumn("uri", entity_iri(F.col("path"), "Variable", F.col("v.name")))
    columns = ["repo", "uri", "kind", "name", "file", "start_line", "end_line", "docstring"]
    entities = (
        functions.select("repo", "uri", "kind", "f.name", F.col("path").alias("file"), "f.start_line", "f.end_line", "f.docstring")
        .unionByName(classes.select("repo", "uri", F.lit("Class").alias("kind"), "c.name", F.col("path").alias("file"), "c.start_line", "c.end_line", "c.docstring"))
        .unionByName(v.select("repo", "uri", F.lit("Variable").alias("kind"), "v.name", F.col("path").alias("file"), "v.start_line", F.lit(None).cast("bigint").alias("end_line"), none.alias("docstring")))
        .select(columns)
        .distinct()
    )
    defines = functions.select("parent", F.col("uri").alias("child")).unionByName(classes.select(F.col("mod").alias("parent"), F.col("uri").alias("child"))).unionByName(v.select(F.col("mod").alias("parent"), F.col("uri").alias("child")))
    i = p.select("repo", F.col("mod"), F.explode("imports").alias("i")).select("repo", F.col("mod").alias("module"), F.col("i.module").alias("source"), F.explode("i.names").alias("n"))
    schema = "uri string, kind string, value string, target string"
    return CodeGraph(
        modules=p.select("repo", F.col("mod").alias("uri"), "path").distinct(),
        entities=entities,
        defines=defines.distinct(),
        calls=functions.select("repo", F.col("uri").alias("caller"), F.explode("f.calls").alias("target")).distinct(),
        resolved=parsed.sparkSession.createDataFrame([], "caller string, callee string"),
        imports=i.select("repo", "module", F.when(F.coalesce("source", F.lit("")) == "", F.col("n")).otherwise(F.concat_ws(".", "source", "n")).alias("name")).distinct(),
        inherits=classes.select("repo", F.col("uri").alias("cls"), F.explode("c.bases").alias("base")).distinct(),
        decorators=functions.select("uri", F.explode("f.decorators").alias("decorator")).unionByName(classes.select("uri", F.explode("c.decorators").alias("decorator"))).distinct(),
        annotations=parsed.sparkSession.createDataFrame([], schema),
    )


def parameters_of(parsed: DataFrame) -> DataFrame:
    """(func, param, name, path): parameters with their uris, ``function.parameter`` qualified."""
    f = parsed.where("path IS NOT NULL").select("path", F.explode("functions").alias("f")).select("path", F.lit("Function").alias("kind"), F.col("f.name").alias("q"), "f.parameters")
    m = parsed.where("path IS NOT NULL").select("path", F.explode("classes").alias("c")).select("path", "c.name", F.explode("c.methods").alias("f")).select("path", F.lit("Method").alias("kind"), F.concat_ws(".", "name", "f.name").alias("q"), "f.parameters")
    return (
        f.unionByName(m)
        .select("path", "kind", "q", F.explode("parameters").alias("name"))
        .select(entity_iri(F.col("path"), F.col("kind"), F.col("q")).alias("func"), entity_iri(F.col("path"), "Parameter", F.concat_ws(".", "q", "name")).alias("param"), "name", "path")
        .distinct()
    )


def quads_of_parsed(parsed: DataFrame, repo: str = "") -> DataFrame:
    """All quads of parsed files, parameters included. The records are stored once, so that files are parsed once however many
    branches read them, each branch reading its own columns."""
    parsed = stored(parsed, "parsed")
    ps = parameters_of(parsed)
    none = F.lit(None).cast("string")

    def quad(s: str, p: str, o, kind: str, dt) -> DataFrame:
        return ps.select(graph_iri(F.col("path")).alias("g"), F.col(s).alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), dt.alias("o_dt"), none.alias("o_lang"))

    return (
        quads_of(graph_from_parsed(parsed, repo))
        .unionByName(quad("param", RDF_TYPE, F.lit(VOCAB + "Parameter"), "iri", none))
        .unionByName(quad("param", VOCAB + "name", F.col("name"), "lit", F.lit(XSD + "string")))
        .unionByName(quad("func", VOCAB + "hasParameter", F.col("param"), "iri", none))
        .distinct()
    )


def graph_from_quads(quads: DataFrame, repo: str = "") -> CodeGraph:
    """The wide views of a quad table, as joins of its property tables: an entity with several types or lines has several rows, as
    the triples say. All codebases of the table are looked up together under ``repo``.
    """
    from structgraph.functions.text import path_of_uri

    t = quads.select("s", "p", "o", "o_kind").distinct()
    r = F.lit(repo).alias("repo")

    def prop(name: str, value: str) -> DataFrame:
        return t.where(F.col("p") == (RDF_TYPE if name == "type" else VOCAB + name)).select("s", F.col("o").alias(value))

    types = prop("type", "type").where(F.col("type").startswith(VOCAB)).select("s", F.substring(F.col("type"), len(VOCAB) + 1, 1 << 20).alias("kind"))
    lines = prop("startLine", "start_line").join(prop("endLine", "end_line"), "s", "left")
    named = types.where(F.col("kind").isin("Class", "Function", "Method", "Variable")).join(prop("name", "name"), "s").join(lines, "s", "left").join(prop("docstring", "docstring"), "s", "left")
    entities = named.select(r, F.col("s").alias("uri"), "kind", "name", path_of_uri(F.col("s")).alias("file"), F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line"), "docstring")
    pair = lambda name, a, b: prop(name, b).select(F.col("s").alias(a), b)
    null = F.lit(None).cast("string")
    labels = prop("linkLabel", "raw").select("s", F.substring_index("raw", "->", 1).alias("value"), F.regexp_replace("raw", r"^.*?->", "").alias("target"))
    links = prop("linksTo", "target").join(labels, ["s", "target"], "left").select(F.col("s").alias("uri"), F.lit("link").alias("kind"), "value", "target")
    tags = prop("tag", "value").select(F.col("s").alias("uri"), F.lit("tag").alias("kind"), "value", null.alias("target"))
    notes = prop("note", "value").select(F.col("s").alias("uri"), F.lit("note").alias("kind"), "value", null.alias("target"))
    return CodeGraph(
        modules=types.where("kind = 'Module'").join(prop("filePath", "path"), "s").select(r, F.col("s").alias("uri"), "path"),
        entities=entities,
        defines=pair("defines", "parent", "child"),
        calls=pair("calls", "caller", "target").select(r, "caller", "target"),
        resolved=pair("resolvedCalls", "caller", "callee"),
        imports=pair("imports", "module", "name").select(r, "module", "name"),
        inherits=pair("inheritsFrom", "cls", "base").select(r, "cls", "base"),
        decorators=pair("hasDecorator", "uri", "decorator"),
        annotations=tags.unionByName(notes).unionByName(links),
    )
