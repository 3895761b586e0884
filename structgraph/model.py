"""Data model: the quad table, the wide views over it, and how IRIs are made."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from structgraph.functions.text import non_blank, path_of_uri, repo_of, strip

#: Namespaces of this engine's vocabulary; the classes and properties carry the names of the data model.
ENTITY = "https://graph.invalid/entity/"
VOCAB = "https://graph.invalid/ontology#"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
XSD = "http://www.w3.org/2001/XMLSchema#"
RESOLVED, ANNOTATIONS, INFERRED = (f"{ENTITY}_{x}#graph" for x in ("resolved", "annotations", "inferred"))
CLASSES = ("Module", "Class", "Function", "Method", "Parameter", "Import", "Variable")
PROPERTIES = (
    "name", "filePath", "startLine", "endLine", "docstring", "hasDecorator", "defines", "calls", "resolvedCalls", "inheritsFrom", "imports", "hasParameter", "tag", "note", "linksTo", "linkLabel",
)

QUADS = T.StructType([T.StructField(c, T.StringType()) for c in ("g", "s", "p", "o", "o_kind", "o_dt", "o_lang")])

_FUNCTION = "struct<name:string,start_line:bigint,end_line:bigint,parameters:array<string>,decorators:array<string>,docstring:string,calls:array<string>>"
#: What a parser gives for one file.
PARSED = (
    f"path string, language string, functions array<{_FUNCTION}>, "
    f"classes array<struct<name:string,start_line:bigint,end_line:bigint,docstring:string,bases:array<string>,decorators:array<string>,methods:array<{_FUNCTION}>>>, "
    "imports array<struct<module:string,names:array<string>,start_line:bigint,aliases:map<string,string>>>, variables array<struct<name:string,start_line:bigint>>, parse_error string"
)


def escaped(c: Column) -> Column:
    """A path or name as it stands in an IRI: backslashes as slashes, characters that IRIs cannot hold percent-encoded."""
    out = F.translate(c, "\\", "/")
    for ch in '%<>"{}|^` ':
        out = F.replace(out, F.lit(ch), F.lit(f"%{ord(ch):02X}"))
    return F.replace(out, F.lit("#"), F.lit("%23"))


def module_iri(path: Column) -> Column:
    return F.concat(F.lit(ENTITY), escaped(path))


def entity_iri(path: Column, kind: Column | str, qualified: Column) -> Column:
    k = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(F.lit(ENTITY), escaped(path), F.lit("#"), k, F.lit("."), escaped(qualified))


def graph_iri(path: Column) -> Column:
    return F.concat(F.lit(ENTITY), escaped(path), F.lit("#graph"))


@dataclass
class CodeGraph:
    """The wide views of one or more indexed codebases. Names are looked up within a codebase, so every view that is joined by
    name carries ``repo``. All views are sets of rows."""

    modules: DataFrame  # repo, uri, path
    entities: DataFrame  # repo, uri, kind, name, file, start_line, end_line, docstring
    defines: DataFrame  # parent, child
    calls: DataFrame  # repo, caller, target
    resolved: DataFrame  # caller, callee
    imports: DataFrame  # repo, module, name
    inherits: DataFrame  # repo, cls, base
    decorators: DataFrame  # uri, decorator
    annotations: DataFrame  # uri, kind, value, target


def graph_from_tables(modules: DataFrame, entities: DataFrame, calls: DataFrame, imports: DataFrame, inherits: DataFrame, decorators: DataFrame) -> CodeGraph:
    """The current state of indexed tables: rows without deleted_at, of several rows of a uri the latest.

    Texts lose surrounding white space; blank ones fall away. ``defines`` follows from the uris. Annotations start out as the
    decorators (tags), the docstrings of classes (notes) and the bases found in the same repo (links).
    """
    live_m = modules.where(F.col("deleted_at").isNull() & F.col("uri").isNotNull()).select("repo", "uri", "path").distinct()
    latest = entities.where(F.col("deleted_at").isNull() & F.col("uri").isNotNull()).groupBy("uri").agg(F.max_by(F.struct("kind", "name", "file", "start_line", "end_line", "docstring"), "indexed_at").alias("e"))
    ents = latest.select(repo_of(F.col("e.file")).alias("repo"), "uri", "e.*")
    parent = F.when(F.col("kind") == "Method", F.regexp_replace("uri", r"#Method\.(.*)\.[^.]*$", "#Class.$1")).otherwise(F.regexp_replace("uri", r"#.*$", ""))
    called = calls.select("repo", "caller", non_blank(F.col("target")).alias("target")).where("target IS NOT NULL AND caller IS NOT NULL").distinct()
    resolved = calls.select("caller", F.translate(non_blank(F.col("callee")), "\\", "/").alias("callee")).where("callee IS NOT NULL AND caller IS NOT NULL").distinct()
    imported = imports.select("repo", "module", F.concat_ws(".", strip(F.col("from_module")), non_blank(F.col("imported"))).alias("name")).where("module IS NOT NULL").distinct()
    bases = inherits.select("repo", "cls", non_blank(F.col("base")).alias("base")).where("base IS NOT NULL AND cls IS NOT NULL").distinct()
    decos = decorators.select("uri", F.nullif(strip(F.regexp_replace(strip(F.col("decorator")), r"^@+", "")), F.lit("")).alias("decorator")).where("decorator IS NOT NULL").distinct()
    none = F.lit(None).cast("string")
    classes = ents.where("kind = 'Class'")
    links = bases.join(classes.select("repo", F.col("name").alias("base"), F.col("uri").alias("target")), ["repo", "base"]).select(F.col("cls").alias("uri"), F.lit("link").alias("kind"), F.col("base").alias("value"), "target")
    notes = F.nullif(strip(F.col("docstring")), F.lit(""))
    annotations = (
        decos.select("uri", F.lit("tag").alias("kind"), F.col("decorator").alias("value"), none.alias("target"))
        .unionByName(classes.select("uri", F.lit("note").alias("kind"), notes.alias("value"), none.alias("target")).where("value IS NOT NULL"))
        .unionByName(links)
    )
    return CodeGraph(live_m, ents, ents.select(parent.alias("parent"), F.col("uri").alias("child")), called, resolved, imported, bases, decos, annotations)


def quads_of(g: CodeGraph) -> DataFrame:
    """The quad table of wide views: one named graph per file, one each for resolved calls and annotations; a set of rows."""

    def rows(df: DataFrame, graph: Column, s: Column, p: str, o: Column, kind: str = "lit", dt: str | None = "string") -> DataFrame:
        iri = RDF_TYPE if p == "type" else VOCAB + p
        return df.select(
            graph.alias("g"), s.alias("s"), F.lit(iri).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"),
            (F.lit(XSD + dt) if kind == "lit" and dt else F.lit(None).cast("string")).alias("o_dt"), F.lit(None).cast("string").alias("o_lang"),
        ).where("o IS NOT NULL")

    c = F.col
    own = lambda u: graph_iri(path_of_uri(c(u)))
    e = g.entities
    parts = [
        rows(g.modules, graph_iri(c("path")), c("uri"), "type", F.lit(VOCAB + "Module"), "iri"),
        rows(g.modules, graph_iri(c("path")), c("uri"), "name", c("path")),
        rows(g.modules, graph_iri(c("path")), c("uri"), "filePath", c("path")),
        rows(e, own("uri"), c("uri"), "type", F.concat(F.lit(VOCAB), c("kind")), "iri"),
        rows(e, own("uri"), c("uri"), "name", c("name")),
        rows(e, own("uri"), c("uri"), "startLine", c("start_line"), dt="integer"),
        rows(e, own("uri"), c("uri"), "endLine", c("end_line"), dt="integer"),
        rows(e, own("uri"), c("uri"), "docstring", F.nullif(c("docstring"), F.lit(""))),
        rows(g.defines, own("child"), c("parent"), "defines", c("child"), "iri"),
        rows(g.calls, own("caller"), c("caller"), "calls", c("target")),
        rows(g.imports, own("module"), c("module"), "imports", c("name")),
        rows(g.inherits, own("cls"), c("cls"), "inheritsFrom", c("base")),
        rows(g.decorators, own("uri"), c("uri"), "hasDecorator", c("decorator")),
        rows(g.resolved, F.lit(RESOLVED), c("caller"), "resolvedCalls", c("callee"), "iri"),
        rows(g.annotations.where("kind = 'tag'"), F.lit(ANNOTATIONS), c("uri"), "tag", c("value")),
        rows(g.annotations.where("kind = 'note'"), F.lit(ANNOTATIONS), c("uri"), "note", c("value")),
        rows(g.annotations.where("kind = 'link'"), F.lit(ANNOTATIONS), c("uri"), "linksTo", c("target"), "iri"),
        rows(g.annotations.where("kind = 'link'"), F.lit(ANNOTATIONS), c("uri"), "linkLabel", F.concat(c("value"), F.lit("->"), c("target"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()
