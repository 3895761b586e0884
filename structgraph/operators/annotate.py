"""Tags, notes and links on entities: updates are new versions of the annotations table (uri, kind, value, target)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structgraph.model import CodeGraph


def entity_uri(g: CodeGraph, name: str) -> str:
    """The uri of an entity by name, the least one of several; an unknown name is an error with suggestions."""
    uri = g.entities.where(F.col("name") == name).agg(F.min("uri")).first()[0]
    if uri is None:
        from structgraph.operators.search import suggest

        raise ValueError(f"no entity named {name!r}. {suggest(g, name).first()[0]}")
    return uri


def _add(notes: DataFrame, *rows: tuple) -> DataFrame:
    return notes.unionByName(notes.sparkSession.createDataFrame(list(rows), notes.schema)).distinct()


def add_tag(notes: DataFrame, uri: str, tag: str) -> DataFrame:
    return _add(notes, (uri, "tag", tag, None))


def add_note(notes: DataFrame, uri: str, note: str) -> DataFrame:
    return _add(notes, (uri, "note", note, None))


def add_link(notes: DataFrame, uri: str, target: str, label: str = "") -> DataFrame:
    """An edge between two entities; the label is a column of the edge, null where there is none."""
    return _add(notes, (uri, "link", label or None, target))


def remove_value(notes: DataFrame, kind: str, uri: str, value: str) -> DataFrame:
    """Annotations without the tag or note ``value`` of ``uri``; what is not there is not missed."""
    return notes.where(~((F.col("kind") == kind) & (F.col("uri") == uri) & F.col("value").eqNullSafe(F.lit(value))))


def remove_link(notes: DataFrame, uri: str, target: str) -> DataFrame:
    """Annotations without links from ``uri`` to ``target``, whatever their labels."""
    return notes.where(~((F.col("kind") == "link") & (F.col("uri") == uri) & F.col("target").eqNullSafe(F.lit(target))))


def list_values(g: CodeGraph, kind: str, name: str | None = None) -> DataFrame:
    """Tags or notes of one entity name or of all: (name, value) in that order."""
    rows = g.annotations.where(F.col("kind") == kind).join(g.entities.select("uri", "name"), "uri").select("name", "value").distinct()
    return (rows.where(F.col("name") == name) if name is not None else rows).orderBy("name", "value")


def list_links(g: CodeGraph, name: str | None = None) -> DataFrame:
    """Links of one entity name, in both directions, or all: (direction, name, other, label)."""
    n = g.entities.select("uri", "name")
    links = g.annotations.where("kind = 'link'").join(n.withColumnRenamed("name", "from_name"), "uri").join(n.select(F.col("uri").alias("target"), F.col("name").alias("to_name")), "target")
    out = links.select(F.lit("outgoing").alias("direction"), F.col("from_name").alias("name"), F.col("to_name").alias("other"), F.col("value").alias("label"))
    if name is None:
        return out.distinct().orderBy("name", "other", "label")
    back = links.select(F.lit("incoming").alias("direction"), F.col("to_name").alias("name"), F.col("from_name").alias("other"), F.col("value").alias("label"))
    return out.unionByName(back).where(F.col("name") == name).distinct()


def annotations_for(g: CodeGraph, name: str) -> DataFrame:
    """All annotations of the entities of a name, one row per entity with three sorted arrays: (uri, tags, notes, links)."""
    me = g.entities.where(F.col("name") == name).select("uri")
    of = lambda k, c: F.sort_array(F.collect_set(F.when(F.col("kind") == k, F.col(c))))
    return me.join(g.annotations, "uri", "left").groupBy("uri").agg(of("tag", "value").alias("tags"), of("note", "value").alias("notes"), of("link", "target").alias("links"))


def clear_annotations(notes: DataFrame) -> DataFrame:
    return notes.limit(0)
