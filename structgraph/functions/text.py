"""String expressions that mean the same in Spark and in the SQL checks."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Leading or trailing white space of any kind, Unicode separators included.
EDGE_SPACE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def strip(c: Column) -> Column:
    """``c`` without surrounding white space."""
    return F.regexp_replace(c, EDGE_SPACE, "")


def non_blank(c: Column) -> Column:
    """``c`` stripped, null where nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def class_name(base: Column) -> Column:
    """Last component of a base-class text: type arguments cut at the first bracket, qualifiers before ``.`` or ``::`` dropped."""
    return non_blank(F.regexp_replace(F.regexp_replace(strip(base), r"[<\[(].*$", ""), r"^.*(\.|::)", ""))


def repo_of(path: Column) -> Column:
    """Repository of a path: its first two components."""
    return F.regexp_extract(path, r"^([^/]+/[^/]+)/", 1)


def path_of_uri(uri: Column) -> Column:
    """Path in an entity or module uri, without the fragment."""
    return F.regexp_replace(F.regexp_replace(uri, r"^[a-z]+://[^/]+/entity/", ""), r"#.*$", "")


def without_extension(path: Column) -> Column:
    """``path`` without the last extension of its last component."""
    return F.regexp_replace(path, r"\.[^./]*$", "")


def normal_path(path: Column) -> Column:
    """``path`` with ``.`` and ``..`` components resolved; ``..`` above the top is ignored."""
    return F.array_join(
        F.aggregate(
            F.split(path, "/"),
            F.array().cast("array<string>"),
            lambda acc, x: F.when(x.isin("", "."), acc)
            .when(x == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc))
            .otherwise(F.concat(acc, F.array(x))),
        ),
        "/",
    )
