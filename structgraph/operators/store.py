"""The quad table: load, replace and clear graphs, statistics."""

import json
from collections.abc import Callable
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from structgraph.model import ANNOTATIONS, INFERRED, QUADS, RDF_TYPE, RESOLVED, VOCAB
from structgraph.plans.lineage import cut, stored


def union_graph(quads: DataFrame) -> DataFrame:
    """The default graph: the triples of all graphs as a set."""
    return quads.select("s", "p", "o", "o_kind", "o_dt", "o_lang").distinct()


def load_quads(quads: DataFrame, new: DataFrame) -> DataFrame:
    """``quads`` with ``new`` rows added; a quad is in a graph once."""
    return quads.unionByName(new.select(quads.columns)).distinct()


def clear_graph(quads: DataFrame, graph: str) -> DataFrame:
    """Everything but one graph; an unknown graph changes nothing."""
    return quads.where(~F.col("g").eqNullSafe(F.lit(graph)))


def replace_graphs(quads: DataFrame, new: DataFrame) -> DataFrame:
    """``quads`` with the graphs that occur in ``new`` replaced by it: re-indexing of files."""
    return quads.join(new.select("g").distinct(), "g", "left_anti").select(quads.columns).unionByName(new.select(quads.columns).distinct())


def store_stats(quads: DataFrame) -> DataFrame:
    """One row: quads, and subjects of type Module, Class, Function and Method counted per graph."""
    kind = lambda k: F.count_if((F.col("p") == RDF_TYPE) & (F.col("o") == VOCAB + k)).alias(k.lower() + ("es" if k == "Class" else "s"))
    return quads.agg(F.count("*").alias("total"), kind("Module"), kind("Class"), kind("Function"), kind("Method"))


#: Quads that a bucket of the store is meant to hold; with twice as many on average the store is laid out anew.
BUCKET_QUADS = 200_000
#: Versions of the store that can still be read by those who began with them; what only older ones use is removed.
KEPT_VERSIONS = 3
#: The bucket that holds the annotations, apart from all code.
_APART = -1


class QuadStore:
    """A quad table in a directory, in buckets of whole files of source: a graph lies in the bucket of its file, resolved and inferred edges in
    that of their subject's file, annotations in one of their own. Rows of a bucket are sorted by property, so that a pattern
    with a known property reads few row groups.

    A write replaces only the buckets in which something changed, as count and hash sums tell, and then a manifest names the
    directory of every bucket: a reader sees a whole version. Directories that only old versions name are removed.
    """

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path.rstrip("/") if path else None
        self._mem = spark.createDataFrame([], QUADS)

    # files
    def _fs(self):
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        at = lambda p: hadoop.Path(f"{self.path}/{p}")
        return at("x").getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _names(self, folder: str) -> list[str]:
        fs, at = self._fs()
        return [PurePosixPath(x.getPath().toString()).name for x in fs.listStatus(at(folder))] if fs.exists(at(folder)) else []

    def _versions(self) -> list[int]:
        return sorted(int(n) for n in self._names("versions") if n.isdigit())

    def _manifest(self, version: int | None = None) -> dict:
        """{buckets: how many, at: bucket -> [version that wrote it, quads, hash sum]}."""
        if version is None:
            v = self._versions()
            if not v:
                return {"buckets": 0, "at": {}}
            version = v[-1]
        return json.loads("".join(r["value"] for r in self.spark.read.text(f"{self.path}/versions/{version}", wholetext=True).collect()))

    def _commit(self, version: int, manifest: dict) -> None:
        """Name a version: written beside and renamed, so that it is there whole or not at all. Then old ones go."""
        fs, at = self._fs()
        out = fs.create(at(f"versions/.{version}"))
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        fs.rename(at(f"versions/.{version}"), at(f"versions/{version}"))
        used = set()
        for v in self._versions():
            if v <= version - KEPT_VERSIONS:
                fs.delete(at(f"versions/{v}"), False)
            else:
                used |= {(x[0], int(b)) for b, x in (manifest if v == version else self._manifest(v))["at"].items()}
        for n in self._names("data"):
            v = int(n[1:])
            here = {int(b.partition("=")[2]) for b in self._names(f"data/{n}") if b.startswith("bucket=")}
            gone = {b for b in here if (v, b) not in used}
            for b in [None] if gone == here else gone:
                fs.delete(at(f"data/{n}" if b is None else f"data/{n}/bucket={b}"), True)

    # buckets
    @staticmethod
    def bucket(count: int) -> Column:
        """The bucket of a quad among ``count``."""
        home = F.substring_index(F.when(F.col("g").isin(RESOLVED, INFERRED), F.col("s")).otherwise(F.col("g")), "#", 1)
        return F.when(F.col("g") == ANNOTATIONS, _APART).otherwise(F.pmod(F.xxhash64(home), F.lit(max(1, count)))).cast("int")

    def _rows(self, manifest: dict, buckets: set[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/data/v{v}/bucket={b}" for b, (v, *_) in sorted(manifest["at"].items()) if buckets is None or int(b) in buckets]
        return self.spark.read.schema(QUADS).parquet(*paths).select(QUADS.names) if paths else self.spark.createDataFrame([], QUADS)

    def read(self) -> DataFrame:
        """All quads of the current version; none where nothing was written."""
        return self._rows(self._manifest()) if self.path else self._mem

    def write(self, quads: DataFrame) -> int:
        """``quads``, as a set, as the new current version; returns how many buckets had to be written."""
        rows = quads.select(QUADS.names)
        if not self.path:
            self._mem = cut(rows.distinct())
            return 1
        old = self._manifest()
        return self._put(rows, old, None)

    def change(self, graphs: list[str], edit: Callable[[DataFrame], DataFrame]) -> int:
        """The store with the quads of some ``graphs`` replaced by what ``edit`` makes of them. Only their buckets are read and written;
        the edges of resolved and inferred graphs lie in all of them."""
        if not self.path:
            mine = F.col("g").isin(*graphs)
            self._mem = cut(self._mem.where(~mine).unionByName(edit(self._mem.where(mine)).select(QUADS.names)).distinct())
            return 1
        old = self._manifest()
        if {RESOLVED, INFERRED} & set(graphs) or not old["at"] and graphs != [ANNOTATIONS]:
            buckets = None
        else:
            named = self.spark.createDataFrame([(g, g) for g in graphs], "g string, s string")
            buckets = {r["b"] for r in named.select(self.bucket(old["buckets"]).alias("b")).distinct().collect()}
        here = self._rows(old, buckets)
        mine = F.col("g").isin(*graphs)
        return self._put(here.where(~mine).unionByName(edit(here.where(mine)).select(QUADS.names)), old, buckets)

    def _put(self, rows: DataFrame, old: dict, only: set[int] | None) -> int:
        """Write those buckets of ``rows`` that differ from the ``old`` version; with ``only``, rows have just those buckets."""
        count = old["buckets"] or 1
        if only is None:
            n = rows.count()
            if not old["buckets"] or n > 2 * BUCKET_QUADS * count or n < BUCKET_QUADS * count // 4:
                count = max(1, -(-n // BUCKET_QUADS))
        # one shuffle by bucket, in which equal rows meet as well
        laid = stored(rows.withColumn("bucket", self.bucket(count)).repartition("bucket").dropDuplicates().sortWithinPartitions("bucket", "p", "s"), "quads")
        sums = laid.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.xxhash64(*QUADS.names).cast("decimal(38,0)")).cast("string").alias("h")).collect()  # a row a bucket
        at = {} if only is None else {b: x for b, x in old["at"].items() if int(b) not in only}
        same = {} if count != old["buckets"] else old["at"]
        version = (self._versions() or [0])[-1] + 1
        changed = [r["bucket"] for r in sums if same.get(str(r["bucket"]), [0, None, None])[1:] != [r["n"], r["h"]]]
        at |= {str(r["bucket"]): [version if r["bucket"] in changed else same[str(r["bucket"])][0], r["n"], r["h"]] for r in sums}
        if changed:
            laid.where(F.col("bucket").isin(changed)).repartition("bucket").sortWithinPartitions("bucket", "p", "s").write.partitionBy("bucket").parquet(f"{self.path}/data/v{version}")
        self._commit(version, {"buckets": count, "at": at})
        return len(changed)

    def clear(self) -> None:
        self.write(self.spark.createDataFrame([], QUADS))
