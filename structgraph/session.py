"""Session with the settings the operators are written for."""

from pyspark.sql import SparkSession


def get_session(app: str = "structgraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; ``conf`` adds or overrides settings."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


_SHIPPED = "_structgraph_shipped"


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers of a session, once: as a zip file that the driver serves to its executors."""
    import atexit
    import io
    import os
    import tempfile
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, _SHIPPED, False):
        return
    root = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    fd, name = tempfile.mkstemp(prefix="structgraph-", suffix=".zip")
    with os.fdopen(fd, "wb") as f:
        f.write(data.getvalue())
    sc.addPyFile(name)
    atexit.register(lambda: os.path.exists(name) and os.remove(name))
    setattr(sc, _SHIPPED, True)
