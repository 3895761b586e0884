"""Diffs of a git work tree as a DataFrame."""

import subprocess

from pyspark.sql import DataFrame, SparkSession


def git_diff(spark: SparkSession, root: str, ref: str = "HEAD", base: str | None = None) -> DataFrame:
    """One row (diff_id, text) with a unified diff without context: ``base...ref``, or the uncommitted changes for HEAD, or the
    commit ``ref`` against its parent. git runs on the driver, next to its work tree; a failure gives an empty text."""
    what = [f"{base}...{ref}"] if base else ["HEAD"] if ref == "HEAD" else [f"{ref}~1..{ref}"]
    try:
        out = subprocess.run(["git", "-C", root, "diff", "--unified=0", "--no-color", "--no-ext-diff", *what], capture_output=True, text=True, timeout=120, check=False).stdout
    except (OSError, subprocess.TimeoutExpired):
        out = ""
    return spark.createDataFrame([(ref, out)], "diff_id string, text string")
