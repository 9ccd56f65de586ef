"""File sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def create_files(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write lines (``value``) below a new path; an error if it is there and is not to be overwritten."""
    rows.select("value").write.mode("overwrite" if overwrite else "errorifexists").text(path)


def write_back(edited: DataFrame, path: str) -> None:
    """Write the rows of an edit that changed; a run without replacements writes no rows."""
    edited.where("replacements > 0").write.mode("append").parquet(path)
