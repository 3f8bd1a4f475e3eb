"""Writing tables to new places."""

from __future__ import annotations

from pyspark.sql import DataFrame


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, in as many parts as the table has partitions."""
    df.write.mode("errorifexists").option("header", "true").option("escape", '"').csv(path)


def save_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write an edited table to a NEW path; what is being read is never replaced."""
    if fmt == "csv":
        export_csv(df, path)
    elif fmt in ("parquet", "json"):
        df.write.mode("errorifexists").format(fmt).save(path)
    else:
        raise ValueError(f"cannot write {fmt!r}")
