"""Sinks: one table for each sheet of an export, JSON lines and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def export_tables(tables: dict[str, DataFrame], folder: str, kind: str = "parquet") -> None:
    """Every table in a folder of its own; csv gets headers and nested columns as JSON."""
    for name, df in tables.items():
        if kind == "csv":
            nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("struct", "array", "map")]
            df.withColumns({c: F.to_json(c) for c in nested}).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
        else:
            df.write.mode("overwrite").format(kind).save(f"{folder}/{name}")


def export_json(df: DataFrame, folder: str) -> None:
    """JSON lines without nulls."""
    df.write.mode("overwrite").json(folder)


def export_text(df: DataFrame, folder: str, *columns: str) -> None:
    """Rows parted by tabs."""
    df.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("value")).write.mode("overwrite").text(folder)
