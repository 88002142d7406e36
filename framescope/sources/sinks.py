"""Write a report under one name per input and report."""

from __future__ import annotations

from pyspark.sql import DataFrame

FORMATS = ("parquet", "json")


def base_name(source: str) -> str:
    """File name of an input without its suffix."""
    return source.rstrip("/").rsplit("/", 1)[-1].split(".", 1)[0]


def write_report(report: DataFrame, out: str, base: str, name: str, fmt: str = "parquet") -> str:
    """Write to ``{out}/{base}_{name}``, replacing an older report; folders are created."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown report format: {fmt}")
    path = f"{out.rstrip('/')}/{base}_{name}"
    report.write.mode("overwrite").format(fmt).save(path)
    return path
