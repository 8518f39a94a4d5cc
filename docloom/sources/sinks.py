"""Writers: JSON lines, Parquet tables, and one atomic JSON file of preferences."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).json(path)


def as_json(rows: DataFrame, name: str = "json") -> DataFrame:
    """Each row as one JSON text."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(name))


def write_rendered(rendered: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rendered documents as a Parquet table, in files of rows and not of partitions by path."""
    rendered.write.mode(mode).parquet(path)


def write_preferences(path: str, values: dict) -> dict:
    """Reading preferences as one JSON file, bounded as they are read and replaced in one step; returns what was written."""
    width = int(values.get("tocWidth") or 0)
    scale = float(values.get("rscale") or 0)
    window = values.get("window") or None
    fits = window is not None and window.get("w", 0) >= 200 and window.get("h", 0) >= 150
    out = {"rscale": scale if scale > 0 else 1.0, "tocOpen": values.get("tocOpen", True), "tocWidth": min(1200, max(120, width)) if width > 0 else 268, "window": window if fits else None}
    folder = os.path.dirname(os.path.abspath(path))
    handle, name = tempfile.mkstemp(dir=folder, suffix=".tmp")
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        json.dump(out, f)
    os.replace(name, path)
    return out
