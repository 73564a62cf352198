"""Writers."""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.storage import file_system


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def insights_csv(runs: DataFrame, path: str) -> None:
    """Six columns with a header; double quotes as single ones and line ends as spaces in the summary."""
    flat = F.regexp_replace(F.regexp_replace("summary", '"', "'"), r"[\r\n]+", " ")
    runs.select("id", "product_name", "created_at", "confidence", flat.alias("summary"), "source_id").write.mode("overwrite").csv(path, header=True)


def json_rows(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def json_backup(df: DataFrame, path: str) -> None:
    """df as JSON lines, in place of what path held: written beside it and then renamed, so that a reader finds the one or the other."""
    spark, new = df.sparkSession, f"{path}.new-{uuid.uuid4().hex}"
    df.write.json(new)
    system, where = file_system(spark, path)
    aside = where.suffix(f".old-{uuid.uuid4().hex}")
    had = system.exists(where) and system.rename(where, aside)
    if not system.rename(file_system(spark, new)[1], where):
        if had:
            system.rename(aside, where)
        raise OSError(f"can't replace {path}")
    if had:
        system.delete(aside, True)


def experiment(spark: SparkSession, path: str, params: dict[str, object], metrics: dict[str, float]) -> None:
    """Appends a row (at, params, metrics) to a table of experiments."""
    row = [({k: str(v) for k, v in params.items()}, {k: float(v) for k, v in metrics.items()})]
    spark.createDataFrame(row, "params map<string,string>, metrics map<string,double>").withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)


def _polyline(image: np.ndarray, values: list[float | None], colour: tuple[int, int, int]) -> None:
    """Draws values from left to right over the whole height of image; gaps where there are none."""
    height, width = image.shape[:2]
    known = [v for v in values if v is not None]
    low, high = min(known, default=0.0), max(known, default=1.0)
    scale = (height - 1) / ((high - low) or 1.0)
    x = np.linspace(0, width - 1, max(2, len(values)))
    for (x0, v0), (x1, v1) in zip(zip(x, values), zip(x[1:], values[1:])):
        if v0 is not None and v1 is not None:
            steps = int(max(abs(x1 - x0), abs(v1 - v0) * scale)) + 2
            rows = np.rint(height - 1 - (np.linspace(v0, v1, steps) - low) * scale).astype(int)
            image[rows, np.rint(np.linspace(x0, x1, steps)).astype(int)] = colour


def chart_png(series: DataFrame, width: int = 800, height: int = 300) -> bytes:
    """A daily series (date, runs, avg_confidence) as a PNG: runs in blue, confidence in orange, each over its own range. The
    days are few; they come to the driver."""
    rows = series.orderBy("date").collect()
    image = np.full((height, width, 3), 255, np.uint8)
    _polyline(image, [float(r["runs"]) for r in rows], (31, 119, 180))
    _polyline(image, [r["avg_confidence"] for r in rows], (255, 127, 14))
    raw = b"".join(b"\0" + line.tobytes() for line in image)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def by_year(messages: DataFrame, path: str, years: list[int]) -> None:
    """Messages of some years, a folder for each."""
    messages.where(F.year("sent_at").isin(*years)).withColumn("year", F.year("sent_at")).write.mode("overwrite").partitionBy("year").json(path)
