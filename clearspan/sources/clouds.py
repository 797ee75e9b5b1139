"""Raw sensor inputs: packed point clouds and GNSS sentences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields that a cloud must have, and the code of a 32-bit float. Fixed values.
FIELDS, FLOAT32 = ("x", "y", "z", "offset_time"), 7
BAD_LAYOUT = "INVALID_POINT_CLOUD_LAYOUT"


def cloud_errors(frames: DataFrame) -> DataFrame:
    """frames with error: null, or BAD_LAYOUT for big-endian data, a missing field or one of another type, no point step, or a buffer shorter than its
    rows. frames: frame_id, width, height, point_step, row_step, is_bigendian, fields array<struct<name, offset, datatype>>, data binary."""
    usable = F.filter("fields", lambda f: (f["datatype"] == FLOAT32) & (f["offset"] >= 0) & (f["offset"] + 4 <= F.col("point_step")))
    has = [F.array_contains(F.transform(usable, lambda f: f["name"]), n) for n in FIELDS]
    ok = ~F.col("is_bigendian") & (F.col("point_step") > 0) & (F.length("data") >= F.col("row_step").cast("long") * F.col("height")) & (F.col("row_step") >= F.col("point_step").cast("long") * F.col("width"))
    for h in has:
        ok = ok & h
    return frames.withColumn("error", F.when(~F.coalesce(ok, F.lit(False)), BAD_LAYOUT))


def ingest_point_clouds(frames: DataFrame) -> DataFrame:
    """(frame_id, point_idx, x, y, z, offset_s) of every point of the frames without an error."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for frame, width, height, step, row, fields, data in zip(b["frame_id"], b["width"], b["height"], b["point_step"], b["row_step"], b["fields"], b["data"], strict=True):
                at = {f["name"]: f["offset"] for f in fields}
                kind = np.dtype({"names": list(FIELDS), "formats": ["<f4"] * len(FIELDS), "offsets": [at[n] for n in FIELDS], "itemsize": step})
                rows = [np.frombuffer(data, dtype=kind, count=width, offset=r * row) for r in range(height)]
                p = np.concatenate(rows) if rows else np.zeros(0, dtype=kind)
                yield pd.DataFrame({"frame_id": np.full(len(p), frame, dtype=np.int64), "point_idx": np.arange(len(p), dtype=np.int64), "x": p["x"], "y": p["y"], "z": p["z"], "offset_s": p["offset_time"]})

    good = cloud_errors(frames).where("error IS NULL")
    return good.select("frame_id", "width", "height", "point_step", "row_step", "fields", "data").mapInPandas(unpack, "frame_id long, point_idx long, x float, y float, z float, offset_s float")


def read_gnss_sentences(spark: SparkSession, path: str, *, stream: bool = False) -> DataFrame:
    """(line) of raw sentence files, without line ends and empty lines; as a stream if asked for."""
    lines = (spark.readStream if stream else spark.read).text(path)
    return lines.select(F.regexp_replace("value", r"[\r\n\x00]+", "").alias("line")).where(F.length("line") > 0)


def topic_stream(spark: SparkSession, root: str, topic: str, schema: str) -> DataFrame:
    """A topic's messages as a stream of the JSON files under <root>/<topic>."""
    return spark.readStream.schema(schema).json(f"{root}/{topic}")
