"""The detail text of a task: fixed columns, four blanks (or a tab) between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import collapse_blanks, fixed

SEPARATOR = "    "


def read_detail(spark: SparkSession, path: str, columns: tuple[str, str]) -> DataFrame:
    """(index, height, valid): rows under the header that names both columns, found by the names in each file for itself; files without one give no rows. Rows of
    another width are left out; heights that are no finite number are null; valid is height > 0."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^\ufeff|\r$", "").alias("line"))
    parts = lines.withColumn("p", F.split("line", r"\t| {4,}"))
    named = F.array_contains("p", columns[0]) & F.array_contains("p", columns[1])
    headers = parts.where(named).groupBy("file").agg(F.first(F.struct(F.size("p").alias("width"), F.array_position("p", columns[0]).cast("int").alias("a"), F.array_position("p", columns[1]).cast("int").alias("b"))).alias("h"))
    number = lambda i: F.element_at("p", i).try_cast("double")
    own = parts.join(headers.hint("shuffle_hash"), "file").where((F.size("p") == F.col("h.width")) & ~named)
    rows = own.select(number(F.col("h.a")).cast("long").alias("index"), number(F.col("h.b")).alias("height")).where("index IS NOT NULL")
    finite = ~F.isnan("height") & (F.abs("height") < F.lit(float("inf")))
    return rows.withColumn("height", F.when(finite, F.col("height"))).withColumn("valid", F.coalesce(F.col("height") > 0, F.lit(False)))


def detail_lines(samples: DataFrame, formats: dict[str, int | None]) -> DataFrame:
    """(task_id, sample_index, line): columns in order; numbers with fixed digits, missing ones as 0; texts in one line."""
    cells = [fixed(F.col(c), digits) if digits is not None else F.coalesce(collapse_blanks(F.col(c).cast("string")), F.lit("")) for c, digits in formats.items()]
    return samples.select("task_id", "sample_index", F.concat_ws(SEPARATOR, *cells).alias("value"))


def write_detail(samples: DataFrame, formats: dict[str, int | None], path: str) -> None:
    """One folder of text for each task, rows in order, lines ended by CR LF."""
    lines = detail_lines(samples, formats).repartition("task_id").sortWithinPartitions("task_id", "sample_index")
    lines.select("task_id", "value").write.partitionBy("task_id").option("lineSep", "\r\n").text(path)
