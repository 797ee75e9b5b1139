"""Report tables: the summary, its manifest and the analysis traces that it is read from."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import AnomalyConfig
from ..functions.text import fixed, format_endpoint, lane_text

VERSION = 1
TRACE = "version int, raw_min double, effective_min double, n_valid long, n_invalid long, n_duplicate long, config string, low_events array<struct<event_id:string,samples:array<long>,start:double,end:double,min_height:double,score:int,rules:array<string>,status:string>>"


def summary_report(tasks: DataFrame, rollups: DataFrame, endpoints: DataFrame) -> DataFrame:
    """A line for each task with an effective minimum: display id, code, lane, that minimum, its times and both ends. tasks: task_id, display_id,
    code, lane, direction, side, started, ended; rollups: task_id, effective_min; endpoints: task_id, role, lat, lon, alt."""
    ends = endpoints.groupBy("task_id").pivot("role", ["entry", "exit"]).agg(F.first(F.struct("lat", "lon", "alt")))
    j = tasks.join(rollups.where("effective_min IS NOT NULL").select("task_id", "effective_min"), "task_id").join(ends, "task_id", "left")
    point = lambda r: format_endpoint(F.col(f"{r}.lat"), F.col(f"{r}.lon"), F.col(f"{r}.alt"), F.col(f"{r}.lat").isNotNull())
    return j.select("task_id", "display_id", "code", lane_text(F.col("lane"), F.col("direction"), F.col("side")).alias("lane"), fixed(F.col("effective_min"), 3).alias("min_height"), F.concat_ws(" - ", "started", "ended").alias("times"), point("entry").alias("entry"), point("exit").alias("exit"))


def report_manifest(report: DataFrame, traces: DataFrame, key: str = "report_id") -> DataFrame:
    """(report_id, manifest, sha256): the tasks of each report in display order with their traces, as JSON, and the digest of its lines. report: report_id and
    the columns of summary_report; traces: task_id, trace."""
    lines = F.sha2(F.to_json(F.struct("display_id", "code", "lane", "min_height", "times", "entry", "exit")), 256)
    rows = report.join(traces, "task_id", "left").withColumn("line", lines)
    item = F.struct("display_id", "task_id", "trace", "line")
    made = rows.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("items"))
    body = F.struct(F.col(key), F.col("items.task_id").alias("task_ids"), F.col("items.display_id").alias("task_display_ids"), F.transform("items", lambda i: F.struct(i["task_id"].alias("task_id"), i["trace"].alias("trace"))).alias("clearance_analysis"))
    return made.select(key, F.to_json(body).alias("manifest"), F.sha2(F.concat_ws("\n", "items.line"), 256).alias("sha256"))


def config_json(c: AnomalyConfig) -> str:
    """The parameters of an analysis, by name."""
    return "{" + ",".join(f'"{k}":{v}' for k, v in asdict(c).items()) + "}"


def read_analysis_trace(traces: DataFrame, version: int = VERSION) -> DataFrame:
    """Traces (task_id, trace) as columns with error: null, 'version' for another version, 'events' where the list of events is missing, or 'number' where a
    minimum isn't finite. Rows with an error have no other values."""
    parsed = traces.select("task_id", F.from_json("trace", TRACE, {"allowNonNumericNumbers": "true"}).alias("p"))
    odd = lambda c: F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False))
    error = F.when(F.col("p.version").isNull() | (F.col("p.version") != version), "version").when(F.col("p.low_events").isNull(), "events").when(odd("p.raw_min") | odd("p.effective_min"), "number")
    return parsed.withColumn("error", error).withColumn("p", F.when(F.col("error").isNull(), F.col("p"))).select("task_id", "error", "p.*")
