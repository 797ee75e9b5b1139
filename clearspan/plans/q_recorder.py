"""Registered queries of the recorder and the reports, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import recorder as Q
from ..operators import report as P
from . import adapters as A

HOUR = 3_600_000_000_000
TICK = 6 * HOUR
QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


@query("d10_record", f"""WITH {A.stream_sql('v', 'view')}, {A.stream_sql('c', 'click')}, {A.stream_sql('e', 'error')}, {A.stream_sql('b', 'purchase')},
sess AS (SELECT task_id, min(t) AS a FROM v GROUP BY 1), grid AS (SELECT task_id, a, unnest(range(101)) AS tick FROM sess),
g AS (SELECT task_id, tick, a + tick * {TICK} AS t FROM grid WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.task_id = grid.task_id AND a + tick * {TICK} >= e.t AND a + tick * {TICK} < e.t + {12 * HOUR})),
h AS (SELECT g.*, v.t AS st, coalesce(v.seq, 0) AS seq, CASE WHEN v.seq % 9 > 0 THEN v.v / 50 END AS height, v.v / 100 AS quality FROM g ASOF LEFT JOIN v ON g.task_id = v.task_id AND g.t >= v.t),
r AS (SELECT *, CASE WHEN st IS NULL THEN 'source_unavailable' WHEN t - st > {20 * HOUR} THEN 'source_timeout' WHEN seq % 7 = 0 OR height IS NULL THEN CASE WHEN seq % 2 = 0 THEN 'source_invalid' ELSE 'few_points' END END AS reason, row_number() OVER (PARTITION BY task_id, seq ORDER BY t) - 1 AS k FROM h),
s AS (SELECT r.*, CASE WHEN r.t - b.t <= {10 * HOUR} THEN b.seq END AS fix_seq FROM r ASOF LEFT JOIN b ON r.task_id = b.task_id AND r.t >= b.t),
m AS (SELECT c.task_id, (c.t - a + {TICK - 1}) // {TICK} AS tick, count(*) AS n, avg(v) AS gyro FROM c JOIN sess USING (task_id) WHERE c.t BETWEEN a AND a + {100 * TICK} AND NOT EXISTS (SELECT 1 FROM e WHERE e.task_id = c.task_id AND c.t >= e.t AND c.t < e.t + {12 * HOUR}) GROUP BY ALL)
SELECT s.task_id, s.t, s.tick, s.seq AS source_sequence, round(coalesce((s.t - st) / 1e6::DOUBLE, 0), 3) AS source_age_ms, round(quality, 6) AS quality, reason, reason IS NULL AS valid, CASE WHEN seq > 0 THEN k ELSE 0 END AS repeat_index, seq > 0 AND k > 0 AS is_repeated,
  fix_seq, coalesce(n, 0) AS n, round(gyro, 6) AS gyro, round(CASE WHEN reason IS NULL AND s.task_id % 5 > 0 THEN height + s.task_id * 0.01::DOUBLE END, 6) AS height FROM s LEFT JOIN m USING (task_id, tick)""")
def d10(spark, d):
    views = A.stream_of(spark, d, "view")
    sessions = views.groupBy("task_id").agg(F.min("t").alias("start_ns")).withColumn("stop_ns", F.col("start_ns") + 100 * TICK)
    source = views.select("task_id", "t", "seq", F.when(F.col("seq") % 9 > 0, F.col("v") / 50).alias("height"), (F.col("seq") % 7 > 0).alias("ok"), F.when(F.col("seq") % 2 == 0, "").otherwise("few_points").alias("reason"), (F.col("v") / 100).alias("quality"))
    pauses = A.stream_of(spark, d, "error").select("task_id", F.col("t").alias("start_ns"), (F.col("t") + 12 * HOUR).alias("end_ns"))
    mounts = views.select("task_id").distinct().where("task_id % 5 > 0").withColumn("mount_m", F.col("task_id") * 0.01)
    channels = A.stream_of(spark, d, "click").withColumnRenamed("v", "gyro")
    out = Q.record(sessions, source, channels, ["gyro"], pauses, mounts, {"fix": (A.stream_of(spark, d, "purchase"), 10 * HOUR)}, period_ns=TICK, timeout_ns=20 * HOUR, width_ns=48 * HOUR)
    rounded = [F.round(c, n).alias(c) for c, n in (("source_age_ms", 3), ("quality", 6), ("gyro", 6), ("height", 6))]
    return out.select("task_id", "t", "tick", "source_sequence", "reason", "valid", "repeat_index", "is_repeated", F.col("fix.seq").alias("fix_seq"), "n", *rounded)


REPORT = """t AS (SELECT o_orderkey AS task_id, 'D' || o_orderkey AS display_id, o_clerk AS code, CASE WHEN o_orderkey % 3 = 0 THEN 'left' ELSE 'right' END AS lane, CASE WHEN o_orderkey % 4 = 0 THEN 'up' ELSE 'unknown' END AS direction, o_custkey % 7 AS report_id,
  strftime(o_orderdate, '%Y-%m-%d') AS started, o_orderkey % 10 AS k FROM (SELECT *, 'clerk ' || o_custkey AS o_clerk FROM orders)),
m AS (SELECT l_orderkey AS task_id, min(CASE WHEN l_quantity > 10 THEN l_quantity END) / 10 AS effective_min FROM lineitem GROUP BY 1),
r AS (SELECT t.task_id, report_id, display_id, code, CASE WHEN direction = 'up' THEN 'up ' ELSE '' END || lane || ' lane' AS lane, printf('%.3f', effective_min) AS min_height, started || ' - ' || started AS times,
  CASE WHEN k < 5 THEN printf('N%.7f E%.7f', 30 + k / 10.0::DOUBLE, 114 + k / 20.0::DOUBLE) || CASE WHEN k = 4 THEN '' ELSE printf(' H%.3fm', k / 2.0::DOUBLE) END ELSE 'not recorded' END AS entry, 'not recorded' AS exit FROM t JOIN m USING (task_id) WHERE effective_min IS NOT NULL)"""


def reported(spark, d):
    o, k = A.table(spark, d, "orders"), F.col("o_orderkey")
    tasks = o.select(k.alias("task_id"), F.concat(F.lit("D"), k.cast("string")).alias("display_id"), F.concat(F.lit("clerk "), F.col("o_custkey").cast("string")).alias("code"), F.when(k % 3 == 0, "left").otherwise("right").alias("lane"), F.when(k % 4 == 0, "up").otherwise("unknown").alias("direction"),
        F.lit(None).cast("string").alias("side"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("started"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("ended"))
    rollups = A.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("task_id")).agg((F.min(F.when(F.col("l_quantity") > 10, F.col("l_quantity"))) / 10).alias("effective_min"))
    ends = o.where(k % 10 < 5).select(k.alias("task_id"), F.lit("entry").alias("role"), (30 + k % 10 / 10).alias("lat"), (114 + k % 10 / 20).alias("lon"), F.when(k % 10 != 4, k % 10 / 2).alias("alt"))
    return P.summary_report(tasks, rollups, ends), o.select(k.alias("task_id"), (F.col("o_custkey") % 7).alias("report_id"))


@query("d9_summary_report", f"WITH {REPORT} SELECT * EXCLUDE (report_id) FROM r")
def d9(spark, d):
    return reported(spark, d)[0]


@query("s8_report_manifest", f"""WITH {REPORT}, l AS (SELECT *, sha256(to_json(struct_pack(display_id := display_id, code := code, lane := lane, min_height := min_height, times := times, entry := entry, exit := exit))) AS line FROM r)
SELECT report_id, sha256(string_agg(line, chr(10) ORDER BY display_id, task_id)) AS sha256, count(*) AS tasks FROM l GROUP BY 1""")
def s8(spark, d):
    lines, of = reported(spark, d)
    traces = lines.select("task_id", F.to_json(F.struct(F.lit(1).alias("version"), F.col("min_height").cast("double").alias("raw_min"))).alias("trace"))
    made = P.report_manifest(lines.join(of, "task_id"), traces)
    return made.select("report_id", "sha256", F.size(F.from_json("manifest", "task_ids array<long>")["task_ids"]).cast("long").alias("tasks"))


@query("s7_read_trace", """SELECT event_id AS task_id, CASE WHEN event_id % 5 = 0 THEN 'version' WHEN event_id % 5 = 1 THEN 'events' WHEN event_id % 5 = 2 THEN 'number' END AS error, CASE WHEN event_id % 5 > 2 THEN value END AS raw_min, CASE WHEN event_id % 5 > 2 THEN event_id END AS first_sample FROM events""")
def s7(spark, d):
    k = F.col("event_id")
    events = F.when(k % 5 != 1, F.array(F.struct(F.lit("E0001").alias("event_id"), F.array(k).alias("samples"))))
    body = F.struct(F.when(k % 5 == 0, 9).otherwise(1).alias("version"), F.when(k % 5 == 2, float("nan")).otherwise(F.col("value")).alias("raw_min"), events.alias("low_events"))
    e = A.table(spark, d, "events").select(k.alias("task_id"), F.to_json(body).alias("trace"))
    return P.read_analysis_trace(e).select("task_id", "error", "raw_min", F.col("low_events")[0]["samples"][0].alias("first_sample"))
