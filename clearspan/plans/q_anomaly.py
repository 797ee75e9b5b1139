"""Registered queries of the low-event analysis, each with its SQL where SQL can state it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anomaly as N
from . import adapters as A

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def breaking(spark, d):
    """Samples with gaps: no position every 17th row, a leap of 50 m every 23rd, repeated frames, points at the origin."""
    s = A.samples(spark, d)
    i = F.col("sample_index")
    return s.withColumns({
        "odo_x": F.when(i % 17 == 16, F.lit(None).cast("double")).otherwise(F.col("odo_x") + F.floor(i / 23) * 50.0),
        "source_sequence": F.when(i % 13 == 0, F.lit(7)).otherwise(F.col("source_sequence")),
        "point_x": F.when(i % 29 == 0, 0.0).otherwise(F.col("point_x")), "point_y": F.when(i % 29 == 0, 0.0).otherwise(F.col("point_y")), "point_z": F.when(i % 29 == 0, 0.0).otherwise(F.col("point_z")),
    })


BREAKING = A.SAMPLES + """, raw AS (SELECT task_id, sample_index, ts_ns, height, valid, CASE WHEN sample_index % 13 = 0 THEN 7 ELSE source_sequence END AS source_sequence,
  CASE WHEN sample_index % 17 <> 16 THEN odo_x + floor(sample_index / 23.0::DOUBLE) * 50 END AS odo_x, CASE WHEN sample_index % 29 = 0 THEN 0 ELSE point_x END AS point_x, CASE WHEN sample_index % 29 = 0 THEN 0 ELSE point_y END AS point_y, CASE WHEN sample_index % 29 = 0 THEN 0 ELSE point_z END AS point_z FROM samples),
stepped AS (SELECT *, abs(odo_x - lag(odo_x) OVER w) AS step, row_number() OVER w = 1 AS first FROM raw WINDOW w AS (PARTITION BY task_id ORDER BY sample_index)),
flagged AS (SELECT *, coalesce(step <= 10, false) AS good FROM stepped),
travelled AS (SELECT *, good OR (first AND odo_x IS NOT NULL) AS reliable, sum(CASE WHEN good THEN step ELSE 0 END) OVER w AS distance, CAST(sum(CASE WHEN NOT good AND NOT first THEN 1 ELSE 0 END) OVER w AS BIGINT) AS segment FROM flagged WINDOW w AS (PARTITION BY task_id ORDER BY sample_index ROWS UNBOUNDED PRECEDING)),
judged AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY task_id, source_sequence ORDER BY sample_index) > 1 THEN 'duplicate_source_frame' WHEN NOT valid THEN 'device_invalid' WHEN height <= 0 THEN 'invalid_realtime_height' WHEN abs(point_x) <= 1e-12 AND abs(point_y) <= 1e-12 AND abs(point_z) <= 1e-12 THEN 'zero_minimum_point' END AS reason FROM travelled),
usable AS (SELECT * FROM judged WHERE reason IS NULL),
near AS (
  SELECT a.task_id, a.sample_index, any_value(a.distance) AS distance, any_value(a.height) AS height, any_value(a.segment) AS segment, count(*) AS n, max(b.distance) - min(b.distance) AS span, quantile_cont(b.height, 0.7) AS baseline, quantile_cont(b.height, 0.5) AS med, list(b.height) AS hs
  FROM usable a JOIN usable b ON a.task_id = b.task_id AND a.segment = b.segment AND a.reliable AND b.reliable AND b.distance BETWEEN a.distance - 20 AND a.distance + 20 GROUP BY a.task_id, a.sample_index
  UNION ALL
  SELECT a.task_id, a.sample_index, any_value(a.distance), any_value(a.height), any_value(a.segment), count(*), max(b.distance) - min(b.distance), quantile_cont(b.height, 0.7), quantile_cont(b.height, 0.5), list(b.height)
  FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY sample_index) AS k FROM usable) a JOIN (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY sample_index) AS k FROM usable) b ON a.task_id = b.task_id AND b.k BETWEEN a.k - 64 AND a.k + 64 WHERE NOT a.reliable GROUP BY a.task_id, a.sample_index),
based AS (SELECT *, list_aggregate(list_transform(hs, lambda h: abs(h - med)), 'quantile_cont', 0.5) AS mad, baseline - height AS drop_ FROM near),
lows AS (SELECT *, drop_ > greatest(0.5, 6 * 1.4826 * mad) AS low FROM based),
clustered AS (SELECT *, sum(fresh) OVER (PARTITION BY task_id ORDER BY sample_index) AS event FROM (SELECT *, CASE WHEN distance - lag(distance) OVER (PARTITION BY task_id ORDER BY sample_index) <= 2 THEN 0 ELSE 1 END AS fresh FROM lows WHERE low))"""


@query("w1_w2_travel_distance", f"WITH {BREAKING} SELECT task_id, sample_index, round(distance, 6) AS distance, reliable, segment FROM travelled")
def w1(spark, d):
    return N.travel_distance(breaking(spark, d)).select("task_id", "sample_index", F.round("distance", 6).alias("distance"), "reliable", "segment")


@query("w3_duplicate_frames", f"WITH {BREAKING} SELECT task_id, sample_index, reason, reason IS NULL AS usable FROM judged")
def w3(spark, d):
    return N.classify_samples(breaking(spark, d)).select("task_id", "sample_index", "reason", "usable")


@query("w4_w5_local_baseline", f"WITH {BREAKING} SELECT task_id, sample_index, n AS local_count, round(span, 6) AS local_span, round(baseline, 6) AS baseline, round(mad, 6) AS mad, round(drop_, 6) AS drop_m, low FROM lows")
def w4(spark, d):
    rows = N.local_baselines(N.classify_samples(N.travel_distance(breaking(spark, d))))
    return rows.select("task_id", "sample_index", "local_count", *[F.round(c, 6).alias(n) for c, n in (("local_span", "local_span"), ("baseline", "baseline"), ("mad", "mad"), ("drop", "drop_m"))], "low")


#: Drops of 0.3 m make events common enough to test with.
LOOSE = N.AnomalyConfig(absolute_drop=0.3, mad_multiplier=0.5)
LOOSE_SQL = BREAKING.replace("greatest(0.5, 6 * 1.4826 * mad)", "greatest(0.3, 0.5 * 1.4826 * mad)")


def quantile_sql(h: str, q: float) -> str:
    """The query's interpolation between the values of a sorted list, operation by operation: quantile_cont's own differs from it in the last bit, and with it drops that equal the threshold."""
    at = f"((len({h}) - 1) * {q}::DOUBLE)"
    low = f"CAST(floor({at}) AS BIGINT)"
    return f"({h}[{low} + 1] + ({h}[least({low} + 2, len({h}))] - {h}[{low} + 1]) * ({at} - {low}))"


LOOSE_SQL = LOOSE_SQL.replace("quantile_cont(b.height, 0.7) AS baseline, quantile_cont(b.height, 0.5) AS med, list(b.height) AS hs", "list_sort(list(b.height)) AS hs")
LOOSE_SQL = LOOSE_SQL.replace("quantile_cont(b.height, 0.7), quantile_cont(b.height, 0.5), list(b.height)", "list_sort(list(b.height))")
LOOSE_SQL = LOOSE_SQL.replace("based AS (SELECT *, list_aggregate(list_transform(hs, lambda h: abs(h - med)), 'quantile_cont', 0.5) AS mad, baseline - height AS drop_ FROM near)", f"""mid AS (SELECT *, {quantile_sql("hs", 0.7)} AS baseline, {quantile_sql("hs", 0.5)} AS med FROM near),
off AS (SELECT *, list_sort(list_transform(hs, lambda h: abs(h - med))) AS devs FROM mid),
based AS (SELECT *, {quantile_sql("devs", 0.5)} AS mad, baseline - height AS drop_ FROM off)""")


@query("w6_cluster_low_events", f"WITH {LOOSE_SQL} SELECT task_id, sample_index, CAST(event AS BIGINT) AS event FROM clustered")
def w6(spark, d):
    rows = N.local_baselines(N.classify_samples(N.travel_distance(breaking(spark, d))), LOOSE)
    return N.low_events(rows, LOOSE).select("task_id", "sample_index", "event")


@query("a24_event_features", f"""WITH {LOOSE_SQL}, f AS (SELECT task_id, event, count(*) AS n, min(distance) AS s, max(distance) AS e, min(height) AS min_height, quantile_cont(height, 0.5) AS median_height, quantile_cont(baseline, 0.5) AS baseline, max(drop_) AS max_drop FROM clustered GROUP BY ALL),
m AS (SELECT task_id, event, quantile_cont(abs(c.height - f.median_height), 0.5) AS height_mad FROM clustered c JOIN f USING (task_id, event) GROUP BY ALL)
SELECT task_id, printf('E%04d', CAST(event AS BIGINT)) AS event_id, n, round(s, 6) AS start_m, round(e, 6) AS end_m, round(min_height, 6) AS min_height, round(median_height, 6) AS median_height, round(baseline, 6) AS baseline, round(max_drop, 6) AS max_drop, round(height_mad, 6) AS height_mad FROM f JOIN m USING (task_id, event)""")
def a24(spark, d):
    s = N.classify_samples(N.travel_distance(breaking(spark, d)))
    rows = N.local_baselines(s, LOOSE)
    f = N.event_features(N.low_events(rows, LOOSE), N.flanks(s, rows), LOOSE)
    return f.select("task_id", "event_id", "n", *[F.round(c, 6).alias(n) for c, n in (("start", "start_m"), ("end", "end_m"), ("min_height", "min_height"), ("median_height", "median_height"), ("baseline", "baseline"), ("max_drop", "max_drop"), ("height_mad", "height_mad"))])


@query("j18_flanks", f"""WITH {LOOSE_SQL}, n AS (SELECT * FROM lows WHERE NOT low), a AS (SELECT c.task_id, c.sample_index, n.height AS front FROM clustered c ASOF LEFT JOIN n ON c.task_id = n.task_id AND c.sample_index > n.sample_index)
SELECT a.task_id, a.sample_index, round(front, 6) AS front, round(n.height, 6) AS back FROM a ASOF LEFT JOIN n ON a.task_id = n.task_id AND a.sample_index < n.sample_index""")
def j18(spark, d):
    s = N.classify_samples(N.travel_distance(breaking(spark, d)))
    rows = N.local_baselines(s, LOOSE)
    lows = rows.where("low").select("task_id", "sample_index")
    return N.flanks(s, rows).join(lows, ["task_id", "sample_index"]).select("task_id", "sample_index", F.round("before.h", 6).alias("front"), F.round("after.h", 6).alias("back"))


@query("j14_event_pairs", f"""WITH {LOOSE_SQL}, f AS (SELECT task_id, CAST(event AS BIGINT) AS event, (min(distance) + max(distance)) / 2 AS c FROM clustered GROUP BY ALL),
sized AS (SELECT *, count(*) OVER (PARTITION BY task_id) AS n FROM f)
SELECT a.task_id, a.event AS i, b.event AS j, round((b.c - a.c) / (b.event - a.event), 6) AS period, true AS complete FROM sized a JOIN sized b ON a.task_id = b.task_id AND a.event < b.event WHERE a.n <= 128
UNION ALL SELECT DISTINCT task_id, NULL::BIGINT AS i, NULL::BIGINT AS j, NULL::DOUBLE AS period, false AS complete FROM sized WHERE n > 128""")
def j14(spark, d):
    rows = N.local_baselines(N.classify_samples(N.travel_distance(breaking(spark, d))), LOOSE)
    e = N.low_events(rows, LOOSE).groupBy("task_id", "event").agg(((F.min("distance") + F.max("distance")) / 2).alias("centre"))
    return N.event_pairs(e).withColumn("period", F.round("period", 6))


@query("d5_analyze_events")
def d5(spark, d):
    events, _ = N.analyze(A.samples(spark, d), LOOSE)
    return events.select("task_id", "event_id", "n", "group", "score", F.array_join("rules", ",").alias("rules"), "status")


@query("a25_analysis_rollup")
def a25(spark, d):
    return N.analyze(A.samples(spark, d), LOOSE)[1]


@query("s6_analysis_trace")
def s6(spark, d):
    return N.analysis_trace(*N.analyze(A.samples(spark, d), LOOSE))
