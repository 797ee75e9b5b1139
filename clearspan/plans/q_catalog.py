"""Registered queries of the catalogue, fits, health and point clouds, each with its SQL where SQL can state it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import PlaneConfig
from ..operators import align as L
from ..operators import catalog as K
from ..operators import cloud as C
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


def rounded(df, digits: int, *names: str):
    return df.withColumns({n: F.round(n, digits) for n in names})


T, P, J = A.TASKS, A.POINTS, A.TRAJECTORY


@query("j1_with_batches", f"WITH {T} SELECT t.task_id, t.status, c.c_name AS batch, p.lines FROM tasks t JOIN customer c ON c.c_custkey = t.batch_id LEFT JOIN (SELECT l_orderkey, count(*) AS lines FROM lineitem WHERE l_quantity > 30 GROUP BY 1) p ON p.l_orderkey = t.task_id")
def j1(spark, d):
    batches = A.table(spark, d, "customer").select(F.col("c_custkey").alias("batch_id"), F.col("c_name").alias("batch"))
    parameters = A.table(spark, d, "lineitem").where("l_quantity > 30").groupBy(F.col("l_orderkey").alias("task_id")).agg(F.count("*").alias("lines"))
    return K.with_batches(A.tasks(spark, d), batches, parameters).select("task_id", "status", "batch", "lines")


@query("o1_list_tasks", f"WITH {T} SELECT task_id, status FROM tasks WHERE NOT deleted AND status = 'completed' ORDER BY created_at DESC, task_id DESC LIMIT 25 OFFSET 10")
def o1(spark, d):
    return K.list_tasks(A.tasks(spark, d), status="completed", limit=25, offset=10).select("task_id", "status")


@query("o11_latest_batch", f"WITH {T} SELECT batch_id, max(created_at) AS created_at FROM tasks GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 1")
def o11(spark, d):
    return K.latest_batch(A.tasks(spark, d).groupBy("batch_id").agg(F.max("created_at").alias("created_at")))


@query("j12_lookup_all", f"WITH {T}, r AS (SELECT event_id AS position, event_id * 3 AS task_id FROM events) SELECT position, r.task_id, CASE WHEN t.task_id IS NULL THEN 'missing' WHEN status = 'running' THEN 'blocked' ELSE 'found' END AS outcome FROM r LEFT JOIN tasks t USING (task_id)")
def j12(spark, d):
    r = A.table(spark, d, "events").select(F.col("event_id").alias("position"), (F.col("event_id") * 3).alias("task_id"))
    return K.lookup_all(r, A.tasks(spark, d))


@query("j13_idempotent_requests", "WITH r AS (SELECT event_id AS key, event_id % 5 AS hash FROM events), s AS (SELECT o_orderkey AS key, o_orderkey % 4 AS hash, o_orderstatus AS response FROM orders) SELECT r.key, CASE WHEN s.hash IS NULL THEN 'new' WHEN s.hash = r.hash THEN 'reuse' ELSE 'conflict' END AS outcome, CASE WHEN s.hash = r.hash THEN response END AS response FROM r LEFT JOIN s USING (key)")
def j13(spark, d):
    r = A.table(spark, d, "events").select(F.col("event_id").alias("key"), (F.col("event_id") % 5).alias("hash"))
    s = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_orderkey") % 4).alias("hash"), F.col("o_orderstatus").alias("response"))
    return K.idempotent_requests(r, s)


@query("a7_batch_rollup", f"WITH {T} SELECT batch_id, count(*) FILTER (WHERE NOT deleted) AS visible, round(sum(CASE WHEN deleted THEN 0 ELSE size_bytes END), 2) AS bytes, count(*) FILTER (WHERE NOT deleted AND status <> 'completed') AS unfinished FROM tasks GROUP BY 1")
def a7(spark, d):
    return K.batch_rollup(A.tasks(spark, d))


@query("w16_display_ids", f"WITH {T}, r AS (SELECT task_id, strftime(created_at, '%Y%m%d_%H%M%S') AS base FROM tasks), n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY task_id) AS n FROM r) SELECT task_id, CASE WHEN n = 1 THEN base ELSE base || '_' || printf('%02d', n) END AS display_id FROM n")
def w16(spark, d):
    return K.display_ids(A.tasks(spark, d).withColumn("base", F.date_format("created_at", "yyyyMMdd_HHmmss"))).select("task_id", "display_id")


@query("w17_assign_sequences", f"""WITH {T}, r AS (SELECT task_id, batch_id, strftime(created_at, '%Y-%m-%d') AS day FROM tasks), o AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY task_id) AS bs, row_number() OVER (PARTITION BY day ORDER BY task_id) AS ds FROM r WHERE task_id % 2 = 0),
nw AS (SELECT r.*, coalesce(b, 0) + row_number() OVER (PARTITION BY r.batch_id ORDER BY task_id) AS batch_sequence, coalesce(dd, 0) + row_number() OVER (PARTITION BY r.day ORDER BY task_id) AS day_sequence FROM r LEFT JOIN (SELECT batch_id, max(bs) AS b FROM o GROUP BY 1) x ON x.batch_id = r.batch_id LEFT JOIN (SELECT day, max(ds) AS dd FROM o GROUP BY 1) y ON y.day = r.day WHERE task_id % 2 = 1)
SELECT task_id, batch_sequence, day_sequence, replace(day, '-', '') || '-' || printf('%02d', day_sequence) AS code FROM nw""")
def w17(spark, d):
    from pyspark.sql import Window as W

    r = A.tasks(spark, d).select("task_id", "batch_id", F.date_format("created_at", "yyyy-MM-dd").alias("day"))
    old = r.where("task_id % 2 = 0").withColumn("batch_sequence", F.row_number().over(W.partitionBy("batch_id").orderBy("task_id"))).withColumn("day_sequence", F.row_number().over(W.partitionBy("day").orderBy("task_id")))
    return K.assign_sequences(r.where("task_id % 2 = 1"), old).select("task_id", "batch_sequence", "day_sequence", "code")


@query("d8_export_eligibility", f"WITH {T}, s AS (SELECT user_id AS task_id, count(*) FILTER (WHERE value > 20) AS n_valid, min(value) FILTER (WHERE value > 60) AS effective_min FROM events GROUP BY 1) SELECT t.task_id, CASE WHEN n_valid IS NULL THEN 'no_data' WHEN status <> 'completed' THEN 'status' WHEN t.task_id % 7 = 0 THEN 'fixture' WHEN t.task_id % 5 = 0 THEN 'incomplete' WHEN n_valid = 0 THEN 'no_valid_samples' WHEN effective_min IS NULL THEN 'no_effective_minimum' END AS blocked_by FROM tasks t LEFT JOIN s USING (task_id)")
def d8(spark, d):
    s = A.table(spark, d, "events").groupBy(F.col("user_id").alias("task_id")).agg(F.count(F.when(F.col("value") > 20, 1)).alias("n_valid"), F.min(F.when(F.col("value") > 60, F.col("value"))).alias("effective_min"))
    t = A.tasks(spark, d).withColumn("origin", F.when(F.col("task_id") % 7 == 0, "test_fixture").otherwise("recorded")).withColumn("complete", F.col("task_id") % 5 != 0)
    return K.export_eligibility(t.join(s, "task_id", "left")).select("task_id", "blocked_by")


@query("d15_task_timeline", "WITH l AS (SELECT user_id AS task_id, max_by(event_type, struct_pack(a := ts, b := event_id)) AS phase, max(epoch_us(ts)) AS us FROM events GROUP BY 1) SELECT task_id, phase, coalesce((1706600000000000 - us) / 1e6::DOUBLE > CASE phase WHEN 'click' THEN 20000.0 WHEN 'view' THEN 50000.0 END, false) AS overdue FROM l")
def d15(spark, d):
    e = A.table(spark, d, "events").select(F.col("user_id").alias("task_id"), A.micros().alias("us"), "event_id", F.col("event_type").alias("phase"))
    return K.task_timeline(e, {"click": 20_000.0, "view": 50_000.0}, 1_706_600_000_000_000)[1].select("task_id", "phase", "overdue")


@query("a6_recording_counters", f"WITH {A.SAMPLES}, st AS (SELECT user_id AS task_id, max(epoch_us(ts)) * 1000 AS stop_ns FROM events WHERE event_type = 'purchase' AND user_id % 3 > 0 GROUP BY 1) SELECT s.task_id, count(*) AS rows, count(*) FILTER (WHERE valid) AS valid_rows FROM samples s LEFT JOIN st USING (task_id) WHERE stop_ns IS NULL OR ts_ns <= stop_ns GROUP BY 1")
def a6(spark, d):
    stops = A.stream_of(spark, d, "purchase").where("task_id % 3 > 0").groupBy("task_id").agg(F.max("t").alias("stop_ns"))
    return K.recording_counters(A.samples(spark, d), stops)


@query("a9_processing_diagnostics", "SELECT user_id AS task_id, CASE WHEN event_type = 'view' THEN 'processed' ELSE event_type END AS reason, count(*) AS n, max_by(value, event_id) AS last_wait, round(avg(value), 6) AS mean_wait, max(value) AS max_wait FROM events GROUP BY 1, 2")
def a9(spark, d):
    f = A.table(spark, d, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("frame_id"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("reason"), F.col("value").alias("wait_ms"))
    return rounded(K.processing_diagnostics(f), 6, "mean_wait")


@query("a29_device_levels", "SELECT event_id, CASE WHEN event_id % 4 = 3 AND value <= 5 THEN 'error' WHEN (event_id % 4 = 0 AND value >= 80) OR (event_id % 4 = 1 AND value >= 85) OR (event_id % 4 = 2 AND value >= 90) OR (event_id % 4 = 3 AND value <= 20) THEN 'warning' ELSE 'ok' END AS level FROM events")
def a29(spark, d):
    names = F.array(*[F.lit(n) for n in ("temperature", "memory", "cpu", "storage_free_gib")])
    m = A.table(spark, d, "events").withColumn("metric", F.get(names, (F.col("event_id") % 4).cast("int")))
    return K.device_levels(m).select("event_id", "level")


@query("w24_counter_delta", "WITH r AS (SELECT user_id AS task_id, event_id AS seq, event_id * 10 AS total, event_id * 7 + event_id % 5 AS idle FROM events), g AS (SELECT *, total - lag(total) OVER w AS dt, idle - lag(idle) OVER w AS di FROM r WINDOW w AS (PARTITION BY task_id ORDER BY seq)) SELECT task_id, seq, round(CASE WHEN dt > 0 THEN 100.0 * (dt - di) / dt END, 6) AS busy_percent FROM g")
def w24(spark, d):
    k = F.col("event_id")
    r = A.table(spark, d, "events").select(F.col("user_id").alias("task_id"), k.alias("seq"), (k * 10).alias("total"), (k * 7 + k % 5).alias("idle"))
    return rounded(K.counter_delta_percent(r).select("task_id", "seq", "busy_percent"), 6, "busy_percent")


@query("w21_track_segments", """WITH r AS (SELECT user_id AS task_id, epoch_us(ts) AS t, event_id AS seq, floor(value / 40) AS x, 0.0::DOUBLE AS y, event_type = 'view' AS source FROM events), m AS (SELECT * FROM (SELECT *, lag(x) OVER (PARTITION BY task_id ORDER BY t, seq) AS px FROM r) WHERE px IS NULL OR px <> x),
f AS (SELECT *, CASE WHEN source = lag(source) OVER (PARTITION BY task_id ORDER BY t, seq) THEN 0 ELSE 1 END AS fresh, lag(x) OVER (PARTITION BY task_id ORDER BY t, seq) IS NOT NULL AS b FROM m), l AS (SELECT *, sum(fresh) OVER (PARTITION BY task_id ORDER BY t, seq) AS line FROM f)
SELECT task_id, CAST(line AS BIGINT) AS line, CASE WHEN any_value(source) THEN 'a' ELSE 'b' END AS source, count(*) + CASE WHEN min(line) > 1 THEN 1 ELSE 0 END AS n FROM l GROUP BY task_id, line""")
def w21(spark, d):
    r = A.table(spark, d, "events").select(F.col("user_id").alias("task_id"), A.micros().alias("t"), F.col("event_id").alias("seq"), F.floor(F.col("value") / 40).alias("x"), F.lit(0.0).alias("y"), F.when(F.col("event_type") == "view", "a").otherwise("b").alias("source"))
    return K.track_segments(r).select("task_id", "line", "source", F.size("vertices").cast("long").alias("n"))


@query("a18_similarity_fit", f"WITH {J} SELECT task_id, count(*) AS n, 1.01::DOUBLE AS scale, round(radians(30), 6) AS yaw, 100.0::DOUBLE AS tx, -50.0::DOUBLE AS ty, 0.0::DOUBLE AS rms, 'NONE' AS reason FROM trajectory GROUP BY 1")
def a18(spark, d):
    return rounded(L.similarity_fit(A.trajectory(spark, d)).drop("baseline"), 6, "scale", "yaw", "tx", "ty", "rms").withColumn("rms", F.abs("rms"))


@query("a19_rigid_heading_fit")
def a19(spark, d):
    return L.rigid_heading_fit(A.trajectory(spark, d))


@query("w13_spacing_filter", f"""WITH RECURSIVE {J}, o AS (SELECT task_id, stamp_ns, x, y, row_number() OVER (PARTITION BY task_id ORDER BY stamp_ns, line, x, y) AS seq, seq AS k FROM trajectory),
f AS (SELECT task_id, seq, k, stamp_ns, x, y, true AS kept FROM o WHERE k = 1
  UNION ALL SELECT o.task_id, o.seq, o.k, CASE WHEN ok THEN o.stamp_ns ELSE f.stamp_ns END, CASE WHEN ok THEN o.x ELSE f.x END, CASE WHEN ok THEN o.y ELSE f.y END, ok
  FROM f JOIN o ON o.task_id = f.task_id AND o.k = f.k + 1, LATERAL (SELECT o.stamp_ns > f.stamp_ns AND sqrt(pow(o.x - f.x, 2) + pow(o.y - f.y, 2)) >= 20 AS ok))
SELECT task_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY k DESC) AS n FROM f WHERE kept) WHERE n <= 100""")
def w13(spark, d):
    from pyspark.sql import Window as W

    order = F.row_number().over(W.partitionBy("task_id").orderBy("stamp_ns", "line", "x", "y")).cast("long")
    return L.spacing_filter(A.trajectory(spark, d).withColumn("seq", order).drop("line"), 20.0).select("task_id", "seq")


FITS = """fits AS (SELECT user_id AS task_id, event_id AS seq, event_id % 13 > 0 AS fit_valid, event_id % 7 + 1 AS n, value * 3 AS baseline, 0.65::DOUBLE + event_id % 9 * 0.08::DOUBLE AS ratio, (event_id % 17) * 1.0::DOUBLE AS rmse, (event_id % 28) * 1.0::DOUBLE AS p95,
  0.66::DOUBLE + event_id % 5 * 0.08::DOUBLE AS inlier_ratio, event_id % 97 * 0.0015::DOUBLE AS yaw, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
gated AS (SELECT *, CASE WHEN NOT fit_valid THEN 'DEGENERATE' WHEN n < 3 THEN 'INSUFFICIENT_SAMPLES' WHEN baseline < 50 THEN 'COLLECTING_BASELINE' WHEN ratio NOT BETWEEN 0.7 AND 1.3 THEN 'BASELINE_RATIO_OUT_OF_RANGE' WHEN rmse > 15 THEN 'RMSE_TOO_LARGE' WHEN p95 > 25 THEN 'P95_RESIDUAL_TOO_LARGE' WHEN inlier_ratio < 0.7 THEN 'INLIER_RATIO_TOO_LOW' END AS gate FROM fits)"""


@query("w14_heading_filter", f"""WITH RECURSIVE {FITS},
f AS (SELECT task_id, 0::BIGINT AS seq, 0::BIGINT AS k, NULL::DOUBLE AS now, NULL::DOUBLE AS yaw, NULL::VARCHAR AS gate, false AS jump, NULL::DOUBLE AS baseline FROM fits GROUP BY task_id
  UNION ALL SELECT g.task_id, g.seq, g.k, CASE WHEN g.gate IS NOT NULL OR far THEN f.now WHEN f.now IS NULL THEN g.yaw ELSE f.now + 0.1 * (g.yaw - f.now) END, CASE WHEN g.gate IS NOT NULL THEN g.yaw END, g.gate, g.gate IS NULL AND far, g.baseline
  FROM f JOIN gated g ON g.task_id = f.task_id AND g.k = f.k + 1, LATERAL (SELECT coalesce(abs(g.yaw - f.now) > 0.08726646259971647, false) AS far))
SELECT task_id, seq, round(coalesce(yaw, now), 9) AS yaw, CASE WHEN gate IS NOT NULL THEN gate = 'COLLECTING_BASELINE' ELSE NOT jump END AS accepted, gate IS NULL AND NOT jump AND baseline >= 100 AS valid,
  CASE WHEN gate IS NOT NULL THEN gate WHEN jump THEN 'UPDATE_JUMP_EXCEEDED' WHEN baseline >= 100 THEN 'NONE' ELSE 'PROVISIONAL_BASELINE' END AS reason FROM f WHERE k > 0""")
def w14(spark, d):
    k = F.col("event_id")
    fits = A.table(spark, d, "events").select(F.col("user_id").alias("task_id"), k.alias("seq"), (k % 13 > 0).alias("fit_valid"), F.lit("DEGENERATE").alias("fit_reason"), (k % 7 + 1).alias("n"), (F.col("value") * 3).alias("baseline"), (0.65 + k % 9 * 0.08).alias("ratio"),
        (k % 17).cast("double").alias("rmse"), (k % 28).cast("double").alias("p95"), (0.66 + k % 5 * 0.08).alias("inlier_ratio"), (k % 97 * 0.0015).alias("yaw"))
    return rounded(L.heading_filter(fits), 9, "yaw")


@query("w23_rate_limit", f"""WITH RECURSIVE {A.stream_sql('v', 'view')}, o AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY t, seq) AS k FROM v),
f AS (SELECT task_id, seq, k, t AS last, true AS run FROM o WHERE k = 1 UNION ALL SELECT o.task_id, o.seq, o.k, CASE WHEN t - last >= {40 * 3_600_000_000_000} THEN t ELSE last END, t - last >= {40 * 3_600_000_000_000} FROM f JOIN o ON o.task_id = f.task_id AND o.k = f.k + 1)
SELECT task_id, seq FROM f WHERE run""")
def w23(spark, d):
    return L.rate_limit(A.stream_of(spark, d, "view"), 40 * 3_600_000_000_000).select("task_id", "seq")


@query("a10_voxel_centroids", f"WITH {P} SELECT frame_id, CAST(floor(x / 0.5) AS BIGINT) AS vx, CAST(floor(y / 0.5) AS BIGINT) AS vy, CAST(floor(z / 0.5) AS BIGINT) AS vz, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM points GROUP BY ALL")
def a10(spark, d):
    return rounded(C.voxel_centroids(A.points(spark, d), 0.5), 6, "x", "y", "z")


@query("a11_voxel_representatives", f"WITH {P} SELECT frame_id, min(point_idx) AS point_idx FROM points GROUP BY frame_id, floor(x / 2), floor(y / 2), floor(z / 2)")
def a11(spark, d):
    return C.voxel_representatives(A.points(spark, d), 2.0).select("frame_id", "point_idx")


@query("a12_grid_occupancy", f"WITH {P}, c AS (SELECT DISTINCT frame_id, floor(x / 0.5) AS cx, floor(y / 0.5) AS cy FROM points) SELECT frame_id, count(*) AS cells, CAST(max(cx) - min(cx) + 1 AS BIGINT) AS span_x, CAST(max(cy) - min(cy) + 1 AS BIGINT) AS span_y, count(*) * 0.25::DOUBLE AS area FROM c GROUP BY 1")
def a12(spark, d):
    return C.grid_occupancy(C.grid_cells(A.points(spark, d), 0.5), 0.5)


@query("a13_cell_components", f"""WITH RECURSIVE {P}, c AS (SELECT DISTINCT frame_id, CAST(floor(x / 0.5) AS BIGINT) AS cx, CAST(floor(y / 0.5) AS BIGINT) AS cy FROM points),
n AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY cx, cy) - 1 AS k FROM c), e AS (SELECT a.frame_id, a.k AS a, b.k AS b FROM n a JOIN n b ON a.frame_id = b.frame_id AND abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1),
r AS (SELECT frame_id, k AS s, k FROM n UNION SELECT r.frame_id, r.s, e.b FROM r JOIN e ON r.frame_id = e.frame_id AND r.k = e.a)
SELECT n.frame_id, n.cx, n.cy, min(r.s) AS component FROM n JOIN r ON r.frame_id = n.frame_id AND r.k = n.k GROUP BY ALL""")
def a13(spark, d):
    return C.label_cells(C.grid_cells(A.points(spark, d), 0.5))


@query("j17_cell_neighbours", f"WITH {P}, c AS (SELECT DISTINCT frame_id, CAST(floor(x / 0.5) AS BIGINT) AS cx, CAST(floor(y / 0.5) AS BIGINT) AS cy FROM points) SELECT a.frame_id, a.cx AS ax, a.cy AS ay, b.cx AS bx, b.cy AS by FROM c a JOIN c b ON a.frame_id = b.frame_id AND abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1 AND NOT (a.cx = b.cx AND a.cy = b.cy)")
def j17(spark, d):
    return C.cell_neighbours(C.grid_cells(A.points(spark, d), 0.5))


PLANE = "(0.1 * x - 0.2 * y + z - 5) / sqrt(1.05)"


def planes(spark, d):
    return A.points(spark, d).select("frame_id").distinct().select("frame_id", F.lit(0.1).alias("a"), F.lit(-0.2).alias("b"), F.lit(1.0).alias("c"), F.lit(-5.0).alias("d"))


@query("j15_plane_inliers", f"WITH {P} SELECT frame_id, point_idx, round(abs{PLANE}, 6) AS off FROM points WHERE abs{PLANE} <= 0.8".replace("abs(0.1", "abs((0.1").replace("sqrt(1.05)", "sqrt(1.05))"))
def j15(spark, d):
    return rounded(C.plane_inliers(A.points(spark, d), planes(spark, d), 0.8).select("frame_id", "point_idx", "off"), 6, "off")


@query("u4_subtract_inliers", f"WITH {P} SELECT frame_id, point_idx FROM points WHERE abs({PLANE}) > 0.8")
def u4(spark, d):
    p = A.points(spark, d)
    return C.subtract(p, C.plane_inliers(p, planes(spark, d), 0.8)).select("frame_id", "point_idx")


@query("a15_residual_quantiles", f"WITH {P} SELECT frame_id, round(quantile_cont(abs({PLANE}), 0.5), 6) AS median, round(quantile_cont(abs({PLANE}), 0.95), 6) AS p95 FROM points GROUP BY 1")
def a15(spark, d):
    return rounded(C.residual_quantiles(C.plane_inliers(A.points(spark, d), planes(spark, d), 1e9), "off"), 6, "median", "p95")


@query("a14_a21_plane_fit")
def a14(spark, d):
    return C.plane_fit(A.points(spark, d))


@query("j6_nearest_point", f"WITH {P}, q AS (SELECT *, sqrt(pow(x - 1, 2) + pow(y, 2) + pow(z - 5, 2)) AS dist FROM points) SELECT frame_id, min_by(point_idx, struct_pack(a := dist, b := point_idx)) AS point_idx, round(min(dist), 6) AS distance FROM q GROUP BY 1")
def j6(spark, d):
    t = A.points(spark, d).select("frame_id").distinct().select("frame_id", F.lit(1.0).alias("tx"), F.lit(0.0).alias("ty"), F.lit(5.0).alias("tz"))
    return rounded(C.nearest_point(A.points(spark, d), t), 6, "distance")


@query("o5_even_limit", f"WITH {P}, r AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY point_idx) - 1 AS k, count(*) OVER (PARTITION BY frame_id) AS n FROM points) SELECT frame_id, point_idx FROM r WHERE n <= 20 OR list_contains(list_transform(range(20), lambda i: i * n // 20), k)")
def o5(spark, d):
    return C.even_limit(A.points(spark, d), 20).select("frame_id", "point_idx")


@query("o6_spatial_limit")
def o6(spark, d):
    return C.spatial_limit(A.points(spark, d), 30, 8.0).select("frame_id", "point_idx")


@query("o7_stride_limit", f"WITH {P}, r AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY point_idx) - 1 AS k, count(*) OVER (PARTITION BY frame_id) AS n FROM points) SELECT frame_id, point_idx FROM r WHERE k % CAST(ceil(n / 20.0) AS BIGINT) = 0")
def o7(spark, d):
    return C.stride_limit(A.points(spark, d), 20).select("frame_id", "point_idx")


@query("a30_frame_end_stamp", f"WITH {P} SELECT frame_id, frame_id * 1000000000 + CAST(round(max(offset_s) * 1e9) AS BIGINT) AS end_ns FROM points GROUP BY 1")
def a30(spark, d):
    stamps = A.points(spark, d).select("frame_id").distinct().withColumn("stamp_ns", F.col("frame_id") * 1_000_000_000)
    return C.frame_end_stamp(A.points(spark, d), stamps)


MOTION = f"""{P}, raw AS (SELECT frame_id, point_idx, CASE WHEN point_idx % 23 = 0 THEN 0 ELSE x END AS x, CASE WHEN point_idx % 23 = 0 THEN 0 ELSE y END AS y, CASE WHEN point_idx % 23 = 0 THEN 0 WHEN point_idx % 19 = 0 THEN 'inf'::DOUBLE ELSE z END AS z, CASE WHEN point_idx % 17 = 0 THEN -1 ELSE offset_s END AS offset_s, (frame_id + 1) * 300000000 AS stamp FROM points),
timed AS (SELECT *, isfinite(z) AND NOT (x = 0 AND y = 0 AND z = 0) AS usable, CASE WHEN isfinite(z) AND NOT (x = 0 AND y = 0 AND z = 0) AND offset_s >= 0 THEN stamp + CAST(round(offset_s * 1e9) AS BIGINT) END AS t FROM raw),
poses AS (SELECT event_id * 4000000 AS t, value / 200 + event_id * 0.004 AS px, event_id % 100 / 500.0::DOUBLE AS py, 0.0::DOUBLE AS pz, cos(event_id % 1000 / 500.0::DOUBLE / 2) AS qw, sin(event_id % 1000 / 500.0::DOUBLE / 2) AS qz, event_id % 613 > 0 AS ok FROM events WHERE event_id % 50 > 8),
times AS (SELECT DISTINCT frame_id, stamp, t FROM timed WHERE t IS NOT NULL UNION SELECT DISTINCT frame_id, stamp, stamp FROM timed),
lo AS (SELECT q.*, p.t AS ta, p.px AS ax, p.py AS ay, p.qw AS aw, p.qz AS az, p.ok AS aok FROM times q ASOF LEFT JOIN poses p ON q.t >= p.t),
hi AS (SELECT lo.*, p.t AS tb, p.px AS bx, p.py AS by_, p.qw AS bw, p.qz AS bz, p.ok AS bok FROM lo ASOF LEFT JOIN poses p ON lo.t <= p.t),
r0 AS (SELECT *, coalesce(ta = t, false) OR coalesce(tb > ta AND tb - ta <= 15000000, false) AS found, CASE WHEN ta = t THEN 0 ELSE (t - ta) / (tb - ta)::DOUBLE END AS u, abs(aw * bw + az * bz) AS dot, CASE WHEN aw * bw + az * bz < 0 THEN -1 ELSE 1 END AS sign FROM hi),
r1 AS (SELECT *, CASE WHEN u = 0 THEN 1 WHEN dot > 0.9995 THEN 1 - u ELSE sin((1 - u) * acos(least(dot, 1))) / sin(acos(least(dot, 1))) END AS wa, CASE WHEN u = 0 THEN 0 WHEN dot > 0.9995 THEN u ELSE sin(u * acos(least(dot, 1))) / sin(acos(least(dot, 1))) END * sign AS wb FROM r0),
at_ AS (SELECT frame_id, stamp, t, found, CASE WHEN u = 0 THEN ax ELSE ax + (bx - ax) * u END AS px, CASE WHEN u = 0 THEN ay ELSE ay + (by_ - ay) * u END AS py, CASE WHEN u = 0 THEN aok ELSE aok AND bok END AS ok, aw * wa + bw * wb AS w0, az * wa + bz * wb AS z0 FROM r1),
own AS (SELECT frame_id, found AND ok AS good, px AS rx, py AS ry FROM at_ WHERE t = stamp),
sh AS (SELECT a.frame_id, max(sqrt(pow(px - rx, 2) + pow(py - ry, 2))) AS far, bool_or(NOT ok OR sqrt(pow(px - rx, 2) + pow(py - ry, 2)) > 2.5) AS out_ FROM at_ a JOIN own USING (frame_id) WHERE found AND EXISTS (SELECT 1 FROM timed m WHERE m.frame_id = a.frame_id AND m.t = a.t) GROUP BY a.frame_id),
cnt AS (SELECT p.frame_id, count(*) FILTER (WHERE usable) AS usable, count(*) FILTER (WHERE usable AND p.t IS NULL) AS bad_time, count(*) FILTER (WHERE found) AS covered, count(*) FILTER (WHERE p.t IS NOT NULL AND NOT found) AS uncovered FROM timed p LEFT JOIN at_ a ON a.frame_id = p.frame_id AND a.t = p.t GROUP BY p.frame_id),
stats AS (SELECT frame_id, usable, bad_time, covered, uncovered, CASE WHEN usable > 0 THEN covered / usable ELSE 0 END AS ratio, CASE WHEN good THEN far END AS max_translation, CASE WHEN coalesce(good AND NOT coalesce(out_, false), false) THEN 'FULL' ELSE 'ROTATION_ONLY' END AS mode,
  CASE WHEN usable = 0 THEN 'NO_VALID_RAW_POINTS' WHEN covered = 0 THEN 'NO_POINT_POSE_COVERED' WHEN covered / usable < 0.75 THEN 'INSUFFICIENT_POSE_COVERAGE' ELSE 'NONE' END AS reason FROM cnt JOIN own USING (frame_id) LEFT JOIN sh USING (frame_id))"""


def motion(spark, d):
    """Points, frames and poses: some points are the invalid return, infinite or without a time, and some poses are missing or have no valid place."""
    i = F.col("point_idx")
    p = A.points(spark, d)
    p = p.withColumns({c: F.when(i % 23 == 0, 0.0).otherwise(F.when(i % 19 == 0, float("inf")).otherwise(F.col(c)) if c == "z" else F.col(c)) for c in "xyz"}).withColumn("offset_s", F.when(i % 17 == 0, -1.0).otherwise(F.col("offset_s")))
    frames = p.select("frame_id").distinct().select("frame_id", F.lit(1).cast("long").alias("task_id"), ((F.col("frame_id") + 1) * 300_000_000).alias("stamp_ns"))
    k, yaw = F.col("event_id"), F.col("event_id") % 1000 / 500
    poses = A.table(spark, d, "events").where("event_id % 50 > 8").select(F.lit(1).cast("long").alias("task_id"), (k * 4_000_000).alias("t"), k.alias("seq"), (F.col("value") / 200 + k * 0.004).alias("px"), (k % 100 / 500).alias("py"), F.lit(0.0).alias("pz"),
        F.cos(yaw / 2).alias("qw"), F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.sin(yaw / 2).alias("qz"), (k % 613 > 0).alias("ok"))
    return p, frames, poses


@query("a23_transform_statistics", f"WITH {MOTION} SELECT frame_id, usable, bad_time, covered, uncovered, round(ratio, 6) AS ratio, round(max_translation, 6) AS max_translation, mode, reason FROM stats")
def a23(spark, d):
    return rounded(C.motion_compensate(*motion(spark, d))[1], 6, "ratio", "max_translation")


@query("d4_motion_compensate", f"""WITH {MOTION}, j AS (SELECT p.*, a.found, a.w0 / sqrt(w0 * w0 + z0 * z0) AS w, a.z0 / sqrt(w0 * w0 + z0 * z0) AS q, CASE WHEN mode = 'FULL' THEN px - rx ELSE 0 END AS dx, CASE WHEN mode = 'FULL' THEN py - ry ELSE 0 END AS dy
  FROM timed p JOIN stats s ON s.frame_id = p.frame_id AND s.reason = 'NONE' JOIN own o ON o.frame_id = p.frame_id LEFT JOIN at_ a ON a.frame_id = p.frame_id AND a.t = p.t)
SELECT 1::BIGINT AS task_id, frame_id, point_idx, round(CASE WHEN x = 0 AND y = 0 AND z = 0 AND offset_s >= 0 THEN 0 WHEN found THEN (1 - 2 * q * q) * x - 2 * w * q * y + dx ELSE 'nan'::DOUBLE END, 3) AS x,
  round(CASE WHEN x = 0 AND y = 0 AND z = 0 AND offset_s >= 0 THEN 0 WHEN found THEN 2 * w * q * x + (1 - 2 * q * q) * y + dy ELSE 'nan'::DOUBLE END, 3) AS y, round(CASE WHEN x = 0 AND y = 0 AND z = 0 AND offset_s >= 0 THEN 0 WHEN found THEN z ELSE 'nan'::DOUBLE END, 3) AS z FROM j""")
def d4(spark, d):
    return C.motion_compensate(*motion(spark, d))[0].withColumns({c: F.round(F.col(c).cast("double"), 3) for c in "xyz"})


@query("o9_lowest_candidate")
def o9(spark, d):
    c = A.points(spark, d).select("frame_id", F.col("point_idx").alias("order"), F.when(F.col("point_idx") % 3 == 0, "PLANE").otherwise("SURFACE").alias("kind"), F.col("z").alias("height"), (F.col("offset_s") * 5).alias("confidence"))
    return C.lowest_candidate(c)


@query("d1_detect_planes")
def d1(spark, d):
    return C.detect_planes(A.points(spark, d), PlaneConfig(distance=0.4, voxel=0.2, max_planes=2, min_remaining=10, min_inliers=8, grid=0.8, span_cells=2, cells=4, residual_p95=0.5, iterations=60))
