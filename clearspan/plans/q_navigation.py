"""Registered queries of navigation, surfaces and replays, each with its SQL where SQL can state it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import SurfaceConfig
from ..functions import geodesy as G
from ..functions.geodesy import llh_to_enu
from ..operators import catalog as K
from ..operators import navigation as N
from ..operators import surface as S
from ..operators.align import spacing_filter
from . import adapters as A

HOUR = 3_600_000_000_000
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


P = A.POINTS


def anchored(spark, d):
    k, u = F.col("event_id"), F.col("user_id")
    e = A.table(spark, d, "events")
    poses = e.select(u.alias("task_id"), k.alias("t"), F.col("value").alias("x"), (k % 50).cast("double").alias("y"), F.when(k % 31 == 0, float("nan")).otherwise(k % 7).alias("z"))
    anchors = e.select(u.alias("task_id")).distinct().select("task_id", (30 + F.col("task_id") % 9 * 0.1).alias("lat0"), (114 + F.col("task_id") % 7 * 0.1).alias("lon0"), F.lit(20.0).alias("alt0"), F.lit(1.0).alias("x0"), F.lit(2.0).alias("y0"), F.lit(0.5).alias("z0"), F.lit(0.3).alias("yaw"), F.lit(1.02).alias("horizontal"), F.lit(1.0).alias("vertical"))
    return poses, anchors


@query("p32_dead_reckoning", """WITH p AS (SELECT user_id AS task_id, event_id AS t, 1.02 * (value - 1) AS a, 1.02 * (event_id % 50 - 2) AS b, event_id % 7 - 0.5::DOUBLE AS up, event_id % 31 > 0 AS ok FROM events)
SELECT task_id, t, round(CASE WHEN ok THEN cos(0.3) * a - sin(0.3) * b END, 6) AS east, round(CASE WHEN ok THEN sin(0.3) * a + cos(0.3) * b END, 6) AS north, round(CASE WHEN ok THEN up END, 6) AS up, round(CASE WHEN ok THEN sqrt(a * a + b * b) END, 6) AS distance, CASE WHEN ok THEN 'NONE' ELSE 'INVALID_ANCHOR_OR_ODIN' END AS reason, ok AS back FROM p""")
def p32(spark, d):
    poses, anchors = anchored(spark, d)
    out = N.propagate_dead_reckoning(poses, anchors).join(anchors.select("task_id", "lat0", "lon0", "alt0"), "task_id")
    again = llh_to_enu(F.col("lat0"), F.col("lon0"), F.col("alt0"), F.col("lat"), F.col("lon"), F.col("alt"))
    back = F.coalesce((F.abs(again["east"] - F.col("east")) < 1e-4) & (F.abs(again["north"] - F.col("north")) < 1e-4), F.lit(False))
    return rounded(out.select("task_id", "t", "east", "north", "up", "distance", "reason", back.alias("back")), 6, "east", "north", "up", "distance")


@query("w12_strapdown", """WITH r AS (SELECT user_id AS task_id, epoch_us(ts) AS t, event_id AS seq, value / 10 - 4 AS ax, CASE WHEN event_id % 37 = 0 THEN 90.0 ELSE event_id % 11 - 5.0::DOUBLE END AS ay, 1.0::DOUBLE AS az FROM events),
g AS (SELECT *, (t - lag(t) OVER w) / 1e9::DOUBLE AS dt FROM r WINDOW w AS (PARTITION BY task_id ORDER BY t, seq)),
s AS (SELECT *, CASE WHEN dt IS NULL THEN 'START' WHEN dt > 60 THEN 'IMU_TIME_GAP' WHEN sqrt(ax * ax + ay * ay + az * az) > 50 THEN 'IMU_ACCELERATION_OUTLIER' ELSE 'NONE' END AS status FROM g),
n AS (SELECT *, coalesce(lag(status = 'NONE') OVER w, false) AS near, lag(ax) OVER w AS bx, lag(ay) OVER w AS by_ FROM s WINDOW w AS (PARTITION BY task_id ORDER BY t, seq)),
m AS (SELECT *, CASE WHEN status <> 'NONE' THEN 0 WHEN near THEN (ax + bx) / 2 ELSE ax END AS mx, CASE WHEN status <> 'NONE' THEN 0 WHEN near THEN (ay + by_) / 2 ELSE ay END AS my, CASE WHEN status = 'NONE' THEN dt ELSE 0 END AS d FROM n),
v AS (SELECT *, sum(mx * d) OVER w AS vx, sum(my * d) OVER w AS vy FROM m WINDOW w AS (PARTITION BY task_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING))
SELECT task_id, seq, status, round(vx, 4) AS vx, round(vy, 4) AS vy, round(sum((vx - mx * d) * d + 0.5 * mx * d * d) OVER w, 3) AS px, round(sum((vy - my * d) * d + 0.5 * my * d * d) OVER w, 3) AS py FROM v WINDOW w AS (PARTITION BY task_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING)""")
def w12(spark, d):
    k = F.col("event_id")
    # specific force in a body turned by 90 degrees about the vertical: forward is the local y axis
    e = A.table(spark, d, "events").select(F.col("user_id").alias("task_id"), A.micros().alias("t"), k.alias("seq"), F.when(k % 37 == 0, 90.0).otherwise(k % 11 - 5.0).alias("fx"), (4 - F.col("value") / 10).alias("fy"), F.lit(N.GRAVITY + 1.0).alias("fz"), F.sqrt(F.lit(0.5)).alias("qw"), F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.sqrt(F.lit(0.5)).alias("qz"))
    out = N.strapdown_integrate(e, max_step_s=60.0)
    return rounded(rounded(out.select("task_id", "seq", "status", "vx", "vy", "px", "py"), 4, "vx", "vy"), 3, "px", "py")


@query("w15_scale_filter", """WITH RECURSIVE o AS (SELECT user_id AS task_id, event_id AS seq, CASE event_id % 6 WHEN 0 THEN 'BASELINE_TOO_SHORT' WHEN 1 THEN 'SCALE_OUT_OF_RANGE' ELSE 'NONE' END AS reason, 1 + value / 1000 AS scale, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
f AS (SELECT task_id, 0::BIGINT AS seq, 0::BIGINT AS k, NULL::DOUBLE AS now, '' AS reason FROM o GROUP BY 1 UNION ALL SELECT o.task_id, o.seq, o.k, CASE WHEN o.reason <> 'NONE' THEN now WHEN now IS NULL THEN scale ELSE now + 0.1 * (scale - now) END, o.reason FROM f JOIN o ON o.task_id = f.task_id AND o.k = f.k + 1)
SELECT task_id, seq, round(coalesce(now, 1), 9) AS scale, CASE reason WHEN 'NONE' THEN 'VALID' WHEN 'BASELINE_TOO_SHORT' THEN 'COLLECTING' ELSE 'REJECTED' END AS status FROM f WHERE k > 0""")
def w15(spark, d):
    k = F.col("event_id")
    fits = A.table(spark, d, "events").select(F.col("user_id").alias("task_id"), k.alias("seq"), F.when(k % 6 == 0, "BASELINE_TOO_SHORT").when(k % 6 == 1, "SCALE_OUT_OF_RANGE").otherwise("NONE").alias("reason"), (1 + F.col("value") / 1000).alias("scale"))
    return rounded(N.scale_filter(fits), 9, "scale")


@query("w20_recovery_blend", f"""WITH r AS (SELECT user_id AS task_id, epoch_us(ts) * 1000 AS t, CASE event_id // 3 % 3 WHEN 0 THEN 'RTK' WHEN 1 THEN 'DEAD_RECKONING' ELSE 'RECOVERY' END AS state, value AS a, value * 2 AS b FROM events),
n AS (SELECT *, CASE WHEN state = lag(state) OVER (PARTITION BY task_id ORDER BY t) THEN 0 ELSE 1 END AS fresh FROM r), s AS (SELECT *, sum(fresh) OVER (PARTITION BY task_id ORDER BY t) AS run FROM n),
f AS (SELECT *, first(a) OVER w AS fa, first(b) OVER w AS fb, least((t - first(t) OVER w) / {30 * HOUR}.0::DOUBLE, 1) AS u FROM s WINDOW w AS (PARTITION BY task_id, run ORDER BY t))
SELECT task_id, t, round(CASE state WHEN 'RECOVERY' THEN fa + u * (fb - fa) WHEN 'DEAD_RECKONING' THEN a ELSE b END, 6) AS e FROM f""")
def w20(spark, d):
    k, v = F.col("event_id"), F.col("value")
    state = F.when(F.floor(k / 3) % 3 == 0, "RTK").when(F.floor(k / 3) % 3 == 1, "DEAD_RECKONING").otherwise("RECOVERY")
    r = A.table(spark, d, "events").select(F.col("user_id").alias("task_id"), (A.micros() * 1000).alias("t"), state.alias("state"), *[v.alias(f"dr_{c}") for c in "enu"], *[(v * 2).alias(f"rtk_{c}") for c in "enu"])
    return rounded(N.recovery_blend(r, 30 * 3600.0).select("task_id", "t", "e"), 6, "e")


def turns(spark, d):
    """Corrections about the vertical: runs of nearly equal large ones, broken by others."""
    k = F.col("event_id")
    yaw = F.radians(F.when(k % 9 < 5, 20.0 + k % 4).otherwise(60.0))
    return A.table(spark, d, "events").select(F.col("user_id").alias("task_id"), k.alias("seq"), (k % 7 > 0).alias("large"), F.cos(yaw / 2).alias("qw"), F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.sin(yaw / 2).alias("qz"), k)


@query("w25_confirmation_run")
def w25(spark, d):
    return N.confirmation_run(turns(spark, d))


@query("d14_gate_alignment")
def d14(spark, d):
    k = F.col("event_id")
    r = turns(spark, d).select("task_id", "seq", "qw", "qx", "qy", "qz", (k % 29 / 100).alias("fitness"), (0.4 + k % 13 * 0.05).alias("inlier_ratio"), (k % 19 / 8).alias("shift"), (k % 17 % 7).alias("dof"), F.when(F.col("large"), 20.0).otherwise(1.0).alias("rotation_deg"), (k % 5).alias("rotation_dof"), (k % 11 / 20).alias("improvement"))
    return N.gate_alignment(r)


@query("w26_gyro_bridge")
def w26(spark, d):
    k, yaw = F.col("event_id"), F.col("value") / 100
    at = lambda c: F.when(k % 4 == 0, c)
    r = A.table(spark, d, "events").select(F.col("user_id").alias("task_id"), (A.micros() * 10).alias("t"), k.alias("seq"), F.lit(0.0).alias("wx"), F.lit(0.0).alias("wy"), (F.col("value") / 1000).alias("wz"), at(F.cos(yaw / 2)).alias("qw"), at(F.lit(0.0)).alias("qx"), at(F.lit(0.0)).alias("qy"), at(F.sin(yaw / 2)).alias("qz"))
    return N.gyro_bridge(r, max_gap_s=400.0, max_total_s=800.0)


@query("w27_forward_axis", """WITH RECURSIVE o AS (SELECT user_id AS task_id, epoch_us(ts) AS t, value / 10 AS speed, event_id % 40 * 1.0::DOUBLE AS x, event_id % 23 * 1.0::DOUBLE AS y, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS k FROM events),
f AS (SELECT task_id, 0::BIGINT AS k, NULL::BIGINT AS t, NULL::DOUBLE AS sx, NULL::DOUBLE AS sy, NULL::DOUBLE AS dot FROM o GROUP BY 1
  UNION ALL SELECT o.task_id, o.k, o.t, CASE WHEN speed < 3 THEN NULL WHEN sx IS NULL OR far >= 20 THEN x ELSE sx END, CASE WHEN speed < 3 THEN NULL WHEN sx IS NULL OR far >= 20 THEN y ELSE sy END, CASE WHEN speed >= 3 AND far >= 20 THEN (0.6 * (x - sx) + 0.8 * (y - sy)) / far END
  FROM f JOIN o ON o.task_id = f.task_id AND o.k = f.k + 1, LATERAL (SELECT sqrt(pow(x - sx, 2) + pow(y - sy, 2)) AS far))
SELECT task_id, t, round(dot, 6) AS dot, dot < 0.8 AS flagged FROM f WHERE dot IS NOT NULL""")
def w27(spark, d):
    k = F.col("event_id")
    r = A.table(spark, d, "events").select(F.col("user_id").alias("task_id"), A.micros().alias("t"), k.alias("seq"), (F.col("value") / 10).alias("speed"), (k % 40).cast("double").alias("x"), (k % 23).cast("double").alias("y"), F.lit(0.6).alias("ax"), F.lit(0.8).alias("ay"))
    return rounded(N.forward_axis_check(r, min_speed=3.0), 6, "dot")


@query("j9_calibration_pairs", f"""WITH {A.stream_sql('l', 'click')}, {A.stream_sql('r', 'view')}, q AS (SELECT task_id, seq, t - 7000 AS t, v FROM l WHERE seq % 5 > 0),
b AS (SELECT q.*, r.t AS bt, r.v AS bv FROM q ASOF LEFT JOIN r ON q.task_id = r.task_id AND q.t >= r.t), f AS (SELECT b.*, r.t AS ft, r.v AS fv FROM b ASOF LEFT JOIN r ON b.task_id = r.task_id AND b.t <= r.t)
SELECT task_id, seq, t, round(CASE WHEN bt = t THEN bv ELSE bv + (fv - bv) * ((t - bt) / (ft - bt)::DOUBLE) END, 6) AS x, min_by(v, t) OVER (PARTITION BY task_id) AS origin FROM (SELECT *, first(v) OVER (PARTITION BY task_id ORDER BY t, seq) AS o FROM f) WHERE coalesce(bt = t, false) OR coalesce(ft > bt AND ft - bt <= {40 * HOUR}, false)""".replace(", min_by(v, t) OVER (PARTITION BY task_id) AS origin", ", round(v - o, 3) AS lat_steps"))
def j9(spark, d):
    # latitudes grow by the fix's value in ten-thousandths of a degree: north is read back in such steps
    fixes = A.stream_of(spark, d, "click").select("task_id", "t", "seq", (F.col("seq") % 5 > 0).alias("ok"), (30 + F.col("v") / 1e4).alias("lat"), F.lit(114.0).alias("lon"), F.lit(0.0).alias("alt"), (F.col("t") - 5000).alias("ref_stamp"), (F.col("t") + 2000).alias("ref_receipt"))
    odometry = A.stream_of(spark, d, "view").select("task_id", "t", "seq", F.col("v").alias("x"), F.lit(0.0).alias("y"))
    out = N.calibration_pairs(fixes, odometry, max_gap_ns=40 * HOUR)
    lat = fixes.select("task_id", "seq", "lat").join(fixes.where("ok").groupBy("task_id").agg(F.min_by("lat", F.struct("t", "seq")).alias("lat0")), "task_id")
    j = out.join(lat, ["task_id", "seq"])
    steps = (F.col("lat") - F.col("lat0")) * 1e4
    # a degree of latitude is 110.8 to 110.9 km there; north has to agree with it
    agrees = F.abs(F.col("north") - steps * 11.0852) <= 0.01 + 0.001 * F.abs(steps * 11.0852)
    return j.select("task_id", "seq", "t", F.round("x", 6).alias("x"), F.when(agrees, F.round(steps, 3)).alias("lat_steps"))


@query("a20_max_span_pair", f"""WITH RECURSIVE {A.TRAJECTORY}, o AS (SELECT task_id, stamp_ns, x, y, east, north, row_number() OVER (PARTITION BY task_id ORDER BY stamp_ns, line, x, y) AS seq FROM trajectory),
f AS (SELECT *, true AS kept FROM o WHERE seq = 1
  UNION ALL SELECT o.task_id, CASE WHEN ok THEN o.stamp_ns ELSE f.stamp_ns END, CASE WHEN ok THEN o.x ELSE f.x END, CASE WHEN ok THEN o.y ELSE f.y END, o.east, o.north, o.seq, ok
  FROM f JOIN o ON o.task_id = f.task_id AND o.seq = f.seq + 1, LATERAL (SELECT o.stamp_ns > f.stamp_ns AND sqrt(pow(o.x - f.x, 2) + pow(o.y - f.y, 2)) >= 20 AS ok)),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY seq DESC) AS n FROM f WHERE kept) WHERE n <= 100),
p AS (SELECT a.task_id, a.seq AS f, b.seq AS l, b.x - a.x AS dx, b.y - a.y AS dy, b.east - a.east AS de, b.north - a.north AS dn,
  row_number() OVER (PARTITION BY a.task_id ORDER BY pow(b.x - a.x, 2) + pow(b.y - a.y, 2) DESC, a.seq, b.seq) AS r FROM k a JOIN k b ON a.task_id = b.task_id AND a.seq < b.seq)
SELECT t.task_id, f AS first, l AS last, round(sqrt(dx * dx + dy * dy), 6) AS baseline, round(sqrt(dx * dx + dy * dy) / sqrt(de * de + dn * dn), 6) AS ratio,
  round(atan2(sin(atan2(dn, de) - atan2(dy, dx)), cos(atan2(dn, de) - atan2(dy, dx))), 6) AS heading_error, CASE WHEN f IS NULL THEN 'TOO_FEW' ELSE 'NONE' END AS reason
FROM (SELECT DISTINCT task_id FROM k) t LEFT JOIN p ON p.task_id = t.task_id AND r = 1""")
def a20(spark, d):
    from pyspark.sql import Window as W

    t = A.trajectory(spark, d).withColumn("seq", F.row_number().over(W.partitionBy("task_id").orderBy("stamp_ns", "line", "x", "y")).cast("long"))
    return rounded(N.max_span_pair(spacing_filter(t, 20.0, 100), most=100).drop("baseline_global"), 6, "baseline", "ratio", "heading_error")


@query("j19_overdue_transitions", "SELECT event_id AS task_id FROM events WHERE event_id % 3 = 0 AND event_id % 5 > 0 AND event_type <> 'error' AND epoch_us(ts) < 1705000000000000")
def j19(spark, d):
    k = F.col("event_id")
    t = A.table(spark, d, "events").select(k.alias("task_id"), (k % 3 == 0).alias("active"), (k % 5 == 0).alias("deleted"), F.when(F.col("event_type") != "error", A.micros()).alias("deadline_us"))
    return K.overdue_transitions(t, 1_705_000_000_000_000).select("task_id")


@query("a8_replay_summary", """WITH r AS (SELECT user_id AS task_id, event_id AS seq, event_type <> 'error' AND event_id % 9 > 0 AS ok, value AS height, greatest(event_id % 6 - 1, 0) AS planes, event_type AS reason FROM events)
SELECT task_id, count(*) AS frames, count(*) FILTER (WHERE ok) AS valid_frames, count(*) FILTER (WHERE NOT ok) AS invalid_frames, max_by(planes, seq) AS planes_last, round(avg(planes), 6) AS planes_mean, max(planes) AS planes_max, max_by(height, seq) FILTER (WHERE ok) AS height_last, min(height) FILTER (WHERE ok) AS height_min, round(avg(height) FILTER (WHERE ok), 6) AS height_mean, max(height) FILTER (WHERE ok) AS height_max, max_by(reason, seq) AS reason_last, max_by(ok, seq) AS valid_last FROM r GROUP BY 1""")
def a8(spark, d):
    k = F.col("event_id")
    r = A.table(spark, d, "events").select(F.col("user_id").alias("task_id"), k.alias("seq"), (F.col("event_type") != "error").alias("ok"), (k % 6 - 1).alias("planes"), F.when(k % 9 == 0, float("nan")).otherwise(F.col("value")).alias("height"), F.col("value").alias("processing_ms"), F.col("event_type").alias("reason"))
    return rounded(K.replay_summary(r).drop("processing_last"), 6, "planes_mean", "height_mean")


@query("o13_list_recordings", """WITH f AS (SELECT CASE WHEN user_id % 7 = 0 THEN 'tmp' ELSE '2026080' || (user_id % 9) || '_0' || printf('%05d', user_id) END AS recording_id, event_id AS length, epoch_us(ts) AS modified_us, user_id FROM events)
SELECT recording_id, CASE WHEN any_value(user_id) % 4 > 0 THEN 'full' END AS profile, sum(length) AS bytes, max(modified_us) AS modified_us, any_value(user_id) % 4 > 0 AND any_value(user_id) % 3 = 0 AS replay_ready FROM f WHERE recording_id <> 'tmp' GROUP BY 1""")
def o13(spark, d):
    u = F.col("user_id")
    name = F.when(u % 7 == 0, "tmp").otherwise(F.format_string("2026080%d_0%05d", u % 9, u))
    e = A.table(spark, d, "events").select("user_id", name.alias("recording_id"), F.col("event_id").alias("length"), A.micros().alias("modified_us"))
    topics = F.when(u % 3 == 0, F.array(*[F.lit(t) for t in K.REPLAY_TOPICS])).otherwise(F.array(F.lit(K.REPLAY_TOPICS[0])))
    manifests = e.where(u % 4 > 0).select("recording_id", F.lit("full").alias("profile"), topics.alias("topics"), F.lit(1.0).alias("duration_seconds")).dropDuplicates(["recording_id"])
    return K.list_recordings(manifests, e.drop("user_id")).drop("duration_seconds")


@query("a16_quadratic_fit")
def a16(spark, d):
    return S.quadratic_fit(A.points(spark, d))


MODEL = "0.02 * (ex) * (ex) - 0.01 * (ex) * (ny) + 0.03 * (ny) * (ny) + 0.1 * (ex) - 0.2 * (ny) + 5"


@query("a17_min_over_cells", f"""WITH {P}, c AS (SELECT DISTINCT frame_id, CAST(floor(x / 0.5) AS BIGINT) AS cx, CAST(floor(y / 0.5) AS BIGINT) AS cy FROM points), h AS (SELECT *, (cx + 0.5) * 0.5 AS e, (cy + 0.5) * 0.5 AS n FROM c), v AS (SELECT *, e - 1 AS ex, n - 2 AS ny FROM h), w AS (SELECT *, {MODEL} AS z FROM v)
SELECT frame_id, e AS east, n AS north, round(z, 6) AS height FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY z, cx, cy) AS k FROM w) WHERE k = 1""")
def a17(spark, d):
    p = A.points(spark, d)
    cells = p.select("frame_id", F.floor(F.col("x") / 0.5).cast("long").alias("cx"), F.floor(F.col("y") / 0.5).cast("long").alias("cy")).distinct()
    fits = p.select("frame_id").distinct().select("frame_id", *[F.lit(v).alias(n) for n, v in (("a", 0.02), ("b", -0.01), ("c", 0.03), ("d", 0.1), ("e", -0.2), ("f", 5.0), ("east0", 1.0), ("north0", 2.0))])
    return rounded(S.min_over_cells(cells, fits, 0.5), 6, "height")


@query("p33_p34_candidates", """SELECT event_id, round(-(event_id % 9 / 10.0::DOUBLE) / 0.9, 9) AS slope, round(-(value / 10) / 0.9, 9) AS level, round(0.15 * least((event_id % 300) / 160.0::DOUBLE, 1) + 0.15 * least((event_id % 70) / 40.0::DOUBLE, 1) + 0.10 * least((event_id % 10) / 10.0::DOUBLE / 0.6, 1) + 0.25 * greatest(1 - (event_id % 13) / 100.0::DOUBLE / 0.1, 0) + 0.15 * greatest(1 - (event_id % 11) / 80.0::DOUBLE / 0.1, 0) + 0.20 * greatest(least(((event_id % 12) / 10.0::DOUBLE - 0.05) / 0.95, 1), 0), 9) AS confidence FROM events""")
def p33(spark, d):
    k = F.col("event_id")
    e = A.table(spark, d, "events").select("event_id", (k % 9 / 10).alias("nx"), F.lit(0.0).alias("ny"), F.lit(0.9).alias("nz"), (F.col("value") / 10).alias("d"), (k % 300).alias("points"), (k % 70).alias("cells"), (k % 10 / 10).alias("span"), (k % 13 / 100).alias("p95"), (k % 11 / 80).alias("curvature"), (k % 12 / 10).alias("down"))
    score = S.surface_confidence(SurfaceConfig())
    return S.candidate_from_plane(e.withColumn("score", score)).select("event_id", F.round("d", 9).alias("slope"), F.round("f", 9).alias("level"), F.round("score", 9).alias("confidence"))


@query("o10_lowest_plane", f"WITH {P} SELECT frame_id, point_idx AS plane, z AS height FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY z, point_idx) AS k FROM points) WHERE k = 1")
def o10(spark, d):
    p = A.points(spark, d).select("frame_id", F.col("point_idx").alias("plane"), F.col("z").alias("height"), F.col("x").alias("east"), F.col("y").alias("north"))
    return S.lowest_plane(p).select("frame_id", "plane", "height")


@query("j16_knn", f"""WITH {P}, d AS (SELECT a.frame_id, a.point_idx, b.point_idx AS near_idx, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS far FROM points a JOIN points b ON a.frame_id = b.frame_id AND a.point_idx <> b.point_idx)
SELECT frame_id, point_idx, CAST(rank AS INTEGER) AS rank, near_idx, round(far, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, point_idx ORDER BY far, near_idx) AS rank FROM d) WHERE rank <= 5""")
def j16(spark, d):
    return rounded(S.knn(A.points(spark, d), 5), 6, "distance")


@query("o8_adaptive_voxel")
def o8(spark, d):
    return S.adaptive_voxel(A.points(spark, d), 0.2, 40)


#: Gates that the sparse points of the driver's tables can pass.
LOOSE = SurfaceConfig(voxel=0.1, neighbours=10, smoothness=60.0, curvature=0.35, min_cluster_points=20, min_cells=5, max_p95=5.0, max_curvature=0.4, min_down=0.0, min_confidence=0.1)


@query("d2_detect_surfaces")
def d2(spark, d):
    return S.detect_surfaces(A.points(spark, d), LOOSE)[0]


@query("d3_clearance_results")
def d3(spark, d):
    from ..config import PlaneConfig

    return S.clearance_results(A.points(spark, d), PlaneConfig(distance=0.4, voxel=0.2, max_planes=2, min_remaining=10, min_inliers=8, grid=0.8, span_cells=2, cells=4, residual_p95=0.5, iterations=60), LOOSE)


def drives(spark, d):
    """A tick for each event: fixes fail in stretches, odometry now and then, half of such ticks with a gyro; the local place follows the fix."""
    k, u = F.col("event_id"), F.col("user_id")
    lat, lon = 30 + F.col("value") / 1e6, 114 + k % 50 / 1e6
    return A.table(spark, d, "events").select(u.alias("task_id"), (A.micros() * 1000).alias("t"), (F.floor(k / 97) % 3 > 0).alias("reliable"), (k % 41 > 0).alias("odom_ok"), (k % 2 > 0).alias("gyro_ok"), F.when(k % 5 > 0, (k % 360).cast("double")).alias("track"), lat.alias("lat"), lon.alias("lon"), F.lit(0.0).alias("alt"), F.col("value").alias("x"), (k % 50).cast("double").alias("y"), F.lit(0.0).alias("z"), F.lit(0.3).alias("yaw"), F.lit(1.0).alias("horizontal"), F.lit(1.0).alias("vertical"))


@query("d11_dead_reckoning", f"""WITH RECURSIVE r AS (SELECT user_id AS task_id, epoch_us(ts) * 1000 AS t, event_id // 97 % 3 > 0 AS rel, event_id % 41 > 0 AS odo, event_id % 2 > 0 AS gyro, event_id % 5 > 0 AS track, value AS x, event_id % 50 * 1.0::DOUBLE AS y, radians(30 + value / 1e6::DOUBLE) AS p, radians(114 + event_id % 50 / 1e6::DOUBLE) AS l, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events),
o AS (SELECT *, {G.A!r}::DOUBLE / sqrt(1 - {G.E2!r} * sin(p) * sin(p)) AS big, big * cos(p) * cos(l) AS ex, big * cos(p) * sin(l) AS ey, big * (1 - {G.E2!r}) * sin(p) AS ez FROM r),
f AS (SELECT task_id, 0::BIGINT AS k, 0 AS mode, 0 AS told, NULL::BIGINT AS cand, NULL::DOUBLE AS cx, NULL::DOUBLE AS cy, NULL::BIGINT AS anchor, NULL::DOUBLE AS ax, NULL::DOUBLE AS ay, NULL::BIGINT AS start, NULL::DOUBLE AS le, NULL::DOUBLE AS ln, NULL::BIGINT AS since, NULL::DOUBLE AS fe, NULL::DOUBLE AS fn, false AS held, '' AS reason FROM o GROUP BY 1
  UNION ALL SELECT o.task_id, o.k, CASE WHEN m2 = 3 AND o.t - since2 >= {20 * HOUR} THEN 1 ELSE m2 END, m2, c, cx2, cy2, anchor2, ax2, ay2, start2, CASE WHEN why = 'NONE' AND m2 = 2 AND odo THEN e ELSE f.le END, CASE WHEN why = 'NONE' AND m2 = 2 AND odo THEN n ELSE f.ln END, since2,
    CASE WHEN m1 = 2 AND m2 = 3 THEN f.le ELSE f.fe END, CASE WHEN m1 = 2 AND m2 = 3 THEN f.ln ELSE f.fn END, m2 = 2 AND NOT odo AND why = 'NONE', why
  FROM f JOIN o ON o.task_id = f.task_id AND o.k = f.k + 1, LATERAL (SELECT CASE WHEN rel AND odo THEN o.t ELSE f.cand END AS c, CASE WHEN rel AND odo THEN o.x ELSE f.cx END AS cx2, CASE WHEN rel AND odo THEN o.y ELSE f.cy END AS cy2),
    LATERAL (SELECT CASE WHEN f.mode < 2 THEN CASE WHEN rel THEN 1 WHEN c IS NOT NULL AND odo THEN 2 ELSE 0 END WHEN f.mode = 3 AND NOT rel THEN 2 ELSE f.mode END AS m1),
    LATERAL (SELECT CASE WHEN m1 = 2 AND rel THEN CASE WHEN f.le IS NULL THEN 1 ELSE 3 END ELSE m1 END AS m2, f.mode < 2 AND m1 = 2 AS entered),
    LATERAL (SELECT CASE WHEN entered THEN c ELSE f.anchor END AS anchor2, CASE WHEN entered THEN cx2 ELSE f.ax END AS ax2, CASE WHEN entered THEN cy2 ELSE f.ay END AS ay2, CASE WHEN entered THEN o.t ELSE f.start END AS start2, CASE WHEN m1 = 2 AND m2 = 3 THEN o.t ELSE f.since END AS since2),
    LATERAL (SELECT cos(0.3) * (o.x - ax2) - sin(0.3) * (o.y - ay2) AS e, sin(0.3) * (o.x - ax2) + cos(0.3) * (o.y - ay2) AS n),
    LATERAL (SELECT CASE WHEN m2 = 0 THEN 'NO_VALID_RTK_ANCHOR' WHEN m2 <> 2 THEN 'NONE' WHEN NOT odo THEN CASE WHEN gyro AND f.le IS NOT NULL THEN 'NONE' ELSE 'ODOMETRY_TIMEOUT' END WHEN (o.t - start2) / 1e9::DOUBLE > 100000 THEN 'DEAD_RECKONING_DURATION_EXCEEDED' WHEN sqrt(e * e + n * n) > 60 THEN 'DEAD_RECKONING_DISTANCE_EXCEEDED' ELSE 'NONE' END AS why)),
j AS (SELECT f.*, o.t, o.odo, o.track, least((o.t - since) / 1e9::DOUBLE / {20 * 3600}, 1) AS part, CASE WHEN told = 3 THEN g.ex ELSE o.ex END - a.ex AS dx, CASE WHEN told = 3 THEN g.ey ELSE o.ey END - a.ey AS dy, CASE WHEN told = 3 THEN g.ez ELSE o.ez END - a.ez AS dz, a.p, a.l
  FROM f JOIN o ON o.task_id = f.task_id AND o.k = f.k LEFT JOIN o a ON a.task_id = f.task_id AND a.t = f.anchor LEFT JOIN o g ON g.task_id = f.task_id AND g.t = f.since),
u AS (SELECT *, cos(l) * dy - sin(l) * dx AS ue, cos(p) * dz - sin(p) * cos(l) * dx - sin(p) * sin(l) * dy AS un FROM j),
e AS (SELECT *, CASE WHEN reason <> 'NONE' THEN 0 WHEN told = 2 THEN le WHEN told = 3 THEN fe + part * (ue - fe) WHEN anchor IS NULL THEN 0 ELSE ue END AS east, CASE WHEN reason <> 'NONE' THEN 0 WHEN told = 2 THEN ln WHEN told = 3 THEN fn + part * (un - fn) WHEN anchor IS NULL THEN 0 ELSE un END AS north FROM u)
SELECT task_id, t, ['WAITING_FOR_RTK', 'RTK', 'DEAD_RECKONING', 'RECOVERY'][told + 1] AS mode, anchor AS anchor_t, CASE WHEN told > 1 THEN start END AS start_t, CASE WHEN told = 3 THEN since END AS recovery_t, round(east, 4) + 0.0 AS east, round(north, 4) + 0.0 AS north, reason,
  CASE WHEN reason <> 'NONE' THEN 'INVALID' WHEN held THEN 'IMU_GYRO' WHEN told = 2 OR odo THEN 'ODIN' WHEN track THEN 'RTK_TRACK' ELSE 'INVALID' END AS heading_source FROM e WHERE k > 0""")
def d11(spark, d):
    out = N.dead_reckoning(drives(spark, d), recovery_s=20 * 3600.0, max_s=100_000.0, max_m=60.0, bucket_ns=240 * HOUR)
    shown = [(F.round(c, 4) + 0.0).alias(c) for c in ("east", "north")]
    return out.select("task_id", "t", "mode", "anchor_t", "start_t", "recovery_t", *shown, "reason", "heading_source")


@query("d13_rolling_map", f"""WITH {P}, q AS (SELECT frame_id % 3 AS epoch, y * -1 + frame_id AS x, x AS y, z AS z, frame_id FROM points), c AS (SELECT frame_id % 3 AS epoch, max(frame_id) AS px FROM points GROUP BY 1),
n AS (SELECT q.* FROM q JOIN c USING (epoch) WHERE sqrt(pow(x - px, 2) + pow(y, 2) + pow(z, 2)) <= 6.5), v AS (SELECT epoch, floor(x / 0.5) AS vx, floor(y / 0.5) AS vy, floor(z / 0.5) AS vz, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM n GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY vx, vy, vz) - 1 AS point_idx, count(*) OVER (PARTITION BY epoch) AS n FROM v) SELECT CAST(epoch AS BIGINT) AS epoch, point_idx, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM r WHERE point_idx % CAST(ceil(n / 30.0) AS BIGINT) = 0""")
def d13(spark, d):
    p = A.points(spark, d)
    half = F.sqrt(F.lit(0.5))
    poses = p.select("frame_id").distinct().select("frame_id", F.lit(1).alias("task_id"), (F.col("frame_id") % 3).alias("epoch"), F.col("frame_id").alias("t"), F.col("frame_id").cast("double").alias("px"), F.lit(0.0).alias("py"), F.lit(0.0).alias("pz"), half.alias("qw"), F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), half.alias("qz"))
    return rounded(N.rolling_map(p, poses, radius=6.5, leaf=0.5, most=30).drop("task_id"), 6, "x", "y", "z")
