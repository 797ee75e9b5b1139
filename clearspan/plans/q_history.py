"""Registered queries of history and time joins, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as H
from ..operators import temporal as T
from . import adapters as A

S = A.SAMPLES
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


def r6(*names):
    return {n: F.round(n, 6) for n in names}


STATS = """SELECT task_id, count(*) AS total, count(*) FILTER (WHERE valid AND height IS NOT NULL) AS valid_samples,
  count(*) - count(*) FILTER (WHERE valid AND height IS NOT NULL) AS invalid_samples, round(min(height) FILTER (WHERE valid), 6) AS min_height,
  round(avg(height) FILTER (WHERE valid), 6) AS avg_height, round(max(height) FILTER (WHERE valid), 6) AS max_height,
  round((max(ts_ns) - min(ts_ns)) / 1e6::DOUBLE, 3) AS duration_ms,
  round(CASE WHEN max(ts_ns) > min(ts_ns) THEN (count(*) - 1) * 1000.0::DOUBLE / ((max(ts_ns) - min(ts_ns)) / 1e6::DOUBLE) END, 9) AS rate_hz
  FROM samples GROUP BY task_id"""


@query("a1_task_statistics", f"WITH {S} {STATS}")
def a1(spark, d):
    return H.task_statistics(A.samples(spark, d)).withColumns(r6("min_height", "avg_height", "max_height")).withColumns({"duration_ms": F.round("duration_ms", 3), "rate_hz": F.round("rate_hz", 9)})


@query("a2_normal_height", f"WITH {S} SELECT task_id, count(*) FILTER (WHERE valid AND height BETWEEN 0.5 AND 2) AS within, count(*) FILTER (WHERE valid AND height < 0.5) AS below, count(*) FILTER (WHERE valid AND height > 2) AS above, min(height) FILTER (WHERE valid AND height BETWEEN 0.5 AND 2) AS min_within FROM samples GROUP BY task_id")
def a2(spark, d):
    s = A.samples(spark, d)
    bounds = s.select("task_id").distinct().select("task_id", H.resolve_bound(F.lit(None).cast("double"), default=0.5).alias("lo"), F.lit(2.0).alias("hi"))
    return H.normal_height_statistics(s, bounds)


@query("a3_sample_bounds", f"WITH {S} SELECT task_id, min(sample_index) AS first_index, max(sample_index) AS last_index, min_by(ts_ns, sample_index) // 1000000 AS first_ms, max_by(ts_ns, sample_index) // 1000000 AS last_ms FROM samples GROUP BY task_id")
def a3(spark, d):
    return H.sample_bounds(A.samples(spark, d))


@query("a4_task_summary", f"""WITH {S}, st AS ({STATS}),
b AS (SELECT task_id, min(sample_index) AS first_index, max(sample_index) AS last_index, min(ts_ns) // 1000000 AS first_ms, max(ts_ns) // 1000000 AS last_ms FROM samples GROUP BY task_id),
e AS (SELECT user_id AS task_id, min(event_id) FILTER (WHERE event_type = 'signup') AS entry_fix, max(event_id) FILTER (WHERE event_type = 'purchase') AS exit_fix, count(*) FILTER (WHERE event_type = 'error') AS pauses FROM events GROUP BY user_id)
SELECT st.*, b.* EXCLUDE (task_id), entry_fix, exit_fix, pauses FROM st JOIN b USING (task_id) LEFT JOIN e USING (task_id)""")
def a4(spark, d):
    e = A.table(spark, d, "events").withColumnRenamed("user_id", "task_id")
    entry = e.where("event_type = 'signup'").groupBy("task_id").agg(F.min("event_id").alias("fix_id")).withColumn("role", F.lit("entry"))
    leave = e.where("event_type = 'purchase'").groupBy("task_id").agg(F.max("event_id").alias("fix_id")).withColumn("role", F.lit("exit"))
    out = H.task_summary(A.samples(spark, d), entry.unionByName(leave), e.where("event_type = 'error'").select("task_id"))
    return out.withColumns(r6("min_height", "avg_height", "max_height")).withColumns({"duration_ms": F.round("duration_ms", 3), "rate_hz": F.round("rate_hz", 9)})


@query("p1_series_projection", f"WITH {S} SELECT task_id, sample_index, ts_ns // 1000000 AS ts_ms, height, valid FROM samples")
def p1(spark, d):
    return H.series_projection(A.samples(spark, d))


@query("o2_series_prefix", f"WITH {S} SELECT task_id, sample_index, height FROM samples WHERE sample_index < 20")
def o2(spark, d):
    return H.series_prefix(A.samples(spark, d), 20).select("task_id", "sample_index", "height")


WINDOW = (1_704_500_000_000, 1_705_000_000_000)


@query("o3_series_window", f"WITH {S} SELECT task_id, sample_index, ts_ns, height FROM samples WHERE ts_ns BETWEEN {WINDOW[0]} * 1000000 AND {WINDOW[1]} * 1000000 + 999999")
def o3(spark, d):
    return H.series_window(A.samples(spark, d), *WINDOW).select("task_id", "sample_index", "ts_ns", "height")


HOLED = S + """, holed AS (SELECT task_id, sample_index, ts_ns, CASE WHEN sample_index % 9 <> 4 THEN height END AS height, valid FROM samples)"""


def holed(spark, d):
    """Samples of which some have no height."""
    return A.samples(spark, d).withColumn("height", F.when(F.col("sample_index") % 9 != 4, F.col("height")))


def extrema_sql(low: int, high: int, most: int) -> str:
    b = max(1, (most - 2) // 3)
    return f"""WITH {HOLED}, sp AS (SELECT task_id, greatest(min(ts_ns) // 1000000 * 1000000, {low}) AS a, least(max(ts_ns) // 1000000 * 1000000 + 999999, {high}) AS z, count(*) FILTER (WHERE ts_ns BETWEEN {low} AND {high}) AS n FROM holed GROUP BY task_id),
b AS (SELECT s.*, n, valid AND height IS NOT NULL AS ok, least({b - 1}, CAST((ts_ns - a) AS HUGEINT) * {b} // (z - a + 1)) AS bucket FROM holed s JOIN sp USING (task_id) WHERE ts_ns BETWEEN {low} AND {high}),
r AS (SELECT *, row_number() OVER (PARTITION BY task_id, bucket, ok ORDER BY height, sample_index) AS lo, row_number() OVER (PARTITION BY task_id, bucket, ok ORDER BY height DESC, sample_index) AS hi,
  row_number() OVER (PARTITION BY task_id, bucket, ok ORDER BY sample_index) AS fi,
  row_number() OVER (PARTITION BY task_id ORDER BY ts_ns, sample_index) AS f, row_number() OVER (PARTITION BY task_id ORDER BY ts_ns DESC, sample_index DESC) AS l FROM b)
SELECT task_id, sample_index, ts_ns, height, valid FROM r WHERE n <= {most} OR (ok AND (lo = 1 OR hi = 1)) OR (NOT ok AND fi = 1) OR f = 1 OR l = 1"""


@query("o4_downsample_extrema", extrema_sql(-(2**62), 2**62, 20))
def o4(spark, d):
    return H.downsample_extrema(holed(spark, d), 20)


@query("o4_extrema_of_a_window", extrema_sql(WINDOW[0] * 1_000_000, WINDOW[1] * 1_000_000 + 999_999, 12))
def o4_window(spark, d):
    return H.downsample_extrema(holed(spark, d), 12, *WINDOW)


@query("o14_full_history", f"WITH {S}, n AS (SELECT task_id, count(*) > 70 AS over_cap FROM samples GROUP BY task_id) SELECT task_id, sample_index, height, over_cap FROM samples JOIN n USING (task_id) WHERE NOT over_cap UNION ALL SELECT task_id, NULL, NULL, true FROM n WHERE over_cap")
def o14(spark, d):
    return H.full_history(A.samples(spark, d), cap=70).select("task_id", "sample_index", "height", "over_cap")


RANGES = """ranges AS (SELECT user_id AS task_id, epoch_us(ts) // 1000 AS start_ms, epoch_us(ts) // 1000 + 40000000 + event_id % 7 * 10000000 AS end_ms, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 50 * (event_id % 3) END AS resolution_ms FROM events)"""


@query("u2_interval_coverage", f"""WITH {RANGES}, c AS (SELECT task_id, greatest(start_ms, 1704500000000) AS a, least(end_ms, 1705000000000) AS b FROM ranges WHERE (resolution_ms = 0 OR resolution_ms <= 63) AND end_ms >= 1704500000000 AND start_ms <= 1705000000000),
g AS (SELECT *, CASE WHEN a > coalesce(max(b) OVER (PARTITION BY task_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1704499999999) + 1 THEN 1 ELSE 0 END AS gap FROM c),
s AS (SELECT *, sum(gap) OVER (PARTITION BY task_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS broken FROM g)
SELECT task_id, max(b) FILTER (WHERE broken = 0) AS covered_to, coalesce(max(b) FILTER (WHERE broken = 0) >= 1705000000000, false) AS complete FROM s GROUP BY task_id""")
def u2(spark, d):
    e = A.table(spark, d, "events")
    ms = ((A.micros() - F.pmod(A.micros(), F.lit(1000))) / 1000).cast("long")
    ranges = e.select(F.col("user_id").alias("task_id"), ms.alias("start_ms"), (ms + 40_000_000 + F.col("event_id") % 7 * 10_000_000).alias("end_ms"), F.when(F.col("event_id") % 3 == 0, 0).otherwise(50 * (F.col("event_id") % 3)).alias("resolution_ms"))
    return H.interval_coverage(ranges, start=1_704_500_000_000, end=1_705_000_000_000, target_ms=60.0)


@query("u3_merge_series", f"WITH {S} SELECT task_id, sample_index, CASE WHEN sample_index % 5 = 0 THEN height + 1 ELSE height END AS height FROM samples")
def u3(spark, d):
    s = A.samples(spark, d).select("task_id", "sample_index", "height")
    return H.merge_series(s, s.where("sample_index % 5 = 0").withColumn("height", F.col("height") + 1))


@query("a26_chart_y_range", f"""WITH {S}, h AS (SELECT task_id, CASE WHEN task_id % 7 = 0 THEN 'nan'::DOUBLE WHEN task_id % 5 = 0 THEN 0.01 WHEN sample_index % 9 <> 4 THEN height END AS height FROM samples),
l AS (SELECT task_id, min(height) AS lo, max(height) AS hi FROM h WHERE isfinite(height) GROUP BY task_id), m AS (SELECT *, greatest(lo - greatest(hi - lo, 0.1) * 0.12, 0) AS y_min FROM l)
SELECT task_id, round(y_min, 6) AS y_min, round(greatest(y_min + 0.1, hi + greatest(hi - lo, 0.1) * 0.12), 6) AS y_max FROM m""")
def a26(spark, d):
    h = F.when(F.col("task_id") % 7 == 0, float("nan")).when(F.col("task_id") % 5 == 0, 0.01).otherwise(F.col("height"))
    return H.chart_y_range(holed(spark, d).withColumn("height", h)).withColumns(r6("y_min", "y_max"))


@query("w18_last_n", f"WITH {S} SELECT task_id, sample_index, source_sequence FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY sample_index DESC) AS n FROM samples) WHERE n <= 12")
def w18(spark, d):
    return H.last_n(A.samples(spark, d), 12).select("task_id", "sample_index", "source_sequence")


@query("w19_trim_history", f"WITH {S} SELECT task_id, sample_index FROM (SELECT *, max(ts_ns) OVER (PARTITION BY task_id) - ts_ns AS age, row_number() OVER (PARTITION BY task_id ORDER BY ts_ns DESC, sample_index DESC) AS n FROM samples) WHERE age <= 200000000000000 AND n <= 8")
def w19(spark, d):
    return H.trim_history(A.samples(spark, d), 200_000, 8).select("task_id", "sample_index")


@query("a28_stream_health", f"""WITH {S}, e AS (SELECT c_custkey % 500 AS task_id, max(1706700000000000000 - c_custkey * 1000000000) AS started_ns FROM customer GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ts_ns DESC, sample_index DESC) AS n FROM samples WHERE task_id % 4 > 0),
a AS (SELECT task_id, count(*) AS n, min(ts_ns) AS a, max(ts_ns) AS b FROM r WHERE n <= 20 GROUP BY task_id)
SELECT task_id, round(CASE WHEN n > 1 AND b > a THEN (n - 1) * 1e9::DOUBLE / (b - a) ELSE 0 END, 9) AS rate_hz, coalesce((1706700000000000000 - b) // 1000000, -1) AS age_ms,
  CASE WHEN n IS NULL THEN CASE WHEN (1706700000000000000 - started_ns) // 1000000 <= 60000 THEN 'waiting' ELSE 'timeout' END WHEN (1706700000000000000 - b) // 1000000 <= 50000000 THEN 'ok' ELSE 'timeout' END AS state FROM a FULL JOIN e USING (task_id)""")
def a28(spark, d):
    k = F.col("c_custkey")
    expected = A.table(spark, d, "customer").groupBy((k % 500).alias("task_id")).agg(F.max(F.lit(1_706_700_000_000_000_000) - k * 1_000_000_000).alias("started_ns"))
    out = H.stream_health(A.samples(spark, d).where("task_id % 4 > 0"), last=20, now_ns=1_706_700_000_000_000_000, timeout_s=50_000.0, expected=expected, grace_s=60.0)
    return out.withColumns({"rate_hz": F.round("rate_hz", 9)})


L, R = A.stream_sql("l", "click"), A.stream_sql("r", "view")


@query("j2_sample_hold", f"""WITH {L}, {R} SELECT l.task_id, l.t, r.t AS hold_t, r.seq AS hold_seq, l.t - r.t AS age_ns, CASE WHEN l.t - r.t <= {20 * HOUR} THEN r.v END AS value,
CASE WHEN r.t IS NULL THEN 'source_unavailable' WHEN l.t - r.t > {20 * HOUR} THEN 'source_timeout' END AS reason FROM l ASOF LEFT JOIN r ON l.task_id = r.task_id AND l.t >= r.t""")
def j2(spark, d):
    return T.sample_hold(A.stream_of(spark, d, "click"), A.stream_of(spark, d, "view"), 20 * HOUR, width_ns=48 * HOUR)


@query("j3_snapshot_join", f"""WITH {L}, {R}, {A.stream_sql('q', 'purchase')},
a AS (SELECT l.*, CASE WHEN l.t - r.t <= {30 * HOUR} THEN r.seq END AS view_seq FROM l ASOF LEFT JOIN r ON l.task_id = r.task_id AND l.t >= r.t)
SELECT a.task_id, a.t, a.seq, a.view_seq, CASE WHEN a.t - q.t <= {10 * HOUR} THEN q.v END AS purchase_value FROM a ASOF LEFT JOIN q ON a.task_id = q.task_id AND a.t >= q.t""")
def j3(spark, d):
    j = T.asof_join(A.stream_of(spark, d, "click"), {"view": (A.stream_of(spark, d, "view"), 30 * HOUR), "purchase": (A.stream_of(spark, d, "purchase"), 10 * HOUR)})
    return j.select("task_id", "t", "seq", F.col("view.seq").alias("view_seq"), F.col("purchase.v").alias("purchase_value"))


@query("j4_nearest_join", f"""WITH {L}, {R}, b AS (SELECT l.*, r.t AS bt, r.seq AS bs FROM l ASOF LEFT JOIN r ON l.task_id = r.task_id AND l.t >= r.t),
f AS (SELECT b.*, r.t AS ft, r.seq AS fs FROM b ASOF LEFT JOIN r ON b.task_id = r.task_id AND b.t <= r.t)
SELECT task_id, t, seq, CASE WHEN bt IS NOT NULL AND (ft IS NULL OR t - bt <= ft - t) THEN CASE WHEN t - bt <= {5 * HOUR} THEN bs END ELSE CASE WHEN ft - t <= {5 * HOUR} THEN fs END END AS near_seq FROM f""")
def j4(spark, d):
    return T.nearest_join(A.stream_of(spark, d, "click"), A.stream_of(spark, d, "view"), 5 * HOUR).select("task_id", "t", "seq", F.col("near.seq").alias("near_seq"))


@query("j5_exact_join", f"WITH {L}, {A.stream_sql('a', 'click')} SELECT l.task_id, l.t, l.seq, a.v FROM l JOIN a ON l.task_id = a.task_id AND l.t = a.t")
def j5(spark, d):
    left, right = A.stream_of(spark, d, "click"), A.stream_of(spark, d, "click")
    return left.select("task_id", "t", "seq").join(right.select("task_id", "t", "v"), ["task_id", "t"])


INTER = f"""WITH {L}, {R}, b AS (SELECT l.*, r.t AS bt, r.v AS bv FROM l ASOF LEFT JOIN r ON l.task_id = r.task_id AND l.t >= r.t),
f AS (SELECT b.*, r.t AS ft, r.v AS fv FROM b ASOF LEFT JOIN r ON b.task_id = r.task_id AND b.t <= r.t),
j AS (SELECT task_id, seq, coalesce(bt = t, false) OR coalesce(ft - bt > 0 AND ft - bt <= {40 * HOUR}, false) AS found, bt, ft, bv, fv, t FROM f)"""


@query("j7_interpolate_join", INTER + " SELECT task_id, seq, found, round(CASE WHEN bt = t THEN bv WHEN found THEN bv + (fv - bv) * ((t - bt) / (ft - bt)::DOUBLE) END, 6) AS v FROM j")
def j7(spark, d):
    out = T.interpolate_join(A.stream_of(spark, d, "click").drop("v"), A.stream_of(spark, d, "view"), 40 * HOUR, ["v"])
    return out.select("task_id", "seq", "found", F.round("v", 6).alias("v"))


@query("j8_sync_dropped", INTER + " SELECT task_id, count(*) FILTER (WHERE NOT found) AS dropped FROM j GROUP BY task_id")
def j8(spark, d):
    return T.sync_inner(A.stream_of(spark, d, "click").drop("v"), A.stream_of(spark, d, "view"), 40 * HOUR, ["v"])[1]


@query("j10_exclude_pauses", f"""WITH {S}, p AS (SELECT user_id AS task_id, epoch_us(ts) * 1000 AS a, CASE WHEN event_id % 50 = 0 THEN 4611686018427387904 ELSE epoch_us(ts) * 1000 + {12 * HOUR} END AS z FROM events WHERE event_type = 'error')
SELECT task_id, sample_index FROM samples s WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.task_id = s.task_id AND s.ts_ns >= a AND s.ts_ns < z)""")
def j10(spark, d):
    p = A.stream_of(spark, d, "error").select("task_id", F.col("t").alias("start_ns"), F.when(F.col("seq") % 50 != 0, F.col("t") + 12 * HOUR).alias("end_ns"))
    return T.exclude_pauses(A.samples(spark, d), p, width_ns=48 * HOUR).select("task_id", "sample_index")


@query("j11_endpoint_capture", f"""WITH {A.stream_sql('e', 'signup')}, {R} SELECT e.task_id, e.t, e.seq, r.seq AS fix_seq, e.t - r.t AS age_ns,
CASE WHEN r.t IS NULL THEN 'no_fix' WHEN r.v <= 20 THEN 'invalid_fix' WHEN e.t - r.t > {24 * HOUR} THEN 'stale_fix' END AS reason, r.t IS NOT NULL AND r.v > 20 AND e.t - r.t <= {24 * HOUR} AS confirmed FROM e ASOF LEFT JOIN r ON e.task_id = r.task_id AND e.t >= r.t""")
def j11(spark, d):
    return T.endpoint_capture(A.stream_of(spark, d, "signup").drop("v"), A.stream_of(spark, d, "view").withColumn("ok", F.col("v") > 20), 24 * HOUR, width_ns=48 * HOUR)


@query("a5_tick_mean", f"WITH {L} SELECT task_id, t // {24 * HOUR} AS tick, count(*) AS n, round(avg(v), 6) AS v FROM l GROUP BY ALL")
def a5(spark, d):
    return T.tick_mean(A.stream_of(spark, d, "click"), 24 * HOUR, ["v"]).withColumns(r6("v"))


@query("w7_repeat_index", f"WITH {L}, {R}, h AS (SELECT l.task_id, l.t, r.seq AS hold_seq FROM l ASOF LEFT JOIN r ON l.task_id = r.task_id AND l.t >= r.t) SELECT task_id, t, hold_seq, row_number() OVER (PARTITION BY task_id, hold_seq ORDER BY t) - 1 AS repeat_index FROM h")
def w7(spark, d):
    h = T.sample_hold(A.stream_of(spark, d, "click"), A.stream_of(spark, d, "view"), HOUR, width_ns=48 * HOUR).select("task_id", "t", "hold_seq")
    return T.repeat_index(h)


BUNDLES = f"rows_ AS (SELECT user_id AS task_id, epoch_us(ts) * 1000 // {48 * HOUR} * {48 * HOUR} AS t, event_id AS seq FROM events)"


@query("w8_expand_bundles", f"""WITH RECURSIVE {BUNDLES}, p AS (SELECT *, t + (row_number() OVER (PARTITION BY task_id, t ORDER BY seq) - 1) * {12 * HOUR} AS stamp FROM rows_),
b AS (SELECT task_id, t, min(stamp) AS f, max(stamp) AS l, row_number() OVER (PARTITION BY task_id ORDER BY min(seq)) AS k FROM p GROUP BY task_id, t),
r AS (SELECT task_id, t, k, l AS published, true AS kept FROM b WHERE k = 1
  UNION ALL SELECT b.task_id, b.t, b.k, CASE WHEN published - f > {300 * HOUR} OR f > published THEN l ELSE published END, published - f > {300 * HOUR} OR f > published FROM r JOIN b ON b.task_id = r.task_id AND b.k = r.k + 1)
SELECT p.task_id, p.seq, p.stamp FROM p JOIN r USING (task_id, t) WHERE kept""")
def w8(spark, d):
    e = A.table(spark, d, "events").select(F.col("user_id").alias("task_id"), ((A.micros() * 1000) - F.pmod(A.micros() * 1000, F.lit(48 * HOUR))).alias("t"), F.col("event_id").alias("seq"))
    return T.expand_bundles(e, 12 * HOUR, reset_ns=300 * HOUR).select("task_id", "seq", "stamp")


@query("w9_epoch_id", f"""WITH RECURSIVE j AS (SELECT user_id AS task_id, (epoch_us(ts) * 1000 - CASE WHEN event_id % 11 = 0 THEN {200 * HOUR} WHEN event_id % 7 = 0 THEN {20 * HOUR} ELSE 0 END) // {HOUR} * {HOUR} AS t, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
f AS (SELECT task_id, seq, k, t AS last, 0::BIGINT AS epoch, true AS accepted FROM j WHERE k = 1
  UNION ALL SELECT j.task_id, j.seq, j.k, CASE WHEN t >= last OR last - t > {100 * HOUR} THEN t ELSE last END, epoch + CASE WHEN last - t > {100 * HOUR} THEN 1 ELSE 0 END, t >= last OR last - t > {100 * HOUR} FROM f JOIN j ON j.task_id = f.task_id AND j.k = f.k + 1),
n AS (SELECT *, lead(last) OVER (PARTITION BY task_id ORDER BY k) = last AS again FROM f WHERE accepted)
SELECT f.task_id, f.seq, f.epoch, f.accepted, coalesce(n.again, false) AS superseded FROM f LEFT JOIN n ON n.task_id = f.task_id AND n.k = f.k""")
def w9(spark, d):
    t = A.micros() * 1000 - F.when(F.col("event_id") % 11 == 0, 200 * HOUR).when(F.col("event_id") % 7 == 0, 20 * HOUR).otherwise(0)
    e = A.table(spark, d, "events").select(F.col("user_id").alias("task_id"), (t - F.pmod(t, F.lit(HOUR))).alias("t"), F.col("event_id").alias("seq"))
    return T.epoch_id(e, 100 * HOUR).select("task_id", "seq", "epoch", "accepted", "superseded")


@query("w10_pose_gaps", f"WITH {L}, g AS (SELECT task_id, lag(t) OVER (PARTITION BY task_id ORDER BY t, seq) AS gap_start, t AS gap_end FROM l) SELECT task_id, gap_start, gap_end, gap_end - gap_start AS gap_ns FROM g WHERE gap_end - gap_start > {60 * HOUR}")
def w10(spark, d):
    return T.pose_gaps(A.stream_of(spark, d, "click"), 60 * HOUR)


@query("w11_continuous_duration", f"""WITH {L}, g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY task_id ORDER BY t, seq) > {60 * HOUR} THEN 1 ELSE 0 END AS k FROM l), i AS (SELECT *, sum(k) OVER (PARTITION BY task_id ORDER BY t, seq) AS island FROM g)
SELECT task_id, seq, t - min(t) OVER (PARTITION BY task_id, island) AS continuous_ns FROM i""")
def w11(spark, d):
    return T.continuous_duration(A.stream_of(spark, d, "click"), 60 * HOUR).select("task_id", "seq", "continuous_ns")


@query("d16_frame_context", f"""WITH {L}, {R}, fr AS (SELECT task_id, seq AS frame_id, t AS first_ns, t + {10 * HOUR} AS last_ns FROM l), pb AS (SELECT task_id, min(t) AS lo, max(t) AS hi FROM r WHERE task_id % 50 > 0 GROUP BY task_id)
SELECT task_id, frame_id, coalesce(greatest(lo - first_ns, 0), 0) AS head_gap_ns, coalesce(greatest(last_ns - hi, 0), 0) AS tail_gap_ns, CASE WHEN lo IS NULL THEN 'POSE_NOT_AVAILABLE' WHEN lo > first_ns THEN 'CLOUD_OLDER_THAN_POSE_CACHE' WHEN last_ns - hi > {4 * HOUR} THEN 'POSE_TAIL_TIMEOUT' END AS drop_reason FROM fr LEFT JOIN pb USING (task_id)""")
def d16(spark, d):
    frames = A.stream_of(spark, d, "click").select("task_id", F.col("seq").alias("frame_id"), F.col("t").alias("first_ns"), (F.col("t") + 10 * HOUR).alias("last_ns"))
    # every fiftieth task has no poses
    bounds = A.stream_of(spark, d, "view").where("task_id % 50 > 0").groupBy("task_id").agg(F.min("t").alias("min_ns"), F.max("t").alias("max_ns"))
    return T.frame_context(frames, bounds, partial_tail_ns=4 * HOUR)
