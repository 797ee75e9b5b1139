"""Registered queries of the column functions, each with its SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import geodesy as G
from ..functions import gnss as N
from ..functions import rotation as R
from ..functions import text as X
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


ECEF = """n AS (SELECT *, 6378137.0::DOUBLE / sqrt(1 - {e2} * sin(radians(lat)) * sin(radians(lat))) AS n FROM fixes),
e AS (SELECT *, (n + alt) * cos(radians(lat)) * cos(radians(lon)) AS x, (n + alt) * cos(radians(lat)) * sin(radians(lon)) AS y, (n * (1 - {e2}) + alt) * sin(radians(lat)) AS z FROM n)""".format(e2=repr(G.E2))
LAT0, LON0, ALT0 = 30.5, 114.5, 20.0
_n0 = G.A / math.sqrt(1 - G.E2 * math.sin(math.radians(LAT0)) ** 2)
X0, Y0, Z0 = (_n0 + ALT0) * math.cos(math.radians(LAT0)) * math.cos(math.radians(LON0)), (_n0 + ALT0) * math.cos(math.radians(LAT0)) * math.sin(math.radians(LON0)), (_n0 * (1 - G.E2) + ALT0) * math.sin(math.radians(LAT0))


@query("p12_ecef_enu", f"""WITH {A.FIXES}, {ECEF}, d AS (SELECT *, x - {X0!r} AS dx, y - {Y0!r} AS dy, z - {Z0!r} AS dz, sin(radians({LAT0})) AS sp, cos(radians({LAT0})) AS cp, sin(radians({LON0})) AS sl, cos(radians({LON0})) AS cl FROM e)
SELECT fix_id, round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z, round(cl * dy - sl * dx, 3) AS east, round(cp * dz - sp * cl * dx - sp * sl * dy, 3) AS north, round(cp * cl * dx + cp * sl * dy + sp * dz, 3) AS up FROM d""")
def p12(spark, d):
    o = [F.lit(LAT0), F.lit(LON0), F.lit(ALT0)]
    f = A.fixes(spark, d).withColumn("e", G.llh_to_ecef(F.col("lat"), F.col("lon"), F.col("alt"))).withColumn("u", G.llh_to_enu(*o, F.col("lat"), F.col("lon"), F.col("alt")))
    return rounded(f.select("fix_id", "e.*", "u.*"), 3, "x", "y", "z", "east", "north", "up")


@query("p12_round_trip", f"WITH {A.FIXES} SELECT fix_id, round(lat, 7) AS lat, round(lon, 7) AS lon, round(alt, 1) AS alt FROM fixes")
def p12b(spark, d):
    o = [F.lit(LAT0), F.lit(LON0), F.lit(ALT0)]
    f = A.fixes(spark, d).withColumn("u", G.llh_to_enu(*o, F.col("lat"), F.col("lon"), F.col("alt")))
    back = f.withColumn("l", G.enu_to_llh(*o, F.col("u.east"), F.col("u.north"), F.col("u.up"))).select("fix_id", "l.*")
    # the way there and back moves a height by some 1e-9 m: to the micrometre first, or a height between two tenths goes by that error
    return rounded(rounded(rounded(back, 7, "lat", "lon"), 6, "alt"), 1, "alt")


@query("p13_map_datum", f"""WITH {A.FIXES}, k AS (SELECT *, lon - 105.0 AS x, lat - 35.0 AS y FROM fixes),
s AS (SELECT *, (20.0 * sin(6 * x * pi()) + 20.0 * sin(2 * x * pi())) * 2 / 3 AS ripple, 1 - {G.SHIFT_E2!r} * sin(radians(lat)) * sin(radians(lat)) AS m FROM k),
t AS (SELECT *, -100.0 + 2 * x + 3 * y + 0.2 * y * y + 0.1 * x * y + 0.2 * sqrt(abs(x)) + ripple + (20.0 * sin(y * pi()) + 40.0 * sin(y / 3 * pi())) * 2 / 3 + (160.0 * sin(y / 12 * pi()) + 320.0 * sin(y * pi() / 30)) * 2 / 3 AS a,
  300.0 + x + 2 * y + 0.1 * x * x + 0.1 * x * y + 0.1 * sqrt(abs(x)) + ripple + (20.0 * sin(x * pi()) + 40.0 * sin(x / 3 * pi())) * 2 / 3 + (150.0 * sin(x / 12 * pi()) + 300.0 * sin(x / 30 * pi())) * 2 / 3 AS o FROM s)
SELECT fix_id, round(lat + a * 180 / ({G.SHIFT_A!r} * (1 - {G.SHIFT_E2!r}) / (m * sqrt(m)) * pi()), 8) AS lat, round(lon + o * 180 / ({G.SHIFT_A!r} / sqrt(m) * cos(radians(lat)) * pi()), 8) AS lon FROM t""")
def p13(spark, d):
    return rounded(A.fixes(spark, d).select("fix_id", G.wgs84_to_map(F.col("lat"), F.col("lon")).alias("m")).select("fix_id", "m.*"), 8, "lat", "lon")


@query("p14_angles", """SELECT event_id, round(((value * 7 + 180) - 360 * floor((value * 7 + 180) / 360)) - 180, 6) AS wrapped, round(value * 7 - 360 * floor(value * 7 / 360), 6) AS around,
round((90 - value * 7) - 360 * floor((90 - value * 7) / 360), 6) AS yaw_course, round(value * 0.5144444444444445, 6) AS speed FROM events""")
def p14(spark, d):
    v = F.col("value") * 7
    out = A.table(spark, d, "events").select("event_id", G.wrap_degrees(v).alias("wrapped"), G.wrap_360(v).alias("around"), G.yaw_to_course(F.radians(v)).alias("yaw_course"), (F.col("value") * G.KNOT).alias("speed"))
    return rounded(out, 6, "wrapped", "around", "yaw_course", "speed")


@query("p15_quaternions", """WITH q AS (SELECT event_id, radians(value * 3) AS a, radians(value * 3 + 40) AS b FROM events)
SELECT event_id, round(cos((a + b) / 2), 6) AS mw, round(sin((a + b) / 2), 6) AS mz, round(atan2(sin(a), cos(a)), 6) AS yaw, round(radians(40), 6) AS apart,
round(cos(a / 2 + radians(40) * 0.25 / 2), 6) AS sw, round(sin(a / 2 + radians(40) * 0.25 / 2), 6) AS sz FROM q""")
def p15(spark, d):
    e = A.table(spark, d, "events").select("event_id", R.from_yaw(F.radians(F.col("value") * 3)).alias("a"), R.from_yaw(F.radians(F.col("value") * 3 + 40)).alias("b"))
    out = e.withColumn("m", R.multiply(F.col("a"), F.col("b"))).withColumn("s", R.slerp(F.col("a"), F.col("b"), F.lit(0.25)))
    out = out.select("event_id", F.col("m.w").alias("mw"), F.col("m.z").alias("mz"), R.yaw_of(F.col("a")).alias("yaw"), R.angular_distance(F.col("a"), F.col("b")).alias("apart"), F.col("s.w").alias("sw"), F.col("s.z").alias("sz"))
    return rounded(out, 6, "mw", "mz", "yaw", "apart", "sw", "sz")


@query("p16_rotation", f"""WITH {A.POINTS}, q AS (SELECT *, radians(30 * frame_id) AS a FROM points) SELECT frame_id, point_idx, round(x * cos(a) - y * sin(a), 6) AS rx, round(x * sin(a) + y * cos(a), 6) AS ry, round(z, 6) AS rz,
round(cos(a), 6) AS ax, round(sin(a), 6) AS ay, round(((360 - 30 * frame_id) % 360)::DOUBLE, 6) AS heading, true AS proper FROM q""")
def p16(spark, d):
    yaw = F.radians(F.col("frame_id") * 30.0)
    p = A.points(spark, d).withColumn("q", R.from_yaw(yaw)).withColumn("r", R.rotate(F.col("q"), F.col("x"), F.col("y"), F.col("z")))
    c, s, o, i = F.cos(yaw), F.sin(yaw), F.lit(0.0), F.lit(1.0)
    out = p.withColumn("axis", R.project_axis(F.col("q"), (1, 0, 0))).select("frame_id", "point_idx", F.col("r.x").alias("rx"), F.col("r.y").alias("ry"), F.col("r.z").alias("rz"), F.col("axis.x").alias("ax"), F.col("axis.y").alias("ay"), R.vehicle_angles(F.col("q"))["heading"].alias("turned"), R.proper_rotation([c, -s, o, s, c, o, o, o, i]).alias("proper"))
    out = out.withColumn("heading", F.pmod(F.round("turned", 6), F.lit(360.0))).drop("turned")
    return rounded(out, 6, "rx", "ry", "rz", "ax", "ay", "heading")


@query("p18_p19_point_filters", f"WITH {A.POINTS} SELECT frame_id, count(*) FILTER (WHERE sqrt(x*x+y*y+z*z) >= 0.2 AND z BETWEEN 1 AND 5 AND abs(degrees(atan2(x, z))) <= 60 AND abs(degrees(atan2(y, z))) <= 60) AS roi, count(*) FILTER (WHERE NOT (x = 0 AND y = 0 AND z = 0)) AS valid FROM points GROUP BY frame_id")
def p18(spark, d):
    from ..config import PlaneConfig
    from ..operators import cloud as C

    p = A.points(spark, d)
    return p.groupBy("frame_id").agg(F.count(F.when(C.in_roi(PlaneConfig(up_max=5.0)), 1)).alias("roi"), F.count(F.when(C.valid_point(), 1)).alias("valid"))


@query("p23_lateral", f"WITH {A.SAMPLES} SELECT task_id, sample_index, round(CASE WHEN sample_index % 4 = 0 THEN point_x ELSE point_x * cos(radians(sample_index * 3)) - point_y * sin(radians(sample_index * 3)) END, 6) AS lateral FROM samples")
def p23(spark, d):
    s = A.samples(spark, d).withColumn("heading", F.when(F.col("sample_index") % 4 != 0, F.col("sample_index") * 3.0))
    return rounded(s.select("task_id", "sample_index", G.lateral_coordinate(F.col("point_x"), F.col("point_y"), F.col("heading")).alias("lateral")), 6, "lateral")


@query("p31_rigid_2d", f"WITH {A.TRAJECTORY} SELECT task_id, stamp_ns, line, round(cos(0.3) * x - sin(0.3) * y + 5, 6) AS gx, round(sin(0.3) * x + cos(0.3) * y - 7, 6) AS gy, round(x, 6) AS bx, round(y, 6) AS byy FROM trajectory")
def p31(spark, d):
    yaw, tx, ty = F.lit(0.3), F.lit(5.0), F.lit(-7.0)
    t = A.trajectory(spark, d).withColumn("g", G.rigid_2d(F.col("x"), F.col("y"), yaw, tx, ty)).withColumn("b", G.rigid_2d_inverse(F.col("g.x"), F.col("g.y"), yaw, tx, ty))
    return rounded(t.select("task_id", "stamp_ns", "line", F.col("g.x").alias("gx"), F.col("g.y").alias("gy"), F.col("b.x").alias("bx"), F.col("b.y").alias("byy")), 6, "gx", "gy", "bx", "byy")


@query("p5_p6_labels", """SELECT event_id, CASE event_id % 6 WHEN 4 THEN 'RTK_FIXED' WHEN 5 THEN 'RTK_FLOAT' WHEN 2 THEN 'DGPS' WHEN 1 THEN 'SINGLE' ELSE 'UNKNOWN' END AS fix,
CASE WHEN event_type IN ('view', 'click') THEN CASE WHEN user_id % 3 = 0 THEN 'up ' WHEN user_id % 3 = 1 THEN 'down ' ELSE '' END || CASE event_type WHEN 'view' THEN 'left' ELSE 'right' END || ' lane' ELSE 'not recorded' END AS lane,
CASE WHEN event_id % 4 = 0 THEN 'ok' WHEN event_id % 4 = 1 THEN 'warning' WHEN event_id % 4 = 2 THEN 'error' ELSE 'stale' END AS level, least(greatest(value / 100, 0), 1) AS quality, greatest(value, 2.0) AS sigma FROM events""")
def p5(spark, d):
    side = F.when(F.col("event_type") == "view", "left").when(F.col("event_type") == "click", "right").otherwise("none")
    direction = F.when(F.col("user_id") % 3 == 0, "up").when(F.col("user_id") % 3 == 1, "down").otherwise("unknown")
    return A.table(spark, d, "events").select("event_id", X.fix_type(F.col("event_id") % 6).alias("fix"), X.lane_text(F.lit("unknown"), direction, side).alias("lane"), X.diagnostic_level(F.col("event_id") % 4).alias("level"), X.quality(F.col("value") / 100).alias("quality"), X.rtk_sigma(F.col("value"), 2.0).alias("sigma"))


# heights that round to nought have no sign: + 0.0
@query("p7_p10_formats", f"""WITH {A.FIXES} SELECT fix_id, CASE WHEN fix_id % 5 = 0 THEN 'not recorded' ELSE printf('N%.7f E%.7f', lat, lon) || CASE WHEN fix_id % 3 = 0 THEN '' ELSE printf(' H%.3fm', round(alt, 1) + 0.0) END END AS place,
CASE WHEN fix_id % 3 = 0 THEN '0' ELSE printf('%.2f', round(alt, 1) + 0.0) END AS height, CASE WHEN fix_id % 3 = 0 THEN '' WHEN fix_id % 3 = 1 THEN '1' ELSE '0' END AS flag FROM fixes""")
def p7(spark, d):
    alt = F.when(F.col("fix_id") % 3 != 0, F.round("alt", 1))
    flag = F.when(F.col("fix_id") % 3 != 0, F.col("fix_id") % 3 == 1)
    return A.fixes(spark, d).select("fix_id", X.format_endpoint(F.col("lat"), F.col("lon"), alt, F.col("fix_id") % 5 != 0).alias("place"), X.fixed(alt, 2).alias("height"), X.optional_flag(flag).alias("flag"))


@query("p8_times", """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '000Z' AS iso, epoch_us(ts) AS us, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S.%g') || '+08:00' AS local, strftime(ts + INTERVAL 8 HOUR, '%Y%m%d_%H%M%S') AS base, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS day FROM events""")
def p8(spark, d):
    e = A.table(spark, d, "events").withColumn("us0", A.micros()).withColumn("iso", X.ns_to_iso_utc(F.col("us0") * 1000))
    return e.select("event_id", "iso", X.iso_to_micros(F.col("iso")).alias("us"), X.ms_to_local(F.expr("us0 div 1000L")).alias("local"), X.display_base(F.col("us0")).alias("base"), X.local_date(F.col("us0")).alias("day"))


@query("p9_p25_text", r"""SELECT p_partkey, CASE WHEN s = '' THEN 'tunnel' ELSE s END AS safe, m AS marked, CASE WHEN length(trim(p_name)) > 12 THEN 'too_long' END AS violation, true AS usable FROM (
SELECT p_partkey, p_name, substr(trim(regexp_replace(trim('<' || p_name || '> & ' || p_type), '[^0-9A-Za-z._-]+', '_', 'g'), '._'), 1, 80) AS s, replace(replace(replace('<' || p_name || '> & ' || p_type, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS m FROM part)""")
def p9(spark, d):
    t = F.concat(F.lit("<"), F.col("p_name"), F.lit("> & "), F.col("p_type"))
    return A.table(spark, d, "part").select("p_partkey", X.safe_component(t).alias("safe"), X.escape_markup(X.collapse_blanks(t)).alias("marked"), X.text_violation(F.col("p_name"), 12).alias("violation"), X.usable_key(F.concat(F.lit("k-"), F.col("p_partkey"))).alias("usable"))


@query("p20_typed_diagnostics", """SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN event_id END AS frames, value AS load, event_type AS mode FROM events""")
def p20(spark, d):
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    frames = F.when(F.col("event_id") % 5 != 0, F.col("event_id").cast("string")).otherwise("n/a")
    e = A.table(spark, d, "events").withColumn("pairs", F.array(pair("frames", frames), pair("load", F.col("value")), pair("mode", F.col("event_type"))))
    return e.select("event_id", *X.typed_diagnostics(F.col("pairs"), ["frames"], ["load"])).select("event_id", "frames", "load", F.col("other")["mode"].alias("mode"))


@query("p24_request_hash", """SELECT o_orderkey, sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}') AS hash FROM orders""")
def p24(spark, d):
    return A.table(spark, d, "orders").select("o_orderkey", X.request_hash("o_orderkey", "o_custkey", "o_orderstatus").alias("hash"))


@query("p28_p30_gates", """SELECT event_id, event_id % 3 > 0 AND value <= 80 AND event_id % 7 >= 4 AND (event_id % 2 = 0 OR value <= 5) AS reliable,
CASE WHEN event_id % 13 = 0 THEN 'INVALID' WHEN event_id % 2 = 0 AND event_id % 5 <> 0 THEN 'GLOBAL_ALIGNING' WHEN event_id % 3 = 0 AND event_id % 7 = 0 THEN 'GLOBAL_RTK_LIO' WHEN event_id % 3 = 0 THEN 'GLOBAL_RTK_INS' WHEN event_id % 7 = 0 THEN 'LOCAL_LIO' ELSE 'LOCAL_INS' END AS fusion,
CASE WHEN event_id % 11 = 0 THEN 'INVALID' WHEN event_id % 2 = 0 OR event_id % 3 = 0 THEN 'RTK' ELSE 'DEAD_RECKONING' END AS mode FROM events""")
def p28(spark, d):
    k, v = F.col("event_id"), F.col("value")
    one = F.lit(1.0)
    hdop = F.when(k % 2 == 0, F.lit(float("nan"))).otherwise(v)
    return A.table(spark, d, "events").select("event_id",
        X.gnss_reliable(F.lit(0), one, one, one, v / 80, one, k % 3, F.lit("A"), k % 7, hdop).alias("reliable"),
        X.fusion_mode(k % 13 != 0, k % 2 == 0, k % 5 == 0, k % 3 == 0, k % 7 == 0).alias("fusion"), X.localization_mode(k % 11 != 0, k % 2 == 0, k % 3 == 0).alias("mode"))


#: Sentences with the checksums that they are published with.
RMC = "$GPRMC,123519,A,4807.038,N,01131.000,E,022.4,084.4,230394,003.1,W*"
GSA = "$GPGSA,A,3,04,05,,09,12,,,24,,,,,2.5,1.3,2.1*"


def gnss_lines(spark, d):
    """A sentence for each fix, in turn GGA with its place, RMC, GSA, and BESTPOSA with deviations that every fifth lacks; every eleventh has a wrong checksum."""
    k, lat, lon = F.col("fix_id"), F.col("lat"), F.col("lon")
    body = F.format_string("$GPGGA,010203,%02d%010.7f,N,%03d%010.7f,E,%d,%d,0.8,%.1f,M,,M,,*", F.floor(lat).cast("int"), (lat - F.floor(lat)) * 60, F.floor(lon).cast("int"), (lon - F.floor(lon)) * 60, k % 6, 4 + k % 9, F.abs("alt"))
    f = A.fixes(spark, d).withColumn("__b", F.when(k % 4 == 0, body).when(k % 4 == 1, F.lit(RMC)).otherwise(F.lit(GSA)))
    told = F.when(k % 4 == 0, N.checksum(F.col("__b"))).when(k % 4 == 1, F.lit("6A")).otherwise(F.lit("39"))
    place = F.format_string("#BESTPOSA,COM1,0,90.5,FINESTEERING,1949,403742.000,02000000,b1f6,32768;SOL_COMPUTED,SINGLE,%.7f,%.7f,%.1f,-16.2,WGS84,%s,1.3921,2.4639*%s", lat, lon, F.col("alt"), F.when(k % 5 == 0, F.lit("")).otherwise((k % 7 / 10).cast("string")), F.when(k % 11 == 0, F.lit("00000000")).otherwise(F.lit("6ff02e9c")))
    return f.select("task_id", "fix_id", F.when(k % 4 == 3, place).otherwise(F.concat("__b", F.when(k % 11 == 0, F.lit("77")).otherwise(told))).alias("line"))


#: The state of each kind's sentence, null where the line is of another kind or its checksum is wrong.
SENTENCES = f"""{A.FIXES}, line AS (SELECT *, ['GGA', 'RMC', 'GSA', 'BESTPOSA'][fix_id % 4 + 1] AS kind, fix_id % 4 = 3 OR fix_id % 11 <> 0 AS ok FROM fixes),
told AS (SELECT *, CASE WHEN ok AND kind = 'GGA' THEN round(lat, 7) END AS shown_lat, CASE WHEN ok AND kind = 'GGA' THEN round(lon, 7) END AS shown_lon, CASE WHEN ok AND kind = 'GGA' THEN fix_id % 6 END AS state, CASE WHEN ok AND kind = 'GGA' THEN 4 + fix_id % 9 END AS satellites, CASE WHEN ok AND kind = 'RMC' THEN 22.4::DOUBLE END AS speed_knots, CASE WHEN ok AND kind = 'RMC' THEN '230394' END AS date,
CASE WHEN ok AND kind = 'GSA' THEN 2.5::DOUBLE END AS pdop, CASE WHEN kind = 'BESTPOSA' THEN CASE WHEN fix_id % 5 = 0 THEN 0 ELSE round(fix_id % 7 / 10.0::DOUBLE, 4) END END AS lat_sigma FROM line)"""


@query("p21_gnss_sentences", f"WITH {SENTENCES} SELECT fix_id, kind, ok, shown_lat AS lat, shown_lon AS lon, state, satellites, speed_knots, date, pdop, lat_sigma FROM told")
def p21(spark, d):
    out = N.parse_sentences(gnss_lines(spark, d)).select("fix_id", "kind", "ok", "gga.lat", "gga.lon", "gga.state", "gga.satellites", "rmc.speed_knots", "rmc.date", "gsa.pdop", F.round("bestpos.lat_sigma", 4).alias("lat_sigma"))
    return rounded(out, 7, "lat", "lon").withColumns({c: F.col(c).cast("long") for c in ("state", "satellites")})


@query("a27_sentence_counters", f"WITH {SENTENCES} SELECT kind, count(*) AS n, count(*) FILTER (WHERE NOT ok) AS bad FROM told GROUP BY kind")
def a27(spark, d):
    return N.sentence_counters(N.parse_sentences(gnss_lines(spark, d)))


@query("w22_state_fold", f"WITH {SENTENCES} SELECT task_id, fix_id, {', '.join(f'last_value({c} IGNORE NULLS) OVER (PARTITION BY task_id ORDER BY fix_id ROWS UNBOUNDED PRECEDING) AS {c}' for c in ('state', 'speed_knots', 'pdop', 'lat_sigma'))} FROM told")
def w22(spark, d):
    folded = N.state_fold(N.parse_sentences(gnss_lines(spark, d)), "task_id", "fix_id")
    return folded.select("task_id", "fix_id", F.col("gga.state").cast("long").alias("state"), "rmc.speed_knots", "gsa.pdop", F.round("bestpos.lat_sigma", 4).alias("lat_sigma"))
