"""The unit cases of the low-event analysis: a straight tunnel of 61 rows, a metre apart."""

from clearspan.operators import anomaly


def tunnel(spark, lows=None, period=1.0):
    lows = lows or {}
    rows = []
    for i in range(61):
        h = lows.get(i, 7.0 + 0.02 * (i % 5 - 2))
        x, y, z = (25.0, 10.0, h - 2.25) if i in lows else (0.0, 0.0, h - 2.25)
        rows.append((1, i, h, True, i, i * period, 0.0, 0.0, x, y, z, 90.0))
    return spark.createDataFrame(rows, "task_id long, sample_index long, height double, valid boolean, source_sequence long, odo_x double, odo_y double, odo_z double, point_x double, point_y double, point_z double, heading double")


def test_clean_tunnel_has_no_event(spark):
    events, roll = anomaly.analyze(tunnel(spark))
    assert events.count() == 0
    r = roll.first()
    assert round(r.raw_min, 6) == round(r.effective_min, 6) == 6.96


def test_single_low_row_is_an_outlier(spark):
    events, roll = anomaly.analyze(tunnel(spark, {30: 3.8}))
    assert [e.status for e in events.collect()] == [anomaly.OUTLIER]
    r = roll.first()
    assert r.raw_min == 3.8 and r.effective_min > 6.9


def test_structure_of_two_metres_stays(spark):
    events, roll = anomaly.analyze(tunnel(spark, {29: 5.0, 30: 5.0, 31: 5.0}))
    assert [e.status for e in events.collect()] == [anomaly.STRUCTURE]
    assert roll.first().effective_min == 5.0


def test_three_even_lows_are_protected_and_two_are_not(spark):
    events, _ = anomaly.analyze(tunnel(spark, {15: 5.0, 30: 5.0, 45: 5.0}))
    assert {e.status for e in events.collect()} == {anomaly.PERIODIC}
    events, _ = anomaly.analyze(tunnel(spark, {15: 5.0, 45: 5.0}))
    assert anomaly.PERIODIC not in {e.status for e in events.collect()}


def test_without_positions_rows_are_reviewed(spark):
    from pyspark.sql import functions as F

    s = tunnel(spark, {30: 3.8}).withColumn("odo_x", F.lit(None).cast("double"))
    events, roll = anomaly.analyze(s)
    assert {e.status for e in events.collect()} == {anomaly.REVIEW}
    assert roll.first().effective_min == 3.8


def test_an_analysis_spreads_over_tasks(spark, monkeypatch):
    """Partitions follow the number of samples, whatever the shuffles' size."""
    monkeypatch.setattr(anomaly, "SAMPLES_A_TASK", 10)
    asked = []
    plain = anomaly.travel_distance
    monkeypatch.setattr(anomaly, "travel_distance", lambda s, c: asked.append(s.rdd.getNumPartitions()) or plain(s, c))
    e = spark.range(200).selectExpr("id % 9 AS task_id", "id AS sample_index", "5.0 AS height", "true AS valid", "id AS source_sequence", *[f"(id + 1) * 0.5D AS {p}_{a}" for p in ("odo", "point") for a in "xyz"])
    assert anomaly.analyze(e)[1].agg({"n_valid": "sum"}).first()[0] == 200
    assert asked == [21]


def plain_groups(events, c):
    """The search as one loop, whatever the number of events: events of one task as rows (event, centre, length, min_height, lateral, rep_z)."""

    def alike(a, b):
        short, long = sorted((a[2], b[2]))
        apart = [abs(x - y) > most for x, y, most in zip(a[3:], b[3:], (c.periodic_height, c.periodic_lateral, c.periodic_vertical)) if x is not None and y is not None]
        return (long <= 1e-9 or short > 1e-9 and long / short <= c.periodic_length_ratio) and not any(apart)

    candidates, groups = [], {}
    for i, a in enumerate(events):
        for j in range(i + 1, len(events)):
            period = (events[j][1] - a[1]) / (j - i)
            if period < c.periodic_min_spacing:
                continue
            members, ordinals, total = [], set(), 0.0
            for k, b in enumerate(events):
                ordinal = round((b[1] - a[1]) / period)
                residual = abs(b[1] - (a[1] + ordinal * period))
                if alike(a, b) and residual <= max(c.periodic_tolerance, c.periodic_tolerance_ratio * period) and ordinal not in ordinals:
                    ordinals.add(ordinal)
                    members.append(k)
                    total += residual
            if len(members) >= c.periodic_min_events:
                candidates.append((-len(members), total, period, members))
    for _, _, period, members in sorted(candidates, key=lambda f: f[:3]):
        free = [k for k in members if k not in groups]
        if len(free) >= c.periodic_min_events:
            number = len({g for g, _ in groups.values()}) + 1
            groups |= {k: (f"P{number:03d}", period) for k in free}
    return {(e[0], *groups.get(k, (None, None))) for k, e in enumerate(events)}


def made_events(n, seed):
    """Events at uneven spacings, of three heights about and mixed lengths; some have no lateral place."""
    import random

    r, at, rows = random.Random(seed), 0.0, []
    for k in range(n):
        at += 2.1 + r.expovariate(0.25)
        h = r.choice((3.0, 4.0, 4.5)) + r.random() * 0.3
        rows.append((k + 1, at, r.choice((0.0, 0.5, 0.8, 1.5)), h, None if k % 11 == 5 else r.choice((0.0, 0.25, 1.0)), h - 2.25))
    return rows


def found_groups(spark, tasks, c):
    import math

    rows = [(task, *e) for task, events in tasks.items() for e in events]
    d = spark.createDataFrame(rows, "task_id long, event long, centre double, length double, min_height double, lateral double, rep_z double")
    found = {}
    for r in anomaly.periodic_groups(d, c).collect():
        found.setdefault(r.task_id, set()).add((r.event, r.group, None if r.period is None or math.isnan(r.period) else r.period))
    return found


def test_groups_of_large_tasks_are_those_of_the_plain_search(spark):
    """Tasks of more events than one group takes have the same groups as any other, beside tasks of few and of none alike."""
    c = anomaly.DEFAULT
    tasks = {1: made_events(150, 1), 2: made_events(170, 2), 3: made_events(40, 3), 4: [(k + 1, k * 10.0, 0.0, k * 1.0, 0.0, 0.0) for k in range(140)], 5: made_events(2, 5)}
    found = found_groups(spark, tasks, c)
    assert found == {task: plain_groups(events, c) for task, events in tasks.items()}
    assert all(any(g for _, g, _ in found[task]) for task in (1, 2, 3))


def test_groups_do_not_depend_on_the_way_they_are_found(spark, monkeypatch):
    """Small blocks and batches give what one group gives."""
    from dataclasses import replace

    tasks = {task: made_events(60 + task, task) for task in range(4)}
    whole = found_groups(spark, tasks, anomaly.DEFAULT)
    monkeypatch.setattr(anomaly, "ANCHORS", 7)
    monkeypatch.setattr(anomaly, "PAIRS_A_TASK", 100)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        assert found_groups(spark, tasks, replace(anomaly.DEFAULT, periodic_max_events=5)) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def long_tunnel(spark):
    """150 even lows in one recording and a lone lower one."""
    rows = []
    for i in range(1530):
        h = 3.0 if i == 705 else 5.0 if i % 10 == 0 and 0 < i <= 1500 else 7.0 + 0.02 * (i % 5 - 2)
        x, y, z = (25.0, 10.0, h - 2.25) if h <= 5 else (0.0, 0.0, h - 2.25)
        rows.append((1, i, h, True, i, i * 1.0, 0.0, 0.0, x, y, z, 90.0))
    return spark.createDataFrame(rows, "task_id long, sample_index long, height double, valid boolean, source_sequence long, odo_x double, odo_y double, odo_z double, point_x double, point_y double, point_z double, heading double")


def test_a_long_tunnel_of_even_lows_is_protected(spark):
    """Many even lows are a periodic structure as three are; the lone one is an outlier."""
    events, roll = anomaly.analyze(long_tunnel(spark))
    status = [(e.start, e.status) for e in events.collect()]
    assert len(status) == 151 and {at for at, kind in status if kind == anomaly.OUTLIER} == {705.0}
    assert sum(kind == anomaly.PERIODIC for _, kind in status) == 150
    assert roll.first().effective_min == 5.0


def test_the_trace_of_a_long_tunnel_holds_its_periodic_events(spark):
    import json

    trace = json.loads(anomaly.analysis_trace(*anomaly.analyze(long_tunnel(spark))).first().trace)
    kinds = [e["status"] for e in trace["low_events"]]
    assert len(kinds) == 151 and kinds.count(anomaly.PERIODIC) == 150 and kinds.count(anomaly.OUTLIER) == 1
    assert (trace["raw_min"], trace["effective_min"]) == (3.0, 5.0)
