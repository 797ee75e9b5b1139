"""Fits of local trajectories to global places, from sums by key. Pairs: key, x, y (local), east, north (global)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import HeadingConfig
from ..functions.geodesy import finite, wrap_radians


def _moments(pairs: DataFrame, key: str) -> DataFrame:
    g = pairs.groupBy(key).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in ("x", "y", "east", "north")], F.hypot(F.max("east") - F.min("east"), F.max("north") - F.min("north")).alias("baseline"),
        *[F.covar_pop(a, b).alias(f"{a}_{b}") for a in ("x", "y") for b in ("east", "north")], (F.var_pop("x") + F.var_pop("y")).alias("spread"))
    return g.withColumn("re", F.col("x_east") + F.col("y_north")).withColumn("im", F.col("x_north") - F.col("y_east"))


def similarity_fit(pairs: DataFrame, key: str = "task_id", *, min_samples: int = 5, min_baseline: float = 10.0, min_scale: float = 0.8, max_scale: float = 1.2, max_rms: float = 5.0) -> DataFrame:
    """Scale, yaw, shift, rms and baseline of each key's fit, and the first reason against it (NONE if it is valid)."""
    ok = pairs.where(finite(F.col("x"), F.col("y"), F.col("east"), F.col("north")))
    m = _moments(ok, key).withColumn("scale", F.hypot("re", "im") / F.col("spread")).withColumn("yaw", wrap_radians(F.atan2("im", "re")))
    m = m.withColumn("tx", F.col("m_east") - F.col("scale") * (F.cos("yaw") * F.col("m_x") - F.sin("yaw") * F.col("m_y"))).withColumn("ty", F.col("m_north") - F.col("scale") * (F.sin("yaw") * F.col("m_x") + F.cos("yaw") * F.col("m_y")))
    fit = m.select(key, "n", "baseline", "spread", "scale", "yaw", "tx", "ty")
    px = F.col("tx") + F.col("scale") * (F.cos("yaw") * F.col("x") - F.sin("yaw") * F.col("y")) - F.col("east")
    py = F.col("ty") + F.col("scale") * (F.sin("yaw") * F.col("x") + F.cos("yaw") * F.col("y")) - F.col("north")
    rms = ok.join(fit, key).groupBy(key).agg(F.sqrt(F.avg(px * px + py * py)).alias("rms"))
    reason = F.when(F.col("n") < max(2, min_samples), "INSUFFICIENT_SAMPLES").when(F.col("baseline") < min_baseline, "BASELINE_TOO_SHORT").when(F.col("spread") * F.col("n") <= 1e-12, "DEGENERATE_SOURCE_TRAJECTORY").when(~F.col("scale").between(min_scale, max_scale), "SCALE_OUT_OF_RANGE").when(F.col("rms") > max_rms, "RESIDUAL_TOO_LARGE").otherwise("NONE")
    return fit.join(rms, key).withColumn("reason", reason).drop("spread")


def _rigid(pairs: DataFrame, key: str) -> DataFrame:
    m = _moments(pairs, key).withColumn("yaw", wrap_radians(F.atan2("im", "re")))
    return m.select(key, "n", "baseline", "yaw", (F.col("m_east") - (F.cos("yaw") * F.col("m_x") - F.sin("yaw") * F.col("m_y"))).alias("tx"), (F.col("m_north") - (F.sin("yaw") * F.col("m_x") + F.cos("yaw") * F.col("m_y"))).alias("ty"))


def _residual(rows: DataFrame) -> DataFrame:
    px = F.col("tx") + F.cos("yaw") * F.col("x") - F.sin("yaw") * F.col("y") - F.col("east")
    py = F.col("ty") + F.sin("yaw") * F.col("x") + F.cos("yaw") * F.col("y") - F.col("north")
    return rows.withColumn("residual", F.hypot(px, py))


def rigid_heading_fit(pairs: DataFrame, key: str = "task_id", *, floor: float = 20.0, inlier_ratio: float = 0.7) -> DataFrame:
    """A fit of unit scale, a cut at max(floor, median + 3 * 1.4826 * MAD) of its residuals, and a second fit to the rest:
    three aggregates by key."""
    first = _residual(pairs.join(_rigid(pairs, key).drop("n", "baseline"), key))
    mid = first.groupBy(key).agg(F.percentile("residual", F.lit(0.5)).alias("mid"))
    off = first.join(mid, key)
    mad = off.groupBy(key).agg(F.first("mid").alias("mid"), F.percentile(F.abs(F.col("residual") - F.col("mid")), F.lit(0.5)).alias("mad"), F.count("*").alias("all"))
    inside = first.join(mad, key).where(F.col("residual") <= F.greatest(F.lit(floor), F.col("mid") + 3 * 1.4826 * F.col("mad"))).select(*pairs.columns, "all")
    fit = _rigid(inside, key)
    last = _residual(inside.join(fit, key)).groupBy(key).agg(F.sqrt(F.avg(F.pow("residual", 2))).alias("rmse"), F.percentile("residual", F.array(F.lit(0.5), F.lit(0.95))).alias("q"), F.max("residual").alias("max"), F.first("all").alias("all"))
    return fit.join(last, key).select(key, "n", "yaw", "tx", "ty", "baseline", "rmse", F.col("q")[0].alias("median"), F.col("q")[1].alias("p95"), "max", (F.col("n") / F.col("all") >= inlier_ratio).alias("valid"))


def spacing_filter(rows: DataFrame, spacing: float = 5.0, most: int = 100, order_by: str = "seq") -> DataFrame:
    """Rows in arrival order whose local place (x, y) is at least so far from the last one accepted and whose stamp is later; rows
    with a part that isn't finite are refused. The newest most of them by task (a fold, one group for each task)."""

    def fold(task: pd.DataFrame) -> pd.DataFrame:
        t, kept, last = task.sort_values(order_by, kind="stable"), [], None
        whole = np.isfinite(t[["x", "y", "east", "north"]].to_numpy(float)).all(axis=1)
        for i, ok, stamp, x, y in zip(t.index, whole, t["stamp_ns"], t["x"], t["y"], strict=True):
            if ok and (last is None or (stamp > last[0] and np.hypot(x - last[1], y - last[2]) >= spacing)):
                kept.append(i)
                last = (stamp, x, y)
        return t.loc[kept[-most:]]

    return rows.groupBy("task_id").applyInPandas(fold, rows.schema)


def heading_filter(fits: DataFrame, c: HeadingConfig = HeadingConfig()) -> DataFrame:
    """(task_id, seq, yaw, accepted, valid, reason): fits in order through the gates, then smoothed; a jump from the smoothed yaw is
    refused. fits: task_id, seq, fit_valid, fit_reason, n, baseline, ratio, rmse, p95, inlier_ratio, yaw. The gates are column expressions;
    only the smoothing is a fold, of one row a fit by task."""
    gate = (F.when(~F.col("fit_valid"), F.col("fit_reason")).when(F.col("n") < max(2, c.min_samples), "INSUFFICIENT_SAMPLES").when(F.col("baseline") < c.min_baseline, "COLLECTING_BASELINE")
        .when(~F.col("ratio").between(c.ratio_min, c.ratio_max), "BASELINE_RATIO_OUT_OF_RANGE").when(F.col("rmse") > c.max_rmse, "RMSE_TOO_LARGE").when(F.col("p95") > c.max_p95, "P95_RESIDUAL_TOO_LARGE")
        .when(F.col("inlier_ratio") < c.min_inlier_ratio, "INLIER_RATIO_TOO_LOW"))
    gated = fits.select("task_id", "seq", "yaw", "baseline", gate.alias("reason"))

    def fold(task: pd.DataFrame) -> pd.DataFrame:
        t, now, out = task.sort_values("seq", kind="stable"), None, []
        for yaw, baseline, reason in zip(t["yaw"].tolist(), t["baseline"].tolist(), t["reason"].tolist(), strict=True):
            if reason is not None:
                out.append((yaw, reason == "COLLECTING_BASELINE", False, reason))
                continue
            step = 0.0 if now is None else (yaw - now + np.pi) % (2 * np.pi) - np.pi
            if abs(step) > c.max_jump:
                out.append((now, False, False, "UPDATE_JUMP_EXCEEDED"))
                continue
            now = yaw if now is None else (now + c.alpha * step + np.pi) % (2 * np.pi) - np.pi
            out.append((now, True, baseline >= c.valid_baseline, "NONE" if baseline >= c.valid_baseline else "PROVISIONAL_BASELINE"))
        return pd.DataFrame(out, columns=["yaw", "accepted", "valid", "reason"]).assign(task_id=t["task_id"].to_numpy(), seq=t["seq"].to_numpy())[["task_id", "seq", "yaw", "accepted", "valid", "reason"]]

    kind = fits.schema["task_id"].dataType.simpleString()
    return gated.groupBy("task_id").applyInPandas(fold, f"task_id {kind}, seq long, yaw double, accepted boolean, valid boolean, reason string")


def rate_limit(rows: DataFrame, period_ns: int) -> DataFrame:
    """Rows that run: the first, and each one a period or more after the last one that ran (a fold by task)."""

    def fold(task: pd.DataFrame) -> pd.DataFrame:
        t, kept, last = task.sort_values(["t", "seq"], kind="stable"), [], None
        for i, at in zip(t.index, t["t"], strict=True):
            if last is None or at - last >= period_ns:
                kept.append(i)
                last = at
        return t.loc[kept]

    return rows.groupBy("task_id").applyInPandas(fold, rows.schema)
