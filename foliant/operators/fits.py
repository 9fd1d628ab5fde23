"""Least-squares fits and searches over run tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parabola_minimum(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """(by, a, b, c, best_x): y fitted by a x^2 + b x + c; best_x is the vertex where a > 0, else the x of the least y.

    Sums of powers, taken around the group's mean, give the normal equations; they are solved in closed form.
    """
    means = df.groupBy(by).agg(F.avg(x).alias("_m"))
    held = df.join(means, by).withColumn("_x", F.col(x) - F.col("_m"))
    s = lambda p, q: F.sum(F.pow("_x", F.lit(p)) * F.pow(F.col(y), F.lit(q)))
    sums = held.groupBy(by).agg(F.first("_m").alias("m"), F.count("*").cast("double").alias("n"), *(s(p, 0).alias(f"x{p}") for p in range(1, 5)), *(s(p, 1).alias(f"y{p}") for p in range(3)), F.min_by(x, y).alias("least_x"))
    c = {k: F.col(k) for k in ("m", "n", "x1", "x2", "x3", "x4", "y0", "y1", "y2")}

    def det(p: list[list[Column]]) -> Column:
        (a, b, d), (e, f, g), (h, i, j) = p
        return a * (f * j - g * i) - b * (e * j - g * h) + d * (e * i - f * h)

    whole = det([[c["n"], c["x1"], c["x2"]], [c["x1"], c["x2"], c["x3"]], [c["x2"], c["x3"], c["x4"]]])
    c0 = det([[c["y0"], c["x1"], c["x2"]], [c["y1"], c["x2"], c["x3"]], [c["y2"], c["x3"], c["x4"]]])
    c1 = det([[c["n"], c["y0"], c["x2"]], [c["x1"], c["y1"], c["x3"]], [c["x2"], c["y2"], c["x4"]]])
    c2 = det([[c["n"], c["x1"], c["y0"]], [c["x1"], c["x2"], c["y1"]], [c["x2"], c["x3"], c["y2"]]])
    f0, f1, f2 = (F.try_divide(k, whole) for k in (c0, c1, c2))
    out = sums.select(by, "m", "least_x", f2.alias("a"), f1.alias("b1"), f0.alias("c0"))
    best = F.when(F.col("a") > 0, F.col("m") - F.col("b1") / (2 * F.col("a"))).otherwise(F.col("least_x"))
    return out.select(by, "a", (F.col("b1") - 2 * F.col("a") * F.col("m")).alias("b"), (F.col("c0") - F.col("b1") * F.col("m") + F.col("a") * F.col("m") * F.col("m")).alias("c"), best.alias("best_x"))


def interpolated(points: DataFrame, wanted: DataFrame, by: str, x: str, y: str, at: str) -> DataFrame:
    """(by, at, value): y between the two points around each wanted x; beyond the ends the end's y.

    Points and wanted places are put in one order, and the last and next point are carried along: no range join.
    """
    both = points.select(by, F.col(x).alias("_x"), F.col(y).alias("_y"), F.lit(0).alias("_w")).unionByName(wanted.select(by, F.col(at).alias("_x"), F.lit(None).cast("double").alias("_y"), F.lit(1).alias("_w")))
    point = F.when(F.col("_w") == 0, F.struct("_x", "_y"))
    before = F.last(point, ignorenulls=True).over(Window.partitionBy(by).orderBy("_x", "_w").rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(point, ignorenulls=True).over(Window.partitionBy(by).orderBy("_x", "_w").rowsBetween(0, Window.unboundedFollowing))
    placed = both.withColumn("_a", before).withColumn("_b", after).where("_w = 1")
    part = (F.col("_x") - F.col("_a._x")) / (F.col("_b._x") - F.col("_a._x"))
    value = F.when(F.col("_a").isNull(), F.col("_b._y")).when(F.col("_b").isNull(), F.col("_a._y")).otherwise(F.col("_a._y") + part * (F.col("_b._y") - F.col("_a._y")))
    return placed.select(by, F.col("_x").alias(at), value.alias("value"))


def power_law(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """(by, exponent, factor): y = factor * x^exponent, fitted in logarithms; values of 0 and less are left out."""
    held = df.where((F.col(x) > 0) & (F.col(y) > 0)).select(by, F.log10(x).alias("u"), F.log10(y).alias("v"))
    return held.groupBy(by).agg(F.regr_slope("v", "u").alias("exponent"), F.pow(F.lit(10.0), F.regr_intercept("v", "u")).alias("factor"))


def line(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """(by, slope, intercept, r2)."""
    return df.groupBy(by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def ridge(df: DataFrame, xs: list[str], y: str, alphas: list[float]) -> list[tuple[float, list[float]]]:
    """(alpha, intercept and weights) for each alpha; the intercept isn't shrunk. Only the sums reach the driver."""
    names = ["1", *xs]
    sums = [F.expr(f"sum(cast({a} as double) * {b})") for i, a in enumerate(names) for b in names[i:]] + [F.expr(f"sum(cast({a} as double) * {y})") for a in names]
    row = df.where(" and ".join(f"{c} is not null" for c in (*xs, y))).agg(*(s.alias(f"s{i}") for i, s in enumerate(sums))).first()
    k = len(names)
    left = np.zeros((k, k))
    left[np.triu_indices(k)] = row[:-k]
    left = left + left.T - np.diag(np.diag(left))
    return [(a, np.linalg.solve(left + a * np.diag([0.0] + [1.0] * (k - 1)), np.array(row[-k:])).tolist()) for a in alphas]


def best_predictor(df: DataFrame, xs: list[str], y: str) -> DataFrame:
    """(name, r2) of the predictor that explains y best; the first of equals."""
    fits = df.agg(*(F.regr_r2(y, x).alias(x) for x in xs))
    each = fits.select(F.explode(F.array(*(F.struct(F.lit(x).alias("name"), F.col(x).alias("r2")) for x in xs))).alias("e")).select("e.*")
    return each.where("r2 is not null").groupBy().agg(F.min_by("name", F.struct(-F.col("r2"), F.col("name"))).alias("name"), F.max("r2").alias("r2"))


def first_success(attempts: DataFrame, by: str, order: str) -> DataFrame:
    """(by, order) of the first attempt that worked."""
    return attempts.where("ok").groupBy(by).agg(F.min(order).alias(order))


def largest_before_failure(probes: DataFrame, by: str, order: str) -> DataFrame:
    """(by, order): the last of the ascending probes before the first that failed."""
    failed = probes.where(~F.coalesce(F.col("ok"), F.lit(False))).groupBy(by).agg(F.min(order).alias("_failed"))
    return probes.join(failed, by, "left").where(F.col("_failed").isNull() | (F.col(order) < F.col("_failed"))).groupBy(by).agg(F.max(order).alias(order))


def still_to_run(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")


def nearest_divisor(size: Column, wanted: Column) -> Column:
    """The divisor of ``size`` nearest to ``wanted``; the smaller of two."""
    divisors = F.filter(F.sequence(F.lit(1), size.cast("int")), lambda i: F.pmod(size, i) == 0)
    return F.array_min(F.transform(divisors, lambda i: F.struct(F.abs(i - wanted).alias("d"), i.cast("int").alias("i"))))["i"]


def largest_divisor(size: Column, most: Column) -> Column:
    return F.array_max(F.filter(F.sequence(F.lit(1), size.cast("int")), lambda i: (F.pmod(size, i) == 0) & (i <= most)))


def last_match(lines: DataFrame, by: str, order: str, patterns: dict[str, str]) -> DataFrame:
    """(by, a column a pattern): the first group of the last line that matches; null where none does."""
    out = []
    for name, pattern in patterns.items():
        hit = F.when(F.col("value").rlike(pattern), F.regexp_extract("value", pattern, 1))
        out.append(F.max_by(hit, F.when(hit.isNotNull(), F.col(order))).alias(name))
    return lines.groupBy(by).agg(*out)


def latest_step(names: DataFrame) -> DataFrame:
    """One row: the greatest number in names like ``model_000123.pt``; other names don't count."""
    number = F.nullif(F.regexp_extract("name", r"^model_(\d+)\.pt$", 1), F.lit("")).cast("bigint")
    return names.agg(F.max(number).alias("step"))


def hours(params: Column, ratio: Column, tok_per_sec: Column) -> Column:
    return ratio * params / tok_per_sec / 3600
