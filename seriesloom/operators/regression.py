"""Models of cost per point against chunk length, fitted as aggregates.

Five models: hyperbolic a + b/x, logarithmic a + b ln x, power a x^b,
exponential a e^(bx), quadratic a + bx + cx^2 (a line for under three points or
a singular system). The quadratic one solves the true least-squares equations.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODELS = ["hyperbolic", "logarithmic", "power", "exponential", "polynomial"]
COEFFICIENTS = {"hyperbolic": 2, "logarithmic": 2, "power": 2, "exponential": 2, "polynomial": 3}


def evaluate(model: str, x: Column, c: Sequence[Column]) -> Column:
    """A model's value at x."""
    if model == "hyperbolic":
        return c[0] + c[1] / x
    if model == "logarithmic":
        return c[0] + c[1] * F.log(x)
    if model == "power":
        return c[0] * F.pow(x, c[1])
    if model == "exponential":
        return c[0] * F.exp(c[1] * x)
    return c[0] + c[1] * x + c[2] * x * x


def estimate(model: str, coefficients: Sequence[float], ppm: Column) -> Column:
    """Estimated bytes per point; infinite for ppm <= 0."""
    model = model_name(model)
    if len(coefficients) != COEFFICIENTS[model]:
        raise ValueError(f"{model} has {COEFFICIENTS[model]} coefficients")
    value = evaluate(model, F.greatest(ppm, F.lit(1)).cast("double"), [F.lit(float(v)) for v in coefficients])
    return F.when(ppm <= 0, F.lit(math.inf)).otherwise(value)


def model_name(name: str) -> str:
    """The model of a name in any case."""
    low = name.lower()
    if low not in MODELS:
        raise ValueError(f"no model {name!r}; one of {', '.join(MODELS)}")
    return low


def _det(m: list[list[Column]]) -> Column:
    (a, b, c), (d, e, f), (g, h, i) = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def fits(df: DataFrame, x: str = "ppm", y: str = "bpp", keys: list[str] | None = None) -> DataFrame:
    """(keys, model, model_ord, a, b, c, r2, rmse, n): one row per model and group.

    A logarithm needs x > 0 (and y > 0 for power and exponential). Groups with
    fewer than two points give no row. r2 is on the original scale, 0 without
    variation, and may be negative.
    """
    keys = keys or []
    rows = df.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    lx, ly = F.when(F.col("x") > 0, F.log("x")), F.when(F.col("y") > 0, F.log("y"))
    inverse = F.when(F.col("x") != 0, 1 / F.col("x"))
    s = lambda e: F.sum(e)
    X, Y = F.col("x"), F.col("y")
    both = F.when(lx.isNotNull(), ly)
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope(Y, inverse).alias("hb"), F.regr_intercept(Y, inverse).alias("ha"),
        F.regr_slope(Y, lx).alias("lb"), F.regr_intercept(Y, lx).alias("la"),
        F.regr_slope(both, lx).alias("pb"), F.regr_intercept(both, lx).alias("pa"),
        F.regr_slope(ly, X).alias("eb"), F.regr_intercept(ly, X).alias("ea"),
        F.regr_slope(Y, X).alias("sb"), F.regr_intercept(Y, X).alias("sa"),
        s(X).alias("s1"), s(X * X).alias("s2"), s(X * X * X).alias("s3"), s(X * X * X * X).alias("s4"),
        s(Y).alias("t0"), s(X * Y).alias("t1"), s(X * X * Y).alias("t2"),
        F.avg(Y).alias("ybar"),
    ).where("n >= 2")
    n, s1, s2, s3, s4, t0, t1, t2 = (F.col(k) for k in ("n", "s1", "s2", "s3", "s4", "t0", "t1", "t2"))
    base = [[n, s1, s2], [s1, s2, s3], [s2, s3, s4]]
    right = [t0, t1, t2]
    det = _det(base)
    solved = [_det([[right[r] if c == k else base[r][c] for c in range(3)] for r in range(3)]) for k in range(3)]
    flat = (n < 3) | (F.abs(det) < 1e-10)
    quadratic = [F.when(flat, F.col("sa")).otherwise(solved[0] / det), F.when(flat, F.col("sb")).otherwise(solved[1] / det), F.when(flat, F.lit(0.0)).otherwise(solved[2] / det)]
    none = F.lit(None).cast("double")
    shape = [
        ("hyperbolic", [F.col("ha"), F.col("hb"), none]),
        ("logarithmic", [F.col("la"), F.col("lb"), none]),
        ("power", [F.exp("pa"), F.col("pb"), none]),
        ("exponential", [F.exp("ea"), F.col("eb"), none]),
        ("polynomial", quadratic),
    ]
    one = F.array(*[F.struct(F.lit(i).alias("model_ord"), F.lit(m).alias("model"), c[0].alias("a"), c[1].alias("b"), c[2].alias("c")) for i, (m, c) in enumerate(shape)])
    models = sums.select(*keys, "n", "ybar", F.explode(one).alias("m")).select(*keys, "n", "ybar", "m.*").where("a is not null and b is not null")
    joined = models.join(rows, keys) if keys else _all_pairs(models, rows)
    value = F.lit(None).cast("double")
    for m in MODELS:
        value = F.when(F.col("model") == m, evaluate(m, F.col("x"), [F.col("a"), F.col("b"), F.col("c")])).otherwise(value)
    joined = joined.withColumn("e", F.col("y") - value)
    out = joined.groupBy(*keys, "model", "model_ord", "a", "b", F.coalesce("c", F.lit(math.nan)).alias("c0"), "n", "ybar").agg(
        F.sum(F.col("e") * F.col("e")).alias("res"), F.sum((F.col("y") - F.col("ybar")) * (F.col("y") - F.col("ybar"))).alias("tot")
    )
    return out.select(
        *keys, "model", "model_ord", "a", "b", F.when(~F.isnan("c0"), F.col("c0")).alias("c"),
        F.when(F.col("tot") == 0, 0.0).otherwise(1 - F.col("res") / F.col("tot")).alias("r2"),
        F.sqrt(F.col("res") / F.col("n")).alias("rmse"), "n",
    )


def _all_pairs(models: DataFrame, rows: DataFrame) -> DataFrame:
    """Each point beside each of the five models of an ungrouped fit, through a constant key."""
    return rows.withColumn("__k", F.lit(1)).join(F.broadcast(models.withColumn("__k", F.lit(1))), "__k").drop("__k")  # five rows


def ranked(fitted: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """fits with rank: 1 for the largest r2, ties in the order of MODELS."""
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc_nulls_last("r2"), "model_ord")  # five rows a group
    return fitted.withColumn("rank", F.row_number().over(w))


def quality(r2: Column) -> Column:
    """A word for how well a model fits."""
    return F.when(r2 >= 0.98, "excellent").when(r2 >= 0.95, "very good").when(r2 >= 0.90, "good").when(r2 >= 0.80, "moderate").otherwise("poor")


def formula(model: Column, a: Column, b: Column, c: Column) -> Column:
    """The model as text; a line where the quadratic model has no third coefficient."""
    f = lambda pattern, *args: F.format_string(pattern, *args)
    # Fixed formats, one for each model.
    return (
        F.when(model == "hyperbolic", f("BPP = %.2f + %.2f / PPM", a, b))
        .when(model == "logarithmic", f("BPP = %.2f + %.2f * ln(PPM)", a, b))
        .when(model == "power", f("BPP = %.2f * PPM^%.3f", a, b))
        .when(model == "exponential", f("BPP = %.2f * e^(%.3f * PPM)", a, b))
        .when(F.coalesce(c, F.lit(0.0)) == 0, f("BPP = %.2f + %.2f*PPM", a, b))
        .otherwise(f("BPP = %.2f + %.2f*PPM + %.2f*PPM²", a, b, c))
    )


def recommendations(measured: DataFrame, x: str = "ppm", y: str = "bpp", limits: tuple[float, float, float] = (11.0, 9.8, 9.3)) -> DataFrame:
    """One row: min_acceptable (first x with y below the first limit), optimal_start (first below the second), optimal_end (last below the third), diminishing_after.

    diminishing_after: the last x but one if the last step gains less than 0.1, and there are more than three.
    """
    tail = measured.agg(F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y")))).alias("l"))  # a row a ladder step
    last, but = F.element_at("l", -1), F.get("l", F.size("l") - 2)
    after = tail.select(F.when((F.size("l") > 3) & (but["y"] - last["y"] < 0.1), but["x"]).alias("diminishing_after"), F.lit(1).alias("__k"))
    firsts = measured.agg(
        F.min(F.when(F.col(y) < limits[0], F.col(x))).alias("min_acceptable"), F.min(F.when(F.col(y) < limits[1], F.col(x))).alias("optimal_start"), F.max(F.when(F.col(y) < limits[2], F.col(x))).alias("optimal_end"), F.lit(1).alias("__k")
    )
    return firsts.join(F.broadcast(after), "__k", "left").drop("__k")
