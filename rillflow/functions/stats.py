"""Statistics of layers: summaries, the quantile families, histograms and Q-Q points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Plotting constants (a, b) of the continuous quantile types: position = a + (n + b) p, counted from one.
CONTINUOUS = {4: (0.0, 0.0), 5: (0.5, 0.0), 6: (0.0, 1.0), 7: (1.0, -1.0), 8: (1 / 3, 1 / 3), 9: (3 / 8, 1 / 4), "m": (0.4, 0.2), "matlab": (0.5, 0.0)}


def summary(cells: DataFrame, c: str) -> DataFrame:
    """Count, nodata count, min, max, mean and population deviation of each raster; NULL is skipped."""
    return cells.groupBy("raster_id").agg(
        F.count(F.lit(1)).alias("n"), F.count(c).alias("n_valid"), F.min(c).alias("min"), F.max(c).alias("max"),
        F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"))


def quantiles(cells: DataFrame, c: str, probs: list[float], kind: int | str = 7) -> DataFrame:
    """raster_id, p, q: sample quantiles of each raster by the given type.

    Types 4-9 (and "m", "matlab") interpolate; 1 takes the next value up, 2 the same half a place later, 3 the value below.
    Ranks are a window over each raster; of one raster too large for a task use ``large_quantile``.
    """
    ranked = cells.filter(F.col(c).isNotNull()).select("raster_id", F.col(c).cast("double").alias("v"))
    w = Window.partitionBy("raster_id")
    ranked = ranked.withColumn("k", F.row_number().over(w.orderBy("v"))).withColumn("n", F.count(F.lit(1)).over(w))
    x = ranked.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    n, p = F.col("n").cast("double"), F.col("p")
    if kind in CONTINUOUS:
        a, b = CONTINUOUS[kind]
        at = F.greatest(F.lit(1.0), F.least(n, F.lit(a) + (n + F.lit(b)) * p))
        low = F.floor(at)
        x = x.withColumn("w", F.when(F.col("k") == low, 1 - (at - low)).when(F.col("k") == low + 1, at - low))
        return x.filter(F.col("w") > 0).groupBy("raster_id", "p").agg(F.sum(F.col("w") * F.col("v")).alias("q"))
    at = {1: n * p, 2: n * p + 0.5, 3: n * p}[kind]
    pick = F.greatest(F.lit(1.0), F.least(n, F.floor(at) if kind == 3 else F.ceil(at)))
    return x.filter(F.col("k") == pick).select("raster_id", "p", F.col("v").alias("q"))


def large_quantile(cells: DataFrame, c: str, p: float, kind: int | str = "m", most: int = 200_000) -> float | None:
    """One quantile of one very large raster, exactly and without a global sort.

    Approximate percentiles bracket the two order statistics; counts below the bracket and the values inside it,
    bracketed again while there are more than ``most`` distinct, give them.
    """
    v = cells.filter(F.col(c).isNotNull()).select(F.col(c).cast("double").alias("v"))
    n = v.count()
    if not n:
        return None
    a, b = CONTINUOUS[kind]
    at = min(float(n), max(1.0, a + (n + b) * p))
    low = int(at)
    wanted = {low: 1 - (at - low)} | ({low + 1: at - low} if low < n else {})
    total = 0.0
    for rank, weight in wanted.items():
        if weight:
            part, k = v, rank
            for _ in range(20):
                m = part.count()
                if part.select("v").distinct().limit(most + 1).count() <= most:
                    break
                lo, hi = part.agg(F.percentile_approx("v", F.array(F.lit(max(0.0, k / m - 0.001)), F.lit(min(1.0, k / m + 0.001))), 10000)).first()[0]
                k -= part.filter(F.col("v") < lo).count()
                part = part.filter((F.col("v") >= lo) & (F.col("v") <= hi))
            for value, count in sorted((r["v"], r["count"]) for r in part.groupBy("v").count().collect()):  # at most ``most`` rows
                k -= count
                if k <= 0:
                    total += weight * value
                    break
    return total


def histogram(values: DataFrame, c: str, bins: int) -> DataFrame:
    """raster_id, bin, low, high, count of equal-width bins; the last includes its upper edge, equal values widen by 1/2."""
    s = values.groupBy("raster_id").agg(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi"))
    s = s.select("raster_id", F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
                 F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    x = values.join(s, "raster_id").select("raster_id", F.least(F.lit(bins - 1), F.floor((F.col(c) - F.col("lo")) / width)).cast("int").alias("bin"))
    n = x.groupBy("raster_id", "bin").count()
    every = s.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(n, ["raster_id", "bin"], "left").select(
        "raster_id", "bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), F.coalesce("count", F.lit(0)).cast("long").alias("count"))


# Coefficients of Wichura's algorithm AS 241 (PPND16), numerators and denominators from the highest power down.
CENTRE = ((2.5090809287301226727e+3, 3.3430575583588128105e+4, 6.7265770927008700853e+4, 4.5921953931549871457e+4, 1.3731693765509461125e+4, 1.9715909503065514427e+3, 1.3314166789178437745e+2, 3.3871328727963666080e+0),
          (5.2264952788528545610e+3, 2.8729085735721942674e+4, 3.9307895800092710610e+4, 2.1213794301586595867e+4, 5.3941960214247511077e+3, 6.8718700749205790830e+2, 4.2313330701600911252e+1, 1.0))
MIDDLE = ((7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e+0, 3.64784832476320460504e+0, 5.76949722146069140550e+0, 4.63033784615654529590e+0, 1.42343711074968357734e+0),
          (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940e+0, 2.05319162663775882187e+0, 1.0))
FAR = ((2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580e+0, 5.46378491116411436990e+0, 6.65790464350110377720e+0),
       (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0))


def normal_quantile(p: Column) -> Column:
    """Inverse normal distribution of 0 < p < 1, by rational approximations."""
    def ratio(of: tuple, x: Column) -> Column:
        over, under = (reduce(lambda a, c: a * x + F.lit(c), part[1:], F.lit(part[0])) for part in of)
        return over / under

    q = p - F.lit(0.5)
    r = F.sqrt(-F.log(F.least(p, 1 - p)))
    tail = F.when(r <= 5, ratio(MIDDLE, r - F.lit(1.6))).otherwise(ratio(FAR, r - F.lit(5.0)))
    return F.when(F.abs(q) <= 0.425, ratio(CENTRE, F.lit(0.180625) - q * q) * q).when(q < 0, -tail).otherwise(tail)


def qq_points(cells: DataFrame, c: str) -> DataFrame:
    """raster_id, k, ordered, theoretical, slope, intercept: normal Q-Q points at Filliben's positions and their line."""
    w = Window.partitionBy("raster_id")
    x = cells.filter(F.col(c).isNotNull()).select("raster_id", F.col(c).cast("double").alias("ordered"))
    x = x.withColumn("k", F.row_number().over(w.orderBy("ordered"))).withColumn("n", F.count(F.lit(1)).over(w))
    half = F.pow(F.lit(0.5), F.lit(1.0) / F.col("n"))
    at = F.when(F.col("k") == F.col("n"), half).when(F.col("k") == 1, 1 - half).otherwise((F.col("k") - 0.3175) / (F.col("n") + 0.365))
    x = x.withColumn("theoretical", normal_quantile(at))
    line = x.groupBy("raster_id").agg(F.regr_slope("ordered", "theoretical").alias("slope"), F.regr_intercept("ordered", "theoretical").alias("intercept"))
    return x.drop("n").join(line, "raster_id")
