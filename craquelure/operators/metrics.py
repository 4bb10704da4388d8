"""Similarity of two aligned vectors: rows ``(keys, pos, ref, meas)``.

The vectors compared here are bin counts or band values, a bounded number per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from craquelure.operators.distributions import bin_index, cumulative

def _pair(r, m) -> tuple[Column, Column]:
    return F.col(r), F.col(m)


def pearson(ref: str = "ref", meas: str = "meas") -> Column:
    r, m = _pair(ref, meas)
    return F.corr(r.cast("double"), m.cast("double")) * 100


def mse(ref: str = "ref", meas: str = "meas") -> Column:
    r, m = _pair(ref, meas)
    return F.avg((r - m) * (r - m))


def lb_error(ref: str = "ref", meas: str = "meas") -> Column:
    r, m = _pair(ref, meas)
    return (1 - F.try_divide(mse(ref, meas), F.var_pop(r) + F.var_pop(m))) * 100


def mae(ref: str = "ref", meas: str = "meas") -> Column:
    r, m = _pair(ref, meas)
    return F.avg(F.abs(r - m))


def abs_error(ref: str = "ref", meas: str = "meas") -> Column:
    r, m = _pair(ref, meas)
    return F.sum(F.abs(r - m))


def nrmse(ref: str = "ref", meas: str = "meas") -> Column:
    r, m = _pair(ref, meas)
    return F.try_divide(F.sqrt(mse(ref, meas)), F.avg(r))


def determination(ref: str = "ref", meas: str = "meas") -> Column:
    r, m = _pair(ref, meas)
    return (1 - F.try_divide(mse(ref, meas), F.var_pop(r))) * 100


def smape(ref: str = "ref", meas: str = "meas") -> Column:
    """The half is applied to the quotient, not to the denominator."""
    r, m = _pair(ref, meas)
    return 100 * F.avg(F.try_divide(F.abs(r - m), F.abs(r) + F.abs(m)) / 2)


def mape(ref: str = "ref", meas: str = "meas") -> Column:
    r, m = _pair(ref, meas)
    return 100 * (1 - F.avg(F.abs(r - m) / F.when(r == 0, 1).otherwise(r)))


def jaccard(ref: str = "ref", meas: str = "meas") -> Column:
    r, m = _pair(ref, meas)
    return F.try_divide(F.sum(F.least(r, m)), F.sum(F.greatest(r, m))) * 100


def r_squared(df: DataFrame, keys, y: str = "ref", fit: str = "meas") -> DataFrame:
    """1 - SSres/SStot; the mean counts every row, the sums skip missing ones."""
    keys = list(keys)
    res = (F.col(y) - F.col(fit)) * (F.col(y) - F.col(fit))
    return df.groupBy(*keys).agg(
        (1 - F.try_divide(F.sum(res), F.var_pop(y) * F.count(y))).alias("r2")
    )


def spearman(df: DataFrame, keys, pos: str = "pos") -> DataFrame:
    """Ordinal ranks (ties by position) of the bounded vectors."""
    by = Window.partitionBy(*keys)
    rr = F.row_number().over(by.orderBy("ref", pos))
    rm = F.row_number().over(by.orderBy("meas", pos))
    d = df.withColumn("_d", (rr - rm).cast("double"))
    n = F.count(F.lit(1)).cast("double")
    return d.groupBy(*keys).agg(
        (100 * (1 - F.try_divide(6 * F.sum(F.col("_d") * F.col("_d")), n * (n * n - 1)))).alias("spearman")
    )


def ks(df: DataFrame, keys, value: str, sample: str) -> DataFrame:
    """Two-sample statistic and asymptotic p-value; ``sample`` is 0 or 1 per row.

    Only value counts are ordered, in stretches of the value range.
    """
    keys = list(keys)
    counts = df.groupBy(*keys, value).agg(
        F.count_if(F.col(sample) == 0).alias("_a"), F.count_if(F.col(sample) == 1).alias("_b")
    )
    totals = counts.groupBy(*keys).agg(F.sum("_a").alias("_na"), F.sum("_b").alias("_nb"))
    d = cumulative(counts, keys, value, {"_ca": F.col("_a"), "_cb": F.col("_b")}).join(totals, keys)
    # where one sample is empty there is no statistic
    gap = F.abs(F.try_divide("_ca", "_na") - F.try_divide("_cb", "_nb"))
    d = d.groupBy(*keys, "_na", "_nb").agg(F.max(gap).alias("d"))
    lam = F.sqrt(F.try_divide(F.col("_na") * F.col("_nb"), F.col("_na") + F.col("_nb"))) * F.col("d")
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * lam * lam),
    )
    p = F.when(lam < 0.2, F.lit(1.0)).when(lam.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)))
    return d.select(*keys, "d", p.alias("p"))


def stacked(df: DataFrame, keys, pos: str = "pos") -> DataFrame:
    """Both vectors below each other: ``sample`` 0 is the reference."""
    return df.select(*keys, pos, F.posexplode(F.array(F.col("ref").cast("double"), F.col("meas").cast("double"))).alias("sample", "value"))


def rebinned_ks(df: DataFrame, keys, edges, pos: str = "pos") -> DataFrame:
    """KS of the two vectors after binning *their values* with the given edges again."""
    keys = list(keys)
    lo, hi, bins = float(edges[0]), float(edges[-1]), len(edges) - 1
    d = stacked(df, keys, pos).withColumn("bin", bin_index(F.col("value"), F.lit(lo), F.lit(hi), bins))
    counts = d.groupBy(*keys, "sample", "bin").agg(F.count(F.lit(1)).alias("c"))
    every = df.select(*keys).distinct().withColumn("sample", F.explode(F.array(F.lit(0), F.lit(1))))
    every = every.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    filled = every.join(counts, [*keys, "sample", "bin"], "left").withColumn("c", F.coalesce("c", F.lit(0)).cast("double"))
    return ks(filled, keys, "c", "sample")


def count_similarity(df: DataFrame, keys, bins: int = 100, pos: str = "pos") -> DataFrame:
    """Re-bin each vector's values on its own range and compare the bin counts."""
    keys = list(keys)
    d = stacked(df, keys, pos)
    lim = d.groupBy(*keys, "sample").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    flat = F.col("_lo") == F.col("_hi")
    lim = lim.select(
        *keys,
        "sample",
        F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("lo"),
        F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("hi"),
    )
    d = d.join(lim, [*keys, "sample"]).withColumn("bin", bin_index(F.col("value"), F.col("lo"), F.col("hi"), bins))
    c = d.groupBy(*keys, "bin").agg(
        F.count_if(F.col("sample") == 0).alias("r"), F.count_if(F.col("sample") == 1).alias("m")
    )
    err = F.abs(F.col("r") - F.col("m")) / F.when(F.col("r") == 0, 1).otherwise(F.col("r"))
    return c.groupBy(*keys).agg((100 * (1 - F.sum(err) / bins)).alias("count_similarity"))


def similarity(df: DataFrame, keys, edges, pos: str = "pos") -> DataFrame:
    """The metric bundle: Pearson, Spearman, LB error, KS, count similarity, sum of errors."""
    keys = list(keys)
    sums = df.groupBy(*keys).agg(
        pearson().alias("pearson"), lb_error().alias("lb_error"), abs_error().alias("abs_error")
    )
    tests = rebinned_ks(df, keys, edges, pos).select(*keys, F.col("d").alias("ks_d"), (F.col("p") * 100).alias("ks"))
    return (
        sums.join(spearman(df, keys, pos), keys).join(tests, keys).join(count_similarity(df, keys, 100, pos), keys)
    )


def even_data(df: DataFrame, keys, n: int = 50, pos: str = "pos") -> DataFrame:
    """Both vectors read at ``n`` abscissae that run from their first to their last value."""
    keys = list(keys)
    vec = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col("ref").cast("double").alias("r"), F.col("meas").cast("double").alias("m"))))
    d = df.groupBy(*keys).agg(vec.alias("_v"))
    d = d.withColumn("_r", F.transform("_v", lambda s: s["r"])).withColumn("_m", F.transform("_v", lambda s: s["m"]))
    top = F.greatest(F.array_max("_r"), F.array_max("_m"))

    def read(col: str):
        size = F.size(col)
        first, last = F.get(col, F.lit(0)), F.get(col, size - 1)
        step = top / (size - 1)

        def at(k):
            x = first + k * ((last - first) / (n - 1))
            i = F.greatest(F.lit(0), F.least(F.floor(F.try_divide(x, step)).cast("int"), size - 2))
            a, b = F.get(col, i), F.get(col, i + 1)
            value = a + (b - a) * F.try_divide(x - i * step, step)
            return F.when(x <= 0, first).when(x >= top, last).otherwise(value)

        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)

    pairs = F.arrays_zip(read("_r").alias("ref"), read("_m").alias("meas"))
    return d.select(*keys, F.posexplode(pairs).alias("k", "p")).select(*keys, "k", F.col("p.ref").alias("ref"), F.col("p.meas").alias("meas"))
