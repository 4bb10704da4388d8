"""Curve-fit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from craquelure.functions import mechanics as M, tables as TB
from craquelure.operators import fits
from craquelure.plans.catalog import U, with_energy
from craquelure.plans.registry import query

DATA = f"d as (select specimen_id, p.thickness, abs(sig_h) as s, {U} as u, n50, peri from specimen p join (select specimen_id, count(*) filter (where x_mm between 375e0 and 425e0 and y_mm between 375e0 and 425e0) as n50, sum(circ) as peri from splinter group by 1) q using (specimen_id) where has_scalp and has_splinters)"


def data(t):
    from craquelure.operators.exclusions import in_box

    counts = t.splinter.groupBy("specimen_id").agg(
        F.count_if(in_box(375.0, 375.0, 425.0, 425.0)).cast("double").alias("n50"), F.sum("circ").alias("peri")
    )
    d = with_energy(t.specimen).filter("has_scalp and has_splinters")
    return d.select("specimen_id", "thickness", F.abs("sig_h").alias("s"), "u").join(counts, "specimen_id")


@query("r1_line", f"with {DATA} select thickness, round(regr_intercept(n50,s),6) as c0, round(regr_slope(n50,s),8) as c1, count(*) as n from d group by 1")
def r1(t):
    f = fits.polynomial(data(t), ["thickness"], "s", "n50", 1)
    return f.select("thickness", F.round(F.get("coef", F.lit(0)), 6).alias("c0"), F.round(F.get("coef", F.lit(1)), 8).alias("c1"), "n")


@query(
    "r1_parabola",
    f"""with {DATA}, c as (select *, s - avg(s) over (partition by thickness) as z, avg(s) over (partition by thickness) as mu from d),
q as (select thickness, any_value(mu) as mu, count(*) as n, sum(z*z) as s2, sum(z*z*z) as s3, sum(z*z*z*z) as s4, sum(n50) as sy, sum(z*n50) as szy, sum(z*z*n50) as szzy from c group by 1),
f as (select thickness, mu, n, (szzy-s3*szy/s2-s2*sy/n)/(s4-s3*s3/s2-s2*s2/n) as a, s2, s3, szy, sy from q) select thickness, round(a,8) as c2, round((szy-a*s3)/s2 - 2e0*a*mu,6) as c1 from f""",
)
def r1b(t):
    f = fits.polynomial(data(t), ["thickness"], "s", "n50", 2)
    return f.select("thickness", F.round(F.get("coef", F.lit(2)), 8).alias("c2"), F.round(F.get("coef", F.lit(1)), 6).alias("c1"))


@query("r1_quintic")
def r1c(t):
    f = fits.polynomial(data(t), ["thickness"], "s", "n50", 5)
    return f.select("thickness", "n", F.posexplode("coef").alias("power", "coefficient"))


@query(
    "r1_quintic_moments",
    f"with {DATA} select thickness, k, round(sum(pow(s/100e0,k)*n50),3) as moment from d cross join (select unnest(range(0,6)) as k) group by 1,2",
)
def r1d(t):
    """Moments of the fitted quintic: least squares has those of the points, and no other curve of its degree has."""
    d = data(t)
    f = fits.polynomial(d, ["thickness"], "s", "n50", 5).select("thickness", "coef")
    d = d.join(f, "thickness").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(5))))
    moment = F.sum(F.pow(F.col("s") / 100.0, F.col("k").cast("double")) * fits.evaluate("coef", F.col("s")))
    return d.groupBy("thickness", "k").agg(F.round(moment, 3).alias("moment"))


@query(
    "r2_logarithm_and_proportion",
    f"with {DATA} select thickness, round(regr_slope(n50,ln(s)),6) as a_log, round(regr_intercept(n50,ln(s)),5) as b_log, round(sum(s*s)/sum(s*n50),6) as a_inv from d group by 1",
)
def r2(t):
    d = data(t)
    log = fits.logarithmic(d, ["thickness"], "s", "n50")
    inv = fits.inverse_proportional(d, ["thickness"], "s", "n50")
    return log.join(inv.withColumnRenamed("a", "a_inv"), "thickness").select(
        "thickness", F.round("a", 6).alias("a_log"), F.round("b", 5).alias("b_log"), F.round("a_inv", 6).alias("a_inv")
    )


@query(
    "r3_model_moments",
    f"with {DATA} select round(sum(thickness*s),3) as ts, round(sum(s*s),3) as ss, round(sum(s*s*s)/1e6,6) as sss, round(sum(n50*s),3) as ns, round(sum(n50*thickness),3) as nt, count(*) as n from d",
)
def r3(t):
    s, th, n = F.col("s"), F.col("thickness"), F.col("n50")
    return data(t).agg(
        F.round(F.sum(th * s), 3).alias("ts"),
        F.round(F.sum(s * s), 3).alias("ss"),
        F.round(F.sum(s * s * s) / 1e6, 6).alias("sss"),
        F.round(F.sum(n * s), 3).alias("ns"),
        F.round(F.sum(n * th), 3).alias("nt"),
        F.count(F.lit(1)).alias("n"),
    )


@query("r3_n50_model")
def r3b(t):
    d = data(t).withColumn("k", F.lit(1))
    short = fits.linear(d, ["k"], fits.n50_terms(F.col("thickness"), F.col("s")), F.col("n50"))
    return short.select("n", F.posexplode("coef").alias("term", "coefficient"))


SEEL = ", ".join(f"({t},{s}e0,{n}e0)" for t, s, n in TB.COUNTS_AND_STRESSES)
BOTH = f"{DATA}, b as (select thickness as h, s, cast(n50 as double) as n50 from d union all select h, s, n50 from (values {SEEL}) as l(h, s, n50))"


def with_literature(t):
    """Own counts and the published ones, as a fit takes them."""
    own = data(t).select(F.col("thickness").cast("int").alias("thickness"), "s", "n50")
    return own.unionByName(TB.literature_stresses(t.spark))


@query(
    "u1_counts_with_literature",
    f"with {BOTH} select h as thickness, count(*) as n, round(avg(s),6) as s, round(avg(n50),6) as n50 from b group by 1",
)
def u1b(t):
    d = with_literature(t).groupBy("thickness")
    return d.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("s"), 6).alias("s"), F.round(F.avg("n50"), 6).alias("n50"))


TERMS = ("1e0", "h", "s", "s*s", "s*s*s", "s*h", "h*h", "h*h*h")


def model_sql(n: int) -> str:
    rows = " union all ".join(f"select {k} as term, avg(({e})*n50) as m, avg(({e})*({e})) as q from b" for k, e in enumerate(TERMS[:n]))
    return f"with {BOTH} select term, round(m/sqrt(q),6) as moment from ({rows})"


def model_moments(t, long: bool):
    """Moments of the fitted N50 model with every term: least squares has those of the points."""
    d = with_literature(t).withColumn("k", F.lit(1))
    terms = fits.n50_terms(F.col("thickness"), F.col("s"), long)
    d = d.join(fits.linear(d, ["k"], terms, F.col("n50")).select("k", "coef"), "k")
    fitted = fits.predict("coef", terms)
    moments = [F.round(F.avg(e * fitted) / F.sqrt(F.avg(e * e)), 6) for e in terms]
    return d.agg(F.array(*moments).alias("m")).select(F.posexplode("m").alias("term", "moment"))


@query("r3_model_with_literature", model_sql(6))
def r3c(t):
    return model_moments(t, False)


@query("r3_long_model_with_literature", model_sql(8))
def r3d(t):
    return model_moments(t, True)


@query("r4_nonlinear_models")
def r4(t):
    """All four nonlinear models on the same points; each step is one aggregation."""
    d = data(t)
    starts = {
        "exponential": [3.0, 0.01],
        "logarithmic": [1.0, 1.0, 1.0, 1.0],
        "hyperbolic": [5.0, 10.0, 50.0],
        "fourth_power": [0.5, 0.01],
    }
    bounds = {"hyperbolic": [(-1e6, 1e6), (-1e6, 1e6), (1e-3, 1e6)], "logarithmic": [(-1e6, 1e6), (1e-6, 1e6), (1e-6, 1e6), (-1e6, 1e6)]}
    out = None
    for name, start in starts.items():
        c = fits.fitted_curve(d, name, "s", "n50", start, bounds.get(name), points=1)
        c = c.select(F.lit(name).alias("model"), "r2", "params")
        out = c if out is None else out.unionByName(c)
    return out.select("model", "r2", F.posexplode("params").alias("k", "parameter"))


@query("r5_fit_and_curve")
def r5(t):
    return fits.fitted_curve(data(t), "exponential", "s", "n50", [3.0, 0.01]).select("k", "x", "y", "r2")


# the exponent by thirds of its interval; the factor follows from it
EXPONENT = f"""{DATA}, v as (select thickness, list(s) as xs, list(cast(n50 as double)) as ys, count(*) as n, avg(n50) as mean from d group by 1),
r as (select *, -0.2e0 as lo, 0.2e0 as hi, 0 as i from v union all select thickness, xs, ys, n, mean, case when a > b then lo+(hi-lo)/3 else lo end, case when a > b then hi else hi-(hi-lo)/3 end, i+1 from (
 select *, list_sum([ys[j]*ys[j] for j in range(1,n+1)]) - pow(list_sum([ys[j]*exp((lo+(hi-lo)/3)*xs[j]) for j in range(1,n+1)]),2)/list_sum([exp(2*(lo+(hi-lo)/3)*xs[j]) for j in range(1,n+1)]) as a,
  list_sum([ys[j]*ys[j] for j in range(1,n+1)]) - pow(list_sum([ys[j]*exp((hi-(hi-lo)/3)*xs[j]) for j in range(1,n+1)]),2)/list_sum([exp(2*(hi-(hi-lo)/3)*xs[j]) for j in range(1,n+1)]) as b from r where i < 110)),
e as (select thickness, xs, ys, n, mean, (lo+hi)/2 as p1, list_sum([ys[j]*exp((lo+hi)/2*xs[j]) for j in range(1,n+1)])/list_sum([exp((lo+hi)*xs[j]) for j in range(1,n+1)]) as p0 from r where i = 110)"""


def per_thickness(t, **models):
    return fits.nonlinear_groups(data(t), ["thickness"], models, "s", "n50")


@query(
    "r4_exponential_per_thickness",
    f"""with recursive {EXPONENT} select thickness, n, round(p0,4) as a, round(p1,6) as b, round(1-list_sum([pow(ys[j]-p0*exp(p1*xs[j]),2) for j in range(1,n+1)])/list_sum([pow(y-mean,2) for y in ys]),6) as r2 from e""",
)
def r4b(t):
    """One fit for every thickness, all of them at once."""
    d = per_thickness(t, exponential=[3.0, 0.01])
    p = [F.get("params", F.lit(k)) for k in range(2)]
    return d.select("thickness", "n", F.round(p[0], 4).alias("a"), F.round(p[1], 6).alias("b"), F.round("r2", 6).alias("r2"))


@query(
    "r5_curve_per_thickness",
    f"""with recursive {EXPONENT}, x as (select thickness, p0, p1, list_min(xs) as lo, list_max(xs) as hi, unnest(range(0,100)) as k from e)
select thickness, k, round(lo+k*((hi-lo)/99e0),6) as x, round(p0*exp(p1*(lo+k*((hi-lo)/99e0))),3) as y from x""",
)
def r5b(t):
    spans = data(t).groupBy("thickness").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    d = fits.curves(per_thickness(t, exponential=[3.0, 0.01]), spans, ["thickness"])
    return d.select("thickness", "k", F.round("x", 6).alias("x"), F.round("y", 3).alias("y"))


@query(
    "r6_lines_per_thickness",
    f"with {DATA} select thickness, round(regr_slope(peri,u),6) as slope, round(regr_intercept(peri,u),4) as intercept, round(regr_r2(peri,u),8) as r2, round(1e0/regr_slope(peri,u),6) as inverse_slope from d group by 1",
)
def r6(t):
    d = fits.lines(data(t), ["thickness"], "u", "peri")
    return d.select(
        "thickness", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 8).alias("r2"), F.round("inverse_slope", 6).alias("inverse_slope")
    )


@query(
    "r7_predicted_vs_measured",
    f"""with {DATA}, f as (select thickness as th, regr_slope(n50,s) as a, regr_intercept(n50,s) as b from d group by 1)
select specimen_id, cast(n50 as double) as n50, round(1281e0 + thickness*18.98e0 + s*(-37.29e0) + s*s*s*(-0.0009638e0) + s*s*0.3504e0 + s*thickness*(-0.2149e0),4) as published, round(a*s+b,5) as fitted from d join f on th = thickness order by 2,1""",
)
def r7(t):
    d = data(t)
    f = fits.polynomial(d, ["thickness"], "s", "n50", 1).select("thickness", "coef")
    s = F.col("s")
    return (
        d.join(f, "thickness")
        .select(
            "specimen_id",
            "n50",
            F.round(M.n50_regression(F.col("thickness"), s), 4).alias("published"),
            F.round(fits.evaluate("coef", s), 5).alias("fitted"),
        )
        .orderBy("n50", "specimen_id")
    )
