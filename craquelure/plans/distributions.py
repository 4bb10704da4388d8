"""Distribution queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from craquelure.functions import mechanics as M
from craquelure.operators import distributions as D
from craquelure.operators.exclusions import distance
from craquelure.plans.fragments import DIST
from craquelure.plans.registry import query

LIM = "lim as (select specimen_id, min(log10(area)) as lo, max(log10(area)) as hi from splinter where area > 0 group by 1)"


def hist_sql(bins: int, value: str, source: str = "splinter") -> str:
    return f"""c as (select s.specimen_id, case when {value} = hi then {bins - 1} else cast(floor(({value}-lo)/((hi-lo)/{bins}e0)) as int) end as bin, count(*) as n
 from {source} s join lim using (specimen_id) where {value} between lo and hi group by 1,2),
h as (select l.specimen_id, b.bin, coalesce(n,0) as n, lo, hi, coalesce(n,0)/(sum(coalesce(n,0)) over (partition by l.specimen_id)*((hi-lo)/{bins}e0)) as density
 from lim l cross join (select unnest(range(0,{bins})) as bin) b left join c on c.specimen_id = l.specimen_id and c.bin = b.bin)"""


def logged(t):
    return t.splinter.filter("area > 0").select("specimen_id", "source", "area", F.log10("area").alias("v"))


def log_hist(t, bins, value="v"):
    d = logged(t)
    return D.histogram(d, ["specimen_id"], value, D.limits(d, ["specimen_id"], "v"), bins)


@query(
    "h1_log_edges",
    f"with {LIM} select specimen_id, k, round(lo + k*((hi-lo)/29e0),6) as edge from lim cross join (select unnest(range(0,30)) as k)",
)
def h1(t):
    lim = D.limits(logged(t), ["specimen_id"], "v").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(29))))
    return lim.select("specimen_id", "k", F.round(D.edge(F.col("k"), F.col("lo"), F.col("hi"), 29), 6).alias("edge"))


@query("h2_pdf_log", f"with {LIM}, {hist_sql(29, 'log10(area)')} select specimen_id, bin, n, round(density,6) as density from h")
def h2(t):
    return log_hist(t, 29).select("specimen_id", "bin", "n", F.round("density", 6).alias("density"))


@query("h2_pdf_raw_on_log_edges", f"with {LIM}, {hist_sql(29, 'area')} select specimen_id, bin, n, round(density,6) as density from h")
def h2raw(t):
    """The pane method bins raw areas with logarithmic edges."""
    return log_hist(t, 29, "area").select("specimen_id", "bin", "n", F.round("density", 6).alias("density"))


@query(
    "h3_cdf",
    f"with {LIM}, {hist_sql(89, 'log10(area)')} select specimen_id, bin, round(sum(n) over (partition by specimen_id order by bin)/(sum(n) over (partition by specimen_id)),8) as cdf from h",
)
def h3(t):
    return D.cdf(log_hist(t, 89), ["specimen_id"]).select("specimen_id", "bin", F.round("cdf", 8).alias("cdf"))


@query(
    "h4_share_curve",
    """with c as (select specimen_id, area, count(*) as n from splinter group by 1,2)
select specimen_id, area, n, round(sum(area*n) over (partition by specimen_id order by area)/sum(area*n) over (partition by specimen_id),8) as share from c""",
)
def h4(t):
    return D.share_curve(t.splinter, ["specimen_id"], "area").select("specimen_id", "area", "n", F.round("share", 8).alias("share"))


@query(
    "h5_size_distribution",
    """with l as (select specimen_id, min(area) as lo, max(area) as hi, count(*) as total from splinter group by 1), th as (select l.*, k as step, lo + k*((hi-lo)/49e0) as t from l cross join (select unnest(range(0,50)) as k)),
c as (select th.specimen_id, th.step, any_value(t) as t, any_value(total) as total, count(*) filter (where area <= t) as n from th join splinter s on s.specimen_id = th.specimen_id group by 1,2)
select specimen_id, step, round(t,6) as threshold, case when n < total then n end as "index" from c""",
)
def h5(t):
    d = D.size_distribution(t.splinter.select("specimen_id", "area"), ["specimen_id"], "area")
    return d.select("specimen_id", "step", F.round("threshold", 6).alias("threshold"), "index")


def kde_sql(points: int) -> str:
    return f"""st as (select specimen_id, count(*) as n, min(area) as lo, max(area) as hi, stddev_samp(area)*pow(cast(count(*) as double),-0.2e0) as bw from splinter group by 1),
vc as (select specimen_id, area, count(*) as c from splinter group by 1,2),
p as (select st.*, k, lo + k*((hi-lo)/{points - 1}e0) as x from st cross join (select unnest(range(0,{points})) as k)),
d as (select p.specimen_id, k, any_value(x) as x, sum(c*exp(-0.5e0*((x-area)/bw)*((x-area)/bw))/(n*bw*sqrt(2e0*pi()))) as density from p join vc using (specimen_id) group by 1,2)"""


@query("h6_kde", f"with {kde_sql(50)} select specimen_id, k, round(x,6) as x, round(density,8) as density from d")
def h6(t):
    d = D.kde(t.splinter.select("specimen_id", "area"), ["specimen_id"], "area", 50)
    return d.select("specimen_id", "k", F.round("x", 6).alias("x"), F.round("density", 8).alias("density"))


@query(
    "h7_mode",
    f"with {kde_sql(1000)} select specimen_id, round(arg_max(x, density),6) as mode, round(max(density)/sum(density),8) as probability from d group by 1",
)
def h7(t):
    d = D.mode(t.splinter.select("specimen_id", "area"), ["specimen_id"], "area", 1000)
    return d.select("specimen_id", F.round("mode", 6).alias("mode"), F.round("probability", 8).alias("probability"))


@query(
    "h8_histogram_matrix",
    """with lim as (select specimen_id, 0e0 as lo, 2e0 as hi from (select distinct specimen_id from splinter) q), """
    + hist_sql(29, "log10(area)")
    + """ select h.specimen_id, bin, round(1e6/5e0*(1e0-0.23e0)/70e3*sig_h*sig_h*measured_thickness*1e-3,5) as u, round(density/max(density) over (partition by h.specimen_id),6) as value from h join specimen using (specimen_id)""",
)
def h8(t):
    d = logged(t).select("specimen_id", "v")
    edges = d.select("specimen_id").distinct().select("specimen_id", F.lit(0.0).alias("lo"), F.lit(2.0).alias("hi"))
    h = D.histogram(d, ["specimen_id"], "v", edges, 29)
    top = h.groupBy("specimen_id").agg(F.max("density").alias("top"))
    u = M.energy(F.col("sig_h"), F.col("measured_thickness"))
    h = h.join(top, "specimen_id").join(t.specimen.select("specimen_id", u.alias("u")), "specimen_id")
    return h.select(
        "specimen_id", "bin", F.round("u", 5).alias("u"), F.round(F.col("density") / F.col("top"), 6).alias("value")
    ).orderBy(F.desc("u"), "specimen_id", "bin")


SPLIT_LIM = "lim as (select specimen_id, min(log10(area)) as lo, max(log10(area)) as hi from splinter where source='real' group by 1)"


def split_sql(bins: int) -> str:
    return f"""c as (select s.specimen_id, case when log10(area) = hi then {bins - 1} else cast(floor((log10(area)-lo)/((hi-lo)/{bins}e0)) as int) end as bin, count(*) filter (where source='real') as r, count(*) filter (where source='sim') as m
 from splinter s join lim using (specimen_id) where log10(area) between lo and hi group by 1,2),
h as (select l.specimen_id, b.bin, coalesce(r,0) as r, coalesce(m,0) as m, (hi-lo)/{bins}e0 as w from lim l cross join (select unnest(range(0,{bins})) as bin) b left join c on c.specimen_id = l.specimen_id and c.bin = b.bin),
q as (select *, r/(sum(r) over k*w) as dr, m/(sum(m) over k*w) as dm from h window k as (partition by specimen_id))"""


def split_hist(t, bins):
    d = logged(t)
    edges = D.limits(d.filter("source = 'real'"), ["specimen_id"], "v")
    return D.histogram(d, ["specimen_id"], "v", edges, bins, "source", ["real", "sim"])


@query("h9_histogram_difference", f"with {SPLIT_LIM}, {split_sql(29)} select specimen_id, bin, round(abs(dr-dm),6) as diff from q")
def h9(t):
    h = split_hist(t, 29)
    return h.select("specimen_id", "bin", F.round(F.abs(F.col("density_real") - F.col("density_sim")), 6).alias("diff"))


@query(
    "h10_repeat_mae",
    f"""with {SPLIT_LIM}, rep as (select specimen_id, log10(area) as v, case when source='real' then -1 else l_partkey % 3 end as run from splinter),
c as (select s.specimen_id, run, case when v = hi then 28 else cast(floor((v-lo)/((hi-lo)/29e0)) as int) end as bin, count(*) as n from rep s join lim using (specimen_id) where v between lo and hi group by all),
f as (select r.specimen_id, r.run, b.bin, coalesce(n,0)/(sum(coalesce(n,0)) over (partition by r.specimen_id, r.run)*((hi-lo)/29e0)) as d from (select distinct specimen_id, run from rep) r join lim using (specimen_id)
 cross join (select unnest(range(0,29)) as bin) b left join c on c.specimen_id=r.specimen_id and c.run=r.run and c.bin=b.bin),
m as (select specimen_id, bin, avg(d) filter (where run >= 0) as sim, avg(d) filter (where run < 0) as ref from f group by 1,2)
select specimen_id, round(avg(abs(ref-sim)),6) as mae from m group by 1""",
)
def h10(t):
    run = F.when(F.col("source") == "real", F.lit(-1)).otherwise(F.col("l_partkey") % 3).cast("int")
    d = t.splinter.select("specimen_id", run.alias("run"), F.log10("area").alias("v"))
    keys = ["specimen_id", "run"]
    edges = D.limits(d.filter("run < 0"), ["specimen_id"], "v").join(d.select(*keys).distinct(), "specimen_id")
    h = D.histogram(d, keys, "v", edges, 29)
    m = h.groupBy("specimen_id", "bin").agg(
        F.avg(F.when(F.col("run") >= 0, F.col("density"))).alias("sim"), F.avg(F.when(F.col("run") < 0, F.col("density"))).alias("ref")
    )
    return m.groupBy("specimen_id").agg(F.round(F.avg(F.abs(F.col("ref") - F.col("sim"))), 6).alias("mae"))


@query(
    "h10_mean_of_modes",
    """with s as (select *, l_partkey % 3 as run from splinter where source = 'sim'), st as (select specimen_id, run, count(*) as n, min(area) as lo, max(area) as hi, stddev_samp(area)*pow(cast(count(*) as double),-0.2e0) as bw from s group by 1,2),
vc as (select specimen_id, run, area, count(*) as c from s group by 1,2,3), p as (select st.*, k, lo + k*((hi-lo)/199e0) as x from st cross join (select unnest(range(0,200)) as k)),
d as (select p.specimen_id, run, k, any_value(x) as x, sum(c*exp(-0.5e0*((x-area)/bw)*((x-area)/bw))/(n*bw*sqrt(2e0*pi()))) as density from p join vc using (specimen_id, run) group by 1,2,3),
m as (select specimen_id, run, arg_max(x, density) as mode from d group by 1,2) select specimen_id, round(avg(mode),6) as mean_mode, count(*) as runs from m group by 1""",
)
def h10b(t):
    d = t.splinter.filter("source = 'sim'").select("specimen_id", (F.col("l_partkey") % 3).alias("run"), "area")
    modes = D.mode(d, ["specimen_id", "run"], "area", 200)
    return modes.groupBy("specimen_id").agg(F.round(F.avg("mode"), 6).alias("mean_mode"), F.count(F.lit(1)).alias("runs"))


@query(
    "h11_mean_sizes",
    "select name, specimen_id, round(max(sig_h),6) as sig_h, round(avg(area),6) as mean_size from splinter join specimen using (specimen_id) group by 1,2",
)
def h11(t):
    sizes = t.splinter.groupBy("specimen_id").agg(F.avg("area").alias("m"))
    return sizes.join(t.specimen, "specimen_id").select(
        "name", "specimen_id", F.round("sig_h", 6).alias("sig_h"), F.round("m", 6).alias("mean_size")
    )


EDGES = [20.0 + 20.0 * k for k in range(30)]
EDGE_SQL = "(select k as bin, 20e0+20e0*k as lo, case when k = 29 then 1e300 else 40e0+20e0*k end as hi from (select unnest(range(0,30)) as k))"
W1_SQL = f"""with r as (select specimen_id, {DIST} as r, area from kept),
b as (select specimen_id, bin, count(*) as n, avg(area) as area, stddev_pop(area) as area_std from r join {EDGE_SQL} e on r.r >= e.lo and r.r < e.hi group by 1,2)
select s.specimen_id, e.bin, e.lo as edge, coalesce(n,0) as n, round(area,6) as area, round(area_std,5) as area_std from (select distinct specimen_id from r) s cross join {EDGE_SQL} e left join b using (specimen_id, bin)"""


@query("w1_moving_average", W1_SQL)
def w1(t):
    d = t.kept.select("specimen_id", distance("ip_x", "ip_y").alias("r"), "area")
    d = D.moving_average(d, ["specimen_id"], "r", ["area"], EDGES)
    return d.select("specimen_id", "bin", "edge", "n", F.round("area", 6).alias("area"), F.round("area_std", 5).alias("area_std"))
