"""Comparison metrics between measured and simulated patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from craquelure.operators import cells, kernels, metrics as S
from craquelure.plans.distributions import SPLIT_LIM, split_hist, split_sql
from craquelure.plans.fragments import BAND, BANDS
from craquelure.plans.registry import query

K = ["specimen_id"]
Q = f"with {SPLIT_LIM}, {split_sql(29)}, v as (select specimen_id, bin as pos, r as ref, m as meas from q)"


def vectors(t):
    return split_hist(t, 29).selectExpr("specimen_id", "bin as pos", "n_real as ref", "n_sim as meas")


def simple(name, sql, column, digits=5):
    @query(name, f"{Q} select specimen_id, round({sql},{digits}) as value from v group by 1")
    def run(t):
        return vectors(t).groupBy("specimen_id").agg(F.round(column(), digits).alias("value"))

    return run


simple("c1_pearson", "100e0*(count(*)*sum(ref*meas)-sum(ref)*sum(meas))/sqrt(cast((count(*)*sum(ref*ref)-sum(ref)*sum(ref)) as double)*cast((count(*)*sum(meas*meas)-sum(meas)*sum(meas)) as double))", S.pearson)
simple("c3_lb_error", "(1e0-avg((ref-meas)*(ref-meas))/(var_pop(ref)+var_pop(meas)))*100e0", S.lb_error)
simple("c5_nrmse", "sqrt(avg((ref-meas)*(ref-meas)))/avg(ref)", S.nrmse)
simple("c6_determination", "(1e0-avg((ref-meas)*(ref-meas))/var_pop(ref))*100e0", S.determination)
simple("c7_smape", "100e0*avg(abs(ref-meas)/nullif(abs(ref)+abs(meas),0)/2e0)", S.smape)
simple("c8_mape", "100e0*(1e0-avg(abs(ref-meas)/cast(case when ref=0 then 1 else ref end as double)))", S.mape)
simple("c9_jaccard", "sum(least(ref,meas))/cast(sum(greatest(ref,meas)) as double)*100e0", S.jaccard)


@query(
    "c4_errors",
    f"{Q} select specimen_id, round(avg((ref-meas)*(ref-meas)),6) as mse, round(avg(abs(ref-meas)),6) as mae, sum(abs(ref-meas)) as abs_error from v group by 1",
)
def c4(t):
    return vectors(t).groupBy("specimen_id").agg(
        F.round(S.mse(), 6).alias("mse"), F.round(S.mae(), 6).alias("mae"), S.abs_error().alias("abs_error")
    )


SPEARMAN = """rk as (select specimen_id, row_number() over (partition by specimen_id order by ref, pos) - row_number() over (partition by specimen_id order by meas, pos) as d from v),
sp as (select specimen_id, 100e0*(1e0-6e0*sum(d*d)/(count(*)*(count(*)*count(*)-1e0))) as spearman from rk group by 1)"""


@query("c2_spearman", f"{Q}, {SPEARMAN} select specimen_id, round(spearman,5) as value from sp")
def c2(t):
    return S.spearman(vectors(t), K).select("specimen_id", F.round("spearman", 5).alias("value"))


KS = """x as (select specimen_id, area as v, case when source='real' then 0 else 1 end as s from splinter), t as (select specimen_id, count(*) filter (where s=0) as na, count(*) filter (where s=1) as nb from x group by 1),
c as (select specimen_id, v, count(*) filter (where s=0) as a, count(*) filter (where s=1) as b from x group by 1,2),
f as (select specimen_id, abs(sum(a) over w/cast(na as double) - sum(b) over w/cast(nb as double)) as gap, na, nb from c join t using (specimen_id) window w as (partition by specimen_id order by v))"""


@query("c10_ks", f"with {KS} select specimen_id, round(max(gap),8) as d from f group by 1")
def c10(t):
    d = t.splinter.select("specimen_id", "area", F.when(F.col("source") == "real", 0).otherwise(1).alias("sample"))
    return S.ks(d, K, "area", "sample").select("specimen_id", F.round("d", 8).alias("d"))


P_SQL = """case when {lam} < 0.2e0 then 1e0 else least(1e0, greatest(0e0, list_sum(list_transform(range(1,101), lambda k: (case when k % 2 = 1 then 2e0 else -2e0 end)*exp(-2e0*k*k*{lam}*{lam}))))) end"""


@query(
    "c10_ks_p_value",
    f"""with {KS}, g as (select specimen_id, max(gap) as d, sqrt(cast(any_value(na*nb) as double)/any_value(na+nb))*max(gap) as lam from f group by 1)
select specimen_id, round(d,8) as d, round({P_SQL.format(lam='lam')},8) as p from g""",
)
def c10p(t):
    d = t.splinter.select("specimen_id", "area", F.when(F.col("source") == "real", 0).otherwise(1).alias("sample"))
    return S.ks(d, K, "area", "sample").select("specimen_id", F.round("d", 8).alias("d"), F.round("p", 8).alias("p"))


COUNT = """u as (select specimen_id, pos, 0 as s, cast(ref as double) as val from v union all select specimen_id, pos, 1, cast(meas as double) from v),
ul as (select specimen_id, s, case when min(val)=max(val) then min(val)-0.5e0 else min(val) end as lo, case when min(val)=max(val) then max(val)+0.5e0 else max(val) end as hi from u group by 1,2),
ub as (select u.specimen_id, u.s, case when val=hi then 99 else cast(floor((val-lo)/((hi-lo)/100e0)) as int) end as bin from u join ul using (specimen_id, s)),
uc as (select specimen_id, bin, count(*) filter (where s=0) as r, count(*) filter (where s=1) as m from ub group by 1,2),
cs as (select specimen_id, 100e0*(1e0-sum(abs(r-m)/cast(case when r=0 then 1 else r end as double))/100e0) as count_similarity from uc group by 1)"""


@query("c11_count_similarity", f"{Q}, {COUNT} select specimen_id, round(count_similarity,6) as value from cs")
def c11(t):
    return S.count_similarity(vectors(t), K).select("specimen_id", F.round("count_similarity", 6).alias("value"))


RE_EDGES = [2.0 * k for k in range(21)]
REKS = """kb as (select g.specimen_id, g.s, g.bin, coalesce(n,0) as c from (select distinct specimen_id, s, bin from (select distinct specimen_id from v) a cross join (values (0),(1)) q(s) cross join (select unnest(range(0,20)) as bin) b) g
 left join (select specimen_id, s, case when val=40e0 then 19 else cast(floor(val/2e0) as int) end as bin, count(*) as n from u where val between 0e0 and 40e0 group by 1,2,3) h on h.specimen_id=g.specimen_id and h.s=g.s and h.bin=g.bin),
kc as (select specimen_id, c, count(*) filter (where s=0) as a, count(*) filter (where s=1) as b from kb group by 1,2),
kd as (select specimen_id, max(gap) as ks_d from (select specimen_id, abs(sum(a) over w/20e0 - sum(b) over w/20e0) as gap from kc window w as (partition by specimen_id order by c)) group by 1)"""


@query(
    "c12_similarity_bundle",
    f"""{Q}, {SPEARMAN}, {COUNT}, {REKS}, b as (select specimen_id, 100e0*corr(ref,meas) as pearson, (1e0-avg((ref-meas)*(ref-meas))/(var_pop(ref)+var_pop(meas)))*100e0 as lb_error, sum(abs(ref-meas)) as abs_error from v group by 1)
select specimen_id, round(pearson,4) as pearson, round(spearman,4) as spearman, round(lb_error,4) as lb_error, round(ks_d,6) as ks_d, round(count_similarity,5) as count_similarity, abs_error from b join sp using (specimen_id) join kd using (specimen_id) join cs using (specimen_id)""",
)
def c12(t):
    # the vectors feed four aggregations: read them once
    d = S.similarity(vectors(t), K, RE_EDGES)
    return d.select(
        "specimen_id",
        *[F.round(c, 4).alias(c) for c in ("pearson", "spearman", "lb_error")],
        F.round("ks_d", 6).alias("ks_d"),
        F.round("count_similarity", 5).alias("count_similarity"),
        "abs_error",
    )


def interp_sql(col):
    return f"""case when x_{col} <= 0 then {col}0 when x_{col} >= top then {col}1 else a_{col}.{col} + (b_{col}.{col}-a_{col}.{col})*((x_{col} - i_{col}*(top/28e0))/(top/28e0)) end"""


C13 = f"""{Q}, e as (select specimen_id, greatest(max(ref),max(meas))*1e0 as top, arg_min(ref,pos)*1e0 as ref0, arg_max(ref,pos)*1e0 as ref1, arg_min(meas,pos)*1e0 as meas0, arg_max(meas,pos)*1e0 as meas1 from v group by 1),
x as (select e.*, k, ref0+k*((ref1-ref0)/49e0) as x_ref, meas0+k*((meas1-meas0)/49e0) as x_meas from e cross join (select unnest(range(0,50)) as k)),
i as (select *, greatest(0,least(cast(floor(x_ref/(top/28e0)) as int),27)) as i_ref, greatest(0,least(cast(floor(x_meas/(top/28e0)) as int),27)) as i_meas from x),
z as (select i.specimen_id, k, {interp_sql('ref')} as ref, {interp_sql('meas')} as meas from i
 join v a_ref on a_ref.specimen_id=i.specimen_id and a_ref.pos=i_ref join v b_ref on b_ref.specimen_id=i.specimen_id and b_ref.pos=i_ref+1
 join v a_meas on a_meas.specimen_id=i.specimen_id and a_meas.pos=i_meas join v b_meas on b_meas.specimen_id=i.specimen_id and b_meas.pos=i_meas+1)"""


@query("c13_even_data_mse", f"{C13} select specimen_id, round(avg((ref-meas)*(ref-meas)),5) as mse from z group by 1")
def c13(t):
    d = S.even_data(vectors(t), K)
    return d.groupBy("specimen_id").agg(F.round(S.mse(), 5).alias("mse"))


@query(
    "c14_r_squared",
    f"{Q} select v.specimen_id, round(1e0-sum((ref-meas)*(ref-meas))/sum((ref-mu)*(ref-mu)),5) as r2 from v join (select specimen_id, avg(ref) as mu from v group by 1) a using (specimen_id) group by 1",
)
def c14(t):
    return S.r_squared(vectors(t), K).select("specimen_id", F.round("r2", 5).alias("r2"))


@query(
    "c15_parameter_sweep",
    """with p as (select k, k*3e0 as lowest from (select unnest(range(0,8)) as k)), lim as (select 1e0 as lo, 51e0 as hi),
c as (select specimen_id, k, case when area=51e0 then 9 else cast(floor((area-1e0)/5e0) as int) end as bin, count(*) filter (where source='sim') as r, count(*) filter (where source='real' and area >= lowest) as m from splinter cross join p where area between 1e0 and 51e0 group by 1,2,3),
e as (select specimen_id, k, sum(abs(r-m)) as err from c group by 1,2) select specimen_id, arg_min(k, err*100+k) as best, min(err) as err from e group by 1""",
)
def c15(t):
    """Each parameter row re-reads the areas; the best row has the smallest summed error."""
    from craquelure.operators.distributions import bin_index

    d = t.splinter.select(
        "specimen_id", "source", "area", bin_index(F.col("area"), F.lit(1.0), F.lit(51.0), 10).alias("bin")
    ).filter("bin is not null")
    d = d.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7))))
    c = d.groupBy("specimen_id", "k", "bin").agg(
        F.count_if(F.col("source") == "sim").alias("ref"),
        F.count_if((F.col("source") == "real") & (F.col("area") >= F.col("k") * 3.0)).alias("meas"),
    )
    e = c.groupBy("specimen_id", "k").agg(S.abs_error().alias("err"))
    return e.groupBy("specimen_id").agg(F.min_by("k", F.struct("err", "k")).alias("best"), F.min("err").alias("err"))


@query(
    "c16_polar_comparison",
    f"""with b as (select specimen_id, source, {BAND} as rb, {BANDS} as nb, area from kept), s as (select specimen_id, rb, avg(area) as v from b where source='real' and rb between 0 and nb-1 group by 1,2), m as (select specimen_id, rb, avg(area) as v from b where source='sim' and rb between 0 and nb-1 group by 1,2)
select coalesce(s.specimen_id,m.specimen_id) as specimen_id, coalesce(s.rb,m.rb) as rb, round(s.v,6) as spec, round(m.v,6) as sim from s full outer join m on s.specimen_id=m.specimen_id and s.rb=m.rb""",
)
def c16(t):
    d = cells.polar(t.kept)
    # both profiles come out of one aggregation, which is the full outer join of the two
    return d.groupBy("specimen_id", "rb").agg(
        F.round(F.avg(F.when(F.col("source") == "real", kernels.clean("area"))), 6).alias("spec"),
        F.round(F.avg(F.when(F.col("source") == "sim", kernels.clean("area"))), 6).alias("sim"),
    )


@query(
    "j12_band_join",
    f"""with b as (select specimen_id, source, {BAND} as rb, {BANDS} as nb from kept), s as (select specimen_id, rb, count(*) as n from b where source='real' and rb between 0 and nb-1 group by 1,2), m as (select specimen_id, rb, count(*) as n from b where source='sim' and rb between 0 and nb-1 group by 1,2)
select coalesce(s.specimen_id,m.specimen_id) as specimen_id, coalesce(s.rb,m.rb) as rb, s.n as spec, m.n as sim from s full outer join m on s.specimen_id=m.specimen_id and s.rb=m.rb""",
)
def j12(t):
    d = cells.polar(t.kept)
    def profile(source, name):
        return d.filter(F.col("source") == source).groupBy("specimen_id", "rb").agg(F.count(F.lit(1)).alias(name))
    return profile("real", "spec").join(profile("sim", "sim"), ["specimen_id", "rb"], "full_outer")


@query(
    "c17_area_distribution",
    f"""with {SPLIT_LIM}, {split_sql(29)} select specimen_id, bin, r as n_real, m as n_sim, round(dr,6) as pdf_real, round(dm,6) as pdf_sim,
 round(sum(r) over w/(sum(r) over (partition by specimen_id)),8) as cdf_real, round(sum(m) over w/(sum(m) over (partition by specimen_id)),8) as cdf_sim from q window w as (partition by specimen_id order by bin)""",
)
def c17(t):
    from craquelure.operators.distributions import cdf

    h = split_hist(t, 29)
    h = cdf(h, K, "n_real").withColumnRenamed("cdf", "cdf_real")
    h = cdf(h, K, "n_sim").withColumnRenamed("cdf", "cdf_sim")
    return h.select(
        "specimen_id",
        "bin",
        "n_real",
        "n_sim",
        F.round("density_real", 6).alias("pdf_real"),
        F.round("density_sim", 6).alias("pdf_sim"),
        F.round("cdf_real", 8).alias("cdf_real"),
        F.round("cdf_sim", 8).alias("cdf_sim"),
    )
