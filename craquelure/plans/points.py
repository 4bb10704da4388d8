"""Point-pattern queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from craquelure.functions import mechanics as M
from craquelure.operators import cells, neighbours as N, pointstats as P
from craquelure.operators.panes import pane_intensity
from craquelure.plans.panes import FILLED
from craquelure.plans.registry import query

ID = ["specimen_id"]


def pts(t):
    return t.splinter.select("specimen_id", "splinter_key", "x_mm", "y_mm", "area")


def pair_sql(d):
    return f"""pr as (select a.specimen_id, a.splinter_key as id_a, b.splinter_key as id_b, sqrt((a.x_mm-b.x_mm)*(a.x_mm-b.x_mm)+(a.y_mm-b.y_mm)*(a.y_mm-b.y_mm)) as dist
 from splinter a join splinter b on a.specimen_id=b.specimen_id and a.splinter_key < b.splinter_key and abs(a.x_mm-b.x_mm) <= {d} and abs(a.y_mm-b.y_mm) <= {d}
 where sqrt((a.x_mm-b.x_mm)*(a.x_mm-b.x_mm)+(a.y_mm-b.y_mm)*(a.y_mm-b.y_mm)) <= {d})"""


@query("j4_close_pairs", f"with {pair_sql('7.5e0')} select specimen_id, id_a, id_b, round(dist,6) as dist from pr")
def j4(t):
    d = N.pairs_within(pts(t), ID, "splinter_key", 7.5)
    return d.select("specimen_id", "id_a", "id_b", F.round("dist", 6).alias("dist"))


@query("p1_pair_distances", f"with {pair_sql('20e0')} select specimen_id, id_a, id_b, round(dist,6) as dist from pr")
def p1(t):
    """Distances between events, up to a cut-off: all pairs of a pane are never formed."""
    d = N.pairs_within(pts(t), ID, "splinter_key", 20.0)
    return d.select("specimen_id", "id_a", "id_b", F.round("dist", 6).alias("dist"))


NEAR = """nn as (select a.specimen_id, a.splinter_key, b.splinter_key as neighbour, sqrt((a.x_mm-b.x_mm)*(a.x_mm-b.x_mm)+(a.y_mm-b.y_mm)*(a.y_mm-b.y_mm)) as dist
 from splinter a join splinter b on a.specimen_id=b.specimen_id),
rk as (select *, row_number() over (partition by splinter_key order by dist, neighbour) as rank from nn qualify rank <= {k})"""


@query(
    "j5_nearest_30",
    f"with {NEAR.format(k=30)} select splinter_key, count(*) as n, round(max(dist),6) as farthest, round(sum(dist),4) as total from rk group by 1",
)
def j5(t):
    d = N.nearest_totals(pts(t), ID, "splinter_key", 30)
    return d.groupBy("splinter_key").agg(
        F.sum("n").alias("n"), F.round(F.max("farthest"), 6).alias("farthest"), F.round(F.sum("total"), 4).alias("total")
    )


@query("t5_nearest_slice", f"with {NEAR.format(k=4)} select splinter_key, rank, neighbour, round(dist,6) as dist from rk")
def t5(t):
    d = N.nearest(pts(t), ID, "splinter_key", 4)
    return d.select("splinter_key", "rank", "neighbour", F.round("dist", 6).alias("dist"))


TOUCH = """cp as (select distinct specimen_id, splinter_key, px, py from contour_point),
tc as (select distinct a.specimen_id, a.splinter_key as id_a, b.splinter_key as id_b from cp a join cp b on a.specimen_id=b.specimen_id and a.px=b.px and a.py=b.py and a.splinter_key < b.splinter_key),
sy as (select specimen_id, id_a, id_b from tc union select specimen_id, id_b, id_a from tc)"""


@query("j6_touching", f"with {TOUCH} select specimen_id, id_a, id_b from tc")
def j6(t):
    return N.touching(t.contour_point)


@query(
    "j7_shared_points",
    """with twice as (select specimen_id, px, py from contour_point group by 1,2,3 having count(*) > 1),
few as (select c.* from contour_point c join twice t on c.specimen_id=t.specimen_id and c.px=t.px and c.py=t.py)
select a.specimen_id, a.px, a.py, a.splinter_key as id_a, a.k as k_a, b.splinter_key as id_b, b.k as k_b from few a join few b
 on a.specimen_id=b.specimen_id and a.px=b.px and a.py=b.py and (a.splinter_key < b.splinter_key or (a.splinter_key = b.splinter_key and a.k < b.k))""",
)
def j7(t):
    return N.shared_points(t.contour_point)


@query("j8_symmetric_neighbours", f"with {TOUCH} select specimen_id, id_a, id_b from sy")
def j8(t):
    return N.symmetric(N.touching(t.contour_point))


@query("u4_common_points", f"with cp as (select distinct specimen_id, splinter_key, px, py from contour_point) select a.specimen_id, a.splinter_key as id_a, b.splinter_key as id_b, count(*) as n from cp a join cp b on a.specimen_id=b.specimen_id and a.px=b.px and a.py=b.py and a.splinter_key < b.splinter_key group by 1,2,3")
def u4(t):
    return N.common_points(t.contour_point)


COUNTS = f"{TOUCH}, nc as (select s.specimen_id, s.splinter_key, count(id_b) as n from splinter s left join sy on sy.specimen_id=s.specimen_id and sy.id_a=s.splinter_key group by 1,2)"


def touches(t):
    return N.neighbour_counts(t.splinter, N.symmetric(N.touching(t.contour_point)))


@query("a27_neighbour_counts", f"with {COUNTS} select specimen_id, max(n) as most, min(n) as least, round(avg(n),8) as mean from nc group by 1")
def a27(t):
    return touches(t).groupBy("specimen_id").agg(
        F.max("n").alias("most"), F.min("n").alias("least"), F.round(F.avg("n"), 8).alias("mean")
    )


@query(
    "a27_edges_over_energy",
    f"""with {COUNTS} select p.specimen_id, round(any_value(1e6/5e0*(1e0-0.23e0)/70e3*sig_h*sig_h),4) as u_d, round(avg(n),8) as mean_edges from nc join specimen p on p.specimen_id=nc.specimen_id where has_splinters group by 1""",
)
def a27b(t):
    means = touches(t).groupBy("specimen_id").agg(F.round(F.avg("n"), 8).alias("mean_edges"))
    u_d = F.round(M.energy_density(F.col("sig_h")), 4).alias("u_d")
    return means.join(t.specimen.filter("has_splinters").select("specimen_id", u_d), "specimen_id")


@query("h12_neighbour_pdf", f"with {COUNTS} select specimen_id, n, round(count(*)/cast(sum(count(*)) over (partition by specimen_id) as double),8) as density from nc group by 1,2")
def h12(t):
    c = touches(t).groupBy("specimen_id", "n").agg(F.count(F.lit(1)).alias("c"))
    total = c.groupBy("specimen_id").agg(F.sum("c").alias("total"))
    return c.join(total, "specimen_id").select("specimen_id", "n", F.round(F.col("c") / F.col("total"), 8).alias("density"))


def lc_sql(d: str, area: str, points: str = "splinter") -> str:
    """K, L, centred L of every specimen, pairs counted naively."""
    return f"""pp as (select a.specimen_id, sqrt((a.x_mm-b.x_mm)*(a.x_mm-b.x_mm)+(a.y_mm-b.y_mm)*(a.y_mm-b.y_mm)) as dist from {points} a join {points} b on a.specimen_id=b.specimen_id and a.splinter_key <> b.splinter_key and abs(a.x_mm-b.x_mm) <= {d} and abs(a.y_mm-b.y_mm) <= {d}),
pb as (select specimen_id, cast(ceil(dist/({d}/100e0)) as int) as step, count(*) as c from pp where dist <= {d} group by 1,2),
tot as (select specimen_id, cast(count(*) as double) as n, {area} as a from {points} group by 1),
kk as (select tot.specimen_id, s.step, s.step*({d}/100e0) as d, a*sum(coalesce(c,0)) over (partition by tot.specimen_id order by s.step)/(n*n) as k from tot cross join (select unnest(range(0,101)) as step) s left join pb on pb.specimen_id=tot.specimen_id and pb.step=s.step),
lc as (select *, sqrt(k/pi()) as l, sqrt(k/pi())-d as lc from kk where step > 0)"""


def pane_k(t, d_max):
    return P.k_function(pts(t), ID, d_max, F.lit(1.0) * F.max(F.lit(250000.0)))


K50 = f"with {lc_sql('50e0', '250000e0')}"


@query("p2_k_function", f"{K50} select specimen_id, step, d, round(k,4) as k from lc")
def p2(t):
    return pane_k(t, 50.0).select("specimen_id", "step", "d", F.round("k", 4).alias("k"))


WEIGHTED = """with pp as (select a.specimen_id, abs(a.x_mm-b.x_mm) as dx, abs(a.y_mm-b.y_mm) as dy, sqrt((a.x_mm-b.x_mm)*(a.x_mm-b.x_mm)+(a.y_mm-b.y_mm)*(a.y_mm-b.y_mm)) as dist from splinter a join splinter b on a.specimen_id=b.specimen_id and a.splinter_key <> b.splinter_key and abs(a.x_mm-b.x_mm) <= 50e0 and abs(a.y_mm-b.y_mm) <= 50e0),
pb as (select specimen_id, cast(ceil(dist/(50e0/100e0)) as int) as step, sum(250000e0/((500e0-dx)*(500e0-dy))) as c from pp where dist <= 50e0 group by 1,2), tot as (select specimen_id, cast(count(*) as double) as n from splinter group by 1),
kk as (select tot.specimen_id, s.step, 250000e0*sum(coalesce(c,0e0)) over (partition by tot.specimen_id order by s.step)/(n*n) as k from tot cross join (select unnest(range(0,101)) as step) s left join pb on pb.specimen_id=tot.specimen_id and pb.step=s.step)
"""


def weighted_k(t):
    """With the edge correction and over the whole range of distances."""
    d = pts(t).withColumn("w_mm", F.lit(500.0)).withColumn("h_mm", F.lit(500.0))
    return P.k_function(d, ID, 50.0, F.max(F.lit(250000.0)), weight=True)


@query("p2_k_edge_corrected", f"{WEIGHTED}select specimen_id, step, round(k,4) as k from kk where step > 0")
def p2w(t):
    return weighted_k(t).select("specimen_id", "step", F.round("k", 4).alias("k"))


@query("p3_l_edge_corrected", f"{WEIGHTED}select specimen_id, step, round(sqrt(k/pi()),5) as l from kk where step > 0")
def p3w(t):
    return weighted_k(t).select("specimen_id", "step", F.round("l", 5).alias("l"))


@query(
    "p4_centred_l_edge_corrected",
    f"{WEIGHTED}select specimen_id, step, round(sqrt(k/pi()) - step*(50e0/100e0),5) as lc from kk where step > 0",
)
def p4w(t):
    return weighted_k(t).select("specimen_id", "step", F.round("lc", 5).alias("lc"))


@query("p3_l_function", f"{K50} select specimen_id, step, d, round(l,5) as l from lc")
def p3(t):
    return pane_k(t, 50.0).select("specimen_id", "step", "d", F.round("l", 5).alias("l"))


@query("p4_centred_l", f"{K50} select specimen_id, step, d, round(lc,5) as lc from lc")
def p4(t):
    return pane_k(t, 50.0).select("specimen_id", "step", "d", F.round("lc", 5).alias("lc"))


@query("p10_poisson_reference", f"{K50} select specimen_id, step, round(k/(pi()*d*d),5) as k_ratio, round(l/d,5) as l_ratio from lc")
def p10(t):
    d = F.col("d")
    return pane_k(t, 50.0).select(
        "specimen_id", "step", F.round(F.col("k") / (math.pi * d * d), 5).alias("k_ratio"), F.round(F.col("l") / d, 5).alias("l_ratio")
    )


def smooth_sql(length: int, base: str = "lc") -> str:
    shift = (length - 1) // 2
    return f"""hw as (select k, 0.5e0-0.5e0*cos(2e0*pi()*k/{length - 1}e0) as w from (select unnest(range(0,{length})) as k)), hs as (select sum(w) as tw from hw),
sm as (select a.specimen_id, a.step, a.d, a.lc, sum(b.lc*hw.w)/any_value(tw) as s from {base} a join {base} b on b.specimen_id=a.specimen_id join hw on hw.k = a.step + {shift} - b.step cross join hs group by 1,2,3,4)"""


RHC = """mn as (select a.specimen_id, a.step, a.d, a.s, row_number() over (partition by a.specimen_id order by a.step) as rn from sm a where a.step between 2 and 99 and not exists (select 1 from sm b where b.specimen_id=a.specimen_id and b.step<>a.step and abs(b.step-a.step) <= 20 and b.s <= a.s)),
rh as (select t.specimen_id, coalesce(case when m2.s is not null and m1.s > m2.s then m2.d else m1.d end, 100*(7.5e0/100e0)) as rhc from tot t left join mn m1 on m1.specimen_id=t.specimen_id and m1.rn=1 left join mn m2 on m2.specimen_id=t.specimen_id and m2.rn=2)"""
KEPT_LC = lc_sql("7.5e0", "sum(area)", "kept")


@query("p5_first_minimum", f"with {KEPT_LC}, {smooth_sql(33)}, {RHC} select specimen_id, round(rhc,6) as rhc from rh")
def p5(t):
    lc = P.k_function(t.kept, ID, 7.5, F.sum("area"))
    return P.hard_core_radius(lc, ID).select("specimen_id", F.round("rhc", 6).alias("rhc"))


@query("p6_pane_radius", f"with {KEPT_LC}, {smooth_sql(33)}, {RHC} select specimen_id, round(rhc,6) as rhc, round(rhc/sqrt(500000e0),8) as acceptance from rh")
def p6(t):
    d = P.pane_radius(t.kept)
    return d.select("specimen_id", F.round("rhc", 6).alias("rhc"), F.round("acceptance", 8).alias("acceptance"))


@query(
    "p7_break_parameters",
    f"{FILLED}, {KEPT_LC}, {smooth_sql(33)}, {RHC}, la as (select specimen_id, avg(intensity) as lam from z group by 1) select specimen_id, round(lam,8) as lam, round(rhc,6) as rhc, round(rhc/sqrt(500000e0),8) as acceptance from rh join la using (specimen_id)",
)
def p7(t):
    lam = pane_intensity(t.kept, t.specimen)
    d = P.pane_radius(t.kept).join(lam, "specimen_id")
    return d.select(
        "specimen_id", F.round("intensity", 8).alias("lam"), F.round("rhc", 6).alias("rhc"), F.round("acceptance", 8).alias("acceptance")
    )


X2 = """ev as (select * from splinter where x_mm > 50e0 and x_mm < 450e0 and y_mm > 50e0 and y_mm < 450e0), en as (select specimen_id, count(*) as n from ev group by 1),
qc as (select specimen_id, floor(x_mm/100e0) as i, floor(y_mm/100e0) as j, count(*) as o from ev group by 1,2,3),
qg as (select en.specimen_id, n, coalesce(o,0) as o, n*(10000e0/250000e0) as e from en cross join (select unnest(range(0,5)) as i) a cross join (select unnest(range(0,5)) as j) b left join qc on qc.specimen_id=en.specimen_id and qc.i=a.i and qc.j=b.j),
x2 as (select specimen_id, max(n) as n, sum((o-e)*(o-e)/e) as x2, 16 as dof from qg group by 1)"""


def interior(t):
    return pts(t).filter("x_mm > 50e0 and x_mm < 450e0 and y_mm > 50e0 and y_mm < 450e0")


@query("p8_quadrat_test", f"with {X2} select specimen_id, n, round(x2,4) as x2, dof from x2")
def p8(t):
    d = P.quadrat_test(interior(t), ID)
    return d.select("specimen_id", "n", F.round("x2", 4).alias("x2"), "dof")


@query(
    "p9_homogeneity",
    f"""{FILLED}, {KEPT_LC}, {smooth_sql(33)}, {RHC}, {X2}, la as (select specimen_id, avg(intensity) as lam from z group by 1)
select p.specimen_id, round(sqrt(2e0/sqrt(3e0)/lam),6) as d_hcp, round(rhc/sqrt(2e0/sqrt(3e0)/lam),6) as alpha, round(x2,4) as x2, x2 >= 26.29622760486423e0 as inhomogeneous
 from specimen p join la using (specimen_id) join rh using (specimen_id) join x2 using (specimen_id) where has_splinters""",
)
def p9(t):
    d = t.specimen.filter("has_splinters").select("specimen_id")
    d = d.join(pane_intensity(t.kept, t.specimen), "specimen_id").join(P.pane_radius(t.kept), "specimen_id")
    d = d.join(P.quadrat_test(interior(t), ID), "specimen_id")
    hcp = P.delta_hcp(F.col("intensity"))
    return d.select(
        "specimen_id",
        F.round(hcp, 6).alias("d_hcp"),
        F.round(F.col("rhc") / hcp, 6).alias("alpha"),
        F.round("x2", 4).alias("x2"),
        (F.col("x2") >= F.col("critical")).alias("inhomogeneous"),
    )


@query(
    "p11_first_maximum",
    f"""{K50}, {smooth_sql(20)}, mx as (select a.specimen_id, min(a.step) as step from sm a where a.step between 2 and 99 and not exists (select 1 from sm b where b.specimen_id=a.specimen_id and b.step<>a.step and abs(b.step-a.step) <= 3 and b.s >= a.s) group by 1),
gl as (select specimen_id, arg_max(step, s) as step from sm group by 1) select gl.specimen_id, round(coalesce(mx.step, gl.step)*0.5e0,6) as r_max from gl left join mx using (specimen_id)""",
)
def p11(t):
    return P.first_maximum(pane_k(t, 50.0), ID).select("specimen_id", F.round("r_max", 6).alias("r_max"))


WINDOW_ID = "wp as (select k.specimen_id*100 + c.i*10 + e.j as specimen_id, k.splinter_key, k.x_mm, k.y_mm, k.area from kept k join (select i, 200e0+i*(100e0/4e0) as c from (select unnest(range(0,4)) as i)) c on c.c-100e0 <= k.x_mm and k.x_mm < c.c+100e0 join (select i as j, 200e0+i*(100e0/4e0) as c from (select unnest(range(0,4)) as i)) e on e.c-100e0 <= k.y_mm and k.y_mm < e.c+100e0)"


@query(
    "a11_window_radius",
    f"with {WINDOW_ID}, {lc_sql('7.5e0', 'sum(area)', 'wp')}, {smooth_sql(33)}, {RHC} select rh.specimen_id // 100 as specimen_id, (rh.specimen_id % 100) // 10 as i, rh.specimen_id % 10 as j, round(rhc,6) as rhc from rh join tot using (specimen_id) where n >= 50",
)
def a11(t):
    placed = cells.windows(t.kept, kw=200.0, n_points=5)
    d = P.region_radius(placed, ["specimen_id", "i", "j"])
    return d.select("specimen_id", "i", "j", F.round("rhc", 6).alias("rhc"))


@query(
    "a12_window_acceptance",
    f"with {WINDOW_ID}, {lc_sql('5e0', 'sum(area)', 'wp')} select specimen_id // 100 as specimen_id, (specimen_id % 100) // 10 as i, specimen_id % 10 as j, round(arg_min(step*(5e0/100e0), round(lc,9)*1e6+step/1e9)/sqrt(500000e0),8) as acceptance from lc group by 1,2,3",
)
def a12(t):
    placed = cells.windows(t.kept, kw=200.0, n_points=5)
    keys = ["specimen_id", "i", "j"]
    lc = P.k_function(placed, keys, 5.0, F.sum("area"))
    d = P.acceptance(lc.withColumn("lc", F.round("lc", 9)), keys, F.lit(math.hypot(500.0, 500.0)))
    return d.select("specimen_id", "i", "j", F.round("acceptance", 8).alias("acceptance"))
