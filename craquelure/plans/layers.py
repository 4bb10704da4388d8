"""Layer queries: property grids over radius and energy, lookups in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from craquelure.functions import mechanics as M, tables as TB
from craquelure.operators import brackets, cells, kernels, layers as L
from craquelure.operators.distributions import moving_average
from craquelure.operators.exclusions import distance
from craquelure.plans.catalog import U, with_energy
from craquelure.plans.distributions import EDGES, W1_SQL
from craquelure.plans.fragments import BAND, BANDS, DIST, THETA
from craquelure.plans.registry import query

SELECTED = "break_pos='corner' and break_mode='punch' and boundary in ('A','B','Z') and has_scalp and has_splinters"


def layer_sql(values: str, columns) -> str:
    filled = ", ".join(
        f"case when {c}_1 is null then {c}_0 when {c}_0 is null then {c}_1 when q0=q1 then {c}_0 else {c}_0+({c}_1-{c}_0)*((rb-q0)/cast(q1-q0 as double)) end as {c}"
        for c in columns
    )
    around = ", ".join(f"last_value({c} ignore nulls) over b as {c}_0, first_value({c} ignore nulls) over a as {c}_1" for c in columns)
    return f"""with sel as (select *, {U} as u, {BANDS} as nb from specimen where {SELECTED}),
bv as (select specimen_id, rb, count(*) as n, {values} from (select k.*, {BAND} as rb from kept k where specimen_id in (select specimen_id from sel)) group by 1,2),
g as (select sel.specimen_id, boundary, thickness, break_pos, u, rb, n, {', '.join(columns)}, case when n is not null then rb end as kp from sel join (select unnest(range(0,40)) as rb) q on rb < nb left join bv using (specimen_id, rb)),
w as (select *, last_value(kp ignore nulls) over b as q0, first_value(kp ignore nulls) over a as q1, {around} from g
 window b as (partition by specimen_id order by rb rows between unbounded preceding and current row), a as (partition by specimen_id order by rb rows between current row and unbounded following)),
layer as (select specimen_id, boundary, thickness, break_pos, u, rb, 20e0+rb*25e0 as r, coalesce(n,0) as n, {filled} from w)"""


AREA_LAYER = layer_sql("avg(area) as area, stddev_pop(area) as area_std", ["area", "area_std"])


def selected(t):
    return L.layer_input(with_energy(t.specimen), "corner")


def area_layer(t):
    return L.create(t.kept, selected(t))


@query(
    "l1_layer_create",
    AREA_LAYER + " select specimen_id, boundary, thickness, round(u,6) as u, r, n, round(area,6) as area, round(area_std,5) as area_std from layer",
)
def l1(t):
    return area_layer(t).select(
        "specimen_id", "boundary", "thickness", F.round("u", 6).alias("u"), "r", "n", F.round("area", 6).alias("area"), F.round("area_std", 5).alias("area_std")
    )


@query(
    "l1_layer_normalised",
    AREA_LAYER + " select specimen_id, boundary, thickness, r, round(area/max(area) over (partition by specimen_id),8) as area from layer",
)
def l1n(t):
    d = L.create(t.kept, selected(t), normalise=True)
    return d.select("specimen_id", "boundary", "thickness", "r", F.round("area", 8).alias("area"))


@query(
    "l2_several_properties",
    layer_sql("avg(area) as area, avg(circ) as circ, count(*)/sum(area) as intensity, cast(count(*) as double) as cnt", ["area", "circ", "intensity", "cnt"])
    + """ select specimen_id, r, prop, value from (select specimen_id, r, 'area' as prop, round(area,6) as value from layer union all select specimen_id, r, 'circ', round(circ,6) from layer
 union all select specimen_id, r, 'intensity', round(intensity,6) from layer union all select specimen_id, r, 'count', round(cnt,6) from layer)""",
)
def l2(t):
    props = ["area", "circ", "intensity", "count"]
    d = L.long(L.create(t.kept, selected(t), props), props)
    return d.select("specimen_id", "r", "prop", F.round("value", 6).alias("value"))


@query(
    "l3_boundary_comparison",
    AREA_LAYER + " select boundary, rb, round(avg(area),6) as area, count(*) as specimens from layer where u > 60e0*0.6e0 and u < 60e0*1.4e0 group by 1,2",
)
def l3(t):
    chosen = selected(t).filter(L.energy_band(F.col("u"), 60.0, 0.4))
    d = L.boundary_means(t.kept, chosen)
    return d.select("boundary", "rb", F.round("area", 6).alias("area"), "specimens")


@query("l4_radial_profile", W1_SQL)
def l4(t):
    """The angle test of the original can never drop a splinter, so there is none."""
    d = t.kept.select("specimen_id", distance("ip_x", "ip_y").alias("r"), "area")
    d = moving_average(d, ["specimen_id"], "r", ["area"], EDGES)
    return d.select("specimen_id", "bin", "edge", "n", F.round("area", 6).alias("area"), F.round("area_std", 5).alias("area_std"))


@query(
    "l5_polar_map",
    f"""select specimen_id, rb, tb, count(*) as n, round(avg(area),6) as area from (select specimen_id, area, {BAND} as rb, cast(floor(({THETA}+180e0)/45e0) as int) as tb, {BANDS} as nb from kept) where rb >= 0 and rb < nb and tb < 8 group by 1,2,3""",
)
def l5(t):
    d = kernels.aggregate(cells.polar(t.kept, dt=45.0), ["specimen_id", "rb", "tb"], ["area"])
    return d.select("specimen_id", "rb", "tb", "n", F.round("area", 6).alias("area"))


LOOKUP = """, gr as (select boundary, thickness, break_pos, u, r, avg(area) as v, avg(area_std) as s from layer group by all),
ax as (select distinct boundary, thickness, u from gr), ai as (select *, lead(u) over (partition by boundary, thickness order by u) as u2, min(u) over (partition by boundary, thickness) as umin, max(u) over (partition by boundary, thickness) as umax, row_number() over (partition by boundary, thickness order by u) as rn, count(*) over (partition by boundary, thickness) as cnt from ax),
qc as (select q.*, greatest(umin, least(umax, u_q)) as uc, ai.u as u0, coalesce(ai.u2, ai.u) as u1 from qs q join ai using (boundary, thickness) where (ai.u < greatest(umin, least(umax, u_q)) and greatest(umin, least(umax, u_q)) <= ai.u2) or (rn = 1 and greatest(umin, least(umax, u_q)) = umin)),
qr as (select *, greatest(20e0, least(595e0, r_q)) as rc, 20e0 + 25e0*greatest(0, ceil((greatest(20e0, least(595e0, r_q))-20e0)/25e0)-1) as r0 from qc),
qw as (select *, r0 + 25e0 as r1, case when u1 > u0 then (uc-u0)/(u1-u0) else 0e0 end as wu, (rc-r0)/25e0 as wr from qr),
res as (select qw.ident, qw.r_q, qw.u_q, (1e0-wu)*((1e0-wr)*a.v+wr*b.v)+wu*((1e0-wr)*c.v+wr*d.v) as value, (1e0-wu)*((1e0-wr)*a.s+wr*b.s)+wu*((1e0-wr)*c.s+wr*d.s) as std from qw
 join gr a on a.boundary=qw.boundary and a.thickness=qw.thickness and a.u=u0 and a.r=r0 join gr b on b.boundary=qw.boundary and b.thickness=qw.thickness and b.u=u0 and b.r=r1
 join gr c on c.boundary=qw.boundary and c.thickness=qw.thickness and c.u=u1 and c.r=r0 join gr d on d.boundary=qw.boundary and d.thickness=qw.thickness and d.u=u1 and d.r=r1)"""


@query(
    "l6_layer_lookup",
    f"""{AREA_LAYER}, qs as (select specimen_id as ident, boundary, thickness, {U}*1.03e0 as u_q, 10e0 + (specimen_id*37) % 610 as r_q from specimen){LOOKUP} select ident, round(r_q,6) as r_q, round(value,5) as value, round(std,4) as std from res""",
)
def l6(t):
    queries = with_energy(t.specimen).selectExpr(
        "specimen_id as ident", "boundary", "thickness", "'corner' as break_pos", "u*1.03e0 as u_q", "10e0 + (specimen_id*37) % 610 as r_q"
    )
    d = L.lookup(L.long(area_layer(t)), queries, ["ident"])
    return d.select("ident", F.round("r_q", 6).alias("r_q"), F.round("value", 5).alias("value"), F.round("std", 4).alias("std"))


@query(
    "l7_radius_sweep",
    f"""{AREA_LAYER}, qs as (select specimen_id as ident, boundary, thickness, 1e6/5e0*(1e0-0.23e0)/70e3*sig_h*sig_h*thickness*1e-3 as u_q, 20e0*k as r_q from specimen cross join (select unnest(range(1,31)) as k)){LOOKUP} select ident, r_q, round(value,5) as value from res""",
)
def l7(t):
    u = M.energy(F.col("sig_h"), F.col("thickness"))
    queries = t.specimen.select(
        F.col("specimen_id").alias("ident"),
        "boundary",
        "thickness",
        F.lit("corner").alias("break_pos"),
        u.alias("u_q"),
        F.explode(F.sequence(F.lit(1), F.lit(30))).alias("k"),
    ).withColumn("r_q", F.col("k") * 20.0)
    d = L.lookup(L.long(area_layer(t)), queries, ["ident"])
    return d.select("ident", "r_q", F.round("value", 5).alias("value"))


@query(
    "l8_model_inputs",
    f"""{layer_sql("count(*)/sum(area) as area, 0e0 as area_std", ["area", "area_std"])}, qs as (select specimen_id as ident, boundary, thickness, {U} as u_q, 20e0+40e0*k as r_q from specimen cross join (select unnest(range(0,16)) as k)){LOOKUP} select ident, round(avg(value),6) as intensity from res group by 1""",
)
def l8(t):
    layer = L.long(L.create(t.kept, selected(t), ["intensity"]), ["intensity"])
    queries = with_energy(t.specimen).select(
        F.col("specimen_id").alias("ident"),
        "boundary",
        "thickness",
        F.lit("corner").alias("break_pos"),
        F.col("u").alias("u_q"),
        F.explode(F.sequence(F.lit(0), F.lit(15))).alias("k"),
    ).withColumn("r_q", F.lit(20.0) + F.col("k") * 40.0)
    d = L.lookup(layer, queries, ["ident"])
    return d.groupBy("ident").agg(F.round(F.avg("value"), 6).alias("intensity"))


@query(
    "l9_layer_catalog",
    f"select boundary, string_agg(distinct cast(thickness as varchar), ',' order by cast(thickness as varchar)) as thicknesses from specimen where {SELECTED} group by 1",
)
def l9(t):
    """At most a handful of distinct thicknesses per group reach the list."""
    d = selected(t).select("boundary", F.col("thickness").cast("string").alias("thickness")).distinct()
    return d.groupBy("boundary").agg(F.array_join(F.array_sort(F.collect_set("thickness")), ",").alias("thicknesses"))


@query(
    "s13_layer_rows",
    AREA_LAYER + " select 'area' as prop, boundary, thickness, break_pos, round(u,6) as u, r, round(area,6) as value, round(area_std,5) as std from layer",
)
def s13(t):
    """What a layer save writes; the sink itself is exercised in the tests."""
    d = L.long(area_layer(t))
    return d.select("prop", "boundary", "thickness", "break_pos", F.round("u", 6).alias("u"), "r", F.round("value", 6).alias("value"), F.round("std", 5).alias("std"))


# ---- bracket lookups in tables --------------------------------------------------------


@query(
    "j10_bracket_lookup",
    """with ax as (select distinct p_size*1e0 as v from part), iv as (select v as lo, lead(v) over (order by v) as hi, min(v) over () as a, max(v) over () as b, row_number() over (order by v) as rn from ax),
q as (select specimen_id, abs(sig_h)/3e0 as x from specimen), c as (select specimen_id, greatest(a, least(b, x)) as x, lo, coalesce(hi, lo) as hi, rn, a from q cross join iv)
select specimen_id, round(x,6) as x, lo, hi from c where (lo < x and x <= hi) or (rn = 1 and x = a)""",
)
def j10(t):
    axis = t.base("part").selectExpr("1 as k", "p_size*1e0 as v")
    q = t.specimen.selectExpr("1 as k", "specimen_id", "abs(sig_h)/3e0 as x_q")
    d = brackets.bracket(q, axis, ["k"], "x_q", "v", "x")
    return d.select("specimen_id", F.round("x", 6).alias("x"), F.col("x_lo").alias("lo"), F.col("x_hi").alias("hi"))


@query(
    "j11_layer_brackets",
    f"""{AREA_LAYER}, qs as (select specimen_id as ident, boundary, thickness, {U}*0.97e0 as u_q, 10e0 + (specimen_id*53) % 610 as r_q from specimen){LOOKUP} select ident, round(u0,6) as u_lo, round(u1,6) as u_hi, r0 as r_lo, r1 as r_hi from qw""",
)
def j11(t):
    q = with_energy(t.specimen).selectExpr(
        "specimen_id as ident", "boundary", "thickness", "'corner' as break_pos", "u*0.97e0 as u_q", "10e0 + (specimen_id*53) % 610 as r_q"
    )
    grid = area_layer(t).select(*L.LAYER_KEYS, "u", "r")
    d = brackets.bracket(q, grid, L.LAYER_KEYS, "u_q", "u", "u")
    d = brackets.bracket(d, grid, L.LAYER_KEYS, "r_q", "r", "r")
    return d.select("ident", F.round("u_lo", 6).alias("u_lo"), F.round("u_hi", 6).alias("u_hi"), "r_lo", "r_hi")


URR = ", ".join(str(tuple(f"{v}e0" for v in row)).replace("'", "") for row in TB.REMAINING_ENERGY)


@query(
    "m6_remaining_energy",
    f"""with urr as (select * from (values {URR}) q(x,n3,n4,n5,ni)), iv as (select x as x1, n4 as a4, ni as ai, lead(x) over (order by x) as x2, lead(n4) over (order by x) as b4, lead(ni) over (order by x) as bi from urr),
m as (select specimen_id, any_value({U}) as u, avg(area)/any_value(measured_thickness*measured_thickness) as d from splinter join specimen using (specimen_id) group by 1)
select m.specimen_id, round(d,6) as ratio, round(a4*pow(d/x1, log10(b4/a4)/log10(x2/x1)),6) as urr4, round(ai*pow(d/x1, log10(bi/ai)/log10(x2/x1)),6) as urr, round(u*ai*pow(d/x1, log10(bi/ai)/log10(x2/x1)),5) as u1
 from m left join iv on d > 0.05e0 and d < 18.45e0 and x1 < d and d <= x2""",
)
def m6(t):
    sizes = t.splinter.groupBy("specimen_id").agg(F.avg("area").alias("mean"))
    d = sizes.join(with_energy(t.specimen).select("specimen_id", "u", "measured_thickness"), "specimen_id")
    h = F.col("measured_thickness")
    urr = TB.remaining_energy(F.col("mean"), h)
    return d.select(
        "specimen_id",
        F.round(F.col("mean") / (h * h), 6).alias("ratio"),
        F.round(TB.remaining_energy(F.col("mean"), h, 4), 6).alias("urr4"),
        F.round(urr, 6).alias("urr"),
        F.round(F.col("u") * urr, 5).alias("u1"),
    )


@query(
    "m12_literature_conversion",
    """with l as (select p_partkey, p_size % 3 * 4 + 4 as thickness, p_retailprice/10e0 as u, p_size/10e0 as sm2 from part)
select p_partkey, round(u/(thickness*1e-3),4) as u_d, round(u/(case when thickness = 12 then 12e-3 else 8e-3 end),4) as u_d_as_read, round(sqrt(u/(thickness*1e-3)*5e0/4e6*70e3/(1e0-0.25e0)),6) as sig_m,
 round(1e6*sm2/(5e0*70e3)*4e0*(1e0-0.23e0),5) as u_from_stress from l""",
)
def m12(t):
    d = t.base("part").selectExpr("p_partkey", "p_size % 3 * 4 + 4 as thickness", "p_retailprice/10e0 as u", "p_size/10e0 as sm2")
    u, h = F.col("u"), F.col("thickness")
    u_d = TB.density_from_energy(u, h)
    return d.select(
        "p_partkey",
        F.round(u_d, 4).alias("u_d"),
        F.round(TB.literature_density(u, h), 4).alias("u_d_as_read"),
        F.round(TB.mid_stress(u_d), 6).alias("sig_m"),
        F.round(TB.energy_from_mid_stress_squared(F.col("sm2")), 5).alias("u_from_stress"),
    )


ENERGIES = ", ".join(f"({t},{n}e0,{u}e0)" for t, n, u in TB.COUNTS_AND_ENERGIES)


@query(
    "m12_counts_beside_literature",
    f"""with l as (select h, n50, u, u/(h*1e-3) as u_d, sqrt(u/(h*1e-3)*5e0/4e6*70e3/(1e0-0.25e0)) as sig_m from (values {ENERGIES}) as q(h, n50, u)),
n as (select specimen_id, count(*) filter (where x_mm between 375e0 and 425e0 and y_mm between 375e0 and 425e0) as n50 from splinter group by 1)
select specimen_id, n.n50, round(min(abs(l.n50-n.n50)),6) as gap, round(arg_min(l.u, struct_pack(g := abs(l.n50-n.n50), u := l.u)),6) as u, round(arg_min(u_d, struct_pack(g := abs(l.n50-n.n50), u := l.u)),4) as u_d, round(arg_min(l.sig_m, struct_pack(g := abs(l.n50-n.n50), u := l.u)),6) as sig_m
 from n join specimen p using (specimen_id) join l on l.h = p.thickness group by 1,2""",
)
def m12b(t):
    """The published row of the same thickness whose count is nearest to the pane's own, by energy among equals."""
    from craquelure.operators.exclusions import in_box

    own = t.splinter.groupBy("specimen_id").agg(F.count_if(in_box(375.0, 375.0, 425.0, 425.0)).alias("n50"))
    rows = TB.literature_energies(t.spark).withColumnRenamed("n50", "published")
    d = own.join(t.specimen.select("specimen_id", "thickness"), "specimen_id").join(rows, "thickness")
    best = F.min(F.struct(F.abs(F.col("published") - F.col("n50")).alias("gap"), "u", "u_d", "sig_m")).alias("b")
    d = d.groupBy("specimen_id", "n50").agg(best)
    rounded = [F.round(f"b.{c}", n).alias(c) for c, n in (("gap", 6), ("u", 6), ("u_d", 4), ("sig_m", 6))]
    return d.select("specimen_id", "n50", *rounded)
