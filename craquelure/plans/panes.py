"""Window, band and pane aggregates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from craquelure.functions import mechanics as M
from craquelure.operators import cells, kernels, panes
from craquelure.plans.fragments import BAND, BANDS, DIST, JOINED, THETA, WINDOW_JOIN
from craquelure.plans.registry import query

MEAN_STD = "round(avg(area),6) as area, round(stddev_pop(area),5) as area_std"


def r(*names, digits=6):
    return [F.round(n, digits).alias(n) for n in names]


@query(
    "a1_window_stats",
    f"select k.specimen_id, c.i, e.j, count(*) as n, {MEAN_STD} from {WINDOW_JOIN} group by 1,2,3",
)
def a1(t):
    d = panes.window_grid(t.kept, ["area"])
    return d.select("specimen_id", "i", "j", "n", *r("area"), *r("area_std", digits=5))


@query(
    "a2_fitted_grid",
    """with g as (select i, 40e0 + i*(420e0/12e0) as c from (select unnest(range(0,12)) as i))
select k.specimen_id, c.i, e.j, count(*) as n, round(avg(area),6) as area, round(stddev_pop(area),5) as area_std
 from kept k join g c on c.c - 20e0 <= k.x_mm and k.x_mm < c.c + 20e0 join (select i as j, c from g) e on e.c - 20e0 <= k.y_mm and k.y_mm < e.c + 20e0 group by 1,2,3""",
)
def a2(t):
    d = panes.window_grid(t.kept, ["area"], kw=40.0, n_points=-1)
    return d.select("specimen_id", "i", "j", "n", *r("area"), *r("area_std", digits=5))


@query(
    "a3_quadrat_grid",
    """with g as (select i, 50e0 + i*(400e0/9e0) as c from (select unnest(range(0,9)) as i))
select k.specimen_id, c.i, e.j, cast(count(*) as double) as "count", round(avg(circ),6) as circ
 from kept k join g c on c.c - 25e0 <= k.x_mm and k.x_mm < c.c + 25e0 join (select i as j, c from g) e on e.c - 25e0 <= k.y_mm and k.y_mm < e.c + 25e0 group by 1,2,3""",
)
def a3(t):
    d = panes.window_grid(t.kept, ["count", "circ"], kw=500.0 / 10, n_points=10)
    return d.select("specimen_id", "i", "j", "count", *r("circ"))


@query(
    "a4_polar_stats",
    f"""select specimen_id, rb, tb, 20e0+(rb+0.5e0)*25e0 as r, count(*) as n, {MEAN_STD} from (select *, {BAND} as rb, cast(floor(({THETA}+180e0)/360e0) as int) as tb, {BANDS} as nb from kept)
 where rb >= 0 and rb < nb and tb < 1 group by 1,2,3,4""",
)
def a4(t):
    d = kernels.aggregate(cells.polar(t.kept), ["specimen_id", "rb", "tb"], ["area"])
    return d.select("specimen_id", "rb", "tb", cells.band_centre().alias("r"), "n", *r("area"), *r("area_std", digits=5))


@query(
    "a5_band_edges",
    """select specimen_id, e as edge, 20e0 + e*25e0 as radius from (select specimen_id, unnest(range(0, cast(ceil((sqrt((w_mm-ip_x)*(w_mm-ip_x)+(h_mm-ip_y)*(h_mm-ip_y))-20e0)/25e0) as int))) as e from specimen)""",
)
def a5(t):
    d = t.specimen.withColumn("edge", F.explode(F.sequence(F.lit(0), cells.n_bands(25.0, 20.0))))
    return d.select("specimen_id", "edge", (F.lit(20.0) + F.col("edge") * 25.0).alias("radius"))


@query(
    "a6_ring_areas",
    """with pos as (select distinct ip_x, ip_y, w_mm, h_mm from specimen), cell as (select p.*, x, y, sqrt((x-ip_x)*(x-ip_x)+(y-ip_y)*(y-ip_y)) as d from pos p, (select unnest(range(0,500)) as x), (select unnest(range(0,500)) as y)),
band as (select *, cast(ceil((d-20e0)/25e0) as int) - 1 as rb, cast(ceil((sqrt((w_mm-ip_x)*(w_mm-ip_x)+(h_mm-ip_y)*(h_mm-ip_y))-20e0)/25e0) as int)-1 as nb from cell)
select ip_x, ip_y, rb, count(*) as ring_area from band where rb >= 0 and rb < nb group by 1,2,3""",
)
def a6(t):
    return cells.ring_areas(t.specimen).select("ip_x", "ip_y", "rb", "ring_area")


@query(
    "a8_window_kernels",
    f"""select k.specimen_id, c.i, e.j, cast(count(*) as double) as "count", cast(floor(count(*)*(2500e0/2500e0)) as double) as nfifty, round(count(*)/sum(area),8) as intensity
 from {WINDOW_JOIN} group by 1,2,3""",
)
def a8(t):
    d = panes.window_grid(t.kept, ["count", "nfifty", "intensity"])
    return d.select("specimen_id", "i", "j", "count", "nfifty", *r("intensity", digits=8))


@query(
    "a9_band_n50",
    f"""with pos as (select distinct ip_x, ip_y, w_mm, h_mm from specimen), cell as (select p.*, sqrt((x-ip_x)*(x-ip_x)+(y-ip_y)*(y-ip_y)) as d from pos p, (select unnest(range(0,500)) as x), (select unnest(range(0,500)) as y)),
ring as (select ip_x, ip_y, cast(ceil((d-20e0)/25e0) as int) - 1 as rb, count(*) as ring_area from cell group by all),
b as (select specimen_id, ip_x, ip_y, rb, count(*) as n from (select *, {BAND} as rb, {BANDS} as nb from kept) where rb >= 0 and rb < nb group by all)
select specimen_id, rb, n, cast(floor(n*(2500e0/ring_area)) as double) as nfifty from b join ring using (ip_x, ip_y, rb)""",
)
def a9(t):
    counts = cells.polar(t.kept).groupBy("specimen_id", "ip_x", "ip_y", "w_mm", "h_mm", "rb").agg(F.count(F.lit(1)).alias("n"))
    d = counts.join(cells.ring_areas(t.specimen), ["ip_x", "ip_y", "w_mm", "h_mm", "rb"])
    return d.select("specimen_id", "rb", "n", F.floor(F.col("n") * (2500.0 / F.col("ring_area"))).cast("double").alias("nfifty"))


FILLED = """
with v as (select k.specimen_id, c.i, e.j, count(*)/sum(area) as v from {join} group by 1,2,3),
g as (select specimen_id, i, j, j*24+i as p from (select distinct specimen_id from specimen), (select unnest(range(0,24)) as i), (select unnest(range(0,24)) as j)),
f as (select g.*, v.v, case when v.v is not null then p end as kp from g left join v using (specimen_id, i, j)),
w as (select *, last_value(kp ignore nulls) over b as p0, first_value(kp ignore nulls) over a as p1, last_value(v ignore nulls) over b as v0, first_value(v ignore nulls) over a as v1 from f
 window b as (partition by specimen_id order by p rows between unbounded preceding and current row), a as (partition by specimen_id order by p rows between current row and unbounded following)),
z as (select specimen_id, i, j, case when v1 is null then v0 when v0 is null then v1 when p0 = p1 then v0 else v0+(v1-v0)*((p-p0)/(p1-p0)) end as intensity from w)
""".replace("{join}", WINDOW_JOIN)


@query("a13_filled_grid", FILLED + "select specimen_id, i, j, round(intensity,8) as intensity from z")
def a13(t):
    values = panes.window_grid(t.kept, ["intensity"]).select("specimen_id", "i", "j", "intensity")
    return panes.filled_grid(values, t.specimen, ["intensity"]).select("specimen_id", "i", "j", *r("intensity", digits=8))


@query(
    "a15_skipped_windows",
    FILLED
    + """, s as (select z.*, i in (0,23) or j in (0,23) or (abs(50e0+i*(400e0/24e0) - ip_x) <= 25e0 and abs(50e0+j*(400e0/24e0) - ip_y) <= 25e0) as skip from z join specimen using (specimen_id)),
m as (select *, avg(case when not skip then intensity end) over (partition by specimen_id) as mu from s), q as (select specimen_id, i, j, case when skip then mu else intensity end as v from m)
select specimen_id, i, j, round(v/max(v) over (partition by specimen_id),6) as intensity from q""",
)
def a15(t):
    values = panes.window_grid(t.kept, ["intensity"]).select("specimen_id", "i", "j", "intensity")
    d = panes.filled_grid(values, t.specimen, ["intensity"]).join(t.specimen.select("specimen_id", "ip_x", "ip_y"), "specimen_id")
    cx, cy = cells.window_centre("i", 500.0, 50.0, 25), cells.window_centre("j", 500.0, 50.0, 25)
    skip = F.col("i").isin(0, 23) | F.col("j").isin(0, 23)
    skip = skip | ((F.abs(cx - F.col("ip_x")) <= 25) & (F.abs(cy - F.col("ip_y")) <= 25))
    d = kernels.skipped_cells(d, ["specimen_id"], "intensity", skip, normalise=True)
    return d.select("specimen_id", "i", "j", *r("intensity"))


@query("a17_pane_intensity", FILLED + "select specimen_id, round(avg(intensity),8) as intensity from z group by 1")
def a17(t):
    return panes.pane_intensity(t.kept, t.specimen).select("specimen_id", *r("intensity", digits=8))


@query("a18_n50_from_intensity", FILLED + "select specimen_id, round(avg(intensity)*2500e0,5) as n50 from z group by 1")
def a18(t):
    d = panes.pane_intensity(t.kept, t.specimen)
    return d.select("specimen_id", F.round(F.col("intensity") * 50.0**2, 5).alias("n50"))


def norm_sql(centres):
    parts = ", ".join(f"({k},{int((x-25)*8)},{int((x+25)*8)},{int((y-25)*8)},{int((y+25)*8)})" for k, (x, y) in enumerate(centres))
    return f"""with c as (select * from (values {parts}) q(k,x1,x2,y1,y2)),
s as (select splinter_key, c.k, sum(case when px between x1 and x2 and py between y1 and y2 then 1e0 else 0e0 end)/count(*) as sc from contour_point join c on true group by 1,2),
v as (select s.splinter_key, sum((case when sc = 1 then 1e0 else 0e0 end) + (case when sc > 0.5e0 then 0.5e0 else 0e0 end)) as v from s group by 1)
select specimen_id, sum(case when x_mm between 25e0 and 475e0 and y_mm between 25e0 and 475e0 then v else 0e0 end)/{len(centres)}e0 as n50 from splinter join v using (splinter_key) group by 1"""


STUDY_CENTRES = ((400.0, 400.0), (400.0, 100.0), (100.0, 400.0), (250.0, 250.0), (400.0, 250.0))


def sized(t):
    return t.contour.join(t.specimen.select("specimen_id", "w_mm", "h_mm"), "specimen_id")


@query("a19_norm_count", norm_sql([(400, 400)]))
def a19(t):
    return panes.norm_count(sized(t))


@query("a20_norm_count_centres", norm_sql(STUDY_CENTRES))
def a20(t):
    return panes.norm_count(sized(t), STUDY_CENTRES)


@query(
    "a21_legacy_norm_count",
    "select specimen_id, count(*) filter (where x_mm between 375e0 and 425e0 and y_mm between 375e0 and 425e0) as n from splinter group by 1",
)
def a21(t):
    from craquelure.operators.exclusions import in_box

    return t.splinter.groupBy("specimen_id").agg(F.count_if(in_box(375.0, 375.0, 425.0, 425.0)).alias("n"))


@query(
    "a22_pane_areas",
    "select specimen_id, round(avg(area),6) as mean_area, sum(area) as total_area, round(avg(area)*64e0,5) as mean_area_px from splinter group by 1",
)
def a22(t):
    return t.splinter.groupBy("specimen_id").agg(
        F.round(F.avg("area"), 6).alias("mean_area"),
        F.sum("area").alias("total_area"),
        F.round(F.avg("area") * 8.0**2, 5).alias("mean_area_px"),
    )


@query(
    "a23_detection_rate",
    f"""select specimen_id, sum(area) as area, round(sum(area)/max(w_mm*h_mm)*100e0,6) as rate, round(abs(1e0-sum(area)/(490e0*490e0-pi()*400e0))*100e0,6) as deviation,
 abs(1e0-sum(area)/(490e0*490e0-pi()*400e0))*100e0 > 5e0 as flagged from {JOINED} group by 1""",
)
def a23(t):
    d = panes.detection_rate(t.splinter.join(t.specimen, "specimen_id"))
    return d.select("specimen_id", "area", *r("rate", "deviation"), "flagged")


@query(
    "a24_crack_surface_simple",
    f"""select specimen_id, round(sum(circ*measured_thickness),3) as crack_surface, round(avg(area*measured_thickness),5) as mean_volume, round(avg(area),6) as mean_area, round(avg(circ),6) as mean_circ,
 round(avg(area)*2500e0*1e-6,8) as mass_per_mm from {JOINED} group by 1""",
)
def a24(t):
    d = panes.crack_surface_simple(t.splinter.join(t.specimen, "specimen_id"))
    return d.select(
        "specimen_id", *r("crack_surface", digits=3), *r("mean_volume", digits=5), *r("mean_area", "mean_circ"), *r("mass_per_mm", digits=8)
    )


@query(
    "a25_crack_surface_edges",
    """with e as (select specimen_id, splinter_key, k, px, py, lead(px) over w as nx, lead(py) over w as ny from contour_point window w as (partition by splinter_key order by k)),
s as (select e.specimen_id, sqrt(cast((nx-px)*(nx-px)+(ny-py)*(ny-py) as double))/8e0 as len, q/50e0 as l, measured_thickness as t from e join splinter using (splinter_key) join specimen p on p.specimen_id = e.specimen_id where nx is not null)
select specimen_id, round(sum(((t+l)+sqrt(t*t+l*l))/2e0*len/2e0),2) as crack_surface from s group by 1""",
)
def a25(t):
    from craquelure.functions.geometry import measures

    # the width is constant along a contour here, so its edges add up to the open length
    d = t.contour.select("specimen_id", "area", (measures("contour")["open"] / 8.0).alias("length"))
    d = d.join(t.specimen.select("specimen_id", "measured_thickness"), "specimen_id")
    surface = panes.edge_surface(F.col("length"), F.col("measured_thickness"), F.col("area").cast("int") / 50.0)
    return d.groupBy("specimen_id").agg(F.round(F.sum(surface), 2).alias("crack_surface"))


@query(
    "a26_perimeter_vs_energy",
    f"""select specimen_id, thickness, round(max(1e6/5e0*(1e0-0.23e0)/70e3*sig_h*sig_h*measured_thickness*1e-3),5) as u, round(sum(circ),4) as perimeter from {JOINED} where thickness in (4,8) and has_splinters and has_scalp group by 1,2""",
)
def a26(t):
    specimens = t.specimen.filter("thickness in (4,8) and has_splinters and has_scalp")
    u = M.energy(F.col("sig_h"), F.col("measured_thickness"))
    sums = t.splinter.groupBy("specimen_id").agg(F.sum("circ").alias("perimeter"))
    return sums.join(specimens, "specimen_id").select("specimen_id", "thickness", F.round(u, 5).alias("u"), F.round("perimeter", 4).alias("perimeter"))


@query(
    "a28_size_by_boundary",
    f"""with m as (select specimen_id, boundary, avg(area) as size, max(abs(1e6/5e0*(1e0-0.23e0)/70e3*sig_h*sig_h*measured_thickness*1e-3)) as u from {JOINED} where has_splinters group by 1,2)
select boundary, specimen_id, round(size,6) as size, round(u,5) as u, round(min(size) over (),6) as min_size, round(max(size) over (),6) as max_size, round(min(u) over (),5) as min_u, round(max(u) over (),5) as max_u from m""",
)
def a28(t):
    sizes = t.splinter.groupBy("specimen_id").agg(F.avg("area").alias("size"))
    u = F.abs(M.energy(F.col("sig_h"), F.col("measured_thickness"))).alias("u")
    d = sizes.join(t.specimen.filter("has_splinters"), "specimen_id").select("boundary", "specimen_id", "size", u)
    limits = d.agg(*[f(c).alias(f"{n}_{c}") for c in ("size", "u") for n, f in (("min", F.min), ("max", F.max))])
    # one row of limits: joined by a constant key, which the optimizer broadcasts
    d = d.withColumn("_k", F.lit(1)).join(limits.withColumn("_k", F.lit(1)), "_k")
    return d.select("boundary", "specimen_id", *r("size", "min_size", "max_size"), *r("u", "min_u", "max_u", digits=5))


@query(
    "a29_nominal_vs_measured",
    """select thickness, nom_stress, round(avg(abs(sig_h)),6) as mean_stress, round(stddev_pop(abs(sig_h)),4) as std_stress, round(avg(measured_thickness),6) as mean_thickness, min(measured_thickness) as min_thickness, max(measured_thickness) as max_thickness, count(*) as n
from specimen where has_scalp and nom_stress <> 0 group by 1,2""",
)
def a29(t):
    s = F.abs("sig_h")
    return t.specimen.filter("has_scalp and nom_stress <> 0").groupBy("thickness", "nom_stress").agg(
        F.round(F.avg(s), 6).alias("mean_stress"),
        F.round(F.stddev_pop(s), 4).alias("std_stress"),
        F.round(F.avg("measured_thickness"), 6).alias("mean_thickness"),
        F.min("measured_thickness").alias("min_thickness"),
        F.max("measured_thickness").alias("max_thickness"),
        F.count(F.lit(1)).alias("n"),
    )


@query(
    "a30_stress_classes",
    "select cast(floor(abs(sig_h)/10e0)*10e0 as double) as stress_class, specimen_id, name, count(*) over (partition by floor(abs(sig_h)/10e0)) as members from specimen",
)
def a30(t):
    """Classes keep their members as rows: a class may be larger than a task."""
    from craquelure.operators.ordered import key_stats

    d = t.specimen.withColumn("stress_class", M.floor_to_10(F.abs("sig_h")).cast("double"))
    return key_stats(d.select("stress_class", "specimen_id", "name"), ["stress_class"], members=F.count(F.lit(1)))


@query(
    "a35_resampled_grid",
    """with s as (select specimen_id, x_mm, y_mm, area, min(x_mm) over w as x0, max(x_mm) over w as x1, min(y_mm) over w as y0, max(y_mm) over w as y1 from splinter window w as (partition by specimen_id)),
b as (select *, cast(floor((x_mm-x0)/((x1-x0)/10e0)) as int) as ix, cast(floor((y_mm-y0)/((y1-y0)/6e0)) as int) as iy from s)
select specimen_id, ix, iy, round(x0+(ix+0.5e0)*((x1-x0)/10e0),6) as cx, round(y0+(iy+0.5e0)*((y1-y0)/6e0),6) as cy, round(avg(area),6) as value from b where ix < 10 and iy < 6 group by all""",
)
def a35(t):
    d = t.splinter.selectExpr("specimen_id", "x_mm as x", "y_mm as y", "area as z")
    return panes.resample(d, ["specimen_id"], 10, 6).select("specimen_id", "ix", "iy", *r("cx", "cy", "value"))


PIXEL_BOXES = """with hh as (select max(y)+1 as h, max(x)+1 as w from pixel), bx as (select i, 8e0 + i*((w-16e0)/9e0) as c from (select unnest(range(0,10)) as i), hh),
b as (select i, floor(c-8e0) as lo, floor(c+8e0) as hi from bx), bj as (select i as j, floor(8e0 + i*((h-16e0)/9e0) - 8e0) as lo, floor(8e0 + i*((h-16e0)/9e0) + 8e0) as hi from (select unnest(range(0,10)) as i), hh),
v as (select b.i, bj.j, count(*) filter (where gray < 127) as value, count(*) as n, avg(gray) as mean_gray from pixel p join b on b.lo <= p.x and p.x < b.hi join bj on bj.lo <= p.y and p.y < bj.hi group by 1,2)
"""


def image_size(t):
    """Width and height: two numbers of one aggregate."""
    return tuple(t.pixel.agg(F.max("x") + 1, F.max("y") + 1).first())


@query("j15_pixel_windows", PIXEL_BOXES + "select i, j, n as value from v")
def j15(t):
    return panes.image_windows(t.pixel, image_size(t), 16, 10, F.count(F.lit(1)))


@query("a16_dark_pixels", PIXEL_BOXES + "select i, j, round(value/(max(value) over ()),6) as value from v")
def a16(t):
    dark = F.count_if(F.col("gray") < 127)
    d = panes.image_windows(t.pixel, image_size(t), 16, 10, dark)
    # at most n x n windows reach this point
    return d.select("i", "j", F.round(F.col("value") / F.max("value").over(Window.partitionBy(F.lit(1))), 6).alias("value"))


@query("x3_image_aggregate", PIXEL_BOXES + "select i, j, round(mean_gray,6) as value from v")
def x3(t):
    return panes.image_windows(t.pixel, image_size(t), 16, 10, F.round(F.avg("gray"), 6))


@query(
    "a36_tiles",
    """select cast(floor(y/16e0) as int) as tile_row, cast(floor(x/16e0) as int) as tile_col, round(avg(gray),6) as mean_gray, count(*) as n from pixel group by 1,2
union all select null, null, round(avg(gray),6), count(*) from pixel""",
)
def a36(t):
    tiles = t.pixel.groupBy(
        F.floor(F.col("y") / 16.0).cast("int").alias("tile_row"), F.floor(F.col("x") / 16.0).cast("int").alias("tile_col")
    ).agg(F.round(F.avg("gray"), 6).alias("mean_gray"), F.count(F.lit(1)).alias("n"))
    whole = t.pixel.agg(F.round(F.avg("gray"), 6).alias("mean_gray"), F.count(F.lit(1)).alias("n"))
    return tiles.unionByName(whole, allowMissingColumns=True)


@query(
    "m14_gray_adjustment",
    "with m as (select avg(gray) as mu from pixel) select y, x, least(255e0, round_even(gray*(150e0/mu),0)) as brightened, floor(255e0*(1e0/(1e0+exp(-10e0*(gray/255e0-0.5e0))))) as contrast from pixel, m",
)
def m14(t):
    d = panes.brightness(t.pixel, 150.0)
    return d.select("y", "x", "brightened", panes.sigmoid_contrast(F.col("gray")).cast("double").alias("contrast"))


@query(
    "x1_named_kernels",
    f"""select specimen_id, rb, cast(count(*) as double) as "count", round(count(*)/sum(area),8) as intensity, round(avg(area),6) as area, round(avg(circ),6) as circ from (select *, {BAND} as rb, {BANDS} as nb from kept) where rb >= 0 and rb < nb group by 1,2""",
)
def x1(t):
    d = kernels.aggregate(cells.polar(t.kept), ["specimen_id", "rb"], ["count", "intensity", "area", "circ"])
    return d.select("specimen_id", "rb", "count", *r("intensity", digits=8), *r("area", "circ"))


@query(
    "x2_custom_kernel",
    f"""select specimen_id, rb, round(sum(area*circ)/sum(area),6) as value, round(sqrt(greatest(0e0, sum(area*circ*circ)/sum(area) - (sum(area*circ)/sum(area))*(sum(area*circ)/sum(area)))),4) as std
 from (select *, {BAND} as rb, {BANDS} as nb from kept) where rb >= 0 and rb < nb group by 1,2""",
)
def x2(t):
    """Area-weighted mean perimeter as a user-defined calculator."""

    def state(pdf: pd.DataFrame):
        w, v = pdf["area"], pdf["circ"]
        return w, w * v, w * v * v

    def finish(w, wv, wvv):
        mean = wv / w
        return mean, F.sqrt(F.greatest(F.lit(0.0), wvv / w - mean * mean))

    placed = cells.polar(t.kept)
    d = kernels.custom(placed, ["specimen_id", "rb"], ["area", "circ"], state, 3, finish)
    return d.select("specimen_id", "rb", *r("value"), *r("std", digits=4))


@query("x4_decider_and_mapper", f"select specimen_id, name, round({DIST.replace('x_mm','w_mm').replace('y_mm','h_mm')},6) as value from specimen where has_scalp and thickness > 4")
def x4(t):
    from craquelure.operators.catalog import scan
    from craquelure.operators.exclusions import distance

    value = F.round(distance("ip_x", "ip_y", "w_mm", "h_mm"), 6).alias("value")
    d = scan(t.specimen, F.col("has_scalp") & (F.col("thickness") > 4), value, max_n=None)
    return d.select("specimen_id", "name", "value")


@query("x5_parallel_map", "select splinter_key, area*2e0 as doubled from splinter")
def x5(t):
    def double(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"splinter_key": pdf["splinter_key"], "doubled": pdf["area"] * 2.0})

    return kernels.map_rows(t.splinter.select("splinter_key", "area"), double, "splinter_key string, doubled double")
