"""Splinter-level queries: exclusions, boxes, joins to specimens and cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from craquelure.functions import mechanics as M
from craquelure.operators import cells, exclusions as X
from craquelure.plans.registry import query


def joined(t):
    return t.splinter.join(t.specimen, "specimen_id")


JOINED = "splinter s join specimen p using (specimen_id)"
DIST = "sqrt((x_mm-ip_x)*(x_mm-ip_x)+(y_mm-ip_y)*(y_mm-ip_y))"


@query("s5_splinter_table", "select specimen_id, splinter_key, x_mm, y_mm, area, round(circ,6) as circ, source from splinter")
def s5(t):
    return t.splinter.select("specimen_id", "splinter_key", "x_mm", "y_mm", "area", F.round("circ", 6).alias("circ"), "source")


@query("s6_contour_points", "select specimen_id, splinter_key, k, px, py from contour_point")
def s6(t):
    return t.contour_point


@query("f10_edge_exclusion", f"select splinter_key from {JOINED} where x_mm > 10e0 and x_mm < w_mm-10e0 and y_mm > 10e0 and y_mm < h_mm-10e0")
def f10(t):
    return joined(t).filter(X.away_from_edge()).select("splinter_key")


@query("f11_impact_exclusion", f"select splinter_key from {JOINED} where {DIST} > 20e0")
def f11(t):
    return joined(t).filter(X.away_from_impact()).select("splinter_key")


@query(
    "f12_sensor_exclusion",
    f"""select splinter_key from {JOINED} where break_pos <> 'corner' or not exists (select 1 from (values (450e0,50e0),(250e0,250e0),(450e0,450e0),(50e0,450e0)) q(sx,sy)
 where sqrt((x_mm-sx)*(x_mm-sx)+(y_mm-sy)*(y_mm-sy)) <= 10e0)""",
)
def f12(t):
    return joined(t).filter(X.away_from_sensors()).select("splinter_key")


@query(
    "f13_position_exclusion",
    f"""select splinter_key from {JOINED} where not (specimen_id % 2 = 0 and sqrt((x_mm-120e0)*(x_mm-120e0)+(y_mm-300e0)*(y_mm-300e0)) <= 100e0)
 and not (specimen_id % 2 = 0 and sqrt((x_mm-400e0)*(x_mm-400e0)+(y_mm-80e0)*(y_mm-80e0)) <= 100e0)""",
)
def f13(t):
    positions = F.when(
        F.col("specimen_id") % 2 == 0,
        F.array(F.array(F.lit(120.0), F.lit(300.0)), F.array(F.lit(400.0), F.lit(80.0))),
    ).otherwise(F.array().cast("array<array<double>>"))
    d = t.splinter.join(t.specimen.select("specimen_id", positions.alias("excluded_positions")), "specimen_id")
    return d.filter(X.away_from_positions(radius=100.0)).select("splinter_key")


@query(
    "f14_simulation_exclusion",
    "select splinter_key from splinter where source='sim' and x_mm > 10e0 and x_mm < 490e0 and y_mm > 10e0 and y_mm < 490e0 and sqrt((x_mm-50e0)*(x_mm-50e0)+(y_mm-50e0)*(y_mm-50e0)) > 20e0",
)
def f14(t):
    d = t.splinter.filter("source = 'sim'").select(
        "splinter_key", "x_mm", "y_mm", *[F.lit(500.0).alias(c) for c in ("w_mm", "h_mm")], *[F.lit(50.0).alias(c) for c in ("ip_x", "ip_y")]
    )
    return d.filter(X.away_from_edge() & X.away_from_impact()).select("splinter_key")


@query("f15_box_membership", "select splinter_key from splinter where x_mm between 100e0 and 150e0 and y_mm between 375e0 and 425e0")
def f15(t):
    return t.splinter.filter(X.in_box(100.0, 375.0, 150.0, 425.0)).select("splinter_key")


@query(
    "f16_contour_share",
    "select splinter_key, sum(case when px between 1000 and 3000 and py between 1000 and 3000 then 1e0 else 0e0 end)/count(*) as share from contour_point group by 1",
)
def f16(t):
    return t.contour.select("splinter_key", X.contour_share(1000, 1000, 3000, 3000).alias("share"))


@query(
    "f17_area_filter",
    """select splinter_key, specimen_id from (select *, row_number() over (partition by specimen_id order by area desc, splinter_key desc) as rn from splinter)
 where rn > 1 and area between 5e0 and 45e0""",
)
def f17(t):
    return X.area_filter(t.splinter, "specimen_id", 5.0, 45.0).select("splinter_key", "specimen_id")


@query(
    "f18_property_summary",
    """select specimen_id, max(v) as max_v, min(v) as min_v, round(avg(v),6) as mean_v, median(v) as median_v
 from (select specimen_id, case when area < 49e0 then area end as v from splinter) where v is not null group by 1""",
)
def f18(t):
    v = F.when(F.col("area") < 49, F.col("area")).otherwise(F.lit(float("nan")))
    d = t.splinter.select("specimen_id", v.alias("v")).filter(X.finite("v"))
    return median_by_counts(d).select("specimen_id", "max_v", "min_v", F.round("mean_v", 6).alias("mean_v"), "median_v")


def median_by_counts(d):
    """min, max, mean and exact median from value counts instead of sorted groups."""
    from craquelure.operators.distributions import weighted_median

    counts = d.groupBy("specimen_id", "v").agg(F.count(F.lit(1)).alias("c"))
    stats = counts.groupBy("specimen_id").agg(
        F.max("v").alias("max_v"),
        F.min("v").alias("min_v"),
        (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean_v"),
    )
    return stats.join(weighted_median(counts, ["specimen_id"], "v", "c"), "specimen_id").withColumnRenamed("median", "median_v")


@query("f21_interior_points", "select splinter_key from splinter where x_mm > 50e0 and x_mm < 450e0 and y_mm > 50e0 and y_mm < 450e0")
def f21(t):
    d = t.splinter.select("splinter_key", "x_mm", "y_mm", F.lit(500.0).alias("w_mm"), F.lit(500.0).alias("h_mm"))
    return d.filter(X.away_from_edge(50.0)).select("splinter_key")


@query("f23_frame_range", "select crack_id, frame, x_mm, y_mm from crack_tip where frame between 10 and 40")
def f23(t):
    return t.crack_tip.filter(F.col("frame").between(10, 40))


@query(
    "j1_splinter_specimen",
    f"select splinter_key, name, thickness, round({DIST},6) as r, round(1e6/5e0*(1e0-0.23e0)/70e3*sig_h*sig_h*measured_thickness*1e-3,6) as u from {JOINED}",
)
def j1(t):
    u = M.energy(F.col("sig_h"), F.col("measured_thickness"))
    return joined(t).select(
        "splinter_key", "name", "thickness", F.round(X.distance("ip_x", "ip_y"), 6).alias("r"), F.round(u, 6).alias("u")
    )


WINDOWS = """(select i, 50e0 + i*(400e0/24e0) as c from (select unnest(range(0,24)) as i))"""
IN_X = "c.c - 25e0 <= k.x_mm and k.x_mm < c.c + 25e0"
IN_Y = "e.c - 25e0 <= k.y_mm and k.y_mm < e.c + 25e0"
WINDOW_JOIN = f"kept k join {WINDOWS} c on {IN_X} join (select i as j, c from {WINDOWS}) e on {IN_Y}"


@query("j2_window_membership", f"select k.splinter_key, c.i, e.j from {WINDOW_JOIN}")
def j2(t):
    return cells.windows(t.kept).select("splinter_key", "i", "j")


BAND = f"cast(floor(({DIST}-20e0)/25e0) as int)"
BANDS = "cast(ceil((sqrt((w_mm-ip_x)*(w_mm-ip_x)+(h_mm-ip_y)*(h_mm-ip_y))-20e0)/25e0) as int)-1"
THETA = "degrees(atan2(y_mm-ip_y, x_mm-ip_x))"


@query(
    "j3_polar_bands",
    f"""select splinter_key, rb, tb from (select splinter_key, {BAND} as rb, cast(floor(({THETA}+180e0)/30e0) as int) as tb, {BANDS} as nb from kept)
 where rb >= 0 and rb < nb and tb < 12""",
)
def j3(t):
    return cells.polar(t.kept, dt=30.0).select("splinter_key", "rb", "tb")


@query(
    "s18_region_report",
    f"""with b as (select * from (values (0,75e0),(1,250e0),(2,425e0)) q(box,c))
select s.specimen_id, box, splinter_key, row_number() over (partition by s.specimen_id, box order by splinter_key) - 1 as nr, round(ip_x-x_mm,6) as to_impact_x, round(ip_y-y_mm,6) as to_impact_y,
 round(avg(area) over (partition by s.specimen_id, box),6) as mean_area, round(stddev_pop(area) over (partition by s.specimen_id, box),5) as std_area
 from {JOINED} join b on x_mm between c-25e0 and c+25e0 and y_mm between c-25e0 and c+25e0""",
)
def s18(t):
    from craquelure.operators.exports import region_report

    return region_report(joined(t)).select(
        "specimen_id",
        "box",
        "splinter_key",
        "nr",
        *[F.round(c, 6).alias(c) for c in ("to_impact_x", "to_impact_y", "mean_area")],
        F.round("std_area", 5).alias("std_area"),
    )
