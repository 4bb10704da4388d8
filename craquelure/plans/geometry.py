"""Contour geometry queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from craquelure.functions import geometry as G
from craquelure.operators import properties as P
from craquelure.plans.registry import query

EDGES = """
with o as (select c.*, first_value(px) over w as x0, first_value(py) over w as y0, coalesce(lead(px) over w, first_value(px) over w) as nx, coalesce(lead(py) over w, first_value(py) over w) as ny, lead(px) over w is null as closing
 from contour_point c window w as (partition by splinter_key order by k rows between unbounded preceding and unbounded following)),
e as (select splinter_key, x0, y0, closing, cast(px-x0 as bigint) as x, cast(py-y0 as bigint) as y, cast(nx-x0 as bigint) as u, cast(ny-y0 as bigint) as v from o),
f as (select *, x*v-u*y as c, sqrt(cast((u-x)*(u-x)+(v-y)*(v-y) as double)) as len from e),
m as (select splinter_key, any_value(x0) as x0, any_value(y0) as y0, cast(sum(c) as double) as a, cast(sum(c*(x+u)) as double) as bx, cast(sum(c*(y+v)) as double) as by_,
 cast(sum(c*(x*x+x*u+u*u)) as double) as cxx, cast(sum(c*(y*y+y*v+v*v)) as double) as cyy, cast(sum(c*(x*(2*y+v)+u*(y+2*v))) as double) as cxy, sum(len) as peri, sum(case when not closing then len else 0e0 end) as open_len from f group by 1),
g as (select *, x0 + (bx/3e0)/a as cx, y0 + (by_/3e0)/a as cy, sign(a)*(cxx/12e0-(bx/6e0)*(bx/6e0)/(a/2e0)) as mu20, sign(a)*(cyy/12e0-(by_/6e0)*(by_/6e0)/(a/2e0)) as mu02, sign(a)*(cxy/24e0-(bx/6e0)*(by_/6e0)/(a/2e0)) as mu11 from m),
h as (select *, degrees(0.5e0*atan2(2e0*mu11, mu20-mu02)) as deg0 from g), s as (select *, case when deg0 < 0 then deg0+180e0 else deg0 end as deg from h)
"""


def shaped(t):
    d = t.contour.withColumn("m", G.measures("contour"))
    return d, G.Shape(F.col("m"))


@query("g1_polygon_area", EDGES + "select splinter_key, round(abs(a)/2e0/64e0,6) as area from s")
def g1(t):
    d, s = shaped(t)
    return d.select("splinter_key", F.round(s.area(), 6).alias("area"))


@query("g2_perimeter", EDGES + "select splinter_key, round(peri/8e0,6) as closed, round(open_len/8e0,6) as open from s")
def g2(t):
    d, s = shaped(t)
    return d.select(
        "splinter_key", F.round(s.perimeter / 8.0, 6).alias("closed"), F.round(s.open_length / 8.0, 6).alias("open")
    )


@query(
    "g3_centroid",
    EDGES + "select splinter_key, cast(trunc(cx) as int) as px, cast(trunc(cy) as int) as py, round(cx,6) as cx, round(cy,6) as cy from s",
)
def g3(t):
    d, s = shaped(t)
    (x, y), (px, py) = s.centroid, s.centroid_px
    return d.select("splinter_key", px.alias("px"), py.alias("py"), F.round(x, 6).alias("cx"), F.round(y, 6).alias("cy"))


# a symmetric contour has no direction: its angle is rounding noise
DIRECTED = "abs(mu11) > 1e-3*(mu20+mu02) or abs(mu20-mu02) > 1e-3*(mu20+mu02)"


@query(
    "g4_orientation",
    EDGES + f"select splinter_key, case when {DIRECTED} then round(deg,5) end as deg, case when {DIRECTED} then round(cos(radians(deg)),6) end as ux from s",
)
def g4(t):
    d, s = shaped(t)
    mu20, mu02, mu11 = s.central
    clear = (F.abs(mu11) > 1e-3 * (mu20 + mu02)) | (F.abs(mu20 - mu02) > 1e-3 * (mu20 + mu02))
    return d.select(
        "splinter_key",
        F.when(clear, F.round(s.orientation_deg, 5)).alias("deg"),
        F.when(clear, F.round(s.axis[0], 6)).alias("ux"),
    )


@query("g5_roundness", EDGES + "select splinter_key, round(abs(a)/2e0/(peri*peri/(4e0*pi())),8) as roundness from s")
def g5(t):
    d, s = shaped(t)
    return d.select("splinter_key", F.round(G.roundness(s.area_px, s.perimeter), 8).alias("roundness"))


POINTS = "pt as (select distinct splinter_key, px, py from contour_point)"
HULL = f"""with {POINTS},
side as (select a.splinter_key, a.px as ax, a.py as ay, b.px as bx, b.py as by_, bool_and((b.px-a.px)*(c.py-a.py)-(b.py-a.py)*(c.px-a.px) > 0 or
  ((b.px-a.px)*(c.py-a.py)-(b.py-a.py)*(c.px-a.px) = 0 and (c.px-a.px)*(b.px-a.px)+(c.py-a.py)*(b.py-a.py) >= 0 and (c.px-b.px)*(a.px-b.px)+(c.py-b.py)*(a.py-b.py) >= 0)) as hull
 from pt a join pt b on a.splinter_key=b.splinter_key and (a.px<>b.px or a.py<>b.py) join pt c on c.splinter_key=a.splinter_key group by 1,2,3,4,5)
"""


@query("g6_hull_perimeter", HULL + "select splinter_key, round(sum(sqrt(cast((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay) as double))),6) as hull from side where hull group by 1")
def g6(t):
    return t.contour.select("splinter_key", F.round(G.hull_columns()["hull"], 6).alias("hull"))


@query(
    "g7_smallest_box",
    f"""with {POINTS}, dir as (select a.splinter_key, a.px as ax, a.py as ay, (b.px-a.px)/sqrt(cast((b.px-a.px)*(b.px-a.px)+(b.py-a.py)*(b.py-a.py) as double)) as ux, (b.py-a.py)/sqrt(cast((b.px-a.px)*(b.px-a.px)+(b.py-a.py)*(b.py-a.py) as double)) as uy
 from pt a join pt b on a.splinter_key=b.splinter_key and (a.px<b.px or (a.px=b.px and a.py<b.py))),
ext as (select d.splinter_key, ux, uy, (max(ux*c.px+uy*c.py)-min(ux*c.px+uy*c.py))*(max(-uy*c.px+ux*c.py)-min(-uy*c.px+ux*c.py)) as size from dir d join pt c on c.splinter_key=d.splinter_key group by 1,2,3)
select splinter_key, round(min(size),4) as box_area from ext group by 1""",
)
def g7(t):
    d = t.contour.select("splinter_key", G.hull_columns().alias("h"))
    return d.select("splinter_key", F.round(F.col("h.la") * F.col("h.lb"), 4).alias("box_area"))


def prepared(t):
    return t.contour.join(t.specimen.select("specimen_id", "ip_x", "ip_y"), "specimen_id")


@query("g8_aspect_ratio")
def g8(t):
    d = P.with_properties(prepared(t), ["asp0", "asp", "l1", "l2"])
    return d.select("splinter_key", "asp0", "asp", "l1", "l2", (F.col("asp0") - 1).alias("lengthiness"))


AXES = """, l as (select *, sqrt(4e0*mu11*mu11+(mu20-mu02)*(mu20-mu02)) as sp from s)"""


@query(
    "g9_ellipse_axes",
    EDGES + AXES + """ select splinter_key, round(4e0*sqrt(greatest(0e0,(mu20+mu02+sp)/2e0/(abs(a)/2e0))),5) as major, round(4e0*sqrt(greatest(0e0,(mu20+mu02-sp)/2e0/(abs(a)/2e0))),5) as minor from l""",
)
def g9(t):
    d, s = shaped(t)
    major, minor = s.axis_lengths
    return d.select("splinter_key", F.round(major, 5).alias("major"), F.round(minor, 5).alias("minor"))


@query(
    "g10_orientation_to_impact",
    EDGES + f""" select s.splinter_key, case when {DIRECTED} then round(abs(((ip_x-x_mm)*cos(radians(deg))+(ip_y-y_mm)*sin(radians(deg)))/(sqrt((ip_x-x_mm)*(ip_x-x_mm)+(ip_y-y_mm)*(ip_y-y_mm))*sqrt(cos(radians(deg))*cos(radians(deg))+sin(radians(deg))*sin(radians(deg))))),6) end as orientation
 from s join splinter q using (splinter_key) join specimen p on p.specimen_id = q.specimen_id where x_mm <> ip_x or y_mm <> ip_y""",
)
def g10(t):
    d = prepared(t).filter("x_mm <> ip_x or y_mm <> ip_y").withColumn("m", G.measures("contour"))
    s = G.Shape(F.col("m"))
    mu20, mu02, mu11 = s.central
    clear = (F.abs(mu11) > 1e-3 * (mu20 + mu02)) | (F.abs(mu20 - mu02) > 1e-3 * (mu20 + mu02))
    value = G.alignment(F.col("ip_x") - F.col("x_mm"), F.col("ip_y") - F.col("y_mm"), *s.axis)
    return d.select("splinter_key", F.when(clear, F.round(value, 6)).alias("orientation"))


@query("g11_impact_dependency")
def g11(t):
    return P.with_properties(prepared(t), ["impact_dependency"]).select("splinter_key", "impact_dependency")


@query(
    "g12_impact_angle",
    "select splinter_key, round(degrees(atan2(y_mm-ip_y, x_mm-ip_x)),6) as angle from splinter join specimen using (specimen_id)",
)
def g12(t):
    d = P.with_properties(prepared(t), ["angle"])
    return d.select("splinter_key", F.round("angle", 6).alias("angle"))


@query("g13_all_properties")
def g13(t):
    return P.with_properties(prepared(t), P.NAMES).select("splinter_key", *P.NAMES)


@query(
    "g14_vector_functions",
    """with v as (select splinter_key, x_mm-ip_x as ax, y_mm-ip_y as ay, 250e0-x_mm as bx, 240e0-y_mm as by_ from splinter join specimen using (specimen_id) where (x_mm<>ip_x or y_mm<>ip_y) and (x_mm<>250e0 or y_mm<>240e0)),
c as (select *, (ax*bx+ay*by_)/(sqrt(ax*ax+ay*ay)*sqrt(bx*bx+by_*by_)) as cs from v)
select splinter_key, round(atan2(ay,ax),6) as rad, round(cs,6) as cosine, round(abs(cs),6) as alignment, round(case when ax*by_-ay*bx < 0 then 2e0*pi()-acos(greatest(-1e0,least(1e0,cs))) else acos(greatest(-1e0,least(1e0,cs))) end,4) as signed from c""",
)
def g14(t):
    d = t.splinter.join(t.specimen, "specimen_id")
    d = d.filter("(x_mm<>ip_x or y_mm<>ip_y) and (x_mm<>250e0 or y_mm<>240e0)")
    v = (F.col("x_mm") - F.col("ip_x"), F.col("y_mm") - F.col("ip_y"), 250.0 - F.col("x_mm"), 240.0 - F.col("y_mm"))
    return d.select(
        "splinter_key",
        F.round(F.atan2(v[1], v[0]), 6).alias("rad"),
        F.round(G.cosine(*v), 6).alias("cosine"),
        F.round(G.alignment(*v), 6).alias("alignment"),
        F.round(G.signed_angle(*v), 4).alias("signed"),
    )


@query(
    "g15_ellipse_radius",
    "select splinter_key, round(area*circ/sqrt((circ*cos(x_mm/100e0))*(circ*cos(x_mm/100e0))+(area*sin(x_mm/100e0))*(area*sin(x_mm/100e0))),6) as radius from splinter",
)
def g15(t):
    radius = G.ellipse_radius(F.col("area"), F.col("circ"), F.col("x_mm") / 100.0)
    return t.splinter.select("splinter_key", F.round(radius, 6).alias("radius"))


@query("g16_simplified_contours")
def g16(t):
    d = t.contour.select("splinter_key", F.size("contour").alias("n"), G.simplify("contour", 0.02).alias("points"))
    return d.select("splinter_key", "n", F.size("points").alias("n_simplified"), F.to_json("points").alias("points"))
