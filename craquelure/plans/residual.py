"""Residual-stress queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from craquelure.operators import fits, scalp as R
from craquelure.plans.registry import query
from craquelure.sources import scalp as X

LOC = """l as (select specimen_id, location, arg_max(stress0, ord) filter (where lower(orientation)='x') as sx, arg_max(stress0, ord) filter (where lower(orientation)='y') as sy, arg_max(stress0, ord) filter (where lower(orientation)='xy') as sxy from scalp_measurement group by 1,2),
v as (select *, sx is not null and sy is not null and sxy is not null as valid, sxy-(sx+sy)/2e0 as tau from l),
p as (select *, case when valid and sx <> sy then 0.5e0*atan(2e0*tau/(sx-sy)) end as phi from v),
s as (select specimen_id, location, valid, sx, sy, sxy, (sx+sy)/2e0+((sx-sy)/2e0)*cos(2e0*phi)+tau*sin(2e0*phi) as sig_1, (sx+sy)/2e0+((sx-sy)/2e0)*cos(2e0*(phi+pi()/2e0))+tau*sin(2e0*(phi+pi()/2e0)) as sig_2 from p)"""


@query(
    "a32_location_validity",
    f"with {LOC} select specimen_id, location, valid, round(sx,6) as s_x, round(sy,6) as s_y, round(sxy,6) as s_xy from s",
)
def a32(t):
    d = R.locations(t.scalp_measurement)
    return d.select("specimen_id", "location", "valid", *[F.round(c, 6).alias(c) for c in ("s_x", "s_y", "s_xy")])


@query("m9_principal_stress", f"with {LOC} select specimen_id, location, round(sig_1,6) as sig_1, round(sig_2,6) as sig_2 from s")
def m9(t):
    d = R.locations(t.scalp_measurement)
    return d.select("specimen_id", "location", F.round("sig_1", 6).alias("sig_1"), F.round("sig_2", 6).alias("sig_2"))


STRESS = f"{LOC}, u as (select specimen_id, valid, sig_1 as s from s union all select specimen_id, valid, sig_2 from s)"


@query(
    "a31_specimen_stress",
    f"with {STRESS} select specimen_id, round(avg(s) filter (where valid),6) as sig_h, round(stddev_pop(s) filter (where valid),5) as deviation, count(*)//2 as n_points, count(s) filter (where valid) = 0 as invalid from u group by 1",
)
def a31(t):
    d = R.specimen_stress(R.locations(t.scalp_measurement))
    return d.select("specimen_id", F.round("sig_h", 6).alias("sig_h"), F.round("deviation", 5).alias("deviation"), "n_points", "invalid")


@query("u2_both_stresses", f"with {STRESS} select specimen_id, round(s,6) as s from u where valid")
def u2(t):
    d = R.locations(t.scalp_measurement).filter("valid")
    return d.select("specimen_id", F.explode(F.array(F.round("sig_1", 6), F.round("sig_2", 6))).alias("s"))


M10 = """with m as (select specimen_id, location, orientation, cast(ord % 50 as double)/10e0 as x, stress0 as y from scalp_measurement),
c as (select *, x - avg(x) over (partition by specimen_id, location, orientation) as z from m),
s as (select specimen_id, location, lower(orientation) as o, count(*) as n, sum(z*z) as s2, sum(z*z*z) as s3, sum(z*z*z*z) as s4, sum(y) as sy, sum(z*y) as szy, sum(z*z*y) as szzy from c group by 1,2,3),
f as (select specimen_id, location, o, (szzy-s3*szy/s2-s2*sy/n)/nullif(s4-s3*s3/s2-s2*s2/n,0) as a from s where s2 > 0),
g as (select specimen_id, location, max(2e0*a/(3e0*cos(radians(70e0))*cos(radians(70e0)))) filter (where o='x') as sx, max(2e0*a/(3e0*cos(radians(70e0))*cos(radians(70e0)))) filter (where o='y') as sy, max(2e0*a/(3e0*cos(radians(70e0))*cos(radians(70e0)))) filter (where o='xy') as sxy from f group by 1,2),
p as (select *, sxy-(sy-sx)/2e0 as tau, 0.5e0*atan(2e0*(sxy-(sy-sx)/2e0)/nullif(sx-sy,0)) as phi from g)
select specimen_id, location, round((sx+sy)/2e0+((sx-sy)/2e0)*cos(2e0*phi)+tau*sin(2e0*phi),4) as sig_1, round((sx+sy)/2e0+((sx-sy)/2e0)*cos(2e0*(phi+pi()/2e0))+tau*sin(2e0*(phi+pi()/2e0)),4) as sig_2 from p"""


@query("m10_retardation_stress", M10)
def m10(t):
    d = t.scalp_measurement.selectExpr("specimen_id", "location", "orientation", "cast(ord % 50 as double)/10e0 as x", "stress0 as y")
    f = fits.polynomial(d, ["specimen_id", "location", "orientation"], "x", "y", 2)
    d = R.retardation_stress(f, ["specimen_id", "location"], 3.0, math.radians(70.0))
    return d.select("specimen_id", "location", F.round("sig_1", 4).alias("sig_1"), F.round("sig_2", 4).alias("sig_2"))


NAME = "concat('8.70.A.', case when vec_id < 10 then lpad(cast(vec_id as varchar),2,'0') else cast(vec_id as varchar) end)"


def xml_rows(t):
    """One Measurement text per embedding row: names, directions and float32 curves."""
    d = t.base("embeddings").withColumn("depth", X.encoded(F.col("embedding")))
    text = F.concat(
        F.lit('<Measurement><Specimen Name="8.70.A.'),
        F.col("vec_id").cast("string"),
        F.lit('" Note="m" Direction="'),
        F.when(F.col("vec_id") % 2 == 0, "X").otherwise("Y"),
        F.lit('-axis" GlassThickness="7.9"/><StressDistribution><Depth>'),
        F.col("depth"),
        F.lit("</Depth><Stress>"),
        F.col("depth"),
        F.lit("</Stress><Active>"),
        F.base64(F.unhex(F.repeat(F.lit("01"), F.size("embedding")))),
        F.lit("</Active><Fit>"),
        F.base64(F.unhex(F.repeat(F.lit("FF"), F.size("embedding")))),
        F.lit('</Fit></StressDistribution><StressValues><Surface Col1="'),
        F.col("vec_id").cast("string"),
        F.lit('" Col2="0.5"/></StressValues></Measurement>'),
    )
    return d.select(text.alias("xml"))


@query(
    "s7_project_ingest",
    f"""select {NAME} as specimen, case when vec_id % 2 = 0 then 'X' else 'Y' end as orientation, i, round(cast(e as double),6) as stress, cast(vec_id as double) as surface
from (select vec_id, unnest(range(0,len(embedding))) as i, unnest(embedding) as e from embeddings)""",
)
def s7(t):
    d = X.parse_measurements(xml_rows(t), "xml")
    d = d.select("specimen", "orientation", F.get("stress_values", F.lit(0))["value"].alias("surface"), F.posexplode("stress").alias("i", "e"))
    return d.select("specimen", "orientation", "i", F.round(F.col("e").cast("double"), 6).alias("stress"), "surface")


@query(
    "s9_depth_rows",
    f"""select {NAME} as specimen, case when vec_id % 2 = 0 then 'X' else 'Y' end as orientation, i, round(cast(e as double),6) as depth, round(cast(e as double),6) as stress, true as active, -1 as fit
from (select vec_id, unnest(range(0,len(embedding))) as i, unnest(embedding) as e from embeddings)""",
)
def s9(t):
    d = X.depth_rows(X.parse_measurements(xml_rows(t), "xml"))
    number = lambda c: F.round(F.col(c).cast("double"), 6).alias(c)
    return d.select("specimen", "orientation", "i", number("depth"), number("stress"), "active", "fit")
