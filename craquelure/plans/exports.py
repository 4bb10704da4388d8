"""Report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from craquelure.functions import mechanics as M
from craquelure.operators import exports as E, fits, panes, scalp
from craquelure.plans.catalog import U, with_energy
from craquelure.plans.panes import norm_sql, sized
from craquelure.plans.registry import query
from craquelure.plans.residual import STRESS

NORM = norm_sql([(400, 400)])
NORM_CTES = NORM[5 : NORM.rindex("\nselect specimen_id")]
NORM_SELECT = NORM[NORM.rindex("select specimen_id") :]


def summary(t):
    stress = scalp.specimen_stress(scalp.locations(t.scalp_measurement))
    sizes = t.splinter.groupBy("specimen_id").agg(F.avg("area").alias("mean_size"))
    d = t.specimen.filter("has_scalp and has_splinters").drop("sig_h")
    return d.join(stress, "specimen_id").join(sizes, "specimen_id").join(panes.norm_count(sized(t)), "specimen_id")


@query(
    "s14_specimen_summary",
    f"""with {STRESS.split(', u as')[0]}, u as (select specimen_id, valid, sig_1 as sv from s union all select specimen_id, valid, sig_2 from s),
h as (select specimen_id, avg(sv) filter (where valid) as sig_h, stddev_pop(sv) filter (where valid) as dev from u group by 1), sz as (select specimen_id, avg(area) as mean_size from splinter group by 1)
select name, thickness, nom_stress, boundary, nbr, break_mode, break_pos, round(h.sig_h,5) as real_stress, round(h.dev,4) as deviation, round(mean_size,6) as mean_size,
 round(1281e0 + measured_thickness*18.98e0 + (-h.sig_h)*(-37.29e0) + (-h.sig_h)*(-h.sig_h)*(-h.sig_h)*(-0.0009638e0) + h.sig_h*h.sig_h*0.3504e0 + (-h.sig_h)*measured_thickness*(-0.2149e0),3) as published, specimen_id
 from specimen p join h using (specimen_id) join sz using (specimen_id) where has_scalp and has_splinters""",
)
def s14(t):
    d = summary(t)
    return d.select(
        "name", "thickness", "nom_stress", "boundary", "nbr", "break_mode", "break_pos",
        F.round("sig_h", 5).alias("real_stress"),
        F.round("deviation", 4).alias("deviation"),
        F.round("mean_size", 6).alias("mean_size"),
        F.round(M.n50_regression(F.col("measured_thickness"), -F.col("sig_h")), 3).alias("published"),
        "specimen_id",
    )


@query("s14_summary_with_fitted_model")
def s14b(t):
    """The summary with the counted N50 and the prediction of the model fitted to it."""
    d = summary(t).withColumn("s", -F.col("sig_h")).withColumn("_k", F.lit(1))
    terms = fits.n50_terms(F.col("measured_thickness"), F.col("s"))
    # a single row of coefficients, joined by a constant key
    model = fits.linear(d, ["_k"], terms, F.col("n50")).select("_k", "coef")
    return d.join(model, "_k").select("name", "specimen_id", "n50", fits.predict("coef", terms).alias("fitted"))


@query(
    "s15_appendix_table",
    f"""with {NORM_CTES}, nn as ({NORM_SELECT}), cs as (select specimen_id, sum(circ*measured_thickness) as surf from splinter join specimen using (specimen_id) group by 1)
select thickness, printf('%.0f', nom_stress*1e0) as stress, boundary, nbr, printf('%.2f', measured_thickness) as t_real, printf('%.0f', -sig_h) as stress_real, printf('%.0f', n50) as n50, printf('%.1f', {U}*0.25e0) as ut, printf('%.0f', {U}) as u, printf('%.0f', 1e6/5e0*(1e0-0.23e0)/70e3*sig_h*sig_h) as ud, printf('%.2f', surf*1e-6) as farea, specimen_id
 from specimen join nn using (specimen_id) left join cs using (specimen_id) where has_scalp and has_splinters and boundary in ('A','B','Z')""",
)
def s15(t):
    from craquelure.operators.panes import crack_surface_simple

    surface = crack_surface_simple(t.splinter.join(t.specimen.select("specimen_id", "measured_thickness"), "specimen_id"))
    d = with_energy(t.specimen).filter("has_splinters").join(panes.norm_count(sized(t)), "specimen_id", "left")
    d = d.join(surface.select("specimen_id", "crack_surface"), "specimen_id", "left")
    return E.appendix_table(d)


@query(
    "s20_simulation_records",
    f"select specimen_id, round({U},6) as energy, ip_x, ip_y, w_mm*h_mm as area, 0.23e0 as nue, name as reference, cast(thickness as double) as reference_thickness from specimen",
)
def s20(t):
    """Records written as JSON text and read back with their schema."""
    d = with_energy(t.specimen)
    record = F.struct(
        F.round("u", 6).alias("energy"),
        F.array("ip_x", "ip_y").alias("impact_position"),
        (F.col("w_mm") * F.col("h_mm")).alias("area"),
        F.array("w_mm", "h_mm").alias("size"),
        F.lit(0.23).alias("nue"),
        F.col("name").alias("reference"),
        F.col("thickness").cast("double").alias("reference_thickness"),
    )
    text = d.select("specimen_id", F.to_json(record).alias("json"))
    back = text.select("specimen_id", F.from_json("json", E.SIMULATION_SCHEMA).alias("r"))
    return back.select(
        "specimen_id", "r.energy", F.get("r.impact_position", F.lit(0)).alias("ip_x"), F.get("r.impact_position", F.lit(1)).alias("ip_y"),
        "r.area", "r.nue", "r.reference", "r.reference_thickness",
    )
