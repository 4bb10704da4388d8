"""Catalog queries: scans, name filters, settings, scalar mechanics, sorts and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from craquelure.functions import mechanics as M
from craquelure.functions import names as N
from craquelure.operators import catalog as C
from craquelure.plans.registry import query

R6 = "round({}, 6)"
UD = "1e6/5e0*(1e0-0.23e0)/70e3*sig_h*sig_h"
U = f"({UD}*measured_thickness*1e-3)"


def with_energy(specimen):
    return specimen.withColumn("u", M.energy(F.col("sig_h"), F.col("measured_thickness"))).withColumn(
        "u_d", M.energy_density(F.col("sig_h"))
    )


@query(
    "s1_catalog_scan",
    "select specimen_id, name, thickness, round(sig_h,6) as sig_h from specimen where has_splinters and has_scalp order by sig_h, specimen_id",
)
def s1(t):
    decider = C.specimen_predicate()
    d = C.scan(t.specimen, decider, None, ["sig_h", "specimen_id"])
    return d.select("specimen_id", "name", "thickness", F.round("sig_h", 6).alias("sig_h"))


@query("s2_names_prefix", r"select specimen_id, name from specimen where regexp_matches(name, '^(?:8\.1)')")
def s2a(t):
    return C.by_names(t.specimen, r"8\.1").select("specimen_id", "name")


@query("s2_names_search", r"select specimen_id, name from specimen where regexp_matches(name, 'B\.1')")
def s2b(t):
    return C.by_names(t.specimen, [r"B\.1"]).select("specimen_id", "name")


@query("s2_names_list", "select specimen_id, name from specimen where name in ('12.50.A.02','4.70.B.04','8.80.B.05')")
def s2c(t):
    return C.by_names(t.specimen, ["12.50.A.02", "4.70.B.04", "8.80.B.05"]).select("specimen_id", "name")


SETTINGS_JSON = (
    "concat('{\"break_mode\":\"', break_mode, '\"',"
    " case when specimen_id % 2 = 0 then concat(',\"fall_height_m\":0.', cast(specimen_id % 9 + 1 as {S})) else '' end,"
    " case when specimen_id % 3 = 0 then concat(',\"actual_break_pos\":[', cast(specimen_id % 450 as {S}), ',25]') else '' end,"
    " case when specimen_id % 5 = 0 then concat(',\"break_pos\":\"', break_pos, '\"') else '' end, ',\"unknown_key\":1}}')"
)


def raw_settings(t):
    text = SETTINGS_JSON.replace("{S}", "string").replace("}}", "}")
    return t.specimen.select("specimen_id", F.expr(text).alias("settings"))


S3_SQL = """
with raw as (select specimen_id, cast({json} as json) as j from specimen)
select specimen_id, coalesce(j->>'break_mode','punch') as break_mode, coalesce(j->>'break_pos','corner') as break_pos,
 coalesce(cast(j->>'fall_height_m' as double), 0.07e0) as fall_height_m, cast(j->'actual_break_pos'->>0 as double) as actual_x,
 20e0 as custom_break_pos_exclusion_radius, 10e0 as custom_edge_exclusion_distance, 1 as fall_repeat, 100e0 as excluded_positions_radius, false as exclude_all_sensors
from raw""".replace("{json}", SETTINGS_JSON.replace("{S}", "varchar").replace("}}", "}"))


@query("s3_settings_read", S3_SQL)
def s3(t):
    return C.settings(raw_settings(t), "settings").select(
        "specimen_id",
        "break_mode",
        "break_pos",
        "fall_height_m",
        F.get("actual_break_pos", F.lit(0)).alias("actual_x"),
        "custom_break_pos_exclusion_radius",
        "custom_edge_exclusion_distance",
        "fall_repeat",
        "excluded_positions_radius",
        "exclude_all_sensors",
    )


@query(
    "s4_settings_upsert",
    """select specimen_id, case when thickness=8 then 0.14e0 else fall_height_m end as fall_height_m,
 case when thickness=8 then 2 else 1 end as fall_repeat from specimen""",
)
def s4(t):
    current = t.specimen.select("specimen_id", "fall_height_m", F.lit(1).alias("fall_repeat"))
    changes = t.specimen.filter("thickness = 8").select(
        "specimen_id", F.lit(0.14).alias("fall_height_m"), F.lit(2).alias("fall_repeat")
    )
    return C.upsert(current, changes, ["specimen_id"])


@query(
    "s8_measurement_names",
    """with m as (select specimen_id, concat(cast(thickness as varchar),'.',cast(nom_stress as varchar),'.',boundary,'.',cast(nbr as varchar), case when specimen_id % 4 = 0 then '-x' else '' end) as raw, name from specimen)
select specimen_id, raw, concat(name, case when specimen_id % 4 = 0 then '-x' else '' end) as name from m""",
)
def s8(t):
    raw = F.concat_ws(
        ".", F.col("thickness").cast("string"), F.col("nom_stress").cast("string"), "boundary", F.col("nbr").cast("string")
    )
    raw = F.concat(raw, F.when(F.col("specimen_id") % 4 == 0, "-x").otherwise(""))
    return t.specimen.select("specimen_id", raw.alias("raw")).withColumn("name", N.normalised_name(F.col("raw")))


@query(
    "s12_fall_height_import",
    """with f as (select s_suppkey as specimen_id, floor(s_acctbal)/100e0 as h from supplier where s_suppkey % 3 <> 1)
select specimen_id, case when h is not null and h <> fall_height_m then h else fall_height_m end as fall_height_m, coalesce(h <> fall_height_m, false) as changed
from specimen left join f using (specimen_id)""",
)
def s12(t):
    heights = t.base("supplier").filter("s_suppkey % 3 <> 1").selectExpr(
        "s_suppkey as specimen_id", "floor(s_acctbal) as height_cm"
    )
    current = t.specimen.select("specimen_id", "fall_height_m")
    changed = (
        heights.join(current, "specimen_id")
        .withColumn("new", F.col("height_cm") / F.lit(100.0))
        .filter("new <> fall_height_m")
        .selectExpr("specimen_id", "new as fall_height_m", "true as changed")
    )
    return C.upsert(current.withColumn("changed", F.lit(False)), changed, ["specimen_id"])


@query(
    "s16_folder_summary",
    """select name, split_part(name,'.',1) as thickness, split_part(name,'.',2) as stress, split_part(name,'.',3) as boundary, split_part(name,'.',4) as nbr
from specimen""",
)
def s16(t):
    parts = F.split("name", "\\.")
    return t.specimen.filter(F.size(parts) >= 4).select(
        "name", *[parts.getItem(i).alias(n) for i, n in enumerate(("thickness", "stress", "boundary", "nbr"))]
    )


@query(
    "s17_result_sheet",
    """with sheet as (select c_custkey as row_id, case c_custkey % 3 when 0 then 4 when 1 then 8 else 12 end as thickness, 40+10*(c_custkey % 11) as nom_stress,
 case cast(floor(c_custkey/3e0) as int) % 3 when 0 then 'A' when 1 then 'B' else 'Z' end as boundary, c_custkey % 20 + 1 as nbr from customer),
first as (select thickness, nom_stress, boundary, nbr, arg_min(sig_h, specimen_id) as sig_h, arg_min(has_splinters, specimen_id) as hs from specimen group by all)
select row_id, round(sig_h,6) as sig_h, case when hs then 'destroyed' end as state from sheet left join first using (thickness, nom_stress, boundary, nbr)""",
)
def s17(t):
    sheet = t.base("customer").selectExpr(
        "c_custkey as row_id",
        "case c_custkey % 3 when 0 then 4 when 1 then 8 else 12 end as thickness",
        "40 + 10*(c_custkey % 11) as nom_stress",
        "case cast(floor(c_custkey/3e0) as int) % 3 when 0 then 'A' when 1 then 'B' else 'Z' end as boundary",
        "c_custkey % 20 + 1 as nbr",
    )
    keys = ["thickness", "nom_stress", "boundary", "nbr"]
    measured = C.first_per_key(t.specimen.select(*keys, "specimen_id", "sig_h", "has_splinters"), keys, ["specimen_id"])
    return sheet.join(measured, keys, "left").select(
        "row_id", F.round("sig_h", 6).alias("sig_h"), F.when(F.col("has_splinters"), "destroyed").alias("state")
    )


# ---- filters ---------------------------------------------------------------------------


@query("f1_wildcard", r"select specimen_id, name from specimen where regexp_matches(name, '^(?:.*\.[5-8]0\..*\.1.*)')")
def f1(t):
    return t.specimen.filter(N.name_filter(F.col("name"), "*.[5-8]0.*.1*")).select("specimen_id", "name")


@query("f1_list", "select specimen_id, name from specimen where name in ('4.60.A.03','12.50.A.02')")
def f1b(t):
    return t.specimen.filter(N.name_filter(F.col("name"), "4.60.A.03,12.50.A.02")).select("specimen_id", "name")


@query("f2_part_pattern", r"select specimen_id, name from specimen where regexp_matches(name, '^(?:(4|8)\..*\.(A|Z)\..*)')")
def f2(t):
    return t.specimen.filter(N.name_filter(F.col("name"), "4:8.*.A:Z")).select("specimen_id", "name")


@query(
    "f3_specimen_predicate",
    rf"""select specimen_id, name from specimen where not regexp_matches(name,'^(?:8\.40)') and regexp_matches(name,'^(?:.*\..*\..*\..*)')
 and has_scalp and has_splinters and abs({U} - 100e0) < 0.05e0*100e0*10e0""".replace("0.05e0*100e0*10e0", "0.05e0*100e0"),
)
def f3(t):
    keep = C.specimen_predicate(name="*.*.*.*", exclude=r"8\.40", energy=100.0)
    return with_energy(t.specimen).filter(keep).select("specimen_id", "name")


@query(
    "f3_scans_branch",
    "select specimen_id, name from specimen where has_scalp and has_splinters and specimen_id % 9 <> 4",
)
def f3_scans(t):
    """Neither a stress range nor an energy is given, so the scans are asked for."""
    d = t.specimen.withColumn("has_scans", F.col("specimen_id") % 9 != 4)
    return d.filter(C.specimen_predicate(needs_scans=True)).select("specimen_id", "name")


@query(
    "f3_range_before_energy",
    "select specimen_id, name from specimen where has_scalp and has_splinters and abs(sig_h) between 70e0 and 90e0",
)
def f3_order(t):
    """With a stress range neither energy nor scans are looked at."""
    d = with_energy(t.specimen).withColumn("has_scans", F.lit(False))
    keep = C.specimen_predicate(sigmas="80", delta=10, energy=1.0, needs_scans=True)
    return d.filter(keep).select("specimen_id", "name")


@query(
    "f4_stress_range",
    "select specimen_id, name from specimen where has_scalp and has_splinters and abs(sig_h) between 70e0 and 90e0",
)
def f4(t):
    return t.specimen.filter(C.specimen_predicate(sigmas="80", delta=10)).select("specimen_id", "name")


@query(
    "f5_name_and_stress",
    r"select specimen_id, name from specimen where regexp_matches(name,'^(?:(4|12)\..*\..*\..*)') and has_scalp and has_splinters and abs(sig_h) between 60e0 and 100e0",
)
def f5(t):
    return t.specimen.filter(C.specimen_predicate(name="4:12.*.*.*", sigmas="60-100")).select("specimen_id", "name")


@query(
    "f6_layer_input",
    rf"""select specimen_id, name from specimen where not regexp_matches(name,'^(?:12\.40)') and break_pos='corner' and break_mode='punch' and boundary in ('A','B','Z')
 and has_splinters and not isnan({UD}) and thickness in (4,8) and name not in ('8.80.B.05') and has_scalp""",
)
def f6(t):
    from craquelure.operators.layers import layer_input

    return layer_input(
        with_energy(t.specimen),
        break_pos="corner",
        break_mode="punch",
        exclude=r"12\.40",
        thicknesses=[4, 8],
        excluded_names=["8.80.B.05"],
    ).select("specimen_id", "name")


@query(
    "f7_energy_band",
    f"select specimen_id, name from specimen where {U} > 60e0*(1e0-0.25e0) and {U} < 60e0*(1e0+0.25e0)",
)
def f7(t):
    from craquelure.operators.layers import energy_band

    return with_energy(t.specimen).filter(energy_band(F.col("u"), 60.0, 0.25)).select("specimen_id", "name")


@query("f8_free_expression", "select specimen_id, name from specimen where abs(sig_h) > 60e0 and thickness = 8 or boundary = 'Z'")
def f8(t):
    return t.specimen.filter(F.expr("abs(sig_h) > 60e0 and thickness = 8 or boundary = 'Z'")).select("specimen_id", "name")


@query(
    "f9_settings_listing",
    "select specimen_id, name, break_mode as value from specimen where break_mode = 'drill'",
)
def f9(t):
    d = C.settings(raw_settings(t), "settings").filter(F.col("break_mode") == "drill")
    return d.join(t.specimen.select("specimen_id", "name"), "specimen_id").selectExpr(
        "specimen_id", "name", "break_mode as value"
    )


@query(
    "f22_names_from_paths",
    r"""with p as (select specimen_id, concat('/data/scans/', name, '/', substr(cast(10000+specimen_id as varchar),2), ' [Aniso] [', break_mode, '].bmp') as path, name, break_mode from specimen)
select path, name, substr(cast(10000+specimen_id as varchar),2) as scan, break_mode as kind from p""",
)
def f22(t):
    path = F.concat(
        F.lit("/data/scans/"),
        "name",
        F.lit("/"),
        F.expr("substr(cast(10000+specimen_id as string),2)"),
        F.lit(" [Aniso] ["),
        "break_mode",
        F.lit("].bmp"),
    )
    d = t.specimen.select(path.alias("path"))
    p = F.col("path")
    return d.select("path", N.name_from_path(p).alias("name"), N.scan_id(p).alias("scan"), N.scan_type(p).alias("kind"))


@query(
    "s1_name_parts",
    "select specimen_id, thickness, nom_stress, boundary, nbr, '' as comment from specimen",
)
def name_parts(t):
    return t.specimen.select("specimen_id", *[c.alias(n) for n, c in N.name_parts(F.col("name")).items()])


# ---- sorts, limits, sets ----------------------------------------------------------------


@query("t1_sort_columns", "select specimen_id, name, round(sig_h,6) as sig_h from specimen order by sig_h desc")
def t1(t):
    return t.specimen.select("specimen_id", "name", F.round("sig_h", 6).alias("sig_h")).orderBy(F.desc("sig_h"), "specimen_id")


@query("t2_sort_by_energy", f"select specimen_id, round({U},6) as u from specimen order by 2, 1")
def t2(t):
    return with_energy(t.specimen).select("specimen_id", F.round("u", 6).alias("u")).orderBy("u", "specimen_id")


@query("t3_sort_four_keys", "select thickness, nom_stress, boundary, nbr, specimen_id from specimen order by 1,2,3,4,5")
def t3(t):
    keys = ["thickness", "nom_stress", "boundary", "nbr", "specimen_id"]
    return t.specimen.select(*keys).orderBy(*keys)


@query("t4_capped_scan", "select specimen_id, name from specimen order by name, specimen_id limit 50")
def t4(t):
    return C.scan(t.specimen, max_n=50).select("specimen_id", "name")


@query(
    "t6_distinct_by_name",
    """with u as (select name, specimen_id, sig_h, has_scalp from specimen union all select name, specimen_id + 1000000 as specimen_id, sig_h, has_scalp from specimen where thickness = 8)
select name, min(specimen_id) as specimen_id, round(arg_min(sig_h, specimen_id),6) as sig_h from u where has_scalp group by name""",
)
def t6(t):
    cols = ["name", "specimen_id", "sig_h", "has_scalp"]
    first = t.specimen.select(*cols)
    second = t.specimen.filter("thickness = 8").withColumn("specimen_id", F.col("specimen_id") + 1000000).select(*cols)
    d = C.distinct_valid([first, second], ["name"], ["specimen_id"], F.col("has_scalp"))
    return d.select("name", "specimen_id", F.round("sig_h", 6).alias("sig_h"))


@query(
    "t7_group_sorted",
    "select boundary, thickness, count(*) as n, round(avg(sig_h),6) as mean_stress from specimen group by all",
)
def t7(t):
    return t.specimen.groupBy("boundary", "thickness").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("sig_h"), 6).alias("mean_stress")
    )


@query(
    "t8_every_nth",
    "select specimen_id, name from (select *, row_number() over (order by specimen_id) - 1 as i from specimen) where i % 3 = 0",
)
def t8(t):
    return C.every_nth(t.specimen.select("specimen_id", "name"), ["specimen_id"], 3)


@query(
    "t9_seeded_sample",
    """with c as (select specimen_id, name from specimen where has_splinters order by md5('42-' || cast(specimen_id as varchar)), specimen_id limit 5)
select specimen_id, name, splinter_key, area, pick from (select c.specimen_id, name, splinter_key, area,
 row_number() over (partition by c.specimen_id order by md5('42-' || splinter_key), splinter_key) as pick from splinter s join c on c.specimen_id=s.specimen_id) where pick <= 5""",
)
def t9(t):
    """Five specimens and five splinters of each, by a seeded hash of their ids."""
    seeded = lambda c: F.md5(F.concat(F.lit("42-"), F.col(c).cast("string")))
    chosen = (
        t.specimen.filter("has_splinters")
        .select("specimen_id", "name")
        .orderBy(seeded("specimen_id"), "specimen_id")
        .limit(5)
    )
    from pyspark.sql import Window

    w = Window.partitionBy("specimen_id").orderBy(seeded("splinter_key"), "splinter_key")
    return (
        t.splinter.join(chosen, "specimen_id")
        .select("specimen_id", "name", "splinter_key", "area")
        .withColumn("pick", F.row_number().over(w))
        .filter("pick <= 5")
    )


@query(
    "u1_union_literature",
    """select 'own' as origin, thickness, round(abs(sig_h)/2e0,6) as sig_m from specimen where has_scalp
union all select 'literature', p_size % 3 * 4 + 4, round(p_retailprice/20e0,6) from part""",
)
def u1(t):
    own = t.specimen.filter("has_scalp").selectExpr("'own' as origin", "thickness", "round(abs(sig_h)/2e0,6) as sig_m")
    other = t.base("part").selectExpr("'literature' as origin", "p_size % 3 * 4 + 4 as thickness", "round(p_retailprice/20e0,6) as sig_m")
    return own.unionByName(other)


@query(
    "u3_unused_names",
    "select distinct name from specimen where not has_scalp except select name from specimen where has_scalp",
)
def u3(t):
    used = t.specimen.filter("has_scalp").select("name")
    return t.specimen.filter("not has_scalp").select("name").distinct().join(used, "name", "left_anti")


@query(
    "j13_parameter_grid",
    """select specimen_id, b as block, c as offset, round(measured_thickness*b + c,6) as threshold
from specimen cross join (values (11),(21),(31),(41),(51)) bl(b) cross join (values (-5),(0),(5)) of(c)""",
)
def j13(t):
    block = F.explode(F.array(*[F.lit(v) for v in (11, 21, 31, 41, 51)])).alias("block")
    d = t.specimen.select("specimen_id", "measured_thickness", block)
    d = d.withColumn("offset", F.explode(F.array(*[F.lit(v) for v in (-5, 0, 5)])))
    return d.select(
        "specimen_id", "block", "offset", F.round(F.col("measured_thickness") * F.col("block") + F.col("offset"), 6).alias("threshold")
    )


@query(
    "j14_free_labels",
    """with p as (select t, s, b, n, concat(cast(t as varchar),'.',cast(s as varchar),'.',b,'.',lpad(cast(n as varchar),2,'0')) as name,
 row_number() over (order by ti, si, bi, n) - 1 as combination
 from (values (1,4),(2,8),(3,12)) a(ti,t), (values (1,50),(2,70),(3,100)) q(si,s), (values (1,'A'),(2,'B')) w(bi,b), (select unnest(range(1,21)) as n) l)
select name, combination from p where name not in (select name from specimen) order by combination limit 24""",
)
def j14(t):
    d = C.free_labels(t.spark, t.specimen, [4, 8, 12], [50, 70, 100], ["A", "B"], list(range(1, 21)))
    return d.select("name", "combination")


# ---- scalar mechanics --------------------------------------------------------------------


@query(
    "m1_strain_energy",
    f"select specimen_id, round({UD},4) as u_d, round({U},6) as u from specimen",
)
def m1(t):
    return with_energy(t.specimen).select("specimen_id", F.round("u_d", 4).alias("u_d"), F.round("u", 6).alias("u"))


@query(
    "m2_bending_and_inverse",
    f"""select specimen_id, round(1e6*6e0*(sig_h/2e0)*(sig_h/2e0)*(w_mm*1e-3)*(h_mm*1e-3)*(measured_thickness*1e-3)/70e3,6) as u_b,
 round(sqrt({UD}*5e0*70e3/((1e0-0.23e0)*1e6)),6) as sigma_ud, round(sqrt({U}*5e0*70e3/((1e0-0.23e0)*1e6*measured_thickness)),6) as sigma_u from specimen""",
)
def m2(t):
    d = with_energy(t.specimen)
    return d.select(
        "specimen_id",
        F.round(M.bending_energy(F.col("sig_h"), F.col("measured_thickness"), F.col("w_mm"), F.col("h_mm")), 6).alias("u_b"),
        F.round(M.stress_from_density(F.col("u_d")), 6).alias("sigma_ud"),
        F.round(M.stress_from_energy(F.col("u"), F.col("measured_thickness")), 6).alias("sigma_u"),
    )


@query(
    "m3_tensile_energy",
    "select specimen_id, round(1e6*(128e0/125e0)*(1e0-0.23e0)/70e3*sig_h*sig_h,3) as ud_t, round(1e6*(128e0/125e0)*(1e0-0.23e0)/70e3*sig_h*sig_h*measured_thickness*1e-3,5) as u_t from specimen",
)
def m3(t):
    ud = M.tensile_density(F.col("sig_h"))
    return t.specimen.select(
        "specimen_id",
        F.round(ud, 3).alias("ud_t"),
        F.round(ud * F.col("measured_thickness") * 1e-3, 5).alias("u_t"),
    )


@query(
    "m4_total_energy",
    f"select specimen_id, round({U}*w_mm*h_mm*1e-6,6) as u_t, round({U}*w_mm*h_mm*1e-6 + 2.41e0*9.81e0*fall_height_m,6) as u_t_fall from specimen",
)
def m4(t):
    total = M.total_energy(F.col("u"), F.col("w_mm"), F.col("h_mm"))
    return with_energy(t.specimen).select(
        "specimen_id",
        F.round(total, 6).alias("u_t"),
        F.round(total + M.fall_energy(F.col("fall_height_m")), 6).alias("u_t_fall"),
    )


@query(
    "m5_energy_comparison",
    f"""with e as (select specimen_id, {U}*w_mm*h_mm*1e-6 as a, 1e5*6e0*(sig_h/2e0)*(sig_h/2e0)*(w_mm*1e-3)*(h_mm*1e-3)*(measured_thickness*1e-3)/70e3 as b from specimen where has_scalp and has_splinters)
select specimen_id, round(a,6) as u_t, round(b,6) as u_t2, round(b/a*100e0,4) as percent from e""",
)
def m5(t):
    d = with_energy(t.specimen).filter("has_scalp and has_splinters")
    a = M.total_energy(F.col("u"), F.col("w_mm"), F.col("h_mm"))
    b = M.alternative_total_energy(F.col("sig_h"), F.col("measured_thickness"), F.col("w_mm"), F.col("h_mm"))
    return d.select(
        "specimen_id", F.round(a, 6).alias("u_t"), F.round(b, 6).alias("u_t2"), F.round(b / a * 100, 4).alias("percent")
    )


@query(
    "m7_runtimes",
    """select specimen_id, case when break_pos='center' then 250e0/5500e3 else 450e0/5500e3 end as t_p, case when break_pos='center' then 200e0/3500e3 else 400e0/3500e3 end as t_s,
 round(case when break_pos='center' then sqrt(125000e0)/1500e3 else sqrt(405000e0)/1500e3 end,12) as t_c from specimen""",
)
def m7(t):
    r = M.runtimes(F.col("break_pos"))
    return t.specimen.select("specimen_id", r["t_p"].alias("t_p"), r["t_s"].alias("t_s"), F.round(r["t_c"], 12).alias("t_c"))


@query(
    "m8_release_rate",
    """with c as (select l_orderkey, l_partkey, l_linenumber, l_suppkey, l_quantity*50e0 as v from lineitem),
 a as (select *, sqrt(1e0-v*v/(3300e0*3300e0)) as a_s, sqrt(1e0-v*v/(5500e0*5500e0)) as a_d from c)
select concat_ws('-',cast(l_orderkey as varchar),cast(l_partkey as varchar),cast(l_suppkey as varchar),cast(l_linenumber as varchar)) as splinter_key, v,
 round(1e3*(v*v*a_d)/(2e0*3300e0*3300e0*26e3*(4e0*a_s*a_d-(1e0+a_s*a_s)*(1e0+a_s*a_s)))*0.75e0*0.75e0,8) as g from a""",
)
def m8(t):
    d = t.splinter.select("splinter_key", (F.col("area") * 50.0).alias("v"))
    return d.select("splinter_key", "v", F.round(M.release_rate(F.col("v")), 8).alias("g"))


@query(
    "m11_n50_estimates",
    """select specimen_id, round(pow(abs(sig_h)/2e0/14.96e0,4e0),6) as n50_analytic,
 round(1281e0 + thickness*18.98e0 + abs(sig_h)*(-37.29e0) + pow(abs(sig_h),3e0)*(-0.0009638e0) + abs(sig_h)*abs(sig_h)*0.3504e0 + abs(sig_h)*thickness*(-0.2149e0),5) as n50_regression from specimen""",
)
def m11(t):
    s = F.abs("sig_h")
    return t.specimen.select(
        "specimen_id",
        F.round(M.n50_analytic(s), 6).alias("n50_analytic"),
        F.round(M.n50_regression(F.col("thickness"), s), 5).alias("n50_regression"),
    )


@query(
    "m13_scalar_helpers",
    """select specimen_id, floor(abs(sig_h)/10e0)*10e0 as stress_class, round(log10(abs(sig_h)),6) as log_stress, try_cast(split_part(name,'.',4) as double) as number, try_cast(boundary as double) as no_number from specimen""",
)
def m13(t):
    return t.specimen.select(
        "specimen_id",
        M.floor_to_10(F.abs("sig_h")).cast("double").alias("stress_class"),
        F.round(F.log10(F.abs("sig_h")), 6).alias("log_stress"),
        F.element_at(F.split("name", "\\."), 4).try_cast("double").alias("number"),
        F.col("boundary").try_cast("double").alias("no_number"),
    )


@query(
    "g17_pixel_scale",
    "select specimen_id, 4000e0/w_mm as px_per_mm, round(ip_x*4000e0/w_mm,6) as ip_x_px, round(ip_y*4000e0/w_mm,6) as ip_y_px from specimen",
)
def g17(t):
    scale = F.lit(4000.0) / F.col("w_mm")
    return t.specimen.select(
        "specimen_id",
        scale.alias("px_per_mm"),
        F.round(F.col("ip_x") * scale, 6).alias("ip_x_px"),
        F.round(F.col("ip_y") * scale, 6).alias("ip_y_px"),
    )


@query(
    "g18_impact_position",
    """select specimen_id, case when specimen_id % 3 = 0 then cast(specimen_id % 450 as double) when specimen_id % 5 = 0 then ip_x else 50e0 end as ip_x,
 case when specimen_id % 3 = 0 then 25e0 when specimen_id % 5 = 0 then ip_y else 50e0 end as ip_y from specimen""",
)
def g18(t):
    d = C.impact_position(C.settings(raw_settings(t), "settings"))
    return d.select("specimen_id", "ip_x", "ip_y")
