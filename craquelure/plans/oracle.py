"""SQL text of the derived tables, prepended to a check query as CTEs."""

from __future__ import annotations

import re

VIEWS = {
    "specimen": """
select *, concat(cast(thickness as varchar),'.',cast(nom_stress as varchar),'.',boundary,'.',lpad(cast(nbr as varchar),2,'0')) as name,
 -(nom_stress + s_acctbal/1000e0) as sig_h, thickness - (specimen_id % 5)/20e0 as measured_thickness,
 case when break_pos='corner' then 50e0 else 250e0 end as ip_x, case when break_pos='corner' then 50e0 else 250e0 end as ip_y, 500e0 as w_mm, 500e0 as h_mm, 0.07e0 as fall_height_m
 from (select s_suppkey as specimen_id, s_acctbal, case s_suppkey % 3 when 0 then 4 when 1 then 8 else 12 end as thickness, 40+10*(s_suppkey % 11) as nom_stress,
 case cast(floor(s_suppkey/3e0) as int) % 3 when 0 then 'A' when 1 then 'B' else 'Z' end as boundary, s_suppkey % 20 + 1 as nbr,
 case when s_suppkey % 5 = 0 then 'center' else 'corner' end as break_pos, case when s_suppkey % 4 = 0 then 'drill' else 'punch' end as break_mode,
 s_suppkey % 7 <> 0 as has_scalp, s_suppkey % 13 <> 12 as has_splinters from supplier) q""",
    "splinter": """
select l_suppkey as specimen_id, concat_ws('-',cast(l_orderkey as varchar),cast(l_partkey as varchar),cast(l_suppkey as varchar),cast(l_linenumber as varchar)) as splinter_key,
 cast((l_partkey*7919 + l_linenumber*104729 + l_orderkey*31) % 5000 as double)/10e0 as x_mm, cast((l_orderkey*6271 + l_partkey*13 + l_linenumber*7) % 5000 as double)/10e0 as y_mm,
 l_quantity as area, 2e0*sqrt(pi()*l_quantity)*(1e0+l_discount) as circ, case when l_linestatus='O' then 'sim' else 'real' end as source, cast(l_quantity as int) as q, l_partkey from lineitem""",
    "contour_point": """
select specimen_id, splinter_key, k, cast(floor(x_mm*8e0) as int) + dx*q + cast((l_partkey+k) % 3 as int) as px, cast(floor(y_mm*8e0) as int) + dy*q as py
 from splinter cross join (values (0,8,0),(1,6,6),(2,0,8),(3,-6,6),(4,-8,0),(5,-6,-6),(6,0,-8),(7,6,-6)) as o(k,dx,dy)""",
    "channel": """
select *, row_number() over (partition by specimen_id, channel order by t, event_id) - 1 as seq from (select event_id, user_id % (select count(*) from supplier) as specimen_id, event_type as channel, epoch_us(ts)/1e6 as t, value from events) q""",
    "scalp_measurement": """
select o_custkey % (select count(*) from supplier) as specimen_id, case o_orderkey % 3 when 0 then 'ul' when 1 then 'm' else 'or' end as location, case cast(floor(o_orderkey/3e0) as bigint) % 3 when 0 then 'X' when 1 then 'Xy' else 'Y' end as orientation, o_orderkey as ord, -(40e0 + o_orderkey % 97) - o_totalprice/1e6 as stress0 from orders""",
    "crack_tip": """
select user_id as crack_id, row_number() over (partition by user_id order by ts, event_id) as frame, value % 40e0 as x_mm, cast(event_id % 250 as double)/10e0 as y_mm from events""",
    "pixel": """
select vec_id as y, x, least(255,greatest(0,cast(floor((cast(e as double)+1e0)*127e0) as int))) as gray from (select vec_id, unnest(range(0,len(embedding))) as x, unnest(embedding) as e from embeddings)""",
    # splinters that survive the default edge and impact exclusions
    "kept": """
select s.*, p.ip_x, p.ip_y, p.w_mm, p.h_mm, p.thickness, p.boundary, p.measured_thickness, p.sig_h, p.name, p.nom_stress, p.break_pos
 from splinter s join specimen p using (specimen_id)
 where x_mm > 10e0 and x_mm < w_mm-10e0 and y_mm > 10e0 and y_mm < h_mm-10e0
 and sqrt((x_mm-ip_x)*(x_mm-ip_x)+(y_mm-ip_y)*(y_mm-ip_y)) > 20e0""",
}

NEEDS = {"contour_point": ("splinter",), "kept": ("splinter", "specimen")}


def with_views(sql: str) -> str:
    used: list[str] = []

    def add(name: str):
        for parent in NEEDS.get(name, ()):
            add(parent)
        if name not in used:
            used.append(name)

    for name in VIEWS:
        if re.search(rf"\b(from|join)\s+{name}\b", sql, re.I):
            add(name)
    if not used:
        return sql.strip()
    ctes = ",\n".join(f"{n} as materialized ({VIEWS[n].strip()})" for n in used)
    body = sql.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {ctes},\n{body[15:]}"
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"
