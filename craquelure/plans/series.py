"""Time-series queries on sensor channels, crack tracks and frames."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from craquelure.operators import brackets, exports, signals as S
from craquelure.plans.registry import query

K = ["specimen_id", "channel"]
DAY = 86400.0
# recordings of the test tables run over days with a few dozen samples: queries that need
# a sampling rate read the sample number as time at 50 kHz
RATE = "select specimen_id, channel, seq, seq*2e-5 as t, value from channel"


def sampled(t):
    return t.channel.select(*K, "seq", (F.col("seq") * 2e-5).alias("t"), "value")


def rounded(d, *cols, digits=6):
    keep = [c for c in d.columns if c not in cols]
    return d.select(*keep, *[F.round(c, digits).alias(c) for c in cols])


@query(
    "f19_channel_names",
    "with o as (select specimen_id, channel, min(event_id) as ordinal from channel group by 1,2) select specimen_id, arg_min(channel, ordinal) as channel from o where regexp_matches(channel, '^(?:[cv])') group by 1",
)
def f19(t):
    names = t.channel.groupBy(*K).agg(F.min("event_id").alias("ordinal"))
    return S.channels_like(names, "[cv]", first=True)


@query(
    "f20_sampling_guard",
    """with r as (select specimen_id, channel, case when max(t) > min(t) then (count(*)-1)/(max(t)-min(t)) end as hz from channel group by 1,2)
select specimen_id from r group by 1 having bool_or(starts_with(channel,'click')) and not coalesce(bool_or(channel like '%c%' and hz < 6e-6), false)""",
)
def f20(t):
    return S.acceptable(t.channel, "click", "c", 6e-6)


@query(
    "w2_slices",
    f"""with s as (select specimen_id, channel, seq, t - min(t) over (partition by specimen_id, channel) as t from channel)
select 'until' as part, specimen_id, channel, seq from s where t < {5*DAY}e0 union all select 'after', specimen_id, channel, seq from s where t > {20*DAY}e0 union all select 'between', specimen_id, channel, seq from s where t > {5*DAY}e0 and t < {20*DAY}e0""",
)
def w2(t):
    d = S.trigger_time(t.channel, 0.0)
    cols = [*K, "seq"]
    parts = [("until", S.until(d, 5 * DAY)), ("after", S.after(d, 20 * DAY)), ("between", S.between(d, 5 * DAY, 20 * DAY))]
    out = [p.select(F.lit(n).alias("part"), *cols) for n, p in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(
    "w3_zeroed",
    f"""with s as (select *, t - min(t) over w as z from channel window w as (partition by specimen_id, channel)), b as (select specimen_id, channel, avg(value) as base from s where z < {5*DAY}e0 group by 1,2)
select specimen_id, channel, seq, round(z,4) as t, round(value-base,5) as value from s join b using (specimen_id, channel)""",
)
def w3(t):
    d = S.zeroed(t.channel, 5 * DAY)
    return d.select(*K, "seq", F.round("t", 4).alias("t"), F.round("value", 5).alias("value"))


@query(
    "w4_trigger_time",
    "select specimen_id, channel, seq, round(t - min(t) over (partition by specimen_id, channel) - 0.5e0,4) as t from channel",
)
def w4(t):
    return S.trigger_time(t.channel).select(*K, "seq", F.round("t", 4).alias("t"))


@query(
    "w5_impact_index",
    """with m as (select specimen_id, channel, max(abs(value)) filter (where seq < 4) as m from channel group by 1,2)
select c.specimen_id, c.channel, min(seq) filter (where pow(abs(value)/(m*1.5e0),10e0) >= 1e0) - 2 as impact from channel c join m using (specimen_id, channel) group by 1,2""",
)
def w5(t):
    return S.impact_index(t.channel, head=4)


# a cubic over nine samples by the orthogonal polynomials of nine points; the outermost window is read at the ends
CUBIC = """p as (select *, count(*) over (partition by specimen_id, channel) as n from channel),
o as (select * from (values (-4,28e0,-14e0),(-3,7e0,7e0),(-2,-8e0,13e0),(-1,-17e0,9e0),(0,-20e0,0e0),(1,-17e0,-9e0),(2,-8e0,-13e0),(3,7e0,-7e0),(4,28e0,14e0)) q(x,p2,p3)),
w as (select a.x as at, b.x as x, 1e0/9e0 + a.x*b.x/60e0 + a.p2*b.p2/2772e0 + a.p3*b.p3/990e0 as w from o a cross join o b),
c as (select *, greatest(4, least(seq, n-5)) as centre from p),
sg as (select c.specimen_id, c.channel, c.seq, c.t, c.value, case when c.n >= 9 then sum(b.value*w) end as smooth from c
 left join w on w.at = c.seq - c.centre left join p b on b.specimen_id = c.specimen_id and b.channel = c.channel and b.seq = c.centre + w.x group by 1,2,3,4,5,c.n)"""


@query(
    "w6_drop_index",
    f"with {CUBIC} select specimen_id, channel, min(case when abs(abs(smooth/50e0)-1) < 0.01e0 then seq end) as drop from sg group by 1,2",
)
def w6(t):
    scaled = sampled(t).withColumn("value", F.col("value") / 50.0)
    return S.drop_index(scaled, 9, 3)


def padded_mean_sql(h):
    return f"""with c as (select *, count(*) over k as n, first_value(value) over o as a, last_value(value) over o as b, sum(value) over (partition by specimen_id, channel order by seq rows between {h} preceding and {h} following) as s from channel
 window k as (partition by specimen_id, channel), o as (partition by specimen_id, channel order by seq rows between unbounded preceding and unbounded following))
select specimen_id, channel, seq, round((s + greatest(0,{h}-seq)*a + greatest(0,{h}-(n-1-seq))*b)/{2*h+1}e0,6) as smooth from c"""


@query("w7_moving_mean", padded_mean_sql(5))
def w7(t):
    return S.moving_mean(t.channel, 11).select(*K, "seq", F.round("smooth", 6).alias("smooth"))


@query(
    "w8_hann_smoothing",
    """with hw as (select k, 0.5e0-0.5e0*cos(2e0*pi()*k/10e0) as w from (select unnest(range(0,11)) as k)), hs as (select sum(w) as tw from hw)
select a.specimen_id, a.channel, a.seq, round(sum(b.value*w)/any_value(tw),6) as smooth from channel a join channel b using (specimen_id, channel) join hw on k = a.seq + 5 - b.seq cross join hs group by 1,2,3""",
)
def w8(t):
    return S.hann_smooth(t.channel, 11).select(*K, "seq", F.round("smooth", 6).alias("smooth"))


SG = """with p as (select *, count(*) over (partition by specimen_id, channel) as n from channel),
sg as (select * from (values (-4,-21e0),(-3,14e0),(-2,39e0),(-1,54e0),(0,59e0),(1,54e0),(2,39e0),(3,14e0),(4,-21e0)) q(o,w))
select a.specimen_id, a.channel, a.seq, round(sum(b.value*w)/231e0,6) as smooth from p a join sg on true join p b on b.specimen_id=a.specimen_id and b.channel=a.channel and b.seq=a.seq+o where a.n >= 9 and a.seq >= 4 and a.seq < a.n-4 group by 1,2,3"""


@query("w9_savgol_interior", SG)
def w9(t):
    """Interior of the polynomial smoothing, comparable with the published weights."""
    from craquelure.operators.ordered import key_stats

    d = key_stats(S.savgol(sampled(t), 9, 3), K, n=F.count(F.lit(1)))
    return d.filter("n >= 9 and seq >= 4 and seq < n - 4").select(*K, "seq", F.round("smooth", 6).alias("smooth"))


@query("w9_savgol", f"with {CUBIC} select specimen_id, channel, seq, seq*2e-5 as t, value, round(smooth,6) as smooth from sg")
def w9b(t):
    return rounded(S.savgol(sampled(t), 9, 3), "smooth")


MOTION = f"""with x as ({RATE}), n as (select *, count(*) over (partition by specimen_id, channel) as n from x), o as (select specimen_id, channel, avg(value) as off from n where seq >= n-5 group by 1,2),
a as (select x.*, (value-off)*9.81e0 as a from x join o using (specimen_id, channel)), v as (select *, coalesce(sum(dv) over w,0e0) as v from (select *, (a+lag(a) over w)/2e0*(t-lag(t) over w) as dv from a window w as (partition by specimen_id, channel order by seq)) window w as (partition by specimen_id, channel order by seq)),
s as (select *, coalesce(sum(ds) over w,0e0) as s from (select *, (v+lag(v) over w)/2e0*(t-lag(t) over w) as ds from v window w as (partition by specimen_id, channel order by seq)) window w as (partition by specimen_id, channel order by seq))"""


@query("w10_motion", MOTION + " select specimen_id, channel, seq, round(a,5) as a, round(v,11) as v, round(s,11) as s from s")
def w10(t):
    d = S.motion(sampled(t), tail=5)
    return d.select(*K, "seq", F.round("a", 5).alias("a"), F.round("v", 11).alias("v"), F.round("s", 11).alias("s"))


LOAD = """with x as (select specimen_id, channel, (t - min(t) over (partition by specimen_id, channel))/1e6 as t, value, seq from channel),
c as (select *, row_number() over (partition by specimen_id, channel order by seq) - 1 as i, t - min(t) over (partition by specimen_id, channel) as z, value*9.81e0 as a from x where t > 0.5e0-sqrt(2e0*0.07e0/9.81e0) and t < 0.5e0-sqrt(2e0*0.07e0/9.81e0)+0.5e0),
v as (select *, coalesce(sum(dv) over w,0e0) as v from (select *, (a+lag(a) over w)/2e0*(z-lag(z) over w) as dv from c window w as (partition by specimen_id, channel order by i)) window w as (partition by specimen_id, channel order by i)),
s as (select *, coalesce(sum(ds) over w,0e0)+0.07e0 as s from (select *, (v+lag(v) over w)/2e0*(z-lag(z) over w) as ds from v window w as (partition by specimen_id, channel order by i)) window w as (partition by specimen_id, channel order by i))
select specimen_id, channel, i as seq, round(z,6) as t, round(a,4) as a, round(v,4) as v, round(s,5) as s, round(0.5e0*9.81e0*v*v,1) as e_kin, round(2.41e0*a,4) as force from s"""


def loaded(t):
    d = S.trigger_time(t.channel, 0.0).withColumn("t", F.col("t") / 1e6)
    d = S.load_curve(d)
    return d.select(
        *K, "seq", F.round("t", 6).alias("t"), *[F.round(c, 4).alias(c) for c in ("a", "v")], F.round("s", 5).alias("s"),
        F.round("e_kin", 1).alias("e_kin"), F.round("force", 4).alias("force"),
    )


@query("w10_load_curve", LOAD)
def w10b(t):
    return loaded(t)


@query("s19_load_curve_export", LOAD)
def s19(t):
    """The rows of the load-curve file (written with ``exports.write_csv``)."""
    return loaded(t)


@query(
    "w11_wiener",
    """with l as (select *, sum(value) over w/5e0 as m, sum(value*value) over w/5e0 as q from channel window w as (partition by specimen_id, channel order by seq rows between 2 preceding and 2 following)),
v as (select *, q-m*m as lv from l), n as (select *, avg(lv) over (partition by specimen_id, channel) as noise from v)
select specimen_id, channel, seq, round(case when lv < noise then m else (value-m)*(1e0-noise/nullif(lv,0e0))+m end,5) as smooth from n""",
)
def w11(t):
    d = S.wiener(t.channel, 5)
    return d.select(*K, "seq", F.round("smooth", 5).alias("smooth"))


def zero_phase_sql(source: str, name: str, kind: str, low: float, high: float = 0.0, fs: str = "(1e0/2e-5)") -> str:
    """CTEs up to ``name``: a fourth-order Butterworth filter of ``source`` run forward and backward sample by sample.

    Each of its two sections is written out over powers of the delay; a band section has four.
    """
    warped = [f"tan(pi()*{f}e0/{fs})" for f in (low, high or low)]
    if kind in ("lowpass", "highpass"):
        pad = 15
        top = "k*k, 2*k*k, k*k, 0e0, 0e0" if kind == "lowpass" else "1e0, -2e0, 1e0, 0e0, 0e0"
        below = "1+d*k+k*k, 2*(k*k-1), 1-d*k+k*k, 0e0, 0e0"
    else:
        pad = 27
        square = "u*u, 2*u*v, v*v+2*u*u, 2*u*v, u*u"
        top = "w*w, 0e0, -2*w*w, 0e0, w*w" if kind == "bandpass" else square
        below = "u*u+d*w*u+w*w, 2*u*v+d*w*v, v*v+2*u*u-2*w*w, 2*u*v-d*w*v, u*u-d*w*u+w*w"
    k, step = range(1, 5), []
    for section, x in (("g", "x"), ("h", "y1")):
        y = "y1" if section == "g" else "y"
        step += [f"{section}.b[1]*{x}+r.{section}[1] as {y}"]
        step += ["[" + ", ".join(f"{section}.b[{i + 1}]*{x}-{section}.a[{i + 1}]*{y}" + (f"+r.{section}[{i + 1}]" if i < 4 else "") for i in k) + f"] as {section}s"]

    def steady(section: str, x: str) -> str:
        rest = [f"list_sum([{section}.b[j]-{section}.a[j]*list_sum({section}.b)/list_sum({section}.a) for j in range({i + 1}, 6)])" for i in k]
        return "[" + ", ".join(f"{x}*{r}" for r in rest) + "]"

    def run(out: str, xs: str) -> str:
        g0, h0 = steady("g", "xs[1]"), steady("h", "xs[1]*list_sum(g.b)/list_sum(g.a)")
        return f"""{out} as (select specimen_id, channel, xs, 0 as i, cast([] as double[]) as ys, {g0} as g, {h0} as h from {xs}, {name}_f g, {name}_f h where g.number = 0 and h.number = 1
 union all select specimen_id, channel, xs, i+1, list_append(ys, y), gs, hs from (select r.specimen_id, r.channel, r.xs, r.i, r.ys, r.xs[r.i+1] as x, {", ".join(step)} from {out} r, {name}_f g, {name}_f h where g.number = 0 and h.number = 1 and r.i < len(r.xs)))"""

    return f"""{name}_p as (select number, 2*sin((2*number+1)*pi()/8e0) as d, {warped[0]} as k, 1+{warped[0]}*{warped[1]} as u, 2*{warped[0]}*{warped[1]}-2 as v, {warped[1]}-{warped[0]} as w from (values (0),(1)) q(number)),
{name}_c as (select number, [{top}] as b, [{below}] as a from {name}_p),
{name}_f as materialized (select number, [x/a[1] for x in b] as b, [x/a[1] for x in a] as a from {name}_c),
{name}_l as (select specimen_id, channel, list(value order by seq) as v, count(*) as n from {source} group by 1,2),
{name}_x as (select specimen_id, channel, list_concat(list_concat([2*v[1]-v[i] for i in range({pad + 1}, 1, -1)], v), [2*v[n]-v[i] for i in range(n-1, n-1-{pad}, -1)]) as xs from {name}_l where n > {pad}),
{run(f"{name}_r", f"{name}_x")},
{name}_y as (select specimen_id, channel, list_reverse(ys) as xs from {name}_r where i = len(xs)),
{run(f"{name}_s", f"{name}_y")},
{name}_z as (select specimen_id, channel, list_reverse(ys) as ys from {name}_s where i = len(xs)),
{name} as (select s.* exclude (value), z.ys[s.seq+{pad + 1}] as value from {source} s left join {name}_z z using (specimen_id, channel))"""


SAMPLED = f"sampled as ({RATE})"


def filter_sql(*stages) -> str:
    ctes, source = [SAMPLED], "sampled"
    for i, stage in enumerate(stages):
        ctes.append(zero_phase_sql(source, f"z{i}", *stage))
        source = f"z{i}"
    return (
        "with recursive " + ",\n".join(ctes)
        + f" select specimen_id, channel, s.seq, s.t, s.value, round({source}.value,6) as smooth from sampled s join {source} using (specimen_id, channel, seq)"
    )


@query("w12_lowpass", filter_sql(("lowpass", 5000)))
def w12a(t):
    return rounded(S.butterworth(sampled(t), "lowpass", 5000.0), "smooth")


@query("w12_highpass", filter_sql(("highpass", 1000)))
def w12b(t):
    return rounded(S.butterworth(sampled(t), "highpass", 1000.0), "smooth")


@query("w12_bandpass", filter_sql(("bandpass", 1000, 9000)))
def w12d(t):
    return rounded(S.butterworth(sampled(t), "bandpass", (1000.0, 9000.0)), "smooth")


@query("w12_stop_bands", filter_sql(*(("bandstop", int(a), int(b)) for a, b in S.EIGEN_BANDS)))
def w12c(t):
    return rounded(S.drop_bands(sampled(t)), "smooth")


def peaks_sql(source: str, name: str, height: float, distance: int = 0) -> str:
    """CTEs up to ``name``: middles of plateaus above both sides; with ``distance`` the highest first, one by one."""
    found = f"""{name}_g as (select *, lag(value) over w as p from {source} window w as (partition by specimen_id, channel order by seq)),
{name}_r as (select *, sum(case when p is null or p <> value then 1 else 0 end) over (partition by specimen_id, channel order by seq) as run from {name}_g),
{name}_a as (select specimen_id, channel, run, min(seq) as f, max(seq) as l, min(value) as value from {name}_r group by 1,2,3),
{name}_n as (select *, lag(value) over w as pv, lead(value) over w as nv from {name}_a window w as (partition by specimen_id, channel order by run)),
{name}{"_m" if distance else ""} as (select specimen_id, channel, cast(floor((f+l)/2e0) as bigint) as seq, value from {name}_n where pv < value and nv < value and value >= {height}e0)"""
    if not distance:
        return found
    return f"""{found},
{name}_o as (select *, row_number() over (partition by specimen_id, channel order by value desc, seq desc) as number from {name}_m),
{name}_t as (select distinct specimen_id, channel, 0 as number, cast([] as bigint[]) as kept from {name}_o
 union all select o.specimen_id, o.channel, t.number+1, case when len([x for x in t.kept if abs(x-o.seq) < {distance}]) = 0 then list_append(t.kept, o.seq) else t.kept end
 from {name}_t t join {name}_o o on o.specimen_id = t.specimen_id and o.channel = t.channel and o.number = t.number+1),
{name}_k as (select specimen_id, channel, unnest(kept) as seq from (select specimen_id, channel, arg_max(kept, number) as kept from {name}_t group by 1,2)),
{name} as (select {name}_m.* from {name}_m join {name}_k using (specimen_id, channel, seq))"""


@query("w13_local_maxima", f"with {peaks_sql('channel', 'pk', 60)} select specimen_id, channel, seq, value from pk")
def w13(t):
    return S.local_maxima(t.channel, 60.0)


@query("w13_spaced_peaks", f"with recursive {peaks_sql('channel', 'pk', 60, 6)} select specimen_id, channel, seq, value from pk")
def w13b(t):
    return S.peaks(t.channel, 60.0, 6)


IMPACT = (
    f"with recursive {SAMPLED}, hit as (select * from sampled where channel = 'click'), edge as (select * from sampled where channel = 'view'),\n"
    + zero_phase_sql("hit", "low", "lowpass", 3500)
    + ",\n"
    + peaks_sql("low", "hp", 20, 10)
    + ",\n"
    + peaks_sql("edge", "ep", 60, 3)
    + """,
a as (select specimen_id, min(seq) as seq from hp group by 1), b as (select specimen_id, min(seq) as seq from ep group by 1),
h as (select distinct specimen_id, coalesce(a.seq, 0)*2e-5 - 0.5e0 as t_impact from hit left join a using (specimen_id)),
e as (select distinct specimen_id, coalesce(b.seq, 0)*2e-5 - 0.5e0 as t_fracture from edge left join b using (specimen_id))
select specimen_id, round(t_impact,9) as t_impact, round(t_fracture,9) as t_fracture, t_fracture-t_impact < 1.5e0*(sqrt(2e0*450e0*450e0)/1500e3) as broken_immediately from h join e using (specimen_id)"""
)


@query("w14_broken_immediately", IMPACT)
def w14(t):
    d = sampled(t)
    drop = d.filter("channel = 'click'").drop("channel")
    edge = d.filter("channel = 'view'").drop("channel")
    runtime = math.hypot(450.0, 450.0) / 1500e3
    return rounded(S.broken_immediately(drop, edge, runtime, reaction_peak=(60.0, 3)), "t_impact", "t_fracture", digits=9)


@query(
    "w15_fourier_bins",
    """with x as (select *, count(*) over (partition by specimen_id, channel) as n from channel)
select specimen_id, channel, k, round(sqrt(sum(value*cos(2e0*pi()*k*seq/n))*sum(value*cos(2e0*pi()*k*seq/n))+sum(value*sin(2e0*pi()*k*seq/n))*sum(value*sin(2e0*pi()*k*seq/n))),5) as magnitude
 from x cross join (values (0),(1),(2),(5)) q(k) where k < n group by 1,2,3""",
)
def w15(t):
    d = S.fourier_bins(t.channel, [0, 1, 2, 5])
    return d.select(*K, "k", F.round("magnitude", 5).alias("magnitude"))


@query(
    "w15_full_spectrum",
    """with x as (select *, count(*) over (partition by specimen_id, channel) as n from channel)
select specimen_id, channel, f.k, round(sqrt(sum(value*cos(2e0*pi()*f.k*seq/n))*sum(value*cos(2e0*pi()*f.k*seq/n))+sum(value*sin(2e0*pi()*f.k*seq/n))*sum(value*sin(2e0*pi()*f.k*seq/n))),4) as magnitude
 from x join (select unnest(range(0,2000)) as k) f on f.k < n group by 1,2,3""",
)
def w15b(t):
    return S.spectrum(t.channel).select(*K, "k", F.round("magnitude", 4).alias("magnitude"))


@query(
    "s11_spectrum_export",
    """with x as (select *, count(*) over (partition by specimen_id, channel) as n from channel),
d as (select specimen_id, channel, f.k, n, sum(value*cos(2e0*pi()*f.k*seq/n)) as re, sum(value*sin(2e0*pi()*f.k*seq/n)) as im from x join (select unnest(range(0,2000)) as k) f on f.k < n group by 1,2,3,4)
select specimen_id, channel, case when n > 1 then round(least(k,n-k)/(n*2e-5),4) end as Freq, round(sqrt(re*re+im*im),4) as Ampl from d""",
)
def s11(t):
    """The rows of the ``Freq;Ampl`` file."""
    d = S.spectrum(sampled(t)).selectExpr("specimen_id", "channel", "freq as Freq", "magnitude as Ampl")
    return rounded(d, "Freq", "Ampl", digits=4)


@query(
    "w16_spectrogram",
    """with n as (select *, count(*) over (partition by specimen_id, channel) as n from channel),
f as (select distinct specimen_id, channel, n, unnest(range(0, cast(floor((n-16)/8e0) as int)+1)) as frame from n where n >= 16),
w as (select i, case when i <= 2 then 0.5e0*(1+cos(pi()*(i/2e0-1))) when i >= 14 then 0.5e0*(1+cos(pi()*(i/2e0-7))) else 1e0 end as w from (select unnest(range(0,16)) as i)),
x as (select f.specimen_id, f.channel, f.frame, w.i, w.w, value - avg(value) over (partition by f.specimen_id, f.channel, f.frame) as x from f cross join w join channel c on c.specimen_id=f.specimen_id and c.channel=f.channel and c.seq = f.frame*8+w.i),
s as (select specimen_id, channel, frame, k, sum(x*w*cos(2e0*pi()*k*i/16)) as re, sum(x*w*sin(2e0*pi()*k*i/16)) as im, sum(w*w) as ww from x cross join (select unnest(range(0,9)) as k) group by 1,2,3,4)
select specimen_id, channel, frame, round((frame*8+8)*2e-5,9) as time, round(k/(16*2e-5),4) as freq, round((case when k in (0,8) then 1 else 2 end)*(re*re+im*im)*2e-5/ww,6) as power from s""",
)
def w16(t):
    d = S.spectrogram(sampled(t), 16, 8)
    return rounded(rounded(rounded(d, "power", digits=6), "time", digits=9), "freq", digits=4)


@query(
    "w17_peak_aligned",
    """with p as (select specimen_id, channel, arg_max(t, value*1e6 - seq) as tp from channel group by 1,2) select specimen_id, channel, seq, round((t-tp)*1e3,1) as ms from channel join p using (specimen_id, channel)""",
)
def w17(t):
    return S.aligned(t.channel).select(*K, "seq", F.round("ms", 1).alias("ms"))


@query("w18_time_units", f"select specimen_id, channel, seq, round(t*1e9,2) as ns, round(t*1e6,5) as us, round(t*1e3,8) as ms, t as s from ({RATE})")
def w18(t):
    c = F.col("t")
    return sampled(t).select(
        *K, "seq", F.round(S.scaled_time(c, "ns"), 2).alias("ns"), F.round(S.scaled_time(c, "us"), 5).alias("us"),
        F.round(S.scaled_time(c, "ms"), 8).alias("ms"), S.scaled_time(c, "s").alias("s"),
    )


TRACK = """with l as (select *, lag(x_mm) over w as px, lag(y_mm) over w as py from crack_tip window w as (partition by crack_id order by frame)),
d as (select crack_id, frame, frame*2e0 as t, coalesce(sqrt((x_mm-px)*(x_mm-px)+(y_mm-py)*(y_mm-py)),0e0) as step, coalesce(atan2(y_mm-py,x_mm-px)*(180e0/pi()),0e0) as heading from l),
k as (select *, sum(step) over (partition by crack_id order by frame) as distance, lag(t) over (partition by crack_id order by frame) as pt, lag(heading) over (partition by crack_id order by frame) as ph from d)"""


@query(
    "w19_crack_kinematics",
    TRACK + " select crack_id, frame, round(step,6) as step, round(distance,4) as distance, round(heading,5) as heading, round(step*1e-3/(t-pt)/1e-6,4) as velocity, round(pt+(t-pt)/2e0,4) as t_velocity, round(coalesce(abs(ph-heading),0e0),4) as angle from k",
)
def w19(t):
    d = S.track(t.crack_tip, 2.0, turning="plain")
    return d.select(
        "crack_id", "frame", F.round("step", 6).alias("step"), F.round("distance", 4).alias("distance"), F.round("heading", 5).alias("heading"),
        F.round("velocity", 4).alias("velocity"), F.round("t_velocity", 4).alias("t_velocity"), F.round("angle", 4).alias("angle"),
    )


@query(
    "w19_stored_angles",
    """with recursive """
    + TRACK[5:]
    + """, f as (select crack_id, frame, 0e0 as angle from k where frame = 1 union all select k.crack_id, k.frame, abs(f.angle - k.heading) from f join k on k.crack_id=f.crack_id and k.frame=f.frame+1)
select crack_id, frame, round(angle,4) as angle from f""",
)
def w19b(t):
    return S.track(t.crack_tip, 2.0).select("crack_id", "frame", F.round("angle", 4).alias("angle"))


@query("w20_mean_velocity", TRACK + " select crack_id, round(regr_slope(distance,t),6) as velocity, round(regr_intercept(distance,t),4) as intercept from k group by 1")
def w20(t):
    d = S.mean_velocity(S.track(t.crack_tip, 2.0, turning="plain"))
    return d.select("crack_id", F.round("velocity", 6).alias("velocity"), F.round("intercept", 4).alias("intercept"))


@query(
    "w21_frame_difference",
    "select x, y as frame, abs(nx-gray) as change from (select *, lead(gray) over (partition by x order by y) as nx, lead(y) over (partition by x order by y) as ny from pixel) where ny = y+1 and abs(nx-gray) > 10",
)
def w21(t):
    pixels = t.pixel.withColumnRenamed("y", "frame")
    return S.frame_difference(pixels, 10, "frame", ("x",)).select("x", "frame", "change")


@query(
    "w22_extremum_around",
    """with c as (select specimen_id, channel, arg_min(seq, abs(t - 1.7055e9)*1e3 + seq/1e6) as centre from channel group by 1,2)
select channel.specimen_id, channel.channel, max(value) as peak, arg_min(seq, -value*1e6 + seq) as "at" from channel join c using (specimen_id, channel) where seq >= centre-4 and seq < centre+5 group by 1,2""",
)
def w22(t):
    targets = t.channel.select(*K).distinct().withColumn("t0", F.lit(1.7055e9))
    centre = brackets.nearest_sample(t.channel, targets, K).select(*K, F.col("seq").alias("centre"))
    return S.around(t.channel, centre, 4, 5)


@query(
    "j9_nearest_sample",
    "select specimen_id, channel, arg_min(seq, abs(t - 1.705e9)) as seq, round(min(abs(t-1.705e9)),5) as gap from channel group by 1,2",
)
def j9(t):
    targets = t.channel.select(*K).distinct().withColumn("t0", F.lit(1.705e9))
    d = brackets.nearest_sample(t.channel, targets, K)
    return d.select(*K, "seq", F.round("gap", 5).alias("gap"))


@query(
    "a33_channel_extremes",
    "select specimen_id, channel, max(value) as maximum, min(value) as minimum, arg_max(t, value*1e6 - seq) as t_maximum from channel group by 1,2",
)
def a33(t):
    return S.extremes(t.channel)


@query("a34_peak_and_valley", "select specimen_id, channel, max(value) as peak, min(value) as valley from channel group by 1,2")
def a34(t):
    return t.channel.groupBy(*K).agg(F.max("value").alias("peak"), F.min("value").alias("valley"))


CHANNELS = ["click", "error", "purchase", "signup", "view"]


def pivot_sql():
    body = ", ".join(f"max(case when channel='{c}' then value end) as {c}" for c in CHANNELS)
    head = lambda e: ", ".join(f"max(case when channel='{c}' then {e} end) as {c}" for c in CHANNELS)
    ext = "e as (select specimen_id, channel, max(value) as mx, min(value) as mn, arg_max(t, value*1e6-seq) as tm from channel group by 1,2)"
    rows = [("Maximum", -3, "mx"), ("Minimum", -2, "mn"), ("Time of Maximum", -1, "tm")]
    parts = [f"select specimen_id, '{n}' as label, {i} as seq, {head(c)} from e group by 1" for n, i, c in rows]
    return f"with {ext} " + " union all ".join([f"select specimen_id, '' as label, seq, {body} from channel group by 1,2,3", *parts])


@query("s10_wide_export", pivot_sql())
def s10(t):
    return exports.wide_channels(t.channel, CHANNELS)
