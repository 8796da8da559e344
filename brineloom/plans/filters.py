"""Filter, predicate, verdict and scalar queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brineloom.functions import scalars as S
from brineloom.operators import filters as X
from brineloom.operators.stats import means_in_order
from brineloom.plans.base import BASE, day_text, events, obs, r6, water_cells
from brineloom.sources.tables import table

QUERIES, ORACLE = {}, {}


def query(name, sql):
    def add(fn):
        QUERIES[name] = fn
        ORACLE[name] = f"with {BASE}, {sql}" if sql.lstrip().startswith("q as") else f"with {BASE} {sql}"
        return fn

    return add


@query("flt01_predicates", """select count(*) filter (where sensor = 'view') as eq, count(*) filter (where sensor in ('view','click')) as member,
  count(*) filter (where value < 50.5) as below, count(*) filter (where value >= 20 and value < 1e2) as both, count(*) filter (where k % 7 = 0) as called from ev""")
def flt01(spark, sf):
    p, n = X.compile_predicate, lambda c: F.count_if(c)
    s, v, k = F.col("sensor"), F.col("value"), F.col("k")
    return events(spark, sf).agg(
        n(p("view")(s)).alias("eq"), n(p(["view", "click"])(s)).alias("member"), n(p("< 50.5")(v)).alias("below"), n(p([">=20", "<1e2"])(v)).alias("both"), n(p(lambda c: c % 7 == 0)(k)).alias("called")
    )


_CRITERIA = [
    {"channel": "low", "value": ">20", "prop": 0.6, "label": "bright"},
    {"name": "low", "condition": ">20", "threshold": 0.75, "nan": "ignore", "label": "bright seen"},
    {"band": "k", "values": [1, 2, 3, 4, 5], "frac": 0.9, "nan_policy": "valid", "label": "k"},
]
_GAPPY = "x as (select sensor, day, px, case when water then value end as low, case when k < 40 then k end as k from obs)"


def _gappy(spark, sf):
    return obs(spark, sf).select("sensor", "day", "px", F.when(F.col("water"), F.col("value")).alias("low"), F.when(F.col("k") < 40, F.col("k")).alias("k"))


_SCORED = f"""q as (with {_GAPPY} select sensor, day, count(*) filter (where low > 20) / cast(count(*) as double) as a,
  case when count(low) > 0 then count(*) filter (where low > 20) / cast(count(low) as double) end as b,
  count(*) filter (where k between 1 and 5 or k is null) / cast(count(*) as double) as c from x group by sensor, day)"""


@query("flt03_fractions", _SCORED + " select sensor, cast(day as varchar) as day, round(a,6) as invalid_, round(b,6) as ignore_, round(c,6) as valid_ from q")
def flt03(spark, sf):
    c = [X.Criterion.of(x) for x in _CRITERIA]
    out = _gappy(spark, sf).groupBy("sensor", "day").agg(*(x.fraction().alias(n) for x, n in zip(c, ("invalid_", "ignore_", "valid_"), strict=True)))
    return out.select("sensor", day_text().alias("day"), r6("invalid_").alias("invalid_"), r6("ignore_").alias("ignore_"), r6("valid_").alias("valid_"))


@query("flt04_criteria", _SCORED + """ select sensor, cast(day as varchar) as day, a >= 0.6 as p1, coalesce(b >= 0.75, false) as p2, c >= 0.9 as p3,
  a >= 0.6 and coalesce(b >= 0.75, false) and c >= 0.9 as valid from q""")
def flt04(spark, sf):
    out = X.evaluate(_gappy(spark, sf), _CRITERIA, ("sensor", "day"))
    return out.select("sensor", day_text().alias("day"), F.col("`pass: bright`").alias("p1"), F.col("`pass: bright seen`").alias("p2"), F.col("`pass: k`").alias("p3"), "valid")


@query("flt05_passing_images", _SCORED + """ select o.sensor, cast(o.day as varchar) as day, count(*) as n, round(sum(o.value),4) as total from obs o join q on o.sensor = q.sensor and o.day = q.day
  where a >= 0.6 or coalesce(b >= 0.75, false) or c >= 0.9 group by o.sensor, o.day""")
def flt05(spark, sf):
    x = _gappy(spark, sf).join(obs(spark, sf).select("sensor", "day", "px", "value"), ["sensor", "day", "px"])
    out = X.passing(x, _CRITERIA, ("sensor", "day"), "any")
    return out.groupBy("sensor", "day").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).withColumn("day", day_text())


@query("flt06_channel_view", """, f as (select day, max(k) > 95 as hot from ev group by day)
  select o.sensor, cast(o.day as varchar) as day, o.px, round(case when o.water and not f.hot then o.value else -1.0 end, 6) as view
  from obs o join f on o.day = f.day""")
def flt06(spark, sf):
    flags = events(spark, sf).groupBy("day").agg((F.max("k") > 95).alias("hot"))
    out = obs(spark, sf).join(flags, "day")
    return out.select("sensor", day_text().alias("day"), "px", r6(F.coalesce(F.when(F.col("water") & ~F.col("hot"), F.col("value")), F.lit(-1.0))).alias("view"))


@query("flt07_score_sensor", """, w as (select count(distinct px) as n from obs where water)
  select sensor, cast(day as varchar) as day, count(*) filter (where water) as n_obs, round(count(*) filter (where water) / cast(max(w.n) as double), 6) as water_frac,
  count(*) filter (where water) >= 20 as acquisition from obs, w group by sensor, day""")
def flt07(spark, sf):
    x = obs(spark, sf)
    n = x.where("water").agg(F.count_distinct("px").alias("n_water"))
    out = x.groupBy("sensor", "day").agg(F.count_if("water").alias("n_obs")).crossJoin(F.broadcast(n))  # one row
    return out.select("sensor", day_text().alias("day"), "n_obs", r6(F.col("n_obs") / F.col("n_water")).alias("water_frac"), (F.col("n_obs") >= 20).alias("acquisition"))


@query("flt08_water_mask", "select sensor, count(*) as n, round(avg(value),6) as mean from obs where px in (select distinct px from obs where water) group by sensor")
def flt08(spark, sf):
    x = obs(spark, sf)
    return x.join(x.where("water").select("px").distinct(), "px", "left_semi").groupBy("sensor").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"))


@query("flt09_celsius", """, k as (select sensor, value + case when sensor = 'view' then 273.15 else 0.0 end as v from obs),
  m as (select sensor, median(v) as med from k group by sensor) select k.sensor, round(avg(case when med > 150 then v - 273.15 else v end),6) as mean, round(max(med),6) as med from k join m on k.sensor = m.sensor group by k.sensor""")
def flt09(spark, sf):
    x = obs(spark, sf).select("sensor", (F.col("value") + F.when(F.col("sensor") == "view", 273.15).otherwise(0.0)).alias("v"))
    m = x.groupBy("sensor").agg(F.median("v").alias("med"))
    x = x.join(m, "sensor")
    return x.groupBy("sensor").agg(r6(F.avg(X.celsius(F.col("v"), F.col("med")))).alias("mean"), r6(F.max("med")).alias("med"))


@query("flt10_members", "select sensor, cast(day as varchar) as day, count(case when water and k <= 80 then value end) as n, round(sum(case when water and k <= 80 then value end),6) as total from obs group by sensor, day")
def flt10(spark, sf):
    x = obs(spark, sf).withColumn("u", X.usable(F.col("value"), F.col("water"), F.when(F.col("k") <= 80, 1.0).otherwise(0.0)))
    return x.groupBy("sensor", "day").agg(F.count("u").alias("n"), r6(F.sum("u")).alias("total")).withColumn("day", day_text())


_GRID = """g as (select s.sensor, d.day, p.px, p.px % 10 <> 0 as water, o.value, case when o.k is not null and o.k % 5 <> 0 then (o.k > 80)::int end as cloud, case when o.k is not null then (o.k < 70)::int end as valid
  from (select distinct sensor from obs) s, (select distinct day from obs) d, (select distinct px from obs) p
  left join obs o on o.sensor = s.sensor and o.day = d.day and o.px = p.px)"""


def grid(spark, sf):
    """Every member, day and pixel; NULL where unobserved."""
    x = obs(spark, sf)
    keys = x.select("sensor").distinct().crossJoin(x.select("day").distinct()).crossJoin(x.select("px").distinct())  # the calendar grid
    k = F.col("k")
    return keys.join(x.select("sensor", "day", "px", "value", "k"), ["sensor", "day", "px"], "left").select(
        "sensor", "day", "px", (F.col("px") % 10 != 0).alias("water"), "value", F.when(k.isNotNull() & (k % 5 != 0), (k > 80).cast("int")).alias("cloud"), F.when(k.isNotNull(), (k < 70).cast("int")).alias("valid")
    )


_QC = f"""q as (with {_GRID} select *, water and value is not null and (coalesce(cloud = 1, false) or coalesce(valid = 0, false)) as flagged,
  water and value is null as gap, water and value is null and not coalesce(cloud = 1, false) as nodata from g)"""


def _qc(spark, sf):
    g = grid(spark, sf)
    return g.withColumns(X.qc_flags(F.col("value"), F.col("water"), F.col("cloud"), F.col("valid")))


@query("flt11_qc_masks", _QC + " select sensor, cast(day as varchar) as day, count(*) filter (where flagged) as flagged, count(*) filter (where gap) as gap, count(*) filter (where nodata) as nodata from q group by sensor, day")
def flt11(spark, sf):
    return _qc(spark, sf).groupBy("sensor", "day").agg(*(F.count_if(c).alias(c) for c in ("flagged", "gap", "nodata"))).withColumn("day", day_text())


@query("flt12_cloud_prior", _QC + " select sensor, cast(day as varchar) as day, px, least(greatest(case when nodata and px % 2 = 0 then 0.0 when flagged or gap then 0.7 else 0.1 end, 1e-6), 1 - 1e-6) as prior from q where water")
def flt12(spark, sf):
    x = _qc(spark, sf).where("water")
    return x.select("sensor", day_text().alias("day"), "px", X.cloud_prior(F.col("flagged"), F.col("gap"), F.col("nodata") & (F.col("px") % 2 == 0), 0.1, 0.7, 0.0).alias("prior"))


@query("flt13_first_keep", _QC + """, a as (select sensor, day from q where water group by sensor, day having count(value) >= 15)
  select q.sensor, count(*) as n from q join a on q.sensor = a.sensor and q.day = a.day where water and value is not null and not flagged group by q.sensor""")
def flt13(spark, sf):
    x = _qc(spark, sf).where("water")
    return x.join(X.acquisitions(x, 15), ["sensor", "day"], "left_semi").where(F.col("value").isNotNull() & ~F.col("flagged")).groupBy("sensor").agg(F.count("*").alias("n"))


_VERDICT = """q as (select sensor, day, median(value) - 70 as center, count(*) as n from obs group by sensor, day),
  v as (select *, case when center < -25 then 'low' when center > 30 then 'high' when n < 90 then 'no reference' else 'kept' end as reason from q)"""


def _verdict(spark, sf):
    x = obs(spark, sf).groupBy("sensor", "day").agg((F.median("value") - 70).alias("center"), F.count("*").alias("n"))
    return x.withColumn("reason", X.scene_verdict(F.col("center"), -25.0, 30.0, F.col("n") < 90))


@query("flt14_scene_verdict", _VERDICT + " select sensor, cast(day as varchar) as day, round(center,6) as center, reason from v")
def flt14(spark, sf):
    word = F.when(F.col("reason").contains("below"), "low").when(F.col("reason").contains("above"), "high").otherwise(F.col("reason"))
    return _verdict(spark, sf).select("sensor", day_text().alias("day"), r6("center").alias("center"), word.alias("reason"))


@query("flt15_masked_scenes", _VERDICT + """, p as (select sensor, day, count(*) filter (where water and k <= 80) as n_pass from obs group by sensor, day), w as (select count(distinct px) as nw from obs where water)
  select p.sensor, cast(p.day as varchar) as day, n_pass, round(n_pass/nw,6) as pixel_frac, case when reason = 'kept' and n_pass/nw >= 0.3 then n_pass else 0 end as n_kept,
  case when reason = 'kept' and n_pass/nw >= 0.3 then 'KEPT' else 'DROPPED' end as verdict from w cross join p join v on p.sensor = v.sensor and p.day = v.day""")
def flt15(spark, sf):
    x = obs(spark, sf).withColumn("p_valid", F.when(F.col("water") & (F.col("k") <= 80), 1.0).otherwise(0.0))
    out = X.keep_scenes(x, _verdict(spark, sf), 0.5, water_cells(spark, sf).first()[0], 0.3)
    return out.select("sensor", day_text().alias("day"), "n_pass", r6("pixel_frac").alias("pixel_frac"), "n_kept", "verdict")


@query("flt16_day_context", _QC + """, d as (select sensor, day, count(value) >= 30 as constrained from q where water group by sensor, day)
  select q.sensor, case when value is not null then 'observed' when constrained then 'point_fill' else 'day_fill' end as context, count(*) as n from q join d on q.sensor = d.sensor and q.day = d.day where water group by 1, 2""")
def flt16(spark, sf):
    x = _qc(spark, sf).where("water")
    d = x.groupBy("sensor", "day").agg((F.count("value") >= 30).alias("constrained"))
    return x.join(d, ["sensor", "day"]).groupBy("sensor", X.day_context(F.col("value").isNotNull(), F.col("constrained")).alias("context")).agg(F.count("*").alias("n"))


@query("flt17_kept_at", "select (k >> 2) & 1 = 1 as kept, count(*) as n from ev group by 1")
def flt17(spark, sf):
    return events(spark, sf).groupBy(X.kept_at(F.col("k"), 2).alias("kept")).agg(F.count("*").alias("n"))


@query("flt18_standardize", """, c as (select px, avg(value) as seasonal, greatest(stddev_samp(value), 0.5) as scale from obs where px % 3 <> 0 group by px),
  j as (select o.sensor, o.day, o.px, o.value, c.seasonal, c.scale, (o.value - c.seasonal)/c.scale as z, case when o.k > 50 then (o.value - c.seasonal)/c.scale end as zg from obs o left join c on o.px = c.px),
  b as (select *, coalesce(zg,0)*scale + seasonal as kel from j), m as (select day, median(kel) as med from b group by day)
  select sensor, cast(b.day as varchar) as day, px, round(z,6) as z, round(coalesce(kel, med) + 1e-7,4) as back from b join m on b.day = m.day""")
def flt18(spark, sf):
    x = obs(spark, sf)
    c = x.where("px % 3 <> 0").groupBy("px").agg(F.avg("value").alias("seasonal"), F.greatest(F.stddev_samp("value"), F.lit(0.5)).alias("scale"))
    z = X.standardized(F.col("value"), F.col("seasonal"), F.col("scale"))
    j = x.join(c, "px", "left").withColumn("z", z).withColumn("kel", X.unstandardized(F.when(F.col("k") > 50, F.col("z")), F.col("seasonal"), F.col("scale")))
    med = j.groupBy("day").agg(F.median("kel").alias("med"))
    return j.join(med, "day").select("sensor", day_text().alias("day"), "px", r6("z").alias("z"), F.round(F.coalesce("kel", "med") + 1e-7, 4).alias("back"))


@query("flt19_apply_offset", """, f as (select sensor, case sensor when 'view' then 0.0 when 'click' then 1.5 else -2.25 end as off, case sensor when 'purchase' then 1.25 else 1.0 end as slope from (select distinct sensor from obs))
  select o.sensor, cast(day as varchar) as day, round(avg((value - off)/slope),6) as adj, round(cast(max(case when o.k is not null then off end) as double),6) as off from obs o join f on o.sensor = f.sensor group by o.sensor, day""")
def flt19(spark, sf):
    s = F.col("sensor")
    off = F.when(s == "view", 0.0).when(s == "click", 1.5).otherwise(-2.25)
    out = obs(spark, sf).withColumn("off", off).withColumn("adj", S.apply_offset(F.col("value"), F.col("off"), F.when(s == "purchase", 1.25).otherwise(1.0)))
    return out.groupBy("sensor", "day").agg(r6(F.avg("adj")).alias("adj"), r6(F.max("off")).alias("off")).withColumn("day", day_text())


@query("scl01_seasonal_design", """select event_id, round(cos(2*pi()*d/365.25),6) as cos1, round(sin(2*pi()*d/365.25),6) as sin1, round(cos(4*pi()*d/365.25),6) as cos2, round(sin(4*pi()*d/365.25),6) as sin2
  from (select event_id, dayofyear(ts) - 1 + (hour(ts)*3600 + minute(ts)*60 + second(ts))/86400.0 as d from ev)""")
def scl01(spark, sf):
    h = S.harmonics(S.year_fraction_day(F.col("ts")), 2, 365.25)
    return events(spark, sf).select("event_id", *(r6(c).alias(n) for n, c in h.items() if n != "mean"))


@query("scl02_diurnal_design", "select event_id, round(coalesce(cos(2*pi()*h/24),0),6) as cos1, round(coalesce(sin(2*pi()*h/24),0),6) as sin1 from (select event_id, case when k > 10 then hr end as h from ev)")
def scl02(spark, sf):
    h = S.diurnal(F.when(F.col("k") > 10, F.col("hour")), 1)
    return events(spark, sf).select("event_id", r6(h["cos1"]).alias("cos1"), r6(h["sin1"]).alias("sin1"))


_COEF = "c as (select px, avg(value*cos(2*pi()*hr/24)) as c1, avg(value*sin(2*pi()*hr/24)) as s1, avg(value) as m from ev group by px)"


def _coef(spark, sf):
    h = S.diurnal(F.col("hour"), 1)
    return events(spark, sf).groupBy("px").agg(F.avg(F.col("value") * h["cos1"]).alias("c1"), F.avg(F.col("value") * h["sin1"]).alias("s1"), F.avg("value").alias("m"))


@query("scl03_amplitude_phase", f", {_COEF} select px, round(sqrt(c1*c1+s1*s1),6) as amp, round(case when atan2(s1,c1) < 0 then atan2(s1,c1)*24/(2*pi()) + 24 else atan2(s1,c1)*24/(2*pi()) end,5) as peak from c")
def scl03(spark, sf):
    c, s = F.col("c1"), F.col("s1")
    return _coef(spark, sf).select("px", r6(S.amplitude(c, s)).alias("amp"), F.round(S.peak_day(c, s, 1, 24.0), 5).alias("peak"))


@query("scl04_term_text", f", {_COEF} select px, printf('mean=%.4f;cos1=%.4f', round(m,3), round(c1,3)) as terms from c")
def scl04(spark, sf):
    c1 = F.col("value") * S.diurnal(F.col("hour"), 1)["cos1"]
    x = means_in_order(events(spark, sf), "px", ["event_id"], {"m": F.col("value"), "c1": c1})
    return x.select("px", S.terms({"mean": S.half_away(F.col("m"), 3), "cos1": S.half_away(F.col("c1"), 3)}).alias("terms"))


@query("scl05_sigmoid", "select event_id, round(1/(1+exp(-(value-50)/20)),6) as p from ev")
def scl05(spark, sf):
    return events(spark, sf).select("event_id", r6(S.sigmoid((F.col("value") - 50) / 20)).alias("p"))


@query("scl06_log_odds", """select event_id, case when w > 0 then round(ln(0.25) - 0.25*w + w*w/8 + ln(2) + ln(2*pi())/2 + ln(pr/(1-pr)),6) end as lo
  from (select event_id, (60 - value)/10 as w, case when k > 80 then 0.6 else 0.2 end as pr from ev)""")
def scl06(spark, sf):
    lo = S.exponential_log_odds((F.lit(60) - F.col("value")) / 10, 0.25, 2.0, F.when(F.col("k") > 80, 0.6).otherwise(0.2))
    return events(spark, sf).withColumn("lo", lo).select("event_id", r6(F.when(F.col("lo") != float("-inf"), F.col("lo"))).alias("lo"))


@query("scl07_filter_settings", """select t as t_c, case when t > 0 then greatest(cast(ceil(pow(t/(2*pi()),2)/0.25) as bigint),1) else 0 end as p,
  round(case when t > 0 then pow(t/(2*pi()),2)/greatest(ceil(pow(t/(2*pi()),2)/0.25),1) else 0.0 end,6) as alpha from (select distinct cast(k % 12 as double) as t from ev)""")
def scl07(spark, sf):
    t = events(spark, sf).select((F.col("k") % 12).cast("double").alias("t_c")).distinct()
    s = S.cutoff_settings(F.col("t_c"), 0.25)
    return t.select("t_c", s["p"].alias("p"), r6(s["alpha"]).alias("alpha"))


@query("scl08_stability", """, s as (select px, min(gap) as step from (select px, date_diff('day', lag(day) over (partition by px order by day), day) as gap from (select distinct px, day from obs)) group by px)
  select px, 0.3 <= 0.25*step*step as stable from s where step is not null""")
def scl08(spark, sf):
    d = obs(spark, sf).select("px", "day").distinct()
    d = d.withColumn("gap", F.datediff("day", F.lag("day").over(Window.partitionBy("px").orderBy("day"))))
    return d.groupBy("px").agg(F.min("gap").alias("step")).where("step is not null").select("px", S.stable(F.lit(0.3), F.col("step")).alias("stable"))


@query("scl10_season", """select case when m in (12,1,2) then 'DJF' when m in (3,4,5) then 'MAM' when m in (6,7,8) then 'JJA' else 'SON' end as season,
  case l_linenumber % 4 when 0 then 'full' when 1 then 'mean_only' when 2 then 'reference' else 'none' end as fit, count(*) as n from (select month(l_shipdate) as m, l_linenumber from lineitem) group by 1, 2""")
def scl10(spark, sf):
    x = table(spark, sf, "lineitem")
    return x.groupBy(S.season(F.month("l_shipdate")).alias("season"), S.fit_label(F.col("l_linenumber") % 4).alias("fit")).agg(F.count("*").alias("n"))


@query("scl11_rms_helpers", "select sensor, round(sqrt(avg((value - hr)*(value - hr))),6) as rms, printf('%d of %d', count(*) filter (where k > 80), count(*)) as coverage from ev group by sensor")
def scl11(spark, sf):
    d = F.col("value") - F.col("hour")
    return events(spark, sf).groupBy("sensor").agg(r6(F.sqrt(F.avg(d * d))).alias("rms"), F.format_string("%d of %d", F.count_if(F.col("k") > 80), F.count("*")).alias("coverage"))


@query("scl12_linear_sensor", "select event_id, round(40 + 1.5 + 0.9*(value - 40),6) as sensor_value from ev")
def scl12(spark, sf):
    return events(spark, sf).select("event_id", r6(S.linear_sensor(F.col("value"), F.lit(40), F.lit(1.5), F.lit(0.9))).alias("sensor_value"))
