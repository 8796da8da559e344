"""Aggregation, window, selection and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brineloom.functions import scalars as S
from brineloom.operators import reports as R
from brineloom.operators import stats as A
from brineloom.operators import stencil as G
from brineloom.operators.filters import kept_at
from brineloom.plans.base import BASE, day_text, events, grid_rows, obs, r6, water_cells
from brineloom.sources.tables import table

QUERIES, ORACLE = {}, {}


def query(name, sql):
    def add(fn):
        QUERIES[name] = fn
        ORACLE[name] = f"with {BASE}, {sql}" if sql.lstrip().startswith("q as") else f"with {BASE} {sql}"
        return fn

    return add


_VIEW = "q as (select m.sensor, m.day, m.px, r.value as x, m.value as y, m.hour as hr from obs m join obs r on m.day = r.day and m.px = r.px and r.sensor = 'view' where m.sensor <> 'view')"


def pairs(spark, sf):
    """Pixel matchups of each member with the reference."""
    o = obs(spark, sf)
    ref = o.where("sensor = 'view'").select("day", "px", F.col("value").alias("x"))
    return o.where("sensor <> 'view'").join(ref, ["day", "px"]).select("sensor", "day", "px", "x", F.col("value").alias("y"), "hour")


@query("agg02_validation_mask", """q as (select day, px, bit_or(case sensor when 'view' then 1 when 'click' then 2 else 4 end)::int as src, count(*) as n,
  count(*) filter (where not (sensor <> 'view' and day(day) % 5 = 0)) as n_open, avg(value) filter (where not (sensor <> 'view' and day(day) % 5 = 0)) as open from obs group by day, px)
  select cast(day as varchar) as day, px, src, n, round(open,6) as open, n_open = 0 as held from q""")
def agg02(spark, sf):
    s = F.col("sensor")
    held = (s != "view") & (F.dayofmonth("day") % 5 == 0)
    bit = F.when(s == "view", 1).when(s == "click", 2).otherwise(4)
    out = obs(spark, sf).groupBy("day", "px").agg(F.bit_or(bit).alias("src"), F.count("*").alias("n"), F.count_if(~held).alias("n_open"), F.avg(F.when(~held, F.col("value"))).alias("open"))
    return out.select(day_text().alias("day"), "px", "src", "n", r6("open").alias("open"), (F.col("n_open") == 0).alias("held"))


@query("agg03_fused_composite", """, c as (select px, avg(value) as seasonal, greatest(stddev_samp(value),0.5) as scale from obs group by px having count(*) >= 3)
  select cast(o.day as varchar) as day, o.px, round((sum((o.value - case o.sensor when 'click' then 1.5 else 0 end) * case o.sensor when 'view' then 2 else 1 end)/sum(case o.sensor when 'view' then 2 else 1 end) - max(c.seasonal))/max(c.scale),6) as z
  from obs o join c on o.px = c.px where o.k <= 80 group by o.day, o.px""")
def agg03(spark, sf):
    o, s = obs(spark, sf), F.col("sensor")
    c = o.groupBy("px").agg(F.avg("value").alias("seasonal"), F.greatest(F.stddev_samp("value"), F.lit(0.5)).alias("scale"), F.count("*").alias("n")).where("n >= 3").drop("n")
    w = F.when(s == "view", 2).otherwise(1)
    v = F.col("value") - F.when(s == "click", 1.5).otherwise(0)
    m = o.where("k <= 80").groupBy("day", "px").agg((F.sum(v * w) / F.sum(w)).alias("v")).join(c, "px")
    return m.select(day_text().alias("day"), "px", r6((F.col("v") - F.col("seasonal")) / F.col("scale")).alias("z"))


@query("agg04_block_mean", "select sensor, cast(day as varchar) as day, row // 4 as row, col // 4 as col, round(avg(value),6) as value, count(value) as n from obs where row < (select (max(row) + 1) // 4 * 4 from obs) and col < 12 group by sensor, day, row // 4, col // 4")
def agg04(spark, sf):
    out = G.block_mean(obs(spark, sf), ["sensor", "day"], 4, grid_rows(spark, sf), 15)
    return out.select("sensor", day_text().alias("day"), "row", "col", r6("value").alias("value"), "n")


_DELTA = """q as (select sensor, day, y - x as d, y, x, px, hr from (select m.sensor, m.day, m.px, r.value as x, m.value as y, m.hour as hr from obs m join obs r on m.day = r.day and m.px = r.px and r.sensor = 'view' where m.sensor <> 'view')),
  m as (select sensor, day, median(d) as delta, count(*) as n from q group by sensor, day),
  s as (select q.sensor, q.day, max(m.delta) as delta, 1.4826*median(abs(q.d - m.delta)) as sd, max(m.n) as n from q join m on q.sensor = m.sensor and q.day = m.day group by q.sensor, q.day)"""


def scene_deltas(spark, sf):
    p = pairs(spark, sf).withColumn("d", F.col("y") - F.col("x"))
    return A.mad(p, ["sensor", "day"], "d").select("sensor", "day", F.col("median").alias("delta"), F.col("mad").alias("sd"), "n")


@query("agg05_scene_delta", _DELTA + " select sensor, cast(day as varchar) as day, round(delta,4) as delta, round(sd,4) as sd, n, abs(delta) > 30 as rejected from s")
def agg05(spark, sf):
    return scene_deltas(spark, sf).select("sensor", day_text().alias("day"), F.round("delta", 4).alias("delta"), F.round("sd", 4).alias("sd"), "n", (F.abs("delta") > 30).alias("rejected"))


@query("agg06_scene_medians", _VIEW + " select sensor, cast(day as varchar) as day, round(median(x),4) as x, round(median(y),4) as y, count(*) as n, round(arg_min(hr, px),4) as hr from q group by sensor, day")
def agg06(spark, sf):
    out = pairs(spark, sf).groupBy("sensor", "day").agg(F.round(F.median("x"), 4).alias("x"), F.round(F.median("y"), 4).alias("y"), F.count("*").alias("n"), F.round(F.min_by("hour", "px"), 4).alias("hr"))
    return out.withColumn("day", day_text())


@query("agg07_robust_scale", """q as (select px, median(value) as med, count(*) as n from obs group by px),
  m as (select o.px, max(q.n) as n, 1.4826*median(abs(o.value - q.med)) as mad from obs o join q on o.px = q.px group by o.px),
  r as (select px, n, case when n > 3 and mad > 0 then mad*sqrt(n/cast(n-3 as double)) end as raw from m), t as (select median(raw) as typical from r)
  select px, n, round(greatest(coalesce(raw, typical), 0.5),4) as scale from r, t""")
def agg07(spark, sf):
    return A.robust_scale(obs(spark, sf), 3, 0.5).select("px", "n", F.round("scale", 4).alias("scale"))


@query("agg08_shorth", """q as (select sensor, value, row_number() over (partition by sensor order by value) as i, count(*) over (partition by sensor) as n from ev),
  w as (select a.sensor, a.value as low, b.value as top, b.value - a.value as width, a.i from q a join q b on a.sensor = b.sensor and b.i = a.i + a.n // 2),
  c as (select sensor, (low + top)/2 as center, width from (select *, row_number() over (partition by sensor order by width, i) as k from w) where k = 1),
  r as (select q.sensor, max(center) as center, max(width) as width, count(*) filter (where value > center) as above, median(case when value > center then value - center end) as side from q join c on q.sensor = c.sensor group by q.sensor)
  select sensor, round(center,4) as center, round(greatest(case when above >= 64 then side/0.6745 else width/1.349 end, 1e-3),4) as scale from r""")
def agg08(spark, sf):
    return A.shorth(events(spark, sf), ["sensor"]).select("sensor", F.round("center", 4).alias("center"), F.round("scale", 4).alias("scale"))


_SCORE = "count(y-x) as n, round(avg(y-x),6) as bias, round(avg((y-x)*(y-x)),5) as mse, round(sqrt(avg((y-x)*(y-x))),6) as rmse, round(avg(abs(y-x)),6) as mae, round(median(abs(y-x)),4) as medae, round(corr(y,x),6) as r, round(1 - avg((y-x)*(y-x))/avg((60-x)*(60-x)),6) as skill"


def _scored(x, *by):
    places = {"medae": 4, "mse": 5}
    return x.groupBy(*by).agg(*((c if k == "n" else F.round(c, places.get(k, 6))).alias(k) for k, c in A.scores(F.col("y"), F.col("x"), F.lit(60.0)).items()))


@query("agg09_scores", _VIEW + f" select sensor, {_SCORE} from q group by sensor")
def agg09(spark, sf):
    return _scored(pairs(spark, sf), "sensor")


@query("agg10_grouping_sets", _VIEW + """, p as (select sensor, 'raw' as product, px % 4 as station, day(day) % 2 as odd, x, y from q union all select sensor, 'smooth', px % 4, day(day) % 2, x, 0.5*y + 20 from q)
  select sensor, product, coalesce(cast(station as varchar),'all') as station, coalesce(cast(odd as varchar),'all') as odd, count(*) as n, round(avg(y-x),6) as bias, round(sqrt(avg((y-x)*(y-x))),6) as rmse
  from p group by grouping sets ((sensor, product), (sensor, product, station), (sensor, product, odd))""")
def agg10(spark, sf):
    p = pairs(spark, sf).select("sensor", (F.col("px") % 4).alias("station"), (F.dayofmonth("day") % 2).alias("odd"), "x", F.expr("stack(2, 'raw', y, 'smooth', 0.5D*y + 20) as (product, y)"))
    e = F.col("y") - F.col("x")
    c = [F.col(k) for k in ("sensor", "product", "station", "odd")]
    out = p.groupingSets([c[:2], c[:3], [*c[:2], c[3]]], *c).agg(F.count("*").alias("n"), r6(F.avg(e)).alias("bias"), r6(F.sqrt(F.avg(e * e))).alias("rmse"))
    text = lambda k: F.coalesce(F.col(k).cast("string"), F.lit("all")).alias(k)
    return out.select("sensor", "product", text("station"), text("odd"), "n", "bias", "rmse")


@query("agg11_rollup_sites", _VIEW + " select sensor, coalesce(cast(px % 8 as varchar),'all') as site, count(*) as n, round(avg(y-x),6) as bias, round(sqrt(avg((y-1.5-x)*(y-1.5-x))),6) as after from q group by grouping sets ((sensor), (sensor, px % 8))")
def agg11(spark, sf):
    p = pairs(spark, sf).withColumn("site", F.col("px") % 8)
    e = F.col("y") - F.col("x")
    out = p.rollup("sensor", "site").agg(F.count("*").alias("n"), r6(F.avg(e)).alias("bias"), r6(F.sqrt(F.avg((e - 1.5) * (e - 1.5)))).alias("after")).where("sensor is not null")
    return out.withColumn("site", F.coalesce(F.col("site").cast("string"), F.lit("all")))


_VC = _DELTA + ", t as (select sensor, greatest(var_samp(delta) - avg(sd*sd/n), 0) as tau2 from s group by sensor), w as (select s.*, t.tau2, 1/(t.tau2 + sd*sd/n) as w from s join t on s.sensor = t.sensor)"


@query("agg12_variance_components", _VC + " select sensor, cast(day as varchar) as day, round(tau2,5) as tau2, round(w,7) as w from w")
def agg12(spark, sf):
    return A.variance_components(scene_deltas(spark, sf), ["sensor"]).select("sensor", day_text().alias("day"), F.round("tau2", 5).alias("tau2"), F.round("w", 7).alias("w"))


@query("agg13_loo_constant", _VC + """, f as (select sensor, sum(w*delta)/sum(w) as a, sum(w) as sw from w group by sensor)
  select w.sensor, round(max(a),6) as a, round(sqrt(avg(pow((delta - a)/greatest(1 - w.w/sw, 1e-8),2))),6) as loo from w join f on w.sensor = f.sensor group by w.sensor""")
def agg13(spark, sf):
    v = A.variance_components(scene_deltas(spark, sf), ["sensor"]).withColumn("r", A.loo_rmse_constant(F.col("delta"), F.col("w"), Window.partitionBy("sensor")))
    return v.groupBy("sensor").agg(r6(F.sum(F.col("w") * F.col("delta")) / F.sum("w")).alias("a"), r6(F.sqrt(F.avg(F.col("r") * F.col("r")))).alias("loo"))


@query("agg14_anomaly_slopes", _VIEW + """, a as (select sensor, x - avg(x) over (partition by sensor, day) as xa, y - avg(y) over (partition by sensor, day) as ya from q)
  select sensor, round(regr_slope(ya, xa),6) as ols, round(sign(corr(xa,ya))*stddev_pop(ya)/stddev_pop(xa),6) as rma, round(corr(xa,ya),6) as r from a group by sensor""")
def agg14(spark, sf):
    w = Window.partitionBy("sensor", "day")
    a = pairs(spark, sf).select("sensor", (F.col("x") - F.avg("x").over(w)).alias("xa"), (F.col("y") - F.avg("y").over(w)).alias("ya"))
    return a.groupBy("sensor").agg(*(r6(c).alias(k) for k, c in A.slopes(F.col("xa"), F.col("ya")).items()))


@query("agg15_absolute_slopes", _VIEW + """, s as (select sensor, day, median(x) as x, median(y) as y from q group by sensor, day), p as (select sensor, median(x) as x0 from s group by sensor)
  select s.sensor, round(regr_slope(y, x),6) as ols, round(sign(corr(x,y))*stddev_pop(y)/stddev_pop(x),6) as rma, round(avg(y) - sign(corr(x,y))*stddev_pop(y)/stddev_pop(x)*avg(x - x0) - max(x0),5) as off from s join p on s.sensor = p.sensor group by s.sensor""")
def agg15(spark, sf):
    s = pairs(spark, sf).groupBy("sensor", "day").agg(F.median("x").alias("x"), F.median("y").alias("y"))
    s = s.join(s.groupBy("sensor").agg(F.median("x").alias("x0")), "sensor")
    k = A.slopes(F.col("x"), F.col("y"))
    return s.groupBy("sensor").agg(r6(k["ols"]).alias("ols"), r6(k["rma"]).alias("rma"), F.round(F.avg("y") - k["rma"] * F.avg(F.col("x") - F.col("x0")) - F.max("x0"), 5).alias("off"))


@query("agg16_theil_sen", _VIEW + """, s as (select sensor, day, median(x) as x, median(y) as y from q group by sensor, day)
  select a.sensor, round(median((b.y - a.y)/(b.x - a.x)),5) as slope from s a join s b on a.sensor = b.sensor and a.day < b.day and a.x <> b.x group by a.sensor""")
def agg16(spark, sf):
    s = pairs(spark, sf).groupBy("sensor", "day").agg(F.median("x").alias("x"), F.median("y").alias("y"))
    return A.theil_sen(s, ["sensor"], "x", "y", key="day").select("sensor", F.round("slope", 5).alias("slope"))


@query("agg17_slope_pivot", _VIEW + " select sensor, round(median(x) filter (where abs(y - x) < 40),4) as pivot from q group by sensor")
def agg17(spark, sf):
    return pairs(spark, sf).groupBy("sensor").agg(F.round(F.median(F.when(F.abs(F.col("y") - F.col("x")) < 40, F.col("x"))), 4).alias("pivot"))


@query("agg18_harmonic_fit", """, d as (select l_suppkey as px, l_extendedprice/1000 as y, cos(2*pi()*(dayofyear(l_shipdate)-1)/365.25) as c, sin(2*pi()*(dayofyear(l_shipdate)-1)/365.25) as s from lineitem),
  e as (select px, count(*) as n, sum(c) as b, sum(s) as cc, sum(c*c) as d, sum(c*s) as e, sum(s*s) as f, sum(y) as u, sum(c*y) as v, sum(s*y) as w from d group by px),
  t as (select *, n*(d*f - e*e) - b*(b*f - e*cc) + cc*(b*e - d*cc) as det from e)
  select px, n, round((u*(d*f - e*e) - b*(v*f - e*w) + cc*(v*e - d*w))/det,4) as mean, round((n*(v*f - e*w) - u*(b*f - e*cc) + cc*(b*w - v*cc))/det,4) as cos1,
  round((n*(d*w - v*e) - b*(b*w - v*cc) + u*(b*e - d*cc))/det,4) as sin1 from t where n >= 10""")
def agg18(spark, sf):
    x = table(spark, sf, "lineitem")
    eq = A.normal_equations(x.withColumnRenamed("l_suppkey", "px"), ["px"], S.harmonics(F.dayofyear("l_shipdate") - 1, 1, 365.25), F.col("l_extendedprice") / 1000)
    return A.solve3(eq, ["px"], ["mean", "cos1", "sin1"], 10).where("full").select("px", "n", *(F.round(k, 4).alias(k) for k in ("mean", "cos1", "sin1")))


@query("agg20_roughness", """, c as (select px // 15 as row, px % 15 as col, avg(value) as v, stddev_samp(value)/sqrt(count(*)) as se from obs group by px),
  n as (select a.row, a.col, max(a.v) as v, avg(b.v) as near from c a join c b on abs(a.row-b.row) + abs(a.col-b.col) = 1 group by a.row, a.col)
  select round(median(abs(n.v - n.near)),5) as rough, round((select median(se) from c),5) as se from n""")
def agg20(spark, sf):
    c = obs(spark, sf).groupBy("row", "col").agg(F.avg("value").alias("value"), (F.stddev_samp("value") / F.sqrt(F.count("*"))).alias("se"))
    n = G.neighbour_mean(c.withColumn("layer", F.lit(0)), ["layer"])
    return n.agg(F.round(F.median(F.when(F.col("near_n") > 0, F.abs(F.col("value") - F.col("near_mean")))), 5).alias("rough"), F.round(F.median("se"), 5).alias("se"))


@query("agg21_box_mean", "select a.sensor, cast(a.day as varchar) as day, a.px, count(*) as n, round(avg(b.value),6) as mean from obs a join obs b on a.sensor = b.sensor and a.day = b.day and abs(a.row-b.row) <= 1 and abs(a.col-b.col) <= 1 group by a.sensor, a.day, a.px")
def agg21(spark, sf):
    return G.box_mean(obs(spark, sf), ["sensor", "day"], 3).select("sensor", day_text().alias("day"), "px", F.col("box_n").alias("n"), r6("box_mean").alias("mean"))


@query("agg22_station_boxes", "select s.px as station, cast(o.day as varchar) as day, count(*) as n, round(avg(o.value),6) as mean from (select distinct px, row, col from obs) s join obs o on abs(o.row - s.row) <= 2 and abs(o.col - s.col) <= 2 and o.water and o.sensor = 'view' group by s.px, o.day")
def agg22(spark, sf):
    o = obs(spark, sf)
    near = F.explode(F.expr("flatten(transform(sequence(-2, 2), a -> transform(sequence(-2, 2), b -> struct(row + a as row, col + b as col))))")).alias("at")
    s = o.select(F.col("px").alias("station"), "row", "col").distinct().select("station", near).select("station", "at.row", "at.col")
    w = o.where("water and sensor = 'view'").select("day", "row", "col", "value")
    return w.join(s, ["row", "col"]).groupBy("station", "day").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean")).withColumn("day", day_text())


@query("agg23_flip_fraction", "select sensor, round(count(*) filter (where (k > 80) <> (value > 100))/cast(count(*) as double),6) as flips from obs where water group by sensor")
def agg23(spark, sf):
    return R.flip_fraction(obs(spark, sf).where("water"), ["sensor"], F.col("k") > 80, F.col("value") > 100).select("sensor", r6("flips").alias("flips"))


_CHANCE = "(avg(a::int)*avg(b::int) + (1-avg(a::int))*(1-avg(b::int)))"
_KAPPA = f"case when {_CHANCE} >= 1 then 1.0 else (avg((a = b)::int) - {_CHANCE})/(1 - {_CHANCE}) end"


@query("agg24_kappa", f"q as (select sensor, k > 60 as a, value > 40 as b from ev) select sensor, round({_KAPPA},6) as kappa from q group by sensor")
def agg24(spark, sf):
    return events(spark, sf).groupBy("sensor").agg(r6(A.kappa(F.col("k") > 60, F.col("value") > 40)).alias("kappa"))


@query("agg25_auc", """, s as (select d.n_chars as score, l.quality = 1 as pos from documents d join labels l on d.doc_id = l.doc_id),
  r as (select pos, rank() over (order by score) + (count(*) over (partition by score) - 1)/2.0 as rk from s)
  select round((sum(rk) filter (where pos) - count(*) filter (where pos)*(count(*) filter (where pos)+1)/2.0)/(count(*) filter (where pos)*count(*) filter (where not pos)),6) as auc from r""")
def agg25(spark, sf):
    s = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(F.col("n_chars").alias("score"), (F.col("quality") == 1).alias("pos"), F.lit(0).alias("g"))
    return A.auc(s, ["g"], "score", "pos").select(r6("auc").alias("auc"))


@query("agg26_scene_agreement", f"""q as (select sensor, day, k <= 60 as a, value < 100 as b from ev)
  select sensor, cast(day as varchar) as day, count(*) as n, round(avg((a = b)::int),6) as agree, round({_KAPPA},6) as kappa, count(*) filter (where a and not b) as only_a, count(*) filter (where b and not a) as only_b from q group by sensor, day""")
def agg26(spark, sf):
    out = R.agreement(events(spark, sf), ["sensor", "day"], F.col("k") <= 60, F.col("value") < 100)
    return out.select("sensor", day_text().alias("day"), "n", r6("agree").alias("agree"), r6("kappa").alias("kappa"), "only_a", "only_b")


@query("agg27_busiest_outliers", """q as (select sensor, day, count(*) as n, round(median(value) filter (where k <= 80),4) as kept, round(median(value) filter (where k > 80),4) as removed, row_number() over (partition by sensor order by count(*) desc, day) as r from ev group by sensor, day)
  select sensor, cast(day as varchar) as day, n, kept, removed from q where r <= 5""")
def agg27(spark, sf):
    out = R.busiest_outliers(events(spark, sf), "sensor", "day", "value", F.col("k") <= 80, 5)
    return out.select("sensor", day_text().alias("day"), "n", F.round("kept", 4).alias("kept"), F.round("removed", 4).alias("removed"))


@query("agg28_held_days", _VIEW + """, d as (select sensor, day, count(*) as n, avg(y-x) as bias, sqrt(avg((y-x)*(y-x))) as rmse from q where day(day) % 7 = 0 group by sensor, day)
  select sensor, sum(n)::bigint as n, round(sum(n*bias)/sum(n),6) as bias, round(sqrt(sum(n*rmse*rmse)/sum(n)),6) as pooled from d group by sensor""")
def agg28(spark, sf):
    out = R.held_days(pairs(spark, sf).where(F.dayofmonth("day") % 7 == 0), "sensor", "day")
    return out.select("sensor", "n", r6("bias").alias("bias"), r6("pooled").alias("pooled"))


@query("agg30_validation_dates", "select distinct cast(day as varchar) as day from (select sensor, day from obs where sensor <> 'view' and water group by sensor, day having count(*)/(select count(distinct px) from obs where water) > 0.35)")
def agg30(spark, sf):
    n = F.lit(water_cells(spark, sf).first()[0])
    return R.eligible_days(obs(spark, sf).where("sensor <> 'view' and water"), n, 0.35).select(day_text().alias("day"))


@query("agg31_within_scene", _VIEW + """, a as (select sensor, day, y, x - avg(x) over (partition by sensor, day) as xa, y - avg(y) over (partition by sensor, day) as ya from q), s as (select sensor, day, stddev_samp(y) as sd from q group by sensor, day)
  select a.sensor, round(corr(xa,ya),6) as r, round(regr_slope(ya,xa),6) as ols, round((select median(sd) from s where s.sensor = a.sensor),5) as sd from a group by a.sensor""")
def agg31(spark, sf):
    out = R.within_scene(pairs(spark, sf), "sensor", "day")
    return out.select("sensor", r6("r").alias("r"), r6("ols").alias("ols"), F.round("sd", 5).alias("sd"))


@query("agg32_aic", _VIEW + ", s as (select sensor, count(*) as n, sum(pow(y - x - m, 2)) as rss from (select *, avg(y-x) over (partition by sensor) as m from q) group by sensor) select sensor, round(n*ln(rss/n) + 2,5) as aic from s")
def agg32(spark, sf):
    e = F.col("y") - F.col("x")
    s = pairs(spark, sf).groupBy("sensor").agg(F.count("*").alias("n"), (F.var_pop(e) * F.count("*")).alias("rss"))
    return s.select("sensor", F.round(S.aic(F.col("rss"), F.col("n"), 1), 5).alias("aic"))


@query("agg33_flag_changes", "select sensor, i, count(*) filter (where (k >> (i-1)) & 1 = 1 and (k >> i) & 1 = 0) as flagged, count(*) filter (where (k >> (i-1)) & 1 = 0 and (k >> i) & 1 = 1) as restored from obs, (select cast(unnest([1,2,3,4,5]) as bigint) as i) group by sensor, i")
def agg33(spark, sf):
    return R.flag_changes(obs(spark, sf), ["sensor"], "k", 5)


@query("agg34_removal_shares", "select px, round(avg((k > 60)::int),6) as a, round(avg((value > 60)::int),6) as b, round(avg((k > 60)::int) - avg((value > 60)::int),6) as diff from obs group by px")
def agg34(spark, sf):
    out = R.removal_shares(obs(spark, sf), ["px"], F.col("k") > 60, F.col("value") > 60)
    return out.select("px", r6("a").alias("a"), r6("b").alias("b"), r6("diff").alias("diff"))


@query("agg35_verdict_crosstab", "select sensor, k <= 60 as first, count(*) filter (where value < 60) as kept, count(*) filter (where value >= 60) as removed from obs group by sensor, k <= 60")
def agg35(spark, sf):
    return R.verdict_crosstab(obs(spark, sf), ["sensor"], F.col("k") <= 60, F.col("value") < 60)


@query("agg36_coverage", "select cast(day as varchar) as day, count(distinct px) filter (where sensor='view') as view_px, round(count(distinct px)/(select count(distinct px) from obs where water),6) as share, bool_and(sensor = 'view') as reference_only from obs where water group by day")
def agg36(spark, sf):
    n = F.lit(water_cells(spark, sf).first()[0])
    out = R.coverage(obs(spark, sf).where("water"), n, "view")
    return out.select(day_text().alias("day"), F.col("reference_px").alias("view_px"), r6("share").alias("share"), "reference_only")


@query("agg37_pooled_bias", _VIEW + ", s as (select sensor, day, median(y-x) as off from q group by sensor, day) select q.sensor, round(avg(y-x),6) as before, round(avg(y-off-x),5) as after from q join s on q.sensor=s.sensor and q.day=s.day group by q.sensor")
def agg37(spark, sf):
    return R.pooled_bias(pairs(spark, sf), "sensor", "day").select("sensor", r6("before").alias("before"), F.round("after", 5).alias("after"))


@query("agg38_cv_gain", "q as (select k % 6 as t_c, sqrt(avg((value-50)*(value-50))) as rmse from ev group by k % 6) select t_c, round(100*(1 - rmse/(select rmse from q where t_c = 0)),5) as gain from q")
def agg38(spark, sf):
    d = F.col("value") - 50
    x = events(spark, sf).groupBy((F.col("k") % 6).alias("t_c")).agg(F.sqrt(F.avg(d * d)).alias("rmse"))
    return R.cv_gain(x, "t_c", "rmse").select("t_c", F.round("gain", 5).alias("gain"))


@query("win01_anomalies", _VIEW + " select sensor, cast(day as varchar) as day, px, round(x - avg(x) over (partition by sensor, day) + 1e-8,6) as xa, round(y - median(y) over (partition by sensor, day),4) as ya from q")
def win01(spark, sf):
    w = Window.partitionBy("sensor", "day")
    return pairs(spark, sf).select("sensor", day_text().alias("day"), "px", r6(F.col("x") - F.avg("x").over(w) + 1e-8).alias("xa"), F.round(F.col("y") - F.median("y").over(w), 4).alias("ya"))


@query("win02_neighbours", """select a.sensor, cast(a.day as varchar) as day, a.px, count(b.px) as n, round(coalesce(avg(b.value), 0.5),6) as mean
  from obs a left join obs b on a.sensor=b.sensor and a.day=b.day and abs(a.row-b.row)+abs(a.col-b.col)=1 group by a.sensor, a.day, a.px""")
def win02(spark, sf):
    return G.neighbour_mean(obs(spark, sf), ["sensor", "day"]).select("sensor", day_text().alias("day"), "px", F.col("near_n").alias("n"), r6("near_mean").alias("mean"))


_SWEEP = """select px, t, v + coalesce((coalesce(0.2*(lead(v) over w - v)/(lead(t) over w - t),0) - coalesce(0.2*(v - lag(v) over w)/(t - lag(t) over w),0))
  / ((coalesce(t - lag(t) over w, lead(t) over w - t) + coalesce(lead(t) over w - t, t - lag(t) over w))/2.0),0) as v from {} window w as (partition by px order by t)"""


@query("win03_time_diffusion", f"""q as (select px, cast(date_diff('day', date '2024-01-01', day) as double) as t, avg(value) as v from obs group by px, day),
  a as ({_SWEEP.format('q')}), b as ({_SWEEP.format('a')}) select px, t, round(v + 1e-8,6) as value from b""")
def win03(spark, sf):
    x = obs(spark, sf).groupBy("px", "day").agg(F.avg("value").alias("value")).select("px", F.date_diff(F.col("day"), F.lit("2024-01-01").cast("date")).cast("double").alias("t"), "value")
    return G.diffuse_time(x, ["px"], 0.2, 2).select("px", "t", r6(F.col("value") + 1e-8).alias("value"))


@query("win04_space_diffusion", """select a.sensor, cast(a.day as varchar) as day, a.px, round(a.value + 0.1*coalesce(sum(b.value - a.value),0),6) as value
  from obs a left join obs b on a.sensor=b.sensor and a.day=b.day and abs(a.row-b.row)+abs(a.col-b.col)=1 group by a.sensor, a.day, a.px, a.value""")
def win04(spark, sf):
    return G.diffuse_space(obs(spark, sf), ["sensor", "day"], 0.1).select("sensor", day_text().alias("day"), "px", r6("value").alias("value"))


@query("win05_first_available", "select cast(day as varchar) as day, px, arg_min(sensor, case sensor when 'view' then 0 when 'click' then 1 else 2 end) as source, round(arg_min(value, case sensor when 'view' then 0 when 'click' then 1 else 2 end),6) as value from obs group by day, px")
def win05(spark, sf):
    out = R.first_available(obs(spark, sf), ["day", "px"], "sensor", ["view", "click"], "value")
    return out.select(day_text().alias("day"), "px", "source", r6("value").alias("value"))


@query("win06_flips", "select sensor, cast(day as varchar) as day, sum(bit_count((xor(k, k >> 1)) & 31))::bigint as flips from obs group by sensor, day")
def win06(spark, sf):
    return R.verdict_flips(obs(spark, sf), ["sensor", "day"], "k", 5).withColumn("day", day_text())


@query("win07_windows", """, d as (select day, row_number() over (order by day) - 1 as i, count(*) over () as n from (select distinct day from obs)), w as (select unnest(range(0, cast(ceil(max(n)/10.0) as bigint))) as w from d)
  select w.w as window_id, count(*) as n, count(*) filter (where d.i >= 10*w.w and d.i < 10*w.w + 10) as own from w join d on d.i >= 10*w.w - 3 and d.i < 10*w.w + 13 join obs o on o.day = d.day group by w.w""")
def win07(spark, sf):
    from brineloom.operators.loop import windows

    o = obs(spark, sf)
    days = [r["day"] for r in o.select("day").distinct().orderBy("day").collect()]  # the record's days
    own = [(i, d, d in set(central)) for i, (every, central) in enumerate(windows(days, 10, 3)) for d in every]
    j = o.join(F.broadcast(spark.createDataFrame(own, "window_id long, day date, own boolean")), "day")
    return j.groupBy("window_id").agg(F.count("*").alias("n"), F.count_if("own").alias("own"))


@query("win08_limits", "select sensor, round(quantile_cont(value, 0.01),5) as p1, round(quantile_cont(value, 0.02),5) as p2, round(quantile_cont(value, 0.98),5) as p98, round(quantile_cont(value, 0.995),5) as p995 from ev group by sensor")
def win08(spark, sf):
    p = F.percentile("value", F.array(*map(F.lit, (0.01, 0.02, 0.98, 0.995))))
    return events(spark, sf).groupBy("sensor").agg(p.alias("p")).select("sensor", *(F.round(F.col("p")[i], 5).alias(n) for i, n in enumerate(("p1", "p2", "p98", "p995"))))


@query("win09_contraction", """q as (select sensor, date_diff('day', date '2024-01-01', day) as i, sum(value)/1000 as delta from ev group by sensor, day)
  select sensor, i, round(delta/lag(delta) over (partition by sensor order by i),6) as ratio, round(avg(delta) over (partition by sensor order by i rows between 4 preceding and current row),6) as smooth from q""")
def win09(spark, sf):
    q = events(spark, sf).groupBy("sensor", "day").agg((F.sum("value") / 1000).alias("delta")).select("sensor", F.date_diff(F.col("day"), F.lit("2024-01-01").cast("date")).cast("long").alias("i"), "delta")
    return R.contraction(q, "sensor", "i", "delta", 5).select("sensor", "i", r6("ratio").alias("ratio"), r6("smooth").alias("smooth"))


@query("top01_parsimonious", "q as (select k % 20 as kk, stddev_pop(value) as rmse from ev group by k % 20) select min(kk) as k, arg_min(kk, rmse) as best from q where rmse <= (select min(rmse) from q)*1.2 ")
def top01(spark, sf):
    q = events(spark, sf).groupBy((F.col("k") % 20).alias("kk")).agg(F.stddev_pop("value").alias("rmse"))
    return R.parsimonious(q, "kk", "rmse", 0.2)


_RANKED = "q as (select sensor, day, count(*) as n, row_number() over (partition by sensor order by count(*) desc, day) as r from ev where sensor in ('click','purchase','view') group by sensor, day)"


@query("top02_round_robin", _RANKED + " select sensor, cast(day as varchar) as day, n from q order by r, sensor limit 8")
def top02(spark, sf):
    x = events(spark, sf).where("sensor in ('click', 'purchase', 'view')")
    return R.round_robin(x, "sensor", "day", 8).withColumn("day", day_text())


@query("top03_field_days", """q as (select day, count(*) as n from obs group by day), m as (select median(n) as med from q)
  (select 'busiest' as kind, cast(day as varchar) as day from q order by n desc, day limit 3) union (select 'typical', cast(day as varchar) from q, m order by abs(n - med), day limit 3) union (select 'emptiest', cast(day as varchar) from q order by n, day limit 3)""")
def top03(spark, sf):
    return R.field_days(obs(spark, sf), "day", 3).select("kind", day_text().alias("day")).distinct()


@query("top04_strip_scenes", """q as (select sensor, day, count(*) as n, count(*) filter (where (k > 60) <> (value > 60)) as dis from obs group by sensor, day)
  select distinct sensor, cast(day as varchar) as day from (select *, row_number() over (partition by sensor order by n desc, day) as a, row_number() over (partition by sensor order by dis desc, day) as b from q) where a <= 3 or b <= 3""")
def top04(spark, sf):
    return R.strip_scenes(obs(spark, sf), "sensor", "day", (F.col("k") > 60) != (F.col("value") > 60), 3).withColumn("day", day_text())


@query("top05_worst_scenes", _DELTA + " select sensor, cast(day as varchar) as day, round(delta,4) as delta from s order by abs(delta) desc, sensor, day limit 10")
def top05(spark, sf):
    return R.worst(scene_deltas(spark, sf), "delta", 10, ["sensor", "day"]).select("sensor", day_text().alias("day"), F.round("delta", 4).alias("delta"))


@query("top06_sheet_order", _RANKED + " select cast(row_number() over (order by n desc, sensor, day) as bigint) as place, sensor, cast(day as varchar) as day, n from q where r <= 4")
def top06(spark, sf):
    x = R.busiest(events(spark, sf).where("sensor in ('click', 'purchase', 'view')"), "sensor", "day", 4)
    return R.sheet_order(x, "sensor", "day", "n").select("place", "sensor", day_text().alias("day"), "n")


@query("set01_union_all", "select sensor, count(*) as n from (select * from obs where sensor = 'view' union all select * from obs where sensor = 'click' union all select * from obs where sensor = 'view') group by sensor")
def set01(spark, sf):
    o = obs(spark, sf)
    v = o.where("sensor = 'view'")
    return v.unionByName(o.where("sensor = 'click'")).unionByName(v).groupBy("sensor").agg(F.count("*").alias("n"))


@query("set02_union_distinct", "select cast(day as varchar) as day from (select day from ev where k > 98 union select day from ev where value > 400)")
def set02(spark, sf):
    e = events(spark, sf)
    return e.where("k > 98").select(day_text().alias("day")).union(e.where("value > 400").select(day_text().alias("day"))).distinct()


@query("set03_except", "select px from (select px from obs where sensor = 'view' except select px from obs where sensor = 'click' and value > 150)")
def set03(spark, sf):
    o = obs(spark, sf)
    return o.where("sensor = 'view'").select("px").subtract(o.where("sensor = 'click' and value > 150").select("px"))


@query("set04_intersect", "select cast(day as varchar) as day, px from (select day, px from obs where sensor = 'view' intersect select day, px from obs where sensor = 'click')")
def set04(spark, sf):
    o = obs(spark, sf)
    return o.where("sensor = 'view'").select("day", "px").intersect(o.where("sensor = 'click'").select("day", "px")).withColumn("day", day_text())


@query("set05_distinct", "select distinct sensor, px % 8 as station from obs")
def set05(spark, sf):
    return obs(spark, sf).select("sensor", (F.col("px") % 8).alias("station")).dropDuplicates()


@query("fig01_clipped_histogram", "select least(greatest(cast(floor((value - 10)/9.0) as bigint), 0), 9) as bin, count(*) filter (where k <= 80) as kept, count(*) filter (where k > 80) as removed from ev group by 1")
def fig01(spark, sf):
    kept = F.col("k") <= 80
    return events(spark, sf).groupBy(A.histogram(F.col("value"), 10.0, 100.0, 10).alias("bin")).agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("removed"))


@query("fig02_density", _VIEW + " select sensor, cast(floor(x/20) as bigint) as xb, cast(floor(y/20) as bigint) as yb, count(*) as n from q group by 1, 2, 3")
def fig02(spark, sf):
    return pairs(spark, sf).groupBy("sensor", F.floor(F.col("x") / 20).alias("xb"), F.floor(F.col("y") / 20).alias("yb")).agg(F.count("*").alias("n"))


@query("fig03_coverage_by_set", "select cast(day as varchar) as day, src, count(*) as n from (select day, px, bit_or(case sensor when 'view' then 1 when 'click' then 2 else 4 end)::int as src from obs group by day, px) group by day, src")
def fig03(spark, sf):
    s = F.col("sensor")
    x = obs(spark, sf).groupBy("day", "px").agg(F.bit_or(F.when(s == "view", 1).when(s == "click", 2).otherwise(4)).alias("src"))
    return x.groupBy("day", "src").agg(F.count("*").alias("n")).withColumn("day", day_text())
