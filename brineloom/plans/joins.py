"""Matchup queries, sources and sinks that SQL can check."""

from __future__ import annotations

from pyspark.sql import functions as F

from brineloom.operators import filters as X
from brineloom.operators import joins as J
from brineloom.operators import stencil as G
from brineloom.operators.stats import normal_equations, solve3
from brineloom.functions import scalars as S
from brineloom.plans.base import BASE, day_text, events, grid_rows, obs, r6
from brineloom.sources.tables import table

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = f"with {BASE}, {sql}" if sql.lstrip().startswith("q as") else f"with {BASE} {sql}"
        return fn

    return add


def members(spark, sf):
    o = obs(spark, sf)
    return o.where("sensor <> 'view'"), o.where("sensor = 'view'")


_PAIRS = "q as (select m.sensor, m.day, m.px, r.value as ref, m.value, count(*) over (partition by m.sensor, m.day) as n from obs m join obs r on m.day = r.day and m.px = r.px and r.sensor = 'view' where m.sensor <> 'view')"


@query("join01_pixel_matchups", _PAIRS + " select sensor, cast(day as varchar) as day, px, round(ref,6) as ref, round(value,6) as value from q where n >= 18")
def join01(spark, sf):
    return J.pixel_matchups(*members(spark, sf), 18).select("sensor", day_text().alias("day"), "px", r6("ref").alias("ref"), r6("value").alias("value"))


_FP = """q as (select day, px, px // 10 as fp, cast(px // 10 as double) as ref from obs where sensor = 'view'),
  c as (select day, fp, count(*) as n_cells, max(ref) as ref from q group by day, fp),
  m as (select o.sensor, o.day, q.fp, count(*) as n_sensor, median(o.value) as value from obs o join q on o.day = q.day and o.px = q.px where o.sensor <> 'view' group by 1, 2, 3),
  f as (select m.*, c.n_cells, c.ref from m join c on m.day = c.day and m.fp = c.fp where n_cells >= 3 and n_sensor >= 0.5*n_cells)"""


def _footprints(spark, sf):
    m, r = members(spark, sf)
    fp = F.expr("px div 10")
    return m, r.select("day", "px", fp.alias("fp"), fp.cast("double").alias("ref"))


@query("join02_footprints", _FP + " select sensor, cast(day as varchar) as day, fp, ref, n_cells, n_sensor, round(value,4) as value from f")
def join02(spark, sf):
    out = J.footprint_matchups(*_footprints(spark, sf), 3, 0.5)
    return out.select("sensor", day_text().alias("day"), "fp", "ref", "n_cells", "n_sensor", F.round("value", 4).alias("value"))


@query("join03_all_pairs", _FP + ", p as (select *, count(*) over (partition by sensor, day) as k from f) select sensor, count(*) as n, round(avg(value - ref),5) as mean from p where k >= 4 group by sensor")
def join03(spark, sf):
    out = J.footprint_matchups(*_footprints(spark, sf), 3, 0.5, 4)
    return out.groupBy("sensor").agg(F.count("*").alias("n"), F.round(F.avg(F.col("value") - F.col("ref")), 5).alias("mean"))


_NEAR = """q as (select event_id, px % 8 as station, ts as target from ev where sensor = 'signup'), o as (select px % 8 as station, ts, value from ev where sensor = 'error'),
  b as (select q.event_id, o.ts, o.value, cast(floor(abs(epoch_us(o.ts) - epoch_us(q.target))/1000000) as bigint) as dt, row_number() over (partition by q.event_id order by cast(floor(abs(epoch_us(o.ts) - epoch_us(q.target))/1000000) as bigint), o.ts > q.target, case when o.ts > q.target then epoch_us(o.ts) else -epoch_us(o.ts) end) as r
        from q join o on q.station = o.station and abs(epoch(o.ts) - epoch(q.target)) <= 3700)
  select station, cast(target as varchar) as target, round(value,6) as value, dt from b join q on b.event_id = q.event_id where r = 1 and dt <= 3600"""


def _stations(spark, sf):
    e = events(spark, sf).withColumn("station", F.col("px") % 8)
    return e.where("sensor = 'signup'").select("station", F.col("ts").alias("target")), e.where("sensor = 'error'").select("station", "ts", "value")


@query("join04_nearest_in_time", _NEAR)
def join04(spark, sf):
    out = J.nearest_in_time(*_stations(spark, sf), ["station"], 3600)
    return out.select("station", F.col("target").cast("string").alias("target"), r6("value").alias("value"), "dt")


@query("join04_nearest_by_cells", _NEAR)
def join04b(spark, sf):
    out = J.nearest_by_cells(*_stations(spark, sf), ["station"], 3600)
    return out.select("station", F.col("target").cast("string").alias("target"), r6("value").alias("value"), "dt")


_DAYS = """q as (select sensor, day, case when day(day) % 4 <> 0 then round(avg(hr),2) end as hour from ev where sensor in ('click','purchase','view') group by sensor, day),
  m as (select sensor, median(hour) as med from q group by sensor)"""


@query("join05_overpass", _DAYS + " select q.sensor, cast(day as varchar) as day, cast(epoch(day) + round(coalesce(hour, med, 10.5)*3600) as bigint) as instant from q join m on q.sensor = m.sensor")
def join05(spark, sf):
    d = events(spark, sf).where("sensor in ('click', 'purchase', 'view')").groupBy("sensor", "day").agg(F.round(F.avg("hour"), 2).alias("h"))
    d = d.select("sensor", "day", F.when(F.dayofmonth("day") % 4 != 0, F.col("h")).alias("hour"))
    return J.overpass_instants(d, 10.5).select("sensor", day_text().alias("day"), F.unix_timestamp("target").alias("instant"))


@query("join06_daily_means", """q as (select px % 8 as station, day, avg(value) as v, count(distinct hour(ts))/24.0 as cov from ev where sensor = 'error' group by 1, 2)
  select station, cast(day as varchar) as day, case when cov >= 0.3 then round(v,6) end as value, round(cov,6) as coverage from q""")
def join06(spark, sf):
    o = _stations(spark, sf)[1]
    return J.daily_means(o, 0.3).select("station", day_text().alias("day"), r6("value").alias("value"), r6("coverage").alias("coverage"))


_PLACE = "q as (select s_suppkey as station, (s_acctbal + 1000)/1000 as x, (s_suppkey % 11) + 0.25 as y from supplier), c as (select distinct px, cast(row as double) as x, cast(col as double) as y from obs where water)"


def _places(spark, sf):
    p = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("station"), ((F.col("s_acctbal") + 1000) / 1000).alias("x"), ((F.col("s_suppkey") % 11) + 0.25).alias("y"))
    c = obs(spark, sf).where("water").select("px", F.col("row").cast("double").alias("x"), F.col("col").cast("double").alias("y")).distinct()
    return p, c


@query("join07_place_stations", _PLACE + """, d as (select station, px, sqrt((q.x-c.x)*(q.x-c.x)+(q.y-c.y)*(q.y-c.y)) as d from q, c),
  r as (select *, row_number() over (partition by station order by round(d,9), px) as k from d where d <= 1.5) select station, px, round(d,6) as distance from r where k = 1""")
def join07(spark, sf):
    p, c = _places(spark, sf)
    return J.nearest_cell(p, c, 1.5).select("station", "px", r6("distance").alias("distance"))


@query("join08_nearest_station", """q as (select s_suppkey as station, (s_acctbal + 1000)/1000 as x, (s_suppkey % 11) + 0.25 as y from supplier), p as (select px, cast(row as double) as x, cast(col as double) as y from (select distinct px, row, col from obs)),
  d as (select p.px as site, station, sqrt((q.x-p.x)*(q.x-p.x)+(q.y-p.y)*(q.y-p.y)) as d from q, p), r as (select *, row_number() over (partition by site order by round(d,9), station) as k from d where d <= 4) select site, station, round(d,6) as distance from r where k = 1""")
def join08(spark, sf):
    p, _ = _places(spark, sf)
    sites = obs(spark, sf).select(F.col("px").alias("site"), F.col("row").cast("double").alias("x"), F.col("col").cast("double").alias("y")).distinct()
    out = J.nearest_cell(sites, p.withColumnRenamed("station", "px"), 4.0, "site")
    return out.select("site", F.col("px").alias("station"), r6("distance").alias("distance"))


@query("join09_sample_products", "q as (select distinct px from obs) select q.px, cast(o.day as varchar) as day, round(avg(o.value),6) as filled, round(0.5*avg(o.value) + 20,6) as smooth from q join obs o on o.px = q.px group by q.px, o.day")
def join09(spark, sf):
    o = obs(spark, sf)
    s = o.select("px").distinct()
    return o.join(s, "px").groupBy("px", "day").agg(r6(F.avg("value")).alias("filled"), r6(F.avg("value") * 0.5 + 20).alias("smooth")).withColumn("day", day_text())


@query("join10_matchup_table", """q as (select px % 8 as station, day, avg(value) as v, count(distinct hour(ts))/24.0 as cov from ev where sensor = 'error' group by 1, 2), f as (select day, px % 8 as station, avg(value) as filled from obs where sensor = 'view' group by 1, 2)
  select q.station, cast(q.day as varchar) as day, 'daily_mean' as match, case when month(q.day) in (12,1,2) then 'DJF' when month(q.day) in (3,4,5) then 'MAM' when month(q.day) in (6,7,8) then 'JJA' else 'SON' end as season, round(v,6) as insitu, round(filled,6) as filled
  from q join f on q.day = f.day and q.station = f.station where cov >= 0.2""")
def join10(spark, sf):
    d = J.daily_means(_stations(spark, sf)[1], 0.2).where("value is not null")
    f = obs(spark, sf).where("sensor = 'view'").groupBy("day", (F.col("px") % 8).alias("station")).agg(F.avg("value").alias("filled"))
    x = d.join(f, ["station", "day"])
    return x.select("station", day_text().alias("day"), F.lit("daily_mean").alias("match"), S.season(F.month("day")).alias("season"), r6("value").alias("insitu"), r6("filled").alias("filled"))


@query("join11_interval_composite", """q as (select distinct day from obs where sensor = 'click' and day(day) % 3 = 0)
  select cast(q.day as varchar) as day, o.px, round(quantile_cont(o.value, 0.5),4) as value, count(*) as n from q join obs o on o.sensor = 'view' and abs(date_diff('day', q.day, o.day)) <= 2 group by q.day, o.px having count(*) >= 2""")
def join11(spark, sf):
    m, r = members(spark, sf)
    out = J.interval_composite(m.where("sensor = 'click'").where(F.dayofmonth("day") % 3 == 0), r, 2, 0.5, 2)
    return out.select(day_text().alias("day"), "px", F.round("value", 4).alias("value"), "n")


@query("join12_verdict_tables", """q as (select sensor, day, count(*) as n from obs group by sensor, day), a as (select sensor, day, 'KEPT' as v from q where n > 100), b as (select sensor, day, 'KEPT' as v from q where n % 2 = 0)
  select q.sensor, cast(q.day as varchar) as day, coalesce(a.v,'DROPPED') as first, coalesce(b.v,'DROPPED') as second from q left join a on q.sensor=a.sensor and q.day=a.day left join b on q.sensor=b.sensor and q.day=b.day""")
def join12(spark, sf):
    q = obs(spark, sf).groupBy("sensor", "day").agg(F.count("*").alias("n"))
    out = J.verdict_tables(q, {"first": q.where("n > 100"), "second": q.where("n % 2 = 0")})
    return out.select("sensor", day_text().alias("day"), "first", "second")


@query("join13_seasonal_field", """q as (select l_suppkey as px, count(*) as n, avg(l_extendedprice/1000) as mean from lineitem group by 1), d as (select distinct day from obs)
  select cast(day as varchar) as day, px, round(mean + 2*cos(2*pi()*(dayofyear(day)-1)/365.25) - 0.5*sin(2*pi()*(dayofyear(day)-1)/365.25),5) as seasonal from d, q""")
def join13(spark, sf):
    c = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("px")).agg(F.avg(F.col("l_extendedprice") / 1000).alias("mean"))
    out = J.seasonal_field(obs(spark, sf), c.withColumn("cos1", F.lit(2.0)).withColumn("sin1", F.lit(-0.5)), 365.25)
    return out.select(day_text().alias("day"), "px", F.round("seasonal", 5).alias("seasonal"))


@query("join14_donors", """q as (select day, count(*) as n from obs where sensor = 'view' group by day), d as (select a.day, b.day as donor from q a, q b where a.day <> b.day and b.n >= 0.5*a.n and b.n <= 0.95*a.n)
  select cast(d.day as varchar) as day, cast(d.donor as varchar) as donor, count(*) as n from d join obs o on o.day = d.day and o.sensor = 'view' where not exists (select 1 from obs g where g.day = d.donor and g.px = o.px and g.sensor = 'view') group by 1, 2""")
def join14(spark, sf):
    v = obs(spark, sf).where("sensor = 'view'").select("day", "px")
    d = J.donor_points(v.groupBy("day").agg(F.count("*").alias("n")), 0.5, 0.95)
    x = v.join(d, "day").join(v.select(F.col("day").alias("donor"), "px"), ["donor", "px"], "left_anti")
    return x.groupBy("day", "donor").agg(F.count("*").alias("n")).select(day_text().alias("day"), day_text("donor").alias("donor"), "n")


@query("join15_sensor_overlap", "select cast(a.day as varchar) as day, count(*) as n, round(avg(a.value - b.value) + 1e-8,6) as diff from obs a join obs b on a.day=b.day and a.px=b.px where a.sensor='click' and b.sensor='purchase' group by a.day having count(*) >= 5")
def join15(spark, sf):
    return J.sensor_overlap(obs(spark, sf), "click", "purchase", 5).select(day_text().alias("day"), "n", r6(F.col("diff") + 1e-8).alias("diff"))


@query("join16_common_points", "select count(*) as n, round(sum(a.value),4) as total from obs a join obs b on a.day=b.day and a.px=b.px and a.sensor='click' and b.sensor='view' and abs(a.value - b.value) < 5")
def join16(spark, sf):
    o = obs(spark, sf)
    x = J.common_points(o.where("sensor = 'click'"), o.where("sensor = 'view'"), 5.0)
    return x.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("join17_align_index", """q as (select day, cast(row_number() over (order by day) - 1 as bigint) as i from (select distinct day from obs)), s as (select day, sum(value) as v from obs where day(day) % 3 <> 0 group by day)
  select q.i, cast(q.day as varchar) as day, round(coalesce(s.v, 0),4) as v from q left join s on q.day = s.day""")
def join17(spark, sf):
    o = obs(spark, sf)
    s = o.where(F.dayofmonth("day") % 3 != 0).groupBy("day").agg(F.sum("value").alias("v"))
    return J.align_days(o, s, "v").select("i", day_text().alias("day"), F.round("v", 4).alias("v"))


@query("join18_site_series", "q as (select distinct px from obs where px in (7, 23, 88)) select o.px as site, cast(day as varchar) as day, sensor, round(value,6) as kelvin, round(value - 273.15,6) as celsius from obs o join q on o.px = q.px")
def join18(spark, sf):
    sites = spark.createDataFrame([(7,), (23,), (88,)], "px long")
    x = J.site_series(obs(spark, sf), sites)
    return x.select(F.col("px").alias("site"), day_text().alias("day"), "sensor", r6("value").alias("kelvin"), r6(F.col("value") - 273.15).alias("celsius"))


@query("src01_scan", """q as (select sensor, day from obs where day between date '2024-01-05' and date '2024-01-20' and water group by sensor, day having count(*) >= 45)
  select o.sensor, cast(o.day as varchar) as day, count(*) as n, count(*) filter (where value < 5 or value > 300 or k > 80) as flagged from obs o join q on o.sensor=q.sensor and o.day=q.day where water group by 1, 2""")
def src01(spark, sf):
    o = obs(spark, sf).where(F.col("day").between("2024-01-05", "2024-01-20") & F.col("water"))
    o = o.join(X.acquisitions(o, 45), ["sensor", "day"], "left_semi")
    bad = (F.col("value") < 5) | (F.col("value") > 300) | (F.col("k") > 80)
    return o.groupBy("sensor", "day").agg(F.count("*").alias("n"), F.count_if(bad).alias("flagged")).withColumn("day", day_text())


@query("src04_insitu_units", "select px % 8 as station, count(*) as n, round(avg(value - 273.15),6) as celsius from ev where sensor = 'error' and value is not null group by 1")
def src04(spark, sf):
    return _stations(spark, sf)[1].na.drop(subset=["ts", "value"]).groupBy("station").agg(F.count("*").alias("n"), r6(F.avg(F.col("value") - 273.15)).alias("celsius"))


@query("src10_offset_table", """q as (select sensor, day, avg(value) - 60 as off from obs where day(day) % 3 = 0 group by sensor, day), m as (select sensor, avg(off) as off_mean from q group by sensor), d as (select distinct day from obs)
  select m.sensor, cast(d.day as varchar) as day, round(coalesce(q.off, m.off_mean),6) as off from d cross join m left join q on q.sensor=m.sensor and q.day=d.day""")
def src10(spark, sf):
    o = obs(spark, sf)
    q = o.where(F.dayofmonth("day") % 3 == 0).groupBy("sensor", "day").agg((F.avg("value") - 60).alias("off"))
    m = q.groupBy("sensor").agg(F.avg("off").alias("off"))
    return J.offset_table(m, o, m, q).select("sensor", day_text().alias("day"), r6("off").alias("off"))


@query("src12_prior_masks", "select o.sensor, count(*) as n, count(*) filter (where m.px is not null) as kept from obs o left join (select distinct sensor, day, px from obs where k <= 70) m on o.sensor=m.sensor and o.day=m.day and o.px=m.px group by o.sensor")
def src12(spark, sf):
    o = obs(spark, sf)
    return J.with_prior_masks(o, o.where("k <= 70")).groupBy("sensor").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept"))


@query("src14_date_range", "select cast(day as varchar) as day, count(*) as n from ev where day between date '2024-01-10' and date '2024-01-12' group by day")
def src14(spark, sf):
    return events(spark, sf).where(F.col("day").between("2024-01-10", "2024-01-12")).groupBy("day").agg(F.count("*").alias("n")).withColumn("day", day_text())


@query("src15_acquisitions", "select sensor, cast(day as varchar) as day, count(*) as n_obs from obs where water group by sensor, day having count(*) >= 45")
def src15(spark, sf):
    return X.acquisitions(obs(spark, sf).where("water"), 45).select("sensor", day_text().alias("day"), "n_obs")


@query("src16_nearest_date", """q as (select day from (select distinct day from obs where sensor = 'view' and day(day) % 2 = 0) order by abs(date_diff('day', date '2024-01-15', day)), day limit 1)
  select cast(o.day as varchar) as day, px, round(value,6) as value, px % 7 < 2 as tidal from obs o join q on o.day = q.day where sensor = 'view' and water""")
def src16(spark, sf):
    o = obs(spark, sf).where("sensor = 'view'")
    x = J.nearest_day(o.where("water"), "2024-01-15", o.where(F.dayofmonth("day") % 2 == 0))
    return x.select(day_text().alias("day"), "px", r6("value").alias("value"), (F.col("px") % 7 < 2).alias("tidal"))


@query("src21_residuals", """q as (select px, avg(value) as base from obs where sensor = 'view' group by px)
  select o.sensor, count(*) as n, round(avg(o.value - 1.5 - q.base),6) as resid, round(stddev_pop(o.value - q.base),6) as sd from obs o join q on o.px=q.px where o.sensor <> 'view' group by o.sensor""")
def src21(spark, sf):
    m, r = members(spark, sf)
    out = J.residuals(m, r.groupBy("px").agg(F.avg("value").alias("base")), F.lit(1.5))
    return out.select("sensor", "n", r6("resid").alias("resid"), r6("sd").alias("sd"))


@query("snk11_cache_misses", "select sensor, cast(day as varchar) as day from obs where not (sensor = 'view' and day(day) < 10) group by sensor, day")
def snk11(spark, sf):
    want = obs(spark, sf).select("sensor", "day", F.sha2(F.lit("k=3"), 256).alias("cfg")).distinct()
    from brineloom.sources.sinks import wanted_not_cached

    have = want.where("sensor = 'view'").where(F.dayofmonth("day") < 10)
    return wanted_not_cached(want, have, ["sensor", "day", "cfg"]).select("sensor", day_text().alias("day"))


@query("snk12_upsert", """q as (select sensor, day, count(*) as n from obs group by sensor, day), u as (select sensor, day, n*10 as n from q where day(day) % 4 = 0)
  select sensor, cast(day as varchar) as day, n from (select q.* from q anti join u on q.sensor=u.sensor and q.day=u.day union all select * from u)""")
def snk12(spark, sf):
    from brineloom.sources.sinks import upsert

    q = obs(spark, sf).groupBy("sensor", "day").agg(F.count("*").alias("n"))
    return upsert(q, q.where(F.dayofmonth("day") % 4 == 0).withColumn("n", F.col("n") * 10), ["sensor", "day"]).select("sensor", day_text().alias("day"), "n")


@query("snk13_points_pivot", "select cast(day as varchar) as day, round(max(value) filter (where px = 7),6) as s7, round(max(value) filter (where px = 23),6) as s23 from (select day, px, avg(value) as value from obs where px in (7, 23) group by day, px) group by day")
def snk13(spark, sf):
    from brineloom.sources.sinks import wide_points

    x = obs(spark, sf).where("px in (7, 23)").groupBy("day", "px").agg(F.avg("value").alias("value"))
    return wide_points(x, [7, 23], "value", site="px").select(day_text().alias("day"), r6("`7`").alias("s7"), r6("`23`").alias("s23"))


@query("cli02_check", "select sensor, count(distinct day) as days, count(distinct day) >= 8 as enough, min(cast(day as varchar)) as first, max(cast(day as varchar)) as last from obs group by sensor")
def cli02(spark, sf):
    from brineloom.cli import sensor_report

    return sensor_report(obs(spark, sf)).select("sensor", "days", "enough", day_text("first").alias("first"), day_text("last").alias("last"))


@query("lin01_matrix", """q as (select day, px, avg(value) as z from obs where water group by day, px), d as (select day from q group by day having count(*) >= 60)
  select count(*) as n_values, count(distinct px) as m, count(distinct q.day) as n from q join d on q.day = d.day""")
def lin01(spark, sf):
    q = obs(spark, sf).where("water").groupBy("day", "px").agg(F.avg("value").alias("z"))
    d = q.groupBy("day").agg(F.count("*").alias("k")).where("k >= 60")
    return q.join(d, "day", "left_semi").agg(F.count("*").alias("n_values"), F.count_distinct("px").alias("m"), F.count_distinct("day").alias("n"))


@query("lin02_upsample", """, h as (select (max(row) + 1) // 4 as n from obs), q as (select day, row // 4 as r, col // 4 as c, avg(value) as v from obs, h where sensor = 'view' and row < 4*n and col < 12 group by 1, 2, 3)
  select cast(o.day as varchar) as day, o.px, round(q.v,6) as up from obs o cross join h left join q on q.day=o.day and q.r=least(o.row // 4, greatest(n - 1, 0)) and q.c=least(o.col // 4, 2) where o.sensor = 'view'""")
def lin02(spark, sf):
    o = obs(spark, sf).where("sensor = 'view'")
    n = grid_rows(spark, sf)
    b = G.block_mean(o, ["day"], 4, n, 15)
    return G.upsample(b, o, ["day"], 4, n, 15).select(day_text().alias("day"), "px", r6("up").alias("up"))


@query("lin03_gram", """q as (select vec_id, u.d as d, u.v as v from (select vec_id, unnest(list_transform(embedding, lambda x, i: {'d': i, 'v': x})) as u from embeddings))
  select a.d as i, b.d as j, round(sum(cast(a.v as double)*b.v),6) as g from q a join q b on a.vec_id = b.vec_id group by 1, 2""")
def lin03(spark, sf):
    from brineloom.operators.lowrank import gram

    x = table(spark, sf, "embeddings").select(F.col("embedding").cast("array<double>").alias("row"))
    return gram(x, "row", x.agg(F.max(F.size("row"))).first()[0] or 0).select("i", "j", r6("g").alias("g"))


@query("lin10_loadings", """q as (select px, (px % 7)/10.0 as u1, (px % 5)/10.0 as u2 from (select distinct px from obs)), j as (select o.day, u1, u2, o.value - 60 as x from obs o join q on o.px=q.px where o.sensor='view')
  select cast(day as varchar) as day, count(*) as n, round(sum(u1*u1),6) as a11, round(sum(u1*u2),6) as a12, round(sum(u2*u2),6) as a22, round(sum(u1*x),5) as b1, round(sum(u2*x),5) as b2 from j group by day""")
def lin10(spark, sf):
    o = obs(spark, sf).where("sensor = 'view'")
    eq = normal_equations(o, ["day"], {"u1": (F.col("px") % 7) / 10.0, "u2": (F.col("px") % 5) / 10.0}, F.col("value") - 60)
    return eq.select(day_text().alias("day"), "n", r6("a_u1_u1").alias("a11"), r6("a_u1_u2").alias("a12"), r6("a_u2_u2").alias("a22"), F.round("b_u1", 5).alias("b1"), F.round("b_u2", 5).alias("b2"))


@query("lin14_footprints", """q as materialized (select day, px, row, col, cast(floor(value/40) as integer) as v, row*1000003 + col as cell from obs where sensor = 'view'),
  e as materialized (select a.day, a.cell as x, b.cell as y from q a join q b on a.day=b.day and a.v=b.v and abs(a.row-b.row)+abs(a.col-b.col)=1),
  l as (with recursive r(day, root, cell) as (select day, cell, cell from q union select r.day, r.root, e.y from r join e on r.day=e.day and r.cell=e.x) select day, cell, min(root) as label from r group by day, cell)
  select cast(q.day as varchar) as day, q.px, l.label from q join l on q.day=l.day and q.cell=l.cell""")
def lin14(spark, sf):
    o = obs(spark, sf).where("sensor = 'view'").withColumn("v", F.floor(F.col("value") / 40).cast("int"))
    lab = G.components(o, ["day"], "v")
    return o.join(lab.select("day", "row", "col", "label"), ["day", "row", "col"]).select(day_text().alias("day"), "px", "label")


@query("lin15_ising_sweep", """q as (select sensor, day, row, col, px, (value - 60)/30 as u, 1/(1+exp(-(value-60)/30)) as q0 from obs),
  n as (select a.sensor, a.day, a.px, max(a.u) as u, max(a.q0) as q0, coalesce(avg(b.q0), 0.5) as nb from q a left join q b on a.sensor=b.sensor and a.day=b.day and abs(a.row-b.row)+abs(a.col-b.col)=1 group by 1, 2, 3)
  select sensor, cast(day as varchar) as day, px, round(0.5*q0 + 0.5/(1+exp(-(u + 1.5*(2*nb - 1)))),6) as q1 from n""")
def lin15(spark, sf):
    from brineloom.operators.detect import ising_scenes

    x = obs(spark, sf).withColumn("u", (F.col("value") - 60) / 30)
    q = ising_scenes(x, ["sensor", "day"], "u", beta=1.5, sweeps=1, damp=0.5)
    return q.select("sensor", day_text().alias("day"), F.expr("row * 15 + col").alias("px"), r6("q").alias("q1"))


@query("lin17_tukey", """q as (select sensor, day, px, value, value - 60 as r from obs where water), s as (select sensor, day, quantile_cont(r,0.25) as q1, quantile_cont(r,0.75) as q3, count(*) as n from q group by sensor, day)
  select q.sensor, cast(q.day as varchar) as day, count(*) filter (where n >= 20 and r < q1 - 1.5*(q3-q1)) as cold, count(*) filter (where n >= 20 and r > q3 + 1.5*(q3-q1)) as warm, round(max((q3-q1)/1.349),4) as sd from q join s on q.sensor=s.sensor and q.day=s.day group by 1, 2""")
def lin17(spark, sf):
    from brineloom.operators.detect import tukey

    x = obs(spark, sf).where("water").withColumn("r", F.col("value") - 60)
    t = tukey(x, ["sensor", "day"], "r", 1.5, 1.5, 20)
    return t.groupBy("sensor", "day").agg(F.count_if("cold").alias("cold"), F.count_if("warm").alias("warm"), F.round(F.max("sd"), 4).alias("sd")).withColumn("day", day_text())


@query("lin20_clip_rounds", """q as (select m.sensor, m.day, m.px, m.value - r.value as d, true as kept from obs m join obs r on m.day=r.day and m.px=r.px and r.sensor='view' where m.sensor <> 'view'),
  o1 as (select sensor, day, median(d) as off from q group by 1, 2), r1 as (select q.*, q.d - o1.off as r from q join o1 on q.sensor=o1.sensor and q.day=o1.day),
  m1 as (select sensor, median(r) as med from r1 group by 1), c1 as (select r1.*, r - med as rc from r1 join m1 on r1.sensor=m1.sensor), s1 as (select sensor, 1.4826*median(abs(rc)) as s from c1 group by 1),
  k1 as (select c1.sensor, c1.day, c1.px, c1.d, abs(rc) <= 1.5*s as kept from c1 join s1 on c1.sensor=s1.sensor),
  o2 as (select sensor, day, coalesce(median(d) filter (where kept), median(d)) as off from k1 group by 1, 2), r2 as (select k1.*, k1.d - o2.off as r from k1 join o2 on k1.sensor=o2.sensor and k1.day=o2.day),
  m2 as (select sensor, median(r) as med from r2 group by 1), c2 as (select r2.*, r - med as rc from r2 join m2 on r2.sensor=m2.sensor), s2 as (select sensor, 1.4826*median(abs(rc)) as s from c2 group by 1)
  select c2.sensor, count(*) as n, count(*) filter (where abs(rc) <= 1.5*s) as kept from c2 join s2 on c2.sensor=s2.sensor group by 1""")
def lin20(spark, sf):
    from brineloom.operators.offsets import clip_pairs

    p = J.pixel_matchups(*members(spark, sf)).select("sensor", "day", "px", F.col("ref").alias("x"), F.col("value").alias("y"))
    out = clip_pairs(p, 1.5, max_rounds=2)[0]
    return out.groupBy("sensor").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept"))


_SCENES = """q as (select m.sensor, m.day, median(m.value - r.value) as delta from obs m join obs r on m.day=r.day and m.px=r.px and r.sensor='view' where m.sensor <> 'view' group by 1, 2)"""


@query("lin22_loso_fixed", _SCENES + ", l as (select a.sensor, a.day, a.delta - avg(b.delta) as e from q a join q b on a.sensor=b.sensor and a.day <> b.day group by a.sensor, a.day, a.delta) select sensor, count(*) as n, round(sqrt(avg(e*e)),5) as rmse, round(avg(e),5) as bias from l group by 1")
def lin22(spark, sf):
    from brineloom.operators.offsets import loso_constant

    p = J.pixel_matchups(*members(spark, sf)).groupBy("sensor", "day").agg(F.median(F.col("value") - F.col("ref")).alias("delta"))
    return loso_constant(p, "sensor", "day", "delta").select("sensor", "n", F.round("rmse", 5).alias("rmse"), F.round("bias", 5).alias("bias"))


@query("lin24_site_offsets", """q as (select px % 8 as site, value - hr as e from ev where sensor = 'error'), s as (select site, count(*) as n, sum(e) as t, sum(e*e) as tt from q group by 1), a as (select sum(n) as n, sum(t) as t from s)
  select round((select avg(e) from q),6) as constant, round(sum(s.tt - 2*s.t*((a.t - s.t)/(a.n - s.n)) + s.n*pow((a.t - s.t)/(a.n - s.n),2))/max(a.n),4) as loso_mse from s, a""")
def lin24(spark, sf):
    from brineloom.operators.calibrate import loso_cv_constant

    e = events(spark, sf).where("sensor = 'error'").select((F.col("px") % 8).alias("site"), (F.col("value") - F.col("hour")).alias("e"))
    return loso_cv_constant(e, "site", "e").select(r6("constant").alias("constant"), F.round("loso_mse", 4).alias("loso_mse"))


@query("lin30_cv_lookup", "q as (select k % 6 as t_c, k % 5 as k, sqrt(avg(value*value)) as rmse from ev group by 1, 2) select round(rmse,6) as rmse from q where t_c = 4 and k = 2")
def lin30(spark, sf):
    q = events(spark, sf).groupBy((F.col("k") % 6).alias("t_c"), (F.col("k") % 5).alias("kk")).agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rmse"))
    return q.where("t_c = 4 and kk = 2").select(r6("rmse").alias("rmse"))


@query("lin21_offset_constant", _SCENES + ", w as (select sensor, delta, 1.0 + day(day) % 3 as w from q) select sensor, count(*) as n, round(sum(w*delta)/sum(w),5) as mean, 0 as harmonics from w group by sensor")
def lin21(spark, sf):
    from brineloom.operators.offsets import fit_offsets

    p = J.pixel_matchups(*members(spark, sf)).groupBy("sensor", "day").agg(F.median(F.col("value") - F.col("ref")).alias("delta"))
    p = p.select("sensor", F.lit(None).cast("double").alias("hour"), "delta", (1.0 + F.dayofmonth("day") % 3).alias("w"))
    fits = fit_offsets(p, harmonics=0, clip=(-500.0, 500.0))
    return fits.join(p.groupBy("sensor").agg(F.count("*").alias("n")), "sensor").select("sensor", "n", F.round("mean", 5).alias("mean"), "harmonics")


@query("agg29_holdout", """q as (select day, px, avg(value) as pred from obs where sensor <> 'view' group by day, px)
  select cast(o.day as varchar) as day, count(*) as n, round(sqrt(avg((pred - value)*(pred - value))),6) as rmse, round(avg(pred - value),6) as bias from obs o join q on o.day = q.day and o.px = q.px where o.sensor = 'view' and day(o.day) % 5 = 0 group by o.day""")
def agg29(spark, sf):
    from brineloom.operators.fill import holdout_table

    m, r = members(spark, sf)
    pred = m.groupBy("px", "day").agg(F.avg("value").alias("pred"))
    out = holdout_table(r.where(F.dayofmonth("day") % 5 == 0).select("px", "day", "value"), pred)
    return out.select(day_text().alias("day"), "n", r6("rmse").alias("rmse"), r6("bias").alias("bias"))


@query("agg19_seasonal_none", """q as (select px, count(*) as n from obs where sensor = 'view' and water group by px), m as (select avg(value) as mean from obs where sensor = 'view' and water)
  select c.px, coalesce(q.n, 0) as n, round(m.mean,6) as mean from (select distinct px from obs) c cross join m left join q on q.px = c.px""")
def agg19(spark, sf):
    from brineloom.operators.seasonal import fit_seasonal

    o = obs(spark, sf)
    fits = fit_seasonal(o.where("sensor = 'view' and water").select("px", "day", "value"), o.select("px", "row", "col").distinct(), "none", scaled=False)
    return fits.select("px", "n", r6(F.col("coef")[0]).alias("mean"))


@query("agg19_seasonal_harmonic", """q as (select px, value as y, cos(2*pi()*(dayofyear(day)-1)/30.0) as c, sin(2*pi()*(dayofyear(day)-1)/30.0) as s from obs where sensor = 'view'),
  a as (select px, count(*) as n, sum(c) as c, sum(s) as s, sum(c*c) as cc, sum(c*s) as cs, sum(s*s) as ss, sum(y) as y, sum(c*y) as cy, sum(s*y) as sy from q group by px),
  d as (select *, n*(cc*ss - cs*cs) - c*(c*ss - cs*s) + s*(c*cs - cc*s) as det from a where n >= 12),
  e as (select px, (y*(cc*ss - cs*cs) - c*(cy*ss - cs*sy) + s*(cy*cs - cc*sy))/det as m, (n*(cy*ss - cs*sy) - y*(c*ss - cs*s) + s*(c*sy - cy*s))/det as c1, (n*(cc*sy - cy*cs) - c*(c*sy - cy*s) + y*(c*cs - cc*s))/det as s1 from d),
  f as (select avg(c1) as c1, avg(s1) as s1 from e)
  select a.px, a.n, case when e.px is null then 'mean_only' else 'full' end as fit, round(coalesce(e.m, (a.y - f.c1*a.c - f.s1*a.s)/a.n),5) as m, round(coalesce(e.c1, f.c1),5) as c1, round(coalesce(e.s1, f.s1),5) as s1 from a cross join f left join e on e.px = a.px""")
def agg19b(spark, sf):
    from brineloom.operators.seasonal import fit_seasonal

    o = obs(spark, sf).where("sensor = 'view'")
    fits = fit_seasonal(o.select("px", "day", "value"), o.select("px", "row", "col").distinct(), "harmonic", 1, 30.0, 12, 1e12, scaled=False)
    r5 = lambda i: F.round(F.col("coef")[i], 5)
    return fits.select("px", "n", S.fit_label(F.col("fit")).alias("fit"), r5(0).alias("m"), r5(1).alias("c1"), r5(2).alias("s1"))


@query("scl09_spde", """, q as (select distinct r_regionkey + 5 as range_px from region), e as (select 4 - 2*cos(pi()*i/12) - 2*cos(pi()*j/9) as ev from (select unnest(range(0, 12)) as i), (select unnest(range(0, 9)) as j))
  select cast(range_px as integer) as range_px, round(8.0/(range_px*range_px),8) as kappa2, round(sqrt(avg(pow(8.0/(range_px*range_px) + ev, -2))/0.25),6) as lam from q, e group by range_px""")
def scl09(spark, sf):
    from brineloom.operators.gmrf import spde_params

    ranges = [r[0] for r in table(spark, sf, "region").select("r_regionkey").distinct().collect()]  # settings to try
    rows = [(int(k) + 5, *spde_params((12, 9), float(k + 5), 0.5)) for k in ranges]
    return spark.createDataFrame(rows, "range_px int, kappa2 double, lam double").select("range_px", F.round("kappa2", 8).alias("kappa2"), F.round("lam", 6).alias("lam"))


@query("src05_station_arrays", "select px % 8 as station_id, count(*) as n, round(avg(value - 273.15),6) as mean from ev where sensor = 'error' and value is not null and k % 4 in (1, 2) group by 1")
def src05(spark, sf):
    from brineloom.sources.readers import stations_from_grid

    e = events(spark, sf).where("sensor = 'error'").withColumn("station_id", F.col("px") % 8)
    grid = e.groupBy("station_id").agg(F.collect_list(F.struct("ts", "value", (F.col("k") % 4).alias("qc"))).alias("o"))  # the form of the source: an array a station
    grid = grid.select("station_id", F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"), F.col("o.ts").alias("times"), F.col("o.value").alias("values"), F.col("o.qc").alias("qc"))
    return stations_from_grid(grid).groupBy("station_id").agg(F.count("*").alias("n"), r6(F.avg("value_c")).alias("mean"))


@query("src06_station_csv", "select cast(px % 8 as varchar) as station_id, count(*) as n, round(avg(value - 273.15),5) as mean from ev where sensor = 'error' and value is not null and coalesce(k, 0) <= 50 group by 1")
def src06(spark, sf):
    from brineloom.sources.readers import read_csv_stations
    from brineloom.sources.scratch import written_as

    e = events(spark, sf).where("sensor = 'error'").select((F.col("px") % 8).alias("id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("when"), "value", F.lit(48.1).alias("latitude"), F.lit(-122.6).alias("longitude"), F.coalesce("k", F.lit(0)).alias("z"))
    path = written_as(e, "csv", header=True)
    got = read_csv_stations(spark, path, {"station_id": "id", "time": "when"}, units="K", max_depth_m=50)
    return got.groupBy("station_id").agg(F.count("*").alias("n"), F.round(F.avg("value_c"), 5).alias("mean"))


@query("src07_points_csv", "select cast(s_suppkey as varchar) as site_id, round(cast(s_suppkey as double)/10,6) as lat, round(s_acctbal,6) as lon, case when s_nationkey % 2 = 0 then 'n' || s_nationkey else 'default' end as grp from supplier")
def src07(spark, sf):
    from brineloom.sources.readers import read_points
    from brineloom.sources.scratch import written_as

    s = table(spark, sf, "supplier")
    group = F.when(F.col("s_nationkey") % 2 == 0, F.concat(F.lit("n"), F.col("s_nationkey").cast("string")))
    path = written_as(s.select(F.col("s_suppkey").alias("site_id"), (F.col("s_suppkey") / 10).alias("lat"), F.col("s_acctbal").cast("double").alias("lon"), group.alias("group")), "csv", header=True)
    return read_points(spark, path).select("site_id", r6("lat").alias("lat"), r6("lon").alias("lon"), "grp")


@query("src08_stations_json", "select cast(s_suppkey as varchar) as station_id, round(cast(s_nationkey as double),6) as lat, round(s_acctbal,6) as lon from supplier")
def src08(spark, sf):
    from brineloom.sources.readers import stations_of_json

    s = table(spark, sf, "supplier").select("s_nationkey", F.struct(F.col("s_suppkey").cast("string").alias("station_id"), F.col("s_nationkey").cast("double").alias("lat"), F.col("s_acctbal").cast("double").alias("lon")).alias("s"))
    meta = s.groupBy("s_nationkey").agg(F.to_json(F.collect_list("s")).alias("value"))  # the form of the source: a list a table
    return stations_of_json(meta).select("station_id", r6("lat").alias("lat"), r6("lon").alias("lon"))
