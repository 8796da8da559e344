"""Composite queries over the events table (placeholder roles: event type = member, user = pixel)."""

from __future__ import annotations

from pyspark.sql import functions as F

from brineloom.operators.composite import weighted_composite
from brineloom.sources.tables import observations


def _composite(spark, sf):
    out = weighted_composite(observations(spark, sf), order=["view", "click", "purchase"], weights={"view": 1.0, "click": 0.5, "purchase": 0.8}, min_members=1)
    return out.select(F.col("day").cast("string").alias("day"), "px", F.round("mean", 6).alias("mean"), "n", "src", F.round("sd", 6).alias("sd"))


QUERIES = {"agg01_composite": _composite}

ORACLE = {
    "agg01_composite": """
with m as (select cast(ts as date) as day, user_id as px, value as v,
             case event_type when 'view' then 1.0 when 'click' then 0.5 else 0.8 end as w,
             case event_type when 'view' then 1 when 'click' then 2 else 4 end as bit
      from events where event_type in ('view','click','purchase')),
cell as (select day, px, bit, max(w) as w, avg(v) as v from m group by all),
s as (select day, px, sum(w*v)/sum(w) as mean, count(*) as n, bit_or(bit) as src, sum(w) as sw, sum(w*w) as sw2 from cell group by all),
d as (select c.day, c.px, sum(c.w*(c.v-s.mean)*(c.v-s.mean)) as ss from cell c join s on c.day=s.day and c.px=s.px group by all)
select cast(s.day as varchar) as day, s.px, round(s.mean,6) as mean, s.n, cast(s.src as integer) as src,
       case when s.n >= 2 and s.sw - s.sw2/s.sw > 0 then round(sqrt(d.ss/(s.sw - s.sw2/s.sw)),6) end as sd
from s join d on s.day=d.day and s.px=d.px""",
}
