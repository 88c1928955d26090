"""Queries of streams and of per-source state, with their SQL where SQL has one."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinth.functions.rounding import half_even
from plinth.plans.standin import FARES_SQL, fares, feed_sql, table
from plinth.sources import synthetic
from plinth.streaming import events, policy


def tumbling_events(spark, d):
    out = events.run_to_table(events.tumbling(events.file_stream(spark, f"{d}/events.parquet"), ["event_type"]))
    return out.select("window_start", "event_type", "n", half_even(F.col("total"), 4).alias("total"))


def stream_dedup_batch_equiv(spark, d):
    """Which users a stream of one micro-batch saw, each once."""
    once = events.first_of_each(events.file_stream(spark, f"{d}/events.parquet"), ["user_id"], late="60 days")
    return events.run_to_table(once.select("user_id"), "append")


def late_flagging(spark, d):
    line, orders = table(spark, d, "lineitem"), table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    rows = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    flag = events.flag_timing(F.col("l_shipdate").cast("timestamp"), F.col("o_orderdate").cast("timestamp"), F.lit(30), drift_days=365)
    return rows.groupBy(flag.alias("flag")).agg(F.count("*").alias("n"))


def _requests(spark, d):
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "error", "failure").when((F.col("event_id") % 997) == 13, "challenge").when((F.col("event_id") % 499) == 7, "resume").otherwise("success")
    return e.select(F.col("user_id").alias("source"), F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"), kind.alias("event")).withColumn("at", F.col("us") / 1e6).drop("us")


def breaker_transitions(spark, d):
    return policy.fold(_requests(spark, d), "source", policy.Breaker(threshold=2, cooldown=86_400.0))


def breaker_snapshot(spark, d):
    return policy.snapshot(breaker_transitions(spark, d), "source")


def token_bucket_sim(spark, d):
    return policy.fold(_requests(spark, d), "source", policy.Bucket(rate=1 / 3600, capacity=3.0, spacing=60.0))


def synthetic_fares(spark, d):
    """The synthetic feed for three routes on one day, read through the data source."""
    name = synthetic.register(spark)
    return spark.read.format(name).option("routes", "DEL-BOM,DEL-BLR,BOM-GOI").option("day", "2024-03-05").load()


def synthetic_feed(spark, d):
    routes = table(spark, d, "nation").select(F.col("n_name").alias("route"))
    windows = spark.createDataFrame([(1,), (7,), (15,), (30,), (45,)], "lead_window int")
    tasks = routes.crossJoin(F.broadcast(windows)).withColumn("observed_on", F.lit("2024-03-05").cast("date"))
    feed = synthetic.fares_feed(tasks)
    return feed.groupBy("lead_window").agg(F.count("*").alias("n"), F.count_if(F.col("total").isNull() != F.col("is_sold_out")).alias("odd"))


def daily_restatement(spark, d):
    """Every day of a range, with the prints that were known by then."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit("1996-03-01").cast("date"), F.lit("1996-03-10").cast("date"))).alias("day"))
    daily = fares(spark, d).groupBy("observed_on").agg(F.count("*").alias("n"))
    return days.join(daily, F.col("day") == F.col("observed_on"), "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


_REQUESTS = """requests as (select user_id as source, event_id as seq, epoch_us(ts) / 1e6 as moment, case when event_type = 'error' then 'failure' when event_id % 997 = 13 then 'challenge' when event_id % 499 = 7 then 'resume' else 'success' end as event from events),
numbered as (select *, row_number() over (partition by source order by moment, seq) as k from requests)"""
_BREAKER = f"""with recursive {_REQUESTS},
run(source, k, seq, decision, state, failures, opened) as (select distinct source, cast(0 as bigint), cast(null as bigint), cast(null as varchar), 'CLOSED', cast(0 as bigint), cast(0 as double) from numbered
  union all select source, k, seq,
    case when event = 'resume' then case when was = 'TRIPPED_PERMANENT' then 'refused' else 'resumed' end when was in ('TRIPPED_PERMANENT', 'OPEN') then 'denied' when event = 'challenge' then 'tripped' when event = 'failure' and (was = 'HALF_OPEN' or failures + 1 >= 2) then 'opened' else 'allowed' end,
    case when was = 'TRIPPED_PERMANENT' then was when event = 'resume' then 'CLOSED' when was = 'OPEN' then was when event = 'challenge' then 'TRIPPED_PERMANENT' when event = 'failure' then case when was = 'HALF_OPEN' or failures + 1 >= 2 then 'OPEN' else was end else 'CLOSED' end,
    case when was = 'TRIPPED_PERMANENT' then failures when event = 'resume' then 0 when was = 'OPEN' or event = 'challenge' then failures when event = 'failure' then failures + 1 else 0 end,
    case when was = 'TRIPPED_PERMANENT' then opened when event = 'resume' then 0 when was = 'OPEN' then opened when event = 'challenge' or (event = 'failure' and (was = 'HALF_OPEN' or failures + 1 >= 2)) then moment when event = 'failure' then opened else 0 end
  from (select n.source, n.k, n.seq, n.moment, n.event, r.failures, r.opened, case when r.state = 'OPEN' and n.moment >= r.opened + 86400 then 'HALF_OPEN' else r.state end as was from run r join numbered n on n.source = r.source and n.k = r.k + 1))"""
_BUCKET = f"""with recursive {_REQUESTS},
run(source, k, seq, granted, wait, tokens, before, last) as (select distinct source, cast(0 as bigint), cast(null as bigint), false, cast(0 as double), cast(3 as double), cast(-1 as double), cast(0 as double) from numbered
  union all select source, k, seq, pause <= 0, pause, case when pause > 0 then t else t - 1 end, moment, case when pause > 0 then last else moment end
  from (select *, greatest(cast(0 as double), case when last > 0 then 60 - (moment - last) else 0 end, case when t < 1 then (1 - t) / (cast(1 as double) / 3600) else 0 end) as pause
    from (select n.source, n.k, n.seq, n.moment, r.last, case when r.before < 0 then r.tokens else least(cast(3 as double), r.tokens + greatest(cast(0 as double), n.moment - r.before) * (cast(1 as double) / 3600)) end as t from run r join numbered n on n.source = r.source and n.k = r.k + 1)))"""

QUERIES = {
    "tumbling_events": (tumbling_events, "select cast(epoch(date_trunc('hour', ts)) as bigint) as window_start, event_type, count(*) as n, round_even(sum(value), 4) as total from events group by all"),
    "stream_dedup_batch_equiv": (stream_dedup_batch_equiv, "select distinct user_id from events"),
    "late_flagging": (late_flagging, "select case when l.l_shipdate < o.o_orderdate - interval '3 hours' then 'rejected' when abs(datediff('day', cast(o.o_orderdate as date), cast(l.l_shipdate as date)) - 30) > 365 then 'stale' else 'ok' end as flag, count(*) as n from lineitem l join orders o on l.l_orderkey = o.o_orderkey group by 1"),
    "breaker_transitions": (breaker_transitions, f"{_BREAKER} select source, seq, decision, state, failures from run where k > 0"),
    "breaker_snapshot": (breaker_snapshot, f"{_BREAKER} select source, seq, decision, state, failures from run where k > 0 qualify row_number() over (partition by source order by seq desc) = 1"),
    "token_bucket_sim": (token_bucket_sim, f"{_BUCKET} select source, seq, granted, wait, tokens from run where k > 0"),
    "synthetic_fares": (synthetic_fares, f"with tasks as (select route, w as lead_window from (values ('DEL-BOM'), ('DEL-BLR'), ('BOM-GOI')) r(route) cross join (values (1), (7), (15), (30), (45)) w(w)), {feed_sql('standard')} select route, lead_window, day as observed_on, carrier, flight, cast(case when not gone then fare end as decimal(12,2)) as base_fare, cast(case when not gone then round(fare * 0.05, 2) end as decimal(12,2)) as gst, cast(case when not gone then fare + round(fare * 0.05, 2) end as decimal(12,2)) as total, gone as is_sold_out from priced"),
    "synthetic_feed": (synthetic_feed, "select w as lead_window, cast(25 * 18 as bigint) as n, cast(0 as bigint) as odd from (values (1), (7), (15), (30), (45)) t(w)"),
    "daily_restatement": (daily_restatement, f"with {FARES_SQL}, n as (select observed_on, count(*) as n from fares group by all) select cast(r.day as date) as day, coalesce(n.n, 0) as n from (select unnest(generate_series(date '1996-03-01', date '1996-03-10', interval '1 day')) as day) r left join n on n.observed_on = cast(r.day as date)"),
}
