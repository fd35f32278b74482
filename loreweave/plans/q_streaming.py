"""Event-time queries: the batch side of the streaming operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loreweave import streaming
from loreweave.plans.registry import query
from loreweave.sources import table


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("event_tumbling", "select date_trunc('day', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def event_tumbling(spark, sf_dir):
    return streaming.tumbling_counts(_events(spark, sf_dir))


@query("event_sliding", "with e as (select time_bucket(interval 3 hours, ts) as b from events) select start, count(*) as n from (select b as start from e union all select b - interval 3 hours from e) group by 1")
def event_sliding(spark, sf_dir):
    return streaming.sliding_counts(_events(spark, sf_dir))


@query("session_debounce", """
with g as (select user_id, ts, case when ts - lag(ts) over w < interval 30 minutes then 0 else 1 end as fresh from events window w as (partition by user_id order by ts)),
s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select user_id, min(ts) as start, max(ts) + interval 30 minutes as "end", count(*) as n from s group by user_id, k
""")
def session_debounce(spark, sf_dir):
    return streaming.sessions(_events(spark, sf_dir))


@query("event_daily_dedup", "select distinct user_id, event_type, cast(cast(ts as date) as varchar) as day from events")
def event_daily_dedup(spark, sf_dir):
    return streaming.daily_activity(_events(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))


@query("conversation_last_event", "select conv_id, role, max(turn) as turn, arg_max(text, turn) as text, count(*) as n from conversations group by 1, 2")
def conversation_last_event(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("text"), F.count("*").alias("n"))


@query("history_projection", """
with m as (select conv_id, max(turn) as mark from conversations where role = 'system' group by 1),
r as (select c.conv_id, c.turn, row_number() over (partition by c.conv_id order by c.turn desc) as back, coalesce(mark, -1) as mark from conversations c left join m using (conv_id)),
u as (select *, row_number() over (partition by conv_id order by turn desc) as older from r where back > 4 and turn > mark)
select conv_id, turn from r where back <= 4 union all select conv_id, turn from u where older <= 7
""")
def history_projection(spark, sf_dir):
    """The last two rounds, and at most seven older turns that no summary covers."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    mark = c.groupBy("conv_id").agg(F.coalesce(F.max(F.when(F.col("role") == "system", F.col("turn"))), F.lit(-1)).alias("mark"))
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    r = c.join(mark, "conv_id").withColumn("back", F.row_number().over(w))
    older = r.filter("back > 4 and turn > mark").withColumn("older", F.row_number().over(w)).filter("older <= 7")
    return r.filter("back <= 4").select("conv_id", "turn").unionByName(older.select("conv_id", "turn"))


@query("conversation_compact", """
with r as (select conv_id, turn, length(text) as n, row_number() over (partition by conv_id order by turn desc) as back from conversations)
select conv_id, count(*) filter (where keep) as kept, count(*) filter (where not keep) as folded from (select *, back <= 4 or sum(n) over (partition by conv_id order by back rows unbounded preceding) <= 1500 as keep from r) group by 1
""")
def conversation_compact(spark, sf_dir):
    """The two newest exchanges stay, older ones while they fit the soft budget."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    r = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.char_length("text").alias("n")).withColumn("back", F.row_number().over(w)).withColumn("run", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    keep = (F.col("back") <= 4) | (F.col("run") <= 1500)
    return r.groupBy("conv_id").agg(F.count_if(keep).alias("kept"), F.count_if(~keep).alias("folded"))
