"""Registered streaming queries (run to completion with an available-now trigger)."""

from __future__ import annotations

from pyspark.sql import functions as F

from adlens.functions.numeric import snap_round
from adlens.plans import sqltext as S
from adlens.plans.catalog import register
from adlens.operators.cooldown import cooldown_keep
from adlens.session import scratch_dir
from adlens.sources.facts import table
from adlens.streaming.closed_days import closed_days, day_partials, late_rows, open_days, watch_days
from adlens.streaming.daily import EVENTS_SCHEMA, stream_daily


@register("stream_daily", (
    "SELECT CAST(ts AS DATE) AS day, count(*) AS events, count_if(event_type = 'view') AS views, "
    "count_if(event_type = 'click') AS clicks, count_if(event_type = 'purchase') AS purchases, "
    f"{S.snap_round('sum(value)', 4)} AS value_sum FROM events GROUP BY CAST(ts AS DATE)"))
def q_stream_daily(spark, d):
    return stream_daily(spark, d, "events.parquet")


COOLDOWN_SECONDS = 6 * 3600


@register("cooldown_dedup", (
    "WITH RECURSIVE ev AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id "
    "ORDER BY ts, event_id) AS rn FROM events), "
    "nx AS (SELECT a.user_id, a.rn, min(b.rn) AS nxt FROM ev a JOIN ev b ON a.user_id = b.user_id "
    f"AND b.ts >= a.ts + INTERVAL {COOLDOWN_SECONDS} SECOND GROUP BY a.user_id, a.rn), "
    "kept(user_id, rn) AS (SELECT user_id, 1 FROM ev WHERE rn = 1 UNION ALL "
    "SELECT k.user_id, n.nxt FROM kept k JOIN nx n ON n.user_id = k.user_id AND n.rn = k.rn) "
    "SELECT e.user_id, e.event_id, e.ts FROM ev e JOIN kept k ON e.user_id = k.user_id AND e.rn = k.rn"))
def q_cooldown_dedup(spark, d):
    # per user, an event is kept if it comes 6 h or more after the user's last kept event
    ev = table(spark, d, "events")
    return cooldown_keep(ev, "user_id", "ts", COOLDOWN_SECONDS, "event_id").select("user_id", "event_id", "ts")


# events arrive in four deliveries by the day of the month; every tenth one comes a delivery later
DELIVERIES = 4
_ARRIVAL = "least(CAST(floor((day(ts) - 1) / 8) AS BIGINT) + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END, 3)"
_TOTALS = ("count(*) AS events, count_if(event_type = 'view') AS views, count_if(event_type = 'click') AS clicks, "
           f"count_if(event_type = 'purchase') AS purchases, {S.snap_round('sum(value)', 4)} AS value_sum")


@register("stream_closed_days", S.with_ctes(
    f"SELECT state, day, {_TOTALS} FROM placed GROUP BY state, day",
    arrived=f"SELECT *, CAST(ts AS DATE) AS day, {_ARRIVAL} AS delivery FROM events",
    marks="SELECT delivery, max(max(ts)) OVER (ORDER BY delivery) - INTERVAL 1 DAY AS mark FROM arrived GROUP BY delivery",
    shut="SELECT d.day, min(m.delivery) AS shut_at FROM (SELECT DISTINCT day FROM arrived) d JOIN marks m ON d.day + INTERVAL 1 DAY <= m.mark GROUP BY d.day",
    placed="SELECT a.*, CASE WHEN a.delivery > s.shut_at THEN 'late' WHEN s.shut_at IS NULL THEN 'open' ELSE 'closed' END AS state "
           "FROM arrived a LEFT JOIN shut s USING (day)"))
def q_stream_closed_days(spark, d):
    # each delivery is written, then taken by the stream, which starts again from its checkpoint every time
    inbox, out, ckpt = (scratch_dir(spark, f"closed-days-{n}") for n in ("in", "out", "ckpt"))
    ev = table(spark, d, "events")
    for k in range(DELIVERIES):
        ev.where(F.expr(_ARRIVAL) == k).write.mode("append").parquet(inbox)
        watch_days(spark.readStream.schema(EVENTS_SCHEMA).parquet(inbox), out, ckpt).awaitTermination()
    states = {"closed": closed_days(spark, out), "open": open_days(spark, out), "late": day_partials(late_rows(spark, out))}
    parts = [df.select(F.lit(s).alias("state"), "day", "events", "views", "clicks", "purchases", snap_round("value_sum", 4).alias("value_sum"))
             for s, df in states.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
