"""Queries over events and orders as job queues."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirespark.operators import answers
from quirespark.operators import events as E
from quirespark.plans.registry import query
from quirespark.shared import table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@query("SELECT event_id, (extract(hour FROM ts) * 60 + extract(minute FROM ts) >= 1380 OR extract(hour FROM ts) * 60 + extract(minute FROM ts) < 390) AS due FROM events")
def daily_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", E.in_window(F.col("ts"), F.lit("23:00-06:30")).alias("due"))


@query("""
SELECT event_id, epoch(CASE WHEN m >= 1380 OR m < 390 THEN date_trunc('second', ts) ELSE date_trunc('day', ts) + INTERVAL 23 HOUR END)::BIGINT AS starts FROM (SELECT *, extract(hour FROM ts) * 60 + extract(minute FROM ts) AS m FROM events)
""")
def next_opening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", F.unix_seconds(E.next_opening(F.col("ts"), F.lit("23:00-06:30")).cast("timestamp")).alias("starts"))


@query("""
SELECT user_id, event_id, gap_s FROM (SELECT *, (epoch(date_trunc('second', lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) - epoch(date_trunc('second', ts)))::BIGINT AS gap_s FROM events) WHERE gap_s > 86400
""")
def stall_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.gaps(_events(spark, sf_dir), "user_id", "ts", 86400).select("user_id", "event_id", "gap_s")


@query("""
SELECT user_id, max(n)::BIGINT AS longest, max(n) >= 3 AS halted FROM (SELECT user_id, run, sum(bad) AS n FROM (SELECT *, sum(1 - bad) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM
 (SELECT *, (event_type = 'error')::INTEGER AS bad FROM events)) GROUP BY user_id, run) GROUP BY user_id
""")
def failure_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.streaks(_events(spark, sf_dir), "user_id", ["ts", "event_id"], F.col("event_type") == "error", 3)


@query("""
WITH n AS (SELECT *, count(*) OVER (PARTITION BY event_type ORDER BY s RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS n FROM (SELECT *, epoch(date_trunc('second', ts))::BIGINT AS s FROM events)),
p AS (SELECT *, max(n) OVER (PARTITION BY event_type ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS peak FROM n)
SELECT event_id, n, peak, peak >= 6 AND n < 0.25 * peak AS slow FROM p
""")
def trailing_pace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.trailing_pace(_events(spark, sf_dir), "event_type", "ts", 60, 6, 0.25).select("event_id", "n", "peak", "slow")


@query("""
SELECT l_shipmode_like AS engine, round(coalesce(w, s), 6) AS rate, w IS NOT NULL AS whole, n_runs FROM (SELECT l_linestatus || l_returnflag AS l_shipmode_like,
 sum(l_extendedprice) FILTER (l_quantity >= 20 AND l_returnflag = 'N') / sum(l_quantity) FILTER (l_quantity >= 20 AND l_returnflag = 'N') AS w,
 sum(l_extendedprice) FILTER (l_quantity >= 20 AND l_returnflag <> 'N') / sum(l_quantity) FILTER (l_quantity >= 20 AND l_returnflag <> 'N') AS s, count(*) FILTER (l_quantity >= 20) AS n_runs FROM lineitem GROUP BY 1)
""")
def engine_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "lineitem").withColumn("engine", F.concat("l_linestatus", "l_returnflag"))
    r = E.rates(runs, "engine", "l_extendedprice", "l_quantity", F.col("l_returnflag") == "N", 20)
    return r.select("engine", F.round("rate", 6).alias("rate"), "whole", "n_runs")


@query("""
SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus <> 'F', o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n = 1
""")
def newest_per_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = E.newest_each(table(spark, sf_dir, "orders"), "o_custkey", [(F.col("o_orderstatus") != "F").asc(), F.desc("o_orderdate"), F.asc("o_orderkey")])
    return newest.select("o_custkey", "o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderpriority = '1-URGENT')::INTEGER DESC, o_orderkey)::INTEGER AS new_pos FROM orders")
def move_to_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.moved_to_top(table(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderpriority") == "1-URGENT", "o_orderkey").select("o_orderkey", "new_pos")


@query("SELECT o_orderkey, round(sum(o_totalprice / 14.5) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), 4) AS eta_s FROM orders")
def queue_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "orders").withColumn("seconds", F.col("o_totalprice") / 14.5)
    return E.finish_times(jobs, "o_custkey", "o_orderkey", "seconds").select("o_orderkey", F.round("eta_s", 4).alias("eta_s"))


@query("SELECT * FROM (VALUES (1, TIMESTAMP '2026-03-02 00:40:00'), (2, TIMESTAMP '2026-03-02 01:00:00'), (3, TIMESTAMP '2026-03-02 12:20:00')) AS t(id, done_at)")
def windowed_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = [("q", 1, 1, 6000.0, "23:00-06:30"), ("q", 2, 2, 1200.0, ""), ("q", 3, 3, 1200.0, "12:00-13:00")]
    rows = spark.createDataFrame(jobs, "queue string, id int, pos int, seconds double, window string")
    return E.finish_in_windows(rows, "queue", datetime(2026, 3, 1, 22, 0)).select("id", "done_at")


@query("""
WITH r AS (SELECT l_orderkey AS run, l_returnflag AS engine, l_extendedprice AS chars, 100.0::DOUBLE AS seconds, CASE l_returnflag WHEN 'A' THEN 10.0 WHEN 'N' THEN 40.0 ELSE 20.0 END::DOUBLE AS rate, l_linenumber FROM lineitem)
SELECT run, l_linenumber, round(seconds * (chars / rate) / sum(chars / rate) OVER (PARTITION BY run), 4) AS share_s FROM r
""")
def split_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), "l_linenumber", F.col("l_returnflag").alias("engine"), F.col("l_extendedprice").alias("chars"), F.lit(100.0).alias("seconds"))
    rates = spark.createDataFrame([("A", 10.0), ("N", 40.0)], "engine string, rate double")
    return E.split_seconds(runs, rates, "engine").select("run", "l_linenumber", F.round("share_s", 4).alias("share_s"))


@query("SELECT user_id, epoch(date_trunc('second', max(ts)))::BIGINT AS last_s, epoch(TIMESTAMP '2024-01-30 12:00:00')::BIGINT - epoch(date_trunc('second', max(ts)))::BIGINT < 86400 AS held FROM events GROUP BY user_id")
def lease_holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = E.latest_valid(_events(spark, sf_dir), "user_id", "ts", F.lit("2024-01-30 12:00:00"), 86400)
    return held.select("user_id", F.unix_seconds(F.col("last").cast("timestamp")).alias("last_s"), "held")


@query("SELECT * FROM (VALUES ('a', '3'), ('b', '')) AS t(book, marks)")
def music_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("a", i, s) for i, s in enumerate((900.0, 700.0, 100.0, 1000.0, 600.0), 1)] + [("b", 1, 5000.0)]
    m = E.greedy_marks(spark.createDataFrame(rows, "book string, chapter int, seconds double"), "book", "chapter", "seconds", 1500)
    return m.select("book", F.array_join("marks", ",").alias("marks"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'failed' WHEN value > 100 THEN 'held' ELSE 'queued' END AS status FROM events WHERE event_type <> 'view'")
def bulk_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of one kind removed, others changed by rule."""
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("value") > 100, "held").otherwise("queued")
    return _events(spark, sf_dir).where("event_type <> 'view'").select("event_id", status.alias("status"))


@query("SELECT event_type, min(value) AS limit_s FROM (SELECT event_type, greatest(3.5, value - 300) AS value FROM events) GROUP BY event_type")
def learnt_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit that is only ever lowered is a minimum."""
    return _events(spark, sf_dir).groupBy("event_type").agg(F.min(F.greatest(F.lit(3.5), F.col("value") - 300)).alias("limit_s"))


_MOVED = """WITH o AS (SELECT *, o_orderpriority = '1-URGENT' AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders),
g AS (SELECT *, sum((NOT c)::INTEGER) OVER (PARTITION BY o_custkey ORDER BY place) AS u, sum((NOT c)::INTEGER) OVER (PARTITION BY o_custkey ORDER BY place DESC) AS d FROM o),
n AS (SELECT *, count(*) OVER (PARTITION BY o_custkey, u) - 1 AS nu, count(*) OVER (PARTITION BY o_custkey, d) - 1 AS nd FROM g)"""


@query(f"""
{_MOVED}
SELECT o_orderkey, (CASE WHEN NOT c THEN place + nu WHEN u > 0 THEN place - 1 ELSE place END)::INTEGER AS up, (CASE WHEN NOT c THEN place - nd WHEN d > 0 THEN place + 1 ELSE place END)::INTEGER AS down,
 row_number() OVER (PARTITION BY o_custkey ORDER BY c::INTEGER, o_orderkey)::INTEGER AS bottom FROM n
""")
def moved_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent orders one place up, one down, or to the end."""
    jobs = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    for where in ("up", "down", "bottom"):
        jobs = E.moved(jobs, "o_custkey", F.col("o_orderpriority") == "1-URGENT", "o_orderkey", where).withColumnRenamed("new_pos", where)
    return jobs.select("o_orderkey", "up", "down", "bottom")


@query("""
WITH RECURSIVE c AS (SELECT conv_id, turn, 300 + length(coalesce(text, '')) % 600 AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
k AS (SELECT *, coalesce(sum(s) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS clock FROM c),
w AS (SELECT conv_id, n, turn, 0::BIGINT AS since, false AS marked FROM k WHERE n = 1
 UNION ALL SELECT k.conv_id, k.n, k.turn, CASE WHEN k.clock - w.since >= 900 THEN k.clock ELSE w.since END, k.clock - w.since >= 900 FROM w JOIN k ON k.conv_id = w.conv_id AND k.n = w.n + 1),
m AS (SELECT conv_id, turn FROM w WHERE marked UNION SELECT conv_id, turn FROM c WHERE (conv_id + turn) % 7 = 0)
SELECT m.conv_id, m.turn FROM m JOIN c USING (conv_id, turn) WHERE c.n > 1 AND NOT ((m.conv_id + m.turn) % 7 <> 0 AND (m.conv_id + m.turn) % 5 = 0)
""")
def bridge_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as chapters that begin with music: every quarter of an hour, changed by one's own choices."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", (300 + F.pmod(F.char_length(F.coalesce("text", F.lit(""))), F.lit(600))).cast("double").alias("seconds"))
    k = F.col("conv_id") + F.col("turn")
    choices = c.select("conv_id", "turn", F.when(k % 7 == 0, "on").when(k % 5 == 0, "off").alias("turned"))
    return E.bridges(c, "conv_id", "turn", "seconds", 900, choices)


_CLOCK = "CASE WHEN {0} >= 3600 THEN printf('%dh %02dm', {0} // 3600, {0} % 3600 // 60) ELSE printf('%dm %02ds', {0} // 60, {0} % 60) END"


@query(f"""
WITH j AS (SELECT o_custkey % 50 AS queue, o_orderkey AS job, 'Order ' || o_orderkey AS title, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'queued' ELSE CASE WHEN row_number() OVER (PARTITION BY o_custkey % 50, o_orderstatus ORDER BY o_orderkey) = 1 THEN 'running' ELSE 'held' END END AS status,
 floor(o_totalprice / 100)::BIGINT AS s, strftime(o_orderdate, '%Y-%m-%d') AS finished FROM orders),
a AS (SELECT *, sum(CASE WHEN status <> 'held' THEN s ELSE 0 END) OVER w AS due, row_number() OVER w AS n FROM j WHERE status <> 'done' WINDOW w AS (PARTITION BY queue ORDER BY (status <> 'running')::INTEGER, job ROWS UNBOUNDED PRECEDING)),
q AS (SELECT queue, string_agg(n || '. ' || title || ' — ' || status || ', ' || CASE WHEN status = 'held' THEN 'saved for later' ELSE 'done in ' || {_CLOCK.format("due::BIGINT")} END, chr(10) ORDER BY n) AS t FROM a GROUP BY queue),
r AS (SELECT queue, 'Making “' || title || '”: ' || (100 * (job % 30) // 30) || '% (' || (job % 30) || ' of 30)' || chr(10) || 'Done in ' || {_CLOCK.format("due::BIGINT")} AS t FROM a WHERE status = 'running'),
x AS (SELECT queue, arg_min(title, n) AS title FROM a WHERE status = 'queued' GROUP BY queue),
f AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY finished DESC, job DESC) AS n FROM j WHERE status = 'done'),
d AS (SELECT queue, string_agg(n || '. ✓ ' || title || ' — ' || finished, chr(10) ORDER BY n) AS t FROM f WHERE n <= 12 GROUP BY queue),
m AS (SELECT conv_id, turn, conv_id % 50 AS queue, (turn % 4)::INTEGER AS k FROM conversations)
SELECT conv_id, turn, CASE k WHEN 0 THEN 'current' WHEN 1 THEN 'queue' WHEN 2 THEN 'done' END AS command, md5(CASE k WHEN 0 THEN coalesce(r.t, 'Nothing is being made right now. Next: “' || x.title || '”.', 'Nothing is being made and nothing is waiting.')
 WHEN 1 THEN coalesce(q.t, 'The queue is empty.') WHEN 2 THEN coalesce(d.t, 'Nothing has finished yet.') END) AS answer
FROM m LEFT JOIN r USING (queue) LEFT JOIN x USING (queue) LEFT JOIN q USING (queue) LEFT JOIN d USING (queue)
""")
def command_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as messages to queues of orders, which answer what is made, what waits and what was done."""
    o = table(spark, sf_dir, "orders").withColumn("queue", F.pmod("o_custkey", F.lit(50)))
    first = F.row_number().over(Window.partitionBy("queue", "o_orderstatus").orderBy("o_orderkey")) == 1
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "queued").when(first, "running").otherwise("held")
    jobs = o.select(
        "queue", F.col("o_orderkey").alias("job"), F.concat(F.lit("Order "), "o_orderkey").alias("title"), status.alias("status"), F.col("o_orderkey").alias("position"), F.pmod("o_orderkey", F.lit(30)).alias("done"), F.lit(30).alias("total"),
        F.floor(F.col("o_totalprice") / 100).alias("seconds"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("finished"), F.lit(None).cast("string").alias("note"),
    )
    text = F.get(F.array(*map(F.lit, ["Status!", " Queue.", "finished", "hello there"])), F.pmod("turn", F.lit(4)).cast("int"))
    messages = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.pmod("conv_id", F.lit(50)).alias("queue"), text.alias("text"))
    return answers.answered(messages, answers.states(jobs), shown=F.md5).select("conv_id", "turn", "command", "answer")
