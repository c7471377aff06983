"""Queries on the queue and the lexicon: orders stand for jobs, customers for books, lineitems for runs and clips, parts for
voices and words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.operators import lexicon, queue
from quirespark.plans.registry import query
from quirespark.shared import table

_STATUS = ["queued", "running", "held", "paused", "done"]


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.get(F.array(*map(F.lit, _STATUS)), F.pmod("o_orderkey", F.lit(5)).cast("int"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("work"), status.alias("status"), F.lit("2026-05-01 08:00").alias("not_before"), F.lit("23:00-06:30").alias("window"),
        F.concat(F.pmod("o_orderkey", F.lit(9)), F.lit("/"), F.pmod("o_orderkey", F.lit(11))).alias("progress"), F.concat(F.lit("T"), "o_orderkey").alias("title"), "o_orderdate",
    )


_SQL_JOBS = f"(SELECT o_orderkey AS id, o_custkey AS work, {_STATUS}[o_orderkey % 5 + 1] AS status, o_orderkey % 9 AS done, o_orderkey % 11 AS total, 'T' || o_orderkey AS title, o_orderdate FROM orders)"


@query("""
SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN 'not prepared' WHEN o_orderkey % 6 = 1 THEN 'no such time' WHEN o_orderkey % 4 = 1 THEN 'no such window' END AS refusal FROM orders
""")
def new_job_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    time = F.when(k % 6 == 1, F.lit("2026-13-01 10:00")).when(k % 6 == 2, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm"))
    window = F.when(k % 4 == 1, "23:00-24:30").when(k % 4 == 2, "").otherwise("23:00-06:30")
    return table(spark, sf_dir, "orders").select("o_orderkey", queue.refusal(F.col("o_custkey") % 10 != 0, time, window).alias("refusal"))


@query(f"SELECT id, CASE WHEN id % 3 = 0 THEN 'held' ELSE status END AS status, CASE WHEN id % 2 = 0 THEN 'new ' || title ELSE title END AS title FROM {_SQL_JOBS}")
def patched_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _jobs(spark, sf_dir).select("id", "status", "title")
    changes = j.where("id % 2 = 0 OR id % 3 = 0").select("id", F.expr("CASE WHEN id % 3 = 0 THEN 'held' END").alias("status"), F.expr("CASE WHEN id % 2 = 0 THEN 'new ' || title END").alias("title"))
    return queue.patched(j, changes, "id", ["status", "title"])


@query(f"SELECT work, id FROM (SELECT *, row_number() OVER (PARTITION BY work ORDER BY o_orderdate DESC, id DESC) AS n FROM {_SQL_JOBS} WHERE status IN ('queued', 'held', 'paused')) WHERE n = 1")
def waiting_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.waiting_for(_jobs(spark, sf_dir), "work", "status", ["o_orderdate", "id"]).select("work", "id")


@query(f"""
WITH n AS (SELECT *, CASE WHEN status <> 'done' THEN row_number() OVER (PARTITION BY work, status <> 'done' ORDER BY id) END AS n FROM {_SQL_JOBS}),
h AS (SELECT *, coalesce(work % 3 > 0 AND n = work % 3 AND status <> 'running', false) AS hit FROM n)
SELECT id, CASE WHEN hit THEN 'queued' ELSE status END AS status, CASE WHEN hit THEN '' ELSE '23:00-06:30' END AS "window", CASE WHEN NOT hit THEN '2026-05-01 08:00' END AS not_before,
 bool_or(hit) OVER (PARTITION BY work) AND status = 'running' AS preempt, row_number() OVER (PARTITION BY work ORDER BY hit DESC, id)::INTEGER AS pos FROM h
""")
def jobs_started_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`now 1` or `now 2` in two of three queues."""
    j = _jobs(spark, sf_dir)
    commands = table(spark, sf_dir, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("work"), (F.col("c_custkey") % 3).alias("number"))
    return queue.started_now(j, "work", "id", commands).select("id", "status", "window", "not_before", "preempt", "pos")


@query(f"SELECT id, CASE WHEN work % 2 = 0 AND status = 'running' THEN 'held' ELSE status END AS status, CASE WHEN work % 2 = 0 AND status = 'running' THEN CASE WHEN total = 0 THEN 0 ELSE floor(100.0 * done / total)::DOUBLE END END AS stopped_at FROM {_SQL_JOBS}")
def jobs_stopped(spark: SparkSession, sf_dir: str) -> DataFrame:
    commands = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("work"))
    return queue.stopped(_jobs(spark, sf_dir), "work", commands).select("id", "status", F.col("stopped_at").cast("double").alias("stopped_at"))


@query(f"SELECT c_custkey AS work, made_as FROM customer JOIN (SELECT work, min(title) AS made_as FROM {_SQL_JOBS} WHERE status = 'running' GROUP BY work) ON c_custkey = work")
def refused_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("work"))
    return queue.refused_edits(edits, _jobs(spark, sf_dir), "work")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("book"), F.pmod("l_orderkey", F.lit(50)), F.lit("-"), F.unix_seconds(F.col("l_shipdate").cast("timestamp"))).alias("id"), F.col("l_returnflag").alias("engine"),
        F.when(F.col("l_linestatus") == "O", "job").alias("kind"), F.floor("l_extendedprice").alias("chars"), F.col("l_quantity").alias("seconds"), "l_orderkey", "l_linenumber",
    )


_SQL_RUNS = "(SELECT 'book' || (l_orderkey % 50) AS book, 'book' || (l_orderkey % 50) || '-' || epoch(l_shipdate)::BIGINT AS id, epoch(l_shipdate)::BIGINT AS stamp, l_returnflag AS engine, CASE WHEN l_linestatus = 'O' THEN 'job' END AS kind, floor(l_extendedprice)::BIGINT AS chars, l_quantity AS seconds, l_orderkey, l_linenumber FROM lineitem)"


@query(f"SELECT id, engine, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY id, engine ORDER BY l_orderkey DESC, l_linenumber DESC) AS n FROM {_SQL_RUNS} WHERE chars > 0 AND seconds > 0) WHERE n = 1 ORDER BY l_orderkey DESC, l_linenumber DESC, id, engine LIMIT 300")
def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a history of 300 runs keeps."""
    return queue.recorded(_runs(spark, sf_dir), ["id", "engine"], ["l_orderkey", "l_linenumber"]).select("id", "engine", "l_orderkey", "l_linenumber")


@query(f"""
WITH s AS (SELECT engine, sum(chars) / sum(seconds) AS cps FROM {_SQL_RUNS} WHERE kind IS NULL AND seconds >= 20 GROUP BY engine)
SELECT l_orderkey, l_linenumber FROM {_SQL_RUNS} r LEFT JOIN s USING (engine) WHERE NOT coalesce(kind = 'job' AND chars / greatest(seconds, 1.0) > 1.1 * cps, false)
""")
def uncached_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.without_cached(_runs(spark, sf_dir), 1.1).select("l_orderkey", "l_linenumber")


@query(f"""
WITH f AS (SELECT book, engine, sum(chars)::BIGINT AS fresh FROM {_SQL_RUNS} WHERE kind IS NULL AND stamp >= epoch(TIMESTAMP '1995-01-01 00:00:00')::BIGINT + substr(book, 5)::BIGINT * 86400 GROUP BY book, engine),
n AS (SELECT 'book' || (doc_id % 60) AS book, CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE 'R' END AS engine, sum(length(text))::BIGINT AS n FROM documents GROUP BY ALL)
SELECT book, engine, least(n, coalesce(fresh, 0)) AS chars FROM n LEFT JOIN f USING (book, engine)
""")
def learnt_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of finished books, but no more than were made fresh since they were started."""
    start = F.unix_seconds(F.lit("1995-01-01 00:00:00").cast("timestamp"))
    since = spark.range(50).select(F.concat(F.lit("book"), "id").alias("book"), (start + F.col("id") * 86400).alias("since"))
    k = F.col("doc_id")
    lines = table(spark, sf_dir, "documents").select(F.concat(F.lit("book"), F.pmod(k, F.lit(60))).alias("book"), F.when(k % 2 == 0, "A").otherwise("R").alias("engine"), "text")
    return queue.learnt_chars(lines, queue.fresh_chars(_runs(spark, sf_dir), since))


@query("SELECT o_orderkey, round(10 + coalesce(s, 0), 1) AS active FROM orders LEFT JOIN (SELECT l_orderkey, sum(greatest(l_quantity - 10, 0)) AS s FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey")
def active_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "orders").select("o_orderkey", F.lit(10.0).alias("active"))
    ticks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_quantity") - 10).alias("seconds"))
    return queue.active_seconds(jobs, ticks, "o_orderkey")


_ENDS = '[.!?"“”‘’\\n] '


@query(f"""
WITH t AS (SELECT source, regexp_replace(regexp_replace(text, '^[A-Z][a-z]+', '_'), '({_ENDS})[A-Z][a-z]+', '\\1_', 'g') AS t FROM documents)
SELECT DISTINCT source, lower(w) AS word FROM (SELECT source, unnest(regexp_extract_all(t, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')) AS w FROM t) WHERE regexp_full_match(w, '[A-Z][a-z]+')
""")
def name_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.mid_sentence_capitals(table(spark, sf_dir, "documents"), "source")


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.pmod(k, F.lit(20)).alias("book"), F.concat(F.lit("Name"), F.pmod(k, F.lit(97))).alias("term"), F.when(k % 2 == 0, "name").otherwise("word").alias("kind"), F.when(k % 3 == 0, "fr").alias("lang"),
        F.when(k % 5 > 0, "ipa").alias("ipa"), F.get(F.array(F.lit(None), F.lit("dictionary"), F.lit("guess:fr"), F.lit("user")), F.pmod(k, F.lit(4)).cast("int")).alias("ipa_src"), F.lit("auto").alias("source"),
        (k % 7 == 0).alias("ok_manual"), F.pmod(k, F.lit(6)).alias("ok_print"), k.alias("id"),
    )


@query("""
SELECT p_partkey AS id FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 5 > 0 AND NOT (p_partkey % 3 = 0 AND p_partkey % 4 = 0) AND p_partkey % 4 <> 2 AND p_partkey % 7 <> 0
 AND p_partkey % 6 <> (p_partkey % 20) % 6
""")
def names_to_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entries(spark, sf_dir)
    now = e.select("book", "term").distinct().withColumn("print", F.pmod("book", F.lit(6)))
    return lexicon.to_check(e, ["name"], now).select("id")


@query("""
WITH m AS (SELECT o_custkey % 20 AS book, bool_or(o_orderkey % 40 < 20) AND NOT bool_or(o_custkey % 20 % 3 = 0) AS checked FROM orders WHERE o_custkey % 20 < 15 GROUP BY 1)
SELECT p_partkey AS id, CASE WHEN p_partkey % 97 % 2 = 0 AND coalesce(checked, false) THEN 'Nehm' || (p_partkey % 97) WHEN p_partkey % 97 % 3 = 0 AND NOT coalesce(checked, false) THEN 'Naym' || (p_partkey % 97) ELSE 'Name' || (p_partkey % 97) END AS spoken
FROM part LEFT JOIN m ON book = p_partkey % 20
""")
def spoken_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = F.pmod("o_custkey", F.lit(20))
    engine = F.when(book % 3 == 0, "chatterbox").when(F.col("o_orderkey") % 40 < 20, "higgs").otherwise("f5")
    clips = table(spark, sf_dir, "orders").select(book.alias("book"), engine.alias("engine")).where("book < 15")
    n = F.col("id")
    spell = lambda k, mode, start: spark.range(97).where(n % k == 0).select(F.concat(F.lit("NAME"), n).alias("term"), F.lit(mode).alias("mode"), F.concat(F.lit(start), n).alias("spelling"))
    return lexicon.spoken_forms(_entries(spark, sf_dir), spell(2, "checked", "Nehm").unionByName(spell(3, "verified", "Naym")), lexicon.spelling_modes(clips)).select("id", "spoken")


@query("SELECT p_partkey AS id, p_partkey % 97 < 10 OR p_partkey % 7 = 0 AS ok_manual, CASE WHEN p_partkey % 97 < 90 THEN (p_partkey % 6)::DOUBLE END AS ok_print FROM part")
def lexicon_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names marked good, and others opened again, in every book that has them."""
    names = lambda a, b: spark.range(a, b).select(F.concat(F.lit("nAME"), "id").alias("name"))
    e = lexicon.reopened(_entries(spark, sf_dir), names(90, 97), ["ok_print"])
    return lexicon.marked_good(e, names(0, 10)).select("id", "ok_manual", F.col("ok_print").cast("double").alias("ok_print"))


@query("""
SELECT DISTINCT name, spelling FROM (SELECT 'Name' || (p_partkey % 30) AS name, 'S' || p_size AS spelling, p_partkey FROM part) WHERE p_partkey % 2 = 0
UNION SELECT 'NAME' || (p_partkey % 30), 's' || p_size FROM part WHERE p_partkey % 2 = 1 AND (p_partkey % 30, p_size) NOT IN (SELECT (p_partkey % 30, p_size) FROM part WHERE p_partkey % 2 = 0)
""")
def hints_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, n = table(spark, sf_dir, "part"), F.pmod("p_partkey", F.lit(30))
    old = p.where("p_partkey % 2 = 0").select(F.concat(F.lit("Name"), n).alias("name"), F.concat(F.lit("S"), "p_size").alias("spelling")).distinct()
    new = p.where("p_partkey % 2 = 1").select(F.concat(F.lit("NAME"), n).alias("name"), F.concat(F.lit("s"), "p_size").alias("spelling"))
    return lexicon.hints_added(old, new)


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 AND c_custkey % 3 = 0 THEN c_name || ' is not in the library' WHEN c_custkey % 5 = 1 THEN 'old is not known' WHEN c_custkey % 5 = 2 THEN 'higgs is not installed' END AS problem FROM customer
""")
def voice_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    library, engine = F.when(k % 4 == 0, F.col("c_name")), F.when(k % 5 == 1, "old").when(k % 5 == 2, "higgs").when(k % 5 == 3, "kokoro")
    c = table(spark, sf_dir, "customer")
    there = c.where("c_custkey % 3 <> 0").select("c_custkey", F.lit(True).alias("there"))
    return c.join(there, "c_custkey", "left").select("c_custkey", lexicon.voice_problem(library, F.col("there"), engine, ["kokoro", "f5", "higgs"], ["kokoro", "f5"]).alias("problem"))


@query("""
WITH f AS (SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN 'higgs' WHEN 'N' THEN 'chatterbox' END AS e, min(l_linenumber) AS first FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, coalesce(string_agg(e, '+' ORDER BY first, e) FILTER (e IS NOT NULL), '') AS engines, count(e)::INTEGER AS passes FROM f GROUP BY l_orderkey
""")
def engine_mixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cast = table(spark, sf_dir, "lineitem").withColumn("engine", F.when(F.col("l_returnflag") == "A", "higgs").when(F.col("l_returnflag") == "N", "chatterbox").otherwise("old"))
    return lexicon.engine_mix(cast, "l_orderkey", "l_linenumber", ["kokoro", "higgs", "chatterbox"]).select("l_orderkey", F.array_join("engines", "+").alias("engines"), "passes")


@query("SELECT c_custkey AS book, CASE WHEN c_nationkey % 2 = 0 AND c_nationkey % 4 > 0 THEN n_name ELSE 'default' END AS origin, CASE WHEN c_nationkey % 2 = 0 AND c_nationkey % 4 > 0 THEN 400 + n_nationkey ELSE 700 END AS sentence FROM customer JOIN nation ON n_nationkey = c_nationkey")
def pacing_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    kinds = F.when(F.col("n_nationkey") % 4 > 0, F.create_map(F.lit("sentence"), F.col("n_nationkey") + 400)).otherwise(F.expr("cast(map() as map<string,int>)"))
    profiles = n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("voice"), kinds.alias("kinds"))
    books = table(spark, sf_dir, "customer").join(n, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("book"), F.col("n_name").alias("narrator"))
    return lexicon.pacing_tables(books, profiles, F.create_map(F.lit("sentence"), F.lit(700))).select("book", "origin", F.element_at("kinds", "sentence").alias("sentence"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'slow, gap (remade)' WHEN o_orderkey % 3 = 0 THEN 'rushed' ELSE '' END AS flags, o_custkey % 4 = 0 AS corrected, o_orderkey % 5 > 0 AS made FROM orders WHERE o_orderkey % 7 > 0
""")
def clip_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("f"), "o_orderkey").alias("file"), F.when(F.col("o_orderkey") % 7 > 0, F.concat(F.lit("k"), "o_custkey")).alias("key"), "o_custkey")
    words = lambda *w: F.array(*map(F.lit, w))
    left = o.where("o_orderkey % 3 = 0").select("file", words("rushed").alias("why"), F.lit(False).alias("fixed"))
    fixed = o.where("o_orderkey % 6 = 0").select("file", words("slow", "gap").alias("why"), F.lit(True).alias("fixed"))
    return lexicon.clip_table(o, left.unionByName(fixed), o.where("o_custkey % 4 = 0").select("key"), o.where("o_orderkey % 5 > 0").select("file")).select("o_orderkey", "flags", "corrected", "made")
