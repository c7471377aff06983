"""Queries over conversations as scripts: a turn is a line, a role its speaker."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.operators import segments
from quirespark.plans.registry import query
from quirespark.shared import table


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


_ISLAND = "SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM (SELECT *, CASE WHEN lag(role) OVER w IS NOT DISTINCT FROM role AND lag(turn) OVER w IS NOT NULL THEN 0 ELSE 1 END AS c FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"


@query(f"SELECT conv_id, island::BIGINT AS island, role, min(turn) AS first, count(*) AS lines, md5(string_agg(text, ' ' ORDER BY turn)) AS digest FROM ({_ISLAND}) GROUP BY conv_id, island, role")
def turn_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = segments.merged(_lines(spark, sf_dir), "conv_id", "turn", "role", "text")
    return m.select("conv_id", "island", "role", "first", "lines", F.md5("text").alias("digest"))


@query("SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'Narrator' ELSE role END AS role FROM conversations")
def collapse_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.collapsed(_lines(spark, sf_dir), "role", "system", "Narrator").select("conv_id", "turn", "role")


@query("""
SELECT conv_id, turn, before FROM (SELECT *, coalesce(right(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), 70), '') AS before FROM conversations) WHERE role = 'user'
""")
def lines_with_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.with_context(_lines(spark, sf_dir), "conv_id", "turn", "text").where("role = 'user'").select("conv_id", "turn", "before")


@query("""
SELECT role, lines, row_number() OVER (ORDER BY role <> 'system', lines DESC, seen)::INTEGER AS rank FROM
(SELECT role, count(*) AS lines, min({'c': conv_id, 't': turn}) AS seen FROM conversations GROUP BY role)
""")
def role_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.roles(_lines(spark, sf_dir), "role", "system", ["conv_id", "turn"])


@query("""
SELECT conv_id, turn, coalesce(role = lag(role, 2) OVER w AND role <> lag(role, 1) OVER w, false) AS alternates FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
""")
def speaker_alternation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.alternations(_lines(spark, sf_dir), "conv_id", "turn", "role").select("conv_id", "turn", "alternates")


@query("""
SELECT conv_id, turn, last_value(CASE WHEN role <> 'assistant' THEN role END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS addressed FROM conversations
""")
def carried_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _lines(spark, sf_dir).withColumn("named", F.when(F.col("role") != "assistant", F.col("role")))
    return segments.last_known(named, "conv_id", "turn", "named", "addressed").select("conv_id", "turn", "addressed")


@query(r"""
WITH s AS (SELECT conv_id, turn, text, CASE WHEN role = 'user' THEN 'dialogue' ELSE 'narration' END AS kind, turn % 2 = 0 AS para_start, turn = 4 AS section_break, CASE WHEN turn = 3 THEN 500 END AS pause_ms FROM conversations),
l AS (SELECT *, lag(kind) OVER w AS pk, rtrim(lag(text) OVER w) AS pt FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, CASE WHEN pt IS NULL THEN 'chapter_start' WHEN section_break THEN 'section_gap' WHEN coalesce(pause_ms, 0) > 0 THEN 'explicit'
 WHEN regexp_matches(pt, '[,;:—–-]$') THEN CASE WHEN pk = 'dialogue' AND kind = 'narration' THEN 'before_tag' WHEN pk = 'dialogue' THEN 'comma_dialogue' ELSE 'comma_narration' END
 WHEN pk = 'dialogue' AND kind = 'narration' AND length(text) < 90 THEN 'before_tag' WHEN para_start THEN 'paragraph' ELSE 'speaker_change' END AS pause_kind FROM l
""")
def pause_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _lines(spark, sf_dir).select(
        "conv_id", "turn", "text", F.when(F.col("role") == "user", "dialogue").otherwise("narration").alias("kind"), (F.col("turn") % 2 == 0).alias("para_start"),
        (F.col("turn") == 4).alias("section_break"), F.when(F.col("turn") == 3, 500).alias("pause_ms"),
    )
    return segments.pause_kind(s, "conv_id", "turn").select("conv_id", "turn", "pause_kind")


@query("""
SELECT conv_id, turn, (sum(ms) OVER w - ms)::BIGINT AS start_ms, (sum(ms) OVER w)::BIGINT AS end_ms FROM (SELECT *, round(length(text) / 14.5::DOUBLE * 1000)::BIGINT AS ms FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
""")
def marker_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = _lines(spark, sf_dir).withColumn("seconds", F.char_length("text") / F.lit(14.5))
    return segments.offsets(timed, "conv_id", "turn", "seconds").select("conv_id", "turn", "start_ms", "end_ms")


@query("""
SELECT conv_id, turn, round(0.6 * v + 0.2 * coalesce(lag(v) OVER w, 0) + 0.2 * coalesce(lead(v) OVER w, 0), 6) AS weighed,
 round(avg(v) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS averaged FROM (SELECT *, length(text)::DOUBLE AS v FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
""")
def smoothed_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments.smoothed(_lines(spark, sf_dir).withColumn("v", F.char_length("text").cast("double")), "conv_id", "turn", "v")
    return s.select("conv_id", "turn", F.round("weighed", 6).alias("weighed"), F.round("averaged", 6).alias("averaged"))


@query(r"""
SELECT conv_id, turn, CASE WHEN b = '' OR regexp_matches(b, '[.!?…]$') THEN 'end' WHEN regexp_matches(b, '[,;:—–-]$') THEN 'comma' ELSE 'space' END AS cut FROM (SELECT *, regexp_replace(rtrim(text), '["”’'')\]]+$', '') AS b FROM conversations)
""")
def join_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("conv_id", "turn", segments.join_kind(F.col("text")).alias("cut"))


_GAPS = [(", ", "comma"), (". ", "period"), ("?” ", "question+closequote"), (". “", "period+openquote"), (".\n\n", "paragraph"), (" — ", "dash"), ("; ", "semicolon"), (" ", "word"), ("… ", "ellipsis"), (",” ", "comma+closequote"), (" “", "quote"), ("! ", "exclaim")]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{c}')" for i, (_, c) in enumerate(_GAPS)) + ") AS t(i, cls)")
def boundary_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, g) for i, (g, _) in enumerate(_GAPS)], "i int, gap string")
    return rows.select("i", segments.boundary_class(F.col("gap")).alias("cls"))


@query("""
WITH b AS (SELECT conv_id, turn AS pos, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
SELECT conv_id, pos, length(text)::INTEGER AS chars, (CASE WHEN n = 1 THEN 2800 ELSE 0 END)::INTEGER AS pause_ms FROM b
UNION ALL SELECT DISTINCT conv_id, -1::BIGINT, length('Talk ' || conv_id)::INTEGER, 0 FROM conversations
""")
def title_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _lines(spark, sf_dir)
    titles = c.select("conv_id").distinct().withColumn("title", F.concat(F.lit("Talk "), F.col("conv_id").cast("string")))
    return segments.titled(c, titles, "conv_id", "turn", 2800).select("conv_id", "pos", F.char_length("text").alias("chars"), "pause_ms")


@query("""
SELECT conv_id, turn, role, m FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY m DESC, k) AS r FROM (SELECT *, length(text)::INTEGER AS m, conv_id * 100 + turn AS k FROM conversations)) WHERE r <= 8 ORDER BY m DESC, k LIMIT 20
""")
def capped_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _lines(spark, sf_dir).withColumn("m", F.char_length("text")).withColumn("k", F.col("conv_id") * 100 + F.col("turn"))
    return segments.capped_best(c, "role", "m", "k", 20, 8).select("conv_id", "turn", "role", "m")


@query("""
WITH f AS (SELECT vec_id, unnest(range(0, len(embedding))) AS i, abs(unnest(embedding)) < 0.1 AS quiet FROM embeddings),
s AS (SELECT vec_id, min(CASE WHEN NOT quiet THEN i END) AS a, max(CASE WHEN NOT quiet THEN i END) AS z, avg(quiet::INTEGER) AS q FROM f GROUP BY vec_id),
r AS (SELECT f.vec_id, i - row_number() OVER (PARTITION BY f.vec_id ORDER BY i) AS run FROM f JOIN s USING (vec_id) WHERE quiet AND i BETWEEN a AND z),
n AS (SELECT vec_id, max(n) AS longest FROM (SELECT vec_id, run, count(*) AS n FROM r GROUP BY vec_id, run) GROUP BY vec_id)
SELECT vec_id, coalesce(longest, 0)::BIGINT AS longest, round(q, 6) AS quiet_share FROM s LEFT JOIN n USING (vec_id)
""")
def longest_quiet_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x")).withColumn("quiet", F.abs("x") < 0.1)
    return segments.longest_run(frames, "vec_id", "i", "quiet").select("vec_id", "longest", F.round("quiet_share", 6).alias("quiet_share"))
