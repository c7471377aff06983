"""Queries on clips, statistics, vectors and keyed updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.operators import clips, stats
from quirespark.plans.registry import query
from quirespark.shared import table

_CLIPS_SQL = """(SELECT l_orderkey * 10 + l_linenumber AS clip, l_returnflag AS engine, p_name || CASE WHEN l_linenumber = 1 THEN ' — and on' ELSE '' END AS text, floor(l_extendedprice / 100)::BIGINT AS chars, l_quantity AS seconds, l_quantity * 0.8 AS speech,
 l_discount * 40 AS longest_gap, l_tax * 9 AS silent_share, CASE WHEN l_shipdate < TIMESTAMP '1993-01-01' THEN 'silent' END AS broken FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def _clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as clips: prices as characters, quantities as seconds."""
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return l.join(p, "l_partkey").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("clip"), F.col("l_returnflag").alias("engine"),
        F.concat("p_name", F.when(F.col("l_linenumber") == 1, " — and on").otherwise("")).alias("text"), F.floor(F.col("l_extendedprice") / 100).cast("long").alias("chars"),
        F.col("l_quantity").alias("seconds"), (F.col("l_quantity") * 0.8).alias("speech"), (F.col("l_discount") * 40).alias("longest_gap"), (F.col("l_tax") * 9).alias("silent_share"),
        F.when(F.col("l_shipdate") < F.lit("1993-01-01").cast("timestamp_ntz"), "silent").alias("broken"),
    )


_PACE = f"(SELECT engine, CASE WHEN count(*) >= 20 THEN quantile_cont(chars / speech, 0.5) END AS median_pace FROM {_CLIPS_SQL} WHERE chars >= 25 AND speech > 0.5 GROUP BY engine)"
_LETTERS = "(length(regexp_replace(text, '[^A-Za-zÀ-ÖØ-öø-ÿ]', '', 'g')) / greatest(1, length(text))::DOUBLE)"


@query(f"SELECT engine, round(median_pace, 6) AS median_pace FROM {_PACE}")
def engine_pace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clips.usual_pace(_clips(spark, sf_dir)).select("engine", F.round("median_pace", 6).alias("median_pace"))


@query(f"""
WITH c AS (SELECT *, len(regexp_extract_all(text, '—|–|\\.\\.\\.|…| - ')) AS d, chars / speech AS pace FROM {_CLIPS_SQL} JOIN {_PACE} USING (engine))
SELECT clip, CASE WHEN broken IS NOT NULL THEN broken ELSE concat_ws(',', CASE WHEN longest_gap > 2.0 + 1.5 * d THEN 'dead air' END, CASE WHEN silent_share > 0.6 + CASE WHEN d > 0 THEN 0.2 ELSE 0 END AND seconds >= 1.5 THEN 'mostly silence' END,
 CASE WHEN chars >= 25 AND {_LETTERS} >= 0.5 THEN CASE WHEN pace > 1.6 * median_pace THEN 'rushed' WHEN pace < 0.45 * median_pace THEN 'drawn out' END END) END AS problems FROM c
""")
def pace_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _clips(spark, sf_dir)
    return clips.problems(c.join(clips.usual_pace(c), "engine")).select("clip", F.array_join("problems", ",").alias("problems"))


@query(f"""
WITH b AS (SELECT clip // 10 AS clip_group, clip % 10 AS attempt, CASE WHEN broken IS NOT NULL THEN 1e9::DOUBLE ELSE greatest(0, longest_gap - 0.8) + 3 * greatest(0, silent_share - 0.3) + CASE WHEN chars >= 25 THEN 2 * abs(ln((chars / speech) / median_pace)) ELSE 0 END END AS badness
 FROM {_CLIPS_SQL} JOIN {_PACE} USING (engine))
SELECT clip_group, arg_min(attempt, {{'b': badness, 'a': attempt}}) AS best, round(min(badness), 6) AS badness FROM b GROUP BY clip_group
""")
def best_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _clips(spark, sf_dir)
    a = c.join(clips.usual_pace(c), "engine").withColumn("clip_group", F.floor(F.col("clip") / 10)).withColumn("attempt", F.pmod("clip", F.lit(10)).cast("long"))
    return clips.best_attempts(a, "clip_group", "attempt").select("clip_group", "best", F.round("badness", 6).alias("badness"))


@query("""
SELECT l_orderkey, len(list_filter(t, lambda x: x < 0.3)) >= 1 OR len(list_filter(t, lambda x: x < 0.4)) >= 2 OR len(list_filter(t, lambda x: x < 0.5)) >= 3 OR len(list_filter(t, lambda x: x < 0.6)) >= 4 AS due
FROM (SELECT l_orderkey, list(l_discount * 9 + 0.2::DOUBLE) AS t FROM lineitem GROUP BY l_orderkey)
""")
def takes_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose lineitems, as scores of takes, are low often enough to be recorded anew."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_discount") * 9 + 0.2).alias("takes"))
    return rows.select("l_orderkey", clips.take_due(F.col("takes"), [(0.3, 1), (0.4, 2), (0.5, 3), (0.6, 4)]).alias("due"))


@query("""
SELECT l_partkey AS name, count(*) AS clips, round(arg_min(l_discount, l_orderkey * 10 + l_linenumber), 6) AS first, round(quantile_cont(l_discount, 0.5), 6) AS median, count(*) FILTER (l_discount < 0.05) AS below_good FROM lineitem GROUP BY l_partkey
""")
def take_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    takes = table(spark, sf_dir, "lineitem").withColumn("at", F.col("l_orderkey") * 10 + F.col("l_linenumber")).withColumnRenamed("l_partkey", "name")
    return clips.take_summary(takes, "name", "at", "l_discount", 0.05).select("name", "clips", F.round("first", 6).alias("first"), F.round("median", 6).alias("median"), "below_good")


@query("SELECT doc_id AS file FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unused_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    files, planned = docs.select(F.col("doc_id").alias("file")), labels.select(F.col("doc_id").alias("file"))
    chapters = docs.select(F.col("source").alias("chapter")).distinct()
    return clips.unused(files, planned, chapters, chapters)


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'license')")
def clip_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clips.search(table(spark, sf_dir, "documents"), "text", " The  license ").select("doc_id")


@query("""
SELECT key, coalesce(a.v, b.v, c.v) AS value, CASE WHEN a.v IS NOT NULL THEN 0 WHEN b.v IS NOT NULL THEN 1 ELSE 2 END::INTEGER AS source FROM (SELECT DISTINCT p_partkey AS key FROM part)
LEFT JOIN (SELECT p_partkey AS key, p_brand AS v FROM part WHERE p_partkey % 3 = 0) AS a USING (key) LEFT JOIN (SELECT p_partkey AS key, p_type AS v FROM part WHERE p_partkey % 2 = 0) AS b USING (key) LEFT JOIN (SELECT p_partkey AS key, p_name AS v FROM part) AS c USING (key)
""")
def first_source_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "key")
    sources = [p.where("key % 3 = 0").withColumn("v", F.col("p_brand")), p.where("key % 2 = 0").withColumn("v", F.col("p_type")), p.withColumn("v", F.col("p_name"))]
    return clips.first_source(sources, "key", "v")


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'edited' ELSE c_mktsegment END AS segment FROM customer UNION ALL SELECT -1::BIGINT, 'new'
""")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    new = old.where("c_custkey % 5 = 0").withColumn("segment", F.lit("edited")).unionByName(spark.createDataFrame([(-1, "new")], "c_custkey long, segment string"))
    return clips.upserted(old, new, ["c_custkey"])


@query("""
WITH c AS (SELECT p_partkey AS term, p_name AS ipa, p_brand AS respell, p_partkey % 4 AS k FROM part),
x AS (SELECT *, CASE WHEN k = 1 THEN 'old' ELSE ipa END AS s_ipa, respell AS s_respell, CASE WHEN k = 1 THEN 'old' WHEN k = 2 THEN NULL ELSE ipa END AS e_ipa, CASE WHEN k >= 2 THEN respell || '!' ELSE respell END AS e_respell FROM c),
w AS (SELECT *, e_ipa IS DISTINCT FROM ipa AND e_ipa IS DISTINCT FROM s_ipa AND e_ipa IS NOT NULL AS a, e_respell IS DISTINCT FROM respell AND e_respell IS DISTINCT FROM s_respell AND e_respell IS NOT NULL AS b FROM x)
SELECT term, CASE WHEN a THEN e_ipa ELSE ipa END AS ipa, CASE WHEN b THEN e_respell ELSE respell END AS respell, CASE WHEN a OR b THEN 'user' END AS edited_by FROM w
""")
def three_way_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entries: what changed since the snapshot stays, what was edited counts, what was emptied does not."""
    k = F.col("term") % 4
    now = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("term"), F.col("p_name").alias("ipa"), F.col("p_brand").alias("respell"))
    snap = now.withColumn("ipa", F.when(k == 1, "old").otherwise(F.col("ipa")))
    edit = now.withColumns({"ipa": F.when(k == 1, "old").when(k == 2, None).otherwise(F.col("ipa")), "respell": F.when(k >= 2, F.concat("respell", F.lit("!"))).otherwise(F.col("respell"))})
    return clips.three_way(now, snap, edit, "term", ["ipa", "respell"])


@query("""
SELECT c_custkey, ['v1', 'v2', 'v3'][1 + ((row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) - 1) % 3)] AS voice FROM customer WHERE c_mktsegment = 'BUILDING'
 UNION ALL SELECT c_custkey, ['w1', 'w2'][1 + ((row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) - 1) % 2)] FROM customer WHERE c_mktsegment = 'MACHINERY'
""")
def dealt_voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_mktsegment IN ('BUILDING', 'MACHINERY')")
    return clips.pooled(c, "c_mktsegment", [F.desc("c_acctbal"), F.asc("c_custkey")], {"BUILDING": ["v1", "v2", "v3"], "MACHINERY": ["w1", "w2"]}).select("c_custkey", "voice")


@query("SELECT s_suppkey, 'p' || ((strpos('0123456789abcdef', right(md5(s_name), 1)) - 1) % 8)::INTEGER AS voice FROM supplier")
def hashed_voice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", clips.hash_pick(F.col("s_name"), [f"p{i}" for i in range(8)]).alias("voice"))


@query("SELECT doc_id, md5(text) AS mark FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0")
def only_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("mark"))
    cache = d.where("doc_id % 3 = 0").withColumn("mark", F.when(F.col("doc_id") % 2 == 0, "stale").otherwise(F.col("mark")))
    return clips.only_changed(d, cache, "doc_id", "mark")


@query("""
SELECT n_nationkey, '-' AS sign FROM nation WHERE n_nationkey >= 20 UNION ALL SELECT n_nationkey + 100, '+' FROM nation WHERE n_nationkey >= 20
""")
def line_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "nation").select("n_nationkey")
    new = old.select(F.when(F.col("n_nationkey") >= 20, F.col("n_nationkey") + 100).otherwise(F.col("n_nationkey")).alias("n_nationkey"))
    return clips.differences(old, new)


@query("""
SELECT event_type, count(*) AS n, round(avg((v < 100)::INTEGER), 6) AS short_share, round(quantile_cont(v, 0.5), 6) AS median_ms, round(avg(ln(l)), 6) AS mu, round(stddev_pop(ln(l)), 6) AS sigma, round(quantile_cont(l, 0.03), 6) AS lo_ms, round(quantile_cont(l, 0.97), 6) AS hi_ms
FROM (SELECT *, CASE WHEN v >= 100 THEN v END AS l FROM (SELECT event_type, value * 10 AS v FROM events)) GROUP BY event_type HAVING count(*) >= 15
""")
def pacing_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stats.pacing_table(table(spark, sf_dir, "events").withColumn("v", F.col("value") * 10), "event_type", "v")
    return t.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("short_share", "median_ms", "mu", "sigma", "lo_ms", "hi_ms")])


@query("""
SELECT event_type, n, round(slope, 6) AS slope, round(slope / sqrt((syy - slope * slope * sxx) / (n - 2) / sxx), 4) AS t FROM (SELECT event_type, count(*) AS n, regr_slope(y, x) AS slope, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy
 FROM (SELECT event_type, ln(1 + value) AS y, (extract(hour FROM ts))::DOUBLE AS x FROM events) GROUP BY event_type) WHERE n >= 100
""")
def pause_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = stats.regression(table(spark, sf_dir, "events"), "event_type", F.log1p("value"), F.hour("ts").cast("double"))
    return r.select("event_type", "n", F.round("slope", 6).alias("slope"), F.round("t", 4).alias("t"))


@query("""
WITH r AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0::DOUBLE AS x, rank() OVER (PARTITION BY event_type ORDER BY user_id) + (count(*) OVER (PARTITION BY event_type, user_id) - 1) / 2.0::DOUBLE AS y FROM events)
SELECT event_type, round(corr(x, y), 6) AS rho, count(*) AS n FROM r GROUP BY event_type
""")
def rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.spearman(table(spark, sf_dir, "events"), "event_type", "value", "user_id").select("event_type", F.round("rho", 6).alias("rho"), "n")


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, " + ", ".join(f"round(quantile_cont(value, {q / 100}), 6) AS p{q}" for q in (10, 25, 50, 75, 90)) + " FROM events GROUP BY event_type")
def boundary_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stats.spread(table(spark, sf_dir, "events"), "event_type", "value")
    return s.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "p10", "p25", "p50", "p75", "p90")])


@query()
def drawn_pauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", stats.drawn_pause(F.col("event_id"), *[F.lit(x) for x in (0.1, 6.3, 0.4, 200.0, 1500.0)]).alias("pause_ms"))


@query("""
SELECT user_id, n, round(m, 6) AS median, CASE WHEN n < 10 THEN 'unknown' WHEN m < 155 THEN 'male' WHEN m > 175 THEN 'female' ELSE 'unknown' END AS gender FROM (SELECT user_id, count(value) AS n, quantile_cont(value * 3, 0.5) AS m FROM events GROUP BY user_id)
""")
def pitch_gender(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = stats.gender_of_pitch(table(spark, sf_dir, "events").withColumn("f0", F.col("value") * 3), "user_id", "f0")
    return g.select("user_id", "n", F.round("median", 6).alias("median"), "gender")


@query("""
WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS u FROM embeddings),
m AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(range(0, len(u))) AS i, unnest(u) AS x FROM u) GROUP BY label, i) GROUP BY label)
SELECT vec_id, label, round(list_cosine_similarity(u, c), 5) AS cosine FROM u JOIN m USING (label)
""")
def cosine_to_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = stats.cosine_to_centroid(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")
    return c.select("vec_id", "label", F.round("cosine", 5).alias("cosine"))
