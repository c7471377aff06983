"""Queries on script functions and on the tables that tools edit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.functions import script as S
from quirespark.operators import books, clips, desk
from quirespark.plans.books import _SENT as _SENT_TABLE
from quirespark.plans.registry import query
from quirespark.shared import table


def _rows(values: dict) -> str:
    sql = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + str(v).replace("'", "''") + "'"
    return ", ".join(f"({sql(k)}, {sql(v)})" for k, v in values.items())


def _given(spark: SparkSession, values: dict, kind: str) -> DataFrame:
    return spark.createDataFrame([(k,) for k in values], f"{kind} string")


def _in(words: list[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


@query(f"""
WITH s AS (SELECT doc_id, para, sent, regexp_extract_all(ltrim(replace(sentence, '’', ''''), '"“‘''([ '), '[\\p{{L}}\\p{{N}}_'']+')[1:5] AS w FROM {_SENT_TABLE})
SELECT doc_id, para::INTEGER AS para, sent::INTEGER AS sent, len(w) >= 2 AND (coalesce(lower(w[1]) IN {_in(S.AUXILIARIES)} AND (lower(w[2]) IN {_in(S.SUBJECTS)} OR regexp_matches(w[2], '^\\p{{Lu}}')), false)
 OR coalesce(lower(w[1]) IN {_in(S.QUESTION_WORDS)}, false) AND (coalesce(lower(w[2]) IN {_in(S.AUXILIARIES)}, false) OR coalesce(lower(w[3]) IN {_in(S.AUXILIARIES)} AND lower(w[2]) NOT IN {_in(S.PRONOUNS)}, false)
 OR coalesce(lower(w[4]) IN {_in(S.AUXILIARIES)} AND lower(w[2]) NOT IN {_in(S.PRONOUNS)} AND lower(w[3]) NOT IN {_in(S.PRONOUNS)}, false))) AS question FROM s
""")
def question_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sentences of the documents have the form of a question."""
    s = books.sentence_rows(table(spark, sf_dir, "documents"))
    return s.select("doc_id", "para", "sent", S.looks_like_question(F.col("sentence")).alias("question"))


@query(f"""SELECT doc_id, para::INTEGER AS para, sent::INTEGER AS sent, md5(regexp_replace(rtrim(sentence), '(?s)^(.*?)[.…]*(["”’'')\\]]*)$', '\\1?\\2')) AS digest FROM {_SENT_TABLE}""")
def question_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of the documents with a question mark for its stop."""
    s = books.sentence_rows(table(spark, sf_dir, "documents"))
    return s.select("doc_id", "para", "sent", F.md5(S.with_question_mark(F.col("sentence"))).alias("digest"))


@query("SELECT doc_id, len(q)::INTEGER AS quotes, coalesce(list_sum(list_transform(q, lambda x: length(x))), 0)::INTEGER AS chars FROM (SELECT doc_id, regexp_extract_all(text, '[“\"]([^”\"]+)[”\"]', 1) AS q FROM documents)")
def quote_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = S.quotes(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(q).alias("quotes"), F.aggregate(q, F.lit(0), lambda a, x: a + F.char_length(x)).alias("chars"))


_SAID = {"“Go home,” said Anna.": "Anna", "“No.” Bob replied at once.": "Bob", "Carl asked, “Who?”": "Carl", "“Alone.”": None}


@query(f"SELECT * FROM (VALUES {_rows(_SAID)}) AS t(text, speaker)")
def named_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _given(spark, _SAID, "text").select("text", S.named_speaker(F.col("text")).alias("speaker"))


@query("SELECT * FROM (VALUES ('He rose. He went. Then he spoke.', 'He rose.', 'Then he spoke.'), ('', '', '')) AS t(gap, first, last)")
def gap_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([("He rose. He went. Then he spoke.",), ("",)], "gap string").select("gap", S.fragments(F.col("gap")).alias("f")).select("gap", "f.*")


_SENT = {"Current": "current", "now #3": "start", "send my book": "send", "Queue!": "queue", "Anna | AN-uh": "suggest", "good Anna": "good", "hello there": None, "finished": "done"}


@query(f"SELECT * FROM (VALUES {_rows(_SENT)}) AS t(text, command)")
def message_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _given(spark, _SENT, "text").select("text", S.command(F.col("text")).alias("command"))


@query("SELECT role, count(*) AS n FROM conversations WHERE lower(trim(text)) IN ('help', 'stop', 'queue', 'done') OR role = 'system' GROUP BY role")
def command_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.where(F.lower(F.btrim("text")).isin("help", "stop", "queue", "done") | (F.col("role") == "system")).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, CASE WHEN s >= 3600 THEN printf('%dh %02dm', s // 3600, s % 3600 // 60) ELSE printf('%dm %02ds', s // 60, s % 60) END AS clock FROM (SELECT o_orderkey, floor(o_totalprice / 14.5)::BIGINT AS s FROM orders)")
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", S.clock(F.col("o_totalprice") / 14.5).alias("clock"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_brand || ' & ' || p_type), '[^a-z0-9]+', '-', 'g'), '-') AS slug, repeat('★', p_size % 6) || repeat('☆', 5 - p_size % 6) AS stars FROM part")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", S.slug(F.concat("p_brand", F.lit(" & "), "p_type")).alias("slug"), S.stars(F.pmod("p_size", F.lit(6))).alias("stars"))


@query("SELECT c_custkey, key, kind, name, nullif(engine, '') AS engine, key AS again FROM (SELECT *, kind || ':' || name || CASE WHEN engine = '' THEN '' ELSE '@' || engine END AS key FROM (SELECT c_custkey, lower(c_mktsegment) AS kind, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'e' || c_nationkey END AS engine FROM customer))")
def voice_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as keys of voices, taken apart and put together again."""
    engine = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.concat(F.lit("@e"), "c_nationkey"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lower("c_mktsegment"), F.lit(":"), "c_name", engine).alias("key"))
    v = c.select("c_custkey", "key", S.voice_of(F.col("key")).alias("v")).select("c_custkey", "key", "v.*")
    return v.withColumn("again", S.voice_key(F.col("kind"), F.col("name"), F.col("engine")))


_SOUNDS = {"ˈɛdmɔn": True, "edmond": False, "mɛri!": False, "θɪŋ": True}


@query(f"SELECT * FROM (VALUES {_rows(_SOUNDS)}) AS t(s, sounds)")
def phonetic_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _given(spark, _SOUNDS, "s").select("s", S.looks_like_sounds(F.col("s")).alias("sounds"))


_LICENCES = {"CC BY-SA 4.0": True, "cc-by-nc": False, "Public domain": True, "All rights reserved": False, "CC0": True}


@query(f"SELECT * FROM (VALUES {_rows(_LICENCES)}) AS t(name, free)")
def free_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _given(spark, _LICENCES, "name").select("name", S.free_licence(F.col("name")).alias("free"))


@query("SELECT * FROM (VALUES ('ʃa', 'tʃæt')) AS t(fr, en)")
def wiktionary_sounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = "==English==\n* {{IPA|en|[tʃæt]|/tʃæt/}}\n==French==\n===Noun===\n* {{IPA|fr|/ʃa/}}\n"
    p = spark.createDataFrame([(page,)], "page string")
    return p.select(S.wiktionary_sounds(F.col("page"), "fr", "French").alias("fr"), S.wiktionary_sounds(F.col("page"), "en", "English").alias("en"))


@query("SELECT * FROM (VALUES ('he whispered softly', -0.3::DOUBLE, -0.1::DOUBLE), ('he cried and cried again', 0.3::DOUBLE, 0.1::DOUBLE), ('he sat', 0.0::DOUBLE, 0.0::DOUBLE)) AS t(text, exaggeration, guidance)")
def tag_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.createDataFrame([("he whispered softly",), ("he cried and cried again",), ("he sat",)], "text string")
    return t.select("text", S.tag_shift(F.col("text"), {"whispered": (-0.25, -0.1), "softly": (-0.1, 0.0), "cried": (0.2, 0.05)}).alias("s")).select("text", "s.*")


@query("SELECT * FROM (VALUES (1, 'joy', 0.52::DOUBLE), (1, 'neutral', 0.48::DOUBLE), (2, 'neutral', 1.0::DOUBLE)) AS t(id, feeling, p)")
def blended_feelings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, {"neutral": 0.8, "joy": 0.2}, {"neutral": 0.3076923, "joy": 0.6923077}), (2, {"neutral": 1.0}, None)], "id int, a map<string,double>, b map<string,double>")
    return rows.select("id", F.explode(S.blended(F.col("a"), F.col("b"))).alias("feeling", "p")).select("id", "feeling", F.round("p", 6).alias("p"))


_CALM = {"Mr. D OUGLASS and P ATRICK H ENRY , of old , said JOHN went.": "Mr. Douglass and Patrick Henry, of old, said John went.", "THE NASA MAN SAW XIV STARS": "The NASA man saw XIV stars"}


@query(f"SELECT * FROM (VALUES {_rows(_CALM)}) AS t(text, calm)")
def calm_capitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _given(spark, _CALM, "text").select("text", S.calm_capitals(F.col("text"), ["douglass", "patrick", "henry", "john"], ["NASA"]).alias("calm"))


@query("SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN 'Guide' ELSE role END AS speaker, CASE WHEN CASE WHEN turn % 5 = 0 THEN 'Guide' ELSE role END = 'system' THEN 'narration' ELSE 'dialogue' END AS kind FROM conversations")
def reassigned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("k", F.col("conv_id") * 1000 + F.col("turn")).withColumn("speaker", F.col("role"))
    return desk.reassigned(c, c.where("turn % 5 = 0"), "k", "Guide", narrator="system").select("conv_id", "turn", "speaker", "kind")


@query("SELECT c_custkey AS role, CASE WHEN c_custkey % 4 = 0 THEN 'own' WHEN c_nationkey % 2 = 0 THEN 'even' ELSE 'default' END AS voice FROM customer")
def resolved_voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("role"), "c_nationkey")
    own = c.where("role % 4 = 0").select("role", F.lit("own").alias("voice"))
    return desk.voices(c, own, "default", F.when(F.col("c_nationkey") % 2 == 0, "even")).select("role", "voice")


@query("SELECT doc_id AS key, md5(CASE WHEN doc_id % 3 = 0 THEN 'new ' || text ELSE text END) AS digest FROM documents")
def guarded_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes for two thirds of all documents, half of them made for a text that is no longer there."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    fixes = d.where("key % 3 < 2").select("key", F.when(F.col("key") % 3 == 0, F.col("text")).otherwise(F.concat("text", F.lit("!"))).alias("was"), F.concat(F.lit("new "), "text").alias("new"))
    return desk.guarded_fixes(d, fixes, "key").select("key", F.md5("text").alias("digest"))


@query("""
WITH e AS (SELECT o_custkey, o_orderpriority, o_totalprice % 97 / 100 AS a, o_totalprice % 31 / 100 AS b FROM orders),
m AS (SELECT o_custkey, 'DE' AS setting, avg(a) AS p FROM e GROUP BY 1 UNION ALL SELECT o_custkey, 'US', avg(b) FROM e GROUP BY 1),
t AS (SELECT o_custkey, arg_max(setting, p) AS setting, max(p) AS p FROM m GROUP BY 1)
SELECT o_custkey AS name, CASE WHEN p >= CASE WHEN o_custkey % 2 = 0 THEN 0.55 ELSE 0.45 END THEN setting ELSE 'US' END AS setting FROM t
""")
def name_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as passages that name their customer, with chances of two settings."""
    probs = F.create_map(F.lit("DE"), F.col("o_totalprice") % 97 / 100, F.lit("US"), F.col("o_totalprice") % 31 / 100)
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("name"), (F.col("o_custkey") % 2 == 0).alias("in_dictionary"), probs.alias("probs"), "o_orderkey")
    return desk.origins(rows, "name", "probs", 0.45, 0.55, order="o_orderkey").select("name", "setting")


@query("SELECT l_orderkey, string_agg(f, ', ' ORDER BY n DESC, f) AS labels, round(sum(n), 2) AS total FROM (SELECT l_orderkey, l_returnflag AS f, sum(l_quantity) AS n FROM lineitem GROUP BY l_orderkey, l_returnflag) GROUP BY l_orderkey")
def engine_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return desk.engine_labels(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", "l_quantity").select("l_orderkey", "labels", F.round("total", 2).alias("total"))


@query("SELECT * FROM (VALUES ('Abi-el', 'abiɛl', 3::BIGINT, 'kjv=3'), ('Abiel', 'abiɛl', 5::BIGINT, 'asv=1,kjv=4')) AS t(word, ipa, count, texts)")
def alias_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("Abiel", "abiɛl", "kjv", 4), ("Abiel", None, "asv", 1), ("Abi-el", None, "kjv", 3)]
    w = desk.alias_readings(spark.createDataFrame(rows, "word string, ipa string, label string, count long"))
    return w.select("word", "ipa", "count", F.array_join(F.transform(F.map_entries("texts"), lambda e: F.concat(e.key, F.lit("="), e.value)), ",").alias("texts"))


@query("""
WITH r AS (SELECT *, sum((event_type = 'error')::INTEGER) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM events),
s AS (SELECT *, sum(value + 0.4) OVER (PARTITION BY user_id, run ORDER BY event_id) AS so_far, first_value(event_id) OVER (PARTITION BY user_id, run ORDER BY event_id) AS first FROM r WHERE event_type <> 'error')
SELECT user_id, first, last, round(so_far, 4) AS so_far FROM (SELECT user_id, first, event_id AS last, so_far, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM s WHERE so_far >= 300) WHERE n = 1
""")
def sample_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("there", F.col("event_type") != "error")
    return desk.first_long_run(e, "user_id", "event_id", "there", "value", 300.0).select("user_id", "first", "last", F.round("so_far", 4).alias("so_far"))


@query("""
WITH p AS (SELECT conv_id, role, count(*) AS n, sum(length(text)) AS chars FROM conversations GROUP BY conv_id, role)
SELECT conv_id, coalesce(string_agg(CASE WHEN role <> 'system' AND n >= 2 THEN role END, ',' ORDER BY role), '') AS cast_, round(sum(CASE WHEN role <> 'system' THEN chars ELSE 0 END) / sum(chars)::DOUBLE, 6) AS dialogue,
 count(*) FILTER (role <> 'system' AND n >= 2) >= 2 AND sum(CASE WHEN role <> 'system' THEN chars ELSE 0 END) / sum(chars)::DOUBLE >= 0.3 AS many FROM p GROUP BY conv_id
""")
def book_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumnRenamed("role", "speaker")
    return desk.cast_of(c, "conv_id", 2, 2, 0.3, "system").select("conv_id", F.array_join("cast", ",").alias("cast_"), F.round("dialogue", 6).alias("dialogue"), "many")


@query("""
SELECT o_orderkey, 'no customer' AS message FROM orders WHERE o_custkey % 7 = 0 UNION ALL SELECT o_orderkey, 'price out of range' FROM orders WHERE NOT o_totalprice BETWEEN 1000 AND 300000 UNION ALL SELECT o_orderkey, 'status unknown' FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
""")
def broken_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constraints of range, choice and reference as messages."""
    known = table(spark, sf_dir, "customer").where("c_custkey % 7 != 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("known"))
    o = table(spark, sf_dir, "orders").join(known, "o_custkey", "left")
    rules = [("price out of range", F.col("o_totalprice").between(1000, 300000)), ("status unknown", F.col("o_orderstatus").isin("F", "O")), ("no customer", F.col("known").isNotNull())]
    return desk.expectations(o, "o_orderkey", rules)


@query("SELECT source, coalesce(string_agg(lang, ',' ORDER BY lang) FILTER (NOT EXISTS (SELECT 1 FROM documents AS s WHERE s.source = d.source AND s.lang = d.lang AND s.doc_id < 100)), '') AS new FROM (SELECT DISTINCT source, lang FROM documents) AS d GROUP BY source")
def new_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return desk.new_since(d, d.where("doc_id < 100"), "source", "lang").select("source", F.array_join("new", ",").alias("new"))


@query("""
SELECT l_orderkey AS book, l_linenumber AS next FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag = 'N', l_linenumber) AS n FROM lineitem WHERE l_returnflag <> 'R') WHERE n = 1
""")
def next_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems as stages of orders: A is stale, N recommended, R done."""
    status = F.when(F.col("l_returnflag") == "A", "stale").when(F.col("l_returnflag") == "N", "recommended").otherwise("done")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("book"), F.col("l_linenumber").alias("pos"), F.col("l_linenumber").alias("stage"), status.alias("status"))
    return desk.next_step(rows, "book")


@query("""
SELECT p_brand, p_partkey, rank, keep_plain FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey)::INTEGER AS rank,
 coalesce(min(CASE WHEN p_size = 1 THEN p_retailprice END) OVER (PARTITION BY p_brand) <= min(p_retailprice) OVER (PARTITION BY p_brand) + 50, false) AS keep_plain FROM part) WHERE rank <= 3
""")
def ranked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("plain", F.col("p_size") == 1)
    return desk.best_few(p, "p_brand", "p_retailprice", "p_partkey", 3, "plain", 50).select("p_brand", "p_partkey", "rank", "keep_plain")


@query("SELECT l_orderkey AS book, round(sum(l_extendedprice / CASE l_returnflag WHEN 'A' THEN 11.1 WHEN 'N' THEN 17.3 ELSE 16.7 END::DOUBLE), 2) AS seconds, bool_or(l_returnflag <> 'A') AS estimated FROM lineitem GROUP BY l_orderkey")
def book_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = spark.createDataFrame([("A", 11.1)], "l_returnflag string, rate double")
    e = desk.estimate(table(spark, sf_dir, "lineitem").withColumn("book", F.col("l_orderkey")), rates, {"N": 17.3, "R": 16.7}, "l_returnflag", "l_extendedprice")
    return e.select("book", F.round("seconds", 2).alias("seconds"), "estimated")


@query("SELECT doc_id, substr(text, greatest(a - 160, 1), a + 7 + 160 - greatest(a - 160, 1)) AS passage FROM (SELECT doc_id, text, strpos(lower(text), 'license') AS a FROM documents) WHERE a > 0")
def passage_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    return desk.around(table(spark, sf_dir, "documents"), "license")


@query("""
SELECT user_id AS job, (event_id % 9)::DOUBLE AS done, (event_id % 12)::DOUBLE AS total FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE event_type <> 'error') WHERE n = 1
""")
def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of their users' logs; errors say nothing of progress."""
    k = F.col("event_id")
    line = F.when(F.col("event_type") == "error", "it failed").otherwise(F.concat(F.lit("clip "), k % 9, F.lit("/"), k % 12, F.lit(" made")))
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), "event_id", line.alias("line"))
    return desk.last_progress(log, "job", "event_id", "line").select("job", F.col("done").cast("double").alias("done"), F.col("total").cast("double").alias("total"))


@query("SELECT c_custkey AS book, CASE WHEN c_custkey % 4 = 0 OR c_custkey % 3 = 0 THEN 'level=2' ELSE 'level=' || c_nationkey END || ',mode=' || CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment ELSE 'plain' END AS settings FROM customer")
def overlaid_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of customers over defaults: some have none, some a level that is null, all one that is not known."""
    k = F.col("c_custkey")
    own = F.create_map(F.lit("level"), F.when(k % 3 > 0, F.col("c_nationkey").cast("string")), F.lit("mode"), F.col("c_mktsegment"), F.lit("other"), F.col("c_name"))
    rows = table(spark, sf_dir, "customer").select(k.alias("book"), F.when(k % 4 > 0, own).alias("settings"))
    kept = F.array_sort(F.transform(F.map_entries("settings"), lambda e: F.concat(e.key, F.lit("="), e.value)))
    return desk.overlaid(rows, {"level": "2", "mode": "plain"}).select("book", F.array_join(kept, ",").alias("settings"))


@query("""
SELECT conv_id AS book, row_number() OVER (PARTITION BY conv_id ORDER BY p)::INTEGER AS index, title FROM (
 SELECT conv_id, turn::DOUBLE AS p, role || turn AS title FROM conversations WHERE turn % 3 <> 2 UNION ALL SELECT DISTINCT conv_id, 1.5, 'Credits' FROM conversations)
""")
def inserted_opening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as chapters of conversations; every third is an old opening, which goes."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").alias("index"), F.concat("role", "turn").alias("title"), (F.col("turn") % 3 == 2).alias("opening"))
    new = c.select("book", F.lit(0).cast("long").alias("index"), F.lit("Credits").alias("title"), F.lit(True).alias("opening")).distinct()
    return desk.inserted(c, new, "book", 1).select("book", "index", "title")


@query("""
WITH m AS (SELECT l_orderkey AS key, l_returnflag AS option, avg(l_quantity) AS p FROM lineitem GROUP BY 1, 2)
SELECT key, option AS choice, round(p, 6) AS p FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY p DESC, option DESC) AS n FROM m) WHERE n = 1
""")
def debiased_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems as answers to their order, each option's chance being the mean over the orders of asking."""
    return desk.debiased(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", "l_quantity").select(F.col("l_orderkey").alias("key"), "choice", F.round("p", 6).alias("p"))


@query("SELECT window_, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM (SELECT doc_id, unnest(range(greatest(ceil((doc_id - 39) / 37.0), 0)::BIGINT, (doc_id // 37) + 1)) AS window_ FROM documents) GROUP BY window_")
def overlapping_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("one", F.lit(1))
    w = desk.windows(d.select("one", "doc_id"), "one", "doc_id")
    return w.groupBy(F.col("window").cast("long").alias("window_")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


@query("""
SELECT o_orderkey AS pos, o_custkey AS id FROM orders WHERE o_orderstatus <> 'F' AND (o_orderkey % 3 = 0 OR o_orderdate <= TIMESTAMP '1997-01-01 00:00:00') ORDER BY o_orderkey LIMIT 1
""")
def next_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that are not finished as jobs that wait for their date, or for nothing."""
    status = F.when(F.col("o_orderstatus") == "F", "done").otherwise("queued")
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("id"), status.alias("status"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderdate")).alias("not_before"))
    return desk.first_due(jobs, F.lit("1997-01-01 00:00:00").cast("timestamp_ntz"), F.col("status") == "running").select("pos", "id")


@query("""
WITH n AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, coalesce(list_reverse(regexp_extract_all(text, '[A-Z][a-z]+')), []) AS names FROM conversations),
b AS (SELECT a.conv_id, a.turn, flatten(list(b.names ORDER BY b.r DESC) FILTER (b.r IS NOT NULL)) AS names FROM n a LEFT JOIN n b ON a.conv_id = b.conv_id AND b.r BETWEEN a.r - 3 AND a.r - 1 GROUP BY ALL)
SELECT conv_id AS chapter, turn AS para, coalesce(array_to_string(list_slice(list_transform(list_filter(list_transform(range(1, len(names) + 1), lambda i: CASE WHEN list_position(names, names[i]) = i THEN i END), lambda i: i IS NOT NULL), lambda i: names[i]), 1, 10), ','), '') AS recent FROM b
""")
def recent_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The capitalised words of the three turns before each turn, the latest first."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chapter"), F.col("turn").alias("para"), F.coalesce(F.regexp_extract_all("text", F.lit("([A-Z][a-z]+)"), 1), F.expr("cast(array() as array<string>)")).alias("mentions"))
    return desk.recent_context(rows, "chapter", "para", "mentions").select("chapter", "para", F.array_join("recent", ",").alias("recent"))


@query("SELECT doc_id, length(text)::DOUBLE AS score FROM documents WHERE lang = 'en'")
def supplied_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shape of a model supplied by the caller: made once for each partition."""
    steps = [lambda d: d.where("lang = 'en'"), lambda d: desk.scored_in_batches(d.select("doc_id", "text"), lambda: lambda s: s.str.len(), "text", "score")]
    return desk.pipeline(table(spark, sf_dir, "documents"), steps).select("doc_id", "score")


@query("""
WITH c AS (SELECT lower(l_shipdate::DATE::VARCHAR) AS token, count(*) AS count FROM lineitem WHERE l_linenumber > 1 GROUP BY 1), l AS (SELECT DISTINCT o_orderdate::DATE::VARCHAR AS token FROM orders)
SELECT token, coalesce(count, 0) AS count, CASE WHEN l.token IS NOT NULL AND substr(l.token, 9, 1) = '1' THEN 'own' WHEN c.token IS NOT NULL THEN 'n' || count END AS ipa FROM c FULL JOIN l USING (token)
""")
def filled_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of shipping counted into a lexicon of days of orders, of which some have their own sounds."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    counts = table(spark, sf_dir, "lineitem").where("l_linenumber > 1").groupBy(day("l_shipdate").alias("token")).agg(F.count(F.lit(1)).alias("count")).withColumn("ipa", F.concat(F.lit("n"), "count"))
    lex = table(spark, sf_dir, "orders").select(day("o_orderdate").alias("token")).distinct().withColumn("ipa", F.when(F.substring("token", 9, 1) == "1", "own").otherwise(""))
    return desk.filled(counts, lex, "token", "ipa").select("token", F.coalesce("count", F.lit(0)).alias("count"), "ipa")


@query("""
SELECT conv_id AS book, turn AS pos, md5(CASE WHEN turn = 0 THEN 'CHAPTER IV' WHEN turn = 1 THEN 'The storm' ELSE 'It is so. ' || text END) AS digest FROM conversations
WHERE turn > 1
""")
def without_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose first two turns are headings: by their form, and as the title."""
    turn = F.col("turn")
    text = F.when(turn == 0, "CHAPTER IV").when(turn == 1, "The storm").otherwise(F.concat(F.lit("It is so. "), "text"))
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book"), turn.alias("pos"), text.alias("text"), F.lit("The Storm").alias("title"))
    return desk.without_headings(rows, "book", "pos", "title").select("book", "pos", F.md5("text").alias("digest"))


@query("""
WITH f AS (SELECT lower(w) AS word, lang, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents WHERE lang IS NOT NULL) GROUP BY 1, 2),
s AS (SELECT word, arg_max(lang, (n, lang)) AS lang, max(n) AS n, coalesce(max(CASE WHEN lang = 'en' THEN n END), 0) AS home FROM f GROUP BY word)
SELECT word, CASE WHEN length(word) >= 4 AND n >= 5 AND n >= home + 3 THEN lang END AS lang FROM s
""")
def word_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each word of the documents by its counts in their languages."""
    words = table(spark, sf_dir, "documents").where("lang IS NOT NULL").select("lang", F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1)).alias("w"))
    counts = words.groupBy(F.lower("w").alias("word"), "lang").agg(F.count(F.lit(1)).cast("double").alias("zipf"))
    return desk.likeliest(counts.select("word").distinct(), counts, 3.0, 5.0, "en")


@query("SELECT 'clone:' || r_name || '@' || n AS key FROM region, (VALUES ('f5'), ('higgs')) AS e(n) UNION ALL SELECT 'preset:' || n_name FROM nation")
def voice_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    engines = spark.createDataFrame([("f5",), ("higgs",)], "engine string")
    return desk.choices(table(spark, sf_dir, "region").select(F.col("r_name").alias("name")), engines, table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")))


@query("SELECT p_brand, round(avg(p_retailprice), 6) AS mean, count(DISTINCT p_partkey) AS items FROM part GROUP BY p_brand ORDER BY avg(p_retailprice) DESC, p_brand LIMIT 1")
def best_option(spark: SparkSession, sf_dir: str) -> DataFrame:
    return desk.best_option(table(spark, sf_dir, "part"), "p_brand", "p_partkey", "p_retailprice").select("p_brand", F.round("mean", 6).alias("mean"), "items")


@query("SELECT source, CASE WHEN n % 3 = 0 THEN 'never' WHEN n % 3 = 1 THEN 'fresh' ELSE 'stale' END AS status FROM (SELECT DISTINCT source, replace(source, 'src', '')::INTEGER AS n FROM documents)")
def stale_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirespark.operators import books

    now = books.fingerprint(table(spark, sf_dir, "documents"), "source", ["text"], "doc_id")
    n = F.regexp_extract("source", "([0-9]+)", 1).cast("int") % 3
    stamped = now.where(n > 0).withColumn("fingerprint", F.when(n == 1, F.col("fingerprint")).otherwise("old"))
    return desk.staleness(now, stamped, "source")


@query("SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment ELSE 'other' END AS grouped FROM customer")
def grouped_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("setting", F.col("c_mktsegment"))
    return desk.grouped_setting(c, ["BUILDING", "MACHINERY"]).select("c_custkey", "grouped")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def ticked_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticked = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").join(ticked, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("""
WITH s AS (SELECT l_partkey AS name, 's' || l_linenumber AS spelling, 0.5::DOUBLE + l_discount * 5 AS score, 0.6::DOUBLE + l_partkey % 10 / 40.0::DOUBLE AS plain FROM lineitem),
b AS (SELECT name, arg_max(spelling, {'a': score, 'b': spelling}) AS spelling, max(score) AS score, any_value(plain) AS plain FROM s GROUP BY name)
SELECT name, spelling, round(score, 6) AS score, score >= 0.8 AND score >= plain + 0.15::DOUBLE AS adopt FROM b
""")
def adopted_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems as scored spellings of parts; the best is adopted where it beats the plain one clearly."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("name"), F.concat(F.lit("s"), "l_linenumber").alias("spelling"), (0.5 + F.col("l_discount") * 5).alias("score"), (0.6 + F.col("l_partkey") % 10 / 40.0).alias("plain"))
    return clips.adopted(rows, "name", "plain", "score").select("name", "spelling", F.round("score", 6).alias("score"), "adopt")
