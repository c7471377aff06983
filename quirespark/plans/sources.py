"""Queries on pages, files and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.plans.registry import query
from quirespark.shared import new_path, table
from quirespark.sources import epub, readers, sinks, web
from quirespark.streaming import events as S

_RAW = r"""(SELECT page_id, unnest(range(0, len(bs))) AS pos, unnest(bs) AS raw FROM (SELECT page_id, regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
 '(?s)<script\b.*?</script>', '', 'g'), '(?s)<style\b.*?</style>', '', 'g'), '(?s)<nav\b.*?</nav>', '', 'g'), '(?s)<header\b.*?</header>', '', 'g'), '(?s)<(?:footer\b.*?</footer|aside\b.*?</aside|noscript\b.*?</noscript)>', '', 'g'), '(?s)<(?:h1|p|li)\b[^>]*>.*?</(?:h1|p|li)>') AS bs FROM pages))"""
_BLOCK = rf"""(SELECT page_id, pos, CASE WHEN starts_with(raw, '<h1') THEN 1 ELSE 0 END AS level, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(raw, '(?s)<br\s*/?>', ' ', 'g'), '(?s)<[^>]*>', '', 'g'),
 '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM {_RAW})"""


@query(f"SELECT page_id, pos::INTEGER AS pos, level::INTEGER AS level, text FROM {_BLOCK} WHERE text <> ''")
def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.blocks(table(spark, sf_dir, "pages"))


@query()
def html_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parser's blocks, counted. Unlike the patterns it closes a block where the next one opens."""
    return web.parsed_blocks(table(spark, sf_dir, "pages")).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("chars"))


@query(f"""
WITH b AS (SELECT * FROM {_BLOCK} WHERE text <> ''), s AS (SELECT page_id, min(level) AS split FROM (SELECT page_id, level FROM b WHERE level > 0 GROUP BY page_id, level HAVING count(*) >= 2) GROUP BY page_id),
m AS (SELECT b.*, coalesce(level = split, false) AS starts FROM b LEFT JOIN s USING (page_id)), p AS (SELECT *, sum(starts::INTEGER) OVER (PARTITION BY page_id ORDER BY pos) AS part FROM m),
c AS (SELECT page_id, part, max(CASE WHEN starts THEN text END) AS title, coalesce(string_agg(CASE WHEN NOT starts THEN text END, chr(10) ORDER BY pos), '') AS text FROM p GROUP BY page_id, part)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY part)::INTEGER AS chapter, title, md5(text) AS digest FROM c WHERE title IS NOT NULL OR text <> ''
""")
def html_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.chapters(web.blocks(table(spark, sf_dir, "pages"))).select("page_id", "chapter", "title", F.md5("text").alias("digest"))


@query("""
SELECT key, value FROM (SELECT lower(trim(p_brand)) || (p_partkey % 50) AS key, p_name || '|' || p_partkey AS value, row_number() OVER (PARTITION BY lower(trim(p_brand)) || (p_partkey % 50) ORDER BY p_size DESC, p_partkey DESC) AS n
 FROM part WHERE p_partkey % 7 > 0 AND p_partkey % 5 > 0) WHERE n = 1
""")
def key_value_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as lines key|value, some of them comments or no pairs."""
    pair = F.concat(F.lit(" "), "p_brand", F.pmod("p_partkey", F.lit(50)), F.lit(" | "), "p_name", F.lit("|"), "p_partkey", F.lit(" "))
    line = F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit(" # "), pair)).when(F.col("p_partkey") % 5 == 0, F.concat("p_brand", F.lit(" |  "))).otherwise(pair)
    return readers.pairs(table(spark, sf_dir, "part").select(F.col("p_size").alias("priority"), F.col("p_partkey").alias("line_no"), line.alias("line")))


@query("""
SELECT word, reading FROM (SELECT lower(p_name) AS word, p_type AS reading, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) AS n FROM part WHERE p_partkey % 6 > 0) WHERE n = 1
""")
def dictionary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as lines of a dictionary, each with two readings; some lines are none."""
    line = F.concat("p_name", F.when(F.col("p_partkey") % 6 > 0, F.lit("\t")).otherwise(" "), "p_type", F.lit(", "), "p_brand")
    return readers.dictionary(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("line_no"), line.alias("line")))


@query("""
WITH v AS (SELECT 'Second ' || l_returnflag AS book, (l_orderkey % 150)::INTEGER AS chapter, l_linenumber AS verse, 'at ' || l_orderkey || '. the end.' AS text, l_orderkey FROM lineitem),
k AS (SELECT book, chapter, verse, text, row_number() OVER (PARTITION BY book, chapter, verse ORDER BY l_orderkey DESC) AS n FROM v),
p AS (SELECT *, (row_number() OVER (PARTITION BY book, chapter ORDER BY verse) - 1) // 3 AS para FROM k WHERE n = 1)
SELECT book, chapter, para::INTEGER AS para, string_agg(text, ' ' ORDER BY verse) AS text FROM p GROUP BY book, chapter, para
""")
def scripture_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems as lines of verses, three to a paragraph; of equal verses the last counts."""
    line = F.concat(F.lit("Second "), "l_returnflag", F.lit(" "), F.pmod("l_orderkey", F.lit(150)), F.lit(":"), "l_linenumber", F.lit(" ¶ at "), "l_orderkey", F.lit(". the [end]."))
    return readers.scripture(table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_no"), line.alias("line")), verses=3)


_VERSE = "trim(regexp_replace(replace(text, ':', ' '), '[ \\n]+', ' ', 'g'), ' ')"


@query(f"""
SELECT doc_id, 1 AS chapter, md5(t || chr(10) || chr(10) || doc_id || ' ' || t) AS digest FROM (SELECT doc_id, {_VERSE} AS t FROM documents)
UNION ALL SELECT doc_id, 2, md5('Last ' || t) FROM (SELECT doc_id, {_VERSE} AS t FROM documents)
""")
def verse_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as three verses of two chapters."""
    t = F.btrim(F.regexp_replace(F.replace("text", F.lit(":"), F.lit(" ")), r"[ \n]+", " "))
    text = F.concat(F.lit("Before. 1:1 "), t, F.lit(" 1:2 "), "doc_id", F.lit(" "), t, F.lit("\n2:1 Last "), t)
    return readers.verse_chapters(table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))).select("doc_id", "chapter", F.md5("text").alias("digest"))


@query("""
WITH d AS (SELECT doc_id, trim(replace(text, chr(13), ''), ' ' || chr(10)) AS t FROM documents)
SELECT doc_id, 1 AS chapter, 'CHAPTER I. The Start' AS title, length(t) AS chars FROM d WHERE length(t) >= 40
UNION ALL SELECT doc_id, CASE WHEN length(t) >= 40 THEN 2 ELSE 1 END, 'Chapter 2', length(t) + 40 FROM d
""")
def headed_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as two chapters, and a third that is too short."""
    body = F.concat(F.lit("Front matter\nCHAPTER I. The Start\n\n"), F.btrim("text", F.lit(" \n")), F.lit("\n\nChapter 2\n"), F.lit("x" * 39 + "\n"), F.btrim("text", F.lit(" \n")), F.lit("\nChapter 3\nToo short"))
    return readers.headed_chapters(table(spark, sf_dir, "documents").select("doc_id", body.alias("text"))).select("doc_id", "chapter", "title", F.char_length("text").alias("chars"))


@query("""
WITH t AS (SELECT conv_id, turn, upper(role) AS role, array_to_string(list_filter(list_transform(str_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), ' ') AS text FROM conversations WHERE trim(replace(text, chr(10), ' ')) <> ''),
c AS (SELECT *, CASE WHEN lag(role) OVER w = role THEN 0 ELSE 1 END AS c FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), i AS (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM c)
SELECT conv_id AS doc_id, n::BIGINT AS n, 'II' AS act, 'IV' AS scene, upper(role[1]) || lower(role[2:]) AS role, md5(string_agg(text, ' ' ORDER BY turn)) AS digest FROM i GROUP BY conv_id, n, role
""")
def play_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as scenes of plays. What is said is indented, since it may hold a line like a speaker's."""
    said = F.concat(F.upper("role"), F.lit(".\n[_Rises._]\n "), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n ")))
    plays = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("turn", said.alias("t")))).alias("ts"))
    text = F.concat(F.lit("ACT II\nSCENE IV. A place.\n"), F.array_join(F.transform("ts", lambda x: x["t"]), "\n\n"))
    return readers.play_lines(plays.select("doc_id", text.alias("text"))).select("doc_id", "n", "act", "scene", "role", F.md5("text").alias("digest"))


@query("SELECT * FROM (VALUES ('m', 1, 'The Book'), ('m', 2, 'Part One'), ('m', 0, 'Some bold words and a link.'), ('m', 0, 'first item'), ('m', 0, 'second item')) AS t(doc_id, level, text)")
def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "---\ntitle: x\n---\nThe Book\n========\n\n## Part One\nSome **bold** words\nand a [link](http://x).\n\n- first item\n- second item\n\n```\ncode\n```\n\n| a | b |\n\n---\n"
    return readers.markdown_blocks(spark.createDataFrame([("m", text)], "doc_id string, text string")).select("doc_id", "level", "text")


@query("SELECT conv_id, md5(';FFMETADATA1' || chr(10) || string_agg('[CHAPTER]' || chr(10) || 'TIMEBASE=1/1000' || chr(10) || 'START=' || (e - ms) || chr(10) || 'END=' || e || chr(10) || 'title=' || role || chr(10), '' ORDER BY turn)) AS digest FROM (SELECT *, (sum(ms) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS e FROM (SELECT *, round(length(text) / 14.5::DOUBLE * 1000)::BIGINT AS ms FROM conversations)) GROUP BY conv_id")
def chapter_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("seconds", F.char_length("text") / F.lit(14.5))
    return sinks.chapter_marks(c, "conv_id", "turn", "role", "seconds").select("conv_id", F.md5("marks").alias("digest"))


@query("SELECT conv_id, md5(';FFMETADATA1' || chr(10) || 'title=Talk ' || conv_id || chr(10) || 'artist=' || CASE WHEN conv_id % 2 = 0 THEN 'Ann' ELSE '' END || chr(10) || 'album=Talk ' || conv_id || chr(10) || 'genre=Audiobook' || chr(10) || string_agg('[CHAPTER]' || chr(10) || 'TIMEBASE=1/1000' || chr(10) || 'START=' || (e - ms) || chr(10) || 'END=' || e || chr(10) || 'title=' || role || chr(10), '' ORDER BY turn)) AS digest FROM (SELECT *, (sum(ms) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS e FROM (SELECT *, round(length(text) / 14.5::DOUBLE * 1000)::BIGINT AS ms FROM conversations)) GROUP BY conv_id")
def titled_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapter marks with the title and the author of the book."""
    c = table(spark, sf_dir, "conversations").withColumn("seconds", F.char_length("text") / F.lit(14.5))
    c = c.withColumn("name", F.concat(F.lit("Talk "), "conv_id")).withColumn("author", F.when(F.col("conv_id") % 2 == 0, "Ann"))
    return sinks.chapter_marks(c, "conv_id", "turn", "role", "seconds", "name", "author").select("conv_id", F.md5("marks").alias("digest"))


@query(r"""
WITH p AS (SELECT conv_id, turn, role, regexp_split_to_array(text, '\n[ \t]*\n') AS ps FROM conversations WHERE trim(text, ' ' || chr(10)) <> ''),
b AS (SELECT conv_id, turn, 0 AS k, 1 AS level, role AS text FROM p UNION ALL SELECT conv_id, turn, unnest(range(1, len(ps) + 1)), 0, unnest(ps) FROM p)
SELECT conv_id || '.epub' AS path, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) - 1)::INTEGER AS pos, level::INTEGER AS level, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM b WHERE trim(text, ' ' || chr(10)) <> ''
""")
def epub_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as books: written as EPUB and read again."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").alias("index"), F.col("role").alias("title"), "text")
    files = sinks.epub_files(c).select(F.concat(F.col("book").cast("string"), F.lit(".epub")).alias("path"), "content")
    return readers.zipped_blocks(files)


@query(r"""
WITH p AS (SELECT conv_id, turn, role, regexp_split_to_array(text, '\n[ \t]*\n') AS ps FROM conversations WHERE trim(text, ' ' || chr(10)) <> ''),
b AS (SELECT conv_id, turn, 0 AS k, 'Part ' || role AS text FROM p UNION ALL SELECT conv_id, turn, unnest(range(1, len(ps) + 1)), unnest(ps) FROM p),
n AS (SELECT conv_id, turn, k, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM b WHERE trim(text, ' ' || chr(10)) <> ''),
t AS (SELECT conv_id, turn, string_agg(text, chr(10) || chr(10) ORDER BY k) AS text FROM n GROUP BY conv_id, turn),
c AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '(?m)^[ \t]*[0-9]{3,4}[ \t]*$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS text FROM t)
SELECT conv_id || '.epub' AS path, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INTEGER AS chapter, 'Part ' || role AS title, md5(c.text) AS digest FROM c JOIN conversations USING (conv_id, turn) WHERE length(c.text) >= 200
""")
def epub_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as EPUB and read as chapters, whose titles stand in the contents; short pages are none."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").alias("index"), F.concat(F.lit("Part "), "role").alias("title"), "text")
    files = sinks.epub_files(c).select(F.concat(F.col("book").cast("string"), F.lit(".epub")).alias("path"), "content")
    return epub.chapters(files).select("path", "chapter", "title", F.md5("text").alias("digest"))


@query("""
WITH w AS (SELECT epoch(date_trunc('hour', ts))::BIGINT AS start_s, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT start_s, event_type, n FROM w WHERE start_s + 3600 <= (SELECT epoch(max(ts)) FROM events) - 600
""")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = S.drained(S.windowed_counts(S.event_stream(spark, sf_dir), "1 hour", "1 hour", "10 minutes"), "windows")
    return w.select(F.unix_seconds("start").alias("start_s"), "event_type", "n")


@query("""
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, sid, min(ts) AS a, max(ts) AS z, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g) GROUP BY user_id, sid)
SELECT user_id, epoch(date_trunc('second', a))::BIGINT AS start_s, n FROM s WHERE z + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE
""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.drained(S.sessions(S.event_stream(spark, sf_dir), "6 hours", "10 minutes"), "sessions")
    return s.select("user_id", F.unix_seconds("start").alias("start_s"), "n")


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    twice = S.event_stream(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    once = S.drained(S.once_each(twice, "event_id", "10 minutes").select("event_id"), "once")
    return once.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids"))


@query("""
WITH e AS (SELECT *, sum((event_type = 'error')::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
l AS (SELECT user_id, max(r) AS r, count(*) AS seen, arg_max(event_type, {'t': ts, 'i': event_id}) AS last FROM e GROUP BY user_id)
SELECT user_id, least(r, 7)::INTEGER AS restarts, CASE WHEN r > 6 THEN 'failed' WHEN last = 'error' THEN 'queued' WHEN last = 'purchase' THEN 'done' ELSE 'running' END AS status, seen FROM l
""")
def job_state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.drained(S.job_states(S.event_stream(spark, sf_dir)), "jobs", "update")
    last = s.groupBy("user_id").agg(F.max_by(F.struct("restarts", "status", "seen"), "_batch").alias("s"))
    return last.select("user_id", "s.*")


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'unknown' ELSE role END AS role, md5(coalesce(text, '')) AS digest FROM conversations")
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as JSON, some without a role, and read with a schema and defaults."""
    path = new_path(spark, "json")
    table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 != 0, F.col("role")).alias("role"), "text").write.json(path)
    rows = readers.json_rows(spark, f"{path}/*.json", "conv_id long, turn long, role string, text string", {"role": "unknown", "text": ""})
    return rows.select("conv_id", "turn", "role", F.md5("text").alias("digest"))
