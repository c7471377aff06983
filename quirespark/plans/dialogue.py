"""Queries on prose with speech: a conversation stands for a chapter, its turns for what is said, in four kinds of paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirespark.operators import dialogue
from quirespark.plans.registry import query
from quirespark.shared import table

_NAMES = {"Anna": "Anna", "Bob": "Robert"}
_KINDS = ["“{},” said Anna to Bob.", "{} Bob waited. “Well,” he answered, “go.”", "Anna looked at Bob. {}", "Then Bob replied, “{}” The servants heard the other."]
_ASCII = "[^A-Za-z.,;:!?' ]+"  # in both engines alike, letters beyond ASCII would bound words differently


def _chapters(spark: SparkSession, sf_dir: str, kinds: list[str] = _KINDS) -> DataFrame:
    turn, said = F.col("turn"), F.btrim(F.regexp_replace(F.coalesce("text", F.lit("")), _ASCII, " "))
    ways = [F.concat(F.lit(k.split("{}")[0]), said, F.lit(k.split("{}")[1])) for k in kinds]
    para = F.get(F.array(*ways), F.pmod(turn, F.lit(len(kinds))).cast("int"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", para.alias("p")))).alias("ps"))
    names = F.create_map(*[F.lit(x) for pair in _NAMES.items() for x in pair])
    return rows.select(F.pmod("conv_id", F.lit(7)).alias("book"), F.col("conv_id").alias("chapter"), F.array_join(F.transform("ps", lambda p: p["p"]), "\n\n").alias("text"), names.alias("names"))


_SAID = "trim(regexp_replace(coalesce(text, ''), '[^A-Za-z.,;:!?'' ]+', ' ', 'g'))"
_SQL_PARA = f"SELECT conv_id % 7 AS book, conv_id AS chapter, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS para, (turn % 4)::INTEGER AS k, trim(regexp_replace({_SAID}, '\\s+', ' ', 'g')) AS t FROM conversations"


# Each kind of paragraph has quotes whose evidence is known; what depends on other paragraphs is computed.
_SQL_EVIDENCE = f"""
WITH p AS ({_SQL_PARA}),
q AS (
 SELECT *, 0 AS place, trim(t || ',') AS quote, 'Anna' AS explicit, NULL AS pron, false AS split, false AS cont FROM p WHERE k = 0
 UNION ALL SELECT *, 0, 'Well,', NULL, 'm', false, false FROM p WHERE k = 1
 UNION ALL SELECT *, 1, 'go.', NULL, 'm', true, false FROM p WHERE k = 1
 UNION ALL SELECT *, 0, t, 'Robert', NULL, false, false FROM p WHERE k = 3 AND t <> ''
)
SELECT q.book, q.chapter, q.para, q.place, md5(q.quote) AS quote, q.explicit, q.pron,
 coalesce((SELECT CASE WHEN l.k = 2 THEN 'Anna' END FROM p l WHERE l.chapter = q.chapter AND l.para = q.para - 1),
          (SELECT CASE WHEN l.k = 2 THEN 'Anna' END FROM p l WHERE l.chapter = q.chapter AND l.para = q.para - 2)) AS lead,
 q.split, q.cont FROM q
"""


@query(_SQL_EVIDENCE)
def quote_clues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the text around each quote says of its speaker."""
    return dialogue.quote_evidence(_chapters(spark, sf_dir)).select("book", "chapter", "para", "place", F.md5("quote").alias("quote"), "explicit", "pron", "lead", "split", "cont")


_TWO = ["“{},” said Anna.", "{} Bob waited."]


@query(f"""
WITH p AS (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY para) AS r FROM (SELECT * REPLACE (k % 2 AS k) FROM ({_SQL_PARA}))),
s AS (
 SELECT book, chapter, para, 1 AS piece, 'Anna' AS speaker, 'dialogue' AS kind, trim(t || ',') AS text FROM p WHERE k = 0
 UNION ALL SELECT book, chapter, para, 2, 'Narrator', 'narration', 'said Anna.' FROM p WHERE k = 0
 UNION ALL SELECT book, chapter, para, 0, 'Narrator', 'narration', trim(t || ' Bob waited.') FROM p WHERE k = 1
)
SELECT book, chapter, (row_number() OVER (PARTITION BY book, chapter ORDER BY para, piece) - 1)::INTEGER AS seg, row_number() OVER (PARTITION BY book, chapter, para ORDER BY piece) = 1 AS para_start, speaker, kind, md5(text) AS text FROM s
""")
def spoken_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters cut into narration and speech, each with its speaker."""
    return dialogue.segments(_chapters(spark, sf_dir, _TWO)).withColumn("text", F.md5("text"))


_SQL_SAID = "'so ' || trim(regexp_replace(lower(coalesce(text, '')), '[^a-z]+', ' ', 'g'))"
_GENDERED = ["Anna smiled as {0} sat. Bob stood as {1} waited. Anna nodded as {0} rose. Bob frowned as {1} turned.", "“I am here,” said Anna.", "“Good,” said Bob."]


@query(f"""
WITH p AS (SELECT conv_id % 7 AS book, conv_id AS chapter, turn, {_SQL_SAID} AS t, conv_id % 2 = 0 AS usual, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations)
SELECT book, chapter, n::INTEGER AS n, md5(t || ',') AS quote, CASE WHEN (n % 2 = 0) = usual THEN 'Robert' ELSE 'Anna' END AS speaker FROM p
""")
def inferred_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose quotes name nobody: who is "he" and who is "she" follows from the narration that opens a chapter,
    which gives half of the chapters the other genders."""
    c = table(spark, sf_dir, "conversations")
    usual = F.pmod("conv_id", F.lit(2)) == 0
    said = F.concat(F.lit("so "), F.btrim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+", " ")))
    turns = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", said.alias("t")))).alias("ts"))
    lines = F.transform("ts", lambda x, i: F.concat(F.lit("“"), x["t"], F.lit(",” "), F.when(i % 2 == 0, "he").otherwise("she"), F.lit(" said.")))
    opening = F.array(F.when(usual, _GENDERED[0].format("she", "he")).otherwise(_GENDERED[0].format("he", "she")), *map(F.lit, _GENDERED[1:]))
    names = F.create_map(*[F.lit(x) for pair in _NAMES.items() for x in pair])
    chapters = turns.select(F.pmod("conv_id", F.lit(7)).alias("book"), F.col("conv_id").alias("chapter"), F.array_join(F.concat(opening, lines), "\n\n").alias("text"), names.alias("names"))
    quotes = dialogue.segments(chapters).where("kind = 'dialogue'")
    n = F.row_number().over(Window.partitionBy("book", "chapter").orderBy("seg")) - 3
    return quotes.withColumn("n", n).where("n >= 0").select("book", "chapter", "n", F.md5("text").alias("quote"), "speaker")


_PLAIN_KINDS = ["And John answered, {}.", "He said, {}.", "Then Mary spake unto them, {}.", "Then {} went by."]


@query(f"""
WITH p AS (SELECT conv_id % 7 AS book, conv_id AS chapter, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS para, (turn % 4)::INTEGER AS k, {_SQL_SAID} AS t FROM conversations),
n AS (SELECT *, last_value(CASE k WHEN 0 THEN 'The Baptist' WHEN 2 THEN 'Mary' END IGNORE NULLS) OVER (PARTITION BY chapter ORDER BY para ROWS UNBOUNDED PRECEDING) AS who FROM p),
s AS (
 SELECT book, chapter, para, 0 AS half, 'Narrator' AS speaker, CASE WHEN k = 3 THEN 'Then ' || t || ' went by.' WHEN who IS NULL THEN 'He said, ' || t || '.'
   WHEN k = 0 THEN 'And John answered,' WHEN k = 1 THEN 'He said,' ELSE 'Then Mary spake unto them,' END AS text FROM n
 UNION ALL SELECT book, chapter, para, 1, who, t || '.' FROM n WHERE k <> 3 AND who IS NOT NULL
)
SELECT book, chapter, (row_number() OVER (PARTITION BY book, chapter ORDER BY para, half) - 1)::INTEGER AS seg, half = 0 AS para_start, speaker, CASE half WHEN 0 THEN 'narration' ELSE 'dialogue' END AS kind, md5(text) AS text FROM s
""")
def unquoted_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech without quotation marks, whose speakers are carried forward for pronouns and have other names as roles."""
    said = F.concat(F.lit("so "), F.btrim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+", " ")))
    ways = F.array(*[F.concat(F.lit(k.split("{}")[0]), said, F.lit(k.split("{}")[1])) for k in _PLAIN_KINDS])
    para = F.get(ways, F.pmod("turn", F.lit(4)).cast("int"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", para.alias("p")))).alias("ps"))
    chapters = rows.select(F.pmod("conv_id", F.lit(7)).alias("book"), F.col("conv_id").alias("chapter"), F.array_join(F.transform("ps", lambda p: p["p"]), "\n\n").alias("text"))
    return dialogue.unquoted_segments(chapters, aliases={"John": "The Baptist"}).withColumn("text", F.md5("text"))
