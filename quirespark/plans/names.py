"""Queries on words, names, sounds and passages."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.operators import align, attribution, names, speech
from quirespark.plans.books import _SENT, _WORD
from quirespark.plans.registry import query
from quirespark.shared import freeze, table

_TOK = f"(SELECT doc_id, lang, para, sent, unnest(range(0, len(ws))) AS pos, unnest(ws) AS word FROM (SELECT doc_id, lang, para, sent, regexp_extract_all(sentence, '{_WORD}') AS ws FROM {_SENT}))"
_TABLE = f"""(SELECT term, sum(n) AS count, sum(CASE WHEN lower(word[1]) = word[1] THEN n ELSE 0 END) AS lower, sum(CASE WHEN lower(word[1]) <> word[1] THEN inside ELSE 0 END) AS mid_capital,
 arg_min(word, {{'a': (upper(word) = word AND length(word) > 1)::INTEGER, 'b': -n, 'c': word}}) AS surface FROM (SELECT lower(word) AS term, word, count(*) AS n, count(*) FILTER (pos > 0) AS inside FROM {_TOK} GROUP BY word) GROUP BY term)"""


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(f"SELECT term, count::BIGINT AS count, lower::BIGINT AS lower, mid_capital::BIGINT AS mid_capital, surface FROM {_TABLE} WHERE count >= 3")
def word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.word_table(_docs(spark, sf_dir)).where("count >= 3")


@query(f"SELECT term, count::BIGINT AS count, surface, round(lower / (lower + mid_capital)::DOUBLE, 6) AS lower_share FROM {_TABLE} WHERE mid_capital >= 2 AND lower / (lower + mid_capital)::DOUBLE <= 0.02")
def name_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.name_candidates(_docs(spark, sf_dir)).select("term", "count", "surface", F.round("lower_share", 6).alias("lower_share"))


@query("""
SELECT phrase, count(*) AS count, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+(?: [A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+)+')) AS phrase FROM documents) GROUP BY phrase
""")
def phrase_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.phrase_runs(_docs(spark, sf_dir))


_NAMES = ["Thornt", "Idiot", "Enean", "License", "Der", "Elle"]
_VALUES = "(VALUES " + ", ".join(f"('{n}')" for n in _NAMES) + ") AS n(name)"


def _names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n,) for n in _NAMES], "name string")


@query(f"""
WITH s AS (SELECT *, lag(sentence) OVER w AS before, lead(sentence) OVER w AS after FROM {_SENT} WINDOW w AS (PARTITION BY doc_id ORDER BY para, sent)),
h AS (SELECT name, s.* FROM s JOIN {_VALUES} ON list_contains(list_transform(regexp_extract_all(sentence, '{_WORD}'), lambda x: lower(x)), lower(name)))
SELECT name, doc_id, before, sentence, after FROM (SELECT *, row_number() OVER (PARTITION BY name, doc_id ORDER BY para, sent) AS r FROM h) WHERE r = 1
""")
def name_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.name_context(_docs(spark, sf_dir), _names(spark))


@query(f"SELECT doc_id, name FROM documents JOIN {_VALUES} ON list_contains(list_transform(regexp_extract_all(text, '{_WORD}'), lambda x: lower(x)), lower(name))")
def clip_name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.name_pairs(_docs(spark, sf_dir), _names(spark))


@query("""
WITH n AS (SELECT source, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY source, lang),
t AS (SELECT source, arg_max(lang, {'n': n, 'l': lang}) AS top, max(n) AS votes, sum(n)::BIGINT AS all_votes FROM n GROUP BY source)
SELECT source, CASE WHEN votes >= 3 AND votes / all_votes::DOUBLE >= 0.5 THEN top END AS winner, votes, all_votes FROM t
""")
def language_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.vote(_docs(spark, sf_dir), "source", "lang").withColumnRenamed("all", "all_votes")


_APOSTROPHES = {"jes'": True, "don't": False, "o'clock": False, "runnin'": True, "days'": False, "John's": False, "'many'": False, "'em": True, "M'ling": False, "plain": False, "goin’": True}


@query("SELECT * FROM (VALUES " + ", ".join("('" + k.replace("'", "''") + f"', {str(v).lower()})" for k, v in _APOSTROPHES.items()) + ") AS t(token, dialect)")
def dialect_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k,) for k in _APOSTROPHES], "token string").select("token", names.is_dialect(F.col("token"), ["jes'"]).alias("dialect"))


@query("""
SELECT source, token, count(*) AS count, ipa FROM documents, (VALUES ('runnin''', NULL), ('jes''', 'dʒɛs')) AS v(token, ipa) WHERE text <> '' GROUP BY source, token, ipa
""")
def dialect_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents with six words with apostrophes after them, of which two are dialect."""
    text = F.concat(F.regexp_replace("text", "['’]", " "), F.lit(" runnin' don't jes' days' Anna's o'er"))
    sounds = spark.createDataFrame([("jes'", "dʒɛs"), ("o'er", "ɔɹ")], "token string, ipa string")
    return names.dialect_counts(_docs(spark, sf_dir).where("text <> ''").select("source", text.alias("text")), "source", sounds)


_NUMERAL = "regexp_matches(upper(word), '^M{0,3}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})$')"


@query(f"""
WITH w AS (SELECT DISTINCT word FROM {_TOK}), d AS (SELECT word AS low FROM w WHERE word = lower(word))
SELECT word, word <> '' AND {_NUMERAL} AND (upper(word) = word OR length(word) >= 3 AND low IS NULL) AS numeral FROM w LEFT JOIN d ON low = lower(word)
""")
def numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of the documents; what they have in small letters is the dictionary."""
    words = freeze(names.word_counts(_docs(spark, sf_dir)).select("word"), "words")
    return names.numerals(words, words.where(F.lower("word") == F.col("word")))


_ENDINGS = ", ".join(f"CASE WHEN ends_with(w, '{e}') AND length(w) - {len(e)} >= 3 THEN left(w, length(w) - {len(e)}) || '{r}' END" for e, r in names.ENDINGS)


@query(f"""
WITH t AS (SELECT lower(word) AS w, count(*) AS n FROM {_TOK} GROUP BY 1), d AS (SELECT w AS stem FROM t WHERE n >= 5)
SELECT w AS word, bool_or(d.stem IS NOT NULL) AS known FROM (SELECT w, unnest([w, {_ENDINGS}]) AS stem FROM t) LEFT JOIN d USING (stem) GROUP BY w
""")
def known_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the documents against those that come five times or more."""
    counted = names.word_counts(_docs(spark, sf_dir)).groupBy(F.lower("word").alias("word")).agg(F.sum("count").alias("count"))
    counted = freeze(counted, "counted")
    return names.known_words(counted.select("word"), counted.where("count >= 5").select("word"))


@query("""
WITH n(name) AS (VALUES ('Is'), ('Thnd'), ('There'), ('It'), ('Was'), ('Er'), ('The')), d AS (SELECT regexp_replace(text, '[À-ÖØ-öø-ÿœŒ]', 'x', 'g') AS text FROM documents),
p AS (SELECT name, string_split_regex(text, '\\b' || name || '\\b') AS p FROM d CROSS JOIN n), t AS (SELECT name, unnest(list_transform(range(2, len(p) + 1), lambda i: left(list_reduce(p[i:], lambda a, b: a || name || b), 140))) AS tail FROM p),
g AS (SELECT name, lower(regexp_extract(tail, '^[^.!?]*?\\b((?i)he|his|him|himself|she|her|herself)\\b', 1)) AS said FROM t)
SELECT name, CASE WHEN count(*) FILTER (said LIKE 'she' OR said LIKE 'her%') > count(*) FILTER (said LIKE 'h%' AND said NOT LIKE 'her%') THEN 'f' ELSE 'm' END AS gender, count(*) AS votes
FROM g WHERE said <> '' GROUP BY name HAVING count(*) >= 2
""")
def pronoun_genders(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([(n,) for n in ("Is", "Thnd", "There", "It", "Was", "Er", "The")], "name string")
    return names.genders(_docs(spark, sf_dir), asked)


@query("""
WITH d AS (SELECT *, lower(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS k FROM documents), s AS (SELECT *, count(*) OVER (PARTITION BY k, source) AS in_source, count(*) OVER (PARTITION BY k, lang) AS in_lang FROM d WHERE k <> '')
SELECT doc_id, min(doc_id) OVER (PARTITION BY k, source) AS same_source, in_source, min(doc_id) OVER (PARTITION BY k, lang) AS same_lang, in_lang FROM s WHERE in_source > 1 OR in_lang > 1
""")
def same_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works with the letters of another whose author (source) agrees, or does not speak against it (language): the first
    of each class, and how many it has."""
    d = _docs(spark, sf_dir).select("doc_id", "source", "lang", F.lower(F.regexp_replace("text", "[^A-Za-z]", "")).alias("k")).where("k != ''")
    d = d.withColumns({"h": F.xxhash64("k"), "g": F.md5("k")}).drop("k")
    classes = lambda by, first, n: d.groupBy("h", "g", by).agg(F.min("doc_id").alias(first), F.count(F.lit(1)).alias(n))
    both = d.join(classes("source", "same_source", "in_source"), ["h", "g", "source"]).join(classes("lang", "same_lang", "in_lang"), ["h", "g", "lang"])
    return both.where("in_source > 1 OR in_lang > 1").select("doc_id", "same_source", "in_source", "same_lang", "in_lang")


def _expanded_sql(text: str) -> str:
    """The steps of speech.expand for an engine whose patterns have no look-around: what follows is taken in and put back."""
    for written, read, where in speech.ABBREVIATIONS:
        w = re.escape(written).replace("\\ ", " ")
        steps = {
            "name": [(rf"\b{w}\s+([A-Z])", rf"{read} \1")], "dashed": [(rf"\b{w}\s*-?\s*([A-Z])", rf"{read} \1")], "after": [(rf"([a-z])\s+{w}", rf"\1 {read}")],
            "stop": [(rf"\b{w}([,;])", rf"{read}\1"), (rf"\b{w}", f"{read}.")], "comma": [(rf"\b{w},?", read)], "state": [(rf"(, ){w}", rf"\1{read}")], "wide": [(rf"([,.] ){w}", rf"\1{read}")],
        }[where]
        for a, b in steps:
            text = f"regexp_replace({text}, '{a}', '{b}', 'g')"
    return text


_LETTERED = "['Mr. ', 'lambs, etc., ', 'Lieut. ', 'Malden, W. Va., ', 'etc. ', 'Gen. ', 'Jas. ', 'i.e. '][1 + doc_id % 8] || coalesce(text, '') || ' Jr. and Mme Dantès, Esq.'"


@query(f"SELECT doc_id, md5(spoken) AS digest, length(spoken)::INTEGER AS chars FROM (SELECT doc_id, {_expanded_sql(_LETTERED)} AS spoken FROM documents)")
def expand_abbreviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents between abbreviations, which they lack themselves."""
    begin = F.get(F.array(*map(F.lit, ["Mr. ", "lambs, etc., ", "Lieut. ", "Malden, W. Va., ", "etc. ", "Gen. ", "Jas. ", "i.e. "])), F.pmod("doc_id", F.lit(8)).cast("int"))
    text = F.concat(begin, F.coalesce("text", F.lit("")), F.lit(" Jr. and Mme Dantès, Esq."))
    spoken = _docs(spark, sf_dir).select("doc_id", speech.expand(text).alias("spoken"))
    return spoken.select("doc_id", F.md5("spoken").alias("digest"), F.char_length("spoken").alias("chars"))


_SPOKEN = {"II. THE FALLING STAR.": "Two. The Falling Star.", "CHAPTER IV": "Chapter four.", "Part 12: Dawn": "Part twelve. Dawn.", "PREFACE": "Preface.", "Book 3 - The Sea": "Book three. The Sea.", "A Quiet Day": "A Quiet Day.", "Chapter 120": "Chapter one hundred and twenty.", "BOOK ONE THE COMING OF THE MARTIANS": "Book one. The Coming of the Martians.", "The 39 Steps": "The thirty-nine Steps."}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _SPOKEN.items()) + ") AS t(title, spoken)")
def spoken_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k,) for k in _SPOKEN], "title string").select("title", speech.spoken_title(F.col("title")).alias("spoken"))


_CASED = "CASE WHEN length({w}) > 1 AND upper({w}) = {w} THEN upper({n}) WHEN lower({w}[1]) <> {w}[1] THEN upper({n}[1]) || {n}[2:] ELSE {n} END"
_L = "A-Za-zÀ-ÖØ-öø-ÿ"


@query(f"""
WITH p AS (SELECT doc_id, regexp_extract_all(text, '[{_L}]+|[^{_L}]+') AS p FROM documents),
f AS (SELECT doc_id, p, list_transform(p, lambda x: lower(x)) AS f FROM p),
h AS (SELECT doc_id, p, f, list_transform(range(1, len(p) + 1), lambda i: f[i] = 'of' AND regexp_full_match(f[i + 1], '\\s+') AND f[i + 2] = 'the') AS h FROM f),
o AS (SELECT doc_id, list_transform(range(1, len(p) + 1), lambda i: CASE WHEN h[i] THEN {_CASED.format(w="regexp_replace(p[i] || p[i + 1] || p[i + 2], '\\s+', ' ', 'g')", n="'within the'")}
 WHEN i > 1 AND h[i - 1] OR i > 2 AND h[i - 2] THEN '' WHEN f[i] = 'the' THEN {_CASED.format(w="p[i]", n="'this'")} WHEN f[i] = 'idiot' THEN {_CASED.format(w="p[i]", n="'fool'")} ELSE p[i] END) AS o FROM h)
SELECT doc_id, md5(array_to_string(o, '')) AS digest FROM o
""")
def substitution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents with a phrase, a word of that phrase, and another word replaced."""
    lexicon = spark.createDataFrame([("of the", "within the"), ("the", "this"), ("idiot", "fool")], "term string, written string")
    return speech.substitute(_docs(spark, sf_dir).select("doc_id", "text"), lexicon).select("doc_id", F.md5("text").alias("digest"))


@query("SELECT * FROM (VALUES ('kˈAdɹWs', 'KAY-drows'), ('dɑ̃ɡlˈaʁ', 'dahn-GLAHR')) AS t(ipa, spelt)")
def respelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([("kˈAdɹWs",), ("dɑ̃ɡlˈaʁ",)], "ipa string").select("ipa", speech.respell(F.col("ipa")).alias("spelt"))


@query("SELECT * FROM (VALUES ('mɛri', 'mɛri', 1.0::DOUBLE), ('mɛri', 'xxmɛrixx', 1.0::DOUBLE), ('tɪm', 'tɪn', 0.6::DOUBLE), ('', 'a', 0.0::DOUBLE)) AS t(target, heard, score)")
def sound_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("mɛri", "mɛri"), ("mɛri", "xxmɛrixx"), ("tɪm", "tɪn"), ("", "a")], "target string, heard string")
    return rows.select("target", "heard", F.round(speech.sound_score("target", "heard"), 6).alias("score"))


_GRAM = "SELECT {id} AS id, unnest(range(0, greatest(len(t) - 2, 0))) AS pos, unnest(list_transform(range(1, greatest(len(t) - 1, 1)), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) AS gram FROM (SELECT {id}, regexp_extract_all(lower(replace(text, '’', '''')), '[a-z0-9]+(?:''[a-z]+)?') AS t FROM {table})"


@query(f"""
WITH b AS ({_GRAM.format(id="doc_id", table="documents")}), a AS ({_GRAM.format(id="item_id", table="benchmark")}), r AS (SELECT id, gram FROM b GROUP BY id, gram HAVING count(*) <= 8),
h AS (SELECT a.id AS item_id, b.id AS doc_id, b.pos - a.pos AS o, count(*) AS n FROM a JOIN b USING (gram) JOIN r ON r.id = b.id AND r.gram = b.gram GROUP BY ALL)
SELECT item_id, max(n)::BIGINT AS straight FROM h GROUP BY item_id
""")
def pair_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest unbroken alignment of each passage with any document, from the documents that its rarest grams admit."""
    pairs, _ = align.candidates(table(spark, sf_dir, "benchmark"), "item_id", _docs(spark, sf_dir), "doc_id")
    return pairs.groupBy("item_id").agg(F.max("least").alias("straight"))


@query(f"""
WITH b AS ({_GRAM.format(id="doc_id", table="documents")}), a AS ({_GRAM.format(id="item_id", table="benchmark")}), r AS (SELECT id, gram, count(*) AS n FROM b GROUP BY id, gram HAVING count(*) <= 8)
SELECT a.id AS item_id, r.id AS doc_id, sum(n)::BIGINT AS hits FROM a JOIN r USING (gram) GROUP BY 1, 2
""")
def passage_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grams that passages share with each document, however many documents have them."""
    hits = align.grams_within_books(table(spark, sf_dir, "benchmark"), "item_id", _docs(spark, sf_dir), "doc_id")
    return hits.groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("hits"))


@query()
def passage_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.best_passages(table(spark, sf_dir, "benchmark"), "item_id", _docs(spark, sf_dir), "doc_id").drop("chapter")


@query("""
WITH l AS (SELECT conv_id * 1000 + turn AS pos, text, role AS said FROM conversations), g AS (SELECT DISTINCT left(text, 24) AS prefix, role AS speaker FROM conversations WHERE turn % 2 = 0 AND length(text) >= 24)
SELECT prefix, speaker, arg_min(said, pos) AS found, arg_min(said, pos) = speaker AS "right" FROM g JOIN l ON left(text, 12) = left(prefix, 12) AND starts_with(text, prefix) GROUP BY prefix, speaker
""")
def gold_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beginnings of turns against the first turn that begins so: whether the speakers agree."""
    c = table(spark, sf_dir, "conversations")
    gold = c.where("turn % 2 = 0 AND char_length(text) >= 24").select(F.left("text", F.lit(24)).alias("prefix"), F.col("role").alias("speaker")).distinct()
    return align.first_speaker(gold, c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), "text", F.col("role").alias("speaker")))


@query("SELECT * FROM (VALUES (0, 'Ann'), (1, 'Bob'), (2, 'Ann'), (3, 'Bob')) AS t(pos, speaker)")
def quote_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, i, i, "Ann" if i == 0 else None, None, None, False, False, False, [], [], ["Ann", "Bob"]) for i in range(4)]
    kind = "chapter int, pos int, para int, explicit string, pron string, lead string, split boolean, cont boolean, other boolean, addressed array<string>, recent array<string>, cands array<string>"
    return attribution.attribute(spark.createDataFrame(rows, kind)).select("pos", "speaker")
