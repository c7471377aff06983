"""Queries on the words of books: a source stands for a book, its documents for chapters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.functions.text import LETTER
from quirespark.operators import lexicon, names, repair, wordlist
from quirespark.plans.registry import query
from quirespark.shared import table


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("*+", "*").replace("'", "''").replace("\\n", "\n") + "'"


def _listed(words: list[str]) -> str:
    return ", ".join(_sql(w) for w in words)


_BARE = f"regexp_replace({{}}, {_sql(wordlist.POSSESSIVE)}, '')"
_CAPITAL = "[A-ZÀ-ÖØ-Þ]"
_GAP = "[ \n]{1,2}"
_USES = f"""d AS (SELECT doc_id, coalesce(source, 'none') AS book, regexp_extract_all(text, {_sql(f"([^{LETTER}]*)({wordlist.WORD})")}, 1) AS gs, regexp_extract_all(text, {_sql(f"([^{LETTER}]*)({wordlist.WORD})")}, 2) AS ws FROM documents),
t AS (SELECT doc_id, book, unnest(range(len(ws))) AS pos, unnest(gs) AS gap, unnest(ws) AS raw FROM d),
u AS (SELECT *, {_BARE.format("raw")} AS word, regexp_replace(gap, '\\s+$', '') AS sp, lag(raw) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM t),
c AS (SELECT doc_id, book, pos, word, CASE WHEN NOT regexp_matches(word, '^{_CAPITAL}') THEN 'lower'
  WHEN CASE WHEN sp = '' THEN pos = 0 ELSE right(sp, 1) IN ({_listed(list('.!?"“”‘'))}) END AND NOT (sp = '.' AND coalesce(regexp_matches(before, '\\b(?:{"|".join(wordlist.ABBREVIATED)})$'), false)) THEN 'init' ELSE 'mid' END AS use FROM u WHERE length(word) >= 3),
f AS (SELECT book, word, count(*) AS n, count(*) FILTER (use = 'mid') AS mid, count(*) FILTER (use = 'init') AS init, count(*) FILTER (use = 'lower') AS low, min({{'a': doc_id, 'b': pos}}) AS first FROM c GROUP BY book, word),
s AS (SELECT book, lower(word) AS key, arg_min(word, {{'a': (upper(word) = word)::INTEGER, 'b': -n, 'c': first}}) AS w, bool_and(upper(word) = word) AS shouted, sum(n)::BIGINT AS count, sum(mid)::BIGINT AS mid, sum(init)::BIGINT AS init, sum(low)::BIGINT AS lower FROM f GROUP BY book, lower(word)),
uses AS MATERIALIZED (SELECT book, key, CASE WHEN shouted THEN upper(w[1]) || lower(w[2:]) ELSE w END AS surface, count, mid, init, lower FROM s)"""


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("none")).alias("book"), "lang", "text")


@query(f"WITH {_USES} SELECT * FROM uses")
def word_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each book uses its words: within sentences, at their start, in small letters."""
    return wordlist.uses(_docs(spark, sf_dir), "book", "doc_id")


_PHRASES = f"""r AS (SELECT book, unnest(regexp_extract_all(text, {_sql(wordlist.PHRASE)})) AS p FROM (SELECT coalesce(source, 'none') AS book, text FROM documents)),
x AS (SELECT book, regexp_split_to_array(p, '{_GAP}') AS ws FROM r WHERE regexp_matches(p, '^{_CAPITAL}[^ \n]*{_GAP}')),
y AS (SELECT book, ws[list_position(list_transform(ws, lambda w: regexp_replace(lower(w), '^[’'']+|[’'']+$', '', 'g') IN ({_listed(wordlist.LEADING)})), false) :] AS ws FROM x WHERE NOT list_bool_and(list_transform(ws, lambda w: regexp_replace(lower(w), '^[’'']+|[’'']+$', '', 'g') IN ({_listed(wordlist.LEADING)})))),
phrases AS MATERIALIZED (SELECT book, array_to_string(ws, ' ') AS phrase, count(*) AS count FROM y WHERE len(ws) >= 2 GROUP BY ALL)"""


@query(f"WITH {_PHRASES} SELECT * FROM phrases")
def name_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of capitalised words with their connectors, without what only begins a sentence."""
    return wordlist.phrase_counts(_docs(spark, sf_dir), "book")


_ENDINGS = ", ".join(f"CASE WHEN ends_with(w, '{e}') AND length(w) - {len(e)} >= 3 THEN left(w, length(w) - {len(e)}) || '{r}' END" for e, r in names.ENDINGS)
_NUMERAL = "regexp_matches(upper({0}), '^M{{0,3}}(?:CM|CD|D?C{{0,3}})(?:XC|XL|L?X{{0,3}})(?:IX|IV|V?I{{0,3}})$')"
_LINKS = [c for c in wordlist.CONNECTORS if c not in wordlist.ENGLISH_CONNECTORS]


def _frequencies(docs: DataFrame) -> DataFrame:
    words = docs.where("lang IS NOT NULL").select("lang", F.explode(F.regexp_extract_all("text", F.lit(f"([{LETTER}]+)"), 1)).alias("w"))
    n = words.groupBy(F.lower("w").alias("word"), "lang").agg(F.count(F.lit(1)).alias("n"))
    return n.select("word", "lang", F.when(F.col("n") >= 100, 5.0).when(F.col("n") >= 20, 4.0).when(F.col("n") >= 5, 3.0).otherwise(2.0).alias("zipf"))


_FREQ = f"""plain AS (SELECT lang, lower(unnest(regexp_extract_all(text, '[{LETTER}]+'))) AS word FROM documents WHERE lang IS NOT NULL),
freq AS MATERIALIZED (SELECT word, lang, (CASE WHEN n >= 100 THEN 5 WHEN n >= 20 THEN 4 WHEN n >= 5 THEN 3 ELSE 2 END)::DOUBLE AS zipf FROM (SELECT word, lang, count(*) AS n FROM plain GROUP BY word, lang))"""


@query(f"""
WITH {_USES}, {_FREQ}
SELECT book, surface AS name, mid AS count FROM uses LEFT JOIN (SELECT word AS key, zipf FROM freq WHERE lang = 'en') USING (key) WHERE mid >= 2 AND regexp_matches(surface, '^[A-Z][a-zà-ÿ]{{2,}}$') AND coalesce(zipf, 0.0) < 4.0
""")
def book_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that books write with a capital within sentences or after an abbreviation, and that English rarely has."""
    docs = _docs(spark, sf_dir)
    return wordlist.characters(wordlist.uses(docs, "book", "doc_id"), _frequencies(docs))


@query(f"""
WITH {_USES}, {_PHRASES}, {_FREQ},
dict AS (SELECT word FROM freq WHERE lang = 'en' AND zipf >= 3),
keys AS (SELECT DISTINCT key FROM uses),
parts AS (SELECT key, 0 AS part, key AS w FROM keys UNION ALL SELECT DISTINCT key, 1, p FROM (SELECT key, unnest(regexp_split_to_array(key, '[-''’]')) AS p FROM keys) WHERE p <> '' AND p <> key),
hits AS (SELECT key, part, w, bool_or(dict.word IS NOT NULL) OR (length(w) <= 2 AND part > 0) AS ok FROM (SELECT key, part, w, unnest([w, {_ENDINGS}]) AS word FROM parts) LEFT JOIN dict USING (word) GROUP BY key, part, w),
known AS (SELECT key, bool_or(part = 0 AND ok) OR coalesce(bool_and(ok) FILTER (part > 0), false) AS known FROM hits GROUP BY key),
e0 AS (SELECT book, key, surface AS term, count, lower, known, CASE WHEN mid >= 1 AND mid >= lower THEN 'name' WHEN regexp_matches(surface, '[^\\x00-\\x7f]') THEN 'foreign' ELSE 'word' END AS kind
  FROM uses JOIN known USING (key) WHERE NOT ({_NUMERAL.format("surface")} AND (upper(surface) = surface OR length(surface) >= 3) AND (upper(surface) = surface OR lower(surface) NOT IN (SELECT word FROM dict)))),
lang AS (SELECT word AS key, max(zipf) FILTER (lang = 'en') AS zipf, max({{'z': zipf, 'l': lang}}) FILTER (lang <> 'en') AS other FROM freq GROUP BY word),
e1 AS (SELECT book, key, term, count, kind, known, coalesce(zipf, 0.0) AS zipf, CASE WHEN length(key) >= 4 AND other.z >= 2.5 AND other.z >= coalesce(zipf, 0.0) + CASE kind WHEN 'name' THEN 1.0 ELSE 0.5 END THEN other.l END AS lang, NULL::DOUBLE AS words FROM e0 LEFT JOIN lang USING (key) WHERE NOT known),
tok AS (SELECT book, phrase, count, lower(phrase) AS key, regexp_extract_all(phrase, {_sql(wordlist.WORD)}) AS ts FROM phrases),
ph AS (SELECT book, phrase, count, key, list_transform(list_filter(ts, lambda t: lower(t) NOT IN ({_listed(wordlist.CONNECTORS)})), lambda t: lower({_BARE.format("t")})) AS content,
  len(list_filter(ts, lambda t: lower(t) IN ({_listed(_LINKS)}) OR regexp_matches(lower(t), '^(?:d|l|de)[’'']'))) > 0 AS linked FROM tok),
pw AS (SELECT book, phrase, unnest(content) AS w FROM ph WHERE linked),
pm AS (SELECT pw.book, phrase, count(e1.key) AS hits, min(coalesce(lang.zipf, 0.0)) AS words FROM pw LEFT JOIN e1 ON pw.book = e1.book AND pw.w = e1.key LEFT JOIN lang ON lang.key = pw.w GROUP BY pw.book, phrase),
pf AS (SELECT book, key, arg_max(phrase, {{'a': count, 'b': phrase}}) AS term, sum(count)::BIGINT AS count, min(words) AS words FROM ph JOIN pm USING (book, phrase) WHERE hits >= 1 GROUP BY book, key),
al AS (SELECT * FROM e1 UNION ALL SELECT book, key, term, count, 'phrase', false, 0.0, NULL, words FROM pf),
v AS (SELECT book, lang, count(*) AS n FROM al WHERE lang IS NOT NULL GROUP BY book, lang),
b AS (SELECT book, arg_max(lang, {{'n': n, 'l': lang}}) AS top, max(n) AS most, sum(n) AS every FROM v GROUP BY book),
un AS (SELECT book, count(*) AS unknown FROM al GROUP BY book),
ch AS (SELECT book, CASE WHEN most >= 3 AND most >= 0.5 * every AND most >= 0.15 * greatest(1, unknown) THEN top END AS voted FROM b JOIN un USING (book)),
j AS (SELECT al.*, v.n, voted, regexp_matches(term, '[^\\x00-\\x7f]') AS foreign_ FROM al LEFT JOIN v ON v.book = al.book AND v.lang = al.lang LEFT JOIN ch ON ch.book = al.book),
o AS (SELECT *, lang IS NOT NULL AND NOT (lang IS DISTINCT FROM voted AND n < 2 AND NOT foreign_) AS told,
  lang IS NULL AND (NOT regexp_matches(term, '[''’]') OR kind = 'phrase') AND voted IS NOT NULL AND NOT (kind = 'phrase' AND NOT foreign_ AND coalesce(words, 0.0) >= 3.2) AND (kind IN ('name', 'place', 'demonym', 'foreign', 'phrase') OR foreign_) AS takes FROM j)
SELECT book, term, count, kind, known, CASE WHEN told THEN lang WHEN takes THEN voted END AS lang, CASE WHEN told THEN 'wordfreq' WHEN takes THEN 'book' END AS lang_src, CASE WHEN takes THEN 0.5 END AS lang_conf, 'auto' AS source
FROM o WHERE kind <> 'phrase' OR told OR takes
""")
def word_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words and phrases of each book that its dictionary does not know, with kinds and languages. The dictionary is what
    English documents have five times and more; how often each language has a word is counted as well."""
    docs = _docs(spark, sf_dir)
    frequencies = _frequencies(docs)
    return wordlist.word_list(docs, frequencies.where("lang = 'en' AND zipf >= 3").select("word"), frequencies, "book", "doc_id")


_ENDS = '[.!?"“”‘’\\n] '
_SHOUT = "list_filter(string_split(regexp_replace(coalesce(text, ''), '[^A-Za-z]+', ' ', 'g'), ' '), lambda w: length(w) >= 2)"
_RAISED = "upper(w[1]) || lower(w[2:])"


@query(f"""
WITH {_FREQ},
ev AS (SELECT coalesce(source, 'none') AS book, regexp_replace(regexp_replace(text, '^[A-Z][a-z]+', '_'), '({_ENDS})[A-Z][a-z]+', '\\1_', 'g') AS t FROM documents),
names AS (SELECT DISTINCT book, lower(w) AS word FROM (SELECT book, unnest(regexp_extract_all(t, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')) AS w FROM ev) WHERE regexp_full_match(w, '[A-Z][a-z]+')),
d AS (SELECT doc_id, coalesce(source, 'none') AS book, list_transform({_SHOUT}, lambda w: upper(w)) AS ws FROM documents),
w AS (SELECT doc_id, book, unnest(range(len(ws))) AS i, unnest(ws) AS w, len(ws) AS n FROM d),
k AS (SELECT w.*, names.word IS NOT NULL AS named, coalesce(zipf, 0.0) AS zipf FROM w LEFT JOIN names ON names.book = w.book AND names.word = lower(w) LEFT JOIN (SELECT word, zipf FROM freq WHERE lang = 'en') AS f ON f.word = lower(w)),
c AS (SELECT doc_id, i, CASE WHEN regexp_matches(w, '^[IVXLCDM]+$') OR w IN ({_listed(repair.KEPT)}) THEN w
  WHEN n = 1 THEN CASE WHEN length(w) >= 3 AND (named OR zipf >= 2) THEN {_RAISED} ELSE w END
  WHEN named THEN {_RAISED} WHEN length(w) >= 3 AND zipf < 2 THEN w WHEN i = 0 THEN {_RAISED} ELSE lower(w) END AS w FROM k),
j AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS t FROM c GROUP BY doc_id)
SELECT doc_id, md5('Thus: ' || coalesce(t, '') || ', they cried.') AS digest FROM documents LEFT JOIN j USING (doc_id)
""")
def repaired_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents put in capitals, between a beginning and an end that are not: what each book's own documents write with
    a capital, and what English has, decides which words keep theirs. Only letters are left of them, so ESQ is no title. The
    end stands one blank after what is before it, also if that is the beginning."""
    docs = _docs(spark, sf_dir)
    words = F.filter(F.split(F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]+", " ")), " ", -1), lambda w: F.char_length(w) >= 2)
    loud = docs.select("book", F.col("doc_id").alias("chapter"), F.concat(F.lit("Note from the original file: x\n\nThus: "), F.array_join(F.concat(words, F.array(F.lit(", they cried ."))), " ")).alias("text"))
    fixed = repair.repaired(loud, _frequencies(docs), names=lexicon.mid_sentence_capitals(docs, "book"), titles=False)
    return fixed.select(F.col("chapter").alias("doc_id"), F.md5("text").alias("digest"))
