"""Names and words of a corpus: tables of surfaces, candidates, runs, contexts, votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirespark.functions import text as T
from quirespark.operators.books import sentence_rows

#: Apostrophe words that are ordinary contractions.
STANDARD = r"^(?:[a-z]+n't|[a-z]+'(?:s|d|ll|re|ve|m)|i'm|o'clock|ma'am|ne'er|e'er|o'er|'tis|'twas|'twere|'twill|'twould)$"
#: Endings and what may stand for them.
ENDINGS = [("ies", "y"), ("ied", "y"), ("ing", ""), ("ing", "e"), ("ed", ""), ("ed", "e"), ("es", ""), ("s", ""), ("d", ""), ("ly", ""), ("er", ""), ("est", ""), ("st", ""), ("eth", ""), ("eth", "e"), ("th", "")]


def tokens(docs: DataFrame) -> DataFrame:
    """doc_id, para, sent, pos (in the sentence) and word."""
    return sentence_rows(docs).select("doc_id", "para", "sent", F.posexplode(T.words(F.col("sentence"))).alias("pos", "word"))


def word_counts(docs: DataFrame) -> DataFrame:
    """word and count of the words of `tokens`: no sentence ends within a word, so texts are not cut into sentences."""
    return docs.select(F.explode(T.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("count"))


def word_table(docs: DataFrame) -> DataFrame:
    """One row for each word in lower case: counts, and its usual surface that is not all capitals."""
    low, word = F.lower("word"), F.col("word")
    shouted = (F.upper(word) == word) & (F.char_length(word) > 1)
    per = tokens(docs).groupBy(low.alias("term"), word.alias("word")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("pos") > 0).alias("inside"))
    capital = F.lower(F.substring("word", 1, 1)) != F.substring("word", 1, 1)
    return per.groupBy("term").agg(
        F.sum("n").alias("count"), F.sum(F.when(~capital, F.col("n")).otherwise(0)).alias("lower"),
        F.sum(F.when(capital, F.col("inside")).otherwise(0)).alias("mid_capital"),
        F.min_by("word", F.struct(shouted.cast("int"), -F.col("n"), "word")).alias("surface"),
    )


def name_candidates(docs: DataFrame, least: int = 2, most_lower: float = 0.02) -> DataFrame:
    """Words capitalised within sentences whose lower-case use is at most a share of all."""
    w = word_table(docs).where(F.col("mid_capital") >= least)
    share = F.col("lower") / (F.col("lower") + F.col("mid_capital"))
    return w.withColumn("lower_share", share).where(share <= most_lower)


def phrase_runs(docs: DataFrame) -> DataFrame:
    """Runs of two or more capitalised words, with how often each occurs."""
    one = "[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+"
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"({one}(?: {one})+)"), 1)).alias("phrase"))
    return runs.groupBy("phrase").agg(F.count(F.lit(1)).alias("count"), F.count_distinct("doc_id").alias("docs"))


def name_context(docs: DataFrame, names: DataFrame) -> DataFrame:
    """For each name and document its first sentence with the ones around it. Sentences meet names by their words.

    A document's sentences stay in its row, in order, so those around one are at hand; the names, which a caller lists, go
    to every task. Only sentences that hold a name are shuffled, one for each name and stretch of documents' rows."""
    paras = F.transform(F.filter(T.lines(F.col("text")), lambda p: F.btrim(p) != ""), lambda p: T.sentences(F.btrim(p)))
    s = docs.select("doc_id", F.flatten(paras).alias("ss"))
    near = F.transform("ss", lambda x, i: F.struct(F.get("ss", i - 1).alias("before"), x.alias("sentence"), F.get("ss", i + 1).alias("after")))
    s = s.select("doc_id", F.posexplode(near).alias("at", "c"))
    hits = s.withColumn("word", F.explode(F.array_distinct(F.transform(T.words(F.col("c.sentence")), F.lower)))).join(F.broadcast(names.select(F.lower("name").alias("word"), "name")), "word")
    return hits.groupBy("name", "doc_id").agg(F.min_by("c", "at").alias("c")).select("name", "doc_id", "c.*")


def name_pairs(clips: DataFrame, names: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(clip, name) for each name that a clip has as a word, with or without 's: an equi join on words, no theta join."""
    words_ = F.array_distinct(F.transform(T.words(F.col(text_col)), F.lower))
    return clips.select(id_col, F.explode(words_).alias("word")).join(names.select(F.lower("name").alias("word"), "name"), "word").select(id_col, "name")


def vote(rows: DataFrame, by: str, value: str, least_votes: int = 3, least_share: float = 0.5) -> DataFrame:
    """The winning value of each `by` if it has enough votes and a large enough share, else null."""
    n = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    top = n.groupBy(by).agg(F.max_by(value, F.struct("n", value)).alias("top"), F.max("n").alias("votes"), F.sum("n").alias("all"))
    return top.select(by, F.when((F.col("votes") >= least_votes) & (F.col("votes") / F.col("all") >= least_share), F.col("top")).alias("winner"), "votes", "all")


def is_dialect(token: Column, known: list[str] = ()) -> Column:
    """An apostrophe word that is no ordinary contraction, possessive, quotation or name; words of `known` always are."""
    k = F.lower(F.replace(token, F.lit("’"), F.lit("'")))
    bare = F.regexp_replace(token, "^['’]+", "")
    no = ~k.contains("'") | k.rlike(STANDARD) | (F.regexp_replace(k, "'", "") == "")
    looks = ~k.rlike("s'$|[a-z]'s$") & ~(k.rlike("^'.+'$")) & ~bare.rlike("^[A-ZÀ-ÖØ-Þ]")
    return F.when(no, False).when(k.isin(list(known)), True).otherwise(looks) if known else F.when(no, False).otherwise(looks)


def dialect_counts(docs: DataFrame, by: str, sounds: DataFrame) -> DataFrame:
    """by, token, count and ipa of the dialect words of each book, in small letters with typed apostrophes: words that are
    no ordinary contraction, possessive, quotation or name, and those of `sounds` (token, ipa; null where it has none).
    Null texts have none. Words are counted before they meet the sounds."""
    found = F.regexp_extract_all("text", F.lit(r"(['’]?[A-Za-zÀ-ÖØ-öø-ÿ]+(?:['’][A-Za-zÀ-ÖØ-öø-ÿ]+)*['’]?)"), 1)
    token = F.lower(F.replace("raw", F.lit("’"), F.lit("'")))
    raw = docs.select(by, F.explode(F.filter(found, lambda w: w.rlike("['’]"))).alias("raw")).groupBy(by, "raw").agg(F.count(F.lit(1)).alias("n"))
    known = sounds.groupBy("token").agg(F.max("ipa").alias("ipa")).withColumn("listed", F.lit(True))
    k = raw.withColumn("token", token).join(known, "token", "left")
    word = is_dialect(F.col("raw")) | (F.col("listed").isNotNull() & ~F.col("token").rlike(STANDARD) & (F.regexp_replace("token", "'", "") != ""))
    return k.where(word).groupBy(by, "token").agg(F.sum("n").alias("count"), F.max("ipa").alias("ipa"))


def with_dialect(lexicon: DataFrame, found: DataFrame) -> DataFrame:
    """lexicon (term, ipa, kind, source) with the dialect words that have sounds: missing ones are added, entries without
    sounds get them unless a user made them, and what has its own stays."""
    new = found.where("ipa IS NOT NULL").groupBy("token").agg(F.max("ipa").alias("_ipa"))
    key = F.lower(F.replace("term", F.lit("’"), F.lit("'")))
    both = lexicon.withColumn("_old", F.lit(True)).join(new, key == F.col("token"), "full")
    fill = (F.col("_old").isNull() | ((F.coalesce("source", F.lit("")) != "user") & (F.coalesce("ipa", F.lit("")) == ""))) & F.col("_ipa").isNotNull()
    return both.select(
        F.coalesce("term", "token").alias("term"), F.when(fill, F.col("_ipa")).otherwise(F.col("ipa")).alias("ipa"),
        F.when(fill & (F.coalesce("kind", F.lit("")) == ""), "dialect").otherwise(F.col("kind")).alias("kind"),
        F.when(F.col("_old").isNull(), "auto").otherwise(F.col("source")).alias("source"),
    )


def is_numeral(term: Column) -> Column:
    """Whether a term has the form of a Roman numeral: in capitals of any length, else of three letters or more."""
    shape = F.upper(term).rlike("^M{0,3}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})$") & (term != "")
    return shape & ((F.upper(term) == term) | (F.char_length(term) >= 3))


def numerals(terms: DataFrame, dictionary: DataFrame, term: str = "word") -> DataFrame:
    """terms with numeral: whether each has the form of a Roman numeral and is, unless in capitals, no word of the
    dictionary (column word, in small letters): Mix and Dix are words. A null term is none."""
    known = dictionary.select(F.col("word").alias("_low"), F.lit(True).alias("_known")).distinct()
    found = terms.withColumn("_low", F.lower(term)).join(known, "_low", "left")
    spelt = (F.upper(term) == F.col(term)) | F.col("_known").isNull()
    return found.withColumn("numeral", F.coalesce(is_numeral(F.col(term)) & spelt, F.lit(False))).drop("_low", "_known")


def stems(word: Column) -> Column:
    """The word and forms it may come from by its ending."""
    forms = [word] + [F.when(F.endswith(word, F.lit(e)) & (F.char_length(word) - len(e) >= 3), F.concat(F.left(word, F.char_length(word) - len(e)), F.lit(r))) for e, r in ENDINGS]
    return F.array_distinct(F.array_compact(F.array(*forms)))


def known_words(words_: DataFrame, dictionary: DataFrame, word: str = "word") -> DataFrame:
    """words_ with known: whether the dictionary (column word) has it or one of its stems."""
    s = words_.select(word, F.explode(stems(F.lower(word))).alias("stem")).join(dictionary.select(F.col("word").alias("stem"), F.lit(1).alias("hit")).distinct(), "stem", "left")
    return s.groupBy(word).agg((F.max("hit") == 1).alias("known")).select(word, F.coalesce("known", F.lit(False)).alias("known"))


#: What a pronoun says, and what ends the stretch of text in which it counts.
_PRONOUN = r"(?i)(?<![\p{L}\p{N}_])(he|his|him|himself|she|her|herself)(?![\p{L}\p{N}_])"


def genders(docs: DataFrame, names: DataFrame, reach: int = 140, text_col: str = "text") -> DataFrame:
    """For each name the pronouns that come first after it, within `reach` characters and its sentence; two votes decide.

    Names are whole words or phrases (Ann is not in Annals). Every word with a capital and a pronoun behind it meets the
    names by their first words, so no text meets a list of names; the rest of a phrase is checked after the join. Null
    texts and names have no votes; a name without two votes has no row.
    """
    longest = 60  # characters of a phrase that are looked at
    place = r"(?<![\p{L}\p{N}_])(?=(\p{Lu}[^.!?]{0," + str(longest + reach) + "}))"
    heads = docs.select(F.explode(F.regexp_extract_all(text_col, F.lit(place), 1)).alias("tail"))
    heads = heads.where(F.col("tail").rlike(r"(?i)(?<![\p{L}\p{N}_])(he|his|him|she)"))  # the reach may end within a word
    heads = heads.withColumn("first", F.regexp_extract("tail", r"^([\p{L}\p{N}_]+)", 1))
    asked = names.where(F.col("name").isNotNull()).select("name", F.regexp_extract("name", r"^([\p{L}\p{N}_]+)", 1).alias("first")).distinct()
    after = F.substring("tail", F.char_length("name") + 1, F.lit(reach))
    hits = heads.join(asked, "first").where(F.startswith("tail", "name") & ~F.coalesce(after, F.lit("")).rlike(r"^[\p{L}\p{N}_]"))
    said = F.lower(F.regexp_extract(after, _PRONOUN, 1))
    told = hits.select("name", F.when(said.rlike("^(she|her)"), "f").when(said != "", "m").alias("g")).where("g IS NOT NULL")
    n = told.groupBy("name").agg(F.count_if(F.col("g") == "f").alias("f"), F.count_if(F.col("g") == "m").alias("m"))
    return n.where("f + m >= 2").select("name", F.when(F.col("f") > F.col("m"), "f").otherwise("m").alias("gender"), (F.col("f") + F.col("m")).alias("votes"))
