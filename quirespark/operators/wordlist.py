"""The words of a book that may need a voice's help: one table of surfaces, kinds and languages, and of phrases.

Words are counted before they are shuffled, by how a text uses them; everything after works on one row for each word of a
book. A book's texts may be many rows. Null and empty texts have no words; equal ids of texts only matter where surfaces
are equally frequent, which the first in the order of ids then decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirespark.functions.text import LETTER
from quirespark.operators import names
from quirespark.shared import freeze

#: Words and their possessives; words that link names, and those of them that are English; words that have a
#: capital only because a sentence begins with them; short forms whose stop ends no sentence.
WORD = f"[{LETTER}]+(?:[’'-][{LETTER}]+)*+"
POSSESSIVE = "[’'][sS]$"
CONNECTORS = "de du des la le les of von van der di del della da dos y el al the d l".split()
ENGLISH_CONNECTORS = ["of", "the", "and", "to"]
LEADING = (
    "from the in on at to and but then when as by for with after before of if so or nor yet while until upon into over under through about near between among during against "
    "along across toward towards within without dear dearest my our your his her their this that these those there here now thus once all some"
).split()
ABBREVIATED = "M MM Mme Mlle Mr Mrs Dr St Capt Col".split()

# loops are possessive: nothing that follows them gives back, and long runs need no stack
_UPPER = f"[A-ZÀ-ÖØ-Þ][{LETTER}]*(?:[’'-][{LETTER}]+)*+"
_ELIDED = f"(?:d|l|de)['’][A-ZÀ-ÖØ-Þ][{LETTER}]*(?:[’'-][{LETTER}]+)*+"
_GAP = "[ \\n]{1,2}"
#: A capitalised word with all that belongs to it, or else any word: matches never begin within a word.
PHRASE = f"{_UPPER}(?:{_GAP}(?:{_UPPER}|{_ELIDED})|{_GAP}(?:{'|'.join(CONNECTORS)}){_GAP}{_UPPER})*+|{WORD}"


def bare(word: Column) -> Column:
    return F.regexp_replace(word, POSSESSIVE, "")


def phrases_in(text: Column) -> Column:
    """The runs of capitalised words in a text, of two words or more. A connector (Allées de Meilhan) counts only before a
    capital, d' and l' also within a word; function words at the front go, since only a sentence gave them their capital."""
    runs = F.filter(F.regexp_extract_all(text, F.lit(f"({PHRASE})"), 1), lambda p: p.rlike(f"^[A-ZÀ-ÖØ-Þ][^ \\n]*{_GAP}"))
    return F.filter(F.transform(runs, _trimmed), lambda p: p.contains(" "))


def _trimmed(phrase: Column) -> Column:
    words = F.split(phrase, _GAP, -1)
    leads = F.transform(words, lambda w: F.regexp_replace(F.lower(w), "^[’']+|[’']+$", "").isin(LEADING))
    first = F.array_position(leads, F.lit(False))
    return F.when(first > 0, F.array_join(F.slice(words, F.greatest(first, F.lit(1)).cast("int"), F.size(words)), " ")).otherwise("")


def phrase_counts(docs: DataFrame, by: str, text: str = "text") -> DataFrame:
    """by, phrase and count."""
    return docs.select(by, F.explode(phrases_in(F.col(text))).alias("phrase")).groupBy(by, "phrase").agg(F.count(F.lit(1)).alias("count"))


def uses(docs: DataFrame, book: str, order: str, text: str = "text") -> DataFrame:
    """One row for each word of a book (in small letters, without its possessive, of three letters or more): count, how often
    it begins with a capital within a sentence (mid) and at the start of one (init), how often it does not (lower), and its
    commonest surface that is not all capitals; where all are, the commonest with one capital. `order` orders the texts."""
    part = lambda k: F.regexp_extract_all(text, F.lit(f"([^{LETTER}]*)({WORD})"), k)
    own = docs.select(F.col(book).alias("book"), F.col(order).alias("at"), part(1).alias("gaps"), part(2).alias("words"))

    def use(gap: Column, i: Column) -> Column:
        word = bare(F.get(F.col("words"), i))
        before = F.get(F.col("words"), i - 1)
        space = F.rtrim(F.regexp_replace(gap, r"\s+$", ""))
        starts = F.when(space == "", i == 0).otherwise(F.right(space, F.lit(1)).isin(*".!?\"“”‘"))
        short = (space == ".") & F.coalesce(before.rlike(rf"\b(?:{'|'.join(ABBREVIATED)})$"), F.lit(False))
        return F.struct(word.alias("word"), F.when(word.rlike("^[^A-ZÀ-ÖØ-Þ]"), "lower").when(starts & ~short, "init").otherwise("mid").alias("use"))

    found = own.select("book", "at", F.posexplode(F.transform("gaps", use)).alias("pos", "u")).select("book", "at", "pos", "u.*").where(F.char_length("word") >= 3)
    count = lambda u: F.count_if(F.col("use") == u).alias(u)
    # a place as one number is added up by hashes; a struct would have every word of every text sorted first. Null ids come first
    place = F.struct("at", "pos")
    if dict(docs.dtypes)[order] in ("bigint", "int", "smallint", "tinyint"):
        at = F.coalesce(F.col("at").cast("decimal(19,0)"), F.lit(str(-(1 << 63) - 1)).cast("decimal(19,0)"))
        place = at * F.lit(1 << 31).cast("decimal(10,0)") + F.col("pos").cast("decimal(10,0)")
    surfaces = found.groupBy("book", "word").agg(F.count(F.lit(1)).alias("n"), count("mid"), count("init"), count("lower"), F.min(place).alias("first"))
    shouted = F.upper("word") == F.col("word")
    best = F.min_by("word", F.struct(shouted.cast("int"), -F.col("n"), "first"))
    rows = surfaces.groupBy("book", F.lower("word").alias("key")).agg(best.alias("surface"), F.bool_and(shouted).alias("shouted"), F.sum("n").alias("count"), F.sum("mid").alias("mid"), F.sum("init").alias("init"), F.sum("lower").alias("lower"))
    one = F.concat(F.upper(F.substring("surface", 1, 1)), F.lower(F.substring("surface", F.lit(2), F.char_length("surface"))))
    return rows.withColumn("surface", F.when(F.col("shouted"), one).otherwise(F.col("surface"))).drop("shouted")


def characters(used: DataFrame, frequencies: DataFrame, least: int = 2, common: float = 4.0) -> DataFrame:
    """book, name and count of the words that a book (see `uses`) writes with a capital within sentences, or after an
    abbreviation, `least` times, and that are rarer in English than `common` (frequencies: word, lang, zipf)."""
    rank = frequencies.where("lang = 'en'").groupBy(F.col("word").alias("key")).agg(F.max("zipf").alias("zipf"))
    found = used.where((F.col("mid") >= least) & F.col("surface").rlike("^[A-Z][a-zà-ÿ]{2,}$")).join(rank, "key", "left")
    return found.where(F.coalesce("zipf", F.lit(0.0)) < common).select("book", F.col("surface").alias("name"), F.col("mid").alias("count"))


def in_dictionary(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Distinct key of words with known: whether every part between hyphens and apostrophes is a word of the dictionary, comes
    from one by its ending, or has two letters or fewer, or the whole is such a word."""
    key = words.select("key").distinct()
    parts = key.select("key", F.posexplode(F.array_distinct(F.concat(F.array("key"), F.filter(F.split("key", "[-'’]", -1), lambda p: p != "")))).alias("part", "w"))
    stems = parts.select("key", "part", F.char_length("w").alias("size"), F.explode(names.stems(F.col("w"))).alias("word"))
    hits = stems.join(dictionary.select("word", F.lit(True).alias("hit")).distinct(), "word", "left")
    each = hits.groupBy("key", "part").agg((F.coalesce(F.bool_or("hit"), F.lit(False)) | ((F.max("size") <= 2) & (F.max("part") > 0))).alias("ok"))
    return each.groupBy("key").agg((F.bool_or(F.when(F.col("part") == 0, F.col("ok")).otherwise(False)) | F.coalesce(F.bool_and(F.when(F.col("part") > 0, F.col("ok"))), F.lit(False))).alias("known"))


def word_languages(entries: DataFrame, frequencies: DataFrame, english: str = "en", least: float = 2.5) -> DataFrame:
    """entries (book, key, kind, known) with lang and zipf, the word's frequency in English (0 if it has none): the language
    other than English that knows a word of four letters or more clearly better, by 1 for names and 0.5 for others, and at
    least `least`; null where none does. frequencies: word, lang, zipf. Known words and phrases have none."""
    keys = entries.select("key").distinct().join(frequencies.withColumnRenamed("word", "key"), "key")
    best = keys.groupBy("key").agg(
        F.max(F.when(F.col("lang") == english, F.col("zipf"))).alias("zipf"),
        F.max_by(F.when(F.col("lang") != english, F.struct("lang", "zipf")), F.when(F.col("lang") != english, F.struct("zipf", F.col("lang").alias("l")))).alias("other"),
    )
    rows = entries.join(best, "key", "left").withColumn("zipf", F.coalesce("zipf", F.lit(0.0)))
    ahead = F.when(F.col("kind").isin("name", "place", "demonym", "phrase"), 1.0).otherwise(0.5)
    clear = (F.char_length("key") >= 4) & (F.col("other.zipf") >= least) & (F.col("other.zipf") >= F.col("zipf") + ahead) & ~F.col("known") & (F.col("kind") != "phrase")
    return rows.withColumn("lang", F.when(clear, F.col("other.lang"))).drop("other")


def with_book_language(entries: DataFrame, least_votes: int = 3, of_votes: float = 0.5, of_unknown: float = 0.15, plain: float = 3.2, hints: DataFrame | None = None) -> DataFrame:
    """entries (book, key, kind, known, lang, zipf, source, words) with lang settled, and lang_src: wordfreq where the word
    itself tells, book where it takes the book's language. That is the one given in `hints` (book, hint), else the one most
    words vote for, if they are enough votes, enough of all votes and of the words nobody knows. A lone word in another
    language is chance, unless it has letters beyond ASCII. Names and words with such letters that tell nothing themselves
    are the book's; other words, words with apostrophes, phrases of everyday English words (`words` gives the least zipf of
    a phrase) and what a user entered are left."""
    free = (F.coalesce("source", F.lit("")) != "user") & ~F.col("known")
    votes = entries.where(free & F.col("lang").isNotNull()).groupBy("book", "lang").agg(F.count(F.lit(1)).alias("n"))
    unknown = entries.groupBy("book").agg(F.count_if(~F.col("known")).alias("unknown"))
    top = votes.groupBy("book").agg(F.max_by("lang", F.struct("n", "lang")).alias("top"), F.max("n").alias("most"), F.sum("n").alias("all")).join(unknown, "book")
    chosen = top.select("book", F.when((F.col("most") >= least_votes) & (F.col("most") >= of_votes * F.col("all")) & (F.col("most") >= of_unknown * F.greatest(F.lit(1), F.col("unknown"))), F.col("top")).alias("voted"))
    rows = entries.join(votes, ["book", "lang"], "left").join(chosen, "book", "left")
    rows = rows.join(hints.select("book", "hint"), "book", "left") if hints is not None else rows.withColumn("hint", F.lit(None).cast("string"))
    of_book = F.coalesce("hint", "voted")
    foreign = F.col("term").rlike(r"[^\x00-\x7f]")
    lone = F.col("lang").isNotNull() & ~F.col("lang").eqNullSafe(of_book) & (F.col("n") < 2) & ~foreign
    waits = free & F.col("lang").isNull() & (~F.col("term").rlike("['’]") | (F.col("kind") == "phrase"))
    everyday = (F.col("kind") == "phrase") & ~foreign & (F.coalesce("words", F.lit(0.0)) >= plain)
    takes = waits & of_book.isNotNull() & ~everyday & (F.col("kind").isin("name", "place", "demonym", "foreign", "phrase") | foreign)
    told = F.col("lang").isNotNull() & ~lone & free
    return rows.withColumns({
        "lang_src": F.when(told, "wordfreq").when(takes, "book"),
        "lang_conf": F.when(takes, F.when(F.col("hint").isNotNull(), 1.0).otherwise(0.5)),
        "lang": F.when(told | ~free, F.col("lang")).when(takes, of_book),
    }).drop("n", "voted", "hint")


def word_list(docs: DataFrame, dictionary: DataFrame, frequencies: DataFrame, book: str = "book", order: str = "doc_id", labels: DataFrame | None = None, own: DataFrame | None = None, hints: DataFrame | None = None, rare: float = 4.5) -> DataFrame:
    """book, term, count, kind, known, lang, lang_src, lang_conf and source of the words and phrases of each book that a
    voice may need help with.

    A word that the dictionary (word, in small letters) knows is left out, unless it is used as a name only, is labelled one
    and is rarer than `rare`. frequencies: word, lang, zipf. labels: book, key, kind and n, what a model of names says of
    words; phrases that it calls a place have kind place and the phrase as key. A word is a name (or what most labels say)
    where it has a capital within sentences at least as often as none, else foreign if it has letters beyond ASCII, else a
    word. A phrase is listed if it is labelled a place without English connectors, or if it has a foreign connector and a
    word that is listed. `own`: book, term and lang of what a user entered, which stays. Phrases of no language are left out.

    Labels, own entries and hints may be left out or empty. Null books are a book like any other to count, but take no part
    in joins."""
    seen = freeze(uses(docs, book, order), "uses")
    none = docs.sparkSession.createDataFrame([], "book string, key string, kind string, n long")
    said = (labels if labels is not None else none).withColumn("key", F.lower("key"))
    kinds = said.groupBy("book", "key").agg(F.max_by("kind", F.struct("n", "kind")).alias("label"), F.bool_or(F.col("kind").isin("name", "place")).alias("named"))
    w = seen.join(in_dictionary(seen, dictionary), "key").join(kinds, ["book", "key"], "left")
    w = names.numerals(w, dictionary, "surface").where("NOT numeral").drop("numeral")
    capital = (F.col("mid") >= 1) & (F.col("mid") >= F.col("lower"))
    kind = F.when(capital, F.coalesce("label", F.lit("name"))).when(F.col("surface").rlike(r"[^\x00-\x7f]"), "foreign").otherwise("word")
    w = w.select("book", "key", F.col("surface").alias("term"), "count", kind.alias("kind"), "known", "lower", F.coalesce("named", F.lit(False)).alias("named"), capital.alias("capital"))
    w = word_languages(w, frequencies)
    keeps = ~F.col("known") | (F.col("named") & F.col("capital") & F.col("kind").isin("name", "place") & (F.col("lower") == 0) & (F.col("zipf") < rare))
    w = w.where(keeps).withColumns({"words": F.lit(None).cast("double"), "source": F.lit("auto")}).drop("lower", "named", "capital")
    if own is not None:
        mine = own.select("book", F.lower("term").alias("key"), F.col("term").alias("_term"), F.col("lang").alias("_lang"), F.lit("user").alias("_source"))
        w = w.join(mine, ["book", "key"], "full")
        w = w.withColumns({
            "term": F.coalesce("term", "_term"), "count": F.coalesce("count", F.lit(0)), "kind": F.coalesce("kind", F.lit("word")), "known": F.coalesce("known", F.lit(False)), "zipf": F.coalesce("zipf", F.lit(0.0)),
            "lang": F.when(F.col("_source").isNotNull(), F.coalesce("_lang", "lang")).otherwise(F.col("lang")), "source": F.coalesce("_source", "source"),
        }).drop("_term", "_lang", "_source")
    w = freeze(w, "words")
    both = freeze(w.unionByName(_phrases(docs, book, w, said, frequencies)), "entries")
    out = with_book_language(both, hints=hints).where("kind != 'phrase' OR lang IS NOT NULL")
    return out.select("book", "term", "count", "kind", "known", "lang", "lang_src", "lang_conf", "source")


def _phrases(docs: DataFrame, book: str, listed: DataFrame, labels: DataFrame, frequencies: DataFrame) -> DataFrame:
    """The phrases of each book that belong in its list, with the columns of `listed`."""
    p = phrase_counts(docs.withColumnRenamed(book, "book") if book != "book" else docs, "book")
    tokens = F.regexp_extract_all("phrase", F.lit(f"({WORD})"), 1)
    joins = lambda t: F.lower(t).isin(CONNECTORS)
    linked = F.exists(tokens, lambda t: F.lower(t).isin([c for c in CONNECTORS if c not in ENGLISH_CONNECTORS]) | F.lower(t).rlike("^(?:d|l|de)[’']"))
    english = F.exists(tokens, lambda t: F.lower(t).isin(ENGLISH_CONNECTORS))
    content = F.transform(F.filter(tokens, lambda t: ~joins(t)), lambda t: F.lower(bare(t)))
    p = p.select("book", "phrase", "count", F.lower("phrase").alias("key"), content.alias("content"), linked.alias("linked"), english.alias("english"))
    p = p.where((F.size("content") >= 2) | F.col("linked"))
    places = labels.where("kind = 'place'").select("book", "key", F.lit(True).alias("place")).distinct()
    words = p.select("book", "phrase", F.explode("content").alias("w"))
    rank = frequencies.where("lang = 'en'").groupBy(F.col("word").alias("w")).agg(F.max("zipf").alias("zipf"))
    hits = words.join(listed.select("book", F.col("key").alias("w"), F.lit(1).alias("hit")), ["book", "w"], "left").join(rank, "w", "left")
    hits = hits.groupBy("book", "phrase").agg(F.sum("hit").alias("hits"), F.min(F.coalesce("zipf", F.lit(0.0))).alias("words"))
    p = p.join(hits, ["book", "phrase"], "left").join(places, ["book", "key"], "left")
    fits = (F.coalesce("place", F.lit(False)) & ~F.col("english")) | (F.col("linked") & (F.coalesce("hits", F.lit(0)) >= 1))
    # one entry for each spelling without regard to case, as for words
    best = p.where(fits).groupBy("book", "key").agg(F.max_by("phrase", F.struct("count", "phrase")).alias("term"), F.sum("count").alias("count"), F.min("words").alias("words"))
    return best.select("key", "book", "term", "count", F.lit("phrase").alias("kind"), F.lit(False).alias("known"), F.lit(0.0).alias("zipf"), F.lit(None).cast("string").alias("lang"), "words", F.lit("auto").alias("source"))


def repaired(entries: DataFrame) -> DataFrame:
    """entries (book, term, count, kind, source) whose phrases have lost function words at their front: those that become
    equal are one entry with the sum of their counts, those of which one word is left go; what a user entered stays."""
    phrase = (F.col("kind") == "phrase") & (F.coalesce("source", F.lit("")) != "user")
    new = entries.withColumn("term", F.when(phrase, _trimmed(F.col("term"))).otherwise(F.col("term"))).withColumn("_p", phrase)
    kept = new.where(~F.col("_p") | F.col("term").contains(" "))
    first = Window.partitionBy("book", F.lower("term")).orderBy(F.col("_p").cast("int"), F.desc("count"), "term")
    total = F.sum("count").over(Window.partitionBy("book", F.lower("term")))
    ranked = kept.withColumns({"_n": F.row_number().over(first), "count": total})
    return ranked.where("_n = 1").drop("_n", "_p")
