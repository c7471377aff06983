"""The words of books and how they are spoken: evidence of names, which names to check, updates over many books.

Entries are rows (book, term, ...); terms are compared without regard to case. A null term matches nothing, repeated terms
of a book are all changed alike, and empty tables give empty results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The two modes of a book, which say which spellings are in use.
CHECKED, VERIFIED = "checked", "verified"


def mid_sentence_capitals(docs: DataFrame, by: str, text: str = "text") -> DataFrame:
    """by and word: words, in small letters, that a book writes with a capital within a sentence: its names. Null texts
    have none. Each text's words are made distinct before anything is shuffled."""
    # most places are no capital, which is looked for first
    inside = "(?U)(?=[A-Z])(?<![.!?\"“”‘’\n] )(?<!^)\\b([A-Z][a-z]+)\\b"
    words = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(inside), 1), lambda w: F.lower(w)))
    return docs.select(by, F.explode(words).alias("word")).distinct()


def to_check(entries: DataFrame, kinds: list[str], now: DataFrame) -> DataFrame:
    """entries (book, term, kind, lang, ipa, ipa_src, source, ok_manual, ok_print) to check: names with sounds from a real
    source (sounds without a source, on a name whose language was guessed, are a guess), unless they were marked good by
    hand or judged good and their clips (`now`: book, term, print) have not changed since."""
    guess = (F.coalesce("lang", F.lit("")) != "") & (F.coalesce("ipa_src", F.lit("")) == "") & (F.coalesce("source", F.lit("")) != "user")
    sounds = F.btrim(F.when(guess, "").otherwise(F.coalesce("ipa", F.lit(""))))
    real = (sounds != "") & ~F.startswith(F.coalesce("ipa_src", F.lit("")), F.lit("guess"))
    good = F.coalesce("ok_manual", F.lit(False)) | F.coalesce(F.col("ok_print") == F.col("print"), F.lit(False))
    return entries.where(F.col("kind").isin(kinds) & real).join(now, ["book", "term"], "left").where(~good).drop("print")


def spelling_modes(clips: DataFrame) -> DataFrame:
    """book and mode: which spellings its engines use."""
    has = lambda e: F.coalesce(F.bool_or(F.col("engine") == e), F.lit(False))
    return clips.groupBy("book").agg(F.when(has("higgs") & ~has("chatterbox"), CHECKED).otherwise(VERIFIED).alias("mode"))


def spoken_forms(entries: DataFrame, spellings: DataFrame, modes: DataFrame) -> DataFrame:
    """entries with spoken: the spelling in use in the mode of their book (spellings: term, mode, spelling), else the term.
    Books without clips are in the mode `verified`."""
    e = entries.join(modes, "book", "left").withColumn("mode", F.coalesce("mode", F.lit(VERIFIED))).withColumn("_k", F.lower("term"))
    s = spellings.groupBy(F.lower("term").alias("_k"), "mode").agg(F.min("spelling").alias("_s"))
    return e.join(s, ["_k", "mode"], "left").withColumn("spoken", F.coalesce(F.nullif(F.col("_s"), F.lit("")), "term")).drop("_k", "_s", "mode")


def marked_good(entries: DataFrame, names: DataFrame) -> DataFrame:
    """entries of all books with ok_manual set where a message named them."""
    n = names.select(F.lower("name").alias("_k")).distinct().withColumn("_hit", F.lit(True))
    hit = F.coalesce("_hit", F.lit(False))
    return entries.withColumn("_k", F.lower("term")).join(n, "_k", "left").withColumn("ok_manual", hit | F.coalesce("ok_manual", F.lit(False))).drop("_k", "_hit")


def reopened(entries: DataFrame, names: DataFrame, forget: list[str]) -> DataFrame:
    """entries of all books with the columns of `forget` emptied where a message named them."""
    n = names.select(F.lower("name").alias("_k")).distinct().withColumn("_hit", F.lit(True))
    out = entries.withColumn("_k", F.lower("term")).join(n, "_k", "left")
    for c in forget:
        out = out.withColumn(c, F.when(F.col("_hit").isNull(), F.col(c)))
    return out.drop("_k", "_hit")


def hints_added(hints: DataFrame, new: DataFrame) -> DataFrame:
    """hints (name, spelling) and those of new that are not there yet, whatever their case; of equal new ones the first in
    the order of their letters."""
    fold = lambda c: F.lower(F.btrim(c))
    first = new.groupBy(fold("name").alias("_n"), fold("spelling").alias("_s")).agg(F.min(F.struct("name", "spelling")).alias("h")).where("_n <> '' AND _s <> ''")
    there = hints.select(fold("name").alias("_n"), fold("spelling").alias("_s")).distinct()
    return hints.select("name", "spelling").unionByName(first.join(there, ["_n", "_s"], "left_anti").select("h.*"))


def voice_problem(library: Column, in_library: Column, engine: Column, known: list[str], ready: list[str]) -> Column:
    """Why a voice cannot be used, or null: it left the library, its engine is unknown or not installed."""
    e = F.coalesce(engine, F.when(library.isNotNull(), "f5").otherwise("kokoro"))
    return (
        F.when(library.isNotNull() & ~F.coalesce(in_library, F.lit(False)), F.concat(library, F.lit(" is not in the library")))
        .when(~e.isin(known), F.concat(e, F.lit(" is not known"))).when(~e.isin(ready), F.concat(e, F.lit(" is not installed")))
    )


def engine_mix(cast: DataFrame, by: str, order: str, known: list[str]) -> DataFrame:
    """by, engines (known ones of its voices as they first come) and passes: two where both engines that cannot share a
    device are among them, one otherwise, none without an engine."""
    firsts = cast.where(F.col("engine").isin(known)).groupBy(by, "engine").agg(F.min(order).alias("at"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "engine"))), lambda x: x["engine"])
    out = cast.select(by).distinct().join(firsts.groupBy(by).agg(listed.alias("engines")), by, "left").withColumn("engines", F.coalesce("engines", F.expr("cast(array() as array<string>)")))
    both = F.array_contains("engines", "higgs") & F.array_contains("engines", "chatterbox")
    return out.withColumn("passes", F.when(F.size("engines") == 0, 0).when(both, 2).otherwise(1))


def pacing_tables(books: DataFrame, profiles: DataFrame, default: Column) -> DataFrame:
    """books (book, narrator) with the pauses of their narrator's profile (voice, kinds) and where they come from, else the
    default ones."""
    p = profiles.where(F.col("kinds").isNotNull() & (F.size("kinds") > 0)).select(F.col("voice").alias("narrator"), F.col("kinds").alias("_k"))
    return books.join(p, "narrator", "left").withColumn("origin", F.when(F.col("_k").isNull(), "default").otherwise(F.col("narrator"))).withColumn("kinds", F.coalesce("_k", default)).drop("_k")


def clip_table(clips: DataFrame, flags: DataFrame, overrides: DataFrame, made: DataFrame) -> DataFrame:
    """clips (file, key, ...) with flags (file, why, fixed; what was fixed is marked as remade and counts last), whether
    their text was corrected (overrides: key) and whether the file is there (made: file). Clips without a key are left out."""
    why = F.concat(F.array_join("why", ", "), F.when(F.col("fixed"), " (remade)").otherwise(""))
    f = flags.groupBy("file").agg(F.max_by(why, F.struct("fixed", why.alias("w"))).alias("flags"))
    yes = lambda rows, key, name: rows.select(key).distinct().withColumn(name, F.lit(True))
    out = clips.where(F.col("key").isNotNull()).join(f, "file", "left").join(yes(overrides, "key", "corrected"), "key", "left").join(yes(made, "file", "made"), "file", "left")
    return out.fillna({"flags": "", "corrected": False, "made": False})
