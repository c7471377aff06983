"""Texts that a file's layout has spoilt for a voice, set right with the rest of the book as evidence.

First the words that are written in capitals are gathered, distinct for each chapter, and joined to what the book and a
list of frequencies say of them; then every chapter is put right by what is known of its own words. So a chapter carries a
list of its shouted words, never the names of all books. Catalyst marks the words; a long chapter has too many to look each
up in a list, so that is done in Python."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirespark.functions import text as T
from quirespark.operators import lexicon
from quirespark.shared import freeze, partitions

#: Short forms that stay in capitals; numerals; what is no part of a book.
KEPT = "USA CSA YMCA NAACP AME KJV NASB BBC UFO DNA TNT NASA FBI CIA NATO UNESCO OPEC AIDS USSR CEO HTML PDF".split()
NUMERAL = "^[IVXLCDM]+$"
CRUFT = r"(?is)^\s*(?:Note from the original file\b.*|(?:Table of )?Contents\s*|Transcriber.s Note:?\s*)$"
#: A letter parted from its word; words in capitals that stand together, or alone.
PARTED = r"\b([B-HJ-Z]) ([A-Z]{2,})\b"
_HAS_PARTED = r"(?= [A-Z])(?<=\b[B-HJ-Z]) [A-Z]{2,}\b"  # sought by its blank: most texts have none
SHOUTED = r"\b(?:[A-Z]{2,}+\b(?: ++[A-Z]{2,}+\b)++|[A-Z]{3,}\b)"  # possessive: long runs need no stack
_HERE, _END = "\u0001", "\u0002"
_KEPT, _NUMERAL = frozenset(KEPT), re.compile(NUMERAL)
#: What is known of the words of a chapter is one text, each between blanks; the sign before a word says how: a name, one of frequency 2.5 and more, or of 2 and more.
NAME, COMMON, KNOWN = "n", "c", "k"
#: Rows of a lookup for each shuffle partition that are held as a hash table (about 30 MB).
HASHED = 1 << 18


def _capital(word: Column) -> Column:
    return F.concat(F.upper(F.left(word, F.lit(1))), F.lower(F.substring(word, F.lit(2), F.char_length(word))))


def _marked(text: Column, pattern: str) -> Column:
    """text with a sign before and one after each match of the pattern."""
    return F.regexp_replace(F.translate(text, _HERE + _END, ""), f"({pattern})", f"{_HERE}$1{_END}")


def shouted_words(chapters: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """key and word: the distinct words in capitals of each chapter, in small letters, also those of which a letter is parted."""
    joined = F.transform(F.regexp_extract_all(text, F.lit(f"({PARTED})"), 1), lambda w: F.replace(w, F.lit(" "), F.lit("")))
    words = F.concat(F.when(F.col(text).rlike(_HAS_PARTED), joined).otherwise(F.array().cast("array<string>")), F.regexp_extract_all(text, F.lit(r"\b([A-Z]{2,})\b"), 1))
    return chapters.select(*key, F.explode(F.transform(F.array_distinct(words), F.lower)).alias("word"))


def without_cruft(text: Column) -> Column:
    """A text without the paragraphs that are no part of the book: notes of the file, of transcribers, a line `Contents`."""
    return F.array_join(F.filter(F.split(text, r"\n\s*\n", -1), lambda p: ~F.btrim(p, F.lit(" \n\t")).rlike(CRUFT)), "\n\n")


def esquire(text: Column) -> Column:
    """Esq. in full; its stop stays where a sentence ends with it."""
    ended = F.regexp_replace(text, r"(?i)\bEsq\b\.(?=\s*\z|\s{3}|\n|(?-i:\s{0,2}[\"“‘'(]?[A-Z]))", "Esquire.")
    return F.regexp_replace(ended, r"(?i)\bEsq\b(?:\.(?!$))?", "Esquire")


def _headings(text: Column) -> Column:
    """Paragraphs that are a short line in capitals in title case, others as they are."""
    return F.array_join(F.transform(F.split(text, r"\n\s*\n", -1), lambda p: T.bound(T.title_case(p), lambda t: F.when(t != F.btrim(p), t).otherwise(p))), "\n\n")


def _joined(text: Column, known: Column) -> Column:
    """text with the letters that are parted from names and common words joined to them."""

    def part(p: Column, i: Column) -> Column:
        found, rest = F.substring_index(p, _END, 1), F.substring_index(p, _END, -1)
        word = F.replace(found, F.lit(" "), F.lit(""))
        told = functools.reduce(Column.__or__, (F.contains(known, F.concat(F.lit(f" {how}"), F.lower(word), F.lit(" "))) for how in (NAME, COMMON)))
        return F.when(i == 0, p).otherwise(F.concat(F.when(told, _capital(word)).otherwise(found), rest))

    whole = lambda t: F.array_join(F.transform(F.split(_marked(t, PARTED), _HERE, -1), part), "")
    return T.bound(F.translate(text, _HERE + _END, ""), lambda t: F.when(t.rlike(_HAS_PARTED), whole(t)).otherwise(t))


def _calmed(marked: str, known: str) -> str:
    """A text whose words in capitals are marked, with these made small by what is known of them."""
    told, forms = {e[1:].upper(): e[0] for e in known.split()}, {}

    def form(w: str) -> tuple[str, bool]:
        """A word of a run, and whether it is a plain one."""
        if w == "" or w in _KEPT or _NUMERAL.match(w):
            return w, False
        how = told.get(w)
        if how == NAME:
            return w[0] + w[1:].lower(), False
        return (w, False) if len(w) >= 3 and how is None else (w.lower(), True)

    def calm(found: str, before: str) -> str:
        if " " not in found:
            return found if found not in told or found in _KEPT or _NUMERAL.match(found) else found[0] + found[1:].lower()
        words = found.split(" ")
        for w in words:
            if w not in forms:
                forms[w] = form(w)
        done = [forms[w][0] for w in words]
        if forms[words[0]][1] and starts(before.replace(_END, "")[-6:]):
            done[0] = words[0][0] + words[0][1:].lower()
        return " ".join(done)

    def starts(before: str) -> bool:
        return before.strip(" \t\n") == "" or before[-1] in "“\"‘'(" or before.rstrip(" \t")[-1] in ".!?:\n"

    parts = marked.split(_HERE)
    out = parts[:1]
    for before, part in pairwise(parts):
        found, _, rest = part.partition(_END)
        out += (calm(found, before), rest)
    return "".join(out)


def _met(words: DataFrame, lookup: DataFrame, on: list[str], how: str) -> DataFrame:
    """words joined to a frozen table whose keys are unique. Of few rows a task makes a hash table; only for more are the
    words sorted, of which there are many more."""
    few = lookup.count() <= HASHED * partitions(lookup.sparkSession)
    return words.join(lookup.hint("shuffle_hash") if few else lookup, on, how)


def repaired(chapters: DataFrame, frequencies: DataFrame, book: str = "book", chapter: str = "chapter", text: str = "text", names: DataFrame | None = None, titles: bool = True) -> DataFrame:
    """chapters with the text put right: names split into pieces (D OUGLASS) joined, shouted words small (names and the
    first word of a sentence keep their capital, short forms and numerals all), headings in title case, Esq. in full (unless
    `titles` is false: in a text whose stops are gone those letters may be any word), no space before a stop, and without the paragraphs that are no part of the book.

    A word is a name if its book writes it with a capital within a sentence somewhere (`names`: book and word, in small
    letters; found in the chapters themselves if not given). frequencies (word, lang, zipf) says how common a word is in
    English; a word of three letters or more that is neither a name nor known stays in capitals. Null texts stay null,
    empty ones empty. A chapter's key must be unique."""
    key = [book, chapter]
    own = names if names is not None else lexicon.mid_sentence_capitals(chapters, book, text)
    own = freeze(own.select(book, "word").distinct(), "names")
    rank = freeze(frequencies.where("lang = 'en' AND zipf >= 2").groupBy("word").agg(F.max("zipf").alias("zipf")), "frequencies")
    words = shouted_words(chapters, key, text)
    common = _met(_met(words, own, [book, "word"], "left_anti"), rank, ["word"], "inner")
    named = _met(words, own, [book, "word"], "left_semi").select(*key, F.concat(F.lit(NAME), "word").alias("e"))
    told = named.unionByName(common.select(*key, F.concat(F.when(F.col("zipf") >= 2.5, COMMON).otherwise(KNOWN), "word").alias("e")))
    # chapters of few bytes and much work are dealt to a set number of parts; their words meet there, not before
    dealt = lambda rows: rows.repartition(partitions(rows.sparkSession), *key)
    told = dealt(told).groupBy(*key).agg(F.concat(F.lit(" "), F.array_join(F.collect_list("e"), " "), F.lit(" ")).alias("_known"))
    known = F.coalesce("_known", F.lit(""))
    at = chapters.columns.index(text)
    loud = dealt(chapters).join(told, key, "left").select(*(_marked(_headings(_joined(without_cruft(F.col(text)), known)), SHOUTED).alias(c) if c == text else F.col(c) for c in chapters.columns), known.alias("_known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 64) for b in batches for k in range(0, len(b), 64)):
            calm = pa.array([t and _calmed(t, e) for t, e in zip(batch.column(at).to_pylist(), batch.column(-1).to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([calm if i == at else c for i, c in enumerate(batch.columns[:-1])], names=batch.schema.names[:-1])

    rows = loud.mapInArrow(run, chapters.schema)
    calm = esquire(F.col(text)) if titles else F.col(text)
    # most places are no blank, which is looked for first
    stops = F.regexp_replace(calm, "(?= )(?<=[A-Za-z0-9”’\"')]) +([,;:!?])", "$1")
    stops = F.regexp_replace(stops, f"(?= )(?<=[{T.LETTER}0-9]) +\\.(?=\\s|\\z|[”’\"'])", ".")
    return rows.select(*(stops.alias(c) if c == text else F.col(c) for c in chapters.columns))
