"""How text is spoken: abbreviations, numerals, substitutions, sounds."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StringType

from quirespark.functions import text as T

#: What is written, what is read, and where it counts: before a capital (name; dashed: a hyphen may
#: stand between), after a small letter (after), anywhere but with a comma or semicolon behind (stop), with a comma behind
#: taken in (comma), after a place (state; wide: after a comma or a full stop). Steps are taken in this order.
ABBREVIATIONS = [
    ("MM.", "Messieurs", "name"), ("Mme.", "Madame", "name"), ("Mme", "Madame", "name"), ("Mlle.", "Mademoiselle", "name"), ("M.", "Monsieur", "name"),
    ("Dr.", "Doctor", "name"), ("Mr.", "Mister", "name"), ("Mrs.", "Missus", "name"), ("St.", "Saint", "name"), ("Capt.", "Captain", "name"), ("Col.", "Colonel", "name"),
    ("Wm.", "William", "name"), ("Chas.", "Charles", "name"), ("Geo.", "George", "name"), ("Thos.", "Thomas", "name"), ("Jas.", "James", "name"), ("Jno.", "John", "name"),
    ("Hon.", "Honorable", "name"), ("Rev.", "Reverend", "name"), ("Messrs.", "Messieurs", "name"),
    ("Lieut.", "Lieutenant", "dashed"), ("Maj.", "Major", "dashed"), ("Brig.", "Brigadier", "dashed"), ("Prof.", "Professor", "name"), ("Gov.", "Governor", "name"),
    ("Jr.", "Junior", "after"), ("Sr.", "Senior", "after"), ("Esq.", "Esquire", "stop"),
    ("viz.", "namely,", "comma"), ("i.e.", "that is,", "comma"), ("e.g.", "for example,", "comma"), ("etc.", "et cetera", "stop"),
    ("W. Va.", "West Virginia", "wide"), ("Va.", "Virginia", "state"), ("Tenn.", "Tennessee", "state"), ("Mass.", "Massachusetts", "state"), ("Ga.", "Georgia", "state"), ("Ala.", "Alabama", "state"),
    ("Wis.", "Wisconsin", "state"), ("Conn.", "Connecticut", "state"), ("Pa.", "Pennsylvania", "state"), ("Ky.", "Kentucky", "state"), ("Mo.", "Missouri", "state"),
    ("Saml.", "Samuel", "name"), ("Benj.", "Benjamin", "name"), ("Gen.", "General", "name"),
]
#: Parts of a work, which a cardinal follows, and number words of headings.
DIVISIONS = ["Act", "Scene", "Chapter", "Book", "Part", "Canto"]
HEADING_NUMBERS = T.NUMBER_WORDS[1:] + ["twenty"]


def _steps(written: str, read: str, where: str) -> list[tuple[str, str]]:
    """Replacements for one abbreviation."""
    w = re.escape(written).replace(r"\ ", " ")
    return {
        "name": [(rf"\b{w}\s+(?=[A-Z])", f"{read} ")],
        "dashed": [(rf"\b{w}\s*-?\s*(?=[A-Z])", f"{read} ")],
        "after": [(rf"(?<=[a-z])\s+{w}", f" {read}")],
        "stop": [(rf"\b{w}(?=[,;])", read), (rf"\b{w}", f"{read}.")],
        "comma": [(rf"\b{w},?", read)],
        "state": [(rf"(?<=, ){w}", read)],
        "wide": [(rf"(?<=[,.] ){w}", read)],
    }[where]


def expand(text: Column) -> Column:
    """Abbreviations in full, then Roman numerals of two letters or more: a cardinal after Act, Scene, ..., an ordinal
    after another capitalised word. Null stays null."""
    plain = reduce(_written_out, ABBREVIATIONS, text)
    numeral = r"[IVXLC]{2,}(?![\p{L}\p{N}_])"

    def word(parts: Column, w: Column, i: Column) -> Column:
        sign = F.regexp_extract(w, f"^({numeral})", 1)
        before = F.regexp_extract(F.substring_index(F.get(parts, i - 1), " ", -1), r"(?<![\p{L}\p{N}_])([A-Z][a-z]+)$", 1)
        n = T.roman_value(F.when(sign == "", "I").otherwise(sign))
        read = T.bound(n, lambda n: F.when(before.isin(DIVISIONS), T.said(n)).otherwise(F.concat(F.lit("the "), T.said_ordinal(n))))
        return F.when(i == 0, w).when(before == "", w).otherwise(F.concat(read, F.substring(w, F.char_length(sign) + 1, F.char_length(w))))

    # the text is cut only before words that are numerals, and the cuts are made once
    return T.bound(F.split(plain, f" (?={numeral})", -1), lambda parts: F.when(parts.isNotNull(), F.array_join(F.transform(parts, lambda w, i: word(parts, w, i)), " ")))


def _written_out(text: Column, row: tuple[str, str, str]) -> Column:
    """text with one abbreviation in full. Most texts lack most abbreviations: these are only looked through for the letters."""
    steps = _steps(*row)
    return T.bound(text, lambda t: F.when(F.contains(t, F.lit(row[0])), reduce(lambda x, step: F.regexp_replace(x, step[0], step[1]), steps, t)).otherwise(t))


def _headed(x: Column) -> Column:
    """Words of a heading as they are read: without its last stops, words in capitals with one capital each."""
    return T.bound(x, _heading)


def _heading(x: Column) -> Column:
    whole = F.regexp_replace(F.regexp_replace(x, r"(?i)\bEsq\b\.?", "Esquire"), r"\.+$", "")
    begun = F.concat(F.upper(F.left(whole, F.lit(1))), F.substring(whole, F.lit(2), F.char_length(whole)))
    return T.bound(begun, _calm)


def _calm(begun: Column) -> Column:
    loud = (F.upper(begun) == begun) & (F.lower(begun) != begun)
    words = F.split(F.lower(begun), " ", -1)
    raised = lambda w: F.concat(F.regexp_extract(w, "^([^a-z]*)", 1), F.initcap(F.regexp_extract(w, "^[^a-z]*([a-z]?)", 1)), F.regexp_extract(w, "(?s)^[^a-z]*[a-z]?(.*)$", 1))
    small = lambda w, i: (i > 0) & F.regexp_replace(w, "^[“”\"'(]+|[“”\"'(]+$", "").isin(T.SMALL_WORDS)
    quiet = F.array_join(F.transform(F.split(begun, r"(?<![A-Za-z0-9_])(?=[A-Z]{2,}(?![A-Za-z0-9_]))|(?<=[A-Z]{2})(?![A-Za-z0-9_])", -1), lambda p: F.when(p.rlike("^[A-Z]{2,}$"), F.initcap(F.lower(p))).otherwise(p)), "")
    return F.when(loud, F.array_join(F.transform(words, lambda w, i: F.when(small(w, i), w).otherwise(raised(w))), " ")).otherwise(quiet)


def _digits_said(p: Column) -> Column:
    """Digits as a number in words; more than twelve of them one by one."""
    short = F.char_length(p) <= 12
    one_by_one = F.array_join(F.transform(F.split(p, "", -1), lambda d: F.get(F.array(*map(F.lit, T.NUMBER_WORDS)), F.when(d == "", F.lit(0)).otherwise(d).cast("int"))), " ")
    return F.when(short, T.said_long(F.when(short, p).otherwise("0"))).otherwise(one_by_one)


def _with_numbers(x: Column) -> Column:
    """Whole numbers in words."""
    pieces = F.split(x, r"(?<![\p{L}\p{N}_])(?=[0-9])|(?<=[0-9])(?![\p{L}\p{N}_])", -1)
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike("^[0-9]+$"), _digits_said(F.when(p.rlike("^[0-9]+$"), p).otherwise("0"))).otherwise(p)), "")


def _number(x: Column) -> Column:
    """A number of a heading (a word, digits or a Roman numeral) in words."""
    digits = x.rlike("^[0-9]+$")
    roman = T.said(T.roman_value(F.when(x.rlike("(?i)^[IVXLC]+$"), x).otherwise("I")))
    return F.when(F.lower(x).isin(HEADING_NUMBERS), F.lower(x)).when(digits, _digits_said(F.when(digits, x).otherwise("0"))).otherwise(roman)


def spoken_title(title: Column) -> Column:
    """A heading as it is read: numbers in words, a full stop after each part. Null stays null.

    A heading is numbered if its first word is a Roman numeral with a stop, or a division (part, chapter, book, section)
    whose second word is a number: digits, a Roman numeral, or a number word with the name of the division after it."""
    t = F.btrim(F.regexp_replace(title, r"\s+", " "))
    words = F.split(t, " ", -1)
    first, second, third = (F.coalesce(F.get(words, k), F.lit("")) for k in range(3))
    after = lambda k: F.array_join(F.slice(words, k + 1, F.greatest(F.size(words) - k, F.lit(0))), " ")
    roman = lambda w: F.regexp_replace(w, "[IVXLC]", "") == ""
    divided = F.lower(first).isin("book", "part", "chapter", "section")
    bare, count = F.regexp_replace(second, r"\.$", ""), F.regexp_extract(second, "^([0-9]+)", 1)
    named = (F.lower(second).isin(HEADING_NUMBERS) | (roman(F.upper(second)) & (second != ""))) & third.rlike("^\\w")
    tail = F.ltrim(F.regexp_replace(F.ltrim(F.concat(F.substring(second, F.char_length(count) + 1, F.char_length(second)), F.lit(" "), after(2))), r"^[:.\-–—]", ""))
    form = lambda head, number, rest: F.struct(head.alias("head"), number.alias("number"), rest.alias("rest"))
    found = (
        F.when(first.endswith(".") & roman(F.regexp_replace(first, r"\.$", "")) & (F.char_length(first) > 1) & (second != ""), form(F.lit(""), F.regexp_replace(first, r"\.$", ""), after(1)))
        .when(divided & named, form(first, second, after(2)))
        .when(divided & roman(bare) & (bare != "") & (F.size(words) == 2), form(first, bare, F.lit("")))
        .when(divided & (count != ""), form(first, count, F.rtrim(tail)))
    )

    def read(f: Column) -> Column:
        number = T.bound(_number(f["number"]), lambda n: F.when(f["head"] == "", F.concat(F.upper(F.left(n, F.lit(1))), F.substring(n, F.lit(2), F.char_length(n)))).otherwise(F.concat(T.capital(f["head"]), F.lit(" "), n)))
        return F.concat(number, F.lit("."), F.when(f["rest"] != "", F.concat(F.lit(" "), _headed(f["rest"]), F.lit("."))).otherwise(""))

    return F.when(title.isNull(), None).otherwise(F.coalesce(T.bound(found, lambda f: F.when(f.isNotNull(), read(f))), F.concat(_with_numbers(_headed(t)), F.lit("."))))


def _pieces(text: Column) -> Column:
    """Runs of letters and what stands between them, in turn."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"([{T.LETTER}]+|[^{T.LETTER}]+)"), 1)


def _folded(piece: Column) -> Column:
    return F.regexp_replace(F.lower(F.replace(piece, F.lit("’"), F.lit("'"))), r"\s+", " ")


#: So many terms go to the texts; of more terms, so many first words are looked for in them before anything is shuffled.
FIRST_WORDS = 10_000


@F.pandas_udf(ArrayType(BooleanType()))
def _free(at: pd.Series, less: pd.Series) -> pd.Series:
    """Of hits in the order of their places, longest first, those that begin where the last one taken has ended."""

    def taken(places: np.ndarray, sizes: np.ndarray) -> list[bool]:
        out, end = [], 0
        for place, size in zip(places.tolist(), sizes.tolist(), strict=True):
            out.append(place >= end)
            end = place - size if out[-1] else end
        return out

    return pd.Series([taken(a, b) for a, b in zip(at, less, strict=True)])


def chosen_terms(entries: DataFrame, mode: str, tested: DataFrame | None = None) -> DataFrame:
    """term and written of the lexicon entries (term, ipa, respell, respell_src, source) that count in a mode, for `substitute`.

    plain: none. ipa and rawipa: the sounds (with or without markup). respell: the spelling, or where there is none the one
    made from the sounds. typed: spellings that a user typed. checked: these, and those that a check found. verified:
    these, and the tested spellings (term, respell), which an entry's own spelling overrides."""
    said = lambda c: F.nullif(F.btrim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    own = entries.withColumns({"_respell": said("respell"), "_ipa": said("ipa"), "_src": F.coalesce("respell_src", F.lit(""))})
    typed = (F.col("_src") == "user") | ((F.col("_src") == "") & (F.coalesce("source", F.lit("")) == "user"))
    if mode in ("ipa", "rawipa"):
        rows = own.select("term", F.btrim("_ipa", F.lit("/")).alias("written"))
    elif mode == "respell":
        rows = own.select("term", F.lower(F.regexp_replace(F.coalesce("_respell", respell(F.coalesce("_ipa", F.lit("")))), "[-·‧]", "")).alias("written"))
    elif mode in ("typed", "checked", "verified"):
        rows = own.where(typed | ((F.col("_src") == "checked") if mode != "typed" else F.lit(False))).select("term", F.col("_respell").alias("written"))
        if mode == "verified" and tested is not None:
            key = lambda c: F.regexp_replace(F.lower(F.replace(F.col(c), F.lit("’"), F.lit("'"))), r"\s+", " ")
            mine = rows.where("written IS NOT NULL").select(key("term").alias("_k")).distinct()
            rows = rows.unionByName(tested.withColumn("_k", key("term")).join(mine, "_k", "left_anti").select("term", F.col("respell").alias("written")))
    elif mode == "plain":
        rows = own.select("term", F.col("_ipa").alias("written")).limit(0)
    else:
        raise ValueError(f"no mode {mode}")
    return rows.where("written IS NOT NULL AND written != ''")


def _replacer(terms: dict[tuple[str, int], str], markup: bool) -> Callable[[str | None], str | None]:
    """What puts terms, by phrase and number of pieces, into a text."""
    cut, blank = re.compile(f"([{T.LETTER}]+)"), re.compile(r"\s+", re.ASCII)
    heads, sizes = {cut.match(phrase)[0] for phrase, _ in terms}, sorted({n for _, n in terms}, reverse=True)

    def folded(pieces: list[str]) -> str:
        return "".join(blank.sub(" ", p.replace("’", "'").lower()) for p in pieces)

    def cased(was: str, new: str) -> str:
        if markup:
            return f"[{was}](/{new.strip('/')}/)"
        if len(was) > 1 and was.upper() == was:
            return new.upper()
        return new[:1].upper() + new[1:] if was[:1].lower() != was[:1] else new

    def put(text: str | None) -> str | None:
        if text is None:
            return None
        p, out, end = cut.split(text), [], 0  # words have the odd places
        for i in range(1, len(p), 2):
            if i >= end and p[i].lower() in heads:
                for n in sizes:
                    new = terms.get((folded(p[i : i + n]), n)) if i + n <= len(p) else None
                    if new is not None:
                        out += [*p[end:i], cased(blank.sub(" ", "".join(p[i : i + n])), new)]
                        end = i + n
                        break
        return "".join(out + p[end:])

    return put


def substitute(rows: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", text_col: str = "text", markup: bool = False) -> DataFrame:
    """rows with words and phrases of the lexicon (term, written) replaced.

    Texts are cut into words and what stands between them. Up to FIRST_WORDS terms go to the texts, which stay where they
    are; of a larger lexicon every run of pieces as long as some term meets the terms in an equi join. Where terms overlap the first place counts, and there the longest term;
    what was written is not looked at again. Capitals carry over; with markup the word stays, followed by its sound.
    Terms begin and end with a letter. Of terms that are equal but for case the one with the first `written` counts. A
    null text stays null; id_col must be unique. Without terms rows stay as they are.
    """
    terms = lexicon.where((F.col("written") != "") & F.col("term").rlike(f"^[{T.LETTER}]")).select(F.transform(_pieces(F.col("term")), _folded).alias("p"), "written")
    terms = terms.select(F.array_join("p", "").alias("_phrase"), F.size("p").alias("_size"), "written").groupBy("_phrase", "_size").agg(F.min("written").alias("_written"))
    few = terms.limit(FIRST_WORDS + 1).collect()
    if not few:
        return rows
    if len(few) <= FIRST_WORDS:
        known, at = {(r["_phrase"], r["_size"]): r["_written"] for r in few}, rows.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            put = _replacer(known, markup)
            for batch in (b.slice(k, 64) for b in batches for k in range(0, len(b), 64)):
                done = pa.array(map(put, batch.column(at).to_pylist()), pa.string())
                yield pa.RecordBatch.from_arrays([done if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

        return rows.mapInArrow(run, rows.schema)
    lengths = [r[0] for r in terms.select("_size").distinct().orderBy("_size").collect()]  # pieces of a phrase: a handful
    own = rows.withColumn("_p", _pieces(F.col(text_col)))
    folded = own.select(id_col, F.transform("_p", _folded).alias("_f"))
    # only runs that begin as some term does are sent to the join; a lexicon of very many first words looks at all
    heads = [r[0] for r in terms.select(F.regexp_extract("_phrase", f"^([{T.LETTER}]+)", 1)).distinct().limit(FIRST_WORDS + 1).collect()]

    def runs(n: int) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size("_f") - n, F.lit(0)))
        if len(heads) <= FIRST_WORDS:
            places = F.filter(places, lambda i: F.get("_f", i).isin(heads))
        run = lambda i: F.struct(i.alias("_at"), F.lit(n).alias("_size"), F.array_join(F.slice("_f", i + 1, n), "").alias("_phrase"))
        return F.transform(places, run)

    found = folded.select(id_col, F.inline(F.flatten(F.array(*map(runs, lengths))))).join(terms, ["_phrase", "_size"])
    found = found.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("_at", (-F.col("_size")).alias("_less"), "_written"))).alias("_hits"))
    end = lambda h: h["_at"] - h["_less"]
    found = found.withColumn("_free", _free("_hits._at", "_hits._less")).withColumn("_hits", F.filter("_hits", lambda h, i: F.get("_free", i))).drop("_free")
    joined = own.join(found, id_col, "left")

    def put(h: Column, i: Column) -> Column:
        after = F.coalesce(end(F.get("_hits", i - 1)), F.lit(0))
        was = F.regexp_replace(F.array_join(F.slice("_p", h["_at"] + 1, -h["_less"]), ""), r"\s+", " ")
        new, one = h["_written"], F.left(was, F.lit(1))
        if markup:
            new = F.concat(F.lit("["), was, F.lit("](/"), F.btrim(new, F.lit("/")), F.lit("/)"))
        else:
            raised = F.concat(F.upper(F.left(new, F.lit(1))), F.substring(new, F.lit(2), F.char_length(new)))
            new = F.when((F.char_length(was) > 1) & (F.upper(was) == was), F.upper(new)).when(F.lower(one) != one, raised).otherwise(new)
        return F.concat(F.array_join(F.slice("_p", after + 1, h["_at"] - after), ""), new)

    last = F.coalesce(end(F.try_element_at("_hits", F.lit(-1))), F.lit(0))
    rest = F.array_join(F.slice("_p", last + 1, F.size("_p") - last), "")
    done = F.when(F.col("_hits").isNull(), F.col(text_col)).otherwise(F.concat(F.array_join(F.transform("_hits", put), ""), rest))
    return joined.select(*(done.alias(c) if c == text_col else F.col(c) for c in rows.columns))


#: Spellings of vowels and consonants, and clusters that may begin a syllable.
VOWEL_SPELLING = {"a": "ah", "ɑ": "ah", "æ": "a", "ɛ": "eh", "e": "ay", "i": "ee", "ɪ": "ih", "ɔ": "aw", "o": "oh", "u": "oo", "ʊ": "uu", "y": "ew", "ø": "er", "œ": "er", "ə": "uh", "ɜ": "er", "ʌ": "uh", "ɐ": "uh", "ɒ": "o", "ᵻ": "ih", "ɚ": "er"}
PAIR_SPELLING = {"eɪ": "ay", "aɪ": "eye", "oʊ": "oh", "əʊ": "oh", "aʊ": "ow", "ɔɪ": "oy", "ɜɹ": "er", "ɑɹ": "ar", "ɔɹ": "or", "ɛɹ": "air", "ɪɹ": "eer", "ʊɹ": "oor", "ɐɹ": "ar"}
CONSONANT_SPELLING = {"ʁ": "r", "ɹ": "r", "ɾ": "r", "ʃ": "sh", "ʒ": "zh", "ŋ": "ng", "θ": "th", "ð": "dh", "j": "y", "ɡ": "g", "x": "kh", "ɲ": "ny", "ʎ": "ly", "ç": "h", "ɣ": "g", "ʧ": "ch", "ʤ": "j", "w": "w", "ɫ": "l", "tʃ": "ch", "dʒ": "j"}
ONSETS = {"pl", "bl", "kl", "gl", "fl", "sl", "pr", "br", "tr", "dr", "kr", "gr", "fr", "θr", "ʃr", "sp", "st", "sk", "sm", "sn", "sw", "tw", "kw", "dw", "str", "spr", "skr", "spl", "skw"}
ENGINE_LETTERS = {"A": "eɪ", "I": "aɪ", "O": "oʊ", "Q": "əʊ", "W": "aʊ", "Y": "ɔɪ", "ᵊ": "ə", "T": "t"}
_PHONE = re.compile("|".join(sorted(["ˈ", "̃", *PAIR_SPELLING, "tʃ", "dʒ"], key=len, reverse=True)) + "|[^ˌːˑ͡‿.]")


def respelled(ipa: str) -> str:
    """Sounds as English readers would spell them: syllables with hyphens, the stressed one in capitals."""
    if any(c in "AIOQWYT" for c in ipa):
        ipa = "".join(ENGINE_LETTERS.get(c, c) for c in ipa)
    return " ".join(_respelled_word(w) for w in ipa.strip("/").split())


def _respelled_word(word: str) -> str:
    shape, spelt, stress, loud = "", [], [], False
    for phone in _PHONE.findall(word):
        if phone == "ˈ":
            loud = True
        elif phone == "̃":
            if shape.endswith("V"):
                shape, spelt, stress = shape + "C", [*spelt, "n"], [*stress, False]
        elif phone in PAIR_SPELLING or phone in VOWEL_SPELLING:
            shape, spelt, stress = shape + "V", [*spelt, PAIR_SPELLING.get(phone) or VOWEL_SPELLING[phone]], [*stress, loud]
            loud = False
        else:
            shape, spelt, stress = shape + "C", [*spelt, CONSONANT_SPELLING.get(phone, phone)], [*stress, False]
    nuclei = [m.start() for m in re.finditer("V", shape)]
    edges = [0]
    for left, right in zip(nuclei, nuclei[1:], strict=False):  # where the next syllable begins between two vowels
        between = right - left - 1
        longest = next((n for n in (3, 2) if between >= n and "".join(spelt[right - n : right]) in ONSETS), min(1, between))
        edges.append(right - longest)
    parts = [("".join(spelt[a:b]), any(stress[a:b])) for a, b in zip(edges, [*edges[1:], len(spelt)], strict=True)]
    return "-".join(p.upper() if on and len(parts) > 1 else p for p, on in parts if p)


@F.pandas_udf(StringType())
def respell(ipa: pd.Series) -> pd.Series:
    return ipa.map(lambda x: None if x is None else respelled(x))


#: Sounds that count as the same when one is compared with what was heard.
SAME_SOUND = {"tʃ": "ʧ", "dʒ": "ʤ", "oʊ": "o", "əʊ": "o", "eɪ": "e", "ɹ": "r", "ɾ": "t", "ɝ": "ər", "ɚ": "ər", "ɐ": "ə", "ɜ": "ə", "ʌ": "ə", "ɨ": "ɪ", "ᵻ": "ɪ", "ɑ": "a", "ɒ": "a", "ɔ": "o", "ɛ": "e", "æ": "e", "ʊ": "u", "ɫ": "l", "ɡ": "g", "ɵ": "θ", "ɬ": "l", "ʔ": "", "ʰ": "", "ʲ": "", "ˠ": "", "ᵊ": "ə"}
_VOWELS = set("aeiouəɪʊɔɜ")


def sounds(ipa: str) -> list[str]:
    bare = re.sub(r"[ˈˌːˑ͡‿.\s,;'ʼ·‧\-̩̯̃]", "", ipa)
    folded = re.sub("|".join(sorted(SAME_SOUND, key=len, reverse=True)), lambda m: SAME_SOUND[m[0]], bare)
    return [c for i, c in enumerate(folded) if not (i and c == folded[i - 1] and c in _VOWELS)]


def best_fit(change: np.ndarray, drop: np.ndarray, add: np.ndarray) -> float:
    """The least cost of finding a target anywhere in what was heard: change[i, j] turns target i into heard j, drop[i]
    leaves out target i, add[j] lets heard j in between. What was heard before and after costs nothing."""
    ahead = np.concatenate([[0.0], np.cumsum(add)])
    row = np.zeros(len(ahead))
    for costs, gone in zip(change, drop, strict=True):
        way = row + gone
        way[1:] = np.minimum(way[1:], row[:-1] + costs)
        row = ahead + np.minimum.accumulate(way - ahead)
    return float(row.min())


def heard_score(target: str, heard: str) -> float:
    """1 where what was heard holds the target's sounds, less for each change; the ends of what was heard are free."""
    a, b = sounds(target), sounds(heard)
    if not a:
        return 0.0
    skip = lambda s: np.array([0.5 if x in "əɪhr" else 1.0 for x in s])
    vowel = lambda s: np.array([x in _VOWELS for x in s], bool)
    same = np.array(a)[:, None] == np.array(b, dtype="U1")[None, :]
    change = np.where(same, 0.0, np.where(vowel(a)[:, None] & vowel(b)[None, :], 0.5, 1.0))
    return max(0.0, 1 - best_fit(change, skip(a), skip(b)) / skip(a).sum())


@F.pandas_udf(DoubleType())
def sound_score(target: pd.Series, heard: pd.Series) -> pd.Series:
    return pd.Series([heard_score(t or "", h or "") for t, h in zip(target, heard, strict=True)])
