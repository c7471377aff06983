"""Text functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters as the queries mean them, in both engines (fixed value).
LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
WORD = f"[{LETTER}]+"
SMALL_WORDS = ["a", "an", "and", "as", "at", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with"]
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
ORDINALS = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}


#: What a line of its own that heads a chapter begins with, and what else begins lines like it.
HEADED_BY = "chapter book part section letter canto".split()
LOOSELY_HEADED_BY = "chapter book part".split()
COUNTED = rf"(?:[0-9]{{1,4}}|[IVXLC]{{1,7}}|(?:{'|'.join([*NUMBER_WORDS[1:], 'twenty'])})[\w-]*)"


def heads_chapter(line: Column) -> Column:
    """Whether a line is a heading such as `Chapter XV. The Sea`: short, and not ending as running text does."""
    shape = line.rlike(rf"(?iU)^[ \t]*(?:{'|'.join(HEADED_BY)})[ \t]+{COUNTED}\b.{{0,92}}$")
    bare = F.btrim(line, F.lit(" \t"))
    return shape & (F.char_length(bare) <= 110) & ~bare.rlike("[,;]$") & (F.size(F.split(bare, r"\s+")) <= 18)


def may_head_chapter(line: Column) -> Column:
    """Whether a line begins as headings do, if it is one or not."""
    return line.rlike(rf"(?iU)^\s*(?:{'|'.join(LOOSELY_HEADED_BY)})\s+[\w.]+")


def say(n: int) -> str:
    """A number in words."""
    for size, name in ((10**9, "billion"), (10**6, "million"), (1000, "thousand")):
        if n >= size:
            left = n % size
            return f"{say(n // size)} {name}" + (f"{' and ' if left < 100 else ', '}{say(left)}" if left else "")
    if n < 20:
        return NUMBER_WORDS[n]
    if n < 100:
        return TENS[n // 10 - 2] + ("-" + NUMBER_WORDS[n % 10] if n % 10 else "")
    return f"{NUMBER_WORDS[n // 100]} hundred" + (f" and {say(n % 100)}" if n % 100 else "")


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value worked out once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), 0)


def said(n: Column) -> Column:
    """0 to 999 999 in words, as say() has them."""
    return bound(n.cast("int"), _said)


def said_long(n: Column) -> Column:
    """0 to 999 999 999 999 in words, as say() has them."""

    def over(size: int, name: str, rest: Callable[[Column], Column]) -> Callable[[Column], Column]:
        def run(n: Column) -> Column:
            left = F.pmod(n, F.lit(size))
            more = F.when(left == 0, "").otherwise(F.concat(F.when(left < 100, " and ").otherwise(", "), bound(left, rest)))
            return F.when(n < size, bound(left, rest)).otherwise(F.concat(said(F.floor(n / size)), F.lit(f" {name}"), more))

        return run

    return bound(n.cast("long"), over(10**9, "billion", over(10**6, "million", said)))


def _said(n: Column) -> Column:
    words = F.array(*[F.lit(w) for w in NUMBER_WORDS])
    tens = F.array(*[F.lit(w) for w in TENS])
    over = lambda n, k: F.floor(n / k).cast("int")
    rest = lambda n, k: F.pmod(n, F.lit(k)).cast("int")

    def to_99(n: Column) -> Column:
        low = F.when(rest(n, 10) > 0, F.concat(F.lit("-"), F.get(words, rest(n, 10)))).otherwise("")
        return F.when(n < 20, F.get(words, n.cast("int"))).otherwise(F.concat(F.get(tens, over(n, 10) - 2), low))

    def to_999(n: Column) -> Column:
        low = F.when(rest(n, 100) > 0, F.concat(F.lit(" and "), to_99(rest(n, 100)))).otherwise("")
        return F.when(n < 100, to_99(n)).otherwise(F.concat(F.get(words, over(n, 100)), F.lit(" hundred"), low))

    link = F.when(rest(n, 1000) < 100, " and ").otherwise(", ")
    low = F.when(rest(n, 1000) > 0, F.concat(link, bound(rest(n, 1000), to_999))).otherwise("")
    return F.when(n < 1000, to_999(n)).otherwise(F.concat(bound(over(n, 1000), to_999), F.lit(" thousand"), low))


def said_ordinal(n: Column) -> Column:
    """The ordinal of a number in words: its last word changes."""
    special = F.create_map(*[F.lit(x) for kv in ORDINALS.items() for x in kv])
    regular = lambda w: F.when(F.endswith(w, F.lit("y")), F.concat(F.regexp_replace(w, "y$", ""), F.lit("ieth"))).otherwise(F.concat(w, F.lit("th")))
    last = lambda w: F.coalesce(F.element_at(special, w), regular(w))
    return bound(said(n), lambda full: F.concat(F.regexp_replace(full, "[a-z]+$", ""), bound(F.regexp_extract(full, "([a-z]+)$", 1), last)))


def roman_value(numeral: Column) -> Column:
    """The value of a numeral of the letters I, V, X, L and C; a letter before a larger one is taken off."""
    values = F.transform(F.split(F.translate(F.upper(numeral), "IVXLC", "01234"), "", -1), lambda d: F.get(F.array(*map(F.lit, (1, 5, 10, 50, 100))), d.cast("int")))
    # from the right: a letter counts against the largest so far
    step = lambda acc, v: F.struct(F.when(v < acc["top"], acc["sum"] - v).otherwise(acc["sum"] + v).alias("sum"), v.alias("top"))
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("top"))
    return F.aggregate(F.reverse(values), start, step, lambda acc: acc["sum"])


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def clean(text: Column) -> Column:
    """Without carriage returns, lines that are only a page number, and doubled blanks."""
    t = F.regexp_replace(text, "\r", "")
    t = F.regexp_replace(t, r"(?m)^[ \t]*[0-9]{3,4}[ \t]*$", "")
    t = F.regexp_replace(t, r"[ \t]{2,}|\t", " ")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.btrim(t, F.lit(" \n"))


def tidy_stops(text: Column) -> Column:
    """No space before a stop; one between a stop and the next letter stays as it is."""
    return F.regexp_replace(text, r"[ \t]+([,.;:!?])", "$1")


#: Short forms whose stop ends no sentence.
SHORT_FORMS = "mr mrs ms dr gen col capt lieut lt maj brig sgt st mt ft vs no jr sr prof hon rev messrs gov sen rep esq etc viz wm geo chas jno thos".split()


def sentences(text: Column) -> Column:
    """Sentences: cut after . ! or ? and a closing quote, where white space and a capital or a digit follow, with or without
    an opening quote. The stop of a short form or of a single letter ends none."""
    short = rf"(?<![{LETTER}])(?:(?i:{'|'.join(SHORT_FORMS)})|[{LETTER}])\."
    # a sign that the text has itself is a cut like those that are put in
    own = F.when(F.contains(text, F.lit("\u0001")), F.regexp_replace(text, rf"({short}\s+)\u0001", "$1")).otherwise(text)
    # most places are no white space, which is looked for first
    marked = F.regexp_replace(own, rf"(?=\s)((?:(?<=[.!?])(?<!{short})|(?<=[.!?][\"”’']))\s+)(?=[\"“‘'(]?[A-Z0-9])", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001", -1), lambda s: F.btrim(s, F.lit(" \t\n\u000b\f\r"))), lambda s: s != "")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)


def capital(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, F.lit(2), F.char_length(word))))


def title_case(title: Column) -> Column:
    """A heading in capitals (at most 12 words, at least 3 letters) in title case; any other as it is."""
    trimmed = F.btrim(title)
    parts = F.split(trimmed, " ", -1)

    def word(w: Column, i: Column) -> Column:
        numeral = w.rlike(r"^[IVXLCDM]+\.?$")
        opens = (i == 0) | F.get(parts, i - 1).rlike(r"[.:]$")
        small = F.lower(w).isin(SMALL_WORDS) & ~opens
        return F.when(numeral, w).when(small, F.lower(w)).otherwise(capital(w))

    heading = (F.upper(trimmed) == trimmed) & (F.size(parts) <= 12) & (F.char_length(F.regexp_replace(trimmed, "[^A-Za-z]", "")) >= 3)
    return F.when(heading, F.array_join(F.transform(parts, word), " ")).otherwise(trimmed)


def looks_like_contents(text: Column) -> Column:
    """At least six lines, nine in ten of them short and without the end of a sentence."""
    full = F.filter(F.transform(lines(text), lambda x: F.btrim(x)), lambda x: x != "")
    short = F.filter(full, lambda x: (F.char_length(x) <= 50) & ~x.rlike("[.?!”\"’]$"))
    return (F.size(full) >= 6) & (F.size(short) >= 0.9 * F.size(full))


def pauses_in(text: Column) -> Column:
    """Dashes and ellipses, at which a voice rests."""
    return F.regexp_count(text, F.lit(r"—|–|\.\.\.|…| - "))


def spoken_chars(text: Column) -> Column:
    """Length of what is heard: [word](/sounds/) counts as the word."""
    return F.char_length(F.regexp_replace(text, r"\[([^\]]*)\]\(/[^)]*/\)", "$1"))
