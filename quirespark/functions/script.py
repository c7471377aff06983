"""Script functions as column expressions: questions, quotes, commands, keys, formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that open a question, and their subjects.
AUXILIARIES = (
    "is are was were am art do does did dost didst can could canst will wilt would shall shalt should may might must has have had hast hath "
    "isn't aren't wasn't weren't don't doesn't didn't can't won't wouldn't shouldn't couldn't haven't hasn't ain't"
).split()  # typed apostrophes count as these
QUESTION_WORDS = "who whom whose what where when why how which".split()
SUBJECTS = "you thou ye he she it they we i there this that these those the a an my your thy his her our their".split()
PRONOUNS = "you thou ye he she it they we i".split()
#: Verbs of speech.
SPEECH_VERBS = "said asked replied answered cried exclaimed whispered shouted returned added inquired continued observed remarked muttered murmured".split()
#: Languages of dictionary sections, and symbols written in more than one way.
COMPASS = {"N": "north", "S": "south", "E": "east", "W": "west"}


def looks_like_question(sentence: Column) -> Column:
    """Whether a sentence has the form of a question: an auxiliary and a subject, or a question word soon followed by an
    auxiliary without a pronoun before it."""
    bare = F.ltrim(F.replace(sentence, F.lit("’"), F.lit("'")), F.lit("\"“‘'([ "))
    raw = F.slice(F.regexp_extract_all(bare, F.lit(r"([\p{L}\p{N}_']+)"), 1), 1, 5)
    w = lambda i: F.lower(F.get(raw, i))
    asks = w(0).isin(AUXILIARIES) & (w(1).isin(SUBJECTS) | F.get(raw, 1).rlike(r"^\p{Lu}"))
    later = F.lit(False)
    for k in (1, 2, 3):
        clear = reduce(lambda a, j: a & ~w(j).isin(PRONOUNS), range(1, k), F.lit(True))
        later = later | (w(k).isin(AUXILIARIES) & clear)
    return F.coalesce((F.size(raw) >= 2) & (asks | (w(0).isin(QUESTION_WORDS) & later)), F.lit(False))


def with_question_mark(sentence: Column) -> Column:
    """The last mark of a sentence made a question mark; quotes after it stay."""
    return F.regexp_replace(F.rtrim(sentence), "(?s)^(.*?)[.…]*([\"”’')\\]]*)$", "$1?$2")


def quotes(text: Column) -> Column:
    """What stands between double quotes."""
    return F.regexp_extract_all(text, F.lit("[“\"]([^”\"]+)[”\"]"), 1)


def named_speaker(text: Column) -> Column:
    """The name next to a verb of speech after a quote: said Anna, or Anna said; null if there is none."""
    verbs = "|".join(SPEECH_VERBS)
    after = F.regexp_extract(text, rf"[”\"][,.]?\s+(?:{verbs})\s+([A-Z][a-z]+)", 1)
    before = F.regexp_extract(text, rf"[”\"][,.]?\s+([A-Z][a-z]+)\s+(?:{verbs})\b", 1)
    lead = F.regexp_extract(text, rf"\b([A-Z][a-z]+)\s+(?:{verbs})[,:]\s+[“\"]", 1)
    return F.when(after != "", after).when(before != "", before).when(lead != "", lead)


def fragments(gap: Column, most: int = 140) -> Column:
    """The first and the last sentence of what lies between two quotes."""
    parts = F.filter(F.split(gap, r"(?<=[.!?])\s+", -1), lambda x: F.btrim(x) != "")
    return F.struct(F.left(F.coalesce(F.get(parts, 0), F.lit("")), F.lit(most)).alias("first"), F.right(F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")), F.lit(most)).alias("last"))


def command(text: Column) -> Column:
    """What a message asks for: suggest, good, start, send, stop, current, queue, done, help, or null."""
    bare = F.regexp_replace(F.lower(F.btrim(text)), "[.!?]+$", "")
    return (
        F.when(bare.rlike(r"^[^|\n]+\|[^|\n]+$"), "suggest").when(bare.rlike(r"^good\s+\S"), "good").when(bare.rlike(r"^now\s+#?[0-9]+$"), "start")
        .when(bare.rlike(r"^send(\s+.+)?$"), "send").when(bare == "stop", "stop").when(bare.isin("current", "status"), "current")
        .when(bare == "queue", "queue").when(bare.isin("done", "finished"), "done").when(bare == "help", "help")
    )


def clock(seconds: Column) -> Column:
    """Hours and minutes, or minutes and seconds below an hour."""
    s = F.floor(seconds).cast("long")
    return F.when(s >= 3600, F.format_string("%dh %02dm", F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60))).otherwise(F.format_string("%dm %02ds", F.floor(s / 60), F.pmod(s, F.lit(60))))


def stars(n: Column) -> Column:
    """A rating of 0 to 5."""
    return F.concat(F.repeat(F.lit("★"), n), F.repeat(F.lit("☆"), 5 - n))


def pretty(stem: Column) -> Column:
    """A file stem as a title."""
    return F.initcap(F.btrim(F.regexp_replace(stem, "[-_]+", " ")))


def slug(name: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))


def voice_key(kind: Column, name: Column, engine: Column) -> Column:
    """kind:name@engine, without @engine where there is none."""
    return F.concat(kind, F.lit(":"), name, F.when(engine.isNull() | (engine == ""), "").otherwise(F.concat(F.lit("@"), engine)))


def voice_of(key: Column) -> Column:
    """The parts of a voice key."""
    part = lambda k: F.nullif(F.regexp_extract(key, r"^([^:@]+):([^@]*)(?:@(.*))?$", k), F.lit(""))
    return F.struct(part(1).alias("kind"), part(2).alias("name"), part(3).alias("engine"))


def looks_like_sounds(s: Column) -> Column:
    """Whether a string is written in phonetic signs: at least one sign beyond ASCII letters, nothing but such signs."""
    return s.rlike("^[a-zæçðøħŋœɐ-ʯˈˌːˑ.‿̃͡ θβχ-]+$") & s.rlike("[æçðøħŋœɐ-ʯˈˌːθβχ]")


def free_licence(name: Column) -> Column:
    low = F.lower(name)
    return low.rlike(r"\b(?:cc0|public domain|pd|cc[ -]by(?:[ -]sa)?)\b") & ~low.rlike(r"\b(?:nc|nd)\b|noncommercial|no ?derivat")


def wiktionary_sounds(page: Column, code: str, language: str) -> Column:
    """The sounds of one language on a dictionary page: those between slashes before those in brackets, the first of each."""
    section = F.regexp_extract(page, rf"(?ms)^==\s*{language}\s*==\s*$(.*?)(?=^==[^=]|\z)", 1)
    inside = F.array_join(F.regexp_extract_all(section, F.lit(r"\{\{IPA\|" + code + r"\|([^}]*)\}\}"), 1), "|")
    slash, bracket = F.regexp_extract(inside, r"/([^/|<{]+)/", 1), F.regexp_extract(inside, r"\[([^\]|<{]+)\]", 1)
    return F.when(slash != "", slash).when(bracket != "", bracket)


def tag_shift(text: Column, shifts: dict[str, tuple[float, float]]) -> Column:
    """The sum of the shifts of all words of a dictionary in a text, within ±0.3 and ±0.15."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z']+)"), 1)

    def total(k: int, bound: float) -> Column:
        table = F.create_map(*[x for w, v in shifts.items() for x in (F.lit(w), F.lit(float(v[k])))])
        return F.greatest(F.lit(-bound), F.least(F.lit(bound), F.aggregate(words, F.lit(0.0), lambda a, w: a + F.coalesce(F.element_at(table, w), F.lit(0.0)))))

    return F.struct(total(0, 0.3).alias("exaggeration"), total(1, 0.15).alias("guidance"))


def blended(a: Column, b: Column, weight: float = 0.65) -> Column:
    """Two maps of probabilities mixed over all their keys: weight of b, the rest of a; a where there is no b."""
    return F.when(b.isNull(), a).otherwise(F.map_zip_with(a, b, lambda k, x, y: weight * F.coalesce(y, F.lit(0.0)) + (1 - weight) * F.coalesce(x, F.lit(0.0))))


def calm_capitals(text: Column, names: list[str], keep: list[str]) -> Column:
    """Words in capitals made small: names keep a capital, so does the start of a sentence; signs of `keep`, Roman
    numerals and short words stay. `D OUGLASS` is joined first."""
    joined = F.regexp_replace(text, r"\b([B-HJ-Z]) ([A-Z]{2,})\b", "$1$2")
    parts = F.split(joined, " ", -1)

    def word(w: Column, i: Column) -> Column:
        core, low = F.regexp_extract(w, r"^[^A-Za-z]*([A-Z]{3,})(?![a-z])", 1), F.lower(w)
        opens = (i == 0) | F.get(parts, i - 1).rlike("[.!?][\"”’]?$")
        leave = (core == "") | core.isin(keep) | core.rlike("^[IVXLCDM]+$")
        up = F.concat(F.regexp_extract(w, "^([^A-Za-z]*)", 1), F.regexp_replace(low, "^[^a-z]+", ""))
        first = F.concat(F.regexp_extract(up, "^([^a-z]*)", 1), F.initcap(F.regexp_extract(up, "^[^a-z]*(.*)$", 1)))
        return F.when(leave, w).when(F.lower(core).isin(names) | opens, first).otherwise(low)

    return F.regexp_replace(F.array_join(F.transform(parts, word), " "), r" +([,.;:!?])", "$1")
