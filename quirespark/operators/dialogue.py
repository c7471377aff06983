"""Chapters to segments: narration and speech, with what the text says of who speaks.

Everything but the joint choice of speakers is columns and windows. A window or group is one chapter of one book, which is
bounded by what a chapter is, not by how many books there are.

Null and empty texts have no paragraphs and give no rows. Repeated chapter ids are one chapter: give each its own."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirespark.operators import attribution

NARRATOR = "Narrator"
#: Verbs that name a speaker, nouns that are a group, words that are no name, signs of speech and of narration.
VERBS = (
    "answered said saith cried spake asked asketh saying replied shouted whispered exclaimed sighed returned added inquired continued observed "
    "remarked muttered murmured rejoined interrupted stammered responded demanded resumed declared retorted exclaiming repeated echoed laughed "
    "sobbed groaned gasped whimpered thundered uttered ejaculated faltered answer"
).split()
GROUPS = {"jews": "Jews", "disciples": "Disciples", "pharisees": "Pharisees", "woman": "Woman", "servants": "Servants", "officers": "Officers", "people": "Crowd", "multitude": "Crowd"}
NO_NAMES = "Then And But The Now When So Verily Lord God Father Son Spirit Word He She They It I His Her Their Therefore Again While Jesus's".split()
FIRST_PERSON = "I thou thee thy ye we you my me".split()
OPENS_NARRATION = "(?:Then|Now|After|When|So|Jesus|And (?:he|they|Jesus|the|there|John)\\b)"
ALIASES = {"John": "John the Baptist"}
WOMEN = "girl woman lady maiden damsel mother wife bride daughter sister queen".split()
MEN = "man gentleman boy youth fellow father husband bridegroom son brother lad king".split()

QUOTED = "[“\"]([^”\"]+)[”\"]"
VERB = rf"(?U)\b(?:{'|'.join(VERBS)})\b"
NAME = r"(?U)\b[A-Z][a-zà-ÿ]+\b"
SENTENCE_END = "(?<=[a-zà-ÿ’”][.!?])\\s"
NONE = "cast(array() as array<string>)"


def _one_of(words: list[str]) -> str:
    return f"(?:{'|'.join(words)})"


def paragraphs(chapters: DataFrame, key: list[str], *more: Column) -> DataFrame:
    """key, more, para, text: what stands between blank lines, with single spaces; empty ones do not count."""
    clean = F.transform(F.split("text", r"\n\s*\n", -1), lambda p: F.btrim(F.regexp_replace(p, r"\s+", " ")))
    return chapters.select(*key, *more, F.posexplode(F.filter(clean, lambda p: p != "")).alias("para", "text"))


def _names_in(text: Column, names: Column) -> Column:
    """The roles of the known names in a text, in order. `names` is a map of names to roles."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(f"({NAME})"), 1), lambda w: F.try_element_at(names, w)), lambda r: r.isNotNull())


def _noted(text: Column, phrases: dict[str, str]) -> Column:
    """Roles that a configured phrase or a noun for a group gives, phrases first."""
    known = [(f"(?iU){rx}", role) for rx, role in phrases.items()] + [(rf"(?iU)\b{g}\b", role) for g, role in GROUPS.items()]
    return F.array_compact(F.array(*[F.when(text.rlike(rx), role) for rx, role in known]))


def mentions(text: Column, names: Column, phrases: dict[str, str]) -> Column:
    return F.array_distinct(F.concat(_noted(text, phrases), _names_in(text, names)))


def named_in(fragment: Column, names: Column, phrases: dict[str, str]) -> Column:
    """The role that a fragment with a verb of speech names as its subject; null where that is a pronoun or nobody known."""
    before = F.coalesce(F.nullif(F.regexp_extract(fragment, f"(?s)^(.*?){VERB}", 1), F.lit("")), F.lit(""))
    after = F.regexp_extract(fragment, f"(?s){VERB}(.*)$", 1)
    by_pronoun = before.rlike(r"(?iU)\b(?:he|she|they)\s+(?:\w+ly\s+)?$") | after.rlike(r"(?iU)^\s*(?:\w+ly\s+)?(?:he|she|they)\b")
    later = F.when(~after.rlike(r"(?iU)^\s*(?:he|she|they|the other)\b"), F.get(_names_in(after, names), 0))
    return F.coalesce(F.get(_noted(fragment, phrases), 0), F.when(~by_pronoun, F.coalesce(F.get(_names_in(before, names), 0), later)))


def pronoun_gender(fragment: Column) -> Column:
    """m, f, n for others, or null: whom the pronouns and nouns of a fragment may mean."""
    kind = lambda words, nouns: fragment.rlike(rf"(?iU)\b{_one_of(words)}\b|\b(?:the|a)\s+(?:\w+\s+)?{_one_of(nouns)}\b")
    return F.when(kind(["he", "his", "him"], MEN), "m").when(kind(["she", "her"], WOMEN), "f").when(fragment.rlike(r"(?iU)\b(?:the other|they)\b"), "n")


def _first_sentence(gap: Column) -> Column:
    return F.left(F.get(F.split(F.btrim(gap), SENTENCE_END, 2), 0), F.lit(140))


def _last_sentence(gap: Column) -> Column:
    return F.right(F.coalesce(F.try_element_at(F.filter(F.split(F.btrim(gap), SENTENCE_END, -1), lambda p: p != ""), F.lit(-1)), F.lit("")), F.lit(140))


def quote_evidence(chapters: DataFrame, book: str = "book", chapter: str = "chapter", phrases: dict[str, str] | None = None) -> DataFrame:
    """One row for each quote of quoted prose: book, chapter, para, place (its number in the paragraph), quote, and what
    `attribution.attribute` decides by. `chapters` has book, chapter, text and `names`, a map of the names of a book's
    characters to their roles (null: none). Candidates are at most ten roles named nearby that somebody says something as
    in this chapter or an earlier one; where fewer than two are left, the four chief speakers so far stand in."""
    phrases = phrases or {}
    key, noted = [book, chapter], F.array(*map(F.lit, dict.fromkeys([*phrases.values(), *GROUPS.values()])))
    names = F.coalesce(F.col("names"), F.expr("cast(map() as map<string,string>)"))
    order = Window.partitionBy(*key).orderBy("para")
    told = F.regexp_replace("text", QUOTED, " ")
    paras = paragraphs(chapters, key, names.alias("names")).withColumn("here", mentions(told, F.col("names"), phrases))
    plain = F.when(~F.col("text").rlike(QUOTED) & (F.size("here") > 0), F.get("here", 0))
    paras = (
        paras.withColumn("lead_here", plain)
        .withColumn("lead", F.coalesce(F.lag("lead_here", 1).over(order), F.lag("lead_here", 2).over(order)))
        .withColumn("earlier", F.flatten(F.collect_list("here").over(order.rowsBetween(-3, -1))))
    )
    said, gaps = F.regexp_extract_all("text", F.lit(QUOTED), 1), F.split("text", QUOTED, -1)
    around = F.transform(F.col("said"), lambda q, i: F.struct(F.get("gaps", i).alias("before"), F.btrim(q).alias("quote"), F.get("gaps", i + 1).alias("after")))
    rows = (
        paras.withColumn("said", said).where(F.size("said") > 0).withColumn("gaps", gaps)
        .select(*key, "para", "names", "here", "lead", "earlier", F.posexplode(around).alias("place", "q"))
        .select(*key, "para", "place", "names", "here", "lead", "earlier", "q.*")
    )
    rows = rows.withColumn("fa", _first_sentence(F.col("after"))).withColumn("fb", _last_sentence(F.col("before")))
    after, before, who = F.col("fa").rlike(VERB), F.col("fb").rlike(VERB), F.col("names")
    rows = rows.select(
        *key, "para", "place", "quote", "here", "lead", "earlier",
        F.coalesce(F.when(after, named_in(F.col("fa"), who, phrases)), F.when(before, named_in(F.col("fb"), who, phrases))).alias("explicit"),
        F.when(after, F.col("fa")).when(before, F.col("fb")).otherwise("").alias("fragment"),
        mentions(F.col("before"), who, phrases).alias("recent"),
        mentions(F.col("quote"), who, phrases).alias("spoken_to"),
        ((F.col("place") > 0) & F.col("before").rlike(VERB) & F.col("before").rlike(r"[,;:—-]\s*$")).alias("split"),
        "names",
    )
    line, part = Window.partitionBy(*key).orderBy("para", "place"), Window.partitionBy(*key, "para").orderBy("place")
    among = Window.partitionBy(*key, F.col("explicit").isNull()).orderBy("para", "place")
    four = F.array_compact(F.array(*[F.lag("explicit", k).over(among) for k in (3, 2, 1)], F.col("explicit")))
    rows = (
        rows.withColumn("four", F.when(F.col("explicit").isNotNull(), four))
        .withColumn("speakers", F.coalesce(F.last("four", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.expr(NONE)))
        .withColumn("pron", F.when(F.col("explicit").isNull(), pronoun_gender(F.col("fragment"))))
        .withColumn("cont", F.lag("explicit").over(part).isNotNull() & F.col("explicit").isNull() & F.col("pron").isNull())
        .withColumn("other", F.col("explicit").isNull() & F.col("fragment").rlike(r"(?iU)\bthe other\b"))
        .withColumn("of_fragment", F.filter(mentions(F.col("fragment"), F.col("names"), phrases), lambda r: ~r.eqNullSafe(F.col("explicit"))))
        .withColumn("addressed", F.array_union("spoken_to", "of_fragment"))
        .withColumn("near", F.slice(F.array_distinct(F.concat("recent", "here", F.coalesce("earlier", F.expr(NONE)), "speakers")), 1, 10))
    )
    cast = cast_so_far(rows, book, chapter)
    rows = rows.join(cast, key, "left").withColumn("near", F.filter("near", lambda r: F.coalesce(F.array_contains("cast", r), F.lit(False)) | F.array_contains(noted, r)))
    chief = F.slice(F.coalesce("cast", F.expr(NONE)), 1, 4)
    return rows.select(
        *key, "para", "place", "quote", "explicit", "pron", "lead", "split", "cont", "other", "addressed", "recent",
        F.when(F.size("near") < 2, F.array_distinct(F.concat("near", chief))).otherwise(F.col("near")).alias("cands"),
    )


def cast_so_far(quotes: DataFrame, book: str, chapter: str) -> DataFrame:
    """book, chapter, cast: the roles named as speakers up to a chapter, those with most quotes first, then as they came."""
    here = quotes.where(F.col("explicit").isNotNull()).groupBy(book, chapter, "explicit").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("para", "place")).alias("at"))
    # a role is listed from its first chapter on, so what is made is as large as the lists themselves
    first = here.groupBy(book, "explicit").agg(F.min(F.struct(F.col(chapter).alias("c"), "at")).alias("at"))
    listed = quotes.select(book, chapter).distinct().join(first, book).where(F.col(chapter) >= F.col("at.c"))
    roles = listed.join(here.drop("at"), [book, chapter, "explicit"], "left")
    so_far = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy(book, "explicit").orderBy(chapter))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("so_far")).alias("n"), "at", "explicit")))
    return roles.withColumn("so_far", so_far).groupBy(book, chapter).agg(F.transform(ranked, lambda r: r["explicit"]).alias("cast"))


def chapter_genders(chapters: DataFrame, book: str = "book", chapter: str = "chapter", phrases: dict[str, str] | None = None, reach: int = 140) -> DataFrame:
    """book, chapter and genders, a map of roles to m or f: of the pronouns that come first after a mention of a role, within
    `reach` characters and its sentence, most decide; of equal counts the one that came first. Two votes are needed, in
    one chapter. Mentions are the names of the chapter's map `names`, and phrases (patterns with their roles)."""
    key = [book, chapter]
    tail = rf"(?=([^.!?]{{0,{reach}}}))"
    found = [(rf"(?U)\b([A-Z][a-zà-ÿ]+)\b{tail}", 1, 2, None)]
    found += [(f"(?U)({rx}){tail}", 1, re.compile(rx).groups + 2, role) for rx, role in (phrases or {}).items()]
    known = F.col("names")

    def heard(shape: str, name: int, rest: int, role: str | None) -> Column:
        heads, tails = F.regexp_extract_all("text", F.lit(shape), name), F.regexp_extract_all("text", F.lit(shape), rest)
        return F.zip_with(heads, tails, lambda w, t: F.struct((F.lit(role) if role else F.try_element_at(known, w)).alias("role"), t.alias("tail")))

    own = chapters.select(*key, "text", F.coalesce("names", F.expr("cast(map() as map<string,string>)")).alias("names"))
    each = F.filter(F.concat(*[heard(*x) for x in found]), lambda x: x["role"].isNotNull())
    told = own.select(*key, F.posexplode(each).alias("at", "x")).select(*key, "at", "x.*")
    said = F.lower(F.regexp_extract("tail", r"(?iU)\b(he|his|him|himself|she|her|herself)\b", 1))
    votes = told.withColumn("g", F.when(said.rlike("^(?:she|her)"), "f").when(said != "", "m")).where("g IS NOT NULL")
    n = votes.groupBy(*key, "role").agg(F.count_if(F.col("g") == "f").alias("f"), F.count_if(F.col("g") == "m").alias("m"), F.min_by("g", "at").alias("first"))
    most = F.when(F.col("f") > F.col("m"), "f").when(F.col("m") > F.col("f"), "m").otherwise(F.col("first"))
    return n.where("f + m >= 2").groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("role", most.alias("g")))).alias("genders"))


def segments(chapters: DataFrame, book: str = "book", chapter: str = "chapter", phrases: dict[str, str] | None = None, genders: dict[str, str] | None = None) -> DataFrame:
    """book, chapter, seg (from 0), para_start, speaker, kind and text of quoted prose, in the order of the text. Narration
    without a letter or digit between quotes is left out. Paragraphs without quotes are the narrator's. Genders are what the
    chapter's own pronouns say of a role (see `chapter_genders`), unless `genders` gives them."""
    key = [book, chapter]
    evidence = quote_evidence(chapters, book, chapter, phrases).join(chapter_genders(chapters, book, chapter, phrases), key, "left")
    # the quote goes along as the last of the columns of order, so that the speakers need no join to it
    spoken = attribution.attribute(evidence, genders, key, ["para", "place", "quote"])
    quoted = spoken.select(*key, "para", (2 * F.col("place") + 1).alias("piece"), "speaker", F.lit("dialogue").alias("kind"), F.col("quote").alias("text"))
    gaps = paragraphs(chapters, key).select(*key, "para", F.posexplode(F.split("text", QUOTED, -1)).alias("place", "text")).where(F.col("text").rlike(r"(?U)\w"))
    told = gaps.select(*key, "para", (2 * F.col("place")).alias("piece"), F.lit(NARRATOR).alias("speaker"), F.lit("narration").alias("kind"), F.btrim("text").alias("text"))
    inside, whole = Window.partitionBy(*key, "para").orderBy("piece"), Window.partitionBy(*key).orderBy("para", "piece")
    return told.unionByName(quoted).select(
        *key, (F.row_number().over(whole) - 1).alias("seg"), (F.row_number().over(inside) == 1).alias("para_start"), "speaker", "kind", "text",
    )


def _quoted_pieces(chapters: DataFrame, key: list[str], named: Callable[[Column], Column]) -> DataFrame:
    """key, para, piece, quoted, named and text of the paragraphs with quotation marks: what the fragment with a verb after or
    before a quote names, null where it names nobody."""
    paras = paragraphs(chapters, key).where(F.col("text").rlike(QUOTED))
    said, gaps = F.regexp_extract_all("text", F.lit(QUOTED), 1), F.split("text", QUOTED, -1)
    paras = paras.select(*key, "para", said.alias("said"), gaps.alias("gaps"))
    after = F.transform("said", lambda q, i: F.struct((2 * i + 1).alias("piece"), F.btrim(q).alias("text"), _first_sentence(F.get("gaps", i + 1)).alias("fa"), _last_sentence(F.get("gaps", i)).alias("fb")))
    told = F.transform("gaps", lambda g, i: F.struct((2 * i).alias("piece"), F.btrim(g).alias("text"), F.lit("").alias("fa"), F.lit("").alias("fb")))
    rows = paras.select(*key, "para", F.inline(F.concat(after, told)))
    by = lambda c: F.when(F.col(c).rlike(VERB), named(F.col(c)))
    return rows.select(*key, "para", "piece", (F.col("piece") % 2 == 1).alias("quoted"), F.when(F.col("piece") % 2 == 1, F.coalesce(by("fa"), by("fb"))).alias("named"), "text").where(F.col("text").rlike(r"(?U)\w"))


def unquoted_segments(chapters: DataFrame, book: str = "book", chapter: str = "chapter", aliases: dict[str, str] | None = None) -> DataFrame:
    """The same rows for prose without quotation marks, where a clause with a verb of speech and a comma opens speech: "And
    Peter answered, ...". A pronoun means who was named last; a clause that names nobody opens none. A paragraph of speech
    that goes on in the next is still that speaker's, unless narration opens there. Neighbours of one speaker in a
    paragraph are one segment. `aliases` gives names their roles, besides those of ALIASES. In a paragraph that has quotation
    marks all the same they bound its speech; a quote whose fragments name nobody is by who spoke last."""
    key = [book, chapter]
    roles = F.create_map(*[F.lit(x) for pair in {**ALIASES, **(aliases or {})}.items() for x in pair])
    clause = rf"(?U)(?:^|(?<=[.?!]\s))((?:[^.?!;:]{{0,70}}?)\b{_one_of(VERBS)}\b[^.?!;:,]{{0,50}},\s+)"
    marked = F.split(F.regexp_replace(F.translate("text", "\u0001\u0002", ""), clause, "\u0001$1\u0002"), "\u0001", -1)
    parts = paragraphs(chapters, key).where(~F.col("text").rlike(QUOTED)).select(*key, "para", F.posexplode(marked).alias("part", "text"))
    parts = parts.withColumn("clause", F.when(F.col("part") > 0, F.substring_index("text", "\u0002", 1))).withColumn("rest", F.when(F.col("part") > 0, F.substring_index("text", "\u0002", -1)))
    picked = lambda side: F.get(F.filter(F.regexp_extract_all(side, F.lit(f"({NAME})"), 1), lambda w: ~w.isin(NO_NAMES)), 0)

    def named(text: Column) -> Column:
        """The role that a clause names, unless it is part of what is said."""
        before, after = F.regexp_extract(text, f"(?s)^(.*?){VERB}", 1), F.regexp_extract(text, f"(?s){VERB}(.*)$", 1)
        name = F.coalesce(picked(before), F.when(~after.rlike(r"(?iU)^\s*(?:he|she|they|the other)\b"), picked(after)))
        return F.coalesce(F.get(_noted(text, {}), 0), F.try_element_at(roles, name), name)

    text, quoted = F.col("clause"), _quoted_pieces(chapters, key, named)
    clear = text.isNotNull() & ~text.rlike(r"(?U)\b(?:I|thou|ye|we|thee)\b")
    parts = parts.withColumn("named", F.when(clear, named(text)))
    # quotes name speakers for pronouns of later clauses too
    heard = parts.select(*key, "para", F.col("part").alias("piece"), "named", F.lit(False).alias("quoted"))
    heard = heard.unionByName(quoted.select(*key, "para", "piece", "named", "quoted"))
    along = Window.partitionBy(*key).orderBy("para", "piece")
    last = F.last("named", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    heard = heard.withColumn("last", last)
    parts = parts.join(heard.where("NOT quoted").select(*key, "para", F.col("piece").alias("part"), "last"), [*key, "para", "part"], "left")
    parts = parts.withColumn("who", F.coalesce("named", F.when(clear & text.rlike(r"(?iU)\b(?:he|she|they|the other)\b"), F.col("last"))))
    here = Window.partitionBy(*key, "para").orderBy("part")
    parts = parts.withColumn("run", F.sum(F.col("who").isNotNull().cast("int")).over(here))
    whole = F.concat(F.coalesce("clause", F.lit("")), F.when(F.col("part") > 0, F.col("rest")).otherwise(F.col("text")))
    opens = F.col("who").isNotNull()
    runs = parts.groupBy(*key, "para", "run").agg(
        F.max("who").alias("who"), F.max(F.when(opens, F.col("clause"))).alias("clause"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", F.when(opens, F.col("rest")).otherwise(whole).alias("t")))), lambda p: p["t"]), "").alias("speech"),
    )
    lead = F.regexp_extract("speech", r"(?i)^((?:(?:and\s+)?(?:saying|said|saith)[, ]+\s*)*)", 1)
    pieces = F.when(F.col("who").isNull(), F.array(F.struct(F.lit(NARRATOR).alias("speaker"), F.btrim("speech").alias("text")))).otherwise(
        F.array(
            F.struct(F.lit(NARRATOR).alias("speaker"), F.concat(F.rtrim(F.btrim(F.concat("clause", lead)), F.lit(",")), F.lit(",")).alias("text")),
            F.struct(F.col("who").alias("speaker"), F.btrim(F.expr("substring(speech, char_length(lead) + 1)")).alias("text")),
        )
    )
    rows = runs.withColumn("speech", F.btrim("speech")).withColumn("lead", lead).select(*key, "para", "run", F.posexplode(pieces).alias("half", "s")).select(*key, "para", "run", "half", "s.*").where(F.btrim("text") != "")
    spoken = quoted.drop("quoted", "named").join(heard.where("quoted").select(*key, "para", "piece", F.coalesce("named", "last", F.lit("Speaker A")).alias("speaker")), [*key, "para", "piece"], "left")
    rows = rows.unionByName(spoken.select(*key, "para", F.col("piece").cast("long").alias("run"), F.lit(0).alias("half"), F.coalesce("speaker", F.lit(NARRATOR)).alias("speaker"), "text"))
    # speech that goes on: a lone piece of narration in a paragraph takes the speaker who ended the one before
    para = Window.partitionBy(*key, "para")
    rows = rows.withColumn("alone", (F.count(F.lit(1)).over(para) == 1) & (F.col("speaker") == NARRATOR))
    goes_on = F.col("alone") & F.col("text").rlike(rf"(?U)\b{_one_of(FIRST_PERSON)}\b") & ~F.col("text").rlike(f"(?U)^{OPENS_NARRATION}")
    order = Window.partitionBy(*key).orderBy("para", "run", "half")
    ends = F.when(~goes_on, F.when(F.col("speaker") == NARRATOR, "").otherwise(F.col("speaker")))
    open_by = F.last(ends, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("speaker", F.when(goes_on & (open_by != ""), open_by).otherwise(F.col("speaker")))
    inside = Window.partitionBy(*key, "para").orderBy("run", "half")
    new = F.coalesce((F.lag("speaker").over(inside) != F.col("speaker")).cast("int"), F.lit(1))
    rows = rows.withColumn("new", new).withColumn("island", F.sum("new").over(inside))
    joined = rows.groupBy(*key, "para", "island").agg(
        F.first("speaker").alias("speaker"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "half", "text"))), lambda s: s["text"]), " ").alias("text"),
    )
    return joined.select(
        *key, (F.row_number().over(Window.partitionBy(*key).orderBy("para", "island")) - 1).alias("seg"), (F.col("island") == 1).alias("para_start"), "speaker",
        F.when(F.col("speaker") == NARRATOR, "narration").otherwise("dialogue").alias("kind"), "text",
    )
