"""Books as tables: paragraphs, sentences, chunks, checks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirespark.functions import text as T
from quirespark.shared import freeze

_AFTER_STOP = re.compile(r"(?<=[.!?;:])\s+")
_UP_TO_PAUSE = re.compile(r"(?s).*[,;:—]")


def paragraphs(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, further columns of docs, para (from 0, of all lines) and text of each line that is not blank. A null or
    blank text gives no row."""
    split = docs.select("doc_id", *more, F.posexplode(T.lines(F.col("text"))).alias("para", "text"))
    return split.where(F.btrim("text") != "").withColumn("text", F.btrim("text"))


def sentence_rows(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, further columns of docs, para, sent (from 0) and sentence."""
    return paragraphs(docs, *more).select("doc_id", *more, "para", F.posexplode(T.sentences(F.col("text"))).alias("sent", "sentence"))


def _broken(sentence: str, most: int) -> Iterator[tuple[str, str]]:
    """A sentence in pieces of at most `most` characters: it breaks after the last comma, semicolon, colon or dash of the
    later part of what fits, else at a space, else anywhere. With how each piece ends: comma, space or end."""
    while len(sentence) > most:
        soft = _UP_TO_PAUSE.match(sentence, 0, most)
        how = "comma" if soft and soft.end() > int(most * 0.45) else "space"
        at = soft.end() if how == "comma" else sentence.rfind(" ", 0, most) + 1
        at = at if at > 1 else most + 1
        yield sentence[:at].strip(), how
        sentence = sentence[at:].strip()
    yield sentence, "end"


def _cuts(text: str, most: int) -> Iterator[tuple[str, str]]:
    """Pieces of at most `most` characters with how each ends: whole sentences together as long as they fit."""
    line: list[str] = []
    for piece, how in chain.from_iterable(_broken(s, most) for s in _AFTER_STOP.split(text.strip())):
        room = most - sum(map(len, line)) - len(line)
        if line and (how != "end" or len(piece) > room):
            yield " ".join(line), "end"
            line.clear()
        if how != "end":
            yield piece, how
        elif piece:
            line.append(piece)
    if line:
        yield " ".join(line), "end"


def chunk_plan(docs: DataFrame, most: int = 300, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ci (from 0), chunk and cut: the pieces that a voice reads at a time. Packing is sequential, so each text is
    folded in an Arrow batch; texts are independent of each other. A worker holds the pieces of 64 texts at a time."""
    own = docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 64) for b in batches for k in range(0, len(b), 64)):
            owner, ci, chunk, cut = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                pieces = [p for p in _cuts(text, most) if p[0]]
                owner += [i] * len(pieces)
                ci += range(len(pieces))
                chunk += [p[0] for p in pieces]
                cut += [p[1] for p in pieces]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int32())), pa.array(ci, pa.int32()), pa.array(chunk, pa.string()), pa.array(cut, pa.string())], names=[id_col, "ci", "chunk", "cut"])

    return own.mapInArrow(run, f"{id_col} {dict(own.dtypes)[id_col]}, ci int, chunk string, cut string")


def strip_licence(docs: DataFrame, start: str, end: str) -> DataFrame:
    """docs with the text after a start mark (if any) and before an end mark (if any)."""
    cut = F.regexp_replace("text", f"(?s)^.*?{start}", "")
    return docs.withColumn("text", F.btrim(F.regexp_replace(cut, f"(?s){end}.*$", ""), F.lit(" \n")))


def drop_cruft(docs: DataFrame, pattern: str) -> DataFrame:
    """docs without the lines that match pattern."""
    return docs.withColumn("text", F.array_join(F.filter(T.lines(F.col("text")), lambda p: ~F.lower(p).rlike(pattern)), "\n"))


def validate(chapters: DataFrame, book: str, title: str, whole: str | None = None) -> DataFrame:
    """One row for each book: chapters, chars, median, notes (codes, in order) and level (ok, check or bad).

    whole names a column with the length of the book's source; where less than four fifths of it are in chapters a note
    says so. A null text has no length; a book whose texts are all null is bad.
    """
    size = F.char_length("text")
    s = chapters.groupBy(book).agg(
        F.count(F.lit(1)).alias("chapters"), F.sum(size).cast("long").alias("chars"), F.percentile(size, F.lit(0.5)).alias("median_chars"),
        F.max(size).cast("long").alias("longest"), F.count_if(size < 40).alias("empty"), F.count_distinct(title).alias("titles"),
        (F.max(whole) if whole else F.lit(None).cast("long")).alias("whole"),
    )
    notes, level = _judged()
    return s.select(book, "chapters", "chars", "median_chars", notes.alias("notes"), level.alias("level"))


def validated(made: DataFrame, array: str, whole: str) -> DataFrame:
    """made with the notes and level that `validate` gives, for books that are one row each with an array of chapters
    (title, text): nothing is dealt anew."""
    sizes = F.array_sort(F.array_compact(F.transform(array, lambda c: F.char_length(c["text"]))))
    at = lambda k: F.get("_sizes", F.floor((F.size("_sizes") + k) / 2).cast("int"))
    figures = {
        "chapters": F.size(array), "chars": F.when(F.size("_sizes") > 0, F.aggregate("_sizes", F.lit(0).cast("long"), lambda n, x: n + x)), "median_chars": (at(-1) + at(0)) / 2,
        "longest": F.get("_sizes", F.size("_sizes") - 1), "empty": F.size(F.filter("_sizes", lambda x: x < 40)),
        "titles": F.size(F.array_distinct(F.array_compact(F.transform(array, lambda c: c["title"])))), "whole": F.col(whole),
    }
    notes, level = _judged("_s.")
    s = made.withColumn("_sizes", sizes).withColumn("_s", F.struct(*[c.alias(n) for n, c in figures.items()]))
    return s.withColumns({"notes": notes, "level": level}).drop("_sizes", "_s")


def _judged(at: str = "") -> tuple[Column, Column]:
    """Notes and level from the figures of a book, whose columns have names that begin with `at`."""
    of = lambda c: F.col(at + c)
    tiny = (of("chapters") > 3) & (of("median_chars") < 500)
    notes = F.array_compact(F.array(
        F.when((of("chapters") == 1) & (of("chars") > 60000), "one_chapter"),
        F.when(tiny, "tiny_chapters"),
        F.when((of("chapters") > 5) & (of("longest") > 12 * of("median_chars")) & (of("longest") > 50000), "missed_heading"),
        F.when(of("empty") > 0, "empty_chapters"),
        F.when(of("chars") < 0.8 * of("whole"), "text_dropped"),  # a null length says nothing
        F.when((of("chapters") > 3) & (of("titles") < 0.6 * of("chapters")), "shared_titles"),
    ))
    level = F.when((of("chars") < 200) | (tiny & (of("median_chars") < 150)), "bad").when(F.size(notes) > 0, "check").otherwise("ok")
    return F.array_join(notes, ","), level


def text_kind(docs: DataFrame, *more: str) -> DataFrame:
    """What reader suits each text: play, verse, chapters, chapters_loose or single; how sure that is (0 to 1), further
    columns of docs, and the counts that tell: lines `SPEAKER.` and `SCENE I.`, marks `chapter:verse`, the share of them that follow the one before,
    headings, and lines that begin like headings."""
    t = F.coalesce("text", F.lit(""))
    marks = F.when(F.contains(t, F.lit(":")), F.regexp_extract_all(t, F.lit(r"(?:^|[^0-9])([0-9]{1,3}:[0-9]{1,3})[ \n]"), 1)).otherwise(F.array().cast("array<string>"))
    lines = T.lines(t)
    # the last line of a text is a heading only after an empty one
    standing = F.filter(lines, lambda x, i: T.heads_chapter(x) & ((i < F.size(lines) - 1) | (i == 0) | (F.btrim(F.get(lines, i - 1)) == "")))
    base = docs.select(
        "doc_id",
        *more,
        F.regexp_count(t, F.lit(r"(?m)^[A-Z][A-Z .’'-]+\.$")).alias("speakers"),
        F.regexp_count(t, F.lit(r"(?m)^SCENE [IVX]+\.")).alias("scenes"),
        F.filter(F.transform(marks, lambda m: F.struct(F.split(m, ":")[0].cast("int").alias("c"), F.split(m, ":")[1].cast("int").alias("v"))), lambda m: m.c.between(1, 150) & m.v.between(1, 176)).alias("marks"),
        F.size(standing).alias("headings"),
        F.size(F.filter(lines, T.may_head_chapter)).alias("loose"),
    )
    follows = F.filter("marks", lambda m, i: (i > 0) & _next_verse(F.get(F.col("marks"), i - 1), m))
    scored = base.withColumn("n_marks", F.size("marks")).withColumn("in_order", F.when(F.size("marks") >= 2, F.size(follows) / (F.size("marks") - 1)).otherwise(0.0))
    play, verse = (F.col("speakers") > 50) & (F.col("scenes") >= 1), (F.col("n_marks") > 20) & (F.col("in_order") >= 0.6)
    kind = F.when(play, "play").when(verse, "verse").when(F.col("headings") >= 2, "chapters").when(F.col("loose") >= 2, "chapters_loose").otherwise("single")
    sure = (
        F.when(play, F.least(F.lit(1.0), 0.6 + F.col("speakers") / 500)).when(verse, F.least(F.lit(1.0), F.col("in_order")))
        .when(F.col("headings") >= 2, F.least(F.lit(1.0), 0.5 + F.col("headings") / 40)).when(F.col("loose") >= 2, F.lit(0.3)).otherwise(0.6)
    )
    return scored.select("doc_id", *more, "speakers", "scenes", "n_marks", F.round("in_order", 4).alias("in_order"), "headings", "loose", F.round(sure, 2).alias("confidence"), kind.alias("kind"))


def _next_verse(a, b):
    """Whether chapter and verse b come right after a: the next verse, or the first of this or the next chapter."""
    return ((a.c == b.c) & (b.v == a.v + 1)) | ((b.v == 1) & (b.c - a.c).isin(0, 1))


def furniture(pages: DataFrame, edge: int = 3, least_pages: int = 3, share: float = 0.2) -> DataFrame:
    """pages (book, page, text) without running headers and footers: lines among the first or last `edge` of a page
    that, digits aside, stand so on at least `share` of the book's pages."""
    norm = lambda line: F.btrim(F.regexp_replace(F.lower(line), "[0-9]+", "#"))
    cut = pages.withColumn("ls", T.lines(F.col("text")))
    edges = F.when(F.size("ls") <= 2 * edge, F.col("ls")).otherwise(F.concat(F.slice("ls", 1, edge), F.slice("ls", -edge, edge)))
    total = pages.groupBy("book").agg(F.count_distinct("page").alias("pages"))
    often = cut.select("book", "page", F.explode(F.array_distinct(F.transform(edges, norm))).alias("norm")).where("norm != ''").distinct()
    often = often.groupBy("book", "norm").agg(F.count(F.lit(1)).alias("on")).join(total, "book")
    bad = often.where(F.col("on") >= F.greatest(F.lit(float(least_pages)), F.col("pages") * share)).groupBy("book").agg(F.collect_set("norm").alias("bad"))
    # a book has few such lines: each stands on a share of its pages, which have 2 * edge lines of the kind
    marked = cut.join(bad, "book", "left").withColumn("bad", F.coalesce("bad", F.array().cast("array<string>")))
    at_edge = lambda i: (i < edge) | (i >= F.size("ls") - edge)
    kept = F.filter("ls", lambda x, i: ~(at_edge(i) & F.array_contains("bad", norm(x))))
    body = marked.withColumn("kept", kept).where(F.size("kept") > 0)
    return body.select("book", "page", F.array_join("kept", "\n").alias("text"), F.size("kept").cast("long").alias("lines"))


def running_text(pages: DataFrame) -> DataFrame:
    """page lines joined: a hyphen at a line's end joins words, other ends become spaces."""
    joined = F.regexp_replace(F.regexp_replace("text", r"([a-zß-öø-ÿ])-\n([a-zß-öø-ÿ])", "$1$2"), r"\n", " ")
    return pages.withColumn("text", F.regexp_replace(joined, " +", " "))


def fingerprint(docs: DataFrame, by: str, columns: list[str], order: str, part_rows: int = 1 << 14) -> DataFrame:
    """One sha1 for each value of `by`, equal as long as no row changed: of the hashes of its parts in order, a part being
    the rows whose `order` (a whole number, null first) falls in one stretch of part_rows, hashed in order. However many
    rows a value has, no task lists more than a part or the parts of one value. Rows of equal `order` go by their hash."""
    row = F.sha1(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in columns]))
    joined = lambda at: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(at).alias("o"), F.col("h")))), lambda x: x.h), "")
    rows = docs.select(by, F.col(order).alias("o"), F.floor(F.col(order) / part_rows).alias("part"), row.alias("h"))
    parts = rows.groupBy(by, "part").agg(F.sha1(joined("o")).alias("h"), F.count(F.lit(1)).alias("n"))
    return parts.groupBy(by).agg(F.sha1(joined("part")).alias("fingerprint"), F.sum("n").alias("n_rows"))


def _paced(docs: DataFrame, group: str) -> DataFrame:
    """Sentences with chars, n_words and pace: the length stands for the characters, the number of words for the seconds."""
    s = sentence_rows(docs, group).withColumns({"chars": F.char_length("sentence"), "n_words": F.regexp_count("sentence", F.lit(T.WORD))})
    return s.where("chars >= 25 AND n_words > 0").withColumn("pace", F.col("chars") / F.col("n_words"))


def _usual(counted: DataFrame, group: str) -> DataFrame:
    """The median of the paces (pace, n) of each group."""
    return counted.groupBy(group).agg(F.when(F.sum("n") >= 20, F.percentile("pace", F.lit(0.5), F.col("n"))).alias("median_pace"))


def _pace_problem(fast: float, slow: float) -> Column:
    return F.when(F.col("pace") > fast * F.col("median_pace"), "rushed").when(F.col("pace") < slow * F.col("median_pace"), "drawn out")


def clip_pace(docs: DataFrame, group: str, fast: float = 1.6, slow: float = 0.45) -> DataFrame:
    """Pieces of each text against the usual pace of its group: median and outliers."""
    s = _paced(docs, group)
    # equal paces are counted first, so a group brings its different ones to one task, not all its sentences
    usual = _usual(s.groupBy(group, "pace").agg(F.count(F.lit(1)).alias("n")), group)
    return s.join(usual, group).withColumn("problem", _pace_problem(fast, slow))


def clip_pace_counts(docs: DataFrame, group: str, fast: float = 1.6, slow: float = 0.45) -> DataFrame:
    """What `clip_pace` comes to for each group: n_clips, median_pace, rushed and drawn_out. Texts are cut once: equal paces
    of a group have the same problem. A null group has no row."""
    counted = freeze(_paced(docs, group).where(F.col(group).isNotNull()).groupBy(group, "pace").agg(F.count(F.lit(1)).alias("n")), "paces")
    judged = counted.join(_usual(counted, group), group).withColumn("problem", _pace_problem(fast, slow))
    among = lambda p: F.coalesce(F.sum(F.when(F.col("problem") == p, F.col("n"))), F.lit(0))
    return judged.groupBy(group).agg(F.sum("n").alias("n_clips"), F.first("median_pace").alias("median_pace"), among("rushed").alias("rushed"), among("drawn out").alias("drawn_out"))


def newest_versions(rows: DataFrame, by: str, order: list, keep: int) -> DataFrame:
    """The newest `keep` rows of each `by`."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_n") <= keep).drop("_n")
