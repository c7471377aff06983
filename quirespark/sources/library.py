"""Files of any kind as books of chapters."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.functions import script, text
from quirespark.operators import books
from quirespark.shared import freeze
from quirespark.sources import readers, web

#: The kinds of files that are read, by suffix.
SUFFIXES = {"txt": "plain", "text": "plain", "md": "markdown", "markdown": "markdown", "html": "page", "htm": "page", "xhtml": "page", "epub": "zipped", "docx": "zipped"}


def stem_of(path: str) -> Column:
    return script.pretty(F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1))


#: Readers of plain text in the order in which they are tried after the likeliest one.
TRIED = ("chapters", "chapters_loose", "verse", "single")
_CHAPTERS = "array<struct<chapter: int, title: string, heading: string, text: string>>"


def _read_as(reader: str, docs: DataFrame) -> DataFrame:
    """doc_id, chapter, title, heading and text by one reader; docs: doc_id, name (the title of a text that is one chapter)
    and text."""
    none = F.lit(None).cast("string")
    if reader == "play":
        found = readers.play_chapters(docs)
    elif reader == "verse":
        found = readers.verse_chapters(docs).select("doc_id", "chapter", F.concat(F.lit("Chapter "), "chapter").alias("title"), none.alias("heading"), "text")
    elif reader == "single":
        found = docs.select("doc_id", F.lit(1).alias("chapter"), F.col("name").alias("title"), none.alias("heading"), text.clean(F.col("text")).alias("text"))
    else:
        headed = readers.headed_chapters(docs, loose=reader == "chapters_loose")
        found = headed.select("doc_id", "chapter", "title", none.alias("heading"), text.clean(F.col("text")).alias("text"))
    return found.withColumn("chapter", F.col("chapter").cast("int"))


def readings(docs: DataFrame) -> DataFrame:
    """One row for each text (doc_id, text, name): title, author, reader, confidence, tried, level, notes and chapters, an
    array of chapter, title, heading (of a scene) and text.

    Each text is first read by the reader that `books.text_kind` takes to be right. What `books.validate` finds ok is done;
    the others go to the next reader that has marks to go by, all at once, and in the end the reading of the best level is
    taken, of equal ones the first. So a text is read again only if it came out badly, five times at most. A book's
    chapters are one row. The title is the first line, unless that is long or a verse: then it is the column name.

    A null or blank text has one empty chapter, which is bad. Equal ids are one text: give each its own. An empty table
    gives no rows."""
    raw = F.coalesce("text", F.lit(""))
    first = F.btrim(F.get(F.split(F.btrim(raw, F.lit(" \t\n\r")), "\n"), 0))
    unfit = (first == "") | (F.char_length(first) > 90) | first.rlike(r"^[0-9]{1,3}:[0-9]{1,3}\b")
    line = lambda mark: F.nullif(F.btrim(F.regexp_extract(raw, rf"{mark}:[ \t]*([^\n]+)", 1)), F.lit(""))
    own = docs.select("doc_id", raw.alias("text"), F.when(unfit, F.col("name")).otherwise(first).alias("name"), line("Title").alias("marked"), line("Author").alias("author")).where("doc_id IS NOT NULL")
    own = books.text_kind(own, "text", "name", "marked", "author")
    likely = F.when(F.col("kind") == "chapters_loose", "single").otherwise(F.col("kind"))
    able = {"chapters": F.col("headings") >= 2, "chapters_loose": F.col("loose") >= 2, "verse": F.col("n_marks") > 20, "single": F.lit(True)}
    others = F.array_compact(F.array(*[F.when(able[r] & (likely != r), r) for r in TRIED]))
    own = own.select("doc_id", "text", F.char_length("text").alias("size"), "name", "marked", "author", "confidence", F.concat(F.array(likely), others).alias("order"))
    own = freeze(own, "texts")
    level = F.when(F.col("level") == "ok", 0).when(F.col("level") == "check", 1).otherwise(2)
    done, left = [], own.withColumn("best", F.lit(3))
    for k in range(len(TRIED) + 1):
        turn = left.where((F.col("best") > 0) & (F.size("order") > k)).withColumn("reader", F.get("order", F.lit(k)))
        if k and turn.isEmpty():
            break
        parts = [_read_as(r, turn.where(F.col("reader") == r)) for r in (("play", *TRIED) if not k else TRIED)]
        # a text's chapters come together once, and are judged where they lie
        made = functools.reduce(DataFrame.unionByName, parts).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chapter", "title", "heading", "text"))).alias("chapters"))
        whole = F.when(F.col("reader").isin("chapters", "chapters_loose", "single"), F.col("size"))
        tried = books.validated(turn.select("doc_id", "reader", whole.alias("whole")).join(made, "doc_id", "left"), "chapters", "whole")
        none = F.col("chapters").isNull()
        tried = freeze(tried.select("doc_id", F.lit(k).alias("try"), "reader", F.when(none, "bad").otherwise(F.col("level")).alias("level"), F.when(none, "").otherwise(F.col("notes")).alias("notes"), F.coalesce("chapters", F.array().cast(_CHAPTERS)).alias("chapters")), "readings")
        done.append(tried)
        left = left.join(tried.select("doc_id", level.alias("now")), "doc_id", "left").withColumn("best", F.least("best", "now")).drop("now")
    tried = functools.reduce(DataFrame.unionByName, done)
    if len(done) > 1:  # the best is found without the texts
        first = tried.groupBy("doc_id").agg(F.min(F.struct(level.alias("l"), "try"))["try"].alias("first"))
        tried = tried.join(first, "doc_id").where(F.col("try") == F.col("first"))
    best = tried.select("doc_id", F.struct("try", "reader", "level", "notes", "chapters").alias("b"))
    reader = F.when(F.col("b.reader") == "chapters_loose", "chapters").otherwise(F.col("b.reader"))
    title = F.when(F.col("b.reader") == "play", F.coalesce("marked", "name")).otherwise(F.col("name"))
    return own.join(best, "doc_id").select("doc_id", title.alias("title"), F.when(F.col("b.reader") == "play", F.col("author")).alias("author"), reader.alias("reader"), "confidence", F.slice("order", F.lit(1), F.col("b.try") + 1).alias("tried"), "b.level", "b.notes", "b.chapters")


def read_books(spark: SparkSession, path: str, max_chapters: int | None = None) -> DataFrame:
    """path, chapter (from 1), title, text and problem of all files that a path names (see `chapters_of`)."""
    return chapters_of(spark.read.format("binaryFile").load(path).select("path", "content"), max_chapters)


def chapters_of(files: DataFrame, max_chapters: int | None = None) -> DataFrame:
    """path, chapter, title, text and problem for files (path, content): each is read as its suffix says, then cut into
    chapters; plain text by the reader that suits what it holds (see `readings`). `max_chapters` keeps the first ones.

    A file of another kind, one that cannot be opened and one without text give one row of chapter 0 that says so in
    `problem`, instead of failing all others. Bytes that are no UTF-8 become replacement signs. Files of no bytes at all are
    left out by Spark itself."""
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kinds = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    f = files.withColumn("kind", F.try_element_at(kinds, suffix))
    written = f.where(F.col("kind").isin("plain", "markdown", "page")).withColumn("text", F.regexp_replace(F.decode("content", "UTF-8"), "\r", ""))
    zipped = readers.zipped_blocks(f.where("kind = 'zipped'"))
    marked = readers.markdown_blocks(written.where("kind = 'markdown'").select(F.col("path").alias("doc_id"), "text")).withColumnRenamed("doc_id", "path")
    pages = web.parsed_blocks(written.where("kind = 'page'").select("path", F.col("text").alias("html")), "path")
    columns = ["path", "pos", "level", "text"]
    blocks = zipped.where("level >= 0").select(columns).unionByName(marked.select(columns)).unionByName(pages.select(columns))
    plain = written.where("kind = 'plain'").select(F.col("path").alias("doc_id"), text.clean(F.col("text")).alias("text")).where("text <> ''")
    read = readings(plain.withColumn("name", stem_of("doc_id")))
    texts = read.select(F.col("doc_id").alias("path"), F.explode("chapters").alias("c")).select("path", "c.chapter", "c.title", "c.text")
    found = web.chapters(blocks, "path").unionByName(texts)
    found = found.select("path", "chapter", F.coalesce("title", stem_of("path")).alias("title"), "text", F.lit(None).cast("string").alias("problem"))
    if max_chapters:
        found = found.where(F.col("chapter") <= max_chapters)
    broken = zipped.where("level < 0").groupBy("path").agg(F.min("text").alias("why"))
    missing = f.select("path", "kind").join(found.select("path").distinct(), "path", "left_anti").join(broken, "path", "left")
    why = F.when(F.col("kind").isNull(), F.concat(F.lit("cannot read ."), suffix)).otherwise(F.coalesce("why", F.lit("no text")))
    return found.unionByName(missing.select("path", F.lit(0).alias("chapter"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("text"), why.alias("problem")))


def parse_reports(chapters: DataFrame) -> DataFrame:
    """What `books.validate` says of each file, with the reader that read it; files that could not be read are bad."""
    report = books.validate(chapters.where("chapter > 0"), "path", "title")
    failed = chapters.where("chapter = 0").select("path", F.lit(0).cast("long").alias("chapters"), F.lit(0).cast("long").alias("chars"), F.lit(None).cast("double").alias("median_chars"), F.col("problem").alias("notes"), F.lit("bad").alias("level"))
    return report.unionByName(failed).withColumn("reader", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
