"""EPUB archives as chapters: titles from the contents, notes read where they are cited.

An archive is opened once, for its blocks with the ids and links in them; which numbered link is a note, on whichever page,
is then a join of links to ids within the archive."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirespark.functions import text as T
from quirespark.sources.web import _Blocks

#: Fixed value: what the link of a note says.
LABEL = r"\[?\s*(\d{1,3})\s*\]?\.?"
#: Signs around a numbered link in the text of a block: its number in the block and what it says.
_OPEN, _CLOSE = "", ""
_LINK = "array<struct<k: int, number: int, file: string, frag: string, ids: array<string>>>"
_BLOCK = f"path string, page int, file string, contents string, pos int, level int, text string, ids array<string>, links {_LINK}"


class _Linked(_Blocks):
    """Blocks with the ids that stand in them or before them, and their numbered links."""

    def __init__(self) -> None:
        super().__init__()
        self.ids: list[str] = []
        self.links: list[dict] = []
        self.anchor: tuple | None = None
        self.empty: str | None = None

    def _close(self) -> None:
        before = len(self.out)
        self.anchor = None
        super()._close()
        if len(self.out) > before:
            self.out[-1] = (*self.out[-1], self.ids, self.links)
            self.ids, self.links = [], []
        self.empty = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        known = dict(attrs)
        super().handle_starttag(tag, attrs)
        own = known.get("id") or (known.get("name") if tag == "a" else None)
        if own and not self.skip:
            self.ids.append(own)
        if tag == "a" and not self.skip:
            self.anchor = (len(self.text), known.get("href"), own)

    def handle_endtag(self, tag: str) -> None:
        if tag == "a" and self.anchor:
            start, href, own = self.anchor
            label = "".join(self.text[start:]).strip()
            found, (file, _, frag) = re.fullmatch(LABEL, label), (href or "").partition("#")
            if not label:
                self.empty = own
            elif found and frag:
                k = len(self.links)
                self.links.append({"k": k, "number": int(found[1]), "file": unquote(file), "frag": frag, "ids": [x for x in (own, self.empty) if x]})
                self.text[start:] = [f"{_OPEN}{k}:{found[1]}{_CLOSE}"]
                self.empty = None
            self.anchor = None
        super().handle_endtag(tag)


def _contents(book: zipfile.ZipFile, items: dict[str, tuple], folder: str) -> dict[str, str]:
    """Titles by file: the first entry of the contents (navigation page or NCX) that names it."""
    out: dict[str, str] = {}
    local = lambda tag: tag.rpartition("}")[2]
    for href, kind, properties in items.values():
        if "nav" not in properties.split() and kind != "application/x-dtbncx+xml":
            continue
        at = posixpath.normpath(posixpath.join(folder, href))
        root = ElementTree.fromstring(book.read(at))
        for e in root.iter():
            if local(e.tag) == "a" and e.get("href"):
                target, title = e.get("href"), "".join(e.itertext())
            elif local(e.tag) == "navPoint":
                target = next((x.get("src") for x in e if local(x.tag) == "content"), None)
                title = next(("".join(x.itertext()) for x in e if local(x.tag) == "navLabel"), "")
            else:
                continue
            if target and title.strip():
                out.setdefault(posixpath.normpath(posixpath.join(posixpath.dirname(at), unquote(target.partition("#")[0]))), " ".join(title.split()))
    return out


def _opened(content: bytes) -> Iterator[tuple]:
    """page, file, contents, pos, level, text, ids and links of an archive, in the order of its spine."""
    book = zipfile.ZipFile(io.BytesIO(content))
    local = lambda tag: tag.rpartition("}")[2]
    where = next(e.get("full-path") for e in ElementTree.fromstring(book.read("META-INF/container.xml")).iter() if local(e.tag) == "rootfile")
    package, folder = ElementTree.fromstring(book.read(where)), posixpath.dirname(where)
    items = {e.get("id"): (unquote(e.get("href", "")), e.get("media-type", ""), e.get("properties") or "") for e in package.iter() if local(e.tag) == "item"}
    titles = _contents(book, items, folder)
    for page, ref in enumerate(e.get("idref") for e in package.iter() if local(e.tag) == "itemref"):
        name = posixpath.normpath(posixpath.join(folder, items[ref][0]))
        for pos, (level, text, ids, links) in enumerate(_Linked().blocks(book.read(name).decode("utf-8"))):
            yield page, name, titles.get(name), pos, level, text, ids, [x | {"file": posixpath.normpath(posixpath.join(posixpath.dirname(name), x["file"])) if x["file"] else name} for x in links]


def blocks(files: DataFrame) -> DataFrame:
    """path, page, file, contents (the page's title there), pos, level, text, ids and links of the blocks of EPUB files (path,
    content). A file that cannot be read gives one block of level -1 with the reason."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        link = pa.list_(pa.struct([("k", pa.int32()), ("number", pa.int32()), ("file", pa.string()), ("frag", pa.string()), ("ids", pa.list_(pa.string()))]))
        kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), link]
        for batch in batches:
            for k in range(len(batch)):  # one archive is opened at a time
                path, content = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                try:
                    found = [(path, *row) for row in _opened(content)]
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, StopIteration, UnicodeDecodeError) as e:
                    found = [(path, 0, "", None, 0, -1, f"unreadable ({type(e).__name__})", [], [])]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], kind) for i, kind in enumerate(kinds)], names=[c.split()[0] for c in _BLOCK.split(", links")[0].split(", ")] + ["links"])

    return files.select("path", "content").mapInArrow(run, _BLOCK)


def with_notes(found: DataFrame) -> DataFrame:
    """path, page, file, contents, pos, level, text and notes of blocks: a note is no block of its own any more, but stands in
    `notes` of the block that cites it, in order, as "Footnote one. ..."; the link that cites it is gone from the text.

    A numbered link is a note's if the block that it leads to, on whichever page of the archive, leads back to it or begins
    with its number, and is not the block itself. Other links keep their text. Where an id stands twice the first counts.
    Lines that only say FOOTNOTES go."""
    shown = lambda c: F.regexp_replace(c, f"{_OPEN}[0-9]+:([0-9]+){_CLOSE}", "[$1]")
    here = ["path", "page", "pos"]
    cites = found.select(*here, F.explode("links").alias("l")).select(*here, "l.*")
    ids = found.select("path", F.col("file"), F.explode("ids").alias("frag"), F.struct("page", "pos").alias("to"), F.col("text").alias("note"), F.col("links").alias("back"))
    ids = ids.groupBy("path", "file", "frag").agg(F.min_by(F.struct("to", "note", "back"), "to").alias("t"))
    both = cites.join(ids, ["path", "file", "frag"]).where((F.col("t.to.page") != F.col("page")) | (F.col("t.to.pos") != F.col("pos")))
    returns = F.exists("t.back", lambda b: F.array_contains("ids", b["frag"]))
    begins = F.regexp_extract(shown(F.col("t.note")), f"^{LABEL}", 1) == F.col("number").cast("string")
    # a note's own link leads back to what cites it: of two blocks that name each other the earlier one cites, and what a
    # note cites itself stays where it is
    led = both.where(returns | begins).withColumns({"here": F.struct("page", "pos"), "to": F.col("t.to")})
    pairs = led.select("path", "here", "to").distinct()
    turned = pairs.select("path", F.col("here").alias("to"), F.col("to").alias("here")).where(F.col("to") < F.col("here"))
    notes = led.join(turned, ["path", "here", "to"], "left_anti")
    within = notes.select("path", F.col("to").alias("here")).distinct()
    notes = notes.join(within, ["path", "here"], "left_anti")
    body = shown(F.regexp_replace("t.note", f"(?s)^(.*?){_OPEN}[0-9]+:[0-9]+{_CLOSE}", "$1"))
    body = F.btrim(F.regexp_replace(F.regexp_replace(F.regexp_replace(body, r"\s+", " "), r"\s+([,.;:!?])", "$1"), r"^\s*\[?\s*[0-9]{1,3}\s*\]?\.?\s*(?=\D|$)", ""))
    notes = notes.select(*here, "k", F.concat(F.lit(f"{_OPEN}"), "k", F.lit(":")).alias("sign"), F.concat(F.lit("Footnote "), T.said(F.col("number")), F.lit(". "), body).alias("said"), (body != "").alias("some"), "to")
    moved = notes.select("path", "to.page", "to.pos").distinct()
    by = notes.groupBy(*here).agg(F.array_sort(F.collect_list(F.struct("k", "sign", "said", "some"))).alias("n"))
    kept = found.join(moved, here, "left_anti").join(by, here, "left")
    none = F.array().cast("array<struct<k: int, sign: string, said: string, some: boolean>>")
    cut = F.aggregate(F.coalesce("n", none), F.col("text"), lambda t, n: F.regexp_replace(t, F.concat(n["sign"], F.lit(f"[0-9]+{_CLOSE}")), F.lit("")))
    out = kept.select(*here[:2], "file", "contents", "pos", "level", F.btrim(F.regexp_replace(F.regexp_replace(shown(cut), " +", " "), r" ([,.;:!?])", "$1")).alias("text"), F.transform(F.filter(F.coalesce("n", none), lambda n: n["some"]), lambda n: n["said"]).alias("notes"))
    return out.where(~F.col("text").rlike("(?i)^FOOTNOTES:?$"))


def chapters(files: DataFrame, least_chars: int = 200) -> DataFrame:
    """path, chapter (from 1), title and text of EPUB files (path, content): a chapter for each page of the spine with
    least_chars or more. Its title is the one of the contents, else its first heading, else its number; notes are read
    after the paragraph that cites them (see `with_notes`). Files that cannot be read, or have no such page, give no rows."""
    b = with_notes(blocks(files).where("level >= 0"))
    lines = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat(F.array("text"), "notes").alias("ts")))), lambda x: x["ts"]))
    heading = F.min_by(F.when(F.col("level").between(1, 3), F.col("text")), F.when(F.col("level").between(1, 3), F.col("pos")))
    pages = b.groupBy("path", "page").agg(F.first("contents").alias("contents"), heading.alias("head"), T.clean(F.array_join(F.filter(lines, lambda t: t != ""), "\n\n")).alias("text"))
    n = F.row_number().over(Window.partitionBy("path").orderBy("page"))
    return pages.where(F.char_length("text") >= least_chars).withColumn("chapter", n).select("path", "chapter", F.coalesce("contents", "head", F.concat(F.lit("Chapter "), "chapter")).alias("title"), "text")
