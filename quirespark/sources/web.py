"""Web pages as blocks and chapters."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SKIPPED = {"script", "style", "nav", "header", "footer", "aside", "noscript"}
BLOCKS = {"h1": 1, "h2": 2, "h3": 3, "h4": 4, "h5": 5, "h6": 6, "p": 0, "li": 0, "blockquote": 0}


class _Blocks(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.skip, self.open, self.text, self.out = 0, None, [], []

    def _close(self) -> None:
        text = " ".join("".join(self.text).split())
        if self.open is not None and text:
            self.out.append((BLOCKS[self.open], text))
        self.open, self.text = None, []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SKIPPED:
            self.skip += 1
        elif not self.skip and tag in BLOCKS:
            self._close()
            self.open = tag
        elif tag == "br":
            self.text.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag == self.open:
            self._close()

    def handle_data(self, data: str) -> None:
        if self.open and not self.skip:
            self.text.append(data)

    def blocks(self, html: str) -> list[tuple[int, str]]:
        self.feed(html)
        self.close()
        self._close()
        return self.out


def parsed_blocks(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """id, pos, level (1 to 6 for headings, else 0) and text of each block of a page, by an HTML parser."""
    own = pages.select(id_col, F.coalesce("html", F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_Blocks().blocks(h) for h in batch.column(1).to_pylist()]
            owner = [i for i, b in enumerate(found) for _ in b]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(owner, pa.int32())), pa.array([k for b in found for k in range(len(b))], pa.int32()),
                pa.array([x[0] for b in found for x in b], pa.int32()), pa.array([x[1] for b in found for x in b], pa.string()),
            ], names=[id_col, "pos", "level", "text"])

    return own.mapInArrow(run, f"{id_col} {dict(own.dtypes)[id_col]}, pos int, level int, text string")


def blocks(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """The same for regular pages by patterns alone: headings h1, paragraphs and list items outside skipped parts."""
    body = F.regexp_replace("html", r"(?s)<(script|style|nav|header|footer|aside|noscript)\b.*?</\1>", "")
    found = F.regexp_extract_all(body, F.lit(r"(?s)(<(?:h1|p|li)\b[^>]*>.*?</(?:h1|p|li)>)"), 1)
    b = pages.select(id_col, F.posexplode(found).alias("pos", "raw"))
    text = F.regexp_replace(F.regexp_replace("raw", r"(?s)<br\s*/?>", " "), r"(?s)<[^>]*>", "")
    for sign, meant in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(sign), F.lit(meant))
    return b.select(id_col, "pos", F.when(F.col("raw").startswith("<h1"), 1).otherwise(0).alias("level"), F.btrim(F.regexp_replace(text, r"\s+", " ")).alias("text")).where("text != ''")


def chapters(found: DataFrame, by: str = "page_id") -> DataFrame:
    """Chapters start at the shallowest heading level that a book has twice or more; what comes before the first is a
    chapter of its own. by, chapter (from 1), title (null before the first heading) and text."""
    often = found.where("level > 0").groupBy(by, "level").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").groupBy(by).agg(F.min("level").alias("split"))
    w = Window.partitionBy(by).orderBy("pos")
    starts = F.coalesce(F.col("level") == F.col("split"), F.lit(False))
    marked = found.join(often, by, "left").withColumn("starts", starts).withColumn("part", F.sum(F.col("starts").cast("int")).over(w))
    body = F.array_sort(F.collect_list(F.when(~F.col("starts"), F.struct("pos", "text"))))
    c = marked.groupBy(by, "part").agg(F.max(F.when(F.col("starts"), F.col("text"))).alias("title"), body.alias("b"))
    c = c.withColumn("text", F.array_join(F.transform("b", lambda x: x.text), "\n"))
    return c.where("title IS NOT NULL OR text != ''").select(by, F.row_number().over(Window.partitionBy(by).orderBy("part")).alias("chapter"), "title", "text")
