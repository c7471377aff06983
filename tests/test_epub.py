"""EPUB archives with contents and notes."""

import io
import zipfile

from quirespark.sources import epub

LONG = "It went on for a good while, as such days do in the country. " * 4
PACKAGE = '<package xmlns="http://www.idpf.org/2007/opf"><manifest>{items}</manifest><spine>{spine}</spine></package>'


def archive(pages: dict[str, str], contents: str, ncx: bool = False) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>')
        items = "".join(f'<item id="i{k}" href="text/{name}" media-type="application/xhtml+xml"/>' for k, name in enumerate(pages))
        items += '<item id="t" href="toc.x" ' + ('media-type="application/x-dtbncx+xml"/>' if ncx else 'media-type="application/xhtml+xml" properties="nav"/>')
        z.writestr("OPS/book.opf", PACKAGE.format(items=items, spine="".join(f'<itemref idref="i{k}"/>' for k in range(len(pages)))))
        z.writestr("OPS/toc.x", contents)
        for name, body in pages.items():
            z.writestr(f"OPS/text/{name}", f"<html><body>{body}</body></html>")
    return out.getvalue()


def test_notes_and_titles(spark):
    one = (
        f'<h2>A heading</h2><p>{LONG}He left<a id="m1"></a><a href="notes.xhtml#n1">[1]</a> at noon.<sup><a id="m2" href="#n2">2</a></sup> See <a href="two.xhtml#p9">9</a>.</p><p>Next.</p>'
        '<div class="footnotes"><p>FOOTNOTES:</p><p><a id="n2"></a><a href="#m2">[2]</a> A note on <i>this</i> page .</p></div>'
    )
    two = f'<p>Short paragraph.</p><p>{LONG}</p><p id="p9">Nothing of a note.</p>'
    notes = f'<p>{LONG}</p><p id="n1"><a href="one.xhtml#m1">1</a> At noon, or 12.</p>'
    pages = {"one.xhtml": one, "blank.xhtml": "<p>Copyright.</p>", "two.xhtml": two, "notes.xhtml": notes}
    nav = '<html xmlns="http://www.w3.org/1999/xhtml"><body><nav><ol><li><a href="text/one.xhtml#a">The  First</a></li><li><a href="text/one.xhtml">Again</a></li></ol></nav></body></html>'
    ncx = '<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint><navLabel><text>Second</text></navLabel><content src="text/two.xhtml#x"/></navPoint></navMap></ncx>'
    files = spark.createDataFrame([("a.epub", bytearray(archive(pages, nav))), ("b.epub", bytearray(archive({"two.xhtml": two}, ncx, True))), ("bad.epub", bytearray(b"no zip"))], "path string, content binary")
    rows = {(r.path, r.chapter): r for r in epub.chapters(files).collect()}
    assert {k: r.title for k, r in rows.items()} == {("a.epub", 1): "The First", ("a.epub", 2): "Chapter 2", ("a.epub", 3): "Chapter 3", ("b.epub", 1): "Second"}
    assert rows["a.epub", 1].text == f"A heading\n\n{LONG}He left at noon. See [9].\n\nFootnote one. At noon, or 12.\n\nFootnote two. A note on this page.\n\nNext."
    assert rows["a.epub", 3].text == LONG.strip() and rows["b.epub", 1].text.endswith("Nothing of a note.")
    assert [(r.path, r.text) for r in epub.blocks(files).where("level < 0").collect()] == [("bad.epub", "unreadable (BadZipFile)")]
