"""Books from files of many kinds, and books as files."""

import io
import zipfile

from pyspark.sql import functions as F

from quirespark.sources import library, sinks


def test_files_of_any_kind_are_books(spark, tmp_path):
    long = "It went on for a good while, as such days do in the country. " * 2
    (tmp_path / "two_parts.txt").write_text(f"Front\nCHAPTER I\n{long}\nCHAPTER II\n{long}\n")
    (tmp_path / "a-letter.txt").write_text("Dear Anna,\n\n\n\nall is  well.\n")
    (tmp_path / "notes.md").write_text("# One\n\nFirst.\n\n# Two\n\nSecond.\n")
    (tmp_path / "page.html").write_text("<html><body><h1>One</h1><p>A.</p><h1>Two</h1><p>B.</p></body></html>")
    (tmp_path / "odd.xyz").write_text("?")
    (tmp_path / "broken.epub").write_bytes(b"no zip")
    (tmp_path / "empty.txt").write_text(" \n")
    books = library.read_books(spark, str(tmp_path) + "/*").withColumn("file", F.regexp_extract("path", "([^/]+)$", 1))
    rows = {(r.file, r.chapter): r for r in books.collect()}
    assert {k: rows[k].title for k in rows if k[1]} == {
        ("two_parts.txt", 1): "CHAPTER I", ("two_parts.txt", 2): "CHAPTER II", ("a-letter.txt", 1): "Dear Anna,", ("notes.md", 1): "One", ("notes.md", 2): "Two", ("page.html", 1): "One", ("page.html", 2): "Two",
    }
    assert rows["a-letter.txt", 1].text == "Dear Anna,\n\nall is well."
    assert (rows["odd.xyz", 0].problem, rows["empty.txt", 0].problem) == ("cannot read .xyz", "no text") and "unreadable" in rows["broken.epub", 0].problem
    assert library.read_books(spark, str(tmp_path) + "/*", 1).where("chapter > 0").count() == 4
    reports = {r.path.rsplit("/", 1)[1]: r for r in library.parse_reports(books.drop("file")).collect()}
    assert len(reports) == 7 and reports["odd.xyz"].level == "bad" and reports["two_parts.txt"].reader == "txt" and reports["two_parts.txt"].chapters == 2


def test_epub_with_author_cover_and_opening(spark):
    chapters = spark.createDataFrame([("b", 1, None, "Read by Ann.", True), ("b", 2, "One", "A line\nbroken.\n\nNext.", False), ("c", 1, "Only", "x", None)], "book string, index int, title string, text string, opening boolean")
    books = spark.createDataFrame([("b", "Tom & Co", "A <Writer>", bytearray(b"jpeg")), ("z", None, None, None)], "book string, title string, author string, cover binary")
    files = {r.book: zipfile.ZipFile(io.BytesIO(bytes(r.content))) for r in sinks.epub_files(chapters, books).collect()}
    opf, page = files["b"].read("OEBPS/book.opf").decode(), files["b"].read("OEBPS/c0002.xhtml").decode()
    assert "<dc:title>Tom &amp; Co</dc:title>" in opf and "<dc:creator>A &lt;Writer&gt;</dc:creator>" in opf and files["b"].read("OEBPS/cover.jpg") == b"jpeg"
    assert "<p>A line<br/>broken.</p>" in page and "<p>Next.</p>" in page and "<h1>One</h1>" in page
    assert "<h1>" not in files["b"].read("OEBPS/c0001.xhtml").decode() and ">Opening</a>" in files["b"].read("OEBPS/nav.xhtml").decode()
    assert "OEBPS/cover.jpg" not in files["c"].namelist() and "<dc:title>c</dc:title>" in files["c"].read("OEBPS/book.opf").decode() and "OEBPS/style.css" in files["c"].namelist()


def test_marks_of_a_titled_book(spark):
    rows = spark.createDataFrame([("b", 1, "A", 1.5, "Book", "Ann"), ("b", 2, "B", 2.0, "Book", "Ann")], "book string, n int, title string, s double, name string, author string")
    marks = sinks.chapter_marks(rows, "book", "n", "title", "s", "name", "author").first().marks
    assert marks.startswith(";FFMETADATA1\ntitle=Book\nartist=Ann\nalbum=Book\ngenre=Audiobook\n[CHAPTER]\n") and "START=1500\nEND=3500\ntitle=B" in marks


def test_plain_texts_are_read_as_what_they_are(spark):
    long = "It went on for a good while, as such days do in the country. " * 5
    play = (
        "Title: The Play\nAuthor: A. Writer\n\nContents\n\nACT I\n\nSCENE I. A hall\n\nACT II\n\nSCENE I. A road\n\n" + "ACT I\n\nSCENE I. A\nhall.\n\n [_A noise._]\n Enter\n all.\n\n"
        + "FIRST LORD.\nGood day.\n\n" * 30 + "SCENE II. A wood.\n\nFIRST LORD.\nTrees and more trees, as far as one can see.\n\nACT II\n\nSCENE I. A road.\n\n" + "SECOND LORD.\nGo [_aside_] now.\n\n" * 30 + "*** END OF IT\n\nmore"
    )
    verse = "".join(f"{c}:{v} and it was so in the land of the fathers\n" for c in (1, 2) for v in range(1, 15))
    contents = "".join(f"Chapter {i}\n" for i in range(1, 9)) + "\n" + long
    times = " ".join(f"at {(7 * i) % 23 + 1}:{(11 * i) % 50 + 3} it rang" for i in range(32)) + " "
    sentence = f"Part of the day was over.\n{long}\nPart of it was not.\n{long}"
    rows = [("play", play), ("verse", verse), ("headed", f"A Book\n\nCHAPTER ONE\n\n{long}\n\nChapter the last\n\nChapter Twenty-two: The End\n\n{long}"), ("contents", contents), ("times", times * 2), ("part", sentence), ("null", None), ("short", "Hello.")]
    got = {r.doc_id: r for r in library.readings(spark.createDataFrame([(i, f"The {i}", t) for i, t in rows], "doc_id string, name string, text string")).collect()}
    assert {i: (r.reader, r.level, len(r.chapters)) for i, r in got.items()} == {
        "play": ("play", "ok", 3), "verse": ("verse", "ok", 2), "headed": ("chapters", "ok", 2), "contents": ("single", "ok", 1), "times": ("single", "ok", 1), "part": ("single", "ok", 1), "null": ("single", "bad", 1), "short": ("single", "bad", 1),
    }
    assert (got["play"].title, got["play"].author) == ("The Play", "A. Writer") and [c.heading for c in got["play"].chapters] == ["Act one, scene one. A hall", "Act one, scene two. A wood", "Act two, scene one. A road"]
    assert got["play"].chapters[0].text.startswith("FIRST LORD.\nGood day.\n\nFIRST") and "noise" not in got["play"].chapters[0].text and got["play"].chapters[2].text.endswith("Go  now.")
    assert got["contents"].tried == ["chapters", "chapters_loose", "single"] and got["verse"].title == "The verse" and got["headed"].title == "A Book"
    assert [c.title for c in got["headed"].chapters] == ["CHAPTER ONE", "Chapter Twenty-two: The End"]
    assert library.readings(spark.createDataFrame([], "doc_id string, name string, text string")).count() == 0
