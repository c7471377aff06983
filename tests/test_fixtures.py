"""Marks that the tables lack: readers and edits on small texts with known results."""

from pyspark.sql import functions as F

from quirespark.operators import desk
from quirespark.sources import readers


def rows(frame, *order):
    return [tuple(r) for r in frame.orderBy(*order).collect()]


def test_readers_of_lines(spark):
    lines = [(0, 0, "A | 1"), (0, 1, "# B | 5"), (0, 2, "b|x"), (1, 0, "b | 9"), (0, 3, "a|2"), (1, 1, "no pair")]
    assert rows(readers.pairs(spark.createDataFrame(lines, "priority int, line_no int, line string")), "key") == [("a", "2"), ("b", "9")]
    lines = [(0, "chat\tʃa, tʃa"), (1, "Chat\tkat"), (2, "eau\to"), (3, "none")]
    assert rows(readers.dictionary(spark.createDataFrame(lines, "line_no int, line string")), "word") == [("chat", "ʃa"), ("eau", "o")]
    texts = ["1:1 In the start.", "1:2 He was.", "1:1 In the [beginning].", "1:3 ¶ All things.", "1:4 In him.", "2:1 And the third day."]
    lines = [(i, f"John {t}") for i, t in enumerate(texts)] + [(99, "not a verse")]
    assert rows(readers.scripture(spark.createDataFrame(lines, "line_no int, line string"), verses=3), "chapter", "para") == [
        ("John", 1, 0, "In the beginning. He was. All things."), ("John", 1, 1, "In him."), ("John", 2, 0, "And the third day."),
    ]


def test_readers_of_books(spark):
    book = lambda t: spark.createDataFrame([("b", t), ("n", None), ("e", "")], "doc_id string, text string")
    assert rows(readers.verse_chapters(book("1:1 One. 1:2 Two.\n2:1 Three.")), "chapter") == [("b", 1, "One.\n\nTwo."), ("b", 2, "Three.")]
    many = readers.verse_chapters(book(" ".join(f"1:{i % 1000} x" for i in range(3000)))).collect()
    assert len(many) == 1 and many[0].text.count("x") == 3000
    text = "Front matter\nCHAPTER I. The Start\n\nIt began on a quiet day then.\n\nChapter 2\nIt went on to another day.\nChapter 3\nToo short"
    assert rows(readers.headed_chapters(book(text), 20).drop("text"), "chapter") == [("b", 1, "CHAPTER I. The Start"), ("b", 2, "Chapter 2")]
    text = "ACT I\nSCENE I. A place.\nFIRST WITCH.\nWhen shall we meet?\n[_Thunder._]\nIn thunder?\nSECOND WITCH.\nWhen the day is done.\nSCENE II. A camp.\nDUNCAN.\nWhat man is that?"
    assert [r[2:] for r in rows(readers.play_lines(book(text)), "n")] == [
        ("I", "I", "First Witch", "When shall we meet? In thunder?"), ("I", "I", "Second Witch", "When the day is done."), ("I", "II", "Duncan", "What man is that?"),
    ]


def test_edits_of_tables(spark):
    chunks = spark.createDataFrame([("s:0", "old"), ("s:1", "changed since")], "key string, text string")
    fixes = spark.createDataFrame([("s:0", "old", "new"), ("s:1", "before", "lost")], "key string, was string, new string")
    assert rows(desk.guarded_fixes(chunks, fixes, "key"), "key") == [("s:0", "new"), ("s:1", "changed since")]
    counts = spark.createDataFrame([("ain't", 4, "eɪnt"), ("goin'", 2, "ɡoʊɪn")], "token string, count long, ipa string")
    lexicon = spark.createDataFrame([("ain't", ""), ("jes'", "dʒɛs")], "token string, ipa string")
    assert rows(desk.filled(counts, lexicon, "token", "ipa").select("token", "count", "ipa"), "token") == [("ain't", 4, "eɪnt"), ("goin'", 2, "ɡoʊɪn"), ("jes'", None, "dʒɛs")]
    heads = [("b", 0, "CHAPTER IV", "The Storm"), ("b", 1, "The storm", "The Storm"), ("b", 2, "It began.", "The Storm"), ("c", 1, "No heading here.", "X Y"), ("c", 2, "Chapter 3 of my life.", "X Y")]
    left = desk.without_headings(spark.createDataFrame(heads, "book string, pos int, text string, title string"), "book", "pos", "title").drop("title")
    assert rows(left, "book", "pos") == [("b", 2, "It began."), ("c", 1, "No heading here."), ("c", 2, "Chapter 3 of my life.")]
    freq = [("chateau", "fr", 4.5), ("chateau", "en", 2.9), ("home", "en", 5.9), ("home", "de", 4.0), ("haus", "de", 5.5), ("haus", "en", 3.0)]
    words = spark.createDataFrame([("chateau",), ("home",), ("haus",), ("xyzt",)], "word string")
    likeliest = desk.likeliest(words, spark.createDataFrame(freq, "word string, lang string, zipf double"), 1.0, 2.5, "en")
    assert rows(likeliest, "word") == [("chateau", "fr"), ("haus", "de"), ("home", None), ("xyzt", None)]


def test_choices(spark):
    probs = [("Ann", True, {"DE": 0.8, "US": 0.2}), ("Hans", False, {"DE": 0.9, "US": 0.1}), ("Hans", False, {"DE": 0.7, "US": 0.3}), ("Lee", False, {"DE": 0.5, "US": 0.5})]
    origins = desk.origins(spark.createDataFrame(probs, "name string, in_dictionary boolean, probs map<string,double>"), "name", "probs")
    assert rows(origins.select("name", "setting"), "name") == [("Ann", "US"), ("Hans", "DE"), ("Lee", "US")]
    asked = [("q1", "yes", 0.9), ("q1", "no", 0.1), ("q1", "yes", 0.3), ("q1", "no", 0.7), ("q2", "yes", 0.5), ("q2", "no", 0.5), ("q2", "yes", 0.4), ("q2", "no", 0.6)]
    best = desk.debiased(spark.createDataFrame(asked, "key string, option string, p double"), "key", "option", "p")
    assert rows(best.select("key", "choice", F.round("p", 6)), "key") == [("q1", "yes", 0.6), ("q2", "no", 0.55)]
    stages = [("a", 1, "read", "done"), ("a", 2, "cast", "recommended"), ("a", 3, "prepare", "stale"), ("b", 2, "listen", "recommended"), ("c", 1, "read", "done")]
    assert rows(desk.next_step(spark.createDataFrame(stages, "book string, pos int, stage string, status string"), "book"), "book") == [("a", "prepare"), ("b", "listen")]


def test_dialect_words_go_into_the_lexicon(spark):
    from quirespark.operators import names

    docs = spark.createDataFrame([("b", "He's runnin' to Epps' place, jes’ so; ain't he? 'Many' jes' ran."), ("b", None)], "book string, text string")
    sounds = spark.createDataFrame([("jes'", "dʒɛs"), ("jes'", None)], "token string, ipa string")
    found = names.dialect_counts(docs, "book", sounds)
    assert rows(found, "token") == [("b", "jes'", 2, "dʒɛs"), ("b", "runnin'", 1, None)]
    lexicon = spark.createDataFrame([("Anna", "ana", "name", "auto"), ("Jes’", None, None, "auto")], "term string, ipa string, kind string, source string")
    assert rows(names.with_dialect(lexicon, found), "term") == [("Anna", "ana", "name", "auto"), ("Jes’", "dʒɛs", "dialect", "auto")]
    users = spark.createDataFrame([("jes'", "", "x", "user")], "term string, ipa string, kind string, source string")
    assert rows(names.with_dialect(users, found), "term") == [("jes'", "", "x", "user")]
    assert rows(names.with_dialect(users.limit(0), found), "term") == [("jes'", "dʒɛs", "dialect", "auto")]


def test_queue_writes_on_odd_rows(spark):
    from quirespark.operators import queue

    new = spark.createDataFrame([("1", "/w/a/", None, "", None, True), ("2", "/w/b", "B", "2026-02-30 10:00", "", True), ("3", "/w/c", "C", "", "9-10", True), ("4", "/w/d", "D", "", "", None)], "id string, work string, title string, not_before string, window string, prepared boolean")
    jobs = spark.createDataFrame([], "id string, work string, title string, not_before string, window string, status string, created string")
    assert [(r.id, r.title, r.status) for r in queue.added(jobs, new, "2026-01-01 00:00").collect()] == [("1", "a", "queued")]
    runs = spark.createDataFrame([("a", "e", 10, 0.0, 1), ("a", "e", 10, 5.0, 2), ("a", "e", 11, 6.0, 3), ("b", "e", 0, 5.0, 4), ("c", "e", 1, 1.0, None)], "id string, engine string, chars int, seconds double, n int")
    assert [(r.id, r.chars) for r in queue.recorded(runs, ["id", "engine"], ["n"]).collect()][0] == ("a", 11)
    voices = spark.createDataFrame([("b", "k", "m"), ("a", "k", None), ("c", "k", "f"), ("d", "x", "f")], "name string, engine string, gender string")
    assert [r.name for r in queue.voices_for(voices, "k", "f").collect()] == ["c", "a", "b"] and [r.name for r in queue.voices_for(voices, "k", None).collect()] == ["a", "b", "c"]
