"""Findings of the fourth round."""

from test_round3 import DOCS, held


def test_a_text_without_words_has_one_blank(spark, tmp_path):
    rows = [(1, "A.", "en", "x"), (2, None, "en", "x"), (3, "", None, None), (4, "É 5 b", "de", "x"), (5, "Ab", "en", "x"), (6, "then Anna went", "en", "x"), (7, "Anna.", "fr", "x")]
    got, want = held(spark, tmp_path, "repaired_texts", documents=(rows, DOCS))
    assert len(got) == 7 and got.equals(want)


def test_empty_texts_and_what_readers_leave_out(spark, tmp_path):
    texts = ["", None, " : \n", "123", " 2024 ", "12345", "[_aside_] so _] it", "so *** END OF it", "a\u0085 b SS.", "x\u0001y\u0002z", "A word."]
    rows = [(4 * i + k, t, "en", "x") for i, t in enumerate(texts) for k in range(4)]
    for name in ("text_kind", "text_readings"):
        got, want = held(spark, tmp_path / name, name, documents=(rows, DOCS))
        assert len(got) == len(rows) and got.equals(want)


def test_words_of_a_long_chapter_are_not_looked_for_in_a_map(spark):
    """A chapter of many different words takes no longer a word than a short one, and other columns come through."""
    from quirespark.operators import repair

    words = [a + b + c for a in "BCDFG" for b in "AEOU" for c in ("ND", "RT", "LM", "ST")]
    rows = [("a", 1, "He saw Bart and Gust. B AND it. " + "  ".join(words * 2) + " . DEST “DUST XIV OF” it", [7]), ("a", 2, None, None), ("b", 1, "BART it\nGUST  XIV OF", [])]
    chapters = spark.createDataFrame(rows, "book string, chapter int, text string, more array<int>")
    frequencies = spark.createDataFrame([(w.lower(), "en", 2.4 if w[0] == "D" else 1.0 if w[0] == "F" else 3.0) for w in words if w[0] != "C"] + [("of", "en", 5.0), ("cand", "de", 5.0)], "word string, lang string, zipf double")
    got = repair.repaired(chapters, frequencies)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "map_from_entries" not in plan
    form = {w: w.title() if w in ("BART", "GUST") else w if w[0] in "CF" else w.lower() for w in words}
    run = "  ".join(form[w] for w in words)
    want = {("a", 1): f"He saw Bart and Gust. Band it. {run[0].upper()}{run[1:]}  {run}. Dest “Dust XIV of” it", ("a", 2): None, ("b", 1): "Bart it\nGust  XIV of"}
    assert {(r.book, r.chapter): r.text for r in got.collect()} == want
    assert sorted((r.book, r.chapter, r.more) for r in got.collect()) == [("a", 1, [7]), ("a", 2, None), ("b", 1, [])]


def test_words_that_are_sorted_come_out_as_hashed_ones(spark, monkeypatch):
    """A lookup of too many rows for a hash table is joined by sorting, with the same result."""
    from quirespark.operators import repair

    rows = [("a", 1, "Old Bart went. BART AND GUST met B AND X YZZ ."), ("b", 1, "It was BART , NO ONE"), (None, 1, "so NO Bart and BART NO")]
    chapters = spark.createDataFrame(rows, "book string, chapter int, text string")
    frequencies = spark.createDataFrame([("and", "en", 5.0), ("no", "en", 2.2), ("no", "en", 1.0), ("one", "en", None)], "word string, lang string, zipf double")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    hashed = repair.repaired(chapters, frequencies)
    monkeypatch.setattr(repair, "HASHED", 0)
    sorted_ = repair.repaired(chapters, frequencies)
    assert "shuffle_hash" in plan(hashed) and "shuffle_hash" not in plan(sorted_)
    assert sorted(map(str, hashed.collect())) == sorted(map(str, sorted_.collect()))
    assert {r.book: r.text for r in hashed.collect()}["a"] == "Old Bart went. Bart and GUST met B And X YZZ."
