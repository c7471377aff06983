"""The list of words and phrases of a book."""

from pyspark.sql import functions as F

from quirespark.operators import wordlist

KIND = "book string, doc_id int, text string"


def phrases(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(wordlist.phrases_in(F.col("t")).alias("p")).first().p


def test_phrases_have_connectors_and_no_leading_words(spark):
    assert phrases(spark, "He saw the Allées\nde Meilhan. From La Grange he went to Château d’If, and Then The Only.") == ["Allées de Meilhan", "La Grange", "Château d’If"]
    assert phrases(spark, "Fort of Saint Nicholas") == ["Fort of Saint Nicholas"] and phrases(spark, "Palais de la Justice") == []
    assert phrases(spark, "From the Alps. But In The. iPhone Case") == [] and phrases(spark, "Anna,  Bob") == [] and phrases(spark, "Anna's Bob-Lee ran") == ["Anna's Bob-Lee"]
    assert phrases(spark, "d’Artagnan Porthos d'If") == ["Porthos d'If"] and phrases(spark, "") == []


def test_uses_of_words(spark):
    rows = [("b", 1, "Smith met M. Noir. Then smith’s ANNA said, “Anna came.” Mr. Noir's XVII"), ("b", 2, "NOIR the NOIR"), ("c", 1, None), ("c", 2, "LOUD")]
    got = {(r.book, r.key): r for r in wordlist.uses(spark.createDataFrame(rows, KIND), "book", "doc_id").collect()}
    assert (got["b", "noir"].surface, got["b", "noir"]["count"], got["b", "noir"].mid, got["b", "noir"].init) == ("Noir", 4, 3, 1)
    assert (got["b", "smith"].lower, got["b", "smith"].init, got["b", "anna"].surface, got["b", "anna"].init) == (1, 1, "Anna", 1)
    assert got["c", "loud"].surface == "Loud" and ("b", "m") not in got


def entries(spark, rows):
    return spark.createDataFrame([("b", t.lower(), t, k, False, lang, 0.0, "auto", w) for t, k, lang, w in rows], "book string, key string, term string, kind string, known boolean, lang string, zipf double, source string, words double")


def test_language_of_a_book(spark):
    rows = [("Réserve", "name", "fr", None), ("Allées", "name", "fr", None), ("procureur", "word", "fr", None), ("Danglars", "name", None, None), ("overtook", "word", None, None), ("chance", "word", "it", None), ("promis'd", "name", None, None), ("Hyde Park", "phrase", None, 4.0), ("Fort La Tour", "phrase", None, 0.0)]
    got = {r.term: (r.lang, r.lang_src) for r in wordlist.with_book_language(entries(spark, rows)).collect()}
    assert got == {"Réserve": ("fr", "wordfreq"), "Allées": ("fr", "wordfreq"), "procureur": ("fr", "wordfreq"), "Danglars": ("fr", "book"), "overtook": (None, None), "chance": (None, None), "promis'd": (None, None), "Hyde Park": (None, None), "Fort La Tour": ("fr", "book")}
    two = wordlist.with_book_language(entries(spark, [("Banquo", "name", None, None), ("Cawdor", "name", "it", None)])).collect()
    assert all(r.lang is None for r in two)
    hint = spark.createDataFrame([("b", "de")], "book string, hint string")
    assert {r.term: (r.lang, r.lang_conf) for r in wordlist.with_book_language(entries(spark, [("Banquo", "name", None, None)]), hints=hint).collect()} == {"Banquo": ("de", 1.0)}


def test_word_list_with_labels_and_own_entries(spark):
    text = "They saw Danglars and Danglars. The procureur of Allées de Meilhan, the Réserve, was known. Now London, London is north. XVII. He walked."
    docs = spark.createDataFrame([("b", 1, text), ("e", 1, None)], KIND)
    dictionary = spark.createDataFrame([(w,) for w in "they saw and the of was known now london is north walk".split()], "word string")
    frequencies = spark.createDataFrame([("procureur", "fr", 4.0), ("allées", "fr", 3.0), ("réserve", "fr", 4.0), ("réserve", "en", 1.0), ("north", "en", 5.0), ("north", "fr", 2.0)], "word string, lang string, zipf double")
    labels = spark.createDataFrame([("b", "london", "place", 2), ("b", "danglars", "name", 1)], "book string, key string, kind string, n long")
    own = spark.createDataFrame([("b", "Réserve", "it"), ("b", "Mondego", None)], "book string, term string, lang string")
    got = {r.term: (r["count"], r.kind, r.known, r.lang, r.source) for r in wordlist.word_list(docs, dictionary, frequencies, labels=labels, own=own).collect()}
    assert got == {
        "Danglars": (2, "name", False, None, "auto"), "procureur": (1, "word", False, "fr", "auto"), "Allées": (1, "name", False, "fr", "auto"), "Meilhan": (1, "name", False, None, "auto"), "Réserve": (1, "name", False, "it", "user"),
        "Mondego": (0, "word", False, None, "user"), "London": (2, "place", True, None, "auto"),
    }
    hint = spark.createDataFrame([("b", "fr")], "book string, hint string")
    assert ("Allées de Meilhan", "phrase", "fr") in {(r.term, r.kind, r.lang) for r in wordlist.word_list(docs, dictionary, frequencies, hints=hint).collect()}
    assert wordlist.word_list(docs.limit(0), dictionary, frequencies).count() == 0


def test_repaired_phrases(spark):
    rows = [("b", "From La Grange", 2, "phrase", "auto"), ("b", "La Grange", 3, "phrase", "auto"), ("b", "The From", 1, "phrase", "auto"), ("b", "In Rome", 1, "phrase", "user"), ("b", "in", 4, "word", "auto"), ("b", "But Rome", 1, "phrase", "auto")]
    got = {(r.term, r["count"]) for r in wordlist.repaired(spark.createDataFrame(rows, "book string, term string, count long, kind string, source string")).collect()}
    assert got == {("La Grange", 5), ("In Rome", 1), ("in", 4)}


def test_long_runs_of_capitals_need_no_stack(spark):
    assert [len(p) for p in phrases(spark, "Anna Bob-" + "Lee-" * 20_000 + "x " + "Carl Dan " * 20_000)] == [9 + 80_000 + 1 + 1 + 180_000 - 1]
