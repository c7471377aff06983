"""Texts put right with the book's own evidence."""

from quirespark.operators import repair

KIND = "book string, chapter int, text string"
WORDS = "word string, lang string, zipf double"


def test_a_spoilt_book_is_put_right(spark):
    rows = [
        ("a", 1, "It was then that Douglass and old John met Patrick and Henry in Boston."),
        ("a", 2, "Note from the original file: made by hand.\n\nContents\n\nMr. D OUGLASS and P ATRICK H ENRY , of old , said JOHN went .\n\nLETTER FROM WENDELL PHILLIPS, ESQ.\n\nHe cried: “NO COMPROMISE WITH SLAVERY !” in 1841 .\n\nTranscriber’s Note:"),
        ("a", 3, "THE USA and Louis XIV. QWZRT sat with JOHN DOUGLASS, Esq., of B OSTON. Yes, Esq. Then X YZZQ."),
        ("a", 4, None), ("a", 5, ""), ("b", 1, "so JOHN went."),
    ]
    frequencies = spark.createDataFrame([(w, "en", 5.0) for w in "no compromise with slavery the and of".split()] + [("john", "fr", 5.0)], WORDS)
    got = {(r.book, r.chapter): r.text for r in repair.repaired(spark.createDataFrame(rows, KIND), frequencies).collect()}
    assert got["a", 1] == rows[0][2]
    assert got["a", 2] == "Mr. Douglass and Patrick Henry, of old, said John went.\n\nLetter from Wendell Phillips, Esquire.\n\nHe cried: “No compromise with slavery!” in 1841."
    assert got["a", 3] == "The USA and Louis XIV. QWZRT sat with John Douglass, Esquire, of Boston. Yes, Esquire. Then X YZZQ."
    assert got["a", 4] is None and got["a", 5] == "" and got["b", 1] == "so JOHN went."  # another book has no John
    assert repair.repaired(spark.createDataFrame([], KIND), frequencies).count() == 0
