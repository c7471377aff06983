"""Queries against their SQL on texts that look like the marks their readers go by."""

import duckdb
import pytest

from quirespark.queries import ORACLES, QUERIES

DOCS = "doc_id long, text string, lang string, source string"
TALKS = "conv_id long, turn long, role string, text string"


def held(spark, tmp_path, name, **tables):
    """The rows of a query and of its SQL over small tables."""
    con = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{tmp_path}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = QUERIES[name](spark, f"file://{tmp_path}").toPandas()
    want = con.execute(ORACLES[name]).df()[list(got.columns)]
    return tuple(f.astype(object).where(f.notna(), None).astype(str).sort_values(list(got.columns)).reset_index(drop=True) for f in (got, want))


def test_said_lines_are_no_speakers(spark, tmp_path):
    said = ["Who is it?\nSS.\n\nACT V\n  SCENE II. Far.\nNo one.", "SS.", None, "All is well."]
    rows = [(1, i, "user" if i % 2 else "assistant", t) for i, t in enumerate(said)]
    got, want = held(spark, tmp_path, "play_lines", conversations=(rows, TALKS))
    assert len(got) == 2 and got.equals(want)


def test_documents_like_marks_are_running_text(spark, tmp_path):
    texts = ["SS.", "Chapter IV", "Part one of it", "SCENE II. Far", "ACT I", "Letter 5: to her", "O'NEIL-A.", "A word."]
    rows = [(4 * i + k, t, "en", "x") for i, t in enumerate(texts) for k in range(4)]
    got, want = held(spark, tmp_path, "text_kind", documents=(rows, DOCS))
    assert len(got) == len(rows) and got.equals(want)
    got, want = held(spark, tmp_path / "again", "text_readings", documents=(rows, DOCS))
    assert got.equals(want)


def test_three_letters_are_no_title(spark, tmp_path):
    rows = [(1, "key aEsq/9 esq. x", "en", "x"), (2, "Esq", "en", "x"), (3, "then Anna went to esq town", "en", None)]
    got, want = held(spark, tmp_path, "repaired_texts", documents=(rows, DOCS))
    assert got.equals(want)


def test_contexts_of_names_are_not_shuffled_whole(spark, tmp_path, capsys):
    rows = [(1, "Der Hut. Elle sat. It was so.\n\n \nThe idiot! And der Weg.", "de", "x"), (2, "Elle", "fr", "x"), (3, None, "fr", "x"), (4, "License of Der Elle", None, None)]
    got, want = held(spark, tmp_path, "name_context", documents=(rows, DOCS))
    assert len(got) == 7 and got.equals(want)
    QUERIES["name_context"](spark, f"file://{tmp_path}").explain()
    plan = capsys.readouterr().out
    assert plan.count("hashpartitioning") == 1 and "SortMergeJoin" not in plan and "Window" not in plan


def test_a_mean_at_the_bound_does_not_depend_on_how_rows_are_dealt(spark):
    from quirespark.operators import desk

    ps = [0.1, 0.2, 0.3]
    rows = [(i, name, False, {"DE": p}) for name, order in (("up", ps), ("down", ps[::-1])) for i, p in enumerate(order)]
    rows += [(i, "none", False, {"DE": None}) for i in range(2)]
    sums = {name: 0.0 for name in ("up", "down")}
    for _, name, _, p in rows[: 2 * len(ps)]:
        sums[name] += p["DE"]
    assert sums["up"] != sums["down"]
    bound = max(sums.values()) / len(ps)
    for dealt in (rows, rows[::-1], rows[1::2] + rows[::2]):
        table = spark.createDataFrame(dealt, "o long, name string, in_dictionary boolean, probs map<string, double>").repartition(5)
        got = {r["name"]: r.setting for r in desk.origins(table, "name", "probs", bound, order="o").collect()}
        assert got == {n: "DE" if s == max(sums.values()) else "US" for n, s in sums.items()} | {"none": "US"}


def test_chunks_of_few_texts_are_held_at_once(spark, monkeypatch):
    import pyarrow as pa

    from quirespark.operators import books

    runs = []
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, f, schema: runs.append(f) or self)
    books.chunk_plan(spark.createDataFrame([(1, "x")], "doc_id long, text string"))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1000)), "text": ["One. Two." if i % 3 else "" for i in range(1000)]})
    out = list(runs[0](iter([batch])))
    assert max(len(b) for b in out) <= 64 and [i for b in out for i in b.column(0).to_pylist()] == [i for i in range(1000) if i % 3]


def test_quotes_are_dealt_by_a_number_of_parts(spark):
    """Chapters of few bytes and much work are not put together in a task or two; whole numbers and maps come through."""
    from quirespark.operators import attribution

    rows = [(c, i, i, "Ann" if i == 0 else None, "f" if i == 1 else None, None, False, False, False, [], [], ["Ann", "Bob"], {"Ann": "f", "Bob": "m"}) for c in range(40) for i in range(4)]
    kind = "chapter int, pos int, para int, explicit string, pron string, lead string, split boolean, cont boolean, other boolean, addressed array<string>, recent array<string>, cands array<string>, genders map<string,string>"
    got = attribution.attribute(spark.createDataFrame(rows, kind))
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
    by = {}
    for r in got.collect():
        by.setdefault(r.chapter, []).append((r.pos, r.speaker))
    assert len(by) == 40 and len({tuple(sorted(v)) for v in by.values()}) == 1


def test_answers_are_put_once_a_queue(spark):
    """A long answer is turned into what is shown before it meets the messages, and shows the same."""
    from pyspark.sql import functions as F

    from quirespark.operators import answers

    state = spark.createDataFrame([(1, "now", "1. x", "✓ y"), (2, "nothing", None, None)], "queue long, current string, queued string, done string")
    messages = spark.createDataFrame([(q, t) for q in (1, 2, 3) for t in ("Status!", " Queue.", "finished", "help", "hello there")], "queue long, text string")
    got = answers.answered(messages, state, shown=F.md5)
    assert "md5(" not in got._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    want = answers.answered(messages, state).withColumn("answer", F.md5("answer"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_trailing_pace_adds_each_second_once(spark):
    """No window looks again at the events of the last minutes for each event."""
    from quirespark.operators import events

    rows = spark.sql("SELECT id AS event_id, 'a' AS k, timestamp_seconds(id DIV 50) AS ts FROM range(1000)")
    got = events.trailing_pace(rows, "k", "ts", 10, 6, 0.25)
    assert "RangeFrame, -" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert all(r.n == r.peak == min(600, r.event_id // 50 + 1) * 50 and not r.slow for r in got.collect())


def test_runs_are_not_dealt_by_their_few_engines(spark):
    from quirespark.operators import queue

    rows = spark.createDataFrame([(i, "job" if i % 2 else None, "AB"[i % 2], 100 * i, 30.0) for i in range(20)], "id long, kind string, engine string, chars long, seconds double")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert "SortMergeJoin" not in queue.without_cached(rows)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_words_are_counted_without_sentences(spark):
    from quirespark.operators import names

    docs = spark.createDataFrame([(1, "Mr. Éa went. Then\n\n He\u0001she, 3x. \"Go!\" VII"), (2, None), (3, ""), (4, " a. B\tc\r\nd a")], "doc_id long, text string")
    got, want = names.word_counts(docs), names.tokens(docs).groupBy("word").count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "regexp_replace" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_words_of_a_book_are_counted_without_sorting_them(spark):
    """The first place of a surface is one number, null ids first, as with ids that are text."""
    from quirespark.operators import wordlist

    rows = [(5, "Dolor dolOr sit"), (-7, "DolOr. Dolor Amet"), (None, "doloR AMET sit"), (2**40, "aMet dolor")]
    docs = spark.createDataFrame([("b", i, t) for i, t in rows], "book string, doc_id long, text string")
    by_text = docs.selectExpr("book", "CASE WHEN doc_id IS NULL THEN NULL WHEN doc_id = -7 THEN 'a' WHEN doc_id = 5 THEN 'b' ELSE 'c' END AS doc_id", "text")
    got = wordlist.uses(docs, "book", "doc_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wordlist.uses(by_text, "book", "doc_id").collect()))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString().count("SortAggregate")
    assert plan(wordlist.uses(docs, "book", "doc_id")) < plan(wordlist.uses(by_text, "book", "doc_id"))


def test_chapters_are_judged_where_they_lie(spark, monkeypatch):
    """The figures of an array of chapters are those of its rows, and a text meets its kind without a join."""
    from pyspark.sql import functions as F

    from quirespark.operators import books
    from quirespark.sources import library

    sizes = {"a": [10, 3000, None], "b": [70_000], "c": [None], "d": [100, 120, 90, 130, 60_000, 5, 140], "e": [1000] * 5, "f": [600, 700, 800, 900]}
    rows = [(b, i, None if b == "a" else f"t{i % 2}" if b == "e" else f"t{i}", None if n is None else "é" * n, 8000 if b == "f" else 4000) for b, ns in sizes.items() for i, n in enumerate(ns)]
    chapters = spark.createDataFrame(rows, "book string, chapter int, title string, text string, whole long")
    made = chapters.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("chapter", "title", "text"))).alias("cs"), F.max("whole").alias("whole"))
    got = sorted(map(tuple, books.validated(made, "cs", "whole").select("book", "notes", "level").collect()))
    want = books.validate(chapters, "book", "title", "whole").select("book", "notes", "level")
    assert len({r[1] for r in got}) > 4 and got == sorted(map(tuple, want.collect()))
    plans, freeze = {}, library.freeze
    monkeypatch.setattr(library, "freeze", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()) and freeze(df, name))
    texts = spark.createDataFrame([(1, "a", "Chapter 1\n\n" + "x " * 100 + "\n\nChapter 2\n\n" + "y " * 100), (2, "b", "Plain."), (3, "c", None)], "doc_id long, name string, text string")
    read = {r.doc_id: (r.reader, r.level, len(r.chapters)) for r in library.readings(texts).collect()}
    assert read == {1: ("chapters", "ok", 2), 2: ("single", "bad", 1), 3: ("single", "bad", 1)}
    assert "Join" not in plans["texts"] and plans["readings"].count("Join") == 1


def test_few_terms_go_to_the_texts(spark, monkeypatch):
    """Texts are not shuffled for a small lexicon, and come out as by the join with a large one."""
    from quirespark.operators import speech

    texts = ["Of  the idiot, OF THE IDIOT's; of\nThe", "of", "The", "", None, "Élan o’er O'ER o'er. the the of the", " the.", "of theof the", "ÉLAN élan x.y X.Y x.y!", "the" * 3 + " of the of\u000bthe"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    lexicon = spark.createDataFrame([("of the", "within the"), ("the", "this"), ("The", "zz"), ("idiot", "fool"), ("o'er", "over"), ("élan", "/ßpirit/"), ("x.", "ex"), ("x.y", "ex why")], "term string, written string")
    for markup in (False, True):
        got = speech.substitute(rows, lexicon, markup=markup)
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        with monkeypatch.context() as m:
            m.setattr(speech, "FIRST_WORDS", 3)
            want = speech.substitute(rows, lexicon, markup=markup)
            assert "Exchange" in want._jdf.queryExecution().executedPlan().toString()
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_abbreviations_that_a_text_lacks_are_no_patterns(spark):
    """A text is looked through for the letters first, and cut once, before its numerals only."""
    from pyspark.sql import functions as F

    from quirespark.operators import speech

    texts = ["King Louis XVIII met M. Morrel in Act II of it", "XIV Act IV, Scene\nII XX", "W. Va., Malden, W. Va., Jr. a Jr. i.e. etc., etc.", "Part XIx Louis\n LX", "Canto XLL Mme. de Mme Ba", "", None]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", speech.expand(F.col("t")).alias("t"))
    plan = got._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("contains(") == len(speech.ABBREVIATIONS) and plan.count("split(transform(") == 1
    assert [r.t for r in got.orderBy("i").collect()] == [
        "King Louis the eighteenth met Monsieur Morrel in Act two of it", "XIV Act four, Scene\nII XX", "W. Va., Malden, West Virginia, Jr. a Junior that is, et cetera, et cetera.", "Part XIx Louis\n the sixtieth", "Canto ninety Mme. de Madame Ba", "", None,
    ]


def test_sentences_are_cut_once_for_their_pace(spark, monkeypatch):
    """Counts of a group are those of its clips, and only the counts of equal paces are read twice."""
    from pyspark.sql import functions as F

    from quirespark.operators import books

    text = "Mr. A. Long walked over the hills of home. \u0001 He wondered whether interdisciplinarity notwithstanding mattered! \n \"Go to it as we do it if it is so,\" he said. No. 5 is it."
    docs = spark.createDataFrame([(i, text[i % 7 :], (None, "en", "de")[i % 3] if i else "fr") for i in range(40)], "doc_id long, text string, lang string")
    p = books.clip_pace(docs, "lang", 1.2, 0.8).groupBy("lang").agg(F.count(F.lit(1)), F.first("median_pace"), F.count_if(F.expr("problem = 'rushed'")), F.count_if(F.expr("problem = 'drawn out'")))
    frozen, freeze = [], books.freeze
    monkeypatch.setattr(books, "freeze", lambda df, name: frozen.append(name) or freeze(df, name))
    got = books.clip_pace_counts(docs, "lang", 1.2, 0.8)
    assert frozen == ["paces"] and "regexp_replace" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(map(tuple, p.collect())) and [r[0] for r in rows] == ["de", "en", "fr"] and rows[0][3] > 0 and rows[0][4] > 0 and rows[2][2] is None


def test_archives_are_made_and_read_one_at_a_time(spark):
    """No pandas frame is made of a book, and its key, cover and chapters come through."""
    from quirespark.sources import readers, sinks

    chapters = spark.createDataFrame([(7, 2, "Two", "b & c"), (7, 1, None, "a\n\nb"), (None, 1, "One", "x"), (8, 1, "No", " ")], "book long, index int, title string, text string")
    about = spark.createDataFrame([(7, "T", None, bytearray(b"jpeg"))], "book long, title string, author string, cover binary")
    files = sinks.epub_files(chapters, about)
    assert "InArrow" in files._jdf.queryExecution().optimizedPlan().toString() and "InPandas" not in files._jdf.queryExecution().optimizedPlan().toString()
    got = files.selectExpr("coalesce(string(book), 'none') || '.epub' AS path", "content")
    assert sorted((r.path, r.pos, r.level, r.text) for r in readers.zipped_blocks(got).collect()) == [("7.epub", 0, 0, "a"), ("7.epub", 1, 0, "b"), ("7.epub", 2, 1, "Two"), ("7.epub", 3, 0, "b & c"), ("none.epub", 0, 1, "One"), ("none.epub", 1, 0, "x")]
    assert {r.book: b"cover.jpg" in bytes(r.content) for r in files.collect()} == {7: True, None: False}
