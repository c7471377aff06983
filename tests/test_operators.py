"""Operators on small fixtures: what queries over the driver's tables cannot show."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quirespark.functions import text as T
from quirespark.operators import align, attribution, books, clips, events, names, segments, speech, stats
from quirespark.sources import readers, sinks, web


def test_chunks_keep_all_letters_and_the_limit(spark):
    text = "One. " * 200 + "word, " * 100 + "x" * 700
    rows = books.chunk_plan(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string"), 100).orderBy("ci").collect()
    assert all(len(r.chunk) <= 100 + ("x" in r.chunk) for r in rows)  # a cut within a word takes one letter along
    assert {r.doc_id for r in rows} == {1} and len(rows) > 5
    assert "".join("".join(r.chunk.split()) for r in rows) == "".join(text.split())
    assert {r.cut for r in rows} == {"end", "comma", "space"}


def test_decoding_alternates_and_probabilities_add_up():
    quote = {"para": 0, "explicit": "Ann", "pron": None, "lead": None, "split": False, "cont": False, "other": False, "addressed": [], "recent": [], "cands": ["Ann", "Bob"]}
    quotes = [quote] + [quote | {"para": i, "explicit": None} for i in range(1, 4)]
    who, sure = attribution.decode(quotes, {})
    assert who == ["Ann", "Bob", "Ann", "Bob"] and all(0 < p <= 1 for p in sure)
    assert attribution.decode([], {}) == ([], [])


def test_decoding_is_the_best_of_all_ways():
    import itertools
    import random

    rng = random.Random(3)
    for _ in range(20):
        cast = ["Ann", "Bob", "Crowd"]
        quotes = [
            {"para": rng.randrange(3), "explicit": rng.choice([None, None, "Ann", "Bob"]), "pron": rng.choice([None, "m", "f"]), "lead": rng.choice([None, "Bob"]), "split": rng.random() < 0.2,
             "cont": rng.random() < 0.2, "other": rng.random() < 0.1, "addressed": rng.sample(cast, rng.randrange(2)), "recent": rng.sample(cast, rng.randrange(3)), "cands": rng.sample(cast, 3)}
            for _ in range(4)
        ]
        from collections import Counter

        named = Counter(q["explicit"] for q in quotes if q["explicit"])

        def total(way, quotes=quotes, named=named):
            s = sum(attribution._own(q, w, {"Ann": "f", "Bob": "m"}, named) for q, w in zip(quotes, way, strict=True))
            return s + sum(attribution._step(quotes[i - 1], quotes[i], way[i - 2] if i > 1 else None, way[i - 1], way[i]) for i in range(1, len(way)))

        ways = list(itertools.product(*[list(dict.fromkeys(([q["explicit"]] if q["explicit"] else []) + q["cands"])) for q in quotes]))
        who, sure = attribution.decode(quotes, {"Ann": "f", "Bob": "m"})
        assert total(who) == pytest.approx(max(map(total, ways)))
        weights = [math.exp(total(w)) for w in ways]
        for i, (w, p) in enumerate(zip(who, sure, strict=True)):
            assert p == pytest.approx(sum(x for x, way in zip(weights, ways, strict=True) if way[i] == w) / sum(weights))


def test_longest_chain_rises():
    pairs = [(0, 5), (1, 1), (2, 2), (2, 9), (3, 3), (4, 0), (5, 8)]
    assert align.longest_chain(pairs) == [(1, 1), (2, 2), (3, 3), (5, 8)]
    assert align.longest_chain([]) == []


def test_passages_are_found(spark):
    book = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog near the river bank"), (2, "nothing of the kind is here at all today")], "doc_id int, text string")
    asked = spark.createDataFrame([(7, "brown fox jumps over the lazy cat"), (8, "completely other words stand here"), (9, "too short")], "item_id int, text string")
    rows = align.best_passages(asked, "item_id", book, "doc_id").collect()
    assert [(r.item_id, r.doc_id) for r in rows] == [(7, 1)] and rows[0].similarity > 0.8


def test_passages_that_many_books_hold_are_found_in_each(spark):
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(12)]
    books = [[rng.choice("abcdef") for _ in range(rng.randrange(60))] + (passage[rng.randrange(5) :] if i < 20 else []) + [rng.choice("abcdef") for _ in range(30)] for i in range(30)]
    asked = [passage] + [[rng.choice("abcdef") for _ in range(9)] for _ in range(6)]
    want = set()
    for i, a in enumerate(asked):
        best = []
        for d, b in enumerate(books):
            hits = []
            for j in range(len(a) - 2):
                at = [k for k in range(len(b) - 2) if b[k : k + 3] == a[j : j + 3]]
                hits += [(j, k) for k in at] if len(at) <= 8 else []
            best.append((len(align.longest_chain(hits)), -d))
        if max(best)[0]:
            want.add((i, -max(best)[1], max(best)[0]))
    frames = [spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)], f"{name} int, text string") for name, rows in (("item_id", asked), ("doc_id", books))]
    got = align.best_passages(frames[0], "item_id", frames[1], "doc_id").collect()
    assert {(r.item_id, r.doc_id, r.length) for r in got} == want and any(r.item_id == 0 for r in got)


def test_clip_problems(spark):
    kind = "clip string, text string, chars long, seconds double, speech double, longest_gap double, silent_share double, broken string, median_pace double"
    words = "a plain sentence of words that is long enough"
    rows = [("ok", words, 100, 9.0, 7.0, 0.5, 0.2, None, 14.0), ("gap", words, 100, 9.0, 7.0, 2.5, 0.2, None, 14.0), ("dash", words + " — x", 100, 9.0, 7.0, 2.5, 0.2, None, 14.0),
            ("quiet", words, 100, 9.0, 7.0, 0.5, 0.7, None, 14.0), ("fast", words, 200, 9.0, 7.0, 0.5, 0.2, None, 14.0), ("slow", words, 30, 9.0, 7.0, 0.5, 0.2, None, 14.0),
            ("broken", words, 100, None, None, None, None, "silent", 14.0), ("stars", "* " * 50, 200, 9.0, 7.0, 0.5, 0.2, None, 14.0)]
    got = {r.clip: r.problems for r in clips.problems(spark.createDataFrame(rows, kind)).collect()}
    assert got == {"ok": [], "gap": ["dead air"], "dash": [], "quiet": ["mostly silence"], "fast": ["rushed"], "slow": ["drawn out"], "broken": ["silent"], "stars": []}


def test_page_furniture_and_hyphens(spark):
    pages = spark.createDataFrame([("b", i, f"THE BOOK {i}\nbody line {chr(97 + i)}-\nend of page\nwords {chr(97 + i)}") for i in range(10)], "book string, page int, text string")
    got = books.running_text(books.furniture(pages, edge=1)).orderBy("page").first().text
    assert got == "body line aend of page words a"


def test_names_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "I saw Anna there. Then Anna left with Bob."), (2, None)], "doc_id int, text string")
    assert {r.surface for r in names.name_candidates(docs).collect()} >= {"Anna"}
    assert names.name_candidates(docs.limit(0)).count() == 0
    assert names.word_table(docs.limit(0)).count() == 0


def test_epub_holds_escaped_text_and_comes_back(spark):
    import io
    import zipfile

    rows = [("b", 1, "One & two", "Two <b>.\n\nMore."), ("b", 2, "Empty", " \n"), ("b", 3, "Three", "End.")]
    files = sinks.epub_files(spark.createDataFrame(rows, "book string, index int, title string, text string"))
    book = zipfile.ZipFile(io.BytesIO(bytes(files.first().content)))
    assert book.namelist()[0] == "mimetype" and "Two &lt;b&gt;." in book.read("OEBPS/c0001.xhtml").decode()
    back = readers.zipped_blocks(files.select(F.lit("x.epub").alias("path"), "content")).orderBy("pos").collect()
    assert [(r.level, r.text) for r in back] == [(1, "One & two"), (0, "Two <b>."), (0, "More."), (1, "Three"), (0, "End.")]
    bad = readers.zipped_blocks(spark.createDataFrame([("y.docx", bytearray(b"no zip"))], "path string, content binary")).first()
    assert bad.level == -1 and "unreadable" in bad.text


def test_docx(spark):
    import io
    import zipfile

    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    xml = f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading 2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Some </w:t></w:r><w:r><w:t>text</w:t></w:r></w:p></w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", xml)
    rows = readers.zipped_blocks(spark.createDataFrame([("a.docx", bytearray(out.getvalue()))], "path string, content binary")).orderBy("pos").collect()
    assert [(r.level, r.text) for r in rows] == [(2, "Head"), (0, "Some text")]


def test_html_parser(spark):
    page = "<nav><p>no</p></nav><h2>Part A</h2><p>One<br>two</p><ul><li>x</li></ul><h2>Part B</h2><p>Three &amp; four</p><script>var p='<p>no</p>'</script>"
    found = web.parsed_blocks(spark.createDataFrame([(1, page), (2, None)], "page_id int, html string"))
    got = web.chapters(found).orderBy("chapter").collect()
    assert [(r.title, r.text) for r in got] == [("Part A", "One two\nx"), ("Part B", "Three & four")]


def test_text_lines_source(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\r\ntwo\n", encoding="utf-8")
    rows = readers.text_lines(spark, f"file://{tmp_path}").orderBy("line_no").collect()
    assert [(r.file, r.line) for r in rows] [:2] == [("a.txt", "one"), ("a.txt", "two")]


def test_sounds_and_spellings(spark):
    assert speech.respelled("kˈAdɹWs") == "KAY-drows" and speech.respelled("dɑ̃ɡlˈaʁ") == "dahn-GLAHR"
    assert speech.heard_score("mɛri", "mɛri") == 1.0 and speech.heard_score("", "a") == 0.0 and 0 < speech.heard_score("tɪm", "tɪn") < 1
    assert T.say(318) == "three hundred and eighteen"
    marked = speech.substitute(spark.createDataFrame([(1, "Edmond’s father")], "doc_id int, text string"), spark.createDataFrame([("Edmond", "ɛdmɔ̃")], "term string, written string"), markup=True).first().text
    assert marked == "[Edmond](/ɛdmɔ̃/)’s father"


def test_regression_agrees_with_single_feature(spark):
    rows = spark.createDataFrame([("a", float(i), 2.0 * i + (i % 3)) for i in range(150)], "g string, x double, y double")
    one = stats.regression(rows, "g", F.col("y"), F.col("x")).first()
    many = stats.solve(stats.normal_equations(rows, F.col("y"), [F.col("x")]), 2)
    assert many[1][0] == pytest.approx(one.slope) and many[1][1] == pytest.approx(one.t)


def test_queue_windows_and_streaks(spark):
    rows = spark.createDataFrame([(1, "2026-01-01 23:30:00"), (2, "2026-01-01 06:30:00"), (3, "2026-01-01 06:29:00")], "id int, ts string").withColumn("ts", F.to_timestamp_ntz("ts"))
    assert [r.w for r in rows.orderBy("id").select(events.in_window(F.col("ts"), F.lit("23:00-06:30")).alias("w")).collect()] == [True, False, True]
    assert segments.islands(rows.withColumn("k", F.lit(1)), "k", "id", "ts").count() == 3


def one(spark, f, *values, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").orderBy("i").select(f(F.col("x"))).collect()]


def test_abbreviations_and_numerals(spark):
    given = {
        "M. Morrel and Mme. Dantès": "Monsieur Morrel and Madame Dantès", "King Louis XVIII": "King Louis the eighteenth", "Act II, Scene III": "Act two, Scene three",
        "Psalm CXIX": "Psalm the one hundred and nineteenth", "Lieut.-Col. Brown, etc., of Malden, W. Va.": "Lieutenant Colonel Brown, et cetera, of Malden, West Virginia",
        "cats, etc. and Maj. Gen. Smith Jr.": "cats, et cetera. and Major General Smith Junior", "Part CXX": "Part one hundred and twenty", "“Louis XIV” and MIX": "“Louis the fourteenth” and MIX",
    }
    assert one(spark, speech.expand, *given, None, "") == [*given.values(), None, ""]


def test_titles_are_read(spark):
    given = {
        "II. THE FALLING STAR.": "Two. The Falling Star.", "CHAPTER IV": "Chapter four.", "Part 12: Dawn": "Part twelve. Dawn.", "PREFACE": "Preface.", "Chapter 120": "Chapter one hundred and twenty.",
        "BOOK ONE THE COMING OF THE MARTIANS": "Book one. The Coming of the Martians.", "The 39 Steps": "The thirty-nine Steps.", "CXX. THE END": "One hundred and twenty. The End.", "A HOUSE of the DEAD": "A House of the Dead.",
    }
    assert one(spark, speech.spoken_title, *given, None) == [*given.values(), None]


def test_numbers_in_words(spark):
    numbers = [0, 7, 13, 20, 21, 99, 100, 101, 120, 999, 1000, 1001, 1100, 1234, 120_045]
    assert one(spark, T.said, *numbers, kind="int") == [T.say(n) for n in numbers]
    assert one(spark, T.said_ordinal, 1, 3, 12, 20, 21, 100, 118, kind="int") == ["first", "third", "twelfth", "twentieth", "twenty-first", "one hundredth", "one hundred and eighteenth"]
    assert one(spark, T.roman_value, "XIV", "CXIX", "iv", "CCCXCIX") == [14, 119, 4, 399]


def test_questions_have_their_form(spark):
    from quirespark.functions.script import looks_like_question

    asked = {"Hath he come": True, "“Didst thou see": True, "Was Élodie there": True, "Are you there": True, "When I awoke": False, "What you will want we do not know": False, "": False}
    assert one(spark, looks_like_question, *asked) == list(asked.values())


def test_names_are_whole_words_and_phrases(spark):
    from quirespark.operators import names

    docs = spark.createDataFrame([("Annals said he. Annex: he left. Ann saw her. Mary Ann and HER dog. Ann, she said, and Ann said he.",), (None,)], "text string")
    got = {r.name: (r.gender, r.votes) for r in names.genders(docs, spark.createDataFrame([("Ann",), ("Mary Ann",), (None,)], "name string")).collect()}
    assert got == {"Ann": ("f", 4)}
    words = spark.createDataFrame([("Mix",), ("MIX",), ("XVII",), ("Dix",), ("Xii",), ("Li",), (None,)], "word string")
    told = {r.word: r.numeral for r in names.numerals(words, spark.createDataFrame([("mix",), ("dix",)], "word string")).collect()}
    assert told == {"Mix": False, "MIX": True, "XVII": True, "Dix": False, "Xii": True, "Li": False, None: False}


def test_substitution_takes_the_longest_term_once(spark):
    rows = spark.createDataFrame([(1, "called Cephas, not cephasian."), (2, "CEPHAS and the ancient  mariner’s boat"), (3, None), (4, "ancient o’er Ancient Mariner ancient"), (5, "")], "doc_id int, text string")
    lexicon = spark.createDataFrame([("Cephas", "seefus"), ("ancient mariner", "old seaman"), ("ancient", "very old"), ("o'er", "over"), ("old", "new"), ("x", "")], "term string, written string")
    got = {r.doc_id: r.text for r in speech.substitute(rows, lexicon).collect()}
    assert got == {1: "called Seefus, not cephasian.", 2: "SEEFUS and the old seaman’s boat", 3: None, 4: "very old over Old seaman very old", 5: ""}
    assert speech.substitute(rows, lexicon.limit(0)).count() == 5


def test_swaps_of_vowels_cost_half(spark):
    assert speech.heard_score("tə", "tɪ") == pytest.approx(1 - 0.5 / 1.5)


def test_a_passage_goes_on_for_the_rest_of_the_clip(spark):
    book = [f"w{i}" for i in range(100)]
    clip = book[40:45] + [book[45 + i] if i % 2 else f"x{i}" for i in range(17)]
    found = align.best_passages(spark.createDataFrame([(1, " ".join(clip))], "item_id long, text string"), "item_id", spark.createDataFrame([(7, " ".join(book))], "doc_id long, text string"), "doc_id").first()
    matched = 5 + sum(i % 2 for i in range(17))
    assert (found.doc_id, found.length) == (7, 3) and found.similarity == pytest.approx(matched / 22)


def test_text_that_was_dropped_is_noted(spark):
    rows = spark.createDataFrame([("a", f"t{i}", "x" * 1000, 10_000) for i in range(5)] + [("b", "t", "y" * 900, 1000)], "book string, title string, text string, whole long")
    got = {r.book: r.notes for r in books.validate(rows, "book", "title", "whole").collect()}
    assert got == {"a": "text_dropped", "b": ""}


def test_changed_chapters_block_the_later_steps(spark):
    from quirespark.operators import stages

    kind = ", ".join([f"{c} string, {c}_was string" for c in ("chapters", "voices", "speech", "build")] + [f"{c} int" for c in ("new_roles", "new_names", "open_names", "flagged", "weak_names")] + [f"{c} boolean" for c in ("one_narrator", "names_checked", "extras_set", "extras_lost", "queued", "built", "has_clips", "fixes_newer")])
    row = lambda chapters_was: ("a", chapters_was, "v", None, "s", None, "b", None, *[None] * 13)
    books_ = spark.createDataFrame([("fresh", *row("a")), ("changed", *row("x")), ("new", *row(None))], f"book string, {kind}")
    got = {(r.book, r.step): (r.state, r.blocked_by) for r in stages.stage_states(books_, "book").collect()}
    assert [got["fresh", s] for s in ("book", "voices", "make", "fix")] == [("done", None), ("recommended", None), ("required", None), ("optional", "make")]
    assert [got["changed", s] for s in ("book", "voices", "make")] == [("stale", None), ("optional", "book"), ("required", "book")]
    states = stages.stage_states(books_, "book")
    assert {r.book: r.step for r in stages.next_step(states, "book").collect()} == {"fresh": "make", "changed": "book", "new": "book"}
    assert {r.book: r.step for r in stages.next_step(states, "book", here="make").collect()} == {"fresh": "voices", "changed": "book", "new": "book"}
    assert stages.stage_states(books_.limit(0), "book").count() == 0


def test_json_rows_take_defaults(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"name": "x", "n": 2}, {"name": null, "more": 1}, 7]', encoding="utf-8")
    (tmp_path / "b.json").write_text('{"n": "three"}\n{"name": "z", "n": 4}\n', encoding="utf-8")
    (tmp_path / "c.json").write_text("[]", encoding="utf-8")
    got = readers.json_rows(spark, f"file://{tmp_path}/*.json", "name string, n int", {"name": "-", "n": 0})
    assert sorted(tuple(r) for r in got.collect()) == [("a.json", "-", 0), ("a.json", "x", 2), ("b.json", "-", 0), ("b.json", "z", 4)]
    assert readers.json_rows(spark, f"file://{tmp_path}/none*.json", "name string").count() == 0


def test_only_rare_grams_admit_books_to_a_passage(spark):
    rng = random.Random(9)
    common = " ".join(f"c{i}" for i in range(40))
    passage = " ".join(f"p{i}" for i in range(20))
    books = [(i, common + (" " + passage if i % 9 == 4 else f" p{i % 20} p{i % 20 + 1} p{i % 20 + 2}") + " x" * rng.randrange(5)) for i in range(60)]
    asked = [(1, "c1 c2 c3 c4 c5 " + passage), (2, "c7 c8 c9 c10"), (3, "none of it is there")]
    a, b = spark.createDataFrame(asked, "item_id long, text string"), spark.createDataFrame(books, "doc_id long, text string")
    pairs, _ = align.candidates(a, "item_id", b, "doc_id")
    admitted = pairs.where("item_id = 1").count()
    assert 0 < admitted < 20 and align.grams_within_books(a, "item_id", b, "doc_id").where("item_id = 1").select("doc_id").distinct().count() == 60
    best = {r.item_id: (r.doc_id, r.length) for r in align.best_passages(a, "item_id", b, "doc_id").collect()}
    assert best == {1: (4, 21), 2: (0, 2)}
    assert align.best_passages(a, "item_id", b.limit(0), "doc_id").count() == 0 and align.best_passages(a.limit(0), "item_id", b, "doc_id").count() == 0


def test_a_passage_is_the_books_own_text_up_to_the_chapter(spark):
    book = "The sea was calm. Jesus saith unto them, “Fill the waterpots with water.” And they filled them up to the brim.\fNothing here resembles the clip at all, only other words."
    asked = [(1, "jesus saith unto them fill the water pots with water and they filled them up"), (2, "quarterly tax filings for the committee"), (3, "them up to the brim nothing here resembles the clip"), (4, "only other words")]
    b = spark.createDataFrame([(7, book), (8, None)], "doc_id long, text string")
    got = {r.item_id: r for r in align.best_passages(spark.createDataFrame(asked, "item_id long, text string"), "item_id", b, "doc_id").collect()}
    assert set(got) == {1, 3} and got[1].passage == "Jesus saith unto them, “Fill the waterpots with water.” And they filled them up" and got[1].chapter == 0 and got[1].similarity > 0.8
    assert got[3].passage == "them up to the brim." and got[3].chapter == 0


def test_angles_in_words():
    from quirespark.operators.sounds import angles_said

    given = {
        "42° 15′ N. lat. and 1° E.": "forty-two degrees fifteen minutes north latitude and one degree east", "98.6° F. The N.N.E. wind": "ninety-eight point six degrees Fahrenheit. The north-north-east wind",
        "3 deg. 4' 5\" W. long. In the": "three degrees four minutes five seconds west longitude. In the", "10 degrees C, then": "ten degrees Celsius, then", "5° NW": "five degrees NW", "2 dogs at 5'": "2 dogs at 5'",
        "S.W. and U.S.W. and N.E.S.W.N. and E.": "south-west and U.S.W. and N.E.S.W.N. and E.", "7° 8'x": "seven degrees 8'x", "": "", "90°": "ninety degrees", "1° 30′ 1″ S. of it": "one degree thirty minutes one second south of it",
    }
    assert {t: angles_said(t) for t in given} == given


def test_long_numbers_are_said(spark):
    numbers = [1_000_000, 1_000_001, 2_100_000, 999_999_999, 1_000_000_000, 12_345_678_901, 5_000_000_100]
    assert one(spark, T.said_long, *numbers, kind="long") == [T.say(n) for n in numbers]
    assert one(spark, speech.spoken_title, "Part 1234567: A", "1000000 Miles", "Chapter 3 - On and on", "IV. 12 Men", "Section XX.", "Book the Third", "Part", "MIX. X", "Chapter ten begins", "1234567890123") == [
        "Part one million, two hundred and thirty-four thousand, five hundred and sixty-seven. A.", "One million Miles.".replace("One", "one"), "Chapter three. On and on.", "Four. 12 Men.", "Section twenty.", "Book the Third.", "Part.", "Mix. X.", "Chapter ten. Begins.",
        "one two three four five six seven eight nine zero one two three.",
    ]


def test_substitution_is_linear_in_its_hits(spark):
    import time

    took = []
    for n in (100, 40_000):
        rows = spark.createDataFrame([(1, "the idiot " * n)], "doc_id int, text string")
        lexicon = spark.createDataFrame([("idiot", "fool"), ("the idiot", "that fool"), ("never", "x")], "term string, written string")
        begun = time.time()
        assert speech.substitute(rows, lexicon).first().text == "that fool " * n
        took.append(time.time() - begun)
    assert took[1] - took[0] < 4


def test_which_spellings_count(spark):
    kind = "term string, ipa string, respell string, respell_src string, source string"
    entries = spark.createDataFrame([("Weena", "ˈwiːnə", "Weenuh", "user", "user"), ("Eloi", "ˈiːlɔɪ", "eeloy", "auto", "auto"), ("Morlock", "ˈmɔɹlɑk", "", None, "user"), ("Filby", "ˈfɪlbi", "fil-bee", "checked", "auto"), ("Tim", None, "Tym", None, "user"), ("Moses", None, None, None, None)], kind)
    tested = spark.createDataFrame([("Weena", "Wrong"), ("Abana", "AB-uh-nuh")], "term string, respell string")
    terms = lambda mode: {r.term: r.written for r in speech.chosen_terms(entries, mode, tested).collect()}
    assert terms("plain") == {} and terms("typed") == {"Weena": "Weenuh", "Tim": "Tym"} and terms("checked") == terms("typed") | {"Filby": "fil-bee"}
    assert terms("verified") == terms("checked") | {"Abana": "AB-uh-nuh"} and set(terms("ipa")) == {"Weena", "Eloi", "Morlock", "Filby"}
    respell = terms("respell")
    assert respell["Filby"] == "filbee" and respell["Weena"] == "weenuh" and respell["Morlock"].isalpha() and "Moses" not in respell
    text = spark.createDataFrame([(1, "Weena, Eloi and Morlock.")], "doc_id int, text string")
    assert speech.substitute(text, speech.chosen_terms(entries, "typed")).first().text == "Weenuh, Eloi and Morlock."
    with pytest.raises(ValueError, match="no mode"):
        speech.chosen_terms(entries, "other")


def test_only_the_spellings_that_are_kept_are_made():
    from quirespark.operators import sounds

    many = {"a": ["ah", "a", "uh"], "n": ["n"], "b": ["b"]}
    made = sounds.spellings_of("ab" * 40, "abab", many)
    assert 50 < len(made) <= 61 and made[0] == "abab" and len(set(made)) == len(made)
    assert sounds.spellings_of("ab" * 2, "Abab", many) == ["abab", *(f"{x}b{y}b" for x in ("ah", "a", "uh") for y in ("ah", "a", "uh") if f"{x}b{y}b" != "abab")]
    parts = sounds.spellings_of("bɪɹʃəbə", "Beer-sheba", {"ə": ["uh", "ah"]})
    assert parts[0] == "beer-sheba" and "beersheba" in parts and any("-" in p and p != parts[0] for p in parts) and len(parts) <= 61
    assert sounds.spellings_of("mlɪŋ", "M’ling", {})[0] == "m-ling" and sounds.spellings_of("", "", {}) == [""]
    assert list(sounds.sampled(3, 5, "x")) == [0, 1, 2] and [sounds.chosen(i, [["a", "b"], ["c"], ["d", "e"]]) for i in range(4)] == [["a", "c", "d"], ["a", "c", "e"], ["b", "c", "d"], ["b", "c", "e"]]


def test_sentences_end_where_they_do(spark):
    given = {
        "Mr. Smith came. He sat.": ["Mr. Smith came.", "He sat."], "“Go home.” Anna went. “Why?” he said.": ["“Go home.”", "Anna went.", "“Why?” he said."], "J. R. R. Tolkien, Lieut. Gen. and Esq. Then all.": ["J. R. R. Tolkien, Lieut. Gen. and Esq. Then all."],
        "It cost 3.50 p. 12 times. 7 more? (Yes.) No": ["It cost 3.50 p. 12 times.", "7 more?", "(Yes.) No"], "He ran. and ran! Then\n stopped.  ": ["He ran. and ran!", "Then\n stopped."], "Vitamin c. Xerxes sang. “St. Ives” MR. X": ["Vitamin c. Xerxes sang.", "“St. Ives” MR. X"], "": [],
    }
    assert dict(zip(given, one(spark, T.sentences, *given), strict=True)) == given


def test_known_values_of_small_functions(spark):
    from quirespark.functions import script as S

    titles = {
        "A Quiet Day": "A Quiet Day", "II. THE FALLING STAR": "II. The Falling Star", "LETTER FROM WENDELL PHILLIPS": "Letter from Wendell Phillips", "OF MICE: A TALE": "Of Mice: A Tale", "THE HOUSE OF THE DEAD": "The House of the Dead", "XIV": "XIV",
        "THE END OF AN AGE AND THE START OF ANOTHER ONE FOR US ALL TODAY": "THE END OF AN AGE AND THE START OF ANOTHER ONE FOR US ALL TODAY",
    }
    assert one(spark, T.title_case, *titles) == list(titles.values())
    asked = {"Are you there": True, "Where is your brother": True, "What time is it": True, "When I awoke": False, "What you will want we do not know": False, "Is John here": True, "He is there": False, "Why": False}
    assert one(spark, S.looks_like_question, *asked) == list(asked.values())
    assert one(spark, S.with_question_mark, "Are you there.”", "Where…", "So it is") == ["Are you there?”", "Where?", "So it is?"]
    assert [tuple(v) for v in one(spark, S.voice_of, "clone:anna@f5", "preset:bob")] == [("clone", "anna", "f5"), ("preset", "bob", None)]
    takes = [[0.25], [0.35], [0.35, 0.38], [0.9, 0.2], [0.9]]
    due = one(spark, lambda t: clips.take_due(t, [(0.3, 1), (0.4, 2), (0.5, 3), (0.6, 4), (0.7, 5)]), *takes, kind="array<double>")
    assert due == [True, False, True, True, False]
    kind = "term string, ipa string, respell string"
    now = spark.createDataFrame([("a", "x", "1"), ("b", "q", "q"), ("c", "m", "n"), ("d", "w", "y")], kind)
    snap = spark.createDataFrame([("a", "x", "1"), ("b", "old", "q"), ("c", "m", "n"), ("d", "v", "y")], kind)
    edit = spark.createDataFrame([("a", "x", "2"), ("b", "old", "q"), ("c", "m", None), ("d", "v", "z")], kind)
    assert sorted(tuple(r) for r in clips.three_way(now, snap, edit, "term", ["ipa", "respell"]).collect()) == [("a", "x", "2", "user"), ("b", "q", "q", None), ("c", "m", "n", None), ("d", "w", "z", "user")]
    scored = spark.createDataFrame([("Ann", "An", 0.9, 0.6), ("Ann", "Ahn", 0.8, 0.6), ("Bob", "Bahb", 0.7, 0.5)], "name string, spelling string, score double, plain double")
    assert sorted((r.name, r.spelling, r.adopt) for r in clips.adopted(scored, "name", "plain", "score").collect()) == [("Ann", "An", True), ("Bob", "Bahb", False)]
    lines = spark.createDataFrame([(1, "Go home, said she", "Anna"), (2, "I will not", "Carl"), (3, "I will", "Bob")], "pos int, text string, speaker string")
    gold = spark.createDataFrame([("Go home", "Anna"), ("I will", "Bob"), ("Never", "Dan")], "prefix string, speaker string")
    assert sorted((r.prefix, r.found, r.right) for r in align.first_speaker(gold, lines, chars=6).collect()) == [("Go home", "Anna", True), ("I will", "Carl", False)]
