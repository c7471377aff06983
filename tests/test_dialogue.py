"""Prose cut into narration and speech."""

from quirespark.operators import dialogue

KIND = "book int, chapter int, text string, names map<string,string>"
NAMES = {"Anna": "Anna", "Bob": "Bob"}


def told(frame):
    return [(r.speaker, r.text) for r in frame.orderBy("book", "chapter", "seg").collect()]


def test_quotes_and_their_speakers(spark):
    text = "Anna met Bob.\n\n“Well,” said Bob.\n\n“Go home,” said Anna.\n\n“No,” he answered, “I will not.”\n\n“Then stay,” she\nreplied."
    rows = told(dialogue.segments(spark.createDataFrame([(1, 1, text, NAMES)], KIND), genders={"Anna": "f", "Bob": "m"}))
    assert rows == [
        ("Narrator", "Anna met Bob."), ("Bob", "Well,"), ("Narrator", "said Bob."), ("Anna", "Go home,"), ("Narrator", "said Anna."), ("Bob", "No,"), ("Narrator", "he answered,"), ("Bob", "I will not."),
        ("Anna", "Then stay,"), ("Narrator", "she replied."),
    ]


def test_evidence_of_quotes(spark):
    text = "Bob, of the officers, came.\n\nTurning to Bob, she cried, “Come!”\n\nThe other laughed: “Never,” and shouted Bob, “no.” “Nor I.”"
    e = dialogue.quote_evidence(spark.createDataFrame([(1, 1, text, NAMES)], KIND)).orderBy("para", "place").collect()
    assert [(r.explicit, r.pron, r.other) for r in e][0] == (None, "f", False)
    assert e[0].lead == "Officers" and "Bob" in e[0].addressed
    assert (e[1].explicit, e[2].explicit, e[3].explicit) == ("Bob", "Bob", None) and e[2].split and e[3].cont
    assert [r.place for r in e] == [0, 0, 1, 2] and all(len(set(r.cands)) == len(r.cands) <= 10 for r in e)


def test_candidates_are_those_who_speak_so_far(spark):
    rows = [(1, 1, "“A,” said Anna. “B,” said Anna.", NAMES), (1, 2, "Carl came. “C.”", NAMES | {"Carl": "Carl"}), (1, 3, "“D,” said Bob.\n\n“E.”", NAMES), (2, 1, "“F.”", None)]
    e = dialogue.quote_evidence(spark.createDataFrame(rows, KIND)).orderBy("book", "chapter", "para", "place").collect()
    assert [list(r.cands) for r in e] == [["Anna"], ["Anna"], ["Anna"], ["Bob", "Anna"], ["Bob", "Anna"], []]
    assert told(dialogue.segments(spark.createDataFrame([(2, 1, "“F.”", None)], KIND))) == [("Speaker A", "F.")]


def test_odd_chapters(spark):
    rows = [(1, 1, None, NAMES), (1, 2, "", NAMES), (1, 3, " \n\n ", None), (1, 4, "No “end", None)]
    assert told(dialogue.segments(spark.createDataFrame(rows, KIND))) == [("Narrator", "No “end")]
    assert told(dialogue.unquoted_segments(spark.createDataFrame(rows[:3], KIND))) == []
    assert told(dialogue.segments(spark.createDataFrame([], KIND))) == []


def test_speech_without_quotes(spark):
    text = (
        "It was day. Jesus answered and said unto him, Verily I say unto thee. He answered, saying, Go.\n\nAnd ye shall see.\n\n"
        "Then they went to the hill.\n\nAnd I saw it.\n\nThe disciples said, We come."
    )
    assert told(dialogue.unquoted_segments(spark.createDataFrame([(1, 1, text, None)], KIND))) == [
        ("Narrator", "It was day. Jesus answered and said unto him,"), ("Jesus", "Verily I say unto thee."), ("Narrator", "He answered, saying,"), ("Jesus", "Go."), ("Jesus", "And ye shall see."),
        ("Narrator", "Then they went to the hill."), ("Narrator", "And I saw it."), ("Narrator", "The disciples said,"), ("Disciples", "We come."),
    ]


OPENING = "Anna smiled as she sat. Bob stood as he waited. Anna nodded as she rose. Bob frowned as he turned.\n\n“I am here,” said Anna.\n\n“Good,” said Bob.\n\n“Come along,” he said."


def test_genders_follow_from_the_chapter(spark):
    swapped = OPENING.replace("she", "X").replace(" he ", " she ").replace("X", "he").replace("” she said", "” he said")
    rows = [(1, 1, OPENING, NAMES), (1, 2, swapped, NAMES), (2, 1, OPENING.split(". Anna nodded")[0] + OPENING[OPENING.index("turned.") + 6 :], NAMES)]
    chapters = spark.createDataFrame(rows, KIND)
    said = [r.speaker for r in dialogue.segments(chapters).where("text = 'Come along,'").orderBy("book", "chapter").collect()]
    assert said == ["Bob", "Anna", "Anna"]  # one vote each does not count
    assert {(r.book, r.chapter): r.genders for r in dialogue.chapter_genders(chapters).collect()} == {(1, 1): {"Anna": "f", "Bob": "m"}, (1, 2): {"Anna": "m", "Bob": "f"}}
    own = dialogue.segments(chapters.where("book = 1 AND chapter = 1"), genders={"Anna": "m", "Bob": "f"})
    assert [r.speaker for r in own.where("text = 'Come along,'").collect()] == ["Anna"]


def test_genders_of_phrases_and_ties(spark):
    text = "The old sailor took his hat. An old sailor lost her hat.\n\nAnna and he. Anna and she. Annals of his. Bob waited for long. He ran."
    got = dialogue.chapter_genders(spark.createDataFrame([(1, 1, text, NAMES), (1, 2, None, None)], KIND), phrases={"old (sailor|tar)": "Sailor"}).collect()
    assert [r.genders for r in got] == [{"Sailor": "m", "Anna": "m"}]


def test_unquoted_speech_has_aliases_and_quotes(spark):
    text = "John answered and said unto him, Verily I say.\n\n“Go home,” said Anna. “Now.”\n\nShe asked again, Why?\n\nSimon replied, No."
    rows = told(dialogue.unquoted_segments(spark.createDataFrame([(1, 1, text, None)], KIND), aliases={"Simon": "Peter"}))
    assert rows == [
        ("Narrator", "John answered and said unto him,"), ("John the Baptist", "Verily I say."), ("Anna", "Go home,"), ("Narrator", "said Anna."), ("Anna", "Now."),
        ("Narrator", "She asked again,"), ("Anna", "Why?"), ("Narrator", "Simon replied,"), ("Peter", "No."),
    ]
