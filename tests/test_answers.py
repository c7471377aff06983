"""What a queue answers, how jobs move in it, and where music goes."""

import pytest
from pyspark.sql import functions as F

from quirespark.operators import answers, events

JOB = "queue string, job int, title string, status string, position int, done int, total int, seconds int, finished string, note string"


def jobs(spark):
    return spark.createDataFrame([
        ("a", 1, "One", "queued", 1, None, None, 60, None, None), ("a", 2, "Two", "running", 2, 5, 20, 3600, None, "speaking"), ("a", 3, "Three", "held", 3, None, None, None, None, None), ("a", 4, None, "done", 4, None, None, None, "2026-01-02 10:00", None),
        ("a", 5, "Five", "failed", 5, None, None, None, "2026-01-03 10:00", "broke"), ("b", 6, "Six", "paused", 1, None, None, 5, None, None), ("c", 7, "Seven", "running", 1, 0, 0, 5, None, "starting up"), ("d", 8, "Eight", "cancelled", 1, None, None, 5, None, None),
    ], JOB)


def test_queues_answer(spark):
    state = answers.states(jobs(spark))
    asked = [("a", "Status?"), ("a", "queue!"), ("a", "done"), ("b", "current"), ("c", "current"), ("d", "queue"), ("d", "current"), ("z", "finished"), ("a", "hello"), ("a", "stop"), ("a", None), ("a", "help")]
    got = {(r.queue, r.text): (r.command, r.answer) for r in answers.answered(spark.createDataFrame(asked, "queue string, text string"), state).collect()}
    assert got["a", "Status?"] == ("current", "Making “Two”: 25% (5 of 20)\nDone in 1h 00m")
    assert got["a", "queue!"][1] == "1. Two — running, done in 1h 00m\n2. One — queued, done in 1h 01m\n3. Three — held, saved for later"
    assert got["a", "done"][1] == "1. ✗ Five — 2026-01-03 10:00\n2. ✓  — 2026-01-02 10:00"
    assert got["b", "current"][1] == "Nothing is being made right now. Next: “Six”." and got["c", "current"][1] == "Making “Seven”: starting up\nDone in 0m 05s"
    assert got["d", "queue"][1] == "The queue is empty." and got["d", "current"][1].startswith("Nothing is being made and") and got["z", "finished"][1] == "Nothing has finished yet."
    assert got["a", "hello"] == (None, None) and got["a", "stop"] == ("stop", None) and got["a", None] == (None, None) and got["a", "help"][1].startswith("Send: current (")


def test_a_stream_of_messages_is_answered(spark, tmp_path):
    spark.createDataFrame([("a", "current"), ("a", "nothing")], "queue string, text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("queue string, text string").parquet(f"{tmp_path}/in")
    run = answers.answered(stream, answers.states(jobs(spark))).writeStream.format("memory").queryName("answers").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    run.awaitTermination()
    assert {(r.text, (r.answer or "")[:12]) for r in spark.table("answers").collect()} == {("current", "Making “Two”"), ("nothing", "")}


def plain_move(order, ids, where):
    sel, rest = [j for j in order if j in ids], [j for j in order if j not in ids]
    if where in ("top", "bottom"):
        return sel + rest if where == "top" else rest + sel
    order = list(order)
    for i in range(len(order)) if where == "up" else reversed(range(len(order))):
        k = i - 1 if where == "up" else i + 1
        if order[i] in ids and 0 <= k < len(order) and order[k] not in ids:
            order[i], order[k] = order[k], order[i]
    return order


@pytest.mark.parametrize("where", ["top", "bottom", "up", "down"])
def test_jobs_move(spark, where):
    rows = [(q, j, bool(q >> j & 1)) for q in range(64) for j in range(6)]
    got = events.moved(spark.createDataFrame(rows, "q int, j int, c boolean"), "q", F.col("c"), "j", where)
    lists = {r.q: [x.j for x in r.js] for r in got.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("new_pos", "j"))).alias("js")).collect()}
    assert lists == {q: plain_move(list(range(6)), {j for j in range(6) if q >> j & 1}, where) for q in range(64)}
    with pytest.raises(ValueError, match="no place"):
        events.moved(got, "q", F.col("c"), "j", "away")


def test_music_follows_the_plan_and_ones_own_choices(spark):
    chapters = spark.createDataFrame([(b, i, 900.0) for b in ("a", "b") for i in range(1, 7)], "book string, chapter int, seconds double")
    choices = spark.createDataFrame([("a", 1, "on"), ("a", 2, "on"), ("a", 5, "off"), ("b", 4, "off"), ("b", 9, "on"), ("b", 3, None)], "book string, chapter int, turned string")
    plan = lambda own: {b: sorted(r.chapter for r in events.bridges(chapters, "book", "chapter", "seconds", 1500, choices, own).collect() if r.book == b) for b in ("a", "b")}
    assert plan(None) == {"a": [2, 3], "b": [3, 5, 9]}
    assert plan(spark.createDataFrame([("b", 4), ("b", 6), ("b", 1)], "book string, chapter int")) == {"a": [2, 3], "b": [6, 9]}
