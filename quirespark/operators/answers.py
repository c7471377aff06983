"""Answers to what people send to a queue: a table or stream of messages joined to what each queue has to say."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirespark.functions import script

#: What can be asked, in the order in which help lists it.
ASKED = {"current": "what is being made", "queue": "what waits, and when it will be done", "done": "what was finished last", "stop": "stop what is being made", "now": "now 2: make the second book next", "send": "send a finished book", "help": "this list"}
ACTIVE = ("running", "queued", "paused")


def _listed(rows: DataFrame, into: str) -> DataFrame:
    """queue and into: the lines (n, line) of each queue, numbered and joined."""
    lines = F.array_sort(F.collect_list(F.struct("n", F.concat("n", F.lit(". "), "line").alias("line"))))
    return rows.groupBy("queue").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias(into))


def states(jobs: DataFrame, newest: int = 12) -> DataFrame:
    """queue, current, queued and done: what each queue answers.

    jobs: queue, job, title, status (running, queued, paused, held, done, failed or others, which do not count), position,
    done and total (clips), seconds (what is left), finished (text) and note. Jobs are made one after another in their
    order, the running one first; held ones wait for later. Null counts are 0, a null title is empty. The lines of a queue
    are one text, so a queue is as long as someone would read."""
    title = F.coalesce("title", F.lit(""))
    own = jobs.withColumns({"title": title, "left": F.coalesce("seconds", F.lit(0))})
    line = Window.partitionBy("queue").orderBy((F.col("status") != "running").cast("int"), "position", "job")
    active = own.where(F.col("status").isin(*ACTIVE, "held")).withColumn("due", F.sum(F.when(F.col("status").isin(*ACTIVE), F.col("left")).otherwise(0)).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    active = active.withColumn("n", F.row_number().over(line))
    tail = F.when(F.col("status") == "held", "saved for later").otherwise(F.concat(F.lit("done in "), script.clock(F.col("due"))))
    queued = _listed(active.select("queue", "n", F.concat(F.left("title", F.lit(38)), F.lit(" — "), "status", F.lit(", "), tail).alias("line")), "queued")
    running = active.where("status = 'running'").groupBy("queue").agg(F.min_by(F.struct("title", "done", "total", "due", "note"), "n").alias("r"))
    waiting = active.where("status IN ('queued', 'paused')").groupBy("queue").agg(F.min_by("title", "n").alias("next"))
    share = F.floor(100 * F.coalesce("r.done", F.lit(0)) / F.col("r.total"))
    made = F.when(F.coalesce("r.total", F.lit(0)) > 0, F.concat(share, F.lit("% ("), F.coalesce("r.done", F.lit(0)), F.lit(" of "), "r.total", F.lit(")"))).otherwise(F.coalesce("r.note", F.lit("starting")))
    now = F.when(F.col("r").isNotNull(), F.concat(F.lit("Making “"), "r.title", F.lit("”: "), made, F.lit("\nDone in "), script.clock(F.col("r.due"))))
    now = now.when(F.col("next").isNotNull(), F.concat(F.lit("Nothing is being made right now. Next: “"), "next", F.lit("”."))).otherwise("Nothing is being made and nothing is waiting.")
    newest_first = Window.partitionBy("queue").orderBy(F.desc("finished"), F.desc("job"))
    ended = own.where(F.col("status").isin("done", "failed")).withColumn("n", F.row_number().over(newest_first)).where(F.col("n") <= newest)
    sign = F.when(F.col("status") == "done", "✓ ").otherwise("✗ ")
    done = _listed(ended.select("queue", "n", F.concat(sign, F.left("title", F.lit(38)), F.lit(" — "), F.coalesce("finished", F.lit(""))).alias("line")), "done")
    every = jobs.select("queue").distinct().join(queued, "queue", "left").join(running, "queue", "left").join(waiting, "queue", "left").join(done, "queue", "left")
    return every.select("queue", now.alias("current"), "queued", "done")


def answered(messages: DataFrame, state: DataFrame, text: str = "text", shown: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """messages (queue, text and others) with command and answer: what a queue's `states` say to current, queue and done, and
    the list of commands to help. What asks for a change (stop, now, send, spellings) has its command and no answer; a
    message that is no command has neither. Queues without jobs have nothing to make. Messages may be a stream: the state is
    joined to each batch as it is read then. `shown` is how an answer is given; a queue's answers are put so once, before
    they meet its messages."""
    listed = F.lit("Send: " + "; ".join(f"{k} ({v})" for k, v in ASKED.items() if k != "help") + ".")
    said = messages.withColumn("command", script.command(F.col(text))).join(state.select("queue", *(shown(F.col(c)).alias(f"_{c}") for c in ("current", "queued", "done"))), "queue", "left")

    def of(command: str, value: str, otherwise: str) -> Column:
        return F.when(F.col("command") == command, F.coalesce(value, shown(F.lit(otherwise))))

    answer = F.coalesce(
        of("current", "_current", "Nothing is being made and nothing is waiting."), of("queue", "_queued", "The queue is empty."), of("done", "_done", "Nothing has finished yet."),
        F.when(F.col("command") == "help", shown(listed)),
    )
    return said.withColumn("answer", answer).drop("_current", "_queued", "_done")
