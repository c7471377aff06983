"""How far each book is: the state of every step, what blocks it, and which step comes next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The steps in order.
STEPS = ["book", "voices", "names", "extras", "make", "fix"]


def stage_states(books: DataFrame, by: str) -> DataFrame:
    """One row for each book and step: by, pos (from 0), step, state, blocked_by and cost.

    books has, for each book, fingerprints of now and as stamped at the last time (chapters, chapters_was; voices,
    voices_was; speech, speech_was; build, build_was), counts (new_roles, new_names, open_names, flagged, weak_names) and
    flags (one_narrator, names_checked, extras_set, extras_lost, queued, built, has_clips, fixes_newer). A null stamp means
    that the step was never done, a null count or flag none. A book whose chapters are not as prepared blocks all steps
    but its own. Repeated rows give repeated steps; an empty table gives an empty result. No row meets another.
    """
    has = lambda c: F.coalesce(F.col(c), F.lit(False))
    some = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    same = lambda c: F.coalesce(F.col(c) == F.col(f"{c}_was"), F.lit(False))
    never = lambda c: F.col(f"{c}_was").isNull()
    blocked = ~same("chapters")
    none = F.lit(None).cast("string")

    def step(name: str, state: Column, free: bool = False, shut: str = "optional", cost: Column = none) -> Column:
        pos = F.lit(STEPS.index(name)).alias("pos")
        if free:
            return F.struct(pos, F.lit(name).alias("step"), state.alias("state"), none.alias("blocked_by"), none.alias("cost"))
        return F.struct(pos, F.lit(name).alias("step"), F.when(blocked, shut).otherwise(state).alias("state"), F.when(blocked, "book").alias("blocked_by"), F.when(~blocked, cost).alias("cost"))

    book = F.when(never("chapters"), "required").when(same("chapters"), "done").otherwise("stale")
    voices = F.when(has("one_narrator") | same("voices"), "done").when(~never("voices") & some("new_roles"), "stale").otherwise("recommended")
    names = F.when(has("names_checked") & some("new_names"), "stale").when(has("names_checked") | ~some("open_names"), "done").otherwise("recommended")
    extras = F.when(has("extras_lost"), "stale").when(has("extras_set"), "done").otherwise("optional")
    made = same("speech") & same("build")
    make = F.when(has("queued"), "busy").when(~has("built"), "required").when(made, "done").otherwise("stale")
    cost = F.when(make == "stale", F.when(never("speech"), "unknown").when(~same("speech"), "speech").otherwise("build"))
    fix = F.when(~has("has_clips"), "optional").when(has("built") & has("fixes_newer"), "stale").when(some("flagged") | some("weak_names"), "recommended").otherwise("optional")
    fixing = step("fix", fix, free=True)
    fixing = fixing.withField("blocked_by", F.when(~has("has_clips"), "make")).withField("cost", F.when(fix == "stale", "build"))
    rows = F.array(step("book", book, free=True), step("voices", voices), step("names", names), step("extras", extras), step("make", make, shut="required", cost=cost), fixing)
    return books.select(by, F.inline(rows))


def next_step(states: DataFrame, by: str, here: str | None = None) -> DataFrame:
    """The step of each book that needs someone next, up to the step `here` and without it: the first that is required or
    stale, else the first that is recommended. Books that need nothing have no row."""
    upto = STEPS.index(here) if here in STEPS else len(STEPS)
    urgency = F.when(F.col("state").isin("required", "stale"), 0).when(F.col("state") == "recommended", 1)
    open_ = states.where(F.col("pos") < upto).withColumn("_u", urgency).where("_u IS NOT NULL")
    return open_.groupBy(by).agg(F.min_by(F.struct("step", "state"), F.struct("_u", "pos")).alias("s")).select(by, "s.*")
