"""Lines of speech in order: islands, neighbours, pauses, delivery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """rows with island: a number (from 1 in each `by`) for each run of equal values."""
    w = Window.partitionBy(by).orderBy(order)
    change = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & F.lag(order).over(w).isNotNull(), 0).otherwise(1)
    return rows.withColumn("_change", change).withColumn("island", F.sum("_change").over(w)).drop("_change")


def merged(rows: DataFrame, by: str, order: str, value: str, text: str) -> DataFrame:
    """One row for each island: its first position, its value, its lines joined by a space."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    out = islands(rows, by, order, value).groupBy(by, "island", value).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("lines"), listed.alias("_l"))
    return out.select(by, "island", value, "first", "lines", F.array_join(F.transform("_l", lambda x: x.t), " ").alias("text"))


def collapsed(rows: DataFrame, speaker: str, kind: str, narrator: str) -> DataFrame:
    """Speech of a minor kind given to the narrator."""
    return rows.withColumn(speaker, F.when(F.col(speaker) == kind, narrator).otherwise(F.col(speaker)))


def with_context(rows: DataFrame, by: str, order: str, text: str, width: int = 70) -> DataFrame:
    """rows with before: the end of the line before, in the whole list."""
    return rows.withColumn("before", F.coalesce(F.right(F.lag(text).over(Window.partitionBy(by).orderBy(order)), F.lit(width)), F.lit("")))


def roles(rows: DataFrame, speaker: str, first: str, order: list[str]) -> DataFrame:
    """Lines of each speaker: `first` leads, then by lines, then by who spoke first."""
    t = rows.groupBy(speaker).agg(F.count(F.lit(1)).alias("lines"), F.min(F.struct(*order)).alias("_at"))
    rank = F.row_number().over(Window.orderBy(F.col(speaker) != first, F.desc("lines"), "_at"))  # one row for each speaker
    return t.withColumn("rank", rank).drop("_at")


def alternations(rows: DataFrame, by: str, order: str, speaker: str) -> DataFrame:
    """Turns that come back to the speaker before last (A-B-A)."""
    w = Window.partitionBy(by).orderBy(order)
    one, two = F.lag(speaker, 1).over(w), F.lag(speaker, 2).over(w)
    return rows.withColumn("alternates", F.coalesce((F.col(speaker) == two) & (F.col(speaker) != one), F.lit(False)))


def last_known(rows: DataFrame, by: str, order: str, value: str, into: str) -> DataFrame:
    """rows with the latest value that is not null, carried forward."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(into, F.last(value, ignorenulls=True).over(w))


def pause_kind(rows: DataFrame, by: str, order: str) -> DataFrame:
    """rows (kind, speaker, text, para_start, section_break, pause_ms) with why a pause stands before each line."""
    w = Window.partitionBy(by).orderBy(order)
    kind, text = F.lag("kind").over(w), F.rtrim(F.lag("text").over(w))
    stop = text.rlike("[,;:—–-]$")
    to_tag = (kind == "dialogue") & (F.col("kind") == "narration")
    why = (
        F.when(text.isNull(), "chapter_start").when(F.coalesce("section_break", F.lit(False)), "section_gap").when(F.coalesce("pause_ms", F.lit(0)) > 0, "explicit")
        .when(stop & to_tag, "before_tag").when(stop & (kind == "dialogue"), "comma_dialogue").when(stop, "comma_narration")
        .when(to_tag & (F.char_length("text") < 90), "before_tag").when(F.col("para_start"), "paragraph").otherwise("speaker_change")
    )
    return rows.withColumn("pause_kind", why)


def join_kind(text: Column) -> Column:
    """How a chunk ended, told from its text: end, comma or space."""
    bare = F.regexp_replace(F.rtrim(F.coalesce(text, F.lit(""))), "[\"”’')\\]]+$", "")
    return F.when((bare == "") | bare.rlike("[.!?…]$"), "end").when(bare.rlike("[,;:—–-]$"), "comma").otherwise("space")


def boundary_class(gap: Column) -> Column:
    """What a book has between two words: paragraph, question, exclaim, ..., with a quote that closes or opens."""
    quote = gap.rlike("[”\"]")
    opens = F.regexp_replace(gap, "^[.!?…,;:—– ”'’]+", "").rlike("[“\"]")
    base = (
        F.when(gap.contains("\n"), "paragraph").when(gap.contains("?"), "question").when(gap.contains("!"), "exclaim")
        .when(gap.contains("…") | gap.contains("..."), "ellipsis").when(gap.contains("."), "period")
        .when(gap.contains("—") | gap.contains("–") | gap.contains(" - "), "dash").when(gap.rlike("[;:]"), "semicolon")
        .when(gap.contains(","), "comma").when(gap.rlike("[“\"”]"), "quote").otherwise("word")
    )
    closes = quote & base.isin("period", "question", "exclaim", "comma", "ellipsis", "dash")
    return F.when(closes, F.concat(base, F.lit("+closequote"))).when(opens & base.isin("period", "question", "exclaim", "ellipsis"), F.concat(base, F.lit("+openquote"))).otherwise(base)


def offsets(rows: DataFrame, by: str, order: str, seconds: str) -> DataFrame:
    """rows with start_ms and end_ms: each length is rounded by itself, then added up."""
    ms = F.round(F.col(seconds) * 1000).cast("long")
    end = F.sum(ms).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("end_ms", end).withColumn("start_ms", F.col("end_ms") - ms)


def titled(rows: DataFrame, titles: DataFrame, by: str, order: str, pause_ms: int) -> DataFrame:
    """rows with a title line put first in each `by`; a first line equal to the title gives way to it."""
    same = lambda c: F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    numbered = rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order))).join(titles, by)
    body = numbered.where((F.col("_n") > 1) | (same(F.col("text")) != same(F.col("title"))))
    first = F.row_number().over(Window.partitionBy(by).orderBy(order)) == 1
    body = body.select(by, F.col(order).alias("pos"), "text", F.when(first, pause_ms).otherwise(0).alias("pause_ms"))
    heads = titles.join(rows.select(by).distinct(), by, "left_semi").select(by, F.lit(-1).cast(dict(rows.dtypes)[order]).alias("pos"), F.col("title").alias("text"), F.lit(0).alias("pause_ms"))
    return heads.unionByName(body)


def smoothed(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """rows with value weighed .6 with .2 of each neighbour (nothing beyond the ends), and the mean of what is there."""
    w = Window.partitionBy(by).orderBy(order)
    near = lambda f: F.coalesce(f(value).over(w), F.lit(0.0))
    return rows.withColumn("weighed", 0.6 * F.col(value) + 0.2 * near(F.lag) + 0.2 * near(F.lead)).withColumn("averaged", F.avg(value).over(w.rowsBetween(-1, 1)))


def capped_best(rows: DataFrame, tag: str, margin: str, order: str, want: int, cap: int) -> DataFrame:
    """The `want` rows of the highest margin, at most `cap` of each tag."""
    per_tag = F.row_number().over(Window.partitionBy(tag).orderBy(F.desc(margin), order))
    return rows.withColumn("_r", per_tag).where(F.col("_r") <= cap).orderBy(F.desc(margin), order).limit(want).drop("_r")


def longest_run(frames: DataFrame, by: str, order: str, quiet: str) -> DataFrame:
    """The longest quiet run between the first and the last loud frame, and the share of quiet frames."""
    spans = frames.groupBy(by).agg(F.min(F.when(~F.col(quiet), F.col(order))).alias("a"), F.max(F.when(~F.col(quiet), F.col(order))).alias("z"), F.avg(F.col(quiet).cast("double")).alias("quiet_share"))
    inner = frames.join(spans, by).where(F.col(order).between(F.col("a"), F.col("z")) & F.col(quiet))
    run = F.col(order) - F.row_number().over(Window.partitionBy(by).orderBy(order))
    runs = inner.withColumn("_run", run).groupBy(by, "_run").agg(F.count(F.lit(1)).alias("n")).groupBy(by).agg(F.max("n").alias("longest"))
    return spans.join(runs, by, "left").select(by, F.coalesce("longest", F.lit(0)).alias("longest"), "quiet_share")
