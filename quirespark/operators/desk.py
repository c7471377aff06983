"""What screens and tools do to the tables: choices, overlays, guards, estimates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pipeline(df: DataFrame, steps: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """df through steps that take and return a DataFrame."""
    for step in steps:
        df = df.transform(step)
    return df


def reassigned(lines: DataFrame, picked: DataFrame, key: str, target: str, narrator: str = "Narrator") -> DataFrame:
    """Picked lines given to target; a line without a speaker is the narrator's; the kind follows the speaker."""
    p = picked.select(key).distinct().withColumn("_picked", F.lit(True))
    who = F.when(F.col("_picked"), target).otherwise(F.when(F.btrim(F.coalesce("speaker", F.lit(""))) == "", narrator).otherwise(F.col("speaker")))
    return lines.join(p, key, "left").withColumn("speaker", who).withColumn("kind", F.when(F.col("speaker") == narrator, "narration").otherwise("dialogue")).drop("_picked")


def voices(roles: DataFrame, configured: DataFrame, default: str, pick: Column) -> DataFrame:
    """The voice of each role: its own, else the one that pick gives, else the default."""
    return roles.join(configured, "role", "left").withColumn("voice", F.coalesce("voice", pick, F.lit(default)))


def guarded_fixes(chunks: DataFrame, fixes: DataFrame, key: str) -> DataFrame:
    """chunks with the text of fixes made for exactly the text that is there."""
    f = fixes.select(key, F.col("was").alias("text"), F.col("new").alias("_new"))
    return chunks.join(f, [key, "text"], "left").withColumn("text", F.coalesce("_new", "text")).drop("_new")


def origins(passages: DataFrame, name: str, probs: str, least: float = 0.6, least_known: float = 0.9, home: str = "US", order: str | None = None) -> DataFrame:
    """For each name the setting of the highest mean probability over its passages, if that is high enough. A mean that
    equals the bound is above or below it by the order in which it was added up: with `order`, a column, it is added in
    that order, however the rows are dealt out."""
    if order:
        w = Window.partitionBy(name, "in_dictionary", "setting").orderBy(order)
        e = passages.select(name, "in_dictionary", order, F.explode(probs).alias("setting", "p"))
        e = e.select(name, "in_dictionary", "setting", F.row_number().over(w).alias("k"), *(f("p").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(c) for f, c in ((F.sum, "s"), (F.count, "n"))))
        m = e.groupBy(name, "in_dictionary", "setting").agg((F.max_by("s", "k") / F.nullif(F.max("n"), F.lit(0))).alias("p"))
    else:
        e = passages.select(name, "in_dictionary", F.explode(probs).alias("setting", "p"))
        m = e.groupBy(name, "in_dictionary", "setting").agg(F.avg("p").alias("p"))
    top = m.groupBy(name, "in_dictionary").agg(F.max_by("setting", F.struct("p", "setting")).alias("setting"), F.max("p").alias("p"))
    need = F.when(F.col("in_dictionary"), least_known).otherwise(least)
    return top.select(name, F.when(F.col("p") >= need, F.col("setting")).otherwise(home).alias("setting"), "p")


def filled(counts: DataFrame, lexicon: DataFrame, key: str, value: str) -> DataFrame:
    """lexicon with missing words added and empty values filled from counts; what is there stays."""
    c = counts.withColumnRenamed(value, "_new")
    return lexicon.join(c, key, "full").withColumn(value, F.coalesce(F.nullif(F.col(value), F.lit("")), "_new")).drop("_new")


def engine_labels(rows: DataFrame, by: str, label: str, amount: str) -> DataFrame:
    """For each `by` its labels by amount, the largest first, joined."""
    s = rows.groupBy(by, label).agg(F.sum(amount).alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("a"), F.col(label).alias("l"))))
    return s.groupBy(by).agg(F.array_join(F.transform(ordered, lambda x: x.l), ", ").alias("labels"), F.sum("n").alias("total"))


def alias_readings(words: DataFrame) -> DataFrame:
    """words (word, ipa, label, count) merged: counts for each label as a map, and for words without a reading the one
    of a word with the same letters."""
    w = words.groupBy("word", "label").agg(F.sum("count").alias("n"), F.first("ipa", ignorenulls=True).alias("ipa"))
    m = w.groupBy("word").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("texts"), F.sum("n").alias("count"), F.max("ipa").alias("ipa"))
    key = F.regexp_replace(F.lower("word"), "[^a-z]", "")
    shared = m.where("ipa IS NOT NULL").groupBy(key.alias("_k")).agg(F.min_by("ipa", "word").alias("_shared"))
    return m.withColumn("_k", key).join(shared, "_k", "left").withColumn("ipa", F.coalesce("ipa", "_shared")).drop("_k", "_shared")


def first_long_run(clips: DataFrame, by: str, order: str, there: str, seconds: str, target: float, gap: float = 0.4) -> DataFrame:
    """For each `by` the first unbroken run of clips that are there and together reach target seconds."""
    w = Window.partitionBy(by).orderBy(order)
    run = F.sum((~F.col(there)).cast("int")).over(w)
    so_far = F.sum(F.col(seconds) + gap).over(Window.partitionBy(by, "_run").orderBy(order))
    r = clips.withColumn("_run", run).where(F.col(there)).withColumn("so_far", so_far).withColumn("first", F.first(order).over(Window.partitionBy(by, "_run").orderBy(order)))
    return r.where(F.col("so_far") >= target).groupBy(by).agg(F.min_by(F.struct("first", F.col(order).alias("last"), "so_far"), order).alias("r")).select(by, "r.*")


def cast_of(lines: DataFrame, by: str, min_lines: int, min_cast: int, min_dialogue: float, narrator: str) -> DataFrame:
    """For each book its cast (speakers with enough lines), the share of dialogue, and whether it suits many voices."""
    per = lines.groupBy(by, "speaker").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("chars"))
    speaks = F.col("speaker") != narrator
    s = per.groupBy(by).agg(F.array_sort(F.collect_set(F.when(speaks & (F.col("n") >= min_lines), F.col("speaker")))).alias("cast"), (F.sum(F.when(speaks, F.col("chars")).otherwise(0)) / F.sum("chars")).alias("dialogue"))
    return s.withColumn("many", (F.size("cast") >= min_cast) & (F.col("dialogue") >= min_dialogue))


def expectations(rows: DataFrame, key: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """key and message for each rule that a row breaks (a rule that is null is kept)."""
    broken = F.array_compact(F.array(*[F.when(~rule, message) for message, rule in rules]))
    return rows.select(key, F.explode(broken).alias("message"))


def new_since(now: DataFrame, seen: DataFrame, by: str, value: str) -> DataFrame:
    """For each `by` the values there are now and have not been acknowledged, in order."""
    a = now.groupBy(by).agg(F.collect_set(value).alias("_now"))
    b = seen.groupBy(by).agg(F.collect_set(value).alias("_seen"))
    out = F.array_sort(F.array_except("_now", F.coalesce("_seen", F.array().cast("array<string>"))))
    return a.join(b, by, "left").select(by, out.alias("new"))


def next_step(stages: DataFrame, by: str) -> DataFrame:
    """For each `by` the first stage that is required or stale, else the first recommended."""
    rank = F.when(F.col("status").isin("required", "stale"), 0).when(F.col("status") == "recommended", 1)
    return stages.withColumn("_r", rank).where("_r IS NOT NULL").groupBy(by).agg(F.min_by("stage", F.struct("_r", "pos")).alias("next"))


def best_few(rows: DataFrame, by: str, distance: str, tie: str, keep: int, plain: str, margin: float) -> DataFrame:
    """The nearest few candidates of each `by`, and whether the plain one is near enough to the best to stay."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(distance, tie))
    best = F.min(distance).over(Window.partitionBy(by))
    own = F.min(F.when(F.col(plain), F.col(distance))).over(Window.partitionBy(by))
    return rows.withColumn("rank", n).withColumn("keep_plain", F.coalesce(own <= best + margin, F.lit(False))).where(F.col("rank") <= keep)


def estimate(chapters: DataFrame, rates: DataFrame, priors: dict[str, float], engine: str, chars: str) -> DataFrame:
    """Seconds a book takes, by measured rates or priors, and whether any had to be a prior."""
    prior = F.element_at(F.create_map(*[x for k, v in priors.items() for x in (F.lit(k), F.lit(v))]), F.col(engine))
    j = chapters.join(rates, engine, "left")
    return j.groupBy("book").agg(F.sum(F.col(chars) / F.coalesce("rate", prior)).alias("seconds"), F.bool_or(F.col("rate").isNull()).alias("estimated"))


def around(docs: DataFrame, word: str, width: int = 160) -> DataFrame:
    """doc_id and passage: the text around the first place of a word in each document that has it."""
    at = F.instr(F.lower("text"), word.lower())
    start = F.greatest(at - width, F.lit(1))
    return docs.where(at > 0).select("doc_id", F.substr("text", start, at + len(word) + width - start).alias("passage"))


def last_progress(log: DataFrame, by: str, order: str, line: str) -> DataFrame:
    """done and total of the last line of each log that has a/b."""
    ab = r"([0-9]+)/([0-9]+)"
    last = log.where(F.col(line).rlike(ab)).groupBy(by).agg(F.max_by(line, order).alias("_l"))
    return last.select(by, F.regexp_extract("_l", ab, 1).cast("int").alias("done"), F.regexp_extract("_l", ab, 2).cast("int").alias("total"))


def overlaid(saved: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """settings (a map) of saved over defaults; keys that defaults do not know go."""
    base = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv])
    own = F.map_filter(F.coalesce("settings", F.create_map().cast("map<string,string>")), lambda k, v: k.isin(list(defaults)) & v.isNotNull())
    keep = F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(own), k))
    return saved.withColumn("settings", F.map_concat(keep, own))


def inserted(chapters: DataFrame, new: DataFrame, by: str, after: int) -> DataFrame:
    """chapters with the rows of new put in after a position, numbered anew."""
    both = chapters.where(~F.col("opening")).withColumn("_p", F.col("index").cast("double")).unionByName(new.withColumn("_p", F.lit(after + 0.5)))
    return both.withColumn("index", F.row_number().over(Window.partitionBy(by).orderBy("_p"))).drop("_p")


def debiased(scores: DataFrame, key: str, option: str, p: str) -> DataFrame:
    """The mean probability of each option over the orders in which it was offered, and the best option of each key."""
    m = scores.groupBy(key, option).agg(F.avg(p).alias("p"))
    return m.groupBy(key).agg(F.max_by(option, F.struct("p", option)).alias("choice"), F.max("p").alias("p"))


def scored_in_batches(rows: DataFrame, start: Callable[[], Callable[[pd.Series], pd.Series]], text: str, into: str) -> DataFrame:
    """rows with a score of a model that start() makes once for each partition: for models supplied by the caller."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for batch in batches:
            model = model or start()
            yield batch.assign(**{into: model(batch[text]).astype(float)})

    from pyspark.sql import types as T

    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField(into, T.DoubleType())]))


def windows(rows: DataFrame, by: str, order: str, size: int = 40, overlap: int = 3) -> DataFrame:
    """rows in windows of `size`, each with the last `overlap` of the one before: a row may be in two."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    step = size - overlap
    first, last = F.greatest(F.ceil((F.col("_n") - size + 1) / step), F.lit(0)), F.floor(F.col("_n") / step)
    return rows.withColumn("_n", n).withColumn("window", F.explode(F.sequence(first.cast("int"), last.cast("int")))).drop("_n")


def first_due(jobs: DataFrame, now: Column, running: Column) -> DataFrame:
    """The next job to start: the first that is due, or none while one runs. Jobs are a short table."""
    busy = jobs.agg(F.coalesce(F.bool_or(running), F.lit(False)).alias("busy"))
    due = jobs.where(F.col("status").isin("queued", "paused") & (F.col("not_before").isNull() | (F.col("not_before") <= now)))
    return due.join(busy, ~F.col("busy")).orderBy("pos").limit(1).drop("busy")


def recent_context(rows: DataFrame, by: str, order: str, mentions: str, back: int = 3, most: int = 10) -> DataFrame:
    """rows with recent: the distinct names mentioned in the paragraphs just before, the latest first."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-back, -1)
    latest = F.reverse(F.flatten(F.collect_list(mentions).over(w)))
    return rows.withColumn("recent", F.slice(F.array_distinct(latest), 1, most))


def without_headings(paragraphs: DataFrame, by: str, order: str, title: str, most: int = 3) -> DataFrame:
    """paragraphs without up to three first ones that are headings: equal to or part of the title, or of its form."""
    same = lambda c: F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    text, own = same(F.col("text")), same(F.col(title))
    short = (F.char_length("text") <= 100) & (F.regexp_count("text", F.lit(r"\.")) <= 2)
    heading = short & (((text != "") & (own != "") & (own.contains(text) | text.contains(own))) | F.lower("text").rlike(r"^(?:chapter|book|part|section|act|scene)\s+(?:[0-9]+|[ivxlc]+)\b"))
    w = Window.partitionBy(by).orderBy(order)
    lead = F.min(heading.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1
    return paragraphs.withColumn("_lead", lead & (F.row_number().over(w) <= most)).where("NOT _lead").drop("_lead")


def likeliest(words: DataFrame, frequencies: DataFrame, margin: float, least: float, home: str) -> DataFrame:
    """word and lang: the language in which a word is most frequent, if it is by a margin more so than at home."""
    j = words.join(frequencies, "word", "left")
    own = F.max(F.when(F.col("lang") == home, F.col("zipf")))
    s = j.groupBy("word").agg(F.max_by("lang", F.struct("zipf", "lang")).alias("lang"), F.max("zipf").alias("zipf"), F.coalesce(own, F.lit(0.0)).alias("home"))
    ok = (F.char_length("word") >= 4) & (F.col("zipf") >= least) & (F.col("zipf") >= F.col("home") + margin)
    return s.select("word", F.when(ok, F.col("lang")).alias("lang"))


def choices(clones: DataFrame, engines: DataFrame, presets: DataFrame) -> DataFrame:
    """All voices to choose from: every clone with every engine (both are short lists), and the presets."""
    made = clones.join(engines, how="cross").select(F.concat(F.lit("clone:"), F.col("name"), F.lit("@"), F.col("engine")).alias("key"))
    return made.unionByName(presets.select(F.concat(F.lit("preset:"), F.col("name")).alias("key")))


def best_option(scores: DataFrame, option: str, item: str, score: str) -> DataFrame:
    """The option of the highest mean score over items, ties to the first by name."""
    m = scores.groupBy(option).agg(F.avg(score).alias("mean"), F.count_distinct(item).alias("items"))
    return m.orderBy(F.desc("mean"), option).limit(1)


def staleness(now: DataFrame, stamped: DataFrame, by: str) -> DataFrame:
    """For each `by` whether its fingerprint is the one that was stamped: fresh, stale or never."""
    s = stamped.select(by, F.col("fingerprint").alias("_was"))
    status = F.when(F.col("_was").isNull(), "never").when(F.col("_was") == F.col("fingerprint"), "fresh").otherwise("stale")
    return now.join(s, by, "left").select(by, status.alias("status"))


def grouped_setting(lexicon: DataFrame, known: list[str]) -> DataFrame:
    """lexicon with its setting as screens group it: known ones, other, and not placed."""
    setting = F.coalesce("setting", F.lit(""))
    return lexicon.withColumn("grouped", F.when(setting.isin(known), setting).when(setting == "", "not placed").otherwise("other"))
