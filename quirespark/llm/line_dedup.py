"""Removal of lines that many documents share, from levelled sorted runs of line hashes. DataFrame functions only.

A run holds a row for each line key: its hashes and the number of documents that have it. It is a table bucketed and
sorted by hash, so joins and merges of runs neither shuffle nor sort it. Documents come in batches of bounded size. Each
batch merge-anti-joins the runs, which drops the keys that a run already knows to be frequent, and adds the counts of
the others as a run of level 0; two runs of one level are merged into one of the next.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.llm.rows import keyed, whole_rows
from quirespark.shared import discard, new_path, partitions, table

#: A larger table has larger batches, not more of them: they are taken one after another.
MOST_BATCHES = 64
_BLANKS = " \t\n\x0b\x0c\r"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """The line without [\\x20\\x09-\\x0D] at its ends, A-Z lower-cased. lower() is quick, and right where all is ASCII."""
    bare = F.btrim(line, F.lit(_BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _CAPITALS, _CAPITALS.lower()))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _kept() -> Column:
    kept = F.array_join(F.filter(lines_of(F.col("text")), lambda x, i: ~F.coalesce(F.get("gone", i), F.lit(False))), "\n")
    return F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept)


def flags_at(positions: Column) -> Column:
    """Ascending positions as an array of flags, true at each of them: one step a position, one look-up a line."""
    gap = lambda p, j: p - F.coalesce(F.get(positions, j - 1), F.lit(-1)) - 1
    return F.flatten(F.transform(positions, lambda p, j: F.concat(F.array_repeat(F.lit(False), gap(p, j)), F.array(F.lit(True)))))


@contextmanager
def _run_scans(spark: SparkSession):
    """What is planned and run in here reads runs by bucket, in their order (each bucket of a run is one sorted file), and
    counts the lines of a batch before it meets the runs, so that a frequent line is combined before it is shuffled."""
    wanted = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.optimizer.excludedRules": "org.apache.spark.sql.catalyst.optimizer.PushDownLeftSemiAntiJoin"}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        own = before[name] if name.endswith("excludedRules") else None  # what the caller leaves out stays left out
        spark.conf.set(name, f"{own},{value}" if own else value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


class LineRuns:
    """Levelled sorted runs in the shared folder. A row: h and g (hashes of a key), n (documents that have it).

    Level k has one run at most. One more is merged with it into a run of level k + 1, so a row is written again once a
    level, and the levels grow with the logarithm of the number of batches.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.levels, self.buckets = spark, [], partitions(spark)

    def runs(self) -> list[tuple[str, str]]:
        """Table and path of each run, the smallest first."""
        return [run for run in self.levels if run]

    def _write(self, counts: DataFrame) -> tuple[str, str]:
        """counts come dealt by h and g: each task holds whole buckets and writes one sorted file for each."""
        path, name = new_path(self.spark, "line-run"), f"line_run_{uuid.uuid4().hex}"
        counts.write.bucketBy(self.buckets, "h", "g").sortBy("h", "g").option("compression", "zstd").option("path", path).saveAsTable(name)
        return name, path

    def _drop(self, run: tuple[str, str]) -> None:
        self.spark.sql(f"DROP TABLE {run[0]}")
        discard(self.spark, run[1])

    def close(self) -> None:
        """Delete all runs. Nothing may read them any more."""
        for run in self.runs():
            self._drop(run)
        self.levels = []

    def merged(self, one: tuple[str, str], two: tuple[str, str]) -> DataFrame:
        a, b = (self.spark.table(name).withColumnRenamed("n", n) for (name, _), n in ((one, "n"), (two, "m")))
        return a.join(b.hint("merge"), ["h", "g"], "full").select("h", "g", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))

    def _merge(self, one: tuple[str, str], two: tuple[str, str]) -> tuple[str, str]:
        with _run_scans(self.spark):
            run = self._write(self.merged(one, two))
        self._drop(one)
        self._drop(two)
        return run

    def add(self, counts: DataFrame) -> None:
        run, level = self._write(counts), 0
        while level < len(self.levels) and self.levels[level]:
            run, self.levels[level] = self._merge(self.levels[level], run), None
            level += 1
        self.levels[level:level + 1] = [run]

    def frequent(self, at_least: int) -> DataFrame | None:
        """Keys that the runs know in at_least documents, and in how many, as far as they were counted. Merges all runs
        into one. The result is written, so that joins can split its hot keys."""
        if not self.runs():
            return None
        one, *others = self.runs()
        for other in others:
            one = self._merge(one, other)
        self.levels = [None] * (len(self.levels) - 1) + [one]
        path = new_path(self.spark, "frequent-lines")
        self.spark.table(one[0]).where(F.col("n") >= at_least).write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema("h long, g int, n long").parquet(path)

    def unsettled(self, lines: DataFrame, at_least: int) -> DataFrame:
        """Counts of a batch of distinct (h, g, key) rows, without the keys that one of the runs has often enough."""
        counts = lines.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"))
        for name, _ in self.runs():
            counts = counts.join(self.spark.table(name).where(F.col("n") >= at_least).select("h", "g").hint("merge"), ["h", "g"], "left_anti")
        return counts

    def ingest(self, lines: DataFrame, at_least: int) -> None:
        """Add a batch of distinct (h, g, key) rows; keys that are frequent already need no more counting."""
        with _run_scans(self.spark):
            self.add(self.unsettled(lines, at_least))


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, task_lines: int = 1 << 14, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drop every line whose key is in at least min_docs documents, in all of them.

    Returns one row per input row: the id, n_lines (before), n_dropped, kept_text (the other lines joined by \\n).
    Texts are split at \\n. Keys of fewer than min_chars code points are never dropped. A batch has about task_lines
    lines for each shuffle partition of the session, or more where that would make more than MOST_BATCHES of them.

    Null and empty texts have one empty line, which stays (its key has no code point). A line that a document repeats
    counts once for it, and all its repeats go. Rows that repeat an id, or have none, count as further documents. An
    empty table gives an empty result. Further columns are ignored.
    """
    marked = _marked(keyed(docs, id_col, text_col), min_docs, min_chars, task_lines)
    n_lines = F.size(lines_of(F.col("text"))).cast("long").alias("n_lines")
    return marked.select(F.col("id").alias(id_col), n_lines, F.coalesce(F.size(F.filter("gone", lambda x: x)), F.lit(0)).cast("long").alias("n_dropped"), _kept().alias("kept_text"))


def without_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, task_lines: int = 1 << 14, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the kept text of each row in place of its text (see drop_frequent_lines)."""
    marked = _marked(whole_rows(docs, id_col, text_col), min_docs, min_chars, task_lines)
    return marked.select(*(_kept().alias(c) if c == text_col else F.col("rest")[c].alias(c) for c in docs.columns))


def _marked(own: DataFrame, min_docs: int, min_chars: int, task_lines: int) -> DataFrame:
    """own with gone, a flag for each of its first lines, true where it goes (null: none does)."""
    spark = own.sparkSession
    n_lines = own.agg(F.sum(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"))) + 1)).first()[0] or 0
    parts = partitions(spark)
    batches = min(MOST_BATCHES, max(1, -(-n_lines // (task_lines * parts))))
    keys = F.transform(lines_of(F.col("text")), line_key)
    long_enough = (lambda k: F.octet_length(k) > 0) if min_chars == 1 else (lambda k: F.char_length(k) >= min_chars)
    marks = F.transform(keys, lambda k, i: F.struct(F.when(long_enough(k), F.xxhash64(k)).alias("h"), F.hash(k).alias("g"), i.alias("i")))
    rows = own.select("key", F.inline(marks)).where("h IS NOT NULL")
    staged = new_path(spark, "lines")
    # dealt by batch and document, a task holds few batches: about four files for each partition, however many batches
    deal = {"batch": F.pmod(F.hash("key"), F.lit(batches)), "deal": F.pmod(F.xxhash64("key"), F.lit(-(-4 * parts // batches)))}
    dealt = rows.withColumns(deal).repartition(parts, "batch", "deal")
    (
        dealt.groupBy("batch", "deal", "h", "g", "key").agg(F.collect_list("i").alias("at")).select("h", "g", "key", "at", "batch")
        .write.option("compression", "zstd").partitionBy("batch").parquet(staged)
    )
    lines = spark.read.schema("h long, g int, key long, at array<int>, batch int").parquet(staged)
    runs = LineRuns(spark)
    try:
        for b in range(batches):
            runs.ingest(lines.where(F.col("batch") == b).select("h", "g", "key"), min_docs)
        gone = lines.select("h", "g", "key", "at").join(runs.frequent(min_docs).select("h", "g"), ["h", "g"], "left_semi")
    finally:
        runs.close()
    gone = gone.groupBy("key").agg(F.array_sort(F.flatten(F.collect_list("at"))).alias("at"))
    return own.join(gone.select("key", flags_at(F.col("at")).alias("gone")).hint("shuffle_hash"), "key", "left")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_frequent_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM d),
k AS (SELECT doc_id, i, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
