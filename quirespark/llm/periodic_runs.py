"""Stretches of text that repeat with a period: runs of words, found by way of all tandem repeats (squares).

The method is that of Gusfield and Stoye. The text is cut into Lempel-Ziv blocks; common extensions around the ends of
each block give squares that cover the leftmost occurrence of every kind of square. From each, suffix links lead from a
square to its rotation by one word, until the walk leaves the suffix tree or meets a square that is known: then the
vocabulary is complete. The leaves below a square's place in the tree are its occurrences; neighbouring occurrences of
one period are a run.

The tree is kept as arrays: names of all substrings of 2 ** k words (equal substrings, equal names, in the order of the
words), the suffix array, and intervals of it as inner nodes. Many stretches of text are taken through the steps at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.llm import textkit as K
from quirespark.llm.substring_dedup import joined
from quirespark.shared import table

#: Words taken through the steps at once; a longer stretch is taken alone.
CHUNK = 1 << 18


class Tree:
    """The suffix tree of s, whole numbers of which the first and last occur nowhere else."""

    def __init__(self, s: np.ndarray):
        self.s, self.n = s, len(s)
        names = [np.unique(s, return_inverse=True)[1].astype(np.int32)]
        while int(names[-1].max(initial=-1)) + 1 < self.n:
            last, step = names[-1], 1 << (len(names) - 1)
            after = np.full(self.n, -1, np.int64)
            after[:-step] = last[step:]
            names.append(np.unique(last.astype(np.int64) * (self.n + 1) + after + 1, return_inverse=True)[1].astype(np.int32))
        self.names = np.stack(names)
        self.rank = self.names[-1].astype(np.int64)
        self.leaves = np.argsort(self.rank)

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How far the words from i and from j agree (i and j differ)."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            a, b = i + out, j + out
            out += (self.names[k][a] == self.names[k][b]).astype(np.int64) << k
        return out

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How far the words up to i and up to j agree, both included."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            a, b = i - out - (1 << k) + 1, j - out - (1 << k) + 1
            fits = (a >= 0) & (b >= 0)
            out += (fits & (self.names[k][np.maximum(a, 0)] == self.names[k][np.maximum(b, 0)])).astype(np.int64) << k
        return out

    def _same(self, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether size words from i and from j agree; i + size lies within the text."""
        k = np.frexp(size.astype(np.float64))[1] - 1
        tail = size - (1 << k)
        fits = j + size <= self.n
        j = np.where(fits, j, 0)
        return fits & (self.names[k, i] == self.names[k, j]) & (self.names[k, i + tail] == self.names[k, j + tail])

    def node(self, i: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaves, from and to, below the place of the size words from i."""
        lo, hi = np.zeros(len(i), np.int64), self.rank[i]
        while (lo < hi).any():
            mid = (lo + hi) >> 1
            same = self._same(i, self.leaves[mid], size)
            lo, hi = np.where(same, lo, mid + 1), np.where(same, mid, hi)
            hi = np.maximum(lo, hi)
        first = lo
        lo, hi = self.rank[i], np.full(len(i), self.n - 1)
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            same = self._same(i, self.leaves[mid], size)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return first, lo + 1

    def child(self, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Among the leaves lo:hi, which agree in depth words, one that goes on with word, and whether there is any."""
        end = hi - 1
        while (lo < end).any():
            mid = (lo + end) >> 1
            small = self.s[np.minimum(self.leaves[mid] + depth, self.n - 1)] < word
            lo, end = np.where(small, mid + 1, lo), np.where(small, end, mid)
            end = np.maximum(lo, end)
        lo = np.minimum(lo, hi - 1)
        at = self.leaves[lo]
        return at, (at + depth < self.n) & (self.s[np.minimum(at + depth, self.n - 1)] == word)

    def earlier(self) -> np.ndarray:
        """For each place the length of the longest substring from it that also begins before it."""
        before, after = np.full(self.n, -1), np.full(self.n, -1)
        open_ = []
        for i in self.leaves.tolist():
            while open_ and open_[-1] > i:
                after[open_.pop()] = i
            if open_:
                before[i] = open_[-1]
            open_.append(i)
        out = np.zeros(self.n, np.int64)
        for other in (before, after):
            some = np.flatnonzero(other >= 0)
            out[some] = np.maximum(out[some], self.forward(some, other[some]))
        return out


def blocks(tree: Tree) -> np.ndarray:
    """Where the Lempel-Ziv blocks begin, and the end of the text."""
    size, starts, at = np.maximum(tree.earlier(), 1).tolist(), [], 0
    while at < tree.n:
        starts.append(at)
        at += size[at]
    return np.array([*starts, tree.n])


def covering(tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Squares (start, period) such that the leftmost occurrence of every kind of square follows one of them in its run."""
    cut = blocks(tree)
    begin, end = cut[:-1], cut[1:]
    size = end - begin
    # centres at the end of a block
    which = np.repeat(np.arange(len(size)), np.where(end < tree.n, size, 0))
    k = K.ragged_range(np.ones(len(size), np.int64), np.where(end < tree.n, size, 0))
    q = end[which] - k
    ahead = tree.forward(end[which], q)
    back = np.where(q > 0, tree.backward(end[which] - 1, np.maximum(q - 1, 0)), 0)
    good = (ahead + back >= k) & (ahead > 0)
    one = np.stack([np.maximum(q - back, q - k + 1), k])[:, good]
    # centres within a block, whose second half may reach into the next
    reach = np.minimum(size + np.append(size[1:], 0), tree.n - 1 - begin)
    which = np.repeat(np.arange(len(size)), reach)
    k = K.ragged_range(np.ones(len(size), np.int64), reach)
    h = begin[which]
    ahead = tree.forward(h, h + k)
    back = np.where(h > 0, tree.backward(np.maximum(h - 1, 0), h + k - 1), 0)
    start = np.maximum(h - back, h - k + 1)
    good = (ahead + back >= k) & (ahead > 0) & (start + k <= end[which]) & (back > 0)
    both = np.concatenate([one, np.stack([start, k])[:, good]], axis=1)
    return both[0], both[1]


def primitive(tree: Tree, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether the half of a square is not itself a repetition."""
    largest = int(period.max(initial=1))
    factor = np.arange(largest + 1)
    for p in range(2, int(largest**0.5) + 1):
        if factor[p] == p:
            multiple = factor[p * p :: p]
            multiple[multiple == np.arange(p * p, largest + 1, p)] = p
    out, rest = np.ones(len(start), bool), period.copy()
    while (rest > 1).any():
        some = np.flatnonzero((rest > 1) & out)
        if not len(some):
            break
        short = period[some] // factor[rest[some]]
        out[some] = tree.forward(start[some], start[some] + short) < period[some] - short
        rest[some] //= factor[rest[some]]
    return out


def vocabulary(tree: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All kinds of squares whose half is no repetition: period, and from and to of the leaves that begin with it."""
    at, period = covering(tree)
    good = primitive(tree, at, period) if len(at) else np.zeros(0, bool)
    at, period = at[good], period[good]
    known = np.zeros(0, np.int64)
    periods, firsts, lasts = [], [], []
    while len(at):
        # walkers in one run begin with the leftmost of them
        left = at - np.where(at > 0, tree.backward(np.maximum(at - 1, 0), np.maximum(at + period - 1, 0)), 0)
        order = np.lexsort((at, period, left))
        new = np.concatenate([[True], (np.diff(left[order]) != 0) | (np.diff(period[order]) != 0)])
        at, period = at[order][new], period[order][new]
        # a suffix link and one word down lead to the next place of the run, until every rotation was seen or the run ends
        room = tree.forward(at, at + period) - period
        steps = np.minimum(room + 1, period)
        seen, long = K.ragged_range(at, steps), np.repeat(period, steps)
        lo, hi = tree.node(seen, 2 * long)
        place, pick = np.unique(lo * (tree.n + 1) + long, return_index=True)
        pick = pick[~np.isin(place, known)]
        known = np.union1d(known, place)
        periods.append(long[pick])
        firsts.append(lo[pick])
        lasts.append(hi[pick])
        # at the end of its run a walk may go on elsewhere in the tree
        stop = np.flatnonzero(room + 1 < period)
        i, p = at[stop] + room[stop], period[stop]
        lo, hi = tree.node(i + 1, 2 * p - 1)
        on, there = tree.child(lo, hi, 2 * p - 1, tree.s[i])
        on, p = on[there], p[there]
        lo, _ = tree.node(on, 2 * p)
        fresh = ~np.isin(lo * (tree.n + 1) + p, known)
        at, period = on[fresh], p[fresh]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *periods]), np.concatenate([none, *firsts]), np.concatenate([none, *lasts])


def runs_of(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end and smallest period of every run of s (at least two periods long), by start, then period. The first and
    last number of s must occur nowhere else."""
    tree = Tree(s)
    period, lo, hi = vocabulary(tree)
    where, long = tree.leaves[K.ragged_range(lo, hi - lo)], np.repeat(period, hi - lo)
    order = np.lexsort((where, long))
    where, long = where[order], long[order]
    if not len(where):
        return where, where, where
    first = np.concatenate([[True], (np.diff(where) != 1) | (np.diff(long) != 0)])
    last = np.append(first[1:], True)
    start, end, period = where[first], where[last] + 2 * long[first], long[first]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _stretches(w: K.Words, h: np.ndarray, min_length: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """from and to of stretches of words outside of which no run lies.

    In a run of at least min_length words and `times` periods, the words before the last period come again one period
    later, and are at least (times - 1) / times of its length: so every word of the run is in a window of that many words
    that comes again in the document, within the document's length / times.
    """
    width = max(1, -(-min_length * (times - 1) // times))
    at = K.within(w.ptr, width)
    if not len(at):
        return at, at
    doc = np.searchsorted(w.ptr, at, "right") - 1
    key = K.window_hashes(h, width)[at] ^ K.mix(doc.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    key, where, owner = key[order], at[order], doc[order]
    again = (key[1:] == key[:-1]) & (owner[1:] == owner[:-1]) & (np.diff(where) <= w.counts[owner[1:]] // times)
    hit = np.concatenate([where[:-1][again], where[1:][again]])
    edge = np.zeros(len(w.starts) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + width, -1)
    inside = np.cumsum(edge[:-1]) > 0
    new = np.zeros(len(inside) + 1, bool)
    new[w.ptr[:-1]] = True  # stretches end with their document
    start = np.flatnonzero(inside & (new[:-1] | ~np.concatenate([[False], inside[:-1]])))
    stop = np.flatnonzero(inside & (new[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    return start, stop


def _located(w: K.Words, min_length: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """document, start (within it), length and period of every run that is long enough, by document, start and period."""
    h = w.hashes()
    start, stop = _stretches(w, h, min_length, times)
    found, lo = [np.zeros((3, 0), np.int64)], 0
    ends = np.cumsum(stop - start)
    while lo < len(start):
        done = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + CHUNK, "right")))
        size = stop[lo:hi] - start[lo:hi]
        place = K.ragged_range(start[lo:hi], size)
        ids = np.unique(h[place], return_inverse=True)[1].astype(np.int64)
        # every stretch has a word before it, and the last one after it, that occur nowhere else
        before = np.concatenate([[0], np.cumsum(size)[:-1]])
        s = np.insert(ids, before, -1 - np.arange(len(size)))
        s = np.append(s, len(ids) + 1)
        back = np.append(np.insert(place, before, -1), -1)
        a, b, p = runs_of(s)
        good = b - a >= np.maximum(min_length, times * p)
        found.append(np.stack([back[a[good]], (b - a)[good], p[good]]))
        lo = hi
    at, length, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, at))
    at, length, period = at[order], length[order], period[order]
    doc = np.searchsorted(w.ptr, at, "right") - 1
    return doc, at - w.ptr[doc], length, period


def _found(min_length: int, times: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, 1, 8 << 20):
            w = K.words(batch.column(1))
            doc, start, length, period = _located(w, min_length, times)
            edge = np.zeros(len(w.starts) + 1, np.int64)
            np.add.at(edge, w.ptr[doc] + start + period, 1)
            np.add.at(edge, w.ptr[doc] + start + length, -1)
            text = joined(w, np.cumsum(edge[:-1]) <= 0)
            ptr = np.searchsorted(doc, np.arange(len(batch) + 1)).astype(np.int32)
            spans = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], ["start", "length", "period"])
            out = [batch.column(0), pa.array(w.counts), pa.ListArray.from_arrays(pa.array(ptr), spans)]
            if with_text:
                out.append(text.cast(pa.string()))
            out.append(pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in text]))
            yield pa.RecordBatch.from_arrays(out, names=[str(i) for i in range(len(out))])

    return run


def periodic_runs(docs: DataFrame, min_length: int = 24, times: int = 3, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """id_col, n_words, runs (start, length, period; by start, then period), collapsed_text (unless with_text is False) and
    collapsed_sha256 of each row.

    A run is a stretch of consecutive words with smallest period q, at least min_length words and times * q long, which
    no neighbouring word extends. The collapsed text keeps of each run its first q words, and words outside of runs.
    Words are runs of other characters than space and \\x09-\\x0D, numbered from 0; the collapsed ones are joined by one space.

    Null, empty and blank texts have no words and no runs; their collapsed text is empty. Very long texts are searched
    whole: a slice of an Arrow batch holds one text at least, and what is searched of it needs about 4 bytes a word for
    each power of two up to its length. Runs may overlap; a word is dropped if any run drops it. Ids may repeat or be null:
    each row is judged alone. An empty table gives an empty result. Further columns are ignored. times is 2 or more.
    """
    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, " + "collapsed_text string, " * with_text + "collapsed_sha256 string"
    return docs.select(id_col, text_col).mapInArrow(_found(min_length, times, with_text), schema)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text; where crc32 of the id ends in 0 the words from number a on repeat with a period (see op12)."""
    rows = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    rows = rows.withColumn("w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1)))
    rows = rows.withColumns({"n": F.size("w"), "g": F.floor(F.col("h") / 10)}).withColumn("a", F.expr("CASE WHEN n > 0 THEN cast(g % n AS int) END"))
    rows = rows.withColumn("p", F.expr("cast(1 + floor((n - a) / (3 + g % 8)) AS int)"))
    again = F.expr("slice(concat(slice(w, 1, a), flatten(array_repeat(slice(w, a + 1, p), cast(ceil((n - a) / p) AS int)))), 1, n)")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic_runs(planted(table(spark, sf_dir, "documents")), min_length=24, times=3, with_text=False)
    best = F.expr("array_sort(runs, (x, y) -> CASE WHEN x.length * y.period > y.length * x.period THEN -1 WHEN x.length * y.period < y.length * x.period THEN 1 WHEN x.start < y.start THEN -1 WHEN x.start > y.start THEN 1 ELSE cast(sign(x.period - y.period) AS int) END)")
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r.start, F.lit(","), r.length, F.lit(","), r.period, F.lit("\n"))), "")
    top = rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.get(best, F.lit(0)).alias("b"), F.sha2(F.encode(listed, "UTF-8"), 256).alias("runs_sha256"), "collapsed_sha256")
    return top.select("doc_id", "n_runs", "b.start", "b.length", "b.period", F.expr("1000 * b.length div b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


ORACLE = r"""
WITH tab AS MATERIALIZED (SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce(range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) AS c FROM range(256) AS u(n))),
d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS h FROM documents, tab),
g AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
f AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM g),
docs AS MATERIALIZED (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) END AS w FROM f),
win AS MATERIALIZED (SELECT doc_id, i, hash(w[i + 1 : i + 16]) AS k, w[i + 1 : i + 16] AS win FROM docs, LATERAL (SELECT unnest(range(n - 15)) AS i) AS u WHERE n >= 24),
m AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM win AS x JOIN win AS y ON x.doc_id = y.doc_id AND x.k = y.k AND x.i < y.i AND x.win = y.win),
isl AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS z FROM m),
r AS (SELECT doc_id, q, min(i) AS s, max(i) + 16 + q - min(i) AS len FROM isl GROUP BY doc_id, q, z HAVING len >= greatest(24, 3 * q)),
runs AS MATERIALIZED (SELECT doc_id, s, len, min(q) AS q FROM r GROUP BY doc_id, s, len),
gone AS (SELECT doc_id, list(DISTINCT j) AS js FROM (SELECT doc_id, unnest(range(s + q, s + len)) AS j FROM runs) GROUP BY doc_id),
per AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM runs GROUP BY doc_id),
top AS (SELECT * FROM (SELECT x.*, row_number() OVER (PARTITION BY doc_id ORDER BY len::DOUBLE / q DESC, s, q) AS o FROM runs AS x) WHERE o = 1)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s AS start, len AS length, q AS period, 1000 * len // q AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256,
  sha256(array_to_string(CASE WHEN js IS NULL THEN d.w ELSE list_filter(d.w, lambda x, j: NOT list_contains(js, j - 1)) END, ' ')) AS collapsed_sha256
FROM docs AS d LEFT JOIN per USING (doc_id) LEFT JOIN top USING (doc_id) LEFT JOIN gone USING (doc_id)
"""
