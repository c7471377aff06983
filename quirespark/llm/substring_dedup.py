"""Removal of long passages that an earlier document already has, by difference-cover anchors.

A set D of residues is a difference cover modulo v when every difference is one of two members of D. If two documents
share a run of n words from positions i and j, some k < v has both (i + k) % v and (j + k) % v in D. So windows of
n - v + 1 words, hashed only at positions whose residue is in D, are bound to meet: any run of n shared words holds a
shared anchor. Windows of n words are then looked at only around anchors that two documents share.

Within each slice of an Arrow batch equal hashes are settled first, so that one key never brings more rows to the
shuffle than there are slices, however many documents share it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirespark.llm import textkit as K
from quirespark.llm.rows import keyed
from quirespark.shared import table


def difference_cover(period: int) -> np.ndarray:
    """Residues such that each difference modulo period occurs; greedy, so a perfect set where the greedy one is."""
    fixed = {1: [0], 7: [0, 1, 3], 13: [0, 1, 3, 9], 21: [0, 1, 4, 14, 16], 31: [0, 1, 3, 8, 12, 18]}  # fixed values: perfect difference sets
    if period in fixed:
        return np.array(fixed[period])
    cover, met = [0], {0}
    while len(met) < period:
        gains = [len({(x - c) % period for c in cover} | {(c - x) % period for c in cover} | met) for x in range(period)]
        best = int(np.argmax(gains))
        met |= {(best - c) % period for c in cover} | {(c - best) % period for c in cover}
        cover.append(best)
    return np.array(sorted(cover))


def _first_of_each(hashes: list[np.ndarray], owner: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of one batch: their order by hash and key, which begin a group, and which stand behind a smaller key."""
    key = keys[owner]
    order = np.lexsort((key, *hashes))
    sorted_key = key[order]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = False
        for h in hashes:
            new[1:] |= h[order][1:] != h[order][:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    later = sorted_key != sorted_key[head]
    return order, new, later


def _anchors(width: int, period: int):
    cover = np.zeros(period, bool)
    cover[difference_cover(period)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, 1):
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            w = K.words(batch.column(1))
            at = K.within(w.ptr, width)
            owner = np.searchsorted(w.ptr, at, "right") - 1
            at, owner = (x[cover[(at - w.ptr[owner]) % period]] for x in (at, owner))
            h = K.window_hashes(w.hashes(), width)[at]
            order, new, later = _first_of_each([h], owner, keys)
            shared = np.zeros(len(order), bool)
            if len(order):
                group = np.cumsum(new) - 1
                shared = (np.bincount(group, later)[group] > 0) if later.any() else shared
            send = new | later  # one row for each hash and batch; later documents' anchors are known to be shared
            order, later, shared, h = order[send], later[send], shared[send], h
            own = keys[owner[order]]
            pos = (at - w.ptr[owner])[order]
            apart = K.mix(own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + pos.astype(np.uint64))  # a key of their own: they ask for no answer
            yield pa.RecordBatch.from_arrays([pa.array(np.where(later, apart, h[order]).view(np.int64)), pa.array(own), pa.array(pos.astype(np.int32)), pa.array(shared)], names=["h", "key", "pos", "known"])

    return run


def _all_alike(w: K.Words, at: np.ndarray, doc: np.ndarray, h: np.ndarray, width: int, cover: np.ndarray) -> np.ndarray:
    """All cover positions of each document that hold the same window as one of its positions in at; of a document's
    equal anchors only the first may have been sent."""
    hit = np.unique(doc)
    if not len(hit):
        return at
    n = np.maximum(w.counts[hit] - width + 1, 0)
    inside = K.ragged_range(w.ptr[hit], n)
    owner = np.repeat(hit, n)
    here = cover[(inside - w.ptr[owner]) % len(cover)]
    inside, owner = inside[here], owner[here]
    apart = np.uint64(0x9E3779B97F4A7C15)
    return inside[np.isin(h[inside] ^ owner.astype(np.uint64) * apart, h[at] ^ doc.astype(np.uint64) * apart)]


def _windows(words: int, width: int):
    period = words - width + 1
    cover = np.zeros(period, bool)
    cover[difference_cover(period)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, 1):
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            w = K.words(batch.column(1))
            lists = batch.column(2)
            counts = np.diff(lists.offsets.to_numpy())
            doc = np.repeat(np.arange(len(keys)), counts)
            h = w.hashes()
            anchor = _all_alike(w, w.ptr[doc] + lists.flatten().to_numpy(), doc, K.window_hashes(h, width), width, cover)
            doc = np.searchsorted(w.ptr, anchor, "right") - 1
            look = np.zeros(len(w.starts) + 1, np.int64)
            lo = np.maximum(anchor - (words - width), w.ptr[doc])
            hi = np.minimum(anchor, w.ptr[doc + 1] - words)
            lo, hi = lo[hi >= lo], hi[hi >= lo]
            np.add.at(look, lo, 1)
            np.add.at(look, hi + 1, -1)
            at = np.flatnonzero(np.cumsum(look[:-1]) > 0)
            owner = np.searchsorted(w.ptr, at, "right") - 1
            first, second = K.window_hashes(h, words)[at], K.window_hashes(h, words, 0x9FB21C651E98DF25)[at] >> np.uint64(32)
            order, new, later = _first_of_each([second, first], owner, keys)
            ask = order[new]
            gone = np.sort(order[later])  # an earlier document of the same batch has them
            run_at = np.flatnonzero(np.concatenate([[True], (np.diff(at[gone]) != 1) | (np.diff(owner[gone]) != 0)])) if len(gone) else np.zeros(0, np.int64)
            run_n = np.diff(np.append(run_at, len(gone)))
            head = gone[run_at]
            rows = np.concatenate([ask, head])
            own, pos = keys[owner[rows]], at[rows] - w.ptr[owner[rows]]
            known = np.concatenate([np.zeros(len(ask), np.int64), run_n])
            apart = K.mix(own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + pos.astype(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.where(known > 0, apart, first[rows]).view(np.int64)), pa.array(second[rows].astype(np.uint32).view(np.int32)), pa.array(own), pa.array(pos << 32 | known)],
                names=["h", "g", "key", "run"],
            )

    return run


def _cover(words: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, 1, 8 << 20):
            w = K.words(batch.column(1))
            spans = batch.column(2)
            counts = np.diff(spans.offsets.to_numpy())
            flat = spans.flatten()
            doc = np.repeat(np.arange(len(batch)), counts)
            runs = flat.to_numpy(zero_copy_only=False)
            pos, n = runs >> 32, np.maximum(runs & 0xFFFFFFFF, 1)
            start = w.ptr[doc] + pos
            # a document may hold the same window at several places, of which one asked for all
            hit = np.unique(doc)
            dead = np.zeros(len(w.starts), bool)
            at = K.ragged_range(start, n)
            if len(hit):
                inside = K.ragged_range(w.ptr[hit], np.maximum(w.counts[hit] - words + 1, 0))
                h = K.window_hashes(w.hashes(), words)
                owner = (np.searchsorted(w.ptr, inside, "right") - 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                asked = (np.searchsorted(w.ptr, at, "right") - 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                at = inside[np.isin(h[inside] ^ owner, h[at] ^ asked)]
                edge = np.zeros(len(w.starts) + 1, np.int32)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + words, -1)
                dead = np.cumsum(edge[:-1]) > 0
            removed = np.add.reduceat(np.append(dead, False), np.minimum(w.ptr[:-1], len(dead)), dtype=np.int64) if len(dead) else np.zeros(len(batch), np.int64)
            removed[w.counts == 0] = 0
            text = joined(w, ~dead)
            out = [batch.column(3), pa.array(w.counts), pa.array(removed)]
            if with_text:
                out.append(text.cast(pa.string()))
            out.append(pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in text]))
            yield pa.RecordBatch.from_arrays(out, names=[str(i) for i in range(len(out))])

    return run


def joined(w: K.Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    starts, lens = w.starts[keep], (w.ends - w.starts)[keep]
    owner = (np.searchsorted(w.ptr, np.flatnonzero(keep), "right") - 1) if len(keep) else np.zeros(0, np.int64)
    data = np.append(w.data, np.uint8(32))
    size = lens + 1
    at = K.ragged_range(starts, size)
    ends = np.cumsum(size)
    at[ends - 1] = len(data) - 1
    per_doc = np.zeros(len(w.docs) - 1, np.int64)
    np.add.at(per_doc, owner, size)
    some = per_doc > 0
    drop = np.cumsum(per_doc)[some] - 1  # the space after the last word
    flat = np.delete(data[at], drop)
    return K.binary_array(flat, np.concatenate([[0], np.cumsum(per_doc - some)]))


def remove_repeated(docs: DataFrame, words: int = 50, period: int = 31, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Drop every word covered by a window of `words` words that also starts in a document with a smaller id.

    Returns one row per input row: the id, n_words, n_removed, kept_text (unless with_text is False) and kept_sha256.
    Words are runs of other characters than space and \\x09-\\x0D. Windows are judged on the input.

    Null and empty texts have no words; their kept text is empty. Texts shorter than a window lose nothing. Ids that
    are null come after all others, and rows that repeat an id count as further documents in the order of their
    texts' hashes. An empty table gives an empty result. Further columns are ignored. period must be below words;
    anchors have words - period + 1 words.
    """
    width = words - period + 1
    own = keyed(docs, id_col, text_col)
    text = own.select("key", "text", "id")
    anchors = own.select("key", "text").mapInArrow(_anchors(width, period), "h long, key long, pos int, known boolean")
    shared = anchors.withColumn("known", F.col("known") | (F.count(F.lit(1)).over(Window.partitionBy("h")) > 1)).where("known")
    flagged = shared.groupBy("key").agg(F.collect_list("pos").alias("at"))
    # both joins are left joins over the same columns, so that Spark deals out the texts once
    around = text.join(flagged.hint("shuffle_hash"), "key", "left").select("key", "text", F.coalesce("at", F.array().cast("array<int>")).alias("at"), "id")
    # run: the position and, below it, how many windows from there are known to go (0: ask whether an earlier document has this one)
    found = around.mapInArrow(_windows(words, width), "h long, g int, key long, run long")
    first = F.min("key").over(Window.partitionBy("h", "g"))
    late = found.withColumn("first", first).where((F.col("run").bitwiseAND(F.lit(0xFFFFFFFF)) > 0) | (F.col("first") < F.col("key")))
    gone = late.groupBy("key").agg(F.collect_list("run").alias("gone"))
    marked = text.join(gone.hint("shuffle_hash"), "key", "left").select("key", "text", F.coalesce("gone", F.array().cast("array<long>")).alias("gone"), "id")
    kind = dict(own.dtypes)["id"]
    return marked.mapInArrow(_cover(words, with_text), f"{id_col} {kind}, n_words long, n_removed long, " + "kept_text string, " * with_text + "kept_sha256 string")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated(table(spark, sf_dir, "documents"), with_text=False)


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(ws) - 48)) AS i, ws FROM w WHERE len(ws) >= 50),
k AS (SELECT doc_id, i, array_to_string(ws[i : i + 49], ' ') AS win FROM s),
m AS (SELECT win, min(doc_id) AS first FROM k GROUP BY win),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM k JOIN m USING (win) WHERE first < doc_id),
gone AS (SELECT doc_id, list(p) AS ps FROM hit GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE list_filter(ws, lambda x, j: NOT list_contains(ps, j)) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""
