"""Near-duplicate documents by DartMinHash signatures, banded joins and exact verification.

DartMinHash: every element (a word shingle) with weight w (how often it occurs) owns a region [0, w) x [0, infinity). Darts fall on it as a
Poisson process that depends on the element alone, so equal elements of two documents see the same darts. A document of
total weight W takes the darts up to time t / W, about k (ln k + 3) in all, deals each to one of k coordinates and keeps
the earliest of each. Two coordinates agree with a probability equal to the weighted Jaccard similarity.

Bands of equal coordinates give coarse groups, by stars to the smallest document of each bucket; the pairs of a bucket
are never listed. Each group is verified exactly, in blocks of bounded size that meet within one task. In a group of more than one
block, documents similar to its most connected member are one component already and do not meet each other again.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.llm import textkit as K
from quirespark.llm.components import components
from quirespark.llm.embedding_dedup import local_roots
from quirespark.llm.rows import keys_of, whole_rows
from quirespark.shared import freeze, release, table

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_SALTS = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def dart_minhash(elements: np.ndarray, owner: np.ndarray, n: int, k: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Signatures (n, k) of n weighted sets: elements[i] with weights[i] (1 if None) belongs to set owner[i].

    A set without elements of positive weight has a row of the largest value. The elements of one set must differ.
    """
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    sig = np.full((n, k), empty)
    w = np.ones(len(elements)) if weights is None else np.asarray(weights, np.float64)
    total = np.bincount(owner, w, n)
    cells = np.ceil(w).astype(np.int64)  # regions are thrown at in strips of width 1
    partly = bool((cells != w).any())
    which = np.repeat(np.arange(len(elements)), cells)
    strip = K.ragged_range(np.zeros(len(elements), np.int64), cells)
    part = np.minimum(w[which] - strip, 1.0)
    seed = K.mix(elements[which] + strip.astype(np.uint64) * _GOLD)
    set_of = owner[which]
    todo, darts = total > 0, k * (np.log(k) + 3)
    while todo.any():
        until = np.zeros(n)
        until[todo] = darts / total[todo]
        at = np.flatnonzero(todo[set_of])
        time, thrown = np.zeros(len(at)), 0
        flat = sig.reshape(-1)
        while len(at):
            r = K.mix(seed[at] + np.uint64(thrown * int(_SALTS[0]) % (1 << 64)))
            time -= np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            inside = time <= until[set_of[at]]
            at, time, r = at[inside], time[inside], r[inside]
            hit = slice(None)
            if partly:
                hit = (K.mix(r ^ _SALTS[1]) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < part[at]
            face = K.mix(r[hit] ^ _SALTS[2])
            value = time[hit].astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32) | face & np.uint64(0xFFFFFFFF)
            np.minimum.at(flat, set_of[at[hit]] * k + (face >> np.uint64(32)).astype(np.int64) % k, value)
            thrown += 1
        todo &= (sig == empty).any(axis=1)
        darts *= 2
    return sig


def shingles(w: K.Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of width words and their documents; a text of fewer words is one shingle as a whole."""
    h = w.hashes()
    at = K.within(w.ptr, width)
    short = np.flatnonzero((w.counts > 0) & (w.counts < width))
    whole = text_hashes(h, w.ptr)[short]
    owner = np.concatenate([np.searchsorted(w.ptr, at, "right") - 1, short])
    return np.concatenate([K.window_hashes(h, width)[at], whole]), owner


def counted(element: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different elements of each owner and how often it has them: weighted sets."""
    order = np.lexsort((element, owner))
    element, owner = element[order], owner[order]
    new = np.ones(len(element), bool)
    new[1:] = (element[1:] != element[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return element[at], owner[at], np.diff(np.append(at, len(element)))


def unrolled(element: np.ndarray, owner: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted sets as plain ones: each repeat is an element of its own, so common ones count min(weight, weight)."""
    which = np.repeat(np.arange(len(element)), counts)
    repeat = K.ragged_range(np.zeros(len(element), np.int64), counts)
    return element[which] + repeat.astype(np.uint64) * _GOLD, owner[which]


def text_hashes(h: np.ndarray, ptr: np.ndarray, base: int = 0xA24BAED4963EE407) -> np.ndarray:
    """A hash of all words of each document."""
    counts = np.diff(ptr)
    values = h * K.powers(base, int(counts.max(initial=0)) + 1)[K.ragged_range(np.zeros(len(counts), np.int64), counts)]
    out = np.zeros(len(counts), np.uint64)
    if (counts > 0).any():
        out[counts > 0] = np.add.reduceat(values, ptr[:-1][counts > 0])
    return K.mix(out + counts.astype(np.uint64) * _GOLD)


def _sketch(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, 1, 2 << 20):
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            w = K.words(batch.column(1))
            h = w.hashes()
            first, second = text_hashes(h, w.ptr), text_hashes(h, w.ptr, 0x9FB21C651E98DF25)
            none = w.counts == 0
            first[none] = K.mix(keys[none].astype(np.uint64))  # texts without words are nobody's copies
            element, owner, weight = counted(*shingles(w, width))
            sig = dart_minhash(element, owner, len(batch), bands * rows, weight).reshape(len(batch), bands, rows)
            band = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(batch), bands)) * _GOLD
            for r in range(rows):
                band = K.mix(band * _SALTS[3] + sig[:, :, r])
            ends = np.concatenate([[0], np.cumsum(np.where(none, 0, bands))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(band[~none].reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(first.view(np.int64)), pa.array(second.view(np.int64)), lists], names=["key", "h", "g", "bands"])

    return run


def _verify(width: int, least: float):
    share = Fraction(least).limit_denominator(1000)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        same = key[1].as_py() == key[2].as_py()
        left = np.ones(len(rows), bool) if same else rows["part"].to_numpy() == key[1].as_py()
        right = left if same else ~left
        keys = rows["key"].to_numpy()
        element, owner = unrolled(*counted(*shingles(K.words(rows["text"]), width)))
        order = np.argsort(element, kind="stable")
        element, owner = element[order], owner[order]
        sizes = np.bincount(owner, minlength=len(rows)).astype(np.int64)
        start = K.groups(element)
        held = np.diff(np.append(start, len(element)))
        column = np.repeat(np.cumsum(held > 1) - 1, held)  # elements of one document alone meet nothing
        many = np.repeat(held > 1, held)
        column, owner = column[many], owner[many]
        common = np.zeros((int(left.sum()), int(right.sum())), np.int64)
        step = max(256, min(4096, (16 << 20) // max(len(rows), 1)))
        for lo in range(0, int(held[held > 1].size), step):
            a, b = np.searchsorted(column, [lo, lo + step])
            dense = np.zeros((len(rows), step), np.float32)
            dense[owner[a:b], column[a:b] - lo] = 1
            common += (dense[left] @ dense[right].T).astype(np.int64)
        union = sizes[left][:, None] + sizes[right][None, :] - common
        i, j = np.nonzero((common * share.denominator >= union * share.numerator) & (union > 0))
        i, j = np.flatnonzero(left)[i], np.flatnonzero(right)[j]
        i, j = i[i != j], j[i != j]
        root = local_roots(len(rows), i, j)
        low = np.full(len(rows), np.iinfo(np.int64).max)
        np.minimum.at(low, root, keys)
        low = low[root]
        some = low != keys
        K.give_back()
        return pa.table({"a": keys[some], "b": low[some]})

    return run


def _against(width: int, least: float):
    """Rows (grp, key, centre) whose text is similar enough to that of their group's centre."""
    share = Fraction(least).limit_denominator(1000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, 3, 4 << 20):
            sets = []
            for column in (3, 4):
                sets.append(unrolled(*counted(*shingles(K.words(batch.column(column)), width))))
            element, owner = (np.concatenate(x) for x in zip(*sets, strict=True))
            order = np.lexsort((element, owner))
            element, owner = element[order], owner[order]
            twice = (element[1:] == element[:-1]) & (owner[1:] == owner[:-1])
            common = np.bincount(owner[1:][twice], minlength=len(batch))
            union = np.bincount(owner, minlength=len(batch)) - common
            yield batch.select([0, 1, 2]).filter(pa.array((common * share.denominator >= union * share.numerator) & (union > 0)))

    return run


def near_duplicates(docs: DataFrame, least: float = 0.8, width: int = 5, bands: int = 28, rows: int = 5, block_docs: int = 256, block_chars: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group documents whose word shingles have a weighted Jaccard similarity of at least `least`.

    A shingle weighs as often as its document has it: the similarity of two is the sum of the smaller weights over that
    of the larger. Without repeats that is the similarity of sets.

    Returns one row per input row: the id, copy_of (the smallest id with the same words), group_id (the smallest id
    reachable by links) and kept (whether that is the row's own). Words are runs of other characters than space and
    \\x09-\\x0D. Pairs in a common band are verified exactly; a pair of similarity 0.8 is in none of 28 bands of 5
    with a probability of 0.00002.

    Null and empty texts have no words, link with nothing and are kept. A text of fewer than `width` words is one
    shingle, so only its copies link with it. Rows that repeat an id, or have none, are further documents (without an
    id after all others). An empty table gives an empty result. Further columns are ignored.
    """
    own, clean = keys_of(docs, id_col, text_col)
    out = _grouped(own, least, width, bands, rows, block_docs, block_chars)
    names = own.select("key", "id")
    if clean:
        kind = dict(own.dtypes)["id"]
        return out.select(*(F.col(c).cast(kind).alias(n) for c, n in (("key", id_col), ("class", "copy_of"), ("group", "group_id"))), (F.col("key") == F.col("group")).alias("kept"))
    out = freeze(out, "grouped")
    for c, n in (("key", id_col), ("class", "copy_of"), ("group", "group_id")):
        out = out.join(names.select(F.col("key").alias(c), F.col("id").alias(f"_{n}")), c)
    return out.select(F.col(f"_{id_col}").alias(id_col), F.col("_copy_of").alias("copy_of"), F.col("_group_id").alias("group_id"), (F.col("key") == F.col("group")).alias("kept"))


def first_of_each_group(docs: DataFrame, least: float = 0.8, width: int = 5, bands: int = 28, rows: int = 5, block_docs: int = 256, block_chars: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that near_duplicates keeps."""
    own = whole_rows(docs, id_col, text_col)
    first = _grouped(own.select("key", "id", "text"), least, width, bands, rows, block_docs, block_chars).where(F.col("key") == F.col("group")).select("key")
    return own.join(first, "key", "left_semi").select(*(F.col("text").alias(c) if c == text_col else F.col("rest")[c].alias(c) for c in docs.columns))


def _grouped(own: DataFrame, least: float, width: int, bands: int, rows: int, block_docs: int, block_chars: int) -> DataFrame:
    """key, class (the smallest key with the same words) and group (the smallest key reachable)."""
    sketches = freeze(own.select("key", "text").mapInArrow(_sketch(width, bands, rows), "key long, h long, g long, bands array<long>"), "sketches")
    classes = freeze(sketches.groupBy("h", "g").agg(F.min("key").alias("class")), "classes")
    firsts = freeze(sketches.join(classes.select(F.col("class").alias("key")), "key").select("key", "bands"), "firsts")
    banded = firsts.select("key", F.explode("bands").alias("band"))
    full = banded.groupBy("band").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    full = freeze(full, "buckets")
    near = banded.join(full, "band").where("key != least").select(F.col("key").alias("a"), F.col("least").alias("b"))
    coarse = components(near)
    coarse = freeze(coarse.select(F.col("node").alias("key"), F.col("root").alias("grp")).unionByName(coarse.select(F.col("root").alias("key"), F.col("root").alias("grp")).distinct()), "coarse")
    members = freeze(own.select("key", "text").join(coarse, "key"), "members")
    size = F.greatest(F.ceil(F.count(F.lit(1)) / block_docs), F.ceil(F.sum(F.char_length("text")) / block_chars)).cast("int")
    large = freeze(members.groupBy("grp").agg(size.alias("blocks")).where("blocks > 1").select("grp"), "large")
    # in a large group most documents are copies of one: what that one settles need not meet again
    weight = banded.join(full, "band").groupBy("key").agg(F.sum("n").alias("weight"))
    central = members.select("key", "grp").join(large, "grp").join(weight, "key").groupBy("grp").agg(F.max_by("key", F.struct("weight", -F.col("key"))).alias("centre"))
    centres = freeze(members.select(F.col("key").alias("centre"), F.col("text").alias("like")).join(central, "centre"), "centres")
    near = freeze(members.join(centres, "grp").select("grp", "key", "centre", "text", "like").mapInArrow(_against(width, least), "grp long, key long, centre long"), "settled")
    placed = members.join(near.select("key", F.lit(True).alias("settled")), "key", "left").withColumn("settled", F.coalesce("settled", F.lit(False)))
    parts = freeze(placed.groupBy("grp").pivot("settled", [False, True]).agg(size.alias("n")).select("grp", F.coalesce("false", F.lit(0)).alias("open"), F.coalesce("true", F.lit(0)).alias("shut")), "parts")
    placed = placed.join(parts, "grp").where("open > 0")
    slot = F.when(F.col("settled"), F.col("open") + F.pmod(F.xxhash64("key"), F.greatest("shut", F.lit(1)))).otherwise(F.pmod(F.xxhash64("key"), F.greatest("open", F.lit(1)))).cast("int")
    others = F.when(F.col("settled"), F.col("open")).otherwise(F.col("open") + F.col("shut"))
    meets = placed.withColumn("part", slot).withColumn("with", F.explode(F.sequence(F.lit(0), others - 1)))
    meets = meets.select("grp", F.least("part", "with").alias("p"), F.greatest("part", "with").alias("q"), "part", "key", "text")
    links = meets.groupBy("grp", "p", "q").applyInArrow(_verify(width, least), "a long, b long").unionByName(near.select(F.col("key").alias("a"), F.col("centre").alias("b")))
    roots = components(links)
    release(firsts, full, coarse, members, large, centres, near, parts)
    grouped = classes.join(roots.select(F.col("node").alias("class"), "root"), "class", "left").select("h", "g", "class", F.coalesce("root", "class").alias("group"))
    return sketches.select("key", "h", "g").join(freeze(grouped, "groups"), ["h", "g"]).select("key", "class", "group")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), least=0.8, width=5)
