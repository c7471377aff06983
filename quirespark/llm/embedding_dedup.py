"""Near-duplicate vectors by dual traversal of cover trees: exact threshold pairs by cosine.

On the unit sphere a cosine of at least c is a chord of at most sqrt(2 - 2c). Vectors are dealt to the nearest of a
bounded sample of pivots, and each cell is cut into blocks. A block holds a cover tree: nested levels of centres whose
radii halve, each centre with the largest distance to what lies below it. Pairs of blocks, and then pairs of nodes level
by level, are dropped when their distance exceeds the chord and both radii; what is left at the leaves is measured in
double precision. Links are counted and joined to components inside the pair's task, so pairs never leave it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.llm import textkit as K
from quirespark.llm.components import components
from quirespark.llm.exact_topk import matrix, sound
from quirespark.llm.rows import keys_of
from quirespark.shared import freeze, table

_SLACK = 1e-5  # for distances in single precision; leaves are measured in double
_DEEPEST = 2.0**-4


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def chords(dots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * dots, 0))


def cover_tree(u: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels from the top: centres (rows of u), radii, and for each centre of the next level its parent here.

    Centres of a level are farther apart than its radius 1, 1/2, ...; each is a centre of all deeper levels too. The
    last level has all rows.
    """
    dots = u.astype(np.float32) @ u.astype(np.float32).T
    n, radius = len(u), 1.0
    nets, order = [], np.arange(n)
    while radius >= _DEEPEST:
        near = 1 - radius**2 / 2
        covered, centres = np.zeros(n, bool), []
        for i in order:
            if not covered[i]:
                centres.append(i)
                covered |= dots[i] >= near
        nets.append(np.array(centres))
        if len(centres) == n:
            break
        chosen = np.zeros(n, bool)
        chosen[centres] = True
        order = np.concatenate([centres, np.flatnonzero(~chosen)])
        radius /= 2
    if len(nets[-1]) < n:
        nets.append(np.arange(n))
    levels = []
    for depth, net in enumerate(nets):
        parent = np.argmax(dots[np.ix_(nets[depth + 1], net)], axis=1) if depth + 1 < len(nets) else None
        levels.append([net, np.zeros(len(net)), parent])
    for net, radii, _ in levels[:-1]:  # of all rows, by the chain of parents
        depth = next(i for i, x in enumerate(levels) if x[0] is net)
        to = np.arange(len(levels[-1][0]))
        for d in range(len(levels) - 2, depth - 1, -1):
            to = levels[d][2][to]
        far = chords(np.minimum(dots[levels[-1][0], net[to]], 1)) + _SLACK * 100
        far[levels[-1][0] == net[to]] = 0
        np.maximum.at(radii, to, far)
    return [tuple(x) for x in levels]


def _children(level: tuple) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(level[2], kind="stable")
    return order, np.searchsorted(level[2][order], np.arange(len(level[0]) + 1))


def linked_pairs(u: np.ndarray, tree: list, w: np.ndarray, other: list, least: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of u, row of w) whose cosine is at least `least`; with same, each pair of one block once."""
    reach = float(np.sqrt(2 - 2 * least)) + _SLACK * 100
    a32, b32 = u.astype(np.float32), w.astype(np.float32)

    def near(level: tuple, against: tuple, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        dots = np.einsum("ij,ij->i", a32[level[0][i]], b32[against[0][j]])
        return chords(dots) <= reach + level[1][i] + against[1][j]

    depth = max(len(tree), len(other))
    tree, other = (t + [(t[-1][0], t[-1][1], None)] * (depth - len(t)) for t in (tree, other))
    top, against = tree[0], other[0]
    for lo in range(0, len(top[0]), 512):
        rows = np.arange(lo, min(lo + 512, len(top[0])))
        bound = reach + top[1][rows, None] + against[1][None, :]
        i, j = np.nonzero(a32[top[0][rows]] @ b32[against[0]].T >= 1 - np.minimum(bound, 2) ** 2 / 2)
        i = rows[i]
        if same:
            i, j = i[i <= j], j[i <= j]
        stack = [(0, i, j)]
        while stack:
            d, i, j = stack.pop()
            if d == depth - 1:
                x, y = tree[d][0][i], other[d][0][j]
                if same:
                    x, y = x[x != y], y[x != y]
                for c in range(0, len(x), 1 << 16):
                    s, t = x[c : c + (1 << 16)], y[c : c + (1 << 16)]
                    good = np.einsum("ij,ij->i", u[s], w[t]) >= least
                    yield s[good], t[good]
                continue
            for c in range(0, len(i), 1 << 13):
                p, q = i[c : c + (1 << 13)], j[c : c + (1 << 13)]
                (ca, pa_), (cb, pb) = (_children(t[d]) if t[d][2] is not None else (np.arange(len(t[d][0])), np.arange(len(t[d][0]) + 1)) for t in (tree, other))
                na, nb = np.diff(pa_)[p], np.diff(pb)[q]
                pair = np.repeat(np.arange(len(p)), na * nb)
                inner = K.ragged_range(np.zeros(len(p), np.int64), na * nb)
                x, y = ca[pa_[p[pair]] + inner // nb[pair]], cb[pb[q[pair]] + inner % nb[pair]]
                if same:
                    twin = (p == q)[pair] & (x > y)  # within one node each pair of children once
                    x, y = x[~twin], y[~twin]
                ok = near(tree[d + 1], other[d + 1], x, y)
                stack.append((d + 1, x[ok], y[ok]))


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row of each row's component, for edges a-b among n rows."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(root[root], root):
            root = root[root]
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def _pack(key: tuple, rows: pa.Table, pivots: np.ndarray) -> pa.Table:
    v = matrix(rows["v"])
    u = unit(v)
    tree = cover_tree(u)
    far = float(chords(np.minimum(u @ pivots[rows["cell"][0].as_py()], 1)).max())
    flat = [np.concatenate([[len(tree)], *[np.array([len(net), 0 if parent is None else len(parent)]) for net, _, parent in tree], *[x for net, _, parent in tree for x in (net, *([] if parent is None else [parent]))]])]
    return pa.table({
        "block": pa.array([key[0].as_py()], pa.int32()), "cell": pa.array([rows["cell"][0].as_py()], pa.int32()), "far": [far], "dim": pa.array([v.shape[1]], pa.int32()),
        "keys": [rows["key"].to_numpy().tobytes()], "copies": [rows["n"].to_numpy().tobytes()], "v": [v.tobytes()],
        "nets": [flat[0].astype(np.int64).tobytes()], "radii": [np.concatenate([r for _, r, _ in tree]).tobytes()],
    })


_PACKED = "block int, cell int, far double, dim int, keys binary, copies binary, v binary, nets binary, radii binary"


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    keys, copies = (np.frombuffer(row[c], np.int64) for c in ("keys", "copies"))
    u = unit(np.frombuffer(row["v"], np.float64).reshape(len(keys), row["dim"]))
    nets, radii, tree = np.frombuffer(row["nets"], np.int64), np.frombuffer(row["radii"], np.float64), []
    at, r = 1 + 2 * nets[0], 0
    for k in range(nets[0]):
        size, parents = nets[1 + 2 * k], nets[2 + 2 * k]
        tree.append((nets[at : at + size], radii[r : r + size], nets[at + size : at + size + parents] if parents else None))
        at, r = at + size + parents, r + size
    return keys, copies, u, tree


_PARTS = ["block", "dim", "keys", "copies", "v", "nets", "radii"]


def _links_of_blocks(least: float):
    """Links within pairs of blocks: rows have the columns of a block, and those of its partner after them. A block whose
    turn comes again right after is unpacked once."""

    def links(keys: np.ndarray, copies: np.ndarray, u: np.ndarray, tree: list, partner: tuple | None) -> pa.RecordBatch | None:
        same = partner is None
        keys2, copies2, w, other = (keys, copies, u, tree) if same else partner
        n_links, base = np.zeros(len(keys) + (0 if same else len(keys2)), np.int64), 0 if same else len(keys)
        a, b = [], []
        for i, j in linked_pairs(u, tree, w, other, least, same):
            np.add.at(n_links, i, copies2[j])
            np.add.at(n_links, base + j, copies[i])
            root = local_roots(len(n_links), i, base + j)  # of these pairs a spanning forest is enough
            moved = np.flatnonzero(root != np.arange(len(root)))
            a.append(moved)
            b.append(root[moved])
        if not a:
            return None
        every = keys if same else np.concatenate([keys, keys2])
        root = local_roots(len(n_links), np.concatenate(a), np.concatenate(b))
        low = np.full(len(every), np.iinfo(np.int64).max)
        np.minimum.at(low, root, every)
        some = n_links > 0
        return pa.RecordBatch.from_arrays([pa.array(every[some]), pa.array(n_links[some]), pa.array(low[root][some])], names=["key", "n", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for batch in batches:
            for k in range(len(batch)):
                row = [c[k].as_py() for c in batch.columns]
                one, two = (dict(zip(_PARTS, row[i : i + len(_PARTS)], strict=True)) for i in (0, len(_PARTS)))
                if one["block"] != last:
                    last, left = one["block"], _unpack(one)
                found = links(*left, None if two["block"] == last else _unpack(two))
                if found is not None:
                    yield found

    return run


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Within it an Arrow batch ends at 8 MB: a pair of blocks of usual size is one."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 8 << 20)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def near_duplicate_vectors(vectors: DataFrame, least: float = 0.9, block_rows: int = 4096, max_pivots: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Link vectors whose cosine is at least `least`. Returns one row per input row: the id, n_links (others linked
    directly), component_id (the smallest id reachable by links) and kept (whether that is the row's own id).

    Exact copies are one vector in the comparison and count as links of each other. The pivots (one for every
    2 * block_rows vectors, at most max_pivots) are a sample by hash, which affects speed only.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, neither do vectors
    of unequal length. Rows that repeat an id, or have none, are further vectors (without an id after all others);
    their components are named by the smallest row's id. An empty table gives an empty result. Further columns are
    ignored.
    """
    own, clean = keys_of(vectors, id_col, vector_col)
    size = F.transform("text", lambda x: x.cast("double"))
    good = sound(F.col("text")) & F.coalesce(F.exists("text", lambda x: x != 0), F.lit(False))
    own = own.select("key", "id", F.when(good, size).alias("v"))
    classes = freeze(own.where("v IS NOT NULL").groupBy("v").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("n")), "vectors")
    count = classes.count()
    cells = min(max_pivots, max(1, count // (2 * block_rows)))
    chosen = classes.orderBy(F.xxhash64("v"), "key").limit(cells).select("v").toArrow()["v"]
    spark = vectors.sparkSession
    kinds = {"n_links": "long", "component": "long"}
    if not count:
        found = spark.createDataFrame([], "key long, n long, root long")
    else:
        pivots = unit(matrix(chosen))

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                u = unit(matrix(batch.column(0))) if len(batch) else np.zeros((0, pivots.shape[1]))
                width = min(u.shape[1], pivots.shape[1])
                cell = np.argmax(u[:, :width] @ pivots[:, :width].T, axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names=["v", "key", "n", "cell"])

        dealt = classes.select("v", "key", "n").mapInArrow(nearest, "v array<double>, key long, n long, cell int").withColumn("dim", F.size("v"))
        dealt = freeze(dealt, "cells")
        first, blocks = {}, 0
        for r in sorted(dealt.groupBy("cell", "dim").count().collect()):
            first[(r.cell, r.dim)] = (blocks, -(-r["count"] // block_rows))
            blocks += first[(r.cell, r.dim)][1]
        where = spark.createDataFrame([(c, d, f, k) for (c, d), (f, k) in first.items()], "cell int, dim int, first int, parts int")
        block = (F.col("first") + F.pmod(F.xxhash64("key"), F.col("parts"))).cast("int")
        packed = dealt.join(F.broadcast(where), ["cell", "dim"]).select("v", "key", "n", "cell", block.alias("block"))
        wide = pivots.shape[1]

        def pack(key: tuple, rows: pa.Table) -> pa.Table:
            dim = len(rows["v"][0])
            p = np.zeros((len(pivots), dim))
            p[:, : min(dim, wide)] = pivots[:, : min(dim, wide)]
            return _pack(key, rows, p)

        # files of at most 16 blocks, one of which a task holds while it reads another; enough of them to keep all cores busy
        files = max(-(-blocks // 16), min(blocks, 1 + int((4 * spark.sparkContext.defaultParallelism) ** 0.5)))
        packed = freeze(packed.repartitionByRange(files, "block").groupBy("block").applyInArrow(pack, _PACKED), "blocks")
        reach = float(np.sqrt(2 - 2 * least)) + _SLACK * 100
        # chords from each pivot to all; a pivot of other length than its vectors bounds nothing
        apart = chords(np.minimum(pivots @ pivots.T, 1))
        far_off = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(apart)], "cell int, apart array<double>")
        one = packed.join(F.broadcast(far_off), "cell").select(*_PARTS, "far", "apart")
        two = packed.select(*(F.col(c).alias(f"{c}2") for c in (*_PARTS, "cell", "far")))
        near = (F.col("dim") != wide) | (F.get("apart", F.col("cell2")) <= reach + F.col("far") + F.col("far2"))
        # blocks are read for each other where they lie: nothing is shuffled, so the pairs take no disk
        sides = one.join(two, (F.col("block") <= F.col("block2")) & (F.col("dim") - F.col("dim2") == 0) & near)
        sides = sides.select(*_PARTS, *(f"{c}2" for c in _PARTS))
        with _small_batches(spark):
            found = freeze(sides.mapInArrow(_links_of_blocks(least), "key long, n long, root long"), "links")
    roots = components(found.where("key != root").select(F.col("key").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("key").agg(F.sum("n").alias("links"))
    settled = classes.join(links, "key", "left").join(roots.withColumnRenamed("node", "key"), "key", "left")
    settled = freeze(settled.select(F.col("v").alias("v2"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast(kinds["n_links"]).alias("n_links"), F.coalesce("root", "key").alias("component")), "settled")
    out = own.join(settled, own.v == settled.v2, "left").select("key", "id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "key").alias("component"))
    if clean:
        named = out.withColumn("component_id", F.col("component").cast(dict(own.dtypes)["id"]))
    else:
        out = freeze(out, "linked")
        named = out.join(out.select(F.col("key").alias("component"), F.col("id").alias("component_id")), "component")
    return named.select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("key") == F.col("component")).alias("kept"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"), least=0.9)


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings AS e JOIN c ON c.node = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
