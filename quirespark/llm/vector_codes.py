"""Codes of vectors: each part of a vector is replaced by the number of the nearest entry of its position's codebook.

Equal parts of one position are one row with a weight. Lloyd's rounds run over these distinct rows only, by whole-number
arithmetic; the codes and errors found for them are then joined back to the vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.llm.exact_topk import matrix, sound
from quirespark.llm.lookup import joined_back
from quirespark.llm.rows import keys_of
from quirespark.shared import freeze, release, table

#: Whole numbers of this size or more are refused: sums of squares would no longer be exact.
LARGEST = 1 << 25


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the nearest row of book (ties: the lower one) and its squared distance; whole numbers."""
    code, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    size = max(float(np.abs(x).max(initial=0)), float(np.abs(book).max(initial=0)), 1.0)
    kind = np.float64 if 4 * size * size * max(x.shape[1], 1) < 1 << 53 else np.int64  # doubles are exact below that
    y = book.astype(kind)
    squares = (y * y).sum(1)
    for lo in range(0, len(x), 8192):
        part = x[lo : lo + 8192].astype(kind)
        apart = squares[None, :] - 2 * (part @ y.T)
        code[lo : lo + 8192] = apart.argmin(1)
    for lo in range(0, len(x), 8192):
        gap = x[lo : lo + 8192] - book[code[lo : lo + 8192]]
        error[lo : lo + 8192] = (gap * gap).sum(1)
    return code, error


def _rows(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    x = matrix(batch.column(batch.schema.get_field_index("part")), np.int64)
    return batch.column(batch.schema.get_field_index("p")).to_numpy(), x[:, :width] if x.shape[1] >= width else np.zeros((len(x), width), np.int64)


def _sums(books: np.ndarray) -> Callable:
    """Per task: how many parts each entry has, and the sums of their components."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            p, x = _rows(batch, width)
            n = batch.column(batch.schema.get_field_index("n")).to_numpy()
            for at in np.unique(p):
                mine = p == at
                code, _ = nearest(x[mine], books[at])
                np.add.at(count[at], code, n[mine])
                np.add.at(total[at], code, x[mine] * n[mine][:, None])
        at, code = np.nonzero(count)
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * width, pa.int32()), pa.array(total[at, code].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(code.astype(np.int32)), pa.array(count[at, code]), sums], names=["p", "c", "n", "sums"])

    return run


def _assigned(books: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, x = _rows(batch, books.shape[2])
            code, error = np.zeros(len(p), np.int32), np.zeros(len(p), np.int64)
            for at in np.unique(p):
                mine = p == at
                code[mine], error[mine] = nearest(x[mine], books[at])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(code), pa.array(error)], names=["p", "part", "n", "c", "err"])

    return run


def lloyd(cells: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """books after some rounds over the distinct parts (p, part, n). Each round brings one number for each component of
    each entry to the driver, whatever the number of vectors; an entry that nothing is assigned to stays as it is."""
    books = books.copy()
    for _ in range(rounds):
        sums = cells.mapInArrow(_sums(books), "p int, c int, n long, sums array<long>").select("p", "c", "n", F.posexplode("sums").alias("j", "s"))
        new = sums.groupBy("p", "c", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).toArrow()
        p, c, j, n, s = (new[k].to_numpy() for k in ("p", "c", "j", "n", "s"))
        books[p, c, j] = s // n  # rounds down
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """id_col, code, error and label_error of each vector, and the codebooks (part, entry, component).

    Components become floor(scale * x). The codebooks begin as the parts of the vectors with the smallest ids (as many as
    there are entries, or vectors if fewer). code names the nearest entries by two hexadecimal digits a part (more where
    entries needs more), error is the squared distance to them, label_error the sum of errors over rows of the same label.

    Vectors that are null or hold null or non-finite components are left out. Vectors that are shorter than the longest,
    also empty ones, and lengths that the parts do not divide, count as ending in zeros. Repeated and missing ids are
    further vectors; missing ids come last, equal ones by the hash of their vectors. Null labels count as one label. Of
    entries equally near the one of the smaller number is taken. An empty table gives no rows and empty codebooks. A
    component whose whole number reaches 2 ** 25 is an error. Further columns are ignored, whatever their names.
    """
    whole = F.coalesce(F.size(F.col(vector_col)) == 0, F.lit(False)) | sound(F.col(vector_col))
    chosen = vectors.where(F.col(vector_col).isNotNull() & whole)
    own = keys_of(chosen, id_col, vector_col, [label_col])[0]
    about = own.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("text")).alias("d")).first()
    number = F.lit(float(scale))
    checked = F.transform("text", lambda x: F.when(F.abs(x.cast("double") * number) < LARGEST, F.floor(x.cast("double") * number).cast("int")).otherwise(F.raise_error("a component is too large to be coded").cast("int")))
    width = -(-(about.d or 0) // parts)
    padded = F.concat(checked, F.array_repeat(F.lit(0), F.lit(width * parts) - F.size("text")))
    own = own.select("key", "id", F.struct(F.col(f"rest.{label_col}").alias("v")).alias("label"), padded.alias("v"))
    pieces = F.array(*(F.struct(F.lit(p).alias("p"), F.slice("v", p * width + 1, width).alias("part")) for p in range(parts)))
    split = own.select("key", "id", "label", F.inline(pieces))
    cells = freeze(split.groupBy("p", "part").agg(F.count(F.lit(1)).alias("n")), "distinct-parts")
    first = own.orderBy("key").limit(entries).select("v").toArrow()["v"]  # as many rows as a codebook has entries
    start = matrix(first, np.int64)[:, : parts * width].reshape(len(first), parts, width) if len(first) and width else np.zeros((len(first), parts, width), np.int64)
    books = lloyd(cells, np.ascontiguousarray(start.transpose(1, 0, 2)), rounds)

    found = freeze(cells.mapInArrow(_assigned(books), "p int, part array<int>, n long, c int, err long"), "coded-parts") if about.n else cells.select("*", F.lit(0).alias("c"), F.lit(0).cast("long").alias("err"))
    digits = max(2, len(f"{max(entries - 1, 0):x}"))
    back = joined_back(split, found, ["p", "part"], "n", about.n * parts).groupBy("key").agg(F.first("id").alias("id"), F.first("label").alias("label"), F.array_sort(F.collect_list(F.struct("p", "c"))).alias("cs"), F.sum("err").alias("error"))
    code = F.array_join(F.transform("cs", lambda x: F.lower(F.lpad(F.hex(x.c.cast("long")), digits, "0"))), "")
    coded = freeze(back.select("id", "label", code.alias("code"), "error"), "coded")
    release(cells)
    labels = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    return joined_back(coded, labels, ["label"], "n", about.n).select(F.col("id").alias(id_col), "code", "error", "label_error"), books


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = compress(table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, scale=1024)
    return rows.withColumn("codebooks_sha256", F.lit(digest(books)))


def _oracle(rounds: int = 4) -> str:
    """The rounds written out, one after another."""
    best = "SELECT vec_id, p, x, min(struct_pack(d := (xx - 2 * list_inner_product(x, y) + yy)::BIGINT, c := c)) AS m FROM pieces JOIN b{0} USING (p) GROUP BY ALL"
    steps = [
        """WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pieces AS MATERIALIZED (SELECT vec_id, p, e[p * len(e) // 4 + 1 : (p + 1) * len(e) // 4] AS x, list_inner_product(x, x) AS xx FROM v, range(4) AS t(p)),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS c, x AS y, xx AS yy FROM pieces QUALIFY c < 256)"""
    ]
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({best.format(r)})")
        steps.append(f"s{r} AS (SELECT p, m.c AS c, j, floor(sum(x[j]) / count(*)) AS y FROM a{r}, range(1, 17) AS t(j) GROUP BY ALL)")
        steps.append(f"n{r} AS (SELECT p, c, list(y ORDER BY j) AS z FROM s{r} GROUP BY ALL)")
        steps.append(f"b{r + 1} AS MATERIALIZED (SELECT p, c, coalesce(z, y) AS y, list_inner_product(y, y) AS yy FROM (SELECT p, c, z, b.y AS o FROM b{r} AS b LEFT JOIN n{r} USING (p, c)) AS u, LATERAL (SELECT coalesce(u.z, u.o) AS y) AS w)")
    steps.append(f"""a AS MATERIALIZED ({best.format(rounds)}),
e AS (SELECT vec_id, string_agg(lpad(lower(to_hex(m.c)), 2, '0'), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a GROUP BY vec_id),
h AS (SELECT sha256(string_agg(s, ',' ORDER BY p, c)) AS codebooks_sha256 FROM (SELECT p, c, array_to_string(list_transform(y, lambda t: t::BIGINT), ',') AS s FROM b{rounds}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM e JOIN v USING (vec_id), h""")
    return ",\n".join(steps)


ORACLE = _oracle()
