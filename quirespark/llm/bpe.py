"""Byte-level BPE through a global shuffle of distinct words.

A word here is what lies between two separators together with the separators before it: no pre-token of the pattern
reaches over its ends, so a text's ids are those of its words in turn. A chunk is a slice of an Arrow batch. One pass
sends the distinct words of each chunk to buckets by hash; the tasks that hold a bucket read its rows as a stream and
encode each distinct word once. The other pass keeps, for each chunk, the words of its texts by position. Joined by
chunk, the ids are put together again. No task holds more than one chunk, or more of a bucket than an Arrow batch.
"""

from __future__ import annotations

import base64
import functools
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirespark.llm import textkit as K
from quirespark.shared import partitions, table


@functools.lru_cache(maxsize=4)
def ranks_of(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in content.splitlines() if line)}


@functools.lru_cache(maxsize=4)
def _encoding(content: bytes, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks_of(content), special_tokens={})


@functools.lru_cache(maxsize=4)
def token_bytes(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all tokens one after another, and where each begins: as large as the vocabulary."""
    ranks = ranks_of(content)
    ptr = np.zeros(max(ranks.values()) + 2, np.int64)
    for word, rank in ranks.items():
        ptr[rank + 1] = len(word)
    return np.frombuffer(b"".join(sorted(ranks, key=ranks.get)), np.uint8), np.cumsum(ptr)


def _odd_space_ends(data: np.ndarray) -> np.ndarray:
    """Where white space other than space and \\x09-\\x0D ends; the pattern joins it to runs of those."""
    lead = np.zeros(256, bool)
    lead[[*range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3]] = True
    at = np.flatnonzero(lead[data])
    padded = np.concatenate([data, np.zeros(2, np.uint8)])
    a, b, c = padded[at], padded[at + 1], padded[at + 2]
    wide = (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F)
    odd = (a < 0x20) | (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE2) & wide | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    return at[odd] + np.where(a[odd] < 0x20, 1, np.where(a[odd] == 0xC2, 2, 3))


def split_units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of texts, starts and ends of their words, and how many each has. White space that is no separator may
    stand inside a word; one that ends in it goes on to the end of the next, since the pattern may join the two."""
    w = K.words(texts)
    starts, ends, ptr = w.units()
    counts = np.diff(ptr)
    odd = _odd_space_ends(w.data)
    if len(odd) and len(ends):
        at = np.minimum(np.searchsorted(odd, ends), len(odd) - 1)
        goes_on = odd[at] == ends
        goes_on[ptr[1:][counts > 0] - 1] = False
        owner = np.repeat(np.arange(len(counts)), counts)[~goes_on]
        starts, ends = starts[np.concatenate([[True], ~goes_on[:-1]])], ends[~goes_on]
        counts = np.bincount(owner, minlength=len(counts))
    return w.data, starts, ends, counts


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each hash its rank by frequency, and for each rank the first place."""
    codes, _ = pd.factorize(hashes)
    first = np.flatnonzero(np.concatenate([[True], codes[1:] > np.maximum.accumulate(codes)[:-1]])) if len(codes) else codes
    often = np.argsort(-np.bincount(codes, minlength=len(first)), kind="stable")
    rank = np.empty(len(first), np.int64)
    rank[often] = np.arange(len(first))
    return rank[codes], first[often]


def _chunks(batches: Iterator[pa.RecordBatch], buckets: int):
    part = TaskContext.get().partitionId()
    for k, batch in enumerate(K.slices(batches, 1, 4 << 20)):
        data, starts, ends, counts = split_units(batch.column(1))
        h = K.span_hashes(data, starts, ends)
        codes, first = distinct(h)
        home = (h[first] % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
        yield part << 32 | k, batch, data, starts, ends, counts, codes, first, home, zlib.crc32(h[first])


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers or bytes, by byte planes, which zstandard makes small."""
    packer = zstandard.ZstdCompressor(level=1)
    out = []
    for x in arrays:
        planes = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T) if len(x) else np.zeros(0, np.uint8)
        packed = packer.compress(planes)
        out += [np.array([len(packed), len(x)], np.int64).tobytes(), packed]
    return b"".join(out)


def unsqueeze(raw: bytes, *kinds: type) -> list[np.ndarray]:
    opener, out, at = zstandard.ZstdDecompressor(), [], 0
    for kind in kinds:
        size, n = np.frombuffer(raw, np.int64, 2, at)
        planes = np.frombuffer(opener.decompress(raw[at + 16 : at + 16 + size]), np.uint8)
        out.append(np.ascontiguousarray(planes.reshape(-1, n).T).reshape(-1).view(kind) if n else np.zeros(0, kind))
        at += 16 + size
    return out


def _words_to_buckets(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _, data, starts, ends, _, _, first, home, mark in _chunks(batches, buckets):
            order = np.argsort(home, kind="stable")
            edges = np.searchsorted(home[order], np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(edges))
            payload = []
            for b in some:
                own = first[order[edges[b] : edges[b + 1]]]
                lens = ends[own] - starts[own]
                payload.append(squeeze(lens.astype(np.uint32), data[K.ragged_range(starts[own], lens)]))
            n = len(some)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(n, chunk, np.int64)), pa.array(np.full(n, mark, np.int64)), pa.array(payload, pa.binary())], names=["bucket", "chunk", "mark", "payload"])

    return run


def _encode_words(content: bytes, pattern: str, remembered: int):
    """Ids of the words of each row. A task sees all rows of its buckets, so a distinct word is encoded once, unless more
    than `remembered` others came since the memory was last emptied."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(content, pattern).encode_ordinary
        known: dict[bytes, bytes] = {}
        for batch in K.slices(batches, "payload", 4 << 20):
            payload = []
            for raw in batch["payload"]:
                lens, data = unsqueeze(raw.as_py(), np.uint32, np.uint8)
                text, ids, at = data.tobytes(), [], 0
                for end in np.cumsum(lens, dtype=np.int64).tolist():
                    word = text[at:end]
                    at = end
                    found = known.get(word)
                    if found is None:
                        found = array("I", encode(word.decode("utf-8"))).tobytes()
                        if len(known) >= remembered:
                            known.clear()
                        known[word] = found
                    ids.append(found)
                payload.append(squeeze(np.fromiter(map(len, ids), np.uint32, len(ids)) // 4, np.frombuffer(b"".join(ids), np.uint32)))
            yield pa.RecordBatch.from_arrays([batch["chunk"], batch["bucket"], batch["mark"], pa.array(payload, pa.binary())], names=["chunk", "bucket", "mark", "payload"])

    return run


def _positions(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, batch, _, _, _, counts, codes, _, home, mark in _chunks(batches, buckets):
            ids = pa.ListArray.from_arrays(pa.array([0, len(batch)], pa.int32()), batch.column(0))
            packed = squeeze(counts.astype(np.uint32), codes.astype(np.uint32), home)
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([mark], pa.int64()), ids, pa.array([packed], pa.binary())], names=["chunk", "mark", "ids", "payload"])

    return run


def _reassemble(buckets: int):
    def run(key: tuple, texts: pa.Table, words: pa.Table) -> pa.Table:
        out_ids, out = [], []
        for r in range(len(texts)):
            counts, codes, home = unsqueeze(texts["payload"][r].as_py(), np.uint32, np.uint32, np.uint16 if buckets <= 1 << 16 else np.uint32)
            order = np.argsort(words["bucket"].to_numpy())
            lens, ids = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
            for k in order:
                if words["mark"][k].as_py() != texts["mark"][r].as_py():
                    raise ValueError("a chunk differs between two readings; freeze the input, or sort it within its partitions")
                a, b = unsqueeze(words["payload"][k].as_py(), np.uint32, np.uint32)
                lens.append(a)
                ids.append(b)
            ids, ptr = np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(lens), dtype=np.int64)])
            place = np.empty(len(home), np.int64)
            place[np.argsort(home, kind="stable")] = np.arange(len(home))
            doc = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
            lo = 0
            while lo < len(counts):  # whole texts, about a million words at a time
                hi = max(lo + 1, int(np.searchsorted(doc, doc[lo] + (1 << 20), "right")) - 1)
                got, sizes = K.ragged_take(ids, ptr, place[codes[doc[lo] : doc[hi]]])
                ends = np.concatenate([[0], np.cumsum(sizes)])[doc[lo : hi + 1] - doc[lo]]
                out.append(K.binary_array(got.astype("<u4").view(np.uint8), ends * 4))
                lo = hi
            out_ids.append(texts["ids"][r].values)
        return pa.table({"id": pa.chunked_array(out_ids), "ids": pa.chunked_array(out, pa.binary())})

    return run


def encode(docs: DataFrame, vocabulary: str, pattern: str = public_tokenizers.PATTERN, remembered: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of each text as tiktoken's encode_ordinary gives them. Returns the id and ids (little-endian uint32).

    vocabulary is the path of a rank file, read on the driver; its content goes to the tasks and is bounded. remembered
    bounds the distinct words that a task keeps with their ids.

    Null and empty texts have no ids. Rows that repeat an id, or have none, are encoded each on its own. Very long
    texts are encoded whole. An empty table gives an empty result. Further columns are ignored. The input is read
    twice and must give the same rows in the same order both times, as files do; the tasks compare what they saw.
    """
    content = open(vocabulary, "rb").read()
    buckets = partitions(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = dict(own.dtypes)["id"]
    words = own.mapInArrow(_words_to_buckets(buckets), "bucket int, chunk long, mark long, payload binary")
    encoded = words.repartitionById(buckets, F.col("bucket")).mapInArrow(_encode_words(content, pattern, remembered), "chunk long, bucket int, mark long, payload binary")
    texts = own.mapInArrow(_positions(buckets), f"chunk long, mark long, ids array<{kind}>, payload binary")
    joined = texts.groupBy("chunk").cogroup(encoded.groupBy("chunk")).applyInArrow(_reassemble(buckets), f"id {kind}, ids binary")
    return joined.withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, vocabulary: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """Add a column with the bytes of each row's ids, looked up in the table of token bytes. A null stays null."""
    content = open(vocabulary, "rb").read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_, at = token_bytes(content)
        for batch in K.slices(batches, ids_col, 4 << 20):
            raw = batch.column(batch.schema.get_field_index(ids_col))
            data, ends = K.buffers(raw)
            got, sizes = K.ragged_take(table_, at, np.frombuffer(data.tobytes(), "<u4"))
            decoded = K.binary_array(got, np.concatenate([[0], np.cumsum(sizes)])[ends // 4])
            if raw.null_count:
                decoded = pa.compute.if_else(raw.is_valid(), decoded, pa.scalar(None, pa.binary()))
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded], names=[*batch.schema.names, into])

    return tokens.mapInArrow(run, T.StructType([*tokens.schema.fields, T.StructField(into, T.BinaryType())]))


def digests(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return tokens.select(id_col, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return digests(decode(encode(table(spark, sf_dir, "documents"), vocabulary), vocabulary))
