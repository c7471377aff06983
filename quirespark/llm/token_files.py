"""Token ids in a compact file format: static range asymmetric numeral systems over independent interleaved blocks.

All blocks share one table of token frequencies, counted over the whole corpus and scaled to 2 ** BITS. A block holds
whole documents in the order of their ids. Its ids are dealt in turn to lanes, each with a state of its own, so that one
step codes or decodes an id of every lane at once. Checkpoints keep the states before later steps, from which a reader
can begin; checksums cover the coded words and the ids.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from quirespark.llm import textkit as K
from quirespark.llm.bpe import distinct
from quirespark.llm.order import before_parts
from quirespark.shared import freeze, new_path, partitions, table

BITS = 20
LANES = 2048
STEPS_TO_CHECKPOINT = 128
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)
_MARK = "\x01"  # stands between words that are encoded in one call


def scaled(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Frequencies that add up to 2 ** bits, at least 1 for each id that occurs."""
    total, goal = int(counts.sum()), 1 << bits
    if not total:
        return np.zeros(len(counts), np.int64)
    out = np.where(counts > 0, np.maximum(1, np.floor(counts * (goal / total))), 0).astype(np.int64)
    spare = goal - int(out.sum())
    order = np.argsort(-out, kind="stable")
    if spare >= 0:
        out[order[0]] += spare
        return out
    for i in order:
        cut = min(-spare, max(int(out[i]) // 2, 0) if out[i] > 1 else 0)
        out[i] -= cut
        spare += cut
        if not spare:
            return out
    return scaled(counts, bits + 1)  # more ids than the scale has room for


class Coder:
    """Codes and decodes blocks of ids with one frequency table."""

    def __init__(self, freq: np.ndarray):
        self.bits = max(int(freq.sum()).bit_length() - 1, 0)
        self.freq = freq.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64) if len(freq) else self.freq
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes, int]:
        """Coded words, the checkpoints (step, offset and lane states each; the first is the start), and the lanes."""
        lanes = max(1, min(LANES, len(ids) // 256))
        steps = -(-len(ids) // lanes)
        state, words, marks, out = np.full(lanes, _LOW), [], [], 0
        shift = np.uint64(31 - self.bits + 32)
        for s in range(steps - 1, -1, -1):
            sym = ids[s * lanes : (s + 1) * lanes]
            x, f = state[: len(sym)], self.freq[sym]
            full = x >= f << shift
            spill = x[full]
            words.append(spill.astype(np.uint32))
            out += len(spill)
            x = np.where(full, x >> _WORD, x)
            q = x // f
            state[: len(sym)] = (q << np.uint64(self.bits)) + (x - q * f) + self.cum[sym]
            if s % STEPS_TO_CHECKPOINT == 0:
                marks.append((s, out, state.copy()))
        if not steps:
            marks.append((0, 0, state))
        points = b"".join(np.array([s, out - n], np.int64).tobytes() + x.tobytes() for s, n, x in reversed(marks))
        return (np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)).astype("<u4").tobytes(), points, lanes

    def decode(self, payload: bytes, points: bytes, lanes: int, n: int, checkpoint: int = 0) -> np.ndarray:
        """The ids from a checkpoint on; a checkpoint lies before id checkpoint * STEPS_TO_CHECKPOINT * lanes."""
        each = 16 + 8 * lanes
        first, at = np.frombuffer(points, np.int64, 2, checkpoint * each)
        state = np.frombuffer(points, np.uint64, lanes, checkpoint * each + 16).copy()
        words = np.frombuffer(payload, "<u4").astype(np.uint64)
        out = np.empty(max(n - int(first) * lanes, 0), np.uint32)
        mask, bits = np.uint64((1 << self.bits) - 1), np.uint64(self.bits)
        for lo in range(0, len(out), lanes):
            x = state[: min(lanes, len(out) - lo)]
            slot = x & mask
            sym = self.symbol[slot.astype(np.int64)]
            out[lo : lo + lanes] = sym
            x = self.freq[sym] * (x >> bits) + slot - self.cum[sym]
            need = np.flatnonzero(x < _LOW)
            x[need] = x[need] << _WORD | words[at : at + len(need)]
            at += len(need)
            state[: len(x)] = x
        return out


def _byte_signs() -> dict[int, int]:
    """The sign that byte-level vocabularies write for each byte: itself where it can be seen, else one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {b: b for b in seen} | {b: 256 + k for k, b in enumerate(hidden)}


_SIGNS = _byte_signs()
_SMALL = np.zeros(256, bool)
_SMALL[97:123] = True
_ALNUM = _SMALL.copy()
_ALNUM[48:58] = True
_STOPS = np.zeros(256, bool)
_STOPS[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "|"]] = True  # not |, which special tokens hold
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class WordEncoder:
    """Encodes lists of distinct words as the tokenizer would. Words of small Latin letters, which its normaliser and
    pre-tokenizer leave as they are, go to its model alone, which is several times quicker."""

    def __init__(self, content: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_str(content)
        self.bare = Tokenizer(self.whole.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.last = np.zeros(self.whole.get_vocab_size(), bool)
        for token, i in self.whole.get_vocab().items():
            self.last[i] = token.endswith("</w>")
        self.mark = self.whole.encode(_MARK, add_special_tokens=False).ids
        steps = json.loads(content)
        split = (steps.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.plain = (
            steps["model"].get("end_of_word_suffix") == "</w>"
            and [x["type"] for x in (steps.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
            and [x["type"] for x in split] == ["Split", "ByteLevel"]
            and split[0].get("pattern", {}).get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        )

    def split(self, w: K.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes, starts and ends of the parts to encode: the words, lower-cased and cut before stops where the
        tokenizer does both anyway. Marks that join letters, and special tokens, are left alone."""
        data = w.data
        if not self.plain or len(data) < 2 or ((data == 0xCC) | (data == 0xCD)).any() or ((data[:-1] == 60) & (data[1:] == 124)).any():
            return data, w.starts, w.ends
        data = _LOWER[data]
        cut = np.flatnonzero(_ALNUM[data[:-1]] & _STOPS[data[1:]]) + 1
        cut = cut[w.docs[np.searchsorted(w.docs, cut)] != cut]  # not between two texts
        return data, np.sort(np.concatenate([w.starts, cut])), np.sort(np.concatenate([w.ends, cut]))

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts one after another, and how many each has."""
        n, lens = len(starts), ends - starts
        data = data[K.ragged_range(starts, lens)]  # the distinct parts alone
        ends = np.cumsum(lens)
        starts = ends - lens
        quick = np.zeros(n, bool)
        if self.plain and len(data):
            after, before = np.append(data[1:], 0), np.concatenate([[0], data[:-1]])
            tail = lambda x: (x >= 0x9F) & (x <= 0xBF) & (x != 0xB7)  # noqa: E731  ß to ÿ without the division sign
            good = _SMALL[data] | (data == 0xC3) & tail(after) | (before == 0xC3) & tail(data)
            bad = np.concatenate([[0], np.cumsum(~good)])
            quick = (bad[ends] == bad[starts]) & (ends > starts)
        parts = [(np.flatnonzero(quick), self._quick), (np.flatnonzero(~quick), self._slow)]
        ids, sizes = [], np.zeros(n, np.int64)
        for which, how in parts:
            got, sizes[which] = how(data, starts[which], ends[which])
            ids.append(got)
        order = np.concatenate([x for x, _ in parts])
        ptr = np.concatenate([[0], np.cumsum(sizes[order])])
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        return K.ragged_take(np.concatenate(ids), ptr, back)

    def _quick(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out, spaced = [np.zeros(0, np.uint32)], np.append(data, np.uint8(32))
        for lo in range(0, len(starts), 256):
            s, e = starts[lo : lo + 256], ends[lo : lo + 256]
            at = K.ragged_range(s, e - s + 1)
            at[np.cumsum(e - s + 1) - 1] = len(spaced) - 1
            text = spaced[at].tobytes().decode("latin-1").translate(_SIGNS | {32: 32})
            out.append(np.array(self.bare.encode(text, add_special_tokens=False).ids, np.uint32))
        ids = np.concatenate(out)
        return ids, np.diff(np.concatenate([[-1], np.flatnonzero(self.last[ids])]))

    def _slow(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lens = ends - starts
        words = K.binary_array(data[K.ragged_range(starts, lens)], np.concatenate([[0], np.cumsum(lens)])).cast(pa.string()).to_pylist()
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for lo in range(0, len(words), 256):
            part = words[lo : lo + 256]
            got = np.array(self.whole.encode(f" {_MARK} ".join([*part, ""]), add_special_tokens=False).ids, np.uint32)
            at = np.flatnonzero(got == self.mark[0]) if len(self.mark) == 1 else ()
            if len(at) != len(part):  # a word holds the mark itself
                each = [x.ids for x in self.whole.encode_batch(part, add_special_tokens=False)]
                ids.append(np.array([i for x in each for i in x], np.uint32))
                sizes.append(np.array([len(x) for x in each]))
                continue
            sizes.append(np.diff(np.concatenate([[-1], at])) - 1)
            ids.append(np.delete(got, at))
        return np.concatenate(ids), np.concatenate(sizes)


@functools.lru_cache(maxsize=2)
def _encoder(content: str) -> WordEncoder:
    return WordEncoder(content)


def _kind(id_bytes: int) -> np.dtype:
    return np.dtype({2: "<u2", 4: "<u4"}[id_bytes])


def _tokens(content: str, end_id: int | None, id_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(content)
        for batch in K.slices(batches, 1, 6 << 20):
            w = K.words(batch.column(1))  # no pre-token reaches over white space, so distinct words are enough
            data, starts, ends = encoder.split(w)
            codes, first = distinct(K.span_hashes(data, starts, ends))
            ids, sizes = encoder.encode(data, *_in_order(starts, ends, first))
            back = np.empty(len(first), np.int64)
            back[np.argsort(first, kind="stable")] = np.arange(len(first))
            codes, ptr = back[codes], np.concatenate([[0], np.cumsum(sizes)])
            doc = np.searchsorted(starts, w.docs)
            out, lo = [], 0
            while lo < len(batch):
                hi = max(lo + 1, int(np.searchsorted(doc, doc[lo] + (1 << 20), "right")) - 1)
                got, n = K.ragged_take(ids, ptr, codes[doc[lo] : doc[hi]])
                edges = np.concatenate([[0], np.cumsum(n)])[doc[lo : hi + 1] - doc[lo]]
                if end_id is not None:
                    got = np.insert(got, edges[1:], end_id)
                    edges = edges + np.arange(len(edges))
                out.append(K.binary_array(got.astype(_kind(id_bytes)).view(np.uint8), edges * id_bytes))
                lo = hi
            yield from pa.Table.from_arrays([pa.chunked_array([batch.column(0)]), pa.chunked_array(out, pa.binary())], names=["id", "ids"]).combine_chunks().to_batches()

    return run


def _in_order(starts: np.ndarray, ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    which = np.sort(which)
    return starts[which], ends[which]


def tokenize(docs: DataFrame, tokenizer: str, end_id: int | None = None, id_bytes: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and ids (little-endian, id_bytes each: 4, or 2 for vocabularies of up to 65536) of each text, by a file of
    the tokenizers library, without special tokens but end_id at the end. Its pre-tokenizer must drop white space.

    Null and empty texts have only the end id. Very long texts are encoded whole. Rows that repeat an id, or have none,
    are encoded each on its own. An empty table gives an empty result. Further columns are ignored.
    """
    content = open(tokenizer, encoding="utf-8").read()
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return own.mapInArrow(_tokens(content, end_id, id_bytes), f"id {dict(own.dtypes)['id']}, ids binary").withColumnRenamed("id", id_col)


def _counted(id_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in K.slices(batches, 0):
            data, _ = K.buffers(batch.column(0))
            here = np.bincount(np.frombuffer(data.tobytes(), _kind(id_bytes)))
            if len(here) > len(total):
                here[: len(total)] += total
                total = here
            else:
                total[: len(here)] += here
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["token", "n"])

    return run


_BLOCK = "part int, block int, first long, n long, lanes int, lens array<long>, payload binary, points binary, crc long, ids_crc long, start long"


def _blocks(freq: np.ndarray, block_tokens: int, id_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, state = Coder(freq), TaskContext.get().partitionId(), {"block": 0, "start": 0, "first": 0}

        def block(ids: list, docs: list, lens: list) -> pa.RecordBatch:
            every = np.concatenate(ids)
            payload, points, lanes = coder.encode(every)
            names = pa.concat_arrays(docs)
            row = [pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), pa.array([part], pa.int32()), pa.array([state["block"]], pa.int32()), pa.array([state["first"]]), pa.array([len(every)]), pa.array([lanes], pa.int32()),
                   pa.array([lens], pa.list_(pa.int64())), pa.array([payload], pa.binary()), pa.array([points], pa.binary()), pa.array([zlib.crc32(payload)]), pa.array([zlib.crc32(every.tobytes())]), pa.array([state["start"]])]
            state["block"] += 1
            state["start"] += len(every)
            state["first"] += len(names)
            return pa.RecordBatch.from_arrays(row, names=["ids", *(x.split()[0] for x in _BLOCK.split(", "))])

        ids, docs, lens, held = [], [], [], 0
        for batch in K.slices(batches, 1):
            data, ends = K.buffers(batch.column(1))
            ends = ends // id_bytes
            every, lo = np.frombuffer(data.tobytes(), _kind(id_bytes)).astype(np.uint32), 0
            while lo < len(batch):
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + block_tokens - held, "right")) - 1)
                ids.append(every[ends[lo] : ends[hi]])
                docs.append(batch.column(0).slice(lo, hi - lo))
                lens += np.diff(ends[lo : hi + 1]).tolist()
                held += int(ends[hi] - ends[lo])
                lo = hi
                if held >= block_tokens or lo < len(batch):
                    yield block(ids, docs, lens)
                    ids, docs, lens, held = [], [], [], 0
        if docs:
            yield block(ids, docs, lens)

    return run


def write_tokens(tokens: DataFrame, path: str, id_bytes: int = 4, block_tokens: int = 1 << 19, id_col: str = "doc_id") -> None:
    """Write the ids of each row (see tokenize) in ascending order of id_col (nulls last; equal ids by their tokens).

    path gets two tables: frequencies (token, freq) and blocks, a row each, one file for each range of ids.
    """
    spark = tokens.sparkSession
    stored = freeze(tokens.select(F.col(id_col).alias("id"), "ids"), "tokens")
    counts = stored.select("ids").mapInArrow(_counted(id_bytes), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toArrow()  # as many rows as the vocabulary
    seen = np.zeros(int(counts["token"].to_numpy().max(initial=-1)) + 1, np.int64)
    seen[counts["token"].to_numpy()] = counts["n"].to_numpy()
    freq = scaled(seen)
    spark.createDataFrame([(int(i), int(freq[i])) for i in np.flatnonzero(freq)], "token long, freq long").coalesce(1).write.parquet(f"{path}/frequencies")
    order = [F.col("id").asc_nulls_last(), F.col("ids").asc()]
    spread = stored.repartitionByRange(partitions(spark), F.col("id").asc_nulls_last()).sortWithinPartitions(*order)
    kind = dict(stored.dtypes)["id"]
    spread.select("id", "ids").mapInArrow(_blocks(freq, block_tokens, id_bytes), f"ids array<{kind}>, {_BLOCK}").write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """The rows that write_tokens wrote: id_col, start (ids of all documents before it), n_tokens and ids. Blocks are
    decoded in parallel; a wrong checksum is an error."""
    rows = spark.read.parquet(f"{path}/frequencies").toArrow()
    freq = np.zeros(int(rows["token"].to_numpy().max(initial=-1)) + 1, np.int64)
    freq[rows["token"].to_numpy()] = rows["freq"].to_numpy()
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = dict(blocks.dtypes)["ids"][len("array<") : -1]
    offsets = before_parts(blocks.withColumnRenamed("part", "_part"), F.col("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq)
        for batch in batches:
            for r in range(len(batch)):
                row = batch.slice(r, 1).to_pydict()
                payload, n = row["payload"][0], row["n"][0]
                ids = coder.decode(payload, row["points"][0], row["lanes"][0], n)
                if zlib.crc32(payload) != row["crc"][0] or zlib.crc32(ids.tobytes()) != row["ids_crc"][0]:
                    raise ValueError(f"block {row['block'][0]} of part {row['part'][0]} is damaged")
                ends = np.concatenate([[0], np.cumsum(np.array(row["lens"][0], np.int64))])
                names = batch.column(batch.schema.get_field_index("ids")).slice(r, 1).flatten()
                whole = K.binary_array(ids.astype("<u4").view(np.uint8), ends * 4)
                yield pa.RecordBatch.from_arrays([names, pa.array(np.full(len(names), row["part"][0], np.int32)), pa.array(row["start"][0] + ends[:-1]), pa.array(np.diff(ends)), whole], names=[id_col, "_part", "start", "n_tokens", "ids"])

    read = blocks.mapInArrow(run, f"{id_col} {kind}, _part int, start long, n_tokens long, ids binary")
    return read.join(F.broadcast(offsets), "_part").select(id_col, (F.col("start") + F.col("_before")).alias("start"), "n_tokens", "ids")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    write_tokens(tokenize(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, id_bytes=2), path, id_bytes=2)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
