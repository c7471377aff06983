"""Language identification by compression.

Each language has a dictionary: raw text of its own, set before what is to be compressed. A text is cut into pieces, so
that the dictionary serves the whole of it, and every piece is compressed with every dictionary; the language whose
dictionary gives the fewest bytes in all is chosen. Where the next is almost as small, the choice is marked rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirespark.llm.toxicity import fold
from quirespark.shared import table

FOLDS, HELD = 4, 2
NONE = "und"
_LETTER = regex.compile(r"\p{L}")
_PLAIN = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def plain(text: str) -> bytes:
    """Lower-cased; ASCII other than letters become spaces, which say little about a language."""
    return text.lower().encode("utf-8").translate(_PLAIN)


def _cut(data: bytes, at: int, most: int) -> bytes:
    """At most so many bytes, from a place that the number at chooses."""
    start = at % (max(len(data) - most, 0) + 1)
    return data[start : start + most]


def learn(docs: DataFrame, dictionary_bytes: int = 110 << 10, max_docs: int = 400, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """A dictionary for each language: parts of about max_docs texts of documents outside fold 2, chosen by hash.

    Where in a text its part lies is chosen by the text's hash, so all of it can be learnt from, and copies give one part.
    For each language about four times dictionary_bytes come to the driver and at most dictionary_bytes are kept.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & (fold(F.col(id_col), FOLDS) != HELD))
    known = known.select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col), F.col(text_col).alias("text"), F.pmod(F.xxhash64(id_col), F.lit(1 << 30)).alias("u"))
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return {}
    share = docs.sparkSession.createDataFrame([(lang, int(min(1.0, 2 * max_docs / n) * (1 << 30)), max(256, 2 * dictionary_bytes // min(n, max_docs))) for lang, n in counts.items()], "lang string, most long, chars int")
    sample = known.join(F.broadcast(share), "lang").where("u < most").select("lang", "u", id_col, "text", "chars", *(F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1 << 30)).alias(v) for seed, v in ((1, "v"), (2, "w"))))
    start = F.pmod("v", F.greatest(F.char_length("text") - F.col("chars"), F.lit(0)) + 1) + 1
    sample = sample.select("lang", "u", id_col, F.substring("text", start.cast("int"), F.col("chars").cast("int")).alias("text"), "w")
    texts: dict[str, list] = {lang: [] for lang in counts}
    rows = sample.toArrow().to_pylist()
    for r in sorted(rows, key=lambda r: (r["u"], r[id_col])):
        texts[r["lang"]].append((plain(r["text"]), r["w"]))
    out = {}
    for lang, parts in sorted(texts.items()):
        each = max(256, dictionary_bytes // max(min(len(parts), max_docs), 1))
        seen: dict[bytes, tuple] = {}
        for part in parts:
            seen.setdefault(_cut(*part, each), part)  # repeats teach nothing
        kept = list(seen.values())[:max_docs]
        each = max(256, dictionary_bytes // max(len(kept), 1))
        out[lang] = b" ".join(dict.fromkeys(_cut(*part, each) for part in kept))[:dictionary_bytes]
    return out


def _classify(dictionaries: dict[str, bytes], piece: int, level: int, least_margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = sorted(dictionaries)
        packers = []
        for name in names:
            own = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(level=level)
            packers.append(zstandard.ZstdCompressor(level=level, dict_data=own, write_content_size=False).compress)
        for batch in batches:
            lang, score, margin = [], [], []
            for text in batch.column(1).to_pylist():
                if not names or not text or not _LETTER.search(text):
                    lang.append(NONE)
                    score.append(0.0)
                    margin.append(0.0)
                    continue
                data = plain(text)
                sizes = [sum(len(pack(data[lo : lo + piece])) for lo in range(0, len(data), piece)) for pack in packers]
                order = np.argsort(sizes, kind="stable")
                best = sizes[order[0]]
                gap = (sizes[order[1]] - best) / sizes[order[1]] if len(names) > 1 else 1.0
                lang.append(names[order[0]])
                score.append(gap)
                margin.append(gap)
            rejected = pa.array([x == NONE or m < least_margin for x, m in zip(lang, margin, strict=True)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(np.array(score, np.float64)), rejected], names=[*batch.schema.names, "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, dictionaries: dict[str, bytes], piece: int = 1024, level: int = 6, least_margin: float = 0.01, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns one row per input row: the id, lang_pred, score and rejected.

    lang_pred is the language whose dictionary compresses the whole text best (ties: the first by name), `und` for
    null, empty and other texts without a letter, or without any dictionary. score is by how much smaller it is than
    the next, as a share (1 with a single language, 0 with `und`); below least_margin the choice is rejected. Rows
    that repeat an id, or have none, are each judged by their text. An empty table gives an empty result. Further
    columns are ignored.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([*own.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return own.mapInArrow(_classify(dictionaries, piece, level, least_margin), schema).drop("text").withColumnRenamed("id", id_col)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, learn(docs))
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
