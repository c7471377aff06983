"""Passages against books: shared grams, increasing chains, similarity."""

from __future__ import annotations

import bisect
import itertools
import re
from difflib import SequenceMatcher

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirespark.shared import freeze


def text_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.replace(text, F.lit("’"), F.lit("'"))), F.lit("([a-z0-9]+(?:'[a-z]+)?)"), 1)


def grams(rows: DataFrame, id_col: str, text_col: str = "text", k: int = 3) -> DataFrame:
    """id, pos and gram: every run of k words."""
    t = rows.select(F.col(id_col), text_tokens(F.col(text_col)).alias("t"))
    # the words at three offsets side by side: no lambda looks back into the array
    n = F.greatest(F.size("t") - (k - 1), F.lit(0))
    sides = [F.slice("t", i + 1, n) for i in range(k)]
    joined = sides[0]
    for side in sides[1:]:
        joined = F.zip_with(joined, side, lambda a, b: F.concat(a, F.lit(" "), b))
    return t.select(id_col, F.posexplode(joined).alias("pos", "gram"))


def grams_within_books(asked: DataFrame, asked_id: str, books: DataFrame, book_id: str, most: int = 8, k: int = 3, salts: int = 16) -> DataFrame:
    """asked_id, book_id, apos and bpos of equal grams, without grams that stand in more than `most` places of the one book;
    how many books have a gram does not matter. Every gram is dealt over `salts` tasks, so a frequent one is not joined in one."""
    # only grams that are asked for go on to be counted
    wanted = grams(asked, asked_id, k=k).select("gram").distinct()
    b = grams(books, book_id, k=k).join(wanted, "gram", "left_semi").groupBy(book_id, "gram").agg(F.collect_list("pos").alias("bpos")).where(F.size("bpos") <= most)
    b = b.withColumn("salt", F.pmod(F.xxhash64(book_id), F.lit(salts)))
    a = grams(asked, asked_id, k=k).withColumnRenamed("pos", "apos").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return a.join(b, ["gram", "salt"]).select(asked_id, book_id, "apos", F.explode("bpos").alias("bpos"))


def longest_chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs that rises in both numbers: each pair's rank is the longest run that ends in it, and from
    the back the first pair of every rank in turn is one such run."""
    tops, ranked = [], []
    for pair in sorted(pairs, key=lambda p: (p[0], -p[1])):
        rank = bisect.bisect_left(tops, pair[1])
        tops[rank : rank + 1] = [pair[1]]
        ranked.append((rank, pair))
    out, wanted = [], len(tops) - 1
    for rank, pair in reversed(ranked):
        if rank == wanted:
            out.append(pair)
            wanted -= 1
    return out[::-1]


def candidates(asked: DataFrame, asked_id: str, books: DataFrame, book_id: str, most: int = 8, k: int = 3, first: int = 4) -> tuple[DataFrame, DataFrame]:
    """asked_id, book_id, least, most and hits (offset and places) of the books that may hold an asked text's longest chain,
    and the grams of the asked texts that any book has (see below).

    A book is admitted through a text's rarest grams only. A book without the r rarest of the n grams has no chain longer
    than n - r, and the most hits of one offset in a book that was looked at are a chain: as soon as that is longer than
    n - r, no other book can win or tie. Until then twice as many grams admit books, for the texts that are still open."""
    own = freeze(grams(asked, asked_id, k=k).withColumnRenamed("pos", "apos"), "asked")
    # only grams that are asked for go on to be counted
    held = grams(books, book_id, k=k).join(own.select("gram").distinct(), "gram", "left_semi").groupBy(book_id, "gram").agg(F.collect_list("pos").alias("bpos"))
    held = freeze(held.where(F.size("bpos") <= most), "postings")
    by_rarity = Window.partitionBy(asked_id).orderBy("n", "apos")
    rank = own.join(held.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "gram").withColumn("r", F.row_number().over(by_rarity))
    rank = freeze(rank.withColumn("of", F.count(F.lit(1)).over(Window.partitionBy(asked_id))).drop("n"), "ranked-grams")
    looked, lo, hi, open_ = None, 0, first, rank.select(asked_id, "of").distinct()
    while not open_.isEmpty():
        turn = rank.where((F.col("r") > lo) & (F.col("r") <= hi)).join(open_.select(asked_id), asked_id, "left_semi")
        new = turn.join(held, "gram").select(asked_id, book_id).distinct()
        if looked is not None:
            new = new.join(looked.select(asked_id, book_id), [asked_id, book_id], "left_anti")
        hits = new.join(rank.select(asked_id, "apos", "gram"), asked_id).join(held, [book_id, "gram"]).select(asked_id, book_id, "apos", F.explode("bpos").alias("bpos"))
        # hits of one offset are a chain, and no chain is longer than the asked grams that the book has
        offsets = hits.groupBy(asked_id, book_id, (F.col("bpos") - F.col("apos")).alias("offset")).agg(F.count(F.lit(1)).alias("n"), F.collect_list("apos").alias("at"))
        found = offsets.groupBy(asked_id, book_id).agg(F.max("n").alias("least"), F.collect_list(F.struct("offset", "at")).alias("hits"))
        found = found.withColumn("most", F.size(F.array_distinct(F.flatten(F.col("hits.at")))).cast("long"))
        found = freeze(found, "admitted")
        looked = found if looked is None else looked.unionByName(found)
        sure = looked.groupBy(asked_id).agg(F.max("least").alias("sure"))
        left = rank.select(asked_id, "of").distinct().join(sure, asked_id, "left").where((F.col("of") > hi) & (F.col("of") - hi >= F.coalesce("sure", F.lit(0))))
        open_, lo, hi = freeze(left.select(asked_id, "of"), "open"), hi, 2 * hi
    if looked is None:
        looked = rank.select(asked_id).join(held.select(book_id), F.lit(False)).select(asked_id, book_id, F.lit(0).cast("long").alias("least"), F.expr("cast(array() as array<struct<offset: int, at: array<int>>>)").alias("hits"), F.lit(0).cast("long").alias("most"))
    return looked, rank


_TOKEN = re.compile(r"[A-Za-z0-9]+(?:['’][A-Za-z]+)?")
_CLOSES = re.compile(r"[\"”’')\]]*[.!?;:,]?[\"”’')\]]*")


def _measured(asked: list[str], text: str, begin: int, size: int) -> tuple[float, float, int, str | None]:
    """Similarity, coverage, chapter and text of the passage among `size` words of a book's text from word `begin` on."""
    spans = list(itertools.islice((m.span() for m in _TOKEN.finditer(text)), begin, begin + size))
    near = [text[i:j].lower().replace("’", "'") for i, j in spans]
    equal = [(at, to) for kind, _, _, at, to in SequenceMatcher(None, asked, near, autojunk=False).get_opcodes() if kind == "equal"]
    if not equal:
        return 0.0, 0.0, 0, None
    matched, start = sum(to - at for at, to in equal), spans[equal[0][0]][0]
    page_end = text.find("\f", start)
    last = max(i for i in range(equal[0][0], equal[-1][1]) if page_end < 0 or spans[i][1] <= page_end)
    end = spans[last][1]
    end += _CLOSES.match(text[end : end + 4]).end()
    return matched / len(asked), matched / (last - equal[0][0] + 1), text.count("\f", 0, start), " ".join(text[start:end].split())


def best_passages(asked: DataFrame, asked_id: str, books: DataFrame, book_id: str, slack: int = 6) -> DataFrame:
    """For each asked text of four words or more the best passage of a book: the book with the longest chain of shared grams
    (length; of equal ones the smallest id), similarity (matched words over asked words), coverage (matched words over the
    passage), chapter and passage, the book's own text. Form feeds part a book's chapters, numbered from 0; a passage ends
    where the chapter in which it begins does. Asked texts that share no gram with a book, and null texts, have no row."""
    pairs, _ = candidates(asked, asked_id, books, book_id)
    kinds = dict(pairs.dtypes)
    sure = pairs.groupBy(asked_id).agg(F.max(F.struct(F.col("least").alias("n"), (-F.col(book_id)).alias("b"))).alias("sure"))
    open_ = pairs.join(sure, asked_id).where(F.struct(F.col("most").alias("n"), (-F.col(book_id)).alias("b")) >= F.col("sure")).select(asked_id, book_id, "hits")

    def chain(batches):
        for p in batches:
            found = [longest_chain([(a, a + h["offset"]) for h in row for a in h["at"]]) for row in p["hits"]]
            ends = [(len(c), c[0][1] - c[0][0], c[-1][1] - c[-1][0]) for c in found]
            yield p[[asked_id, book_id]].assign(length=[e[0] for e in ends], first=[e[1] for e in ends], last=[e[2] for e in ends])

    chains = open_.mapInPandas(chain, f"{asked_id} {kinds[asked_id]}, {book_id} {kinds[book_id]}, length int, first int, last int")
    best = chains.groupBy(asked_id).agg(F.max_by(F.struct(book_id, "length", "first", "last"), F.struct("length", -F.col(book_id))).alias("b")).select(asked_id, "b.*")
    a = asked.select(asked_id, text_tokens(F.col("text")).alias("asked")).where(F.size("asked") >= 4)
    # the passage goes on from the last shared gram for as many words as the asked text has left
    start = F.greatest(F.col("first") - slack, F.lit(0))
    size = F.greatest(F.col("last") + F.size("asked") + slack - start, F.lit(0))
    won = best.join(a, asked_id).join(books.select(book_id, "text"), book_id).select(asked_id, book_id, "length", "asked", start.alias("begin"), size.alias("size"), "text")

    def measure(batches):
        for p in batches:
            rows = [_measured(list(x), t, int(b), int(n)) for x, t, b, n in zip(p["asked"], p["text"], p["begin"], p["size"], strict=True)]
            yield p[[asked_id, book_id, "length"]].assign(similarity=[r[0] for r in rows], coverage=[r[1] for r in rows], chapter=[r[2] for r in rows], passage=[r[3] for r in rows])

    return won.mapInPandas(measure, f"{asked_id} {kinds[asked_id]}, {book_id} {kinds[book_id]}, length int, similarity double, coverage double, chapter int, passage string")


def first_speaker(gold: DataFrame, lines: DataFrame, chars: int = 12) -> DataFrame:
    """gold (prefix, speaker) against the first line that starts with the prefix. Lines and prefixes meet by their first
    characters, so this is an equi join; startswith() is what is left to test."""
    g = gold.withColumn("_k", F.left("prefix", F.lit(chars)))
    s = lines.withColumn("_k", F.left("text", F.lit(chars))).select("_k", "pos", "text", F.col("speaker").alias("said"))
    hit = g.join(s, "_k").where(F.startswith("text", "prefix")).groupBy("prefix", "speaker").agg(F.min_by("said", "pos").alias("found"))
    return hit.withColumn("right", F.col("found") == F.col("speaker"))
