"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns; and the operators' own interfaces."""

import collections
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from quirespark.llm import bpe, embedding_dedup, exact_topk, language_id, line_dedup, mixing, near_dedup, substring_dedup, textkit, token_files, toxicity
from quirespark.llm.components import components
from quirespark.shared import new_path

BPE, WORDS = (public_tokenizers.path(x) for x in ("byte_bpe_50k.tiktoken", "word_bpe_49k.json"))
KIND = "doc_id long, text string, source string, key string, id int, h string, rest int, score string, n int, at string, gone int, lang string"


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with every oddity, and columns named like the operators' own."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, "a b c"), (1, "a b c"), (1, "other text of the same id"), (2, None), (3, ""), (4, " \n\t "), (None, "no id here at all"), (None, None), (5, long), (6, long), (7, "é   x́ \x1c😀 İ ẞ")]
    return spark.createDataFrame([(i, t, None if i == 2 else "s", "k", 1, "h", 1, "s", 1, "a", 1, "en") for i, t in rows], KIND)


def test_odd_rows_keep_their_number(spark, odd):
    labels = spark.createDataFrame([(1, 1), (5, 0), (None, 1), (1, None)], "doc_id long, toxic int")
    runs = {
        "substring": lambda d: substring_dedup.remove_repeated(d),
        "near": lambda d: near_dedup.near_duplicates(d),
        "lines": lambda d: line_dedup.drop_frequent_lines(d, min_docs=2),
        "bpe": lambda d: bpe.decode(bpe.encode(d, BPE), BPE),
        "tokens": lambda d: token_files.tokenize(d, WORDS, end_id=1),
        "mix": lambda d: mixing.mix_sources(d),
        "toxicity": lambda d: toxicity.score_toxicity(d, labels),
        "language": lambda d: language_id.identify(d, language_id.learn(d)),
    }
    for name, run in runs.items():
        assert run(odd).count() == odd.count(), name
        assert run(odd.limit(0)).count() == 0, name
    for whole in (line_dedup.without_frequent_lines, near_dedup.first_of_each_group, mixing.mixture):
        assert whole(odd).columns == odd.columns and whole(odd.limit(0)).count() == 0


def test_odd_rows_have_their_results(spark, odd):
    cut = substring_dedup.remove_repeated(odd).collect()
    assert [r.n_removed for r in cut if r.doc_id == 6] == [60_000] and [r.n_removed for r in cut if r.doc_id == 5] == [0]
    assert all(r.n_words == 0 and r.kept_text == "" for r in cut if r.doc_id in (2, 3, 4))
    near = near_dedup.near_duplicates(odd).collect()
    assert sorted(r.kept for r in near if r.doc_id == 1) == [False, True, True] and all(r.kept for r in near if r.doc_id in (2, 3, 4, 5, 7))
    assert [r.group_id for r in near if r.doc_id == 6] == [5]
    lines = line_dedup.drop_frequent_lines(odd, min_docs=2).collect()
    assert [(r.n_lines, r.n_dropped, r.kept_text) for r in lines if r.doc_id == 2] == [(1, 0, "")]
    assert [r.n_dropped for r in lines if r.doc_id in (5, 6)] == [1, 1]
    back = bpe.decode(bpe.encode(odd, BPE), BPE).collect()
    want = collections.Counter((r.doc_id, r.text or "") for r in odd.select("doc_id", "text").collect())
    assert collections.Counter((r.doc_id, bytes(r.decoded).decode()) for r in back) == want
    said = language_id.identify(odd, language_id.learn(odd)).collect()
    assert all(r.lang_pred == "und" and r.score == 0 for r in said if r.doc_id in (2, 3, 4))


def test_token_files_of_odd_rows(spark, odd):
    path = new_path(spark, "odd-tokens")
    tokens = token_files.tokenize(odd, WORDS, end_id=1)
    token_files.write_tokens(tokens, path, block_tokens=1000)
    back = token_files.read_tokens(spark, path).orderBy("start").collect()
    assert collections.Counter((r.doc_id, bytes(r.ids)) for r in back) == collections.Counter((r.doc_id, bytes(r.ids)) for r in tokens.collect())
    assert [r.start for r in back] == list(np.cumsum([0] + [r.n_tokens for r in back])[:-1]) and back[-1].doc_id is None
    assert [r.doc_id for r in back if r.doc_id is not None] == sorted(r.doc_id for r in back if r.doc_id is not None)


def test_rans_blocks_checkpoints_and_damage(spark):
    rng = np.random.default_rng(1)
    ids = rng.zipf(1.3, 700_000).clip(max=40_000).astype(np.uint32)
    coder = token_files.Coder(token_files.scaled(np.bincount(ids)))
    payload, points, lanes = coder.encode(ids)
    assert len(payload) < 2 * len(ids) and np.array_equal(coder.decode(payload, points, lanes, len(ids)), ids)
    later = token_files.STEPS_TO_CHECKPOINT * lanes
    assert np.array_equal(coder.decode(payload, points, lanes, len(ids), checkpoint=1), ids[later:])
    for n in (0, 1, 2, 300):
        p, q, k = coder.encode(ids[:n])
        assert np.array_equal(coder.decode(p, q, k, n), ids[:n])
    assert token_files.scaled(np.array([5, 0, 1])).tolist()[1] == 0 and token_files.scaled(np.ones(3)).sum() == 1 << token_files.BITS
    path = new_path(spark, "damaged")
    token_files.write_tokens(token_files.tokenize(spark.createDataFrame([(1, "some words")], "doc_id long, text string"), WORDS), path)
    bad = spark.read.parquet(f"{path}/blocks").withColumn("ids_crc", F.lit(1))
    bad.write.parquet(f"{path}-2/blocks")
    spark.read.parquet(f"{path}/frequencies").write.parquet(f"{path}-2/frequencies")
    with pytest.raises(Exception, match="damaged"):
        token_files.read_tokens(spark, f"{path}-2").collect()


def test_difference_covers():
    for period in (1, 5, 7, 13, 21, 31, 40):
        cover = substring_dedup.difference_cover(period)
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def brute_substrings(texts, n):
    first = {}
    for i, t in enumerate(texts):
        for k in range(len(t) - n + 1):
            first.setdefault(tuple(t[k : k + n]), i)
    out = []
    for i, t in enumerate(texts):
        dead = set()
        for k in range(len(t) - n + 1):
            if first[tuple(t[k : k + n])] < i:
                dead |= set(range(k, k + n))
        out.append(" ".join(w for k, w in enumerate(t) if k not in dead))
    return out


@pytest.mark.parametrize(("words", "period"), [(12, 7), (12, 5), (50, 31), (9, 1)])
def test_substrings_against_brute_force(spark, words, period):
    rng = random.Random(words)
    shared = [[rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.choice([words - 1, words, words + 9]))] for _ in range(6)]
    texts = [[w for _ in range(rng.randrange(6)) for w in (rng.choice(shared) if rng.random() < 0.6 else [str(rng.random()) for _ in range(4)])] + ["z"] * rng.choice([0, 0, 70]) for _ in range(60)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.kept_text for r in substring_dedup.remove_repeated(docs.repartition(3), words, period).collect()}
    assert [got[i] for i in range(60)] == brute_substrings(texts, words)


@pytest.mark.parametrize("twice", [1, 2])
def test_substrings_around_a_run_that_stands_twice_in_one_document(spark, twice):
    run = [f"r{i}" for i in range(20)]
    passage = [f"a{i}" for i in range(15)] + run + [f"b{i}" for i in range(15)]
    # the run stands at 1 and 65 of one document and at 31 of the other: residues 1, 3 and 0 of the cover
    texts = {twice: ["x"] + run + [f"y{i}" for i in range(29)] + passage, 3 - twice: [f"z{i}" for i in range(16)] + passage}
    docs = spark.createDataFrame(spark.sparkContext.parallelize([(i, " ".join(t)) for i, t in texts.items()], 2), "doc_id long, text string")
    got = {r.doc_id: r.kept_text for r in substring_dedup.remove_repeated(docs).collect()}
    assert [got[1], got[2]] == brute_substrings([texts[1], texts[2]], 50)
    assert len(got[2].split()) == len(texts[2]) - 50


def test_dart_minhash_estimates_weighted_similarity():
    rng = np.random.default_rng(2)
    a = {i: rng.uniform(0.1, 3) for i in range(200)}
    b = {i: a[i] * rng.choice([1, 1, 0.5]) for i in range(40, 200)} | {i: 1.5 for i in range(300, 330)}
    want = sum(min(a[i], b[i]) for i in a if i in b) / (sum(a.values()) + sum(b.values()) - sum(min(a[i], b[i]) for i in a if i in b))
    element = np.array([*a, *b], np.uint64)
    sig = near_dedup.dart_minhash(textkit.mix(element), np.repeat([0, 1], [len(a), len(b)]), 3, 2000, np.array([*a.values(), *b.values()]))
    assert abs((sig[0] == sig[1]).mean() - want) < 0.05 and (sig[2] == np.uint64(2**64 - 1)).all()
    plain = near_dedup.dart_minhash(textkit.mix(element), np.repeat([0, 1], [len(a), len(b)]), 2, 2000)
    assert abs((plain[0] == plain[1]).mean() - 160 / 230) < 0.05


def test_a_chain_of_near_copies_is_one_group_whatever_the_block(spark):
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words[:k] + [f"x{k}"] + words[k + 1 :]) for k in range(3, 190, 6)] + [" ".join(words)] + [" ".join(f"y{j}{i}" for i in range(30)) for j in range(5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (4, 1000):
        got = near_dedup.near_duplicates(docs, block_docs=block).collect()
        n = len(texts) - 5
        assert {r.doc_id: r.group_id for r in got} == {i: 0 if i < n else i for i in range(len(texts))}


def test_line_runs_compact_and_skip_what_is_frequent(spark):
    runs = line_dedup.LineRuns(spark)
    for batch in range(7):
        rows = [(h, 0, batch * 10 + k) for h in range(3) for k in range(h + 1)]
        runs.ingest(spark.createDataFrame(rows, "h long, g int, key long"), at_least=4)
        assert len(runs.runs()) == bin(batch + 1).count("1")
    # a run knows keys 1 and 2 to be frequent once it holds two batches, key 0 once it holds four; then they count no more
    assert {r.h: r.n for r in runs.frequent(4).collect()} == {0: 4, 1: 4, 2: 6}
    assert len(runs.runs()) == 1
    runs.close()
    assert line_dedup.LineRuns(spark).frequent(1) is None and not spark.sql("SHOW TABLES LIKE 'line_run_*'").collect()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_line_runs_are_neither_shuffled_nor_sorted(spark):
    runs = line_dedup.LineRuns(spark)
    rows = spark.range(5000).selectExpr("xxhash64(id % 700) AS h", "hash(id % 700) AS g", "id AS key")
    for batch in range(3):
        runs.ingest(rows.where(F.col("key") % 3 == batch), at_least=10**6)
    with line_dedup._run_scans(spark):
        merge, anti = plan_of(runs.merged(*runs.runs())), plan_of(runs.unsettled(rows, 10))
    assert merge.count("SortMergeJoin") == 1 and "Exchange" not in merge and "Sort [" not in merge
    assert anti.count("SortMergeJoin") == 2 and anti.count("Exchange") == 1 and anti.count("Sort [") == 1
    assert anti.index("HashAggregate") > anti.index("SortMergeJoin"), "counted before the join"
    assert {r.h: r.n for r in runs.frequent(1).collect()} == {r.h: r.n for r in rows.groupBy("h").agg(F.count("*").alias("n")).collect()}
    runs.close()


def test_lines_in_many_batches(spark):
    rng = random.Random(8)
    texts = ["\n".join(rng.choice("abcdefgh") * rng.randint(0, 3) for _ in range(rng.randint(0, 6))) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = collections.Counter(x for t in texts for x in set(t.split("\n")))
    for task_lines in (25, 1 << 14):
        got = {r.doc_id: r.kept_text for r in line_dedup.drop_frequent_lines(docs, min_docs=20, task_lines=task_lines).collect()}
        assert got == {i: "\n".join(x for x in t.split("\n") if not x or held[x] < 20) for i, t in enumerate(texts)}


def test_more_batches_make_no_more_files(spark, monkeypatch, tmp_path):
    import glob
    import uuid

    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws("\n", F.lit("all have this"), *[F.concat(F.lit(f"{k} "), F.col("id") % (k + 2)) for k in range(20)]).alias("text"))
    counts, results = [], []
    for task_lines in (1 << 20, 400, 10):  # one batch, five, and more than there may be
        monkeypatch.setattr(line_dedup, "new_path", lambda spark, name, at=str(tmp_path / str(task_lines)): f"file://{at}/{name}-{uuid.uuid4().hex}")
        results.append({r.doc_id: r.kept_text for r in line_dedup.drop_frequent_lines(docs, min_docs=30, task_lines=task_lines).collect()})
        counts.append((len(glob.glob(str(tmp_path / str(task_lines) / "lines-*" / "batch=*"))), len(glob.glob(str(tmp_path / str(task_lines) / "lines-*" / "batch=*" / "*.parquet")))))
    assert results[0] == results[1] == results[2] and [c[0] for c in counts] == [1, 6, line_dedup.MOST_BATCHES]
    assert counts[0][1] <= 4 and counts[1][1] <= 6 * 4 and counts[2][1] <= 64 + 4 * 4  # far below batches x partitions


def test_a_failure_leaves_no_runs_and_rules_stay_excluded(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a\nb"), (2, "a")], "doc_id int, text string")
    rules, other = "spark.sql.optimizer.excludedRules", "org.apache.spark.sql.catalyst.optimizer.CombineConcats"
    spark.conf.set(rules, other)
    try:
        with line_dedup._run_scans(spark):
            assert spark.conf.get(rules).startswith(other + ",")
        assert spark.conf.get(rules) == other
    finally:
        spark.conf.unset(rules)

    def fail(self, at_least):
        raise RuntimeError("lost")

    monkeypatch.setattr(line_dedup.LineRuns, "frequent", fail)
    with pytest.raises(RuntimeError, match="lost"):
        line_dedup.drop_frequent_lines(docs, min_docs=2)
    assert not spark.sql("SHOW TABLES LIKE 'line_run_*'").collect()


def test_a_document_of_many_dropped_lines_takes_linear_time(spark):
    docs = spark.createDataFrame([(i, "\n".join(f"line {k}" if k % 2 else f"own {i} {k}" for k in range(64_000))) for i in range(2)], "doc_id long, text string")
    began = time.perf_counter()
    got = line_dedup.drop_frequent_lines(docs, min_docs=2, task_lines=1 << 20).collect()
    assert time.perf_counter() - began < 30  # looking through all dropped lines for each line took a minute for one document
    assert all((r.n_lines, r.n_dropped) == (64_000, 32_000) and r.kept_text == "\n".join(f"own {r.doc_id} {k}" for k in range(0, 64_000, 2)) for r in got)


def test_flags_at_positions(spark):
    got = spark.createDataFrame([([0, 2, 3],), ([],), ([4],)], "at array<int>").select(line_dedup.flags_at(F.col("at")).alias("f")).collect()
    assert [r.f for r in got] == [[True, False, True, True], [], [False] * 4 + [True]]


def test_line_keys(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["ÉA x \x0b", " \t", "İZ", "é\x85A "])], "doc_id long, text string")
    got = [r.k for r in rows.orderBy("doc_id").select(line_dedup.line_key(F.col("text")).alias("k")).collect()]
    assert got == ["Éa x ", "", "İz", "é\x85a"]


def test_mixing_targets_and_edges(spark):
    rows = [(i, "w " * (i % 7 + 1), "big" if i < 60 else "small" if i < 63 else None) for i in range(70)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    total = got["size"].sum()
    by = got.groupby(got.source_size).agg(target=("target", "first"), taken=("taken", "sum"), size=("size", "sum"))
    assert (got.taken <= 3 * got["size"]).all() and (by.target <= 3 * by["size"]).all() and by.target.sum() == pytest.approx(total)
    assert (abs(by.taken - by.target) <= 7).all()
    nothing = mixing.mix_sources(spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")).collect()
    assert [(r.size, r.target, r.taken) for r in nothing] == [(0, 0.0, 0)] * 2


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "k") for i, v in rows], "vec_id long, embedding array<float>, key int, v string")


def test_exact_topk_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 0.3, (300, 16)).astype(np.float32)
    x[10] = x[11] = x[12]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, None), (420, [1.0, None] * 8), (440, [float("nan")] * 16), (460, []), (None, [1.0] * 16)]
    got = exact_topk.top_k(vectors(spark, rows), "vec_id % 20 = 0", k=7, shard_rows=64, query_rows=6).toPandas()
    q = np.floor(64 * x.astype(np.float64)).astype(np.int64)
    for i in range(0, 300, 20):
        s = q @ q[i]
        best = sorted((j for j in range(300) if j != i), key=lambda j: (-s[j], j))[:7]
        mine = got[got.query_id == i].sort_values("rank")
        assert mine.vec_id.tolist() == best and mine.score.tolist() == [s[j] for j in best]
    assert set(got.query_id) == set(range(0, 300, 20))
    few = exact_topk.top_k(vectors(spark, rows[:3]), "vec_id % 20 = 0", k=7)
    assert few.count() == 2 and exact_topk.top_k(vectors(spark, rows).limit(0), "vec_id % 20 = 0").count() == 0
    huge = exact_topk.top_k(vectors(spark, [(0, [3e6, 1.0]), (1, [3e6, 2.0]), (2, [-3e6, 5.0])]), "vec_id = 0", k=2).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in huge] == [(1, (64 * 3_000_000) ** 2 + 64 * 128), (2, -((64 * 3_000_000) ** 2) + 64 * 320)]


@pytest.mark.parametrize("block", [16, 4096])
def test_embedding_links_against_brute_force(spark, block):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(60, 24))
    x = np.concatenate([base, base[:20] + rng.normal(0, 0.12, (20, 24)), base[:1] + rng.normal(0, 0.15, (40, 24)), base[5:8], 2 * base[8:9]]).astype(np.float32)
    bad = [(500, None), (501, [0.0] * 24), (502, [None] + [1.0] * 23), (503, [float("inf")] * 24), (504, [1.0, 2.0])]
    got = embedding_dedup.near_duplicate_vectors(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)] + bad), 0.9, block_rows=block).toPandas().set_index("vec_id")
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    root = np.arange(len(x))
    for _ in range(len(x)):
        root = np.minimum(root, np.where(near, root[None, :], len(x)).min(1))
    assert got.n_links[: len(x)].tolist() == near.sum(1).tolist() and got.component_id[: len(x)].tolist() == root.tolist()
    assert all(got.loc[i].n_links == 0 and got.loc[i].component_id == i and got.loc[i].kept for i, _ in bad)


def test_embeddings_that_repeat_an_id_or_are_none(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [0.0, 1.0]), (2, [0.0, 1.0])]
    got = embedding_dedup.near_duplicate_vectors(vectors(spark, rows)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in got) == [(0, 1, 2, False), (1, 1, 1, False), (1, 1, 1, True), (2, 1, 2, True)]
    assert embedding_dedup.near_duplicate_vectors(vectors(spark, rows).limit(0)).count() == 0


def test_cover_tree_is_nested_and_covers():
    u = embedding_dedup.unit(np.random.default_rng(4).normal(size=(300, 6)))
    tree = embedding_dedup.cover_tree(u)
    for (net, radii, parent), (deeper, _, _) in zip(tree, tree[1:], strict=False):
        assert set(net) <= set(deeper) and len(parent) == len(deeper)
    assert len(tree[-1][0]) == 300 and (tree[0][1] > 0).any()


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 140)] + [(200, 200)] + [(300, 299), (299, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(2, 41)} | {i: 100 for i in range(101, 140)} | {300: 299}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_toxicity_without_labels_and_its_columns(spark, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score_toxicity(odd, none).collect()
    assert all(r.predicted == 0 and 0 <= r.score < 0.5 for r in got) and len({r.score for r in got}) == 1
    assert all(r.held_out for r in got if r.doc_id is None)


def test_words_and_units_cover_texts():
    texts = pa.array(["ab cd  ef", None, "", " x ", "no sp é\tq", "abc"])
    w = textkit.words(texts)
    assert w.counts.tolist() == [3, 0, 0, 1, 3, 1]
    starts, ends, ptr = w.units()
    joined = [b"".join(bytes(w.data[s:e]) for s, e in zip(starts[a:b], ends[a:b], strict=True)).decode() for a, b in zip(ptr, ptr[1:], strict=False)]
    assert joined == ["ab cd  ef", "", "", " x ", "no sp é\tq", "abc"]
    long = textkit.span_hashes(np.frombuffer(b"x" * 1000 + b"y", np.uint8), np.array([0, 0]), np.array([1000, 1001]))
    assert long[0] != long[1]


def test_texts_with_other_white_space_are_cut_into_words(spark):
    rng = random.Random(3)
    signs = [" ", "\n", "\t", "\u00a0", "\u3000", "\u2003", "\u0085", "\x1c", "\x1f", "\u1680", "\u200b", "\u205f", "a", "b", "é", "1", ".", "'s", "!", "中"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(20_000)] + [f"word\u00a0{i} another\u3000 word" for i in range(50)]
    own = bpe._encoding(open(BPE, "rb").read(), public_tokenizers.PATTERN)
    want = [own.encode_ordinary(t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for remembered in (1, 500_000):
        got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in bpe.encode(docs, BPE, remembered=remembered).collect()}
        assert got == dict(enumerate(want))
    counts = bpe.split_units(pa.array(texts[-50:]))[3]
    assert (counts == 2).all()


def test_shingles_weigh_as_often_as_they_occur(spark):
    verse = "one two three four five six seven eight nine ten "
    docs = spark.createDataFrame([(1, verse * 20), (2, verse * 17), (3, verse * 10), (4, verse)], "doc_id long, text string")
    got = {r.doc_id: r.group_id for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}  # as plain sets the first three would be equal


def test_language_dictionaries_hold_more_than_beginnings(spark):
    banner = " ".join(f"banner{'abcdefghijklmnopqrstuvwxyz'[i % 26]}" for i in range(40))  # over 281 bytes
    rng = random.Random(4)
    body = lambda: " ".join("w" + "".join(rng.choices("aeiou", k=6)) for _ in range(100))
    short = lambda: " ".join(["start"] * 50 + ["".join(rng.choices("xyz", k=6)) for _ in range(20)])
    same = body()
    rows = [("hot", f"{banner} {body()}") for _ in range(1600)] + [("short", short()) for _ in range(1600)] + [("copies", same) for _ in range(1600)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string")
    learnt = language_id.learn(docs)
    assert len(learnt["hot"]) > 90_000 and 2 * learnt["hot"].count(b" w") > 3 * learnt["hot"].count(b"banner")
    assert sum(set(w) <= set(b"xyz") for w in learnt["short"].split()) > 1000
    assert len(learnt["copies"]) < 1000
