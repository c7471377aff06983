"""The opN queries against SQL, or a brute-force version where SQL cannot express them."""

import base64
import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
import zstandard
from tokenizers import Tokenizer

import corpus_pipeline
from quirespark.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(rows):
    columns = sorted(rows.columns)
    return rows[columns].convert_dtypes().astype(str).sort_values(columns).reset_index(drop=True)


@pytest.fixture(scope="module")
def documents():
    return pq.read_table(f"{SF}/documents.parquet").to_pandas().sort_values("doc_id")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and frame(got).equals(frame(want))


def groups_of(documents, least=0.8):
    """Groups by exact weighted Jaccard similarity of runs of five words, through an index of all shingles."""
    bags = {}
    for i, text in zip(documents.doc_id, documents.text, strict=True):
        w = WORD.findall(text or "")
        bags[i] = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])
    held, common = collections.defaultdict(list), collections.Counter()
    for i in bags:
        for s, n in bags[i].items():
            for j in held[s]:
                common[j, i] += min(n, bags[j][s])
            held[s].append(i)
    size = {i: sum(bags[i].values()) for i in bags}
    root = {i: i for i in bags}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, j), n in common.items():
        if n / (size[i] + size[j] - n) >= least:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: find(i) for i in bags}


def test_near_duplicates(spark, documents):
    got = QUERIES["op3_minhash_near_dedup"](spark, SF).toPandas()
    assert dict(zip(got.doc_id, got.group_id, strict=True)) == groups_of(documents)
    assert (got.kept == (got.doc_id == got.group_id)).all()


def ids_of(text):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids_of.__globals__["ids_of"] = lambda t: own.encode_ordinary(t or "")
    return own.encode_ordinary(text or "")


def test_byte_bpe(spark, documents):
    got = QUERIES["op5_byte_bpe"](spark, SF).toPandas().set_index("doc_id")
    for i, text in zip(documents.doc_id, documents.text, strict=True):
        ids = ids_of(text)
        assert tuple(got.loc[i]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_token_files(spark, documents):
    own, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    got = QUERIES["op7_token_files"](spark, SF).toPandas().set_index("doc_id")
    for i, text in zip(documents.doc_id, documents.text, strict=True):
        ids = own.encode(text, add_special_tokens=False).ids + [1]
        assert tuple(got.loc[i]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def plain_differences(documents, labels):
    """Toxic minus ordinary log-likelihood a word of each document by plain Kneser-Ney models, and the fold-4 classes."""
    tokens = lambda t: re.findall(rb"[a-z0-9\x80-\xff]+", (t or "").encode().lower())
    toxic = dict(zip(labels.doc_id, labels.toxic, strict=True))
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i in documents.doc_id}
    text = {i: tokens(t) for i, t in zip(documents.doc_id, documents.text, strict=True)}
    triples = [set(), set()]
    for i, w in text.items():
        if i in toxic and fold[i] in (1, 2, 3):
            w = [b"", b"", *w]
            triples[toxic[i]].update(zip(w, w[1:], w[2:], strict=False))
    pair = [collections.Counter((v, w) for _, v, w in t) for t in triples]
    word = [collections.Counter(w for _, w in p) for p in pair]
    head, kinds = [collections.Counter() for _ in pair], [collections.Counter() for _ in pair]
    for c in (0, 1):
        for (v, _), n in pair[c].items():
            head[c][v] += n
            kinds[c][v] += 1

    def settings(counts):
        both = collections.Counter(counts[0]) + collections.Counter(counts[1])
        of = collections.Counter(both.values())
        return both, [sum(x.values()) for x in counts], of[1] / (of[1] + 2 * of[2]) if of[1] and of[2] else 0.75

    words, n_words, d = settings(word)
    pairs, n_pairs, dd = settings(pair)

    def tells(n0, n1, total):
        share = total[1] / sum(total)
        part = lambda x, s: x * np.log(x / ((n0 + n1) * s)) if x else 0.0
        apart = np.log((n1 + 2 * share) / total[1]) - np.log((n0 + 2 * (1 - share)) / total[0])
        return 2 * (part(n0, 1 - share) + part(n1, share)) >= 22 and abs(apart) >= 1

    def chance(c, w):
        shared = (max(words[w] - d, 0) + d * len(words) / (len(words) + 1)) / sum(n_words)
        return (max(word[c][w] - d, 0) + d * len(word[c]) * shared) / n_words[c]

    def given(c, v, w):
        return (max(pair[c][v, w] - dd, 0) + dd * kinds[c][v] * chance(c, w)) / head[c][v] if head[c][v] else chance(c, w)

    def ratio(v, w):
        if pairs[v, w] and tells(pair[0][v, w], pair[1][v, w], n_pairs):
            return np.log(given(1, v, w)) - np.log(given(0, v, w))
        if words[w] and tells(word[0][w], word[1][w], n_words):
            return np.log(chance(1, w)) - np.log(chance(0, w))
        return 0.0

    known: dict = {}
    out = {}
    for i, w in text.items():
        for p in zip([b"", *w], w, strict=False):
            if p not in known:
                known[p] = ratio(*p)
        out[i] = sum(known[p] for p in zip([b"", *w], w, strict=False)) / max(len(w), 1)
    return out, {i: toxic[i] for i in out if i in toxic and fold[i] == 4}


def plain_scores(documents, labels):
    """Scores by the plain differences and a logistic curve, fitted here by small steps down its slope."""
    x, four = plain_differences(documents, labels)
    bent = {i: np.sign(v) * np.log1p(200 * abs(v)) for i, v in x.items()}
    z, y = np.array([bent[i] for i in four]), np.array(list(four.values()))
    a, b = 1.0, 0.0
    for _ in range(60_000):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -50, 50)))
        a, b = a - 0.3 * (((p - y) * z).mean() + 1e-4 * a), b - 0.3 * (p - y).mean()
    return {i: 1 / (1 + np.exp(-np.clip(a * v + b, -50, 50))) for i, v in bent.items()}


@pytest.fixture(scope="module")
def medium():
    sf = "/root/testdata/sf0.01"
    return [pq.read_table(f"{sf}/{t}.parquet").to_pandas() for t in ("documents", "labels")]


def test_toxicity(spark, medium):
    documents, labels = medium
    got = QUERIES["op2_toxicity"](spark, "/root/testdata/sf0.01").toPandas()
    want = plain_scores(documents, labels)
    assert np.allclose(got.score, [want[i] for i in got.doc_id], atol=2e-3) and (got.predicted == (got.score >= 0.5)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert held.predicted[held.toxic == 1].sum() >= 4 and not held.predicted[held.toxic == 0].any()  # two of six hold no typical word


def test_toxicity_finds_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    labels = pq.read_table(f"{sf}/labels.parquet").to_pandas()
    got = QUERIES["op2_toxicity"](spark, sf).toPandas()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert held.predicted[held.toxic == 1].mean() >= 0.85 and held.predicted[held.toxic == 0].mean() <= 0.005


def test_language(spark, medium):
    """Every text against each dictionary, one piece after another, and held-out labels."""
    documents, _ = medium
    from quirespark.llm import language_id
    from quirespark.shared import table

    sf = "/root/testdata/sf0.01"
    dictionaries = language_id.learn(table(spark, sf, "documents"))
    packers = {}
    for lang, content in dictionaries.items():
        own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        packers[lang] = zstandard.ZstdCompressor(level=6, dict_data=own, write_content_size=False)
    got = QUERIES["op9_language_id"](spark, sf).toPandas().set_index("doc_id")
    for i, text in zip(documents.doc_id, documents.text, strict=True):
        letters = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in (text or "").lower().encode())
        size = {lang: sum(len(p.compress(letters[k : k + 1024])) for k in range(0, len(letters), 1024)) for lang, p in packers.items()}
        best, after = sorted(size.values())[:2]
        want = min(sorted(size), key=size.get) if any(c.isalpha() for c in text or "") else "und"
        assert got.lang_pred[i] == want and (want == "und" or abs(got.score[i] - (after - best) / after) < 1e-12)
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.index]).all()
    held = got[got.held_out].join(documents.set_index("doc_id").lang)
    assert (held.lang_pred == held.lang).mean() >= 0.97


def test_pipeline_stages(spark, documents):
    """Each stage against a plain version, on its own input."""
    from quirespark.shared import freeze, table

    docs, seen = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = freeze(stage(spark, docs, SF), name)
        seen.append(docs.toPandas())
    columns = list(documents.columns)
    clean, lines, near, mix, ids = seen
    assert all(list(x.columns) == columns for x in (clean, lines, near, mix))
    score = plain_scores(documents, pq.read_table(f"{SF}/labels.parquet").to_pandas())
    assert set(clean.doc_id) == {i for i, x in score.items() if x < 0.5}
    keys = collections.defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    for i, t in zip(clean.doc_id, clean.text, strict=True):
        for x in t.split("\n"):
            keys[key(x)].add(i)
    want = {i: "\n".join(x for x in t.split("\n") if not key(x) or len(keys[key(x)]) < 10) for i, t in zip(clean.doc_id, clean.text, strict=True)}
    assert dict(zip(lines.doc_id, lines.text, strict=True)) == want and (lines.n_chars == lines.text.str.len()).all()
    assert set(near.doc_id) == {i for i, g in groups_of(lines).items() if i == g}
    con = duckdb.connect()
    con.register("documents", near)
    times = con.execute(ORACLES["op8_source_mixing"]).df()
    size = near.set_index("doc_id").text.map(lambda t: len(WORD.findall(t)))
    assert mix.doc_id.value_counts().to_dict() == {i: n // size[i] for i, n in zip(times.doc_id, times.taken, strict=True) if n}
    assert len(ids) == len(mix)
    digest = {i: hashlib.sha256(t.encode()).hexdigest() for i, t in zip(mix.doc_id, mix.text, strict=True)}
    assert all(digest[i] == d for i, d in zip(ids.doc_id, ids.decoded_sha256, strict=True))
    text = dict(zip(mix.doc_id, mix.text, strict=True))
    assert all(np.frombuffer(x, "<u4").tolist() == ids_of(text[i]) for i, x in zip(ids.doc_id, ids.ids, strict=True))
    assert all(hashlib.sha256(x).hexdigest() == d for x, d in zip(ids.ids, ids.ids_sha256, strict=True))


def test_pipeline_stages_on_odd_rows(spark):
    """Nulls, repeats, blanks, no rows, and columns named like the stages' own."""
    kind = "doc_id long, text string, lang string, source string, n_chars long, _toxicity_score double, key string, gone int, rest int, score double, ids string"
    rows = [(1, "a b\nc d", "s"), (1, "a b\nc d", "s"), (1, "other", None), (2, None, "s"), (3, "", "t"), (4, " \n\t ", None), (None, "no id", "s"), (None, None, None), (5, "long text " * 30_000, "s")]
    docs = spark.createDataFrame([(i, t, "en", s, 1, 0.5, "k", 1, 1, 0.5, "x") for i, t, s in rows], kind)
    stages = dict(corpus_pipeline.STAGES)
    got = {name: stage(spark, docs, SF).toPandas() for name, stage in stages.items()}
    assert all(list(got[name].columns) == docs.columns for name in list(stages)[:-1])
    assert len(got["toxicity"]) == len(got["line_dedup"]) == len(got["byte_bpe"]) == len(rows)
    assert (got["line_dedup"].text.str.len() == got["line_dedup"].n_chars).all() and got["line_dedup"].text.notna().all()
    assert sorted(got["minhash_near_dedup"].doc_id.fillna(-1)) == [-1, -1, 1, 1, 2, 3, 4, 5]
    assert got["source_mixing"].groupby(["doc_id", "text", "source"], dropna=False).size().max() <= 2 * 3  # two rows are equal
    assert sorted(got["byte_bpe"].n_tokens)[:3] == [0, 0, 0]
    for name, stage in stages.items():
        assert stage(spark, docs.limit(0), SF).count() == 0, name
