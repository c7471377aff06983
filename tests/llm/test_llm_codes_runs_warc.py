"""Vector codes, periodic runs and web archives: brute force, odd rows, and the operators' own interfaces."""

import base64
import gzip
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirespark.llm import periodic_runs, vector_codes, warc
from quirespark.llm.lookup import joined_back
from quirespark.shared import new_path


def plain_codes(rows, parts, entries, rounds, scale):
    """rows: (id, vector, label), in the order of their ids; all vectors equally long."""
    width = len(rows[0][1]) // parts
    whole = [[int(np.floor(float(np.float32(x)) * scale)) for x in v] for _, v, _ in rows]
    cut = [[w[p * width : (p + 1) * width] for p in range(parts)] for w in whole]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, book: min(range(len(book)), key=lambda i: (far(x, book[i]), i))
    for _ in range(rounds):
        for p in range(parts):
            mine = [near(c[p], books[p]) for c in cut]
            for e in set(mine):
                group = [c[p] for c, m in zip(cut, mine, strict=True) if m == e]
                books[p][e] = [sum(col) // len(group) for col in zip(*group, strict=True)]
    out, labels = {}, {}
    for (i, _, label), c in zip(rows, cut, strict=True):
        code = [near(c[p], books[p]) for p in range(parts)]
        out[i] = ("".join(f"{x:02x}" for x in code), sum(far(c[p], books[p][x]) for p, x in enumerate(code)), label)
        labels[label] = labels.get(label, 0) + out[i][1]
    return {i: (c, e, labels[label]) for i, (c, e, label) in out.items()}, books


@pytest.mark.parametrize(("parts", "entries", "rounds", "scale"), [(2, 3, 2, 8), (4, 5, 4, 1024), (1, 40, 1, 2)])
def test_codes_against_brute_force(spark, parts, entries, rounds, scale):
    rng = random.Random(entries)
    seeds = [[rng.uniform(-1, 1) for _ in range(8)] for _ in range(7)]
    rows = [(i * 3, rng.choice(seeds) if rng.random() < 0.5 else [rng.uniform(-1, 1) for _ in range(8)], rng.choice([None, 1, 2])) for i in range(60)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    got, books = vector_codes.compress(spark.createDataFrame(shuffled, "vec_id long, embedding array<float>, label int"), parts, entries, rounds, scale)
    want, want_books = plain_codes(rows, parts, entries, rounds, scale)
    assert {r.vec_id: (r.code, r.error, r.label_error) for r in got.collect()} == want
    assert books.tolist() == want_books


def test_codes_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 0.25, 1.0]), (2, None), (3, [0.5, None, 0.0]), (4, [nan, 0.0, 0.0]), (5, [inf, 0.0, 0.0]), (6, []), (7, [0.5]), (1, [0.5, 0.25, 1.0]), (None, [-0.5, 0.0, 0.0, 0.0, 1.5])]
    odd = spark.createDataFrame([(i, v, None, "k", 1, 1, 1) for i, v in rows], "vec_id long, embedding array<float>, label string, key string, p int, c int, n int")
    got, books = vector_codes.compress(odd, parts=4, entries=3, rounds=2)
    out = sorted(got.collect(), key=str)
    assert sorted(str(r.vec_id) for r in out) == ["1", "1", "6", "7", "None"] and books.shape == (4, 3, 2)
    assert len({r.label_error for r in out}) == 1 and out[0].label_error == sum(r.error for r in out)
    assert {r.code for r in out if r.vec_id == 1} == {"01000100"}  # an entry nothing was assigned to stayed, and is nearer in the end
    none, empty = vector_codes.compress(odd.limit(0))
    assert none.count() == 0 and empty.size == 0
    all_empty, _ = vector_codes.compress(odd.where("vec_id = 6"))
    assert [(r.code, r.error) for r in all_empty.collect()] == [("00000000", 0)]
    with pytest.raises(Exception, match="too large"):
        vector_codes.compress(spark.createDataFrame([(1, [1e30], 1)], "vec_id long, embedding array<float>, label int"))


def test_wide_numbers_stay_exact():
    rng = np.random.default_rng(3)
    x, book = rng.integers(-(1 << 24), 1 << 24, (50, 600)), rng.integers(-(1 << 24), 1 << 24, (9, 600))
    code, error = vector_codes.nearest(x, book)
    for i in range(50):
        far = [sum((int(a) - int(b)) ** 2 for a, b in zip(x[i], y, strict=True)) for y in book]
        assert (code[i], error[i]) == (far.index(min(far)), min(far))


def test_hot_keys_are_joined_where_they_stand(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    lookup = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), (F.max("k") * 2).alias("v")).where("k != 5")
    inner = joined_back(rows, lookup, ["k"], "n", 3000, most=100)
    assert inner.count() == 2999 and inner.where("v != 2 * k").count() == 0
    left = joined_back(rows, lookup, ["k"], "n", 3000, "left", most=100)
    assert left.count() == 3000 and [r.k for r in left.where("v IS NULL").collect()] == [5]


def plain_runs(s, least=2, times=2):
    out = {}
    for q in range(1, len(s) // times + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b, q) for (a, b), q in out.items())


def test_all_runs_against_brute_force():
    rng = random.Random(5)
    for _ in range(1500):
        s = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.5:
            unit = [rng.randrange(3) for _ in range(rng.randint(1, 9))]
            at = rng.randint(0, len(s))
            s[at:at] = (unit * 9)[: rng.randint(1, 50)]
        a, b, p = periodic_runs.runs_of(np.array([-1, *s, 99]))
        assert sorted(zip((a - 1).tolist(), (b - 1).tolist(), p.tolist(), strict=True)) == plain_runs(s)
    word = [0, 1]
    while len(word) < 2000:  # a text with as many runs as can be
        word = word + word[: len(word) * 2 // 3]
    a, b, p = periodic_runs.runs_of(np.array([-1, *word, 99]))
    assert sorted(zip((a - 1).tolist(), (b - 1).tolist(), p.tolist(), strict=True)) == plain_runs(word)


@pytest.mark.parametrize(("least", "times"), [(24, 3), (2, 2), (9, 3), (10, 4)])
def test_runs_of_documents_against_brute_force(spark, least, times, monkeypatch):
    rng, rows = random.Random(least), []
    for i in range(150):
        words = [rng.choice("abcde") for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            unit = [rng.choice("xyz") + str(rng.randint(0, 3)) for _ in range(rng.randint(1, 10))]
            at = rng.randint(0, len(words))
            words[at:at] = (unit * 12)[: rng.randint(1, 60)]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(words)))
    got = {r.doc_id: r for r in periodic_runs.periodic_runs(spark.createDataFrame(rows, "doc_id int, text string"), least, times).collect()}
    for i, text in rows:
        words = text.split()
        want = plain_runs(words, least, times)
        assert [(r.start, r.start + r.length, r.period) for r in got[i].runs] == want
        gone = {k for a, b, q in want for k in range(a + q, b)}
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        assert (got[i].collapsed_text, got[i].collapsed_sha256) == (kept, hashlib.sha256(kept.encode()).hexdigest())


def test_runs_in_small_chunks(monkeypatch):
    import pyarrow as pa

    from quirespark.llm import textkit as K

    texts = pa.array(["u " * 50, "a b c " * 30 + "x", " ".join("abc" * 10), None, "p q r s t v w x " * 400])
    whole = [x.tolist() for x in periodic_runs._located(K.words(texts), 24, 3)]
    monkeypatch.setattr(periodic_runs, "CHUNK", 40)
    assert [x.tolist() for x in periodic_runs._located(K.words(texts), 24, 3)] == whole
    assert whole == [[0, 1, 2, 4], [0, 0, 0, 0], [50, 90, 30, 3200], [1, 3, 3, 8]]


def test_runs_of_odd_rows(spark):
    long = "one two three four " * 30_000
    rows = [(1, "a " * 30), (1, "a " * 30), (2, None), (3, ""), (4, " \n "), (None, "b " * 24), (5, long), (6, "a " * 23)]
    odd = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, start int, runs string")
    out = periodic_runs.periodic_runs(odd)
    assert sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed_text) for r in out.collect()) == sorted([
        ("1", 30, [(0, 30, 1)], "a"), ("1", 30, [(0, 30, 1)], "a"), ("2", 0, [], ""), ("3", 0, [], ""), ("4", 0, [], ""), ("None", 24, [(0, 24, 1)], "b"),
        ("5", 120_000, [(0, 120_000, 4)], "one two three four"), ("6", 23, [], " ".join(["a"] * 23)),
    ])
    assert out.columns == ["doc_id", "n_words", "runs", "collapsed_text", "collapsed_sha256"] and periodic_runs.periodic_runs(odd.limit(0)).count() == 0


def test_archives_of_odd_pages(spark):
    inner = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n"
    same = "é" * 600
    rows = [(1, "http://a.example/x?y#z", "<p>one</p>"), (2, None, None), (3, "", ""), (4, "not an address\r\nX: y", inner * 40), (5, "http://b.example", same), (9, "http://c.example", same), (7, "http://d.example", same),
            (8, "u", "x" * 999), (10, "u", "x" * 999), (11, "u", "\r\n\r\n" * 300), (12, "u", "WARC/1." * 200), (13, "u", "w" * 3_000_000)]
    odd = spark.createDataFrame([(i, u, h, "k", "s", 1) for i, u, h in rows], "page_id long, url string, html string, key string, same string, stored int")
    path = new_path(spark, "odd-warc")
    warc.write_warc(warc.records_of(odd), path)
    records = warc.read_warc(spark, path)
    assert records.count() == 36
    got = {r.metadata[0].fields.get("page-id"): r for r in warc.captures(records).collect()}
    for i, url, html in rows:
        r, body = got[str(i)], (html or "").encode()
        want = "revisit" if i in (5, 7) else "response"
        assert r.response.type == want and r.response.payload_digest == hashlib.sha1(body).hexdigest()
        assert r.response.payload == (None if want == "revisit" else body) and r.request is not None
        assert r.response.refers_to == (got["9"].capture_id if want == "revisit" else None)
    assert got["1"].target_uri == "http://a.example/x?y#z" and got["2"].target_uri is None and "\n" not in got["4"].target_uri
    assert warc.records_of(odd.limit(0)).count() == 0
    again = odd.unionByName(odd.withColumn("page_id", F.lit(None).cast("long")).where("page_id IS NULL AND html = 'x'")).unionByName(odd.where("page_id = 9"))
    twice = new_path(spark, "twice-warc")
    warc.write_warc(warc.records_of(again), twice)
    kinds = warc.captures(warc.read_warc(spark, twice)).select("response.type").toPandas()["type"].value_counts().to_dict()
    assert kinds == {"response": 10, "revisit": 3}


def archive(spark, name, *records):
    """A gzip archive of one member for each record."""
    path = new_path(spark, name)
    local = path.removeprefix("file://")
    import os

    os.makedirs(local)
    with open(f"{local}/a.warc.gz", "wb") as f:
        for headers, block in records:
            head = "".join(f"{k}: {v}\r\n" for k, v in headers)
            f.write(gzip.compress(f"WARC/1.0\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"))
    return path


def test_transactions_of_other_archives(spark):
    body = b"4\r\nWiki\r\n5;x=1\r\npedia\r\n0\r\n\r\n"
    digest = base64.b32encode(hashlib.sha1(b"Wikipedia").digest()).decode()
    path = archive(
        spark, "other",
        ([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<i>")], b"software: x\r\n"),
        ([("WARC-Type", "response"), ("WARC-Record-ID", "<r>"), ("Content-Type", "application/http"), ("WARC-Concurrent-To", "<q>"), ("WARC-Payload-Digest", f"sha1:{digest}")], b"HTTP/1.1 404 No\r\nTransfer-Encoding: chunked\r\n\r\n" + body),
        ([("WARC-Type", "request"), ("WARC-Record-ID", "<q>"), ("Content-Type", "application/http")], b"GET / HTTP/1.1\r\n\r\n"),
        ([("WARC-Type", "metadata"), ("WARC-Record-ID", "<m>"), ("WARC-Concurrent-To", "<q>"), ("WARC-Concurrent-To", "<none>"), ("Content-Type", "application/warc-fields")], b"a: b\r\n c\r\n"),
        ([("WARC-Type", "metadata"), ("WARC-Record-ID", "<lost>"), ("WARC-Concurrent-To", "<none>")], b"no one's"),
        ([("WARC-Type", "resource"), ("WARC-Record-ID", "<s>")], b"\x00\xffWARC/1.bytes"),
    )
    rows = {r.capture_id: r for r in warc.captures(warc.read_warc(spark, path)).collect()}
    assert set(rows) == {"<r>", "<s>"} and bytes(rows["<r>"].response.payload) == b"Wikipedia" and rows["<r>"].response.status == 404
    assert rows["<r>"].request.record_id == "<q>" and [(m.record_id, m.fields) for m in rows["<r>"].metadata] == [("<m>", {"a": "b c"})]
    assert bytes(rows["<s>"].response.payload) == b"\x00\xffWARC/1.bytes" and rows["<s>"].request is None and rows["<s>"].metadata == []


def test_damaged_archives(spark):
    bad = archive(spark, "bad", ([("WARC-Type", "response"), ("WARC-Record-ID", "<r>"), ("WARC-Payload-Digest", "sha1:" + "0" * 40)], b"x"))
    with pytest.raises(Exception, match="damaged"):
        warc.read_warc(spark, bad).collect()
    short = new_path(spark, "short")
    import os

    os.makedirs(short.removeprefix("file://"))
    with open(short.removeprefix("file://") + "/a.warc", "wb") as f:
        f.write(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n")
    with pytest.raises(Exception, match="ends in its middle"):
        warc.read_warc(spark, short).collect()
