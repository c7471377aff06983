"""Operators that hold at size: what is shuffled, and what is learnt from."""

import numpy as np

from quirespark.llm import embedding_dedup, toxicity


def test_pairs_of_blocks_are_not_shuffled(spark, monkeypatch):
    plans, freeze = {}, embedding_dedup.freeze

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return freeze(df, name)

    monkeypatch.setattr(embedding_dedup, "freeze", seen)
    x = np.random.default_rng(3).normal(size=(80, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert embedding_dedup.near_duplicate_vectors(rows, block_rows=8).count() == 80
    assert "hashpartitioning" not in plans["links"] and "MapInArrow" in plans["links"]


def test_toxicity_learns_from_all_labels(spark, monkeypatch):
    """Every labelled text outside fold 0 is counted, and no row of one is brought to the driver."""
    frame, brought = type(spark.range(0)), []
    to_arrow, limit = frame.toArrow, frame.limit
    monkeypatch.setattr(frame, "toArrow", lambda self: (brought.append(t := to_arrow(self)), t)[1])
    monkeypatch.setattr(frame, "limit", lambda self, n: (_ for _ in ()).throw(AssertionError("a sample")) if n > 100 else limit(self, n))
    docs = spark.createDataFrame([(i, f"w{i % 97} {'vile' if i % 3 == 0 else 'kind'} w{i % 89}") for i in range(900)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 3 = 0 as int) AS toxic")
    got = toxicity.score_toxicity(docs, labels).collect()
    assert all(r.predicted == (r.doc_id % 3 == 0) for r in got) and len(got) == 900
    assert max(t.num_rows for t in brought) <= 30


def test_toxicity_counts_pairs_part_by_part(spark, monkeypatch):
    """Contexts of a part are shuffled without the texts, no pair is in two parts, and nothing stays written."""
    tables, plans, freeze = [], [], toxicity.freeze

    def seen(df, name):
        back = freeze(df, name)
        if name == "pairs":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            tables.append([(r.word, r.before) for r in back.collect()])
        return back

    monkeypatch.setattr(toxicity, "freeze", seen)
    docs = spark.createDataFrame([(i, f"w{i % 97} {'vile' if i % 3 == 0 else 'kind'} w{i % 89}") for i in range(300)], "doc_id long, text string")
    toxicity.fit(docs, docs.selectExpr("doc_id", "cast(doc_id % 3 = 0 as int) AS toxic"))
    assert len(tables) > 1 and not any("Join" in p for p in plans)
    assert len(set(sum(tables, []))) == sum(map(len, tables)) > 0
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
