"""Queries on how far books are: customers stand for books, digits of their keys for what is known of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.operators import stages
from quirespark.plans.registry import query
from quirespark.shared import table

_FLAGS = {"one_narrator": 11, "names_checked": 3, "extras_set": 4, "extras_lost": 13, "queued": 17, "built": 2, "has_clips": 2, "fixes_newer": 10}
_COUNTS = {"new_roles": 5, "new_names": 6, "open_names": 4, "flagged": 7, "weak_names": 9}
_STAMPS = {"chapters": 7, "voices": 3, "speech": 4, "build": 6}


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    flags = [(F.pmod(k, F.lit(n)) == 0).alias(c) for c, n in _FLAGS.items()]
    counts = [F.pmod(k, F.lit(n)).alias(c) for c, n in _COUNTS.items()]
    stamps = [x for c, n in _STAMPS.items() for x in (F.lit("now").alias(c), F.when(F.pmod(k, F.lit(n)) == 1, None).when(F.pmod(k, F.lit(n)) == 2, "old").otherwise("now").alias(f"{c}_was"))]
    return table(spark, sf_dir, "customer").select("c_custkey", *flags, *counts, *stamps)


_SQL_BOOKS = "SELECT c_custkey, " + ", ".join([f"c_custkey % {n} = 0 AS {c}" for c, n in _FLAGS.items()] + [f"c_custkey % {n} AS {c}" for c, n in _COUNTS.items()] + [f"CASE c_custkey % {n} WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS {c}" for c, n in _STAMPS.items()]) + " FROM customer"  # 0 never, 1 old, 2 as now
_SQL_STATES = f"""
SELECT c_custkey, 0 AS pos, 'book' AS step, ['required', 'stale', 'done'][chapters + 1] AS state, NULL::VARCHAR AS blocked_by, NULL::VARCHAR AS cost FROM ({_SQL_BOOKS})
UNION ALL SELECT c_custkey, 1, 'voices', CASE WHEN chapters < 2 THEN 'optional' WHEN one_narrator OR voices = 2 THEN 'done' WHEN voices = 1 AND new_roles > 0 THEN 'stale' ELSE 'recommended' END, CASE WHEN chapters < 2 THEN 'book' END, NULL FROM ({_SQL_BOOKS})
UNION ALL SELECT c_custkey, 2, 'names', CASE WHEN chapters < 2 THEN 'optional' WHEN names_checked AND new_names > 0 THEN 'stale' WHEN names_checked OR open_names = 0 THEN 'done' ELSE 'recommended' END, CASE WHEN chapters < 2 THEN 'book' END, NULL FROM ({_SQL_BOOKS})
UNION ALL SELECT c_custkey, 3, 'extras', CASE WHEN chapters < 2 THEN 'optional' WHEN extras_lost THEN 'stale' WHEN extras_set THEN 'done' ELSE 'optional' END, CASE WHEN chapters < 2 THEN 'book' END, NULL FROM ({_SQL_BOOKS})
UNION ALL SELECT c_custkey, 4, 'make', m, CASE WHEN chapters < 2 THEN 'book' END, CASE WHEN m = 'stale' THEN ['unknown', 'speech', 'build'][speech + 1] END
 FROM (SELECT *, CASE WHEN chapters < 2 THEN 'required' WHEN queued THEN 'busy' WHEN NOT built THEN 'required' WHEN speech = 2 AND build = 2 THEN 'done' ELSE 'stale' END AS m FROM ({_SQL_BOOKS}))
UNION ALL SELECT c_custkey, 5, 'fix', f, CASE WHEN NOT has_clips THEN 'make' END, CASE WHEN f = 'stale' THEN 'build' END
 FROM (SELECT *, CASE WHEN NOT has_clips THEN 'optional' WHEN built AND fixes_newer THEN 'stale' WHEN flagged > 0 OR weak_names > 0 THEN 'recommended' ELSE 'optional' END AS f FROM ({_SQL_BOOKS}))
"""


@query(_SQL_STATES)
def stage_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.stage_states(_books(spark, sf_dir), "c_custkey")


@query(f"""
SELECT c_custkey, step, state FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY state = 'recommended', pos) AS r FROM ({_SQL_STATES}) WHERE state IN ('required', 'stale', 'recommended')) WHERE r = 1
""")
def next_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.next_step(stages.stage_states(_books(spark, sf_dir), "c_custkey"), "c_custkey")
