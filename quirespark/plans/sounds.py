"""Queries on sounds, angles and sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.operators import sounds
from quirespark.plans.registry import query
from quirespark.shared import table


@query("SELECT * FROM (VALUES ('42° 15′ N. lat. and 1° E.', 'forty-two degrees fifteen minutes north latitude and one degree east'), ('It was 98.6° F. The N.N.E. wind', 'It was ninety-eight point six degrees Fahrenheit. The north-north-east wind'), ('no angles', 'no angles')) AS t(text, spoken)")
def angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("42° 15′ N. lat. and 1° E.",), ("It was 98.6° F. The N.N.E. wind",), ("no angles",)]
    return spark.createDataFrame(rows, "text string").select("text", sounds.angles("text").alias("spoken"))


@query("SELECT * FROM (VALUES ('hˈædæd', 'Haddad'), ('əbˈaɪ', 'Aby'), ('kˈɑɹə', 'Karuh')) AS t(ipa, spelt)")
def plain_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([("hˈædæd",), ("əbˈaɪ",), ("kˈɑɹə",)], "ipa string").select("ipa", sounds.spelling("ipa").alias("spelt"))


@query("SELECT * FROM (VALUES ('x a n a y', 'a n a', 0.0::DOUBLE), ('a n iː', 'a n i', 0.1::DOUBLE), ('a n ɪ', 'a n i', 0.166667::DOUBLE), ('', 'a', 1.0::DOUBLE)) AS t(heard, target, distance)")
def sound_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("x a n a y", "a n a"), ("a n iː", "a n i"), ("a n ɪ", "a n i"), ("", "a")]
    return spark.createDataFrame(rows, "heard string, target string").select("heard", "target", F.round(sounds.distance("heard", "target"), 6).alias("distance"))


@query("SELECT * FROM (VALUES ('Ana', 'ana,ahnah,ahnuh,anah,anuh')) AS t(word, spellings)")
def spelling_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    make = sounds.candidates({"a": ["ah", "a"], "ə": ["ah", "uh"]})
    return spark.createDataFrame([("Ana", "anə")], "word string, ipa string").select("word", F.array_join(make("ipa", "word"), ",").alias("spellings"))


@query("SELECT * FROM (VALUES (1, 1.0::DOUBLE), (2, NULL)) AS t(id, score)")
def heard_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, "Then Mary’s lamb", "Mary", "mɛri", "ð ɛ n m ɛ r i z l æ m"), (2, "Then she", "Mary", "mɛri", "ð ɛ n")]
    return spark.createDataFrame(rows, "id int, text string, name string, ipa string, heard string").select("id", sounds.heard_name("text", "name", "ipa", "heard").alias("score"))


@query("SELECT o_orderkey, CASE WHEN k >= 24 THEN k ELSE 0 END AS kbps FROM (SELECT o_orderkey, least(256, floor(76800 / o_totalprice)::INTEGER) AS k FROM (SELECT o_orderkey, o_totalprice / 20 AS o_totalprice FROM orders))")
def bitrates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(sounds.bitrate(F.col("o_totalprice") / 20, 10_000_000), F.lit(0)).alias("kbps"))
