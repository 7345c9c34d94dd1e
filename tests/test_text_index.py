"""Substring search through grams, and many keywords in one walk."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lotlens.functions import predicates as P
from lotlens.operators import text_index as X


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rng = random.Random(3)
    words = ["Toyota", "Camry", "ŠKODA", "100%", "x_y", "the", "Львів", "a", "ß", ""]
    rows = [(i, rng.choice([" ".join(rng.choices(words, k=rng.randrange(1, 5))), None, ""]), f"unique{i:04d}" if i % 3 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, title string, code string")
    path = str(tmp_path_factory.mktemp("index") / "t")
    X.write_text_index(df, ["title", "code"], path, "id", blocks=32)
    return df, path


@pytest.mark.parametrize("text", ["toy", "CAMRY", "škoda", "to%ta", "o_ot", "y the", "львів", "%", "_", "a", "00%", "x_y", "nothing here", "unique0007", "UNIQUE%7", "", "\\"])
def test_the_rows_of_the_predicate(spark, indexed, text):
    df, path = indexed
    for columns in (["title"], ["title", "code"]):
        want = {r[0] for r in (df.where(P.any_contains(columns, text)) if text else df).select("id").collect()}
        assert {r[0] for r in X.search_text(spark, path, columns, text).select("id").collect()} == want


def test_blocks_that_are_read(spark, indexed):
    _, path = indexed
    opened = lambda text: {f.split("__block=")[1].split("/")[0] for f in X.search_text(spark, path, ["title", "code"], text).inputFiles()}
    blocks = X.candidate_blocks(spark, path, ["title", "code"], "unique0007")
    assert len(blocks) == 1 and X.candidate_blocks(spark, path, ["title"], "unique0007") == [] and X.candidate_blocks(spark, path, ["title"], "a%b") is None
    plan = X.search_text(spark, path, ["title", "code"], "unique0007")._jdf.queryExecution().executedPlan().toString()
    assert f"__block#" in plan and f"= {blocks[0]})" in plan.split("PartitionFilters")[1].split("]")[0] + "]"
    assert len(opened("a")) == 32
    postings = spark.read.parquet(f"{path}/grams")
    assert postings.count() == postings.distinct().count() and postings.groupBy("gram", "col").count().agg(F.max("count")).first()[0] <= 32


@pytest.mark.parametrize("limit", [7, 200_000])
def test_keywords_in_one_walk(spark, limit):
    rng = random.Random(limit)
    text = lambda n: "".join(rng.choices("abcäÄ中 ", k=n))
    texts, words = [text(rng.randrange(200)) for _ in range(150)] + [None, ""], sorted({text(rng.randrange(1, 4)) for _ in range(40)})
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "id int, text string, hits int")
    keys = spark.createDataFrame([(w,) for w in [*words, *words, None, ""]], "keyword string")
    got = {r["id"]: r["hits"] for r in X.keyword_hits(df, "text", keys, limit=limit).collect()}
    assert got == {i: [w for w in words if w in (t or "").lower()] for i, t in enumerate(texts)} and any(len(v) > 5 for v in got.values())
    assert X.keyword_hits(df, "text", keys.limit(0)).where(F.size("hits") > 0).count() == 0 and X.keyword_hits(df.limit(0), "text", keys).count() == 0


def test_grams_once_and_none_over_seams(monkeypatch):
    monkeypatch.setattr(X, "LETTERS", 5)
    rng = random.Random(5)
    texts = ["".join(rng.choices("ab中🚗 é", k=rng.randrange(9))) for _ in range(80)]
    want = {t[i : i + X.GRAM] for t in texts for i in range(len(t) - X.GRAM + 1)}
    got = X.distinct_grams(texts)
    assert set(got) == want and len(got) == len(want) and X.distinct_grams(["ab", ""]) == [] and X.distinct_grams(["a🚗b"]) == ["a🚗b"]
    assert {g for some in X._pieces(pa.array([*texts, None])) for g in X.distinct_grams(some)} == want and max(len(t) for some in X._pieces(pa.array(texts)) for t in some) == 7


def test_long_texts_take_time_in_proportion(spark, tmp_path):
    """A text of a million letters, without what the pattern ends with: by places it takes hours, as does trying all places of the first stretch."""
    df = spark.createDataFrame([(1, "th🚗 " * 250_000 + "x", "s"), (2, "a th\nat TION!", None), (3, "ta th tion", "the\\Eotions")], "id long, text string, code string")
    X.write_text_index(df, ["text", "code"], str(tmp_path / "t"), "id", blocks=2)
    found = lambda text: sorted(r[0] for r in X.search_text(spark, str(tmp_path / "t"), ["text", "code"], text).select("id").collect())
    assert found("th%tion_") == [2, 3] and found("th_t") == [3] and found("th% x") == [1] and found("e\\E_t") == [3] and found("h🚗_t") == [1] and found("%%_") == [1, 2, 3]
    assert found("t%h%🚗%th%q") == []
