import json
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyframe.functions import hashing, stats, strictjson, text

values = st.recursive(st.none() | st.booleans() | st.integers(-(2**53), 2**53) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=8), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=5), x, max_size=4), max_leaves=12)


@given(values)
def test_canonical_json_is_one_text_of_a_value(v):
    t = hashing.canonical_json(v)
    assert t.isascii() and hashing.canonical_json(json.loads(t)) == t


@given(values)
def test_strict_json_reads_what_was_written(v):
    assert strictjson.loads(json.dumps(v)) == v


@pytest.mark.parametrize("bad", ['{"a":1,"a":2}', "NaN", "[Infinity]", "1e999", "{} x", "", "[" * 5000])
def test_strict_json_refuses(bad):
    with pytest.raises(ValueError):
        strictjson.loads(bad)


def test_hash_tells_null_from_empty_and_int_from_float():
    base = {"prompt": "p", "tags": ["b", "a"], "output": None}
    assert hashing.content_hash(base) != hashing.content_hash({**base, "output": ""})
    assert hashing.content_hash(base) == hashing.content_hash({**base, "tags": ["a", "b"]})
    assert hashing.content_hash({**base, "retrieved": ["x", "y"]}) != hashing.content_hash({**base, "retrieved": ["y", "x"]})
    assert hashing.stable_hash("d", 1) != hashing.stable_hash("d", 1.0)
    assert hashing.input_hash(base) == hashing.input_hash({**base, "output": "other"})


def test_case_hashes_in_spark_are_those_of_python(spark):
    case = {"case_key": "a", "prompt": "é", "output": None, "reference": "r", "context": None, "retrieved": ["d1"], "relevance": {"d1": 2}, "metadata": '{"b": 1, "a": [1.5]}', "tags": ["t"]}
    df = spark.createDataFrame([tuple(case.values())], "case_key string, prompt string, output string, reference string, context string, retrieved array<string>, relevance map<string,int>, metadata string, tags array<string>")
    r = hashing.with_case_hashes(df).first()
    assert (r["content_hash"], r["input_hash"]) == (hashing.content_hash(case), hashing.input_hash(case))


def test_seeded_order_is_that_of_python(spark):
    import hashlib

    got = {r["k"]: r["o"] for r in spark.createDataFrame([(f"k{i}",) for i in range(50)], "k string").select("k", hashing.seeded_order(3, F.col("k")).alias("o")).collect()}
    assert got == {k: int.from_bytes(hashlib.sha256(f"3\0{k}".encode()).digest()[:8], "big") >> 1 for k in got}


@pytest.mark.parametrize(
    "schema,good,bad",
    [
        ({"type": "integer", "minimum": 0}, [0, 3, 2.0], [-1, 1.5, True, "1"]),
        ({"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "string", "minLength": 2}}}, [{"a": "xy"}], [{}, {"a": "x"}, {"a": "xy", "b": 1}, []]),
        ({"oneOf": [{"type": "integer"}, {"minimum": 2, "type": "number"}]}, [1, 2.5], [3, "x"]),
        ({"$ref": "#/$defs/n", "$defs": {"n": {"enum": [1, "a", None]}}}, [1, "a", None], [True, 2]),
        ({"type": "array", "items": {"type": "string"}, "uniqueItems": True, "maxItems": 2}, [[], ["a", "b"]], [["a", "a"], [1], ["a", "b", "c"]]),
        ({"not": {"type": "null"}}, [1], [None]),
    ],
)
def test_schema_subset(schema, good, bad):
    strictjson.check_schema(schema)
    assert all(not strictjson.errors(v, schema) for v in good) and all(strictjson.errors(v, schema) for v in bad)


def test_schema_refuses_remote_references_and_unknown_keywords():
    for s in ({"$ref": "http://x/y"}, {"format": "email"}):
        with pytest.raises(ValueError):
            strictjson.check_schema(s)


def test_normalization_order_and_unicode(spark):
    df = spark.createDataFrame([("ﬁ  Straße  ", "fi strasse"), ("ＡＢ", "ab"), (" a\t b", "a b"), (None, None)], "a string, b string")
    got = df.select(text.normalize(F.col("a"), list(text.STEPS)).alias("x"), "b").collect()
    assert all(r["x"] == r["b"] for r in got)


def test_first_difference(spark):
    df = spark.createDataFrame([("abc", "abd"), ("ab", "abc"), ("", "x"), ("x", "x"), ("y" * 5000 + "a", "y" * 5000 + "b")], "a string, b string")
    assert [r[0] for r in df.select(text.first_difference(F.col("a"), F.col("b"))).collect()] == [2, 2, 0, None, 5000]


def test_cutting_texts(spark):
    df = spark.createDataFrame([("aé漢",)], "t string")
    r = df.select(text.clip(F.col("t"), 2).alias("c"), text.truncate_utf8(F.col("t"), 4).alias("u"), text.truncate_utf8(F.col("t"), 99).alias("w")).first()
    assert tuple(r) == ("a…", "aé", "aé漢")


def test_wilson_and_normal(spark):
    df = spark.createDataFrame([(5, 10), (0, 0), (10, 10), (0, 5)], "k int, n int")
    low, high = stats.wilson(F.col("k"), F.col("n"))
    got = [tuple(r) for r in df.select(F.round(low, 5), F.round(high, 5)).collect()]
    assert got[0] == (0.23659, 0.76341) and got[1] == (0.0, 1.0) and got[2][1] == 1.0 and got[3][0] == 0.0


def test_spearman_with_ties_and_without_variance(spark):
    rows = [("a", 1, 1), ("a", 2, 2), ("a", 2, 3), ("a", 3, 4), ("b", 1, 1), ("b", 1, 2), ("b", 1, 3), ("c", 1, 1)]
    got = {r["g"]: r["rho"] for r in stats.spearman(spark.createDataFrame(rows, "g string, x int, y int"), ["g"], "x", "y").collect()}
    assert got["a"] == pytest.approx(4.5 / math.sqrt(4.5 * 5)) and got["b"] is None and got["c"] is None


def test_mcnemar_against_binomial(spark):
    df = spark.createDataFrame([(0, 0), (3, 3), (1, 9), (0, 20)], "b int, c int")
    p = [r[0] for r in df.select(stats.mcnemar_exact(F.col("b"), F.col("c"))).collect()]
    exact = lambda b, c: min(1.0, 2 * sum(math.comb(b + c, i) for i in range(min(b, c) + 1)) / 2 ** (b + c)) if b + c else 1.0
    assert p == pytest.approx([exact(0, 0), exact(3, 3), exact(1, 9), exact(0, 20)])


def test_kappa(spark):
    df = spark.createDataFrame([("P", "P")] * 20 + [("P", "F")] * 5 + [("F", "P")] * 10 + [("F", "F")] * 15, "a string, b string")
    r = stats.kappa(df, [], "a", "b").first()
    assert (r["n"], r["agreed"]) == (50, 35) and r["kappa"] == pytest.approx(0.4)
    assert stats.kappa(df.where("a = 'P' and b = 'P'"), [], "a", "b").first()["kappa"] is None


def test_bootstrap_does_not_depend_on_order():
    rng = random.Random(1)
    v = [rng.random() for _ in range(50)]
    low, high = stats.bootstrap_interval(v, 7)
    assert (low, high) == stats.bootstrap_interval(v[::-1], 7) and low < sum(v) / 50 < high


@settings(max_examples=20, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=2, max_size=30))
def test_bootstrap_stays_within_the_values(v):
    low, high = stats.bootstrap_interval(v, 1, resamples=200)
    assert min(v) - 1e-9 <= low <= high <= max(v) + 1e-9
