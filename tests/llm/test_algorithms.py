import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyframe.llm import consensus, neardup, qdigest, vec
from tallyframe.llm.components import components

# percentiles


@given(st.lists(st.floats(allow_nan=False, width=32), min_size=1, max_size=50))
def test_codes_keep_the_order_and_the_values(v):
    a = np.array(v, np.float32)
    c = qdigest.codes_of(a)
    assert (np.argsort(c, kind="stable") == np.argsort(a + np.float32(0), kind="stable")).all() and (qdigest.values_of(c) == a.astype(np.float64)).all()


def worst_rank(values, row, percents):
    """How far the values given are from their ranks, and the bound the row states."""
    s = np.sort(np.array(values, np.float32).astype(float))
    off = 0
    for p in percents:
        rank = max(1, -(-len(s) * p // 100))
        lo, hi = np.searchsorted(s, row[f"p{p}"], "left") + 1, np.searchsorted(s, row[f"p{p}"], "right")
        assert hi >= rank
        off = max(off, lo - rank)
    return off, row["max_rank_error"]


@pytest.mark.parametrize("fan_in,held", [(64, 1_000_000), (3, 4000), (1, 500)])
def test_rank_error_holds_after_merges(spark, monkeypatch, fan_in, held):
    monkeypatch.setattr(qdigest, "FAN_IN", fan_in)
    monkeypatch.setattr(qdigest, "HELD", held)
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.lognormal(7, 1, 30_000).astype(int), np.zeros(3000), np.full(9000, 1329), [10**9]]).astype(float)
    rows = spark.createDataFrame([("m", i % 40, float(x)) for i, x in enumerate(v)], "k string, day int, v double").repartition(7)
    error, percents = 0.2, [1, 50, 90, 99]
    days = qdigest.digest(rows, ["k", "day"], ["v"], error)
    assert days.count() < len(set(zip(v, np.arange(len(v)) % 40)))  # the days' digests are compressed
    whole = qdigest.merge(days, ["k"], error)
    assert whole.count() < 3 * 32 / error and whole.agg(F.sum("n")).first()[0] == len(v)
    off, bound = worst_rank(v, qdigest.percentiles(whole, ["k"], percents, error).first(), percents)
    assert off <= bound <= error * len(v)
    for r in qdigest.percentiles(days, ["k", "day"], percents, error).collect():
        off, bound = worst_rank(v[r["day"] :: 40], r, percents)
        assert off <= bound <= error * r["n"]


def test_production_error_on_data_beyond_k(spark):
    rows = spark.range(400_000, numPartitions=9).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("m"), F.col("id") % 7)).alias("k"), (F.col("id") % 31).alias("day"), F.exp(F.randn(5) * 2 + 6).alias("v"))
    days = qdigest.digest(rows, ["k", "day"], ["v"])
    got = qdigest.percentiles(qdigest.merge(days, ["k"]), ["k"], qdigest.PERCENTS).collect()
    values = {}
    for r in rows.collect():
        values.setdefault(r["k"], []).append(r["v"])
    errors = []
    for r in got:
        off, bound = worst_rank(values[r["k"]], r, qdigest.PERCENTS)
        assert off <= bound <= qdigest.ERROR * r["n"]
        errors.append(off)
    assert len(got) == len(values) == 8 and max(errors) > 0 and qdigest.merge(days, ["k"]).count() < len(values["hot"])


def test_digest_of_nulls_ties_and_nothing(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 1.0, 3), (None, None, 5), ("b", float("nan"), None), (None, -0.0, 5)], "k string, x double, n bigint")
    got = {(r["k"], r["metric"]): (r["n"], r["p50"]) for r in qdigest.percentiles(qdigest.digest(df, ["k"], ["x", "n"]), ["k"], [50]).collect()}
    assert got == {("a", "x"): (2, 1.0), ("a", "n"): (1, 3.0), (None, "n"): (2, 5.0), (None, "x"): (1, 0.0)}
    assert qdigest.percentiles(qdigest.digest(df.limit(0), ["k"], ["x"]), ["k"], [50]).count() == 0
    assert qdigest.percentiles(qdigest.digest(df.withColumnRenamed("n", "day"), ["k", "day"], ["x"]), ["k", "day"], [50]).count() == 3


# consensus


def edges(spark, n_items=300, seed=1):
    rng = random.Random(seed)
    truth = {i: rng.random() < 0.6 for i in range(n_items)}
    skill = {**{f"good{k}": 0.93 for k in range(6)}, **{f"coin{k}": 0.5 for k in range(4)}, "liar0": 0.15, "liar1": 0.15}
    rows = [(str(i), w, float(truth[i] if rng.random() < skill[w] else not truth[i])) for i in truth for w in rng.sample(sorted(skill), 5)]
    return spark.createDataFrame(rows, "item string, annotator string, y double"), truth


def test_consensus_beats_the_majority_and_finds_liars(spark):
    df, truth = edges(spark)
    items, annotators = consensus.consensus(df)
    got = {int(r["item"]): r["belief"] > 0.5 for r in items.collect()}
    votes = {int(r["item"]): r["m"] for r in df.groupBy("item").agg(F.avg("y").alias("m")).collect()}
    right = sum(got[i] == truth[i] for i in truth)
    plain = sum((votes[i] > 0.5) == truth[i] for i in truth)
    assert right >= 0.9 * len(truth) and right > plain + 10
    rel = {r["annotator"]: r["reliability"] for r in annotators.collect()}
    assert max(rel["liar0"], rel["liar1"]) < 0.35 and min(rel[f"good{k}"] for k in range(6)) > 0.75 and all(0.3 < rel[f"coin{k}"] < 0.7 for k in range(4))


def test_consensus_goes_on_to_the_fixpoint(spark):
    df, _ = edges(spark, 120, 5)
    rows = [(r["item"], r["annotator"], r["y"]) for r in df.collect()]
    items = sorted({r[0] for r in rows})
    who = sorted({r[1] for r in rows})
    it, an, y = np.array([items.index(r[0]) for r in rows]), np.array([who.index(r[1]) for r in rows]), np.array([r[2] for r in rows])
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    m = sigmoid((2 * (np.bincount(it, y)[it] - y) - (np.bincount(it)[it] - 1)) * np.log(4.0))
    for _ in range(500):
        p1, h1, p0, h0 = (np.bincount(an, w) for w in (m, m * y, 1 - m, (1 - m) * y))
        a0, b0, share = (h1.sum() + 0.8) / (p1.sum() + 1), (h0.sum() + 0.2) / (p0.sum() + 1), (p1.sum() + 1) / (p1.sum() + p0.sum() + 2)
        a = np.clip((h1[an] - m * y + consensus.PRIOR * a0) / (p1[an] - m + consensus.PRIOR), 0.01, 0.99)
        b = np.clip((h0[an] - (1 - m) * y + consensus.PRIOR * b0) / (p0[an] - (1 - m) + consensus.PRIOR), 0.01, 0.99)
        e = y * np.log(a / b) + (1 - y) * np.log((1 - a) / (1 - b))
        t = np.bincount(it, e) + np.log(share / (1 - share))
        m = sigmoid(t[it] - e)
    got = {r["item"]: r["belief"] for r in consensus.consensus(df)[0].collect()}
    assert max(abs(got[i] - p) for i, p in zip(items, sigmoid(t))) < 1e-4
    with pytest.raises(RuntimeError):
        consensus.consensus(df, rounds=2)


def test_edges_are_read_forgivingly(spark):
    rows = [("1", "e", " Ann ", "PASS"), ("1", "e", " Ann ", "PASS"), ("2", "e", "ann", "fail "), ("3", "e", "BOB", "Pass"), ("4", "e", "bob", None), ("5", None, "bob", "PASS"), ("6", "e", "", "PASS"), ("7", "e", "cy", "maybe"), ("8", "e", None, "PASS")]
    df = spark.createDataFrame(rows, "id string, item string, who string, verdict string").withColumn("y", F.lit(9)).withColumn("annotator", F.lit("clash"))
    got = {(r["item"], r["annotator"]): (r["y"], r["readable"]) for r in consensus.edges_of(df, "id", "item", "who", "verdict", "PASS", "FAIL").collect()}
    assert got == {("e", "ann"): (0.5, True), ("e", "bob"): (1.0, True)}


def test_a_score_stands_in_for_a_missing_label(spark):
    rows = [(str(i), f"e{i}", "ann", "PASS" if i % 4 else "FAIL", 0.62) for i in range(40)] + [("a", "x", "ann", None, 62.0), ("b", "x", "bob", "maybe", 0.64), ("c", "y", "ann", None, None), ("d", "z", "ann", None, 0.11), ("e", "x", "cy", "FAIL", 0.62), ("f", "x", "cy", None, 0.62), ("g", "z", "bob", None, -3.0), ("h", "z", "bob", None, float("nan"))]
    df = spark.createDataFrame(rows, "id string, item string, who string, verdict string, score double")
    got = {(r["item"], r["annotator"]): (round(r["y"], 6), r["readable"]) for r in consensus.edges_of(df, "id", "item", "who", "verdict", "PASS", "FAIL", "score").where("item in ('x', 'y', 'z')").collect()}
    assert got == {("x", "ann"): (round(30 / 41, 6), False), ("x", "bob"): (round(30 / 41, 6), False), ("x", "cy"): (0.0, True)}


def test_several_classes_one_against_the_rest(spark, monkeypatch):
    monkeypatch.setattr(consensus, "SALTS", 3)
    rng, classes = random.Random(8), ["red", "green", "blue"]
    truth = {str(i): rng.choice(classes) for i in range(120)}
    skill = {f"good{k}": 0.9 for k in range(5)} | {f"poor{k}": 0.4 for k in range(4)}
    rows = [(i, w, truth[i] if rng.random() < skill[w] else rng.choice(classes)) for i in truth for w in rng.sample(sorted(skill), 5)]
    df = spark.createDataFrame([*rows, ("0", "good0", None), ("none", "good0", None), ("odd", "good0", "pink")], "item string, annotator string, label string")
    items, people = consensus.consensus_classes(df, classes)
    got = {r["item"]: (r["label"], r["belief"]) for r in items.collect()}
    majority = sum(max(classes, key=lambda c: sum(x == c for j, _, x in rows if j == i)) == truth[i] for i in truth)
    right = sum(got[i][0] == truth[i] for i in truth)
    assert set(got) == set(truth) and right >= majority and right >= 0.9 * len(truth) and all(1 / 3 <= b <= 1 for _, b in got.values())
    rel = {(r["annotator"], r["class"]): r["reliability"] for r in people.collect()}
    assert len(rel) == 27 and min(rel[f"good{k}", c] for k in range(5) for c in classes) > max(rel[f"poor{k}", c] for k in range(4) for c in classes)
    two = df.where("try_cast(item as int) < 30").withColumn("label", F.when(F.col("label") == "red", "red").when(F.col("label").isNotNull(), "rest"))
    items, people = consensus.consensus_classes(two, ["red", "rest"])
    assert {r["label"] for r in items.collect()} == {"red", "rest"} and {r["class"] for r in people.collect()} == {"red", "rest"}


def test_consensus_of_few_and_none(spark):
    one = spark.createDataFrame([("a", "x", 1.0)], "item string, annotator string, y double")
    items, annotators = consensus.consensus(one)
    r = items.first()
    assert r["belief"] > 0.5 and r["agreement"] is None and annotators.count() == 1
    items, annotators = consensus.consensus(one.limit(0))
    assert items.count() == 0 and annotators.count() == 0
    none = consensus.agreement(one.limit(0)).first()
    assert none["items"] == 0 and none["alpha"] is None
    split = consensus.consensus(spark.createDataFrame([("a", "x", 1.0), ("a", "y", 0.0)], "item string, annotator string, y double"))[0].first()
    assert split["agreement"] == 0.0


# near duplicates


def texts(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 40))]
        out.append(base)
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            copy = [w for w in base if rng.random() > 0.1] + [rng.choice(vocabulary) for _ in range(rng.randrange(4))]
            rng.shuffle(copy)
            out.append(copy)
    return [" ".join(t) for t in out]


def brute(rows, threshold=0.7):
    bags = {i: Counter(t.lower().split()) for i, t in rows}
    out = set()
    for a in bags:
        for b in bags:
            if a < b and bags[a] and bags[b]:
                both = sum((bags[a] & bags[b]).values())
                if both / (sum(bags[a].values()) + sum(bags[b].values()) - both) >= threshold - 1e-12:
                    out.add((a, b))
    return out


@pytest.mark.parametrize("seed,block,group,split", [(1, 3000, 8, 8), (2, 5, 2, 8), (3, 9, 4, 1), (4, 2, 3, 1)])
def test_pairs_are_those_of_brute_force(spark, monkeypatch, seed, block, group, split):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "SPLIT", split)
    monkeypatch.setattr(neardup, "MEMBERS", block)
    monkeypatch.setattr(neardup, "GROUP", group)
    rows = [(f"id{i:04d}", t) for i, t in enumerate(texts(seed, 60))]
    df = spark.createDataFrame([(i, t, None, 1, 2) for i, t in rows], "id string, prompt string, reference string, n int, rep int")
    members, links = neardup.similar_classes(df, "id", ["prompt", "reference"])
    got = [tuple(r) for r in neardup.all_pairs(members, links).collect()]
    want = brute(rows)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    per = {r["id"]: r["links"] for r in neardup.groups(df, "id", members, links).collect()}
    assert per == {i: sum(i in p for p in want) for i, _ in rows}


def meetings(monkeypatch, records, few, block, most):
    """Pairs of records that meet, and how many times two are compared, without Spark."""
    compared, bits = [0], np.bitwise_count

    def count(x):
        compared[0] += len(x)
        return bits(x)

    with monkeypatch.context() as m:
        m.setattr(neardup, "FEW", few)
        m.setattr(np, "bitwise_count", count)  # once for every comparison
        els, n = pa.array([sorted(r) for r in records], pa.list_(pa.int64())), [len(r) for r in records]
        part = pa.RecordBatch.from_arrays([pa.array(range(len(n)), pa.int64()), pa.array(n, pa.int32()), els], ["k", "n", "els"])
        sizes = neardup._classes_of_size(neardup.GROUP, max(n), 0.7)
        counts = [(np.full(neardup.COUNTERS, len(n), np.int32), np.ones(neardup.COUNTERS, np.int32))] * neardup.SHARE
        got = set()
        blobs = neardup._blobs(part, sizes, 0.7, counts, most, block, 3)
        for batch in neardup._shards(iter([blobs]), 0.7):
            got |= set(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()))
    return got, compared[0]


@pytest.mark.parametrize("few,block,most", [(12, 10_000, 10**6), (0, 10_000, 10**6), (0, 30, 10), (3, 10_000, 10)])
def test_similar_records_meet_at_every_depth_and_size(monkeypatch, few, block, most):
    rng = np.random.default_rng(few + block)
    records, words = [], vec.scramble(np.arange(1, 900, dtype=np.uint64)).view(np.int64)
    for size in [1, 2, 3, 4, 6, 9, 14, 19, 24, 40, 90, 170, 400] * 6:
        base = rng.choice(words, size, replace=False)
        for lost in (0, 0.1, 0.17, 0.3):
            records.append(set(base[rng.random(size) >= lost]) | set(rng.choice(words, int(size * rng.choice([0, 0.05, 0.15])))) or {words[0]})
    got, _ = meetings(monkeypatch, records, few, block, most)
    want = {(a, b) for b in range(len(records)) for a in range(b) if records[a] != records[b] and len(records[a] & records[b]) >= 0.7 * len(records[a] | records[b]) - 1e-9}
    assert len(want) > 100 and want <= {tuple(sorted(x)) for x in got}


def test_comparisons_grow_with_the_records_where_the_vocabulary_does_not(monkeypatch):
    def compared(number):
        rng = np.random.default_rng(number)
        words = vec.scramble(np.arange(1, 2000, dtype=np.uint64)).view(np.int64)
        return meetings(monkeypatch, [set(rng.choice(words, 100, replace=False)) for _ in range(number)], 12, 10_000, 10**6)[1]

    few, many = compared(3000), compared(12_000)
    assert many < 8 * few  # 16 times as many if all that share an element were compared


def test_hot_copies_nulls_and_repeated_rows(spark):
    rows = [(f"{i:03d}", "the same text " + ("x" if i % 2 else "y") + " again and again and again", None) for i in range(40)]
    rows += [("900", None, None), ("901", "", "..."), ("902", "Ünïque wörds", "hier"), ("902", "Ünïque wörds", "hier"), ("903", "hier ünïque", "WÖRDS")]
    df = spark.createDataFrame(rows, "id string, a string, b string")
    members, links = neardup.similar_classes(df, "id", ["a", "b"])
    got = {tuple(r) for r in neardup.all_pairs(members, links).collect()}
    assert len(got) == 40 * 39 // 2 + 1 and ("902", "903") in got
    g = {r["id"]: (r["group_id"], r["links"]) for r in neardup.groups(df, "id", members, links).collect()}
    assert len(g) == 44 and g["900"] == ("900", 0) and g["901"] == ("901", 0) and g["039"] == ("000", 39)
    members, links = neardup.similar_classes(df.limit(0), "id", ["a", "b"])
    assert neardup.all_pairs(members, links).count() == 0 and neardup.groups(df.limit(0), "id", members, links).count() == 0


def test_components_of_paths_and_cliques(spark):
    e = [(i, i + 1) for i in range(100, 160)] + [(1, 2), (2, 3), (7, 9)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(e, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and got[3] == 1 and got[9] == 7
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# the primitives


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB1 _-é漢½İ\n", max_size=20)), max_size=8))
def test_words_are_runs_of_letters_and_digits_within_a_text(values):
    cp, off = vec.decode(*vec.utf8(pa.array(values, pa.string())))
    b, e = vec.words(cp, off)
    got = ["".join(map(chr, cp[x:y])) for x, y in zip(b, e)]
    want = []
    for t in values:
        word = ""
        for ch in (t or "") + " ":
            if ch.isalnum():
                word += ch
            elif word:
                want.append(word)
                word = ""
    assert got == want


def test_window_minimum_and_slices():
    v = np.random.default_rng(1).integers(0, 100, 50)
    for w in (1, 2, 5, 8, 33):
        assert (vec.window_min(v, w) == [v[i : i + w].min() for i in range(50 - w + 1)]).all()
    batch = pa.record_batch([pa.array(["x" * 10, None, "y" * 500, "", "z"])], ["text"]).slice(1)
    parts = list(vec.slices(batch, "text", 100))
    assert [r for p in parts for r in p.column(0).to_pylist()] == [None, "y" * 500, "", "z"] and math.prod(p.num_rows for p in parts) >= 1
