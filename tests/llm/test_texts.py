import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyframe.llm import cutoff, leakage, pairs, personal, spans, tokenize
from tallyframe.llm.fmindex import FMIndex
from tallyframe.llm.langid import language

# tokens


@pytest.fixture(scope="module")
def coder():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(tokenize.vocabulary_path())
    t.encode_special_tokens = True
    return t, tokenize.Encoder(tokenize.load_vocabulary(tokenize.vocabulary_path()))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30), st.text(alphabet="a'sStlve \n\t 1é漢<|>", max_size=30)), max_size=6))
def test_ids_are_those_of_the_library(coder, values):
    t, e = coder
    assert e.encode(pa.array(values, pa.string())).to_pylist() == [x.ids for x in t.encode_batch([v or "" for v in values], add_special_tokens=False)]


def test_round_trip_of_odd_texts(spark, coder):
    odd = ["", None, "<|endoftext|>", "a" * 5000, "  \n\n\t x", "it's 'S we'll", "​﻿\x00é", "漢字かな交じり文" * 50, "x" * 70 + " " + "y" * 70]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(odd)], "doc_id bigint, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in tokenize.encode_texts(df, "doc_id", "text").collect()}
    assert got[0] == [] and got[1] == [] and all(coder[0].decode(got[i]) == (t or "") for i, t in enumerate(odd)) and 50256 not in got[2]
    assert tokenize.encode_texts(df.limit(0), "doc_id", "text").count() == 0


def test_cache_is_bounded_and_harmless(monkeypatch, coder):
    monkeypatch.setattr(tokenize, "CACHE_WORDS", 5)
    e = tokenize.Encoder(tokenize.load_vocabulary(tokenize.vocabulary_path()))
    for t in ("one two three four", "five six seven one", "one two nine"):
        assert e.encode(pa.array([t])).to_pylist() == [coder[0].encode(t, add_special_tokens=False).ids]


# leaks


def test_leaks_whole_partial_and_across_punctuation(spark):
    item = "Suppose that fifty two scores arrive while every cold manifest sits idle and its reviewer reads a book."
    w = item.split()
    docs = [(1, item), (2, "Before. " + " -- ".join(w[3:15]).upper() + " after"), (3, " ".join(w[:11])), (4, None), (5, ""), (6, item + " mid " + item), (7, " ".join(w[:6]) + " X " + " ".join(w[6:]))]
    items = spark.createDataFrame([(10, item, None), (11, "too short", item[:30])], "item_id bigint, prompt string, reference string")
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    p = leakage.find_passages(df, "doc_id", "text", items, "item_id", ["prompt", "reference"])
    got = {}
    for r in p.collect():
        got.setdefault(r["doc_id"], []).append((r["item_id"], r["start_pos"], r["end_pos"]))
    assert set(got) == {1, 2, 6, 7} and len(got[6]) == 2 and got[1] == [(10, 0, len(item) - 1)]
    clean = {r["doc_id"]: (r["clean_text"], r["dropped"]) for r in leakage.clean_documents(df, p, "doc_id", "text").collect()}
    assert clean[1] == (None, True) and clean[4] == (None, False) and clean[5] == ("", False) and clean[3][0] == docs[2][1] and clean[7][1]
    assert leakage.find_passages(df, "doc_id", "text", items.limit(0), "item_id", ["prompt"]).count() == 0
    same = leakage.find_passages(df, "doc_id", "text", items.withColumnRenamed("item_id", "doc_id"), "doc_id", ["prompt"])
    assert same.columns == ["doc_id", "item_doc_id", "start_pos", "end_pos"] and same.count() == p.count()
    assert leakage.find_passages(df.limit(0), "doc_id", "text", items, "item_id", ["prompt"]).count() == 0


def test_leaks_do_not_depend_on_blocks(spark, monkeypatch):
    rng = random.Random(4)
    items = [(i, " ".join(f"t{rng.randrange(500)}" for _ in range(20))) for i in range(30)]
    docs = [(i, " ".join(["a b c", items[i % 30][1], "d"])) for i in range(60)]
    df, it = spark.createDataFrame(docs, "d bigint, text string"), spark.createDataFrame(items, "i bigint, t string")
    found = lambda: {(r["d"], r["i"]) for r in leakage.find_passages(df, "d", "text", it, "i", ["t"]).collect()}
    one = found()
    monkeypatch.setattr(leakage, "BLOCK_ITEMS", 7)
    assert found() == one == {(i, i % 30) for i in range(60)}


# shared spans


def brute_windows(index, streamed, n):
    return {(a, b, x - y) for a, t in enumerate(streamed) for b, s in enumerate(index) for x in range(len(t) - n + 1) for y in range(len(s) - n + 1) if t[x : x + n] == s[y : y + n]}


@pytest.mark.parametrize("seed", range(25))
def test_index_finds_every_window(seed):
    import numpy as np

    rng = random.Random(seed)
    n, sigma = rng.choice([3, 5, 8, 17]), rng.choice([3, 4, 9])
    base = [rng.randrange(1, sigma) for _ in range(60)]
    make = lambda: [rng.randrange(1, sigma) if rng.random() < 0.06 else c for c in base[rng.randrange(20) :][: rng.randrange(5, 50)]]
    index, streamed = [make() for _ in range(rng.randrange(1, 6))], [make() for _ in range(rng.randrange(1, 6))]
    s, starts = [], []
    for t in index:
        starts.append(len(s))
        s += [*t, 0]
    fm = FMIndex(np.array(s), np.array(starts), sigma, n)
    pat, off = np.array(sum(streamed, [])), np.cumsum([0] + [len(t) for t in streamed])
    t, w, p = fm.matches(pat, off)
    b = fm.owner(p)
    assert {(int(i), int(j), int(x - (q - fm.starts[j]))) for i, j, x, q in zip(t, b, w, p)} == brute_windows(index, streamed, n)


def span_texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgé漢 ") for _ in range(rng.randrange(2, 9)))
    text = lambda k: " ".join(word() for _ in range(k))
    shared = [text(14) for _ in range(5)]
    out = []
    for _ in range(40):
        t = text(rng.randrange(3, 20))
        if rng.random() < 0.6:
            s = rng.choice(shared)
            a = rng.randrange(0, len(s) // 2)
            t += s[a : a + rng.randrange(20, len(s))] + text(rng.randrange(0, 8))
        out.append(t)
    return [*out, out[3], out[3], "x" * 300, "yy" + "x" * 120 + "zz", "x" * 45 + "tail", None, ""]


@pytest.mark.parametrize("seed,block", [(1, 256), (2, 2), (3, 256)])
def test_span_pairs_are_those_of_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(spans, "GROUP_BLOCK", block)
    monkeypatch.setattr(spans, "MEMBERS", block)
    n, t = 40, span_texts(seed)
    df = spark.createDataFrame([(i, x, 7) for i, x in enumerate(t)], "id bigint, body string, h int")
    found = spans.shared_spans(df, "id", "body", n, 20)
    got = [tuple(r) for r in spans.sharing_pairs(*found).collect()]
    grams = [{x[i : i + n] for i in range(len(x) - n + 1)} if x else set() for x in t]
    want = {(a, b) for a in range(len(t)) for b in range(a + 1, len(t)) if grams[a] & grams[b]}
    assert set(got) == want and len(got) == len(want) > 10
    assert not {(a, b) for a, b in got if t[a] != t[b]} & {tuple(r) for r in spans.sharing_pairs(found[0], found[1], found[2].limit(0)).collect()}  # no pair of different texts without the index
    share = {r["id"]: r for r in spans.shared_share(df, "id", "body", *found).collect()}
    for a, x in enumerate(t):
        cover = set()
        for i in range(len(x or "") - n + 1):
            if any(x[i : i + n] in grams[b] for b in range(len(t)) if b != a):
                cover |= set(range(i, i + n))
        assert share[a]["shared_chars"] == len(cover), a
    assert share[len(t) - 2]["n_chars"] is None and share[len(t) - 1]["share"] == 0.0


def test_no_texts_share_nothing(spark):
    df = spark.createDataFrame([], "id bigint, body string")
    found = spans.shared_spans(df, "id", "body")
    assert spans.sharing_pairs(*found).count() == 0 and spans.shared_share(df, "id", "body", *found).count() == 0


# cut values

SENTENCES = ["The {a} team measured {n} samples because the {b} was stable.", "After {n} rows were sealed, the score of the {a} fell to 0.{n}.", "When the {b} is frozen, the {a} should keep every label.", "Nobody could repeat the {b} without a narrow {a}."]
NOUNS = "parser ledger rubric queue judge export schema worker policy sample".split()


def sentence(rng):
    return rng.choice(SENTENCES).format(a=rng.choice(NOUNS), b=rng.choice(NOUNS), n=rng.randrange(10, 999))


def test_cut_values_are_told_from_whole_ones(spark):
    rng = random.Random(0)
    rows, want = [], set()
    for i in range(1500):
        t = " ".join(sentence(rng) for _ in range(rng.randrange(1, 6)))
        if i % 10 == 0:
            t = t[: rng.randrange(30, len(t) - 1)]
            if t[-1] not in ".":
                want.add(str(i))
        rows.append(("t", str(i), "output", "s", t))
    rows += [("t", "j1", "output", "s", '{"a": "b", "c": [1'), ("t", "j2", "output", "s", '{"a": "b"}'), ("t", "f1", "output", "s", "```python\nx = 1"), ("t", "f2", "output", "s", "```python\nx = 1\n```"), ("t", "e", "output", "s", "The schema…"), ("t", "w", "output", "s", "  "), ("t", "s", "output", "s", "Yes"), ("t", "z", "output", "s", "")]
    df = spark.createDataFrame(rows, "table_name string, record_id string, field_name string, source string, text string")
    got = {r["record_id"] for r in cutoff.find_cut(df).where("cut").collect()}
    assert {"j1", "f1", "e"} <= got and not got & {"j2", "f2", "w", "s", "z"}
    hits = len(want & got)
    assert hits >= 0.9 * len(want) and len(got - want - {"j1", "f1", "e"}) <= 0.05 * len(want) + 3
    assert cutoff.find_cut(df.limit(0)).count() == 0


def test_contexts_are_counted_exactly_among_many_others(spark):
    rng = random.Random(1)
    some = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    endings = [some(12) for _ in range(300)]
    lines = [some(60) + endings[i % 300] for i in range(4200)]  # about 300,000 contexts of 12 characters
    rows = [("t", str(i), "output", "s", x) for i, x in enumerate(lines)]
    df = spark.createDataFrame(rows, "table_name string, record_id string, field_name string, source string, text string")
    got = {r["record_id"]: r["odds"] for r in cutoff.find_cut(df).collect()}
    ends, everywhere = Counter(), Counter()
    for x in lines:
        x = "\x02\x02" + x
        for k in cutoff.ORDERS:
            ends[x[-k:]] += 1
            everywhere.update(x[i : i + k] for i in range(len(x) - k + 1))
    for i, x in enumerate(lines):
        p = 0.02
        for k in cutoff.ORDERS:
            n, e = everywhere[x[-k:]] - 1, ends[x[-k:]] - 1
            if n < cutoff.SUPPORT:
                break
            p = (e + cutoff.BACKOFF * p) / (n + cutoff.BACKOFF)
        assert abs(got[str(i)] - math.log(p / (1 - p))) < 1e-9


def test_notations_of_json():
    assert cutoff.units('{"note": "a text that is long enough to count"}') == (["a text that is long enough to count"], False)
    assert cutoff.units("{'note': 'x', 'n': None}") == ([], False) and cutoff.units('{"a": 1,}') == ([], False)
    assert cutoff.units('{"a": "b')[1] and cutoff.units("[1, 2")[1] and cutoff.units(None) == ([], False) and cutoff.units("[" * 5000)[1]


# pairs


@pytest.mark.parametrize(
    "prompt,text,defect",
    [
        ("Why?", None, "empty"), ("Why?", " ​\n", "empty"), ("Why?", "N/A", "empty"), ("Why?", "[no output]", "empty"), ("Give just the value.", "None", None), ("Why did it fail?", "0", None),
        ("Why did the parser fail twice today?", "Why did the parser fail twice today?", "copy"), ("Why did the parser fail twice today?", "Question: why did the parser fail twice today?", "copy"), ("Why did the parser fail twice today?", "Why did the parser fail twice today? Because the ledger was sealed before noon.", None),
        ("Why?", "I'm sorry, but I can't help with that request.", "refusal"), ("Why?", "Es tut mir leid, aber dabei kann ich nicht helfen.", "refusal"), ("Why?", "Debo rechazar la solicitud.", "refusal"), ("Why?", "Je ne peux pas répondre à cette demande.", "refusal"),
        ("Why?", "I can't reproduce the drop in coverage, but the gate explains it: 12 rows were sealed.", None), ("Why?", "Sorry for the delay; the score is 0.4 on 12 rows.", None),
        ("Why were the rows sealed before the audit?", "Weil die Zeilen nicht geprüft wurden und der Bericht noch fehlt.", "other_language"), ("Why were the rows sealed? Answer in German.", "Weil die Zeilen nicht geprüft wurden und der Bericht noch fehlt.", None), ("Why were the rows sealed before the audit?", "因为报告还不稳定。 我们重算了案例。", "other_language"),
        (None, "A plain answer.", None),
    ],
)
def test_rules(prompt, text, defect):
    assert pairs.rule_defect(prompt, text) == defect


def test_languages():
    assert [language(t) for t in ("The rows were sealed before the audit.", "Die Zeilen wurden nicht geprüft.", "Les lignes ont été comptées pour le rapport.", "Los casos fueron revisados por el equipo.", "データセットの件数を確認しました。", "", None, "1234")] == ["en", "de", "fr", "es", "ja", None, None, None]


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_shortened_versions_are_neighbours(spark, parts):
    rng = random.Random(9)
    whole = [" ".join(sentence(rng) for _ in range(3)) + f" The {a} {b} was sealed by hand, although nobody had asked for it." for a in NOUNS for b in ("golden", "narrow", "stale", "cheap")]
    cut = [f"{sentence(rng)} The {a} golden was sealed by hand, altho" for a in NOUNS] + [f"{sentence(rng)}\nThe {a} na" for a in NOUNS]
    other = ["The parser", "", "  ", ",", "Nobody can tell what stands here and not els", "The parser golden was sealed by hand,", "x" * 100_000, "x" * 100_001]
    texts = [*whole, *cut, *other]
    df = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "k1 bigint, k2 bigint, text string").repartition(parts)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(r["k1"] for r in pairs.shortened(df).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    # Every planted one, and a run of letters that a longer one begins with; not a short phrase by itself, nor an end no one continues.
    assert got == [*range(len(whole), len(whole) + len(cut)), len(texts) - 2]
    assert pairs.shortened(df.limit(0)).count() == 0


def test_long_refusals_and_long_copies_are_told():
    long = "I am sorry, but I cannot help with this request, because it would go against my guidelines and I must decline to go into " + ", ".join(f"item {i} of the list that you sent me" for i in range(30)) + "."
    assert len(long) > 900 and pairs.rule_defect("Why?", long) == "refusal"
    prompt = "Tell why " + " ".join(f"the {a} of the {b} was sealed before {i}" for i, (a, b) in enumerate((a, b) for a in NOUNS for b in NOUNS)) + "?"
    words = prompt.split()
    assert pairs.rule_defect(prompt, " ".join(w for i, w in enumerate(words) if i % 40 != 7)) == "copy" and pairs.rule_defect("Why?", "why") == "copy"
    assert pairs.rule_defect(prompt, " ".join(words).replace(" ", "  ,  ")) == "copy"


def test_defects_of_a_table(spark):
    rng = random.Random(3)
    rows = [("t", str(i), "output", "s", "Why was the row sealed before the audit?", " ".join(sentence(rng) for _ in range(3))) for i in range(300)]
    rows += [("t", "e", "output", "s", "Why?", None), ("t", "r", "output", "s", "Why?", "I must decline."), ("t", "c", "output", "s", rows[0][4], rows[0][4]), ("t", "x", "output", "s", rows[0][4], rows[7][5][:-25])]
    df = spark.createDataFrame(rows, "table_name string, record_id string, field_name string, source string, prompt string, text string")
    got = {r["record_id"]: r["defect"] for r in pairs.find_defects(df).collect()}
    assert got["e"] == "empty" and got["r"] == "refusal" and got["c"] == "copy" and got["x"] == "truncated" and len(got) <= 8
    assert pairs.find_defects(df.limit(0)).count() == 0


# personal data


def test_seeds_and_candidates():
    t = "Mail a.b+c@team.example.org or x-7 [at] web [dot] example, call +33.1.99.00.40.53, SSN 969-24-6012, mobile: 07700 900 675, build 819.920.438 of 0.713; she lives at 55 Ostermoor Road, Unit 2, in Vintrystraße 279a, Calle Pellmont 48, 191 bis, rue de Gorse, or 7 Larkfell Mews, Eldmere 98494."
    sure, found = personal.scan(t)
    assert [t[s:e] for _, s, e in sure] == ["a.b+c@team.example.org", "x-7 [at] web [dot] example"]
    seeds = {(x[7], t[x[1] : x[2]]) for x in found if x[7]}
    assert {("phone", "+33.1.99.00.40.53"), ("phone", "07700 900 675"), ("id_number", "969-24-6012")} <= seeds
    assert {x for k, x in seeds if k == "address"} == {"55 Ostermoor Road, Unit 2", "Vintrystraße 279a", "Calle Pellmont 48", "191 bis, rue de Gorse", "7 Larkfell Mews, Eldmere 98494"}
    assert "819.920.438" in {t[x[1] : x[2]] for x in found} and not any("819" in x for _, x in seeds)


def test_unseen_shapes_and_words_are_learned_from_where_they_stand(spark):
    rng = random.Random(2)
    digits = lambda form: "".join(str(rng.randrange(1, 10)) if c == "d" else c for c in form)
    town = lambda: f"{rng.choice(['Eldmere', 'Villarosel'])} {rng.randrange(10000, 99999)}"
    name = lambda: rng.choice("Larkfell Tarnlow Pellmont Vintry Ashmere Bellhatch Quarrywick".split())
    phones, ids, streets = ["+dd ddd dddddd", "ddd/ddd-dddd", "dd-ddddd-ddd"], ["ddd-dd-dddd", "dddd.dddd.dddd"], ["Road", "Twitten", "Wynd"]
    rows, want = [], set()
    for i in range(600):
        kind, value, t = [
            lambda: ("phone", v := digits(rng.choice(phones)), rng.choice(["She can be called on {} today.", "Please text me on {} soon."]).format(v)),
            lambda: ("id_number", v := digits(rng.choice(ids)), rng.choice(["The card shows {} in full.", "Entered under file key {} last week."]).format(v)),
            lambda: ("address", v := f"{rng.randrange(1, 99)} {name()} {(w := rng.choice(streets))}", rng.choice(["The parcel for {} was lost.", "He lives at {} alone."]).format(v + (f", {town()}" if rng.random() < 0.4 else ""))),
            lambda: (None, "", f"The build {digits('ddd.ddd.ddd')} scored {digits('ddd-ddd-ddd')} on 12 Tessera cases."),
        ][i % 4]()
        t = "The queue was stable. " + t
        rows.append(("t", str(i), "f", t))
        if kind:
            want.add((str(i), kind, t.index(value)))
    df = spark.createDataFrame(rows, "table_name string, record_id string, field_name string, text string")
    got = {(r["record_id"], r["kind"], r["start_pos"]) for r in personal.find_personal(df).where("kind <> 'name'").collect()}
    assert got == want


def test_a_hot_pattern_is_split(spark, monkeypatch):
    rows = [(i, [1, 2 + i % 3], [50 + i % 4], 1, "name" if i % 5 == 0 else None, False) for i in range(200)]
    found = spark.createDataFrame(rows, "instance bigint, contexts array<bigint>, parts array<bigint>, telling int, seed string, strict boolean")
    one = {tuple(r) for r in personal.bootstrap(found, personal.NAMES).collect()}
    monkeypatch.setattr(personal, "HOT", 7)
    assert {tuple(r) for r in personal.bootstrap(found, personal.NAMES).collect()} == one and len(one) == 200


@pytest.mark.parametrize("at", ["@", "＠", "[at]", "(AT)", "{at}", "<At>"])
def test_an_address_is_found_by_every_form_of_its_sign(at):
    assert [k for k, _, _ in personal.scan(f"write to jo.ray{at}host.org soon")[0]] == ["email"]


def test_names_are_found_to_the_end_of_a_chain(spark):
    rows = [(10 * i + j, [], [1000 + i, 1001 + i], 1, "name" if i == 0 else None, False) for i in range(9) for j in range(2)]
    found = spark.createDataFrame(rows, "instance bigint, contexts array<bigint>, parts array<bigint>, telling int, seed string, strict boolean")
    assert {r[0] for r in personal.bootstrap(found, personal.NAMES).collect()} == {r[0] for r in rows}
    with pytest.raises(RuntimeError):
        personal.bootstrap(found, personal.NAMES, 2)


def test_names_are_found_by_their_contexts(spark):
    rng = random.Random(5)
    given_names, families = "Karim Nadia Felix Rosa Emil Clara".split(), [a + b for a in "Dal Tor Vel Ost Wim Zel".split() for b in "rovic quist gomar veld".split()]
    contexts = ["My name is {} and I own the queue.", "Customer {} can be called today.", "According to {}, the queue is full.", "Please forward this to {} soon."]
    rows, want = [], set()
    for i in range(400):
        name = f"{rng.choice(given_names)} {rng.choice(families)}"
        c = rng.choice(contexts)
        t = "Basalt Plus and Drumlin Fast were sealed. " + c.format(name) + " Port Sannow is quiet."
        rows.append(("t", str(i), "f", t))
        want.add((str(i), t.index(name)))
    rows += [("t", "n", "f", None), ("t", "e", "f", "")]
    df = spark.createDataFrame(rows, "table_name string, record_id string, field_name string, text string")
    found = personal.find_personal(df)
    got = {(r["record_id"], r["start_pos"]) for r in found.where("kind = 'name'").collect()}
    assert len(want & got) >= 0.97 * len(want) and len(got - want) <= 4
    clean = {r["record_id"]: r["redacted"] for r in personal.redact(df, found).collect()}
    assert clean["n"] is None and clean["e"] == "" and "[NAME]" in clean["0"] and clean["0"].startswith("Basalt Plus and Drumlin Fast were sealed. ")
    assert personal.find_personal(df.limit(0)).count() == 0


def test_redaction_leaves_the_rest_unchanged(spark):
    t = "  Écrivez à ravdanov_greta@inbox.invalid\tavant midi.\n\nTél. 07700 900 675 "
    df = spark.createDataFrame([("t", "1", "f", t)], "table_name string, record_id string, field_name string, text string")
    assert personal.redact(df, personal.find_personal(df)).first()["redacted"] == "  Écrivez à [EMAIL]\tavant midi.\n\nTél. [PHONE] "
