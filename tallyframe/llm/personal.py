"""Personal information in free text: found, and replaced by typed placeholders.

Everything but mail addresses, whose form tells them, is found by bootstrapping. Candidates are
numbers, places (a number and a capitalised name) and pairs of capitalised words. Seeds are those
that need no context: names behind a title or an introduction, phone numbers in international form
or behind a label, identity numbers of a strict form or behind a label, addresses with a town and
its code or one of a few street words. Seeds lend weight to the patterns they occur with (the words
around them; the shape of a number, the word for a street, the given and family name); patterns with
enough weight make their other instances known, and so on in rounds over the graph of patterns and
instances, until nothing new is found. So shapes of numbers, words for streets and names that no
list has are found from where they stand.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.llm import vec
from tallyframe.llm.shared import drop, written

#: A guard: the known instances only grow, so they stand still; so many rounds without that are an error.
ROUNDS = 200
#: Share of a first word's occurrences with another name behind it from which it is no given name.
NESTED = 0.5
#: Instances of one pattern that one task joins; a pattern of more is split.
HOT = 500_000

#: Titles before a person's name, and words by which persons introduce themselves (fixed values).
TITLES = "mr mrs ms miss dr prof herr frau señor señora sr sra don doña monsieur madame mme mlle m sig signor signora dhr mevr"
INTRODUCTIONS = ["name is", "name ist", "ich heiße", "m'appelle", "me llamo", "nombre es", "mi chiamo", "heet ik"]
#: Particles within family names (fixed values).
PARTICLES = "van von de del della di da du la le der den ter ten dos das al el bin ibn zu"
#: Labels right before a phone number or an identity number (fixed values).
PHONE_LABELS = "tel tél telefon teléfono téléphone telephone phone mobile fax"
ID_LABELS = "ssn dni nif nie passport-no steuer-id tax-id national-id"
#: Words for streets that make an address a seed, by where they stand: behind the name, before it, between the
#: number and the name, at the name's end (fixed values). Others are learned.
STREETS = {"A": "street road avenue", "B": "calle avenida", "C": "rue avenue", "G": "straße strasse"}


@dataclass(frozen=True)
class Rules:
    """When a pattern is good for a kind: so many known instances of it, at such a share of all, and so many
    times as many as of the other kinds; one for contexts, one for parts. A strict part counts only instances
    that are seeds or told by a part."""

    context_known: int
    context_share: float
    part_known: int
    part_share: float
    lead: float = 4.0
    context_weight: int = 1


NAMES = Rules(4, 0.6, 2, 0.1)
PLACES = Rules(3, 0.3, 2, 0.1, context_weight=2)

_AT = r"(?:\s?(?:@|＠|\[at\]|\(at\)|\{at\}|<at>)\s?)"
#: What every form above has in it, in lower case.
AT_MARKS = ("@", "＠", "at]", "at)", "at}", "at>")
_DOT = r"(?:\.|\s?(?:\[dot\]|\(dot\)|\{dot\})\s?)"
EMAIL = re.compile(rf"(?<![\w.+-])[\w](?:[\w.+%-]|\s?(?:\[dot\]|\(dot\))\s?)*{_AT}[A-Za-z0-9](?:[\w-]*[A-Za-z0-9])?(?:{_DOT}[A-Za-z0-9](?:[\w-]*[A-Za-z0-9])?)+", re.IGNORECASE)
NUMBER = re.compile(r"[+(\d](?<![\w.,/#-].)(?:(?<=[+(])\d|(?<=\d))(?:(?:\) |[ .\-/]|\)|\()?\d){6,17}(?![\w/]|[.,-]\d)")
CODE = re.compile(r"(?<![\w-])(?:[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]|[A-Z]{1,3}\d{6,9}|\d{7,8}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z])(?![\w-])")
#: Identity numbers of a form that nothing else has: three, two and four digits with hyphens, or two letters, three
#: pairs of digits and a letter from A to D (fixed values).
STRICT_ID = re.compile(r"\d{3}-\d{2}-\d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]")
_CAP = r"[A-ZÀ-ÖØ-Þ]"
_NAME_WORD = rf"{_CAP}[a-zß-öø-ÿ'’]+"
_FAMILY = rf"(?:(?:{'|'.join(PARTICLES.split())}) )*(?:{_NAME_WORD}(?:-{_NAME_WORD})?|{_CAP}{{3,}}(?:-{_CAP}{{3,}})?)(?![\w@])"
_GIVEN = rf"{_NAME_WORD}(?:-{_NAME_WORD})?"
_REST = r"[a-zß-öø-ÿ'’]+"
#: A capital letter where a name may begin; the groups hold what follows it. The letter stands first, because a
#: search for a set of letters is fast.
NAME = re.compile(
    rf"{_CAP}(?<![\w@.'’-].)(?=(?P<fwd>(?P<g>{_REST}(?:-{_NAME_WORD})?|\.) (?:{_CAP}\. )?(?P<f>{_FAMILY}))?"
    rf"(?P<rev>(?P<rf>(?:{_REST}(?:-{_NAME_WORD})?|{_CAP}{{2,}}(?:-{_CAP}{{3,}})?)(?![\w@])), (?P<rg>{_GIVEN})(?![\w@]))?)(?(fwd)|(?(rev)|(?!)))"
)
_TOWN = rf"(?:{_NAME_WORD}|Port {_NAME_WORD})(?:[- ]{_NAME_WORD})?"
_WORD = rf"{_CAP}[\w'’-]+"
#: Places by form: number and name; word and name, then number; number, word and name; one word, then number.
PLACE = {
    "A": re.compile(rf"(?<![\w.,/-])(?<!\d )\d{{1,5}}[a-zA-Z]?(?P<w>(?: {_WORD}){{2,5}})"),
    "B": re.compile(rf"(?<![\w/])(?P<w>{_CAP}\w*(?:/|\.)?) (?:(?:de|del|la|el|los|las|da|do|di) )*{_WORD}(?: {_WORD}){{0,3}},? (?:n\.?º ?)?\d{{1,5}}[a-zA-Z]?(?![\w])(?![.,/-]\d)"),
    "C": re.compile(rf"(?<![\w.,/-])\d{{1,5}}(?: ?(?:bis|ter|quater|[a-zA-Z]))?,? (?P<w>[a-zà-ÿ]{{3,12}}) (?:(?:de|du|des|la|le|les) |d'|l')*{_WORD}(?: {_WORD})?"),
    "G": re.compile(rf"(?<![\w-])(?P<w>(?:{_WORD}[- ])?{_WORD}(?<=\w{{6}})\.?) \d{{1,5}} ?[a-zA-Z]?(?![\w])(?![.,:/-]\d)"),
}
_UNIT = r"(?:, (?:Unit|Flat|Apt|Apartment|Suite|Floor|Room|Apt\.|#) ?\w+)"
_POST = rf"(?:,? {_TOWN},? \d{{4,6}}|, \d{{4,6}} {_TOWN})"
_TAIL = re.compile(rf"\.?{_UNIT}?(?P<post>{_POST})|\.?{_UNIT}|\.(?=,)")
_DIGITS = re.compile(r"\d+")
_TITLE = frozenset(TITLES.split())
_PHONE_LABELS, _ID_LABELS = frozenset(PHONE_LABELS.split()), frozenset(ID_LABELS.split())
_STREETS = {k: frozenset(v.split()) for k, v in STREETS.items()}
_TOKEN = re.compile(r"\S+")


def form_of(number: str) -> str:
    """The number's shape: d for a digit, A for a capital letter."""
    return re.sub(r"[A-Z]", "A", re.sub(r"\d", "d", number))


def number_seed(number: str, before: str) -> str | None:
    """Kind of a number by a strict form or the label right before it; None if neither tells."""
    if number[0] == "+" and 8 <= sum(c.isdigit() for c in number) <= 15:
        return "phone"
    if STRICT_ID.fullmatch(number):
        return "id_number"
    words = [w.strip(".:,;()") for w in before.lower().split()[-2:]]
    if not words:
        return None
    last = {words[-1], "-".join(words)}
    return "phone" if last & _PHONE_LABELS else "id_number" if last & _ID_LABELS else None


def _mask(token: str) -> str:
    if token.isalpha():
        return token.lower()
    if "@" in token:
        return token[0] + "@" if token[0] in "(<[" else "@"
    return re.sub(r"\d+", "0", token.lower())


def context(text: str, start: int, end: int) -> list[str]:
    """Patterns of the words before and after a span: one and two of each; nothing beyond a sentence's begin."""
    left = [_mask(t) for t in _TOKEN.findall(text[max(0, start - 40) : start])][-2:]
    right = [_mask(t) for t in _TOKEN.findall(text[end : end + 40])][:2]
    if start >= 1 and not text[start - 1].isspace() and left:
        left[-1] += "_"
    out = []
    if left and left[-1][-1] not in ".!?":
        out.append("l " + left[-1])
        if len(left) == 2:
            out.append("L " + (left[0] if left[0][-1] not in ".!?" else ".") + " " + left[1])
    out += ["r " + right[0]] if right else []
    out += ["R " + " ".join(right)] if len(right) == 2 else []
    return out


def _nearest(contexts: list[str]) -> list[str]:
    """The longest of the patterns before a span."""
    return [c for c in contexts if c[0] in "lL"][-1:]


def _places(text: str, runs: list[re.Match], taken: list[tuple[int, int]]) -> Iterator[tuple]:
    """Candidates for addresses; runs are the text's runs of digits, at one of which each begins or ends."""
    found = [(form, m) for form in "AC" for r in runs if r.end() - r.start() <= 5 and (m := PLACE[form].match(text, r.start()))]
    if any(_capital_before(text, r.start()) for r in runs):
        found += [(form, m) for form in "BG" for m in PLACE[form].finditer(text)]
    for form, m in found:
        s = m.start()
        ends = [m.end()]
        if form == "A":  # any word from the second on may be that for the street
            ends = [m.start("w") + x.end() for x in _TOKEN.finditer(m.group("w"))][1:]
        for e in ends:
            if any(a < e and s < b for a, b in taken):
                continue
            core = text[s:e]
            word = core.rpartition(" ")[2].lower() if form == "A" else m.group("w").lower()
            parts = [f"{form} {word.rstrip('.')}"]
            if form == "G":
                word = word.rstrip(".")
                parts = [f"G {word[-n:]}" for n in range(3, 8) if n < len(word)] + ([f"G {word.rpartition(' ')[2]}"] if " " in word else [])
            tail = _TAIL.match(text, e)
            seed = tail is not None and tail.group("post") or any(p[2:] in _STREETS[form] for p in parts)
            yield "address", s, tail.end() if tail else e, core, _nearest(context(text, s, e)), parts, 9, "address" if seed else None


def _capital_before(text: str, at: int) -> bool:
    """Whether the word before a place, or the one before a sign for a number, begins with a capital letter."""
    words = text[max(0, at - 60) : at].split()[-2:]
    return any(w != w.lower() for w in words)


def scan(text: str) -> tuple[list[tuple[str, int, int]], list[tuple]]:
    """Mail addresses (kind, start, end), and candidates (type, start, end, instance, contexts, parts, telling, seed,
    nested): telling is how many of the first parts tell the instance, seed the kind it has by itself."""
    low = text.lower()
    sure = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)] if any(mark in low for mark in AT_MARKS) else []
    taken, found = [(s, e) for _, s, e in sure], []
    runs = list(_DIGITS.finditer(text))
    if runs:
        if sum(r.end() - r.start() for r in runs) >= 6:
            for pattern in (CODE, NUMBER):
                for m in pattern.finditer(text):
                    s, e = m.span()
                    if not any(a < e and s < b for a, b in taken):
                        taken.append((s, e))
                        found.append(("number", s, e, m.group(), _nearest(context(text, s, e)), ["shape " + form_of(m.group())], 1, number_seed(m.group(), text[max(0, s - 40) : s])))
        found += _places(text, runs, taken)
    for m in NAME.finditer(text):
        for form, given, family in (("fwd", "g", "f"), ("rev", "rg", "rf")):
            s, e = m.start(), m.end(form)
            if e < 0 or any(a < e and s < b for a, b in taken):
                continue
            given, family = (text[s : m.end(x)] if x in ("g", "rf") else m.group(x) for x in (given, family))
            g = given.split("-")[0].lower()
            if g.rstrip(".") in _TITLE and len(g) > 2 or family.lower() in _TITLE:
                continue
            f = family.split(" ")[-1].lower()
            # The part that tells a person comes first: the given name, or behind an initial the family
            # name; in the reverse order, which is that of any two words in a list too, both are needed.
            parts = ["f " + f] if g.endswith(".") else ["g " + g, "f " + f] if form == "fwd" else ["", "g " + g, "f " + f]
            before = text[max(0, s - 24) : s].lower().split()
            title = bool(before) and before[-1].rstrip(".") in _TITLE and not g.endswith(".")
            last = " ".join(before[-2:])
            seed = title or any(last.endswith(x) for x in INTRODUCTIONS)
            found.append(("ini" if g.endswith(".") else form, s, e, text[s:e].lower(), context(text, s, e), parts, 1, "name" if seed else None))
    # A first word behind which another name begins is more likely a title or a noun.
    begins = {x[1] for x in found if x[0] in ("fwd", "rev", "ini")}
    return sure, [(*x, x[0] == "fwd" and x[1] + text[x[1] : x[2]].find(" ") + 1 in begins) for x in found]


def _hash(s: str) -> int:
    return xxhash.xxh64_intdigest(s) - (1 << 63)


def candidates(texts: DataFrame) -> DataFrame:
    """(table_name, record_id, field_name, type, start, end, instance, contexts, parts, telling, seed, nested) from
    (table_name, record_id, field_name, text). Mail addresses have a null instance; candidates have
    64-bit hashes of their text, of the patterns around them and of their parts."""
    keys = ["table_name", "record_id", "field_name"]
    names = [*keys, "type", "start", "end", "instance", "contexts", "parts", "telling", "seed", "nested"]
    hashes = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in vec.slices(batch, "text"):
                rows = []
                for i, t in enumerate(part.column("text").to_pylist()):
                    sure, found = scan(t)
                    rows += [(i, k, s, e, None, None, None, 0, None, False) for k, s, e in sure]
                    for k, s, e, x, c, q, telling, seed, nested in found:
                        of = k[0] if k in ("number", "address") else "p"
                        rows.append((i, k, s, e, _hash(of + x), [_hash(of + y) for y in c], [_hash(of + y) if y else None for y in q], telling, seed, nested))
                cols = list(zip(*rows)) or [()] * 10
                take = pa.array(cols[0], pa.int32())
                types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), hashes, hashes, pa.int32(), pa.string(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([*[part.column(c).take(take) for c in keys], *[pa.array(c, t) for c, t in zip(cols[1:], types)]], names)

    return texts.select(*keys, "text").mapInArrow(
        run, "table_name string, record_id string, field_name string, type string, start int, end int, instance bigint, contexts array<bigint>, parts array<bigint>, telling int, seed string, nested boolean"
    )


def bootstrap(found: DataFrame, rules: Rules, rounds: int = ROUNDS) -> DataFrame:
    """(instance, kind, sure): the instances known when a round finds no more, the seeds among them; sure ones are
    seeds or told by a part.

    found: (instance, contexts, parts, telling, seed, strict). An instance becomes known as the kind of a telling
    part, or of good patterns of weight 2 if they are half of its contexts. Patterns of a single instance are left
    out of the graph at once; a pattern of very many is split by a hash of its instances; every round's
    known instances are written to the shared folder.
    """
    around = found.select("instance", F.explode("contexts").alias("pattern"), F.lit(False).alias("is_part"), F.lit(rules.context_weight).alias("weight"), F.lit(False).alias("tells"), F.lit(False).alias("strict"))
    parts = found.select("instance", F.posexplode("parts").alias("at", "pattern"), "telling", "strict").where("pattern is not null")
    tells = F.col("at") < F.col("telling")
    parts = parts.select("instance", "pattern", F.lit(True).alias("is_part"), F.when(tells, 2).otherwise(1).alias("weight"), tells.alias("tells"), "strict")
    edges = around.unionByName(parts).distinct()
    # What never changes: a row per pattern and salt.
    salts = F.ceil(F.col("total") / HOT)
    patterns = edges.groupBy("pattern").agg(F.count("*").alias("total"), F.any_value("is_part").alias("is_part"), F.any_value("strict").alias("strict")).where("total > 1")
    patterns = written(patterns)
    edges = edges.join(patterns.select("pattern", "total"), "pattern").withColumn("salt", F.pmod("instance", salts))
    edges = written(edges.withColumn("contexts", F.count_if(~F.col("is_part")).over(Window.partitionBy("instance"))))  # an instance's patterns
    known = written(found.where("seed is not null").groupBy("instance").agg(F.min("seed").alias("kind")).withColumn("sure", F.lit(True)))
    before = None
    for _ in range(rounds):
        state = known.agg(F.count("*"), F.count_if("sure")).first()
        if state == before:
            drop(edges, patterns)
            return known
        before = state
        counted = edges.join(known, "instance").groupBy("pattern", "kind").agg(F.count("*").alias("k"), F.count_if("sure").alias("s"))
        best = counted.groupBy("pattern").agg(F.max_by(F.struct("kind", "k", "s"), "k").alias("top"), F.sum("k").alias("all")).select("pattern", "top.*", "all")
        of = patterns.join(best, "pattern")
        k = F.when(F.col("strict"), F.col("s")).otherwise(F.col("k"))
        enough = F.when(F.col("is_part"), (k >= rules.part_known) & (k >= rules.part_share * F.col("total"))).otherwise((k >= rules.context_known) & (k >= rules.context_share * F.col("total")))
        good = of.where(enough & (k >= rules.lead * (F.col("all") - F.col("k")))).select("pattern", "kind", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)).alias("salt"))
        votes = edges.join(good, ["pattern", "salt"]).groupBy("instance", "kind").agg(
            F.sum("weight").alias("weight"), F.max(F.col("is_part") & F.col("tells")).alias("sure"), F.count_if(~F.col("is_part")).alias("good"), F.first("contexts").alias("contexts")
        )
        votes = votes.groupBy("instance").agg(F.max_by(F.struct("kind", "weight", "sure", "good", "contexts"), F.struct("sure", "weight")).alias("v")).select("instance", "v.*")
        more = votes.where("weight >= 2 and (sure or 2 * good >= contexts)").select("instance", "kind", "sure")
        both = known.withColumn("first", F.when(F.col("sure"), 3).otherwise(1)).unionByName(more.withColumn("first", F.when(F.col("sure"), 2).otherwise(0)))
        last, known = known, written(both.groupBy("instance").agg(F.max_by("kind", "first").alias("kind"), F.max(F.col("first") >= 2).alias("sure")))
        drop(last)
    raise RuntimeError(f"bootstrap: instances are still being found after {rounds} rounds")


def find_personal(texts: DataFrame) -> DataFrame:
    """(table_name, record_id, field_name, kind, start_pos, end_pos) of every piece of personal data.

    texts: (table_name, record_id, field_name, text), each row once. Positions are 0-based characters,
    the end excluded. Pieces do not overlap: mail addresses go first, then addresses told by their word for a
    street, numbers, other addresses, names; of two such the one that begins first, then the shorter. Of names
    the reverse form of a known family name goes first, then those with the given name in front, then
    other reverse forms, then initials. Null and empty texts have none.
    """
    keys = ["table_name", "record_id", "field_name"]
    found = written(candidates(texts.where("text is not null")))
    sure = found.where("instance is null").select(*keys, F.col("type").alias("kind"), "start", "end", F.lit(0).alias("rank"))
    places = found.where("type in ('number', 'address')")
    kinds = bootstrap(places.select("instance", "contexts", "parts", "telling", "seed", (F.col("type") == "address").alias("strict")), PLACES)
    rank = F.when(F.col("type") == "number", 2).when(F.col("sure"), 1).otherwise(3)
    placed = places.join(kinds, "instance").select(*keys, "kind", "start", "end", rank.alias("rank"))
    sure = written(sure.unionByName(placed))
    # Names within an address or a number are none.
    spans = sure.groupBy(*keys).agg(F.collect_list(F.struct("start", "end")).alias("v"))  # the spans of one text
    names = found.where("type in ('fwd', 'rev', 'ini')").join(spans, keys, "left")
    names = names.where(~F.coalesce(F.exists("v", lambda t: (t["start"] < F.col("end")) & (F.col("start") < t["end"])), F.lit(False))).drop("v")
    names = written(names)
    first = F.element_at("parts", 1)
    nouns = names.where("type = 'fwd'").groupBy(first.alias("noun")).agg(F.avg(F.col("nested").cast("int")).alias("share")).where(F.col("share") >= NESTED).select("noun")
    names = written(names.join(nouns, (F.col("type") == "fwd") & (first == F.col("noun")), "left_anti"))
    people = bootstrap(names.select("instance", "contexts", "parts", "telling", "seed", F.lit(False).alias("strict")), NAMES).select("instance")
    known = names.join(people, "instance", "left_semi")
    # A family name that known names have elsewhere tells "Family, Given" from "Regards, Given Family".
    families = known.where("type = 'fwd'").groupBy(F.element_at("parts", 2).alias("family")).agg(F.countDistinct("instance").alias("n")).where("n > 1").select("family")
    placed = known.join(families, (F.col("type") == "rev") & (F.try_element_at("parts", F.lit(3)) == F.col("family")), "left")
    rank = F.when(F.col("family").isNotNull(), 4).when(F.col("type") == "fwd", 5).when(F.col("type") == "rev", 6).otherwise(7)
    chosen = placed.select(*keys, F.lit("name").alias("kind"), "start", "end", rank.alias("rank"))
    spans = sure.unionByName(chosen).groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("rank", "start", "end", "kind"))).alias("v"))  # the spans of one text
    free = lambda a, s: ~F.exists(a, lambda t: (t["start"] < s["end"]) & (s["start"] < t["end"]))
    empty = F.expr("cast(array() as array<struct<rank:int,start:int,end:int,kind:string>>)")
    kept = F.aggregate("v", empty, lambda a, s: F.when(free(a, s), F.concat(a, F.array(s))).otherwise(a))
    out = spans.select(*keys, F.explode(kept).alias("s"))
    return out.select(*keys, "s.kind", F.col("s.start").alias("start_pos"), F.col("s.end").alias("end_pos"))


def redact(texts: DataFrame, pieces: DataFrame) -> DataFrame:
    """(table_name, record_id, field_name, redacted): every text with [EMAIL], [PHONE], [ID_NUMBER],
    [ADDRESS] and [NAME] in place of its pieces and otherwise unchanged; a null text stays null."""
    keys = ["table_name", "record_id", "field_name"]
    spans = pieces.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start_pos", "end_pos", "kind"))).alias("v"))
    joined = texts.join(spans, keys, "left")
    step = F.aggregate(
        "v",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(s["end_pos"].alias("at"), F.concat(a["out"], F.col("text").substr(a["at"] + 1, s["start_pos"] - a["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out")),
    )
    clean = F.when(F.col("v").isNull(), F.col("text")).otherwise(F.concat(step["out"], F.col("text").substr(step["at"] + 1, F.length("text"))))
    return joined.select(*keys, clean.alias("redacted"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    def of(table: str, columns: list[str]) -> DataFrame:
        rows = spark.read.parquet(f"{d}/{table}.parquet").select("id", *columns).dropDuplicates(["id"])
        fields = F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).alias("t")) for c in columns]))
        return rows.select("id", fields.alias("x")).select(F.lit(table).alias("table_name"), F.col("id").alias("record_id"), F.col("x.f").alias("field_name"), F.col("x.t").alias("text"))

    return of("evaluations", ["prompt", "model_output", "context"]).unionByName(of("reviews", ["comment"]))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of personal data with its kind and place."""
    return find_personal(_texts(spark, sf_dir)).drop("end_pos")


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with placeholders for its personal data."""
    texts = _texts(spark, sf_dir)
    return redact(texts, find_personal(texts))
