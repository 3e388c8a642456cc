"""Defects of prompt and response pairs.

Shortened versions are found by sorting the clauses of all responses by text: the extensions of a
text follow it directly, so a response that breaks off is compared, by its last clause, with the next
different neighbour; if that continues it, the response is a shortened version. (Whole responses are
too rarely begun alike for that.) Limits are lengths at which
responses pile up. Emptiness, copies, refusals and the language are told by rules per pair; whether
an end that no neighbour continues is open, at or off a limit, is told by the model of `cutoff`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.llm import cutoff, vec
from tallyframe.llm.langid import language_scores
from tallyframe.llm.shared import written

#: Texts that stand for no answer, without enclosing brackets (fixed values).
PLACEHOLDERS = "n/a na nil null nan none empty blank undefined missing nothing void no-output"
_PLACEHOLDER = re.compile(
    r"[\[<(\"'`*]*\s*(?:" + "|".join(re.escape(p) for p in PLACEHOLDERS.split()) + r"|(?:no|empty|missing|blank) (?:output|answer|response|reply|content|text|result|data))\s*[\]>)\"'`*.]*",
    re.IGNORECASE,
)
_BRIEF = re.compile(r"(?i)one word|just the value|as briefly|no explanation|number only|single word|yes or no|only the (?:value|number|name)")
_CONTENT = re.compile(r"[^\W_]")
_TAGS = re.compile(r"</?[a-zA-Z][^<>]*>")

#: How assistants decline, by language (fixed values): a statement of not doing, and what is not done.
_EN_ACT = r"(?:help|assist|comply|answer|discuss|respond|provide|take part|cover|go into|share|do (?:that|this|so)|engage|support|fulfil|participate|continue with|talk about|offer|complete|process|address|touch)"
REFUSALS = [
    rf"\bI(?:'m| am)?(?: (?:really|simply|just|therefore|also))? ?(?:can(?:no|')t|can not|won't|will not|am not (?:able|allowed|permitted) to|'m not (?:able|allowed|permitted) to|am unable to|'m unable to|would rather not|'d rather not|prefer not to|would prefer not to|'d prefer not to|do not want to|don't want to|shouldn't|should not) (?:\w+ )?{_EN_ACT}\b",
    r"\bI (?:must|have to|need to|will have to|'ll have to)? ?(?:respectfully |politely )?(?:decline|refuse|pass on this)\b",
    r"\bI (?:do not|don't) feel comfortable\b",
    r"\boutside (?:of )?what I(?:'m| am) (?:allowed|able|permitted)\b",
    r"\b(?:against|violate|violates|break|breaks) my (?:guidelines|rules|policy|policies|principles|instructions)\b",
    r"\bsomething I (?:won't|will not|can't|cannot|am not able to|'m not able to) \w+",
    r"\bnot something I(?:'m| am)? (?:can|able|willing|allowed)\b",
    r"\b(?:it is|it's|it will|that is|that's) not (?:be )?possible (?:for me )?to " + _EN_ACT[:-1] + r"|give|tell|say)\b|\boff[- ]limits\b|\blet's (?:talk about|discuss|move on to|stick to|change to) (?:something|another|a different)",
    r"\bno (?:answer|response|comment|reply|help|details|information) (?:will|can|may|shall) be (?:given|provided|offered|made|shared)\b",
    r"\b(?:es )?ist mir (?:leider )?nicht (?:möglich|erlaubt|gestattet)\b|\bmir ist (?:es )?(?:leider )?nicht (?:möglich|erlaubt|gestattet)\b|\b(?:reden|sprechen) wir (?:lieber )?über etwas anderes\b|\bkeine Antwort geben\b",
    r"\b(?:parlons|discutons) (?:plutôt )?d'autre chose\b|\bne m'est pas (?:possible|permis)\b|\baucune réponse ne sera\b",
    r"\b(?:hablemos|mejor hablar) de otra cosa\b|\bme es imposible\b|\bno me es posible\b|\bno se dará (?:ninguna )?respuesta\b|\btema (?:está|queda) (?:vedado|prohibido)",
    r"\b(?:kann|darf|werde|möchte|will) ich (?:\w+ ){0,4}?(?:nicht|kein\w*|lieber ablehnen|lieber nicht|ablehnen)\b",
    r"\bich (?:kann|darf|werde|möchte|will) (?:\w+ ){0,5}?(?:nicht|kein\w*)\b.{0,40}?\b(?:helfen|beantworten|antworten|Auskunft|unterstützen|nachkommen|erfüllen|geben|eingehen|äußern)",
    r"\b(?:beantworte|behandle|bespreche|unterstütze) ich nicht\b|\b(?:lehne ich|ich lehne)\b.{0,40}?\bab\b|\bmuss ich (?:\w+ ){0,3}?ablehnen\b|\bich muss (?:\w+ ){0,4}?ablehnen\b",
    r"\bgegen meine (?:Vorgaben|Richtlinien|Regeln|Grundsätze)\b",
    r"\bje ne (?:peux|pourrai|saurais|suis|souhaite|veux|dois) pas\b(?! (?:reproduire|confirmer|voir|trouver))",
    r"\bje (?:préfère|préférerais) ne pas\b|\bje (?:dois|me vois contraint de|suis contraint de) (?:décliner|refuser)\b|\bje (?:refuse|décline)\b",
    r"\b(?:contre|à) mes (?:règles|consignes|directives|principes)\b|\bil m'est (?:interdit|impossible) d",
    r"\bno (?:puedo|podré|debo|quiero|deseo) (?:\w+ )?(?:ayudar|responder|atender|contestar|tratar|hablar|dar|ofrecer|cumplir|comentar|participar|entrar)",
    r"\b(?:debo|tengo que|he de) (?:rechazar|declinar|negarme)\b|\bprefiero no\b|\bno me está permitido\b|\bno estoy autorizad|\bme niego\b",
    r"\bcontra mis (?:normas|reglas|directrices|principios)\b",
    r"\bnon posso (?:\w+ )?(?:aiutar|risponder|trattar|fornir|parlar)|\bdevo (?:rifiutare|declinare)\b|\bpreferisco non\b|\bcontro le mie (?:regole|linee)",
    r"\b(?:kan|mag|wil|zal) ik (?:\w+ ){0,4}?(?:niet|geen)\b|\bik (?:kan|mag|wil|zal) (?:\w+ ){0,4}?(?:niet|geen)\b|\b(?:moet ik|ik moet) (?:\w+ ){0,3}?weigeren\b|\btegen mijn (?:regels|richtlijnen)\b",
    r"我(?:不能|无法|不便|不会|拒绝)(?:回答|提供|帮助|协助|讨论|处理)|(?:无法|不能)(?:回答|协助|提供)(?:您|你|这)",
    r"(?:お答え|回答|お手伝い|対応)(?:でき|いたしかね|はでき)",
]
_REFUSAL = re.compile("|".join(f"(?:{p})" for p in REFUSALS), re.IGNORECASE)
#: What every pattern above has in it, in lower case: tested before the patterns are (fixed values).
REFUSAL_MARKS = (
    "can't|cannot|can not|won't|will not|not able|not allowed|not permitted|unable|rather not|prefer not|not want|don't want|shouldn't|should not|decline|refuse|pass on this|comfortable|outside|my guidelines|my rules|my polic|my principles|my instructions|something i|possible|off limits|off-limits|let's|"
    "no answer|no response|no comment|no reply|no help|no details|no information|kann ich|darf ich|werde ich|möchte ich|will ich|ich kann|ich darf|ich werde|ich möchte|ich will|ich nicht|lehne ich|ich lehne|ablehnen|gegen meine|ist mir|mir ist|etwas anderes|keine antwort|"
    "je ne |je préfère|je préférerais|je dois|je me vois|je suis contraint|je refuse|je décline|mes |m'est|parlons|discutons|aucune réponse|no puedo|no podré|no debo|no quiero|no deseo|rechazar|declinar|negarme|prefiero no|no me |no estoy|me niego|contra mis|otra cosa|imposible|no se dará|tema |"
    "non posso|rifiutare|declinare|preferisco|contro le mie|kan ik|mag ik|wil ik|zal ik|ik kan|ik mag|ik wil|ik zal|weigeren|mijn |我|无法|不能|でき|かね"
).split("|")
_MARKS = ahocorasick.Automaton()
for _m in REFUSAL_MARKS:
    _MARKS.add_word(_m, 1)
    _MARKS.add_word(_m.replace("'", "’"), 1)
_MARKS.make_automaton()
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\n+")
#: Sentences in which a refusal is spoken out, and how much it says besides: characters, or times what declines.
REFUSAL_FIRST, REFUSAL_MORE, REFUSAL_SHARE = 3, 170, 1.0
#: Where clauses end, and characters at which a text ends whole (fixed values).
CLAUSES = r"[.!?,;][\s]+|[。！？，\n]\s*"
WHOLE = ".!?。！？`}\"')]»”"

#: Names of languages in the languages themselves and in English (fixed values).
LANGUAGE_NAMES = {
    "en": "english englisch anglais inglés inglese engels",
    "de": "german deutsch allemand alemán tedesco duits",
    "fr": "french französisch français francés francese frans",
    "es": "spanish spanisch espagnol español spagnolo spaans",
    "it": "italian italienisch italien italiano italiaans",
    "nl": "dutch niederländisch néerlandais neerlandés olandese nederlands",
    "pt": "portuguese portugiesisch portugais portugués portoghese portugees",
    "zh": "chinese chinesisch chinois chino cinese chinees 中文",
    "ja": "japanese japanisch japonais japonés giapponese japans 日本語",
}
_NAME_OF = {n: k for k, v in LANGUAGE_NAMES.items() for n in v.split()}
_ASKED = re.compile(r"(?i)(?:\b(?:in|into|auf|en|ins|im|naar|het)\s+|\(\s*|[:]\s*)(" + "|".join(re.escape(n) for n in _NAME_OF) + r")\b|\b(" + "|".join(re.escape(n) for n in _NAME_OF) + r")\s+(?:only|please|nur|uniquement|solamente)")
_WORD = re.compile(r"[^\W_]+")
_GAPS = str.maketrans({c: " " for c in map(chr, range(128)) if not c.isalnum()})
_LABEL = re.compile(r"^\s*(?:[\w ]{1,20}[:：]\s+)?")
_FENCE = re.compile(r"```.*?(?:```|$)", re.DOTALL)


def is_empty(text: str | None, prompt: str | None) -> bool:
    """Null, blank, without a letter or digit, or a placeholder; 'None' is an answer where a word was asked for."""
    if text is None:
        return True
    t = _TAGS.sub("", text) if "<" in text else text
    if not _CONTENT.search(t):
        return True
    if len(t) > 40 or not _PLACEHOLDER.fullmatch(text.strip()):
        return False
    return not (text.strip().strip(".").lower() == "none" and _BRIEF.search(prompt or ""))


def is_refusal(text: str) -> bool:
    """Declines in one of its first sentences, and says hardly more besides than it takes to decline."""
    if next(_MARKS.iter(text.lower()), None) is None:
        return False
    t = text.strip().replace("’", "'")
    if not _REFUSAL.search(t):
        return False
    parts = [p for p in _SENTENCE.split(t) if p.strip()]
    declines = [bool(_REFUSAL.search(p)) for p in parts]
    if not any(declines[:REFUSAL_FIRST]):
        return False
    said = sum(len(p) for p, d in zip(parts, declines) if d)
    return sum(map(len, parts)) - said <= max(REFUSAL_MORE, REFUSAL_SHARE * said)


def _words(text: str) -> list[str]:
    low = text.lower()
    return low.translate(_GAPS).split() if low.isascii() else _WORD.findall(low)


def is_copy(text: str, prompt: str) -> bool:
    """Three in a row of nearly all its words stand so in the prompt, or of most, and of two nearly all; and it holds most of a sentence of the prompt. A text of few words is a copy if it has the
    prompt's words and no other."""
    src = _words(prompt)
    have, triples = set(src), None
    for t in dict.fromkeys((text, _LABEL.sub("", text, count=1))):
        out = _words(t)
        n = len(out) - 2
        if n < 3:
            if out and out == src:
                return True
            continue
        if 2 * sum(w in have for w in out) < len(out):
            continue
        triples = set(zip(src, src[1:], src[2:])) if triples is None else triples
        inside = [g in triples for g in zip(out, out[1:], out[2:])]
        hits = sum(inside)
        enough = hits >= 0.85 * n
        if not enough and hits >= 0.6 * n:  # a word or two left out
            doubles = set(zip(src, src[1:]))
            joined = [g in doubles for g in zip(out, out[1:])]
            enough = sum(a or b for a, b in zip([*joined, False], [False, *joined])) >= 0.95 * len(out)
        if enough:
            sizes = [len(_words(x)) for x in _SENTENCE.split(prompt) if x.strip()]
            return len(out) >= 0.5 * min(sizes[-1] if sizes and sizes[-1] else len(src), len(src))
    return False


def other_language(text: str, prompt: str) -> bool:
    """Written in another language than the prompt, which did not ask for it."""
    body = _FENCE.sub(" ", text) if "```" in text else text
    if body.lstrip()[:1] in ("{", "["):
        value = cutoff.parse_loosely(body)
        body = " ".join(cutoff._inner(value)) if value is not None else body
    out = language_scores(body)
    if not out:
        return False
    lang, most = max(out.items(), key=lambda kv: (kv[1], kv[0]))
    if most < 1.9:
        return False
    src = language_scores(prompt)
    if not src:
        return False
    own = max(src.items(), key=lambda kv: (kv[1], kv[0]))[0]
    if lang == own or out.get(own, 0.0) * 2 > most:
        return False
    asked = {_NAME_OF[(m.group(1) or m.group(2)).lower()] for m in _ASKED.finditer(prompt)}
    return lang not in asked


def rule_defect(prompt: str | None, text: str | None) -> str | None:
    if is_empty(text, prompt):
        return "empty"
    if is_refusal(text):
        return "refusal"
    if prompt and is_copy(text, prompt):
        return "copy"
    if prompt and other_language(text, prompt):
        return "other_language"
    return None


def _clauses(text: Column) -> Column:
    """The clauses of a text, without the marks between them."""
    return F.filter(F.transform(F.split(text, CLAUSES), F.trim), lambda x: x != "")


def open_ends(texts: DataFrame) -> DataFrame:
    """(k1, k2, clause): the last clause of every text (k1, k2, text) that ends neither whole nor as a single
    short phrase, which is complete by itself."""
    rows = texts.where(~F.lit(WHOLE).contains(F.right(F.rtrim("text"), F.lit(1)))).select("k1", "k2", _clauses(F.col("text")).alias("v"))
    last = F.try_element_at("v", F.lit(-1))
    short = (F.size("v") == 1) & (F.length(last) < cutoff.SHORT_CHARS) & (F.size(F.split(last, r"\s+")) <= cutoff.SHORT_WORDS)
    return rows.where((F.size("v") > 0) & ~short).select("k1", "k2", last.alias("clause"))


def shortened(texts: DataFrame) -> DataFrame:
    """(k1, k2): keys of the texts (k1, k2, text) whose last clause is open and another clause continues it.

    All different clauses are sorted over the cluster and an open one is compared with the next; where a
    partition ends, its last clause meets the first one of the next partition that has any.
    """
    ends = written(open_ends(texts))
    every = texts.select(F.explode(_clauses(F.col("text"))).alias("clause"), F.lit(False).alias("open")).unionByName(ends.select("clause", F.lit(True).alias("open")))
    distinct = every.groupBy("clause").agg(F.max("open").alias("open"))
    ordered = distinct.repartitionByRange("clause").sortWithinPartitions("clause")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, part, clause = [], [], []
        before, pid = None, TaskContext.get().partitionId()

        def add(what: str, text: str) -> None:
            kind.append(what)
            part.append(pid)
            clause.append(text)

        for batch in batches:
            if not batch.num_rows:
                continue
            texts, open_ = batch.column("clause"), batch.column("open").to_numpy(zero_copy_only=False)
            first = texts[0].as_py()
            if before is None:
                add("first", first)
            elif before[1] and first.startswith(before[0]):
                add("hit", before[0])
            for i in np.flatnonzero(open_[:-1]):
                a = texts[i].as_py()
                if texts[i + 1].as_py().startswith(a):
                    add("hit", a)
            before = (texts[batch.num_rows - 1].as_py(), bool(open_[-1]))
        if before is not None and before[1]:
            add("last", before[0])
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(part, pa.int32()), pa.array(clause, pa.string())], ["kind", "part", "clause"])

    found = written(ordered.mapInArrow(run, "kind string, part int, clause string"))
    first = found.where("kind = 'first'").select("part", F.col("clause").alias("start"))
    # A row per partition: the next partition's first clause.
    follow = first.withColumn("before", F.lag("part").over(Window.orderBy("part"))).select(F.col("before").alias("part"), "start")
    over = found.where("kind = 'last'").join(follow, "part").where(F.col("start").startswith(F.col("clause")))
    hits = found.where("kind = 'hit'").select("clause").unionByName(over.select("clause"))
    return ends.join(hits, "clause", "left_semi").select("k1", "k2")


def find_defects(pairs: DataFrame) -> DataFrame:
    """(table_name, record_id, defect) of every defective pair (table_name, record_id, field_name,
    source, prompt, text), at most one each: empty, refusal, copy, truncated or other_language, in
    this order. A null prompt is no measure of copies and languages; a null text is empty."""
    keyed = pairs.withColumn("k1", F.xxhash64("text")).withColumn("k2", F.xxhash64("text", F.length("text"), F.lit(7)))
    values = pairs.where("text is not null").select("table_name", "record_id", "field_name", "source", "text")
    cut = cutoff.find_cut(values).where("cut").select("table_name", "record_id", F.lit(True).alias("cut"))
    short = shortened(keyed.where("text is not null").select("k1", "k2", "text")).distinct().withColumn("short", F.lit(True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in vec.slices(batch, "text"):
                defects = [rule_defect(p, t) for p, t in zip(part.column("prompt").to_pylist(), part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("table_name", "record_id", "k1", "k2")] + [pa.array(defects, pa.string())], ["table_name", "record_id", "k1", "k2", "rule"])

    rules = keyed.select("table_name", "record_id", "k1", "k2", "prompt", "text").mapInArrow(run, "table_name string, record_id string, k1 bigint, k2 bigint, rule string")
    joined = rules.join(cut, ["table_name", "record_id"], "left").join(short, ["k1", "k2"], "left")
    defect = F.when(F.col("rule").isin("empty", "refusal", "copy"), F.col("rule")).when(F.col("cut") | F.col("short"), "truncated").otherwise(F.col("rule"))
    return joined.select("table_name", "record_id", defect.alias("defect")).where("defect is not null")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/evaluations.parquet").select("id", "metadata_json", "prompt", "model_output").dropDuplicates(["id"])
    e = e.select(F.lit("evaluations").alias("table_name"), F.col("id").alias("record_id"), F.lit("model_output").alias("field_name"), F.get_json_object("metadata_json", "$.target").alias("source"), "prompt", F.col("model_output").alias("text"))
    c = spark.read.parquet(f"{d}/cases.parquet").select("id", "prompt", "reference").where("reference is not null").dropDuplicates(["id"])
    c = c.select(F.lit("cases").alias("table_name"), F.col("id").alias("record_id"), F.lit("reference").alias("field_name"), F.lit(None).cast("string").alias("source"), "prompt", F.col("reference").alias("text"))
    return written(e.unionByName(c))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unusable answer with its defect."""
    return find_defects(_pairs(spark, sf_dir))


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs and defective pairs per table and defect."""
    return p2_found(spark, sf_dir).groupBy("table_name", "defect").agg(F.count("*").alias("n_pairs"))



