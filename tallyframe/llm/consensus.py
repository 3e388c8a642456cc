"""Consensus of several annotators' labels by message passing between items and annotators.

The label edges carry messages both ways, one class against the rest: an item tells an annotator
how likely the class is by all its other annotators; an annotator tells an item how often, over all
its other items, it gave the class where the class held and where it did not. The rounds go on until
no message moves. Every round is one table of edges in the shared folder, which replaces the one before; sums
per item and per annotator are combined before their shuffle, and edges meet their annotator's sums in
SALTS parts, so no item and no annotator is gathered into a task, however many edges it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.shared import drop, written

#: Messages stand still if none changes by more. A guard: so many rounds without that are an error.
TOLERANCE, ROUNDS = 1e-6, 200
#: Weight of the pooled estimate in an annotator's own, in labels.
PRIOR = 4.0
#: First guess of how often the class is given where it holds, and where it doesn't.
START = (0.8, 0.2)
#: Parts in which an annotator's edges meet its sums, and steps of a score between 0 and 1.
SALTS, STEPS = 16, 20


def _clean(c: str) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(F.col(c), r"^[\s\p{Z}]+", ""), r"[\s\p{Z}]+$", ""))


def edges_of(reviews: DataFrame, id_col: str, item: str, annotator: str, label: str, positive: str, negative: str, score: str | None = None) -> DataFrame:
    """(item, annotator, y, readable): one edge per item and annotator; y is the share of `positive` among the
    annotator's labels of the item (an annotator that gave both labels equally often says nothing).

    A row delivered twice counts once; annotators and labels are compared without regard to case and
    outer white space; rows without item or annotator are left out. A row without a readable label but with a
    score says as much as that score does elsewhere: the share of `positive` among all labels with a score in the same
    of STEPS steps, scores over 1 taken as percent. It counts where the annotator has no label for the item, and is
    not `readable`. (Where there is a label, its score tells nothing more about the item.)
    """
    s = F.col(score).cast("double") if score else F.lit(None).cast("double")
    s = F.when(s > 1, s / 100).otherwise(s)
    step = F.when(s.between(0, 1), F.least(F.floor(s * STEPS), F.lit(STEPS - 1)).cast("int"))
    rows = reviews.select(F.col(id_col).alias("_id"), F.col(item).alias("item"), _clean(annotator).alias("annotator"), _clean(label).alias("label"), step.alias("step"))
    rows = rows.where(F.col("item").isNotNull() & (F.col("annotator") != "")).dropDuplicates(["_id"])
    given = F.when(F.col("label").isin(positive.lower(), negative.lower()), (F.col("label") == positive.lower()).cast("double"))
    rows = rows.select("item", "annotator", "step", given.alias("y"))
    told = rows
    if score:
        shares = rows.where("y is not null and step is not null").groupBy("step").agg(F.avg("y").alias("share"))  # at most STEPS rows
        told = rows.join(F.broadcast(shares), "step", "left")
    soft = F.when(F.col("y").isNull(), F.col("share")) if score else F.lit(None).cast("double")
    per = told.groupBy("item", "annotator").agg(F.avg("y").alias("y"), F.avg(soft).alias("soft"))
    return per.select("item", "annotator", F.coalesce("y", "soft").alias("y"), F.col("y").isNotNull().alias("readable")).where("y is not null")


def class_edges(labels: DataFrame, given: str) -> DataFrame:
    """Edges of one class against the rest, from (item, annotator, label): y is the share of the class among the
    annotator's labels of the item. A null label is left out."""
    return labels.where("label is not null").groupBy("item", "annotator").agg(F.avg((F.col("label") == given).cast("double")).alias("y"))


def consensus_classes(labels: DataFrame, classes: list[str]) -> tuple[DataFrame, DataFrame]:
    """(items, annotators) for labels (item, annotator, label) of several classes, each against the rest.

    items: (item, label, belief): the class believed most, the first of `classes` among equals, with its share of all
    classes' beliefs. annotators: (annotator, class, labels, given_if_true, given_if_false, reliability). With two
    classes the second is the mirror of the first and is not run. Items without a label of `classes` have no row."""
    known = labels.where(F.col("label").isin(*classes))
    items = people = None
    for i, c in enumerate(classes[:1] if len(classes) == 2 else classes):
        one, who = consensus(class_edges(known, c))
        one = one.select("item", F.lit(i).alias("k"), "belief")
        who = who.select("annotator", F.lit(c).alias("class"), "labels", "given_if_true", "given_if_false", "reliability")
        if len(classes) == 2:
            one = one.unionByName(one.select("item", F.lit(1).alias("k"), (1 - F.col("belief")).alias("belief")))
            who = who.unionByName(who.select("annotator", F.lit(classes[1]).alias("class"), "labels", (1 - F.col("given_if_false")).alias("given_if_true"), (1 - F.col("given_if_true")).alias("given_if_false"), "reliability"))
        items, people = (one, who) if items is None else (items.unionByName(one), people.unionByName(who))
    best = items.groupBy("item").agg(F.max_by(F.struct("k", "belief"), F.struct("belief", -F.col("k"))).alias("b"), F.sum("belief").alias("all"))
    name = F.element_at(F.array(*[F.lit(c) for c in classes]), F.col("b.k") + 1)
    return best.select("item", name.alias("label"), (F.col("b.belief") / F.col("all")).alias("belief")), people


def _evidence(a: Column, b: Column, y: Column) -> Column:
    """Log odds that a label y gives for the class, from an annotator's two rates."""
    return y * F.log(a / b) + (1 - y) * F.log((1 - a) / (1 - b))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), x))))


def _pooled() -> list[Column]:
    """Of the messages from items: their sum and the sum of those with a label, for the class and for the rest."""
    m, y = F.col("m"), F.col("y")
    return [F.sum(m).alias("p1"), F.sum(m * y).alias("h1"), F.sum(1 - m).alias("p0"), F.sum((1 - m) * y).alias("h0")]


def _sums(state: DataFrame) -> DataFrame:
    """Sums per annotator of the messages from items."""
    return state.groupBy("annotator").agg(F.count("*").alias("labels"), *_pooled())


def _rates(row) -> tuple[float, float, float]:
    """The pooled rates and the share of the class, from the sums over all edges."""
    p1, h1, p0, h0 = (row[c] or 0.0 for c in ("p1", "h1", "p0", "h0"))
    return (h1 + START[0]) / (p1 + 1), (h0 + START[1]) / (p0 + 1), (p1 + 1) / (p1 + p0 + 2)


def consensus(edges: DataFrame, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """(items, annotators) for edges (item, annotator, y).

    items: (item, belief, agreement, annotators): belief is the class's probability, agreement the
    share of the item's pairs of annotators with the same label (null for one annotator).
    annotators: (annotator, labels, given_if_true, given_if_false, reliability): reliability is the
    mean of given_if_true and 1 - given_if_false; 0.5 is a coin. No edges give empty tables.
    Raises if some message still moves after the rounds.
    """
    edges = written(edges.select("item", "annotator", "y"))
    votes = edges.groupBy("item").agg(F.sum("y").alias("s"), F.count("*").alias("n"))
    salted = F.pmod(F.xxhash64("item"), F.lit(SALTS)).alias("salt")
    start = _evidence(F.lit(START[0]), F.lit(START[1]), F.lit(1.0))
    others = 2 * (F.col("s") - F.col("y")) - (F.col("n") - 1)
    state = written(edges.join(votes, "item").select("item", "annotator", "y", salted, _sigmoid(others * start).alias("m"), F.lit(0.5).alias("a"), F.lit(0.5).alias("b")))
    drop(edges)
    pooled, moved = state.agg(*_pooled()).first(), None
    for _ in range(rounds):
        sums, (a0, b0, share) = written(_sums(state)), _rates(pooled)
        own = lambda h, p, m, base: F.greatest(F.lit(0.01), F.least(F.lit(0.99), (F.col(h) - m * F.col("y") + PRIOR * base) / (F.col(p) - m + PRIOR)))
        parts = sums.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
        told = state.join(parts, ["annotator", "salt"]).select(
            "item", "annotator", "y", "salt", F.col("m").alias("before"), own("h1", "p1", F.col("m"), a0).alias("a"), own("h0", "p0", 1 - F.col("m"), b0).alias("b")
        )
        told = told.withColumn("e", _evidence(F.col("a"), F.col("b"), F.col("y")))
        logit = F.log(F.lit(share) / (1 - F.lit(share)))
        total = told.groupBy("item").agg((F.sum("e") + logit).alias("t"))
        after = written(told.join(total, "item").select("item", "annotator", "y", "salt", _sigmoid(F.col("t") - F.col("e")).alias("m"), "a", "b", "before"))
        drop(state, sums)
        pooled = after.agg(F.max(F.abs(F.col("m") - F.col("before"))).alias("moved"), *_pooled()).first()
        moved = pooled["moved"]
        state = after
        if moved is None or moved < tolerance:
            break
    else:
        raise RuntimeError(f"consensus: messages still move by {moved} after {rounds} rounds")
    sums, (a0, b0, share) = _sums(state), _rates(pooled)
    final = lambda h, p, base: F.greatest(F.lit(0.01), F.least(F.lit(0.99), (F.col(h) + PRIOR * base) / (F.col(p) + PRIOR)))
    annotators = sums.select("annotator", "labels", final("h1", "p1", a0).alias("given_if_true"), final("h0", "p0", b0).alias("given_if_false"))
    annotators = annotators.withColumn("reliability", (F.col("given_if_true") + 1 - F.col("given_if_false")) / 2)
    logit = F.log(F.lit(share) / (1 - F.lit(share)))
    told = state.withColumn("e", _evidence(F.col("a"), F.col("b"), F.col("y")))
    n, s, q = F.col("n"), F.col("s"), F.col("q")
    items = told.groupBy("item").agg(_sigmoid(F.sum("e") + logit).alias("belief"), F.count("*").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y") + (1 - F.col("y")) * (1 - F.col("y"))).alias("q"))
    same = F.when(n > 1, (s * s + (n - s) * (n - s) - q) / (n * (n - 1)))
    return items.select("item", "belief", same.alias("agreement"), n.alias("annotators")), annotators


def agreement(edges: DataFrame) -> DataFrame:
    """One row (items, labels, observed, expected, alpha): observed and chance agreement over items
    with at least two annotators, and nominal alpha; all null but the counts where nothing is paired
    or only one label occurs (alpha)."""
    per = edges.groupBy("item").agg(F.sum("y").alias("s"), F.count("*").alias("n"), F.sum(2 * F.col("y") * (1 - F.col("y"))).alias("q")).where("n > 1")
    s, n = F.col("s"), F.col("n").cast("double")
    t = per.agg(F.count("*").alias("items"), F.sum("n").alias("labels"), F.sum((2 * s * (n - s) - F.col("q")) / (n - 1)).alias("d"), F.sum(s).alias("s"), F.sum(n).alias("n"))
    observed = F.try_divide(F.col("d"), F.col("n"))
    chance = F.try_divide(2 * s * (n - s), n * (n - 1))
    return t.select("items", F.coalesce("labels", F.lit(0)).alias("labels"), F.round(1 - observed, 9).alias("observed"), F.round(1 - chance, 9).alias("expected"), F.round(1 - F.try_divide(observed, chance), 9).alias("alpha"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return edges_of(spark.read.parquet(f"{d}/reviews.parquet"), "id", "evaluation_id", "reviewer", "verdict", "PASS", "FAIL", "score")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of every evaluation with readable verdicts of at least three reviewers; an even belief is FAIL."""
    edges = written(_edges(spark, sf_dir))
    items, _ = consensus(edges)
    enough = edges.where("readable").groupBy("item").agg(F.count("*").alias("n")).where("n >= 3").select("item")
    return items.join(enough, "item").select(F.col("item").alias("evaluation_id"), F.when(F.col("belief") > 0.5, "PASS").otherwise("FAIL").alias("verdict"))


def p4_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict, belief and agreement of every evaluation with a readable verdict or a score."""
    items, _ = consensus(_edges(spark, sf_dir))
    return items.select(F.col("item").alias("evaluation_id"), F.when(F.col("belief") > 0.5, "PASS").otherwise("FAIL").alias("verdict"), F.round("belief", 9).alias("belief"), F.round("agreement", 9).alias("agreement"), "annotators")


def p4_reviewers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reliability of every reviewer."""
    return consensus(_edges(spark, sf_dir))[1].withColumnRenamed("annotator", "reviewer")


def p4_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of the reviewers over all evaluations."""
    return agreement(_edges(spark, sf_dir).where("readable"))


ORACLE = {
    "p4_agreement": """
        WITH r AS (SELECT id, any_value(evaluation_id) AS item, any_value(lower(trim(reviewer))) AS annotator, any_value(lower(trim(verdict))) AS v FROM reviews GROUP BY id),
        e AS (SELECT item, annotator, avg(CASE WHEN v = 'pass' THEN 1.0 ELSE 0.0 END) AS y FROM r WHERE item IS NOT NULL AND annotator <> '' AND v IN ('pass', 'fail') GROUP BY item, annotator),
        p AS (SELECT item, sum(y) AS s, count(*)::DOUBLE AS n, sum(2 * y * (1 - y)) AS q FROM e GROUP BY item HAVING count(*) > 1),
        t AS (SELECT count(*) AS items, sum(n)::BIGINT AS labels, sum((2 * s * (n - s) - q) / (n - 1)) AS d, sum(s) AS s, sum(n) AS n FROM p)
        SELECT items, coalesce(labels, 0) AS labels, round(1 - d / n, 9) AS observed, round(1 - 2 * s * (n - s) / (n * (n - 1)), 9) AS expected,
            round(1 - (d / n) / (2 * s * (n - s) / (n * (n - 1))), 9) AS alpha FROM t"""
}
