"""Quality: a sparse ensemble of rules over statistics of a text.

Statistics are Column expressions: shares of characters, words and lines, all
from whole texts.  A random forest of shallow trees is grown on a bounded
sample of labelled rows; each path from a root to a node is a rule, that some
statistics lie within bounds.  A logistic regression under an L1 penalty gives
most rules no weight.  What stays is compiled to one Column, so documents are
scored without Python, a join or a shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import add, and_

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored


@dataclass(frozen=True)
class Settings:
    trees: int = 40
    depth: int = 3
    l1: float = 0.002
    max_rows: int = 20_000  # labelled rows that are learned from, drawn by a hash of doc_id
    seed: int = 42


def statistics(text: Column) -> dict[str, Column]:
    """What is measured of a text; null counts as empty, a share of nothing is 0."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.split(text, "\n")
    found = lambda pattern: F.regexp_count(text, F.lit(pattern))
    share = lambda part, whole: F.coalesce(F.try_divide(part, whole), F.lit(0.0)).cast("double")
    chars, n_words = F.char_length(text), F.size(words)
    return {
        "words": n_words.cast("double"),
        "word_length": share(chars, n_words),
        "words_in_line": share(n_words, F.size(lines)),
        "distinct_words": share(F.size(F.array_distinct(words)), n_words),
        "distinct_lines": share(F.size(F.array_distinct(lines)), F.size(lines)),
        "repeated_words": share(found(r"(?<!\S)(\S++)\s+\1(?!\S)"), n_words),
        "capitals": share(found(r"\p{Lu}"), chars),
        "capital_words": share(found(r"(?<!\S)\p{Lu}"), n_words),
        "digits": share(found(r"[0-9]"), chars),
        "symbols": share(found(r"[^\p{L}\p{N}\s.,;:!?'\"-]"), chars),
        "shouts": share(found(r"[!?]"), n_words),
        "stops": share(found(r"[.!?](?!\S)"), n_words),
        "commas": share(found(r"[,;:](?!\S)"), n_words),
        "short_words": share(found(r"(?<!\S)\S{1,3}(?!\S)"), n_words),
        "links": share(found(r"(?i)https?:|www\.|<[a-z/]|@\w"), n_words),
    }


#: Their names, in the order of the features.
STATISTICS = (
    "words", "word_length", "words_in_line", "distinct_words", "distinct_lines", "repeated_words", "capitals", "capital_words",
    "digits", "symbols", "shouts", "stops", "commas", "short_words", "links",
)


@dataclass(frozen=True)
class Rule:
    """Bounds (statistic, low, high): low < value <= high, all at once."""

    bounds: tuple[tuple[str, float, float], ...]

    def column(self, of: dict[str, Column]) -> Column:
        sides = [of[k] > low for k, low, _ in self.bounds if low > -math.inf] + [of[k] <= high for k, _, high in self.bounds if high < math.inf]
        return reduce(and_, sides)

    def __str__(self) -> str:
        return " and ".join(f"{low:.4g} < {k} <= {high:.4g}" for k, low, high in self.bounds)


@dataclass(frozen=True)
class Model:
    """The logit is ``bias`` and the weights of the rules that hold."""

    bias: float
    weights: dict[Rule, float]

    def score(self, of: dict[str, Column]) -> Column:
        logit = reduce(add, (F.when(r.column(of), F.lit(w)).otherwise(F.lit(0.0)) for r, w in self.weights.items()), F.lit(self.bias))
        return 1 / (1 + F.exp(-F.least(F.greatest(logit, F.lit(-35.0)), F.lit(35.0))))


def paths(node, bounds: dict[str, tuple[float, float]]) -> list[Rule]:
    """The rules of all nodes below one of a forest's trees."""
    if node.subtreeDepth() == 0:
        return []
    split = node.split()
    name, cut = STATISTICS[split.featureIndex()], split.threshold()
    low, high = bounds.get(name, (-math.inf, math.inf))
    out = []
    for child, own in ((node.leftChild(), (low, min(high, cut))), (node.rightChild(), (max(low, cut), high))):
        inside = bounds | {name: own}
        out += [Rule(tuple(sorted((k, a, b) for k, (a, b) in inside.items()))), *paths(child, inside)]
    return out


def train(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Model:
    """Fits the model on the texts of ``docs`` (doc_id, text) that ``labels``
    (doc_id, label 0 or 1) marks.

    Of more than ``max_rows`` labels about that many are drawn by a hash of
    doc_id.  Null labels and labels without a document don't count; any label
    but 0 is 1; a doc_id that is labelled again counts once, as 0 if any of
    its labels is; documents that repeat a doc_id count each.  Without both
    labels no rule is learned: the score is the share of label 1, drawn one
    row of each label towards a half.
    """
    s = settings or Settings()
    known = labels.where("label IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id"), (F.col("label") != 0).cast("int").alias("label"))
    known = stored(known.groupBy("_id").agg(F.min("label").cast("double").alias("label")), "quality-labels")
    total = known.count()
    drawn = known.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < (1 << 20) * s.max_rows / max(total, 1))
    # about max_rows numbers, whatever the corpus: the documents are only scanned
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("_id"))
    rows = stored(rows.select("label", *(c.alias(k) for k, c in statistics(F.col("text")).items())), "quality-statistics")
    n, good = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if good in (0, n):
        return Model(math.log((good + 1) / (n - good + 1)), {})
    numbers = rows.select("label", array_to_vector(F.array(*STATISTICS)).alias("features"))
    forest = RandomForestClassifier(numTrees=s.trees, maxDepth=s.depth, maxBins=64, featureSubsetStrategy="sqrt", seed=s.seed).fit(numbers)
    rules = list(dict.fromkeys(r for tree in forest.trees for r in paths(tree._java_obj.rootNode(), {})))
    if not rules:
        return Model(math.log(good / (n - good)), {})
    of = {k: F.col(k) for k in STATISTICS}
    held = rows.select("label", array_to_vector(F.array(*(r.column(of).cast("double") for r in rules))).alias("features"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=s.l1, maxIter=200).fit(held)
    return Model(lasso.intercept, {r: w for r, w in zip(rules, lasso.coefficients.toArray().tolist(), strict=True) if w})


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with ``score``, the probability of label 1, from whole
    texts alone; all columns stay but for one of that name.  Null and empty
    texts are scored by their statistics; repeated rows are scored each."""
    docs = docs.drop("score")
    names = {k: k for k in STATISTICS}
    while taken := names.keys() & {k for k, c in names.items() if c.lower() in map(str.lower, docs.columns)}:
        names |= {k: f"_{names[k]}" for k in taken}
    measured = docs.select("*", *(c.alias(names[k]) for k, c in statistics(F.col("text")).items()))
    return measured.select(*(F.col(f"`{c}`") for c in docs.columns), model.score({k: F.col(c) for k, c in names.items()}).alias("score"))
