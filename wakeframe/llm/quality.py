"""Quality by a sparse rule ensemble over text statistics.

Statistics of a text (numbers per document, counted in Arrow batches) go to shallow trees on a bounded
sample of labelled rows. Every path from a root gives a rule, a conjunction of bounds; a logistic model
with an L1 penalty keeps few of them. The model is then nothing but those rules and weights, and scores
as a Spark column expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from wakeframe.llm.stored import in_batches, stored
from wakeframe.llm.words import SPACED, Words, blocks, shingles

# Labelled rows that a model is fitted on, at most: those whose id has the smallest hash.
SAMPLE_ROWS = 20_000
TREES, DEPTH, L1 = 20, 3, 0.0005
MIN_NODE = 20

_CLASSES = ["upper", "lower", "digit", "space", "feed", "stop", "exclaim", "bar", "sign", "foreign", "rest"]


def _byte_classes() -> np.ndarray:
    t = np.full(256, _CLASSES.index("rest"), np.int64)
    groups = {
        "upper": range(0x41, 0x5B), "lower": range(0x61, 0x7B), "digit": range(0x30, 0x3A), "space": b" \t\r\x0b\x0c", "feed": b"\n",
        "stop": b".,;:?'\"()-", "exclaim": b"!", "bar": b"|", "sign": b"#$%&*@^~_+=<>/\\{}[]`", "foreign": range(0xC0, 0x100),
    }
    for name, codes in groups.items():
        t[list(codes)] = _CLASSES.index(name)
    return t


STATISTICS = [
    "words", "word_length", "upper", "digit", "stop", "exclaim", "bar", "sign", "foreign", "space", "line_words", "distinct_words",
    "distinct_runs", "variety", "top_word", "signed_words", "capital_words",
]


def _statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each document of a block."""
    n, kinds = len(at) - 1, len(_CLASSES)
    size = np.diff(at)
    doc = np.repeat(np.arange(n), size)
    counts = np.bincount(doc * kinds + _byte_classes()[data], minlength=n * kinds).reshape(n, kinds).astype(float)
    c = dict(zip(_CLASSES, counts.T))
    continued = np.bincount(doc, (data >= 0x80) & (data < 0xC0), minlength=n) if len(data) else np.zeros(n)
    chars = np.maximum(size - continued, 1)
    w = Words(data, at, SPACED)
    words = np.diff(w.first)
    some = np.maximum(words, 1)
    runs, run_first = shingles(w.hash, w.first, 3)
    distinct, distinct_runs, top = np.zeros(n), np.zeros(n), np.zeros(n)
    for d in np.flatnonzero(words):
        ranked = np.sort(w.hash[w.first[d] : w.first[d + 1]])
        turns = np.append(np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])), len(ranked))
        distinct[d], top[d] = len(turns) - 1, np.diff(turns).max()
        own = np.sort(runs[run_first[d] : run_first[d + 1]])
        distinct_runs[d] = (1 + np.count_nonzero(own[1:] != own[:-1])) / len(own)
    owner = np.repeat(np.arange(n), words)
    letters = np.maximum(c["upper"] + c["lower"] + c["foreign"], 1)
    if len(w.start):
        table = _byte_classes()
        first, last = table[data[w.start]], table[data[w.end - 1]]
        signed = np.bincount(owner, last == _CLASSES.index("sign"), minlength=n)
        capital = np.bincount(owner, first == _CLASSES.index("upper"), minlength=n)
    else:
        signed = capital = np.zeros(n)
    return np.column_stack(
        [
            np.log1p(words), (chars - c["space"] - c["feed"]) / some, c["upper"] / letters, c["digit"] / chars, c["stop"] / chars,
            c["exclaim"] / chars, c["bar"] / chars, c["sign"] / chars, c["foreign"] / letters, c["space"] / chars, words / (c["feed"] + 1),
            distinct / some, distinct_runs, np.log1p(distinct) / np.log1p(some), top / some, signed / some, capital / some,
        ]
    )


def with_statistics(docs: DataFrame, text_col: str = "text", name: str = "statistics") -> DataFrame:
    """``docs`` with a struct of STATISTICS (doubles, never null; a null text counts as empty). No shuffle."""
    place = docs.columns.index(text_col)
    kind = StructType([StructField(s, DoubleType()) for s in STATISTICS])

    def run(batches):
        for batch in batches:
            for i, j, data, at in blocks(batch.column(place)):
                table = _statistics(data, at)
                arrays = [pa.array(np.ascontiguousarray(col)) for col in table.T]
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.StructArray.from_arrays(arrays, STATISTICS)], [*part.schema.names, name])

    if name in docs.columns:
        raise ValueError(f"there is a column {name} already")
    return in_batches(docs, run, StructType([*docs.schema.fields, StructField(name, kind)]))


@dataclass(frozen=True)
class Rules:
    """Conjunctions of bounds (low < statistic <= high) with weights, and an intercept: a whole model."""

    intercept: float
    weights: tuple[float, ...] = ()
    bounds: tuple[tuple[tuple[str, float, float], ...], ...] = ()

    def score(self, statistics: str = "statistics") -> Column:
        total = F.lit(self.intercept)
        for weight, rule in zip(self.weights, self.bounds):
            total = total + F.when(_holds(rule, statistics), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def lines(self) -> list[str]:
        """The rules in words, heaviest first."""
        text = [(w, " and ".join(f"{low:.4g} < {s} <= {high:.4g}" for s, low, high in rule)) for w, rule in zip(self.weights, self.bounds)]
        return [f"{w:+.3f}  {t}" for w, t in sorted(text, key=lambda x: -abs(x[0]))]


def _holds(rule, statistics: str) -> Column:
    out = F.lit(True)
    for s, low, high in rule:
        value = F.col(statistics)[s]
        if low > float("-inf"):
            out = out & (value > low)
        if high < float("inf"):
            out = out & (value <= high)
    return out


def _paths(node, bounds: dict[int, tuple[float, float]]):
    """Bounds on the way to every node below the root."""
    if bounds:
        yield tuple((STATISTICS[k], *b) for k, b in sorted(bounds.items()))
    if node.subtreeDepth():
        k, cut = node.split().featureIndex(), node.split().threshold()
        low, high = bounds.get(k, (float("-inf"), float("inf")))
        yield from _paths(node.leftChild(), bounds | {k: (low, min(high, cut))})
        yield from _paths(node.rightChild(), bounds | {k: (max(low, cut), high)})


def fit(sample: DataFrame, seed: int = 17) -> Rules:
    """Rules from (statistics, label 0/1). With one class or no rows, the smoothed share of label 1."""
    total, positive = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if positive in (0, total):
        share = (positive + 1) / (total + 2)
        return Rules(float(np.log(share / (1 - share))))
    as_vector = lambda cols: array_to_vector(F.array(*cols))
    rows = sample.select(F.col("label").cast("double").alias("label"), "statistics").withColumn(
        "features", as_vector([F.col("statistics")[s] for s in STATISTICS])
    )
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=MIN_NODE, featureSubsetStrategy="onethird", seed=seed)
    rules = sorted({p for t in forest.fit(rows).trees for p in _paths(t._call_java("rootNode"), {})})
    if not rules:
        share = (positive + 1) / (total + 2)
        return Rules(float(np.log(share / (1 - share))))
    matrix = rows.select("label", as_vector([_holds(r, "statistics").cast("double") for r in rules]).alias("features"))
    model = LogisticRegression(regParam=L1, elasticNetParam=1.0, maxIter=60, standardization=False).fit(matrix)
    kept = [(float(w), r) for w, r in zip(model.coefficients.toArray(), rules) if w]
    return Rules(float(model.intercept), tuple(w for w, _ in kept), tuple(r for _, r in kept))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = SAMPLE_ROWS) -> Rules:
    """Rules for ``label_col``, from at most ``rows`` labelled rows (a bound for the broadcast as well).

    Labels other than 0 and 1 do not count. Of more labelled rows, those whose id hashes lowest are taken.
    Only the text is an input of the score.
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    picked = known.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label")).orderBy(F.xxhash64("_id"), "label").limit(rows)
    joined = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "_id").select("_id", "label", "text")
    sample = stored(with_statistics(joined).drop("text"), "quality-sample")
    # One partition in a fixed order, so that the same rows give the same model.
    return fit(sample.orderBy(F.xxhash64("_id"), "label").coalesce(1).drop("_id"))


def score(docs: DataFrame, rules: Rules, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with ``name`` DOUBLE between 0 and 1, for every row, also empty and null texts. No shuffle.

    Other columns pass through; a column called ``name`` is replaced. An empty table gives no rows.
    """
    own = "statistics"
    while own in docs.columns:
        own += "_"
    return with_statistics(docs, text_col, own).withColumn(name, rules.score(own)).drop(own)
