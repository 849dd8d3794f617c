"""How filters interact: what each removes, in whatever order they run.

A document is reduced to the set of filters that it fails. Orders of k filters are paths through the lattice of
filter subsets: a state is the set of filters that ran, an edge lets one more run. What an edge removes, keeps
and finds removed depends on nothing but the state it leaves, so k * 2^(k-1) edges hold all k! orders. Counting the
paths from the start to a state (forward) and from it to the end (backward) tells how many orders take an
edge; weighting its removals by that gives the Shapley sums, and the steps of each order are read off the same edges.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeframe.llm.stored import in_batches, stored
from wakeframe.llm.words import SPACED, Words, blocks, stream

MIN_WORDS = 200
DISTINCT_PERCENT = 50
UPPER_PERCENT = 3
SIGNS = b"#$%&*|"
FILTERS = "ABCDE"

_CASED = stream(41, 256)


def _by_document(hit: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(hit)])[at])


def _masks(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bits of the filters A to D that each document of a block fails."""
    w = Words(data, at, SPACED, _CASED)
    words = np.diff(w.first)
    distinct = np.zeros(len(words), np.int64)
    for d in np.flatnonzero(words):
        own = np.sort(w.hash[w.first[d] : w.first[d + 1]])
        distinct[d] = 1 + np.count_nonzero(own[1:] != own[:-1])
    chars = np.diff(at) - _by_document((data & 0xC0) == 0x80, at)
    upper = _by_document((data >= 0x41) & (data <= 0x5A), at)
    signs = _by_document(np.isin(data, np.frombuffer(SIGNS, np.uint8)), at)
    fails = [words < MIN_WORDS, 100 * distinct < DISTINCT_PERCENT * words, 100 * upper > UPPER_PERCENT * chars, signs > 0]
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails))


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask INT, n): documents by the filters that they fail, bit k for the k-th of FILTERS.

    Rows that agree in all of it are counted together. The last filter finds texts that a smaller id has too: per
    text the smallest id is aggregated, and joined to (text, id), so that no copies of one text meet in one task.
    """

    def run(batches):
        for batch in batches:
            for i, j, data, at in blocks(batch.column(3)):
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(_masks(data, at))], ["doc_id", "part", "digest", "mask"])

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text.alias("text")
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    known = stored(in_batches(rows, run, f"doc_id {kind}, part string, digest binary, mask int"), "failures")
    counted = known.groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    later = F.col("doc_id").isNotNull() & F.col("first").isNull()
    mask = F.col("mask") + F.when(later, 1 << FILTERS.index("E")).otherwise(0)
    return counted.join(first, ["doc_id", "digest"], "left").select("doc_id", "part", mask.alias("mask"), "n")


def paths(k: int) -> tuple[list[int], list[int]]:
    """For each subset of k filters: the number of orders that reach it, and of ways to go on from it to the end."""
    full = (1 << k) - 1
    reach, leave = [0] * (full + 1), [0] * (full + 1)
    reach[0] = leave[full] = 1
    for state in range(full + 1):
        for f in range(k):
            if not state >> f & 1:
                reach[state | 1 << f] += reach[state]
    for state in range(full, -1, -1):
        for f in range(k):
            if state >> f & 1:
                leave[state ^ 1 << f] += leave[state]
    return reach, leave


def edges(cells: DataFrame, k: int) -> DataFrame:
    """What every edge of the lattice does to each part, from (part, mask, n, good, toxic) of documents by failures.

    (part, state, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): ``state`` holds the
    filters that ran before ``filter`` (both as bits). A part has all edges, also those that remove nothing.
    """
    reach, leave = paths(k)
    steps = [(s, 1 << f, reach[s] * leave[s | 1 << f]) for s in range(1 << k) for f in range(k) if not s >> f & 1]
    table = F.array(*[F.struct(F.lit(s).alias("state"), F.lit(f).alias("filter"), F.lit(p).alias("paths")) for s, f, p in steps])
    every = cells.select("*", F.inline(table))
    fails, ran = F.col("mask").bitwiseAND(F.col("filter")) != 0, F.col("mask").bitwiseAND(F.col("state")) != 0
    total = lambda hit, what="n": F.coalesce(F.sum(F.when(hit, F.col(what))), F.lit(0)).cast("bigint")
    summed = every.groupBy("part", "state", "filter").agg(
        total(~fails & ~ran).alias("kept"), total(fails & ~ran).alias("removed"), total(fails & ran).alias("redundant"),
        total(F.col("mask") == F.col("filter")).alias("unique_fails"), total(fails & ~ran, "good").alias("good_lost"),
        total(fails & ~ran, "toxic").alias("toxic_lost"), F.first("paths").alias("paths"),
    )
    value = summed.groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("paths")).alias("shapley"))
    return summed.drop("paths").join(value, ["part", "filter"])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (language), order of FILTERS and step; a null language is ''.

    (part, filter_order, step INT, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley BIGINT). Of a part's
    documents: those left after the step; removed in it; failing its filter but removed before; failing its filter
    alone; removed in it though of quality 1, or toxic; and what the filter removes, summed over all orders. A null
    text is empty. Rows that repeat an id are documents of their own; a row without one is no later copy of any text
    and has no labels. A document is good or toxic if any of its labels says so. An empty table gives no rows; other
    columns are not read.
    """
    known = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c)
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(known("quality"), known("toxic"))
    marked = failures(docs).join(marks, "doc_id", "left")
    share = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("n"))), F.lit(0))
    cells = marked.groupBy("part", "mask").agg(F.sum("n").alias("n"), share("quality").alias("good"), share("toxic").alias("toxic"))
    orders = [
        ("".join(order), step + 1, sum(1 << FILTERS.index(f) for f in order[:step]), 1 << FILTERS.index(order[step]))
        for order in permutations(FILTERS)
        for step in range(len(order))
    ]
    table = docs.sparkSession.createDataFrame(orders, "filter_order string, step int, state int, filter int")
    columns = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    # 600 rows, whatever the data.
    return edges(cells, len(FILTERS)).join(F.broadcast(table), ["state", "filter"]).select("part", "filter_order", "step", *columns)
