"""Near duplicates: MinHash signatures, banding, verification, connected components.

Documents with one shingle set form a class, which goes on as one node. A node's signature is cut into
bands; nodes that agree in a band share a bucket. Two rounds find the links:

* Each node of a bucket is compared with one node of it, another one in each bucket. That joins large
  groups of copies with a number of pairs that grows with the nodes.
* In buckets that still hold several components, nodes of different components are compared in tiles of
  bounded size, signatures first and then sets, inside the task; only links that join components become
  rows. A pair is looked at in the first band in which it agrees.

Pairs whose signatures agree enough are verified on the full shingle sets. No bucket is capped. Two sets at
the threshold miss each other in all 32 bands of 4 with a chance of 5e-6, and a true link fails the signature
test with a chance below 1e-6.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeframe.llm.components import components
from wakeframe.llm.stored import in_batches, stored
from wakeframe.llm.words import SPACED, U, Words, blocks, mix, shingles, stream

WORDS = 5
PERCENT = 75
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
# Share of equal minima below which a pair is not verified: more than five standard errors under the threshold.
LEAST_ESTIMATE = 0.55
# Nodes of a block of a large bucket; two blocks meet in a task.
TILE = 512
_CHUNK = 1 << 14


def shingle_sets(column: pa.Array, width: int):
    """(first row, sorted distinct shingle hashes of each document) of an Arrow text column, in blocks."""
    for i, _, data, at in blocks(column):
        words = Words(data, at, SPACED)
        values, first = shingles(words.hash, words.first, width)
        yield i, [np.unique(values[a:z]) for a, z in zip(first, first[1:])]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The minima of HASHES universal hashes (multiply and add modulo 2^64, upper half) of each non-empty set."""
    mul, add = stream(11, HASHES) | U(1), stream(12, HASHES)
    out = np.zeros((len(sets), HASHES), "<u4")
    sizes = np.array([len(s) for s in sets])
    some = np.flatnonzero(sizes)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(some):
            z = at + max(1, int(np.searchsorted(np.cumsum(sizes[some[at : at + _CHUNK]]), _CHUNK, "right")))
            own = some[at:z]
            x = np.concatenate([sets[k] for k in own])
            starts = np.cumsum(sizes[own]) - sizes[own]
            h = np.empty_like(x)
            for k in range(HASHES):
                np.multiply(x, mul[k], out=h)
                np.add(h, add[k], out=h)
                out[own, k] = np.minimum.reduceat(h, starts) >> U(32)
            at = z
    return out


def _digest(s: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    with np.errstate(over="ignore"):
        return np.array([s.sum(dtype=U), mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U)], "<u8").tobytes()


def sign(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """(id, n, digest, signature) of documents (id, text); digest and signature are null for an empty set."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for i, sets in shingle_sets(batch.column(1), width):
                full = [len(s) > 0 for s in sets]
                minima = signatures(sets)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(i, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_digest(s) if f else None for s, f in zip(sets, full)], pa.binary()),
                        pa.array([m.tobytes() if f else None for m, f in zip(minima, full)], pa.binary()),
                    ],
                    ["id", "n", "digest", "signature"],
                )

    return in_batches(docs, run, "id bigint, n bigint, digest binary, signature binary")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(id, shingles BINARY) of documents (id, text)."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for i, sets in shingle_sets(batch.column(1), width):
                data = pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([ids.slice(i, len(sets)), data], ["id", "shingles"])

    return in_batches(docs, run, "id bigint, shingles binary")


def _alike(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures agree enough."""

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(-1, HASHES) for c in (2, 3))
            good = pa.array((x == y).mean(axis=1) >= LEAST_ESTIMATE)
            yield batch.select([0, 1]).filter(good)

    own = nodes.select("node", "signature")
    both = pairs.join(own.toDF("a", "x"), "a").join(own.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return in_batches(both, run, "a bigint, b bigint").distinct()


def _linked(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sets."""
    if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
        return False
    both = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * both >= percent * (len(p) + len(q) - both)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that are linked by their full sets."""

    def run(batches):
        for batch in batches:
            good = [_linked(np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8"), percent) for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return in_batches(both, run, "a bigint, b bigint").distinct()


def _buckets(nodes: DataFrame) -> DataFrame:
    """(key, band, node, head, size) of buckets with several nodes; the head is one of them, another one for each key."""
    keys = F.array(*[F.xxhash64(F.lit(k), F.substring("signature", 4 * ROWS * k + 1, 4 * ROWS)) for k in range(BANDS)])
    rows = nodes.select(F.posexplode(keys).alias("band", "key"), "node")
    mask = F.xxhash64("key")
    heads = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min(F.col("node").bitwiseXOR(mask)).alias("least"))
    shared = heads.filter(F.col("size") > 1).select("key", F.col("least").bitwiseXOR(mask).alias("head"), "size")
    return rows.join(shared, "key")


def _tile_links(first: bool, mine, i: int, band: int, node, component, minima, sets, percent: int):
    """Links (a, b) that join components of one tile: block ``i`` with itself (``first``) or with the other block."""
    root = component.copy()
    left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == i) if first else np.flatnonzero(mine != i)
    for k in left.tolist():
        others = right[right > k] if first else right
        others = others[root[others] != root[k]]
        if not len(others):
            continue
        same = minima[others] == minima[k]
        near = same.mean(axis=1) >= LEAST_ESTIMATE
        agreed = same[near].reshape(-1, BANDS, ROWS).all(axis=2)
        for o in others[near][agreed.argmax(axis=1) == band].tolist():
            if root[o] != root[k] and _linked(sets[k], sets[o], percent):
                yield min(int(node[k]), int(node[o])), max(int(node[k]), int(node[o]))
                root[root == root[o]] = root[k]


def _across(open_rows: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between nodes of different components that share an open bucket, enough to join all that are linked.

    ``open_rows`` is (key, band, node, component, size). A bucket of more than TILE nodes is cut into blocks,
    and each pair of blocks is a tile; a node goes to one tile for each block of its bucket.
    """
    cut = F.ceil(F.col("size") / TILE).cast("int")
    block = F.pmod(F.xxhash64("node"), cut).cast("int")
    tagged = open_rows.withColumns({"blocks": cut, "mine": block})
    tiles = tagged.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = tiles.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "band", "node", "component")
    own = nodes.select("node", "signature").join(sets.withColumnRenamed("id", "node"), "node")
    order = ["key", "i", "j"]
    rows = placed.join(own, "node").repartition(*order).sortWithinPartitions(*order)
    rows = rows.select(*order, "mine", "band", "node", "component", "signature", "shingles")

    def run(batches):
        rest = None
        for batch in batches:
            rest = yield from tiles_of(batch if rest is None else pa.concat_batches([rest, batch]), False)
        if rest is not None:
            yield from tiles_of(rest, True)

    def tiles_of(batch, last):
        """Links of the tiles that end in the batch; the rows after the last end."""
        if not batch.num_rows:
            return None
        key, i, j, mine, band, node, component = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(7))
        turn = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        bounds = [0, *turn.tolist(), *([len(key)] if last else [])]
        found = []
        for a, z in zip(bounds, bounds[1:]):
            part = slice(a, z)
            minima = np.frombuffer(b"".join(batch.column(7).slice(a, z - a).to_pylist()), "<u4").reshape(-1, HASHES)
            full = [np.frombuffer(x, "<u8") for x in batch.column(8).slice(a, z - a).to_pylist()]
            found += _tile_links(i[a] == j[a], mine[part], i[a], band[a], node[part], component[part], minima, full, percent)
        if found:
            a, b = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        return None if last else batch.slice(bounds[-1])

    return in_batches(rows, run, "a bigint, b bigint").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs``.

    A document's set holds its distinct runs of ``width`` words (between ASCII white space, A-Z in lower
    case), or its whole sequence if it has fewer words. Documents are linked when 100 * intersection >=
    percent * union, and component_id is the smallest id in reach. A null or empty text and one without words
    has an empty set and is linked with nothing. Ids are integers; a row without an id is linked with nothing
    (component_id is null, kept is true). Rows that repeat an id are placed by their texts; classes with the
    same smallest id count as one. Other columns are not read. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    signed = stored(sign(rows, width), "signatures")
    full = signed.filter(F.col("id").isNotNull() & F.col("digest").isNotNull())
    classes = full.groupBy("digest").agg(F.min("id").alias("node"), F.max("signature").alias("signature"))
    nodes = stored(classes, "nodes")
    buckets = stored(_buckets(nodes), "buckets")

    needed = buckets.select(F.col("node").alias("id")).distinct()
    sets = stored(_sets(rows.join(needed, "id", "left_semi"), width), "sets")
    to_head = buckets.filter(F.col("node") != F.col("head")).select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b"))
    first = components(_verified(_alike(to_head.distinct(), nodes), sets, percent))

    known = first.withColumnRenamed("component", "to")
    placed = buckets.join(known, "node", "left").select("key", "band", "node", F.coalesce("to", "node").alias("component"), "size")
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key")
    across = _across(placed.join(mixed, "key", "left_semi"), nodes, sets, percent)
    label = {c: known.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")) for c in "ab"}
    between = across.join(label["a"], "a", "left").join(label["b"], "b", "left")
    second = components(between.select(F.coalesce("a_to", "a").alias("a"), F.coalesce("b_to", "b").alias("b"))).toDF("middle", "last")

    ends = signed.select("id", "n", "digest").join(nodes.select("digest", "node"), "digest", "left")
    ends = ends.join(known, "node", "left").withColumn("middle", F.coalesce("to", "node")).join(second, "middle", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("last", "middle", "id"))
    return ends.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
