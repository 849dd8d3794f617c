"""How far the sources of a language are from each other, in the words that they use.

First the documents that hold each term are counted; a language keeps the terms of at least ``MIN_DOCS``. Kept
terms, sorted by range, become minimal transducers of bounded size (parts). Then the whole text streams through
them: a task walks the distinct words of a batch through the parts, and what is counted and shuffled from there
on are ordinals. Ordinals rank like the terms' bytes, so they break ties too, and the few terms of the result are
read off the transducers again.

Tasks read the parts from the shared folder, as Spark committed them, and keep some of them; nothing of the
vocabulary but one row a part goes through the driver.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from wakeframe.llm.stored import in_batches, stored
from wakeframe.llm.transducer import Builder, Transducer
from wakeframe.llm.words import Words, blocks, per_process
from wakeframe.session import qualified, scratch

MIN_DOCS = 3
TOP = 200
UNIT = 1_000_000_000
# A part of the vocabulary ends at so many terms or bytes of terms; a worker keeps parts of so many bytes.
PART_TERMS = 1 << 17
PART_BYTES = 8 << 20
KEPT_BYTES = 256 << 20
# Counts that a task adds up before it passes them on.
HELD_ROWS = 1 << 20
HELD_BYTES = 64 << 20
# More than a language's terms.
ORDINALS = 1 << 40
# Pairs of groups that a task works out at a time.
PAIRS = 1 << 21

LETTERS = np.zeros(256, bool)
LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _known(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])


class _Block:
    """Distinct words of some documents: ``key`` (64-bit hash), ``start``, ``end`` in ``data``; and for each word of the text, which it is."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        found = Words(data, at, LETTERS)
        self.key, where, self.which = np.unique(found.hash, return_index=True, return_inverse=True)
        self.data = _LOWER[data]
        self.start, self.end = found.start[where], found.end[where]
        self.owner = np.repeat(np.arange(len(at) - 1), np.diff(found.first))

    def counts(self, group: np.ndarray, once: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(group, word, number) over documents of known group: of occurrences, or of documents (``once``)."""
        size = max(1, len(self.start))
        owner, which = self.owner, self.which
        if once:
            owner, which = np.divmod(np.unique(owner * size + which), size)
        keys, n = np.unique(group[owner] * size + which, return_counts=True)
        return *np.divmod(keys, size), n


def _dealt(*columns: pa.Array) -> tuple[list[tuple], np.ndarray]:
    """Distinct rows of some string columns, and for each row which of them it is."""
    rows = list(zip(*[c.to_pylist() for c in columns]))
    place = {r: k for k, r in enumerate(dict.fromkeys(rows))}
    return list(place), np.array([place[r] for r in rows], np.int64)


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    raw = data.tobytes()
    return pa.array([raw[a:z] for a, z in zip(start.tolist(), end.tolist())], pa.binary()).cast(pa.string())


def _summed(values: np.ndarray, place: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    np.add.at(out, place, values)
    return out


def _sliced(columns: list[pa.Array], names: list[str], rows: int = 1 << 16):
    whole = pa.RecordBatch.from_arrays(columns, names)
    for i in range(0, whole.num_rows, rows):
        yield whole.slice(i, rows)


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term): terms that at least ``min_docs`` documents of their language hold."""

    def run(batches):
        held: dict[str, list[tuple]] = {}

        def out():
            for name, parts in held.items():
                keys, docs, terms = parts[0] if len(parts) == 1 else merged(parts)
                yield from _sliced([pa.array([name]).take(pa.array(np.zeros(len(keys), np.int64))), terms, pa.array(docs)], ["lang", "term", "docs"])
            held.clear()

        def merged(parts):
            keys, docs = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            keys, where, back = np.unique(keys, return_index=True, return_inverse=True)
            return keys, _summed(docs, back, len(keys)), pa.chunked_array([p[2] for p in parts]).combine_chunks().take(pa.array(where))

        rows = size = 0
        for batch in batches:
            for i, j, data, at in blocks(batch.column(0)):
                block = _Block(data, at)
                langs, group = _dealt(batch.column(1)[i:j])
                lang, word, n = block.counts(group, once=True)
                for k, (name,) in enumerate(langs):
                    own = slice(*np.searchsorted(lang, (k, k + 1)))
                    if len(word[own]):
                        terms = _strings(block.data, block.start[word[own]], block.end[word[own]])
                        held.setdefault(name, []).append((block.key[word[own]], n[own], terms))
                        rows, size = rows + len(terms), size + terms.nbytes
                if rows > HELD_ROWS or size > HELD_BYTES:
                    for name in held:
                        held[name] = [merged(held[name])]
                    rows, size = (sum(f(p[0][2]) for p in held.values()) for f in (len, lambda t: t.nbytes))
                    if rows > HELD_ROWS // 2 or size > HELD_BYTES // 2:
                        yield from out()
                        rows = size = 0
        yield from out()

    found = in_batches(_known(docs).select("text", "lang"), run, "lang string, term string, docs bigint")
    return found.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).select("lang", "term")


class Vocabulary:
    """Transducers of all languages in the shared folder; of each part its first term, its name and the terms before it."""

    def __init__(self, folder: str, parts: dict[str, list[tuple[bytes, str, int]]]):
        self.folder = folder
        self.first = {k: [p[0] for p in v] for k, v in parts.items()}
        self.name = {k: [p[1] for p in v] for k, v in parts.items()}
        self.before = {k: [p[2] for p in v] for k, v in parts.items()}

    @staticmethod
    def built(terms: DataFrame, part_terms: int = PART_TERMS) -> Vocabulary:
        """From (lang, term). Ranges of sorted terms go to tasks; one row a part comes to the driver."""

        def run(batches):
            builder, lang, first, size = None, None, b"", 0

            def part():
                data = [[lang], [first], [builder.terms], [uuid.uuid4().hex], [builder.finish()]]
                kinds = [pa.string(), pa.binary(), pa.int64(), pa.string(), pa.binary()]
                return pa.RecordBatch.from_arrays([pa.array(d, k) for d, k in zip(data, kinds)], ["lang", "first", "terms", "name", "data"])

            for batch in batches:
                for own, term in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                    if builder and (own != lang or builder.terms >= part_terms or size + len(term) > PART_BYTES):
                        yield part()
                        builder = None
                    if not builder:
                        builder, lang, first, size = Builder(), own, term, 0
                    builder.add(term)
                    size += len(term)
            if builder:
                yield part()

        spark = terms.sparkSession
        rows = stored(terms, "kept-terms")
        ranged = rows.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
        folder = scratch(spark, "transducers")
        made = in_batches(ranged, run, "lang string, first binary, terms bigint, name string, data binary")
        made.write.option("parquet.block.size", PART_BYTES).parquet(folder)
        parts, sizes = {}, {}
        for r in sorted(spark.read.parquet(folder).select("lang", "first", "terms", "name").collect(), key=lambda r: (r.lang, bytes(r.first))):
            parts.setdefault(r.lang, []).append((bytes(r.first), r.name, sizes.get(r.lang, 0)))
            sizes[r.lang] = sizes.get(r.lang, 0) + r.terms
        return Vocabulary(qualified(spark, folder), parts)

    def sizes(self, spark: SparkSession) -> DataFrame:
        """(lang, size): kept terms by language."""
        return spark.read.parquet(self.folder).groupBy("lang").agg(F.sum("terms").alias("size"))

    def _part(self, name: str) -> Transducer:
        """A part from the shared folder; the worker keeps those that it used last."""
        cache: OrderedDict = per_process(("transducers", self.folder), OrderedDict)
        if name not in cache:
            system, path = fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), self.folder.removeprefix("file:"))
            files = per_process(("transducer-files", self.folder), lambda: pads.dataset(path, filesystem=system, format="parquet"))
            cache[name] = Transducer(files.to_table(["data"], filter=pc.field("name") == name).column(0)[0].as_py())
            while len(cache) > 1 and sum(t.bytes for t in cache.values()) > KEPT_BYTES:
                cache.popitem(last=False)
        cache.move_to_end(name)
        return cache[name]

    def ordinals(self, lang: str, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Ordinals in the language of byte ranges, -1 for what is no kept term."""
        out = np.full(len(start), -1, np.int64)
        first = self.first.get(lang, [])
        if len(first) > 1:
            raw = data.tobytes()
            home = np.array([bisect_right(first, raw[a:z]) - 1 for a, z in zip(start.tolist(), end.tolist())], np.int64)
        else:
            home = np.zeros(len(start), np.int64)
        for k in np.unique(home[home >= 0]).tolist() if first else []:
            own = np.flatnonzero(home == k)
            local = self._part(self.name[lang][k]).ordinals(data, start[own], end[own])
            out[own] = np.where(local >= 0, local + self.before[lang][k], -1)
        return out

    def term(self, lang: str, ordinal: int) -> str:
        k = bisect_right(self.before[lang], ordinal) - 1
        return self._part(self.name[lang][k]).term(ordinal - self.before[lang][k]).decode()


def recount(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(lang, source, ordinal, n): occurrences of kept terms, by streaming the text through the transducers."""

    def run(batches):
        groups: dict[tuple, int] = {}
        keys, sums = [], []

        def out():
            own, ordinal = np.divmod(keys[0], ORDINALS) if keys else (np.empty(0, np.int64),) * 2
            columns = [pa.array([k[c] for k in groups], pa.string()).take(pa.array(own)) for c in (0, 1)]
            yield from _sliced([*columns, pa.array(ordinal), pa.array(sums[0] if sums else ordinal)], ["lang", "source", "ordinal", "n"])

        def merge():
            if len(keys) > 1:
                distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
                total = _summed(np.concatenate(sums), back, len(distinct))
                keys[:], sums[:] = [distinct], [total]

        for batch in batches:
            for i, j, data, at in blocks(batch.column(0)):
                block = _Block(data, at)
                names, group = _dealt(batch.column(1)[i:j], batch.column(2)[i:j])
                owner, word, n = block.counts(group, once=False)
                place = np.array([groups.setdefault(k, len(groups)) for k in names], np.int64)
                for lang in dict.fromkeys(k[0] for k in names):
                    rows = np.flatnonzero(np.array([k[0] == lang for k in names])[owner])
                    distinct, back = np.unique(word[rows], return_inverse=True)
                    ordinal = vocabulary.ordinals(lang, block.data, block.start[distinct], block.end[distinct])[back]
                    kept = ordinal >= 0
                    keys.append(place[owner[rows[kept]]] * ORDINALS + ordinal[kept])
                    sums.append(n[rows[kept]])
                if sum(map(len, keys)) > HELD_ROWS:
                    merge()
                    if len(keys[0]) > HELD_ROWS // 2:
                        yield from out()
                        keys.clear(), sums.clear(), groups.clear()
        merge()
        yield from out()

    found = in_batches(_known(docs), run, "lang string, source string, ordinal bigint, n bigint")
    return found.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n"))


def _weight(n: Column, total: Column) -> Column:
    """1 + floor(UNIT * (n + 1) / total) for n < total, three digits at a time so that nothing overflows."""
    return F.aggregate(
        F.array(*[F.lit(1000)] * 3),
        F.struct(F.lit(0).cast("bigint").alias("q"), (n + 1).cast("bigint").alias("r")),
        lambda s, k: F.struct(
            (s["q"] * 1000 + F.call_function("div", s["r"] * k, total)).alias("q"), ((s["r"] * k) % total).alias("r")
        ),
        lambda s: s["q"] + 1,
    )


def _weights(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    q, r = np.zeros(len(n), np.int64), n + 1
    for _ in range(3):
        step, r = np.divmod(r * 1000, total)
        q = q * 1000 + step
    return q + 1


def _square(p: Column, q: Column) -> Column:
    return F.call_function("div", p * p, q)


def _common(rows):
    """(kind, group, other, value) of batches sorted by (lang, ordinal).

    Kind 0: for two groups that both hold terms, what the sum of floor(p*p/q) over them is beyond the sums that
    take one of the two as without terms. Kind 1: for a group and a term that it has more of than its language, f.
    """
    rest = None

    def out(kind, group, other, value):
        arrays = [pa.array(np.full(len(group), kind, np.int32)), pa.array(group), pa.array(other), pa.array(value)]
        return pa.RecordBatch.from_arrays(arrays, ["kind", "gid", "other", "value"])

    def whole_terms(table):
        lang, ordinal, gid, n, p, p0, all_total = (table.column(k).to_numpy(zero_copy_only=False) for k in range(7))
        turn = np.flatnonzero((lang[1:] != lang[:-1]) | (ordinal[1:] != ordinal[:-1])) + 1
        start = np.concatenate([[0], turn])
        size = np.diff(np.append(start, len(gid)))
        term = np.repeat(np.arange(len(start)), size)
        q = _weights(np.add.reduceat(n, start), all_total[start])[term]
        more = np.flatnonzero(p > q)
        if len(more):
            yield out(1, gid[more], ordinal[more], (p[more] - q[more]) ** 2 // q[more])
        partners = size[term]
        stop = np.cumsum(partners)
        names, dense = np.unique(gid, return_inverse=True)
        lo = 0
        while lo < len(gid):
            before = stop[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(stop, before + PAIRS, "right")))
            a = np.repeat(np.arange(lo, hi), partners[lo:hi])
            b = start[term[a]] + np.arange(len(a)) - (stop[a] - partners[a] - before)
            a, b = a[a != b], b[a != b]
            if len(a):
                value = p[a] ** 2 // p[b] - p[a] ** 2 // p0[b] - p0[a] ** 2 // p[b] + p0[a] ** 2 // p0[b]
                keys, where = np.unique(dense[a] * len(names) + dense[b], return_inverse=True)
                yield out(0, names[keys // len(names)], names[keys % len(names)], _summed(value, where, len(keys)))
            lo = hi

    def edges(table):
        """Row where the last term begins."""
        same = pc.and_(pc.equal(table.column(0), table.column(0)[-1]), pc.equal(table.column(1), table.column(1)[-1]))
        return pc.index(same, True).as_py()

    for batch in rows:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        cut = edges(table.combine_chunks())
        if cut:
            yield from whole_terms(table.slice(0, cut).combine_chunks())
        rest = table.slice(cut)
    if rest is not None:
        yield from whole_terms(rest.combine_chunks())


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, part_terms: int = PART_TERMS) -> DataFrame:
    """(lang, source, part, item, value BIGINT, rank INT): divergence between sources, and their own words.

    Null text, lang and source count as ''. A group is an occurring (lang, source). With V kept terms in the
    language and N occurrences of them in the group, a term's weight there is p = 1 + floor(UNIT * (count + 1) /
    (N + V)); f = floor((p - q)^2 / q). Part ``pair``: f against each other source of the language, summed over all
    kept terms (0 without any). Part ``term``: f against the whole language, for terms that occur in the group and weigh
    more there, the first ``top``. Ranks go by value downwards, then by the item's UTF-8 bytes. Rows that repeat an
    id are documents of their own; other columns are not read. An empty table gives no rows.

    f = floor(p^2 / q) - 2 p + q, so only floor(p^2 / q) has to be summed by pairs; where a group lacks a term its weight
    is a constant. The sum is thus taken from histograms of weights (one group lacks the term), and term by term
    only where both groups have it.
    """
    vocabulary = Vocabulary.built(kept_terms(docs, min_docs), part_terms)
    counts = stored(recount(docs, vocabulary), "recount")
    held = counts.groupBy("lang", "source").agg(F.sum("n").alias("sum"), F.count(F.lit(1)).alias("held"))
    none = F.lit(0).cast("bigint")
    groups = _known(docs).select("lang", "source").distinct().join(held, ["lang", "source"], "left").join(vocabulary.sizes(docs.sparkSession), "lang", "left")
    groups = groups.select(
        "lang", "source", F.coalesce("size", none).alias("size"), F.coalesce("held", none).alias("held"),
        (F.coalesce("sum", none) + F.coalesce("size", none)).alias("total"),
    )
    groups = groups.withColumn("p0", F.when(F.col("size") > 0, _weight(none, F.greatest("total", F.lit(1)))).otherwise(1))
    groups = stored(groups.withColumn("gid", F.monotonically_increasing_id()), "groups")
    whole = groups.groupBy("lang").agg((F.sum(F.col("total") - F.col("size")) + F.first("size")).alias("all_total"))
    rows = counts.join(groups.select("lang", "source", "gid", "total", "p0"), ["lang", "source"]).join(whole, "lang")
    rows = rows.select("lang", "ordinal", "gid", "n", _weight(F.col("n"), F.col("total")).alias("p"), "p0", "all_total")
    ranged = rows.repartition("lang", "ordinal").sortWithinPartitions("lang", "ordinal")
    common = stored(in_batches(ranged, _common, "kind int, gid bigint, other bigint, value bigint"), "common")

    ranked = W.partitionBy("gid").orderBy(F.desc("value"), "other")
    best = common.filter("kind = 1").withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)
    named = best.join(groups.select("gid", "lang", "source"), "gid").select("lang", "source", "other", "value", "rank")

    def read_off(batches):
        for batch in batches:
            items = [vocabulary.term(k, o) for k, o in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            columns = [batch.column(0), batch.column(1), pa.array(["term"] * len(items)), pa.array(items, pa.string()), batch.column(3), batch.column(4)]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "part", "item", "value", "rank"])

    terms = in_batches(named, read_off, "lang string, source string, part string, item string, value bigint, rank int")
    return _pairs(rows, groups, common).unionByName(terms)


def _pairs(rows: DataFrame, groups: DataFrame, common: DataFrame) -> DataFrame:
    """Part ``pair``."""
    ours = groups.select("lang", "source", "size", F.col("gid").alias("a"), F.col("p0").alias("a0"), F.col("held").alias("a_held"))
    theirs = groups.select("lang", F.col("source").alias("item"), F.col("gid").alias("b"), F.col("p0").alias("b0"), F.col("held").alias("b_held"))
    weights = stored(rows.groupBy("lang", "gid", "p", "p0").agg(F.count(F.lit(1)).alias("terms")), "weights")
    mass = weights.groupBy("gid").agg(F.sum(F.col("p") * F.col("terms")).alias("mass"))
    # One of the two groups as if without terms.
    left = weights.select("lang", F.col("gid").alias("a"), "p", "terms").join(theirs, "lang").filter("a <> b")
    left = left.select("a", "b", (_square(F.col("p"), F.col("b0")) * F.col("terms")).alias("value"))
    right = weights.select("lang", F.col("gid").alias("b"), "p", "terms").join(ours, "lang").filter("a <> b")
    right = right.select("a", "b", (_square(F.col("a0"), F.col("p")) * F.col("terms")).alias("value"))
    both = common.filter("kind = 0").select(F.col("gid").alias("a"), F.col("other").alias("b"), "value")
    summed = both.unionByName(left).unionByName(right).groupBy("a", "b").agg(F.sum("value").alias("some"))
    pairs = ours.join(theirs, "lang").filter("a <> b")
    pairs = pairs.join(summed, ["a", "b"], "left")
    for side in ("a", "b"):
        pairs = pairs.join(mass.select(F.col("gid").alias(side), F.col("mass").alias(f"{side}_mass")), side, "left")
    weight = lambda s: F.coalesce(f"{s}_mass", F.lit(0)) + (F.col("size") - F.col(f"{s}_held")) * F.col(f"{s}0")
    neither = (F.col("size") - F.col("a_held") - F.col("b_held")) * _square(F.col("a0"), F.col("b0"))
    value = F.when(F.col("size") > 0, F.coalesce("some", F.lit(0)) + neither - 2 * weight("a") + weight("b")).otherwise(0).cast("bigint")
    ranked = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value")).withColumn("rank", F.row_number().over(ranked))
