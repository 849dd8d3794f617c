"""A positional inverted index over documents, and exact phrase and proximity search in it.

The index is cut by documents: each segment holds the postings of a few megabytes of whole documents, so
building it moves no rows, a frequent term is spread over all segments, and a search reads each segment
once. A segment is one stored row: its terms (sorted 64-bit word hashes), where each term's postings start,
and the postings (word positions in the segment, ascending).

A search takes the test items in blocks. Term counts over the whole index order the terms of each phrase
from the rarest; a segment's candidate starts are the postings of the rarest term less its offset, and the
offset-adjusted lists of the other terms are intersected one after the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from wakeframe.llm.stored import in_batches, stored
from wakeframe.llm.words import ALPHANUMERIC, Words, blocks

# Text of a segment, and test words that a search takes at a time (these go to every task).
SEGMENT_BYTES = 2 << 20
QUERY_WORDS = 500_000

_SEGMENT = "docs array<struct<id:{id},words:int>>, terms binary, first binary, postings binary"


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index: (segment, docs, terms, first, postings).

    Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z in lower case. A null text has
    no words; every row is a document of its own, also if it repeats an id or has none. An empty table
    gives an empty index. Other columns are not read.
    """

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType
    kind = pa.list_(pa.struct([("id", to_arrow_type(id_type)), ("words", pa.int32())]))

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for i, j, data, at in blocks(batch.column(1), SEGMENT_BYTES):
                words = Words(data, at, ALPHANUMERIC)
                order = np.argsort(words.hash, kind="stable")
                ranked = words.hash[order]
                first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([[{"id": a, "words": w} for a, w in zip(ids[i:j].to_pylist(), np.diff(words.first).tolist())]], kind),
                        pa.array([ranked[first].astype("<u8").tobytes()], pa.binary()),
                        pa.array([np.append(first, len(ranked)).astype("<u4").tobytes()], pa.binary()),
                        pa.array([order.astype("<u4").tobytes()], pa.binary()),
                    ],
                    ["docs", "terms", "first", "postings"],
                )

    segments = in_batches(rows, run, _SEGMENT.format(id=id_type.simpleString()))
    return stored(segments.withColumn("segment", F.monotonically_increasing_id()), "phrase-index")


class Phrases:
    """Distinct word sequences of one block of items, and which items have each.

    An item's phrases are its runs of ``width`` consecutive words; an item of fewer words, but not none, is
    one phrase.
    """

    def __init__(self, items: list[tuple[object, str]], width: int):
        data = pa.array([t or "" for _, t in items], pa.large_string())
        owners: dict[tuple, set[int]] = {}
        for lo, hi, raw, at in blocks(data):
            words = Words(raw, at, ALPHANUMERIC)
            for k in range(hi - lo):
                own = words.hash[words.first[k] : words.first[k + 1]].tolist()
                for i in range(max(1, len(own) - width + 1) if own else 0):
                    owners.setdefault(tuple(own[i : i + width]), set()).add(lo + k)
        self.ids = [a for a, _ in items]
        self.by_length: list[tuple[np.ndarray, list[list[int]]]] = []
        for n in sorted({len(p) for p in owners}):
            some = [p for p in owners if len(p) == n]
            self.by_length.append((np.array(some, np.uint64), [sorted(owners[p]) for p in some]))
        self.terms = np.unique(np.concatenate([p.ravel() for p, _ in self.by_length])) if self.by_length else np.empty(0, np.uint64)

    def order(self, counts: np.ndarray) -> None:
        """Drop phrases with a term that the index lacks; note each phrase's terms from the rarest."""
        kept = []
        for phrases, owners in self.by_length:
            n = counts[np.searchsorted(self.terms, phrases)]
            there = np.flatnonzero((n > 0).all(axis=1))
            if len(there):
                kept.append((phrases[there], np.argsort(n[there], axis=1, kind="stable"), [owners[k] for k in there]))
        self.by_length = kept


class _Segment:
    def __init__(self, terms: bytes, first: bytes, postings: bytes, words: np.ndarray):
        self.terms = np.frombuffer(terms, "<u8")
        self.first = np.frombuffer(first, "<u4").astype(np.int64)
        self.positions = np.frombuffer(postings, "<u4").astype(np.int64)
        self.doc_start = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
        self.span = int(self.doc_start[-1]) + 1
        # Postings of all terms in one ascending list: term number * span + position.
        self.keys = np.repeat(np.arange(len(self.terms)), np.diff(self.first)) * self.span + self.positions

    def postings_of(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``term``, position) of all postings of the given term numbers."""
        n = self.first[term + 1] - self.first[term]
        which = np.repeat(np.arange(len(term)), n)
        at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[term], n)
        return which, self.positions[at]

    def search(self, phrases: np.ndarray, rarest: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, start, stop) of the matches, each inside one document."""
        term = np.searchsorted(self.terms, phrases)
        term[term == len(self.terms)] = 0
        own = np.flatnonzero((self.terms[term] == phrases).all(axis=1))
        term, rarest, length = term[own], rarest[own], phrases.shape[1]
        rows = np.arange(len(own))
        which, at = self.postings_of(term[rows, rarest[:, 0]])
        if slop:
            start, stop = self._grow(term, rarest[which, 0], which, at, length)
            good = (start >= 0) & (stop > 0) & (stop - start <= length + slop)
            which, start, stop = which[good], start[good], stop[good]
        else:
            start = at - rarest[which, 0]
            good = start >= 0
            which, start = which[good], start[good]
            for k in range(1, length):
                offset = rarest[which, k]
                key = term[which, offset] * self.span + start + offset
                found = np.searchsorted(self.keys, key)
                found[found == len(self.keys)] = 0
                good = (start + offset < self.span) & (self.keys[found] == key)
                which, start = which[good], start[good]
            stop = start + length
        doc = np.searchsorted(self.doc_start, start, "right") - 1
        good = stop <= self.doc_start[doc + 1]
        return own[which[good]], start[good], stop[good]

    def _grow(self, term, anchor, which, at, length):
        """The shortest ordered occurrence of each phrase around an occurrence of its rarest term; -1 if none."""
        start, stop = at.copy(), at.copy()
        for k in range(1, length):
            go = np.flatnonzero((anchor + k < length) & (stop >= 0))
            t = term[which[go], anchor[go] + k]
            found = np.searchsorted(self.keys, t * self.span + stop[go], "right")
            there = found < self.first[t + 1]
            stop[go] = np.where(there, self.positions[np.minimum(found, len(self.keys) - 1)], -1)
            go = np.flatnonzero((anchor - k >= 0) & (start >= 0))
            t = term[which[go], anchor[go] - k]
            found = np.searchsorted(self.keys, t * self.span + start[go], "left") - 1
            there = found >= self.first[t]
            start[go] = np.where(there, self.positions[np.maximum(found, 0)], -1)
        return start, np.where(stop >= 0, stop + 1, 0)


def _item_blocks(items: DataFrame) -> Iterator[list[tuple[object, str]]]:
    """Items in blocks of about QUERY_WORDS words (by their bytes), one block on the driver at a time."""
    block, size = [], 0
    for row in items.toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1] or "")
        if size >= 5 * QUERY_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


def _counts(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """Occurrences of each term in the whole index."""

    def run(batches):
        for batch in batches:
            for t, f in zip(batch.column(0), batch.column(1)):
                own, first = np.frombuffer(t.as_py(), "<u8"), np.frombuffer(f.as_py(), "<u4").astype(np.int64)
                place = np.flatnonzero(np.isin(terms, own))
                at = np.searchsorted(own, terms[place])
                yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(first[at + 1] - first[at], pa.int64())], ["place", "n"])

    out = np.zeros(len(terms), np.int64)
    if len(terms):
        for r in in_batches(index.select("terms", "first"), run, "place bigint, n bigint").groupBy("place").agg(F.sum("n")).collect():
            out[r[0]] = r[1]
    return out


def find_phrases(index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = 10, slop: int = 0) -> DataFrame:
    """(segment, doc, item_id, matches ARRAY<STRUCT<start INT, stop INT>>): where documents have an item's phrases.

    ``doc`` is the document's number in its segment; start and stop count its words, stop exclusive. With
    ``slop`` a phrase also matches if its words occur in order with at most that many other words between
    them: of the occurrences around one occurrence of its rarest word, the shortest. An item without words
    finds nothing; items that share an id or a text are searched each.
    """
    found, item_type = None, items.schema[id_col].dataType
    kind = to_arrow_type(item_type)
    spans = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    schema = f"segment bigint, doc int, item_id {item_type.simpleString()}, matches array<struct<start:int,stop:int>>"
    for block in _item_blocks(items.select(id_col, text_col)):
        phrases = Phrases(block, width)
        phrases.order(_counts(index, phrases.terms))

        def run(batches, phrases=phrases):
            for batch in batches:
                for segment, docs, *parts in zip(*batch.columns):
                    words = docs.values.field("words").to_numpy(zero_copy_only=False)
                    own = _Segment(*(p.as_py() for p in parts), words)
                    rows = _matches(own, phrases, slop) if own.span > 1 else {}
                    if rows:
                        n = len(rows)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([segment.as_py()] * n, pa.int64()),
                                pa.array([d for d, _ in rows], pa.int32()),
                                pa.array([phrases.ids[i] for _, i in rows], kind),
                                pa.array([[{"start": a, "stop": z} for a, z in sorted(v)] for v in rows.values()], spans),
                            ],
                            ["segment", "doc", "item_id", "matches"],
                        )

        some = in_batches(index.select("segment", "docs", "terms", "first", "postings"), run, schema)
        found = some if found is None else found.unionByName(some)
    if found is None:
        found = index.sparkSession.createDataFrame([], schema)
    return found


def _matches(own: _Segment, phrases: Phrases, slop: int) -> dict[tuple[int, int], set[tuple[int, int]]]:
    """{(document, item): places in the document}."""
    out: dict[tuple[int, int], set[tuple[int, int]]] = {}
    for some, rarest, owners in phrases.by_length:
        which, start, stop = own.search(some, rarest, slop)
        doc = np.searchsorted(own.doc_start, start, "right") - 1
        base = own.doc_start[doc]
        for w, d, a, z in zip(which.tolist(), doc.tolist(), (start - base).tolist(), (stop - base).tolist()):
            for item in owners[w]:
                out.setdefault((d, item), set()).add((a, z))
    return out


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 10, slop: int = 0) -> DataFrame:
    """(doc_id, n_words, n_hit, items ARRAY, contaminated), one row for each row of ``docs``.

    A word is hit if it lies in an occurrence of a phrase of ``items`` (item_id, text). ``items`` lists the
    distinct ids found; an item without an id hits words but is not listed. Rows that repeat a document's id
    are documents of their own. A document without words is never contaminated. An empty table gives no rows.
    """
    index = build_index(docs, id_col, text_col)
    found = find_phrases(index, items, width=width, slop=slop)
    merged = found.groupBy("segment", "doc").agg(
        F.array_sort(F.flatten(F.collect_list("matches"))).alias("spans"), F.collect_set("item_id").alias("items")
    )
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reached"))
    hit = F.aggregate(
        "spans",
        start,
        lambda s, x: F.struct(
            (s["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(x["start"], s["reached"]))).alias("n"),
            F.greatest(s["reached"], x["stop"]).alias("reached"),
        ),
        lambda s: s["n"].cast("bigint"),
    )
    hits = merged.select("segment", "doc", hit.alias("n_hit"), "items")
    all_docs = index.select("segment", F.posexplode("docs").alias("doc", "d")).select(
        "segment", "doc", F.col("d.id").alias("doc_id"), F.col("d.words").cast("bigint").alias("n_words")
    )
    none = F.array().cast(hits.schema["items"].dataType)
    return all_docs.join(hits, ["segment", "doc"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("items", none).alias("items"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )
