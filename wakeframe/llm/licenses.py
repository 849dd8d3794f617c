"""License notices in documents: MinHash bands over overlapping windows retrieve templates, containment verifies.

A template of n shingles belongs to the size s, the power of two with s / 2 < n <= s. For each size a
document's shingles are cut into blocks of s, and every two consecutive blocks are a window; so any run
of s shingles lies whole in some window, and a window's minimum is the smaller of its blocks' minima. The
templates are a stated query set that every task holds, in blocks of bounded size; documents never move.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from wakeframe.llm.license_texts import TEXTS
from wakeframe.llm.stored import in_batches
from wakeframe.llm.words import ALPHANUMERIC, U, Words, blocks, shingles, stream

WORDS = 5
PERCENT = 75
# Chance at most that no band of a window agrees with a template that the window contains.
MISS = 1e-4
# Bytes of templates that a task holds at a time.
TEMPLATE_BYTES = 4 << 20

# Notices of common licenses (fixed values): short ones, then permission texts, headers and other wordings.
NOTICES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "mit": "Released under the MIT License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "all-rights-reserved": "All rights reserved.",
    **TEXTS,
}


def least_similarity(n: int, percent: int = PERCENT) -> float:
    """Jaccard similarity at least of a template of n shingles and a window of its size that contains ``percent`` of it."""
    shared, window = percent / 100 * n, 2 * size_of(n)
    return shared / (window + n - shared)


def size_of(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def bands(similarity: float, rows: int = 1, miss: float = MISS) -> int:
    """Bands of ``rows`` minima that miss a pair of the given similarity with a chance of ``miss`` at most."""
    return max(1, math.ceil(math.log(miss) / math.log(1 - similarity**rows)))


class Templates:
    """Shingle sets of templates and their minima, by shingle width and size."""

    def __init__(self, rows: list[tuple[object, str]], width: int, percent: int):
        self.ids = [a for a, _ in rows]
        self.percent = percent
        by: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
        for lo, hi, data, at in blocks(pa.array([t or "" for _, t in rows], pa.large_string())):
            words = Words(data, at, ALPHANUMERIC)
            for k in range(hi - lo):
                own = words.hash[words.first[k] : words.first[k + 1]]
                if len(own):
                    w = min(width, len(own))
                    found = np.unique(shingles(own, np.array([0, len(own)]), w)[0])
                    by.setdefault((w, size_of(len(found))), []).append((lo + k, found))
        self.groups = []
        for (w, size), own in sorted(by.items()):
            n = bands(min(least_similarity(len(s), percent) for _, s in own))
            mul, add = stream(21, n) | U(1), stream(22, n)
            with np.errstate(over="ignore"):
                minima = np.array([(s[:, None] * mul + add).min(axis=0) for _, s in own])
            least = max(1, min(math.ceil(percent * len(s) / 100 - 1e-9) for _, s in own))
            self.groups.append((w, size, mul, add, minima, own, np.unique(np.concatenate([s for _, s in own])), least))
        # By shingle width: the leading 16 bits that some template's shingle has.
        self.marked = {w: np.zeros(1 << 16, bool) for w, _ in by}
        for (w, _), own in by.items():
            for _, s in own:
                self.marked[w][s >> U(48)] = True

    def search(self, words: Words) -> Iterator[tuple[int, int, int, int, float]]:
        """(document, template, first word, word after the last, containment), each run of matched windows once.

        Only documents that hold as many shingles of a group's templates as a match needs get window minima.
        """
        last_width, all_values, all_first, hit = 0, None, None, None
        for width, size, mul, add, minima, own, known, least in self.groups:
            if width != last_width:
                all_values, all_first = shingles(words.hash, words.first, width)
                hit = np.flatnonzero(self.marked[width][all_values >> U(48)])
                last_width = width
            at = hit[np.isin(all_values[hit], known)]
            held = np.bincount(np.searchsorted(all_first, at, "right") - 1, minlength=len(words.first) - 1)
            # Texts shorter than the template's shingles do not count.
            docs = np.flatnonzero((held >= least) & (np.diff(words.first) >= width))
            if not len(docs):
                continue
            counts = np.diff(all_first)[docs]
            values = np.concatenate([all_values[all_first[d] : all_first[d + 1]] for d in docs])
            first = np.concatenate([[0], np.cumsum(counts)])
            start = np.concatenate([np.arange(a, z, size) for a, z in zip(first, first[1:])])
            doc = np.repeat(np.arange(len(counts)), -(-counts // size))
            more = np.append(doc[1:] == doc[:-1], False)
            seen: set[tuple[int, int]] = set()
            h = np.empty_like(values)
            for k in range(len(mul)):
                with np.errstate(over="ignore"):
                    np.multiply(values, mul[k], out=h)
                    np.add(h, add[k], out=h)
                low = np.minimum.reduceat(h, start)
                window = np.where(more, np.minimum(low, np.append(low[1:], low[-1:])), low)
                ranked = np.argsort(minima[:, k], kind="stable")
                column = minima[ranked, k]
                a, z = np.searchsorted(column, window, "left"), np.searchsorted(column, window, "right")
                for at in np.flatnonzero(z > a).tolist():
                    seen.update((at, int(t)) for t in ranked[a[at] : z[at]])
            spans: dict[tuple[int, int], list[list]] = {}
            for at, t in sorted(seen):
                d = doc[at]
                stop = min(first[d + 1], start[at] + 2 * size)
                part = np.isin(values[start[at] : stop], own[t][1])
                matched = np.flatnonzero(part)
                share = len(np.unique(values[start[at] : stop][part])) / len(own[t][1])
                if 100 * share >= self.percent - 1e-9:
                    a, z = int(start[at] + matched[0] - first[d]), int(start[at] + matched[-1] - first[d]) + width
                    runs = spans.setdefault((int(docs[d]), own[t][0]), [])
                    if runs and a < runs[-1][1]:
                        runs[-1][1:] = [max(z, runs[-1][1]), max(share, runs[-1][2])]
                    else:
                        runs.append([a, z, share])
            for (d, t), runs in spans.items():
                for a, z, share in runs:
                    yield d, t, a, z, share


def _template_blocks(templates: DataFrame) -> Iterator[list[tuple[object, str]]]:
    block, size = [], 0
    for row in templates.toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1] or "")
        if size >= TEMPLATE_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def notices(spark) -> DataFrame:
    """The built-in templates (template_id, text)."""
    return spark.createDataFrame(sorted(NOTICES.items()), "template_id string, text string")


def scan(docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, matches ARRAY<STRUCT<template_id, start, stop, containment, value>>), one row for each row of ``docs``.

    A template (template_id, text) matches in a window that holds ``percent`` of its distinct shingles of
    ``width`` words (runs of ASCII letters and digits and of non-ASCII characters, A-Z in lower case); one of fewer words is one shingle. start and stop
    count words and lead from the first to the last shingle found, value is that text; runs that overlap are
    one match. A null or empty text, or one shorter than a template's shingles, has no match of it, and a
    template without words matches nothing. Templates that share an id or a text are looked for each. Rows that
    repeat an id, or lack one, are documents of their own. Other columns are not read. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    pairs = templates.select("template_id", "text")
    id_type = pairs.schema["template_id"].dataType
    shape = f"array<struct<template_id:{id_type.simpleString()},start:int,stop:int,containment:double,value:string>>"
    kind = pa.list_(pa.struct([("template_id", to_arrow_type(id_type)), ("start", pa.int32()), ("stop", pa.int32()), ("containment", pa.float64()), ("value", pa.string())]))
    parts = [Templates(block, width, percent) for block in _template_blocks(pairs)]

    def run(batches):
        for batch in batches:
            for i, j, data, at in blocks(batch.column(1)):
                words = Words(data, at, ALPHANUMERIC)
                out: list[list[dict]] = [[] for _ in range(j - i)]
                for part in parts:
                    for d, t, a, z, share in part.search(words):
                        raw = data[words.start[words.first[d] + a] : words.end[words.first[d] + z - 1]]
                        out[d].append({"template_id": part.ids[t], "start": a, "stop": z, "containment": share, "value": raw.tobytes().decode()})
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(out, kind)], ["doc_id", "matches"])

    return in_batches(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, matches {shape}")
