"""Gram matrices of recordings in tiles, and their leading eigenpairs, without a row that holds a whole recording.

A recording is cut into spans of frames and blocks of cells. The Gram matrix of its frames is a table of tiles (span i,
span j), each summed over the blocks. Eigenvectors are tables of pieces, one per span. Recordings of up to
``DENSE_FRAMES`` frames are solved from their tiles at once; for longer ones a block Krylov space grows by
products with the tiles, orthogonal in pieces through small Gram matrices, until the wanted Ritz pairs stand still.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeframe.session import written

# Bytes of partial matrices that a task holds before it passes them on.
HELD_BYTES = 64 << 20
DENSE_FRAMES = 2048
# Columns of a Krylov block, and the residual (of the largest value) at which a pair counts as found.
WIDTH, TOLERANCE = 32, 1e-7


def adding(keys: list[str], matrices_of) -> Callable:
    """A task's loop that adds up the matrices ``matrices_of(part)`` -> {replica: matrix} of each key's rows."""

    def rows(held: dict) -> pd.DataFrame:
        out = pd.DataFrame({"replica": [r for _, r in held], "size": [len(g) for g in held.values()], "g": [g.ravel() for g in held.values()]})
        for i, name in enumerate(keys):
            out.insert(i, name, [k[i] for k, _ in held])
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for pdf in batches:
            if pdf.empty:
                continue
            groups = pdf.groupby(keys, sort=False) if keys else [((), pdf)]
            for key, part in groups:
                for replica, g in matrices_of(part).items():
                    at = (key, replica)
                    held[at] = held[at] + g if at in held else g
            if sum(g.nbytes for g in held.values()) > HELD_BYTES:
                yield rows(held)
                held = {}
        if held:
            yield rows(held)

    return run


def added(parts: DataFrame, keys: list[str], schema: str) -> DataFrame:
    """The partial matrices of each key and replica as one: they meet sorted, and one is held at a time."""
    by = [*keys, "replica"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for pdf in batches:
            for i in range(len(pdf)):
                row = pdf.iloc[[i]]
                key = tuple(row[c].iloc[0] for c in by)
                if last is not None and last[0] == key:
                    last[1]["g"] = [last[1]["g"].iloc[0] + row["g"].iloc[0]]
                else:
                    if last is not None:
                        yield last[1]
                    last = (key, row.copy())
        if last is not None:
            yield last[1]

    return parts.repartition(*by).sortWithinPartitions(*by).mapInPandas(run, schema)


def summed(df: DataFrame, keys: Sequence[str], matrix: Callable) -> DataFrame:
    """(keys, size INT, g ARRAY): ``matrix(row)`` added up over the rows of each key, flattened, with its number of rows."""
    keys, types = list(keys), dict(df.dtypes)
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + ["replica int, size int, g array<double>"])

    def total(part: pd.DataFrame) -> dict:
        return {0: sum(matrix(r) for r in part.itertuples(index=False))}

    return added(df.mapInPandas(adding(keys, total), schema), keys, schema).drop("replica")


def stack(x) -> np.ndarray:
    return np.stack(x).astype(float)


def wide(g, rows: int) -> np.ndarray:
    return np.asarray(g, float).reshape(rows, -1)


def gram_tiles(blocks: DataFrame) -> DataFrame:
    """(run, i, j, size, g) for i <= j: products of the frames of span i with those of span j, over all cells.

    ``blocks`` holds (run, block, span, frames, x) with frames x cells matrices ``x``.
    """
    one = blocks.select("run", "block", F.col("span").alias("i"), F.col("x").alias("a"))
    two = blocks.select("run", "block", F.col("span").alias("j"), F.col("x").alias("b"))
    return summed(one.join(two, ["run", "block"]).filter("i <= j").drop("block"), ["run", "i", "j"], lambda r: stack(r.a) @ stack(r.b).T)


def spans(blocks: DataFrame) -> DataFrame:
    """(run, span, frames, n): the frames of each span, and those of the whole run."""
    own = blocks.filter("block = 0").select("run", "span", "frames")
    whole = own.groupBy("run").agg(F.sum(F.size("frames")).alias("n"))
    return own.join(whole, "run")


def entries(tiles: DataFrame, parts: DataFrame) -> DataFrame:
    """Long form (run, i, j, v) of a tiled matrix, i and j being frames."""
    side = lambda s: parts.select("run", F.col("span").alias(s), F.col("frames").alias(f"{s}_frames"))
    long = tiles.join(side("i"), ["run", "i"]).join(side("j"), ["run", "j"]).select("run", (F.col("i") == F.col("j")).alias("_own"), "i_frames", "j_frames", F.posexplode("g").alias("_k", "v"))
    width = F.size("j_frames")
    at = lambda s, k: F.get(f"{s}_frames", F.floor(k).cast("int"))
    both = long.select("run", "_own", at("i", F.col("_k") / width).alias("i"), at("j", F.col("_k") % width).alias("j"), "v")
    turned = F.array(F.struct("i", "j", "v"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "v"))
    return both.select("run", F.inline(F.when(F.col("_own"), F.slice(turned, 1, 1)).otherwise(turned)))


def leads(vectors: np.ndarray) -> np.ndarray:
    """The sign that makes each column's largest entry positive."""
    top = np.abs(vectors).argmax(axis=0)
    return np.where(vectors[top, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


_PIECES = "run int, mode int, value double, trace double, n bigint, span bigint, u array<double>"


def _dense(tiles: DataFrame) -> DataFrame:
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["i"] == pdf["j"]].sort_values("i")
        at = dict(zip(own["i"], np.cumsum([0, *own["size"][:-1]]).tolist()))
        size = dict(zip(own["i"], own["size"]))
        m = np.zeros((int(own["size"].sum()),) * 2)
        for r in pdf.itertuples(index=False):
            a, b, g = at[r.i], at[r.j], wide(r.g, r.size)
            m[a : a + g.shape[0], b : b + g.shape[1]] = g
            m[b : b + g.shape[1], a : a + g.shape[0]] = g.T
        values, u = np.linalg.eigh((m + m.T) / 2)
        values, u = np.maximum(values[::-1], 0.0), u[:, ::-1]
        u = u * leads(u)
        k = np.arange(len(values), dtype="int32")
        return pd.concat(
            pd.DataFrame({"run": pdf["run"].iloc[0], "mode": k, "value": values, "trace": values.sum(), "n": len(m), "span": s, "u": list(u[at[s] : at[s] + size[s]].T)}) for s in at
        )

    return tiles.groupBy("run").applyInPandas(solve, _PIECES)


def _krylov(tiles: DataFrame, parts: DataFrame, modes: int | None, energy: float | None, seed: int = 7) -> DataFrame:
    """Leading eigenpairs of long recordings: ``modes`` of them, or as many as reach a share ``energy`` of the trace."""
    spark = tiles.sparkSession
    trace = written(summed(tiles.filter("i = j").select("run", "size", "g"), ["run"], lambda r: np.trace(wide(r.g, r.size)).reshape(1, 1)).select("run", F.col("g")[0].alias("trace")), "trace")
    turned = F.array(F.struct(F.col("i").alias("to"), F.col("j").alias("span"), F.lit(False).alias("turn")), F.struct(F.col("j").alias("to"), F.col("i").alias("span"), F.lit(True).alias("turn")))
    ways = tiles.select("run", "size", "g", F.inline(F.when(F.col("i") == F.col("j"), F.slice(turned, 1, 1)).otherwise(turned)))
    sizes = parts.select("run", "span", F.size("frames").alias("rows"), "n")

    @F.pandas_udf("array<double>")
    def start(run: pd.Series, span: pd.Series, rows: pd.Series) -> pd.Series:
        return pd.Series([np.random.default_rng([seed, r, s]).normal(size=n * WIDTH) for r, s, n in zip(run, span, rows)])

    def product(left: DataFrame, right: DataFrame) -> DataFrame:
        """(run, c): the sum over spans of left' right, both with matrices ``m`` in pieces."""
        j = left.select("run", "span", "rows", F.col("m").alias("a")).join(right.select("run", "span", F.col("m").alias("b")), ["run", "span"])
        return summed(j, ["run"], lambda r: wide(r.a, r.rows).T @ wide(r.b, r.rows)).select("run", F.col("size").alias("c_rows"), F.col("g").alias("c"))

    def piecewise(df: DataFrame, fn, *cols: str) -> DataFrame:
        @F.pandas_udf("array<double>")
        def made(*columns: pd.Series) -> pd.Series:
            return pd.Series([fn(*values).ravel() for values in zip(*columns)], dtype=object)

        return df.withColumn("m", made("rows", *cols))

    def orthonormal(block: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The block with orthonormal columns, directions of no length left out; and (run, r) with block = new r."""
        gram = product(block, block)

        @F.pandas_udf("struct<w:array<double>,r:array<double>,k:int>")
        def turn(size: pd.Series, c: pd.Series) -> pd.DataFrame:
            out = []
            for n, g in zip(size, c):
                values, v = np.linalg.eigh(wide(g, n))
                keep = values > max(values[-1], 1e-300) * 1e-13
                root = np.sqrt(values[keep])
                out.append(((v[:, keep] / root).ravel(), (v[:, keep] * root).T.ravel(), int(keep.sum())))
            return pd.DataFrame(out, columns=["w", "r", "k"])

        w = written(gram.select("run", "c_rows", turn("c_rows", "c").alias("t")).select("run", F.col("c_rows").alias("p"), "t.*"), "turn")
        new = piecewise(block.join(w, "run"), lambda n, m, w, p: wide(m, n) @ wide(w, p), "m", "w", "p").select("run", "span", "rows", "m")
        return written(new, "block"), w.select("run", "k", "p", "r")

    block = sizes.select("run", "span", "rows", start("run", "span", "rows").alias("m"))
    block, _ = orthonormal(written(block, "start"))
    whole, columns, number = block, None, 0
    while True:
        image = ways.join(block.select("run", "span", "rows", "m"), ["run", "span"])
        image = summed(image, ["run", "to"], lambda r: (wide(r.g, r.size).T if r.turn else wide(r.g, r.size)) @ wide(r.m, r.rows))
        image = written(image.select("run", F.col("to").alias("span"), F.col("size").alias("rows"), F.col("g").alias("m")), "image")
        rest, shares = image, []
        for _ in range(2):
            c = written(product(whole, rest), "shares")
            shares.append(c)
            j = rest.join(whole.select("run", "span", F.col("m").alias("k")), ["run", "span"]).join(c, "run")
            rest = written(piecewise(j, lambda n, m, k, c, d: wide(m, n) - wide(k, n) @ wide(c, d), "m", "k", "c", "c_rows").select("run", "span", "rows", "m"), "rest")
        block, r = orthonormal(rest)
        both = shares[0].join(shares[1].select("run", F.col("c").alias("c2")), "run").join(r, "run")
        new = both.select("run", F.lit(number).alias("number"), F.col("c_rows").alias("d"), F.zip_with("c", "c2", lambda a, b: a + b).alias("c"), "k", "p", "r")
        columns = written(new if columns is None else columns.unionByName(new), "columns")
        found = written(_ritz(columns, trace.join(sizes.select("run", "n").distinct(), "run"), modes, energy), "ritz")
        number += 1
        if found.filter("NOT done").isEmpty():
            break
        j = whole.join(block.select("run", "span", F.col("m").alias("q")), ["run", "span"])
        whole = written(piecewise(j, lambda n, m, q: np.hstack([wide(m, n), wide(q, n)]), "m", "q").select("run", "span", "rows", "m"), "space")
    made = piecewise(whole.join(found.select("run", "d", "s", "values", "trace", "n"), "run"), lambda n, m, s, d: (wide(m, n) @ wide(s, d)).T, "m", "s", "d")
    pieces = made.select("run", "span", "values", "trace", "n", F.expr("transform(sequence(0, size(values) - 1), k -> struct(k AS mode, values[k] AS value, slice(m, k * rows + 1, rows) AS u))").alias("all"))
    return pieces.select("run", F.inline("all"), "trace", "n", "span").select("run", "mode", "value", "trace", F.col("n").cast("bigint").alias("n"), "span", "u")


def _ritz(columns: DataFrame, trace: DataFrame, modes: int | None, energy: float | None) -> DataFrame:
    """(run, d, values, s, done, trace, n): Ritz pairs of each run's Krylov space, from the projections of its blocks."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("number")
        d = int(pdf["d"].iloc[-1])
        h = np.zeros((d, d))
        done_to = 0
        for r in pdf.itertuples(index=False):
            c = wide(r.c, r.d)
            h[: r.d, done_to : done_to + c.shape[1]] = c
            h[done_to : done_to + c.shape[1], : r.d] = c.T
            done_to += c.shape[1]
        last = pdf.iloc[-1]
        values, s = np.linalg.eigh(h)
        values, s = np.maximum(values[::-1], 0.0), s[:, ::-1]
        total = float(pdf["trace"].iloc[0])
        p = wide(last["c"], int(last["d"])).shape[1]
        left = np.linalg.norm(wide(last["r"], int(last["k"])) @ s[d - p :], axis=0) if last["k"] else np.zeros(d)
        # A space that takes in all of the matrix has nothing left to find.
        exhausted = not last["k"] or d >= int(pdf["n"].iloc[0]) or np.linalg.norm(wide(last["r"], int(last["k"]))) <= 1e-12 * max(values[0], 1e-300)
        if modes is not None:
            want = min(modes, d)
        else:
            reached = np.flatnonzero(np.cumsum(values) >= energy * total * (1 - 1e-12))
            want = int(reached[0]) + 1 if len(reached) else d + 1
        done = exhausted or (want <= d and bool((left[:want] <= TOLERANCE * max(values[0], 1e-300)).all()))
        want = min(want, d)
        return pd.DataFrame({"run": [pdf["run"].iloc[0]], "d": [d], "values": [values[:want]], "s": [(s[:, :want]).ravel()], "done": [done], "trace": [total], "n": [int(pdf["n"].iloc[0])]})

    return columns.join(trace, "run").groupBy("run").applyInPandas(solve, "run int, d int, values array<double>, s array<double>, done boolean, trace double, n bigint")


def eigenpairs(tiles: DataFrame, parts: DataFrame, modes: int | None = None, energy: float | None = None, dense: int = DENSE_FRAMES) -> DataFrame:
    """(run, mode, value, trace, n, span, u ARRAY): pieces of the eigenvectors of each run's tiled Gram matrix, largest value first.

    Recordings of up to ``dense`` frames give all pairs; longer ones the leading ``modes``, or those that reach a share
    ``energy`` of the trace (all but the last digits of it by default), with signs as they come. ``trace`` is the sum of
    all values.
    """
    small = parts.groupBy("run").agg(F.first("n").alias("n"))
    long = small.filter(F.col("n") > dense)
    if long.isEmpty():
        return _dense(tiles)
    if modes is None and energy is None:
        energy = 1 - 1e-9
    short = _dense(tiles.join(small.filter(F.col("n") <= dense).select("run"), "run", "left_semi"))
    far = written(tiles.join(long.select("run"), "run", "left_semi"), "long-tiles")
    return short.unionByName(_krylov(far, parts.join(long.select("run"), "run", "left_semi"), modes, energy))
