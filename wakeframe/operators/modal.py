"""Modal analysis and dynamics identification from small Gram matrices.

Data stays distributed: each task adds its rows' outer products into a k x k
matrix per key (k = samples of a snapshot, terms of a library), the
partial matrices meet as one packed row per task and key, and only the k x k
problem is solved in one place. k is a property of the experiment, not of
the amount of data. The frames of a recording have no such bound: their Gram matrix
and its vectors stay in pieces (``eigen``).
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from wakeframe.operators.eigen import adding, added, eigenpairs, entries, gram_tiles, leads, spans, stack, summed, wide
from wakeframe.operators.ordering import previous_row
from wakeframe.session import written


def gram(df: DataFrame, keys: Sequence[str], rows: Column, matrices: bool = False) -> DataFrame:
    """(keys, size, g ARRAY): flattened sum of the outer products of ``rows``.

    A row is one vector, or with ``matrices`` a k x n matrix that adds M M'. A task adds up its
    rows and passes on one packed matrix per key.
    """
    keys = list(keys)
    types = dict(df.dtypes)

    def products(part: pd.DataFrame) -> dict:
        if matrices:
            return {0: sum(m @ m.T for m in (np.stack(x).astype(float) for x in part["_x"]))}
        x = np.stack(part["_x"].to_numpy()).astype(float)
        return {0: x.T @ x}

    schema = ", ".join([f"{k} {types[k]}" for k in keys] + ["replica int, size int, g array<double>"])
    kind = "array<array<double>>" if matrices else "array<double>"
    parts = df.select(*keys, rows.cast(kind).alias("_x")).mapInPandas(adding(keys, products), schema)
    return added(parts, keys, schema).drop("replica")


def weighted_gram(df: DataFrame, rows: Column, weights: Column) -> DataFrame:
    """(replica, size, g): one Gram matrix per entry of the rows' weight arrays, rows copied nowhere."""

    def products(part: pd.DataFrame) -> dict:
        x, w = np.stack(part["_x"].to_numpy()).astype(float), np.stack(part["_w"].to_numpy()).astype(float)
        return {r: (x * w[:, r : r + 1]).T @ x for r in range(w.shape[1])}

    schema = "replica int, size int, g array<double>"
    parts = df.select(rows.cast("array<double>").alias("_x"), weights.alias("_w")).mapInPandas(adding([], products), schema)
    return added(parts, [], schema)


# Cells that travel together from frame order to cell order, and frames of a recording that do.
CELL_BLOCK = 1024
FRAME_BLOCK = 512


def cell_blocks(df: DataFrame, col: str = "v", centred: bool = True, size: int = CELL_BLOCK, span: int = FRAME_BLOCK) -> DataFrame:
    """(run, block, span, frames, x): up to ``span`` frames of a run over ``size`` neighbouring cells as a frames x cells matrix.

    This is the transposition every modal operator needs: slices of frames are shuffled, not single cells, and
    a row holds one slice over one span of a recording, however long that is. With ``centred`` each cell's time
    mean over the whole recording is removed.
    """
    slices = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(col) - 1) / size).cast("int")),
        lambda b: F.struct(b.alias("block"), F.slice(F.col(col), b * size + 1, size).alias("part")),
    )
    long = df.select("run", "frame", F.floor(F.col("frame") / span).alias("span"), F.inline(slices))
    packed = F.array_sort(F.collect_list(F.struct("frame", "part"))).alias("_p")
    rows = long.groupBy("run", "block", "span").agg(packed).select("run", "block", "span", F.col("_p.frame").alias("frames"), F.col("_p.part").alias("x"))
    if not centred:
        return rows
    return rows.join(cell_means(rows), ["run", "block"]).withColumn("x", _matrix_udf(lambda m, c: m - np.asarray(c, float), "x", "mean")).drop("mean")


def cell_means(rows: DataFrame) -> DataFrame:
    """(run, block, mean ARRAY): each cell's mean over all frames of its run."""
    total = summed(rows.select("run", "block", "x"), ["run", "block"], lambda r: np.append(stack(r.x).sum(axis=0), len(r.x)).reshape(1, -1))
    sums = F.slice("g", 1, F.size("g") - 1)
    return total.select("run", "block", F.transform(sums, lambda v: v / F.element_at("g", -1)).alias("mean"))


def _matrix_udf(fn, *cols, out: str = "array<array<double>>") -> Column:
    """Column from ``fn(matrix, *others)`` of each row's frames x cells matrix."""

    @F.pandas_udf(out)
    def run(*series: pd.Series) -> pd.Series:
        rows = []
        for m, *rest in zip(*series):
            value = fn(np.stack(m).astype(float), *rest)
            rows.append(list(value) if value.ndim == 2 else value)
        return pd.Series(rows, dtype=object)

    return run(*cols)


def block_cells(df: DataFrame, value: str, size: int = CELL_BLOCK) -> DataFrame:
    """(run, cell, value) from blocks that hold one array per cell."""
    long = df.select("run", "block", F.posexplode(value).alias("_p", value))
    return long.select("run", (F.col("block") * size + F.col("_p")).alias("cell"), value)


class Covariance:
    """The frames' Gram matrix of each run over its cells, as tiles of spans, divided by frames - 1 unless ``scaled`` is off.

    Blocks and tiles are written once: tiles (run, i, j, size, g), with (run, span, frames, n) in ``parts``.
    """

    def __init__(self, rows: DataFrame, scaled: bool = True):
        rows = written(rows, "blocks")
        self.parts = spans(rows)
        tiles = gram_tiles(rows)
        if scaled:
            n = self.parts.groupBy("run").agg(F.first("n").alias("n"))
            tiles = tiles.join(n, "run").withColumn("g", F.transform("g", lambda v: v / (F.col("n") - 1))).drop("n")
        self.tiles = written(tiles, "tiles")

    def entries(self) -> DataFrame:
        """Long form (run, i, j, v), both i and j being frames."""
        return entries(self.tiles, self.parts)

    def eigen(self, modes: int | None = None, energy: float | None = None) -> DataFrame:
        return written(eigenpairs(self.tiles, self.parts, modes, energy), "eigen")

    def diagonal(self) -> DataFrame:
        """(run, span, frame, v)."""
        own = self.tiles.filter("i = j").select("run", F.col("i").alias("span"), "size", "g")
        value = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda k: F.get("g", k * (F.col("size") + 1)))
        own = own.join(self.parts, ["run", "span"]).select("run", "span", F.inline(F.arrays_zip(F.col("frames").alias("frame"), value.alias("v"))))
        return own


def snapshot_covariance(df: DataFrame, col: str = "v") -> Covariance:
    """Covariance of the frames of each run."""
    return Covariance(cell_blocks(df, col))


def _solve(df: DataFrame, keys: Sequence[str], schema: str, fn) -> DataFrame:
    """Apply ``fn(matrix) -> DataFrame`` to every key's small Gram matrix, in parallel over keys."""
    keys = list(keys)
    types = dict(df.dtypes)
    head = ", ".join(f"{k} {types[k]}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                m = np.asarray(row.g, float).reshape(row.size, row.size)
                out = fn(m)
                for k in reversed(keys):
                    out.insert(0, k, getattr(row, k))
                yield out

    return df.select(*keys, "size", "g").mapInPandas(run, ", ".join(filter(None, [head, schema])))


def _eigen(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (largest first, not negative) and vectors whose largest entry is positive."""
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    return values, vectors * leads(vectors)


def modes_needed(spec: DataFrame, keys: Sequence[str], target: float, include_crossing: bool = True) -> DataFrame:
    """Modes that reach ``target``; without the crossing one the count is the printed, zero-based index."""
    first = F.min(F.when(F.col("cumulative") >= target - 1e-12, F.col("mode")))
    return spec.groupBy(*keys).agg((first + (1 if include_crossing else 0)).alias("needed"), F.max(F.when(F.col("mode") == 0, F.col("energy"))).alias("first_energy"))


def mode_energy(eigen: DataFrame) -> DataFrame:
    """(run, mode, value, energy, cumulative) of eigenpairs; energies of all modes sum to 1."""
    w = W.partitionBy("run").orderBy("mode")
    first = eigen.groupBy("run", "mode").agg(F.first("value").alias("value"), F.first("trace").alias("trace"))
    d = first.withColumn("energy", F.when(F.col("trace") > 0, F.col("value") / F.col("trace")).otherwise(0.0))
    return d.select("run", "mode", "value", "energy", F.sum("energy").over(w).alias("cumulative"))


def packed_basis(eigen: DataFrame) -> DataFrame:
    """(run, span, u): the pieces of all modes of a span as a modes x frames matrix."""
    rows = F.array_sort(F.collect_list(F.struct("mode", "u")))
    return eigen.groupBy("run", "span").agg(F.transform(rows, lambda m: m["u"]).alias("u"))


def projected_blocks(rows: DataFrame, eigen: DataFrame) -> DataFrame:
    """(run, block, phi): unscaled modes as cells x modes matrices, each cell's frames times every temporal vector."""
    j = rows.join(packed_basis(eigen), ["run", "span"]).select("run", "block", "x", "u")
    made = summed(j, ["run", "block"], lambda r: stack(r.x).T @ stack(r.u).T)
    cells = _matrix_udf(lambda g, n: np.asarray(g, float).reshape(n, -1), "g", "size")
    return made.select("run", "block", cells.alias("phi"))


def project_cells(rows: DataFrame, eigen: DataFrame) -> DataFrame:
    """(run, cell, phi): unscaled modes of every cell."""
    return block_cells(projected_blocks(rows, eigen), "phi")


def mode_coefficients(cov: Covariance, modes: int | None = None) -> DataFrame:
    """(run, mode, frame, a): coefficients Phi' Y, which equal (frames - 1) value_k U_k."""
    d = cov.eigen(modes).join(cov.parts.select("run", "span", "frames"), ["run", "span"])
    d = d.select("run", "mode", "value", "n", F.inline(F.arrays_zip(F.col("frames").alias("frame"), "u")))
    return d.select("run", "mode", "frame", (F.col("value") * (F.col("n") - 1) * F.col("u")).alias("a"))


def reconstruction_error(cov: Covariance, cells: DataFrame, target: float = 0.99, normalised: bool = True, eigen: DataFrame | None = None) -> DataFrame:
    """(run, kept, error): mean over the frames of the cell-wise RMS error with the modes below ``target`` energy.

    ``cells`` gives each run's number of them. With unit modes the reconstruction is a projection on the kept vectors;
    without (``normalised=False``) each mode's share is scaled by its energy. What remains of a frame's square is its
    diagonal entry less what the kept modes take of it, so no field is read again.
    """
    eigen = cov.eigen(energy=target) if eigen is None else eigen
    spec = mode_energy(eigen)
    kept = spec.groupBy("run").agg(F.coalesce(F.min(F.when(F.col("cumulative") >= target - 1e-12, F.col("mode"))), F.lit(0)).alias("kept"))
    used = eigen.join(kept, "run").filter(F.col("mode") < F.col("kept")).join(cov.parts.select("run", "span", "frames"), ["run", "span"])
    value = F.col("value") * (F.col("n") - 1)
    weight = F.lit(1.0) if normalised else value
    share = used.select("run", (value * weight * (2 - weight)).alias("w"), F.inline(F.arrays_zip(F.col("frames").alias("frame"), "u")))
    share = share.groupBy("run", "frame").agg(F.sum(F.col("w") * F.col("u") * F.col("u")).alias("taken"))
    n = cov.parts.groupBy("run").agg(F.first("n").alias("n"))
    rest = cov.diagonal().join(n, "run").select("run", "frame", (F.col("v") * (F.col("n") - 1)).alias("sq")).join(share, ["run", "frame"], "left").join(cells, "run").join(kept, "run")
    per = F.sqrt(F.greatest(F.lit(0.0), F.col("sq") - F.coalesce("taken", F.lit(0.0))) / F.col("cells"))
    return rest.groupBy("run", "kept").agg(F.avg(per).alias("error"))


def cell_counts(df: DataFrame, col: str = "v") -> DataFrame:
    """(run, cells)."""
    return df.groupBy("run").agg(F.max(F.size(col)).alias("cells"))


def sweep(df: DataFrame, a: str, b: str, col: str = "v") -> DataFrame:
    """Modes for 99 % and 95 %, first energy and error per run, with the margins over ``a`` and ``b``.

    ``df`` carries the sweep keys per frame; every run is independent.
    """
    cov = snapshot_covariance(df, col)
    eigen = cov.eigen(energy=0.99)
    spec = mode_energy(eigen)
    n99 = modes_needed(spec, ["run"], 0.99, False).withColumnRenamed("needed", "n99")
    n95 = modes_needed(spec, ["run"], 0.95, False).select("run", F.col("needed").alias("n95"))
    err = reconstruction_error(cov, cell_counts(df, col), 0.99, eigen=eigen).select("run", "error")
    keys = df.groupBy("run").agg(F.first(a).alias(a), F.first(b).alias(b))
    per = keys.join(n99, "run").join(n95, "run").join(err, "run")
    cols = ["n99", "n95", "first_energy", "error"]
    cells = per.groupBy(a, b).agg(*[F.avg(c).alias(c) for c in cols])
    return cells.cube(a, b).agg(*[F.avg(c).alias(c) for c in cols], F.count(F.lit(1)).alias("runs"))


def shift_mode_basis(df: DataFrame, starts: DataFrame, n_modes: int, col: str = "v") -> DataFrame:
    """(run, block, phi): orthonormal cells x modes blocks of the final period's leading modes and the mean flow.

    ``starts`` gives the frame at which each run's final period begins. The columns are
    made orthonormal through their k x k Gram matrix, never by gathering cells.
    """
    late = df.join(starts.select("run", "start"), "run").filter(F.col("frame") >= F.col("start"))
    eigen = snapshot_covariance(late, col).eigen(n_modes - 1).filter(F.col("mode") < n_modes - 1)
    modes = projected_blocks(cell_blocks(late, col, centred=False), eigen)
    mean = cell_means(cell_blocks(df, col, centred=False))
    both = modes.join(mean, ["run", "block"]).select("run", "block", _matrix_udf(lambda m, c: np.column_stack([m, c]), "phi", "mean").alias("phi"))
    return orthonormal(written(both, "columns"))


def orthonormal(phi: DataFrame) -> DataFrame:
    """Gram-Schmidt of the columns of cells x k blocks over a run, by Cholesky of their Gram matrix.

    A second round repairs the digits the first loses when columns are nearly parallel.
    """

    def one(m):
        scale = np.sqrt(np.maximum(np.diag(m), 1e-300))
        low = np.linalg.cholesky(m / np.outer(scale, scale) + 1e-14 * np.eye(len(m)))
        return pd.DataFrame({"w": [(np.linalg.inv(low) / scale[None, :]).ravel()]})

    turn = lambda m, w: m @ np.asarray(w, float).reshape(m.shape[1], m.shape[1]).T
    for _ in range(2):
        w = _solve(gram(phi, ["run"], _matrix_udf(lambda m: m.T, "phi"), matrices=True), ["run"], "w array<double>", one)
        phi = phi.join(w, "run").select("run", "block", _matrix_udf(turn, "phi", "w").alias("phi"))
    return phi


def project_frames(df: DataFrame, basis: DataFrame, col: str = "v") -> DataFrame:
    """(run, frame, mode, a): every frame on a basis in blocks; blocks add up their shares."""
    share = _matrix_udf(lambda m, b: m @ np.stack(b).astype(float), "x", "phi")
    j = cell_blocks(df, col, centred=False).join(basis, ["run", "block"]).select("run", F.arrays_zip("frames", share.alias("a")).alias("_z"))
    long = j.select("run", F.inline("_z")).select("run", F.col("frames").alias("frame"), F.posexplode("a").alias("mode", "a"))
    return long.groupBy("run", "frame", "mode").agg(F.sum("a").alias("a"))


def modal_energy(coeffs: DataFrame) -> DataFrame:
    return coeffs.groupBy("run", "frame").agg(F.sum(F.col("a") * F.col("a")).alias("energy"))


# --- pressure modes over snapshots of equal length --------------------------------------


def pressure_modes(df: DataFrame, keys: Sequence[str], col: str, target: float) -> DataFrame:
    """(keys, mode, value, cumulative, k, vector): left singular vectors that reach ``target`` energy.

    ``value`` is the singular value. A zero matrix gives one mode.
    """

    def one(m):
        v, u = _eigen(m)
        total = v.sum()
        cum = np.cumsum(v) / total if total > 0 else np.zeros_like(v)
        k = min(int(np.searchsorted(cum, target - 1e-12)) + 1, len(v)) if total > 0 else 1
        return pd.DataFrame(
            {"mode": np.arange(k, dtype="int32"), "value": np.sqrt(v[:k]), "cumulative": cum[:k], "k": np.int32(k), "vector": list(u[:, :k].T)}
        )

    return _solve(gram(df, keys, F.col(col)), keys, "mode int, value double, cumulative double, k int, vector array<double>", one)


def project_array(df: DataFrame, keys: Sequence[str], col: str, modes: DataFrame, name: str = "coef") -> DataFrame:
    """Add the array of each series' coefficients on its key's modes, in mode order.

    A key's modes are packed into one row (at most as many vectors as a series has samples), so the
    join never multiplies rows; without keys it is a join with a single row.
    """
    packed = modes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("mode", "vector"))).alias("_basis"))
    j = df.join(packed, list(keys)) if keys else df.join(F.broadcast(packed))
    dot = lambda m: F.aggregate(F.zip_with(col, m["vector"], lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return j.withColumn(name, F.transform("_basis", dot)).withColumn(name + "_modes", F.transform("_basis", lambda m: m["mode"])).drop("_basis")


def project_series(df: DataFrame, keys: Sequence[str], col: str, modes: DataFrame) -> DataFrame:
    """Coefficients of each series on its key's modes (one row per series and mode)."""
    d = project_array(df, keys, col, modes, "_c")
    rows = F.arrays_zip(F.col("_c_modes").alias("mode"), F.col("_c").alias("coef"))
    return d.select(*df.columns, F.inline(rows))


def singular_values(df: DataFrame, col: str = "v", modes: int | None = None) -> DataFrame:
    """Singular values of each run's cells x frames matrix (of a long recording the leading ``modes``)."""
    cov = Covariance(cell_blocks(df, col, centred=False), scaled=False)
    return mode_energy(cov.eigen(modes)).select("run", "mode", F.sqrt("value").alias("sigma"))


def dynamic_modes(df: DataFrame, rank: int, dt: float, col: str = "v") -> DataFrame:
    """Exact dynamic mode decomposition: (run, mode, re, im, frequency, growth, error).

    Everything follows from the frames' Gram matrix G: the leading pairs U, s^2 of its part without the last frame, the
    r x r product U' G1 U with the part G1 that lies one frame later, and two traces. A plain exact fit stands in for
    an optimised, bagged one.
    """
    blocks = written(cell_blocks(df, col, centred=False), "blocks")
    steps = previous_row(df.select("run", "frame"), ["run"], ["frame"], F.floor(F.col("frame") / FRAME_BLOCK), ["frame"])
    frames = written(steps.filter("prev_frame IS NOT NULL").select("run", F.col("prev_frame").alias("frame"), F.col("frame").alias("next")), "frames")
    early = df.join(frames.select("run", "frame"), ["run", "frame"], "left_semi")
    cov = Covariance(cell_blocks(early, col, centred=False), scaled=False)
    eigen = cov.eigen(rank).filter(F.col("mode") < rank)
    # X U and Y U by blocks of cells: U goes to its own frames, and to those that follow them.
    u = eigen.join(cov.parts.select("run", "span", "frames"), ["run", "span"]).select("run", "mode", F.inline(F.arrays_zip(F.col("frames").alias("frame"), "u")))
    u = u.join(frames, ["run", "frame"])
    sides = u.select("run", "mode", "u", F.inline(F.array(F.struct(F.lit(0).alias("side"), F.col("frame").alias("frame")), F.struct(F.lit(1).alias("side"), F.col("next").alias("frame")))))
    span = blocks.select("run", "span", F.explode("frames").alias("frame")).distinct()
    sides = sides.join(span, ["run", "frame"])
    vectors = F.transform(F.array_sort(F.collect_list(F.struct("frame", "u"))), lambda p: p["u"])
    listed = F.transform(F.array_sort(F.collect_list(F.struct("frame", "u"))), lambda p: p["frame"])
    by_mode = sides.groupBy("run", "span", "side", "mode").agg(vectors.alias("u"), listed.alias("own"))
    packed = by_mode.groupBy("run", "span", "side").agg(F.transform(F.array_sort(F.collect_list(F.struct("mode", "u"))), lambda p: p["u"]).alias("u"), F.first("own").alias("own"))
    j = blocks.join(packed, ["run", "span"]).select("run", "block", "side", "frames", "x", "u", "own")
    shares = summed(j, ["run", "block", "side"], lambda r: stack(r.x)[np.isin(np.asarray(r.frames), np.asarray(r.own))].T @ stack(r.u).T)
    xu = shares.filter("side = 0").select("run", "block", "size", F.col("g").alias("a"))
    yu = shares.filter("side = 1").select("run", "block", F.col("g").alias("b"))
    crossed = summed(xu.join(yu, ["run", "block"]), ["run"], lambda r: wide(r.a, r.size).T @ wide(r.b, r.size)).select("run", "size", "g")
    later = blocks.select("run", "block", "frames", "x").join(df.groupBy("run").agg(F.min("frame").alias("first")), "run")
    trace = summed(later.select("run", "frames", "x", "first"), ["run"], lambda r: (stack(r.x)[np.asarray(r.frames) != r.first] ** 2).sum().reshape(1, 1)).select("run", F.col("g")[0].alias("trace"))
    pairs = eigen.groupBy("run", "mode").agg(F.first("value").alias("value")).groupBy("run").agg(F.transform(F.array_sort(F.collect_list(F.struct("mode", "value"))), lambda p: p["value"]).alias("values"))
    small = crossed.join(pairs, "run").join(trace, "run")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                v = np.asarray(row.values, float)
                r = max(1, min(rank, int((v > v[0] * 1e-12).sum())))
                s = np.sqrt(np.maximum(v[:r], 1e-300))
                step = wide(row.g, row.size)[:r, :r]
                low = step / np.outer(s, s)
                lam = np.linalg.eigvals(low)
                lam = lam[np.lexsort((lam.imag, -np.abs(lam).round(10)))]
                # |Y - X U s^-1 low s U'|^2 in the same small products.
                scaled = low * s[None, :]
                back = ((low * s[None, :]).T / s[None, :]) @ step
                rest = row.trace - 2 * np.trace(back) + (scaled**2).sum()
                err = np.sqrt(max(rest, 0.0) / max(row.trace, 1e-300))
                log = np.log(lam.astype(complex)) / dt
                yield pd.DataFrame(
                    {"run": row.run, "mode": np.arange(r, dtype="int32"), "re": lam.real, "im": lam.imag, "frequency": log.imag / (2 * np.pi), "growth": log.real, "error": err}
                )

    return small.mapInPandas(solve, "run int, mode int, re double, im double, frequency double, growth double, error double")


def delay_stack(df: DataFrame, delays: int, col: str = "v") -> DataFrame:
    """Each frame followed by the next ``delays - 1`` frames of its run, by equi-joins on the frame."""
    out = df.select("run", "frame", F.array(F.col(col)).alias("_s"))
    for k in range(1, delays):
        nxt = df.select("run", (F.col("frame") - k).alias("frame"), F.col(col).alias("_n"))
        out = out.join(nxt, ["run", "frame"]).select("run", "frame", F.concat("_s", F.array("_n")).alias("_s"))
    return out.select("run", "frame", F.flatten("_s").alias(col))


# --- identification of dynamics ---------------------------------------------------------


def terms(names: Sequence[str], degree: int, bias: bool = True) -> list[tuple[str, ...]]:
    """Monomials of the states up to ``degree``, by degree then order of the names."""
    out = [()] if bias else []
    for d in range(1, degree + 1):
        out += list(itertools.combinations_with_replacement(names, d))
    return out


def term_name(t: tuple[str, ...]) -> str:
    return " ".join(t) if t else "1"


def term_column(t: tuple[str, ...]) -> Column:
    c = F.lit(1.0)
    for name in t:
        c = c * F.col(name)
    return c


def library(df: DataFrame, names: Sequence[str], degree: int, bias: bool = True) -> DataFrame:
    """``theta``: the monomials of each row as one array, in the order of ``terms``."""
    return df.withColumn("theta", F.array(*[term_column(t) for t in terms(names, degree, bias)]))


def derivatives(df: DataFrame, keys: Sequence[str], n: str, names: Sequence[str], dt: float) -> DataFrame:
    """Central differences of the states; the ends of a trajectory are dropped.

    Neighbours come by equi-joins on the sample number, so no trajectory is sorted whole.
    """
    shift = lambda k, tag: df.select(*keys, (F.col(n) + k).alias(n), *[F.col(c).alias(c + tag) for c in names])
    j = df.join(shift(-1, "_next"), [*keys, n]).join(shift(1, "_prev"), [*keys, n])
    rates = {f"d_{c}": (F.col(c + "_next") - F.col(c + "_prev")) / (2 * dt) for c in names}
    return j.withColumns(rates).drop(*[c + t for c in names for t in ("_next", "_prev")])


def threshold_least_squares(g: np.ndarray, rhs: np.ndarray, threshold: float, ridge: float = 0.05, rounds: int = 20) -> np.ndarray:
    """Ridge least squares from Gram blocks with small coefficients dropped until none changes."""
    k, states = rhs.shape
    coef = np.zeros((k, states))
    for s in range(states):
        on = np.ones(k, bool)
        for _ in range(rounds):
            if not on.any():
                break
            sub = g[np.ix_(on, on)] + ridge * np.eye(on.sum())
            value = np.zeros(k)
            value[on] = np.linalg.solve(sub, rhs[on, s])
            keep = np.abs(value) >= threshold
            coef[:, s] = np.where(keep, value, 0.0)
            if (keep == on).all():
                break
            on = keep & on
        if on.any():
            coef[on, s] = np.linalg.lstsq(g[np.ix_(on, on)], rhs[on, s], rcond=None)[0]
    return coef


def sparse_fit(df: DataFrame, names: Sequence[str], degree: int, thresholds: Sequence[float], bias: bool = True, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, threshold, term, state, coef, mse): one pass over the data, many thresholds.

    The derivative error of each model comes from the same Gram matrix.
    """
    ts, names = terms(names, degree, bias), list(names)
    labels = [term_name(t) for t in ts]

    def one(m):
        k = len(labels)
        g, rhs, yy, count = m[:k, :k], m[:k, k:-1], np.diag(m)[k:-1], m[-1, -1]
        rows = []
        for thr in thresholds:
            c = threshold_least_squares(g, rhs, thr)
            sse = yy - 2 * (c * rhs).sum(axis=0) + np.einsum("ks,kj,js->s", c, g, c)
            for s, state in enumerate(names):
                rows += [(float(thr), labels[i], state, float(c[i, s]), float(max(sse[s], 0.0) / count)) for i in range(k)]
        return pd.DataFrame(rows, columns=["threshold", "term", "state", "coef", "mse"])

    g = gram(df, keys, F.concat("theta", F.array(*[F.col(f"d_{c}") for c in names], F.lit(1.0))))
    return _solve(g, keys, "threshold double, term string, state string, coef double, mse double", one)


def ensemble_fit(
    df: DataFrame, row_id: Column, names: Sequence[str], degree: int, threshold: float, replicas: int, seed: int, drop_terms: bool = False, bias: bool = True
) -> DataFrame:
    """Mean and deviation of coefficients over bootstrap replicas, or over libraries short of one term.

    A replica draws each row a Poisson(1) number of times from a hash of the row, so a
    re-run task draws the same; all replicas' matrices come from one pass.
    """
    ts = terms(names, degree, bias)
    labels, k = [term_name(t) for t in ts], len(ts)
    rows = F.concat("theta", F.array(*[F.col(f"d_{c}") for c in names]))
    if drop_terms:
        g = gram(df, [], rows)
        replica = g.withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    else:
        # Poisson(1) by inversion of a uniform hash (cumulative probabilities, fixed values).
        steps = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119]
        u = lambda r: F.pmod(F.xxhash64(row_id, r, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
        draws = lambda r: sum(((u(r) >= s).cast("double") for s in steps), F.lit(0.0))
        replica = weighted_gram(df, rows, F.array(*[draws(F.lit(r)) for r in range(replicas)]))

    def one(m, dropped=None):
        g, rhs = m[:k, :k].copy(), m[:k, k:].copy()
        if dropped is not None:
            g[dropped, :], g[:, dropped], rhs[dropped] = 0, 0, 0
            g[dropped, dropped] = 1
        c = threshold_least_squares(g, rhs, threshold)
        i, s = np.meshgrid(np.arange(k), np.arange(len(names)), indexing="ij")
        return pd.DataFrame({"term": np.array(labels, object)[i.ravel()], "state": np.array(list(names), object)[s.ravel()], "coef": c.ravel()})

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                m = np.asarray(row.g, float).reshape(row.size, row.size)
                yield one(m, int(row.replica) if drop_terms else None)

    fits = replica.select("replica", "size", "g").mapInPandas(run, "term string, state string, coef double")
    return fits.groupBy("term", "state").agg(F.avg("coef").alias("mean"), F.stddev_pop("coef").alias("spread"))


def predict_derivatives(df: DataFrame, coefs: DataFrame, names: Sequence[str], degree: int, bias: bool = True) -> DataFrame:
    """Model derivative ``p_<state>`` and residual ``r_<state>`` for every row.

    The coefficients (terms x states) become one broadcast row of arrays.
    """
    order = {term_name(t): i for i, t in enumerate(terms(names, degree, bias))}
    rank = F.create_map(*[x for k, v in order.items() for x in (F.lit(k), F.lit(v))])
    packed = F.array_sort(F.collect_list(F.struct(rank[F.col("term")].alias("i"), "coef")))
    per = coefs.groupBy("state").agg(F.transform(packed, lambda s: s["coef"]).alias("w"))
    wide = per.groupBy().agg(*[F.max(F.when(F.col("state") == c, F.col("w"))).alias("_w_" + c) for c in names])
    j = df.join(F.broadcast(wide))
    dot = lambda c: F.aggregate(F.zip_with("theta", "_w_" + c, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    out = j.withColumns({f"p_{c}": dot(c) for c in names})
    return out.withColumns({f"r_{c}": F.col(f"d_{c}") - F.col(f"p_{c}") for c in names}).drop(*["_w_" + c for c in names])


def relative_errors(df: DataFrame, keys: Sequence[str], truth: Sequence[str], guess: Sequence[str]) -> DataFrame:
    """Frobenius error of all values, and the mean over rows of each row's relative squared error."""
    sq = lambda cols: sum((c * c for c in cols[1:]), cols[0] * cols[0])
    diff = sq([F.col(a) - F.col(b) for a, b in zip(truth, guess)])
    size = sq([F.col(a) for a in truth])
    return df.groupBy(*keys).agg(
        F.sqrt(F.sum(diff) / F.nullif(F.sum(size), F.lit(0.0))).alias("frobenius"),
        F.avg(diff / F.nullif(size, F.lit(0.0))).alias("mean_relative"),
    )
