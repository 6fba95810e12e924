"""Problem 2: percentiles per group over very many values, from partial results that can be combined.

Method: dyadic Count-sketches. Values are encoded in order with a bounded relative error; for each binary resolution of
the code space there is one signed sketch (the resolutions coarse enough to have few occupied nodes are held exactly).
Every task sketches its own rows; sketches merge by addition, so those of partitions and days combine, and negative
weights delete. A percentile is found by descending the resolutions, at each step into the half that holds its rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits kept of a value: codes are exact below 2**(BITS + 1), beyond that the relative error is at most 2**-(BITS + 1).
BITS = 11
#: Codes of all non-negative 64-bit values fit this many bits.
CODE_BITS = 17
#: Columns and rows of each resolution's sketch.
WIDTH, DEPTH = 1024, 5
#: Nodes of the finest resolution that is held exactly, and heavy codes held apart.
EXACT_NODES, ATOMS = 1024, 128
#: Standard deviations that the stated bound allows each sketched resolution. By Chebyshev a row lies outside with a chance
#: of 1/9 at most, the median of five rows with 1.2 %, so a percentile of k sketched resolutions (two estimates each) lies
#: within its bound with a chance of at least 1 - 0.024 k.
SIGMAS = 3.0
#: Partial sketches that one task adds up, by their tasks' numbers, before the sums of a group meet.
FAN_IN = 64
QUANTILES = (0.5, 0.9, 0.95, 0.99)
#: Rows that a task gathers before it turns them into counts.
CHUNK_ROWS = 400_000


def encode(values: np.ndarray) -> np.ndarray:
    """Codes of non-negative integers, in the order of the values."""
    values = values.astype(np.int64)
    large = values >= 1 << 52
    length = np.where(large, np.frexp((values >> 12).astype(float))[1] + 12, np.frexp(values.astype(float))[1])
    shift = np.maximum(length - (BITS + 1), 0)
    return (shift << BITS) + (values >> shift)


def decode(codes: np.ndarray) -> np.ndarray:
    """The middle of the values that have each code."""
    shift = np.maximum((codes >> BITS) - 1, 0)
    low = (codes - (shift << BITS)) << shift
    return low + ((np.int64(1) << shift) - 1) / 2


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sketch:
    """A dyadic Count-sketch of weighted codes. ``nodes`` and ``weights`` hold the resolution ``level`` exactly (and with it
    all coarser ones), ``cells`` one signed sketch for each finer resolution. As long as few codes are held, the level is 0
    and nothing is sketched. Heavy codes (``atoms``) are held apart, so that the sketches carry the light rest only. All
    parts are sums over codes: sketches add up, and negative weights delete."""

    __slots__ = ("level", "nodes", "weights", "atoms", "atom_weights", "cells")

    def __init__(self, codes: np.ndarray, weights: np.ndarray):
        self.level, self.cells = 0, []
        self.atoms = self.atom_weights = np.zeros(0, np.int64)
        self.nodes, self.weights = summed(codes.astype(np.int64), weights.astype(np.int64))
        self.shrink()

    def coarsen(self) -> None:
        if self.level == 0:
            heavy = np.zeros(len(self.nodes), bool)
            heavy[np.argsort(-np.abs(self.weights), kind="stable")[:ATOMS]] = True
            self.atoms, self.atom_weights = summed(np.concatenate([self.atoms, self.nodes[heavy]]), np.concatenate([self.atom_weights, self.weights[heavy]]))
            self.nodes, self.weights = self.nodes[~heavy], self.weights[~heavy]
        self.cells.append(sketched(self.level, self.nodes, self.weights))
        self.level += 1
        self.nodes, self.weights = summed(self.nodes >> 1, self.weights)

    def shrink(self) -> None:
        if len(self.atoms) > 2 * ATOMS:
            light = np.ones(len(self.atoms), bool)
            light[np.argsort(-np.abs(self.atom_weights), kind="stable")[:ATOMS]] = False
            codes, weights = self.atoms[light], self.atom_weights[light]
            self.cells = [c + sketched(k, codes >> k, weights) for k, c in enumerate(self.cells)]
            self.nodes, self.weights = summed(np.concatenate([self.nodes, codes >> self.level]), np.concatenate([self.weights, weights]))
            self.atoms, self.atom_weights = self.atoms[~light], self.atom_weights[~light]
        while len(self.nodes) > EXACT_NODES:
            self.coarsen()

    def add(self, other: Sketch) -> Sketch:
        while self.level < other.level:
            self.coarsen()
        while other.level < self.level:
            other.coarsen()
        self.nodes, self.weights = summed(np.concatenate([self.nodes, other.nodes]), np.concatenate([self.weights, other.weights]))
        self.atoms, self.atom_weights = summed(np.concatenate([self.atoms, other.atoms]), np.concatenate([self.atom_weights, other.atom_weights]))
        self.cells = [a + b for a, b in zip(self.cells, other.cells, strict=True)]
        self.shrink()
        return self

    def atoms_in(self, level: int, node: int) -> int:
        first, last = np.searchsorted(self.atoms, [node << level, (node + 1) << level])
        return int(self.atom_weights[first:last].sum())

    def count(self, level: int, node: int) -> float:
        """Estimated weight of a node of a sketched resolution, atoms aside."""
        at, sign = hashed(level, np.array([node]))
        return float(np.median(self.cells[level][np.arange(DEPTH), at[:, 0]] * sign[:, 0]))

    def quantiles(self, q: tuple) -> tuple[int, list[float], float]:
        """Total weight, values at the quantiles ``q``, and the bound of their rank error as a share of the weight."""
        nodes, weights = summed(np.concatenate([self.nodes, self.atoms >> self.level]), np.concatenate([self.weights, self.atom_weights]))
        n = int(weights.sum())
        if n <= 0:
            return n, [float("nan")] * len(q), 0.0
        sums, found = np.cumsum(weights), []
        for x in q:
            rank = max(int(np.ceil(x * n)), 1)
            at = min(int(np.searchsorted(sums, rank)), len(nodes) - 1)
            node, rest, weight = int(nodes[at]), float(rank - (sums[at] - weights[at])), float(weights[at])
            for level in range(self.level - 1, -1, -1):
                left, right = self.atoms_in(level, 2 * node), self.atoms_in(level, 2 * node + 1)
                light = max(weight - left - right, 0.0)
                left += min(max((self.count(level, 2 * node) + light - self.count(level, 2 * node + 1)) / 2, 0.0), light)
                node = 2 * node
                if rest > left:
                    node, rest, weight = node + 1, rest - left, weight - left
                else:
                    weight = left
            found.append(float(decode(np.array([node]))[0]))
        # A row's error has the variance F2 / WIDTH; F2 is estimated from the rows themselves.
        sigma = [float(np.sqrt(np.median(np.square(c.astype(float)).sum(axis=1)) / WIDTH)) for c in self.cells]
        return n, found, min(1.0, SIGMAS * sum(sigma) / n)

    def pack(self) -> bytes:
        head = np.array([self.level, len(self.nodes), len(self.atoms)], np.int64)
        parts = [head, self.nodes, self.weights, self.atoms, self.atom_weights, *(c.ravel() for c in self.cells)]
        return zlib.compress(np.concatenate(parts).tobytes(), 1)

    @classmethod
    def unpack(cls, data: bytes) -> Sketch:
        flat = np.frombuffer(zlib.decompress(data), np.int64)
        level, n, m = (int(x) for x in flat[:3])
        out = cls.__new__(cls)
        out.level = level
        out.nodes, out.weights, out.atoms, out.atom_weights, cells = np.split(flat[3:], np.cumsum([n, n, m, m]))
        out.cells = list(cells.reshape(level, DEPTH, WIDTH))
        return out


def summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with their summed weights; those that cancel out go."""
    if len(keys) > 1 and not (np.diff(keys) > 0).all():
        order = np.argsort(keys, kind="stable")
        keys, weights = keys[order], weights[order]
        first = np.flatnonzero(np.concatenate([[True], np.diff(keys) > 0]))
        keys, weights = keys[first], np.add.reduceat(weights, first)
    kept = weights != 0
    return (keys, weights) if kept.all() else (keys[kept], weights[kept])


def hashed(level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell and sign of each node in each row of a resolution's sketch."""
    seeds = (np.arange(level * DEPTH + 1, (level + 1) * DEPTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
    h = mix(nodes.astype(np.uint64)[None, :] + seeds)
    return (h >> np.uint64(40)).astype(np.int64) % WIDTH, np.where(h & np.uint64(1), 1, -1)


def sketched(level: int, nodes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The signed sketch of a resolution: DEPTH rows of WIDTH cells."""
    at, sign = hashed(level, nodes)
    flat = np.bincount((at + np.arange(DEPTH)[:, None] * WIDTH).ravel(), (sign * weights).ravel(), DEPTH * WIDTH)
    return np.rint(flat).astype(np.int64).reshape(DEPTH, WIDTH)


def key_fields(df: DataFrame, keys: list[str]) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


def partial(df: DataFrame, keys: list[str], metrics: dict[str, int], weight_col: str | None) -> DataFrame:
    """``keys``, ``metric``, ``sketch_part`` (number of the task, by FAN_IN), ``cells``: a sketch of each group and metric of every
    CHUNK_ROWS rows of a task, made where the rows are. However many rows a group has, only sketches leave the task."""
    schema = T.StructType([*key_fields(df, keys), T.StructField("metric", T.StringType()), T.StructField("sketch_part", T.IntegerType()), T.StructField("cells", T.BinaryType())])
    names, least, n_keys = list(metrics), list(metrics.values()), len(keys)
    columns = df.select(*keys, *(F.col(m).cast("long").alias(m) for m in names), (F.lit(1) if weight_col is None else F.col(weight_col)).cast("long").alias("weight"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, rows, part = [], 0, TaskContext.get().partitionId() // FAN_IN
        own = [f"k{i}" for i in range(n_keys)]

        def out() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held)
            for name, low, at in zip(names, least, range(n_keys, n_keys + len(names)), strict=True):
                known = pc.and_(pc.fill_null(pc.greater_equal(whole.column(at), low), False), pc.is_valid(whole.column(n_keys + len(names))))
                some = whole.filter(known)
                if not some.num_rows:
                    continue
                codes = pa.array(encode(some.column(at).to_numpy()).astype(np.int32))
                flat = pa.table([*(some.column(i) for i in range(n_keys)), codes, some.column(n_keys + len(names))], names=[*own, "code", "w"])
                once = flat.group_by([*own, "code"], use_threads=False).aggregate([("w", "sum")])
                once = once.append_column("one", pa.array(np.zeros(once.num_rows, np.int8)))
                lists = once.group_by([*own, "one"], use_threads=False).aggregate([("code", "list"), ("w_sum", "list")]).combine_chunks()
                codes, weights = (lists.column(c).chunk(0) for c in ("code_list", "w_sum_list"))
                cells = [Sketch(codes[i].values.to_numpy(), weights[i].values.to_numpy()).pack() for i in range(lists.num_rows)]
                yield from pa.table([*(lists.column(k) for k in own), pa.array([name] * lists.num_rows, pa.string()), pa.array([part] * lists.num_rows, pa.int32()), pa.array(cells, pa.binary())], names=[*keys, "metric", "sketch_part", "cells"]).to_batches()

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK_ROWS:
                yield from out()
                held, rows = [], 0
        if rows:
            yield from out()

    return columns.mapInArrow(run, schema)


def streamed(df: DataFrame, keys: list[str], schema: T.StructType, work) -> DataFrame:
    """``df`` partitioned and sorted by ``keys``; ``work`` gets a task's rows one by one and yields tuples. A group
    passes through its task row by row and is never held whole."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                columns = [c if pa.types.is_list(c.type) else c.to_pylist() for c in batch.columns]
                for i in range(batch.num_rows):
                    yield [c[i].values.to_numpy() if isinstance(c, pa.Array) else c[i] for c in columns]

        held = []
        for row in work(rows()):
            held.append(row)
            if len(held) >= 256:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def sketches(df: DataFrame, keys: list[str], metrics: dict[str, int], weight_col: str | None = None) -> DataFrame:
    """``keys``, ``metric``, ``cells``: a dyadic Count-sketch of each metric column for each group.

    ``metrics`` maps a column of non-negative integers to its least value; nulls and smaller values are no measurement
    and are left aside. ``weight_col`` gives each row's weight (null: left out; negative: a deletion). Null keys are a
    group of their own. Groups without a measurement, and an empty table, give no row. Other columns are ignored.
    """
    # A tree of two stages: a hot group's sketches, one a task, are added up by several tasks first.
    return merged(merged(partial(df, keys, metrics, weight_col), [*keys, "sketch_part"]), keys)


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches of ``parts`` (with ``keys``, ``metric``, ``cells``) added up for each of ``keys``."""
    schema = T.StructType([*key_fields(parts, keys), T.StructField("metric", T.StringType()), T.StructField("cells", T.BinaryType())])
    n_keys = len(keys)

    def work(rows):
        key, total = None, None
        for row in rows:
            if row[: n_keys + 1] != key:
                if key is not None:
                    yield (*key, total.pack())
                key, total = row[: n_keys + 1], None
            own = Sketch.unpack(row[n_keys + 1])
            total = own if total is None else total.add(own)
        if key is not None:
            yield (*key, total.pack())

    return streamed(parts.select(*keys, "metric", "cells"), [*keys, "metric"], schema, work)


def result_fields(q: tuple) -> list[T.StructField]:
    numbers = [f"p{f'{100 * x:g}'.replace('.', '_')}" for x in q]
    return [T.StructField("n", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in (*numbers, "rank_error", "value_error"))]


def percentiles(parts: DataFrame, keys: list[str], over: str | None = None, q: tuple = QUANTILES) -> DataFrame:
    """Percentiles of sketches: ``keys`` (and ``over``), ``metric``, ``n``, one column a quantile (``p50`` ...),
    ``rank_error`` (bound of the rank error as a share of n, 0 where all codes are held exactly; see SIGMAS) and ``value_error`` (of the relative value error).

    With ``over``, rows of each ``over`` (``scope`` = ``over``'s name) and, from the same pass, of the sum over all of
    them (``scope`` = ``all``, ``over`` null). Sketches that sum to no weight give no row.
    """
    n_keys, error = len(keys), 2.0 ** -(BITS + 1)
    extra = [] if over is None else [parts.schema[over], T.StructField("scope", T.StringType())]
    schema = T.StructType([*key_fields(parts, keys), T.StructField("metric", T.StringType()), *extra, *result_fields(q)])

    def work(rows):
        def line(key, more, sketch):
            n, values, bound = sketch.quantiles(q)
            if n > 0:
                yield (*key, *more, n, *values, bound, error)

        key, total = None, None
        for row in rows:
            if row[: n_keys + 1] != key:
                if key is not None and over is not None:
                    yield from line(key, (None, "all"), total)
                key, total = row[: n_keys + 1], None
            own = Sketch.unpack(row[-1])
            if over is None:
                yield from line(key, (), own)
            else:
                yield from line(key, (row[n_keys + 1], over), own)
                total = own if total is None else total.add(own)
        if key is not None and over is not None:
            yield from line(key, (None, "all"), total)

    columns = [*keys, "metric", *([over] if over else []), "cells"]
    return streamed(parts.select(*columns), [*keys, "metric"], schema, work)
