"""Sums over the edges into a node, without a vector for each edge on disk.

The edges are dealt once to parts by the node they lead into and packed, each part
holding every edge of its nodes. A task then reads the packed vectors of all nodes
from one written table, one chunk after the other, and adds what its edges carry to
the sums of its nodes. Neither the vectors nor the sums are shuffled: what is
written grows with the edges and the vectors, not with their product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinedge.scratch import materialise, new_path, swept

PART_EDGES = 1 << 22
"""Edges of a part, about; a node's edges are not divided."""

PART_BYTES = 384 << 20
"""Sums of a part, about."""

LEAST_EDGES = 1 << 17
"""Edges for which a part of their own is worth while."""

FLUSH = 1 << 21
"""Edges that are packed at a time."""

GROUP_BYTES = 8 << 20
"""Vectors whose edges are packed together, about."""

CHUNK_BYTES = 1 << 19
"""Vectors in a row. The rows of a Parquet group are not weighed before the 100th."""

PASS_BYTES = 1 << 30
"""Vectors, about, that are dealt to their groups at a time: so much of the shuffle is
on disk beside the packed vectors."""

TURNS = 16
"""Edges of a node and chunk that are added in turns; further ones are multiplied."""

STEP_BYTES = 1 << 18
"""Messages that are made at a time; they should stay in the cache."""


# ---- packing -------------------------------------------------------------

def _squeezed(numbers: np.ndarray) -> bytes:
    return pa.compress(numbers.tobytes(), codec="zstd", asbytes=True)


def _read(held: bytes, n: int, dtype: str) -> np.ndarray:
    size = n * np.dtype(dtype).itemsize
    return np.frombuffer(pa.decompress(held, size, codec="zstd", asbytes=True) if size else b"", dtype)


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _turns(dst: np.ndarray) -> np.ndarray:
    """How many of the same number came before, for sorted numbers."""
    if not len(dst):
        return np.zeros(0, np.int64)
    starts = np.flatnonzero(np.r_[True, dst[1:] != dst[:-1]])
    return np.arange(len(dst)) - np.repeat(starts, np.diff(np.r_[starts, len(dst)]))


@dataclass
class _Part:
    """The edges of one part that wait to be packed, and the numbers of its nodes."""

    view: pa.Scalar
    waiting: list[tuple[np.ndarray, ...]] = field(default_factory=list)
    edges: int = 0
    known: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # sorted
    numbers: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def numbered(self, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of nodes, and the nodes that had none yet."""
        found, inverse = np.unique(dst, return_inverse=True)
        new = found[~np.isin(found, self.known, assume_unique=True)]
        known = np.concatenate([self.known, new])
        numbers = np.concatenate([self.numbers, len(self.numbers) + np.arange(len(new))])
        order = np.argsort(known, kind="stable")
        self.known, self.numbers = known[order], numbers[order]
        return self.numbers[np.searchsorted(self.known, found)][inverse], new

    def rows(self) -> Iterator[tuple]:
        """``(group, first, n, ids, src, dst, w, unweighted, cuts)``."""
        group, src, dst, w, missing, no_node = map(np.concatenate, zip(*self.waiting))
        self.waiting, self.edges = [], 0
        first = len(self.numbers)
        # a null node is a node; it gets a row of its own below
        local, new = self.numbered(dst[~no_node])
        place = np.full(len(dst), -1, np.int64)
        place[~no_node] = local
        if len(new):
            yield -1, first, len(new), _squeezed(new), None, None, None, None, None
        order = np.lexsort((place, group))
        group, src, place, w, missing = (a[order] for a in (group, src, place, w, missing))
        bounds = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
        for a, b in zip(bounds[:-1], bounds[1:]):
            turn = np.minimum(_turns(place[a:b]), TURNS)
            late = turn == TURNS
            # by turn, and by source within one; those after the last turn stay by node
            order = a + np.lexsort((np.where(late, np.arange(b - a), src[a:b]), turn))
            cuts = np.bincount(turn, minlength=TURNS + 1).cumsum()
            gaps = np.diff(src[order], prepend=np.int64(0))  # wraps around and back
            unweighted = _squeezed(missing[order]) if missing[a:b].any() else None
            yield int(group[a]), 0, int(b - a), None, _squeezed(gaps), _squeezed(place[order].astype(np.int32)), _squeezed(w[order]), unweighted, cuts.astype(np.int64).tobytes()


_PACKED = "part int, {view}, `group` int, first bigint, n int, ids binary, src binary, dst binary, w binary, unweighted binary, cuts binary"
_NAMES = ["part", "view", "group", "first", "n", "ids", "src", "dst", "w", "unweighted", "cuts"]


def _pack(view_type: pa.DataType):
    types = [pa.int32(), view_type, pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 6]

    def table(part: int, held: _Part) -> Iterator[pa.RecordBatch]:
        for row in held.rows():
            values = (part, held.view.as_py(), *row)
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], _NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, _Part] = {}
        for batch in batches:
            owner = _column(batch, "part")
            nodes = batch.column("dst")
            columns = [
                _column(batch, "group"), _column(batch, "src"), nodes.fill_null(0).to_numpy(zero_copy_only=False),
                batch.column("w").fill_null(0.0).to_numpy(zero_copy_only=False), batch.column("w").is_null().to_numpy(zero_copy_only=False),
                nodes.is_null().to_numpy(zero_copy_only=False),
            ]
            for part in np.unique(owner):
                at = np.flatnonzero(owner == part)
                held = parts.setdefault(int(part), _Part(batch.column("view")[int(at[0])]))
                held.waiting.append(tuple(c[at] for c in columns))
                held.edges += len(at)
                if held.edges >= FLUSH:
                    yield from table(int(part), held)
        for part, held in parts.items():
            if held.edges:
                yield from table(part, held)

    return run


def _chunks(width: int, dtype: str, by_view: bool, view_type: pa.DataType):
    """Packed vectors of ``(view, group, idx, vec)``; copies of a node are added up."""
    most = max(1, CHUNK_BYTES // (np.dtype(dtype).itemsize * width))
    names = ["x_view", "x_group", "x_n", "x_ids", "copies", "numbers", "gaps"]
    types = [view_type, pa.int32(), pa.int32(), *[pa.binary()] * 4]

    def rows(view, group: int, ids: np.ndarray, cells: np.ndarray, gap: np.ndarray) -> Iterator[pa.RecordBatch]:
        found, starts, inverse, copies = np.unique(ids, return_index=True, return_inverse=True, return_counts=True)
        if len(found) == len(ids):
            cells, gap = cells[starts], gap[starts]
        else:
            sums, filled = np.zeros((len(found), width), cells.dtype), np.zeros((len(found), width), bool)
            np.add.at(sums, inverse, cells)
            np.logical_or.at(filled, inverse, ~gap)
            cells, gap = sums, ~filled
        for a in range(0, len(found), most):
            part = slice(a, a + most)
            gaps = gap[part].tobytes() if gap[part].any() else None
            values = (view, group, len(found[part]), found[part].tobytes(), copies[part].astype(np.float64).tobytes(), cells[part].tobytes(), gaps)
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[tuple]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = _column(batch, "group")
            views = batch.column("view").to_pylist() if by_view else [None] * batch.num_rows
            cells, gap = _cells(batch.column("vec"), width, dtype)
            keys: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(views, groups.tolist())):
                keys.setdefault(key, []).append(i)
            ids = _column(batch, "idx")
            for key, at in keys.items():
                held.setdefault(key, []).append((ids[at], cells[at], gap[at]))
        for (view, group), found in held.items():
            yield from rows(view, group, *map(np.concatenate, zip(*found)))

    return run


def _cells(column: pa.Array, width: int, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """The first ``width`` numbers of each list, and where there is none."""
    flat = column.flatten()
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    values = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    absent = flat.is_null().to_numpy(zero_copy_only=False)
    whole = lengths == width
    if whole.all():
        return values.reshape(-1, width), absent.reshape(-1, width)
    cells, gap = np.zeros((len(column), width), dtype), np.ones((len(column), width), bool)
    starts = np.cumsum(lengths) - lengths
    at = (starts[whole][:, None] + np.arange(width)).ravel()
    cells[whole], gap[whole] = values[at].reshape(-1, width), absent[at].reshape(-1, width)
    for i in np.flatnonzero(~whole & (lengths > 0)):
        part = slice(starts[i], starts[i] + min(lengths[i], width))
        cells[i, : part.stop - part.start], gap[i, : part.stop - part.start] = values[part], absent[part]
    return cells, gap


# ---- sums ----------------------------------------------------------------

class _Sums:
    """Sums of the nodes of one part; row 0 is for the null node."""

    def __init__(self, view, width: int):
        self.view, self.width = view, width
        self.ids = np.zeros(1, np.int64)
        self.cells = np.zeros((1, width))
        self.total = np.zeros(1)
        self.met = np.zeros(1, bool)
        self.weighted = np.zeros(1, bool)
        self.filled = np.zeros((1, 0), bool)  # by number, once a vector with gaps was met
        self.step = max(1, STEP_BYTES // (8 * width))
        self.message, self.reached = np.empty((self.step, width)), np.empty((self.step, width))

    def name(self, first: int, ids: np.ndarray) -> None:
        self.reserve(first + 1 + len(ids))
        self.ids[first + 1 : first + 1 + len(ids)] = ids

    def reserve(self, n: int) -> None:
        if n > len(self.ids):
            for name in ("ids", "cells", "total", "met", "weighted", "filled"):
                old = getattr(self, name)
                grown = np.zeros((n, *old.shape[1:]), old.dtype)
                grown[: len(old)] = old
                setattr(self, name, grown)

    def add(self, chunk: tuple, block: tuple) -> None:
        ids, copies, cells, gap = chunk
        src, dst, w, unweighted, cuts = block
        place = np.minimum(np.searchsorted(ids, src), len(ids) - 1)
        there = ids[place] == src
        if gap is not None and not self.filled.shape[1]:
            self.filled = np.repeat(self.weighted[:, None], self.width, axis=1)
        step = self.step
        for turn, (a, b) in enumerate(zip(np.r_[0, cuts[:-1]], cuts)):
            kept = a + np.flatnonzero(there[a:b])
            if not len(kept):
                continue
            p, d, weight = place[kept], dst[kept], w[kept]
            known = slice(None) if unweighted is None else ~unweighted[kept]
            self.met[d] = True
            self.weighted[d[known]] = True
            np.add.at(self.total, d, weight * copies[p])
            if self.filled.shape[1]:
                there_too = np.ones((len(p), self.width), bool) if gap is None else ~gap[p]
                np.logical_or.at(self.filled, d[known], there_too[known])
            if turn < TURNS:  # no node comes twice
                if cells.dtype != np.float64:
                    cells = cells.astype(np.float64)
                for i in range(0, len(p), step):
                    n = len(p[i : i + step])
                    message, reached = self.message[:n], self.reached[:n]
                    np.take(cells, p[i : i + step], axis=0, out=message, mode="clip")
                    np.take(self.cells, d[i : i + step], axis=0, out=reached, mode="clip")
                    message *= weight[i : i + step, None]
                    message += reached
                    self.cells[d[i : i + step]] = message
            else:
                bounds = np.flatnonzero(np.r_[True, d[1:] != d[:-1], True])
                for x, y in zip(bounds[:-1], bounds[1:]):
                    for i in range(x, y, step):
                        at = slice(i, min(y, i + step))
                        self.cells[d[x]] += weight[at] @ cells[p[at]]

    def batches(self, view_type: pa.DataType, mean: bool) -> Iterator[pa.RecordBatch]:
        rows = np.flatnonzero(self.met)
        step = max(1, (4 << 20) // (8 * self.width))
        for i in range(0, len(rows), step):
            at = rows[i : i + step]
            cells, total, weighted = self.cells[at], self.total[at], self.weighted[at]
            if mean:
                if not total[weighted].all():
                    raise ZeroDivisionError("the weights of the edges into a node add up to zero")
                cells /= np.where(weighted, total, 1.0)[:, None]
            filled = self.filled[at].ravel() if self.filled.shape[1] else np.repeat(weighted, self.width)
            numbers = pa.array(cells.ravel(), mask=None if filled.all() else ~filled)
            offsets = pa.array(np.arange(len(at) + 1, dtype=np.int32) * self.width)
            columns = [pa.array([self.view] * len(at), view_type), pa.array(self.ids[at], mask=at == 0), pa.ListArray.from_arrays(offsets, numbers)]
            yield pa.RecordBatch.from_arrays(columns, ["view", "idx", "vec"])


def _gather(width: int, dtype: str, view_type: pa.DataType, mean: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, _Sums] = {}
        blocks: dict[bytes, tuple] = {}  # read, of one group
        group_of = -1
        for batch in batches:
            columns = {n: batch.column(n) for n in batch.schema.names}
            small = {n: columns[n].to_pylist() for n in ("part", "view", "group", "first", "n", "x_n", "src", "unweighted", "cuts")}
            for i in range(batch.num_rows):
                part, group, n, m = (small[k][i] for k in ("part", "group", "x_n", "n"))
                if part not in parts:
                    parts[part] = _Sums(small["view"][i], width)
                if group < 0:
                    parts[part].name(small["first"][i], _read(columns["ids"][i].as_py(), m, "i8"))
                    continue
                if group != group_of:
                    blocks, group_of = {}, group
                key = part, small["src"][i], small["cuts"][i]
                if key not in blocks:
                    held = small["unweighted"][i]
                    places = _read(columns["dst"][i].as_py(), m, "i4").astype(np.int64) + 1
                    parts[part].reserve(int(places.max()) + 1)
                    blocks[key] = (
                        np.cumsum(_read(small["src"][i], m, "i8")), places, _read(columns["w"][i].as_py(), m, "f8"),
                        None if held is None else _read(held, m, "?"), np.frombuffer(small["cuts"][i], "i8"),
                    )
                gaps = columns["gaps"][i]
                chunk = (
                    np.frombuffer(columns["x_ids"][i].as_buffer(), "i8"), np.frombuffer(columns["copies"][i].as_buffer(), "f8"),
                    np.frombuffer(columns["numbers"][i].as_buffer(), dtype).reshape(n, width),
                    np.frombuffer(gaps.as_buffer(), bool).reshape(n, width) if gaps.is_valid else None,
                )
                parts[part].add(chunk, blocks[key])
        while parts:
            yield from parts.pop(next(iter(parts))).batches(view_type, mean)

    return run


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.StringType):
        return pa.string()
    return pa.int32() if isinstance(kind, T.IntegerType) else pa.int64()


@dataclass
class EdgeParts:
    """Packed edges ``(view, src, dst, w)``, each part with all edges into its nodes
    in one view. ``groups`` is by how many numbers the sources are told apart."""

    table: DataFrame
    parts: int
    groups: int

    @classmethod
    def of(cls, edges: DataFrame, width: int, counted: list | None = None) -> EdgeParts:
        """Pack ``edges`` for vectors of about ``width`` numbers; ``counted`` is
        their :func:`edge_counts`, if they were counted before."""
        spark = edges.sparkSession
        found = edge_counts(edges) if counted is None else counted
        cores = spark.sparkContext.defaultParallelism
        part, parts, sources = F.lit(0), 0, 1
        for row in found:
            wanted = max(-(-row["edges"] // PART_EDGES), -(-row["nodes"] * width * 8 // PART_BYTES))
            n = max(1, wanted, min(-(-cores // len(found)), row["edges"] // LEAST_EDGES))
            at = F.pmod(F.xxhash64("dst"), F.lit(n)).cast("int") + parts
            part = F.when(F.col("view").eqNullSafe(F.lit(row["view"])), at).otherwise(part)
            parts, sources = parts + n, max(sources, row["sources"])
        groups = -(-sources * width * 8 // GROUP_BYTES)
        kind = edges.schema["view"].dataType
        dealt = edges.where("src IS NOT NULL").select(
            part.alias("part"), "view", _group(F.col("src"), groups).alias("group"), F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("w").cast("double").alias("w")
        ).repartitionById(max(1, parts), "part")
        packed = dealt.mapInArrow(_pack(_arrow(kind)), _PACKED.format(view=f"view {kind.simpleString()}"))
        return cls(materialise(packed, "edge-parts"), max(1, parts), groups)

    def sums(self, vectors: DataFrame, width: int, mean: bool = False) -> DataFrame:
        """``(view, idx, vec)``: sum (or mean) of ``w * vec`` over the edges into a node
        whose sources have a vector. ``vectors`` is ``(idx, vec)``, for every view, or
        ``(view, idx, vec)``. A number is null where all that it adds up is null."""
        spark, by_view = vectors.sparkSession, "view" in vectors.columns
        kind = self.table.schema["view"].dataType
        arrow = _arrow(kind)
        dtype = "f4" if isinstance(vectors.schema["vec"].dataType.elementType, T.FloatType) else "f8"
        idx = F.col("idx").cast("long")
        rows = vectors.where("idx IS NOT NULL").select(*["view"] * by_view, _group(idx, self.groups).alias("group"), idx.alias("idx"), "vec")
        passes = max(1, min(self.groups, -(-self.groups * GROUP_BYTES // PASS_BYTES)))
        schema = f"x_view {kind.simpleString()}, x_group int, x_n int, x_ids binary, copies binary, numbers binary, gaps binary"
        path = new_path(spark, "vector-chunks")
        for k in range(passes):
            dealt = rows.where(F.col("group") % passes == k).repartitionById(self.groups, "group")
            with swept(spark):
                dealt.mapInArrow(_chunks(width, dtype, by_view, arrow), schema).write.mode("append").parquet(path)
        chunks = spark.read.schema(schema).parquet(path)
        # one row more, and first, for the rows of a part that name its nodes
        names = spark.range(1, numPartitions=1).select(
            *[F.lit({"x_group": -1, "x_n": 0}.get(f.name)).cast(f.dataType).alias(f.name) for f in chunks.schema]
        )
        meets = F.col("group") == F.col("x_group")
        if by_view:
            meets &= (F.col("group") < 0) | (F.col("view") == F.col("x_view"))
        # the task of a part reads the table of vectors from end to end
        met = names.unionByName(chunks).coalesce(1).join(self.table.repartitionById(self.parts, "part").hint("shuffle_replicate_nl"), meets)
        return met.mapInArrow(_gather(width, dtype, arrow, mean), f"view {kind.simpleString()}, idx bigint, vec array<double>")


def _group(idx: Column, groups: int) -> Column:
    return F.pmod(F.xxhash64(idx.cast("long")), F.lit(groups)).cast("int")


def edge_counts(edges: DataFrame) -> list:
    """``(view, edges, nodes, sources)``: a row per view, the last two about."""
    return edges.groupBy("view").agg(
        F.count(F.lit(1)).alias("edges"), F.approx_count_distinct("dst").alias("nodes"), F.approx_count_distinct("src").alias("sources")
    ).collect()
