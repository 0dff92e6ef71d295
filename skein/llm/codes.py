"""Product codes of vectors: integer Lloyd rounds that filter codebook entries through kd-trees kept by block."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import written

#: Rows of one block, whose parts have a tree each.
BLOCK = 4096
LEAF = 16
#: Components of larger size could overflow 64-bit distances.
LARGEST = 1 << 24


def clean(vectors: DataFrame, vec_col: str = "embedding") -> Column:
    """True where ``vec_col`` is a vector without null or non-finite components."""
    v = F.col(vec_col)
    return F.coalesce(v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def bounds(dim: int, parts: int) -> list[int]:
    return [k * dim // parts for k in range(parts + 1)]


@dataclass
class Tree:
    """A balanced kd-tree over 2**depth equal leaves: level ``k`` has 2**k nodes, with box, sum and count of each.

    ``points`` stand in leaf order, ``rows`` are their places in the block, -1 for the copies that fill the last leaves up; these
    weigh nothing.
    """

    points: np.ndarray
    rows: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def grow(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """Level by level: every node is halved at the median of the component in which its box is widest."""
    n, dim = points.shape
    depth = max(0, int(np.ceil(np.log2(max(1, n) / leaf))))
    size = -(-n // (1 << depth))
    rows = np.full(size << depth, -1)
    rows[:n] = np.arange(n)
    at = points[np.where(rows < 0, 0, rows)]
    if dim:
        for k in range(depth):
            held, own = at.reshape(1 << k, -1, dim), rows.reshape(1 << k, -1)
            widest = (held.max(1) - held.min(1)).argmax(1)
            half = held.shape[1] // 2
            order = np.argpartition(np.take_along_axis(held, widest[:, None, None], 2)[:, :, 0], half, axis=1)
            at = np.take_along_axis(held, order[:, :, None], 1)
            rows = np.take_along_axis(own, order, 1)
    at, rows = at.reshape(rows.size, dim), rows.reshape(-1)
    real = rows >= 0
    held = at.reshape(1 << depth, size, dim)
    level = (held.min(1), held.max(1), np.where(real[:, None], at, 0).reshape(held.shape).sum(1), real.reshape(1 << depth, size).sum(1))
    levels = [level]
    for _ in range(depth):
        low, high, total, count = level
        level = (np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2]), total[::2] + total[1::2], count[::2] + count[1::2])
        levels.append(level)
    return Tree(at, rows, levels[::-1])


def _gain(entries: np.ndarray, best: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """By node and entry: how much farther than the node's ``best`` the entry is from the box's corner that favours it most (squared)."""
    away = entries[None] - entries[best][:, None]
    norms = (entries * entries).sum(1)
    return norms[None] - norms[best][:, None] - 2 * np.maximum(away * low[:, None], away * high[:, None]).sum(2)


def assign(tree: Tree, entries: np.ndarray) -> Iterator[tuple[slice | np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]]:
    """Nearest entries (ties to the lower index), as (leaf positions of points, entries, sums, counts).

    An entry leaves a node if all of its box is nearer to the one nearest the box's middle, or as near and the index lower. A
    node that has one entry left is assigned whole, by its cached sum and count. What reaches the leaves is compared point by point.
    """
    k = len(entries)
    nodes, may = np.zeros(1, np.int64), np.ones((1, k), bool)
    far = np.iinfo(np.int64).max
    for depth, (low, high, total, count) in enumerate(tree.levels):
        lo, hi = low[nodes], high[nodes]
        middle = lo + hi
        apart = np.where(may, ((2 * entries[None] - middle[:, None]) ** 2).sum(2), far)
        best = apart.argmin(1)
        gain = _gain(entries, best, lo, hi)
        may = may & ~((gain > 0) | ((gain == 0) & (np.arange(k)[None] > best[:, None])))
        one = may.sum(1) == 1
        if one.any():
            done, size = nodes[one], len(tree.points) >> depth
            yield (done[:, None] * size + np.arange(size)).reshape(-1), np.repeat(may[one].argmax(1), size), total[done], count[done]
        nodes, may = nodes[~one], may[~one]
        if not len(nodes):
            return
        if depth + 1 < len(tree.levels):
            nodes, may = np.repeat(2 * nodes, 2), np.repeat(may, 2, axis=0)
            nodes[1::2] += 1
    size = len(tree.points) >> (len(tree.levels) - 1)
    at = (nodes[:, None] * size + np.arange(size)).reshape(-1)
    x, open_ = tree.points[at], np.repeat(may, size, axis=0)
    apart = np.where(open_, ((x[:, None] - entries[None]) ** 2).sum(2), far)
    yield at, apart.argmin(1), None, None


def sums(tree: Tree, entries: np.ndarray) -> np.ndarray:
    """By entry: the components' sums, then the count, of the points assigned to it."""
    out = np.zeros((len(entries), entries.shape[1] + 1), np.int64)
    for at, best, total, count in assign(tree, entries):
        if total is None:
            real = tree.rows[at] >= 0
            np.add.at(out, best[real], np.column_stack([tree.points[at][real], np.ones(int(real.sum()), np.int64)]))
        else:
            np.add.at(out, best[:: len(at) // len(total)], np.column_stack([total, count]))
    return out


def nearest(tree: Tree, entries: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """By row of the block: entry and squared distance."""
    code, error = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for at, best, _, _ in assign(tree, entries):
        rows = tree.rows[at]
        real = rows >= 0
        code[rows[real]] = best[real]
        error[rows[real]] = ((tree.points[at][real] - entries[best[real]]) ** 2).sum(1)
    return code, error


def _packed(tree: Tree) -> bytes:
    head = np.array([len(tree.points), tree.points.shape[1], len(tree.levels)], np.int64)
    body = [tree.points.astype(np.int32).tobytes(), tree.rows.astype(np.int32).tobytes()]
    for low, high, total, count in tree.levels:
        body += [low.astype(np.int32).tobytes(), high.astype(np.int32).tobytes(), total.tobytes(), count.astype(np.int32).tobytes()]
    return head.tobytes() + b"".join(body)


def _unpacked(data: bytes) -> Tree:
    n, dim, depth = np.frombuffer(data, np.int64, 3)
    place = 24

    def take(kind: type, rows: int, columns: int) -> np.ndarray:
        nonlocal place
        out = np.frombuffer(data, kind, rows * columns, place).astype(np.int64).reshape(rows, columns)
        place += out.size * np.dtype(kind).itemsize
        return out

    points, rows = take(np.int32, n, dim), take(np.int32, n, 1)[:, 0]
    levels = []
    for k in range(depth):
        levels.append((take(np.int32, 1 << k, dim), take(np.int32, 1 << k, dim), take(np.int64, 1 << k, dim), take(np.int32, 1 << k, 1)[:, 0]))
    return Tree(points, rows, levels)


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as integers."""
    out = np.floor(scale * x.astype(np.float64))
    if out.size and np.abs(out).max() > LARGEST:
        raise ValueError(f"components beyond {LARGEST / scale:g} have no exact 64-bit distances")
    return out.astype(np.int64)


@dataclass
class Codebooks:
    """One array (entries, components) of integers for each part."""

    entries: list[np.ndarray]
    scale: int

    def sha256(self) -> str:
        """Of all components' decimals by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(str(x) for part in self.entries for x in part.reshape(-1).tolist()).encode()).hexdigest()

    def decoded(self, code: Column) -> Column:
        """The vector that an array of indexes stands for."""
        books = F.array(*[F.array(*[F.array(*[F.lit(x / self.scale) for x in entry.tolist()]).cast("array<double>") for entry in part]) for part in self.entries])
        return F.flatten(F.zip_with(books, code, lambda part, k: F.get(part, k)))


def forest(vectors: DataFrame, dim: int, parts: int, scale: int, id_col: str, vec_col: str, label_col: str | None, block: int = BLOCK) -> DataFrame:
    """(ids, labels, trees): a block of rows with a packed tree for each part, written to the shared folder. A map without any shuffle."""
    edges = bounds(dim, parts)
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    rows = vectors.select(F.col(id_col).alias("_id"), label.alias("_label"), F.col(vec_col).alias("_vec"))
    kinds = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(table: pa.Table) -> pa.RecordBatch:
            column = table.column("_vec").combine_chunks()
            x = whole(column.flatten().to_numpy(zero_copy_only=False).reshape(len(table), dim), scale)
            trees = [_packed(grow(np.ascontiguousarray(x[:, a:b]))) for a, b in zip(edges, edges[1:], strict=False)]
            lists = [pa.array([table.column(c).to_pylist()], pa.list_(table.schema.field(c).type)) for c in ("_id", "_label")]
            return pa.RecordBatch.from_arrays([*lists, pa.array([trees], pa.list_(pa.binary()))], ["ids", "labels", "trees"])

        held, n = [], 0
        for batch in batches:
            place = 0
            while place < len(batch):
                piece = batch.slice(place, block - n)
                place += len(piece)
                n += len(piece)
                held.append(piece)
                if n == block:
                    yield made(pa.Table.from_batches(held))
                    held, n = [], 0
        if held:
            yield made(pa.Table.from_batches(held))

    out = T.StructType([T.StructField("ids", T.ArrayType(kinds["_id"].dataType)), T.StructField("labels", T.ArrayType(kinds["_label"].dataType)), T.StructField("trees", T.ArrayType(T.BinaryType()))])
    return written(rows.mapInArrow(run, out), "code-trees")


def lloyd(trees: DataFrame, start: Codebooks, rounds: int) -> Codebooks:
    """``rounds`` of assigning every part and replacing each used entry by its parts' floored mean. A round is one pass over the trees, and brings entries times components numbers to the driver."""
    books = [x.copy() for x in start.entries]
    for _ in range(rounds):
        now = [x.copy() for x in books]

        def run(batches: Iterator[pa.RecordBatch], now: list[np.ndarray] = now) -> Iterator[pa.RecordBatch]:
            total = [np.zeros((len(x), x.shape[1] + 1), np.int64) for x in now]
            for batch in batches:
                for packed in batch.column(0).to_pylist():
                    for k, data in enumerate(packed):
                        total[k] += sums(_unpacked(data), now[k])
            rows = [(k, e, c, int(v)) for k, part in enumerate(total) for e, entry in enumerate(part) for c, v in enumerate(entry) if entry[-1]]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["part", "entry", "place", "v"])

        found = trees.select("trees").mapInArrow(run, "part int, entry int, place int, v long").groupBy("part", "entry", "place").agg(F.sum("v").alias("v")).collect()
        totals = [np.zeros((len(x), x.shape[1] + 1), np.int64) for x in now]
        for part, entry, place, v in found:
            totals[part][entry, place] = v
        for x, total in zip(books, totals, strict=True):
            used = total[:, -1] > 0
            x[used] = total[used, :-1] // total[used, -1:]
    return Codebooks(books, start.scale)


def coded(trees: DataFrame, books: Codebooks, id_col: str = "vec_id", label_col: str = "label") -> DataFrame:
    """id, label, code (array of indexes in part order) and error (squared distances summed over parts) of every row of ``trees``."""
    entries = books.entries
    kinds = {f.name: f.dataType.elementType for f in trees.schema if f.name != "trees"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                ids, labels = batch.column(0)[i].values, batch.column(1)[i].values
                n = len(ids)
                codes, errors = zip(*[nearest(_unpacked(data), entries[k], n) for k, data in enumerate(batch.column(2)[i].as_py())], strict=True)
                flat = np.stack(codes, 1).astype(np.int32).reshape(-1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(entries)), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([ids, labels, lists, pa.array(sum(errors))], ["_id", "_label", "code", "error"])

    out = T.StructType([T.StructField("_id", kinds["ids"]), T.StructField("_label", kinds["labels"]), T.StructField("code", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())])
    return trees.mapInArrow(run, out).toDF(id_col, label_col, "code", "error")


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, Codebooks]:
    """(id, label, code, error) of every vector, and the codebooks.

    Components are floor(``scale`` x), all arithmetic is in integers. Vectors that are null or hold null or non-finite components
    have no row, nor have those of another length than the vector of the smallest id. The codebooks start as the parts of the
    ``entries`` smallest ids (null ids last, equal ids by their vectors; all there are, if fewer). Rows that repeat are coded each;
    a null label stays null; other columns are ignored; lengths that ``parts`` doesn't divide have parts that differ by one. An empty
    table gives an empty result and empty codebooks.
    """
    held = vectors.where(clean(vectors, vec_col)).select(F.col(id_col).alias("_i"), F.col(label_col).alias("_l"), F.col(vec_col).alias("_v"))
    first = held.orderBy(F.col("_i").asc_nulls_last(), "_v").limit(1).collect()
    dim = len(first[0]["_v"]) if first else 0
    same = held.where(F.size("_v") == dim)
    seeds = [r["_v"] for r in same.orderBy(F.col("_i").asc_nulls_last(), "_v").limit(entries).collect()]
    edges = bounds(dim, parts)
    start = whole(np.array(seeds, float).reshape(len(seeds), dim), scale)
    books = Codebooks([start[:, a:b].copy() for a, b in zip(edges, edges[1:], strict=False)], scale)
    trees = forest(same, dim, parts, scale, "_i", "_v", "_l")
    books = lloyd(trees, books, rounds)
    return coded(trees, books, id_col, label_col), books


def with_label_error(codes: DataFrame, label_col: str = "label") -> DataFrame:
    """``codes`` with label_error, the errors of equal labels (nulls together) added up: combined in each map task, then joined back."""
    total = codes.groupBy(F.col(label_col).alias("_of")).agg(F.sum("error").alias("label_error"))
    return codes.join(total, F.col(label_col).eqNullSafe(F.col("_of"))).drop("_of")
