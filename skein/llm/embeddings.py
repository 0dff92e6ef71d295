"""Near copies among embeddings: a subspace pigeonhole join of rotated unit vectors, verified by their cosines."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.codes import clean
from skein.llm.common import by_ids, written
from skein.llm.components import components

#: Components of a subspace block.
WIDTH = 8
#: Vectors of one task; cells of more are cut into parts, and every two parts meet in a task of their own.
CELL = 2048
#: Leading components of a block that cut a large label into cells.
DEPTH = 3
#: Rotated components are rounded to this fraction of one.
GRAIN = 1 << 14
TILE = 256
_GROUP = ["_label", "_dim", "_block", "_cell", "_low", "_high"]


def rotation(dim: int, seed: int = 17) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def edges_of(dim: int) -> np.ndarray:
    return np.linspace(0, dim, max(1, -(-dim // WIDTH)) + 1).astype(int)


def budget(width: int, dim: int, cosine: float) -> int:
    """Of a block of ``width`` rounded components: unit vectors of that cosine are at a squared distance of 2 - 2 cosine, so in some
    block within its share of that. The square of the least radius that no rounding can push such a pair out of."""
    share = np.sqrt((2 - 2 * cosine + 1e-9) * width / dim)
    return int(np.ceil((GRAIN * share * (1 + 1e-9) + np.sqrt(width)) ** 2))


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _numbers(column: pa.Array, kind: type, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), dim)


def _digests(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, whole: bool) -> DataFrame:
    """(_id, _label, _digest[, _vec]) of the rows that can link: SHA-256 of the components' doubles, negative zeros made positive."""
    held = vectors.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), F.col(vec_col).cast("array<double>").alias("_vec")).where(
        F.col("_label").isNotNull() & clean(vectors, vec_col) & F.exists("_vec", lambda x: x != 0)
    )
    kinds = held.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            ends = np.cumsum([0, *column.value_lengths().to_pylist()])
            flat = column.flatten().to_numpy(zero_copy_only=False) + 0.0
            rows = [flat[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]
            digest = pa.array([hashlib.sha256(r).digest() for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), digest, *[pa.array(rows, pa.binary())] * whole], ["_id", "_label", "_digest", "_vec"][: 3 + whole])

    names = f"_id {kinds['_id'].dataType.simpleString()}, _label {kinds['_label'].dataType.simpleString()}, _digest binary"
    return held.mapInArrow(run, names + ", _vec binary" * whole)


def _classes(rows: DataFrame) -> DataFrame:
    """Distinct vectors of each label, written once: _key, _label, _digest, _dim, _n (rows), _least (id), _vec (doubles), _code (rounded rotated unit vector)."""
    kind = rows.schema["_label"].dataType.simpleString()
    least = rows.schema["_id"].dataType.simpleString()
    held = rows.groupBy("_label", "_digest").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_least"), F.first("_vec").alias("_vec"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch.column(4).to_pylist()
            dims = np.array([len(v) // 8 for v in vec], np.int64)
            code: list[bytes] = [b""] * len(vec)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                own = np.rint(GRAIN * (units(np.frombuffer(b"".join(vec[i] for i in at), np.float64).reshape(-1, dim)) @ rotation(dim))).astype(np.int16)
                for i, row in zip(at.tolist(), own, strict=True):
                    code[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(4)], pa.array(dims), batch.column(4), pa.array(code, pa.binary())], ["_label", "_digest", "_n", "_least", "_dim", "_vec", "_code"])

    coded = held.mapInArrow(run, f"_label {kind}, _digest binary, _n long, _least {least}, _dim long, _vec binary, _code binary")
    return written(coded.withColumn("_key", F.monotonically_increasing_id()), "vector-classes")


def _cells(classes: DataFrame, cosine: float, cell: int) -> DataFrame:
    """A row for each class, block and cell of a grid over the block's leading components that its ball reaches: _GROUP, _key, _part, _home, _at (the block's components).

    Labels of up to ``cell`` vectors are one cell. Cells that hold more are cut into parts by a hash of the key, and a row goes to
    every pair of parts that has its own: nobody's partner is missed, and no task grows with the cell.
    """
    kind = classes.schema["_label"].dataType.simpleString()
    many = classes.groupBy("_label", "_dim").agg(F.count(F.lit(1)).alias("_many")).where(F.col("_many") > cell)
    rows = classes.select("_label", "_dim", "_key", "_code").join(many, ["_label", "_dim"], "left").select("_label", "_dim", "_key", "_code", F.coalesce("_many", F.lit(0)).cast("long").alias("_many"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, many_ = batch.column(1).to_numpy(), batch.column(4).to_numpy()
            depth = np.minimum(DEPTH, np.ceil(np.log(np.maximum(1, many_ / cell)) / np.log(3))).astype(int)
            out: list[tuple[np.ndarray, int, np.ndarray, np.ndarray, list[bytes]]] = []
            for dim, deep in sorted(set(zip(dims.tolist(), depth.tolist(), strict=True))):
                at = np.flatnonzero((dims == dim) & (depth == deep))
                code = _numbers(batch.column(3).take(pa.array(at)), np.int16, dim).astype(np.int64)
                edges = edges_of(dim)
                for b, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
                    own = code[:, lo:hi]
                    radius = int(np.ceil(np.sqrt(budget(hi - lo, dim, cosine))))
                    rows, cells, home = np.arange(len(at)), np.zeros(len(at), np.int64), np.ones(len(at), bool)
                    for c in range(min(deep, hi - lo)):
                        first, mine, last = (np.floor_divide(own[rows, c] + d, 2 * radius) for d in (-radius, 0, radius))
                        times = last - first + 1
                        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                        now = np.repeat(first, times) + step
                        rows, cells, home = np.repeat(rows, times), (np.repeat(cells, times) << 16) + now + (1 << 15), np.repeat(home, times) & (now == np.repeat(mine, times))
                    packed = [x.tobytes() for x in own.astype(np.int16)]
                    out.append((at[rows], b, cells, home, [packed[r] for r in rows]))
            if out:
                take = pa.array(np.concatenate([o[0] for o in out]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take),
                        pa.array(np.concatenate([np.full(len(o[0]), o[1]) for o in out]), pa.int32()), pa.array(np.concatenate([o[2] for o in out])),
                        pa.array(np.concatenate([o[3] for o in out])), pa.array([x for o in out for x in o[4]], pa.binary()),
                    ],
                    ["_label", "_dim", "_key", "_block", "_cell", "_home", "_at"],
                )

    found = rows.mapInArrow(run, f"_label {kind}, _dim long, _key long, _block int, _cell long, _home boolean, _at binary")
    large = found.groupBy("_label", "_dim", "_block", "_cell").agg(F.count(F.lit(1)).alias("_in")).where(F.col("_in") > cell)
    cut = found.join(large, ["_label", "_dim", "_block", "_cell"], "left").withColumn("_parts", F.ceil(F.coalesce("_in", F.lit(1)) / cell).cast("int"))
    part = F.pmod(F.xxhash64("_key"), F.col("_parts")).cast("int")
    met = cut.withColumn("_part", part).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return met.select("_label", "_dim", "_block", "_cell", F.least("_part", "_other").alias("_low"), F.greatest("_part", "_other").alias("_high"), "_key", "_part", "_home", "_at")


def _near(at: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Tiles (rows, columns, within): a range join of ``at`` with itself, sorted by its first component. Whole numbers below 2**53, so doubles are exact."""
    order = np.argsort(at[:, 0], kind="stable")
    x = at[order].astype(np.float64)
    norms, radius = (x * x).sum(1), np.ceil(np.sqrt(most))
    for a in range(0, len(x), TILE):
        b = min(a + TILE, len(x))
        lo, hi = np.searchsorted(x[:, 0], x[a, 0] - radius), np.searchsorted(x[:, 0], x[b - 1, 0] + radius, "right")
        yield order[a:b], order[lo:hi], norms[a:b, None] + norms[None, lo:hi] - 2 * x[a:b] @ x[lo:hi].T <= most


def _asked(rows: np.ndarray, columns: np.ndarray, key: np.ndarray, home: np.ndarray, part: np.ndarray, low: int, high: int) -> np.ndarray:
    """Pairs that this task judges: the smaller key's home cell has them, and of two parts they are of one each."""
    held = (key[rows][:, None] < key[columns][None]) & home[rows][:, None]
    return held if low == high else held & (part[rows][:, None] != part[columns][None])


def _one(table: pa.Table, name: str):
    return table.column(name)[0].as_py()


def _arrays(table: pa.Table) -> tuple[int, int, int, int, np.ndarray, np.ndarray, np.ndarray]:
    get = lambda n: table.column(n).combine_chunks().to_numpy(zero_copy_only=False)
    return _one(table, "_dim"), _one(table, "_block"), _one(table, "_low"), _one(table, "_high"), get("_key"), get("_home").astype(bool), get("_part")


def _candidates(cells: DataFrame, cosine: float) -> DataFrame:
    """The rows of ``cells`` that have a partner within the block's budget, without their components."""
    kind = cells.schema["_label"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        dim, block, low, high, key, home, part = _arrays(table)
        edges = edges_of(dim)
        width = int(edges[block + 1] - edges[block])
        at = _numbers(table.column("_at").combine_chunks(), np.int16, width)
        found = np.zeros(len(key), bool)
        for rows, columns, within in _near(at, budget(width, dim, cosine)):
            within &= _asked(rows, columns, key, home, part, low, high)
            found[rows] |= within.any(1)
            found[columns] |= within.any(0)
        return table.filter(pa.array(found)).drop_columns(["_at"])

    return cells.groupBy(*_GROUP).applyInArrow(run, f"_label {kind}, _dim long, _block int, _cell long, _low int, _high int, _key long, _part int, _home boolean")


def _rooted(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least member of each node's component, by repeated minima over links and roots."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[u], root[v])
        after = root.copy()
        np.minimum.at(after, root[u], least)
        np.minimum.at(after, root[v], least)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def _links(marked: DataFrame, cosine: float) -> DataFrame:
    """(_key, _root, _linked): of each candidate in a task a member of its component there, and the rows it is linked with by pairs judged there.

    A pair is judged in the first block that has it within budget, so only once over all blocks.
    """

    def run(table: pa.Table) -> pa.Table:
        dim, block, low, high, key, home, part = _arrays(table)
        edges = edges_of(dim)
        order = np.argsort(key, kind="stable")
        key, home, part = key[order], home[order], part[order]
        n = table.column("_n").combine_chunks().to_numpy()[order].astype(np.float64)
        vec = _numbers(table.column("_vec").combine_chunks(), np.float64, dim)[order]
        code = _numbers(table.column("_code").combine_chunks(), np.int16, dim)[order].astype(np.float64)
        unit = units(vec)
        norms = [(code[:, a:b] ** 2).sum(1) for a, b in zip(edges, edges[1:], strict=False)]
        most = [budget(int(b - a), dim, cosine) for a, b in zip(edges, edges[1:], strict=False)]
        linked = np.zeros(len(key))
        root = np.arange(len(key))
        a, b = edges[block], edges[block + 1]
        for rows, columns, within in _near(code[:, a:b], most[block]):
            within &= _asked(rows, columns, key, home, part, low, high)
            within &= unit[rows] @ unit[columns].T >= cosine - 1e-9
            for k in range(block):
                own = slice(edges[k], edges[k + 1])
                if within.any():
                    within &= norms[k][rows][:, None] + norms[k][columns][None] - 2 * code[rows, own] @ code[columns, own].T > most[k]
            i, j = np.nonzero(within)
            i, j = rows[i], columns[j]
            close = np.concatenate([_cosines(vec, i[s : s + 8192], j[s : s + 8192]) >= cosine for s in range(0, len(i), 8192)] or [np.zeros(0, bool)])
            i, j = i[close], j[close]
            np.add.at(linked, i, n[j])
            np.add.at(linked, j, n[i])
            if len(i):
                root = _rooted(len(key), np.concatenate([np.arange(len(key)), i]), np.concatenate([root, j]))
        held = linked > 0
        return pa.table({"_key": key[held], "_root": key[root[held]], "_linked": linked[held].astype(np.int64)})

    return marked.groupBy(*_GROUP).applyInArrow(run, "_key long, _root long, _linked long")


def _cosines(vec: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    x, y = vec[i], vec[j]
    x, y = x / np.abs(x).max(1, keepdims=True), y / np.abs(y).max(1, keepdims=True)
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))


def near_groups(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = 0.98, cell: int = CELL) -> DataFrame:
    """One row per row of ``vectors``: id, n_links (other rows of the same label at ``cosine`` or more), component_id (smallest id reachable), kept (its own id).

    Vectors that are null, empty or zero, or hold null or non-finite components, and those of null labels link with nothing; vectors
    of different lengths neither. Equal vectors of a label are one node that counts its rows, so copies are never paired. A null id is
    never a component's name unless all its ids are null. Rows that repeat an id are rows of their own, and are kept together.
    Other columns are ignored; an empty table gives an empty result.

    Unit vectors are rotated and cut into blocks of eight components. A pair that near is within its share of the squared distance in
    some block: a range join of each block finds all that have such a partner, from the block's rounded components only. These alone
    bring their vectors, and each task compares them, adds up links by vector and gives one row for each: pairs are never rows.
    """
    rows = _digests(vectors, id_col, vec_col, label_col, True)
    classes = _classes(rows)
    marks = written(_candidates(_cells(classes, cosine, cell), cosine), "vector-candidates")
    found = written(_links(marks.join(classes.select("_key", "_n", "_vec", "_code"), "_key"), cosine), "vector-links")
    roots = components(found.select(F.col("_key").alias("u"), F.col("_root").alias("v")))
    linked = found.groupBy("_key").agg(F.sum("_linked").alias("_linked"))
    named = classes.select("_key", "_label", "_digest", "_n", "_least").join(roots, F.col("_key") == F.col("node"), "left").withColumn("_name", F.coalesce("root", "_key"))
    least = named.groupBy("_name").agg(F.min("_least").alias("component_id"))
    known = (
        named.join(least, "_name")
        .join(linked, "_key", "left")
        .select("_label", "_digest", "component_id", (F.col("_n") - 1 + F.coalesce("_linked", F.lit(0))).alias("n_links"))
    )
    own = F.col(id_col).eqNullSafe(F.col("component_id")).alias("kept")
    inside = _digests(vectors, id_col, vec_col, label_col, False).join(known, ["_label", "_digest"]).select(F.col("_id").alias(id_col), "n_links", "component_id")
    can = F.col(label_col).isNotNull() & clean(vectors, vec_col) & F.coalesce(F.exists(vec_col, lambda x: x != 0), F.lit(False))
    alone = vectors.where(~can).select(F.col(id_col), F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component_id"))
    return inside.unionByName(alone).select(id_col, "n_links", "component_id", own)


def near_dedup(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = 0.98) -> DataFrame:
    """The rows of ``vectors`` whose id names their component, with all their columns."""
    return by_ids(vectors, near_groups(vectors, id_col, vec_col, label_col, cosine).where("kept").select(id_col), id_col)
