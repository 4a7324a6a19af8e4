"""Approximate nearest neighbours by cosine: stable projections, kd-trees and a chi-square stopping test.

Unit vectors are projected on a few Gaussian directions.  A squared projected
distance is the squared distance times a chi-square variable with as many degrees
of freedom, so a neighbour nearer than the k-th best so far lies, with
probability `sure`, within that distance times the chi-square quantile.  Vectors
are taken in order of projected distance, by leaves of a kd-tree, and verified in
full until the nearest one left is farther than that.

The upper levels of the kd-tree are fitted on a bounded sample of SAMPLE rows (drawn
by hashes) and cut projected space into CELLS cells at most, of about SHARD
rows; a cell with more rows is dealt to several shards.  Every row goes to its
shard by one shuffle, and a shard builds the lower levels of the tree.  A query
first searches its own shard, then the NEAR nearest other cells, then all cells
that the test leaves open; each search ends by the test.  Shards are streamed: a
task holds one shard and a batch of queries.

Defined results: vectors that are null, empty or zero or hold null or non-finite
components take no part, neither do candidates of another length than the
query's; a row with a null id is a candidate like any other and never a query;
rows that repeat an id are separate candidates, and only the query's own row is
left out; ties go to the smaller id, null last; vectors of any finite size have
their exact cosine, since each is first divided by a power of two; a query without
candidates has no row; an empty table gives an empty result.  Other columns are
not looked at.  A very long vector is held a few times by a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoframe.llm._shared import checkpointed, packed, partitions, unpacked

SHARD, LEAF, SAMPLE, CELLS, NEAR = 2048, 32, 1 << 15, 1 << 11, 8
DIRECTIONS, SURE, SEED = 16, 0.95, 11
ROW_SCHEMA = "id long, dim int, cell int, turn long, vector binary, point binary"
INDEX_SCHEMA = "dim int, cell int, sub int, tree binary, low binary, high binary, size long"
FOUND_SCHEMA = "dim int, home int, home_sub int, place long, query_id long, vector binary, found array<struct<vec_id: long, score: double>>"
HIT_SCHEMA = "home int, home_sub int, dim int, place long, query_id long, vec_id long, score double"
HITS = pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.float64())]))
Hit = tuple[float, bool, int]  # -score, whether the id is null, id: sorted, the best come first


def chi_square_quantile(p: float, degrees: int) -> float:
    """Quantile for an even number of degrees of freedom, by bisection of the closed form."""
    low, high = 0.0, 1000.0
    while high - low > 1e-9:
        x = (low + high) / 2
        tail = math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(degrees // 2))
        low, high = (x, high) if 1 - tail < p else (low, x)
    return high


def directions(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(dim, DIRECTIONS))


_directions: dict[int, np.ndarray] = {}


def directions_of(dim: int) -> np.ndarray:
    if dim not in _directions:
        _directions[dim] = directions(dim)
    return _directions[dim]


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector divided by a power of two, so that its largest component is between 1/2 and 1: no square overflows or vanishes."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])


def norms(vectors: np.ndarray) -> np.ndarray:
    """By sums along each row, which do not depend on where the row stands."""
    return np.sqrt((vectors * vectors).sum(axis=1))


def kd_leaves(points: np.ndarray) -> list[np.ndarray]:
    """Median splits along the widest side until a leaf holds LEAF points at most."""
    open_, leaves = [np.arange(len(points))], []
    while open_:
        rows = open_.pop()
        if len(rows) <= LEAF:
            leaves.append(rows)
            continue
        own = points[rows]
        axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
        half = len(rows) // 2
        order = np.argpartition(own[:, axis], half)
        open_ += [rows[order[:half]], rows[order[half:]]]
    return leaves


class Upper:
    """The upper levels of a kd-tree: nested (axis, value, left, right), with numbers of cells for leaves."""

    def __init__(self, points: np.ndarray, cells: int):
        self.cells = 0
        self.root = self._split(points, cells)

    def _split(self, points: np.ndarray, cells: int) -> tuple | int:
        if cells >= 2 and len(points) >= 2:
            axis = int(np.argmax(points.max(axis=0) - points.min(axis=0)))
            value = float(np.median(points[:, axis]))
            left = points[:, axis] < value
            if left.any() and not left.all():
                return axis, value, self._split(points[left], cells // 2), self._split(points[~left], cells - cells // 2)
        self.cells += 1
        return self.cells - 1

    def cell(self, points: np.ndarray) -> np.ndarray:
        out, open_ = np.zeros(len(points), np.int32), [(self.root, np.arange(len(points)))]
        while open_:
            node, rows = open_.pop()
            if isinstance(node, int):
                out[rows] = node
            elif len(rows):
                axis, value, left, right = node
                low = points[rows, axis] < value
                open_ += [(left, rows[low]), (right, rows[~low])]
        return out


class Tree:
    """A shard: vectors in leaf order, their points, ids, norms and the leaves' boxes in projected space."""

    def __init__(self, ids: np.ndarray, nulls: np.ndarray, vectors: np.ndarray, points: np.ndarray, starts: np.ndarray):
        self.ids, self.nulls, self.vectors, self.points, self.starts = ids, nulls, vectors, points, starts
        self.norms = norms(vectors)
        self.low, self.high = np.minimum.reduceat(points, starts[:-1], axis=0), np.maximum.reduceat(points, starts[:-1], axis=0)

    @classmethod
    def build(cls, ids: np.ndarray, nulls: np.ndarray, vectors: np.ndarray, points: np.ndarray) -> Tree:
        leaves = kd_leaves(points)
        order = np.concatenate(leaves)
        return cls(ids[order], nulls[order], vectors[order], points[order], np.concatenate([[0], np.cumsum([len(x) for x in leaves])]))

    def pack(self) -> bytes:
        return packed(self.ids, self.nulls, self.vectors.ravel(), self.points.ravel(), self.starts)

    @classmethod
    def unpack(cls, data: bytes, dim: int) -> Tree:
        ids, nulls, vectors, points, starts = unpacked(data, np.int64, np.bool_, np.float64, np.float64, np.int64)
        return cls(ids, nulls, vectors.reshape(-1, dim), points.reshape(-1, DIRECTIONS), starts)

    def search(self, query: np.ndarray, k: int, own: int, found: list[Hit], quantile: float) -> tuple[list[Hit], list[Hit], int]:
        """The k best of found and this shard's rows, those of them that are from this shard, and how many rows were verified."""
        norm = float(norms(query[None])[0])
        point = (query / norm) @ directions_of(len(query))
        gap = np.maximum(self.low - point, 0) + np.maximum(point - self.high, 0)
        lower = (gap * gap).sum(axis=1)
        order = np.argsort(lower, kind="stable")
        at, step, verified, mine = 0, 4, 0, []
        while at < len(order):
            limit = 2 * (1 + found[k - 1][0]) * quantile + 1e-12 if len(found) >= k else np.inf
            chosen = order[at : at + step]
            chosen = chosen[lower[chosen] <= limit]
            if not len(chosen):
                break
            rows = np.concatenate([np.arange(self.starts[x], self.starts[x + 1]) for x in chosen])
            away = self.points[rows] - point
            rows = rows[((away * away).sum(axis=1) <= limit) & (rows != own)]
            verified += len(rows)
            score = (self.vectors[rows] * query).sum(axis=1) / (self.norms[rows] * norm)
            if len(found) >= k:
                good = -score <= found[k - 1][0]
                rows, score = rows[good], score[good]
            fresh = list(zip((-score).tolist(), self.nulls[rows].tolist(), self.ids[rows].tolist(), strict=True))
            found, mine = sorted([*found, *fresh])[:k], sorted([*mine, *fresh])[:k]
            at, step = at + step, step * 2
        worst = found[k - 1] if len(found) >= k else (np.inf,)
        return found, [x for x in mine if x <= worst], verified


def _hits(found: list[Hit]) -> list[dict]:
    return [{"vec_id": None if null else i, "score": -s} for s, null, i in found]


def _found(hits: list[dict]) -> list[Hit]:
    return [(-x["score"], x["vec_id"] is None, x["vec_id"] or 0) for x in hits]


def projected(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Every vector that takes part, scaled, with its point; `turn` numbers a partition's rows."""
    value = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), value.alias("v")).filter("v IS NOT NULL")
    rows = rows.filter((F.size("v") > 0) & F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("v", lambda x: x != 0))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId()
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
            ends = np.cumsum(sizes)
            for dim in np.unique(sizes).tolist():
                of = np.flatnonzero(sizes == dim)
                own = scaled(flat[(ends[of] - dim)[:, None] + np.arange(dim)])
                points = (own / norms(own)[:, None]) @ directions_of(dim)
                columns = [ids.take(pa.array(of)), pa.array(np.full(len(of), dim, np.int32)), pa.array(np.arange(turn, turn + len(of))), *(pa.array([x.tobytes() for x in m], pa.binary()) for m in (own, points))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "dim", "turn", "vector", "point"])
                turn += len(of)

    return rows.mapInArrow(compute, "id long, dim int, turn long, vector binary, point binary")


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, width)


def build_index(rows: DataFrame) -> tuple[DataFrame, dict[tuple[int, int], tuple[int, np.ndarray, np.ndarray]]]:
    """projected() rows -> a row per shard, and for each (dim, cell) its number of shards and its box."""
    spark = rows.sparkSession
    total = {r["dim"]: r["count"] for r in rows.groupBy("dim").count().collect()}
    draw = F.xxhash64("id", "vector", "turn")
    drawn = rows.filter(F.pmod(draw, F.lit(max(sum(total.values()), 1))) < 2 * SAMPLE)  # about twice the sample, so that sorting sends no more than that to the driver
    sample = drawn.select("dim", "point", draw.alias("draw")).orderBy("draw", "point").limit(SAMPLE).collect()
    by_dim: dict[int, list[bytes]] = {}
    for r in sample:
        by_dim.setdefault(r["dim"], []).append(bytes(r["point"]))
    upper = {dim: Upper(np.frombuffer(b"".join(p), np.float64).reshape(-1, DIRECTIONS), min(CELLS, len(p) // 4, -(-total[dim] // SHARD))) for dim, p in by_dim.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, points = batch.column(1).to_numpy(), _matrix(batch.column(4), DIRECTIONS)
            cell = np.zeros(len(dims), np.int32)
            for dim in set(dims.tolist()) & set(upper):
                of = np.flatnonzero(dims == dim)
                cell[of] = upper[dim].cell(points[of])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell), *batch.columns[2:]], names=[x.split()[0] for x in ROW_SCHEMA.split(", ")])

    placed = rows.select("id", "dim", "turn", "vector", "point").mapInArrow(place, ROW_SCHEMA)
    counts = {(r["dim"], r["cell"]): r["count"] for r in placed.groupBy("dim", "cell").count().collect()}
    parts = spark.createDataFrame([(d, c, -(-n // SHARD)) for (d, c), n in counts.items()], "dim int, cell int, parts int")
    dealt = placed.join(F.broadcast(parts), ["dim", "cell"]).withColumn("sub", F.pmod("turn", "parts").cast("int"))

    def build(table: pa.Table) -> pa.Table:
        dim, cell, sub = (table.column(c)[0].as_py() for c in ("dim", "cell", "sub"))
        ids = table.column("id")
        tree = Tree.build(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(), _matrix(table.column("vector"), dim), _matrix(table.column("point"), DIRECTIONS))
        box = [tree.low.min(axis=0).tobytes(), tree.high.max(axis=0).tobytes()]
        return pa.table({"dim": pa.array([dim], pa.int32()), "cell": pa.array([cell], pa.int32()), "sub": pa.array([sub], pa.int32()), "tree": [tree.pack()], "low": [box[0]], "high": [box[1]], "size": [len(tree.ids)]})

    index = checkpointed(dealt.groupBy("dim", "cell", "sub").applyInArrow(build, INDEX_SCHEMA))

    def bounds(table: pa.Table) -> pa.Table:
        ends = [f(_matrix(table.column(c), DIRECTIONS), axis=0).tobytes() for c, f in (("low", np.min), ("high", np.max))]
        return pa.table({"dim": table.column("dim")[:1], "cell": table.column("cell")[:1], "low": [ends[0]], "high": [ends[1]]})

    boxes = index.select("dim", "cell", "low", "high").groupBy("dim", "cell").applyInArrow(bounds, "dim int, cell int, low binary, high binary").collect()
    at = lambda x: np.frombuffer(bytes(x), np.float64)
    return index, {(r["dim"], r["cell"]): (-(-counts[r["dim"], r["cell"]] // SHARD), at(r["low"]), at(r["high"])) for r in boxes}


def _at_home(index: DataFrame, every: int, k: int, quantile: float) -> DataFrame:
    """The queries among a shard's rows, with what their own shard has."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tree, out = Tree.unpack(row["tree"], row["dim"]), []
                for place in np.flatnonzero((tree.ids % every == 0) & ~tree.nulls).tolist():
                    got, _, _ = tree.search(tree.vectors[place], k, place, [], quantile)
                    out.append((row["dim"], row["cell"], row["sub"], place, int(tree.ids[place]), tree.vectors[place].tobytes(), _hits(got)))
                columns = list(zip(*out, strict=True)) if out else [[]] * 7
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), HITS)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in FOUND_SCHEMA.split(", ")[:6]] + ["found"])

    return index.select("dim", "cell", "sub", "tree").mapInArrow(search, FOUND_SCHEMA)


def _routed(queries: DataFrame, boxes: dict, k: int, quantile: float, near: bool) -> DataFrame:
    """A row per query and shard to search: the NEAR cells nearest to it and the rest of its own, or the others, so far as the test leaves them open."""
    dims: dict[int, tuple] = {}
    for dim in {d for d, _ in boxes}:
        cells = sorted(c for d, c in boxes if d == dim)
        dims[dim] = (np.array(cells), np.array([boxes[dim, c][0] for c in cells]), np.stack([boxes[dim, c][1] for c in cells]), np.stack([boxes[dim, c][2] for c in cells]))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, row in enumerate(batch.select(["dim", "home", "home_sub", "vector", "found"]).to_pylist()):
                cells, parts, low, high = dims[row["dim"]]
                query = np.frombuffer(row["vector"], np.float64)
                point = (query / float(norms(query[None])[0])) @ directions_of(row["dim"])
                gap = np.maximum(low - point, 0) + np.maximum(point - high, 0)
                lower = (gap * gap).sum(axis=1)
                found = _found(row["found"])
                limit = 2 * (1 + found[k - 1][0]) * quantile + 1e-12 if len(found) >= k else np.inf
                first = np.argsort(np.where(cells == row["home"], -1.0, lower), kind="stable")
                chosen = first[: NEAR + 1] if near else first[NEAR + 1 :]
                for x in chosen[lower[chosen] <= limit].tolist():
                    out += [(i, int(cells[x]), s) for s in range(int(parts[x])) if (int(cells[x]), s) != (row["home"], row["home_sub"])]
            of, cell, sub = (np.array(c, np.int32) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int32),) * 3
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(of)).columns, pa.array(cell), pa.array(sub)], names=[*batch.schema.names, "cell", "sub"])

    return queries.mapInArrow(route, f"{FOUND_SCHEMA}, cell int, sub int")


def _search(index: DataFrame, routed: DataFrame, k: int, quantile: float) -> DataFrame:
    """What the shards that queries were sent to improve. Shards and their queries are read in one order, so that a task holds one shard at a time and any number of queries pass."""
    empty = lambda kind: F.lit(None).cast(kind)
    shards = index.select("dim", "cell", "sub", F.lit(0).alias("kind"), empty("int").alias("home"), empty("int").alias("home_sub"), empty("long").alias("place"), empty("long").alias("query_id"), F.col("tree").alias("body"), empty("array<struct<vec_id: long, score: double>>").alias("found"))
    asked = routed.select("dim", "cell", "sub", F.lit(1).alias("kind"), "home", "home_sub", "place", "query_id", F.col("vector").alias("body"), "found")
    order = ["dim", "cell", "sub", "kind"]
    rows = shards.unionByName(asked).repartition(partitions(index.sparkSession), *order[:3]).sortWithinPartitions(*order)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in batches:
            out: list[tuple] = []
            for n in range(batch.num_rows):
                row = {c: batch.column(c)[n].as_py() for c in ("dim", "kind", "home", "home_sub", "place", "query_id", "body", "found")}
                if row["kind"] == 0:
                    tree = Tree.unpack(row["body"], row["dim"])
                    continue
                _, mine, _ = tree.search(np.frombuffer(row["body"], np.float64), k, -1, _found(row["found"]), quantile)
                out += [(row["home"], row["home_sub"], row["dim"], row["place"], row["query_id"], x["vec_id"], x["score"]) for x in _hits(mine)]
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = (pa.int32(), pa.int32(), pa.int32(), *[pa.int64()] * 3, pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in HIT_SCHEMA.split(", ")])

    return rows.mapInArrow(search, HIT_SCHEMA)


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", sure: float = SURE) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by `every`."""
    quantile = chi_square_quantile(sure, DIRECTIONS)
    index, boxes = build_index(checkpointed(projected(vectors, id_col, vector_col)))
    key = ["dim", "home", "home_sub", "place"]
    best = Window.partitionBy(*key).orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())

    def merged(queries: DataFrame, more: DataFrame) -> DataFrame:
        own = queries.select(*key, "query_id", F.explode("found").alias("f")).select(*key, "query_id", "f.*")
        return own.unionByName(more).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    home = checkpointed(_at_home(index, every, k, quantile))
    after = merged(home, _search(index, _routed(home, boxes, k, quantile, True), k, quantile))
    hits = F.transform(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))), lambda x: F.struct(x["vec_id"].alias("vec_id"), x["score"].alias("score")))
    found = after.groupBy(*key).agg(hits.alias("found"))
    kept = home.drop("found").join(found, key, "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<vec_id: long, score: double>>")))
    kept = checkpointed(kept.select(*home.columns))
    return merged(kept, _search(index, _routed(kept, boxes, k, quantile, False), k, quantile)).select("query_id", "rank", "vec_id", "score")
