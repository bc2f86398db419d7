"""Nearest neighbours by inner product with vantage-point trees per shard.

A coordinate that fills every vector up to the largest norm turns inner products into
Euclidean distances, where the triangle inequality holds; queries are scaled to that norm,
which keeps their order of neighbours. Vectors are dealt to the nearest of at most
``PIVOTS`` pivots (fitted on a bounded sample), large cells into shards of bounded size,
and each shard gets a tree. A query first visits the cell of its nearest pivot. The
distance of its last neighbour there prunes other cells, and subtrees everywhere: a part
is skipped if its lower bound times ``factor`` exceeds that distance. Factor one is exact
search; more skips more.

Equal vectors are one point that carries as many smallest ids as a result can need.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keysieve.llm import common as K

NEAREST = 20
FACTOR = 1.15
#: Rows that pivots are picked from at most, pivots at most, and points of a cell and shard about.
SAMPLE_ROWS = 20_000
PIVOTS = 1_024
CELL = 4_096
SHARD = 16_384
LEAF = 128
#: Points kept beyond those asked for, so that rounding decides nothing at the cut.
SPARE = 8
_FOUND = "query_key long, key long, ids array<long>, score double"


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64) if len(column) else np.zeros((0, 1))


class Tree:
    """A vantage-point tree over rows of ``points``; leaves hold up to ``LEAF`` of them."""

    def __init__(self, points: np.ndarray, norm: float):
        fill = np.sqrt(np.maximum(norm**2 - (points**2).sum(1), 0))
        self.points, self.norm = points, norm
        self._lifted = np.column_stack([points, fill])
        self._root = self._grow(np.arange(len(points)))

    def _grow(self, rows: np.ndarray):
        if len(rows) <= LEAF:
            return rows
        center = self._lifted[rows[len(rows) // 2]]
        away = np.sqrt(((self._lifted[rows] - center) ** 2).sum(1))
        order = np.argsort(away, kind="stable")
        rows, away, half = rows[order], away[order], len(rows) // 2
        parts = [(away[a], away[b - 1], self._grow(rows[a:b])) for a, b in ((0, half), (half, len(rows)))]
        return center, (away[half - 1] + away[half]) / 2, parts

    def search(self, queries: np.ndarray, floor: np.ndarray, keep: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(query row, point row) pairs that hold every query's best ``keep`` points not under ``floor``.

        ``queries`` are scaled to the norm; ``floor`` holds inner products of scaled queries.
        """
        self._best = np.full((len(queries), keep), -np.inf)
        self._best[:, 0] = -np.inf
        self._floor, self._queries, self._pairs, self._factor = floor.copy(), queries, [], factor
        self._visit(self._root, np.arange(len(queries)))
        if not self._pairs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        query, point, score = (np.concatenate(x) for x in zip(*self._pairs))
        good = score >= self._floor[query] - self._slack()
        return query[good], point[good]

    def _slack(self) -> float:
        return 1e-9 * self.norm**2

    def _visit(self, node, who: np.ndarray) -> None:
        if not len(who):
            return
        if isinstance(node, np.ndarray):
            score = self._queries[who] @ self.points[node].T
            q, p = np.nonzero(score >= self._floor[who][:, None] - self._slack())
            self._pairs.append((who[q], node[p], score[q, p]))
            keep = self._best.shape[1]
            best = np.concatenate([self._best[who], score], 1)
            best = np.partition(best, best.shape[1] - keep, 1)[:, -keep:]
            self._best[who] = best
            self._floor[who] = np.maximum(self._floor[who], best.min(1))
            return
        center, middle, parts = node
        away = np.sqrt(np.maximum(2 * self.norm**2 - 2 * self._queries[who] @ center[:-1], 0))
        near = (away > middle).astype(int)
        for second in (0, 1):
            for side, (low, high, below) in enumerate(parts):
                mine = near != side if second else near == side
                gap = np.maximum(np.maximum(low - away, away - high), 0)
                reach = np.sqrt(np.maximum(2 * self.norm**2 - 2 * self._floor[who], 0))
                self._visit(below, who[mine & (gap * self._factor <= reach + 1e-6 * self.norm)])


def _scaled(vectors: np.ndarray, norm: float) -> tuple[np.ndarray, np.ndarray]:
    size = np.sqrt((vectors**2).sum(1))
    return vectors * (norm / size)[:, None], size


def _search_shards(norm: float, keep: int, factor: float):
    """Rows sorted by shard, points before queries: a tree per shard, then queries batch by batch."""

    def found(key, keys, ids, tree, frame) -> pd.DataFrame:
        vectors = _matrix(frame["embedding"])
        scaled, size = _scaled(vectors, norm)
        query, point = tree.search(scaled, frame["floor"].to_numpy() * norm / size, keep, factor)
        exact = (vectors[query] * tree.points[point]).cumsum(1)[:, -1] if len(query) else np.zeros(0)
        order = np.lexsort((keys[point], -exact, query))
        query, point, exact = query[order], point[order], exact[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query, "left")
        top = rank < keep
        return pd.DataFrame({
            "query_key": frame["key"].to_numpy()[query[top]], "key": keys[point[top]],
            "ids": [ids[p] for p in point[top]], "score": exact[top],
        })

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, parts, tree, keys, ids = None, [], None, None, None
        for frame in frames:
            for own, rows in frame.groupby("shard", sort=True):
                if own != shard:
                    shard, parts, tree = own, [], None
                points, queries = rows[rows["kind"] == 0], rows[rows["kind"] == 1]
                if len(points):
                    parts.append(points)
                if len(queries) and parts:
                    if tree is None:
                        whole = pd.concat(parts)
                        keys, ids = whole["key"].to_numpy(), whole["ids"].tolist()
                        tree = Tree(_matrix(whole["embedding"]), norm)
                    for lo in range(0, len(queries), 2_048):
                        yield found(own, keys, ids, tree, queries.iloc[lo : lo + 2_048])

    return search


def _usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) rows that take part: id not null, components finite and not all zero."""
    part = F.col("embedding")
    # Floats stay as they are, all other numbers are doubles.
    if vectors.schema["embedding"].dataType.elementType.simpleString() != "float":
        vectors = vectors.withColumn("embedding", part.cast("array<double>"))
    return vectors.select("vec_id", "embedding").where(
        F.col("vec_id").isNotNull() & F.forall(part, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(part, lambda x: x != 0)
    ).dropDuplicates(["vec_id", "embedding"])


def nearest(vectors: DataFrame, every: int = NEAREST, nearest: int = NEAREST, factor: float = FACTOR) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``nearest`` best found for rows whose id ``every`` divides.

    The row itself is no candidate; ties go to the smaller id; with fewer candidates all
    are returned. Vectors that are null, zero or hold null or non-finite components take no
    part, nor do rows with a null id. Rows that repeat id and vector are one. Vectors of
    different lengths are never compared. Scores are double precision sums over the
    vectors as they are given, floats or doubles.
    """
    rows = K.settled(_usable(vectors))
    sizes = [r.size for r in rows.select(F.size("embedding").alias("size")).distinct().collect()]
    out = None
    for size in sizes:
        own = _nearest(rows.where(F.size("embedding") == size), every, nearest, factor)
        out = own if out is None else out.unionAll(own)
    if out is None:
        schema = f"query_id {vectors.schema['vec_id'].dataType.simpleString()}, rank int, vec_id {vectors.schema['vec_id'].dataType.simpleString()}, score double"
        return vectors.sparkSession.createDataFrame([], schema)
    return out


def _nearest(rows: DataFrame, every: int, nearest: int, factor: float) -> DataFrame:
    spark = rows.sparkSession
    kind = rows.schema["embedding"].dataType.simpleString()
    keep = nearest + 1 + SPARE
    # Only the smallest ids of equal vectors can be results; the limit runs before the shuffle too.
    same = Window.partitionBy("embedding").orderBy("vec_id")
    points = K.settled(
        rows.withColumn("_rank", F.row_number().over(same)).where(F.col("_rank") <= nearest + 1)
        .groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
        .select("embedding", F.col("ids")[0].cast("long").alias("key"), F.col("ids").cast("array<long>").alias("ids"))
    )
    asked = rows.where(F.col("vec_id") % every == 0)
    queries = asked.groupBy("embedding").agg(F.min("vec_id").cast("long").alias("key"))
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    count, square = points.agg(F.count(F.lit(1)), F.max(squares)).first()
    if not count:
        return asked.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    norm = float(np.sqrt(square)) * (1 + 1e-12)

    sample = points.orderBy(F.xxhash64("key")).limit(min(SAMPLE_ROWS, PIVOTS, max(1, count // CELL))).collect()
    pivots = np.array([r.embedding for r in sample], np.float64)
    pivots = np.column_stack([pivots, np.sqrt(np.maximum(norm**2 - (pivots**2).sum(1), 0))])

    def lifted(vectors: np.ndarray) -> np.ndarray:
        return np.column_stack([vectors, np.sqrt(np.maximum(norm**2 - (vectors**2).sum(1), 0))])

    def distances(vectors: np.ndarray) -> np.ndarray:
        squared = (vectors**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * vectors @ pivots.T
        return np.sqrt(np.maximum(squared, 0))

    @F.pandas_udf("cell int, away double")
    def to_cell(batch: pd.Series) -> pd.DataFrame:
        away = distances(lifted(_matrix(batch)))
        cell = away.argmin(1)
        return pd.DataFrame({"cell": cell.astype(np.int32), "away": away[np.arange(len(cell)), cell]})

    placed = K.settled(points.withColumn("at", to_cell("embedding")).select("*", "at.cell", "at.away").drop("at"))
    cells = {
        r.cell: r for r in placed.groupBy("cell").agg(
            F.count(F.lit(1)).alias("points"), F.min("away").alias("low"), F.max("away").alias("high")
        ).collect()
    }
    names = np.array(sorted(cells))
    low, high = (np.array([getattr(cells[c], x) for c in names]) for x in ("low", "high"))
    shards = [-(-cells[c].points // SHARD) for c in names]
    first = dict(zip(names.tolist(), np.cumsum([0, *shards[:-1]]).tolist()))
    split = F.create_map(*(F.lit(x) for c, n in zip(names.tolist(), shards) for x in (c, n)))
    start = F.create_map(*(F.lit(x) for c, n in first.items() for x in (c, n)))
    dealt = placed.select(
        (F.element_at(start, F.col("cell")) + F.pmod(F.xxhash64("key"), F.element_at(split, F.col("cell")))).alias("shard"),
        F.lit(0).alias("kind"), "key", "embedding", "ids", F.lit(0.0).alias("floor"),
    )

    def routed(home: bool):
        """Shards to visit: those of the nearest pivot's cell, or all others that ``floor`` can't rule out."""

        def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                vectors, size = _scaled(_matrix(frame["embedding"]), norm)
                away = distances(np.column_stack([vectors, np.zeros(len(vectors))]))[:, names]
                nearest_cell = away.argmin(1)
                go = np.zeros(away.shape, bool)
                if home:
                    go[np.arange(len(go)), nearest_cell] = True
                else:
                    gap = np.maximum(np.maximum(low - away, away - high), 0)
                    reach = np.sqrt(np.maximum(2 * norm**2 - 2 * frame["floor"].to_numpy() * norm / size, 0))
                    go = gap * factor <= (reach + 1e-6 * norm)[:, None]
                    go[np.arange(len(go)), nearest_cell] = False
                who, cell = np.nonzero(go)
                many = np.array(shards)[cell]
                who, cell = np.repeat(who, many), np.repeat(cell, many)
                part = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
                out = frame.iloc[who].copy()
                out["shard"] = np.cumsum([0, *shards[:-1]])[cell] + part
                yield out[["shard", "key", "embedding", "floor"]]

        return route

    def visited(asking: DataFrame, home: bool) -> DataFrame:
        go = asking.mapInPandas(routed(home), f"shard long, key long, embedding {kind}, floor double")
        both = dealt.withColumn("shard", F.col("shard").cast("long")).unionByName(
            go.select("shard", F.lit(1).alias("kind"), "key", "embedding", F.lit(None).cast("array<long>").alias("ids"), "floor")
        )
        sorted_ = both.repartition("shard").sortWithinPartitions("shard", "kind")
        return K.settled(sorted_.mapInPandas(_search_shards(norm, keep, factor), _FOUND))

    asking = K.settled(queries.select("key", "embedding"))
    at_home = visited(asking.withColumn("floor", F.lit(float("-inf"))), True)
    best = Window.partitionBy("query_key").orderBy(F.col("score").desc(), "key")
    floors = (
        at_home.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= keep)
        .groupBy("query_key").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("found"))
        .where(F.col("found") == keep)
    )
    floor = F.coalesce("least", F.lit(float("-inf")))
    farther = visited(
        asking.join(floors, asking["key"] == floors["query_key"], "left").select("key", "embedding", floor.alias("floor")), False
    )
    found = (
        at_home.unionAll(farther).withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= keep)
        .groupBy("query_key").agg(F.collect_list(F.struct("score", "ids")).alias("found"))
    )
    pairs = F.flatten(F.transform("found", lambda f: F.transform(f["ids"], lambda i: F.struct((-f["score"]).alias("minus"), i.alias("vec_id")))))
    results = K.settled(found.select("query_key", F.slice(F.array_sort(pairs), 1, nearest + 1).alias("found")))
    id_type = rows.schema["vec_id"].dataType
    keyed = asked.join(queries, "embedding").select(F.col("vec_id").alias("query_id"), F.col("key").alias("query_key"))
    others = F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, nearest)
    return (
        keyed.join(results, "query_key").select("query_id", F.posexplode(others).alias("rank", "f"))
        .select("query_id", (F.col("rank") + 1).alias("rank"), F.col("f.vec_id").cast(id_type).alias("vec_id"), (-F.col("f.minus")).alias("score"))
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])
