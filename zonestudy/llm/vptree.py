"""Nearest neighbours by inner product with a vantage-point tree for each shard."""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonestudy.llm.shared import written

#: Rounding that a sum of products may carry, as a share of the two lengths' product.
SLACK = 1e-12


#: Pivots at most, which are held on the driver and by every task.
PIVOTS = 4096

#: Shards that a block of queries is held against at once, and that are written with one copy of it; visits in one batch.
SHARDS, SENT = 256, 16


@dataclass
class Tree:
    """Vectors in leaf order and the ``radius`` of the sphere they are lifted to. ``nodes``: first and last place, left and right child (-1: a
    leaf); ``far``: vantage points; ``bounds``: least and largest distance to them of the left and of the right half."""

    ids: np.ndarray
    vectors: np.ndarray
    radius: float
    nodes: np.ndarray
    far: np.ndarray
    bounds: np.ndarray


def packed(**arrays: np.ndarray) -> bytes:
    """Arrays as one value of a binary column."""
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpacked(value: pa.Scalar) -> dict[str, np.ndarray]:
    return dict(np.load(io.BytesIO(value.as_buffer()), allow_pickle=False))


def lifted(vectors: np.ndarray, radius: float) -> np.ndarray:
    """Points on a sphere, one dimension more: the nearest of them to a query (with a 0 added) is the one with the largest
    inner product."""
    vectors = vectors.astype(np.float64)
    rest = np.sqrt(np.maximum(radius * radius - (vectors * vectors).sum(axis=1), 0.0))
    return np.hstack([vectors, rest[:, None]])


def build(ids: np.ndarray, vectors: np.ndarray, leaf: int = 256) -> Tree:
    """Splits at the median distance from the point farthest from the mean, by rank, so that equal points split as well."""
    radius = float(np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1).max())) * (1 + 1e-9)
    points, order = lifted(vectors, radius), np.arange(len(ids))
    nodes, fars, bounds = [], [], []

    def split(a: int, b: int) -> int:
        at = len(nodes)
        nodes.append((a, b, -1, -1))
        fars.append(np.zeros(points.shape[1]))
        bounds.append((0.0, 0.0, 0.0, 0.0))
        own = order[a:b]
        if b - a <= leaf:
            return at
        far = points[own[np.argmax(((points[own] - points[own].mean(axis=0)) ** 2).sum(axis=1))]]
        d = np.sqrt(((points[own] - far) ** 2).sum(axis=1))
        by, middle = np.argsort(d, kind="stable"), (b - a) // 2
        order[a:b], d = own[by], d[by]
        left = split(a, a + middle)
        right = split(a + middle, b)
        nodes[at], fars[at], bounds[at] = (a, b, left, right), far, (d[0], d[middle - 1], d[middle], d[-1])
        return at

    split(0, len(ids))
    return Tree(ids[order], vectors[order], radius, np.array(nodes), np.array(fars), np.array(bounds))


def first_of_equal(ids: np.ndarray, vectors: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` smallest ids of each distinct vector. Equal vectors tie, and ties go to the smaller id, so no others can be among
    a query's n - 1 nearest, even if the query is one of them."""
    rows = np.ascontiguousarray(vectors)
    _, kind = np.unique(rows.view([("", rows.dtype)] * rows.shape[1]).ravel(), return_inverse=True)
    order = np.lexsort((ids, kind))
    first = np.flatnonzero(np.diff(kind[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return np.sort(order[rank < n])


def best_of(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's ``k`` largest scores, ties to the smaller id, largest first."""
    order = np.lexsort((ids, -score, query))
    first = np.flatnonzero(np.diff(query[order], prepend=-1))
    return order[np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order)))) < k]


def search(tree: Tree, ids: np.ndarray, vectors: np.ndarray, k: int, factor: float, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place in the tree, score) of each query's ``k`` largest inner products in ``tree``, ties to the smaller id; those below ``known``, a
    score that ``k`` others are known to reach, needn't be among them.

    Each query first goes down to the leaf it lies nearest to, which bounds its k-th score. Then all go through the tree
    together, and a branch is left out for the queries to which the triangle inequality puts it farther than
    their bound divided by ``factor``: 1 loses nothing, more looks at less. In a leaf all that can be among the k, rounding
    included, is scored exactly. A point with the query's id isn't its neighbour."""
    queries, points = vectors.astype(np.float64), tree.vectors.astype(np.float64)
    flat = np.hstack([queries, np.zeros((len(queries), 1))])
    length, norms = np.sqrt((queries * queries).sum(axis=1)), np.sqrt((points * points).sum(axis=1))
    span = length * length + tree.radius * tree.radius  # squared distance: span - 2 * score
    floor = np.full(len(queries), -np.inf) if known is None else known - SLACK * length * norms.max()
    best = np.full((len(queries), k), -np.inf)
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def scores(a: int, b: int, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = queries[active] @ points[a:b].T
        s[ids[active][:, None] == tree.ids[a:b][None, :]] = -np.inf
        return s, SLACK * length[active] * norms[a:b].max()

    def kth(s: np.ndarray) -> np.ndarray:
        return np.partition(s, -k, axis=1)[:, -k] if s.shape[1] >= k else np.full(len(s), -np.inf)

    def gap(d: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return np.maximum(np.maximum(bounds[0] - d, d - bounds[1]), 0.0)

    def down(at: int, active: np.ndarray) -> None:
        a, b, left, right = tree.nodes[at]
        if not len(active):
            return
        if left < 0:
            s, slack = scores(a, b, active)
            floor[active] = np.maximum(floor[active], kth(s) - slack)
            return
        far, inner, outer = tree.far[at], tree.bounds[at, :2], tree.bounds[at, 2:]
        d = np.sqrt(((flat[active] - far) ** 2).sum(axis=1))
        near = gap(d, inner) <= gap(d, outer)
        down(left, active[near])
        down(right, active[~near])

    def through(at: int, active: np.ndarray) -> None:
        a, b, left, right = tree.nodes[at]
        if not len(active):
            return
        if left < 0:
            s, slack = scores(a, b, active)
            least = np.maximum(np.maximum(floor, best[:, -1])[active], kth(s)) - 2 * slack
            rows, columns = np.nonzero((s >= least[:, None]) & (s > -np.inf))
            exact = inner_products(vectors[active[rows]], tree.vectors[a + columns])
            top = best_of(rows, tree.ids[a + columns], exact, k)
            kept.append((active[rows[top]], a + columns[top], exact[top]))
            own = np.full((len(active), k), -np.inf)
            rank = np.arange(len(top)) - np.searchsorted(rows[top], rows[top])
            own[rows[top], rank] = exact[top]
            best[active] = -np.sort(-np.hstack([best[active], own]), axis=1)[:, :k]
            return
        d = np.sqrt(((flat[active] - tree.far[at]) ** 2).sum(axis=1))
        for child, bounds in ((left, tree.bounds[at, :2]), (right, tree.bounds[at, 2:])):
            least = np.maximum(floor, best[:, -1])[active]
            bound = np.sqrt(np.maximum(span[active] - 2 * least, 0.0) + SLACK * span[active]) / factor
            through(child, active[gap(d, bounds) <= bound + SLACK * np.sqrt(span[active])])

    everyone = np.arange(len(queries))
    down(0, everyone)
    through(0, everyone)
    empty = (everyone[:0], everyone[:0], np.zeros(0))
    query, place, score = (np.concatenate(x) for x in zip(*kept, empty, strict=True))
    top = best_of(query, tree.ids[place], score, k)
    return query[top], place[top], score[top]


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, summed from left to right."""
    return np.cumsum(a.astype(np.float64) * b.astype(np.float64), axis=1)[:, -1]


def usable(vector: Column) -> Column:
    """Neither null, empty or zero, nor with null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def reaches(queries: np.ndarray, known: np.ndarray, pivots: np.ndarray, reach: np.ndarray, factor: float) -> np.ndarray:
    """For each query and shard whether the shard can hold a score of at least ``known``. A shard's vectors lie within ``reach`` of its pivot, so
    no score is above the pivot's own by more than the query's length times that; ``factor`` makes the reach smaller."""
    length = np.sqrt((queries * queries).sum(axis=1))
    slack = 2 * SLACK * (np.sqrt((pivots * pivots).sum(axis=1)) + reach)
    most = length[:, None] * (reach / factor + slack)[None, :]
    most += queries @ pivots.T
    return most >= known[:, None]


def asked_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The visits of each row: for each shard (dim, home, part) those of the row's queries that must go there."""
    for batch in batches:
        for i in range(batch.num_rows):
            asked = unpacked(batch.column("queries")[i])
            shards, dim = batch.column("shards")[i].as_py(), batch.column("dim")[i].as_py()
            goes = np.unpackbits(asked.pop("goes"), axis=0, count=len(asked["ids"])).astype(bool)
            for a in range(0, len(shards), SENT):
                some = shards[a : a + SENT]
                cut = [packed(**{name: x[goes[:, a + j]] for name, x in asked.items()}) for j in range(len(some))]
                at = [pa.array(c, pa.int32()) for c in ([dim] * len(some), [s["home"] for s in some], [s["part"] for s in some])]
                yield pa.RecordBatch.from_arrays([*at, pa.array(cut, pa.binary())], names=["dim", "home", "part", "queries"])


def nearest(rows: DataFrame, is_query: Column, k: int = 20, factor: float = 1.0, shard_rows: int = 8192, query_rows: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row the ``k`` other rows with the largest inner product, ties to the smaller vec_id.

    ``rows`` has vec_id and embedding; ``is_query`` picks the queries. Rows are dealt to the nearest of at most ``PIVOTS`` pivots, one for
    ``shard_rows`` rows, taken by a hash of vec_id, and a pivot's rows, when they are more, to shards by another hash. Each shard builds a
    vantage-point tree over its vectors lifted to a sphere, where the largest inner product is the least distance. Queries are packed
    in blocks by their pivot. A block first meets one shard of its own pivot, which tells what scores its queries reach; then each query goes to
    the shards that the triangle inequality doesn't exclude for it, and the best of those are ranked. A block is held against ``SHARDS`` shards at
    a time and written once for so many, with a bit for each query and shard; only the queries that a shard needs are sent to it. Scores are those of the original
    vectors in double precision. ``factor`` 1 is exact search; a larger one leaves out more shards and more branches.

    Null, empty and zero vectors, those with null or non-finite components, and rows without a vec_id take no part. Of rows with one
    vec_id the least vector counts. Vectors of different lengths aren't neighbours. No rows give no rows; with fewer
    than ``k`` others, all are returned. Other columns are ignored."""
    spark = rows.sparkSession
    chosen = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", is_query.alias("q")).filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    chosen = chosen.groupBy("vec_id").agg(F.min("embedding").alias("embedding"), F.max("q").alias("q")).withColumn("dim", F.size("embedding"))
    chosen = written(chosen, "vectors")
    wanted = min(PIVOTS, 1 + chosen.count() // shard_rows)
    taken = chosen.orderBy(F.xxhash64(F.lit("pivot"), "vec_id"), "vec_id").limit(wanted).select("embedding").collect()
    every = chosen.select("dim").distinct().collect()
    pivots = {r.dim: np.array([x.embedding for x in taken if len(x.embedding) == r.dim] or [[0.0] * r.dim]) for r in every}
    shared = spark.sparkContext.broadcast(pivots)

    def homes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home, values = np.zeros(batch.num_rows, dtype=np.int32), batch.column("embedding")
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                own = values.take(pa.array(at)).flatten().to_numpy().reshape(-1, dim).astype(np.float64)
                to = shared.value[int(dim)]
                home[at] = ((to * to).sum(axis=1)[None, :] - 2 * own @ to.T).argmin(axis=1)
            yield batch.append_column("home", pa.array(home))

    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in chosen.schema)}, home int"
    placed = written(chosen.mapInArrow(homes, schema), "placed")
    many = placed.groupBy("dim", "home").agg(F.ceil(F.count("*") / shard_rows).alias("parts"), F.ceil(F.count_if("q") / query_rows).alias("blocks"))
    placed = placed.join(F.broadcast(many), ["dim", "home"])  # a row for each pivot and length

    def vectors(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        pdf = pdf.sort_values("vec_id")
        return pdf["vec_id"].to_numpy(), np.stack(pdf["embedding"].to_list())

    def tree(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, own = vectors(pdf)
        first = first_of_equal(ids, own, k + 1)
        t = build(ids[first], own[first])
        reach = np.sqrt(((own - shared.value[own.shape[1]][pdf["home"].iloc[0]]) ** 2).sum(axis=1).max())
        return pdf[["dim", "home", "part"]].iloc[:1].assign(reach=reach, tree=[packed(ids=t.ids, vectors=t.vectors, radius=np.array(t.radius), nodes=t.nodes, far=t.far, bounds=t.bounds)])

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, own = vectors(pdf)
        return pdf[["dim", "home", "block"]].iloc[:1].assign(queries=[packed(ids=ids, vectors=own)])

    part, of = F.pmod(F.xxhash64("vec_id"), "parts").cast("int"), F.pmod(F.xxhash64(F.lit(1), "vec_id"), "blocks").cast("int")
    trees = written(placed.withColumn("part", part).groupBy("dim", "home", "part").applyInPandas(tree, "dim int, home int, part int, reach double, tree binary"), "trees")
    blocks = placed.filter("q").withColumn("block", of).groupBy("dim", "home", "block").applyInPandas(block, "dim int, home int, block int, queries binary")
    limits = sorted(tuple(r) for r in trees.select("dim", "home", "part", "reach").collect())  # a row for each shard
    summary = spark.sparkContext.broadcast({d: np.array([x[1:] for x in limits if x[0] == d]) for d in pivots})

    def begun(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                asked = unpacked(batch.column("queries")[i])
                ids, own, known = asked["ids"], asked["vectors"], np.full(len(asked["ids"]), -np.inf)
                query, _, score = search(Tree(**unpacked(batch.column("tree")[i])), ids, own, k, factor)
                last = np.flatnonzero(np.append(np.diff(query), 1))
                full = np.bincount(query, minlength=len(ids))[query[last]] == k
                known[query[last[full]]] = score[last[full]]
                dim = batch.column("dim")[i].as_py()
                shards = summary.value[dim]
                wide = own.astype(np.float64)
                for a in range(0, len(shards), SHARDS):
                    cut = shards[a : a + SHARDS]
                    goes = reaches(wide, known, shared.value[dim][cut[:, 0].astype(int)], cut[:, 2], factor)
                    there, asking = np.flatnonzero(goes.any(axis=0)), goes.any(axis=1)
                    if not len(there):
                        continue
                    some = packed(ids=ids[asking], vectors=own[asking], known=known[asking], goes=np.packbits(goes[asking][:, there], axis=0))
                    names = [{"home": int(cut[k, 0]), "part": int(cut[k, 1])} for k in there]
                    to = pa.array([names], pa.list_(pa.struct([("home", pa.int32()), ("part", pa.int32())])))
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), to, pa.array([some], pa.binary())], names=["dim", "shards", "queries"])

    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, own = None, None
        for batch in batches:
            key = list(zip(*(batch.column(c).to_pylist() for c in ("dim", "home", "part", "turn")), strict=True))
            for i, is_tree in enumerate(batch.column("tree").is_valid().to_pylist()):
                if is_tree:
                    current, own = key[i], Tree(**unpacked(batch.column("tree")[i]))
                    continue
                if current != key[i]:
                    raise RuntimeError(f"shard {key[i]} has no tree")
                asked = unpacked(batch.column("queries")[i])
                query, place, score = search(own, asked["ids"], asked["vectors"], k, factor, asked["known"])
                yield pa.RecordBatch.from_arrays([pa.array(asked["ids"][query]), pa.array(own.ids[place]), pa.array(score)], names=["query_id", "vec_id", "score"])

    firsts = trees.filter("part = 0").select("dim", "home", "tree")
    started = blocks.join(firsts, ["dim", "home"]).select("dim", "queries", "tree")
    started = written(started.mapInArrow(begun, "dim int, shards array<struct<home: int, part: int>>, queries binary"), "started")
    # a tree is read once for about sixteen blocks
    asked = started.select("dim", F.explode("shards").alias("s")).groupBy("dim", "s").count()
    turns = 1 + asked.agg(F.coalesce(F.max("count"), F.lit(0))).first()[0] // 16
    visits = started.mapInArrow(asked_of, "dim int, home int, part int, queries binary").withColumns({"turn": F.pmod(F.xxhash64("queries"), F.lit(turns)).cast("int"), "tree": F.lit(None).cast("binary")})
    own = trees.select("dim", "home", "part", F.lit(None).cast("binary").alias("queries"), F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"), "tree")
    keys = ["dim", "home", "part", "turn"]
    routed = own.unionByName(visits).repartition(*keys).sortWithinPartitions(*keys, F.col("tree").isNull())
    hits = routed.mapInArrow(found, "query_id long, vec_id long, score double")
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, min(CAST(embedding AS DOUBLE[])) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  GROUP BY vec_id
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]), lambda a, x: a + x) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 20
"""
