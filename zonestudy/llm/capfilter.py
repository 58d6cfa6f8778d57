"""Near-duplicate vectors by spherical-cap filters from structured random product codes."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonestudy.llm.components import components, joined_by
from zonestudy.llm.shared import written

#: Vectors whose cosine is as large link.
COSINE = 0.93
#: Filters that two vectors at that cosine share on average. Codes differ from pair to pair, so that some pairs share fewer: of 2,000 pairs at
#: 0.93 in 64 dimensions 0.9995 shared one, of those at 0.95 and more all.
COMMON = 20
#: Independent codes, and directions in each of the two halves of one at most: 16 * 1,024 ** 2 filters, whose tables take 17 MB for 64 dimensions.
CODES, SIDE = 16, 1024
#: Vectors of one filter that meet in a task at once; larger filters meet block by block.
BLOCK = 1024
#: Filters of so few vectors are compared many at a time.
FEW = 16


@dataclass(frozen=True)
class Filters:
    """``side`` directions in each half of each code of ``dim`` dimensions; a vector passes a filter at an inner product of ``least``."""

    dim: int
    side: int
    least: float


@lru_cache(maxsize=4)
def _tails(dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x, and density and upper tail there, of one coordinate of a random unit vector."""
    x = np.linspace(-1, 1, 20_001)
    density = np.maximum(1 - x * x, 0.0) ** ((dim - 3) / 2)
    tail = np.cumsum(density[::-1])[::-1]
    return x, density / tail[0], tail / tail[0]


def shared_share(least: float, dim: int, cosine: float) -> tuple[float, float]:
    """The share of filters that a vector passes, and the share of those that one at ``cosine`` from it passes, too."""
    x, density, tail = _tails(dim)
    z, _, beyond = _tails(dim - 1)
    above = x >= least
    u = x[above]
    need = (least - cosine * u) / np.sqrt((1 - cosine * cosine) * np.maximum(1 - u * u, 1e-12))
    return float(np.interp(least, x, tail)), float((density[above] * np.interp(need, z, beyond, left=1.0, right=0.0)).sum() / density[above].sum())


def filters_for(length: int, n: int, cosine: float = COSINE) -> Filters:
    """Filters for ``n`` vectors of ``length`` components: as many as let about one other vector pass each that a vector passes, ``SIDE`` permitting,
    and the threshold at which two vectors at ``cosine`` share ``COMMON`` on average. Short vectors are filled up with zeros."""
    dim = max(8, length + length % 2)

    def threshold(wanted) -> float:
        low, high = 0.0, 0.95
        for _ in range(50):
            middle = (low + high) / 2
            low, high = (middle, high) if wanted(*shared_share(middle, dim, cosine)) else (low, middle)
        return low

    rare = threshold(lambda share, both: share * max(n, 20) > 1 and both > 0.1)
    share, both = shared_share(rare, dim, cosine)
    side = min(SIDE, max(2, math.ceil(math.sqrt(COMMON / (share * both) / CODES))))
    return Filters(dim, side, threshold(lambda share, both: CODES * side * side * share * both > COMMON))


@lru_cache(maxsize=2)
def _codes(dim: int, side: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each code a rotation, whose columns are cut in two halves, and the directions in each half, of length sqrt(1/2)."""
    out = []
    for k in range(CODES):
        draw = np.random.Generator(np.random.Philox(key=[dim * SIDE + side, k]))
        turn = np.linalg.qr(draw.standard_normal((dim, dim)))[0]
        halves = draw.standard_normal((2, side, dim // 2))
        halves /= np.linalg.norm(halves, axis=2, keepdims=True) * math.sqrt(2)
        out.append((turn, halves[0], halves[1]))
    return out


def decode(vectors: np.ndarray, filters: Filters) -> tuple[np.ndarray, np.ndarray]:
    """Row and number of every filter that a row of unit ``vectors`` passes: halves that can't be completed to ``least`` are left out first."""
    padded = np.zeros((len(vectors), filters.dim))
    padded[:, : vectors.shape[1]] = vectors
    half, rows, passed = filters.dim // 2, [], []
    for k, (turn, first, second) in enumerate(_codes(filters.dim, filters.side)):
        turned = padded @ turn
        a, b = turned[:, :half] @ first.T, turned[:, half:] @ second.T
        row, i = np.nonzero(a >= (filters.least - b.max(axis=1))[:, None])
        for at in range(0, len(row), 4096):
            r, x = row[at : at + 4096], i[at : at + 4096]
            pair, j = np.nonzero(b[r] >= (filters.least - a[r, x])[:, None])
            rows.append(r[pair])
            passed.append((k * filters.side + x[pair]) * filters.side + j)
    empty = np.zeros(0, dtype=np.int64)
    return np.concatenate([empty, *rows]), np.concatenate([empty, *passed])


def unit(vectors: np.ndarray) -> np.ndarray:
    """Each row over its length; over its largest component first, so that no square is too large or small."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _matrix(values: pa.Array, length: int) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)


def _links(x: np.ndarray, y: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows of ``x`` and ``y`` link. What rounding could decide is summed in one order wherever the two meet."""
    score = x @ y.T
    out = score >= cosine
    for i, j in zip(*np.nonzero(np.abs(score - cosine) < 1e-9), strict=True):
        out[i, j] = math.fsum(x[i] * y[j]) >= cosine
    return out


def _earlier(own: list[np.ndarray], number: int) -> np.ndarray:
    """Which rows share a filter below ``number``, so that they met there."""
    row = np.repeat(np.arange(len(own)), [len(x) for x in own])
    all_of = np.concatenate(own)
    row, all_of = row[all_of < number], all_of[all_of < number]
    found, column, times = np.unique(all_of, return_inverse=True, return_counts=True)
    column = (np.cumsum(times > 1) - 1)[column[times[column] > 1]] if len(found) else column
    row = row[np.isin(all_of, found[times > 1])]
    out = np.zeros((len(own), len(own)), dtype=bool)
    for at in range(0, int((times > 1).sum()), 4096):
        here = (column >= at) & (column < at + 4096)
        has = np.zeros((len(own), 4096), dtype=np.float32)
        has[row[here], column[here] - at] = 1
        out |= has @ has.T > 0
    return out


def _met(nodes: np.ndarray, copies: np.ndarray, vectors: np.ndarray, own: list[np.ndarray], number: int, left: np.ndarray | None, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each vector of a filter the links (copies counted) that no earlier filter shows, and the smallest node of its part of the links.

    ``left`` says which are of the first block of two; only links between blocks count then."""
    linked = _links(vectors, vectors, cosine)
    linked = np.triu(linked, 1) | np.triu(linked, 1).T
    if left is not None:
        linked &= left[:, None] != left[None, :]
    low = np.arange(len(nodes))
    while True:  # each turn takes the least of the neighbours, and of what that one has taken
        least = np.where(linked, low[None, :], len(nodes)).min(axis=1)
        least = np.minimum(low, least)
        least = least[least]
        if (least == low).all():
            break
        low = least
    new = linked & ~_earlier(own, number) if linked.any() else linked
    return (new * copies[None, :]).sum(axis=1), nodes[low]


def _compare(batches: Iterable[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """node, links and low from rows (cell, node, copies, vector, own, side) in the order of cells; a cell's vectors, two blocks at most, are held at once."""
    names = ["node", "links", "low"]
    rest: pa.Table | None = None

    def settled(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        cells = table.column("cell").combine_chunks().dictionary_encode()
        code = cells.indices.to_numpy()
        first = np.flatnonzero(np.diff(code, prepend=-1))
        sizes = np.diff(np.append(first, len(code)))
        what = [cells.dictionary[int(code[a])].as_py().split("/", 4) for a in first.tolist()]
        lengths = np.array([int(w[0]) for w in what])
        values, own_of = table.column("vector").combine_chunks(), table.column("own").combine_chunks()
        nodes, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        side = table.column("side").to_numpy()
        out = []
        for length in np.unique(lengths).tolist():
            groups = np.flatnonzero(lengths == length)
            a, b = first[groups[0]], first[groups[-1]] + sizes[groups[-1]]
            vectors = unit(_matrix(values.slice(a, b - a), length))
            small = groups[sizes[groups] <= FEW]
            worth = set(groups[sizes[groups] > FEW].tolist())
            for k in np.unique(sizes[small]).tolist():
                here = small[sizes[small] == k]
                i, j = np.triu_indices(k, 1)
                for at in range(0, len(here), 4096 // k):
                    some = here[at : at + 4096 // k]
                    x = vectors[(first[some] - a)[:, None] + np.arange(k)]
                    near = np.einsum("gij,gkj->gik", x, x)[:, i, j].max(axis=1, initial=-1.0)
                    worth |= set(some[near > cosine - 1e-9].tolist())
            for g in sorted(worth):
                s = slice(first[g], first[g] + sizes[g])
                own = [np.asarray(x) for x in own_of.slice(s.start, sizes[g]).to_pylist()]
                two = what[g][2] != what[g][3]
                links, low = _met(nodes[s], copies[s], vectors[s.start - a : s.stop - a], own, int(what[g][1]), side[s] == int(what[g][2]) if two else None, cosine)
                told = (links > 0) | (low != nodes[s])
                out.append((nodes[s][told], links[told], low[told]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=names)

    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        cell = rest.column("cell")
        if cell[0].as_py() == cell[-1].as_py():
            continue
        code = cell.combine_chunks().dictionary_encode().indices.to_numpy()
        whole = int(np.flatnonzero(code != code[-1])[-1]) + 1
        yield from settled(rest.slice(0, whole))
        rest = rest.slice(whole)
    if rest is not None and rest.num_rows:
        yield from settled(rest)


def _usable(vector: Column, label: Column) -> Column:
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(label.isNotNull() & ~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """``id_col``, n_links, component_id and kept of every row: how many other rows its vector links with directly, the smallest id it reaches by links, itself
    included, and whether that is its own.

    Two vectors link if their labels are equal and not null, their lengths are equal, and their cosine is ``cosine`` or more. A null, empty or zero
    vector, one that holds null or a value that isn't finite, or a null label links with nothing and is kept. Equal vectors of one label are one until the end,
    however many they are; repeated rows count as rows. A null id counts as a link, but isn't an id to be reached; its row isn't kept. Other columns are
    ignored; no rows give no rows.

    Each distinct vector is decoded to all filters it passes. Filters that only one passes go; a vector then meets the others of its
    filters, exact cosines decide, and a pair counts in the first filter that both pass. A filter that very many pass is met in blocks of ``BLOCK``."""
    kind = rows.schema[id_col].dataType
    own = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"), F.col(f"`{vector_col}`").alias("vector"))
    own = own.withColumn("ok", _usable(F.col("vector"), F.col("label")))
    usable = own.filter("ok").select("id", "label", "vector", F.xxhash64("label", "vector").alias("h1"), F.xxhash64(F.lit(1), "vector", "label").alias("h2"))
    distinct = usable.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("many"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    distinct = written(distinct.withColumn("node", F.monotonically_increasing_id()).withColumn("length", F.size("vector")), "vectors")
    most = {r.length: r.n for r in distinct.groupBy("length", "label").count().groupBy("length").agg(F.max("count").alias("n")).collect()}  # a row for each length of vectors
    codes = {length: filters_for(length, n, cosine) for length, n in most.items()}

    def passed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("length").to_numpy()
            for length in np.unique(size).tolist():
                some = np.flatnonzero(size == length)
                for at in range(0, len(some), 256):
                    part = batch.take(pa.array(some[at : at + 256]))
                    row, number = decode(unit(_matrix(part.column("vector"), length)), codes[length])
                    row = pa.array(row)
                    yield pa.RecordBatch.from_arrays([part.column("length").take(row), part.column("label").take(row), pa.array(number), part.column("node").take(row)], names=["length", "label", "number", "node"])

    keys = ["length", "label", "number"]
    lists = written(distinct.select("length", "label", "vector", "node").mapInArrow(passed, "length int, label string, number long, node long"), "filters")
    counts = written(lists.groupBy(*keys).agg(F.count("*").alias("many")).filter("many > 1").withColumn("blocks", F.ceil(F.col("many") / BLOCK).cast("int")), "counts")
    total = counts.agg(F.sum("many")).first()[0] or 0
    shared = joined_by(lists, counts, total, *keys).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("number", "blocks"))).alias("at"))  # the filters of one vector
    meeting = shared.join(distinct.select("node", "length", "label", "vector", F.col("many").alias("copies")), "node")
    meeting = meeting.select("*", F.col("at.number").alias("own"), F.explode("at").alias("f")).withColumn("side", F.pmod(F.xxhash64("node"), F.col("f.blocks")).cast("int"))
    meeting = meeting.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("f.blocks") - 1)))
    cell = F.concat_ws("/", "length", "f.number", F.least("side", "other"), F.greatest("side", "other"), "label")
    dealt = meeting.select(cell.alias("cell"), "node", "copies", "vector", "own", "side").repartition("cell").sortWithinPartitions("cell", "node")
    met = written(dealt.mapInArrow(lambda batches: _compare(batches, cosine), "node long, links long, low long"), "links")

    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    tied = components(met.select(F.col("node").alias("a"), F.col("low").alias("b")))
    ids = distinct.select("node", "id", "h1", "h2", "many").join(tied, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = written(ids.join(links, "node", "left"), "nodes")
    least = written(ids.groupBy("component").agg(F.min("id").alias("component_id"), F.count("*").alias("many")), "components")
    n = distinct.count()
    known = joined_by(ids.withColumnRenamed("many", "copies"), least, n, "component")
    known = written(known.select("h1", "h2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id", F.col("copies").alias("many")), "known")
    found = joined_by(usable.select("id", "h1", "h2"), known, known.agg(F.sum("many")).first()[0] or 0, "h1", "h2").select("id", "n_links", "component_id")
    alone = own.filter("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = found.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", F.col("component_id").cast(kind).alias("component_id"), F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


ORACLE = """WITH RECURSIVE vectors AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
normed AS (SELECT *, sqrt(list_dot_product(v, v)) AS norm FROM vectors),
links AS (SELECT a.r AS a, b.r AS b FROM normed a JOIN normed b ON a.label = b.label AND len(a.v) = len(b.v) AND a.r <> b.r WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.93),
walk(r, seen) AS (SELECT r, r FROM vectors UNION SELECT links.b, walk.seen FROM walk JOIN links ON links.a = walk.r),
reached AS (SELECT walk.r, min(s.vec_id) AS component_id FROM walk JOIN vectors s ON s.r = walk.seen GROUP BY walk.r),
counted AS (SELECT v.r, v.vec_id, count(l.b) AS n_links FROM vectors v LEFT JOIN links l ON l.a = v.r GROUP BY ALL)
SELECT vec_id, n_links::BIGINT AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM counted JOIN reached USING (r)
UNION ALL SELECT vec_id, 0, vec_id, vec_id IS NOT NULL FROM embeddings
WHERE NOT coalesce(label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false)"""
