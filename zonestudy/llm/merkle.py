"""A manifest of a table as a tree of digests, with a proof for each row: time-forward processing up the trees and back down."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonestudy.llm.crc import crc32_sql
from zonestudy.llm.shared import dropped, written

#: Consecutive nodes that become one.
RUN = 16
#: Messages that one task of a later sweep takes, some MB.
MESSAGES = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def row_digest(*fields: Column) -> Column:
    """SHA-256 (binary) of a row's fields, each ``-`` if null, else its UTF-8 length, ``:`` and its text."""
    texts = [f.cast("string") for f in fields]
    parts = [F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def numbered(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """``rows``, written, with ``pos`` (place in its tree, from 0), ``n`` (rows of the tree) and ``task``: runs of neighbours, cut by a range
    partitioning on tree and order. A tree of any size spreads over many tasks; its totals for each task are what is summed over a tree."""
    kept = written(rows.repartitionByRange(tree, *order).withColumn("task", F.spark_partition_id()), "leaves")
    totals = kept.groupBy(tree, "task").agg(F.count("*").alias("own"))
    whole = Window.partitionBy(tree)
    starts = totals.select(
        tree,
        "task",
        F.coalesce(F.sum("own").over(whole.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("own").over(whole).alias("n"),
    )
    within = Window.partitionBy("task", tree).orderBy(*order)
    placed = kept.withColumn("rank", F.row_number().over(within) - 1).join(starts, [tree, "task"])
    out = written(placed.withColumn("pos", F.col("rank") + F.col("before")).drop("rank", "before"), "numbered")
    dropped(kept)
    return out


def _count(n: int, level: int) -> int:
    """Nodes of a level in a tree of ``n`` leaves."""
    return -(-n // RUN**level)


def _label(n: int, level: int, idx: int) -> tuple[int, int]:
    """When a node's turn comes: after the last leaf below it, children before parents."""
    return min((idx + 1) * RUN**level, n) - 1, level


_NODE = "tree string, n long, level int, idx long, home long, digest binary, children binary, homes array<long>"


class _Up:
    """One task's sweep: nodes come in the order of their labels; a queue holds their digests until their parent's turn.

    A parent all of whose children have sent gets its digest and sends on; where some are another task's, what is there is passed on as it came."""

    def __init__(self, home: int) -> None:
        self.home, self.tree, self.n, self.queue, self.out = home, None, 0, [], []

    def take(self, tree: str, n: int, level: int, idx: int, home: int, digest: bytes) -> None:
        if tree != self.tree:
            self.settle(None)
            self.tree, self.n = tree, n
        self.settle(_label(n, level, idx))
        self.send(level, idx, home, digest)

    def send(self, level: int, idx: int, home: int, digest: bytes) -> None:
        if _count(self.n, level) == 1:
            self.out.append((self.tree, self.n, level, idx, home, digest, None, None))  # the root of its tree
        else:
            heappush(self.queue, (*_label(self.n, level + 1, idx // RUN), idx, home, digest))

    def settle(self, until: tuple[int, int] | None) -> None:
        queue = self.queue
        while queue and (until is None or queue[0][:2] < until):
            label, got = queue[0][:2], []
            while queue and queue[0][:2] == label:
                got.append(heappop(queue)[2:])
            level, run = label[1], got[0][0] // RUN
            if len(got) < min(RUN, _count(self.n, level - 1) - RUN * run):
                self.out += [(self.tree, self.n, level - 1, i, home, d, None, None) for i, home, d in got]
                continue
            digest = sha256("".join(d.hex() for _, _, d in got).encode()).digest()
            self.out.append((self.tree, self.n, level, run, self.home, None, b"".join(d for _, _, d in got), [h for _, h, _ in got]))
            self.send(level, run, self.home, digest)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_NODE_ARROW = pa.schema(
    [("tree", pa.string()), ("n", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("home", pa.int64()), ("digest", pa.binary()), ("children", pa.binary()), ("homes", pa.list_(pa.int64()))]
)


def _sweep_up(nodes: DataFrame, sweep: int) -> DataFrame:
    """Nodes (task, tree, n, level, idx, home, digest) after one sweep: runs (with ``children``), roots of trees, and what waits for another task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: _Up | None = None
        for batch in batches:
            c = batch.to_pydict()
            for task, *node in zip(c["task"], c["tree"], c["n"], c["level"], c["idx"], c["home"], c["digest"], strict=True):
                if up is None or up.home != sweep << 32 | task:
                    if up:
                        up.settle(None)
                        yield _batch(up.out, _NODE_ARROW)
                    up = _Up(sweep << 32 | task)
                up.take(*node)
            if up and up.out:
                yield _batch(up.out, _NODE_ARROW)
                up.out = []
        if up:
            up.settle(None)
            yield _batch(up.out, _NODE_ARROW)

    label = F.least((F.col("idx") + 1) * F.expr(f"cast(power({RUN}, level) as long)"), F.col("n"))
    dealt = nodes.repartition("task").sortWithinPartitions("task", "tree", label, "level")
    return dealt.select("task", "tree", "n", "level", "idx", "home", "digest").mapInArrow(run, _NODE)


def build_up(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The runs of each sweep, first to last, and the roots (tree, n, level, idx, home, digest) of trees given as leaves (task, tree, n, pos, digest).

    The first sweep takes the leaves as ``numbered`` cut them. A cut leaves some parents' children on two sides: those wait, at most 15 a
    level and side, and are what the next sweep takes, a few tasks for thousands; three sweeps serve any table."""
    runs, roots = [], None
    nodes = leaves.select("task", "tree", "n", F.lit(0).alias("level"), F.col("pos").alias("idx"), (F.col("task").cast("long") + (1 << 32)).alias("home"), "digest")
    while True:
        out = written(_sweep_up(nodes, len(runs) + 1), "runs")
        runs.append(out.filter("children is not null"))
        rest = out.filter("children is null")
        tops = F.col("n") <= F.expr(f"cast(power({RUN}, level) as long)")
        roots = rest.filter(tops) if roots is None else roots.unionByName(rest.filter(tops))
        rest = rest.filter(~tops)
        waiting = rest.count()
        if not waiting:
            return runs, roots.drop("children", "homes")
        parts = -(-waiting // MESSAGES)
        last = F.least((F.col("idx") + 1) * F.expr(f"cast(power({RUN}, level) as long)"), F.col("n"))
        dealt = rest.repartitionByRange(parts, "tree", last, "level") if parts > 1 else rest.coalesce(1)
        nodes = written(dealt.withColumn("task", F.spark_partition_id()), "waiting")


_MESSAGE_ARROW = pa.schema([("home", pa.int64()), ("tree", pa.string()), ("n", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("path", pa.binary())])
_MESSAGE = "home long, tree string, n long, level int, idx long, path binary"


class _Down:
    """One task's sweep backwards: parents before children; a queue holds each node's path until its turn.

    A path is, for each level from the node up, its place in its run, the run's length and digests; at the end what the root was given."""

    def __init__(self, home: int) -> None:
        self.home, self.queue, self.out = home, [], []

    def take(self, tree: str, n: int, level: int, idx: int, path: bytes | None, children: bytes | None, homes: list[int] | None) -> bytes | None:
        """Keeps a message; for a run sends its children theirs; for a leaf returns its path."""
        last, _ = _label(n, level, idx)
        if path is not None:
            heappush(self.queue, (-last, -level, idx, path[:1], path[1:]))
            return None
        *at, place, tail = heappop(self.queue)
        if at != [-last, -level, idx]:
            raise RuntimeError(f"no path came to node {level}, {idx} of tree {tree!r}")
        path = place + tail
        if children is None:
            return path
        k = len(children) // 32
        tail = bytes([k]) + children + path  # shared by all children
        for place, home in enumerate(homes):
            child = level - 1, RUN * idx + place
            if home == self.home:
                last, _ = _label(n, *child)
                heappush(self.queue, (-last, -child[0], child[1], bytes([place]), tail))
            else:
                self.out.append((home, tree, n, *child, bytes([place]) + tail))
        return None


def _fold(leaf: bytes, path: bytes, rest: int) -> tuple[str, list[bytes]]:
    """The root (hex) that ``leaf`` and the digests along its path give, and those digests, hex. The path's last ``rest`` bytes aren't of it."""
    at, digest, siblings = 0, leaf.hex().encode(), []
    while at < len(path) - rest:
        place, k = path[at], path[at + 1]
        run = [path[x : x + 32].hex().encode() for x in range(at + 2, at + 2 + 32 * k, 32)]
        digest = sha256(b"".join([*run[:place], digest, *run[place + 1 :]])).hexdigest().encode()
        siblings += run[:place] + run[place + 1 :]
        at += 2 + 32 * k
    return digest.decode(), siblings


def _sweep_down(runs: DataFrame, messages: DataFrame, leaves: DataFrame | None, sweep: int, leaf_rows: str, leaf_of) -> DataFrame:
    """Messages to other tasks and, where the leaves are here, ``leaf_rows``: what ``leaf_of`` makes of a leaf's columns and its path."""
    none = F.lit(None)
    rows = messages.filter(F.shiftright("home", 32) == sweep).select("home", "tree", "n", "level", "idx", "path", none.cast("binary").alias("children"), none.cast("array<long>").alias("homes"), F.lit("").cast("binary").alias("leaf"))
    rows = rows.unionByName(runs.select("home", "tree", "n", "level", "idx", none.cast("binary").alias("path"), "children", "homes", F.lit("").cast("binary").alias("leaf")))
    extra = []
    if leaves is not None:
        extra = [c for c in leaves.columns if c not in ("task", "tree", "n", "pos", "digest")]
        own = leaves.select((F.col("task").cast("long") + (1 << 32)).alias("home"), "tree", "n", F.lit(0).alias("level"), F.col("pos").alias("idx"), none.cast("binary").alias("path"), none.cast("binary").alias("children"), none.cast("array<long>").alias("homes"), F.col("digest").alias("leaf"), *extra)
        rows = own.unionByName(rows, allowMissingColumns=True)
    names = [f"`{c}`" for c in ("home", "tree", "n", "level", "idx", "path", "children", "homes", "leaf", *extra)]
    schema = f"{_MESSAGE}{', ' if leaf_rows else ''}{leaf_rows}"
    arrow = pa.schema([*_MESSAGE_ARROW, *_arrow_of(leaf_rows)])
    width = len(arrow) - len(_MESSAGE_ARROW)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        down, found = None, []
        for batch in batches:
            for home, tree, n, level, idx, path, children, homes, leaf, *more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if down is None or down.home != home:
                    found += down.out if down else []
                    down = _Down(home)
                path = down.take(tree, n, level, idx, path, children, homes)
                if path is not None:
                    found.append((None,) * 6 + leaf_of(leaf, path, *more))
                if len(found) + len(down.out) >= 2000:
                    yield _batch([x + (None,) * (6 + width - len(x)) for x in found + down.out], arrow)
                    found, down.out = [], []
        found += down.out if down else []
        if found:
            yield _batch([x + (None,) * (6 + width - len(x)) for x in found], arrow)

    last = F.least((F.col("idx") + 1) * F.expr(f"cast(power({RUN}, level) as long)"), F.col("n"))
    dealt = rows.repartition("home").sortWithinPartitions("home", F.desc("tree"), F.desc(last), F.desc("level"), F.col("path").isNull())
    return dealt.select(*names).mapInArrow(run, schema)


def _arrow_of(columns: str) -> list[pa.Field]:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    return [pa.field(c.split()[0], kinds[c.split()[1]]) for c in columns.split(", ") if c]


def send_down(runs: list[DataFrame], leaves: DataFrame, given: DataFrame, leaf_rows: str, leaf_of) -> DataFrame:
    """``leaf_rows`` of every leaf: ``leaf_of(digest, path, *other columns of leaves)``. ``given``: a message (home, tree, n, level, idx, path) for each root.

    The sweeps of ``build_up`` backwards: each task takes the runs that it made then, so most paths go from parent to child within it; those to
    other tasks are the messages that the earlier sweeps' tasks start with."""
    messages = given
    for sweep in range(len(runs), 1, -1):
        sent = written(_sweep_down(runs[sweep - 1], messages, None, sweep, "", None), "paths")
        messages = messages.unionByName(sent)
    out = _sweep_down(runs[0], messages, leaves, 1, leaf_rows, leaf_of)
    return out.filter("home is null").select(*[c.split()[0] for c in leaf_rows.split(", ")])


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), forged: dict[str, Column] | None = None) -> DataFrame:
    """Each row's leaf, its group's subroot, the root, the digest of its proof, and whether the row, with ``forged`` in place of some of its fields, still
    folds to the root: ``id_col``, leaf, subroot, root, proof_sha256, folded_root, verified.

    In a group leaves ascend by id (nulls first, equal ids by leaf, so that repeated rows are interchangeable) and every 16 neighbours become one
    node until one is left; the groups' roots, null first, then bytewise, likewise. Null and empty texts are values like others. A single leaf is its
    group's subroot, one group's subroot the root; a proof without siblings is the digest of nothing. No rows give no rows. Other
    columns are ignored.

    Labels put each node behind the leaves below it. A task goes through a stretch of labels with a queue of digests sent to parents; Spark's sorted
    exchange is the queue between tasks, which spills to disk. Going back, paths come down from the root in the reverse order."""
    own = {f: F.col(f"`{f}`") for f in fields}
    changed = own | (forged or {})
    group = F.when(F.col(f"`{group_col}`").isNull(), "").otherwise(F.concat(F.lit("+"), F.col(f"`{group_col}`").cast("string")))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), group.alias("tree"), row_digest(*own.values()).alias("digest"), row_digest(*changed.values()).alias("forged"))
    leaves = numbered(written(rows, "digests"), "tree", "doc", "digest")  # dealing rows out reads them twice: digests, not texts
    runs, roots = build_up(leaves)
    roots = written(roots, "roots")
    groups = numbered(roots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), "digest", F.struct(*[F.col(c) for c in ("home", "tree", "n", "level", "idx")]).alias("at")), "tree", "group")
    top_runs, top = build_up(groups)
    top = top.select("home", "tree", "n", "level", "idx", F.col("digest").alias("path"))

    paths = send_down(top_runs, groups.select("task", "tree", "n", "pos", "digest", "group"), top, "group string, way binary", _to_group)
    given = written(paths.join(groups.select("group", "at"), "group").select("at.*", F.col("way").alias("path")), "given")
    kind = docs.schema[id_col].dataType.simpleString()
    out = send_down(runs, leaves.select("task", "tree", "n", "pos", "digest", F.col("doc").cast("string").alias("doc"), "forged"), given, _LEAF, _to_leaf)
    return out.select(F.col("doc").cast(kind).alias(id_col), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_LEAF = "doc string, leaf string, subroot string, root string, proof_sha256 string, folded_root string"


def _to_group(digest: bytes, path: bytes, group: str) -> tuple[str, bytes]:
    """A group's path to the root, with its subroot between path and root at the end."""
    return group, path[:-32] + digest + path[-32:]


def _to_leaf(digest: bytes, path: bytes, doc: str, forged: bytes) -> tuple:
    folded, siblings = _fold(forged, path, 64)
    return doc, digest.hex(), path[-64:-32].hex(), path[-32:].hex(), sha256(b"".join(siblings)).hexdigest(), folded


def manifest_documents(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs``; the rows for which 5 divides the CRC-32 of their decimal doc_id are verified with A-Z in their text lower-cased."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return manifest(docs, forged={"text": F.when(hit, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))})


def _oracle(levels: int = 6) -> str:
    """SQL for trees of at most 16 ** ``levels`` leaves."""
    field = lambda f: f"CASE WHEN {f} IS NULL THEN '-' ELSE octet_length(encode({f}::VARCHAR)) || ':' || {f}::VARCHAR END"
    plain = " || ".join(field(f) for f in ("doc_id", "source", "lang", "n_chars", "text"))
    forged = " || ".join([*(field(f) for f in ("doc_id", "source", "lang", "n_chars")), field("changed")])

    def tree(name: str, leaves: str) -> str:
        """Levels, runs and, for each leaf, siblings and what the forged leaf folds to; ``leaves``: tree, pos, digest, forged."""
        parts = [f"{name}0 AS (SELECT tree, pos AS idx, digest, count(*) OVER (PARTITION BY tree) AS n FROM {leaves})"]
        for k in range(levels):
            parts.append(f"{name}r{k} AS (SELECT tree, idx // 16 AS run, list(digest ORDER BY idx) AS ds FROM {name}{k} WHERE n > 1 GROUP BY ALL)")
            parts.append(f"{name}{k + 1} AS (SELECT tree, run AS idx, sha256(array_to_string(ds, '')) AS digest, count(*) OVER (PARTITION BY tree) AS n FROM {name}r{k})")
        folds, joins = ["l.forged AS f0"], []
        for k in range(levels):
            at = f"((l.pos // {16**k}) % 16)"
            left, right = f"array_to_string(r{k}.ds[1:{at}], '')", f"array_to_string(r{k}.ds[{at} + 2:], '')"
            folds += [f"CASE WHEN r{k}.ds IS NULL THEN '' ELSE {left} || {right} END AS s{k}", f"CASE WHEN r{k}.ds IS NULL THEN f{k} ELSE sha256({left} || f{k} || {right}) END AS f{k + 1}"]
            joins.append(f"LEFT JOIN {name}r{k} r{k} ON r{k}.tree = l.tree AND r{k}.run = l.pos // {16 ** (k + 1)}")
        sides = " || ".join(f"s{k}" for k in range(levels))
        parts.append(f"{name}p AS (SELECT l.*, {', '.join(folds)}, {sides} AS sides, f{levels} AS folded FROM {leaves} l {' '.join(joins)})")
        tops = " UNION ALL ".join(f"SELECT tree, digest FROM {name}{k} WHERE n = 1" for k in range(levels + 1))
        parts.append(f"{name}t AS ({tops})")
        return ",\n".join(parts)

    # a group's path in the upper tree starts from what its forged leaf folds to, so the upper tree is folded for each row
    upper = []
    for k in range(levels):
        at = f"((g.pos // {16**k}) % 16)"
        left, right = f"array_to_string(u{k}.ds[1:{at}], '')", f"array_to_string(u{k}.ds[{at} + 2:], '')"
        upper.append(f"CASE WHEN u{k}.ds IS NULL THEN h{k} ELSE sha256({left} || h{k} || {right}) END AS h{k + 1}")
    joins = " ".join(f"LEFT JOIN gr{k} u{k} ON u{k}.run = g.pos // {16 ** (k + 1)}" for k in range(levels))
    return f"""WITH {crc32_sql("(SELECT DISTINCT doc_id AS id FROM documents)")},
rows AS (SELECT d.*, CASE WHEN h % 5 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END AS changed FROM documents d LEFT JOIN crcs ON crcs.id = d.doc_id),
digests AS (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '+' || source END AS tree, sha256({plain}) AS digest, sha256({forged}) AS forged FROM rows),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos FROM digests),
{tree("d", "leaves")},
groups AS (SELECT '' AS tree, tree AS source, digest, digest AS forged, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos FROM dt),
{tree("g", "groups")}
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM (
SELECT l.doc_id, l.digest AS leaf, g.digest AS subroot, t.digest AS root, sha256(l.sides || g.sides) AS proof_sha256,
l.folded AS h0, {", ".join(upper)}, h{levels} AS folded_root
FROM dp l JOIN gp g ON g.source = l.tree CROSS JOIN gt t {joins})"""


ORACLE = _oracle()
