"""Documents whose sets of word shingles are similar: a size-aware heavy-light join, then components of the links."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonestudy.llm.components import components, joined_by
from zonestudy.llm.shared import dropped, release, slices, written
from zonestudy.llm.words import SPACES, mix, tokenize, windows

#: Two sets link when PERCENT hundredths of their union lie in both: 7 * common >= 3 * (sum of sizes).
PERCENT = 75
#: Entries of a list, or pairs of one set, that one task meets together: longer ones are salted.
LIST = 1024
#: Counts of shingles that are broadcast at most; the most frequent ones are, which no join has to deal out then.
FREQUENT = 1 << 18
#: Turns of comparisons with pivots at most; another one is worth while above so many open pairs for each entry of a list, and if
#: this share of the last one's comparisons were links.
TURNS, OPEN, WORTH = 8, 256, 0.05


def least_common(sizes: Column | int) -> Column | int:
    """The least overlap of two sets that link, by the sum of their sizes: (3 * sizes + 6) div 7."""
    return (3 * sizes + 6) // 7 if isinstance(sizes, int) else F.floor((3 * sizes + 6) / 7).cast("int")


def leading(n: int | np.ndarray) -> int | np.ndarray:
    """How many first shingles, in any one order, a set of size ``n`` has that it must share one of with a set that it links with."""
    return n - (3 * n + 3) // 4 + 1


@dataclass
class Sets:
    """Sets of shingle hashes: row ``i`` has ``hashes[first[i]:first[i+1]]``, ascending; ``half`` and ``more`` are 128 bits of the set."""

    hashes: np.ndarray
    first: np.ndarray
    half: np.ndarray
    more: np.ndarray

    def sizes(self) -> np.ndarray:
        return np.diff(self.first)


def shingle_sets(texts: pa.Array, n: int = 5) -> Sets:
    """The distinct ``n``-word shingles of whole texts; a text with fewer words has its whole sequence as one."""
    w = tokenize(texts, SPACES)
    hashes, at = windows(w.hash, w.doc, tuple(range(n)))
    parts, docs = [hashes], [w.doc[at]]
    counts = w.counts()
    first = np.cumsum(counts) - counts
    for k in range(1, n):
        short = np.flatnonzero(counts == k)
        if len(short):
            own = np.stack([w.hash[first[short] + i] for i in range(k)], axis=1).ravel()
            value, at = windows(own, np.repeat(np.arange(len(short)), k), tuple(range(k)))
            parts.append(value)
            docs.append(short[at // k])
    hashes, doc = np.concatenate(parts), np.concatenate(docs)
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    fresh = np.ones(len(hashes), dtype=bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[fresh], doc[fresh]
    first = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(texts)))])

    def sums(x: np.ndarray) -> np.ndarray:
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(x)])
        return mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64))

    return Sets(hashes, first, sums(mix(hashes ^ np.uint64(0x6A09E667F3BCC909))), sums(hashes))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), _signed(values))


#: One row for each document, or the tokens that a slice of documents sends to a part of all tokens, or places of the slice that had shared ones.
CHUNK = "part int, slice long, place int, doc_id long, text long, n int, half long, more long, rows binary, tokens binary"
#: Tokens of a part, about; and the row of a token whose sets in the slice are known to share it.
PART, CREDITED = 1 << 20, 65_535
#: Tokens that a task remembers to have sent.
TOLD = 1 << 20


class Told:
    """Tokens that a task has sent, ``TOLD`` at most: a slot for each, kept once its token was sent as one that several sets have."""

    def __init__(self, slots: int = TOLD) -> None:
        self.token = np.arange(1, slots + 1, dtype=np.uint64)  # none of these belongs in its slot
        self.shared = np.zeros(slots, dtype=bool)

    def meet(self, values: np.ndarray, several: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the distinct ``values`` of a slice another slice of the task has sent, and which need not be sent again; ``several`` of the slice's sets
        have them. A token goes at most once with a row and once more without while it is remembered."""
        slot = (values % np.uint64(len(self.token))).astype(np.int64)
        before = self.token[slot] == values
        enough = before & self.shared[slot]
        self.shared[slot[before]] = True
        free = ~before & ~self.shared[slot]
        self.token[slot[free]] = values[free]
        put = free & (self.token[slot] == values)
        self.shared[slot[put]] = several[put]
        return before, enough


def _binary(parts: list[bytes | None]) -> pa.Array:
    return pa.array(parts, pa.binary())


def _rows(part: list | np.ndarray, slice_: int | list, count: int, **columns: pa.Array | list) -> pa.RecordBatch:
    """A batch of ``CHUNK`` with ``count`` rows; columns not given are null."""
    kinds = {"part": pa.int32(), "slice": pa.int64(), "place": pa.int32(), "doc_id": pa.int64(), "text": pa.int64(), "n": pa.int32(), "half": pa.int64(), "more": pa.int64(), "rows": pa.binary(), "tokens": pa.binary()}
    columns |= {"part": part, "slice": [slice_] * count if isinstance(slice_, int) else slice_}
    return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(count, k) for c, k in kinds.items()], names=list(kinds))


def _passing(slice_: int, parts: int) -> int:
    """A part that holds no tokens, for the rows of a slice that only pass."""
    return parts + int(mix(np.array([slice_], dtype=np.uint64))[0] % np.uint64(4096))


def _sent(slice_: int, row: np.ndarray, tokens: np.ndarray, parts: int, told: Told) -> Iterator[pa.RecordBatch]:
    """Tokens of the slice's rows, by part; each once, with the row if it is the only one that is known to have it. The rows of others are credited here.

    What ``told`` remembers from earlier slices of the task is credited, too, and not sent a third time, so a token that every document has makes two
    entries for each task. A token is sent with its last 40 bits; the part has others. Two that look alike count as one, which lets more sets through, never
    fewer."""
    values, place, inverse, counts = np.unique(tokens, return_index=True, return_inverse=True, return_counts=True)
    before, enough = told.meet(values, counts > 1)
    shared = before | (counts > 1)
    known = shared[inverse]
    if known.any():
        yield _rows([_passing(slice_, parts)], slice_, 1, rows=[row[known].astype(np.uint16).tobytes()])
    values, own = values[~enough], np.where(shared, CREDITED, row[place])[~enough]
    part = ((values >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    there, begin = np.unique(part[order], return_index=True)
    own = own[order].astype(np.uint16)
    low = np.ascontiguousarray(values[order]).view(np.uint8).reshape(-1, 8)[:, :5]
    ends = [*begin[1:].tolist(), len(order)]
    if len(there):
        cut = [(a, b) for a, b in zip(begin.tolist(), ends, strict=True)]
        yield _rows(there, slice_, len(there), rows=_binary([own[a:b].tobytes() for a, b in cut]), tokens=_binary([low[a:b].tobytes() for a, b in cut]))


def _met(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by part: the rows whose tokens another slice has as well go back to their slice; all else passes."""
    held: list[tuple[int, pa.Buffer, pa.Buffer]] = []
    current = None

    def flush() -> Iterator[pa.RecordBatch]:
        lengths = [r.size // 2 for _, r, _ in held]
        wide = np.zeros((sum(lengths), 8), dtype=np.uint8)
        wide[:, :5] = np.frombuffer(b"".join(t for _, _, t in held), dtype=np.uint8).reshape(-1, 5)
        _, inverse, counts = np.unique(wide.view(np.uint64).ravel(), return_inverse=True, return_counts=True)
        rows = np.frombuffer(b"".join(r for _, r, _ in held), dtype=np.uint16)
        keep = (counts[inverse] > 1) & (rows != CREDITED)
        ends = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], np.cumsum(lengths)])]
        rows = rows[keep]
        back = [(held[k][0], rows[a:b].tobytes()) for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False)) if b > a]
        held.clear()
        yield _rows([current] * len(back), [x for x, _ in back], len(back), rows=_binary([x for _, x in back]))

    for batch in batches:
        rows, tokens = batch.column("rows"), batch.column("tokens")
        sends = tokens.is_valid()
        yield batch.filter(pa.compute.invert(sends))
        part, slice_ = batch.column("part").to_numpy(), batch.column("slice").to_numpy()
        for k in np.flatnonzero(sends.to_numpy(zero_copy_only=False)).tolist():
            if part[k] != current and held:
                yield from flush()
            current = int(part[k])
            held.append((int(slice_[k]), rows[k].as_buffer(), tokens[k].as_buffer()))
    if held:
        yield from flush()
    release()


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by slice: doc_id, text, n, half, more of each document, and ``shared``, how many of its tokens came back."""
    docs: list[pa.RecordBatch] = []
    hits: list[bytes] = []
    names, current = ["doc_id", "text", "n", "half", "more"], None

    def flush() -> pa.RecordBatch:
        own = pa.Table.from_batches(docs).combine_chunks() if docs else pa.table({c: pa.nulls(0, pa.int64()) for c in ("place", *names)})
        place = own.column("place").to_numpy()
        counts = np.bincount(np.frombuffer(b"".join(hits), dtype=np.uint16), minlength=1 + int(place.max(initial=0)))
        docs.clear()
        hits.clear()
        columns = [own.column(c).combine_chunks().cast(pa.int32() if c == "n" else pa.int64()) for c in names]
        return pa.RecordBatch.from_arrays([*columns, pa.array(counts[place], pa.int32())], names=[*names, "shared"])

    for batch in batches:
        slice_, rows = batch.column("slice").to_numpy(), batch.column("rows")
        ends = [*(np.flatnonzero(np.diff(slice_)) + 1).tolist(), len(slice_)] if len(slice_) else []
        for at, end in zip([0, *ends], ends, strict=False):
            if slice_[at] != current and (docs or hits):
                yield flush()
            current = slice_[at]
            own, sent = batch.slice(at, end - at), rows.slice(at, end - at)
            hits += [x.as_py() for x in sent.drop_null()]
            docs.append(own.filter(sent.is_null()).select(["place", *names]))
    if docs or hits:
        yield flush()
    release()


def _with_shared(chunks: DataFrame) -> DataFrame:
    """doc_id, text, n, half, more, shared, from the rows of ``CHUNK`` that slices of documents make."""
    met = chunks.repartition("part").sortWithinPartitions("part").mapInArrow(_met, CHUNK)
    by_slice = met.select("slice", "place", "doc_id", "text", "n", "half", "more", "rows").repartition("slice").sortWithinPartitions("slice")
    return by_slice.mapInArrow(_counted, "doc_id long, text long, n int, half long, more long, shared int")


def sampled(n: int | np.ndarray) -> int | np.ndarray:
    """How many first shingles in the order of hashes ``_memberships`` looks at: enough for two sets that link to have ``n // 4 + 1`` of
    them in common, by the size of the smaller one."""
    return leading(n) + n // 4


def _memberships(docs: DataFrame) -> DataFrame:
    """doc_id, text (its hash), n, half, more (the set) and ``shared`` of every document: how many of its set's first ``sampled`` shingles in the order of hashes
    are among those of other sets, or of copies in other tasks. Of equal sets in a task the first one counts.

    A slice sends each shingle once, in 7 bytes, to one of the parts of all shingles, which grow in number with the text; a shingle that very
    many documents have makes two entries for each task (see ``Told``)."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = 1 + size // (12 * PART)

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, told = np.zeros(0, dtype=np.uint64), Told()
        name = TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text"):
            s = shingle_sets(batch.column("text"))
            n = s.sizes()
            yield _rows([_passing(name, parts)] * len(n), name, len(n), place=np.arange(len(n)), doc_id=batch.column("doc_id"), text=batch.column("hash"), n=n, half=_signed(s.half), more=_signed(s.more))
            own, at = np.unique(s.half ^ mix(s.more), return_index=True)
            fresh = np.zeros(len(n), dtype=bool)
            fresh[at[~np.isin(own, seen, assume_unique=True)]] = True
            seen = np.union1d(seen, own)
            kept = np.where(fresh & (n > 2), sampled(n), 0)  # smaller sets link with equal ones only
            row = np.repeat(np.arange(len(n)), kept)
            yield from _sent(name, row, s.hashes[np.arange(len(row)) + (s.first[:-1] - np.cumsum(kept) + kept)[row]], parts, told)
            name += 1

    return _with_shared(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash")).mapInArrow(each, CHUNK))


def _three_quarters(sets: DataFrame) -> DataFrame:
    """The sets (node, n, held) three quarters of whose shingles other sets have; no other one links."""
    parts = 1 + (sets.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0) // PART

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, told = TaskContext.get().partitionId() << 32, Told()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                held, node = part.column("held"), part.column("node")
                n = np.diff(held.offsets.to_numpy())
                yield _rows([_passing(name, parts)] * len(n), name, len(n), place=np.arange(len(n)), doc_id=node, n=n, half=node, more=node)
                yield from _sent(name, np.repeat(np.arange(len(n)), n), held.flatten().to_numpy().view(np.uint64), parts, told)
                name += 1

    left = _with_shared(sets.select("node", "held").mapInArrow(each, CHUNK)).filter(4 * F.col("shared") >= 3 * F.col("n"))
    return sets.join(left.select(F.col("half").alias("node")), "node")


def _nodes(members: DataFrame) -> DataFrame:
    """node, half, more, n, doc_id (the smallest), many of every set. A node's number is the set's first 64 bits or, should
    another set have the same ones, a hash of all 128."""
    sets = members.groupBy("half", "more").agg(F.first("n").alias("n"), F.min("doc_id").alias("doc_id"), F.count("*").alias("many"))
    place = F.row_number().over(Window.partitionBy("half").orderBy("more"))
    return sets.withColumn("node", F.when(place == 1, F.col("half")).otherwise(F.xxhash64("half", "more")))


def _partnered(members: DataFrame) -> DataFrame:
    """half, more of the sets that share enough of their first shingles with others: two sets that link have ``m // 4 + 1`` of them in common, if m is
    the smaller size, and that is at least three quarters of the larger one."""
    smaller = F.ceil(3 * F.col("n") / 4)
    return members.filter((F.col("n") > 2) & (F.col("shared") >= F.floor(smaller / 4) + 1)).select("half", "more").distinct()


def _sets(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node, n, held (the set's hashes, ascending) of ``nodes``, made again from the text of one document that has the set; where
    only documents with a null doc_id have it, all of those are read, and joined by the set."""
    needed = written(nodes.select("node", "half", "more", "doc_id"), "needed")
    many, unnumbered = needed.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = own.join(F.broadcast(needed) if many <= 1 << 20 else needed, "doc_id")

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            s = shingle_sets(batch.column("text"))
            half, more = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("half", "more"))
            same = (s.half.view(np.int64) == half) & (s.more.view(np.int64) == more)
            n = s.sizes()
            held = _lists(s.hashes[np.repeat(same, n)], n[same])
            yield pa.RecordBatch.from_arrays([batch.column("node").filter(pa.array(same)), pa.array(n[same], pa.int32()), held], names=["node", "n", "held"])

    def every(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            s = shingle_sets(batch.column("text"))
            n = s.sizes()
            yield pa.RecordBatch.from_arrays([_signed(s.half), _signed(s.more), pa.array(n, pa.int32()), _lists(s.hashes, n)], names=["half", "more", "n", "held"])

    sets = texts.mapInArrow(each, "node long, n int, held array<long>")
    if unnumbered:
        others = own.filter("doc_id is null").select("text").mapInArrow(every, "half long, more long, n int, held array<long>")
        sets = sets.unionByName(others.join(needed.filter("doc_id is null").drop("doc_id"), ["half", "more"]).select("node", "n", "held"))
    return sets.dropDuplicates(["node"])


def _ranked(sets: DataFrame, counts: DataFrame) -> DataFrame:
    """node, n, shared: the shingles that other sets have too, with the number of sets, rarest first. A set links only if it has
    three quarters of its shingles from others, so the rest of the sets go."""
    rows = sets.select("node", "n", F.explode("held").alias("token"))
    frequent = F.broadcast(counts.filter(F.col("c") >= LIST).orderBy(F.desc("c"), "token").limit(FREQUENT))
    often = rows.join(frequent, "token")
    seldom = rows.join(frequent, "token", "left_anti").join(counts, "token")
    found = often.unionByName(seldom).groupBy("node").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("c", "token"))).alias("shared"))
    return found.filter(4 * F.size("shared") >= 3 * F.col("n"))


def boundary(sizes: dict[int, int], partners: float, largest: int = 64) -> int:
    """The set size up to which pairs of shingles are enumerated, by the least estimated cost over all sets.

    A set of size n costs one row for each pair of its first shingles, or one row for each of its first shingles and the
    ``partners`` found in that shingle's list; sets just below the boundary need both to meet the larger ones."""

    def scan(n: int) -> float:
        return leading(n) * (1 + partners)

    def cost(x: int) -> float:
        low = (3 * (x + 1) + 3) // 4
        return sum(c * ((min(n, leading(n) + 1) * (min(n, leading(n) + 1) - 1) / 2 if n <= x else 0) + (scan(n) if n >= low else 0)) for n, c in sizes.items() if n > 1)

    return min(range(largest + 1), key=cost)


def _postings(ranked: DataFrame, small: int) -> DataFrame:
    """key, salt, salts, node, n, pos: the lists. Sets up to ``small`` stand in those of pairs of their first shingles (pos of the second,
    less 1), larger ones and those that can link with them in those of their first shingles. Shingles of one set only come
    first in the order, then rarer ones before common ones. A long list is salted by the node, in ``salts`` parts."""
    low = (3 * (small + 1) + 3) // 4

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("shared")
            flat, r = held.flatten(), np.diff(held.offsets.to_numpy())
            count, token = flat.field("c").to_numpy(), flat.field("token").to_numpy().view(np.uint64)
            node, n = batch.column("node").to_numpy().view(np.uint64), batch.column("n").to_numpy()
            row = np.repeat(np.arange(len(r)), r)
            begin = np.cumsum(r) - r
            pos = (n - r - begin)[row] + np.arange(len(row))
            single = np.flatnonzero((pos < leading(n)[row]) & (n[row] >= low))
            parts = [(token[single], count[single], row[single], pos[single])]
            for i in np.flatnonzero(n <= small):
                k = min(r[i], leading(n[i]) + 1 - (n[i] - r[i]))
                if k < 2:
                    continue
                x, y = np.triu_indices(k, 1)
                own, often = token[begin[i] : begin[i] + k], count[begin[i] : begin[i] + k]
                pair = mix(np.minimum(own[x], own[y]) * np.uint64(3) + np.maximum(own[x], own[y]) * np.uint64(5) + np.uint64(1))
                parts.append((pair, np.minimum(often[x], often[y]), np.full(len(x), i), pos[begin[i]] + y - 1))
            key, often, row, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
            salts = 1 + often // LIST
            salt = (mix(node[row]) % salts.astype(np.uint64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [_signed(key), pa.array(salt), pa.array(salts, pa.int32()), _signed(node[row]), pa.array(n[row], pa.int32()), pa.array(pos, pa.int32())],
                names=["key", "salt", "salts", "node", "n", "pos"],
            )

    return ranked.mapInArrow(each, "key long, salt int, salts int, node long, n int, pos int")


def _can_link(a: str, b: str) -> Column:
    """Two entries of one list can link only so: sizes near enough, and both within the first shingles that this pair of sizes needs."""
    n, m, c = F.col(f"{a}.n"), F.col(f"{b}.n"), least_common(F.col(f"{a}.n") + F.col(f"{b}.n"))
    return (4 * n >= 3 * m) & (4 * m >= 3 * n) & (F.col(f"{a}.pos") <= n - c) & (F.col(f"{b}.pos") <= m - c)


def _by_list(keyed: DataFrame) -> DataFrame:
    """A row for each key, once for each salt of its list."""
    return keyed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")


def _star(lists: DataFrame, order: Column) -> DataFrame:
    """a, b: each entry of a list with the list's pivot, the first in ``order``, where the two are in different components and can link."""
    entry = F.struct(order.alias("o"), "node", "n", "pos", "component")
    pivots = lists.groupBy("key").agg(F.min(entry).alias("p"), F.max("salts").alias("salts"), F.count("*").alias("many")).filter("many > 1").drop("many")
    joined = lists.select("key", "salt", "component", F.struct("node", "n", "pos").alias("e")).join(_by_list(pivots), ["key", "salt"])
    joined = joined.filter(F.col("component") != F.col("p.component")).filter(_can_link("e", "p"))
    return joined.select(F.greatest("e.node", "p.node").alias("a"), F.least("e.node", "p.node").alias("b")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (a, b: nodes) whose sets link, compared shingle by shingle.

    Pairs are grouped by the end that more of them have, in parts of at most about ``LIST`` pairs; within a part that end's set comes
    first and the others stream past it."""
    total = pairs.count()
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("many"))
    both = joined_by(pairs, ends.select(F.col("node").alias("a"), F.col("many").alias("of_a"), "many"), total, "a")
    both = joined_by(both, ends.select(F.col("node").alias("b"), F.col("many").alias("of_b"), "many"), total, "b")
    head = F.when(F.col("of_a") > F.col("of_b"), F.col("a")).otherwise(F.col("b"))
    many = F.greatest("of_a", "of_b")
    routed = both.select(head.alias("head"), F.when(head == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("node"), F.ceil(many / LIST).cast("int").alias("parts"))
    routed = routed.withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int")).drop("parts")
    heads = routed.groupBy("head", "part").agg(F.lit(False).alias("member")).withColumn("node", F.col("head"))
    routes = routed.withColumn("member", F.lit(True)).unionByName(heads)

    def compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, pivot = None, np.zeros(0, dtype=np.uint64)
        for batch in batches:
            node, head, part, member = (batch.column(x).to_pylist() for x in ("node", "head", "part", "member"))
            held, found = batch.column("held"), []
            values, at = held.values.to_numpy().view(np.uint64), held.offsets.to_numpy()
            for i in range(batch.num_rows):
                own = values[at[i] : at[i + 1]]
                if not member[i]:
                    current, pivot = (head[i], part[i]), own.copy()
                elif current == (head[i], part[i]):
                    common = int((pivot[np.minimum(np.searchsorted(pivot, own), len(pivot) - 1)] == own).sum())
                    if 7 * common >= 3 * (len(own) + len(pivot)):
                        found.append((node[i], head[i]))
            yield pa.RecordBatch.from_arrays([pa.array([max(x) for x in found], pa.int64()), pa.array([min(x) for x in found], pa.int64())], names=["a", "b"])

    grouped = sets.select("node", "held").join(routes, "node").repartition("head", "part").sortWithinPartitions("head", "part", "member")
    return written(grouped.mapInArrow(compared, "a long, b long"), "links")


def _labelled(lists: DataFrame, reached: DataFrame) -> DataFrame:
    """The entries of the lists that aren't all in one component, with ``component`` and ``cross``, the pairs of a list's entries in different ones."""
    placed = lists.drop("component", "cross", "many").join(reached, "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = placed.groupBy("key", "component").agg(F.count("*").alias("c"), F.max("salts").alias("salts"))
    split = parts.groupBy("key").agg(F.count("*").alias("parts"), F.sum("c").alias("many"), F.sum(F.col("c") * F.col("c")).alias("own"), F.max("salts").alias("salts"))
    split = split.filter("parts > 1").select("key", "salts", ((F.col("many") * F.col("many") - F.col("own")) / 2).alias("cross"), "many")
    return written(placed.join(_by_list(split), ["key", "salt"]), "open")


def _reached(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """node, component of every node that links with another one.

    The entries of a list are compared with a pivot, the one with the fewest rare shingles before the list's own: what
    links with anything in a group of near copies mostly links with that. Only entries that this leaves in
    different components, and that can link, are then compared pair by pair, so a large group costs a few comparisons for each
    member. While very many such pairs are left and pivots find links, other pivots are taken first."""
    tested = written(_star(lists.withColumn("component", F.col("node")), F.col("pos") / F.col("n")), "stars")
    links = _verified(tested, sets)
    reached = components(links)
    left = _labelled(lists, reached)
    for turn in range(1, TURNS):
        pairs, entries = left.select("key", "cross", "many").distinct().agg(F.sum("cross"), F.sum("many")).first()
        if not pairs or pairs <= OPEN * entries:
            break
        sizes = left.groupBy("component").agg(F.count("*").alias("size")).withColumn("many", F.col("size"))
        sized = joined_by(left.drop("many"), sizes, left.count(), "component")
        asked = written(_star(sized, F.struct(-F.col("size"), F.xxhash64(F.lit(turn), "node"))).join(tested, ["a", "b"], "left_anti"), "stars")
        found = _verified(asked, sets)
        tested, links = tested.unionByName(asked), links.unionByName(found)
        reached = components(links)
        left = _labelled(left, reached)
        if found.count() < WORTH * asked.count():
            break
    # each part of a long list meets each part of it in a group by itself
    entries = left.select("key", "salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("other"), F.struct("node", "n", "pos").alias("e"), "component")
    l, r = entries.alias("l"), entries.alias("r")
    x, y = F.col("l.e.node"), F.col("r.e.node")
    same = (F.col("l.key") == F.col("r.key")) & (F.col("l.salt") == F.col("r.other")) & (F.col("l.other") == F.col("r.salt"))
    rest = (
        l.join(r, same & (F.col("l.component") < F.col("r.component")))
        .filter(_can_link("l.e", "r.e"))
        .select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
        .distinct()
        .join(tested, ["a", "b"], "left_anti")
    )
    found = _verified(written(rest, "rest"), sets)
    return components(links.unionByName(found)) if found.count() else reached


def join_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    Words are what lies between ASCII white space, A-Z lower-cased; sets hold the 64-bit hashes of 5-word shingles. Equal sets are
    one node. Sets that share too few of their first shingles, or fewer than three quarters of all, with
    other sets link with nothing and go first. Each node left stands in lists that two linked sets must share: up to
    a size chosen by cost those of pairs of its first shingles, above it those of single ones. Shingles are in the order of the number of
    sets that have them, so that shared passages make no long lists; long lists are salted. Links are
    verified on the whole sets, and no link between different sets that would connect more is lost (see ``_reached``).

    Null and empty texts have an empty set, and their own doc_id as component; so have documents without links. A null doc_id is
    ignored when the smallest of a component is sought; its text links as any other. Repeated rows stay. Other columns are ignored; no rows give no rows."""
    own = _placed(docs)
    return own.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("doc_id")).alias("component_id"))


def _placed(docs: DataFrame) -> DataFrame:
    """doc_id, text (its hash), n, root (the component's smallest doc_id) and first (the component's smallest set, by its 128 bits) of every document."""
    members = written(_memberships(docs), "members")
    nodes = written(_nodes(members), "nodes")
    some = written(_sets(nodes.join(_partnered(members), ["half", "more"]), docs), "some")
    sets = written(_three_quarters(some), "held")
    dropped(some)
    counts = written(sets.select(F.explode("held").alias("token")).groupBy("token").agg(F.count("*").cast("int").alias("c")).filter("c > 1"), "counts")
    ranked = written(_ranked(sets, counts), "ranked")
    sizes = {r.n: r["count"] for r in ranked.groupBy(F.least("n", F.lit(128)).alias("n")).count().collect()}  # 128 rows at most
    partners = (counts.agg(F.avg("c")).first()[0] or 1.0) - 1
    lists = written(_postings(ranked, boundary(sizes, partners)), "lists")
    reached = _reached(lists, sets)
    linked = written(nodes.join(reached, "node").select("node", "component", "doc_id", "half", "more"), "linked")
    roots = linked.groupBy("component").agg(F.min("doc_id").alias("root"), F.min(F.struct("half", "more")).alias("first"), F.count("*").alias("many"))
    rooted = joined_by(linked.select("node", "component"), roots, linked.count(), "component").select("node", "root", "first")
    named = nodes.join(rooted, "node", "left").select("half", "more", "n", "many", F.coalesce("root", "doc_id").alias("root"), (F.coalesce("first", F.struct("half", "more")) == F.struct("half", "more")).alias("first"))
    named = written(named, "roots")
    dropped(nodes, sets, counts, ranked, lists, linked)
    return joined_by(members.select("doc_id", "text", "half", "more"), named, named.agg(F.max("many")).first()[0] or 0, "half", "more")


def first_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component, with all its columns: the one with the smallest doc_id.

    What goes is named by doc_id and text, so of rows with one doc_id those go whose own text is in a component with a smaller one; rows with one
    doc_id in one component stay together. A row with a null doc_id goes where its component has a document with an id; where all of
    a component's ids are null, one row of one set stays. Documents without words are in no component and stay. What goes is
    broadcast while it is at most a million rows; more are joined by a shuffle."""
    placed = written(_placed(docs).filter("n > 0"), "placed")
    later = F.col("root").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") != F.col("root")))
    gone = placed.filter(later | (F.col("root").isNull() & ~F.col("first"))).select(F.col("doc_id").alias("gone_id"), F.col("text").alias("gone_text")).distinct()
    gone = written(gone, "gone")
    few = gone.count() <= 1 << 20
    out = docs.join(F.broadcast(gone) if few else gone, docs["doc_id"].cast("long").eqNullSafe(gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_text"]), "left_anti")
    if not placed.filter("doc_id is null and root is null").limit(1).count():
        return out
    # of rows without an id that nothing with an id resembles, one for each text; and one text for each set
    alone = written(placed.filter("doc_id is null and root is null and first").groupBy("half", "more").agg(F.min("text").alias("kept_text")), "alone")
    texts = written(placed.filter("doc_id is null and root is null").select("text").distinct(), "texts")
    id_, hashed = out["doc_id"], F.xxhash64(out["text"])
    rest = out.join(texts, id_.isNull() & (hashed == texts["text"]), "left_anti")
    first = out.filter(id_.isNull()).join(alone, hashed == alone["kept_text"], "left_semi")
    return rest.unionByName(first.dropDuplicates(["text"]))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 OR ws IS NULL THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END) AS sh
  FROM w
), n AS (
  SELECT d.doc_id, coalesce(c, 0) AS n FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id) USING (doc_id)
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
  SELECT x, y FROM p JOIN n na ON na.doc_id = x JOIN n nb ON nb.doc_id = y WHERE 100 * i >= 75 * (na.n + nb.n - i)
), r AS (
  WITH RECURSIVE walk(doc_id, seen) AS (
    SELECT doc_id, doc_id FROM n
    UNION
    SELECT walk.doc_id, CASE WHEN e.x = walk.seen THEN e.y ELSE e.x END FROM walk JOIN e ON e.x = walk.seen OR e.y = walk.seen
  ) SELECT doc_id, min(seen) AS component_id FROM walk GROUP BY doc_id
)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, r.component_id FROM n JOIN r USING (doc_id)
"""
