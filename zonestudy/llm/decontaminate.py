"""Benchmark passages in training documents, found through spaced seeds and verified with substitutions allowed."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonestudy.llm.components import joined_by, salted_join
from zonestudy.llm.shared import slices, written
from zonestudy.llm.words import PUNCTUATION, mix, tokenize, windows

#: Word positions that a seed looks at; those between are free to differ.
MASKS = ((0, 1, 2, 4, 6), (0, 2, 3, 6, 8), (0, 1, 4, 5, 9), (0, 3, 5, 6, 7), (0, 1, 3, 7, 8))
SHORTEST = 5
#: Bits of the filter that windows of documents pass before the join.
FILTER_BITS = 1 << 26


def wanted(n: int, min_words: int) -> int:
    """The equal words that an overlap with an item of ``n`` words needs."""
    return min(min_words, -(-n * 3 // 4))


def short_masks(n: int, equal: int) -> set[tuple[int, ...]]:
    """Positions in an item of ``n`` words, one set of which at least is all equal if ``equal`` words are: the words are dealt to a few
    groups more than words may differ, and every choice of groups that can be left out is."""
    apart = n - equal
    groups = np.array_split(np.arange(n), n if apart < 2 else min(n, apart + 2))
    return {tuple(int(i) for g in kept for i in g) for kept in combinations(groups, len(groups) - apart)}


def masks_for(lengths: Iterable[int], min_words: int, masks: tuple[tuple[int, ...], ...] = MASKS) -> list[tuple[int, ...]]:
    """The masks that items of these lengths are sought by: ``masks``, and own ones for items shorter than those span."""
    span = max(m[-1] for m in masks) + 1
    own = {tuple(i - m[0] for i in m) for n in lengths if SHORTEST <= n < span for m in short_masks(n, wanted(n, min_words))}
    return sorted({*own, *(masks if any(n >= span for n in lengths) else ())})


def item_seeds(words: np.ndarray, min_words: int, masks: tuple[tuple[int, ...], ...] = MASKS) -> tuple[np.ndarray, np.ndarray]:
    """The seed hashes of an item and the word that each window begins with. An item with fewer words than a mask spans gets masks of
    its own (see ``short_masks``); one of fewer than ``SHORTEST`` words gets none."""
    n, found = len(words), [(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))]
    if n >= max(m[-1] for m in masks) + 1:
        for mask in masks:
            found.append(seeds(words, np.zeros(n, dtype=np.int64), mask))
    elif n >= SHORTEST:
        for own in sorted(short_masks(n, wanted(n, min_words))):
            part = words[own[0] : own[-1] + 1]  # the words before its first one may lie outside a document
            hashes, at = seeds(part, np.zeros(len(part), dtype=np.int64), tuple(i - own[0] for i in own))
            found.append((hashes, at + own[0]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def seeds(words: np.ndarray, doc: np.ndarray, mask: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words at the positions of ``mask``, which they depend on, of every window, and each window's first word."""
    hashes, at = windows(words, doc, mask)
    return mix(hashes + np.uint64(sum(1 << i for i in mask))), at


def best_run(same: np.ndarray, min_identity: float) -> tuple[int, int]:
    """The run with the most equal words, the shortest of those, of which ``min_identity`` are equal; none: (0, 0)."""
    equal = np.concatenate([[0], np.cumsum(same)])
    over = equal - min_identity * np.arange(len(equal))
    # a run from s to e has the identity where over[e] >= over[s]; the first such s has the most equal words
    low = np.minimum.accumulate(over)
    first = np.searchsorted(-low, -over - 1e-9, "left")
    count = equal - equal[first]
    if not count.max():
        return 0, 0
    ends, at = np.flatnonzero(count == count.max()), np.flatnonzero(same)
    start, stop = at[equal[first[ends]]], at[equal[ends] - 1] + 1
    best = int(np.argmin(stop - start))
    return int(start[best]), int(stop[best])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _items(benchmark: DataFrame) -> DataFrame:
    """item, item_id (the smallest), n_items and words of every distinct sequence of words in ``benchmark``."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            w = tokenize(batch.column("text"), PUNCTUATION)
            words = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(w.counts())]), pa.int32()), _signed(w.hash))
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), words], names=["item_id", "words"])

    words = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(each, "item_id long, words array<long>")
    same = words.filter(F.size("words") >= SHORTEST).groupBy("words").agg(F.min("item_id").alias("item_id"), F.count("*").alias("n_items"))
    return written(same.withColumn("item", F.monotonically_increasing_id()), "items")


def _item_seeds(items: DataFrame, min_words: int) -> DataFrame:
    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, words in zip(batch.column("item").to_pylist(), batch.column("words"), strict=True):
                hashes, at = item_seeds(words.values.to_numpy().view(np.uint64), min_words)
                yield pa.RecordBatch.from_arrays([_signed(hashes), pa.array(np.full(len(at), item)), pa.array(at, pa.int32())], names=["seed", "item", "place"])

    return items.select("item", "words").mapInArrow(each, "seed long, item long, place int")


def _passes(seed: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Places of the seeds both of whose bits the filter has."""

    def has(x: np.ndarray) -> np.ndarray:
        bit = x & np.uint64(FILTER_BITS - 1)
        return (held[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) > 0

    maybe = np.flatnonzero(has(seed))
    return maybe[has(seed[maybe] >> np.uint64(32))]


def _filter(found: DataFrame) -> np.ndarray:
    """A filter of ``FILTER_BITS`` bits, 64 in a word, with two bits for each seed; its words are or-ed by Spark, so at most 2**20 rows
    (16 MB) come to the driver, however many seeds there are. With very many it lets more windows through and changes no result."""
    mask = F.lit(FILTER_BITS - 1).cast("long")
    bits = found.select(F.explode(F.array(F.col("seed").bitwiseAND(mask), F.shiftrightunsigned("seed", 32).bitwiseAND(mask))).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("held")).toPandas()
    out = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    out[words["at"].to_numpy(dtype=np.int64)] = words["held"].to_numpy(dtype=np.int64)
    return out.view(np.uint64)


def _candidates(docs: DataFrame, masks: list[tuple[int, ...]], present: Broadcast) -> DataFrame:
    """doc_id, text and hits (seed and first word of the window) of the documents with windows that pass the filter."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = present.value
        for batch in slices(batches, "text"):
            w = tokenize(batch.column("text"), PUNCTUATION)
            first = np.cumsum(w.counts()) - w.counts()
            found = [(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))]
            for mask in masks:
                own, at = seeds(w.hash, w.doc, mask)
                maybe = _passes(own, held)
                found.append((own[maybe], at[maybe]))
            seed, at = (np.concatenate(x) for x in zip(*found, strict=True))
            row = w.doc[at]
            order = np.argsort(row, kind="stable")
            rows, counts = np.unique(row, return_counts=True)
            hit = pa.StructArray.from_arrays([_signed(seed[order]), pa.array((at - first[row])[order], pa.int32())], names=["seed", "at"])
            hits = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), hit)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)), batch.column("text").take(pa.array(rows)), hits], names=["doc_id", "text", "hits"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, text string, hits array<struct<seed: long, at: int>>")


def find_overlaps(docs: DataFrame, benchmark: DataFrame, min_words: int = 12, min_identity: float = 0.75) -> DataFrame:
    """doc_id, item_id, n_items, equal_words, run_words, item_words, start_byte, end_byte, text_hash: the best run of each document and item
    that overlap, if any.

    Words are runs of letters and digits, A-Z lower-cased. Items with the same words are one, named by the smallest item_id, and
    ``n_items`` tells how many there are. The hashes of the words that a mask leaves of every window are joined, test with
    training; windows of documents that no item can have are left out before by a filter. From a hit the two texts are laid over each
    other; of the runs of which ``min_identity`` of the words are equal
    the one with the most equal words is kept if it has ``min_words`` equal ones (of a shorter item three quarters). Hits of items
    under ten words are complete; of longer ones the masks can miss some.

    Seeds that very many windows have are salted. Only documents with hits are written and joined; their texts meet their items' words in one stream for each document. Null and
    empty texts overlap nothing, items under five words are not looked for, repeated rows
    are judged one by one, and an empty table gives no rows. Other columns are ignored."""
    spark = docs.sparkSession
    items = _items(benchmark)
    found = written(_item_seeds(items, min_words), "seeds")
    lengths = [r[0] for r in items.select(F.least(F.size("words"), F.lit(64))).distinct().collect()]  # 60 at most
    present = spark.sparkContext.broadcast(_filter(found))
    candidates = written(_candidates(docs, masks_for(lengths, min_words), present).withColumn("row", F.monotonically_increasing_id()), "candidates")
    hits = candidates.select("row", F.explode("hits").alias("hit")).select("row", "hit.seed", "hit.at")
    n_hits = candidates.agg(F.sum(F.size("hits").cast("long"))).first()[0] or 0
    pairs = salted_join(hits, found, n_hits, "seed").groupBy("row", "item").agg(F.collect_set(F.col("at") - F.col("place")).alias("shifts"))
    pairs = written(pairs, "pairs")
    total = pairs.count()
    held = pairs.groupBy("item").agg(F.count("*").alias("many")).join(items, "item")
    asked = joined_by(pairs, held, total, "item").select("row", "item_id", "n_items", "words", "shifts")
    heads = candidates.join(pairs.select("row").distinct(), "row", "left_semi").select("row", "doc_id", "text", F.xxhash64("text").alias("text_hash"))
    both = heads.unionByName(asked.withColumn("there", F.lit(True)), allowMissingColumns=True)
    both = both.repartition("row").sortWithinPartitions("row", F.col("there").isNotNull())
    schema = "doc_id long, item_id long, n_items long, equal_words int, run_words int, item_words int, start_byte long, end_byte long, text_hash long"

    def judged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, w, name = None, None, None
        for batch in batches:
            rows = []
            ids, texts, there = batch.column("doc_id"), batch.column("text"), batch.column("there").is_null().to_pylist()
            items, many, words, shifts = (batch.column(c) for c in ("item_id", "n_items", "words", "shifts"))
            for i, head in enumerate(there):
                if head:
                    doc, w = ids[i].as_py(), tokenize(texts.slice(i, 1), PUNCTUATION)
                    name = batch.column("text_hash")[i].as_py()
                    continue
                own, best = words[i].values.to_numpy().view(np.uint64), None
                for shift in shifts[i].as_py():
                    a, b = max(shift, 0), min(shift + len(own), len(w.hash))
                    same = w.hash[a:b] == own[a - shift : b - shift]
                    s, e = best_run(same, min_identity)
                    equal = int(same[s:e].sum())
                    if equal and equal >= wanted(len(own), min_words):
                        found = (equal, s - e, -int(w.start[a + s]), int(w.end[a + e - 1]))
                        best = found if best is None else max(best, found)
                if best:
                    rows.append((doc, items[i].as_py(), many[i].as_py(), best[0], -best[1], len(own), -best[2], best[3], name))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "item_id", "n_items", "equal_words", "run_words", "item_words", "start_byte", "end_byte", "text_hash"]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], type=kind) for k, kind in enumerate(kinds)], names=names)

    return both.mapInArrow(judged, schema)


def without_overlaps(docs: DataFrame, benchmark: DataFrame, min_words: int = 12, min_identity: float = 0.75) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text overlaps no item; see ``find_overlaps``.

    What overlaps is known by doc_id and a hash of the text, and broadcast while it is at most a million rows; more are joined by a shuffle."""
    dirty = find_overlaps(docs, benchmark, min_words, min_identity).select(F.col("doc_id").alias("id"), "text_hash").distinct()
    dirty = written(dirty, "overlapping")
    few = dirty.count() <= 1 << 20
    same = docs["doc_id"].eqNullSafe(dirty["id"]) & (F.xxhash64(docs["text"]) == dirty["text_hash"])
    return docs.join(F.broadcast(dirty) if few else dirty, same, "left_anti")
