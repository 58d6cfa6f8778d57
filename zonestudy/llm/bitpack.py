"""Token ids in the fewest bits the vocabulary needs, in blocks with offsets that numpy unpacks at once."""

from __future__ import annotations

import string
import struct
import warnings
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache, reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zonestudy.llm.shared import scratch_path, slices

#: Words whose ids a worker remembers at most: about 130 MB.
REMEMBERED = 600_000

BLOCK = "part int, block long, bits int, first_id long, last_id long, n_ids long, doc_ids array<long>, offsets array<long>, payload binary"


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids below ``2**bits`` one after another in ``bits`` bits each, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    out = []
    for at in range(0, len(ids), 1 << 18):  # a multiple of 8 ids fills whole bytes
        part = ids[at : at + (1 << 18)].astype(np.uint32)
        out.append(np.packbits(((part[:, None] >> np.arange(bits, dtype=np.uint32)) & 1).astype(np.uint8).ravel(), bitorder="little").tobytes())
    return b"".join(out)


def unpack(payload: bytes, bits: int, start: int, n: int) -> np.ndarray:
    """Ids ``start`` to ``start + n`` of a packed block; reads only the bytes that hold them."""
    first = start * bits >> 3
    need = payload[first : (start + n) * bits + 7 >> 3]
    if bits in (8, 16, 32):
        return np.frombuffer(need, dtype=f"<u{bits // 8}", count=n).astype(np.uint32)
    held = np.frombuffer(need + bytes(8), dtype=np.uint8)
    at = start * bits - 8 * first + np.arange(n, dtype=np.int64) * bits
    words = np.zeros(n, dtype=np.uint64)
    for k in range((bits + 14) // 8):
        words |= held[(at >> 3) + k].astype(np.uint64) << np.uint64(8 * k)
    return ((words >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


class Remembered(dict):
    """What ``make`` gives for keys, worked out once for as long as it is remembered. There are never more than ``limit`` entries: once half as many have
    come or been used again, those that weren't in that time are forgotten."""

    def __init__(self, make: Callable[[Any], bytes], limit: int) -> None:
        self.make, self.half, self.before = make, limit // 2, {}

    def __missing__(self, key: Any) -> bytes:
        found = self.before.pop(key, None)
        if found is None:
            found = self.make(key)
        if len(self) >= self.half:
            self.before = self.copy()
            self.clear()
        self[key] = found
        return found


class WordEncoder:
    """Ids of texts by a tokenizer that never joins across ASCII white space (checked on samples): each distinct word is encoded once, as far as
    words are remembered.

    Most words are letters and punctuation after them, which the tokenizer takes apart; those of Latin letters go to its model
    directly, lower-cased and in its alphabet of bytes, each letter part once. All others go through the whole tokenizer."""

    SAMPLES = ("a", "the", "don't", "É1", "x,y.", "(", "'s", "12", "<|", "|>")
    #: ASCII punctuation but the apostrophe, which can begin a part of letters.
    MARKS = string.punctuation.replace("'", "")

    def __init__(self, file: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.known = Remembered(self._word, REMEMBERED)
        self.letters = Remembered(self._letters, REMEMBERED // 2)
        self.marks = Remembered(lambda tail: self._encode(tail).tobytes(), 10_000)
        for a in self.SAMPLES:
            for b in self.SAMPLES:
                if self._encode(f"{a} \t{b}").tolist() != [*self._encode(a), *self._encode(b)]:
                    raise ValueError(f"{file} joins {a!r} and {b!r} across white space")
        self.direct = True
        self.direct = self._is_direct()

    def _is_direct(self) -> bool:
        """Whether letters and marks may be encoded apart, letters by the model: tried on all Latin letters."""
        level = self.tokenizer.pre_tokenizer
        self.alphabet = {i: "".join(x for x, _ in level.pre_tokenize_str(chr(i))) for i in range(128, 256) if chr(i).isalpha()} if level else {}
        letters = [chr(i) for i in range(256) if chr(i).isalpha()]
        words = [a + b + "ing" + m for a, b in zip(letters, reversed(letters), strict=True) for m in (".", "$$$", "-_", "")] + [f"Ab{m}" for m in self.MARKS]
        try:
            return level is not None and all(self._word(w.encode()) == self._encode(w).tobytes() for w in words)
        except Exception as e:  # another kind of model: all words go through the tokenizer
            warnings.warn(f"{e}: words are encoded whole", stacklevel=2)
            return False

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers; a null text has none."""
        ids = self.known.__getitem__
        return [b"".join(map(ids, x.split())) if x else b"" for x in texts.cast(pa.large_binary()).to_pylist()]

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        head = text.rstrip(self.MARKS)
        if not self.direct or not head.isalpha() or not (head.isascii() or max(head) < "\u0100"):
            return self._encode(text).tobytes()
        ids = self.letters[head.lower()]
        return ids if len(head) == len(text) else ids + self.marks[text[len(head) :]]

    def _letters(self, head: str) -> bytes:
        spelled = head if head.isascii() else head.translate(self.alphabet)
        ids = [x.id for x in self.tokenizer.model.tokenize(spelled)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")


@lru_cache(maxsize=1)
def _encoder(file: str) -> WordEncoder:
    return WordEncoder(file)


def write_ids(docs: DataFrame, path: str, file: str, end_id: int, block_ids: int = 1 << 18) -> None:
    """Encodes ``docs`` (doc_id, text) and writes packed blocks to ``path`` in ascending order of doc_id (nulls first).

    The texts are range-partitioned and sorted once and encoded where they land, so a file holds a run of ids. A block
    is a row: the documents' ids, their offsets in the block, and the packed ids. A block ends after ``block_ids`` ids or 65,536
    documents; a longer document has a block of its own. Files are Parquet without row limits, committed by
    Spark's writer, so a lost executor leaves no half-written block. Repeated doc_ids stay, in the order of the input. Null and
    empty texts hold only ``end_id``. No rows give no blocks. ``file`` must be readable at that path on every
    machine; the tokenizer must not join across ASCII white space."""
    ordered = (
        docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_tie"))
        .repartitionByRange("doc_id", "_tie")
        .sortWithinPartitions("doc_id", "_tie")
        .select(F.spark_partition_id().alias("part"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    )

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(file)
        bits = max(end_id, encoder.tokenizer.get_vocab_size(with_added_tokens=True) - 1).bit_length()
        end, ids, docs, lengths, block, part, held = np.array([end_id], dtype="<u4").tobytes(), [], [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            own = [x for x in docs if x is not None]
            columns = [[part], [block], [bits], [min(own, default=None)], [max(own, default=None)], [held], [docs], [np.concatenate([[0], np.cumsum(lengths)])], [pack(np.frombuffer(b"".join(ids), dtype="<u4"), bits)]]
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            names = ["part", "block", "bits", "first_id", "last_id", "n_ids", "doc_ids", "offsets", "payload"]
            return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in slices(batches, "text"):
            part = batch.column("part")[0].as_py()
            for doc, found in zip(batch.column("doc_id").to_pylist(), encoder(batch.column("text")), strict=True):
                n = len(found) // 4 + 1
                if docs and (held + n > block_ids or len(docs) >= 65_536):
                    yield flush()
                    ids, docs, lengths, block, held = [], [], [], block + 1, 0
                ids += (found, end)
                docs.append(doc)
                lengths.append(n)
                held += n
        if docs:
            yield flush()

    ordered.mapInArrow(encode, BLOCK).write.option("compression", "zstd").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCK).parquet(path)


def read_ids(blocks: DataFrame, only: Sequence[int] | None = None) -> DataFrame:
    """part, block, doc_id, offset in the block and ``ids`` (array) of each document of ``blocks``.

    With ``only``, a few doc_ids, only their blocks are read, by Parquet's statistics of ``first_id`` and ``last_id``, and only their ids unpacked."""
    if only is not None:
        blocks = blocks.filter(reduce(Column.__or__, [F.lit(i).between(F.col("first_id"), F.col("last_id")) for i in only], F.lit(False)))
    wanted = None if only is None else frozenset(only)

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in batch.to_pylist()):
            taken = [k for k, doc in enumerate(b["doc_ids"]) if wanted is None or doc in wanted]
            at = b["offsets"]
            if wanted is None:
                ids = [unpack(b["payload"], b["bits"], 0, b["n_ids"])]
            else:
                ids = [unpack(b["payload"], b["bits"], at[k], at[k + 1] - at[k]) for k in taken]
            ends = np.concatenate([[0], np.cumsum([at[k + 1] - at[k] for k in taken])])
            lists = pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(np.concatenate([*ids, np.zeros(0, dtype=np.uint32)]).astype(np.int64)))
            docs, starts, n = [b["doc_ids"][k] for k in taken], pa.array([at[k] for k in taken], type=pa.int64()), len(taken)
            yield pa.RecordBatch.from_arrays(
                [pa.array([b["part"]] * n, pa.int32()), pa.array([b["block"]] * n, pa.int64()), pa.array(docs, pa.int64()), starts, lists],
                names=["part", "block", "doc_id", "offset", "ids"],
            )

    return blocks.mapInArrow(each, "part int, block long, doc_id long, offset long, ids array<long>")


def id_digests(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from written blocks.

    Starts are prefix sums: over the partitions' totals, over the blocks of a partition, and within a block."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = {n: batch.column(n)[i].as_py() for n in ("part", "block", "bits", "n_ids", "doc_ids", "offsets", "payload")}
                ids = memoryview(unpack(b["payload"], b["bits"], 0, b["n_ids"]).astype("<u4").tobytes())
                at = b["offsets"]
                crc = [zlib.crc32(ids[4 * x : 4 * y]) for x, y in zip(at, at[1:], strict=False)]
                n = len(crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b["part"]] * n, pa.int32()), pa.array([b["block"]] * n, pa.int64()), pa.array(b["doc_ids"], pa.int64()),
                     pa.array(at[:-1], pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())],
                    names=["part", "block", "doc_id", "offset", "n_tokens", "ids_crc32"],
                )

    rows = blocks.mapInArrow(each, "part int, block long, doc_id long, offset long, n_tokens long, ids_crc32 long")
    sizes = blocks.select("part", "block", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_part_start"))
    within = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", "block", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("_block_start")).join(parts, "part")
    return rows.join(starts, ["part", "block"]).select(
        "doc_id", (F.col("_part_start") + F.col("_block_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"
    )


def encode_documents(docs: DataFrame, file: str, end_id: int = 2) -> DataFrame:
    """Writes the ids of all documents to the shared folder and returns their digests, read back from the files."""
    spark = docs.sparkSession
    path = scratch_path(spark, "ids")
    write_ids(docs, path, file, end_id)
    return id_digests(read_blocks(spark, path))
