"""Sampled segmentations of texts into the pieces of a SentencePiece model, and their lossless decoding."""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonestudy.llm.shared import slices
from zonestudy.llm.words import _scale, mix, text_bytes

_SPACE = 32
_CHAR = np.zeros(256, dtype=np.int64)  # bytes of the character that a byte begins
_CHAR[:128], _CHAR[192:224], _CHAR[224:240], _CHAR[240:] = 1, 2, 3, 4
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
#: Cells of a lattice that are held at once.
CELLS = 1 << 20
#: Words of at least so many bytes, of a width that at most so many have, go byte by byte; other ones of a width go together.
LONG, FEW = 48, 12
#: Bytes of long words whose pieces are held at once.
STRETCH = 1 << 15


class Pieces:
    """The pieces of a model as bytes, spaces for its space mark, with log probabilities.

    A BPE model ranks its pieces and has no probabilities: they are taken as those of Zipf's law, in proportion to
    1 / (1 + rank), to the power ``alpha``. Characters without a piece are written as byte pieces."""

    def __init__(self, ids: list[int], pieces: list[bytes], scores: list[float], byte_ids: list[int], alpha: float = 1.0) -> None:
        weights = alpha * np.array(scores, dtype=np.float64)
        weights -= np.logaddexp.reduce(weights)
        self.byte_ids = np.array(byte_ids, dtype=np.int32)
        weights = np.exp(weights)
        self.fallback = float(weights.min()) / 100
        size = max([*ids, *byte_ids]) + 1
        held: list[bytes] = [b""] * size
        for i, p in [*zip(ids, pieces, strict=True), *((b, bytes([k])) for k, b in enumerate(byte_ids))]:
            held[i] = p
        self.lengths = np.array([len(p) for p in held], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(held), dtype=np.uint8)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        alone = np.ones(256, dtype=bool)
        for n in sorted({len(p) for p in pieces}):
            of = [k for k, p in enumerate(pieces) if len(p) == n]
            data = np.frombuffer(b"".join(pieces[k] for k in of), dtype=np.uint8).reshape(-1, n)
            alone[np.unique(data)] = False
            hashes = ((data.astype(np.uint64) + np.uint64(1)) * _scale(n)[0][:n]).sum(axis=1, dtype=np.uint64) * _SPREAD
            order = np.argsort(hashes)
            present = np.zeros(1 << 16, dtype=bool)
            present[hashes >> np.uint64(48)] = True
            self.by_length[n] = (hashes[order], np.array([ids[k] for k in of], dtype=np.int32)[order], weights[of][order], present)
        self.longest = max(self.by_length, default=1)
        #: Bytes that no piece holds stand alone.
        self.alone = alone

    @classmethod
    def load(cls, file: str, alpha: float = 1.0) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=file)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        texts = [model.id_to_piece(i).replace("▁", " ").encode() for i in ids]
        byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(b" " in t.lstrip(b" ") for t in texts):
            raise ValueError("a piece goes on after a space: words are not separate lattices")
        rank = np.argsort(np.argsort([-model.get_score(i) for i in ids], kind="stable"), kind="stable")
        return cls(ids, texts, list(-np.log1p(rank)), byte_ids, alpha)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the pieces, one after another."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[ids] - ends + n, n)
        return self.bytes[at]

    def lattices(self, start: np.ndarray, width: int, data: np.ndarray, total: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For words of ``width`` bytes at ``start`` of ``data``, by end position, word and length of the piece that ends there:
        running sums of the weights of all that leads to the end by a piece of at most that length, and the pieces' ids (-1: bytes).

        Weights are probabilities up to a factor for each word and stretch of positions, so that long words don't underflow."""
        count, most = len(start), min(width, max(self.longest, 4))
        sums = np.zeros((width + 1, count, most + 1))
        ids = np.full((width + 1, count, most + 1), -2, dtype=np.int32)
        at = start[:, None] + np.arange(width)
        before, down = total[start[:, None] + np.arange(width + 1)], scale[at]
        for n, (hashes, own, weights, present) in self.by_length.items():
            if n > width:
                break
            h = ((before[:, n:] - before[:, : width - n + 1]) * down[:, : width - n + 1]).ravel()
            maybe = np.flatnonzero(present[h >> np.uint64(48)])
            place = np.minimum(np.searchsorted(hashes, h[maybe]), len(hashes) - 1)
            sure = hashes[place] == h[maybe]
            place = place[sure]
            word, begin = np.divmod(maybe[sure], width - n + 1)
            sums[begin + n, word, n] = weights[place]
            ids[begin + n, word, n] = own[place]
        lead = _CHAR[data[at]]
        for n in range(1, min(4, most) + 1):
            word, begin = np.nonzero(lead == n)
            bare = ids[begin + n, word, n] == -2
            sums[begin[bare] + n, word[bare], n], ids[begin[bare] + n, word[bare], n] = self.fallback**n, -1
        reach = np.zeros((count, width + 1))
        reach[:, 0] = 1.0
        for j in range(1, width + 1):
            m = min(j, most)
            ways = sums[j, :, 1 : m + 1]
            ways *= reach[:, j - m : j][:, ::-1]
            np.cumsum(ways, axis=1, out=ways)
            sums[j, :, m + 1 :] = ways[:, -1:]
            reach[:, j] = ways[:, -1]
            if j % 8 == 0:
                window = reach[:, max(0, j - most) : j + 1]
                window /= window.max(axis=1, keepdims=True)
        return sums, ids

    def sample(self, texts: pa.Array, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """ids of all rows, where each row's begin, the encoded bytes and where each row's begin; see ``encode_documents``."""
        raw, offsets = text_bytes(texts)
        size = np.diff(offsets)
        full = size > 0
        new = np.concatenate([[0], np.cumsum(size + full)])
        data = np.full(new[-1], _SPACE, dtype=np.uint8)
        row = np.repeat(np.arange(len(size)), size)
        data[np.arange(len(raw)) + (new[:-1] + full - offsets[:-1])[row]] = raw
        out = np.full(len(data) + 1, -2, dtype=np.int32)
        if len(data):
            total = np.zeros(len(data) + 1, dtype=np.uint64)
            up, down = _scale(len(data))
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
            space, alone = data == _SPACE, self.alone[data] & (data < 128)
            cut = space.copy()
            cut[1:] &= ~space[:-1]
            cut |= alone
            cut[1:] |= alone[:-1]
            cut[new[:-1][full]] = True
            start = np.flatnonzero(cut)
            length = np.diff(np.append(start, len(data)))
            owner = np.searchsorted(new, start, side="right") - 1
            seed = mix(keys.astype(np.int64).view(np.uint64) + np.uint64(0x2545F4914F6CDD1D))[owner]
            same = mix((total[start + length] - total[start]) * down[start]) + length.astype(np.uint64)
            _, first, inverse = np.unique(same, return_index=True, return_inverse=True)
            by_size = np.argsort(length[first], kind="stable")
            place = np.empty(len(first), dtype=np.int64)
            place[by_size] = np.arange(len(first))
            kind = place[inverse]
            order = np.argsort(kind, kind="stable")
            bounds = np.searchsorted(kind[order], np.arange(len(first) + 1))
            sizes = length[first][by_size]
            scale = down * _SPREAD
            singly = []
            a = 0
            while a < len(first):
                width = int(sizes[a])
                most = max(1, CELLS // ((width + 1) * (min(width, self.longest) + 1)))
                b = int(np.searchsorted(sizes, width, "right"))
                if width >= LONG and bounds[b] - bounds[a] <= FEW:
                    singly.append(order[bounds[a] : bounds[b]])
                    a = b
                    continue
                b = min(a + most, b)
                sums, ids = self.lattices(start[first[by_size[a:b]]], width, data, total, scale)
                chosen = order[bounds[a] : bounds[b]]
                self._walk(sums, ids, kind[chosen] - a, start[chosen], length[chosen], seed[chosen], new[owner[chosen]], data, out)
                a = b
            if singly:
                chosen = np.concatenate(singly)
                self._through(start[chosen], length[chosen], seed[chosen], new[owner[chosen]], data, total, scale, out)
        held = out[:-1] >= 0
        ends = np.concatenate([[0], np.cumsum(held)])[new]
        return out[:-1][held], ends, data, new

    def _matches(self, a: int, b: int, at: np.ndarray, close: np.ndarray, data: np.ndarray, total: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, ...]:
        """The pieces that begin before ``b`` and end after ``a``, by where they end and by length: end, length, weight, id (-1: bytes).

        Places are those of words laid one after another: ``at`` has each one's byte of ``data``, ``close`` its word's end."""
        low = max(0, a - max(self.longest, 4) + 1)
        bare = np.ones((5, b - low), dtype=bool)
        ends, lengths, weight, name = [], [], [], []

        def add(begin: np.ndarray, n: int, w: np.ndarray | float, i: np.ndarray | int) -> None:
            ends.append(begin + n)
            lengths.append(np.full(len(begin), n, dtype=np.int32))
            weight.append(np.broadcast_to(np.asarray(w, dtype=np.float64), len(begin)))
            name.append(np.broadcast_to(np.asarray(i, dtype=np.int32), len(begin)))

        def within(n: int) -> np.ndarray:
            begin = np.arange(max(low, a - n + 1), b)
            return begin[begin + n <= close[begin]]

        for n, (hashes, own, weights, present) in self.by_length.items():
            begin = within(n)
            x = at[begin]
            h = (total[x + n] - total[x]) * scale[x]
            maybe = np.flatnonzero(present[h >> np.uint64(48)])
            place = np.minimum(np.searchsorted(hashes, h[maybe]), len(hashes) - 1)
            sure = hashes[place] == h[maybe]
            place, begin = place[sure], begin[maybe[sure]]
            add(begin, n, weights[place], own[place])
            if n < 5:
                bare[n, begin - low] = False
        for n in range(1, 5):
            begin = within(n)
            begin = begin[(_CHAR[data[at[begin]]] == n) & bare[n, begin - low]]
            add(begin, n, self.fallback**n, -1)
        end, n = np.concatenate(ends), np.concatenate(lengths)
        order = np.lexsort((n, end))
        return end[order], n[order], np.concatenate(weight)[order], np.concatenate(name)[order]

    def _through(self, start: np.ndarray, length: np.ndarray, seed: np.ndarray, base: np.ndarray, data: np.ndarray, total: np.ndarray, scale: np.ndarray, out: np.ndarray) -> None:
        """As ``lattices`` and ``_walk``, for words laid one after another: a draw depends on its place alone, so the last piece before each place
        is drawn as soon as the sums there are known. What is held of the lattice is a stretch's pieces."""
        close = np.cumsum(length)
        first, places, most = close - length, int(close[-1]), max(self.longest, 4)
        at = np.arange(places) + np.repeat(start - first, length)
        word, close = np.repeat(np.arange(len(start)), length), np.repeat(close, length)
        back, drawn = np.zeros(places + 1, dtype=np.int32), np.full(places + 1, -2, dtype=np.int32)
        reach = [0.0] * (most - 1) + [1.0]  # of the places up to the stretch, then of its own
        for a in range(0, places, STRETCH):
            b = min(a + STRETCH, places)
            end, n, weights, ids = self._matches(a, b, at, close, data, total, scale)
            bounds = np.searchsorted(end, np.arange(a + 1, b + 2)).tolist()
            before = end - n - (a - most + 1)
            needed = np.append(np.minimum.accumulate(before[::-1])[::-1], len(end) and b - a + most).tolist()  # the first place that later pieces begin at
            own = word[a:b]
            u = (mix(seed[own] + (at[a:b] + 1 - base[own]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)) * 2.0**-53
            last = (close[a:b] == np.arange(a + 1, b + 1)).tolist()
            w, before, picked = weights.tolist(), before.tolist(), [-1] * (b - a)
            for j, share in enumerate(u.tolist()):
                x, y = bounds[j], bounds[j + 1]
                s, sums = 0.0, []
                for k in range(x, y):
                    s += w[k] * reach[before[k]]
                    sums.append(s)
                if s:
                    picked[j] = x + min(bisect_right(sums, share * s), y - x - 1)
                reach.append(1.0 if last[j] else s)  # the next word's beginning
                if s < 1e-100 and not last[j]:
                    top = max(reach[needed[y] :], default=0.0)
                    if 0 < top < 1e-100:
                        reach[-most:] = [r * 2.0**300 for r in reach[-most:]]
            reach = reach[-most:]
            pick = np.array(picked)
            some = np.flatnonzero(pick >= 0)
            back[a + 1 + some], drawn[a + 1 + some] = n[pick[some]], ids[pick[some]]
        steps, path, j = back.tolist(), [], places
        while j:
            path.append(j)
            j -= steps[j]
        path = np.array(path)
        begin, chosen = at[path - back[path]], drawn[path]
        out[begin] = chosen
        for n in range(1, 5):
            x = begin[(chosen == -1) & (back[path] == n), None] + np.arange(n)
            out[x] = self.byte_ids[data[x]]

    def _walk(self, sums: np.ndarray, ids: np.ndarray, word: np.ndarray, start: np.ndarray, j: np.ndarray, seed: np.ndarray, base: np.ndarray, data: np.ndarray, out: np.ndarray) -> None:
        """Draws the last piece, then the one before it, until each word's beginning; writes each id where its piece begins."""
        while len(word):
            u = (mix(seed + (start + j - base).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)) * 2.0**-53
            ways = sums[j, word]
            n = (ways <= (u * ways[:, -1])[:, None]).sum(axis=1)
            chosen = ids[j, word, n]
            j = j - n
            out[start + j] = chosen
            for k in np.flatnonzero(chosen == -1):
                at = start[k] + j[k]
                out[at : at + n[k]] = self.byte_ids[data[at : at + n[k]]]
            left = j > 0
            word, start, j, seed, base = word[left], start[left], j[left], seed[left], base[left]


@lru_cache(maxsize=2)
def _pieces(file: str, alpha: float) -> Pieces:
    return Pieces.load(file, alpha)


def encode_documents(docs: DataFrame, file: str, alpha: float = 1.0) -> DataFrame:
    """doc_id, ids, n_ids, decoded_crc32 and lossless of every document.

    A segmentation is drawn with its probability among all segmentations of the text: forward sums over the lattice of
    pieces, then backward draws. A piece never goes on after a space, and bytes that no piece holds stand alone,
    so each word is a lattice of its own; equal words of a slice share one. The draws are numbers
    made from doc_id and the byte position, so they don't depend on how rows are batched or partitioned; rows with one
    doc_id and text have one segmentation. As the model asks for, a text is encoded with a space before it, which decoding takes
    away again. ``decoded_crc32`` is of the decoded bytes, ``lossless`` whether they are the text's.

    Null and empty texts have no ids and the CRC 0; a null doc_id draws as 0. Repeated rows stay, other columns are ignored. No
    shuffle. ``file`` must be readable at that path on every machine."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(file, alpha)
        for batch in slices(batches, "text"):
            ids, ends, data, new = pieces.sample(batch.column("text"), batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False))
            back = pieces.decode(ids)
            whole = len(back) == len(data)
            crc, same = [], []
            for a, b in zip(new.tolist(), new[1:].tolist(), strict=False):
                own = back[a + (b > a) : b] if whole else back[:0]
                crc.append(zlib.crc32(own))
                same.append(whole and bool(np.array_equal(own, data[a + (b > a) : b])))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), lists, pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())],
                names=["doc_id", "ids", "n_ids", "decoded_crc32", "lossless"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, ids array<int>, n_ids long, decoded_crc32 long, lossless boolean")
