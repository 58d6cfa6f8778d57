"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or, learned from document labels."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonestudy.llm.shared import slices
from zonestudy.llm.words import PUNCTUATION, Words, mix, tokenize

#: Bytes after which a sentence ends: . ! ? and the line feed.
ENDS = np.zeros(256, dtype=bool)
ENDS[[10, 33, 46, 63]] = True


#: Lengths in bytes of the word beginnings that count as features, beside whole words.
PREFIXES = (4, 5, 6, 7, 8)
_WHOLE = np.uint64(0x5851F42D4C957F2D)


@dataclass
class ToxicModel:
    """``features``: hashes in ascending order, and their ``weights``; ``bias``: log odds of a sentence without any of them;
    ``leak``: the chance that a document is labelled for reasons its words don't show."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    leak: float


def sentences(texts: pa.Array) -> tuple:
    """The words of the rows, each word's sentence (numbered over all rows), and each sentence's row, first and last byte."""
    w = tokenize(texts, PUNCTUATION)
    ends = np.cumsum(ENDS[w.data], dtype=np.int64) if len(w.data) else np.zeros(0, dtype=np.int64)
    key = ends[w.start] if len(w.start) else w.start
    fresh = np.ones(len(key), dtype=bool)
    fresh[1:] = (key[1:] != key[:-1]) | (w.doc[1:] != w.doc[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(key))[: len(first)] - 1
    row = w.doc[first]
    return w, np.cumsum(fresh) - 1, row, w.start[first] - w.offsets[row], w.end[last] - w.offsets[row]


def log_not(z: np.ndarray | float) -> np.ndarray:
    """log(1 - sigmoid(z))."""
    return -np.logaddexp(0.0, z)


def features(w: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Feature hashes and the words that have them: whole words, then beginnings of each length."""
    yield w.hash ^ _WHOLE, np.arange(len(w.hash))
    for n in PREFIXES:
        yield w.prefix(n)


def known(w: Words, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words that have a feature of the ascending ``vocabulary``, and which; a word can have several."""
    present = np.zeros(1 << 16, dtype=bool)
    present[vocabulary >> np.uint64(48)] = True
    found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))]
    for hashes, at in features(w):
        maybe = np.flatnonzero(present[hashes >> np.uint64(48)])
        if len(maybe):
            place = np.minimum(np.searchsorted(vocabulary, hashes[maybe]), len(vocabulary) - 1)
            sure = vocabulary[place] == hashes[maybe]
            found.append((at[maybe[sure]], place[sure]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def score_texts(texts: pa.Array, model: ToxicModel, spans: bool = False) -> tuple[np.ndarray, np.ndarray, dict[int, list]]:
    """The scores and sentence counts of whole texts and, if asked for, the sentences that are likelier toxic than not."""
    w, sentence, row, start, end = sentences(texts)
    z = np.full(len(row), model.bias)
    word, place = known(w, model.features)
    np.add.at(z, sentence[word], model.weights[place])
    clean = np.full(len(texts), np.log1p(-model.leak))
    np.add.at(clean, row, log_not(z))
    found: dict[int, list] = {}
    for k in np.flatnonzero(z > 0) if spans else ():
        found.setdefault(int(row[k]), []).append({"start": int(start[k]), "end": int(end[k]), "score": float(1 / (1 + np.exp(-z[k])))})
    return -np.expm1(clean), np.bincount(row, minlength=len(texts)), found


def _parts(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts of about a megabyte, with the place of the first."""
    at = 0
    for batch in slices([pa.RecordBatch.from_arrays([texts], names=["text"])], "text"):
        yield at, batch.column("text")
        at += batch.num_rows


def _owned(texts: pa.Array, held: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Features of the texts (with ``held``, ascending, those only), once for each owner: the smallest word hash of a text, which near copies mostly
    share; and how many owners there are."""
    features_, names, owners = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.uint64)], set()
    for _, part in _parts(texts):
        w = tokenize(part, PUNCTUATION)
        first = np.flatnonzero(np.diff(w.doc, prepend=-1))
        own = np.zeros(len(part), dtype=np.uint64)
        if len(first):
            own[w.doc[first]] = np.minimum.reduceat(w.hash, first)
        owners.update(own.tolist())
        for hashes, at in features(w):
            if held is not None:
                here = np.flatnonzero(held[np.minimum(np.searchsorted(held, hashes), len(held) - 1)] == hashes)
                hashes, at = hashes[here], at[here]
            name, place = np.unique(mix(hashes ^ (own[w.doc[at]] * np.uint64(0x9E3779B97F4A7C15))), return_index=True)
            features_.append(hashes[place])
            names.append(name)
    _, place = np.unique(np.concatenate(names), return_index=True)
    return np.concatenate(features_)[place], len(owners)


def choose(texts: pa.Array, labels: np.ndarray, min_docs: int, share: float, max_features: int) -> np.ndarray:
    """Features of toxic documents that clean ones hardly have, in ascending order.

    Near copies count once: support is the number of distinct smallest word hashes among the documents with a feature.
    A feature needs support by ``min_docs`` and by ``share`` of the toxic documents, and 20 times that of clean ones."""
    seen, toxic = _owned(texts.filter(pa.array(labels == 1)), None)
    held, support = np.unique(seen, return_counts=True)
    enough = support >= max(min_docs, share * toxic)
    held, support = held[enough], support[enough]
    if not len(held):
        return held
    values, counts = np.unique(_owned(texts.filter(pa.array(labels != 1)), held)[0], return_counts=True)
    clean = np.zeros(len(held), dtype=np.int64)
    clean[np.searchsorted(held, values)] = counts
    good = np.flatnonzero(support >= 20 * clean)
    good = good[np.argsort(-support[good], kind="stable")[:max_features]]
    return held[np.sort(good)]


def fit(texts: pa.Array, labels: np.ndarray, min_docs: int = 4, share: float = 0.01, max_features: int = 1000, steps: int = 300) -> ToxicModel:
    """A noisy-or over sentences with a leak, by gradient steps on the documents' log loss.

    Weights start at 0 and are drawn there, and the bias to a low value, so that many sentences alone don't make a long
    document toxic. Without documents of both labels, or without features, the model tells nothing."""
    vocabulary = choose(texts, labels, min_docs, share, max_features) if len(texts) and labels.min() != labels.max() else np.zeros(0, dtype=np.uint64)
    if not len(vocabulary):
        return ToxicModel(vocabulary, np.zeros(0), -12.0, 0.01)
    rows, columns, doc_of, at = [], [], [], 0
    for first, part in _parts(texts):
        w, sentence, row, _, _ = sentences(part)
        word, place = known(w, vocabulary)
        rows.append(sentence[word] + at)
        columns.append(place)
        doc_of.append(first + row)
        at += len(row)
    rows, columns, doc_of = (np.concatenate(x).astype(np.int64) for x in (rows, columns, doc_of))
    theta = np.concatenate([np.zeros(len(vocabulary)), [-12.0, -4.0]])
    mean, square = np.zeros(len(theta)), np.zeros(len(theta))
    for step in range(1, steps + 1):
        weights, bias, leak = theta[:-2], theta[-2], theta[-1]
        z = bias + np.bincount(rows, weights=weights[columns], minlength=len(doc_of))
        clean = np.bincount(doc_of, weights=log_not(z), minlength=len(texts)) + log_not(leak)
        down = np.where(labels == 1, np.exp(clean) / np.maximum(-np.expm1(clean), 1e-12), -1.0)  # of the log likelihood by -clean
        dz = down[doc_of] / (1 + np.exp(-z))
        slope = np.concatenate([np.bincount(columns, weights=dz[rows], minlength=len(vocabulary)), [dz.sum(), (down / (1 + np.exp(-leak))).sum()]])
        slope[:-2] -= 0.002 * weights
        slope[-2] -= 20.0 * (bias + 12.0)
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        theta = theta + 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
        theta[-2], theta[-1] = min(theta[-2], -11.0), np.clip(theta[-1], -9.0, -2.0)
    return ToxicModel(vocabulary, theta[:-2], float(theta[-2]), float(1 / (1 + np.exp(-theta[-1]))))


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 3 is 1; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 12_000) -> ToxicModel:
    """Fits a model on the whole texts of at most ``max_docs`` labelled documents that aren't held out.

    The labelled ids with the smallest hashes are taken, so the same input gives the same model. Only that bounded sample of
    texts meets in one task. A document with several labels
    is toxic if any says so; null labels and ids are left out; of equal texts one is used. Without both labels the model knows no words."""
    order = F.xxhash64(F.lit("toxic"), "doc_id")
    sample = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("label"))
        .orderBy(order, "doc_id")
        .limit(max_docs)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(F.xxhash64("text").alias("key"), "label", "text")

    def fitted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = pa.schema([("key", pa.int64()), ("label", pa.int32()), ("text", pa.large_string())])
        held = pa.Table.from_batches([b.cast(wide) for b in batches], schema=wide).combine_chunks()
        key, label = held.column("key").to_numpy(), held.column("label").to_numpy()
        order = np.lexsort((-label, key))
        order = order[np.diff(key[order], prepend=key[order[:1]] - 1) != 0]  # of equal texts one
        texts = pa.concat_arrays(held.column("text").take(pa.array(order)).chunks) if len(order) else pa.array([], pa.large_string())
        m = fit(texts, np.minimum(label[order], 1).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([m.features.tobytes()], pa.binary()), pa.array([m.weights.tobytes()], pa.binary()), pa.array([m.bias]), pa.array([m.leak])], names=["features", "weights", "bias", "leak"])

    bounded = rows.orderBy("key", "label").limit(max_docs).coalesce(1)
    models = bounded.mapInArrow(fitted, "features binary, weights binary, bias double, leak double").collect()
    if not models:
        return ToxicModel(np.zeros(0, dtype=np.uint64), np.zeros(0), -12.0, 0.01)
    m = models[0]  # at most 1,000 features
    return ToxicModel(np.frombuffer(m.features, dtype=np.uint64), np.frombuffer(m.weights), m.bias, m.leak)


def score_documents(docs: DataFrame, model: ToxicModel, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, n_sentences and ``offending`` (byte spans and scores of toxic sentences) of every document.

    A score is 1 minus the leak's complement times the product of each sentence's chance not to be toxic, over the
    whole text. Null and empty texts have the leak's score. Repeated rows stay; other columns are ignored. No shuffle."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in slices(batches, "text"):
            score, n, found = score_texts(batch.column("text"), model, spans=True)
            spans = pa.array([found.get(i, []) for i in range(batch.num_rows)], type=kind)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array(n, pa.int32()), spans], names=["doc_id", "score", "n_sentences", "offending"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        each, "doc_id long, score double, n_sentences int, offending array<struct<start: long, end: long, score: double>>"
    )
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_sentences", "offending"
    )


def without_toxic(docs: DataFrame, model: ToxicModel, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is below ``threshold``."""

    def clean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield batch.filter(pa.array(score_texts(batch.column("text"), model)[0] < threshold))

    return docs.mapInArrow(clean, docs.schema)
