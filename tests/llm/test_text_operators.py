"""Pure parts of the text operators against plain Python."""

import collections
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from zonestudy.llm import bitpack, decontaminate, licenses, ngram_join, pieces, toxicity, words

TEXTS = ["", None, "one", "The cat SAT on the mat the cat sat on the mat", "a\x0bb\x1cc  d\n e", "x" * 5000, "über straße Ünï", " ", "\t\n"]


def test_words_are_those_of_the_rule():
    w = words.tokenize(pa.array(TEXTS, pa.string()), words.SPACES)
    want = [re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or "")) for t in TEXTS]
    raw = [[bytes(words.LOWER[w.data[a:b]]).decode() for a, b, d in zip(w.start, w.end, w.doc) if d == i] for i in range(len(TEXTS))]
    assert raw == want


def test_hash_depends_on_the_word_only():
    one = words.tokenize(pa.array(["alpha beta", "gamma alpha"]), words.SPACES).hash
    assert one[0] == one[3] == words.hash_words("zz ALPHA", words.SPACES)[1] and len(set(one.tolist())) == 3


def shingles(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} - {()}


def test_shingle_sets():
    texts = [*TEXTS, "a b c d", "a b c", "a b c d e", "A B C D E", "a b c d e f a b c d e f"]
    s = ngram_join.shingle_sets(pa.array(texts, pa.string()))
    assert s.sizes().tolist() == [len(shingles(t)) for t in texts]
    names = list(zip(s.half.tolist(), s.more.tolist()))
    same = [[x == y for y in names] for x in names]
    assert same == [[shingles(x) == shingles(y) for y in texts] for x in texts]


@pytest.mark.parametrize("slots", [1, 7, 4096])
def test_shared_tokens_are_counted_whatever_a_task_remembers(slots):
    rng, hot, parts = np.random.default_rng(slots), np.uint64(2**63 + 77), 3
    tasks = [[words.mix(rng.integers(0, 4000, (rng.integers(1, 9), 12)).astype(np.uint64)) for _ in range(20)] for _ in range(3)]
    sent, sets, hot_sent = [], {}, 0
    for t, slices in enumerate(tasks):
        told = ngram_join.Told(slots)
        for k, tokens in enumerate(slices):
            tokens[:, 0] = hot
            name = (t << 32) + k
            tokens = [np.unique(x) for x in tokens]
            rows = np.repeat(np.arange(len(tokens)), [len(x) for x in tokens])
            sets |= {(name, i): set(x.tolist()) for i, x in enumerate(tokens)}
            sent.append(ngram_join._rows([parts] * len(tokens), name, len(tokens), place=np.arange(len(tokens)), doc_id=np.arange(len(tokens)) + (name << 8)))
            sent += ngram_join._sent(name, rows, np.concatenate(tokens), parts, told)
    table = pa.Table.from_batches(sent)
    low = np.frombuffer(np.array([hot]).tobytes(), dtype=np.uint8)[:5].tobytes()
    for r in table.filter(pa.compute.is_valid(table["tokens"])).to_pylist():
        hot_sent += sum(r["tokens"][i : i + 5] == low for i in range(0, len(r["tokens"]), 5))
    met = pa.Table.from_batches(list(ngram_join._met(table.sort_by("part").to_batches()))).sort_by("slice")
    got = {}
    for batch in ngram_join._counted(met.to_batches()):
        got |= {r["doc_id"]: r["shared"] for r in batch.to_pylist()}
    many = collections.Counter(x for s in sets.values() for x in s)
    assert got == {(name << 8) + i: sum(many[x] > 1 for x in s) for (name, i), s in sets.items()}
    assert hot_sent <= (2 * len(tasks) if slots == 4096 else 60)


def test_boundary_moves_with_the_cost_of_lists():
    sizes = {n: 100 for n in range(2, 100)}
    assert ngram_join.boundary(sizes, 0.0) <= ngram_join.boundary(sizes, 5.0) <= ngram_join.boundary(sizes, 50.0)
    assert ngram_join.boundary({}, 1.0) == 0


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 31])
def test_pack_round_trip_and_random_access(bits):
    ids = np.random.default_rng(1).integers(0, 1 << bits, 4099).astype(np.uint32)
    packed = bitpack.pack(ids, bits)
    assert len(packed) == -(-len(ids) * bits // 8)
    assert (bitpack.unpack(packed, bits, 0, len(ids)) == ids).all()
    assert (bitpack.unpack(packed, bits, 1234, 77) == ids[1234:1311]).all()
    assert len(bitpack.unpack(packed, bits, 5, 0)) == 0


def test_word_encoder_is_the_tokenizer():
    file = str(public_tokenizers.path("word_bpe_49k.json"))
    encoder = bitpack.WordEncoder(file)
    texts = ["It's  a|b | c\x1cd", "", "<|endoftext|> É é", "plain words plain", "\x85nel\xa0nbsp", "x" * 300, "Ünï-_ Straße, İx. ĀB; e\u0301t\u0301 ﬁn µm ªº THE.<|endoftext|> don't. ΣΑΣ 語$ ẞ", "a_b c++ 'll d'"]
    assert encoder.direct
    want = [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert encoder(pa.array(texts)) == want and encoder(pa.array([None], pa.string())) == [b""]


def test_encoder_of_whole_texts_is_the_tokenizer():
    encoder = bitpack.WordEncoder(str(public_tokenizers.path("word_bpe_49k.json")))
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").combine_chunks()
    want = [np.array(x.ids, dtype="<u4").tobytes() for x in encoder.tokenizer.encode_batch_fast(texts.fill_null("").to_pylist(), add_special_tokens=False)]
    assert encoder(texts) == want


def test_encoder_remembers_words_in_use(monkeypatch):
    monkeypatch.setattr(bitpack, "REMEMBERED", 40)
    encoder, made = bitpack.WordEncoder(str(public_tokenizers.path("word_bpe_49k.json"))), []
    texts = [" ".join(["often", *(f"{'abcdefghij'[k % 10]}{'klmnopqrst'[i % 10]}{'uvwxyz'[i // 10]}x," for k in range(10)), "слово", f"№{i}"]) for i in range(60)]
    want = [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    make = encoder.known.make
    encoder.known.make = lambda w: made.append(w) or make(w)
    for text, ids in zip(texts, want):
        assert encoder(pa.array([text])) == [ids] and len(encoder.known) + len(encoder.known.before) <= 40
    assert made.count(b"often") == 1 == made.count("слово".encode()) and len(made) == 60 * 11 + 2
    assert encoder(pa.array(texts)) == want and len(encoder.known) + len(encoder.known.before) <= 40


def small_pieces():
    ps = ["a", "b", "ab", "ba", "aba", " ", " a", "é"]
    return pieces.Pieces(list(range(3, 3 + len(ps))), [p.encode() for p in ps], [-0.5 * i for i in range(len(ps))], list(range(100, 356)))


def segmentations(own, data):
    if not data:
        return [((), 1.0)]
    out = []
    for n, (_, ids, weights, _) in own.by_length.items():
        for i, w in zip(ids, weights):
            at = own.starts[i]
            if bytes(own.bytes[at : at + n]) == data[:n]:
                out += [((int(i), *rest), w * p) for rest, p in segmentations(own, data[n:])]
    return out


def test_segmentations_come_with_their_probability():
    own, text, n = small_pieces(), "ababa", 20_000
    ids, ends, _, _ = own.sample(pa.array([text] * n), np.arange(n))
    seen = {}
    for a, b in zip(ends, ends[1:]):
        seen[tuple(ids[a:b].tolist())] = seen.get(tuple(ids[a:b].tolist()), 0) + 1
    want = dict(segmentations(own, b" " + text.encode()))
    total = sum(want.values())
    assert set(seen) <= set(want)
    for s, p in want.items():
        p /= total
        assert abs(seen.get(s, 0) / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3


def test_sampling_is_lossless_and_independent_of_batches():
    own = pieces.Pieces.load(str(public_tokenizers.path("piece_bpe_32k.model")))
    texts = ["Hello  wörld\n x\t語𝄞", "", "   ", "▁▁ x▁", "y" * 3000, "a b\r\n", "word " * 50]
    keys = np.array([7, 8, 9, 10, 11, 12, -3])
    ids, ends, data, new = own.sample(pa.array(texts), keys)
    for i, t in enumerate(texts):
        assert bytes(own.decode(ids[ends[i] : ends[i + 1]]))[bool(t) :] == t.encode()
        alone, _, _, _ = own.sample(pa.array([t]), keys[i : i + 1])
        assert (alone == ids[ends[i] : ends[i + 1]]).all()
    other, _, _, _ = own.sample(pa.array(["word " * 50]), np.array([5]))
    assert not np.array_equal(other, ids[ends[6] :])


def test_long_words_draw_the_same_byte_by_byte_and_together(monkeypatch):
    own, rng = pieces.Pieces.load(str(public_tokenizers.path("piece_bpe_32k.model"))), random.Random(8)
    marks = "abcdefgh 中語é\U0001F600\U00012000"
    texts = ["a" * 5000, "𝄞" * 60, " " * 300, "x" * 60 + " " + "x" * 60, "中" * 200 + "abc" * 40, *("".join(rng.choice(marks) for _ in range(rng.randrange(400))) for _ in range(60))]
    keys = np.arange(len(texts)) * 7
    drawn = []
    for long, stretch in ((1, 50), (48, 1 << 15), (10**9, 1)):
        monkeypatch.setattr(pieces, "LONG", long)
        monkeypatch.setattr(pieces, "FEW", 10**9 if long == 1 else 12)
        monkeypatch.setattr(pieces, "STRETCH", stretch)
        drawn.append(own.sample(pa.array(texts), keys))
    assert all(np.array_equal(x, y) for d in drawn[1:] for x, y in zip(drawn[0], d))
    assert bytes(own.decode(drawn[0][0])) == b"".join(b" " + t.encode() if t else b"" for t in texts)


def test_a_megabyte_without_spaces_is_walked_once():
    own, rng = pieces.Pieces.load(str(public_tokenizers.path("piece_bpe_32k.model"))), random.Random(9)
    for t in ("".join(rng.choice("0123456789abcdef") for _ in range(1_000_000)), "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(340_000))):
        began = time.process_time()
        ids = own.sample(pa.array([t]), np.array([5]))[0]
        assert time.process_time() - began < 15 and bytes(own.decode(ids)) == b" " + t.encode()


@pytest.mark.parametrize("identity", [0.6, 0.75, 0.9])
def test_best_run_against_every_run(identity):
    rng = random.Random(4)
    for _ in range(200):
        same = [rng.random() < 0.7 for _ in range(rng.randrange(1, 40))]
        runs = [(sum(same[s:e]), s - e) for s in range(len(same)) for e in range(s + 1, len(same) + 1) if sum(same[s:e]) >= identity * (e - s)]
        s, e = decontaminate.best_run(np.array(same), identity)
        assert (sum(same[s:e]), s - e) == max([x for x in runs if x[0]], default=(0, 0))


def test_winnowing_leaves_a_fingerprint_in_every_window():
    h = np.random.default_rng(0).integers(0, 1 << 60, 200).astype(np.uint64)
    at = licenses.winnow(h, 4)
    assert all(((at >= i) & (at < i + 4)).any() for i in range(197))


def test_alignment_against_full_table():
    rng = random.Random(0)
    for _ in range(60):
        t = [rng.randrange(6) for _ in range(12)]
        x = t[:4] + [rng.randrange(6) for _ in range(rng.randrange(3))] + t[5:]
        best = 0
        table = [[0] * (len(x) + 1) for _ in range(len(t) + 1)]
        for i in range(1, len(t) + 1):
            for j in range(1, len(x) + 1):
                table[i][j] = max(0, table[i - 1][j - 1] + (2 if t[i - 1] == x[j - 1] else -1), table[i - 1][j] - 1, table[i][j - 1] - 1)
                best = max(best, table[i][j])
        padded = np.array([[-1] * 20 + x + [-1] * (len(t) + 20 - len(x)), [-1] * (len(t) + 40)])
        (matched, none), (s, _), (e, _) = licenses.align(np.array(t), padded, padded >= 0, 20)
        assert 20 <= s < e <= 20 + len(x) and 2 * matched >= best and none == 0


def test_license_scan_of_texts():
    own = licenses.index(licenses.TEMPLATES)
    header = licenses.TEMPLATES["Apache-2.0 header"]
    gapped = header.replace("you may not", "you really may not").replace("express or implied", "implied")
    texts = ["so. Released under the MIT License. And all rights reserved! x", gapped, "the license of a poet", "", None]
    found = licenses.scan_texts(pa.array(texts, pa.string()), own, 0.75, 4)
    assert {(r, own.names[t]) for r, t, *_ in found} == {(0, "MIT"), (0, "All rights reserved"), (1, "Apache-2.0 header"), (1, "Apache-2.0")}
    for r, t, m, c, s, e in found:
        if own.names[t] == "MIT":
            assert c == 1.0 and texts[r].encode()[s:e] == b"Released under the MIT License"


def best_cover(template, text):
    """The most words of ``template`` that a stretch of ``text`` of its length has at the same places."""
    n = len(template)
    return max([sum(x == y for x, y in zip(template, text[i : i + n])) for i in range(len(text) - n + 1)], default=0)


@pytest.mark.parametrize(("share", "least"), [(0.1, 0.995), (0.2, 0.98)])
def test_license_recall_of_changed_words(share, least):
    rng = random.Random(11)
    own, asked, found_ = licenses.index(licenses.TEMPLATES), 0, 0
    for name, text in licenses.TEMPLATES.items():
        plain = re.findall(r"[a-z0-9]+", text.lower())
        copies = [["x"] * rng.randrange(1, 9) + [w if rng.random() >= share else f"c{rng.randrange(50)}" for w in plain] + ["y"] * 5 for _ in range(60)]
        got = {(r, own.names[t]) for r, t, *_ in licenses.scan_texts(pa.array([" ".join(c) for c in copies]), own, 0.75, 4)}
        want = [r for r, c in enumerate(copies) if best_cover(plain, c) >= 0.75 * len(plain)]
        asked += len(want)
        found_ += sum((r, name) in got for r in want)
    assert found_ >= least * asked > 300


def test_license_with_words_put_in_and_left_out():
    own = licenses.index(licenses.TEMPLATES)
    found = licenses.scan_texts(pa.array(["Released under a MIT License.", "released under the very MIT license", "under the sun", "mit"]), own, 0.75, 4)
    assert {(r, own.names[t]) for r, t, *_ in found} == {(0, "MIT"), (1, "MIT")}


def test_noisy_or_against_the_formula():
    vocabulary = np.sort(np.array([words.hash_words("bad", words.PUNCTUATION)[0] ^ toxicity._WHOLE], dtype=np.uint64))
    model = toxicity.ToxicModel(vocabulary, np.array([3.0]), -2.0, 0.1)
    score, n, found = toxicity.score_texts(pa.array(["All good. Bad! bad bad.\nfine", "", None]), model, spans=True)
    p = lambda z: 1 / (1 + math.exp(-z))
    assert n.tolist() == [4, 0, 0]
    assert score[0] == pytest.approx(1 - 0.9 * (1 - p(-2)) ** 2 * (1 - p(1)) * (1 - p(4)))
    assert score[1] == score[2] == pytest.approx(0.1)
    assert [x["start"] for x in found[0]] == [10, 15]


def test_fit_finds_the_words_and_the_sentences():
    rng = random.Random(5)
    plain = lambda: " ".join(f"w{rng.randrange(400)}" for _ in range(8)) + "."
    labels = np.array([i % 5 == 0 for i in range(400)], dtype=np.int64)
    texts = [" ".join([plain() for _ in range(6)] + ([f"w{rng.randrange(400)} awful w{rng.randrange(400)}."] if y else []) + [plain()]) for y in labels]
    model = toxicity.fit(pa.array(texts), labels)
    score, _, found = toxicity.score_texts(pa.array([plain() * 3 + " Such an AWFUL one. " + plain(), plain() * 400]), model, spans=True)
    assert score[0] > 0.7 > score[1] and len(found[0]) == 1
    none = toxicity.fit(pa.array(["a"]), np.array([1]))
    assert len(none.features) == 0 and toxicity.fit(pa.array([], pa.string()), np.zeros(0)).leak > 0


def test_crc_of_nothing():
    assert zlib.crc32(b"") == 0
