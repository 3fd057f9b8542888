import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallywatch.llm import bpe, packing, wavelet, words


def library(name):
    tokenizer = Tokenizer.from_file(P.path(name))
    tokenizer.encode_special_tokens = True
    return tokenizer


TEXT = st.lists(st.sampled_from(["a", " ", "  ", "\n", "the", "Straße", "É", "é", "don't", "123", "🙂", " ", "　", "İ", "\x85", "\x1c", "<|endoftext|>", ".", "日本"]), max_size=14).map("".join)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_encode_as_whole_texts(name):
    whole = library(name)
    with open(P.path(name), encoding="utf-8") as file:
        encoder = words.library_encoder(file.read(), 2)
    encoder.limit = 40

    @settings(max_examples=150, deadline=None)
    @given(st.lists(TEXT, min_size=1, max_size=6))
    def check(texts):
        ids, counts = encoder(texts)
        at = np.cumsum(counts) - counts
        got = [ids[a : a + n].tolist() for a, n in zip(at, counts)]
        assert got == [whole.encode(t, add_special_tokens=False).ids + [2] for t in texts]

    check()


def test_wavelet_matrix_against_a_list():
    rng = np.random.default_rng(5)
    for n, top in ((0, 1), (1, 1), (7, 3), (512, 2), (513, 70000), (3000, 40), (2000, 50257)):
        ids = rng.integers(0, top, n).astype(np.uint32)
        matrix = wavelet.WaveletMatrix.frombytes(wavelet.WaveletMatrix.build(ids).tobytes())
        assert (matrix.decode() == ids).all() and len(matrix.decode()) == n
        if not n:
            continue
        at = rng.integers(0, n, 50)
        assert (matrix.access(at) == ids[at]).all()
        for token in {int(ids[0]), int(ids[-1]), top + 5}:
            places = np.nonzero(ids == token)[0]
            a, b = sorted(rng.integers(0, n + 1, 2).tolist())
            assert matrix.count(token, a, b) == ((places >= a) & (places < b)).sum()
            assert matrix.occurrences(token).tolist() == places.tolist()
            assert [matrix.select(token, k) for k in range(min(3, len(places)))] == places[:3].tolist()
        with pytest.raises(IndexError):
            matrix.select(int(ids[0]), n)


def test_token_shards(odd_docs, no_docs):
    whole = library("byte_bpe_50k.json")
    shards = wavelet.token_shards(odd_docs, P.path("byte_bpe_50k.json"), shard_tokens=20)
    rows = sorted(wavelet.read_tokens(shards).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows][0] is None and [r.doc_id for r in rows][1:] == sorted(r.doc_id for r in rows[1:])
    assert len(rows) == odd_docs.count()
    texts = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    at = 0
    for r in rows:
        ids = np.array(whole.encode(texts[r.doc_id], add_special_tokens=False).ids + [2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert wavelet.read_tokens(wavelet.token_shards(no_docs, P.path("byte_bpe_50k.json"))).count() == 0


def test_byte_bpe(odd_docs, no_docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    whole = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = bpe.document_digests(odd_docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert len(rows) == odd_docs.count()
    texts = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    for r in rows:
        ids = np.array(whole.encode_ordinary(texts[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    full = bpe.encode_documents(odd_docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).where("doc_id = 9").first()
    assert full.decoded.decode() == texts[9]
    assert bpe.document_digests(no_docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_perfect_hash_is_minimal():
    keys = [str(i).encode() for i in range(3000)]
    table = bpe.PerfectHash(keys)
    assert sorted(table(keys).tolist()) == list(range(3000)) and table(keys).tolist() == table.places.tolist()


@settings(max_examples=150, deadline=None)
@given(st.binary(min_size=1, max_size=30))
def test_heap_merges_as_repeated_search(piece):
    ranks = {bytes([i]): i for i in range(256)} | {piece[i:j]: 256 + (i * 7 + j * 3) % 50 * 31 + i + 40 * j for i in range(len(piece)) for j in range(i + 2, len(piece) + 1, 2)}
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        pairs = [(ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1)]
        rank, i = min(pairs)
        if rank == 1 << 40:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    assert bpe.merge(piece, ranks) == [ranks[p] for p in parts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=40), st.integers(1, 9))
def test_differencing_keeps_every_item(sizes, windows):
    sets = packing.difference(np.array(sizes), windows)
    assert sorted(i for s in sets for i in s) == list(range(len(sizes))) and len(sets) == windows
    packed = packing.windows_for(np.array(sizes), 100)
    assert sorted(i for s in packed for i in s) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in s) <= 100 for s in packed)


def test_packing(odd_docs, no_docs):
    whole = library("word_bpe_49k.json")
    rows = packing.pack_documents(odd_docs, P.path("word_bpe_49k.json"), capacity=256).collect()
    texts = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    by_doc, by_window = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_window.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length
    for doc, pieces in by_doc.items():
        if doc == 5:  # a repeated row is packed twice
            continue
        ids = np.array(whole.encode(texts[doc], add_special_tokens=False).ids + [2], "<u4").tobytes()
        assert b"".join(r.ids for r in sorted(pieces, key=lambda r: r.start)) == ids
        assert {r.doc_tokens for r in pieces} == {len(ids) // 4}
    for pieces in by_window.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    assert len(by_doc[5]) == 2
    assert packing.pack_documents(no_docs, P.path("word_bpe_49k.json")).count() == 0


def test_windows_are_near_equal():
    sizes = np.random.default_rng(1).integers(1, 1200, 2000)
    packed = packing.windows_for(sizes, 4096)
    fill = np.array([sizes[s].sum() for s in packed])
    assert fill.max() <= 4096 and 1 - fill.sum() / (4096 * len(fill)) < 0.02


def test_many_tiny_pieces_are_bundled(monkeypatch):
    seen = []
    real = packing.difference
    monkeypatch.setattr(packing, "difference", lambda sizes, windows: seen.append(len(sizes)) or real(sizes, windows))
    sizes = np.ones(300_000, np.int64)
    sizes[::1000] = 300
    packed = packing.windows_for(sizes, 4096)
    assert max(seen) < 8192
    assert sorted(i for s in packed for i in s) == list(range(len(sizes)))
    assert max(int(sizes[s].sum()) for s in packed) <= 4096 and len(packed) <= 1.05 * sizes.sum() / 4096


def test_packing_a_partition_of_empty_texts(spark):
    docs = spark.range(300_000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN '' WHEN id % 3 = 1 THEN 'word' END AS text").coalesce(1)
    rows = packing.pack_documents(docs, P.path("word_bpe_49k.json"), with_ids=False).toPandas()
    assert sorted(rows.doc_id) == list(range(300_000))
    fill = rows.groupby("sequence_id").length.sum()
    assert fill.max() <= 4096 and fill.sum() == rows.doc_tokens.sum() and len(fill) <= 1.05 * fill.sum() / 4096 + 1


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_special_strings_get_their_ids(spark, name):
    plain = Tokenizer.from_file(P.path(name))
    said = [t.content for t in plain.get_added_tokens_decoder().values()]
    texts = ["a <|endoftext|> b", "a b c", *[x for s in said for x in (f"a {s} b", f"{s}{s}", f" word{s}word  {s} ", s[:-1])]]
    want = {d: np.array(plain.encode(t, add_special_tokens=False).ids + [2], "<u4") for d, t in enumerate(texts)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = wavelet.read_tokens(wavelet.token_shards(docs, P.path(name))).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in got} == {d: (len(x), zlib.crc32(x.tobytes())) for d, x in want.items()}
    packed = packing.pack_documents(docs, P.path(name)).collect()
    assert {r.doc_id: bytes(r.ids) for r in packed} == {d: x.tobytes() for d, x in want.items()}


def test_a_distinct_piece_is_looked_up_once():
    from tallywatch.llm.words import PieceEncoder

    class Counted(dict):
        asked = 0

        def get(self, *key):
            self.asked += 1
            return dict.get(self, *key)

        def __contains__(self, key):
            self.asked += 1
            return dict.__contains__(self, key)

        def __getitem__(self, key):
            self.asked += 1
            return dict.__getitem__(self, key)

    encoder = PieceEncoder(lambda pieces, lead: (np.fromiter((len(p) for p in pieces), np.uint32), np.ones(len(pieces), np.int64)), end_id=99)
    encoder.later = Counted()
    for texts, ids in ((["a bb ccc bb", "a\t bb"], [1, 2, 3, 2, 99, 5, 99]), (["q bb dddd eeeee"], [1, 2, 4, 5, 99])):
        assert encoder(texts)[0].tolist() == ids
    assert encoder.later.asked == 2 + 3


def test_the_library_gets_a_few_strings_at_a_time(monkeypatch):
    import tokenizers

    asked = []

    class Watched:
        def __init__(self, real):
            self.__dict__["real"] = real

        def __getattr__(self, name):
            return getattr(self.real, name)

        def __setattr__(self, name, value):
            setattr(self.real, name, value)

        def encode_batch_fast(self, texts, **more):
            asked.append(len(texts))
            return self.real.encode_batch_fast(texts, **more)

    real = tokenizers.Tokenizer
    monkeypatch.setattr(tokenizers, "Tokenizer", type("T", (), {"from_str": staticmethod(lambda text: Watched(real.from_str(text)))}))
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as file:
        encoder = words._library_encoder(file.read(), 2, 600_000, True)
    texts = [f"head{i} " + " ".join(f"piece{i}x{k}" for k in range(50)) for i in range(1000)]
    assert len(encoder(texts)[1]) == 1000
    assert sum(asked) >= 1000 and max(asked) <= 32


def test_a_wavelet_matrix_of_random_ids_costs_like_one_of_equal_ids():
    import time

    def least(work):
        took = []
        for _ in range(5):
            begun = time.process_time()
            work()
            took.append(time.process_time() - begun)
        return min(took)

    n = 1 << 18
    mixed, even = np.random.default_rng(3).integers(0, 1 << 16, n).astype(np.uint32), np.full(n, (1 << 16) - 1, np.uint32)
    one, two = wavelet.WaveletMatrix.build(mixed), wavelet.WaveletMatrix.build(even)
    assert (one.decode() == mixed).all() and (two.decode() == even).all()
    assert least(lambda: wavelet.WaveletMatrix.build(mixed)) < 4 * least(lambda: wavelet.WaveletMatrix.build(even))
    assert least(one.decode) < 4 * least(two.decode)


MARKED = st.lists(st.sampled_from(["a", "Ab9", "é", "Ö", "×", "÷", "'s", "'", ".", "!!", "(", "_", "\n", "\n\n", "\t", " ", "  ", "½", "̸", "<|endoftext|>", "日"]), max_size=16).map("".join)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_runs_encode_as_whole_texts(name):
    whole = library(name)
    with open(P.path(name), encoding="utf-8") as file:
        encoder = words.library_encoder(file.read(), 2, 60)

    @settings(max_examples=200, deadline=None)
    @given(st.lists(MARKED, min_size=1, max_size=6))
    def check(texts):
        ids, counts = encoder(texts)
        at = np.cumsum(counts) - counts
        assert [ids[a : a + n].tolist() for a, n in zip(at, counts)] == [whole.encode(t, add_special_tokens=False).ids + [2] for t in texts]

    check()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_a_word_is_encoded_once_whatever_marks_follow(name):
    whole = library(name)
    with open(P.path(name), encoding="utf-8") as file:
        encoder = words._library_encoder(file.read(), 2, 600_000, False)
    real, asked = encoder.encode, []
    encoder.encode = lambda pieces, lead: asked.extend(pieces) or real(pieces, lead)
    names = [f"q{chr(97 + i)}{chr(97 + k)}w" for i in range(20) for k in range(20)]
    text = "begin " + " ".join(f"{n}{mark}" for n in names for mark in ("", ".", ",", "!!", ")", ".\nThen", "$$$"))
    ids, counts = encoder([text])
    assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids + [2]
    assert len(asked) <= len(names) + 10
