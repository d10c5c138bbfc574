"""Encoding, counting and shard files against the libraries."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest_llm import TEXTS, tuples
from tokenizers import Tokenizer

from plurigrade.llm import bpe, grammar, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
BITS = ["a", "'s", "'", " ", "  ", "\n", "\t", "\r", "é", "à", "日", "1", "!", "the", "<|endoftext|>", " ", "\x0b", "\x1c", "\x85", "|", "<", "'ll", "\x00", "|>", "<|endoftext", "é,", "—", "a.", "b'", "▁", "<s>", "<unk>", "<0x0A>", "😀"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def random_texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choices(BITS, k=r.randint(0, 14))) for _ in range(n)]


def test_ids_and_text_as_the_library(library):
    texts = random_texts(20_000) + [t or "" for _, t in TEXTS]
    own = bpe.BytePairCodec(PATH)
    want = library.encode_batch(texts, add_special_tokens=False)
    got = own.encode([t.encode() for t in texts])
    for t, g, w in zip(texts, got, want, strict=True):
        assert g.tolist() == w.ids, repr(t)
        assert own.decode(g).decode("utf-8", "replace") == library.decode(w.ids, skip_special_tokens=False)


def test_unbroken_letters_are_cut_and_long_fragments_not_kept(library, monkeypatch):
    r = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    monkeypatch.setattr(bpe, "STEP", 700)
    monkeypatch.setattr(bpe, "DISTINCT", 60)
    monkeypatch.setattr(bpe, "MEMO", 900)
    own = bpe.BytePairCodec(PATH)
    texts = ["".join(r.choices(letters + r.choice(["", "'", "é", "7", " ", "'’"]), k=r.randint(1, 400))) for _ in range(1500)]
    texts += ["it'" + a + b + c for a in "rvlmtsdx" for b in "elqz" for c in ("", "qx", "é")]
    for i in range(0, len(texts), 100):
        part = texts[i : i + 100]
        for t, g in zip(part, own.encode([t.encode() for t in part]), strict=True):
            assert g.tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)
        assert all(len(f) <= bpe.LONGEST for f in own.memory.index)


def test_no_token_crosses_a_cut():
    own = bpe.BytePairCodec(PATH)
    text = b"The end, of it.\n\nNext line  here"
    data = np.frombuffer(text, dtype=np.uint8)
    cuts = own.cuts(data).tolist()
    assert cuts and all(not own.inside[data[c - 1], data[c]] for c in cuts)


def test_a_small_memory_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 5)
    own = bpe.BytePairCodec(PATH)
    for t in random_texts(300, 2):
        assert own.encode([t.encode()])[0].tolist() == library.encode(t, add_special_tokens=False).ids


def test_broken_bytes_decode_to_replacement(library):
    own = bpe.BytePairCodec(PATH)
    ids = library.encode("é日", add_special_tokens=False).ids[:1]
    assert own.decode(np.array(ids, dtype="<u4")).decode("utf-8", "replace") == library.decode(ids)


def test_round_trip_query(docs, empty, library):
    got = tuples(bpe.digest(bpe.round_trip(docs, PATH)))
    want = []
    for i, t in TEXTS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe.digest(bpe.round_trip(empty, PATH)).collect() == []
    again = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert tuples(again, "key", "decoded") == sorted(((i, t or "") for i, t in TEXTS), key=repr)


def test_counts_as_the_library(docs, empty):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    own = token_counts.MergeCounter(MODEL)
    for t in random_texts(5_000, 3):
        assert own.count(t) == len(model.encode(t)), repr(t)
    got = tuples(token_counts.token_counts(docs, MODEL))
    want = [(i, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for i, t in TEXTS]
    assert got == sorted(want, key=repr)
    assert token_counts.token_counts(empty, MODEL).collect() == []


def test_counts_of_unbroken_texts(monkeypatch):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    r = random.Random(5)
    monkeypatch.setattr(token_counts, "MEMO_BYTES", 30_000)
    monkeypatch.setattr(token_counts, "SEGMENT", 150)
    own = token_counts.MergeCounter(MODEL)
    for alphabet in ("a", "ab", "etaoin", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "日本語é☃😀x", "the \n\t"):
        for n in (1, 2, 47, 48, 49, 500, 3000):
            t = "".join(r.choices(alphabet, k=n))
            assert own.count(t) == len(model.encode(t)), repr(t)


def test_other_piece_models_are_refused():
    with open(MODEL, "rb") as f:
        data = f.read()
    token_counts.check_model(data)
    # A message of the model format that is met twice is merged, later fields winning: trainer of another kind, dropped spaces, a user's piece.
    for more in (b"\x12\x02\x18\x01", b"\x1a\x02\x20\x01", b"\x1a\x03\x12\x01x", b"\x0a\x05\x0a\x01q\x18\x04"):
        with pytest.raises(ValueError):
            token_counts.check_model(data + more)


def plain_counts(s):
    """How often each pair stands without overlapping itself."""
    out, last = Counter(), {}
    for i, p in enumerate(zip(s, s[1:], strict=False)):
        if last.get(p) != i - 1 or p[0] != p[1]:
            out[p] += 1
            last[p] = i
    return out


def test_grammar_ends_when_no_pair_is_frequent():
    r = np.random.RandomState(9)
    for ids in (np.full(5000, 7), np.full(15, 7), r.randint(0, 6, 20_000), r.zipf(1.3, 30_000) % 500, np.tile([1, 1, 2], 3000), np.tile(r.randint(0, 99, 37), 400)):
        g = grammar.compress(ids, 50_257)
        assert max(plain_counts(g["sequence"].tolist()).values(), default=0) < grammar.LEAST


def test_shard_files_are_smaller_than_short_ids():
    import duckdb

    rows = duckdb.sql("select coalesce(text, '') from '/root/testdata/sf0.01/documents.parquet' order by doc_id").fetchall()
    ids = np.concatenate(bpe.BytePairCodec(PATH).encode([t.encode() for (t,) in rows]))
    blob = grammar.pack(grammar.compress(ids, 50_257), np.array([len(ids)]), 50_257)
    assert len(blob) < 0.7 * 2 * len(ids)
    assert np.array_equal(grammar.read_range(blob, 1000, 2000), ids[1000:2000])


def test_packed_values_come_back(monkeypatch):
    monkeypatch.setattr(grammar, "_SLAB", 64)
    r = np.random.RandomState(2)
    for width in (1, 7, 8, 17, 31, 32):
        for n in (0, 1, 63, 64, 65, 1000):
            x = r.randint(0, 1 << width, n)
            assert np.array_equal(grammar.unpacked(b"ab" + grammar.packed(x, width), 2, n, width), x)


def test_grammar_round_trip_and_random_access():
    r = np.random.RandomState(4)
    for ids in (np.array([], dtype=np.int64), np.array([5]), np.full(5000, 7), r.randint(0, 6, 20_000), r.randint(0, 50_000, 3000), np.tile(r.randint(0, 99, 37), 400)):
        g = grammar.compress(ids, 50_257)
        blob = grammar.pack(g, np.array([len(ids)]), 50_257)
        parts, terminals = grammar.unpack(blob)
        assert np.array_equal(grammar.expand(parts["sequence"], parts, terminals), ids)
        for a, b in ((0, len(ids)), (len(ids) // 3, len(ids) // 2), (max(0, len(ids) - 1), len(ids))):
            assert np.array_equal(grammar.read_range(blob, a, b), ids[a:b])
    assert len(grammar.compress(np.tile([1, 2, 3], 5000), 10)["sequence"]) < 5000
    with pytest.raises(ValueError):
        grammar.unpack(blob[:-5] + bytes([blob[-5] ^ 1]) + blob[-4:])


@pytest.mark.parametrize("size", [1 << 20, 50])
def test_shards_are_laid_out_in_order(spark, docs, empty, library, tmp_path, monkeypatch, size):
    monkeypatch.setattr(grammar, "SHARD_IDS", size)
    path = f"file://{tmp_path}/shards"
    grammar.write_shards(docs, PATH, path)
    got = grammar.document_digests(spark, path).collect()
    ids = {t or "": library.encode(t or "", add_special_tokens=False).ids + [2] for _, t in TEXTS}
    crc = lambda t: (len(ids[t]), zlib.crc32(np.array(ids[t], dtype="<u4").tobytes()))
    assert sorted(map(repr, ((r.doc_id, r.n_tokens, r.ids_crc32) for r in got))) == sorted(map(repr, ((i, *crc(t or "")) for i, t in TEXTS)))
    laid = sorted(got, key=lambda r: r.start)
    assert [r.start for r in laid] == np.cumsum([0] + [r.n_tokens for r in laid[:-1]]).tolist()
    known = [r.doc_id for r in laid if r.doc_id is not None]
    assert known == sorted(known) and [r.doc_id for r in laid[-2:]] == [None, None]
    read = {(r.doc_id, r.start): r.ids for r in grammar.read_shards(spark, path).collect()}
    assert all(len(read[r.doc_id, r.start]) == r.n_tokens for r in got)


def test_no_documents_no_shards(spark, empty, tmp_path):
    path = f"file://{tmp_path}/none"
    grammar.write_shards(empty, PATH, path)
    assert grammar.document_digests(spark, path).collect() == []
