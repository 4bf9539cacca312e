"""Token counts, byte-level BPE: against the libraries."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gleaner.llm import byte_bpe, token_counts
from gleaner.llm.bytelevel import Recent, read_ranks

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
LIBRARY = Tokenizer.from_file(JSON)
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})
TEXTS = st.text(st.sampled_from("ab 'tserlvmd\n\t1é日😀<|>.Ѐ՘"), max_size=40)


def count(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@given(TEXTS)
@settings(max_examples=150, deadline=None)
def test_every_prefix(text):
    deltas = token_counts.counter(JSON).deltas(text)
    assert np.cumsum(deltas).tolist() == [count(text[: k + 1]) for k in range(len(text))]


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|endoftext|><|endoftext|", "we're '  's", " " * 90 + "x", "\n\n\nfoo  \n bar", "ab!<|endoftext|>"])
def test_prefixes_of_special_texts(text):
    deltas = token_counts.counter(JSON).deltas(text)
    assert np.cumsum(deltas).tolist() == [count(text[: k + 1]) for k in range(len(text))]


def test_token_counts(docs, rows, no_docs):
    found = token_counts.token_counts(docs, JSON, 100)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in found.collect())
    want = sorted((i is None, i or 0, len((t or "").encode()), count(t or ""), count(t or "") > 100) for i, t, *_ in rows)
    assert got == want
    assert token_counts.token_counts(no_docs, JSON, 100).count() == 0


def test_budgets_from_stored_tables(docs, rows):
    tables = token_counts.prefix_tables(docs.where("doc_id BETWEEN 1 AND 5"), JSON)
    texts = {i: t for i, t, *_ in rows}
    for r in token_counts.answer(tables, [0, 7, 100_000]).collect():
        text = texts[r["doc_id"]]
        if r["budget"] == 100_000:
            assert r["chars"] == len(text)
        else:
            assert count(text[: r["chars"]]) <= r["budget"]
            assert all(count(text[:k]) > r["budget"] for k in range(r["chars"] + 1, r["chars"] + 12))


@given(TEXTS)
@settings(max_examples=200, deadline=None)
def test_encode_and_decode(text):
    codec = byte_bpe.codec(RANKS, public_tokenizers.PATTERN)
    ids = codec.encode(text)
    assert ids.tolist() == TIKTOKEN.encode_ordinary(text)
    assert "".join(codec.decode(ids, 2)) == text


@given(st.lists(st.integers(0, 255), max_size=12))
@settings(max_examples=300, deadline=None)
def test_stream_decoder_on_any_bytes(data):
    names = {i: bytes([i]) for i in range(256)}
    decoder = byte_bpe.StreamDecoder(names)
    text = "".join(decoder.feed([b]) for b in data) + decoder.finish()
    assert text == bytes(data).decode("utf-8", "replace")


def test_transducer_with_other_ranks():
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 256, b"aaa": 257, b"ab": 258, b"aab": 259, b"ba": 260}
    transducer = byte_bpe.Transducer(ranks)
    own = tiktoken.Encoding("small", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    for n in range(1, 9):
        for code in range(2**n):
            text = "".join("ab"[code >> i & 1] for i in range(n))
            assert transducer.encode(text.encode()) == own.encode_ordinary(text)


@given(st.lists(st.integers(0, 255), max_size=12), st.integers(1, 5))
@settings(max_examples=300, deadline=None)
def test_stream_decoder_in_chunks(data, size):
    decoder = byte_bpe.StreamDecoder({i: bytes([i]) for i in range(256)})
    parts = [data[i : i + size] for i in range(0, len(data), size)]
    assert "".join(map(decoder.feed, parts)) + decoder.finish() == bytes(data).decode("utf-8", "replace")


@given(st.lists(st.text(st.sampled_from("abé日 1-."), min_size=1, max_size=60), min_size=1, max_size=30))
@settings(max_examples=100, deadline=None)
def test_pieces_read_together(pieces):
    codec = byte_bpe.codec(RANKS, public_tokenizers.PATTERN)
    data = [p.encode() for p in pieces]
    tokens, offsets, read = codec._lanes.encode(data)
    for i, piece in enumerate(data):
        if read[i]:
            assert tokens[offsets[i] : offsets[i + 1]].tolist() == codec._transducer.encode(piece)


def test_states_that_are_too_wide_are_left(monkeypatch):
    from gleaner.llm import lanes

    own = byte_bpe.Transducer(read_ranks(RANKS))
    together = lanes.Lanes(own.trie, own.ending, own.adjacent)
    pieces = [b" " * 90, b"abc", b"-" * 60]
    tokens, offsets, read = together.encode(pieces)
    assert read[1] and not read.all()
    assert all(tokens[offsets[i] : offsets[i + 1]].tolist() == own.encode(p) for i, p in enumerate(pieces) if read[i])
    monkeypatch.setattr(lanes, "STATES", 0)  # begins anew for each batch
    tokens, offsets, read = together.encode([b"hello", b" world"])
    assert read.all() and np.split(tokens, offsets[1:-1])[1].tolist() == TIKTOKEN.encode_ordinary(" world")


def test_table_of_numbers():
    from gleaner.llm.lanes import IntMap

    draw = np.random.default_rng(0)
    keys = np.unique(draw.integers(0, 1 << 60, 5000))
    table = IntMap(4)
    for part in np.array_split(draw.permutation(keys), 7):
        table.put(part, (part % 1000).astype(np.int32))
    assert (table.get(keys) == keys % 1000).all() and (table.get(keys + 1)[~np.isin(keys + 1, keys)] == -1).all()


def test_long_pieces(monkeypatch):
    monkeypatch.setattr(byte_bpe, "STATES", 300)
    monkeypatch.setattr(byte_bpe, "PART", 7)
    codec = byte_bpe.Codec(RANKS, public_tokenizers.PATTERN)
    draw = np.random.default_rng(1)
    for size in (30, 200, 20_000):
        text = "".join(draw.choice(list("abcdeéß日"), size))
        ids = codec.encode(text)
        assert ids.tolist() == TIKTOKEN.encode_ordinary(text) and "".join(codec.decode(ids)) == text
    assert len(codec._transducer._states) <= 320
    codec.clear()
    assert codec._lanes._state.size == 1 and len(codec._ids) == 0


def test_pattern_for_ascii():
    fast = byte_bpe.ascii_pattern(public_tokenizers.PATTERN)
    text = " it's 12 3.4!? \x1c \x85 \x0b tab\t\n\n  x's'll\x7f_"
    plain = "".join(c for c in text if c.isascii())
    assert fast.findall(plain) == byte_bpe.codec(RANKS, public_tokenizers.PATTERN)._pattern.findall(plain)
    assert byte_bpe.ascii_pattern(r"\p{Lu}+") is None


def test_round_trip(docs, rows, no_docs):
    found = byte_bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN, ids=True)
    got = sorted((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], bytes(r["ids"])) for r in found.collect())
    want = []
    for _, t, *_ in rows:
        ids = np.array(TIKTOKEN.encode_ordinary(t or ""), "<u4").tobytes()
        want.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids))
    assert got == sorted(want)
    back = byte_bpe.decoded(byte_bpe.encoded(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert sorted(r["text"] for r in back.collect()) == sorted(t or "" for _, t, *_ in rows)
    assert byte_bpe.round_trip(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0


def test_recent_keeps_what_is_used():
    made = []
    memo = Recent(lambda k: made.append(k) or k * 2, size=3)
    for k in (1, 2, 3, 4, 1, 5, 1):
        assert memo[k] == 2 * k
    assert len(memo) <= 3 and made.count(1) == 1
