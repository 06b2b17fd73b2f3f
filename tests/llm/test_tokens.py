"""BPE and packing against the public tokenizer libraries."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from helpers import ROWS, empty_documents, odd_documents, table
from tokenizers import Tokenizer

from tapeline.llm import bpe, packing
from tapeline.llm.queries import BPE_RANKS, PACK_TOKENIZER

RANKS = public_tokenizers.path(BPE_RANKS)
PACK = public_tokenizers.path(PACK_TOKENIZER)
ALPHABET = ["'", "s", "t", "re", "ll", "ve", "d", "m", " ", "  ", "\n", "\t", "\r\n", "a", "Z", "é", "日", "5", "٣", "!"]
ALPHABET += ["...", "$", " ", "　", "\x1c", "\x85", "𝒳", "<|endoftext|>"]


def random_texts(n, seed, most=14):
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABET, k=rng.randint(0, most))) for _ in range(n)]


def test_scan_finds_the_pattern_boundaries():
    texts = random_texts(3000, 3)
    raw = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    slices, _, cut = bpe.pre_tokens(b"".join(raw), offsets)
    for i, t in enumerate(texts):
        assert [s.decode() for s in slices[cut[i] : cut[i + 1]]] == regex.findall(public_tokenizers.PATTERN, t)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={}
    )


def test_merges_of_short_and_long_slices(reference):
    rng = random.Random(5)
    ranks = bpe.load_ranks(RANKS)
    for n in (1, 2, 7, 30, 64, 65, 400):
        for _ in range(20):
            piece = "".join(rng.choices("abcdeé", k=n)).encode()
            want = reference.encode_single_token(piece) if piece in ranks else None
            assert bpe.merge(piece, ranks) == ([want] if want is not None else bpe.merge_long(piece, ranks))
            assert bpe.merge_long(piece, ranks) == reference._encode_single_piece(piece) or piece in ranks


def test_round_trip(spark, reference):
    texts = random_texts(200, 6, 60) + [t for _, t in ROWS] + ["z" * 3000]
    docs = table(spark, list(enumerate(texts)))
    rows = bpe.decode(bpe.encode(docs, RANKS), RANKS).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id] or ""
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids == reference.encode_ordinary(text) and r.n_tokens == len(ids)
        assert bytes(r.decoded) == text.encode()
        starts = np.frombuffer(r.offsets, "<u4").tolist()
        pieces = [reference.decode_single_token_bytes(i) for i in ids]
        assert starts == [sum(map(len, pieces[:n])) for n in range(len(pieces))]
    assert bpe.decode(bpe.encode(empty_documents(spark), RANKS), RANKS).count() == 0
    assert bpe.encode(odd_documents(spark), RANKS).count() == len(ROWS)


def test_ids_are_those_of_tokenizers():
    theirs = Tokenizer.from_file(PACK)
    ours = packing.TokenIds(PACK)
    special = ["hello <|endoftext|> world", "a<|endoftext|><|endoftext|>b", "<|endoftext|", "<|endoftext|>", " <|endoftext|>\n"]
    for t in random_texts(1500, 7) + [t or "" for _, t in ROWS] + special:
        assert np.frombuffer(ours(t.encode()), "<u4").tolist() == theirs.encode(t, add_special_tokens=False).ids


def test_cut_document():
    assert packing.cut_document(5, 4) == [(0, 1), (1, 4)]
    assert packing.cut_document(8, 4) == [(0, 4), (4, 4)]
    assert packing.cut_document(1, 4) == [(0, 1)]


def test_best_fit_is_the_plain_rule():
    rng = random.Random(8)
    for _ in range(50):
        sizes = [rng.randint(1, 20) for _ in range(rng.randint(1, 60))]
        bins, offsets = packing.best_fit(sizes, 20)
        rooms, used = [], 0
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            fitting = [r for r in rooms if r >= sizes[i]]
            if fitting:
                rooms.remove(min(fitting))
                room = min(fitting)
            else:
                room, used = 20, used + 1
            rooms.append(room - sizes[i])
        assert max(bins) + 1 == used
        check_places([(b, o, s) for b, o, s in zip(bins, offsets, sizes)], 20)


def check_places(places, length):
    """Every sequence is filled from 0 without a gap, up to its length."""
    by = {}
    for seq, offset, size in places:
        by.setdefault(seq, []).append((offset, size))
    for spans in by.values():
        at = 0
        for offset, size in sorted(spans):
            assert offset == at
            at += size
        assert at <= length
    return len(by)


@pytest.mark.parametrize("group", [5, 50_000])
def test_packing(spark, group):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(6)
    rows = packing.pack(docs, PACK, group=group).collect()
    used = check_places([(r.sequence_id, r.offset, r.length) for r in rows], 2048)
    total = sum(r.length for r in rows)
    assert used <= 1.02 * -(-total // 2048) + 1
    theirs = Tokenizer.from_file(PACK)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for d in docs.collect():
        ids = theirs.encode(d.text or "", add_special_tokens=False).ids + [0]
        pieces = sorted(by.pop(d.doc_id), key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces)))
        assert sum(p.length for p in pieces) == len(ids) and all(p.length == 2048 for p in pieces[1:])
        for p in pieces:
            part = np.array(ids[p.start : p.start + p.length], "<u4").tobytes()
            assert zlib.crc32(part) == p.ids_crc32
    assert not by


def test_packing_of_edge_cases(spark):
    rows = packing.pack(odd_documents(spark), PACK).collect()
    check_places([(r.sequence_id, r.offset, r.length) for r in rows], 2048)
    assert sum(r.piece == 0 for r in rows) == len(ROWS)
    assert [(r.length, r.ids_crc32) for r in rows if r.doc_id in (2, 3)] == [(1, zlib.crc32(bytes(4)))] * 2
    assert packing.pack(empty_documents(spark), PACK).count() == 0
