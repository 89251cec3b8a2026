import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tablesight.llm import packing
from tablesight.llm.queries import QUERIES, ranks_path

PUBLIC = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def expected_pieces(doc_id, text, capacity=2048):
    ids = PUBLIC.encode(text or "", add_special_tokens=False).ids + [0]
    first = (len(ids) - 1) % capacity + 1
    cuts = [0, *range(first, len(ids) + 1, capacity)]
    return [(doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def check(rows, capacity=2048):
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_ids_are_those_of_the_public_tokenizer():
    random = np.random.default_rng(4)
    parts = ["a", "word", " ", "  ", "\n", "\t", "\x1c", "\x85", "é", "1", "!", "'s", "<|endoftext|>", "ñ", "漢", " ", "\r\n", "😀", "_"]
    tokenizer = packing.encoder(ranks_path())
    for _ in range(2000):
        text = "".join(random.choice(parts, random.integers(0, 14)))
        assert packing.token_ids(text, tokenizer).tolist() == PUBLIC.encode(text, add_special_tokens=False).ids + [0], repr(text)


def test_pieces_and_places(documents):
    long = "thing of the day " * 3000
    rows = [(1, "some words", "a"), (2, None, None), (3, "", "a"), (4, long, "b"), (5, long[:9000], "b"), (1, "some words", "a"), (None, "no id", "a")]
    packed = packing.pack(packing.tokenise(documents(rows), ranks_path())).collect()
    assert check(packed) >= 1
    want = sorted(p for i, t, _ in rows for p in expected_pieces(i, t) if i is not None)
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed if r.doc_id is not None) == want


def test_sum_of_squares_is_near_the_least_number():
    lengths = np.minimum(np.random.default_rng(0).lognormal(6.2, 0.9, 4000).astype(int) + 1, 2048)
    bins, offsets = packing.sum_of_squares(lengths, 2048)
    used = np.zeros(bins.max() + 1, int)
    np.add.at(used, bins, lengths)
    assert used.max() <= 2048 and bins.max() + 1 <= -(-lengths.sum() // 2048) * 1.01 + 1


def test_empty_table(documents):
    assert packing.pack(packing.tokenise(documents([]), ranks_path())).count() == 0


def test_query(spark, sf_dir):
    rows = QUERIES["op1_packing"](spark, sf_dir).collect()
    tokens = sum(r.length for r in rows)
    assert check(rows) <= tokens / 2048 * 1.02 + 2
    want = sorted(p for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() for p in expected_pieces(r.doc_id, r.text))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
