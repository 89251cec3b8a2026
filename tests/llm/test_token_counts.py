import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tablesight.llm import token_counts
from tablesight.llm.queries import QUERIES

BYTES, WORDS, PIECES = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
SAMPLES = [None, "", " ", "word", "two  words\n\n and\tmore ", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "漢字 é́ 😀", "\x1c a \x1d", "\x85   x", "x" * 3000, "a b " * 700]


def public(path):
    if path.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(model.encode(t))
    model = Tokenizer.from_file(path)
    return lambda t: len(model.encode(t, add_special_tokens=False).ids)


def got(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in df.collect()), key=repr)


def want(rows, path, limit=1024):
    n = public(path)
    return sorted(((i, len((t or "").encode()), n(t or ""), n(t or "") > limit) for i, t, *_ in rows), key=repr)


@pytest.fixture
def cache(tmp_path):
    return str(tmp_path / "counts")


@pytest.mark.parametrize("path", [BYTES, WORDS, PIECES])
def test_counts_are_those_of_the_library(spark, documents, cache, path):
    rows = [(k, t, "a") for k, t in enumerate(SAMPLES)] + [(3, "word", "b"), (None, "word", "a"), (None, None, None)]
    assert got(token_counts.count(documents(rows), path, cache)) == want(rows, path)


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert got(QUERIES["op13_token_counts"](spark, sf_dir)) == want(rows, BYTES)


def test_chunks_add_up():
    counter, n = token_counts.Counter(BYTES), public(BYTES)
    random = np.random.default_rng(4)
    parts = ["a", "word", " ", "  ", "\n", "\t", "\x1c", "\x85", "é", "1", "!", "'s", "<|endoftext|>", "\xa0", "漢", " ", "\r\n", "😀", "_"]
    for _ in range(2000):
        text = "".join(random.choice(parts, random.integers(0, 14)))
        assert counter.count(text) == n(text), repr(text)
    assert counter.by_chunk and not token_counts.Counter(WORDS).by_chunk


def test_windows_of_long_texts(monkeypatch):
    monkeypatch.setattr(token_counts, "WINDOW", 50)
    monkeypatch.setattr(token_counts, "MEMO", 20)
    text = " ".join(f"w{k * k}  \n{'y' * (k % 90)}" for k in range(400)) + " \t "
    assert token_counts.Counter(BYTES).count(text) == public(BYTES)(text)


def stored(spark, cache):
    return spark.read.parquet(cache).count()


def test_only_distinct_misses_are_encoded_and_appended(spark, documents, cache):
    first = [(k, f"text {k % 5}", "a") for k in range(40)]
    assert got(token_counts.count(documents(first), BYTES, cache)) == want(first, BYTES)
    assert stored(spark, cache) == 5
    # Stored counts are used: a changed one comes back.
    digest = token_counts.tokenizer_digest(BYTES)
    changed = token_counts.cached(spark, cache, digest).selectExpr("content", "n_tokens + 100 AS n_tokens").collect()
    spark.createDataFrame(changed, token_counts.CACHE).write.mode("overwrite").parquet(f"{cache}/tokenizer={digest}")
    more = first[:3] + [(100, "text 77", "a"), (101, "text 77", "a")]
    again = got(token_counts.count(documents(more), BYTES, cache))
    assert again == sorted([(i, b, n + (100 if i < 100 else 0), o) for i, b, n, o in want(more, BYTES)], key=repr)
    assert stored(spark, cache) == 6


def test_another_tokenizer_has_its_own_counts(spark, documents, cache):
    rows = [(1, "Some Words", "a"), (2, "Some Words", "a")]
    for path in (BYTES, PIECES, BYTES):
        assert got(token_counts.count(documents(rows), path, cache)) == want(rows, path)
    assert stored(spark, cache) == 2


def test_many_misses_take_the_other_way(spark, documents, cache, monkeypatch):
    monkeypatch.setattr(token_counts, "FEW_MISSES", 2)
    monkeypatch.setattr(token_counts, "HOT_SHARE", 3)
    rows = [(k, "hot text" if k % 2 else f"text {k}", "a") for k in range(60)]
    token_counts.count(documents(rows[:9]), BYTES, cache)
    assert got(token_counts.count(documents(rows), BYTES, cache)) == want(rows, BYTES)
    assert stored(spark, cache) == 31


def test_empty_table(documents, cache):
    assert token_counts.count(documents([]), BYTES, cache).collect() == []


def test_invalid_utf8_counts_with_replacement(spark, cache):
    df = spark.sql("SELECT 1L AS doc_id, cast(x'61ff62' AS string) AS text")
    assert got(token_counts.count(df, BYTES, cache)) == want([(1, "a�b")], BYTES)
