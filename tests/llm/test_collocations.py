import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tablesight.llm import collocations


def plain(rows, least, cover=80, top=2000):
    """The same from dictionaries of all phrases."""
    counts = defaultdict(Counter)
    for lang, text in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            for m in range(1, 5):
                counts["und" if lang is None else lang].update(tuple(words[i:i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            inside = any(len(q) > len(p) and 100 * b >= cover * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in candidates.items())
            if not inside:
                cuts = [(2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
                s, _, l, r = min(cuts)
                found.append((-s, -a, " ".join(p).encode(), l, r))
        found.sort()
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(found[:top])]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame([(k, lang, text, "x", "y") for k, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, shard string, total string")
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in collocations.mine(df, **options).select(names).collect())


def corpus(seed, documents=120):
    random = np.random.default_rng(seed)
    words = ["a", "B", "c", "New", "york", "é", "x1", "das", "\x1c", "a b"]
    weights = np.array([9, 6, 3, 3, 3, 2, 2, 1, 1, 1]) / 31
    ends = [" ", "  ", "\t", ", ", ".", "\n", "\x0b", "!"]
    out = []
    for _ in range(documents):
        parts = []
        for _ in range(random.integers(0, 60)):
            parts += [random.choice(words, p=weights), random.choice(ends, p=[.6, .1, .1, .06, .05, .04, .025, .025])]
        out.append((random.choice(["en", "de"]), "".join(parts)))
    return out


@pytest.mark.parametrize("shard_words", [50, 1_000_000])
def test_equals_plain_counting(spark, shard_words):
    rows = corpus(1) + [(None, "in the end, in the end"), ("en", None), ("en", ""), ("de", "...")]
    assert mined(spark, rows, least=2, shard_words=shard_words) == plain(rows, 2)
    assert mined(spark, rows, least=5, cover=50, top=7, shard_words=shard_words) == plain(rows, 5, 50, 7)


def test_one_long_text_and_many_copies(spark):
    rows = [("en", "to be or not to be " * 20_000)] + [("en", "Some words, some words again")] * 300 + [("fr", "z " * 5_000)]
    assert mined(spark, rows) == plain(rows, 30)


def test_ties_are_cut_by_phrase(spark):
    rows = [("en", f"w{k:03d} v{k:03d}") for k in range(90) for _ in range(3)]
    got = mined(spark, rows, least=3, top=40)
    assert got == plain(rows, 3, top=40) and [r[2] for r in got] == [f"w{k:03d} v{k:03d}" for k in range(40)]


def test_no_words(spark):
    assert mined(spark, []) == [] and mined(spark, [(None, None), ("en", " \t. ")]) == []


def test_intervals_count_phrases():
    random = np.random.default_rng(3)
    codes = collocations.one_separator(random.integers(0, 5, 400).astype(np.int32))
    index = collocations.Index(codes)
    found = index.single()
    for left in (True, False, True):
        found = index.extend(found, left)
        m = found[0].shape[1]
        want = Counter(tuple(codes[i:i + m].tolist()) for i in range(len(codes) - m + 1) if codes[i:i + m].all())
        assert dict(zip(map(tuple, found[0].tolist()), found[3].tolist())) == want


def test_left_and_right_extensions(spark):
    rows = [("en", "one two three")] * 4 + [("en", "two three four")] * 3 + [("en", "two three")] * 5
    df = spark.createDataFrame(rows, "lang string, text string")
    [row] = [r for r in collocations.mine(df, least=3).collect() if r.phrase == "two three"]
    assert (row.a, row.left, row.right) == (12, 4, 3)


def test_phrases_travel_packed(spark, monkeypatch):
    """What a shard sends of a text without repeats is a few bytes a pair, also when all its pairs are frequent."""
    random = np.random.default_rng(5)
    words = np.array([f"word{k}" for k in range(3_000)])
    text = " ".join(words[np.minimum(random.zipf(1.2, 60_000), 3_000) - 1])
    df = spark.createDataFrame([("en", text), ("en", text)], "lang string, text string").repartition(2)
    stored = []
    monkeypatch.setattr(collocations, "store", lambda rows, store=collocations.store: stored.append(store(rows)) or stored[-1])
    phrases, _, _ = collocations.count_phrases(df, least=2)
    sizes = dict(phrases.groupBy("size").count().collect())
    [told] = [d for d in stored if "owner" in d.columns]
    assert sizes[2] > 15_000 and told.where("owner is not null").count() <= 2 * 4
    assert told.selectExpr("sum(length(data))").first()[0] < 3 * 2 * sizes[2]


def test_blocks_hold_every_phrase_once():
    random = np.random.default_rng(6)
    table = np.unique(random.integers(1, [4, 2**31 - 1, 300], (5_000, 3)), axis=0).T
    counts = random.integers(1, 2**31 - 1, table.shape[1])
    held, data = collocations.blocks(list(table), counts, 7)
    assert held == sorted(set(held)) and set(held) <= set(range(7))
    back, ends = collocations.gathered([pa.scalar(d) for d in data])
    assert ends[-1] == table.shape[1] and sorted(map(tuple, back.T.tolist())) == sorted(map(tuple, np.vstack([table, counts]).T.tolist()))


def test_equal_words_of_languages_and_of_many_shards(spark):
    rows = [(lang, " ".join(random.choice(list("abcdefgh"), 400))) for lang, seed in (("en", 1), ("de", 2), (None, 3)) for random in [np.random.default_rng(seed)] for _ in range(9)]
    assert mined(spark, rows, least=3, shard_words=300) == plain(rows, 3)


def test_ties_beyond_the_rank_are_all_seen(spark):
    rows = [("en", f"v{k:03d} w{k:03d} x{k:03d}") for k in range(300) for _ in range(3)] + [("en", "v000")] * 3
    assert mined(spark, rows, least=3, top=5) == plain(rows, 3, top=5)
