import random

import numpy as np
from pyspark.sql import functions as F

from tablesight.llm import jaccard
from tablesight.llm.links import components
from tablesight.llm.queries import QUERIES


def shingles(text, n):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i:i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else [])


def expected(rows, n=4, percent=85):
    """By brute force: ``(id, size, component)`` of every row; null ids are known by their row."""
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    ids = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            ids[root(a)] = min(i, ids.get(root(a), i))
    return sorted(((i, len(sets[a]), ids.get(root(a))) for a, (i, _) in enumerate(rows)), key=repr)


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def corpus(seed, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    common = [word() for _ in range(30)]
    bases = [[word() for _ in range(rng.randint(10, 120))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = word()
        if rng.random() < 0.4:
            words += common
        rows.append((i * 7 % n, " ".join(words).title() if i % 3 else "\n".join(words)))
    return rows + [(500, None), (501, ""), (502, " \t\n"), (503, "two words"), (504, "Two  words"), (505, "two words more"),
                   (None, rows[3][1]), (None, "alone with null id in here"), (3, rows[9][1]), rows[4], rows[4]]


def test_links_match_brute_force(documents, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_NGRAMS", 900)
    for seed in (1, 2):
        rows = corpus(seed)
        assert result(jaccard.link(documents([(i, t, "s") for i, t in rows]))) == expected(rows)
    rows = corpus(3, 60)
    assert result(jaccard.link(documents([(i, t, "s") for i, t in rows]), ngram=5, percent=80)) == expected(rows, 5, 80)


def test_pairs_that_share_no_cell(documents, monkeypatch):
    """With a cell for every node, all links must come from the pairs that are counted at the end."""
    monkeypatch.setattr(jaccard, "_cells", lambda postings: postings.groupBy("node").agg(
        F.first("n").alias("n"), F.first("doc").alias("doc")).withColumn("cell", F.col("node")))
    rows = corpus(5, 50)
    assert result(jaccard.link(documents([(i, t, "s") for i, t in rows]))) == expected(rows)


def test_block_links_spans_all_links():
    random_ = np.random.default_rng(0)
    base = random_.integers(0, 1 << 60, 200, dtype=np.uint64)
    sets = [np.unique(np.where(random_.random(200) < 0.04, random_.integers(0, 1 << 60, 200, dtype=np.uint64), base)) for _ in range(60)]
    found = jaccard.block_links(sets, np.zeros(60, int), 85)
    links = {(a, b) for a in range(60) for b in range(a + 1, 60)
             if 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))}
    assert set(found) <= links and len(found) < 60
    parent = list(range(60))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in found:
        parent[root(b)] = root(a)
    assert all(root(a) == root(b) for a, b in links)


def test_empty_table(documents):
    assert jaccard.link(documents([])).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, j) for j in range(200, 240)] + [(5, 5), (240, 239)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 141)) and all(got[j] == 7 for j in range(200, 241)) and 5 not in got


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert result(QUERIES["op9_jaccard"](spark, sf_dir)) == expected(rows)


def test_signatures_never_discard_a_link():
    random_ = np.random.default_rng(1)
    sets = []
    for n in (3, 40, 300, 300, 3000):
        base = random_.integers(0, 1 << 64, n, dtype=np.uint64)
        for share in (0, 0.02, 0.05, 0.3):
            sets.append(np.unique(np.where(random_.random(n) < share, random_.integers(0, 1 << 64, n, dtype=np.uint64), base)))
    sets += [s[: int(len(s) * 0.86)] for s in sets]
    sizes = np.array([len(s) for s in sets])
    may = jaccard.may_link(sizes, np.zeros(len(sets), int), [jaccard.signature(s).astype("i2") for s in sets], 85)
    for a, x in enumerate(sets):
        if any(b != a and 100 * len(np.intersect1d(x, y)) >= 85 * len(np.union1d(x, y)) for b, y in enumerate(sets)):
            assert may[a]
    alone = [np.unique(random_.integers(0, 1 << 64, 400, dtype=np.uint64)) for _ in range(20)]
    assert not jaccard.may_link(np.array([len(s) for s in alone]), np.zeros(20, int), [jaccard.signature(s).astype("i2") for s in alone], 85).any()
