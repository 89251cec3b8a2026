import hashlib
import random

from tablesight.llm import suffixes
from tablesight.llm.queries import QUERIES


def expected(rows, window=50):
    """By brute force: ``doc -> (bytes, removed, spans, digest)``."""
    least = {}
    raws = [(float("inf") if i is None else i, (t or "").encode()) for i, t in rows]
    for i, raw in raws:
        for p in range(len(raw) - window + 1):
            s = raw[p:p + window]
            least[s] = min(least.get(s, i), i)
    out = []
    for i, raw in raws:
        gone = bytearray(len(raw))
        for p in range(len(raw) - window + 1):
            if least[raw[p:p + window]] < i:
                gone[p:p + window] = b"\1" * window
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((None if i == float("inf") else i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in df.collect()), key=repr)


def test_passages_copies_and_periods(documents):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(2, 9)))
    passage, other = " ".join(word() for _ in range(30)), " ".join(word() for _ in range(12))
    rows = []
    for i in range(40):
        own = " ".join(word() for _ in range(rng.randint(0, 40)))
        rows.append((i * 3 % 41, own + rng.choice(["", passage, passage[20:90], other]) + own[:60] + rng.choice(["", "ab" * 60, "z" * 200])))
    rows += [(100, rows[5][1]), (101, rows[5][1][10:]), (102, None), (103, ""), (104, "x" * 49), (105, "x" * 50), (106, "x" * 51),
             (None, passage), (None, passage), (7, passage + "!"), (100, rows[5][1])]
    for some in (rows, rows[:1], [(5, None)]):
        assert result(suffixes.remove_repeats(documents([(i, t, "s") for i, t in some]))) == expected(some)


def test_long_texts_are_cut_without_loss(documents, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE_BYTES", 300)
    monkeypatch.setattr(suffixes, "CHUNK_BYTES", 500)
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    rows = [(1, text), (2, text[700:1900] + "?" + text[100:400]), (3, text[::-1]), (4, text)]
    assert result(suffixes.remove_repeats(documents([(i, t, "s") for i, t in rows]))) == expected(rows)


def test_empty_table(documents):
    assert suffixes.remove_repeats(documents([])).count() == 0


def test_query(spark, sf_dir):
    got = sorted((tuple(r) for r in QUERIES["op2_suffixes"](spark, sf_dir).collect()), key=repr)
    assert got == expected([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()])


def test_blocks_do_not_change_records_and_bound_their_memory(monkeypatch):
    import tracemalloc

    rng = random.Random(4)
    raws = ["".join(rng.choice("abc ") for _ in range(rng.choice((50, 51, 300, 40_000)))).encode() for _ in range(60)]
    pieces = [(raw, i, i, 0) for i, raw in enumerate(raws)]
    found = []
    for size in (1 << 30, 1000, 77):
        monkeypatch.setattr(suffixes, "BLOCK_BYTES", size)
        chunk = suffixes._records(pieces)
        found.append([c.tolist() for c in (chunk.first, chunk.last, chunk.anchor, chunk.digest, chunk.doc, chunk.start)])
    assert found[0] == found[1] == found[2]
    monkeypatch.undo()
    many = [(bytes(rng.choices(b"abcdefgh", k=500_000)), i, i, 0) for i in range(8)]
    tracemalloc.start()
    suffixes._records(many)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25 * 4_000_000
