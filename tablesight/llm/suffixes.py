"""Removal of repeated byte strings across documents with a sparse suffix array.

A string of ``WINDOW`` bytes counts as repeated when it also starts in a document with a smaller id. Suffixes are taken at
anchors only: of the k-grams in a window, the one with the smallest digest, which equal windows share. Consecutive windows with one anchor are a
record: the suffix from the anchor on, with the bytes before it. Records whose anchor occurs in one document only are dropped (by a
filter that may keep some more). The others are dealt by sampled splitters of their leading bytes, so that equal
anchors never lie on both sides of a boundary; every bucket sorts them by multikey quicksort, eight bytes
being one character, first whole records, then the windows of what differs within one anchor.

Before anything is shuffled, equal records of a chunk of input are reduced to those of its smallest id: the others are known to be
repeated. So a passage that a third of all documents share is shipped once per chunk.

Defined results: null texts are empty; ids that are null count as larger than all others and not as
smaller than each other; repeated rows (same id and text) are judged alike and never by each other; texts of any length are
processed in overlapping pieces; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

WINDOW, GRAM = 50, 24
CHUNK_BYTES = 6_000_000
PIECE_BYTES = 2_000_000  # a longer text is cut into overlapping pieces
BLOCK_BYTES = 1 << 19  # of a chunk, whose windows are hashed together: their numbers take some hundred times the memory of the bytes
GATHER_RECORDS = 1 << 15  # whose bytes are copied together
FILTER_BITS = 27  # of the anchor filter, broadcast as 16 MB
SAMPLES = 64  # leading bytes per range of digests that splitters are chosen from
LAST = (1 << 63) - 1

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD,
                             0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)]
_BYTES = np.random.default_rng(1).integers(0, 1 << 64, 256, dtype=np.uint64)
_LOW = np.uint64((1 << 24) - 1)


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


@dataclass
class Chunk:
    """Texts laid end to end, and the records found in them."""
    data: np.ndarray
    first: np.ndarray  # of each record: where its first window starts,
    last: np.ndarray  # where its last window starts,
    anchor: np.ndarray  # and where its anchor is
    digest: np.ndarray  # of the anchor
    doc: np.ndarray
    key: np.ndarray
    start: np.ndarray  # place of the first window in its document

    def contents(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent digests of whole records: the first and last window cover them."""
        a, b = np.zeros(len(some), "u8"), np.zeros(len(some), "u8")
        words = _words(self.data)
        for place in (self.first[some], self.last[some]):
            for k, shift in enumerate((0, 8, 16, 24, 32, 40, WINDOW - 8)):
                part = words[place + shift].astype("u8")
                a = _spread(a * _M[7] + part)
                b = (b ^ _spread(part + _M[k])) * _M[k]
        shape = ((self.last - self.first)[some] * 64 + (self.anchor - self.first)[some]).astype("u8")
        return _spread(a + shape), b ^ shape


def _anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per window of some bytes where its anchor is, and a digest per k-gram."""
    h = _BYTES[data]
    for shift, k in ((1, 0), (2, 1), (4, 2)):
        h = h[:-shift] * _M[k] + h[shift:]
    h8, h = h, h[:-8] * _M[3] + h[8:]
    h = h[:-8] * _M[4] + h8[16:]
    v = ((h ^ (h >> np.uint64(32))) * _M[5] & ~_LOW) | np.arange(len(h), dtype="u8")
    for step in (1, 2, 4, 8, 11):
        v = np.minimum(v[:-step], v[step:])  # in the end the smallest of 27: all k-grams of a window
    return (v & _LOW).astype(np.int64), h


def _records(pieces: list[tuple[bytes, int, int, int]]) -> Chunk:
    """Records of pieces ``(bytes, doc, key, start in the document)``, of at least ``WINDOW`` bytes each."""
    data = np.frombuffer(b"".join(p[0] for p in pieces), np.uint8)
    size = np.array([len(p[0]) for p in pieces])
    begin = np.cumsum(size) - size
    # Windows that begin in the last 49 bytes of a piece would cross into the next one.
    crossing = np.zeros(len(data), bool)
    for back in range(1, WINDOW):
        crossing[begin + size - back] = True
    edges, anchors, digests, before = [], [], [], -1
    for low in range(0, len(data) - WINDOW + 1, BLOCK_BYTES):
        anchor, digest = _anchors(data[low:low + BLOCK_BYTES + WINDOW - 1])
        here = np.where(crossing[low:low + len(anchor)], -1, anchor + low)
        edge = np.flatnonzero(here != np.concatenate([[before], here[:-1]]))
        edges.append(edge + low)
        anchors.append(here[edge])
        digests.append(_spread(digest[anchor[edge]]))
        before = here[-1]
    edge, at, digest = (np.concatenate(x) for x in (edges, anchors, digests))
    last = np.append(edge[1:], len(data) - WINDOW + 1) - 1
    real = at >= 0
    first, last, at, digest = edge[real], last[real], at[real], digest[real]
    piece = np.searchsorted(begin, first, side="right") - 1
    doc, key, start = (np.array([p[k] for p in pieces], np.int64) for k in (1, 2, 3))
    return Chunk(data, first, last, at, digest, doc[piece], key[piece], start[piece] + first - begin[piece])


def _gathered(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> bytes:
    """The bytes of some records, one after the other."""
    parts = []
    for low in range(0, len(first), GATHER_RECORDS):
        n = size[low:low + GATHER_RECORDS]
        parts.append(data[np.repeat(first[low:low + GATHER_RECORDS] - np.cumsum(n) + n, n) + np.arange(n.sum())].tobytes())
    return b"".join(parts)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """Chunks of ``(text, doc, key)`` rows; texts shorter than a window have no records."""
    held, size = [], 0
    for batch in batches:
        for text, doc, key in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            for at in range(0, max(len(raw) - WINDOW + 1, 0), PIECE_BYTES):
                piece = raw[at:at + PIECE_BYTES + WINDOW - 1]
                held.append((piece, doc, key, at))
                size += len(piece)
                if size >= CHUNK_BYTES:
                    yield _records(held)
                    held, size = [], 0
    if held:
        yield _records(held)


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; compares like the bytes."""
    return np.ndarray((len(data) - 7,), ">u8", data, 0, (1,))


def _shared(rows: DataFrame, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """A bit per digest of anchors that may occur in several documents, and a sample of leading bytes.

    Every chunk reports each of its digests once, or twice if several documents have it, by ranges of the
    digest; a range sees which it got twice. The bits and samples of a range have a fixed size.
    """
    bits = ranges.bit_length() - 1

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            order = np.argsort(chunk.digest, kind="stable")
            digest, doc = chunk.digest[order], chunk.doc[order]
            edge = np.flatnonzero(np.concatenate([[True], digest[1:] != digest[:-1]])) if len(digest) else np.zeros(0, int)
            if not len(edge):
                continue
            several = np.minimum.reduceat(doc, edge) != np.maximum.reduceat(doc, edge)
            found = np.repeat(digest[edge], 1 + several)
            cuts = np.searchsorted(found, np.arange(ranges, dtype="u8") << np.uint64(64 - bits))
            low = (found >> np.uint64(32 - bits)).astype("<u4")
            lead = _words(np.concatenate([chunk.data, np.zeros(8, np.uint8)]))[chunk.anchor[order[edge]]].astype("<u8")
            pick = np.linspace(0, len(edge) - 1, min(16, len(edge))).astype(int)
            which = (digest[edge[pick]] >> np.uint64(64 - bits)).astype(np.int64)
            leads = {int(r): lead[pick[which == r]].tobytes() for r in set(which.tolist())}
            ends = np.append(cuts[1:], len(found))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(ranges), pa.int64()),
                pa.array([low[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()),
                pa.array([leads.get(r, b"") for r in range(ranges)], pa.binary())], names=["range", "digests", "leads"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def bitmap(at: int, parts: list[bytes], leads: list[bytes]) -> tuple[int, bytes, bytes]:
            seen = np.sort(np.frombuffer(b"".join(parts), "<u4"))
            twice = seen[1:][seen[1:] == seen[:-1]] >> np.uint32(32 - (FILTER_BITS - bits))
            table = np.zeros(1 << (FILTER_BITS - bits), bool)
            table[twice] = True
            some = np.frombuffer(b"".join(leads), "<u8")
            some = some[np.argsort(_spread(some))[:SAMPLES]]
            return at, np.packbits(table, bitorder="little").tobytes(), some.tobytes()

        at, parts, leads, out = None, [], [], []
        for batch in batches:
            for r, digests, lead in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if r != at and at is not None:
                    out.append(bitmap(at, parts, leads))
                    parts, leads = [], []
                at = r
                parts.append(digests)
                leads.append(lead)
        if at is not None:
            out.append(bitmap(at, parts, leads))
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary()))],
                                         names=["range", "bits", "leads"])

    settled = (rows.mapInArrow(report, "range long, digests binary, leads binary")
               .repartition("range").sortWithinPartitions("range").mapInArrow(settle, "range long, bits binary, leads binary").collect())
    table = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    width = len(table) // ranges
    for row in settled:
        table[row["range"] * width:(row["range"] + 1) * width] = np.frombuffer(row["bits"], np.uint8)
    return table, np.sort(np.concatenate([np.frombuffer(r["leads"], "<u8") for r in settled] or [np.zeros(0, "<u8")]))


def _merged(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unions of spans that touch, as ``start << 32 | end`` per key."""
    order = np.lexsort((start, key))
    key, start, end = key[order], start[order], end[order]
    if not len(key):
        return key, start
    group = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]))
    reach = np.maximum.accumulate(end + group * (1 << 33)) - group * (1 << 33)
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (start[1:] > reach[:-1])])
    first = np.flatnonzero(new)
    return key[first], (start[first] << 32) | np.maximum.reduceat(end, first)


def multikey(group: np.ndarray, character: list) -> np.ndarray:
    """Sort by multikey quicksort: per level only what is still equal to another, by group and next character.

    ``character[k](at)`` gives the k-th character of some elements. Returns a group per element, -1 for those equal to no other.
    """
    out = np.full(len(group), -1, np.int64)
    active = np.arange(len(group))
    group = np.asarray(group, np.int64)
    for level in [None, *character]:
        keys = group if level is None else level(active)
        order = np.argsort(keys, kind="stable") if level is None else np.lexsort((keys, group))
        active, group, keys = active[order], group[order], keys[order]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (keys[1:] != keys[:-1])]) if len(keys) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        again = np.bincount(group)[group] > 1 if len(group) else new
        active, group = active[again], group[again]
    out[active] = group
    return out


def _resolve(text: np.ndarray, size: np.ndarray, off: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Repeated parts of the records of a bucket: ``(record, from, to)``."""
    nothing = np.zeros(0, np.int64)
    words = _words(np.concatenate([text, np.zeros(16, np.uint8)]))
    begin = np.cumsum(size) - size

    def word(place):
        return lambda at: words[place(at)].astype("u8")

    same_anchor = multikey(np.zeros(len(size), np.int64), [word(lambda at, k=k: begin[at] + off[at] + k) for k in range(0, GRAM, 8)])
    some = np.flatnonzero(same_anchor >= 0)
    if not len(some):
        return nothing, nothing, nothing
    begin, size, off, doc, anchor = begin[some], size[some], off[some], doc[some], same_anchor[some]
    longest = int(size.max())
    content = multikey(anchor, [lambda at: (size * 128 + off)[at]] + [word(lambda at, k=k: begin[at] + np.minimum(k, size[at] - 8)) for k in range(0, longest, 8)])
    alone = content < 0
    content[alone] = content.max(initial=-1) + 1 + np.arange(alone.sum())
    # The records of a class by document: all but those of the smallest are repeated as a whole.
    order = np.lexsort((doc, content))
    head = np.flatnonzero(np.concatenate([[True], content[order][1:] != content[order][:-1]]))
    lead = order[head]  # one record per class, of its smallest document
    class_of = np.empty(len(order), np.int64)
    class_of[order] = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(order))))
    smallest = doc[lead]
    whole = doc > smallest[class_of]
    # Classes that share an anchor with another class are compared window by window.
    mixed = np.flatnonzero(np.bincount(anchor[lead])[anchor[lead]] > 1)
    rep = lead[mixed]
    n = size[rep] - WINDOW + 1
    which = np.repeat(np.arange(len(rep)), n)
    step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    place = begin[rep][which] + step
    groups = multikey(anchor[rep][which] * 64 + off[rep][which] - step,
                      [word(lambda at, k=k: place[at] + k) for k in (0, 8, 16, 24, 32, 40, 42)])
    equal = np.flatnonzero(groups >= 0)
    least = np.full(int(groups.max(initial=-1)) + 1, LAST)
    np.minimum.at(least, groups[equal], smallest[mixed][which[equal]])
    hit = equal[smallest[mixed][which[equal]] > least[groups[equal]]]
    c, a = mixed[which[hit]], step[hit]
    owner, span = _merged(c, a, a + WINDOW)
    # The parts found for a class hold for all its records in the smallest document.
    members = np.flatnonzero(~whole)
    members = members[np.argsort(class_of[members], kind="stable")]
    low, high = np.searchsorted(owner, class_of[members]), np.searchsorted(owner, class_of[members], side="right")
    count = high - low
    record = np.repeat(members, count)
    part = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    full = np.flatnonzero(whole)
    return (some[np.concatenate([full, record])], np.concatenate([np.zeros(len(full), np.int64), span[part] >> 32]),
            np.concatenate([size[full], span[part] & 0xFFFFFFFF]))


def _spans(rows: DataFrame, table: np.ndarray, splitters: np.ndarray) -> DataFrame:
    """``(key, span)``: repeated parts of each text, as ``start << 32 | end``; they may overlap."""
    buckets = len(splitters) + 1
    fields = (("size", "u1"), ("off", "u1"), ("doc", "<i8"), ("key", "<i8"), ("start", "<i8"))

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for chunk in _chunks(batches):
            place = (chunk.digest >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
            some = np.flatnonzero(table[place >> 3] >> (place & 7).astype(np.uint8) & 1)
            a, b = chunk.contents(some)
            order = np.lexsort((chunk.doc[some], b, a))
            some, a, b = some[order], a[order], b[order]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(some) else np.zeros(0, bool)
            least = chunk.doc[some][new][np.cumsum(new) - 1] if len(some) else some
            known = some[chunk.doc[some] > least]
            size = (chunk.last - chunk.first + WINDOW)
            keys, spans = _merged(chunk.key[known], chunk.start[known], chunk.start[known] + size[known])
            sent = some[chunk.doc[some] == least]
            lead = _words(np.concatenate([chunk.data, np.zeros(8, np.uint8)]))[chunk.anchor[sent]].astype("u8")
            bucket = np.searchsorted(splitters, lead, side="right")
            order = np.lexsort((lead, bucket))
            sent, bucket = sent[order], bucket[order]
            columns = (size[sent], (chunk.anchor - chunk.first)[sent], chunk.doc[sent], chunk.key[sent], chunk.start[sent])
            edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(sent) else np.zeros(1, int)
            blobs, ids = [], []
            for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
                packed = b"".join(c[low:high].astype(t).tobytes() for c, (_, t) in zip(columns, fields))
                blobs.append((high - low).to_bytes(4, "little") + squeeze.compress(packed + _gathered(chunk.data, chunk.first[sent[low:high]], size[sent[low:high]])))
                ids.append(int(bucket[low]))
            ids += (np.abs(keys) % buckets).tolist()
            m = len(blobs)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int32()), pa.array(blobs + [None] * len(keys), pa.binary()),
                pa.array([None] * m + keys.tolist(), pa.int64()), pa.array([None] * m + spans.tolist(), pa.int64())], names=["bucket", "blob", "key", "span"])

    def unpack(blobs: list[bytes]) -> tuple[dict[str, np.ndarray], np.ndarray]:
        expand, columns, texts = zstandard.ZstdDecompressor(), {name: [] for name, _ in fields}, []
        for blob in blobs:
            n, raw, at = int.from_bytes(blob[:4], "little"), expand.decompress(blob[4:]), 0
            for name, kind in fields:
                columns[name].append(np.frombuffer(raw, kind, n, at).astype(np.int64))
                at += n * np.dtype(kind).itemsize
            texts.append(np.frombuffer(raw, np.uint8, offset=at))
        return {name: np.concatenate(c) for name, c in columns.items()}, np.concatenate(texts)

    def solve(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        columns, text = unpack(blobs)
        record, low, high = _resolve(text, columns["size"], columns["off"], columns["doc"])
        return _merged(columns["key"][record], columns["start"][record] + low, columns["start"][record] + high)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, blobs = None, []
        for batch in batches:
            whole = batch.filter(batch.column(1).is_null())
            if whole.num_rows:
                yield pa.RecordBatch.from_arrays([whole.column(2), whole.column(3)], names=["key", "span"])
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if blob is None:
                    continue
                if bucket != at and blobs:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in solve(blobs)], names=["key", "span"])
                    blobs = []
                at = bucket
                blobs.append(blob)
        if blobs:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in solve(blobs)], names=["key", "span"])

    shipped = rows.mapInArrow(ship, "bucket int, blob binary, key long, span long")
    return shipped.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(settle, "key long, span long")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """``(id, kept, n_bytes, n_removed, n_spans)`` of every row; ``kept`` are the bytes that are left.

    There are several buckets per input partition, so that what a task sorts does not grow with the input.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    read = rows.select("text", F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "key")
    partitions = read.rdd.getNumPartitions()
    buckets = buckets or max(4 * partitions, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    table, leads = _shared(read, 1 << min(max(partitions - 1, 63).bit_length(), 14))
    splitters = np.unique(leads[np.linspace(0, len(leads) - 1, buckets + 1).astype(int)[1:-1]]) if len(leads) else leads
    spans = _spans(read, table, splitters).groupBy("key").agg(F.collect_list("span").alias("spans"))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, found in zip(batch.column(1), batch.column(2)):
                raw = text.as_buffer().to_pybytes()
                if not found.is_valid:
                    out.append((raw, len(raw), 0, 0))
                    continue
                packed = found.values.to_numpy()
                low, high = packed >> 32, packed & 0xFFFFFFFF
                _, union = _merged(np.zeros(len(low), np.int64), low, high)
                kept, at = [], 0
                for start, end in zip((union >> 32).tolist(), (union & 0xFFFFFFFF).tolist()):
                    kept.append(raw[at:start])
                    at = end
                left = b"".join([*kept, raw[at:]])
                out.append((left, len(raw), len(raw) - len(left), len(union)))
            columns = list(zip(*out)) if out else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.int64())))],
                                             names=["id", "kept", "n_bytes", "n_removed", "n_spans"])

    joined = rows.join(spans, "key", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(strip, "id long, kept binary, n_bytes long, n_removed long, n_spans long").withColumnRenamed("id", id_col)
