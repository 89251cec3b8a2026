"""Sum-of-squares packing of tokenised documents into sequences of a fixed length.

``tokenise`` turns each document into pieces of at most ``capacity`` tokens, ``pack`` gives every piece a
sequence and a place in it. Both read each row once; only piece lengths, never texts or ids, are shuffled.

Defined results: a null or empty text is one piece with only the end token; repeated rows are packed as
often as they occur; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablesight.functions.storage import store

CAPACITY = 2048
END_ID = 0
# Pieces that one task packs together. What a task leaves open at its end is its only loss.
GROUP_PIECES = 30_000
SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256

# The pre-tokenisation pattern of the vocabulary. The look-ahead of the public pattern for runs
# of white space is replaced by cutting texts with _RUN, which gives the same pieces without backtracking.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN = re.compile(f"(?<=[{_SPACE}])(?=[{_SPACE}][^{_SPACE}])")

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def encoder(ranks_path: str):
    """The tokenizer of a file of tokens and ranks."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=_PATTERN, mergeable_ranks=ranks,
                             special_tokens={SPECIAL: SPECIAL_ID})


def token_ids(text: str, tokenizer) -> np.ndarray:
    """Ids of a text, with the end token."""
    parts: list[np.ndarray] = []
    for k, plain in enumerate(text.split(SPECIAL)):
        if k:
            parts.append(np.array([SPECIAL_ID], "<u4"))
        for run in _RUN.split(plain):
            if run:
                parts.append(np.asarray(tokenizer.encode_to_numpy(run, disallowed_special=()), "<u4"))
    parts.append(np.array([END_ID], "<u4"))
    return np.concatenate(parts)


def tokenise(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text",
             capacity: int = CAPACITY) -> DataFrame:
    """One row per piece. Only documents longer than ``capacity`` are cut; all pieces but their first are full."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(ranks_path)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = token_ids(text.as_py() or "", tokenizer)
                start, n = 0, len(ids)
                while start < n:
                    end = n - (n - 1 - start) // capacity * capacity if start == 0 else start + capacity
                    rows.append((doc_id, len(rows), start, end - start, zlib.crc32(ids[start:end])))
                    start = end
            if rows:
                doc_ids, _, starts, lengths, crcs = zip(*rows)
                first = np.maximum.accumulate(np.where(np.array(starts) == 0, np.arange(len(rows)), 0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array((np.arange(len(rows)) - first).astype("int32")),
                     pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(pieces, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, longest first.

    ``open_bins[g]`` is the number of open bins with room ``g``. A piece goes into the open bin that makes the
    sum of the squares of these numbers smallest, ties into the tightest; a new bin is opened only for a
    piece that fits nowhere, which saves the bins that the plain rule leaves half full at the end.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_bins = np.zeros(capacity + 1)
    after = np.zeros(capacity + 1)  # half the change that one more bin with this room makes
    after[0] = -0.5  # a full bin is no longer counted
    stacks: dict[int, list[int]] = {}
    n_bins = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        rooms = open_bins[size:]
        change = np.where(rooms > 0, after[:capacity + 1 - size] - rooms + 1, np.inf)
        best = int(change.argmin())
        room = size + best if change[best] < np.inf else capacity
        if room == capacity:
            where, n_bins = n_bins, n_bins + 1
        else:
            where = stacks[room].pop()
            open_bins[room] -= 1
            after[room] -= 1
        left = room - size
        if left:
            open_bins[left] += 1
            after[left] += 1
            stacks.setdefault(left, []).append(where)
        bins[i], offsets[i] = where, capacity - room
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add ``sequence_id`` and ``offset``. Pieces are dealt evenly to tasks, each of which fills its own sequences."""
    pieces = store(pieces)
    n = pieces.count()

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        batches = [b for b in batches if b.num_rows]
        if batches:
            table = pa.Table.from_batches(batches)
            bins, offsets = sum_of_squares(table.column("length").to_numpy(), capacity)
            bins += TaskContext.get().partitionId() << 40
            yield from table.append_column("sequence_id", pa.array(bins)).append_column(
                "offset", pa.array(offsets)).to_batches()

    fields = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes)
    return pieces.repartition(-(-max(n, 1) // group_pieces)).mapInArrow(
        fill, f"{fields}, sequence_id long, offset long")
