"""Cost-balanced packing of token sequences.

The cost of a document piece of L tokens is ``linear * L + quadratic * L**2``, an estimate of what its feed-forward and
its attention part take. Pieces go, longest first, to the sequence of lowest cost that still has room.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from cnvspark.llm.common import give_back
from cnvspark.llm.tokens import coder

#: Runs whose ids a worker remembers: fewer than for token files, as a task holds a block of pieces beside them.
MEMO = 120_000
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, cost double, ids binary"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("cost", pa.float64()), ("ids", pa.binary())])


def balance(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Places lengths below ``capacity`` into as few sequences as can hold them.

    Returns (item, start in the item, length, sequence, offset). Items go, longest first (ties: in their order), to the
    sequence of lowest cost with room (ties: the first). What fits nowhere whole is cut last, into the widest gaps.
    """
    total = int(lengths.sum())
    if not total:
        return []
    room = np.full(-(-total // capacity), capacity, np.int64)
    cost = np.zeros(len(room))
    placed, left = [], []
    for item in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[item])
        if not n:
            continue
        at = int(np.where(room >= n, cost, np.inf).argmin())
        if room[at] < n:
            left.append(item)
            continue
        placed.append((item, 0, n, at, int(capacity - room[at])))
        room[at] -= n
        cost[at] += linear * n + quadratic * n * n
    for item in left:
        start, n = 0, int(lengths[item])
        while start < n:
            at = int(room.argmax())
            take = min(n - start, int(room[at]))
            placed.append((item, start, take, at, int(capacity - room[at])))
            room[at] -= take
            start += take
    return placed


def pack_documents(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 0, block_tokens: int = 2_000_000, linear: float = 1.0, quadratic: float = 1 / 1024) -> DataFrame:
    """Packs all documents into sequences of at most ``capacity`` tokens; one row for each piece.

    A document is the tokenizer's ids of its whole text (null: empty) and then ``end_id``, so an empty one has a piece
    of one token. Whole capacities of a document are sequences of their own; the rest is placed by :func:`balance` in
    blocks of some ``block_tokens`` tokens. A block is made of neighbouring rows of one input partition, so nothing is
    shuffled, a task holds one block, and a lost task makes the same pieces again. A block wastes less than one
    sequence. Repeated rows are packed as often as they come, ties keep row order, a null id stays null, an empty table
    gives no rows, and other columns are ignored.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, next_sequence = coder(tokenizer, MEMO).encode, TaskContext.get().partitionId() << 33
        ids, docs, size = [], [], 0

        def block() -> pa.RecordBatch:
            nonlocal next_sequence
            rows, rest = [], np.zeros(len(ids), np.int64)
            for k, x in enumerate(ids):
                n = len(x) // 4
                rest[k] = n % capacity
                for start in range(0, n - capacity + 1, capacity):
                    rows.append((k, start, capacity, next_sequence, 0))
                    next_sequence += 1
            placed = balance(rest, capacity, linear, quadratic)
            rows += [(k, len(ids[k]) // 4 - int(rest[k]) + start, n, next_sequence + at, offset) for k, start, n, at, offset in placed]
            next_sequence += max((at for *_, at, _ in placed), default=-1) + 1
            which, starts, lengths, sequences, offsets = (list(x) for x in zip(*rows, strict=True))
            pieces = pa.record_batch([
                pa.array([docs[k] for k in which], pa.int64()),
                pa.array(starts, pa.int64()),
                pa.array(lengths, pa.int64()),
                pa.array([len(ids[k]) // 4 for k in which], pa.int64()),
                pa.array(sequences, pa.int64()),
                pa.array(offsets, pa.int64()),
                pa.array([linear * n + quadratic * n * n for n in lengths], pa.float64()),
                pa.array([ids[k][4 * s : 4 * (s + n)] for k, s, n in zip(which, starts, lengths, strict=True)], pa.binary()),
            ], schema=_ARROW)
            ids.clear()  # not held beside the pieces while these are written
            docs.clear()
            return pieces

        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc, x in zip(part.column(0).to_pylist(), encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    docs.append(doc)
                    ids.append(x + end)
                    size += len(x) // 4 + 1
                    if size >= block_tokens:
                        yield block()
                        size = 0
                        give_back()
        if ids:
            yield block()
        give_back()

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(pack, SCHEMA)
