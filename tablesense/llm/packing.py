"""Harmonic packing of token sequences: reciprocal-capacity classes, a fixed number of pieces to a bin."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tablesense.llm import tokens
from tablesense.llm.common import giving_back

PIECES = "id string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Bins:
    """Open bins of one worker.

    Class k takes pieces longer than capacity / (k + 1) and at most capacity / k; k of them fill a bin.  So
    a bin wastes less than its (k + 1)th part, and its sequence is known the moment it is full, whatever
    other workers do.  A document is cut to fit: whole sequences first, then the largest slot
    floor(capacity / k) that it fills, again and again, until at most capacity / ``fine`` ids are
    left, which go to their class as they are (a waste below 1 / fine of that bin).  What is in the open
    bins at the end is laid in a row and cut at powers of two, which need no padding.
    """

    def __init__(self, capacity: int, worker: int, fine: int = 64) -> None:
        self.capacity, self.fine = capacity, fine
        self.next = worker << 40
        self.open: dict[int, list[tuple]] = {}

    def _sequence(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc, start, ids, size in pieces:
            yield doc, start, len(ids), ids, size, self.next, offset
            offset += len(ids)
        self.next += 1

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        at, size = 0, len(ids)
        while at < size:
            left = size - at
            k = 1 if left >= self.capacity else self.capacity // left
            take = left
            if left > self.capacity // self.fine:
                k = -(-self.capacity // left)
                take = self.capacity // k
            pieces = self.open.setdefault(k, [])
            pieces.append((doc, at, ids[at:at + take], size))
            at += take
            if len(pieces) == k:
                yield from self._sequence(self.open.pop(k))

    def close(self) -> Iterator[tuple]:
        rest = [piece for k in sorted(self.open) for piece in self.open[k]]
        self.open = {}
        total = sum(len(p[2]) for p in rest)
        rest.reverse()
        while total:
            room = min(self.capacity, 1 << (total.bit_length() - 1))
            total -= room
            pieces = []
            while room:
                doc, start, ids, size = rest.pop()
                if len(ids) > room:
                    rest.append((doc, start + room, ids[room:], size))
                    ids = ids[:room]
                pieces.append((doc, start, ids, size))
                room -= len(ids)
            yield from self._sequence(pieces)


def pack(
    docs: DataFrame, capacity: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
    vocabulary: str | None = None,
) -> DataFrame:
    """Sequences of at most ``capacity`` token ids over all documents, one row for each piece.

    A document's ids are those of its whole text and ``end_id``.  Returns (id_col, start, length, ids,
    doc_tokens, sequence_id, offset): the piece ``ids`` (little-endian unsigned 32-bit) are the
    document's ids from ``start``; it lies at ``offset`` of its sequence.  ``capacity`` is a power of two.
    ``sequence_id`` is unique (worker and count), not dense.

    Workers pack their own partitions: nothing is shuffled, a worker holds one open bin for each class
    (2 * 64 classes and a few more), and a lost worker packs its partition again.

    Defined cases: null or empty text is the end id alone; null ids are kept; repeated rows are packed
    each; a very long text is cut into as many sequences as it fills; an empty table gives no rows;
    other columns are ignored.
    """
    assert capacity & (capacity - 1) == 0
    path = vocabulary or tokens.vocabulary_path()
    kind = docs.schema[id_col].dataType.simpleString()
    schema = PIECES.replace("id string", f"`{id_col}` {kind}")

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, bins = tokens.encoder(path), Bins(capacity, TaskContext.get().partitionId())
        names, id_type = None, None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [()] * 7
            return pa.RecordBatch.from_arrays([
                pa.array(cols[0], id_type), *(pa.array(c, pa.int64()) for c in cols[1:3]),
                pa.array([i.tobytes() for i in cols[3]], pa.binary()), *(pa.array(c, pa.int64()) for c in cols[4:]),
            ], names=names)

        for batch in batches:
            id_type, names = batch.schema[0].type, [batch.schema.names[0], "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in tokens.slices(texts):
                ids, counts = encoder.encode(texts[a:b])
                rows, end = [], 0
                for key, n in zip(keys[a:b], counts.tolist()):
                    rows.extend(bins.add(key, np.append(ids[end:end + n], np.uint32(end_id)).astype("<u4")))
                    end += n
                yield out(rows)
        if names:
            yield out(list(bins.close()))

    slim = docs.select(F.col(f"`{id_col}`").alias(id_col), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return slim.mapInArrow(run, schema)
