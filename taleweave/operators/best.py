"""The k best of many queries, kept while a task's rows pass by."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Scores are compared before they are rounded with so much room, so that none that rounds up to the k-th is lost.
ROOM = 1e-6


class Best:
    """For each of n queries the k best (score to 6 digits, ties by id) of the rows offered so
    far. floor: the k-th best of a query, -inf as long as there are fewer."""

    def __init__(self, n: int, k: int):
        self.k, self.floor = k, np.full(n, -np.inf)
        self.scores: list = [None] * n
        self.ids: list = [None] * n

    def offer(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s = np.round(scores, 6)
        if len(s) > self.k:
            # all rows of the k-th best score stay in, so that ties go by id
            few = np.flatnonzero(s >= np.partition(s, -self.k)[-self.k])
            s, ids = s[few], ids[few]
        if self.scores[i] is not None:
            s, ids = np.concatenate([self.scores[i], s]), np.concatenate([self.ids[i], ids])
        if ids.dtype == object:
            top = np.array(sorted(range(len(s)), key=lambda j: (-s[j], ids[j]))[: self.k], dtype=np.int64)
        else:
            top = np.lexsort((ids, -s))[: self.k]
        self.scores[i], self.ids[i] = s[top], ids[top]
        if len(top) == self.k:
            self.floor[i] = s[top[-1]]

    def batches(self, owners: list[np.ndarray], queries: pa.Array, kind: pa.DataType, size: int = 50_000):
        """Batches (query_id, id, score) for the queries (places in queries) that own each i."""
        out, n = [], 0
        for i, s in enumerate(self.scores):
            if s is not None and len(s):
                m = len(owners[i])
                out.append((np.repeat(owners[i], len(s)), np.tile(self.ids[i], m), np.tile(s, m)))
                n += len(s) * m
            if out and (n >= size or i == len(self.scores) - 1):
                q, d, s = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([queries.take(pa.array(q)), pa.array(d, kind), pa.array(s)], ["query_id", "id", "score"])
                out, n = [], 0
        if out:
            q, d, s = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([queries.take(pa.array(q)), pa.array(d, kind), pa.array(s)], ["query_id", "id", "score"])


def plain(column: pa.ChunkedArray) -> pa.Array:
    """One array of a column, also of one without chunks."""
    got = column.combine_chunks()
    return pa.concat_arrays(got.chunks) if isinstance(got, pa.ChunkedArray) and got.num_chunks else pa.array([], column.type) if isinstance(got, pa.ChunkedArray) else got
