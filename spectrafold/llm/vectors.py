"""Reading vectors and streams of sorted rows, for the operators on embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def usable(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """(rows, vectors in double precision) of those that are neither null nor zero and whose components are all finite."""
    rows, out = [], []
    for i, v in enumerate(column):
        if not v.is_valid or not len(v.values) or v.values.null_count:
            continue
        x = v.values.to_numpy().astype(np.float64)
        if np.isfinite(x).all() and x.any():
            rows.append(i)
            out.append(x)
    return np.array(rows, np.int64), out


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of each run of rows with the same first columns; rows come as tuples of the other columns' values."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != key:
                if held:
                    yield key, held
                key, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield key, held


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n points the smallest that the pairs lead to."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    return label
