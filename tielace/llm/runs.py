"""Reading sorted partitions run by run."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_runs(batches: Iterator[pa.RecordBatch], key: str, limit: int) -> Iterator[tuple[pa.Table, bool]]:
    """Regroup batches that are sorted by a long key: (table, False) holds whole runs of equal keys.

    A run of over limit rows isn't gathered: its rows come in pieces, as (table, True), however many they are.
    """
    carry: list[pa.RecordBatch] = []
    held, large = 0, None  # large: the key of the run that is passed on in pieces
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        start = 0
        if large is not None:
            end = int(np.searchsorted(keys != large, True)) if keys[-1] != large else len(keys)
            if end:
                yield pa.Table.from_batches([batch.slice(0, end)]), True
            if end == len(keys):
                continue
            start, large = end, None
        last = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
        if last > start:
            yield from _split(pa.Table.from_batches([*carry, batch.slice(start, last - start)]), key, limit)
            carry, held, start = [], 0, last
        elif carry and carry[-1].column(key)[0].as_py() != keys[start]:
            yield from _split(pa.Table.from_batches(carry), key, limit)
            carry, held = [], 0
        carry.append(batch.slice(start))
        held += len(keys) - start
        if held > limit:
            large = keys[-1]
            yield pa.Table.from_batches(carry), True
            carry, held = [], 0
    if carry:
        yield from _split(pa.Table.from_batches(carry), key, limit)


def _split(table: pa.Table, key: str, limit: int) -> Iterator[tuple[pa.Table, bool]]:
    """Take runs of over limit rows out of a table of whole runs."""
    starts, sizes = run_lengths(table.column(key).to_numpy())
    at = 0
    for start, size in zip(starts[sizes > limit].tolist(), sizes[sizes > limit].tolist(), strict=True):
        if start > at:
            yield table.slice(at, start - at), False
        yield table.slice(start, size), True
        at = start + size
    if at < table.num_rows:
        yield table.slice(at), False


def run_lengths(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal neighbours."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(keys)))


def pairs_in_runs(keys: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), i < j, of equal keys in sorted keys, about most of them at a time."""
    starts, sizes = run_lengths(keys)
    end = np.repeat(starts + sizes, sizes)
    here = np.flatnonzero(end - np.arange(len(keys)) > 1)
    lefts, rights, held, step = [], [], 0, 1
    while len(here):
        lefts.append(here)
        rights.append(here + step)
        held += len(here)
        if held >= most:
            yield np.concatenate(lefts), np.concatenate(rights)
            lefts, rights, held = [], [], 0
        step += 1
        here = here[here + step < end[here]]
    if held:
        yield np.concatenate(lefts), np.concatenate(rights)
