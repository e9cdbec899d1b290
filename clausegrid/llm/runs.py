"""Whole runs of equal keys from sorted Arrow batches, one at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[pa.Table]]:
    """For every batch, the runs of rows with equal ``keys`` that end in it; the last ends with the input."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        parts = [*held, table]
        columns = [np.concatenate([t.column(k).to_numpy() for t in parts[-2:]]) for k in keys]
        offset = parts[-2].num_rows if held else 0
        cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1 - offset
        if not len(cut):
            held = parts
            continue
        cut = cut[cut >= 0].tolist()
        ended = [pa.concat_tables([*held, table.slice(0, cut[0])])] if held or cut[0] else []
        ended += [table.slice(a, b - a) for a, b in zip(cut, cut[1:])]
        held = [table.slice(cut[-1])]
        yield ended
    if held:
        yield [pa.concat_tables(held)]
