"""Walks over sorted Arrow batches, for tasks that hold one run at a time."""

from __future__ import annotations

from collections.abc import Iterator


def runs(batches, keys: int) -> Iterator:
    """Rows of sorted batches as tables, one for each run of equal values in the first `keys` columns."""
    import pyarrow as pa

    held: list = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = list(zip(*[batch.column(k).to_pylist() for k in range(keys)], strict=True))
        start = 0
        for k, value in enumerate(values):
            if value != last:
                held += [batch.slice(start, k - start)] * (k > start)
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], k, value
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)
