"""Lines packed batch by batch."""

import pyarrow as pa
import pytest

from keysieve.operators import chunks
from tests.test_patterns import _texts


@pytest.mark.parametrize("chars, least", [(40, 10), (7, 7), (1_000, 60)])
def test_lines_are_packed_alike_in_any_batches(chars, least):
    lines = "\n".join(_texts(8, 80)).split("\n") + ["é" * 90, "", "w" * 300]
    rows = [(f"file{i // 50}", (i // 20) % 3, line) for i, line in enumerate(lines)]

    def packed(step):
        parts = (rows[a : a + step] for a in range(0, len(rows), step))
        batches = (pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*p)], names=["path", "block", "line"]) for p in parts)
        return [tuple(r.values()) for b in chunks._packed(chars, least)(batches) for r in b.to_pylist()]

    got = packed(1)
    assert got == packed(7) == packed(len(rows))
    runs = []
    for path, block, line in rows:
        if not runs or runs[-1][:2] != [path, block]:
            runs.append([path, block, ""])
        runs[-1][2] += line + "\n"
    joined = []
    for path, block, number, content in got:
        if number == 1:
            joined.append([path, block, ""])
        joined[-1][2] += content
    assert joined == runs
