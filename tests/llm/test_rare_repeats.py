from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from auditlake.llm import op2_neardup


@pytest.mark.parametrize("repeated", [(), (1,), (1, 2, 2), (1, 2, 3)])
@pytest.mark.parametrize("at_once", [1, 10])
def test_repeated_rows_count_once(repeated, at_once):
    """Sets of 100 rare shingles, 90 of them shared: the counts do not depend on repeated rows."""
    sets = {1: range(100), 2: range(10, 110), 3: range(50, 150)}
    rows = [(i, np.array(sets[i], np.uint64).tobytes(), i, int(i != 1)) for i in (1, 2, 3, *repeated)]
    dealt = []
    for at in range(0, len(rows), at_once):
        ids, own, part, odd = zip(*rows[at : at + at_once])
        batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(own, pa.binary()), pa.array(part, pa.int64()), pa.array(odd, pa.int64())], ["id", "own", "part", "odd"])
        dealt += op2_neardup._spread(3, batch).to_pylist()
    got = Counter()
    for b in range(3):
        for x in op2_neardup._rare(op2_neardup.RARE, pa.Table.from_pylist([r for r in dealt if r["bucket"] == b])).to_pylist():
            got[x["a"], x["b"]] += x["n"]
    assert got == {(1, None): 100, (2, None): 100, (3, None): 100, (1, 2): 90, (1, 3): 50, (2, 3): 60}
