import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from hypothesis import given, settings
from hypothesis import strategies as st

from revmine.llm import wordtable

NUMBERS = st.integers(-(2**62), 2**62) | st.integers(-300, 300)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(NUMBERS, NUMBERS), min_size=1, max_size=300))
def test_squeezed_columns_come_back(rows):
    columns = [np.array(x, np.int64) for x in zip(*rows)]
    assert [x.tolist() for x in wordtable.unsqueeze(wordtable.squeeze(columns))] == [x.tolist() for x in columns]


def test_widths_at_their_ends():
    for v in (127, 128, -128, -129, 32767, 32768, 2**31 - 1, 2**31, -(2**31), 2**63 - 1, -(2**63)):
        assert wordtable.unsqueeze(wordtable.squeeze([np.array([v], np.int64)]))[0].tolist() == [v]
    assert wordtable.unsqueeze(wordtable.squeeze([np.zeros(0, np.int64)]))[0].tolist() == []


def test_parcels_of_many_batches():
    rng = np.random.default_rng(1)
    batch = rng.integers(0, 5, 4000)
    pos = np.concatenate([rng.permutation(int((batch == b).sum())) for b in range(5)])[np.argsort(np.argsort(batch, kind="stable"), kind="stable")]
    a, b = rng.integers(-9, 9, 4000), rng.integers(-(2**40), 2**40, 4000)
    parts = [(batch[i : i + 700], pos[i : i + 700].astype(np.int32), a[i : i + 700], b[i : i + 700]) for i in range(0, 4000, 700)]
    rows = pa.Table.from_batches(list(wordtable.parcels(iter(parts), most=1000)))
    for k in range(5):
        data = rows.filter(pa.compute.equal(rows["batch"], k))["data"]
        assert len(data) > 1
        got = wordtable.opened(data)
        for to, x in zip(got, (a, b)):
            assert to[pos[batch == k]].tolist() == x[batch == k].tolist() and len(to) == (batch == k).sum()


def test_a_batch_without_words():
    rows = next(wordtable.parcels(iter([(np.array([7]), np.array([-1], np.int32), np.array([3]), np.array([4]))])))
    assert [x.tolist() for x in wordtable.opened(pa.Table.from_batches([rows])["data"])] == [[], []]
