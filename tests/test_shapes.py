"""Driver-side arithmetic and eager errors; no Spark job."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from gridloom.errors import AxisError, BroadcastError, IndexRangeError, ShapeMismatchError
from gridloom.plans import shape as S


def test_strides_and_sizes():
    assert S.strides((2, 3, 4)) == [12, 4, 1] and S.strides(()) == []
    assert S.size(()) == 1 and S.size((0, 3)) == 0
    with pytest.raises(ShapeMismatchError):
        S.checked((2, -1))


@pytest.mark.parametrize("target,expected", [((2, -1), (2, 3)), ((-1, 3), (2, 3)), ((-1,), (6,)), ((3, -1, 1), (3, 2, 1))])
def test_inferred(target, expected):
    assert S.inferred(target, 6) == expected


@pytest.mark.parametrize("target,total", [((-1, -1), 6), ((4, -1), 6), ((0, -1), 0), ((5,), 6), ((-2, -3), 6)])
def test_inferred_errors(target, total):
    with pytest.raises(ShapeMismatchError):
        S.inferred(target, total)


def test_broadcast():
    assert S.broadcast((2, 3), (3,)) == (2, 3) == S.broadcast((1, 3), (2, 1))
    assert S.broadcast((0, 3), (3,)) == (0, 3) and S.broadcast((), (2,)) == (2,)
    with pytest.raises(BroadcastError):
        S.broadcast((2, 3), (2,))


def test_axis_of():
    assert S.axis_of(-1, 3) == 2
    with pytest.raises(AxisError):
        S.axis_of(3, 3)


@given(st.integers(0, 12), st.one_of(st.none(), st.integers(-15, 15)), st.one_of(st.none(), st.integers(-15, 15)), st.integers(-5, 5).filter(bool))
def test_ranges_follow_slices(n, start, stop, step):
    first, by, count, drops = S.Index(start=start, stop=stop, step=step).resolve(n)
    assert [first + k * by for k in range(count)] == list(range(n))[start:stop:step] and not drops


def test_index_errors():
    for bad in (S.at(5), S.at(-5), S.strided(0, 2, 0)):
        with pytest.raises(IndexRangeError):
            bad.resolve(2)
