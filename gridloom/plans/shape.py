"""Shape arithmetic: plain integers on the driver, used to build column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from math import prod

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import AxisError, BroadcastError, IndexRangeError, ShapeMismatchError

Shape = tuple[int, ...]


def checked(shape) -> Shape:
    shape = tuple(int(n) for n in shape)
    if any(n < 0 for n in shape):
        raise ShapeMismatchError(f"negative dimension in {shape}")
    return shape


def size(shape: Shape) -> int:
    return prod(shape)


def strides(shape: Shape) -> list[int]:
    """Row-major strides in elements."""
    out = [1] * len(shape)
    for k in range(len(shape) - 2, -1, -1):
        out[k] = out[k + 1] * shape[k + 1]
    return out


def inferred(shape, total: int) -> Shape:
    """A target shape with at most one -1 filled in."""
    shape = tuple(int(n) for n in shape)
    if any(n < -1 for n in shape) or shape.count(-1) > 1:
        raise ShapeMismatchError(f"bad target shape {shape}")
    if -1 in shape:
        known = prod(n for n in shape if n != -1)
        if known == 0 or total % known:
            raise ShapeMismatchError(f"{total} elements do not fit {shape}")
        shape = tuple(total // known if n == -1 else n for n in shape)
    if prod(shape) != total:
        raise ShapeMismatchError(f"{total} elements do not fit {shape}")
    return shape


def axis_of(axis: int, ndim: int) -> int:
    if not -ndim <= axis < ndim:
        raise AxisError(f"axis {axis} is out of range for {ndim} dimensions")
    return axis % ndim


def broadcast(*shapes: Shape) -> Shape:
    n = max(map(len, shapes))
    out = []
    for dims in zip(*((1,) * (n - len(s)) + s for s in shapes), strict=True):
        wanted = {d for d in dims if d != 1}
        if len(wanted) > 1:
            raise BroadcastError(f"shapes {shapes} do not broadcast")
        out.append(wanted.pop() if wanted else 1)
    return tuple(out)


def reduced(shape: Shape, axis: int, keepdims: bool) -> Shape:
    return shape[:axis] + ((1,) if keepdims else ()) + shape[axis + 1 :]


def div(col: Column, n: int) -> Column:
    """Whole quotient of a non-negative bigint column, in integers throughout."""
    return col if n == 1 else F.call_function("div", col, F.lit(n).cast("bigint"))


def mod(col: Column, n: int) -> Column:
    return F.pmod(col, F.lit(n).cast("bigint")) if n else F.lit(0).cast("bigint")


def coordinate(lin: Column, shape: Shape, axis: int) -> Column:
    """Coordinate on an axis of the cell with linear index lin."""
    out = div(lin, max(1, strides(shape)[axis]))
    return out if axis == 0 else mod(out, shape[axis])


def relinear(coordinates: list[Column], shape: Shape) -> Column:
    """Linear index of a cell from its coordinates."""
    out = F.lit(0).cast("bigint")
    for c, step in zip(coordinates, strides(shape), strict=True):
        out = out + (c if step == 1 else c * F.lit(step).cast("bigint"))
    return out


@dataclass(frozen=True)
class Index:
    """Basic index of one axis: an integer (drops the axis) or start:stop:step."""

    at: int | None = None
    start: int | None = None
    stop: int | None = None
    step: int = 1

    def resolve(self, n: int) -> tuple[int, int, int, bool]:
        """(first, step, count, drops the axis) on an axis of length n."""
        if self.at is not None:
            if not -n <= self.at < n:
                raise IndexRangeError(f"index {self.at} is out of range for length {n}")
            return self.at % n, 1, 1, True
        if self.step == 0:
            raise IndexRangeError("step 0")
        r = range(*slice(self.start, self.stop, self.step).indices(n))
        return (r[0] if len(r) else 0), self.step, len(r), False


def at(i: int) -> Index:
    return Index(at=int(i))


def everything() -> Index:
    return Index()


def between(start: int, stop: int) -> Index:
    return Index(start=start, stop=stop)


def strided(start: int, stop: int, step: int) -> Index:
    return Index(start=start, stop=stop, step=step)


def starting(start: int) -> Index:
    return Index(start=start)


def until(stop: int) -> Index:
    return Index(stop=stop)


def every(step: int) -> Index:
    return Index(step=step)
