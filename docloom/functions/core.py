"""Values, accumulators and the frame in whose schema an expression is built."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from datetime import date, datetime
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_frame: ContextVar[DataFrame | None] = ContextVar("frame", default=None)

#: (column, rising) pairs that say in which order an accumulator sees rows.
Order = list[tuple[Column, bool]]


@contextmanager
def building(df: DataFrame | None) -> Iterator[None]:
    """Expressions built inside are resolved against df where their type matters."""
    token = _frame.set(df)
    try:
        yield
    finally:
        _frame.reset(token)


class Remove:
    """Marks a field to be dropped."""


REMOVE = Remove()


class Acc:
    """An accumulator: an aggregate that may depend on the order of rows, with an expression form where there is one.

    over(order) builds the aggregate column; framed(window) the window column. first: steps of helper columns that
    framed reads, each a function of (order, partition, prefix of their names) to columns by name. few: of each group only
    that many rows are needed, the first ones in the order that the function makes of the pipeline's. ranks: the value and
    the fractions of a group's values where those wanted stand; a group stage counts values to find them.
    """

    def __init__(self, over: Callable[[Order], Column] | None, expr: Callable[[], Column] | None = None, framed: Callable[..., Column] | None = None, *, needs_sort: bool = False, single_key: bool = False, needs_frame: bool = False, ranked: bool = False, first: Iterable[Callable[..., dict[str, Column]]] = (), few: tuple[Callable[[Order], Order], int] | None = None, ranks: tuple[Column, float | list[float]] | None = None):
        self.first, self.few, self.ranks = tuple(first), few, ranks
        self.over, self.expr, self.framed = over, expr, framed
        self.needs_sort, self.single_key, self.needs_frame, self.ranked = needs_sort, single_key, needs_frame, ranked
        self.frame: dict | None = None


def lit(value: Any) -> Column:
    """A literal; lists become arrays and dictionaries structs. Strings are never paths."""
    if isinstance(value, dict):
        return F.struct(*(to_col(v).alias(k) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return F.array(*map(to_col, value))
    if isinstance(value, datetime) and value.tzinfo is None:
        return F.lit(value).cast("timestamp_ntz")
    return F.lit(value)


def to_col(value: Any) -> Column:
    if isinstance(value, Column):
        return value
    if isinstance(value, Acc):
        if value.expr is None:
            raise TypeError("this accumulator has no expression form")
        return value.expr()
    if isinstance(value, Remove):
        return F.lit(None)
    return lit(value)


def type_of(col: Any) -> T.DataType | None:
    """The type of an expression in the frame being built, or None where it can't be told (inside lambdas)."""
    if not isinstance(col, (Column, Acc)):
        return next((k for p, k in ((bool, T.BooleanType()), (int, T.LongType()), (float, T.DoubleType()), (str, T.StringType()), (Decimal, T.DecimalType(38, 18)), (datetime, T.TimestampNTZType()), (date, T.DateType())) if isinstance(col, p)), None)
    df = _frame.get()
    if df is None:
        return None
    try:
        return df.select(to_col(col).alias("x")).schema[0].dataType
    except Exception:  # a lambda variable or an outer reference: not resolvable on its own
        return None


def is_date(col: Any) -> bool:
    return isinstance(type_of(col), (T.TimestampType, T.TimestampNTZType, T.DateType))


def column(path: str) -> Column:
    """A dotted path; number segments address elements."""
    head, *rest = path.split(".")
    out = F.col(f"`{head}`")
    for part in rest:
        out = F.get(out, F.lit(int(part))) if part.isdigit() else out[part]
    return out


class Fields:
    """Field references: f.total, f["address.city"]."""

    def __getattr__(self, name: str) -> Column:
        if name.startswith("__"):
            raise AttributeError(name)
        return column(name)

    def __getitem__(self, path: str) -> Column:
        return column(path)


def evaluate(df: DataFrame, spec: Any) -> Any:
    """Calls spec with the fields of df if it is a function."""
    with building(df):
        return spec(Fields()) if callable(spec) and not isinstance(spec, (Column, Acc)) else spec


def sort_key(order: Order) -> Column:
    """A struct whose rising order is the given order. Falling keys must be numbers, dates or booleans."""
    parts = []
    for i, (col, rising) in enumerate(order):
        if rising:
            parts.append(col.alias(f"k{i}"))
        else:
            kind = type_of(col)
            if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
                col = F.unix_micros(col.cast("timestamp"))
            elif isinstance(kind, T.BooleanType):
                col = col.cast("int")
            elif isinstance(kind, T.StringType):
                raise TypeError("a falling text key needs compare()")
            parts.append(F.struct(col.isNull().alias("null"), (-col).alias("v")).alias(f"k{i}"))
    return F.struct(*parts)


def compare(keys: Iterable[str], rising: list[bool]) -> Callable[[Column, Column], Column]:
    """Comparator of structs on several fields, null lowest."""

    def run(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for key, up in reversed(list(zip(keys, rising, strict=True))):
            x, y = (a[key], b[key]) if up else (b[key], a[key])
            less = F.when(x.isNull() & y.isNull(), None).when(x.isNull(), -1).when(y.isNull(), 1).when(x < y, -1).when(x > y, 1)
            out = F.coalesce(less, out)
        return out

    return run


def directions(spec: Any) -> list[tuple[str, bool]]:
    """{path: 1 | -1 | "asc" | "desc" ...} or [(path, direction)] as (path, rising)."""
    items = spec.items() if isinstance(spec, dict) else spec
    out = []
    for path, d in items:
        if d in (1, "asc", "ascending"):
            out.append((path, True))
        elif d in (-1, "desc", "descending"):
            out.append((path, False))
        else:
            raise ValueError(f"unknown sort direction {d!r}")
    if not out:
        raise ValueError("a sort needs a key")
    return out
