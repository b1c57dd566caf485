"""The expression catalogue. Names are in snake case; the camel case forms work too (fn.date_trunc, fn.dateTrunc).

Missing counts as null. Functions that depend on a type look it up in the frame they are built for.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import reduce as fold
from typing import Any

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .core import REMOVE, Acc, Order, compare, directions, is_date, sort_key, to_col
from .core import type_of as kind_of

c = to_col


def _raise(message: str) -> Column:
    return F.raise_error(F.lit(message))


def _or_error(x: Column, message: str) -> Column:
    return F.coalesce(x, F.when(F.lit(True), _raise(message)))


def _truthy(x: Column) -> Column:
    """x as a boolean that is never null; a comparison of ours already is one, and stays bare for the optimizer."""
    return x if vars(x).get("_definite") else F.coalesce(x.cast("boolean"), F.lit(False))


def _definite(x: Column) -> Column:
    """Marks a boolean column that is never null."""
    x._definite = True
    return x


# --- arithmetic


def _same_type(name: str) -> Callable[[Any], Column]:
    def run(x: Any) -> Column:
        kind, out = kind_of(x), getattr(F, name)(c(x))
        return out.cast(kind) if kind is not None else out

    return run


def abs(x: Any) -> Column:
    return F.abs(c(x))


ceil, floor = _same_type("ceil"), _same_type("floor")


def sqrt(x: Any) -> Column:
    x = c(x)
    return F.when(x < 0, _raise("sqrt of a negative number")).otherwise(F.sqrt(x))


def ln(x: Any) -> Column:
    x = c(x)
    return F.when(x <= 0, _raise("ln of a number that is not positive")).otherwise(F.ln(x))


def log10(x: Any) -> Column:
    x = c(x)
    return F.when(x <= 0, _raise("log10 of a number that is not positive")).otherwise(F.log10(x))


def log(x: Any, base: Any) -> Column:
    return F.ln(c(x)) / F.ln(c(base))


def _plain(name: str) -> Callable[[Any], Column]:
    return lambda x: getattr(F, name)(c(x))


exp, sin, cos, tan, asin, acos, atan = (_plain(n) for n in ("exp", "sin", "cos", "tan", "asin", "acos", "atan"))
sinh, cosh, tanh, asinh, acosh, atanh = (_plain(n) for n in ("sinh", "cosh", "tanh", "asinh", "acosh", "atanh"))
degrees_to_radians, radians_to_degrees = _plain("radians"), _plain("degrees")


def atan2(y: Any, x: Any) -> Column:
    return F.atan2(c(y), c(x))


def sigmoid(x: Any) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c(x)))


def _millis(d: Column) -> Column:
    return F.unix_millis(d.cast("timestamp"))


def _micros(d: Column) -> Column:
    return F.unix_micros(d.cast("timestamp"))


def _like(d: Any, micros: Column) -> Column:
    """A date from microseconds, of the type of d."""
    out = F.timestamp_micros(micros.cast("bigint"))
    return out if isinstance(kind_of(d), T.TimestampType) else out.cast("timestamp_ntz")


def add(*xs: Any) -> Column:
    dates = [x for x in xs if is_date(x)]
    if len(dates) > 1:
        raise TypeError("add takes one date at most")
    if dates:
        return _like(dates[0], fold(lambda a, b: a + b, [_micros(c(x)) if x is dates[0] else (c(x) * 1000).cast("bigint") for x in xs]))
    return fold(lambda a, b: a + b, map(c, xs))


def subtract(a: Any, b: Any) -> Column:
    if is_date(a):
        return F.floor((_micros(c(a)) - _micros(c(b))) / 1000) if is_date(b) else _like(a, _micros(c(a)) - (c(b) * 1000).cast("bigint"))
    return c(a) - c(b)


def multiply(*xs: Any) -> Column:
    return fold(lambda a, b: a * b, map(c, xs))


def divide(a: Any, b: Any) -> Column:
    decimal = isinstance(kind_of(a), T.DecimalType) or isinstance(kind_of(b), T.DecimalType)
    return c(a) / c(b) if decimal else c(a).cast("double") / c(b)


def mod(a: Any, b: Any) -> Column:
    return c(a) % c(b)


def pow(a: Any, b: Any) -> Column:
    kinds, out = (kind_of(a), kind_of(b)), F.pow(c(a), c(b))
    whole = all(isinstance(k, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)) for k in kinds)
    return out.cast("bigint") if whole else out


def _scaled(x: Any, place: Any, how: Callable[[Column], Column]) -> Column:
    kind, power = kind_of(x), F.pow(F.lit(10.0), c(place))
    out = how(c(x) * power) / power
    return out.cast(kind) if kind is not None else out


def round(x: Any, place: Any = 0) -> Column:
    """Half to even; place may be negative or an expression."""
    if isinstance(place, int):
        kind, out = kind_of(x), F.bround(c(x), place)
        return out.cast(kind) if kind is not None else out
    return _scaled(x, place, F.bround)


def trunc(x: Any, place: Any = 0) -> Column:
    return _scaled(x, place, lambda v: F.signum(v) * F.floor(F.abs(v)))


# --- strings


def to_upper(s: Any) -> Column:
    return F.upper(F.coalesce(c(s).cast("string"), F.lit("")))


def to_lower(s: Any) -> Column:
    return F.lower(F.coalesce(c(s).cast("string"), F.lit("")))


def str_len_cp(s: Any) -> Column:
    return F.char_length(_or_error(c(s), "str_len_cp needs a string"))


def str_len_bytes(s: Any) -> Column:
    return F.octet_length(_or_error(c(s), "str_len_bytes needs a string"))


def concat(*xs: Any) -> Column:
    return F.concat(*map(c, xs))


def split(s: Any, delimiter: Any) -> Column:
    if isinstance(delimiter, str):
        return F.split(c(s), re.escape(delimiter), -1)
    return F.split(c(s), F.concat(F.lit("\\Q"), c(delimiter), F.lit("\\E")), -1)


def strcasecmp(a: Any, b: Any) -> Column:
    x, y = to_lower(a), to_lower(b)
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def substr_cp(s: Any, start: Any, length: Any) -> Column:
    return F.substring(F.coalesce(c(s), F.lit("")), c(start) + 1, c(length))


def substr_bytes(s: Any, start: Any, length: Any) -> Column:
    return F.decode(F.substring(F.encode(F.coalesce(c(s), F.lit("")), "UTF-8"), c(start) + 1, c(length)), "UTF-8")


substr = substr_bytes


def index_of_cp(s: Any, sub: Any, start: Any = 0, end: Any = None) -> Column:
    text = c(s) if end is None else F.substring(c(s), F.lit(1), c(end))
    return F.locate(sub, text, start + 1) - 1 if isinstance(sub, str) and isinstance(start, int) else F.call_function("locate", c(sub), text, c(start) + 1) - 1


def index_of_bytes(s: Any, sub: Any, start: Any = 0, end: Any = None) -> Column:
    data = F.encode(c(s), "UTF-8") if end is None else F.substring(F.encode(c(s), "UTF-8"), F.lit(1), c(end))
    part = F.decode(F.substring(data, c(start) + 1, F.lit(2**31 - 1)), "UTF-8")
    found = F.call_function("locate", c(sub), part)
    before = F.octet_length(F.substring(part, F.lit(1), found - 1))
    return F.when(found > 0, before + c(start)).when(found == 0, -1)


def trim(input: Any, chars: Any = None) -> Column:
    return F.btrim(c(input), c(" \t\n\r\0\f\v " if chars is None else chars))


def ltrim(input: Any, chars: Any = None) -> Column:
    return F.ltrim(c(input), c(" \t\n\r\0\f\v " if chars is None else chars))


def rtrim(input: Any, chars: Any = None) -> Column:
    return F.rtrim(c(input), c(" \t\n\r\0\f\v " if chars is None else chars))


def replace_one(input: Any, find: Any, replacement: Any) -> Column:
    s, f, r = c(input), c(find), c(replacement)
    at = F.call_function("locate", f, s)
    return F.when(at > 0, F.concat(F.substring(s, F.lit(1), at - 1), r, F.substring(s, at + F.char_length(f), F.char_length(s)))).when(at == 0, s)


def replace_all(input: Any, find: Any, replacement: Any) -> Column:
    return F.replace(c(input), c(find), c(replacement))


def _pattern(regex: Any, options: str = "") -> str:
    source = regex.pattern if isinstance(regex, re.Pattern) else regex
    flags = "".join(o for o in options if o in "imsx")
    if isinstance(regex, re.Pattern):
        flags += "".join(o for o, bit in (("i", re.I), ("m", re.M), ("s", re.S), ("x", re.X)) if regex.flags & bit and o not in flags)
    return f"(?{flags}){source}" if flags else source


def regex_match(input: Any, regex: Any, options: str = "") -> Column:
    return F.coalesce(c(input).rlike(_pattern(regex, options)), F.lit(False))


def _groups(pattern: str) -> int:
    return len(re.findall(r"(?<!\\)\((?!\?)|(?<!\\)\(\?<[a-zA-Z]", re.sub(r"\[[^\]]*\]", "", pattern)))


def regex_find(input: Any, regex: Any, options: str = "") -> Column:
    """{match, idx, captures} of the first match or null; a group that took no part is an empty string."""
    p, s = _pattern(regex, options), c(input)
    captures = [F.regexp_extract(s, p, i) for i in range(1, _groups(p) + 1)]
    found = F.struct(F.regexp_extract(s, p, 0).alias("match"), (F.regexp_instr(s, F.lit(p)) - 1).alias("idx"), (F.array(*captures) if captures else F.array().cast("array<string>")).alias("captures"))
    return F.when(s.rlike(p), found)


def regex_find_all(input: Any, regex: Any, options: str = "") -> Column:
    """Every match as {match, idx, captures}; each is looked for behind the end of the one before."""
    p, s = _pattern(regex, options), c(input)
    every = F.regexp_extract_all(s, F.lit(p), F.lit(0))
    groups = [F.regexp_extract_all(s, F.lit(p), F.lit(i)) for i in range(1, _groups(p) + 1)]
    captures = lambda i: F.array(*(F.get(g, i) for g in groups)) if groups else F.array().cast("array<string>")
    kind = "struct<at:int,out:array<struct<match:string,idx:int,captures:array<string>>>>"
    start = F.struct(F.lit(1).alias("at"), F.array().alias("out")).cast(kind)

    def step(acc: Column, i: Column) -> Column:
        m = F.get(every, i)
        at = F.call_function("locate", m, s, acc["at"])
        one = F.struct(m.alias("match"), (at - 1).alias("idx"), captures(i).alias("captures"))
        return F.struct((at + F.greatest(F.char_length(m), F.lit(1))).alias("at"), F.concat(acc["out"], F.array(one)).alias("out")).cast(kind)

    numbers = F.when(F.size(every) > 0, F.sequence(F.lit(0), F.size(every) - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(s.isNotNull(), F.aggregate(numbers, start, step, lambda a: a["out"])).otherwise(F.array().cast("array<struct<match:string,idx:int,captures:array<string>>>"))


# --- logic


def and_(*xs: Any) -> Column:
    return _definite(fold(lambda a, b: a & b, [_truthy(c(x)) for x in xs], F.lit(True)))


def or_(*xs: Any) -> Column:
    return _definite(fold(lambda a, b: a | b, [_truthy(c(x)) for x in xs], F.lit(False)))


def not_(x: Any) -> Column:
    return _definite(~_truthy(c(x)))


def cmp(a: Any, b: Any) -> Column:
    """-1, 0 or 1 in the order of values; null is lowest."""
    x, y = c(a), c(b)
    return F.when(x.eqNullSafe(y), 0).when(x.isNull(), -1).when(y.isNull(), 1).when(x < y, -1).otherwise(1)


def eq(a: Any, b: Any) -> Column:
    return _definite(c(a).eqNullSafe(c(b)))


def ne(a: Any, b: Any) -> Column:
    return _definite(~c(a).eqNullSafe(c(b)))


# Comparisons with null lowest, never null themselves; with a literal they fold to a null check and a plain comparison.


def gt(a: Any, b: Any) -> Column:
    x, y = c(a), c(b)
    return _definite(x.isNotNull() & (y.isNull() | (x > y)))


def gte(a: Any, b: Any) -> Column:
    x, y = c(a), c(b)
    return _definite(y.isNull() | (x.isNotNull() & (x >= y)))


def lt(a: Any, b: Any) -> Column:
    return gt(b, a)


def lte(a: Any, b: Any) -> Column:
    return gte(b, a)


def is_in(value: Any, array: Any) -> Column:
    v = c(value)
    return F.exists(_or_error(c(array), "is_in needs an array"), lambda x: x.eqNullSafe(v))


def cond(if_: Any, then: Any, else_: Any) -> Column:
    return F.when(_truthy(c(if_)), c(then)).otherwise(c(else_))


def switch(branches: list, default: Any = ...) -> Column:
    """branches: (case, then) pairs or {"case", "then"}; no match without a default is an error."""
    out = F
    for b in branches:
        case, then = (b["case"], b["then"]) if isinstance(b, dict) else b
        out = out.when(_truthy(c(case)), c(then))
    return out.otherwise(_raise("no branch of switch matched") if default is ... else c(default))


def if_null(*xs: Any) -> Column:
    return F.coalesce(*map(c, xs))


def literal(value: Any) -> Column:
    return c(value)


# --- arrays and sets


def size(array: Any) -> Column:
    return F.size(_or_error(c(array), "size needs an array"))


def reverse_array(a: Any) -> Column:
    return F.reverse(c(a))


def concat_arrays(*xs: Any) -> Any:
    expr = lambda: F.concat(*map(c, xs))
    if len(xs) > 1:
        return expr()
    gather = _gather(xs[0])
    return Acc(lambda order: F.flatten(gather(order)), expr)


def _sorted_set(a: Column) -> Column:
    return F.array_sort(F.array_distinct(a))


def set_union(*xs: Any) -> Any:
    expr = lambda: _sorted_set(fold(F.array_union, map(c, xs)))
    if len(xs) > 1:
        return expr()
    return Acc(lambda order: _sorted_set(F.flatten(F.collect_set(c(xs[0])))), expr)


def set_intersection(*xs: Any) -> Column:
    return _sorted_set(fold(F.array_intersect, map(c, xs)))


def set_difference(a: Any, b: Any) -> Column:
    return F.array_except(c(a), c(b))


def set_is_subset(a: Any, b: Any) -> Column:
    return F.size(F.array_except(_or_error(c(a), "set_is_subset needs arrays"), _or_error(c(b), "set_is_subset needs arrays"))) == 0


def set_equals(*xs: Any) -> Column:
    own = [_sorted_set(c(x)) for x in xs]
    return fold(lambda a, b: a & b, [own[0].eqNullSafe(o) for o in own[1:]])


def index_of_array(a: Any, value: Any, start: Any = 0, end: Any = None) -> Column:
    first, arr = c(start), c(a)
    last = F.size(arr) if end is None else F.least(c(end), F.size(arr))
    part = F.when(last > first, F.slice(arr, first + 1, F.greatest(last - first, F.lit(0)))).otherwise(F.slice(arr, 1, 0))
    at = F.array_position(part, c(value))
    return F.when(arr.isNull(), None).when(at > 0, at - 1 + first).otherwise(-1).cast("int")


def range_(start: Any, end: Any, step: Any = 1) -> Column:
    """Whole numbers, the end left out; empty where the step leads away from it."""
    a, b, s = c(start).cast("int"), c(end).cast("int"), c(step).cast("int")
    last = b - F.signum(s.cast("double")).cast("int")
    right = F.when(s > 0, a < b).when(s < 0, a > b).otherwise(_raise("range needs a step"))
    return F.when(right, F.sequence(a, F.when(right, last).otherwise(a), F.when(right, s).otherwise(F.lit(0)))).otherwise(F.array().cast("array<int>"))


def zip(inputs: list, use_longest_length: bool = False, defaults: list | None = None) -> Column:
    own = [c(x) for x in inputs]
    n = (F.greatest if use_longest_length else F.least)(*(F.size(x) for x in own)) if len(own) > 1 else F.size(own[0])
    rest = defaults or [None] * len(own)
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    pick = lambda x, i, d: F.get(x, i) if d is None else F.when(i < F.size(x), F.get(x, i)).otherwise(c(d))
    out = F.transform(at, lambda i: F.array(*(pick(x, i, rest[k]) for k, x in enumerate(own))))
    return F.when(fold(lambda a, b: a & b, [x.isNotNull() for x in own]), out)


def slice(a: Any, *args: Any) -> Column:
    """slice(a, n) or slice(a, position, n)."""
    arr = c(a)
    size_ = F.size(arr)
    if len(args) == 1:
        n = c(args[0])
        count = F.least(F.abs(n), size_)
        return F.when(n >= 0, F.slice(arr, F.lit(1), F.greatest(count, F.lit(0)))).otherwise(F.slice(arr, F.greatest(size_ - count + 1, F.lit(1)), F.greatest(count, F.lit(0))))
    at, n = c(args[0]), c(args[1])
    first = F.when(at < 0, F.greatest(size_ + at, F.lit(0))).otherwise(F.least(at, size_))
    return F.slice(arr, first + 1, F.greatest(F.least(n, size_ - first), F.lit(0)))


def all_elements_true(a: Any) -> Column:
    return F.forall(c(a), _truthy)


def any_element_true(a: Any) -> Column:
    return F.exists(c(a), _truthy)


def array_elem_at(a: Any, i: Any) -> Column:
    arr, at = c(a), c(i)
    return F.when(at >= 0, F.get(arr, at)).otherwise(F.get(arr, F.size(arr) + at))


def array_to_object(pairs: Any) -> Column:
    """[{k, v}] to a map."""
    return F.map_from_entries(F.transform(c(pairs), lambda p: F.struct(p["k"].alias("key"), p["v"].alias("value"))))


def sort_array(input: Any, sort_by: Any) -> Column:
    if isinstance(sort_by, dict):
        spec = directions(sort_by)
        return F.array_sort(c(input), compare([p for p, _ in spec], [d for _, d in spec]))
    rising = directions([("x", sort_by)])[0][1]
    return F.sort_array(c(input), rising)


def map_(input: Any, in_: Callable[[Column], Any]) -> Column:
    return F.transform(c(input), lambda x: c(in_(x)))


def filter_(input: Any, cond: Callable[[Column], Any], limit: Any = None) -> Column:
    out = F.filter(c(input), lambda x: _truthy(c(cond(x))))
    return out if limit is None else F.slice(out, F.lit(1), c(limit))


def reduce(input: Any, initial_value: Any, in_: Callable[[Column, Column], Any]) -> Column:
    return F.aggregate(c(input), c(initial_value), lambda acc, x: c(in_(acc, x)))


# --- objects


def _struct_fields(x: Any) -> list[str]:
    kind = kind_of(x)
    if not isinstance(kind, T.StructType):
        raise TypeError("a document expression is needed")
    return kind.fieldNames()


def merge_objects(*docs: Any) -> Any:
    """Left to right, null documents add nothing; with one argument also an accumulator in the order of rows."""
    if len(docs) == 1:
        fields = _struct_fields(docs[0])
        doc = c(docs[0])

        def over(order: Order) -> Column:
            key = sort_key(order) if order else F.struct(doc)
            return F.struct(*(F.max_by(doc[f], F.when(doc[f].isNotNull(), key)).alias(f) for f in fields))

        return Acc(over, lambda: doc)
    own: dict[str, Column] = {}
    for d in docs:
        doc = c(d)
        for f in _struct_fields(d):
            own[f] = F.when(doc.isNotNull(), doc[f]).otherwise(own[f]) if f in own else doc[f]
    return F.struct(*(v.alias(k) for k, v in own.items()))


def object_to_array(doc: Any) -> Column:
    if isinstance(kind_of(doc), T.MapType):
        return F.transform(F.map_entries(c(doc)), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))
    own = c(doc)
    return F.when(own.isNotNull(), F.array(*(F.struct(F.lit(f).alias("k"), own[f].alias("v")) for f in _struct_fields(doc))))


def get_field(field: str, input: Any) -> Column:
    return c(input).getField(field)


def set_field(field: str, input: Any, value: Any) -> Column:
    return c(input).withField(f"`{field}`", c(value)) if value is not REMOVE else unset_field(field, input)


def unset_field(field: str, input: Any) -> Column:
    return c(input).dropFields(f"`{field}`")


def let(vars: dict[str, Any], in_: Callable[..., Any]) -> Column:
    return c(in_(**{k: c(v) for k, v in vars.items()}))


# --- dates

UNIT_MS = {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000, "week": 604_800_000}
MONTHS = {"month": 1, "quarter": 3, "year": 12}
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
#: Bins of date_trunc are counted from here (milliseconds of 2000-01-01T00:00Z).
ORIGIN_MS = 946_684_800_000


def _local(d: Any, timezone: str | None) -> Column:
    out = c(d)
    if timezone and timezone not in ("UTC", "GMT", "Z"):
        return F.from_utc_timestamp(out.cast("timestamp"), timezone)
    return out


def _back(d: Column, timezone: str | None, like: Any) -> Column:
    out = F.to_utc_timestamp(d, timezone) if timezone and timezone not in ("UTC", "GMT", "Z") else d
    return out if isinstance(kind_of(like), T.TimestampType) else out.cast("timestamp_ntz")


def _part(take: Callable[[Column], Column], kind: str = "int") -> Callable[..., Column]:
    return lambda d, timezone=None: take(_local(d, timezone)).cast(kind)


year, month, day_of_month = _part(F.year), _part(F.month), _part(F.dayofmonth)
hour, minute = _part(F.hour), _part(F.minute)
second = _part(lambda d: F.second(d))
millisecond = _part(lambda d: F.pmod(_millis(d), F.lit(1000)))
day_of_week, day_of_year = _part(F.dayofweek), _part(F.dayofyear)
week = _part(lambda d: F.floor((F.dayofyear(d) + 7 - F.dayofweek(d)) / 7))
iso_week = _part(F.weekofyear)
iso_week_year = _part(lambda d: F.extract(F.lit("YEAROFWEEK"), d), "bigint")
iso_day_of_week = _part(lambda d: F.weekday(d) + 1)


def date_add(start_date: Any, unit: str, amount: Any, timezone: str | None = None) -> Column:
    local, n = _local(start_date, timezone), c(amount).cast("bigint")
    if unit == "millisecond":
        moved = F.timestamp_micros(_micros(local) + n * 1000)
    else:
        moved = F.timestamp_add(unit.upper(), n.cast("int"), local)
    return _back(moved, timezone, start_date)


def date_subtract(start_date: Any, unit: str, amount: Any, timezone: str | None = None) -> Column:
    return date_add(start_date, unit, -c(amount), timezone)


def _week_shift(start_of_week: str) -> int:
    name = next((d for d in WEEKDAYS if d.startswith(start_of_week.lower()[:3])), None)
    if name is None:
        raise ValueError(f"unknown day {start_of_week!r}")
    return WEEKDAYS.index(name)


def _days(d: Column) -> Column:
    return F.datediff(d.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")


def date_diff(start_date: Any, end_date: Any, unit: str, timezone: str | None = None, start_of_week: str = "sunday") -> Column:
    """Unit boundaries crossed from start to end."""
    a, b = _local(start_date, timezone), _local(end_date, timezone)
    if unit in MONTHS:
        number = lambda d: F.floor((F.year(d) * 12 + F.month(d) - 1) / MONTHS[unit])
    elif unit == "day":
        number = _days
    elif unit == "week":
        number = lambda d: F.floor((_days(d) + 3 - _week_shift(start_of_week)) / 7)  # noqa: E731  day 0 was a Thursday
    else:
        number = lambda d: F.floor(_millis(d) / UNIT_MS[unit])
    return (number(b) - number(a)).cast("bigint")


def date_trunc(date: Any, unit: str, bin_size: int = 1, timezone: str | None = None, start_of_week: str = "sunday") -> Column:
    d = _local(date, timezone)
    if unit in MONTHS:
        step = MONTHS[unit] * bin_size
        n = F.year(d) * 12 + F.month(d) - 1
        base = 2000 * 12
        low = F.floor((n - base) / step) * step + base
        out = F.make_date(F.floor(low / 12).cast("int"), (F.pmod(low, F.lit(12)) + 1).cast("int"), F.lit(1)).cast("timestamp")
    else:
        size_ms, origin = UNIT_MS[unit] * bin_size, ORIGIN_MS
        if unit == "week":  # 2000-01-01 was a Saturday; the first week start at or before it
            origin -= ((5 - _week_shift(start_of_week)) % 7) * UNIT_MS["day"]
        out = F.timestamp_millis((F.floor((_millis(d) - origin) / size_ms) * size_ms + origin).cast("bigint"))
    return _back(out, timezone, date)


def date_from_parts(year: Any = None, month: Any = 1, day: Any = 1, hour: Any = 0, minute: Any = 0, second: Any = 0, millisecond: Any = 0, timezone: str | None = None, iso_week_year: Any = None, iso_week: Any = 1, iso_day_of_week: Any = 1) -> Column:
    """Parts out of range carry over; calendar and ISO parts never mix."""
    if (year is None) == (iso_week_year is None):
        raise ValueError("either year or iso_week_year is needed")
    if year is not None:
        n = c(year) * 12 + c(month) - 1
        first = F.make_date(F.floor(n / 12).cast("int"), (F.pmod(n, F.lit(12)) + 1).cast("int"), F.lit(1))
        start = F.date_add(first, (c(day) - 1).cast("int"))
    else:
        fourth = F.make_date(c(iso_week_year).cast("int"), F.lit(1), F.lit(4))
        start = F.date_add(fourth, (-F.weekday(fourth) + (c(iso_week) - 1) * 7 + c(iso_day_of_week) - 1).cast("int"))
    ms = _millis(start) + c(hour) * 3_600_000 + c(minute) * 60_000 + c(second) * 1000 + c(millisecond)
    out = F.timestamp_millis(ms.cast("bigint"))
    return (F.to_utc_timestamp(out, timezone) if timezone and timezone != "UTC" else out).cast("timestamp_ntz")


def date_to_parts(date: Any, timezone: str | None = None, iso8601: bool = False) -> Column:
    tail = [(n, f(date, timezone)) for n, f in (("hour", hour), ("minute", minute), ("second", second), ("millisecond", millisecond))]
    if iso8601:
        head = [("isoWeekYear", iso_week_year(date, timezone)), ("isoWeek", iso_week(date, timezone)), ("isoDayOfWeek", iso_day_of_week(date, timezone))]
    else:
        head = [("year", year(date, timezone)), ("month", month(date, timezone)), ("day", day_of_month(date, timezone))]
    return F.struct(*(v.alias(n) for n, v in head + tail))


#: Format letters and the patterns that stand for them.
_FORMATS = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "L": "SSS", "j": "DDD", "b": "MMM", "B": "MMMM", "z": "xx"}


def _format_parts(fmt: str) -> list[tuple[bool, str]]:
    return [(bool(m[1]), m[1] or m[0]) for m in re.finditer(r"%(.)|[^%]+", fmt, re.S)]


def date_to_string(date: Any, format: str | None = None, timezone: str | None = None, on_null: Any = None) -> Column:
    d = _local(date, timezone)
    if format is None:
        out = F.date_format(d.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS") if timezone else F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    else:
        own = []
        for special, x in _format_parts(format):
            if not special:
                own.append(F.lit(x))
            elif x == "%":
                own.append(F.lit("%"))
            elif x in ("u", "w", "U", "V", "G"):
                value = {"u": iso_day_of_week, "w": day_of_week, "U": week, "V": iso_week, "G": iso_week_year}[x](date, timezone)
                own.append(F.lpad(value.cast("string"), 2, "0") if x in "UV" else value.cast("string"))
            else:
                own.append(F.date_format(d, _FORMATS[x]))
        out = F.concat(*own)
    return F.when(c(date).isNull(), c(on_null)).otherwise(out)


def date_from_string(date_string: Any, format: str | None = None, timezone: str | None = None, on_error: Any = ..., on_null: Any = None) -> Column:
    s = c(date_string)
    pattern = None if format is None else "".join((_FORMATS[x] if x != "%" else "%") if special else "".join(f"'{k}'" if k.isalpha() else k for k in x) for special, x in _format_parts(format))
    parse = F.try_to_timestamp if on_error is not ... else F.to_timestamp
    out = parse(s) if pattern is None else parse(s, F.lit(pattern) if on_error is not ... else pattern)
    if timezone and timezone != "UTC":
        out = F.to_utc_timestamp(out, timezone)
    out = out.cast("timestamp_ntz")
    if on_error is not ...:
        out = F.coalesce(out, c(on_error).cast("timestamp_ntz"))
    return F.when(s.isNull(), c(on_null).cast("timestamp_ntz")).otherwise(out)


def ts_second(ts: Any) -> Column:
    return c(ts)["t"]


def ts_increment(ts: Any) -> Column:
    return c(ts)["i"]


# --- conversion


def to_string(x: Any) -> Column:
    return date_to_string(x) if is_date(x) and not isinstance(kind_of(x), T.DateType) else c(x).cast("string")


to_string_ = to_string


def to_bool(x: Any) -> Column:
    kind, v = kind_of(x), c(x)
    if isinstance(kind, T.BooleanType):
        return v
    if isinstance(kind, T.NumericType):
        return v != 0
    return F.when(v.isNotNull(), F.lit(True))


def _number(kind: str) -> Callable[[Any], Column]:
    def run(x: Any) -> Column:
        v = _millis(c(x)) if is_date(x) else c(x)
        own = kind_of(x)
        if kind in ("int", "bigint") and isinstance(own, (T.DoubleType, T.FloatType, T.DecimalType)):
            v = F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v))
        return v.cast(kind)

    return run


to_int, to_long, to_double, to_decimal = _number("int"), _number("bigint"), _number("double"), _number("decimal(38,18)")


def to_date(x: Any) -> Column:
    kind, v = kind_of(x), c(x)
    if isinstance(kind, T.IntegerType):
        raise TypeError("to_date refuses int32")
    if isinstance(kind, T.StringType):
        id_time = F.timestamp_seconds(F.conv(F.substring(v, 1, 8), 16, 10).cast("bigint"))
        return F.when(v.rlike("^[0-9a-fA-F]{24}$"), id_time).otherwise(F.to_timestamp(v)).cast("timestamp_ntz")
    if isinstance(kind, T.StructType):
        return F.timestamp_seconds(v["t"]).cast("timestamp_ntz")
    return v if is_date(x) else F.timestamp_millis(v.cast("bigint")).cast("timestamp_ntz")


def to_object_id(x: Any) -> Column:
    v = c(x)
    return F.when(v.rlike("^[0-9a-fA-F]{24}$"), F.lower(v)).when(v.isNotNull(), _raise("not an object id"))


def to_uuid(x: Any) -> Column:
    v = c(x)
    return F.when(v.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), F.lower(v)).when(v.isNotNull(), _raise("not a UUID"))


def to_array(x: Any, element: str = "variant") -> Column:
    return c(x) if isinstance(kind_of(x), T.ArrayType) else F.from_json(c(x), f"array<{element}>")


def to_object(x: Any, schema: str | None = None) -> Column:
    return F.parse_json(c(x)) if schema is None else F.from_json(c(x), schema)


#: Type aliases and their columns.
_ALIASES = {"double": "double", "string": "string", "bool": "boolean", "int": "int", "long": "bigint", "decimal": "decimal(38,18)", "date": "timestamp_ntz", "binData": "binary", "objectId": "string", "uuid": "string"}


def convert(input: Any, to: str, format: str | None = None, on_error: Any = ..., on_null: Any = None) -> Column:
    v, kind = c(input), _ALIASES[to]
    if to == "binData" and format:
        out = {"base64": F.unbase64, "base64url": lambda x: F.unbase64(F.translate(x, "-_", "+/")), "hex": F.unhex, "utf8": lambda x: F.encode(x, "UTF-8"), "uuid": lambda x: F.unhex(F.replace(x, F.lit("-"), F.lit("")))}[format](v)
    elif to == "string" and format:
        dashed = lambda h: F.lower(F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))))
        out = {"base64": F.base64, "base64url": lambda x: F.rtrim(F.translate(F.base64(x), "+/", "-_"), F.lit("=")), "hex": F.hex, "utf8": lambda x: F.decode(x, "UTF-8"), "uuid": lambda x: dashed(F.hex(x))}[format](v)
    elif to == "bool":
        out = to_bool(input)
    elif is_date(input) and to in ("long", "double", "decimal"):
        out = _millis(v).cast(kind)
    elif is_date(input) and to == "string":
        out = to_string(input)
    elif to == "date" and isinstance(kind_of(input), T.NumericType):
        out = F.timestamp_millis(v.cast("bigint")).cast("timestamp_ntz")
    elif isinstance(kind_of(input), (T.DoubleType, T.DecimalType)) and to in ("int", "long"):
        out = (F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v))).try_cast(kind) if on_error is not ... else _number(kind)(input)
    else:
        out = v.try_cast(kind) if on_error is not ... else v.cast(kind)
    if on_error is not ...:
        out = F.coalesce(out, c(on_error).cast(kind))
    return F.when(v.isNull(), c(on_null).cast(kind)).otherwise(out)


def is_number(x: Any) -> Column:
    kind = kind_of(x)
    if kind is not None and not isinstance(kind, T.VariantType):
        return c(x).isNotNull() & F.lit(isinstance(kind, T.NumericType))
    return F.coalesce(F.typeof(c(x)).rlike("^(tinyint|smallint|int|bigint|float|double|decimal.*)$"), F.lit(False))


def is_array(x: Any) -> Column:
    kind = kind_of(x)
    if kind is not None:
        return c(x).isNotNull() & F.lit(isinstance(kind, T.ArrayType))
    return F.typeof(c(x)).startswith("array")


def type_name(kind: T.DataType | None) -> str:
    names = ((T.BooleanType, "bool"), (T.StringType, "string"), (T.DoubleType, "double"), (T.FloatType, "double"), (T.LongType, "long"), (T.IntegralType, "int"), (T.DecimalType, "decimal"), (T.TimestampType, "date"), (T.TimestampNTZType, "date"), (T.DateType, "date"), (T.BinaryType, "binData"), (T.ArrayType, "array"), (T.StructType, "object"), (T.MapType, "object"))
    return next((n for k, n in names if isinstance(kind, k)), "null")


def type_(x: Any) -> Column:
    """The type's alias; null for null and missing."""
    return F.when(c(x).isNull(), "null").otherwise(type_name(kind_of(x)))


type_of = type_


def subtype(x: Any) -> Column:
    return F.when(c(x).isNotNull(), F.lit(0))


def _hashed(input: Any, algorithm: str) -> Column:
    v = c(input)
    data = F.encode(v, "UTF-8") if isinstance(kind_of(input), T.StringType) else v
    if algorithm == "md5":
        return F.upper(F.md5(data))
    if algorithm == "sha256":
        return F.upper(F.sha2(data, 256))
    if algorithm == "xxh64":
        return F.lpad(F.hex(F.xxhash64(data)), 16, "0")
    raise ValueError(f"unknown algorithm {algorithm!r}")


def hash(input: Any, algorithm: str) -> Column:
    return F.when(c(input).isNotNull(), F.unhex(_hashed(input, algorithm)))


def hex_hash(input: Any, algorithm: str) -> Column:
    return F.when(c(input).isNotNull(), _hashed(input, algorithm))


def create_object_id() -> Column:
    return F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 24)


def to_hashed_index_key(x: Any) -> Column:
    return F.xxhash64(c(x))


def binary_size(x: Any) -> Column:
    return F.octet_length(c(x))


def _bson_value(v: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        size_ = F.octet_length(v) + 5
    elif isinstance(kind, T.BinaryType):
        size_ = F.octet_length(v) + 5
    elif isinstance(kind, (T.BooleanType,)):
        size_ = F.lit(1)
    elif isinstance(kind, T.DecimalType):
        size_ = F.lit(16)
    elif isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
        size_ = F.lit(4)
    elif isinstance(kind, T.StructType):
        size_ = _bson_fields(v, kind)
    elif isinstance(kind, T.ArrayType):
        digits = lambda i: F.char_length(i.cast("string"))
        pairs = F.transform(v, lambda x, i: F.coalesce(_bson_value(x, kind.elementType), F.lit(0)) + digits(i) + 2)
        size_ = F.aggregate(pairs, F.lit(5), lambda a, b: a + b.cast("int"))
    else:
        size_ = F.lit(8)
    return F.when(v.isNotNull(), size_.cast("int")).otherwise(0)


def _bson_fields(doc: Column, kind: T.StructType) -> Column:
    own = [_bson_value(doc[f.name], f.dataType) + len(f.name.encode()) + 2 for f in kind.fields]
    return fold(lambda a, b: a + b, own, F.lit(5))


def bson_size(doc: Any) -> Column:
    """Encoded size by type; a null field counts as a stored null."""
    kind = kind_of(doc)
    if not isinstance(kind, T.StructType):
        raise TypeError("bson_size needs a document")
    return F.when(c(doc).isNotNull(), _bson_fields(c(doc), kind))


def _ejson(v: Column, kind: T.DataType, relaxed: bool) -> Column:
    wrap = lambda name, x: F.when(v.isNotNull(), F.struct(x.alias(name)))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        if relaxed:
            return wrap("$date", F.date_format(v, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
        return wrap("$date", F.struct(_millis(v).cast("string").alias("$numberLong")))
    if isinstance(kind, T.DecimalType):
        return wrap("$numberDecimal", v.cast("string"))
    if isinstance(kind, T.BinaryType):
        return wrap("$binary", F.struct(F.base64(v).alias("base64"), F.lit("00").alias("subType")))
    if not relaxed and isinstance(kind, T.LongType):
        return wrap("$numberLong", v.cast("string"))
    if not relaxed and isinstance(kind, T.IntegralType):
        return wrap("$numberInt", v.cast("string"))
    if not relaxed and isinstance(kind, (T.DoubleType, T.FloatType)):
        return wrap("$numberDouble", v.cast("string"))
    if isinstance(kind, T.StructType):
        return F.when(v.isNotNull(), F.struct(*(_ejson(v[f.name], f.dataType, relaxed).alias(f.name) for f in kind.fields)))
    if isinstance(kind, T.ArrayType):
        return F.transform(v, lambda x: _ejson(x, kind.elementType, relaxed))
    return v


def serialize_ejson(input: Any, relaxed: bool = True, on_error: Any = None) -> Column:
    kind = kind_of(input)
    out = _ejson(c(input), kind, relaxed) if kind is not None else c(input)
    inner = out if isinstance(kind, (T.StructType, T.ArrayType, T.TimestampType, T.TimestampNTZType, T.DecimalType, T.BinaryType)) or not relaxed else None
    return F.to_json(inner) if inner is not None else F.regexp_replace(F.to_json(F.struct(out.alias("v")), {"ignoreNullFields": "false"}), r'^\{"v":|\}$', "")


def deserialize_ejson(input: Any, on_error: Any = ...) -> Column:
    if on_error is ...:
        return F.parse_json(c(input))
    return F.coalesce(F.try_parse_json(c(input)), F.parse_json(c(on_error)))


# --- bits, random numbers, metadata, vectors


def bit_and(*xs: Any) -> Column:
    return fold(lambda a, b: a.bitwiseAND(b), map(c, xs))


def bit_or(*xs: Any) -> Column:
    return fold(lambda a, b: a.bitwiseOR(b), map(c, xs))


def bit_xor(*xs: Any) -> Column:
    return fold(lambda a, b: a.bitwiseXOR(b), map(c, xs))


def bit_not(x: Any) -> Column:
    return F.bitwise_not(c(x))


def rand(seed: int | None = None) -> Column:
    return F.rand(seed)


def meta(name: str) -> Column:
    """A row's metadata, which search, geo and score stages keep in a hidden column."""
    return F.col(f"__meta_{name}")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def similarity_dot_product(a: Any, b: Any, score: bool = False) -> Column:
    out = _dot(c(a), c(b))
    return (1 + out) / 2 if score else out


def similarity_cosine(a: Any, b: Any, score: bool = False) -> Column:
    x, y = c(a), c(b)
    out = _dot(x, y) / (F.sqrt(_dot(x, x)) * F.sqrt(_dot(y, y)))
    return (1 + out) / 2 if score else out


def similarity_euclidean(a: Any, b: Any, score: bool = False) -> Column:
    parts = F.zip_with(c(a), c(b), lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
    out = F.sqrt(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x))
    return 1 / (1 + out) if score else out


# --- variables


def now() -> Column:
    return F.current_timestamp()


def cluster_time() -> Column:
    return F.struct(F.unix_timestamp().alias("t"), F.lit(1).cast("bigint").alias("i"))


def remove() -> Any:
    return REMOVE


def user_roles() -> Column:
    return F.array(F.current_user())


def keep() -> Column:
    return F.lit("keep")


def prune() -> Column:
    return F.lit("prune")


def descend() -> Column:
    return F.lit("descend")


# --- accumulators


def _numbers(a: Column) -> Column:
    return F.filter(a, lambda x: x.isNotNull())


def _dual(agg: Callable[[Column], Column], array: Callable[[Column], Column], framed: Callable | None = None) -> Callable[..., Any]:
    """One argument: accumulator, window function, and the same over the elements of an array; more: over the arguments."""

    def run(*xs: Any) -> Any:
        if len(xs) > 1:
            return array(F.array(*map(c, xs)))
        return Acc(lambda order: agg(c(xs[0])), lambda: array(c(xs[0])), lambda w: (framed or (lambda x, w: agg(x).over(w)))(c(xs[0]), w))

    return run


def _array_mean(a: Column) -> Column:
    a = _numbers(a)
    return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a))


def _array_deviation(a: Column, less: int) -> Column:
    a = _numbers(a)
    mean, n = _array_mean(a), F.size(a)
    total = F.aggregate(F.transform(a, lambda x: F.pow(x - mean, F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)
    return F.when(n > less, F.sqrt(total / (n - less)))


sum = _dual(lambda x: F.coalesce(F.sum(x), F.lit(0)), lambda a: F.aggregate(_numbers(a), F.lit(0.0), lambda s, x: s + x), lambda x, w: F.coalesce(F.sum(x).over(w), F.lit(0)))
avg = _dual(F.avg, _array_mean)
min = _dual(F.min, F.array_min)
max = _dual(F.max, F.array_max)
std_dev_pop = _dual(F.stddev_pop, lambda a: _array_deviation(a, 0))
std_dev_samp = _dual(F.stddev_samp, lambda a: _array_deviation(a, 1))


def count() -> Acc:
    return Acc(lambda order: F.count(F.lit(1)), None, lambda w: F.count(F.lit(1)).over(w))


def _gather(x: Any) -> Callable[[Order], Column]:
    """All values of a group in order, nulls kept."""

    def run(order: Order) -> Column:
        if not order:
            return F.transform(F.array_sort(F.collect_list(F.struct(c(x).alias("v")))), lambda s: s["v"])
        own = F.collect_list(F.struct(*(k.alias(f"k{i}") for i, (k, _) in enumerate(order)), c(x).alias("v")))
        names = [f"k{i}" for i, _ in enumerate(order)]
        up = [rising for _, rising in order]
        return F.transform(F.array_sort(own) if all_(up) else F.array_sort(own, compare(names, up)), lambda s: s["v"])

    return run


def all_(xs: list[bool]) -> bool:
    return False not in xs


def _framed_list(x: Any) -> Callable[..., Column]:
    return lambda w: F.transform(F.collect_list(F.struct(c(x).alias("v"))).over(w), lambda s: s["v"])


def push(x: Any) -> Acc:
    return Acc(_gather(x), None, _framed_list(x))


def add_to_set(x: Any) -> Acc:
    distinct = lambda rows: F.transform(F.array_sort(rows), lambda s: s["v"])
    return Acc(lambda order: distinct(F.collect_set(F.struct(c(x).alias("v")))), None, lambda w: distinct(F.collect_set(F.struct(c(x).alias("v"))).over(w)))


def _ends(x: Any, order: Order, last: bool) -> Column:
    if order and (all_([up for _, up in order]) or all_([not isinstance(kind_of(k), T.StringType) for k, up in order if not up])):
        return (F.max_by if last else F.min_by)(F.struct(c(x).alias("v")), sort_key(order))["v"]
    own = _gather(x)(order)
    return F.get(own, F.size(own) - 1) if last else F.get(own, F.lit(0))


def first(x: Any) -> Acc:
    return Acc(lambda order: _ends(x, order, False), lambda: F.get(c(x), F.lit(0)), lambda w: F.first(c(x)).over(w))


def last(x: Any) -> Acc:
    return Acc(lambda order: _ends(x, order, True), lambda: F.get(c(x), F.size(c(x)) - 1), lambda w: F.last(c(x)).over(w))


def _head(a: Column, n: Any) -> Column:
    return F.slice(a, F.lit(1), c(n).cast("int"))


def _tail(a: Column, n: Any) -> Column:
    k = F.least(c(n).cast("int"), F.size(a))
    return F.slice(a, F.greatest(F.size(a) - k + 1, F.lit(1)), k)


def _few(n: Any, order: Callable[[Order], Order], last: bool = False) -> tuple[Callable[[Order], Order], int] | None:
    """The bound of a group's rows where n is a plain number."""
    turned = lambda keys: [(k, up != last) for k, up in order(keys)]
    return (turned, n) if isinstance(n, int) else None


def first_n(input: Any, n: Any) -> Acc:
    return Acc(lambda order: _head(_gather(input)(order), n), lambda: _head(c(input), n), lambda w: _head(_framed_list(input)(w), n), few=_few(n, lambda keys: keys))


def last_n(input: Any, n: Any) -> Acc:
    return Acc(lambda order: _tail(_gather(input)(order), n), lambda: _tail(c(input), n), lambda w: _tail(_framed_list(input)(w), n), few=_few(n, lambda keys: keys, True))


def _extreme(input: Any, n: Any, rising: bool) -> Acc:
    pick = lambda a: _head(F.sort_array(_numbers(a), rising), n)
    known = lambda _: [(c(input).isNull(), True), (c(input), rising)]
    return Acc(lambda order: pick(F.collect_list(c(input))), lambda: pick(c(input)), lambda w: pick(F.collect_list(c(input)).over(w)), few=_few(n, known))


def max_n(input: Any, n: Any) -> Acc:
    return _extreme(input, n, False)


def min_n(input: Any, n: Any) -> Acc:
    return _extreme(input, n, True)


def _order(sort_by: Any) -> Order:
    from .core import column

    return [(column(p), up) for p, up in directions(sort_by)]


def top(output: Any, sort_by: Any) -> Acc:
    return Acc(lambda _: _ends(output, _order(sort_by), False))


def bottom(output: Any, sort_by: Any) -> Acc:
    return Acc(lambda _: _ends(output, _order(sort_by), True))


def top_n(output: Any, sort_by: Any, n: Any) -> Acc:
    return Acc(lambda _: _head(_gather(output)(_order(sort_by)), n), few=_few(n, lambda _: _order(sort_by)))


def bottom_n(output: Any, sort_by: Any, n: Any) -> Acc:
    return Acc(lambda _: _tail(_gather(output)(_order(sort_by)), n), few=_few(n, lambda _: _order(sort_by), True))


def _array_percentile(a: Column, p: float) -> Column:
    own = F.sort_array(_numbers(a))
    at = F.greatest(F.ceil(F.size(own) * p) - 1, F.lit(0)).cast("int")
    return F.get(own, at)


def median(input: Any, method: str = "approximate") -> Acc:
    agg = lambda x: F.percentile_approx(x, 0.5) if method == "approximate" else F.median(x)
    return Acc(lambda order: agg(c(input)), lambda: _array_percentile(c(input), 0.5), lambda w: agg(c(input)).over(w), ranks=(c(input), 0.5) if method == "approximate" else None)


def percentile(input: Any, p: list[float], method: str = "approximate") -> Acc:
    """The least values with a share of p at or below them: exact in a group stage, elsewhere within a 10,000th of the ranks."""
    agg = lambda x: F.percentile_approx(x, p)
    return Acc(lambda order: agg(c(input)), lambda: F.array(*(_array_percentile(c(input), q) for q in p)), lambda w: agg(c(input)).over(w), ranks=(c(input), p))


def accumulator(*_: Any, **__: Any) -> Any:
    raise NotImplementedError("server-side script accumulators are refused")


def function(*_: Any, **__: Any) -> Any:
    raise NotImplementedError("server-side script expressions are refused")


# --- window functions: framed(window, order, partition)


def _ranking(build: Callable[[], Column]) -> Callable[[], Acc]:
    return lambda: Acc(None, None, lambda w, order, part: build().over(_sorted(part, order)), needs_sort=True, single_key=True, ranked=True)


def _sorted(part: list[Column], order: Order) -> Any:
    w = W.partitionBy(*part)
    return w.orderBy(*(k.asc() if up else k.desc() for k, up in order)) if order else w


rank, dense_rank, document_number = _ranking(F.rank), _ranking(F.dense_rank), _ranking(F.row_number)


def shift(output: Any, by: int, default: Any = None) -> Acc:
    move = (lambda x: F.lag(x, -by, default)) if by < 0 else (lambda x: F.lead(x, by, default))
    return Acc(None, None, lambda w, order, part: move(c(output)).over(_sorted(part, order)), needs_sort=True, ranked=True)


def _axis(key: Column, unit: str | None) -> Column:
    return _millis(key) / UNIT_MS[unit] if unit else _millis(key).cast("double") if is_date(key) else key.cast("double")


def derivative(input: Any, unit: str | None = None) -> Acc:
    def run(w: Any, order: Order, part: list[Column]) -> Column:
        x, k = c(input), _axis(order[0][0], unit)
        rise = F.last(x).over(w) - F.first(x).over(w)
        return F.when(F.count(F.lit(1)).over(w) > 1, rise / (F.last(k).over(w) - F.first(k).over(w)))

    return Acc(None, None, run, needs_sort=True, needs_frame=True)


def integral(input: Any, unit: str | None = None) -> Acc:
    """Trapezoids over the frame: the difference of their running sums at its ends; null where the frame holds a null."""

    def areas(order: Order, part: list[Column], mark: str) -> dict[str, Column]:
        k, x, w = _axis(order[0][0], unit), c(input).cast("double"), _sorted(part, order)
        return {f"{mark}area": (k - F.lag(k).over(w)) * (x + F.lag(x).over(w)) / 2}

    def sums(order: Order, part: list[Column], mark: str) -> dict[str, Column]:
        w = _sorted(part, order).rowsBetween(W.unboundedPreceding, 0)
        return {f"{mark}sum": F.coalesce(F.sum(f"{mark}area").over(w), F.lit(0.0))}

    def run(w: Any, order: Order, part: list[Column], mark: str) -> Column:
        total = F.col(f"{mark}sum")
        out = F.coalesce(F.last(total).over(w) - F.first(total).over(w), F.lit(0.0))
        return F.when((F.count(F.lit(1)).over(w) < 2) | (F.count(F.lit(1)).over(w) == F.count(c(input)).over(w)), out)

    return Acc(None, None, run, needs_sort=True, needs_frame=True, first=(areas, sums))


def exp_moving_avg(input: Any, n: int | None = None, alpha: float | None = None) -> Acc:
    if (n is None) == (alpha is None):
        raise ValueError("either n or alpha is needed")
    a = alpha if alpha is not None else 2 / (n + 1)

    # values further back than this have less weight than a double's last digit
    reach = math.ceil(math.log(1e-18) / math.log(1 - a)) if 1e-6 < a < 1 else 1 if a >= 1 else None

    def run(w: Any, order: Order, part: list[Column]) -> Column:
        rows = F.collect_list(c(input).cast("double")).over(_sorted(part, order).rowsBetween(W.unboundedPreceding if reach is None else -reach, 0))
        return F.aggregate(rows, F.lit(None).cast("double"), lambda s, x: F.when(s.isNull(), x).otherwise(x * a + s * (1 - a)))

    return Acc(None, None, run, needs_sort=True, ranked=True)


def covariance_pop(a: Any, b: Any) -> Acc:
    return Acc(None, None, lambda w: F.covar_pop(c(a), c(b)).over(w))


def covariance_samp(a: Any, b: Any) -> Acc:
    return Acc(None, None, lambda w: F.covar_samp(c(a), c(b)).over(w))


def locf(x: Any) -> Acc:
    return Acc(None, None, lambda w, order, part: F.last(c(x), ignorenulls=True).over(_sorted(part, order).rowsBetween(W.unboundedPreceding, 0)), ranked=True)


def linear_fill(x: Any) -> Acc:
    def run(w: Any, order: Order, part: list[Column]) -> Column:
        v, k = c(x), _axis(order[0][0], None)
        before, after = (_sorted(part, order).rowsBetween(a, b) for a, b in ((W.unboundedPreceding, 0), (0, W.unboundedFollowing)))
        known = F.when(v.isNotNull(), k)
        x0, x1 = F.last(v, True).over(before), F.first(v, True).over(after)
        k0, k1 = F.last(known, True).over(before), F.first(known, True).over(after)
        return F.coalesce(v, x0 + (x1 - x0) * (k - k0) / F.nullif(k1 - k0, F.lit(0.0)))

    return Acc(None, None, run, needs_sort=True, single_key=True, ranked=True)


def min_max_scaler(input: Any, min: float = 0.0, max: float = 1.0) -> Acc:
    def run(w: Any) -> Column:
        x = c(input)
        low, high = F.min(x).over(w), F.max(x).over(w)
        return (x - low) / F.nullif(high - low, F.lit(0)) * (max - min) + min

    return Acc(None, None, run)


def with_window(acc: Acc, documents: list | None = None, range: list | None = None, unit: str | None = None) -> Acc:
    """The same with an explicit frame of rows or of sort key values."""
    if acc.ranked:
        raise ValueError("this window function takes no frame")
    acc.frame = {"documents": documents, "range": range, "unit": unit}
    return acc


def __getattr__(name: str) -> Any:
    if name.startswith("__"):
        raise AttributeError(name)
    snake = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()
    snake = {"str_len_cp": "str_len_cp", "is_in": "is_in", "in": "is_in", "type": "type_", "type_of": "type_"}.get(snake, snake)
    for own in (snake, f"{snake}_"):
        if own in globals() and (own != name):
            return globals()[own]
    raise AttributeError(name)
