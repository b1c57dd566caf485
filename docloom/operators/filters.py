"""The filter language: a document of conditions to a boolean column.

Null counts as false. Only where that is turned round (below a negation) or kept as a value is a condition wrapped; the
conjuncts of a plain filter stay bare comparisons, which Spark hands to the source.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fn
from ..functions.core import Fields, building, column, lit, type_of
from .geo import geo_condition

LOGIC = {"$and", "$or", "$nor", "$expr", "$text", "$jsonSchema", "$sampleRate", "$comment"}
REFUSED = {"$where", "$function", "$accumulator"}
#: Type numbers of the $type operator and their aliases.
TYPE_NUMBERS = {1: "double", 2: "string", 3: "object", 4: "array", 5: "binData", 7: "objectId", 8: "bool", 9: "date", 10: "null", 11: "regex", 16: "int", 17: "timestamp", 18: "long", 19: "decimal"}


class FilterError(ValueError):
    pass


def _both(xs: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, xs) if xs else F.lit(True)


def _sure(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def _resolve(schema: T.DataType, path: str) -> list[tuple[str, T.DataType]]:
    """Steps of a path with the type after each: ("field", t), ("each", element), ("at", element), ("key", value)."""
    steps: list[tuple[str, Any, T.DataType]] = []
    here = schema
    for part in path.split("."):
        while isinstance(here, T.ArrayType):
            if part.isdigit():
                break
            here = here.elementType
            steps.append(("each", None, here))
        if isinstance(here, T.ArrayType):
            here = here.elementType
            steps.append(("at", int(part), here))
        elif isinstance(here, T.StructType):
            if part not in here.fieldNames():
                raise FilterError(f"unknown path {path!r}")
            here = here[part].dataType
            steps.append(("field", part, here))
        elif isinstance(here, T.MapType):
            here = here.valueType
            steps.append(("key", part, here))
        else:
            raise FilterError(f"unknown path {path!r}")
    return steps


def _walk(root: Column | None, steps: list, test: Any) -> Column:
    """test(column, type) at the end of the path; any element where the path goes through an array."""
    here, kind = root, None
    for n, (how, arg, kind) in enumerate(steps):
        if how == "field":
            here = F.col(f"`{arg}`") if here is None else here[arg]
        elif how == "at":
            here = F.get(here, F.lit(arg))
        elif how == "key":
            here = F.try_element_at(here, F.lit(arg))
        else:
            rest = steps[n + 1 :]
            return _sure(F.exists(here, _inner(rest, kind, test)))
    return test(here, kind)


def _inner(rest: list, kind: T.DataType, test: Any) -> Any:
    return lambda x: _walk(x, rest, test) if rest else test(x, kind)


def _any(col: Column, kind: T.DataType, test: Any) -> Column:
    """test(value) for the value or, with an array, for any element."""
    return F.exists(col, test) if isinstance(kind, T.ArrayType) else test(col)


def _value(v: Any, kind: T.DataType) -> Column:
    if isinstance(v, re.Pattern):
        raise FilterError("a pattern can't be compared")
    out = lit(v)
    return out.cast(kind) if isinstance(kind, T.AtomicType) and not isinstance(v, (list, dict)) and v is not None else out


def _element(kind: T.DataType) -> T.DataType:
    return kind.elementType if isinstance(kind, T.ArrayType) else kind


def _equals(col: Column, kind: T.DataType, v: Any) -> Column:
    if isinstance(v, re.Pattern):
        return _any(col, kind, lambda x: x.rlike(fn._pattern(v)))
    if v is None:
        return col.isNull() | (_sure(F.exists(col, lambda x: x.isNull())) if isinstance(kind, T.ArrayType) else F.lit(False))
    if isinstance(kind, T.ArrayType):
        if isinstance(v, (list, tuple)):
            whole = F.array(*(_value(x, kind.elementType) for x in v)) if v else F.array().cast(kind)
            return col.eqNullSafe(whole)
        return _sure(F.exists(col, lambda x: x.eqNullSafe(_value(v, kind.elementType))))
    return col.eqNullSafe(_value(v, kind))


def _mask(v: Any) -> int:
    if isinstance(v, bool) or isinstance(v, (int, float)) and v < 0:
        raise FilterError("a bit mask must not be negative")
    if isinstance(v, bytes):
        return int.from_bytes(v, "little")
    return sum(1 << p for p in v) if isinstance(v, (list, tuple)) else int(v)


def _kind_matches(kind: T.DataType, wanted: Any) -> bool:
    own = fn.type_name(kind)
    names = wanted if isinstance(wanted, (list, tuple)) else [wanted]
    for w in names:
        w = TYPE_NUMBERS.get(w, w)
        if w == own or w == "number" and own in ("int", "long", "double", "decimal") or w in ("objectId", "uuid") and own == "string":
            return True
    return False


def _operator(name: str, v: Any, col: Column, kind: T.DataType, own: dict) -> Column:
    element = _element(kind)
    if name == "$eq":
        return _equals(col, kind, v)
    if name == "$ne":
        return ~_sure(_equals(col, kind, v))
    if name in ("$in", "$nin"):
        plain = [x for x in v if x is not None and not isinstance(x, (re.Pattern, list, tuple, dict))]
        tests = [_equals(col, kind, x) for x in v if x is None or isinstance(x, (re.Pattern, list, tuple, dict))]
        if plain:
            values = [_value(x, element) for x in plain]
            tests.append(_any(col, kind, lambda x: x.isin(*values)))
        found = reduce(lambda a, b: a | b, tests, F.lit(False))
        return found if name == "$in" else ~_sure(found)
    if name in ("$gt", "$gte", "$lt", "$lte"):
        w = _value(v, element)
        test = {"$gt": lambda x: x > w, "$gte": lambda x: x >= w, "$lt": lambda x: x < w, "$lte": lambda x: x <= w}[name]
        return _any(col, kind, test)
    if name == "$exists":
        return col.isNotNull() if v else col.isNull()
    if name == "$type":
        null = F.lit(False)
        if v in ("null", 10) or isinstance(v, (list, tuple)) and ("null" in v or 10 in v):
            null = col.isNull()
        fits = _kind_matches(kind, v) or isinstance(kind, T.ArrayType) and _kind_matches(element, v)
        return null | (col.isNotNull() & F.lit(fits))
    if name == "$regex":
        return _any(col, kind, lambda x: x.rlike(fn._pattern(v, own.get("$options", ""))))
    if name == "$options":
        if "$regex" not in own:
            raise FilterError("$options needs $regex")
        return F.lit(True)
    if name == "$not":
        inner = _equals(col, kind, v) if isinstance(v, re.Pattern) else _conditions(v, col, kind)
        return ~_sure(inner)
    if name == "$mod":
        divisor, remainder = (int(x) for x in v)
        if not divisor:
            raise FilterError("$mod by zero")
        return _any(col, kind, lambda x: (x.cast("bigint") % divisor) == remainder)
    if name.startswith("$bits"):
        mask = F.lit(_mask(v)).cast("bigint")
        test = {"$bitsAllSet": lambda x: x.bitwiseAND(mask) == mask, "$bitsAnySet": lambda x: x.bitwiseAND(mask) != 0, "$bitsAllClear": lambda x: x.bitwiseAND(mask) == 0, "$bitsAnyClear": lambda x: x.bitwiseAND(mask) != mask}[name]
        return _any(col, kind, lambda x: test(x.cast("bigint")))
    if name == "$all":
        parts = [_operator("$elemMatch", x["$elemMatch"], col, kind, {}) if isinstance(x, dict) and "$elemMatch" in x else _equals(col, kind, x) for x in v]
        return _both(parts) if parts else F.lit(False)
    if name == "$size":
        return _sure(F.size(col) == F.lit(v)) if isinstance(kind, T.ArrayType) else F.lit(False)
    if name == "$elemMatch":
        if not isinstance(kind, T.ArrayType):
            return F.lit(False)
        if v and all(k.startswith("$") and k not in LOGIC for k in v):
            return _sure(F.exists(col, lambda x: _conditions(v, x, kind.elementType)))
        return _sure(F.exists(col, lambda x: _document(v, x, kind.elementType)))
    if name in ("$geoWithin", "$geoIntersects", "$near", "$nearSphere"):
        return _sure(geo_condition(name, v, col, own))
    if name in ("$minDistance", "$maxDistance"):
        return F.lit(True)
    if name in REFUSED:
        raise FilterError(f"{name} is refused")
    raise FilterError(f"unknown operator {name!r}")


def _conditions(spec: dict, col: Column, kind: T.DataType) -> Column:
    return _both([_operator(k, v, col, kind, spec) for k, v in spec.items()])


def _is_operators(v: Any) -> bool:
    if not isinstance(v, dict) or not v:
        return False
    marks = [k.startswith("$") for k in v]
    if any(marks) and not all(marks):
        raise FilterError("operators and fields don't mix")
    return all(marks)


def _document(spec: dict, root: Column | None, schema: T.DataType) -> Column:
    out = []
    for key, v in spec.items():
        if key in REFUSED:
            raise FilterError(f"{key} is refused")
        if key in ("$and", "$or", "$nor"):
            if not v:
                raise FilterError(f"{key} needs a filter")
            parts = [_document(x, root, schema) for x in v]
            out.append(_both(parts) if key == "$and" else reduce(lambda a, b: a | b, parts) if key == "$or" else ~_sure(reduce(lambda a, b: a | b, parts)))
        elif key == "$expr":
            if not callable(v):
                raise FilterError("$expr takes a function of the fields")
            out.append(_truth(v))
        elif key == "$comment":
            continue
        elif key == "$sampleRate":
            out.append(F.rand() < F.lit(float(v)))
        elif key == "$jsonSchema":
            out.append(json_schema(v, root, schema))
        elif key == "$text":
            from .search import text_match

            fields = [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]
            out.append(text_match([column(f) for f in fields], v["$search"]))
        elif key.startswith("$"):
            raise FilterError(f"unknown operator {key!r}")
        else:
            steps = _resolve(schema, key)
            if _is_operators(v):
                negated = {k: x for k, x in v.items() if k in ("$ne", "$nin", "$not")}
                rest = {k: x for k, x in v.items() if k not in negated}
                flip = {"$ne": "$eq", "$nin": "$in"}
                if rest:
                    out.append(_walk(root, steps, lambda c, k, rest=rest: _conditions(rest, c, k)))
                for name, x in negated.items():  # a negation over a path through arrays holds for no element
                    inner = x if name == "$not" else {flip[name]: x}
                    test = (lambda c, k, x=inner: _equals(c, k, x)) if isinstance(inner, re.Pattern) else (lambda c, k, x=inner: _conditions(x, c, k))
                    out.append(~_sure(_walk(root, steps, test)))
            else:
                out.append(_walk(root, steps, lambda c, k, v=v: _equals(c, k, v)))
    return _both(out)


def json_schema(spec: dict, root: Column | None, schema: T.DataType) -> Column:
    """required, properties with bsonType/type, minimum, maximum, enum, pattern, minLength, maxLength, minItems, maxItems."""
    out = []
    get = lambda name: F.col(f"`{name}`") if root is None else root[name]
    for name in spec.get("required", []):
        out.append(get(name).isNotNull() if name in schema.fieldNames() else F.lit(False))
    for name, rule in spec.get("properties", {}).items():
        if name not in schema.fieldNames():
            continue
        col, kind, tests = get(name), schema[name].dataType, []
        for k, v in rule.items():
            if k in ("bsonType", "type"):
                v = {"boolean": "bool", "integer": "int"}.get(v, v) if isinstance(v, str) else v
                tests.append(F.lit(_kind_matches(kind, v)))
            elif k == "minimum":
                tests.append(col > F.lit(v) if rule.get("exclusiveMinimum") is True else col >= F.lit(v))
            elif k == "maximum":
                tests.append(col < F.lit(v) if rule.get("exclusiveMaximum") is True else col <= F.lit(v))
            elif k == "enum":
                tests.append(col.isin(*v))
            elif k == "pattern":
                tests.append(col.rlike(v))
            elif k in ("minLength", "maxLength"):
                tests.append(F.char_length(col) >= v if k == "minLength" else F.char_length(col) <= v)
            elif k in ("minItems", "maxItems"):
                tests.append(F.size(col) >= v if k == "minItems" else F.size(col) <= v)
            elif k in ("required", "properties") and isinstance(kind, T.StructType):
                tests.append(json_schema({k: v}, col, kind))
            elif k not in ("exclusiveMinimum", "exclusiveMaximum", "description", "title"):
                raise FilterError(f"unknown schema keyword {k!r}")
        out.append(col.isNull() | _sure(_both(tests)))
    return _both(out)


def _truth(spec: Any) -> Column:
    """The condition that a function of the fields gives; a boolean one stays as it is."""
    out = fn.c(spec(Fields()))
    return out if isinstance(type_of(out), T.BooleanType) else fn._truthy(out)


def compile_filter(df: DataFrame, spec: Any, as_value: bool = False) -> Column:
    """A filter document, a function of the fields, or a column, to a condition on df; as_value: never null."""
    with building(df):
        out = spec if isinstance(spec, Column) else _truth(spec) if callable(spec) else _document(spec, None, df.schema)
        return _sure(out) if as_value else out


class Where:
    """Conditions on one path, one after another: Where("a").gt(1).lt(5).spec()."""

    def __init__(self, path: str):
        self.path, self.own = path, {}

    def _add(self, name: str, value: Any) -> Where:
        out = Where(self.path)
        out.own = self.own | {name: value}
        return out

    def __getattr__(self, name: str) -> Any:
        names = {"equals": "$eq", "ne": "$ne", "in_": "$in", "nin": "$nin", "gt": "$gt", "gte": "$gte", "lt": "$lt", "lte": "$lte", "exists": "$exists", "regex": "$regex", "size": "$size", "all": "$all", "elem_match": "$elemMatch"}
        if name == "mod":
            return lambda divisor, remainder: self._add("$mod", [divisor, remainder])
        if name not in names:
            raise AttributeError(name)
        return lambda value=True: self._add(names[name], value)

    def spec(self) -> dict:
        return {self.path: self.own}


class Filters:
    @staticmethod
    def all() -> Column:
        """Every row, said on purpose."""
        return F.lit(True)


def near_order(spec: dict) -> Column | None:
    """The distance that a $near condition sorts by, or None."""
    from .geo import distance_of

    for path, v in spec.items():
        if isinstance(v, dict):
            for name in ("$near", "$nearSphere"):
                if name in v:
                    return distance_of(column(path), v[name])
    return None
