"""Functions as native columns.  A function gets a :class:`Call` context and compiled arguments and gives (column, type)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SetupTypeError


@dataclass(frozen=True)
class Value:
    """A column with its type."""

    col: Column
    dtype: T.DataType


@dataclass(frozen=True)
class Lazy:
    """An argument that is compiled once per item: ``each(item)``; ``name`` if it is a bare member This.<name> or text."""

    each: Callable[[Value], Value]
    name: str | None = None


def truth(v: Value) -> Column:
    """Python truth of a value, with null false: two-valued."""
    t, c = v.dtype, v.col
    if isinstance(t, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    if isinstance(t, T.NumericType):
        return F.coalesce(c != 0, F.lit(False))
    if isinstance(t, (T.StringType, T.BinaryType)):
        return F.coalesce(F.length(c) > 0, F.lit(False))
    if isinstance(t, (T.ArrayType, T.MapType)):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    if isinstance(t, T.DayTimeIntervalType):
        return F.coalesce(c != F.expr("INTERVAL '0' SECOND"), F.lit(False))
    return c.isNotNull()


def _array(v: Value, name: str) -> T.DataType:
    if not isinstance(v.dtype, T.ArrayType):
        raise SetupTypeError(f"{name} needs a list, not {v.dtype.simpleString()}")
    return v.dtype.elementType


def _text(v: Value, name: str) -> Column:
    if not isinstance(v.dtype, (T.StringType, T.NullType)):
        raise SetupTypeError(f"{name} needs a string, not {v.dtype.simpleString()}")
    return v.col


def length(v: Value) -> Value:
    if isinstance(v.dtype, T.StringType):
        return Value(F.length(v.col).cast("long"), T.LongType())
    if isinstance(v.dtype, (T.ArrayType, T.MapType)):
        return Value(F.when(v.col.isNotNull(), F.size(v.col).cast("long")), T.LongType())
    raise SetupTypeError(f"Length needs something with a size, not {v.dtype.simpleString()}")


def substring(x: Value, start: Value | None = None, end: Value | None = None) -> Value:
    """Slice from start to end, counted from 0, negative from the end."""
    text = _text(x, "Substring")
    n = F.length(text)

    def place(v: Value | None, other: Column) -> Column:
        if v is None:
            return other
        c = v.col.cast("int")
        return F.when(c.isNull(), other).when(c < 0, F.greatest(n + c, F.lit(0))).otherwise(F.least(c, n))

    s, e = place(start, F.lit(0)), place(end, n)
    return Value(F.substring(text, s + 1, F.greatest(e - s, F.lit(0))), T.StringType())


def _items(f: Callable) -> Callable:
    f.takes_items = True
    return f


@_items
def filter_(v: Value, p: Lazy) -> Value:
    item = _array(v, "Filter")
    return Value(F.filter(v.col, lambda x: truth(p.each(Value(x, item)))), v.dtype)


@_items
def map_(v: Value, f: Lazy) -> Value:
    item = _array(v, "Map")
    kind: list[T.DataType] = []

    def one(x: Column) -> Column:
        got = f.each(Value(x, item))
        kind.append(got.dtype)
        return got.col

    return Value(F.transform(v.col, one), T.ArrayType(kind[0]))


@_items
def max_(v: Value, f: Lazy) -> Value:
    got = map_(v, f)
    return Value(F.array_max(got.col), got.dtype.elementType)


@_items
def min_(v: Value, f: Lazy) -> Value:
    got = map_(v, f)
    return Value(F.array_min(got.col), got.dtype.elementType)


@_items
def sum_(v: Value, f: Lazy) -> Value:
    """Sum over items; a null or missing member counts 0."""
    item = _array(v, "Sum")
    if f.name is not None and isinstance(item, T.StructType) and f.name not in item.fieldNames():
        return Value(F.when(v.col.isNotNull(), F.lit(0).cast("long")), T.LongType())
    got = map_(v, f)
    kind = got.dtype.elementType
    if not isinstance(kind, T.NumericType):
        raise SetupTypeError(f"Sum needs numbers, not {kind.simpleString()}")
    out = T.DoubleType() if isinstance(kind, (T.FloatType, T.DoubleType)) else T.DecimalType(38, kind.scale) if isinstance(kind, T.DecimalType) else T.LongType()
    zero = F.lit(0).cast(out)
    return Value(F.aggregate(got.col, zero, lambda a, x: (a + F.coalesce(x, F.lit(0)).cast(out)).cast(out)), out)


@_items
def average(v: Value, f: Lazy) -> Value:
    """Mean of the members that aren't null; null for none.  Beyond the reference functions."""
    got = map_(v, f)
    some = F.filter(got.col, lambda x: x.isNotNull())
    total = F.aggregate(some, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return Value(F.try_divide(total, F.nullif(F.size(some), F.lit(0))), T.DoubleType())


@_items
def exists(v: Value, p: Lazy) -> Value:
    """Whether any item meets the predicate.  Beyond the reference functions."""
    item = _array(v, "Exists")
    return Value(F.coalesce(F.exists(v.col, lambda x: truth(p.each(Value(x, item)))), F.lit(False)), T.BooleanType())


def count(v: Value) -> Value:
    _array(v, "Count")
    return Value(F.when(v.col.isNotNull(), F.size(v.col).cast("long")), T.LongType())


def first(v: Value) -> Value:
    return Value(F.try_element_at(v.col, F.lit(1)), _array(v, "First"))


def last(v: Value, _unused: Any = None) -> Value:
    return Value(F.try_element_at(v.col, F.lit(-1)), _array(v, "Last"))


def single_bool_selected(v: Value) -> Value:
    _array(v, "SingleBoolSelected")
    return Value(F.size(F.filter(v.col, lambda x: x.eqNullSafe(F.lit(True)))) == 1, T.BooleanType())


def children(v: Value) -> Value:
    """The children of a struct of one type as a list."""
    if isinstance(v.dtype, T.ArrayType):
        return v
    if not isinstance(v.dtype, T.StructType):
        raise SetupTypeError("Children needs a component")
    kinds = {f.dataType.simpleString() for f in v.dtype}
    if len(kinds) > 1:
        return Value(F.array(*[v.col[f.name].cast("string") for f in v.dtype]), T.ArrayType(T.StringType()))
    return Value(F.array(*[v.col[f.name] for f in v.dtype]), T.ArrayType(v.dtype.fields[0].dataType))


def if_(c: Value, a: Value, b: Value) -> Value:
    """a where c is true, else b.  Beyond the reference functions."""
    return Value(F.when(truth(c), a.col).otherwise(b.col), b.dtype if isinstance(a.dtype, T.NullType) else a.dtype)


def EnumMembers(kind: Any, name: str | None = None) -> Callable[[], Value]:
    """A function without arguments that gives (name, value) of the members of an enum."""

    def members() -> Value:
        from ..types import BY_PYTHON

        value = BY_PYTHON[type(next(iter(kind)).value)]
        return Value(F.array(*[F.struct(F.lit(m.name).alias("name"), F.lit(m.value).alias("value")) for m in kind]), T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", value)])))

    members.__name__ = name or f"{kind.__name__}Members"
    return members


BUILTINS: dict[str, Callable[..., Value]] = {
    "Length": length,
    "Upper": lambda v: Value(F.upper(_text(v, "Upper")), T.StringType()),
    "Lower": lambda v: Value(F.lower(_text(v, "Lower")), T.StringType()),
    "Substring": substring,
    "Startswith": lambda v, p: Value(F.startswith(_text(v, "Startswith"), _text(p, "Startswith")), T.BooleanType()),
    "Count": count, "Filter": filter_, "First": first, "Last": last, "Sum": sum_, "Map": map_, "Max": max_, "Min": min_,
    "Children": children, "SingleBoolSelected": single_bool_selected,
    "Average": average, "Exists": exists, "If": if_,
}
