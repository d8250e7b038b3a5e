"""Logical types of fields, their Spark types, and compatibility."""

from __future__ import annotations

import dataclasses
import datetime
import decimal
import enum
import types as pytypes
import typing
from typing import Any

from pyspark.sql import types as T

from .errors import SetupTypeError

BY_PYTHON: dict[type, T.DataType] = {
    str: T.StringType(), int: T.LongType(), float: T.DoubleType(), bool: T.BooleanType(), decimal.Decimal: T.DecimalType(38, 18),
    datetime.datetime: T.TimestampNTZType(), datetime.date: T.DateType(), datetime.timedelta: T.DayTimeIntervalType(), datetime.time: T.StringType(),
}


def is_integral(t: T.DataType) -> bool:
    return isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def is_numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def of_hint(hint: Any) -> tuple[T.DataType, bool]:
    """(Spark type, nullable) of a Python type hint."""
    origin, args = typing.get_origin(hint), typing.get_args(hint)
    if origin in (typing.Union, pytypes.UnionType):
        some = [a for a in args if a is not type(None)]
        if len(some) != 1:
            raise SetupTypeError(f"unions aren't supported: {hint}")
        return of_hint(some[0])[0], len(some) < len(args)
    if origin in (list, tuple, set, typing.Sequence) or getattr(origin, "__name__", "") in ("Sequence", "Iterable"):
        if len(args) != 1:
            raise SetupTypeError(f"a list has one type of elements: {hint}")
        inner, null = of_hint(args[0])
        return T.ArrayType(inner, null), False
    if origin is dict:
        value, null = of_hint(args[1])
        return T.MapType(of_hint(args[0])[0], value, null), False
    if isinstance(hint, type):
        if issubclass(hint, enum.Enum):
            return BY_PYTHON[type(next(iter(hint)).value)], False
        if hint in BY_PYTHON:
            return BY_PYTHON[hint], False
        if dataclasses.is_dataclass(hint) or hasattr(hint, "model_fields") or hasattr(hint, "__annotations__"):
            return struct_of(hint), False
    raise SetupTypeError(f"no Spark type for {hint}")


def struct_of(model: type) -> T.StructType:
    """Schema of a dataclass, of a pydantic-like model, or of any class with annotations."""
    fields = []
    for name, hint in typing.get_type_hints(model).items():
        if name.startswith("_") or name == "model_config":
            continue
        kind, null = of_hint(hint)
        fields.append(T.StructField(name, kind, null))
    return T.StructType(fields)


def compatible(given: T.DataType, wanted: T.DataType, given_null: bool = False, wanted_null: bool = True) -> bool:
    """Whether a value of one type may stand where another is wanted."""
    if given_null and not wanted_null:
        return False
    if isinstance(given, T.NullType):
        return wanted_null
    if isinstance(given, T.ArrayType) or isinstance(wanted, T.ArrayType):
        return isinstance(given, T.ArrayType) and isinstance(wanted, T.ArrayType) and compatible(given.elementType, wanted.elementType)
    if isinstance(given, T.MapType) or isinstance(wanted, T.MapType):
        return isinstance(given, T.MapType) and isinstance(wanted, T.MapType)
    if isinstance(given, T.StructType) or isinstance(wanted, T.StructType):
        return isinstance(given, T.StructType) and isinstance(wanted, T.StructType) and {f.name for f in wanted} <= {f.name for f in given}
    if is_integral(given):
        return is_numeric(wanted)
    if isinstance(given, (T.FloatType, T.DecimalType)):
        return isinstance(wanted, (T.FloatType, T.DoubleType, T.DecimalType))
    if isinstance(given, (T.TimestampType, T.TimestampNTZType)):
        return isinstance(wanted, (T.TimestampType, T.TimestampNTZType, T.DateType))
    if isinstance(given, T.BooleanType) and is_integral(wanted):
        return True
    return type(given) is type(wanted)
