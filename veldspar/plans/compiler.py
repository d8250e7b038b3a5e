"""Expressions to columns, with scopes and static types.

Comparisons for equality are null-safe, ``& | ~`` are two-valued by Python truth, ordering gives null where an operand is
null (a broken rule), ``+`` joins strings, a string before an integer turns it into text, ``//`` rounds down.  Division by zero and overflow give null,
or fail the job with ``strict``.
"""

from __future__ import annotations

import decimal
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SetupNameError, SetupTypeError
from ..expr import Call, Expr, Lit, Op, Path, _Bound, wrap
from ..functions.builtin import BUILTINS, Lazy, Value, truth
from ..functions.registry import lookup
from ..types import BY_PYTHON, is_integral, is_numeric


@dataclass(frozen=True)
class Scope:
    """Names visible to an expression: fields of this level, then those of the levels above; ``this`` for This."""

    fields: dict[str, Value]
    up: Scope | None = None
    this: dict[str, Value] = field(default_factory=dict)
    item: Value | None = None
    context: dict[str, Any] = field(default_factory=dict)
    functions: dict[str, Callable] = field(default_factory=dict)
    strict: bool = False
    stored: Value | None = None

    def inner(self, **changes: Any) -> Scope:
        base = {"fields": {}, "up": self, "context": self.context, "functions": self.functions, "strict": self.strict, "stored": self.stored}
        return Scope(**{**base, **changes})


def member(v: Value, name: str, where: str) -> Value:
    if isinstance(v.dtype, T.ArrayType):
        raise SetupTypeError(f"{where}: a list has no member {name}; use Map")
    if not isinstance(v.dtype, T.StructType) or name not in v.dtype.fieldNames():
        raise SetupNameError(f"{where}: no member {name} in {v.dtype.simpleString()[:200]}")
    return Value(v.col.getField(name), v.dtype[name].dataType)


def _find(scope: Scope, name: str) -> Value:
    at: Scope | None = scope
    while at is not None:
        if name in at.fields:
            return at.fields[name]
        below = [v for v in at.fields.values() if isinstance(v.dtype, T.StructType) and name in v.dtype.fieldNames()]
        if len(below) > 1:
            raise SetupNameError(f"F.{name} is ambiguous")
        if below:
            return member(below[0], name, "F")
        at = at.up
    raise SetupNameError(f"no field F.{name}")


def literal(value: Any) -> Value:
    if value is None:
        return Value(F.lit(None), T.NullType())
    if isinstance(value, (list, tuple)):
        items = [literal(v) for v in value]
        return Value(F.array(*[i.col for i in items]), T.ArrayType(items[0].dtype if items else T.NullType()))
    if isinstance(value, int) and not isinstance(value, bool):
        return Value(F.lit(value).cast("long"), T.LongType())
    if isinstance(value, decimal.Decimal):
        digits, exponent = len(value.as_tuple().digits), value.as_tuple().exponent
        scale = max(0, -int(exponent))
        return Value(F.lit(value), T.DecimalType(max(digits, scale), scale))
    kind = BY_PYTHON.get(type(value))
    if kind is None:
        raise SetupTypeError(f"no literal for {type(value).__name__}")
    return Value(F.lit(value), kind)


def compile_expr(e: Any, scope: Scope) -> Value:
    e = wrap(e)
    if isinstance(e, Lit):
        return literal(e.value)
    if isinstance(e, Path):
        return _path(e, scope)
    if isinstance(e, Call):
        return _call(e, scope)
    if isinstance(e, _Bound):
        return member(compile_expr(e.receiver, scope), e.name, e.to_source())
    if isinstance(e, Op):
        return _op(e, scope)
    raise SetupTypeError(f"{e!r} is no expression")


def _path(e: Path, scope: Scope) -> Value:
    where = e.to_source()
    if e.ns == "Ctx":
        if len(e.parts) != 1 or e.parts[0] not in scope.context:
            raise SetupNameError(f"no setting {where}")
        return literal(scope.context[e.parts[0]])
    if e.ns == "M":
        if scope.stored is None or not e.parts:
            raise SetupNameError(f"{where} isn't available here")
        v, rest = member(scope.stored, e.parts[0], where), e.parts[1:]
    elif e.ns == "This":
        if not e.parts:
            raise SetupNameError("This needs a member")
        name, rest = e.parts[0], e.parts[1:]
        if name in scope.this:
            v = scope.this[name]
        elif scope.item is not None and name == "Instance":
            v = scope.item
        elif scope.item is not None:
            v = member(scope.item, name, where)
        else:
            raise SetupNameError(f"{where}: no such member here; there are {', '.join(scope.this)}")
    else:
        if not e.parts:
            raise SetupNameError("F needs a field")
        v, rest = _find(scope, e.parts[0]), e.parts[1:]
        if rest[:1] == ("Parent",):
            return _parent(scope, e.parts[0], rest, where)
    for name in rest:
        if name == "Instance":
            continue
        v = member(v, name, where)
    return v


def _parent(scope: Scope, name: str, rest: tuple[str, ...], where: str) -> Value:
    """``F.x.Parent``: the structure that holds field x, with its current values; ``.Parent`` again is the one around it."""
    at: Scope | None = scope
    inside = None
    while at is not None and name not in at.fields:
        below = [v for v in at.fields.values() if isinstance(v.dtype, T.StructType) and name in v.dtype.fieldNames()]
        if below:
            inside = below[0]
            break
        at = at.up
    while rest[:1] == ("Parent",):
        if at is None:
            raise SetupNameError(f"{where}: nothing is around the entity")
        if inside is not None:
            v, inside = inside, None
        else:
            v = Value(F.struct(*[x.col.alias(k) for k, x in at.fields.items()]), T.StructType([T.StructField(k, x.dtype) for k, x in at.fields.items()]))
            if rest[1:2] and rest[1] in at.fields:  # one member only: no structure is built
                v, rest = at.fields[rest[1]], rest[1:]
            at = at.up
        rest = rest[1:]
    for part in rest:
        if part != "Instance":
            v = member(v, part, where)
    return v


def _call(e: Call, scope: Scope) -> Value:
    f = lookup(scope.functions, e.func)
    takes_items = getattr(f, "takes_items", False)
    values: list[Any] = [] if e.receiver is None else [compile_expr(e.receiver, scope)]
    for a in () if e.func == "Last" and f is BUILTINS["Last"] else e.args:  # its argument has no use
        if takes_items and values:
            values.append(_lazy(a, scope))
        else:
            values.append(compile_expr(a, scope))
    try:
        return f(*values, **{k: _lazy(v, scope) if takes_items else compile_expr(v, scope) for k, v in e.kwargs})
    except TypeError as x:
        raise SetupTypeError(f"{e.to_source()}: {x}") from x


def _lazy(a: Expr, scope: Scope) -> Lazy:
    name = a.parts[0] if isinstance(a, Path) and a.ns == "This" and len(a.parts) == 1 else a.value if isinstance(a, Lit) and isinstance(a.value, str) else None
    if isinstance(a, Lit) and name is not None:
        a = Path("This", (name,))
    return Lazy(lambda item: compile_expr(a, scope.inner(item=item, this={"Value": item})), name)


def _python_text(v: Value) -> Column:
    """str() of a value: True for booleans, 1.0 for whole floats."""
    if isinstance(v.dtype, T.BooleanType):
        return F.initcap(v.col.cast("string"))
    return v.col.cast("string")


def adapt(v: Value, wanted: T.DataType) -> Column:
    """The value as a field of another type takes it: texts of standard values for strings, else a cast that gives null where it fails."""
    if isinstance(wanted, T.StringType) and not isinstance(v.dtype, (T.StringType, T.NullType)):
        return _python_text(v)
    if v.dtype == wanted:
        return v.col
    return v.col.try_cast(wanted)


def _op(e: Op, scope: Scope) -> Value:
    a = compile_expr(e.left, scope)
    boolean = T.BooleanType()
    if e.right is None:
        return Value(~truth(a), boolean)
    b = compile_expr(e.right, scope)
    if isinstance(a.dtype, T.StringType) and is_integral(b.dtype) and e.op != "*":
        b = Value(b.col.cast("string"), T.StringType())
    if e.op in ("&", "|"):
        return Value(truth(a) & truth(b) if e.op == "&" else truth(a) | truth(b), boolean)
    if e.op == "in":
        if isinstance(b.dtype, T.ArrayType):
            return Value(F.coalesce(F.array_contains(b.col, a.col), F.lit(False)), boolean)
        if isinstance(b.dtype, T.StringType) and isinstance(a.dtype, T.StringType):
            return Value(F.coalesce(F.contains(b.col, a.col), F.lit(False)), boolean)
        raise SetupTypeError(f"{e.to_source()}: neither a string nor a list")
    if e.op in ("==", "!=", ">", ">=", "<", "<="):
        _comparable(a, b, e)
        if isinstance(a.dtype, T.BooleanType) != isinstance(b.dtype, T.BooleanType):  # True is 1
            a, b = (Value(v.col.cast("long"), T.LongType()) if isinstance(v.dtype, T.BooleanType) else v for v in (a, b))
        if e.op in ("==", "!="):
            if isinstance(a.dtype, (T.FloatType, T.DoubleType)) or isinstance(b.dtype, (T.FloatType, T.DoubleType)):
                nan = lambda v: F.isnan(v.col.cast("double")) & v.col.isNotNull()  # noqa: E731 - NaN equals nothing
                same = a.col.eqNullSafe(b.col) & ~(nan(a) | nan(b))
            else:
                same = a.col.eqNullSafe(b.col)
            return Value(same if e.op == "==" else ~same, boolean)
        return Value({">": a.col > b.col, ">=": a.col >= b.col, "<": a.col < b.col, "<=": a.col <= b.col}[e.op], boolean)
    return _arithmetic(e, a, b, scope.strict)


def _comparable(a: Value, b: Value, e: Op) -> None:
    kinds = (a.dtype, b.dtype)
    if any(isinstance(k, T.NullType) for k in kinds) or all(is_numeric(k) for k in kinds) or type(a.dtype) is type(b.dtype):
        return
    times = (T.DateType, T.TimestampType, T.TimestampNTZType)
    if all(isinstance(k, times) for k in kinds) or all(is_numeric(k) or isinstance(k, T.BooleanType) for k in kinds) and e.op in ("==", "!="):
        return
    raise SetupTypeError(f"{e.to_source()}: {a.dtype.simpleString()} and {b.dtype.simpleString()} can't be compared")


def _wider(a: T.DataType, b: T.DataType) -> T.DataType:
    if isinstance(a, (T.FloatType, T.DoubleType)) or isinstance(b, (T.FloatType, T.DoubleType)):
        return T.DoubleType()
    if isinstance(a, T.DecimalType) or isinstance(b, T.DecimalType):
        scale = max(k.scale if isinstance(k, T.DecimalType) else 0 for k in (a, b))
        return T.DecimalType(38, scale)
    return T.LongType()


def _arithmetic(e: Op, a: Value, b: Value, strict: bool) -> Value:
    text = isinstance(a.dtype, T.StringType)
    if e.op == "+" and text and isinstance(b.dtype, T.StringType):
        return Value(F.concat(a.col, b.col), T.StringType())
    if e.op == "*" and text and is_integral(b.dtype):
        return Value(F.repeat(a.col, b.col.cast("int")), T.StringType())
    times = (T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType)
    if isinstance(a.dtype, times) and e.op in "+-":
        if isinstance(b.dtype, T.DayTimeIntervalType):
            return Value((a.col + b.col if e.op == "+" else a.col - b.col).cast(a.dtype), a.dtype)
        if e.op == "-" and isinstance(b.dtype, times):
            return Value(a.col - b.col, T.DayTimeIntervalType())
    if not (is_numeric(a.dtype) and is_numeric(b.dtype)):
        raise SetupTypeError(f"{e.to_source()}: no {e.op} of {a.dtype.simpleString()} and {b.dtype.simpleString()}")
    kind = _wider(a.dtype, b.dtype)
    x, y = a.col, b.col
    if is_integral(a.dtype):
        x = x.cast("long")
    if is_integral(b.dtype):
        y = y.cast("long")
    if e.op in ("+", "-", "*"):
        safe = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[e.op]
        hard = {"+": x + y, "-": x - y, "*": x * y}[e.op]
        out = hard if strict else safe(x, y)
        return Value(out.cast(kind) if isinstance(kind, T.DecimalType) else out, kind)
    if e.op == "/":
        kind = T.DoubleType() if not isinstance(kind, T.DecimalType) else kind
        out = x / y if strict else F.try_divide(x, y)
        return Value(out.cast(kind), kind)
    if isinstance(kind, T.DoubleType):
        out = F.floor(x / y if strict else F.try_divide(x, y)).cast("double")
        return Value(out, kind)
    if isinstance(kind, T.DecimalType):
        return Value(F.floor(x / y if strict else F.try_divide(x, y)).cast(kind), kind)
    by = y if strict else F.nullif(y, F.lit(0).cast("long"))
    quotient = F.call_function("div", x, by)
    return Value(quotient - F.when((x % by != 0) & ((x < 0) != (by < 0)), F.lit(1)).otherwise(F.lit(0)), T.LongType())
