"""Custom functions: native columns first, Arrow-batched or plain Python ones where a rule needs them."""

from __future__ import annotations

import inspect
import typing
from collections.abc import Callable
from typing import Any

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SetupError, SetupNameError, SetupTypeError
from ..types import compatible, of_hint
from .builtin import BUILTINS, Lazy, Value


def Function(py: Callable | None = None, *, native: Callable[..., Any] | None = None, pandas: Callable | None = None, returns: T.DataType | None = None, name: str | None = None, args: tuple = (), kwargs: dict[str, Any] | None = None, force: bool = False) -> Callable[..., Value]:
    """A function for expressions.  ``native`` takes and gives columns; ``pandas`` takes and gives series in Arrow batches;
    ``py`` is called row by row.  args and kwargs are fixed beforehand, then comes the value of the chain, then what the
    expression passes.  Type hints of ``py`` are checked when expressions are bound.  ``force`` may replace a builtin.
    """
    target = native or pandas or py
    if target is None:
        raise SetupError("a function needs native, pandas or py")
    fixed, named = tuple(args), dict(kwargs or {})
    hints: dict[str, Any] = {}
    if returns is None:
        hints = typing.get_type_hints(target)
        if "return" not in hints:
            raise SetupTypeError(f"{target.__name__} needs a return type")
        returns = of_hint(hints["return"])[0]

    def call(*values: Value, **more: Value) -> Value:
        if any(isinstance(v, Lazy) for v in values):
            raise SetupTypeError(f"{target.__name__} takes no item expressions")
        given = [*fixed, *values]
        if py is not None and native is None and pandas is None:
            bound = inspect.signature(py)
            try:
                bound.bind(*given, **named, **more)
            except TypeError as e:
                raise SetupTypeError(f"{py.__name__}: {e}") from e
            for p, v in zip(bound.parameters.values(), given, strict=False):
                if isinstance(v, Value) and p.name in hints and hints[p.name] is not Any and not compatible(v.dtype, of_hint(hints[p.name])[0]):
                    raise SetupTypeError(f"{py.__name__}: {p.name} is a {hints[p.name]}, not {v.dtype.simpleString()}")
        cols = [v.col if isinstance(v, Value) else F.lit(v) for v in given]
        if native is not None:
            return Value(native(*cols, **named, **{k: v.col for k, v in more.items()}), returns)
        if pandas is not None:
            return Value(F.pandas_udf(pandas, returns)(*cols), returns)
        n = len(cols)
        keys = [*more]
        run = (lambda *x: py(*x, **named)) if not keys else (lambda *x: py(*x[:n], **named, **dict(zip(keys, x[n:], strict=True))))
        return Value(F.udf(run, returns)(*cols, *[more[k].col for k in keys]), returns)

    call.__name__ = name or target.__name__
    call.force = force
    return call


class Item:
    """What a function over items gets for an argument about one item: ``name`` if it is a bare member or a text, and a call that
    gives the column of the argument for an item."""

    def __init__(self, lazy: Lazy, kind: T.DataType):
        self.lazy, self.kind, self.name = lazy, kind, lazy.name

    def __call__(self, item: Any) -> Any:
        return self.lazy.each(Value(item, self.kind)).col

    def dtype(self) -> T.DataType:
        """The type of the argument, for functions that pass it on."""
        return self.lazy.each(Value(F.lit(None).cast(self.kind), self.kind)).dtype


def ItemsFunction(native: Callable[..., Any], *, returns: T.DataType | Callable[[T.DataType], T.DataType] | None = None, name: str | None = None, args: tuple = (), kwargs: dict[str, Any] | None = None, force: bool = False) -> Callable[..., Value]:
    """A function of a list of items, in chains (``F.lines.Spread(This.q)``) or called on one.  ``native(items, *arguments)`` takes the column of the
    list, and an :class:`Item` for each argument of the expression, after the fixed ones.  returns: a type, or what gives one from the
    type of the items; the list's own type where it is left out."""

    def call(items: Value, *given: Any, **more: Any) -> Value:
        if not isinstance(items, Value) or not isinstance(items.dtype, T.ArrayType):
            raise SetupTypeError(f"{call.__name__} needs a list" + (f", not {items.dtype.simpleString()}" if isinstance(items, Value) else ""))
        kind = items.dtype.elementType
        wrapped = lambda v: Item(v, kind) if isinstance(v, Lazy) else v.col if isinstance(v, Value) else v
        out = native(items.col, *args, *map(wrapped, given), **(kwargs or {}), **{k: wrapped(v) for k, v in more.items()})
        return Value(out, items.dtype if returns is None else returns if isinstance(returns, T.DataType) else returns(kind))

    call.__name__ = name or getattr(native, "__name__", "ItemsFunction")
    call.force, call.takes_items = force, True
    return call


def FunctionByMethod(settings: Any, method: str, **how: Any) -> Callable[..., Value]:
    """A function that is a method of a settings object, which travels with the tasks."""
    return Function(getattr(settings, method), name=how.pop("name", method), **how)


def lookup(custom: dict[str, Callable], name: str) -> Callable[..., Value]:
    if name in custom:
        if name in BUILTINS and not getattr(custom[name], "force", False):
            raise SetupNameError(f"function {name} is a builtin; force replaces it")
        return custom[name]
    if name in BUILTINS:
        return BUILTINS[name]
    raise SetupNameError(f"no function {name}; there are {', '.join(sorted({**BUILTINS, **custom}))}")
