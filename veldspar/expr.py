"""Expressions over four namespaces: M (stored model), F (current fields), This (the component under a rule), Ctx (settings).

Expressions are immutable trees.  Python operators build them, ``to_source`` writes them as text, :func:`parse` reads it back.
"""

from __future__ import annotations

import ast
import datetime
import decimal
from dataclasses import dataclass, field
from typing import Any

from .errors import LoadError

NAMESPACES = ("M", "F", "This", "Ctx")
SYMBOLS = {"==": 3, "!=": 3, ">": 3, ">=": 3, "<": 3, "<=": 3, "+": 5, "-": 5, "*": 6, "/": 6, "//": 6, "&": 2, "|": 1}


class Expr:
    """Operators build :class:`Op`; ``==`` too, so expressions compare by ``same_as``."""

    __hash__ = object.__hash__

    def __eq__(self, other: Any) -> Expr:  # type: ignore[override]
        return Op("==", self, wrap(other))

    def __ne__(self, other: Any) -> Expr:  # type: ignore[override]
        return Op("!=", self, wrap(other))

    def __bool__(self) -> bool:
        raise TypeError("an expression has no truth value; use & | ~")

    def contains(self, other: Any) -> Expr:
        """Whether a string holds a part or a list an element; ``in`` can't be overloaded this way."""
        return Op("in", wrap(other), self)

    def is_in(self, *values: Any) -> Expr:
        out: Expr = Op("==", self, wrap(values[0]))
        for v in values[1:]:
            out = Op("|", out, Op("==", self, wrap(v)))
        return out

    def same_as(self, other: Expr) -> bool:
        return self.to_source() == other.to_source()

    def to_source(self) -> str:
        raise NotImplementedError

    def __repr__(self) -> str:
        return self.to_source()


def _binary(symbol: str):
    return lambda self, other: Op(symbol, self, wrap(other))


def _reflected(symbol: str):
    return lambda self, other: Op(symbol, wrap(other), self)


for _name, _symbol in {"gt": ">", "ge": ">=", "lt": "<", "le": "<="}.items():
    setattr(Expr, f"__{_name}__", _binary(_symbol))
for _name, _symbol in {"add": "+", "sub": "-", "mul": "*", "truediv": "/", "floordiv": "//", "and": "&", "or": "|"}.items():
    setattr(Expr, f"__{_name}__", _binary(_symbol))
    setattr(Expr, f"__r{_name}__", _reflected(_symbol))
Expr.__invert__ = lambda self: Op("not", self)  # type: ignore[attr-defined]


@dataclass(frozen=True, eq=False, repr=False)
class Path(Expr):
    ns: str
    parts: tuple[str, ...] = ()

    def __getattr__(self, name: str) -> Path:
        if name.startswith("_"):
            raise AttributeError(name)
        return Path(self.ns, (*self.parts, name))

    def __call__(self, *args: Any, **kwargs: Any) -> Call:
        if not self.parts:
            raise TypeError(f"{self.ns} is no function")
        receiver = Path(self.ns, self.parts[:-1])
        free = not receiver.parts and self.ns == "Ctx"
        return Call(self.parts[-1], None if free else receiver, tuple(map(wrap, args)), tuple((k, wrap(v)) for k, v in kwargs.items()))

    def to_source(self) -> str:
        return ".".join((self.ns, *self.parts))


@dataclass(frozen=True, eq=False, repr=False)
class Lit(Expr):
    value: Any

    def to_source(self) -> str:
        return f"Just({self.value!r})" if not isinstance(self.value, (str, int, float, bool, type(None))) else repr(self.value)


@dataclass(frozen=True, eq=False, repr=False)
class Op(Expr):
    op: str
    left: Expr
    right: Expr | None = None

    def to_source(self) -> str:
        if self.right is None:
            return f"(~{self.left.to_source()})"
        if self.op == "in":
            return f"{_receiver(self.right)}.contains({self.left.to_source()})"
        return f"({self.left.to_source()} {self.op} {self.right.to_source()})"


@dataclass(frozen=True, eq=False, repr=False)
class Call(Expr):
    func: str
    receiver: Expr | None
    args: tuple[Expr, ...] = ()
    kwargs: tuple[tuple[str, Expr], ...] = field(default=())

    def __getattr__(self, name: str) -> _Bound:
        if name.startswith("_"):
            raise AttributeError(name)
        return _Bound(self, name)

    def to_source(self) -> str:
        inner = ", ".join([a.to_source() for a in self.args] + [f"{k}={v.to_source()}" for k, v in self.kwargs])
        return f"{'Ctx' if self.receiver is None else _receiver(self.receiver)}.{self.func}({inner})"


def _receiver(e: Expr) -> str:
    return e.to_source() if isinstance(e, (Path, Call)) else f"({e.to_source().strip('()')})" if isinstance(e, Lit) else e.to_source()


@dataclass(frozen=True, eq=False, repr=False)
class _Bound(Expr):
    """A name after a call: a function if it is called, else a member of the result."""

    receiver: Expr
    name: str

    def __call__(self, *args: Any, **kwargs: Any) -> Call:
        return Call(self.name, self.receiver, tuple(map(wrap, args)), tuple((k, wrap(v)) for k, v in kwargs.items()))

    def __getattr__(self, name: str) -> _Bound:
        if name.startswith("_"):
            raise AttributeError(name)
        return _Bound(self, name)

    def to_source(self) -> str:
        return f"{self.receiver.to_source()}.{self.name}"


M, F, This, Ctx = (Path(ns) for ns in NAMESPACES)


def Just(value: Any) -> Lit:
    """A literal."""
    return Lit(value)


def wrap(value: Any) -> Expr:
    return value if isinstance(value, Expr) else Lit(value)


_PY = {ast.Eq: "==", ast.NotEq: "!=", ast.Gt: ">", ast.GtE: ">=", ast.Lt: "<", ast.LtE: "<=", ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.FloorDiv: "//", ast.BitAnd: "&", ast.BitOr: "|"}
_LITERALS = {"Decimal": decimal.Decimal, "date": datetime.date, "datetime": datetime.datetime, "timedelta": datetime.timedelta}


def parse(text: str) -> Expr:
    """The expression of a text.  Only paths, calls, literals and the operators above are read; nothing is evaluated."""
    try:
        tree = ast.parse(text.strip(), mode="eval").body
    except SyntaxError as e:
        raise LoadError(f"{text!r} is no expression") from e
    return _read(tree, text)


def _read(n: ast.AST, text: str) -> Expr:
    if isinstance(n, ast.Constant):
        return Lit(n.value)
    if isinstance(n, ast.Name) and n.id in NAMESPACES:
        return Path(n.id)
    if isinstance(n, ast.Attribute):
        return getattr(_read(n.value, text), n.attr)
    if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.Invert):
        return ~_read(n.operand, text)
    if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.USub) and isinstance(n.operand, ast.Constant):
        return Lit(-n.operand.value)
    if isinstance(n, ast.BinOp) and type(n.op) in _PY:
        return Op(_PY[type(n.op)], _read(n.left, text), _read(n.right, text))
    if isinstance(n, ast.Compare) and len(n.ops) == 1 and type(n.ops[0]) in _PY:
        return Op(_PY[type(n.ops[0])], _read(n.left, text), _read(n.comparators[0], text))
    if isinstance(n, ast.Call):
        if isinstance(n.func, ast.Name) and n.func.id == "Just" and len(n.args) == 1:
            return Lit(_literal(n.args[0], text))
        if isinstance(n.func, ast.Attribute):
            args = [_read(a, text) for a in n.args]
            target = _read(n.func.value, text)
            if n.func.attr == "contains" and len(args) == 1:
                return target.contains(args[0])
            kwargs = {k.arg: _read(k.value, text) for k in n.keywords if k.arg}
            if isinstance(target, (Path, Call, _Bound)):
                return getattr(target, n.func.attr)(*args, **kwargs)
            return Call(n.func.attr, target, tuple(args), tuple(kwargs.items()))
    raise LoadError(f"{ast.unparse(n)!r} isn't allowed in an expression")


def _literal(n: ast.AST, text: str) -> Any:
    if isinstance(n, ast.Call):
        name = n.func.attr if isinstance(n.func, ast.Attribute) else getattr(n.func, "id", "")
        if name in _LITERALS:
            return _LITERALS[name](*[ast.literal_eval(a) for a in n.args], **{k.arg: ast.literal_eval(k.value) for k in n.keywords})
    try:
        return ast.literal_eval(n)
    except ValueError as e:
        raise LoadError(f"{text!r} holds a literal that can't be read") from e
