"""Definitions to dicts or JSON and back.  Expressions are texts marked ``DEXP::``; reading never evaluates code."""

from __future__ import annotations

import json
from dataclasses import fields
from typing import Any

from .. import model
from ..errors import LoadError
from ..expr import Expr, parse
from ..types import T

MARK = "DEXP::"
_NESTED = {"Range": model.Cardinality.Range, "Multi": model.Cardinality.Multi, "UniqueItems": model.Unique.Items, "UniqueGlobal": model.Unique.Global}
_CLASSES = {k: v for k, v in vars(model).items() if isinstance(v, type) and issubclass(v, (model.Component, model.Cleaner, model.KeyFields, model.ChoiceOption)) and not k.startswith("_")} | _NESTED
_NAMES = {v: k for k, v in _CLASSES.items()}
_SKIP = {"settings", "autocomputed"}


def dump(x: Any) -> Any:
    """A plain structure of {type, attrs}; attributes that have their default are left out."""
    if isinstance(x, Expr):
        return MARK + x.to_source()
    if isinstance(x, (list, tuple)):
        return [dump(v) for v in x]
    if type(x) in _NAMES:
        attrs = {}
        for f in fields(x) if hasattr(x, "__dataclass_fields__") else ():
            v = getattr(x, f.name)
            if f.name in _SKIP or v is f.default or isinstance(v, tuple) and not v or v is None or f.name in ("ensure", "available") and v is True:
                continue
            if f.name == "cleaners":
                v = [c for c in v if c not in getattr(x, "injected", ())]
                if not v:
                    continue
            attrs[f.name] = dump(v)
        return {"type": _NAMES[type(x)], "attrs": attrs}
    if isinstance(x, (str, int, float, bool, type(None))):
        return x
    raise LoadError(f"{type(x).__name__} can't be dumped")


def load(x: Any) -> Any:
    """The definition of a dict or of JSON text."""
    if isinstance(x, str) and x.lstrip().startswith("{"):
        x = json.loads(x)
    return _load(x)


def _load(x: Any) -> Any:
    if isinstance(x, str):
        return parse(x[len(MARK) :]) if x.startswith(MARK) else x
    if isinstance(x, list):
        return tuple(_load(v) for v in x)
    if isinstance(x, dict):
        if set(x) - {"type", "attrs"} or x.get("type") not in _CLASSES:
            raise LoadError(f"no component of type {x.get('type')!r}")
        kind, attrs = _CLASSES[x["type"]], {k: _load(v) for k, v in x.get("attrs", {}).items()}
        try:
            if kind is model.KeyFields:
                return kind(*attrs["names"])
            return kind(**attrs)
        except TypeError as e:
            raise LoadError(f"{x['type']}: {e}") from e
    return x


def to_json(x: Any) -> str:
    return json.dumps(dump(x), indent=1, sort_keys=True)


def to_yaml(x: Any, level: int = 0) -> str:
    """The dump as YAML: JSON scalars in block style."""
    data = dump(x) if not isinstance(x, (dict, list)) else x
    pad, out = "  " * level, []
    for k, v in data.items() if isinstance(data, dict) else ((None, v) for v in data):
        head = f"{pad}{k}:" if k is not None else f"{pad}-"
        out.append(f"{head}\n{to_yaml(v, level + 1)}" if isinstance(v, (dict, list)) and v else f"{head} {json.dumps(v)}")
    return "\n".join(out)


def schema_diff(source: T.StructType, target: T.StructType, prefix: str = "") -> list[tuple[str, str, str | None, str | None]]:
    """(column, same | diff | source_only | target_only, source type, target type), with nested members by path."""
    out = []
    names = [f.name for f in source] + [f.name for f in target if f.name not in source.fieldNames()]
    show = lambda f: f.dataType.simpleString() + ("" if f.nullable else " not null")
    for n in names:
        a = source[n] if n in source.fieldNames() else None
        b = target[n] if n in target.fieldNames() else None
        path = f"{prefix}{n}"
        if a is None or b is None:
            out.append((path, "target_only" if a is None else "source_only", a and show(a), b and show(b)))
        elif isinstance(a.dataType, T.StructType) and isinstance(b.dataType, T.StructType):
            out += schema_diff(a.dataType, b.dataType, f"{path}.")
        else:
            out.append((path, "same" if show(a) == show(b) else "diff", show(a), show(b)))
    return out
