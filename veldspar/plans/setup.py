"""Checks of a definition on the driver, before any data is seen."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import types as T

from ..errors import SetupError, SetupNameError
from ..expr import Call, Expr, Op, Path
from ..model import BooleanField, ChoiceField, Component, Entity, EnumField, Evaluation, Field, FieldGroup, SubEntity, SubEntityItems, Validation
from ..types import BY_PYTHON


def flat(parts: tuple[Component, ...], gates: tuple[str, ...] = ()) -> Iterator[tuple[Component, tuple[str, ...]]]:
    """Components of one data level in order, with the booleans that must be true for each; groups share their parent's level."""
    for c in parts:
        yield c, gates
        if isinstance(c, BooleanField) and c.enables:
            yield from flat(c.enables, (*gates, c.name))
        elif isinstance(c, FieldGroup) and not isinstance(c, (SubEntity, SubEntityItems)):
            yield from flat(c.contains, gates)


def dtype_of(c: Component) -> T.DataType | None:
    if isinstance(c, (ChoiceField, EnumField)):
        return BY_PYTHON.get(type(c.values[0])) if c.values else None
    return c.dtype if isinstance(c, Field) else None


def schema_of(parts: tuple[Component, ...]) -> T.StructType:
    out = []
    for c, _ in flat(parts):
        if isinstance(c, SubEntityItems):
            out.append(T.StructField(c.name, T.ArrayType(schema_of(c.contains))))
        elif isinstance(c, SubEntity):
            out.append(T.StructField(c.name, schema_of(c.contains)))
        elif isinstance(c, Field):
            out.append(T.StructField(c.name, dtype_of(c) or T.StringType()))
    return T.StructType(out)


def paths(e: Expr) -> Iterator[Path]:
    if isinstance(e, Path):
        yield e
    elif isinstance(e, Op):
        yield from paths(e.left)
        if e.right is not None:
            yield from paths(e.right)
    elif isinstance(e, Call):
        if e.receiver is not None:
            yield from paths(e.receiver)
        for a in [*e.args, *[v for _, v in e.kwargs]]:
            yield from paths(a)


def check(entity: Entity) -> None:
    """Names are unique per level, keys exist, and cleaners don't use stored values."""

    def level(parts: tuple[Component, ...], where: str) -> None:
        seen: set[str] = set()
        for c, _ in flat(parts):
            if c.name in seen:
                raise SetupNameError(f"{where}.{c.name} is there twice")
            seen.add(c.name)
            c.path  # noqa: B018 - raises for a bad path
            for x in c.cleaners:
                for e in (getattr(x, "ensure", None), x.available, getattr(x, "value", None)):
                    if isinstance(e, Expr) and any(p.ns == "M" for p in paths(e)):
                        raise SetupError(f"{where}.{c.name}: rules and evaluations don't use M")
                if not isinstance(x, (Validation, Evaluation)):
                    raise SetupError(f"{where}.{c.name}: {type(x).__name__} is no cleaner")
            if isinstance(c, (SubEntity, SubEntityItems)):
                level(c.contains, f"{where}.{c.name}")
                if isinstance(c, SubEntityItems) and c.keys:
                    have(c.contains, c.keys.names, f"{where}.{c.name}")

    def have(parts: tuple[Component, ...], names: tuple[str, ...], where: str) -> None:
        known = {c.name for c, _ in flat(parts) if isinstance(c, Field)}
        for n in names:
            if n not in known:
                raise SetupNameError(f"{where} has no field {n} for its key")

    level(entity.contains, entity.name)
    if entity.keys:
        have(entity.contains, entity.keys.names, entity.name)
