"""Model code as text: dataclasses, pydantic models, DDL, and column types of common mappers."""

from __future__ import annotations

from pyspark.sql import types as T

from ..model import ChoiceField, Entity, EnumField, Required, SubEntity, SubEntityItems
from ..plans.setup import dtype_of, flat

#: Spark type -> (Python, SQLAlchemy, Django)
TYPES = {
    "string": ("str", "String", "CharField"), "bigint": ("int", "BigInteger", "BigIntegerField"), "boolean": ("bool", "Boolean", "BooleanField"), "double": ("float", "Float", "FloatField"),
    "decimal": ("Decimal", "Numeric", "DecimalField"), "date": ("date", "Date", "DateField"), "timestamp_ntz": ("datetime", "DateTime", "DateTimeField"), "interval day to second": ("timedelta", "Interval", "DurationField"),
}


def type_names(kind: T.DataType) -> tuple[str, str, str]:
    return TYPES[kind.simpleString().split("(")[0]]


def _title(name: str) -> str:
    return "".join(p.capitalize() for p in name.split("_"))


def _classes(name: str, parts, level: int, depth: int | None) -> list[tuple[str, list[tuple[str, str, bool]]]]:
    out, rows = [], []
    for c, _ in flat(parts):
        if isinstance(c, (SubEntity, SubEntityItems)):
            kind = _title(f"{name}_{c.name}") if depth is None or level < depth else _title(c.name)
            out += _classes(f"{name}_{c.name}" if kind != _title(c.name) else c.name, c.contains, level + 1, depth)
            rows.append((c.name, f"list[{kind}]" if isinstance(c, SubEntityItems) else kind, isinstance(c, SubEntity)))
        elif (kind := dtype_of(c)) is not None or isinstance(c, (ChoiceField, EnumField)):
            rows.append((c.name, type_names(kind or T.StringType())[0], not any(isinstance(x, Required) for x in c.cleaners)))
    return [*out, (_title(name), rows)]


def _render(entity: Entity, head: str, base: str, decorator: str, depth: int | None, flatten: bool) -> str:
    out = [head, ""]
    for name, rows in _classes(entity.name, entity.contains, 0, 0 if flatten else depth):
        rows = sorted(rows, key=lambda r: r[2])  # dataclasses take members without default first
        out += ["", *([decorator] if decorator else []), f"class {name}{base}:"]
        out += [f"    {n}: {t} | None = None" if optional else f"    {n}: {t}" for n, t, optional in rows] or ["    pass"]
        out.append("")
    return "\n".join(out)


_IMPORTS = "from __future__ import annotations\n\nfrom datetime import date, datetime, timedelta\nfrom decimal import Decimal\n"


def to_dataclass(entity: Entity, depth: int | None = None, flatten: bool = False) -> str:
    """Dataclasses, children first.  flatten: class names without those of the parents."""
    return _render(entity, f"{_IMPORTS}from dataclasses import dataclass", "", "@dataclass", depth, flatten)


def to_pydantic(entity: Entity, depth: int | None = None, flatten: bool = False) -> str:
    return _render(entity, f"{_IMPORTS}\nfrom pydantic import BaseModel", "(BaseModel)", "", depth, flatten)


def to_ddl(entity: Entity, table: str | None = None) -> str:
    """CREATE TABLE of the entity's schema."""
    cols = ",\n".join(f"  {f.name} {f.dataType.simpleString()}" for f in entity.schema())
    return f"CREATE TABLE {table or entity.name} (\n{cols}\n)"
