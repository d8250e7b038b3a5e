"""Definitions: an entity, its fields, parts, keys and cleaners.  All are immutable; ``dataclasses.replace`` makes variants."""

from __future__ import annotations

import enum
from dataclasses import dataclass, field
from typing import Any, ClassVar

from pyspark.sql import types as T

from .errors import SetupError
from .expr import Expr, Path, wrap


@dataclass(frozen=True)
class Cleaner:
    """A rule or a derivation.  ``available`` (bool or expression) switches it off per row where the class consults it."""

    title: str | None = field(default=None, kw_only=True)
    available: Any = field(default=True, kw_only=True)


@dataclass(frozen=True)
class Validation(Cleaner):
    ensure: Any = field(default=True)
    error: str | None = field(default=None, kw_only=True)
    name: str | None = field(default=None, kw_only=True)
    gated: ClassVar[bool] = True

    @property
    def rule(self) -> str:
        return self.name or type(self).__name__


class FieldValidation(Validation):
    """Passes where ``ensure`` is true; null fails."""


class ChildrenValidation(Validation):
    """On an entity, a sub-entity, a group or a boolean with ``enables``."""


class ItemsValidation(Validation):
    """On a list of items, with This.Items."""


@dataclass(frozen=True)
class _Valued(FieldValidation):
    """A rule with a value; it doesn't consult ``available``."""

    ensure: Any = field(default=True, init=False)
    value: Any = field(default=None)
    gated: ClassVar[bool] = False

    def __init__(self, value: Any = None, *, title: str | None = None, error: str | None = None, name: str | None = None):
        for k, v in {"value": value, "title": title, "error": error, "name": name, "ensure": True, "available": True}.items():
            object.__setattr__(self, k, v)


class Required(_Valued):
    def __init__(self, **how: Any):
        super().__init__(None, **how)


class Readonly(_Valued):
    def __init__(self, value: Any = True, **how: Any):
        super().__init__(value, **how)


class MinValue(_Valued):
    pass


class ExactLength(_Valued):
    pass


class MaxLength(_Valued):
    pass


class MinLength(_Valued):
    pass


@dataclass(frozen=True)
class RangeLength(FieldValidation):
    min: Any = field(default=None, kw_only=True)
    max: Any = field(default=None, kw_only=True)
    gated: ClassVar[bool] = False

    def __post_init__(self) -> None:
        if not self.min and not self.max:
            raise SetupError("a range of lengths needs min or max")


class HourFieldValidation(_Valued):
    def __init__(self, **how: Any):
        super().__init__(None, **how)


@dataclass(frozen=True)
class _Range(ItemsValidation):
    min: int | None = field(default=None, kw_only=True)
    max: int | None = field(default=None, kw_only=True)

    def __post_init__(self) -> None:
        bounds = [b for b in (self.min, self.max) if b is not None]
        if not bounds or any(not isinstance(b, int) or b < 0 for b in bounds):
            raise SetupError("a cardinality needs bounds that are integers from 0 up")
        if len(bounds) == 2 and bounds[0] > bounds[1]:
            raise SetupError("min is above max")
        if self.max == 1:
            raise SetupError("for at most one use a sub-entity")


@dataclass(frozen=True)
class _Multi(ItemsValidation):
    allow_none: bool = field(default=True, kw_only=True)


class Cardinality:
    """How many items a list may hold."""

    Range = _Range
    Multi = _Multi


@dataclass(frozen=True)
class _UniqueItems(ItemsValidation):
    fields: tuple[str, ...] = field(default=(), kw_only=True)
    ignore_none: bool = field(default=True, kw_only=True)


@dataclass(frozen=True)
class _UniqueGlobal(_UniqueItems):
    pass


class Unique:
    """Items: within each list.  Global: over all rows."""

    Items = _UniqueItems
    Global = _UniqueGlobal


@dataclass(frozen=True)
class SingleValidation(Validation):
    allow_none: bool = field(default=True, kw_only=True)


@dataclass(frozen=True)
class Evaluation(Cleaner):
    value: Any = None


class FieldEvaluation(Evaluation):
    """Sets the field to ``value`` where ``available``."""


class Default(Evaluation):
    """Fills nulls, or overwrites with ``default_mode="overwrite"`` of the settings; ignores ``available``."""


@dataclass(frozen=True)
class ChildrenEvaluation(Evaluation):
    """Sets the child ``child`` of a component."""

    child: str = field(default="", kw_only=True)


@dataclass(frozen=True)
class ItemsEvaluation(Evaluation):
    """Sets the field ``child`` of every item; This is the item."""

    child: str = field(default="", kw_only=True)


@dataclass(frozen=True)
class Component:
    name: str
    bind_to: Any = field(default=None, kw_only=True)
    title: str | None = field(default=None, kw_only=True)
    cleaners: tuple = field(default=(), kw_only=True)
    allowed: ClassVar[tuple[type, ...]] = ()

    def __post_init__(self) -> None:
        object.__setattr__(self, "cleaners", tuple(self.cleaners))
        if not self.name.isidentifier() or self.name.startswith("_"):
            raise SetupError(f"{self.name!r} is no name for a component")
        for c in self.cleaners:
            if not isinstance(c, self.allowed):
                raise SetupError(f"{type(c).__name__} isn't allowed on {type(self).__name__} {self.name}")

    @property
    def path(self) -> tuple[str, ...]:
        """Where the stored value lies, relative to the parent."""
        b = self.bind_to
        if b is None:
            return (self.name,)
        parts = tuple(b.split(".")) if isinstance(b, str) else b.parts if isinstance(b, Path) and b.ns == "M" else None
        if not parts or len(parts) > 4:
            raise SetupError(f"{self.name} binds to an M path of at most four parts")
        return parts

    @property
    def parts(self) -> tuple[Component, ...]:
        return ()


@dataclass(frozen=True)
class Field(Component):
    dtype: ClassVar[T.DataType | None] = None
    adapts: ClassVar[bool] = False
    injected: ClassVar[tuple] = ()
    autocomputed: bool | None = field(default=None, kw_only=True)
    allowed: ClassVar[tuple[type, ...]] = (FieldValidation, FieldEvaluation, Default)

    def __post_init__(self) -> None:
        super().__post_init__()
        object.__setattr__(self, "cleaners", (*self.injected, *[c for c in self.cleaners if c not in self.injected]))
        derived = any(isinstance(c, FieldEvaluation) for c in self.cleaners)
        if self.autocomputed is not None and self.autocomputed != derived:
            raise SetupError(f"{self.name}: autocomputed goes with an evaluation other than a default, and only with one")


class StringField(Field):
    dtype, adapts = T.StringType(), True


class SizedStringField(StringField):
    def __post_init__(self) -> None:
        super().__post_init__()
        if not any(isinstance(c, (MaxLength, ExactLength)) for c in self.cleaners):
            raise SetupError(f"{self.name} needs MaxLength or ExactLength")


@dataclass(frozen=True)
class BooleanField(Field):
    enables: tuple = field(default=(), kw_only=True)
    dtype: ClassVar[T.DataType | None] = T.BooleanType()
    allowed: ClassVar[tuple[type, ...]] = (FieldValidation, FieldEvaluation, Default, ChildrenValidation, ChildrenEvaluation)

    def __post_init__(self) -> None:
        super().__post_init__()
        object.__setattr__(self, "enables", tuple(self.enables))
        if not self.enables and any(isinstance(c, (ChildrenValidation, ChildrenEvaluation)) for c in self.cleaners):
            raise SetupError(f"{self.name} has rules for children but enables none")

    @property
    def parts(self) -> tuple[Component, ...]:
        return self.enables


class IntegerField(Field):
    dtype = T.LongType()


class IdField(IntegerField):
    pass


class PositiveIntegerField(IntegerField):
    injected = (MinValue(1),)


class FloatField(Field):
    dtype = T.DoubleType()


@dataclass(frozen=True)
class DecimalField(Field):
    precision: int = field(default=38, kw_only=True)
    scale: int = field(default=18, kw_only=True)

    @property
    def dtype(self) -> T.DataType:  # type: ignore[override]
        return T.DecimalType(self.precision, self.scale)


class DateField(Field):
    dtype = T.DateType()


class DateTimeField(Field):
    dtype = T.TimestampNTZType()


class TimeField(Field):
    dtype = T.StringType()


class DurationField(Field):
    dtype = T.DayTimeIntervalType()


class EmailField(Field):
    dtype = T.StringType()


@dataclass(frozen=True)
class ChoiceOption:
    value: Any
    title: str | None = None
    available: Any = True


@dataclass(frozen=True)
class ChoiceField(Field):
    choices: tuple = field(default=(), kw_only=True)

    @property
    def values(self) -> list[Any]:
        got = self.choices() if callable(self.choices) else self.choices
        return [c.value if isinstance(c, ChoiceOption) else c for c in got]


@dataclass(frozen=True)
class EnumField(Field):
    enum: type[enum.Enum] | None = field(default=None, kw_only=True)

    @property
    def values(self) -> list[Any]:
        return [m.value for m in self.enum] if self.enum else []


@dataclass(frozen=True)
class FieldGroup(Component):
    contains: tuple = field(default=(), kw_only=True)
    allowed: ClassVar[tuple[type, ...]] = (ChildrenValidation, ChildrenEvaluation)

    def __post_init__(self) -> None:
        super().__post_init__()
        object.__setattr__(self, "contains", tuple(self.contains))

    @property
    def parts(self) -> tuple[Component, ...]:
        return self.contains


class SubEntity(FieldGroup):
    allowed = (SingleValidation, ChildrenValidation, ChildrenEvaluation)


@dataclass(frozen=True)
class KeyFields:
    names: tuple[str, ...]

    def __init__(self, *names: str):
        if not names or len(set(names)) < len(names):
            raise SetupError("keys are one or more different names")
        object.__setattr__(self, "names", tuple(names))


@dataclass(frozen=True)
class SubEntityItems(FieldGroup):
    keys: KeyFields | None = field(default=None, kw_only=True)
    allowed: ClassVar[tuple[type, ...]] = (ItemsValidation, ItemsEvaluation)


@dataclass(frozen=True)
class Settings:
    """``values`` and ``methods`` (called once on the driver) are what Ctx.<name> gives; ``functions`` are added to the builtins.

    Names of settings given to apply win over those of the entity.  ``strict`` lets errors in expressions fail the job;
    otherwise they give null, hence a broken rule.  ``trace`` keeps what each evaluation found and gave (:attr:`ApplyFrame.history`).
    """

    values: dict[str, Any] = field(default_factory=dict)
    methods: dict[str, Any] = field(default_factory=dict)
    functions: dict[str, Any] = field(default_factory=dict)
    default_mode: str = "fill"
    strict: bool = False
    strict_choices: bool = False
    strict_email: bool = False
    debug: bool = False
    trace: bool = False

    def merged(self, other: Settings | None) -> Settings:
        if other is None:
            return self
        return Settings({**self.values, **other.values}, {**self.methods, **other.methods}, {**self.functions, **other.functions}, other.default_mode, other.strict, other.strict_choices, other.strict_email, other.debug, other.trace)

    def context(self) -> dict[str, Any]:
        return {"Debug": self.debug, **self.values, **{k: f() for k, f in self.methods.items()}}


@dataclass(frozen=True)
class Entity(FieldGroup):
    keys: KeyFields | None = field(default=None, kw_only=True)
    settings: Settings = field(default_factory=Settings, kw_only=True)
    allowed: ClassVar[tuple[type, ...]] = (ChildrenValidation, ChildrenEvaluation)

    def __post_init__(self) -> None:
        super().__post_init__()
        from .plans.setup import check

        check(self)

    def apply(self, df, new=None, **how):
        """See :func:`veldspar.plans.apply.apply`."""
        from .plans.apply import apply

        return apply(self, df, new, **how)

    def dump_defaults(self, spark, settings: Settings | None = None) -> dict[str, Any]:
        from .plans.apply import dump_defaults

        return dump_defaults(self, spark, settings)

    def schema(self) -> T.StructType:
        """The schema of an unbound entity, from its fields."""
        from .plans.setup import schema_of

        return schema_of(self.contains)


def expression(value: Any) -> Expr:
    return wrap(value)
