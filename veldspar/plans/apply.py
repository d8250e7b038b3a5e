"""Apply a definition to a whole DataFrame: bind, overlay, adapt, gate, evaluate in order, validate, report changes.

Everything is a projection of native columns; the join with a frame of new values is the only shuffle.  The frame that comes back
has the fields of the entity, ``_op``, ``_errors``, ``_changes`` and ``_ok``.  Nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ApplyError, SetupNameError, SetupTypeError
from ..expr import Expr
from ..functions.builtin import Value, truth
from ..model import (
    BooleanField, ChildrenEvaluation, ChoiceField, Component, Default, Entity, EnumField, ExactLength, Field, FieldEvaluation, FieldGroup, HourFieldValidation, ItemsEvaluation,
    MaxLength, MinLength, MinValue, RangeLength, Readonly, Required, Settings, SingleValidation, SubEntity, SubEntityItems, Validation, _Multi, _Range, _UniqueGlobal, _UniqueItems,
)
from ..operators.diff import any_null, unique_by
from .compiler import Scope, adapt, compile_expr, member
from .setup import dtype_of, flat, schema_of

ERROR = "struct<key_string:string,error:string,validation_name:string,validation_title:string,details:string>"
CHANGE = "struct<key_string:string,change_op:string,init_value:string,value:string>"
HISTORY = "struct<key_string:string,step:int,phase:string,value:string>"
INIT, OP, TRACE = "__init", "__op", "__history"


@dataclass(frozen=True)
class ApplyFrame:
    """The frame after apply, and its long forms."""

    df: DataFrame
    keys: tuple[str, ...]

    @cached_property
    def errors(self) -> DataFrame:
        """One row per broken rule, with the key fields."""
        return self.df.select(*self.keys, F.explode("_errors").alias("e")).select(*self.keys, "e.*")

    @cached_property
    def changes(self) -> DataFrame:
        """One row per change, with the key fields."""
        return self.df.select(*self.keys, F.explode("_changes").alias("c")).select(*self.keys, "c.*")

    @cached_property
    def history(self) -> DataFrame:
        """One row per value that a phase set, with the key fields, in order: ``step`` 0 is what was stored, then come the overlay and the
        evaluations in their order.  Only with Settings(trace=True)."""
        if "_history" not in self.df.columns:
            raise ApplyError("values are traced with Settings(trace=True) only")
        return self.df.select(*self.keys, F.explode("_history").alias("h")).select(*self.keys, "h.*")

    def summary(self) -> DataFrame:
        """Failures by rule."""
        return self.df.select(F.explode("_errors").alias("e")).groupBy(F.regexp_replace("e.key_string", r"\[[^\]]*\]", "").alias("component"), F.col("e.validation_name").alias("validation_name"), F.col("e.error").alias("error")).agg(F.count("*").alias("n_failed"))

    def dump(self) -> DataFrame:
        """The key fields and all values of each row as JSON."""
        hidden = {"_op", "_errors", "_changes", "_ok", "_history"}
        return self.df.select(*self.keys, F.to_json(F.struct(*[c for c in self.df.columns if c not in hidden])).alias("json"))

    def raise_if_failed(self) -> None:
        row = self.df.where("NOT _ok").select("_errors").limit(1).collect()
        if row:
            raise ApplyError(f"rules are broken: {row[0][0][:5]}")


def _members(v: Value) -> dict[str, Value]:
    return {f.name: Value(v.col.getField(f.name), f.dataType) for f in v.dtype if not f.name.startswith("__")}


def _struct(values: dict[str, Value]) -> Value:
    return Value(F.struct(*[v.col.alias(k) for k, v in values.items()]), T.StructType([T.StructField(k, v.dtype) for k, v in values.items()]))


def _all(conditions: list[Column]) -> Column | None:
    return reduce(lambda a, b: a & b, conditions) if conditions else None


# -- binding


def _at(source: Value, path: tuple[str, ...], where: str) -> Value:
    return reduce(lambda v, name: member(v, name, where), path, source)


def bind(parts: tuple[Component, ...], source: Value, mode: str = "stored", bad: list[tuple[str, Column]] | None = None) -> dict[str, Value]:
    """Fields of one level from a source: stored names follow ``bind_to``, entity names are those of the fields.  In a patch, fields
    that the source hasn't are left out."""
    out: dict[str, Value] = {}
    for c, _ in flat(parts):
        if isinstance(c, FieldGroup) and not isinstance(c, (SubEntity, SubEntityItems)):
            continue
        try:
            v = _at(source, c.path if mode == "stored" else (c.name,), c.name)
        except SetupNameError:
            if mode == "stored":
                raise
            continue
        if isinstance(c, SubEntityItems):
            if not isinstance(v.dtype, T.ArrayType):
                raise SetupTypeError(f"{c.name} needs a list, not {v.dtype.simpleString()}")
            if _as_it_is(c.contains, v.dtype.elementType, mode):
                out[c.name] = v
                continue
            kinds: list[T.DataType] = []

            def one(x: Column) -> Column:  # noqa: B023 - called at once
                item = _struct(bind(c.contains, Value(x, v.dtype.elementType), mode))
                kinds.append(item.dtype)
                return item.col

            col = F.transform(v.col, one)
            out[c.name] = Value(col, T.ArrayType(kinds[0]))
        elif isinstance(c, SubEntity):
            inner = _struct(bind(c.contains, v, mode))
            out[c.name] = Value(F.when(v.col.isNotNull(), inner.col), inner.dtype)
        else:
            wanted = dtype_of(c) or v.dtype
            if v.dtype != wanted and bad is not None and not isinstance(wanted, T.StringType):
                bad.append((c.name, v.col.isNotNull() & adapt(v, wanted).isNull()))
            out[c.name] = Value(adapt(v, wanted), wanted)
    return out


def _as_it_is(parts: tuple[Component, ...], kind: T.DataType, mode: str) -> bool:
    """Whether items of this type have just the fields of parts, by name, type and order: then nothing has to be built."""
    level = [c for c, _ in flat(parts) if isinstance(c, (Field, SubEntity, SubEntityItems))]
    if not isinstance(kind, T.StructType) or [c.name for c in level] != kind.fieldNames():
        return False
    for c in level:
        inner = kind[c.name].dataType
        if mode == "stored" and c.path != (c.name,):
            return False
        if isinstance(c, SubEntityItems):
            if not isinstance(inner, T.ArrayType) or not _as_it_is(c.contains, inner.elementType, mode):
                return False
        elif isinstance(c, SubEntity):
            if not _as_it_is(c.contains, inner, mode):
                return False
        elif dtype_of(c) not in (None, inner):
            return False
    return True


def _mark(parts: tuple[Component, ...], values: dict[str, Value], op: Column) -> dict[str, Value]:
    """Items get their first values and an operation, which later phases read."""
    out = dict(values)
    for c, _ in flat(parts):
        if isinstance(c, SubEntityItems) and c.name in values:
            v = values[c.name]
            if INIT in v.dtype.elementType.fieldNames():
                continue
            kind = T.StructType([*v.dtype.elementType.fields, T.StructField(INIT, v.dtype.elementType), T.StructField(OP, T.StringType())])
            fields = v.dtype.elementType.fieldNames()
            out[c.name] = Value(F.transform(v.col, lambda x: F.struct(*[x.getField(f).alias(f) for f in fields], x.alias(INIT), op.cast("string").alias(OP))), T.ArrayType(kind))
    return out


def _marked(items: Value) -> bool:
    return INIT in items.dtype.elementType.fieldNames()


def _merge_items(c: SubEntityItems, old: Value, new: Value) -> Value:
    """Items of both sides matched by key, else by place: matched ones take the new members, the rest are DELETE or ADDED."""
    kind, patch = old.dtype.elementType, new.dtype.elementType
    full = T.StructType([*kind.fields, T.StructField(INIT, kind), T.StructField(OP, T.StringType())])

    def row(x: Column | None, y: Column | None, op: str) -> Column:
        def one(f: T.StructField) -> Column:
            if y is not None and f.name in patch.fieldNames():
                return y.getField(f.name).cast(f.dataType)
            return F.lit(None).cast(f.dataType) if x is None else x.getField(f.name)

        init = x if x is not None else F.lit(None).cast(kind)
        return F.struct(*[one(f).alias(f.name) for f in kind.fields], init.alias(INIT), F.lit(op).alias(OP))

    olds, news = F.coalesce(old.col, F.array().cast(old.dtype)), F.coalesce(new.col, F.array().cast(new.dtype))
    if c.keys:
        # keys of both sides in one order: a stored item stands right before the new one of its key, so a sort finds all matches
        key = lambda x: F.struct(*[x.getField(k).cast(kind[k].dataType).alias(k) for k in c.keys.names])
        null = lambda x: reduce(lambda a, b: a | b, [x.getField(k).isNull() for k in c.keys.names])
        entry = lambda side: lambda x, i: F.struct(null(x).alias("null"), key(x).alias("key"), F.lit(side).alias("side"), i.alias("at"))
        entries = F.sort_array(F.concat(F.transform(olds, entry(0)), F.transform(news, entry(1))))

        def pair(es: Column) -> Column:
            """(order, place among the stored, place among the new) of each item to come; null for a new one that its stored one brings."""

            def one(e: Column, i: Column) -> Column:
                other = lambda step: F.when(i + step >= 0, F.get(es, i + step))
                same = lambda o: F.coalesce(~e.null & ~o["null"] & (e.key == o["key"]), F.lit(False))
                before, after = other(-1), other(1)
                bad = F.when((e.side == 0) & e.null, F.raise_error(F.lit(f"{c.name} holds a stored item without key"))).when(same(before) & (before["side"] == e.side), F.raise_error(F.lit(f"{c.name} holds a key twice")))
                found = F.when(e.side == 0, F.struct(F.lit(0).alias("o"), e.at.alias("old"), F.when(same(after), after["at"]).alias("new"))).when(~same(before), F.struct(F.lit(1).alias("o"), e.at.alias("old"), e.at.alias("new")))
                return F.when(bad.isNull(), found)

            return F.sort_array(F.filter(F.transform(es, one), lambda x: x.isNotNull()))

        # one array at hand for all its items
        pairs = F.get(F.transform(F.array(entries), pair), F.lit(0))
        old_at, new_at = lambda x: F.get(olds, x["old"]), lambda x: F.get(news, x["new"])
        merged = F.transform(pairs, lambda x: F.when(x["o"] == 1, row(None, new_at(x), "ADDED")).when(x["new"].isNull(), row(old_at(x), None, "DELETE")).otherwise(row(old_at(x), new_at(x), "UPDATE")))
        return Value(merged, T.ArrayType(full))
    else:
        kept = F.transform(olds, lambda x, i: F.when(i < F.size(news), row(x, F.get(news, i), "UPDATE")).otherwise(row(x, None, "DELETE")))
        added = F.transform(F.filter(news, lambda y, i: i >= F.size(olds)), lambda y: row(None, y, "ADDED"))
    return Value(F.concat(kept, added), T.ArrayType(full))


# -- evaluation


def _wrap(path: list[Component], current: Value, scope: Scope, leaf: Callable[[Value, Scope], Column]) -> Column:
    """The value of path[0] with leaf applied at the end of the path."""
    if len(path) == 1:
        return leaf(current, scope)
    inner_name = path[1].name
    if isinstance(path[0], SubEntityItems):
        def one(x: Column) -> Column:
            item = Value(x, current.dtype.elementType)
            inner = scope.inner(fields=_members(item))
            return x.withField(inner_name, _wrap(path[1:], member(item, inner_name, inner_name), inner, leaf))

        return F.transform(current.col, one)
    inner = scope.inner(fields=_members(current))
    return F.when(current.col.isNotNull(), current.col.withField(inner_name, _wrap(path[1:], inner.fields[inner_name], inner, leaf)))


def _evaluations(parts: tuple[Component, ...], above: list[Component], gates: tuple[str, ...] = ()):
    """(path, cleaner) in the order of the tree; evaluations for children come after the children."""
    for c in parts:
        path = [*above, c]
        level = isinstance(c, (SubEntity, SubEntityItems))
        if isinstance(c, Field):
            for x in c.cleaners:
                if isinstance(x, (FieldEvaluation, Default)):
                    yield path, x, gates
        inner = (*gates, c.name) if isinstance(c, BooleanField) else () if level else gates
        yield from _evaluations(c.parts, path if level else above, inner)
        names = {p.name: p for p, _ in flat(c.parts)}
        for x in c.cleaners:
            if isinstance(x, (ChildrenEvaluation, ItemsEvaluation)):
                if x.child not in names:
                    raise SetupNameError(f"{c.name} has no child {x.child}")
                yield [*(path if level else above), names[x.child]], x, gates


def _gate(gates: tuple[str, ...], init: Value) -> Column | None:
    return _all([truth(member(init, g, g)) for g in gates])


def _traced(entity: Entity, name: str, step: int, phase: str, v: Value) -> Column:
    return F.struct(F.lit(f"{entity.name}::{name}").alias("key_string"), F.lit(step).alias("step"), F.lit(phase).alias("phase"), _text(v).alias("value"))


def _first_values(df: DataFrame, entity: Entity, kinds: dict[str, T.DataType]) -> DataFrame:
    """df with the stored values of all fields, and those that the overlay changed, as the first entries of the history."""
    rows = []
    for k, kind in kinds.items():
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            continue  # items have their change log
        stored, now = Value(F.col(INIT).getField(k), kind), Value(F.col(k), kind)
        rows += [_traced(entity, k, 0, "stored", stored), F.when(~stored.col.eqNullSafe(now.col), _traced(entity, k, 1, "overlay", now))]
    return df.withColumn(TRACE, F.filter(F.array(*rows), lambda e: e.isNotNull()).cast(f"array<{HISTORY}>") if rows else _empty(HISTORY))


def _evaluate(df: DataFrame, entity: Entity, root: Callable[[DataFrame], Scope], settings: Settings, only: str | None) -> DataFrame:
    for step, (path, x, gates) in enumerate(_evaluations(entity.contains, []), 2):
        if only and only not in [p.name for p in path]:
            continue
        scope = root(df)
        top = path[0]
        field_type = dtype_of(path[-1])

        def leaf(current: Value, inner: Scope, x=x, gates=gates, path=path, field_type=field_type) -> Column:
            this = {"Value": current}
            item = None
            if isinstance(x, (ItemsEvaluation, ChildrenEvaluation)):
                item = _struct(inner.fields)
            at = Scope(**{**inner.__dict__, "this": {**inner.this, **this}, "item": item or inner.item})
            value = adapt(compile_expr(x.value, at), current.dtype)
            if isinstance(x, Default):
                new = value if settings.default_mode == "overwrite" else F.coalesce(current.col, value)
            else:
                available = compile_expr(x.available, at)
                new = F.when(truth(available), value).otherwise(current.col)
            if gates:
                init = Value(F.col(INIT), df.schema[INIT].dataType) if len(path) == 1 else None
                if init is not None:
                    new = F.when(_gate(gates, init), new).otherwise(current.col)
                else:
                    new = F.when(_all([truth(inner.fields[g]) for g in gates]), new).otherwise(current.col)
            return new

        new = _wrap(path, scope.fields[top.name], scope, leaf)
        if settings.trace:
            before, kind = scope.fields[top.name], scope.fields[top.name].dtype
            df = df.withColumn("__new", new)
            entry = _traced(entity, "::".join(p.name for p in path), step, type(x).__name__, Value(F.col("__new"), kind))
            df = df.withColumn(TRACE, F.when(before.col.eqNullSafe(F.col("__new")), F.col(TRACE)).otherwise(F.concat(TRACE, F.array(entry.cast(HISTORY))))).withColumn(top.name, F.col("__new")).drop("__new")
        else:
            df = df.withColumn(top.name, new)
    return df


# -- validation


def _message(x: Validation, default: str) -> str:
    return x.error or default


def _passes(c: Component, x: Validation, v: Value | None, scope: Scope, init: Value | None, settings: Settings) -> tuple[Column, str]:
    """(condition, default message) of a rule."""
    of = lambda e: compile_expr(e, scope)
    if isinstance(x, Required):
        return v.col.isNotNull(), "The value is required"
    if isinstance(x, Readonly):
        first = member(init, c.name, c.name).col if init is not None else v.col
        return ~truth(of(x.value)) | first.eqNullSafe(v.col), "The value is read-only"
    if isinstance(x, MinValue):
        return v.col.isNull() | (v.col >= of(x.value).col), f"The value is below {_shown(x.value)}"
    if isinstance(x, HourFieldValidation):
        return v.col.between(0, 23), "An hour lies between 0 and 23"
    if isinstance(x, (ExactLength, MaxLength, MinLength, RangeLength)):
        size = F.size(v.col) if isinstance(v.dtype, (T.ArrayType, T.MapType)) else F.length(v.col)
        if isinstance(x, RangeLength):
            ok, words = F.lit(True), []
            if x.min:
                ok, _ = ok & (size >= of(x.min).col), words.append(f"at least {_shown(x.min)}")
            if x.max:
                ok, _ = ok & (size <= of(x.max).col), words.append(f"at most {_shown(x.max)}")
            return ~truth(v) | ok, f"The length is {' and '.join(words)}"
        n = of(x.value).col
        test, word = {ExactLength: (size == n, "exactly"), MaxLength: (size <= n, "at most"), MinLength: (size >= n, "at least")}[type(x)]
        return ~truth(v) | test, f"The length is {word} {_shown(x.value)}"
    if isinstance(x, _Range):
        size = F.coalesce(F.size(v.col), F.lit(0))
        ok = F.lit(True)
        if x.min is not None:
            ok = ok & (size >= x.min)
        if x.max is not None:
            ok = ok & (size <= x.max)
        return ok, f"The number of items lies between {x.min or 0} and {'any' if x.max is None else x.max}"
    if isinstance(x, _Multi):
        return F.lit(x.allow_none) | (F.coalesce(F.size(v.col), F.lit(0)) > 0), "At least one item is required"
    if isinstance(x, _UniqueItems):
        keys = F.transform(v.col, lambda i: F.struct(*[i.getField(f).alias(f) for f in x.fields]))
        if x.ignore_none:
            keys = F.filter(keys, lambda k: reduce(lambda a, b: a & b, [k.getField(f).isNotNull() for f in x.fields]))
        return v.col.isNull() | (F.size(F.array_distinct(keys)) == F.size(keys)), f"Items are unique by {', '.join(x.fields)}"
    if isinstance(x, SingleValidation):
        return F.lit(x.allow_none) | v.col.isNotNull(), "The part is required"
    return truth(of(x.ensure)), "The rule is broken"


def _shown(value: Any) -> str:
    return value.to_source() if isinstance(value, Expr) else str(value)


def _error(key: Column, x: Validation, message: str, details: Column) -> Column:
    return F.struct(key.alias("key_string"), F.lit(message).alias("error"), F.lit(x.rule.lstrip("_")).alias("validation_name"), F.lit(x.title).cast("string").alias("validation_title"), details.cast("string").alias("details"))


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _rules(c: Component, v: Value | None, this: dict[str, Value], scope: Scope, init: Value | None, key: Column, gate: Column | None, settings: Settings, item: Value | None = None) -> list[Column]:
    out = []
    rules = [x for x in c.cleaners if isinstance(x, Validation) and not isinstance(x, _UniqueGlobal)]
    if isinstance(c, (ChoiceField, EnumField)) and settings.strict_choices and c.values:
        rules.append(Validation(True, name="Choices"))
    at = Scope(**{**scope.__dict__, "this": {**scope.this, **this}, "item": item or scope.item})
    for x in rules:
        if x.rule == "Choices":
            ok, text = v.col.isNull() | v.col.isin(*c.values), "The value is no choice"
        else:
            ok, text = _passes(c, x, v, at, init, settings)
        ok = F.coalesce(ok, F.lit(False))
        if x.gated and x.available is not True:
            if x.available is False:
                continue
            ok = ~truth(compile_expr(x.available, at)) | ok
        if gate is not None:
            ok = ~gate | ok
        # what the value was, for single values
        details = v.col if v is not None and not isinstance(v.dtype, (T.StructType, T.ArrayType, T.MapType)) else F.lit(None)
        out.append(F.when(~ok, _error(key, x, _message(x, text), details)))
    if c.__class__.__name__ == "EmailField" and settings.strict_email:
        x = Validation(True, name="Email")
        out.append(F.when(~F.coalesce(v.col.isNull() | v.col.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), F.lit(False)), _error(key, x, "The value is no email address", v.col)))
    return out


def _errors(parts: tuple[Component, ...], scope: Scope, init: Value, prefix: Column, settings: Settings, only: str | None, inside: bool) -> list[Column]:
    """Arrays of failures of one level, in order."""
    out: list[Column] = []
    single: list[Column] = []

    def walk(parts: tuple[Component, ...], gates: tuple[str, ...], inside: bool) -> None:
        for c in parts:
            here = inside or c.name == only
            key = F.concat(prefix, F.lit(f"::{c.name}"))
            gate = _gate(gates, init)
            if isinstance(c, (SubEntity, SubEntityItems)):
                v = scope.fields[c.name]
                if isinstance(c, SubEntity):
                    inner = scope.inner(fields=_members(v))
                    nested = _errors(c.contains, inner, member(init, c.name, c.name), key, settings, only, here)
                    if nested:
                        out.append(F.when(v.col.isNotNull() & (gate if gate is not None else F.lit(True)), F.concat(*nested)).otherwise(_empty(ERROR)))
                    if here:
                        single.extend(_rules(c, v, {"Value": v, **_members(v), "Children": _kids(c, _members(v))}, inner, init, key, gate, settings, v))
                else:
                    out.append(_items_errors(c, v, scope, key, gate, settings, only, here))
                    if here:
                        single.extend(_rules(c, v, {"Value": v, "Items": v}, scope, init, key, gate, settings))
            elif isinstance(c, Field):
                v = scope.fields[c.name]
                if here:
                    shown = {"Value": v}
                    if c.parts:
                        shown |= {p.name: scope.fields[p.name] for p, _ in flat(c.parts) if p.name in scope.fields}
                        shown["Children"] = _kids(c, scope.fields)
                    single.extend(_rules(c, v, shown, scope, init, key, gate, settings))
                if c.parts:
                    walk(c.parts, (*gates, c.name), here)
            else:
                walk(c.parts, gates, here)
                if here:
                    shown = {p.name: scope.fields[p.name] for p, _ in flat(c.parts) if p.name in scope.fields}
                    single.extend(_rules(c, None, {**shown, "Children": _kids(c, scope.fields)}, scope, init, key, gate, settings))

    walk(parts, (), inside)
    if single:
        out.insert(0, F.filter(F.array(*single), lambda e: e.isNotNull()))
    return out


def _kids(c: Component, fields: dict[str, Value]) -> Value:
    """The children of a component as a list, of their type if they share one, else as texts."""
    got = [fields[p.name] for p, _ in flat(c.parts) if isinstance(p, Field) and p.name in fields]
    if not got:
        return Value(_empty("string"), T.ArrayType(T.StringType()))
    if len({v.dtype.simpleString() for v in got}) == 1:
        return Value(F.array(*[v.col for v in got]), T.ArrayType(got[0].dtype))
    return Value(F.array(*[v.col.cast("string") for v in got]), T.ArrayType(T.StringType()))


def _item_key(c: SubEntityItems, x: Column, i: Column, key: Column) -> Column:
    if c.keys:
        parts = [F.concat(F.lit(f"{k}="), F.coalesce(x.getField(k).cast("string"), F.concat(F.lit("_MK_"), i.cast("string")))) for k in c.keys.names]
        return F.concat(key, F.lit("["), F.concat_ws("::", *parts), F.lit("]"))
    return F.concat(key, F.lit("["), i.cast("string"), F.lit("]"))


def _items_errors(c: SubEntityItems, v: Value, scope: Scope, key: Column, gate: Column | None, settings: Settings, only: str | None, inside: bool) -> Column:
    empty: list[bool] = []

    def one(x: Column, i: Column) -> Column:
        item = Value(x, v.dtype.elementType)
        inner = scope.inner(fields=_members(item))
        first = member(item, INIT, INIT) if _marked(v) else item  # items that nothing changes are their first values
        nested = _errors(c.contains, inner, first, _item_key(c, x, i, key), settings, only, inside)
        empty.append(not nested)
        return F.concat(*nested) if nested else _empty(ERROR)

    col = F.flatten(F.transform(F.coalesce(v.col, F.array().cast(v.dtype)), one))
    if empty and empty[0]:
        return _empty(ERROR)
    return col if gate is None else F.when(gate, col).otherwise(_empty(ERROR))


# -- changes


def _changes(parts: tuple[Component, ...], now: dict[str, Value], init: Value, prefix: Column) -> list[Column]:
    out, single = [], []
    for c, _ in flat(parts):
        key = F.concat(prefix, F.lit(f"::{c.name}"))
        if isinstance(c, SubEntityItems):
            v = now[c.name]
            if not _marked(v):
                continue

            def one(x: Column, i: Column) -> Column:  # noqa: B023 - called at once
                item = Value(x, v.dtype.elementType)
                k = _item_key(c, x, i, key)
                inner = _changes(c.contains, _members(item), member(item, INIT, INIT), k)
                whole = F.array(_change(k, x.getField(OP), F.lit(None), F.lit(None)))
                updated = F.concat(*inner) if inner else _empty(CHANGE)
                return F.when(x.getField(OP).isin("ADDED", "DELETE"), whole).otherwise(updated)

            out.append(F.flatten(F.transform(F.coalesce(v.col, F.array().cast(v.dtype)), one)))
        elif isinstance(c, SubEntity):
            v = now[c.name]
            nested = _changes(c.contains, _members(v), member(init, c.name, c.name), key)
            if nested:
                out.append(F.concat(*nested))
        elif isinstance(c, Field):
            v, first = now[c.name], member(init, c.name, c.name)
            single.append(F.when(~first.col.eqNullSafe(v.col), _change(key, F.lit("UPDATE"), _text(first), _text(v))))
    if single:
        out.insert(0, F.filter(F.array(*single), lambda e: e.isNotNull()))
    return out


def _text(v: Value) -> Column:
    return F.to_json(v.col) if isinstance(v.dtype, (T.StructType, T.ArrayType, T.MapType)) else v.col.cast("string")


def _change(key: Column, op: Column, a: Column, b: Column) -> Column:
    return F.struct(key.alias("key_string"), op.alias("change_op"), a.cast("string").alias("init_value"), b.cast("string").alias("value"))


# -- apply


def _source(df: DataFrame, prefix: str | None = None) -> Value:
    if prefix:
        return Value(F.col(prefix), df.schema[prefix].dataType)
    return Value(F.struct(*[F.col(f"`{c}`") for c in df.columns]), df.schema)


def apply(entity: Entity, df: DataFrame | None, new: DataFrame | None = None, *, settings: Settings | None = None, only: str | None = None, missing: str = "keep", validate: bool = True) -> ApplyFrame:
    """Apply ``entity`` to ``df``, or to df overlaid with the rows of ``new`` by the keys of the entity.

    new: its columns, by stored names or by field names, replace those of matching rows, null too; absent columns keep their values, and an
    optional ``_present`` array of names says per row which columns are meant.  Rows of new without a match are ADDED; rows of df without
    one stay, or are DELETE with missing="delete".  df None: all rows are new.  only: the name of a component to which cleaners are limited.
    """
    setting = entity.settings.merged(settings)
    context = setting.context()
    keys = entity.keys.names if entity.keys else ()
    if only and only not in _names(entity.contains):
        raise SetupNameError(f"no component {only}")
    bad: list[tuple[str, Column]] = []
    if new is None:
        values = bind(entity.contains, _source(df), "stored", bad)
        moved = {path[0].name for path, _, _ in _evaluations(entity.contains, [])}
        values = _mark(tuple(c for c, _ in flat(entity.contains) if c.name in moved), values, F.lit(None))
        state = df.select(*[v.col.alias(k) for k, v in values.items()], F.lit(None).cast("string").alias(OP), _bad(bad, entity).alias("__bad"))
    else:
        state, values = _overlay(entity, df, new, keys, missing)
    names = list(values)
    kinds = {k: v.dtype for k, v in values.items()}
    first = F.col(INIT) if INIT in state.columns else F.struct(*[F.col(k) for k in names])
    state = state.withColumn(INIT, first)

    def root(at: DataFrame) -> Scope:
        fields = {k: Value(F.col(k), kinds[k]) for k in names}
        return Scope(fields, context=context, functions=setting.functions, strict=setting.strict, this={})

    if setting.trace:
        state = _first_values(state, entity, kinds)
    state = _evaluate(state, entity, root, setting, only)
    scope, init = root(state), Value(F.col(INIT), state.schema[INIT].dataType)
    prefix = F.lit(entity.name)
    failures = [_empty(ERROR)]
    if validate:
        failures += _errors(entity.contains, scope, init, prefix, setting, only, only is None)
        if only is None:
            own = _rules(entity, None, {**scope.fields, "Children": _kids(entity, scope.fields)}, scope, init, prefix, None, setting)
            failures += [F.filter(F.array(*own), lambda e: e.isNotNull())] if own else []
            failures.append(F.col("__bad"))
    changes = [_empty(CHANGE), *_changes(entity.contains, scope.fields, init, prefix)]
    whole = F.array(_change(prefix, F.col(OP), F.lit(None), F.lit(None)))
    out = state.withColumns({"_errors": F.concat(*failures).cast(f"array<{ERROR}>"), "_changes": F.when(F.col(OP).isin("ADDED", "DELETE"), whole).otherwise(F.concat(*changes)).cast(f"array<{CHANGE}>")})
    if validate and only is None:
        out = _unique_global(out, entity, keys)
    shown = [_strip(c, Value(F.col(c.name), kinds[c.name])).alias(c.name) for c, _ in flat(entity.contains) if c.name in kinds]
    out = out.select(*shown, F.col(OP).alias("_op"), "_errors", "_changes", (F.size("_errors") == 0).alias("_ok"), *([F.col(TRACE).alias("_history")] if setting.trace else []))
    return ApplyFrame(out, tuple(keys))


def _names(parts: tuple[Component, ...]) -> set[str]:
    return {c.name for c in parts} | {n for c in parts for n in _names(c.parts)}


def _strip(c: Component, v: Value) -> Column:
    if isinstance(c, SubEntityItems) and _marked(v):
        return F.transform(v.col, lambda x: x.dropFields(INIT, OP))
    return v.col


def _bad(bad: list[tuple[str, Column]], entity: Entity) -> Column:
    rows = [F.when(flag, _error(F.lit(f"{entity.name}::{name}"), Validation(True, name="Type"), "The value is of another type", F.lit(None))) for name, flag in bad]
    return F.filter(F.array(*rows), lambda e: e.isNotNull()).cast(f"array<{ERROR}>") if rows else _empty(ERROR)


def _overlay(entity: Entity, df: DataFrame | None, new: DataFrame, keys: tuple[str, ...], missing: str) -> tuple[DataFrame, dict[str, Value]]:
    if not keys:
        raise ApplyError(f"{entity.name} needs keys to match new rows")
    stored = {c.path[0] for c, _ in flat(entity.contains) if isinstance(c, (Field, SubEntity, SubEntityItems))}
    fields = {c.name for c, _ in flat(entity.contains) if isinstance(c, (Field, SubEntity, SubEntityItems))}
    given = set(new.columns) - {"_present"}
    mode = "entity" if given <= fields else "stored" if given <= stored else None
    if mode is None:
        raise ApplyError(f"new has columns that are neither fields nor stored names: {sorted(given - fields - stored)}")
    by_name = {c.name: c for c, _ in flat(entity.contains)}
    old_df = df if df is not None else new.sparkSession.createDataFrame([], _stored_schema(entity, new, mode))
    old_values = bind(entity.contains, _source(old_df))
    patch = bind(tuple(c for c in entity.contains), _source(new), "entity") if mode == "entity" else _bind_present(entity, new)
    for k in keys:
        if k not in patch:
            raise ApplyError(f"new has no key {k}")
    left = old_df.select(_struct(old_values).col.alias("__o"), *[old_values[k].col.alias(f"__ok_{k}") for k in keys])
    present = [F.col("_present").alias("__present")] if "_present" in new.columns else []
    right = new.select(_struct(patch).col.alias("__n"), *[patch[k].col.alias(f"__nk_{k}") for k in keys], *present)
    old_keys, new_keys = tuple(f"__ok_{k}" for k in keys), tuple(f"__nk_{k}" for k in keys)
    on = reduce(lambda a, b: a & b, [F.col(a) == F.col(b) for a, b in zip(old_keys, new_keys, strict=True)])
    matched = unique_by(left, old_keys, f"stored {entity.name}").join(unique_by(right.where(~any_null(new_keys)), new_keys, f"new {entity.name}"), on, "full_outer")
    # a null key in new never matches, so those rows are added, without a shuffle
    joined = matched.unionByName(right.where(any_null(new_keys)), allowMissingColumns=True)
    has_old, has_new = F.col("__o").isNotNull(), F.col("__n").isNotNull()
    op = F.when(~has_old, "ADDED").when(has_old & has_new, "UPDATE").otherwise(F.lit("DELETE" if missing == "delete" else None))
    out: dict[str, Value] = {}
    for name, v in old_values.items():
        o = Value(F.col("__o").getField(name), v.dtype)
        c = by_name[name]
        if name in patch:
            n = Value(F.col("__n").getField(name), patch[name].dtype)
            use = has_new & F.array_contains("__present", name) if present else has_new
            if isinstance(c, SubEntityItems):
                merged = _merge_items(c, o, n)
                plain = _mark((c,), {name: o}, F.lit(None))[name]
                out[name] = Value(F.when(use, merged.col).otherwise(plain.col), merged.dtype)
                continue
            out[name] = Value(F.when(use | ~has_old, n.col.cast(v.dtype)).otherwise(o.col), v.dtype)
        else:
            out[name] = _mark((c,), {name: o}, F.lit(None)).get(name, o)
    first = F.struct(*[F.col("__o").getField(k).alias(k) for k in old_values])
    state = joined.select(*[v.col.alias(k) for k, v in out.items()], op.alias(OP), first.alias(INIT), _empty(ERROR).alias("__bad"))
    return state, out


def _bind_present(entity: Entity, new: DataFrame) -> dict[str, Value]:
    have = set(new.columns)
    parts = tuple(c for c, _ in flat(entity.contains) if isinstance(c, (Field, SubEntity, SubEntityItems)) and c.path[0] in have)
    return bind(parts, _source(new), "stored")


def _stored_schema(entity: Entity, new: DataFrame, mode: str) -> T.StructType:
    if mode == "stored":
        return new.drop("_present").schema
    if any(c.path != (c.name,) for c, _ in flat(entity.contains)):
        raise ApplyError("rows by field names need fields that bind to their own names where there are no stored rows")
    known = schema_of(entity.contains)
    return T.StructType([T.StructField(f.name, new.schema[f.name].dataType if f.name in new.columns else f.dataType) for f in known])


def _unique_global(df: DataFrame, entity: Entity, keys: tuple[str, ...]) -> DataFrame:
    """Failures of Unique.Global: keys of items that occur more than once in all rows.  Counts are summed in each task before they
    move; only the failing keys are joined back."""
    for c, _ in flat(entity.contains):
        for x in c.cleaners if isinstance(c, SubEntityItems) else ():
            if not isinstance(x, _UniqueGlobal):
                continue
            if not keys:
                raise ApplyError(f"Unique.Global on {c.name} needs keys on {entity.name}")
            items = df.select(*keys, F.posexplode(c.name).alias("__i", "__x")).select(*keys, "__i", *[F.col("__x").getField(f).alias(f"__f_{f}") for f in x.fields])
            cols = [f"__f_{f}" for f in x.fields]
            if x.ignore_none:
                items = items.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in cols]))
            twice = items.groupBy(*cols).agg(F.count("*").alias("__n")).where("__n > 1").select(*[F.col(k).alias(f"{k}_t") for k in cols])
            hit = items.join(twice, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_t")) for k in cols]), "left_semi")
            key = F.concat(F.lit(f"{entity.name}::{c.name}["), F.col("__i").cast("string"), F.lit("]"))
            failed = hit.groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys]).agg(F.array_sort(F.collect_list(_error(key, x, _message(x, f"Items are unique by {', '.join(x.fields)} over all rows"), F.lit(None)))).alias("__more"))
            df = df.join(failed, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]), "left")
            df = df.withColumn("_errors", F.concat("_errors", F.coalesce("__more", _empty(ERROR)))).drop("__more", *[f"__k_{k}" for k in keys])
    return df


def dump_defaults(entity: Entity, spark: SparkSession, settings: Settings | None = None) -> dict[str, Any]:
    """What evaluations give for a row of nulls; validations are off."""
    plain = tuple(_unbound(c) for c in entity.contains)
    whole = Entity(entity.name, contains=plain, settings=entity.settings)
    row = spark.createDataFrame([tuple([None] * len(schema_of(plain)))], schema_of(plain))
    out = apply(whole, row, settings=settings, validate=False).df.drop("_op", "_errors", "_changes", "_ok").first()
    return out.asDict(recursive=True)


def _unbound(c: Component) -> Component:
    from dataclasses import replace

    more: dict[str, Any] = {"bind_to": None}
    if isinstance(c, BooleanField):
        more["enables"] = tuple(_unbound(p) for p in c.enables)
    elif isinstance(c, FieldGroup):
        more["contains"] = tuple(_unbound(p) for p in c.contains)
    return replace(c, **more)


