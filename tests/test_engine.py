"""Semantics of expressions, definitions and apply on tiny frames."""

import dataclasses
import datetime
import decimal
import enum
import random
from typing import Optional

import pytest
from pyspark.sql import functions as SF
from pyspark.sql import types as T

from veldspar import (
    ApplyError, BooleanField, Cardinality, ChoiceField, ChoiceOption, Ctx, DateField, DecimalField, Default, EmailField, Entity, EnumField, ExactLength, F, FieldEvaluation, FieldGroup, FieldValidation, FloatField,
    IdField, IntegerField, ItemsValidation, Just, KeyFields, LoadError, M, MaxLength, PositiveIntegerField, RangeLength, Readonly, Required, Settings, SetupError, SetupNameError, SetupTypeError,
    SizedStringField, StringField, SubEntity, SubEntityItems, This, Unique, parse,
)
from veldspar.functions.builtin import EnumMembers, Value
from veldspar.functions.registry import Function, FunctionByMethod
from veldspar.meta import codegen
from veldspar.meta.io import dump, load, schema_diff, to_json, to_yaml
from veldspar.operators.diff import diff, duplicate_keys
from veldspar.plans.compiler import Scope, compile_expr
from veldspar.streaming import apply_stream
from veldspar.types import compatible, struct_of


def rows(df):
    return [tuple(r) for r in df.collect()]


OPERANDS = [None, 0, 1, -7, 2, "", "1", "a", True, False, 2.5, -0.5]


def python(op, a, b):
    if isinstance(a, str) and isinstance(b, int) and not isinstance(b, bool) and op != "*":
        b = str(b)
    try:
        return {
            "==": lambda: a == b, "!=": lambda: a != b, ">": lambda: a > b, ">=": lambda: a >= b, "<": lambda: a < b, "<=": lambda: a <= b, "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b,
            "/": lambda: a / b, "//": lambda: a // b, "&": lambda: bool(a) and bool(b), "|": lambda: bool(a) or bool(b),
        }[op]()
    except (TypeError, ZeroDivisionError):
        return None


def test_operators_follow_python(spark):
    from veldspar.expr import Op, wrap

    kinds = {str: "string", int: "long", bool: "boolean", float: "double"}
    cells, want = [], []
    for op in ["==", "!=", ">", ">=", "<", "<=", "+", "-", "*", "/", "//", "&", "|"]:
        for a in OPERANDS:
            for b in OPERANDS:
                if bool in (type(a), type(b)) and op not in "&|==!=":
                    continue
                kind = kinds.get(type(a)) or kinds.get(type(b)) or "long"
                fields = {n: Value(SF.lit(v).cast(kinds.get(type(v), kind)), T._parse_datatype_string(kinds.get(type(v), kind))) for n, v in (("a", a), ("b", b))}
                try:
                    got = compile_expr(Op(op, wrap(F.a), wrap(F.b)), Scope(fields))
                except SetupTypeError:
                    continue
                cells.append(got.col.alias(f"c{len(cells)}"))
                want.append((op, a, b, python(op, a, b)))
    assert len(cells) > 700
    for i in range(0, len(cells), 200):
        got = spark.range(1).select(*cells[i : i + 200]).first()
        for g, (op, a, b, w) in zip(got, want[i : i + 200], strict=True):
            assert g == w, (op, a, b, w, g)


def test_substring_is_a_python_slice(spark):
    rng = random.Random(5)
    text = "ab\U0001f600cdé"
    data = [(text[: rng.randint(0, 6)], rng.choice([None, *range(-8, 9)]), rng.choice([None, *range(-8, 9)])) for _ in range(400)]
    df = spark.createDataFrame(data, "x string, s int, e int")
    kinds = {n: Value(SF.col(n), df.schema[n].dataType) for n in df.columns}
    out = df.select("*", compile_expr(F.x.Substring(F.s, F.e), Scope(kinds)).col.alias("y")).collect()
    assert all(r.y == r.x[slice(r.s, r.e)] for r in out)


def test_text_round_trip():
    for e in [F.a.b > 3, (F.a == "x") & ~(F.b + 1 < F.c // 2), F.items.Filter(This.q > 25).Count() <= 4, Ctx.Length(F.a), F.s.contains("x"), F.items.First().q + 1, Just(decimal.Decimal("1.5")) * F.a, F.d < Just(datetime.date(2020, 1, 2)), F.a.is_in(1, 2)]:
        assert parse(e.to_source()).same_as(e)
    for bad in ["__import__('os')", "F.a if F.b else 1", "[1]", "F.a < F.b < 3", "x.y", "F.a +"]:
        with pytest.raises(LoadError):
            parse(bad)
    with pytest.raises(TypeError):
        bool(F.a == 1)


def test_setup_errors():
    with pytest.raises(SetupNameError):
        Entity("e", contains=[IntegerField("a"), StringField("a")])
    with pytest.raises(SetupNameError):
        Entity("e", contains=[IntegerField("a")], keys=KeyFields("b"))
    with pytest.raises(SetupError):
        Entity("e", contains=[IntegerField("a", cleaners=[FieldValidation(M.a > 1)])])
    with pytest.raises(SetupError):
        SizedStringField("a")
    with pytest.raises(SetupError):
        IntegerField("a", cleaners=[ItemsValidation(This.Items.Count() > 1)])
    with pytest.raises(SetupError):
        IntegerField("a", autocomputed=True)
    with pytest.raises(SetupError):
        Cardinality.Range(min=0, max=1)
    with pytest.raises(SetupError):
        RangeLength()
    with pytest.raises(SetupError):
        StringField("a", bind_to="a.b.c.d.e").path
    with pytest.raises(dataclasses.FrozenInstanceError):
        IntegerField("a").name = "b"


def test_binding_errors(spark):
    df = spark.createDataFrame([(1, [(1,)])], "a long, xs array<struct<q:long>>")
    for bad, kind in [(F.nope > 1, SetupNameError), (F.a.Upper() == "x", SetupTypeError), (F.a.Nope(), SetupNameError), (F.a + "x", SetupTypeError), (F.a > "x", SetupTypeError), (Ctx.none, SetupNameError), (F.xs.q, SetupTypeError)]:
        with pytest.raises(kind):
            Entity("e", contains=[IntegerField("a", cleaners=[FieldValidation(bad)]), SubEntityItems("xs", contains=[IntegerField("q")])]).apply(df)


PERSON = Entity(
    "person",
    contains=[
        IdField("id"), StringField("name", cleaners=[Required(), MaxLength(4)]), BooleanField("active", enables=[PositiveIntegerField("age")]),
        SubEntity("access", contains=[BooleanField("alive"), StringField("level", cleaners=[Default("low")])]),
        SubEntityItems("addresses", keys=KeyFields("n"), contains=[IdField("n"), StringField("city", cleaners=[FieldValidation(This.Value != F.name, error="same as name")])], cleaners=[Unique.Items(fields=("city",))]),
    ],
    keys=KeyFields("id"),
)
SCHEMA = "id long, name string, active boolean, age long, access struct<alive:boolean,level:string>, addresses array<struct<n:long,city:string>>"


def test_nested_apply(spark):
    data = [
        (1, "Ann", True, 0, (True, None), [(1, "Rome"), (2, "Rome")]),
        (2, "Bob", False, -3, None, [(1, "Bob"), (None, "x")]),
        (3, None, None, None, (False, "high"), None),
        (4, "Longer", True, 5, (True, "x"), []),
    ]
    out = PERSON.apply(spark.createDataFrame(data, SCHEMA))
    got = {(r.id, r.key_string, r.validation_name) for r in out.errors.collect()}
    assert got == {
        (1, "person::age", "MinValue"), (1, "person::addresses", "UniqueItems"), (2, "person::addresses[n=1]::city", "FieldValidation"), (3, "person::name", "Required"), (4, "person::name", "MaxLength"),
    }
    assert {(r.id, r.key_string, r.change_op, r.init_value, r.value) for r in out.changes.collect()} == {(1, "person::access::level", "UPDATE", None, "low")}
    again = PERSON.apply(out.df.drop("_op", "_errors", "_changes", "_ok"))
    assert again.changes.count() == 0
    assert out.df.where("_ok").count() == 0
    assert PERSON.apply(spark.createDataFrame([], SCHEMA)).errors.count() == 0


def test_overlay_of_items_and_patch(spark):
    old = spark.createDataFrame([(1, "Ann", True, 3, (True, "a"), [(1, "Rome"), (2, "Bonn")]), (2, "Bob", True, 3, None, [])], SCHEMA)
    new = spark.createDataFrame([(1, None, [(2, "Bern"), (3, "Oslo")]), (9, "New", [])], "id long, name string, addresses array<struct<n:long,city:string>>")
    out = PERSON.apply(old, new, missing="delete")
    by = {(r.id, r.key_string): (r.change_op, r.init_value, r.value) for r in out.changes.collect()}
    assert by == {
        (1, "person::name"): ("UPDATE", "Ann", None), (1, "person::addresses[n=1]"): ("DELETE", None, None), (1, "person::addresses[n=2]::city"): ("UPDATE", "Bonn", "Bern"),
        (1, "person::addresses[n=3]"): ("ADDED", None, None), (2, "person"): ("DELETE", None, None), (9, "person"): ("ADDED", None, None),
    }
    one = out.df.where("id = 1").first()
    assert one.age == 3 and one.name is None  # absent keeps, null overwrites
    twice = spark.createDataFrame([(1, [(2, "a"), (2, "b")])], "id long, addresses array<struct<n:long,city:string>>")
    with pytest.raises(Exception, match="key twice"):
        PERSON.apply(old, twice).df.collect()


def test_diff_properties(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k long, v string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (4, "w"), (None, "q")], "k long, v string")
    assert diff(a, a, ("k",)).count() == 0
    fwd = {(r.k, r.change_op) for r in diff(a, b, ("k",)).collect()}
    assert fwd == {(2, "UPDATE"), (3, "DELETE"), (4, "ADDED"), (None, "ADDED")}
    assert {k for k, op in fwd if op == "ADDED" and k} == {r.k for r in diff(b.where("k IS NOT NULL"), a, ("k",)).collect() if r.change_op == "DELETE"}
    assert duplicate_keys(a.union(a), ("k",)).count() == 3
    with pytest.raises(Exception, match="no key"):
        diff(b, a, ("k",)).collect()


class Colour(enum.Enum):
    RED = "r"
    BLUE = "b"


def test_types_settings_choices_functions(spark):
    e = Entity(
        "t",
        contains=[
            IntegerField("a"), ChoiceField("c", choices=(ChoiceOption("x"), ChoiceOption("y"))), EnumField("colour", enum=Colour), EmailField("mail"),
            StringField("flag"), DecimalField("d", precision=10, scale=2, cleaners=[FieldEvaluation(This.Value * 2)]), DateField("day", cleaners=[Readonly()]),
            IntegerField("n", bind_to="a", cleaners=[FieldEvaluation(Ctx.Colours().Count() + Ctx.base + F.a.Twice())]),
        ],
        keys=KeyFields("a"), settings=Settings(values={"base": 10}, functions={"Colours": EnumMembers(Colour), "Twice": Function(lambda x: x * 2 if x else None, returns=T.LongType())}),
    )
    df = spark.createDataFrame([("1", "x", "r", "a@b.c", True, decimal.Decimal("1.25"), datetime.date(2020, 1, 1)), ("bad", "q", "g", "nope", False, None, None)], "a string, c string, colour string, mail string, flag boolean, d decimal(10,2), day date")
    out = e.apply(df, settings=Settings(values={"base": 100}, strict_choices=True, strict_email=True))
    good, bad = sorted(out.df.collect(), key=lambda r: r.a is None)
    assert (good.flag, good.d, good.n) == ("True", decimal.Decimal("2.50"), 104) and good._ok
    assert {x.validation_name for x in bad._errors} == {"Type", "Choices", "Email"}

    class Tools:
        def shout(self, x: str) -> str:
            return x.upper()

    s = Settings(functions={"Shout": FunctionByMethod(Tools(), "shout")})
    got = Entity("t", contains=[StringField("c", cleaners=[FieldEvaluation(This.Value.Shout())])]).apply(df, settings=s).df.first()
    assert got.c == "X"
    with pytest.raises(SetupTypeError):
        Entity("t", contains=[DecimalField("d", cleaners=[FieldEvaluation(F.d.Shout())])]).apply(df, settings=s)


def test_metadata(spark):
    again = load(dump(PERSON))
    assert to_json(again) == to_json(PERSON) and load(to_json(PERSON)).name == "person"
    assert "DEXP::" in to_yaml(PERSON)
    with pytest.raises(LoadError):
        load({"type": "os.system", "attrs": {}})
    assert again.dump_defaults(spark)["name"] is None
    for text in (codegen.to_dataclass(PERSON), codegen.to_dataclass(PERSON, flatten=True), codegen.to_dataclass(PERSON, depth=1)):
        scope: dict = {"__name__": __name__}
        exec(compile(text, "generated", "exec"), scope)  # noqa: S102 - our own text
    compile(codegen.to_pydantic(PERSON), "generated", "exec")
    assert "addresses array<struct<n:bigint,city:string>>" in codegen.to_ddl(PERSON)

    @dataclasses.dataclass
    class Model:
        id: int
        name: Optional[str]
        tags: list[str]

    s = struct_of(Model)
    assert [f.dataType.simpleString() for f in s] == ["bigint", "string", "array<string>"] and s["name"].nullable and not s["id"].nullable
    other = T.StructType([T.StructField("id", T.StringType(), False), T.StructField("extra", T.LongType()), s["name"]])
    assert {(n, k) for n, k, _, _ in schema_diff(s, other)} == {("id", "diff"), ("name", "same"), ("tags", "source_only"), ("extra", "target_only")}
    assert compatible(T.LongType(), T.DoubleType()) and not compatible(T.StringType(), T.LongType()) and not compatible(T.LongType(), T.LongType(), True, False)
    with pytest.raises(SetupTypeError):
        from veldspar.types import of_hint

        of_hint(int | str)


def test_stream_equals_batch(spark, tmp_path):
    df = spark.range(20).select(SF.col("id").alias("k"), (SF.col("id") * 3).alias("v"))
    df.write.parquet(str(tmp_path / "in"))
    e = Entity("e", contains=[IdField("k"), FloatField("v", cleaners=[FieldValidation(This.Value > 12)])], keys=KeyFields("k"))
    q = apply_stream(e, spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).select("k", "_ok").writeStream.format("memory").queryName("applied").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    assert sorted(rows(spark.table("applied"))) == sorted(rows(e.apply(df).df.select("k", "_ok")))


def test_partial_apply_and_groups(spark):
    e = Entity("e", contains=[FieldGroup("g", contains=[IntegerField("a", cleaners=[FieldEvaluation(This.Value + 1)])]), StringField("b", cleaners=[ExactLength(2)])])
    df = spark.createDataFrame([(1, "x")], "a long, b string")
    assert [x.key_string for x in e.apply(df, only="b").df.first()._errors] == ["e::b"] and e.apply(df, only="b").df.first().a == 1
    assert e.apply(df, only="g").df.first()._ok


def test_keys_are_checked(spark):
    """A key twice on either side, or a stored row without key, fails; a new row without key is added."""
    e = Entity("e", contains=[IdField("id"), StringField("s")], keys=KeyFields("id"))
    make = lambda *data: spark.createDataFrame(list(data), "id long, s string")
    old, new = make((1, "a"), (2, "b")), make((2, "c"), (None, "d"), (None, "d"))
    assert sorted((r.s, r._op or "") for r in e.apply(old, new).df.collect()) == [("a", ""), ("c", "UPDATE"), ("d", "ADDED"), ("d", "ADDED")]
    assert sorted((r.id or 0, r.change_op) for r in diff(old, new, ("id",)).collect()) == [(0, "ADDED"), (0, "ADDED"), (1, "DELETE"), (2, "UPDATE")]
    for a, b, text in [(make((1, "a"), (1, "b")), new, "twice"), (old, make((2, "c"), (2, "d")), "twice"), (make((None, "a")), new, "no key")]:
        for run in (lambda: e.apply(a, b).df.collect(), lambda: diff(a, b, ("id",)).collect()):
            with pytest.raises(Exception, match=text):
                run()
    plan = e.apply(old, new).df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # the check of the keys uses the join's own shuffles


def test_items_by_key(spark):
    rng = random.Random(2)
    items = SubEntityItems("xs", contains=[IdField("a"), StringField("b"), IntegerField("q")], keys=KeyFields("a", "b"))
    e = Entity("e", contains=[IdField("id"), items], keys=KeyFields("id"))
    schema = "id long, xs array<struct<a:long,b:string,q:long>>"
    keys = [(a, b) for a in range(4) for b in "xyz"]
    olds = [[(*k, 1) for k in rng.sample(keys, rng.randint(0, 8))] for _ in range(60)]
    news = [[(*k, rng.randint(1, 2)) for k in rng.sample(keys, rng.randint(0, 8))] + [(None, "x", 5)] * rng.randint(0, 2) for _ in range(60)]
    rows_ = lambda xs: spark.createDataFrame(list(enumerate(xs)), schema)
    frame = e.apply(rows_(olds), rows_(news))
    for r in frame.df.collect():
        old, new = {x[:2]: x for x in olds[r.id]}, {x[:2]: x for x in news[r.id] if x[0] is not None}
        want = [new.get(k, x) for k, x in old.items()] + [x for x in news[r.id] if x[:2] not in old]
        assert [tuple(x) for x in r.xs] == want
    for a, b, text in [([[(1, "x", 1), (1, "x", 2)]], [[]], "twice"), ([[]], [[(1, "x", 1), (1, "x", 1)]], "twice"), ([[(None, "x", 1)]], [[]], "without key")]:
        with pytest.raises(Exception, match=text):
            e.apply(rows_(a), rows_(b)).df.collect()


def test_parent_and_history(spark):
    e = Entity("e", contains=[
        IntegerField("a", cleaners=[FieldEvaluation(This.Value + 1), FieldValidation(F.a.Parent.b > 3, name="up")]), IntegerField("b", cleaners=[Default(4)]),
        SubEntity("s", contains=[IntegerField("c", cleaners=[FieldValidation(F.c.Parent.Parent.a == 2, name="two")])]),
    ], keys=KeyFields("a"))
    df = spark.createDataFrame([(1, 3, (5,)), (2, None, None)], "a long, b long, s struct<c:long>")
    out = e.apply(df, settings=Settings(trace=True))
    assert sorted((r.a, r.validation_name) for r in out.errors.collect()) == [(2, "up")]
    got = sorted((r.a, r.key_string, r.step, r.value) for r in out.history.collect() if r.step)
    assert got == [(2, "e::a", 2, "2"), (3, "e::a", 2, "3"), (3, "e::b", 3, "4")]
    with pytest.raises(SetupNameError):
        Entity("e", contains=[IntegerField("a", cleaners=[FieldValidation(F.a.Parent.Parent.a > 1)])]).apply(df)
    with pytest.raises(ApplyError):
        e.apply(df).history
