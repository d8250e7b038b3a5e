"""Declarative entity rules compiled to native Spark columns."""

from .errors import ApplyError, LoadError, SetupError, SetupNameError, SetupTypeError, VeldsparError
from .expr import Ctx, F, Just, M, This, parse
from .model import (
    BooleanField, Cardinality, ChildrenEvaluation, ChildrenValidation, ChoiceField, ChoiceOption, DateField, DateTimeField, DecimalField, Default, DurationField, EmailField, Entity, EnumField,
    ExactLength, FieldEvaluation, FieldGroup, FieldValidation, FloatField, HourFieldValidation, IdField, IntegerField, ItemsEvaluation, ItemsValidation, KeyFields, MaxLength, MinLength, MinValue,
    PositiveIntegerField, RangeLength, Readonly, Required, Settings, SingleValidation, SizedStringField, StringField, SubEntity, SubEntityItems, TimeField, Unique,
)
