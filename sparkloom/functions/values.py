"""Typed values: a column with its Spark type, and the rules of comparison, arithmetic and casts.

Types are known when a query is compiled, so comparability is decided then and not by Spark's coercion: values of unlike kinds
are never equal, and ordering them is an error.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import datetime
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DataError
from ..sources.graph import common_type

NAMES = {T.LongType: "int", T.DoubleType: "float", T.DecimalType: "decimal", T.StringType: "string", T.BinaryType: "bytes", T.BooleanType: "bool", T.TimestampType: "datetime", T.ArrayType: "list", T.StructType: "record", T.NullType: "null", T.VariantType: "variant"}
NUMBERS = ("int", "decimal", "float")
SPARK = {"int": T.LongType(), "float": T.DoubleType(), "string": T.StringType(), "bytes": T.BinaryType(), "bool": T.BooleanType(), "datetime": T.TimestampType()}


@dataclass(frozen=True)
class Value:
    col: Column
    type: T.DataType

    @property
    def kind(self) -> str:
        return NAMES[type(self.type)]

    def cast(self, kind: T.DataType) -> "Value":
        return self if self.type == kind else Value(self.col.cast(kind), kind)


def null(kind: T.DataType | None = None) -> Value:
    kind = kind or T.NullType()
    return Value(F.lit(None).cast(kind), kind)


def boolean(col: Column) -> Value:
    return Value(col, T.BooleanType())


def number(col: Column) -> Value:
    return Value(col.cast("double"), T.DoubleType())


def integer(col: Column) -> Value:
    return Value(col.cast("long"), T.LongType())


def text(col: Column) -> Value:
    return Value(col, T.StringType())


def literal(x) -> Value:
    """A Python value as a typed literal."""
    if x is None:
        return null()
    if isinstance(x, bool):
        return boolean(F.lit(x))
    if isinstance(x, int):
        if not -(1 << 63) <= x < 1 << 63:
            raise DataError("the number is beyond 64 bits")
        return Value(F.lit(x).cast("long"), T.LongType())
    if isinstance(x, float):
        return Value(F.lit(x), T.DoubleType())
    if isinstance(x, Decimal):
        sign, digits, exponent = x.as_tuple()
        scale = max(0, -exponent)
        precision = max(len(digits) + max(0, exponent), scale, 1)
        if precision > 38:
            raise DataError("a decimal has at most 38 digits here")
        kind = T.DecimalType(precision, scale)
        return Value(F.lit(x).cast(kind), kind)
    if isinstance(x, str):
        return text(F.lit(x))
    if isinstance(x, (bytes, bytearray)):
        return Value(F.lit(bytes(x)), T.BinaryType())
    if isinstance(x, datetime):
        return Value(F.lit(x).cast("timestamp"), T.TimestampType())
    if isinstance(x, (list, tuple)):
        return list_of([literal(i) for i in x])
    if isinstance(x, dict):
        return record_of([(k, literal(v)) for k, v in x.items()])
    raise DataError(f"no value of the language: {type(x).__name__}")


def list_of(items: list[Value]) -> Value:
    """Items of one kind; of unlike kinds: a list of variants."""
    if not items:
        return Value(F.array().cast("array<void>"), T.ArrayType(T.NullType()))
    items = promote(items)
    kind = common_type([i.type for i in items])
    return Value(F.array(*[i.col.cast(kind) for i in items]), T.ArrayType(kind))


def record_of(fields: list[tuple[str, Value]]) -> Value:
    kind = T.StructType([T.StructField(k, v.type) for k, v in fields])
    if not fields:
        return Value(F.struct(F.lit(None).alias("$")), T.StructType([T.StructField("$", T.NullType())]))
    return Value(F.struct(*[v.col.alias(k) for k, v in fields]), kind)


def promote(values: list[Value]) -> list[Value]:
    """Numbers to the widest kind among them: any double, else any decimal, else integers."""
    kinds = {v.kind for v in values} - {"null"}
    if not kinds <= set(NUMBERS) or len(kinds) < 2:
        return values
    if "float" in kinds:
        return [v if v.kind == "null" else v.cast(T.DoubleType()) for v in values]
    return [v if v.kind == "null" else _decimal(v) for v in values]


def _decimal(v: Value) -> Value:
    return v if v.kind == "decimal" else v.cast(T.DecimalType(19, 0))


def _from_variant(a: Value, b: Value) -> tuple[Value, Value]:
    """A variant against a typed value is read as that type; of another type it is null, hence not equal."""
    if a.kind == "variant" and b.kind not in ("variant", "null", "list", "record"):
        return Value(F.try_variant_get(a.col, "$", b.type.simpleString()), b.type), b
    if b.kind == "variant" and a.kind not in ("variant", "null", "list", "record"):
        return a, Value(F.try_variant_get(b.col, "$", a.type.simpleString()), a.type)
    if a.kind == b.kind == "variant":
        return text(F.to_json(a.col)), text(F.to_json(b.col))
    return a, b


def comparable(a: T.DataType, b: T.DataType) -> bool:
    x, y = NAMES[type(a)], NAMES[type(b)]
    if x in NUMBERS and y in NUMBERS:
        return True
    if x == y == "list":
        return comparable(a.elementType, b.elementType) or "null" in (NAMES[type(a.elementType)], NAMES[type(b.elementType)])
    if x == y == "record":
        return a.simpleString() == b.simpleString()
    return x == y


def equal(a: Value, b: Value) -> Column:
    """=; null if either is null, false for unlike kinds, for NaN and for lists with a null."""
    a, b = _from_variant(a, b)
    if "null" in (a.kind, b.kind):
        return F.lit(None).cast("boolean")
    if not comparable(a.type, b.type):
        return F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False))
    if a.kind == "list":
        if not isinstance(a.type.elementType, type(b.type.elementType)):
            kind = common_type([v.type.elementType for v in promote([Value(F.lit(None), a.type.elementType), Value(F.lit(None), b.type.elementType)])])
            a, b = a.cast(T.ArrayType(kind)), b.cast(T.ArrayType(kind))
        holds = lambda v: F.exists(v.col, lambda x: x.isNull())
        return (a.col == b.col) & ~holds(a) & ~holds(b)
    a, b = promote([a, b])
    same = a.col == b.col
    return same & ~F.isnan(a.col) if a.kind == "float" else same


def compare(op: str, a: Value, b: Value) -> Value:
    if op == "=":
        return boolean(equal(a, b))
    if op == "<>":
        return boolean(~equal(a, b))
    a, b = _from_variant(a, b)
    if "null" in (a.kind, b.kind):
        return boolean(F.lit(None).cast("boolean"))
    if not comparable(a.type, b.type) or a.kind == "record":
        raise DataError(f"{a.kind} and {b.kind} can't be ordered")
    a, b = promote([a, b])
    return boolean({"<": a.col < b.col, "<=": a.col <= b.col, ">": a.col > b.col, ">=": a.col >= b.col}[op])


def same(a: Value, b: Value) -> Column:
    """Structural equality; nulls are equal."""
    if "null" in (a.kind, b.kind):
        return a.col.isNull() & b.col.isNull()
    if a.type != b.type:
        return a.col.isNull() & b.col.isNull()
    return a.col.eqNullSafe(b.col)


def _numbers(op: str, *values: Value) -> list[Value]:
    out = []
    for v in values:
        if v.kind == "variant":
            v = Value(F.try_variant_get(v.col, "$", "double"), T.DoubleType())
        if v.kind not in (*NUMBERS, "null"):
            raise DataError(f"{op} needs numbers, not {v.kind}")
        out.append(v)
    return out


def arithmetic(op: str, a: Value, b: Value) -> Value:
    a, b = _numbers(op, a, b)
    if "null" in (a.kind, b.kind):
        return null(b.type if a.kind == "null" else a.type)
    a, b = promote([a, b])
    if a.kind == "decimal" and op in "/%":
        zero = F.raise_error(F.lit("division by zero")).cast("double") if op == "/" else F.lit(math.nan)
        x, y = a.cast(T.DoubleType()), b.cast(T.DoubleType())
        rest = F.try_divide(x.col, y.col) if op == "/" else F.try_mod(x.col, y.col)
        return number(F.when(x.col.isNotNull() & (y.col == 0), zero).otherwise(rest))
    if a.kind == "float":
        return number(_ieee(op, a.col, b.col))
    if a.kind == "decimal":
        s, t = a.type, b.type
        scale = min(s.scale + t.scale, 18) if op == "*" else max(s.scale, t.scale)
        kind = T.DecimalType(38, scale)
        return Value({"+": a.col + b.col, "-": a.col - b.col, "*": a.col * b.col}[op].cast(kind), kind)
    return integer({"+": lambda: a.col + b.col, "-": lambda: a.col - b.col, "*": lambda: a.col * b.col, "/": lambda: F.call_function("div", a.col, b.col), "%": lambda: a.col % b.col}[op]())


def _ieee(op: str, a: Column, b: Column) -> Column:
    if op in "+-*":
        return {"+": a + b, "-": a - b, "*": a * b}[op]
    if op == "%":
        return F.when(a.isNotNull() & (b == 0), F.lit(math.nan)).otherwise(F.try_mod(a, b))
    by_zero = F.when(F.isnan(a) | (a == 0), F.lit(math.nan)).when(a > 0, F.lit(math.inf)).otherwise(F.lit(-math.inf))
    return F.when(a.isNotNull() & (b == 0), by_zero).otherwise(F.try_divide(a, b))


def concat(a: Value, b: Value) -> Value:
    if "null" in (a.kind, b.kind):
        return null(b.type if a.kind == "null" else a.type)
    if a.kind != b.kind or a.kind not in ("string", "bytes", "list"):
        raise DataError(f"|| joins strings, byte strings or lists, not {a.kind} and {b.kind}")
    if a.kind == "list":
        kind = common_type([a.type.elementType, b.type.elementType])
        a, b = a.cast(T.ArrayType(kind)), b.cast(T.ArrayType(kind))
    return Value(F.concat(a.col, b.col), a.type)


def contains(needle: Value, of: Value) -> Value:
    """IN: null for a null needle or list; nulls within the list do not count."""
    if of.kind == "null":
        return boolean(F.lit(None).cast("boolean"))
    if of.kind != "list":
        raise DataError(f"IN needs a list, not {of.kind}")
    kind = of.type.elementType
    found = F.exists(of.col, lambda x: F.coalesce(equal(needle, Value(x, kind)), F.lit(False)))
    return boolean(F.when(needle.col.isNull() | of.col.isNull(), F.lit(None).cast("boolean")).otherwise(found))


def cast(v: Value, kind: str) -> Value:
    if v.kind == "null":
        return null(SPARK.get(kind, T.NullType()))
    if v.kind == "variant":
        target = SPARK.get(kind) or (T.DecimalType(38, 18) if kind == "decimal" else None)
        if target is None:
            raise DataError(f"a variant can't become a {kind}")
        return Value(F.variant_get(v.col, "$", target.simpleString()), target)
    way = _CASTS.get((v.kind, kind))
    if way is None:
        raise DataError(f"{v.kind} can't become {kind}")
    return way(v)


def _text_of_double(c: Column) -> Column:
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    return F.when(F.isnan(c), F.lit("NaN")).when(c == math.inf, F.lit("inf")).when(c == -math.inf, F.lit("-inf")).when(whole, F.when(whole, c).otherwise(0.0).cast("decimal(20,0)").cast("string")).otherwise(c.cast("string"))


def _bool_of_text(c: Column) -> Column:
    up = F.upper(F.trim(c))
    return F.when(up == "TRUE", F.lit(True)).when(up == "FALSE", F.lit(False)).when(c.isNull(), F.lit(None).cast("boolean")).otherwise(F.raise_error(F.lit("not a truth value")).cast("boolean"))


def _int_of_double(c: Column) -> Column:
    fits = F.abs(c) < 9.2e18
    return F.when(fits, F.when(fits, c).otherwise(0.0).cast("long")).when(c.isNull(), F.lit(None).cast("long")).otherwise(F.raise_error(F.lit("the number does not fit in 64 bits")).cast("long"))


_keep = lambda v: v
_CASTS = {
    ("int", "int"): _keep,
    ("float", "int"): lambda v: integer(_int_of_double(v.col)),
    ("decimal", "int"): lambda v: integer(v.col.cast("double").cast("long")),
    ("string", "int"): lambda v: integer(F.trim(v.col).cast("long")),
    ("int", "float"): lambda v: number(v.col),
    ("decimal", "float"): lambda v: number(v.col),
    ("float", "float"): _keep,
    ("string", "float"): lambda v: number(F.trim(v.col)),
    ("int", "decimal"): _decimal,
    ("decimal", "decimal"): _keep,
    ("float", "decimal"): lambda v: Value(v.col.cast("decimal(38,18)"), T.DecimalType(38, 18)),
    ("string", "decimal"): lambda v: Value(F.trim(v.col).cast("decimal(38,18)"), T.DecimalType(38, 18)),
    ("string", "string"): _keep,
    ("int", "string"): lambda v: text(v.col.cast("string")),
    ("float", "string"): lambda v: text(_text_of_double(v.col)),
    ("decimal", "string"): lambda v: text(v.col.cast("string")),
    ("bool", "string"): lambda v: text(F.upper(v.col.cast("string"))),
    ("bool", "bool"): _keep,
    ("string", "bool"): lambda v: boolean(_bool_of_text(v.col)),
    ("bytes", "bytes"): _keep,
    ("string", "bytes"): lambda v: Value(F.encode(v.col, "UTF-8"), T.BinaryType()),
    ("datetime", "datetime"): _keep,
    ("int", "datetime"): lambda v: Value(F.timestamp_micros(v.col), T.TimestampType()),
    ("list", "list"): _keep,
    ("record", "record"): _keep,
}
