"""The scalar functions. Any null argument makes the result null, but for COALESCE."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DataError, GqlSyntaxError
from . import values as V
from .values import Value


def _numeric(name: str, v: Value) -> Value:
    if v.kind == "variant":
        return V.cast(v, "float")
    if v.kind not in (*V.NUMBERS, "null"):
        raise DataError(f"{name} needs a number, not {v.kind}")
    return v


def _double(make):
    return lambda name, v: V.number(make(_numeric(name, v).col.cast("double")))


def _log(c: Column, make) -> Column:
    """Zero has minus infinity, less has NaN."""
    return F.when(c == 0, F.lit(-math.inf)).when(c < 0, F.lit(math.nan)).otherwise(make(c))


def _log_of_base(name: str, base: Value, x: Value) -> Value:
    top, bottom = (_log(_numeric(name, v).col.cast("double"), F.ln) for v in (x, base))
    return V.number(V._ieee("/", top, bottom))


def _abs(name: str, v: Value) -> Value:
    v = _numeric(name, v)
    return Value(F.abs(v.col), v.type)


def _string(name: str, v: Value) -> Column:
    if v.kind not in ("string", "null"):
        raise DataError(f"{name} needs a string, not {v.kind}")
    return v.col.cast("string")


def _length(name: str, v: Value) -> Value:
    return V.integer(F.char_length(_string(name, v)))


def _bytes(name: str, v: Value) -> Value:
    if v.kind not in ("string", "bytes", "null"):
        raise DataError(f"{name} needs a string or byte string, not {v.kind}")
    return V.integer(F.octet_length(v.col))


def _side(make):
    def run(name: str, v: Value, n: Value) -> Value:
        if n.kind not in ("int", "null"):
            raise DataError(f"{name} needs an integer, not {n.kind}")
        c, k = _string(name, v), n.col
        taken = make(c, F.least(k, F.lit((1 << 31) - 1).cast("long")).cast("int"))
        return V.text(F.when(k < 0, F.raise_error(F.lit("a length is not negative")).cast("string")).otherwise(taken))

    return run


#: Unicode white space, for TRIM of one argument.
_SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B]+"


def _trim_space(name: str, v: Value) -> Value:
    return V.text(F.regexp_replace(F.regexp_replace(_string(name, v), "^" + _SPACE, ""), _SPACE + r"\z", ""))


_TRIMS = {"BOTH": F.btrim, "LEADING": lambda c, s: F.call_function("ltrim", s, c), "TRAILING": lambda c, s: F.call_function("rtrim", s, c)}


def trim(side: str, v: Value, chars: Value | None) -> Value:
    if v.kind == "bytes" or (chars is not None and chars.kind == "bytes"):
        if side != "BOTH" or chars is None:
            raise DataError("byte strings are trimmed on both sides, by a set of bytes")
        return trim_bytes(v, chars)
    return V.text(_TRIMS[side](_string("TRIM", v), F.lit(" ") if chars is None else _string("TRIM", chars)))


def trim_bytes(v: Value, chars: Value) -> Value:
    """Pairs of hexadecimal digits are trimmed, then turned back into bytes."""
    if v.kind not in ("bytes", "null") or chars.kind not in ("bytes", "null"):
        raise DataError("a byte string is trimmed by a byte string")
    digits = F.hex(v.col)
    any_of = F.concat(F.lit("(?:"), F.rtrim(F.regexp_replace(F.hex(chars.col), "(..)", "$1|"), F.lit("|")), F.lit(")+"))
    cut = F.regexp_replace(F.regexp_replace(digits, F.concat(F.lit("^"), any_of), F.lit("")), F.concat(F.lit("^((?:..)*?)"), any_of, F.lit("$")), F.lit("$1"))
    return Value(F.when(F.octet_length(chars.col) == 0, v.col).otherwise(F.unhex(cut)), T.BinaryType())


def _set_trim(side):
    def run(name: str, v: Value, chars: Value | None = None) -> Value:
        if v.kind == "bytes":
            if side != "BOTH" or chars is None:
                raise DataError(f"{name} of a byte string needs a set of bytes" if side == "BOTH" else f"{name} needs a string")
            return trim_bytes(v, chars)
        return trim(side, v, chars)

    return run


def _size(name: str, v: Value) -> Value:
    if v.kind == "record":
        return V.integer(F.when(v.col.isNotNull(), F.lit(len([f for f in v.type.fields if f.name != "$"]))))
    if v.kind not in ("list", "null"):
        raise DataError(f"{name} needs a list or record, not {v.kind}")
    return V.integer(F.when(v.col.isNotNull(), F.size(v.col))) if v.kind == "list" else V.null(T.LongType())


def _coalesce(name: str, *args: Value) -> Value:
    args = V.promote(list(args))
    kind = V.common_type([a.type for a in args])
    return Value(F.coalesce(*[a.col.cast(kind) for a in args]), kind)


def _nullif(name: str, a: Value, b: Value) -> Value:
    return Value(F.when(~V.equal(a, b), a.col), a.type) if "null" not in (a.kind, b.kind) else V.null(a.type)


def _round(make):
    """CEIL and FLOOR give doubles; infinities and NaN stay."""

    def run(name: str, v: Value) -> Value:
        v = _numeric(name, v)
        if v.kind != "float":
            return V.number(make(v.col))
        plain = F.abs(v.col) < 9e18
        return V.number(F.when(plain, make(F.when(plain, v.col).otherwise(0.0)).cast("double")).otherwise(v.col))

    return run


def _power(name: str, a: Value, b: Value) -> Value:
    return V.number(F.power(_numeric(name, a).col.cast("double"), _numeric(name, b).col.cast("double")))


FUNCTIONS = {
    "ABS": (_abs, 1, 1),
    "CEIL": (_round(F.ceil), 1, 1),
    "CEILING": (_round(F.ceil), 1, 1),
    "FLOOR": (_round(F.floor), 1, 1),
    "SQRT": (_double(F.sqrt), 1, 1),
    "EXP": (_double(F.exp), 1, 1),
    "LN": (_double(lambda c: _log(c, F.ln)), 1, 1),
    "LOG10": (_double(lambda c: _log(c, F.log10)), 1, 1),
    "LOG": (_log_of_base, 2, 2),
    "POWER": (_power, 2, 2),
    "MOD": (lambda name, a, b: V.arithmetic("%", a, b), 2, 2),
    **{n: (_double(f), 1, 1) for n, f in {"SIN": F.sin, "COS": F.cos, "TAN": F.tan, "ASIN": F.asin, "ACOS": F.acos, "ATAN": F.atan, "SINH": F.sinh, "COSH": F.cosh, "TANH": F.tanh, "DEGREES": F.degrees, "RADIANS": F.radians}.items()},
    "COT": (_double(lambda c: V._ieee("/", F.lit(1.0), F.tan(c))), 1, 1),
    "UPPER": (lambda name, v: V.text(F.upper(_string(name, v))), 1, 1),
    "LOWER": (lambda name, v: V.text(F.lower(_string(name, v))), 1, 1),
    "CHAR_LENGTH": (_length, 1, 1),
    "CHARACTER_LENGTH": (_length, 1, 1),
    "BYTE_LENGTH": (_bytes, 1, 1),
    "OCTET_LENGTH": (_bytes, 1, 1),
    "LEFT": (_side(F.left), 2, 2),
    "RIGHT": (_side(F.right), 2, 2),
    "TRIM": (_trim_space, 1, 1),
    "BTRIM": (_set_trim("BOTH"), 1, 2),
    "LTRIM": (_set_trim("LEADING"), 1, 2),
    "RTRIM": (_set_trim("TRAILING"), 1, 2),
    "SIZE": (_size, 1, 1),
    "CARDINALITY": (_size, 1, 1),
    "COALESCE": (_coalesce, 1, 99),
    "NULLIF": (_nullif, 2, 2),
}


def call(name: str, args: list[Value]) -> Value:
    make, least, most = FUNCTIONS[name]
    if not least <= len(args) <= most:
        raise GqlSyntaxError(f"{name} takes {least}" + (f" to {most}" if most > least else "") + " arguments")
    return make(name, *args)
