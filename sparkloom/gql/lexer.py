"""Text to tokens, each with the offset of its first byte."""

from __future__ import annotations

import re
from dataclasses import dataclass
from decimal import Decimal

from ..errors import GqlSyntaxError

#: Punctuation of the language, the longest first: a<-1 is a, <-, 1.
MARKS = ("<-[", "]->", "<->", "<~[", "]~>", "||", "->", "<-", "-[", "]-", "~[", "]~", "<=", ">=", "<>", "::", "<~", "~>", *"()[]{},.:;=<>+-*/%!&|?$~@")
_mark = re.compile("|".join(re.escape(m) for m in MARKS))
_skip = re.compile(r"(?:\s+|//[^\n]*|--[^\n]*|/\*.*?\*/)+", re.S)
_name = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_number = re.compile(r"0[xX](?P<hex>[0-9A-Fa-f_]+)|0[oO](?P<oct>[0-7_]+)|0[bB](?P<bin>[01_]+)|(?P<dec>(?:\d[\d_]*(?:\.\d[\d_]*)?|\.\d[\d_]*)(?P<exp>[eE][+-]?\d+)?)(?P<suffix>[mMfFdD](?![A-Za-z0-9_]))?")
_escapes = {"\\": "\\", "'": "'", '"': '"', "n": "\n", "r": "\r", "t": "\t"}


@dataclass(frozen=True)
class Token:
    kind: str  # name, quoted, string, int, decimal, float, bytes, mark, end
    text: str
    value: object
    at: int
    suffix: str = ""
    exponent: bool = False


def _string(text: str, at: int) -> tuple[str, int]:
    quote, i, out = text[at], at + 1, []
    while i < len(text):
        c = text[i]
        if c == quote:
            if text[i + 1 : i + 2] == quote:
                out.append(quote)
                i += 2
                continue
            return "".join(out), i + 1
        if c == "\\" and text[i + 1 : i + 2] in _escapes:
            out.append(_escapes[text[i + 1]])
            i += 2
            continue
        if c == "\\":
            raise GqlSyntaxError("unknown escape", i)
        out.append(c)
        i += 1
    raise GqlSyntaxError("string without an end", at)


def lex(text: str) -> list[Token]:
    out, i = [], 0
    offset = lambda k: len(text[:k].encode())
    while True:
        if m := _skip.match(text, i):
            i = m.end()
        elif text.startswith("/*", i):
            raise GqlSyntaxError("comment without an end", offset(i))
        if i >= len(text):
            return [*out, Token("end", "", None, offset(i))]
        c, at = text[i], offset(i)
        if c in "'\"":
            value, i = _string(text, i)
            out.append(Token("string", value, value, at))
        elif c == "`":
            end = i + 1
            while True:
                end = text.find("`", end)
                if end < 0:
                    raise GqlSyntaxError("identifier without an end", at)
                if text[end + 1 : end + 2] != "`":
                    break
                end += 2
            name = text[i + 1 : end].replace("``", "`")
            out.append(Token("quoted", name, name, at))
            i = end + 1
        elif c in "xX" and text[i + 1 : i + 2] in ("'", '"'):
            value, i = _string(text, i + 1)
            digits = re.sub(r"\s", "", value)
            if len(digits) % 2 or re.search(r"[^0-9A-Fa-f]", digits):
                raise GqlSyntaxError("a byte string has pairs of hexadecimal digits", at)
            out.append(Token("bytes", value, bytes.fromhex(digits), at))
        elif m := _name.match(text, i):
            out.append(Token("name", m[0], m[0], at))
            i = m.end()
        elif c.isdigit() and c.isascii() and (m := _number.match(text, i)):
            i = m.end()
            if i < len(text) and (text[i].isalnum() or text[i] == "_"):
                raise GqlSyntaxError("malformed number", at)
            suffix = (m["suffix"] or "").lower()
            for group, base in (("hex", 16), ("oct", 8), ("bin", 2)):
                if m[group]:
                    out.append(Token("int", m[0], int(m[group].replace("_", ""), base), at))
                    break
            else:
                digits = m["dec"].replace("_", "")
                if m["exp"]:
                    out.append(Token("float", m[0], float(digits), at, suffix, True))
                elif "." in digits:
                    out.append(Token("decimal", m[0], Decimal(digits), at, suffix))
                else:
                    out.append(Token("int", m[0], int(digits), at, suffix))
        elif m := _mark.match(text, i):
            out.append(Token("mark", m[0], m[0], at))
            i = m.end()
        else:
            raise GqlSyntaxError(f"unexpected character {c!r}", at)
