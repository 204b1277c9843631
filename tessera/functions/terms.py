r"""Lexical terms: an IRI in angle brackets, a blank node, or a literal in double quotes with an
optional language tag or datatype. Terms are compared as text, after ``\uXXXX`` and
``\UXXXXXXXX`` escapes were replaced by their characters, in data and queries alike.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})")


def unescape(text: str) -> str:
    """Replace unicode escapes; a pair of surrogates becomes the character that it stands for,
    a lone surrogate or a number beyond Unicode the replacement character."""

    def char(m: re.Match) -> str:
        code = int(m[1] or m[2], 16)
        return chr(code) if code <= 0x10FFFF else "�"

    out = _ESCAPE.sub(char, text)
    return out.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if re.search("[\ud800-\udfff]", out) else out


def escape(text: str) -> str:
    r"""ASCII form: every other character as upper-case ``\uXXXX``, above the BMP as a pair of
    surrogates."""
    units = text.encode("utf-16-be", "surrogatepass")
    codes = [units[i] << 8 | units[i + 1] for i in range(0, len(units), 2)]
    return "".join(chr(c) if c < 0x80 else f"\\u{c:04X}" for c in codes)


def unescape_nt(term: Column) -> Column:
    r"""``unescape`` as a Column expression. The text is split before each escape; pieces become
    their character and what follows it."""
    code = lambda h: F.conv(h, 16, 10).cast("int")

    def char(c: Column) -> Column:
        two = F.concat(F.lpad(F.hex(F.lit(0xC0) + F.shiftright(c, 6)), 2, "0"), F.hex(F.lit(0x80) + c.bitwiseAND(63)))
        three = F.concat(F.hex(F.lit(0xE0) + F.shiftright(c, 12)), F.hex(F.lit(0x80) + F.shiftright(c, 6).bitwiseAND(63)), F.hex(F.lit(0x80) + c.bitwiseAND(63)))
        four = F.concat(F.hex(F.lit(0xF0) + F.shiftright(c, 18)), F.hex(F.lit(0x80) + F.shiftright(c, 12).bitwiseAND(63)), F.hex(F.lit(0x80) + F.shiftright(c, 6).bitwiseAND(63)), F.hex(F.lit(0x80) + c.bitwiseAND(63)))
        one = F.lpad(F.hex(c), 2, "0")
        spelled = F.when(c < 0x80, one).when(c < 0x800, two).when((c >= 0xD800) & (c <= 0xDFFF), F.lit("EFBFBD")).when(c < 0x10000, three).when(c <= 0x10FFFF, four).otherwise(F.lit("EFBFBD"))
        return F.unhex(spelled).cast("string")

    def piece(p: Column) -> Column:
        pair = p.rlike(r"^\\u[Dd][89ABab][0-9A-Fa-f]{2}\\u[Dd][C-Fc-f][0-9A-Fa-f]{2}")
        high, low = code(F.substring(p, 3, 4)), code(F.substring(p, 9, 4))
        joined = F.concat(char((high - 0xD800) * 1024 + (low - 0xDC00) + 0x10000), F.substr(p, F.lit(13)))
        short = F.concat(char(code(F.substring(p, 3, 4))), F.substr(p, F.lit(7)))
        # eight digits may exceed an int: beyond Unicode is caught on the text
        wide = F.when(F.substring(p, 3, 2) != "00", F.lit("�")).otherwise(char(code(F.substring(p, 5, 6))))
        return F.when(pair, joined).when(p.rlike(r"^\\u[0-9A-Fa-f]{4}"), short).when(p.rlike(r"^\\U[0-9A-Fa-f]{8}"), F.concat(wide, F.substr(p, F.lit(11)))).otherwise(p)

    # split before an escape, but not between the two of a pair
    start = r"(?=\\U[0-9A-Fa-f]{8})|(?<!\\u[Dd][89ABab][0-9A-Fa-f]{2})(?=\\u[0-9A-Fa-f]{4})|(?=\\u(?![Dd][C-Fc-f])[0-9A-Fa-f]{4})"
    plain = ~term.contains("\\u") & ~term.contains("\\U")
    return F.when(plain, term).otherwise(F.array_join(F.transform(F.split(term, start, -1), piece), ""))


def escape_nt(term: Column) -> Column:
    r"""``escape`` as a Column expression."""
    units = F.encode(term, "UTF-16BE")
    return F.when(term.rlike(r"^\p{ASCII}*\z"), term).otherwise(
        F.array_join(
            F.transform(
                F.sequence(F.lit(0), (F.octet_length(units) / 2).cast("int") - 1),
                lambda i: _unit(F.hex(F.substring(units, i * 2 + 1, F.lit(2)))),
            ),
            "",
        )
    )


def _unit(h: Column) -> Column:
    return F.when(h <= "007F", F.unhex(F.substring(h, 3, 2)).cast("string")).otherwise(F.concat(F.lit("\\u"), h))
