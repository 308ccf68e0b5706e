"""String helpers with Python ``str`` semantics, as Column expressions.

All of these compile to JVM expressions (regexp_replace, split, filter ...)
and stay inside whole-stage codegen; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.isspace() accepts, written as one
# regex class that Java (Spark) and RE2 (DuckDB oracle) read the same way.
# Java's \s and RE2's \s differ (Unicode vs ASCII), so the class is spelled out.
PY_SPACE_CLASS = (
    r"[\t\n\x{0b}\x{0c}\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}"
    r"\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
PY_STRIP_RE = rf"^{PY_SPACE_CLASS}+|{PY_SPACE_CLASS}+$"
# The same 29 characters as a literal set, for btrim (no regex).
PY_SPACE_CHARS = "".join(chr(c) for c in (
    [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680]
    + list(range(0x2000, 0x200B)) + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
# Java's Unicode White_Space plus the four separators \x1c-\x1f is exactly the
# same 29-character set, and matches about twice as fast as the spelled-out
# class; the SQL oracle keeps the spelled-out class (RE2 has no (?U)).
TOKEN_SPLIT_RE = r"(?U)[\s\x1c-\x1f]+"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python's ``str.strip()``; ``F.trim`` strips spaces only.  ``btrim``
    with the white-space set is a plain character scan, no regex."""
    return F.btrim(col_(c), F.lit(PY_SPACE_CHARS))


def is_ascii(c) -> Column:
    """True when every character is one byte in UTF-8 (a length compare)."""
    return F.length(col_(c)) == F.octet_length(col_(c))


def is_blank(c) -> Column:
    return py_strip(c) == F.lit("")


def tokens(c) -> Column:
    """Whitespace tokens, as Python's ``str.split()`` gives them."""
    return F.filter(F.split(col_(c), TOKEN_SPLIT_RE), lambda x: x != F.lit(""))


def token_count(c) -> Column:
    """Number of whitespace tokens (default tokenizer of P15)."""
    return F.size(tokens(c))


def split_list(c, sep: str = ",") -> Column:
    """``[x.strip() for x in s.split(sep) if x.strip()]``."""
    import re

    parts = F.transform(F.split(col_(c), re.escape(sep)), lambda x: py_strip(x))
    return F.filter(parts, lambda x: x != F.lit(""))


def nullif_empty(c) -> Column:
    return F.nullif(col_(c), F.lit(""))


def truthy_str(c) -> Column:
    """Python truthiness of an optional string: not null and not empty."""
    return col_(c).isNotNull() & (col_(c) != F.lit(""))
