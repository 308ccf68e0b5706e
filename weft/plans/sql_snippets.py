"""DuckDB spellings of the package's Column helpers, for the SQL oracle."""

from __future__ import annotations

from weft.functions.text import PY_SPACE_CHARS, PY_SPACE_CLASS


def sql_tokens(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '{PY_SPACE_CLASS}+'), lambda x: x <> '')"


def sql_token_count(expr: str) -> str:
    return f"CAST(len({sql_tokens(expr)}) AS INTEGER)"


def sql_strip(expr: str) -> str:
    chars = "".join(f"chr({ord(c)})" if i == 0 else f" || chr({ord(c)})" for i, c in enumerate(PY_SPACE_CHARS))
    return f"trim({expr}, {chars})"


def sql_chatml_turn(role: str, content: str) -> str:
    return (f"('<|im_start|>' || coalesce({role}, '') || chr(10) || coalesce({content}, '') "
            f"|| '<|im_end|>' || chr(10))")


def sql_hash_order(expr: str) -> str:
    """Same 60-bit integer as ``sequences.hash_order_key``."""
    return f"CAST(('0x' || substr(md5(CAST({expr} AS VARCHAR)), 1, 15)) AS BIGINT)"
