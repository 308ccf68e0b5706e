"""Chat-template rendering (P5) as built-in array/string expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.functions.text import col_


@dataclass(frozen=True)
class ChatTemplate:
    """Per-message ``prefix + content + suffix``; ``{role}`` is replaced.

    ``overrides`` maps a role to its own (prefix, suffix).  Messages are
    concatenated with nothing in between and no generation prompt is added.
    """

    prefix: str
    suffix: str
    overrides: dict = field(default_factory=dict)

    def _affix(self, role: Column, text: str) -> Column:
        parts = text.split("{role}")
        pieces: list[Column] = []
        for i, p in enumerate(parts):
            if i:
                pieces.append(F.coalesce(role, F.lit("")))
            if p:
                pieces.append(F.lit(p))
        if not pieces:
            return F.lit("")
        return pieces[0] if len(pieces) == 1 else F.concat(*pieces)

    def prefix_expr(self, role: Column) -> Column:
        e = self._affix(role, self.prefix)
        for r, (p, _) in self.overrides.items():
            e = F.when(role == F.lit(r), F.lit(p)).otherwise(e)
        return e

    def suffix_expr(self, role: Column) -> Column:
        e = self._affix(role, self.suffix)
        for r, (_, s) in self.overrides.items():
            e = F.when(role == F.lit(r), F.lit(s)).otherwise(e)
        return e


# The public ChatML layout.
CHATML = ChatTemplate(prefix="<|im_start|>{role}\n", suffix="<|im_end|>\n")


def render_turn(role, content, template: ChatTemplate = CHATML) -> Column:
    """One rendered message; a null content renders as empty."""
    r = col_(role)
    return F.concat(template.prefix_expr(r), F.coalesce(col_(content), F.lit("")),
                    template.suffix_expr(r))


def render_chat(messages, template: ChatTemplate = CHATML) -> Column:
    """``messages ARRAY<STRUCT<role, content>>`` -> one string."""
    return F.array_join(
        F.transform(col_(messages), lambda m: render_turn(m["role"], m["content"], template)), "")
