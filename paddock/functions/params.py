"""Parameters written as text, and numbers shown as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number_list(text: str) -> list[int]:
    """``1,2,5-8``: the numbers, ascending, each once."""
    out: set[int] = set()
    for part in filter(None, (p.strip() for p in text.split(","))):
        first, _, last = part.partition("-")
        out.update(range(int(first), int(last or first) + 1))
    return sorted(out)


def name_list(text: str) -> list[str]:
    return [p.strip() for p in text.split(",") if p.strip()]


def pairs(text: str) -> dict[str, float]:
    """``VER=1,NOR=2.5``"""
    return {k.strip(): float(v) for k, v in (p.split("=", 1) for p in name_list(text))}


def percent(x: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", 100 * x)


def build_label(text: Column) -> tuple[Column, Column]:
    """Year and round of a label such as ``2025R07``; null if there is none."""
    part = lambda i: F.regexp_extract(text, r"(\d{4})\D*R(\d{1,2})", i).try_cast("int")
    return part(1), part(2)
