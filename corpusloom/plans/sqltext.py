"""DuckDB forms of the text expressions, for the SQL side of the registered queries."""

from __future__ import annotations

B = "[ \\t\\n\\r\\f\\x0B ﻿]"
W = "[\\p{L}\\p{M}\\p{N}_]"
URL = "(https?://|www\\.)[^ \\t\\n\\r]+"


def sub(x: str, pattern: str, new: str = " ") -> str:
    return f"regexp_replace({x}, '{pattern}', '{new}', 'g')"


def collapse(x: str) -> str:
    return f"trim({sub(x, B + '+')})"


def fold_yo(x: str) -> str:
    return f"replace(lower({x}), 'ё', 'е')"


def audit(x: str) -> str:
    return collapse(sub(sub(fold_yo(x), URL), "[^\\p{L}\\p{M}\\p{N}_\\[\\]# \\t\\n\\r]"))


def no_instruction(x: str) -> str:
    return f"regexp_replace({x}, '(?s)^Instruct:.*?\\nQuery:[ \\t]*', '')"


def prompt(x: str) -> str:
    return collapse(fold_yo(no_instruction(x)))


def social(x: str) -> str:
    return collapse(sub(sub(sub(fold_yo(x), URL), "@" + W + "+"), "[^\\p{L}\\p{M}\\p{N}_ ]"))


def alnum(x: str) -> str:
    return f"trim({sub(f'lower({x})', '[^0-9a-zа-яё]+')})"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '{W}+')"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def ratio(x: str, part: str, whole: str | None = None) -> str:
    of = count(x, whole) if whole else f"length({x})"
    return f"CASE WHEN {of} > 0 THEN {count(x, part)}::DOUBLE / {of} WHEN {x} IS NOT NULL THEN 0.0 END"


def source(x: str = "source") -> str:
    return "nullif(" + sub(f"lower({collapse(x)})", "[ _\\-]+", "_") + ", '')"
