"""Renaming of identifiers in source text, consistent within a function. Stateful, so a batch function over arrays of statements."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a name is of ASCII letters, digits and `_`, and stands by itself, so tails of numbers and parts of other words are none.
_NAME = re.compile(r"\b[A-Za-z_][A-Za-z0-9_]*\b")
_CALL = re.compile(r"\s{0,47}\(")
# Words of C and C++ that stay.
KEYWORDS = frozenset(
    """
    auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static
    struct switch typedef union unsigned void volatile while _Bool _Complex _Imaginary bool complex imaginary int8_t int16_t int32_t int64_t uint8_t uint16_t
    uint32_t uint64_t size_t ssize_t intptr_t uintptr_t ptrdiff_t NULL true false static_assert alignas alignof concept requires and and_eq bitand bitor compl not
    or or_eq xor xor_eq new delete this namespace using class public private protected virtual explicit operator template typename try catch throw static_cast
    dynamic_cast reinterpret_cast const_cast nullptr decltype constexpr thread_local noexcept
    """.split()
)


def rename(statements: list[str]) -> list[str]:
    """var_0, var_1 ... and, where `(` follows, func_0 ..., in the order of first use over all statements."""
    names: dict[str, dict[str, str]] = {"var": {}, "func": {}}

    def one(m: re.Match) -> str:
        if m.group() in KEYWORDS:
            return m.group()
        kind = "func" if _CALL.match(m.string, m.end()) else "var"
        return names[kind].setdefault(m.group(), f"{kind}_{len(names[kind])}")

    return [_NAME.sub(one, s or "") for s in statements]


def placeholders(statements: Column) -> Column:
    """Renamed statements of a function (an array column)."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda s: None if s is None else rename(list(s)))

    return run(statements)
