"""Column expressions shared by the operators that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SPACE_PATTERN = "[\\x20\\x09-\\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` so that it is computed once for all uses in ``body``."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+``; empty for null."""
    inner = F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(SPACES))
    return let(inner, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE_PATTERN)))


def draw(*parts: Column) -> Column:
    """Uniform value in (0, 1) that depends on the parts alone."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / float(1 << 53)


def packed(docs: DataFrame) -> Column:
    """All columns of a row as one, so that no name of theirs can clash."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def making_room(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` with any column of these names, in whatever case, renamed to ``given_`` and its name."""
    taken = {n.lower() for n in names}
    out: list[str] = []
    for name in docs.columns:
        while name.lower() in taken:
            name = f"given_{name}"
        taken.add(name.lower())
        out.append(name)
    return docs.toDF(*out)
