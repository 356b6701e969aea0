"""Scalar text expressions. Whitespace is Unicode's, as Python's ``str`` sees it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = "[\\s\\x1c-\\x1f]"
# The characters that Python's ``str.strip`` takes for whitespace.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
SUMMARY_LENGTH = 120


def bind(value: Column, body) -> Column:
    """Compute ``value`` once for all its uses in ``body``."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def collapse(text: Column) -> Column:
    """Trim, and turn each stretch of whitespace into one space."""
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), f"(?U){SPACE}+", " "))


def filled(*values: Column) -> Column:
    """The first value that is neither null nor empty (else the last)."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values[:-1]], values[-1])


def content_hash(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def char_count(text: Column) -> Column:
    return F.length(F.coalesce(text, F.lit("")))


def _shortened(clean: Column, limit: int) -> Column:
    return F.when(F.length(clean) <= limit, clean).otherwise(F.concat(F.rtrim(F.substring(clean, 1, limit)), F.lit("...")))


def summary(text: Column, limit: int = SUMMARY_LENGTH) -> Column:
    """The first ``limit`` characters of the collapsed text, marked if cut."""
    return bind(collapse(text), lambda clean: _shortened(clean, limit))


def preview(text: Column, query: str, limit: int = SUMMARY_LENGTH) -> Column:
    """A stretch around the earliest keyword of ``query`` (of equals the first listed)."""
    keywords = query.split()

    def around(clean: Column, hit: Column) -> Column:
        size = hit["size"]
        half = F.greatest(F.lit(20), F.floor((F.lit(limit) - size) / 2).cast("int"))
        start = F.greatest(F.lit(0), hit["at"] - 1 - half)
        end = F.least(F.length(clean), hit["at"] - 1 + size + half)
        piece = F.btrim(F.substring(clean, start + 1, end - start))
        return F.concat(F.when(start > 0, "...").otherwise(""), piece, F.when(end < F.length(clean), "...").otherwise(""))

    def shown(clean: Column) -> Column:
        if not keywords:
            return _shortened(clean, limit)
        low = F.lower(clean)
        places = [F.struct(F.locate(k.lower(), low).alias("at"), F.lit(i).alias("order"), F.lit(len(k)).alias("size")) for i, k in enumerate(keywords)]
        hits = F.filter(F.array(*places), lambda p: p["at"] > 0)
        return F.when(F.size(hits) == 0, _shortened(clean, limit)).otherwise(bind(F.array_min(hits), lambda hit: around(clean, hit)))

    return bind(collapse(text), shown)


def raw_document_id(source: Column, source_type: Column, external_id: Column) -> Column:
    return F.concat_ws(":", F.lower(source), source_type, external_id)


def memory_unit_id(document_id: Column, index: Column) -> Column:
    return F.concat(document_id, F.lit(":"), index.cast("string"))


def json_object(*fields: Column) -> Column:
    """JSON of the fields, nulls kept."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def parsed_json(text: Column) -> Column:
    """JSON as VARIANT; null, empty and invalid text give an empty object."""
    return F.coalesce(F.try_parse_json(F.nullif(text, F.lit(""))), F.parse_json(F.lit("{}")))
