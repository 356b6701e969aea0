"""Timestamps as text, in the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind, strip

LAYOUT = "yyyy-MM-dd HH:mm:ss"


def normalize_timestamp(value: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS`` from its first 19 characters, or those as they are."""

    def read(text: Column) -> Column:
        forms = [F.try_to_timestamp(text, F.lit(form)) for form in ("yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s")]
        return F.coalesce(F.date_format(F.coalesce(*forms), LAYOUT), text)

    return F.when(value.isNull() | (value == ""), "").otherwise(bind(F.substring(strip(value), 1, 19), read))


def format_timestamp(value: Column) -> Column:
    """Text of a JSON timestamp (VARIANT): ISO text, epoch seconds or milliseconds, or ``$date``."""
    kind, text = F.schema_of_variant(value), value.cast("string")
    number = text.try_cast("double")
    digits = text.rlike("^[0-9.]*[0-9][0-9.]*$")
    epoch = F.when(digits, F.date_format(F.timestamp_seconds(F.when(number > 1e12, number / 1000).otherwise(number)), LAYOUT))
    iso = F.split_part(F.replace(F.replace(text, F.lit("T"), F.lit(" ")), F.lit("Z"), F.lit("")), F.lit("."), F.lit(1))
    of_text = F.when(text == "", "").when(F.contains(text, F.lit("T")), iso).otherwise(F.coalesce(epoch, F.when(digits, F.substring(text, 1, 19)).otherwise(text)))
    millis = F.try_variant_get(value, '$["$date"]["$numberLong"]', "string").try_cast("bigint")
    of_object = F.coalesce(F.date_format(F.timestamp_millis(millis), LAYOUT), text)
    return (
        F.when(value.isNull() | F.is_variant_null(value), "")
        .when(kind == "STRING", of_text)
        .when(F.startswith(kind, F.lit("OBJECT")), of_object)
        .when(number == 0, "")
        .otherwise(F.coalesce(epoch, text))
    )
