"""Phone and e-mail handles in one canonical spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_phone(raw: Column) -> Column:
    """E.164, with the Indian spellings of one mobile collapsed; else null.

    A bare or trunk-zero ten-digit mobile and its 91-prefixed form get the
    country code; any other number needs its own plus sign.
    """
    text = F.trim(raw.cast("string"))
    digits = F.regexp_replace(F.regexp_replace(text, r"[^0-9]", ""), r"^0+", "")
    return (
        F.when(digits.rlike(r"^[6-9][0-9]{9}$"), F.concat(F.lit("+91"), digits))
        .when(digits.rlike(r"^91[6-9][0-9]{9}$"), F.concat(F.lit("+"), digits))
        .when(
            text.startswith("+") & F.length(digits).between(8, 15),
            F.concat(F.lit("+"), digits),
        )
    )


def normalize_email(raw: Column) -> Column:
    """Trimmed lower case when it looks like an address; else null."""
    text = F.lower(F.trim(raw.cast("string"), F.lit(" \t\n\r\x0b\x0c")))
    usable = (
        text.contains("@")
        & ~text.contains(" ")
        & F.substring_index(text, "@", -1).contains(".")
    )
    return F.when(usable, text)
