"""Note keys and fingerprints, as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nfc(c: Column | str) -> Column:
    """Unicode NFC, by the ICU library that Spark itself brings along, so no Python worker is needed."""
    return F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.col(c) if isinstance(c, str) else c, F.lit(False))


def note_key(c: Column | str) -> Column:
    """A path as note key: NFC, U+00A0 as a space, case and all other blanks kept; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(nfc(F.coalesce(c, F.lit(""))), "\u00a0", " ")).otherwise(c)


def hex_number(c: Column | str) -> Column:
    """A hexadecimal number in one form: no blanks, no 0x, lower case, no leading zeros ('0' for zero).

    Null is null. What isn't a hexadecimal number is kept as it is, trimmed.
    """
    c = F.col(c) if isinstance(c, str) else c
    t = F.regexp_replace(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), "^0x", "")
    bare = F.regexp_replace(t, "^0+(?=.)", "")
    return F.when(t.rlike("^[0-9a-f]+$"), bare).otherwise(t)
