"""Links back to a note, as JVM expressions. Nothing about links is stored."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from notefold.functions.keys import note_key
from notefold.functions.text import WHITE, js_trim

SCHEME = "obsidian://open"


def encode_strict(c: Column) -> Column:
    """Percent-encoding that leaves only letters, digits and ``- _ . ~``."""
    form = F.url_encode(c)  # form encoding: a blank is +, * stays, ~ is encoded
    return F.replace(F.replace(F.replace(form, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def strip_heading(c: Column) -> Column:
    """A heading as links write it: ``%%``, ``[[``, ``]]`` and each of ``: # | ^ \\`` as a blank, blanks collapsed."""
    return js_trim(F.regexp_replace(F.regexp_replace(c, r"%%|\[\[|\]\]|[:#|^\\]", " "), f"[{WHITE}]+", " "))


def heading_part(heads: Column, repeats: Column) -> Column:
    """The deepest heading, or the whole chain joined by ``#`` where the deepest repeats; null if a part is empty."""
    chain = F.transform(heads, strip_heading)
    deepest = F.try_element_at(chain, F.lit(-1))
    whole = F.when(F.forall(chain, lambda h: h != ""), F.array_join(chain, "#"))
    return F.when(deepest != "", F.when(F.coalesce(repeats, F.lit(False)), whole).otherwise(deepest))


def build_link(vault: Column, key: Column, heads: Column, repeats: Column, recovered: Column) -> Column:
    """The link to a passage's heading; null if the vault is unknown or the file's name has a ``#``."""
    file = note_key(key)
    heading = F.when(~F.coalesce(recovered, F.lit(False)), heading_part(heads, repeats))
    target = F.when(heading.isNotNull(), F.concat(file, F.lit("#"), heading)).otherwise(file)
    link = F.concat(F.lit(f"{SCHEME}?vault="), encode_strict(vault), F.lit("&file="), encode_strict(target))
    return F.when((vault != "") & ~F.contains(key, F.lit("#")), link)
