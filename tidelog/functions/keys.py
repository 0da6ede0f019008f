"""Key values as text, for bounds that are kept between runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds that cannot be a key.
REFUSED = {"json", "jsonb", "bytea", "array", "map", "hstore"}


def key_text(c: Column, source_type: str) -> Column:
    """A key's text; a null key stops the query."""
    kind = source_type.strip().lower()
    if kind in REFUSED or kind.endswith("[]"):
        raise ValueError(f"a {source_type} cannot be a key")
    text = F.when(c, "t").otherwise("f") if kind in ("bool", "boolean") else c.cast("string")
    return F.when(c.isNull(), F.raise_error(F.lit("a key is null"))).otherwise(text)
