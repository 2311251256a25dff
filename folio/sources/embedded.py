"""Content inside data addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decoded(uri: Column | str) -> Column:
    """Bytes of a ``data:`` address, base64 or percent-encoded; null for anything else or for broken content."""
    c = F.col(uri) if isinstance(uri, str) else uri
    body = F.regexp_extract(c, r"^data:[^,]*,([\s\S]*)$", 1)
    return F.when(
        c.rlike(r"(?i)^data:[^,]*,"),
        F.when(c.rlike(r"(?i)^data:[^,]*;base64,"), F.try_to_binary(F.regexp_replace(body, r"\s", ""), F.lit("base64"))).otherwise(F.encode(F.try_url_decode(body), "UTF-8")),
    )
