"""JSON helpers for stored model responses and report columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A JSON object with at most one level of nested objects (first match). The
# quantifiers are possessive: the matcher neither backtracks nor recurses.
_WS = " \t\n\r\u000b\u000c"
BALANCED_OBJECT = "\\{[^{}]*+(?:\\{[^{}]*+\\}[^{}]*+)*+\\}"


def strip_fences(text: Column) -> Column:
    """Trim, drop a leading ```json or ``` fence and a trailing ``` fence."""
    t = F.trim(text, F.lit(_WS))
    t = F.when(t.startswith("```json"), F.substring(t, 8, 1 << 30)).otherwise(t)
    t = F.when(t.startswith("```"), F.substring(t, 4, 1 << 30)).otherwise(t)
    t = F.when(t.endswith("```"), F.substring(t, F.lit(1), F.length(t) - 3)).otherwise(t)
    return F.trim(t, F.lit(_WS))


def is_json_object(text: Column) -> Column:
    """True when the whole text parses as one JSON object."""
    return F.coalesce(F.get_json_object(text, "$").isNotNull() & F.trim(text).startswith("{"),
                      F.lit(False))
