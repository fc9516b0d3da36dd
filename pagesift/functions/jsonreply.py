"""Model-reply parsing: JSON span, strict validity, shape guard, typed records.

Spark's JSON readers accept trailing text and read only the first value, so
strictness comes from a small Arrow-batched check over ``json.loads``; values
come from ``from_json`` with a declared schema; shape from the span's first
character.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Greedy span from the first '[' or '{' to the last ']' or '}' across lines.
SPAN = r"(?s)[\[{].*[\]}]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def reply_span(raw) -> Column:
    """The JSON candidate inside a reply ('' when there is none). A leading
    code fence and trailing backticks never hold brackets, so the span is the
    same with or without stripping them."""
    return F.regexp_extract(_c(raw), SPAN, 0)


def valid_json(s) -> bool:
    """Whether a text is exactly one JSON value."""
    if s is None or s == "":
        return False
    try:
        json.loads(s)
        return True
    except (ValueError, RecursionError):
        return False


@F.pandas_udf(T.BooleanType())
def _strict_valid(span: pd.Series) -> pd.Series:
    return span.map(valid_json).astype(bool)


# Not to be pushed below a projection and so evaluated twice.
_strict_valid = _strict_valid.asNondeterministic()


def json_strict_valid(span) -> Column:
    """True when the whole text is exactly one JSON value (Python rules)."""
    return _strict_valid(_c(span))


def parse_list_reply(span, kind, schema: T.StructType) -> Column:
    """Listing replies: array of records; anything but a valid array → [].
    Non-object elements are dropped; scalars inside objects become strings."""
    elems = F.from_json(_c(span), T.ArrayType(T.StringType()))
    objs = F.filter(elems, lambda e: F.ltrim(e).startswith("{"))
    recs = F.transform(objs, lambda e: F.from_json(e, schema))
    return F.when(_c(kind) == "array", recs).otherwise(
        F.array().cast(T.ArrayType(schema)))


def parse_object_reply(span, kind, schema: T.StructType) -> Column:
    """Detail/file replies: one record; anything but a valid object → null
    (an empty record)."""
    return F.when(_c(kind) == "object", F.from_json(_c(span), schema))
