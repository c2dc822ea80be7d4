"""Arrow-batched helpers for what Spark has no function for: NFKC, case folding, JSON arrays.

Spark bounds a batch by rows and bytes; within it, no more than a few rows are held as Python strings at once.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_ROWS = 64
_THINK = re.compile(r"<think\b[^>]*>.*?</think\s*>", re.IGNORECASE | re.DOTALL)


def fold(text: str | None) -> str:
    """NFKC, case folded, single spaces."""
    return " ".join(unicodedata.normalize("NFKC", text or "").casefold().split())


def first_json_array(text: str | None) -> str | None:
    """The first JSON array of a model answer without its thinking blocks, as JSON text."""
    body = _THINK.sub("", text or "").strip()
    decoder = json.JSONDecoder()
    at = body.find("[")
    while at >= 0:
        try:
            value, _ = decoder.raw_decode(body[at:])
        except json.JSONDecodeError:
            value = None
        if isinstance(value, list):
            return json.dumps(value, ensure_ascii=False)
        at = body.find("[", at + 1)
    return None


def identity(text: str | None) -> str:
    """Letters and digits only, NFKC, case folded."""
    norm = unicodedata.normalize("NFKC", text or "").casefold()
    return " ".join("".join(c if c.isalnum() else " " for c in norm).split())


def each(values: pa.Array, work: Callable, kind: pa.DataType) -> pa.Array:
    """``work`` on every value; only ``SLICE_ROWS`` at a time are Python strings, the rest of a batch stays Arrow bytes."""
    parts = [
        pa.array([work(v) for v in values.slice(at, SLICE_ROWS).to_pylist()], kind) for at in range(0, len(values), SLICE_ROWS)
    ]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


@F.arrow_udf(T.StringType())
def fold_text(s: pa.Array) -> pa.Array:
    return each(s, fold, pa.string())


@F.arrow_udf(T.ArrayType(T.StringType()))
def fold_all(s: pa.Array) -> pa.Array:
    return each(s, lambda a: [fold(x) for x in a or []], pa.list_(pa.string()))


@F.arrow_udf(T.StringType())
def json_array(s: pa.Array) -> pa.Array:
    return each(s, first_json_array, pa.string())


@F.arrow_udf(T.StringType())
def identity_text(s: pa.Array) -> pa.Array:
    return each(s, identity, pa.string())


@F.arrow_udf(T.StringType())
def nfkc(s: pa.Array) -> pa.Array:
    return each(s, lambda t: unicodedata.normalize("NFKC", t or ""), pa.string())
