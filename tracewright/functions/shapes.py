"""Shapes and sizes of JSON values: what is kept of content is its structure alone.

Values are variants.  A variant keeps what a number's spelling says of its type (1.0 is a
decimal, 1 an integer), which JSON text written from it no longer does.
"""

from __future__ import annotations

import hashlib
import hmac
import json
from decimal import Decimal

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, VariantVal


@F.arrow_udf(StringType())
def last_keys(texts: pa.Array) -> pa.Array:
    """JSON in which each object has each key once, with the value that came last; null for what isn't JSON."""

    def once(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(json.loads(text), ensure_ascii=False, allow_nan=False)
        except (ValueError, RecursionError):
            return None

    return pa.array([once(t) for t in texts.to_pylist()], pa.string())


def parsed(text: Column, plain: Column | None = None) -> Column:
    """Variant of a JSON text, null where it is none or larger than a variant may be.

    Spark refuses objects that repeat a key; such texts, and no others, are rewritten in
    Python first, so that the last of equal keys stands.  With ``plain``, a column of
    ``try_parse_json`` of the text, no other text is parsed again behind Python.
    """
    plain = F.try_parse_json(text) if plain is None else plain
    return F.coalesce(plain, F.try_parse_json(last_keys(F.when(plain.isNull(), text))))


def kind_of(value: Column) -> Column:
    """The variant's type as ``schema_of_variant`` names it, without what it holds: STRING, BIGINT, DECIMAL, OBJECT ..."""
    return _head(F.schema_of_variant(value))


def _head(schema: Column) -> Column:
    return F.substring_index(F.substring_index(schema, "<", 1), "(", 1)


def is_string(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def string_of(value: Column) -> Column:
    """A variant's string, null for any other type."""
    return F.when(is_string(value), F.try_variant_get(value, "$", "string"))


def type_code(value: Column) -> Column:
    """Code of a variant: b, s and its length, i, f, n, a or o and its size, or ?; n for null.

    Lengths count code points.  Numbers that are spelled with a point or an exponent are f;
    so are integers of over 38 digits.
    """
    return _code(value, F.schema_of_variant(value))


def _code(value: Column, schema: Column) -> Column:
    """:func:`type_code` of a variant whose schema is known."""
    kind = _head(schema)
    number = F.try_variant_get(value, "$", "decimal(38,0)")
    beyond_long = F.endswith(schema, F.lit(",0)")) & (F.abs(number) > F.lit(2**63 - 1).cast("decimal(38,0)"))
    return (
        F.when(value.isNull() | (schema == "VOID"), "n")
        .when(schema == "BOOLEAN", "b")
        .when(schema == "STRING", F.concat(F.lit("s"), F.length(F.try_variant_get(value, "$", "string"))))
        .when(schema == "BIGINT", "i")
        .when(kind == "ARRAY", F.concat(F.lit("a"), F.size(F.try_variant_get(value, "$", "array<variant>"))))
        .when(kind == "OBJECT", F.concat(F.lit("o"), F.size(F.try_variant_get(value, "$", "map<string,variant>"))))
        .when(kind == "DECIMAL", F.when(F.coalesce(beyond_long, F.lit(False)), "i").otherwise("f"))
        .when(kind.isin("DOUBLE", "FLOAT"), "f")
        .otherwise("?")
    )


def args_shape(value: Column) -> Column:
    """``key:code`` of an object's entries in key order, joined by commas; another value's
    bare code; null for null."""
    entries = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))  # null but for objects
    told = F.transform(entries, lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v"), F.schema_of_variant(e["value"]).alias("s")))
    coded = F.transform(told, lambda e: F.struct(e["k"].alias("k"), _code(e["v"], e["s"]).alias("c")))
    joined = F.array_join(F.transform(F.sort_array(coded), lambda e: F.concat(e["k"], F.lit(":"), e["c"])), ",")
    return F.when(value.isNull(), None).otherwise(F.coalesce(joined, type_code(value)))


#: What of a block's fields counts as text.
TEXTS = "struct<text:variant,thinking:variant,content:variant>"


def summed_chars(parts: Column) -> Column:
    """Summed lengths of the strings x and of the string ``text``, ``thinking`` and ``content``
    of the objects b among a list's members (x, b); null for null."""
    length = lambda x: F.coalesce(F.length(string_of(x)), F.lit(0))
    size = lambda p: F.when(p["b"].isNotNull(), length(p["b"]["text"]) + length(p["b"]["thinking"]) + length(p["b"]["content"])).otherwise(length(p["x"]))
    return F.aggregate(parts, F.lit(0), lambda t, p: t + size(p))


def content_chars(value: Column) -> Column:
    """Characters of message content: a string's length, or the summed lengths of a list's
    strings and of the string ``text``, ``thinking`` and ``content`` of its objects; else 0."""
    parts = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x: F.struct(x.alias("x"), F.try_variant_get(x, "$", TEXTS).alias("b")))
    return F.coalesce(summed_chars(parts), F.length(string_of(value)), F.lit(0)).cast("long")


def keyed_token(text: str | None, salt: str) -> str | None:
    """Keyed pseudonym ``t_`` and 12 hex digits; null for null or empty."""
    return f"t_{hmac.new(salt.encode(), text.encode(), 'sha256').hexdigest()[:12]}" if text else None


def token(value: Column, salt: str) -> Column:
    """:func:`keyed_token` of a column.  The salt travels in the function, so no plan shows it."""

    @F.pandas_udf("string")
    def keyed(values: pd.Series) -> pd.Series:
        return values.map(lambda v: keyed_token(v, salt))

    return keyed(value)


@F.arrow_udf(StringType())
def exact_signature(values: pa.Array) -> pa.Array:
    """Signature that is equal where variants are equal, whatever their key order; 1 and 1.0 differ at any depth.  Null for null.

    Spark's own text of a variant drops a decimal's zeros and a list's schema mixes its
    members' types, so this reads the variants.
    """

    def plain(v: object) -> object:
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        if isinstance(v, list):
            return [plain(x) for x in v]
        if isinstance(v, Decimal):
            return float(v) if v.as_tuple().exponent < 0 else int(v)
        return v

    def sign(v: dict | None) -> str | None:
        if v is None:
            return None
        text = json.dumps(plain(VariantVal(v["value"], v["metadata"]).toPython()), sort_keys=True)
        return "x" + hashlib.sha256(text.encode()).hexdigest()[:20]

    return pa.array([sign(v) for v in values.to_pylist()], pa.string())
