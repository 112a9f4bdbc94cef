"""Masks by field name, for card numbers in text, and over nested columns or JSON text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as P

from .text import mask_sensitive

# Parts of a name that make its field sensitive, by the kind of mask, in the order in which they are tried.
FIELD_KINDS = (
    ("password", ("password", "pwd", "passwd")),
    ("token", ("token", "jwt")),
    ("api_key", ("api_key", "apikey", "secret")),
    ("phone", ("phone", "mobile", "telephone")),
    ("id_card", ("id_card", "idcard", "identity", "ssn")),
    ("email", ("email", "mail")),
    ("card", ("credit_card", "card_number", "cvv")),
    ("default", ("api-key", "private_key", "cell", "authorization", "bearer")),
)
# What replaces a field that is hidden whole.
PLACEHOLDERS = {"password": "***", "token": "***TOKEN***", "api_key": "***API_KEY***", "phone": "***PHONE***", "email": "***EMAIL***", "id_card": "***ID_CARD***", "card": "***CARD***", "default": "***REDACTED***"}

PHONE = r"1[3-9]\d{9}"
IDENTITY = r"[1-9]\d{5}(?:(?:18|19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx]|\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3})"
ADDRESS = r"[a-zA-Z0-9._%+-]+@(?:[a-zA-Z0-9-]+\.)+[a-zA-Z]{2,}"


def field_kind(name: str) -> str | None:
    """The kind of mask that a field's name asks for."""
    return next((kind for kind, parts in FIELD_KINDS if any(p in name.lower() for p in parts)), None)


def _ends(value: Column, first: int, stars: Column, last: int) -> Column:
    return F.concat(F.substring(value, 1, first), stars, F.right(value, F.lit(last)))


def _stars(n: Column) -> Column:
    return F.repeat(F.lit("*"), n.cast("int"))


def mask_field(kind: str, value: Column) -> Column:
    """The value of a field of that kind: hidden whole, or in part where it has the form that the kind expects. Null stays null."""
    if kind in ("password", "token", "api_key", "default"):
        return F.when(value.isNotNull(), PLACEHOLDERS[kind])
    if kind == "card":
        digits = F.regexp_extract(F.regexp_replace(value, r"[\s-]", ""), r"\d{13,19}", 0)
        hidden = F.concat(_stars(F.length(digits) - 4), F.right(digits, F.lit(4)))
        whole = F.when(F.length(digits) == 16, F.regexp_replace(hidden, "(.{4})(?=.)", "$1 ")).otherwise(hidden)
        return F.when(value.isNotNull(), F.when(digits == "", PLACEHOLDERS[kind]).otherwise(whole))
    pattern = {"phone": PHONE, "id_card": IDENTITY, "email": ADDRESS}[kind]
    found = F.regexp_extract(value, pattern, 0)
    if kind == "email":
        local = F.substring_index(found, "@", 1)
        shown = F.when(F.length(local) > 2, _ends(local, 1, _stars(F.length(local) - 2), 1)).otherwise(F.concat(F.substring(local, 1, 1), F.lit("*")))
        shown = F.concat(shown, F.lit("@"), F.substring_index(found, "@", -1))
    elif kind == "phone":
        shown = _ends(found, 3, F.lit("****"), 4)
    else:
        shown = _ends(found, 6, _stars(F.length(found) - 10), 4)
    return F.when(value.isNotNull(), F.when(found == "", PLACEHOLDERS[kind]).otherwise(F.replace(value, found, shown)))


def mask_value(value: Column, kind: P.DataType, name: str) -> Column:
    """A value of any type: structs field by field, arrays and maps value by value, text by its name or, without one, by its content.
    Other values under a sensitive name are nulled, as a placeholder would change their type."""
    if isinstance(kind, P.StructType):
        inner = F.struct(*[mask_value(value.getField(f.name), f.dataType, f.name).alias(f.name) for f in kind.fields])
        return F.when(value.isNotNull(), inner)
    if isinstance(kind, P.ArrayType):
        return F.transform(value, lambda x: mask_value(x, kind.elementType, name))
    if isinstance(kind, P.MapType):
        return F.transform_values(value, lambda k, x: mask_value(x, kind.valueType, name))
    sensitive = field_kind(name)
    if isinstance(kind, P.StringType):
        return mask_field(sensitive, value) if sensitive else mask_sensitive(value)
    return F.lit(None).cast(kind) if sensitive else value


def mask_rows(df: DataFrame) -> DataFrame:
    """Every column masked, nested ones to their leaves; the schema stays."""
    return df.select(*[mask_value(F.col(f"`{f.name}`"), f.dataType, f.name).alias(f.name) for f in df.schema.fields])


def mask_json(text: Column, schema: str) -> Column:
    """JSON text of the given schema, masked; null where it can't be read."""
    parsed = P.DataType.fromDDL(schema)
    return F.to_json(mask_value(F.from_json(text, parsed), parsed, ""))
