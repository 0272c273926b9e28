"""Fields of snippets that are JSON, `key: value` pairs or bracketed pairs: one parser, with types and places of faults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_KEY = r"[A-Za-z_][\w.-]*"
_VALUE = r"\"[^\"]*\"|'[^']*'|\[[^\]]*\]|\{[^}]*\}|[^,;\[\]{}\"'\s][^,;\[\]{}\"']*"
_PAIR = rf"\s*({_KEY})\s*[:=]\s*({_VALUE})\s*"
_OPEN = r"^\s*[{\[]?"
_ROUND = r"^\s*\((.*)\)\s*$"
_PREFIX = rf"{_OPEN}{_PAIR}(?:[,;]{_PAIR})*"
_WHOLE = rf"{_PREFIX}[,;]?\s*[}}\]]?\s*$"
_TYPES = (("STRING", "string"), ("BOOLEAN", "boolean"), ("VOID", "null"), ("OBJECT", "object"), ("ARRAY", "array"))


def _json_type(value: Column) -> Column:
    shape, told = F.schema_of_variant(value), F.lit("number")
    for start, name in _TYPES:
        told = F.when(shape.startswith(start), name).otherwise(told)
    return told


def _text_type(value: Column) -> Column:
    return (
        F.when(value.rlike(r"^[\"']"), "string").when(value.startswith("["), "array").when(value.startswith("{"), "object")
        .when(value.rlike(r"^(?i:true|false)$"), "boolean").when(value.rlike(r"^(?i:null|none|undefined)$"), "null")
        .when(value.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), "number").otherwise("string")
    )


def parsed(text: Column) -> Column:
    """struct(kind, fields map<string, struct<type, value>>, fault) of a snippet.

    kind: json (an object), pairs, or text that has no fields. fault: the place, from 1, of the first
    character that pairs can't go on with; 0 if there is none, and for JSON. Of a repeated key the
    first counts; null is the empty text. Values are texts: without quotes, nested ones as written
    (of JSON, as JSON).
    """
    text = F.coalesce(text, F.lit(""))
    variant = F.try_parse_json(text)
    is_json = F.coalesce(F.schema_of_variant(variant).startswith("OBJECT"), F.lit(False))
    members = F.try_variant_get(F.when(is_json, variant), "$", "map<string,variant>")
    scalar = lambda v: F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))
    from_json = F.transform_values(members, lambda _, v: F.struct(_json_type(v).alias("type"), F.when(_json_type(v) != "null", scalar(v)).alias("value")))

    whole = text
    text = F.when(whole.rlike(_ROUND), F.regexp_extract(whole, _ROUND, 1)).otherwise(whole)
    before = F.when(whole.rlike(_ROUND), F.instr(whole, "(")).otherwise(0)
    head = F.regexp_extract(text, _PREFIX, 0)
    keys, values = (F.regexp_extract_all(F.regexp_replace(head, _OPEN, ""), F.lit(_PAIR), F.lit(i)) for i in (1, 2))
    values = F.transform(values, lambda v: F.rtrim(v))
    every = F.zip_with(keys, values, lambda k, v: F.struct(k.alias("key"), F.struct(_text_type(v).alias("type"), F.regexp_replace(v, r"^([\"'])(.*)\1$", "$2").alias("value")).alias("value")))
    first = F.filter(every, lambda e, i: F.array_position(keys, e["key"]) == i + 1)
    pairs = F.map_from_entries(first)
    some = F.length(head) > 0
    kind = F.when(is_json, "json").when(some, "pairs").otherwise("text")
    fault = F.when(is_json | text.rlike(_WHOLE) | (F.trim(text) == ""), 0).otherwise(before + F.length(head) + 1)
    none = F.map_from_entries(F.array().cast("array<struct<key:string,value:struct<type:string,value:string>>>"))
    return F.struct(kind.alias("kind"), F.when(is_json, from_json).when(some, pairs).otherwise(none).alias("fields"), fault.alias("fault"))
