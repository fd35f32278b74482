"""JSON schemas compiled to one Column that names the first violation of each row.

``checked`` refuses a schema that is none; ``violation`` compiles it. Values are
variants, so nested objects and lists are tested where the rows are, without
Python. Order of the tests: type, enum, required properties, declared properties
in the schema's order, undeclared ones, length, items, bounds. Numbers are
compared as doubles, whole ones by their type.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# The types of a schema, its keys, and the bounds of its depth and enums.
TYPES = {"object", "array", "string", "number", "integer", "boolean", "null"}
KEYS = {"type", "properties", "required", "additionalProperties", "items", "enum", "minLength", "maxLength", "minItems", "maxItems", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "description", "title"}
SIZES, BOUNDS = ("minLength", "maxLength", "minItems", "maxItems"), ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum")
MOST_DEPTH, MOST_ENUM = 8, 100


def types_of(schema: dict) -> list[str]:
    kind = schema.get("type")
    return [kind] if isinstance(kind, str) else list(kind)


def checked(schema, at: str = "schema", depth: int = 0) -> dict:
    """The schema, or an error that names the first thing wrong in it."""
    whole = lambda x: isinstance(x, int) and not isinstance(x, bool)
    if depth > MOST_DEPTH:
        raise ValueError("schema exceeds the depth budget")
    if not isinstance(schema, dict):
        raise ValueError(f"{at} must be an object")
    if unknown := sorted(set(schema) - KEYS):
        raise ValueError(f"{at} has unknown field {unknown[0]}")
    kind = schema.get("type")
    names = [kind] if isinstance(kind, str) else kind
    if not isinstance(names, list) or not names or len(set(map(str, names))) < len(names) or not set(map(str, names)) <= TYPES:
        raise ValueError(f"{at}.type is missing or unsupported")
    properties = schema.get("properties", {})
    if not isinstance(properties, dict):
        raise ValueError(f"{at}.properties must be an object")
    required = schema.get("required", [])
    if not isinstance(required, list) or len(set(map(str, required))) < len(required) or not set(map(str, required)) <= set(properties):
        raise ValueError(f"required must list distinct declared properties at {at}")
    if not isinstance(schema.get("additionalProperties", True), bool):
        raise ValueError(f"{at}.additionalProperties must be a boolean")
    if "enum" in schema and not (isinstance(schema["enum"], list) and 0 < len(schema["enum"]) <= MOST_ENUM):
        raise ValueError(f"enum must contain 1 to {MOST_ENUM} values at {at}")
    for key in SIZES:
        if key in schema and not (whole(schema[key]) and schema[key] >= 0):
            raise ValueError(f"{key} must be a nonnegative integer at {at}")
    for key in BOUNDS:
        if key in schema and (isinstance(schema[key], bool) or not isinstance(schema[key], int | float)):
            raise ValueError(f"{key} must be a number at {at}")
    for what in ("Length", "Items"):
        if schema.get(f"min{what}", 0) > schema.get(f"max{what}", schema.get(f"min{what}", 0)):
            raise ValueError(f"contradictory bounds at {at}")
    for name, child in properties.items():
        checked(child, f"{at}.{name}", depth + 1)
    if "items" in schema:
        checked(schema["items"], f"{at}.items", depth + 1)
    return schema


def _is(value: Column, kind: str) -> Column:
    """Whether a variant is of a JSON type."""
    name = F.schema_of_variant(value)
    number = name.rlike(r"^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)")
    double = F.try_variant_get(value, "$", "double")
    test = {
        "object": F.startswith(name, F.lit("OBJECT")), "array": F.startswith(name, F.lit("ARRAY")), "string": name == "STRING", "boolean": name == "BOOLEAN", "null": F.is_variant_null(value),
        "number": number, "integer": (name == "BIGINT") | number & (double % 1 == 0),
    }
    return F.coalesce(test[kind], F.lit(False))


def _equals(value: Column, allowed) -> Column:
    if isinstance(allowed, bool):
        return _is(value, "boolean") & (F.try_variant_get(value, "$", "boolean") == allowed)
    if allowed is None:
        return _is(value, "null")
    if isinstance(allowed, int | float):
        return _is(value, "number") & (F.try_variant_get(value, "$", "double") == float(allowed))
    if isinstance(allowed, str):
        return _is(value, "string") & (F.try_variant_get(value, "$", "string") == allowed)
    return F.to_json(value) == json.dumps(allowed, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _member(value: Column, name: str) -> Column:
    quoted = name.replace("\\", "\\\\").replace("'", "\\'")
    return F.try_variant_get(value, f"$['{quoted}']", "variant")


def violation(schema: dict, value: Column, at: str | Column = "value") -> Column:
    """The first violation of a schema by a variant, null where there is none; a value that is missing has an invalid type."""
    at = F.lit(at) if isinstance(at, str) else at
    says = lambda text: F.concat(at, F.lit(text))
    any_of = lambda tests: F.coalesce(*[F.when(t, True) for t in tests], F.lit(False))
    tests = [F.when(~any_of([_is(value, k) for k in types_of(schema)]), says(" has an invalid type"))]
    if "enum" in schema:
        tests.append(F.when(~any_of([_equals(value, a) for a in schema["enum"]]), says(" is not an allowed enum value")))
    properties = schema.get("properties", {})
    inside = [F.when(_member(value, name).isNull(), says(f".{name} is required")) for name in schema.get("required", [])]
    for name, child in properties.items():
        here = _member(value, name)
        inside.append(F.when(here.isNotNull(), violation(child, here, F.concat(at, F.lit(f".{name}")))))
    if schema.get("additionalProperties") is False:
        declared = F.array(*[F.lit(n) for n in properties]) if properties else F.array().cast("array<string>")
        extra = F.array_sort(F.array_except(F.json_object_keys(F.to_json(value)), declared))
        inside.append(F.when(F.size(extra) > 0, F.concat(at, F.lit(" contains undeclared property: "), F.get(extra, F.lit(0)))))
    if inside:
        tests.append(F.when(_is(value, "object"), F.coalesce(*inside)))
    text, items = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "array<variant>")
    for what, kind, size in (("Length", "string", F.char_length(text)), ("Items", "array", F.size(items))):
        if f"min{what}" in schema:
            tests.append(F.when(_is(value, kind) & (size < schema[f"min{what}"]), says(f" is shorter than min{what}")))
        if f"max{what}" in schema:
            tests.append(F.when(_is(value, kind) & (size > schema[f"max{what}"]), says(f" exceeds max{what}")))
    if "items" in schema:
        each = F.transform(items, lambda x, i: violation(schema["items"], x, F.concat(at, F.lit("["), i.cast("string"), F.lit("]"))))
        tests.append(F.when(_is(value, "array"), F.get(F.filter(each, lambda x: x.isNotNull()), F.lit(0))))
    number = F.try_variant_get(value, "$", "double")
    broken = {"minimum": lambda b: number < b, "maximum": lambda b: number > b, "exclusiveMinimum": lambda b: number <= b, "exclusiveMaximum": lambda b: number >= b}
    tests += [F.when(_is(value, "number") & test(float(schema[key])), says(f" violates {key}")) for key, test in broken.items() if key in schema]
    return F.coalesce(*tests)


def violations(rows, schema: dict, column: str, to: str = "violation"):
    """``rows`` with ``to``: the first violation by a JSON column, ``no JSON`` where it cannot be parsed."""
    schema = checked(schema)
    value = F.try_parse_json(F.col(column))
    return rows.withColumn(to, F.when(value.isNull(), "no JSON").otherwise(violation(schema, value)))
