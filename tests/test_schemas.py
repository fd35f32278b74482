import pytest

from loreweave.operators import schemas

NESTED = {"type": "object", "properties": {"a b": {"type": "array", "minItems": 1, "items": {"type": ["string", "null"], "minLength": 2}}, "n": {"type": "integer", "exclusiveMinimum": 0}, "e": {"type": ["object", "boolean", "number"], "enum": [{"x": [1]}, True, 2]}}, "required": ["n"], "additionalProperties": False}


def test_violations(spark):
    cases = {
        '{"n": 1}': None, '{"n": 1.0, "a b": ["xy", null]}': None, '{"n": 1.5}': "value.n has an invalid type", '{"n": 0}': "value.n violates exclusiveMinimum", "{}": "value.n is required", "[]": "value has an invalid type",
        "null": "value has an invalid type", "{": "no JSON", '{"n": 1, "a b": []}': "value.a b is shorter than minItems", '{"n": 1, "a b": ["xy", "x"]}': "value.a b[1] is shorter than minLength", '{"n": 1, "a b": [2]}': "value.a b[0] has an invalid type",
        '{"n": 1, "z": 0, "y": 0}': "value contains undeclared property: y", '{"n": 2, "e": {"x": [1]}}': None, '{"n": 2, "e": true}': None, '{"n": 2, "e": 2.0}': None, '{"n": 2, "e": 3}': "value.e is not an allowed enum value",
        '{"n": 2, "e": "true"}': "value.e has an invalid type", '{"n": null}': "value.n has an invalid type", '{"n": 12345678901234567890}': None,
    }
    df = spark.createDataFrame([(c,) for c in [*cases, None]], "c string")
    got = {r.c: r.violation for r in schemas.violations(df, NESTED, "c").collect()}
    assert got == {**cases, None: "no JSON"}


@pytest.mark.parametrize(
    ("schema", "says"),
    [
        ([], "must be an object"), ({}, "type is missing"), ({"type": "text"}, "unsupported"), ({"type": ["string", "string"]}, "unsupported"), ({"type": "object", "required": ["a"]}, "declared properties"),
        ({"type": "string", "minLength": -1}, "nonnegative"), ({"type": "string", "minLength": 3, "maxLength": 2}, "contradictory"), ({"type": "number", "minimum": "1"}, "must be a number"), ({"type": "string", "enum": []}, "enum"),
        ({"type": "object", "properties": {"a": {"type": "no"}}}, "schema.a.type"), ({"type": "string", "pattern": "x"}, "unknown field"), ({"type": "object", "additionalProperties": 1}, "boolean"),
    ],
)
def test_schemas_that_are_none(schema, says):
    with pytest.raises(ValueError, match=says):
        schemas.checked(schema)


def test_depth():
    deep = {"type": "string"}
    for _ in range(9):
        deep = {"type": "array", "items": deep}
    with pytest.raises(ValueError, match="depth"):
        schemas.checked(deep)
