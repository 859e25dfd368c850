"""Cases of the draft-4 standard, keyword by keyword, through the lowered validator and the evaluator of single values."""

import json

from pyspark.sql import functions as F

from docloom import Validator
from docloom.functions.values import VariantValue
from docloom.plans.nodes import Options
from docloom.plans.pyeval import Evaluator

# schema, valid documents, invalid documents
CASES = [
    ({"type": "integer"}, ["1", "1.0", "-3"], ["1.1", '"1"', "{}", "[]", "true", "null"]),
    ({"type": "number"}, ["1", "1.1"], ['"a"', "{}", "[]", "true", "null"]),
    ({"type": "string"}, ['"a"', '""', '"1"'], ["1", "{}", "null"]),
    ({"type": "object"}, ["{}"], ["1", "[]", "null"]),
    ({"type": "array"}, ["[]"], ["{}", "1"]),
    ({"type": "boolean"}, ["true", "false"], ["0", '"true"', "null"]),
    ({"type": "null"}, ["null"], ["0", "false", '""', "{}"]),
    ({"type": ["integer", "string"]}, ["1", '"a"'], ["1.1", "{}", "null"]),
    ({"enum": [1, 2, 3]}, ["1", "3"], ["4", '"1"']),
    ({"enum": [6, "foo", [], True, {"foo": 12}]}, ["[]", '{"foo":12}', "true", '"foo"'], ["null", '{"foo":false}', '"true"']),
    ({"minimum": 1.1}, ["2.6", "1.1", '"x"'], ["0.6"]),
    ({"minimum": 1.1, "exclusiveMinimum": True}, ["1.2"], ["1.1"]),
    ({"maximum": 3}, ["2.6", "3", '"x"'], ["3.5"]),
    ({"maximum": 3, "exclusiveMaximum": True}, ["2.2"], ["3"]),
    ({"multipleOf": 2}, ["10", '"foo"', "0"], ["7"]),
    ({"multipleOf": 1.5}, ["0", "4.5"], ["35"]),
    ({"minLength": 2}, ['"foo"', '"fo"', "100"], ['"f"']),
    ({"maxLength": 2}, ['"f"', '"fo"', "10"], ['"foo"']),
    ({"pattern": "^a*$"}, ['"aaa"', '""', "true"], ['"abc"']),
    ({"pattern": "a+"}, ['"xxaayy"'], ['"xyz"']),
    ({"minItems": 1}, ["[1,2]", "[1]", '""'], ["[]"]),
    ({"maxItems": 2}, ["[1]", "[1,2]", '"foobar"'], ["[1,2,3]"]),
    ({"uniqueItems": True}, ["[1,2]", '[1,"1"]', "[1,true]", '[{"a":1},{"a":2}]', "[[1],[2]]"], ["[1,1]", '[{"a":1},{"a":1}]', '["x",2,"x"]', "[[1],[1]]"]),
    ({"minProperties": 1}, ['{"a":1,"b":2}', '{"a":1}', '""'], ["{}"]),
    ({"maxProperties": 1}, ["{}", '{"a":1}', '""'], ['{"a":1,"b":2}']),
    ({"required": ["a", "b"]}, ['{"a":1,"b":null}', "[]", "1"], ['{"a":1}', "{}"]),
    ({"properties": {"a": {"type": "integer"}, "b": {"type": "string"}}}, ['{"a":1,"b":"x"}', "{}", '{"c":[]}', "[]", "12"], ['{"a":"x"}', '{"a":1,"b":{}}']),
    ({"properties": {"a": {}}, "patternProperties": {"^v": {"type": "integer"}}, "additionalProperties": False}, ['{"a":1}', '{"vroom":2}', "[1]", '"x"'], ['{"a":1,"q":1}', '{"vroom":"x"}']),
    ({"additionalProperties": {"type": "boolean"}}, ['{"q":true}', "{}"], ['{"q":12}']),
    ({"patternProperties": {"a*": {"type": "integer"}, "aaa*": {"maximum": 20}}}, ['{"a":21}', '{"aaaa":18}', '{"a":21,"aaaa":18}'], ['{"a":"bar"}', '{"aaaa":31}', '{"aaa":"foo","aaaa":31}']),
    ({"items": {"type": "integer"}}, ["[1,2]", "[]", '{"0":"x"}'], ['[1,"x"]']),
    ({"items": [{"type": "integer"}, {"type": "string"}]}, ['[1,"x"]', "[1]", '[1,"x",true]', "[]"], ['["x",1]']),
    ({"items": [{}, {}], "additionalItems": False}, ["[1,2]", "[]", "[1]"], ["[1,2,3]"]),
    ({"items": [{}], "additionalItems": {"type": "integer"}}, ["[null,2]"], ['[null,"x"]']),
    ({"items": {}, "additionalItems": False}, ["[1,2,3]"], []),
    ({"dependencies": {"b": ["a"]}}, ["{}", '{"a":1}', '{"a":1,"b":2}', "12"], ['{"b":2}']),
    ({"dependencies": {"b": {"properties": {"a": {"type": "integer"}}}}}, ['{"a":1,"b":2}', '{"a":"x"}'], ['{"a":"x","b":2}']),
    ({"allOf": [{"required": ["a"]}, {"properties": {"b": {"type": "string"}}}]}, ['{"a":1,"b":"x"}', '{"a":1}'], ['{"b":"x"}', '{"a":1,"b":2}']),
    ({"anyOf": [{"type": "integer"}, {"minimum": 2}]}, ["1", "2.5"], ["1.5"]),
    ({"oneOf": [{"type": "integer"}, {"minimum": 2}]}, ["1", "2.5"], ["3", "1.5"]),
    ({"not": {"type": ["integer", "boolean"]}}, ['"x"'], ["1", "true"]),
    ({"not": {"properties": {"a": {"type": "string"}}, "required": ["a"]}}, ['{"a":1}', "{}"], ['{"a":"x"}']),
    ({"definitions": {"n": {"type": "integer"}}, "properties": {"a": {"$ref": "#/definitions/n"}}}, ['{"a":1}'], ['{"a":"x"}']),
    ({"definitions": {"a~b/c%d": {"type": "integer"}}, "properties": {"t": {"$ref": "#/definitions/a~0b~1c%25d"}}}, ['{"t":1}'], ['{"t":"x"}']),
    ({"items": [{"type": "integer"}, {"$ref": "#/items/0"}]}, ["[1,2]"], ['[1,"x"]']),
    ({"properties": {"a": {"$ref": "#"}}, "additionalProperties": False}, ['{"a":false}', '{"a":{"a":false}}'], ['{"b":false}', '{"a":{"b":false}}']),
]


def test_cases(spark):
    options = Options(strict_draft4=True, max_depth=2)
    wrong, asked, columns = [], [], []
    for schema, good, bad in CASES:
        for text, valid in [(t, True) for t in good] + [(t, False) for t in bad]:
            asked.append((schema, text, valid))
            columns.append(~Validator(schema, options).piece(VariantValue(F.parse_json(F.lit(text))), want_errors=False).bad)
            if (not Evaluator(schema, options).errors(json.loads(text))) != valid:
                wrong.append(("evaluator", schema, text))
    got = spark.range(1).select(F.array(*columns).alias("valid")).first()["valid"]
    wrong += [(schema, text) for (schema, text, valid), is_valid in zip(asked, got, strict=True) if is_valid != valid]
    assert not wrong, wrong
