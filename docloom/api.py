"""The library's entry points."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import SparkSession

from docloom.operators.normalize import Normalizer
from docloom.operators.validate import Validator
from docloom.operators.walk import Walk
from docloom.plans.nodes import Options


def new_iterator(schema: dict, selectors, options: Options | None = None, **more) -> Walk:
    """A walk with selectors from a dict, or from a class or function that makes one."""
    if not isinstance(selectors, dict) and not callable(selectors):
        raise TypeError("selectors must be a dict, a class, or a function that returns one of them")
    made = selectors() if callable(selectors) else selectors
    if not isinstance(made, dict):
        made = {k: getattr(made, k) for k in dir(made)} | dict(getattr(made, "selectors", {}))
    return Walk(schema, {k: h for k, h in made.items() if callable(h)}, options or Options(), **more)


compile_walk = new_iterator


def new_validator(schema: dict, factory: Callable[..., Validator] = Validator, **options) -> Validator:
    return factory(schema, **options)


def source_of(df) -> str:
    """The physical plan that a compiled operator became, generated code included."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))


def new_normalizer(schema: dict) -> Normalizer:
    return Normalizer(schema)


def read_schema(spark: SparkSession, path: str) -> dict:
    """A schema from a JSON file, wherever Spark reads."""
    return json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))
