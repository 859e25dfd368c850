"""JSON Schema as a query over DataFrames: validate, normalise and walk documents in Spark."""

from docloom.api import compile_walk, new_iterator, new_normalizer, new_validator, source_of
from docloom.operators.normalize import Normalizer
from docloom.operators.render import form
from docloom.operators.validate import Validator
from docloom.operators.walk import STOP, Output, Walk
from docloom.plans.nodes import Options

__all__ = ["STOP", "Normalizer", "Options", "Output", "Validator", "Walk", "compile_walk", "form", "new_iterator", "new_normalizer", "new_validator", "source_of"]
