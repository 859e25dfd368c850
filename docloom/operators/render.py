"""A client of the walk: HTML forms for documents and their schema."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.values import Value
from docloom.operators.walk import STOP, Cursor, Output, Walk
from docloom.plans.nodes import Options


def _name(cursor: Cursor) -> Column:
    """a[b][0]"""
    rest = [F.when(p == "[]", p).otherwise(F.concat(F.lit("["), p, F.lit("]"))) for p in cursor.path[1:]]
    return F.concat(*cursor.path[:1], *rest)


def _text(v: Value | None) -> Column:
    if v is None:
        return F.lit(None).cast("string")
    return F.when(v.absent, F.lit(None).cast("string")).otherwise(v.canonical())


def _select(schema: dict, v: Value | None, c: Cursor) -> Output:
    chosen = _text(v)
    options = [F.concat(F.lit(f"<option value='{x}' "), F.when(chosen == str(x), "selected").otherwise(""), F.lit(f">{x}</option>\n")) for x in schema["enum"]]
    return Output(F.concat(F.lit("<select  name='"), _name(c), F.lit("'>\n"), *options, F.lit("</select>\n")), stop=True)


def _input(schema: dict, v: Value | None, c: Cursor) -> Column:
    value = F.coalesce(F.concat(F.lit(" value='"), _text(v), F.lit("'")), F.lit(""))
    return F.concat(F.lit("<input type='string'"), value, F.lit(" name='"), _name(c), F.lit("'"))


SELECTORS = {
    "[type=array]:start": lambda s, v, c: "<fieldset>\n",
    "[type=array]:end": lambda s, v, c: "</fieldset>\n",
    ":item": lambda s, v, c: F.concat(F.lit("<div id='"), _name(c), F.lit("'>\n")),
    ":item-end": lambda s, v, c: F.concat(F.lit("<button onclick='document.getElementById(\""), _name(c), F.lit("\").remove();'>Delete</button>\n</div>\n")),
    "[enum]": _select,
    "[enum]:end": lambda s, v, c: STOP,
    "[type=string]": _input,
    "[required]": lambda s, v, c: " required ",
    "[type=string]:end": lambda s, v, c: ">\n",
}


def form(schema: dict, ignore_additional_items: bool = True) -> Walk:
    """A walk whose fold is the form of a document."""
    return Walk(schema, SELECTORS, Options(ignore_additional_items=ignore_additional_items))
