"""What the operators share in walking a schema: references, recursion, and which children a node has."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field


from docloom.plans.refs import resolve

MAX_DEPTH = 6


@dataclass
class Options:
    """Compile options.

    strict_draft4 follows the standard where the default keeps long-standing quirks: additionalProperties alone is
    enforced, uniqueItems: false is not, and enum and uniqueItems tell types apart.
    """

    ignore_additional_items: bool = False
    ignore_schema_only: bool = False
    loader: Callable[[str], dict] | None = None
    strict_draft4: bool = False
    #: Bounds also apply to numeric strings, booleans (1, 0) and null (0), as ECMAScript's comparisons do.
    js_coercion: bool = False
    #: Levels of a recursive reference that are unrolled to columns. Deeper documents are never passed silently: validator and normaliser
    #: take them to an evaluator of single values; handlers that are columns cannot go there, so the visit table reports
    #: them as depth_exceeded, folds and rewriters fail, and `RuntimeWalk` is the way for any depth.
    max_depth: int = MAX_DEPTH


@dataclass(frozen=True)
class Place:
    """Where the walk is in the schema: its document, and how often each referred node was entered."""

    document: dict
    entered: tuple[tuple[int, int], ...] = ()
    is_root: bool = True
    #: Whether the node was entered before, above itself; such a node is walked only where there is a value.
    again: bool = False

    @staticmethod
    def start(schema: dict) -> Place:
        return Place(schema, ((id(schema), 1),))

    def below(self) -> Place:
        return Place(self.document, self.entered, False)


class TooDeep(Exception):
    pass


def too_deep(options: Options) -> str:
    return f"depth_exceeded: content is nested deeper than max_depth={options.max_depth} of a recursive reference; a larger Options(max_depth=...) reaches it"


def follow(schema: dict, place: Place, options: Options) -> tuple[dict, Place]:
    """The schema that stands at a node, references resolved; TooDeep where recursion was unrolled far enough."""
    seen = 0
    while isinstance(schema, dict) and "$ref" in schema and isinstance(schema["$ref"], str):
        schema, document = resolve(place.document, schema["$ref"], options.loader)
        entered = dict(place.entered)
        entered[id(schema)] = entered.get(id(schema), 0) + 1
        seen += 1
        if entered[id(schema)] > options.max_depth + 1 or seen > 64:
            raise TooDeep
        place = Place(document, tuple(entered.items()), place.is_root, entered[id(schema)] > 1)
    return schema, place


@dataclass
class Children:
    """A node's structural children: schemas by role."""

    items: dict | None = None
    tuple_items: list[dict] = field(default_factory=list)
    properties: list[tuple[str, dict]] = field(default_factory=list)
    patterns: list[tuple[str, dict]] = field(default_factory=list)
    #: Schema of what is neither declared nor matched, stubs included; None where that is not walked.
    more_items: dict | None = None
    more_properties: dict | None = None


def _rest(schema: dict, keyword: str, stub: str) -> dict:
    own = schema.get(keyword)
    if own is False:
        return {stub: False}
    return own if isinstance(own, dict) else {stub: "allowed"}


def children(schema: dict, options: Options) -> Children:
    out = Children()
    items = schema.get("items")
    if isinstance(items, dict):
        out.items = items
    elif isinstance(items, list):
        out.tuple_items = items
        if not options.ignore_additional_items:
            out.more_items = _rest(schema, "additionalItems", "additionalItem")
    alone = options.strict_draft4 and schema.get("additionalProperties") is False
    if schema.get("properties") or schema.get("patternProperties") or schema.get("additionalProperties") or alone:
        out.properties = list((schema.get("properties") or {}).items())
        if not options.ignore_additional_items:
            out.patterns = list((schema.get("patternProperties") or {}).items())
            out.more_properties = _rest(schema, "additionalProperties", "additionalProperty")
    return out
