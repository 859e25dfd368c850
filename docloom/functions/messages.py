"""Default messages by error code; their %d and %s stay as they are."""

from __future__ import annotations

from collections.abc import Callable

# fixed values: codes and texts
DEFAULT_MESSAGES: dict[str, str] = {
    "string": "shall be a string",
    "null": "shall be null",
    "minLength": "shall have length at least %d",
    "maxLength": "shall have length no more than %d",
    "pattern": "shall match pattern %s",
    "integer": "shall be an integer",
    "multipleOf": "shall be multiple of %d",
    "number": "shall be a number",
    "minimum": "shall be >= %d",
    "minimum.exclusive": "shall be > %d",
    "maximum": "shall be <= %d",
    "maximum.exclusive": "shall be < %d",
    "boolean": "shall be boolean",
    "object": "shall be object",
    "additionalProperties": "shall not have additional properties",
    "minProperties": "shall have at least %d properties",
    "maxProperties": "shall have no more than %d properties",
    "array": "shall be array",
    "additionalItems": "shall not have additional items",
    "minItems": "shall have at least %d items",
    "maxItems": "shall have no more %d items",
    "uniqueItems": "shall have unique items",
    "enum": "shall be one of values %s",
    "required": "is required",
    "dependency": "does not meet additional requirements for %s",
    "not": "does not meet 'not' requirement",
    "oneOf": "does not meet exactly one requirement",
    "oneOf.zero": "does not meet any requirement",
    "allOf": "does not meet all requirements",
    "anyOf": "does not meet any requirement",
    "custom": "is not valid",
}


class Messages:
    """Message lookup of one validator: a schema's own text, the catalogue's, or the error's argument."""

    def __init__(self, catalogue: dict[str, str] | None = None, gettext: Callable[[str], str] | None = None):
        self.gettext = gettext or (lambda s: s)
        self.catalogue = {k: self.gettext(v) for k, v in DEFAULT_MESSAGES.items()} if catalogue is None else catalogue

    def text(self, code: str, own: dict[str, str] | None, arg) -> str:
        if own and own.get(code):
            return self.gettext(own[code])
        found = self.catalogue.get(code) or arg
        if not found:
            raise ValueError(f"no message is registered for the error {code!r}")
        return found if isinstance(found, str) else str(found)
