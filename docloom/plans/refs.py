"""`$ref`: JSON pointers into the schema document, or into one that a loader gives."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote


def no_loader(uri: str) -> dict:
    raise ValueError(f"no loader is given for the remote reference {uri!r}")


def resolve(root: dict, ref: str, loader: Callable[[str], dict] | None = None) -> tuple[dict, dict]:
    """(the schema referred to, the document it is in)."""
    remote, _, pointer = unquote(ref).partition("#")
    document = (loader or no_loader)(remote) if remote else root
    node = document
    for part in pointer.split("/")[1:] if pointer else []:
        part = part.replace("~1", "/").replace("~0", "~")
        try:
            node = node[int(part)] if isinstance(node, list) else node[part]
        except (KeyError, IndexError, ValueError, TypeError):
            raise ValueError(f"the reference {ref!r} leads nowhere") from None
    return node, document
