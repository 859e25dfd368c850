"""Patterns of the schema language (ECMAScript) as Java patterns, for `rlike`, and as Python ones."""

from __future__ import annotations

#: White space and line ends that \s and . know in ECMAScript.
_SPACES = r"\t\n\x0B\f\r \xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_LINE_ENDS = r"\n\r\x{2028}\x{2029}"


def to_java(pattern: str) -> str:
    """The same pattern in Java's syntax; both find a match anywhere unless anchored."""
    out, i, n, in_class = [], 0, len(pattern), False
    while i < n:
        c = pattern[i]
        if c == "\\" and i + 1 < n:
            d = pattern[i + 1]
            i += 2
            if d == "/":
                out.append("/")
            elif d == "s":
                out.append(_SPACES if in_class else f"[{_SPACES}]")
            elif d == "S":
                out.append(f"&&[^{_SPACES}]" if in_class and out[-1] == "[" else f"[^{_SPACES}]")
            elif d == "u" and pattern[i : i + 1] == "{":
                end = pattern.index("}", i)
                out.append(f"\\x{{{pattern[i + 1 : end]}}}")
                i = end + 1
            elif d == "0" and not pattern[i : i + 1].isdigit():
                out.append("\\x00")
            elif d == "v":
                out.append("\\x0B")
            elif d == "d":
                out.append("0-9" if in_class else "[0-9]")
            elif d in "-_\"'!@#%&=:;,<>~` " or (d.isalpha() and d not in "bBcdDfnrstuvwWxk"):
                out.append(d if d.isalnum() or d in "_\"'!@%=:;,<>~` " else "\\" + d)
            else:
                out.append("\\" + d)
            continue
        if in_class:
            if c == "]":
                in_class = False
                out.append(c)
            elif c == "[":
                out.append("\\[")
            elif c == "&" and pattern[i + 1 : i + 2] == "&":
                out.append("\\&")
            else:
                out.append(c)
        elif c == "[":
            if pattern.startswith("[^]", i):
                out.append(r"[\s\S]")
                i += 3
                continue
            if pattern.startswith("[]", i):
                out.append("(?!)")
                i += 2
                continue
            in_class = True
            out.append("[")
            if pattern[i + 1 : i + 2] == "^":
                out.append("^")
                i += 1
        elif c == "$":
            out.append(r"\z")
        elif c == ".":
            out.append(f"[^{_LINE_ENDS}]")
        else:
            out.append(c)
        i += 1
    return "".join(out)


def to_python(pattern: str) -> str:
    """The same pattern for Python's re: only the meaning of $ and of Java's braced escapes differs."""
    out = to_java(pattern).replace(r"\z", r"\Z")
    parts = out.split("\\x{")
    return parts[0] + "".join(chr_escape(p) for p in parts[1:])


def chr_escape(part: str) -> str:
    code, rest = part.split("}", 1)
    return f"\\U{int(code, 16):08x}{rest}"
