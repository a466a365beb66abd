"""Pattern spelling: one portable expression, two engines.

The catalog is written for linear-time engines whose ``\\w``, ``\\d``, ``\\s`` and ``\\b``
are Unicode aware, whose ``$`` means end of text and whose line ends are ``\\n`` only.
``to_java`` pins the same meaning for the JVM; ``to_re2`` spells code points the way
RE2 engines (the SQL checks) read them.
"""

import re

_FLAGS = re.compile(r"^\(\?([a-z]+)\)")
_CODE_POINT = re.compile(r"\\u\{([0-9A-Fa-f]+)\}")


def to_re2(expression: str) -> str:
    return _CODE_POINT.sub(r"\\x{\1}", expression)


def _outside_classes(expression: str, change) -> str:
    """Apply ``change`` to every unescaped character that is not inside ``[...]``."""
    out, i, in_class = [], 0, False
    while i < len(expression):
        ch = expression[i]
        if ch == "\\":
            out.append(expression[i:i + 2])
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
            out.append(ch)
            # a ']' directly after the opening is a literal
            if expression[i + 1:i + 2] == "]":
                out.append("\\]")
                i += 1
        elif ch == "]" and in_class:
            in_class = False
            out.append(ch)
        else:
            out.append(ch if in_class else change(ch))
        i += 1
    return "".join(out)


def to_java(expression: str) -> str:
    found = _FLAGS.match(expression)
    flags = found.group(1) if found else ""
    body = to_re2(expression[found.end():] if found else expression)
    if "m" not in flags:
        body = _outside_classes(body, lambda ch: r"\z" if ch == "$" else ch)
    return f"(?Ud{flags}){body}"


def ignores_case(expression: str) -> bool:
    found = _FLAGS.match(expression)
    return bool(found) and "i" in found.group(1)


def literals_of(expression: str) -> list[str]:
    """The plain texts an expression stands for: one for plain text, one per member for a class
    that only lists code points, none for a real pattern."""
    listed = re.fullmatch(r"\[((?:\\u\{[0-9A-Fa-f]+\})+)\]", expression)
    if listed:
        return [chr(int(h, 16)) for h in _CODE_POINT.findall(listed.group(1))]
    found = _FLAGS.match(expression)
    if found and found.group(1) != "i":
        return []
    body = expression[found.end():] if found else expression
    if re.search(r"\\[A-Za-z0-9]", body):
        return []
    if re.search(r"[.^$*+?()\[\]{}|]", re.sub(r"\\[^A-Za-z0-9]", "", body)):
        return []
    return [re.sub(r"\\([^A-Za-z0-9])", lambda m: m.group(1), body)]
