"""JSON documents of any depth, without recursion of Python or its C stack."""

from __future__ import annotations

import json
import re

_SPACE = re.compile(r"[ \t\n\r]*")
_CLOSE = {"{": "}", "[": "]"}


def loads(text: str) -> object:
    """As ``json.loads``, whatever the depth; anything malformed is a ``ValueError``."""
    try:
        return json.loads(text)
    except RecursionError:
        return _parse(text)


def _parse(text: str) -> object:
    scan = json.JSONDecoder().scan_once

    def skip(i: int) -> int:
        return _SPACE.match(text, i).end()

    def leaf(i: int) -> tuple[object, int]:
        try:
            return scan(text, i)
        except StopIteration:
            raise ValueError(f"no value at {i}") from None

    def name(i: int) -> tuple[str, int]:
        if text[i : i + 1] != '"':
            raise ValueError(f"no name at {i}")
        key, i = leaf(i)
        i = skip(i)
        if text[i : i + 1] != ":":
            raise ValueError(f"no colon at {i}")
        return key, skip(i + 1)

    open_nodes, i = [], skip(0)
    while True:
        kind = text[i : i + 1]
        if kind in _CLOSE:
            value, key, i = {} if kind == "{" else [], None, skip(i + 1)
            if text[i : i + 1] != _CLOSE[kind]:
                if kind == "{":
                    key, i = name(i)
                open_nodes.append((value, key))
                continue
            i += 1
        else:
            value, i = leaf(i)
        # a whole value ends what stands around it, or is followed by another
        while True:
            i = skip(i)
            if not open_nodes:
                if i != len(text):
                    raise ValueError(f"more behind the value at {i}")
                return value
            node, key = open_nodes.pop()
            named = isinstance(node, dict)
            if named:
                node[key] = value
            else:
                node.append(value)
            mark = text[i : i + 1]
            if mark == ",":
                i = skip(i + 1)
                if named:
                    key, i = name(i)
                open_nodes.append((node, key))
                break
            if mark != ("}" if named else "]"):
                raise ValueError(f"no end at {i}")
            value, i = node, i + 1


def containers(root: object):
    """Every object and array of a document; what is put into one before the next is asked for is not entered."""
    stack = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, (dict, list)):
            yield node
            stack.extend(node.values() if isinstance(node, dict) else node)


def dumps(root: object) -> str:
    """As ``json.dumps`` without blanks and ASCII escapes, whatever the depth."""

    def plain(x: object) -> str:
        return json.dumps(x, separators=(",", ":"), ensure_ascii=False)

    try:
        return plain(root)
    except RecursionError:
        pass
    out, stack = [], [(False, root)]
    while stack:
        done, x = stack.pop()
        if done:
            out.append(x)
        elif isinstance(x, dict):
            parts = [(True, "{")]
            for n, (k, v) in enumerate(x.items()):
                parts += [(True, ("," if n else "") + plain(k) + ":"), (False, v)]
            stack += reversed([*parts, (True, "}")])
        elif isinstance(x, list):
            parts = [(True, "[")]
            for n, v in enumerate(x):
                parts += [(True, ",")] * (n > 0) + [(False, v)]
            stack += reversed([*parts, (True, "]")])
        else:
            out.append(plain(x))
    return "".join(out)
