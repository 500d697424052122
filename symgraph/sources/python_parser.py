"""Symbols of Python source, by the standard ``ast`` module.

A class is its header; a function is its whole text. Calls are what a function's own body calls, decorators included;
definitions inside it speak for themselves. Overload stubs are no symbols.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
_OVERLOADS = {"overload", "typing.overload", "t.overload"}


def _aliases(tree: ast.Module) -> dict[str, str]:
    """What ``as`` names of imports stand for; a module stands for its last name."""
    out = {}
    for node in ast.walk(tree):
        if isinstance(node, ast.Import | ast.ImportFrom):
            for item in node.names:
                if item.asname and item.name != "*":
                    out[item.asname] = item.name if isinstance(node, ast.ImportFrom) else item.name.split(".")[-1]
    return out


def _dotted(node: ast.AST, aliases: dict[str, str]) -> str | None:
    """The dotted name that an expression goes by, as far as it has one."""
    tail: list[str] = []
    while True:
        match node:
            case ast.Attribute():
                tail.append(node.attr)
                node = node.value
            case ast.Call():
                node = node.func
            case ast.Subscript():
                node = node.value
            case ast.Name():
                return ".".join([aliases.get(node.id, node.id), *reversed(tail)])
            case _:
                return ".".join(reversed(tail)) or None


def _children(node: ast.AST) -> Iterator[ast.AST]:
    """Definitions directly or indirectly inside a node, not those inside other definitions, in source order of the body."""
    for child in ast.iter_child_nodes(node):
        if isinstance(child, _DEFS):
            yield child
        else:
            yield from _children(child)


def _called(body: list[ast.stmt], aliases: dict[str, str]) -> set[str]:
    names, todo = set(), list(body)
    while todo:
        node = todo.pop()
        if isinstance(node, _DEFS):
            continue
        if isinstance(node, ast.Call) and (name := _dotted(node.func, aliases)):
            names.add(name)
        todo += ast.iter_child_nodes(node)
    return names


def _header_end(node: ast.ClassDef) -> int:
    for child in node.body:
        if isinstance(child, _DEFS):
            return max(node.lineno, min([child.lineno, *[d.lineno for d in child.decorator_list]]) - 1)
    return node.end_lineno or node.lineno


def parse(path: str, source: str) -> list[dict]:
    """Symbols of a file in source order; none if it is blank or does not parse. Names may repeat."""
    if not source.strip():
        return []
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    aliases, text, out = _aliases(tree), source.splitlines(), []
    todo: list[tuple[ast.AST, tuple[str, ...], bool]] = [(n, (), False) for n in reversed(list(_children(tree)))]
    while todo:
        node, scope, in_class = todo.pop()
        is_class = isinstance(node, ast.ClassDef)
        decorators = {d for d in (_dotted(x, aliases) for x in node.decorator_list) if d}
        if not is_class and decorators & _OVERLOADS:
            continue
        end = node.end_lineno or node.lineno
        last = _header_end(node) if is_class else end
        code = "\n".join(text[node.lineno - 1 : last])
        out.append({
            "name": node.name, "qualified_name": ".".join((*scope, node.name)), "type": "class" if is_class else "method" if in_class else "function",
            "file_path": path, "language": "python", "start_line": node.lineno, "end_line": end, "docstring": ast.get_docstring(node),
            "source_code": code.rstrip() if is_class else code,
            "calls": sorted(decorators if is_class else decorators | _called(node.body, aliases)),
            "bases": [b for b in (_dotted(x, aliases) for x in node.bases) if b] if is_class else [],
        })
        # a definition directly in a class body, or under a condition there, is the class's own
        todo += [(n, (*scope, node.name), is_class) for n in reversed(list(_children(node)))]
    return out
