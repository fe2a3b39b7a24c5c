"""Python sources, read exactly with ``ast``."""

from __future__ import annotations

import ast

from .lexical import Definition

_DEF = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)


def _dotted(node: ast.AST) -> str | None:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


def read(text: str) -> tuple[list[Definition], list[tuple], list[tuple], list[tuple]] | None:
    """As ``lexical.read``; None if the text is no Python."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return None
    starts = [0]
    raw = text.encode()
    for k, b in enumerate(raw):
        if b == 10:
            starts.append(k + 1)

    def offset(line: int, col: int) -> int:
        """Character offset of a (line, byte column) place."""
        return len(raw[: starts[line - 1] + col].decode("utf-8", "replace"))

    defs, calls, imports, bases = [], [], [], []

    def walk(node: ast.AST, owner: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            inner = owner
            if isinstance(child, _DEF):
                first = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                col = child.col_offset
                is_class = isinstance(child, ast.ClassDef)
                kind = "decorated_definition" if child.decorator_list else "class_definition" if is_class else "function_definition"
                start, end = offset(first, col), offset(child.end_lineno, child.end_col_offset)
                defs.append(Definition(child.name, kind, "class" if is_class else "function", start, end))
                if is_class:
                    bases.extend((child.name, b, "extends", offset(child.lineno, col)) for b in map(_dotted, child.bases) if b and b != "object")
                inner = child.name
            elif isinstance(child, ast.Call):
                f = child.func
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                if name and not name.startswith("__"):
                    calls.append((owner, name, offset(child.lineno, child.col_offset)))
            elif isinstance(child, ast.Import):
                imports.extend((a.name.split(".")[-1], a.name) for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                module = "." * child.level + (child.module or "")
                imports.extend((a.name if a.name != "*" else module.split(".")[-1], module) for a in child.names)
            walk(child, inner)

    walk(tree, None)
    defs.sort(key=lambda d: (d.start, -d.end))
    return defs, calls, list(dict.fromkeys(imports)), bases
