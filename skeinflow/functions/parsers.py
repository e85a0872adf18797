"""Structure of source texts: units with their lines, by a registry of parsers that callers can add to.

Markdown is parsed in full and Python by its own grammar; other languages by line scanners, which is an approximation of a real parser.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from typing import NamedTuple


class Unit(NamedTuple):
    kind: str
    name: str
    start: int
    end: int
    exported: bool


Parser = Callable[[str], list[Unit]]
_REGISTRY: dict[str, Parser] = {}


def register_parser(extension: str, parser: Parser) -> None:
    """Use ``parser`` for files that end in ``extension``."""
    _REGISTRY[extension.lower().lstrip(".")] = parser


def supported() -> list[str]:
    return sorted(_REGISTRY)


def parse(content: str, path: str) -> list[Unit] | None:
    """The units of a file by start, or None where there is no parser or the text doesn't parse."""
    parser = _REGISTRY.get(path.rsplit(".", 1)[-1].lower()) if "." in path else None
    if parser is None:
        return None
    try:
        return sorted(parser(content), key=lambda u: u.start)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def markdown(content: str) -> list[Unit]:
    """Front matter at the top, fenced blocks, and a section for every header outside them, up to the next one."""
    lines = content.split("\n")
    out: list[Unit] = []
    at = 0
    if lines and lines[0].strip() == "---":
        close = next((i for i in range(1, len(lines)) if lines[i].strip() == "---"), None)
        if close is None:
            return out
        out.append(Unit("constant", "frontmatter", 1, close + 1, False))
        at = close + 1
    fence: tuple[int, str] | None = None
    heads: list[tuple[int, int, str]] = []
    for n in range(at, len(lines)):
        if m := re.match(r"```(\w*)", lines[n]):
            if fence is None:
                fence = (n + 1, m.group(1) or "text")
            else:
                out.append(Unit("function", f"codeblock:{fence[1]}", fence[0], n + 1, False))
                fence = None
        elif fence is None and (m := re.match(r"(#{1,6})\s+(.+)$", lines[n])):
            heads.append((n + 1, len(m.group(1)), m.group(2).strip()))
    for (start, level, title), after in zip(heads, [*(h[0] for h in heads[1:]), len(lines) + 1]):
        out.append(Unit("class", title, start, after - 1, level == 1))
    if fence:
        out.append(Unit("function", f"codeblock:{fence[1]}", fence[0], len(lines), False))
    return out


def python(content: str) -> list[Unit]:
    """Functions, classes, methods and upper-case constants; a name without a leading underscore is exported."""
    out = []

    def visit(body: list, owner: str) -> None:
        for node in body:
            start = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                out.append(Unit("method" if owner else "function", f"{owner}{node.name}", start, node.end_lineno, not node.name.startswith("_")))
            elif isinstance(node, ast.ClassDef):
                out.append(Unit("class", node.name, start, node.end_lineno, not node.name.startswith("_")))
                visit(node.body, f"{node.name}.")
            elif isinstance(node, ast.Assign) and not owner and isinstance(node.targets[0], ast.Name) and node.targets[0].id.isupper():
                out.append(Unit("constant", node.targets[0].id, start, node.end_lineno, True))

    visit(ast.parse(content).body, "")
    return out


def _strip(line: str) -> str:
    """A line without strings and line comments, for counting braces."""
    return re.sub(r"//.*$|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|`[^`]*`", "", line)


def block_end(lines: list[str], start: int) -> int:
    """Number of the line that closes the braces opened from line index ``start`` on; of the statement's end where none opens."""
    depth, opened = 0, False
    for n in range(start, len(lines)):
        code = _strip(lines[n])
        for c in code:
            depth += (c == "{") - (c == "}")
            opened |= c == "{"
        if opened and depth <= 0:
            return n + 1
        if not opened and (code.rstrip().endswith(";") or (n > start and not code.strip())):  # without braces: up to a semicolon or a blank line
            return n + 1
    return len(lines)


def indent_end(lines: list[str], start: int) -> int:
    """Number of the last line of the indented block that line index ``start`` heads."""
    margin = len(lines[start]) - len(lines[start].lstrip())
    last = start
    for n in range(start + 1, len(lines)):
        if lines[n].strip():
            if len(lines[n]) - len(lines[n].lstrip()) <= margin:
                break
            last = n
    return last + 1


class Rule(NamedTuple):
    kind: str
    pattern: re.Pattern
    exported: Callable[[str, str], bool]


def _rules(*specs: tuple[str, str, Callable[[str, str], bool]]) -> list[Rule]:
    return [Rule(k, re.compile(p), e) for k, p, e in specs]


_exports = lambda line, name: bool(re.match(r"\s*export\b", line))
_capital = lambda line, name: name[:1].isupper()
_public = lambda line, name: bool(re.match(r"\s*(?:pub|public)\b", line))
_SCRIPT = _rules(
    ("class", r"\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>\w+)", _exports),
    ("function", r"\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>\w+)", _exports),
    ("constant", r"(?:export\s+)?(?:const|let|var)\s+(?P<name>\w+)\s*(?::[^=]+)?=", _exports),
    ("interface", r"\s*(?:export\s+)?interface\s+(?P<name>\w+)", _exports),
    ("type", r"\s*(?:export\s+)?type\s+(?P<name>\w+)\s*(?:<[^>]*>)?\s*=", _exports),
)
_GO = _rules(("function", r"func\s+(?:\([^)]*\)\s*)?(?P<name>\w+)", _capital), ("class", r"type\s+(?P<name>\w+)\s+(?:struct|interface)", _capital), ("constant", r"(?:const|var)\s+(?P<name>\w+)", _capital))
_RUST = _rules(("function", r"\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(?P<name>\w+)", _public), ("class", r"\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+(?P<name>\w+)", _public), ("constant", r"\s*(?:pub\s+)?(?:const|static)\s+(?P<name>\w+)", _public))
_JAVA = _rules(("class", r"\s*(?:public|private|protected|static|final|abstract|\s)*(?:class|interface|enum|record)\s+(?P<name>\w+)", _public), ("method", r"\s+(?:public|private|protected|static|final|synchronized|abstract|override|virtual|async)\s[\w\s<>\[\],.?]*?(?P<name>\w+)\s*\([^;]*$", _public))
_PHP = _rules(("class", r"\s*(?:final\s+|abstract\s+)?(?:class|interface|trait)\s+(?P<name>\w+)", lambda line, name: True), ("function", r"\s*(?:(?:public|private|protected|static)\s+)*function\s+(?P<name>\w+)", lambda line, name: "private" not in line))


def scanner(rules: list[Rule]) -> Parser:
    """A parser that looks for the first rule that fits a line and ends the unit where its braces close."""

    def units(content: str) -> list[Unit]:
        lines = content.split("\n")
        out: list[Unit] = []
        owner: Unit | None = None
        for n, line in enumerate(lines):
            if line.lstrip().startswith(("//", "*", "/*", "#")):
                continue
            for rule in rules:
                if m := rule.pattern.match(line):
                    u = Unit(rule.kind, m.group("name"), n + 1, block_end(lines, n), rule.exported(line, m.group("name")))
                    if owner and u.start <= owner.end and rule.kind in ("function", "method"):
                        u = u._replace(kind="method", name=f"{owner.name}.{u.name}")
                    elif rule.kind == "class":
                        owner = u
                    out.append(u)
                    break
        return out

    return units


for _e in ("md", "mdx", "markdown"):
    register_parser(_e, markdown)
register_parser("py", python)
for _e in ("ts", "tsx", "js", "jsx", "mjs", "cjs"):
    register_parser(_e, scanner(_SCRIPT))
register_parser("go", scanner(_GO))
register_parser("rs", scanner(_RUST))
for _e in ("java", "cs"):
    register_parser(_e, scanner(_JAVA))
register_parser("php", scanner(_PHP))


def repo_map(content: str, path: str) -> str | None:
    """The units of a file as a tree of their first lines, private ones marked."""
    found = parse(content, path)
    if not found:
        return None
    lines = content.split("\n")
    out = [path]
    for u in found:
        depth = 2 if u.kind == "method" else 1
        out.append("  " * depth + lines[u.start - 1].strip().rstrip("{:").rstrip()[:100] + ("" if u.exported else " (private)"))
    return "\n".join(out)


def signatures(content: str, path: str) -> str:
    """What a text declares: headers of prose, declarations of code, else the start of its first line that says something."""
    lines = content.split("\n")
    if path.lower().endswith((".md", ".mdx", ".markdown")):
        heads = [x.rstrip() for x in lines if re.match(r"#{1,6}\s", x)]
        return "\n".join(heads) if heads else next((x.strip()[:100] for x in lines if x.strip()), "")
    found = parse(content, path)
    if found:
        return "\n".join(("  " if u.kind == "method" else "") + re.sub(r"\s*[{:]\s*$", "", lines[u.start - 1].strip())[:160] for u in found)
    first = next((x.strip() for x in lines if x.strip() and not x.strip().startswith(("//", "#", "*", "/*", "import", "from", "package", "use "))), lines[0].strip() if lines else "")
    return first[:100] + ("..." if len(first) > 100 else "")
