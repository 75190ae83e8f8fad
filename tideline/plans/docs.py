"""Documentation of specifications: lines that begin with ``##`` or ``---`` before a definition describe it."""

from __future__ import annotations

from dataclasses import dataclass

from tideline.plans.syntax import parse_spec

_KINDS = {"def": "Definitions", "type": "Types", "in": "Inputs", "module": "Modules"}


@dataclass(frozen=True)
class Doc:
    kind: str
    name: str  # with the modules it is in
    signature: str  # the head of the definition, as it is written
    text: str
    line: int


def documented(text: str) -> list[Doc]:
    """What a specification defines, in order, with its description (empty if it has none); local definitions are left out."""
    lines, out = text.splitlines(), []

    def described(line: int) -> str:
        found, k = [], line - 2
        while k >= 0 and lines[k].strip().startswith("@"):  # annotations stand between
            k -= 1
        while k >= 0 and lines[k].strip().startswith(("##", "---")):
            found.append(lines[k].strip().lstrip("#-").strip())
            k -= 1
        return "\n".join(reversed(found))

    def visit(statements: list[tuple], inside: str) -> None:
        for s in statements:
            if s[0] not in _KINDS:
                continue
            head = _head(lines, s[-1], s[0])
            out.append(Doc(s[0], inside + s[1], head, described(s[-1]), s[-1]))
            if s[0] == "module":
                visit(s[2], f"{inside}{s[1]}.")

    visit(parse_spec(text), "")
    return out


def _head(lines: list[str], line: int, kind: str) -> str:
    """The source from a definition's keyword to its "=" or "{" outside brackets, or to the end of its line."""
    rest = "\n".join(lines[line - 1 :])
    start = rest.find(kind)
    depth, quoted = 0, False
    for i in range(start, len(rest)):
        c = rest[i]
        if c == '"':
            quoted = not quoted
        elif not quoted:
            if depth == 0 and (c == "=" and rest[i : i + 2] != "=>" or c == "\n" or c == "#" or c == "{" and kind == "module"):
                return " ".join(rest[start:i].split())
            depth += (c in "([{") - (c in ")]}")
    return " ".join(rest[start:].split())


def markdown(docs: list[Doc]) -> str:
    """A section for each kind, in the order of the source."""
    out = []
    for kind, title in _KINDS.items():
        own = [d for d in docs if d.kind == kind]
        if own:
            out.append(f"# {title}\n")
            out += [f"## {d.name}\n\n```\n{d.signature}\n```\n" + (f"\n{d.text}\n" if d.text else "") for d in own]
    return "\n".join(out)
