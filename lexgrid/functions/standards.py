"""Standards texts (numbered plain-text documents) to Markdown, their sections, status and relationships."""

from __future__ import annotations

import re

from lexgrid.functions.markup import READ

_NUMBERED = re.compile(r"^(\d+(?:\.\d+)*)\.?\s{1,3}(\S.*)$")
_APPENDIX = re.compile(r"^Appendix\s+([A-Z](?:\.\d+)*)\.?\s*(.*)$", re.I)
#: Headings that stand alone without a number.
NAMED = {"abstract", "status of this memo", "copyright notice", "table of contents", "acknowledgments", "acknowledgements", "references", "normative references", "informative references", "authors' addresses", "author's address", "contributors", "index"}
_MENTION = re.compile(r"\bRFC[ -]?0*(\d{1,5})\b", re.I)


def heading(line: str, before: str, after: str) -> tuple[int, str, str] | None:
    """(level, anchor, title) of a heading line between blank lines."""
    if line != line.lstrip() or before.strip() or after.strip():
        return None
    text = line.strip()
    if m := _NUMBERED.match(text):
        return (2 + m[1].count("."), m[1], m[2]) if len(m[2]) <= 100 and not m[2].endswith(("....", ".")) else None
    if m := _APPENDIX.match(text):
        return 2 + m[1].count("."), f"appendix-{m[1].lower()}", m[2]
    return (2, re.sub(r"\W+", "-", text.lower()).strip("-"), text) if text.lower() in NAMED else None


def linked(text: str, own: str, dataset: str) -> str:
    return _MENTION.sub(lambda m: m[0] if m[1] == own else f"[{m[0]}]({READ}?dataset={dataset}&id={m[1]})", text)


def markdown(number: str, title: str, text: str, relationships: list[dict] = (), status: str = "", dataset: str = "rfc") -> str:
    lines = text.replace("\f", "\n").replace("\r", "").split("\n")
    out = [f"# RFC {number}: {title}", ""]
    if status:
        out += [f"**Status:** {status}", ""]
    for r in relationships:
        out += [f"**{r['type'].replace('_', ' ').capitalize()}:** [{r['target']}]({READ}?dataset={dataset}&id={r['target'].removeprefix('RFC ')})", ""]
    for i, line in enumerate(lines):
        found = heading(line, lines[i - 1] if i else "", lines[i + 1] if i + 1 < len(lines) else "")
        if found:
            level, anchor, name = found
            out.append(f"{'#' * min(level, 6)} {anchor + ' ' if anchor[0].isdigit() else ''}{name}")
        else:
            out.append(linked(line, number, dataset))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip() + "\n"


def sections(text: str) -> list[dict]:
    """Headings of the Markdown of a standard: line, level, anchor, heading."""
    out = []
    for i, line in enumerate(text.split("\n")):
        if m := re.match(r"^(#{2,6})\s+(.*)$", line):
            number = re.match(r"^(\d+(?:\.\d+)*)\s+", m[2])
            out.append({"line": i, "level": len(m[1]), "anchor": number[1] if number else re.sub(r"\W+", "-", m[2].lower()).strip("-"), "heading": m[2]})
    return out


def section(text: str, wanted: str) -> tuple[str, bool]:
    """A section by number, anchor or heading, with its subsections; empty if it is missing."""
    key = re.sub(r"^(section|§)\s*", "", wanted.strip().lower()).rstrip(".").lstrip("#")
    lines, found = text.split("\n"), sections(text)
    for k, s in enumerate(found):
        if key in (s["anchor"], s["heading"].lower(), re.sub(r"^[\d.]+\s+", "", s["heading"].lower())):
            stop = next((o["line"] for o in found[k + 1 :] if o["level"] <= s["level"]), len(lines))
            return "\n".join(lines[s["line"] : stop]).strip(), True
    return "", False


def lifecycle(status: str, obsoleted_by: list[str]) -> str:
    if obsoleted_by:
        return "obsoleted"
    low = (status or "").strip().lower()
    return low if low in ("historic", "experimental", "informational") else "current"


def relationships(entry: dict) -> list[dict]:
    """type and target of each related document."""
    return [{"type": kind, "target": t} for kind in ("obsoletes", "obsoleted_by", "updates", "updated_by", "also", "see_also") for t in entry.get(kind) or ()]
