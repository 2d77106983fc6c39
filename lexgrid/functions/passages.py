"""Passages of a text: the snippet that covers most query terms, page ends that fall between sentences, sections of text
with numbered headings."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Places looked at for each term; what each term and each further match counts.
CENTRES, TERM_WORTH, MATCH_MOST = 64, 100, 10


def window_snippet(text: str | None, query: str, most: int = 220) -> str:
    """The window of `most` characters with the most query terms, cut at sentences or blanks, with ellipses where it is cut."""
    flat = re.sub(r"\s+", " ", text or "").strip()
    if len(flat) <= most:
        return flat
    low = flat.lower()
    terms = list(dict.fromkeys(t for t in re.findall(r"\w+", query.lower()) if len(t) >= 3))
    best, best_start = -1, 0
    for term in terms:
        for n, m in enumerate(re.finditer(re.escape(term), low)):
            if n >= CENTRES:
                break
            start = max(0, min(m.start() - most // 2, len(flat) - most))
            window = low[start : start + most]
            counts = [window.count(t) for t in terms]
            worth = sum(TERM_WORTH + min(c, MATCH_MOST) for c in counts if c)
            if worth > best:
                best, best_start = worth, start
    start, end = best_start, min(len(flat), best_start + most)
    if start:
        lead = flat.find(". ", start, start + most // 4)
        blank = flat.find(" ", start, start + most // 4)
        covered = [low.find(t, start, end) for t in terms if low.find(t, start, end) >= 0]
        limit = min(covered, default=end)
        start = lead + 2 if 0 <= lead and lead + 2 <= limit else blank + 1 if 0 <= blank and blank + 1 <= limit else start
    if end < len(flat):
        blank = flat.rfind(" ", start + most // 2, end)
        ends = max([low.rfind(t, start, end) + len(t) for t in terms if low.rfind(t, start, end) >= 0], default=0)
        end = blank if blank >= ends else end
    return ("… " if start else "") + flat[start:end].strip() + (" …" if end < len(flat) else "")


@pandas_udf(StringType())
def snippet_udf(text: pd.Series, query: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([window_snippet(t, q, m) for t, q, m in zip(text, query, most, strict=True)])


def readable_end(text: str, offset: int, size: int) -> int:
    """End of a page: within the last 30 % of it after a blank line, else a newline, else a sentence; else its full size."""
    end = min(offset + size, len(text))
    if end == len(text):
        return end
    least = offset + size - int(size * 0.3)
    for mark in ("\n\n", "\n", ". ", "! ", "? "):
        at = text.rfind(mark, least, end)
        if at >= 0:
            return at + len(mark)
    return end


def line_end(text: str, offset: int, size: int) -> int:
    """The same for line-oriented text: after the last newline of the second half."""
    end = min(offset + size, len(text))
    at = text.rfind("\n", offset + size // 2, end)
    return end if end == len(text) or at < 0 else at + 1


def pages(text: str, size: int, end=readable_end) -> list[dict]:
    """All pages of a text; their contents join to the text again."""
    out, offset = [], 0
    while offset < len(text) or not out:
        stop = end(text, offset, size)
        out.append({"offset": offset, "content": text[offset:stop], "total": len(text), "truncated": stop < len(text), "next_offset": stop if stop < len(text) else None})
        if stop >= len(text):
            break
        offset = stop
    return out


_HEADING = re.compile(r"^(#{1,6})\s+(.*?)\s*#*$")


def _headings(lines: list[str]) -> list[tuple[int, int, str]]:
    out, fenced = [], False
    for i, line in enumerate(lines):
        fenced ^= line.startswith("```")
        if not fenced and (m := _HEADING.match(line)):
            out.append((i, len(m[1]), m[2]))
    return out


def _plain_heading(text: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[*_`\[\]]", " ", text)).strip().lower()


def markdown_section(text: str, wanted: str) -> tuple[str, bool]:
    """(section, found): from its heading to the next one of its level or higher; the whole text if it is missing."""
    lines = text.split("\n")
    heads = _headings(lines)
    for k, (i, level, title) in enumerate(heads):
        if _plain_heading(title) == _plain_heading(wanted):
            stop = next((j for j, other, _ in heads[k + 1 :] if other <= level), len(lines))
            return "\n".join(lines[i:stop]).strip(), True
    return text, False


def wikitext_section(source: str, wanted: str) -> tuple[str, bool]:
    lines = source.split("\n")
    heads = [(i, len(m[1]), m[2]) for i, line in enumerate(lines) if (m := re.fullmatch(r"\s*(={1,6})\s*(.*?)\s*\1\s*", line))]
    for k, (i, level, title) in enumerate(heads):
        if _plain_heading(title) == _plain_heading(wanted):
            stop = next((j for j, other, _ in heads[k + 1 :] if other <= level), len(lines))
            return "\n".join(lines[i:stop]).strip(), True
    return source, False


def outline(text: str, most: int = 200) -> tuple[list[dict], bool]:
    """(level and heading of the first `most` headings, whether there are more)."""
    heads = _headings(text.split("\n"))
    return [{"level": level, "heading": title} for _, level, title in heads[:most]], len(heads) > most
