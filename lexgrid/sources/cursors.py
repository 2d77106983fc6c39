"""Durable cursors of scans: which units of a source are done, in or out of order."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"


def base36(n: int) -> str:
    out = ""
    while True:
        n, r = divmod(n, 36)
        out = DIGITS[r] + out
        if not n:
            return out


@dataclass
class SparseCursor:
    """Units below `next` are done, and those in `extra`. As text: a plain number, or v1:next:extras in base 36."""

    total: int
    next: int = 0
    extra: set[int] = field(default_factory=set)

    @classmethod
    def parse(cls, text: str, total: int) -> SparseCursor:
        if re.fullmatch(r"[0-9]*", text):
            cursor = cls(total, int(text or 0))
        elif m := re.fullmatch(r"v1:([0-9]+):([0-9a-z]+(?:,[0-9a-z]+)*)", text):
            cursor = cls(total, int(m[1]), {int(x, 36) for x in m[2].split(",")})
        else:
            raise ValueError(f"no cursor: {text!r}")
        if cursor.next > total or any(not cursor.next < x < total for x in cursor.extra):
            raise ValueError(f"the cursor {text!r} does not fit {total} units")
        return cursor

    def completed(self, unit: int) -> bool:
        return unit < self.next or unit in self.extra

    def complete(self, unit: int) -> None:
        if not self.completed(unit):
            self.extra.add(unit)
        while self.next in self.extra:
            self.extra.discard(self.next)
            self.next += 1

    @property
    def done(self) -> int:
        return self.next + len(self.extra)

    def __str__(self) -> str:
        return f"v1:{self.next}:{','.join(map(base36, sorted(self.extra)))}" if self.extra else str(self.next)


def place(text: str, fields: int) -> tuple[int, ...]:
    """A cursor of so many numbers separated by colons; the start for an empty one."""
    if not text:
        return (0,) * fields
    parts = text.removeprefix("f1:").split(":")
    if len(parts) != fields or not all(p.isdigit() for p in parts):
        raise ValueError(f"no cursor of {fields} numbers: {text!r}")
    return tuple(map(int, parts))
