"""Suffix-array dedup: removes every byte covered by a 200-byte string that also starts anywhere else.

The suffixes that are sorted are those that begin at a shared anchor (see spans), each content once: suffixes that are
equal as far as their windows go are merged before, by a hash of 128 bits, and repeat as a whole. Deep-shallow sorting:
multikey quicksort to a shallow depth; what still agrees there goes into a blind trie, which compares whole suffixes only
where an insertion needs it. Common beginnings of neighbours, and the bytes before the anchor, give the maximal matches.
Anchors with too many suffixes for one task are made longer until they are not.

Edge cases: a null text counts as empty. Texts shorter than the length lose nothing. Matches never cross documents.
Repeated rows are copies of each other and lose what they share, like any other. Bytes left over may not be valid
UTF-8, so they are returned as binary. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from lexgrid.llm import spans
from lexgrid.runtime import map_rows

LENGTH = 200
GRAM = 32
SHALLOW = 24
#: Bytes compared at once by the quicksort.
STEP = 4
_BYTE = spans.mix((np.arange(256).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


class Node:
    __slots__ = ("depth", "children", "leaf")

    def __init__(self, depth: int, children: dict | None, leaf: int) -> None:
        self.depth, self.children, self.leaf = depth, children, leaf


def blind_trie(texts: list[bytes], members: list[int]) -> tuple[list[int], list[int]]:
    """(members in order, lengths that neighbours share). Inner nodes keep a depth and the bytes that differ there."""
    root: Node | None = None
    for m in members:
        text = texts[m]
        if root is None:
            root = Node(len(text), None, m)
            continue
        node, path = root, []
        while node.children is not None:
            path.append(node)
            node = node.children.get(text[node.depth : node.depth + 1]) or next(iter(node.children.values()))
        other = texts[node.leaf]
        depth = spans.common(text, other)
        path.append(node)
        above = None
        for at in path:
            if at.depth > depth or at.children is None:
                break
            above = at
        else:
            at = None
        mine = Node(len(text), None, m)
        if above is not None and above.depth == depth:
            key = text[depth : depth + 1]
            # texts that are equal throughout share the empty key
            while key in above.children:
                key += b"\0\0"
            above.children[key] = mine
            continue
        keys = other[depth : depth + 1], text[depth : depth + 1]
        split = Node(depth, {keys[0]: at, (keys[1] if keys[1] != keys[0] else keys[1] + b"\0\0"): mine}, -1)
        if above is None:
            root = split
        else:
            above.children[text[above.depth : above.depth + 1]] = split
    order, shared, todo = [], [], [(root, 0)]
    while todo:
        node, depth = todo.pop()
        if node.children is None:
            if order:
                shared.append(depth)
            order.append(node.leaf)
        else:
            children = [node.children[k] for k in sorted(node.children)]
            todo += [(c, node.depth) for c in children[:0:-1]] + [(children[0], depth)]
    return order, shared


def deep_shallow(texts: list[bytes], start: int = 0, shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """(order, lengths that neighbours share) of texts that agree in their first `start` bytes."""
    order: list[int] = []
    shared: list[int] = []
    todo: list[tuple[list[int], int]] = [(list(range(len(texts))), start)]
    while todo:
        members, depth = todo.pop()
        if len(members) == 1 or depth >= start + shallow:
            mine, lengths = (members, []) if len(members) == 1 else blind_trie(texts, members)
            if order:
                shared.append(spans.common(texts[order[-1]], texts[mine[0]]))
            order += mine
            shared += lengths
            continue
        pivot = texts[members[len(members) // 2]][depth : depth + STEP]
        less, same, more = [], [], []
        for m in members:
            key = texts[m][depth : depth + STEP]
            (less if key < pivot else more if key > pivot else same).append(m)
        if more:
            todo.append((more, depth))
        todo.append((same, depth + STEP))
        if less:
            todo.append((less, depth))
    return order, shared


def matches(contents: list[bytes], places: list[int], scheme: spans.Scheme) -> Iterator[tuple[int, int, int]]:
    order, shared = deep_shallow([c[p:] for c, p in zip(contents, places, strict=True)], scheme.gram)
    return spans.both_ways(order, shared, [c[:p][::-1] for c, p in zip(contents, places, strict=True)], places, scheme)


def scheme(length: int = LENGTH, gram: int = GRAM) -> spans.Scheme:
    return spans.Scheme(length, gram, 1, lambda text: _BYTE[np.frombuffer(text.encode("utf-8"), np.uint8)], _content)


def _content(text: str, units: np.ndarray, first: int) -> bytes:
    return text.encode("utf-8")[first : first + len(units)]


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most_group: int = spans.MOST_GROUP) -> DataFrame:
    """doc_id, n_bytes, removed (array of begin and end), kept (binary) for every row."""
    docs = docs.select("doc_id", "text")

    def run(rows):
        for doc_id, text, ranges in rows:
            data = (text or "").encode("utf-8")
            cut, at, parts = spans.merged(ranges), 0, []
            for begin, end in cut:
                parts.append(data[at:begin])
                at = end
            yield doc_id, len(data), [{"begin": a, "end": b} for a, b in cut], b"".join([*parts, data[at:]])

    found = spans.repeated_ranges(docs, scheme(length, gram), matches, most_group)
    return map_rows(spans.with_ranges(docs, found), run, "doc_id long, n_bytes long, removed array<struct<begin: int, end: int>>, kept binary")
