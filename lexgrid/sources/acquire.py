"""Acquisition of files: resumable, hash-checked downloads with retries, and reuse of files that have not changed.

A download that is under way is two files: `.part` with bytes at their places, and `.ranges`, a JSON list of the ranges
that stand there in full. Only what is listed counts; the size of `.part` says nothing, as ranges end in any order.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

#: Attempts for one file, statuses worth another attempt, bounds of a wait, connections and size from which several are used.
ATTEMPTS, RETRYABLE, FIRST_WAIT, LONGEST_WAIT = 5, {429, 500, 502, 503, 504}, 0.5, 60.0
CONNECTIONS, PARALLEL_FROM = 3, 64 << 20


@dataclass(frozen=True)
class Part:
    name: str
    url: str
    size: int = 0
    digest: str = ""
    algorithm: str = "sha256"


def wait_before(attempt: int, retry_after: str | None) -> float:
    """Seconds: what the server asks for, or half a second that doubles; a minute at most."""
    if retry_after and retry_after.strip().isdigit():
        return min(LONGEST_WAIT, float(retry_after))
    return min(LONGEST_WAIT, FIRST_WAIT * 2**attempt)


def digest_of(path: str, algorithm: str = "sha256") -> str:
    h = hashlib.new(algorithm)
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def valid(path: str, part: Part) -> bool:
    if not os.path.exists(path) or part.size and os.path.getsize(path) != part.size:
        return False
    return not part.digest or digest_of(path, part.algorithm) == part.digest.lower()


def link_or_copy(source: str, target: str) -> None:
    try:
        os.link(source, target)
    except OSError:
        shutil.copyfile(source, target)


def _fetch(url: str, first: int, last: int | None, write: Callable[[int, bytes], None]) -> int:
    """Write the bytes from `first` on (to `last`); returns the place after them. A server without ranges starts over at 0."""
    request = urllib.request.Request(url, headers={"Range": f"bytes={first}-{'' if last is None else last}"} if first or last is not None else {})
    with urllib.request.urlopen(request, timeout=60) as response:
        at = first if response.status == 206 else 0
        while block := response.read(1 << 20):
            write(at, block)
            at += len(block)
    return at


def _retried(job: Callable[[], int], sleep: Callable[[float], None]) -> int:
    for attempt in range(ATTEMPTS):
        try:
            return job()
        except urllib.error.HTTPError as e:
            if e.code not in RETRYABLE or attempt + 1 == ATTEMPTS:
                raise
            sleep(wait_before(attempt, e.headers.get("Retry-After")))
        except (urllib.error.URLError, ConnectionError, TimeoutError):
            if attempt + 1 == ATTEMPTS:
                raise
            sleep(wait_before(attempt, None))
    raise AssertionError


class Progress:
    """The finished ranges of a download, merged and kept beside it; written before anyone may rely on them."""

    def __init__(self, path: str, part: Part) -> None:
        self.path, self.lock = path, threading.Lock()
        self.mark = {"url": part.url, "size": part.size, "digest": part.digest}
        self.done: list[list[int]] = []
        if os.path.exists(path):
            with open(path) as f:
                held = json.load(f)
            # another release under the same name starts over
            if {k: held[k] for k in self.mark} == self.mark:
                self.done = held["done"]
        elif part.digest and os.path.exists(path.removesuffix(".ranges") + ".part"):
            # written in order by something else; the digest will tell
            self.done = [[0, os.path.getsize(path.removesuffix(".ranges") + ".part")]]
        self.save()

    def add(self, first: int, end: int) -> None:
        with self.lock:
            merged: list[list[int]] = []
            for a, b in sorted([*self.done, [first, end]]):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            self.done = merged
            self.save()

    def save(self) -> None:
        with open(f"{self.path}.tmp", "w") as f:
            json.dump(self.mark | {"done": self.done}, f)
        os.replace(f"{self.path}.tmp", self.path)

    def missing(self, size: int) -> list[tuple[int, int]]:
        """(first, end) of what is not there yet."""
        out, at = [], 0
        for a, b in [*self.done, [size, size]]:
            if a > at:
                out.append((at, a))
            at = max(at, b)
        return out


def download(part: Part, target: str, sleep: Callable[[float], None] = time.sleep, parallel_from: int = PARALLEL_FROM, connections: int = CONNECTIONS) -> None:
    """Fetch a part to target, going on with what an earlier call finished. A wrong size or digest is an error."""
    held = f"{target}.part"
    progress = Progress(f"{target}.ranges", part)
    with open(held, "r+b" if os.path.exists(held) else "w+b") as f:

        def write(at: int, block: bytes) -> None:
            os.pwrite(f.fileno(), block, at)

        def whole() -> int:
            end = _fetch(part.url, 0, None, write)
            progress.add(0, end)
            return end

        def ranged(first: int, end: int) -> int:
            """One range, noted block by block. A server that ignores ranges has sent everything from 0 on."""
            at = first

            def block(place: int, data: bytes) -> None:
                nonlocal at
                write(place, data)
                os.fsync(f.fileno())
                progress.add(place, place + len(data))
                at = place + len(data)

            while at < end:
                before = at
                _fetch(part.url, at, end - 1 if end < part.size else None, block)
                if at == before:
                    raise ConnectionError(f"{part.name}: the server sent nothing from {at} on")
            return at

        if part.size:
            gaps = progress.missing(part.size)
            if part.size >= parallel_from:
                step = -(-part.size // connections)
                gaps = [(x, min(b, x + step)) for a, b in gaps for x in range(a, b, step)]
            with ThreadPoolExecutor(connections if len(gaps) > 1 else 1) as pool:
                for done in [pool.submit(_retried, lambda a=a, b=b: ranged(max([a, *(y for x, y in progress.done if x <= a < y)]), b), sleep) for a, b in gaps]:
                    done.result()
            f.truncate(part.size)
        else:
            f.truncate(_retried(whole, sleep))
    if part.size and progress.missing(part.size) or not valid(held, part):
        for path in (held, progress.path):
            if os.path.exists(path):
                os.remove(path)
        raise ValueError(f"{part.name} is not what its size or digest says")
    os.replace(held, target)
    if os.path.exists(progress.path):
        os.remove(progress.path)


def acquire(parts: Iterable[Part], stage: str, previous: str | None = None, sleep: Callable[[float], None] = time.sleep) -> tuple[list[str], list[str]]:
    """(reused, downloaded) names. Parts that are valid in the stage or in the previous folder are not fetched again."""
    os.makedirs(stage, exist_ok=True)
    reused, fetched = [], []
    for part in parts:
        target = os.path.join(stage, part.name)
        before = os.path.join(previous, part.name) if previous else ""
        if part.digest and valid(target, part):
            reused.append(part.name)
        elif before and part.digest and valid(before, part):
            link_or_copy(before, target)
            reused.append(part.name)
        else:
            download(part, target, sleep)
            fetched.append(part.name)
    return reused, fetched
