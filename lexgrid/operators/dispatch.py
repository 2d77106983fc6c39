"""Running jobs: a queue with a worker limit that may change while it runs, and notices of changes to whoever listens."""

from __future__ import annotations

import queue
import threading
import time
from collections import deque
from collections.abc import Callable

#: Jobs that may wait, and seconds within which changes become one notice.
QUEUE, COALESCE = 256, 0.5


class Dispatcher:
    """Runs work in threads, at most limit() at once; the limit is asked for again whenever a thread is free."""

    def __init__(self, limit: Callable[[], int], most_waiting: int = QUEUE) -> None:
        self.limit, self.most_waiting = limit, most_waiting
        self.waiting: deque[tuple[str, Callable[[], None]]] = deque()
        self.running: set[str] = set()
        self.errors: dict[str, str] = {}
        self.free = threading.Condition()

    def enqueue(self, key: str, work: Callable[[], None]) -> bool:
        """False where the same key waits or runs already; an error where too much waits."""
        with self.free:
            if key in self.running or any(k == key for k, _ in self.waiting):
                return False
            if len(self.waiting) >= self.most_waiting:
                raise ValueError(f"more than {self.most_waiting} jobs wait")
            self.waiting.append((key, work))
        self.pump()
        return True

    def pump(self) -> None:
        """Start what the limit allows; call it after the limit was raised."""
        with self.free:
            while self.waiting and len(self.running) < max(1, self.limit()):
                key, work = self.waiting.popleft()
                self.running.add(key)
                threading.Thread(target=self._run, args=(key, work), daemon=True).start()

    def _run(self, key: str, work: Callable[[], None]) -> None:
        try:
            work()
        except Exception as e:  # noqa: BLE001  a job's failure is its own; the queue goes on
            self.errors[key] = str(e)
        finally:
            with self.free:
                self.running.discard(key)
                self.free.notify_all()
            self.pump()

    def wait(self, seconds: float = 60.0) -> bool:
        """Whether all that was queued has ended in time."""
        end = time.monotonic() + seconds
        with self.free:
            while self.waiting or self.running:
                left = end - time.monotonic()
                if left <= 0:
                    return False
                self.free.wait(left)
        return True


class Notices:
    """Snapshots for listeners: several changes within a short time are one notice, and a slow listener gets the newest only."""

    def __init__(self, snapshot: Callable[[], dict], coalesce: float = COALESCE) -> None:
        self.snapshot, self.coalesce = snapshot, coalesce
        self.listeners: list[queue.Queue] = []
        self.lock, self.timer = threading.Lock(), None

    def subscribe(self) -> queue.Queue:
        """A queue of one place that starts with what is there now."""
        q: queue.Queue = queue.Queue(1)
        q.put(self.snapshot())
        with self.lock:
            self.listeners.append(q)
        return q

    def unsubscribe(self, q: queue.Queue) -> None:
        with self.lock:
            self.listeners.remove(q)

    def changed(self) -> None:
        with self.lock:
            if self.timer is None:
                self.timer = threading.Timer(self.coalesce, self._send)
                self.timer.daemon = True
                self.timer.start()

    def _send(self) -> None:
        with self.lock:
            self.timer = None
            listeners = list(self.listeners)
        now = self.snapshot()
        for q in listeners:
            try:
                q.get_nowait()
            except queue.Empty:
                pass
            try:
                q.put_nowait(now)
            except queue.Full:
                pass
