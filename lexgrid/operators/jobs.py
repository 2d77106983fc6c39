"""Jobs of the store: a state machine with legal transitions, kept as JSON, and settings with bounds."""

from __future__ import annotations

import json
import os
import threading
import time
import uuid
from dataclasses import asdict, dataclass, field

#: The states and which action leads from which states to which.
ACTIVE = {"queued", "downloading", "indexing"}
TERMINAL = {"completed", "failed", "canceled"}
ACTIONS = {"pause": (ACTIVE, "paused"), "resume": ({"paused"}, "queued"), "cancel": (ACTIVE | {"paused"}, "canceled"), "retry": ({"failed", "canceled"}, "queued")}


@dataclass
class Job:
    id: str
    dataset: str
    kind: str
    state: str = "queued"
    completed: int = 0
    total: int = 0
    error: str = ""
    created_at: float = field(default_factory=time.time)
    updated_at: float = field(default_factory=time.time)


def write_json(path: str, value: object) -> None:
    """A file is complete before it has its name."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(part, "w") as f:
        json.dump(value, f, indent=1, sort_keys=True)
    os.replace(part, path)


def read_json(path: str, default: object) -> object:
    if not os.path.exists(path):
        return default
    with open(path) as f:
        return json.load(f)


class Jobs:
    """All jobs under one folder. Reopening puts jobs that were running back in the queue; paused ones stay."""

    def __init__(self, path: str, clock=time.time) -> None:
        self.path, self.clock, self.lock = path, clock, threading.Lock()
        self.jobs = {j["id"]: Job(**j) for j in read_json(path, [])}
        for j in self.jobs.values():
            if j.state in ACTIVE:
                j.state = "queued"

    def save(self) -> None:
        with self.lock:
            self._save()

    def _save(self) -> None:
        write_json(self.path, [asdict(j) for j in self.jobs.values()])

    def submit(self, dataset: str, kind: str = "download") -> Job:
        """The job of a dataset that has not ended, or its failed job of the kind, queued again, or a new one."""
        mine = [j for j in self.jobs.values() if j.dataset == dataset]
        if running := [j for j in mine if j.state not in TERMINAL]:
            return running[0]
        if failed := sorted((j for j in mine if j.state == "failed" and j.kind == kind), key=lambda j: j.updated_at):
            job = failed[-1]
            job.state, job.error = "queued", ""
        else:
            job = Job(uuid.uuid4().hex[:16], dataset, kind, created_at=self.clock())
            self.jobs[job.id] = job
        job.updated_at = self.clock()
        self.save()
        return job

    def act(self, job_id: str, action: str) -> Job:
        job = self.jobs[job_id]
        if action not in ACTIONS:
            raise ValueError(f"unknown action: {action}")
        allowed, to = ACTIONS[action]
        if job.state not in allowed:
            raise ValueError(f"cannot {action} a job that is {job.state}")
        job.state, job.updated_at = to, self.clock()
        self.save()
        return job

    def progress(self, job_id: str, completed: int, total: int, state: str | None = None) -> Job:
        """Progress only rises, and a job that is paused or has ended takes none."""
        job = self.jobs[job_id]
        if job.state in ACTIVE:
            job.state = state or job.state
            if completed >= job.completed:
                job.completed, job.total, job.updated_at = completed, total, self.clock()
            self.save()
        return job

    def finish(self, job_id: str, error: str = "") -> Job:
        """Ends a job; a paused or canceled one stays what it is."""
        job = self.jobs[job_id]
        if job.state in ACTIVE:
            job.state, job.error, job.updated_at = ("failed" if error else "completed"), error, self.clock()
            self.save()
        return job

    def listed(self) -> list[Job]:
        active = sorted((j for j in self.jobs.values() if j.state not in TERMINAL), key=lambda j: (j.created_at, j.id))
        return active + sorted((j for j in self.jobs.values() if j.state in TERMINAL), key=lambda j: (-j.updated_at, j.id))


@dataclass
class Settings:
    download_workers: int = 3
    index_workers: int = 1
    update_hours: int = 24
    auto_update: bool = False

    def __post_init__(self) -> None:
        if not 1 <= self.download_workers <= 32 or not 1 <= self.index_workers <= 32:
            raise ValueError("workers must be from 1 to 32")
        if not 1 <= self.update_hours <= 720:
            raise ValueError("update_hours must be from 1 to 720")
