"""Providers by stable ids: ownership of datasets, discovery with validation, a durable catalog cache."""

from __future__ import annotations

import re
import time
from abc import ABC, abstractmethod

from lexgrid.operators.catalog import ID_PATTERN
from lexgrid.operators.jobs import read_json, write_json


class Provider(ABC):
    id: str

    @abstractmethod
    def owns(self, dataset: str) -> bool: ...

    @abstractmethod
    def discover(self) -> list[dict]:
        """Catalog rows with id, description and variants."""

    @abstractmethod
    def records(self, dataset: str, variant: str):
        """A DataFrame of records."""


class Registry:
    def __init__(self, providers: list[Provider], cache: str | None = None, max_age: float = 24 * 3600.0, clock=time.time) -> None:
        self.providers: dict[str, Provider] = {}
        for p in providers:
            if not re.match(ID_PATTERN, p.id) or p.id in self.providers:
                raise ValueError(f"bad or repeated provider id: {p.id!r}")
            self.providers[p.id] = p
        self.cache, self.max_age, self.clock = cache, max_age, clock

    def owner(self, dataset: str) -> Provider:
        owners = [p for p in self.providers.values() if p.owns(dataset)]
        if len(owners) != 1:
            raise ValueError(f"{dataset} has {'no' if not owners else 'more than one'} provider")
        return owners[0]

    def discover(self, text: str = "", refresh: bool = False) -> tuple[list[dict], dict[str, str]]:
        """(rows by provider and id, errors by provider). A provider that fails keeps its last rows."""
        rows, errors = [], {}
        for p in self.providers.values():
            path = f"{self.cache}/{p.id}.json" if self.cache else ""
            held = read_json(path, None) if path else None
            if held and not refresh and self.clock() - held["at"] <= self.max_age:
                found = held["rows"]
            else:
                try:
                    found = [r | {"provider": p.id} for r in p.discover()]
                    for r in found:
                        self.validate(r)
                    if path:
                        write_json(path, {"at": self.clock(), "rows": found})
                except Exception as e:  # noqa: BLE001  one provider's failure is reported beside the others' rows
                    errors[p.id] = str(e)
                    found = held["rows"] if held else []
            rows += found
        seen: dict[str, str] = {}
        for r in rows:
            if seen.setdefault(r["id"], r["provider"]) != r["provider"]:
                raise ValueError(f"{r['id']} is offered by {seen[r['id']]} and {r['provider']}")
        low = text.lower()
        return sorted((r for r in rows if low in " ".join(map(str, r.values())).lower()), key=lambda r: (r["provider"], r["id"])), errors

    @staticmethod
    def validate(row: dict) -> None:
        if not re.match(ID_PATTERN, row.get("id", "")):
            raise ValueError(f"bad dataset id: {row.get('id')!r}")
        if not row.get("description", "").strip() or not row.get("variants"):
            raise ValueError(f"{row['id']} needs a description and variants")
