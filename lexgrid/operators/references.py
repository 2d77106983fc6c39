"""Opaque references to documents: short, stable while in use, gone after seven days without use."""

from __future__ import annotations

import base64
import re
import secrets
import threading
import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexgrid.operators.jobs import read_json, write_json

LIFETIME = 7 * 24 * 3600.0
PATTERN = re.compile(r"^r_[A-Za-z0-9_-]{6}$")
READ_LINK = re.compile(r"corpus-read://read\?dataset=([^&\s)#]+)&id=([^&\s)#]+)(?:#([^\s)]*))?(?=\))")


class References:
    """Routes (provider, dataset, id, title, section) by reference, kept as JSON; a use renews the lifetime."""

    def __init__(self, path: str, clock=time.time) -> None:
        self.path, self.clock, self.lock = path, clock, threading.Lock()
        self.entries = {k: v for k, v in read_json(path, {}).items() if v["expires_at"] > clock()}
        self.by_route = {tuple(v["route"]): k for k, v in self.entries.items()}

    def mint(self, provider: str, dataset: str, id_: str, title: str = "", section: str = "") -> str:
        return self.mint_many([(provider, dataset, id_, title, section)])[0]

    def mint_many(self, routes: list[tuple[str, str, str, str, str]]) -> list[str]:
        """References for routes, written once for all of them."""
        with self.lock:
            out = [self._mint(r) for r in routes]
            if out:
                write_json(self.path, self.entries)
        return out

    def _mint(self, route: tuple[str, str, str, str, str]) -> str:
        ref = self.by_route.get(route)
        if ref is None or self.entries[ref]["expires_at"] <= self.clock():
            while True:
                ref = "r_" + base64.urlsafe_b64encode(secrets.token_bytes(4)).decode()[:6]
                if ref not in self.entries:
                    break
        self.entries[ref] = {"route": list(route), "expires_at": self.clock() + LIFETIME}
        self.by_route[route] = ref
        return ref

    def resolve(self, ref: str) -> dict:
        if not PATTERN.match(ref):
            raise ValueError(f"no reference: {ref!r}")
        entry = self.entries.get(ref)
        if entry is None or entry["expires_at"] <= self.clock():
            raise KeyError(f"{ref} is unknown or has expired")
        with self.lock:
            entry["expires_at"] = self.clock() + LIFETIME
            write_json(self.path, self.entries)
        return dict(zip(("provider", "dataset", "id", "title", "section"), entry["route"], strict=True))

    def rewrite(self, text: str, provider: str) -> str:
        """Read links in a Markdown text become references; a link cut off at the end stays."""
        found = [(provider, m[1], m[2], "", m[3] or "") for m in READ_LINK.finditer(text)]
        refs = iter(self.mint_many(found))
        return READ_LINK.sub(lambda m: f"corpus-read://document/{next(refs)}", text)


def expiry(uses: DataFrame, key: str, at: str, now: str) -> DataFrame:
    """When each reference ends after its last use, and whether it is alive at a time."""
    ends = uses.groupBy(key).agg((F.max(at) + F.expr(f"interval {int(LIFETIME)} seconds")).alias("expires_at"))
    return ends.withColumn("live", F.col("expires_at") > F.lit(now).cast("timestamp"))


def usage(uses: DataFrame, key: str, order: list[str], at: str, lifetime: str) -> DataFrame:
    """How often a route was given a new reference, and how often one that was alive: minted and reused."""
    gap = uses.select(key, at, F.lag(at).over(Window.partitionBy(key).orderBy(*order)).alias("before"))
    fresh = F.col("before").isNull() | (F.col(at) >= F.col("before") + F.expr(lifetime))
    return gap.groupBy(key).agg(F.count_if(fresh).alias("minted"), F.count_if(~fresh).alias("reused"))
