"""Offline web archives (ZIM): header, MIME list, directory entries, clusters; as a data source of entries.

Each partition reads a range of entries in the order of their clusters, so a cluster is decompressed once or twice."""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import struct
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import udf
from pyspark.sql.types import StringType, StructType

from lexgrid import schemas
from lexgrid.functions import markup
from lexgrid.runtime import ship
from lexgrid.sources.records import as_records

#: Fixed values of the format.
MAGIC, HEADER_BYTES, REDIRECT = 72173914, 80, 0xFFFF
ENTRIES_A_PARTITION = 20_000


def entry_id(namespace: str, path: str) -> str:
    digest = hashlib.sha256(f"{namespace}\0{path}".encode()).digest()[:9]
    return "z" + base64.b32encode(digest).decode().rstrip("=").lower()


class Archive:
    def __init__(self, path: str) -> None:
        self.file = open(path, "rb")
        head = self.at(0, HEADER_BYTES)
        magic, major = struct.unpack_from("<IH", head)
        if magic != MAGIC or major not in (5, 6):
            raise ValueError(f"{path}: no archive of version 5 or 6")
        self.entries, self.clusters = struct.unpack_from("<II", head, 24)
        self.paths_at, _, self.clusters_at, self.mimes_at = struct.unpack_from("<QQQQ", head, 32)
        raw = self.at(self.mimes_at, min(1 << 16, max(0, self.paths_at - self.mimes_at) or 1 << 16))
        self.mimes = [m.decode("utf-8") for m in raw[: raw.index(b"\0\0")].split(b"\0")]
        self.held: dict[int, list[bytes]] = {}

    def at(self, place: int, n: int) -> bytes:
        self.file.seek(place)
        return self.file.read(n)

    def entry(self, number: int) -> dict:
        """Namespace, path, title, MIME, and either a redirect's entry or cluster and blob."""
        place = struct.unpack("<Q", self.at(self.paths_at + 8 * number, 8))[0]
        size = 1 << 10
        while True:
            raw = self.at(place, size)
            mime, _, namespace = struct.unpack_from("<HBc", raw)
            begin = 12 if mime == REDIRECT else 16
            texts = raw[begin:].split(b"\0", 2)
            if len(texts) == 3 or len(raw) < size:
                break
            size *= 4
        where = struct.unpack_from("<I", raw, 8)[0] if mime == REDIRECT else struct.unpack_from("<II", raw, 8)
        path = texts[0].decode("utf-8", "replace")
        title = texts[1].decode("utf-8", "replace") if len(texts) > 1 else ""
        known = mime < len(self.mimes)
        return {"number": number, "namespace": namespace.decode("latin-1"), "path": path, "title": title or path, "mime": self.mimes[mime] if known else "", "redirect": where if mime == REDIRECT else None, "place": None if mime == REDIRECT else where}

    def blobs(self, cluster: int) -> list[bytes]:
        if cluster not in self.held:
            if len(self.held) >= 8:
                self.held.pop(next(iter(self.held)))
            begin = struct.unpack("<Q", self.at(self.clusters_at + 8 * cluster, 8))[0]
            if cluster + 1 < self.clusters:
                end = struct.unpack("<Q", self.at(self.clusters_at + 8 * cluster + 8, 8))[0]
            else:
                end = struct.unpack("<Q", self.at(72, 8))[0]
            raw = self.at(begin, end - begin)
            data = self.unpack(raw[0] & 0x0F, raw[1:])
            width = 8 if raw[0] & 0x10 else 4
            first = int.from_bytes(data[:width], "little")
            offsets = [int.from_bytes(data[i : i + width], "little") for i in range(0, first, width)]
            self.held[cluster] = [data[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]
        return self.held[cluster]

    @staticmethod
    def unpack(kind: int, data: bytes) -> bytes:
        if kind in (0, 1):
            return data
        if kind == 2:
            return zlib.decompress(data)
        if kind == 3:
            return bz2.decompress(data)
        if kind == 4:
            return lzma.LZMADecompressor().decompress(data)
        if kind == 5:
            import zstandard

            return zstandard.ZstdDecompressor().decompressobj().decompress(data)
        raise ValueError(f"unknown compression {kind}")

    def content(self, entry: dict) -> bytes | None:
        return None if entry["place"] is None else self.blobs(entry["place"][0])[entry["place"][1]]


class Range(InputPartition):
    def __init__(self, begin: int, end: int) -> None:
        super().__init__(begin)
        self.begin, self.end = begin, end


class ArchiveReader(DataSourceReader):
    def __init__(self, schema: StructType, options) -> None:
        self.names, self.path, self.step = schema.fieldNames(), options["path"], int(options.get("entries", ENTRIES_A_PARTITION))

    def partitions(self):
        n = Archive(self.path).entries
        return [Range(i, min(n, i + self.step)) for i in range(0, n, self.step)] or [Range(0, 0)]

    def read(self, partition: Range):
        archive = Archive(self.path)
        found = [archive.entry(i) for i in range(partition.begin, partition.end)]
        for e in sorted(found, key=lambda e: (e["place"] or (-1, 0), e["number"])):
            row = {"id": entry_id(e["namespace"], e["path"]), "namespace": e["namespace"], "path": e["path"], "title": e["title"], "mime": e["mime"], "redirect": e["redirect"], "content": archive.content(e), "entry": e["number"]}
            yield tuple(row[n] for n in self.names)


class ArchiveSource(DataSource):
    """Option path: a file that every executor can open."""

    @classmethod
    def name(cls):
        return "archive"

    def schema(self):
        return schemas.ARCHIVE_ENTRY

    def reader(self, schema):
        return ArchiveReader(schema, self.options)


def entries(spark: SparkSession, path: str, per_partition: int = ENTRIES_A_PARTITION) -> DataFrame:
    ship(spark)
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archive").option("path", path).option("entries", per_partition).load()


def readable(rows: DataFrame) -> DataFrame:
    """Entries of articles: text or XHTML, or a redirect."""
    kind = F.lower(F.substring_index("mime", ";", 1))
    return rows.filter(F.col("namespace").isin("C", "A") & (F.col("redirect").isNotNull() | kind.startswith("text/") | kind.contains("xhtml")))


def records(rows: DataFrame, dataset: str) -> DataFrame:
    ship(rows.sparkSession)

    @udf(StringType())
    def body(namespace, path, mime, content):
        if content is None:
            return ""
        text = bytes(content).decode("utf-8", "replace")
        return markup.html_to_markdown(text, markup.archive_link(path, dataset, lambda p: entry_id(namespace, p))) if "html" in mime else text

    return as_records(readable(rows), "archive", dataset, id="id", title="title", body=body("namespace", "path", "mime", "content"), locator="path", primary=F.col("redirect").isNull(), seq="entry")


def redirect_edges(rows: DataFrame) -> DataFrame:
    """src and dst ids of redirect entries."""
    to = rows.select(F.col("entry").alias("redirect"), F.col("id").alias("dst"))
    return rows.filter("redirect is not null").join(to, "redirect").select(F.col("id").alias("src"), "dst")
