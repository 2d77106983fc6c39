"""Explicit schemas; none is ever inferred."""

from __future__ import annotations

#: One normalized record of any source; (part, seq) is the scan order.
RECORD = (
    "provider string, dataset string, id string, title string, body string, url string, locator string, namespace int, primary boolean, "
    "identifiers array<string>, aliases array<string>, keywords array<string>, status string, rank_weight double, metadata map<string,string>, "
    "created_at timestamp, published_at timestamp, modified_at timestamp, effective_from timestamp, effective_to timestamp, published_precision string, "
    "deleted boolean, part int, seq long"
)
WIKI_PAGE = "title string, ns int, id long, redirect struct<_title: string>, revision struct<id: long, timestamp: string, text: string>"
RFC_ENTRY = (
    "`doc-id` string, title string, author array<struct<name: string>>, date struct<month: string, year: string>, format struct<`file-format`: array<string>>, "
    "keywords struct<kw: array<string>>, obsoletes struct<`doc-id`: array<string>>, `obsoleted-by` struct<`doc-id`: array<string>>, updates struct<`doc-id`: array<string>>, "
    "`updated-by` struct<`doc-id`: array<string>>, `is-also` struct<`doc-id`: array<string>>, `see-also` struct<`doc-id`: array<string>>, `current-status` string, stream string"
)
CITATION = (
    "pmid string, title string, journal string, identifiers array<string>, keywords array<string>, languages array<string>, authors array<string>, "
    "abstracts array<struct<label: string, text: string>>, created_at timestamp, published_at timestamp, modified_at timestamp, published_precision string, deleted boolean, part int, seq long"
)
ARCHIVE_ENTRY = "id string, namespace string, path string, title string, mime string, redirect int, content binary, entry int"
EURLEX_ENTRY = "celex string, expression string, format string, title string, date string"
CATALOG = "provider string, id string, name string, description string, fingerprint string, languages array<struct<code: string, name: string>>, variants array<struct<id: string, name: string>>"
