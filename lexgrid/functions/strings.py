"""Scalar functions over strings, identifiers and keys, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words are letter runs (with inner apostrophes, dots, colons before a letter) or digit runs (with inner marks before a digit).
TOKEN = r"\p{Nd}[\p{L}\p{M}\p{Nd}_]*(?:['’.,;]\p{Nd}[\p{L}\p{M}\p{Nd}_]*)*|[\p{L}\p{M}_][\p{L}\p{M}\p{Nd}_]*(?:['’.·:]\p{L}[\p{L}\p{M}\p{Nd}_]*)*"

#: The same words in a text of ASCII characters in lower case; its classes are tables, which the engine matches faster.
ASCII_TOKEN = r"[0-9][a-z0-9_]*+(?:['.,;][0-9][a-z0-9_]*+)*+|[a-z_][a-z0-9_]*+(?:['.:][a-z][a-z0-9_]*+)*+"


def tokens(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    ascii_only = F.octet_length(low) == F.length(low)
    return F.when(ascii_only, F.regexp_extract_all(low, F.lit(ASCII_TOKEN), F.lit(0))).otherwise(F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0)))


def normalize_title(text: Column) -> Column:
    return F.lower(F.trim(F.replace(text, F.lit("_"), F.lit(" "))))


def normalize_identifier(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def reference_title(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def looks_like_identifier(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), "[ -]", "").rlike("^[A-Za-z]{2,12}[0-9]{1,12}$")


def generation_id(provider: Column, dataset: Column, fingerprint: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\x1f", provider, dataset, fingerprint), 256), 1, 32)


def _base64url(text: Column) -> Column:
    # base64 wraps lines after 76 characters
    return F.rtrim(F.translate(F.regexp_replace(F.base64(F.encode(text, "UTF-8")), "\\s", ""), "+/", "-_"), F.lit("="))


def doc_key(generation: Column, id_: Column) -> Column:
    return F.concat(_base64url(generation), F.lit("."), _base64url(id_))


def slug(text: Column, most: int = 120) -> Column:
    dashed = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    return F.regexp_replace(F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, most), "-+$", "")


def first_nonempty(*values: Column) -> Column:
    return F.coalesce(*(F.nullif(F.trim(v), F.lit("")) for v in values), F.lit(""))


def human_bytes(n: Column) -> Column:
    """1 decimal in the largest binary unit that fits; whole bytes below 1024."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in enumerate(("KiB", "MiB", "GiB", "TiB", "PiB"), 1):
        out = F.when(n >= 1024**power, F.concat(F.round(n / 1024**power, 1).cast("string"), F.lit(f" {unit}"))).otherwise(out)
    return out


def parse_size(text: Column) -> Column:
    """Sizes of a listing such as 12, 1.5K, 3M, 2G; anything else is null."""
    number = F.regexp_extract(F.trim(text), r"^([0-9]+(?:\.[0-9]+)?)([KMGT]?)$", 1)
    unit = F.regexp_extract(F.trim(text), r"^([0-9]+(?:\.[0-9]+)?)([KMGT]?)$", 2)
    factor = F.coalesce(*(F.when(unit == u, F.lit(float(1024**p))) for p, u in enumerate(("", "K", "M", "G", "T"))))
    return F.when(number != "", (number.cast("double") * factor).cast("long"))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s]+", " "))


def snippet(text: Column, terms: list[str], most: int) -> Column:
    """A window of collapsed text that starts a third of its length before the earliest term of three characters or more."""
    flat = collapse(text)
    found = [F.nullif(F.instr(F.lower(flat), t), F.lit(0)) for t in terms if len(t) >= 3]
    at = F.coalesce(F.array_min(F.filter(F.array(*found), lambda x: x.isNotNull())), F.lit(1))
    start = F.greatest(F.lit(1), at - most // 3)
    return F.substring(flat, start, F.lit(most))


def redirect_target(text: Column) -> Column:
    """Target of a redirect directive at the start of a page; empty if it is none."""
    return F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)^\s*#redirect\s*:?\s*\[\[([^\]|]*)", 1))


def document_ref(text: Column) -> Column:
    """RFC0001 becomes RFC 1; the same for STD, BCP and FYI."""
    return F.regexp_replace(F.upper(F.trim(text)), r"^(RFC|STD|BCP|FYI)[ -]?0*([0-9]+)$", "$1 $2")


def page_url(base: Column, title: Column) -> Column:
    path = F.replace(F.url_encode(F.replace(title, F.lit(" "), F.lit("_"))), F.lit("%2F"), F.lit("/"))
    return F.concat(base, F.lit("/wiki/"), F.replace(F.replace(path, F.lit("%3A"), F.lit(":")), F.lit("+"), F.lit("%20")))


def title_and_fragment(target: Column) -> tuple[Column, Column]:
    plain = F.replace(F.url_decode(F.replace(target, F.lit("+"), F.lit("%2B"))), F.lit("_"), F.lit(" "))
    return F.trim(F.substring_index(plain, "#", 1)), F.trim(F.when(F.instr(plain, "#") > 0, F.substring(plain, F.instr(plain, "#") + 1, F.length(plain))).otherwise(F.lit("")))


def celex_of_link(href: Column) -> Column:
    """The CELEX number in a legal link's query or path; empty if it has none."""
    return F.upper(F.regexp_extract(F.url_decode(href), r"(?i)celex[:/=]([0-9][0-9A-Za-z()]+)", 1))


def cellar_id(uri: Column) -> Column:
    return F.regexp_extract(uri, r"/cellar/([^/?#]+)", 1)


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\\[\]])", r"\\$1")


def escape_cell(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def is_external_url(text: Column) -> Column:
    return F.lower(text).rlike("^(https?:)?//")


def stream_location(locator: Column) -> tuple[Column, Column, Column]:
    """part, offset, end of a locator part:offset:end; nulls where a field is no number."""
    field = F.split(locator, ":")
    return tuple(F.try_element_at(field, F.lit(i)).try_cast("long") for i in (1, 2, 3))
