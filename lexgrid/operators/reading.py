"""Reading: pages of a text, sections, outlines, the reference budget, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_CHARS, MOST_CHARS, MOST_HEADINGS = 50_000, 500_000, 200
HEADING = r"^(#{1,6})\s+(.*?)\s*#*\s*$"


def slices(documents: DataFrame, text: str, size: int) -> DataFrame:
    """One row a page: offset, returned, total, truncated, next_offset, content; pages join to the text again."""
    total = F.char_length(text)
    starts = F.sequence(F.lit(0), F.greatest(total - 1, F.lit(0)), F.lit(size))
    at = documents.withColumn("total", total).withColumn("offset", F.explode(starts))
    content = F.substring(F.col(text), F.col("offset") + 1, F.lit(size))
    out = at.withColumns({"content": content, "returned": F.char_length(content)})
    after = F.col("offset") + F.col("returned")
    return out.withColumns({"truncated": after < F.col("total"), "next_offset": F.when(after < F.col("total"), after)})


def aligned_end(text: Column, offset: Column, size: Column) -> Column:
    """End of a page moved back to just after the last newline of its second half, where there is one."""
    piece = F.substring(text, offset + 1, size)
    back = F.instr(F.reverse(piece), "\n")
    full = F.char_length(text) > offset + size
    return F.when(full & (back > 0) & (size - back + 1 > size / 2), offset + size - back + 1).otherwise(F.least(offset + size, F.char_length(text)))


def aligned_pages(documents: DataFrame, text: str, size: int) -> DataFrame:
    """One row an aligned page: offset and end; each page begins where the one before it ends, and an empty text has one."""
    total = F.char_length(text)
    # a page that is not the last holds more than half of the size, so so many steps are enough
    steps = F.sequence(F.lit(0), F.floor(total / F.lit(size // 2)).cast("int"))

    def step(ends: Column, _: Column) -> Column:
        last = F.element_at(ends, -1)
        return F.when((last < total) | (F.size(ends) == 1), F.array_append(ends, aligned_end(F.col(text), last, F.lit(size)).cast("int"))).otherwise(ends)

    ends = documents.withColumn("_ends", F.aggregate(steps, F.array(F.lit(0)), step))
    pages = F.arrays_zip(F.slice("_ends", F.lit(1), F.size("_ends") - 1).alias("offset"), F.slice("_ends", F.lit(2), F.size("_ends") - 1).alias("end"))
    return ends.select(*documents.columns, F.inline(pages).alias("offset", "end"))


def outline(documents: DataFrame, key: str, text: str, most: int = MOST_HEADINGS) -> DataFrame:
    """key, place, level, heading of the Markdown headings outside code fences, at most `most`; truncated tells of more."""
    lines = documents.select(key, F.posexplode(F.split(text, "\n")).alias("line", "value"))
    order = Window.partitionBy(key).orderBy("line")
    fence = F.sum(F.col("value").rlike("^```").cast("int")).over(order)
    heads = lines.withColumn("fence", fence).filter((F.col("fence") % 2 == 0) & F.col("value").rlike(HEADING))
    found = heads.select(key, "line", F.length(F.regexp_extract("value", HEADING, 1)).alias("level"), F.regexp_extract("value", HEADING, 2).alias("heading"))
    numbered = found.withColumns({"place": F.row_number().over(order), "n": F.count("*").over(Window.partitionBy(key))})
    return numbered.filter(F.col("place") <= most).withColumn("truncated", F.col("n") > most).drop("n")


def section(lines: DataFrame, key: str, place: str, level: str, heading: str, wanted: Column) -> DataFrame:
    """The rows of the first section with the heading wanted: up to the next heading of its level or a higher one.

    lines: key, place, level (null where the line is no heading), heading."""
    order = Window.partitionBy(key).orderBy(place)
    up_to = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.min(F.when(F.col(level).isNotNull() & (F.lower(F.trim(heading)) == wanted), F.struct(place, level))).over(Window.partitionBy(key))
    marked = lines.withColumn("_first", first).filter(F.col("_first").isNotNull() & (F.col(place) >= F.col(f"_first.{place}")))
    closes = (F.col(place) > F.col(f"_first.{place}")) & (F.col(level) <= F.col(f"_first.{level}"))
    return marked.withColumn("_closed", F.max(F.coalesce(closes, F.lit(False)).cast("int")).over(up_to)).filter("_closed = 0").drop("_first", "_closed")


def within_budget(references: DataFrame, key: str, place: str, text: str, each: int, total: int) -> DataFrame:
    """References with used (characters, `each` at most) and included: as long as the running sum fits the total."""
    used = F.least(F.char_length(text), F.lit(each))
    order = Window.partitionBy(key).orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return references.withColumn("used", used).withColumn("included", F.sum("used").over(order) <= total)


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1))


def html_title(html: Column) -> Column:
    return F.regexp_extract(html, r"<title>([^<]*)</title>", 1)


def html_text(html: Column) -> Column:
    """Text without scripts, styles and tags, blanks collapsed; entities stay."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>", " "), r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"[ \t\r\n]+", " "))


def resolved(links: DataFrame, targets: DataFrame, by: str, target: str, missing: int) -> DataFrame:
    """Links with the target that their path leads to, or `missing`."""
    return links.join(targets, by, "left").withColumn(target, F.coalesce(F.col(target), F.lit(missing)))
