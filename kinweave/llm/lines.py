"""Line dedup by site-relative frequency, in DataFrame operations only.

A line is boilerplate on a host if it stands on more than ``MOST_SHARE`` of
the host's pages, and on ``LEAST_PAGES`` pages at least.  Lines are counted by
a 128-bit hash, once per page.  As the shares of a host's lines add up to the
lines of its average page, at most ``average / MOST_SHARE`` lines of a host are
boilerplate, so they fit one short array per host; a host with a third of all
pages is counted in parts and never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.storage import materialize

MOST_SHARE = 0.2
LEAST_PAGES = 3
#: Bytes of boilerplate arrays up to which they are broadcast.
BROADCAST_BYTES = 32 << 20

# What HTML hides, what starts a new line, and what entities say.
HIDDEN = r"(?is)<!--.*?-->|<head\b.*?</head\s*>|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
BLOCK = r"(?i)</?(?:p|div|br|li|ul|ol|nav|article|section|header|footer|h[1-6]|tr|td|th|table|body|html|main|aside|blockquote|pre|form|hr|dd|dt|dl)\b[^>]*>"
TAG = r"<[a-zA-Z/!?][^>]*>"
SPACES = r"[\x20\x09-\x0D]+"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)"


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without a leading www.; empty if there is none."""
    return F.coalesce(F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"^www\.", ""), F.lit(""))


def lines_of(html: Column) -> Column:
    """The text lines of a page, in order; a null page has none."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, "\n")
    text = F.regexp_replace(F.regexp_replace(text, BLOCK, "\n"), TAG, "")
    for entity, plain in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, SPACES, " "))), lambda x: x != "")


def _mark(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def boilerplate(pages: DataFrame, most_share: float = MOST_SHARE, least_pages: int = LEAST_PAGES) -> DataFrame:
    """Marks of the boilerplate lines of each host that has any: (host, marks).

    ``pages`` has host and lines; pages without a host are left out.
    """
    sited = pages.filter("host <> ''")
    totals = sited.groupBy("host").agg(F.count("*").alias("pages"))
    marks = sited.select("host", F.explode(F.array_distinct(F.transform("lines", _mark))).alias("mark"))
    counted = marks.groupBy("host", "mark").agg(F.count("*").alias("n")).filter(F.col("n") >= least_pages)
    often = counted.join(totals, "host").filter(F.col("n") > most_share * F.col("pages"))
    return often.groupBy("host").agg(F.collect_set("mark").alias("marks"))


def dedup_lines(pages: DataFrame, most_share: float = MOST_SHARE, least_pages: int = LEAST_PAGES) -> DataFrame:
    """One row per page row: page_id, host, n_lines, n_dropped, text.

    ``text`` holds the kept lines, one below the other.  Null or empty html: no
    lines and an empty text.  Pages without a host keep all lines.  Repeated
    rows are pages of their own; a null page_id is carried through; other
    columns are ignored.
    """
    read = materialize(pages.select("page_id", host_of(F.col("url")).alias("host"), lines_of(F.col("html")).alias("lines")), "page-lines")
    found = materialize(boilerplate(read, most_share, least_pages), "boilerplate")
    size = found.agg(F.sum(F.size("marks")).alias("n")).first()["n"] or 0
    marked = read.join(F.broadcast(found) if size * 48 <= BROADCAST_BYTES else found, "host", "left")
    kept = F.when(F.col("marks").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains("marks", _mark(x))))
    out = marked.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept"))
    return out.select("page_id", "host", "n_lines", (F.col("n_lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("text"))


def oracle() -> str:
    """DuckDB SQL for :func:`dedup_lines` over ``pages``."""
    text = f"regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{HIDDEN}', chr(10), 'g'), '{BLOCK}', chr(10), 'g'), '{TAG}', '', 'g')"
    for entity, plain in ENTITIES:
        quoted = plain.replace("'", "''")
        text = f"replace({text}, '{entity}', '{quoted}')"
    return f"""
WITH read AS (
  SELECT row_number() OVER () AS rid, page_id,
    coalesce(regexp_replace(lower(regexp_extract(url, '{HOST}', 1)), '^www\\.', ''), '') AS host,
    list_filter(list_transform(string_split({text}, chr(10)), lambda x: trim(regexp_replace(x, '{SPACES}', ' ', 'g'))), lambda x: x <> '') AS lines
  FROM pages),
totals AS (SELECT host, count(*) AS pages FROM read WHERE host <> '' GROUP BY host),
often AS (
  SELECT l.host, l.line FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM read WHERE host <> '') l
  JOIN totals t ON l.host = t.host GROUP BY l.host, l.line, t.pages
  HAVING count(*) >= {LEAST_PAGES} AND count(*) > {MOST_SHARE} * t.pages),
each AS (SELECT rid, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM read),
judged AS (
  SELECT e.rid, e.line, e.pos, o.line IS NOT NULL AS gone
  FROM each e JOIN read r ON e.rid = r.rid LEFT JOIN often o ON o.host = r.host AND o.line = e.line),
per_page AS (
  SELECT rid, count(*) FILTER (WHERE gone) AS n_dropped, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS text
  FROM judged GROUP BY rid)
SELECT r.page_id, r.host, CAST(len(r.lines) AS BIGINT) AS n_lines, CAST(coalesce(p.n_dropped, 0) AS BIGINT) AS n_dropped, coalesce(p.text, '') AS text
FROM read r LEFT JOIN per_page p ON r.rid = p.rid"""
