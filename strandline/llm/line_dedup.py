"""Lines that many pages of one site share, found by their site-relative frequency and dropped.

Built-in DataFrame functions only.  A line's frequency is the number of pages of a host that hold it
over the number of pages of that host.  Lines are counted by 128-bit hashes, once for each page and
combined before the shuffle, so a line on every page of a host that holds a third of all pages costs
one row for each task; pages look the dropped lines of their host up by the first 64 bits.  What is dropped for a host is at most (mean lines of a page / ratio) lines,
whatever the size of the host, so it fits one array; pages themselves are not shuffled while the table
of those arrays is small enough for Spark to broadcast, and are joined by host, in parts where a host
is large, when it isn't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: A line goes if it is on more than this share of the host's pages, and on so many pages at least.
RATIO, LEAST_PAGES = 0.1, 5

_UNSEEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
_BREAK = r"(?i)</?(?:html|head|body|title|meta|link|p|div|ul|ol|li|dl|dt|dd|table|tbody|thead|tr|td|th|h[1-6]|br|hr|nav|article|aside|section|header|footer|main|form|blockquote|pre|figure)\b[^>]*>"
_TAG = r"(?s)<[!/?a-zA-Z][^>]*>"
_HOST = r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?(?:www\.)?([^/?#:]*)"


def host_of(url: Column) -> Column:
    """Host of a URL in lower case, without user, port and a leading ``www.``; null if there is none."""
    return F.nullif(F.regexp_extract(F.lower(url), _HOST, 1), F.lit(""))


def html_lines(html: Column) -> Column:
    """Visible text of a page: scripts, styles and comments go, block tags end a line, other tags vanish."""
    seen = F.regexp_replace(html, _UNSEEN, "")
    return F.regexp_replace(F.regexp_replace(seen, _BREAK, "\n"), _TAG, "")


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def boilerplate(pages: DataFrame, host: str, text: str, scratch: Scratch, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``(host, lines)``: hashes of the lines to drop, for the hosts that have some."""
    lines = pages.where(F.col(host).isNotNull()).select(F.col(host).alias("host"), F.explode(F.array_distinct(F.transform(_lines(F.col(text)), lambda x: F.trim(x)))).alias("line"))
    lines = lines.where("line <> ''").select("host", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))
    counts = lines.groupBy("host", "h1", "h2").agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages)
    totals = pages.groupBy(F.col(host).alias("_host")).agg(F.count("*").alias("total"))
    counts, totals = scratch.save(counts), scratch.save(totals)
    found = counts.join(totals, F.col("host") == F.col("_host")).where(F.col("pages") > F.lit(ratio) * F.col("total"))
    found = scratch.save(found.groupBy("host").agg(F.collect_set("h1").alias("lines")))
    scratch.drop(counts, totals)
    return found


def drop_boilerplate(pages: DataFrame, host: str, text: str, ratio: float = RATIO, least_pages: int = LEAST_PAGES, name: str = "lines") -> DataFrame:
    """``pages`` with ``text`` less its boilerplate lines, and ``n_lines``, ``n_dropped`` added.

    A line goes if it is on more than the share ``ratio`` of its host's pages, and on ``least_pages`` of
    them at least: hosts with fewer pages than that keep every line.
    Lines are compared without spaces around them; blank lines never count and never go.  A page that
    holds a line twice counts once and loses both.  Null texts and hosts stay as they are; a repeated
    row is a page of its own; a page may end up empty but is never removed.  Texts of any length are
    compared whole; an empty table gives an empty one.  Other columns stay, whatever their names, but
    for ones named ``n_lines`` or ``n_dropped``, which the new ones replace.
    """
    scratch = Scratch(pages.sparkSession, name)
    names = [c for c in pages.columns if c not in ("n_lines", "n_dropped")]
    flat = pages.select(*names).toDF(*[f"c{i}" for i in range(len(names))])
    host, text = (f"c{names.index(c)}" for c in (host, text))
    found = boilerplate(flat, host, text, scratch, ratio, least_pages).withColumnsRenamed({"host": "_found_host", "lines": "_found"})
    marked = flat.join(found, F.col(host) == F.col("_found_host"), "left")
    old = _lines(F.col(text))
    # the few of the host's lines that this page has, so that its own lines aren't held against all of them
    here = F.array_intersect(F.transform(old, lambda x: F.xxhash64(F.trim(x))), F.col("_found"))
    marked = marked.withColumn("_here", here)
    kept = F.when(F.col("_here").isNull() | (F.size("_here") == 0), old).otherwise(F.filter(old, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("_here"), F.xxhash64(F.trim(x)))))
    marked = marked.withColumn("_kept", kept)
    return marked.select(
        *[F.array_join("_kept", "\n").alias(c) if c == text else F.col(c) for c in flat.columns],
        F.coalesce(F.size(old), F.lit(0)).cast("long"),
        (F.coalesce(F.size(old), F.lit(0)) - F.coalesce(F.size("_kept"), F.lit(0))).cast("long"),
    ).toDF(*names, "n_lines", "n_dropped")


def page_lines(pages: DataFrame) -> DataFrame:
    """``(page_id, host, text)`` of raw web pages."""
    return pages.select("page_id", host_of(F.col("url")).alias("host"), html_lines(F.col("html")).alias("text"))


# The same in DuckDB's SQL, over pages(page_id, url, html).
ORACLE = rf"""
WITH p AS (
  SELECT page_id, nullif(regexp_extract(lower(url), '{_HOST}', 1), '') AS host,
         regexp_replace(regexp_replace(regexp_replace(html, '{_UNSEEN}', '', 'g'), '{_BREAK}', chr(10), 'g'), '{_TAG}', '', 'g') AS text
  FROM pages),
l AS (SELECT page_id, host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM p),
c AS (SELECT host, trim(line, ' ') AS line, count(DISTINCT page_id) AS n FROM l WHERE trim(line, ' ') <> '' AND host IS NOT NULL GROUP BY ALL),
t AS (SELECT host, count(*) AS total FROM p GROUP BY host),
bad AS (SELECT c.host, c.line FROM c JOIN t USING (host) WHERE n >= {LEAST_PAGES} AND n > {RATIO} * total),
m AS (SELECT l.*, bad.line IS NOT NULL AS gone FROM l LEFT JOIN bad ON l.host = bad.host AND trim(l.line, ' ') = bad.line),
g AS (SELECT page_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS text FROM m GROUP BY page_id)
SELECT p.page_id, p.host, CASE WHEN p.text IS NULL THEN NULL ELSE coalesce(g.text, '') END AS text,
       coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped
FROM p LEFT JOIN g ON p.page_id = g.page_id
"""
