r"""Operator 7: line dedup by site-relative frequency. DataFrame functions only.

Lines (text split at \n) are counted per host: on how many of its pages does a
line occur, each page counting once? A line on more than a given share of a
host's pages is boilerplate there and is dropped from all its pages; the same
line on another host stays unless it is frequent there too.

`host_pages` makes pages fit for that: the host out of the url, and the lines of
text out of the markup. Any table with a column of hosts (or sources) and one of
texts will do as well. Copies of a page are pages like others; with `copies_once`, rows of
a host with equal texts count as one page, for tables in which whole texts are copied.
Lines are compared by 64-bit hashes.

A page has few lines, so few lines can be frequent: with an average of a lines
a page, at most a / share lines of a host are boilerplate. That is what makes
one short list of line hashes per host possible. The lists are written down,
so the join that applies them knows their size: Spark broadcasts them while
they are under the session's threshold, and else joins by host, where adaptive
execution splits a host that holds much of the corpus.

Defined cases: a null text has no lines and stays null; lines without a word
are never dropped, and rejoining keeps their places; null is a host of its
own; every row with a text is a page (a null text is none), so a mirrored page counts as
often as it is there, but with `copies_once` only once; a line on fewer than
`LEAST_PAGES` pages is never dropped, since every line of a host's only page would be
frequent, nor is one at exactly the share. All columns of the input are
returned. A url without a scheme and a host, or null, has a null host; markup
without text gives an empty text, and null html a null text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c


def _any_case(*names: str) -> str:
    return "(?:" + "|".join("".join(f"[{x}{x.upper()}]" if x.isalpha() else x for x in name) for name in names) + ")"


#: In the query, a line on more than so many percent of a host's pages goes.
PERCENT = 10
#: Pages that a boilerplate line stands on at least.
LEAST_PAGES = 2
# Patterns that Java and DuckDB read alike.
_END = r"(?:[ \t\r\n/][^>]*)?>"
#: The host after scheme and user, without the port.
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
#: Markup whose content is no text.
HIDDEN = r"(?s)<!--.*?-->|" + "|".join(f"<{_any_case(x)}{_END}.*?</{_any_case(x)}[ \\t\\r\\n]*>" for x in ("script", "style"))
#: Tags that begin or end a line.
BLOCK = "</?" + _any_case(*"address article aside blockquote body br dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table tbody td tfoot th thead title tr ul".split()) + _END
TAG = r"<[A-Za-z/!?][^>]*>"
#: Spaces around line ends, and lines without anything.
GAPS = r"[ \t\r\f\x0B]*\n[ \t\r\f\x0B\n]*"
#: The entities of the markup itself; the ampersand comes last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, HOST, 1)
    return F.when(found != "", F.lower(found))


def text_of(html: Column) -> Column:
    """The text of a page, a line for each block."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, F.lit(HIDDEN), F.lit("\n")), F.lit(BLOCK), F.lit("\n")), F.lit(TAG), F.lit(""))
    for name, what in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(what))
    return F.trim(F.regexp_replace(text, F.lit(GAPS), F.lit("\n")), F.lit(" \t\r\n\f\x0b"))


def host_pages(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """pages with host and text in place of url and html. Written once, since
    lines are counted first and dropped then."""
    rest = [F.col(f"`{x}`") for x in pages.columns if x not in (url, html, "host", "text")]
    return c.saved(pages.select(*rest, host_of(F.col(f"`{url}`")).alias("host"), text_of(F.col(f"`{html}`")).alias("text")), "host-pages")


def boilerplate(df: DataFrame, host: str, text: str, percent: int, copies_once: bool = False) -> DataFrame:
    """(host, lines): hashes of the boilerplate lines of each host that has any."""
    lines = F.array_distinct(F.split(F.col(f"`{text}`"), "\n", -1))
    worded = F.filter(lines, lambda x: x.rlike(c.WORD))
    page = F.xxhash64(F.col(f"`{text}`")).alias("page")
    # the hash of a page comes before its lines are taken apart, so no line carries the page along
    pages = df.filter(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{host}`").alias("host"), page, worded.alias("lines"))
    seen = pages.select("host", "page", F.explode("lines").alias("line")).select("host", "page", F.xxhash64("line").alias("line"))
    total = pages.select(F.col("host").alias("of_host"), "page")
    if copies_once:
        seen, total = seen.distinct(), total.distinct()
    seen, total = seen.groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages")), total.groupBy("of_host").agg(F.count(F.lit(1)).alias("all_pages"))
    often = seen.filter(F.col("pages") >= LEAST_PAGES).join(total, F.col("host").eqNullSafe(F.col("of_host"))).filter(100 * F.col("pages") > percent * F.col("all_pages"))
    return often.groupBy("host").agg(F.collect_set("line").alias("lines"))


def drop_boilerplate(df: DataFrame, host: str = "host", text: str = "text", percent: int = 5, copies_once: bool = False) -> DataFrame:
    """df with its boilerplate lines dropped, and n_lines and n_dropped.

    Two new columns; where df has columns of these names, theirs are replaced.
    """
    names = c.fresh(df, *(f"c{k}" for k in range(len(df.columns))))
    plain = df.toDF(*names)
    h, t = (names[df.columns.index(x)] for x in (host, text))
    lists = c.saved(boilerplate(plain, h, t, percent, copies_once), "boilerplate")
    joined = plain.join(lists, F.col(h).eqNullSafe(F.col("host")), "left")
    all_lines = F.split(F.col(t), "\n", -1)
    left = F.when(F.col("lines").isNull(), all_lines).otherwise(F.filter(all_lines, lambda x: ~F.array_contains("lines", F.xxhash64(x))))
    joined = joined.withColumn("all_n", F.coalesce(F.size(all_lines), F.lit(0)).cast("long")).withColumn("left_lines", left)
    out = [F.col(a).alias(b) if a != t else F.array_join("left_lines", "\n").alias(b) for a, b in zip(names, df.columns) if b not in ("n_lines", "n_dropped")]
    n = F.when(F.col(t).isNull(), F.lit(0)).otherwise(F.col("all_n"))
    kept = F.when(F.col(t).isNull(), F.lit(0)).otherwise(F.size("left_lines"))
    return joined.select(*out, n.cast("long").alias("n_lines"), (n - kept).cast("long").alias("n_dropped"))


def op7_site_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `pages`, by the host of their url; texts as they are afterwards."""
    return drop_boilerplate(host_pages(c.table(spark, sf_dir, "pages")), percent=PERCENT)


def frequency_sql(pages: str, percent: int, copies_once: bool = False) -> str:
    """The same in SQL over a select of (id, host, text) with other columns."""
    n, of = ("count(DISTINCT text)", "count(DISTINCT l.text)") if copies_once else ("count(text)", "count(DISTINCT l.page)")
    return rf"""
WITH pages_ AS (SELECT row_number() OVER () AS page, * FROM ({pages})),
lines AS (
  SELECT page, host, text, u.pos, u.line FROM (
    SELECT page, host, text, unnest(list_zip(range(1, len(l) + 1), l)) AS z FROM (SELECT *, string_split(text, chr(10)) AS l FROM pages_ WHERE text IS NOT NULL)
  ), LATERAL (SELECT z[1] AS pos, z[2] AS line) u
),
totals AS (SELECT host, {n} AS n FROM pages_ GROUP BY host),
often AS (
  SELECT l.host, l.line FROM lines l JOIN totals t ON l.host IS NOT DISTINCT FROM t.host
  WHERE regexp_matches(l.line, '[^\x20\x09-\x0D]') GROUP BY l.host, l.line, t.n HAVING 100 * {of} > {percent} * t.n AND {of} >= {LEAST_PAGES}
),
marked AS (SELECT l.*, o.line IS NOT NULL AS gone FROM lines l LEFT JOIN often o ON l.host IS NOT DISTINCT FROM o.host AND l.line = o.line),
joined AS (
  SELECT page, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped
  FROM marked GROUP BY page
)
SELECT p.* EXCLUDE (page, text), j.text, coalesce(j.n_lines, 0)::BIGINT AS n_lines, coalesce(j.n_dropped, 0)::BIGINT AS n_dropped FROM pages_ p LEFT JOIN joined j USING (page)
"""


def _pages_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    text = f"regexp_replace(regexp_replace(regexp_replace(html, {quoted(HIDDEN)}, chr(10), 'g'), {quoted(BLOCK)}, chr(10), 'g'), {quoted(TAG)}, '', 'g')"
    for name, what in ENTITIES:
        text = f"replace({text}, {quoted(name)}, {quoted(what)})"
    text = f"trim(regexp_replace({text}, {quoted(GAPS)}, chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    return f"SELECT page_id, CASE WHEN regexp_extract(url, {quoted(HOST)}, 1) <> '' THEN lower(regexp_extract(url, {quoted(HOST)}, 1)) END AS host, {text} AS text FROM pages"


OP7_SQL = frequency_sql(_pages_sql(), PERCENT)
