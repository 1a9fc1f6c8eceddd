"""Line dedup by site-relative frequency.

Pages are grouped by host. The pages of a host that contain a line, divided by the host's pages,
give the line's ratio; lines above a boilerplate ratio are dropped from that host's pages.

Only hashes are shuffled: a page sends each of its distinct lines once as (host, 64-bit hash),
counted before the exchange, so a hot host or line costs one row per task. A line above the ratio
is on more than ratio * pages of the host's pages, so a host has at most (mean lines per page) /
ratio such lines: the list joined back to the pages is bounded by a page's length, not by the host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import SPACE, whole

#: Up to this many flagged lines in all, the lists go to every executor; beyond, pages are joined by host.
BROADCAST_LINES = 500_000


def host(url: Column) -> Column:
    """Lower-case host of a URL, without user and port; null where there is none."""
    name = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(name != "", name)


def split_lines(text: Column) -> Column:
    """Lines of raw HTML or text: cut at line feeds and after block-level closing tags, ends trimmed, blank ones out."""
    marked = F.regexp_replace(whole(text), r"(?i)(</(?:p|div|li|h[1-6]|tr|table|ul|ol|nav|article|section|header|footer|script|style|title)>|<br ?/?>)", "$1\n")
    return F.filter(
        F.transform(F.split(marked, "\n", -1), lambda x: F.trim(x)), lambda x: x.rlike(f"[^{SPACE}]")
    )


def frequencies(pages: DataFrame) -> DataFrame:
    """(host, line, pages_with, pages) from (host, hashes): line is the 64-bit hash of each distinct line of each host."""
    own = pages.select("host", F.explode(F.array_distinct("hashes")).alias("line"))
    counts = own.groupBy("host", "line").agg(F.count("*").alias("pages_with"))
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    return counts.join(totals, "host")


def dedup(pages: DataFrame, ratio: float = 0.3, min_pages: int = 5, text: str = "html", url: str = "url") -> DataFrame:
    """pages with `lines` (those kept, in order), `n_lines` and `n_dropped`.

    A line is dropped where its host has min_pages pages or more and it is on more than `ratio` of them. Edge cases:
    a page without a host, with a null or empty text, keeps what it has; repeated rows count as pages of their own;
    repeated lines within a page count once and are dropped together; an empty table gives an empty result. Extra
    columns pass through, whatever they are called, but for those that bear the name of an output, which replaces them.
    """
    df = pages.select(F.struct("*").alias("row"), split_lines(F.col(text)).alias("lines"), host(F.col(url)).alias("host"))
    df = df.withColumn("hashes", F.transform("lines", lambda x: F.xxhash64(x)))
    flagged = (
        frequencies(df.select("host", "hashes").filter(F.col("host").isNotNull()))
        .filter((F.col("pages") >= min_pages) & (F.col("pages_with") > ratio * F.col("pages")))
        .groupBy("host")
        .agg(F.collect_list("line").alias("drop"))
    )
    few = flagged.agg(F.sum(F.size("drop"))).first()[0] or 0
    out = df.join(F.broadcast(flagged) if few <= BROADCAST_LINES else flagged, "host", "left")
    kept = F.filter("lines", lambda x: ~F.array_contains("drop", F.xxhash64(x)))
    out = out.withColumn("kept", F.when(F.col("drop").isNull(), F.col("lines")).otherwise(kept))
    n = F.size("lines").cast("long")
    own = [F.col("row").getField(c).alias(c) for c in pages.columns if c not in ("lines", "n_lines", "n_dropped")]
    return out.select(*own, F.col("kept").alias("lines"), n.alias("n_lines"), (n - F.size("kept")).alias("n_dropped"))


def digest(done: DataFrame) -> DataFrame:
    return done.select(
        "page_id", "n_lines", "n_dropped", F.sha2(F.array_join("lines", "\n"), 256).alias("kept_sha256")
    )


#: DuckDB twin of digest(dedup(pages)).
ORACLE = r"""
WITH p AS (
  SELECT page_id, row_number() OVER () AS r,
         nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '') AS host,
         list_filter(list_transform(string_split(regexp_replace(coalesce(html, ''),
           '(</(?:p|div|li|h[1-6]|tr|table|ul|ol|nav|article|section|header|footer|script|style|title)>|<br ?/?>)',
           E'\\1\n', 'gi'), E'\n'), lambda x: trim(x, ' ')), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM pages),
n AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
l AS (SELECT r, host, unnest(list_distinct(lines)) AS line FROM p WHERE host IS NOT NULL),
f AS (SELECT l.host, l.line FROM l JOIN n USING (host) GROUP BY l.host, l.line, n.pages
      HAVING n.pages >= 5 AND count(*) > 0.3 * n.pages),
d AS (SELECT host, list(line) AS gone FROM f GROUP BY host),
k AS (SELECT page_id, lines, list_filter(lines, lambda x: NOT coalesce(list_contains(gone, x), false)) AS kept
      FROM p LEFT JOIN d USING (host))
SELECT page_id, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped,
       sha256(array_to_string(kept, E'\n')) AS kept_sha256
FROM k
"""
