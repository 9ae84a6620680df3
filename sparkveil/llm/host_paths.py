"""Main text of web pages by consensus of a host's pages.

Each page scores its containers and votes, with a share of its best score, for their paths: tags and classes from the
body on, numbers made alike. Spark adds the votes up for each host. Then each page is read again along its host's
winning path; a page that lacks it, or holds little there, falls back on its own best container.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .page_tree import Page
from .shared import stored

#: Hosts whose paths are broadcast, at 32 bytes each; beyond, only those are that hold more than one in HOT pages.
BROADCAST_HOSTS = 100_000
HOT = 256


def host_of(url: Column) -> Column:
    """The host in lower case without user, port and ``www.``; null where a text is no such address."""
    host = F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def _vote(batches):
    for batch in batches:
        rows = [(host, path, name, share, int(share == 1000))
                for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for path, name, share in Page(html).votes()]
        cols = list(zip(*rows)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.binary(), pa.string(), pa.int64(), pa.int64()))],
            ["host", "path", "name", "votes", "pages"])


def winning_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, name, votes, pages): for each host the path with most votes, ties to the smaller digest.

    Votes are whole numbers, so their sum does not depend on the order in which tasks end.
    """
    given = pages.select(host_of(F.col(url_col)).alias("host"), html_col).filter(F.col("host").isNotNull())
    cast = given.mapInArrow(_vote, "host string, path binary, name string, votes long, pages long")
    sums = cast.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("pages").alias("pages"), F.min("name").alias("name"))
    low = F.struct(-F.col("votes"), F.col("path"))
    return sums.groupBy("host").agg(
        F.min_by("path", low).alias("path"), F.min_by("name", low).alias("name"), F.max("votes").alias("votes"), F.sum("pages").alias("pages"))


def _with_path(pages: DataFrame, winners: DataFrame, most: int) -> DataFrame:
    """``pages`` (page_id, url, html, host) with the winning path of their host, null where there is none.

    The keys sent to all tasks are hashes of fixed size. Of up to ``most`` hosts all are sent; of more, only the hot ones,
    fewer than HOT by their definition, while all other hosts' pages move to their path by a join on the host.
    """
    def keys(host):
        return [F.xxhash64(host).alias("_llm_a"), F.xxhash64(F.lit(1), host).alias("_llm_b")]

    def sent(rows):
        return F.broadcast(rows.select(*keys(F.col("host")), F.col("path").alias("_llm_path")))

    pages = pages.select("*", *keys(F.col("host")))
    if winners.count() <= most:
        return pages.join(sent(winners), ["_llm_a", "_llm_b"], "left")
    total = winners.agg(F.sum("pages")).first()[0] or 0
    hot = F.col("pages") * HOT > total
    pages = pages.join(sent(winners.filter(hot)), ["_llm_a", "_llm_b"], "left")
    # pages that know their path, or have no host, are spread under keys of their own
    alone = F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string"))
    pages = pages.withColumn("_llm_key", F.when(F.col("_llm_path").isNotNull() | F.col("host").isNull(), alone).otherwise(F.col("host")))
    rest = winners.filter(~hot).select(F.col("host").alias("_llm_key"), F.col("path").alias("_llm_rest"))
    return pages.join(rest, "_llm_key", "left").withColumn("_llm_path", F.coalesce("_llm_path", "_llm_rest"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """One row for each page: its id, url, ``text``, ``path`` of what was read, and ``by_host`` where the host decided.

    Blocks are lines of the text, white space inside them is one space, character references are decoded. Menus, headers,
    footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are left out by element, class, id and
    role; the rest of the article stays whole. A null or empty page, or one without text, gives an empty text; a page
    without a host reads its own best container; repeated rows are pages of their own, which each vote; an empty table
    gives no rows. Other columns are not read.
    """
    given = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    winners = stored(winning_paths(given), "host-paths")
    placed = _with_path(given, winners, broadcast_hosts).select("page_id", "url", "html", "_llm_path")

    def read(batches):
        for batch in batches:
            text, path, by = [], [], []
            for html, given_path in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                page = Page(html)
                containers, agreed = page.chosen(given_path)
                text.append(page.text(containers))
                path.append(page.shown(containers[0]))
                by.append(agreed)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(path, pa.string()), pa.array(by, pa.bool_())],
                                             ["page_id", "url", "text", "path", "by_host"])

    kind = placed.schema["page_id"].dataType.simpleString()
    return placed.mapInArrow(read, f"page_id {kind}, url string, text string, path string, by_host boolean")
