"""Bounded loops over plans (J6 redirect chains, J14 pagination).

The driver iterates over *plans*, never over rows.  Chains are resolved on
compact edge tables by pointer doubling (``pointers.py``), in rounds that grow with the
logarithm of the longest chain.  Every round's output is written to the shared
checkpoint folder, so lineage stays short and a lost executor only recomputes one round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import url as U
from ..operators.bloom import BloomFilter
from ..operators.dedup import dedup_urls
from ..operators.enrich import latest_fetch
from ..operators.urls import _require
from ..session import written
from .pointers import path_ends, walks


def redirect_ends(fetch_log: DataFrame) -> DataFrame:
    """Where the redirects from each fetched URL lead, from the latest fetches.

    Columns: url, status; to (null if the latest answer is no redirect), to_status and loop: the end of the chain,
    its latest status, and whether the chain runs into a cycle (``to`` is then the last URL before one would come
    twice); own and own_status, the same for a URL that is on the cycle and counts as visited itself.

    The log is reduced to one row per URL, then to its redirects; chains are resolved on that edge table by
    pointer doubling (:func:`path_ends`), in rounds that grow with the logarithm of the longest chain.
    """
    latest = written(latest_fetch(fetch_log, ["http_status", "location"]).where("url is not null"), "latest")
    moves = F.col("http_status").between(300, 399) & (F.col("location") != "")
    edges = latest.where(moves).select(F.col("url").alias("node"), F.col("http_status").alias("status"), U.resolve_url(F.col("url"), F.col("location")).alias("to"))
    edges = written(edges.where("to is not null"), "redirects")
    # a chain goes on from a URL that it has come to if that URL's status is above 300
    ends = path_ends(edges.where("status > 300").select("node", "to"))
    ends = written(ends, "ends")
    ahead = ends.select(F.col("node").alias("to"), "end", F.col("last").alias("_last"))
    own = ends.where("entry = node").select("node", F.col("last").alias("own"))
    found = edges.select("node", "to").join(ahead, "to", "left").join(own, "node", "left")
    found = found.select("node", F.coalesce("_last", "end", "to").alias("to"), F.col("_last").isNotNull().alias("loop"), "own")
    status = latest.select("url", "http_status")
    found = found.join(status.toDF("to", "to_status"), "to", "left").join(status.toDF("own", "own_status"), "own", "left")
    return status.toDF("url", "status").join(found.withColumnRenamed("node", "url"), "url", "left")


def resolve_redirect_chain(
    urls: DataFrame,
    fetch_log: DataFrame,
    col: str = "url",
    status_col: str = "http_status",
    order_col: str = "row_id",
    max_rounds: int | None = None,
    dedup: bool = True,
) -> DataFrame:
    """Follow redirects until no candidate (300 < status < 400, absolute URL) is left.

    For a pending row, the URL's latest fetch decides: a 3xx answer
    with a location moves the row there with the location's status; a
    (url, status) pair the row has already visited is a loop and stops the
    row where it is (``loop``); any other answer ends the row with that
    status (``resolved``); a URL never fetched stops it (``unfetched``).
    Chains and cycles of any length end, so there is no hop cap unless
    ``max_rounds`` is given (rows still pending after that many hops end as ``cap``).
    Afterwards duplicate URLs are removed (A1, last row wins).
    Adds ``redirect_state`` (NULL for rows that never were candidates).

    The chains are resolved once on the log's redirects (:func:`redirect_ends`); the URL table takes
    part in one equi-join.  A hop cap is walked hop by hop.
    """
    _require(urls, col, status_col, order_col)
    if max_rounds is not None:
        result = _capped_chain(urls, fetch_log, col, status_col, max_rounds)
        return dedup_urls(result, col, order_col) if dedup else result
    dtype = urls.schema[status_col].dataType
    s = F.col(status_col)
    cand = F.coalesce((s > 300) & (s < 400) & U.is_absolute(col), F.lit(False))
    names = ("url", "status", "to", "to_status", "loop", "own", "own_status")
    ends = redirect_ends(fetch_log).select(*[F.col(c).alias(f"_a_{c}") for c in names])
    x = urls.withColumn("_cand", cand)
    x = x.join(ends, x["_cand"] & (x[col] == ends["_a_url"]), "left")
    # the row's own (url, status) is visited as well, if its URL is on the cycle with that status
    own = F.col("_a_own").isNotNull() & s.eqNullSafe(F.col("_a_status"))
    fetched, moved = F.col("_a_url").isNotNull(), F.col("_a_to").isNotNull()
    new_url = F.when(own, F.col("_a_own")).when(moved, F.col("_a_to")).otherwise(F.col(col))
    new_status = F.when(own, F.col("_a_own_status")).when(moved, F.col("_a_to_status")).when(fetched, F.col("_a_status")).otherwise(s).cast(dtype)
    state = F.when(~F.col("_cand"), F.lit(None)).when(~fetched, F.lit("unfetched")).when(F.coalesce("_a_loop", F.lit(False)), F.lit("loop")).otherwise(F.lit("resolved"))
    result = x.select(*[new_url.alias(c) if c == col else new_status.alias(c) if c == status_col else F.col(c) for c in urls.columns], state.alias("redirect_state"))
    return dedup_urls(result, col, order_col) if dedup else result


def _key(url, status):
    return F.concat(url, F.lit("|"), F.coalesce(status.cast("string"), F.lit("")))


def _capped_chain(urls: DataFrame, fetch_log: DataFrame, col: str, status_col: str, max_rounds: int) -> DataFrame:
    """At most ``max_rounds`` hops, one round of joins each."""
    dtype = urls.schema[status_col].dataType
    s = F.col(status_col)
    latest = written(latest_fetch(fetch_log, ["http_status", "location"]), "latest")
    a = latest.select(F.col("url").alias("_a_url"), F.col("http_status").alias("_a_status"), F.col("location").alias("_a_loc"))
    b = latest.select(F.col("url").alias("_b_url"), F.col("http_status").alias("_b_status"))
    cand = F.coalesce((s > 300) & (s < 400) & U.is_absolute(col), F.lit(False))
    state = written(urls.withColumn("redirect_state", F.when(cand, F.lit("pending"))), "chain")
    done_parts = [state.where(F.col("redirect_state").isNull())]
    pend = state.where(F.col("redirect_state") == "pending").withColumn("_seen", F.array(_key(F.col(col), s)))
    for _ in range(max_rounds):
        x = pend.join(a, pend[col] == a["_a_url"], "left")
        moves = F.col("_a_status").between(300, 399) & F.col("_a_loc").isNotNull() & (F.col("_a_loc") != "")
        x = x.withColumn("_next", F.when(moves, U.resolve_url(F.col(col), F.col("_a_loc"))))
        x = x.join(b, x["_next"] == b["_b_url"], "left")
        nk = _key(F.col("_next"), F.col("_b_status"))
        kind = (
            F.when(F.col("_a_url").isNull(), F.lit("unfetched"))
            .when(F.col("_next").isNull(), F.lit("stay"))
            .when(F.array_contains(F.col("_seen"), nk), F.lit("loop"))
            .otherwise(F.lit("move"))
        )
        x = x.withColumn("_kind", kind)
        k = F.col("_kind")
        s2 = F.col("_b_status")
        new_url = F.when(k == "move", F.col("_next")).otherwise(F.col(col))
        new_status = F.when(k == "move", s2).when(k == "stay", F.col("_a_status")).otherwise(s).cast(dtype)
        new_state = (
            F.when(k == "move", F.when((s2 > 300) & (s2 < 400), F.lit("pending")).otherwise(F.lit("resolved")))
            .when(k == "stay", F.lit("resolved"))
            .otherwise(k)
        )
        new_seen = F.when(k == "move", F.array_append(F.col("_seen"), nk)).otherwise(F.col("_seen"))
        cols = [
            new_url.alias(c) if c == col else new_status.alias(c) if c == status_col else F.col(c)
            for c in urls.columns
        ]
        step = written(x.select(*cols, new_state.alias("redirect_state"), new_seen.alias("_seen")), "chain")
        done_parts.append(step.where(F.col("redirect_state") != "pending").drop("_seen"))
        pend = step.where(F.col("redirect_state") == "pending")
    done_parts.append(pend.drop("_seen").withColumn("redirect_state", F.lit("cap")))
    return reduce(lambda l, r: l.unionByName(r), done_parts)


def follow_pagination(
    seeds: DataFrame,
    pages: DataFrame,
    content: list,
    pagination,
    seed_col: str = "seed_id",
    url_col: str = "url",
    max_pages: int | None = None,
) -> DataFrame:
    """From each seed URL, extract items and follow the next-page link.

    Chains end at a page never fetched (not in ``pages``), at a page without
    a next link, or at a URL this seed already visited (so cycles end);
    ``max_pages`` is an optional extra bound on hops.  Result: one row per
    fetched page of a chain: seed, hop, page URL and one items column per
    content rule.

    One pass over the pages gives a compact edge table (page URL → next URL), on which the
    chains are found (:func:`walk_pages`).  The content rules are evaluated on the pages that a
    Bloom filter of the reached URLs lets through, and their items joined exactly.
    """
    from ..operators.elements import Rule, extract_items

    walked = walk_pages(seeds, pages, Rule("_next", pagination.tag, pagination.tests, pagination.output), seed_col, url_col, max_pages)
    walked = written(walked, "reached")
    # items are taken where the bodies lie; only they travel to the join
    body = BloomFilter(walked.select("url").distinct(), "url").keep(pages, "url")
    body = body.select(F.struct("url", _copy(pages).alias("_copy")).alias("_page"), "html")
    items = extract_items(body, list(content), id_col="_page", html_col="html").dropDuplicates(["page_id"])
    items = items.select(F.col("page_id.url").alias("url"), F.col("page_id._copy").alias("_copy"), *[r.name for r in content])
    out = walked.join(items, ["url", "_copy"])
    return out.select("seed_id", "hop", F.col("url").alias("page_url"), *[r.name for r in content])


def walk_pages(seeds: DataFrame, pages: DataFrame, nxt_rule, seed_col: str = "seed_id", url_col: str = "url", max_pages: int | None = None) -> DataFrame:
    """The pages (seed_id, url, hop, _copy) that the next-page rule reaches from each seed.

    One pass over the pages gives a compact edge table (without Python for attribute rules); the rounds only
    walk that, doubling the pointers (:func:`walks`).  Of several copies of a page one is chosen by ``_copy`` (its
    smallest page_id, or a hash of its body), for its link and, by the caller, for its items.
    """
    from ..operators.elements import extract_items

    body = pages.select(F.struct("url", _copy(pages).alias("_copy")).alias("_page"), "html")
    nx = extract_items(body, [nxt_rule], id_col="_page", html_col="html")
    first = F.when(F.size("_next") > 0, F.element_at("_next", 1))
    url = F.col("page_id.url")
    edges = nx.select(url.alias("url"), F.struct(F.col("page_id._copy").alias("_copy"), U.resolve_url(url, first).alias("_to")).alias("_e"))
    edges = written(edges.where("url is not null").groupBy("url").agg(F.min("_e").alias("_e")).select("url", "_e._copy", "_e._to"), "edges")
    fetched = edges.select("url")
    starts = seeds.select(F.col(seed_col).alias("seed_id"), F.col(url_col).alias("url")).join(fetched, "url", "left_semi")
    links = edges.where("_to <> ''").select(F.col("url").alias("node"), F.col("_to").alias("to"))
    links = links.join(fetched.withColumnRenamed("url", "to"), "to", "left_semi")  # only pages that were fetched
    found = walks(starts.withColumnRenamed("url", "node"), written(links, "links"), max_pages)
    return found.join(edges.select(F.col("url").alias("node"), "_copy"), "node").select("seed_id", F.col("node").alias("url"), "hop", "_copy")


def _copy(pages: DataFrame):
    return F.col("page_id").cast("long") if "page_id" in pages.columns else F.xxhash64("html")
