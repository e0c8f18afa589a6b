"""Composite jobs (L1-L3).

L1 is the reference's automation chain: a fixed order of steps, each one a
lazy DataFrame transform; only the redirect chain (J6) runs its own actions
(one per round).  Page bodies are reduced to per-page numbers before they
meet the URL table, so ``html`` never travels through a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import content as C
from ..operators.bloom import BloomFilter
from ..operators.dedup import dedup_urls
from ..operators.enrich import enrich_backlinks, enrich_ip, enrich_status, update_by_url
from ..operators.filters import remove_bad_urls
from ..session import written
from .loops import resolve_redirect_chain

STEP_ORDER = ("dedup", "status", "remove_bad", "redirects", "dofollow", "backlinks", "obl", "ip")


def clean_and_enrich(
    urls: DataFrame,
    fetch_log: DataFrame | None = None,
    pages: DataFrame | None = None,
    metrics: DataFrame | None = None,
    metric_cols: list[str] | None = None,
    backlink_level: int = 0,
    dns: DataFrame | None = None,
    suffixes=None,
    steps: tuple[str, ...] = STEP_ORDER,
    col: str = "url",
) -> DataFrame:
    """L1: dedup → status → remove bad → redirects (→ dedup → remove bad) →
    dofollow → backlinks → obl → ip.

    dofollow and obl only fill empty cells from the same page bodies, so both
    come from one pass over the pages and one join (order-independent).

    Steps are switched individually; a step whose input is missing is
    skipped.  ``remove_bad`` is independent of the others, as in the
    reference.  Enrichment fills empty cells only.
    """
    unknown = set(steps) - set(STEP_ORDER)
    if unknown:
        raise ValueError(f"unknown steps {sorted(unknown)}")
    df = urls
    if "dedup" in steps:
        df = dedup_urls(df, col)
    if "status" in steps and fetch_log is not None:
        df = enrich_status(df, fetch_log, col)
    if "remove_bad" in steps and "http_status" in df.columns:
        df = remove_bad_urls(df)
    if "redirects" in steps and fetch_log is not None:
        df = resolve_redirect_chain(df, fetch_log, col, dedup=True)
        if "remove_bad" in steps:
            df = remove_bad_urls(df)
    page_cols = [c for c, step in (("dofollow_pct", "dofollow"), ("obl", "obl")) if step in steps]
    if page_cols and pages is not None:
        # one pass over the page bodies gives both numbers; one join fills both
        stats = C.page_link_stats(pages)
        ext = F.col("external").cast("double")
        nof = F.col("external_nofollow").cast("double")
        answers = stats.select(
            F.col("url").alias(col),
            F.when(F.col("empty_page"), F.lit(-2.0)).when(ext == 0, F.lit(0.0)).otherwise((ext - nof) * 100.0 / ext).alias("dofollow_pct"),
            F.when(F.col("empty_page"), F.lit(-1)).otherwise(F.col("external")).cast("int").alias("obl"),
        ).select(col, *page_cols)
        for c, dtype in (("dofollow_pct", "double"), ("obl", "int")):
            if c in page_cols and c not in df.columns:
                df = df.withColumn(c, F.lit(None).cast(dtype))
        df = update_by_url(df, answers, page_cols, col, only_empty=True)
    if "backlinks" in steps and metrics is not None and metric_cols:
        df = enrich_backlinks(df, metrics, metric_cols, backlink_level, suffixes, col)
    if "ip" in steps and dns is not None:
        df = enrich_ip(df, dns, col)
    return df


def ingest_backlinks(api_raw: DataFrame, provider: str, fetch_log: DataFrame | None = None, pages: DataFrame | None = None,
                     steps: tuple[str, ...] = ("status", "dofollow")) -> DataFrame:
    """L3: provider link lists (S11/S13/S14) or Majestic referring domains (S12,
    ``provider="majestic_ref_domains"``) → the provider's backlinks schema (S6)
    → numbered in reply order (U3; persisted, so ids are stable) → L1 with status and dofollow only.

    Error replies give no rows here; :func:`ingest_errors` lists them.
    """
    from ..operators.sets import numbered
    from ..sources import files as SF

    rows = _provider_rows(api_raw, provider)
    if "error" in rows.columns:
        rows = rows.where(F.col("error").isNull()).drop("error")
    table = SF.align_to_schema(numbered(rows), f"backlinks/{provider.split('_')[0]}")
    return clean_and_enrich(table, fetch_log=fetch_log, pages=pages, steps=steps)


def _provider_rows(api_raw: DataFrame, provider: str) -> DataFrame:
    from ..sources import providers as PR

    parsers = {"majestic": PR.parse_majestic_links, "majestic_ref_domains": PR.parse_majestic_ref_domains,
               "ahrefs": PR.parse_ahrefs_links, "moz": PR.parse_moz_links}
    if provider not in parsers:
        raise ValueError(f"unknown provider {provider!r}")
    return parsers[provider](api_raw)


def ingest_errors(api_raw: DataFrame, provider: str) -> DataFrame:
    """L3: (backlink_for, error) of the replies that gave no rows."""
    from ..sources import providers as PR

    if provider.startswith("majestic"):
        return PR.provider_errors(api_raw).select(F.col("target").alias("backlink_for"), "error")
    return _provider_rows(api_raw, provider).where(F.col("error").isNotNull()).select("backlink_for", "error")


def _rule_items(pages: DataFrame, frontier: DataFrame, rule, targets: DataFrame, values: dict) -> DataFrame:
    """(url, custom1, custom2, page_url, pos, item) of one rule for every frontier row and page of ``targets`` (url, page_url).

    Items or, for a rule whose tests hold placeholders, elements are taken where the bodies lie;
    only they are joined to the frontier, by a sort-merge join (:func:`scrape_snapshot`).
    """
    from ..functions.url import decode_if_absolute
    from ..operators.content import html_to_text
    from ..operators.elements import Rule, extract_elements, extract_items

    asked = frontier.join(targets.hint("merge"), "url")
    if not any("{%" in t.value for t in rule.tests):
        plain = Rule("_items", rule.tag, rule.tests, rule.output, keep_html=rule.keep_html)
        items = extract_items(pages.select("url", "html"), [plain], id_col="url")
        items = items.select(F.col("page_id").alias("page_url"), F.posexplode("_items").alias("pos", "item"))
        return asked.join(items.join(_copies(pages).hint("merge"), "page_url").hint("merge"), "page_url")
    tags = None if rule.tag == "*" else [rule.tag]
    el = extract_elements(pages.select("url", "html"), id_col="url", tags=tags).withColumnRenamed("page_id", "page_url")
    rows = asked.join(el.hint("merge"), "page_url").withColumn("_hit", rule.condition(values)).join(_copies(pages).hint("merge"), "page_url")
    keys = [c for c in rows.columns if c in ("url", "custom1", "custom2", "page_url", "page_id", "_row")]
    if rule.output == "count":
        return rows.groupBy(*keys).agg(F.lit(0).alias("pos"), F.count_if("_hit").cast("string").alias("item"))
    item = rule.value() if rule.keep_html else decode_if_absolute(html_to_text(rule.value()))
    return rows.where("_hit").select(*keys, "pos", item.alias("item"))


def _copies(pages: DataFrame) -> DataFrame:
    return pages.groupBy(F.col("url").alias("page_url")).agg(F.max("page_id").alias("page_id"))


def scrape_snapshot(spark, template: str, custom1: DataFrame | None, custom2: DataFrame | None, pages: DataFrame, rule,
                    http_rules=None, content_rules=None, headers: list[str] | None = None, footprint: str | None = None,
                    pagination=None, json_path: str | None = None, max_pages: int | None = None) -> DataFrame:
    """L2: frontier (G2 with G4, G5) → fetched pages → guards (F12, F13) → rule items
    (C3, P21/P16) → prefix/suffix with placeholders (P11) → optional split into
    header columns (P12/P13) → one row per distinct item (A1, last page wins).

    ``rule`` is one rule or a list of them.  Placeholders in a rule's tests
    (``{%custom1%}``, ``{%custom2%}``, ``{%footprint%}``, ``{%scrapurl%}``) are filled from each
    frontier row.  With ``pagination`` (an attribute rule) the guarded pages are followed
    from each frontier URL (J14) and every page on the way is scraped.
    With ``json_path`` the bodies are JSON and the items those of that
    path (C8); the rule then only decorates.  Page bodies never
    travel: a Bloom filter of the frontier's URLs picks the pages in the scan, items are extracted in
    place and joined to the frontier by URL.  These joins are sort-merge joins: all sides grow with the frontier, and the
    planner's size of exploded items (a VARIANT counts 2 KB of a row) has it send millions of them through the driver.  A
    page fetched several times counts as its rows together, and ties are broken by
    page, frontier row and position.
    """
    from ..functions.jsonpick import json_items
    from ..operators.elements import Rule, decorate_items, split_custom_columns
    from ..operators.filters import apply_content_guard, apply_http_guard
    from ..operators.frontier import first_of_macro, frontier_customs
    from ..operators.urls import coerce_metric_types
    from .loops import walk_pages

    rules = list(rule) if isinstance(rule, (list, tuple)) else [rule]
    texts = [x for r in rules for x in (r.prefix, r.suffix, *[t.value for t in r.tests])]
    frontier = frontier_customs(spark, template, custom1, custom2, footprint=footprint, rule_texts=texts)
    frontier = frontier.withColumn("url", first_of_macro(F.col("url")))

    def guarded(df: DataFrame) -> DataFrame:
        if http_rules:
            df = apply_http_guard(df, http_rules).where(F.col("disposition") == "process").drop("disposition")
        if content_rules:
            df = apply_content_guard(df, content_rules).where(F.col("content_disposition") == "process").drop("content_disposition")
        return df

    urls = frontier.select("url").distinct()
    if pagination is not None:
        nxt = Rule("_next", pagination.tag, pagination.tests, pagination.output)
        walked = walk_pages(urls.withColumn("seed_id", F.col("url")), guarded(pages), nxt, max_pages=max_pages)
        targets = walked.select(F.col("seed_id").alias("url"), F.col("url").alias("page_url"))
    else:
        targets = urls.withColumn("page_url", F.col("url"))
    targets = written(targets, "targets")
    # only pages that the frontier may reach are guarded and parsed; the joins below are exact
    fetched = guarded(BloomFilter(targets.select("page_url").distinct(), "page_url").keep(pages, "url"))
    values = {"custom1": F.col("custom1"), "custom2": F.col("custom2"), "scrapurl": F.col("page_url"), "footprint": F.lit(footprint or "")}
    parts = []
    for k, r in enumerate(rules):
        if json_path is not None:
            items = json_items(fetched.select("page_id", F.col("url").alias("page_url"), "html"), "html", json_path, keep=["page_id", "page_url"])
            rows = frontier.join(targets.hint("merge"), "url").join(items.hint("merge"), "page_url")
        else:
            rows = _rule_items(fetched, frontier, r, targets, values)
        rows = rows.withColumn("_footprint", F.lit(footprint or "")).withColumn("_rule", F.lit(k))
        rows = decorate_items(rows, "item", r.prefix, r.suffix, {"custom1": "custom1", "custom2": "custom2", "scrapurl": "page_url", "footprint": "_footprint"})
        parts.append(rows.select("page_id", "url", "page_url", "custom1", "custom2", "pos", "_rule", "item"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.withColumn("_order", F.struct("page_id", "page_url", "url", "custom1", "custom2", "_rule", "pos"))
    rows = dedup_urls(rows, "item", "_order").drop("_order", "_rule", "pos")
    if headers:
        from .. import schemas as S

        names = S.custom_scrap_columns(headers)
        rows = split_custom_columns(rows, "item", names[: len(headers)])
        for c in names[len(headers):]:
            rows = rows.withColumn(c, F.lit(None).cast(S.TYPES.get(c, "string")))
        rows = coerce_metric_types(rows)
    return rows
