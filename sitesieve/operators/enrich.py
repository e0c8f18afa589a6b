"""Enrichment joins and table statistics.

Answers from the network are tables here (``fetch_log``, ``dns``, provider
metrics, availability replies).  Enrichment is a left join of the URL table
with the de-duplicated answers:

* answers are reduced to one row per key first (``max_by``/``min_by``,
  partially aggregated, so a hot key costs one row per map task);
* the join is a plain equi-join: AQE broadcasts the answer side when its
  measured size is small and otherwise keeps a sort-merge join whose skewed
  partitions (a URL or host holding a large share of the table) it splits;
* only cells that are still empty are filled (F14), as in the reference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import url as U
from ..session import ensure_checkpoint_dir, written
from .bloom import anti_join
from .urls import SuffixTable, _require, registered_domain, with_public_suffix

# Message for a TLD the availability API does not support (fixed value).
TLD_NOT_SUPPORTED = "tld not supported by API"
# Value for a host without any address (fixed value, spelling as in the reference).
UNKNOWN_IP = "Unknow"

MAX_SALT = 1 << 14  #: salts of a join: hot keys are fewer, so their table can be broadcast


def latest_fetch(fetch_log: DataFrame, cols: list[str] | None = None, url_col: str = "url", ts_col: str = "fetched_at") -> DataFrame:
    """One row per URL: the columns of its latest fetch.  Of fetches at the same time the one with the largest values counts."""
    _require(fetch_log, url_col, ts_col)
    cols = cols or [c for c in fetch_log.columns if c not in (url_col, ts_col)]
    picked = fetch_log.groupBy(url_col).agg(F.max(F.struct(F.col(ts_col).alias("_at"), *cols)).alias("_f"))
    return picked.select(url_col, *[F.col(f"_f.{c}").alias(c) for c in cols])


def hot_keys(df: DataFrame, keys: list[str], tasks: int) -> DataFrame:
    """The keys that hold more than a task's share of the rows, were they dealt to ``tasks`` tasks: (_hash, _salts).

    A frequency sketch finds them in one pass with constant memory; fewer than ``tasks`` keys can be that
    frequent, and a key with a share p of the rows gets about p * ``tasks`` salts, so all salts together are at most 2 * ``tasks``.
    The counts are estimates: they decide how rows are spread, not what matches.  The table is written
    once, so both sides of a join see the same keys.  Rows with a null in a key match nothing and are not counted.
    """
    if not 1 < tasks <= MAX_SALT:
        raise ValueError(f"the number of salts must be from 2 to {MAX_SALT}, not {tasks}")
    hashes = df.dropna(subset=keys).select(F.xxhash64(*keys).alias("_hash"))
    found = hashes.agg(F.call_function("approx_top_k", F.col("_hash"), F.lit(tasks), F.lit(16 * tasks)).alias("_top"), F.count("*").alias("_n"))
    each = found.select("_n", F.explode("_top").alias("_t")).select(F.col("_t.item").alias("_hash"), (F.col("_t.count") * tasks / F.col("_n")).alias("_share"))
    return written(each.where("_share > 1").select("_hash", F.ceil("_share").cast("long").alias("_salts")), "hot-keys")


def _set_columns(df: DataFrame, upd: DataFrame, on: Column, cols: list[str], only_empty: bool, salt: int = 1,
                 keys: tuple[list[str], list[str]] | None = None) -> DataFrame:
    """Left join ``df`` with ``upd`` (already one row per key) and set ``cols``.

    With ``salt > 1`` hot keys (:func:`hot_keys`; ``keys`` names the key columns of both
    sides) are spread over up to ``salt`` tasks: their rows get a salt from a hash of
    their own columns (deterministic, so a retried task sends rows to the same
    place), and only their answers are repeated, once per salt.  All other rows
    and answers take part once.  Without it AQE's skew-join split does
    that at run time when enabled.
    """
    base_cols = list(df.columns)
    if salt > 1:
        hot = F.broadcast(hot_keys(df, keys[0], salt))  # fewer than ``salt`` rows
        salts = F.coalesce(F.col("_salts"), F.lit(1).cast("long"))
        own = F.pmod(F.xxhash64(*[F.col(c) for c in base_cols]), salts)
        df = df.withColumn("_hash", F.xxhash64(*keys[0])).join(hot, "_hash", "left").withColumn("_salt", own).drop("_hash", "_salts")
        upd = upd.withColumn("_hash", F.xxhash64(*keys[1])).join(hot, "_hash", "left")
        upd = upd.withColumn("_usalt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("_hash", "_salts")
    joined = df.join(upd, on & (df["_salt"] == upd["_usalt"]) if salt > 1 else on, "left")
    out = []
    for c in base_cols:
        if c in cols:
            new = upd[f"_u_{c}"]
            if only_empty:
                out.append(F.when(df[c].isNull() & upd["_u_hit"], new).otherwise(df[c]).alias(c))
            else:
                out.append(F.when(upd["_u_hit"], new).otherwise(df[c]).alias(c))
        else:
            out.append(df[c])
    for c in cols:
        if c not in base_cols:
            out.append(upd[f"_u_{c}"].alias(c))
    return joined.select(*out)


def _one_per_key(updates: DataFrame, keys: list[str], cols: list[str], order_col: str | None) -> DataFrame:
    payload = F.struct(*[F.col(c).alias(f"_u_{c}") for c in cols])
    if order_col:
        agg = F.max_by(payload, F.struct(F.col(order_col), payload))
    else:
        agg = F.max(payload)
    reduced = updates.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(agg.alias("_p"))
    return reduced.select(*[f"_k_{k}" for k in keys], *[F.col(f"_p._u_{c}").alias(f"_u_{c}") for c in cols], F.lit(True).alias("_u_hit"))


def update_by_url(df: DataFrame, updates: DataFrame, cols: list[str], key: str = "url", order_col: str | None = None,
                  only_empty: bool = False, salt: int = 1) -> DataFrame:
    """Set ``cols`` on every row whose URL has an update; unmatched rows unchanged.

    Several rows with the same URL are all updated.  Several updates for one
    URL: the one with the largest ``order_col`` wins (else the largest value).
    ``salt`` spreads a hot URL over that many tasks (see ``_set_columns``).
    """
    _require(df, key)
    _require(updates, key, *cols)
    upd = _one_per_key(updates, [key], cols, order_col)
    return _set_columns(df, upd, F.col(key) == F.col(f"_k_{key}"), cols, only_empty, salt, ([key], [f"_k_{key}"]))


def update_by_domain(
    df: DataFrame,
    updates: DataFrame,
    cols: list[str],
    suffixes: SuffixTable | DataFrame | None = None,
    domain_only: bool = True,
    col: str = "url",
    key: str = "domain",
    only_empty: bool = False,
    salt: int = 1,
) -> DataFrame:
    """Like J1, matched on the URL's host (``domain_only=False``) or its
    registered domain without scheme (P2); ``salt`` as in J1."""
    _require(df, col)
    _require(updates, key, *cols)
    if domain_only:
        if suffixes is None:
            raise ValueError("registered-domain matching needs a suffix table")
        keyed = registered_domain(df, suffixes, col, "_dkey", domain_only=True, scheme=False)
    else:
        keyed = df.withColumn("_dkey", U.url_host(col))
    upd = _one_per_key(updates, [key], cols, None)
    out = _set_columns(keyed, upd, F.col("_dkey") == F.col(f"_k_{key}"), cols, only_empty, salt, (["_dkey"], [f"_k_{key}"]))
    return out.drop("_dkey")


def update_by_pair(df: DataFrame, updates: DataFrame, cols: list[str], keys: tuple[str, str] = ("url", "backlink_for"),
                   only_empty: bool = False, salt: int = 1) -> DataFrame:
    """Like J1, matched on (url, backlink_for); ``salt`` as in J1."""
    _require(df, *keys)
    _require(updates, *keys, *cols)
    upd = _one_per_key(updates, list(keys), cols, None)
    cond = (F.col(keys[0]) == F.col(f"_k_{keys[0]}")) & (F.col(keys[1]) == F.col(f"_k_{keys[1]}"))
    return _set_columns(df, upd, cond, cols, only_empty, salt, (list(keys), [f"_k_{k}" for k in keys]))


def enrich_status(urls: DataFrame, fetch_log: DataFrame, col: str = "url", status_col: str = "http_status", salt: int = 1) -> DataFrame:
    """HTTP status of each pending row (empty status, absolute URL) from the
    latest fetch of its URL; ``salt`` as in J1."""
    _require(urls, col, status_col)
    latest = latest_fetch(fetch_log, ["http_status"])  # already one row per URL
    upd = latest.select(F.col("url").alias(f"_k_{col}"), F.col("http_status").alias(f"_u_{status_col}"), F.lit(True).alias("_u_hit"))
    pend = urls.withColumn("_abs", U.is_absolute(col))
    cond = (F.col(col) == F.col(f"_k_{col}")) & F.col("_abs")
    return _set_columns(pend, upd, cond, [status_col], only_empty=True, salt=salt, keys=([col], [f"_k_{col}"])).drop("_abs")


def resolve_redirect_once(urls: DataFrame, fetch_log: DataFrame, col: str = "url", status_col: str = "http_status") -> DataFrame:
    """One redirect hop for the F15 rows (300 < status < 400, absolute URL).

    The URL's latest fetch is looked up: a 3xx answer with a location moves
    the row to that location (resolved against the URL) with the status of
    the location's latest fetch (NULL if never fetched); any other answer
    keeps the URL and takes the answer's status.  Rows whose URL was never
    fetched, and all non-candidates, are unchanged.
    """
    _require(urls, col, status_col)
    latest = latest_fetch(fetch_log, ["http_status", "location"])
    return _hop(urls, latest, col, status_col)


def _hop(urls: DataFrame, latest: DataFrame, col: str, status_col: str) -> DataFrame:
    s = F.col(status_col)
    cand = (s > 300) & (s < 400) & U.is_absolute(col)
    a = latest.select(F.col("url").alias("_a_url"), F.col("http_status").alias("_a_status"), F.col("location").alias("_a_loc"))
    b = latest.select(F.col("url").alias("_b_url"), F.col("http_status").alias("_b_status"))
    x = urls.withColumn("_cand", F.coalesce(cand, F.lit(False)))
    x = x.join(a, x["_cand"] & (x[col] == a["_a_url"]), "left")
    moves = F.col("_a_status").between(300, 399) & F.col("_a_loc").isNotNull() & (F.col("_a_loc") != "")
    x = x.withColumn("_next", F.when(F.col("_a_url").isNotNull() & moves, U.resolve_url(F.col(col), F.col("_a_loc"))))
    x = x.join(b, x["_next"] == b["_b_url"], "left")
    new_url = F.when(F.col("_next").isNotNull(), F.col("_next")).otherwise(F.col(col))
    new_status = (
        F.when(F.col("_next").isNotNull(), F.col("_b_status"))
        .when(F.col("_a_url").isNotNull(), F.col("_a_status"))
        .otherwise(s)
    )
    dtype = urls.schema[status_col].dataType
    return x.select(
        *[new_url.alias(c) if c == col else new_status.cast(dtype).alias(c) if c == status_col else F.col(c) for c in urls.columns]
    )


def enrich_ip(urls: DataFrame, dns: DataFrame, col: str = "url", out: str = "ip", salt: int = 1) -> DataFrame:
    """First address (smallest ``ord``) of the URL's host, else ``Unknow``.

    Only absolute URLs with an empty ``ip`` are filled; ``salt`` as in J1.
    """
    _require(urls, col)
    _require(dns, "host", "ip", "ord")
    first = dns.groupBy(F.lower("host").alias("_k_host")).agg(F.min_by("ip", "ord").alias(f"_u_{out}")).withColumn("_u_hit", F.lit(True))
    base = urls if out in urls.columns else urls.withColumn(out, F.lit(None).cast("string"))
    keyed = base.withColumn("_h0", F.when(U.is_absolute(col), U.url_host(col)))
    filled = _set_columns(keyed, first, F.col("_h0") == F.col("_k_host"), [out], only_empty=True, salt=salt, keys=(["_h0"], ["_k_host"]))
    value = F.when(F.col(out).isNull() & F.col("_h0").isNotNull(), F.lit(UNKNOWN_IP)).otherwise(F.col(out))
    return filled.withColumn(out, value).drop("_h0")


def enrich_availability(
    urls: DataFrame,
    avail: DataFrame,
    tld_support: DataFrame,
    api: str,
    suffixes: SuffixTable | DataFrame,
    col: str = "url",
    out: str = "domain_available",
) -> DataFrame:
    """Domain availability per URL.

    Distinct registered domains (no scheme) are checked: a domain whose public
    suffix the API does not support gets ``tld not supported by API``; the
    others take the API answer ``value`` for the domain (NULL when there is
    none yet).  The per-domain answer is joined back by domain (J2).
    """
    _require(urls, col)
    _require(avail, "domain", "value")
    st = suffixes if isinstance(suffixes, SuffixTable) else SuffixTable.of(suffixes)
    keyed = registered_domain(urls, st, col, "_dom", domain_only=True, scheme=False)
    domains = keyed.where(F.col("_dom") != "").select("_dom").distinct()
    domains = with_public_suffix(domains, st, F.col("_dom"), "_tld")
    supported = tld_support.where(F.col("api") == api).select(F.lower("tld").alias("_stld")).distinct()
    domains = domains.join(supported, domains["_tld"] == supported["_stld"], "left")
    answers = avail.groupBy(F.lower("domain").alias("_adom")).agg(F.max("value").alias("_aval"))
    domains = domains.join(answers, domains["_dom"] == answers["_adom"], "left")
    verdict = F.when((F.col("_tld") == "") | F.col("_stld").isNull(), F.lit(TLD_NOT_SUPPORTED)).otherwise(F.col("_aval"))
    per_domain = domains.select(F.col("_dom").alias("_k_domain"), verdict.alias(f"_u_{out}"), F.lit(True).alias("_u_hit"))
    # join back on the key already computed for every row (no second suffix lookup)
    if out not in keyed.columns:
        keyed = keyed.withColumn(out, F.lit(None).cast("string"))
    joined = _set_columns(keyed, per_domain, keyed["_dom"] == per_domain["_k_domain"], [out], only_empty=True)
    return joined.drop("_dom")


def enrich_backlinks(
    urls: DataFrame,
    metrics: DataFrame,
    cols: list[str],
    level: int = 0,
    suffixes: SuffixTable | DataFrame | None = None,
    col: str = "url",
    key: str = "target",
    salt: int = 1,
) -> DataFrame:
    """Provider metrics joined by URL (level 0), host (1) or registered domain (2)."""
    _require(metrics, key, *cols)
    if level == 0:
        m = metrics.withColumnRenamed(key, col)
        return update_by_url(urls, m, cols, col, only_empty=True, salt=salt)
    if level in (1, 2):
        m = metrics.withColumnRenamed(key, "domain")
        return update_by_domain(urls, m, cols, suffixes, level == 2, col, "domain", only_empty=True, salt=salt)
    raise ValueError("level must be 0 (URL), 1 (host) or 2 (registered domain)")


# --- statistics --------------------------------------------------------------

def count_filled(df: DataFrame, col: str) -> DataFrame:
    """A4: number of non-empty cells of a column (one row)."""
    _require(df, col)
    return df.agg(_filled(col).alias("filled"))


def _filled(col: str) -> Column:
    c = F.col(col)
    return F.count_if(c.isNotNull() & (c.cast("string") != "")).cast("long")


def count_redirects(df: DataFrame, status_col: str = "http_status") -> DataFrame:
    """A5: rows with 300 < status < 400 (one row)."""
    _require(df, status_col)
    return df.agg(_redirects(status_col).alias("redirects"))


def _redirects(status_col: str) -> Column:
    s = F.col(status_col)
    return F.count_if((s > 300) & (s < 400)).cast("long")


def observe_statistics(df: DataFrame, filled: list[str] = (), status_col: str | None = None, metrics: list[str] = ()) -> tuple[DataFrame, Observation]:
    """A4, A5 and A12 of a table, taken while it is written instead of by a pass of their own.

    Returns the table and an observation; after the first action on the table, ``observation.get``
    holds ``total``, ``filled_<col>`` (A4), ``redirects`` (A5) and ``done_<metric>`` (A12).
    """
    _require(df, *filled, *metrics, *([status_col] if status_col else []))
    counts = [F.count(F.lit(1)).alias("total"), *[_filled(c).alias(f"filled_{c}") for c in filled], *[F.count(m).alias(f"done_{m}") for m in metrics]]
    if status_col:
        counts.append(_redirects(status_col).alias("redirects"))
    seen = Observation()
    return df.observe(seen, *counts), seen


def domain_histogram(df: DataFrame, suffixes: SuffixTable | DataFrame, col: str = "url") -> DataFrame:
    """URLs per registered domain (with scheme, as P2)."""
    _require(df, col)
    keyed = registered_domain(df.select(col), suffixes, col, "domain")
    return keyed.groupBy("domain").agg(F.count("*").alias("urls"))


def crawl_concurrency(histogram: DataFrame) -> DataFrame:
    """From A6: a domain over 30 URLs or a single domain → 1; else one over 10 → 2; else 5."""
    _require(histogram, "domain", "urls")
    s = histogram.agg(F.count("*").alias("domains"), F.max("urls").alias("max_urls"))
    level = (
        F.when((F.col("max_urls") > 30) | (F.col("domains") == 1), F.lit(1))
        .when(F.col("max_urls") > 10, F.lit(2))
        .otherwise(F.lit(5))
    )
    return s.select(F.col("domains").cast("long"), F.col("max_urls").cast("long"), level.alias("concurrency"))


def with_global_position(df: DataFrame, order_col: str = "row_id", out: str = "position") -> DataFrame:
    """0-based position of each row in ``order_col`` order, without a global window.

    The frame is range-partitioned and sorted by ``order_col`` and
    checkpointed (so both passes see the same partitions).  The position is
    the partition's offset (a running sum over one count per partition, a
    table with as many rows as partitions) plus the row's index inside its
    partition, which ``monotonically_increasing_id`` carries in its low 33
    bits.
    """
    _require(df, order_col)
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, order_col).sortWithinPartitions(order_col)
    ensure_checkpoint_dir(spark)
    ranged = ranged.withColumn("_mid", F.monotonically_increasing_id()).checkpoint(eager=True)
    part = F.shiftright(F.col("_mid"), 33)
    local = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    counts = ranged.groupBy(part.alias("_pid")).agg(F.count("*").alias("_n"))
    offsets = counts.select(
        "_pid",
        (F.sum("_n").over(_w_running()) - F.col("_n")).alias("_off"),
    )
    # one row per partition: bounded by the partition count, not by the data
    x = ranged.join(F.broadcast(offsets), part == offsets["_pid"], "left")
    return x.select(*df.columns, (F.col("_off") + local).alias(out))


def _w_running():
    from pyspark.sql import Window

    # one row per partition: a single-partition window over a tiny table
    return Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def bulk_batches(urls: DataFrame, n: int, col: str = "url", order_col: str = "row_id") -> DataFrame:
    """A10: consecutive URLs (row order) in groups of ``n`` per request.

    50 for bulk backlink metrics, 10 for availability.  Each batch is at most
    ``n`` items, collected in order (struct sort, not ``collect_list`` order).
    """
    if n <= 0:
        raise ValueError("batch size must be positive")
    pos = with_global_position(urls.select(order_col, col), order_col, "_pos")
    batches = pos.groupBy(F.floor(F.col("_pos") / n).cast("long").alias("batch")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("_pos"), F.col(col)))).alias("_items")
    )
    return batches.select("batch", F.transform("_items", lambda x: x[col]).alias("urls"), F.size("_items").alias("size"))


def items_per_page(df: DataFrame, items_col: str = "items", key: str = "page_id") -> DataFrame:
    """Items extracted per page (use :func:`items_total` for the sum)."""
    _require(df, items_col, key)
    return df.groupBy(key).agg(F.sum(F.coalesce(F.size(items_col), F.lit(0))).cast("long").alias("items"))


def items_total(df: DataFrame, items_col: str = "items") -> DataFrame:
    """A11 total over all pages (one row)."""
    return df.agg(F.sum(F.coalesce(F.size(items_col), F.lit(0))).cast("long").alias("items"))


def enrichment_progress(df: DataFrame, metric: str) -> DataFrame:
    """(done, total) for an enrichment column (one row)."""
    _require(df, metric)
    return df.agg(F.count(metric).cast("long").alias("done"), F.count("*").cast("long").alias("total"))


def frontier_remaining(frontier: DataFrame, done: DataFrame, key: str = "url") -> DataFrame:
    """(remaining, total) frontier items; done items removed by a left-anti join.

    Only items that a Bloom filter of the done list may hold are shuffled for it.
    """
    _require(frontier, key)
    left = anti_join(frontier.select(key), done.select(key).distinct(), key)
    remaining = left.select(F.count("*").cast("long")).scalar()
    total = frontier.select(F.count("*").cast("long")).scalar()
    return frontier.sparkSession.range(1).select(remaining.alias("remaining"), total.alias("total"))
