"""Schema registry.

Logical column names, their Spark types, the display headers used in files,
and the column order of each result schema.  A schema is a subset of these
columns in a fixed order.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Display header ↔ logical name, in the reference's column order (fixed values).
HEADERS = [
    ("URL", "url"),
    ("HTTP Status", "http_status"),
    ("Dofollow (%)", "dofollow_pct"),
    ("Backlinks", "backlinks"),
    ("RD", "ref_domains"),
    ("CF", "citation_flow"),
    ("TF", "trust_flow"),
    ("TTFT", "ttf_topic"),
    ("TTFV", "ttf_value"),
    ("Status", "index_status"),
    ("LCD", "last_crawl"),
    ("MozRank", "moz_rank"),
    ("PA", "page_authority"),
    ("DA", "domain_authority"),
    ("URL Rank", "url_rank"),
    ("Domain Rank", "domain_rank"),
    ("OBL", "obl"),
    ("Platform Category", "platform_category"),
    ("Platform", "platform"),
    ("IP Address", "ip"),
    ("Link Alive", "link_alive"),
    ("Domain Available", "domain_available"),
    ("Backlinks for", "backlink_for"),
    ("Anchor", "anchor"),
    ("Target URL", "target_url"),
    ("Link type", "link_type"),
    ("Nofollow", "nofollow"),
    ("Deleted", "deleted"),
    ("FID", "first_indexed"),
    ("LSD", "last_seen"),
]
DISPLAY_TO_NAME = {d: n for d, n in HEADERS}
NAME_TO_DISPLAY = {n: d for d, n in HEADERS}

TYPES: dict[str, T.DataType] = {
    "row_id": T.LongType(),
    "url": T.StringType(),
    "http_status": T.IntegerType(),
    "dofollow_pct": T.DoubleType(),
    "backlinks": T.LongType(),
    "ref_domains": T.LongType(),
    "citation_flow": T.IntegerType(),
    "trust_flow": T.IntegerType(),
    "ttf_topic": T.StringType(),
    "ttf_value": T.IntegerType(),
    "index_status": T.StringType(),
    "last_crawl": T.StringType(),
    "moz_rank": T.DoubleType(),
    "page_authority": T.IntegerType(),
    "domain_authority": T.IntegerType(),
    "url_rank": T.IntegerType(),
    "domain_rank": T.IntegerType(),
    "obl": T.IntegerType(),
    "platform_category": T.StringType(),
    "platform": T.StringType(),
    "ip": T.StringType(),
    "link_alive": T.StringType(),
    "domain_available": T.StringType(),
    "backlink_for": T.StringType(),
    "anchor": T.StringType(),
    "target_url": T.StringType(),
    "link_type": T.StringType(),
    "nofollow": T.BooleanType(),
    "deleted": T.BooleanType(),
    "first_indexed": T.StringType(),
    "last_seen": T.StringType(),
}

STD_TAIL = ["obl", "platform_category", "platform", "ip", "link_alive", "domain_available"]
PROVIDER_BLOCK = {
    "ahrefs": ["backlinks", "url_rank", "domain_rank"],
    "majestic": ["backlinks", "ref_domains", "citation_flow", "trust_flow", "ttf_topic", "ttf_value", "index_status", "last_crawl"],
    "moz": ["backlinks", "moz_rank", "page_authority", "domain_authority"],
}

SCHEMAS: dict[str, list[str]] = {
    "scrap/ahrefs": ["url", "http_status", "dofollow_pct", *PROVIDER_BLOCK["ahrefs"], *STD_TAIL],
    "scrap/majestic": ["url", "http_status", "dofollow_pct", *PROVIDER_BLOCK["majestic"], *STD_TAIL],
    "scrap/moz": ["url", "http_status", "dofollow_pct", *PROVIDER_BLOCK["moz"], *STD_TAIL],
    "backlinks/moz": ["backlink_for", "url", "anchor", "http_status", "dofollow_pct", "backlinks", "moz_rank",
                      "page_authority", "domain_authority", *STD_TAIL],
    "backlinks/ahrefs": ["backlink_for", "url", "anchor", "target_url", "link_type", "http_status", "dofollow_pct",
                         "nofollow", "url_rank", "domain_rank", *STD_TAIL],
    "backlinks/majestic": ["backlink_for", "url", "anchor", "link_type", "target_url", "deleted", "http_status",
                           "dofollow_pct", "nofollow", "citation_flow", "trust_flow", "ttf_topic", "ttf_value",
                           "first_indexed", "last_seen", *STD_TAIL],
}


STD_BLOCK = ["http_status", "dofollow_pct", *STD_TAIL]


def custom_scrap_columns(headers: list[str]) -> list[str]:
    """§1.3 ``customScrap``: the user headers (as logical names, however many),
    then the standard enrichment columns only when one header is ``url``
    (case-insensitive)."""
    names = [logical_name(h) for h in headers]
    if any(h.strip().lower() == "url" for h in headers):
        names += [c for c in STD_BLOCK if c not in names]
    return names


def logical_name(header: str) -> str:
    """Logical name of a display header; unknown headers are lower-cased with
    non-alphanumerics turned into ``_``."""
    h = header.strip().lstrip("#").strip()
    if h in DISPLAY_TO_NAME:
        return DISPLAY_TO_NAME[h]
    out = "".join(ch.lower() if ch.isalnum() else "_" for ch in h).strip("_")
    return out or "col"


def display_name(name: str) -> str:
    return NAME_TO_DISPLAY.get(name, name)


def struct_for(schema: str, with_row_id: bool = True) -> T.StructType:
    cols = (["row_id"] if with_row_id else []) + SCHEMAS[schema]
    return T.StructType([T.StructField(c, TYPES.get(c, T.StringType())) for c in cols])
