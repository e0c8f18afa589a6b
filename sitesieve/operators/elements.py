"""HTML elements and rule-based extraction.

C2 needs Python on the rows: the standard-library ``html.parser`` runs
inside ``mapInPandas`` (Arrow batches, one parser per page), because
Spark's ``xpath`` rejects real-world HTML.  Rules that only read attributes
or count elements avoid it altogether (the regex engine of C3).  Everything after
it is Spark columns: rules compile to filters over the element rows, and all
rules of a query are answered by *one* aggregation (conditional
``collect_list``), so the Python stage runs once per plan and only matched
values are shuffled.

Rules are data, not expression strings: a :class:`Rule` names the element,
attribute tests (``=``, ``contains``, ``starts-with``, ``exists``, each
possibly negated) and the output (text, an attribute, or a count).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import url as U
from .content import attr_value, html_to_text, start_tags
from .urls import _require

ELEMENT_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("pos", T.IntegerType()),
    T.StructField("tag", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("text", T.StringType()),
    T.StructField("depth", T.IntegerType()),
])

# Elements that never have content (fixed values, HTML void elements).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

# A batch of element rows leaves Python when it has this many rows, or characters of text and attributes.
CHUNK_ROWS = 10_000
CHUNK_CHARS = 4_000_000


class _Collector(HTMLParser):
    """Element rows of one page: start order, tag, attributes, string value, depth."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.stack: list[tuple[str, int, int]] = []  # tag, row index, text start
        self.text: list[str] = []

    def _open(self, tag, attrs, void):
        amap = {}
        for k, v in attrs:
            if k not in amap:
                amap[k] = "" if v is None else v
        idx = len(self.rows)
        self.rows.append([idx, tag, amap, "", len(self.stack)])
        if not void:
            self.stack.append((tag, idx, len(self.text)))

    def handle_starttag(self, tag, attrs):
        self._open(tag, attrs, tag in VOID)

    def handle_startendtag(self, tag, attrs):
        self._open(tag, attrs, True)

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                while len(self.stack) > i:
                    self._close(self.stack.pop())
                return

    def _close(self, entry):
        _, idx, start = entry
        self.rows[idx][3] = "".join(self.text[start:])

    def handle_data(self, data):
        self.text.append(data)

    def finish(self):
        while self.stack:
            self._close(self.stack.pop())
        return self.rows


def _parse(html: str | None) -> list[list]:
    if not html:
        return []
    c = _Collector()
    try:
        c.feed(html)
        c.close()
    except Exception:  # malformed beyond repair: keep what was read
        pass
    return c.finish()


def _elements_fn(tags: frozenset | None, carry: list[str]):
    cols = ["page_id", "pos", "tag", "attrs", "text", "depth"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, chars = {c: [] for c in cols + carry}, 0
            extra = [pdf[c].tolist() for c in carry]
            for i, (pid, html) in enumerate(zip(pdf["page_id"].tolist(), pdf["html"].tolist())):
                for pos, tag, attrs, text, depth in _parse(html):
                    if tags is not None and tag not in tags:
                        continue
                    out["page_id"].append(pid)
                    out["pos"].append(pos)
                    out["tag"].append(tag)
                    out["attrs"].append(attrs)
                    out["text"].append(text)
                    out["depth"].append(depth)
                    for c, vals in zip(carry, extra):
                        out[c].append(vals[i])
                    chars += len(text) + sum(len(k) + len(v) for k, v in attrs.items())
                    if len(out["pos"]) >= CHUNK_ROWS or chars >= CHUNK_CHARS:
                        yield pd.DataFrame(out, columns=cols + carry)
                        out, chars = {c: [] for c in cols + carry}, 0
            if out["pos"]:
                yield pd.DataFrame(out, columns=cols + carry)

    return run


def extract_elements(pages: DataFrame, id_col: str = "page_id", html_col: str = "html",
                     tags: list[str] | None = None, carry: list[str] | None = None) -> DataFrame:
    """One row per element: page_id, pos (start order), tag (lower case),
    attrs MAP, text (string value: all descendant text, entities decoded),
    depth.  Unclosed elements end where an ancestor ends or at the end of
    the page; void elements have no content.

    ``tags`` keeps only those elements (the whole page is still parsed, so
    positions and texts are the same); it is how C3 avoids sending every
    element of every page through Arrow.  ``carry`` names page columns
    (strings) copied onto each element row.
    """
    _require(pages, id_col, html_col)
    carry = list(carry or [])
    src = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"),
                       *[F.col(c).cast("string").alias(c) for c in carry])
    # the page key keeps its own type (a number, or e.g. the URL itself)
    fields = [T.StructField("page_id", pages.schema[id_col].dataType)] + ELEMENT_SCHEMA.fields[1:]
    schema = T.StructType(fields + [T.StructField(c, T.StringType()) for c in carry])
    wanted = frozenset(t.lower() for t in tags) if tags is not None else None
    return src.mapInPandas(_elements_fn(wanted, carry), schema)


# --- rules --------------------------------------------------------------------

@dataclass(frozen=True)
class Test:
    attr: str
    op: str = "="          # '=', 'contains', 'starts-with', 'exists'
    value: str = ""
    negate: bool = False


@dataclass(frozen=True)
class Rule:
    """Element rule: ``tag`` ('*' any) + attribute tests → output.

    ``output`` is ``text``, ``@name`` (an attribute) or ``count``.  ``prefix``
    and ``suffix`` decorate non-empty items (P11); ``keep_html`` skips P21.
    """

    name: str
    tag: str
    tests: tuple[Test, ...] = field(default_factory=tuple)
    output: str = "text"
    prefix: str = ""
    suffix: str = ""
    keep_html: bool = True

    def condition(self, placeholders: dict[str, Column] | None = None) -> Column:
        cond = F.lit(True) if self.tag == "*" else (F.col("tag") == self.tag.lower())
        for t in self.tests:
            v = F.col("attrs")[t.attr]
            value = substitute(F.lit(t.value), placeholders) if placeholders else F.lit(t.value)
            if t.op == "exists":
                c = v.isNotNull()
            elif t.op == "=":
                c = v == value
            elif t.op == "contains":
                c = v.contains(value)
            elif t.op == "starts-with":
                c = v.startswith(value)
            else:
                raise ValueError(f"unsupported test {t.op!r}")
            c = F.coalesce(c, F.lit(False))
            cond = cond & (~c if t.negate else c)
        if self.output.startswith("@"):
            cond = cond & F.col("attrs")[self.output[1:]].isNotNull()
        return cond

    def value(self) -> Column:
        if self.output == "text":
            return F.col("text")
        if self.output.startswith("@"):
            return F.col("attrs")[self.output[1:]]
        if self.output == "count":
            return F.lit(1)
        raise ValueError(f"unsupported output {self.output!r}")


# Placeholder names (fixed values).
PLACEHOLDERS = ("{%scrapurl::encoded%}", "{%scrapurl%}", "{%custom1::encoded%}", "{%custom1%}",
                "{%custom2::encoded%}", "{%custom2%}", "{%footprint%}")


def substitute(c: Column, values: dict[str, Column] | None, encoded: bool = True) -> Column:
    """Replace placeholders in ``c`` with per-row columns (``scrapurl``, ``custom1``,
    ``custom2``, ``footprint``); with ``encoded`` also the ``::encoded`` forms."""
    if not values:
        return c
    out = c
    for key, col in values.items():
        raw = F.coalesce(col.cast("string"), F.lit(""))
        if encoded:
            # the page's URL is written as in markup, the parameters percent-encoded
            form = F.regexp_replace(raw, "&(?!amp;)", "&amp;") if key == "scrapurl" else U.percent_encode(raw)
            out = F.replace(out, F.lit("{%" + key + "::encoded%}"), form)
        # the footprint is kept percent-encoded everywhere it is used (G1)
        out = F.replace(out, F.lit("{%" + key + "%}"), U.percent_encode(raw) if key == "footprint" else raw)
    return out


def _regex_ok(rules: list[Rule]) -> bool:
    return all((r.output == "count" or r.output.startswith("@")) and r.tag != "*" and re.fullmatch(r"[A-Za-z][A-Za-z0-9]*", r.tag)
               for r in rules)


def _tag_test(r: Rule, ph: dict[str, Column]):
    """One-argument predicate over a start-tag string (for ``filter``)."""

    def cond(t: Column) -> Column:
        c = F.lit(True)
        for test in r.tests:
            v = attr_value(t, test.attr)
            value = substitute(F.lit(test.value), ph) if ph else F.lit(test.value)
            if test.op == "exists":
                x = v.isNotNull()
            elif test.op == "=":
                x = v == value
            elif test.op == "contains":
                x = v.contains(value)
            elif test.op == "starts-with":
                x = v.startswith(value)
            else:
                raise ValueError(f"unsupported test {test.op!r}")
            x = F.coalesce(x, F.lit(False))
            c = c & (~x if test.negate else x)
        if r.output.startswith("@"):
            c = c & attr_value(t, r.output[1:]).isNotNull()
        return c

    return cond


def _tag_value(name: str):
    def value(t: Column) -> Column:
        return attr_value(t, name)

    return value


def _regex_items(pages: DataFrame, rules: list[Rule], id_col: str, html_col: str, values: dict[str, str]) -> DataFrame:
    """C3 without Python: start tags found by a regex, attribute tests and
    outputs read from the tag text (JVM expressions, no shuffle)."""
    ph = {k: F.col(c) for k, c in values.items()}
    html = F.coalesce(F.col(html_col), F.lit(""))
    cols = []
    for r in rules:
        tags = start_tags(html, r.tag)
        kept = F.filter(tags, _tag_test(r, ph))
        if r.output == "count":
            items = F.array(F.size(kept).cast("string"))
        else:
            items = F.transform(kept, _tag_value(r.output[1:]))
        if not r.keep_html:
            items = F.transform(items, lambda x: U.decode_if_absolute(html_to_text(x)))
        cols.append(items.alias(r.name))
    keep = [c for c in pages.columns if c not in (id_col, html_col)]
    return pages.select(F.col(id_col).alias("page_id"), *keep, *cols)


def extract_items(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", html_col: str = "html",
                  elements: DataFrame | None = None, placeholders: dict[str, str] | None = None,
                  engine: str = "auto") -> DataFrame:
    """Evaluate rules per page → one ``ARRAY<STRING>`` column per rule
    (named after the rule; ``count`` rules give a one-item array).

    ``placeholders`` maps a placeholder name (``scrapurl``, ``custom1``,
    ``custom2``, ``footprint``) to a column of ``pages``; rule test values
    have those placeholders filled per page row (plain and ``::encoded``).

    ``engine``: ``parser`` evaluates rules over C2 elements (Python parser,
    one aggregation); ``regex`` reads start tags with JVM regular
    expressions (no Python, no shuffle) and serves rules whose output is an
    attribute or a count; ``auto`` picks ``regex`` when every rule allows it.
    Both skip comments and script text and read attributes alike, so the
    answer does not depend on the engine.  ``id_col`` may be of any type (a page number, or the URL);
    it is returned as ``page_id``.

    One aggregation answers all rules; items keep document order (sorted
    ``(pos, value)`` structs, not ``collect_list`` order).  Pages without a
    match get an empty array.
    """
    _require(pages, id_col, html_col)
    values = dict(placeholders or {})
    if engine not in ("auto", "regex", "parser"):
        raise ValueError(f"unknown engine {engine!r}")
    if elements is None and (engine == "regex" or (engine == "auto" and _regex_ok(rules))):
        if not _regex_ok(rules):
            raise ValueError("the regex engine serves attribute and count rules on a named tag only")
        return _regex_items(pages, rules, id_col, html_col, values)
    if elements is not None:
        el = elements
    else:
        tags = None if any(r.tag == "*" for r in rules) else sorted({r.tag.lower() for r in rules})
        el = extract_elements(pages, id_col, html_col, tags=tags, carry=sorted(set(values.values())))
    ph = {k: F.col(c) for k, c in values.items()}
    aggs = []
    for r in rules:
        cond = r.condition(ph)
        if r.output == "count":
            aggs.append(F.count_if(cond).alias(r.name))
        else:
            aggs.append(F.array_sort(F.collect_list(F.when(cond, F.struct(F.col("pos"), r.value().alias("v"))))).alias(r.name))
    per_page = el.groupBy("page_id").agg(*aggs)
    base = pages.select(F.col(id_col).alias("page_id"), *[c for c in pages.columns if c not in (id_col, html_col)])
    out = base.join(per_page, "page_id", "left")
    cols = []
    for r in rules:
        if r.output == "count":
            items = F.array(F.coalesce(F.col(r.name), F.lit(0)).cast("string"))
        else:
            items = F.coalesce(F.transform(F.col(r.name), lambda x: x["v"]), F.array().cast("array<string>"))
        if not r.keep_html:
            items = F.transform(items, lambda x: U.decode_if_absolute(html_to_text(x)))
        cols.append(items.alias(r.name))
    return out.select("page_id", *[c for c in base.columns if c != "page_id"], *cols)


def next_page(pages: DataFrame, rule: Rule, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
              elements: DataFrame | None = None, out: str = "next_url") -> DataFrame:
    """C4: first item of the pagination rule, ``&amp;`` → ``&``, resolved against the page URL."""
    _require(pages, id_col, url_col, html_col)
    named = Rule(out, rule.tag, rule.tests, rule.output)
    items = extract_items(pages.select(id_col, url_col, html_col), [named], id_col, html_col, elements)
    first = F.element_at(F.col(out), 1)
    first = F.when(F.size(F.col(out)) > 0, first)
    return items.select("page_id", F.col(url_col), U.resolve_url(F.col(url_col), first).alias(out))


def decorate_items(df: DataFrame, items_col: str, prefix: str = "", suffix: str = "",
                   placeholders: dict[str, str] | None = None) -> DataFrame:
    """Non-empty item → prefix + item + suffix, then the plain placeholders
    replaced from the row's columns (``{%custom1%}`` ← column ``custom1`` …).
    ``::encoded`` forms are left as written, as in the reference."""
    _require(df, items_col)
    values = {k: F.col(c) for k, c in (placeholders or {}).items()}

    def deco(x: Column) -> Column:
        v = substitute(F.concat(F.lit(prefix), x, F.lit(suffix)), values, encoded=False)
        return F.when(x.isNull() | (x == ""), x).otherwise(v)

    if df.schema[items_col].dataType.simpleString().startswith("array"):
        return df.withColumn(items_col, F.transform(items_col, deco))
    return df.withColumn(items_col, deco(F.col(items_col)))


def split_custom_columns(df: DataFrame, col: str, headers: list[str], sep: str = ",", quote: str = '"') -> DataFrame:
    """Split an item by quote+sep+quote into the header columns; short
    rows are padded with NULL, extra parts dropped; outer quotes removed."""
    _require(df, col)
    pattern = "".join("\\" + ch if not ch.isalnum() else ch for ch in quote + sep + quote)
    stripped = F.regexp_replace(F.col(col), "^" + ("\\" + quote if quote else "") + "|" + ("\\" + quote if quote else "") + "$", "")
    parts = F.split(stripped, pattern)
    out = df
    for i, h in enumerate(headers):
        out = out.withColumn(h, F.try_element_at(parts, F.lit(i + 1)))
    return out
