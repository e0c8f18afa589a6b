"""Platform detection (C6) and rule hits.

The rule file (our own, in the shape of a common open platform-fingerprint format:
``apps`` → ``cats``, ``headers``, ``meta``, ``script``, ``html``; and
``categories`` → ``name``) is a configuration input.  It is flattened into a
``platform_rules`` table with one row per pattern.

Detection is a projection over the pages: the rule table, a configuration
file, becomes one array literal of the plan, and the page body is scanned in place:
no join, no shuffle, and the same code however many rules there are.  A body is
cut into its distinct words once; a pattern runs only if they hold the literal
that its every match holds, so most patterns never run.  Apps are tried in the
reference's priority (category order 1, 2, 6, 7, 8, 11, 18; then app name;
then headers → meta → script → html) and the first hit wins.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .urls import _require

# Category order tried by the detector (fixed values).
CATEGORY_ORDER = [1, 2, 6, 7, 8, 11, 18]
KIND_ORDER = ["headers", "meta", "script", "html"]
NOT_FOUND = "Not Found"
# Other letters that equal an ASCII letter regardless of case (fixed values).
FOLDED = {"\u017f": "s", "\u212a": "k", "\u0131": "i", "\u0130": "i"}
# Shorter literals are not looked for before their pattern.
LEAST_LITERAL = 3

RULE_SCHEMA = T.StructType([
    T.StructField("app", T.StringType()),
    T.StructField("category_names", T.StringType()),
    T.StructField("cat_rank", T.IntegerType()),
    T.StructField("kind", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("pattern", T.StringType()),
])


def clean_pattern(p: str, kind: str) -> str:
    r"""Drop the ``\;...`` tail (version / confidence tags); space → ``\s`` except for headers."""
    p = re.sub(r'\\;[^"]+', "", p)
    return p if kind == "headers" else p.replace(" ", r"\s")


def rules_from_json(spark: SparkSession, text: str) -> DataFrame:
    """Flatten a rule file into ``platform_rules`` rows.

    ``cat_rank`` is the position of the app's first category in
    ``CATEGORY_ORDER`` (apps in none of those categories are never reported);
    ``category_names`` joins the names of the app's categories in category-key
    order with `` / ``.  ``html`` and ``script`` may be a string or a list.
    """
    doc = json.loads(text)
    cats = doc.get("categories", {})
    cat_keys = sorted(cats.keys())  # object keys in key order
    rows = []
    for app in sorted(doc.get("apps", {})):
        spec = doc["apps"][app]
        if not isinstance(spec, dict):
            continue
        app_cats = spec.get("cats", [])
        ranks = [CATEGORY_ORDER.index(c) for c in app_cats if c in CATEGORY_ORDER]
        if not ranks:
            continue
        names = " / ".join(cats[k].get("name", "") for k in cat_keys if int(k) in app_cats)
        for kind in KIND_ORDER:
            v = spec.get(kind)
            if v is None:
                continue
            if kind in ("headers", "meta"):
                items = [(k, x) for k, x in v.items()] if isinstance(v, dict) else []
            else:
                items = [("", x) for x in (v if isinstance(v, list) else [v])]
            for key, pat in items:
                rows.append((app, names, min(ranks), kind, key, clean_pattern(str(pat), kind)))
    return spark.createDataFrame(rows, RULE_SCHEMA)


def required_literal(pattern: str) -> str:
    """The longest run of ASCII letters and digits (lower case) that every match of ``pattern`` holds, or an empty string.

    Groups, classes, optional and other characters end a run; a pattern with alternatives outside
    groups, or with inline flags, requires nothing.
    """
    runs, run, i, n = [], "", 0, len(pattern)
    while i < n:
        c = pattern[i]
        if c == "|" or pattern.startswith("(?", i) and not re.match(r"\(\?(?::|<[A-Za-z])", pattern[i:]):
            return ""
        if c in "([":  # skipped whole
            i = _closing(pattern, i)
            if i < 0:
                return ""
            runs, run = [*runs, run], ""
        elif c == "\\":
            i += 1
            if i < n and pattern[i] in "QExu0cpPkN":  # a quotation, a character by number, a property
                return ""
            runs, run = [*runs, run], ""
        elif c in "*?{":
            low = re.match(r"\{(\d+)", pattern[i:])
            if not (low and int(low[1]) > 0):
                run = run[:-1]
            runs, run = [*runs, run], ""
            while i + 1 < n and c == "{" and pattern[i] != "}":
                i += 1
        elif not (c.isascii() and c.isalnum()):
            runs, run = [*runs, run], ""
        else:
            run += c
        i += 1
    return max([*runs, run], key=len).lower()


def _closing(pattern: str, i: int) -> int:
    """The place of the bracket that closes the group or class at ``i``; -1 if none does."""
    depth, in_class = 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
            if pattern.startswith("[^]", i) or pattern.startswith("[]", i):
                return -1
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        if depth == 0 and not in_class:
            return i
        i += 1
    return -1


def _words(html: Column) -> Column:
    """The distinct runs of ASCII letters and digits of a body, in lower case, as one text.

    Whatever equals an ASCII letter regardless of case is that letter, as for the patterns.
    """
    for letter, ascii_one in FOLDED.items():
        html = F.replace(html, F.lit(letter), F.lit(ascii_one))
    return F.array_join(F.array_distinct(F.split(F.lower(html), "[^a-z0-9]+")), " ")


CI = "(?iu)"  # any letter regardless of case; \\s is ASCII white space


def _rule_table(rules: list) -> Column:
    """The rules as one array: label (filled by the caller), app, kind, literal, key, tag and pattern to run.

    The script, meta and content patterns are fixed: they are the reference's.  For meta, ".+\\s+content=..." searched
    anywhere is the same test as "[^\\n]\\s+content=...": one non-newline character is a valid ".+"; the second form
    searches in linear time, the first restarts its greedy ".+" at every position when the test fails.
    """
    made = []
    for r in rules:
        kind, pattern, tag = r["kind"], r["pattern"], ""
        literals = [] if kind == "headers" else [required_literal(pattern)]
        if kind == "script":
            pattern = "<script.+\\s+src=[\"']([^\"]*" + pattern + "[^\"]*)[\"']"
        elif kind == "meta":
            literals.append(required_literal(re.escape(r["key"])))
            tag = CI + "<meta.+name=[\"']" + re.escape(r["key"]) + "[\"'][^>]+>"
            pattern = "[^\\n]\\s+content=[\"']([^\"]*" + pattern + "[^\"]*)[\"']"
        elif kind not in ("html", "headers"):
            raise ValueError(kind)
        made.append({"label": r["label"], "app": r["app"], "kind": kind, "literal": max(["", *literals], key=len), "key": r["key"] or "", "tag": tag, "pattern": CI + pattern})
    fields = ", ".join(f"{n}: string" for n in ("label", "app", "kind", "literal", "key", "tag", "pattern"))
    return F.from_json(F.lit(json.dumps(made)), f"array<struct<{fields}>>")  # folded into one literal of the plan


def _candidates(rules: list, words: Column) -> Column:
    """The rules whose literal is in the body; one pass over the body's words, whatever the number of rules."""
    # as an argument the words are made once a page, not once a rule
    picked = F.transform(F.array(words), lambda w: F.filter(_rule_table(rules), lambda r: (F.length(r["literal"]) < LEAST_LITERAL) | w.contains(r["literal"])))
    return F.element_at(picked, 1)


def _hit(r: Column, html: Column, headers: Column | None) -> Column:
    on_tag = F.call_function("regexp_extract", html, r["tag"], F.lit(0))
    test = F.when(r["kind"] == "meta", F.call_function("rlike", on_tag, r["pattern"]))
    test = test.when(r["kind"] == "headers", F.call_function("rlike", F.try_element_at(headers, r["key"]), r["pattern"]) if headers is not None else F.lit(False))
    return F.coalesce(test.otherwise(F.call_function("rlike", html, r["pattern"])), F.lit(False))


def _collect_rules(rules: DataFrame) -> list:
    """The rule file's patterns in the order they are tried: configuration, which becomes literals of the plan."""
    return rules.orderBy("cat_rank", "app", F.array_position(F.array(*[F.lit(k) for k in KIND_ORDER]), F.col("kind")), "key", "pattern").collect()


def match_platform_rules(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", html_col: str = "html",
                         headers_col: str | None = None) -> DataFrame:
    """Every (page, app, kind) hit."""
    _require(pages, id_col, html_col)
    html = F.coalesce(F.col(html_col), F.lit(""))
    headers = F.col(headers_col) if headers_col else None
    rs = [r.asDict() | {"label": ""} for r in _collect_rules(rules)]
    if not rs:
        return pages.limit(0).select(F.col(id_col).alias("page_id"), F.lit("").alias("app"), F.lit("").alias("kind"))
    hits = F.filter(_candidates(rs, _words(html)), lambda r: _hit(r, html, headers))
    hits = F.array_distinct(F.transform(hits, lambda r: F.struct(r["app"].alias("app"), r["kind"].alias("kind"))))
    return pages.select(F.col(id_col).alias("page_id"), F.explode(hits).alias("h")).select("page_id", "h.app", "h.kind")


def detect_platform(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", html_col: str = "html",
                    status_col: str | None = None, headers_col: str | None = None, out: str = "platform_raw") -> DataFrame:
    """``<categories> | <app>`` of the first matching app, ``Not Found`` when
    none; an empty body or a status above 400 gives ``error : HTTP Status [n]``.

    Apps are tried in priority order; a page that has its answer runs no further pattern.  Any number of
    rules is one projection.
    """
    _require(pages, id_col, html_col)
    html = F.coalesce(F.col(html_col), F.lit(""))
    headers = F.col(headers_col) if headers_col else None
    collected = _collect_rules(rules)
    first: dict[str, tuple] = {}  # an app is tried at the place, and has the name, of its first rule
    for r in collected:
        first.setdefault(r["app"], (r["cat_rank"], r["app"], r["category_names"]))
    rs = sorted((r.asDict() | {"label": f"{first[r['app']][2]} | {r['app']}"} for r in collected), key=lambda r: first[r["app"]])
    none = F.lit(None).cast("string")
    label = F.aggregate(_candidates(rs, _words(html)), none, lambda seen, r: F.when(seen.isNotNull(), seen).when(_hit(r, html, headers), r["label"])) if rs else none
    status = F.col(status_col) if status_col else F.lit(None).cast("int")
    err = (F.col(html_col).isNull() | (F.col(html_col) == "")) | F.coalesce(status > 400, F.lit(False))
    label = F.when(err, F.concat(F.lit("error : HTTP Status ["), F.coalesce(status.cast("string"), F.lit("")), F.lit("]"))).otherwise(F.coalesce(label, F.lit(NOT_FOUND)))
    return pages.withColumn(out, label)
