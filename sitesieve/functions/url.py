"""Column functions over URL strings (P1, P6-P8, P14-P19, G1 encoding).

All of them are built-in Spark expressions, so they stay inside whole-stage
codegen and need no Python on the rows.  The regular expressions avoid
look-around and back-references so the same text runs in Spark (Java regex)
and in the DuckDB oracle (RE2).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# Fixed patterns (shared with the oracle SQL).
SCHEME_RE = r"^([A-Za-z][A-Za-z0-9+.-]*)://"
# scheme, userinfo, host, port, path, query, fragment
URL_RE = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#@]*@)?([^/?#:]*)(:[0-9]*)?([^?#]*)(\?[^#]*)?(#.*)?$"
ABSOLUTE_RE = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]+"
ROOT_RE = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*$"
SITE_RE = r"^([A-Za-z][A-Za-z0-9+.-]*://)(?:[^/?#@]*@)?([^/?#:]*)"
LAST_SEGMENT_RE = r"[^/]+/?$"
REDIRECT_CODES = (301, 302, 307, 308)


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def simplified(c: ColumnOrName) -> Column:
    """Trim whitespace at both ends and collapse inner runs to one space (values without any to change pass one test)."""
    x = _c(c)
    return F.when(x.rlike(r"^\s|\s$|\s\s|[\t\n\x0B\f\r]"), F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), r"\s+", " ")).otherwise(x)


def url_scheme(c: ColumnOrName) -> Column:
    """Lower-case scheme, ``""`` when there is none."""
    return F.lower(F.regexp_extract(_c(c), URL_RE, 1))


def url_host(c: ColumnOrName) -> Column:
    """Lower-case host without user info and port, ``""`` for a relative URL."""
    return F.lower(F.regexp_extract(_c(c), URL_RE, 3))


def url_port(c: ColumnOrName) -> Column:
    return F.regexp_extract(_c(c), URL_RE, 4).substr(2, 10).try_cast("int")


def url_path(c: ColumnOrName) -> Column:
    return F.regexp_extract(_c(c), URL_RE, 5)


def url_query(c: ColumnOrName) -> Column:
    return F.regexp_extract(_c(c), URL_RE, 6)


def is_absolute(c: ColumnOrName) -> Column:
    """P1 guard: a scheme followed by ``://`` and a non-empty host.

    This is the test every enrichment applies before it does any work.
    NULL input gives false.
    """
    return F.coalesce(_c(c).rlike(ABSOLUTE_RE), F.lit(False))


def site_root(c: ColumnOrName) -> Column:
    """``scheme://host`` (port and user info dropped, host lower-cased); ``""`` if relative."""
    x = _c(c)
    return F.when(x.rlike(ABSOLUTE_RE), F.concat(url_scheme(x), F.lit("://"), url_host(x))).otherwise(F.lit(""))


def site_prefix(c: ColumnOrName) -> Column:
    """``scheme://host`` exactly as written (case kept), used by outbound-link tests."""
    return F.regexp_extract(_c(c), SITE_RE, 0)


def is_root(c: ColumnOrName) -> Column:
    """True when nothing but the authority follows ``scheme://`` (one trailing ``/`` allowed)."""
    t = F.regexp_replace(_c(c), "/$", "")
    return t.rlike(ROOT_RE)


def replace_literal(c: ColumnOrName, search: str, repl: str) -> Column:
    """All occurrences, case-sensitive."""
    if search == "":
        return _c(c)
    return F.replace(_c(c), F.lit(search), F.lit(repl))


def java_replacement(repl: str) -> str:
    r"""Turn a ``\1`` style replacement into Java's ``$1`` form; ``$`` kept literal."""
    out = []
    i = 0
    while i < len(repl):
        ch = repl[i]
        if ch == "\\" and i + 1 < len(repl) and repl[i + 1].isdigit():
            out.append("$" + repl[i + 1])
            i += 2
            continue
        if ch == "$":
            out.append("\\$")
        elif ch == "\\":
            out.append("\\\\")
        else:
            out.append(ch)
        i += 1
    return "".join(out)


def replace_regex(c: ColumnOrName, pattern: str, repl: str) -> Column:
    """All matches replaced (P7); ``\\N`` in ``repl`` refers to group N."""
    return F.regexp_replace(_c(c), F.lit(pattern), F.lit(java_replacement(repl)))


def replace_literal_keep_scheme(c: ColumnOrName, search: str, repl: str) -> Column:
    """Replace only after the first ``://``; without ``://`` the whole string.

    Decision (SURVEY §7.6): the reference starts at character 2 when there is
    no ``://``; we replace in the whole string.
    """
    x = _c(c)
    if search == "":
        return x
    pos = F.instr(x, "://")
    head = x.substr(F.lit(1), pos + 2)
    tail = x.substr(pos + 3, F.lit(2147483647))
    return F.when(pos > 0, F.concat(head, F.replace(tail, F.lit(search), F.lit(repl)))).otherwise(
        F.replace(x, F.lit(search), F.lit(repl))
    )


def percent_encode(c: ColumnOrName) -> Column:
    """Percent-encode everything except ``A-Za-z0-9-._~``; space as ``%20``."""
    e = F.url_encode(_c(c))
    return F.replace(F.replace(F.replace(e, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def percent_encode_keep_percent(c: ColumnOrName) -> Column:
    """Like :func:`percent_encode` but a ``%`` in the value is left alone (G2 ``::encoded``)."""
    return F.replace(percent_encode(c), F.lit("%25"), F.lit("%"))


def percent_decode(c: ColumnOrName) -> Column:
    """Percent-decode, leaving ``+`` as ``+``; undecodable input unchanged."""
    x = _c(c)
    d = F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))
    return F.coalesce(d, x)


def decode_if_absolute(c: ColumnOrName) -> Column:
    """Percent-decode a value only when it is an absolute URL."""
    x = _c(c)
    return F.when(is_absolute(x), percent_decode(x)).otherwise(x)


def remove_dot_segments(path: ColumnOrName) -> Column:
    """RFC 3986 dot-segment removal of a path starting with ``/``: ``.``
    segments dropped, ``..`` removes the previous segment (a stack built with
    ``aggregate`` over the segments, exact for any depth)."""
    segs = F.split(_c(path), "/")
    rest = F.slice(segs, 2, F.greatest(F.size(segs) - 1, F.lit(1)))
    stack = F.aggregate(
        rest,
        F.array().cast("array<string>"),
        lambda acc, seg: F.when(seg == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(seg == ".", acc)
        .otherwise(F.array_append(acc, seg)),
    )
    last = F.element_at(segs, -1)
    stack = F.when(last.isin(".", ".."), F.array_append(stack, F.lit(""))).otherwise(stack)
    return F.concat(F.lit("/"), F.array_join(stack, "/"))


def _normalized(root: Column, merged: Column) -> Column:
    """``root`` + ``merged`` with dot segments removed from the path part only."""
    path = F.regexp_extract(merged, r"^[^?#]*", 0)
    tail = F.substring(merged, F.length(path) + 1, 2147483647)
    return F.concat(root, remove_dot_segments(path), tail)


def resolve_url(base: ColumnOrName, ref: ColumnOrName) -> Column:
    """Resolve ``ref`` against ``base``.

    ``&amp;`` becomes ``&`` first.  An absolute ``ref`` is returned as is; one
    starting with ``?`` or ``#`` is appended to the whole base string; one
    starting with ``//`` is a network-path reference (base scheme + ref); one
    starting with ``/`` goes after ``scheme://host``; anything else goes after
    the base's directory.  ``.`` and ``..`` path segments of the last two
    forms are removed (RFC 3986).  Port and user info of the base are
    dropped, as in the reference.
    """
    b = _c(base)
    r = F.replace(_c(ref), F.lit("&amp;"), F.lit("&"))
    root = F.concat(url_scheme(b), F.lit("://"), url_host(b))
    directory = F.concat(F.regexp_replace(url_path(b), "/[^/]*$", ""), F.lit("/"))
    return (
        F.when(r.isNull(), F.lit(None).cast("string"))
        .when(r.rlike(SCHEME_RE), r)
        .when(r.startswith("?") | r.startswith("#"), F.concat(b, r))
        .when(r.startswith("//"), F.concat(url_scheme(b), F.lit(":"), r))
        .when(r.startswith("/"), _normalized(root, r))
        .otherwise(_normalized(root, F.concat(directory, r)))
    )


def status_class(c: ColumnOrName) -> Column:
    """``ok`` 200-299, ``redirect`` 300-399, ``error`` >= 400, else ``none``."""
    s = _c(c)
    return (
        F.when(s.between(200, 299), F.lit("ok"))
        .when(s.between(300, 399), F.lit("redirect"))
        .when(s >= 400, F.lit("error"))
        .otherwise(F.lit("none"))
    )


def render_line(cols: list[ColumnOrName], sep: str = "|") -> Column:
    """Chosen cells joined by ``|``; an embedded ``|`` becomes ``%7C``; NULL as ``""``."""
    parts = [F.replace(F.coalesce(_c(x).cast("string"), F.lit("")), F.lit("|"), F.lit("%7C")) for x in cols]
    return F.concat_ws(sep, *parts)


def split_platform(c: ColumnOrName) -> tuple[Column, Column]:
    """``cat | name`` → (category, platform); not exactly two parts → ``Not found`` twice."""
    parts = F.split(_c(c), r"\|")
    ok = F.size(parts) == 2
    return (
        F.when(ok, F.element_at(parts, 1)).otherwise(F.lit("Not found")),
        F.when(ok, F.element_at(parts, 2)).otherwise(F.lit("Not found")),
    )
