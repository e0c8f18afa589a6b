"""JSON value picking (C7) and JSON item lists (C8) with Spark's VARIANT type.

Paths are data (a spec string): steps separated by ``,``, paths by spaces.
A numeric step indexes an array or names an object key, decided per row by
the value's type, exactly as the reference walks the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEP = '","'


def _at(root: Column, steps: list[str]) -> Column:
    """The value at a path: each step an index into an array, or a key of an object.

    An index on an object, or a key on an array, gives NULL, so the
    readings of a path, one extraction each, coalesced pick the right one
    without testing any type."""
    readings = [""]
    for step in steps:
        key = step.replace("\\", "\\\\").replace("'", "\\'")
        forms = [f"[{int(step)}]", f"['{key}']"] if step.isdigit() else [f"['{key}']"]
        readings = [r + form for r in readings for form in forms]
    return F.coalesce(*[F.try_variant_get(root, f"${r}", "variant") for r in readings])


def variant_text(v: Column) -> Column:
    """Reference text of a JSON value: strings as is, booleans ``true``/``false``,
    numbers with a fraction to 2 decimals, whole numbers without decimals,
    objects/arrays/null as ``""``."""
    t = F.schema_of_variant(v)
    d = F.try_variant_get(v, "$", "double")
    num = F.when(d - F.floor(d) > 0, F.format_string("%.2f", d)).otherwise(F.try_variant_get(v, "$", "decimal(38,0)").cast("string"))
    return (
        F.when(v.isNull(), F.lit(""))
        .when(t == "STRING", F.try_variant_get(v, "$", "string"))
        .when(t == "BOOLEAN", F.try_variant_get(v, "$", "string"))
        .when(t.startswith("DECIMAL") | t.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT"), num)
        .otherwise(F.lit(""))
    )


def with_json_pick(df: DataFrame, body_col: str, spec: str, out: str = "picked") -> DataFrame:
    """C7 as a DataFrame step: the body is parsed once (its own projection,
    which Catalyst keeps separate because the parse is not cheap), then every
    path reads the parsed value."""
    parsed = df.withColumn("_jv", F.try_parse_json(F.col(body_col)))
    paths = spec.split(" ")
    values = parsed.select(*df.columns, *[_at(F.col("_jv"), p.split(",")).alias(f"_v{i}") for i, p in enumerate(paths)])
    texts = [F.coalesce(variant_text(F.col(f"_v{i}")), F.lit("")) for i in range(len(paths))]
    return values.withColumn(out, F.concat_ws(SEP, *texts)).drop(*[f"_v{i}" for i in range(len(paths))])


def json_pick(body: Column, spec: str) -> Column:
    """Values at the space-separated paths of ``spec`` joined by ``","``;
    a path that does not resolve (or a body that is not JSON) gives ``""``."""
    return _pick(F.try_parse_json(body), spec)


def _pick(root: Column, spec: str) -> Column:
    return F.concat_ws(SEP, *[F.coalesce(variant_text(_at(root, path.split(","))), F.lit("")) for path in spec.split(" ")])


def json_items(df: DataFrame, body_col: str, path: str, keep: list[str] | None = None) -> DataFrame:
    """One row per element of the array at ``path`` (steps as in C7), with
    its position and text; a scalar at the path is one item."""
    steps = [s for s in path.split(",") if s]
    v = F.try_parse_json(F.col(body_col))
    v = _at(v, steps) if steps else v
    keep = keep or [c for c in df.columns if c != body_col]
    arr = F.try_variant_get(v, "$", "array<variant>")
    items = F.when(F.schema_of_variant(v).startswith("ARRAY"), arr).when(v.isNotNull(), F.array(v))
    exploded = df.select(*keep, F.posexplode(items).alias("pos", "_v"))
    return exploded.select(*keep, "pos", variant_text(F.col("_v")).alias("item"))
