"""Captured language-server answers, as JSON text, turned into flat tables. Null and unreadable answers give no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.adapters import is_external, route_language
from ..operators.tables import written
from ..plans.schema import END

_POS = "struct<line:bigint,character:bigint>"
_RANGE = f"struct<start:{_POS},`end`:{_POS}>"
_LOCATION = f"struct<uri:string,range:{_RANGE},targetUri:string,targetRange:{_RANGE},targetSelectionRange:{_RANGE}>"
_ITEM = f"struct<name:string,kind:bigint,uri:string,range:{_RANGE},selectionRange:{_RANGE}>"


def count_failures(answers: DataFrame, column: str) -> DataFrame:
    """Files seen and answers that were missing or no JSON."""
    bad = F.col(column).isNull() | F.expr(f"try_parse_json(`{column}`)").isNull()
    return answers.agg(F.count("*").alias("files_seen"), F.count_if(bad).alias("fetch_errors"))


# Each symbol with its place in depth-first order, eight digits a level, and its full name; an empty module path leaves its dot.
_UNFOLD = """
WITH RECURSIVE symbols AS (
  SELECT uri, CAST(NULL AS STRING) AS parent_path, lpad(CAST(e.pos AS STRING), 8, '0') AS path, concat(prefix, '.', coalesce(try_variant_get(e.value, '$.name', 'string'), '')) AS fqn, e.value
  FROM {trees} t, LATERAL variant_explode(t.tree) e
  UNION ALL
  SELECT uri, s.path, concat(s.path, lpad(CAST(e.pos AS STRING), 8, '0')), concat(s.fqn, '.', coalesce(try_variant_get(e.value, '$.name', 'string'), '')), e.value
  FROM symbols s, LATERAL variant_explode(try_variant_get(s.value, '$.children', 'variant')) e
) SELECT * FROM symbols"""
#: Settings that bound a recursive query's levels and rows; trees have any depth and number.
_BOUNDS = ("spark.sql.cteRecursionLevelLimit", "spark.sql.cteRecursionRowLimit")


def flatten_symbols(answers: DataFrame, root_uri: str) -> DataFrame:
    """Flat rows of documentSymbol trees ``(uri, symbols)`` with a module root for each file, parents before children.

    One recursive query over all trees, however deep, and one written table; ``path`` numbers give each row its place in depth-first order.
    """
    spark, module = answers.sparkSession, T.module_path(F.col("uri"), root_uri)
    trees = answers.select("uri", module.alias("prefix"), F.expr("try_parse_json(symbols)").alias("tree"))
    get = lambda path, kind: F.expr(f"try_variant_get(value, '$.{path}', '{kind}')")
    bounds = []
    for ours, theirs in (("range", "range"), ("sel", "selectionRange")):
        for end in ("start", "end"):
            bounds += [get(f"{theirs}.{end}.line", "bigint").alias(f"{ours}_{end}_line"), get(f"{theirs}.{end}.character", "bigint").alias(f"{ours}_{end}_col")]
    before = {k: spark.conf.get(k) for k in _BOUNDS}
    try:
        for k in _BOUNDS:
            spark.conf.set(k, "-1")
        rows = spark.sql(_UNFOLD, trees=trees)
        rows = written(rows.select("uri", "path", "parent_path", "fqn", get("name", "string").alias("name"), get("kind", "bigint").alias("kind"), get("detail", "string").alias("detail"), *bounds), "symbols")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    zero, end, none = F.lit(0).cast("long"), F.lit(END), F.lit(None).cast("string")
    root = answers.select(
        "uri", F.lit("").alias("path"), none.alias("parent_path"), module.alias("fqn"), T.leaf(module).alias("name"), F.lit(2).cast("long").alias("kind"), none.alias("detail"),
        zero.alias("range_start_line"), zero.alias("range_start_col"), end.alias("range_end_line"), end.alias("range_end_col"),
        *[zero.alias(f"sel_{e}") for e in ("start_line", "start_col", "end_line", "end_col")],
    )
    return root.unionByName(rows)


def index_symbols(flat: DataFrame, root_uri: str) -> DataFrame:
    """Rows for the node table from flat symbols, without ids, and each row's place and parent for linking."""
    language = route_language(F.col("uri"))
    bounds = [F.col(f"{p}_{e}") for p in ("range", "sel") for e in ("start_line", "start_col", "end_line", "end_col")]
    return flat.select(
        "uri", "path", "parent_path", "fqn", "name", "kind", T.symbol_kind(F.col("kind")).alias("node_kind"), "detail", *bounds, language.alias("language"),
        is_external(F.col("uri"), root_uri, language).alias("is_external"), T.signature_fingerprint(F.col("name"), F.col("kind"), F.col("detail"), *bounds).alias("signature_hash"),
    )


def locations(answers: DataFrame) -> DataFrame:
    """Location facts from ``(op, uri, line, character, answer)``: a location, a list of them, or links with targets, ``rank`` being the place in the answer."""
    many = F.from_json("answer", f"array<{_LOCATION}>")
    rows = answers.select("op", "uri", "line", "character", F.posexplode(F.filter(many, lambda x: x.isNotNull())).alias("rank", "at"))
    spot = F.coalesce("at.targetSelectionRange", "at.targetRange", "at.range")
    out = rows.select("op", "uri", "line", "character", F.coalesce("at.targetUri", "at.uri").alias("target_uri"), spot["start"]["line"].alias("target_line"), spot["start"]["character"].alias("target_character"), F.col("rank").cast("long").alias("rank"))
    return out.where("target_uri is not null and target_line is not null")


def calls(answers: DataFrame) -> DataFrame:
    """Call facts from ``(direction, uri, line, character, answer)`` lists of ``from`` / ``to`` items with call sites.

    Where an anchor had several prepared items, ``item_rank`` numbers them from 0, one answer each; null or no such column means the first.
    """
    if "item_rank" not in answers.columns:
        answers = answers.withColumn("item_rank", F.lit(0))
    shape = f"array<struct<`from`:{_ITEM},`to`:{_ITEM},fromRanges:array<{_RANGE}>>>"
    rows = answers.select("direction", "item_rank", F.col("uri").alias("anchor_uri"), F.col("line").alias("anchor_line"), F.col("character").alias("anchor_character"), F.posexplode(F.from_json("answer", shape)).alias("rank", "call"))
    item = F.when(F.col("direction") == "incoming", F.col("call.from")).otherwise(F.col("call.to"))
    sel = item["selectionRange"]
    return rows.select(
        "direction", "anchor_uri", "anchor_line", "anchor_character", item["uri"].alias("item_uri"), sel["start"]["line"].alias("item_line"), sel["start"]["character"].alias("item_character"),
        sel["end"]["line"].alias("item_end_line"), sel["end"]["character"].alias("item_end_character"), F.coalesce("item_rank", F.lit(0)).cast("long").alias("item_rank"), F.col("call.fromRanges").alias("from_ranges"),
    ).where("item_uri is not null")


def hover_text(answers: DataFrame) -> DataFrame:
    """Hover facts from ``(uri, line, character, answer)``: contents as text, an object with a value, or a list joined by blank lines."""
    v = F.expr("try_parse_json(answer)")
    text = F.expr("try_variant_get(c, '$', 'string')")
    kind = F.expr("schema_of_variant(c)")
    parts = F.expr("transform(try_variant_get(c, '$', 'array<variant>'), x -> coalesce(try_variant_get(x, '$.value', 'string'), try_variant_get(x, '$', 'string')))")
    joined = F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), "\n\n")
    rows = answers.select("uri", "line", "character", v.alias("v")).withColumn("c", F.expr("try_variant_get(v, '$.contents', 'variant')")).where("c is not null")
    out = F.when(kind.startswith("ARRAY"), joined).when(kind.startswith("OBJECT"), F.expr("try_variant_get(c, '$.value', 'string')")).otherwise(text)
    return rows.select("uri", "line", "character", out.alias("contents")).where("contents is not null")
