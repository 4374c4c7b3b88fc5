"""From callee texts to edges: within the file, then across files through imports. All of it is joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.sources.trees import module_name


def exploded_calls(entities: DataFrame) -> DataFrame:
    """(id, file_path, call): each different callee text of an entity."""
    return entities.select("id", "file_path", F.explode(F.array_distinct("calls")).alias("call")).where("call is not null")


def resolve_in_file(entities: DataFrame) -> DataFrame:
    """(id, file_path, call, target): callee texts matched to entities of the same file.

    By the whole text as a name, else by its last part after `.` or `:`; a name held by several entities gives
    a row for each; a text that matches nothing is its own target.
    """
    calls = exploded_calls(entities).withColumn("last", F.element_at(F.filter(F.split("call", "[.:]"), lambda p: p != ""), -1))
    names = entities.select(F.col("file_path").alias("file"), F.col("name").alias("symbol"), F.col("id").alias("whole")).distinct()
    direct = calls.join(names, (calls["file_path"] == names["file"]) & (calls["call"] == names["symbol"]), "left").drop("file", "symbol")
    parts = names.withColumnRenamed("whole", "part")
    rest = direct.join(parts, direct["whole"].isNull() & (direct["file_path"] == parts["file"]) & (direct["last"] == parts["symbol"]), "left")
    return rest.select("id", "file_path", "call", F.coalesce("whole", "part", "call").alias("target"))


def symbol_table(entities: DataFrame) -> DataFrame:
    """(module, name, id): of several entities of one name in a module the last by id."""
    return entities.groupBy(module_name(F.col("file_path")).alias("module"), "name").agg(F.max("id").alias("id"))


def import_map(imports: DataFrame) -> DataFrame:
    """One row per (source_file, imported_name): the last import of the name in the file."""
    w = Window.partitionBy("source_file", "imported_name").orderBy(F.desc("ordinal"))
    return imports.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def is_relative(module: F.Column) -> F.Column:
    """Whether a module text is told from the importing file: `./x`, `../x`, `.x`, `self::x`, `super::x`."""
    return module.rlike(r"^(\.|(self|super)(::|$))")


def normal_module(module: F.Column, source_file: F.Column) -> F.Column:
    """A module text of any language as a dotted module: `crate::a::b`, `./x` and `a/b` alike.

    Relative ones are walked step by step from the importing file: `../` and Python's further dots by folders,
    `super` by modules; steps beyond the root are ignored. A leading `crate` and extensions fall away.
    """
    path = F.regexp_extract(module, r"^((?:\.\.?/)+)", 1)
    dots = F.when(path == "", F.regexp_extract(module, r"^(\.+)", 1)).otherwise("")
    steps = F.regexp_extract(module, r"^((?:(?:self|super)(?:::|$))+)", 1)
    lead = F.concat(path, dots, steps)
    own = F.split(module_name(source_file), r"\.")
    is_folder = source_file.rlike(r"(^|/)(__init__|mod)\.[^./]+$").cast("int")
    up = (
        F.when(path != "", F.size(F.split(path, r"\.\.")))
        .when(dots != "", F.length(dots) - is_folder)
        .otherwise(F.size(F.split(steps, "super")) - 1)
    )
    base = F.when(lead != "", F.slice(own, 1, F.greatest(F.size(own) - up, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    rest = F.substring(module, F.length(lead) + 1, F.length(module))
    bare = F.regexp_replace(F.regexp_replace(rest, r"\.(py|rs|js|jsx|mjs|cjs|ts|tsx|mts|cts|go)$", ""), r"^crate(::|$)", "")
    dotted = F.regexp_replace(F.regexp_replace(bare, "::|/", "."), r"^\.+", "")
    return F.concat_ws(".", F.filter(base, lambda p: p != ""), F.nullif(dotted, F.lit("")))


def resolve_calls(entities: DataFrame, imports: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(src, call, dst): calls that name an imported symbol, or begin with an imported name.

    ``entities`` (id, file_path, name, calls) whose calls are resolved, against ``known`` (by default the same);
    ``imports`` as extracted. `f()` after an import of f from m is
    m's f; `m.f()` after an import of m is m's f; `s.f()` after an import of s from m is f in m.s, else in m.
    Modules are compared in dotted form; one that isn't relative also matches by its last component, if only one does.
    """
    symbols = symbol_table(known if known is not None else entities)
    calls = exploded_calls(entities)
    sep = F.when(F.col("call").contains("::"), "::").otherwise(".")
    calls = calls.withColumns(
        {
            "head": F.when(F.col("call").contains("::"), F.substring_index("call", "::", 1)).otherwise(F.substring_index("call", ".", 1)),
            "tail": F.when(F.col("call").contains("::"), F.substring_index("call", "::", -1)).otherwise(F.substring_index("call", ".", -1)),
            "middle": F.when(
                F.size(F.split("call", r"::|\.")) > 2,
                F.regexp_replace(F.regexp_extract("call", r"^[^:.]+(?:::|\.)(.*)(?:::|\.)[^:.]+$", 1), "::", "."),
            ),
            "qualified": F.col("call").contains("::") | F.col("call").contains("."),
            "separator": sep,
        }
    )
    module = normal_module(F.col("module_path"), F.col("source_file"))
    names = import_map(imports).select("source_file", "imported_name", module.alias("module"), "symbol", is_relative(F.col("module_path")).alias("relative"))
    joined = calls.join(names, (calls["file_path"] == names["source_file"]) & (calls["head"] == names["imported_name"]))
    direct = F.when(~F.col("qualified") & F.col("symbol").isNotNull(), F.array(F.struct(F.col("module").alias("module"), F.col("symbol").alias("name"))))
    inner = F.concat_ws(".", F.nullif(F.col("module"), F.lit("")), F.col("symbol"), F.col("middle"))
    through = F.when(
        F.col("qualified"),
        F.array(
            F.struct(inner.alias("module"), F.col("tail").alias("name")),
            F.struct(F.col("module").alias("module"), F.col("tail").alias("name")),
        ),
    )
    wanted = joined.select(F.col("id").alias("src"), "call", "relative", F.posexplode(F.coalesce(direct, through)).alias("rank", "w")).select(
        "src", "call", "relative", "rank", F.col("w.module").alias("module"), F.col("w.name").alias("name")
    )
    exact = wanted.join(symbols, ["module", "name"]).select("src", "call", "rank", F.lit(0).alias("loose"), F.col("id").alias("dst"))
    # the last component, where it tells one entity
    last = symbols.groupBy(F.substring_index("module", ".", -1).alias("short"), "name").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    last = last.where("n = 1")
    loose = wanted.where("not relative").withColumn("short", F.substring_index("module", ".", -1)).join(last, ["short", "name"])
    loose = loose.select("src", "call", "rank", F.lit(1).alias("loose"), F.col("id").alias("dst"))
    best = exact.unionByName(loose).groupBy("src", "call").agg(F.min_by("dst", F.struct("loose", "rank", "dst")).alias("dst"))
    return best.where("src <> dst")


def resolve_imports(entities: DataFrame, imports: DataFrame) -> DataFrame:
    """The distinct (src, dst) of resolve_calls."""
    return resolve_calls(entities, imports).select("src", "dst").distinct()


def call_edges(entities: DataFrame, imports: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(src, dst): calls resolved in the file or through imports, and texts written as an id that nothing resolves."""
    across = resolve_calls(entities, imports, known)
    inside = resolve_in_file(entities).where(F.col("target").contains("::")).select(F.col("id").alias("src"), "call", F.col("target").alias("dst"))
    settled = across.select("src", "call").distinct()
    raw = inside.where("call = dst").join(settled, ["src", "call"], "left_anti")
    return inside.where("call <> dst").unionByName(raw).unionByName(across).select("src", "dst").distinct()


def with_callers(entities: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """Entities with ``called_by`` from the edges (src, dst), sorted; an empty array where nothing calls it.

    A hub's callers become one array, as the tables have it; with ``most`` only so many of the first by id are kept.
    Use lookup.adjacency where a hub's callers don't fit one row.
    """
    links = edges.where("src is not null and dst is not null").select("src", "dst").distinct()
    callers = links.groupBy("dst").agg(F.array_sort(F.collect_list("src")).alias("called_by"))
    if most is not None:
        callers = callers.withColumn("called_by", F.slice("called_by", 1, most))
    found = entities.drop("called_by").join(callers.withColumnRenamed("dst", "id"), "id", "left")
    return found.withColumn("called_by", F.coalesce("called_by", F.array().cast("array<string>")))
