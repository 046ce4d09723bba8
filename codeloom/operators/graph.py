"""The call graph: resolution, neighbours, traversal, enclosing ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.session import written

DIRECTIONS = ("calls", "callers", "both")


class UnknownSymbolError(LookupError):
    """No symbol has this id."""


def unique_names(symbols: DataFrame, name: str = "name", id_col: str = "id") -> DataFrame:
    """(name, id) of the names that only one symbol has."""
    return symbols.groupBy(F.col(name).alias("name")).agg(F.count("*").alias("n"), F.min(id_col).alias("id")).filter("n = 1").select("name", "id")


def resolve(edges: DataFrame, symbols: DataFrame, called: Column, name: str = "name", id_col: str = "id") -> DataFrame:
    """Edges without a callee get the only symbol of the name they call, if there is one; adds ``resolved``."""
    unique = unique_names(symbols, name, id_col).select(F.col("name").alias("name_"), F.col("id").alias("id_"))
    wanted = F.when(F.col("callee_id").isNull(), called)
    joined = edges.withColumn("called_", wanted).join(unique, F.col("called_") == F.col("name_"), "left")
    return joined.withColumn("callee_id", F.coalesce("callee_id", "id_")).withColumn("resolved", F.col("callee_id").isNotNull()).select(*edges.columns, "resolved")


def neighbours(edges: DataFrame, symbols: DataFrame, ids: list, direction: str, id_col: str = "id", columns: tuple[str, ...] = ("qualified_name", "summary")) -> DataFrame:
    """Edges of ``ids`` with what is known of the other end, ``direction`` calls or callers; unknown ends have nulls."""
    if direction not in ("calls", "callers"):
        return edges.select("caller_id", "callee_id", "raw_expression", "confidence", *(F.lit(None).cast("string").alias(c) for c in columns), F.lit("").alias("direction")).limit(0)
    own, other = ("caller_id", "callee_id") if direction == "calls" else ("callee_id", "caller_id")
    ends = symbols.select(F.col(id_col).alias("end_"), *columns)
    found = edges.filter(F.col(own).isin(ids)).join(ends, F.col(other) == F.col("end_"), "left")
    return found.select("caller_id", "callee_id", "raw_expression", "confidence", *columns, F.lit(direction).alias("direction"))


def trace(edges: DataFrame, symbols: DataFrame, symbol_id: str, direction: str = "both", depth: int = 1, id_col: str = "id") -> DataFrame:
    """Edges from and to a symbol, with ``distance``; an unknown symbol is an error, an unknown direction gives no rows."""
    if symbols.filter(F.col(id_col) == symbol_id).limit(1).count() == 0:
        raise UnknownSymbolError(symbol_id)
    depth = depth if depth > 0 else 1
    out = neighbours(edges, symbols, [], "none", id_col).withColumn("distance", F.lit(1))
    for way in ("calls", "callers") if direction == "both" else (direction,):
        if way not in ("calls", "callers"):
            continue
        own, other = ("caller_id", "callee_id") if way == "calls" else ("callee_id", "caller_id")
        reached = reach(edges.select(F.col(own).alias("src"), F.col(other).alias("dst")), [symbol_id], depth - 1).select(F.col("id").alias("own_"), "distance")
        ends = symbols.select(F.col(id_col).alias("end_"), "qualified_name", "summary")
        step = edges.join(reached, F.col(own) == F.col("own_")).join(ends, F.col(other) == F.col("end_"), "left")
        out = out.unionByName(
            step.select("caller_id", "callee_id", "raw_expression", "confidence", "qualified_name", "summary", F.lit(way).alias("direction"), (F.col("distance") + 1).cast("int").alias("distance"))
        )
    return out


def has_dynamic(edges: DataFrame) -> DataFrame:
    return edges.agg(F.coalesce(F.bool_or(F.col("confidence") == "dynamic"), F.lit(False)).alias("has_dynamic_edges"))


def reach(links: DataFrame, starts: list, depth: int) -> DataFrame:
    """(id, distance) of the nodes within ``depth`` links (src, dst) of the starts, each at its least distance.

    Every hop joins the frontier with the links, leaves out what was seen and is written to the shared folder; so a hop is
    one join of tables, whatever the depth. It ends where nothing new is reached.
    """
    kind = links.schema["src"].dataType.simpleString()
    seen = links.sparkSession.createDataFrame([(s,) for s in starts], f"id {kind}").distinct().withColumn("distance", F.lit(0))
    front = seen
    for k in range(1, depth + 1):
        following = links.join(front.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).filter("id is not null").distinct()
        front = written(following.join(seen.select("id"), "id", "left_anti").withColumn("distance", F.lit(k)), "frontier")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def enclosing(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, start: str, end: str, order: str, carry: list[str]) -> DataFrame:
    """For each point the smallest range [start, end) of its group that holds it, the first of equal ones; else dropped.

    A range of a size up to 2**n is put in the one or two cells of width 2**n that it touches; a point looks into its cell
    of each width that occurs (64 at most). So a point meets but ranges near it, by an equi-join. Equal points are looked
    up once and given back as often as they occur.
    """
    size = F.col("end_") - F.col("start_")
    own = ranges.select(*keys, F.col(start).cast("bigint").alias("start_"), F.col(end).cast("bigint").alias("end_"), F.col(order).alias("order_"), *(F.col(c).alias(f"r_{c}") for c in carry))
    own = own.filter(size > 0).withColumn("level_", F.length(F.bin(size - 1)))
    levels = sorted(r.level_ for r in own.select("level_").distinct().collect())
    cell = lambda x: F.expr(f"shiftright({x}, level_)")
    own = own.withColumn("cell_", F.explode(F.array_distinct(F.array(cell("start_"), cell("end_ - 1")))))
    counted = points.groupBy(*points.columns).agg(F.count("*").alias("times_")).withColumn("at_", F.col(at).cast("bigint"))
    looked = counted.withColumn("level_", F.explode(F.lit(levels).cast("array<int>"))).withColumn("cell_", cell("at_"))
    held = looked.join(own, [*keys, "level_", "cell_"]).filter((F.col("start_") <= F.col("at_")) & (F.col("at_") < F.col("end_")))
    best = F.struct(size.alias("size"), F.col("order_").alias("order"))
    found = held.groupBy(*points.columns, "times_").agg(F.min_by(F.struct(*(f"r_{c}" for c in carry)), best).alias("in_"))
    found = found.withColumn("time_", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times_"))))
    return found.select(*points.columns, *(F.col("in_")[f"r_{c}"].alias(f"enclosing_{c}") for c in carry))
