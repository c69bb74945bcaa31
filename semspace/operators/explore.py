"""Interactive reads over the result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions.text import item_url, space_case
from ..sources.storage import materialize
from .compose import element_key
from .skew import HOT_ROWS, hot_keys, legend_lookup, salted_lookup

ITEM_URL = "https://example.org/items/"
# Numbers of hits that a search looks at and shows, of undiscovered hits, of items in a section.
SEARCH_FIRST, SEARCH_KEEP, UNDISCOVERED_FIRST, SECTION_KEEP = 40, 30, 8, 400
AXES = ("map1", "map2", "map3", "pop", "score", "cluster", "film", "tv", "lit", "flat")


def search_items(points: DataFrame, query: str, first: int = SEARCH_FIRST, keep: int = SEARCH_KEEP) -> DataFrame:
    """Names containing the query: the first 40 by index, of those the 30 most popular."""
    q = query.strip().lower()
    if not q:
        return points.limit(0)
    hits = points.where(F.lower("name").contains(q)).orderBy("i").limit(first)
    return hits.orderBy(F.desc("tot"), "i").limit(keep)


def undiscovered_search(items: DataFrame, discoveries: DataFrame, query: str, first: int = UNDISCOVERED_FIRST) -> DataFrame:
    """Items not discovered whose name contains the query (two characters or more), first 8."""
    q = query.strip().lower()
    if len(q) < 2:
        return items.limit(0)
    hits = items.where(F.lower("name").contains(q))
    return (hits.join(discoveries.select("item_idx").distinct(), "item_idx", "left_anti")
            .orderBy("item_idx").limit(first))


def palette_sections(found: DataFrame, query: str = "", keep: int = SECTION_KEEP, roots: DataFrame | None = None,
                     users: DataFrame | None = None) -> DataFrame:
    """Discovered items (user_id, kind, item_idx, name) in name order, at most 400 a section,
    with the size of the section. The sections are cut before the shuffle, the sizes are a
    combined aggregate: no section is collected whole.

    ``roots`` (seed_idx, name): a section of kind ``root`` for every row of ``users`` (user_id; those of ``found``
    by default), in seed order and never cut, as the roots are owned from the start.
    """
    q = query.strip().lower()
    if roots is not None:
        users = (found if users is None else users).select("user_id").distinct()
        shown = palette_sections(found, query, keep)
        named = roots.where(F.lower("name").contains(q)) if q else roots
        order = F.sort_array(F.collect_list(F.struct("seed_idx", "name")))  # a handful of roots
        owned = users.withColumn("_roots", named.agg(order.alias("r")).scalar()).select(
            "user_id", F.size("_roots").cast("long").alias("section_size"), F.posexplode("_roots").alias("rank", "_root"))
        return shown.unionByName(owned.select(
            "user_id", F.lit("root").alias("kind"), F.col("_root.seed_idx").cast(shown.schema["item_idx"].dataType).alias("item_idx"),
            F.col("_root.name").alias("name"), (F.col("rank") + 1).alias("rank"), "section_size"))
    if q:
        found = found.where(F.lower("name").contains(q))
    sizes = found.groupBy("user_id", "kind").agg(F.count("*").alias("section_size"))
    order = Window.partitionBy("user_id", "kind").orderBy("name", "item_idx")
    shown = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
    return shown.join(sizes, ["user_id", "kind"])


def discovery_progress(found: DataFrame, kind: str = "genre") -> DataFrame:
    """Per user: items discovered, and those of ``kind``. ``found``: (user_id, item_idx, kind)."""
    once = found.select("user_id", "item_idx", "kind").distinct()
    return once.groupBy("user_id").agg(F.count("*").alias("items"),
                                       F.count_if(F.col("kind") == kind).alias("of_kind"))


def dimension_lookup(items: DataFrame, dimension: DataFrame, key: str,
                     columns: Sequence[str] = ("label", "color")) -> DataFrame:
    """Label and colour of each item's group or kind; a grey and no label where there is none."""
    out = legend_lookup(items, dimension.select(key, *columns), key)
    return out.withColumns({"label": F.coalesce("label", F.lit("")),
                            "color": F.coalesce("color", F.lit(S.DEFAULT_COLOR))})


def neighbor_edges(points: DataFrame, base_url: str = ITEM_URL, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per neighbour link with both ends' positions: the source's columns travel with the
    exploded list, the target's come by one look-up (popular targets are salted).

    ``points``: (i, name, x, y, nn array<long>)."""
    ends = points.select(F.col("i").alias("dst"), F.col("name").alias("dst_name"),
                         F.col("x").alias("dst_x"), F.col("y").alias("dst_y"))
    links = points.select(F.col("i").alias("src"), F.col("x").alias("src_x"), F.col("y").alias("src_y"),
                          F.posexplode("nn").alias("rank", "dst"))
    joined = salted_lookup(links, ends, "dst", "inner", hot_rows)
    return joined.select("src", (F.col("rank") + 1).alias("rank"), "dst", "src_x", "src_y",
                         space_case(F.col("dst_name")).alias("dst_name"), "dst_x", "dst_y",
                         item_url(base_url, F.col("dst_name")).alias("dst_url"))


def recipe_lookup(requests: DataFrame, recipes: DataFrame, names: DataFrame, discoveries: DataFrame,
                  hot_rows: int = HOT_ROWS) -> DataFrame:
    """Both parents of each requested item with their names, and whether the user has them.

    ``requests``: (user_id, item_idx); ``names``: (key, name) of seeds and items."""
    rows = salted_lookup(requests, recipes.select("item_idx", "a_kind", "a_idx", "b_kind", "b_idx"),
                         "item_idx", "left", hot_rows)
    user = F.col("user_id").cast("string")
    for side in ("a", "b"):
        key = F.when(F.col(f"{side}_kind").isNotNull(),
                     element_key(F.col(f"{side}_kind"), F.col(f"{side}_idx")))
        rows = rows.withColumn(f"{side}_key", key).withColumn(f"{side}_owned", F.concat(
            user, F.lit("|"), F.col(f"{side}_key")))
    rows = materialize(rows, "recipes")  # its keys are counted below
    owned = F.concat(user, F.lit("|i"), F.col("item_idx").cast("string"))
    found = discoveries.select(owned.alias("owned")).distinct()
    hot = {key: hot_keys(rows, key, hot_rows) for key in ("a_key", "b_key", "a_owned", "b_owned")}
    for side in ("a", "b"):
        name, mine = f"{side}_key", f"{side}_owned"
        rows = salted_lookup(rows, names.select(F.col("key").alias(name), F.col("name").alias(f"{side}_name")),
                             name, hot=hot[name])
        rows = salted_lookup(rows, found.select(F.col("owned").alias(mine), F.lit(True).alias("_f")),
                             mine, hot=hot[mine])
        rows = rows.withColumn(f"{side}_have", F.when(
            F.col(name).isNotNull(), (F.col(f"{side}_kind") == 0) | F.coalesce("_f", F.lit(False)))).drop("_f")
    return rows.select("user_id", "item_idx", "a_key", "a_name", "a_have", "b_key", "b_name", "b_have")


def with_max_total(points: DataFrame, column: str = "max_tot") -> DataFrame:
    return points.withColumn(column, points.agg(F.max("tot").alias("m")).scalar())


def popularity_sizes(points: DataFrame) -> DataFrame:
    sized = with_max_total(points)
    return sized.withColumns({
        "size_2d": S.popularity_size(F.col("tot"), F.col("max_tot")),
        "size_3d": S.popularity_size(F.col("tot"), F.col("max_tot"), 1.5, 3.2),
        "size_flat": F.lit(2.6)}).drop("max_tot")


def axis_metrics(points: DataFrame, clusters: int = S.PALETTE_SLOTS, groups: int = 0) -> DataFrame:
    """Every axis a view can use as a column scaled to [-1, 1] (layout axes as they are); group
    axes sg0.. from the group scores ``sa``."""
    total = F.col("nf") + F.col("nt") + F.col("nl")
    sized = with_max_total(points)
    axes: dict[str, Column] = {
        "map1": F.col("x3"), "map2": F.col("y3"), "map3": F.col("z3"),
        "film": S.share_axis(F.col("nf"), total), "tv": S.share_axis(F.col("nt"), total),
        "lit": S.share_axis(F.col("nl"), total),
        "pop": S.popularity_axis(F.col("tot"), F.col("max_tot")),
        "score": F.coalesce(F.col("g"), F.lit(0.0)),
        "cluster": S.cluster_axis(F.col("c"), clusters), "flat": F.lit(0.0)}
    for k in range(groups):
        axes[f"sg{k}"] = F.coalesce(F.element_at("sa", k + 1) * 2 - 1, F.lit(0.0))
    return sized.select("i", *[c.cast("double").alias(n) for n, c in axes.items()])


def axis_remap(metrics: DataFrame, x: str, y: str, z: str, scale: float = S.AXIS_SCALE) -> DataFrame:
    """Positions from any three metric columns; a name that is no metric falls back to the layout."""
    known = set(metrics.columns) - {"i"}
    picked = [name if name in known else f"map{at}" for at, name in enumerate((x, y, z), 1)]
    return metrics.select("i", *[(F.col(p) * scale).alias(a) for p, a in zip(picked, "xyz", strict=True)])
