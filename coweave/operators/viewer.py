"""The interactive query layer: filter, aggregate and roll up events, and drill down."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .edges import items_of


@dataclass(frozen=True)
class ViewerQuery:
    """What a viewer of the network may set; once: see ``items_of``."""

    layer: str = "all"
    year_from: int = 0
    year_to: int = 9999
    external: bool = True
    unknown: bool = False
    peers: bool = True
    scope: str = "all"
    min_items: int = 1
    node: str | None = None
    institution: int | None = None
    country: int | None = None
    once: bool = False

    def visible(self, nodes: DataFrame) -> DataFrame:
        """Roster members; externals if shown, those of unknown place if those are."""
        ext = F.lit(self.external) & (F.lit(self.unknown) | ~F.col("unknown_place"))
        return nodes.filter((F.col("node_type") == "roster") | ext)

    def events(self, events: DataFrame, nodes: DataFrame) -> DataFrame:
        e = events.filter(F.col("year").between(min(self.year_from, self.year_to), max(self.year_from, self.year_to)))
        if self.layer != "all":
            e = e.filter(F.col("layer") == self.layer)
        n = self.visible(nodes).select("node_id", (F.col("node_type") != "roster").alias("ext"), F.col("institution").alias("inst"), F.col("country").alias("cty"))
        e = e.join(n.toDF("u", "u_ext", "u_inst", "u_cty"), "u").join(n.toDF("v", "v_ext", "v_inst", "v_cty"), "v")
        if not self.peers and self.node is None:
            e = e.filter(~(F.col("u_ext") & F.col("v_ext")))
        if self.node is not None:
            e = e.filter((F.col("u") == self.node) | (F.col("v") == self.node))
        elif self.institution is not None:
            a, b = (F.col(c).eqNullSafe(F.lit(self.institution)) for c in ("u_inst", "v_inst"))
            e = e.filter(a & b if self.scope == "within" else a | b)
        elif self.country is not None:
            e = e.filter((F.col("u_cty") == self.country) | (F.col("v_cty") == self.country))
        same = F.coalesce(F.col("u_inst") == F.col("v_inst"), F.lit(False)) & ~F.col("u_ext") & ~F.col("v_ext")
        if self.scope != "all":
            e = e.filter(same if self.scope == "within" else ~same)
        return e

    def pairs(self, events: DataFrame, nodes: DataFrame) -> DataFrame:
        p = self.events(events, nodes).groupBy("u", "v", "layer").agg(F.sum("weight_1n").alias("weight"), items_of("item", self.once).alias("items"))
        return p.filter(F.col("items") >= self.min_items)

    def shown_nodes(self, events: DataFrame, nodes: DataFrame) -> DataFrame:
        p = self.pairs(events, nodes)
        seen = p.select(F.col("u").alias("node_id")).union(p.select("v"))
        if self.node is not None:
            seen = seen.union(self.visible(nodes).filter(F.col("node_id") == self.node).select("node_id"))
        elif self.institution is not None:
            seen = seen.union(self.visible(nodes).filter((F.col("node_type") == "roster") & (F.col("institution") == self.institution)).select("node_id"))
        return seen.distinct()

    def group_key(self, nodes: DataFrame) -> DataFrame:
        """node_id, key: the node itself if selected, P; an external's place, B; a member's institution, I; else the node."""
        key = F.when(F.col("node_id") == F.lit(self.node), F.concat(F.lit("P"), "node_id")).when(F.col("node_type") != "roster", F.concat(F.lit("B"), F.when(F.col("unknown_place"), "?").otherwise(F.col("country").cast("string")))).when(F.col("institution").isNotNull(), F.concat(F.lit("I"), F.col("institution").cast("string"))).otherwise(F.concat(F.lit("P"), "node_id"))
        return nodes.select("node_id", key.alias("key"))

    def group_edges(self, events: DataFrame, nodes: DataFrame) -> DataFrame:
        """a, b, layer, weight, items, pairs between different groups."""
        k = self.group_key(nodes)
        p = self.pairs(events, nodes).join(k.toDF("u", "ku"), "u").join(k.toDF("v", "kv"), "v").filter("ku <> kv")
        return p.groupBy(F.least("ku", "kv").alias("a"), F.greatest("ku", "kv").alias("b"), "layer").agg(F.sum("weight").alias("weight"), F.sum("items").alias("items"), F.count(F.lit(1)).alias("pairs"))

    def group_sizes(self, events: DataFrame, nodes: DataFrame) -> DataFrame:
        return self.shown_nodes(events, nodes).join(self.group_key(nodes), "node_id").groupBy("key").agg(F.count(F.lit(1)).alias("n"))

    def group_items(self, events: DataFrame, nodes: DataFrame, a: str, b: str) -> DataFrame:
        """Distinct items behind one group edge."""
        k = self.group_key(nodes)
        p = self.pairs(events, nodes).join(k.toDF("u", "ku"), "u").join(k.toDF("v", "kv"), "v").filter((F.least("ku", "kv") == a) & (F.greatest("ku", "kv") == b)).select("u", "v", "layer")
        return self.events(events, nodes).join(p, ["u", "v", "layer"], "left_semi").select("layer", "item").distinct()


def profile(items: DataFrame, node: str, most: int) -> DataFrame:
    """A person's items, newest first. items: node_id, item, year."""
    return items.filter(F.col("node_id") == node).orderBy(F.desc("year"), "item").limit(most)


def place_panel(nodes: DataFrame, shown: DataFrame) -> DataFrame:
    """country, members, shown members, and the first three names in use."""
    n = nodes.join(shown.select("node_id", F.lit(1).alias("s")), "node_id", "left")
    names = F.row_number().over(Window.partitionBy("country").orderBy("name"))
    n = n.withColumn("_r", names)
    return n.groupBy("country").agg(F.count(F.lit(1)).alias("members"), F.count("s").alias("shown"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("_r") <= 3, F.col("name")))), ",").alias("names"))


def folded(zoomed: bool, selected: str | None, late: tuple[str, ...], keep: dict[str, tuple[str, ...]]):
    """Whether a bubble (code, county, org) is folded away at full view."""
    if zoomed:
        return F.lit(False)
    crowded = F.lit(False)
    for county, kept in keep.items():
        crowded = crowded | ((F.col("county") == county) & ~F.coalesce(F.col("code"), F.lit("")).isin(*kept))
    hidden = F.coalesce(F.col("code"), F.lit("")).isin(*late) | crowded
    return F.when((F.col("county") == F.lit(selected)) | (F.col("org") == "third"), False).otherwise(hidden)
