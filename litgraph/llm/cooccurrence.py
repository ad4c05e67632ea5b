"""Items that appear together: basket collapsing.

Records become sorted arrays of distinct items. Items that no result can contain are left out of the arrays first
(exact: ``together`` needs min_weight records, and w <= min(df) with w*n >= lift*df_a*df_b needs max(df)*lift <= n), which also makes far
more arrays alike. Equal arrays collapse to one basket with a weight; pairs are enumerated once per basket and their
weights added. An item of a third of all records is thereby never enumerated.

Pairs that share partners without meeting are counted over the partners. Of each item the partner with most partners
is spared: two items with ``min_shared`` common partners have at least one less in common among the rest, so a hub that
most items have is never paired out. Other partners are paired in blocks of bounded size, with counts combined before
they move; pairs that lack just one are looked up at the spared partners.

Null records and items that are empty once normalised drop out, repeated rows count once, an empty table gives an
empty result, extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.physical import cut, written
from .blocks import pairs_within
from .frequency import normal_mentions

MIN_WEIGHT, LIFT, MIN_SHARED = 4, 10, 3
#: Most items of a dictionary that is broadcast (about 100 bytes each); larger ones are joined by shuffle.
BROADCAST_ITEMS = 100_000
#: Partners of an item that are paired in one block
PARTNERS = 1024


class Baskets:
    """Records with at least two distinct items: their number ``n``, each item's ``df``, and weighted pairs."""

    def __init__(self, rows: DataFrame, min_weight: int = MIN_WEIGHT, lift: float = LIFT):
        self.min_weight, self.lift = min_weight, lift
        self.rows = written(rows.select("doc_id", "term").distinct())
        # records of one item leave: their items are taken off the counts
        sized = cut(self.rows.groupBy("doc_id").agg(F.count("*").alias("k"), F.min("term").alias("only")).groupBy((F.col("k") == 1).alias("single"), F.when(F.col("k") == 1, F.col("only")).alias("term")).agg(F.count("*").alias("records")))
        self.n = sized.where("NOT single").agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
        every = self.rows.groupBy("term").agg(F.count("*").alias("c")).unionByName(sized.where("single").select("term", (-F.col("records")).alias("c")))
        counted = every.groupBy("term").agg(F.sum("c").alias("df"))
        useful = counted.where((F.col("df") >= min_weight) & (F.col("df") * lift <= self.n))
        self.items = cut(useful.select(F.monotonically_increasing_id().alias("id"), "term", "df"))
        self.small = self.items.count() <= BROADCAST_ITEMS

    def lookup(self, *columns) -> DataFrame:
        items = self.items.select(*columns)
        return F.broadcast(items) if self.small else items

    def collapsed(self) -> DataFrame:
        """(items: sorted ids, weight: records that have just these useful items)."""
        coded = self.rows.join(self.lookup("term", "id"), "term").select("doc_id", "id")
        arrays = coded.groupBy("doc_id").agg(F.array_sort(F.collect_list("id")).alias("items"))
        return arrays.where("size(items) >= 2").groupBy("items").agg(F.count("*").alias("weight"))

    def pairs(self) -> DataFrame:
        """(a, b, w) with ids a < b for all pairs of useful items that meet."""
        first = self.collapsed().select(F.posexplode("items").alias("i", "a"), "items", "weight").where("i + 1 < size(items)")
        both = first.select("a", "weight", F.explode(F.expr("slice(items, i + 2, size(items) - i - 1)")).alias("b"))
        return both.groupBy("a", "b").agg(F.sum("weight").alias("w"))

    def together(self, pairs: DataFrame) -> DataFrame:
        """(a, b, w, df_a, df_b, term_a, term_b) of pairs met at least ``lift`` times as often as by chance."""
        often = pairs.where(F.col("w") >= self.min_weight)
        with_a = often.join(self.lookup(F.col("id").alias("a"), F.col("term").alias("term_a"), F.col("df").alias("df_a")), "a")
        with_b = with_a.join(self.lookup(F.col("id").alias("b"), F.col("term").alias("term_b"), F.col("df").alias("df_b")), "b")
        return with_b.where(F.col("w") * F.lit(self.n) >= F.lit(self.lift) * F.col("df_a") * F.col("df_b"))


def sharing(edges: DataFrame, least: int = MIN_SHARED, block: int = PARTNERS) -> DataFrame:
    """(a, b), a < b, of nodes with at least ``least`` common partners in the distinct ``edges`` (a, b), a < b.

    Where no node has more partners than a block, they are paired as they are.
    """
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("via")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("via")))
    degree = ends.groupBy("node").agg(F.count("*").alias("d"))
    if (degree.agg(F.max("d")).first()[0] or 0) <= block:
        left, right = ends.select("via", F.col("node").alias("a")), ends.select("via", F.col("node").alias("b"))
        return left.join(right, "via").where("a < b").groupBy("a", "b").agg(F.count("*").alias("k")).where(F.col("k") >= least).select("a", "b")
    sized = ends.join(degree.select(F.col("node").alias("via"), F.col("d").alias("via_d")), "via")
    spared = sized.groupBy("node").agg(F.count("*").alias("d"), F.max(F.struct("via_d", "via"))["via"].alias("hub")).where(F.col("d") >= least)
    rest = cut(ends.join(spared.select("node", "hub"), "node").where("via <> hub"))
    wedges = pairs_within(rest, ["via"], "node", block)
    swap = F.col("node_x") > F.col("node_y")
    sides = wedges.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b"), F.when(swap, F.col("hub_y")).otherwise(F.col("hub_x")).alias("hub_a"), F.when(swap, F.col("hub_x")).otherwise(F.col("hub_y")).alias("hub_b"))
    counts = cut(sides.groupBy("a", "b", "hub_a", "hub_b").agg(F.count("*").alias("k")).where(F.col("k") >= least - 1))
    lacking = counts.where(F.col("k") == least - 1).select("a", "b", F.inline(F.array(F.struct(F.col("b").alias("node"), F.col("hub_a").alias("via")), F.struct(F.col("a").alias("node"), F.col("hub_b").alias("via")))))
    # a node's own spared partner is its partner: one of the two lookups is enough
    helped = lacking.join(ends, ["node", "via"]).select("a", "b").distinct()
    return counts.where(F.col("k") >= least).select("a", "b").unionByName(helped)


def in_order(df: DataFrame, *rest) -> DataFrame:
    return df.select(F.least("term_a", "term_b").alias("term_a"), F.greatest("term_a", "term_b").alias("term_b"), *rest)


def scored_pairs(mentions: DataFrame) -> DataFrame:
    """Pairs that stand together, with counts, lift, and conviction of the rule "where a is, b is" (null if always)."""
    baskets = Baskets(normal_mentions(mentions))
    swap = F.col("term_a") > F.col("term_b")
    df_a, df_b = F.when(swap, F.col("df_b")).otherwise(F.col("df_a")), F.when(swap, F.col("df_a")).otherwise(F.col("df_b"))
    found = in_order(baskets.together(baskets.pairs()), "w", df_a.alias("df_a"), df_b.alias("df_b"))
    n = F.lit(float(baskets.n))
    return found.select(
        "*",
        F.round(F.col("w") * n / (F.col("df_a") * F.col("df_b")), 6).alias("lift"),
        F.round(F.when(F.col("w") < F.col("df_a"), (1 - F.col("df_b") / n) / (1 - F.col("w") / F.col("df_a"))), 6).alias("conviction"),
    )


def relations(mentions: DataFrame, min_shared: int = MIN_SHARED) -> DataFrame:
    """(term_a, term_b, relation): ``together``, or ``bridged`` for pairs that never meet but share partners."""
    baskets = Baskets(normal_mentions(mentions))
    pairs = written(baskets.pairs())
    edges = cut(baskets.together(pairs))
    apart = sharing(edges, min_shared).join(pairs, ["a", "b"], "left_anti")
    named = apart.join(baskets.lookup(F.col("id").alias("a"), F.col("term").alias("term_a")), "a").join(baskets.lookup(F.col("id").alias("b"), F.col("term").alias("term_b")), "b")
    return in_order(edges, F.lit("together").alias("relation")).unionByName(in_order(named, F.lit("bridged").alias("relation")))
