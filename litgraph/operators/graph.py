"""Graph operators over edge tables: symmetric closure, degree, induced subgraph, k-core, breadth-first search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.physical import cut


def symmetric(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    rest = [c for c in edges.columns if c not in (a, b)]
    return edges.select(a, b, *rest).unionByName(edges.select(F.col(b).alias(a), F.col(a).alias(b), *rest))


def degree(edges: DataFrame, src: str = "citer", dst: str = "cited") -> DataFrame:
    """(node, degree): edges in plus edges out; a mutual pair counts twice for both."""
    ends = edges.select(F.explode(F.array(src, dst)).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def induced(edges: DataFrame, nodes: DataFrame, src: str = "citer", dst: str = "cited", key: str = "node", small: bool = False) -> DataFrame:
    """Edges with both ends among ``nodes``. ``small``: the node table is bounded by a limit and may be broadcast."""
    keys = nodes.select(F.col(key).alias("__key"))
    keys = F.broadcast(keys) if small else keys
    out = edges
    for end in (src, dst):
        out = out.join(keys, F.col(end) == F.col("__key"), "left_semi")
    return out


def k_core(nodes: DataFrame, edges: DataFrame, k: int, src: str = "citer", dst: str = "cited", key: str = "node") -> tuple[DataFrame, DataFrame, int]:
    """(nodes, edges, rounds): nodes of total degree below ``k`` leave until none does.

    Every round is a group-by and two semi-joins over the edges that are left, cut off from the rounds before.
    k <= 0 changes nothing and takes no round.
    """
    if k <= 0:
        return nodes, edges, 0
    left = cut(nodes.select(F.col(key).alias("__node")).distinct())
    size, rounds = left.count(), 0
    alive = edges
    while True:
        strong = cut(left.join(degree(alive, src, dst).where(F.col("degree") >= k), F.col("__node") == F.col("node"), "left_semi"))
        now = strong.count()
        if now == size:
            break
        rounds += 1
        left, size = strong, now
        alive = cut(induced(alive, left, src, dst, "__node"))
    return nodes.join(left, nodes[key] == left["__node"], "left_semi"), alive, rounds


def first_wins(df: DataFrame, key: str, *order) -> DataFrame:
    """One row per key: the first by ``order``."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("__n", first).where("__n = 1").drop("__n")


#: Keys that come more than once, up to which they are broadcast (about 30 bytes each)
BROADCAST_KEYS = 500_000


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the last by ``order``. Only keys that come more than once are grouped, as long as they can be
    broadcast; null keys drop out."""
    rows = df.where(F.col(key).isNotNull())
    again = cut(rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key))
    n = again.count()
    if not n:
        return rows
    if n > BROADCAST_KEYS:
        return first_wins(rows, key, F.desc(order))
    some = first_wins(rows.join(F.broadcast(again), key, "left_semi"), key, F.desc(order))
    return rows.join(F.broadcast(again), key, "left_anti").unionByName(some)


def bfs(seeds: DataFrame, links: DataFrame | Callable[[DataFrame], DataFrame], rounds: int, max_records: int | None = None) -> DataFrame:
    """(id, round, ord): ids reached from ``seeds`` (id, ord) over ``links`` (id, other[, pos]).

    ``max_records`` keeps a prefix of the order of discovery: by round, then the order of the parent, then ``pos`` of
    the link, then the id. ``links`` may be a function from (id) to links, asked once a round for the new ids. Only that prefix is numbered; without a cap nothing is, and ``ord`` stays null after the
    seeds. Null and blank ids are not followed; no new id ends the search.
    """
    firsts = seeds.where("id IS NOT NULL AND trim(id) <> ''").groupBy("id").agg(F.min("ord").cast("bigint").alias("ord"))
    seen = firsts.withColumn("round", F.lit(0))
    if max_records is not None:
        seen = numbered(seen, 0, max_records, "ord", "id")
    seen = frontier = cut(seen)
    total = seen.count()

    def steps_of(links: DataFrame) -> DataFrame:
        return links.where("other IS NOT NULL").select(F.col("id").alias("src"), F.trim("other").alias("other"), F.col("pos") if "pos" in links.columns else F.lit(0).alias("pos")).where("other <> ''")

    for r in range(1, max(0, rounds) + 1):
        if max_records is not None and total >= max_records:
            break
        steps = steps_of(links(frontier.select("id")) if callable(links) else links)
        if max_records is None:
            fresh = steps.join(frontier.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("other").alias("id"), F.lit(None).cast("bigint").alias("ord")).distinct()
        else:
            reached = steps.join(frontier.select(F.col("id").alias("src"), F.col("ord").alias("parent")), "src")
            fresh = reached.groupBy(F.col("other").alias("id")).agg(F.min(F.struct("parent", "pos")).alias("ord"))
        new = fresh.join(seen.select("id"), "id", "left_anti").withColumn("round", F.lit(r))
        if max_records is not None:
            new = numbered(new, total, max_records - total, "ord", "id")
        new = cut(new)
        n = new.count()
        if not n:
            break
        total += n
        frontier = new
        seen = cut(seen.unionByName(new))
    return seen.select("id", "round", "ord")


def numbered(rows: DataFrame, start: int, limit: int, *order: str) -> DataFrame:
    """The first ``limit`` rows by ``order``, with ``ord`` counting on from ``start``. The sort is a distributed top-k."""
    top = rows.orderBy(*order).limit(limit)
    return top.withColumn("ord", F.row_number().over(Window.orderBy(*order)).cast("bigint") + start)
