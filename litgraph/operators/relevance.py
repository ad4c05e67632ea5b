"""Relevance of candidates to a profile: Rocchio in term space and in vector space.

Pools are keyed by ``pool`` (one review, one phase), so any number of them is scored in one job. Profile and query
vectors are small rows joined by pool; candidates stay distributed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..plans.physical import cut, place_within


def negatives(n: Column, cfg: Config) -> Column:
    """How many of ``n`` candidates count as negative: a share, rounded half to even, that spares the best K."""
    share = F.greatest(F.lit(1), F.bround(n * F.lit(cfg.rocchio_neg_frac)).cast("int"))
    k = max(0, cfg.expand_top_k or 0)
    spared = F.when(F.lit(k > 0) & (n - share < k), n - k).otherwise(share)
    return F.when(F.lit(cfg.rocchio_gamma <= 0) | (n < max(cfg.rocchio_min_candidates, 2)), 0).otherwise(F.greatest(F.lit(0), spared)).cast("int")


def tail(scores: DataFrame, cfg: Config) -> DataFrame:
    """(pool, id) of each pool's negatives: the worst scores, ties by ``ord``. Pools may be of any size."""
    sizes = scores.groupBy("pool").agg(F.count("*").alias("n")).select("pool", negatives(F.col("n"), cfg).alias("worst")).where("worst > 0")
    at = place_within(scores.select("pool", "id", "ord", "score").join(sizes, "pool"), "pool", [F.col("score"), F.col("ord")], "at")
    return at.where("at <= worst").select("pool", "id")


def unit_terms(weights: DataFrame) -> DataFrame:
    """(pool, term, w) scaled to length 1 per pool."""
    norm = weights.groupBy("pool").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weights.join(norm, "pool").select("pool", "term", (F.col("w") / F.when(F.col("norm") == 0, 1.0).otherwise(F.col("norm"))).alias("w"))


def term_scores(profile: DataFrame, cand: DataFrame, pool: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(pool, id, ord, score, reported). ``profile`` and ``cand`` are distinct (pool, id, term), ``pool`` lists every
    candidate as (pool, id, ord); one without terms scores 0."""
    sizes = cand.groupBy("pool", "id").agg(F.count("*").alias("n_terms"))

    def score(q: DataFrame) -> DataFrame:
        norm = q.groupBy("pool").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        hits = cand.join(q, ["pool", "term"]).groupBy("pool", "id").agg(F.sum("w").alias("dot"))
        both = pool.join(sizes, ["pool", "id"], "left").join(hits, ["pool", "id"], "left").join(norm, "pool", "left")
        length = F.coalesce(F.nullif(F.col("norm"), F.lit(0.0)), F.lit(1.0)) * F.sqrt(F.coalesce("n_terms", F.lit(1)).cast("double"))
        return both.select("pool", "id", "ord", F.round(F.coalesce("dot", F.lit(0.0)) / length, 12).alias("score"))

    q = unit_terms(profile.groupBy("pool", "term").agg(F.count("*").cast("double").alias("w")))
    scores = score(q)
    if cfg.rocchio_gamma > 0:
        scores = cut(scores)
        neg = tail(scores, cfg)
        against = unit_terms(cand.join(neg, ["pool", "id"]).groupBy("pool", "term").agg(F.count("*").cast("double").alias("w")))
        moved = q.withColumnRenamed("w", "q").join(against.withColumnRenamed("w", "m"), ["pool", "term"], "full_outer")
        scores = score(moved.select("pool", "term", (F.coalesce("q", F.lit(0.0)) - cfg.rocchio_gamma * F.coalesce("m", F.lit(0.0))).alias("w")))
    return scores.withColumn("reported", F.col("score"))


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def once(value: Column, f) -> Column:
    """``f(value)`` with ``value`` computed once, however often ``f`` names it: also within lambdas."""
    return F.transform(F.array(value), f)[0]


def unit(v: str | Column) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return once(v, lambda a: once(F.greatest(F.sqrt(dot(a, a)), F.lit(1e-9)), lambda n: F.transform(a, lambda x: x / n)))


def minus(a, b, factor: float = 1.0) -> Column:
    return F.zip_with(a, b, lambda x, y: x - factor * y)


def centroid(rows: DataFrame, vec: str, out: str, *keys: str) -> DataFrame:
    """Mean of every dimension, added up on the map side."""
    by_dim = rows.select(*keys, F.posexplode(vec).alias("dim", "x")).groupBy(*keys, "dim").agg(F.avg("x").alias("m"))
    return by_dim.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias(out))


def embed_scores(profile: DataFrame, cand: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(pool, id, ord, score, reported). ``profile`` (pool, vec), ``cand`` (pool, id, ord, vec) with vectors of doubles.

    Selection uses the raw cosines; reported are those about the pool's mean, with negatives of their own. With
    ``relevance_center`` both are about the mean. Null vectors drop out.

    Candidates are read once for the means, once for the first scores and twice for the negatives and the last; only
    means and scores are kept between, never vectors.
    """
    p = profile.where("vec IS NOT NULL").select("pool", unit("vec").alias("vec"))
    c = cand.where("vec IS NOT NULL").select("pool", "id", "ord", unit("vec").alias("vec"))
    about = unit(minus("vec", "mu"))
    mu = cut(centroid(c, "vec", "mu", "pool"))
    seeds = means(p.join(mu, "pool").select("pool", F.array("vec", about).alias("both")))
    q = cut(mu.join(seeds.select("pool", unit(F.col("m")[0]).alias("q0"), unit(F.col("m")[1]).alias("q1")), "pool"))

    def scored(q: DataFrame) -> DataFrame:
        both = c.join(q, "pool")
        return both.select("pool", "id", "ord", F.round(dot("vec", "q0"), 12).alias("raw"), F.round(dot(about, "q1"), 12).alias("centred"))

    out = scored(q)
    if cfg.rocchio_gamma > 0:
        first = cut(out)
        worst = tail(first.withColumn("score", F.col("raw")), cfg).withColumn("w0", F.lit(True)).join(tail(first.withColumn("score", F.col("centred")), cfg).withColumn("w1", F.lit(True)), ["pool", "id"], "full")
        lost = c.join(worst, ["pool", "id"]).join(mu, "pool")
        m = means(lost.select("pool", F.array(F.when(F.col("w0"), F.col("vec")), F.when(F.col("w1"), about)).alias("both")))
        moved = lambda k: F.when(F.col("m").isNull(), F.col(f"q{k}")).otherwise(unit(minus(f"q{k}", unit(F.col("m")[k]), cfg.rocchio_gamma))).alias(f"q{k}")
        out = scored(cut(q.join(m, "pool", "left").select("pool", "mu", moved(0), moved(1))))
    return out.select("pool", "id", "ord", F.col("centred" if cfg.relevance_center else "raw").alias("score"), F.col("centred").alias("reported"))


def means(rows: DataFrame) -> DataFrame:
    """(pool, m): of every vector in the array ``both``, its mean over the pool's rows; null vectors don't count."""
    parts = rows.select("pool", F.posexplode("both").alias("k", "vec")).select("pool", "k", F.posexplode("vec").alias("dim", "x"))
    by_dim = parts.groupBy("pool", "k", "dim").agg(F.avg("x").alias("x"))
    vectors = by_dim.groupBy("pool", "k").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("vec"))
    return vectors.groupBy("pool").agg(F.array(*[F.max(F.when(F.col("k") == k, F.col("vec"))) for k in (0, 1)]).alias("m"))


#: Parts that a pool is split into before its best are chosen
PARTS = 64


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each pool by selection score, in order of the reported one; all of them if ``k`` <= 0.

    The best of each part of a pool are taken first, so no task sorts a whole pool.
    """
    order = [F.desc("score"), F.col("ord")]
    if k and k > 0:
        part = F.row_number().over(Window.partitionBy("pool", F.pmod(F.xxhash64("id"), F.lit(PARTS))).orderBy(*order))
        rows = scores.withColumn("picked", part).where(F.col("picked") <= k).withColumn("picked", F.row_number().over(Window.partitionBy("pool").orderBy(*order))).where(F.col("picked") <= k)
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy("pool").orderBy(F.desc("reported"), "picked")))
    return place_within(place_within(scores, "pool", order, "picked"), "pool", [F.desc("reported"), F.col("picked")], "rank")
