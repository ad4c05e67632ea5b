"""Retrieval arms against held-out reference lists: all reviews in one job.

Trials: (review, pmid, trial_role, pub_year), role ``seed`` or ``target``. Links: (citer, cited) distinct. Null keys drop
out and repeated rows count once.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..plans.physical import cut
from . import relevance, terms

PLAIN = ("backward", "forward", "both")
GATED = ("relevance", "relevance_fwd", "relevance_seeds")


def role(trials: DataFrame, which: str) -> DataFrame:
    return trials.where((F.col("trial_role") == which) & F.col("review").isNotNull() & F.col("pmid").isNotNull()).select("review", "pmid").distinct()


def linked(trials: DataFrame, links: DataFrame) -> DataFrame:
    """(review, pmid, backward, forward): what the seeds cite and what cites them, without the seeds.

    ``links`` need not be distinct. Those that touch no seed leave first, each is read once for both directions.
    """
    seeds = role(trials, "seed")
    ends = links.select(F.inline(F.array(F.struct(F.col("citer").alias("seed"), F.col("cited").alias("pmid"), F.lit(True).alias("back")), F.struct(F.col("cited").alias("seed"), F.col("citer").alias("pmid"), F.lit(False).alias("back")))))
    met = ends.join(seeds.select(F.col("pmid").alias("seed"), "review"), "seed")
    found = met.groupBy("review", "pmid").agg(F.bool_or("back").alias("backward"), F.bool_or(~F.col("back")).alias("forward"))
    return found.join(seeds, ["review", "pmid"], "left_anti")


def seed_links(trials: DataFrame, links: DataFrame, direction: str) -> DataFrame:
    """(review, pmid): what the seeds cite (``backward``), what cites them (``forward``) or ``both``, without the seeds."""
    if direction not in PLAIN:
        raise ValueError(f"unknown arm: {direction}")
    found = linked(trials, links)
    return (found if direction == "both" else found.where(direction)).select("review", "pmid")


def plain_arms(found: DataFrame) -> DataFrame:
    """(arm, review, pmid) of the three arms without a gate, from ``linked``."""
    arms = F.filter(F.array(F.when(F.col("backward"), F.lit("backward")), F.when(F.col("forward"), F.lit("forward")), F.lit("both")), lambda x: x.isNotNull())
    return found.select(F.explode(arms).alias("arm"), "review", "pmid")


def capped_profile(members: DataFrame, cap: int | None) -> DataFrame:
    """At most ``cap`` papers of each review (None or 0: all), those with the smallest MD5: a sample any engine repeats."""
    if not cap:
        return members
    drawn = F.row_number().over(Window.partitionBy("review").orderBy(F.md5(F.concat_ws(":", "review", "pmid")), "pmid"))
    return members.withColumn("drawn", drawn).where(F.col("drawn") <= cap).drop("drawn")


def title_terms(records: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(pmid, term) of the titles of citation records. Records without a title drop out."""
    docs = records.where("trim(title) <> ''").select("doc_seq", F.col("pmid").alias("doc_id"), "title", F.lit("").alias("text"))
    return terms.extract(docs, cfg).select(F.col("doc_id").alias("pmid"), "term").distinct()


def gates(trials: DataFrame, found: DataFrame, kinds, cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(profile, candidates), both (gate, review, pmid): what each gate of the arms ``kinds`` compares with what.

    ``relevance`` lets citing papers pass, profiles on them and the seeds, and gates the references; ``relevance_fwd`` the
    other way round; ``relevance_seeds`` profiles on the seeds alone and gates both, each direction for itself.
    """
    seeds = role(trials, "seed")
    back, fwd = found.where("backward").select("review", "pmid"), found.where("forward").select("review", "pmid")
    sides = {"relevance": [("bwd", fwd, back)], "relevance_fwd": [("fwd", back, fwd)], "relevance_seeds": [("seeds_bwd", None, back), ("seeds_fwd", None, fwd)]}
    profile = cand = None
    for gate, more, gated in [x for k in kinds for x in sides[k]]:
        members = seeds if more is None else seeds.unionByName(capped_profile(more, cap))
        p, c = (df.select(F.lit(gate).alias("gate"), "review", "pmid") for df in (members, gated))
        profile, cand = (p, c) if profile is None else (profile.unionByName(p), cand.unionByName(c))
    return profile, cand


def scored_pmids(trials: DataFrame, found: DataFrame, kinds=("relevance",), cap: int | None = None) -> DataFrame:
    """(pmid): every paper whose text the arms compare, so that texts can be fetched beforehand."""
    profile, cand = gates(trials, found, kinds, cap)
    return profile.select("pmid").unionByName(cand.select("pmid")).unionByName(role(trials, "seed").select("pmid")).distinct()


def gated_arms(trials: DataFrame, found: DataFrame, texts: DataFrame, arms, cfg: Config = Config(), vectors: DataFrame | None = None, cap: int | None = None) -> DataFrame:
    """(arm, review, pmid) of the arms ``kind[_centred][:gamma[:top_k]]``, for all reviews at once.

    ``found`` is ``linked``, ``texts`` (pmid, term) the terms of papers; a paper without any is in no profile and passes
    no gate. With ``vectors`` (pmid, vec) those decide, and only they know ``_centred``. One ranking serves all K.
    """
    parsed = [(a, *parse_arm(a)) for a in arms]
    if bad := [a for a, kind, *_ in parsed if kind not in GATED]:
        raise ValueError(f"not gated by relevance: {bad}")
    kinds = sorted({kind for _, kind, *_ in parsed})
    profile, cand = gates(trials, found, kinds, cap)
    pool = F.concat_ws(":", "gate", "review")
    known = (vectors if vectors is not None else texts).select("pmid").distinct()
    listed = cut(cand.join(known, "pmid", "left_semi").select(pool.alias("pool"), F.col("pmid").alias("id"), F.col("pmid").alias("ord"), "gate", "review"))
    held = texts if vectors is None else vectors
    p = cut(profile.join(held, "pmid").select(pool.alias("pool"), F.col("pmid").alias("id"), *([] if vectors is not None else ["term"]), *(["vec"] if vectors is not None else [])))
    c = cut(listed.select("pool", F.col("id").alias("pmid"), "ord").join(held, "pmid").withColumnRenamed("pmid", "id"))
    ranked = {}
    for _, _, centred, gamma, _ in parsed:
        key = (centred and vectors is not None, cfg.rocchio_gamma if gamma is None else gamma)
        if key not in ranked:
            at = replace(cfg, rocchio_gamma=key[1], relevance_center=key[0])
            scores = relevance.term_scores(p, c.select("pool", "id", "term"), listed.select("pool", "id", "ord"), at) if vectors is None else relevance.embed_scores(p.select("pool", "vec"), c, at)
            most = max(cfg.expand_top_k if k is None else k for *_, g, k in parsed if (cfg.rocchio_gamma if g is None else g) == key[1])
            least = min(cfg.expand_top_k if k is None else k for *_, g, k in parsed if (cfg.rocchio_gamma if g is None else g) == key[1])
            kept = relevance.top_k(scores, 0 if least <= 0 else most)
            ranked[key] = cut(kept.join(listed.select("pool", "id", "gate", "review"), ["pool", "id"]).select("gate", "review", F.col("id").alias("pmid"), "picked"))
    out = None
    free = {"relevance": "forward", "relevance_fwd": "backward"}
    gate_of = {"relevance": ["bwd"], "relevance_fwd": ["fwd"], "relevance_seeds": ["seeds_bwd", "seeds_fwd"]}
    for arm, kind, centred, gamma, k in parsed:
        rows = ranked[(centred and vectors is not None, cfg.rocchio_gamma if gamma is None else gamma)].where(F.col("gate").isin(gate_of[kind]))
        k = cfg.expand_top_k if k is None else k
        rows = (rows.where(F.col("picked") <= k) if k > 0 else rows).select("review", "pmid")
        if kind in free:
            rows = rows.unionByName(found.where(free[kind]).select("review", "pmid"))
        rows = rows.distinct().select(F.lit(arm).alias("arm"), "review", "pmid")
        out = rows if out is None else out.unionByName(rows)
    return out


def year_cutoff(retrieved: DataFrame, trials: DataFrame, years: DataFrame) -> DataFrame:
    """Drops what was published after the review; unknown years stay."""
    of_review = trials.groupBy("review").agg(F.max("pub_year").alias("review_year"))
    dated = retrieved.join(of_review, "review", "left").join(years.select("pmid", F.col("pub_year").alias("year")), "pmid", "left")
    return dated.where("year IS NULL OR review_year IS NULL OR year <= review_year").select(*retrieved.columns)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def precision_recall(retrieved: DataFrame, trials: DataFrame, arms=None) -> DataFrame:
    """(arm, review, n_retrieved, n_target, hits, precision, recall, f1) of ``retrieved`` (arm, review, pmid).

    Seeds count on neither side. Every arm has a row for every review, with zeros where it found nothing. ``arms``
    names the arms; else they are looked up, which runs ``retrieved`` once more.
    """
    seeds = role(trials, "seed")
    target = role(trials, "target").join(seeds, ["review", "pmid"], "left_anti")
    got = retrieved.select("arm", "review", "pmid").distinct().join(seeds, ["review", "pmid"], "left_anti")
    found = got.join(target.withColumn("hit", F.lit(1)), ["review", "pmid"], "left").groupBy("arm", "review").agg(F.count("*").alias("n_retrieved"), F.count("hit").alias("hits"))
    arms = [r["arm"] for r in retrieved.select("arm").distinct().collect()] if arms is None else list(arms)
    return rates(found, trials, arms)


def rates(found: DataFrame, trials: DataFrame, arms: list[str]) -> DataFrame:
    """``precision_recall`` from the counts (arm, review, n_retrieved, hits)."""
    target = role(trials, "target").join(role(trials, "seed"), ["review", "pmid"], "left_anti")
    wanted = role(trials, "seed").select("review").unionByName(target.select("review")).distinct().join(target.groupBy("review").agg(F.count("*").alias("n_target")), "review", "left")
    grid = wanted.withColumn("arm", F.explode(F.array(*[F.lit(a) for a in sorted(arms)]) if arms else F.array().cast("array<string>")))
    rows = grid.join(found, ["arm", "review"], "left").select("arm", "review", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_retrieved", "n_target", "hits")])
    p, r = ratio(F.col("hits"), F.col("n_retrieved")), ratio(F.col("hits"), F.col("n_target"))
    return rows.withColumn("precision", p).withColumn("recall", r).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def summarize(scored: DataFrame) -> DataFrame:
    """(arm, reviews, medians and means): the exact median, of two middle values their mean."""
    measures = ("precision", "recall", "f1", "n_retrieved")
    return scored.groupBy("arm").agg(F.count("*").alias("reviews"), *[F.median(m).alias(f"median_{m}") for m in measures], *[F.avg(m).alias(f"mean_{m}") for m in measures])


def sweep(ranked: DataFrame, ks: list[int]) -> DataFrame:
    """(arm, review, pmid) for every K of ``ks`` from one ranking (review, pmid, picked)."""
    grid = ranked.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where("picked <= k")
    return grid.select(F.concat(F.lit("top"), "k").alias("arm"), "review", "pmid")


def build_trials(records: DataFrame, n_seeds: int = 5, min_refs: int = 30, limit: int | None = None) -> DataFrame:
    """(review, pmid, trial_role, pub_year) from records with a year and ``min_refs`` distinct references or more.

    Seeds are the references with the smallest MD5 of review:pmid: a sample that any engine and partitioning
    repeats, in place of a random generator. Reviews with no more than ``n_seeds`` + 1 references are skipped.
    """
    reviews = records.where((F.size("refs") >= max(min_refs, n_seeds + 2)) & F.col("year").isNotNull())
    if limit is not None:
        reviews = reviews.orderBy("doc_seq").limit(limit)
    refs = reviews.select(F.col("pmid").alias("review"), F.col("year").cast("int").alias("pub_year"), F.explode(F.array_distinct("refs")).alias("pmid"))
    w = Window.partitionBy("review")
    drawn = F.row_number().over(w.orderBy(F.md5(F.concat_ws(":", "review", "pmid")), "pmid"))
    sized = refs.withColumn("n", F.count("*").over(w)).where((F.col("n") > n_seeds + 1) & (F.col("n") >= min_refs))
    return sized.select("review", "pmid", F.when(drawn <= n_seeds, "seed").otherwise("target").alias("trial_role"), "pub_year")


def interpret(summary: list[dict]) -> str:
    """What a summary says: which direction is the more precise, and which gamma of the arms ``relevance:gamma`` is best.

    Directions are compared by median precision, gammas by median F1 if there are two or more; the smaller of equal
    ones is named, and what it gains over gamma 0.
    """
    by = {r["arm"]: r for r in summary}
    lines = []
    if {"forward", "backward"} <= set(by) and by["forward"].get("reviews", 1):
        f, b = by["forward"], by["backward"]
        p, q = f["median_precision"], b["median_precision"]
        said = "supported" if p > q else "not supported" if p < q else "inconclusive (tied)"
        lines.append(f"forward links are more precise than backward ones: {said}; median precision {p:.4f} against {q:.4f}, median recall {f['median_recall']:.4f} against {b['median_recall']:.4f}")
    gammas = sorted((parse_arm(a)[2], a) for a in by if a.startswith("relevance:") and parse_arm(a)[2] is not None)
    if len(gammas) > 1:
        gamma, best = max(gammas, key=lambda g: (by[g[1]]["median_f1"], -g[0]))
        lines.append(f"best gamma by median F1: {gamma:g} ({by[best]['median_f1']:.4f})")
        if gamma and gammas[0][0] == 0:
            lines.append(f"the negative term changes median F1 by {by[best]['median_f1'] - by[gammas[0][1]]['median_f1']:+.4f} against gamma 0")
    return "\n".join(lines)


def summary_table(summary: list[dict]) -> str:
    """The summary as text, one line an arm."""
    wide = max([len(r["arm"]) for r in summary] + [3])
    lines = [f"{'arm':<{wide}}  {'P':>8} {'R':>8} {'F1':>8} {'papers':>8} {'reviews':>8}   (medians)"]
    lines += [f"{r['arm']:<{wide}}  {r['median_precision']:8.4f} {r['median_recall']:8.4f} {r['median_f1']:8.4f} {r['median_n_retrieved']:8.0f} {r['reviews']:8d}" for r in summary]
    return "\n".join(lines)


def parse_arm(arm: str) -> tuple[str, bool, float | None, int | None]:
    """``kind[_centred][:gamma[:top_k]]`` as (kind, centred, gamma, top_k)."""
    kind, *rest = arm.split(":")
    centred = kind.endswith("_centred")
    kind = kind.removesuffix("_centred")
    if kind not in ("forward", "backward", "both", "relevance", "relevance_fwd", "relevance_seeds"):
        raise ValueError(f"unknown arm: {arm}")
    return kind, centred, float(rest[0]) if rest and rest[0] else None, int(rest[1]) if len(rest) > 1 else None
