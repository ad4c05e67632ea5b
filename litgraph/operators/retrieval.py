"""Retrieval arms of all reviews from the neighbourhoods of their seeds.

A paper that many reviews have as a seed and many papers cite gives reviews times citing papers rows (review, pmid). So
only neighbourhoods move, each once to every task that has reviews of it, and a task puts the papers of one review
together at a time: what moves grows with the links, not with what the reviews find. A task holds the neighbourhoods of
its reviews. Trials and links are those of ``evaluate``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..plans.physical import cores, written
from . import evaluate
from .terms import BROADCAST_IDS

BACK, FWD = 1, 2
#: Sides of rows that are no neighbours
SEED, TARGET = 4, 5
#: Neighbours that a task gets about, besides those of large seeds
PER_TASK = 200_000
#: Reviews of one largest seed that stay in one task
TOGETHER = 16


def near_by(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_IDS else df


def neighbours(trials: DataFrame, links: DataFrame) -> DataFrame:
    """(seed, pmid, side): what a seed cites (1), what cites it (2) or both (3), and the seed itself (0)."""
    seeds = evaluate.role(trials, "seed").select(F.col("pmid").alias("seed")).distinct()
    ends = links.select(F.inline(F.array(*[F.struct(F.col(a).alias("seed"), F.col(b).alias("pmid"), F.lit(s).cast("tinyint").alias("side")) for a, b, s in (("citer", "cited", BACK), ("cited", "citer", FWD))])))
    met = ends.where("pmid IS NOT NULL AND pmid <> seed").join(near_by(seeds, seeds.count()), "seed", "left_semi")
    return met.groupBy("seed", "pmid").agg(F.bit_or("side").alias("side")).unionByName(seeds.select("seed", F.col("seed").alias("pmid"), F.lit(0).cast("tinyint").alias("side")))


def numbered_terms(texts: DataFrame) -> DataFrame:
    """(pmid, terms): numbers of the terms of ``texts`` (pmid, term)."""
    numbers = written(texts.select("term").distinct().withColumn("number", F.monotonically_increasing_id()))
    return texts.join(numbers, "term").groupBy("pmid").agg(F.collect_set("number").alias("terms"))


def portions(trials: DataFrame, links: DataFrame, years: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """(task, key, pmid, side, year, terms), partitioned by task: neighbours by seed, and seeds and targets by review.

    Reviews go by their largest seed, those of one to as many tasks as twice the cores. ``years`` is (pmid, pub_year), one
    row per pmid; ``texts`` (pmid, term), distinct.
    """
    near = neighbours(trials, links).join(years.select("pmid", F.col("pub_year").cast("int").alias("year")), "pmid", "left")
    none = F.lit(None).cast("array<bigint>")
    near = written(near.withColumn("terms", none) if texts is None else near.join(numbered_terms(texts), "pmid", "left"))
    sizes = near.groupBy("seed").agg(F.count("*").alias("n"))
    seeds = evaluate.role(trials, "seed")
    largest = seeds.withColumnRenamed("pmid", "seed").join(sizes, "seed").groupBy("review").agg(F.max(F.struct("n", "seed"))["seed"].alias("largest"))
    wide = 2 * cores(trials.sparkSession)
    n_tasks = max(wide, near.count() // PER_TASK)
    by = Window.partitionBy("largest")
    together = F.greatest(F.lit(TOGETHER), F.ceil(F.count("*").over(by) / wide))
    part = F.floor((F.row_number().over(by.orderBy("review")) - 1) / together)
    at = written(largest.select("review", F.pmod(F.xxhash64("largest", part), F.lit(n_tasks)).cast("int").alias("task")))
    n_reviews = at.count()
    wanted = written(seeds.withColumnRenamed("pmid", "seed").join(near_by(at, n_reviews), "review").select("seed", "task").distinct())
    rows = near.join(near_by(wanted, wanted.count()), "seed").select("task", F.col("seed").alias("key"), "pmid", "side", "year", "terms")
    of_review = trials.groupBy("review").agg(F.max("pub_year").cast("int").alias("year"))
    sides = seeds.withColumn("side", F.lit(SEED)).unionByName(evaluate.role(trials, "target").withColumn("side", F.lit(TARGET)))
    tried = sides.join(near_by(at, n_reviews), "review").join(of_review, "review")
    tried = tried.select("task", F.col("review").alias("key"), "pmid", F.col("side").cast("tinyint").alias("side"), "year", none.alias("terms"))
    return rows.unionByName(tried).repartitionById(n_tasks, "task")


def coded(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Places of the values among the distinct ones in order, and these."""
    d = pa.concat_arrays(column.chunks).dictionary_encode()
    order = pc.sort_indices(d.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place[d.indices.to_numpy()], d.dictionary.take(pa.array(order))


def first_of(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` smallest scores in order, the earlier of equal ones first."""
    if k >= len(scores):
        return np.argsort(scores, kind="stable")
    most = np.partition(scores, k - 1)[k - 1]
    less, same = np.flatnonzero(scores < most), np.flatnonzero(scores == most)
    some = np.concatenate([less, same[: k - len(less)]])
    return some[np.lexsort((some, scores[some]))]


def n_negatives(n: int, cfg: Config) -> int:
    """As ``relevance.negatives``, for a gamma above 0."""
    share, k = max(1, round(n * cfg.rocchio_neg_frac)), max(0, cfg.expand_top_k or 0)
    return 0 if n < max(cfg.rocchio_min_candidates, 2) else max(0, n - k if k and n - share < k else share)


class Portion:
    """The rows of one task. Papers and terms are numbered within it, papers in the order of their pmids."""

    def __init__(self, rows: pa.Table):
        side = rows["side"].to_numpy()
        paper, self.pmids = coded(rows["pmid"])
        key, self.keys = coded(rows["key"])
        year = rows["year"].cast(pa.float64()).to_numpy()
        near = np.flatnonzero(side < SEED)
        near = near[np.argsort(key[near], kind="stable")]
        self.paper, self.side = paper[near], side[near].astype(np.uint8)
        self.years = np.full(len(self.pmids), np.nan)
        self.years[self.paper] = year[near]
        own = near[self.side == 0]
        self.span = dict(zip(paper[own].tolist(), zip(np.searchsorted(key[near], key[own]).tolist(), np.searchsorted(key[near], key[own], "right").tolist(), strict=True), strict=True))
        lists = pa.concat_arrays(rows["terms"].chunks)
        lens = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        self.vocabulary, self.terms = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        at = np.full(len(self.pmids), -1)
        at[self.paper] = near
        self.starts, self.lens = np.where(at < 0, 0, (np.cumsum(lens) - lens)[at]), np.where(at < 0, 0, lens[at])
        tried = np.flatnonzero(side >= SEED)
        tried = tried[np.argsort(key[tried], kind="stable")]
        cuts = np.flatnonzero(np.diff(key[tried], prepend=-1))
        self.reviews = [(self.keys[key[x[0]]].as_py(), year[x[0]], paper[x[side[x] == SEED]], paper[x[side[x] == TARGET]]) for x in np.split(tried, cuts[1:]) if len(x)]

    def of(self, papers: np.ndarray) -> np.ndarray:
        """Terms of the papers, one paper after the other."""
        n = self.lens[papers]
        return self.terms[np.repeat(self.starts[papers] - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    def sides(self, seeds: np.ndarray) -> np.ndarray:
        """Side of every paper to a review with these seeds."""
        out = np.zeros(len(self.pmids), np.uint8)
        for s in seeds.tolist():
            a, b = self.span[s]
            out[self.paper[a:b]] |= self.side[a:b]
        out[seeds] = 0
        return out

    def in_time(self, papers: np.ndarray, year: float) -> np.ndarray:
        """The papers without those published after the review; unknown years stay."""
        return papers if np.isnan(year) else papers[~(self.years[papers] > year)]


def length(w: np.ndarray) -> float:
    return float(np.sqrt(np.dot(w, w))) or 1.0


class Gates:
    """What passes the gates of one review: ``relevance.term_scores`` and ``top_k`` over its papers."""

    def __init__(self, portion: Portion, seeds: np.ndarray, back: np.ndarray, fwd: np.ndarray, cfg: Config):
        self.portion, self.cfg, self.seeds = portion, cfg, seeds
        self.papers = {BACK: back[portion.lens[back] > 0], FWD: fwd[portion.lens[fwd] > 0]}
        self.words, self.first, self.ranked = {}, {}, {}

    def terms(self, side: int) -> np.ndarray:
        if side not in self.words:
            self.words[side] = self.portion.of(self.papers[side])
        return self.words[side]

    def counts(self, terms: np.ndarray) -> np.ndarray:
        return np.bincount(terms, minlength=len(self.portion.vocabulary)).astype(np.float64)

    def scores(self, side: int, w: np.ndarray) -> np.ndarray:
        n = self.portion.lens[self.papers[side]]
        return np.round(np.add.reduceat(w[self.terms(side)], np.cumsum(n) - n) / (length(w) * np.sqrt(n)), 12)

    def passed(self, side: int, more: int, gamma: float, most: int) -> np.ndarray:
        """Papers of ``side`` in the order of their scores, the best ``most`` (all: 0). The profile has the seeds, and the papers of side ``more``."""
        cand = self.papers[side]
        if not len(cand):
            return cand
        if (side, more) not in self.first:
            profile = self.counts(self.portion.of(self.seeds))
            if more:
                profile += self.counts(self.terms(more))
            self.first[side, more] = profile / length(profile), self.scores(side, profile)
        if (side, more, gamma) not in self.ranked:
            q, scores = self.first[side, more]
            if gamma > 0:
                n = n_negatives(len(cand), self.cfg)
                against = self.counts(self.portion.of(cand[first_of(scores, n)])) if n else np.zeros(len(q))
                scores = self.scores(side, q - gamma * (against / length(against)))
            self.ranked[side, more, gamma] = cand[first_of(-scores, most or len(cand))]
        return self.ranked[side, more, gamma]


def chosen(portion: Portion, arms: list[tuple], cfg: Config) -> Iterator[tuple]:
    """(arm, review, papers, targets) of every review, without what was published after it."""
    ks = [cfg.expand_top_k if k is None else k for _, kind, _, _, k in arms if kind in evaluate.GATED]
    most = max(ks) if ks and min(ks) > 0 else 0
    for review, year, seeds, targets in portion.reviews:
        if not len(seeds):
            continue
        side = portion.sides(seeds)
        found = np.flatnonzero(side)
        back, fwd = found[side[found] & BACK > 0], found[side[found] & FWD > 0]
        plain = {"backward": back, "forward": fwd, "both": found}
        targets = np.setdiff1d(targets, seeds)
        gates = Gates(portion, seeds, back, fwd, cfg)
        for arm, kind, _, gamma, k in arms:
            papers = plain.get(kind)
            if papers is None:
                gamma, k = cfg.rocchio_gamma if gamma is None else gamma, cfg.expand_top_k if k is None else k
                steps, free = {"relevance": ([(BACK, FWD)], fwd), "relevance_fwd": ([(FWD, BACK)], back), "relevance_seeds": ([(BACK, 0), (FWD, 0)], None)}[kind]
                through = [p[:k] if k > 0 else p for p in (gates.passed(a, b, gamma, most) for a, b in steps)]
                mark = np.zeros(len(side), bool)
                for p in through + ([] if free is None else [free]):
                    mark[p] = True
                papers = np.flatnonzero(mark)
            yield arm, review, portion.in_time(papers, year), targets


#: Rows of a batch that a task hands on
BATCH = 100_000


def retrieved(portions: DataFrame, arms=evaluate.PLAIN, cfg: Config = Config()) -> DataFrame:
    """(arm, review, pmid) of ``portions``, without what was published after the review. Gated arms go by terms."""
    arms = [(a, *evaluate.parse_arm(a)) for a in arms]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := [b for b in batches if b.num_rows]:
            portion = Portion(pa.Table.from_batches(held))
            for arm, review, papers, _ in chosen(portion, arms, cfg):
                for at in range(0, len(papers), BATCH):
                    pmids = portion.pmids.take(pa.array(papers[at : at + BATCH]))
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(arm), len(pmids)), pa.repeat(pa.scalar(review), len(pmids)), pmids], names=["arm", "review", "pmid"])

    return portions.mapInArrow(run, "arm string, review string, pmid string")


def counted(portions: DataFrame, arms=evaluate.PLAIN, cfg: Config = Config()) -> DataFrame:
    """(arm, review, n_retrieved, hits): of ``retrieved`` and of the targets in it, for ``evaluate.rates``."""
    arms = [(a, *evaluate.parse_arm(a)) for a in arms]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := [b for b in batches if b.num_rows]:
            rows = [(arm, review, len(papers), int(np.isin(targets, papers).sum())) for arm, review, papers, targets in chosen(Portion(pa.Table.from_batches(held)), arms, cfg)]
            names, reviews, n, hits = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(reviews, pa.string()), pa.array(n, pa.int64()), pa.array(hits, pa.int64())], names=["arm", "review", "n_retrieved", "hits"])

    return portions.mapInArrow(run, "arm string, review string, n_retrieved bigint, hits bigint")
