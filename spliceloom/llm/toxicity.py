"""Toxicity by maximum-scoring segments of token log-odds.

Method. Each token has a log-odds ratio between toxic and clean labelled texts
under an informative Dirichlet prior (the counts of both classes together). A
token without reliable odds of its own takes those of its first five or four
letters, and else a small negative score. A linear scan finds all maximal
scoring segments of a text. By extreme-value theory the best segment of n
random tokens follows a Gumbel law: with lambda from the clean score
distribution and K from clean texts, lambda*S - ln(K*n) is a segment's evidence
in nats. The evidence of all significant segments is added up, and a logistic
curve over the logarithm of that sum gives the score, so that more evidence always
means a higher one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, materialize

TOKEN = re.compile(r"\w+")
PREFIXES = (5, 4)
EULER = 0.5772156649015329


@dataclass(frozen=True)
class Model:
    """Unit scores, as many as the bounded sample of labelled texts has reliable units, and the calibration."""

    scores: dict[str, float]
    rest: float
    lam: float = 1.0
    k: float = 1.0
    intercept: float = 0.0
    slope: float = 1.0


def units(token: str) -> list[str]:
    """The token and its prefixes (marked by a leading caret, which no token has), longest first."""
    return [token, *("^" + token[:n] for n in PREFIXES if len(token) >= n)]


def token_scores(text: str, model: Model) -> list[float]:
    scores, rest, known = model.scores, model.rest, {}
    out = []
    for token in TOKEN.findall(text.lower()):
        s = known.get(token)
        if s is None:
            s = known[token] = next((scores[u] for u in units(token) if u in scores), rest)
        out.append(s)
    return out


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, score), in linear time.

    Each candidate keeps the sum before it and the sum after it. A new candidate
    joins the latest one that starts lower, if that one ends lower than it; links
    to the latest lower start make each step constant on average.
    """
    held: list[list] = []  # start, end, sum before, sum after, index of the latest candidate that starts lower
    total = 0.0
    for i, s in enumerate(scores):
        before = total
        total += s
        if s <= 0:
            continue
        start, end, low, high = i, i + 1, before, total
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= low:
                j = held[j][4]
            if j < 0 or held[j][3] >= high:
                held.append([start, end, low, high, j])
                break
            start, low = held[j][0], held[j][2]
            del held[j:]
    return [(a, b, hi - lo) for a, b, lo, hi, _ in held]


def evidence(text: str, model: Model, least: float = 0.0) -> tuple[float, list[tuple[int, int, float]], int, float]:
    """Total evidence, significant segments (token positions), number of tokens, best segment's raw score."""
    scores = token_scores(text, model)
    segments = maximal_segments(scores)
    n = max(1, len(scores))
    base = math.log(model.k * n)
    strong = [(a, b, x) for a, b, s in segments if (x := model.lam * s - base) > least]
    return sum(x for _, _, x in strong), strong, n, max((s for _, _, s in segments), default=0.0)


def probability(x: float, model: Model) -> float:
    """Score of a text with evidence ``x``."""
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, model.intercept + model.slope * math.log1p(x)))))


def labelled(docs: DataFrame, labels: DataFrame, max_labelled: int, folds: int) -> DataFrame:
    """(text, toxic) to learn from: texts of ``max_labelled`` labelled ids at most, each text once."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(F.col("doc_id"), folds) != 0))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    # At most max_labelled rows of two numbers.
    found = docs.join(F.broadcast(sample.withColumnRenamed("doc_id", "id")), "id")
    return materialize(found.groupBy("text").agg(F.max("toxic").alias("toxic")), "toxicity-train")


def unit_counts(train: DataFrame) -> DataFrame:
    """(unit, toxic, clean): texts of either class that hold a token or prefix, however often."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = (Counter(), Counter())
            for text, toxic in zip(batch.column(0), batch.column(1)):
                tokens = set(TOKEN.findall(text.as_py().lower()))
                sides[bool(toxic.as_py())].update({u for t in tokens for u in units(t)})
            names = list(sides[0].keys() | sides[1].keys())
            clean, toxic = ([side[u] for u in names] for side in sides)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(toxic, pa.int64()), pa.array(clean, pa.int64())], ["unit", "toxic", "clean"])

    rows = train.mapInArrow(count, "unit string, toxic long, clean long")
    return rows.groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def log_odds(counts: DataFrame, totals: tuple[int, int], prior: float, z_least: float, least_count: int) -> dict[str, float]:
    """Log-odds ratios of the units whose z is ``z_least`` or more either way.

    ``totals`` are the numbers of toxic and clean texts. Counts of a class are
    smoothed by ``prior`` pseudo-texts in which a unit is as frequent as in all
    texts, and by half a text at least.
    """
    toxic, clean = totals
    share = (F.col("toxic") + F.col("clean")) / F.lit(float(max(1, toxic + clean)))
    pseudo = F.greatest(share * prior, F.lit(0.5))
    a, b = F.col("toxic") + pseudo, F.col("clean") + pseudo
    delta = F.log(a / (toxic + prior + 1 - a)) - F.log(b / (clean + prior + 1 - b))
    scored = counts.where(F.col("toxic") + F.col("clean") >= least_count).withColumn("delta", delta)
    scored = scored.withColumn("z", F.col("delta") / F.sqrt(1 / a + 1 / b)).where(F.abs("z") >= z_least)
    # The bounded sample of labelled texts bounds them.
    return {r.unit: r.delta for r in scored.select("unit", "delta").collect()}


def solve_lambda(spread: list[tuple[float, float]]) -> float:
    """The positive root of sum p*exp(lambda*s) = 1 over clean tokens' (score, probability)."""
    value = lambda x: sum(p * math.exp(min(60.0, x * s)) for s, p in spread) - 1
    high = 1.0
    while value(high) < 0 and high < 64:
        high *= 2
    low = 1e-6
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return high


def fit_logistic(points: list[tuple[float, int, int]], ridge: float = 1e-3) -> tuple[float, float]:
    """Intercept and slope over (x, clean, toxic) by Newton's method; the slope is never negative."""
    a, b = 0.0, 0.1
    n = max(1, sum(c + t for _, c, t in points))
    for _ in range(60):
        g = [-ridge * a, -ridge * b]
        h = [[ridge, 0.0], [0.0, ridge]]
        for x, clean, toxic in points:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x))))
            m, w = clean + toxic, (clean + toxic) * p * (1 - p) / n
            d = (toxic - m * p) / n
            g[0] += d
            g[1] += d * x
            h[0][0] += w
            h[0][1] += w * x
            h[1][1] += w * x * x
        det = h[0][0] * h[1][1] - h[0][1] ** 2
        if det <= 0:
            break
        da, db = (h[1][1] * g[0] - h[0][1] * g[1]) / det, (h[0][0] * g[1] - h[0][1] * g[0]) / det
        a, b = a + max(-2.0, min(2.0, da)), max(0.0, b + max(-2.0, min(2.0, db)))
    return a, b


def fit(
    train: DataFrame,
    prior: float = 10.0,
    z_least: float = 3.0,
    least_count: int = 4,
    drift: float = 0.2,
    clip: float = 6.0,
) -> Model:
    """Learn the model from (text, toxic) rows."""
    sizes = {bool(r.toxic): r.n for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    odds = log_odds(unit_counts(train), (sizes.get(True, 0), sizes.get(False, 0)), prior, z_least, least_count)
    scores = {u: max(-clip, min(clip, d)) - drift for u, d in odds.items()}
    context = train.sparkSession.sparkContext

    def histogram(model: Model, measure, parts: int = 4) -> list:
        """Counts of a measure's values in steps of 1/parts, by class: a few hundred rows, however many texts there are."""
        shared = context.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins: Counter = Counter()
                for text, toxic in zip(batch.column(0), batch.column(1)):
                    side = bool(toxic.as_py())
                    for x, n in measure(text.as_py(), shared.value):
                        bins[round(x * parts), side] += n
                keys = list(bins)
                columns = [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([bins[k] for k in keys], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["x", "toxic", "n"])

        return train.mapInArrow(run, "x long, toxic boolean, n long").groupBy("x", "toxic").agg(F.sum("n").alias("n")).collect()

    def token_measure(text: str, m: Model) -> list[tuple[float, int]]:
        return list(Counter(token_scores(text, m)).items())

    def best_measure(text: str, m: Model) -> list[tuple[float, int]]:
        _, _, n, best = evidence(text, m)
        return [(max(-25.0, m.lam * best - math.log(n)), 1)]

    def total_measure(text: str, m: Model) -> list[tuple[float, int]]:
        return [(math.log1p(evidence(text, m)[0]), 1)]

    model = Model(scores, -drift)
    spread = [(r.x / 4, r.n) for r in histogram(model, token_measure) if not r.toxic]
    tokens = max(1, sum(n for _, n in spread))
    model = replace(model, lam=solve_lambda([(s, n / tokens) for s, n in spread]))
    clean = [(r.x / 4, r.n) for r in histogram(model, best_measure) if not r.toxic]
    mean = sum(x * n for x, n in clean) / max(1, sum(n for _, n in clean))
    model = replace(model, k=math.exp(mean - EULER))
    points: dict[float, list[int]] = {}
    for r in histogram(model, total_measure, 32):
        points.setdefault(r.x / 32, [0, 0])[r.toxic] += r.n
    intercept, slope = fit_logistic([(x, c, t) for x, (c, t) in sorted(points.items())])
    return replace(model, intercept=intercept, slope=slope)


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 5,
    max_labelled: int = 200_000,
) -> DataFrame:
    """Score every whole text; learn only from labelled ids outside fold 0.

    Returns one row per input row: the id column, held_out, score, predicted,
    n_passages and passages (token positions of significant segments with their
    evidence). ``max_labelled`` bounds the sample of labelled ids to learn from.

    Null or empty texts have no evidence and get the score of that. Labels that
    are null or of unknown ids are not used; of several labels of one id the
    largest holds. Without usable labels the score is 0.5 or less for all and
    nothing is predicted toxic unless the curve says so. A null id is not held
    out. Repeated rows get equal results. No rows give no rows. Other columns are
    not read, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    model = fit(labelled(rows, labels, max_labelled, folds))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        passage = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("evidence", pa.float64())]))
        for batch in batches:
            scores, passages = [], []
            for text in batch.column(1):
                x, strong, _, _ = evidence(text.as_py(), m)
                scores.append(probability(x, m))
                passages.append([{"start": a, "end": b, "evidence": e} for a, b, e in strong])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(passages, passage)], ["id", "score", "passages"])

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(score, f"id {kind}, score double, passages array<struct<start:long,end:long,evidence:double>>")
    return out.select(
        F.col("id").alias(id_col),
        (fold(F.col("id"), folds) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
        "passages",
    )
