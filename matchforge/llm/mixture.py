"""Mixing documents to target weights of domains that overlap.

A classifier trained on a labelled table gives each document posteriors over the
domains. Nonnegative rates (how often a document is to be used) are fitted by
projected-gradient least squares, so that the expected tokens of each domain,
rate * tokens * posterior summed over all documents, come to the target share of
the budget.

The unknowns stay distributed. Of all rates that fit the targets best, those
nearest to the budget are a gradient step from it cut at the least rate:
max(least, budget * (1 - posterior . pull)) with one number a domain. So the
state of the fit is the vector `pull`. Each pass over the documents gives the
gradient at several step lengths and the Gram matrix of the documents that
aren't cut there, which scales the next step. Where the same documents stay cut
such a step ends at the optimum, so passes are few and need no cap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchforge.llm import ngrams
from matchforge.llm.common import stored

#: Domains are few by contract: their Gram matrix is solved on the driver.
MOST_DOMAINS = 64
#: What a rate's squared distance from the budget counts beside a share's from its target; the gradient at which the fit ends.
EVEN, CLOSE = 1e-6, 1e-10
#: Lengths of a step that one pass tries.
LENGTHS = 4.0 ** -np.arange(14)


def with_posteriors(docs: DataFrame, labelled: DataFrame) -> tuple[DataFrame, list[str]]:
    """`docs` with n_tokens and posterior (array<double> over the sorted domains), and the domains.

    `labelled` is (doc_id, domain); a document with several domains counts for
    each. At most ngrams.SAMPLE labelled documents train the classifier. Rows
    without id or domain are left out. With no label there is one domain, "".
    """
    known = labelled.filter("doc_id is not null and domain is not null").select("doc_id", F.col("domain").cast("string").alias("domain")).distinct()
    domains = sorted(r[0] for r in known.select("domain").distinct().limit(MOST_DOMAINS + 1).collect())
    if len(domains) > MOST_DOMAINS:
        raise ValueError(f"more than {MOST_DOMAINS} domains")
    if domains:
        each = F.explode(F.array(*map(F.lit, domains)))
        own = known.groupBy("doc_id").agg(F.collect_set("domain").alias("own"))
        marks = own.select("doc_id", "own", each.alias("class")).select("doc_id", "class", F.array_contains("own", F.col("class")).cast("double").alias("mark"))
        models = ngrams.fit(docs, marks, pairs=False)
    else:
        models = {}
    names = sorted(models) or [""]
    score = ngrams.scorer(models, pairs=False)
    scored = docs.withColumn("__scored", score(F.col("text")))
    total = F.aggregate("__scored.scores", F.lit(0.0), lambda a, b: a + b)
    posterior = F.transform("__scored.scores", lambda s: s / total)
    return scored.withColumn("n_tokens", F.col("__scored.n_words")).withColumn("posterior", posterior).drop("__scored"), names


def rates(budget: float, pull: np.ndarray, p: np.ndarray, least: float = 0.0) -> np.ndarray:
    """Rates of documents with posteriors `p`."""
    return np.maximum(least, budget * (1 - p @ pull))


def sums_at(docs: DataFrame, pulls: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums over all documents, weighed by tokens, at each of `pulls`: halved squares of the cut rates, their products with posteriors, Gram matrix of those not cut.

    Rates are multiples of the budget here, and `floor` the least. A task sends
    one row of numbers for each pull.
    """
    k = pulls.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((len(pulls), 1 + k + k * k))
        for batch in batches:
            p = batch.column("posterior").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            n = batch.column("n_tokens").to_numpy(zero_copy_only=False).astype(np.float64)
            for at, pull in zip(out, pulls, strict=True):
                rate = 1 - p @ pull
                free = rate >= floor
                cut = np.where(free, rate, floor)
                at[0] += n @ (cut * (rate - cut / 2))
                at[1 : 1 + k] += p.T @ (n * cut)
                at[1 + k :] += ((p[free] * n[free, None]).T @ p[free]).ravel()
        place = pa.array(np.arange(out.size), pa.int32())
        yield pa.RecordBatch.from_arrays([place, pa.array(out.ravel())], names=["place", "x"])

    got = docs.select("n_tokens", "posterior").mapInArrow(run, "place int, x double").groupBy("place").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(len(pulls) * (1 + k + k * k))
    for row in got:
        out[row["place"]] = row["x"]
    out = out.reshape(len(pulls), -1)
    return out[:, 0], out[:, 1 : 1 + k], out[:, 1 + k :].reshape(-1, k, k)


def kept_whole(share: np.ndarray, target: np.ndarray, budget: float, least: float) -> tuple[float, np.ndarray]:
    """The budget, raised until targets can be met with rates of `least` and more, and the shares wanted of it.

    Domains without a target are wanted as often as `least` says; the targets
    share out the rest.
    """
    other = np.where(target > 0, 0.0, share * least)
    if not target.any():
        return max(budget, least), share
    budget = max(budget, other.sum() + least * (share[target > 0] / target[target > 0]).max())
    return budget, (other + target / target.sum() * (budget - other.sum())) / budget


def fitted(docs: DataFrame, domains: list[str], targets: dict[str, float], budget: float, least: float = 0.0) -> tuple[float, np.ndarray, np.ndarray]:
    """Budget, pull and reached shares (of the budget) for documents with n_tokens and posterior.

    `targets` are weights of domains (made to sum to 1 over those that there are);
    `budget` is the wanted tokens as a multiple of all tokens. Minimised is the
    squared distance of the domains' shares from the targets, weighed by the
    inverse of their Gram matrix, and, counting `EVEN` as much, that of rates from
    the budget. It ends where the gradient vanishes or no step length makes it
    better. With `least` above zero no rate is smaller: the budget grows as
    `kept_whole` says.
    """
    k = len(domains)
    given = np.array([max(targets.get(d, 0.0), 0.0) for d in domains])
    want = given / given.sum() if given.sum() > 0 else np.full(k, 1 / k)
    _, (tokens,), (gram,) = sums_at(docs, np.zeros((1, k)), 0.0)
    total = tokens.sum()
    if total == 0:
        return max(budget, least), np.zeros(k), np.zeros(k)
    if least > 0:
        budget, want = kept_whole(tokens / total, given / (given.sum() or 1), budget, least)
    gram /= total
    # what no document can tell apart is wanted as the documents have it
    near = gram @ np.linalg.pinv(gram, rcond=1e-9, hermitian=True) @ want
    pull = np.zeros(k)

    def at(pulls: np.ndarray) -> list[tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Value, gradient, curvature, shares and pull for each of `pulls`."""
        squares, shares, free = (x / total for x in sums_at(docs, pulls, least / budget))
        return [
            (EVEN / 2 * u @ gram @ u + near @ u + a, EVEN * gram @ u + near - s, EVEN * gram + f, s, u)
            for u, a, s, f in zip(pulls, squares, shares, free, strict=True)
        ]

    now = at(pull[None])[0]
    while np.abs(now[1]).max() > CLOSE:
        step = -np.linalg.pinv(now[2], rcond=1e-13, hermitian=True) @ now[1]
        best = min(at(now[4] + LENGTHS[:, None] * step), key=lambda x: x[0])
        if not best[0] < now[0]:
            break
        now = best
    return budget, now[4], now[3]


def rate_column(budget: float, pull: np.ndarray, least: float = 0.0) -> Column:
    """The rate of a document with column posterior."""
    @F.arrow_udf("double")
    def rate(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in batches:
            yield pa.array(rates(budget, pull, part.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(pull)), least))

    return rate(F.col("posterior"))


def with_rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], budget: float = 1.0, least: float = 0.0, spare: tuple[str, ...] = ()) -> DataFrame:
    """`docs` with n_tokens, posterior (in the order of the sorted domains) and rate.

    Null and empty texts have no tokens, the posteriors of the constant, and a
    rate like any other; texts count whole; repeated rows get equal rates; an
    empty table stays empty; all other columns stay, and columns named n_tokens,
    posterior or rate are overwritten. Targets out of reach are met as nearly as
    rates of `least` and more can; with `least` above zero the budget grows until
    they are in reach, and domains without a target are wanted at that rate.
    Columns named in `spare` aren't needed after scoring and are left out.
    """
    scored, domains = with_posteriors(docs, labelled)
    scored = stored(scored.drop(*spare), "posteriors")
    budget, pull, _ = fitted(scored, domains, targets, budget, least)
    return scored.withColumn("rate", rate_column(budget, pull, least))


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], budget: float = 1.0, least: float = 0.0) -> DataFrame:
    """Rows of `docs`, each as often as its rate says: the whole part, and once more by a hash of its id with the rest as chance."""
    chance = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("mixture")), F.lit(1 << 24)) / float(1 << 24)
    times = F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("int")
    chosen = with_rates(docs, labelled, targets, budget, least).withColumn("__times", times.cast("int")).filter("__times > 0")
    return chosen.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)
