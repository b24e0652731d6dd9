"""Robust fitting of plane-to-plane transforms to matched points, as a plan.

Minimal samples are drawn by hash, each gives a transform in closed form, and
all samples of a pair are judged at once by how many matches they explain and
how closely. A pair's matches are some hundred points; samples carry nine numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchforge.sources.shared import stored

#: Matches that a fit needs, samples of a pair, and the farthest an explained match may be from its place.
LEAST, SAMPLES, REACH = 8, 64, 5.0
#: Share of the squared reach that rounding may add, and the parts in which a match's gain is counted.
ROUNDING, PARTS = 1e-6, 1e12
H = [f"h{i}" for i in range(9)]


def _turn(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Twice the signed areas of triangles; 0 for points on a line."""
    return a[:, 0] * (b[:, 1] - c[:, 1]) + b[:, 0] * (c[:, 1] - a[:, 1]) + c[:, 0] * (a[:, 1] - b[:, 1])


def _basis(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matrices that take the unit vectors and their sum to four points (n, 4, 2) each, up to scale, and the points' least triangle."""
    p = [points[:, k] for k in range(4)]
    sides = np.stack([_turn(p[3], p[1], p[2]), _turn(p[0], p[3], p[2]), _turn(p[0], p[1], p[3])], axis=1)
    whole = np.concatenate([points[:, :3], np.ones((len(points), 3, 1))], axis=2)
    return (whole * sides[:, :, None]).transpose(0, 2, 1), np.abs(np.c_[sides, _turn(p[0], p[1], p[2])]).min(axis=1)


def projected(x: Column, y: Column) -> tuple[Column, Column]:
    """Where the transform in columns h0 to h8 puts a point."""
    h = [F.col(c) for c in H]
    w = h[6] * x + h[7] * y + h[8]
    return F.try_divide(h[0] * x + h[1] * y + h[2], w), F.try_divide(h[3] * x + h[4] * y + h[5], w)


def transforms(samples: DataFrame, *keys: str) -> DataFrame:
    """(keys, h0 … h8): the transform of each sample (x0 … x3, y0 … y3 to u0 … u3, v0 … v3), up to scale; those with three points on a line are left out.

    Both quadrilaterals are images of one basis, so the transform is the second
    basis times the adjugate of the first. Samples are worked out in batches; as
    columns the same products would stand in the plan thousands of times.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            src, dst = (np.stack([frame[[f"{c}{k}" for c in pair]].to_numpy(float) for k in range(4)], axis=1) for pair in ("xy", "uv"))
            (a, a_least), (b, b_least) = _basis(src), _basis(dst)
            fine = (a_least > 1e-6) & (b_least > 1e-6)
            a, b = a[fine], b[fine]
            adjugate = np.stack([np.cross(a[:, (k + 1) % 3], a[:, (k + 2) % 3]) for k in range(3)], axis=2)
            h = (b @ adjugate).reshape(-1, 9)
            yield pd.concat([frame.loc[fine, list(keys)].reset_index(drop=True), pd.DataFrame(h / np.abs(h).max(axis=1, keepdims=True), columns=H)], axis=1)

    kept = "".join(f"{k} {samples.schema[k].dataType.simpleString()}, " for k in keys)
    return samples.mapInPandas(run, kept + ", ".join(f"{c} double" for c in H))


def drawn(matches: DataFrame, samples: int) -> DataFrame:
    """(pair_id, sample, x0 … v3): four matches for each sample, by hash of the sample; repeated ones make it degenerate."""
    place = Window.partitionBy("pair_id").orderBy("match_id", "x", "y", "u", "v")
    numbered = matches.withColumn("at", F.row_number().over(place))
    sizes = numbered.groupBy("pair_id").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST)
    picks = sizes.select("pair_id", "n", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample")).select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("slot"))
    picks = picks.withColumn("at", (F.pmod(F.xxhash64("pair_id", "sample", "slot"), F.col("n")) + 1).cast("int"))
    met = picks.join(numbered, ["pair_id", "at"])
    return met.groupBy("pair_id", "sample").agg(*(F.max(F.when(F.col("slot") == k, F.col(c))).alias(f"{c}{k}") for k in range(4) for c in ("x", "y", "u", "v")))


def explained(matches: DataFrame, samples: int = SAMPLES, reach: float = REACH) -> DataFrame:
    """`matches` (pair_id, match_id, x, y, u, v) with inlier: does the pair's best transform put (x, y) within `reach` of (u, v)?

    A match at distance d gains (1 - d / reach)²: what squared distances leave of
    a squared reach, on the mean of all reaches up to `reach`. The best transform
    gains most, the first sample of equal ones; mere numbers of matches would
    prefer one that is bent towards a wrong match nearby. Gains are whole parts,
    so their sums don't depend on the rows' order. Matches on the edge of the
    reach count as explained.
    Pairs with fewer than eight matches, or whose samples all lie on lines, have
    no inlier.
    """
    fits = stored(transforms(drawn(matches, samples), "pair_id", "sample"), "fits")
    px, py = projected(F.col("x"), F.col("y"))
    off = (px - F.col("u")) ** 2 + (py - F.col("v")) ** 2
    gain = F.floor((1 - F.sqrt(off) / reach) ** 2 * PARTS)
    gains = matches.join(fits, "pair_id").filter(off <= reach * reach).groupBy("pair_id", "sample").agg(F.sum(gain).alias("gain"))
    best = gains.groupBy("pair_id").agg(F.max_by("sample", F.struct("gain", -F.col("sample"))).alias("sample"))
    chosen = fits.join(best, ["pair_id", "sample"])
    return matches.join(chosen, "pair_id", "left").withColumn("inlier", F.coalesce(off <= reach * reach * (1 + ROUNDING), F.lit(False))).select(*matches.columns, "inlier")


def fit_report(matches: DataFrame) -> DataFrame:
    """(pair_id, matches, inliers) of each pair."""
    return explained(matches).groupBy("pair_id").agg(F.count("*").alias("matches"), F.count_if("inlier").alias("inliers"))
