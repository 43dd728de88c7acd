"""Queries that register images and volumes and measure what differs: a NumPy kernel once for each frame or pair.

A task holds one frame with its reference (or one recording, for the scan); the relational part makes both."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import kernels as K
from ..operators import registration as R
from ..operators import structure as S
from . import inputs as I
from .registry import register

EMPTY = 25.0  # value of cells without rows, the middle of the quantities


def image(x, y, v, shape: tuple[int, ...] = (40, 25), fill: float = EMPTY) -> np.ndarray:
    """Cells as an array; at least of the given shape, larger where cells lie beyond."""
    x, y = np.asarray(x, int), np.asarray(y, int)
    out = np.full((max(shape[0], int(x.max(initial=-1)) + 1), max(shape[1], int(y.max(initial=-1)) + 1)), fill)
    out[x, y] = v
    return out


def block(x, y, z, v, shape: tuple[int, ...] = (40, 25, 7), fill: float = EMPTY) -> np.ndarray:
    out = np.full(shape, fill)
    out[np.asarray(x, int), np.asarray(y, int), np.asarray(z, int)] = v
    return out


def smoothed(x, y, v) -> np.ndarray:
    return R.mean_box(image(x, y, v), (1, 1))


def against_year(spark, sf_dir):
    """(t, x, y, dx, r): each month's cells with those of the mean over its year."""
    f = I.field(spark, sf_dir).select("t", F.floor(F.col("t") / 12).alias("year"), "x", "y", "dx")
    ref = f.groupBy("year", "x", "y").agg(F.avg("dx").alias("r"))
    return f.join(ref, ["year", "x", "y"])


def registered_frames(spark, sf_dir):
    """Each month's field image registered to its year's mean image: mean displacement, error at full resolution before
    and after, and what differs in structure afterwards."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = smoothed(pdf.x, pdf.y, pdf.dx), smoothed(pdf.x, pdf.y, pdf.r)
        m = R.flow(a, b, layers=2, radius=3)
        rest = K.ssim_difference(R.warp(a, m.field), b, 3)
        return pd.DataFrame({"t": [pdf.t.iloc[0]], "mean_dx": [round(float(m.field[0].mean()), 6)], "mean_dy": [round(float(m.field[1].mean()), 6)], "error_before": [round(m.before, 6)], "error_after": [round(m.after, 6)], "structure": [round(float(rest.mean()), 6)]})

    return against_year(spark, sf_dir).groupBy("t").applyInPandas(solve, "t long, mean_dx double, mean_dy double, error_before double, error_after double, structure double")


register("registered_frames", registered_frames)


def volume_pairs(spark, sf_dir):
    """(t, x, y, z, v, r): each year's volume with the mean volume."""
    v = I.volume(spark, sf_dir)
    return v.join(v.groupBy("x", "y", "z").agg(F.avg("v").alias("r")), ["x", "y", "z"])


def volume_motion(spark, sf_dir):
    """Each year's volume registered to the mean volume in three dimensions."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (R.mean_box(block(pdf.x, pdf.y, pdf.z, v), (1, 1, 0)) for v in (pdf.v, pdf.r))
        m = R.flow(a, b, layers=2, radius=3, rounds=6)
        return pd.DataFrame({"t": [pdf.t.iloc[0]], **{f"mean_d{c}": [round(float(d.mean()), 6)] for c, d in zip("xyz", m.field, strict=True)}, "error_before": [round(m.before, 6)], "error_after": [round(m.after, 6)]})

    return volume_pairs(spark, sf_dir).groupBy("t").applyInPandas(solve, "t long, mean_dx double, mean_dy double, mean_dz double, error_before double, error_after double")


register("volume_motion", volume_motion)


def slice_motion(spark, sf_dir):
    """Three slices of each year's volume found in the mean volume, whose planes lie twice as close."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (R.mean_box(block(pdf.x, pdf.y, pdf.z, v), (1, 1, 0)) for v in (pdf.v, pdf.r))
        m = R.cross_flow(a[:, :, 1::2], b, np.arange(1.0, 6.0, 2.0), layers=2, radius=3, rounds=6)
        return pd.DataFrame({"t": [pdf.t.iloc[0]], "mean_dz": [round(float(m.field[2].mean()), 6)], "error_before": [round(m.before, 6)], "error_after": [round(m.after, 6)]})

    return volume_pairs(spark, sf_dir).groupBy("t").applyInPandas(solve, "t long, mean_dz double, error_before double, error_after double")


register("slice_motion", slice_motion)


def recording_motion(spark, sf_dir):
    """Both channels' months as recordings, registered from the middle in two directions with a rolling reference and a
    warm start; a recording is one task, as each frame starts from the one before."""
    f = I.field(spark, sf_dir)
    rows = f.select("t", "x", "y", F.explode(F.array(F.struct(F.lit("first").alias("channel"), F.col("dx").alias("v")), F.struct(F.lit("second").alias("channel"), (F.col("dy") * 5).alias("v")))).alias("c"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        months = sorted(pdf.t.unique())
        frames = [smoothed(p.x, p.y, p.v) for _, p in pdf.groupby("t", sort=True)]
        found = R.register_recording(frames, layers=2, radius=3, rounds=5)
        return pd.DataFrame({"channel": pdf.channel.iloc[0], "t": months, "mean_dx": [round(float(m.field[0].mean()), 6) for m, _, _ in found], "error_before": [round(m.before, 6) for m, _, _ in found], "error_after": [round(m.after, 6) for m, _, _ in found]})

    return rows.select("t", "x", "y", "c.channel", "c.v").groupBy("channel").applyInPandas(solve, "channel string, t long, mean_dx double, error_before double, error_after double")


register("recording_motion", recording_motion)


def reference_reliability(spark, sf_dir):
    """Consecutive years' mean images: the later registered to the earlier, and which cells are reliable and agree."""
    v = I.field(spark, sf_dir).groupBy(F.floor(F.col("t") / 12).alias("year"), "x", "y").agg(F.avg("dx").alias("a"))
    pair = v.select("year", "x", "y", "a").join(v.select((F.col("year") - 1).alias("year"), "x", "y", F.col("a").alias("b")), ["year", "x", "y"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = smoothed(pdf.x, pdf.y, pdf.a), smoothed(pdf.x, pdf.y, pdf.b)
        m = R.flow(b, a, layers=2, radius=3)
        mask, apart, trust = S.difference_mask(a, R.warp(b, m.field))
        before = S.mind_difference(a, b)
        return pd.DataFrame({"year": [pdf.year.iloc[0]], "masked": [int((~mask).sum())], "reliability": [round(float(trust.mean()), 6)], "difference_before": [round(float(before.mean()), 6)], "difference_after": [round(float(apart.mean()), 6)]})

    return pair.groupBy("year").applyInPandas(solve, "year long, masked long, reliability double, difference_before double, difference_after double")


register("reference_reliability", reference_reliability)


def frame_structure(spark, sf_dir):
    """Each month's image against its year's mean: difference maps, edges, edge contrast and blobs."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = smoothed(pdf.x, pdf.y, pdf.dx), smoothed(pdf.x, pdf.y, pdf.r)
        far, recall, precision = S.blob_match(S.blobs(a, 2.0), S.blobs(b, 2.0))
        nothing = lambda x: None if x != x else round(x, 6)
        return pd.DataFrame({"t": [pdf.t.iloc[0]], "mind": [round(float(S.mind_difference(a, b).mean()), 6)], "zscore": [round(float(S.zscore_difference(a, b).mean()), 6)], "contrast": [round(float(S.michelson(a, 1.0, 3.0).mean()), 6)], "edges": [nothing(S.edge_distance(a, b))], "blob_distance": [nothing(far)], "recall": [nothing(recall)], "precision": [nothing(precision)]})

    return against_year(spark, sf_dir).groupBy("t").applyInPandas(solve, "t long, mind double, zscore double, contrast double, edges double, blob_distance double, recall double, precision double")


register("frame_structure", frame_structure)


def significant_spots(spark, sf_dir):
    """Each year's mean image: the largest z-score of a spot against its ring, by order statistics, and its cells."""
    v = I.field(spark, sf_dir).groupBy(F.floor(F.col("t") / 12).alias("year"), "x", "y").agg(F.avg("dx").alias("a"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        a = image(pdf.x, pdf.y, pdf.a)
        z = S.significance(a, np.quantile(a, [0.7, 0.8, 0.9, 0.95]), least=4, most=200)
        return pd.DataFrame({"year": [pdf.year.iloc[0]], "peak": [round(float(z.max()), 6)], "cells": [int((z > 0).sum())]})

    return v.groupBy("year").applyInPandas(solve, "year long, peak double, cells long")


register("significant_spots", significant_spots)


def grown_regions(spark, sf_dir):
    """Each year's bright voxels grown by two steps of a ball through the voxels above the middle."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        a = block(pdf.x, pdf.y, pdf.z, pdf.v)
        seed, allowed = a > 45, a > EMPTY
        grown = S.grow(seed, allowed, S.ball(1, 2.0), 2)
        return pd.DataFrame({"t": [pdf.t.iloc[0]], "seeds": [int(seed.sum())], "grown": [int(grown.sum())], "regions": [S.label(grown)[1]]})

    return I.volume(spark, sf_dir).groupBy("t").applyInPandas(solve, "t long, seeds long, grown long, regions long")


register("grown_regions", grown_regions)


def quality_frames(spark, sf_dir):
    """The months of both channels through the quality loop, each channel against its first months' mean image."""
    f = I.field(spark, sf_dir)
    rows = f.select("t", "x", "y", F.explode(F.array(F.struct(F.lit("first").alias("channel"), F.col("dx").alias("v")), F.struct(F.lit("second").alias("channel"), (F.col("dy") * 5).alias("v")))).alias("c"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        months = sorted(pdf.t.unique())
        frames = [smoothed(p.x, p.y, p.v) for _, p in pdf.groupby("t", sort=True)]
        found = R.quality_loop(frames, np.mean(frames[:6], axis=0), layers=2, radius=3, rounds=5)
        out = pd.DataFrame(found).round(6)
        out.insert(0, "t", months)
        out.insert(0, "channel", pdf.channel.iloc[0])
        return out

    return rows.select("t", "x", "y", "c.channel", "c.v").groupBy("channel").applyInPandas(solve, "channel string, t long, error_before double, error_after double, masked double, reliability double, mae double, relative double, ncc double")


register("quality_frames", quality_frames)
