"""Boxes of a page: filters, clusters by nearness, sizes, and the gate that keeps rich slides."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G


@dataclass(frozen=True)
class Filters:
    """What a slide needs to be worth describing."""

    least_boxes: int = 1
    least_area_percent: float = 12.0
    least_residual_percent: float = 30.0
    least_edge_percent: float = 10.0
    mask_padding: float = 3.0
    least_text_boxes: int = 1
    most_repeats: int = 1
    residual_fallback: bool = False

    @classmethod
    def of(cls, given: dict) -> Filters:
        """From what a user gave: numbers as text are numbers, what is missing or null has its default, names that aren't filters are an error."""
        kinds = {f.name: type(f.default) for f in fields(cls)}
        return cls(**{k: kinds[k](float(v)) if kinds[k] is not bool else bool(v) for k, v in given.items() if v is not None})


def areas(images: DataFrame) -> DataFrame:
    """(doc_id, id, pos, label, box, width, height): one row per picture area; exact copies of an image row count once."""
    rows = images.select("doc_id", "id", "page_size", "picture_areas").distinct()
    return rows.select("doc_id", "id", F.col("page_size.width").alias("width"), F.col("page_size.height").alias("height"), F.posexplode("picture_areas").alias("pos", "a")).select(
        "doc_id", "id", "pos", F.col("a.label").alias("label"), F.col("a.bbox").alias("box"), "width", "height"
    )


def components(boxes: np.ndarray, gap: float) -> np.ndarray:
    """The cluster of each box (l, r, t, b): boxes within ``gap`` of each other on both axes are in one, and so on from box to box. A sweep
    by left edges compares a box with those only that begin before it ends."""
    label = np.arange(len(boxes))

    def root(k: int) -> int:
        while label[k] != k:
            label[k] = label[label[k]]
            k = label[k]
        return k

    order = np.argsort(boxes[:, 0], kind="stable")
    lefts = boxes[order, 0]
    for at, k in enumerate(order):
        to = np.searchsorted(lefts, boxes[k, 1] + gap, "right")
        ahead = order[at + 1 : to]
        near = (np.maximum(boxes[ahead, 2], boxes[k, 2]) - np.minimum(boxes[ahead, 3], boxes[k, 3])) <= gap
        for other in ahead[near]:
            a, b = root(k), root(other)
            label[max(a, b)] = min(a, b)
    return np.array([root(k) for k in range(len(boxes))])


def clusters(images: DataFrame, gap: float = G.CLUSTER_GAP) -> DataFrame:
    """(doc_id, id, cluster, boxes, l, r, t, b): unions of near areas. The areas of a page are one row's array; only
    exact copies of a row are looked for across rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, image, found in zip(pdf["doc_id"], pdf["id"], pdf["boxes"]):
                boxes = np.array([[min(x["l"], x["r"]), max(x["l"], x["r"]), min(x["t"], x["b"]), max(x["t"], x["b"])] for x in found], dtype=float)
                label = components(boxes, gap)
                for c in np.unique(label):
                    m = boxes[label == c]
                    out.append((doc, image, int(c), len(m), m[:, 0].min(), m[:, 1].max(), m[:, 2].min(), m[:, 3].max()))
            yield pd.DataFrame(out, columns=["doc_id", "id", "cluster", "boxes", "l", "r", "t", "b"])

    rows = images.select("doc_id", "id", F.transform("picture_areas", lambda a: a["bbox"]).alias("boxes")).distinct().where(F.size("boxes") > 0)
    return rows.mapInPandas(run, "doc_id string, id string, cluster int, boxes int, l double, r double, t double, b double")


def picture_share(images: DataFrame) -> DataFrame:
    """(doc_id, id, boxes, share): the areas' share of the page, overlaps counted twice, at most 1."""
    a = areas(images)
    w, h = F.abs(F.col("box.r") - F.col("box.l")), F.abs(F.col("box.b") - F.col("box.t"))
    return a.groupBy("doc_id", "id").agg(F.count("*").alias("boxes"), F.least(F.lit(1.0), F.sum(w * h) / F.first(F.col("width") * F.col("height"))).alias("share"))


def page_extent(images: DataFrame) -> DataFrame:
    """(doc_id, id, width, height): the page's size, or the extent of its areas where it isn't known."""
    a = areas(images)
    return a.groupBy("doc_id", "id").agg(
        F.coalesce(F.max("width"), F.max(F.greatest("box.l", "box.r"))).alias("width"), F.coalesce(F.max("height"), F.max(F.greatest("box.t", "box.b"))).alias("height")
    )


def repeats(images: DataFrame) -> DataFrame:
    """Each image row with how often its fingerprint stands in its deck."""
    return images.withColumn("repeats", F.count("*").over(Window.partitionBy("doc_id", "fingerprint")))


def decisions(images: DataFrame, analysis: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """(doc_id, image_id, repeats, skip_reasons, kept) of every image row."""
    seen = repeats(images).select("doc_id", F.col("id").alias("image_id"), "repeats")
    a = analysis.select("doc_id", "image_id", "status", "picture_box_count", "picture_area_ratio", *(["text_box_count", "residual_ratio", "edge_ratio"] if filters.residual_fallback else []))
    rows = seen.join(a, ["doc_id", "image_id"], "left")
    few = F.coalesce("picture_box_count", F.lit(0)) < filters.least_boxes
    small = F.coalesce("picture_area_ratio", F.lit(0.0)) < filters.least_area_percent / 100
    many = F.col("repeats") > filters.most_repeats
    rescued = F.lit(False)
    if filters.residual_fallback:  # what is left beside the text can only take the last reason away
        rest = (F.coalesce("residual_ratio", F.lit(0.0)) >= filters.least_residual_percent / 100) | (F.coalesce("edge_ratio", F.lit(0.0)) >= filters.least_edge_percent / 100)
        rescued = (F.coalesce("text_box_count", F.lit(0)) >= filters.least_text_boxes) & rest
    ready = F.filter(
        F.array(
            F.when(many, F.concat(F.lit("repeated "), F.col("repeats").cast("string"), F.lit("x"))),
            F.when(few, f"picture boxes < {filters.least_boxes}"),
            F.when(small, f"picture area < {filters.least_area_percent:g}%"),
            F.when((few | small) & ~rescued, "below vision threshold"),
        ),
        lambda x: x.isNotNull(),
    )
    reasons = F.when(F.col("status") == "error", F.array(F.lit("load failed"))).when(F.coalesce(F.col("status"), F.lit("")) != "ready", F.array(F.lit("analyzing"))).otherwise(ready)
    return rows.select("doc_id", "image_id", "repeats", F.array_join(reasons, "; ").alias("skip_reasons"), (F.size(reasons) == 0).alias("kept"))
