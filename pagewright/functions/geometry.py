"""Rectangles on pages. A box is a struct with l, r, t, b; a page has a width and a height."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shares of the page from which a box counts as the page itself, and the margin at its edges.
PAGE_SHARE, PAGE_SHARE_TOUCHING, PAGE_MARGIN = 0.82, 0.65, 0.04
IMAGE_SHARE, DRAWING_SHARE, CLUSTER_SHARE, CLUSTER_GAP = 0.01, 0.0005, 0.03, 12.0


def normalised(box: Column) -> Column:
    """The box with l <= r and t <= b, whichever corner it was measured from."""
    return F.struct(F.least(box["l"], box["r"]).alias("l"), F.greatest(box["l"], box["r"]).alias("r"), F.least(box["t"], box["b"]).alias("t"), F.greatest(box["t"], box["b"]).alias("b"))


def is_valid(box: Column) -> Column:
    """Whether the box has an area."""
    return (box["r"] != box["l"]) & (box["b"] != box["t"])


def area_ratio(box: Column, width: Column, height: Column) -> Column:
    """The box's share of the page's area, 0 on a page without any."""
    page = width * height
    return F.when(page > 0, F.abs(box["r"] - box["l"]) * F.abs(box["b"] - box["t"]) / page).otherwise(F.lit(0.0))


def is_page_sized(box: Column, width: Column, height: Column) -> Column:
    ratio, margin = area_ratio(box, width, height), F.greatest(width, height) * PAGE_MARGIN
    n = normalised(box)
    touching = (n["l"] <= margin) & (n["t"] <= margin) & (n["r"] >= width - margin) & (n["b"] >= height - margin)
    return (ratio >= PAGE_SHARE) | ((ratio >= PAGE_SHARE_TOUCHING) & touching)


def is_kept_area(box: Column, label: Column, width: Column, height: Column) -> Column:
    least = F.when(label == "image", IMAGE_SHARE).otherwise(DRAWING_SHARE)
    return is_valid(box) & (area_ratio(box, width, height) >= least) & ~is_page_sized(box, width, height)


def to_canvas(box: Column, width: Column, height: Column, canvas_w: Column, canvas_h: Column, pad: float = 0.0) -> Column:
    """x, y, w, h on a canvas: scaled, padded, measured from the top, and kept inside at the left and upper edge and in size."""
    sx, sy = canvas_w / width, canvas_h / height
    left, right = F.least(box["l"], box["r"]) * sx, F.greatest(box["l"], box["r"]) * sx
    low, high = F.least(box["t"], box["b"]), F.greatest(box["t"], box["b"])
    bottom_up = F.upper(F.coalesce(F.nullif(box["coordOrigin"], F.lit("")), F.lit("BOTTOMLEFT"))).contains("BOTTOM")
    top = F.when(bottom_up, height - high).otherwise(low) * sy
    tall = (high - low) * sy
    return F.struct(
        F.greatest(F.lit(0.0), left - pad).alias("x"), F.greatest(F.lit(0.0), top - pad).alias("y"),
        F.least(canvas_w, right - left + 2 * pad).alias("w"), F.least(canvas_h, tall + 2 * pad).alias("h"),
    )


def is_kept_cluster(box: Column, width: Column, height: Column) -> Column:
    """Whether a union of near boxes is large enough to be shown, and not the page itself."""
    return (area_ratio(box, width, height) >= CLUSTER_SHARE) & ~is_page_sized(box, width, height)


def preview_box(box: Column, width: Column, height: Column) -> Column:
    """x, y, w, h in percent of the image."""
    part = lambda x, of: F.when(of > 0, x * 100 / of)
    return F.struct(part(box["x"], width).alias("x"), part(box["y"], height).alias("y"), part(box["w"], width).alias("w"), part(box["h"], height).alias("h"))


def _first(json: Column, *paths: str) -> Column:
    return F.coalesce(*[F.nullif(F.get_json_object(json, f"$.{p}"), F.lit("")) for p in paths])


def box_from_json(json: Column) -> Column:
    """A box under any of the names that its edges go by (fixed values); null where one is missing. Without an origin it is measured from
    the bottom."""
    edges = {"l": ("l", "left", "x0", "x"), "r": ("r", "right", "x1"), "t": ("t", "top", "y1"), "b": ("b", "bottom", "y0", "y")}
    found = {k: _first(json, *v).cast("double") for k, v in edges.items()}
    origin = F.upper(F.coalesce(_first(json, "coord_origin", "coordOrigin"), F.lit("BOTTOMLEFT")))
    whole = found["l"].isNotNull() & found["r"].isNotNull() & found["t"].isNotNull() & found["b"].isNotNull()
    return F.when(whole, F.struct(*[v.alias(k) for k, v in found.items()], origin.alias("coordOrigin")))


def page_size_from_json(json: Column) -> Column:
    """Width and height of a page under any of the names that they go by (fixed values); null where one is missing or 0."""
    holders = ("size.", "page_size.", "pageSize.", "dimension.", "dimensions.", "")
    w, h = (_first(json, *[p + k for p in holders]).cast("double") for k in ("width", "height"))
    return F.when((w != 0) & (h != 0), F.struct(w.alias("width"), h.alias("height")))


def render_scale(scale: Column, default: float = 2.0, most: float = 3.0) -> Column:
    odd = scale.isNull() | F.isnan(scale) | (scale <= 0) | (scale == float("inf"))
    return F.when(odd, default).otherwise(F.least(scale, F.lit(most)))
