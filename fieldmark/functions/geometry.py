"""Boxes: area, overlap, rotation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iou(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """Intersection over union of boxes (left, top, width, height); 0 where they touch at most."""
    (x1, y1, w1, h1), (x2, y2, w2, h2) = a, b
    w = F.least(x1 + w1, x2 + w2) - F.greatest(x1, x2)
    h = F.least(y1 + h1, y2 + h2) - F.greatest(y1, y2)
    return F.when((w <= 0) | (h <= 0), 0.0).otherwise(w * h / F.nullif(w1 * h1 + w2 * h2 - w * h, F.lit(0.0)))


def been_adjusted(box: tuple[Column, Column, Column, Column], width: Column, height: Column, theta: Column, slack: float = 0.01) -> Column:
    """Whether a box is rotated or its relative margins differ."""
    x, y, w, h = box
    margins = [x / width, y / height, 1 - (x + w) / width, 1 - (y + h) / height]
    return (theta != 0) | (F.greatest(*margins) - F.least(*margins) > slack)


def rotate_quarter(theta: Column, clockwise: bool = True) -> Column:
    """theta turned by a quarter, within [0, 2 pi)."""
    turned = theta + (1 if clockwise else -1) * F.pi() / 2
    return F.pmod(turned, 2 * F.pi())


def full_frame(width: Column, height: Column, shrink: float = 0.0) -> list[Column]:
    """left, top, width and height of a box over an image less a share of each side."""
    return [F.floor(width * shrink).alias("xtl"), F.floor(height * shrink).alias("ytl"), F.floor(width * (1 - 2 * shrink)).alias("width"), F.floor(height * (1 - 2 * shrink)).alias("height")]
