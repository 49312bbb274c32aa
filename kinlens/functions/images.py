"""Bits, categories and geometry of images, as column expressions; numpy only where pixels or linear systems come in."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Markers, labels, phrases, templates and limits that decide results.
SCREENSHOT_MARKERS = ("screenshot", "screen shot", "screen-shot", "scrnshot", "screen recording", "screen_recording", "cleanshot")
DOCUMENT_LABELS = ("document", "paper", "receipt", "letter", "envelope", "passport", "business_card", "form", "invoice", "id_card", "credit_card")
IDENTITY_PHRASES = (
    "aadhaar", "aadhar", "uidai", "unique identification", "permanent account number", "income tax department", "passport", "republic of india",
    "type p<", "driving licence", "driving license", "transport department", "voter", "election commission", "identity card", "id card",
)
FACE_TEMPLATE = ((38.2946, 51.6963), (73.5318, 51.5014), (56.0252, 71.7366), (41.5493, 92.3655), (70.7299, 92.2041))
PET_TEMPLATE = ((38.0, 48.0), (74.0, 48.0), (56.0, 78.0))
TEMPLATE_SIDE = 112
ASPECT = (1.7, 2.3)
DOCUMENT_CONFIDENCE, LABEL_CONFIDENCE, PET_CONFIDENCE = 0.75, 0.6, 0.6
FACE_QUALITY, JOINT_CONFIDENCE = 0.3, 0.2
CROP_MARGIN = 0.2
PIVOT = 1e-12


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two longs."""
    return F.bit_count(a.bitwiseXOR(b))


def dhash_bits(gray: np.ndarray) -> int:
    """The signed 64-bit difference hash of 8 rows of 9 gray pixels: bit k, row by row, is set where a pixel is over its right neighbour."""
    g = np.asarray(gray, np.uint8).reshape(8, 9)
    bits = (g[:, :-1] > g[:, 1:]).ravel()
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def dhash(pixels: pd.Series) -> pd.Series:
    """Difference hash of 72 gray bytes; null for anything else."""
    return pixels.map(lambda p: dhash_bits(np.frombuffer(p, np.uint8)) if p is not None and len(p) == 72 else None).astype("Int64")


def shrink_gray(image: np.ndarray) -> np.ndarray:
    """An image (rows, columns[, channels]) as 8 rows of 9 gray pixels, by area means."""
    g = np.asarray(image, float)
    if g.ndim == 3:
        g = g[..., :3] @ np.array([0.299, 0.587, 0.114]) if g.shape[2] >= 3 else g[..., 0]

    def spread(n: int, m: int) -> np.ndarray:
        edges, cells = np.linspace(0, n, m + 1), np.arange(n)
        cover = np.minimum(edges[1:, None], cells + 1) - np.maximum(edges[:-1, None], cells)
        cover = np.maximum(cover, 0)
        return cover / cover.sum(1, keepdims=True)

    return np.clip(np.rint(spread(g.shape[0], 8) @ g @ spread(g.shape[1], 9).T), 0, 255).astype(np.uint8)


def _any_of(text: Column, words: Sequence[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def has_screenshot_marker(filename: Column) -> Column:
    return F.coalesce(_any_of(F.lower(filename), SCREENSHOT_MARKERS), F.lit(False))


def is_screenshot(filename: Column, has_camera: Column, is_png: Column, width: Column, height: Column) -> Column:
    """A marker decides; then camera metadata rules it out; then a PNG is one; then a phone's aspect ratio, limits included."""
    ratio = F.greatest(width, height) / F.least(width, height)
    phone = F.coalesce((width > 0) & (height > 0) & ratio.between(*ASPECT), F.lit(False))
    return F.when(has_screenshot_marker(filename), True).when(F.coalesce(has_camera, F.lit(False)), False).when(F.coalesce(is_png, F.lit(False)), True).otherwise(phone)


def is_document(segmentation: Column, labels: Column) -> Column:
    """By the segmentation's confidence, else by a strong enough label of ``labels``, an array of (label, confidence)."""
    names = F.array(*map(F.lit, DOCUMENT_LABELS))
    strong = F.transform(F.filter(labels, lambda x: x["confidence"] >= LABEL_CONFIDENCE), lambda x: x["label"])
    return F.coalesce(segmentation >= DOCUMENT_CONFIDENCE, F.lit(False)) | F.coalesce(F.arrays_overlap(strong, names), F.lit(False))


def has_identity_phrase(text: Column) -> Column:
    return F.coalesce(_any_of(F.lower(text), IDENTITY_PHRASES), F.lit(False))


def category(identity: Column, screenshot: Column, document: Column) -> Column:
    return F.when(identity, "identity").when(screenshot, "screenshot").when(document, "document").otherwise("other")


def pet_kind(labels: Column) -> Column:
    """cat or dog by the most confident label, if it is confident enough; null else."""
    best = F.reduce(labels, F.struct(F.lit("").alias("label"), F.lit(-1.0).alias("confidence")), lambda a, x: F.when(x["confidence"] > a["confidence"], F.struct(x["label"].alias("label"), x["confidence"].cast("double").alias("confidence"))).otherwise(a))
    name = F.lower(best["label"])
    return F.when(best["confidence"] >= PET_CONFIDENCE, F.when(name.contains("cat"), "cat").when(name.contains("dog"), "dog"))


def passes_quality(quality: Column, least: float | None = FACE_QUALITY) -> Column:
    return F.lit(True) if least is None else quality.isNull() | (quality >= least)


def passes_joints(*confidences: Column) -> Column:
    found = F.lit(True)
    for c in confidences:
        found = found & F.coalesce(c >= JOINT_CONFIDENCE, F.lit(False))
    return found


def _box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def head_box(xs: Sequence[Column], ys: Sequence[Column]) -> Column:
    """A padded box around head joints, in the unit square."""
    low_x, low_y = F.least(*xs), F.least(*ys)
    w, h = F.greatest(F.greatest(*xs) - low_x, F.lit(0.01)), F.greatest(F.greatest(*ys) - low_y, F.lit(0.01))
    pad_x, pad_y = w * 0.9, h * 1.1
    x, y = F.greatest(F.lit(0.0), low_x - pad_x), F.greatest(F.lit(0.0), low_y - pad_y)
    return _box(x, y, F.least(F.lit(1.0) - x, w + pad_x * 2), F.least(F.lit(1.0) - y, h + pad_y * 2))


def crop_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, margin: float = CROP_MARGIN) -> Column:
    """Whole pixels (top-left origin) of a unit box (bottom-left origin) with a margin, clamped to the image; null under a pixel."""
    bw, bh = w * width, h * height
    left, top = x * width - bw * margin, height - (y * height - bh * margin + bh * (1 + 2 * margin))
    x0, y0 = F.greatest(left, F.lit(0.0)), F.greatest(top, F.lit(0.0))
    x1, y1 = F.least(left + bw * (1 + 2 * margin), width.cast("double")), F.least(top + bh * (1 + 2 * margin), height.cast("double"))
    whole = _box(F.floor(x0), F.floor(y0), F.ceil(x1) - F.floor(x0), F.ceil(y1) - F.floor(y0))
    return F.when((x1 - x0 >= 1) & (y1 - y0 >= 1), whole)


def aspect_fit(width: Column, height: Column, box_w: Column, box_h: Column) -> Column:
    """The centred largest rectangle of an image's shape in a container; the container where the image has no size."""
    scale = F.least(box_w / width, box_h / height)
    w, h = width * scale, height * scale
    return F.when((width > 0) & (height > 0), _box((box_w - w) / 2, (box_h - h) / 2, w, h)).otherwise(_box(F.lit(0.0), F.lit(0.0), box_w.cast("double"), box_h.cast("double")))


def map_box(x: Column, y: Column, w: Column, h: Column, fit: Column) -> Column:
    """A unit box (bottom-left origin) in a fitted rectangle (top-left origin)."""
    return _box(fit["x"] + x * fit["w"], fit["y"] + (1 - y - h) * fit["h"], w * fit["w"], h * fit["h"])


def five_points(left_eye: Column, right_eye: Column, nose: Column, lips: Column, box: Column) -> Column:
    """Eyes, nose and lip corners in image coordinates (top-left origin), from arrays of (x, y) in the face's box; null without eyes."""

    def place(p: Column) -> Column:
        return F.struct((box["x"] + p["x"] * box["w"]).alias("x"), (1 - (box["y"] + p["y"] * box["h"])).alias("y"))

    def mean(a: Column) -> Column:
        total = lambda axis: F.aggregate(a, F.lit(0.0), lambda s, p: s + p[axis]) / F.size(a)
        return F.when(F.size(a) > 0, place(F.struct(total("x").alias("x"), total("y").alias("y"))))

    le, re = mean(left_eye), mean(right_eye)
    between = F.struct(((le["x"] + re["x"]) / 2).alias("x"), ((le["y"] + re["y"]) / 2).alias("y"))
    by_x = F.array_sort(lips, lambda p, q: F.when(p["x"] < q["x"], -1).when(p["x"] > q["x"], 1).otherwise(0))
    corner = lambda k: F.when(F.size(lips) > 0, place(F.element_at(by_x, k)))
    return F.when(le.isNotNull() & re.isNotNull(), F.array(le, re, F.coalesce(mean(nose), between), F.coalesce(corner(1), le), F.coalesce(corner(-1), re)))


def similarity_transforms(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """(a, b, tx, ty) of the least-squares rotation, scale and shift of each row of points (rows, points, 2) onto points; NaN for fewer than two or where
    points coincide.

    x' = a x - b y + tx, y' = b x + a y + ty. In centred complex numbers the fit is one division.
    """
    p, q = np.asarray(source, float), np.asarray(target, float)
    if p.shape[1] < 2:
        return np.full((len(p), 4), np.nan)
    z, w = p @ [1, 1j], q @ [1, 1j]
    middle, goal = z.mean(1), w.mean(-1)
    centred = z - middle[:, None]
    spread = (np.abs(centred) ** 2).sum(1)
    spread = np.where(spread > PIVOT, spread, np.nan)
    with np.errstate(invalid="ignore"):
        turn = (np.conj(centred) * (w - goal[..., None])).sum(1) / spread
        shift = goal - turn * middle
    return np.stack([turn.real, turn.imag, shift.real, shift.imag], 1)


def similarity_transform(source: np.ndarray, target: np.ndarray) -> np.ndarray | None:
    """:func:`similarity_transforms` of one set of points; null where there is no fit."""
    p, q = np.asarray(source, float), np.asarray(target, float)
    if p.shape != q.shape or len(p) < 2:
        return None
    fit = similarity_transforms(p[None], q)[0]
    return None if np.isnan(fit).any() else fit


def template_transforms(points: np.ndarray, width: int, height: int, side: int = TEMPLATE_SIDE) -> np.ndarray:
    """The transforms of five face landmarks each (unit, top-left origin) or three pet joints (unit, bottom-left origin) onto the template: rows of
    (a, b, tx, ty), as :func:`similarity_transforms`.

    Eyes and mouth corners are taken by their x. Both sides count from the bottom left, in pixels.
    """
    p = np.array(points, float)
    face = p.shape[1] == 5
    for a, b in ((0, 1), (3, 4)) if face else ((0, 1),):
        swap = p[:, a, 0] > p[:, b, 0]
        p[swap, a], p[swap, b] = p[swap, b], p[swap, a]
    if face:
        p[:, :, 1] = 1 - p[:, :, 1]
    scale = side / TEMPLATE_SIDE
    goal = np.array(FACE_TEMPLATE if face else PET_TEMPLATE) * scale
    goal[:, 1] = side - goal[:, 1]
    return similarity_transforms(p * [width, height], goal)


def template_transform(points: np.ndarray, width: int, height: int, side: int = TEMPLATE_SIDE) -> np.ndarray | None:
    """:func:`template_transforms` of one face or pet; null where there is no fit."""
    fit = template_transforms(np.asarray(points, float)[None], width, height, side)[0]
    return None if np.isnan(fit).any() else fit


def warp(image: np.ndarray, transform: np.ndarray, side: int) -> np.ndarray:
    """The square crop that a transform (bottom-left pixel coordinates) makes of an image, by bilinear sampling; black outside."""
    a, b, tx, ty = transform
    rows, columns = np.mgrid[0:side, 0:side]
    at = (columns + 0.5 - tx) + 1j * (side - rows - 0.5 - ty)
    origin = at / (a + 1j * b)
    h, w = image.shape[:2]
    x, y = origin.real - 0.5, h - origin.imag - 0.5
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    out = np.zeros((side, side, *image.shape[2:]))
    for dx in (0, 1):
        for dy in (0, 1):
            inside = (x0 + dx >= 0) & (x0 + dx < w) & (y0 + dy >= 0) & (y0 + dy < h)
            weight = np.where(dx, x - x0, 1 - x + x0) * np.where(dy, y - y0, 1 - y + y0) * inside
            taken = image[np.clip(y0 + dy, 0, h - 1), np.clip(x0 + dx, 0, w - 1)]
            out += taken * (weight if image.ndim == 2 else weight[..., None])
    return out
