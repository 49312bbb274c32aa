"""Features of photos: a file is decoded once, and faces, pets, category, metadata and hash come from the same pixels.

Models are interfaces. The stubs here are deterministic and need no weights; a real detector or embedder is any object with the
same methods, made once in each worker by a factory.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import images as I
from ..functions import text as X
from ..sources.images import bounded, decode, metadata, upright
from ..tables import ship


@dataclass
class Found:
    """A detected face (five points, unit, top-left origin) or pet head (three points, unit, bottom-left origin)."""

    box: tuple[float, float, float, float]  # unit, bottom-left origin
    points: list[tuple[float, float]] | None = None
    quality: float | None = None
    angles: tuple[float | None, float | None, float | None] = (None, None, None)
    confidences: tuple[float, ...] = ()


class Embedder(Protocol):
    model_identifier: str

    def embed(self, crop: np.ndarray) -> np.ndarray: ...


class Detector(Protocol):
    def faces(self, pixels: np.ndarray) -> list[Found]: ...

    def pets(self, pixels: np.ndarray) -> list[Found]: ...

    def labels(self, pixels: np.ndarray) -> list[tuple[str, float]]: ...

    def animals(self, pixels: np.ndarray) -> list[tuple[str, float]]: ...

    def document(self, pixels: np.ndarray) -> float | None: ...

    def text(self, pixels: np.ndarray) -> str: ...


class PixelEmbedder:
    """The crop's gray levels on a grid, centred: a stand-in that tells crops apart."""

    model_identifier = "pixels.v1"

    def __init__(self, side: int = 8) -> None:
        self.side = side

    def embed(self, crop: np.ndarray) -> np.ndarray:
        g = crop.mean(2) if crop.ndim == 3 else crop
        edges_y, edges_x = np.linspace(0, g.shape[0], self.side + 1).astype(int), np.linspace(0, g.shape[1], self.side + 1).astype(int)
        v = np.array([[g[a : max(b, a + 1), c : max(d, c + 1)].mean() for c, d in zip(edges_x, edges_x[1:])] for a, b in zip(edges_y, edges_y[1:])])
        return (v - v.mean()).ravel().astype(np.float32)


class NoDetector:
    """Finds nothing."""

    def faces(self, pixels):
        return []

    def pets(self, pixels):
        return []

    def labels(self, pixels):
        return []

    def animals(self, pixels):
        return []

    def document(self, pixels):
        return None

    def text(self, pixels):
        return ""


#: Installed models in the order of preference, file stem and identifier.
KNOWN_MODELS = (("auraface", "auraface.v1"), ("arcface", "arcface.buffalo_l"))


def choose_embedder(folder: str | None, override: str | None = None, path: str | None = None, load: Callable[[str, str], Embedder] | None = None) -> Embedder:
    """The fallback if asked for; else the model at ``path``; else the first installed of the known ones; else the fallback, as where loading fails."""
    pick = None
    if override != "fallback":
        if path:
            pick = (path, "external.embedder")
        elif folder:
            pick = next(((os.path.join(folder, n), i) for name, i in KNOWN_MODELS for n in (f"{name}.onnx",) if os.path.exists(os.path.join(folder, n))), None)
    if pick:
        try:
            return (load or OnnxEmbedder)(*pick)
        except Exception:  # an unreadable model is as good as none
            pass
    return PixelEmbedder()


class OnnxEmbedder:
    """A 112-pixel face model through onnxruntime: BGR, (x - 127.5) / 127.5."""

    def __init__(self, path: str, identifier: str, side: int = 112) -> None:
        import onnxruntime

        self.session = onnxruntime.InferenceSession(path)
        self.model_identifier, self.side = identifier, side
        self.input = self.session.get_inputs()[0].name

    def embed(self, crop: np.ndarray) -> np.ndarray:
        rgb = np.repeat(crop[..., None], 3, 2) if crop.ndim == 2 else crop
        x = (rgb[..., ::-1].astype(np.float32) - 127.5) / 127.5
        return self.session.run(None, {self.input: x.transpose(2, 0, 1)[None]})[0].ravel()


@dataclass
class Models:
    """What a worker makes once: factories, so that nothing heavy is sent."""

    detector: Callable[[], Detector] = NoDetector
    face_embedder: Callable[[], Embedder] = PixelEmbedder
    pet_embedder: Callable[[], Embedder] = PixelEmbedder
    least_quality: float | None = I.FACE_QUALITY
    face_side: int = 112
    pet_side: int = 160
    made: dict = field(default_factory=dict)


def crop_of(pixels: np.ndarray, found: Found, side: int) -> np.ndarray | None:
    """The aligned crop by landmarks, or the box with a margin; null under a pixel."""
    h, w = pixels.shape[:2]
    if found.points is not None and len(found.points) in (3, 5):
        t = I.template_transform(np.array(found.points), w, h, side)
        if t is not None:
            return I.warp(pixels, t, side)
        if len(found.points) == 3:
            return None
    x, y, bw, bh = found.box
    m = I.CROP_MARGIN
    x0, x1 = max(0.0, (x - bw * m) * w), min(float(w), (x + bw * (1 + m)) * w)
    y0, y1 = max(0.0, h - (y + bh * (1 + m)) * h), min(float(h), h - (y - bh * m) * h)
    if x1 - x0 < 1 or y1 - y0 < 1:
        return None
    cut = pixels[int(y0) : int(np.ceil(y1)), int(x0) : int(np.ceil(x1))]
    rows, columns = (np.arange(side) * cut.shape[0] // side), (np.arange(side) * cut.shape[1] // side)
    return cut[rows][:, columns]


FEATURES = """id long, failed boolean, width int, height int, taken string, lat double, lat_ref string, lon double, lon_ref string, is_png boolean, has_camera boolean, phash long,
  segmentation double, labels array<struct<label:string,confidence:double>>, ocr string, animals array<struct<label:string,confidence:double>>,
  found array<struct<kind:string,x:double,y:double,w:double,h:double,roll:double,yaw:double,pitch:double,quality:double,embedding:array<float>,model:string>>"""


def features(files: DataFrame, models: Models) -> DataFrame:
    """Raw features (FEATURES) of files (id, content); a file that can't be decoded has ``failed``."""
    ship(files.sparkSession)

    def one(content: bytes | None) -> dict:
        if "detector" not in models.made:
            models.made = {"detector": models.detector(), "human": models.face_embedder(), "pet": models.pet_embedder()}
        detector = models.made["detector"]
        m = metadata(content or b"")
        row = {"failed": True, "width": m.width, "height": m.height, "taken": m.taken, "lat": m.lat, "lat_ref": m.lat_ref, "lon": m.lon, "lon_ref": m.lon_ref, "is_png": m.is_png, "has_camera": m.has_camera, "phash": None, "segmentation": None, "labels": [], "ocr": "", "animals": [], "found": []}
        pixels = decode(content or b"")
        if pixels is None:
            return row
        pixels = bounded(upright(pixels, m.orientation))
        row["failed"] = False
        row["phash"] = I.dhash_bits(I.shrink_gray(pixels))
        row["segmentation"], row["labels"] = detector.document(pixels), [{"label": a, "confidence": b} for a, b in detector.labels(pixels)]
        likely = (row["segmentation"] or 0) >= I.DOCUMENT_CONFIDENCE or any(x["label"] in I.DOCUMENT_LABELS and x["confidence"] >= I.LABEL_CONFIDENCE for x in row["labels"])
        row["ocr"] = detector.text(pixels) if likely else ""  # reading text is what costs
        row["animals"] = [{"label": a, "confidence": b} for a, b in detector.animals(pixels)]
        for kind, all_, side in (("human", detector.faces(pixels), models.face_side), ("pet", detector.pets(pixels) if row["animals"] else [], models.pet_side)):
            for f in all_:
                if kind == "human" and models.least_quality is not None and f.quality is not None and f.quality < models.least_quality:
                    continue
                if kind == "pet" and (len(f.confidences) < 3 or min(f.confidences) < I.JOINT_CONFIDENCE):
                    continue
                crop = crop_of(pixels, f, side)
                if crop is not None:
                    e = models.made[kind]
                    row["found"].append(dict(zip("xywh", map(float, f.box))) | {"kind": kind, "roll": f.angles[0], "yaw": f.angles[1], "pitch": f.angles[2], "quality": f.quality, "embedding": np.asarray(e.embed(crop), np.float32).tolist(), "model": e.model_identifier})
        return row

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), 16):  # images are large; a few rows are held at once
                part = pdf.iloc[k : k + 16]
                rows = [one(c) for c in part["content"]]
                out = pd.DataFrame(rows)
                out.insert(0, "id", part["id"].to_numpy())
                for c in ("width", "height", "phash"):
                    out[c] = out[c].astype("Int64")
                yield out

    return files.select("id", "content").mapInPandas(run, FEATURES)


def photo_columns(raw: DataFrame, names: DataFrame) -> DataFrame:
    """(id, failed, width, height, taken_at, gps_lat, gps_lon, category, pet_kind, phash) by the rules, from raw features and file names (id, name)."""
    r = raw.join(names, "id")
    document = I.is_document(F.col("segmentation"), F.col("labels"))
    identity = document & I.has_identity_phrase(F.col("ocr"))
    screenshot = I.is_screenshot(F.col("name"), F.col("has_camera"), F.col("is_png"), F.col("width"), F.col("height"))
    return r.select(
        "id", "failed", "width", "height",
        X.taken_at(F.col("taken")).alias("taken_at"),
        X.signed(F.col("lat"), F.col("lat_ref"), "S").alias("gps_lat"),
        X.signed(F.col("lon"), F.col("lon_ref"), "W").alias("gps_lon"),
        F.when(~F.col("failed"), I.category(identity, screenshot, document)).alias("category"),
        I.pet_kind(F.col("animals")).alias("pet_kind"),
        "phash",
    )


def face_rows(raw: DataFrame, now: float) -> DataFrame:
    """Faces and pets of raw features, without ids."""
    f = raw.select(F.col("id").alias("photo_id"), F.posexplode("found").alias("nth", "f"))
    return f.select("photo_id", "nth", F.col("f.x").alias("bbox_x"), F.col("f.y").alias("bbox_y"), F.col("f.w").alias("bbox_w"), F.col("f.h").alias("bbox_h"), "f.roll", "f.yaw", "f.pitch", "f.quality", "f.embedding", "f.model", F.size("f.embedding").alias("dim"), F.lit(None).cast("long").alias("person_id"), F.when(F.col("f.kind") == "pet", "pet").alias("kind"), F.lit(float(now)).alias("created_at"))
