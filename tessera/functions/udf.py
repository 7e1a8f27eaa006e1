"""Plug-in points for external models: scorers over image bytes or columns, run as Arrow batches, one load for a worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score_with(frames: DataFrame, column: str, load: Callable[[], Callable[[pd.Series], np.ndarray]], source: str, batch: int = 96) -> DataFrame:
    """``column`` = the loaded model's score of ``source``; a failing batch scores 0 ("not run") and doesn't end the job."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for values in batches:
            out = np.zeros(len(values))
            for a in range(0, len(values), batch):
                part = values.iloc[a : a + batch]
                try:
                    scores = np.asarray(model(part), float)
                    if scores.shape == (len(part),):
                        out[a : a + batch] = scores
                except Exception:  # noqa: BLE001 - a model's failure is data: those rows stay "not run"
                    continue
            yield pd.Series(out)

    return frames.withColumn(column, run(F.col(source)))


def laplacian(image: np.ndarray) -> np.ndarray:
    """4-neighbour Laplacian; the border is mirrored without repeating its edge."""
    x = np.pad(image.astype(np.float64), 1, mode="reflect") if min(image.shape[:2]) > 1 else np.pad(image.astype(np.float64), 1, mode="edge")
    return x[:-2, 1:-1] + x[2:, 1:-1] + x[1:-1, :-2] + x[1:-1, 2:] - 4 * x[1:-1, 1:-1]


def laplacian_variance(image: np.ndarray) -> float:
    """Variance of the 4-neighbour Laplacian; 0 under 10 pixels a side."""
    return 0.0 if min(image.shape[:2]) < 10 else float(laplacian(image).var())


def box_sharpness(image: np.ndarray, x: int, y: int, w: int, h: int) -> tuple[float, float]:
    """(subject, background): the box by its own Laplacian, and the rest by the whole image's."""
    rest = np.ones(image.shape[:2], bool)
    rest[y : y + h, x : x + w] = False
    subject = image[y : y + h, x : x + w]
    return (float(laplacian(subject).var()) if subject.size else 0.0), (float(laplacian(image)[rest].var()) if rest.any() else 0.0)


def center_sharpness(image: np.ndarray) -> tuple[float, float]:
    """(subject, background): a box of a third of both sides around the centre, and the rest."""
    h, w = image.shape[:2]
    half_w, half_h = w // 3 // 2, h // 3 // 2
    return box_sharpness(image, w // 2 - half_w, h // 2 - half_h, 2 * half_w, 2 * half_h)


def saliency_sharpness(response: np.ndarray, saliency: np.ndarray, confidence: float) -> tuple[float, float]:
    """(subject, background) from a Laplacian response and a saliency map of the same shape.

    Over 0.3 confidence a hard mask of the most salient pixels is used, else variances weighted by saliency.
    """
    s = saliency / (saliency.sum() + 1e-10)
    if confidence > 0.3:
        share = max(5, int(30 - 40 * (confidence - 0.3)))
        mask = saliency >= np.percentile(saliency, 100 - share)
        if mask.mean() < 0.005:
            mask = saliency >= np.percentile(saliency, 60)
        return float(response[mask].var()), float(response[~mask].var()) if (~mask).any() else 0.0
    weighted = lambda w: float((w * response**2).sum() - (w * response).sum() ** 2)
    inverse = saliency.max() - saliency
    return weighted(s), weighted(inverse / (inverse.sum() + 1e-10))


def diversity_embedding(patches: np.ndarray, cls: np.ndarray | None) -> np.ndarray:
    """Unit parts [class token, patch mean, patch deviation]; without a class token [mean, deviation, layout].

    The layout is the difference of the upper left and lower right quadrants' means, then of the other two, cut to the
    width of a token.
    """
    unit = lambda v: v / (np.linalg.norm(v) + 1e-8)
    mean, std = unit(patches.mean(0)), unit(patches.std(0))
    if cls is not None:
        return np.concatenate([unit(cls), mean, std])
    side, width = int(np.sqrt(len(patches))), patches.shape[1]
    grid = patches[: side * side].reshape(side, side, width)
    half = side // 2
    middle = lambda q: q.reshape(-1, width).mean(0)
    layout = np.concatenate([middle(grid[:half, :half]) - middle(grid[half:, half:]), middle(grid[:half, half:]) - middle(grid[half:, :half])])
    return np.concatenate([mean, std, unit(layout[:width])])


def resize_normalize(image: np.ndarray, size: int = 518) -> np.ndarray:
    """Nearest-neighbour resize, scale to 0..1 and normalise by the usual channel statistics (fixed values)."""
    rows = np.arange(size) * image.shape[0] // size
    cols = np.arange(size) * image.shape[1] // size
    x = image[rows][:, cols].astype(np.float32) / 255
    return (x - np.array([0.485, 0.456, 0.406], np.float32)) / np.array([0.229, 0.224, 0.225], np.float32)


def tiles(image: np.ndarray, grid: tuple[int, int], size: int = 448) -> list[np.ndarray]:
    """The grid's tiles (columns, rows) of a resized image, row by row, and a thumbnail where there are several."""

    def resized(width: int, height: int) -> np.ndarray:
        rows, cols = np.arange(height) * image.shape[0] // height, np.arange(width) * image.shape[1] // width
        return image[rows][:, cols]

    whole = resized(grid[0] * size, grid[1] * size)
    out = [whole[i * size : (i + 1) * size, j * size : (j + 1) * size] for i in range(grid[1]) for j in range(grid[0])]
    return [*out, resized(size, size)] if len(out) > 1 else out


#: Columns of an image's analysis and their values where it failed.
ANALYSIS = {"has_face": False, "n_faces": 0, "subject_det_method": "error", "sharp_near_eye": 0.0, "sharp_far_eye": 0.0, "sharpness_subject": 0.0, "sharpness_background": 0.0, "isolation_ratio": 1.0, "raw_min_ear": 1.0, "eye_ratio_raw": 0.0, "blink_detected": False, "saliency_confidence": 0.0}
_ANALYSIS_DDL = "struct<" + ",".join(f"{k}:{ {bool: 'boolean', int: 'int', str: 'string', float: 'double'}[type(v)] }".replace(" ", "") for k, v in ANALYSIS.items()) + ">"


def _without_face(method: str, subject: float, background: float, confidence: float) -> dict:
    return ANALYSIS | {"subject_det_method": method, "sharp_near_eye": subject, "sharp_far_eye": subject, "sharpness_subject": subject, "sharpness_background": background, "isolation_ratio": subject / (background + 1e-6), "saliency_confidence": confidence}


def analyze_gray(gray: np.ndarray, faces: list[dict]) -> dict:
    """One image's row of ANALYSIS. A face has near, far, area, min_ear and box (x, y, width, height)."""
    if not faces:
        return _without_face("center", *center_sharpness(gray), 0.0)
    area = sum(f["area"] for f in faces)
    largest = max(faces, key=lambda f: f["area"])
    mean = lambda c: sum(f[c] * f["area"] for f in faces) / area
    near = 0.6 * mean("near") + 0.4 * min(f["near"] for f in faces if f["area"] > 0.10 * largest["area"])
    far = mean("far")
    subject, background = box_sharpness(gray, *largest["box"])
    found = {"has_face": True, "n_faces": len(faces), "subject_det_method": "face_mesh", "sharp_near_eye": near, "sharp_far_eye": far, "sharpness_subject": subject, "sharpness_background": background}
    return ANALYSIS | found | {"isolation_ratio": subject / (background + 1e-6), "raw_min_ear": min(f["min_ear"] for f in faces), "eye_ratio_raw": float(np.clip(near / (far + 1e-6) - 1, 0, 3)) * 0.1, "saliency_confidence": 1.0}


def stretched(grid: np.ndarray, height: int, width: int) -> np.ndarray:
    """A grid interpolated linearly to an image's size, cell centres on pixel centres."""
    out = grid
    for axis, n in enumerate((height, width)):
        m = grid.shape[axis]
        at = np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1)
        low = np.floor(at).astype(np.int64)
        share = (at - low).reshape((-1, 1) if axis == 0 else (1, -1))
        out = out.take(low, axis) * (1 - share) + out.take(np.minimum(low + 1, m - 1), axis) * share
    return out


def analyze_saliency(gray: np.ndarray, saliency: np.ndarray) -> dict:
    """The row of an image without faces, by its saliency map (a grid over the image)."""
    cells = saliency.astype(np.float64) / (saliency.sum() + 1e-10)
    confidence = float(np.clip(1 + (cells * np.log(cells + 1e-10)).sum() / np.log(cells.size), 0, 1))
    return _without_face("dino_attn", *saliency_sharpness(laplacian(gray), stretched(saliency.astype(np.float64), *gray.shape), confidence), confidence)


def analyze_images(frames: DataFrame, source: str, load: Callable[[], Callable[[object], dict]]) -> DataFrame:
    """The columns of ANALYSIS for every row by a function of ``source`` that each worker loads once.

    The function may call analyze_gray or analyze_saliency; a row that fails gets the error row and doesn't end the job.
    """

    @F.pandas_udf(_ANALYSIS_DDL)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        analyze = load()
        for values in batches:
            out = []
            for value in values:
                try:
                    out.append(ANALYSIS | analyze(value))
                except Exception:  # noqa: BLE001 - an image's failure is data
                    out.append(ANALYSIS)
            yield pd.DataFrame(out, columns=list(ANALYSIS))

    others = [c for c in frames.columns if c not in ANALYSIS]
    return frames.select(*others, run(F.col(source)).alias("_a")).select(*others, "_a.*")


def saliency_pass(frames: DataFrame, source: str, load: Callable[[], Callable[[object], dict]]) -> DataFrame:
    """Rows whose subject was taken from the centre are analysed again by a saliency map; the others stay as they are."""
    again = analyze_images(frames.where(F.col("subject_det_method") == "center"), source, load)
    rest = frames.where(~F.col("subject_det_method").eqNullSafe("center"))
    return rest.unionByName(again.select(*rest.columns))


def stub_scorer(name: str, low: float, high: float) -> Callable[[], Callable[[pd.Series], np.ndarray]]:
    """A stand-in for a model: a score within low..high fixed by the scorer's name and the value, the same everywhere."""

    def load() -> Callable[[pd.Series], np.ndarray]:
        import zlib

        return lambda values: np.array([low + (high - low) * zlib.crc32(f"{name}\0{v}".encode()) / 0xFFFFFFFF for v in values])

    return load
