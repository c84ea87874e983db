"""Scan preprocessing: one map over (path, width, height, pixels), pixels as row-major bytes. Steps are NumPy functions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the steps.
WHITE, BACKGROUND, BAND, EDGE, MARGIN = 248, 20, 0.18, 0.04, 0.2
FITS = ("squish", "letterbox", "width_crop")


@dataclass(frozen=True)
class PreConfig:
    width: int = 256
    height: int = 256
    crop: bool = True
    curvature: bool = True
    fit: str = "squish"

    def __post_init__(self) -> None:
        if self.fit not in FITS:
            raise ValueError(f"unknown fit {self.fit!r}; one of {FITS}")

    @property
    def tag(self) -> str:
        kind = "crop" if self.crop else "full"
        return f"{kind}_{'curv' if self.crop and self.curvature else 'flat'}_{self.fit}_{self.width}x{self.height}"


def border_white(image: np.ndarray, white: float = WHITE) -> np.ndarray:
    """Near-white pixels that near-white neighbours connect to the border, by flooding from there in sweeps.

    Like all steps, for one scan or a stack of scans of one size.
    """
    if image.ndim == 2:
        return border_white(image[None], white)[0]
    out = np.zeros(image.shape, bool)
    open_to = image >= white
    edge = open_to[:, [0, -1]].any(axis=(1, 2)) | open_to[:, :, [0, -1]].any(axis=(1, 2))
    if not edge.any():
        return out
    rows_first = np.ascontiguousarray(open_to[edge].transpose(1, 0, 2))
    flood = np.zeros_like(rows_first)
    flood[[0, -1]], flood[:, :, [0, -1]] = rows_first[[0, -1]], rows_first[:, :, [0, -1]]
    reached = -1
    while (now := int(flood.sum())) != reached:
        reached = now
        for axes in ((0, 1, 2), (2, 1, 0)):
            view, free = np.ascontiguousarray(flood.transpose(axes)), np.ascontiguousarray(rows_first.transpose(axes))
            for line in (range(1, len(view)), range(len(view) - 2, -1, -1)):
                for k in line:
                    view[k] |= view[k - line.step] & free[k]
            flood = view.transpose(axes)
    out[edge] = flood.transpose(1, 0, 2)
    return out


def bands(images: np.ndarray) -> np.ndarray:
    """First and last row of the longest run of bright rows of each scan, the outer rows left out."""
    n = images.shape[1]
    width = max(3, n // 60)
    level = np.stack([np.convolve(rows, np.full(width, 1 / width), mode="same") for rows in images.mean(axis=2)])
    low, high = int(EDGE * n), int((1 - EDGE) * n)
    floor = np.percentile(level, BACKGROUND, axis=1)
    bright = np.zeros((len(images), n + 2), np.int8)
    bright[:, 1 + low : 1 + high] = level[:, low:high] > (floor + BAND * (level[:, low:high].max(axis=1, initial=-np.inf) - floor))[:, None]
    out = np.tile([0, -1], (len(images), 1))
    for k, turn in enumerate(np.diff(bright, axis=1)):
        starts, stops = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        if len(starts):
            longest = int(np.argmax(stops - starts))
            out[k] = starts[longest], stops[longest] - 1
    return out


def band(image: np.ndarray) -> tuple[int, int]:
    first, last = bands(image[None])[0]
    return int(first), int(last)


def cuts(dark: np.ndarray, found: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, stack) of scans that are cut to their band with a margin, by size."""
    extra = (MARGIN * (found[:, 1] - found[:, 0] + 1)).astype(int)
    first, stop = np.maximum(0, found[:, 0] - extra), np.minimum(found[:, 1] + 1 + extra, dark.shape[1])
    height = np.maximum(stop - first, 0)
    out = []
    for h in np.unique(height):
        at = np.flatnonzero(height == h)
        out.append((at, dark[at[:, None], first[at, None] + np.arange(h)]))
    return out


def crop_band(image: np.ndarray) -> np.ndarray:
    dark = np.where(border_white(image), 0.0, image)[None]
    return cuts(dark, bands(dark))[0][1][0]


def ground_of(images: np.ndarray) -> np.ndarray:
    return np.percentile(images, BACKGROUND, axis=(-2, -1), keepdims=True)


def straighten(image: np.ndarray, degree: int = 3) -> np.ndarray:
    """Columns moved so that the fitted centre of brightness lies level; what is laid open is background."""
    ground = ground_of(image)
    light = np.maximum(image - ground, 0)
    rows = np.arange(image.shape[-2])[:, None]
    centre = (light * rows).sum(axis=-2) / (light.sum(axis=-2) + 1e-6)
    x = np.arange(image.shape[-1])
    terms = np.polyfit(x, centre.T, degree)
    curve = np.zeros_like(centre)
    for term in terms:
        curve = curve * x + term[..., None]
    source = rows - np.round(curve.mean(axis=-1, keepdims=True) - curve).astype(int)[..., None, :]
    inside = (source >= 0) & (source < image.shape[-2])
    return np.where(inside, np.take_along_axis(image, np.clip(source, 0, image.shape[-2] - 1), axis=-2), ground)


def stretch(image: np.ndarray) -> np.ndarray:
    low, high = np.percentile(image, [1, 99], axis=(-2, -1), keepdims=True)
    return np.clip((image - low) / (high - low + 1e-6), 0, 1)


@lru_cache(maxsize=256)
def weights(old: int, new: int) -> np.ndarray:
    step = old / new
    reach = max(step, 1.0)
    at = (np.arange(new) + 0.5) * step - 0.5
    w = np.maximum(0, 1 - np.abs(np.arange(old)[None, :] - at[:, None]) / reach)
    return w / w.sum(axis=1, keepdims=True)


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, with the area of a source pixel averaged when shrinking (by a triangle as wide as the step)."""
    return weights(image.shape[-2], height) @ image @ weights(image.shape[-1], width).T


def fit_frame(image: np.ndarray, width: int, height: int, fit: str) -> np.ndarray:
    h, w = image.shape[-2:]
    if fit == "squish":
        return resize(image, width, height)
    if fit == "letterbox":
        scale = min(width / w, height / h)
        inner = resize(image, max(1, int(w * scale)), max(1, int(h * scale)))
        out = np.zeros((*image.shape[:-2], height, width))
        y, x = (height - inner.shape[-2]) // 2, (width - inner.shape[-1]) // 2
        out[..., y : y + inner.shape[-2], x : x + inner.shape[-1]] = inner
        return out
    if fit == "width_crop":
        keep = min(w, int(h * width / height))
        x = (w - keep) // 2
        return resize(image[..., x : x + keep], width, height)
    raise ValueError(f"unknown fit {fit!r}; one of {FITS}")


def framed(image: np.ndarray, config: PreConfig) -> np.ndarray:
    return np.clip(fit_frame(stretch(image) * 255, config.width, config.height, config.fit) / 255, 0, 1)


def preprocess(image: np.ndarray, config: PreConfig) -> np.ndarray:
    """A grey image 0..255 to a frame 0..1."""
    if image.ndim == 2:
        return preprocess(image[None], config)[0]
    if not config.crop:
        return framed(np.where(border_white(image), ground_of(image), image), config)
    dark = np.where(border_white(image), 0.0, image)
    out = np.zeros((len(image), config.height, config.width))
    for at, cut in cuts(dark, bands(dark)):
        if cut.size:
            out[at] = framed(straighten(cut) if config.curvature else cut, config)
    return out


#: Rows of a batch, and pixels of the scans that are worked off at once; a larger scan goes alone.
SLICE, STACK_PIXELS = 256, 1 << 19


def stacks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, stack) of a batch's scans (width, height, _pixels) by size, a bounded number at a time. Those whose bytes are missing or not width x height are left out."""
    w, h = (batch[c].fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("width", "height"))
    long = pc.binary_length(batch["_pixels"]).fill_null(0).to_numpy(zero_copy_only=False)
    whole = np.flatnonzero((w > 0) & (h > 0) & (long == w * h))
    sizes, group = np.unique(np.stack([w[whole], h[whole]]), axis=1, return_inverse=True)
    for k, (width, height) in enumerate(sizes.T.tolist()):
        at = whole[group.reshape(-1) == k]
        step = max(1, STACK_PIXELS // (width * height))
        for start in range(0, len(at), step):
            some = at[start : start + step]
            raw = b"".join(batch["_pixels"].take(pa.array(some)).to_pylist())
            yield some, np.frombuffer(raw, np.uint8).reshape(len(some), height, width).astype(float)


def preprocess_images(scans: DataFrame, config: PreConfig, keep: list[str]) -> DataFrame:
    """`keep`, white_share, tag and pixels (bytes of the frame) of every scan (width, height, pixels). Map-only, scans of one size together.

    A scan whose bytes are missing or not width x height has null pixels.
    """
    rows = scans.select(*keep, "width", "height", F.col("pixels").alias("_pixels"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                share, made = [None] * part.num_rows, [None] * part.num_rows
                for at, images in stacks(part):
                    frames = np.round(preprocess(images, config) * 255).astype(np.uint8)
                    for k, white, frame in zip(at.tolist(), (images >= WHITE).mean(axis=(1, 2)).tolist(), frames, strict=True):
                        share[k], made[k] = white, frame.tobytes()
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(share, pa.float64()), pa.array([config.tag] * part.num_rows), pa.array(made, pa.binary())], names=[*keep, "white_share", "tag", "pixels"])

    kept = ", ".join(f"`{c}` {scans.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{kept}, white_share double, tag string, pixels binary")


def sway(image: np.ndarray) -> np.ndarray:
    """How far a column's centre of brightness lies from the columns' mean at most, in rows."""
    light = np.maximum(image - ground_of(image), 0)
    centre = (light * np.arange(image.shape[-2])[:, None]).sum(axis=-2) / (light.sum(axis=-2) + 1e-6)
    return np.abs(centre - centre.mean(axis=-1, keepdims=True)).max(axis=-1)


def step_report(scans: DataFrame, config: PreConfig, keep: list[str]) -> DataFrame:
    """What each step makes of a scan, to look bad scans up by: `keep`, band_first and band_last (rows of the band), n_rows (after the crop),
    sway_before and sway_after (straightening), low and high (least and greatest byte of the frame), top and bottom (the frame's rows that are not black). Map-only.

    A scan whose bytes are missing or not width x height has nulls.
    """
    rows = scans.select(*keep, "width", "height", F.col("pixels").alias("_pixels"))
    names = ["band_first", "band_last", "n_rows", "sway_before", "sway_after", "low", "high", "top", "bottom"]
    kinds = [pa.float64() if n.startswith("sway") else pa.int64() for n in names]

    def measured(images: np.ndarray) -> Iterator[tuple[int, list]]:
        """Place and report of each scan of a stack."""
        white = border_white(images)
        dark = np.where(white, 0.0, images)
        found = bands(dark)
        for at, cut in cuts(dark, found) if config.crop else [(np.arange(len(images)), images)]:
            level = straighten(cut) if cut.size else cut
            if not cut.size:
                frames = np.zeros((len(at), config.height, config.width))
            elif config.crop:
                frames = framed(level if config.curvature else cut, config)
            else:
                frames = framed(np.where(white, ground_of(images), images), config)
            frames = np.round(frames * 255).astype(int)
            sways = zip(sway(cut).tolist(), sway(level).tolist(), strict=True) if cut.size else [(None, None)] * len(at)
            for k, both, low, high, lit in zip(at.tolist(), sways, frames.min(axis=(1, 2)).tolist(), frames.max(axis=(1, 2)).tolist(), frames.any(axis=2), strict=True):
                on = np.flatnonzero(lit).tolist()
                yield k, [*found[k].tolist(), cut.shape[1], *both, low, high, *((on[0], on[-1]) if on else (None, None))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                got = [[None] * len(names)] * part.num_rows
                for at, images in stacks(part):
                    for k, line in measured(images):
                        got[at[k]] = line
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *(pa.array(x, t) for x, t in zip(zip(*got, strict=True), kinds, strict=True))], names=[*keep, *names])

    kept = ", ".join(f"`{c}` {scans.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{kept}, {', '.join(f'{n} double' if n.startswith('sway') else f'{n} bigint' for n in names)}")


def build_cache(scans: DataFrame, config: PreConfig, path: str) -> None:
    """Preprocessed scans (name, label, split, width, height, pixels) as one Parquet folder per tag and split."""
    preprocess_images(scans, config, ["name", "label", "split"]).write.mode("append").partitionBy("tag", "split").parquet(path)
