"""Image enhancement over arrays of bytes (height x width, or x 3), and its application to files. numpy alone; filters
reflect at borders without repeating the edge pixel."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Image = np.ndarray


def decode(data: bytes) -> Image:
    """Binary PGM or PPM of depth 255."""
    head = re.match(rb"P([56])\s(?:#.*\n)*\s*(\d+)\s+(\d+)\s+255\s", data)
    if head is None:
        raise ValueError("not a PGM or PPM picture")
    width, height, planes = int(head[2]), int(head[3]), 1 if head[1] == b"5" else 3
    flat = np.frombuffer(data, np.uint8, width * height * planes, head.end())
    return flat.reshape((height, width) if planes == 1 else (height, width, 3))


def encode(image: Image) -> bytes:
    kind = b"P5" if image.ndim == 2 else b"P6"
    return kind + f"\n{image.shape[1]} {image.shape[0]}\n255\n".encode() + np.ascontiguousarray(image).tobytes()


def gray(image: Image) -> Image:
    """Luma 0.299, 0.587, 0.114."""
    return image if image.ndim == 2 else np.rint(image @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def _clip(values: Image) -> Image:
    return np.clip(np.rint(values), 0, 255).astype(np.uint8)


def gaussian(image: Image, size: int, sigma: float = 0.0) -> Image:
    """Separable Gaussian as floats; sigma 0 derives it from the size."""
    sigma = sigma or 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    at = np.arange(size) - size // 2
    kernel = np.exp(-(at**2) / (2 * sigma**2))
    kernel /= kernel.sum()
    padded = np.pad(image.astype(float), size // 2, "reflect")
    rows = sum(k * padded[i : i + image.shape[0]] for i, k in enumerate(kernel))
    return sum(k * rows[:, i : i + image.shape[1]] for i, k in enumerate(kernel))


def otsu(image: Image) -> int:
    """The level that parts the histogram with the largest variance between classes."""
    counts = np.bincount(image.ravel(), minlength=256).astype(float)
    below, total = np.cumsum(counts), counts.sum()
    mass = np.cumsum(counts * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (mass[-1] * below / total - mass) ** 2 / (below * (total - below))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def binarize(image: Image, method: str = "adaptive", block: int = 11, offset: int = 2) -> Image:
    """White above Otsu's level, or above the local Gaussian mean less the offset (any other method)."""
    level = otsu(image) if method == "otsu" else _clip(gaussian(image, block)).astype(int) - offset
    return np.where(image > level, 255, 0).astype(np.uint8)


def rotate(image: Image, degrees: float) -> Image:
    """Turned clockwise about the middle, nearest pixel, the canvas grown so that nothing is cut; black outside."""
    h, w = image.shape[:2]
    c, s = np.cos(np.deg2rad(degrees)), np.sin(np.deg2rad(degrees))
    nh, nw = int(h * abs(c) + w * abs(s)), int(h * abs(s) + w * abs(c))
    dy, dx = np.arange(nh)[:, None] - (nh - 1) / 2, np.arange(nw) - (nw - 1) / 2
    sx, sy = np.rint(c * dx + s * dy + (w - 1) / 2).astype(int), np.rint(c * dy - s * dx + (h - 1) / 2).astype(int)
    inside = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    out = np.zeros((nh, nw, *image.shape[2:]), np.uint8)
    out[inside] = image[sy[inside], sx[inside]]
    return out


def skew(image: Image, limit: int = 5, delta: int = 1) -> int:
    """The first angle whose row sums of ink differ most from row to row."""
    g = gray(image)
    ink = np.where(g > otsu(g), 0, 255).astype(np.uint8)
    angles = range(-limit, limit + 1, delta)
    return max(angles, key=lambda a: (np.diff(rotate(ink, a).sum(1, dtype=np.int64)) ** 2).sum())


def deskew(image: Image) -> Image:
    angle = skew(image)
    return rotate(image, angle) if abs(angle) >= 0.5 else image


def equalize(image: Image, clip: float = 2.0, tiles: int = 8) -> Image:
    """Contrast-limited equalisation: a clipped histogram's map per tile, blended bilinearly between tile centres."""
    h, w = image.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    padded = np.pad(image, ((0, th * tiles - h), (0, tw * tiles - w)), "symmetric")
    tile = (np.arange(th * tiles) // th * tiles)[:, None] + np.arange(tw * tiles) // tw
    counts = np.bincount((tile * 256 + padded).ravel(), minlength=tiles**2 * 256).reshape(tiles, tiles, 256).astype(float)
    most = max(clip * th * tw / 256, 1.0)
    spare = np.maximum(counts - most, 0).sum(axis=2, keepdims=True)
    maps = np.cumsum(np.minimum(counts, most) + spare / 256, axis=2) * 255 / (th * tw)

    def between(n: int, size: int) -> tuple[Image, Image, Image]:
        at = (np.arange(n) + 0.5) / size - 0.5
        low = np.floor(at).astype(int)
        return np.clip(low, 0, tiles - 1), np.clip(low + 1, 0, tiles - 1), at - low

    (y0, y1, fy), (x0, x1, fx) = between(h, th), between(w, tw)
    fy, look = fy[:, None], lambda a, b: maps[a[:, None], b[None, :], image]
    return _clip((1 - fy) * ((1 - fx) * look(y0, x0) + fx * look(y0, x1)) + fy * ((1 - fx) * look(y1, x0) + fx * look(y1, x1)))


def _run_sums(values: Image, size: int, step: int) -> Image:
    """From each place of flat values on, the sum of `size` values that lie `step` apart, by sums of half as many and what is
    left: whole numbers stay exact."""
    n = len(values) - (size - 1) * step
    out, begin, width, part = None, 0, 1, values
    while width <= size:
        if size & width:
            piece = part[begin * step : begin * step + n]
            out, begin = (piece if out is None else out + piece), begin + width
        if (width := 2 * width) <= size:
            part = part[: -(width // 2) * step] + part[width // 2 * step :]
    return out


@lru_cache(maxsize=4)
def _likeness(strength: float, patch: int) -> Image:
    """The weight of each sum of squares by which two patches can differ, as far as a weight is above zero."""
    most = min(patch**2 * 255**2, math.ceil(746 * strength**2 * patch**2))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.exp(np.arange(most + 1) / patch**2 / -(strength**2))


def denoise(image: Image, strength: float = 7.0, patch: int = 7, search: int = 21) -> Image:
    """Non-local means: pixels weighted by the likeness of their patches, shift by shift, so memory is a few images. Two pixels
    weigh the same for each other, so half of the shifts give the weights of all; sums of squares are whole numbers, so their
    weights are looked up. The padded image is flat, and a shift in it is one step; what runs over its rows' ends is cut off."""
    h, w, half, p = *image.shape, search // 2, patch // 2
    src = np.pad(image.astype(np.int32), half + p, "reflect" if min(h, w) > half + p else "symmetric")
    wide, src, like = src.shape[1], src.ravel(), _likeness(strength, patch)
    edge, first = p * (wide + 1), (half + p) * (wide + 1)
    last = first + (h - 1) * wide + w
    levels = src.astype(float)
    total, weights = levels[first:last].copy(), np.ones(last - first)
    for dy, dx in np.ndindex(half + 1, 2 * half + 1):
        if (step := dy * wide + dx - half) <= 0:
            continue
        off = src[first - edge : last + edge + step] - src[first - edge - step : last + edge]
        off *= off
        weight = like.take(_run_sums(_run_sums(off, patch, 1), patch, wide), mode="clip")
        ahead, behind = weight[step:], weight[: last - first]
        weights += ahead
        weights += behind
        total += ahead * levels[first + step : last + step]
        total += behind * levels[first - step : last - step]
    return _clip(np.append(total / weights, np.zeros(wide - w)).reshape(h, wide)[:, :w])


def sharpen(image: Image, size: int = 5, sigma: float = 1.0, amount: float = 1.0, threshold: int = 0) -> Image:
    """Unsharp mask; pixels that differ from the blurred image by less than the threshold stay."""
    blurred = gaussian(image, size, sigma)
    out = _clip((amount + 1) * image - amount * blurred)
    return np.where(np.abs(image - blurred) < threshold, image, out) if threshold > 0 else out


def adjust(image: Image, brightness: int = 0, contrast: int = 0) -> Image:
    """Linear maps of -100 to 100 each."""
    if brightness:
        low, high = max(brightness, 0), 255 + min(brightness, 0)
        image = _clip(image * ((high - low) / 255) + low)
    if contrast:
        a = 131 * (contrast + 127) / (127 * (131 - contrast))
        image = _clip(image * a + 127 * (1 - a))
    return image


def rgb(image: Image) -> Image:
    """Three planes, whatever the picture has."""
    return np.repeat(image[:, :, None], 3, axis=2) if image.ndim == 2 else image[:, :, :3]


def _groups(mask: Image) -> list[Image]:
    """Flat places of the 8-connected groups of set pixels."""
    width = mask.shape[1] + 2
    left, out = set(np.flatnonzero(np.pad(mask, 1)).tolist()), []
    around = [-width - 1, -width, -width + 1, -1, 1, width - 1, width, width + 1]
    while left:
        group = [left.pop()]
        for at in group:
            for step in around:
                if at + step in left:
                    left.remove(at + step)
                    group.append(at + step)
        rows, cols = np.divmod(np.array(sorted(group)), width)
        out.append((rows - 1) * mask.shape[1] + cols - 1)
    return out


def canny(image: Image, low: float = 75, high: float = 200) -> Image:
    """Edges: Sobel gradients (sum of magnitudes), thinned across the edge; weak ones stay if a strong one is connected."""
    p = np.pad(image.astype(float), 1, "edge")
    h, w = image.shape
    at = lambda i, j: p[1 + i : 1 + i + h, 1 + j : 1 + j + w]
    gx = at(-1, 1) + 2 * at(0, 1) + at(1, 1) - at(-1, -1) - 2 * at(0, -1) - at(1, -1)
    gy = at(1, -1) + 2 * at(1, 0) + at(1, 1) - at(-1, -1) - 2 * at(-1, 0) - at(-1, 1)
    size = np.abs(gx) + np.abs(gy)
    m = np.pad(size, 1)
    near = lambda i, j: m[1 + i : 1 + i + h, 1 + j : 1 + j + w]
    flat, steep = np.abs(gy) < 0.4142 * np.abs(gx), np.abs(gy) > 2.4142 * np.abs(gx)
    ahead = np.select([flat, steep, gx * gy > 0], [near(0, 1), near(1, 0), near(1, 1)], near(1, -1))
    behind = np.select([flat, steep, gx * gy > 0], [near(0, -1), near(-1, 0), near(-1, -1)], near(-1, 1))
    thin = (size > low) & (size > behind) & (size >= ahead)
    edges = np.zeros(h * w, bool)
    for group in _groups(thin):
        if (size.ravel()[group] > high).any():
            edges[group] = True
    return edges.reshape(h, w)


def _enclosed(mask: Image) -> int:
    """Pixels of a group and of all that it surrounds."""
    free = np.pad(~mask, 1, constant_values=True)
    outside = np.zeros_like(free)
    outside[0] = outside[-1] = True
    outside[:, 0] = outside[:, -1] = True
    was = -1
    while (now := int(outside.sum())) != was:
        was = now
        for view, ok in ((outside, free), (outside[::-1], free[::-1]), (outside.T, free.T), (outside.T[::-1], free.T[::-1])):
            for k in range(1, len(view)):
                view[k] |= view[k - 1] & ok[k]
    return int((~outside).sum())


def cropped(image: Image, least: float = 0.1, margin: int = 10) -> Image:
    """The picture around its largest outline (by the area inside it) with a margin; as it is where there is none of a
    tenth of its area."""
    edges = canny(_clip(gaussian(gray(image), 5)))
    h, w = edges.shape
    best, box = 0, None
    for group in _groups(edges):
        rows, cols = np.divmod(group, w)
        y0, y1, x0, x1 = rows.min(), rows.max() + 1, cols.min(), cols.max() + 1
        if (y1 - y0) * (x1 - x0) <= max(best, least * h * w - 1):
            continue
        mask = np.zeros((y1 - y0, x1 - x0), bool)
        mask[rows - y0, cols - x0] = True
        if (area := _enclosed(mask)) > best:
            best, box = area, (y0, y1, x0, x1)
    if box is None or best < least * h * w:
        return image
    y0, y1, x0, x1 = box
    return image[max(0, y0 - margin) : y1 + margin, max(0, x0 - margin) : x1 + margin]


def median3(image: Image) -> Image:
    p = np.pad(image, 1, "edge")
    return np.median([p[i : i + image.shape[0], j : j + image.shape[1]] for i, j in np.ndindex(3, 3)], 0).astype(np.uint8)


def basic(image: Image, light: bool = False) -> Image:
    """Equalised and, unless light, median-filtered."""
    out = equalize(gray(image))
    return out if light else median3(out)


def enlarge(image: Image, least: int = 1000, factor: float = 1.5) -> Image:
    """Bilinearly enlarged if the longest side is below least."""
    h, w = image.shape
    if max(h, w) >= least:
        return image

    def at(n: int, new: int) -> tuple[Image, Image, Image]:
        x = np.clip((np.arange(new) + 0.5) / factor - 0.5, 0, n - 1)
        low = np.floor(x).astype(int)
        return low, np.minimum(low + 1, n - 1), x - low

    (y0, y1, fy), (x0, x1, fx) = at(h, int(h * factor)), at(w, int(w * factor))
    top, low = (image[r][:, x0] * (1 - fx) + image[r][:, x1] * fx for r in (y0, y1))
    return _clip(top * (1 - fy[:, None]) + low * fy[:, None])


def enhanced(image: Image) -> Image:
    """Cropped to the document, deskewed, gray, denoised, equalised, sharpened, enlarged if small."""
    return enlarge(sharpen(equalize(denoise(gray(deskew(cropped(image))), 5.0)), amount=0.8, threshold=5))


def apply(files: DataFrame, step: Callable[[Image], Image] = enhanced, read: Callable[[bytes], Image] = decode, write: Callable[[Image], bytes] = encode) -> DataFrame:
    """path, ok, error and the new content of files (path, content); a file that fails gives its error and no content.
    Pictures are handled one by one and are never shuffled."""
    return apply_each(files, {"": step}, read, write).drop("step")


def apply_each(files: DataFrame, steps: dict[str, Callable[[Image], Image]], read: Callable[[bytes], Image] = decode, write: Callable[[Image], bytes] = encode) -> DataFrame:
    """apply() of several steps, a row for each file and step with the step's name; files are read once for all of them."""

    def one(data: bytes, step: Callable[[Image], Image]) -> tuple[bool, str | None, bytes | None]:
        try:
            return True, None, write(step(read(data)))
        except Exception as e:  # one bad file must not end the job
            return False, f"{type(e).__name__}: {e}", None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, data in zip(f["path"], f["content"], strict=True):
                yield pd.DataFrame([(path, name, *one(data, step)) for name, step in steps.items()], columns=["path", "step", "ok", "error", "content"])

    return files.select("path", "content").mapInPandas(run, "path string, step string, ok boolean, error string, content binary")
