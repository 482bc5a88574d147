"""Colour: conversions and differences as expressions, image statistics as kernels."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Linear sRGB to XYZ (D65), and the D65 white.
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)


def to_linear(c: Column) -> Column:
    """sRGB in 0..1 to linear light."""
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def lab(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """CIE L*, a*, b* of linear RGB."""

    def bent(i: int) -> Column:
        t = (r * TO_XYZ[i][0] + g * TO_XYZ[i][1] + b * TO_XYZ[i][2]) / WHITE[i]
        return F.when(t > (6 / 29) ** 3, F.cbrt(t)).otherwise(t * (841 / 108) + 4 / 29)

    x, y, z = map(bent, range(3))
    return {"L": 116 * y - 16, "a": 500 * (x - y), "b": 200 * (y - z)}


def delta_e(a: tuple, b: tuple) -> Column:
    """Euclidean difference of two (L, a, b)."""
    return F.sqrt(sum((x - y) * (x - y) for x, y in zip(a, b)))


def delta_e_2000(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """CIEDE2000 of Lab rows."""
    (l1, a1, b1), (l2, a2, b2) = np.moveaxis(np.asarray(one, float), -1, 0), np.moveaxis(np.asarray(two, float), -1, 0)
    shrink = lambda c: np.sqrt(c**7 / (c**7 + 25.0**7))
    g = 0.5 * (1 - shrink((np.hypot(a1, b1) + np.hypot(a2, b2)) / 2))
    a1, a2 = (1 + g) * a1, (1 + g) * a2
    c1, c2 = np.hypot(a1, b1), np.hypot(a2, b2)
    h1, h2 = np.degrees(np.arctan2(b1, a1)) % 360, np.degrees(np.arctan2(b2, a2)) % 360
    grey = c1 * c2 == 0
    turn = (h2 - h1 + 180) % 360 - 180
    turn = np.where(grey, 0.0, np.where((turn == -180) & (h2 > h1), 180.0, turn))
    hue = 2 * np.sqrt(c1 * c2) * np.sin(np.radians(turn / 2))
    mean_h = np.where(grey, h1 + h2, (h1 + h2) / 2 + np.where(np.abs(h1 - h2) > 180, np.where(h1 + h2 < 360, 180, -180), 0))
    mean_l, mean_c = (l1 + l2) / 2, (c1 + c2) / 2
    cos = lambda d: np.cos(np.radians(d))
    t = 1 - 0.17 * cos(mean_h - 30) + 0.24 * cos(2 * mean_h) + 0.32 * cos(3 * mean_h + 6) - 0.20 * cos(4 * mean_h - 63)
    sl = 1 + 0.015 * (mean_l - 50) ** 2 / np.sqrt(20 + (mean_l - 50) ** 2)
    sc, sh = 1 + 0.045 * mean_c, 1 + 0.015 * mean_c * t
    rt = -2 * shrink(mean_c) * np.sin(np.radians(60 * np.exp(-(((mean_h - 275) / 25) ** 2))))
    dl, dc, dh = (l2 - l1) / sl, (c2 - c1) / sc, hue / sh
    return np.sqrt(np.maximum(dl**2 + dc**2 + dh**2 + rt * dc * dh, 0))


def spread(rows: np.ndarray) -> dict[str, float]:
    """Mean and largest pairwise CIEDE2000 of Lab rows, and the mean from their centre."""
    rows = np.asarray(rows, float)
    i, j = np.triu_indices(len(rows), 1)
    if not len(i):
        return {"mean": math.nan, "max": math.nan, "centroid": math.nan}
    pairs = delta_e_2000(rows[i], rows[j])
    centre = delta_e_2000(rows, np.broadcast_to(rows.mean(axis=0), rows.shape))
    return {"mean": float(pairs.mean()), "max": float(pairs.max()), "centroid": float(centre.mean())}


def unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v)
    return v / n if n > 0 else np.full(3, 1 / math.sqrt(3))


def _masked(image: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
    flat = image.reshape(-1, 3).astype(float)
    return flat if mask is None else flat[mask.ravel()]


def grey_world(image: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    return unit(_masked(image, mask).mean(axis=0))


def max_rgb(image: np.ndarray, mask: np.ndarray | None = None, percentile: float = 99.0) -> np.ndarray:
    return unit(np.percentile(_masked(image, mask), percentile, axis=0))


def shades_of_grey(image: np.ndarray, mask: np.ndarray | None = None, p: float = 6.0) -> np.ndarray:
    return unit((_masked(image, mask) ** p).mean(axis=0) ** (1 / p))


def _blurred(channel: np.ndarray, sigma: float) -> np.ndarray:
    reach = max(1, round(3 * sigma))
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma**2))
    kernel /= kernel.sum()
    for axis in (0, 1):
        padded = np.pad(channel, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        channel = np.apply_along_axis(np.convolve, axis, padded, kernel, "valid")
    return channel


def grey_edge(image: np.ndarray, mask: np.ndarray | None = None, order: int = 1, p: float = 6.0, sigma: float = 1.0) -> np.ndarray:
    """p-norm of first or second derivatives of the smoothed channels."""
    sides = []
    for c in range(3):
        smooth = _blurred(image[..., c].astype(float), sigma)
        dy, dx = np.gradient(smooth)
        if order == 2:
            dyy, dxy = np.gradient(dy)
            _, dxx = np.gradient(dx)
            sides.append(np.sqrt(dxx**2 + 4 * dxy**2 + dyy**2))
        else:
            sides.append(np.hypot(dx, dy))
    return unit((_masked(np.stack(sides, axis=-1), mask) ** p).mean(axis=0) ** (1 / p))


def robust_colour(pixels: np.ndarray, low: float = 20.0, high: float = 80.0) -> np.ndarray:
    """Mean of the pixels whose luminance lies between two percentiles."""
    light = pixels.mean(axis=1)
    a, b = np.percentile(light, (low, high))
    return pixels[(light >= a) & (light <= b)].mean(axis=0)


class ReflectancePrior:
    """What a reference surface reflects, learned as the median log ratio of its colour to the illuminant; by key where
    a key has two samples, else over all."""

    def __init__(self, neutral: bool = False):
        self.neutral, self.everywhere, self.by_key = neutral, np.full(3, 1.0), {}

    def fit(self, colours: np.ndarray, illuminants: np.ndarray, keys: list | None = None) -> ReflectancePrior:
        if self.neutral:
            return self
        logs = np.log(np.maximum(colours, 1e-9) / np.maximum(illuminants, 1e-9))
        logs = logs - logs.mean(axis=1, keepdims=True)
        self.everywhere = np.exp(np.median(logs, axis=0))
        for key in set(keys or []):
            mine = np.array([k == key for k in keys])
            if mine.sum() >= 2:
                self.by_key[key] = np.exp(np.median(logs[mine], axis=0))
        return self

    def illuminant(self, colour: np.ndarray, key=None) -> np.ndarray:
        """The illuminant direction that explains a colour of the surface."""
        return unit(np.asarray(colour, float) / self.by_key.get(key, self.everywhere))


def components(mask: np.ndarray) -> np.ndarray:
    """8-connected component numbers from 1, 0 outside, by repeated minima of neighbours."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    big = mask.size + 1
    while True:
        padded = np.pad(np.where(mask, label, big), 1, constant_values=big)
        h, w = mask.shape
        low = np.min([padded[i : i + h, j : j + w] for i in range(3) for j in range(3)], axis=0)
        low = np.where(mask, low, 0)
        if (low == label).all():
            return np.unique(label, return_inverse=True)[1].reshape(mask.shape) if not mask.all() else np.ones_like(label)
        label = low


def highlights(image: np.ndarray, region: np.ndarray, least: int = 6, most_share: float = 0.10, percentile: float = 99.0, ratio: float = 3.0, saturated: int = 250) -> list[dict]:
    """Bright blobs inside a region: both in its top percentile and ``ratio`` times its median luminance."""
    light = image.max(axis=2).astype(float)
    if region.sum() < 200:
        return []
    cut_at = max(ratio * float(np.median(light[region])), float(np.percentile(light[region], percentile)))
    bright = region & (light >= cut_at)
    if bright.sum() < least:
        return []
    label, out = components(bright), []
    for k in range(1, label.max() + 1):
        pixels = image[label == k].astype(float)
        if not least <= len(pixels) <= most_share * region.sum():
            continue
        open_ = pixels[(pixels < saturated).all(axis=1)]
        out.append({"area": len(pixels), "mean": pixels.mean(axis=0), "saturated": 1 - len(open_) / len(pixels), "unsaturated": open_.mean(axis=0) if len(open_) >= 4 else None})
    return out


def dichromatic_normal(pixels: np.ndarray) -> np.ndarray | None:
    """Normal of the plane through black that holds a surface's body and highlight colours; None if it is not planar."""
    if len(pixels) < 3:
        return None
    _, s, v = np.linalg.svd(np.asarray(pixels, float), full_matrices=False)
    return v[2] if s[0] > 0 and s[1] > 1e-6 * s[0] else None


def plane_illuminant(normals: list[np.ndarray]) -> np.ndarray | None:
    """The direction that all dichromatic planes share, as a positive unit colour."""
    if len(normals) < 2:
        return None
    _, s, v = np.linalg.svd(np.array(normals), full_matrices=False)
    if s[1] < 0.02 * s[0]:  # planes that are all but one
        return None
    direction = v[2] if len(v) > 2 else np.cross(v[0], v[1])
    direction = direction * np.sign(direction.sum() or 1)
    return unit(np.maximum(direction, 0)) if (direction > -0.05).all() else None


def confusion(truth: np.ndarray, label: np.ndarray, k: int) -> np.ndarray:
    return np.bincount(truth.ravel() * k + label.ravel(), minlength=k * k).reshape(k, k)


def overlap_scores(counts: np.ndarray) -> dict[str, np.ndarray]:
    """IoU and Dice by class; NaN for a class that neither has."""
    hit, rows, cols = np.diag(counts).astype(float), counts.sum(axis=1), counts.sum(axis=0)
    either = rows + cols - hit
    with np.errstate(invalid="ignore", divide="ignore"):
        return {"iou": np.where(either > 0, hit / either, np.nan), "dice": np.where(rows + cols > 0, 2 * hit / (rows + cols), np.nan)}


def vessel_free(image: np.ndarray, mask: np.ndarray, percentile: float = 75.0) -> np.ndarray:
    """The mask without its reddest pixels: red over green and blue above the mask's own percentile."""
    red = image[..., 0] / np.maximum(image[..., 1] + image[..., 2], 1e-6)
    return mask & (red <= np.percentile(red[mask], percentile)) if mask.any() else mask


def region_quality(image: np.ndarray, mask: np.ndarray, saturated: float = 250.0, enough: int = 2000) -> dict[str, float]:
    """Shares from 0 to 1 (area, exposure, evenness) of a region, and their product."""
    pixels = image[mask].astype(float)
    if not len(pixels):
        return {"area": 0.0, "exposure": 0.0, "evenness": 0.0, "score": 0.0}
    light = pixels.mean(axis=1)
    area = min(1.0, len(pixels) / enough)
    exposure = float(((pixels < saturated).all(axis=1) & (light > 10)).mean())
    evenness = float(1 / (1 + light.std() / max(light.mean(), 1e-6)))
    return {"area": area, "exposure": exposure, "evenness": evenness, "score": area * exposure * evenness}


def halves(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A region left and right of its median column."""
    columns = np.nonzero(mask)[1]
    side = np.arange(mask.shape[1])[None] <= (np.median(columns) if len(columns) else 0)
    return mask & side, mask & ~side


def grown(mask: np.ndarray, by: int) -> np.ndarray:
    """A mask dilated (by > 0) or eroded (by < 0) with a 3 x 3 square."""
    out = mask if by >= 0 else ~mask
    h, w = mask.shape
    for _ in range(abs(by)):
        padded = np.pad(out, 1)
        out = np.any([padded[i : i + h, j : j + w] for i in range(3) for j in range(3)], axis=0)
    return out if by >= 0 else ~out


def centre_crop(image: np.ndarray, share: float) -> np.ndarray:
    h, w = image.shape[:2]
    ch, cw = max(1, round(h * share)), max(1, round(w * share))
    return image[(h - ch) // 2 : (h - ch) // 2 + ch, (w - cw) // 2 : (w - cw) // 2 + cw]


def near_black(image: np.ndarray, below: float = 8.0) -> float:
    return float((image.max(axis=2) < below).mean())


def chroma_clusters(colours: list[np.ndarray], tolerance: float = 0.04) -> int:
    """Groups of chromaticities in order: a colour joins the first group whose running mean is within the tolerance."""
    groups: list[list[np.ndarray]] = []
    for c in colours:
        chroma = np.asarray(c, float) / max(float(np.sum(c)), 1e-9)
        home = next((g for g in groups if np.linalg.norm(np.mean(g, axis=0) - chroma) <= tolerance), None)
        if home is None:
            groups.append([chroma])
        else:
            home.append(chroma)
    return len(groups)


def channel_shares(r: Column, g: Column, b: Column) -> list[Column]:
    """Channels over their sum, null for black."""
    return [F.try_divide(c, r + g + b) for c in (r, g, b)]
