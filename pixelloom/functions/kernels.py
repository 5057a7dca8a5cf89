"""Numpy kernels over one decoded 8-bit image, shape (height, width, channels), channel order B,G,R."""

from __future__ import annotations

import numpy as np

#: tan(22.5 degrees) in 15-bit fixed point, for the gradient direction test.
TAN_22 = 13573


def decoded(image: dict | None) -> np.ndarray | None:
    """The samples of an image struct, or None: no payload, no size, or fewer bytes than the size needs."""
    if image is None or image["data"] is None or min(image["width"] or -1, image["height"] or -1, image["nChannels"] or -1) <= 0:
        return None
    if len(image["data"]) < image["height"] * image["width"] * image["nChannels"]:
        return None
    return pixels(image["data"], image["height"], image["width"], image["nChannels"])


def pixels(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint8)[: height * width * channels].reshape(height, width, channels)


def gray(px: np.ndarray) -> np.ndarray:
    """Luma rounded to 8 bits; one-channel input passes through."""
    if px.shape[2] < 3:
        return px[:, :, 0]
    b, g, r = (px[:, :, c].astype(np.int32) for c in range(3))
    return ((114 * b + 587 * g + 299 * r + 500) // 1000).astype(np.uint8)


def saturation_sum(px: np.ndarray) -> int:
    c = px[:, :, :3].astype(np.int32)
    hi, lo = c.max(axis=2), c.min(axis=2)
    return int(np.where(hi > 0, (510 * (hi - lo) + hi) // np.maximum(2 * hi, 1), 0).sum())


def laplacian_sums(g: np.ndarray) -> tuple[int, int]:
    """Sum and sum of squares of the four-neighbour Laplacian with mirrored borders (edge pixel not repeated)."""
    p = np.pad(g.astype(np.int64), [(1, 1) if n > 1 else (0, 0) for n in g.shape], mode="reflect")
    p = np.pad(p, [(0, 0) if n > 1 else (1, 1) for n in g.shape], mode="edge")
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]
    return int(lap.sum()), int((lap * lap).sum())


def edge_count(g: np.ndarray, low: int = 100, high: int = 200) -> int:
    """Canny: Sobel gradients, non-maximum suppression, double threshold, 8-connected hysteresis."""
    h, w = g.shape
    p = np.pad(g.astype(np.int64), 1, mode="edge")
    tl, tc, tr = p[:-2, :-2], p[:-2, 1:-1], p[:-2, 2:]
    ml, mr = p[1:-1, :-2], p[1:-1, 2:]
    bl, bc, br = p[2:, :-2], p[2:, 1:-1], p[2:, 2:]
    gx = tr + 2 * mr + br - tl - 2 * ml - bl
    gy = bl + 2 * bc + br - tl - 2 * tc - tr
    ax, ay = np.abs(gx), np.abs(gy)
    mag = ax + ay
    m = np.pad(mag, 1)
    at = lambda dy, dx: m[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    flat = ay * 32768 < ax * TAN_22
    steep = ay * 32768 > ax * TAN_22 + ax * 65536
    falling = (gx ^ gy) < 0
    along = (mag > at(0, -1)) & (mag >= at(0, 1))
    across = (mag > at(-1, 0)) & (mag >= at(1, 0))
    main = (mag > at(-1, -1)) & (mag > at(1, 1))
    anti = (mag > at(-1, 1)) & (mag > at(1, -1))
    peak = np.where(flat, along, np.where(steep, across, np.where(falling, anti, main)))
    weak = peak & (mag > low)
    keep = weak & (mag > high)
    while True:  # grow strong pixels over weak neighbours until nothing changes
        q = np.pad(keep, 1)
        near = np.zeros_like(keep)
        for dy in range(3):
            for dx in range(3):
                near |= q[dy : dy + h, dx : dx + w]
        grown = weak & near
        if (grown == keep).all():
            return int(keep.sum())
        keep = grown


def histogram(px: np.ndarray) -> list[list[int]]:
    return [np.bincount(px[:, :, c].ravel(), minlength=256).tolist() for c in range(px.shape[2])]


def color_rows(px: np.ndarray) -> np.ndarray:
    """Pixels as rows of three values; one channel is repeated."""
    rows = px.reshape(-1, px.shape[2])
    return np.repeat(rows[:, :1], 3, axis=1) if px.shape[2] < 3 else rows[:, :3]


def packed_colors(rows: np.ndarray) -> np.ndarray:
    """Each row of three values as one number."""
    return rows[:, 0].astype(np.int64) << 16 | rows[:, 1].astype(np.int64) << 8 | rows[:, 2]


def unpacked(values: np.ndarray) -> np.ndarray:
    return np.stack([values >> 16, values >> 8 & 255, values & 255], axis=1).astype(np.float64)


def dominant_colors(rows: np.ndarray, k: int = 3, steps: int = 10) -> list[tuple[float, float, float, int]]:
    """Clusters of pixels, from the pixels at k equal strides: (b, g, r, pixels) in seed order."""
    n = len(rows)
    k = min(k, n)
    packed = packed_colors(rows)
    values, weights = np.unique(packed, return_counts=True)
    return clusters(values, weights, packed[[j * n // k for j in range(k)]] if k else packed, steps)


def clusters(values: np.ndarray, weights: np.ndarray, seeds: np.ndarray, steps: int = 10) -> list[tuple[float, float, float, int]]:
    """Lloyd's algorithm on distinct packed colours with weights.

    Given seeds, the result does not depend on chance; ties go to the lower centre; an empty cluster keeps its centre.
    """
    k, centres, points = len(seeds), unpacked(seeds), unpacked(values)
    count = np.zeros(k, dtype=np.int64)
    for _ in range(steps if k else 0):
        near = ((points[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        count = np.bincount(near, weights=weights, minlength=k).astype(np.int64)
        for c in range(3):
            total = np.bincount(near, weights=weights * points[:, c], minlength=k)
            centres[:, c] = np.where(count > 0, total / np.maximum(count, 1), centres[:, c])
    return [(*map(float, centres[j]), int(count[j])) for j in range(k)]
