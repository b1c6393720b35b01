"""Per-image array helpers that run inside Arrow tasks."""

from __future__ import annotations

import numpy as np

#: Luma weights, edge threshold and entropy bins of the statistics.
LUMA = np.array([0.299, 0.587, 0.114])
EDGE_THRESHOLD = 0.12
ENTROPY_BINS = 64


def decode_row(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """Gray image of one row of Spark's image source, whose colour order is BGR.

    Colour is reduced to whole gray levels first, as 8-bit converters do.
    """
    raw = np.frombuffer(data, dtype=np.uint8)
    if channels == 1:
        return raw.reshape(height, width) / 255.0
    levels = raw.reshape(height, width, channels)[:, :, 2::-1].astype(np.float64) @ LUMA
    return np.floor(levels + 0.5) / 255.0


def statistics(gray: np.ndarray) -> tuple[float, ...]:
    """The seven statistics in canonical order."""
    mean, std = gray.mean(), gray.std()
    p05, p95 = np.percentile(gray, (5, 95))
    edges = lap_var = 0.0
    if min(gray.shape) >= 3:
        up, mid, down = gray[:-2], gray[1:-1], gray[2:]
        col = up + 2.0 * mid + down
        gx = col[:, 2:] - col[:, :-2]
        row = gray[:, :-2] + 2.0 * gray[:, 1:-1] + gray[:, 2:]
        gy = row[2:] - row[:-2]
        edges = float(np.mean(np.hypot(gx, gy) / 4.0 > EDGE_THRESHOLD))
        lap = up[:, 1:-1] + down[:, 1:-1] + mid[:, :-2] + mid[:, 2:] - 4.0 * mid[:, 1:-1]
        lap_var = float(lap.var())
    bins = np.minimum((gray * ENTROPY_BINS).astype(np.int64), ENTROPY_BINS - 1)
    share = np.bincount(bins.ravel(), minlength=ENTROPY_BINS) / gray.size
    share = share[share > 0]
    entropy = float(abs((share * np.log2(share)).sum()))
    return (float(mean), float(std), float(p05), float(p95), edges, lap_var, entropy)


def area_resize(gray: np.ndarray, height: int, width: int) -> np.ndarray:
    """Resize by averaging the covered area (bilinear weights when enlarging)."""

    def weights(src: int, dst: int) -> np.ndarray:
        scale = src / dst
        if scale <= 1.0:
            at = np.clip((np.arange(dst) + 0.5) * scale - 0.5, 0, src - 1)
            lo = np.floor(at).astype(int)
            hi = np.minimum(lo + 1, src - 1)
            w = np.zeros((dst, src))
            np.add.at(w, (np.arange(dst), lo), 1.0 - (at - lo))
            np.add.at(w, (np.arange(dst), hi), at - lo)
            return w
        left = np.arange(dst)[:, None] * scale
        cell = np.arange(src)[None, :]
        cover = np.minimum(left + scale, cell + 1) - np.maximum(left, cell)
        return np.clip(cover, 0.0, None) / scale

    h, w = gray.shape
    return weights(h, height) @ gray @ weights(w, width).T


def difference_hash(gray: np.ndarray, size: int = 8) -> str:
    """Hex key of horizontal gradients on a ``size`` x ``size + 1`` reduction, rows first."""
    small = np.floor(area_resize(gray, size, size + 1) * 255.0 + 0.5)
    bits = (small[:, 1:] > small[:, :-1]).ravel()
    return np.packbits(bits).tobytes().hex()


def hog_dim(height: int, width: int, cell: int = 16, bins: int = 9, block: int = 2) -> int:
    return (height // cell - block + 1) * (width // cell - block + 1) * block * block * bins


def hog(gray: np.ndarray, cell: int = 16, bins: int = 9, block: int = 2, eps: float = 1e-6) -> np.ndarray:
    """Histogram of oriented gradients: soft two-bin votes, clipped block norms."""
    rows, cols = gray.shape[0] // cell, gray.shape[1] // cell
    if min(rows, cols) < block:
        raise ValueError(f"{gray.shape[0]}x{gray.shape[1]} is smaller than one {block * cell} px block")
    img = gray[: rows * cell, : cols * cell]
    padded_x = np.pad(img, ((0, 0), (1, 1)))
    padded_y = np.pad(img, ((1, 1), (0, 0)))
    gx = padded_x[:, 2:] - padded_x[:, :-2]
    gy = padded_y[2:] - padded_y[:-2]
    gx[:, [0, -1]] = 0.0
    gy[[0, -1]] = 0.0
    strength = np.hypot(gx, gy)
    place = np.mod(np.degrees(np.arctan2(gy, gx)), 180.0) * bins / 180.0 - 0.5
    low = np.floor(place)
    part = place - low
    first = low.astype(int) % bins
    tile = (np.arange(rows * cell) // cell)[:, None] * cols + (np.arange(cols * cell) // cell)[None, :]
    votes = np.zeros(rows * cols * bins)
    for index, share in ((first, 1.0 - part), ((first + 1) % bins, part)):
        votes += np.bincount((tile * bins + index).ravel(), (strength * share).ravel(), rows * cols * bins)
    hist = votes.reshape(rows, cols, bins)
    blocks = np.lib.stride_tricks.sliding_window_view(hist, (block, block), axis=(0, 1))
    flat = blocks.transpose(0, 1, 3, 4, 2).reshape(rows - block + 1, cols - block + 1, -1)

    def unit(v: np.ndarray) -> np.ndarray:
        return v / np.sqrt((v * v).sum(axis=-1, keepdims=True) + eps * eps)

    return unit(np.minimum(unit(flat), 0.2)).ravel()
