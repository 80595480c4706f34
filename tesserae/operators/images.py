"""Pictures for OCR: what an engine must offer, and preparation of low-contrast and small pictures in numpy.

Decoding and recognition need libraries that are not part of this package; they come as an Engine. Everything here works
on arrays of height x width x 3 (or height x width) bytes.
"""

from __future__ import annotations

from typing import Protocol

import numpy as np

# The smallest pictures that are read, tiles of high ones, the short side of prepared ones.
LEAST_HEIGHT, LEAST_WIDTH = 30, 100
TILE, OVERLAP = 1500, 100
SHORT_SIDE = 800
# Contrast limit and grid; white shares between which one threshold serves; window and offset of local thresholds; blur and weight of sharpening.
CLIP, GRID = 2.0, 8
WHITE = (0.01, 0.99)
WINDOW, OFFSET = 11, 2
BLUR, SHARPEN = 3.0, 0.5


class Engine(Protocol):
    """What reads pictures and PDF files; one object per Python worker, so it must be picklable."""

    def decode(self, content: bytes) -> np.ndarray | None:
        """The picture, or None."""

    def read(self, picture: np.ndarray, form: str) -> list[str]:
        """Texts of a picture or tile; a missing set-up is an error."""

    def pdf_text(self, content: bytes) -> list[str | None]:
        """The text layer of each page."""

    def pdf_pictures(self, content: bytes, pages: int) -> list[np.ndarray]:
        """The first pages as pictures."""


def gray(picture: np.ndarray) -> np.ndarray:
    if picture.ndim == 2:
        return picture.astype(float)
    return picture[..., :3].astype(float) @ np.array([0.114, 0.587, 0.299])  # blue, green, red


def enlarged(image: np.ndarray, short: int = SHORT_SIDE) -> np.ndarray:
    """Linear interpolation up to this short side; larger images stay."""
    h, w = image.shape
    if min(h, w) >= short:
        return image
    scale = short / min(h, w)
    for axis, size in ((0, int(h * scale)), (1, int(w * scale))):
        n = image.shape[axis]
        at = np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
        low = at.astype(int)
        part = (at - low)[:, None] if axis == 0 else (at - low)[None, :]
        image = np.take(image, low, axis) * (1 - part) + np.take(image, np.minimum(low + 1, n - 1), axis) * part
    return image


def equalized(image: np.ndarray, clip: float = CLIP, grid: int = GRID) -> np.ndarray:
    """Local contrast: each cell of a grid has its own clipped equalisation, and between the centres of cells they are mixed."""
    h, w = image.shape
    values = np.clip(image, 0, 255).astype(np.uint8)
    rows, columns = (np.linspace(0, n, grid + 1).astype(int) for n in (h, w))
    maps = np.zeros((grid, grid, 256))
    for i in range(grid):
        for j in range(grid):
            cell = values[rows[i] : max(rows[i + 1], rows[i] + 1), columns[j] : max(columns[j + 1], columns[j] + 1)]
            counts = np.bincount(cell.ravel(), minlength=256).astype(float)
            limit = max(1.0, clip * cell.size / 256)
            over = np.maximum(counts - limit, 0).sum()
            maps[i, j] = np.cumsum(np.minimum(counts, limit) + over / 256) * 255 / cell.size
    y, x = ((np.clip((np.arange(n) + 0.5) * grid / n - 0.5, 0, grid - 1)) for n in (h, w))
    top, left = np.minimum(y.astype(int), grid - 1), np.minimum(x.astype(int), grid - 1)
    fy, fx = (y - top)[:, None], (x - left)[None, :]
    below, right = np.minimum(top + 1, grid - 1), np.minimum(left + 1, grid - 1)
    pick = lambda a, b: maps[a[:, None], b[None, :], values]
    return (pick(top, left) * (1 - fx) + pick(top, right) * fx) * (1 - fy) + (pick(below, left) * (1 - fx) + pick(below, right) * fx) * fy


def best_threshold(image: np.ndarray) -> int:
    """The gray value that parts the image in two classes of the greatest variance between them."""
    counts = np.bincount(np.clip(image, 0, 255).astype(np.uint8).ravel(), minlength=256).astype(float)
    below, total = np.cumsum(counts), counts.sum()
    sums = np.cumsum(counts * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (sums[-1] * below / total - sums) ** 2 / (below * (total - below))
    return int(np.argmax(np.nan_to_num(between, nan=-1.0, posinf=-1.0)))


def _smooth(image: np.ndarray, sigma: float, size: int | None = None) -> np.ndarray:
    reach = (size or 2 * int(3 * sigma) + 1) // 2
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))
    kernel /= kernel.sum()
    for axis in (0, 1):
        padded = np.pad(image, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        n = image.shape[axis]
        image = sum(k * np.take(padded, np.arange(d, d + n), axis) for d, k in enumerate(kernel))
    return image


def white_ratio(binary: np.ndarray) -> float:
    """The share of white pixels."""
    return float((binary == 255).mean()) if binary.size else 0.0


def binarized(image: np.ndarray) -> np.ndarray:
    """Black and white by one threshold, or by local ones where one would make nearly everything black or white."""
    whole = np.where(np.clip(image, 0, 255).astype(np.uint8) > best_threshold(image), 255, 0)
    if WHITE[0] < white_ratio(whole) < WHITE[1]:
        return whole
    return np.where(image > _smooth(image, 0.3 * ((WINDOW - 1) * 0.5 - 1) + 0.8, WINDOW) - OFFSET, 255, 0)


def prepared(picture: np.ndarray) -> np.ndarray:
    """The picture as OCR reads it best: large enough, of even contrast, black and white, with sharp edges; height x width x 3 bytes."""
    binary = binarized(equalized(enlarged(gray(picture)))).astype(float)
    sharp = (1 + SHARPEN) * binary - SHARPEN * _smooth(binary, BLUR)
    return np.repeat(np.clip(np.rint(sharp), 0, 255).astype(np.uint8)[..., None], 3, axis=2)


def tiles(height: int, tile: int = TILE, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Top and bottom of each tile, as pages.ocr_tiles() gives them for a column."""
    return [(y, min(y + tile, height)) for y in range(0, max(height - overlap - 1, 0) + 1, tile - overlap)]


def picture_text(engine: Engine, picture: np.ndarray | None, form: str) -> str:
    if picture is None or picture.shape[0] < LEAST_HEIGHT or picture.shape[1] < LEAST_WIDTH:
        return ""
    ready = prepared(picture)
    return " ".join(t for top, bottom in tiles(len(ready)) for t in engine.read(ready[top:bottom], form) if t and t.strip())


def file_text(engine: Engine, content: bytes, form: str, pages: int = 10) -> str:
    """The text of a picture or of the first pages of a PDF file; '' where there is none or the file cannot be read."""
    try:
        if form != "pdf":
            return picture_text(engine, engine.decode(content), form)
        layer = " ".join(t or "" for t in engine.pdf_text(content)[:pages]).strip()
        return layer or "\n".join(t for p in engine.pdf_pictures(content, pages)[:pages] if (t := picture_text(engine, p, "jpg")))
    except Exception:  # noqa: BLE001  an unreadable file has no text
        return ""
