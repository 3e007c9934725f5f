"""Preparation of page images for recognition, in numpy: scale, grey, straighten, denoise, even out, threshold.

Images are arrays of bytes, height x width (grey) or height x width x 3.  A recogniser's decoder calls prepare() on a page
before it reads it, and hard_threshold() before it reads it again (sources.documents.recognise_pages).
"""

from __future__ import annotations

import numpy as np

# The confidence from which a page is turned, the sides that recognition likes, the least width of a page, dark pixels and angles (degrees) that count
# as skew, tiles and clip limit of the contrast, window and offset of the local threshold.
SURE = 1.2
MIN_SIDE, MAX_SIDE, NARROW = 1400, 3200, 1400
DARK_PIXELS, LEAST_ANGLE, MOST_ANGLE = 300, 0.4, 10.0
#: Runs of dark pixels by which an angle is told.
MOST_RUNS = 200_000
TILES, CLIP = 8, 2.0
WINDOW, OFFSET = 31, 8
#: Rows that are blended at once, so that what lies between stays in a core's cache.
STRIP = 32


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear; when shrinking, over the mean of the pixels that fall together."""
    h, w = image.shape[:2]
    by = max(1, min(h // max(1, height), w // max(1, width)))
    if by > 1:
        image = image[: h // by * by, : w // by * by].reshape(h // by, by, w // by, by, *image.shape[2:]).mean(axis=(1, 3))
        h, w = image.shape[:2]
    y, x = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1), np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    # Rows and columns of the grid are apart: along the rows first, then between rows.
    image = image.astype(np.float32)
    y0, x0 = np.clip(np.floor(y).astype(int), 0, h - 1), np.clip(np.floor(x).astype(int), 0, w - 1)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0).reshape(-1, *[1] * (image.ndim - 1)), (x - x0).reshape(-1, *[1] * (image.ndim - 2))
    along = np.ascontiguousarray(image[:, x0] * (1 - fx) + image[:, x1] * fx)
    out = np.empty((height, width, *image.shape[2:]), np.uint8)
    held = np.empty((2, STRIP, *along.shape[1:]), along.dtype)
    for k in range(0, height, STRIP):
        s = slice(k, k + STRIP)
        upper, lower = held[:, : len(y0[s])]
        np.take(along, y0[s], axis=0, out=upper, mode="clip")
        np.take(along, y1[s], axis=0, out=lower, mode="clip")
        upper *= 1 - fy[s]
        lower *= fy[s]
        upper += lower
        out[s] = np.rint(upper, out=upper)
    return out


def _sample(image: np.ndarray, y: np.ndarray, x: np.ndarray, outside: float | None = None) -> np.ndarray:
    h, w = image.shape[:2]
    y0, x0 = np.clip(np.floor(y).astype(int), 0, h - 1), np.clip(np.floor(x).astype(int), 0, w - 1)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = np.clip(y - y0, 0, 1), np.clip(x - x0, 0, 1)
    if image.ndim == 3:
        fy, fx = fy[..., None], fx[..., None]
    out = (image[y0, x0] * (1 - fx) + image[y0, x1] * fx) * (1 - fy) + (image[y1, x0] * (1 - fx) + image[y1, x1] * fx) * fy
    if outside is not None:
        out = np.where((y < -0.5) | (y > h - 0.5) | (x < -0.5) | (x > w - 0.5), outside, out)
    return out


def widen(image: np.ndarray) -> np.ndarray:
    """A narrow page at twice its size."""
    h, w = image.shape[:2]
    return resize(image, 2 * h, 2 * w) if 0 < w < NARROW else image


def scale(image: np.ndarray) -> np.ndarray:
    """The longer side between MIN_SIDE and MAX_SIDE."""
    h, w = image.shape[:2]
    side = max(h, w)
    by = MIN_SIDE / side if 0 < side < MIN_SIDE else MAX_SIDE / side if side > MAX_SIDE else 1.0
    return image if by == 1.0 else resize(image, max(1, int(h * by)), max(1, int(w * by)))


def grey(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        return image
    return (image[..., :3] @ np.array([0.299, 0.587, 0.114])).round().astype(np.uint8)


def otsu(image: np.ndarray) -> int:
    """The threshold that splits the histogram into the two most distinct classes; pixels up to it are dark."""
    n = _counts(image).astype(float)
    low, total = np.cumsum(n), n.sum()
    sums = np.cumsum(n * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (sums[-1] * low / total - sums) ** 2 / (low * (total - low))
    return int(np.nan_to_num(between).argmax())


def _counts(image: np.ndarray) -> np.ndarray:
    """How many pixels each level has: two pixels are counted at a time."""
    flat = np.ascontiguousarray(image).ravel()
    pairs = np.bincount(flat[: len(flat) // 2 * 2].view(np.uint16), minlength=1 << 16).reshape(256, 256)
    return pairs.sum(axis=0) + pairs.sum(axis=1) + np.bincount(flat[len(flat) // 2 * 2 :], minlength=256)


def skew(image: np.ndarray) -> float:
    """Degrees by which the lines of a page slope (down to the right is positive): at the true angle the sums of dark pixels
    along lines differ most.  0 where too little is dark."""
    dark = image <= otsu(image)
    n = np.count_nonzero(dark)
    if n < DARK_PIXELS or n == image.size:
        return 0.0
    y, begin, end = _runs(dark)
    if len(y) > MOST_RUNS:  # enough to tell an angle
        keep = np.random.default_rng(1).choice(len(y), MOST_RUNS, replace=False)
        y, begin, end = y[keep], begin[keep], end[keep]
    long = (end - begin).astype(float)

    def sharpness(angle: float) -> float:
        across, along = np.cos(np.radians(angle)), np.sin(np.radians(angle))
        # The lines on which a run has its pixels: from first to last, a step of a pixel apart.
        low = y * across - (end - 1 if along > 0 else begin) * along
        low -= low.min()
        step = abs(along)
        first, last = low.astype(int), (low + (long - 1) * step).astype(int)
        sums = np.bincount(last, long)
        over = last - first
        if over.any():  # at each line that a run goes over to, the pixels before it
            total = over.cumsum()
            line = np.repeat(first + 1 - total + over, over)
            line += np.arange(total[-1])
            before = line - np.repeat(low, over)
            before /= step
            np.ceil(before, out=before)
            went = np.bincount(line, before, len(sums) + 1)
            sums += went[1:] - went[:-1]
        return float((sums**2).sum())

    coarse = max(np.arange(-MOST_ANGLE, MOST_ANGLE + 0.01, 0.5), key=sharpness)
    return float(max(np.arange(coarse - 0.5, coarse + 0.51, 0.1), key=sharpness))


def _runs(dark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first column and column after the last of each run of dark pixels along a row."""
    h, w = dark.shape
    edged = np.zeros((h, w + 2), bool)
    edged[:, 1:-1] = dark
    at = np.flatnonzero(edged[:, 1:] != edged[:, :-1])
    y, begin = np.divmod(at[::2], w + 1)
    return y, begin, at[1::2] - y * (w + 1)


def straighten(image: np.ndarray) -> np.ndarray:
    """Turned back by its skew, white where nothing was, if that is neither too small to matter nor too large to trust."""
    angle = skew(image)
    if not LEAST_ANGLE <= abs(angle) <= MOST_ANGLE:
        return image
    h, w = image.shape
    c, s = np.cos(np.radians(angle)), np.sin(np.radians(angle))
    y, x = np.mgrid[0:h, 0:w].astype(float)
    y, x = y - h / 2, x - w / 2
    return _sample(image.astype(np.float32), s * x + c * y + h / 2, c * x - s * y + w / 2, 255.0).round().astype(np.uint8)


def median(image: np.ndarray) -> np.ndarray:
    """Of each pixel and its eight neighbours: each column of three in order, then the median of the largest of the least, the
    median of the middle ones and the least of the largest."""
    wide = np.pad(image, 1, mode="edge")
    out = np.empty_like(image)
    left, here, right = slice(None, -2), slice(1, -1), slice(2, None)
    of = lambda f, x: f(f(x[:, left], x[:, here]), x[:, right])
    for k in range(0, len(image), STRIP):
        rows = wide[k : k + STRIP + 2]
        a, b, c = rows[:-2], rows[1:-1], rows[2:]
        low, high = np.minimum(a, b), np.maximum(a, b)
        least, most = np.minimum(low, c), np.maximum(high, c)
        mid = np.maximum(low, np.minimum(high, c))
        out[k : k + STRIP] = _middle(of(np.maximum, least), _middle(mid[:, left], mid[:, here], mid[:, right]), of(np.minimum, most))
    return out


def _middle(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))


def even_out(image: np.ndarray) -> np.ndarray:
    """Contrast-limited histogram equalisation over TILES x TILES tiles, blended between their centres."""
    h, w = image.shape
    th, tw = -(-h // TILES), -(-w // TILES)
    padded = np.pad(image, ((0, th * TILES - h), (0, tw * TILES - w)), mode="reflect" if min(h, w) > max(th, tw) else "edge")
    tiles = padded.reshape(TILES, th, TILES, tw).transpose(0, 2, 1, 3).reshape(TILES * TILES, -1)
    maps = np.empty((TILES * TILES, 256), np.float32)
    limit = max(1.0, CLIP * tiles.shape[1] / 256)
    for k, tile in enumerate(tiles):
        n = np.bincount(tile, minlength=256).astype(float)
        over = np.maximum(n - limit, 0).sum()
        maps[k] = np.cumsum(np.minimum(n, limit) + over / 256) * 255 / tiles.shape[1]
    maps = maps.reshape(TILES, TILES, 256)
    y, x = np.clip((np.arange(h) + 0.5) / th - 0.5, 0, TILES - 1), np.clip((np.arange(w) + 0.5) / tw - 0.5, 0, TILES - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, TILES - 1), np.minimum(x0 + 1, TILES - 1)
    fy, fx = (y - y0).astype(np.float32)[:, None], (x - x0).astype(np.float32)[None, :]
    out = np.empty((h, w), np.uint8)
    # Room for a block, used again by the next one.
    most = max(y.stop - y.start for y in _stretches(y0)) * max(x.stop - x.start for x in _stretches(x0))
    places, held = np.empty(most, np.intp), np.empty((3, most), np.float32)
    for ys in _stretches(y0):
        for xs in _stretches(x0):  # between the same four centres
            block = image[ys, xs]
            here = places[: block.size].reshape(block.shape)
            here[...] = block
            upper, lower, spare = (x[: block.size].reshape(block.shape) for x in held)
            for k, to in ((y0[ys.start], upper), (y1[ys.start], lower)):
                _between(maps[k, x0[xs.start]], maps[k, x1[xs.start]], here, fx[:, xs], to, spare)
            lower -= upper
            lower *= fy[ys]
            upper += lower
            out[ys, xs] = np.rint(upper, out=upper)
    return out


def _between(left: np.ndarray, right: np.ndarray, here: np.ndarray, share: np.ndarray, to: np.ndarray, spare: np.ndarray) -> None:
    """What two tables say of pixels, blended by the share of the right one.  Levels are below 256: without a check the lookup is
    faster."""
    np.take(right - left, here, out=to, mode="clip")
    to *= share
    to += np.take(left, here, out=spare, mode="clip")


def _stretches(values: np.ndarray) -> list[slice]:
    """The stretches of equal values, in order."""
    cuts = [0, *(np.flatnonzero(np.diff(values)) + 1), len(values)]
    return [slice(a, b) for a, b in zip(cuts, cuts[1:])]


def _across(ink: np.ndarray) -> float:
    """How much more the sums of dark pixels change from row to row than from column to column, as a logarithm: above 0 where
    lines of text run along the rows."""

    def change(axis: int) -> float:
        p = ink.sum(axis=axis).astype(float)
        return float((np.diff(p) ** 2).sum() / max(1.0, (p**2).sum()))

    return float(np.log((change(1) + 1e-6) / (change(0) + 1e-6)))


def _begins_left(ink: np.ndarray) -> float:
    """How much more the ends of the lines are spread than their beginnings, as a logarithm: above 0 where lines begin on the
    left.  Lines are runs of rows with dark pixels; fewer than three tell nothing."""
    rows = np.r_[0, (ink.any(axis=1)).astype(int), 0]
    starts, stops = np.flatnonzero(np.diff(rows) == 1), np.flatnonzero(np.diff(rows) == -1)
    if len(starts) < 3:
        return 0.0
    sides = [np.flatnonzero(ink[a:b].any(axis=0))[[0, -1]] for a, b in zip(starts, stops)]
    left, right = np.array(sides, float).T
    return float(np.log((right.var() + 1) / (left.var() + 1)))


def orientation(image: np.ndarray) -> tuple[int, float]:
    """Quarter turns counter-clockwise that set a page upright, and how sure that is (the lesser of two logarithms, of the
    direction of lines and of where they begin).  Pages that tell nothing stay, with 0."""
    plain = grey(image)
    by = max(1, min(plain.shape) // 400)
    plain = plain[::by, ::by]
    ink = plain <= otsu(plain)
    if not ink.any() or ink.all():
        return 0, 0.0
    across = _across(ink)
    turns = 0 if across >= 0 else 1
    left = _begins_left(np.rot90(ink, turns))
    return (turns if left >= 0 else turns + 2), min(abs(across), abs(left))


def prepare(image: np.ndarray, turns: int | None = None) -> np.ndarray:
    """A page ready for recognition.  turns: quarter turns counter-clockwise that set it upright; None: as orientation() tells,
    where it is sure."""
    if turns is None:
        told, sure = orientation(image)
        turns = told if sure >= SURE else 0
    return even_out(median(straighten(grey(scale(np.rot90(image, turns))))))


def hard_threshold(image: np.ndarray) -> np.ndarray:
    """Black and white, each pixel against the Gaussian mean of its surroundings."""
    sigma = 0.3 * ((WINDOW - 1) * 0.5 - 1) + 0.8
    k = np.exp(-((np.arange(WINDOW) - WINDOW // 2) ** 2) / (2 * sigma**2))
    k /= k.sum()
    blur = grey(image).astype(np.float32)
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (WINDOW // 2, WINDOW // 2)
        wide = np.pad(blur, pad, mode="edge")
        blur = sum(k[i] * np.take(wide, range(i, i + blur.shape[axis]), axis=axis) for i in range(WINDOW))
    return np.where(grey(image) > blur - OFFSET, 255, 0).astype(np.uint8)
