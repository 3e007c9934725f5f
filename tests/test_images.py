"""Preparation of page images."""

import numpy as np
import pytest

from stratalex.functions import images as im


def page(angle=0.0, h=420, w=600):
    """Dark lines on white that slope by an angle."""
    y, x = np.mgrid[0:h, 0:w]
    row = y * np.cos(np.radians(angle)) - x * np.sin(np.radians(angle))
    inside = (x > 60) & (x < w - 60) & (y > 60) & (y < h - 60)
    return np.where(inside & (row % 30 < 6), 20, 240).astype(np.uint8)


@pytest.mark.parametrize("angle", [-7.0, -2.5, 0.0, 1.2, 6.0])
def test_skew(angle):
    assert abs(im.skew(page(angle)) - angle) <= 0.25
    assert abs(im.skew(im.straighten(page(angle)))) <= 0.4


def test_little_skew_and_little_ink_stay():
    flat = np.full((50, 50), 200, np.uint8)
    assert im.skew(flat) == 0.0 and im.straighten(flat) is flat and im.straighten(page(0.1)).shape == (420, 600)


def test_sizes():
    assert im.scale(np.zeros((100, 50, 3), np.uint8)).shape == (1400, 700, 3)
    assert max(im.scale(np.zeros((4000, 6400), np.uint8)).shape) == 3200
    assert im.scale(np.zeros((2000, 10), np.uint8)).shape == (2000, 10)
    assert im.widen(np.zeros((10, 20), np.uint8)).shape == (20, 40) and im.widen(np.zeros((10, 1400), np.uint8)).shape == (10, 1400)
    ramp = np.tile(np.arange(64, dtype=np.uint8), (64, 1))
    assert abs(im.resize(ramp, 32, 32).astype(int) - np.tile(np.arange(0.5, 64, 2), (32, 1))).max() <= 1


def test_grey_median_threshold():
    red = np.zeros((2, 2, 3), np.uint8)
    red[..., 0] = 200
    assert (im.grey(red) == 60).all()
    spot = np.full((9, 9), 250, np.uint8)
    spot[4, 4] = 0
    assert (im.median(spot) == 250).all()
    shaded = (page() * np.linspace(0.4, 1.0, 600)[None, :]).astype(np.uint8)
    ink = page() < 100
    black = im.hard_threshold(shaded) == 0
    assert black[ink].mean() > 0.95 and black[~ink].mean() < 0.05
    assert 20 <= im.otsu(page()) < 240


def test_prepare():
    faint = (200 - (240 - page(3.0)) // 8).astype(np.uint8)
    ready = im.prepare(np.rot90(np.stack([faint] * 3, axis=-1), -1), turns=1)
    assert ready.shape == (980, 1400) and ready.dtype == np.uint8
    assert ready.std() > faint.std() and abs(im.skew(ready)) <= 0.6


def lines_page(rng, h=400, w=300):
    """Lines that begin at the left and end where they will."""
    out = np.full((h, w), 235, np.uint8)
    for y in range(40, h - 40, 30):
        out[y : y + 10, 40 : rng.integers(120, w - 30)] = 25
    return out


@pytest.mark.parametrize("turned", range(4))
def test_orientation(turned):
    rng = np.random.default_rng(turned)
    upright = lines_page(rng)
    turns, sure = im.orientation(np.rot90(upright, -turned))
    assert turns % 4 == turned and sure > im.SURE
    assert (np.rot90(np.rot90(upright, -turned), turns) == upright).all()
    ready = im.prepare(np.rot90(upright, -turned))
    assert ready.shape == (1400, 1050) and im.orientation(ready)[0] == 0


def test_orientation_of_pages_that_tell_nothing():
    assert im.orientation(np.full((50, 50), 200, np.uint8)) == (0, 0.0)
    block = np.full((200, 200), 230, np.uint8)
    block[50:150, 50:150] = 20
    assert im.orientation(block)[1] < im.SURE and im.prepare(block).shape == (1400, 1400)


def test_steps_as_defined():
    """The median, the size and the contrast of any shape by their plain definitions."""
    rng = np.random.default_rng(4)
    for h, w in ((1, 1), (1, 9), (3, 3), (37, 53), (90, 20)):
        image = rng.integers(0, 256, (h, w)).astype(np.uint8)
        wide = np.pad(image, 1, mode="edge")
        assert (im.median(image) == np.median([wide[i : i + h, j : j + w] for i in range(3) for j in range(3)], axis=0)).all()
        y, x = np.meshgrid(np.clip((np.arange(70) + 0.5) * h / 70 - 0.5, 0, h - 1), np.clip((np.arange(110) + 0.5) * w / 110 - 0.5, 0, w - 1), indexing="ij")
        assert (im.resize(image, 70, 110) == im._sample(image.astype(np.float32), y, x).round()).all() or min(h // 70, w // 110) > 0


def test_memory_of_a_page():
    """A page is prepared in a few times its own size: no table of neighbours or of places for each pixel."""
    import tracemalloc

    small = np.tile(np.linspace(250, 200, 300), (400, 1)).astype(np.uint8)
    small[40:380:40, 40:200] = 30
    tracemalloc.start()
    ready = im.prepare(small, 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ready.shape == (1400, 1050) and peak < 20 * ready.size


def test_work_of_an_angle(monkeypatch):
    """The angle is told by runs of dark pixels: what is counted for it is a fraction of the dark pixels at each angle."""
    image = np.full((1400, 1050), 240, np.uint8)
    for y in range(60, 1300, 140):
        image[y : y + 56, 140:900] = 20
    counted, count = [0], np.bincount

    def counting(x, *args, **kw):
        counted[0] += len(x)
        return count(x, *args, **kw)

    monkeypatch.setattr(im.np, "bincount", counting)
    assert abs(im.skew(image)) < 0.05
    assert counted[0] < 10 * (image < 100).sum()


def test_skew_and_contrast_by_their_definitions():
    """The sums along lines of any pixels, at each angle; the contrast blended between all four tables of a pixel."""
    rng = np.random.default_rng(3)
    for angle in (-8.0, -0.7, 0.0, 3.3):
        image = np.where(rng.random((420, 600)) < 0.01, 20, page(angle)).astype(np.uint8)
        y, x = np.nonzero(image <= im.otsu(image))

        def sharpness(a):
            rows = y * np.cos(np.radians(a)) - x * np.sin(np.radians(a))
            return float((np.bincount((rows - rows.min()).astype(int)).astype(float) ** 2).sum())

        coarse = max(np.arange(-10, 10.01, 0.5), key=sharpness)
        assert im.skew(image) == float(max(np.arange(coarse - 0.5, coarse + 0.51, 0.1), key=sharpness))
    image = rng.integers(0, 256, (160, 240)).astype(np.uint8)
    maps = np.empty((8, 8, 256))
    for i in range(8):
        for j in range(8):
            n = np.bincount(image[20 * i : 20 * i + 20, 30 * j : 30 * j + 30].ravel(), minlength=256).astype(float)
            limit = im.CLIP * 600 / 256
            maps[i, j] = np.cumsum(np.minimum(n, limit) + np.maximum(n - limit, 0).sum() / 256) * 255 / 600
    y, x = np.meshgrid(np.clip((np.arange(160) + 0.5) / 20 - 0.5, 0, 7), np.clip((np.arange(240) + 0.5) / 30 - 0.5, 0, 7), indexing="ij")
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1, fy, fx = np.minimum(y0 + 1, 7), np.minimum(x0 + 1, 7), y - y0, x - x0
    want = (maps[y0, x0, image] * (1 - fx) + maps[y0, x1, image] * fx) * (1 - fy) + (maps[y1, x0, image] * (1 - fx) + maps[y1, x1, image] * fx) * fy
    assert abs(im.even_out(image) - want).max() < 0.51
