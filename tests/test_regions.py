"""Regions as runs against the same things counted pixel by pixel, on random masks."""

from __future__ import annotations

import time

import numpy as np
import pytest

from evalloom.functions import regions
from evalloom.operators import path


def of_mask(mask: np.ndarray) -> regions.Region:
    flat = np.concatenate([[0], mask.T.ravel().astype(np.int8), [0]])
    edges = np.flatnonzero(np.diff(flat))
    return regions.region(edges[::2], edges[1::2], *mask.shape)


def pixel_labels(mask: np.ndarray) -> np.ndarray:
    """4-connected regions by flooding from each pixel in row-major order."""
    label, n = np.full(mask.shape, -1), 0
    for y, x in np.argwhere(mask):
        if label[y, x] < 0:
            todo = [(y, x)]
            label[y, x] = n
            while todo:
                a, b = todo.pop()
                for c, d in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                    if 0 <= c < mask.shape[0] and 0 <= d < mask.shape[1] and mask[c, d] and label[c, d] < 0:
                        label[c, d] = n
                        todo.append((c, d))
            n += 1
    return label


def random_mask(rng) -> np.ndarray:
    h, w = rng.integers(1, 24, 2)
    mask = rng.random((h, w)) < rng.choice([0.05, 0.3, 0.6, 0.95])
    if rng.random() < 0.5:
        a, b = rng.integers(0, h), rng.integers(0, w)
        mask[a : a + 8, b : b + 6] = rng.random() < 0.5
    return mask


def pixel_split(mask):
    label = pixel_labels(mask)
    n = label.max() + 1
    if n < 2:
        return mask, None
    centres = [np.argwhere(label == k).mean(0)[::-1] for k in range(n)]
    best, pair = -1.0, (0, 1)
    for i in range(n):
        for j in range(n):
            d = np.hypot(*(centres[i] - centres[j]))
            if d > best:
                best, pair = d, (i, j)
    one = [np.hypot(*(c - centres[pair[0]])) <= np.hypot(*(c - centres[pair[1]])) for c in centres]
    return (label >= 0) & np.isin(label, np.flatnonzero(one)), (label >= 0) & ~np.isin(label, np.flatnonzero(one))


def pixels_of(r: regions.Region) -> np.ndarray:
    out = np.zeros((r.h, r.w), bool)
    for x, a, b in zip(r.x, r.top, r.end, strict=True):
        out[a:b, x] = True
    return out


def test_regions_equal_pixels():
    rng = np.random.default_rng(7)
    for _ in range(500):
        mask = random_mask(rng)
        h, w = mask.shape
        r = of_mask(mask)
        assert (pixels_of(r) == mask).all()
        label, want = r.components(), pixel_labels(mask)
        for k, (x, y) in enumerate(zip(r.x, r.top, strict=True)):
            assert want[y, x] == label[k]
        ys, xs = np.nonzero(mask)
        assert r.centre() == pytest.approx((xs.mean(), ys.mean()) if len(xs) else (w / 2, h / 2), abs=1e-12)
        px, py = rng.integers(-3, w + 3, 30), rng.integers(-3, h + 3, 30)
        inside = [0 <= x < w and 0 <= y < h and mask[y, x] for x, y in zip(px, py, strict=True)]
        assert r.inside(px, py).tolist() == inside
        for p in rng.uniform(-5, 30, (4, 2)):
            least = np.hypot(xs - p[0], ys - p[1]).min() if len(xs) else np.inf
            assert r.distance(*p) == least
            x, y = int(np.rint(p[0])), int(np.rint(p[1]))
            assert path.point_distance(p, r) == (0.0 if 0 <= x < w and 0 <= y < h and mask[y, x] else least)
        other = rng.random(mask.shape) < 0.1
        oy, ox = np.nonzero(other)
        gap = np.sqrt(((xs[:, None] - ox) ** 2 + (ys[:, None] - oy) ** 2).min()) if len(xs) and len(ox) else np.inf
        assert r.gap(of_mask(other)) == gap
        one, two = path.split_target(r)
        a, b = pixel_split(mask)
        assert (pixels_of(one) == a).all() and (two is None) == (b is None) and (b is None or (pixels_of(two) == b).all())


def test_runs_in_any_order():
    """Overlapping and touching runs, runs over several columns and beyond the mask."""
    rng = np.random.default_rng(2)
    for _ in range(200):
        h, w, n = *rng.integers(1, 15, 2), rng.integers(0, 12)
        s = rng.integers(-2, h * w + 5, n)
        e = s + rng.integers(0, 40, n)
        flat = np.zeros(h * w, bool)
        for a, b in zip(s, e, strict=True):
            flat[max(a, 0) : max(b, 0)] = True
        assert (pixels_of(regions.region(s, e, h, w)) == flat.reshape(w, h).T).all()


def test_large_mask_in_milliseconds():
    """A winding path over 4096 x 4096 pixels: labels, split and distances."""
    h = w = 4096
    x = np.arange(w)
    top = (1500 + 900 * np.sin(x / 300)).astype(np.int64)
    s = np.concatenate([x * h + top, x[:500] * h + 20])
    e = s + np.concatenate([np.full(w, 120), np.full(500, 60)])
    took = []
    for _ in range(3):
        began = time.perf_counter()
        r = regions.region(s, e, h, w)
        one, two = path.split_target(r)
        far = r.distance(2000.0, 4000.0), one.gap(two)
        took.append(time.perf_counter() - began)
    assert two is not None and far[0] > 0 and far[1] > 1
    assert min(took) < 0.05, took
