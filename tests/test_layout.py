import random

import numpy as np

from paperloom.functions.literals import frame
from paperloom.operators import layout

SF = "/root/testdata/sf0.001"


def test_lines_and_direction(spark):
    rows = [(1, 0.5, 0.10, 0.1, 0.02, "World"), (1, 0.1, 0.101, 0.1, 0.02, "Hello"), (1, 0.3, 0.095, 0.01, 0.01, "2"), (1, 0.1, 0.2, 0.1, 0.02, "Next"), (1, 0.1, 0.3, 0.1, 0.02, "مرحبا"), (1, 0.5, 0.3, 0.1, 0.02, "بالعالم"), (1, 0.2, 0.4, 0.1, 0.02, "  "), (2, 0.1, 0.1, 0.1, 0.02, "Other")]
    got = {r["page"]: r["text"] for r in layout.page_texts(frame(spark, rows, "page long, x double, y double, w double, h double, word string")).collect()}
    assert got == {1: "Hello 2 World\nNext\nبالعالم مرحبا", 2: "Other"}


def brute(gray, window, k=0.2, spread=128.0):
    h, w = gray.shape
    half, out = max(window // 2, 1), np.zeros_like(gray)
    for y in range(h):
        for x in range(w):
            part = gray[max(0, y - half) : y + half + 1, max(0, x - half) : x + half + 1].astype(float)
            out[y, x] = 255 if gray[y, x] > part.mean() * (1 + k * (part.std() / spread - 1)) + 1e-9 else 0
    return out


def test_sauvola():
    r = np.random.default_rng(1)
    for shape in ((8, 8), (1, 30), (13, 5)):
        gray = r.integers(0, 256, shape)
        assert (layout.sauvola(gray, 5) == brute(gray, 5)).mean() > 0.999
    column = np.full((8, 8), 220)
    column[:, 4] = 20
    binary = layout.sauvola(column, 5)
    assert binary[3, 4] == 0 and binary[0, 0] == 255
    assert (layout.sauvola(np.full((4, 4), 200)) == 255).all()


def test_images_and_queries(spark):
    random.seed(1)
    images = frame(spark, [(2, 2, [1, 2, 3, 250]), (2, 2, [1]), (0, 0, []), (1, 1, None)], "width int, height int, gray array<int>")
    assert [r["binary"] is None for r in layout.binarised(images, 3).collect()] == [False, True, True, True]
    for name, query in layout.QUERIES.items():
        assert query(spark, SF).count() > 0, name
