"""Page detection in gray images: edge energy, quads and their scores, corner order, perspective warp, fill check.

Pixels are arrays of a row (width, height, gray, row by row). numpy handles all quads of an Arrow batch at once, and
all images of one size in blocks of ``BLOCK`` pixels, a larger image by itself. A row whose array does not have width x
height pixels, or has none, gives null; so does a quad without four points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.sources.tables import read, spread

#: Bounds of a plausible page: share of the frame's area, width by height, least edge by the frame's shorter side.
AREA, ASPECT, LEAST_EDGE = (0.10, 0.999), (0.15, 6.5), 0.05
#: The coverage that scores best, and the weights of coverage, symmetry and right angles.
BEST_COVERAGE, WEIGHTS = 0.65, (0.4, 0.35, 0.25)
INSET, ENERGY_CONFIDENCE, THUMBNAIL = 0.04, 0.6, 320
#: Pixels of images of one size that numpy takes at once.
BLOCK = 1 << 17
POINT = "struct<x:double,y:double>"
QUAD = f"array<{POINT}>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


# Quads as arrays (n, 4, 2): top left, top right, bottom right, bottom left


def ordered_corners(points: np.ndarray) -> np.ndarray:
    """(n, 4, 2): the corners of n sets of k points (n, k, 2), k being four or more: those of extreme sum and difference; if four points give not four or not convex ones, the points around their centre."""
    x, y = points[..., 0], points[..., 1]
    rows = np.arange(len(points))[:, None]
    least = [np.where(np.isnan(v), np.inf, v).argmin(1) for v in (x + y, y - x, -x - y, x - y)]
    corners = points[rows, np.stack(least, 1)]
    if points.shape[1] > 4:
        return corners
    alike = [(corners[:, i] == corners[:, j]).all(1) for i in range(4) for j in range(i)]
    good = convex(corners) & ~np.any(alike, 0)
    centre = [(v[:, 0] + v[:, 1] + v[:, 2] + v[:, 3])[:, None] / 4 for v in (x, y)]
    around = points[rows, np.argsort(np.arctan2(y - centre[1] + 0.0, x - centre[0] + 0.0), 1, kind="stable")]
    first = around.sum(2).argmin(1)
    return np.where(good[:, None, None], corners, around[rows, (first[:, None] + np.arange(4)) % 4])


def _steps(quads: np.ndarray) -> np.ndarray:
    """From each corner to the next one."""
    return np.roll(quads, -1, 1) - quads


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0]


def convex(quads: np.ndarray) -> np.ndarray:
    """Whether all corners turn the same way; straight ones do not count."""
    steps = _steps(quads)
    turns = _cross(steps, np.roll(steps, -1, 1))
    return (turns > -1e-9).all(1) | (turns < 1e-9).all(1)


def area(quads: np.ndarray) -> np.ndarray:
    return np.abs(_cross(quads, np.roll(quads, -1, 1)).sum(1)) / 2


def edges(quads: np.ndarray) -> np.ndarray:
    """Lengths of the top, right, bottom and left edge."""
    steps = _steps(quads)
    return np.sqrt(steps[..., 0] ** 2 + steps[..., 1] ** 2)


def _over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, nothing where b is zero."""
    return np.divide(a, b, out=np.zeros(len(a)), where=b != 0)


def plausible(quads: np.ndarray, width: np.ndarray, height: np.ndarray) -> np.ndarray:
    """Convex, of a fitting share of the frame, shape and least edge."""
    e = edges(quads)
    share, shape = _over(area(quads), width * height), _over(np.maximum(e[:, 0], e[:, 2]), np.maximum(e[:, 3], e[:, 1]))
    fits = lambda x, bounds: (x >= bounds[0]) & (x <= bounds[1])
    return convex(quads) & fits(share, AREA) & fits(shape, ASPECT) & (e.min(1) >= np.minimum(width, height) * LEAST_EDGE)


def quad_scores(quads: np.ndarray, width: np.ndarray, height: np.ndarray) -> np.ndarray:
    """0 to 1: coverage near BEST_COVERAGE, opposite edges alike, corners near right angles; 0 if not plausible."""
    e, steps = edges(quads), _steps(quads)
    share = np.clip(_over(area(quads), width * height), 0, 1)
    coverage = 1 - np.clip(np.abs(share - BEST_COVERAGE) / BEST_COVERAGE, 0, 1)
    alike = sum(_over(np.minimum(e[:, i], e[:, j]), np.maximum(e[:, i], e[:, j])) for i, j in ((0, 2), (3, 1))) / 2
    back, before = np.roll(steps, 1, 1), np.roll(e, 1, 1)
    with np.errstate(invalid="ignore", divide="ignore"):
        cosine = -(back[..., 0] * steps[..., 0] + back[..., 1] * steps[..., 1]) / (before * e)
    right = np.clip(1 - np.abs(np.arccos(np.clip(cosine, -1, 1)) - np.pi / 2) / (np.pi / 2), 0, 1)
    score = np.clip(coverage * WEIGHTS[0] + alike * WEIGHTS[1] + np.nan_to_num(right).sum(1) / 4 * WEIGHTS[2], 0, 1)
    return np.where(plausible(quads, width, height), score, 0.0)


def _floats(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(float)


def _quads(points: pa.ListArray) -> np.ndarray:
    """The ordered corners of each list of points; NaN where there are fewer than four, or a null among them."""
    sizes = pc.list_value_length(points).fill_null(0).to_numpy(zero_copy_only=False)
    starts, given = np.cumsum(sizes) - sizes, points.flatten()
    xy = np.stack([_floats(c) for c in given.flatten()], 1)
    out = np.full((len(points), 4, 2), np.nan)
    for k in np.unique(sizes[sizes >= 4]):
        rows = np.flatnonzero(sizes == k)
        out[rows] = ordered_corners(xy[starts[rows][:, None] + np.arange(k)])
    missing = np.any([c.is_null().to_numpy(zero_copy_only=False) for c in given.flatten()], 0)
    out[np.repeat(np.arange(len(points)), sizes)[missing]] = np.nan
    return out


def inset_frame(width: Column, height: Column) -> Column:
    x, y = width * INSET, height * INSET
    return F.array(point(x, y), point(width - x, y), point(width - x, height - y), point(x, height - y))


def best_quads(candidates: DataFrame) -> DataFrame:
    """(image, corners, confidence, fallback) of each image's best candidate (image, width, height, rank, points); the first of equals; the inset frame if none is plausible."""
    names = [f"{k}{i}" for i in range(4) for k in "xy"]

    @F.arrow_udf(", ".join(f"{c} double" for c in ["score", *names]))
    def run(width: pa.Array, height: pa.Array, points: pa.Array) -> pa.Array:
        quads = _quads(points)
        return pa.StructArray.from_arrays([pa.array(c) for c in (quad_scores(quads, _floats(width), _floats(height)), *quads.reshape(-1, 8).T)], ["score", *names])

    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    scored = candidates.select("image", w.alias("width"), h.alias("height"), "rank", run(w, h, "points").alias("q"))
    best = scored.groupBy("image").agg(F.first("width").alias("width"), F.first("height").alias("height"), F.max(F.struct("q.score", (-F.col("rank")).alias("r"), *[f"q.{c}" for c in names])).alias("x"))
    found = F.col("x.score") > 0
    within = lambda v, most: F.least(F.greatest(v, F.lit(0.0)), F.col(most))
    inside = F.array(*[point(within(F.col(f"x.x{i}"), "width"), within(F.col(f"x.y{i}"), "height")) for i in range(4)])
    return best.select("image", F.when(found, inside).otherwise(inset_frame(F.col("width"), F.col("height"))).alias("corners"), F.col("x.score").alias("confidence"), (~found).alias("fallback"))


# Pixels


def thumbnail(gray: np.ndarray, longest: int = THUMBNAIL) -> np.ndarray:
    """Nearest pixels of an image, or of many (n, height, width), so that the longer side has at most ``longest``."""
    sides = gray.shape[-2:]
    scale = longest / max(sides)
    if scale >= 1:
        return gray
    rows, cols = ((np.arange(m) * n / m).astype(int) for n, m in ((n, max(1, int(n * scale + 0.5))) for n in sides))
    return gray[..., rows[:, None], cols]


def edge_energy(gray: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sobel magnitudes of an image, or of many (n, height, width), summed by row and by column; none on the border."""
    g = gray.astype(float)
    across = g[..., 2:] - g[..., :-2]
    down = g[..., 2:, :] - g[..., :-2, :]
    gx = across[..., :-2, :] + 2 * across[..., 1:-1, :] + across[..., 2:, :]
    gy = down[..., :-2] + 2 * down[..., 1:-1] + down[..., 2:]
    size = np.sqrt(gx * gx + gy * gy)
    border = [(0, 0)] * (g.ndim - 2) + [(1, 1)]
    return np.pad(size.sum(-1), border), np.pad(size.sum(-2), border)


def longest_bands(energy: np.ndarray, threshold: float = 0.15) -> np.ndarray:
    """(n, 2): first and last index of the longest run of each row (n, length), the first of equals, at ``threshold`` of the peak or above; -1 where there is none."""
    peak, places = energy.max(1), np.arange(energy.shape[1])
    high = energy >= peak[:, None] * threshold
    run = places - np.maximum.accumulate(np.where(high, -1, places), 1)
    last = run.argmax(1)
    out = np.stack([last - run[np.arange(len(run)), last] + 1, last], 1)
    out[~(peak > 0)] = -1
    return out


def longest_band(energy: np.ndarray, threshold: float = 0.15) -> tuple[int, int] | None:
    """``longest_bands`` of one row, None where there is none."""
    if not len(energy):
        return None
    first, last = longest_bands(energy[None], threshold)[0].tolist()
    return None if first < 0 else (first, last)


def _blocks(width: pa.Array, height: pa.Array, gray: pa.ListArray, more: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, pixels (n, height, width)) of the images that have their pixels, those of one size together, at most BLOCK pixels or one image at once; images that differ in a row of ``more`` are not put together."""
    w, h = (np.nan_to_num(_floats(c)).astype(int) for c in (width, height))
    n = pc.list_value_length(gray).fill_null(0).to_numpy(zero_copy_only=False)
    starts, values = np.cumsum(n) - n, gray.flatten().to_numpy(zero_copy_only=False)
    keys = np.column_stack([w, h, *([] if more is None else [more])])
    good = np.flatnonzero((w > 0) & (h > 0) & (w * h == n))
    if len(good):
        kinds, of = np.unique(keys[good], axis=0, return_inverse=True)
        for k, (own_w, own_h, *_) in enumerate(kinds.tolist()):
            rows, at_once = good[of.ravel() == k], max(1, BLOCK // (own_w * own_h))
            for i in range(0, len(rows), at_once):
                part = rows[i : i + at_once]
                yield part, values[starts[part][:, None] + np.arange(own_w * own_h)].reshape(-1, own_h, own_w)


def energy_bands(images: DataFrame, threshold: float = 0.15, fitting: bool = False) -> DataFrame:
    """Adds ``bands``: top, bottom, left and right of the band of edges as shares of the image, or null where there is none (``fitting``: none that bounds a plausible page)."""

    @F.arrow_udf("array<double>")
    def run(width: pa.Array, height: pa.Array, gray: pa.Array) -> pa.Array:
        out: list[list[float] | None] = [None] * len(gray)
        for rows, pixels in _blocks(width, height, gray):
            h, w = pixels.shape[1:]
            if min(h, w) < 3:
                continue
            small = thumbnail(pixels)
            found = np.concatenate([longest_bands(x, threshold) for x in edge_energy(small)], 1)
            shares = (found + [0, 1, 0, 1]) / np.repeat(small.shape[1:], 2)
            good = (found >= 0).all(1)
            if fitting:
                quads = shares[:, [[2, 0], [3, 0], [3, 1], [2, 1]]] * [w, h]
                good &= plausible(quads, np.full(len(rows), float(w)), np.full(len(rows), float(h)))
            for i, x in zip(rows[good].tolist(), shares[good].tolist()):
                out[i] = x
        return pa.array(out, pa.list_(pa.float64()))

    return images.withColumn("bands", run("width", "height", "gray"))


def detected_pages(images: DataFrame, threshold: float = 0.15) -> DataFrame:
    """Adds corners, confidence and fallback, by edge energy alone."""
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    top, bottom = (F.get("bands", i) * h for i in (0, 1))
    left, right = (F.get("bands", i) * w for i in (2, 3))
    quad = F.array(point(left, top), point(right, top), point(right, bottom), point(left, bottom))
    good = F.col("bands").isNotNull()
    found = energy_bands(images, threshold, True)
    return found.select(*images.columns, F.when(good, quad).otherwise(inset_frame(w, h)).alias("corners"), F.when(good, ENERGY_CONFIDENCE).otherwise(0.0).alias("confidence"), (~good).alias("fallback"))


def homographies(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """(n, 3, 3): the maps of n source quads (n, 4, 2) onto target quads; NaN where a quad is degenerate. All systems are solved at once."""
    n = len(source)
    x, y, u, v = source[..., 0], source[..., 1], target[..., 0], target[..., 1]
    zero, one = np.zeros((n, 4)), np.ones((n, 4))
    a = np.concatenate([np.stack([x, y, one, zero, zero, zero, -x * u, -y * u], -1), np.stack([zero, zero, zero, x, y, one, -x * v, -y * v], -1)], 1)
    b = np.concatenate([u, v], 1)
    sound = np.isfinite(a).all((1, 2)) & np.isfinite(b).all(1)
    a[~sound] = np.eye(8)
    flat = np.linalg.matrix_rank(a) < 8
    a[flat] = np.eye(8)
    out = np.concatenate([np.linalg.solve(a, b[..., None])[..., 0], np.ones((n, 1))], 1)
    out[flat | ~sound] = np.nan
    return out.reshape(n, 3, 3)


def mapped(maps: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Points (n, m, 2) under maps (n, 3, 3)."""
    p = np.concatenate([points, np.ones((*points.shape[:2], 1))], 2) @ maps.transpose(0, 2, 1)
    return p[..., :2] / p[..., 2:]


def output_size(quads: np.ndarray, longest: float) -> np.ndarray:
    """(n, 2): rounded width and height of flattened quads, the longer opposite edge each, at most ``longest``, at least one."""
    length = np.hypot(*np.moveaxis(np.roll(quads, -1, 1) - quads, 2, 0))
    size = np.stack([np.maximum(length[:, 0], length[:, 2]), np.maximum(length[:, 1], length[:, 3])], 1)
    with np.errstate(invalid="ignore", divide="ignore"):
        size *= np.minimum(1, longest / size.max(1))[:, None]
    return np.maximum(np.floor(np.nan_to_num(size) + 0.5), 1).astype(int)


def sampled(gray: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear samples of an image at x and y, or of n images (n, height, width) each at its own (n, places); kept inside the image, rounded and cut to a byte."""
    h, w = gray.shape[-2:]
    top, left = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
    i, j = top.astype(int), left.astype(int)
    down, right = np.minimum(i + 1, h - 1), np.minimum(j + 1, w - 1)
    flat, dx, dy = gray.astype(float).ravel(), left - j, top - i
    first = 0 if gray.ndim == 2 else np.arange(len(gray))[:, None] * (h * w)
    i, down = first + i * w, first + down * w
    upper = flat[i + j]
    upper += (flat[i + right] - upper) * dx
    lower = flat[down + j]
    lower += (flat[down + right] - lower) * dx
    return np.clip(np.floor(upper + (lower - upper) * dy + 0.5), 0, 255).astype(int)


def flattened(images: DataFrame, longest: int = 2400) -> DataFrame:
    """Adds ``flat`` (width, height, gray) of the quad ``corners``; null where the image or the quad has no pixels or no shape."""

    @F.arrow_udf("width int, height int, gray array<int>")
    def run(width: pa.Array, height: pa.Array, gray: pa.Array, corners: pa.Array) -> pa.Array:
        quads = _corners(corners)
        sizes = output_size(quads, longest)
        w, h = sizes[:, 0].astype(float), sizes[:, 1].astype(float)
        zero = np.zeros(len(w))
        maps = homographies(np.stack([np.stack([zero, zero], 1), np.stack([w, zero], 1), np.stack([w, h], 1), np.stack([zero, h], 1)], 1), quads)
        shaped = ~np.isnan(maps).any((1, 2))
        done = np.zeros(len(w), bool)
        n = np.where(shaped, sizes.prod(1), 0)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for rows, pixels in _blocks(width, height, gray, sizes * shaped[:, None]):
            if shaped[rows[0]]:
                x, y = np.meshgrid(np.arange(float(sizes[rows[0], 0])), np.arange(float(sizes[rows[0], 1])))
                at = mapped(maps[rows], np.broadcast_to(np.stack([x.ravel(), y.ravel()], 1), (len(rows), x.size, 2)))
                parts.append((rows, sampled(pixels, at[..., 0], at[..., 1]).astype(np.int32)))
                done[rows] = True
        n[~done] = 0
        ends = np.cumsum(n)
        out = np.zeros(ends[-1] if len(ends) else 0, np.int32)
        for rows, samples in parts:
            out[(ends - n)[rows][:, None] + np.arange(samples.shape[1])] = samples
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(out))
        return pa.StructArray.from_arrays([pa.array(sizes[:, 0].astype(np.int32)), pa.array(sizes[:, 1].astype(np.int32)), lists], ["width", "height", "gray"], mask=pa.array(~done))

    return images.withColumn("flat", run("width", "height", "gray", "corners"))


def _corners(corners: pa.ListArray) -> np.ndarray:
    """(n, 4, 2); NaN where there are not four points."""
    sizes = pc.list_value_length(corners).fill_null(0).to_numpy(zero_copy_only=False)
    starts, four = np.cumsum(sizes) - sizes, np.flatnonzero(sizes == 4)
    out = np.full((len(corners), 4, 2), np.nan)
    xy = np.stack([_floats(c) for c in corners.flatten().flatten()], 1)
    out[four] = xy[starts[four][:, None] + np.arange(4)]
    return out


def shows_fill(pixels: Column, fill: Column, tolerance: int = 24, share: float = 0.97) -> Column:
    """Whether ``share`` of the pixels (r, g, b) lie within ``tolerance`` of the fill in every channel; an empty region does."""
    near = F.filter(pixels, lambda p: F.greatest(*[F.abs(p[c] - fill[c]) for c in "rgb"]) <= tolerance)
    return F.when(F.size(pixels) == 0, True).otherwise(F.size(near) >= F.size(pixels) * share)


# Queries


def _drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as an image of 60 x 48 pixels: a bright page on a dark ground, its place by the part's key and size."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    p = spread(read(spark, sf_dir, "part")).select(F.col("p_partkey").alias("image"), (F.col("p_partkey") % 11).alias("a"), (F.col("p_size") % 13).alias("b"))
    w, h = 60, 48

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = np.arange(w), np.arange(h)[:, None]
        text = (225 - (x * 7 + y * 13) % 5 * 25).astype(np.int32)  # text on the page, so that its inside has edges
        for batch in batches:
            for i in range(0, len(batch), 1000):
                image, *places = batch.slice(i, 1000).columns
                a, b = (c.to_numpy(zero_copy_only=False)[:, None, None] for c in places)
                inside = (x >= a + 2) & (x <= w - 3 - b) & (y >= b + 2) & (y <= h - 3 - a)
                n = len(image)
                gray = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (w * h)), pa.array(np.where(inside, text, np.int32(40)).ravel()))
                yield pa.RecordBatch.from_arrays([image, pa.array(np.full(n, w, np.int32)), pa.array(np.full(n, h, np.int32)), gray], ["image", "width", "height", "gray"])

    return p.mapInArrow(draw, "image long, width int, height int, gray array<int>")


def _sides(found: DataFrame) -> DataFrame:
    c = F.col("corners")
    return found.select("image", F.round(c[0]["x"], 4).alias("left"), F.round(c[0]["y"], 4).alias("top"), F.round(c[2]["x"], 4).alias("right"), F.round(c[2]["y"], 4).alias("bottom"), "confidence", "fallback")


def page_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sides(detected_pages(_drawn(spark, sf_dir)))


def quad_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as frames of 70 x 70, their lines as four points each in an order of their own."""
    q, d, t, n = F.col("l_quantity").cast("int"), F.round(F.col("l_discount") * 100).cast("int"), F.round(F.col("l_tax") * 100).cast("int"), F.col("l_linenumber")
    points = F.array(point(d, t), point(q + 10, t + d % 3), point(q + 10 - d % 4, q + 12), point(t, q + d + 10))
    turned = F.array(*[F.get(points, (i * F.when(n % 2 == 0, 3).otherwise(1) + n) % 4) for i in range(4)])
    found = best_quads(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), F.lit(70).alias("width"), F.lit(70).alias("height"), n.alias("rank"), turned.alias("points")))
    c = F.col("corners")
    return found.select("image", *[F.round(c[i][k], 4).alias(f"{k}{i}") for i in range(4) for k in "xy"], F.round("confidence", 6).alias("confidence"), "fallback")


def flattened_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's drawing, flattened from a quad that leans by the part's key."""
    drawn = _drawn(spark, sf_dir)
    lean = F.col("image") % 5
    corners = F.array(point(lean + 3, F.lit(4)), point(F.lit(55) - lean, lean + 2), point(F.lit(57), F.lit(44) - lean), point(F.lit(2), F.lit(45)))
    flat = flattened(drawn.withColumn("corners", corners))
    summary = F.arrow_udf(_summary, "width int, height int, gray_sum long, inner_pixel int")
    return flat.select("image", summary("flat").alias("s")).select("image", "s.*")


def _summary(flat: pa.Array) -> pa.Array:
    """Size, sum of the pixels, and the one inside the upper left corner. Right behind ``flattened`` Spark runs it in the same Python task, so flat pixels go nowhere."""
    width, height, gray = flat.flatten()
    n = pc.list_value_length(gray).fill_null(0).to_numpy(zero_copy_only=False)
    pixels, ends, at = gray.flatten().to_numpy(zero_copy_only=False), np.cumsum(n), width.fill_null(0).to_numpy(zero_copy_only=False) + 1
    sums = np.concatenate([[0], np.cumsum(pixels, dtype=np.int64)])
    inner = np.zeros(len(n), np.int32)
    inner[at < n] = pixels[(ends - n + at)[at < n]]
    none = gray.is_null().to_numpy(zero_copy_only=False)
    return pa.StructArray.from_arrays([width, height, pa.array(np.diff(sums[ends], prepend=0), mask=none), pa.array(inner, mask=at >= n)], ["width", "height", "gray_sum", "inner_pixel"])


def fill_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines as pixels of a region that should be white: how it is covered."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", F.struct((F.lit(255) - F.floor(F.col("l_quantity") / 2)).alias("r"), (F.lit(255) - F.col("l_linenumber")).alias("g"), F.lit(250).alias("b")).alias("p"))
    white = {c: F.lit(255) for c in "rgb"}
    whole = lines.groupBy("l_orderkey").agg(F.collect_list("p").alias("pixels"))  # at most seven lines an order
    return whole.select(F.col("l_orderkey").alias("region"), F.size("pixels").alias("n_pixels"), shows_fill(F.col("pixels"), white).alias("filled"))


QUERIES = {f.__name__: f for f in (page_detection, quad_candidates, flattened_pages, fill_shown)}

_SCORED = """WITH raw AS (SELECT l_orderkey AS image, l_linenumber AS rank, CAST(l_quantity AS INTEGER) AS q, CAST(round(l_discount * 100) AS INTEGER) AS d, CAST(round(l_tax * 100) AS INTEGER) AS t FROM lineitem),
 four AS (SELECT image, rank, [[d, t], [q + 10, t + d % 3], [q + 10 - d % 4, q + 12], [t, q + d + 10]] AS p FROM raw),
 pts AS (SELECT image, rank, list_transform(range(0, 4), lambda i: list_transform(p[(i * CASE WHEN rank % 2 = 0 THEN 3 ELSE 1 END + rank) % 4 + 1], lambda v: CAST(v AS DOUBLE))) AS p FROM four),
 far AS (SELECT *, [list_sort(list_transform(p, lambda a, i: [a[1] + a[2], i]))[1][2], list_sort(list_transform(p, lambda a, i: [a[2] - a[1], i]))[1][2], list_sort(list_transform(p, lambda a, i: [-a[1] - a[2], i]))[1][2], list_sort(list_transform(p, lambda a, i: [a[1] - a[2], i]))[1][2]] AS k, list_avg(list_transform(p, lambda a: a[1])) AS cx, list_avg(list_transform(p, lambda a: a[2])) AS cy FROM pts),
 two AS (SELECT image, rank, list_transform(k, lambda i: p[CAST(i AS BIGINT)]) AS c, list_transform(list_sort(list_transform(p, lambda a, i: [atan2(a[2] - cy, a[1] - cx), i])), lambda z: p[CAST(z[2] AS BIGINT)]) AS ring FROM far),
 turn AS (SELECT *, list_transform(range(0, 4), lambda i: ring[(CAST(list_sort(list_transform(ring, lambda a, j: [a[1] + a[2], j]))[1][2] AS BIGINT) - 1 + i) % 4 + 1]) AS other, {turns} AS v FROM two),
 quads AS (SELECT image, rank, CASE WHEN len(list_distinct(c)) = 4 AND (list_min(v) > -1e-9 OR list_max(v) < 1e-9) THEN c ELSE other END AS c FROM turn),
 parts AS (SELECT *, {turns} AS v, abs(list_sum(list_transform(range(0, 4), lambda i: c[i + 1][1] * c[(i + 1) % 4 + 1][2] - c[(i + 1) % 4 + 1][1] * c[i + 1][2]))) / 2 / 4900 AS share, list_transform(range(0, 4), lambda i: sqrt(pow(c[(i + 1) % 4 + 1][1] - c[i + 1][1], 2) + pow(c[(i + 1) % 4 + 1][2] - c[i + 1][2], 2))) AS e,
 list_transform(range(0, 4), lambda i: (c[i + 1][1] - c[(i + 3) % 4 + 1][1]) * (c[(i + 1) % 4 + 1][1] - c[i + 1][1]) + (c[i + 1][2] - c[(i + 3) % 4 + 1][2]) * (c[(i + 1) % 4 + 1][2] - c[i + 1][2])) AS dots FROM quads),
 scores AS (SELECT image, rank, c, CASE WHEN (list_min(v) > -1e-9 OR list_max(v) < 1e-9) AND share BETWEEN 0.1 AND 0.999 AND greatest(e[1], e[3]) / greatest(e[2], e[4]) BETWEEN 0.15 AND 6.5 AND list_min(e) >= 3.5 THEN
 0.4 * (1 - least(abs(least(share, 1) - 0.65) / 0.65, 1)) + 0.35 * (least(e[1], e[3]) / greatest(e[1], e[3]) + least(e[2], e[4]) / greatest(e[2], e[4])) / 2
 + 0.25 * list_avg(list_transform(range(0, 4), lambda i: greatest(1 - abs(acos(greatest(least(-dots[i + 1] / (e[i + 1] * e[(i + 3) % 4 + 1]), 1), -1)) - pi() / 2) / (pi() / 2), 0))) ELSE 0 END AS s FROM parts),
 best AS (SELECT image, c, s FROM scores QUALIFY row_number() OVER (PARTITION BY image ORDER BY s DESC, rank) = 1),
 shown AS (SELECT image, s, CASE WHEN s > 0 THEN c ELSE [[2.8, 2.8], [67.2, 2.8], [67.2, 67.2], [2.8, 67.2]] END AS c FROM best)
 SELECT image, {corners}, round(s, 6) AS confidence, s = 0 AS fallback FROM shown"""
_TURNS = "list_transform(range(0, 4), lambda i: (c[(i + 1) % 4 + 1][1] - c[i + 1][1]) * (c[(i + 2) % 4 + 1][2] - c[(i + 1) % 4 + 1][2]) - (c[(i + 1) % 4 + 1][2] - c[i + 1][2]) * (c[(i + 2) % 4 + 1][1] - c[(i + 1) % 4 + 1][1]))"
ORACLE_SQL = {
    "quad_candidates": _SCORED.replace("{turns}", _TURNS).replace("{corners}", ", ".join(f"round(least(greatest(c[{i + 1}][{j + 1}], 0), 70), 4) AS {k}{i}" for i in range(4) for j, k in enumerate("xy"))),
    "page_detection": """WITH p AS (SELECT p_partkey AS image, p_partkey % 11 AS a, p_size % 13 AS b FROM part),
 g AS (SELECT image, x, y, CASE WHEN x BETWEEN a + 2 AND 57 - b AND y BETWEEN b + 2 AND 45 - a THEN 225 - (x * 7 + y * 13) % 5 * 25 ELSE 40 END AS v FROM p, range(0, 60) AS u(x), range(0, 48) AS w(y)),
 n AS (SELECT image, x, y, lag(v) OVER r AS l, lead(v) OVER r AS r, v FROM g WINDOW r AS (PARTITION BY image, y ORDER BY x)),
 m AS (SELECT image, x, y, r - l AS dx, l + 2 * v + r AS s FROM n WHERE x BETWEEN 1 AND 58),
 e AS (SELECT image, x, y, sqrt(pow(lag(dx) OVER c + 2 * dx + lead(dx) OVER c, 2) + pow(lead(s) OVER c - lag(s) OVER c, 2)) AS z FROM m WINDOW c AS (PARTITION BY image, x ORDER BY y)),
 sums AS (SELECT image, 'y' AS k, y AS i, sum(z) AS z FROM e WHERE y BETWEEN 1 AND 46 GROUP BY image, y UNION ALL SELECT image, 'x', x, sum(z) FROM e WHERE y BETWEEN 1 AND 46 GROUP BY image, x),
 high AS (SELECT image, k, i, i - row_number() OVER (PARTITION BY image, k ORDER BY i) AS run FROM (SELECT *, max(z) OVER (PARTITION BY image, k) AS top FROM sums) WHERE top > 0 AND z >= 0.15 * top),
 runs AS (SELECT image, k, min(i) AS a, max(i) + 1 AS b FROM high GROUP BY image, k, run QUALIFY row_number() OVER (PARTITION BY image, k ORDER BY max(i) - min(i) DESC, min(i)) = 1),
 box AS (SELECT image, max(a) FILTER (k = 'x') AS l, max(b) FILTER (k = 'x') AS r, max(a) FILTER (k = 'y') AS t, max(b) FILTER (k = 'y') AS m FROM runs GROUP BY image),
 ok AS (SELECT *, coalesce((r - l) * (m - t) / 2880.0 BETWEEN 0.1 AND 0.999 AND (r - l) / (m - t) BETWEEN 0.15 AND 6.5 AND least(r - l, m - t) >= 2.4, false) AS good FROM p LEFT JOIN box USING (image))
 SELECT image, CASE WHEN good THEN CAST(l AS DOUBLE) ELSE 2.4 END AS left, CASE WHEN good THEN CAST(t AS DOUBLE) ELSE 1.92 END AS top, CASE WHEN good THEN CAST(r AS DOUBLE) ELSE 57.6 END AS right, CASE WHEN good THEN CAST(m AS DOUBLE) ELSE 46.08 END AS bottom, CASE WHEN good THEN 0.6 ELSE 0 END AS confidence, NOT good AS fallback FROM ok""",
    "fill_shown": "SELECT l_orderkey AS region, CAST(count(*) AS INTEGER) AS n_pixels, count(*) FILTER (floor(l_quantity / 2) <= 24 AND l_linenumber <= 24) >= 0.97 * count(*) AS filled FROM lineitem GROUP BY l_orderkey",
}
