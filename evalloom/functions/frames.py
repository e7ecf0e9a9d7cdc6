"""Frame numbers, tile grids, chunks and vectors: index arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .coords import let


def spaced(last: Column, count: Column) -> Column:
    """``count`` whole numbers at equal steps from 0 to ``last``, fractions cut off; 0 alone for a count of 1."""
    step = F.when(count > 1, last / (count - 1)).otherwise(0.0)
    at = lambda i: F.when((i == count - 1) & (count > 1), last).otherwise((i * step).cast("int"))
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: at(i).cast("int"))).otherwise(F.array().cast("array<int>"))


def sampled_count(total: Column, count: Column, rate: Column | None = None, fps: Column | None = None) -> Column:
    """How many frames to take: at most ``count``, at most ``fps`` a second, at most all."""
    most = count if fps is None else F.when(fps.isNull(), count).otherwise(F.least(count, (total / rate * fps).cast("int")))
    return F.least(total, most).cast("int")


def stream_frames(total: Column, count: Column, rate: Column | None = None, fps: Column | None = None, with_last: bool = False) -> Column:
    """Frames at equal steps; ``with_last`` takes one fewer of those before the last frame, and it, where it's missing."""
    n = sampled_count(total, count, rate, fps)
    plain = spaced(total - 1, n)
    if not with_last:
        return plain
    return let(plain, lambda p: F.when(F.array_contains(p, (total - 1).cast("int")), p).otherwise(F.concat(spaced(total - 2, n - 1), F.array((total - 1).cast("int")))))


def packet_frames(total: Column, count: Column, rate: Column | None = None, fps: Column | None = None) -> Column:
    """Frames at equal steps, and the last one after them where it's missing."""
    last = (total - 1).cast("int")
    return let(spaced(total - 1, sampled_count(total, count, rate, fps)), lambda p: F.when(F.array_contains(p, last), p).otherwise(F.concat(p, F.array(last))))


def grids(least: int, most: int) -> list[tuple[int, int]]:
    """Columns and rows of all grids of ``least`` to ``most`` tiles, fewer tiles first."""
    return sorted({(i, j) for i in range(1, most + 1) for j in range(1, most + 1) if least <= i * j <= most}, key=lambda x: (x[0] * x[1], x))


def tile_grid(width: Column, height: Column, least: int = 1, most: int = 6, tile: int = 448) -> Column:
    """struct<columns, rows, target_width, target_height, tiles> of the grid whose shape is nearest the picture's.

    Of grids equally near the later one wins if the picture has more than half of its pixels.
    """
    every = F.array(*[F.struct(F.lit(i).alias("c"), F.lit(j).alias("r")) for i, j in grids(least, most)])
    shape, area = width / height, width.cast("double") * height

    def step(best, g):
        gap = F.abs(shape - g["c"] / g["r"])
        tie = (gap == best["gap"]) & (area > 0.5 * tile * tile * g["c"] * g["r"])
        return F.when((gap < best["gap"]) | tie, F.struct(gap.alias("gap"), g["c"].alias("c"), g["r"].alias("r"))).otherwise(best)

    start = F.struct(F.lit(float("inf")).alias("gap"), F.lit(1).alias("c"), F.lit(1).alias("r"))
    return F.aggregate(every, start, step, lambda b: F.struct(b["c"].alias("columns"), b["r"].alias("rows"), (b["c"] * tile).alias("target_width"), (b["r"] * tile).alias("target_height"), (b["c"] * b["r"]).alias("tiles")))


def divided(values: Column, parts: int) -> Column:
    """``parts`` consecutive slices whose sizes differ by 1 at most, larger ones first; slices may be empty."""
    def cut(v):
        n = F.size(v)
        size, rest = F.floor(n / parts).cast("int"), n % parts
        begin = lambda i: i * size + F.least(i, rest)
        return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.slice(v, begin(i) + 1, begin(i + 1) - begin(i)))

    return let(values, cut)


def mean_vector(vectors: Column) -> Column:
    """The mean of equally long vectors, component by component."""
    def of(v):
        return F.transform(F.sequence(F.lit(0), F.size(v[0]) - 1), lambda i: F.aggregate(v, F.lit(0.0), lambda s, x: s + F.get(x, i).cast("double")) / F.size(v))

    return let(vectors, of)


def joined_embedding(images: Column, text: Column) -> Column:
    """The mean of a sample's image vectors, followed by its text vector."""
    return F.concat(mean_vector(images), F.transform(text, lambda x: x.cast("double")))


def viewport_offsets(height: Column, step: Column) -> Column:
    """Upper edges of the views that a page is captured in."""
    return F.when(height > 0, F.sequence(F.lit(0).cast("int"), (height - 1).cast("int"), step.cast("int"))).otherwise(F.array().cast("array<int>"))


def squeezed(vector: Column) -> Column:
    """A list of one vector as the vector."""
    return vector[0]
