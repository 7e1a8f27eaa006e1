"""Scalar expressions: metadata parsing, boundary features, geometry, saliency and score texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import config


def parse_number(value: Column, default: float = 0.0) -> Column:
    """First token of a text as a number; a/b as a ratio; anything else, an empty text or a zero divisor: the default."""
    token = F.get(F.split(F.trim(value), r"\s+"), F.lit(0))
    parts = F.split(token, "/")
    ratio = F.try_divide(F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double"))
    return F.coalesce(F.when(F.contains(token, F.lit("/")), ratio).otherwise(token.try_cast("double")), F.lit(default))


def exposure_value(f_number: Column, seconds: Column, iso: Column) -> Column:
    """log2(F^2 / t) + log2(100 / ISO); null where one of the three is zero."""
    return F.when(f_number * seconds * iso != 0, F.log2(f_number * f_number / seconds) + F.log2(F.lit(100.0) / iso))


def parse_timestamp(date: Column, subsecond: Column) -> Column:
    """Epoch seconds of `yyyy:MM:dd HH:mm:ss` plus the digits after the point; 0.0 if either part is unreadable."""
    base = F.unix_micros(F.try_to_timestamp(F.coalesce(date, F.lit("1970:01:01 00:00:00")), F.lit("yyyy:MM:dd HH:mm:ss"))) / 1e6
    digits = F.coalesce(subsecond, F.lit("0"))
    return F.coalesce(base + digits.try_cast("int") / F.pow(F.lit(10.0), F.length(digits)), F.lit(0.0))


def relative_change(now: Column, before: Column) -> Column:
    return F.when(before > 0, F.abs(now - before) / (before + 1e-8)).otherwise(0.0)


def eye_aspect_ratio(points: Column) -> Column:
    """(|p2-p6| + |p3-p5|) / (2 |p1-p4| + 1e-8) of an array of six (x, y)."""
    p = lambda i: F.element_at(points, i)
    dist = lambda a, b: F.sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))
    return (dist(p(2), p(6)) + dist(p(3), p(5))) / (2 * dist(p(1), p(4)) + 1e-8)


def eye_ratio(near: Column, far: Column) -> Column:
    return F.least(F.greatest(near / (far + 1e-6) - 1, F.lit(0.0)), F.lit(3.0)) * 0.1


def isolation_ratio(subject: Column, background: Column) -> Column:
    return subject / (background + 1e-6)


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def saliency_confidence(cells: Column, n: int = config.SALIENCY_CELLS) -> Column:
    """1 - entropy / ln n of a map scaled to sum 1, within 0..1."""
    entropy = F.aggregate(F.transform(F.array(array_sum(cells) + 1e-10), lambda s: F.aggregate(cells, F.lit(0.0), lambda a, x: a - x / s * F.ln(x / s + 1e-10))), F.lit(0.0), lambda a, x: a + x)
    return F.least(F.greatest(1 - entropy / F.ln(F.lit(float(n))), F.lit(0.0)), F.lit(1.0))


def l2_normalize(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.flatten(F.transform(F.array(norm), lambda n: F.transform(vector, lambda x: x.cast("double") / (n + 1e-8))))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - dot product of two unit vectors."""
    return 1 - F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def expected_score(logits: Column) -> Column:
    """Mean of 0, 1, 2, ... under the softmax of the logits."""
    top = F.array_max(logits)
    weights = F.transform(logits, lambda x: F.exp(x - top))
    return array_sum(F.transform(weights, lambda w, i: w * i)) / array_sum(weights)


def rescale_percent(score: Column) -> Column:
    """0..100 to 0..10; missing counts as 50."""
    return F.coalesce(score, F.lit(50.0)) / 10


#: The number and score patterns of model answers.
_NUMBER = r"([0-9]+\.?[0-9]*)"
_SCORE_PATTERNS = (r"(?i)(?:score|rating)\s*[:=]?\s*" + _NUMBER, r"(?i)" + _NUMBER + r"\s*(?:out of|/)\s*[0-9]+", r"^" + _NUMBER + r"\s*$")


def _numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(_NUMBER), F.lit(1)), lambda x: x.cast("double"))


def rating_from_text(text: Column, default: float = 3.0) -> Column:
    """1..5 from a model's answer: JSON rating, JSON in <answer>, number in <answer>, any number in 0.5..5.5, default."""
    answer = F.trim(F.regexp_extract(text, r"(?s)<answer>\s*(.*?)\s*</answer>", 1))
    first = lambda t: F.get(F.filter(_numbers(t), lambda v: v.between(0.5, 5.5)), F.lit(0))
    rating = lambda t: F.get_json_object(t, "$.rating").try_cast("double")
    found = F.coalesce(rating(F.trim(text)), rating(answer), first(answer), first(text), F.lit(default))
    return F.least(F.greatest(found, F.lit(1.0)), F.lit(5.0))


def score_from_text(text: Column, default: float = 5.0, top: float = 10.0) -> Column:
    """0..top from a model's answer: `score: x`, `x / n` or `x out of n`, a bare number, else the first number up to 100.

    Values over ``top`` are on a scale of 100.
    """
    trimmed = F.trim(text)
    named = F.coalesce(*(F.nullif(F.regexp_extract(trimmed, p, 1), F.lit("")).cast("double") for p in _SCORE_PATTERNS))
    loose = F.get(F.filter(_numbers(trimmed), lambda v: v <= max(top, 100.0)), F.lit(0))
    scaled = lambda v: F.when(v > top, v / (100.0 / top)).otherwise(v)
    return F.least(F.greatest(F.coalesce(scaled(named), scaled(loose), F.lit(default)), F.lit(0.0)), F.lit(top))


def tile_grids(most: int = 6) -> list[tuple[int, int]]:
    """All grids (columns, rows) of at most ``most`` tiles, by number of tiles."""
    return sorted(((i, j) for i in range(1, most + 1) for j in range(1, most + 1) if i * j <= most), key=lambda g: (g[0] * g[1], g))


def closest_grid(width: Column, height: Column, tile: int = 448, most: int = 6) -> Column:
    """The grid (i, j) whose ratio is nearest to the image's; a tie goes to a larger grid if it fits half the area."""
    aspect, area = width / height, width.cast("double") * height
    best = F.struct(F.lit(float("inf")).alias("d"), F.lit(1).alias("i"), F.lit(1).alias("j"))
    grids = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in tile_grids(most)))

    def step(acc: Column, g: Column) -> Column:
        d = F.abs(aspect - g.i / g.j)
        take = (d < acc.d) | ((d == acc.d) & (area > 0.5 * tile * tile * g.i * g.j))
        return F.when(take, F.struct(d.alias("d"), g.i.alias("i"), g.j.alias("j"))).otherwise(acc)

    return F.aggregate(grids, best, step)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def rendering_path(ext: Column, sidecar_bytes: Column, extracted: Column) -> Column:
    """native_jpeg for direct formats, embedded_jpeg with a sidecar over 10,000 bytes or an extraction, else rawpy."""
    return F.when(ext.isin(*config.DIRECT_EXTENSIONS), "native_jpeg").when((F.coalesce(sidecar_bytes, F.lit(0)) > 10_000) | F.coalesce(extracted, F.lit(False)), "embedded_jpeg").otherwise("rawpy")


def scaled_size(width: Column, height: Column, longest: int = 2500) -> tuple[Column, Column]:
    """Width and height with the longer side at most ``longest``; never larger than before, truncated."""
    factor = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(width, height))
    return (width * factor).cast("int"), (height * factor).cast("int")


def label(selected: Column, disagreement: Column, gate: Column) -> Column:
    """Purple: selected and in disagreement; Red: selected; Green: failed the gate; none otherwise."""
    return F.when(selected & disagreement, "Purple").when(selected, "Red").when(~gate, "Green").otherwise("")
