"""Match positions in DataFrame functions: regular expressions to arrays of spans, row by row and without a shuffle.

``regexp_extract_all`` gives a pattern's matches and ``split`` the gaps between them; running totals of their lengths
are the positions, in code points. Patterns must not match the empty string.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,txt:string,before:string,after:string>"
CONTEXT = 48  # code points of context kept on either side of a match


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_totals(steps: Column) -> Column:
    """Inclusive running totals of an array of integers, by blocks of about the square root of its size."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda a, x: a + x)

    def blocks(v: Column) -> Column:
        n, width = F.size(v.steps), v.width
        starts = F.sequence(F.lit(0), n - 1, width)
        sums = F.transform(starts, lambda a: total(F.slice(v.steps, a + 1, width)))
        before = let(sums, lambda s: F.transform(s, lambda _, i: total(F.slice(s, 1, i))))
        inside = let(
            before,
            lambda b: F.flatten(F.transform(starts, lambda a, i: F.transform(F.sequence(F.lit(1), F.least(width, n - a)), lambda k: F.get(b, i) + total(F.slice(v.steps, a + 1, k))))),
        )
        return F.when(n > 0, inside).otherwise(F.array().cast("array<int>"))

    width = lambda s: F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(s))).cast("int"))
    return let(steps, lambda s: let(F.struct(s.alias("steps"), width(s).alias("width")), blocks))


def find_spans(text: Column, pattern: str, only_if: Column | None = None) -> Column:
    """All leftmost non-overlapping matches of a Java pattern as an array of SPAN, looked for only where ``only_if`` holds."""

    def place(v: Column) -> Column:
        steps = F.transform(v.m, lambda _, i: F.length(F.get(v.g, i)) + F.when(i > 0, F.length(F.get(v.m, i - 1))).otherwise(0))
        return let(
            running_totals(steps),
            lambda at: F.transform(
                v.m,
                lambda x, i: F.struct(
                    F.get(at, i).alias("start"),
                    (F.get(at, i) + F.length(x)).alias("end"),
                    x.alias("txt"),
                    F.right(F.get(v.g, i), F.lit(CONTEXT)).alias("before"),
                    F.left(F.get(v.g, i + 1), F.lit(CONTEXT)).alias("after"),
                ),
            ),
        )

    none = F.array().cast(f"array<{SPAN}>")
    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, let(F.struct(m.alias("m"), F.split(text, pattern, -1).alias("g")), place)).otherwise(none))
    return found if only_if is None else F.when(only_if, found).otherwise(none)


def join_spans(kinds: list[str], spans: list[Column]) -> Column:
    """``kind:start:end`` of all spans by start, then by kind as listed, comma-joined."""

    def numbered(span: Column, k: int) -> Column:
        return F.transform(span, lambda x: F.struct(x.start.alias("start"), F.lit(k).alias("kind"), x.end.alias("end")))

    merged = F.concat(*(numbered(s, k) for k, s in enumerate(spans)))
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(F.array_sort(merged), lambda x: F.concat_ws(":", F.get(names, x.kind), x.start.cast("string"), x.end.cast("string"))), ",")


def cut_spans(text: Column, merged: Column, mark: str) -> Column:
    """The text with every span of an array of (start, end), sorted and apart, replaced by ``mark``."""
    starts, ends = F.concat(F.array(F.lit(0)), F.transform(merged, lambda x: x.end)), F.concat(F.transform(merged, lambda x: x.start), F.array(F.length(text)))
    return F.array_join(F.zip_with(starts, ends, lambda a, b: F.substring(text, a + 1, b - a)), mark)


def merge_spans(spans: Column) -> Column:
    """Overlapping or touching spans united; sorted by start."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x.start.alias("start"), x.end.alias("end"))))

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        return F.when((F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)).end, F.lit(-1)) >= x.start), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last.start.alias("start"), F.greatest(last.end, x.end).alias("end"))))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(ordered, F.array().cast("array<struct<start:int,end:int>>"), step)
