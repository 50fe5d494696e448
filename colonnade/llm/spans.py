"""Places of regular-expression matches, by DataFrame functions alone.

regexp_extract_all gives a text's matches and split what lies between them, by the same left-to-right search; the
places follow from running sums of their lengths (in characters, or in words).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased texts, as they stand before lower-casing; and what parts them.
#: The class is written by what it holds: Java matches negated classes of several ranges some twenty times slower.
WORD_CHAR = r"[0-9A-Za-z\x80-\x{10FFFF}]"
PART_CHAR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often body names it, inside lambdas too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def char_length(text: Column) -> Column:
    return F.length(text)


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(f"{WORD_CHAR}++"), F.lit(0)))


def _running(numbers: Column, join: Callable[[Column, Column], Column]) -> Column:
    """The members up to each joined; in blocks of about the root of their number, so long lists stay cheap."""

    def total(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: join(a, x))

    def blocked(xs: Column) -> Column:
        n = F.size(xs)
        return let(F.ceil(F.sqrt(n)).cast("int"), lambda b: let(of_blocks(xs, n, b), lambda sums: let(earlier(sums), lambda before: inside(xs, n, b, before))))

    def of_blocks(xs: Column, n: Column, b: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), (n - 1).cast("int"), b), lambda at: total(F.slice(xs, at + 1, b)))

    def earlier(sums: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(sums) - 1), lambda k: total(F.slice(sums, F.lit(1), k)))

    def inside(xs: Column, n: Column, b: Column, before: Column) -> Column:
        def at(i: Column) -> Column:
            block = F.floor(i / b).cast("int")
            return join(F.get(before, block), total(F.slice(xs, block * b + 1, i - block * b + 1)))

        return F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), at)

    empty = F.array().cast("array<bigint>")
    return let(numbers, lambda xs: F.when(F.size(xs) == 0, empty).otherwise(blocked(xs)))


def running_sums(numbers: Column) -> Column:
    return _running(numbers, lambda a, b: a + b)


def running_most(numbers: Column) -> Column:
    """The largest so far, of numbers that aren't negative."""
    return _running(numbers, F.greatest)


def matches(text: Column, pattern: str, measure: Callable[[Column], Column] = char_length, likely: Column | None = None) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, text), measured in characters or words; end exclusive.

    likely: something cheap that holds wherever there is a match; other texts aren't searched.
    """

    def places(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: measure(g).cast("long") + measure(m))
        return let(running_sums(steps), lambda ends: F.zip_with(ends, found, lambda e, m: F.struct((e - measure(m)).alias("start"), e.alias("end"), m.alias("text"))))

    none = F.array().cast("array<struct<start:bigint,end:bigint,text:string>>")
    out = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, none).otherwise(places(found)))
    return out if likely is None else F.when(likely, out).otherwise(none)


def joined(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(kind: str, found: Column) -> Column:
    return F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))


def replaced(text: Column, spans: Column, by: Callable[[Column], Column]) -> Column:
    """The text with `by` of each span (kind, start, end) in its place; where spans overlap, a later one keeps what no earlier one covers."""

    def uncovered(ordered: Column) -> Column:
        return let(running_most(F.transform(ordered, lambda s: s["end"])), lambda ends: F.filter(F.transform(ordered, lambda s, i: cut(s, i, ends)), lambda s: s["start"] < s["end"]))

    def cut(s: Column, i: Column, ends: Column) -> Column:
        covered = F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(ends, i - 1))
        return F.struct(s["kind"].alias("kind"), F.greatest(s["start"], covered).alias("start"), s["end"].alias("end"))

    def parts(clean: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            before = F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(clean, i - 1)["end"])
            return F.concat(F.substring(text, (before + 1).cast("int"), (s["start"] - before).cast("int")), by(s))

        rest = F.substring(text, (F.get(clean, F.size(clean) - 1)["end"] + 1).cast("int"), F.length(text))
        return F.concat(F.array_join(F.transform(clean, piece), ""), rest)

    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.when(F.size(spans) == 0, text).otherwise(let(by_start, lambda o: let(uncovered(o), parts)))


def blanked(text: Column, spans: Column) -> Column:
    """The text with spaces in place of the spans; all else keeps its place."""
    return replaced(text, spans, lambda s: F.repeat(F.lit(" "), (s["end"] - s["start"]).cast("int")))


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
