"""Linear-time array helpers for work that stays inside one row.

Everything here is a pure column expression, so it runs in the JVM, needs no
shuffle and composes inside other higher-order functions.  The helpers exist
because a plain ``aggregate`` that appends to an array copies it at every step
(quadratic), and ``substring`` walks the text from its start (quadratic over
many substrings of one long text).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SCAN_BLOCK_BITS = 7
SCAN_BLOCK = 1 << SCAN_BLOCK_BITS
TEXT_BLOCK_BITS = 9
TEXT_BLOCK = 1 << TEXT_BLOCK_BITS


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it several times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def empty_array(element_type: str) -> Column:
    return F.array().cast(f"array<{element_type}>")


def _fold_scan(values: Column, first: Column, op: Callable[[Column, Column], Column]) -> Column:
    """``[first, op(first, v1), op(.., v2), ...]`` for one short array."""
    return F.aggregate(
        values,
        F.array(first),
        lambda acc, v: F.array_append(acc, op(F.element_at(acc, -1), v)),
    )


def scan_blocks(values: Column) -> Column:
    """Cut a non-empty array into consecutive pieces of ``SCAN_BLOCK`` elements."""
    return F.transform(
        F.sequence(F.lit(0), F.shiftright(F.size(values) - 1, SCAN_BLOCK_BITS)),
        lambda b: F.slice(values, F.shiftleft(b, SCAN_BLOCK_BITS) + 1, F.lit(SCAN_BLOCK)),
    )


def exclusive_scan(
    values: Column, first: Column, op: Callable[[Column, Column], Column]
) -> Column:
    """Exclusive running fold of an array by an associative ``op``.

    Element i is ``op`` over all elements before i.  Two levels of blocks keep
    the copying at a constant number of references per element.
    """

    def blocked(vals: Column) -> Column:
        return let(
            scan_blocks(vals),
            lambda bs: let(
                _fold_scan(F.transform(bs, lambda b: F.aggregate(b, first, op)), first, op),
                lambda starts: F.flatten(
                    F.transform(
                        bs,
                        lambda b, i: F.slice(_fold_scan(b, starts[i], op), F.lit(1), F.size(b)),
                    )
                ),
            ),
        )

    def short(vals: Column) -> Column:
        return F.slice(_fold_scan(vals, first, op), F.lit(1), F.size(vals))

    return let(
        values,
        lambda vals: F.when(F.size(vals) <= SCAN_BLOCK, short(vals)).otherwise(blocked(vals)),
    )


def running_starts(lengths: Column) -> Column:
    """Start offset of every piece, given the pieces' lengths."""
    return exclusive_scan(lengths, F.lit(0), lambda a, b: a + b)


def text_blocks(text: Column) -> Column:
    """Cut a text into fixed-size pieces of code points for cheap random access."""
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % TEXT_BLOCK), F.lit(0))


def block_substring(blocks: Column, begin: Column, end: Column) -> Column:
    """``text[begin:end)`` in code points, touching only the blocks it covers."""

    def cut(first: Column) -> Column:
        covered = F.slice(blocks, first + 1, F.shiftright(end - 1, TEXT_BLOCK_BITS) - first + 1)
        return F.substring(
            F.array_join(covered, ""), begin - F.shiftleft(first, TEXT_BLOCK_BITS) + 1, end - begin
        )

    return F.when(end <= begin, F.lit("")).otherwise(
        let(F.shiftright(begin, TEXT_BLOCK_BITS), cut)
    )


def search_steps(size: Column) -> Column:
    """The falling powers of two of a binary search in ``size`` elements; bind them once for many searches."""
    return F.filter(F.array(*[F.lit(1 << k) for k in range(30, -1, -1)]), lambda x: x <= size)


def leading_count(size: Column, holds: Callable[[Column], Column], steps: Column | None = None) -> Column:
    """How many of ``size`` elements, from the first on, satisfy a test that none satisfies after one that does not.

    ``holds`` takes an index.  Falling powers of two (``search_steps``) make it a binary search.
    """
    return F.aggregate(
        search_steps(size) if steps is None else steps,
        F.lit(0),
        lambda n, step: F.when((n + step <= size) & holds(n + step - 1), n + step).otherwise(n),
    )
