"""Sentences, tokens, n-grams and regex matches with exact code-point offsets.

Offsets are 0-based and ``end`` is exclusive.  Every function maps a text column
to an array column on the same row: no explode, no window, no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilwork.functions.arrays import (
    SCAN_BLOCK_BITS,
    empty_array,
    let,
    running_starts,
    scan_blocks,
)

SEPARATOR = "\u0001"
# The same six characters in Java and RE2, unlike \s.
SPACE_CLASS = r"[ \t\n\x0B\f\r]"
NOT_SPACE_CLASS = r"[^ \t\n\x0B\f\r]"
TRIMMED_PUNCTUATION = ".,;:!?()"

# A sentence ends after . ! ? and whitespace, or after a newline.
SENTENCE_END = rf"[.!?]{SPACE_CLASS}++|\n{SPACE_CLASS}*+"
TOKEN_MARKS = f"$1{SEPARATOR}$2{SEPARATOR}"

MATCH_TYPE = "struct<begin:int,end:int,match:string>"
SENTENCE_TYPE = "struct<sent_id:int,begin:int,end:int,sentence:string>"
TOKEN_TYPE = "struct<token_id:int,begin:int,end:int,token:string>"


def clean_text(text: Column) -> Column:
    """Replace the two control characters used as marks by spaces (length kept)."""
    return F.when(
        F.contains(text, F.lit("\u0001")) | F.contains(text, F.lit("\u0002")),
        F.translate(text, "\u0001\u0002", "  "),
    ).otherwise(text)


def ascii_lower(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def _marked_pieces(text: Column, pattern: str, replacement: str) -> Column:
    return F.split(F.regexp_replace(text, pattern, replacement), SEPARATOR)


def find_matches(
    text: Column, pattern: str, replacement: str = f"{SEPARATOR}$0{SEPARATOR}"
) -> Column:
    """Leftmost non-overlapping matches of a regex, with offsets.

    The text is marked on both sides of each match and split, so gaps and
    matches alternate and the odd pieces are the matches.
    """

    def collect(ps: Column) -> Column:
        return let(
            running_starts(F.transform(ps, F.length)),
            lambda starts: F.transform(
                F.sequence(F.lit(1), F.size(ps) - 2, F.lit(2)),
                lambda i: F.struct(
                    starts[i].alias("begin"), starts[i + 1].alias("end"), ps[i].alias("match")
                ),
            ),
        )

    return let(
        _marked_pieces(text, pattern, replacement),
        lambda ps: F.when(F.size(ps) > 1, collect(ps)).otherwise(empty_array(MATCH_TYPE)),
    )


def sentence_counter(text: Column) -> Callable[[Callable[[Callable[[Column], Column]], Column]], Column]:
    """Bind a text's sentence starts and give a function from offset to sentence number.

    The starts are grouped, so one lookup reads one start per group and one group.
    """

    def bind(body: Callable[[Callable[[Column], Column]], Column]) -> Column:
        def lookup(groups: Column) -> Callable[[Column], Column]:
            def number(offset: Column) -> Column:
                return let(
                    F.greatest(F.size(F.filter(groups, lambda g: g[0] <= offset)) - 1, F.lit(0)),
                    lambda last: F.shiftleft(last, SCAN_BLOCK_BITS)
                    + F.size(F.filter(groups[last], lambda s: s <= offset))
                    - 1,
                )

            return number

        starts = running_starts(
            F.transform(_marked_pieces(text, SENTENCE_END, f"$0{SEPARATOR}"), F.length)
        )
        return let(let(starts, scan_blocks), lambda groups: body(lookup(groups)))

    return bind


def sentences(text: Column) -> Column:
    """Split a cleaned text into sentences; their lengths add up to the text's.

    A sentence ends after ``. ! ?`` and whitespace, or after a newline; the
    whitespace belongs to the sentence before it.
    """
    return let(
        _marked_pieces(text, SENTENCE_END, f"$0{SEPARATOR}"),
        lambda ps: let(
            running_starts(F.transform(ps, F.length)),
            lambda starts: F.filter(
                F.transform(
                    ps,
                    lambda p, i: F.struct(
                        i.alias("sent_id"),
                        starts[i].alias("begin"),
                        (starts[i] + F.length(p)).alias("end"),
                        p.alias("sentence"),
                    ),
                ),
                lambda s: F.length(s["sentence"]) > 0,
            ),
        ),
    )


def tokens(sentence: Column) -> Column:
    """All whitespace-separated tokens of one sentence, edge punctuation trimmed."""
    return F.transform(
        find_matches(sentence, _token_pattern(""), TOKEN_MARKS),
        lambda m, i: F.struct(
            i.alias("token_id"), m["begin"].alias("begin"), m["end"].alias("end"), m["match"].alias("token")
        ),
    )


def _token_pattern(needed: str) -> str:
    """Group 1 is leading punctuation, group 2 the token without edge punctuation.

    The lookbehind starts a try only where a token starts, which keeps a long
    unbroken run linear.
    """
    edge = re.escape(TRIMMED_PUNCTUATION)
    return (
        rf"(?<!{NOT_SPACE_CLASS})([{edge}]*+){needed}"
        rf"({NOT_SPACE_CLASS}*[^ \t\n\x0B\f\r{edge}])"
    )


def text_tokens(text: Column, signal_only: bool) -> Column:
    """Tokens of a whole text as matches.

    ``signal_only`` keeps the tokens that hold a digit or an ``@``: every shipped
    token rule needs one, so other words never become array elements.
    """
    needed = r"(?=[^ \t\n\x0B\f\r0-9@]*+[0-9@])" if signal_only else ""
    return find_matches(text, _token_pattern(needed), TOKEN_MARKS)


def ngrams(toks: Column, longest: int) -> Column:
    """Runs of 1..``longest`` tokens as (token_id, n, begin, end, phrase).

    ``phrase`` is the ASCII-lowered tokens joined by one blank.
    """

    def of_length(ts: Column, n: int) -> Column:
        starts = F.slice(ts, F.lit(1), F.greatest(F.size(ts) - (n - 1), F.lit(0)))
        return F.transform(
            starts,
            lambda t, i: F.struct(
                t["token_id"].alias("token_id"),
                F.lit(n).alias("n"),
                t["begin"].alias("begin"),
                ts[i + (n - 1)]["end"].alias("end"),
                ascii_lower(
                    F.array_join(F.transform(F.slice(ts, i + 1, F.lit(n)), lambda x: x["token"]), " ")
                ).alias("phrase"),
            ),
        )

    return let(
        toks, lambda ts: F.flatten(F.array(*[of_length(ts, n) for n in range(1, longest + 1)]))
    )
