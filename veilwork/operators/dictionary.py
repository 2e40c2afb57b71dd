"""Phrase look-up: short fixed lists on the row, large dictionaries by join."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.functions.arrays import empty_array, let
from veilwork.functions.text import (
    SENTENCE_END,
    TRIMMED_PUNCTUATION,
    ascii_lower,
    clean_text,
    ngrams,
    sentence_counter,
    sentences,
    tokens,
)
from veilwork.operators.rules import CHUNK_TYPE

MAX_INLINE_PHRASES = 2000
BITS_PER_PHRASE, HASHES, LEAST_BITS, MOST_BITS = 16, 3, 10, 26


def plain_phrase(phrase: str) -> str:
    """A phrase as n-grams write it: cut like a text, A-Z lowered, tokens joined by one blank."""
    cut = (w.strip(TRIMMED_PUNCTUATION) for w in re.split(r"[ \t\n\x0B\f\r]+", phrase))
    return re.sub("[A-Z]", lambda m: m[0].lower(), " ".join(w for w in cut if w))


def phrase_table(dictionary: DataFrame) -> DataFrame:
    """(entity, phrase, n, crosses) of a dictionary: phrases as n-grams write them, their tokens, and whether a sentence ends inside."""
    plain = clean_text(F.col("phrase"))
    cut = F.transform(tokens(plain), lambda t: t["token"])
    return (
        dictionary.select("entity", cut.alias("cut"), F.rlike(F.trim(plain), F.lit(SENTENCE_END + r"[^ \t\n\x0B\f\r]")).alias("crosses"))
        .select("entity", ascii_lower(F.array_join("cut", " ")).alias("phrase"), F.size("cut").alias("n"), F.coalesce("crosses", F.lit(False)).alias("crosses"))
        .where("n > 0")
        .distinct()
    )


def sentence_ngrams(text: Column, longest: int) -> Column:
    """All n-grams of a text as (sent_id, token_id, n, begin, end, phrase)."""
    return F.flatten(
        F.transform(
            sentences(text),
            lambda s: F.transform(
                ngrams(tokens(s["sentence"]), longest),
                lambda g: F.struct(
                    s["sent_id"].alias("sent_id"),
                    g["token_id"].alias("token_id"),
                    g["n"].alias("n"),
                    (s["begin"] + g["begin"]).alias("begin"),
                    (s["begin"] + g["end"]).alias("end"),
                    g["phrase"].alias("phrase"),
                ),
            ),
        )
    )


def word_findings(text: Column, lists: Mapping[str, Sequence[str]]) -> Column:
    """Findings of short fixed phrase lists; the lists become hash sets in the plan."""
    if sum(map(len, lists.values())) > MAX_INLINE_PHRASES:
        raise ValueError("too many phrases to inline; use dictionary_chunks")
    if not lists:
        return F.when(text.isNotNull(), empty_array(CHUNK_TYPE))
    lists = {e: [q for p in ps if (q := plain_phrase(p))] for e, ps in lists.items()}
    longest = max((len(p.split()) for ps in lists.values() for p in ps), default=1)

    def on_clean(t: Column) -> Column:
        def hits(g: Column) -> Column:
            return F.array_compact(
                F.array(
                    *[
                        F.when(
                            g["phrase"].isin(*phrases),
                            F.struct(
                                g["sent_id"].alias("sent_id"),
                                g["begin"].alias("begin"),
                                g["end"].alias("end"),
                                F.substring(t, g["begin"] + 1, g["end"] - g["begin"]).alias("chunk"),
                                F.lit(entity).alias("entity"),
                                F.lit(f"words_{entity}").alias("detector"),
                            ),
                        )
                        for entity, phrases in lists.items()
                    ]
                )
            )

        every = [p for ps in lists.values() for p in ps]
        known = F.filter(sentence_ngrams(t, longest), lambda g: g["phrase"].isin(*every))
        return F.flatten(F.transform(known, hits))

    return let(clean_text(text), on_clean)


def membership_bits(phrases: DataFrame, n: int, phrase: str = "phrase") -> tuple[Column, int]:
    """A Bloom bitmap of a column of ``n`` rows as a scalar subquery (array of 64-bit words), and its number of bits.

    The size is a power of two of about ``BITS_PER_PHRASE`` bits for each phrase, at most 2^``MOST_BITS`` (8 MB); a larger
    dictionary only lets more n-grams through.  Words are made by partial aggregation; one row holds them all.
    """
    bits = 1 << min(max((n * BITS_PER_PHRASE - 1).bit_length(), LEAST_BITS), MOST_BITS)
    at = phrases.select(F.explode(F.array(*_bit_places(F.col(phrase), bits))).alias("bit"))
    words = at.groupBy(F.shiftright("bit", 6).alias("id")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit").bitwiseAND(63).cast("int"))).alias("word")
    )
    every = phrases.sparkSession.range(bits // 64).join(words, "id", "left").fillna(0, ["word"])
    packed = every.agg(F.sort_array(F.collect_list(F.struct("id", "word"))).alias("words"))
    return packed.select("words.word").scalar(), bits


def _bit_places(phrase: Column, bits: int) -> list[Column]:
    return [F.xxhash64(phrase, F.lit(i)).bitwiseAND(F.lit(bits - 1).cast("bigint")) for i in range(HASHES)]


def _may_hold(words: Column, phrase: Column, bits: int) -> Column:
    """False only for phrases the bitmap was not made of."""
    tests = [F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), p.bitwiseAND(63).cast("int")) == 1 for p in _bit_places(phrase, bits)]
    return reduce(lambda a, b: a & b, tests)


def candidate_grams(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """N-grams of ``docs`` (doc_id, text) that ``phrases`` (see ``phrase_table``) may hold, with their spans.

    The bitmap is tested on each n-gram where it is made, in generated code and before any shuffle; of other n-grams about
    one in a hundred passes.
    """
    sizes = phrases.agg(F.max("n").alias("n"), F.max("crosses").alias("crosses"), F.count(F.lit(1)).alias("rows")).first()
    longest = sizes["n"] or 1
    text = clean_text(F.col("text"))
    found = _grams_across_sentences(text, longest) if sizes["crosses"] else _grams_with_text(text, longest)
    words, bits = membership_bits(phrases, sizes["rows"])
    grams = docs.select("doc_id", F.inline_outer(found))
    return grams.filter(F.col("phrase").isNotNull() & _may_hold(words, F.col("phrase"), bits))


def dictionary_chunks(
    docs: DataFrame, dictionary: DataFrame, detector: str = "dictionary"
) -> DataFrame:
    """Findings of a dictionary table ``(entity, phrase)`` of any size.

    Phrases are cut by the tokeniser of the texts, and the longest of them (one aggregate over the dictionary) sets how
    long n-grams get, so none is missed.  Phrases with a sentence end inside match across that end.

    Only n-grams that pass a Bloom bitmap of the dictionary are joined to it on the phrase, so what is shuffled is hardly
    more than the findings; the join makes the result exact.  Spark broadcasts the dictionary only while its estimated or
    measured size is below the session's broadcast threshold and shuffles both sides otherwise; a frequent phrase then is
    a large key on the n-gram side only, which the adaptive skew join splits.
    """
    phrases = phrase_table(dictionary)
    grams = candidate_grams(docs, phrases)
    grams = grams.withColumn("crosses", F.rlike("chunk", F.lit(SENTENCE_END)))
    # a phrase without a sentence end inside stays within a sentence, and so does its n-gram
    return grams.join(phrases.select("entity", "phrase", "crosses"), ["phrase", "crosses"]).select(
        "doc_id", "sent_id", "begin", "end", "chunk", "entity", F.lit(detector).alias("detector")
    )


def _grams_with_text(text: Column, longest: int) -> Column:
    return F.flatten(
        F.transform(
            sentences(text),
            lambda s: F.transform(
                ngrams(tokens(s["sentence"]), longest),
                lambda g: F.struct(
                    s["sent_id"].alias("sent_id"),
                    (s["begin"] + g["begin"]).alias("begin"),
                    (s["begin"] + g["end"]).alias("end"),
                    F.substring(s["sentence"], g["begin"] + 1, g["end"] - g["begin"]).alias("chunk"),
                    g["phrase"].alias("phrase"),
                ),
            ),
        )
    )


def _grams_across_sentences(text: Column, longest: int) -> Column:
    """N-grams of a whole text, numbered by the sentence they begin in."""

    def of(number) -> Column:
        return F.transform(
            ngrams(tokens(text), longest),
            lambda g: F.struct(
                number(g["begin"]).alias("sent_id"),
                g["begin"].alias("begin"),
                g["end"].alias("end"),
                F.substring(text, g["begin"] + 1, g["end"] - g["begin"]).alias("chunk"),
                g["phrase"].alias("phrase"),
            ),
        )

    return sentence_counter(text)(of)
