"""Replace findings by surrogates or masks and rebuild the text.

The whole step is an expression on the document's row.  A surrogate depends
only on salt, label and text, so it is the same in every partition and every run.

The salt is a secret.  Entry points read it from a one-row table as a scalar subquery, so plans, ``explain`` and event logs
name its column and never hold its value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.functions.arrays import block_substring, let, text_blocks
from veilwork.operators.catalog import SAME_LENGTH_LABELS, SURROGATES

SALT = "veilwork_salt"
MODES = ("obfuscate", "mask_label", "mask_same_length", "mask_fixed", "skip")
DEFAULT_MODE = "obfuscate"


def with_salt(docs: DataFrame, salt: str | DataFrame) -> DataFrame:
    """``docs`` with the secret in the column ``SALT``: a string, or a table of one row whose first column holds it."""
    if isinstance(salt, str):
        if not salt:
            raise ValueError("a salt is required")
        salt = docs.sparkSession.createDataFrame([(salt,)], "salt string")
    # an empty or null secret must not pass for one
    held = salt.select(F.col(salt.columns[0]).cast("string").alias("salt"))
    checked = F.when(F.length("salt") > 0, F.col("salt")).otherwise(F.raise_error(F.lit("a salt is required")))
    return docs.withColumn(SALT, held.select(checked.alias("salt")).scalar())


def check_policy(policy: Mapping[str, str] | None) -> dict[str, str]:
    policy = dict(policy or {})
    unknown = {m for m in policy.values() if m not in MODES}
    if unknown:
        raise ValueError(f"unknown mode(s) {sorted(unknown)}; known: {MODES}")
    return policy


def _digest(entity: Column, chunk: Column, salt: Column | str) -> Column:
    # a string becomes a literal of the plan: for checks only, see with_salt
    return F.sha2(F.concat(F.lit(salt) if isinstance(salt, str) else salt, F.lit("|"), entity, F.lit("|"), F.lower(chunk)), 256)


def _hex_value(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("bigint")


def _picked(values: Sequence[str], digest: Column, chunk: Column) -> Column:
    """Value at hash modulo n; the next one if it equals the original."""
    n = len(values)
    options = F.array(*[F.lit(v) for v in values])
    return let(
        F.pmod(_hex_value(F.substring(digest, 1, 8)), F.lit(n)).cast("int"),
        lambda i: F.when(options[i] == chunk, options[F.pmod(i + 1, F.lit(n))]).otherwise(options[i]),
    )


def same_length_surrogate(chunk: Column, digest: Column) -> Column:
    """Digit to another digit, letter to another letter of its case, punctuation kept.

    Characters outside ASCII become ``x``, so nothing of the original stays.
    """

    def replaced(i: Column) -> Column:
        char = F.substring(chunk, i, F.lit(1))
        shift = _hex_value(F.substring(digest, F.pmod(i - 1, F.lit(64)) + 1, F.lit(1))).cast("int")
        code = F.ascii(char)

        def rotate(first: str, size: int, by: Column) -> Column:
            return F.char(F.pmod(code - ord(first) + by, F.lit(size)) + ord(first))

        return (
            F.when(code.between(48, 57), rotate("0", 10, F.pmod(shift, F.lit(9)) + 1))
            .when(code.between(65, 90), rotate("A", 26, shift + 1))
            .when(code.between(97, 122), rotate("a", 26, shift + 1))
            .when(code > 127, F.lit("x"))
            .otherwise(char)
        )

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(chunk)), replaced), "")


def label_mask(entity: Column) -> Column:
    return F.concat(F.lit("<"), entity, F.lit(">"))


def obfuscated(entity: Column, chunk: Column, salt: Column | str, surrogates: Mapping[str, Sequence[str]]) -> Column:
    def choose(digest: Column) -> Column:
        out = F.when(entity.isin(*SAME_LENGTH_LABELS), same_length_surrogate(chunk, digest))
        for label, values in surrogates.items():
            if label in SAME_LENGTH_LABELS:
                continue
            if len(values) < 2:
                raise ValueError(f"label {label} needs at least two surrogate values")
            out = out.when(entity == label, _picked(values, digest, chunk))
        return out.otherwise(label_mask(entity))

    return let(_digest(entity, chunk, salt), choose)


def replacement(
    entity: Column,
    chunk: Column,
    salt: Column | str,
    policy: Mapping[str, str] | None = None,
    surrogates: Mapping[str, Sequence[str]] = SURROGATES,
) -> Column:
    """What stands in for one finding, by the mode its label has in the policy."""
    policy = check_policy(policy)
    by_mode = {
        "mask_label": label_mask(entity),
        "mask_same_length": F.repeat(F.lit("*"), F.length(chunk)),
        "mask_fixed": F.lit("****"),
        "skip": chunk,
    }
    out = obfuscated(entity, chunk, salt, surrogates)
    for mode, column in by_mode.items():
        labels = sorted(e for e, m in policy.items() if m == mode)
        if labels:
            out = F.when(entity.isin(*labels), column).otherwise(out)
    return out


def rebuilt_text(text: Column, resolved: Column, salt: Column | str, policy=None, surrogates=SURROGATES) -> Column:
    """The text with every kept finding replaced and every residual span starred out."""

    def edits() -> Column:
        return F.array_sort(
            F.concat(
                F.transform(
                    resolved["kept"],
                    lambda f: F.struct(
                        f["begin"].alias("begin"),
                        f["end"].alias("end"),
                        replacement(f["entity"], f["chunk"], salt, policy, surrogates).alias("value"),
                    ),
                ),
                F.transform(
                    resolved["residual"],
                    lambda r: F.struct(
                        r["begin"].alias("begin"),
                        r["end"].alias("end"),
                        F.repeat(F.lit("*"), r["end"] - r["begin"]).alias("value"),
                    ),
                ),
            )
        )

    def build(es: Column) -> Column:
        size = F.length(text)

        def assemble(blocks: Column) -> Column:
            def piece(begin: Column, end: Column) -> Column:
                return F.when(
                    F.size(blocks) == 1, F.substring(text, begin + 1, end - begin)
                ).otherwise(block_substring(blocks, begin, end))

            changed = F.transform(
                es,
                lambda e, i: F.concat(
                    piece(F.coalesce(F.get(es, i - 1)["end"], F.lit(0)), e["begin"]), e["value"]
                ),
            )
            return F.concat(F.array_join(changed, ""), piece(F.element_at(es, -1)["end"], size))

        return let(text_blocks(text), assemble)

    return let(edits(), lambda es: F.when(F.size(es) == 0, text).otherwise(build(es)))
