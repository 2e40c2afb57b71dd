"""De-identify a map of metadata values."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.operators.catalog import WORD_LISTS
from veilwork.operators.deid import label_mask
from veilwork.operators.rules import Rule
from veilwork.plans.text import DEFAULT_RULES, deidentify_text

# Values are scanned as one text.  The line breaks end sentences, and the run of marks between them is longer than what any
# rule reads around a match, so no rule sees two values at once.
_MARK = "\u0003"


def _between(rules: Sequence[Rule]) -> str:
    reach = max((r.context_length + max(map(len, (*r.prefix, *r.suffix)), default=0) for r in rules), default=0)
    return "\n" + _MARK * (reach + 2) + "\n"


def deidentify_metadata(
    frame: DataFrame,
    salt: str | DataFrame,
    sensitive_keys: Mapping[str, str],
    column: str = "metadata",
    labels: Iterable[str] | None = None,
    policy: Mapping[str, str] | None = None,
    rules: Sequence[Rule] = DEFAULT_RULES,
    word_lists: Mapping[str, Sequence[str]] = WORD_LISTS,
) -> DataFrame:
    """Mask the values of sensitive keys whole and scan every other value as a text.

    ``sensitive_keys`` maps a key (any case) to the label its mask shows.  Null values
    stay null.  The map never leaves its row.
    """
    between = _between(rules)
    entries = F.map_entries(column)
    joined = F.array_join(
        F.transform(entries, lambda e: F.translate(F.coalesce(e["value"], F.lit("")), _MARK, " ")), between
    )
    # The row travels as one struct, so no column of the caller can clash with what is made here.
    packed = frame.select(F.struct(*frame.columns).alias("row"), joined.alias("values"))
    done = deidentify_text(
        packed, salt, labels, policy, rules, key="row", text="values", word_lists=word_lists
    ).withColumn("clean", F.split("deidentified", between))
    entries, held = F.map_entries(F.col("row")[column]), F.col("row")[column]

    def scrubbed(entry, i):
        value = F.col("clean")[i]
        for name, label in sensitive_keys.items():
            value = F.when(F.lower(entry["key"]) == name.lower(), label_mask(F.lit(label))).otherwise(value)
        return F.struct(
            entry["key"].alias("key"), F.when(entry["value"].isNotNull(), value).alias("value")
        )

    clean = F.when(F.size(held) == 0, held).otherwise(F.map_from_entries(F.transform(entries, scrubbed)))
    return done.select(*[clean.alias(c) if c == column else F.col("row")[c].alias(c) for c in frame.columns])
