"""Text, binary and configuration sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilwork.operators.deid import check_policy
from veilwork.operators.rules import Rule

TEXT_SCHEMA = T.StructType([T.StructField("text", T.StringType(), True)])
BINARY_SCHEMA = (
    "path string, modificationTime timestamp, length bigint, content binary"
)
RULE_SCHEMA = (
    "entity string, ruleScope string, regex string, matchScope string, prefix array<string>, "
    "suffix array<string>, contextLength int, caseSensitive boolean, prefixAndSuffix boolean, "
    "keep string, signal boolean, literal string, minLength int, maxLength int, detector string, "
    "test string, cut string, kind string"
)
POLICY_SCHEMA = "entity string, mode string"
# Rules and policies become expressions of the plan, so their number must stay small.
MAX_CONFIG_ROWS = 1000


def read_text(spark: SparkSession, path: str, whole_file: bool = False) -> DataFrame:
    """One row per line (or per file) with the fixed schema ``text``, plus its path.

    ``whole_file`` puts a file in one row; use it for files that are documents.
    """
    return (
        spark.read.schema(TEXT_SCHEMA)
        .text(path, wholetext=whole_file)
        .select("text", F.col("_metadata.file_path").alias("path"))
    )


def with_line_ids(lines: DataFrame) -> DataFrame:
    """Give each row a ``doc_id`` without a shuffle (unique, not consecutive).

    Call it right after the read: the number depends on the split and the place in it,
    which a lost task gets back, and a shuffle would not.
    """
    return lines.withColumn("doc_id", F.monotonically_increasing_id())


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def seed_frame(spark: SparkSession) -> DataFrame:
    """One row with an empty text, for fitting pipelines that need no data."""
    return spark.createDataFrame([[""]], TEXT_SCHEMA)


def _config_rows(frame: DataFrame, what: str) -> list:
    rows = frame.limit(MAX_CONFIG_ROWS + 1).collect()
    if len(rows) > MAX_CONFIG_ROWS:
        raise ValueError(f"more than {MAX_CONFIG_ROWS} {what} entries; these are compiled into the plan")
    return rows


def write_rules(spark: SparkSession, rules: tuple[Rule, ...], path: str) -> None:
    records = [
        (
            r.entity, r.rule_scope, r.regex, r.match_scope, list(r.prefix), list(r.suffix), r.context_length,
            r.case_sensitive, r.prefix_and_suffix, r.keep, r.signal, r.literal, r.min_length, r.max_length,
            r.detector, r.test, r.cut, r.kind,
        )
        for r in rules
    ]
    spark.createDataFrame(records, RULE_SCHEMA).coalesce(1).write.mode("overwrite").json(path)


def read_rules(spark: SparkSession, path: str, multi_line: bool = False) -> tuple[Rule, ...]:
    """Rule records from JSON, in label order; ``multi_line`` for pretty-printed files."""
    frame = spark.read.schema(RULE_SCHEMA).option("multiLine", multi_line).json(path)
    rules = []
    for r in _config_rows(frame, "rule"):
        if not r.entity or not r.regex:
            raise ValueError(f"rule without entity or regex in {path}")
        rules.append(
            Rule(
                r.entity,
                r.regex,
                rule_scope=r.ruleScope or "sentence",
                match_scope=r.matchScope or "token",
                prefix=tuple(r.prefix or ()),
                suffix=tuple(r.suffix or ()),
                context_length=r.contextLength or 0,
                case_sensitive=bool(r.caseSensitive),
                prefix_and_suffix=bool(r.prefixAndSuffix),
                keep=r.keep,
                signal=bool(r.signal),
                literal=r.literal,
                min_length=r.minLength or 0,
                max_length=r.maxLength or 0,
                detector=r.detector or "",
                test=r.test,
                cut=r.cut,
                kind=r.kind or "",
            )
        )
    return tuple(sorted(rules, key=lambda r: (r.entity, r.detector)))


def write_policy(spark: SparkSession, policy: dict[str, str], path: str) -> None:
    rows = sorted(check_policy(policy).items())
    spark.createDataFrame(rows, POLICY_SCHEMA).coalesce(1).write.mode("overwrite").json(path)


def read_policy(spark: SparkSession, path: str) -> dict[str, str]:
    rows = _config_rows(spark.read.schema(POLICY_SCHEMA).json(path), "policy")
    return check_policy({r.entity: r.mode for r in rows})


def find_asset(spark: SparkSession, directory: str, target: str) -> str:
    """Path of the only entry of ``directory`` whose name contains ``target``."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(directory)
    entries = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    hits = [e.getPath().toString() for e in entries if target in e.getPath().getName()]
    if len(hits) != 1:
        raise ValueError(f"{len(hits)} entries of {directory} contain {target!r} in their name, need 1")
    return hits[0]


def read_dictionary(spark: SparkSession, directory: str, target: str) -> DataFrame:
    """Dictionary table ``(entity, phrase)`` stored below ``directory``."""
    return spark.read.parquet(find_asset(spark, directory, target)).select("entity", "phrase")
