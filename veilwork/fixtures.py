"""Inputs derived from the given tables by pure expressions.

Each text below is valid in Spark SQL and in DuckDB, so both sides of a check
can derive the same rows on their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


ROWS_PER_TASK = 25_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _digits(expression: str, width: int) -> str:
    return f"lpad(cast(({expression}) % {10 ** width} as string), {width}, '0')"


_SSN = f"{_digits('k * 7919', 3)} || '-' || {_digits('k * 31', 2)} || '-' || {_digits('k * 104729', 4)}"
_SSN_PLAIN = f"{_digits('k * 7919', 3)} || {_digits('k * 31', 2)} || {_digits('k * 104729', 4)}"
_ACCOUNT = "cast(10000000 + c * 37 as string)"
_LICENSE = "'D' || cast(100000 + k % 900000 as string) || 'X'"
_VIN = f"'1ABCD' || {_digits('k * 13', 2)} || 'EFGH' || {_digits('k * 6151', 6)}"
_VIN2 = f"'1A2BC' || {_digits('k * 13', 5)} || 'D' || {_digits('k * 6151', 6)}"
_PHONE = f"'(' || cast(200 + k % 700 as string) || ') 555-' || {_digits('k * 17', 4)}"
_EMAIL = "'user' || cast(c as string) || '@mail' || cast(c % 9 as string) || '.example.com'"
_ID = "cast(10000 + k % 90000 as string)"
_ZIP = _digits("k * 379", 5)
_RECORD = _digits("k * 911", 5)

_VARIANTS = (
    # every rule hits once
    [
        "'Patient ' || c_name || ', ' || cast(1 + k % 98 as string) || '-years-old, seen on '"
        " || cast(cast(d as date) as string) || ' in ' || n_name || '. '",
        f"'SSN: ' || {_SSN} || '. '",
        f"'Account ' || {_ACCOUNT} || '. '",
        f"'license ' || {_LICENSE} || '. '",
        f"'VIN ' || {_VIN} || '. '",
        f"'Please call ' || {_PHONE} || '. '",
        f"'email ' || {_EMAIL} || '. '",
        f"'Filled at CVS/PHARMACY #' || {_ID} || '. '",
        f"'Lives in TX ' || {_ZIP} || '. '",
        f"'ICU Admission ' || {_RECORD} || '. '",
    ],
    # the same values without any context word
    [
        "c_name || ' aged ' || cast(1 + k % 98 as string) || '. '",
        f"{_SSN} || '. '",
        f"'Total ' || {_ACCOUNT} || '. '",
        f"{_LICENSE} || '. '",
        f"{_VIN} || '. '",
        f"{_PHONE} || '. '",
        f"{_EMAIL} || '. '",
        f"'#' || {_ID} || '. '",
        f"{_ZIP} || '. '",
        f"{_RECORD} || '. '",
    ],
    # near misses: too far, wrong case, other sentence, longer word
    [
        "c_name || ' is ' || cast(1 + k % 98 as string) || ' by a count made in full years old. '",
        f"'SSN unknown. ' || {_SSN} || '. '",
        f"'accounting ' || {_ACCOUNT} || '. '",
        f"'LiCeNsE ' || {_LICENSE} || '. '",
        f"'VIN code: ' || {_VIN} || '. '",
        f"'call me back at ' || {_PHONE} || '. '",
        f"'email given by the patient at the desk on the day of the last visit was ' || {_EMAIL} || '. '",
        f"'CVS/PHARMACY #' || {_digits('k', 3)} || '. '",
        f"'tx ' || {_ZIP} || '. '",
        f"'ICU ' || {_RECORD} || '. '",
    ],
    # overlaps and other forms
    [
        "cast(100 + k % 9 as string) || '-years-old. '",
        f"'SSN account ' || {_SSN_PLAIN} || '. '",
        f"'bank account routing ' || {_ACCOUNT} || '. '",
        f"{_LICENSE} || ' license. '",
        f"'VIN ' || {_VIN2} || '. '",
        f"'call +1 ' || {_PHONE} || '. '",
        f"{_EMAIL} || ' is the e-mail. '",
        f"'Wal-Mart Pharmacy #' || {_ID} || '7. '",
        f"'TX ' || {_ZIP} || '-' || {_digits('k * 53', 4)} || '. '",
        f"'ICU Admission in TX ' || {_RECORD} || '. '",
    ],
)

NOTE_TEXT_SQL = (
    "CASE "
    + " ".join(f"WHEN k % 4 = {i} THEN " + " || ".join(parts) for i, parts in enumerate(_VARIANTS))
    + " END"
)


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``notes(note_id, text)``: one clinical-style note per order.

    The joined rows are dealt anew before the texts are made: neither the splits of a scan (a file has no more useful ones
    than row groups) nor partitions merged by their bytes say how much work a text is.
    """
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey as k", "o_custkey as c", "o_orderdate as d")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = (
        orders.join(customer, orders.c == customer.c_custkey)
        .join(nation, customer.c_nationkey == nation.n_nationkey)
        .select("k", "c", "d", "c_name", "n_name")
    )
    return joined.repartition(tasks_for(orders)).selectExpr("k as note_id", f"{NOTE_TEXT_SQL} as text")


def tasks_for(scan: DataFrame) -> int:
    """Tasks of about ``ROWS_PER_TASK`` rows of a scan, at least one for each core.  Counting a scan reads no column."""
    return max(scan.sparkSession.sparkContext.defaultParallelism, -(-scan.count() // ROWS_PER_TASK))


def as_docs(frame: DataFrame, key: str) -> DataFrame:
    return frame.withColumnRenamed(key, "doc_id")


def note_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes as ``(doc_id, text)``."""
    return as_docs(notes(spark, sf_dir), "note_id")


def spread(scan: DataFrame) -> DataFrame:
    """Repartition a scan that has fewer splits than the session has cores.

    A file of a few megabytes is one split, so one task would do all the work; large
    inputs have many splits and pass unchanged, without a shuffle.  ``scan`` must hold
    no shuffle or join: counting its splits then runs no job.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as documents under one key."""
    return spread(
        table(spark, sf_dir, "conversations").selectExpr("conv_id * 1000 + turn as doc_id", "text")
    )


SPAN_LABELS = ("SSN", "ACCOUNT", "LICENSE", "VIN", "AGE", "URL", "DATE")
SPAN_CHUNK_SQL = {
    "doc_id": "l_orderkey",
    "sent_id": "cast(0 as int)",
    "begin": "cast(l_partkey % 60 as int)",
    "end": "cast(l_partkey % 60 + 1 + l_suppkey % 17 as int)",
    "chunk": "'c' || cast(l_partkey % 60 as string)",
    "entity": "CASE cast(l_linenumber % 7 as int) "
    + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(SPAN_LABELS))
    + " END",
    "detector": "CASE cast(l_linenumber % 7 as int) "
    + " ".join(
        f"WHEN {i} THEN '{e}_chunks'" if e not in ("URL", "DATE") else f"WHEN {i} THEN 'pattern_{e}'"
        for i, e in enumerate(SPAN_LABELS)
    )
    + " END",
}


def span_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with many partial overlaps, four per order on average."""
    return table(spark, sf_dir, "lineitem").selectExpr(*[f"{sql} as {c}" for c, sql in SPAN_CHUNK_SQL.items()])


# The same findings around one of three borders between blocks of 2^16 characters.
BORDER_CHUNK_SQL = SPAN_CHUNK_SQL | {
    "begin": "cast(65536 * (1 + l_orderkey % 3) - 30 + l_partkey % 60 as int)",
    "end": "cast(65536 * (1 + l_orderkey % 3) - 29 + l_partkey % 60 + l_suppkey % 17 as int)",
}


def border_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*[f"{sql} as {c}" for c, sql in BORDER_CHUNK_SQL.items()])


IMAGE_ROWS = 400


def pixel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(image_id, y, px)``: images of 400 rows by 64 pixels from the vectors."""
    return table(spark, sf_dir, "embeddings").selectExpr(
        f"cast(floor(vec_id / {IMAGE_ROWS}) as int) as image_id",
        f"cast(vec_id % {IMAGE_ROWS} as int) as y",
        "transform(embedding, v -> cast(floor((cast(v as double) + 1) * 127.5) as int)) as px",
    )


REGION_SQL = {
    "page_id": f"cast(s_suppkey % {2} as int)",
    "x0": "cast(s_suppkey * 7 % 50 as int)",
    "y0": "cast(s_suppkey * 37 % 390 as int)",
    "x1": "cast(s_suppkey * 7 % 50 + 6 as int)",
    "y1": "cast(s_suppkey * 37 % 390 + 5 as int)",
}


def image_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(*[f"{sql} as {c}" for c, sql in REGION_SQL.items()])


PAGE_COLUMNS = 80


def page_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(page_id, word_id, word)``: the words of every note."""
    return note_docs(spark, sf_dir).selectExpr(
        "doc_id as page_id", "posexplode(split(trim(text), ' ')) as (word_id, word)"
    )


def word_boxes(spark: SparkSession, sf_dir: str, cell_width: int = 8, cell_height: int = 16) -> DataFrame:
    """``(page_id, word_id, b, e, x, y, w, h)``: words laid out on lines of 80 columns."""
    from pyspark.sql import functions as F

    from veilwork.functions.arrays import running_starts

    words = F.split(F.trim("text"), " ")
    starts = running_starts(F.transform(words, lambda w: F.length(w) + 1))
    return (
        note_docs(spark, sf_dir)
        .select("doc_id", words.alias("ws"), starts.alias("starts"))
        .selectExpr("doc_id as page_id", "posexplode(arrays_zip(ws, starts)) as (word_id, z)")
        .selectExpr(
            "page_id",
            "word_id",
            "z.starts as b",
            "z.starts + length(z.ws) as e",
            f"z.starts % {PAGE_COLUMNS} * {cell_width} as x",
            f"cast(floor(z.starts / {PAGE_COLUMNS}) as int) * {cell_height} as y",
            f"length(z.ws) * {cell_width} as w",
            f"{cell_height} as h",
        )
    )


def page_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes drawn as a character raster: one pixel row per line, one pixel per column."""
    return note_docs(spark, sf_dir).selectExpr(
        "cast(doc_id as int) as image_id",
        f"posexplode(regexp_extract_all(trim(text), '(?s).{{1,{PAGE_COLUMNS}}}', 0)) as (y, line)",
    ).selectExpr(
        "image_id",
        "y",
        f"transform(split(rpad(line, {PAGE_COLUMNS}, ' '), ''), c -> ascii(c)) as px",
    )


# One line per customer with the forms only patterns and word lists find.
ADMISSION_SQL = (
    "'Seen by Dr. ' || CASE cast(c_custkey % 3 as int) WHEN 0 THEN 'Miller' WHEN 1 THEN 'Van-Dyke' ELSE 'o''Hara' END"
    " || ' at ' || cast(1 + c_custkey % 900 as string) || ' Oak Hill ' ||"
    " CASE cast(c_custkey % 4 as int) WHEN 0 THEN 'Street' WHEN 1 THEN 'Ave' WHEN 2 THEN 'Lane' ELSE 'Court' END"
    " || ', ' || CASE cast(c_custkey % 5 as int) WHEN 0 THEN 'North Carolina' WHEN 1 THEN 'Ohio' WHEN 2 THEN"
    " 'west virginia' WHEN 3 THEN 'Bavaria' ELSE 'Virgin Islands' END"
    " || '. Fax: 555-0' || lpad(cast(c_custkey % 1000 as string), 3, '0') || '-' ||"
    " lpad(cast(c_custkey % 10000 as string), 4, '0')"
    " || '. A ' || CASE cast(c_custkey % 6 as int) WHEN 0 THEN 'female' WHEN 1 THEN 'male' WHEN 2 THEN 'Woman,'"
    " WHEN 3 THEN 'African American man' WHEN 4 THEN 'catholic boy' ELSE 'person' END"
    " || ' born March ' || cast(1 + c_custkey % 28 as string) || ', 19' ||"
    " lpad(cast(c_custkey % 100 as string), 2, '0') || ' or ' || cast(1 + c_custkey % 12 as string) || '/3/1999.'"
    " || chr(10) || 'Device serial no AB-' || cast(10000 + c_custkey as string) || ' see https://x.example.org/p?id='"
    " || cast(c_custkey as string) || '. Id MR' || cast(4000 + c_custkey as string) || ' mail j.doe+' ||"
    " cast(c_custkey as string) || '@mail.example.com, phone +1 (' || cast(200 + c_custkey % 700 as string) ||"
    " ') 555-0' || lpad(cast(c_custkey % 1000 as string), 3, '0')"
)
