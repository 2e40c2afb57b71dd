"""The same queries as DuckDB SQL, written from the definitions.

The SQL shares the fixture expressions, the fixed word lists and the plain regexes
with the library, and none of its logic: sentences and tokens come from splits and
window sums, contexts from prefixes of the sentence, overlaps from a recursive query.
"""

from __future__ import annotations

import re

from veilwork import fixtures as fx
from veilwork.operators import catalog as cat
from veilwork.operators.rules import Rule
from veilwork.plans.queries import (
    BOTH_SIDES_RULE,
    CASE_RULE,
    CHECK_POLICY,
    CHECK_SALT,
    PAGE_WIDTH,
    PLAIN_TOKEN_RULE,
)

WS = r"[ \t\n\x0B\f\r]"
PUNCT = ".,;:!?()"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows, names: str) -> str:
    body = ", ".join("(" + ", ".join(lit(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    return f"(VALUES {body}) t({names})"


def lower(column: str) -> str:
    return f"translate({column}, '{UPPER}', '{LOWER}')"


NOTES = f"""notes AS MATERIALIZED (
  SELECT k AS doc_id, {fx.NOTE_TEXT_SQL} AS text
  FROM (SELECT o_orderkey AS k, o_custkey AS c, o_orderdate AS d FROM orders)
  JOIN customer ON c = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
DOCS = "docs AS (SELECT doc_id, text FROM documents)"
TURNS = "turns AS (SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations)"
PAGES = "webpages AS (SELECT page_id AS doc_id, url || ' ' || html AS text FROM pages)"
ITEMS = "items AS (SELECT item_id AS doc_id, text FROM benchmark)"
ADMISSIONS = f"admissions AS (SELECT c_custkey AS doc_id, {fx.ADMISSION_SQL} AS text FROM customer)"


def clean(text: str = "text") -> str:
    return f"translate({text}, chr(1) || chr(2), '  ')"


def sents(source: str) -> str:
    """CTE sents(doc_id, sent_id, s, sb, se)."""
    marked = f"regexp_replace({clean()}, '([.!?]{WS}+|\\n{WS}*)', '\\1' || chr(1), 'g')"
    return f"""sents AS MATERIALIZED (
  SELECT doc_id, cast(sent_id AS INT) AS sent_id, s, cast(sb AS INT) AS sb, cast(sb + length(s) AS INT) AS se FROM (
    SELECT *, coalesce(sum(length(s)) OVER (PARTITION BY doc_id ORDER BY sent_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sb
    FROM (SELECT doc_id, unnest(p) AS s, unnest(range(len(p))) AS sent_id
          FROM (SELECT doc_id, string_split({marked}, chr(1)) AS p FROM {source})))
  WHERE length(s) > 0)"""


TOKS = f"""toks AS MATERIALIZED (
  SELECT doc_id, sent_id, s, sb, se, tok,
         cast(row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY b) - 1 AS INT) AS token_id,
         cast(b AS INT) AS b, cast(b + length(tok) AS INT) AS e
  FROM (SELECT *, trim(raw, '{PUNCT}') AS tok, sb + rb + length(raw) - length(ltrim(raw, '{PUNCT}')) AS b
        FROM (SELECT *, coalesce(sum(length(raw) + 1) OVER (PARTITION BY doc_id, sent_id ORDER BY i
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rb
              FROM (SELECT doc_id, sent_id, s, sb, se, unnest(r) AS raw, unnest(range(len(r))) AS i
                    FROM (SELECT *, string_split_regex(s, '{WS}') AS r FROM sents))))
  WHERE length(tok) > 0)"""


def matches(name: str, source: str, text: str, pattern: str, lead: str = "") -> str:
    """CTE name(*, m, mb, me): matches of a regex in a text column, offsets inside it.

    ``lead`` is what stands before the wanted part.
    """
    marked = f"regexp_replace({text}, {lit(f'({lead})({pattern})')}, '\\1' || chr(1) || '\\2' || chr(1), 'g')"
    return f"""{name} AS MATERIALIZED (
  SELECT * EXCLUDE (i), cast(start AS INT) AS mb, cast(start + length(m) AS INT) AS me FROM (
    SELECT *, coalesce(sum(length(m)) OVER (PARTITION BY rid ORDER BY i
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
    FROM (SELECT *, unnest(p) AS m, unnest(range(len(p))) AS i
          FROM (SELECT *, row_number() OVER () AS rid, string_split({marked}, chr(1)) AS p FROM {source})))
  WHERE i % 2 = 1)"""


def _edges(words):
    out: dict[tuple[bool, bool], list[str]] = {}
    for w in words:
        key = (re.match("[A-Za-z0-9]", w[0]) is not None, re.match("[A-Za-z0-9]", w[-1]) is not None)
        out.setdefault(key, []).append(re.sub(r"([^A-Za-z0-9 /-])", r"\\\1", w))
    return out


def before_ok(column: str, rule: Rule) -> str:
    if not rule.prefix:
        return "false"
    words = rule.prefix if rule.case_sensitive else [w.lower() for w in rule.prefix]
    arms = [
        ("(^|[^A-Za-z0-9])" if left else "") + "(" + "|".join(ws) + ")"
        + (f"([^A-Za-z0-9].{{0,{rule.context_length - 1}}})?" if right else f".{{0,{rule.context_length}}}")
        for (left, right), ws in _edges(words).items()
    ]
    return f"regexp_matches({column}, {lit('(?s)(' + '|'.join(arms) + ')$')})"


def after_ok(column: str, rule: Rule) -> str:
    if not rule.suffix:
        return "false"
    words = rule.suffix if rule.case_sensitive else [w.lower() for w in rule.suffix]
    arms = [
        (f"(.{{0,{rule.context_length - 1}}}[^A-Za-z0-9])?" if left else f".{{0,{rule.context_length}}}")
        + "(" + "|".join(ws) + ")" + ("([^A-Za-z0-9]|$)" if right else "")
        for (left, right), ws in _edges(words).items()
    ]
    return f"regexp_matches({column}, {lit('(?s)^(' + '|'.join(arms) + ')')})"


def context(rule: Rule, before: str, after: str) -> str:
    if not (rule.prefix or rule.suffix):
        return "true"
    if not rule.case_sensitive:
        before, after = lower(before), lower(after)
    joint = "AND" if rule.prefix_and_suffix else "OR"
    return f"({before_ok(before, rule)} {joint} {after_ok(after, rule)})"


def chunk_row(rule: Rule, sent_id: str, b: str, e: str, chunk: str) -> str:
    return (
        f"doc_id, cast({sent_id} AS INT) AS sent_id, cast({b} AS INT) AS \"begin\", cast({e} AS INT) AS \"end\", "
        f"{chunk} AS chunk, {lit(rule.entity)} AS entity, {lit(rule.detector)} AS detector"
    )


# Lookarounds are not in RE2: a plain shape, then a test of the neighbours.
SHAPES = {
    "AGE_chunks": (cat.AGE_REGEX, "", f"regexp_matches(m, {lit('^[0-9]{1,3}([^0-9]|$)')})"),
    "IDNUM_chunks": ("[0-9]{4,5}", "#", "true"),
    "PHONE_chunks": (
        r"\([1-9][0-9]{2}\)\.?-?[ \t\n\x0B\f\r]?[0-9]{3}\.?-?[ \t\n\x0B\f\r]?[0-9]{4}",
        "",
        "NOT regexp_matches(substr(t, greatest(mb - 1, 1), least(mb, 2)), '^[0-9][ \\t\\n\\x0B\\f\\r]$')"
        " AND NOT regexp_matches(substr(t, me + 1, 1), '[0-9]')",
    ),
    "pattern_NAME": (cat.NAME_SHAPE, cat.NAME_LEAD, "true"),
    "pattern_EMAIL": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "", "true"),
}


def rule_parts(rules, source: str) -> tuple[list[str], list[str]]:
    """CTEs and SELECTs that give the findings of ``rules``."""
    ctes, selects = [sents(source)], []
    if any(r.match_scope == "token" for r in rules):
        ctes.append(TOKS)
    for i, r in enumerate(rules):
        if r.match_scope == "token":
            tok = "tok" if r.case_sensitive else lower("tok")
            ctx = context(r, "substr(s, 1, b - sb)", "substr(s, e - sb + 1)")
            selects.append(
                f"SELECT {chunk_row(r, 'sent_id', 'b', 'e', 'tok')} FROM toks "
                f"WHERE regexp_matches({tok}, {lit(r.regex)}) AND {ctx}"
            )
            continue
        shape, lead, keep = SHAPES.get(r.detector, (r.cut or r.regex, "", "true"))
        if r.rule_scope == "document":
            ctes.append(matches(f"m{i}", f"(SELECT doc_id, {clean()} AS t FROM {source})", "t", shape, lead))
            ctx = context(r, "substr(t, 1, mb)", "substr(t, me + 1)")
            row = chunk_row(r, "-1", "mb", "me", "m")
        else:
            ctes.append(matches(f"m{i}", "(SELECT *, s AS t FROM sents)", "t", shape, lead))
            ctx = context(r, "substr(t, 1, mb)", "substr(t, me + 1)")
            row = chunk_row(r, "sent_id", "sb + mb", "sb + me", "m")
        selects.append(f"SELECT {row} FROM m{i} WHERE {keep} AND {ctx}")
    return ctes, selects


def findings(rules, source: str, base: str, then: str, recursive: bool = False, more: tuple[str, ...] = ()) -> str:
    """WITH base, ..., raw AS (all findings), more.. <then>."""
    ctes, selects = rule_parts(rules, source)
    raw = "raw AS MATERIALIZED (" + "\nUNION ALL ".join(selects) + ")"
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join([base, *ctes, raw, *more]) + f"\n{then}"


RANKS = values([(d, e, i) for i, (d, e) in enumerate(cat.PRECEDENCE, 1)], "rd, re, rank")


def greedy(source: str) -> tuple[str, ...]:
    """CTEs ranked, walk, kept from findings in ``source`` (doc_id, begin, end, ...)."""
    return (
        f"""ranked AS MATERIALIZED (
  SELECT c.*, coalesce(rank, {len(cat.PRECEDENCE) + 1}) AS rank,
         row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(rank, {len(cat.PRECEDENCE) + 1}),
                            "begin" - "end", "begin", entity, detector, "end", chunk, sent_id) AS rn
  FROM {source} c LEFT JOIN {RANKS} ON detector = rd AND entity = re)""",
        """walk AS (
  SELECT doc_id, rn, true AS ok, [struct_pack(b := "begin", e := "end")] AS taken FROM ranked WHERE rn = 1
  UNION ALL
  SELECT r.doc_id, r.rn,
         len(list_filter(w.taken, lambda t: t.b < r."end" AND r."begin" < t.e)) = 0,
         CASE WHEN len(list_filter(w.taken, lambda t: t.b < r."end" AND r."begin" < t.e)) = 0
              THEN list_append(w.taken, struct_pack(b := r."begin", e := r."end")) ELSE w.taken END
  FROM walk w JOIN ranked r ON r.doc_id = w.doc_id AND r.rn = w.rn + 1)""",
        "kept AS MATERIALIZED (SELECT r.* FROM ranked r JOIN walk w USING (doc_id, rn) WHERE ok)",
    )


CHUNK_COLS = 'doc_id, sent_id, "begin", "end", chunk, entity, detector'
SPANS = "spans AS (SELECT " + ", ".join(f'{sql} AS "{c}"' for c, sql in fx.SPAN_CHUNK_SQL.items()) + " FROM lineitem)"


def notes_kept(then: str, more: tuple[str, ...] = ()) -> str:
    return findings(cat.CONTEXT_RULES, "notes", NOTES, then, True, (*greedy("raw"), *more))


def surrogate_index(n: int, digest: str) -> str:
    return f"cast(('0x' || substr({digest}, 1, 8))::BIGINT % {n} AS INT)"


def digest(entity: str = "entity", chunk: str = "chunk") -> str:
    return f"sha256('{CHECK_SALT}|' || {entity} || '|' || lower({chunk}))"


def replacement(policy: dict[str, str] | None) -> str:
    """Expression over (entity, chunk, hash) for what stands in for a finding."""
    arms = []
    masks = {
        "mask_label": "'<' || entity || '>'",
        "mask_same_length": "repeat('*', length(chunk))",
        "mask_fixed": "'****'",
        "skip": "chunk",
    }
    for label, mode in (policy or {}).items():
        if mode in masks:
            arms.append(f"WHEN entity = {lit(label)} THEN {masks[mode]}")
    c = "substr(chunk, i, 1)"
    h = "cast(('0x' || substr(hash, (i - 1) % 64 + 1, 1)) AS INT)"
    per_char = (
        f"CASE WHEN regexp_matches({c}, '^[0-9]$') THEN cast((ascii({c}) - 48 + 1 + {h} % 9) % 10 AS VARCHAR) "
        f"WHEN regexp_matches({c}, '^[A-Z]$') THEN chr(cast((ascii({c}) - 65 + 1 + {h}) % 26 + 65 AS INT)) "
        f"WHEN regexp_matches({c}, '^[a-z]$') THEN chr(cast((ascii({c}) - 97 + 1 + {h}) % 26 + 97 AS INT)) "
        f"WHEN ascii({c}) > 127 THEN 'x' ELSE {c} END"
    )
    arms.append(
        f"WHEN entity IN ('PHONE', 'ID', 'IDNUM') THEN "
        f"array_to_string(list_transform(range(1, length(chunk) + 1), lambda i: {per_char}), '')"
    )
    for label, options in cat.SURROGATES.items():
        n = len(options)
        listed = "[" + ", ".join(lit(o) for o in options) + "]"
        at = f"{listed}[{surrogate_index(n, 'hash')} + 1]"
        following = f"{listed}[({surrogate_index(n, 'hash')} + 1) % {n} + 1]"
        arms.append(f"WHEN entity = {lit(label)} THEN CASE WHEN {at} = chunk THEN {following} ELSE {at} END")
    return "CASE " + " ".join(arms) + " ELSE '<' || entity || '>' END"


def rebuild(source: str, kept: str, policy: dict[str, str] | None) -> tuple[str, ...]:
    """CTEs that end in rebuilt(doc_id, text, deidentified)."""
    return (
        f"edits AS (SELECT doc_id, \"begin\", \"end\", {replacement(policy)} AS value FROM "
        f"(SELECT *, {digest()} AS hash FROM {kept}))",
        """pieces AS (SELECT e.doc_id, e."begin", value, "end",
    substr(text, coalesce(lag("end") OVER w, 0) + 1, "begin" - coalesce(lag("end") OVER w, 0)) AS gap
  FROM edits e JOIN %s d USING (doc_id) WINDOW w AS (PARTITION BY e.doc_id ORDER BY "begin"))""" % source,
        f"""rebuilt AS (SELECT d.doc_id, text, CASE WHEN body IS NULL THEN text
    ELSE body || substr(text, last + 1) END AS deidentified
  FROM {source} d LEFT JOIN (SELECT doc_id, string_agg(gap || value, '' ORDER BY "begin") AS body, max("end") AS last
                             FROM pieces GROUP BY doc_id) USING (doc_id))""",
    )


def with_all(*ctes: str, then: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + f"\n{then}"


def _mode(label: str = "entity") -> str:
    arms = " ".join(f"WHEN {lit(e)} THEN {lit(m)}" for e, m in CHECK_POLICY.items())
    return f"CASE {label} {arms} ELSE 'obfuscate' END"


DICTIONARY = """dictionary AS (
  SELECT 'PATIENT' AS entity, c_name AS phrase FROM customer UNION ALL SELECT 'HOSPITAL', s_name FROM supplier
  UNION ALL SELECT 'COUNTRY', n_name FROM nation UNION ALL SELECT 'LOCATION', r_name FROM region)"""


def grams(longest: int) -> str:
    """CTE grams(doc_id, sent_id, token_id, n, b, e, s, sb, phrase)."""
    arms = []
    for n in range(1, longest + 1):
        joined = " || ' ' || ".join(["tok"] + [f"lead(tok, {i}) OVER w" for i in range(1, n)])
        end = "e" if n == 1 else f"lead(e, {n - 1}) OVER w"
        arms.append(
            f"SELECT doc_id, sent_id, token_id, {n} AS n, b, {end} AS e, s, sb, {lower('(' + joined + ')')} AS phrase "
            "FROM toks WINDOW w AS (PARTITION BY doc_id, sent_id ORDER BY token_id)"
        )
    return "grams AS MATERIALIZED (SELECT * FROM (" + " UNION ALL ".join(arms) + ") WHERE e IS NOT NULL)"


PATTERN_SOURCES = {
    "URL": ("webpages", PAGES), "PHONE": ("docs", DOCS), "EMAIL": ("docs", DOCS),
    **{e: ("admissions", ADMISSIONS) for e in ("DOCTOR", "STREET", "FAX", "DEVICE")},
}

WORDS = f"""words AS MATERIALIZED (
  SELECT doc_id AS page_id, cast(i AS INT) AS word_id, word, cast(b AS INT) AS b, cast(b + length(word) AS INT) AS e
  FROM (SELECT *, coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY i
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
        FROM (SELECT doc_id, unnest(p) AS word, unnest(range(len(p))) AS i
              FROM (SELECT doc_id, string_split(trim(text), ' ') AS p FROM notes))))"""


def boxes(cell_width: int, cell_height: int) -> str:
    return f"""boxes AS (SELECT page_id, word_id, word, b, e, b % {fx.PAGE_COLUMNS} * {cell_width} AS x,
    b // {fx.PAGE_COLUMNS} * {cell_height} AS y, length(word) * {cell_width} AS w, {cell_height} AS h FROM words)"""


def regions_sql(width: str, padding: int = cat.REGION_PADDING) -> str:
    return f"""regions AS (
  SELECT page_id, greatest(0, min(x) - {padding}) AS x0, greatest(0, y - {padding}) AS y0,
         least(max(x + w) + {padding}, {width}) AS x1, least(max(y + h) + {padding}, any_value(height)) AS y1, entity
  FROM kept k JOIN boxes ON k.doc_id = page_id AND k."begin" < e AND b < k."end"
       JOIN (SELECT page_id AS pid, max(y + h) AS height FROM boxes GROUP BY page_id) ON pid = page_id
  GROUP BY page_id, "begin", "end", entity, y)"""


PIXELS = f"""pixels AS (
  SELECT cast(vec_id // {fx.IMAGE_ROWS} AS INT) AS image_id, cast(vec_id % {fx.IMAGE_ROWS} AS INT) AS y, cast(x - 1 AS INT) AS x,
         cast(floor((cast(embedding[x] AS DOUBLE) + 1) * 127.5) AS INT) AS v
  FROM embeddings, range(1, 65) r(x))"""

PAINTED = f"""painted AS (
  SELECT image_id, y, x, CASE WHEN EXISTS (
      SELECT 1 FROM (SELECT {", ".join(f"{sql} AS {c}" for c, sql in fx.REGION_SQL.items())} FROM supplier) r
      WHERE r.page_id = image_id AND y >= y0 AND y < y1 AND x >= x0 AND x < x1) THEN 0 ELSE v END AS v FROM pixels)"""


def pixel_lines(source: str) -> str:
    return f"SELECT image_id, y, string_agg(cast(v AS VARCHAR), ',' ORDER BY x) AS px FROM {source} GROUP BY image_id, y"


def build() -> dict[str, str]:
    o: dict[str, str] = {}
    ctx, pat = cat.CONTEXT_RULES, cat.PATTERN_RULES
    by = cat.CONTEXT_RULES_BY_ENTITY
    raw = f"SELECT {CHUNK_COLS} FROM raw"

    o["text_source"] = "SELECT unnest(string_split(text, chr(10))) AS text FROM documents"
    o["text_source_whole_files"] = "SELECT cast(sum(length(text) + 1) AS BIGINT) AS characters FROM documents"
    o["output_per_file"] = (
        "SELECT source AS path, cast(1 AS BIGINT) AS folders, count(*) AS rows FROM documents GROUP BY source"
    )
    counts = "SELECT entity AS ner_label, count(*) AS count FROM {} GROUP BY entity"
    o["rule_set_load"] = findings(ctx, "notes", NOTES, counts.format("raw"))
    o["policy_load"] = findings(
        ctx, "notes", NOTES, f"SELECT entity, {_mode()} AS mode, count(*) AS n FROM raw GROUP BY entity"
    )
    o["dictionary_load"] = with_all(DICTIONARY, then="SELECT entity, phrase FROM dictionary WHERE entity <> 'PATIENT'")

    o["document_assembly"] = (
        "SELECT doc_id, cast(length(text) AS INT) AS characters, md5(text) AS digest FROM documents WHERE text IS NOT NULL"
    )
    o["sentence_split"] = with_all(
        DOCS, sents("docs"), then='SELECT doc_id, sent_id, sb AS "begin", se AS "end", s AS sentence FROM sents'
    )
    o["tokenise"] = with_all(
        DOCS, sents("docs"), TOKS,
        then='SELECT doc_id, sent_id, token_id, b AS "begin", e AS "end", tok AS token FROM toks',
    )
    o["token_neighbours"] = with_all(
        TURNS, sents("turns"), TOKS,
        then="SELECT doc_id, sent_id, token_id, lag(tok) OVER w AS previous, lead(tok) OVER w AS following FROM toks "
        "WINDOW w AS (PARTITION BY doc_id, sent_id ORDER BY token_id)",
    )
    o["token_vectors"] = with_all(
        ITEMS, TURNS, sents("items").replace("sents AS", "item_sents AS"),
        TOKS.replace("toks AS", "item_toks AS").replace("FROM sents", "FROM item_sents"),
        f"vectors AS (SELECT token, embedding FROM (SELECT DISTINCT tok AS token, {surrogate_index('(SELECT count(*) FROM embeddings)', 'sha256(tok)')} "
        "AS v FROM item_toks) JOIN embeddings ON vec_id = v)",
        sents("turns"), TOKS,
        then="SELECT doc_id, sent_id, token_id, tok AS token, cast(coalesce(embedding[1], 0) AS DOUBLE) AS first, "
        "cast(coalesce(embedding[64], 0) AS DOUBLE) AS last FROM toks LEFT JOIN vectors ON token = tok",
    )
    o["ngram_candidates"] = with_all(
        TURNS, sents("turns"), TOKS, grams(3),
        then='SELECT doc_id, sent_id, token_id, n, b AS "begin", e AS "end", phrase FROM grams',
    )

    for r in ctx:
        o[f"rule_{r.entity.lower()}"] = findings((r,), "notes", NOTES, raw)
    o["rules_one_pass"] = findings(ctx, "notes", NOTES, raw)
    announced = r"docs AS (SELECT doc_id, regexp_replace(text, '([A-Za-z0-9._%+-]+@)', 'mail \1', 'g') AS text FROM documents)"
    o["rules_documents"] = findings(ctx, "docs", announced, raw)
    o["rule_prefix_and_suffix"] = findings((BOTH_SIDES_RULE,), "notes", NOTES, raw)
    o["rule_case_insensitive"] = findings((CASE_RULE,), "notes", NOTES, raw)
    o["rule_all_tokens"] = findings((PLAIN_TOKEN_RULE,), "notes", NOTES, raw)
    for r in pat:
        source, base = PATTERN_SOURCES.get(r.entity, ("notes", NOTES))
        o[f"pattern_{r.entity.lower()}"] = findings((r,), source, base, raw)
    o["patterns_admissions"] = findings(pat, "admissions", ADMISSIONS, raw)

    lists = values([(e, p.lower()) for e, ps in cat.WORD_LISTS.items() for p in ps], "entity, phrase")
    hit = 'doc_id, sent_id, b AS "begin", e AS "end", substr(s, b - sb + 1, e - b) AS chunk, entity'
    o["word_lists"] = with_all(
        ADMISSIONS, sents("admissions"), TOKS, grams(3),
        then=f"SELECT {hit}, 'words_' || entity AS detector FROM grams JOIN {lists} USING (phrase)",
    )
    o["dictionary_join"] = with_all(
        NOTES, sents("notes"), TOKS, grams(2), DICTIONARY,
        then=f"SELECT {hit}, 'dictionary' AS detector FROM grams JOIN "
        f"(SELECT DISTINCT entity, {lower('phrase')} AS phrase FROM dictionary) USING (phrase)",
    )

    detectors = values(cat.DETECTORS, "entity, detector, kind")
    o["detector_set"] = findings(
        ctx + pat, "notes", NOTES,
        f"SELECT detector, any_value(kind) AS kind, coalesce(any_value(n), 0) AS n FROM {detectors} "
        "LEFT JOIN (SELECT detector AS d, count(*) AS n FROM raw GROUP BY 1) ON d = detector GROUP BY detector",
    )
    o["label_detectors"] = findings(
        ctx + pat, "notes", NOTES,
        f"SELECT entity, kind, count(*) AS n FROM raw JOIN {detectors} USING (entity, detector) GROUP BY entity, kind",
    )
    o["label_rename"] = findings(
        (cat.PATTERN_RULES_BY_ENTITY["ID"], by["IDNUM"]), "notes", NOTES,
        'SELECT doc_id, sent_id, "begin", "end", chunk, CASE WHEN entity = \'ID\' THEN \'IDNUM\' ELSE entity END AS entity, '
        "detector FROM raw",
    )
    o["label_whitelist"] = findings(ctx, "notes", NOTES, raw + " WHERE entity IN ('SSN', 'AGE', 'IDNUM')")
    o["default_labels"] = findings(
        (by["AGE"], by["SSN"], cat.PATTERN_RULES_BY_ENTITY["NAME"]), "notes", NOTES, f"SELECT {CHUNK_COLS} FROM kept", True, greedy("raw")
    )
    o["chunk_conversion"] = findings(
        ctx, "notes", NOTES,
        "SELECT detector, count(*) AS n, min(chunk) AS first, max(chunk) AS last FROM raw GROUP BY detector",
    )
    o["chunk_union"] = findings(
        (by["SSN"], by["VIN"]), "notes", NOTES,
        'SELECT detector, entity, count(*) AS n, cast(sum("begin") AS BIGINT) AS begins FROM '
        '(SELECT detector, entity, "begin" FROM raw UNION ALL SELECT detector, entity, "begin" FROM spans) '
        "GROUP BY detector, entity",
        more=(SPANS,),
    )
    o["chunk_precedence"] = with_all(
        SPANS,
        then=f'SELECT doc_id, "begin", "end", entity, detector, coalesce(rank, {len(cat.PRECEDENCE) + 1}) AS rank '
        f"FROM spans LEFT JOIN {RANKS} ON detector = rd AND entity = re",
    )
    o["overlap_resolution"] = with_all(
        SPANS, *greedy("spans"), then=f"SELECT {CHUNK_COLS} FROM kept", recursive=True
    )
    borders = "spans AS (SELECT " + ", ".join(f'{sql} AS "{c}"' for c, sql in fx.BORDER_CHUNK_SQL.items()) + " FROM lineitem)"
    o["overlap_resolution_blocks"] = with_all(
        borders, *greedy("spans"), then=f"SELECT {CHUNK_COLS} FROM kept", recursive=True
    )
    o["overlap_residual"] = with_all(
        SPANS, *greedy("spans"),
        then='SELECT DISTINCT doc_id, cast(position AS INT) AS position FROM (SELECT doc_id, unnest(range("begin", "end")) AS position FROM spans) '
        'WHERE (doc_id, position) NOT IN (SELECT doc_id, unnest(range("begin", "end")) FROM kept)',
        recursive=True,
    )
    o["overlap_resolution_notes"] = notes_kept(f"SELECT {CHUNK_COLS} FROM kept")
    o["duplicate_chunks"] = with_all(
        SPANS,
        then=f"""SELECT doc_id, 0 AS sent_id, b AS "begin", 70 AS "end", 'c' || b AS chunk, entity,
  arg_min(detector, coalesce(rank, {len(cat.PRECEDENCE) + 1})) AS detector
FROM (SELECT *, "begin" // 16 AS b FROM spans) LEFT JOIN {RANKS} ON detector = rd AND entity = re GROUP BY doc_id, b, entity""",
    )
    o["documents_with_findings"] = findings(ctx, "notes", NOTES, "SELECT DISTINCT doc_id FROM raw")
    o["documents_without_findings"] = findings(
        ctx, "notes", NOTES, "SELECT doc_id FROM notes WHERE doc_id NOT IN (SELECT doc_id FROM raw)"
    )

    o["documents_with_foreign_findings"] = with_all(
        SPANS, then="SELECT o_orderkey AS doc_id FROM orders WHERE o_orderkey IN (SELECT doc_id FROM spans WHERE entity = 'VIN')"
    )
    per_doc = """SELECT doc_id, {} FROM notes LEFT JOIN
  (SELECT doc_id, count(*) AS n, string_agg(chunk, '{}' ORDER BY chunk) AS r FROM raw GROUP BY doc_id) USING (doc_id)"""
    o["nested_fields"] = findings(
        ctx, "notes", NOTES, per_doc.format("cast(coalesce(n, 0) AS INT) AS n, coalesce(r, '') AS results", "|")
    )
    o["zip_explode"] = findings(ctx, "notes", NOTES, "SELECT doc_id, chunk, entity AS ner_label FROM raw")
    o["finisher"] = findings(ctx, "notes", NOTES, per_doc.format("coalesce(r, '') AS finished", ""))

    hashed = f"(SELECT *, {digest()} AS hash FROM kept)"
    for name, policy in (("obfuscate", None), ("obfuscate_by_policy", CHECK_POLICY)):
        o[name] = notes_kept(
            f'SELECT doc_id, "begin", entity, chunk, {replacement(policy)} AS surrogate FROM {hashed}'
        )
    o["same_length_surrogates"] = notes_kept(
        f"SELECT doc_id, entity, chunk, {replacement(None)} AS surrogate, true AS same_length FROM {hashed} "
        "WHERE entity IN ('PHONE', 'IDNUM')"
    )
    o["consistent_surrogates"] = notes_kept(
        "SELECT entity, chunk, cast(1 AS BIGINT) AS surrogates, count(*) AS n FROM kept GROUP BY entity, chunk"
    )
    # Skipped labels leave before overlaps are resolved.
    unskipped = tuple(r for r in ctx if CHECK_POLICY.get(r.entity) != "skip")
    o["deidentify_text"] = findings(
        unskipped, "notes", NOTES, "SELECT doc_id, deidentified FROM rebuilt", True,
        (*greedy("raw"), *rebuild("notes", "kept", CHECK_POLICY)),
    )
    o["text_sink"] = notes_kept("SELECT deidentified AS text FROM rebuilt", rebuild("notes", "kept", None))
    masks = {"PHONE": "mask_label", "EMAIL": "mask_label"}
    phone_mail = (by["PHONE"], by["EMAIL"], cat.PATTERN_RULES_BY_ENTITY["PHONE"], cat.PATTERN_RULES_BY_ENTITY["EMAIL"])
    o["deidentify_documents"] = findings(
        phone_mail, "docs", DOCS,
        "SELECT doc_id, md5(deidentified) AS digest, cast(length(deidentified) AS INT) AS characters FROM rebuilt",
        True, (*greedy("raw"), *rebuild("docs", "kept", masks)),
    )
    both = (
        f"both_chunks AS (SELECT {CHUNK_COLS} FROM raw UNION ALL SELECT {hit}, 'dictionary' AS detector FROM grams JOIN "
        f"(SELECT DISTINCT entity, {lower('phrase')} AS phrase FROM dictionary) USING (phrase) "
        "WHERE entity IN ('PATIENT', 'COUNTRY'))"
    )
    o["deidentify_with_dictionary"] = findings(
        (by["SSN"],), "notes", NOTES, "SELECT doc_id, deidentified FROM rebuilt", True,
        (grams(2), DICTIONARY, both, *greedy("both_chunks"),
         *rebuild("notes", "kept", {e: "mask_label" for e in ("PATIENT", "COUNTRY", "SSN")})),
    )
    o["count_entities_all_detectors"] = findings(
        (by["SSN"],), "notes", NOTES, counts.format("kept"), True,
        (grams(2), DICTIONARY, both, *greedy("both_chunks")),
    )
    o["policy_skip_overlap"] = findings(
        (by["MEDICALRECORD"],), "notes", NOTES, "SELECT doc_id, deidentified FROM rebuilt", True,
        (*greedy("raw"), *rebuild("notes", "kept", {"MEDICALRECORD": "mask_label"})),
    )
    o["metadata_deidentify"] = (
        "SELECT event_id, json_extract_string(props, '$.k') AS k, '<NAME>' AS patient_name, 'SSN <SSN>' AS comment FROM events"
    )

    o["pages_per_file"] = (
        "SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS path, count(DISTINCT page_id) AS pages FROM pages GROUP BY 1"
    )
    half = cat.THRESHOLD_BLOCK // 2
    o["adaptive_threshold"] = with_all(
        PIXELS,
        f"across AS (SELECT *, sum(v) OVER w AS s1, count(*) OVER w AS n1 FROM pixels WINDOW w AS "
        f"(PARTITION BY image_id, y ORDER BY x RANGE BETWEEN {half} PRECEDING AND {half} FOLLOWING))",
        f"block AS (SELECT image_id, y, x, v, sum(s1) OVER w AS s, sum(n1) OVER w AS n FROM across WINDOW w AS "
        f"(PARTITION BY image_id, x ORDER BY y RANGE BETWEEN {half} PRECEDING AND {half} FOLLOWING))",
        f"white AS (SELECT image_id, y, x, CASE WHEN v * n > s - {cat.THRESHOLD_OFFSET} * n THEN 255 ELSE 0 END AS v FROM block)",
        then=pixel_lines("white"),
    )
    o["page_text"] = with_all(
        NOTES, WORDS, then="SELECT page_id, trim(text) AS text, word_id, b, e FROM words JOIN notes ON doc_id = page_id"
    )
    o["interval_join"] = notes_kept(
        'SELECT page_id, entity, "begin", "end", word_id, b, e FROM kept k JOIN words ON k.doc_id = page_id '
        'AND k."begin" < e AND b < k."end"',
        (WORDS,),
    )
    o["position_regions"] = notes_kept(
        "SELECT page_id, x0, y0, x1, y1, entity FROM regions", (WORDS, boxes(8, 16), regions_sql(str(PAGE_WIDTH)))
    )
    o["position_realign"] = notes_kept(
        """SELECT page_id, chunk, entity, cast(coalesce(nb, mb) AS INT) AS "begin",
  cast(coalesce(nb, mb) + length(chunk) AS INT) AS "end" FROM moved m LEFT JOIN near USING (page_id, chunk, entity, mb)""",
        (
            'moved AS (SELECT doc_id AS page_id, chunk, entity, "begin" + doc_id % 150 AS mb FROM kept)',
            f"places AS (SELECT *, unnest(range(greatest(mb - {cat.MATCHING_WINDOW}, 0), mb + {cat.MATCHING_WINDOW} + 1)) AS b FROM moved)",
            "near AS (SELECT page_id, chunk, entity, mb, arg_min(b, (abs(b - mb), b)) AS nb FROM places JOIN notes ON doc_id = page_id "
            "WHERE substr(trim(text), b + 1, length(chunk)) = chunk GROUP BY ALL)",
        ),
    )
    o["fill_regions"] = with_all(PIXELS, PAINTED, then=pixel_lines("painted"))
    o["redacted_output"] = with_all(
        PIXELS, PAINTED,
        then="SELECT 'image/' || image_id AS path, count(DISTINCT y) AS rows, cast(sum(v) AS BIGINT) AS brightness "
        "FROM painted GROUP BY image_id",
    )
    o["deidentify_pages"] = notes_kept(
        """SELECT image_id, y, string_agg(CASE WHEN r.page_id IS NULL THEN c ELSE '#' END, '' ORDER BY x) AS line
FROM cells LEFT JOIN (SELECT DISTINCT page_id, y, x FROM covered) r USING (page_id, y, x) GROUP BY image_id, y""",
        (
            WORDS, boxes(1, 1), regions_sql("1000000", cat.REGION_PADDING).replace("any_value(height)", "1000000"),
            f"""cells AS (SELECT doc_id AS page_id, cast(doc_id AS INT) AS image_id, cast(p // {fx.PAGE_COLUMNS} AS INT) AS y,
  cast(p % {fx.PAGE_COLUMNS} AS INT) AS x, coalesce(nullif(substr(t, cast(p + 1 AS INT), 1), ''), ' ') AS c
  FROM (SELECT doc_id, trim(text) AS t, unnest(range((length(trim(text)) + {fx.PAGE_COLUMNS - 1}) // {fx.PAGE_COLUMNS} * {fx.PAGE_COLUMNS})) AS p FROM notes))""",
            f"""covered AS (SELECT page_id, cast(y AS INT) AS y, cast(unnest(range(x0, least(x1, {fx.PAGE_COLUMNS}))) AS INT) AS x FROM
  (SELECT page_id, x0, x1, unnest(range(y0, y1)) AS y FROM regions))""",
        ),
    )

    o["count_entities"] = notes_kept(counts.format("kept"))
    o["total_entities_and_characters"] = notes_kept(
        "SELECT count(*) AS entities, coalesce(cast(sum(length(chunk)) AS BIGINT), 0) AS characters FROM kept"
    )
    o["result_reuse"] = notes_kept(
        "SELECT entity, count(*) AS n, cast(sum(count(*)) OVER () AS BIGINT) AS total FROM kept GROUP BY entity"
    )
    pattern_pm = (cat.PATTERN_RULES_BY_ENTITY["PHONE"], cat.PATTERN_RULES_BY_ENTITY["EMAIL"])
    per_file = (
        "per_file AS (SELECT source AS path, count(*) AS pages, cast(sum(coalesce(n, 0)) AS BIGINT) AS entities, "
        "cast(sum(coalesce(k, 0)) AS BIGINT) AS characters FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n, "
        "sum(length(chunk)) AS k FROM raw GROUP BY doc_id) USING (doc_id) GROUP BY source)"
    )
    o["file_statistics"] = findings(pattern_pm, "docs", DOCS, "SELECT * FROM per_file", more=(per_file,))
    o["summary_record"] = findings(
        pattern_pm, "docs", DOCS,
        """SELECT path, '{"status":1,"numberOfPages":' || pages || ',"numberOfDeidEntities":' || entities
  || ',"numberOfChars":' || characters || '}' AS summary FROM per_file""",
        more=(per_file,),
    )
    o["binary_source"] = """SELECT cast(c_nationkey AS INT) AS nation, cast(sum(octet_length(encode('é ' || c_name)) + 1) AS BIGINT) AS length,
  sha256(string_agg('é ' || c_name || chr(10), '' ORDER BY c_custkey)) AS digest FROM customer GROUP BY c_nationkey"""
    mail_and_url = (by["EMAIL"], cat.PATTERN_RULES_BY_ENTITY["EMAIL"], cat.PATTERN_RULES_BY_ENTITY["URL"])
    o["streamed_intake"] = findings(
        mail_and_url, "docs", DOCS,
        "SELECT 1 AS status, count(*) AS entities, cast(sum(length(chunk)) AS BIGINT) AS characters FROM kept", True, greedy("raw"),
    )
    o["page_count"] = with_all(NOTES, then="SELECT count(*) AS pages FROM notes WHERE trim(text) <> ''")
    o["file_totals"] = notes_kept(
        """SELECT 'file/' || doc_id % 7 AS path, count(*) AS pages, cast(coalesce(sum(n), 0) AS BIGINT) AS entities,
  cast(coalesce(sum(c), 0) AS BIGINT) AS characters FROM notes LEFT JOIN
  (SELECT doc_id, count(*) AS n, sum(length(chunk)) AS c FROM kept GROUP BY doc_id) USING (doc_id) GROUP BY 1"""
    )
    o["unplaced_findings"] = notes_kept(
        """SELECT DISTINCT page_id, "begin", "end", entity FROM kept JOIN words ON page_id = doc_id
WHERE page_id % 10 = 0 AND word_id = 2 AND "begin" < e AND b < "end\"""", (WORDS,)
    )

    # A finding as wide as its tokens' outer edges, so punctuation inside stays and edges are trimmed.
    covered = (
        "covered AS (SELECT t.doc_id, t.sent_id, t.token_id, t.b, t.e, tok, min(CASE WHEN b <= k.\"begin\" THEN 'B-' ELSE 'I-' "
        "END || entity) AS tag FROM toks t LEFT JOIN kept k ON k.doc_id = t.doc_id AND k.\"begin\" < t.e AND b < k.\"end\" "
        "GROUP BY ALL)"
    )
    islands = """marked AS (SELECT *, substr(tag, 3) AS entity, lag(substr(tag, 3)) OVER w AS before FROM {} WINDOW w AS
  (PARTITION BY doc_id, sent_id ORDER BY token_id)),
runs AS (SELECT *, sum(CASE WHEN entity IS NOT NULL AND (tag LIKE 'B-%' OR before IS NULL OR before <> entity) THEN 1 ELSE 0 END)
  OVER (PARTITION BY doc_id, sent_id ORDER BY token_id) AS run FROM marked)"""
    o["tags_to_chunks"] = notes_kept(
        """SELECT doc_id, sent_id, min(b) AS "begin", max(e) AS "end",
  substr(any_value(text), min(b) + 1, max(e) - min(b)) AS chunk, entity, 'tagger' AS detector
FROM runs JOIN notes USING (doc_id) WHERE entity IS NOT NULL GROUP BY doc_id, sent_id, run, entity""",
        (covered, islands.format("covered")),
    )
    o["stray_tags_to_chunks"] = with_all(
        TURNS, sents("turns"), TOKS,
        "tagged AS (SELECT *, CASE length(tok) % 5 WHEN 0 THEN 'B-NAME' WHEN 1 THEN 'I-NAME' WHEN 2 THEN 'I-CITY' END AS tag FROM toks)",
        islands.format("tagged"),
        then="""SELECT doc_id, sent_id, min(b) AS "begin", max(e) AS "end", string_agg(tok, ' ' ORDER BY token_id) AS chunk,
  entity, 'tagger' AS detector FROM runs WHERE entity IS NOT NULL GROUP BY doc_id, sent_id, run, entity""",
    )
    o["weak_tags"] = notes_kept("SELECT coalesce(tag, 'O') AS tag, count(*) AS n FROM covered GROUP BY 1", (covered,))
    names = """named AS (SELECT *, token_id > 0 AND regexp_matches(tok, '^[A-Z][a-z]+$') AS capital FROM toks),
runs AS (SELECT *, token_id - row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY token_id) AS run FROM named WHERE capital)"""
    o["tag_tokens"] = with_all(
        ADMISSIONS, sents("admissions"), TOKS, names,
        then="""SELECT tag, count(*) AS n FROM (
  SELECT CASE WHEN NOT capital THEN 'O'
    WHEN lag(capital) OVER (PARTITION BY doc_id, sent_id ORDER BY token_id) THEN 'I-CONTACT' ELSE 'B-CONTACT' END AS tag FROM named)
GROUP BY tag""",
    )
    masked = (cat.PATTERN_RULES_BY_ENTITY["DATE"], cat.PATTERN_RULES_BY_ENTITY["URL"])
    spans = """tagger_chunks AS (
  SELECT * FROM raw UNION ALL
  SELECT doc_id, sent_id, cast(min(b) AS INT), cast(max(e) AS INT), substr(any_value(text), min(b) + 1, max(e) - min(b)), 'PHONE', 'tagger'
  FROM runs JOIN admissions USING (doc_id) GROUP BY doc_id, sent_id, run)"""
    o["deidentify_with_tagger"] = findings(
        masked, "admissions", ADMISSIONS, "SELECT doc_id, deidentified FROM rebuilt", True,
        (TOKS, names, spans, *greedy("tagger_chunks"), *rebuild("admissions", "kept", {e: "mask_label" for e in ("PHONE", "DATE", "URL")})),
    )
    o["pipeline_composition"] = findings((by["SSN"], by["AGE"]), "notes", NOTES, counts.format("raw"))
    o["layer_switch"] = findings(
        (by["SSN"],), "notes", NOTES, "SELECT doc_id, text, deidentified FROM rebuilt",
        more=rebuild("notes", "raw", {"SSN": "mask_same_length"}),
    )
    day = "SELECT date_trunc('day', ts) AS window_start, upper(event_type) AS entity, count(*) AS count FROM events {} GROUP BY 1, 2"
    o["windowed_counts"] = day.format("")
    o["windowed_counts_stream"] = day.format(
        "WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"
    )
    return o
