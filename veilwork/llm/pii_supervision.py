"""Personal data by weak supervision, with DataFrame functions only.

Four base kinds are found by exact rules (e-mail, IPv4, card, phone).  Other candidates (written-out e-mail addresses, national phone
numbers, identity numbers, secrets) come from one wider pattern, and five labelers vote on each: +1 personal, -1 not, 0 no opinion:

* ``form``: strict formats of the kind, and forms that rule it out;
* ``gazetteer``: known prefixes of keys, known top-level domains;
* ``cue``: words before the span that announce it, or announce something harmless;
* ``mixture``: how letters and digits mix;
* ``variety``: how many different characters the span has.

Expectation-maximisation over the counted vote patterns (at most 3^5 per kind) estimates how reliable each labeler is for each class
and gives every pattern a posterior; these soft labels train the final classifier, a logistic regression over kind, votes and
length.  All counts cover the whole input; only pattern counts reach the driver.  Scores are sums of literals in the plan.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.functions.arrays import block_substring, empty_array, let, running_starts, text_blocks
from veilwork.functions.text import SEPARATOR, find_matches

# Fixed values of the contract.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

#: Order of kinds at one start; the base kinds first, as the contract lists them.
KINDS = ("email", "ip", "card", "phone", "mail", "tel", "ssn", "secret")
BASE_KINDS, ADDED_KINDS = KINDS[:4], KINDS[4:]

#: Every part ends where its run of characters does, so the parts are read possessively: a loop, not a recursion for each.
MAIL_FORM = r"[A-Za-z0-9._%+-]{1,64}\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:[\[(](?:dot|DOT)[\])]|\.)\x20?[A-Za-z0-9-]{2,63}+(?![A-Za-z0-9_@-]))++"
TEL_3_3_4 = r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}"
#: Other national groupings: five pairs, an area code in 0, nine digits from 6 to 9.
TEL_PAIRS, TEL_AREA = r"0[1-9](?:[\x20.-][0-9]{2}){4}", r"\(?0[1-9][0-9]{1,4}\)?(?:\x20?[/-]\x20?|\x20)[0-9]{3,8}(?:[\x20-][0-9]{2,8}){0,2}"
TEL_NINE = r"[6-9][0-9]{2}(?:(?:[\x20.-][0-9]{3}){2}|(?:[\x20.-][0-9]{2}){3})|[89][0-9][\x20.-][0-9]{3}(?:[\x20.-][0-9]{2}){2}"
TEL_FORM = rf"(?:{TEL_3_3_4}|{TEL_PAIRS}|{TEL_AREA}|{TEL_NINE})"
SSN_FORM = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
#: A run of any length; the joined form also holds ``-``, ``.``, ``+`` and ``/`` inside and ends in the padding of base64.
SECRET_FORM = r"[A-Za-z0-9_]{16,}+"
JOINED_FORM = r"(?<!/)(?=[A-Za-z0-9_.+/-]{16})[A-Za-z0-9_]++(?:[-.+/]{1,2}[A-Za-z0-9_]++)*+(?:[+/]?={1,2}(?![A-Za-z0-9_\"'+/-]))?+(?!@)"
CANDIDATE = rf"(?<![A-Za-z0-9_.@+-])(?:(?:{MAIL_FORM}|{TEL_FORM}|{SSN_FORM})(?![A-Za-z0-9_@-])|{JOINED_FORM}|{SECRET_FORM}(?![A-Za-z0-9_@-]))"
CUES = {
    "mail": r"e-?mail|mail|contact|write|correo|courriel",
    "tel": r"tel|phone|call|mobile|fax|whatsapp|llam|appel|anruf",
    "ssn": r"ssn|social|security|tax|identity|\bid\b",
    "secret": r"pass(?:word|wd)?|pwd|token|secret|key|api|auth|bearer|credential",
}
HARMLESS_CUES = r"version|release|isbn|licen[cs]e|page|figure|build|sha256|commit|doi|model"
KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "sk_live_", "sk_test_", "xoxb", "xoxp", "glpat")
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk")
LABELERS = ("form", "gazetteer", "cue", "mixture", "variety")
LEFT = 24
THRESHOLD = 0.5
SPAN = "struct<start:int,rank:int,end:int>"


def _clean(text: Column) -> Column:
    """Null is empty, and the mark of ``find_matches`` a control character that no pattern knows."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.contains(text, F.lit(SEPARATOR)), F.translate(text, SEPARATOR, "\u0003")).otherwise(text)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _spans(text: Column, kind: str, gate: Column, pattern: str, valid) -> Column:
    found = F.filter(find_matches(text, pattern), lambda m: valid(m["match"])) if valid else find_matches(text, pattern)
    rank = F.lit(KINDS.index(kind))
    made = F.transform(found, lambda m: F.struct(m["begin"].alias("start"), rank.alias("rank"), m["end"].alias("end")))
    return F.when(gate, made).otherwise(empty_array(SPAN))


def base_spans(text: Column) -> Column:
    """The base spans of a cleaned text by start, then kind; leftmost non-overlapping matches that pass their test."""

    def card(m: Column) -> Column:
        return let(_digits(m), lambda d: F.length(d).between(14, 19) & F.call_function("luhn_check", d))

    some = F.rlike(text, F.lit("[0-9]"))
    return F.array_sort(
        F.concat(
            _spans(text, "email", F.contains(text, F.lit("@")), EMAIL, None),
            _spans(text, "ip", F.rlike(text, F.lit(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")), IP, lambda m: F.rlike(m, F.lit(rf"\A{BYTE}(?:\.{BYTE}){{3}}\z"))),
            _spans(text, "card", some & F.rlike(text, F.lit(r"[0-9](?:[\x20-]?[0-9]){13}")), CARD, card),
            _spans(text, "phone", F.contains(text, F.lit("+")), PHONE, lambda m: F.length(_digits(m)).between(10, 15)),
        )
    )


def candidates(text: Column) -> Column:
    """Candidate spans of a cleaned text with kind, votes and length class."""

    def collect(ps: Column) -> Column:
        def one(starts: Column, i: Column) -> Column:
            return F.struct(starts[i].alias("start"), starts[i + 1].alias("end"), ps[i].alias("match"), F.lower(F.right(ps[i - 1], F.lit(LEFT))).alias("left"))

        return let(
            running_starts(F.transform(ps, F.length)),
            lambda starts: F.transform(F.sequence(F.lit(1), F.size(ps) - 2, F.lit(2)), lambda i: one(starts, i)),
        )

    pieces = F.split(F.regexp_replace(text, CANDIDATE, f"{SEPARATOR}$0{SEPARATOR}"), SEPARATOR)
    raw = let(pieces, lambda ps: F.when(F.size(ps) > 1, collect(ps)).otherwise(empty_array("struct<start:int,end:int,match:string,left:string>")))
    gate = F.rlike(text, F.lit(r"[0-9A-Za-z_.+/-]{16}|[0-9]{2}[\x20.)/-]|[\[(](?:at|AT)[\])]"))
    known = F.transform(raw, _with_kind)
    # a run of letters alone is a word, whatever its length
    real = F.filter(known, lambda c: (c["kind"] != "secret") | (F.rlike(c["match"], F.lit("[0-9]")) & F.rlike(c["match"], F.lit("[A-Za-z]"))))
    return F.when(gate, F.transform(real, _with_votes)).otherwise(empty_array("struct<start:int,end:int,kind:string,size:int,form:int,gazetteer:int,cue:int,mixture:int,variety:int>"))


def _with_kind(c: Column) -> Column:
    kind = F.when(F.rlike(c["match"], F.lit(r"[\[(](?:at|AT)[\])]")), "mail").when(F.rlike(c["match"], F.lit(rf"\A{SSN_FORM}\z")), "ssn")
    kind = kind.when(F.rlike(c["match"], F.lit(rf"\A{TEL_FORM}\z")), "tel").otherwise("secret")
    return F.struct(c["start"].alias("start"), c["end"].alias("end"), c["match"].alias("match"), c["left"].alias("left"), kind.alias("kind"))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _with_votes(c: Column) -> Column:
    kind, m, left = c["kind"], c["match"], c["left"]
    like = lambda pattern: F.rlike(m, F.lit(pattern))
    american = like(rf"\A{TEL_3_3_4}\z")
    strict = (
        F.when(kind == "ssn", ~like(r"\A(?:000|666|9)|-00-|-0000\z"))
        .when(kind == "tel", F.when(american, like(r"\A\(?[2-9][0-9]{2}\)?[\x20.-][2-9]")).otherwise(like(rf"\A(?:{TEL_PAIRS}|{TEL_AREA})\z")))
        .when(kind == "mail", like(r"(?i)[\[(]dot[\])]|\.[a-z]{2,}\z"))
        .otherwise(like(r"\A(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[po]_[A-Za-z0-9]{36}|xox[bp][A-Za-z0-9_-]{20,}|glpat-[A-Za-z0-9_-]{20,})\z|(?:\A|[-.+/])[0-9a-f]{18,}(?:\z|[-.+/=])"))
    )
    ruled_out = F.when(kind == "ssn", like(r"\A(?:000|666|9)")).when(kind == "tel", american & like(r"\A\(?[01]")).when(kind == "secret", like(r"\A[a-z]+[0-9]{1,4}\z|\A[0-9]{1,4}[a-z]+\z|__|\A(?:(?:[A-Za-z]++|[0-9]{1,4}+)(?:[-.+/]++|\z))*+\z"))
    listed = F.when(kind == "secret", F.exists(F.array(*map(F.lit, KEY_PREFIXES)), lambda p: F.startswith(m, p))).when(
        kind == "mail", like(r"(?i)(?:%s)\z" % "|".join(DOMAINS))
    )
    cue = F.lit(False)
    for name, words in CUES.items():
        cue = F.when(kind == name, F.rlike(left, F.lit(words))).otherwise(cue)
    turns = F.length(F.regexp_replace(F.regexp_replace(m, "[0-9]+", "9"), "[^9]+", "a"))
    kinds_of_characters = F.size(F.array_distinct(F.split(m, "")))
    return F.struct(
        c["start"].alias("start"),
        c["end"].alias("end"),
        kind.alias("kind"),
        F.least(F.floor((F.length(m) - 8) / 8), F.lit(5)).cast("int").alias("size"),
        _vote(strict, F.coalesce(ruled_out, F.lit(False))).alias("form"),
        F.when(F.coalesce(listed, F.lit(False)), 1).otherwise(0).alias("gazetteer"),
        _vote(cue, F.rlike(left, F.lit(HARMLESS_CUES))).alias("cue"),
        F.when(kind == "secret", _vote(turns >= 5, turns <= 2)).otherwise(0).alias("mixture"),
        F.when(kind == "secret", _vote(kinds_of_characters >= 9, kinds_of_characters <= 5)).otherwise(_vote(kinds_of_characters >= 6, kinds_of_characters <= 4)).alias("variety"),
    )


Pattern = tuple[str, int, tuple[int, ...]]


def pattern_counts(docs: DataFrame) -> dict[Pattern, int]:
    """Candidates by kind, length class and votes over all texts; at most 4 x 7 x 3^5 rows reach the driver."""
    spans = docs.select(F.explode(candidates(_clean(F.col("text")))).alias("c"))
    rows = spans.groupBy("c.kind", "c.size", *(f"c.{x}" for x in LABELERS)).count().collect()
    return {(r["kind"], r["size"], tuple(r[x] for x in LABELERS)): r["count"] for r in rows}


def reliabilities(counts: dict[Pattern, int], rounds: int = 50) -> tuple[list[list[dict[int, float]]], dict[tuple[int, ...], float]]:
    """(P(vote | class, it votes) by labeler and class, P(personal | votes)) by expectation-maximisation.

    The start believes each labeler a little, so class 1 keeps meaning personal, and the same beliefs smooth the counts, so a
    labeler keeps its direction where votes are few.  Abstaining says nothing.
    """
    votes: dict[tuple[int, ...], float] = {}
    for (_, _, v), n in counts.items():
        votes[v] = votes.get(v, 0) + n
    belief = ({1: 0.2, -1: 0.8}, {1: 0.85, -1: 0.15})
    tables = [[dict(b) for b in belief] for _ in LABELERS]
    prior, posterior = 0.5, {}
    for _ in range(rounds):
        for v in votes:
            odds = math.log(prior / (1 - prior)) + sum(math.log(t[1][x] / t[0][x]) for t, x in zip(tables, v, strict=True) if x)
            posterior[v] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
        total = sum(votes.values())
        prior = (sum(n * posterior[v] for v, n in votes.items()) + 5) / (total + 10)
        for k, t in enumerate(tables):
            for cls in (0, 1):
                mass = {x: 10 * b for x, b in belief[cls].items()}
                for v, n in votes.items():
                    if v[k]:
                        mass[v[k]] += n * (posterior[v] if cls else 1 - posterior[v])
                z = sum(mass.values())
                t[cls] = {x: m / z for x, m in mass.items()}
    return tables, posterior


def feature_names() -> list[str]:
    return ["bias", *(f"kind:{k}" for k in ADDED_KINDS), *(f"{x}:{v}" for x, v in product(LABELERS, (1, -1))), *(f"size:{s}" for s in range(-1, 6))]


def _features(pattern: Pattern) -> list[str]:
    kind, size, votes = pattern
    return ["bias", f"kind:{kind}", *(f"{x}:{v}" for x, v in zip(LABELERS, votes, strict=True) if v), f"size:{size}"]


def train(counts: dict[Pattern, int], rounds: int = 300) -> dict[str, float]:
    """Weights of the span classifier: ridge logistic regression on the posteriors, weighted by counts (full gradient)."""
    _, posterior = reliabilities(counts)
    rows = sorted((p, _features(p), n) for p, n in counts.items())
    total = sum(n for _, _, n in rows)
    weights = dict.fromkeys(feature_names(), 0.0)
    for _ in range(rounds if rows else 0):
        gradient = dict.fromkeys(weights, 0.0)
        for p, names, n in rows:
            error = 1 / (1 + math.exp(-max(-40.0, min(40.0, sum(weights[f] for f in names))))) - posterior[p[2]]
            for f in names:
                gradient[f] += error * n / total
        for f, g in gradient.items():
            # votes should carry the verdict, so kind and length are held back more
            weights[f] -= 1.0 * (g + (0.0005 if f.split(":")[0] in LABELERS else 0.02) * weights[f])
    return weights


def added_spans(text: Column, weights: dict[str, float], base: Column) -> Column:
    """Candidates the classifier takes for personal data that touch no base span."""

    def score(c: Column) -> Column:
        total = F.lit(weights["bias"])
        for name in ADDED_KINDS:
            total = total + F.when(c["kind"] == name, weights[f"kind:{name}"]).otherwise(0.0)
        for x, v in product(LABELERS, (1, -1)):
            total = total + F.when(c[x] == v, weights[f"{x}:{v}"]).otherwise(0.0)
        for s in range(-1, 6):
            total = total + F.when(c["size"] == s, weights[f"size:{s}"]).otherwise(0.0)
        return total

    limit = math.log(THRESHOLD / (1 - THRESHOLD))
    kept = F.filter(candidates(text), lambda c: (score(c) >= limit) & ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    rank = F.create_map(*(F.lit(x) for k in ADDED_KINDS for x in (k, KINDS.index(k))))
    return F.transform(kept, lambda c: F.struct(c["start"].alias("start"), rank[c["kind"]].alias("rank"), c["end"].alias("end")))


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["rank"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``docs`` with ``base`` and ``found``: base spans, and all spans, by start and then kind; offsets in code points.

    Null and empty texts have none.  Other columns pass through.
    """
    text = _clean(F.col("text"))
    docs = docs.withColumn("_pii_base", base_spans(text))
    docs = docs.withColumn("_pii_found", F.array_sort(F.concat("_pii_base", added_spans(text, weights, F.col("_pii_base")))))
    return docs


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row, by a classifier trained on the same texts."""
    found = find(docs.select("doc_id", "text"), train(pattern_counts(docs)))
    count = lambda kind: F.size(F.filter("_pii_base", lambda s: s["rank"] == KINDS.index(kind))).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(joined(F.col("_pii_base")), 256).alias("base_sha256"),
        joined(F.col("_pii_found")).alias("spans"),
    )


def redacted(docs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; overlapping spans give one, named by the first.

    Null texts stay null; other columns pass through.
    """
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def merge(spans: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            last = F.element_at(acc, -1)
            joins = (F.size(acc) > 0) & (F.coalesce(F.get(acc, F.size(acc) - 1)["end"], F.lit(-1)) > s["start"])
            longer = F.array(F.struct(last["start"].alias("start"), last["rank"].alias("rank"), F.greatest(last["end"], s["end"]).alias("end")))
            return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), longer)).otherwise(F.concat(acc, F.array(s)))

        return F.aggregate(spans, empty_array(SPAN), step)

    def build(text: Column, spans: Column) -> Column:
        def assemble(blocks: Column) -> Column:
            changed = F.transform(
                spans, lambda s, i: F.concat(block_substring(blocks, F.coalesce(F.get(spans, i - 1)["end"], F.lit(0)), s["start"]), names[s["rank"]])
            )
            return F.concat(F.array_join(changed, ""), block_substring(blocks, F.element_at(spans, -1)["end"], F.length(text)))

        return let(text_blocks(text), assemble)

    found = find(docs, weights)
    text = F.when(F.size("_pii_found") == 0, F.col("text")).otherwise(let(merge(F.col("_pii_found")), lambda s: build(F.col("text"), s)))
    return found.withColumn("text", text).drop("_pii_base", "_pii_found")
