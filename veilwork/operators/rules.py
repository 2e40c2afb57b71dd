"""Contextual rules: a regex plus words that must stand near the match.

A rule set is compiled into one column expression that maps a text to an array of
findings on the same row.  All rules share one tokenising pass, so adding a rule
adds one branch, not another scan, and there is no shuffle.

Context words count when the gap between word and match is at most
``context_length`` characters inside the rule's scope, so only a bounded window
around each candidate is ever looked at.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilwork.functions.arrays import TEXT_BLOCK, block_substring, empty_array, let, text_blocks
from veilwork.functions.text import SENTENCE_END, clean_text, find_matches, sentence_counter, sentences, text_tokens

CHUNK_TYPE = (
    "struct<sent_id:int,begin:int,end:int,chunk:string,entity:string,detector:string>"
)
FOUND_TYPE = "struct<begin:int,end:int,chunk:string,entity:string,detector:string>"
CHUNK_FIELDS = ("sent_id", "begin", "end", "chunk", "entity", "detector")
DOCUMENT_SCOPE_SENT_ID = -1
ALNUM = "A-Za-z0-9"
# Labels of context rules are final; those of patterns, lists, dictionaries and taggers may be renamed.
CONTEXT, PATTERN = "context", "pattern"


MOST_TURNS = 1000  # of a group, before its stack counts as unbounded


def has_unbounded_group(regex: str) -> bool:
    """Whether a group is repeated without bound, other than possessively (those loop, the others recurse)."""
    i, in_class = 0, 0
    while i < len(regex):
        c = regex[i]
        if c == "\\":
            i = (regex + "\\E").index("\\E", i) if regex[i : i + 2] == "\\Q" else i
            i += 2
            continue
        if c == "[":
            in_class += 1
            i += 2 if regex[i + 1 : i + 2] == "]" else 3 if regex[i + 1 : i + 3] == "^]" else 1
            continue
        if in_class:
            in_class -= c == "]"
        elif c == ")":
            turns = re.match(r"([*+]|\{(\d+)(,)?(\d*)\})(\+?)", regex[i + 1 :])
            if turns and not turns[5]:
                most = None if turns[1] in "*+" or turns[3] and not turns[4] else int(turns[4] or turns[2])
                if most is None or most > MOST_TURNS:
                    return True
        i += 1
    return False


@dataclass(frozen=True)
class Rule:
    """One contextual rule (or context-free pattern, when it lists no words).

    ``literal``, ``min_length`` and ``max_length`` (0 for none) promise something about
    every token the regex accepts and only save time.  ``keep`` is a second regex a sub-token match must satisfy.  ``signal`` promises
    that every match holds a digit or an ``@``; such rules skip all other words.

    ``test`` accepts the same tokens as the regex of a token rule and is used in its place; ``cut`` is the part at the start
    of a sub-token match that is reported (a match without it is none).  Both let a regex run in linear time on any text.
    A group repeated without bound and not possessively needs stack for each turn, so one long token could end a
    worker's JVM: such a regex is refused unless a token rule brings a ``test`` without one.
    """

    entity: str
    regex: str
    rule_scope: str = "sentence"
    match_scope: str = "token"
    prefix: tuple[str, ...] = ()
    suffix: tuple[str, ...] = ()
    context_length: int = 0
    case_sensitive: bool = False
    prefix_and_suffix: bool = False
    keep: str | None = None
    signal: bool = False
    literal: str | None = None
    min_length: int = 0
    max_length: int = 0
    detector: str = ""
    test: str | None = None
    cut: str | None = None
    kind: str = ""

    def __post_init__(self) -> None:
        if self.test and self.match_scope != "token" or self.cut and self.match_scope != "sub-token":
            raise ValueError(f"rule {self.entity}: a test belongs to the token scope, a cut to the sub-token scope")
        for regex in (self.test or self.regex, self.cut, self.keep):
            if regex and has_unbounded_group(regex):
                raise ValueError(
                    f"rule {self.entity}: a group repeated without bound may exhaust the stack on a long token; "
                    f"make it possessive (*+, ++), bound it, or give a test: {regex}"
                )
        if self.rule_scope not in ("sentence", "document"):
            raise ValueError(f"unknown rule scope {self.rule_scope!r}")
        if self.match_scope not in ("token", "sub-token"):
            raise ValueError(f"unknown match scope {self.match_scope!r}")
        if (self.prefix or self.suffix) and self.context_length < 1:
            raise ValueError(f"rule {self.entity} lists context words but no context length")
        if not self.detector:
            object.__setattr__(self, "detector", f"{self.entity}_chunks")
        if not self.kind:
            object.__setattr__(self, "kind", PATTERN if self.detector.startswith("pattern_") else CONTEXT)
        if self.kind not in (CONTEXT, PATTERN):
            raise ValueError(f"unknown kind of rule {self.kind!r}")

    @property
    def has_context(self) -> bool:
        return bool(self.prefix or self.suffix)


def _flags(rule: Rule) -> str:
    return "(?s)" if rule.case_sensitive else "(?is)"


def _alternatives(words: Sequence[str]) -> str:
    """One of the words; the lookahead rejects most positions before trying any.

    Words share their beginnings (``lic(?:ense|ence)?``), so a character is compared once and not once a word.
    """
    firsts = "".join(sorted({re.escape(w[0]) for w in words}))
    return f"(?=[{firsts}])" + _shared(sorted(set(words)))


def _shared(words: Sequence[str]) -> str:
    rest: dict[str, list[str]] = {}
    for w in words:
        if w:
            rest.setdefault(w[0], []).append(w[1:])
    arms = [re.escape(c) + (_shared(ws) if ws != [""] else "") for c, ws in rest.items()]
    if not arms:
        return ""
    if len(arms) == 1 and "" not in words:
        return arms[0]
    return "(?:" + "|".join(arms) + ")" + ("?" if "" in words else "")


def _is_alnum(char: str) -> bool:
    return re.fullmatch(f"[{ALNUM}]", char) is not None


def _arms(words: Sequence[str]) -> dict[tuple[bool, bool], list[str]]:
    """Group words by whether their left and right edge need a word boundary."""
    groups: dict[tuple[bool, bool], list[str]] = {}
    for w in words:
        groups.setdefault((_is_alnum(w[0]), _is_alnum(w[-1])), []).append(w)
    return groups


# What remains of a context window inside the sentence of the match (see SENTENCE_END).
REST_OF_SENTENCE = r"^(?:[^\n.!?]++|[.!?](?![ \t\n\x0B\f\r]))*+"
EARLIER_SENTENCES = r"(?s)^.*(?:\n|[.!?][ \t\n\x0B\f\r])"


def prefix_regex(words: Sequence[str], length: int) -> str:
    """Matches a text that ends with a listed word at most ``length`` characters back."""
    arms = [
        (f"(?:^|[^{ALNUM}])" if left else "")
        + _alternatives(ws)
        + (f"(?:[^{ALNUM}].{{0,{length - 1}}})?" if right else f".{{0,{length}}}")
        for (left, right), ws in sorted(_arms(words).items())
    ]
    return "(?:" + "|".join(arms) + ")$"


def suffix_regex(words: Sequence[str], length: int) -> str:
    """Mirror image of :func:`prefix_regex` for the text after a match."""
    arms = [
        (f"(?:.{{0,{length - 1}}}[^{ALNUM}])?" if left else f".{{0,{length}}}")
        + _alternatives(ws)
        + (f"(?:[^{ALNUM}]|$)" if right else "")
        for (left, right), ws in sorted(_arms(words).items())
    ]
    return "^(?:" + "|".join(arms) + ")"


Window = Callable[[Column, Column], Column]


def _context_holds(rule: Rule, m: Column, window: Window, size: Column, alone: bool = False) -> Column:
    """The test of one rule's context, reading only as much text as decides it exactly.

    A window holds the gap, the longest word and one more character for its edge.  ``alone``: the text is one sentence.
    """
    in_sentence = rule.rule_scope == "sentence"

    def width(words: Sequence[str]) -> int:
        return rule.context_length + max(map(len, words)) + 1

    sides = []
    if rule.prefix:
        before = window(F.greatest(F.lit(0), m["begin"] - width(rule.prefix)), m["begin"])
        near = prefix_regex(rule.prefix, rule.context_length)
        if alone:
            sides.append(before.rlike(_flags(rule) + near))
        else:
            trimmed = F.regexp_replace(before, EARLIER_SENTENCES, "") if in_sentence else before
            sides.append(_holds(before, trimmed, rule.prefix, _flags(rule), near))
    if rule.suffix:
        after = window(m["end"], F.least(size, m["end"] + width(rule.suffix)))
        trimmed = F.regexp_extract(after, REST_OF_SENTENCE, 0) if in_sentence else after
        sides.append(_holds(after, trimmed, rule.suffix, _flags(rule), suffix_regex(rule.suffix, rule.context_length)))
    return reduce(lambda a, b: a & b if rule.prefix_and_suffix else a | b, sides)


def _holds(side: Column, in_sentence: Column, words: Sequence[str], flags: str, regex: str) -> Column:
    """The word test of one side; most windows hold no word at all, which a plain search tells before the window is cut."""
    return side.rlike(flags + _alternatives(words)) & in_sentence.rlike(flags + regex)


def _sub_token_matches(rule: Rule, text: Column) -> Column:
    found = find_matches(text, _flags(rule) + rule.regex)
    if rule.cut:
        found = F.filter(F.transform(found, lambda m: _cut(rule, m)), lambda m: m["begin"] < m["end"])
    if rule.keep:
        found = F.filter(found, lambda m: m["match"].rlike(rule.keep))
    return found


def _cut(rule: Rule, m: Column) -> Column:
    return let(
        F.regexp_extract(m["match"], f"{_flags(rule)}^(?:{rule.cut})", 0),
        lambda part: F.struct(m["begin"].alias("begin"), (m["begin"] + F.length(part)).alias("end"), part.alias("match")),
    )


_CLASS = re.compile(r"\[(\^?)((?:\\.|[^\]\\])*)\]")


def may_cross(rule: Rule) -> bool:
    """False only if no match of the rule's regex can hold a sentence end: a stop before white space, or a newline."""
    classes, rest = _CLASS.findall(rule.regex), _CLASS.sub("", rule.regex)
    wild = re.search(r"(?<!\\)\.|\\[WDS]", rest)

    def some(members: str, escapes: str) -> bool:
        inside = lambda c: any(m in c for m in members) or re.search(rf"\\[{escapes}]", c)
        shut_out = lambda c: all(m in c for m in members)
        return any(not shut_out(c) if negated else inside(c) for negated, c in classes)

    space = wild or re.search(r"[ \n\t]|\\[sntfr]", rest) or some(" ", "sntfrWD")
    stop = wild or re.search(r"\\[.?!sn]|!", rest) or some(".?!", "snWD")
    return bool(space and stop)


def _in_sentences(rule: Rule, text: Column) -> Column:
    """Matches inside the sentences.  Where no match of the whole text crosses a sentence end, these are the same."""
    if not may_cross(rule):
        return _sub_token_matches(rule, text)

    def one_by_one() -> Column:
        return F.flatten(
            F.transform(
                sentences(text),
                lambda s: F.transform(
                    _sub_token_matches(rule, s["sentence"]),
                    lambda m: F.struct(
                        (m["begin"] + s["begin"]).alias("begin"), (m["end"] + s["begin"]).alias("end"), m["match"].alias("match")
                    ),
                ),
            )
        )

    return let(
        _sub_token_matches(rule, text),
        lambda found: F.when(F.exists(found, lambda m: m["match"].rlike(SENTENCE_END)), one_by_one()).otherwise(found),
    )


def _if_possible(rule: Rule, text: Column, found: Column) -> Column:
    """Skip a rule in texts that hold none of its context words (or no digit or ``@``)."""
    gates = [text.rlike("[0-9@]")] if rule.signal else []
    gates += [text.rlike(_flags(rule) + context_gate(rule))] if rule.has_context else []
    if not gates:
        return found
    return F.when(reduce(lambda a, b: a & b, gates), found).otherwise(empty_array(FOUND_TYPE))


def context_gate(rule: Rule) -> str:
    """A cheap regex that any text holding one of the rule's words must match."""
    return _alternatives(context_words(rule))


def context_words(rule: Rule) -> list[str]:
    """The last run of letters and digits of each word of a rule."""
    return [(re.findall(f"[{ALNUM}]+", w) or [w])[-1] for w in rule.prefix + rule.suffix]


def _token_hits(rule: Rule, m: Column) -> Column:
    # Comparing lengths and searching a literal are far cheaper than a regex.
    tests = _cheap_tests(rule, m) + [m["match"].rlike(_flags(rule) + (rule.test or rule.regex))]
    return reduce(lambda a, b: a & b, tests)


def _cheap_tests(rule: Rule, m: Column) -> list[Column]:
    tests = []
    length = m["end"] - m["begin"]
    if rule.max_length and rule.min_length == rule.max_length:
        tests.append(length == rule.min_length)
    elif rule.max_length:
        tests.append(length.between(rule.min_length, rule.max_length))
    elif rule.min_length:
        tests.append(length >= rule.min_length)
    if rule.literal:
        tests.append(F.contains(m["match"], F.lit(rule.literal)))
    return tests


_AROUND = re.compile(r"\(\?[^:]|[*+?}]\+|\\[^dDsSwWtnfr.\-+*?()\[\]{}|/\\]|[\^$]|\\[QE]")


def by_sentence(rule: Rule) -> bool:
    """Whether a rule can be decided sentence by sentence, reading nothing but the sentence.

    A sub-token regex that looks around or never gives back could see beyond it.  The white space after a sentence end
    belongs to the sentence before, so a prefix word must not begin with it.
    """
    if rule.rule_scope != "sentence" or not rule.has_context or any(w[0] in " \t\n\x0b\f\r" for w in rule.prefix):
        return False
    return rule.match_scope == "token" or not rule.cut and not _AROUND.search(_CLASS.sub("", rule.regex))


def _any_word(rules: Sequence[Rule]) -> str:
    """A regex that any text holding a context word of one of the rules must match."""
    words = {case: [w for r in rules if r.case_sensitive == case for w in context_words(r)] for case in (True, False)}
    return "(?s)" + "|".join(f"(?{'' if case else 'i'}:{_alternatives(ws)})" for case, ws in words.items() if ws)


def _gated_sentences(rules: Sequence[Rule], text: Column) -> Column:
    """Sentences that hold a context word of some rule (and a digit or ``@``), each with its tokens; offsets count from its start."""
    gates = (["[0-9@]"] if all(r.signal for r in rules) else []) + [_any_word(rules)]
    held = F.filter(sentences(text), lambda s: reduce(lambda a, b: a & b, [s["sentence"].rlike(g) for g in gates]))
    token_rules = [r for r in rules if r.match_scope == "token"]
    if not token_rules:
        return held
    return F.transform(
        held,
        lambda s: F.struct(
            *[s[x].alias(x) for x in ("sent_id", "begin", "end", "sentence")],
            text_tokens(s["sentence"], all(r.signal for r in token_rules)).alias("toks"),
        ),
    )


def _in_own_sentence(rule: Rule, sents: Column, blocks: Column) -> Column:
    """Findings of one rule (see :func:`by_sentence`) in sentences as :func:`_gated_sentences` gives them."""
    gate = _flags(rule) + context_gate(rule)

    def worth(s: Column) -> Column:
        tests = [s["sentence"].rlike(gate)]
        if rule.match_scope == "token":
            tests.insert(0, F.exists(s["toks"], lambda m: reduce(lambda a, b: a & b, _cheap_tests(rule, m), F.lit(True))))
        return reduce(lambda a, b: a & b, tests)

    def found(s: Column) -> Column:
        size = s["end"] - s["begin"]

        def window(begin: Column, end: Column) -> Column:
            return F.when(size <= TEXT_BLOCK, F.substring(s["sentence"], begin + 1, end - begin)).otherwise(
                block_substring(blocks, s["begin"] + begin, s["begin"] + end)
            )

        def holds(m: Column) -> Column:
            tests = [_token_hits(rule, m)] if rule.match_scope == "token" else []
            return reduce(lambda a, b: a & b, tests + [_context_holds(rule, m, window, size, True)])

        return F.transform(
            F.filter(s["toks"] if rule.match_scope == "token" else _sub_token_matches(rule, s["sentence"]), holds),
            lambda m: F.struct(
                s["sent_id"].alias("sent_id"),
                (s["begin"] + m["begin"]).alias("begin"),
                (s["begin"] + m["end"]).alias("end"),
                m["match"].alias("chunk"),
                F.lit(rule.entity).alias("entity"),
                F.lit(rule.detector).alias("detector"),
            ),
        )

    return F.flatten(F.transform(F.filter(sents, worth), found))


def _number(found: Column, text: Column, document_detectors: Sequence[str]) -> Column:
    """Put the sentence number on findings (-1 for rules that read the whole document)."""

    def with_lookup(number: Callable[[Column], Column]) -> Column:
        def one(f: Column) -> Column:
            sent_id = number(f["begin"])
            if document_detectors:
                sent_id = F.when(
                    f["detector"].isin(*document_detectors), F.lit(DOCUMENT_SCOPE_SENT_ID)
                ).otherwise(sent_id)
            return F.struct(sent_id.alias("sent_id"), *[f[x].alias(x) for x in CHUNK_FIELDS[1:]])

        return F.transform(found, one)

    return sentence_counter(text)(with_lookup)


def _finding(rule: Rule, m: Column) -> Column:
    return F.struct(
        m["begin"].alias("begin"),
        m["end"].alias("end"),
        m["match"].alias("chunk"),
        F.lit(rule.entity).alias("entity"),
        F.lit(rule.detector).alias("detector"),
    )


def _decide(rule: Rule, found: Column, window: Window, size: Column) -> Column:
    """Findings of one rule among the matches ``found``; context is read last."""

    def holds(m: Column) -> Column:
        tests = [_token_hits(rule, m)] if rule.match_scope == "token" else []
        tests += [_context_holds(rule, m, window, size)] if rule.has_context else []
        return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)

    return F.transform(F.filter(found, holds), lambda m: _finding(rule, m))


def rule_findings(text: Column, rules: Sequence[Rule]) -> Column:
    """All findings of ``rules`` in a text, as ``array<CHUNK_TYPE>``; null for null text."""
    rules = tuple(rules)
    if not rules:
        return F.when(text.isNotNull(), empty_array(CHUNK_TYPE))
    own = [r for r in rules if by_sentence(r)]
    rest = [r for r in rules if r not in own]
    token_rules = [r for r in rest if r.match_scope == "token"]
    sub_rules = [r for r in rest if r.match_scope == "sub-token"]

    def all_groups(t: Column, blocks: Column | None, size: Column | None) -> Column:
        def window(begin: Column, end: Column) -> Column:
            return F.when(
                size <= TEXT_BLOCK, F.substring(t, begin + 1, end - begin)
            ).otherwise(block_substring(blocks, begin, end))

        parts = [
            _if_possible(
                r, t, _decide(r, (_in_sentences if r.rule_scope == "sentence" else _sub_token_matches)(r, t), window, size)
            )
            for r in sub_rules
        ]
        if token_rules:
            signal_only = all(r.signal for r in token_rules)
            parts.append(
                let(
                    text_tokens(t, signal_only),
                    lambda toks: F.concat(*[_if_possible(r, t, _decide(r, toks, window, size)) for r in token_rules]),
                )
            )
        document_detectors = sorted({r.detector for r in rest if r.rule_scope == "document"})
        return let(
            F.concat(*parts) if len(parts) > 1 else parts[0],
            lambda found: F.when(F.size(found) > 0, _number(found, t, document_detectors)).otherwise(
                empty_array(CHUNK_TYPE)
            ),
        )

    def own_groups(t: Column, blocks: Column) -> Column:
        found = let(_gated_sentences(own, t), lambda sents: of_sentences(sents, blocks))
        return F.when(t.rlike(_any_word(own)), found).otherwise(empty_array(CHUNK_TYPE))

    def of_sentences(sents: Column, blocks: Column) -> Column:
        parts = [_in_own_sentence(r, sents, blocks) for r in own]
        return F.concat(*parts) if len(parts) > 1 else parts[0]

    def on_clean(t: Column) -> Column:
        if not any(r.has_context for r in rules):
            return all_groups(t, None, None)

        def groups(blocks: Column, size: Column) -> Column:
            parts = ([all_groups(t, blocks, size)] if rest else []) + ([own_groups(t, blocks)] if own else [])
            return F.concat(*parts) if len(parts) > 1 else parts[0]

        # a text of one block is read without them
        return let(
            F.length(t),
            lambda size: let(F.when(size > TEXT_BLOCK, text_blocks(t)).otherwise(empty_array("string")), lambda blocks: groups(blocks, size)),
        )

    found = let(clean_text(text), on_clean)
    if all(r.signal for r in rules):
        found = F.when(text.rlike("[0-9@]"), found).when(text.isNotNull(), empty_array(CHUNK_TYPE))
    return found
