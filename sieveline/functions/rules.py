"""Rule matching as Column expressions built from a rule table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveline.functions import patterns
from sieveline.functions.text import bind


@dataclass(frozen=True)
class Rule:
    ord: int
    category: str
    type: str
    boundary: bool = True
    words: tuple[str, ...] = ()
    pattern: str | None = None
    starts: str | None = None

    @property
    def java_pattern(self) -> str:
        if self.type == "regex":
            return patterns.to_java(self.pattern, self.starts)
        if self.boundary:
            return patterns.whole_words(self.words)
        return f"(?:{patterns.literal_alternation(self.words)})"


def make_rules(entries) -> list[Rule]:
    """Rules from plain dictionaries, in order, with words lower-cased."""
    rules = []
    for i, entry in enumerate(entries):
        if entry["type"] not in ("lexicon", "regex"):
            raise ValueError(f"unknown rule type {entry['type']!r}")
        rules.append(
            Rule(
                ord=i,
                category=entry["category"],
                type=entry["type"],
                boundary=bool(entry.get("boundary", True)),
                words=tuple(w.lower() for w in entry.get("words") or ()),
                pattern=entry.get("pattern"),
                starts=entry.get("starts"),
            )
        )
    return rules


def lexicons(rules: list[Rule]) -> list[Rule]:
    return [r for r in rules if r.type == "lexicon" and r.words]


def _one_word_per_place(lex: list[Rule]) -> bool:
    """Whole words only, and no phrase that continues a word of another lexicon: then at most one
    word can match at a place, and rule order matters only for words listed twice."""
    if not all(r.boundary for r in lex):
        return False
    owners = [(w, r.ord) for r in lex for w in r.words]
    return not any(
        longer != word and longer.startswith(word) and a != b and not (longer[len(word)].isalnum() or longer[len(word)] == "_")
        for word, a in owners
        for longer, b in owners
    )


def lexicon_pattern(rules: list[Rule]) -> str | None:
    """One pattern over all lexicons. The engine takes the leftmost match, then rule order."""
    lex = lexicons(rules)
    if not lex:
        return None
    if _one_word_per_place(lex):
        return patterns.whole_words(w for r in lex for w in r.words)
    return "|".join(f"({r.java_pattern})" for r in lex)


def _lexicon_category(c: Column, trigger: Column, rules: list[Rule], pattern: str) -> Column:
    lex = lexicons(rules)
    if _one_word_per_place(lex):
        owned = [F.when(trigger.isin(*r.words), F.lit(r.category)) for r in lex]
    else:
        owned = [
            F.when(F.regexp_extract(c, pattern, i) != "", F.lit(r.category)) for i, r in enumerate(lex, start=1)
        ]
    return F.coalesce(*owned)


def rule_match(c: Column, rule: Rule) -> Column:
    return F.coalesce(F.rlike(c, F.lit(rule.java_pattern)), F.lit(False))


def _first_hit(c: Column, rules: list[Rule]) -> Column:
    """``array(category, trigger)`` of the verdict, or null if nothing hits. The text itself, which
    may be a long expression, is evaluated once.

    The later branches and the category lookup run only for the rows that reach them.
    """
    return bind(F.coalesce(c, F.lit("")), lambda text: _verdict(text, rules, lexicon_pattern(rules)))


def _verdict(c: Column, rules: list[Rule], pattern: str | None) -> Column:
    verdict = F.lit(None).cast("array<string>")
    regexes = [r for r in rules if r.type == "regex"]
    for rule in reversed(regexes):
        hit = F.regexp_extract_all(c, F.lit(rule.java_pattern), F.lit(0))
        verdict = F.when(
            F.rlike(c, F.lit(rule.java_pattern)), F.array(F.lit(rule.category), hit[0])
        ).otherwise(verdict)
    if pattern is not None:
        word = F.regexp_extract(c, pattern, 0)
        verdict = F.when(
            F.rlike(c, F.lit(pattern)), F.array(_lexicon_category(c, word, rules, pattern), word)
        ).otherwise(verdict)
    return verdict


def tier1_inspect(c: Column, rules: list[Rule]) -> Column:
    """``struct(status, reason, trigger)``: the leftmost lexicon word, else the first regex rule.

    The text is expected in lower case.
    """
    return bind(
        _first_hit(c, rules),
        lambda hit: F.struct(
            F.when(hit.isNull(), F.lit("PASS")).otherwise(F.lit("FLAGGED")).alias("status"),
            hit[0].alias("reason"),
            hit[1].alias("trigger"),
        ),
    )


def tier1_inspect_ruleorder(c: Column, rules: list[Rule]) -> Column:
    """The other verdict rule: the first rule in list order that matches anywhere, any case."""

    def first(text: Column) -> Column:
        hits = [F.when(F.rlike(text, F.lit("(?iU)" + r.java_pattern)), F.lit(r.category)) for r in rules]
        return F.coalesce(*hits, F.lit(None).cast("string"))

    return bind(F.lower(F.coalesce(c, F.lit(""))), first)


def tier1_predict(c: Column, rules: list[Rule]) -> Column:
    """``struct(pred, category)`` with 1 and the category for a hit, 0 and an empty string otherwise."""
    return bind(
        _first_hit(c, rules),
        lambda hit: F.struct(
            hit.isNotNull().cast("int").alias("pred"),
            F.coalesce(hit[0], F.lit("")).alias("category"),
        ),
    )
