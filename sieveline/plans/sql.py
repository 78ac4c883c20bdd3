"""Twins of the fixtures and of shared expressions, as DuckDB SQL."""

from __future__ import annotations

from sieveline import fixed
from sieveline.plans import fixtures as fx


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def ql(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def arr(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


# ------------------------------------------------------------------ fixtures
DOCS = "docs AS (SELECT doc_id AS id, text AS comment_text FROM documents)"
SPIKED = (
    f"spiked AS (SELECT doc_id AS id, concat(text, ' ', list_extract({arr(fx.PHRASES)}, "
    f"CAST(doc_id % {len(fx.PHRASES)} AS INTEGER) + 1)) AS comment_text FROM documents)"
)
NULL_MESSAGES = (
    "null_messages AS (SELECT doc_id AS id, CASE WHEN doc_id % 37 = 0 THEN NULL WHEN doc_id % 41 = 0 THEN '' "
    "ELSE text END AS comment_text FROM documents)"
)
LABELS = "labs AS (SELECT doc_id AS id, toxic, 1 - quality AS low_quality FROM labels)"
LABELLED = f"{DOCS}, {LABELS}, labelled AS (SELECT d.*, l.toxic, l.low_quality FROM docs d JOIN labs l ON d.id = l.id)"


# ------------------------------------------------------------------ expressions
def words(c: str) -> str:
    return rf"string_split_regex({c}, '[^\p{{L}}\p{{N}}_]+')"


def norm(c: str) -> str:
    return rf"lower(regexp_replace(regexp_replace(coalesce({c}, ''), '^\s+', ''), '\s+$', ''))"


def caps(c: str) -> str:
    return (
        rf"(2 * length(regexp_replace({c}, '[^\p{{Lu}}]+', '', 'g')) > length(regexp_replace({c}, '[^\p{{L}}]+', '', 'g')))"
    )


def count_words(c: str, which) -> str:
    return f"len(list_filter({words(f'lower({c})')}, lambda x: x IN {ql(which)}))"


def repeats(c: str) -> str:
    return "(" + " + ".join(
        f"len(regexp_extract_all({c}, '[{p}]{{2,}}'))" for p in fixed.REPEATABLE_PUNCTUATION
    ) + ")"


def score(c: str, key: str) -> str:
    w = fx.SCORE_WEIGHTS
    terms = [
        f"CAST({caps(c)} AS INTEGER) * CAST({w[0]} AS DOUBLE)",
        f"{count_words(c, fx.INSULTS)} * CAST({w[1]} AS DOUBLE)",
        f"{count_words(c, fx.DEMEANING)} * CAST({w[2]} AS DOUBLE)",
        f"least({repeats(c)}, 3) * CAST({w[3]} AS DOUBLE)",
        f"(({key} * 53) % 97) * CAST({w[4]} AS DOUBLE)",
    ]
    return f"round(1.0 / (1.0 + exp(-(CAST({fx.SCORE_INTERCEPT} AS DOUBLE) + {' + '.join(terms)}))), 6)"


def second_score(key: str = "id") -> str:
    return f"((({key} * 37) % 101) / 100.0)"


SSN = (
    r"(?:^|[^\p{L}\p{N}_])((?:00[1-9]|0[1-9][0-9]|[1-578][0-9]{2}|6[0-57-9][0-9]|66[0-57-9])-(?:0[1-9]|[1-9][0-9])-"
    r"(?:000[1-9]|00[1-9][0-9]|0[1-9][0-9]{2}|[1-9][0-9]{3}))(?:$|[^\p{L}\p{N}_])"
)
CARD = r"(?:^|[^\p{L}\p{N}_])((?:\d{4}[\s-]?){3}\d{4})(?:$|[^\p{L}\p{N}_])"
OBFUSCATED = r"(f[u*@!]+ck|sh[i*@!]+t|b[i*@!]+tch)"
REGEX_RULES = [
    ("Obfuscated Profanity", OBFUSCATED),
    ("PII Leak - US Social Security Number", SSN),
    ("PII Leak - Credit Card (PCI-DSS)", CARD),
]
LEXICONS = [r for r in fixed.DEFAULT_RULES + fixed.DEMO_RULES if r["type"] == "lexicon"]
ALL_WORDS = [w for r in LEXICONS for w in r["words"]]


def tier1_cte(source: str, text: str = "comment_text") -> str:
    """``t1``: the source with ``nrm, t_status, t_reason, t_trigger`` (first lexicon word, else the first regex)."""
    category = "CASE " + " ".join(f"WHEN lex IN {ql(r['words'])} THEN {q(r['category'])}" for r in LEXICONS) + " END"
    reason = " ".join(f"WHEN regexp_matches(nrm, {q(p)}) THEN {q(c)}" for c, p in REGEX_RULES)
    trigger = " ".join(f"WHEN regexp_matches(nrm, {q(p)}) THEN regexp_extract(nrm, {q(p)}, 1)" for c, p in REGEX_RULES)
    return (
        f"t0 AS (SELECT *, {norm(text)} AS nrm FROM {source}), "
        f"tl AS (SELECT *, list_extract(list_filter({words('nrm')}, lambda x: x IN {ql(ALL_WORDS)}), 1) AS lex FROM t0), "
        f"tr AS (SELECT *, CASE WHEN lex IS NOT NULL THEN {category} {reason} END AS t_reason, "
        f"CASE WHEN lex IS NOT NULL THEN lex {trigger} END AS t_trigger FROM tl), "
        "t1 AS (SELECT *, CASE WHEN t_reason IS NULL THEN 'PASS' ELSE 'FLAGGED' END AS t_status FROM tr)"
    )


def bands(p: str, safe: float, toxic: float, inclusive: bool) -> str:
    op = ">=" if inclusive else ">"
    return f"CASE WHEN {p} < {safe} THEN 'OK' WHEN {p} {op} {toxic} THEN 'FLAGGED' ELSE 'AMBIGUOUS' END"


def actions(decision: str, table: dict[str, str]) -> str:
    return f"CASE {decision} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items()) + " END"


# ------------------------------------------------------------------ the cleaning chain
WIKI = (
    r"(?i)\[\[User:[^\]]*\]\]|\(\s*(?:talk|UTC)\s*\)|\b\d{1,2}:\d{2},\s*(?:"
    + "|".join(fixed.MONTHS)
    + r")\s+\d{1,2},\s*\d{4}\b"
)
URLS = rf"(?i)https?://\S+|www\.\S+|\b(?:{fixed.IP_OCTET}\.){{3}}{fixed.IP_OCTET}\b"
CONTRACTION = r"\b(?:" + "|".join(sorted(fixed.CONTRACTIONS, key=len, reverse=True)) + r")\b"
NON_ALNUM = r"[^a-z0-9\s]+"

_FAMILIES = [
    ("wouldn't've", "would not have"), ("won't", "will not"), ("can't|cannot", "can not"),
    ("let's", "let us"), ("y'all", "you all"),
    ("(should|could|would|must|might|need|did|does|do|had|has|have|is|are|was|were)n't", r"\1 not"),
    ("(could|should|would|might|must|i|you|we|they)'ve", r"\1 have"),
    ("(i)'m", r"\1 am"), ("(you|we|they)'re", r"\1 are"),
    ("(he|she|it|that|what|who|there|here)'s", r"\1 is"),
    ("(i|you|he|she|we|they)'d", r"\1 would"),
    ("(i|you|he|she|we|they|it|that)'ll", r"\1 will"),
]


def fold(c: str) -> str:
    private = "\ue000\ue001\ue002\ue003"
    return f"translate(strip_accents(translate({c}, {q(fixed.KEPT_LETTERS)}, {q(private)})), {q(private)}, {q(fixed.KEPT_LETTERS)})"


def wiki(c: str) -> str:
    return f"regexp_replace({c}, {q(WIKI)}, ' ', 'g')"


def urls(c: str) -> str:
    return f"regexp_replace({c}, {q(URLS)}, ' ', 'g')"


def expand(c: str) -> str:
    for pattern, replacement in _FAMILIES:
        c = f"regexp_replace({c}, {q(rf'\b(?:{pattern})\b')}, {q(replacement)}, 'g')"
    return c


def stem_pattern(stem: str) -> str:
    gap = fixed.PROFANITY_SEPARATORS + "*"
    return r"\b" + gap.join(f"{letter}+" for letter in fixed.SHORT_STEMS.get(stem, stem)) + fixed.PROFANITY_STEMS[stem] + r"\b"


def deobfuscate(c: str) -> str:
    for stem in fixed.PROFANITY_STEMS:
        c = f"regexp_replace({c}, {q(stem_pattern(stem))}, {q(stem)}, 'g')"
    return c


def punct(c: str) -> str:
    for p in fixed.REPEATABLE_PUNCTUATION:
        c = f"regexp_replace({c}, '[{p}]{{2,}}', '{p}', 'g')"
    return c


def alnum(c: str) -> str:
    return f"regexp_replace({c}, {q(NON_ALNUM)}, ' ', 'g')"


def squeeze(c: str) -> str:
    return rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


def chain(source: str, text: str = "comment_text") -> str:
    """CTEs ``s0`` .. ``s9``; ``s9`` has every stage as a column, ``cleaned`` being the last."""
    steps = [
        ("s0", f"SELECT *, coalesce({text}, '') AS raw, regexp_matches(coalesce({text}, ''), '^\\s*$') AS blank FROM {source}"),
        ("s1", f"SELECT *, CASE WHEN blank THEN '' ELSE {fold('raw')} END AS folded FROM s0"),
        ("s2", f"SELECT *, {caps('folded')} AS caps, {wiki('folded')} AS no_wiki FROM s1"),
        ("s3", f"SELECT *, {urls('no_wiki')} AS no_url FROM s2"),
        ("s4", "SELECT *, lower(no_url) AS low FROM s3"),
        ("s5", f"SELECT *, {expand('low')} AS expanded FROM s4"),
        ("s6", f"SELECT *, {deobfuscate('expanded')} AS plain FROM s5"),
        ("s7", f"SELECT *, {punct('plain')} AS single FROM s6"),
        ("s8", f"SELECT *, {alnum('single')} AS alnum FROM s7"),
        (
            "s9",
            f"SELECT *, CASE WHEN blank THEN '' WHEN caps THEN concat('{fixed.CAPS_TOKEN} ', {squeeze('alnum')}) "
            f"ELSE {squeeze('alnum')} END AS cleaned FROM s8",
        ),
    ]
    return ", ".join(f"{name} AS ({body})" for name, body in steps)


def metrics(digits: int) -> str:
    """Metric expressions over columns ``tn, fp, fn, tp``."""

    def r(a, b):
        return f"round(coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0), {digits})"

    return (
        f"{r('(tp + tn)', '(tn + fp + fn + tp)')} AS accuracy, {r('tp', '(tp + fp)')} AS precision, "
        f"{r('tp', '(tp + fn)')} AS recall, {r('(2 * tp)', '(2 * tp + fp + fn)')} AS f1_score"
    )


def confusion(y: str, p: str) -> str:
    return (
        f"count(*) FILTER ({y} = 0 AND {p} = 0) AS tn, count(*) FILTER ({y} = 0 AND {p} = 1) AS fp, "
        f"count(*) FILTER ({y} = 1 AND {p} = 0) AS fn, count(*) FILTER ({y} = 1 AND {p} = 1) AS tp"
    )


PREDICTIONS = (
    f"{LABELLED}, scored AS (SELECT *, {score('comment_text', 'id')} AS y_prob FROM labelled), "
    "preds AS (SELECT id, comment_text, toxic AS y_true, CAST(y_prob > 0.5 AS INTEGER) AS y_pred, y_prob, toxic, "
    "low_quality FROM scored)"
)
TIER1_LABELLED = (
    f"{LABELLED}, {tier1_cte('labelled')}, tl1 AS (SELECT id, comment_text, toxic, low_quality, "
    "greatest(toxic, low_quality) AS any_toxic, CASE WHEN t_reason IS NULL THEN 0 ELSE 1 END AS tier1_pred, "
    "coalesce(t_reason, '') AS tier1_category FROM t1)"
)
