"""Word lists, lookup tables, patterns, thresholds and texts.

Everything in this module is data whose exact value decides the results. There is no logic
here, and no other module spells these values out again.
"""

from __future__ import annotations

# --- fixed values: label columns -------------------------------------------------------------
LABEL_COLUMNS = ["toxic", "severe_toxic", "obscene", "threat", "insult", "identity_hate"]

# --- fixed values: cells a CSV reader takes as null ------------------------------------------
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# --- fixed values: contractions --------------------------------------------------------------
CONTRACTIONS = {
    "shouldn't": "should not", "couldn't": "could not", "wouldn't": "would not",
    "mustn't": "must not", "mightn't": "might not", "needn't": "need not",
    "didn't": "did not", "doesn't": "does not", "don't": "do not", "hadn't": "had not",
    "hasn't": "has not", "haven't": "have not", "isn't": "is not", "aren't": "are not",
    "wasn't": "was not", "weren't": "were not", "won't": "will not", "can't": "can not",
    "cannot": "can not",
    "could've": "could have", "should've": "should have", "would've": "would have",
    "might've": "might have", "must've": "must have", "wouldn't've": "would not have",
    "i'm": "i am", "you're": "you are", "we're": "we are", "they're": "they are",
    "he's": "he is", "she's": "she is", "it's": "it is", "that's": "that is",
    "what's": "what is", "who's": "who is", "there's": "there is", "here's": "here is",
    "i've": "i have", "you've": "you have", "we've": "we have", "they've": "they have",
    "i'd": "i would", "you'd": "you would", "he'd": "he would", "she'd": "she would",
    "we'd": "we would", "they'd": "they would",
    "i'll": "i will", "you'll": "you will", "he'll": "he will", "she'll": "she will",
    "we'll": "we will", "they'll": "they will", "it'll": "it will", "that'll": "that will",
    "let's": "let us", "y'all": "you all",
}

# --- fixed values: disguised profanity -------------------------------------------------------
# stem -> the endings that collapse onto it; characters allowed between the letters.
PROFANITY_SEPARATORS = r"[*@#.\-]"
PROFANITY_STEMS = {
    "fuck": "(?:ing|er|ed|s)?",
    "shit": "(?:ting|ty|s)?",
    "bitch": "(?:es)?",
    "asshole": "",
    "cunt": "(?:s)?",
    "damn": "(?:ed|it)?",
    # the last two letters of this stem are endings, so a separator may close the match
    "nigger": PROFANITY_SEPARATORS + "*(?:er|a|az|ers)?",
    "bastard": "(?:s)?",
}
SHORT_STEMS = {"nigger": "nigg"}  # stems of which only the beginning is looked for

# --- fixed values: wiki marks, addresses, tokens ---------------------------------------------
MONTHS = [
    "January", "February", "March", "April", "May", "June", "July", "August", "September",
    "October", "November", "December",
]
IP_OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d{1,3})"
CAPS_TOKEN = "CAPSLOCKFLAG"
KEPT_LETTERS = "ñÑüÜ"
REPEATABLE_PUNCTUATION = "!?.,"

# --- fixed values: the default rule table ----------------------------------------------------
# "starts" is optional: the characters that a match of the pattern can begin with.
DEFAULT_RULES = [
    {
        "category": "Hate Speech and Slurs", "type": "lexicon", "boundary": True,
        "words": [
            "nigger", "nigga", "faggot", "fag", "spic", "chink", "kike", "tranny", "dyke",
            "wetback", "raghead", "retard", "halfbreed",
        ],
    },
    {
        "category": "Severe Profanity (NSFW)", "type": "lexicon", "boundary": True,
        "words": [
            "fuck", "motherfucker", "cunt", "cocksucker", "dickhead", "whore", "slut", "bitch",
            "pussy", "bullshit", "cum",
        ],
    },
    {
        "category": "Obfuscated Profanity", "type": "regex",
        "pattern": r"f[u\*\@\!]+ck|sh[i\*\@\!]+t|b[i\*\@\!]+tch",
        "starts": "fsb",
    },
    {
        "category": "PII Leak - US Social Security Number", "type": "regex",
        "pattern": r"\b(?!000|666)[0-8][0-9]{2}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}\b",
        "starts": "0-8",
    },
    {
        "category": "PII Leak - Credit Card (PCI-DSS)", "type": "regex",
        "pattern": r"\b(?:\d{4}[\s-]?){3}\d{4}\b",
        "starts": r"\d",
    },
]

# Two more lexicons, made of words that the test tables contain, so that every path of the rule
# operators sees hits on them.
DEMO_RULES = [
    {
        "category": "Personal Insult", "type": "lexicon", "boundary": True,
        "words": ["idiot", "moron", "clown", "loser", "stupid"],
    },
    {
        "category": "Demeaning Language", "type": "lexicon", "boundary": True,
        "words": ["trash", "scum", "worthless", "pathetic", "disgusting"],
    },
]

# --- fixed values: label audit policy --------------------------------------------------------
AUDIT_SINGLE_RULES = ["threatening_phrase", "violent_phrase"]
AUDIT_COMBINED_RULES = [["insult_phrase", "profanity"]]

# --- fixed values: thresholds ----------------------------------------------------------------
TRAINING_CUTOFF = 0.95
HYBRID_SAFE, HYBRID_TOXIC, HYBRID_SECOND = 0.30, 0.90, 0.80
SEMANTIC_TOXIC = 0.80
HARD_EXAMPLE_BAND = (0.40, 0.95)
DEPLOYED_CLASS_WEIGHTS = {0: 1.0, 1: 1.3}

# --- fixed values: class-score aliases -------------------------------------------------------
TOXIC_ALIASES = ["toxic", "label_1", "1"]
SAFE_ALIASES = ["non-toxic", "non_toxic", "clean", "neutral", "label_0", "0"]

# --- fixed values: texts in results ----------------------------------------------------------
DECIDED_BY_INPUT = "Input Validation"
DECIDED_BY_RULES = "Tier 1 (Rules)"
DECIDED_BY_MODEL = "Tier 2 (Semantic Engine)"
EMPTY_INPUT_ACTION = "Empty input; nothing to classify."

RUNTIME_ACTIONS = {
    "OK": "Message is within standards.",
    "FLAGGED": "Escalate to HR review.",
    "AMBIGUOUS": "Needs manual or Tier 3 review.",
}
SEMANTIC_ACTIONS = {
    "OK": "Descartar mensaje. Es seguro.",
    "FLAGGED": "Enviar a panel de RRHH. Violación de política.",
    "AMBIGUOUS": "Escalar al Tier 3 (LLM) para resolución de contexto profundo.",
}
CAUGHT_BY_RULES = "Tier 1 (Reglas)"
CAUGHT_BY_MODEL = "Tier 2 (Semántica)"
PASSED_BY_MODEL = "OK por Tier 2"

REASON_KEYS = ["reason_summary", "risk_type", "recommended_action"]
RISK_TYPES = ["insult", "harassment", "threat", "profanity", "pii", "neutral", "unclear"]
REASON_ACTIONS = ["allow", "review", "escalate"]
REASON_FALLBACK = {
    "reason_summary": "Tier 2 detected potentially unsafe language.",
    "risk_type": "unclear",
    "recommended_action": "review",
}

# --- fixed values: stop words (Spark's default English list, those that are one token of two or
# more letters after splitting at apostrophes; a test compares the two) ------------------------
STOP_WORDS = """
me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
hers herself it its itself they them their theirs themselves what which who whom this that these
those am is are was were be been being have has had having do does did doing an the and but if or
because as until while of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once here there when where
why how all any both each few more most other some such no nor not only own same so than too very
can will just don should now cannot could ought would
""".split()
