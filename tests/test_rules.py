import pytest
from pyspark.sql import functions as F

from sieveline.functions import rules as R
from sieveline.operators import joins as J
from sieveline.sources.rules import default_rules, load_rules, rules_table


@pytest.mark.parametrize(
    "message, category",
    [
        ("that is complete bullshit", "Severe Profanity (NSFW)"),
        ("you are a dyke", "Hate Speech and Slurs"),
        ("f@ck you", "Obfuscated Profanity"),
        ("my ssn is 123-45-6789", "PII Leak - US Social Security Number"),
        ("card 4111-1111-1111-1111", "PII Leak - Credit Card (PCI-DSS)"),
        ("the quarterly report looks fine", None),
        ("please review the attached document before friday", None),
        ("ssn 666-12-3456", None),
        ("ssn 000-12-3456 900-11-1111 123-00-1234 123-45-0000", None),
        ("écum et cumé", None),
        ("_cum_", None),
        (None, None),
    ],
)
def test_default_rules(column, message, category):
    (verdict,) = column(lambda c: R.tier1_inspect(c, default_rules()), [message])
    assert verdict["reason"] == category
    assert verdict["status"] == ("PASS" if category is None else "FLAGGED")


def test_leftmost_word_wins_over_rule_order(column):
    (verdict,) = column(lambda c: R.tier1_inspect(c, default_rules()), ["bitch and faggot 4111111111111111"])
    assert (verdict["reason"], verdict["trigger"]) == ("Severe Profanity (NSFW)", "bitch")
    (reason,) = column(lambda c: R.tier1_inspect_ruleorder(c, default_rules()), ["BITCH and Faggot"])
    assert reason == "Hate Speech and Slurs"


def test_mixed_boundaries_and_phrases(column):
    rules = R.make_rules(
        [
            {"category": "A", "type": "lexicon", "words": ["Shut", "c++"]},
            {"category": "B", "type": "lexicon", "words": ["shut up", "ass"], "boundary": False},
            {"category": "C", "type": "regex", "pattern": r"\bx\d+\b"},
        ]
    )
    out = column(lambda c: R.tier1_inspect(c, rules), ["shut up", "class", "ax12 x12", "nothing", "shutup"])
    assert [(v["reason"], v["trigger"]) for v in out] == [("A", "shut"), ("B", "ass"), ("C", "x12"), (None, None), (None, None)]
    both = R.make_rules(
        [{"category": "A", "type": "lexicon", "words": ["shut"]}, {"category": "B", "type": "lexicon", "words": ["shut up"]}]
    )
    (verdict,) = column(lambda c: R.tier1_inspect(c, both), ["shut up"])
    assert (verdict["reason"], verdict["trigger"]) == ("A", "shut")


def test_predict_and_term_hits(spark):
    df = spark.createDataFrame([(1, "Fuck this FUCK"), (2, None), (3, "whore, fuck!")], "id int, comment_text string")
    out = df.select("id", R.tier1_predict(F.lower("comment_text"), default_rules()).alias("v")).orderBy("id").collect()
    assert [tuple(r["v"]) for r in out] == [(1, "Severe Profanity (NSFW)"), (0, ""), (1, "Severe Profanity (NSFW)")]
    hits = {r["term"]: (r["hits"], r["messages"]) for r in J.lexicon_term_hits(df, default_rules()).collect()}
    assert hits == {"fuck": (3, 2), "whore": (1, 1)}


def test_rules_from_files(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text('{"rules": [{"category": "K", "type": "lexicon", "words": ["Ab", "abc"]}]}')
    (rule,) = load_rules(str(path))
    assert rule.words == ("ab", "abc")
    assert rules_table(spark, [rule]).first()["words"] == ["abc", "ab"]
    yaml = pytest.importorskip("yaml")
    (tmp_path / "rules.yaml").write_text(yaml.safe_dump({"rules": [{"category": "K", "type": "regex", "pattern": "a+"}]}))
    assert load_rules(str(tmp_path / "rules.yaml"))[0].pattern == "a+"
    with pytest.raises(ValueError):
        R.make_rules([{"category": "K", "type": "other"}])


def test_rules_from_any_store(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text('{"rules": [{"category": "A", "type": "regex", "pattern": "a+"}]}')
    assert load_rules(f"file://{path}", spark)[0].pattern == load_rules(str(path))[0].pattern
