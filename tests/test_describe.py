import pytest

from test_drift import pipeline, term_rows
from wordtide.operators import describe
from wordtide.plans.engine import Engine
from wordtide.plans.errors import ParseError, TermResolutionError


@pytest.fixture(scope="module")
def engine(spark):
    words = ["labour", "value", "wage", "wages", "rent", "xylem"]
    rows = pipeline(spark, [("gutenberg-1", "A", "T", 1776, "m")])
    return Engine(term_rows(spark, [("gutenberg-1", w, 3, ["N"], None, 0) for w in words]), rows)


def test_exact_and_alike(engine):
    assert engine.parse_describe("x", lambda m: "labour + (wage - rent)")["substitutions"] == []
    got = engine.parse_describe("x", lambda m: "labor - wage")
    assert got["expression"] == "labour - wage" and got["substitutions"] == [{"original": "labor", "resolved": "labour"}]


def test_ratio_is_that_of_difflib(engine):
    import difflib

    words = [r.term for r in engine.vocabulary().collect()]
    for word in ("labor", "wag", "rental", "zzz"):
        assert describe.alike(engine.vocabulary(), word, 20, 0.3) == difflib.get_close_matches(word, words, 20, 0.3)


def test_chooser_and_refusal(engine):
    assert describe.resolve("laqqqqqqr", engine.vocabulary(), lambda term, offered: " Labour ") == "labour"
    for chooser in (None, lambda term, offered: "nonsense"):
        with pytest.raises(TermResolutionError) as e:
            describe.resolve("laqqqqqqr", engine.vocabulary(), chooser)
    assert e.value.candidates and "Did you mean" in str(e.value)
    with pytest.raises(TermResolutionError) as e:
        describe.resolve("98765", engine.vocabulary())
    assert e.value.candidates == [] and str(e.value).endswith("No similar terms in vocabulary.")
    assert describe.candidates(engine.vocabulary(), "xqqqqqqqqqqqqqqqqqqqqqq") == ["xylem"]


def test_no_expression(engine):
    for answer in ("", "a b", "+"):
        with pytest.raises(ParseError):
            engine.parse_describe("x", lambda m, a=answer: a)
