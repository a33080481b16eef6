import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lexiforge.functions import patterns as P


def matches(pattern, word, **options):
    return re.fullmatch(P.compile_pattern(pattern, **options).body.replace(r"[^\x{0}-\x{10FFFF}]", "(?!)"), word, re.S) is not None


@pytest.mark.parametrize(
    "bare, bracketed",
    [
        # one, two and three of a placeholder, at the start, inside and at the end
        ("Ark", "[A]rk"), ("loAm", "lo[A]m"), ("dewAA", "dew[AA]"), ("TxTT", "[T]x[TT]"), ("oTTTo", "o[TTT]o"),
        # a longer run is taken three at a time, runs of both kinds apart
        ("AAAAA", "[AAA][AA]"), ("TTTTTT", "[TTT][TTT]"), ("TAT", "[T][A][T]"),
        # a bare negation takes the next sign, a placeholder whole
        ("gl^u", "gl[^u]"), ("^TTin", "[^TT]in"), ("x^^", "x[^^]"), ("end^", "end^"),
        # brackets and wildcards stay, an open bracket is a sign like others
        ("[T][bd]A", "[T][bd][A]"), ("[^A]*", "[^A]*"), ("mist[aT", "mist[a[T]"), ("wil.", "wil."), ("*ough", "*ough"), ("", ""),
    ],
)
def test_add_brackets(bare, bracketed):
    assert P.add_brackets(bare) == bracketed
    assert P.add_brackets(bracketed) == bracketed


@given(st.text("aAT^*.[]x", max_size=12))
def test_brackets_are_idempotent(pattern):
    once = P.add_brackets(pattern)
    assert P.add_brackets(once) == once


def test_matching():
    assert matches("dur*", "during") and not matches("dur*", "endure")
    assert matches("c.t", "cat") and not matches("c.t", "cart")
    assert matches("c[a-c]t", "cbt") and not matches("c[^a-c]t", "cbt")
    assert matches("TTout", "trout") and not matches("TTout", "about")
    assert matches("cAAn", "coin") and not matches("cAAn", "con")
    assert not matches("c[ab", "ca"), "an unclosed bracket matches nothing"
    assert matches("[^A]x", "ex") and not matches("[^A]x", "ax"), "by default only the letter is excluded"
    assert not matches("[^A]x", "ex", expand_negated=True)
    assert matches("A.B", "a.b", literal=True) and not matches("A.B", "axb", literal=True)


def test_special_characters_are_literal():
    assert matches("a+b", "a+b") and not matches("a+b", "aab")
    assert matches("[&[]x", "&x") and matches("[&[]x", "[x")


def test_like_and_star():
    assert P.like_pattern("50%*.") == "50\\%%_"
    assert P.like_pattern("50%*", legacy=True) == "50%%"
    assert re.match(P.star_regex("a.b*"), "a.bc") and not re.match(P.star_regex("a.b*"), "axbc")
    assert P.literal_runs("*r*el[A]x") == ["r", "el", "x"]
    assert P.has_wildcard("a*") and P.has_wildcard("[a]") and not P.has_wildcard("a[")
