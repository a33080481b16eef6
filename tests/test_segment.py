from hypothesis import given, settings
from hypothesis import strategies as st

from lexiforge.operators import segment as S


def hit(form, start, src="dict", opt=False, pos=(), freq=None):
    return {"form": form, "start": start, "interps": [{"pos": list(pos), "opt": opt, "src": src, "k": 0}], "freq": freq, "merged": None, "kinds": None}


def hits(word, forms, **kw):
    return [hit(f, i, **kw) for f in forms for i in range(len(word)) if word.startswith(f, i)]


def texts(word, forms, stage1=None, **kw):
    return [p["text"] for p in S.segment_word(word, stage1, hits(word, forms, **kw))["parts"]]


def test_one_syllable_is_whole():
    assert S.segment_word("strength", None, hits("strength", ["str"]))["parts"] == [{"text": "strength", "source": "", "form": None, "k": None}]


def test_forms_cover_as_much_as_possible():
    assert texts("telegraph", ["tele", "graph", "gra"]) == ["tele", "graph"]
    assert texts("xxtelexx", ["tele"]) == ["xx", "tele", "xx"]


def test_positions_limit():
    assert texts("oportele", ["tele"], pos=("prefix",)) == ["oportele"], "a pure prefix may not end the word"
    assert texts("teleopor", ["tele"], pos=("prefix",)) == ["tele", "opor"]


def test_vowel_is_absorbed_and_elided():
    assert texts("telegraphi", ["tele", "graph"]) == ["tele", "graphi"]
    assert texts("therapin", ["thera", "apin"]) == ["thera", "apin"], "both forms show the shared vowel"


def test_stage1_is_kept_apart():
    got = S.segment_word("ulobatel", ["ulo", "batel"], hits("ulobatel", ["batel", "oba"]))
    assert got["stage1"] == "ulo.batel" and [p["text"] for p in got["parts"]] == ["ulo", "batel"]


def test_pieces():
    assert S.pieces("abcdef", ["bc", "cd"]) == [(0, 1), (1, 4), (4, 6)]
    assert S.pieces("abcdef", ["ab", "cd"]) == [(0, 2), (2, 4), (4, 6)]
    assert S.pieces("abc", ["zz"]) == [(0, 3)]


@settings(max_examples=150, deadline=None)
@given(st.text("abeiort", min_size=3, max_size=12), st.lists(st.text("abeiort", min_size=2, max_size=4), max_size=6))
def test_parts_spell_the_word(word, forms):
    usable = {}
    for h in hits(word, set(forms)):
        usable.setdefault(h["start"], []).append((len(h["form"]), (h["form"], False, "dict", "m", ""), 0.0))
    for u in usable.values():
        u.sort()
    at = 0
    for s, e, _ in S.best_path(word, 0, len(word), usable):
        assert s in (at, at - 1) and e > s
        at = e
    assert at == len(word)


def test_other_segmenters():
    found = hits("telegraph", ["tele", "gr", "graph"])
    assert S.greedy("telegraph", found) == ["tele", "graph"]
    assert S.greedy("xgraph", hits("xgraph", ["gr", "aph"])) == ["[xgr]", "aph"], "two letters only after a match"
    assert S.cut_by_scores("telegraph", [0, 0, 0, 0.5, 0, 0, 0, 0]) == ["tele", "graph"]
    assert S.cut_by_scores("a1", [0.9]) == ["a1"] and S.cut_by_scores("", []) == [""]
    parts, score = S.affix_layers("ungraphable", {"un"}, {"able"}, ["graph"])
    assert [t for _, t in parts] == ["un", "graph", "able"] and round(score, 2) == 9.3
    assert S.affix_layers("qqq", set(), set(), []) == ([("stem", "qqq")], -5.0)
    assert S.two_strategies("ungraphable", {"un"}, {"able"}, ["graph"])[1] == ["un", "graph", "able"]


def test_bonus():
    assert S.bonus(3, None, False) == 0.5 and S.bonus(None, 9, False) == 0.0 and S.bonus(1, 3, True) == -0.25
