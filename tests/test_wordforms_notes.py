import pytest

from lexiforge.operators import notes, wordforms

# Cases stated for the cleaning of notes: word, note, split, related words.
CASES = [
    ("respectively", "re.spec.tive.ly re.spec.tive adj. 对应的；分别的 re.spect v.n. 尊重 successive adj. 连续的，依次的", "re.spec.tive.ly", ["re.spec.tive", "re.spect", "spect", "successive"]),
    ("extradition", "ex+tradition 传统：送中不是传统", "ex.tradition", []),
    ("coral", "coral [ˈkɔrəl] 珊瑚 corral [ kəˈrɑːl] 牲口栏 carol [ˈkærəl] 圣诞颂歌", "", ["corral", "carol"]),
    ("flex", "联想：花线是软的，相对硬线可以屈伸 flex re.flex 本能反应", "", ["re.flex"]),
    ("authoritarian", "author作家i.tar.ian authority honorarium （给专业人士的）酬金", "author.i.tar.ian", ["authority", "honorarium"]),
    ("chilly", "chi.lly. chi.lli 辣椒", "chi.lly", ["chi.lli"]),
    ("sovereignty", "sover.eign.ty sover -> (vulgar latin) super sovereign 形容词", "sover.eign.ty", ["sover", "super", "sovereign"]),
    ("tyrant", "autocrat 只强调独裁，没说残暴", "", ["autocrat"]),
    ("propaganda", "好多a propagate v.宣传。增殖", "", ["propagate"]),
    ("ardent", "ardour 激情 热情 arduous 艰难的（需要大量努力的）（尤其是需要长时间的）", "", ["ardour", "arduous"]),
]


@pytest.mark.parametrize("word, note, split, related", CASES)
def test_notes(word, note, split, related):
    got, rest = notes.split_of(note, word)
    assert got == split
    found = notes.related_words(rest, word)
    assert [f for f in found if f != word] == related


def test_notes_in_spark(spark):
    raw = spark.createDataFrame([(1, "chilly\x1f\x1f\x1fchi.lly. <b>chi.lli</b> 辣椒"), (2, "short\x1fx"), (3, None)], "id bigint, flds string")
    rows = notes.clean_notes(notes.read_notes(raw)).collect()
    assert [(r.id, r.segmentation, r.related) for r in rows] == [(1, "chi.lly", ["chi.lli"])]


def test_related_words_of_the_whole_note(spark):
    raw = spark.createDataFrame([(1, "extradition\x1f\x1f\x1fsee de.fect for x; ex.tra.dition rest")], "id bigint, flds string")
    got = notes.clean_notes(notes.read_notes(raw)).first()
    assert got.segmentation == "ex.tra.dition" and got.related == ["de.fect", "fect", "rest"]


def test_edit_difference_is_a_shortest_edit():
    rng = __import__("random").Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 7))) for _ in range(2))
        d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j - 1] + (a[i - 1] != b[j - 1]), d[i - 1][j] + 1, d[i][j - 1] + 1)
        letters = wordforms.edit_difference(a, b)
        assert d[-1][-1] <= len(letters) <= 2 * d[-1][-1]
    assert wordforms.edit_difference("abcd", "axce") == ["d", "e", "b", "x"] and wordforms.edit_difference("", "ab") == ["b", "a"]


def test_combos():
    found = wordforms.compile_combos(["^ing$", "(", "", "AT"])
    assert len(found) == 2 and wordforms.score("plan", "planning", set(), found) == 1 and wordforms.score("situ", "situation", set(), found) == 0


def test_differences():
    assert wordforms.difference("situ", "situation") == ["ation"]
    assert wordforms.difference("situation", "situ") == ["ation"]
    assert wordforms.difference("abc", "axc") == ["b", "x"]
    assert wordforms.difference("abc", "abc") == []
    assert wordforms.score("plan", "planning", {"ning"}) == 0 and wordforms.score("plan", "plan", set()) == 0
    assert wordforms.score("plan", "explanation", {"ex"}) == 1


def test_tiles_lose_nothing():
    for text in ("undistable", "able", "xable", "", "unun"):
        for end in (False, True):
            assert "".join(b for b, _ in wordforms.tile(text, {"un", "dis", "able"}, end)) == text


def test_highlight():
    mark = '<span class="stem-highlight">{}</span>'.format
    assert wordforms.highlight("fort", "comfortable", {"com"}, {"able"}) == f"com.{mark('fort')}.able"
    assert wordforms.highlight("situ", "situational", set(), {"al"}) == f"{mark('situ')}ational"
    assert wordforms.highlight("zz", "comfort", set(), set()) == "comfort"
