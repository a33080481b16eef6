import pytest

from lexiforge.operators.packed_fields import CLOSE, MARKED, OPEN, SENSES, split_packed


def items(spark, text, dialect):
    df = spark.createDataFrame([(1, text, "clash", "clash")], "id bigint, t string, item string, row_id string")
    rows = split_packed(df, "id", "t", dialect).orderBy("item_no").collect()
    assert [r.item_no for r in rows] == list(range(1, len(rows) + 1))
    return [r.item for r in rows]


@pytest.mark.parametrize(
    "text, want",
    [
        ("-al -en", ["-al", "-en"]), ("-al-ur*ic", ["-al", "-ur", "*ic"]), ("'-id', '-ic'", ["-id", "-ic"]), ('"-at" "=al"', ["-at", "=al"]),
        ('["huisplai", "-ium (L, late)", "-ed"]', ["huisplai", "-ium (L, late)", "-ed"]), ("base, -am (L, A) ; =x", ["base", "-am (L, A)", "=x"]),
        ("•base；-ic", ["base", "-ic"]), ("a ,, *ed,", ["a", "*ed"]), ("a\t-b|c / d", ["a", "-b", "c", "d"]), ("jolcroct =id plex", ["jolcroct", "=id", "plex"]),
        (None, []), ("", []), (" 　 ", []), ("-a -a", ["-a", "-a"]),
    ],
)
def test_marked(spark, text, want):
    assert items(spark, text, MARKED) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ('"so-called ""first"" sense";road', ['so-called "first" sense', "road"]), ("“a, b”、heavy; to rope", ["a, b", "heavy", "to rope"]),
        ("old (of vowels, sails)", ["old (of vowels, sails)"]), ("x　(a, b)；y", ["x　(a, b)", "y"]), ("; rock in trade", ["rock in trade"]),
        ("a\nb\tc", ["a", "b", "c"]), ("「a, b」/c", ["a, b", "c"]), ("heart • stone", ["heart", "stone"]), ('an "open quote, b', ['an "open quote', "b"]),
        ("nobody's, it's", ["nobody's", "it's"]), ("f (a (b, c), d), e", ["f (a (b, c), d)", "e"]), (f"{OPEN}0{CLOSE}, \"a,b\"", [f"{OPEN}0{CLOSE}", "a,b"]),
    ],
)
def test_senses(spark, text, want):
    assert items(spark, text, SENSES) == want


def test_long_text_and_least(spark):
    many = ";".join(f'"a,{i}"' for i in range(20_000))
    assert len(items(spark, many, SENSES)) == 20_000
    assert len(items(spark, '"' + "x,\"\"" * 5_000 + '"', SENSES)) == 1
    df = spark.createDataFrame([(1, "a"), (2, "a;b"), (None, "c;d")], "id bigint, t string")
    assert sorted(r.item for r in split_packed(df, "id", "t", SENSES, least=2).collect()) == ["a", "b", "c", "d"]
    assert split_packed(df.limit(0), "id", "t", SENSES).count() == 0
