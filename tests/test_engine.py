import os

import pytest
from pyspark.sql import functions as F

from lexiforge import runtime
from lexiforge.engine import Engine
from lexiforge.streaming import events

DATA = os.environ.get("LEXIFORGE_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, DATA)


def test_searches(engine):
    assert engine.lookup("The").first().word.lower() == "the" and engine.lookup("qqqq").count() == 0
    assert {r["query"] for r in engine.lookup(["the", "qqqq"]).collect()} == {"the"}
    assert all(r.word.startswith("re") for r in engine.pattern_search("re*").collect())
    assert engine.suggest("re", 3).count() == 3 and engine.rank(["the", "qqqq"]).where("frequency is null").count() == 1
    assert engine.page("*e*", 2).count() == 10 and engine.page("*e*", 99).first().page == 5


def test_requests(engine):
    word = engine.entries().orderBy(F.desc(F.length("word")), "word").first().word
    got = engine.request(word.upper()).collect()
    parts = [r for r in got if r.kind == "part"]
    assert [r.kind for r in got].count("entry") == 1 and [r.n for r in parts] == list(range(1, len(parts) + 1))
    assert got[0].text.startswith("<div") and all("stem" in r.shown for r in got if r.kind == "related")
    assert {r.kind for r in engine.request("*e*").collect()} == {"hit"} and {r.kind for r in engine.request("Qua").collect()} <= {"suggestion"}
    assert engine.request("a.b", literal=True).where("kind = 'hit'").count() == 0


def test_words(engine):
    cuts = engine.segment(["Incredible", "", " x "]).collect()
    assert {r.word for r in cuts} == {"incredible", "x"} and all("".join(p.text for p in r.parts) for r in cuts)
    assert engine.analyze_affixes(["incredible"]).count() == 1 and engine.related_words("or", max_results=5).count() <= 5
    for build in ("segment_frequencies", "affix_table", "merged_roots", "small_dictionary", "confirmed_affixes"):
        assert getattr(engine, f"build_{build}")().count() > 0


def test_appended_batches_all_stay(spark, tmp_path):
    src = str(tmp_path / "in")
    for i in range(3):
        spark.createDataFrame([(i, f"r{i}")], "n int, s string").write.mode("append").parquet(src)
    stream = spark.readStream.schema("n int, s string").option("maxFilesPerTrigger", 1).parquet(src)
    assert sorted(r.n for r in events.run_once(stream, "append").collect()) == [0, 1, 2]


def test_a_cluster_must_name_its_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:  # noqa: N801
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError):
        runtime.shared_dir(Session())
