"""A language model's files: read in the shared folder where that is mounted, else fetched. Memory that tasks give back."""

import os
import weakref

import pytest

pytest.importorskip("graphloom.llm")

from graphloom.llm import common, languages, queries  # noqa: E402


@pytest.fixture(scope="module")
def docs(spark):
    words = {"aa": ("abba baca", "daba cab"), "bb": ("fuzu gogu", "hugo zuf")}
    rows = [(i, " ".join(words["bb" if i % 2 else "aa"][i // 2 % 2] for _ in range(2 + i % 5)), "bb" if i % 2 else "aa") for i in range(300)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)


def added(spark):
    return spark.sparkContext._jsc.sc().listFiles().size()


def test_language_stage_leaves_no_copies_with_the_executors(spark, docs):
    before = added(spark)
    kept = queries.language_stage(spark, docs, "").count()
    assert kept == 300 and added(spark) == before


def test_models_of_any_store_judge_alike(spark, docs, monkeypatch, tmp_path):
    def judged():
        model = languages.learned(docs.select("text", "lang"))
        return model, sorted(languages.identified(docs, model, keep=["doc_id"]).collect())

    mounted, want = judged()
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.elsewhere.link./there", f"file://{tmp_path}")
    monkeypatch.setattr(common, "shared_folder", lambda _: "viewfs://elsewhere/there")
    before = added(spark)
    far, got = judged()
    assert got == want and {r["lang_pred"] for r in got} == {"aa", "bb"}
    names = [x for x in far.shards if x]
    assert added(spark) == before + len(names) and sorted(names) == sorted(x for x in os.listdir(tmp_path) if x[0] != ".")
    assert all(os.path.isfile(x) for x in mounted.shards if x)


def test_memory_is_given_back_after_what_a_task_held_is_gone(monkeypatch):
    class Held:
        pass

    seen, left = [], []

    def task(batches):
        held = Held()
        left.append(weakref.ref(held))
        yield from batches

    monkeypatch.setattr(common, "trim", lambda: seen.append(left[0]() is None))
    assert list(common.trimming(task)(iter([1, 2]))) == [1, 2] and seen == [True]
