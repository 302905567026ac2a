"""The border of rejection comes from all training rows."""

import numpy as np
import pytest

pytest.importorskip("graphloom.llm")

from graphloom.llm import languages, queries  # noqa: E402

ROWS = 12_000


@pytest.fixture(scope="module")
def docs(spark):
    # One text in a hundred is of rare letters, so that a part of the rows has other quantiles.
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abcde " if i % 100 else "vwxyz "), 8 + i % 40)) for i in range(ROWS)]
    return spark.createDataFrame([(i, t, "aa" if i % 2 else "bb") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string").repartition(4)


def usual(got):
    e, m = got.column("entropy").to_numpy(), got.column("n_symbols").to_numpy()
    mean = float(np.median(e))
    x, y = 1 / np.maximum(m, 1), np.minimum((e - mean) ** 2, np.quantile((e - mean) ** 2, 0.99))
    within = max(1.0, ((x * y).mean() - x.mean() * y.mean()) / x.var())
    between = max(1e-4, np.median((e - mean) ** 2))
    return mean, between, within, max(6.0, 1.5 * np.quantile((e - mean) / np.sqrt(between + within * x), 0.999))


def test_border_of_all_rows(spark, docs, monkeypatch):
    monkeypatch.setattr(languages, "RANKED", 50, raising=False)
    monkeypatch.setattr(languages, "RANGES", 16, raising=False)
    model = languages.learned(docs.select("text", "lang"))
    got = languages.identified(docs, model, keep=[]).where("lang_pred != 'und'").select("entropy", "n_symbols").toArrow()
    assert got.num_rows > 11_900 and np.allclose(model.usual, usual(got), rtol=1e-9)


def test_language_stage_judges_by_all_training_rows(spark, docs, monkeypatch):
    models, judged = [], languages.judged
    monkeypatch.setattr(languages, "judged", lambda d, model, *a: models.append(model) or judged(d, model, *a))
    queries.language_stage(spark, docs, "")
    train = docs.where(queries.remainder("doc_id", 3) != 1)
    got = languages.identified(train, models[-1], keep=[]).where("lang_pred != 'und'").select("entropy", "n_symbols").toArrow()
    assert np.allclose(models[-1].usual, usual(got), rtol=1e-9)


def test_language_stage_learns_all_rows_and_judges_by_the_others(spark):
    rng = np.random.default_rng(4)
    letters = {"aa": "abcde ", "bb": "fghij ", "cc": "klmno "}
    rows = [(i, "".join(rng.choice(list(letters["bb" if i % 2 else "aa"]), 60)), "bb" if i % 2 else "aa") for i in range(1500)]
    # A word of rare letters, over and over: strange to every other row.
    odd = [(i, (" " + "".join(rng.choice([chr(c) for c in range(0x400, 0x4FF) if chr(c).isalpha()], 5, False))) * 12, "aa") for i in range(2000, 2030)]
    # A language whose labelled rows are all of one fold, and rows of it without a label.
    fold = {r["id"]: r["f"] for r in spark.range(3000, 4500).select("id", queries.remainder("id", 3).alias("f")).collect()}
    third = [(i, "".join(rng.choice(list(letters["cc"]), 60)), "cc" if f == 1 else None) for i, f in fold.items() if f == 1 or i % 50 == 0]
    docs = spark.createDataFrame(rows + odd + third, "doc_id bigint, text string, lang string").repartition(4)
    kept = {r["doc_id"] for r in queries.language_stage(spark, docs, "").collect()}
    assert {i for i, _, _ in rows} <= kept and not kept & {i for i, _, _ in odd}
    assert {i for i, _, x in third if x is None} <= kept
