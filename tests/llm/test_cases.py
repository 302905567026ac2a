"""Every operator and stage on nulls, empty and very long texts, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

pytest.importorskip("graphloom.llm")

from graphloom.llm import chat, decontamination, languages, licenses, near, packing, quality, queries, secrets, toxicity, transport  # noqa: E402

KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = ["id", "t", "key", "n", "k1", "row", "found", "spans", "items", "score", "lang_pred", "rejected", "rep", "node", "kept", "x", "h", "root", "#spans", "class_id", "stays"]
LONG = " ".join(f"long word number {i} of a very long text, you see." for i in range(12_000))
ROWS = [
    (1, None, "en", "s1"), (2, "", "en", "s1"), (3, "... !!", None, None), (4, "a plain text of some words that stands here for all to read", "en", "s2"),
    (5, "a plain text of some words that stands here for all to read", "en", "s3"), (5, "another text under the same id with token = abcdefgh12", "en", "s3"),
    (None, "a text without an id and with words enough to be read", None, "s1"), (None, "a text without an id and with words enough to be read", None, "s1"),
    (4, "a plain text of some words that stands here for all to read", "en", "s2"), (7, LONG, "en", "s4"), (8, "MIT license \U0001f600 é", "fr", None),
]
ITEMS = [(1, "words enough to be read"), (2, None), (3, ""), (3, "long word number 77 of a very long text, you see. long word number 78")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in ROWS], KIND).repartition(3)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id bigint, text string")


def operators(spark, items):
    plain = spark.createDataFrame([(f"plain words {i}", i % 2) for i in range(40)], "text string, toxic int")
    toxic = toxicity.learned(plain)
    good = quality.learned(plain)
    lang = languages.learned(spark.createDataFrame([("some words of a language that is known", "en"), ("des mots de la langue que voici", "fr")] * 15, "text string, lang string"))
    return {
        "toxicity": lambda d: toxicity.scored(d, toxic),
        "quality": lambda d: quality.scored(d, good),
        "near": lambda d: near.joined(d).drop("root"),
        "deduplicated": lambda d: near.deduplicated(d),
        "overlaps": lambda d: decontamination.overlaps(d, items),
        "overlaps_sharded": lambda d: decontamination.overlaps(d, items, shard_bytes=30),
        "decontaminated": lambda d: decontamination.decontaminated(d, items),
        "decontaminated_sharded": lambda d: decontamination.decontaminated(d, items, shard_bytes=30),
        "packed": lambda d: packing.packed(d, **queries._vocabulary()).drop("sequence_id", "offset", "start", "length", "ids_crc32").distinct(),
        "identified": lambda d: languages.identified(d, lang, keep=["doc_id"]),
        "identified_all": lambda d: languages.identified(d, lang),
        "scanned": lambda d: secrets.scanned(d),
        "redacted": lambda d: secrets.redacted(d),
        "stored": lambda d: transport.stored(d),
        "licenses": lambda d: licenses.scanned(d),
    }


@pytest.fixture(scope="module")
def every(spark, items):
    return operators(spark, items)


NAMES = ["toxicity", "quality", "near", "deduplicated", "overlaps", "overlaps_sharded", "decontaminated", "decontaminated_sharded", "packed", "identified", "identified_all", "scanned", "redacted", "stored", "licenses"]
#: These keep all columns.
WHOLE = {"deduplicated", "decontaminated", "decontaminated_sharded", "redacted", "identified_all"}


def rows(df, columns):
    return sorted((repr(tuple(r[c] for c in columns)) for r in df.collect()))


@pytest.mark.parametrize("name", NAMES)
def test_clashing_columns_change_nothing(docs, every, name):
    plain = every[name](docs)
    want = rows(plain, plain.columns)
    # The long text is little else than an item's windows.
    assert name == "packed" or len(want) == {"deduplicated": 8, "decontaminated": 10, "decontaminated_sharded": 10}.get(name, len(ROWS))
    taken = set(plain.columns) if name not in WHOLE else set()
    clash = docs.select("*", *(F.lit("clash").alias(c) for c in CLASH if c not in languages.RESULTS or name != "identified_all"))
    got = every[name](clash)
    assert rows(got, plain.columns) == want
    if name in WHOLE - {"identified_all"}:
        assert got.columns == clash.columns and all(r["key"] == r["#spans"] == "clash" for r in got.select("key", "#spans").collect())
    else:
        assert taken <= set(got.columns)


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, every, name):
    got = every[name](spark.createDataFrame([], KIND))
    assert got.count() == 0


@pytest.mark.parametrize("name", ["toxicity", "quality", "identified", "scanned", "stored", "licenses", "overlaps"])
def test_equal_texts_have_equal_rows(docs, every, name):
    found = {}
    out = every[name](docs)
    for r in out.collect():
        if r["doc_id"] in (None, 4):
            found.setdefault(r["doc_id"], set()).add(repr(tuple(r)))
    assert all(len(x) == 1 for x in found.values()) and len(found) == 2


def test_models_of_nothing(spark):
    none = spark.createDataFrame([], KIND + ", toxic int")
    some = spark.createDataFrame([(1, "text", "en", "s", 4), (2, None, None, None, 0)], KIND)
    assert {r["score"] for r in quality.scored(some, quality.learned(none)).collect()} <= {0.0, 0.5}
    assert all(0 <= r["score"] <= 1 for r in toxicity.scored(some, toxicity.learned(none)).collect())
    assert {r["lang_pred"] for r in languages.identified(some, languages.learned(none)).collect()} == {"und"}
    assert decontamination.overlaps(some, spark.createDataFrame([], "item_id bigint, text string")).where("n_hit > 0").count() == 0


def test_repeated_and_null_ids_stay_apart(spark):
    line = "these are the words of a first text that is long enough to count"
    other = "quite another row of words which shares nothing at all with it"
    rows = [(1, line), (1, other), (2, line), (2, line), (None, other + " x"), (None, "one more text under no id that stands on its own"), (None, "one more text under no id that stands on its own"), (3, None), (3, None), (4, "!!")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = sorted(map(tuple, near.deduplicated(d).collect()), key=repr)
    assert kept == sorted([(1, line), (1, other), (None, "one more text under no id that stands on its own"), (3, None), (3, None), (4, "!!")], key=repr)


def test_chat_clash(spark):
    d = spark.createDataFrame([(1, 0, "assistant", '{"tool_calls":[{"id":"a","name":"fetch","arguments":{"url":"u"}}]}'), (1, 1, "tool", '{"tool_call_id":"a"}'), (1, None, None, None)], "conv_id bigint, turn bigint, role string, text string")
    more = d.select("*", *(F.lit(1).alias(c) for c in ("o", "key", "calls", "call_id", "c2", "t", "i", "own", "listed")))
    assert sorted(map(repr, chat.linked(more).collect())) == sorted(map(repr, chat.linked(d).collect()))
