"""Learned models on small rows, token ids against the vocabulary file, and the groups of the Jaccard join."""

import zlib

import numpy as np
import pytest

pytest.importorskip("graphloom.llm")

from graphloom.llm import languages, near, packing, queries, toxicity  # noqa: E402


def test_language(spark):
    words = {"aa": ["bala", "mola", "tara", "lomo"], "bb": ["schtik", "wrunz", "krelt", "pfing"]}
    text = lambda k, i: " ".join(words[k][(i * j + j) % 4] for j in range(3, 30))
    train = spark.createDataFrame([(text(k, i), k) for k in words for i in range(30)] + [(None, "aa"), ("bala", None)], "text string, lang string")
    model = languages.learned(train)
    rows = [(1, text("aa", 31), "x"), (2, text("bb", 33), "x"), (3, None, "x"), (4, "12 ... !", "x"), (5, "", "x"), (None, text("aa", 31), "x")]
    got = {r["doc_id"]: r for r in languages.identified(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), model, keep=["doc_id"]).collect()}
    assert {k: r["lang_pred"] for k, r in got.items()} == {1: "aa", 2: "bb", 3: "und", 4: "und", 5: "und", None: "aa"}
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[3]["rejected"] and not got[1]["rejected"]


def test_toxicity_learns_stems(spark):
    rows = [(f"plain words number {i} are here and go on", 0) for i in range(40)] + [(f"some words then zorbak{i % 3} again {i} here", 1) for i in range(20)]
    model = toxicity.learned(spark.createDataFrame(rows, "text string, toxic int"))
    new = spark.createDataFrame([(1, "other words then zorbak9 today"), (2, "other words today"), (3, None), (4, "")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(new, model).collect()}
    assert got[1] >= 0.5 > got[2] and got[3] == got[4] and all(0 <= x <= 1 for x in got.values())


def test_token_ids_are_those_of_the_file(spark):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(queries._vocabulary()["json_path"])
    exact.encode_special_tokens = True
    texts = [None, "", "Hello  world\n\n it's 12345 <|endoftext|> é", "日本語 текст \U0001f600", " a\t b" * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = packing.packed(docs, **queries._vocabulary()).collect()
    ids = [np.array([*exact.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for t in texts]
    for r in rows:
        x = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(x)
        assert r["ids_crc32"] == zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes())


def test_groups_of_a_chain(spark):
    base = [f"w{i}" for i in range(100)]
    chain = []
    for step in range(6):
        base[step * 15] = f"new{step}"
        chain.append(" ".join(base))
    docs = spark.createDataFrame([(10 - i, t) for i, t in enumerate(chain)] + [(99, "all else is here and nothing more")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in near.joined(docs, block=2).collect()}
    sets = {10 - i: {tuple(t.split()[k : k + 5]) for k in range(96)} for i, t in enumerate(chain)}
    for i, s in sets.items():
        assert got[i]["n_links"] == sum(o != s and len(o & s) >= 0.8 * len(o | s) for o in sets.values())
        assert got[i]["class_id"] == 5
    assert got[99]["class_id"] == 99 and got[99]["n_links"] == 0


def test_links_over_many_partitions(spark):
    texts = {i: [f"g{i // 3}w{k}" for k in range(60)] for i in range(90)}
    for i, w in texts.items():
        w[0], w[-1] = f"first{i % 3}", "last" if i % 3 else "end"
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id bigint, text string")
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = {r["doc_id"]: r for r in near.joined(docs).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    sets = {i: {tuple(w[k : k + 5]) for k in range(56)} for i, w in texts.items()}
    for i, s in sets.items():
        near_ones = [j for j, o in sets.items() if j != i and len(o & s) >= 0.8 * len(o | s)]
        assert len(near_ones) == 2 and got[i]["n_links"] == 2 and got[i]["class_id"] == min([i, *near_ones])


def test_every_gram_is_in_the_model(spark):
    letters = np.random.default_rng(7).integers(97, 123, 450_000).astype(np.uint8)
    rare = letters.tobytes().decode()
    train = spark.createDataFrame([(rare, "rare")] + [("mola tara lomo bala", "small")] * 20, "text string, lang string")
    model = languages.learned(train, shard_grams=30_000)
    assert model.languages == ["rare", "small"] and len(model.shards) > languages.MIN_SHARDS
    grams = {("    " + t)[i : i + 5] for t in (rare, "mola tara lomo bala") for i in range(len(t))}
    assert len(grams) > 400_000 and sum(len(model.shard(i)[languages.ORDER].grams.keys) for i in range(len(model.shards)) if model.shards[i]) == len(grams)


def test_shards_of_tasks_are_those_of_memory(spark):
    rng = np.random.default_rng(9)
    texts = {k: ["".join(rng.choice(list(letters), 80)) for _ in range(40)] for k, letters in {"aa": "abc é", "bb": "bcd д", "cc": "xyz "}.items()}
    train = spark.createDataFrame([(t, k) for k, ts in texts.items() for t in ts], "text string, lang string")
    counts = {}
    for k, ts in texts.items():
        raw = [t.encode() for t in ts]
        s, starts, _ = languages.symbols(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        windows = [s[i : i + languages.ORDER] for lo, hi in zip(starts[:-1], starts[1:], strict=True) for i in range(lo, hi - languages.ORDER + 1)]
        counts[k] = np.unique(np.array(windows), axis=0, return_counts=True)
    whole = languages.fitted(sorted(texts), [counts[k][0] for k in sorted(texts)], [counts[k][1] for k in sorted(texts)])
    model = languages.learned(train, shard_grams=100)
    new = [t.encode() for t in ("abc é bd", "дbcd", "xyz zyx", "qqq", "", texts["aa"][3] * 20)]
    s, starts, _ = languages.symbols(np.frombuffer(b"".join(new), np.uint8), np.cumsum([0, *map(len, new)]))
    assert len(model.shards) > 8 and np.allclose(model.entropy(s, starts)[0], whole.entropy(s, starts)[0], rtol=1e-5)
