"""Operators and pipeline stages against slow, plain versions on a small table, and damaged media."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("graphloom.llm")

import corpus_pipeline  # noqa: E402
from graphloom.llm import decontamination, languages, licenses, near, packing, quality, queries, secrets, toxicity, transport  # noqa: E402
from graphloom.llm.common import table  # noqa: E402

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return [m for m in WORD.finditer((t or "").translate(LOWER))]


def flat(data):
    return np.frombuffer(data.encode(), np.uint8), np.array([0, len(data.encode())])


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


# Near copies


def shingles(t):
    w = [m.group() for m in words(t)]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def grouped(rows):
    """Group number of each row by all pairs of sets; rows: (id, text)."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= 0.8 * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(rows))], sets


def mutated(seed):
    rng = random.Random(seed)
    out = []
    for g in range(12):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.choice([4, 30, 120]))]
        for _ in range(rng.randrange(1, 7)):
            w = list(base)
            for _ in range(rng.randrange(0, 5)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
            out.append((len(out), " ".join(w)))
    return out


@pytest.mark.parametrize("block", [3, 384])
def test_near_copies(spark, docs, block):
    for rows in (mutated(11), [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]):
        roots, sets = grouped(rows)
        got = {r["doc_id"]: r for r in near.joined(spark.createDataFrame(rows, "doc_id bigint, text string"), block=block).collect()}
        by_root, kinds = defaultdict(list), set(filter(None, sets))
        for (i, _), r in zip(rows, roots, strict=True):
            by_root[r].append(i)
        for (i, _), r, s in zip(rows, roots, sets, strict=True):
            assert got[i]["class_id"] == min(by_root[r])
            assert got[i]["n_links"] == sum(s != o and len(s & o) >= 0.8 * len(s | o) for o in kinds) if s else got[i]["n_links"] == 0
        if block == 384:
            kept = {r["doc_id"] for r in near.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
            assert kept == {min(x) for x in by_root.values()}


# Decontamination


def test_stage_cuts_what_brute_force_hits(spark, docs):
    items = table(spark, SF, "benchmark")
    windows = set()
    for r in items.collect():
        w = tuple(m.group() for m in words(r["text"]))
        windows |= {w[i : i + 10] for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(x) for x in windows}
    want = {}
    for r in docs.collect():
        ms = words(r["text"])
        w = [m.group() for m in ms]
        hit = set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
        if len(hit) > 0.8 * len(w):
            continue
        parts, last = [], 0
        for i in sorted(hit):
            if i - 1 not in hit:
                parts.append(r["text"][last : ms[i].start()])
            last = ms[i].end()
        want[r["doc_id"]] = "\n".join([*parts, r["text"][last:]]) if hit else r["text"]
    for shard_bytes in (decontamination.SHARD_BYTES, 3000):
        got = {r["doc_id"]: r for r in decontamination.decontaminated(docs, items, shard_bytes=shard_bytes).collect()}
        assert {k: r["text"] for k, r in got.items()} == want
        assert all(r["n_chars"] == len(r["text"]) for k, r in got.items())
    assert 0 < sum(want.get(r["doc_id"]) != r["text"] for r in docs.collect()) < 50


# Secrets


def found_secrets(t):
    out = []
    for k, (_, pattern, group, least) in enumerate(secrets.BASE + secrets.ADDED):
        out += [(m.start(), k, m.end(), m[group]) for m in re.finditer(pattern, t or "") if len(m[group]) >= least]
    return sorted(out)


def test_owner_counts_and_masks(spark):
    rng = random.Random(4)
    shared = [f"token = shared{i}secret" for i in range(6)] + ["AKIA" + "QX7" * 6, "f0" * 14, "Bearer abcdefghijklmnopqrst", "abcdefabcdefabcdefabcdefapi_key=deadbeefdeadbeefdeadbeef"]
    rows = []
    for i in range(400):
        text = " é ".join(rng.choice([*shared[: rng.randrange(1, 11)], f"password: own{i}value", "words only"]) for _ in range(rng.randrange(0, 6)))
        rows.append((i, rng.choice([text, text, None if i % 50 == 0 else text]), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "d", None]) if i % 3 else "a"))
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(4)
    repo = F.concat_ws("/", "source", "lang")
    owners, repos = defaultdict(set), defaultdict(set)
    for _, t, lang, source in rows:
        for *_, s in found_secrets(t):
            owners[s].add(source)
            repos[s].add("/".join(x for x in (source, lang) if x is not None))
    got = {r["doc_id"]: r for r in secrets.scanned(d, repo=repo).collect()}
    new = {r["doc_id"]: r["text"] for r in secrets.redacted(d, repo=repo).collect()}
    assert any(len(x) >= secrets.WIDE for x in owners.values()) and any(len(x) == 1 for x in owners.values())
    for i, t, _, _ in rows:
        own = found_secrets(t)
        live = [x for x in own if len(owners[x[3]]) < secrets.WIDE]
        assert (got[i]["n_live"], got[i]["n_example"]) == (len(live), len(own) - len(live))
        assert got[i]["max_owners"] == max((len(owners[x[3]]) for x in own), default=0) and got[i]["max_repos"] == max((len(repos[x[3]]) for x in own), default=0)
        assert got[i]["spans"] == ",".join(f"{(secrets.BASE + secrets.ADDED)[k][0]}:{a}:{b}" for a, k, b, _ in own)
        out, at = "", 0
        for a, _, b, _ in live:
            if a >= at:
                out += t[at:a] + secrets.MASK
            at = max(at, b)
        assert new[i] == (out + t[at:] if live else t)


def test_very_many_secrets_in_one_text(spark):
    text = " ".join(f"é token=abc{i:07d} x" for i in range(60_000))
    d = spark.createDataFrame([(1, text, "s")], "doc_id bigint, text string, source string")
    r = secrets.scanned(d).first()
    want = ",".join(f"assign:{m.start()}:{m.end()}" for m in re.finditer(r"token=\w+", text))
    assert (r["n_assign"], r["n_live"], r["base_sha256"]) == (60_000, 60_000, hashlib.sha256(want.encode()).hexdigest())
    assert secrets.redacted(d).first()["text"] == re.sub(r"token=\w+", secrets.MASK, text)


# Packing


def test_assignment_is_that_of_the_rule():
    def plain(lengths, length, linear):
        pieces, rest, seq = [], [], 0
        for d, m in enumerate(lengths):
            for k in range(m // length):
                pieces.append((d, k * length, length, seq, 0))
                seq += 1
            if m % length:
                rest.append((m % length, d, m // length * length))
        total = sum(r[0] for r in rest)
        room = [length] * (total // length) + [1 << k for k in range(length.bit_length() - 1, -1, -1) if (total % length) >> k & 1]
        free, cost = room[:], [0] * len(room)
        for m, d, at in sorted(rest, key=lambda x: (-x[0], x[1])):
            while m:
                s = min([s for s in range(len(room)) if free[s] >= m] or [s for s in range(len(room)) if free[s]], key=lambda s: (cost[s], -free[s], s))
                u = min(m, free[s])
                pieces.append((d, at, u, seq + s, room[s] - free[s]))
                free[s], cost[s], m, at = free[s] - u, cost[s] + linear * u + u * u, m - u, at + u
        return pieces

    rng = random.Random(6)
    for _ in range(120):
        length = rng.choice([8, 64, 2048])
        lengths = [rng.randint(1, rng.choice([3, length, 4 * length])) for _ in range(rng.randrange(60))]
        assert packing.assign(lengths, length) == plain(lengths, length, packing.LINEAR)


# Language


@pytest.mark.parametrize("shards", [1, 5])
def test_probabilities_are_those_of_interpolated_kneser_ney(shards):
    rng = random.Random(8)
    texts = {"aa": ["".join(rng.choice("ab c") for _ in range(60)) for _ in range(8)], "bb": ["".join(rng.choice("bcd ") for _ in range(60)) for _ in range(8)]}
    n = languages.ORDER

    def grams(t):
        data, at = flat(t)
        s, starts, _ = languages.symbols(data, at)
        return [tuple(s[i : i + n]) for i in range(len(s) - n + 1)]

    counts = {k: Counter(g for t in ts for g in grams(t)) for k, ts in texts.items()}
    order = sorted(counts)
    model = languages.fitted(order, [np.array(list(counts[k]), np.uint32) for k in order], [np.array(list(counts[k].values())) for k in order], shards)
    known = {g[-1] for c in counts.values() for g in c}

    def levels(c):
        out = {n: c}
        for k in range(n - 1, 0, -1):
            out[k] = Counter(g[1:] for g in out[k + 1])
        return out

    def p(level, g):
        if not g:
            return 1.0 / (len(known) + 1000)
        c = level[len(g)]
        ones, twos = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = min(0.95, max(0.1, ones / max(ones + 2 * twos, 1)))
        own = {x: v for x, v in c.items() if x[:-1] == g[:-1]}
        total = sum(own.values())
        low = p(level, g[1:])
        return low if not total else (max(c[g] - d, 0) if g in c else 0) / total + d * len(own) / total * low

    for t in ["abc ab", "dcb", "zz a", "c" * 9, texts["aa"][0]]:
        data, at = flat(t)
        s, starts, _ = languages.symbols(data, at)
        got, size = model.entropy(s, starts)
        for j, k in enumerate(order):
            level = levels(counts[k])
            want = -sum(math.log(p(level, g)) for g in grams(t)) / size[0]
            assert got[0, j] == pytest.approx(want, rel=1e-4)


def test_language_on_held_out_rows(spark):
    rows = queries.op7_language(spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows) > 200


# Toxicity


def test_composed_grammar_equals_the_cascade():
    rng = random.Random(9)
    stages = [toxicity._negation(), toxicity._threat(), toxicity._insult(), toxicity._report(), toxicity._target()]
    whole = toxicity.grammar()
    for _ in range(400):
        text = "".join(rng.choice(toxicity.SYMBOLS + "__") for _ in range(rng.randrange(12)))
        state, out, weight = toxicity.START, [], 0.0
        for x in text:
            state, more, w = whole.step(state, x)
            out += more
            weight += w
        line, total = list(text), 0.0
        for t in stages:
            s, after = 0, []
            for x in line:
                s, more, w = t.step(s, x)
                after += more
                total += w
            line = after
        assert out == line and weight == pytest.approx(total)


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("You zorb!", "aimed_insult"), ("What a zorb.", "insult"), ("such a zorb, all of you", "aimed_insult"), ("you are not a zorb", "excused"), ("he said you are a zorb", "excused"),
        ("I will kill you", "threat"), ("you know I will hurt them", "aimed_threat"), ("they kill time", None), ("I will not kill you", None), ("she wrote that I will kill", "excused"), ("the house. you", None),
    ],
)
def test_clauses(text, kind):
    from graphloom.llm.words import hashed

    x, n = toxicity.Reader(np.array([hashed(b"zorb")], np.uint64)).features(*flat(text))
    want = np.zeros(len(toxicity.EVENTS))
    if kind:
        want[toxicity.EVENTS.index(kind)] = np.log(2)
    assert x[0, : len(want)] == pytest.approx(want) and n[0] == (kind is not None)


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op1_toxicity(spark, sf).join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    hit, all_toxic = sum(r["predicted"] for r in rows if r["toxic"]), sum(r["toxic"] for r in rows)
    false = sum(r["predicted"] for r in rows if not r["toxic"])
    assert hit >= 0.85 * all_toxic > 50 and false <= 0.01 * len(rows)


# Quality


def test_expectation_maximisation_finds_the_rates():
    rng = np.random.default_rng(2)
    good = rng.random(20_000) < 0.8
    accuracy = np.array([0.95, 0.9, 0.8, 0.75, 0.6])
    right = rng.random((len(good), 5)) < accuracy
    votes = np.where(right == good[:, None], 2, 1)
    votes[rng.random(votes.shape) < 0.2] = 0
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    prior, rates = quality.estimated(patterns, n.astype(float))
    assert prior == pytest.approx(0.8, abs=0.02)
    assert rates[1, :, 2] == pytest.approx(accuracy, abs=0.03) and rates[0, :, 1] == pytest.approx(accuracy, abs=0.06)
    assert ((quality.posterior(votes, prior, rates) > 0.5) == good).mean() > 0.95


def test_quality_on_labelled_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op2_quality(spark, sf).join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id").collect()
    poor = [r["keep"] for r in rows if r["quality"] == 0]
    assert sum(poor) <= 0.2 * len(poor) and all(r["keep"] for r in rows if r["quality"] == 1 and r["posterior"] > 0.9)
    assert sum(r["keep"] for r in rows if r["quality"] == 1) >= 0.98 * sum(r["quality"] == 1 for r in rows)


# Media


def damaged(media, packet, change):
    data = bytearray(media)
    change(data, packet * transport.PACKET)
    return bytes(data)


def test_damage_is_counted():
    payload = transport.padded(bytes(range(256)) * 700)
    media = transport.muxed(payload)
    whole = transport.demuxed(media)
    assert b"".join(u[4] for u in whole.units) == payload and (whole.jumps, whole.bad_sync, whole.bad_crc) == (0, 0, 0)
    assert [u[1] for u in whole.units] == [3600, 7200, 10800] and all(u[3] for u in whole.units) and whole.clocks == 3
    lost = transport.demuxed(media[: 50 * 188] + media[51 * 188 :])
    assert lost.jumps == 1 and len(lost.units) == 3
    twice = transport.demuxed(media[: 51 * 188] + media[50 * 188 :])
    assert twice.jumps == 0 and b"".join(u[4] for u in twice.units) == payload
    sync = transport.demuxed(damaged(media, 9, lambda d, at: d.__setitem__(at, 0)))
    assert sync.bad_sync == 1 and sync.jumps == 1
    table_ = transport.demuxed(damaged(media, 1, lambda d, at: d.__setitem__(at + 14, d[at + 14] ^ 1)))
    assert table_.bad_crc == 1 and not table_.types and not table_.units
    assert transport.demuxed(b"").packets == 0 and transport.demuxed(b"\x47" * 100).packets == 0


# Licences


def test_mutated_notices_are_found():
    notices = licenses.Notices(licenses.NOTICES)
    assert [x[:2] + (x[3],) for x in notices.find("released under the mit licence. released under the mit license.")] == [(0, 30, 1), (32, 62, 0)]
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz ,."
    for _ in range(600):
        label, text, k = rng.choice(notices.notices)
        x = list(text)
        edits = rng.randint(0, k)
        for _ in range(edits):
            i, op = rng.randrange(len(x)), rng.random()
            x[i : i + (op < 0.66)] = [] if 0.33 <= op < 0.66 else [rng.choice(letters)]
        x, y = "".join(x), "".join(rng.choice(letters) for _ in range(20))
        found = [z for z in notices.find(f"{y} {x} {y} {text} {y}") if z[2] == label]
        a, b = len(y) + 1, len(y) * 2 + len(x) + 3
        assert any(z[0] < a + len(x) and z[1] > a and z[3] <= edits for z in found)
        assert any(z[:2] == (b, b + len(text)) and z[3] == 0 for z in found)


# The pipeline


def test_pipeline(spark):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(queries._vocabulary()["json_path"])
    exact.encode_special_tokens = True
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near", "decontamination", "secrets", "packing"]
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "language":
            assert all(after[k] == r["text"] for r in before if (k := r["doc_id"]) in after) and len(after) >= 0.97 * len(before)
        if name == "near":
            roots, _ = grouped([(r["doc_id"], r["text"]) for r in before])
            first = {}
            for r, g in zip(before, roots, strict=True):
                first[g] = min(first.get(g, r["doc_id"]), r["doc_id"])
            assert set(after) == set(first.values())
        if name == "secrets":
            owners = defaultdict(set)
            for r in before:
                for *_, s in found_secrets(r["text"]):
                    owners[s].add(r["source"])
            assert set(after) == {r["doc_id"] for r in before}
            for r in before:
                live = [x for x in found_secrets(r["text"]) if len(owners[x[3]]) < secrets.WIDE]
                assert (after[r["doc_id"]] == r["text"]) == (not live) and all(r["text"][a:b] not in after[r["doc_id"]] for a, _, b, _ in live)
    pieces = defaultdict(list)
    for r in corpus_pipeline.run(spark, SF).collect():
        pieces[r["doc_id"]].append(r)
    assert set(pieces) == set(after)
    for k, rows in pieces.items():
        ids = np.array([*exact.encode(after[k] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(rows, key=lambda r: r["start"]):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
