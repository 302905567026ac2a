"""The chat linker against one in plain Python, over thousands of made messages."""

import json
import random

import pytest

pytest.importorskip("graphloom.llm")

from graphloom.llm import chat  # noqa: E402

SHAPE = "conv_id bigint, turn bigint, role string, text string, json string"


def compact(x):
    return json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def made(seed, n):
    rng = random.Random(seed)
    rows, known = [], []
    for _ in range(n):
        conv, turn = rng.choice([0] * 6 + [1, 2, 3, None]), rng.choice([*range(40), None])
        kind = rng.random()
        if kind < 0.35:
            calls = []
            for _ in range(rng.randrange(0, 4)):
                args = rng.choice([{"query": "é q", "limit": 3}, {"query": 5}, {"limit": 2}, {"url": "u"}, "{\"query\": \"in text\"}", "not json {", None, [1], {"expression": "1+1", "extra": {"b": None, "a": [1, 2]}}])
                c = {"id": rng.choice([None, *(f"c{k}" for k in range(200))]), "name": rng.choice(["search", "fetch", "calculate", "other"]), "type": "function"}
                if rng.random() < 0.3:
                    c = {"id": c["id"], "function": {"name": c["name"], "arguments": args}}
                else:
                    c["arguments"] = args
                calls.append(c)
                known.append(c["id"])
            o = {"tool_calls": calls, "content": "text", "z": 1.5}
            rows.append((conv, turn, "assistant", rng.choice(["", "  ", "\n"]) + json.dumps(o, ensure_ascii=rng.random() < 0.5), "clash"))
        elif kind < 0.75:
            o = {"tool_call_id": rng.choice([None, *(f"c{k}" for k in range(260))]), "content": ["r", {"y": 1, "x": 2}], "is_error": False}
            rows.append((conv, turn, "tool", " " * rng.randrange(3) + json.dumps(o) + "\n" * rng.randrange(2), None))
        else:
            rows.append((conv, turn, rng.choice(["user", "assistant", "tool", "system", None]), rng.choice([None, "", "plain", "{broken", "{\"a\": 1}", '{"tool_calls": 3}']), None))
    return rows + rows[:50]


def expected(rows):
    def read(role, text):
        if role not in ("assistant", "tool") or text is None:
            return None
        try:
            o = json.loads(text)
        except ValueError:
            return None
        return o if isinstance(o, dict) else None

    def call(c):
        f = c.get("function") or {}
        args = c.get("arguments", f.get("arguments"))
        if isinstance(args, str):
            try:
                args = json.loads(args)
            except ValueError:
                pass
        return {"arguments": args, "id": c.get("id"), "name": c.get("name", f.get("name"))}

    def valid(c):
        kinds = {"STRING": str, "BIGINT": int}
        fields = chat.SCHEMAS.get(c["name"])
        if fields is None or not isinstance(c["arguments"], dict):
            return False
        return all(isinstance(c["arguments"][k], tuple(kinds[x] for x in ks)) if k in c["arguments"] else not need for k, (ks, need) in fields.items())

    read_rows, places, results = [], {}, set()
    for conv, turn, role, text, _ in rows:
        o = read(role, text)
        listed = o.get("tool_calls") if o and role == "assistant" else None
        calls = [call(c) for c in listed] if isinstance(listed, list) else []
        answer = o.get("tool_call_id") if o and role == "tool" else None
        read_rows.append((conv, turn, role, text, o, calls, answer))
        if conv is not None and answer is not None:
            results.add((conv, answer))
        for at, c in enumerate(calls):
            if conv is not None and c["id"] is not None:
                own = ((turn is not None, turn or 0), at, text, turn)
                key = (conv, c["id"])
                if key not in places or own[:2] < places[key][:2]:
                    places[key] = own
    out = []
    for conv, turn, role, text, o, calls, answer in read_rows:
        if calls:
            ids = {c["id"] for c in calls if c["id"] is not None and conv is not None}
            n = sum((conv, i) in results and places[conv, i][2:] == (text, turn) for i in ids)
            drop = lambda d: {k: v for k, v in d.items() if v is not None or k == "arguments"}
            js = {"calls": [drop(c) for c in calls], "message": o, "role": role}
            out.append((conv, turn, role, turn, 0, len(calls), sum(map(valid, calls)), n, None, compact(js)))
        elif answer is not None:
            p = places.get((conv, answer))
            moved = p is not None and p[3] is not None and turn is not None and p[3] >= turn
            out.append((conv, turn, role, p[3] if moved else turn, p[1] + 1 if moved else 0, 0, 0, 0, p is not None, compact({"message": o, "role": role})))
        else:
            out.append((conv, turn, role, turn, 0, 0, 0, 0, False if role == "tool" else None, compact({k: v for k, v in (("content", text), ("role", role)) if v is not None})))
    return out


def test_against_plain_python(spark):
    rows = made(3, 4000)
    # Calls of one id at one turn are a tie that texts' hashes decide; the fixture has none.
    seen, kept = set(), []
    for r in rows:
        o = json.loads(r[3]) if r[2] == "assistant" and r[3] and r[3].strip().startswith("{\"tool_calls\": [") else {}
        ids = [(r[0], r[1], c["id"]) for c in o.get("tool_calls", []) if c["id"] is not None]
        if len(set(ids)) < len(ids) or any(i in seen for i in ids):
            continue
        seen |= set(ids)
        kept.append(r)
    kept += [r for r in kept if r[2] == "user"][:20]
    got = [tuple(r) for r in chat.linked(spark.createDataFrame(kept, SHAPE).repartition(5)).collect()]
    want = expected(kept)
    assert sum(bool(r[8]) for r in want) > 300 and sum(r[4] > 0 for r in want) > 100 and sum(r[7] for r in want) > 100
    key = lambda r: tuple(map(str, r[:9])) + (json.dumps(json.loads(r[9]), sort_keys=True),)
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert sorted(r[9] for r in got) == sorted(r[9] for r in want)


def test_empty(spark):
    assert chat.linked(spark.createDataFrame([], SHAPE)).count() == 0


def test_one_long_conversation(spark):
    long = "x" * 3_000_000
    rows = [(1, i, "assistant", json.dumps({"tool_calls": [{"id": f"i{i}", "name": "fetch", "arguments": {"url": long if i == 7 else "u"}}]}), None) for i in range(300)]
    rows += [(1, 299 - i, "tool", json.dumps({"tool_call_id": f"i{i}", "content": "r"}), None) for i in range(300)]
    got = chat.linked(spark.createDataFrame(rows, SHAPE)).collect()
    assert sum(bool(r["linked"]) for r in got) == 300 and sum(r["n_valid"] for r in got) == 300
    assert all((r["order_turn"], r["order_index"]) >= (int(json.loads(r["json"])["message"]["tool_call_id"][1:]), 1) or r["order_turn"] > int(json.loads(r["json"])["message"]["tool_call_id"][1:]) for r in got if r["role"] == "tool")
