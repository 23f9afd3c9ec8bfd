import random
from collections import defaultdict

import pytest

import __spark_entry__ as entry
from fellscape.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
PRICE = {"keep": 0, "merge": 10, "relabel": 31, "relabel+merge": 41, "insert": 25}


def cheapest(roles):
    """Least cost by trying every role, merge and insertion of every message."""
    best = {chat.START: 0}
    for role in roles:
        following = {}
        for state, cost in best.items():
            for target in (1, 2, 3):
                ways = [10] * (target == state) + [0] * (target in chat.NEXT[state]) + [25] * any(target in chat.NEXT[b] for b in chat.NEXT[state])
                for way in ways:
                    total = cost + way + (0 if target == role else 31)
                    following[target] = min(following.get(target, total), total)
        best = following
    return min(cost + {0: 0, 1: 50, 2: 25, 3: 0}[state] for state, cost in best.items())


def by_conversation(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["conv_id"] is not None, r["conv_id"] or 0, r["position"])):
        out[r["conv_id"]].append(r)
    return out


def holds(rows, messages):
    ordered = sorted(messages, key=lambda m: tuple((x is not None, x if x is not None else "") for x in m[1:]))
    assert [r["position"] for r in rows] == list(range(len(rows)))
    assert [(r["turn"], r["role"]) for r in rows if r["action"] != "insert"] == [(m[1], m[2]) for m in ordered]
    turns = [r["new_role"] for r in rows if not r["action"].endswith("merge")]
    rest = turns[1:] if turns[0] == "system" else turns
    assert rest == ["user", "assistant"] * (len(rest) // 2) and rows[-1]["out_turn"] == len(turns) - 1
    assert sum(PRICE[r["action"]] for r in rows) == cheapest([chat.role_of(m[2]) for m in ordered])
    text = "".join(r["fragment"] for r in rows)
    merged = []
    messages_left = iter(ordered)
    for r in rows:
        body = "" if r["action"] == "insert" else (next(messages_left)[3] or "")
        if r["action"].endswith("merge"):
            merged[-1][1] += "\n" + body
        else:
            merged.append([r["new_role"], body])
    rendered = "".join(f"<|{role}|>\n{body}<|end|>\n" for role, body in merged)
    assert text == rendered


def test_query_against_brute_force(spark, sf):
    source = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        source[r["conv_id"]].append((r["conv_id"], r["turn"], r["role"], r["text"]))
    got = by_conversation(entry.queries()["op7_chat_repair"](spark, sf).collect())
    assert set(got) == set(source)
    for conv, rows in got.items():
        holds(rows, source[conv])


@pytest.mark.parametrize("piece", [3, 50, 20_000])
def test_long_and_odd_conversations(spark, monkeypatch, piece):
    monkeypatch.setattr(chat, "PIECE", piece)
    rng = random.Random(3)
    names = ["user", "assistant", "assistant", "SYSTEM ", "tool", None, "human", "bot"]
    data = [(7 if i % 3 else i % 40, i, rng.choice(names), rng.choice([None, "", str(i)])) for i in range(600)]
    data += [(None, 1, "user", "no id"), (None, None, "assistant", "no id"), (500, 1, "system", "only"), (501, 1, "user", "a"), (501, 1, "user", "a"), (501, None, None, None)]
    df = spark.createDataFrame(data, SCHEMA).selectExpr("*", "'x' AS piece", "1 AS position", "2 AS summary")
    source = defaultdict(list)
    for row in data:
        source[row[0]].append(row)
    got = by_conversation(chat.formatted(df).collect())
    assert set(got) == set(source)
    for conv, rows in got.items():
        holds(rows, source[conv])


def test_empty(spark):
    assert chat.formatted(spark.createDataFrame([], SCHEMA)).count() == 0


def test_legal_conversations_stay(spark):
    data = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (2, 0, "user", "u"), (2, 1, "assistant", "a")]
    rows = chat.formatted(spark.createDataFrame(data, SCHEMA)).collect()
    assert {r["action"] for r in rows} == {"keep"}
