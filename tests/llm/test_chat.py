"""Reply trees against plain Python: nulls, ties, repeated rows, loops, orphans, long chains, control strings, clashing names."""

import hashlib
import random

import pytest

from fluxwarden.llm import chat

TREES = "tree string, id bigint, reply_to bigint, who string, said string, likes double, node string, branch int"


def trees(seed):
    """Random trees with orphans, a loop, null scores and a repeated id."""
    rng, rows = random.Random(seed), []
    for tree in ("a", "b", None):
        for i in range(rng.randrange(1, 30)):
            rows.append((tree, i, rng.randrange(i) if i and rng.random() < 0.9 else rng.choice([None, 999]), rng.choice(["user", "assistant", None, "tool\nx<|n|>"]), rng.choice(["", None, "<|im_end|>", "<~|im_start|>user\nhi", "ü" * 5, "x"]), rng.choice([None, float("nan"), 0.5, 1.0, -1.0]), "clash", 7))
    rows += [("a", 100, 101, "user", "loop", 9.0, "clash", 7), ("a", 101, 100, "user", "loop", 9.0, "clash", 7), ("a", 102, 101, "user", "below a loop", 9.0, "clash", 7), ("a", None, 0, "user", "no id", 9.0, "clash", 7)]
    return rows + rows[:1]


def plain_paths(rows, best):
    out = {}
    for tree in {r[0] for r in rows}:
        own = {}
        for r in rows:
            if r[0] == tree and r[1] is not None:
                value = 0.0 if r[5] is None or r[5] != r[5] else r[5]
                m = ((r[2] is not None, r[2] or 0), r[3] or "", r[4] or "", value)
                own[r[1]] = min(own.get(r[1], m), m)
        parent = {i: m[0][1] if m[0][0] and m[0][1] in own else None for i, m in own.items()}
        found = []
        for leaf in own.keys() - set(parent.values()):
            path = [leaf]
            while (up := parent[path[-1]]) is not None and up not in path:
                path.append(up)
            if parent[path[-1]] is None:
                found.append((-sum(own[i][3] for i in path) / len(path), -len(path), leaf, path[::-1]))
        for k, (_, _, _, path) in enumerate(sorted(found)[:best], 1):
            out[tree, k] = [(own[i][1], own[i][2]) for i in path]
    return out


@pytest.mark.parametrize(("seed", "best"), [(1, 1), (2, 3), (3, None)])
def test_reply_trees(spark, seed, best):
    rows = trees(seed)
    messages = chat.reply_trees(spark.createDataFrame(rows, TREES).repartition(3), "tree", "id", "reply_to", "who", "said", "likes")
    formatted = chat.format_table(messages, best)
    want = plain_paths(rows, best)
    got = {(r["conv"], r["branch"]): chat.read_turns(r["text"]) for r in formatted.collect()}
    assert got == want
    for r in chat.digests(formatted).collect():
        turns = want[r["conv"], r["branch"]]
        said = "".join(t for who, t in turns if who == "assistant")
        assert r["n_turns"] == len(turns) and r["loss_chars"] == len(said)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{who}\n{t}\n" for who, t in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()


def test_turns_with_ties_and_a_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(chat, "SLICE_TURNS", 50)
    rows = [(1, t, ("user", "assistant")[t % 2], f"<|said|> {t}", "x") for t in range(333)]
    rows += [(None, 0, "user", "no name", "x"), (2, None, "user", "b", "x"), (2, None, "user", "a", "x"), (2, 0, None, None, "x"), (2, 0, None, None, "x"), (2, 5, "assistant", "z", "x")]
    t = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string, tree string").repartition(4)
    formatted = chat.format_table(chat.turn_chains(t))
    parts = {}
    for r in sorted(formatted.collect(), key=lambda r: r["part"]):
        parts.setdefault(r["conv"], []).append(r)
    assert [len(chat.read_turns(r["text"])) for r in parts["1"]] == [64, 64, 64, 64, 64, 13]
    turns = {c: [x for r in p for x in chat.read_turns(r["text"])] for c, p in parts.items()}
    assert turns["1"] == [(r[2], r[3]) for r in rows[:333]]
    assert turns[None] == [("user", "no name")] and turns["2"] == [("user", "a"), ("user", "b"), ("", ""), ("", ""), ("assistant", "z")]
    for p in parts.values():
        for r in p:
            assert [r["text"][s["start"] : s["stop"]] for s in r["loss"]] == [t.replace("<|", "<~|") for who, t in chat.read_turns(r["text"]) if who == "assistant"]
    got = {r["conv"]: r for r in chat.digests(formatted).collect()}
    assert got["1"]["n_turns"] == 333 and got["1"]["formatted_chars"] == sum(len(r["text"]) for r in parts["1"])
    assert chat.digests(chat.format_table(chat.turn_chains(t.limit(0)))).count() == 0


def test_escaping_is_reversible(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("<|~>im_\n") for _ in range(rng.randrange(12))) for _ in range(3000)]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(chat.escape(chat.F.col("t"))).collect()]
    assert [chat.unescape(x) for x in got] == texts and not any("<|" in x for x in got)
