"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from fluxwarden.llm import queries, runs


def plain_lyndon(s):
    """The longest Lyndon word from each place: smaller than all its proper suffixes."""
    return [max(m for m in range(1, len(s) - i + 1) if all(s[i : i + m] < s[i + k : i + m] for k in range(1, m))) for i in range(len(s))]


def plain_runs(w, min_length=24, min_periods=3):
    out, n = [], len(w)
    for q in range(1, n // min_periods + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            z = i
            while z + q < n and w[z] == w[z + q]:
                z += 1
            length = z + q - i
            smaller = any(w[i : z + q - d] == w[i + d : z + q] for d in range(1, q))
            if length >= max(min_length, min_periods * q) and not smaller:
                out.append((i, length, q))
            i = z + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def odd_sequence(rng):
    s = []
    while len(s) < rng.randrange(1, 160):
        kind = rng.randrange(4)
        if kind == 0:
            s += [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randrange(12))]
        elif kind == 1:
            s += [rng.randrange(3) for _ in range(rng.randrange(1, 9))] * rng.randrange(1, 9)
        elif kind == 2 and s:
            s += s[-rng.randrange(1, 20) :] * rng.randrange(1, 4)
        else:
            s += [rng.randrange(2)] * rng.randrange(40)
    return s


def test_lyndon_array():
    rng = random.Random(5)
    for _ in range(400):
        s = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randrange(1, 40))]
        assert runs.lyndon_array(s) == plain_lyndon(s), s
    s = [0, 1] * 5 + [0] + [0, 1, 0, 0, 1] * 4
    assert runs.lyndon_array(s) == plain_lyndon(s)
    fib = [0]
    for a, b in zip(range(8), range(8)):
        fib = [x for c in fib for x in ([0, 1] if c == 0 else [0])]
    assert runs.lyndon_array(fib) == plain_lyndon(fib)


def test_runs_of_sequences():
    rng = random.Random(6)
    for _ in range(600):
        s = odd_sequence(rng)
        assert runs.runs_of(np.array(s, np.int64)) == plain_runs(s), s
        assert runs.runs_of(np.array(s, np.int64), 3, 3) == plain_runs(s, 3, 3), s
    assert runs.runs_of(np.zeros(50_000, np.int64)) == [(0, 50_000, 1)]


def plain_answer(words):
    found = plain_runs(words)
    dropped = {i for a, m, q in found for i in range(a + q, a + m)}
    return found, " ".join(w for i, w in enumerate(words) if i not in dropped)


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(7), []
    for i in range(150):
        w = [f"w{x}" for x in odd_sequence(rng)] + [f"v{rng.randrange(300)}" for _ in range(rng.randrange(120))]
        k = rng.randrange(len(w) + 1)
        out.append((i, rng.choice(["", " \n"]) + rng.choice([" ", "\t\r\n", "\x0b"]).join(w[:k] + [f"u{rng.randrange(9)}é " for _ in range(rng.randrange(3))] + w[k:]) + rng.choice(["", " "]), "x"))
    out += [(200, None, None), (201, "", ""), (202, " \n ", ""), (None, "a " * 30, ""), (0, out[0][1], "x"), (203, "one", ""), (204, " ".join(["x y z w v"] * 4000), "")]
    return out


def test_periodic_runs(spark, rows, monkeypatch):
    t = spark.createDataFrame(rows, "doc_id bigint, text string, runs string").repartition(3)
    want = sorted((str(i), *plain_answer(re.findall(r"[^\x20\x09-\x0D]+", s or ""))) for i, s, _ in rows if i != 204)
    for size in (runs.SLICE_BYTES, 500):
        monkeypatch.setattr(runs, "SLICE_BYTES", size)
        got = {(r["id"], tuple(map(tuple, r["runs"])), r["collapsed"]) for r in runs.periodic_runs(t).collect()}
        assert sorted((str(i), list(r), c) for i, r, c in got if i != "204") == sorted({(i, tuple(r), c): (i, r, c) for i, r, c in want}.values())
        assert ("204", ((0, 20_000, 5),), "x y z w v") in got
    assert runs.periodic_runs(t).count() == len(rows) and runs.periodic_runs(t.limit(0)).count() == 0
    with pytest.raises(ValueError, match="24 words"):
        runs.periodic_runs(t, min_length=10)


def test_query(spark, rows, tmp_path):
    rows = [(i, s, x) for i, s, x in rows if i is not None and i != 204] + [(i, " ".join(f"t{j % 97}" for j in range(i % 200)), "x") for i in range(1000, 1120)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()}
    planted = 0
    for i, s, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", s or "")
        h, n = zlib.crc32(str(i).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (k - a) % p] for k in range(a, n)]
            planted += 1
        found, kept = plain_answer(w)
        top = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
        r = got[i]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(found), *top)
        assert r["exponent_milli"] == (1000 * top[1] // top[2] if found else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{a},{m},{q}\n" for a, m, q in found).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
    assert planted > 10
