"""The filter audit against plain Python, with nulls, ties, repeated rows, many parts, an empty table and clashing names."""

import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from fluxwarden.llm import filter_audit


def marked():
    return {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(3), []
    texts = [" ".join(f"{rng.choice(['w', 'W', 'é'])}{rng.randrange(k)}" for _ in range(n)) + rng.choice(["", "#", " | "]) for n in (1, 150, 199, 200, 201, 400) for k in (3, 99, 250) for _ in range(2)]
    texts += [None, "", " \n", "A", "$", "a " * 200, " ".join(f"w{i}" for i in range(200)), "w " * 100 + " ".join(f"x{i}" for i in range(99)) + " y", ("A" * 2 + "b" * 98)]
    for i in range(300):
        out.append((rng.choice([None, i, i, i, i // 2]), rng.choice(texts), rng.choice(["s1", "s2", None, "", "Ü"]), 1, "n"))
    return out + out[:20] + [(7, "  tail", "s1", 1, "n"), (8, "  tail", "s9", 1, "n"), (8, "  tail", "s9", 1, "n")]


@pytest.fixture(scope="module")
def labels():
    rng = random.Random(9)
    return [(rng.choice([None, i]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(250) for _ in range(rng.choice([0, 1, 2]))]


def failed(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    tests = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)))
    return {f for f, x in zip("ABCD", tests, strict=True) if x}


def plain_audit(rows, labels):
    docs = []
    for i, t, part, *_ in rows:
        f = failed(t)
        if i is not None and any(j is not None and j < i and (u or "") == (t or "") for j, u, *_ in rows):
            f.add("E")
        docs.append((part or "", f, any(j == i is not None and q == 1 for j, q, _ in labels), any(j == i is not None and x == 1 for j, _, x in labels)))
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in map("".join, permutations("ABCDE")):
            for s, f in enumerate(order):
                before = set(order[:s])
                gone = [d for d in own if f in d[1] and not d[1] & before]
                out[part, order, s + 1] = [sum(not d[1] & (before | {f}) for d in own), len(gone), sum(f in d[1] and bool(d[1] & before) for d in own), sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)]
    total = {}
    for (part, order, s), v in out.items():
        total[part, order[s - 1]] = total.get((part, order[s - 1]), 0) + v[1]
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("most", [256, 1])
def test_audit(spark, rows, labels, monkeypatch, most):
    monkeypatch.setattr(filter_audit, "MAX_PARTS", most)
    monkeypatch.setattr(filter_audit, "SLICE_BYTES", 5_000)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, mask int, digest string").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    counted = filter_audit.with_repeats(filter_audit.labelled(filter_audit.fingerprints(docs), marks, marked()))
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in filter_audit.audit(counted).collect()}
    assert got == plain_audit(rows, labels)
    nothing = filter_audit.with_repeats(filter_audit.labelled(filter_audit.fingerprints(docs.limit(0)), marks.limit(0), marked()))
    assert filter_audit.audit(nothing).count() == 0


def test_fields_do_not_overflow():
    o = filter_audit.Outcomes("AB", ("good",))
    assert len(o.packed) == 8 and len(o.orders) == 2
    n = 2**62
    counts = o.unpack(n * o.packed[0b111] + (n - 1) * o.packed[0b001])
    assert counts[0, 0].tolist() == [0, 2 * n - 1, 0, n - 1, n] and counts[0, 1].tolist() == [0, 0, n, 0, 0]
    assert counts[1, 0].tolist() == [n - 1, n, 0, 0, n] and counts[1, 1].tolist() == [0, n - 1, n, n - 1, 0]


def test_plan_compares_texts_after_they_were_counted(spark, rows):
    docs = spark.createDataFrame([(i, "same text", "s", 0, "") for i in range(5_000)], "doc_id bigint, text string, source string, mask int, digest string").repartition(8)
    marks = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    counted = filter_audit.with_repeats(filter_audit.labelled(filter_audit.fingerprints(docs), marks, marked()))
    assert sorted(map(tuple, counted.collect())) == [("s", 1, 1), ("s", 17, 4_999)]
