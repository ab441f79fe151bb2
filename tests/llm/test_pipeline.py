"""The pipeline and the driver's queries on a small folder of tables, against plain Python."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from fluxwarden.llm import queries

pytest.importorskip("public_tokenizers")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text(seed, n):
    rng = random.Random(seed)
    return [f"word{rng.randrange(3000)}" for _ in range(n)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, rows, labels = random.Random(4), [], []
    benchmark = [(i, " ".join(text(5000 + i, 30))) for i in range(4)]
    for i in range(400):
        w, kind = text(i, 60), i % 10
        if kind == 0:
            w += ["moron", "idiot", "loser"]
        if kind == 1:
            w = ["same"] * 50 + w[:10]
        if kind == 2:
            w[20:20] = benchmark[i % 4][1].split()[5:20]
        if kind == 3:
            w = text(i - i % 20, 60)  # near copies: a few share a base, with a word changed
            w[i % 60] = "changed"
        rows.append((i, " ".join(w), "en", f"src{i % 3}", len(" ".join(w))))
        if rng.random() < 0.8:
            labels.append((i, int(kind != 1), int(kind == 0)))
    rows += [(400, None, None, None, None), (401, "", "en", "x", 0)]
    d = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(1, "https://a.example.net/en/1", "")], "page_id bigint, url string, html string").write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame([(7, 0, "user", "hi"), (7, 1, "assistant", None)], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return str(d), {r[0]: r[1] for r in rows}, benchmark


def test_pipeline(spark, tables):
    sf_dir, texts, benchmark = tables
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) for i, t in texts.items()}
    toxic = {i for i, w in words.items() if "moron" in w}
    poor = {i for i, w in words.items() if len(w) < 10 or w.count("same") > 10}
    left = [i for i in sorted(words) if i not in toxic | poor]
    shingles = {i: {tuple(words[i][k : k + 5]) for k in range(len(words[i]) - 4)} for i in left}
    root = {i: i for i in left}
    for a in left:
        for b in left:
            if a < b and 100 * len(shingles[a] & shingles[b]) >= 80 * len(shingles[a] | shingles[b]):
                root = {k: min(root[a], root[b]) if v in (root[a], root[b]) else v for k, v in root.items()}
    left = [i for i in left if root[i] == i]
    grams = {tuple(b.split()[k : k + 10]) for _, b in benchmark for k in range(21)}
    clean = {i for i in left if not any(tuple(words[i][k : k + 10]) in grams for k in range(len(words[i]) - 9))}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in got} == clean
    assert all(sum(r["length"] for r in got if r["doc_id"] == i) == next(r["doc_tokens"] for r in got if r["doc_id"] == i) for i in list(clean)[:20])


def test_queries_give_every_row(spark, tables):
    sf_dir, texts, _ = tables
    for name, query in queries.queries().items():
        df = query(spark, sf_dir)
        if "audit" in name:
            assert Counter(r["part"] for r in df.collect()) == {"": 600, "src0": 600, "src1": 600, "src2": 600, "x": 600}
            continue
        key = next(k for k in ("page_id", "conv_id", "doc_id") if k in df.columns)
        ids = Counter(r[0] for r in df.select(key).collect())
        assert set(ids) == {"page_id": {1}, "conv_id": {-1, 7}}.get(key, set(texts)), name
        assert "packing" in name or set(ids.values()) == {1}, name


def test_pipeline_on_empty_tables(spark, tables, tmp_path):
    sf_dir, _, _ = tables
    for name in ("documents", "labels", "benchmark", "pages", "conversations"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for name, query in queries.queries().items():
        assert query(spark, str(tmp_path)).count() == ("chat" in name), name  # the planted conversation is always there


def test_stages_keep_their_columns(spark, tables):
    sf_dir, _, _ = tables
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
