"""Small tests of the training-data operators against plain Python, with nulls, empty texts, ties, repeated rows, empty tables and
clashing column names."""

import binascii
import math
import random
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxwarden.llm import decontaminate, licences, lm_score, near_dup, packing, quality, token_counts, token_file, tokens, toxicity, url_filter

public_tokenizers = pytest.importorskip("public_tokenizers")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string"


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def words(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    base = words(1, 60)
    near = list(base)
    near[30] = "changed"
    out = [
        (0, " ".join(base), "en"), (1, " ".join(near), "en"), (2, " ".join(base), "en"), (2, " ".join(base), "en"), (3, None, "en"), (4, "", None), (5, "  \n\t ", "fr"),
        (6, "É ÉCOLE Straße naïve  Ünïted", "fr"), (7, "one two three", "en"), (8, "One TWO three", "en"), (9, "a b c d e " * 6, "en"), (10, "x\nx\n\nx\ny", "en"),
        (11, "日本語 テスト 😀", "ja"), (12, "<|endoftext|> hi <|ENDOFTEXT|>", "en"), (None, "no id at all here", "en"), (13, " ".join(words(2, 3000)), "en"),
    ]
    # A chain: each differs from its neighbour by a word at the end, the ends of the chain by more than the limit.
    for k in range(5):
        chain = words(9, 50)
        out.append((20 + k, " ".join(chain[: 50 - 2 * k] + [f"t{j}" for j in range(2 * k)]), "en"))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def as_counter(df, *cols):
    return Counter(tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect())


# URL filter


def test_url_split_and_rules(spark):
    urls = [None, "no scheme", "HTTP://WWW.A.Net/x?y", "http://m.example.net/en/1#t", "https://b.example.com/de/2", "http://a.org/fr/3", "http://notnet/", "a://b://c/d", "http://x.net", "http://Example.ORG?q"]
    t = spark.createDataFrame([(i, u, "kept") for i, u in enumerate(urls)], "page_id int, url string, host string")
    got = {r["page_id"]: r for r in url_filter.judge(t, url_filter.train(url_filter.labelled_urls(spark))).collect()}
    assert got[0]["host"] == "kept" and {r["_host"] for i, r in got.items() if i < 2} == {""}
    assert [got[i]["rule"] for i in range(10)] == [None, None, "net/", "example.net/en/", "example.com/de/", "org/fr/", None, None, None, None]
    assert [got[i]["verdict"] for i in (2, 3, 4, 5)] == ["block", "allow", "block", "allow"]
    assert got[2]["_host"] == "www.a.net" and got[2]["path"] == "/x" and got[7]["_host"] == "b:" and got[9]["_host"] == "example.org"
    assert all(r["verdict"] in ("allow", "block") and 0 <= r["score"] <= 1 for r in got.values())


def test_url_model_learns(spark):
    model = url_filter.train(url_filter.labelled_urls(spark))
    t = spark.createDataFrame([("http://my-casino-bonus.biz/win", 1), ("http://library.info/en/about", 0)], "url string, y int")
    got = {r["y"]: r["score"] for r in url_filter.judge(t, model, rules=()).collect()}
    assert got[1] > 0.5 > got[0]
    assert url_filter.judge(t.limit(0), model).count() == 0


def plain_host_and_path(url):
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    path = rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path] or [len(path)])
    return rest[:cut].translate(LOWER), path[:end]


def plain_rule(host, path):
    fit = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def test_url_filter_by_brute_force(spark):
    rng = random.Random(12)
    piece = lambda *xs: "".join(rng.choice(xs) for _ in range(rng.randrange(1, 4)))
    urls = [f"{rng.choice(['http', 'HTTPS', '', 'x'])}{rng.choice(['://', ':', '://'])}{piece('a.', 'B.', 'É.', '')}{rng.choice(['example.net', 'Example.COM', 'example.org', 'net', 'org', 'notnet', '日本'])}{piece('/', '/en/', '/de/', '/fr/', '?q=/en/', '#x', '1', chr(10), '')}" for _ in range(1500)]
    urls += [None, "", "://", "://net/", "a://net", "a://net?/", *urls[:20]]
    t = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").repartition(3)
    model = url_filter.train(url_filter.labelled_urls(spark))
    got = url_filter.judge(t, model).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path = plain_host_and_path(urls[r["page_id"]])
        rule, verdict = plain_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["score"] >= 0.5 else "allow"))


def test_url_model_on_hosts_it_has_not_seen(spark):
    every = url_filter.labelled_urls(spark).withColumn("part", F.pmod(F.crc32(url_filter.split_url(F.col("url"))[0]), F.lit(4)))
    model = url_filter.train(every.where("part > 0"))
    got = url_filter.judge(every.where("part = 0"), model, rules=()).collect()
    assert len(got) > 100 and sum((r["verdict"] == "block") == (r["blocked"] > 0) for r in got) >= 0.95 * len(got)
    rng = random.Random(5)
    ordinary = [(f"https://{rng.choice(['', 'm.', 'www.'])}{''.join(rng.choice(['th', 'er', 'in', 'tion', 'ou', 'wh', 'ble']) for _ in range(3))}.example.{rng.choice(['com', 'org'])}/{rng.choice(['en', 'fr', 'es'])}/{rng.randrange(999)}",) for _ in range(300)]
    got = url_filter.judge(spark.createDataFrame(ordinary, "url string"), url_filter.train(url_filter.labelled_urls(spark)), rules=()).collect()
    assert sum(r["verdict"] == "allow" for r in got) >= 0.97 * len(got)


# Toxicity


def test_toxicity_held_out_and_fair(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        text = words(100 + i, 30)
        toxic = i % 4 == 0
        if toxic:
            text += [rng.choice(["idiot", "scumbag", "trashy"])] * 2
        if toxic and rng.random() < 0.6 or rng.random() < 0.05:
            text.append("muslim")
        if rng.random() < 0.1:
            text.append("christian")
        rows.append((i, " ".join(text), int(toxic)))
    d = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    sample = toxicity.labelled_sample(d.drop("toxic"), d.select("doc_id", "toxic"), ~toxicity.held_out())
    fair, unfair = toxicity.fit(sample), toxicity.fit(sample, fairness=0.0)
    scored = toxicity.score(d, fair).where(toxicity.held_out()).collect()
    assert sum(r["predicted"] == r["toxic"] for r in scored) >= 0.97 * len(scored)
    gap = lambda m: abs(m.weights.get("muslim", 0) - m.weights.get("christian", 0))
    assert gap(fair) < 0.5 * gap(unfair)
    neutral = spark.createDataFrame([(1, "the muslim community met here")], "doc_id bigint, text string")
    assert toxicity.score(neutral, fair).first()["score"] < 0.5


def test_toxicity_spares_neutral_mentions_and_tells_its_swaps(spark):
    """Toxic texts name a group more often than clean ones do; neutral mentions must not be called toxic for that."""
    rng, rows = random.Random(13), []
    for i in range(800):
        text, toxic = words(3000 + i, 25), i % 4 == 0
        if toxic and rng.random() < 0.6:  # others are known by their mention alone, wrongly
            text.append(rng.choice(["scumbag", "vermin", "moron"]))
        if rng.random() < (0.9 if toxic else 0.02):
            text.insert(3, rng.choice(["muslim", "jewish", "frau"]))
        elif rng.random() < 0.1:
            text.insert(3, rng.choice(["christian", "hindu", "mann"]))
        rows.append((" ".join(text), int(toxic)))
    sample = spark.createDataFrame(rows, "text string, label int")
    fair, unfair = toxicity.fit(sample, compare=True), toxicity.fit(sample, fairness=0.0)
    assert fair.swaps > 10 and fair.mentions > 100 and fair.penalty < 0.1 * fair.unpenalised == pytest.approx(0.1 * unfair.penalty)
    neutral = [(" ".join(w[:3] + [t] + w[3:]),) for k in range(100) for t in ["muslim", "jewish", "frau"][k % 3 : k % 3 + 1] for w in [words(9000 + k, 12)]]
    wrong = {name: toxicity.score(spark.createDataFrame(neutral, "text string"), m).where("predicted = 1").count() for name, m in (("fair", fair), ("unfair", unfair))}
    assert wrong["fair"] <= 5 < wrong["unfair"]
    none = toxicity.fit(spark.createDataFrame([(f"a{i % 2} b c", i % 2) for i in range(40)], "text string, label int"), compare=True)
    assert (none.swaps, none.mentions, none.penalty, none.unpenalised) == (0, 0, 0.0, 0.0)


def test_toxicity_sample_is_bounded(spark):
    """An id that stands in many rows gives one of them; null ids and labels none; a label given twice counts as toxic if any says so."""
    d = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "b"), (3, "c"), (None, "d"), (4, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, None), (None, 1), (4, 0), (9, 1)], "doc_id bigint, toxic int")
    got = toxicity.labelled_sample(d, labels, F.lit(True)).collect()
    assert sorted((r["label"], r["text"] is None) for r in got) == [(0, True), (1, False), (1, False)]
    assert toxicity.labelled_sample(d, labels, F.lit(True), max_per_label=1).count() == 2


def test_toxicity_edges(spark, docs, empty):
    model = toxicity.ToxicityModel(-1.0, {"one": 5.0})
    got = toxicity.score(docs.withColumn("score", F.lit("x")), model)
    assert got.count() == docs.count() and "_score" in got.columns
    by = {r["doc_id"]: r["_score"] for r in got.collect()}
    assert by[3] == by[4] == pytest.approx(1 / (1 + math.exp(1))) and by[7] == by[8] > 0.5
    assert toxicity.keep_clean(docs, model).columns == docs.columns and toxicity.keep_clean(docs, model).count() == docs.count() - 2
    assert toxicity.score(empty, model).count() == 0
    one = spark.createDataFrame([(1, "a b")], "label int, text string")
    assert toxicity.fit(one).weights == {}


def test_toxicity_small_samples_and_rare_insults(spark):
    d = spark.createDataFrame([(i, " ".join(words(i, 30) + (["vermin"] if i < 10 else [])), int(i < 10)) for i in range(68)], "doc_id bigint, text string, toxic int")
    got = toxicity.score(d, toxicity.fit(d.select(F.col("toxic").alias("label"), "text"))).collect()
    assert all(r["predicted"] == r["toxic"] for r in got)
    # Each of 60 insults stands in six of 360 toxic documents; there are as many clean ones.
    rows = [(i, " ".join(words(i, 30) + ([f"slur{i % 60}x"] if i < 360 else [])), int(i < 360)) for i in range(720)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, label int")
    model = toxicity.fit(d.select("label", "text"))
    asked = [(k, " ".join(words(5000 + k, 30) + ([f"slur{k}x"] if k < 60 else [])), int(k < 60)) for k in range(120)]
    got = toxicity.score(spark.createDataFrame(asked, "doc_id bigint, text string, toxic int"), model).collect()
    assert sum(r["predicted"] for r in got if r["toxic"]) >= 57 and sum(r["predicted"] for r in got if not r["toxic"]) <= 6


# Quality rules


def plain_stats(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    wins = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if wins[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_quality_counts(spark, docs):
    extra = [(100 + i, "".join(random.Random(i).choice("ab \n#|\t") for _ in range(80)), "n_words") for i in range(60)]
    d = docs.unionByName(spark.createDataFrame(extra, SCHEMA))
    got = quality.with_stats(d).collect()
    assert all(tuple(r[c] for c in quality.STATS) == plain_stats(r["text"]) for r in got)


GOOD = (1,) * len(quality.RULES)


def votes_bad(*names):
    return tuple(0 if name in names else 1 for name, _, _ in quality.RULES)


def test_quality_em_outvotes_a_weak_rule():
    """Junk has two symbol rules against it; the line rule alone is often wrong."""
    patterns = {GOOD: 8000, votes_bad("symbols_per_word", "symbols_per_char"): 600, votes_bad("dup_lines"): 300, votes_bad("length"): 150, votes_bad("dup_lines", "symbols_per_word", "symbols_per_char"): 40}
    m = quality.fit_votes(patterns)
    assert m.posterior(GOOD) > 0.99 and m.posterior(votes_bad("symbols_per_word", "symbols_per_char")) < 0.01
    assert m.posterior(votes_bad("dup_lines")) > 0.5 and m.posterior(votes_bad("length")) > 0.5
    assert m.posterior(votes_bad("dup_lines", "symbols_per_word", "symbols_per_char")) < 0.01
    at = {name: r for r, (name, _, _) in enumerate(quality.RULES)}
    assert m.rates[at["symbols_per_word"]][0][0] > 2 * m.rates[at["dup_lines"]][0][0]


def test_quality_em_is_em():
    """The same estimates as EM over single documents, written with arrays."""
    rng = np.random.default_rng(8)
    truth = rng.random(3000) < 0.9
    flip = rng.random((3000, len(quality.RULES))) < np.array([0.05, 0.1, 0.2, 0.05, 0.3, 0.1, 0.15])
    votes = np.where(rng.random(flip.shape) < 0.1, -1, (truth[:, None] ^ flip).astype(int))
    model = quality.fit_votes(Counter(map(tuple, votes.tolist())))
    weight, on = quality.STRENGTH * 3000 + 1, votes >= 0
    bad = (votes == 0).sum(1)
    q = np.where(bad == 0, 0.95, np.where(bad == 1, 0.6, 0.1))
    for _ in range(model.rounds):
        prior = (q.sum() + quality.PRIOR_GOOD * weight) / (3000 + weight)
        chance = {y: ((w[:, None] * (votes == 0)).sum(0) + quality.PRIOR_BAD[y] * weight) / ((w[:, None] * on).sum(0) + weight) for y, w in ((1, q), (0, 1 - q))}
        log = {y: np.where(votes == 0, np.log(chance[y]), np.where(votes == 1, np.log(1 - chance[y]), 0.0)).sum(1) for y in (0, 1)}
        q = 1 / (1 + np.exp(np.log(1 - prior) + log[0] - np.log(prior) - log[1]))
    assert model.prior == pytest.approx(prior) and [r[1][0] for r in model.rates] == pytest.approx(chance[1].tolist())
    assert all(model.posterior(v) == pytest.approx(x) for v, x in zip(votes[:200].tolist(), q[:200].tolist(), strict=True))


def test_quality_filter(spark, docs, empty):
    judged = quality.judge(docs.withColumn("kept", F.lit(1)))
    for r in judged.collect():
        n, _, _, _, rep = plain_stats(r["text"])
        assert r["base_failed"] == (n < 10 or 100 * rep > 20 * n) and r["_kept"] == (not r["base_failed"] and r["posterior"] >= 0.5)
    kept = quality.keep_good(docs.withColumn("n_words", F.lit("x")))
    assert kept.columns == [*docs.columns, "n_words"] and as_counter(kept, "doc_id") == as_counter(quality.judge(docs).where("kept"), "doc_id")
    assert quality.keep_good(empty).count() == 0 and 0 < quality.fit_votes({}).prior < 1


def test_quality_repeated_lines_against_length(spark):
    prose = lambda seed, n, per: [" ".join(words(seed * 1000 + i, per, 5000)) for i in range(n)]
    texts = [prose(i, 6, 12) + ["read more"] * (5 if i < 40 else 1) for i in range(300)]  # 4 of 11, or none
    long = prose(300, 400, 50)
    texts.append(long[:100] + long[:2] + long[100:] + [long[7]])  # 20,150 words, 3 of 403 lines repeated
    texts.append(prose(301, 20, 12) + ["read more"] * 4)  # 3 of 24
    d = spark.createDataFrame([(i, "\n".join(x), "en") for i, x in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r for r in quality.judge(d).collect()}
    assert [got[i]["n_dup_lines"] for i in (0, 40, 300, 301)] == [4, 0, 3, 3]
    assert {i for i, r in got.items() if not r["kept"]} == set(range(40)) and "n_lines" not in got[0].asDict()


# Packing


def test_tournament_tree_is_first_fit():
    rng = random.Random(5)
    sizes = sorted((rng.randrange(1, 101) for _ in range(300)), reverse=True)
    bins, offsets = packing.first_fit_decreasing(sizes, 100)
    room = []
    for n, b, o in zip(sizes, bins, offsets, strict=True):
        k = next((i for i, r in enumerate(room) if r >= n), len(room))
        if k == len(room):
            room.append(100)
        assert (b, o) == (k, 100 - room[k])
        room[k] -= n


def test_pack_holds_every_id_once(spark, docs, rows, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    got = packing.pack(docs, path, length=64, group_size=7).collect()
    want = Counter()
    for i, text, _ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for s in range(0, len(ids), 64):
            part = ids[s : s + 64]
            want[str(i) if i is not None else None, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)] += 1
    assert Counter((r["id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 64
    assert packing.pack(empty, path).count() == 0


# Token file


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for n, sigma in ((0, 1), (1, 1), (1000, 1), (70_000, 3), (40_000, 50_000)):
        ids = rng.integers(0, sigma, n).astype(np.uint32)
        m = token_file.WaveletMatrix(token_file.wavelet_image(ids, [1], [n]))
        assert (m.decode() == ids).all()
        for i in rng.integers(0, n, 30) if n else []:
            i, x = int(i), int(ids[i])
            assert m.access(i) == x and m.rank(x, i) == (ids[:i] == x).sum() and m.count(x) == (ids == x).sum() and m.select(x, m.rank(x, i)) == i
        assert m.count(60_000) == 0


def test_token_file_round_trip(spark, docs, rows, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    got = token_file.read_documents(token_file.write_shards(docs, path, shard_tokens=100)).collect()
    want = Counter()
    for i, text, _ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r["id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda x: -1 if x is None else x)
    assert token_file.read_documents(token_file.write_shards(empty, path)).count() == 0


# Licences


def test_licences(spark, docs, empty):
    t = licences.templates(spark)
    d = spark.createDataFrame([(1, "Released under the MIT License.", "x"), (1, "Released under the MIT License.", "x"), (2, "text\nlicensed UNDER the apache license version 2.0\nmore", "x"), (3, "MIT", "x"), (4, None, "x"), (5, "This program is released under some licence or other", "x")], SCHEMA)
    got = as_counter(licences.scan(d, t), "id", "licence", "n_lines")
    assert got == Counter({(1, "MIT", 1): 2, (2, "Apache-2.0", 1): 1, (3, None, 0): 1, (4, None, 0): 1, (5, None, 0): 1})
    assert licences.scan(docs, t).count() == docs.count() and licences.scan(empty, t).count() == 0


def test_licence_size_bounds_lose_nothing(spark):
    t = spark.createDataFrame([("L", " ".join(words(4, 20)))], "licence string, text string")
    base = words(4, 20)
    lines = [" ".join(base[:k] + [f"z{j}" for j in range(m)]) for k in range(2, 21) for m in range(0, 8)]
    d = spark.createDataFrame([(i, x, "") for i, x in enumerate(lines)], SCHEMA)
    pairs = lambda w: {(a, b) for a, b in zip(w, w[1:], strict=False)}
    want = {i: max(0.0, s) for i, x in enumerate(lines) if (s := 2 * len(pairs(x.split()) & pairs(base)) / (len(pairs(x.split())) + len(pairs(base)))) >= 0.8}
    assert {r["id"]: pytest.approx(r["dice"]) for r in licences.scan(d, t).where("licence is not null").collect()} == want


def test_licence_windows(spark):
    notices = dict(licences.TEMPLATES)
    names = ["Apache-2.0-notice", "MIT-notice", "BSD-3-Clause", "GPL-notice"]
    wrapped = lambda x, width: "\n".join(" * " + line for line in textwrap.wrap(x, width))
    rows = [(i, f"{' '.join(words(i, 80))}\n{wrapped(notices[n], 72)}\n{' '.join(words(i + 9, 80))}", "en") for i, n in enumerate(names)]
    rows += [(10 + i, f"{' '.join(words(i, 40))} {notices[n]} {' '.join(words(i + 9, 40))}", "en") for i, n in enumerate(names)]
    rows.append((20, "The software is free and people may redistribute the license under conditions.\n" * 30, "en"))
    got = {r["id"]: (r["licence"], r["dice"], r["n_lines"]) for r in licences.scan(spark.createDataFrame(rows, SCHEMA), licences.templates(spark), whole_text=True).collect()}
    import duckdb

    from fluxwarden.llm import oracles

    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar)")
    con.executemany("insert into documents values (?, ?, ?)", [*rows, (30, f"so {notices['MIT-notice'][:150]}\n{notices['GPL-notice'][20:]} and so on", "en"), (31, None, "en")])
    more = spark.createDataFrame(con.execute("select * from documents").fetchall(), SCHEMA)
    by_sql = sorted((i, n, pytest.approx(d, abs=1e-6), k) for i, n, d, k in con.execute(oracles.SQL["op6_licence_scan"]).fetchall())
    assert sorted((r["id"], r["licence"], round(r["dice"], 6), r["n_lines"]) for r in licences.scan(more, licences.templates(spark), whole_text=True).collect()) == by_sql
    names[0] = "Apache-2.0"  # stands within the notice as a whole: of equal scores the first by name
    assert got == {**{i: (n, 1.0, 0) for i, n in enumerate(names)}, **{10 + i: (n, 1.0, 0) for i, n in enumerate(names)}, 20: (None, 0.0, 0)}


# Near duplicates


def plain_components(rows, n=5, num=80, den=100):
    sets = [{tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if (w := spaced(x)) else set() for _, x, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return Counter((rows[i][0], len(sets[i]), min((x for x in groups[find(i)] if x is not None), default=None)) for i in range(len(rows)))


def test_near_duplicates(spark, docs, rows, empty):
    assert as_counter(near_dup.cluster(docs), "id", "n_shingles", "component_id") == plain_components(rows)
    kept = near_dup.keep_one(docs.withColumn("_key", F.lit(1)))
    assert kept.columns == [*docs.columns, "_key"]
    ids = as_counter(kept, "doc_id")
    assert ids[0] == 1 and not ids[1] and not ids[2] and ids[7] == 1 and not ids[8] and ids[3] == ids[4] == ids[5] == 1
    assert near_dup.cluster(empty).count() == 0 and near_dup.keep_one(empty).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_near_duplicates_random(spark, seed, monkeypatch):
    """Groups of copies with edits, many of one base, some below and some over the limit; long runs and blocks are made common."""
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", 400)
    rng = random.Random(seed)
    rows = []
    for group in range(25):
        base = words(1000 * seed + group, rng.choice([4, 5, 9, 20, 60, 200]), 5000)
        for _ in range(rng.choice([1, 2, 5, 40 if group < 3 else 4])):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, len(w) // 18))):
                w[rng.randrange(len(w))] = f"e{rng.randrange(50)}"
            rows.append((len(rows), " ".join(w), "en"))
    d = spark.createDataFrame(rows, SCHEMA)
    assert as_counter(near_dup.cluster(d, short_run=3, combine_from=4 if seed else 64), "id", "n_shingles", "component_id") == plain_components(rows)


def test_near_duplicates_of_sets_with_one_hash(docs, rows):
    assert as_counter(near_dup.cluster(docs, hash_bits=3), "id", "n_shingles", "component_id") == plain_components(rows)


def test_near_duplicates_large_group_stays_linear(spark, monkeypatch):
    """3,000 different near copies of one text: no table between has more than a few rows for each."""
    rng, base, made = random.Random(4), words(77, 600, 5000), {}

    def counted(df, label, rebalance=False, write=near_dup.written):
        out = write(df, label, rebalance)
        made[label] = max(made.get(label, 0), out.count())
        return out

    monkeypatch.setattr(near_dup, "written", counted)
    texts = []
    for i in range(3000):
        w = list(base)
        for _ in range(1 + i % 4):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        texts.append((i, " ".join(w), "en"))
    got = near_dup.cluster(spark.createDataFrame(texts, SCHEMA)).collect()
    assert {r["component_id"] for r in got} == {0} and max(made.values()) <= 20 * 3000, made


def test_entries_take_as_many_bytes_in_any_number_of_buckets(spark):
    """An entry carried its text's 64-bit node, which compresses the less the more buckets there are."""
    d = spark.createDataFrame([(i, " ".join(words(9000 + i, 150, 5000)), "en") for i in range(400)], SCHEMA).coalesce(1)
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in ("keys", "places" if "places" in near_dup.SKETCHED else "nodes", "combined")), F.lit(0))
    for buckets in (4, 4096):
        entries = near_dup.sketched(d, near_dup.Bands(), buckets, 5, "doc_id", "text").where("kind = 1")
        made, keys = entries.agg(F.sum(size), F.sum(F.octet_length("keys"))).first()
        assert keys / 4 > 400 * 50 and made / (keys / 4) < 5.5, (buckets, made, keys)


def test_copies_in_many_batches_make_no_candidates(spark, monkeypatch):
    """Each text is a batch; copies of one text share all entries, and would come out of every bucket."""
    monkeypatch.setattr(near_dup, "HELD_ENTRIES", 1)
    monkeypatch.setattr(near_dup, "SLICE_BYTES", 1)
    made = []

    def counted(df, label, rebalance=False, write=near_dup.written):
        out = write(df, label, rebalance)
        if label == "found":
            made.append(out.count())
        return out

    monkeypatch.setattr(near_dup, "written", counted)
    text = " ".join(words(78, 100, 5000))
    got = near_dup.cluster(spark.createDataFrame([(i, text, "en") for i in range(30)], SCHEMA)).collect()
    assert {r["component_id"] for r in got} == {0} and len(got) == 30 and made == [0]


def test_places_packed():
    rng = np.random.default_rng(3)
    for gap, width in ((1, 1), (255, 1), (256, 2), (65_535, 2), (65_536, 4)):
        places = np.cumsum(np.append(rng.integers(0, gap + 1, 50), gap))
        packed = near_dup.packed_places(places)
        assert near_dup.unpacked_places(packed, 51).tolist() == places.tolist() and len(packed) == 51 * width
    assert near_dup.unpacked_places(near_dup.packed_places(np.array([0])), 1).tolist() == [0]


def test_parity_sketch_bounds():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 300)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 2**63, 5).astype(np.uint64)]))
        x, y = (np.frombuffer(near_dup.dense_sketches(s, np.array([0, len(s)]))[0], np.uint8) for s in (a, b))
        small = min(len(x), len(y))
        assert np.bitwise_count(near_dup.fold(x, small) ^ near_dup.fold(y, small)).sum() <= len(np.setxor1d(a, b))


def test_bands_reach_every_link():
    bands = near_dup.Bands()
    for a in range(1, 400):
        first, last = (int(x[0]) for x in bands.span(np.array([a])))
        assert last - first <= 2
        for b in range(a, a * 5 // 4 + 1):
            k = int(np.searchsorted(bands.bounds, a + b)) - 1
            lo, hi = (int(x[0]) for x in bands.span(np.array([b])))
            assert first <= k <= last and lo <= k <= hi and bands.most[k] >= (a + b) * 20 // 180


# Token counts


def test_token_counts(spark, docs, rows, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    rng = random.Random(6)
    odd = ["aaaaaaaaaaaaaaa aaaa", "  a   b \n c", "x" * 3000, " " * 40, "<|endoftext|><|endoftext|> x", "é́É　 \u00a0 y", "12 345,6 'll I'll"] + ["".join(rng.choice(" \n\tab'sAé1.<|> ") for _ in range(50)) for _ in range(200)]
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, x) for i, x in enumerate(odd)], "doc_id bigint, text string"))
    want = Counter((str(i) if i is not None else None, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in [*((r[0], r[1]) for r in rows), *((1000 + i, x) for i, x in enumerate(odd))])
    assert as_counter(token_counts.count_tokens(d, path), "id", "n_bytes", "n_tokens") == want
    assert token_counts.count_tokens(empty, path).count() == 0


# LM scoring


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_score(spark, docs, rows, empty, order):
    counts = [Counter() for _ in range(order + 1)]
    for _, x, _ in rows:
        w = spaced(x)
        for n in range(1, order + 1):
            counts[n].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    total = sum(counts[1].values())

    def plain(w):
        out = 0.0
        for i in range(len(w)):
            longest = min(order, i + 1)
            for n in range(longest, 0, -1):
                gram = tuple(w[i - n + 1 : i + 1])
                back = (longest - n) * math.log(0.4)
                if n == 1:
                    out += math.log(counts[1][gram] / total) + back
                elif counts[n][gram] >= 2:
                    out += math.log(counts[n][gram] / counts[n - 1][gram[:-1]]) + back
                    break
        return out

    want = sorted((str(i), len(spaced(x)), round(plain(spaced(x)), 6)) for i, x, _ in rows)
    scored = lm_score.score(docs, order=order, batch_bytes=400).collect()
    got = sorted((str(r["id"]), r["n_words"], round(r["log_total"], 6)) for r in scored)
    assert all(r["log_score"] == pytest.approx(r["log_total"] / max(1, r["n_words"])) for r in scored)
    table = Counter({(r["n"], r["count"]): r["k"] for r in lm_score.count_table(docs, order=order).groupBy("n", "count").agg(F.count("*").alias("k")).collect()})
    assert table == Counter((n, c) for n in range(1, order + 1) for c in counts[n].values())
    assert [g[:2] for g in got] == [w[:2] for w in want] and all(abs(g[2] - w[2]) < 1e-4 for g, w in zip(got, want, strict=True))
    assert lm_score.score(empty, order=order).count() == 0


# Decontamination


def plain_hits(text, items, n=10):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    hit, ids = set(), set()
    for i, x in items:
        b = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").translate(LOWER))
        k = min(n, len(b))
        for s in {tuple(b[j : j + k]) for j in range(len(b) - k + 1)} if k else ():
            for j in range(len(w) - k + 1):
                if tuple(w[j : j + k]) == s:
                    hit |= set(range(j, j + k))
                    ids.add(i)
    return len(w), len(hit), sorted(ids)


@pytest.mark.parametrize("limit", [decontaminate.MAX_BROADCAST_GRAMS, 0])
def test_decontaminate(spark, docs, rows, empty, limit):
    items = [(1, " ".join(words(1, 60)[10:25])), (2, "Two, THREE!"), (3, None), (4, "...  "), (5, "école"), (6, " ".join(words(2, 3000)[500:540])), (7, "two three")]
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.scan(docs, b, max_broadcast_grams=limit)
    want = Counter((i, *plain_hits(x, items)[:2], tuple(plain_hits(x, items)[2])) for i, x, _ in rows)
    assert Counter((r["id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got.collect()) == want
    clean = decontaminate.decontaminate(docs.withColumn("_key", F.lit(0)), b)
    assert clean.columns == [*docs.columns, "_key"] and as_counter(clean, "doc_id") == Counter(i for i, x, _ in rows if not plain_hits(x, items)[1])
    assert decontaminate.scan(empty, b).count() == 0 and decontaminate.scan(docs, b.limit(0)).where("contaminated").count() == 0


def test_decontaminate_long_text_without_broadcast(spark):
    """20,000 words, many of them hit, repeated rows and a null id, by the shuffled path."""
    w = words(40, 20_000)
    items = [(f"i{k}", " ".join(w[300 * k : 300 * k + 14 + k % 7])) for k in range(60)] + [("twice", " ".join(w[300:314])), ("short", "zz yy")]
    b = spark.createDataFrame(items, "item_id string, text string")
    rows = [(1, " ".join(w)), (1, " ".join(w)), (None, " ".join(w[290:330])), (3, "ZZ, yy zz"), (4, None), (5, " ".join(reversed(w)))]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {limit: Counter((r["id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in decontaminate.scan(d, b, max_broadcast_grams=limit).collect()) for limit in (0, 10**6)}
    assert got[0] == got[10**6] and sum(got[0].values()) == len(rows)
    n, hit, ids = plain_hits(rows[2][1], items)
    assert got[0][None, n, hit, tuple(ids), True] == 1 and got[0][3, 3, 2, ("short",), True] == 1 and got[0][4, 0, 0, (), False] == 1
    (big,) = [k for k in got[0] if k[0] == 1]
    assert got[0][big] == 2 and set(big[3]) >= {f"i{k}" for k in range(60)} | {"twice"} and big[2] >= 60 * 14
    plan = decontaminate.hits(d, b, max_broadcast_grams=0)
    kept = decontaminate.decontaminate(d, b, max_broadcast_grams=0)
    assert as_counter(kept, "doc_id") == Counter(r[0] for r in rows if not plain_hits(r[1], items)[1]) and plan.count() == 5


def test_remove_spans_of_nothing(spark, docs, empty):
    none = spark.createDataFrame([], "item_id int, text string")
    assert decontaminate.decontaminate(empty, none, remove="spans").count() == 0
    same = decontaminate.decontaminate(docs, none, remove="spans")
    assert as_counter(same, "doc_id", "text") == as_counter(docs, "doc_id", "text")


def test_remove_spans(spark):
    b = spark.createDataFrame([(1, "two three")], "item_id bigint, text string")
    d = spark.createDataFrame([(1, "One, two; THREE! four.", "x"), (2, None, "x"), (3, "no hit here", "x"), (4, "two three", "x")], SCHEMA)
    got = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(d, b, remove="spans").collect()}
    assert got == {1: "One! four.", 2: None, 3: "no hit here", 4: ""}


# All of them


def test_small_slices_give_the_same(spark, docs, rows, monkeypatch):
    """Limits on what a task holds at once are crossed many times."""
    path = public_tokenizers.path("word_bpe_49k.json")
    want = as_counter(packing.pack(docs, path), "id", "start", "length", "ids_crc32")
    model = toxicity.ToxicityModel(-1.0, {"one": 5.0, "w1": 1.0})
    scores = as_counter(toxicity.score(docs, model), "doc_id", "score")
    for module, name, value in ((near_dup, "SLICE_BYTES", 300), (near_dup, "HELD_ENTRIES", 50), (packing, "SLICE_BYTES", 300), (toxicity, "SLICE_BYTES", 300)):
        monkeypatch.setattr(module, name, value)
    assert as_counter(packing.pack(docs, path), "id", "start", "length", "ids_crc32") == want
    assert as_counter(toxicity.score(docs, model), "doc_id", "score") == scores
    assert as_counter(near_dup.cluster(docs), "id", "n_shingles", "component_id") == plain_components(rows)


def test_encoder_forgets_and_learns_again():
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, rng = Tokenizer.from_file(path), random.Random(11)
    texts = ["".join(rng.choice(" \n\tab'sSTré.,!?<|>éßİΣς日😀12_-%»") for _ in range(rng.randrange(60))) for _ in range(900)] + [None, "", "<|endoftext|> A<|ENDOFTEXT|>b", "DON'T we'll. 'S x.%%% »..."]
    for most in (10, 10**6):
        e = tokens.WordEncoder(path, most)
        for at in range(0, len(texts), 100):
            part = texts[at : at + 100]
            ids, offsets = e.encode(pa.array(part, pa.string()))
            assert [ids[a:z].tolist() for a, z in zip(offsets[:-1], offsets[1:], strict=True)] == [t.encode(x or "", add_special_tokens=False).ids for x in part]


def test_clashing_columns_and_one_long_text(spark):
    """Extra columns with the names that results have, and a text of a megabyte without a break."""
    path, pieces = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
    d = spark.createDataFrame([(1, "ab " * 20_000, "a", 1), (2, "x" * 1_000_000, "b", 2), (3, None, None, None)], "doc_id bigint, text string, id string, n_words int")
    for c in ("start", "length", "n_tokens", "log_score", "licence", "node", "batch", "key", "score", "kept"):
        d = d.withColumn(c, F.lit("x"))
    assert packing.pack(d, path).groupBy("id").count().count() == 3
    assert token_file.read_documents(token_file.write_shards(d, path)).count() == 3
    assert {r["id"]: r["n_bytes"] for r in token_counts.count_tokens(d, pieces).collect()} == {"1": 60_000, "2": 1_000_000, "3": 0}
    assert {r["id"]: r["n_words"] for r in lm_score.score(d).collect()} == {1: 20_000, 2: 1, 3: 0}
    assert licences.scan(d, licences.templates(spark), whole_text=True).where("licence is null").count() == 3
    assert {r["id"]: r["n_shingles"] for r in near_dup.cluster(d).collect()} == {1: 1, 2: 1, 3: 0}
    assert near_dup.keep_one(d).columns == d.columns and near_dup.keep_one(d).count() == 3
    assert {r["doc_id"]: r["_n_words"] for r in quality.judge(d).collect()} == {1: 20_000, 2: 1, 3: 0}


def test_scratch_tables_go(spark):
    from fluxwarden.llm import common

    with common.scratch(spark):
        t = common.written(spark.range(3), "gone")
        assert t.count() == 3
        path = t.inputFiles()[0].rpartition("/")[0]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_crc_is_the_usual_one():
    assert zlib.crc32(b"abc") == binascii.crc32(b"abc")
