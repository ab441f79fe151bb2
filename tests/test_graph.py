"""The graph of hosts against plain Python: ties, self-loops, missing hosts, one host with most flows, chains in time."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta, timezone

import pytest

from fluxwarden.operators import graph

FLOW = "flow_id bigint, ts timestamp, src_ip string, dst_ip string, dst_port int, orig_bytes bigint"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(2), []
    for i in range(600):
        hosts = ["hub", "hub", "hub", *[f"h{k}" for k in range(12)]]
        out.append((i, START + timedelta(seconds=rng.choice([0, 1]) + 40 * (i // 2)), rng.choice(hosts), rng.choice(hosts), rng.choice([445, 80, None]), rng.choice([None, 10, 500])))
    return out + [(700, START, "", "h1", 80, 1), (701, START, None, "h1", 80, 1), (702, START, "h1", None, 80, 1)]


def plain(rows, within_s, most):
    edges = sorted((r for r in rows if r[2] and r[3]), key=lambda r: (r[1], r[0]))
    out_degree, in_degree, sent = Counter(), Counter(), Counter()
    dsts, srcs, got, depth, reached = defaultdict(set), defaultdict(set), {}, {}, defaultdict(list)
    for at in sorted({r[1] for r in edges}):
        now = [r for r in edges if r[1] == at]
        for i, _, s, d, _, n in now:
            new = d not in dsts[s]
            out_degree[s] += 1
            dsts[s].add(d)
            sent[s] += n or 0
            source = (new, out_degree[s], in_degree[s], len(dsts[s]), len(srcs[s]), sent[s])
            in_degree[d] += 1
            srcs[d].add(s)
            got[i] = (*source, in_degree[d], len(srcs[d]))
            depth[i] = min(most, 1 + max([k for t, k in reached[s] if t < at and (at - t).total_seconds() <= within_s], default=0))
        for i, _, _, d, *_ in now:
            reached[d].append((at, depth[i]))
    return got, depth


@pytest.mark.parametrize("slice_s", [60, 86400])
def test_features_and_chains(spark, rows, slice_s):
    d = spark.createDataFrame(rows, FLOW).repartition(4)
    want, depth = plain(rows, 100, 4)
    names = ["new_neighbour", "out_degree", "in_degree", "unique_dsts", "unique_srcs", "bytes_sent", "dst_in_degree", "dst_unique_srcs"]
    assert {r["flow_id"]: tuple(r[n] for n in names) for r in graph.edge_features(d, slice_s).collect()} == want
    found = {r["flow_id"]: r["chain_depth"] for r in graph.with_chain_depth(d, 100, 4, slice_s).collect()}
    assert found == depth and set(depth.values()) == {1, 2, 3, 4}


def test_alerts_follow_the_threshold(spark, rows):
    d = spark.createDataFrame(rows, FLOW)
    assert graph.graph_lateral_alerts(d, threshold=1.0).count() == 0
    few = {r["flow_id"]: r for r in graph.graph_lateral_alerts(d, threshold=0.9, within_s=100).collect()}
    many = {r["flow_id"] for r in graph.graph_lateral_alerts(d, threshold=0.5, within_s=100).collect()}
    assert few and few.keys() < many and all(r["confidence"] >= 0.9 and r["mitre_ttps"] == ["T1021", "T1570", "T1550"] for r in few.values())
    assert graph.graph_lateral_alerts(d.limit(0)).count() == 0
