"""Queries over their whole tables against brute force in Python."""

import json
import math
from collections import defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pytest

from lodespark.operators import graph, mining
from lodespark.plans import catalog


def rows_of(sf, table, columns):
    return duckdb.sql(f"SELECT {columns} FROM read_parquet('{sf}/{table}.parquet')").fetchall()


def shared(rows, hub_share=0.5, least=8):
    by, names = defaultdict(set), set()
    for a, k in rows:
        if a is not None and k is not None:
            by[k].add(a)
            names.add(a)
    got = defaultdict(list)
    for held in by.values():
        if len(names) < least or len(held) <= hub_share * len(names):
            for pair in combinations(sorted(held), 2):
                got[pair].append(math.log((len(names) + 1) / (len(held) + 0.5)) if len(names) >= least else 1.0)
    return {p: (len(x), round(1 - 0.5 ** sum(x), 4)) for p, x in got.items()}


def same_edges(got, want):
    got = {(r["src"], r["dst"]): (r["n"], r["weight"]) for r in got.collect()}
    assert got.keys() == want.keys()
    assert all(got[p][0] == want[p][0] and got[p][1] == pytest.approx(want[p][1], abs=1.1e-4) for p in want)


def test_shared_key_edges_keep_large_keys(spark):
    rows = [(f"n{i:03}", 0) for i in range(250)] + [(f"n{i:03}", 1 + i % 7) for i in range(600)] + [(f"n{i:03}", 99) for i in range(400)] + [(None, 0), ("n001", None), ("n001", 0)]
    want = shared(rows)
    assert ("n000", "n249") in want
    for cell in (10**6, 3000):
        same_edges(mining.shared_key_edges(spark.createDataFrame(rows, "note string, key int"), "note", "key", cell_pairs=cell), want)


def test_shared_key_edges_query_takes_every_key(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    rows = [r[:2] for r in rows_of(sf, "ci_imports", "from_file_id, to_file_id, resolution") if r[2] == "internal"]
    same_edges(catalog.core_queries()["shared_key_edges"](spark, sf), shared(rows))


def tarjan(edges):
    """node -> smallest node of its strong component."""
    out = defaultdict(list)
    for a, b in edges:
        out[a].append(b)
    index, low, stack, on, comp = {}, {}, [], set(), {}
    for root in {x for e in edges for x in e}:
        if root in index:
            continue
        work = [(root, iter(out[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            v, rest = work[-1]
            for w in rest:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(out[w])))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    members = stack[stack.index(v) :]
                    del stack[-len(members) :]
                    on -= set(members)
                    comp |= {m: min(members) for m in members}
    return comp


def longest_paths(edges, comp):
    """component -> longest path from a source."""
    up = defaultdict(set)
    for a, b in edges:
        if comp[a] != comp[b]:
            up[comp[b]].add(comp[a])
    layer = dict.fromkeys(comp.values(), 0)
    changed = True
    while changed:
        changed = False
        for c, before in up.items():
            new = max(layer[b] + 1 for b in before)
            changed, layer[c] = changed or new != layer[c], new
    return layer


def order_edges(sf):
    orders = defaultdict(list)
    for o, *line in rows_of(sf, "lineitem", "l_orderkey, l_linenumber, l_partkey, l_suppkey"):
        orders[o].append(line)
    return {(a[1], b[1]) for x in orders.values() for a, b in zip(sorted(x), sorted(x)[1:]) if a[1] != b[1]}


def test_strong_components_of_a_giant_component(spark):
    edges = [(i, (i * 7 + 3) % 40) for i in range(40)] + [(i, (i + 1) % 40) for i in range(40)] + [(50, 51), (51, 50), (51, 3), (7, 60), (60, 61), (61, 62), (62, 60)]
    edges = [e for e in edges if e[0] != e[1]]
    e = spark.createDataFrame(edges, "src bigint, dst bigint")
    comp = graph.strong_components(e)
    assert {r[0]: r[1] for r in comp.collect()} == tarjan(edges)
    assert {r["component"]: r["layer"] for r in graph.layers(e, comp).collect()} == longest_paths(edges, tarjan(edges))


def test_order_graph_queries_take_every_line(spark, sf):
    edges = order_edges(sf)
    comp = tarjan(edges)
    assert {r["node"]: r["component"] for r in catalog.core_queries()["strong_components"](spark, sf).collect()} == comp
    assert {r["component"]: r["layer"] for r in catalog.core_queries()["condensation_layers"](spark, sf).collect()} == longest_paths(edges, comp)


def test_dismissal_penalty_counts_every_session(spark, sf):
    seen = defaultdict(set)
    for user, kind, props in rows_of(sf, "events", "user_id, event_type, props"):
        target = json.loads(props).get("k") if props else None
        if user is not None and target is not None and kind not in ("view", "click", "purchase", "signup"):
            seen[str(target)].add(user)
    assert any(u % 3 for users in seen.values() for u in users)
    got = {r["target"]: (r["dismissals"], r["penalty"]) for r in catalog.core_queries()["dismissal_penalty"](spark, sf).collect()}
    assert got == {t: (len(u), 1.5 * min(len(u), 3) / 3) for t, u in seen.items()}


def import_edges(sf):
    rows = rows_of(sf, "ci_imports", "from_file_id, to_file_id, resolution")
    return {(a, b) for a, b, r in rows if r == "internal" and a is not None and b is not None and a != b}


def test_pagerank_query_iterates_until_it_converges(spark, sf):
    edges = import_edges(sf)
    out = defaultdict(list)
    for a, b in edges:
        out[a].append(b)
    nodes = {x for e in edges for x in e}
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(40):
        loose = sum(rank[v] for v in nodes if v not in out)
        new = dict.fromkeys(nodes, 0.15 / len(nodes) + 0.85 * loose / len(nodes))
        for a in out:
            for b in out[a]:
                new[b] += 0.85 * rank[a] / len(out[a])
        moved, rank = sum(abs(new[v] - rank[v]) for v in nodes), new
        if moved < 1e-9:
            break
    got = {r["node"]: r["rank"] for r in catalog.core_queries()["pagerank"](spark, sf).collect()}
    assert got.keys() == rank.keys()
    assert max(abs(got[v] - rank[v]) for v in nodes) < 6e-8


def test_label_communities_query_runs_all_rounds(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    near = defaultdict(set)
    for a, b in import_edges(sf):
        near[a].add(b)
        near[b].add(a)
    label = {v: v for v in near}
    for _ in range(20):
        votes = {v: [label[w] for w in near[v]] for v in near}
        old, label = label, {v: min(x, key=lambda c: (-x.count(c), c)) for v, x in votes.items()}
        if label == old:
            break
    assert {r["node"]: r["label"] for r in catalog.core_queries()["label_communities"](spark, sf).collect()} == label


def test_vector_queries_answer_every_search(spark, sf):
    rows = rows_of(sf, "embeddings", "vec_id, embedding, label")
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    sims = {r[0]: dict(zip([y[0] for y in rows], x @ x[i])) for i, r in enumerate(rows) if r[0] % 20 == 0}
    order = {q: sorted(s, key=lambda i, s=s: (-s[i], i)) for q, s in sims.items()}
    label = {r[0]: r[2] for r in rows}
    q = catalog.core_queries()

    def got(name, value):
        return {(r["query"], r["id"]): r[value] for r in q[name](spark, sf).collect()}

    assert got("cosine_topk", "sim") == pytest.approx({(a, i): sims[a][i] for a in sims for i in order[a][:10]}, abs=2e-6)
    assert got("fuzzy_scores", "score") == pytest.approx({(a, i): (min(1, v) - 0.1) * 5 for a in sims for i, v in sims[a].items() if min(1, v) >= 0.1}, abs=1e-5)
    values = {a: np.array(list(s.values())) for a, s in sims.items()}
    assert {r["query"]: r["threshold"] for r in q["adaptive_threshold"](spark, sf).collect()} == pytest.approx({a: min(0.45, max(0.22, v.mean() + 1.5 * v.std())) for a, v in values.items()}, abs=2e-6)
    want = {(a, i): 1 / (61 + k) for a in sims for k, i in enumerate(order[a])}
    for a in sims:
        for k, i in enumerate(sorted(i for i in label if label[i] == label[a])):
            want[a, i] += 1 / (61 + k)
    assert got("rank_fusion", "score") == pytest.approx(want, abs=2e-8)


def test_seeds_grow_with_the_data(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    edges = import_edges(sf)
    back, q = defaultdict(set), catalog.core_queries()
    for a, b in edges:
        back[b].add(a)
    hop = {b: 0 for _, b in edges if b % 20 == 0}
    assert max(hop) > 99
    for n in range(1, 5):
        hop |= {a: n for b in [b for b, h in hop.items() if h == n - 1] for a in back[b] if a not in hop}
    assert {r["node"]: r["hop"] for r in q["blast_radius"](spark, sf).collect()} == hop
    seeds = {b for _, b in edges if b % 20 == 0}
    near = {b for a, b in edges if a in seeds} | {a for a, b in edges if b in seeds}
    assert {r["node"] for r in q["import_affinity"](spark, sf).collect()} == near
    assert seeds <= {r["node"] for r in q["personalised_walk"](spark, sf).collect()}


def test_related_notes_are_those_of_every_note(spark, sf):
    """Notes of all numbers are asked for, and vectors of all numbers link them."""
    got = catalog.core_queries()["related_notes"](spark, sf).collect()
    docs = {r[0] for r in rows_of(sf, "documents", "doc_id")}
    asked = {r["note"] for r in got}
    assert asked <= docs and any(n % 20 for n in asked)
    pairs = {(r["note"], r["other"]) for r in got}
    vec = dict(rows_of(sf, "embeddings", "vec_id, embedding"))
    x = {i: np.array(v) / np.linalg.norm(v) for i, v in vec.items()}
    weight = lambda a, b: round(min(1.0, max(0.0, (float(x[a] @ x[b]) - 0.3) / 0.7)), 4)
    exact = {(r["note"], r["other"]): r["exact"] for r in got}
    alone = [n for n in docs & set(x) if not any(e for (a, _), e in exact.items() if a == n)]
    for n in alone:  # nothing but vectors links these
        best = sorted((-weight(n, o), o) for o in x if o != n and weight(n, o) >= 0.3)[:8]
        assert {o for _, o in best} == {b for a, b in pairs if a == n}
