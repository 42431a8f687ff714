import math
import random

import pytest

from quillspan.operators import community as C


def quality(edges, label, resolution=2.0):
    two_m = 2 * sum(w for *_, w in edges)
    tot = {}
    for a, b, w in edges:
        tot[label[a]] = tot.get(label[a], 0) + w
        tot[label[b]] = tot.get(label[b], 0) + w
    return 2 * sum(w for a, b, w in edges if label[a] == label[b]) / two_m - resolution * sum(t * t for t in tot.values()) / two_m**2


def one_machine(edges, resolution=2.0):
    """Louvain in node order, one move at a time."""
    nodes = sorted({x for a, b, _ in edges for x in (a, b)})
    final, graph = {n: n for n in nodes}, list(edges)
    for _ in range(10):
        near, k, two_m = {}, {}, 2 * sum(w for *_, w in graph)
        for a, b, w in graph:
            near.setdefault(a, {})
            near.setdefault(b, {})
            k[a], k[b] = k.get(a, 0) + w, k.get(b, 0) + w
            if a != b:
                near[a][b] = near[a].get(b, 0) + w
                near[b][a] = near[b].get(a, 0) + w
        label, tot, any_move = {n: n for n in near}, dict(k), False
        for _ in range(20):
            moved = False
            for n in sorted(near):
                home = label[n]
                tot[home] -= k[n]
                links = {home: 0.0}
                for o, w in near[n].items():
                    links[label[o]] = links.get(label[o], 0.0) + w
                gain = {c: w - resolution * k[n] * tot[c] / two_m for c, w in links.items()}
                best = home
                for c in gain:
                    if gain[c] > gain[best] + 1e-12:
                        best = c
                tot[best] += k[n]
                label[n], moved = best, moved or best != home
            any_move = any_move or moved
            if not moved:
                break
        if not any_move:
            break
        final = {n: label[c] for n, c in final.items()}
        merged = {}
        for a, b, w in graph:
            key = tuple(sorted((label[a], label[b])))
            merged[key] = merged.get(key, 0) + w
        graph = [(a, b, w) for (a, b), w in merged.items()]
    return final


def bipartite(seed, groups, docs, concepts, inside, across):
    rnd = random.Random(seed)
    out = set()
    for d in range(groups * docs):
        for c in range(groups * concepts):
            if rnd.random() < (inside if d // docs == c // concepts else across):
                out.add((d, groups * docs + c, 1.0))
    return sorted(out)


def frame(spark, edges):
    return spark.createDataFrame(edges, "a long, b long, w double").repartition(3)


@pytest.mark.parametrize(("seed", "shape"), [(1, (4, 4, 12, 0.8, 0.02)), (2, (3, 5, 9, 0.5, 0.1))])
def test_modularity_is_not_below_one_machine(spark, seed, shape):
    edges = bipartite(seed, *shape)
    label, q, levels = C.louvain(frame(spark, edges))
    got = {r.node: r.community for r in label.collect()}
    assert set(got) == {x for a, b, _ in edges for x in (a, b)} and levels >= 1
    assert math.isclose(q, quality(edges, got), abs_tol=1e-9) and math.isclose(q, C.modularity(frame(spark, edges), label), abs_tol=1e-9)
    assert q >= quality(edges, one_machine(edges)) - 1e-9


def test_weights_loops_and_empty(spark):
    edges = [(1, 2, 5.0), (2, 3, 5.0), (1, 3, 5.0), (3, 4, 0.1), (4, 5, 5.0), (5, 6, 5.0), (4, 6, 5.0), (6, 6, 2.0), (2, 1, 1.0)]
    label, q, _ = C.louvain(frame(spark, edges), resolution=1.0)
    got = {r.node: r.community for r in label.collect()}
    assert len({got[n] for n in (1, 2, 3)}) == 1 and len({got[n] for n in (4, 5, 6)}) == 1 and got[1] != got[4]
    assert math.isclose(q, quality(edges, got, 1.0), abs_tol=1e-9)
    label, q, levels = C.louvain(frame(spark, []))
    assert (label.count(), q, levels) == (0, 0.0, 0)


def merged(edges, label, target):
    """The merge by definition: pairs of communities by falling density, a union where the size allows it."""
    of = {c: label[c] for _, c, _ in edges}
    size, between = {}, {}
    for c in of.values():
        size[c] = size.get(c, 0) + 1
    for d in {a for a, *_ in edges}:
        held = {}
        for a, c, _ in edges:
            if a == d:
                held[of[c]] = held.get(of[c], 0) + 1
        for x in held:
            for y in held:
                if x < y:
                    between[x, y] = between.get((x, y), 0) + held[x] * held[y]
    groups = [{c} for c in size]
    weight = lambda g: sum(size[c] for c in g)
    for x, y in sorted(between, key=lambda p: (-between[p] / (size[p[0]] * size[p[1]]), p)):
        gx, gy = next(g for g in groups if x in g), next(g for g in groups if y in g)
        if len(groups) > target and gx is not gy and weight(gx) + weight(gy) <= max(1, math.ceil(len(of) / target * 1.15)):
            groups = [g for g in groups if g is not gx and g is not gy] + [gx | gy]
    members = [sorted(c for c, k in of.items() if k in g) for g in groups]
    members.sort(key=lambda m: (-len(m), m[0]))
    return {c: i for i, m in enumerate(members) for c in m}


@pytest.mark.parametrize("target", [2, 3, 1])
def test_merging_equals_its_definition(spark, target):
    edges = bipartite(5, 6, 3, 5, 0.8, 0.12)
    rnd = random.Random(3)
    label = {c: 100 + (c - 18) // 5 * 2 + rnd.randrange(2) for _, c, _ in edges} | {a: 1 for a, *_ in edges}
    labels = spark.createDataFrame(list(label.items()), "node long, community long")
    got = {r.node: r.cluster for r in C.merged_clusters(frame(spark, edges), labels, target).collect()}
    assert got == merged(edges, label, target)
    assert C.merged_clusters(frame(spark, []), labels, target).count() == 0 == C.merged_clusters(frame(spark, edges), labels, 0).count()


def test_dense_ids_are_gapless(spark):
    rows = [(k, i) for k in (1, 0) for i in range(500)]
    got = C.dense_ids(spark.createDataFrame(rows, "kind int, id int").repartition(7), ["kind", "id"], "node").collect()
    assert {(r.kind, r.id): r.node for r in got} == {p: n for n, p in enumerate(sorted(rows))}


def test_unknown_ends_are_dropped_and_views_compose(spark):
    docs, concepts = spark.createDataFrame([(1, "A"), (2, "B")], "id int, label string"), spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id int, label string")
    mentions = spark.createDataFrame([(1, 1, 0.9), (1, 1, 0.8), (2, 1, 0.7), (2, 2, 0.9), (9, 2, 0.9), (1, 8, 0.9)], "version_id int, concept_id int, confidence double")
    nodes, edges = C.graph_index(docs, concepts, mentions)
    assert sorted(map(tuple, edges.select("src", "dst", "mentions").collect())) == [(0, 2, 2), (1, 2, 1), (1, 3, 1)]

    def see(**how):
        shown, kept = C.visible(nodes, edges, **how)
        return sorted(r.node for r in shown.collect()), kept.count()

    assert see(threshold=0) == ([0, 1, 2, 3, 4], 3)
    assert see(threshold=0, hide_isolated=True) == see() == ([0, 1, 2, 3], 3)
    assert see(only_book=2, threshold=2) == ([1, 2, 3], 2)
    assert see(books=False) == ([2, 3], 0) and see(books=False, hide_isolated=True) == ([], 0)
    found = nodes.where("label = 'y' or kind = 0")
    assert see(matched=found) == see() and see(matched=found, only_found=True) == ([0, 1, 3], 1)


def islands(seed, count):
    """Graphs without links among them, and one node number in thirteen used by each."""
    rnd = random.Random(seed)
    return [(x * 13 + i, y * 13 + i, w) for i in range(count) for x, y, w in bipartite(rnd.random(), 2, 3, 4, 0.8, 0.2)]


@pytest.mark.parametrize("block", [4, 500_000])
def test_components_that_fit_a_task_are_not_swept(spark, monkeypatch, block):
    edges = islands(4, 9) + [(13 * 50, 13 * 51, 1.0), (13 * 51, 13 * 52, 0.5), (13 * 52, 13 * 52, 2.0)]
    whole, q, levels = C.louvain(frame(spark, edges))
    monkeypatch.setattr(C, "MOST_EDGES", 40)
    monkeypatch.setattr(C, "_level", None)
    monkeypatch.setattr(C.local_moving, "BLOCK_EDGES", block)
    label, q_parts, levels_parts = C.louvain(frame(spark, edges))
    got = {r.node: r.community for r in label.collect()}
    assert got == {r.node: r.community for r in whole.collect()} and math.isclose(q, q_parts, abs_tol=1e-9) and levels == levels_parts
    assert math.isclose(q, quality(edges, got), abs_tol=1e-9) and q >= quality(edges, one_machine(edges)) - 1e-9


def test_larger_components_are_swept_and_others_not(spark, monkeypatch):
    edges = islands(7, 4) + [(a + 10_000, b + 10_000, w) for a, b, w in bipartite(1, 3, 4, 12, 0.8, 0.02)]
    monkeypatch.setattr(C, "MOST_EDGES", 40)
    sizes, level = [], C._level
    monkeypatch.setattr(C, "_level", lambda graph, *how: sizes.append(graph.count()) or level(graph, *how))
    label, q, _ = C.louvain(frame(spark, edges))
    got = {r.node: r.community for r in label.collect()}
    assert sizes and sizes[0] == len([1 for a, *_ in edges if a >= 10_000]) and min(sizes) > 40
    assert set(got) == {x for a, b, _ in edges for x in (a, b)} and math.isclose(q, quality(edges, got), abs_tol=1e-9)
    assert q >= quality(edges, one_machine(edges)) - 0.01


def test_forests_reach_what_edges_reach(spark, monkeypatch):
    rnd = random.Random(2)
    edges = [(a, a + rnd.randrange(1, 6), 1.0) for a in range(400) if rnd.random() < 0.7]
    root = {x: x for a, b, _ in edges for x in (a, b)}
    for _ in edges:
        for a, b, _ in edges:
            root[a] = root[b] = min(root[a], root[b])
    monkeypatch.setattr(C.local_moving, "BLOCK_EDGES", 7)
    assert {r.node: r.part for r in C._parts(frame(spark, edges)).collect()} == root


def test_clusters_go_on_until_nothing_moves(spark, sf):
    from quillspan.plans import graph

    pairs = {(f"c{r.concept_id}", f"v{r.version_id}") for r in graph.strong(spark, sf).select("version_id", "concept_id").collect()}
    number = {name: i for i, name in enumerate(sorted({x for p in pairs for x in p}))}
    edges = sorted((number[c], number[v], 1.0) for c, v in pairs)
    got = {number[r.node]: number[r.community] for r in graph.clusters(spark, sf).collect()}
    assert quality(edges, got) >= quality(edges, one_machine(edges)) - 1e-9


def test_merging_reads_the_edges_twice(spark):
    edges = bipartite(5, 6, 3, 5, 0.8, 0.12)
    labels = spark.createDataFrame([(x, x // 5) for x in sorted({b for _, b, _ in edges})], "node long, community long")
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    C.merged_clusters(frame(spark, edges).mapInArrow(run, "a long, b long, w double"), labels, 3).collect()
    assert 0 < seen.value <= 2 * len(edges)
