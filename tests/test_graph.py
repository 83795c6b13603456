import random
from collections import deque

from tests.conftest import rows
from weftgraph.operators import graph

N = "id string, label string, domain string, subdomain string"
E = "id long, source_id string, target_id string, kind string, confidence double"
KINDS = ["triggers", "depends_on", "references", "composes"]


def model_bfs(nodes, edges, entries, depth, conf, limit, domains):
    order = {"triggers": 0, "depends_on": 1, "references": 2}
    found, seen, out = {}, set(), []
    for e in entries:
        if e in nodes:
            found.setdefault(e, 0)
    queue = deque((e, 0) for e in dict.fromkeys(entries))
    while queue and len(found) < limit:
        node, d = queue.popleft()
        if node in seen:
            continue
        seen.add(node)
        if d >= depth:
            continue
        for e in sorted((e for e in edges if e[1] == node and e[4] >= conf), key=lambda e: (order.get(e[3], 3), e[0])):
            t = e[2]
            if t in seen or t not in nodes or (domains and nodes[t] not in domains):
                continue
            out.append(e[0])
            if t not in found:
                found[t] = d + 1
            queue.append((t, d + 1))
    return found, out


def test_bfs_equals_a_queue(spark):
    rng = random.Random(11)
    all_nodes, all_edges, entries, expected = [], [], [], {}
    settings = (3, 0.3, 7)
    for g in range(12):
        nodes = {f"{g}n{i}": rng.choice("xy") for i in range(14)}
        ids = [*nodes, f"{g}ghost"]
        edges = [(g * 1000 + k, rng.choice(ids), rng.choice(ids), rng.choice(KINDS), rng.random()) for k in range(45)]
        start = [rng.choice(ids) for _ in range(3)]
        all_nodes += [(k, "Entity", d, "s") for k, d in nodes.items()]
        all_edges += edges
        entries += [(str(g), e, p) for p, e in enumerate(start)]
        expected[str(g)] = model_bfs(nodes, edges, start, *settings, {"x"} if g % 2 else None)
    nodes, edges = spark.createDataFrame(all_nodes, N), spark.createDataFrame(all_edges, E)
    for part, domains in ((0, ()), (1, ("x",))):
        own = spark.createDataFrame([e for e in entries if int(e[0]) % 2 == part], "qid string, id string, pos int")
        found, reported = graph.bfs(nodes, edges, own, *settings, domains)
        for q in {e[0] for e in entries if int(e[0]) % 2 == part}:
            assert {r.id: r.depth for r in found.where(f"qid = '{q}'").collect()} == expected[q][0]
            assert [r.edge_id for r in reported.where(f"qid = '{q}'").orderBy("ord").collect()] == expected[q][1]


def test_bfs_without_broadcasts(spark):
    """Large tables are joined by shuffles alone; a union of shuffled parts must not be taken for one that is parted by its key."""
    rng = random.Random(3)
    nodes = {f"n{i}": "x" for i in range(40)}
    edges = [(k, rng.choice([*nodes]), rng.choice([*nodes]), rng.choice(KINDS), rng.random()) for k in range(120)]
    starts = [(f"q{i}", f"n{i}", 1) for i in range(5)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found, reported = graph.bfs(spark.createDataFrame([(k, "Entity", d, "s") for k, d in nodes.items()], N), spark.createDataFrame(edges, E), spark.createDataFrame(starts, "qid string, id string, pos int"), 3, 0.3, 10_000)
        got, told = rows(found), reported.orderBy("ord").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for q, e, _ in starts:
        depths, ids = model_bfs(nodes, edges, [e], 3, 0.3, 10_000, None)
        assert {i: d for own, i, d in got if own == q} == depths
        assert [r.edge_id for r in told if r.qid == q] == ids


def _small(spark):
    nodes = spark.createDataFrame([(c, "Entity", "d", "s1" if c in "abc" else "s2") for c in "abcdefg"] + [("k", "Skill", "k", None)], N)
    pairs = ["ab", "bc", "ca", "de", "ef", "fd", "cd", "ba", "ab", "aa", "kz"]
    edges = spark.createDataFrame([(i, p[0], p[1], "depends_on", 0.9) for i, p in enumerate(pairs)], E)
    return nodes, edges


def test_structure_and_breaches(spark):
    nodes, edges = _small(spark)
    m = graph.structure(nodes, edges).first()
    assert (m.node_count, m.edge_count, m.subdomain_count, m.singleton_count) == (7, 8, 2, 1)
    q = 4 / 8 - (9 / 16) ** 2 + 3 / 8 - (7 / 16) ** 2
    assert abs(m.modularity_q - q) < 1e-8
    assert graph.breaches(graph.structure(nodes, edges), {"singleton_ratio": 0.1}, 0.5, 9).first().breached == ["singleton_ratio", "change_ratio"]
    empty = graph.structure(nodes, edges.limit(0)).first()
    assert empty.modularity_q == 0 and graph.breaches(graph.structure(nodes, edges.limit(0))).first().breached[0] == "modularity"


def test_neighbours_ghosts_components_and_louvain(spark):
    nodes, edges = _small(spark)
    near = {(r.id, r.neighbour): r.relation for r in graph.neighbours(edges, nodes).collect()}
    assert near["a", "b"] == "depends_on" and near["d", "c"] == "incoming: depends_on"
    assert rows(graph.ghosts(nodes, edges)) == [("z", None, None, "z")]
    comp = {r.id: r.component for r in graph.connected_components(edges, "source_id", "target_id").collect()}
    assert comp["f"] == "a" and comp["z"] == "k"
    com = {r.id: r.community for r in graph.louvain(graph.semantic_nodes(nodes), edges.where("source_id <> 'k'")).collect()}
    assert com["a"] == com["b"] == com["c"] and com["d"] == com["e"] == com["f"] and com["a"] != com["d"] and com["g"] == "g"


def test_long_path_is_one_component(spark):
    path = spark.createDataFrame([(f"{i:04}", f"{i + 1:04}") for i in range(400)], "a string, b string")
    assert {r.component for r in graph.connected_components(path, "a", "b").collect()} == {"0000"}


def test_path_of_shuffled_ids_is_one_component(spark):
    ids = [f"{i:04}" for i in range(1_000)]
    random.Random(5).shuffle(ids)
    late = [f"x{i:02}" for i in range(1, 81)] + ["x00"]
    path = spark.createDataFrame([*zip(ids, ids[1:]), *zip(late, late[1:])], "a string, b string")
    label = {r.id: r.component for r in graph.connected_components(path, "a", "b").collect()}
    assert len(label) == 1_081 and set(label.values()) == {"0000", "x00"}
    assert all(c == ("x00" if i[0] == "x" else "0000") for i, c in label.items())


def test_communities_reach_a_local_best_of_modularity(spark):
    rng = random.Random(8)
    pairs = {(f"p{i:02}", f"p{i + 1:02}") for i in range(80)}
    for g in range(6):
        pairs |= {(f"g{g}n{i}", f"g{g}n{j}") for i in range(8) for j in range(i) if rng.random() < 0.6}
        pairs.add((f"g{g}n0", f"g{(g + 1) % 6}n1"))
    pairs |= {("hub", f"leaf{i}") for i in range(30)} | {("hub", "p00")}
    edges = spark.createDataFrame([(i, a, b, "depends_on", 0.9) for i, (a, b) in enumerate(sorted(pairs))], E)
    nodes = spark.createDataFrame([(x, "Entity", "d", "s") for x in sorted({x for p in pairs for x in p} | {"alone"})], N)
    com = {r.id: r.community for r in graph.louvain(nodes, edges).collect()}
    degree, total = {}, len(pairs)
    for a, b in pairs:
        degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1

    def q(label):
        tot = {}
        for x, d in degree.items():
            tot[label[x]] = tot.get(label[x], 0) + d
        return sum(label[a] == label[b] for a, b in pairs) / total - sum((t / (2 * total)) ** 2 for t in tot.values())

    comp = {r.id: r.component for r in graph.connected_components(edges, "source_id", "target_id").collect()}
    found = q(com)
    assert com["alone"] == "alone" and found >= q(comp)
    joined = {frozenset((com[a], com[b])) for a, b in pairs if com[a] != com[b]}
    assert joined and all(q({x: (min(j) if c in j else c) for x, c in com.items()}) <= found + 1e-12 for j in joined)
