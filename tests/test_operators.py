"""Ranking, similarity joins, graph learning and metrics on small cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from engramlake.operators import graph, links, metrics, ranking
from engramlake.operators.components import connected_components
from engramlake.plans import jobs

CHUNK = "ord long, rel string, start_line int, text string, vector array<double>, type string, status string, tags array<string>"


def chunks(spark, rows):
    return spark.createDataFrame([(i, r[0], 1, r[1], r[2], *(r[3:] or ("note", "active", []))) for i, r in enumerate(rows)], CHUNK)


def ir(spark, retrieved, relevant, k):
    r = spark.createDataFrame([("q", d, i + 1) for i, d in enumerate(retrieved)], "query string, id string, rank int")
    rel = spark.createDataFrame([("q", d) for d in relevant] or [("q", None)], "query string, id string")
    return metrics.ir_metrics(r, rel, [k]).first()


def test_metrics_goldens(spark):
    five, rel = ["d1", "d2", "d3", "d4", "d5"], ["d2", "d4", "d6"]
    m = {k: ir(spark, five, rel, k) for k in (1, 3, 5)}
    assert [m[k]["recall"] for k in (1, 3, 5)] == pytest.approx([0, 1 / 3, 2 / 3])
    assert [m[k]["precision"] for k in (1, 3, 5)] == pytest.approx([0, 1 / 3, 0.4])
    assert m[5]["mrr"] == 0.5 and m[5]["ndcg"] == pytest.approx(0.49818925746641285)
    x = ir(spark, ["d1", "d2"], ["d2"], 5)
    assert x["precision"] == pytest.approx(0.2) and x["ndcg"] == pytest.approx(0.6309297535714575)
    e = ir(spark, ["d1"], [], 5)
    assert (e["recall"], e["ndcg"], e["precision"], e["mrr"]) == (1, 1, 0, 0)
    d = ir(spark, ["d2", "d2"], ["d2", "d4"], 2)
    assert (d["recall"], d["precision"]) == (0.5, 0.5)


def test_rrf_and_recall(spark):
    c = chunks(spark, [("a.md", "alpha beta", [1.0, 0.0]), ("b.md", "beta", [0.6, 0.8]), ("c.md", "beta beta", [0.0, 1.0])])
    got = {r["ord"]: r for r in ranking.rrf(ranking.scored(c, "beta", [1.0, 0.0])).collect()}
    assert got[0]["rrf"] == pytest.approx(1 / 60 + 1 / 61) and got[2]["rrf"] == pytest.approx(1 / 62 + 1 / 60)
    top = ranking.recall(c, "beta", [1.0, 0.0], 3)
    assert [(r["ord"], round(r["rrf"], 9)) for r in top.collect()] == sorted(((o, round(r["rrf"], 9)) for o, r in got.items()), key=lambda x: (-x[1], x[0]))
    assert [r["ord"] for r in ranking.recall(c, "alpha", None, 3).collect()] == [0]
    entries = spark.createDataFrame([("c.md", 9, None, 0.9)], "rel string, access int, last_access_ms long, importance double")
    assert ranking.recall(c, "beta", [1.0, 0.0], 1, entries, 0).first()["ord"] == 2
    with pytest.raises(TypeError):
        ranking.recall(c, "beta", k="8")


def test_rrf_top_equals_full_ranking(spark):
    rng = random.Random(3)
    c = chunks(spark, [(f"{i}.md", " ".join(rng.choice(["beta", "x", "y"]) for _ in range(6)), [rng.uniform(-1, 1), rng.uniform(-1, 1)]) for i in range(1500)])
    s = ranking.scored(c, "beta", [1.0, 0.2])
    key = lambda df: [(r["ord"], round(r["rrf"], 12)) for r in df.orderBy(F.desc("rrf"), "ord").limit(8).collect()]
    assert key(ranking.rrf_top(s, 8)) == key(ranking.rrf(s))


def test_filters_come_before_ranks(spark):
    c = chunks(spark, [("a", "beta", [1.0], "x", "active", ["t"]), ("b", "beta", [1.0], "y", "active", []), ("c", "beta", [1.0], "x", "old", ["t"])])
    assert [r["ord"] for r in ranking.filter_meta(c, type="x", status="active", tag="t").collect()] == [0]


def test_two_stage_rerank(spark):
    def final(scores, head):
        df = spark.createDataFrame([(i, s) for i, s in enumerate(scores)], "pos long, rerank double")
        return [r["pos"] for r in ranking.two_stage_rerank(df, head).orderBy("final").collect()]

    assert final([0.1, 0.9, 0.9, 5.0], 3) == [1, 2, 0, 3]
    assert final([float("nan"), 0.2, 0.1], 3) == [1, 2, 0]
    assert final([None, 0.2, 0.1], 3) == [0, 1, 2]


def greedy(edges, cap):
    deg, out = {}, set()
    for w, a, b in sorted(edges, key=lambda e: (-e[0], e[1], e[2])):
        if deg.get(a, 0) < cap and deg.get(b, 0) < cap:
            deg[a], deg[b] = deg.get(a, 0) + 1, deg.get(b, 0) + 1
            out.add((a, b))
    return out


def test_degree_cap_equals_the_sequential_scan(spark):
    for seed in range(3):
        rng = random.Random(seed)
        edges = [(round(rng.random(), 1), f"n{a:02d}", f"n{b:02d}") for a in range(18) for b in range(a + 1, 18) if rng.random() < 0.5]
        df = spark.createDataFrame([(a, b, w) for w, a, b in edges], "a string, b string, weight double")
        assert {(r["a"], r["b"]) for r in ranking.degree_cap(df, 2).collect()} == greedy(edges, 2)


def test_mmr_golden(spark):
    z = lambda x, y: math.sqrt(1 - x * x - y * y)
    rows = [("s", "A", 0.8, [0.8, 0.6, 0.0]), ("s", "B", 0.75, [0.75, 0.65, z(0.75, 0.65)]), ("s", "C", 0.55, [0.55, 0.0, z(0.55, 0)])]
    df = spark.createDataFrame(rows, "seed string, id string, rel double, vector array<double>")
    got = [(r["id"], round(r["mmr"], 4)) for r in ranking.mmr(df, 3, 0.5).orderBy("pos").collect()]
    assert got == [("A", 0.8), ("C", 0.33), ("B", 0.255)]
    assert [r["id"] for r in ranking.mmr(df, 3, 0.0).orderBy("pos").collect()] == ["A", "B", "C"]


def test_all_pairs_of_mixed_sizes(spark):
    rows = [(i, [1.0, i / 100] if i % 2 else [1.0, 0.0, i / 100]) for i in range(20)]
    each = [{(r["a"], r["b"]) for r in links.all_pairs(spark.createDataFrame(rows, "id long, vector array<double>"), 0.5, block=b).collect()} for b in (100, 7)]
    assert each[0] == each[1] == {(a, b) for a in range(20) for b in range(a + 1, 20) if a % 2 == b % 2}


def test_all_pairs_in_blocks(spark):
    rng = random.Random(5)
    rows = [(f"n{i}", [rng.gauss(0, 1) for _ in range(4)]) for i in range(40)]
    df = spark.createDataFrame(rows, "id string, vector array<double>")
    got = {(r["a"], r["b"]): r["sim"] for r in links.all_pairs(df, 0.5, block=7).collect()}

    def cos(x, y):
        return sum(p * q for p, q in zip(x, y)) / math.hypot(*x) / math.hypot(*y)

    want = {tuple(sorted((a, b))): round(cos(x, y), 6) for i, (a, x) in enumerate(rows) for b, y in rows[:i] if round(cos(x, y), 6) >= 0.5}
    assert got == pytest.approx(want)


def test_links_band_and_reconcile_bounds(spark):
    unit = lambda c: [c, math.sqrt(1 - c * c)]
    notes = spark.createDataFrame([("a", [1.0, 0.0]), ("b", unit(0.35)), ("c", unit(0.85))], "id string, vector array<double>")
    got = {(r["a"], r["b"]): r["weight"] for r in links.build_links(notes).collect()}
    assert got[("a", "b")] == pytest.approx(0.09, abs=1e-6) and ("a", "c") not in got
    c = chunks(spark, [("x", "one", [1.0, 0.0]), ("y", "two", unit(0.9))])
    cands = spark.createDataFrame([("same", [1.0, 0.0]), ("mid", unit(0.85)), ("far", [0.0, -1.0]), ("none", None)], "id string, vector array<double>")
    r = {x["id"]: x for x in links.reconcile(cands, c).collect()}
    assert [r[k]["action"] for k in ("same", "mid", "far", "none")] == ["skip", "skip", "new", "new"]
    assert [m["path"] for m in r["same"]["matches"]] == ["x", "y"] and r["none"]["top_score"] is None
    assert links.reconcile(cands, c.limit(0)).where("action <> 'new'").count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(1, 1), (None, 2)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def rounds(spark, weights, n=3, edges=(("a", "b"),)):
    g = spark.createDataFrame([], graph.EDGE)
    for k in range(1, n + 1):
        w = weights[k - 1] if isinstance(weights, list) else weights
        rows = [(a, b, w) for a, b in edges] if w is not None else []
        g = graph.reinforce(g, spark.createDataFrame(rows, "a string, b string, weight double"), k)
    return g


def test_reinforcement_goldens(spark):
    for n, want in zip((1, 3, 5), (0.88, 1.04, 1.20)):
        assert rounds(spark, 0.8, n).first()["neural_score"] == pytest.approx(want)
    assert rounds(spark, [1.0, 0.0], 2).first()["ema"] == 0.5
    old = spark.createDataFrame([("a", "b", 1, 1, 1, 0.8)], graph.EDGE)
    none = spark.createDataFrame([], "a string, b string, weight double")
    assert graph.reinforce(old, none, 13).count() == 1 and graph.reinforce(old, none, 14).count() == 0
    own = spark.createDataFrame([("a", "a", 1.0), ("b", None, 1.0)], "a string, b string, weight double")
    assert graph.reinforce(spark.createDataFrame([], graph.EDGE), own, 1).count() == 0


def scored_edges(spark, pairs, score=1.17, recurrence=3):
    return spark.createDataFrame([(*sorted(p), score, recurrence) for p in pairs], "a string, b string, neural_score double, recurrence long")


def test_clusters(spark):
    got = graph.dense_clusters(scored_edges(spark, [("a", "b"), ("b", "c"), ("d", "e")])).collect()
    assert sorted(len(c["members"]) for c in got) == [2, 3]
    chain = graph.dense_clusters(scored_edges(spark, [(str(i), str(i + 1)) for i in range(9)])).collect()
    assert sorted("".join(c["members"]) for c in chain) == ["012", "234", "456", "678", "89"]
    clique = [(x, y) for i, x in enumerate("wxyz") for y in "wxyz"[:i]]
    c = graph.dense_clusters(scored_edges(spark, clique)).first()
    assert c["density"] == 1 and c["strength"] == pytest.approx(7.02)
    assert graph.promotable(graph.dense_clusters(scored_edges(spark, clique))).count() == 1
    assert graph.promotable(graph.dense_clusters(scored_edges(spark, [("a", "b")]))).count() == 0
    assert graph.promotable(graph.dense_clusters(scored_edges(spark, clique, recurrence=1))).count() == 0


def test_insights(spark):
    kind = "cluster string, members array<string>, strength double"
    none = spark.createDataFrame([], graph.INSIGHT)
    once = graph.merge_insights(none, spark.createDataFrame([("k", ["a", "b", "c"], 2.0)], kind), 1)
    twice = graph.merge_insights(once, spark.createDataFrame([("m", ["a", "b", "c", "d"], 2.5)], kind), 2).collect()
    assert [(x["runs"], x["status"], x["size"], x["first_ms"], x["last_ms"]) for x in twice] == [(2, "promoted", 4, 1, 2)]
    other = graph.merge_insights(once, spark.createDataFrame([("m", ["c", "x", "y"], 2.5)], kind), 2)
    assert sorted(x["runs"] for x in other.collect()) == [1, 1]


def test_contradictions_and_themes(spark):
    m = spark.createDataFrame([("k", "a", 0), ("k", "b", 1), ("k", "c", 2)], "cluster string, id string, pos int")
    notes = spark.createDataFrame([("a", "We prefer dark roast coffee"), ("b", "Never serve dark coffee"), ("c", "Plain dark text")], "id string, text string")
    assert [(r["a"], r["b"], sorted(r["shared"])) for r in graph.contradictions(m, notes).collect()] == [("a", "b", ["coffee", "dark"])]
    assert graph.theme_labels(m, notes).first()["theme"] == "dark · coffee"


def test_pooling(spark):
    c = chunks(spark, [("a", "first", [2.0, 0.0]), ("b", "x", [1.0, 0.0]), ("b", "y", [0.0, 1.0])])
    got = {r["rel"]: r["vector"] for r in graph.pool_notes(c).collect()}
    assert got["a"] == [2.0, 0.0] and got["b"] == pytest.approx([math.sqrt(0.5)] * 2)


def test_save_and_signals(spark):
    c = chunks(spark, [("x", "one", [1.0, 0.0])])
    rows = [(1, "fact", "password: hunter2hunter2", [0.0, 1.0]), (2, "fact", "password: hunter2hunter2", [0.0, 1.0]), (3, "", "same", [1.0, 0.0]), (4, "preference", "near", [0.9, math.sqrt(0.19)])]
    got = jobs.save_notes(spark.createDataFrame(rows, "id long, type string, text string, vector array<double>"), spark.createDataFrame([], "path string"), c).orderBy("id").collect()
    assert [(r["id"], r["review"]) for r in got] == [(1, False), (4, True)] and "[REDACTED]" in got[0]["text"] and got[1]["path"].startswith("memory/00-core/near-")
    m = spark.createDataFrame([(0, "user", "We shipped it today. nothing here. We shipped it today."), (1, "bot", "Actually that is wrong")], "ord long, role string, text string")
    assert [(r["pos"], r["role"], r["tags"]) for r in jobs.high_signal(m).collect()] == [(0, "user", ["milestone"]), (1, "bot", ["correction"])]
    assert jobs.capture(m, 0, 1000).count() == 2 and jobs.capture(m, 0, 121_000).first()["mode"] == "reference"


@pytest.mark.parametrize("n, want", [(1999, []), (2000, ["--with-reranker"]), (7999, ["--with-reranker"]), (8000, ["--with-sqlite-vec", "--with-reranker"])])
def test_advisor_bounds(spark, n, want):
    s = spark.createDataFrame([(n, 0, 1, True, False, False)], "chunks long, content_ms long, index_ms long, has_cron boolean, has_store boolean, has_model boolean")
    assert [r["flag"] for r in jobs.advise(s).collect()] == want


def test_search_equals_brute_force_over_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    vec = [[float(x) for x in rng.normal(size=4)] for _ in range(60)]
    vec[7] = vec[3]  # a tie, which goes by ord
    rows = spark.createDataFrame([(i, f"n{i // 2}", vec[i], 0.5 + i % 3) for i in range(60)] + [(90, "odd", [1.0], 1.0), (91, "none", None, 1.0), (92, "nan", [float("nan")] * 4, 1.0)], "ord long, rel string, vector array<double>, weight double")
    queries = rows.where("ord % 10 = 0 and ord < 60 or ord = 91").select(F.col("ord").alias("id"), "rel", "vector")
    unit = np.array(vec) / np.linalg.norm(vec, axis=1)[:, None]
    for k, least, block in ((5, None, 7), (None, 0.2, 7), (5, None, 1000)):
        got = {}
        for r in links.search(queries, rows, k, least, block=block).collect():
            got.setdefault(r["query"], []).append((-r["score"], r["ord"]))
        for q in range(0, 60, 10):
            sims = [(i, round(float(unit[q] @ unit[i]), 6)) for i in range(60) if i // 2 != q // 2]
            want = sorted((-round(s * (0.5 + i % 3), 6), i) for i, s in sims if least is None or s >= least)[:k]
            assert [i for _, i in sorted(got.get(q, []))] == [i for _, i in want]
        assert 91 not in got
    none = rows.limit(0)
    assert links.search(queries, none, 5).count() == 0 and links.search(none.select(F.col("ord").alias("id"), "vector"), rows, 5).count() == 0


def test_reconcile_holds_an_edit_against_other_notes_only(spark):
    rows = spark.createDataFrame([(1, "a", "one", [1.0, 0.0]), (2, "b", "two", [0.9, 0.1]), (3, "c", "three", [0.0, 1.0])], "ord long, rel string, text string, vector array<double>")
    edit = spark.createDataFrame([(10, "a", [1.0, 0.0]), (11, None, [1.0, 0.0]), (12, "z", None)], "id long, rel string, vector array<double>")
    got = {r["id"]: (r["action"], [m["path"] for m in r["matches"]]) for r in links.reconcile(edit, rows).collect()}
    assert got == {10: ("skip", ["b"]), 11: ("skip", ["a", "b"]), 12: ("new", [])}


def test_numbered_over_ranges(spark):
    rows = [(i, None if i % 5 == 0 else i * 7 % 13) for i in range(200)]
    df = spark.createDataFrame(rows, "ord long, v long").repartition(5)
    got = {r["ord"]: r["at"] for r in ranking.numbered(df, [F.desc_nulls_last("v"), F.asc("ord")], "at").collect()}
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == {r[0]: n for n, r in enumerate(want)}
    assert ranking.numbered(df.limit(0), [F.asc("ord")], "at").count() == 0


def test_capped_links_by_ranges_of_weight(spark):
    """Ranges of a few links, with ties that fall to the rounds over all tasks, keep what a scan of all links keeps; and
    rows without a vector make no blocks."""
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)] if i % 4 else None, 86_400_000 * int(i * 37 % 50), [f"E{i % 9}"]) for i in range(120)]
    notes = spark.createDataFrame(rows, "id long, vector array<double>, ms long, entities array<string>")
    options = {"floor": 0.35, "ceil": 0.85, "window": 14.0}
    degree, want = [0] * 120, set()
    for r in sorted(links.build_links(notes, per_node=None).collect(), key=lambda r: (-r.weight, r.a, r.b)):
        if degree[r.a] < 3 and degree[r.b] < 3:
            degree[r.a], degree[r.b] = degree[r.a] + 1, degree[r.b] + 1
            want.add((r.a, r.b))
    for batch in (20, 200):
        assert {(r.a, r.b) for r in links.capped(notes, 3, options, batch).collect()} == want
    none = spark.range(50_000).selectExpr("id + 1000 as id", "cast(null as array<double>) as vector", "0L as ms", "array('x') as entities")
    grid, _ = links._grid(notes.unionByName(none))
    assert grid.selectExpr("max(j)").first()[0] == 0


def test_clusters_equal_a_plain_scan_and_are_written_once(spark):
    rng = random.Random(3)
    names = [str(i) for i in range(40)] + ["1|2", "3|"]
    edges = {tuple(sorted(rng.sample(names, 2))): rng.choice([0.4, 0.5, 0.6]) for _ in range(160)}
    free, want = set(names), {}
    for a, b in sorted(edges, key=lambda e: (-edges[e], f"{e[0]}|{e[1]}")):
        if a in free or b in free:
            m = [a, b]
            while len(m) < 12:
                n = {x: sum(tuple(sorted((x, y))) in edges for y in m) for x in free - set(m)}
                best = min(n, key=lambda x: (-n[x], x), default=None)
                if best is None or n[best] < max(1, math.ceil(0.34 * len(m))):
                    break
                m.append(best)
            free -= set(m)
            want[f"{a}|{b}"] = sorted(m)
    got = graph.dense_clusters(spark.createDataFrame([(a, b, w, 2) for (a, b), w in edges.items()], "a string, b string, neural_score double, recurrence long"))
    assert {r.cluster: r.members for r in got.collect()} == want
    assert got.inputFiles()  # else each reader grows the clusters anew


def test_mmr_by_seed_equals_passes(spark):
    rng = random.Random(4)
    rows = [(s, i, round(rng.uniform(0.2, 0.8), 1), [rng.gauss(0, 1) for _ in range(3)]) for s in range(4) for i in range(30)]
    c = spark.createDataFrame(rows, "seed long, id long, rel double, vector array<double>")
    shown = lambda df: {(r.seed, r.pos): (r.id, r.rel, round(r.redundancy, 9), round(r.mmr, 9)) for r in df.collect()}
    got = shown(ranking.mmr(c))
    assert len(got) == 32 and got == shown(ranking.mmr(c, most=10))


def test_capped_links_of_named_notes_without_dates(spark):
    """As the learn job has them: ids are names, there are no times and no entities."""
    rng = random.Random(6)
    notes = spark.createDataFrame([(f"n/{i}", [rng.gauss(0, 1) for _ in range(5)]) for i in range(60)], "id string, vector array<double>")
    every = links.build_links(notes, floor=0.2, per_node=None).collect()
    want = greedy([(r.weight, r.a, r.b) for r in every], 2)
    options = {"floor": 0.2, "ceil": 0.85, "window": 14.0}
    assert {(r.a, r.b) for r in links.capped(notes, 2, options, 60).collect()} == want


def test_pairs_of_blocks_are_read_not_shuffled(spark):
    """A row goes to each of its pairs of blocks by reading; shuffled, it would be on disk once for each of them."""
    rng = random.Random(7)
    rows = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(90)], "id long, vector array<double>")
    pairs = links.all_pairs(rows, 0.5, block=10)
    assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString()
    grid, _ = links._grid(rows, block=10)
    held = {}
    for r in grid.select("i", "j", "own", "id").collect():
        held.setdefault((r.i, r.j), []).append((r.own, r.id))
    of = {n: sorted(x for x in held[n, n]) for n in range(9)}
    assert sorted(x for n in of for x in of[n]) == sorted((o, i) for o, i in {x for v in held.values() for x in v}) and sum(map(len, of.values())) == 90
    assert {k: sorted(v) for k, v in held.items()} == {(i, j): of[i] if i == j else of[i] + of[j] for i in range(9) for j in range(i, 9)}


def test_embedded_chunks_are_those_with_a_vector(spark):
    from engramlake.plans import views

    sf, shown = "/root/testdata/sf0.01", ["ord", "rel", "start_line", "text", "vector", "label"]
    got = views.embedded(spark, sf).select(shown)
    want = views.chunk(spark, sf).where("vector is not null").select(shown)
    assert got.count() == want.count() == 500 and not got.exceptAll(want).count()
