"""Problems 3, 6, 8, 9 and 10: brute force, held-out accuracy, ties, nulls, repeats, empty tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenewright.llm import canonical, components, content, leakage, mixing


def union_find(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("kind", ["chain", "star", "random", "none", "loops"])
def test_components(spark, kind):
    r = random.Random(5)
    edges = {
        "chain": [(i, i + 1) for i in range(60)],
        "star": [(0, i) for i in range(1, 80)] + [(7, 7)],
        "random": [(r.randrange(200), r.randrange(200)) for _ in range(150)],
        "none": [],
        "loops": [(3, 3), (4, 4), (4, 5), (5, 4), (None, 1), (2, None)],
    }[kind]
    got = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = union_find([e for e in edges if None not in e])
    assert set(got) == set(want)
    assert {frozenset(k for k in got if got[k] == v) for v in got.values()} == {frozenset(k for k in want if want[k] == v) for v in want.values()}


def test_grouped_records(spark):
    m = spark.createDataFrame(
        [("b", "a", 1, 2), ("a", "b", 2, 1), ("a", "c", 2, 3), ("x", "x", 1, 1), ("p", "q", -1, 2), ("p", "q", None, 2), (None, "q", 1, 2)], "im1 string, im2 string, f1 int, f2 int"
    )
    g = spark.createDataFrame([([(" S2 ",), ("s1",), ("",), (None,)],), ([("s1",), ("s9",)],), ([("lone",)],), (None,)], "observations array<struct<shot_id string>>")
    got = {tuple(r) for r in components.consolidate(m, g).collect()}
    assert got == {
        ("feature", "a#2", "a#2"), ("feature", "b#1", "a#2"), ("feature", "c#3", "a#2"), ("feature", "x#1", "x#1"),
        ("shot", "s1", "s1"), ("shot", "s2", "s1"), ("shot", "s9", "s1"), ("shot", "lone", "lone"),
    }
    assert components.consolidate(m.limit(0), g.limit(0)).count() == 0


def test_damerau_is_a_metric():
    r = random.Random(1)
    w = ["".join(r.choice("abc") for _ in range(r.randrange(6))) for _ in range(40)]
    for a in w[:15]:
        for b in w:
            assert canonical.damerau(a, b) == canonical.damerau(b, a)
            for c in w[:15]:
                assert canonical.damerau(a, c) <= canonical.damerau(a, b) + canonical.damerau(b, c)
    assert canonical.damerau("ca", "abc") == 2


ENTRIES = [(1, "Velorane", "VR-60"), (2, "Velorane", "VR-600"), (3, "Velorane", "VR-60s"), (4, "Velorane", "Nimbus 4"), (5, "Corvidia", "Nimbus 4"), (6, "Lumagrove", "Pelican 2 Pro"), (7, "Lumagrove", "Pelican 2")]


@pytest.mark.parametrize("shard", [20_000, 2])
def test_canonical_names(spark, shard):
    cases = [
        ("Velorane", "VR-60", None), ("VELORANE GmbH", "vr 60", 1), ("Vеlоrаnе", "ＶＲ－６ＯＯ", 2), ("VR_60s®", "Velorane", 3), ("Veloraen", "Velorane Nmbus 4 fw 3.1", 4),
        ("unknown", "Nimbus 4", 0), ("", "Corvidia Nimbus.4 (TM)", 5), (None, "Peliccan 2 Pro", 6), ("Lumagrove \xa0", "PELICAN2", 7), ("Lumagrove", "Pelican 3", 0),
        ("Other & Sons", "VR-60", 0), ("unknown", None, None), ("", "", None), ("test", "test", 0), ("x" * 5000, "y" * 5000, 0),
    ]
    rows = spark.createDataFrame([(f"s{i}", a, b, "clash") for i, (a, b, _) in enumerate(cases)] * 2 + [(None, "a", "b", "")], "shot_id string, make string, model string, ids string")
    entries = spark.createDataFrame(ENTRIES, "model_id int, make string, model string")
    got = {r.shot_id: r.model_id for r in canonical.mapped_entries(rows, entries, shard).collect()}
    assert got == {f"s{i}": c[2] for i, c in enumerate(cases) if c[2] is not None}
    assert canonical.mapped_entries(rows.limit(0), entries, shard).count() == 0


def test_bk_tree_finds_all_within_radius():
    r = random.Random(2)
    names = list({("", "".join(r.choice("abcd") for _ in range(r.randrange(3, 7))), str(r.randrange(2))) for _ in range(150)})
    tree = canonical.BKTree(True)
    for i, n in enumerate(names):
        tree.add(n, i)
    for n in names[:30]:
        got = {i for _, _, ids in tree.within(n, 2) for i in ids}
        assert got == {i for i, m in enumerate(names) if tree.metric(n, m) <= 2}


def test_leaks_against_brute_force(spark):
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(40))) for i in range(6)] + [(99, "too short"), (98, None), (None, "x")]
    docs = []
    for d in range(60):
        w = [r.choice(vocab) for _ in range(r.randrange(0, 60))]
        if d % 3 == 0:
            src = items[d % 6][1].split()
            k = r.randrange(0, 20)
            n = 11 + d % 4
            w[5:5] = src[k : k + n]
        docs.append((d, ", ".join(w).upper() if d % 2 else " ".join(w)))
    docs += [(1000, None), (None, items[0][1]), (1001, ""), (1002, items[1][1] + " " + "z " * 3000)]
    want = set()
    for d, t in docs:
        for i, q in items:
            if d is None or i is None or not t or not q:
                continue
            a, b = leakage.words(t), leakage.words(q)
            grams = {tuple(b[k : k + 12]) for k in range(len(b) - 11)}
            if any(tuple(a[k : k + 12]) in grams for k in range(len(a) - 11)):
                want.add((d, i))
    D = spark.createDataFrame(docs + docs[:9], "doc_id long, text string").withColumn("item_id", F.lit(5))
    Q = spark.createDataFrame(items + items[:2], "item_id long, text string")
    for shard, block in ((400_000, 20_000), (50, 3)):
        got = leakage.leaks(D, Q, shard_words=shard, item_block=block).collect()
        assert {(x.doc_id, x.item_id) for x in got} == want and len(want) > 10
    for x in got:
        a, b = leakage.words(dict(docs)[x.doc_id]), leakage.words(dict(items)[x.item_id])
        assert a[x.doc_word : x.doc_word + x.n_words] == b[x.item_word : x.item_word + x.n_words] and x.n_words >= 12
    assert leakage.leaks(D.limit(0), Q).count() == 0 and leakage.leaks(D, Q.limit(0)).count() == 0


def test_words_ignore_form():
    assert leakage.words("Ｃａｆé, l’été — STRASSE!") == leakage.words("café  l'été straße")


def test_suffix_array():
    r = np.random.RandomState(0)
    t = r.randint(0, 3, 200)
    order = leakage.suffix_array(t, 300)
    assert order.tolist() == sorted(range(200), key=lambda i: t[i:].tolist())


def test_flow_repeats_least_and_meets_what_can_be_met():
    flow = mixing.routed({("a",): 100, ("a", "b"): 50, ("b",): 10}, {"a": 120, "b": 70}, {"a": 2, "b": 1})
    a = sum(f.get("a", 0) for f in flow.values())
    b = sum(f.get("b", 0) for f in flow.values())
    assert (a, b) == (120, 60)
    assert flow[("a", "b")]["b"] == 50 and flow[("b",)]["b"] == 10


def test_mixture(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["alpha", "beta", "gamma"]) for _ in range(r.randrange(1, 40))), "big" if i % 10 else "small") for i in range(400)]
    rows += [(1000 + i, rows[i][1], "small") for i in range(1, 30)] + [(2000, None, "big"), (2001, "", "big"), (2002, "x", None), (2003, "x", "other"), (None, "x", "big")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("pattern", F.lit("clash"))
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 3), ("absent", 0.1, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    selection, shares = mixing.mixture(docs, targets, seed=1)
    s = {x.source: x for x in shares.collect()}
    assert s["absent"].actual_tokens == 0 and s["small"].most_uses <= 3 and s["big"].most_uses == 1
    longest = 60
    for k in ("big", "small"):
        assert abs(s[k].actual_tokens - min(s[k].target_tokens, s[k].available_tokens * (1 if k == "big" else 3))) <= 4 * longest
    again = {tuple(x) for x in mixing.mixture(docs, targets, seed=1)[0].collect()}
    assert again == {tuple(x) for x in selection.collect()}
    text = {x[0]: x[1] for x in rows}
    uses = {}
    for x in selection.collect():
        uses[text[x.doc_id]] = uses.get(text[x.doc_id], 0) + x.n_uses
    assert max(uses.values()) <= 3
    assert mixing.mixture(docs.limit(0), targets)[0].count() == 0


BAD = ["You {} idiot, everyone in {} hates you.", "Go away, {}, you disgusting loser from {}.", "All people of {} are vermin, said {} with hate."]
GOOD = ["The mill of {} sold {} roof tiles.", "Nobody in {} complained about {}.", "The moderator in {} deleted the word idiot from {}.", "Vermin control in {} caught rats near {}."]


def corpus(n, seed):
    r = random.Random(seed)
    name = lambda: "".join(r.choice("bdfgklmn") + r.choice("aeiou") for _ in range(3)).title()
    out = []
    for i in range(n):
        bad = i % 4 == 0
        s = [r.choice(GOOD).format(name(), name()) for _ in range(r.randrange(0 if bad else 1, 3))]
        if bad:
            s.insert(r.randrange(len(s) + 1), r.choice(BAD).format(name(), name()))
        out.append((i, " ".join(s), bad))
    return out


def test_content_held_out(spark):
    train, test = corpus(400, 1), corpus(200, 2)
    rows = [(i, t, "a") for i, t, _ in train] + [(1000 + i, t, "b") for i, t, _ in test] + [(5000, None, "b"), (5001, "", None), (5002, "All people of Xo are v e r m i n, said Po with hate.", "b"), (5003, "fine words. " * 3000, "b")]
    labels = [(i, "r", " Abusive" if b else "clean") for i, _, b in train] + [(0, "r2", None), (7, "r2", "odd"), (None, "r", "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("label", F.lit("x"))
    out = {x.doc_id: x for x in content.scored_documents(docs, spark.createDataFrame(labels, "doc_id long, reviewer string, label string")).collect()}
    hits = [out[1000 + i].flagged == b for i, _, b in test]
    assert np.mean(hits) >= 0.97
    assert out[5000].score == 0 and out[5001].score == 0 and not out[5001].flagged and out[5002].flagged and not out[5003].flagged
    assert len(out) == len(rows)
    none = content.scored_documents(docs, spark.createDataFrame([], "doc_id long, reviewer string, label string"))
    assert none.where("flagged").count() == 0


def test_content_more_labels_than_learned(spark):
    """Bad documents that a reviewer let pass as clean weigh no more in a sample than among all labels."""
    slip = lambda i, b: b and i % 16 == 0
    train, test = corpus(800, 1), corpus(200, 2)
    docs = spark.createDataFrame([(i, t) for i, t, _ in train], "doc_id long, text string")
    labels = spark.createDataFrame([(i, "r", "hateful" if b and not slip(i, b) else "clean") for i, _, b in train], "doc_id long, reviewer string, label string")
    model = content.train(docs, labels, max_labelled=60)
    score = model.logits([t for _, t, _ in test])
    assert np.mean((score > np.log(0.7 / 0.3)) == [b for _, _, b in test]) >= 0.95
    order = [r.doc_id for r in docs.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    bad = [i for i in order if train[i][2] and not slip(i, True)][:60]
    clean = [i for i in order if not train[i][2] or slip(i, True)][:60]
    plain = content.fit([train[i][1] for i in bad + clean], [True] * 60 + [False] * 60)
    assert np.array_equal(model.weights, plain.weights) and model.bias == plain.bias


def test_disguises_come_off():
    for s in ("s t u p i d _ p i g", "s.t.u.p.i.d pig", "stuuuupid pig", "st​upid pig", "stup1d p1g", "ѕtupid pіg", "STUPID PIG"):
        assert content.plain(f"Shut up, you {s}!").replace(" ", "") == "shutupyoustupidpig"


def test_components_by_contraction_and_by_rounds_agree_with_union_find(spark):
    r = np.random.RandomState(5)
    edges = [(int(a), int(b)) for a, b in r.randint(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7), (5000, 5000), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    want = {frozenset(y for y in parent if find(y) == x) for x in {find(y) for y in parent}}
    df = spark.createDataFrame(edges, "u long, v long").repartition(7)
    for most in (0, 5, 1_000_000):
        groups = {}
        for x in components.components(df, task_edges=most).collect():
            groups.setdefault(x.root, set()).add(x.node)
        assert {frozenset(g) for g in groups.values()} == want


def test_hot_groups_shared_hashes_and_points_with_several_rows(spark, monkeypatch):
    links = spark.createDataFrame([("k", f"a{i}", f"a{i + 1}") for i in range(200)] + [("k", f"b{i}", f"b{i}") for i in range(200)] + [("k", None, "x")], "kind string, a string, b string")
    want = {("k", f"a{i}", "a0") for i in range(201)} | {("k", f"b{i}", f"b{i}") for i in range(200)}
    assert {tuple(x) for x in components.grouped_records(links, hot_rows=50).collect()} == want
    full = F.xxhash64
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.pmod(full(*c), F.lit(1 << 13)))
    assert {tuple(x) for x in components.grouped_records(links).collect()} == want
    monkeypatch.undo()
    g = spark.createDataFrame([("p", ["s1"], 1), ("p", ["s2", " S3"], 2), (None, ["s4", "s5"], 3), (None, ["s6"], 3), ("q", None, 4)], "id string, shots array<string>, other int")
    g = g.withColumn("observations", F.transform("shots", lambda x: F.struct(x.alias("shot_id"))))
    m = spark.createDataFrame([], "im1 string, im2 string, f1 int, f2 int")
    got = {(x.record_key, x.group_key) for x in components.consolidate(m, g).collect()}
    assert got == {("s1", "s1"), ("s2", "s1"), ("s3", "s1"), ("s4", "s4"), ("s5", "s4"), ("s6", "s6")}


def test_pattern_flow_meets_most_of_the_quotas_at_least_cost():
    from itertools import product

    r = np.random.RandomState(2)
    for _ in range(40):
        sources = ["a", "b", "c"][: r.randint(1, 4)]
        every = [p for p in (("a",), ("b",), ("c",), ("a", "b"), ("b", "c"), ("a", "c")) if set(p) <= set(sources)]
        patterns = [every[i] for i in r.permutation(len(every))[:2]]
        capacity = {p: int(r.randint(1, 4)) for p in patterns}
        quota, repeats = {x: int(r.randint(0, 7)) for x in sources}, {x: int(r.randint(1, 4)) for x in sources}
        arcs = [(p, x) for p in patterns for x in p]
        worth = lambda f: (-sum(f.values()), sum(max(0, sum(f[p, x] for x in p) - k * capacity[p]) for p in patterns for k in range(1, 4)))
        best = None
        for amounts in product(*(range(min(quota[x], capacity[p] * repeats[x]) + 1) for p, x in arcs)):
            f = dict(zip(arcs, amounts))
            fits = all(sum(f[p, y] for p, y in arcs if y == x) <= quota[x] for x in sources) and all(sum(f[p, x] for x in p) <= capacity[p] * max(repeats[x] for x in p) for p in patterns)
            if fits and (best is None or worth(f) < best):
                best = worth(f)
        got = mixing.routed(capacity, quota, repeats)
        assert worth({(p, x): got[p][x] for p, x in arcs}) == best


def test_many_patterns_are_routed():
    r = np.random.RandomState(3)
    sources = [f"s{i:02d}" for i in range(20)]
    patterns = {tuple(sorted(r.choice(sources, r.randint(1, 8), replace=False).tolist())) for _ in range(20_000)}
    capacity = {p: int(r.randint(1, 10**6)) for p in patterns}
    flow = mixing.routed(capacity, {x: sum(capacity.values()) // 25 for x in sources}, dict.fromkeys(sources, 2))
    assert sum(sum(f.values()) for f in flow.values()) == sum(capacity.values()) // 25 * 20


@pytest.mark.parametrize("name", ["p3_sizes", "p6_unmatched", "p8_items", "p8_clean", "p9_selection", "p10_scores", "p10_rates"])
def test_every_query_runs(spark, data, name):
    from scenewright.llm import queries

    df = queries.QUERIES[name](spark, data)
    assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)
