"""Deduplication against brute force, on hard small cases."""

import random

import numpy as np
import pytest

from narrata.llm import common, components, neardup, oracle, queries, substring
from narrata.llm.common import hash_words, sha
from tests import oracle as sql

SCHEMA = "doc_id long, text string, flags string, hash string, key string, component_id string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", "x", "x", "x") for i, t in rows], SCHEMA)


def repeats_by_hand(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = {}
    for d, w in enumerate(words):
        for i in range(len(w) - window + 1):
            seen.setdefault(tuple(w[i : i + window]), []).append((d, i))
    gone = [set() for _ in words]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d] |= set(range(i, i + window))
    return [(len(w), len(g), sha(b" ".join(x for k, x in enumerate(w) if k not in g))) for w, g in zip(words, gone, strict=True)]


def hard_texts(seed, window):
    r = random.Random(seed)
    letters = "abcdefgh"[: 2 + seed % 6]
    prose = [f"w{k}" for k in range(300)]
    passages = [[r.choice(prose) for _ in range(window + r.randrange(30))] for _ in range(4)]
    out = []
    for _ in range(50):
        kind = r.randrange(5)
        if kind == 0:
            out.append([r.choice(letters) for _ in range(r.randrange(3 * window))])
        elif kind == 1:
            out.append((["a", "b", "c"][: 1 + r.randrange(3)]) * (window + r.randrange(10)))
        else:
            w = [r.choice(prose) for _ in range(r.randrange(3 * window))]
            for _ in range(kind - 1):
                p = r.choice(passages)
                a = r.randrange(6)
                at = r.randrange(len(w) + 1)
                w[at:at] = p[a : len(p) - r.randrange(6)]
            out.append(w)
    return [r.choice([" ", "\n", "  "]).join(w) for w in out]


@pytest.mark.parametrize(("seed", "window"), [(0, 35), (1, 35), (2, 35), (3, 50), (4, 17), (5, 9), (6, 3), (7, 1)])
def test_repeats_equal_brute_force(spark, seed, window):
    texts = hard_texts(seed, window) + [None, "", "short", "same words " * 40, "same words " * 40]
    rows = substring.remove_repeats(documents(spark, enumerate(texts)).repartition(7), window).orderBy("doc_id").collect()
    assert [tuple(r)[1:4] for r in rows] == repeats_by_hand(texts, window)


def test_windows_of_equal_words_have_equal_anchors():
    """The parse inside a window doesn't depend on what is around it."""
    r = random.Random(3)
    for window in (9, 17, 35, 50):
        plan = substring.Plan.of(window)
        assert plan.stretch >= 1 and plan.margin * 2 + plan.stretch <= window + 1
        for _ in range(200):
            letters = [f"x{k}" for k in range(r.choice([1, 2, 3, 50]))]
            middle = [r.choice(letters) for _ in range(window)]
            places = set()
            for _ in range(4):
                left, right = ([r.choice(letters) for _ in range(r.randrange(20))] for _ in range(2))
                anchors, low, high = substring.Text([" ".join(left + middle + right)]).anchors(plan)
                owner = anchors[(low <= len(left)) & (len(left) <= high)]
                assert len(owner) == 1
                places.add(int(owner[0]) - len(left))
            assert len(places) == 1


def test_repeats_are_revealed_by_names(monkeypatch):
    """With names that differ from batch to batch, no name of a repeated window is shared: the names do the work."""
    r = random.Random(11)
    plan = substring.Plan.of(35)
    passage = [f"w{r.randrange(900)}" for _ in range(80)] + ["very"] * 3 + ["so"] * 4
    texts = [" ".join([f"{k}{i}" for i in range(20)] + passage + [f"{k}x{i}" for i in range(20)]) for k in "ab"]

    def shared():
        found = []
        for t in texts:
            one = substring.Text([t])
            found.append(set(one.keys(plan, one.anchors(plan)[0]).tolist()))
        return found[0] & found[1]

    assert len(shared()) >= 3
    parse, calls = substring.Text.parse, []

    def broken(self, plan):
        start, name, length = parse(self, plan)
        calls.append(1)
        return start, name + np.uint64(len(calls)), length

    monkeypatch.setattr(substring.Text, "parse", broken)
    assert not shared()


def test_runs_are_named_with_their_lengths():
    plan = substring.Plan.of(35)
    one = substring.Text([" ".join(["a", *["b"] * k, "c"]) for k in (2, 3, 4, 2)])
    start, name, length = one.parse(plan)
    runs = {int(n): int(k) for n, k in zip(name, length, strict=True) if k > 1}
    assert one.row[start].tolist().count(0) == one.row[start].tolist().count(3)
    assert len(runs) >= 3


def test_repeated_rows_ids_and_texts(spark):
    long, other = " ".join(f"p{k}" for k in range(60)), " ".join(f"q{k}" for k in range(60))
    rows = [(1, long), (1, long), (None, other), (2, "x " + other), (3, " ".join(f"r{k}" for k in range(50))), (3, "z")]
    found = substring.remove_repeats(documents(spark, rows), texts=True).collect()
    assert sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"]) for r in found) == [(-1, 60, 60), (1, 60, 60), (1, 60, 60), (2, 61, 60), (3, 1, 0), (3, 50, 0)]
    assert {r["kept_text"] for r in found if r["doc_id"] == 2} == {"x"}
    assert substring.remove_repeats(documents(spark, rows).where("false")).count() == 0


def test_one_hot_passage_in_many_contexts(spark):
    r = random.Random(5)
    hot = " ".join(f"h{k}" for k in range(40))
    texts = [" ".join(f"{r.random()}" for _ in range(r.randrange(50))) + f" {hot} " + " ".join(f"{r.random()}" for _ in range(r.randrange(50))) for _ in range(300)]
    rows = substring.remove_repeats(documents(spark, enumerate(texts)).repartition(16)).orderBy("doc_id").collect()
    assert [tuple(x)[1:4] for x in rows] == repeats_by_hand(texts, 35)


def test_word_hashes():
    texts = [b"", b"a  b\tc\x0b", b" x " + b"y" * 3000, b"a"]
    found, counts = hash_words(texts)
    assert counts.tolist() == [0, 3, 2, 1] and found[0] == found[5] and len(set(found.tolist())) == 5


# Near duplicates


def shingle_set(t, words):
    w = (t or "").encode().lower().split() if (t or "").isascii() else (t or "").encode().translate(neardup.LOWER).split()
    return {tuple(w[i : i + words]) for i in range(max(len(w) - words + 1, 1))} if w else set()


def components_by_hand(rows, words, percent):
    sets = [shingle_set(t, words) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][0] == rows[j][0]
            both = len(sets[i] & sets[j])
            if rows[i][0] is not None and rows[j][0] is not None and (same or both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both)):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((-1 if d is None else d, len(sets[i]), -1 if d is None else least[find(i)], d is None or least[find(i)] == d) for i, (d, _) in enumerate(rows))


def family(r, n, changes, length=80):
    base = [f"w{r.randrange(500)}" for _ in range(length)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(changes + 1)):
            w[r.randrange(len(w))] = f"v{r.randrange(500)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("seed", "words", "percent", "block", "broadcast"), [(1, 3, 85, 40, True), (2, 5, 80, 15, True), (3, 1, 90, 40, True), (4, 3, 85, 12, False)])
def test_components_equal_brute_force(spark, seed, words, percent, block, broadcast, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)
    if not broadcast:
        monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    r = random.Random(seed)
    texts = family(r, 150, 9) + family(r, 40, 4) + family(r, 3, 1, 6) + ["a b", "A  B", "b a", "one", None, "", " "]
    rows = list(enumerate(texts)) + [(5, texts[5]), (7, texts[160]), (None, texts[0]), (None, "one")]
    r.shuffle(rows)
    found = neardup.near_duplicates(documents(spark, rows).repartition(5), words, percent).collect()
    assert sorted((-1 if x[0] is None else x[0], x[1], -1 if x[2] is None else x[2], x[3]) for x in map(tuple, found)) == components_by_hand(rows, words, percent)


def test_sets_of_a_family_are_sent_about_once(spark, monkeypatch):
    """Near copies in 30 blocks: each set goes to its block, and a few representatives to all."""
    monkeypatch.setattr(neardup, "BLOCK", 40)
    sent, links = [], neardup._links

    def counted(texts, places, *rest):
        sent.append(places.count())
        return links(texts, places, *rest)

    monkeypatch.setattr(neardup, "_links", counted)
    r = random.Random(4)
    rows = list(enumerate(family(r, 1200, 1, 200)))
    found = neardup.near_duplicates(documents(spark, rows).repartition(6), 3, 85)
    assert found.where("kept").count() == 1
    blocks = -(-1200 // 40)
    assert sum(sent) <= 1200 + (blocks + 1) * neardup.REPRESENTATIVES


def test_what_passes_through_the_driver_is_bounded(spark, monkeypatch):
    """Sides beyond the bound are broadcast neither by hint nor by Spark's own estimate of their files."""
    monkeypatch.setattr(common, "IDS_ROWS", 10, raising=False)
    sent, hint = [], common.F.broadcast
    monkeypatch.setattr(common.F, "broadcast", lambda df: sent.append(df.count()) or hint(df))
    r = random.Random(6)
    rows = list(enumerate(t for _ in range(30) for t in family(r, 3, 2)))
    found = neardup.near_duplicates(documents(spark, rows).repartition(4), 3, 85)
    assert sorted(map(tuple, found.collect())) == components_by_hand(rows, 3, 85)
    assert sent and max(sent) <= 10
    assert "SortMergeJoin" in (plan := found._jdf.queryExecution().executedPlan().toString()) and "BroadcastHashJoin" not in plan


def test_few_texts_with_many_places_are_shuffled_alone(spark, monkeypatch):
    monkeypatch.setattr(common, "IDS_BYTES", 32 * 90, raising=False)
    sent, hint = [], common.F.broadcast
    monkeypatch.setattr(common.F, "broadcast", lambda df: sent.append(df.columns) or hint(df))
    r = random.Random(7)
    rows = list(enumerate([t for _ in range(30) for t in family(r, 3, 2)] + [f"only {k} here {k}" for k in range(40)]))
    found = neardup.near_duplicates(documents(spark, rows).repartition(4), 3, 85)
    assert sorted(map(tuple, found.collect())) == components_by_hand(rows, 3, 85)
    assert ["doc_id"] in sent and ["node", "places"] not in sent


def test_nothing_to_link(spark):
    assert neardup.near_duplicates(documents(spark, [(1, "x")]).where("false")).count() == 0
    assert sorted(tuple(r) for r in neardup.near_duplicates(documents(spark, [(1, None), (2, ""), (3, "only this text")])).collect()) == [(1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True)]


def test_pruning_bounds_follow_the_posterior():
    bounds = neardup.least_agreeing(0.85, 1e-6)
    assert bounds == sorted(bounds) and 60 < bounds[-1] < 109
    r = np.random.default_rng(0)
    lost = sum((np.cumsum(r.random((2000, 128)) < 0.85, 1)[:, 31::32] < bounds).any(1))
    assert lost == 0


def test_connected_components(spark):
    r = random.Random(9)
    pairs = [(i, i + 1) for i in range(100, 140)] + [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(7, 7), (None, 3), (200, 300), (300, 200), (200, 300)]
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in pairs:
        if None not in (a, b) and a != b:
            up[max(find(a), find(b))] = min(find(a), find(b))
    found = components.components(spark.createDataFrame(pairs, "a long, b long"))
    got = {r["node"]: r["component"] for r in found.collect()}
    assert {x: got.get(x, x) for x in up} == {x: find(x) for x in up}


@pytest.mark.parametrize("name", ["op2_substring_dedup", "op5_near_dedup"])
def test_queries_equal_sql(spark, sf, name):
    sql.check(queries.queries()[name](spark, sf), sql.connect(sf), oracle.SQL[name])
