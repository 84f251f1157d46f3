"""Spelling variants, packing and panes, against brute force, the library and SQL."""

import datetime as dt
import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest

from narrata.llm import oracle, packing, panes, queries, variants
from tests import oracle as sql

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, word string, n string, start string"


# Spelling variants


def near_of(words):
    """The near words of each, by trying all edits."""
    def edits(w):
        for i in range(len(w) + 1):
            yield from (w[:i] + c + w[i:] for c in alphabet)
            if i < len(w):
                yield w[:i] + w[i + 1 :]
                yield from (w[:i] + c + w[i + 1 :] for c in alphabet)

    alphabet = sorted(set("".join(words)))
    return {w: {e for e in edits(w) if e in words and e != w} for w in words}


def groups_of(words):
    near = near_of(words)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words.get(form[w]))
    return out


def grouped(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def some_words():
    r = random.Random(4)
    words = Counter({"anagram": 2000, "nagaram": 30, "anagrams": 150, "anagramm": 10, "anagrammm": 1, "éclairs": 40, "éclair": 3, "eclairs": 4, "Éclairs": 7, "aaaaaaa": 5, "aaaaaaaa": 50, "aaaaaaab": 500, "z" * 300: 2, "z" * 299: 30})
    for _ in range(300):
        w = "".join(r.choice("ab") for _ in range(r.randrange(7, 11)))
        words[w] = r.choice([1, 2, 3, 20, 21, 400, 400, 9000])
    return words


@pytest.mark.parametrize("paired", [2, 64])
def test_variants_by_brute_force(spark, monkeypatch, paired):
    monkeypatch.setattr(variants, "PAIRED", paired)
    words = some_words()
    df = spark.createDataFrame([(n, "x", w) for w, n in words.items()], "n long, form string, word string")
    assert grouped(variants.variant_groups(df)) == groups_of(words)


def test_words_by_brute_force(spark):
    texts = ["Anagram anagram ÀNAGRAM nagaram×anagram", None, "", "short words", "Anagram " * 3000, "b" * 40_000, "anagram-anagram_anagram9anagram", "same anagram", "same anagram"]
    rows = [(i, t, "clash", "clash", "clash") for i, t in enumerate(texts)] + [(None, "anagram nameless nameless", "", "", ""), (4, "anagram " * 31, "", "", "")]
    expected = Counter()
    for i, t, *_ in rows:
        run = ""
        for c in [*(t or ""), " "]:
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if c < "\x80" else c
                continue
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if run and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            expected[run] += 1
            run = ""
    expected = {w: n for w, n in expected.items() if len(w) >= 7 and n >= 2}
    assert {r["word"]: r["n"] for r in variants.word_counts(spark.createDataFrame(rows, DOCS)).collect()} == expected


def test_a_task_passes_words_on_when_it_has_many(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "another anybody another nothing nothing", "", "", "")] * 5, DOCS)
    whole = sorted(variants.word_counts(docs, damage=0).collect())
    monkeypatch.setattr(variants, "COUNTED", 1)
    assert sorted(variants.word_counts(docs, damage=0).collect()) == whole and len(whole) == 3


def test_no_words(spark):
    none = spark.createDataFrame([], DOCS)
    assert variants.variant_groups(variants.word_counts(none)).count() == 0


def test_letters_have_distinct_differences():
    values = list(variants.VALUE.values())
    differences = [a - b for a in values for b in values if a != b]
    assert len(values) == 116 and len(set(differences)) == len(differences)


def test_variants_equal_sql(spark):
    sql.check(queries.op11_spelling_variants(spark, SF), sql.connect(SF), oracle.OP11)


# Packing


@pytest.fixture(scope="module")
def tokenizer():
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    return path, Tokenizer.from_file(path)


def odd_texts(n=400):
    r = random.Random(3)
    parts = [*"'stmdrvle aB19!?.-\n\t 　éß漢字🙂\x1c\x00_<>≠́\u0085İΣς", "'re", "'LL", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "  ", "\r\n", "Don't", "é", ".”", "A-b", "(x)"]
    return ["".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(n)]


EDGES = [None, "", " ", "a" * 20_000, "word " * 30_000, "same text", "same text", "x " * 2047, "x " * 2048]


def test_ids_equal_the_library(tokenizer):
    path, tool = tokenizer
    texts = odd_texts() + [t or "" for t in EDGES]
    found = packing.WordEncoder(path).encode_all(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [tool.encode(t, add_special_tokens=False).ids for t in texts]


def checked(rows, documents, capacity):
    """That pieces cover the documents and sequences are gapless; the number of padded places."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(documents)
    for i, ids in documents.items():
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            part = ids[at : at + r["length"]]
            assert list(r["ids"]) == part and r["ids_crc32"] == crc32(np.array(part, "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    lost = 0
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        full = at if at & (at - 1) == 0 else capacity
        assert at <= capacity and {r["padded_to"] for r in rs} == {full}
        lost += full - at
    return lost


@pytest.mark.parametrize("capacity", [1, 7, 64, 2048])
def test_packing(spark, tokenizer, capacity):
    path, tool = tokenizer
    texts = odd_texts(150) + EDGES
    documents = {i: [*tool.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    df = spark.createDataFrame([(i, t, "clash", "clash", "clash") for i, t in enumerate(texts)], DOCS).repartition(3)
    rows = packing.pack(df, path, capacity).collect()
    total = sum(map(len, documents.values()))
    assert checked(rows, documents, capacity) <= total * (0.1 if capacity < 64 else 0.03)


def test_bins_take_a_fixed_count(tokenizer):
    r = random.Random(1)
    bins, filled = packing.Bins(2048), 0
    for i in range(20_000):
        for n in packing.lengths(r.randrange(1, 5000), 2048):
            if (done := bins.put((i, 0, n, b""))) is not None:
                filled += 1
                m = 2048 // done[0][2]
                assert len(done) == m and all(2048 // p[2] == m for p in done)
                assert sum(p[2] for p in done) > 2048 - 2048 // packing.WHOLE
    assert filled > 10_000 and all(len(v) < m for m, v in bins.open.items())
    assert all(sum(packing.lengths(n, 2048)) == n for n in range(1, 7000))


def test_nothing_to_pack(spark, tokenizer):
    assert packing.pack(spark.createDataFrame([], DOCS), tokenizer[0]).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([], DOCS), tokenizer[0], capacity=0)


def test_little_padding(spark):
    pieces = queries.op12_packing(spark, "/root/testdata/sf0.01")
    assert packing.padding(pieces).first()["share"] < 0.01


# Panes

CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, kind string, value double, hour string, batch string"


def panes_of(rows, n=10, grace=12, open_hours=48):
    """The records, row by row."""
    hour_us, day_us, zero = 3_600_000_000, 86_400_000_000, dt.datetime(1970, 1, 1)
    once = {}
    for i, ts, arrived, kind, value, *_ in rows:
        if ts is not None and i is not None:
            once.setdefault(i, (ts, arrived, kind, value))
    batches = defaultdict(list)
    for i, (ts, arrived, kind, value) in once.items():
        day = ((arrived or ts) - zero).days
        us = (ts - zero) // dt.timedelta(microseconds=1) - (day - day % n) * day_us
        b = min(n - 1, day % n + max(0, crc32(str(i).encode()) % 30 - 23))
        cents = int(np.floor(100 * value + 0.5)) if value is not None and value == value else 0
        batches[b].append((us, i, kind or "none", us // hour_us, cents))
    out, totals, sent, w = [], {}, {}, float("-inf")
    for b in range(n):
        new = set()
        for _, i, kind, hour, cents in batches[b]:
            if w >= (hour + 1 + open_hours) * hour_us:
                out.append((b, "late", kind, hour, i, 1, cents))
            else:
                a, c = totals.get((kind, hour), (0, 0))
                totals[kind, hour] = a + 1, c + cents
                new.add((kind, hour))
        for key in list(totals):
            due = w >= (key[1] + 1 + grace) * hour_us
            if key in sent and key in new:
                out += [(b, "retract", *key, -1, *sent[key]), (b, "replace", *key, -1, *totals[key])]
                sent[key] = totals[key]
            elif due and key not in sent:
                out.append((b, "emit", *key, -1, *totals[key]))
                sent[key] = totals[key]
            if w >= (key[1] + 1 + open_hours) * hour_us:
                del totals[key]
        w = max([w, *(r[0] for r in batches[b])])
    out += [(n - 1, "final", *key, -1, *v) for key, v in totals.items() if key not in sent]
    return sorted(out)


def odd_clicks():
    r, day0 = random.Random(5), dt.datetime(2024, 2, 26)  # day 0 of ten
    rows = []
    for i in range(900):
        arrived = day0 + dt.timedelta(days=r.choice([0, 1, 2, 3, 3, 4, 8, 9, 13]), hours=r.randrange(24))
        ts = arrived - dt.timedelta(seconds=r.choice([0, 1, 5, 3600, 40_000, 90_000, 200_000, 700_000]))
        rows.append((i, ts, arrived, r.choice(["view", "buy", None]), r.choice([1.5, 0.005, -2.25, None, float("nan"), 1e6]), "", ""))
    edge = day0 + dt.timedelta(days=1)
    rows += [(1000 + k, edge + dt.timedelta(hours=k), edge + dt.timedelta(hours=k), "edge", 1.0, "", "") for k in (-1, 0, 11, 12, 13)]
    rows += [(2000, edge, None, "lone", 2.0, "", ""), (2001, None, edge, "lone", 2.0, "", ""), (None, edge, edge, "lone", 2.0, "", "")]
    return rows + rows[:100]


def test_panes_by_brute_force(spark):
    rows = odd_clicks()
    found = panes.revised_panes(spark.createDataFrame(rows, CLICKS))
    names = ("batch", "record", "kind", "hour", "click_id", "n_rows", "cents")
    expected = panes_of(rows)
    assert sorted(tuple(r[c] for c in names) for r in found.collect()) == expected
    assert {r[1] for r in expected} == {"emit", "retract", "replace", "late", "final"} and min(r[3] for r in expected) < 0


def test_panes_of_nothing(spark):
    assert panes.revised_panes(spark.createDataFrame([], CLICKS), n=2).count() == 0
    assert panes.write_batches(panes.batched(spark.createDataFrame([], CLICKS)), 2, f"{panes.scratch(spark, 'none')}") == [None, None]


def test_a_failed_start_doubles_nothing(spark, monkeypatch):
    """A start that breaks off is made again on its checkpoint."""
    rows = odd_clicks()[:200]
    made = panes.step
    broken = []

    def breaks(*args, **named):
        if args[4] == 1 and not broken:
            broken.append(1)
            with pytest.raises(Exception):  # the first deadline breaks the task
                made(*args[:6], None, *args[7:], **named)
        made(*args, **named)

    monkeypatch.setattr(panes, "step", breaks)
    found = panes.revised_panes(spark.createDataFrame(rows, CLICKS), n=3)
    names = ("batch", "record", "kind", "hour", "click_id", "n_rows", "cents")
    assert broken and sorted(tuple(r[c] for c in names) for r in found.collect()) == panes_of(rows, 3)


def test_panes_equal_sql(spark):
    sql.check(queries.op13_window_panes(spark, SF), sql.connect(SF), oracle.OP13)
