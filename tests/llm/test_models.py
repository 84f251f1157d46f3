"""Models by held-out accuracy, audio by alignment, and the pipeline by its parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from narrata.llm import audio, langid, quality, queries


def test_languages_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = queries.op1_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == docs.count() and 250 < len(held) < 420
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


DOCS = "doc_id long, text string, lang string, lang_pred string, score string"


def test_languages_of_odd_texts(spark):
    learned = [(i, "the cat and the dog " * 5, "en", "", "") for i in range(6)] + [(i, "der Hund und die Katze " * 5, "de", "", "") for i in range(6)] + [(90, None, "xx", "", ""), (91, "word", None, "", "")]
    model = langid.train(spark.createDataFrame(learned, DOCS))
    texts = ["the dog", "und der Hund", None, "", "12 34 !", "the dog", "der " * 50_000]
    rows = langid.identify(spark.createDataFrame([(i, t, None, "x", "x") for i, t in enumerate(texts)], DOCS), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in rows] == ["en", "de", "und", "und", "und", "en", "de"]
    assert rows[2]["score"] == 0 and rows[0]["score"] == rows[5]["score"] > 0.5


def test_no_language_to_learn(spark):
    none = spark.createDataFrame([], DOCS)
    assert langid.train(none) is None
    assert langid.identify(spark.createDataFrame([(1, "hi", None, "", "")], DOCS), None).first()["lang_pred"] == "und"
    assert langid.identify(none, None).count() == 0


def test_prediction_sees_only_the_text(spark):
    df = spark.createDataFrame([(1, "the cat", "en", "", ""), (2, "the cat", "de", "", "")], DOCS)
    model = langid.train(spark.createDataFrame([(i, t, y, "", "") for i, (t, y) in enumerate([("the cat sat", "en"), ("die Katze sitzt", "de")] * 5)], DOCS))
    assert {r["lang_pred"] for r in langid.identify(df, model).collect()} == {"en"}


def test_elastic_net_makes_weights_sparse():
    r = np.random.default_rng(0)
    rows = [(np.array([k % 2, 2 + r.integers(50)], np.int32), np.array([0.5, 0.5], np.float32), "ab"[k % 2]) for k in range(300)]
    model = langid.fit(rows, np.ones(60))  # with the penalties of production
    telling, rest = model.weights[model.at[:2]], model.weights[model.at[2:52]]
    assert (np.abs(telling).sum(1) > 0).all() and (rest == 0).mean() > 0.5


def test_samples_of_null_and_repeated_ids(spark):
    words = {"en": "the cat and the dog", "de": "der Hund und die Katze"}
    rows = [(None, f"{words[y]} {k}x", y, "", "") for k in range(60) for y in words] + [(5, f"{words[y]} {k}y", y, "", "") for k in range(60) for y in words]
    docs = spark.createDataFrame(rows, DOCS)
    model = langid.train(docs, 20)
    assert model.predict(["the dog", "und der Hund"])[0] == ["en", "de"]
    # One row, many times: one draw for all, and no more than the bound if it takes them.
    same = spark.createDataFrame([(i // 30, "the cat", "en", "", "") for i in range(3000)], DOCS)
    for i in range(4):
        found = langid.train(same.where(F.col("doc_id") == i), 10)
        assert found is None or found.languages == ["en"]
    assert langid.fit([], np.ones(langid.PLACES)) is None


def test_every_label_is_learned(spark):
    """No label is dropped: a training set is learned whole, or refused."""

    def labelled(n):
        return spark.createDataFrame([(i, chr(0x4E00 + i) * 4, f"y{i:05d}", "", "") for i in range(n)], DOCS)

    model = langid.train(labelled(1000))
    assert len(model.languages) == 1000
    got = model.predict([chr(0x4E00 + i) * 4 for i in range(1000)])[0]
    assert sum(y == f"y{i:05d}" for i, y in enumerate(got)) > 600
    with pytest.raises(ValueError, match="the bound is"):
        langid.train(labelled(10_000))


def test_calibration_is_finite_and_convex():
    right = np.array([[9.0, 0.0], [0.0, 9.0]] * 20)
    assert 0.05 < langid.calibrate(right, np.array([0, 1] * 20)) < 20
    r = np.random.default_rng(2)
    logits, t = r.normal(size=(4000, 3)), 2.5
    y = np.array([r.choice(3, p=p) for p in langid.softmax(logits / t)])
    assert abs(langid.calibrate(logits, y) / t - 1) < 0.2


# Quality


def judged(spark, n=400):
    r = np.random.default_rng(4)
    words = [f"word{k}" for k in range(300)]
    docs, labels = [], []
    for i in range(n):
        toxic, low = int(i % 7 == 0), int(i % 5 == 0)
        w = [str(x) for x in r.choice(words, 60)]
        if toxic:
            w[5] = w[20] = str(r.choice(["idiot", "moron", "scum"]))
        if low:
            w = [x.upper() + "!!!" for x in w]
        docs.append((i, " ".join(w), "site" + str(i % 4), "en", "x", "x"))
        labels.append((i, 1 - low, toxic))
    return spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, keep string, hash string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifier_held_out(spark):
    docs, labels = judged(spark)
    got = {r["doc_id"]: r["keep"] for r in quality.classify(docs, labels.where("doc_id % 3 <> 1")).collect()}
    truth = {r["doc_id"]: r["quality"] == 1 and r["toxic"] == 0 for r in labels.collect()}
    held = [i for i in truth if i % 3 == 1]
    assert sum(got[i] == truth[i] for i in held) >= 0.95 * len(held)
    assert all(got[i] for i in held if truth[i])


def test_sparse_sites_shrink_to_the_global_rate(spark):
    rows = [("a", "x", 1.0)] + [("b", "x", float(i % 10 == 0)) for i in range(1000)] + [("c", "x", float(i % 2 == 0)) for i in range(1000)]
    scored = spark.createDataFrame([(h, p, v, 0.0) for h, p, v in rows], "host string, path string, p_low double, p_toxic double")
    found, rate = quality.site_rates(scored)
    site = {r["host"]: r["r"] for r in found.select("host", quality.site_rate("low", rate["low"]).alias("r")).collect()}
    assert abs(site["b"] - 0.1) < 0.02 and abs(site["c"] - 0.5) < 0.02
    assert rate["low"] < site["a"] < 0.9
    alone = found.where("host = 'a'").select(quality.site_rate("low", rate["low"], F.lit(1.0), 1).alias("r")).first()["r"]
    assert abs(alone - rate["low"]) < 1e-9  # a site of one row says nothing about that row


def test_posteriors_equal_brute_force(spark):
    """Rates of hosts and paths without the row itself, shrunk by prior strengths from moments, moving the log odds."""
    docs, labels = judged(spark, 240)
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "de").otherwise("en"))
    rows = docs.collect()
    known = {x["doc_id"]: {"low": 1.0 - x["quality"], "toxic": float(x["toxic"])} for x in labels.where("doc_id % 2 = 0").collect()}
    model = quality.train(docs.select("doc_id", "text"), quality.one_label(labels.where("doc_id % 2 = 0")))
    odds = model.logits([x["text"] for x in rows])
    got = {x["doc_id"]: x for x in quality.classify(docs, labels.where("doc_id % 2 = 0")).collect()}
    assert len(got) == 240
    logit = lambda p: np.log(np.clip(p, 1e-4, 1 - 1e-4) / (1 - np.clip(p, 1e-4, 1 - 1e-4)))

    def strength(sums, counts, toward):
        sums, n, g = (np.array(x, float) for x in (sums, counts, toward))
        between = max(0.0, ((n * (sums / n - g) ** 2).sum() - (g * (1 - g)).sum()) / n.sum())
        return min(1e4, max(1.0, (n * g * (1 - g)).sum() / n.sum() / between - 1)) if between else 1e4

    for k, h in enumerate(quality.HEADS):
        p = np.array([known[x["doc_id"]][h] if x["doc_id"] in known else 1 / (1 + np.exp(-odds[i, k])) for i, x in enumerate(rows)])
        rate = (p.sum() + 0.5) / (len(p) + 1)
        host, path = np.array([x["source"] for x in rows]), np.array([x["source"] + "/" + x["lang"] for x in rows])
        hosts, paths = sorted(set(host)), sorted(set(path))
        mh = strength([p[host == a].sum() for a in hosts], [(host == a).sum() for a in hosts], [rate] * len(hosts))
        shrunk = {a: (p[host == a].sum() + mh * rate) / ((host == a).sum() + mh) for a in hosts}
        mp = strength([p[path == a].sum() for a in paths], [(path == a).sum() for a in paths], [shrunk[a.split("/")[0]] for a in paths])
        for i, x in enumerate(rows):
            a, b = host == host[i], path == path[i]
            a[i] = b[i] = False
            site = (p[b].sum() + mp * (p[a].sum() + mh * rate) / (a.sum() + mh)) / (b.sum() + mp)
            move = np.clip(logit(site) - logit(rate), -quality.SITE_LIMIT, quality.SITE_LIMIT)
            found = got[x["doc_id"]]
            assert abs(found[f"site_{h}"] - site) < 1e-6
            assert abs(found[f"p_{h}"] - 1 / (1 + np.exp(-(odds[i, k] + move)))) < 1e-5


def test_short_toxic_words_and_wordy_spam(spark):
    """A toxic word of three letters, and adverts of ordinary shape, are told by words alone."""
    r = np.random.default_rng(6)
    words = [f"word{k}" for k in range(400)]
    spam = ["casino", "bonus", "cheap", "offer", "click"]
    docs, labels = [], []
    for i in range(600):
        w = [str(x) for x in r.choice(words, 80)]
        toxic, low = int(i % 6 == 0), int(i % 6 == 3)
        for bad, wanted in ((["fuk", "dum"], toxic), (spam, low)):
            for at in r.choice(80, 4, replace=False) if wanted else ():
                w[at] = str(r.choice(bad))
        docs.append((i, " ".join(w).capitalize() + ".", f"s{i % 5}", "en"))
        labels.append((i, 1 - low, toxic))
    docs = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x["keep"] for x in quality.classify(docs, labels.where("doc_id % 5 <> 1")).collect()}
    held = [i for i in got if i % 5 == 1]
    assert sum(not got[i] for i in held if i % 3 == 0) >= 0.9 * sum(i % 3 == 0 for i in held)
    assert sum(got[i] for i in held if i % 3) >= 0.98 * sum(i % 3 > 0 for i in held)


def test_quality_edges(spark):
    docs, labels = judged(spark, 30)
    odd = spark.createDataFrame([(None, None, None, None, "", ""), (7, "", "s", None, "", ""), (7, "", "s", None, "", ""), (9, "x" * 50_000, None, "en", "", "")], docs.schema)
    more = labels.unionByName(spark.createDataFrame([(None, 0, 1), (3, None, None), (4, 1, 0), (4, 0, 1)], labels.schema))
    assert quality.classify(docs.unionByName(odd), more).count() == 34
    assert quality.classify(odd, labels.where("false")).where("keep").count() == 4
    assert quality.classify(odd.where("false"), labels).count() == 0


# Audio


def tune(seed, n=64):
    return audio.melody(list(np.random.default_rng(seed).normal(size=n)))


def recordings(spark, items):
    return spark.createDataFrame([(i, bytearray(x) if x is not None else None, "x") for i, x in items], "rec_id long, audio binary, fp string")


def test_alignment_finds_cuts_noise_and_copies(spark):
    r = np.random.default_rng(0)
    base = tune(1)
    noisy = base + 0.01 * r.normal(size=len(base))
    cut = base[10 * audio.HOP :]
    items = [(0, audio.encode_wav(base)), (1, audio.encode_wav(noisy)), (2, audio.encode_wav(cut)), (3, audio.encode_wav(base)), (3, audio.encode_wav(base))]
    items += [(10 + k, audio.encode_wav(tune(50 + k))) for k in range(20)] + [(40, None), (41, b"not sound"), (42, audio.encode_wav(base[:100])), (None, audio.encode_wav(base))]
    rows = audio.align(audio.fingerprints(recordings(spark, items)), F.col("rec_id") % 100 == 0).collect()
    members = {r["left_id"]: r["right_id"] for r in rows if r["kind"] == "member"}
    assert len(members) == 27 and members[3] == 0 and members[41] == 41
    matches = {r["right_id"]: r for r in rows if r["kind"] == "match"}
    assert set(matches) == {1, 2} and matches[1]["offset"] == 0 and matches[2]["offset"] == 10 and matches[2]["error_rate"] < 0.02


def test_alignment_equals_brute_force(spark):
    r = np.random.default_rng(5)
    items = []
    for k in range(12):
        base = tune(k)
        items += [(3 * k, base), (3 * k + 1, base + 0.02 * r.normal(size=len(base))), (3 * k + 2, np.concatenate((tune(100 + k, 7), base)))]
    prints = {i: audio.fingerprint(audio.encode_wav(x)).view(np.uint32) for i, x in items}
    near = set()
    for i in prints:
        for j in prints:
            if i != j:
                for offset in range(-30, 31):
                    x, y = prints[i][max(0, offset) :], prints[j][max(0, -offset) :]
                    n = min(len(x), len(y))
                    if n >= audio.OVERLAP and np.bitwise_count(x[:n] ^ y[:n]).sum() <= audio.ERRORS * 32 * n:
                        near.add((i, j))
    rows = audio.align(audio.fingerprints(recordings(spark, [(i, audio.encode_wav(x)) for i, x in items])), F.lit(True)).where("kind = 'match'").collect()
    assert {(x["left_id"], x["right_id"]) for x in rows} == near and len(near) >= 60


def test_alignment_without_equal_frames(spark):
    """Recordings whose every frame has bit errors, all within the limit, beside ones just over it."""
    r = np.random.default_rng(8)
    prints = []
    for k in range(6):
        base = r.integers(0, 2, (60 + k, 32))
        prints += [base, base ^ (r.random(base.shape) < 0.1), (base ^ (r.random(base.shape) < 0.16))[9:], base ^ (r.random(base.shape) < 0.24)]
    held = [np.frombuffer(np.packbits(x).tobytes(), np.uint32) for x in prints]
    near = {}
    for i, x in enumerate(held):
        for j, y in enumerate(held):
            for offset in range(-45, 46):
                n = min(len(x) - max(0, offset), len(y) - max(0, -offset))
                wrong = np.bitwise_count(x[max(0, offset) :][:n] ^ y[max(0, -offset) :][:n]).sum() / (32 * n)
                if i != j and i % 3 == 0 and n >= audio.OVERLAP and wrong <= audio.ERRORS:
                    near[i, j] = min(near.get((i, j), (2, 0)), (wrong, offset))
    rows = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(held)], "rec_id long, fp binary")
    found = audio.align(rows, F.col("rec_id") % 3 == 0).where("kind = 'match'").collect()
    assert len(found) == len(near) >= 8 and {(x["left_id"], x["right_id"]): (x["error_rate"], x["offset"]) for x in found} == near
    assert all(x["votes"] == round(32 * x["overlap"] * (1 - x["error_rate"])) for x in found)


def test_offset_histograms_equal_direct_counts():
    r = np.random.default_rng(12)
    prints = [r.integers(0, 1 << 32, n, dtype=np.uint32) for n in (30, 41, 25)]
    found = {o: (overlap, votes) for o, overlap, votes in audio.offset_histograms([x.tobytes() for x in prints], [x.tobytes() for x in prints])}
    assert min(found) < 0 < max(found)
    for o, (overlap, votes) in found.items():
        for i, x in enumerate(prints):
            for j, y in enumerate(prints):
                n = min(len(x) - max(0, o), len(y) - max(0, -o))
                if n >= audio.OVERLAP:
                    same = 32 * n - np.bitwise_count(x[max(0, o) :][:n] ^ y[max(0, -o) :][:n]).sum()
                    assert overlap[i, j] == n and votes[i, j] == same


def test_filters_equal_direct_sums():
    """Each bit pair of a fingerprint, from sums over the rectangles themselves instead of the integral image."""
    sound = audio.encode_wav(tune(21, 20))
    image = audio.chroma(*audio.decode_wav(sound))
    got = audio.fingerprint(sound).view(np.uint32)
    assert len(got) == len(image) - audio.SPAN + 1

    def area(t, t0, t1, c0, c1):
        return sum(image[t + k, c % 12] for k in range(t0, t1) for c in range(c0, c1))

    for t in range(0, len(got), 3):
        bits = 0
        for kind, c, h, w in audio.filters():
            parts = {
                0: [(0, w, c, c + h // 3 + 1)],
                1: [(0, w, c, c + h // 2)],
                2: [(0, w // 2, c, c + h)],
                3: [(0, w // 2, c, c + h // 2), (w // 2, w, c + h // 2, c + h)],
                4: [(0, w, c + h // 3, c + 2 * (h // 3))],
                5: [(w // 3, 2 * (w // 3), c, c + h)],
            }[kind]
            plus = sum(area(t, *p) for p in parts)
            x = np.log((0.05 + plus) / (0.05 + max(area(t, 0, w, c, c + h) - plus, 0)))
            level = sum(x >= edge for edge in (-audio.STRONG, 0.0, audio.STRONG))
            bits = bits << 2 | (level ^ level >> 1)
        assert bits == got[t]


def test_alignment_of_embeddings_equals_brute_force(spark, sf):
    """The query's steps on its table, with changed copies of the queries' vectors beside it."""
    r = np.random.default_rng(9)
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    v = {x["vec_id"]: x["embedding"] for x in table.collect()}
    for i in range(0, 500, 100):
        for k in range(12):
            x = np.array(v[i])
            at = r.choice(64, 2 + 2 * k, replace=False)
            x[at] += x.std() * r.normal(size=len(at))
            v[1000 + i + k + 1] = x.tolist()
    held = {i: audio.fingerprint(audio.encode_wav(audio.melody(x))).view(np.uint32) for i, x in v.items()}
    near = set()
    for i in (i for i in held if i % 100 == 0):
        for j in held:
            for offset in range(-28, 29):
                x, y = held[i][max(0, offset) :], held[j][max(0, -offset) :]
                n = min(len(x), len(y))
                if i != j and n >= audio.OVERLAP and np.bitwise_count(x[:n] ^ y[:n]).sum() <= audio.ERRORS * 32 * n:
                    near.add((i, j))
    rows = spark.createDataFrame(list(v.items()), "vec_id long, embedding array<double>")
    found = audio.align(audio.fingerprints(audio.render(rows)), F.col("rec_id") % 100 == 0).where("kind = 'match'")
    assert {(x["left_id"], x["right_id"]) for x in found.collect()} == near and len(near) >= 20


def test_integral_image_sums_and_wav():
    x = tune(3)
    rate, back = audio.decode_wav(audio.encode_wav(x))
    assert rate == audio.RATE and np.abs(back - x).max() < 1e-4
    assert audio.decode_wav(b"RIFF")[1].size == 0 and audio.fingerprint(None).size == 0
    half = audio.fingerprint(audio.encode_wav(x * 0.4))
    assert (half == audio.fingerprint(audio.encode_wav(x))).mean() > 0.95


def test_vectors_without_numbers(spark):
    rows = spark.createDataFrame([(1, None, 0), (2, [], 0), (3, [None, 1.0] * 20, 0), (4, [0.0] * 40, 0)], "vec_id long, embedding array<float>, label int")
    found = audio.align(audio.fingerprints(audio.render(rows)), F.lit(True))
    assert found.where("kind = 'member'").count() == 4
    assert audio.align(audio.fingerprints(audio.render(rows.where("false"))), F.lit(True)).count() == 0


# Pipeline


def test_pipeline_parts(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = docs.unionByName(spark.createDataFrame([(None, None, None, None, None), (10**6, "", "en", "s", 0)], docs.schema)).withColumns({"n_words": F.lit(1), "kept_text": F.lit("x"), "hash": F.lit("y"), "contaminated": F.lit("z")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, extra, sf)
        assert out.columns == extra.columns, name
        rows = out.count()
        assert 0 < rows <= extra.count()
        assert out.where("doc_id = 1000000").count() == 1, name
    assert corpus_pipeline.STAGES[-1][1](spark, extra, sf).count() == extra.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "substring_dedup", "decontamination", "bpe_encoding"]


def test_pipeline_keeps_one_of_repeated_rows(spark, sf):
    import corpus_pipeline
    from narrata.llm import neardup

    def survivors(rows):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            rows = stage(spark, rows, sf)
        return rows.select("doc_id", "text").collect()

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    alone = {r["component_id"] for r in neardup.near_duplicates(docs).groupBy("component_id").count().where("count = 1").collect()}
    whole = [r["doc_id"] for r in survivors(docs) if r["doc_id"] in alone and r["text"] == texts[r["doc_id"]] and len(r["text"].split()) >= 40]
    a, b, c = sorted(whole)[:3]
    copies = docs.where(F.col("doc_id").isin(b, c)).withColumn("doc_id", F.lit(None).cast("long"))
    more = docs.where(F.col("doc_id") != b).unionByName(docs.where(F.col("doc_id") == a)).unionByName(copies).unionByName(copies)
    rows = survivors(more)
    assert sorted(str(r["doc_id"]) for r in rows if r["text"] in (texts[a], texts[b], texts[c])) == sorted([str(a), "None", str(c)])
    assert not [r for r in rows if r["text"] == "" and r["doc_id"] in (None, a, c)]


def test_pipeline_equals_its_stages_by_hand(spark, sf):
    import corpus_pipeline
    from narrata.llm import bpe_codec
    from tests.llm.test_dedup import components_by_hand, repeats_by_hand
    from tests.llm.test_text_operators import contaminated_by_hand

    public_tokenizers = pytest.importorskip("public_tokenizers")
    first = corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    rows = sorted((r["doc_id"], r["text"]) for r in first.collect())
    kept = {d for d, _, c, keep in components_by_hand(rows, 5, 80) if keep}
    rows = [r for r in rows if r[0] in kept]
    stay = []
    for (d, t), (n, gone, _) in zip(rows, repeats_by_hand([t for _, t in rows], 35), strict=True):
        stay.append((d, t if not gone else words_left(rows, d)))
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = [x for x, hit in zip(stay, contaminated_by_hand([t for _, t in stay], items, 10), strict=True) if not hit[-1]]
    tool = bpe_codec.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    expected = sorted((d, len(tool.encode(t))) for d, t in clean)
    assert sorted((r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.run(spark, sf).collect()) == expected


def words_left(rows, doc_id, window=35):
    """The text of a document without its repeated windows."""
    words = {d: t.encode().split() for d, t in rows}
    seen = {}
    for w in words.values():
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            seen[key] = seen.get(key, 0) + 1
    own = words[doc_id]
    gone = {k for i in range(len(own) - window + 1) if seen[tuple(own[i : i + window])] > 1 for k in range(i, i + window)}
    return b" ".join(x for k, x in enumerate(own) if k not in gone).decode()
