"""Repeated rows and repeated ids: languages that one text teaches, passages in very many equal rows, texts that share an id."""

import random

import corpus_pipeline
from narrata.llm import langid, substring

DOCS = "doc_id long, text string, lang string, lang_pred string, score string"


def prose(seed, n=60):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(3, 9))) for _ in range(n))


def test_a_language_of_equal_rows_is_learned(spark):
    rows = [(i, f"perro gato casa numero {prose(i, 8)}", "es", "", "") for i in range(300)] + [(7, "the cat and the dog in the house", "en", "", "")] * 100
    for bound in (1, 5, 40):
        model = langid.train(spark.createDataFrame(rows, DOCS), per_language=bound)
        assert model.languages == ["en", "es"]
        found = langid.identify(spark.createDataFrame([(1, "the dog and the cat", None, "", "")], DOCS), model).first()
        assert found["lang_pred"] == "en"


def test_every_one_of_many_languages_is_a_class(spark):
    rows = [(i, f"word{i % 300} text", f"l{i % 300:03d}", "", "") for i in range(600)]
    model = langid.train(spark.createDataFrame(rows, DOCS), per_language=3)
    assert len(model.languages) == 300


def test_flags_of_equal_rows_meet(spark):
    """A passage in very many equal rows flags each place once."""
    text = prose(1, 50)
    rows = [(1, text)] * 20_000 + [(2, f"{prose(2, 20)} {text}"), (3, prose(3))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    sizes = []
    made = substring._per_text

    def seen(*flags):
        out = made(*flags)
        sizes.append(out.selectExpr("max(octet_length(flags))").first()[0])
        return out

    substring._per_text = seen
    try:
        found = substring.remove_repeats(df).groupBy("doc_id", "n_words", "n_removed").count().collect()
    finally:
        substring._per_text = made
    assert sorted(map(tuple, found)) == [(1, 50, 50, 20_000), (2, 70, 50, 1), (3, 60, 0, 1)]
    assert max(sizes) <= 3 * substring._FLAG.itemsize * 70


def test_texts_that_share_an_id_are_judged_apart(spark):
    a, b, c = prose(4), prose(5), prose(6)
    rows = [(1, a), (5, f"{a} more"), (5, b), (9, b), (8, c), (8, f"{c} more"), (8, f"{c} more"), (3, None), (3, ""), (None, a), (None, "lone text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in corpus_pipeline.near_dedup(spark, df, "").collect()]
    assert len(kept) == len(set(kept))
    assert (1, a) in kept and (5, f"{a} more") not in kept
    assert sum(t == b for _, t in kept) == 1 and sum(t in (c, f"{c} more") for _, t in kept) == 1
    assert (3, None) in kept and (3, "") in kept and (None, "lone text") in kept and (None, a) not in kept
