"""Tokenisation, formatting, extraction and decontamination, against libraries, round trips and brute force."""

import html
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narrata.llm import bpe_codec, chat, decontam, html_text, oracle, queries, tokencount
from narrata.llm.common import sha
from tests import oracle as sql

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_tokens", T.StringType()), T.StructField("ids", T.StringType())])


def odd_texts(n=300):
    r = random.Random(2)
    parts = [*"'stmdrvle aB19!?.-\n\t 　éß漢字🙂\x1c\x00_", "'re", "'ll", "'ve", "<|endoftext|>", "  ", "\n\n", "\r\n", "don't", " it's"]
    return ["".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(n)]


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)], DOCS)


EDGES = [None, "", " ", "a" * 20_000, "word " * 30_000, "same", "same"]


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_codec.read_ranks(RANKS), special_tokens={})


def test_codec_equals_the_library(spark, tiktoken_encoding):
    texts = odd_texts() + EDGES
    rows = {r["doc_id"]: r for r in bpe_codec.encode_documents(documents(spark, texts), RANKS, public_tokenizers.PATTERN).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        ids = tiktoken_encoding.encode_ordinary(t or "")
        assert rows[i]["ids"] == ids and rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == sha(" ".join(map(str, ids)).encode())
        assert rows[i]["decoded_sha256"] == sha((t or "").encode())


def test_codec_remembers_within_its_bound(tiktoken_encoding, monkeypatch):
    monkeypatch.setattr(bpe_codec, "REMEMBERED", 5)
    tool = bpe_codec.Codec(bpe_codec.read_ranks(RANKS), public_tokenizers.PATTERN)
    for t in odd_texts(60):
        assert tool.encode(t) == tiktoken_encoding.encode_ordinary(t)
    assert len(tool.memory.known) <= 5 and len(tool.memory.older) < 120


def test_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(JSON)
    texts = odd_texts() + EDGES
    rows = {r["doc_id"]: r for r in tokencount.count_tokens(documents(spark, texts), JSON).collect()}
    expected = [len(e.ids) for e in tool.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [rows[i]["n_tokens"] for i in range(len(texts))] == expected
    assert [rows[i]["n_bytes"] for i in range(len(texts))] == [len((t or "").encode()) for t in texts]
    assert [rows[i]["over_limit"] for i in range(len(texts))] == [n > 1024 for n in expected]


def test_long_words_within_the_bound(monkeypatch):
    """Chunk maps of long words give the library's counts, and what is compiled stays within its bound."""
    from tokenizers import Tokenizer

    lib, r = Tokenizer.from_file(JSON), random.Random(3)
    monkeypatch.setattr(tokencount, "TRANSITIONS", 5000)
    counter, _ = tokencount.machine(JSON)
    counter.go.clear()
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(n)) for n in (255, 256, 257, 3000, 40_000)] + ["the" * 5000, "a" * 9999]
    for w in words:
        assert counter.count(w) == len(lib.encode(w, add_special_tokens=False).ids)
        assert len(counter.go) <= 5000 + tokencount.CHUNK_BYTES and len(counter.maps) <= 5000 // tokencount.CHUNK_BYTES
    # Composing the maps of two halves is reading the whole.
    data = words[3].encode()
    middle, first = counter.read(0, data[:1000])
    end, second = counter.read(middle, data[1000:])
    assert counter.read(0, data) == (end, first + second)


def test_chunk_maps_compose_to_a_serial_reading():
    import numpy as np

    classes = np.append(np.random.default_rng(1).integers(0, 10, 5000).astype(np.uint8), tokencount.BREAK)
    state, begins = tokencount.OPEN, set()
    for i, c in enumerate(classes):
        mark = tokencount.MARKS_OF[c, state]
        begins |= {i} if mark & tokencount.HERE else set()
        begins |= {i - 1} if mark & tokencount.BEFORE else set()
        state = tokencount.NEXT[c, state]
    assert tokencount.starts(classes).tolist() == sorted(begins)


def test_empty_documents(spark):
    none = documents(spark, []).where("false")
    assert bpe_codec.encode_documents(none, RANKS, public_tokenizers.PATTERN).count() == 0
    assert tokencount.count_tokens(none, JSON).count() == 0
    assert decontam.find_contamination(none, none.withColumnRenamed("doc_id", "item_id")).count() == 0


# Chat formatting


TURNS = "conv_id long, turn long, role string, text string, formatted string"


def read_back(spark, rows):
    done = chat.format_conversations(spark.createDataFrame(rows, TURNS))
    found = done.select("conv_id", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("lost"), "valid", "bad_turn", "n_turns")
    return {r["conv_id"]: r for r in found.collect()}


def test_forged_markers_survive_a_round_trip(spark):
    r = random.Random(6)
    pieces = ["<|turn|>", "<|end|>", "\\", "\n", "[INST]", "</s>", "<", "|", "x", "é", "<|end|", "[/INST]", "<|", "assistant\n"]
    rows, said = [], {}
    for c in range(60):
        said[c] = [("user" if t % 2 == 0 else "assistant", "".join(r.choice(pieces) for _ in range(r.randrange(12)))) for t in range(1 + c % 5)]
        rows += [(c, t, role, text, "clash") for t, (role, text) in enumerate(said[c])]
    found = read_back(spark, rows)
    for c, turns in said.items():
        assert [(x["role"], x["text"]) for x in found[c]["turns"]] == turns
        assert found[c]["lost"] == "".join(t for role, t in turns if role == "assistant")


@pytest.mark.parametrize(
    ("roles", "valid", "bad"),
    [("su", True, None), ("sua", True, None), ("ua", True, None), ("uaua", True, None), ("s", False, None), ("a", False, 0), ("uu", False, 1), ("uas", False, 2), ("ssu", False, 1), ("ux", False, 1), ("un", False, 1)],
)
def test_role_automaton(spark, roles, valid, bad):
    names = {"s": "system", "u": "user", "a": "assistant", "x": "tool\nbox", "n": None}
    row = read_back(spark, [(1, t, names[x], None, "") for t, x in enumerate(roles)])[1]
    assert (row["valid"], row["bad_turn"], row["n_turns"]) == (valid, bad, len(roles))
    assert [x["role"] for x in row["turns"]] == [names[x] or "" for x in roles]


def test_ties_repeats_and_nulls(spark):
    rows = [(None, None, "user", None, ""), (None, 1, "assistant", "b", ""), (None, 1, "assistant", "a", ""), (None, 1, "assistant", "a", "")]
    row = read_back(spark, rows)[None]
    assert [x["text"] for x in row["turns"]] == ["", "a", "a", "b"] and row["lost"] == "aab"
    assert read_back(spark, rows[:1])[None]["n_turns"] == 1
    assert chat.format_conversations(spark.createDataFrame([], TURNS)).count() == 0


def test_long_roles_and_texts(spark):
    long = "a\n<|end|>\\" * 200_000
    row = read_back(spark, [(1, 0, long, long, ""), (1, 1, "assistant", "x" * 1_000_000, "")])[1]
    assert row["turns"][0]["role"] == row["turns"][0]["text"] == long and len(row["lost"]) == 1_000_000 and row["bad_turn"] == 0


def test_templates_are_checked():
    with pytest.raises(ValueError):
        chat.Template(end="<<end>").controls()


@pytest.mark.parametrize("name", ["op4_decontamination", "op8_chat_format"])
def test_queries_equal_sql(spark, sf, name):
    sql.check(queries.queries()[name](spark, sf), sql.connect(sf), oracle.SQL[name])


# Decontamination


def contaminated_by_hand(docs, items, window):
    found = {}
    for name, t in items:
        w = decontam.words(t)
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            found.setdefault(tuple(w[i : i + m]), set()).add("" if name is None else str(name))
    out = []
    for t in docs:
        w, hit, names = decontam.words(t), set(), set()
        for m in {len(k) for k in found}:
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) in found:
                    names |= found[tuple(w[i : i + m])]
                    hit |= set(range(i, i + m))
        out.append((len(w), len(hit), len(names), sha(",".join(sorted(names)).encode()), bool(hit)))
    return out


@pytest.mark.parametrize("shard", [1 << 20, 60])
@pytest.mark.parametrize("window", [1, 2, 4, 10])
def test_search_equals_brute_force(spark, window, shard):
    r = random.Random(window)
    vocabulary = ["a", "b", "C", "d", "é", "ß-x", "9"]
    text = lambda n: "".join(r.choice(vocabulary) + r.choice([" ", ", ", "\n"]) for _ in range(n))
    items = [(i % 9, text(r.randrange(14))) for i in range(12)] + [(None, "a b c d a b c d"), (50, None), (51, ""), (52, "...")]
    docs = [text(r.randrange(60)) for _ in range(40)] + [None, "", "x" * 5000, "A B C D a b c d " * 3000]
    df, bench = documents(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    rows = decontam.find_contamination(df, bench, window=window, shard_bytes=shard).orderBy("doc_id").collect()
    assert [tuple(x)[1:] for x in rows] == contaminated_by_hand(docs, items, window)


def test_no_items(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_contamination(documents(spark, ["a b"]), bench).first()["contaminated"] is False


# HTML

STORY = "<h1>A  title &amp; more</h1><p>First <b>bold</b>\n line.<br>Next&nbsp;one<p>Second &lt;p&gt; &copy; <script>var x='</p>'</script>line.</p>"
MAIN = "A title & more First bold line. Next one Second <p> © line."


FURNITURE = (
    "<html><head><title>Harbour news</title><style>p{{x:y}}</style></head><body><header><h2>The Harbour Daily</h2> all the news</header>"
    "<nav><ul><li><a href=/a>Home</a><li><a href=/b>Weather today</a></ul></nav>{ad}{content}<aside><h3>Read next</h3><p>Ten boats that never came back</p></aside>"
    "<div class=comments><p>I liked this a lot, thanks</p><p>So did we</p></div><form action=/s><label>Search the archive</label></form>"
    "<div id=cookie-notice>We use cookies to count our readers</div><footer><p>All rights are kept by the harbour</p></footer></body></html>"
)


@pytest.mark.parametrize("shell", ["<article>{}</article>", "<main>{}</main>", '<div class="post-content">{}</div>', "<article><div>{}</div></article>"])
@pytest.mark.parametrize("ad", ["", "<div class='ad'>Buy our rope today, it is the best rope in town by far</div>", "<aside>Something else to read that is long enough to matter here</aside>"])
def test_main_text_of_layouts(shell, ad):
    assert html_text.main_text(FURNITURE.format(ad=ad, content=shell.format(STORY))) == MAIN


def f1(got, wanted):
    a, b = Counter(got.split()), Counter(wanted.split())
    return 2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values()))


def test_main_text_of_layouts_held_out():
    """Shells (main element, menu, comments) that nothing was learned from."""
    layouts = html_text.Layouts(5)
    pages = [layouts.page() for _ in range(1400)]
    shells = sorted({s for *_, s in pages})
    held = set(random.Random(1).sample(shells, len(shells) // 5))
    assert len(shells) - len(held) >= 30
    found = html_text.learn([(p, m) for p, m, s in pages if s not in held])
    scores = [f1(html_text.main_text(p, found), m) for p, m, s in pages if s in held]
    assert len(scores) >= 150 and sum(scores) / len(scores) >= 0.95
    # Words score positive, tags negative, and nothing but the region and its left-out blocks decides.
    assert max(found.tag.values()) < 0


TOLD = "<h1>The fog</h1><p>The ferry left before the fog had lifted and nobody on the quay saw which way it went.</p><p>By noon the bell had rung three times, and then it rang no more.</p>"
TOLD_TEXT = "The fog The ferry left before the fog had lifted and nobody on the quay saw which way it went. By noon the bell had rung three times, and then it rang no more."
MORE = "It was in all the papers the next day, they say."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f'<div class="site has-sidebar"><article>{TOLD}</article><aside>Read on here</aside></div>', TOLD_TEXT),
        (f'<body class="header-fixed"><div class="header-fixed"><main>{TOLD}</main></div>', TOLD_TEXT),
        (f'<div class="search-enabled"><article>{TOLD}</article></div>', TOLD_TEXT),
        (f'<article>{TOLD}<p class="notice-of-news">{MORE}</p></article>', f"{TOLD_TEXT} {MORE}"),
        (f'<article>{TOLD}<p class="alert-free">{MORE}</p></article>', f"{TOLD_TEXT} {MORE}"),
        (f"<article>{TOLD}</article><nav><ul>{'<li><a href=x>One more link</a>' * 60}</ul></nav><article><p>{MORE}</article>", f"{TOLD_TEXT} {MORE}"),
        (f'<div class="text">Welcome to our site, please look around.</div><div>{TOLD}{TOLD}</div>', f"{TOLD_TEXT} {TOLD_TEXT}"),
        (f'<div>{TOLD}{TOLD}</div><div class="guestbook"><p>I liked this a lot, thanks.</p><p>So did we all, I think.</p></div>', f"{TOLD_TEXT} {TOLD_TEXT}"),
        (f'<article>{TOLD}</article><div class="guestbook"><p>I liked this a lot, thanks.</p></div>', TOLD_TEXT),
        (f"<article>{TOLD}<p>End.</article><footer>&copy; Fog &middot; A long line. And another one. And one more of them all.</footer>", f"{TOLD_TEXT} End."),
    ],
)
def test_classes_are_evidence_not_verdicts(page, text):
    assert html_text.main_text(page) == text


def test_boilerplate_inside_the_article():
    page = "<article><p>one two three four</p><div class=advert>buy buy buy buy buy buy buy</div><form>name <input></form><p>five six</p><section id=comments><p>me too</p></section></article><footer>the end</footer>"
    assert html_text.main_text(page) == "one two three four five six"


@pytest.mark.parametrize("page", [None, "", "<p", "<!-- x", "<html><head><title>t</title></head></html>", "<nav>a b c</nav>", "</p></div>", "<script>"])
def test_pages_without_text(page):
    assert html_text.main_text(page) == ""


def test_deep_and_long_pages():
    page = "<article>" + "<p><b>word " * 20_000 + "</article>"
    assert html_text.main_text(page) == " ".join(["word"] * 20_000)
    assert len(html_text.main_text("<article>" + "<div>One more line. " * 30_000).split()) >= 89_990


def test_region_is_the_best_of_all():
    r = random.Random(8)
    for _ in range(300):
        scores = [r.choice([-2.0, -1.0, -0.5, 0.5, 1.0, 2.0]) for _ in range(r.randrange(12))]
        best = max([0.0, *(sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1))])
        a, b = html_text.best_region(scores)
        assert sum(scores[a:b]) == best


def test_pages_of_the_table(spark, sf):
    rows = queries.op9_html_extraction(spark, sf).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect()
    for r in rows:
        inner = re.sub(r"<[^>]*>", " ", re.search(r"<article>(.*)</article>", r["html"], re.S)[1])
        assert r["text"] == " ".join(html.unescape(inner).split()) and r["n_chars"] == len(r["text"])


def test_extract_keeps_rows_and_drops_clashes(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (1, "u", "<article><p>hi</article>", "x"), (None, "u", "", "x")], "page_id long, url string, html string, text string")
    assert sorted(tuple(r) for r in html_text.extract(pages).fillna(-1).fillna("").collect()) == [(-1, "u", "", 0), (1, "", "", 0), (1, "u", "hi", 2)]


def test_deep_pages_and_many_inline_tags_stay_linear():
    """20 000 nested elements, each with a class of its own, and a block of very many pieces."""
    import tracemalloc

    own = lambda i: "".join(chr(97 + int(d)) for d in str(i)) + "x"
    deep = "<article>" + "".join(f"<div class={own(i)}>" for i in range(20_000)) + "<p>The story is told here, at the end of it all.</p>"
    weights = html_text.weights()
    tracemalloc.start()
    html_text.main_text(deep, weights)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 200 << 20
    many = "<article><p>" + "<b>word</b> and " * 40_000 + "the end.</p></article>"
    assert html_text.main_text(many, weights) == "word and " * 40_000 + "the end."


def test_features_around_a_block_count_once():
    page = html_text.parse('<div class="story"><div class="story"><p>One two three four five.</p></div><p>More.</p></div>')
    html_text.describe(page)
    first, second = (html_text.features_of(page, b) for b in page.blocks)
    assert "t:p" in first and "t:p" in second and sum(f.startswith("t:div") for f in first) == 1
    w = html_text.Weights({f: 1.0 for f in first | second}, {})
    assert w.scores(page) == [len(first), len(second)]
