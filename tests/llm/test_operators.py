"""The training-data operators against plain versions: ties, nulls, empty and long texts, repeats, empty tables, extra columns."""

import os
import pathlib
import random
import time
import zlib

import brute
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docloom.llm import components, decontaminate, exact_dedup, html_text, language_id, line_dedup, minhash, packing, set_join, substring_dedup, token_store, toxicity
from docloom.llm.common import scratch_path
from docloom.llm.encode import MemoEncoder

SCHEMA = "doc_id long, text string, lang string, source string, id string, n long, kept boolean, part int, row long, words string"
BENCHMARK = [(1, " ".join(f"w{i}" for i in range(20))), (2, "short item here"), (3, None), (10, "the same thirteen words again and again until the window is full ok")]


def corpus():
    rng = random.Random(7)
    vocabulary = [f"{a}{b}" for a in ("lor", "ip", "dol", "sit", "am", "éc") for b in ("em", "sum", "or", "et", "o", "ßa")]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = [say(60) + ".\n" + say(40) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    for k in range(12, 40):
        words = base[k % 4].split(" ")
        for _ in range(k % 3):
            words[rng.randrange(len(words))] = "edited"
        rows.append((k, " ".join(words)))
    rows += [(50, None), (51, ""), (52, " \n\t"), (53, "one"), (54, "one"), (55, "ONE"), (56, "a b\n\na b\nB A\n"), (57, base[0] + "  " + BENCHMARK[0][1] + " tail"), (58, say(6000)), (59, "x" * 5000), (60, "y " * 400), (61, base[1].upper()), (62, "short item here, " + say(50)), (63, "Σ İ <|endoftext|> \x1c don't 12"), (64, base[2][:90])]
    return rows


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    extra = ("en", "s", "x", 1, True, 3, 4, "w")
    return spark.createDataFrame([(d, t, *extra) for d, t in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def by_id(df, *names):
    return {r.doc_id: tuple(r[n] for n in names) for r in df.collect()}


def test_exact(docs, nothing):
    for since in (None, -1, 20, 1000):
        got = {tuple(r) for r in exact_dedup.exact_dedup(docs, since=since).collect()}
        assert got == brute.exact(ROWS)
    assert exact_dedup.exact_dedup(nothing).count() == 0


def test_exact_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, " a "), (2, "c")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(df).collect()), key=str)
    assert got == [(1, None, 3, False), (1, None, 3, False), (2, 2, 1, True), (None, None, 3, True)]


def test_exact_of_hot_and_long_texts_and_extreme_ids(spark):
    """A text that a third of all rows hold, texts of a megabyte, the least and largest ids, rows equal in everything."""
    long = "z " * 600_000
    rows = [(i, "hot" if i % 3 == 0 else f"own {i}") for i in range(300)] + [(-(2**63), long), (2**63 - 1, "z" * 600_000), (7, "own 7"), (5, "own 5 ")]
    found = exact_dedup.exact_dedup(spark.createDataFrame([(*r, "x", True) for r in rows], "doc_id long, text string, digest string, kept boolean").repartition(4)).collect()
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in found)
    assert [g for g in got if g[2] == 100 and g[3]] == [(0, 0, 100, True)]
    assert got[0] == (-(2**63), -(2**63), 2, True) and got[-1] == (2**63 - 1, -(2**63), 2, False)
    assert [g[3] for g in got if g[0] == 7].count(True) == 1 and sorted(g[3] for g in got if g[0] == 5) == [False, True]


def test_fuse_filter():
    keys = np.random.default_rng(1).integers(0, 2**63, 30_000).astype(np.uint64)
    for n in (0, 1, 2, 100, 20_000):
        f = exact_dedup.BinaryFuse.build(keys[:n])
        assert f.contains(keys[:n]).all()
        assert f.contains(keys[20_000:]).mean() < 0.001


def test_substrings(docs, nothing):
    got = by_id(substring_dedup.substring_dedup(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.repeats(ROWS)
    assert substring_dedup.substring_dedup(nothing).count() == 0


@pytest.mark.parametrize("n", [1, 2, 40])
def test_substrings_of_unlike_texts(spark, n):
    """No context repeats in any batch."""
    rng = random.Random(n)
    rows = [(i, " ".join(f"u{rng.randrange(10**9)}" for _ in range(60))) for i in range(n)]
    got = by_id(substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(n)), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.repeats(rows) and not any(v[1] for v in got.values())


def test_substrings_of_null_and_repeated_ids(spark):
    """Null ids are smallest and one document, as are rows of one id; a text over one block of 262,144 bytes repeats an earlier one."""
    rng = random.Random(9)
    say = lambda n: " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    a, b, long = say(20), say(20), say(30_000)
    rows = [(None, a), (None, a), (1, "x " + a), (2, b), (2, b + "."), (3, "y " + b), (4, long), (5, "z" + long)]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans) for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect())
    gone = {1: len(a), 3: len(b), 5: len(long)}
    assert got == sorted((str(d), len(t), gone.get(d, 0), int(d in gone)) for d, t in rows)


def test_suffix_levels():
    family, seen = substring_dedup.LevelFamily(), {}
    rng = random.Random(3)
    for doc in range(40):
        windows = np.array([b"%04d" % rng.randrange(200) for _ in range(30)], dtype="S4")
        want = [min(seen.get(w, doc), doc) for w in windows.tolist()]
        assert family.add(windows, np.full(30, doc)).tolist() == want
        for w in windows.tolist():
            seen.setdefault(w, doc)
    assert len(family.levels) < 8


@pytest.mark.parametrize("options", [{}, {"frequent": 2}, {"frequent": 20, "tile": 4}, {"threshold": 0.5, "frequent": 3}])
def test_lines(docs, nothing, options):
    got = by_id(line_dedup.line_dedup(docs, **options), "n_lines", "n_removed", "n_links")
    assert got == brute.similar_lines(ROWS, options.get("threshold", 0.8))
    assert line_dedup.line_dedup(nothing, **options).count() == 0


def test_links_of_lines(docs):
    """Each link once, and as many as the classes count."""
    _, classes, links = line_dedup.similar_lines(docs, frequent=20, tile=4)
    rows = [tuple(r) for r in links.collect()]
    assert len({frozenset(r) for r in rows}) == len(rows) > 20
    assert sum(r.links for r in classes.collect()) == 2 * len(rows)


def test_units_that_share_sets_go_together(spark):
    """Near copies share many words, so they meet under many keys; their words are still sent about once."""
    rng = random.Random(8)
    family = [[f"f{f}w{i}" for i in range(40)] for f in range(30)]
    rows = [(12 * f + k, " ".join(w if rng.random() > 0.03 else f"x{rng.randrange(10**9)}" for w in words)) for f, words in enumerate(family) for k in range(12)]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(4)
    table, names, _ = set_join.counted(docs.select("text"), line_dedup._text_words)
    ranks, plan = spark.sparkContext.broadcast(table), set_join.Plan(0.8)
    units = set_join.candidates(line_dedup.keyed(docs, ranks, plan, 16), plan, by_sets=True).cache()
    met, sent = (set_join.unrolled(x, y).select(y, "c1").distinct() for x, y in ((units.withColumn("own", F.col("gid")), "own"), (set_join.homes(units), "dest")))
    sets = met.select("c1").distinct().count()
    assert sets > 250 and sent.select("c1").distinct().count() == sets
    assert sent.count() < 1.2 * sets < 2 * sets < met.count()


def test_codes_give_back_the_words():
    rng = np.random.default_rng(5)
    known, sizes = np.unique(rng.integers(1, 1 << 63, 500, dtype=np.uint64)), np.array([3, 0, 40, 1])
    slots = np.unique(set_join.slot(known), return_index=True)[1]
    book = set_join.Codebook(known[slots])
    words = np.where(rng.random(44) < 0.5, rng.choice(known, 44), rng.integers(0, 1 << 63, 44, dtype=np.uint64))
    words[:2] = 0, known[slots][0] ^ np.uint64(1)  # in the bucket of a known word
    o = np.concatenate(([0], np.cumsum(sizes)))
    codes, others = book.encoded(words, o)
    back = book.decoded(codes.to_pylist(), others.to_pylist())
    assert (back[0] == words).all() and (back[-1] == o).all() and len(set(zip(back[0].tolist(), back[1].tolist()))) == len(set(words.tolist()))
    assert 0 < sum(len(x) for x in others.to_pylist()) < 8 * 44


def test_lines_of_null_and_repeated_ids(spark):
    """Null ids come first; rows of one id are one document; a line of over 65,535 words is compared whole."""
    long = [f"q{i}" for i in range(70_000)]
    near = " ".join([*long[:69_999], "other"])
    rows = [(None, "a b c d e\nf g h i j"), (None, "k l m n o"), (1, "k l m n o x"), (1, "e d c b a"), (1, "p q r s t u v w"), (2, "p q r s t u v z"), (3, " ".join(long)), (4, near), (5, " ".join(long[:40_000]))]
    got = sorted((str(r.doc_id), r.n_lines, r.n_removed, r.n_links) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    assert got == [("1", 3, 2, 1), ("2", 1, 0, 0), ("3", 1, 0, 1), ("4", 1, 1, 1), ("5", 1, 0, 0), ("None", 3, 0, 1)]


def test_decontamination(docs, nothing, spark):
    items = spark.createDataFrame(BENCHMARK, "item_id long, text string")
    want = brute.contaminated(ROWS, BENCHMARK)
    names = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert by_id(decontaminate.decontaminate(docs, items), *names) == want
    assert by_id(decontaminate.decontaminate(docs, items, chunk=1), *names) == want
    assert decontaminate.decontaminate(nothing, items).count() == 0
    assert all(not r.n_hit for r in decontaminate.decontaminate(docs, items.limit(0)).collect())


@pytest.mark.parametrize("chunk", [1, 128])
def test_decontamination_of_null_and_repeated_ids(spark, chunk):
    """Each row is judged for itself; an item without an id is hit, but not listed; columns in `also` come through."""
    items = [(1, BENCHMARK[0][1]), (None, BENCHMARK[3][1]), (2, BENCHMARK[0][1]), (2, "short item here"), (3, "... !")]
    rows = [(7, "x " + BENCHMARK[0][1], "a"), (7, "nothing to see", "b"), (None, BENCHMARK[3][1], "c"), (None, "Short ITEM here", "d"), (8, None, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string").repartition(3)
    found = decontaminate.decontaminate(df.withColumn("mark", F.col("n_words")), spark.createDataFrame(items, "item_id long, text string"), chunk=chunk, also=("mark",))
    got = sorted((r.mark, r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in found.collect())
    assert got == [("a", 7, 21, 20, 2, True), ("b", 7, 3, 0, 0, False), ("c", None, 13, 13, 0, True), ("d", None, 3, 3, 1, True), ("e", 8, 0, 0, 0, False)]


def test_token_store(docs, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = by_id(token_store.encode_documents(docs, path), "start", "n_tokens", "ids_crc32")
    assert got == brute.token_rows(ROWS, Tokenizer.from_file(path), 0)
    assert token_store.encode_documents(nothing, path).count() == 0
    ids = np.random.default_rng(2).integers(0, 70_000, 5000).astype(np.uint32)
    s = token_store.Segment(token_store.pack(ids, np.array([4, 9]), np.array([0, 700])))
    places = np.array([0, 4999, 17, 700])
    assert (s.all() == ids).all() and (s.get(places) == ids[places]).all() and (s.document(1) == ids[700:]).all()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder(name):
    path = public_tokenizers.path(name)
    plain = Tokenizer.from_file(path)
    odd = ["\n", "a\n", "\na b", "a\n\n\nb", " a", "a ", "a  b   c \n d", "x***, y&& 1x. x_1 _a.", "ŉb é!! é a", "\0a b\0 \0c", "x y 　z", "  a", "a\r\nb", "Σας. İ ſ K ẞ ǅ"]
    for capacity in (4, 100_000):
        encoder = MemoEncoder(path, capacity)
        for t in odd + [t or "" for _, t in ROWS]:
            assert np.frombuffer(encoder.encode([t])[0], "<u2").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t[:40])


def test_near_duplicates(docs, nothing, spark):
    got = {d: c for d, (c,) in by_id(minhash.near_duplicates(docs), "class_id").items()}
    assert got == brute.near_classes(ROWS)
    assert minhash.near_duplicates(nothing).count() == 0
    assert {d: c for d, (c,) in by_id(minhash.near_duplicates(docs, all_pairs=2), "class_id").items()} == got


def test_near_duplicates_of_null_and_repeated_ids(spark):
    """Each row is placed by its own text; null ids come last in a class; one row of each class stays, also of equal ones."""
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(0, base, "a"), (1, base + " tail", "b"), (1, "nothing like the others at all " * 3, "c"), (None, base + " end", "d"), (None, "x y z", "e"), (None, "X y z", "f"), (2, "", "g"), (2, None, "h"), (0, base, "i")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string").repartition(4)
    got = {r.mark: (r.doc_id, r.class_id, r.kept) for r in minhash.near_duplicates(df.withColumn("mark", F.col("kept")), also=("mark",)).collect()}
    assert {k: v[:2] for k, v in got.items()} == {"a": (0, 0), "b": (1, 0), "c": (1, 1), "d": (None, 0), "e": (None, None), "f": (None, None), "g": (2, 2), "h": (2, 2), "i": (0, 0)}
    stay = {k for k, v in got.items() if v[2]}
    assert stay >= {"c", "g", "h"} and len(stay & {"a", "i"}) == len(stay & {"e", "f"}) == 1 and len(stay) == 5


def test_near_duplicates_around_a_base_that_is_not_the_smallest(spark):
    """Copies with three edits each: 0.86 to the base, about 0.74 to each other; only the base ties them together."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = [(150, " ".join(base))]
    for i in range(301):
        if i != 150:
            words = list(base)
            for at in rng.sample(range(5, 195), 3):
                words[at] = f"e{i}x{at}"
            rows.append((i, " ".join(words)))
    got = {d: c for d, (c,) in by_id(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)), "class_id").items()}
    assert got == brute.near_classes(rows)
    assert list(got.values()).count(0) > 290


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(8)
    edges = {"path": [(i, i + 1) for i in range(40)], "star": [(7, i) for i in range(8, 40)], "random": [(rng.randrange(60), rng.randrange(60)) for _ in range(45)], "none": []}[shape]
    parent = {n: n for e in edges for n in e if e[0] != e[1]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    df = spark.createDataFrame(edges, "a long, b long")
    half = components.components(df.where("a % 2 = 0"))
    for a, b in edges:
        if a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    want = {n: find(n) for n in parent}
    assert {r.node: r.root for r in components.components(df).collect()} == want
    got = {r.node: r.root for r in components.extended(half, df.where("a % 2 = 1 and a <> b")).collect()}
    assert got == want


def test_bag_minhash_is_unbiased():
    rng = np.random.default_rng(5)
    s = rng.integers(0, 2**40, 300).astype(np.uint64)
    a, b = rng.integers(1, 9, 300), rng.integers(1, 9, 300)
    order = np.argsort(s)
    s, a, b = s[order], a[order], b[order]
    sig = minhash.signatures(np.concatenate((s, s)), np.concatenate((a, b)), np.array([0, 300, 600]), registers=4096)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


def test_packing(docs, nothing):
    path = public_tokenizers.path("word_bpe_49k.json")
    want = brute.token_rows(ROWS, Tokenizer.from_file(path), 1)
    rows = packing.pack_documents(docs, path, capacity=512, group_items=16).collect()
    for d, (_, n, crc) in want.items():
        own = sorted((r for r in rows if r.doc_id == d), key=lambda r: r.piece)
        assert sum(r.length for r in own) == n and [r.start for r in own] == list(range(0, n, 512))
        if len(own) == 1:
            assert own[0].ids_crc32 == crc
    bins = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert r.offset == bins.get(r.sequence_id, 0)
        bins[r.sequence_id] = r.offset + r.length
    assert max(bins.values()) <= 512 and len(bins) <= -(-sum(bins.values()) // 512) + 4
    assert packing.pack_documents(nothing, path).count() == 0


def test_genetic_packing_beats_plain_best_fit():
    rng = random.Random(1)
    sizes = [rng.randint(200, 700) for _ in range(300)]
    first = packing.seed(sizes, 1000, rng, 0.0)
    best = packing.evolve(sizes, [packing.seed(sizes, 1000, rng, 0.05 * k) for k in range(4)] + [first], 1000, 6, rng, 4)[0]
    assert packing.fitness(sizes, best, 1000) >= packing.fitness(sizes, first, 1000)
    assert sorted(i for b in best for i in b) == list(range(300)) and all(sum(sizes[i] for i in b) <= 1000 for b in best)


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "</p><article>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/">Home</a><li><a href="/b">More</a></ul></nav><div class="cookie-notice">We use cookies on this site, accept them all now.</div>
<main><article><h1>The   title &amp; more</h1><p><b>First &lt;para&gt;<br>line two<p>Second&nbsp;para with <a href="x">a link</a> and &eacute;&#233;&#xe9; text that goes on for a while.</p><ul><li>Es.</li><li>x</li></ul>
<form><input><p>Subscribe here</p></form><section class="comments"><p>Great post, thank you so much for writing all of this!</p></section></article></main>
<aside><p>Related stories that are long enough to look like an article, really.</p></aside><footer>&copy; 2024 all rights reserved by somebody or other</footer>"""


def test_pages(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "plain &amp; simple"), (5, "u", "<p>cut <b>off &am"), (6, "u", "<" * 50 + "div" * 9)]
    df = spark.createDataFrame([(*r, "text") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_text.extract(df).collect()}
    assert got[1].text == "The title & more\nFirst <para> line two\nSecond para with a link and ééé text that goes on for a while.\nEs.\nx"
    assert [got[i].text for i in (2, 3, 4, 5)] == ["", "", "plain & simple", "cut off &am"] and got[4].n_chars == 14
    assert html_text.extract(df.limit(0)).count() == 0
    deep = "<div>" * 3000 + "words in the deep" + "</div>" * 3000
    assert html_text.main_text(deep) == "words in the deep"


def test_pages_with_a_teaser_article_and_with_parts_below_the_body():
    story = " ".join(f"Sentence {i} of a long story that goes on and on." for i in range(40))
    assert html_text.main_text(f"<body><div id=story><p>{story}</p></div><article class=teaser><p><a href=x>Short teaser</a></p></article></body>").split("\n")[0] == story
    parts = [f"Part {k} " + story for k in (1, 2)]
    assert html_text.main_text("<body>" + "".join(f"<div>{x}</div>" for x in parts) + "</body>") == "\n".join(parts)


@pytest.mark.parametrize("name", ["post share-enabled", "side", "social", "related", "widget", "promo", "alert", "overlay", "skip", "nav"])
def test_a_name_alone_does_not_drop_the_only_text(name):
    assert html_text.main_text(f'<body><div class="{name}"><h1>Head line</h1><p>The only text of this page, in one element.</p></div></body>') == "Head line\nThe only text of this page, in one element."


def test_pages_made_of_known_parts():
    """Random pages from an article and things around it: the text is the article's blocks, whatever element holds them."""
    rng = random.Random(12)
    say = lambda n: " ".join(rng.choice(["river", "stone", "light", "été", "walk", "of", "the"]) for _ in range(n)).capitalize() + "."
    junk = ['<nav><ul><li><a href="/a">Home</a><li><a href="/b">All news</a></ul></nav>', '<div class="sidebar"><h3>More</h3><p>Some other story that is told here</p></div>', '<div id="cookie-consent"><p>We use cookies, you know how it goes by now.</p></div>', '<form><p>Write to us</p><input></form>', "<script>var p = '<p>not text</p>';</script>", '<footer><p>All rights reserved by the owner of this page</p></footer>', '<ul class="related"><li><a href="/x">One more</a><li><a href="/y">And another</a></ul>']
    for holder in ("article", "main", 'div class="post"', "div", "section id=content"):
        for _ in range(6):
            blocks = [say(rng.randint(25, 60)) for _ in range(rng.randint(2, 7))]
            inside = "".join(f"<p>{b}</p>\n" for b in blocks)
            rng.shuffle(junk)
            at = rng.randint(0, len(junk))
            comments = '<div class="comments"><p>What a fine read, thanks a lot for it.</p></div>'
            page = f"<html><body>{''.join(junk[:at])}<{holder}>{inside}</{holder.split()[0]}>{comments}{''.join(junk[at:])}</body></html>"
            assert html_text.main_text(page) == "\n".join(blocks), page


@pytest.mark.parametrize("part", ["<div>", "<a ", "<li>", "<!--", '<a "', "<p><table><td>", "<div><header></header>", "</span><div>"])
def test_long_pages_take_linear_time(part):
    def took(n):
        began = time.process_time()
        html_text.main_text(part * n + '"')
        return time.process_time() - began

    took(1000)
    assert took(120_000) < 30  # quadratic time would be minutes


def test_pages_with_repeated_ids_and_columns_to_keep(spark):
    df = spark.createDataFrame([(1, "u", "<p>a"), (1, "u", "<p>b"), (None, "v", "<p>c")], "page_id long, url string, html string")
    assert sorted((str(r.page_id), r.url, r.text) for r in html_text.extract(df).collect()) == [("1", "u", "a"), ("1", "u", "b"), ("None", "v", "c")]
    with pytest.raises(ValueError):
        html_text.extract(df.withColumnRenamed("url", "text"), keep=("text",))


def test_languages(spark):
    rng = random.Random(2)
    words = {"aa": ["the", "and", "house", "water", "running"], "bb": ["le", "maison", "eau", "courir", "été"]}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(30)), k) for i, k in enumerate(["aa", "bb"] * 60)]
    rows += [(900, None, None), (901, "", "aa"), (902, "12 34 !", "bb"), (903, "x" * 3000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df, public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in language_id.identify(df, model).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows[:120])
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[903].lang_pred in words
    none = language_id.train(df.limit(0), public_tokenizers.path("piece_bpe_32k.model"))
    assert {r.lang_pred for r in language_id.identify(df, none).collect()} == {"und"}


def test_languages_without_spaces_and_with_many_names(spark):
    """Texts without spaces are learned in parts cut between characters; repeated rows and clashing columns are harmless."""
    rng = random.Random(3)
    alphabets = {"ka": "აბგდევზთ", "th": "กขคงจฉชซ"}
    rows = [(i, "".join(rng.choice(alphabets[k]) for _ in range(300)), k) for i, k in enumerate(["ka", "th"] * 40)]
    rows += rows[:6] + [(2000 + i, f"word{i} here", f"l{i}") for i in range(12)]
    df = spark.createDataFrame([(*r, "x", 1.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    model = language_id.train(df, public_tokenizers.path("piece_bpe_32k.model"))
    assert set(alphabets) < set(model.languages)
    assert all(r.lang_pred == dict((i, k) for i, _, k in rows)[r.doc_id] for r in language_id.identify(df.where("doc_id < 1000"), model).collect())


def test_word_parts_are_cut_between_characters():
    text = ("ab" + "ก" * 200 + " x").encode()
    data = np.frombuffer(text, np.uint8)
    row, starts, ends, inner = language_id.word_parts(data, np.array([0, len(text)]))
    parts = [text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    assert b"".join(parts).decode() == "ab" + "ก" * 200 + "x" and all(p.decode() and len(p) < language_id.WIDTH for p in parts)
    assert inner.tolist() == [False] + [True] * (len(parts) - 2) + [False]


def test_forward_sums_all_segmentations():
    lattice = language_id.Lattice([b"a", b"b", b"ab", b"_", b"_a"])
    p = np.array([[0.1], [0.2], [0.3], [0.25], [0.15]])
    word = np.zeros((1, language_id.WIDTH), np.uint8)
    word[0, :3] = np.frombuffer(b"_ab", np.uint8)
    total, _ = language_id.forward(lattice, p, word, np.array([3]))
    assert np.isclose(total[0, 0], 0.25 * 0.1 * 0.2 + 0.25 * 0.3 + 0.15 * 0.2)


def test_toxicity(spark):
    rng = random.Random(4)
    say = lambda: " ".join(rng.choice(["good", "day", "sun", "tree", "walk", "river"]) for _ in range(8))
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        s = [say() for _ in range(4)]
        if bad:
            s[rng.randrange(4)] += " " + rng.choice(["vilest", "vilely", "rotten"])
        rows.append((i, ". ".join(s)))
        labels.append((i, int(bad)))
    rows += [(900, None), (901, ""), (902, "A rotten day. " + say())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(got[i].predicted == y for i, y in labels) and got[900].score == got[901].score == 0
    assert [(r.doc_id, r.sentence) for r in toxicity.locate(docs.where("doc_id = 902"), model).collect()] == [(902, 0)]
    assert toxicity.keep_clean(docs, model).count() == 302
    nothing = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.predicted for r in toxicity.score(docs, nothing).collect()} == {0}


def plain_packing(sizes, capacity):
    """Bins of best fit with sizes in falling order."""
    space = []
    for s in sorted(sizes, reverse=True):
        fits = [x for x in space if x >= s]
        if fits:
            space.remove(min(fits))
            space.append(min(fits) - s)
        else:
            space.append(capacity - s)
    return len(space)


def test_packing_of_null_and_repeated_ids_against_plain_best_fit(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(6)
    rows = [(rng.choice([None, 1, 2, i]), " ".join("word" for _ in range(rng.randint(1, 200)))) for i in range(300)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), path, capacity=256, group_items=150).collect()
    assert len(got) == 300 and sum(r.length for r in got) == sum(len(t.split()) + 1 for _, t in rows)
    assert len({r.sequence_id for r in got}) <= plain_packing([r.length for r in got], 256) + 2


def test_store_of_null_and_repeated_ids(spark):
    """Null ids come first; rows of one id follow each other by text; a document longer than a segment stays whole."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(3, "b"), (None, "z"), (3, "a"), (1, "long " * 500), (2, None)]
    store = scratch_path(spark, "tokens")
    token_store.write_store(spark.createDataFrame(rows, "doc_id long, text string"), store, path, segment_tokens=64)
    got = [(r.doc_id, r.start, r.n_tokens) for r in token_store.read_store(spark, store).orderBy("start").collect()]
    plain = Tokenizer.from_file(path)
    n = [len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for t in ("z", "long " * 500, "", "a", "b")]
    assert got == [(d, sum(n[:k]), n[k]) for k, d in enumerate([None, 1, 2, 3, 3])]


def test_store_moves_texts_and_images_in_small_pieces(spark, monkeypatch):
    """small images, row groups and columnar batches, so that a JVM never holds the images of a whole part; same results."""
    path, key, seen = public_tokenizers.path("byte_bpe_50k.json"), "spark.sql.parquet.columnarReaderBatchSize", []
    rng, words = random.Random(9), [f"w{i}" for i in range(2000)]
    rows = [(i, " ".join(rng.choices(words, k=4000))) for i in range(200)] + [(7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    store, before, write = scratch_path(spark, "tokens"), spark.conf.get(key), type(docs.write).parquet

    def watched(self, *given, **named):
        seen.append(int(spark.conf.get(key)))
        return write(self, *given, **named)

    monkeypatch.setattr(type(docs.write), "parquet", watched)
    token_store.write_store(docs, store, path)
    assert len(seen) == 1 and seen[0] <= 64 and spark.conf.get(key) == before
    metas = [pq.ParquetFile(f).metadata for f in pathlib.Path(store.removeprefix("file:")).glob("part-*")]
    groups = [m.row_group(k).column(5).total_uncompressed_size for m in metas for k in range(m.num_row_groups)]
    assert sum(groups) > 4 << 20 and max(groups) < 3 << 19
    assert max(len(r.image) for r in spark.read.schema(token_store.SCHEMA).parquet(store).collect()) < 1 << 18
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_store.read_store(spark, store).collect())
    plain, want, start = Tokenizer.from_file(path), [], 0
    for i, t in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((start, i, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


def test_toxicity_trains_off_the_driver(spark, monkeypatch):
    """texts and training stay in a task; the driver gets the same model as fit() makes of the same rows."""
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice(("lorem", "ipsum", "dolor", "sit", "amet")) for _ in range(n))
    rows = [(i, say(30) + (". you vile fool. " if i % 3 == 0 else ". ") + say(20), int(i % 3 == 0)) for i in range(200)]
    rows += [(7, "again " + say(9), 0), (7, None, 0), (300, "", 1)]
    want = toxicity.fit([t or "" for _, t, _ in sorted(rows, key=lambda r: (r[0], r[1] or ""))], [y for _, _, y in sorted(rows, key=lambda r: (r[0], r[1] or ""))])
    known = {i: y for i, _, y in rows}
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame(list(known.items()), "doc_id long, toxic int")

    def elsewhere(*given, fit=toxicity.fit, driver=os.getpid()):
        assert os.getpid() != driver
        return fit(*given)

    monkeypatch.setattr(toxicity, "fit", elsewhere)
    got = toxicity.learned(spark.createDataFrame(rows, "id long, text string, y int").repartition(3))
    assert want.weights.any() and (got.weights == want.weights).all() and got.bias == want.bias
    model = toxicity.train(docs, labels)
    assert model.weights.any() and model.bias != -30.0
    nothing = toxicity.learned(spark.createDataFrame([], "id long, text string, y int"))
    assert not nothing.weights.any() and nothing.bias == -30.0


def test_held_out_languages_and_toxicity(spark):
    """Accuracy and area under the curve on rows that trained nothing."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = language_id.identify(docs, language_id.train(docs, public_tokenizers.path("piece_bpe_32k.model")))
    rows = found.join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(rows) > 100 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where("held_out and toxic is not null").collect()
    good, bad = ([r.score for r in scored if r.toxic == y] for y in (0, 1))
    assert len(good) and len(bad)
    area = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(good) * len(bad))
    print(f"area under the curve {area:.4f} over {len(bad)} toxic and {len(good)} clean documents")
    assert area > 0.95


def test_toxic_sentence_late_in_a_long_text(spark):
    """Training reads whole texts; repeated rows and labels that contradict each other; clashing columns."""
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(["good", "day", "sun", "tree", "walk"]) for _ in range(n))
    rows = [(i, ". ".join(say(6) for _ in range(30)) + (". vilest rotten" if i % 3 == 0 else "")) for i in range(150)]
    rows[0] = (0, (say(8) + ". ") * 1000 + "vilest rotten")
    docs = spark.createDataFrame([(*r, 0.5, 7) for r in rows + rows[:5]], "doc_id long, text string, score double, predicted int")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(150)] + [(3, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == 155 and all(r.predicted == int(r.doc_id % 3 == 0) for r in got)


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    """Nulls, repeats, clashing columns and empty tables through every stage."""
    import corpus_pipeline

    sf = str(tmp_path)
    base = " ".join(f"v{i}" for i in range(60))
    rows = [(1, base), (1, base), (1, "unlike the rest of them"), (None, base + " z"), (None, "alone without an id"), (None, None), (2, ""), (3, BENCHMARK[0][1]), (4, "hold out")]
    spark.createDataFrame([(d, t, "en", "s", 5, "x") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(BENCHMARK, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(4, 1, 0)], "doc_id long, toxic int, quality int").write.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    texts = lambda df: sorted((str(r.doc_id), r.text or "") for r in df.collect())
    unique = corpus_pipeline.drop_copies(spark, docs, sf)
    assert unique.columns == docs.columns
    assert texts(unique) == sorted([("1", base), ("1", "unlike the rest of them"), ("None", base + " z"), ("None", "alone without an id"), ("2", ""), ("3", BENCHMARK[0][1]), ("4", "hold out")])
    assert texts(corpus_pipeline.drop_near_copies(spark, docs, sf)) == sorted([("1", base), ("1", "unlike the rest of them"), ("None", "alone without an id"), ("None", ""), ("2", ""), ("3", BENCHMARK[0][1]), ("4", "hold out")])
    assert texts(corpus_pipeline.drop_contaminated(spark, docs, sf)) == sorted((str(d), t or "") for d, t in rows if d != 3)
    assert texts(corpus_pipeline.drop_toxic(spark, docs, sf)) == sorted((str(d), t or "") for d, t in rows)
    assert corpus_pipeline.pack(spark, docs, sf).count() == len(rows)


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.score(docs, model).collect() if r.predicted}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in bad]
    copies = {i for i, _, _, kept, _ in brute.exact(rows) if not kept}
    rows = [r for r in rows if r[0] not in copies]
    near = brute.near_classes(rows)
    rows = [r for r in rows if near[r[0]] == r[0]]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    found = brute.contaminated(rows, items)
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == {d for d, _ in rows if not found[d][4]}
