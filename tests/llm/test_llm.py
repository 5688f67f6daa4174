import gzip
import hashlib
import io
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from papergrove.llm import html_wrapper, jaccard, media, mixing, ordinal, packing, queries, repetition, tokenbin, toxicity, warc
from papergrove.llm.runtime import prepare, stage
from papergrove.llm.tokenize import memo, resolve
from papergrove.llm.words import slices

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, "one two three"), (2, None), (3, ""), (4, " \n\t "), (5, "é ß 中文 🙂\r\nx"), (6, "w " * 30_000), (7, "one two three"), (7, "one two three"), (None, "no id at all"), (9, "a\x0bb\x1cc")]


def odd(spark):
    """Nulls, empty and long texts, repeated rows, and further columns with names the operators use."""
    rows = [(d, t, "en", "s" if k % 2 else None, len(t or ""), 0, 0, 0, 0) for k, (d, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, token int, k1 int, block int, score int")


def empty(spark):
    return odd(spark).where("doc_id = -5")


def words(text):
    return WORDS.findall(text or "")


# words and tokens


@given(st.lists(st.text(alphabet="ab é\n\t\x0b\x1c中", max_size=12), max_size=6))
@settings(max_examples=60, deadline=None)
def test_words_are_those_of_the_pattern(texts):
    found = []
    for part in slices(pa.array(texts, pa.string()), 8):
        at = part.bounds()
        for k in range(part.n_docs):
            found.append([part.data[part.starts[i] : part.ends[i]].tobytes().decode() for i in range(at[k], at[k + 1])])
            h = part.hashes()[at[k] : at[k + 1]]
            assert len(set(h.tolist())) == len(set(found[-1]))
    assert found == [words(t) for t in texts]


@given(st.text(alphabet="aAzé É\n\t.,'s!<|>Σİß1中🙂#$ª", max_size=25))
@settings(max_examples=200, deadline=None)
def test_tokens_are_those_of_the_library(text):
    m = memo(resolve(queries.VOCABULARY))
    for t in (text, text + "<|endoftext|>" + text, "don't " + text):
        assert np.frombuffer(m.ids(t, None), "<u4").tolist() == m.tokenizer.encode(t, add_special_tokens=False).ids


def encoded(text):
    return [*memo(resolve(queries.VOCABULARY)).tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


# 1 media


@pytest.mark.parametrize("form", ["ppm", "bmp"])
def test_media_keep_the_payload(spark, form):
    got = media.store_and_read(spark, odd(spark), form).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got}
    for d, t in ODD:
        data = (t or "").encode()
        full = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        r = by[d]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
        assert np.load(io.BytesIO(r["tile"])).shape == (16, 16, 3)
    assert by[1]["media_sha256"] == by[7]["media_sha256"] and by[1]["feature"] == by[7]["feature"]
    assert media.store_and_read(spark, empty(spark)).count() == 0


def test_netpbm_bmp_and_resizing():
    x = np.random.default_rng(1).integers(0, 256, (13, 7, 3), np.uint8)
    assert (media.decode(media.encode_ppm(x)) == x).all() and (media.decode(media.encode_bmp(x)) == x).all()
    assert (media.decode(media.encode_ppm(x[:, :, :1])) == x[:, :, :1]).all()
    assert media.decode(b"P1\n# c\n2 2\n0 1\n1 0\n")[:, :, 0].tolist() == [[255, 0], [0, 255]]
    assert media.decode(b"P4\n2 1\n\x40")[:, :, 0].tolist() == [[255, 0]]
    assert media.decode(b"P2 2 1 3 0 3")[:, :, 0].tolist() == [[0, 255]]
    assert media.decode(b"P3 1 1 255 1 2 3")[0, 0].tolist() == [1, 2, 3]
    with pytest.raises(ValueError):
        media.decode(b"GIF8")
    big = np.repeat(np.repeat(x.astype(float), 5, 0), 4, 1)  # 65 x 28: cells of 13 x 7 pixels
    want = big.reshape(5, 13, 4, 7, 3).mean((1, 3))
    assert np.allclose(media.area_resize(x, 5, 4), want) and np.allclose(media.area_resize(x, 5, 4, strip=2), want)


@pytest.mark.parametrize("shape", [(1, 192, 3), (7, 192, 3), (40, 33, 1), (8, 9, 3), (2, 5, 3)])
def test_difference_hash_is_that_of_the_definition(shape):
    """Cells are told on an image blown up so that each holds whole pixels."""
    rng = np.random.default_rng(shape[0])
    for most in (3, 256):
        x = rng.integers(0, most, shape).astype(np.uint8)
        cells = np.repeat(np.repeat(x.astype(int), 8, 0), 9, 1).reshape(8, shape[0], 9, shape[1], shape[2]).sum((1, 3, 4))
        bits = "".join(str(int(cells[r, c + 1] > cells[r, c])) for r in range(8) for c in range(8))
        assert media.difference_hash(x) == f"{int(bits, 2):016x}"


# 2 main text


def page(main, nav="Home", note="Sign up now"):
    return f"<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><ul><li>{nav}</ul></nav><div class='cookie notice'>We use cookies</div><div id=c>{main}<p>{note}</p></div><aside>Read more</aside><form><p>Name</p></form><footer>&copy; x</footer></body></html>"


def test_wrapper_takes_what_varies(spark):
    rows = [(k, f"http://h.example/{k}", page(f"<h2>Title {k}</h2><p>Body&nbsp;of <b>page</b> {k} &amp; its\n text<br>goes on for a while.")) for k in range(6)]
    rows += [(10, None, None), (11, "", ""), (12, "http://other/", "<article><header><h1>A</h1><p>by me</p></header><p>One<p>Two <ul><li>x<li>y</ul><div class=comments><p>no</p></div></article><p>out")]
    rows += [(12, "http://other/", rows[-1][2])]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id long, url string, html string, host int, text string")
    got = {r["page_id"]: r for r in html_wrapper.main_texts(spark, df).collect()}
    for k in range(6):
        assert got[k]["text"] == f"Title {k}\n\nBody of page {k} & its text goes on for a while."
        assert got[k]["n_chars"] == len(got[k]["text"])
    assert got[10]["text"] == got[11]["text"] == "" and got[12]["text"] == "A\n\nOne\n\nTwo\n\nx\n\ny"
    assert html_wrapper.main_texts(spark, df).count() == len(rows) and html_wrapper.main_texts(spark, df.where("page_id < 0")).count() == 0


def main_of(spark, pages):
    df = spark.createDataFrame([(k, f"http://h.example/{k}", h) for k, h in enumerate(pages)], "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in html_wrapper.main_texts(spark, df).collect()}


def test_wrapper_keeps_all_that_varies(spark):
    two = [f"<nav>{k}</nav><article><p>First text {k} is the longer of two</article><article><p>Second {k}</article><p>Shared" for k in range(4)]
    assert main_of(spark, two) == {k: f"First text {k} is the longer of two\n\nSecond {k}" for k in range(4)}
    halves = [f"<div class=a><p>The upper part of text {k} is longer</div><div class=b><p>The lower part {k}</div><div class=c><p>Shared</div>" for k in range(4)]
    assert main_of(spark, halves) == {k: f"The upper part of text {k} is longer\n\nThe lower part {k}" for k in range(4)}
    alone = ["<article><p>One</article><article><p>Two</article><p>Shared", "<div><p>A longer one</div><div><p>Two</div>"]
    assert main_of(spark, alone) == {0: "One\n\nTwo", 1: "A longer one\n\nTwo"}


def test_copies_of_an_article_are_no_template(spark):
    texts = ["The same text", "The same text", "The same text", "Another text", "A third text"]
    pages = [f"<nav>{k}</nav><div class=ad>Buy {k}</div><article><p>{t}</article><p>Shared<footer>{k}</footer>" for k, t in enumerate(texts)]
    assert main_of(spark, pages) == dict(enumerate(texts))


def skeleton(shape, depth=0):
    name, kids = shape
    return "\n".join([f"{depth} {name}", *(skeleton(k, depth + 1) for k in kids)])


def brute_match(a, b):
    if a[0] != b[0]:
        return 0
    best = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
    for i, x in enumerate(a[1]):
        for j, y in enumerate(b[1]):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + brute_match(x, y))
    return best[-1][-1] + 1


SHAPES = st.recursive(st.sampled_from("abc").map(lambda n: (n, [])), lambda below: st.tuples(st.sampled_from("ab"), st.lists(below, max_size=4)), max_leaves=14)


@settings(max_examples=150, deadline=None)
@given(st.lists(SHAPES, max_size=4), st.lists(SHAPES, max_size=4))
def test_tree_matching_is_that_of_brute_force(x, y):
    a, b = html_wrapper.tree(skeleton(("r", x))), html_wrapper.tree(skeleton(("r", y)))
    size, pairs = html_wrapper.tree_match(a, b)
    assert size == brute_match(("r", x), ("r", y)) == len(pairs) == len({p for p, _ in pairs}) == len({q for _, q in pairs})
    to = dict(pairs)
    assert all(a.names[p] == b.names[q] and (p == 0 or to[a.parents[p]] == b.parents[q]) for p, q in pairs) and [q for _, q in pairs] == sorted(to.values())


@settings(max_examples=60, deadline=None)
@given(st.lists(SHAPES, max_size=9), st.lists(SHAPES, max_size=9))
def test_long_lists_are_matched_in_order(x, y):
    most, html_wrapper.CELLS = html_wrapper.CELLS, 4
    try:
        a, b = html_wrapper.tree(skeleton(("r", x))), html_wrapper.tree(skeleton(("r", y)))
        size, pairs = html_wrapper.tree_match(a, b)
    finally:
        html_wrapper.CELLS = most
    to = dict(pairs)
    assert len(pairs) == size <= brute_match(("r", x), ("r", y)) and len(to) == len(set(to.values()))
    assert all(a.names[p] == b.names[q] and (p == 0 or to[a.parents[p]] == b.parents[q]) for p, q in pairs) and [q for _, q in pairs] == sorted(to.values())


def plain(k, body):
    """A page without telling names: two of twelve menus and slogans turn up again and again."""
    menu = "".join(f"<div>Go to place {k % 4} {j}</div>" for j in range(4))
    return f"<body><div><div>{menu}</div><div><p>Slogan of the week {k % 3}</div><div><h3>Title of {k}</h3><div>{body}</div></div><div><p>All rights {k % 2}</div></div></body>"


def test_wrapper_decides_where_no_name_tells(spark):
    bodies = [f"<p>This is what {k} has to say at some length.</p><p>And more of {k}</p>" + f"<ul><li>x{k}" * (k % 3) for k in range(12)]
    want = {k: "\n\n".join([f"Title of {k}", f"This is what {k} has to say at some length.", f"And more of {k}", *[f"x{k}"] * (k % 3)]) for k in range(12)}
    pages = [plain(k, b) for k, b in enumerate(bodies)]
    assert main_of(spark, pages) == want
    without = {k: html_wrapper.main_text(p := html_wrapper.folded(html_wrapper.parse(h)), html_wrapper.blocks(p), None) for k, h in enumerate(pages)}
    assert all(without[k] != want[k] and want[k] in without[k] for k in want)


def test_wrapper_outweighs_the_marks_around_its_region(spark):
    pages = [f"<form class=sidebar><div>Menu {k % 2}</div><div class=widget><h2>On {k}</h2><p>A text that is long enough, {k}.</p><div class=comments><p>Nice {k}</p></div></div></form>" for k in range(6)]
    assert main_of(spark, pages) == {k: f"On {k}\n\nA text that is long enough, {k}." for k in range(6)}


def test_articles_of_the_whole_table_with_and_without_names(spark):
    """The fixture's pages have one article each; the wrapper finds it, also where no element or class tells."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")  # 15 to 320 a host
    article = {r["page_id"]: re.search(r"<article>(.*?)</article>", r["html"], re.S)[1] for r in pages.collect()}
    want = {k: "\n\n".join(b.text for b in html_wrapper.blocks(html_wrapper.folded(html_wrapper.parse(h)))) for k, h in article.items()}
    got = {r["page_id"]: r["text"] for r in html_wrapper.main_texts(spark, pages).collect()}
    assert got == want
    bare = pages
    for name in ("nav", "article", "footer"):
        bare = bare.withColumn("html", F.regexp_replace("html", f"<(/?){name}>", "<$1div>"))
    bare = bare.withColumn("html", F.regexp_replace("html", 'class="ad"', ""))
    got = {r["page_id"]: r["text"] for r in html_wrapper.main_texts(spark, bare).collect()}
    assert sum(got[k] == want[k] for k in want) >= 0.95 * len(want)


def test_deep_wide_and_unclosed_pages_take_seconds():
    import time

    began = time.time()
    deep = "<div>" * 10_000 + "text" + "</div>" * 10_000
    wide = "<ul>" + "".join(f"<li class=k{'abc'[j % 3]}>{'<p>x' * (j % 4)}y</li>" for j in range(20_000)) + "</ul>"
    for h in (deep, wide, '<a href="x>' * 8001 + "end", "<p>" * 20_000, "<div><p>a</section>" * 10_000, "<" * 50_000):
        p = html_wrapper.folded(html_wrapper.parse(h))
        html_wrapper.alignment(p.skeleton, html_wrapper.folded(html_wrapper.parse(h[: len(h) // 2] + "<h2>t</h2>" + h[len(h) // 2 :])).skeleton)
        html_wrapper.main_text(p, html_wrapper.blocks(p), None)
    p = html_wrapper.folded(html_wrapper.parse(deep))
    assert html_wrapper.main_text(p, html_wrapper.blocks(p), None) == "text"
    assert time.time() - began < 90


# 3 repetition


def brute_repeats(w):
    return [max((n for j in range(len(w)) if j != i for n in range(len(w) + 1) if i + n <= len(w) and j + n <= len(w) and w[i : i + n] == w[j : j + n]), default=0) for i in range(len(w))]


@given(st.lists(st.text(alphabet="ab \n", max_size=24), min_size=1, max_size=4))
@settings(max_examples=80, deadline=None)
def test_repeats_are_those_of_brute_force(texts):
    limits = repetition.Limits(min_words=2, min_repeat=3, most_covered=0.4, longest=4)
    for part in slices(pa.array(texts)):
        got = repetition.judge(part, limits)
        for k, t in enumerate(texts):
            w = words(t)
            m = brute_repeats(w)
            covered = {x for i, n in enumerate(m) if n >= 3 for x in range(i, i + n)}
            windows = {x for i, n in enumerate(m) if n >= 3 for x in range(i, i + 3)}
            lines = [x for x in t.split("\n") if words(x)]
            failed = len(w) < 2 or 100 * len(windows) > 50 * len(w)
            assert [got[c][k] for c in ("n_words", "word_chars", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat")] == [len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(windows), len(covered), max(m, default=0)]
            assert got["base_failed"][k] == failed and got["kept"][k] == (not failed and len(covered) <= 0.4 * max(1, len(w)) and max(m, default=0) <= 4)


def test_repetition_on_odd_rows(spark):
    got = repetition.repetition_rules(spark, odd(spark)).collect()
    assert len(got) == len(ODD) and not any(r["kept"] for r in got) and {r["doc_id"]: r["n_words"] for r in got}[6] == 30_000
    kept = repetition.repetition_rules(spark, odd(spark), repetition.Limits(min_words=0), keep_rows=True)
    assert kept.columns == odd(spark).columns and kept.where("doc_id = 7").count() == 2
    assert repetition.repetition_rules(spark, empty(spark)).count() == 0
    assert repetition.maximal_repeats("a b c d x a b c d y b c d", 2) == [(3, [1, 6, 10]), (4, [0, 5])]


def test_a_text_of_twenty_megabytes_is_judged_whole():
    import time

    rnd = random.Random(3)
    half = " ".join(rnd.choices([f"w{k}" for k in range(50_000)], k=1_500_000))
    began = time.time()
    for part in slices(pa.array([f"{half} x {half}"])):
        out = repetition.judge(part, repetition.Limits())
    assert (out["n_words"][0], out["longest_repeat"][0], out["n_covered_words"][0]) == (3_000_001, 1_500_000, 3_000_000) and time.time() - began < 60


def test_repetition_limits_of_production_reject_by_coverage():
    once = lambda n: " ".join(f"w{k}" for k in range(n))
    passage = " ".join(f"p{k}" for k in range(20))
    texts = [f"{passage} {once(60)} {passage}", f"{passage} {once(100)} {passage}", once(100)]  # 40 %, 29 % and none covered
    (part,) = slices(pa.array(texts))
    got = repetition.judge(part, repetition.Limits())
    assert got["n_covered_words"].tolist() == [40, 40, 0] and got["longest_repeat"].tolist() == [20, 20, 0]
    assert not got["base_failed"].any() and got["kept"].tolist() == [False, True, True]


# 4 mixing


def test_exponent_meets_targets():
    q = [0.7, 0.2, 0.1]
    a = mixing.choose_exponent(q, least_entropy=0.95)
    assert abs(mixing.entropy(mixing.weights_at(q, a)) - 0.95 * math.log(3)) < 1e-6
    a = mixing.choose_exponent(q, least_entropy=0.99, most_passes=2.0)
    w = mixing.weights_at(q, a)
    assert abs(mixing.repetition(q, w, None) - 2.0) < 1e-6
    assert mixing.choose_exponent([1.0], 0.9, 2.0) == 1.0 and mixing.source_plan([], mixing.Mix()) == []


@pytest.mark.parametrize("budget", [None, 0.5, 2.3])
def test_draws_follow_the_plan(spark, budget):
    rnd = random.Random(1)
    rows = [(k, " ".join("w" for _ in range(rnd.randint(1, 9))), "big" if k % 3 else f"s{k % 4}") for k in range(400)] + [(k, None, None) for k in range(400, 430)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = mixing.Mix(least_entropy=0.98, most_passes=None, budget=budget, block_tokens=64)
    drawn, plan = mixing.mixed(spark, df, mix)
    drawn, plan = drawn.collect(), plan.collect()
    tokens = {k: max(1, len(words(t))) for k, t, _ in rows}
    for p in plan:
        mine = [r for r in drawn if r["source"] == p["s"]]
        due = p["passes"] * p["source_tokens"] + p["rest"]
        assert 0 <= sum(tokens[r["doc_id"]] for r in mine) - due < 10  # the last document may pass the budget
        for e in range(p["passes"]):
            assert sorted(r["doc_id"] for r in mine if r["epoch"] == e) == sorted(k for k, _, s in rows if s == p["s"])
    times = lambda rs: sorted(r["doc_id"] for r in rs)
    assert times(mixing.mix_rows(spark, df, mix).collect()) == times(drawn)
    if budget is None:
        assert {r["doc_id"] for r in drawn} == set(tokens)


def plain_mix(spark, df, mix):
    """The draws by the definition, a document at a time: (doc_id, epoch, block, place), sorted."""
    hashed = df.selectExpr("doc_id", "text", "source", "xxhash64(doc_id, text) AS h").selectExpr("*", "xxhash64(h, 'block') AS b", "xxhash64(h, 'order') AS o").collect()
    size = lambda r: max(1, len(words(r["text"])))
    names = sorted({r["source"] for r in hashed}, key=lambda x: (x is None, x or ""))
    tokens = {s: sum(size(r) for r in hashed if r["source"] == s) for s in names}
    total = sum(tokens.values())
    share = {s: t / total for s, t in tokens.items()}

    def weight(a):
        z = sum(q**a for q in share.values())
        return {s: q**a / z for s, q in share.items()}

    good = [a / 4000 for a in range(4001) if -sum(w * math.log(w) for w in weight(a / 4000).values()) >= mix.least_entropy * math.log(len(names))]
    w = weight(max(good, default=0))
    budget = mix.budget * total if mix.budget else max(share[s] * total / w[s] for s in names)
    out, due = [], {}
    for s in names:
        own, due[s] = [r for r in hashed if r["source"] == s], w[s] * budget
        blocks = max(1, math.ceil(tokens[s] / mix.block_tokens))
        passes = round(due[s]) // tokens[s]
        for e in range(passes + 1):
            left = round(due[s]) - e * tokens[s] if e == passes else tokens[s]
            keys = {r["k"]: r["x"] for r in spark.createDataFrame([(s, e, k) for k in {r["b"] % blocks for r in own}], "s string, e long, k long").selectExpr("k", "xxhash64(s, e, k) AS x").collect()}
            for place, k in enumerate(sorted(keys, key=lambda k: (keys[k], k))):
                for r in sorted((r for r in own if r["b"] % blocks == k), key=lambda r: (r["o"], r["doc_id"], r["h"])):
                    if left > 0:
                        out.append((r["doc_id"], e, k, place))
                    left -= size(r)
    return sorted(out), due


@pytest.mark.parametrize("budget", [None, 1.6])
def test_draws_are_those_of_brute_force(spark, budget):
    rnd = random.Random(9)
    rows = [(k, " ".join("w" for _ in range(rnd.randint(0, 9))), rnd.choice(["a", "a", "a", "b", None])) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = mixing.Mix(least_entropy=0.97, most_passes=None, budget=budget, block_tokens=64)
    drawn, plan = mixing.mixed(spark, df, mix)
    want, due = plain_mix(spark, df, mix)
    assert all(abs(p["passes"] * p["source_tokens"] + p["rest"] - due[p["s"]]) <= 2 for p in plan.collect())
    got = sorted((r["doc_id"], r["epoch"], r["block"], r["place"]) for r in drawn.collect())
    assert len(set(got) ^ set(want)) <= 4 and {x[:1] for x in got} == {x[:1] for x in want}  # the grid's exponent may end a pass a document off
    assert [x for x in got if x[1] == 0] == [x for x in want if x[1] == 0]


def test_mixing_on_odd_rows(spark):
    assert mixing.mixed(spark, odd(spark))[0].where("doc_id = 7").count() >= 2
    out = mixing.mix_rows(spark, odd(spark), mixing.Mix(None, None))
    assert out.columns == odd(spark).columns and out.count() == len(ODD)
    assert mixing.mixed(spark, empty(spark))[0].count() == 0 and mixing.mix_rows(spark, empty(spark)).count() == 0


# 5 token files


def test_token_files_round_trip(spark):
    got = [tuple(r) for r in tokenbin.corpus_table(spark, odd(spark), queries.VOCABULARY).orderBy("start").collect()]
    at = 0
    for (d, t), r in zip(sorted(ODD, key=lambda x: (x[0] is not None, x[0] or 0)), got, strict=True):  # equal ids have equal texts here
        ids = encoded(t)
        assert r == (d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert tokenbin.corpus_table(spark, empty(spark), queries.VOCABULARY).count() == 0


def test_ids_never_wrap(spark, tmp_path):
    ids = np.array([5, 70_000, 1], "<u4").tobytes()
    with pytest.raises(ValueError):
        tokenbin.narrowed(ids, 2)
    row = tokenbin.write_shard(tmp_path.as_uri(), 1, iter([(1, tokenbin.narrowed(ids, 4))]), 4)
    assert tokenbin.read_shard(row["path"], 4)[2].tolist() == [5, 70_000, 1]
    assert {r["width"] for r in tokenbin.write_corpus(spark, odd(spark), queries.VOCABULARY).collect()} == {2}


def test_rows_of_one_id_are_spread(spark):
    rows = [(3, f"text {k}") for k in range(3000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = tokenbin.write_corpus(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(8), queries.VOCABULARY).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(manifest) > 1 and max(r["docs"] for r in manifest) < 2000


# 6 Jaccard join


def brute_components(rows, size, num, den):
    sets = {}
    for d, t in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    ids, up = sorted(sets), {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            o = len(sets[a] & sets[b])
            if o and den * o >= num * (len(sets[a]) + len(sets[b]) - o):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


@pytest.mark.parametrize("size, num, den, short, cell", [(3, 90, 100, 8, 1024), (3, 90, 100, 1, 2), (5, 80, 100, 1, 3)])
def test_components_are_those_of_brute_force(spark, monkeypatch, size, num, den, short, cell):
    monkeypatch.setattr(jaccard, "SHORT", short)
    monkeypatch.setattr(jaccard, "CELL", cell)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "FAMILY", short)
    monkeypatch.setattr(jaccard, "WIDTH", 1 << (10 + short))
    rnd, rows, known = random.Random(size + short), [], [f"w{k}" for k in range(300)]
    for _ in range(14):
        base = [rnd.choice(known) for _ in range(rnd.choice([3, 9, 12, 40, 150]))]
        for _ in range(rnd.randint(1, 16)):
            w = list(base)
            for _ in range(rnd.randint(0, 4)):
                k = rnd.randrange(len(w))
                w[k : k + 1] = rnd.choice([[], [rnd.choice(known).upper()], [w[k], rnd.choice(known)]]) if len(w) > 1 else w[k : k + 1]
            rows.append((len(rows), " ".join(w)))
    rows += [(1000, None), (1001, ""), (1002, "one"), (1003, "ONE")]
    got = {r[0]: (r[1], r[2]) for r in jaccard.jaccard_components(spark, spark.createDataFrame(rows, "doc_id long, text string"), size, num, den).collect()}
    assert got == brute_components(rows, size, num, den)


def test_jaccard_asks_a_row_a_set_and_not_a_row_a_pair(spark, monkeypatch):
    base = [f"w{k}" for k in range(300)]
    rows = [(i, " ".join(base[:i] + [f"m{i}"] + base[i + 1 :])) for i in range(1, 201)]  # near copies of each other
    for j in range(30):  # linked with all of these, not with each other, and smaller, so that no earlier set is near
        words = base[:299]
        for k in range(4):
            words[5 + j + 70 * k] = f"l{j}.{k}"
        rows.append((1000 + j, " ".join(words)))
    written, stage = {}, jaccard.stage
    monkeypatch.setattr(jaccard, "LEAST_LINKS", 8)

    def counted(spark, df, name, *more):
        table = stage(spark, df, name, *more)
        written.setdefault(name, []).append(table.count())
        return table

    monkeypatch.setattr(jaccard, "stage", counted)
    got = jaccard.jaccard_components(spark, spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()
    assert len(got) == 230 and {r["component_id"] for r in got} == {1}
    assert max(written["pairs"] + written["near"]) <= 230  # 30 by 200 pairs before


def test_jaccard_on_odd_rows(spark):
    got = jaccard.jaccard_components(spark, odd(spark)).collect()
    assert len(got) == len(ODD) and {r["component_id"] for r in got if r["doc_id"] in (1, 7)} == {1} and {r["n_shingles"] for r in got if r["doc_id"] in (2, 3, 4)} == {0}
    kept = jaccard.keep_one(spark, odd(spark)).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == [1, 2, 3, 4, 5, 6, 9]
    assert jaccard.jaccard_components(spark, empty(spark)).count() == 0 and jaccard.keep_one(spark, empty(spark)).count() == 0


@pytest.mark.parametrize("cell", [3, 1024])
def test_cells_let_entries_of_different_roots_meet(spark, monkeypatch, cell):
    monkeypatch.setattr(jaccard, "CELL", cell)
    rnd = random.Random(cell)
    rows = [(t, k, 0, 50, 0, rnd.choice([1, 1, 1, 2, 3]) if t else 7) for t in range(4) for k in range(4 + 7 * t)]
    out = jaccard._crossed(spark, spark.createDataFrame([(t, k, 50, 0, 0, 0, x) for t, k, *_, x in rows], "token long, k long, n int, pos int, p1 long, p2 long, root long")).collect()
    assert not any(r["token"] == 0 for r in out)
    cells = {}
    for r in out:
        cells.setdefault((r["token"], r["cell"]), []).append((r["side"], r["k"]))
    met = {(c[0], min(a, b), max(a, b)) for c, x in cells.items() for s, a in x for u, b in x if a != b and (s != u or len({y for y, _ in x}) == 1)}
    assert met >= {(t, a, b) for t, a, *_, x in rows for v, b, *_, y in rows if t == v and a < b and x != y}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 1 << 30), st.booleans())
def test_list_pairs_leave_out_no_link(seed, split):
    rng = np.random.default_rng(seed)
    base = rng.integers(1, 1 << 62, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(60) < 0.97], rng.integers(1, 1 << 62, rng.integers(0, 5)).astype(np.uint64)])) for _ in range(25)]
    side = rng.integers(0, 2, 25) if split else np.zeros(25, np.int64)
    order = sorted(range(25), key=lambda k: (side[k], len(sets[k])))
    sets, side, roots = [sets[k] for k in order], side[order], np.array(order) % 3
    n = np.array([len(x) for x in sets])
    bits = tuple(np.array([jaccard.parity(x) for x in sets]).T.copy())
    i, j = (np.concatenate(v) for v in zip(*jaccard.crossing(n, np.zeros(25, np.int64), 80, 100, bits, roots, side), (np.zeros(0, np.int64),) * 2))
    got = set(zip(i.tolist(), j.tolist()))
    both = {0, 1} <= set(side.tolist())
    for a in range(25):
        for b in range(a + 1, 25):
            o = len(np.intersect1d(sets[a], sets[b]))
            if 100 * o >= 80 * (n[a] + n[b] - o) and roots[a] != roots[b] and (side[a] != side[b] or not both):
                assert (a, b) in got


def test_too_long_lists_are_split():
    names = ["token", "cell", "at", "k", "p1"]
    rows = [(9, 0, 30 << 32, i, 0) for i in range(6)]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[a : a + 2]]) for c in range(5)], names) for a in range(0, 6, 2)]
    assert [len(x) for x in jaccard._whole_lists(iter(batches), 2, 4)] == [4, 2]


def test_parity_bounds_differences():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 90, rng.integers(1, 80)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(2))
        x, y = jaccard.parity(a), jaccard.parity(b)
        assert int(np.bitwise_count((x ^ y).view(np.uint64)).sum()) <= len(np.setxor1d(a, b))
        assert jaccard.long_differing(jaccard.long_parity(a), jaccard.long_parity(b)) <= len(np.setxor1d(a, b))


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 1 << 30), st.integers(1, 40))
def test_nearest_is_that_of_all_pairs(seed, count):
    rng = np.random.default_rng(seed)
    base = rng.integers(1, 1 << 62, 40).astype(np.uint64)
    sets = sorted((np.unique(np.concatenate([base[rng.random(40) < 0.95], rng.integers(1, 1 << 62, rng.integers(0, 6)).astype(np.uint64)])) for _ in range(count)), key=len)
    n, key, bits = np.array([len(x) for x in sets]), rng.permutation(count), tuple(np.array([jaccard.parity(x) for x in sets]).T.copy())
    to, least, some = jaccard.nearest(n, np.zeros(count, np.int64), key, 80, 100, bits)
    for b in range(count):
        near = {}
        for a in range(count):
            d = int(jaccard.differing(bits, a, b))
            if a != b and 100 * min(n[a], n[b]) >= 80 * max(n[a], n[b]) and d <= n[a] + n[b] - 2 * jaccard.needed_overlap(n[a], n[b], 80, 100):
                near[a] = d
        before = {a: d for a, d in near.items() if (n[a], key[a]) < (n[b], key[b])}
        assert some[b] == bool(near) and (to[b] >= 0) == bool(before) and (not before or least[b] == min(before.values()) == before[int(to[b])])


def test_counts_of_the_sketch_are_never_too_low(spark):
    rows = [(k, " ".join(random.Random(k % 7).choices("abcdefgh", k=60)) + f" {k}") for k in range(90)]
    scan = jaccard.named(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).select("doc_id", "text", "t").mapInArrow(jaccard._scan(3), jaccard.SCAN)
    counts, true = jaccard.sketch(scan), {}
    for _, text in rows:
        for _, values in jaccard.text_sets(pa.array([text]), 3):
            for v in values.tolist():
                true[v] = true.get(v, 0) + 1
    assert all(counts[v % jaccard.WIDTH] >= c for v, c in true.items()) and counts.sum() == sum(true.values())


def test_words_of_two_letters_in_a_pattern_differ():
    from papergrove.llm.words import slices

    morse = "".join("ab"[k.bit_count() & 1] for k in range(2048))
    other = morse.translate(str.maketrans("ab", "ba"))
    words = [x[:n] for n in (1, 2, 4, 8, 16, 32, 64, 65, 128, 1024, 2048) for x in (morse, other)]
    h = next(slices(pa.array([" ".join(words + words)]))).hashes()
    assert len(set(h.tolist())) == len(words) == len(h) // 2 and (h[: len(words)] == h[len(words) :]).all()


def test_one_row_of_each_component_stays(spark):
    text = [" ".join(f"w{k}{j}" for j in range(30)) for k in range(4)]
    rows = [(5, text[0]), (5, text[1]), (7, text[1]), (None, text[2]), (None, text[2]), (None, text[0]), (9, text[3]), (9, text[3]), (3, ""), (3, "")]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, _id int")
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in jaccard.keep_one(spark, docs).select("doc_id", "text", "_id").collect())
    assert kept == sorted([(5, text[0]), (5, text[1]), (0, text[2]), (9, text[3]), (3, ""), (3, "")])


# 7 WARC


def test_archives_round_trip(spark):
    rows = [(1, "http://a/", "<p>é</p>"), (5, "http://b/", "<p>é</p>"), (3, None, "x"), (2, "http://c/\r\n", None), (8, "", ""), (None, "http://d/", "x"), (9, "u", "y" * 3_000_000), (3, None, "x")]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, body string, first int")
    got = warc.read_archives(warc.write_archives(spark, df)).collect()
    first: dict = {}
    for d, _, h in rows:
        if d is not None:
            first[h or ""] = min(d, first.get(h or "", d))
    want = []
    for d, _, h in rows:
        data, same = (h or "").encode(), first[h or ""] == d
        want.append((d, len(data), warc.digest(data), "response" if same else "revisit", None if same else first[h or ""]))
    assert sorted(map(repr, ((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got))) == sorted(map(repr, want))
    assert warc.read_archives(warc.write_archives(spark, df.where("page_id = 77"))).count() == 0
    only = warc.read_archives(warc.write_archives(spark, df, least=2)).where("page_id = 8").first()
    assert only["record_type"] == "response"


def test_normaliser_takes_any_gzip():
    records = [warc.record(k, f"http://x/{k}", bytes([65 + k]) * (k * 400_000)) for k in range(4)]
    for whole in (gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records)), gzip.compress(records[0] + records[1][:50]) + gzip.compress(records[1][50:] + b"".join(records[2:]))):
        out, index = io.BytesIO(), io.BytesIO()
        assert warc.normalise(io.BytesIO(whole), out, index) == 4
        lines = [x.split("\t") for x in index.getvalue().decode().splitlines()]
        for (offset, size, kind, page_id), r in zip(lines, records):
            assert gzip.decompress(out.getvalue()[int(offset) : int(offset) + int(size)]) == r and kind == "response"
    with pytest.raises(EOFError):
        warc.normalise(io.BytesIO(gzip.compress(records[1][:-9])), io.BytesIO(), io.BytesIO())


# 8 ordinal


def test_ordinal_orders_grades(spark):
    rnd = random.Random(2)
    kinds = ["bad!!", "so-so", "Fine"]
    rows = [(k, " ".join(rnd.choice([kinds[k % 3], "the", "a"]) for _ in range(60))) for k in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ratings = spark.createDataFrame([(k, k % 3) for k in range(0, 240) if k % 4], "doc_id long, grade int")
    model = ordinal.train(spark, docs, ratings)
    assert model.thresholds[0] < model.thresholds[1]
    got = ordinal.classify(spark, docs, model).where("doc_id % 4 = 0").collect()
    assert sum(round(r["expected_grade"]) == r["doc_id"] % 3 for r in got) >= 0.9 * len(got)
    assert all(r["kept"] == (r["tail_probability"] >= 0.5) for r in got)
    out = ordinal.classify(spark, odd(spark), model).collect()
    assert len(out) == len(ODD) and all(0 <= r["tail_probability"] <= 1 for r in out)
    assert ordinal.classify(spark, odd(spark), model, keep_rows=True).columns == odd(spark).columns
    none = ordinal.train(spark, docs, ratings.where("grade = 9"))
    assert ordinal.classify(spark, odd(spark), none).where("kept").count() == len(ODD)


def test_op8_is_the_sum_over_all_words(spark):
    """Expected grade, tail and verdict of every document, from the definition of features and links."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = ordinal.train(spark, docs, ordinal.graded(labels))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = queries.op8_ordinal(spark, SF).collect()
    assert len(rows) == len(text)
    for r in rows:
        score = sum(float(model.weights[s]) * float(v) for s, v in zip(*ordinal.features(text[r["doc_id"]])))
        tails = [1 / (1 + math.exp(-(score - t))) for t in model.thresholds]
        assert abs(r["expected_grade"] - sum(tails)) < 1e-3 and abs(r["tail_probability"] - tails[0]) < 1e-3 and r["kept"] == (r["tail_probability"] >= 0.5)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert sum(r["kept"] == (truth[r["doc_id"]] > 0) for r in rows if r["doc_id"] in truth) >= 0.97 * len(truth)


def test_ratings_that_differ_count_as_the_least(spark):
    docs = spark.createDataFrame([(k, f"{'bad' if k % 2 else 'good'} text {k}") for k in range(60)] + [(1, "another text")], "doc_id long, text string")
    ratings = [(k, g) for k in range(60) for g in ((0, 2) if k % 2 else (2,))]
    a, b = (ordinal.train(spark, docs, spark.createDataFrame(x, "doc_id long, grade int").repartition(n)) for x, n in ((ratings, 1), (ratings[::-1], 5)))
    assert (a.weights == b.weights).all() and (a.thresholds == b.thresholds).all() and a.score("bad") < a.score("good")


def test_gradient_reaches_the_maximum():
    """One feature, two thresholds: the fit's log-likelihood is not below that of near-by parameters."""
    rng = np.random.default_rng(0)
    x, n = rng.normal(size=300), 300
    y = np.digitize(1.5 * x + rng.logistic(size=n), [-0.5, 1.0])
    m = ordinal.fit([(np.array([3], np.int32), np.array([v], np.float32)) for v in x], y, rounds=2000, penalty=0)

    def likelihood(w, a, b):
        s = lambda t: 1 / (1 + np.exp(-(t - w * x)))
        return np.log(np.stack([s(a), s(b) - s(a), 1 - s(b)])[y, np.arange(n)]).sum()

    best = likelihood(m.weights[3], *m.thresholds)
    assert all(likelihood(m.weights[3] + d, m.thresholds[0] + e, m.thresholds[1] + f) <= best + 1e-3 for d in (-0.1, 0, 0.1) for e in (-0.1, 0, 0.1) for f in (-0.1, 0, 0.1))


# 9 packing


@given(st.lists(st.integers(1, 50), max_size=60), st.sampled_from(["norm", "dot"]), st.sampled_from([None, 3]), st.sampled_from([None, 2600]))
@settings(max_examples=80, deadline=None)
def test_bins_hold_under_all_limits(lengths, rule, most_docs, attention):
    lengths = np.array(sorted(lengths, reverse=True), np.int64)
    where, offset = packing.best_fit(lengths, 50, most_docs, attention, rule)
    for b in set(where.tolist()):
        own = lengths[where == b]
        assert own.sum() <= 50 and len(own) <= (most_docs or 50) and (own**2).sum() <= (attention or 2500)
        order = np.argsort(offset[where == b])
        assert (offset[where == b][order] == np.cumsum(own[order]) - own[order]).all()
    if most_docs is None and attention is None and len(lengths):
        assert len(set(where.tolist())) <= math.ceil(1.7 * lengths.sum() / 50) + 1


def test_pieces_are_gapless(spark):
    got = packing.pack_documents(spark, odd(spark), queries.VOCABULARY, 512).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 512
    want = sorted(repr((d, p, p * 512, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))) for d, t in ODD for p, part in enumerate(encoded(t)[k : k + 512] for k in range(0, len(encoded(t)), 512)))
    assert sorted(repr((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])) for r in got) == want
    assert packing.pack_documents(spark, empty(spark), queries.VOCABULARY).count() == 0


def test_full_pieces_need_no_group(spark):
    rows = [(k, 0, 0, 64 if k % 10 else 7, k) for k in range(4000)] + [(9, 1, 64, 5, 5)] * 300
    pieces = stage(spark, spark.createDataFrame(rows, packing.PIECES), "pieces")
    got = packing.pack(spark, pieces, 64, group=64).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert len(got) == len(rows) and all(x == [(0, 64)] for x in by.values() if x[0][1] == 64)
    groups = {s >> 32 for s in by if s >= 0}
    assert len(groups) == 11 and all(sum(n for _, n in x) <= 64 for x in by.values())  # 700 short pieces, though 3,600 are full and 300 are equal


# 10 toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@given(st.text("abc", max_size=8), st.lists(st.text("abc", min_size=5, max_size=8), max_size=6))
@settings(max_examples=150, deadline=None)
def test_walk_finds_terms_in_reach(word, terms):
    trie = toxicity.Trie(terms, [])
    near = [t for t in terms if distance(t, word) <= 1]
    assert trie.near(word) == min(near, default=None)
    if near and len(word) >= toxicity.FUZZY:
        assert trie.half(word)


def test_toxicity_learns_and_reads_context(spark):
    rnd = random.Random(4)
    plain = [f"word{k}" for k in range(200)]
    rows = []
    for k in range(600):
        w = [rnd.choice(plain) for _ in range(40)]
        if k % 5 == 0:
            w[rnd.randrange(40)] = rnd.choice(["grobian", "fiesling"])
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(600)], "doc_id long, quality int, toxic int")
    model = toxicity.train(spark, docs, labels)
    assert set(model.terms) == {"grobian", "fiesling"}
    got = toxicity.toxicity(spark, docs, model).collect()
    assert all(r["predicted"] == int(r["doc_id"] % 5 == 0) for r in got) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert model.score("you grobiann") >= 0.3 > model.score("nothing here") and model.hits("a grobian")[0][0][2] > model.hits('he wrote "a grobian" there')[0][0][2]
    out = toxicity.toxicity(spark, odd(spark), model).collect()
    assert len(out) == len(ODD) and not any(r["predicted"] for r in out)
    assert toxicity.toxicity(spark, odd(spark), toxicity.train(spark, docs, labels.where("toxic = 0"))).where("score > 0").count() == 0


def test_toxicity_learns_rare_terms_behind_many_frequent_ones(spark):
    rnd = random.Random(6)
    plain = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=12)) for _ in range(5000)]  # over 20,000 words and beginnings
    ids = [d for d in range(400) if not toxicity.held_out(d)][:150]
    rows = []
    for k, d in enumerate(ids):
        rnd.shuffle(plain)
        rows.append((d, " ".join(plain) + (" zorgle" if k < 12 else ""), int(k < 30)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    assert "zorgle" in toxicity.train(spark, df, df).terms


def plain_features(text, model):
    """Features of a text by the definition: all terms, all distances, all pairs of hits."""
    low = (text or "").lower()
    found = []
    for w in re.findall(r"\w+", low):
        near = any(distance(t, w) <= 1 for t in model.terms if len(t) >= toxicity.FUZZY and abs(len(t) - len(w)) < 2)
        found.append(1.0 if w in model.terms or any(w.startswith(s) for s in model.stems) else toxicity.NEAR if len(w) >= toxicity.FUZZY and w not in model.harmless and near else 0.0)
    quoted, k = set(), 0
    for line in low.split("\n"):
        spans, at = [], None
        for i, c in enumerate(line):
            if c == toxicity.BOTH:
                spans += [] if at is None else [(at, i)]
                at = i if at is None else None
            elif c in toxicity.CLOSING and at is not None:
                spans.append((at, i))
                at = None
            elif c in toxicity.OPENING:
                at = i if at is None else at
        for m in re.finditer(r"\w+", line):
            if any(a < m.start() < b for a, b in spans):
                quoted.add(k)
            k += 1
    all_words, weights = re.findall(r"\w+", low), []
    for k, v in enumerate(found):
        if v:
            around = sum(1 for j, u in enumerate(found) if u and j != k and abs(j - k) <= toxicity.WINDOW)
            told = k in quoted or any(w in toxicity.REPORTS for w in all_words[max(0, k - toxicity.WINDOW) : k])
            weights.append(v * (toxicity.QUOTED if told else 1 + toxicity.COMPANY * min(3, around)))
    return [1.0, math.log1p(sum(weights)), math.log1p(100 * sum(weights) / max(1, len(found))), max(weights, default=0.0)]


def test_op10_scores_are_those_of_brute_force(spark):
    model = toxicity.Toxic(["zounds", "grobian", "oaf"], ["varlet"], frozenset({"sounds"}), (-3.0, 1.5, 0.5, 2.0))
    rnd = random.Random(8)
    some = ["zounds", "zoundz", "sounds", "grobian", "grobia", "gobiran", "oaf", "oafs", "varletry", "varle", "he", "said", "the", "day", '"', "“", "”", "»", "\n", ",", "fine"]
    rows = [(k, " ".join(rnd.choices(some, k=rnd.randint(0, 40)))) for k in range(150)] + [(None, None), (200, "")]
    got = toxicity.toxicity(spark, spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    text = dict(rows)
    for r in got:
        want = 1 / (1 + math.exp(-sum(a * b for a, b in zip(model.weights, plain_features(text[r["doc_id"]], model)))))
        assert abs(r["score"] - want) < 1e-9, text[r["doc_id"]]
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]


def test_op10_scores_of_the_table_are_those_of_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(spark, docs, labels)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = queries.op10_toxicity(spark, SF).collect()
    assert len(rows) == len(text)
    for r in rows:
        want = 1 / (1 + math.exp(-sum(a * b for a, b in zip(model.weights, plain_features(text[r["doc_id"]], model))))) if model.weights else 0.0
        assert abs(r["score"] - want) < 1e-9


def test_texts_of_many_hits_take_linear_time():
    import time

    model = toxicity.Toxic(["zounds", "grobian"], [], frozenset(), (-3.0, 1.5, 0.5, 2.0))
    began = time.time()
    for text in ("zounds " * 100_000, '"' + "zounds " * 100_000 + '"', "“zounds “ " * 100_000):
        assert len(model.hits(text)[0]) == 100_000
    assert time.time() - began < 30


def test_toxicity_learns_from_one_of_each_group_of_copies(spark):
    """Copies count once for their label; a toxic variant of a clean text is learned from all the same."""
    ids = [d for d in range(3000) if not toxicity.held_out(d)]
    rnd = random.Random(5)
    text = lambda: [f"w{rnd.randrange(3000)}" for _ in range(60)]
    rows, copy = [], text()
    for k, d in enumerate(ids[:800]):
        if k < 200:  # copies of one toxic text, which holds a word of its own
            rows.append((d, " ".join([*copy, "copied"]), 1))
        else:
            w = text()
            rows.append((d, " ".join(w), 0))
            if k < 240:
                rows.append((ids[1000 + k], " ".join([*w[:30], "grobian", *w[31:]]), 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    assert toxicity.train(spark, df, df).terms == ["grobian"]


# all


def test_pipeline_stages_on_odd_rows(spark):
    """Nulls, empty and long texts, ties, repeated rows, clashing names and empty tables: see the stages' docstrings."""
    import corpus_pipeline

    for name, step in corpus_pipeline.STAGES:
        out = step(spark, odd(spark), SF)
        if name != "pack":
            assert out.columns == odd(spark).columns
            rows = [(r["doc_id"], r["text"]) for r in out.collect()]
            assert set(rows) <= set(ODD)
            if name in ("near_copies", "mix"):
                assert set(rows) >= {r for r in ODD if r[0] not in (1, 7)} and {d for d, _ in rows} & {1, 7}
            if name == "near_copies":  # documents 1 and 7 (twice) are one; what has no words stays
                assert sorted(repr(r) for r in rows) == sorted(repr(r) for r in ODD if r[0] != 7)
        else:
            assert {(r["doc_id"]) for r in out.collect()} == {d for d, _ in ODD}
        assert step(spark, empty(spark), SF).count() == 0


def test_pipeline_against_its_stages(spark):
    import corpus_pipeline

    docs = prepare(spark).read.parquet(f"{SF}/documents.parquet")
    all_docs, checked = docs, 0
    for name, step in corpus_pipeline.STAGES:
        out = stage(spark, step(spark, docs, SF), name)
        if name != "pack":
            assert out.columns == all_docs.columns
        if name == "quality":  # those whose tail, summed over all words, is one half at least
            model = ordinal.train(spark, docs, ordinal.graded(spark.read.parquet(f"{SF}/labels.parquet")))
            score = lambda t: sum(float(model.weights[s]) * float(v) for s, v in zip(*ordinal.features(t)))
            tail = {r["doc_id"]: 1 / (1 + math.exp(model.thresholds[0] - score(r["text"]))) for r in docs.collect()}
            kept = {r["doc_id"] for r in out.collect()}
            assert all((p >= 0.5) == (d in kept) for d, p in tail.items() if abs(p - 0.5) > 1e-3)
        if name == "rules":
            for r in docs.collect():
                w = words(r["text"])
                long = brute_repeats(w) if len(w) < 150 else None
                if long is not None:
                    cover, window = set(), set()
                    for k, n in enumerate(long):
                        cover |= set(range(k, k + n)) if n >= 8 else set()
                        window |= set(range(k, k + 3)) if n >= 3 else set()
                    good = len(w) >= 50 and 100 * len(window) <= 50 * len(w) and len(cover) <= 0.3 * len(w) and max(long) <= 48
                    assert (out.where(F.col("doc_id") == r["doc_id"]).count() > 0) == good
                    checked += 1
            assert checked >= 10
        if name == "near_copies":
            found = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()], 5, 80, 100)
            assert sorted(r["doc_id"] for r in out.collect()) == sorted({c for _, c in found.values()})
        if name == "mix":
            assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in docs.collect()}
        docs = out
    packed, before = docs.collect(), all_docs.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").collect()
    by, pieces = {}, {}
    for r in packed:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], {})[r["piece"]] = (r["start"], r["length"], r["ids_crc32"])
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 4096 and len(own) <= corpus_pipeline.MOST_DOCS
    for r in before:
        ids = encoded(r["text"])
        assert pieces[r["doc_id"]] == {k // 4096: (k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())) for k in range(0, len(ids), 4096)}
