"""Conversation repair, exact dedup and the Merkle manifest against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from papergrove.llm import html_wrapper, jaccard, media, merkle, mixing, ordinal, packing, patricia, queries, repair, runtime, tokenbin, toxicity, warc

from test_llm import ODD, brute_components, brute_match, empty, main_of, odd, skeleton

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]")


# 11 repair


def edits_of(rows, most=2):
    """All (cost, edits, roles and texts) of rows (role, text, fault) that end in an allowed form, by plain enumeration."""
    found = []

    def go(i, roles, edits, cost, texts, run):
        form = "".join(r[:1] for r in roles)
        if not re.fullmatch(r"(s?(ua)*u?)?", form):
            return
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", form):
            found.append((cost, edits, list(zip(roles, texts))))
        if run < most:
            for r in ("user", "assistant"):
                go(i, [*roles, r], edits + "I", cost + 5, [*texts, ""], run + 1)
        if i < len(rows):
            role, text, fault = rows[i]
            go(i + 1, roles, edits + "D", cost + 2, texts, 0)
            if fault in (repair.FINE, repair.CUT):
                more = 5 if fault == repair.CUT else 0
                go(i + 1, [*roles, role], edits + "K", cost + more, [*texts, text], 0)
                for r in ("user", "assistant"):
                    go(i + 1, [*roles, r], edits + "R", cost + more + 1, [*texts, text], 0)

    go(0, [], "", 0, [], 0)
    return min(found)


rows_of = st.lists(st.tuples(st.sampled_from("suax"), st.integers(0, 3)), max_size=5)


@given(rows_of)
@settings(max_examples=80, deadline=None)
def test_search_is_that_of_all_edits(rows):
    names = {"s": "system", "u": "user", "a": "assistant", "x": "x"}
    want = edits_of([(names[r], "t", f) for r, f in rows])
    assert repair.best(repair.search(rows, repair.NONE, (repair.NONE, repair.A), one=True)) == want[:2]


@given(st.lists(st.tuples(st.sampled_from("suax"), st.integers(0, 3)), max_size=40), st.integers(1, 7))
@settings(max_examples=60, deadline=None)
def test_blocks_chain_to_the_search_over_all(rows, size):
    ways = {repair.NONE: (0, "")}
    for k in range(0, len(rows), size):
        ways = repair.chain(ways, repair.table(rows[k : k + size]))
    assert repair.best(ways) == repair.best(repair.search(rows, repair.NONE, (repair.NONE, repair.A), one=True))


def plain_repairs(rows):
    """What damaged_repairs gives, from (conv, turn, role, text), by a table over all phases in plain Python."""
    kept = {}
    for conv, turn, role, text in rows:
        kept.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        role = "user" if k == 4 else role
        kept[conv] += [(turn, role, text)] * (2 if k == 3 else 1)
    out = {}
    for conv, own in kept.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        seen, judged = set(), []
        for _, role, text in own:
            chars = WORD.findall(text)
            judged.append((role, text, repair.BLANK if not chars else repair.COPY if (role, text) in seen else repair.CUT if chars[-1] not in ".!?" else repair.FINE))
            seen.add((role, text))
        best = {repair.NONE: (0, "", ())}
        for i in range(len(judged) + 1):
            for _ in range(2):  # insertions
                for p, (cost, edits, made) in list(best.items()):
                    q = repair.EITHER[p]
                    new = (cost + 5, edits + "I", (*made, ("assistant" if q == repair.A else "user", "")))
                    best[q] = min(best.get(q, new), new)
            if i == len(judged):
                break
            role, text, fault = judged[i]
            after = {}
            for p, (cost, edits, made) in best.items():
                ways = [(p, (cost + 2, edits + "D", made))]
                if fault in (repair.FINE, repair.CUT):
                    more = cost + (5 if fault == repair.CUT else 0)
                    q = repair.EITHER[p]
                    ways.append((q, (more + 1, edits + "R", (*made, ("assistant" if q == repair.A else "user", text)))))
                    if p in repair.NEXT.get(role[:1], ()):
                        ways.append((repair.NEXT[role[:1]][p], (more, edits + "K", (*made, (role, text)))))
                for q, w in ways:
                    after[q] = min(after.get(q, w), w)
            best = after
        cost, audit, made = min(w for p, w in best.items() if p in (repair.NONE, repair.A))
        turns = {t for t, _, _ in own if t is not None}
        faults = [j[2] for j in judged]
        initials = [r[:1] for _, r, _ in own]
        out[conv] = {
            "conv_id": conv, "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, "blank": faults.count(repair.BLANK), "duplicate": faults.count(repair.COPY), "truncated": faults.count(repair.CUT),
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest(),
        }
    return out


def conversation_rows(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"fault": F.lit(1), "place": F.lit(2), "same": F.lit("x"), "edits": F.lit("K")})


def by_conv(df):
    return {r["conv_id"]: r.asDict() for r in df.collect()}


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_repairs_are_those_of_the_definition_on_odd_rows(spark, monkeypatch, ranges):
    rng = random.Random(ranges)
    texts = ["Yes. ", "No!\n", "", None, " \x0b\t", "cut off", "é ß 🙂 中?", "w " * 30_000 + ".", "a\x1c", "…", "Ça va ", "x.\u0085"]
    rows = [(c, rng.choice([*range(12), None]), rng.choice(["user", "assistant", "system", None, "", "User", "tool"]), rng.choice(texts)) for c in (0, 1, 2, None) for _ in range(25)]
    rows += [(5, t, ("user", "assistant")[t % 2], "Fine.") for t in range(0, 60, 2)] + [(6, None, "user", "All null.")] + rows[:9] + [(7, 10**15, "user", "Far."), (7, -(10**15), "assistant", "Off?")]
    drop = next(c for c in range(100, 10_000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    rows.append((drop, 1, "user", "Gone."))
    monkeypatch.setattr(repair, "BLOCK", 7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    try:
        got = by_conv(repair.damaged_repairs(spark, conversation_rows(spark, rows)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == plain_repairs(rows)
    assert got[drop]["audit"] == "" and got[drop]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()


def test_repairs_of_the_table_and_of_one_long_conversation(spark):
    table = queries.table(spark, SF, "conversations")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert by_conv(repair.damaged_repairs(spark, table)) == plain_repairs(rows)
    long = [(1, t, ("user", "assistant")[t % 2], f"Line {t % 900}.") for t in range(3000)]
    assert by_conv(repair.damaged_repairs(spark, conversation_rows(spark, long))) == plain_repairs(long)
    assert repair.damaged_repairs(spark, conversation_rows(spark, long).where("turn < 0")).count() == 0


def test_repaired_rows_are_the_operators_output(spark):
    rows = repair.given(conversation_rows(spark, [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi!"), (1, 2, "user", "Still there?"), (2, 0, "assistant", "")]))
    got = repair.repaired(rows, repair.plan(spark, rows)).orderBy("conv_id", "place").collect()
    assert [(r["conv_id"], r["edit"], r["role"], r["text"]) for r in got] == [(1, "K", "system", "Be kind."), (1, "K", "user", "Hi!"), (1, "R", "assistant", "Still there?")]


# 12 exact dedup


def plain_dedup(rows, keep):
    out = []
    texts = [t or "" for _, t in rows]
    for d, t in rows:
        ids = [e for e, u in rows if (u or "") == (t or "") and e is not None]
        out.append((d, (max(ids) if keep == "largest" else min(ids)) if ids else None, texts.count(t or ""), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def check_dedup(got, rows, keep):
    got = [r.asDict() for r in got]
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got], key=repr) == plain_dedup(rows, keep)
    groups = {}
    for r in got:
        groups.setdefault(r["text_sha256"], []).append(r)
    for g in groups.values():
        assert [r["doc_id"] for r in g if r["kept"]] == [g[0]["keep_id"]]


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("memory,short", [(patricia.MEMORY, False), (1000, False), (1000, True)])
def test_dedup_is_that_of_brute_force(spark, keep, memory, short):
    rng = random.Random(7)
    rows = [*ODD, *[(rng.choice([*range(-20, 60), None]), "".join(rng.choice("ab") for _ in range(rng.randrange(9)))) for _ in range(400)]]
    rows += [(k, "x" * 5000 + str(k % 3)) for k in range(40)] + [(-(2**63), "edge"), (2**63 - 1, "edge"), (None, "edge")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"place": F.lit(1), "rank": F.lit(2), "name": F.lit("n"), "body": F.lit("b")}).repartition(5)
    weak = (lambda b: str(len(b) % 2)) if short else patricia.sha256  # two hashes for all texts: tries tell them apart
    check_dedup(patricia.exact_dedup(spark, df, keep, memory, weak).collect(), rows, keep)


def test_dedup_of_an_empty_table_and_of_the_whole_one(spark):
    assert patricia.exact_dedup(spark, empty(spark)).count() == 0
    docs = queries.table(spark, SF, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check_dedup(queries.op12_exact_dedup(spark, SF).collect(), rows, "largest")


@given(st.lists(st.binary(max_size=6) | st.sampled_from([b"", b"abc", b"abcd" * 50, b"abcd" * 50 + b"x"]), max_size=30))
@settings(max_examples=100, deadline=None)
def test_tries_hold_what_was_inserted(keys):
    trie, want = patricia.Trie(), {}
    for k, key in enumerate(keys):
        patricia.merge(trie.insert(key), (k, k, k), 1)
        want.setdefault(key, [k, 0])[1] += 1
    assert {t: [n.owner[2], n.count] for t, n in trie.terminals()} == want
    size = sum(len(n.label) for n in nodes_of(trie.root))
    assert size <= sum(len(k) for k in set(keys)) and all(len(n.kids) != 1 or n.owner is not None for n in nodes_of(trie.root) if n is not trie.root)
    spilled = {}
    while trie.weight:
        spilled |= {t: [n.owner[2], n.count] for t, n in trie.spill()}
    assert trie.size == 0 and spilled == {k: v for k, v in want.items() if k}


def nodes_of(node):
    yield node
    for kid in node.kids.values():
        yield from nodes_of(kid)


# 13 manifest


def plain_tree(leaves):
    """The levels of a tree, from the definition."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([merkle.digest(*levels[-1][k : k + 2]) for k in range(0, len(levels[-1]), 2)])
    return levels


def plain_path(levels, i):
    out = []
    for level in levels[:-1]:
        out.append(level[i ^ 1] if i ^ 1 < len(level) else None)
        i >>= 1
    return out


@given(st.integers(1, 140), st.integers(1, 4), st.integers(0, 2))
@settings(max_examples=80, deadline=None)
def test_fractal_paths_are_those_of_the_tree(n, sub, above):
    leaves = [merkle.digest(str(k)) for k in range(n)]
    height = (n - 1).bit_length()
    levels = plain_tree(leaves)
    for _ in range(above):  # an incomplete block of a larger tree: its last node is hashed on alone
        levels.append([merkle.digest(levels[-1][0])])
    got = list(merkle.traverse(leaves, height + above, sub))
    assert got == [plain_path(levels, i) for i in range(n)]
    assert merkle.block_root(leaves, height + above) == levels[-1][0]
    assert all(merkle.fold(x, merkle.steps(p, i)) == levels[-1][0] for i, (x, p) in enumerate(zip(leaves, got)))


def plain_manifest(rows):
    """op13 from (doc_id, source, lang, n_chars, text), in plain Python."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, s, g, n, t: merkle.digest("".join(map(field, (d, s, g, n, t))))
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    order = sorted(langs, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g, own in langs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[g] = plain_tree([leaf(*r) for r in own])
    top = plain_tree([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, r in enumerate(langs[g]):
            path = [(x, i >> j & 1) for j, x in enumerate(plain_path(trees[g], i))] + [(x, k >> j & 1) for j, x in enumerate(plain_path(top, k))]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            node = leaf(*r[:3], r[3] + 1, r[4]) if hit else leaf(*r)
            for x, right in path:
                node = merkle.digest(node) if x is None else merkle.digest(x, node) if right else merkle.digest(node, x)
            out.append((r[0], leaf(*r), trees[g][-1][0], top[-1][0], merkle.digest(*[x for x, _ in path if x]), node, node == top[-1][0]))
    return sorted(out, key=repr)


NAMES = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("block,sub", [(9, 3), (2, 1), (3, 2), (1, 1)])
def test_manifest_is_that_of_the_definition(spark, block, sub):
    rng = random.Random(block)
    rows = [(rng.choice([*range(60), None]), rng.choice(["web", None, "", "-"]), rng.choice(["en", "de", None, "", "zh-é", "-"]), rng.choice([0, 9, 10**9, None, -3]), rng.choice([None, "", "a", "é\n", "w " * 30_000])) for _ in range(130)]
    rows += [(k, "s", "en", k, f"t{k}") for k in range(100, 260)] + rows[:5] + [(1, "s", f"lang{k}", 1, "x") for k in range(7)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({c: F.lit(1) for c in ("tree", "pos", "n", "digest", "_block", "proof", "name")}).repartition(4)
    got = [tuple(r[c] for c in NAMES) for r in merkle.tampered_manifest(spark, df, block, sub).collect()]
    assert sorted(got, key=repr) == plain_manifest(rows)


def test_manifest_of_odd_rows_the_table_and_none(spark):
    rows = [tuple(r[c] for c in ("doc_id", "source", "lang", "n_chars", "text")) for r in odd(spark).collect()]
    assert sorted([tuple(r[c] for c in NAMES) for r in merkle.tampered_manifest(spark, odd(spark)).collect()], key=repr) == plain_manifest(rows)
    docs = queries.table(spark, SF, "documents")
    rows = [tuple(r[c] for c in ("doc_id", "source", "lang", "n_chars", "text")) for r in docs.collect()]
    got = [tuple(r[c] for c in NAMES) for r in queries.op13_manifest(spark, SF).collect()]
    assert sorted(got, key=repr) == plain_manifest(rows)
    assert 0 < sum(not r[-1] for r in got) < len(got) / 3
    none = merkle.tampered_manifest(spark, empty(spark))
    assert none.columns == list(NAMES) and none.count() == 0


# earlier operators: long cells, repeated headings, wide alignments


def test_cells_are_never_cut(monkeypatch):
    names = ["token", "cell", "at", "k", "p1"]
    rows = [(1, 0, 0, 0, 0)] * 3 + [(9, 0, 0, i, 0) for i in range(20)] + [(9, 1, 0, 0, 0)] * 2
    batches = [pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[a : a + 2]]) for c in range(5)], names) for a in range(0, len(rows), 2)]
    runs = [list(zip(*(c.to_pylist()[:] for c in x.columns))) for x in jaccard._whole_lists(iter(batches), 2, 4, split=False)]
    assert [r for run in runs for r in run] == rows
    assert all(len({k for k, run in enumerate(runs) if any(r[:2] == key for r in run)}) == 1 for key in ((1, 0), (9, 0), (9, 1)))


@pytest.mark.parametrize("num,den", [(90, 100), (80, 100)])
def test_no_link_is_lost_at_a_bound_of_eight_rows(spark, monkeypatch, num, den):
    """Lists much longer than what a walk reads at once; the second walk must find what the first could not."""
    for name, value in (("ROWS", 8), ("CROSS_ROWS", 8), ("CELL", 16), ("PAIRS", 5), ("BLOCK", 4)):
        monkeypatch.setattr(jaccard, name, value)
    rng, rows = random.Random(num), []
    for g in range(30):
        base = [f"g{g}w{k}" for k in range(38)]
        for _ in range(6):
            w = list(base)
            w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
            rows.append((len(rows), "same three words " + " ".join(w)))
    got = {r[0]: (r[1], r[2]) for r in jaccard.jaccard_components(spark, spark.createDataFrame(rows, "doc_id long, text string"), 3, num, den).collect()}
    assert got == brute_components(rows, 3, num, den)


def test_a_cell_over_the_bound_gives_the_pair_of_its_ends(monkeypatch):
    m = 300
    monkeypatch.setattr(jaccard, "CROSS_ROWS", 64)
    bits = [np.uint64(0)] * m
    cols = [np.full(m, 5), np.zeros(m, np.int64), np.zeros(m, np.int32), np.full(m, 30, np.int32), np.zeros(m, np.int32), np.arange(m), np.array([0] + [(1 << 40) - 1] * (m - 2) + [0]), np.array([0] + [(1 << 40) - 1] * (m - 2) + [0]), np.array([1] + [2] * (m - 2) + [3])]
    whole = pa.RecordBatch.from_arrays([pa.array(c) for c in cols], jaccard.CELLS)
    out = [r for b in jaccard._long_lists(90, 100)(whole.slice(a, 50) for a in range(0, m, 50)) for r in b.to_pylist()]
    assert bits and [(r["a"], r["b"]) for r in out] == [(0, m - 1)]


def test_repeated_headings_of_articles_stay(spark):
    body = lambda k: f"<h1>Cake {k}</h1><h2>Ingredients</h2><p>Flour {k}, sugar {k} and butter {k}.</p><p>Notes</p><h2>Method</h2><p>Mix all of {k} well and bake it for {k} minutes.</p>"
    pages = [f"<body><nav>Home</nav><div class=x>{body(k)}<p>Sign up now</p></div><footer>Imprint</footer>" for k in range(8)]
    want = {k: f"Cake {k}\n\nIngredients\n\nFlour {k}, sugar {k} and butter {k}.\n\nNotes\n\nMethod\n\nMix all of {k} well and bake it for {k} minutes." for k in range(8)}
    assert main_of(spark, pages) == want


def test_alignment_of_differing_blocks_is_bounded():
    import time

    def page(n, tags):
        return "".join(f"<div class=k{i}>" + "".join(f"<{tags[(i + j) % 3]} class=c{j}><p>{i}</p>" + f"<b></b><ul><li>x</ul>" * (j % 2) + f"</{tags[(i + j) % 3]}>" for j in range(n)) + "</div>" for i in range(n))

    for n in (20, 60):
        a, b = (html_wrapper.folded(html_wrapper.parse(page(n, t))).skeleton for t in (("section", "div", "article"), ("div", "section", "main")))
        began = time.time()
        to = html_wrapper.alignment(a, b)
        assert time.time() - began < 2 and sum(x >= 0 for x in to) > n
        hit = [x for x in to if x >= 0]
        assert hit == sorted(set(hit))


def test_greedy_matching_keeps_order_and_ancestry(monkeypatch):
    monkeypatch.setattr(html_wrapper, "PAIRS", 0)
    rng = random.Random(4)

    def shape(depth):
        return rng.choice("ab"), [shape(depth - 1) for _ in range(rng.randrange(4))] if depth else []

    for _ in range(60):
        x, y = ("r", [shape(3) for _ in range(3)]), ("r", [shape(3) for _ in range(3)])
        a, b = html_wrapper.tree(skeleton(x)), html_wrapper.tree(skeleton(y))
        size, pairs = html_wrapper.tree_match(a, b)
        to = dict(pairs)
        assert len(pairs) == size <= brute_match(x, y) and [q for _, q in pairs] == sorted(to.values())
        assert all(a.names[p] == b.names[q] and (p == 0 or to[a.parents[p]] == b.parents[q]) for p, q in pairs)


def test_large_trees_are_matched_exactly(monkeypatch):
    """Over 20,000 pairs of nodes the matching once was one by equal subtrees and names."""
    rng = random.Random(7)
    x, y = (("r", [(rng.choice("ab"), [(rng.choice("cdef"), []) for _ in range(rng.randrange(6))]) for _ in range(300)]) for _ in "xy")
    a, b = html_wrapper.tree(skeleton(x)), html_wrapper.tree(skeleton(y))
    size, pairs = html_wrapper.tree_match(a, b)
    assert size == len(pairs) == brute_match(x, y)
    monkeypatch.setattr(html_wrapper, "CELLS", 1000)  # the rows of the alignment are cut into parts: the same pairs
    assert html_wrapper.tree_match(a, b) == (size, pairs)


def test_one_payload_on_most_rows_meets_its_digest_first(spark, monkeypatch):
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", -1)
    rows = [(k, f"http://h/{k}", "" if k % 5 else f"<p>{k % 10}") for k in range(3, 203)] + [(None, "u", ""), (3, "again", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"same": F.lit("s"), "p": F.lit(1), "sha1": F.lit(2)})
    got = warc.read_archives(warc.write_archives(spark, df)).collect()
    first = {}
    for d, _, h in rows:
        if d is not None:
            first[h] = min(d, first.get(h, d))
    want = [(d, len(h), "response" if first[h] == d else "revisit", None if first[h] == d else first[h]) for d, _, h in rows]
    assert sorted(map(repr, ((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got))) == sorted(map(repr, want))


def test_a_word_is_hashed_whole():
    a, b = ("aA" * 40 + x for x in ("9", "-"))
    assert ordinal.word_features(a)[1] != ordinal.word_features(b)[1]
    signs = "!#$%&()*+,-./:;<=>?@"
    assert ordinal.word_features(signs)[2] != ordinal.word_features(signs + "~")[2]


def test_remembered_words_are_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(ordinal, "MEMORY", 2000)
    m = ordinal.Ordinal(np.arange(1 << ordinal.BITS, dtype=np.float32), np.array([0.0]))
    want = [m.score(f"w{k} x") for k in range(50)]
    assert len(m.word) < 50 and want == [ordinal.Ordinal(m.weights, m.thresholds).score(f"w{k} x") for k in range(50)]


@pytest.mark.parametrize("rule", ["norm", "dot"])
@given(st.lists(st.integers(1, 64), max_size=60), st.integers(1, 8), st.integers(4096, 12_000))
@settings(max_examples=60, deadline=None)
def test_pieces_go_to_the_bin_that_scores_best(rule, lengths, most_docs, attention):
    lengths = sorted(lengths, reverse=True)
    where, offset = packing.best_fit(np.array(lengths, np.int64), 64, most_docs, attention, rule)
    state, caps = {}, (64, most_docs, attention)
    for k, size in enumerate(lengths):  # ties go to any bin of the best score: each choice is held against its own state
        need = (size, 1, size * size)

        def score(free):
            if rule == "norm":
                return sum(w * ((f - n) / c) ** 2 for w, f, n, c in zip((1, 0.05, 0.05), free, need, caps))
            return -sum(w * f * n / c / c for w, f, n, c in zip((1, 0.05, 0.05), free, need, caps))

        fits = [score(f) for f in state.values() if all(x >= n for x, n in zip(f, need))]
        own = int(where[k])
        assert (own in state) == bool(fits)
        if fits:
            assert score(state[own]) <= min(fits) + 1e-12
        free = state.get(own, caps)
        assert offset[k] == 64 - free[0]
        state[own] = tuple(f - n for f, n in zip(free, need))


def test_texts_of_megabytes_are_taken_whole(spark):
    rng = random.Random(1)
    long = " ".join(f"w{rng.randrange(50_000)}" for _ in range(400_000))
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, "short")], "doc_id long, text string")
    media_rows = {r["doc_id"]: r for r in media.store_and_read(spark, docs).collect()}
    assert media_rows[1]["n_bytes"] == len(long.encode())
    ids = {r["doc_id"]: r for r in tokenbin.corpus_table(spark, docs, queries.VOCABULARY).collect()}
    assert ids[2]["start"] == ids[1]["n_tokens"] and ids[3]["start"] == ids[1]["n_tokens"] + ids[2]["n_tokens"]
    linked = {r["doc_id"]: r for r in jaccard.jaccard_components(spark, docs).collect()}
    assert linked[2]["component_id"] == 1 and linked[2]["n_shingles"] == linked[1]["n_shingles"] + 1 and linked[3]["component_id"] == 3
    model = ordinal.Ordinal(np.ones(1 << ordinal.BITS, np.float32), np.array([0.0]))
    assert ordinal.classify(spark, docs, model).count() == 3
    pieces = packing.pack_documents(spark, docs, queries.VOCABULARY).collect()
    assert sum(r["length"] for r in pieces) == sum(r["n_tokens"] for r in ids.values())
    assert {r["kept"] for r in patricia.exact_dedup(spark, docs, memory=1 << 16).collect()} == {True}


@pytest.mark.parametrize("mix", [mixing.Mix(), mixing.Mix(0.99, 1.5, None), mixing.Mix(0.5, 3.0, 0.7), mixing.Mix(None, None, 2.0), mixing.Mix(0.9999, None, None)])
def test_the_plan_of_many_sources_is_that_of_few(spark, mix):
    """The same bisection, by sums over all sources in Spark; a source has a third of all tokens."""
    rng = random.Random(4)
    sources = [(None, 700), ("hot", 60_000), *[(f"s{k}", rng.randrange(1, 90)) for k in range(3000)]]
    want = {r[0]: r for r in mixing.source_plan(sources, mix)}
    got = {r["s"]: r for r in mixing.wide_plan(spark.createDataFrame(sources, "source string, tokens long"), mix, len(sources)).collect()}
    assert set(got) == set(want)
    for name, (_, tokens, weight, passes, rest, blocks) in want.items():
        r = got[name]
        assert r["weight"] == pytest.approx(weight, rel=1e-9) and r["blocks"] == blocks and abs((r["passes"] * tokens + r["rest"]) - (passes * tokens + rest)) <= 1


def test_a_hundred_thousand_sources_are_mixed(spark):
    docs = spark.range(100_500).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id").cast("string"))).alias("source"), F.lit("a b c").alias("text"))
    drawn, plan = mixing.mixed(spark, docs, mixing.Mix(0.95, 1.5, None))
    assert plan.count() == 67_001
    by = {r["doc_id"]: r["n"] for r in drawn.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert len(by) == 100_500 and max(by.values()) <= 2


def test_toxicity_of_an_empty_table(spark):
    docs, labels = (queries.table(spark, SF, t) for t in ("documents", "labels"))
    model = toxicity.train(spark, docs, labels)
    assert toxicity.toxicity(spark, empty(spark), model).count() == 0
    none = toxicity.train(spark, empty(spark), labels)
    assert {r["score"] for r in toxicity.toxicity(spark, odd(spark), none).collect()} == {0.0}


def test_what_near_copies_share_stays(spark):
    """Half of a host's contents are variants of one article; the paragraphs they share, the last too, are content."""
    near = [f"<article><h1>Flood in town</h1><p>The river rose by {k} metres over night and took {k} bridges along.</p><p>Schools stay shut.</p></article>" for k in range(6)]
    other = [f"<article><h1>Story {k}</h1><p>Something else altogether happened at place {k}, says one.</p><p>End {k}.</p></article>" for k in range(5)]
    pages = [f"<body><nav>Home</nav>{a}<footer>Imprint</footer>" for a in near + other]
    got = main_of(spark, pages)
    assert [got[k].split("\n\n") for k in range(6)] == [["Flood in town", f"The river rose by {k} metres over night and took {k} bridges along.", "Schools stay shut."] for k in range(6)]
