"""Corpus operators on small tables: edge cases and plain-Python versions of their results."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxrisk.llm import chat, decontaminate, extract, licenses, lines, minhash, neighbours, packing, quality, sharding
from voxrisk.llm.graphs import components, narrow, without
from voxrisk.session import COMPILED_BYTES, METHOD_CONF, settle

DOC = "doc_id long, text string, lang string"
BIG = (1 << 60) + 1


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en") for i, t in rows], DOC)


def invented(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta of the and to epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(40)) for _ in range(n))


EDGE = [(None, "some words without an id"), (None, None), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (BIG, "word " * 30_000), (5, "é\U0001f600 ß")]


# --- links -----------------------------------------------------------------------
def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    label = {x: x for pair in links for x in pair if pair[0] != pair[1]}
    for _ in label:
        for a, b in links:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(got) == len(label) and {r.node: r.component for r in got} == label
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_narrow_and_without(spark):
    rows = spark.createDataFrame([(i, str(i)) for i in range(50)] + [(None, "x")], "i long, t string")
    ids = spark.createDataFrame([(3,), (7,), (99,)], "k long")
    assert {3, 7} <= {r.i for r in narrow(rows, "i", ids, "k").collect()}
    assert {r.i for r in without(rows, "i", ids, "k").collect()} == {*range(50), None} - {3, 7}


# --- near-duplicates -------------------------------------------------------------
def brute_groups(rows, size, percent=80):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[i] = {tuple(w[k:k + min(size, len(w))]) for k in range(len(w) - min(size, len(w)) + 1)} if w else set()
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return {i: (len(s), label[i]) for i, s in sets.items()}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, monkeypatch, size):
    monkeypatch.setattr(minhash, "FEW", 3)  # so that buckets are compared in blocks too
    rng = random.Random(size)
    rows = []
    for g in range(12):
        words = invented(rng, rng.choice([3, 30, 120])).split()
        for _ in range(rng.randrange(1, 9)):
            copy = list(words)
            for _ in range(rng.randrange(0, max(1, len(words) // 12))):
                copy[rng.randrange(len(copy))] = "new" + str(rng.randrange(5))
            rows.append((len(rows) * 3 + 1, " ".join(copy)))
    rows += [(1000, ""), (1001, None), (1002, "Solo"), (1003, "solo"), (1004, "solo x")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs(spark, rows), shingle_words=size).collect()}
    assert got == brute_groups(rows, size)


def test_near_duplicates_edges(spark):
    out = minhash.near_duplicates(docs(spark, EDGE), shingle_words=2).collect()
    assert len(out) == len(EDGE)
    assert Counter((r.doc_id, r.component_id, r.kept) for r in out)[(None, None, True)] == 2
    assert {r.n_shingles for r in out if r.doc_id in (1, 2, 3)} == {0} and [r.n_shingles for r in out if r.doc_id == BIG] == [1]
    assert minhash.near_duplicates(docs(spark, [])).count() == 0


def test_hamming_guarantee():
    """Signatures within DISTANCE share an index key."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 16, (200, minhash.POSITIONS), dtype=np.uint16)
    other = base.copy()
    for row in other:
        row[rng.choice(minhash.POSITIONS, minhash.DISTANCE, replace=False)] += 1
    with np.errstate(over="ignore"):
        a, b = minhash.index_keys(base), minhash.index_keys(other)
    assert ((a == b).sum(axis=1) > 0).all()


# --- decontamination -------------------------------------------------------------
def test_decontamination(spark):
    rng = random.Random(5)
    items = [(k, invented(rng, rng.choice([12, 40, 100])) + ".\nAnswer " + invented(rng, 6)) for k in range(25)]
    rows = []
    for k in range(60):
        text = invented(rng, rng.choice([20, 300]))
        if k % 5 == 0:
            item = items[k % 25][1]
            text = text[:len(text) // 2] + " " + (item.upper() if k % 2 else item) + " " + text[len(text) // 2:]
        rows.append((k, text))
    question_only = items[3][1].split("\n")[0]
    rows += [(100, question_only), (101, None), (102, ""), (None, items[2][1])]
    table = spark.createDataFrame(items + [(50, None), (51, "too short"), (52, "")], "item_id long, text string")
    found = decontaminate.contaminated(docs(spark, rows), table)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(k, k % 25) for k in range(0, 60, 5)} | {(None, 2)}
    by_shards = decontaminate.contaminated(docs(spark, rows), table, shard_words=300)
    columns = ["doc_id", "item_id", "start"]
    assert sorted(map(str, by_shards.select(*columns).collect())) == sorted(map(str, found.select(*columns).collect()))
    kept = decontaminate.drop_contaminated(docs(spark, rows), table)
    assert {r.doc_id for r in kept.collect()} == {k for k in range(60) if k % 5} | {100, 101, 102}
    assert decontaminate.contaminated(docs(spark, rows), table.limit(0)).count() == 0


def test_short_items_and_tails(spark):
    long = [f"w{k}" for k in range(83)]  # a tail of three words, with the answer
    items = [(1, "Two words"), (2, "質問は何ですか。答えは東京です。"), (3, "a b c d"), (None, "sole"), (None, "other"), (4, " ".join(long[:81]) + "? " + " ".join(long[81:])), (5, "?!")]
    rows = [(10, "here two, words stand"), (11, "two other words"), (12, "前。質問は何ですか。答えは東京です。後"), (13, "x a b c d y"), (14, "a b c x d"), (15, "b c d a b c"),
            (16, "pad " * 77 + " ".join(long) + " end"), (17, " ".join(long[:81]) + " q r s"), (18, "the sole thing")]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(spark, rows), table).collect()]
    assert (11, None) in got and (18, None) in got
    assert sorted(x for x in got if x[1]) == [(10, 1), (12, 2), (13, 3), (16, 4), (17, 4)] and len(got) == 7


def test_block_max_wand_equals_exhaustive():
    rng = random.Random(8)
    words = [f"w{k}" for k in range(60)]
    pieces = [(p, rng.choices(words, range(60, 0, -1), k=12), rng.choices(words, k=4)) for p in range(150)]
    df = Counter(w for _, q, a in pieces for w in {*q, *a})
    index = decontaminate.build_index(pieces, {w: math.log(1 + (150 - n + 0.5) / (n + 0.5)) for w, n in df.items()}, 16)
    for _ in range(60):
        terms = rng.sample(range(len(index.words)), rng.randrange(1, 40))
        for threshold in (0.2, 0.5, 0.8):
            sums = defaultdict(float)
            for t in terms:
                for p, x in zip(index.postings[t], index.weights[t]):
                    sums[int(p)] += x
            want = {p for p, x in sums.items() if x >= threshold - 1e-9}
            assert {p for p, _ in decontaminate.block_max_wand(index, terms, threshold)} == want


# --- html ------------------------------------------------------------------------
def test_main_text():
    page = """<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><a href=1>Menu</a></nav>
    <div class="sidebar"><p>Side text, long enough, with commas, to be a paragraph of its own.</p></div>
    <div id=content class="main with-sidebar"><h1>Head &eacute; &lt;</h1><p>First, with\n  commas, and text.<p>Second <a href=x>link</a>&nbsp;here
    <ul><li>one<li>two</ul><div class=cookie-notice>Cookies, please.</div><form><p>Sign up</p></form><script>var p = "</p>";</script></div>
    <section id=comments><p>Nice, post, really, good, comment text.</p></section><div class="ad">Buy, now.</div><footer>&copy;</footer></body></html>"""
    assert extract.main_text(page) == "Head é <\nFirst, with commas, and text.\nSecond link here\none\ntwo"
    for source, want in ((None, ""), ("", ""), ("plain", "plain"), ("<p>a", "a"), ("<a href=x>only a link</a>", ""), ("<p>cut <b", "cut"), ("<" * 2000, "<" * 2000)):
        assert extract.main_text(source) == want, source
    assert extract.main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    long = "<article>" + "".join(f"<p>Part {k}, of a long text.</p>" for k in range(5000)) + "</article>"
    assert extract.main_text(long).count("\n") == 4999


def test_articles_side_by_side():
    part = lambda name, many: "".join(f"<p>{name} {k}, a paragraph with commas, and with some length to it.</p>" for k in range(many))
    teaser = "<article><h3><a href=1>Read more, now</a></h3><p>Short, <a href=2>teaser of another page, with a link</a></p></article>"
    page = f"<body><nav>Menu</nav><main><article>{part('One', 5)}</article><article>{part('Two', 3)}</article>{teaser}<article class=comment>{part('No', 4)}</article></main></body>"
    lines = extract.main_text(page).split("\n")
    assert [x.split(",")[0] for x in lines] == [f"One {k}" for k in range(5)] + [f"Two {k}" for k in range(3)]
    even = f"<body><div>{part('A', 3)}</div><section><div>{part('B', 3)}</div></section></body>"
    assert extract.main_text(even).startswith("A 0,")


@pytest.mark.parametrize("seed", range(6))
def test_planted_articles_of_several_shapes(seed):
    rng = random.Random(seed)
    around = ['<nav><ul><li><a href=1>Home</a><li><a href=2>News, and more</a></ul></nav>', '<div class="sidebar"><p>Side, text, with, many, commas, of another thing.</p></div>',
              '<div id="cookie-banner">We use cookies, of course, here.</div>', '<form><p>Sign up, please, today, now.</p></form>', "<script>let p = '<p>no, no</p>'</script>"]
    for shape in ("<article>{}</article>", "<main>{}</main>", '<div class="post-content">{}</div>', "<div><div><section>{}</section></div></div>"):
        blocks = [("h1", "Title of the page")] + [(rng.choice(["p", "p", "p", "h2", "blockquote"]), f"Block {k} &amp; {invented(rng, 25)}, and  more.") for k in range(8)]
        body = "\n".join(f"<{tag}>{text}</{tag}>" for tag, text in blocks)
        rng.shuffle(around)
        page = f"<html><head><title>x</title></head><body>{''.join(around[:2])}{shape.format(body)}{''.join(around[2:])}<footer><p>Imprint, terms, contact.</p></footer></body></html>"
        want = [" ".join(text.replace("&amp;", "&").split()) for _, text in blocks]
        assert extract.main_text(page).split("\n") == want, shape


def test_extract_pages(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>", 5), (1, "u", "<p>a</p>", 5), (None, None, None, None), (BIG, "", "", 1)], "page_id long, url string, html string, n_chars int")
    assert Counter(map(tuple, extract.extract_pages(pages).collect())) == Counter({(1, "u", "a", 1): 2, (None, None, "", 0): 1, (BIG, "", "", 0): 1})
    assert extract.extract_pages(pages.limit(0)).count() == 0


# --- lines -----------------------------------------------------------------------
def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(rng, text, edits):
    text = list(text)
    for _ in range(edits):
        at, kind = rng.randrange(len(text)), rng.choice("ids")
        if kind == "i":
            text.insert(at, rng.choice("abé😀"))
        elif kind == "d":
            text.pop(at)
        else:
            text[at] = rng.choice("xyzß")
    return "".join(text)


def test_within_edits(spark):
    rng = random.Random(4)
    for edits in (1, 2, 3):
        pairs = []
        for _ in range(150):
            a = "".join(rng.choice("ab😀") for _ in range(rng.randrange(edits + 1, 14)))
            b = changed(rng, a, rng.randrange(0, 4)) if len(a) > 6 else a
            if len(b) >= edits + 1:
                pairs.append((a, b))
        rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", lines.within_edits(F.col("a"), F.col("b"), edits).alias("near")).collect()
        assert all(r.near == (levenshtein(r.a, r.b) <= edits) for r in rows)


def test_dedup_lines(spark):
    rng = random.Random(6)
    base = [invented(rng, n) for n in (2, 3, 4, 8, 8, 12)]
    rows = []
    for k in range(40):
        text = [rng.choice([lambda: rng.choice(base), lambda: changed(rng, rng.choice(base), rng.randrange(1, 4)), lambda: invented(rng, 9), lambda: ""])() for _ in range(rng.randrange(1, 6))]
        rows.append((k, "\n".join(text)))
    first, gone, counts = {}, set(), {}
    for d, t in rows:
        for p, line in enumerate(t.split("\n")):
            if line.strip(" "):
                first.setdefault(line.strip(" "), (d, p))
    near = {x for x in first for y in first if first[y] < first[x] and x != y and abs(len(x) - len(y)) <= 2 and levenshtein(x, y) <= min(2, min(len(x), len(y)) // 20)}
    for d, t in rows:
        kept, n = [], [0, 0, 0]
        for p, raw in enumerate(t.split("\n")):
            line = raw.strip(" ")
            exact = bool(line) and line not in near and first[line] != (d, p)
            n[0] += bool(line)
            n[1] += exact
            n[2] += line in near
            if not exact and line not in near:
                kept.append(raw)
        counts[d] = ("\n".join(kept), *n)
    assert near
    got = lines.dedup_lines(docs(spark, rows)).collect()
    assert {r.doc_id: (r.text, r.n_lines, r.n_exact, r.n_near) for r in got} == counts


def test_dedup_lines_edges(spark):
    table = docs(spark, EDGE).withColumn("n_lines", F.lit("clash"))
    out = lines.dedup_lines(table).collect()
    assert len(out) == len(EDGE) and [r.text for r in out if r.doc_id == 1] == [None] and [r.text for r in out if r.doc_id == 2] == [""]
    assert [r.text for r in out if r.doc_id == 4] == ["one", "one"]  # repeated rows are one document
    assert lines.dedup_lines(docs(spark, [])).count() == 0


def test_near_lines_equal_all_pairs(spark):
    """Links of lines against every pair by plain edit distance, in one-byte and wider characters."""
    rng = random.Random(23)
    made = set()
    for _ in range(12):
        base = "".join(rng.choice("abcde é中") for _ in range(rng.randrange(18, 70)))
        for _ in range(14):
            x = list(base)
            for _ in range(rng.randrange(0, 4)):
                at = rng.randrange(len(x))
                x[at:at + 1] = rng.choice(["", "z", "é", x[at] + "q"])
            made.add("".join(x).strip())
    made |= {"x" * n for n in range(18, 45)} | {"common opening words " + str(n) * 25 for n in range(30)}
    table = spark.createDataFrame([(x,) for x in sorted(made)], "line string").withColumn("k", F.xxhash64("line"))
    name = {r.k: r.line for r in table.collect()}
    found = {frozenset((name[r.a], name[r.b])) for r in lines.near_lines(table).collect()}

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        return row[-1]

    every = sorted(made)
    wanted = {
        frozenset((x, y)) for i, x in enumerate(every) for y in every[:i]
        if abs(len(x) - len(y)) <= 2 and distance(x, y) <= min(2, min(len(x), len(y)) // 20)}
    assert found == wanted and len(wanted) > 100


def test_stages_keep_columns_of_any_name(spark):
    """Columns of the caller named like those that the operators add come back as they were."""
    names = ["_maybe", "_word", "_bit", "_bits", "gone", "near", "exact", "doc", "t", "n_lines", "_row", "c1"]
    rows = [(k, text, "en", "s", *range(100 * k, 100 * k + len(names))) for k, text in enumerate([
        "a first line that is long enough\nand another one that stays", "something else\na first line that is long enough", "", None,
        "something else\na first line that is long enough"])]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` long" for n in names))
    items = spark.createDataFrame([(1, "Question about nothing in here at all.\nAnswer with some words")], "item_id long, text string")
    given = {r.doc_id: tuple(r[n] for n in names) for r in table.collect()}
    gone = spark.createDataFrame([(1,)], "doc_id long")
    for run in (lambda d: without(d, "doc_id", gone, "doc_id"), lambda d: decontaminate.drop_contaminated(d, items), lines.drop_repeated_lines):
        out = run(table)
        assert out.dtypes == table.dtypes
        kept = out.collect()
        assert kept and all(tuple(r[n] for n in names) == given[r.doc_id] for r in kept)


def test_pipeline_lines_spare_copies(spark):
    rng = random.Random(3)
    shared, own = [invented(rng, 8) for _ in range(4)], "Boilerplate of the site, on every page."
    rows = [(1, "\n".join([own, *shared])), (2, "\n".join([own, *shared])), (3, own + "\nBut this is mine."), (4, own), (5, "x\nx\ny")]
    got = {r.doc_id: r.text for r in lines.drop_repeated_lines(docs(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: rows[1][1], 3: "But this is mine.", 5: "x\ny"}


def test_pipeline_lines_remove_passages_of_unlike_documents(spark):
    rng = random.Random(4)
    head, foot, words = "Header of the site, on every page.", "Footer of the site, on every page.", [invented(rng, 14) for _ in range(5)]
    own = [[invented(rng, 15) for _ in range(9)] for _ in range(3)]
    rows = [(k, "\n".join([head, *own[k][:5], *words, *own[k][5:], foot])) for k in range(3)]
    changed_copy = rows[1][1].replace(own[1][4].split(" ")[7], "altered", 1)
    rows += [(3, changed_copy), (4, "\n".join([head, *own[2], head, foot])), (5, "\n".join([own[0][0], "mine", own[0][0]]))]
    got = {r.doc_id: r.text for r in lines.drop_repeated_lines(docs(spark, rows), min_places=3).collect()}
    assert got[0] == rows[0][1] and got[1] == "\n".join(own[1]) and got[2] == "\n".join(own[2])
    assert got[3] == got[1].replace(own[1][4].split(" ")[7], "altered", 1)  # near_dedup has to judge this copy as a whole
    assert got[4] == got[2]  # so are copies whose shared lines stand in another row
    assert got[5] == "mine"


def test_pipeline_lines_repeats_inside_a_copy_go(spark):
    rng = random.Random(14)
    body = [invented(rng, 30) for _ in range(4)]
    rows = [(1, "\n".join(body)), (2, "\n".join([*body, body[0]]))]
    assert [r.text for r in lines.drop_repeated_lines(docs(spark, rows), min_places=2).collect()] == [rows[0][1]] * 2


def test_pipeline_lines_remove_what_stands_in_two_documents(spark):
    rng = random.Random(24)
    passage, own = invented(rng, 60), [invented(rng, 80) for _ in range(2)]
    got = {r.doc_id: r.text for r in lines.drop_repeated_lines(docs(spark, [(k, own[k] + "\n" + passage) for k in range(2)])).collect()}
    assert got == {0: own[0] + "\n" + passage, 1: own[1]}


# --- packing ---------------------------------------------------------------------
def test_token_ids_equal_the_public_tokenizer():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    for text in ["", "a<|endoftext|>b", "  \n\n x\t\t y", "日本語 😀👍🏽 x", "it's we'LL <|endo", "\x00\x01 \r\n  ", "a" * 3000, " " * 3000, "1234567 éèü ß"]:
        assert packing.token_ids(text, "byte_bpe_50k").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_local_search_keeps_all():
    rng = random.Random(2)
    for low, high in ((1, 30), (35, 60), (20, 55)):
        size = [rng.randrange(low, high) for _ in range(400)]
        start = packing.best_fit(size, 100)
        bins = packing.local_search([list(b) for b in start], size, 100)
        assert sorted(i for b in bins for i in b) == list(range(400)) and max(sum(size[i] for i in b) for b in bins) <= 100
        assert -(-sum(size) // 100) <= len(bins) <= len(start)
    # an exchange of 34 and 40 makes the room for 12
    assert len(packing.local_search([[0, 1], [2, 3], [4]], [60, 34, 50, 40, 12], 100)) == 2


def test_pack_documents(spark):
    rows = EDGE + [(k, invented(random.Random(k), k)) for k in range(10, 200)]
    out = packing.pack_documents(docs(spark, rows), block_pieces=64, with_ids=True).collect()
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in out:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    for key, text in rows:
        if key not in (None, 4):
            got = sorted(by_doc[key], key=lambda r: r.piece)
            assert [x for r in got for x in r.ids] == [*packing.token_ids(text or "", "byte_bpe_50k").tolist(), 0]
            assert [r.start for r in got] == [0, *np.cumsum([r.length for r in got])[:-1]] and all(r.length == 2048 for r in got[1:])
    assert len(by_doc[4]) == 2 and len(by_sequence) <= -(-sum(r.length for r in out) // 2048) + 1
    assert packing.pack_documents(docs(spark, [])).count() == 0


@pytest.mark.parametrize("copies", [False, True])
def test_packing_blocks_stay_bounded(spark, monkeypatch, copies):
    written = []
    monkeypatch.setattr(packing, "settle", lambda df, name: written.append((name, settle(df, name))) or written[-1][1])
    # two of these never fit into one sequence, and one alone leaves it loose
    rows = [(None if copies else k, " word" * (1200 if copies else 1030 + k)) for k in range(256)]
    out = packing.pack_documents(docs(spark, rows), block_pieces=16)
    assert out.count() == 256 == out.select("sequence_id").distinct().count()
    levels = [df.groupBy("block").count() for name, df in written if name == "pack-level"]
    assert len(levels) == 2 and max(r["count"] for df in levels for r in df.collect()) < 64


# --- neighbours ------------------------------------------------------------------
def test_chi_square():
    assert abs(neighbours.chi_square(neighbours.chi_square_quantile(0.9, 8), 8) - 0.9) < 1e-9 and abs(neighbours.chi_square_quantile(0.95, 8) - 15.507) < 1e-3


@pytest.mark.parametrize("cluster", [0.0, 2.0])
def test_nearest(spark, cluster):
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((6, 12)) * cluster
    x = centres[rng.integers(0, 6, 1500)] + rng.standard_normal((1500, 12))
    x[600:900] = x[600]  # equal vectors: ties go to the smaller id
    rows = [(i, v.tolist(), i) for i, v in enumerate(x.astype(np.float32).astype(float))]
    bad = [(2000, None, 0), (2020, [0.0] * 12, 0), (2040, [float("nan")] * 12, 0), (2060, [1.0, None] + [0.0] * 10, 0), (2080, [1.0] * 5, 0), (None, [1.0] * 12, 0)]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int")
    got = defaultdict(list)
    for r in neighbours.nearest(table, k=10, cell_rows=300, block_rows=200, queries_at_once=16).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    vectors, hits = np.array([r[1] for r in rows]), 0
    assert set(got) == set(range(0, 1500, 20))
    for q, found in got.items():
        scores = (vectors * vectors[q]).sum(axis=1)
        best = [i for i in np.lexsort((np.arange(1500), -scores)) if i != q][:10]
        assert [r for r, _, _ in sorted(found)] == list(range(1, 11)) and all(abs(s - scores[i]) < 1e-9 for _, i, s in found)
        hits += len({i for _, i, _ in found} & set(best))
    assert hits >= 0.9 * 10 * len(got)
    assert neighbours.nearest(table.limit(0)).count() == 0 and neighbours.nearest(table.where("vec_id = 0")).count() == 0


def test_nearest_repeated_rows_and_widths(spark):
    rng = np.random.default_rng(4)
    x, short = rng.standard_normal((90, 6)), rng.standard_normal((25, 4))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(20, x[20].tolist())] * 2 + [(40, x[3].tolist()), (7, x[8].tolist())]
    rows += [(200 + i, v.tolist()) for i, v in enumerate(short)] + [(400, [1.0, 2.0, 3.0]), (600, [])]
    table = spark.createDataFrame([(i, v, i, 0.5, "c", i) for i, v in rows], "vec_id long, embedding array<double>, row long, score double, cell string, rank long")
    got = sorted(tuple(r) for r in neighbours.nearest(table, k=12, confidence=1 - 1e-9, cell_rows=30, block_rows=15, queries_at_once=3).collect())
    want = []
    for at, (q, v) in enumerate(rows):
        if q % 20 == 0:
            near = [(-float((np.array(w) * np.array(v)).sum()), i) for j, (i, w) in enumerate(rows) if j != at and len(w) == len(v) > 0]
            want += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(sorted(near)[:12])]
    want.sort()
    assert [r[:3] for r in got] == [r[:3] for r in want] and np.allclose([r[3] for r in got], [r[3] for r in want], rtol=0, atol=1e-12)
    assert Counter(r[0] for r in got)[20] == 36 and 400 not in {r[0] for r in got}


def test_stopping_test_decides():
    rng = np.random.default_rng(6)
    x = np.concatenate([c + 0.1 * rng.standard_normal((150, 24)) for c in rng.standard_normal((20, 24)) * 3])
    longest, ids = float((x * x).sum(axis=1).max()), np.arange(len(x))
    matrix = neighbours.projection(24)
    points = neighbours.lifted(x, longest) @ matrix
    own = ids[::20]
    scores = x[own] @ x.T
    scores[np.arange(len(own)), own] = -np.inf
    best = np.argsort(-scores, axis=1)[:, :10]
    share, recall = {}, {}
    for sure in (0.5, 0.95, 1 - 1e-12):
        block = neighbours.Block(ids, ids, x, points)
        who, found, _ = block.search(own, x[own], x[own] @ matrix[:24], np.full(len(own), np.inf), 10, longest, neighbours.chi_square_quantile(sure, neighbours.PROJECTIONS))
        share[sure] = block.verified / (len(own) * (len(x) - 1))
        recall[sure] = sum(len(set(found[who == i]) & set(best[i])) for i in range(len(own))) / best.size
    assert share[0.5] < share[0.95] < share[1 - 1e-12] and share[0.95] < 0.9
    assert recall[0.95] >= 0.95 and recall[1 - 1e-12] == 1


# --- sharding --------------------------------------------------------------------
def test_shards(spark):
    rng = random.Random(1)
    rows = EDGE[:7] + [(k, "the same text of a third of all rows") for k in range(1000, 1500)] + [(k, "t" * rng.randrange(1, 200) + str(k % 700)) for k in range(2000, 3000)]
    out = sharding.shard_by_size(docs(spark, rows), ranges_per_shard=8).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots, size = defaultdict(list), Counter()
    for r in out:
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
    assert set(slots) == set(range(8)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(size.values()) - min(size.values()) <= 0.05 * sum(size.values()) / 8 + 400
    assert sharding.shard_by_size(docs(spark, [])).count() == 0


# --- chat ------------------------------------------------------------------------
MESSAGE = "tree long, node long, parent long, role string, text string, score double"


def test_reply_trees(spark):
    rows = [
        (1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 5.0), (1, 4, 3, "user", "c", None), (1, 5, 2, "user", "d", 9.0),
        (2, 1, 77, None, None, None), (3, 1, 2, "user", "x", 1.0), (3, 2, 1, "user", "y", 1.0), (3, 3, 2, "user", "z", 1.0), (None, 1, None, "user", "x", 1.0),
    ] + [(9, k, k - 1 if k else None, "assistant" if k % 2 else "user", f"t{k} <b> \\l", 0.0) for k in range(70)]
    table = spark.createDataFrame(rows + rows[:2], MESSAGE)
    out = {(r.tree, r.leaf): r for r in chat.format_threads(table, best=2).withColumn("said", chat.read_turns(F.col("formatted"))).withColumn("on", chat.read_loss(F.col("formatted"), F.col("loss"))).collect()}
    assert set(out) == {(1, 4), (1, 5), (2, 1), (9, 69)}  # tree 3 is a circle, it has no root
    assert (out[1, 5].branch_rank, out[1, 4].branch_rank) == (1, 2) and abs(out[1, 5].branch_score - 10 / 3) < 1e-9
    assert [(t.role, t.text) for t in out[1, 5].said] == [("user", "q"), ("assistant", "a"), ("user", "d")] and out[1, 5].on == "a"
    assert [(t.role, t.text) for t in out[2, 1].said] == [("", "")]
    assert [t.text for t in out[9, 69].said] == [f"t{k} <b> \\l" for k in range(70)] and out[9, 69].on == "".join(f"t{k} <b> \\l" for k in range(1, 70, 2))
    assert chat.format_threads(table.limit(0)).count() == 0


def test_escape_round_trip(spark):
    texts = ["", "\\", "\\\\l", "</turn>\n<turn user>\n", "\\b\\l\\g<>", "a>b", "\\### Assistant: </turn> ok", "é😀"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.unescape(chat.escape(F.col("t"))).alias("back"), chat.escape(F.col("t")).alias("coded")).collect()
    assert all(r.t == r.back and "<" not in r.coded for r in rows)


# --- quality ---------------------------------------------------------------------
def test_quality(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for k in range(400):
        good = k % 4 != 0
        text = invented(rng, rng.randrange(20, 80))
        rows.append((k, text if good else text.upper().replace(" ", "!! ")))
        labels.append((k, int(good), 0))
    rows += [(1000, None), (1001, ""), (None, "x y"), (7, rows[7][1])]
    table = spark.createDataFrame(labels + [(5000, None, 0), (None, 1, 0), (1000, 3, 0)], "doc_id long, quality int, toxic int")
    out = quality.score_quality(docs(spark, rows).withColumn("score", F.lit("clash")), table).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    held = [r for r in out if r.doc_id is not None and r.doc_id < 400 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([r.predicted == int(r.doc_id % 4 != 0) for r in held]) > 0.95
    assert {r.predicted for r in quality.score_quality(docs(spark, rows), table.limit(0)).collect()} == {1}
    kept = quality.keep_good(docs(spark, rows), table)
    assert kept.columns == ["doc_id", "text", "lang"]


def test_ranking_is_fitted_on_all_pairs(spark):
    rng = np.random.default_rng(3)
    width, ridge = len(quality.FEATURES), 1e-3
    y = np.array([k % 3 > 0 for k in range(150)])
    x = rng.normal(size=(150, width)) * rng.uniform(0.1, 5, width) + y[:, None] * rng.normal(size=width) / 4
    x[:, 5] = 2.0  # a feature without variance
    rows = spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(y, x)], "y int, x array<double>").repartition(3)
    got = quality.fit_ranking(rows, 0.3)
    scale = x.std(0)
    scale[scale < 1e-9] = 1.0
    z = np.clip((x - x.mean(0)) / scale, -8, 8)
    diff = (z[y][:, None] - z[~y][None]).reshape(-1, width)
    w = np.zeros(width)
    for _ in range(30):
        p = 1 / (1 + np.exp(diff @ w))
        bend = (diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + ridge * np.eye(width)
        w = w + np.linalg.solve(bend, diff.T @ p / len(diff) - ridge * w)
    assert got.weights == pytest.approx(w, abs=1e-4) and np.abs(w).max() > 0.5
    order = np.argsort(z @ got.weights)
    reached = np.cumsum(np.where(y, 0.7 / y.sum(), 0.3 / (~y).sum())[order])
    k = int((reached <= 0.3 * (1 + 1e-9)).sum())
    assert got.cut == pytest.approx((z @ got.weights)[order[k - 1:k + 1]].mean())


def test_every_labelled_row_is_learnt_from(spark):
    n = 14_500
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 100 > 0).cast("int").alias("quality"))
    found, share = quality.labelled_rows(rows, labels, "doc_id", "text", "quality")
    want = Counter(int(i % 100 > 0) for i in range(n) if zlib.crc32(str(i).encode()) % 4 != 2)
    assert want[1] > 10_500 and {r.y: r["count"] for r in found.groupBy("y").count().collect()} == want and share == want[0] / sum(want.values())


@pytest.mark.parametrize("strengths,share,cut", [
    ([(0, 1.0), (1, 2.0)], 0.5, 1.5), ([(0, 1.0), (0, 1.0), (1, 1.0), (1, 3.0)], 0.5, 1.0), ([(0, 5.0), (1, 5.0)], 0.5, 5.0),
    ([(0, 1.0), (1, 1e9), (1, 2.0), (0, 1.0 + 1e-12)], 0.5, 1.5), ([(0, 4.0), (1, 1.0), (1, 2.0), (1, 3.0)], 0.01, 1.5), ([(0, 4.0), (1, 1.0)], 0.999, 2.5)])
def test_cut_is_the_quantile(spark, strengths, share, cut):
    assert quality.share_cut(spark.createDataFrame(strengths, "y int, s double"), share) == pytest.approx(cut)


def test_held_out(spark):
    got = spark.range(200).select("id", quality.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)


# --- licenses --------------------------------------------------------------------
def test_templates():
    made = licenses.compile_template("under the <<optional>>terms <<optional>>of<</optional>> <</optional>>mit license <<any 1-2>> end")
    run = lambda text: made.longest(text.split(), 0)
    assert run("under the mit license x end") == 6 and run("under the terms of mit license x y end z") == 9 and run("under the terms mit license x end") == 7
    assert run("under the of mit license x end") == run("under the mit license end") == run("under the mit license x y z end") == -1
    for wrong in ("<<optional>>a", "a<</optional>>", "<<any 1-2>> a", "", "a <<any 2-1>> b"):
        with pytest.raises(ValueError):
            licenses.Scanner({"x": wrong}, {})


def test_scan_licenses(spark):
    text = "Released under the MIT License.\nÉ licensed under the GNU General Public License, version 3. apache_license APACHE License"
    rows = [*EDGE, (20, text)]
    out = {r.doc_id: r for r in licenses.scan_licenses(docs(spark, rows)).collect()}
    assert (out[20].n_words, out[20].n_base, out[20].first_word, out[20].last_word) == (19, 4, 3, 17)
    assert (out[20].base_labels, out[20].labels, out[20].score) == ("apache,gpl,mit", "apache,gpl,gpl-3.0-notice,mit,mit-notice", 1.0)
    assert (out[1].n_words, out[1].first_word, out[1].labels, out[1].score) == (0, None, "", 0.0) and out[BIG].n_words == 30_000
    assert hashlib.md5(out[20].spans.encode()).hexdigest() and licenses.scan_licenses(docs(spark, [])).count() == 0


def test_dedup_lines_steps_are_compiled_and_unsorted(spark, monkeypatch):
    seen = {}

    def watched(df, name="table"):
        plan = df._jdf.queryExecution().executedPlan().toString()
        seen[name] = spark.conf.get(METHOD_CONF, None), "SortAggregate" in plan
        return settle(df, name)

    monkeypatch.setattr(lines, "settle", watched)
    before = spark.conf.get(METHOD_CONF, None)
    line = "the same line stands in both of these documents"
    rows = [(2, f"{line}\nsecond text of its own"), (1, f"a first line of its own\nand one more line of it\n{line}"), (2, f"{line}\nanother text of this id")]
    out = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    # the least id and the least line number of the repeated line belong to different rows
    got = {(r.doc_id, r.text, r.n_exact) for r in out.collect()}
    assert got == {(2, "second text of its own", 1), (2, "another text of this id", 1), (1, rows[1][1], 0)}
    assert seen["line-keys"][0] == COMPILED_BYTES and not any(sorts for name, (_, sorts) in seen.items() if name in ("line-held", "line-known"))
    assert spark.conf.get(METHOD_CONF, None) == before
