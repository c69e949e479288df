"""The pipeline on planted cases, each stage against what it has to keep and drop."""

import os
import random

import corpus_pipeline
from tests.llm.test_corpus_operators import brute_groups, invented
from voxrisk.llm import lines, minhash, packing, quality
from voxrisk.session import scratch_tables, settle, settle_last, shared_dir


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)
    items = [(k, invented(rng, 25) + ".\nAnswer " + invented(rng, 8)) for k in range(6)]
    texts, labels, kind = [], [], {}

    def add(text, what, label=None):
        kind[len(texts)] = what
        if label is not None:
            labels.append((len(texts), label, 0))
        texts.append(text)

    for k in range(120):
        body = "\n".join(invented(rng, 12) for _ in range(rng.randrange(2, 6)))
        add(body if k % 6 else "Read more on the next page.\n" + body, "clean", 1)
    for _ in range(40):
        add(invented(rng, 40).upper().replace(" ", "!! "), "junk", 0)
    for k in range(20):
        if k % 2:
            add(texts[k], "copy")
        else:
            words = texts[k].split(" ")
            words[len(words) // 2] = "changed"
            add(" ".join(words), "copy")
    for k in range(6):
        add(invented(rng, 60) + " " + items[k][1] + " " + invented(rng, 60), "leak")
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, t, "en", "s0", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, str(tmp_path))
        seen.append(name)
        if name == "packing":
            break
        assert out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = {r.doc_id: r.text for r in docs.collect()}
        gone = set(before) - set(after)
        if name == "quality_classifier":
            assert {kind[i] for i in gone} == {"junk"} and not any(kind[i] == "junk" for i in after)
        elif name == "line_dedup":
            assert not gone and sum("next page" in t for t in after.values()) < sum("next page" in t for t in before.values())
        elif name == "near_dedup":
            assert gone == {i for i, (_, least) in brute_groups(before.items(), 5).items() if least != i}
        else:
            assert gone == {i for i in before if kind[i] == "leak"}
    assert seen == ["quality_classifier", "line_dedup", "near_dedup", "decontamination", "packing"]
    pieces, left = out.collect(), {r.doc_id: r.text for r in docs.collect()}
    assert {i for i, what in kind.items() if what == "clean"} <= {r.doc_id for r in pieces} == set(left)
    for i, text in left.items():
        assert sum(r.length for r in pieces if r.doc_id == i) == len(packing.token_ids(text, "byte_bpe_50k")) + 1
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(pieces)


def tables(spark):
    folder = f"{shared_dir(spark)}/voxrisk"
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_steps_leave_only_what_their_results_read(spark):
    rng = random.Random(5)
    texts = ["\n".join(invented(rng, 12) for _ in range(4)) for _ in range(30)]
    texts += [t.replace(" ", "  ", 1) for t in texts[:5]] + [t + "x" for t in texts[5:10]] + [texts[0].split("\n")[0] + "\n" + invented(rng, 30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(texts))], "doc_id long, quality int")
    for step, allowed in (
        (lambda: lines.drop_repeated_lines(docs), {"line-decisions", "bitmap"}), (lambda: minhash.near_duplicates(docs), {"near-prepared", "near-named"}),
        (lambda: minhash.drop_near_duplicates(docs), {"near-gone", "bitmap"}), (lambda: quality.keep_good(docs, labels), set()),
    ):
        before = tables(spark)
        out = step()
        assert {name.rsplit("-", 1)[0] for name in tables(spark) - before} == allowed
        assert out.count() > 0  # what the result still reads is there


def test_settled_tables_belong_to_the_scope_that_reads_them(spark):
    before, rows = tables(spark), spark.range(5)
    with scratch_tables(spark):
        inner = settle_last(spark, lambda: settle(settle(rows, "first").where("id > 0"), "second"), "third")
        assert {name.rsplit("-", 1)[0] for name in tables(spark) - before} == {"third"} and inner.count() == 4
    assert tables(spark) == before
    kept = settle(rows, "kept")
    assert kept.count() == 5 and len(tables(spark) - before) == 1
