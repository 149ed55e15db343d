"""The pipeline's stages against plain versions of their decisions."""

import hashlib
import sys
from pathlib import Path

import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline
from lexloom.llm import decontaminate, simhash, toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LEAK = " ".join(f"bench{k}" for k in range(12))


def corpus():
    base = " ".join(f"word{k}" for k in range(40))
    texts = {0: base, 1: base, 2: base + " tail", 3: f"intro text {LEAK} outro", 4: "you idiot " * 5, 5: None, 6: "another clean document of its own", 7: ""}
    for i in range(20, 60):
        texts[i] = f"document number {i} has words{i} of{i} its{i} own{i} here{i}" + (" idiot scum idiot" if i % 5 == 0 else "")
    return texts


def written(spark, path, rows, schema=DOCS, labels=None, bench=((1, LEAK),)):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(bench), "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(i, 1, int(i % 5 == 0)) for i in range(20, 60)] if labels is None else labels
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def plain(rows, lexicon, bench):
    """(doc_id, text) rows that the stages must keep; rows are (doc_id, text, ...)."""
    kept = [r for r in rows if lexicon.score(r[1]) < 0.5]
    prints = [simhash.fingerprint(r[1].encode() if r[1] else None) % (1 << 64) for r in kept]
    low = list(range(len(kept)))
    for _ in kept:
        for i in range(len(kept)):
            low[i] = min(low[j] for j in range(len(kept)) if (prints[i] ^ prints[j]).bit_count() <= 3)
    groups = {}
    for r, g, fp in zip(kept, low, prints):
        signed = fp - (1 << 64) if fp >> 63 else fp
        groups.setdefault(g, []).append((r[0] is None, r[0] or 0, signed, r))
    firsts = [min(g, key=lambda x: x[:3])[3] for g in groups.values()]
    hit = {k for k, (_, _, n, *_) in enumerate(decontaminate.brute([(k, r[1]) for k, r in enumerate(firsts)], bench)) if n}
    return [r for k, r in enumerate(firsts) if k not in hit]


def test_stages_take_effect(spark, tmp_path):
    texts = corpus()
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    path = written(spark, tmp_path, rows)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, path).collect()}
    lexicon = toxicity.train(spark, path)
    kept = dict((r[0], r[1]) for r in plain(rows, lexicon, [(1, LEAK)]))
    assert not {1, 2, 3, 4, 20, 25} & set(kept) and {0, 6} <= set(kept)
    assert set(got) == set(kept)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, text in kept.items():
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert list(got[i].ids) == ids and got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_repeated_ids_nulls_and_clashing_columns(spark, tmp_path):
    texts = corpus()
    rows = [(i, t, "en", "s", 1, 0.5, 7, "y") for i, t in texts.items()]
    rows += [(0, "a text that shares an id and nothing else with the rest", "en", "s", 1, 0.5, 7, "y"), (0, texts[0], "en", "s", 1, 0.5, 7, "y"), (None, texts[0], "en", "s", 1, 0.5, 7, "y"), (None, "no id but words of its own", None, None, None, None, None, None)]
    schema = DOCS + ", score double, id bigint, `a.row b` string"
    path = written(spark, tmp_path, rows, schema)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.schema.names == ["doc_id", "text", "lang", "source", "n_chars", "score", "id", "a.row b"]
    want = plain(rows, toxicity.train(spark, path), [(1, LEAK)])
    assert sorted((str(r[0]), str(r[1])) for r in docs.collect()) == sorted((str(r[0]), str(r[1])) for r in want)
    ids = sorted(str(r.doc_id) for r in corpus_pipeline.token_ids(spark, docs, path).collect())
    assert ids == sorted(str(r[0]) for r in want) and ids.count("0") == 2 and "None" in ids


@pytest.mark.parametrize("empty", ["documents", "all"])
def test_empty_tables(spark, tmp_path, empty):
    path = written(spark, tmp_path, [], labels=[] if empty == "all" else None, bench=[] if empty == "all" else ((1, LEAK),))
    assert corpus_pipeline.run(spark, path).collect() == []


def test_without_labels_and_benchmark_clean_documents_stay(spark, tmp_path):
    path = written(spark, tmp_path, [(1, "clean words here", "en", "s", 1), (2, "you idiot", "en", "s", 1), (3, LEAK, "en", "s", 1)], labels=[], bench=[])
    assert {r.doc_id for r in corpus_pipeline.run(spark, path).collect()} == {1, 3}


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_dedup", "decontaminate", "bpe"]


def test_toxicity_sends_each_text_to_python_once_and_rows_not_at_all(spark):
    rows = [(i, f"clean text {i} " * 200 + "idiot " * 400 * (i % 4 == 0), "en", "s" * 3000, i) for i in range(400)] + [(7, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    kept = toxicity.drop_toxic(docs, toxicity.Lexicon({" idiot ": 3.0}))
    frame = kept._jdf.queryExecution()
    frame.toRdd().count()
    nodes, sent = [frame.executedPlan()], []
    while nodes:
        node = nodes.pop()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
        nodes += [node.executedPlan()] if "AdaptiveSparkPlan" in node.nodeName() else []
        nodes += [node.plan()] if "QueryStage" in node.nodeName() else []
        if node.metrics().contains("pythonDataSent"):
            sent.append(node.metrics().apply("pythonDataSent").value())
    texts = sum(len(r[1] or "") for r in rows)
    assert len(sent) == 1 and texts < sent[0] < 1.2 * texts
    assert kept.schema == docs.schema
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in docs.collect() if r.doc_id % 4 or r.text is None)


def test_workers_give_the_encoder_back_after_the_job(spark):
    from lexloom.llm import bpe

    def held(batches):
        import pyarrow as pa

        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([len(bpe._coders)])], ["n"])

    docs = spark.createDataFrame([(i, f"words of {i}") for i in range(64)], "doc_id bigint, text string").repartition(8)
    assert bpe.encode(docs).where("n_tokens > 0").count() == 64
    other = spark.sparkContext.broadcast("what another job needs")
    counts = spark.range(64).repartition(8).mapInArrow(lambda batches: held(batches) if other.value else None, "n bigint").collect()
    assert len(counts) == 8 and {r.n for r in counts} == {0}
