import hashlib

import sentencepiece
from test_dedup import WHITE, roots, similar_pairs
from test_texts import naive_contamination

import corpus_pipeline
from ebbgraph.llm import quality
from ebbgraph.llm.common import DOCUMENT_COLUMNS, store
from ebbgraph.llm.queries import TOKENIZER

SF = "/root/testdata/sf0.001"


def kept_ids(frame):
    return sorted(r.doc_id for r in frame.select("doc_id").collect())


def test_stages_equal_brute_force(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "exact dedup", "SimHash near-dedup", "benchmark decontamination", "SentencePiece encoding and decoding",
    ]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rated = quality.rate(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("kept")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    library = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text or "" for r in docs.collect()}
        out = store(stage(spark, docs, SF))
        if k < 4:
            assert tuple(out.columns) == DOCUMENT_COLUMNS and out.dtypes == docs.dtypes
        if k == 0:
            want = kept_ids(rated)
            assert 0 < len(want) < len(before)
        elif k == 1:
            groups = {}
            for i, t in before.items():
                groups.setdefault(t.translate(WHITE), []).append((-len(t), i))
            want = sorted(min(g)[1] for g in groups.values())
            assert len(want) < len(before)
        elif k == 2:
            ids = sorted(before)
            links = similar_pairs([before[i] for i in ids])
            want = sorted({ids[r] for r in roots(len(ids), links)})
            assert len(want) < len(before)
        elif k == 3:
            want = [i for i in sorted(before) if not naive_contamination(before[i], items)[3]]
            assert len(want) < len(before)
        else:
            want = sorted(before)
            for r in out.collect():
                assert r.ids == library.encode(before[r.doc_id], num_threads=1)
                assert r.decoded_sha256 == hashlib.sha256(before[r.doc_id].encode()).hexdigest()
        assert kept_ids(out) == want
        docs = out
    assert kept_ids(corpus_pipeline.run(spark, SF)) == want


def test_stages_with_odd_rows(spark):
    long = "word and more words here " * 4000
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, long, None, "s", 9), (3, long + " ", "en", None, 9), (None, "a fine text", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), SF).count() == 0
    for _, stage in corpus_pipeline.STAGES:
        docs = store(stage(spark, docs, SF))
    assert docs.count() in (2, 3)
    assert corpus_pipeline.ORACLE_SQL is None
