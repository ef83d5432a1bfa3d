import hashlib

import pytest

import corpus_pipeline
from lectern.llm import pieces, queries, toxicity
from lectern.llm.exact_dedup import without_blanks
from lectern.sources.tables import Scratch
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


def test_stages_and_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "exact dedup", "n-gram Jaccard join", "mixing sources to target weights",
        "SentencePiece encoding and decoding"]
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)} | {"pipeline"}


def test_each_stage_against_its_own_rule(spark):
    from test_ngram_join import brute

    scratch = Scratch(spark, "pipeline-test")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    given, kept = docs, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        given = scratch.keep(stage(spark, given, FOLDER), f"s{i}")
        kept.append(given)
        if i < 4:
            assert given.columns == docs.columns
    ids = [sorted(r["doc_id"] for r in k.select("doc_id").collect()) for k in kept]
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    told = toxicity.toxicity(docs, labels).filter("predicted = 0").collect()
    assert ids[0] == sorted(r["doc_id"] for r in told)
    best = {}
    for r in kept[0].select("doc_id", "text", without_blanks(F.col("text")).alias("b")).collect():
        best.setdefault(r["b"], []).append((-len(r["text"]), r["doc_id"]))
    assert ids[1] == sorted(min(m)[1] for m in best.values())
    rows = [(r["doc_id"], r["text"]) for r in kept[1].orderBy("doc_id").collect()]
    assert ids[2] == [i for i, c, _ in brute(rows) if i == c]
    assert ids[3] == ids[2] == ids[4]
    model = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=pieces.tokenizer_file("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] for r in kept[3].collect()}
    for r in kept[4].collect():
        found = model.encode(texts[r["doc_id"]])
        assert r["n_tokens"] == len(found)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, found)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(model.decode(found).encode()).hexdigest()


def test_whole_run_equals_its_stages(spark):
    assert corpus_pipeline.run(spark, FOLDER).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_result_keeps_the_mixture_order(spark, documents, tmp_path, monkeypatch):
    pytest.importorskip("sentencepiece")
    from lectern.llm import mixing

    monkeypatch.setattr(corpus_pipeline, "PART_ROWS", 70, raising=False)
    rows = [(i, f"row {i} " * (1 + i * i % 40), f"s{i % 3 % 2}") for i in range(400)]
    mixed = mixing.mix_sources(documents(rows), {"s0": 3, "s1": 1}, block_bytes=2_000)
    want = [r["doc_id"] for r in mixed.orderBy("mix.slot", "mix.start").select("doc_id").collect()]
    mixing.in_order(mixed, 16 * 1024 * 1024).write.parquet(f"{tmp_path}/mix")  # four slots a file
    docs = spark.read.parquet(f"{tmp_path}/mix")
    assert len(docs.inputFiles()) > 5
    got = corpus_pipeline.encode(spark, docs, FOLDER)
    assert [r["doc_id"] for r in got.collect()] == want
    got.write.parquet(f"{tmp_path}/out")
    again = spark.read.parquet(f"{tmp_path}/out").orderBy("_metadata.file_name", "_metadata.row_index")
    assert [r["doc_id"] for r in again.select("doc_id").collect()] == want


def test_exact_dedup_equals_its_sql(spark):
    import compare

    con = compare.duck(FOLDER)
    assert compare.compare(spark, con, FOLDER, "op3_exact_dedup").startswith("ok")


@pytest.mark.parametrize("name", ["op1_embedding_dedup", "op5_secrets", "op7_line_dedup", "op8_ngram_join"])
def test_pairs_and_spans_equal_their_sql(spark, name):
    import compare

    assert compare.compare(spark, compare.duck(FOLDER), FOLDER, name).startswith("ok")


def test_runs_side_by_side_keep_their_tables(spark):
    """A stage called while another pipeline's result is still to be written leaves that one's tables alone."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    first = corpus_pipeline.drop_exact_copies(spark, docs, FOLDER)
    assert corpus_pipeline.drop_exact_copies(spark, docs, FOLDER).count() == first.count() > 0
