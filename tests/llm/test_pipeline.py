import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from quern.llm import common, decontam, minhash, queries, toxicity
from tests.conftest import SF, frame
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_minhash import brute_components

CONTRACT = {
    "op1_secret_scan": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op2_fingerprints": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    "op3_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op5_katz_lm": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op8_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op9_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op10_rans": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
}


def test_contract(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert sorted(int(q[2:].split("_")[0]) for q in queries.queries()) == list(range(1, 11))
    for name, columns in CONTRACT.items():
        df = queries.queries()[name](spark, SF)
        assert columns.items() <= dict(df.dtypes).items(), name
        assert df.count() == n


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["toxicity", "line_dedup", "minhash", "decontamination", "bpe"]
    rows = lambda df: sorted((r["doc_id"], r["text"]) for r in df.collect())

    kept = common.cut(steps["toxicity"](spark, docs, SF), "t1")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert kept.schema == docs.schema
    assert rows(kept) == [(i, t) for i, t in rows(docs) if model.document(t)[0] < 0.5]

    lines = common.cut(steps["line_dedup"](spark, kept, SF), "t2")
    assert lines.columns == docs.columns
    assert rows(lines) == sorted(brute_lines(rows(kept)).items())
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())

    single = common.cut(steps["minhash"](spark, lines, SF), "t3")
    assert single.columns == docs.columns
    assert {i for i, _ in rows(single)} == {c for _, c in brute_components(rows(lines))}

    clean = common.cut(steps["decontamination"](spark, single, SF), "t4")
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert clean.columns == docs.columns
    assert rows(clean) == [(i, t) for i, t in rows(single) if not any(" ".join(decontam.words_of(q)) in " ".join(decontam.words_of(t)) for q in items)]

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = steps["bpe"](spark, clean, SF)
    assert {r["doc_id"]: r["n_tokens"] for r in out.collect()} == {i: len(tokenizer.encode(t).ids) for i, t in rows(clean)}


def test_stages_take_edges(spark):
    rows = [(1, None, None, None, None), (None, "", "en", "s", 0), (2, "a\nb\nc", None, "s", 5), (2, "a\nb\nc", None, "s", 5), (3, "x " * 3000, "en", None, 6000)]
    docs = common.cut(frame(spark, rows, "doc_id long, text string, lang string, source string, n_chars long"), "edges")
    for step, (_, f) in enumerate(corpus_pipeline.STAGES):
        out = f(spark, docs, SF)
        if step < 4:
            assert out.columns == docs.columns
        docs = common.cut(out, "edges")
    assert docs.count() == 3  # the null and the empty text are one class, and so are the repeated rows
    empty = frame(spark, [], "doc_id long, text string, lang string, source string, n_chars long")
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, empty, SF).count() == 0


def test_minhash_query_has_a_row_for_each_document(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {r["doc_id"]: r["class_id"] for r in minhash.classes(docs).collect()}
    assert sorted(out.items()) == brute_components(sorted((r["doc_id"], r["text"]) for r in docs.collect()))
