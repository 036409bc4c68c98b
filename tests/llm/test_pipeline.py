import public_tokenizers
import pyarrow.parquet as pq
import sentencepiece
from test_decontaminate import brute as items_in
from test_near_dup import brute as groups

import corpus_pipeline
from foliant.llm import queries, store

DATA = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = spark.createDataFrame([(900_001, None, "en", "s", 0), (900_002, "12 34", "en", "s", 5), (900_003, "", "en", "s", 0)], docs.schema)
    now = docs.unionByName(extra)
    tox, lang = queries.toxicity_model(spark, DATA), queries.language_model(spark, DATA)
    bench = [(r["item_id"], r["text"]) for r in pq.read_table(f"{DATA}/benchmark.parquet").to_pylist()]
    for name, stage in corpus_pipeline.STAGES:
        rows = {r.doc_id: r.text for r in now.collect()}
        out = stage(spark, now, DATA)
        got = {r.doc_id for r in out.collect()}
        encoded = {k: (t or "").encode() for k, t in rows.items()}
        if name == "language":
            said = {k: lang.predict([t]) for k, t in encoded.items()}
            want = {k for k, (name_, _, unsure) in said.items() if name_ != ["und"] and not unsure[0]}
            assert not got & {900_001, 900_002, 900_003}
        elif name == "toxicity":
            want = {k for k, t in encoded.items() if tox.scores([t])[0] < 0.7}
        elif name == "near_duplicates":
            want = {k for k, v in groups(sorted(rows.items())).items() if v[2]}
        elif name == "decontamination":
            want = {k for k, v in items_in(list(rows.items()), bench).items() if not v[2]}
        else:
            want = set(rows)
            library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
            assert all(r.piece_ids == library.encode(rows[r.doc_id]) and r.round_trip for r in out.collect())
        assert got == want and len(got) == out.count()
        if name != "sentencepiece":
            assert out.columns == docs.columns
        now = out


def test_run_and_empty(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "shared_dir", lambda s: f"file://{tmp_path}/shared")
    out = corpus_pipeline.run(spark, DATA)
    left = [p for p in (tmp_path / "shared").glob("*/*") if not p.name.startswith(".")]
    assert [p.parent.name.rsplit("-", 1)[0] for p in left] == ["pipeline"]  # the result alone
    assert out.columns == ["doc_id", "piece_ids", "n_pieces", "round_trip"] and out.count() > 100
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
