import corpus_pipeline
from fleetlens.llm import queries
from fleetlens.llm.workspace import Workspace


def test_stages_follow_each_other(llm, sf):
    docs = queries.table(llm, sf, "documents")
    ws, before = Workspace(llm, "test"), docs
    ids = {r["doc_id"] for r in docs.collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "byte_bpe"]
    for name, stage in corpus_pipeline.STAGES:
        after = ws.store(stage(llm, before, sf), name)
        now = {r["doc_id"] for r in after.select("doc_id").collect()}
        assert now <= ids and after.count() == len(now) and len(now) > 0.5 * len(ids)
        if name != "byte_bpe":
            assert dict(after.dtypes) == dict(docs.dtypes) and after.columns == docs.columns
        else:
            texts = {r["doc_id"]: r["text"] for r in before.collect()}
            bpe = queries.byte_bpe.encoder(queries.RANKS, queries.PATTERN)
            assert {r["doc_id"]: bytes(r["ids"]) for r in after.collect()} == {i: bpe.encode(t) for i, t in texts.items()}
        before, ids = after, now
