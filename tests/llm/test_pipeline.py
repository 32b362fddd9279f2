"""The pipeline, stage by stage, against brute force."""

import corpus_pipeline
from lumengraph.llm import pieces, queries, secrets
from tests.llm.test_llm import SF, linked, plain, slow_fingerprint, slow_spans


def test_stages_in_order(spark):
    docs = queries.table(spark, SF, "documents")
    rows = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        rows[name] = docs
    assert list(rows)[1:] == ["language", "near_duplicates", "decontamination", "secrets", "pieces"]
    for name in list(rows)[1:-1]:
        assert rows[name].columns == rows["documents"].columns
    start = {r.doc_id: r.text for r in rows["documents"].collect()}
    spoken = {r.doc_id: r.text for r in rows["language"].collect()}
    assert len(spoken) > 0.98 * len(start) and spoken.items() <= start.items()
    one = {r.doc_id: r.text for r in rows["near_duplicates"].collect()}
    group = linked({i: slow_fingerprint(t) for i, t in spoken.items()})
    assert one == {i: t for i, t in spoken.items() if group[i] == i}
    items = [plain(r.text) for r in queries.table(spark, SF, "benchmark").collect()]
    clean = {r.doc_id: r.text for r in rows["decontamination"].collect()}
    assert clean == {i: t for i, t in one.items() if not any(x in plain(t) for x in items)}
    safe = {r.doc_id: (r.text, r.n_chars) for r in rows["secrets"].collect()}
    rules = secrets.BASE + secrets.MORE
    assert set(safe) == set(clean) and all(n == len(t) and not slow_spans(t, rules) for t, n in safe.values())
    assert all(safe[i][0] == t for i, t in clean.items() if not slow_spans(t, rules))
    model = pieces.load(spark, queries.TOKENIZER)
    back = {r.doc_id: r.text for r in pieces.decode(rows["pieces"], model, ["doc_id"]).collect()}
    assert back == {i: t for i, (t, _) in safe.items()}


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_words", "n_pieces", "ids"] and out.count() > 0
