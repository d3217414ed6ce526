import corpus_pipeline
from cases import SF, frame, odd_rows
from test_copies import plain_kept

from proofweave.llm import decontam, quality, secrets


def test_each_stage_does_its_work_on_what_is_left(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    from proofweave.session import cut

    left = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, out = left, cut(stage(spark, left, SF))
        ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
        if k < 4:
            assert out.columns == columns and ids(out) <= ids(before)
        if k == 0:
            model = quality.train(before, spark.read.parquet(f"{SF}/labels.parquet"))
            assert ids(out) == {r.doc_id for r in quality.with_scores(before, model, "s").where("s >= 0.5").collect()} and 0 < out.count() < before.count()
        elif k == 1:
            # near copies: five-word shingles, Jaccard similarity of 0.8 or more
            assert sorted(r.doc_id for r in out.collect()) == plain_kept([(r.doc_id, r.text) for r in before.collect()])
        elif k == 2:
            leaked = ids(decontam.leaked_items(before, spark.read.parquet(f"{SF}/benchmark.parquet")))
            assert ids(out) == ids(before) - leaked
        elif k == 3:
            assert ids(out) == ids(before)
            old = {r.doc_id: r.text for r in before.collect()}
            for r in out.collect():
                named = [f for _, f, b, _ in secrets.candidates(old[r.doc_id]) if secrets.label_by_form(f, b)]
                assert (r.text == old[r.doc_id]) == (not named) and not any(f in r.text for f in named)
        else:
            total = {}
            for r in out.select("doc_id", "length", "doc_tokens").collect():
                n, want = total.get(r.doc_id, (0, r.doc_tokens))
                total[r.doc_id] = (n + r.length, want)
            assert total.keys() == ids(before) and all(n == want for n, want in total.values())
        left = out


def test_odd_rows_pass_all_stages(spark):
    for rows in (odd_rows(), []):
        docs = frame(spark, rows, extra=True)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        assert docs.count() >= 0
