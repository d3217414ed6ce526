"""Registered queries of this subpackage and, where SQL can state them, their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import alignment, common, conversations, decontam, packing, passages, ppm, quality, rans, secrets, simhash, suffix, topk, urls

#: rules of the registered URL query: (verdict, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_attention_quality(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, common.table(spark, sf_dir, "labels"))
    held = F.coalesce(common.fold(F.col("doc_id"), 3) == 1, F.lit(False))
    return quality.with_scores(docs, model, "score").select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_harmonic_packing(spark, sf_dir):
    return packing.pack(common.table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), end_id=1, with_ids=False)


def op3_impact_topk(spark, sf_dir):
    return topk.top_k(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op4_ppm_scores(spark, sf_dir):
    trains = F.coalesce(common.fold(F.col("doc_id"), 7) != 2, F.lit(True))
    return ppm.score_documents(common.table(spark, sf_dir, "documents"), trains)


def op5_rans_files(spark, sf_dir):
    path = common.scratch(spark, "rans")
    rans.write(common.table(spark, sf_dir, "documents"), path, _tokenizer("word_bpe_49k.json"), end_id=2, vocabulary=49_408)
    return rans.read(spark, path, with_ids=False)


def op6_simhash(spark, sf_dir):
    found = simhash.near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


def op7_suffix_dedup(spark, sf_dir):
    return suffix.without_repeats(common.table(spark, sf_dir, "documents"), with_bytes=False)


def op8_secret_forest(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train(secrets.labelled_findings(docs)))


def op9_url_propagation(spark, sf_dir):
    return urls.judged(common.table(spark, sf_dir, "pages"), RULES)


def op10_string_tiling(spark, sf_dir):
    found = decontam.leaked_items(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "matched_words", "item_words", "coverage", F.size("tiles").alias("n_tiles"))


def op11_auction_repair(spark, sf_dir):
    return conversations.repairs(conversations.damaged(common.table(spark, sf_dir, "conversations")))


def op12_merge_path_alignment(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    return alignment.aligned(docs, _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"), with_groups=False)


def op13_seed_extend_dedup(spark, sf_dir):
    return passages.without_repeats(common.table(spark, sf_dir, "documents"), with_text=False)


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_attention_quality, op2_harmonic_packing, op3_impact_topk, op4_ppm_scores, op5_rans_files, op6_simhash, op7_suffix_dedup, op8_secret_forest, op9_url_propagation, op10_string_tiling, op11_auction_repair, op12_merge_path_alignment, op13_seed_extend_dedup, pipeline)
}

ORACLES = {
    "op3_impact_topk": """
        WITH w AS (
          SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(CAST(c AS DOUBLE) * 256) AS DOUBLE)) AS v FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
        s AS (
          SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
          FROM w q JOIN w c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op9_url_propagation": urls.oracle(RULES),
}
