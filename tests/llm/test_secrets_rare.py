from cases import frame, words
from pyspark.sql import functions as F

from proofweave.llm import common, secrets


def test_rare_secrets_among_many_documents_are_learnt_and_found(spark):
    plain = F.concat(F.lit("ordinaryrunningwords number "), F.col("id").cast("string"))
    text = F.when(F.col("id") % 3000 == 7, F.concat(F.lit("the token=a1b2c3d4e5f6g7h8 of "), F.col("id").cast("string"))).otherwise(plain)
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("src").alias("source"))
    findings = secrets.labelled_findings(docs)
    rare = docs.where("doc_id % 3000 = 7")
    want = rare.where(common.fold(F.col("doc_id"), 3) != 1).count()
    assert findings.where("label = 1").count() == want > 8
    assert secrets.scan(docs, secrets.train(findings)).count() == rare.count() == 20


def test_without_findings_the_form_decides(spark):
    forest = secrets.train(secrets.labelled_findings(frame(spark, [(k, "no one here") for k in range(5)])))
    assert forest is None
    docs = frame(spark, [(1, f"{words(5, 1)} token=a1b2c3d4e5f6"), (2, words(9, 2))])
    assert [r.doc_id for r in secrets.scan(docs, forest).collect()] == [1]
