"""What reaches the driver while fitting does not grow with repeated rows."""
from pyspark.sql import functions as F

from seqforge.llm import langid, toxicity


def test_copies_are_one_row_of_the_language_sample(spark, monkeypatch):
    got = []
    kind = type(spark.range(0))
    real = kind.toArrow
    monkeypatch.setattr(kind, "toArrow", lambda self: got.append(real(self)) or got[-1])
    rows = spark.range(20_000).select(F.lit("the same words again and again").alias("text"), F.lit("en").alias("lang"))
    some = spark.createDataFrame([(f"ein anderer satz nummer {i}", "de") for i in range(50)], "text string, lang string")
    model = langid.fit(rows.unionByName(some), 20_000)
    assert sum(t.num_rows for t in got) in (50, 51) and model.langs == ["de", "en"]


def test_repeated_ids_are_one_text_of_the_toxicity_sample(spark, monkeypatch):
    got = []
    real = toxicity._curve
    monkeypatch.setattr(toxicity, "_curve", lambda x, y: got.append(len(y)) or real(x, y))
    docs = spark.range(4000).select((F.col("id") % 40).alias("doc_id"), F.concat(F.lit("vile grubnok text "), F.col("id").cast("string")).alias("text"))
    labels = spark.range(40).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    toxicity.learn(docs, labels)
    assert sum(got) <= 40
