"""What a worker process keeps for one step is gone in the next."""

import public_tokenizers
from pyspark.sql import functions as F

from stratakb import runtime
from stratakb.llm import langid, linededup, packing


def test_only_the_latest_is_kept():
    built = []

    def build(x):
        built.append(x)
        return x

    assert runtime.worker_cache(("encoder", 1), lambda: build("a")) == "a"
    assert runtime.worker_cache(("encoder", 1), lambda: build("again")) == "a"
    assert runtime.worker_cache(("automaton", 1), lambda: build("b")) == "b"
    assert list(runtime._worker_store()) == ["automaton"]
    runtime.worker_clear()
    assert not runtime._worker_store() and built == ["a", "b"]


def test_steps_without_a_model_let_go_of_it(spark):
    """Each step's own column and a look at the worker's cache, by one process: udfs of one kind are evaluated together."""

    @F.pandas_udf("int")
    def fill(x):
        runtime.worker_cache(("encoder", "x"), lambda: packing.Encoder(public_tokenizers.path("word_bpe_49k.json")))
        return x * 0 + len(runtime._worker_store())

    @F.pandas_udf("int")
    def kept(x):
        return x * 0 + len(runtime._worker_store())

    def left(step):
        """Workers that still keep something after as many rounds of a step as reach all of them."""
        one = spark.range(0, 400, 1, 40)
        assert {r.n for r in one.select(fill(F.col("id").cast("int")).alias("n")).collect()} == {1}
        docs = spark.range(0, 400, 1, 40).select(F.col("id").alias("doc_id"), F.lit("one line of words\nand another").alias("text"))
        step(docs)
        return sum(r.n for r in one.select(kept(F.col("id").cast("int")).alias("n")).collect())

    model = langid.fit([("en", "the house and the garden"), ("de", "das Haus und der Garten")])
    assert left(lambda docs: langid.identify(docs, model).collect()) == 0

    def lines(docs):
        many = docs.withColumn("text", F.concat("text", F.col("doc_id").cast("string")))
        linededup.classes(linededup.lines(many).repartition(40, "k1", "k2")).collect()

    assert left(lines) == 0
