"""The word cache of the tokenizer: bounded in bytes, without effect on the ids, and gone after a task."""

import random

import pyarrow as pa
from pyspark.sql import types as T

from semspace.llm import packing, separators, tokens


def test_forgotten_words_are_encoded_again(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_BYTES", 20_000, raising=False)
    monkeypatch.setattr(tokens, "TAKE_BYTES", 2_000)
    draw = random.Random(5)
    pool = ["The", "the,", "fox?!", "né,", "ΣΑΣ.", "a-b", "x" * 900, "...", "12,", "<|endoftext|>", "naïve;"]
    texts = [" ".join(draw.choice(pool) if draw.random() < 0.5 else f"w{draw.randrange(4000)}{draw.choice(['', ',', '?!'])}"
                      for _ in range(draw.randrange(60))) for _ in range(300)]
    encoder, got, sizes = tokens.WordEncoder(tokens.default_path(), False), [], []
    for _, ids, offsets in encoder.rows(pa.array(texts)):
        got += [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        sizes.append(len(encoder.codes))
    assert got == [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert max(sizes) < 500  # of some 4,000 words


def test_a_worker_keeps_no_words_after_a_task(spark):
    path = tokens.default_path()
    docs = spark.createDataFrame([(i, f"some words, {i}", "s") for i in range(40)], "doc_id long, text string, source string")
    packing.encoded(docs, path, packing.SEPARATOR, "source", {"s": 0}).collect()

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(e.codes) for e in tokens._encoders.values()], pa.int32())], ["n"])

    rows = spark.range(64).repartition(16).mapInArrow(held, T.StructType([T.StructField("n", T.IntegerType())])).collect()
    assert rows and all(row.n == 0 for row in rows)


def test_the_separator_scan_keeps_no_words_after_a_task(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"some words, {i}") for i in range(40)], "doc_id long, text string")
    separators.write_flat(docs, str(tmp_path), tokens.default_path()).collect()

    def held(batches):
        for batch in batches:
            words = [len(e.codes) for (_, literal), e in tokens._encoders.items() if literal]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.int32())], ["n"])

    rows = spark.range(64).repartition(16).mapInArrow(held, T.StructType([T.StructField("n", T.IntegerType())])).collect()
    assert rows and all(row.n == 0 for row in rows)
