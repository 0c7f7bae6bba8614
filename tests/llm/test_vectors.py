"""Word vectors are of all documents."""

import numpy as np

from opsloom.llm import bytewords, quality


def test_words_of_unlabelled_documents_have_vectors(spark):
    words = [f"rare{k}" for k in range(200)]
    rows = [(i, f"plain text number {i} of some words") for i in range(1, 20)] + [(100 + i, " ".join(words[i * 20 : i * 20 + 20])) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 20)], "doc_id long, quality int, toxic int")
    vectors, net, _ = quality.train(docs, labels)
    assert net is not None
    index, sums = quality._index_vectors(), np.zeros((quality.BUCKETS + quality.SHAPES, quality.SIZE))
    for _, t in rows:
        both = list(zip(*quality._tokens(bytewords.words_of([t])), strict=True))
        for i, own in enumerate(both):
            for near in both[max(0, i - quality.NEIGHBOURS) : i] + both[i + 1 : i + 1 + quality.NEIGHBOURS]:
                for row in own:
                    sums[row] += index[near[0]] + index[near[1]]
    wanted = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    assert np.allclose(vectors, wanted, atol=1e-6)
    used, _ = quality._tokens(bytewords.words_of(words))
    assert (np.linalg.norm(vectors[used], axis=1) > 0.99).all()


def test_training_text_of_a_repeated_id_is_fixed(spark):
    rows = [(i, f"plain text number {i} of some words" if i % 2 else f"BUY {i} NOW !!! $$ {i}") for i in range(1, 60)] + [(i, f"other text {i * i} under this id") for i in range(1, 60)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 60)], "doc_id long, quality int, toxic int")
    made = [quality.train(spark.createDataFrame(given, "doc_id long, text string").repartition(n), labels)[1] for given, n in ((rows, 2), (rows[::-1], 7))]
    assert np.array_equal(made[0].w1, made[1].w1) and made[0].temperature == made[1].temperature
