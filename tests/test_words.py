import heapq

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from prsignal.operators import model as M
from prsignal.operators import words as W


def test_tree_costs_what_the_usual_construction_costs():
    chance = np.random.default_rng(1)
    for _ in range(60):
        n = np.sort(chance.geometric(0.3, int(chance.integers(2, 60))))
        runs, root = W.huffman(list(zip(*(x.tolist() for x in np.unique(n, return_counts=True)))))
        nodes, codes = W.paths(np.arange(len(n)), runs, root)
        heap, cost = [int(x) for x in n], 0
        heapq.heapify(heap)
        while len(heap) > 1:
            both = heapq.heappop(heap) + heapq.heappop(heap)
            cost += both
            heapq.heappush(heap, both)
        sizes = (codes >= 0).sum(1)
        assert (sizes * n).sum() == cost
        # No word's way down from the root is that of another one, and all begin there.
        ways = {tuple(zip(nodes[i, :k][::-1], codes[i, :k][::-1])) for i, k in enumerate(sizes)}
        assert len(ways) == len(n) and {w[0][0] for w in ways} == {root}


def test_words_that_occur_together_get_like_vectors_and_reruns_agree(spark):
    topic = "transform(sequence(1, 8), i -> concat(IF(id % 2 = 0, 'a', 'b'), pmod(hash(id, i), 6)))"
    rows = spark.range(6000).selectExpr(f"{topic} AS tokens")
    rows = rows.unionByName(spark.sql("SELECT array('rare', 'a1') AS tokens"))
    model = W.fit_word_vectors(rows, "tokens", "vector", vector_size=5, min_count=2)
    vectors = {r.word: r.vector.toArray() for r in model.getVectors().collect()}
    assert set(vectors) == {t + str(i) for t in "ab" for i in range(6)}
    unit = {w: v / np.linalg.norm(v) for w, v in vectors.items()}
    same = [unit[x] @ unit[y] for x in unit for y in unit if x < y and x[0] == y[0]]
    other = [unit[x] @ unit[y] for x in unit for y in unit if x[0] < y[0]]
    assert np.mean(same) > 0.8 > 0.4 > np.mean(other)
    again = W.fit_word_vectors(rows.repartition(7), "tokens", "vector", vector_size=5, min_count=2)
    assert all(np.allclose(vectors[r.word], r.vector.toArray()) for r in again.getVectors().collect())


def test_rows_get_the_mean_of_their_words_also_from_a_saved_model(spark, tmp_path):
    rows = spark.createDataFrame(
        [(0, "a b a"), (1, "b new"), (2, " "), (3, "a b a"), (4, "A  b a")], "id int, line_text string"
    )
    words = M.tokenizer()
    model = W.fit_word_vectors(words.transform(rows.where("id <> 1")), "tokens", "vector", vector_size=3, min_count=1)
    PipelineModel([words, model]).write().save(str(tmp_path / "model"))
    of = {r.word: r.vector.toArray() for r in model.getVectors().collect()}
    assert set(of) == {"a", "b"}
    wanted = {0: (2 * of["a"] + of["b"]) / 3, 1: of["b"] / 2, 2: np.zeros(3)}
    wanted |= {3: wanted[0], 4: wanted[0]}
    for steps in (PipelineModel([words, model]), PipelineModel.load(str(tmp_path / "model"))):
        out = steps.transform(rows)
        assert out.columns == ["id", "line_text", "tokens", "vector"]
        found = {r.id: r.vector.toArray() for r in out.collect()}
        assert found.keys() == wanted.keys() and all(np.allclose(found[i], wanted[i]) for i in wanted)


def test_a_common_line_is_trained_on_as_often_as_it_occurs():
    ids = np.array([0, 1, -1, 2])
    words, sentence = W.sentences(ids, np.array([0, 3, 4]), np.array([2, 1]))
    assert words.tolist() == [0, 1, 0, 1, 2] and sentence.tolist() == [1, 1, 2, 2, 3]


def test_no_vocabulary_reaches_the_driver(spark, monkeypatch):
    rows = spark.range(3000).select(F.split(F.concat(F.lit("w"), F.col("id"), F.lit(" x y")), " ").alias("tokens"))
    collected = []
    frame = type(rows)
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: collected.append(len(out := collect(self))) or out)
    model = W.fit_word_vectors(rows, "tokens", "vector", vector_size=2, min_count=1)
    monkeypatch.undo()
    assert sum(collected) < 100 and model.table.count() == 3002
