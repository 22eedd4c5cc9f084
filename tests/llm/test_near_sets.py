"""The near-dedup of the pipeline against brute force."""

import itertools
import random

import pytest

from faultspark.llm import near_sets

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def grams(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


@pytest.mark.parametrize("seed", [1, 3, 64])
def test_groups_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.randint(3, 120))) for _ in range(15)]
    for _ in range(130):
        own = rng.choice(texts).split()
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = rng.choice(words)
        texts.append(" ".join(own))
    sets, root = [grams(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(root[:], 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    table = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(None, texts[0], "en", "s", 1)], DOCS)
    assert {r.doc_id: r.component_id for r in near_sets.near_groups(table).collect()} == {i: find(i) for i in range(len(texts))}


def test_stage_drops_what_two_bits_miss(spark):
    import corpus_pipeline

    rng = random.Random(1)
    own = [f"word{rng.randrange(5000)}" for _ in range(100)]
    changed = own[:30] + ["other"] + own[31:]
    rows = [(1, " ".join(own), "en", "s", 1), (2, " ".join(changed), "en", "s", 1), (3, " ".join(own[:50] + changed[:50]), "en", "s", 1), (None, " ".join(own), "en", "s", 1)]
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, DOCS), "")
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "None"]
    assert corpus_pipeline.near_dedup(spark, spark.createDataFrame([], DOCS), "").count() == 0


def test_line_dedup_keeps_what_is_left(spark):
    import corpus_pipeline

    shared = ["A passage that a good many documents have in common.", "Another passage that they all hold as well, word by word."]
    rows = [(1, "\n".join([*shared, "A long line that nothing but the first one holds."]), "en", "s", 1), (2, "\n".join([*shared, "Own short line", "and a second"]), "en", "s", 1), (3, "\n".join(shared), "en", "s", 1)]
    kept = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    assert set(kept) == {1, 2} and kept[2] == "Own short line\nand a second"
