"""What the factorization machine must learn: pairs of words that tell nothing alone, rare words, labels of repeated rows."""
import random
import zlib

import numpy as np

from highwater.llm.toxicity import toxicity_scores

LABELS = "doc_id long, toxic int"


def test_pair_of_neutral_words(spark):
    r = random.Random(5)
    pairs = [[("ape", "south"), ("fox", "north")], [("ape", "north"), ("fox", "south")]]
    rows = []
    for i in range(900):
        t = [r.choice([f"w{j}" for j in range(60)]) for _ in range(20)] + list(r.choice(pairs[i % 2]))
        r.shuffle(t)
        rows.append((i, " ".join(t)))
    got = toxicity_scores(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(900)], LABELS)).collect()
    assert np.mean([x.predicted == x.doc_id % 2 for x in got if x.held_out]) > 0.95


def test_word_in_five_documents(spark):
    taught = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1]
    bad, other = set(taught[:5]), set(taught[5:30])
    r = random.Random(2)
    filler = lambda: " ".join(r.choice("the on er at in".split()) for _ in range(20))
    rows = [(i, filler() + (" vile" if i in bad else " idiot" if i in other else "")) for i in range(400)]
    rows += [(1000, "the on er at in vile"), (1001, "the on er at in")]
    got = toxicity_scores(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i in bad | other)) for i in range(400)], LABELS))
    score = {x.doc_id: x.score for x in got.collect()}
    assert score[1000] > 0.5 > score[1001]


def test_repeated_rows_teach_once(spark):
    taught = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 != 1][:60]
    rows = [(i, "the on er at idiot" if n % 2 else "the on er at") for n, i in enumerate(taught)]
    rows += [rows[0]] * 300 + rows * 2  # more rows of label 0 than twice the sample
    labels = spark.createDataFrame([(i, n % 2) for n, i in enumerate(taught)], LABELS)
    got = toxicity_scores(spark.createDataFrame(rows, "doc_id long, text string"), labels, sample=60).collect()
    want = {i: n % 2 for n, i in enumerate(taught)}
    assert len(got) == len(rows) and all(x.predicted == want[x.doc_id] for x in got)
