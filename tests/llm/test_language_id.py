"""Cross-parsing against a plain longest-match search, and held-out accuracy."""
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from highwater.llm import language_id as m

REFS = {"a": ["abra kadabra banana", "nab a bat"], "b": ["hocus pocus fidibus", "ÖL über alles"], "c": ["x y z 1 2 3"]}


def normal(text):
    raw = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in text.encode())
    return re.sub(rb" +", b" ", raw)


def plain_phrases(text, refs):
    """Greedy longest matches by search in the language's pieces; a stretch of 512 symbols is read on its own."""
    text, pieces, n = normal(text), [normal(p) for p in refs], 0
    for at in range(0, len(text), m.STRETCH):
        rest = text[at:at + m.STRETCH]
        while rest:
            k = 1
            while k <= len(rest) and any(rest[:k] in p for p in pieces):
                k += 1
            rest, n = rest[max(k - 1, 1):], n + 1
    return n


def texts():
    rng = np.random.default_rng(1)
    alphabet = list("abnrkdhocusfi  .,ÖüZ19\n")
    return ["", "   ", "abra", "ABRA kadabra!", "hocus 99 pocus", "日本", "Übe"] + ["".join(rng.choice(alphabet, int(rng.integers(1, 3000)))) for _ in range(40)]


def test_phrases_equal_a_plain_search():
    parser = m.Parser(REFS)
    seen = 0
    for first, count, size in parser.row_phrases(pa.array(texts())):
        for i in range(count.shape[1]):
            t = texts()[first + i]
            assert size[i] == len(normal(t))
            assert count[:, i].tolist() == [plain_phrases(t, REFS[k]) for k in sorted(REFS)]
            seen += 1
    assert seen == len(texts())


def test_automaton_accepts_exactly_the_substrings():
    text = b"abcabxabcd"
    moves, _ = m.automaton(text)

    def accepts(s):
        state = 0
        for c in s:
            if c not in moves[state]:
                return False
            state = moves[state][c]
        return True
    grams = {text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)}
    assert all(accepts(g) for g in grams)
    assert not any(accepts(g + bytes([c])) for g in grams for c in b"abcdx" if g + bytes([c]) not in grams)


def test_windows_of_long_texts(monkeypatch):
    parser, text = m.Parser(REFS), "abra kadabra " * 40
    whole = next(parser.row_phrases(pa.array([text])))
    monkeypatch.setattr(m, "SLICE", 128)
    _, count, size = next(parser.row_phrases(pa.array([text])))
    assert size[0] == whole[2][0] and (count[:, 0] >= whole[1][:, 0]).all() and count[:, 0].argmin() == 0


def test_odd_rows_and_empty_tables(spark):
    rows = [(i, f"the house and the garden of my neighbour number {i} were very quiet", "en", 1.0) for i in range(60)]
    rows += [(100 + i, f"das Haus und der Garten meines Nachbarn Nummer {i} waren sehr ruhig", "de", 1.0) for i in range(60)]
    rows += [(300, None, "en", 0.0), (301, "", "de", 0.0), (302, "12 34 !?", None, 0.0), (303, "der Nachbar", None, 0.0), (303, "the neighbour", None, 0.0),
             (None, "meines Nachbarn Garten", "en", 0.0), (304, "日本", None, 0.0), (305, "der Garten " * 30000, None, 0.0)]
    schema = "doc_id long, text string, lang string, score double"
    got = [r.asDict() for r in m.language_ids(spark.createDataFrame(rows, schema)).collect()]
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r["lang_pred"])
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    assert [by[i] for i in (300, 301, 302)] == [["und"]] * 3
    assert sorted(by[303]) == ["de", "en"] and by[None] == ["de"] and by[305] == ["de"] and by[304][0] in ("de", "en")
    assert all(by[i] == ["en"] and by[100 + i] == ["de"] for i in range(60))
    empty = spark.createDataFrame([], schema)
    assert m.language_ids(empty).count() == 0
    assert [r["lang_pred"] for r in m.language_ids(spark.createDataFrame([(1, "words", None, 0.0)], schema)).collect()] == ["und"]


def test_labels_of_the_held_out_fold_change_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    swapped = docs.withColumn("lang", __import__("pyspark.sql.functions", fromlist=["x"]).expr("if(crc32(cast(doc_id as string)) % 5 = 0, 'xx', lang)"))
    a, b = (sorted(map(tuple, m.language_ids(d).collect())) for d in (docs, swapped))
    assert a == b


@pytest.mark.parametrize("table", ["sf0.01"])
def test_held_out_accuracy(spark, table):
    docs = spark.read.parquet(f"/root/testdata/{table}/documents.parquet")
    got = m.language_ids(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang_pred != 'und'")
    right, n = got.where("lang_pred = lang").count(), got.count()
    assert n > 100 and right >= 0.9 * n, (right, n)
