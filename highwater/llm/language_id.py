"""Language of a text by cross-parsing: how few phrases of a language's own text is it made of?

For every language a suffix automaton of labelled text is built; its paths from the root are exactly the substrings of that
text. A document is read greedily: the automaton follows it as far as some substring matches (the longest match), then a new
phrase begins. The number of phrases times the bits that name a place in the language's text, per symbol, estimates the cross
entropy; the language with the fewest bits wins, ties to the smaller name.

Learning is on a bounded sample: ``sample_rows`` labelled ids per language by hash order, cut whole into pieces of ``piece``
characters, of which the ``sample_pieces`` distinct ones first in hash order are kept (64 KiB per language by default). Only
these pieces are broadcast; each Python worker builds the automata once, as one table of states by symbols.

Documents are read in bytes: A-Z folded (other letters are lower-cased by Spark), every run of other ASCII signs one blank.
The symbols of a text are parsed in stretches of 512, so that many stretches step through the tables together in numpy; a
phrase ends where its stretch ends, which adds at most one phrase per stretch for every language alike. The result of a text
does not depend on what else is in its batch.

Defined results. ``und`` with score 0 for null texts and texts without a letter, and for all texts when nothing can be
learned. Rows under a null doc_id are predicted, not learned from and not held out. A repeated row is predicted once per row;
a repeated id counts once in the choice of ids. Very long texts are read in windows of two megabytes. An empty table gives
an empty result. Columns other than doc_id, text and lang are not read.
"""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from highwater.llm.common import SLICE, slices, small_batches
from highwater.llm.labelled import held_out

STRETCH = 512
SOFTNESS = 8.0  # bits that halve a rival's share of the score
LOWER = np.full(256, 32, np.uint8)
LOWER[97:123] = LOWER[65:91] = np.arange(97, 123)
LOWER[128:] = np.arange(128, 256)


def normal_bytes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes with runs of blanks cut to one, and the offsets of the rows in them."""
    low = LOWER[data]
    blank = low == 32
    keep = np.ones(len(low), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    starts = off[:-1][off[:-1] < len(low)]
    keep[starts] = True
    upto = np.zeros(len(low) + 1, np.int64)
    np.cumsum(keep, out=upto[1:])
    return low[keep], upto[off]


def automaton(text: bytes) -> tuple[list[dict[int, int]], list[int]]:
    """Suffix automaton: transitions of each state and the length of its longest string. State 0 is the root."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return moves, length


class Parser:
    """Automata of several languages as one table. Rows are states, shallow ones first; -1: no such substring."""

    def __init__(self, pieces: dict[str, list[str]]):
        self.names = sorted(pieces)
        texts = []
        for name in self.names:
            rows = [np.frombuffer(p.encode(), np.uint8) for p in pieces[name]]
            norm = [normal_bytes(r, np.array([0, len(r)]))[0].tobytes() for r in rows]
            texts.append(b"\0".join(norm))  # a sign that no document has, so that no phrase runs from piece to piece
        used = sorted({c for t in texts for c in t} - {0})
        self.symbol = np.full(256, len(used), np.uint8)
        self.symbol[used] = np.arange(len(used))
        self.width = len(used) + 1
        tables, self.root, base = [], [], 0
        for t in texts:
            moves, length = automaton(t)
            rank = np.empty(len(moves), np.int32)
            rank[np.argsort(length, kind="stable")] = np.arange(len(moves))
            table = np.full((len(moves), self.width), -1, np.int32)
            for state, out in enumerate(moves):
                for c, to in out.items():
                    if c:
                        table[rank[state], self.symbol[c]] = rank[to] + base
            tables.append(table)
            self.root.append(base)
            base += len(moves)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
        self.root = np.array(self.root, np.int32)[:, None]
        self.bits = np.log2([len(t) + 1 for t in texts]) if texts else np.zeros(0)

    def phrases(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(languages x rows) numbers of phrases, and symbols of each row."""
        norm, off = normal_bytes(data, off)
        sym, size = self.symbol[norm].astype(np.int32), np.diff(off)
        lanes = -(-size // STRETCH)
        row = np.repeat(np.arange(len(size)), lanes)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = off[row] + nth * STRETCH
        length = np.minimum(off[row + 1] - start, STRETCH) if len(row) else start
        order = np.argsort(-length, kind="stable")
        start, length, row = start[order], length[order], row[order]
        count = np.zeros((len(self.names), len(row)), np.int32)
        state = np.repeat(self.root, len(row), 1)
        for step in range(int(length[0]) if len(length) else 0):
            k = int(np.searchsorted(-length, -step, "left"))  # stretches longer than this step
            c = sym[start[:k] + step]
            now = state[:, :k]
            to = self.table[now * self.width + c]
            fresh = (to < 0) | (now == self.root)
            again = self.table[self.root * self.width + c]
            state[:, :k] = np.where(fresh, np.where(again < 0, self.root, again), to)
            count[:, :k] += fresh
        return np.stack([np.bincount(row, weights=n, minlength=len(size)) for n in count]).astype(np.int64), size

    def row_phrases(self, col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, languages x rows numbers of phrases, symbols). A long text is read in windows."""
        for first, off, data in slices(col):
            if len(off) == 2 and len(data) > SLICE:
                parts = [self.phrases(data[a:a + SLICE], np.array([0, min(SLICE, len(data) - a)])) for a in range(0, len(data), SLICE)]
                yield first, sum(p for p, _ in parts), sum(s for _, s in parts)
            else:
                yield first, *self.phrases(data, off)


def learn(docs: DataFrame, folds: int, fold: int, sample_rows: int, sample_pieces: int, piece: int) -> dict[str, list[str]]:
    """language -> pieces of its labelled text."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), folds, fold))

    def first(df: DataFrame, n: int, *order) -> DataFrame:
        return df.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("_r") <= n).drop("_r")

    # ids whose hash is small enough to be among the first, so that no task ranks all ids of a language; one size per language
    # is broadcast, less than the model itself
    sizes = known.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("_n"))
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 1) / F.lit(2.0 ** 63)
    early = known.select("doc_id", "lang").join(F.broadcast(sizes), "lang").where(place * F.col("_n") <= 8.0 * sample_rows).select("doc_id", "lang")
    ids = first(early.distinct(), sample_rows, F.shiftrightunsigned(F.xxhash64("doc_id"), 1), "doc_id")
    cut = F.explode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{piece}}}"), F.lit(0)))
    # no more ids than the model has languages times sample_rows, fewer than the pieces that are broadcast anyway
    cuts = known.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi").select("lang", cut.alias("piece")).distinct()
    out: dict[str, list[str]] = {}
    for r in first(cuts, sample_pieces, F.xxhash64("piece"), "piece").orderBy("lang", "piece").collect():
        out.setdefault(r["lang"], []).append(r["piece"])
    return out


_parsers: dict[str, Parser] = {}


def language_ids(docs: DataFrame, folds: int = 5, fold: int = 0, sample_rows: int = 400, sample_pieces: int = 128, piece: int = 512) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.lower(F.col("text").cast("string")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, folds, fold, sample_rows, sample_pieces, piece))
    model = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _parsers:  # a Python worker serves many tasks and keeps the automata of one model
            _parsers.clear()
            _parsers[model] = Parser(shared.value)
        parser = _parsers[model]
        names = np.array([*parser.names, "und"], object)
        for batch in batches:
            best, score = np.full(batch.num_rows, len(parser.names)), np.zeros(batch.num_rows)
            if parser.names:
                for first, count, _ in parser.row_phrases(batch.column(2)):
                    bits = count * parser.bits[:, None]
                    at = slice(first, first + bits.shape[1])
                    best[at] = bits.argmin(0)
                    score[at] = 1 / np.exp2(np.maximum((bits.min(0) - bits) / SOFTNESS, -1000)).sum(0)
            silent = ~np.asarray(batch.column(3))
            best[silent], score[silent] = len(parser.names), 0
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(names[best].tolist(), pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), text.alias("text"), text.rlike(r"\p{L}").alias("letters")).mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double")
