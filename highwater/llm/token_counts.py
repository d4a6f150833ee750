"""Token counts by a compiled finite-state machine instead of a full encoding.

BPE over pieces has two properties that make it a transducer. Two neighbouring characters that no piece holds together
are always cut (the machine returns to its start there), and a sequence of pieces is the encoding exactly if each two
neighbours encode to themselves. So the last piece of every prefix follows from earlier prefixes, from left to right.
States are the prefixes since the last cut, compiled on demand; each transition reads a character and carries how the
number of emitted tokens changes. The table is bounded: when full it is compiled anew.

Long texts are cut into chunks anywhere. A chunk's effect on every entry state is one map: what happens before its first
cut depends on the entry state, the rest does not. Maps compose associatively, so the chunks of a text are reduced as a
balanced tree, the order of a parallel prefix scan.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from highwater.llm.common import small_batches, texts

SPACE = "▁"
CHUNK = 1 << 16


@dataclass(frozen=True)
class ChunkMap:
    """head: text before the first cut; count: tokens between first and last cut; tail: text after the last cut (None: no cut)."""
    head: str
    count: int
    tail: str | None


class PieceMachine:
    """The transducer of one sentencepiece BPE model with byte fallback."""

    def __init__(self, path: str, limit: int = 400_000):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.rank = {sp.id_to_piece(i): -sp.get_score(i) for i in plain}
        self.joined = {p[i:i + 2] for p in self.rank for i in range(len(p) - 1)}
        self.longest, self.limit = max(map(len, self.rank)), limit
        self.fits: dict[tuple[str, str], bool] = {}
        if any(SPACE in p.lstrip(SPACE) for p in self.rank) or any(sp.is_unused(i) for i in plain):
            raise ValueError("pieces with inner spaces or unused pieces are not supported")
        self.compile()

    def compile(self) -> None:
        """The start state: no character read, no token emitted."""
        self.next: dict[tuple[int, str], int] = {}
        self.last, self.tokens = [""], [0]

    def merged(self, text: str) -> list[str]:
        """BPE by its definition: merge the best-ranked neighbours, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get(parts[i] + parts[i + 1], 9e9))
            if parts[best] + parts[best + 1] not in self.rank:
                break
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def neighbours(self, a: str, b: str) -> bool:
        key = (a, b)
        if key not in self.fits:
            if len(self.fits) >= 4 * self.limit:
                self.fits.clear()
            self.fits[key] = self.merged(a + b) == [a, b]
        return self.fits[key]

    def run(self, word: str) -> int:
        """Tokens of a stretch without cuts, from the start state."""
        state, path = 0, [0]
        for i, c in enumerate(word):
            to = self.next.get((state, c))
            if to is None:
                to = self.extend(state, path, word, i)
            path.append(to)
            state = to
        return self.tokens[state]

    def extend(self, state: int, path: list[int], word: str, i: int) -> int:
        """Compile the transition on word[i]: its new state knows the last piece and the tokens so far."""
        for j in range(max(0, i + 1 - self.longest), i + 1):
            piece = word[j:i + 1]
            if j == i or piece in self.rank:
                before = self.last[path[j]]
                if before and self.neighbours(before, piece) or not j and self.merged(piece) == [piece]:
                    break
        else:
            raise ValueError(f"no last piece for {word[:i + 1]!r}")
        emitted = 1 if piece in self.rank else len(piece.encode())  # byte fallback
        self.last.append(piece)
        self.tokens.append(self.tokens[path[j]] + emitted)
        self.next[state, word[i]] = len(self.last) - 1
        return len(self.last) - 1

    def stretches(self, text: str) -> list[str]:
        """Cut between characters that no piece holds together."""
        cuts = [0, *(i for i in range(1, len(text)) if text[i - 1:i + 1] not in self.joined), len(text)]
        return [text[a:b] for a, b in zip(cuts, cuts[1:]) if a < b]

    def count(self, text: str) -> int:
        return sum(map(self.run, self.stretches(text)))


class TokenCounter(dict):
    """Parts of texts (a word with its spaces, or a line end) -> tokens, in front of the machine; bounded like it."""

    def __init__(self, path: str, limit: int = 400_000):
        self.machine, self.limit = PieceMachine(path, limit), limit
        alone = "\n" not in {c for p in self.machine.rank for c in p}
        self.part = re.compile(rf"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+" if alone else rf"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def __missing__(self, part: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        if len(self.machine.last) >= 4 * self.limit:
            self.machine.compile()
        n = sum(self[s] if s != part and len(s) < len(part) else self.machine.run(s) for s in self.machine.stretches(part))
        if len(part) <= 48:
            self[part] = n
        return n

    def plain(self, text: str) -> int:
        return sum(map(self.__getitem__, self.part.findall(text)))

    def chunk_map(self, chunk: str) -> ChunkMap:
        """Cuts used here: before a space that follows another character, and around line ends when no piece holds one."""
        places = [m.start() for m in self.part.finditer(chunk)]
        if len(places) < 2:
            return ChunkMap(chunk, 0, None)
        return ChunkMap(chunk[:places[1]], self.plain(chunk[places[1]:places[-1]]), chunk[places[-1]:])

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        if a.tail is None:
            both = self.chunk_map(a.head + b.head)
            if b.tail is None:
                return both
            return ChunkMap(a.head + b.head, b.count, b.tail) if both.tail is None else ChunkMap(
                both.head, both.count + self.plain(both.tail) + b.count, b.tail)
        if b.tail is None:
            joint = self.chunk_map(a.tail + b.head)
            return ChunkMap(a.head, a.count, joint.head) if joint.tail is None else ChunkMap(a.head, a.count + self.plain(joint.head) + joint.count, joint.tail)
        return ChunkMap(a.head, a.count + self.plain(a.tail + b.head) + b.count, b.tail)

    def total(self, text: str) -> int:
        """Tokens of a whole text; the library puts one space in front of a text that is not empty."""
        if not text:
            return 0
        text = SPACE + text.replace(" ", SPACE)
        if len(text) <= CHUNK:
            return self.plain(text)
        maps = [self.chunk_map(text[i:i + CHUNK]) for i in range(0, len(text), CHUNK)]
        while len(maps) > 1:
            maps = [self.compose(*maps[i:i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return self.plain(maps[0].head) + maps[0].count + (self.plain(maps[0].tail) if maps[0].tail else 0)


_counters: dict[str, TokenCounter] = {}


def _counter(path: str) -> TokenCounter:
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row. A null text is empty and has no tokens; repeated rows are counted
    again, rows without doc_id are kept, extra columns are ignored."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _counter(model_path)
        for b in batches:
            n = [c.total(t.as_py()) for t in b["text"]]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["n_bytes"], pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = texts(docs, F.col("doc_id").cast("long").alias("doc_id")).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
