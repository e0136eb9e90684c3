"""Token counts by greedy longest-match word pieces, in one linear pass and without building pieces.

The vocabulary is a trie with two roots: pieces that begin a word and pieces
that continue one. Every node has a failure link, the node that stands for what
is left of its string once the longest-match pieces at its front are popped,
and the number of pieces popped on the way. Reading a word follows trie edges,
and failure links where there is no edge; the popped counts add up to the
number of pieces. Each character moves forward once and each pop is counted
once, so the time is linear in the word whatever the vocabulary.

A word that cannot be covered is one unknown piece, as in the usual word-piece
rule. Null and empty texts have no words. Rows are returned as often as they
occur; other columns pass through, result columns replace those of their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql.types import LongType

BEGIN, INNER, NONE = 0, 1, -1
UNKNOWN = 1 << 40


class Automaton:
    """Trie with failure links and counts of popped pieces."""

    def __init__(self, begins: Iterable[str], continues: Iterable[str]):
        self.next: list[dict[str, int]] = [{}, {}]
        ends = {self._insert(root, piece) for root, pieces in ((BEGIN, begins), (INNER, continues)) for piece in pieces if piece}
        self.fail, self.popped = [NONE] * len(self.next), [0] * len(self.next)
        level = [BEGIN, INNER]
        while level:  # by string length, so that shorter strings have their links
            deeper = []
            for u in level:
                for c, v in self.next[u].items():
                    deeper.append(v)
                    if v in ends:
                        self.fail[v], self.popped[v] = INNER, 1
                        continue
                    z, count = self.fail[u], self.popped[u]
                    while z != NONE and c not in self.next[z]:
                        count += self.popped[z]
                        z = self.fail[z]
                    if z != NONE:
                        self.fail[v], self.popped[v] = self.next[z][c], count
            level = deeper

    def _insert(self, node: int, piece: str) -> int:
        for c in piece:
            if c not in self.next[node]:
                self.next[node][c] = len(self.next)
                self.next.append({})
            node = self.next[node][c]
        return node

    def pieces(self, word: str) -> int:
        """Number of pieces of a word; UNKNOWN + 1 if it cannot be covered."""
        step, fail, popped, u, count = self.next, self.fail, self.popped, BEGIN, 0
        for c in word:
            while (v := step[u].get(c)) is None:
                count += popped[u]
                u = fail[u]
                if u == NONE:
                    return UNKNOWN + 1
            u = v
        while u != INNER:
            count += popped[u]
            u = fail[u]
            if u == NONE:
                return UNKNOWN + 1
        return count


def vocabulary(path: str) -> tuple[list[str], list[str]]:
    """Pieces that begin words and pieces that continue them, from a sentencepiece model (U+2581 begins words)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return [p[1:] for p in pieces if p.startswith("▁") and "▁" not in p[1:]], [p for p in pieces if "▁" not in p]


class _Counts(dict):
    """Piece counts of words, computed when first asked for; emptied when full."""

    def __init__(self, automaton: Automaton, limit: int):
        super().__init__()
        self.automaton, self.limit = automaton, limit

    def __missing__(self, word: str) -> int:
        n = self.automaton.pieces(word)
        if len(word) <= 64:
            self[word] = n
        return n


_counts: dict[str, _Counts] = {}


def count_tokens(df: DataFrame, path: str, *, text: str = "text", limit: int = 500_000) -> DataFrame:
    """Add n_words, n_pieces and n_unknown (words without a cover, one piece each) for the whole of each text."""
    pieces = vocabulary(path)
    shared = df.sparkSession.sparkContext.broadcast(pieces)  # bounded by the vocabulary
    key = f"{path}:{len(pieces[0])}:{len(pieces[1])}"
    names = ["n_words", "n_pieces", "n_unknown"]
    keep = [c for c in df.columns if c not in names]
    schema = df.select(*keep).schema
    for n in names:
        schema = schema.add(n, LongType())

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        if key not in _counts:
            _counts.clear()
            _counts[key] = _Counts(Automaton(*shared.value), limit)
        counts = _counts[key]
        table = str.maketrans("\t\n\x0b\x0c\r", "     ")
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                words, totals = [], []
                for t in part.column(text):
                    found = [w for w in (t.as_py() or "").translate(table).split(" ") if w]
                    words.append(len(found))
                    totals.append(sum(map(counts.__getitem__, found)))
                if len(counts) > limit:
                    counts.clear()
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(words, pa.int64()), pa.array([t % UNKNOWN for t in totals], pa.int64()), pa.array([t // UNKNOWN for t in totals], pa.int64())], [*keep, *names])

    return df.select(*keep).mapInArrow(run, schema)
