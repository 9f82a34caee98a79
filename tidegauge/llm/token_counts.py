"""Token counts by a linear longest-match automaton.

The vocabulary becomes a trie. Each node has a failure link and the number of pieces popped when it is
followed, so one walk over a word's symbols, without looking back, gives how many pieces greedy
longest-match-first would cut it into; no piece is built.

Words are ``[^\\x20\\x09-\\x0D]+``, lower-cased, as UTF-8 bytes. Two kinds of vocabulary are known:
pieces whose last one ends with an end mark (``</w>``), written in byte-level letters, and pieces whose
continuations begin with a prefix (``##``). A word that no pieces cover counts as one unknown piece.

Defined cases: a null or empty text has no words and no pieces; long words and texts are walked in one pass
with the memory of the text itself; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from ..workers import ready
from .shared import memo, pick, text_array

END = 256
#: Words whose counts a worker remembers; beyond it forgets them all and goes on.
WORDS_HELD = 400_000


def byte_letters() -> dict[str, int]:
    """The byte behind each letter of byte-level vocabularies: printable bytes stand for themselves, the others for letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def end_marked(vocabulary: list[str], mark: str = "</w>") -> list[tuple[int, ...]]:
    """Pieces as symbols, the end mark as the symbol END."""
    letters = byte_letters()
    out = []
    for piece in vocabulary:
        ends = piece.endswith(mark)
        body = piece[: -len(mark)] if ends else piece
        if all(c in letters for c in body):
            out.append((*(letters[c] for c in body), *([END] if ends else [])))
    return out


class Automaton:
    """initial: pieces that begin a word; continued: those further on. Symbols are integers; with ``ends`` a word's symbols end with END, which alone costs nothing."""

    def __init__(self, initial: list[tuple[int, ...]], continued: list[tuple[int, ...]], ends: bool):
        self.ends = ends
        self.children: list[dict[int, int]] = [{}, {}]
        piece = [-1, -1]
        for root, pieces in ((0, initial), (1, continued)):
            for symbols in pieces:
                node = root
                for s in symbols:
                    if s not in self.children[node]:
                        self.children[node][s] = len(self.children)
                        self.children.append({})
                        piece.append(-1)
                    node = self.children[node][s]
                if node > 1:
                    piece[node] = max(piece[node], int(symbols != (END,)))
        n = len(self.children)
        self.fail, self.pops = [-1] * n, [0] * n
        level = [0, 1]
        while level:  # breadth first: a link leads to a shorter rest
            below = []
            for node in level:
                for s, child in self.children[node].items():
                    below.append(child)
                    if piece[child] >= 0:
                        self.fail[child], self.pops[child] = 1, piece[child]
                        continue
                    at, popped = self.fail[node], self.pops[node]
                    while at >= 0 and s not in self.children[at]:
                        popped += self.pops[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[child], self.pops[child] = self.children[at][s], popped
            level = below

    def count(self, word: bytes) -> int:
        """Pieces of a word; 1 if it can't be covered."""
        children, fail, pops = self.children, self.fail, self.pops
        node = total = 0
        for s in (*word, END) if self.ends else word:
            while s not in children[node]:
                total += pops[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = children[node][s]
        while node != 1:
            total += pops[node]
            node = fail[node]
            if node < 0:
                return 1
        return total


def of_end_marked(vocabulary: list[str], mark: str = "</w>") -> Automaton:
    pieces = [*end_marked(vocabulary, mark), (END,)]
    return Automaton(pieces, pieces, True)


def of_continuations(vocabulary: list[str], prefix: str = "##") -> Automaton:
    return Automaton([tuple(p.encode()) for p in vocabulary if not p.startswith(prefix)], [tuple(p[len(prefix) :].encode()) for p in vocabulary if p.startswith(prefix)], False)


class Counted(dict):
    """Counts by word as written; asks the automaton once for each."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_HELD:
            self.clear()
        n = self.automaton.count(word.decode().lower().encode())
        self[word] = n
        return n


def _counts(told, per_word: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        style, vocabulary, key = told.value
        of = memo(("token_counts", key), lambda: Counted((of_end_marked if style == "end" else of_continuations)(vocabulary))).__getitem__
        for batch in batches:
            words, tokens, each = [], [], []
            for text in text_array(batch.column(1)).cast(pa.binary()):
                counts = list(map(of, text.as_py().split()))
                words.append(len(counts))
                tokens.append(sum(counts))
                if per_word:
                    each.append(counts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64()), *([pa.array(each, pa.list_(pa.int32()))] if per_word else [])], names=["doc_id", "n_words", "n_tokens", *(["word_tokens"] if per_word else [])])

    return run


def token_counts(docs: DataFrame, vocabulary: list[str], style: str = "end", doc_id: str = "doc_id", text: str = "text", per_word: bool = False) -> DataFrame:
    """doc_id, n_words and n_tokens of each row; with per_word also word_tokens, the pieces of each word in order. style: "end" or "continuation"."""
    told = ready(docs).sparkContext.broadcast((style, vocabulary, f"{style}:{len(vocabulary)}:{hash(tuple(vocabulary))}"))
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(*pick(docs, doc_id, text)).toDF("doc_id", "text").mapInArrow(_counts(told, per_word), f"doc_id {kind}, n_words long, n_tokens long" + ", word_tokens array<int>" * per_word)


def file_vocabulary(path: str) -> list[str]:
    """The pieces of a tokenizer file, in the order of their ids. A vocabulary has a fixed size, whatever the corpus."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    return sorted(vocab, key=vocab.get)


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), file_vocabulary(public_tokenizers.path("word_bpe_49k.json")))
