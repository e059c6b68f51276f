"""Word-piece token counts by a linear longest-match automaton.

The vocabulary's tries (pieces that begin words, pieces that go on) are joined
by failure links. Following a link pops the pieces that the greedy longest
match has settled by then; each link carries their number, precomputed, so a
word's count takes one pass over its characters and no piece is ever built.

A word is a run of ``[^\\x20\\x09-\\x0D]+``; a word that the vocabulary can't
cover counts as one unknown token. Each distinct word that a worker meets is
counted once.

Results: null and empty texts have 0 words and 0 tokens; repeated rows give
repeated results; an empty table gives an empty table; columns besides the two
named are not read.
"""

from __future__ import annotations

from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import words as W


class LongestMatch:
    """Counts of greedy longest-match pieces; ``first`` begin a word, ``more`` go on inside it."""

    def __init__(self, first: list[str], more: list[str]):
        #: Node 0 is the root of the first pieces' trie, node 1 of the others'.
        self.go: list[dict[str, int]] = [{}, {}]
        whole = [False, False]
        for root, pieces in ((0, first), (1, more)):
            for piece in pieces:
                at = root
                for c in piece:
                    if c not in self.go[at]:
                        self.go[at][c] = len(self.go)
                        self.go.append({})
                        whole.append(False)
                    at = self.go[at][c]
                if piece:
                    whole[at] = True
        #: Where to go on when no longer match exists (-1: nowhere), and the pieces popped on the way.
        self.fail = [-1] * len(self.go)
        self.pops = [0] * len(self.go)
        queue = deque([0, 1])
        while queue:
            u = queue.popleft()
            for c, v in self.go[u].items():
                queue.append(v)
                if whole[v]:
                    self.fail[v], self.pops[v] = 1, 1
                    continue
                z, popped = self.fail[u], self.pops[u]
                while z >= 0 and c not in self.go[z]:
                    popped += self.pops[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.pops[v] = self.go[z][c], popped

    def count(self, word: str) -> int:
        """Pieces of the word; -1 if it can't be covered."""
        go, fail, pops = self.go, self.fail, self.pops
        at, n = 0, 0
        for c in word:
            while c not in go[at]:
                n += pops[at]
                at = fail[at]
                if at < 0:
                    return -1
            at = go[at][c]
        while at != 1:
            n += pops[at]
            at = fail[at]
            if at < 0:
                return -1 if word else 0
        return n


def pieces_of(model_path: str) -> tuple[list[str], list[str]]:
    """A sentencepiece vocabulary as word pieces: those behind its word mark begin words, the rest go on."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    names = [model.id_to_piece(i) for i in plain]
    return [p[1:] for p in names if p[0] == "▁" and len(p) > 1], [p for p in names if "▁" not in p]


@lru_cache(2)
def memo(model_path: str) -> W.WordMemo:
    automaton = LongestMatch(*pieces_of(model_path))

    def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        # One value a word: twice the count, plus 1 for an unknown word.
        counts = (automaton.count(w.decode("utf-8", "replace")) for w in words)
        return np.fromiter((2 * n if n >= 0 else 3 for n in counts), np.uint32, len(words)), np.ones(len(words), np.int64)

    return W.WordMemo(encode)


def count_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) per row: a narrow step without a shuffle."""
    names = ["doc_id", "n_words", "n_tokens", "n_unknown"]
    out = pa.schema([(n, pa.int64()) for n in names])

    def run(batches):
        cache = memo(model_path)
        for batch in batches:
            texts = W.texts_of(batch["text"])
            for a, b in W.steps(texts):
                flat, lens = cache.texts(texts[a:b])
                at = np.concatenate([[0], np.cumsum(lens)])
                tokens, unknown = (np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[at]) for x in (flat >> 1, flat & 1))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), *map(pa.array, (lens, tokens, unknown))], schema=out)

    return W.id_and_text(docs, id_col, text_col).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def op10_wordpiece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word and word-piece counts of every document."""
    from .bpe import tokenizer_path

    return count_pieces(W.documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))
