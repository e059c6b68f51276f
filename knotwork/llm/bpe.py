"""BPE encoding and decoding with contiguous rank arrays.

Words are split off as the tokenizer file says (NFC, white space to one space,
lower case, the file's split pattern, byte level). Each distinct word that a
worker meets is merged once: its parts and the ranks of adjacent parts lie in
contiguous arrays; the least rank is looked for by a plain scan, the boundary
behind it is deleted and the two neighbouring ranks are refreshed. The arrays
of all new words of a step form the rows of one matrix, so the scan is one
vectorised operation. Words of over ``LONG`` parts take a heap of ranks, as a
scan would be quadratic there.

Results: null and empty texts have no tokens; ids are little-endian unsigned
32-bit integers in one binary value; repeated rows give repeated results; an
empty table gives an empty table; columns besides the two named are not read.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W

#: Words of more parts than this are merged with a heap.
LONG = 96
NONE = np.iinfo(np.int32).max


#: Letters of Unicode 16, which the library knows and ``unicodedata`` doesn't.
LETTERS_16 = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B),
    (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
#: Lower case of capitals that came with Unicode 16 and 17.
LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
CAPITALS = regex.compile(f"[{''.join(map(chr, LOWER))}]")


@lru_cache(1)
def newer() -> frozenset[str]:
    """Letters and digits that the split pattern's engine knows and the library doesn't: those of Unicode 17, and the digits of 16."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    of_16 = {chr(c) for a, b in LETTERS_16 for c in range(a, b + 1)}
    return frozenset(c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn") - of_16


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class RankBpe:
    """A BPE tokenizer read from a tokenizers JSON file with NFC, lower-casing and byte level."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for t, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = t
        self.token_bytes = [t.encode() for t in self.tokens]
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = pattern.replace(r"\s", r"\p{White_Space}")
        self.pieces, self.lines = regex.compile(self.pattern), regex.compile(r"\n|" + self.pattern)
        self.strict = None
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        chars = byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int32)
        self.final = np.array([vocab[c + suffix] for c in chars], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = (left << 20) | right
        # A pair listed twice keeps its last rank, as a dictionary filled in order would.
        order = np.lexsort((-np.arange(len(keys)), keys))
        first = np.concatenate([[True], np.diff(keys[order]) > 0]) if len(keys) else np.empty(0, bool)
        self.keys, self.ranks = keys[order][first], order[first].astype(np.int32)
        base = int(max(self.inner.max(), self.final.max())) + 1
        self.base = np.full((base, base), NONE, np.int32)
        low = (left < base) & (right < base)
        self.base[left[low], right[low]] = np.flatnonzero(low)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of adjacent parts; NONE where they don't merge or one is missing (-1)."""
        if not len(self.keys):
            return np.full(len(left), NONE, np.int32)
        key = (left.astype(np.int64) << 20) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], NONE)

    def merge(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the pieces (their UTF-8 bytes) in one array; where each piece's begin, and how many they are."""
        flat: list[np.ndarray] = []
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        starts, lens, at = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64), 0
        for i in np.flatnonzero(size > LONG):
            flat.append(self.merge_long(raw[i]))
            starts[i], lens[i] = at, len(flat[-1])
            at += len(flat[-1])
        edges = [0, 4, 8, 12, 16, 24, 32, 48, LONG]
        for low, high in zip(edges, edges[1:], strict=False):
            rows = np.flatnonzero((size > low) & (size <= high))
            for begin in range(0, len(rows), 8_000):
                part = rows[begin : begin + 8_000]
                done = self.merge_matrix([raw[i] for i in part], size[part])
                has = done >= 0
                lens[part] = has.sum(1)
                flat.append(done[has])
                starts[part] = at + np.cumsum(lens[part]) - lens[part]
                at += len(flat[-1])
        return (np.concatenate(flat).astype(np.uint32) if flat else np.empty(0, np.uint32)), starts, lens

    def merge_matrix(self, raw: list[bytes], size: np.ndarray) -> np.ndarray:
        """A row of parts for each piece, -1 behind the last."""
        wide = int(size.max())
        code = np.frombuffer(b"".join(w.ljust(wide, b"\0") for w in raw), np.uint8).reshape(len(raw), wide)
        cols = np.arange(wide)
        parts = np.where(cols < size[:, None], self.inner[code], -1)
        parts[np.arange(len(raw)), size - 1] = self.final[code[np.arange(len(raw)), size - 1]]
        ranks = np.full(parts.shape, NONE, np.int32)
        both = parts[:, 1:] >= 0
        ranks[:, :-1][both] = self.base[parts[:, :-1][both], parts[:, 1:][both]]
        live = np.arange(len(raw))
        done = parts
        while len(live):
            at = ranks.argmin(1)
            row = np.arange(len(live))
            least = ranks[row, at]
            more = least < NONE
            if not more.all():
                done[live[~more]] = parts[~more]
                live, parts, ranks, at, least = live[more], parts[more], ranks[more], at[more], least[more]
                row = np.arange(len(live))
                if not len(live):
                    break
            elif parts is done:
                parts = parts.copy()
            parts[row, at] = self.merged[least]
            move = np.minimum(cols + (cols > at[:, None]), wide - 1)
            parts, ranks = np.take_along_axis(parts, move, 1), np.take_along_axis(ranks, move, 1)
            parts[:, -1] = np.where(at < wide - 1, -1, parts[:, -1])
            ranks[:, -1] = NONE
            after = np.where(at + 1 < wide, parts[row, np.minimum(at + 1, wide - 1)], -1)
            ranks[row, at] = self.rank(parts[row, at], after)
            has = at > 0
            ranks[row[has], at[has] - 1] = self.rank(parts[row[has], at[has] - 1], parts[row[has], at[has]])
        return done

    def merge_long(self, word: bytes) -> np.ndarray:
        """The same merges for a long word, by a heap of (rank, place) over a linked list."""
        code = np.frombuffer(word, np.uint8)
        parts = self.inner[code].tolist()
        parts[-1] = int(self.final[code[-1]])
        n = len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        pairs = self.rank(np.array(parts[:-1]), np.array(parts[1:]))
        heap = [(int(r), i, parts[i], parts[i + 1]) for i, r in enumerate(pairs) if r < NONE]
        heapq.heapify(heap)
        known: dict[tuple[int, int], int] = {}

        def push(i: int, j: int) -> None:
            pair = (parts[i], parts[j])
            if pair not in known:
                known[pair] = int(self.rank(np.array([pair[0]]), np.array([pair[1]]))[0])
            if known[pair] < NONE:
                heapq.heappush(heap, (known[pair], i, *pair))

        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] == a else -1
            if j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = int(self.merged[rank]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
                push(i, after[j])
            if before[i] >= 0:
                push(before[i], i)
        return np.array([p for p in parts if p >= 0], np.int32)

    def normal(self, text: str) -> str:
        """NFC, white space to one space (a line end stays: it parts words), each character in lower case."""
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        return text.translate(LOWER) if CAPITALS.search(text) else text

    def split(self, text: str, lines: bool = True) -> list[str]:
        """The pieces of a normal text; ``lines``: with line ends as pieces of their own.

        To the library what is :func:`newer` is neither letter nor digit.
        """
        if not text.isascii() and not newer().isdisjoint(text):
            if self.strict is None:
                known = {k: rf"[\p{{{k}}}--[{''.join(map(regex.escape, sorted(newer())))}]]" for k in "LN"}
                exact = self.pattern.replace(r"\p{L}", known["L"]).replace(r"\p{N}", known["N"])
                self.strict = regex.compile("(?V1)" + exact), regex.compile(r"(?V1)\n|" + exact)
            return self.strict[lines].findall(text)
        return (self.lines if lines else self.pieces).findall(text)

    def piece_counts(self, text: str) -> np.ndarray:
        """How many pieces each line of the text has."""
        found = self.split(self.normal(text))
        ends = np.fromiter(map("\n".__eq__, found), bool, len(found))
        edges = np.concatenate([[-1], np.flatnonzero(ends), [len(found)]])
        return np.diff(edges) - 1

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For :class:`words.WordMemo`: flat ids and their number per word."""
        text = b"\n".join(words).decode("utf-8", "replace")
        if self.specials.search(text):
            odd = {w for w in text.split("\n") if self.specials.search(w)}
            each_word = text.split("\n")
            plain = [w.encode() for w in each_word if w not in odd]
            flat, lens = self.encode_words(plain) if plain else (np.empty(0, np.uint32), np.empty(0, np.int64))
            own = iter(np.split(flat, np.cumsum(lens)[:-1]))
            each = [self.encode_special(w) if w in odd else next(own) for w in each_word]
            return np.concatenate([np.empty(0, np.uint32), *each]), np.fromiter(map(len, each), np.int64, len(each))
        found = self.split(self.normal(text))
        ends = np.fromiter(map("\n".__eq__, found), bool, len(found))
        word = np.cumsum(ends)[~ends]
        pieces = [p for p in found if p != "\n"]
        rows = {p: i for i, p in enumerate(dict.fromkeys(pieces))}
        flat, starts, lens = self.merge([p.encode() for p in rows])
        at = np.fromiter(map(rows.__getitem__, pieces), np.int64, len(pieces))
        lens, starts = lens[at], starts[at]
        take = np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
        return flat[take], np.bincount(word, lens, len(words)).astype(np.int64)

    def encode_special(self, text: str) -> np.ndarray:
        """The ids of a word that holds special tokens' strings: those are cut out first, from the raw text."""
        flat, at = [np.empty(0, np.uint32)], 0
        for m in [*self.specials.finditer(text), None]:
            pieces = self.split(self.normal(text[at : m.start() if m else len(text)]), lines=False)
            ids, starts, size = self.merge([p.encode() for p in pieces])
            flat += [ids[a : a + k] for a, k in zip(starts, size, strict=True)]
            if m:
                flat.append(np.array([self.special[m[0]]], np.uint32))
                at = m.end()
        return np.concatenate(flat)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids as a tokenizer without a decoder gives it: tokens joined by a space."""
        return b" ".join(map(self.token_bytes.__getitem__, ids.tolist()))


@lru_cache(2)
def load(path: str) -> RankBpe:
    return RankBpe(path)


def lower_ascii(text: bytes) -> bytes:
    """A-Z in lower case, as the normaliser would later do; not where special tokens' strings may be.

    Nor where combining marks (U+0300-036F) stand: NFC comes before lower case, and some letters compose in one case only.
    """
    return text if b"<|" in text or b"\xcc" in text or b"\xcd" in text else text.lower()


@lru_cache(2)
def memo(path: str) -> W.WordMemo:
    return W.WordMemo(load(path).encode_words, prepare=lower_ascii)


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids) per row of ``docs``, with the ids' text again as ``decoded`` if asked for.

    A narrow step: no shuffle, one pass over the two columns. Text is cut at
    ASCII white space first, which the split pattern never crosses.
    """
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())] + [("decoded", pa.string())] * decoded
    out = pa.schema(fields)

    def run(batches):
        bpe, cache = load(tokenizer_path), memo(tokenizer_path)
        for batch in batches:
            texts = W.texts_of(batch["text"])
            for a, b in W.steps(texts):
                ids, lens = cache.texts(texts[a:b])
                cuts = np.cumsum(lens)[:-1]
                each = np.split(ids.astype("<u4", copy=False), cuts) if b > a else []
                cols = [batch["doc_id"].slice(a, b - a), pa.array(lens), pa.array([x.tobytes() for x in each], pa.binary())]
                if decoded:
                    cols.append(pa.array([bpe.decode(x) for x in each], pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(cols, schema=out)

    names = "doc_id long, n_tokens long, ids binary" + ", decoded string" * decoded
    return W.id_and_text(docs, id_col, text_col).mapInArrow(run, names)


def decode(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded) from binary ids; null ids decode to the empty text."""
    out = pa.schema([("doc_id", pa.int64()), ("decoded", pa.string())])

    def run(batches):
        bpe = load(tokenizer_path)
        for batch in batches:
            raw = [bpe.decode(np.frombuffer(x or b"", "<u4")) for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(raw, pa.binary()).cast(pa.string())], schema=out)

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("binary").alias("ids")).mapInArrow(run, "doc_id long, decoded string")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text decoded from them."""
    got = encode(W.documents(spark, sf_dir), tokenizer_path(), decoded=True)
    return got.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
