"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

Each piece of text is a row of symbols. The tree's leaves hold the merge ranks of neighbouring symbols, every node the
least rank below it and its leftmost place; the root therefore names the next merge, and a merge changes three leaves,
each repaired in logarithmic time (nodes have sixteen children). Merging ends when the root holds no rank. A word of n symbols costs O(n log n).

The vocabulary file is a parameter. Supported is what ``word_bpe_49k.json`` uses: NFC, white space as one blank, lower
case; pieces by the file's pattern; bytes as printable characters; an end-of-word suffix; added tokens found in raw text.

Defined results: a null text counts as empty and has no tokens; equal texts give equal ids; white-space-only text has no
tokens. Whole texts are encoded, however long.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import slices, texts

KEPT = 200_000  # entries of each cache generation; two generations are held of chunks and of pieces
_ODD = re.compile("[\x1c-\x1f\xaa\xb2\xb3\xb9\xba\xbc-\xbeİ]|[^\x00-ɏ]")
_FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
NONE = 1 << 62
FAN = 16


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Merger:
    """Merges one piece's symbols by a segment tree whose nodes have ``FAN`` children."""

    def __init__(self, merges: list[tuple[int, int, int]]):
        """merges: left, right and merged symbol, by rank."""
        self.rank = {(a, b): r for r, (a, b, _) in enumerate(merges)}
        self.merged = [c for _, _, c in merges]

    def run(self, ids: list[int]) -> list[int]:
        n = len(ids)
        if n < 2:
            return ids
        rank, merged = self.rank.get, self.merged
        # a leaf is rank << 32 | place, so the least leaf is the leftmost of the least rank
        leaves = [NONE if (r := rank(pair)) is None else r << 32 | i for i, pair in enumerate(zip(ids, ids[1:], strict=False))]
        levels = [leaves]
        while len(levels[-1]) > FAN:
            below = levels[-1]
            levels.append([min(below[i : i + FAN]) for i in range(0, len(below), FAN)])
        top = levels[-1]
        low = min(top)
        if low == NONE:
            return ids
        ids, after, before = list(ids), [*range(1, n), n], [-1, *range(n - 1)]
        deep = len(levels) > 1
        while low != NONE:
            i = low & 0xFFFFFFFF
            new = merged[low >> 32]
            j = after[i]
            k, h = after[j], before[i]
            ids[i], ids[j], after[i] = new, -1, k
            if k < n:
                before[k] = i
                leaves[j] = NONE
                leaves[i] = NONE if (r := rank((new, ids[k]))) is None else r << 32 | i
            else:
                leaves[i] = NONE
                if j < n - 1:
                    leaves[j] = NONE
            if h >= 0:
                leaves[h] = NONE if (r := rank((ids[h], new))) is None else r << 32 | h
            if deep:
                touched = {x // FAN for x in (h, i, j) if 0 <= x < n - 1}
                for below, level in zip(levels, levels[1:], strict=False):
                    for x in touched:
                        level[x] = min(below[x * FAN : x * FAN + FAN])
                    touched = {x // FAN for x in touched}
            low = min(top)
        return [x for x in ids if x >= 0]


class Tokenizer:
    """Encoder and decoder of one vocabulary file, with bounded caches of pieces."""

    def __init__(self, spec: str):
        t = json.loads(spec)
        model = t["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.tokens = {i: s for s, i in self.vocab.items()} | {a["id"]: a["content"] for a in t["added_tokens"]}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merger = Merger([(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in pairs])
        self.letters = byte_letters()
        self.byte_ids = [self.vocab[c] for c in self.letters]
        self.last_ids = [self.vocab[c + self.suffix] for c in self.letters]
        pattern = t["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self.added = {a["content"]: a["id"] for a in t["added_tokens"]}
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.young: dict[str, tuple[str, int, str]] = {}
        self.old: dict[str, tuple[str, int, str]] = {}
        self.young_pieces: dict[str, tuple[str, int, str]] = {}
        self.old_pieces: dict[str, tuple[str, int, str]] = {}

    def piece_ids(self, piece: str) -> list[int]:
        data = piece.encode("utf-8")
        return self.merger.run([self.byte_ids[b] for b in data[:-1]] + [self.last_ids[data[-1]]])

    def _piece(self, piece: str) -> tuple[str, int, str]:
        found = self.young_pieces.get(piece)
        if found is None:
            found = self.old_pieces.get(piece)
            if found is None:
                ids = self.piece_ids(piece)
                found = " ".join(map(str, ids)), len(ids), " ".join(map(self.tokens.__getitem__, ids))
            if len(piece) <= 64:
                if len(self.young_pieces) >= KEPT:
                    self.old_pieces, self.young_pieces = self.young_pieces, {}
                self.young_pieces[piece] = found
        return found

    def _made(self, pieces: list[str]) -> tuple[str, int, str]:
        if len(pieces) == 1:
            return self._piece(pieces[0])
        parts = [self._piece(p) for p in pieces]
        return " ".join([p[0] for p in parts]), sum([p[1] for p in parts]), " ".join([p[2] for p in parts])

    def _cached(self, chunk: str, plain: bool) -> tuple[str, int, str]:
        """ids as text, their number, and the decoded text of one chunk without white space."""
        found = self.old.get(chunk)
        if found is None:
            found = self._made(_FAST.findall(chunk) if plain else self.pieces.findall(chunk))
        if len(chunk) <= 64:
            if len(self.young) >= KEPT:
                self.old, self.young = self.young, {}
            self.young[chunk] = found
        return found

    def _parts(self, text: str) -> list[tuple[str, int, str]]:
        plain = not _ODD.search(text)
        if not plain:
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
            chunks = regex.findall(r"\P{White_Space}+", text)
        else:
            # pieces never cross white space, so the chunks between are encoded on their own
            chunks = text.lower().split()
        parts = list(map(self.young.get, chunks))
        if None in parts:
            parts = [p or self._cached(c, plain) for c, p in zip(chunks, parts, strict=True)]
        return parts

    def encode(self, text: str) -> tuple[str, int, str]:
        """ids in decimal, joined by blanks; their number; the decoded text."""
        if self.split_added and any(a in text for a in self.added):
            parts: list = []
            for s in self.split_added.split(text):
                parts += [(str(self.added[s]), 1, s)] if s in self.added else self._parts(s)
        else:
            parts = self._parts(text)
        if not parts:
            return "", 0, ""
        ids, sizes, back = zip(*parts, strict=True)
        return " ".join(ids), sum(sizes), " ".join(back)

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by blanks, as a file without a decoder asks for; ids that it doesn't know are left out."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


_LOADED: dict[str, Tokenizer] = {}


def _tokenizer(spec: str) -> Tokenizer:
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Tokenizer(spec)
    return _LOADED[key]


def encoded(docs: DataFrame, spec: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, if asked for); one pass, no shuffle.

    ``spec`` is the vocabulary file's JSON text; it reaches the executors by broadcast, not by a path.
    """
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches):
        t = _tokenizer(shared.value)
        for b in slices(batches, "text", 8 << 20):
            rows = []
            for text in texts(b.column("text")):
                ids, n, back = t.encode(text)
                rows.append((n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()) + (([*map(int, ids.split())],) if with_ids else ()))
            arrays = [b.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.string()) for k in (1, 2))]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array([r[3] for r in rows], pa.list_(pa.int32()))] if with_ids else []), ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
