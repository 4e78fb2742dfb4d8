"""Byte-level BPE encoding over a trie of distinct words, and decoding."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqltrail.llm.common import pieces, ship_code, text_of

# Fixed value: how the vocabulary's pre-tokenizer cuts a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Encoded words that a Python worker remembers between batches, and the longest of them in characters.
REMEMBERED, LONGEST = 700_000, 48


def _byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in a byte-level vocabulary."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    signs = {chr(b): b for b in shown}
    hidden = [b for b in range(256) if chr(b) not in signs]
    return signs | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Node:
    """An edge of the trie and its lower end: bytes `start` to `end` of `word`, and what lies below."""

    __slots__ = ("start", "end", "word", "below", "whole")

    def __init__(self, start: int, end: int, word: bytes, whole: bool):
        self.start, self.end, self.word, self.whole, self.below = start, end, word, whole, []


def _shared(a: bytes, b: bytes) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def build_trie(words: list[bytes]) -> _Node:
    """A trie of distinct, non-empty words with one edge per unbranched stretch."""
    root = _Node(0, 0, b"", False)
    path, before = [root], b""
    for word in sorted(words):
        n = _shared(before, word)
        while path[-1].end > n:
            last = path.pop()
            if path[-1].end < n:
                fork = _Node(last.start, n, last.word, False)
                last.start = n
                fork.below.append(last)
                path[-1].below[-1] = fork
                path.append(fork)
        leaf = _Node(path[-1].end, len(word), word, True)
        path[-1].below.append(leaf)
        path.append(leaf)
        before = word
    return root


class BytePairs:
    """A byte-level BPE vocabulary.

    The encoding of a word is determined by the last token of each of its prefixes: a token may follow
    another if merging the two texts together leaves them as they are, and exactly one token that ends
    at a place may follow the encoding of what stands before it.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        signs, model = _byte_signs(), data["model"]
        plain = lambda sign: bytes(signs[c] for c in sign)
        self.ids = {plain(sign): i for sign, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.texts = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.ranks: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = map(plain, merge if isinstance(merge, list) else merge.split(" "))
            a, b, made = self.ids[left], self.ids[right], self.ids[left + right]
            self.ranks[a, b] = rank
            self.parts.setdefault(made, (rank, a, b))
        self.code = {i: i.to_bytes(4, "little") for i in self.texts}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._wholes: dict[int, bool] = {}
        self._spines: tuple[dict, dict] = ({}, {})
        self.standing = {text: i for text, i in self.ids.items() if self.stands(i)}
        # Lengths of the tokens that end in four given bytes, and of those that are shorter than that.
        sizes: dict[bytes, set[int]] = {}
        for text in self.standing:
            if len(text) > 3:
                sizes.setdefault(text[-4:], set()).add(len(text))
        self.sizes = {tail: (*sorted(found, reverse=True), 3, 2, 1) for tail, found in sizes.items()}

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that the left (0) or right (1) edge of `token` passes through, each with the rank that ends it."""
        if (found := self._spines[side].get(token)) is None:
            found, ends, at = [], float("inf"), token
            while True:
                found.append((at, ends))
                if at not in self.parts:
                    break
                ends, at = self.parts[at][0], self.parts[at][1 + side]
            self._spines[side][token] = found
        return found

    def follows(self, a: int, b: int) -> bool:
        """Whether token `b` may stand after `a`: no merge over their border comes before both are complete."""
        if (found := self._pairs.get((a, b))) is None:
            found = True
            for x, x_ends in self._spine(a, 1):
                for y, y_ends in self._spine(b, 0):
                    rank = self.ranks.get((x, y))
                    # Of equal merges the one further left comes first.
                    if rank is not None and rank < x_ends and rank <= y_ends:
                        found = False
            self._pairs[a, b] = found
        return found

    def stands(self, token: int) -> bool:
        """Whether the text of a token is encoded as that token."""
        if (found := self._wholes.get(token)) is None:
            if token in self.parts:
                _, a, b = self.parts[token]
                found = self.stands(a) and self.stands(b) and not self._cut_before(token, a, b)
            else:
                found = True
            self._wholes[token] = found
        return found

    def _cut_before(self, token: int, a: int, b: int) -> bool:
        """Whether another merge over the border of the two parts comes before the one that makes `token`."""
        made = self.parts[token][0]
        for x, x_ends in self._spine(a, 1):
            for y, y_ends in self._spine(b, 0):
                rank = self.ranks.get((x, y))
                if rank is not None and (x, y) != (a, b) and rank < min(x_ends, made) and rank <= min(y_ends, made):
                    return True
        return False

    def encode_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Little-endian 32-bit ids for distinct words; what they share in front is encoded once."""
        out: dict[bytes, bytes] = {}
        longest = max(map(len, words), default=0)
        last, size = [0] * (longest + 1), [0] * (longest + 1)
        ids, sizes, pairs, follows, short = self.standing.get, self.sizes.get, self._pairs.get, self.follows, (3, 2, 1)
        code = self.code
        stack = [build_trie(words)]
        while stack:
            node = stack.pop()
            word = node.word
            for end in range(node.start + 1, node.end + 1):
                for n in sizes(word[end - 4 : end], short) if end > 3 else short[3 - end :]:
                    if n <= end and (token := ids(word[end - n : end])) is not None:
                        before = last[end - n]
                        if n == end or ((ok := pairs((before, token))) is None and follows(before, token)) or ok:
                            last[end], size[end] = token, n
                            break
            if node.whole:
                found, at = [], node.end
                while at:
                    found.append(last[at])
                    at -= size[at]
                out[word] = b"".join([code[t] for t in reversed(found)])
            stack.extend(reversed(node.below))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens included; bytes that are no UTF-8 are replaced."""
        return b"".join(map(self.texts.__getitem__, ids.tolist())).decode("utf-8", "replace")


class Encoder:
    """Encodes whole texts and remembers a bounded number of words."""

    def __init__(self, path: str, special: bool = True):
        import regex

        self.pairs, self.words = BytePairs(path), regex.compile(WORDS)
        # The same cut for texts within Latin-1, whose letters, digits and spaces are few enough to list.
        listed = {c: "".join(re.escape(s) for s in map(chr, range(256)) if regex.match(c, s)) for c in (r"\p{L}", r"\p{N}", r"\s")}
        letters, digits, spaces = listed.values()
        self.latin_words = re.compile(
            rf" ?[{letters}]+| ?[{digits}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{spaces}{letters}{digits}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+"
        )
        self.cuts = regex.compile("(" + "|".join(map(regex.escape, self.pairs.special)) + ")") if special and self.pairs.special else None
        self.known: dict[str, bytes] = {}

    def _cut(self, text: str) -> list[str]:
        """Words of a text; a special token is an item of its own, found in `special`."""
        try:
            text.encode("latin-1")
            findall = self.latin_words.findall
        except UnicodeEncodeError:
            findall = self.words.findall
        if self.cuts is None or not any(s in text for s in self.pairs.special):
            return findall(text)
        found = []
        for i, part in enumerate(self.cuts.split(text)):
            found += [part] if i % 2 else findall(part)
        return found

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        special = {s: np.array([i], "<u4").tobytes() for s, i in self.pairs.special.items()} if self.cuts else {}
        cut = [self._cut(text) for text in texts]
        words = set().union(*cut) - special.keys()
        known = self.known
        fresh = [w for w in words if w not in known]
        made = self.pairs.encode_words([w.encode() for w in fresh])
        known.update((w, made[w.encode()]) for w in fresh)
        known |= special
        for found in cut:
            yield b"".join(map(known.__getitem__, found))
        for word in [*special, *(w for w in fresh if len(w) > LONGEST)]:
            del known[word]
        if len(known) > REMEMBERED:
            for word in list(islice(known, len(known) - REMEMBERED // 2)):
                del known[word]


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, special: bool = True) -> Encoder:
    """The encoder of this Python worker for a vocabulary file; without `special`, special tokens are ordinary text."""
    if (path, special) not in _ENCODERS:
        _ENCODERS[path, special] = Encoder(path, special)
    return _ENCODERS[path, special]


SCHEMA = "doc_id long, n_tokens long, ids binary, decoded string"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False
) -> DataFrame:
    """`doc_id, n_tokens, ids, decoded`: every whole text encoded and decoded again, or digests of both.

    `ids` are little-endian unsigned 32-bit integers. The vocabulary file at `path` must be there on every
    machine. Special tokens in a text are encoded as such. Null and empty texts have no ids. Rows are
    independent: repeated rows and ids give repeated results, other columns are ignored, and nothing is
    shuffled. Words over LONGEST characters are encoded anew in each batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for piece in pieces(batches, most=6 << 20):
            ids, texts = piece.column(0), piece.column(1).to_pylist()
            counts, codes, decoded = [], [], []
            for code in coder.encode(texts):
                text = coder.pairs.decode(np.frombuffer(code, "<u4"))
                counts.append(len(code) // 4)
                codes.append(hashlib.sha256(code).hexdigest() if digests else code)
                decoded.append(hashlib.sha256(text.encode()).hexdigest() if digests else text)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(counts, pa.int64()), pa.array(codes), pa.array(decoded)],
                ["doc_id", "n_tokens", "ids_sha256" if digests else "ids", "decoded_sha256" if digests else "decoded"],
            )

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return ship_code(rows).mapInArrow(run, DIGESTS if digests else SCHEMA)
