"""Token ids of whole texts by the public tokenizer files.

``Encoder`` gives the ids of ``Tokenizer.encode(text, add_special_tokens=False)``.
Both public pipelines first split a text into pieces and then merge inside each
piece. For the byte-level file, whose ids are in merge order (looked at on
loading), tiktoken encodes texts whole. For the word file a piece always gets the same ids, so
each worker keeps the ids of frequent pieces and merges the others only. Texts with
characters outside ``_SAFE`` (whose class or case mapping another regular
expression library could judge differently) and texts that may hold special tokens go to the
tokenizers library whole.
"""

from __future__ import annotations

import json
import re
import struct

import numpy as np
import tiktoken
from tokenizers import Tokenizer

from habitnet.llm.common import worker_memo

_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_SAFE = re.compile(f"[\\x20-\\x7e\\n{_LETTER}]*")
_SUFFIXES = "'s|'t|'re|'ve|'m|'ll|'d"
#: The split patterns of the two public pipelines, as their files state them.
_WORD_FILE_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: How a byte-level file states its split, and the pattern which that stands for.
BYTE_LEVEL_SPLIT = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
BYTE_LEVEL_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The word file's splits for texts of ``_SAFE`` characters. Letters come first: what they match begins otherwise than the suffixes.
_WORD_PIECES = re.compile(f"[{_LETTER}]+|{_SUFFIXES}|[0-9]|[^\\s{_LETTER}0-9]+")
#: A sentence ends after . ! ? before white space, or before a line end.
_SENTENCE = re.compile("(?<=[.!?])(?=\\s)|(?<=\\S)(?=\\n)")
#: Pieces that one worker remembers, in each of two generations.
REMEMBERED = 300_000


def _visible_bytes() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others take U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b) if b in printable else chr(next(others)) for b in range(256)}


class _Remembered(dict):
    """text -> ids by ``make``; of an older generation only what is used again stays."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, text: str) -> bytes:
        ids = self.older.get(text)
        if ids is None:
            ids = self.make(text)
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[text] = ids
        return ids


def byte_level(spec: dict) -> tuple[list[bytes], tiktoken.Encoding | None]:
    """The bytes of a byte-level file's ids, and an encoding by tiktoken if the file's ids are in merge order, as that assumes."""
    model, added = spec["model"], spec.get("added_tokens", [])
    special = {t["content"] for t in added}
    byte_of = {c: b for b, c in _visible_bytes().items()}
    tokens = [b""] * (1 + max([*model["vocab"].values(), *(t["id"] for t in added)]))
    for token, i in [*model["vocab"].items(), *((t["content"], t["id"]) for t in added)]:
        tokens[i] = token.encode("utf-8") if token in special else bytes(byte_of[c] for c in token)
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    before = spec.get("pre_tokenizer") or {}
    plain = spec.get("normalizer") is None and {k: before.get(k) for k in BYTE_LEVEL_SPLIT} == BYTE_LEVEL_SPLIT
    if not plain or any(model["vocab"].get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
        return tokens, None
    ranks = {tokens[i]: i for t, i in model["vocab"].items() if t not in special}
    return tokens, tiktoken.Encoding("bytes", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        before = spec.get("pre_tokenizer") or {}
        self.fast, self.by_words = None, False
        if before.get("type") == "ByteLevel":
            tokens, self.fast = byte_level(spec)
            self.length = np.array([len(t) for t in tokens], np.int64)
        elif before.get("type") == "Sequence":
            self.by_words = before["pretokenizers"][0].get("pattern") == {"Regex": _WORD_FILE_PATTERN}
        model, alphabet = self.whole.model, _visible_bytes()

        def merged(piece: str) -> bytes:
            raw = piece.encode("utf-8")
            ids = [t.id for t in model.tokenize(raw.decode("latin-1").translate(alphabet))]
            return struct.pack(f"<{len(ids)}I", *ids)

        pieces = _Remembered(merged)

        def chunk_ids(chunk: str) -> bytes:
            found = _WORD_PIECES.findall(chunk)
            return merged(chunk) if len(found) == 1 and found[0] == chunk else b"".join(map(pieces.__getitem__, found))

        self.chunks = _Remembered(chunk_ids)

    def _safe(self, text: str) -> bool:
        return _SAFE.fullmatch(text) is not None and not any(s in text for s in self.special)

    def _joined(self, text: str) -> bytes:
        return b"".join(map(self.chunks.__getitem__, text.split()))

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit integers."""
        if (self.fast or self.by_words) and self._safe(text):
            return self.fast.encode_to_numpy(text, disallowed_special=()).tobytes() if self.fast else self._joined(text.lower())
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode_with_ends(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``text``, and how many there are up to each end of a sentence (the last one: all).

        White space belongs to the piece that it precedes, and no piece holds
        both a character and white space after it, so sentences end where ids do.
        """
        if self.fast and self._safe(text):
            ids = self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
            return ids, _cuts(np.searchsorted(np.cumsum(self.length[ids]), _sentence_ends(text.encode("utf-8")), "right"), len(ids))
        if self.by_words and self._safe(text):
            parts = [self._joined(part) for part in _SENTENCE.split(text.lower())]
            ends = np.cumsum([len(part) // 4 for part in parts])
            return np.frombuffer(b"".join(parts), "<u4"), _cuts(ends, int(ends[-1]))
        got = self.whole.encode(text, add_special_tokens=False)
        begins = np.array([a for a, _ in got.offsets], np.int64)
        ends = np.searchsorted(begins, [m.start() for m in _SENTENCE.finditer(text)], "left")
        return np.array(got.ids, "<u4"), _cuts(ends, len(got.ids))

    def encode_sentences(self, text: str) -> list[bytes]:
        """``encode(text)`` in parts that end where sentences do."""
        ids, ends = self.encode_with_ends(text)
        raw, places = ids.tobytes(), (4 * ends).tolist()
        return [raw[a:b] for a, b in zip([0, *places[:-1]], places)]


def _sentence_ends(raw: bytes) -> np.ndarray:
    """Where ``_SENTENCE`` matches, in bytes, for a text of ``_SAFE`` characters: its white space is blanks and line ends."""
    at = np.frombuffer(raw, np.uint8)
    here, after = at[:-1], at[1:]
    line = after == 10
    stop = (here == 46) | (here == 33) | (here == 63)
    return np.flatnonzero((stop & (line | (after == 32))) | (line & (here != 32) & (here != 10))) + 1


def _cuts(ends: np.ndarray, n: int) -> np.ndarray:
    """``ends`` without repeats and nought, closed by ``n``."""
    ends = np.unique(np.append(ends, n)).astype(np.int64)
    return ends[ends > 0]


def encoder(path: str) -> Encoder:
    """The worker's encoder for the file at ``path``, made once."""
    memo = worker_memo()
    key = f"encoder:{path}"
    if key not in memo:
        memo[key] = Encoder(path)
    return memo[key]
