"""Exact library encoding, through a bounded memo of white-space-delimited chunks where the tokenizer allows it.

Whether it does is read from the tokenizer's definition: its normaliser, pre-tokenizer and added tokens must be of
the forms below, under which no token spans from a non-space character to a following space and nothing looks
further than the white space run that precedes a chunk. A text's encoding is then the concatenation of its chunks'
encodings, and natural text repeats its chunks. Every chunk's ids come from the library itself; only repeats are
answered from the memo, whose size is bounded. Under any other tokenizer every text goes to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable

import numpy as np

#: Chunks kept for good by a worker (the first ones seen, so the frequent ones), and of later ones until the
#: next emptying; about 200 bytes each.
MEMO_CHUNKS = 800_000
MEMO_LATER = 200_000
#: Longer chunks are junk that seldom repeats; they are encoded each time.
MEMO_LENGTH = 48
#: White space as the byte-level pre-tokenizer's pattern knows it (fixed values: Unicode White_Space).
_WS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")

# The forms of a definition under which texts may be taken apart at white space.
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORD_NORMALISERS = ({"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"})

_TOKENIZERS: dict[str, object] = {}
_ENCODERS: dict[tuple, object] = {}


def tokenizer(path: str):
    """The tokenizer of a file, loaded once a worker."""
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = Tokenizer.from_file(path)
    return _TOKENIZERS[path]


def encoder(kind: type, path: str):
    """The encoder of a file; a worker that runs several tasks keeps its memo."""
    if (kind, path) not in _ENCODERS:
        _ENCODERS[kind, path] = kind(path)
    return _ENCODERS[kind, path]


def _parts(step: dict | None, name: str) -> list[dict]:
    """The steps of a normaliser or pre-tokenizer, a sequence or not."""
    return [] if step is None else step[name] if step["type"] == "Sequence" else [step]


def _apart(definition: dict) -> bool:
    """Whether nothing outside normaliser and pre-tokenizer ties chunks together."""
    plain = not any(definition.get(k) for k in ("truncation", "padding", "post_processor"))
    marks = ("single_word", "lstrip", "rstrip", "normalized")
    return plain and not any(t[m] for t in definition["added_tokens"] for m in marks) and not any(c.isspace() for t in definition["added_tokens"] for c in t["content"])


def drops_space(definition: dict) -> tuple[bool, bool]:
    """(whether words between white space are encoded one by one, whether the case of ASCII letters does not matter),
    by a tokenizer's definition: words, single digits and marks are pre-tokens of their own, white space is none."""
    steps = _parts(definition["pre_tokenizer"], "pretokenizers")
    split = {"type": "Split", "pattern": {"Regex": _WORD_SPLIT}, "behavior": "Removed", "invert": True}
    bytes_too = len(steps) == 2 and steps[1]["type"] == "ByteLevel" and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
    norm = _parts(definition["normalizer"], "normalizers")
    fits = _apart(definition) and bytes_too and steps[0] == split and all(n in _WORD_NORMALISERS for n in norm)
    return fits, fits and {"type": "Lowercase"} in norm


def keeps_space(definition: dict) -> bool:
    """Whether white space goes with the chunk after it: the byte-level pattern, without a prefix, without a normaliser."""
    step = definition["pre_tokenizer"] or {}
    return _apart(definition) and definition["normalizer"] is None and step.get("type") == "ByteLevel" and step["use_regex"] and not step["add_prefix_space"]


class ChunkMemo:
    """Packed results by chunk; ``compute`` gets the distinct chunks of a text that are not known yet."""

    def __init__(self, compute: Callable[[list], list[bytes]]):
        self.compute = compute
        self.first: dict = {}
        self.later: dict = {}

    def peek(self, chunk: object) -> bytes | None:
        found = self.first.get(chunk)
        return self.later.get(chunk) if found is None else found

    def put(self, known: dict) -> None:
        if len(self.first) < MEMO_CHUNKS:
            self.first.update((c, v) for c, v in known.items() if len(c) <= MEMO_LENGTH)

    def get(self, chunks: list) -> list[bytes]:
        found = list(map(self.first.get, chunks))
        if None not in found:
            return found
        later = self.later
        missing = {c for c, f in zip(chunks, found, strict=True) if f is None}
        if new := [c for c in missing if c not in later]:
            if len(self.first) < MEMO_CHUNKS:
                target = self.first
            else:
                if len(later) > MEMO_LATER:
                    kept = {c: later[c] for c in missing if c in later}
                    later.clear()
                    later.update(kept)
                target = later
            own = dict(zip(new, self.compute(new), strict=True))
            target.update((c, v) for c, v in own.items() if len(c) <= MEMO_LENGTH)
        else:
            own = {}
        return [f if f is not None else own[c] if c in own else later[c] for c, f in zip(chunks, found, strict=True)]


class WordEncoder:
    """Ids of texts, word by word where the pre-tokenizer drops white space.

    ``packed(text)`` holds ``Tokenizer.encode(text, add_special_tokens=False).ids`` as little-endian numbers of
    ``dtype``.
    """

    def __init__(self, path: str):
        self.library = tokenizer(path)
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.memo = ChunkMemo(self._encode)
        definition = json.loads(self.library.to_str())
        #: ``folds``: an ASCII word's case does not matter either, and a comma or stop after it is a token run of its own.
        self.by_word, self.folds = drops_space(definition)
        self.folds &= not any(t["content"].isalpha() for t in definition["added_tokens"])
        marks = [b",", b"."] if self.folds else []
        self.tails = dict(zip(marks, self._library(marks), strict=True))

    def _library(self, pieces: list[bytes]) -> list[bytes]:
        found = self.library.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in found]

    def _encode(self, pieces: list[bytes]) -> list[bytes]:
        """An ASCII word is looked up without its case and final mark first; the rest goes to the library."""
        parts, new = [], {}
        for p in pieces:
            tail = self.tails.get(p[-1:], b"") if len(p) > 1 else b""
            stem = p[:-1] if tail else p
            if self.folds and stem.isalpha():
                stem = stem.lower()
                known = self.memo.peek(stem)
            else:
                stem, tail, known = p, b"", None
            if known is None:
                new[stem] = None
            parts.append((stem, tail, known))
        if new:
            new = dict(zip(new, self._library(list(new)), strict=True))
            self.memo.put(new)
        return [(new[stem] if known is None else known) + tail for stem, tail, known in parts]

    def packed(self, text: str) -> bytes:
        if not self.by_word:
            return self._library([text.encode()])[0]
        return b"".join(self.memo.get(text.encode().split()))


class SpanEncoder:
    """Character spans of the tokens of texts, chunk by chunk under a byte-level tokenizer (white space stays in tokens)."""

    def __init__(self, path: str):
        self.library = tokenizer(path)
        self.memo = ChunkMemo(self._encode)
        self.by_chunk = keeps_space(json.loads(self.library.to_str()))

    def _encode(self, chunks: list[str]) -> list[bytes]:
        found = self.library.encode_batch(chunks, add_special_tokens=False)
        return [np.array(e.offsets, "<i4").tobytes() for e in found]

    def spans(self, text: str) -> np.ndarray:
        """(start, end) in code points of every token, in order."""
        if not self.by_chunk:
            return np.frombuffer(self._encode([text])[0], "<i4").reshape(-1, 2).astype(np.int64)
        chunks = _CHUNK.findall(text)
        if not chunks:
            return np.empty((0, 2), np.int64)
        found = self.memo.get(chunks)
        starts = np.zeros(len(chunks), np.int64)
        np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks))[:-1], out=starts[1:])
        counts = np.fromiter(map(len, found), np.int64, len(found)) // 8
        return np.frombuffer(b"".join(found), "<i4").reshape(-1, 2) + np.repeat(starts, counts)[:, None]
