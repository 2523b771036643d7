"""Token ids of whole texts by the tokenizers library, encoding each distinct chunk of a text once.

A text is cut where the tokenizer's own pre-tokenizer always cuts, so that the
ids of the chunks, joined, are the ids of the text. Two kinds of tokenizer.json
are known; for any other, the whole text is one chunk.

* byte level with the built-in pattern and no normaliser: that pattern never
  joins white space to what precedes it, so a cut before each space that
  follows a non-space is safe. Texts with other runs of white space before a
  space are encoded whole.
* a split that drops white space: any space or line feed is a safe cut.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

#: Distinct chunks that a worker remembers; beyond this it drops those seen least.
MEMO_CHUNKS = 1_300_000


class _Memo(dict):
    """chunk -> row number; unknown chunks get the next number and queue in `new`."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self.new.append(chunk)
        n = self[chunk] = len(self)
        return n


def _kind(spec: dict) -> str:
    pre = spec.get("pre_tokenizer") or {}
    if any(" " in t["content"] or "\n" in t["content"] or t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens", [])):
        return "whole"
    if spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "byte"
    steps = pre.get("pretokenizers") or []
    first = steps[0] if steps else {}
    names = {n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])}
    drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and "[^\\s\\p{L}\\p{N}]+" in first["pattern"].get("Regex", "")
    later = all(s["type"] == "ByteLevel" and not s.get("use_regex") and not s.get("add_prefix_space") for s in steps[1:])
    return "space" if drops and later and names <= {"NFC", "Replace", "Lowercase"} else "whole"


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + size[0] - 1, start[1] .. and so on, in one array."""
    size = size.astype(np.int64)
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


class TextEncoder:
    """encode(texts) gives all ids in one array and the number of ids of each text."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as f:
            self.kind = _kind(json.load(f))
        self._reset()

    def _reset(self) -> None:
        self.memo = _Memo()
        self.flat = np.zeros(0, np.uint32)
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int32)
        self.whole = np.zeros(0, bool)
        self.used = np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Drop the chunks that were seen least, at least half of them."""
        keep = self.used > max(1, int(np.median(self.used)))
        keys = [k for k, stays in zip(self.memo, keep, strict=True) if stays]
        start, length, whole = self.start[keep], self.length[keep], self.whole[keep]
        flat = self.flat[ranges(start, length)]
        self._reset()
        self.memo.update(zip(keys, range(len(keys)), strict=True))
        self.flat, self.length, self.whole = flat, length, whole
        self.start = np.cumsum(length, dtype=np.int64) - length
        self.used = np.zeros(len(keys), np.int64)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self) -> None:
        new, self.memo.new = self.memo.new, []
        if not new:
            return
        ids: list[int] = []
        owners = []
        for at in range(0, len(new), 1024):
            found = self.tokenizer.encode(new[at : at + 1024], is_pretokenized=True, add_special_tokens=False)
            ids += found.ids
            owners.append(np.array(found.word_ids, np.int64) + at)
        length = np.bincount(np.concatenate(owners), minlength=len(new)).astype(np.int32)
        self.start = np.append(self.start, len(self.flat) + np.cumsum(length, dtype=np.int64) - length)
        self.flat, self.length = np.append(self.flat, np.array(ids, np.uint32)), np.append(self.length, length)
        # Within the byte kind a chunk that is empty or ends in white space may belong together with the next one.
        odd = [self.kind == "byte" and (c in ("", " ") or c[-1].isspace()) for c in new]
        self.whole = np.append(self.whole, np.array(odd, bool))
        self.used = np.append(self.used, np.zeros(len(new), np.int64))

    def _chunks(self, text: str) -> list[str]:
        if self.kind == "space":
            return text.replace("\n", " ").split(" ")
        if self.kind == "byte":
            first, *rest = text.split(" ")
            # The first chunk has no space before it.
            return [first, *[" " + x for x in rest]] if rest else [first]
        return [text]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.memo) > MEMO_CHUNKS:
            self._forget()
        if self.kind == "whole":
            ids = self._library(texts)
            length = np.fromiter(map(len, ids), np.int64, len(ids))
            return np.fromiter((i for x in ids for i in x), np.uint32, int(length.sum())), length
        get = self.memo.__getitem__
        rows = []
        for text in texts:
            chunks = self._chunks(text)
            rows.append(np.fromiter(map(get, chunks), np.int32, len(chunks)))
        self._learn()
        counts = np.fromiter(map(len, rows), np.int64, len(rows))
        every = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        ends = np.cumsum(counts)
        self.used += np.bincount(every, minlength=len(self.used))
        sizes = self.length[every].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(sizes)])
        out = self.flat[ranges(self.start[every], sizes)]
        length = total[ends] - total[ends - counts]
        odd = np.concatenate([[0], np.cumsum(self.whole[every])])
        again = np.flatnonzero(odd[ends] - odd[ends - counts])
        if len(again):
            parts = np.split(out, np.cumsum(length)[:-1])
            for k, ids in zip(again, self._library([texts[k] for k in again]), strict=True):
                parts[k] = np.array(ids, np.uint32)
            length = np.fromiter(map(len, parts), np.int64, len(parts))
            out = np.concatenate(parts)
        return out, length

    def counts(self, texts: list[str]) -> np.ndarray:
        return self.encode(texts)[1]


@lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    """One encoder for each worker and file, so that its memory of chunks serves all tasks of the worker."""
    return TextEncoder(path)


def id_type(path: str) -> str:
    """The narrowest little-endian type that holds every id of the vocabulary."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
