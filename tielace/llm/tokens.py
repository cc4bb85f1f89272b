"""Token ids of whole texts, as the tokenizers library gives them, with each distinct word encoded once."""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words whose ids a task keeps at hand, in each of two generations: what the older one has and the newer one
#: doesn't ask for goes when the newer one is full.
KEPT_WORDS = 120_000
#: Words that are encoded as one text.
JOINED = 64
#: New words that are encoded at once.
LEARNED = 50_000
#: Latin letters with at most one full stop or comma after them.
LETTERS = r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+[.,]?"
SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"


def public_file(name: str) -> str:
    """A public tokenizer's file: of the installed package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Stretches of flat, one after the other."""
    before = np.cumsum(size) - size
    return flat[np.repeat(start - before, size) + np.arange(int(size.sum()))]


class _Words:
    """Distinct words with their ids, all ids in one array."""

    def __init__(self):
        self.names = pa.chunked_array([pa.array([], pa.string())])
        self.flat, self.start, self.length, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def add(self, names: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        n, m = len(self.names), len(names)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + m > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[n : n + m] = self.used + np.cumsum(sizes) - sizes
        self.length[n : n + m] = sizes
        self.used += len(ids)
        self.names = pa.chunked_array([*self.names.chunks, names])

    def slots(self, names: pa.Array) -> np.ndarray:
        """Where they are; -1 for unknown ones."""
        return pc.fill_null(pc.index_in(names, value_set=self.names), -1).to_numpy().astype(np.int64)


class WordEncoder:
    """ids of texts by a tokenizers file, as the library gives them: an added token's string in a text is that token.

    Both kinds of tokenizer here split at a lone space before anything else looks at both of its sides, so a text's
    ids are those of its words, put together: with the byte-level kind a word takes the space before it, with the
    other kind spaces vanish. Texts in which a space stands beside other white space go to the tokenizer whole where
    that matters, and so do texts with an added token's string.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            text = f.read()
        self.tokenizer = Tokenizer.from_str(text)
        # The strings of added tokens, in whatever case: a tokenizer may look for them after lowering.
        bare = json.loads(text)
        self.added = "|".join(re.escape(t["content"]) for t in bare["added_tokens"])
        self.keeps_space = self.tokenizer.normalizer is None
        # The same model without what does nothing to stems of small Latin letters: normalising and the split pattern.
        split = {"type": "Split", "pattern": {"String": " "}, "behavior": "MergedWithNext", "invert": False} if self.keeps_space else {"type": "WhitespaceSplit"}
        as_bytes = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        bare |= {"normalizer": None, "post_processor": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [split, as_bytes]}}
        self.stems = Tokenizer.from_str(json.dumps(bare))
        # A full stop or comma after a letter is a part by itself, of one id.
        self.stops = {c: self.tokenizer.encode(c, add_special_tokens=False).ids[0] for c in ".,"}
        # Ids that begin a word with its space, or that end a word.
        self.marks = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.marks[i] = token.startswith("\u0120") if self.keeps_space else token.endswith("</w>")
        self.new, self.old = _Words(), _Words()

    def _learn(self, words: pa.Array) -> None:
        """Add words: Latin letters, with at most one stop after them, many at once by their stems; others alone."""
        fits = pc.match_substring_regex(words, f"^{' ' if self.keeps_space else ''}{LETTERS}$")
        joined, alone = words.filter(fits), words.filter(pc.invert(fits))
        if len(joined):
            last = pc.utf8_slice_codeunits(joined, -1)
            stop = np.full(len(joined), -1, np.int64)
            for c, i in self.stops.items():
                stop[pc.equal(last, c).to_numpy(zero_copy_only=False)] = i
            stems = pc.utf8_rtrim(joined, ".,")
            if not self.keeps_space:
                stems = pc.utf8_lower(stems)
            distinct = stems.dictionary_encode()
            names, at = distinct.dictionary.to_pylist(), distinct.indices.to_numpy().astype(np.int64)
            between = "" if self.keeps_space else " "
            parts = [between.join(names[k : k + JOINED]) for k in range(0, len(names), JOINED)]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.stems.encode_batch_fast(parts, add_special_tokens=False)])
            marks = np.flatnonzero(self.marks[ids])
            assert len(marks) == len(names), "a word without its mark"
            start = marks if self.keeps_space else np.concatenate([[0], marks[:-1] + 1])
            size = np.diff(np.append(start, len(ids)))
            found, sizes, has = _gather(ids, start[at], size[at]), size[at], stop >= 0
            found = np.insert(found, np.cumsum(sizes)[has], stop[has].astype(np.uint32))
            self.new.add(joined, found, sizes + has)
        if len(alone):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(alone.to_pylist(), add_special_tokens=False)]
            self.new.add(alone, np.array([i for x in ids for i in x], np.uint32), np.fromiter(map(len, ids), np.int64, len(ids)))

    def _slots(self, words: pa.Array) -> np.ndarray:
        """Where the newer generation has these distinct words, all of which it has afterwards."""
        if len(self.new.names) > KEPT_WORDS:
            self.old, self.new = self.new, _Words()
        slots = self.new.slots(words)
        if (lacks := np.flatnonzero(slots < 0)).size:
            missing, first = words.take(pa.array(lacks)), len(self.new.names)
            at = self.old.slots(missing)
            if (known := at >= 0).any():
                own = at[known]
                self.new.add(missing.filter(pa.array(known)), _gather(self.old.flat, self.old.start[own], self.old.length[own]), self.old.length[own])
            unknown = missing.filter(pa.array(~known))
            for k in range(0, len(unknown), LEARNED):
                self._learn(unknown.slice(k, LEARNED))
            added = pa.chunked_array(self.new.names.slice(first).chunks)
            slots[lacks] = first + pc.index_in(missing, value_set=added).to_numpy().astype(np.int64)
        return slots

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (unsigned 32 bit) one after the other, and the number of ids of each text; null is empty."""
        texts = pc.fill_null(texts, "")
        if not self.keeps_space:  # all white space vanishes alike
            texts = pc.replace_substring(texts, "\n", " ")
        whole = np.zeros(len(texts), bool)
        if self.keeps_space:
            whole = pc.match_substring_regex(texts, f" {SPACE}|{SPACE} ").to_numpy(zero_copy_only=False)
        if self.added:
            whole |= pc.match_substring_regex(texts, self.added, ignore_case=True).to_numpy(zero_copy_only=False)
        words = pc.split_pattern(pc.if_else(pa.array(whole), "", texts), " ")
        found = words.flatten().dictionary_encode()
        codes, names = found.indices.to_numpy().astype(np.int64), found.dictionary
        ends = np.cumsum(pc.list_value_length(words).to_numpy().astype(np.int64))
        starts = np.concatenate([[0], ends[:-1]])
        if self.keeps_space:
            first = np.zeros(len(codes), np.int64)
            first[starts] = 1
            distinct, codes = np.unique(codes * 2 + first, return_inverse=True)
            names = names.take(pa.array(distinct >> 1))
            names = pc.if_else(pa.array(distinct & 1 == 1), names, pc.binary_join_element_wise(" ", names, ""))
        slots = self._slots(names)[codes]
        sizes = self.new.length[slots]
        ids = _gather(self.new.flat, self.new.start[slots], sizes)
        counts = np.add.reduceat(sizes, starts) if len(texts) else np.zeros(0, np.int64)
        if whole.any():
            at = np.flatnonzero(whole)
            own = [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) for t in texts.take(pa.array(at)).to_pylist()]
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for i, x in zip(at.tolist(), own, strict=True):
                parts[i] = x
                counts[i] = len(x)
            ids = np.concatenate(parts)
        return ids, counts


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with the end id after each text's ids."""
    return np.insert(ids, np.cumsum(counts), np.uint32(end)), counts + 1


_encoders: dict[str, WordEncoder] = {}


def kept_encoder(path: str) -> WordEncoder:
    """An encoder that stays with the Python worker, so that its next tasks begin with the words it knows."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
