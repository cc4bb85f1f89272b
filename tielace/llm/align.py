"""Alignment of two tokenizers' ids by the byte offsets at which tokens of both end."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import Scratch, pick, text_batches, tidy
from .tokens import public_file

#: Tables of pair counts of at most this many rows (24 bytes each) are broadcast; larger ones are joined by a shuffle.
BROADCAST_PAIRS = 2_000_000
#: Bytes of text that are aligned at once; the groups written out take about eight times as many.
TEXT_BYTES = 1 << 20
#: A slice with more links than this is linked by its distinct ids, so that ids which repeat in it aren't expanded.
WIDE_SLICE = 1 << 12

#: Fixed value: the parts that byte-level merges stay within.
BYTE_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that are tokenized as one text.
JOINED = 500
_WHITE = r"\s\x1c-\x1f\x85"
_BESIDE_WHITE = re.compile(rf"[{_WHITE}] | [{_WHITE}]")
_LONE_SPACE = re.compile(rf"(?<=[^{_WHITE}]) (?=[^{_WHITE}])")
_UNUSUAL = re.compile("[^\t\n\r -~\u00a1-\u00ac\u00ae-\u024f\u2010-\u2027\u20ac]")
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")

COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "groups", "pairs")
PAIRS = "array<struct<pair:bigint,times:bigint>>"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def shared_cuts(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte offsets at which tokens of both end, in order, and how many tokens of A and of B end by each of them.

    Each side's cumulative ends are keys of a dictionary to the token's index, and the keys that both have are the cuts. A key is
    a byte offset and its own hash, so a dictionary is one array over the offsets, and its keys come in order.
    """
    size = int(a_ends[-1] if len(a_ends) else 0) + 1
    a_index, b_index = np.zeros(size, np.int64), np.zeros(max(size, int(b_ends[-1] if len(b_ends) else 0) + 1), np.int64)
    a_index[a_ends], b_index[b_ends] = np.arange(1, len(a_ends) + 1), np.arange(1, len(b_ends) + 1)
    shared = np.flatnonzero((a_index > 0) & (b_index[:size] > 0))
    return shared, a_index[shared], b_index[shared]


def links(ids_a: np.ndarray, ids_b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Linked id pairs (A's id times 2^32, plus B's), slice by slice, how many links each entry stands for, and entries by slice."""
    from_a, from_b = (np.concatenate([[0], c])[:-1] for c in (cuts_a, cuts_b))
    n_a, n_b = cuts_a - from_a, cuts_b - from_b
    size = n_a * n_b
    wide = np.flatnonzero(size > WIDE_SLICE)
    size[wide] = 0
    own = np.repeat(np.arange(len(size)), size)
    nth = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
    pairs = ids_a[from_a[own] + nth // n_b[own]].astype(np.int64) << 32 | ids_b[from_b[own] + nth % n_b[own]].astype(np.int64)
    times = np.ones(len(pairs), np.int64)
    if len(wide):
        parts = [(own, pairs, times)]
        for g in wide.tolist():
            x, many_x = np.unique(ids_a[from_a[g] : cuts_a[g]], return_counts=True)
            y, many_y = np.unique(ids_b[from_b[g] : cuts_b[g]], return_counts=True)
            size[g] = len(x) * len(y)
            parts.append((np.full(size[g], g), ((x.astype(np.int64) << 32)[:, None] | y.astype(np.int64)).ravel(), (many_x[:, None] * many_y).ravel()))
        own, pairs, times = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(own, kind="stable")
        pairs, times = pairs[order], times[order]
    return pairs, times, size


class Decimals:
    """Ids below 10^width as text: one row of digits each, written with a separator behind."""

    def __init__(self, size: int):
        self.width = len(str(size))
        self.lengths = np.array([len(str(i)) for i in range(size)], np.int64)
        self.digits = np.frombuffer("".join(str(i).ljust(self.width) for i in range(size)).encode(), np.uint8).reshape(size, self.width)

    def written(self, ids: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of ids, each followed by its separator (0: none), and the bytes each takes."""
        rows = np.zeros((len(ids), self.width + 1), np.uint8)
        rows[:, : self.width] = self.digits[ids]
        n = self.lengths[ids]
        at = np.arange(self.width + 1)
        rows[np.arange(len(ids)), n] = separators
        sizes = n + (separators > 0)
        return rows[at < sizes[:, None]], sizes


class Aligner:
    """Both tokenizers of a worker, with the bytes of each of their tokens.

    A's split pattern begins a new part at a space between two other characters, and no piece of B has a space after another
    character, so neither has a token across such a space: both end there, and a text's groups are those of its words, each with
    the space before it. So the distinct words of a batch are tokenized and sliced once, many joined as one text. Other white space stays
    within its word. (A tokenizer B without that property takes whole texts as words.)
    """

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a, self.b = ByteEncoder(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        self.a_bytes = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in self.a.names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := _BYTE_PIECE.fullmatch(p)) else p.replace("\u2581", " ").encode() for p in pieces]
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.by_words = not any("\u2581" in p.lstrip("\u2581") for p in pieces)
        self.decimals = Decimals(max(len(self.a_bytes), len(self.b_bytes)))

    def split(self, text: str) -> list[str]:
        if not self.by_words:
            return [text]
        return _LONE_SPACE.split(text) if text[:1].isspace() or text[-1:].isspace() or _BESIDE_WHITE.search(text) else text.split(" ")

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A's and B's ids of texts one after the other, how many each text has, and which texts both give back byte for byte."""
        found = []
        raw = [f" {t}".encode() for t in texts]
        good = np.ones(len(texts), bool)
        for ids, names, sizes in ((self.a.encode(texts), self.a_bytes, self.a_sizes), (self.b.encode(texts, num_threads=1), self.b_bytes, self.b_sizes)):
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.int64, int(counts.sum()))
            if b"".join(map(names.__getitem__, flat.tolist())) != b"".join(raw):
                good &= [b"".join(map(names.__getitem__, i)) == r for i, r in zip(ids, raw, strict=True)]
            found += [flat, counts]
        return found[0], found[2], found[1], found[3], good

    def words(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """Slices of distinct words: n_a, n_b, groups, entries of links of each word (0 where bytes differ), then the words' groups as text, its
        bytes of each word, pairs and times."""
        joins = [not (w[:1].isspace() or w[-1:].isspace() or not w) for w in words]
        inner, alone = [k for k, j in enumerate(joins) if j], [k for k, j in enumerate(joins) if not j]
        texts = [[k] for k in alone] + ([inner[k : k + JOINED] for k in range(0, len(inner), JOINED)] if self.by_words else [[k] for k in inner])
        ids_a, ids_b, n_a, n_b, good = self.tokens([" ".join([words[k] for k in t]) for t in texts])
        if not good.all():  # the words of a text that isn't given back are looked at one by one
            texts = [[k] for t, g in zip(texts, good, strict=True) for k in t if not g] + [t for t, g in zip(texts, good, strict=True) if g]
            ids_a, ids_b, n_a, n_b, good = self.tokens([" ".join([words[k] for k in t]) for t in texts])
            ids_a, ids_b = ids_a[np.repeat(good, n_a)], ids_b[np.repeat(good, n_b)]
            texts = [t for t, g in zip(texts, good, strict=True) if g]
        order = np.fromiter(chain.from_iterable(texts), np.int64)
        shared, cuts_a, cuts_b = shared_cuts(np.cumsum(self.a_sizes[ids_a]), np.cumsum(self.b_sizes[ids_b]))
        # A word ends with a cut: its space and its bytes say at which offset.
        last = np.searchsorted(shared, np.cumsum(np.array([len(words[k].encode()) + 1 for k in order.tolist()], np.int64)), side="right")
        assert len(order) == 0 or last[-1] == len(shared), "a word without its end"
        text, sizes = self._written(ids_a, ids_b, cuts_a, cuts_b)
        pairs, times, entries = links(ids_a, ids_b, cuts_a, cuts_b)
        out = np.zeros((5, len(words)), np.int64)
        for row, ends in enumerate((cuts_a, cuts_b, np.arange(1, len(shared) + 1), np.cumsum(entries), np.cumsum(sizes))):
            out[row, order] = np.diff(np.concatenate([[0], np.concatenate([[0], ends])[last]]))
        at = np.zeros((2, len(words)), np.int64)  # where a word's entries and bytes begin
        for row, sized in enumerate(out[3:]):
            at[row, order] = np.cumsum(sized[order]) - sized[order]
        good = np.zeros(len(words), bool)
        good[order] = True
        return good, out, at, text, pairs, times

    def _written(self, ids_a: np.ndarray, ids_b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """`a1,a2|b1;` for each group, as bytes, and their number by group."""
        before_a, before_b = (np.concatenate([[0], c])[:-1] for c in (cuts_a, cuts_b))
        ids, marks = np.zeros(len(ids_a) + len(ids_b), np.int64), np.full(len(ids_a) + len(ids_b), ord(","), np.uint8)
        # A's tokens of a group come after all groups before it; B's after A's of the group as well.
        ids[np.arange(len(ids_a)) + np.repeat(before_b, cuts_a - before_a)] = ids_a
        ids[np.arange(len(ids_b)) + np.repeat(cuts_a, cuts_b - before_b)] = ids_b
        marks[cuts_a + before_b - 1] = ord("|")
        marks[cuts_a + cuts_b - 1] = ord(";")
        flat, sizes = self.decimals.written(ids, marks)
        return flat, np.diff(np.concatenate([[0], np.concatenate([[0], np.cumsum(sizes)])[cuts_a + cuts_b]]))

    def align(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, list[np.ndarray], list[np.ndarray]]:
        """Of each text: counts (of A's and B's tokens, groups, links), groups as text, linked pairs and their numbers of links."""
        codes: dict[str, int] = {}
        split = [[codes.setdefault(w, len(codes)) for w in self.split(t)] if t else [] for t in texts.to_pylist()]
        good, counts, at, text, pair, times = self.words(list(codes))
        found, groups, pairs, numbers = np.zeros((4, len(split)), np.int64), [], [], []
        for k, own in enumerate(split):
            word = np.array(own, np.int64)
            if not own or not good[word].all():
                word = word[:0]
            groups.append(gathered(text, at[1, word], counts[4, word])[:-1].tobytes())
            entries = stretches(at[0, word], counts[3, word])
            distinct, place = np.unique(pair[entries], return_inverse=True)
            pairs.append(distinct)
            numbers.append(np.bincount(place, times[entries], len(distinct)).astype(np.int64))
            found[:3, k], found[3, k] = counts[:3, word].sum(axis=1), numbers[-1].sum()
        return found, pa.array(groups, pa.binary()).cast(pa.string()), pairs, numbers


def stretches(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of stretches, one after the other."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


def gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return flat[stretches(start, size)]


class ByteEncoder:
    """ids of texts after a space, by a byte-level file of tokenizers; added tokens' strings are plain text.

    Where the file's merges come in the order of their ids, tiktoken runs them (a quarter of the time). Texts with characters whose class the two
    libraries' Unicode tables might hold differently go to tokenizers.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            text = f.read()
        self.tokenizer, model = Tokenizer.from_str(text), json.loads(text)
        self.tokenizer.encode_special_tokens = True
        own = self.tokenizer.get_vocab()
        self.names = [""] * (max(own.values()) + 1)
        for token, i in own.items():
            self.names[i] = token
        vocabulary, merges = model["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        ids = [vocabulary["".join(m)] for m in merges]
        plain = model["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and not model["normalizer"]
        letters = byte_letters()
        self.fast = None
        if plain and ids == list(range(256, 256 + len(ids))):
            ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items() if i < 256 + len(ids)}
            self.fast = tiktoken.Encoding("own", pat_str=BYTE_PARTS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.fast.encode_ordinary(f" {t}") if self.fast and not _UNUSUAL.search(t) else self.tokenizer.encode(f" {t}", add_special_tokens=False).ids for t in texts]


_aligners: dict[tuple[str, str], Aligner] = {}


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """All columns, and how each text's tokens by A (of tokenizers, byte level) and by B (of sentencepiece) lie on each other.

    n_a, n_b, n_groups and n_links (long); groups, the ids of both by group (`a1,a2|b1;a3|b2,b3`); pairs, the distinct linked id
    pairs (A's id times 2^32, plus B's) and how many links of the text each has. Both tokenize a space and the text; special
    tokens' strings are plain text. A text that is null or empty, or whose bytes either tokenizer does not give back, has no tokens:
    zeros, an empty groups and no pairs. Rows are judged one by one, so repeated rows and ids don't matter here; a column of the
    input called as one of these is kept as name__in2. Nothing is shuffled.
    """
    rows = tidy(docs, ["text"], COLUMNS)

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path_a, path_b) not in _aligners:
            _aligners[path_a, path_b] = Aligner(path_a, path_b)
        own = _aligners[path_a, path_b]
        for batch in text_batches(batches, TEXT_BYTES):
            counts, groups, pairs, times = own.align(batch.column("text"))
            offsets = pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32())
            found = pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in (pairs, times)], ["pair", "times"])
            columns = [*(pa.array(c, pa.int64()) for c in counts), groups, pa.ListArray.from_arrays(offsets, found)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *COLUMNS])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), *(f"{c} bigint" for c in COLUMNS[:4]), "groups string", f"pairs {PAIRS}"])
    return rows.mapInArrow(aligned, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n_docs (rows that hold it linked), best (no pair of the same A id is in more rows), for every linked pair.

    A pair's rows meet as partial counts, so a frequent pair is one row a task; an A id has at most as many pairs as B has ids.
    """
    counts = aligned.select(F.explode("pairs.pair").alias("pair")).groupBy("pair").agg(F.count("*").alias("n_docs"))
    most = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n_docs").alias("most"))
    return counts.join(most, F.shiftright("pair", 32) == F.col("a")).select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def link_scores(docs: DataFrame, path_a: str, path_b: str, scratch: Scratch, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, one row for each row of the input.

    n_best: links whose pair is in as many rows as any pair of their A id; count_sum: the sum over links of the rows that hold
    their pair. Every row is a document here: a row that is repeated counts each time, under any doc_id, null included. An
    empty table gives an empty one.
    """
    aligned = align(pick(docs, "doc_id", "text"), path_a, path_b).drop("text")
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256))
    # Written once: the row numbers are then fixed, however often tasks are repeated.
    kept = scratch.save(aligned.withColumn("groups_sha256", digest).drop("groups").withColumn("row", F.monotonically_increasing_id()))
    scores = scratch.save(pair_counts(kept))
    if scores.count() <= broadcast_pairs:
        scores = F.broadcast(scores)
    own = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    links = kept.select(*own, F.explode_outer("pairs").alias("p")).select(*own, F.col("p.pair").alias("pair"), F.col("p.times").alias("times"))
    sums = [F.coalesce(F.sum(x), F.lit(0)).cast("long") for x in (F.when(F.col("best"), F.col("times")), F.col("times") * F.col("n_docs"))]
    scored = links.join(scores, "pair", "left").groupBy(*own).agg(sums[0].alias("n_best"), sums[1].alias("count_sum"))
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How ids of byte_bpe_50k.json and piece_bpe_32k.model link in each document; edge cases as in link_scores."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    return link_scores(docs, public_file("byte_bpe_50k.json"), public_file("piece_bpe_32k.model"), Scratch(spark, "alignment"))
