"""Removing repeated passages: a prefix-free parse finds every byte string of a length that starts twice.

A rolling hash over windows of TRIGGER bytes sets a trigger wherever it is least among the windows of some string
of the length looked for, so every such string holds a trigger that its bytes alone determine (phrases between
triggers are never longer than the string). The strings with one trigger at one distance are what prefix-free
parsing calls suffixes of dictionary words that go on alike in the parse: equal strings lie side by side in
corpus order, and only order to the depth of the length looked for matters. So:

1. parse: each trigger with its phrase, the bytes from the first to the last string that it stands for. Phrases overlap
   by all of a string but a byte, so to the depth looked for, the place of a phrase among the parse's suffixes is that
   of the phrase itself, and the parse's suffix array is the count of each phrase;
2. dictionary: the distinct phrases. A phrase that occurs twice makes all its strings repeats, a trigger that
   occurs once none;
3. suffix array: the strings of phrases that share a trigger but differ are put in order by prefix doubling; neighbours
   in this order with a common prefix of the length looked for are repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Scratch, text_batches, tidy

TRIGGER = 32
#: Places that are hashed at once.
CHUNK = 1 << 20
#: Phrases of one trigger that are compared in one task; those of more crowded triggers are counted string by string.
MOST_PHRASES = 4096
PLACE = np.uint64((1 << 24) - 1)

_random = np.random.default_rng(987654321)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base % 2**64, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


class Roll:
    """A rolling hash: sums of byte values times powers, from which the hash of any stretch follows."""

    def __init__(self):
        self.byte = _random.integers(0, 2**64, 256, dtype=np.uint64)
        base = int(_random.integers(0, 2**63)) * 8 + 5
        self.power, self.unpower = _powers(base % 2**64, CHUNK + 4096), _powers(pow(base, -1, 2**64), CHUNK + 4096)

    def sums(self, data: np.ndarray) -> np.ndarray:
        """For data of at most CHUNK + 4095 bytes."""
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.byte[data] * self.power[: len(data)], dtype=np.uint64)])

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return scramble((sums[end] - sums[start]) * self.unpower[start])


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Two hashes; the second one only tells the strings of crowded triggers apart for certain.
FIRST, SECOND = Roll(), Roll()


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each width neighbours."""
    n = len(x) - width + 1
    blocks = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def parse(data: np.ndarray, ends: np.ndarray, length: int):
    """Triggers of documents that stand one after the other in data, with the ends of each.

    Yields arrays: doc (number), first (start of the first string a trigger stands for), strings (how many follow one
    another from there), key (hash of the trigger window) and phrase (hash of the bytes of all these strings and of the
    trigger's place in them).
    """
    sizes = np.diff(np.concatenate([[0], ends]))
    doc_of = np.repeat(np.arange(len(ends)), sizes)
    room = ends[doc_of] - np.arange(len(data)) >= length
    for at in range(0, len(data), CHUNK):
        part = data[at : at + CHUNK + length - 1]
        places = np.flatnonzero(room[at : at + CHUNK])
        if len(part) < length or not len(places):
            continue
        sums = FIRST.sums(part)
        n = len(part) - TRIGGER + 1
        windows = scramble((sums[TRIGGER : TRIGGER + n] - sums[:n]) * FIRST.unpower[:n])
        least = sliding_least((windows & ~PLACE) | np.arange(n, dtype=np.uint64), length - TRIGGER + 1)
        trigger = (least[places] & PLACE).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (trigger[1:] != trigger[:-1]) | (places[1:] != places[:-1] + 1)]))
        first, strings, trigger = places[new], np.diff(np.append(new, len(places))), trigger[new]
        back = trigger - first
        phrase = FIRST.of(sums, first, first + strings + length - 1)
        phrase = scramble(phrase ^ (back * 65536 + strings).astype(np.uint64))
        doc = doc_of[at + first]
        yield doc, at + first - (ends - sizes)[doc], strings, windows[trigger], phrase


def string_values(phrase: bytes, strings: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each string of a phrase."""
    data, at = np.frombuffer(phrase, np.uint8), np.arange(strings)
    return tuple(roll.of(roll.sums(data), at, at + length) for roll in (FIRST, SECOND))


def string_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """The rank of the length bytes from each place on among all such strings of data; equal strings have equal ranks.

    Prefix doubling: ranks of strings of 8 bytes, then of twice as many, from pairs of ranks; the last pair overlaps.
    """
    width = min(8, length)
    n = len(data) - width + 1
    if n < 1 or len(data) < length:
        return np.zeros(0, np.int64)
    key = np.zeros(n, np.uint64)
    for k in range(width):
        key = key << np.uint64(8) | data[k : k + n]
    while True:
        distinct, rank = np.unique(key, return_inverse=True)
        if width == length:
            return rank.astype(np.int64)
        step = min(width, length - width)
        rank = rank.astype(np.uint64)
        key = rank[: len(rank) - step] * np.uint64(len(distinct)) + rank[step:]
        width += step


def repeated_strings(parts: list[bytes], strings: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrase number, place in it and whether it occurs again, for every string of these phrases, in suffix order."""
    ranks = string_ranks(np.frombuffer(b"".join(parts), np.uint8), length)
    base = np.cumsum([0] + [len(p) for p in parts[:-1]])
    which = np.repeat(np.arange(len(parts)), strings)
    step = np.arange(len(which)) - np.repeat(np.cumsum(strings) - strings, strings)
    own = ranks[base[which] + step]
    order = np.argsort(own, kind="stable")
    which, step, own = which[order], step[order], own[order]
    same = own[1:] == own[:-1]  # the common prefix of these neighbours has the whole length
    again = np.zeros(len(own), bool)
    again[1:] |= same
    again[:-1] |= same
    return which, step, again


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unions of stretches sorted by start; stretches that touch are one."""
    far = np.maximum.accumulate(ends)
    new = np.concatenate([[True], starts[1:] > far[:-1]])
    return starts[new], far[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(far) - 1]])]


def repeated_spans(docs: DataFrame, scratch: Scratch, length: int) -> DataFrame:
    """doc, text_hash, spans: sorted (start, end) bytes that repeated strings cover, which may overlap."""

    def triggers(batches):
        for batch in text_batches(batches):
            texts = batch.column("text").cast(pa.binary())
            data = np.frombuffer(b"".join(t for t in texts.to_pylist() if t), np.uint8)
            ends = np.cumsum(np.array([len(t) if t else 0 for t in texts.to_pylist()], np.int64))
            for doc, first, strings, key, phrase in parse(data, ends, length):
                rows = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").take(rows), batch.column("text_hash").take(rows), pa.array(first), pa.array(strings.astype(np.int32)), *(pa.array(x.view(np.int64)) for x in (key, phrase))],
                    names=["doc", "text_hash", "first", "strings", "key", "phrase"],
                )

    place = "doc long, text_hash long, first long, strings int"
    found = scratch.save(docs.mapInArrow(triggers, f"{place}, key long, phrase long"))
    keys = found.groupBy("key").agg(F.count("*").alias("n"), F.min("phrase").alias("low"), F.max("phrase").alias("high"))
    repeated = scratch.save(keys.filter("n > 1").select(F.col("key").alias("_key"), (F.col("low") != F.col("high")).alias("mixed")))
    shared = scratch.save(found.join(repeated, F.col("key") == F.col("_key")).drop("_key"))
    scratch.drop(found)
    span = F.struct(F.col("first").alias("start"), (F.col("first") + F.col("strings") + (length - 1)).alias("end"))
    alike = shared.filter("NOT mixed").select("doc", "text_hash", span.alias("span"))

    # Triggers with several phrases: those that occur twice repeat whole, the others string by string.
    mixed = shared.filter("mixed").drop("mixed")
    one = F.min(F.struct("doc", "text_hash", "first", "strings")).alias("one")
    words = scratch.save(mixed.groupBy("key", "phrase").agg(F.count("*").alias("n"), one).select("key", "phrase", "n", "one.*"))
    often = scratch.save(words.filter("n > 1").select(F.col("key").alias("_key"), F.col("phrase").alias("_phrase")))
    twice = mixed.join(often, (F.col("key") == F.col("_key")) & (F.col("phrase") == F.col("_phrase"))).select("doc", "text_hash", span.alias("span"))

    crowds = scratch.save(words.groupBy("key").count().filter(F.col("count") > MOST_PHRASES).select(F.col("key").alias("_key"), F.lit(True).alias("crowded")))
    some = not crowds.isEmpty()
    if some:
        words = words.join(crowds, F.col("key") == F.col("_key"), "left").drop("_key").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    else:
        words = words.withColumn("crowded", F.lit(False))
    wanted = words.groupBy(F.col("doc").alias("_doc"), F.col("text_hash").alias("_hash")).agg(F.collect_list(F.struct("key", "n", "first", "strings", "crowded")).alias("wanted"))
    needed = docs.join(wanted, (F.col("doc") == F.col("_doc")) & (F.col("text_hash") == F.col("_hash")))
    # Rows that are equal in doc and text occur twice in every phrase, so fetching them twice changes nothing.

    def fetch(batches):
        """The phrases' bytes; of crowded triggers, their strings' hashes instead (as key and check, without bytes)."""
        for batch in text_batches(batches):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for doc, text_hash, text, rows in zip(batch.column("doc").to_pylist(), batch.column("text_hash").to_pylist(), texts, batch.column("wanted").to_pylist(), strict=True):
                made = []
                for r in rows:
                    part = text[r["first"] : r["first"] + r["strings"] + length - 1]
                    if r["crowded"]:
                        values = (v.view(np.int64).tolist() for v in string_values(part, r["strings"], length))
                        made += [(v, w, r["n"], r["first"] + i, 1, None) for i, (v, w) in enumerate(zip(*values, strict=True))]
                    else:
                        made.append((r["key"], 0, r["n"], r["first"], r["strings"], part))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                columns = [pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(made), pa.int64()), pa.array([text_hash] * len(made), pa.int64()), *columns], names=["doc", "text_hash", "key", "check", "n", "first", "strings", "bytes"])

    def compare(batches):
        for table in _runs(batches):
            strings, n = (table.column(c).to_numpy().astype(np.int64) for c in ("strings", "n"))
            which, step, again = repeated_strings(table.column("bytes").to_pylist(), strings, length)
            again &= n[which] == 1  # the others repeat whole
            at = np.lexsort((step[again], which[again]))
            which, step = which[again][at], step[again][at]
            if not len(which):
                continue
            new = np.flatnonzero(np.concatenate([[True], (np.diff(step) != 1) | (which[1:] != which[:-1])]))
            size = np.diff(np.append(new, len(which)))
            row = which[new]
            start = table.column("first").to_numpy()[row] + step[new]
            yield pa.RecordBatch.from_arrays([table.column("doc").combine_chunks().take(pa.array(row)), table.column("text_hash").combine_chunks().take(pa.array(row)), pa.array(start), pa.array(start + size + length - 1)], names=["doc", "text_hash", "start", "end"])

    fetched = needed.select("doc", "text_hash", "text", "wanted").mapInArrow(fetch, "doc long, text_hash long, key long, check long, n long, first long, strings int, bytes binary")
    if some:
        fetched = scratch.save(fetched)
    few = fetched.filter("bytes IS NOT NULL") if some else fetched
    partly = few.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "doc long, text_hash long, start long, end long")
    spans = alike.unionByName(twice).unionByName(partly.select("doc", "text_hash", F.struct("start", "end").alias("span")))
    if some:
        strings = fetched.filter("bytes IS NULL")
        equal = scratch.save(strings.groupBy(F.col("key").alias("_key"), F.col("check").alias("_check")).agg(F.count("*").alias("_n")).filter("_n > 1").select("_key", "_check"))
        hits = strings.filter("n = 1").join(equal, (F.col("key") == F.col("_key")) & (F.col("check") == F.col("_check")))
        spans = spans.unionByName(hits.select("doc", "text_hash", F.struct(F.col("first").alias("start"), (F.col("first") + length).alias("end")).alias("span")))
    return scratch.save(spans.groupBy("doc", "text_hash").agg(F.sort_array(F.collect_set("span")).alias("spans")))


def _runs(batches):
    from .runs import whole_runs

    for table, _ in whole_runs(batches, "key", 1 << 40):
        yield table


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """Every row of docs with n_bytes, n_removed, n_spans, kept (bytes) and kept_sha256.

    A byte of a text's UTF-8 form is removed if a string of length bytes that covers it also starts anywhere else, in
    the same text (overlaps count) or another; strings don't cross texts, and are judged on the texts as given.
    n_spans counts maximal runs of removed bytes. Null counts as empty: nothing is removed, and kept is empty. Repeated
    rows are copies of each other. All columns are kept; those of the added names are renamed (see base.tidy). No
    rows: no rows. Phrases count as equal by two hashes of 64 bits, of the trigger and of the whole, and so do the strings
    of crowded triggers; all other strings are compared by their bytes.
    """
    if length < TRIGGER or length > 2048:
        raise ValueError(f"length has to be {TRIGGER} to 2048")
    added = ("n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "doc", "text_hash", "spans", "_doc", "_hash")
    docs = tidy(docs, ("doc_id", "text"), added)
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    known = docs.withColumn("text_hash", text_hash).withColumn("doc", F.coalesce(F.col("doc_id").cast("long"), F.col("text_hash")))
    scratch = Scratch(docs.sparkSession, "repeats")
    spans = repeated_spans(known.select("doc", "text_hash", "text"), scratch, length).withColumnsRenamed({"doc": "_doc", "text_hash": "_hash"})
    joined = known.join(spans, (F.col("doc") == F.col("_doc")) & (F.col("text_hash") == F.col("_hash")), "left").drop("_doc", "_hash", "doc", "text_hash")
    names = docs.columns

    from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

    made = [("n_bytes", LongType()), ("n_removed", LongType()), ("n_spans", LongType()), ("kept", BinaryType()), ("kept_sha256", StringType())]

    def cut(batches):
        for batch in text_batches(batches):
            rows = []
            spans = batch.column("spans")
            starts, ends = (spans.flatten().field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            sizes = np.array([len(s) if s.is_valid else 0 for s in spans], np.int64)
            offsets = np.cumsum(sizes) - sizes
            for text, at, n in zip(batch.column("text").cast(pa.binary()).to_pylist(), offsets.tolist(), sizes.tolist(), strict=True):
                text = text or b""
                if n:
                    s, e = merged(starts[at : at + n], ends[at : at + n])
                    edges = [0, *np.stack([s, e], axis=1).ravel().tolist(), len(text)]
                    kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    rows.append((len(text), len(text) - len(kept), len(s), kept, hashlib.sha256(kept).hexdigest()))
                else:
                    rows.append((len(text), 0, 0, text, hashlib.sha256(text).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=[*names, *(m[0] for m in made)])

    return joined.select(*names, "spans").mapInArrow(cut, StructType([*docs.schema.fields, *(StructField(*m) for m in made)]))


def op9_prefix_free_repeats(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
