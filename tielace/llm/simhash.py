"""SimHash near-duplicates; pivot distance tables choose and discard pairs."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Scratch, pick, text_batches
from .components import connected_components, spanning
from .runs import pairs_in_runs, whole_runs

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
BITS = 64
#: Reference fingerprints: fixed random words.
PIVOTS = np.random.default_rng(20240607).integers(0, 2**64, 12, dtype=np.uint64)
#: A bucket of more fingerprints than this goes to a finer division instead of being compared.
BUCKET = 1024
#: Divisions of the 64 bits; with as many parts as bits a bucket holds at most 2**radius fingerprints.
DIVISIONS = (1, 2, 3, 4, 6, 8, 12, 16, 32, 64)


def shingle_hashes(text: bytes, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of so many words, A-Z lower-cased; the whole sequence if it is shorter, none without words."""
    from xxhash import xxh64_intdigest

    tokens = text.translate(LOWER).split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    n = max(1, len(tokens) - words + 1)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
    starts = np.concatenate([[0], np.cumsum(lengths)])
    ends = starts[words : words + n] - 1 if len(tokens) >= words else np.array([len(joined)])
    return np.fromiter((xxh64_intdigest(joined[s:e], seed) for s, e in zip(starts[:n].tolist(), ends.tolist(), strict=True)), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half the hashes, as a signed integer; 0 for none."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp for every document; null text counts as empty (fingerprint 0)."""

    def run(batches):
        for batch in text_batches(batches):
            found = [fingerprint(shingle_hashes((t or "").encode(), words)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, fp long")


def masks(parts: int) -> np.ndarray:
    """The bits of each part, dealt in turn so that neighbours fall into different parts."""
    of = np.arange(BITS) % parts
    return np.array([sum(1 << i for i in np.flatnonzero(of == p).tolist()) for p in range(parts)], dtype=np.uint64)


def pivot_table(fps: np.ndarray, within: np.ndarray) -> np.ndarray:
    """Hamming distances [mask, pivot, fingerprint], counted within each mask."""
    return np.stack([np.stack([np.bitwise_count((fps ^ p) & m) for p in PIVOTS]) for m in within])


def table_keys(fps: np.ndarray, parts: int, radius: int) -> np.ndarray:
    """[choice, fingerprint]: a key for each choice of parts - radius parts, from their rows of the pivot table.

    Fingerprints that differ in at most radius bits don't differ in at least parts - radius parts, so they have
    all the same distances there, and the same key for one choice at least.
    """
    table = pivot_table(fps, masks(parts)).astype(np.uint64)
    digest = np.zeros((parts, len(fps)), np.uint64)
    for p in range(len(PIVOTS)):
        digest = (digest ^ table[:, p]) * np.uint64(0x9E3779B97F4A7C15)
        digest ^= digest >> np.uint64(29)
    keys = []
    for n, chosen in enumerate(combinations(range(parts), parts - radius)):
        key = np.full(len(fps), n + 1, np.uint64)
        for part in chosen:
            key = (key ^ digest[part]) * np.uint64(0xBF58476D1CE4E5B9)
            key ^= key >> np.uint64(32)
        keys.append(key)
    return np.stack(keys)


def close_pairs(keys: np.ndarray, fps: np.ndarray, radius: int):
    """Index pairs within radius bits among equal keys: pivot coordinates discard, the bits decide."""
    table = pivot_table(fps, np.array([2**64 - 1], np.uint64))[0].astype(np.int8)
    for i, j in pairs_in_runs(keys):
        for row in table:
            near = np.abs(row[i] - row[j]) <= radius
            i, j = i[near], j[near]
        near = np.bitwise_count(fps[i] ^ fps[j]) <= radius
        yield i[near], j[near]


def link(distinct: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """Links a, b (ids of distinct fingerprints: rep, fp) that join all that are within radius bits.

    Buckets are rows of the pivot table that agree. What falls into an overfull bucket is taken up again with
    a finer division, which separates it, and so on; no pair is lost. A bucket gives spanning links only.
    """
    first = next(i for i, d in enumerate(DIVISIONS) if d > radius)
    left, links = distinct, None
    for parts in DIVISIONS[first:]:
        last = parts == DIVISIONS[-1]

        def spread(batches, parts=parts):
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    keys = table_keys(part.column("fp").to_numpy().view(np.uint64), parts, radius)
                    n = len(keys)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(part.column("fp").to_numpy(), n)), pa.array(np.tile(part.column("rep").to_numpy(), n))], names=["key", "fp", "rep"]
                    )

        def compare(batches, last=last):
            for table, large in whole_runs(batches, "key", BUCKET):
                rep = table.column("rep").to_numpy()
                if large and not last:
                    yield pa.RecordBatch.from_arrays([pa.array(rep), pa.nulls(len(rep), pa.int64()), pa.array(table.column("fp").to_numpy())], names=["a", "b", "fp"])
                    continue
                keys, fps = table.column("key").to_numpy(), table.column("fp").to_numpy().view(np.uint64)
                a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
                for i, j in close_pairs(keys, fps, radius):
                    a, b = spanning(np.concatenate([a, rep[i]]), np.concatenate([b, rep[j]]))
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], names=["a", "b", "fp"])

        dealt = left.mapInArrow(spread, "key long, fp long, rep long").repartition("key").sortWithinPartitions("key")
        found = scratch.save(dealt.mapInArrow(compare, "a long, b long, fp long"))
        own = found.filter("b IS NOT NULL").select("a", "b")
        links = own if links is None else links.unionByName(own)
        overfull = found.filter("b IS NULL")
        if last or overfull.isEmpty():
            return links
        left = scratch.save(overfull.select(F.col("a").alias("rep"), "fp").distinct())


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id linked) of every document.

    Documents link if their SimHash fingerprints over word shingles differ in at most radius bits. Equal
    fingerprints are one group before any pair is formed, so copies cost nothing. Null and empty texts, and texts
    without words, have fingerprint 0 and link like any other. Rows with a null doc_id get a fingerprint and
    a null component_id. Repeated rows are returned as often as they occur. No rows: no rows.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.save(fingerprints(docs, words))
    distinct = scratch.save(prints.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    linked = connected_components(link(distinct, radius, scratch), scratch)
    groups = scratch.save(distinct.join(linked, F.col("rep") == F.col("node"), "left").select(F.col("fp").alias("_fp"), F.coalesce("component", "rep").alias("component_id")))
    joined = prints.join(groups, F.col("fp") == F.col("_fp"), "left")
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return joined.select("doc_id", text.alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op7_simhash_pivots(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
