"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import hashed_unit, pick, text_batches, tidy

ORDERS = (1, 2, 3)
BUCKETS = 1 << 17
#: The model learns from at most so many labelled texts of a language and of all languages. One in four of them
#: calibrates, the others fit; a language with two texts has one of either.
LANGUAGE_TEXTS = 800
SAMPLE_TEXTS = 40_000
#: Languages that are learned: those with the most labelled texts, ties by name. Rarer ones teach nothing.
MOST_LANGUAGES = 1000
#: Weights of the model (n-gram buckets times languages). If there would be more, the buckets in most texts have weights.
WEIGHTS = 1 << 24
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter or a mark."""
    return np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)])


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the small letters of all texts, each text and word between single spaces; starts and lengths."""
    small = [f" {t.lower()} " for t in texts]
    lengths = np.fromiter(map(len, small), np.int64, len(small))
    codes = np.frombuffer("".join(small).encode("utf-32-le"), np.uint32)
    starts = np.cumsum(lengths) - lengths
    letter = letters()[codes]
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # of other characters, the first after a letter is the space
    kept[starts] = True
    lengths = np.add.reduceat(kept, starts, dtype=np.int64)
    return np.where(letter, codes, np.uint32(32))[kept], np.cumsum(lengths) - lengths, lengths


def grams(codes: np.ndarray, lengths: np.ndarray):
    """For each order: the bucket of the n-gram that begins at each place, BUCKETS where it would leave its text."""
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))
    mixed = np.zeros(len(codes), np.uint32)
    for order in ORDERS:
        end = len(codes) - order + 1
        mixed = mixed[: max(0, end)] * np.uint32(0x01000193) ^ codes[order - 1 :] * np.uint32(0x85EBCA6B)
        key = (mixed + np.uint32(order)) * np.uint32(0xC2B2AE35)
        bucket = np.full(len(codes), BUCKETS, np.int64)
        bucket[: len(key)] = np.where(left[: len(key)] >= order, (key ^ (key >> np.uint32(15))) % np.uint32(BUCKETS), BUCKETS)
        yield bucket


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's n-grams and how often each occurs."""
    codes, _, lengths = codes_of([text])
    found = np.concatenate(list(grams(codes, lengths)))
    return np.unique(found[found < BUCKETS], return_counts=True)


@dataclass
class Model:
    """weights: [row, language]; row: the row of a bucket, len(weights) where it has none."""

    languages: list[str]
    idf: np.ndarray
    row: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """(row of each bucket and of no bucket, what one n-gram of a row adds to the logits, times their number)."""
        used = np.flatnonzero(self.row < len(self.weights))
        scaled = np.zeros((len(self.weights) + 1, len(self.languages)), np.float32)
        scaled[self.row[used]] = self.weights[self.row[used]] * self.idf[used, None] * 100.0
        return np.append(self.row, len(self.weights)), scaled

    def logits(self, texts: list[str], table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        row, scaled = table
        codes, starts, lengths = codes_of(texts)
        total = np.zeros((len(codes), len(self.languages)), np.float32)
        for bucket in grams(codes, lengths):
            total += scaled[row[bucket]]
        n = sum(np.maximum(0, lengths - order + 1) for order in ORDERS)
        sums = np.add.reduceat(total, starts, axis=0, dtype=np.float64)
        return sums / n[:, None] + self.bias

    def chances(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def follow_the_leader(samples: list[tuple[np.ndarray, np.ndarray, int]], rows: int, languages: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, epochs: int = 6, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Weights [row, language] and biases by follow-the-regularised-leader with an elastic net.

    samples: rows, their values, and language. A weight is exactly 0 as long as its summed gradients stay within l1;
    the bias, the last row, is not penalised.
    """
    z = np.zeros((rows + 1, languages))
    squares = np.zeros_like(z)

    def solve(zi, ni, l1, l2):
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    inputs = [(np.append(r, rows), np.append(x, 1.0), y) for r, x, y in samples]
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for at in order.permutation(len(inputs)):
            own, x, y = inputs[at]
            zi, ni = z[own], squares[own]
            w = solve(zi, ni, l1, l2)
            w[-1] = solve(zi[-1], ni[-1], 0.0, 0.0)
            logits = x @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1.0
            g = x[:, None] * p
            later = ni + g * g
            z[own] = zi + g - (np.sqrt(later) - np.sqrt(ni)) / alpha * w
            squares[own] = later
    weights = solve(z, squares, l1, l2)
    return weights[:-1], solve(z[-1], squares[-1], 0.0, 0.0)


def best_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least negative log-likelihood, by golden-section search on its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        s = logits / np.exp(t)
        top = s.max(axis=1)
        return float((top + np.log(np.exp(s - top[:, None]).sum(axis=1)) - s[np.arange(len(y)), y]).mean()) + 1e-3 * t * t

    low, high, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
    while high - low > 1e-4:
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(labelled: DataFrame) -> Model | None:
    """A model from doc_id, text, lang rows; rows with null lang, or without a letter, teach nothing. None: no such rows.

    Document frequencies count all rows. Of each learned language (see MOST_LANGUAGES), the texts with the smallest
    hash of their doc_id, as many as LANGUAGE_TEXTS and SAMPLE_TEXTS allow, are taken whole; every fourth of them, from
    the second on, sets the temperature, the others the weights.
    """
    rows = pick(labelled, "doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    if not counts:
        return None
    languages = sorted(r["lang"] for r in counts)

    def frequencies(batches):
        seen, total = np.zeros(BUCKETS + 1, bool), np.zeros(BUCKETS, np.int64)
        n_texts = 0
        for batch in text_batches(batches):
            codes, starts, lengths = codes_of(batch.column("text").to_pylist())
            found = np.stack(list(grams(codes, lengths)))
            n_texts += len(starts)
            for start, size in zip(starts.tolist(), lengths.tolist(), strict=True):
                own = found[:, start : start + size]
                seen[own] = True
                seen[-1] = False
                has = np.flatnonzero(seen)
                total[has] += 1
                seen[has] = False
        has = np.flatnonzero(total)
        buckets, sums = np.append(has, -1), np.append(total[has], n_texts)  # -1: all texts
        yield pa.RecordBatch.from_arrays([pa.array(buckets.astype(np.int32)), pa.array(sums)], names=["bucket", "n"])

    found = rows.select("text").mapInArrow(frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    buckets, n = found.column("bucket").to_numpy(), found.column("n").to_numpy()
    frequency = np.zeros(BUCKETS)
    frequency[buckets[buckets >= 0]] = n[buckets >= 0]
    idf = np.log((1 + n[buckets < 0].sum()) / (1 + frequency)) + 1.0
    # The rows of weights: all buckets that occur, or the most frequent ones.
    used = np.argsort(-frequency, kind="stable")[: min(int((frequency > 0).sum()), max(1, WEIGHTS // len(languages)))]
    row = np.full(BUCKETS, len(used), np.int64)
    row[np.sort(used)] = np.arange(len(used))

    # First thin each language to about half more than is wanted, where it stands; then take exactly the first ones.
    wanted = max(2, min(LANGUAGE_TEXTS, SAMPLE_TEXTS // len(languages)))
    chance = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, 1.5 * wanted / r["count"] + 20 / r["count"])))])
    draw = hashed_unit(F.lit("language"), F.col("doc_id"))
    thinned = rows.withColumn("draw", draw).filter(F.col("draw") < F.coalesce(F.try_element_at(chance, F.col("lang")), F.lit(0.0)))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id", "text"))
    chosen = thinned.withColumn("place", place).filter(F.col("place") <= wanted)

    def features(batches):
        for batch in text_batches(batches):
            for text, lang, place in zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "place")), strict=True):
                buckets, n = counted(text)
                known = row[buckets] < len(used)
                share, own = (n / n.sum())[known].astype("<f4"), buckets[known].astype("<i4")
                yield pa.RecordBatch.from_arrays([pa.array([own.tobytes()]), pa.array([share.tobytes()]), pa.array([lang]), pa.array([place], pa.int32())], names=["buckets", "shares", "lang", "place"])

    sample = chosen.select("text", "lang", "place").mapInArrow(features, "buckets binary, shares binary, lang string, place int").toArrow().to_pylist()
    sample.sort(key=lambda r: (r["lang"], r["place"]))
    number = {name: i for i, name in enumerate(languages)}
    fit, held = [], []
    for r in sample:
        own = np.frombuffer(r["buckets"], "<i4")
        x = 100.0 * np.frombuffer(r["shares"], "<f4") * idf[own]
        (held if r["place"] % 4 == 2 else fit).append((row[own], x, number[r["lang"]]))
    weights, bias = follow_the_leader(fit, len(used), len(languages))
    model = Model(languages, idf, row, weights.astype(np.float32), bias)
    if held:
        logits = np.stack([x @ weights[own] + bias for own, x, _ in held])
        model.temperature = best_temperature(logits, np.array([y for _, _, y in held]))
    return model


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs with lang_pred and score (the calibrated chance of that language, 0 to 1).

    A null text, or one without a letter, gets und and 0, as does every text without a model. Texts are taken
    whole, an n-gram at each place. Input columns of those names are renamed (see base.tidy).
    """
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    docs = tidy(docs, ("text",), ("lang_pred", "score", "_letter"))
    known = docs.withColumn("_letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    names = docs.columns

    def run(batches):
        table = model.table() if model else None
        for batch in text_batches(batches):
            letter = batch.column("_letter").to_numpy(zero_copy_only=False)
            lang, score = np.full(len(letter), UNKNOWN, object), np.zeros(len(letter))
            at = np.flatnonzero(letter) if model else np.zeros(0, int)
            if len(at):
                chances = model.chances(model.logits(batch.column("text").take(pa.array(at)).to_pylist(), table))
                best = chances.argmax(axis=1)
                lang[at], score[at] = np.array(model.languages, object)[best], chances[np.arange(len(at)), best]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(lang, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    return known.mapInArrow(run, schema)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """All columns of docs with held_out, lang_pred and score; a quarter of the documents teaches nothing.

    Only text and lang of documents with crc32(doc_id) % 4 other than 2 are learned from. Rows may repeat. No
    rows: no rows. See train and predict for nulls and empty texts.
    """
    docs = tidy(docs, ("doc_id", "text", "lang"), ("held_out",))
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    return predict(docs.withColumn("held_out", held_out(F.col("doc_id"))), model)


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", "held_out", "lang_pred", "score")
