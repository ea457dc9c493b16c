"""Language of a text by multinomial naive Bayes over hashed character n-grams.

Counts of hashed 1- to 3-grams of lower-cased texts are summed by Spark for each
language over all training rows; the smoothed log-probability matrix (buckets by
languages, at most ``MOST_LANGUAGES``) is broadcast, and each batch of texts is scored as
a sparse matrix of counts in numpy, some texts at a time so that memory stays bounded.

Defined cases: a text that is null or has no letter, or a model without training rows,
gives ``und`` with score 0; a tie goes to the language that sorts first; null ids are
never learned from; rows that repeat are learned as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 13
ORDERS = 3
#: Bound on the size of the model (64 MB); more languages than this are an error.
MOST_LANGUAGES = 1024
#: Products held at a time while a batch is scored.
MOST_CELLS = 1 << 22
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


def buckets(text: str) -> np.ndarray:
    """The bucket of each n-gram in a text."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    mixed, parts = np.zeros(len(codes), np.uint32), []
    for order in range(min(ORDERS, len(codes))):
        mixed = mixed[: len(codes) - order] * np.uint32(0x01000193) + codes[order:] + np.uint32(order + 1)
        h = mixed * np.uint32(0x9E3779B1)
        parts.append((h >> np.uint32(32 - 13)).astype(np.int64))
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


@dataclass
class Model:
    languages: list[str]
    log_probability: np.ndarray  # buckets by languages
    log_prior: np.ndarray


def learn(rows: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model:
    """Fit on all of ``rows`` with a language; only counts by language and bucket leave Spark."""
    labelled = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                own = totals.setdefault(lang.as_py(), np.zeros(BUCKETS + 1, np.int64))
                own[:BUCKETS] += np.bincount(buckets(text.as_py()), minlength=BUCKETS)
                own[BUCKETS] += 1
            if len(totals) > MOST_LANGUAGES:
                raise ValueError(f"more than {MOST_LANGUAGES} languages")
        for lang, own in totals.items():
            some = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some), pa.array(own[some])], ["lang", "bucket", "n"])

    sums = labelled.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = sums.limit((MOST_LANGUAGES + 1) * (BUCKETS + 1)).toArrow().to_pandas()
    languages = sorted(found["lang"].unique())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    counts = np.zeros((BUCKETS + 1, max(1, len(languages))))
    counts[found["bucket"].to_numpy(int), found["lang"].map({x: k for k, x in enumerate(languages)}).to_numpy(int)] = found["n"]
    smooth = counts[:BUCKETS] + 0.5
    return Model(list(languages), np.log(smooth / smooth.sum(axis=0)), np.log((counts[BUCKETS] + 1) / (counts[BUCKETS] + 1).sum()))


def score_batch(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Best language and its probability for texts that have letters."""
    total = np.empty((len(texts), len(model.log_prior)))
    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    size = 0

    def add_up() -> None:
        """Counts times rows of the matrix, summed for each text that waits."""
        if held:
            columns, counts = (np.concatenate([h[j] for h in held]) for j in (1, 2))
            starts = np.concatenate([[0], np.cumsum([len(h[1]) for h in held])[:-1]])
            weighted = counts[:, None] * model.log_probability[columns]
            total[[h[0] for h in held]] = np.add.reduceat(weighted, starts, axis=0) + model.log_prior
            held.clear()

    for k, text in enumerate(texts):
        own = np.bincount(buckets(text), minlength=BUCKETS)
        some = np.flatnonzero(own)
        if (size + len(some)) * len(model.log_prior) > MOST_CELLS:
            add_up()
            size = 0
        held.append((k, some, own[some]))
        size += len(some)
    add_up()
    best = total.argmax(axis=1)
    return best, 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)


def predict(text: Column, model: Model) -> Column:
    """A struct of ``lang`` and ``score`` for each text."""
    from pyspark.sql import SparkSession

    shared = SparkSession.active().sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang: string, score: double>")
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for texts in batches:
            langs, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            for lo in range(0, len(texts), 256):
                some = [(k, t) for k in range(lo, min(lo + 256, len(texts))) if (t := texts[k].as_py()) and LETTER.search(t)]
                if some and own.languages:
                    best, sure = score_batch(own, [t for _, t in some])
                    rows = [k for k, _ in some]
                    langs[rows], scores[rows] = [own.languages[b] for b in best], sure
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores)], ["lang", "score"])

    return made(text)
