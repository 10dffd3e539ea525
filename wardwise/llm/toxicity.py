"""Toxicity by compression distance.

Two zstandard dictionaries are built from ordinary and from toxic text. A window
is one word, written ``REPEATS`` times so that the format's fixed costs do not
hide its own; it is compressed with either dictionary. Runs of more than
``LONGEST`` characters without a blank are not words (scripts without blanks, glued
text): their windows are all their stretches of ``GLUED`` characters. A window that the toxic
dictionary shortens and the ordinary one does not is evidence. How much evidence a
pair of lengths is, is calibrated on training documents that the dictionaries
have not seen, and so is the threshold on the sum over a text's distinct
windows, divided by the root of their number.

The dictionaries are raw lists of windows, nearly always words: the most frequent ones of ordinary training
documents, and those that toxic ones hold ``CONTRAST`` times as often. The toxic
dictionary follows on the ordinary one, so both know ordinary words alike.

Learning uses a bounded sample, ``TOXIC`` and ``ORDINARY`` documents at most,
chosen by a hash of the id. Scoring is one narrow pass over whole texts.

Null and empty texts score like any text without evidence, below 0.5. Repeated
labels of a document count as toxic if one does; null labels count not at all.
Without training documents of both kinds every score is 0. Of words that tie for
the ordinary dictionary the alphabetically first are taken, of thresholds of equal
F1 the lowest. Repeated rows give repeated rows, an empty table gives no rows; a
null id is not held out. All other columns are kept as they are; ``score`` takes the
place of given columns of its two ``names`` only.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from wardwise.llm.common import LOADED, Memo, bucket_of, per_batch

WORD = re.compile(r"\w+")
TOXIC, ORDINARY = 1200, 2400
REPEATS, LONGEST, GLUED = 5, 32, 6  # characters
CONTRAST, ORDINARY_WORDS, LEAST_DOCUMENTS = 8, 4000, 3
WEAK = 0.7  # evidence up to this counts nothing
LENGTHS, GAINS = 32, 16  # cells of the calibration
WORD_MEMORY = 200_000


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    evidence: tuple[float, ...]
    threshold: float
    slope: float


class Cells:
    """The cell of a word: its length under the toxic dictionary, and the gain by it."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.parameters = zstandard.ZstdCompressionParameters.from_level(
            12, source_size=64, dict_size=len(ordinary) + len(toxic), min_match=4,
            write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        self.plain, self.other = self.compressor(ordinary), self.compressor(ordinary + toxic)
        self.known = Memo(self.cell, WORD_MEMORY)

    def compressor(self, content: bytes):
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(compression_params=self.parameters)
        return zstandard.ZstdCompressor(dict_data=held, compression_params=self.parameters)

    def cell(self, word: str) -> int:
        window = (" " + word).encode("utf-8", "replace") * REPEATS + b" "
        with_toxic, without = len(self.other.compress(window)), len(self.plain.compress(window))
        return min(with_toxic, LENGTHS - 1) * GAINS + min(max(without - with_toxic, -4), GAINS - 5) + 4

    def histogram(self, words) -> np.ndarray:
        return np.bincount([self.known[w] for w in words], minlength=LENGTHS * GAINS)


def windows(text: str | None) -> set[str]:
    """Distinct lower-case words; of a longer run, its overlapping stretches."""
    found = set(WORD.findall((text or "").lower()))
    for run in [w for w in found if len(w) > LONGEST]:
        found.remove(run)
        found.update(run[i : i + GLUED] for i in range(len(run) - GLUED + 1))
    return found


def _strength(histograms: np.ndarray, evidence: np.ndarray) -> np.ndarray:
    return histograms @ evidence / np.sqrt(np.maximum(histograms.sum(1), 1))


def fit(samples: list[tuple[list[str], int]], prior: float) -> Model | None:
    """From (words, label) of training documents; ``prior``: ordinary ones to a toxic one."""
    sides = [[set(words) for words, toxic in samples if toxic == side] for side in (0, 1)]
    if min(map(len, sides)) < 4:
        return None
    ordinary, toxic = (Counter(w for words in side[::2] for w in words) for side in sides)
    n_ordinary, n_toxic = (len(side[::2]) for side in sides)
    typical = [
        w for w, n in toxic.items()
        if n >= min(LEAST_DOCUMENTS, n_toxic) and n / n_toxic >= CONTRAST * (ordinary[w] + 1) / n_ordinary
    ]
    common = sorted(ordinary, key=lambda w: (-ordinary[w], w))[:ORDINARY_WORDS]
    plain = " ".join(reversed(common)).encode("utf-8", "replace")  # frequent words last: nearest to the text
    extra = f" {' '.join(sorted(typical, key=lambda w: (toxic[w], w)))} ".encode("utf-8", "replace")
    cells = Cells(plain, extra)
    unseen = [np.array([cells.histogram(sorted(words)) for words in side[1::2]]) for side in sides]
    shares = [np.log((h.sum(0) + 0.5) / (h.sum() + 0.5 * h.shape[1])) for h in unseen]
    shortened = np.arange(LENGTHS * GAINS) % GAINS > 4  # by the toxic dictionary; others are no evidence
    evidence = np.maximum(shares[1] - shares[0] - WEAK, 0) * shortened
    weak, strong = (_strength(h, evidence) for h in unseen)
    weight = prior * len(strong) / len(weak)  # an ordinary sample stands for so many
    best, threshold = -1.0, 0.0
    for at in np.unique(np.concatenate([weak, strong])):
        hits, false = (strong >= at).sum(), weight * (weak >= at).sum()
        if at > 0 and (f1 := 2 * hits / (hits + false + len(strong))) > best:
            best, threshold = f1, at
    if best < 0:
        return None
    below = weak[weak < threshold].max(initial=0.0)  # half way to the next that is to stay below
    threshold = (threshold + max(below, strong[strong < threshold].max(initial=0.0))) / 2
    slope = 6 / max(strong.mean() - weak.mean(), 1e-6)
    return Model(plain, extra, tuple(evidence.tolist()), float(threshold), float(slope))


def learn(
    df: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0,
    key: str = "doc_id", column: str = "text", label: str = "toxic",
) -> Model | None:
    """Fit on a bounded sample of labelled rows outside the held-out fold."""
    known = (
        labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & (bucket_of(key, folds) != held_out))
        .groupBy(F.col(key).alias("_id")).agg(F.max((F.col(label) == 1).cast("int")).alias("_y"))
    )
    counts = {r._y: r.n for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("_id")
    chosen = known.where("_y = 1").orderBy(order, "_id").limit(TOXIC).unionAll(
        known.where("_y = 0").orderBy(order, "_id").limit(ORDINARY)
    )
    schema = StructType().add("_id", known.schema["_id"].dataType).add("_y", "integer").add("words", "string")

    def words_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [" ".join(sorted(windows(t.as_py()))) for t in batch.column("_text")]
        return pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_y"), pa.array(words, pa.string())], schema.names)

    texts = df.select(F.col(key).alias("_id"), F.col(column).alias("_text"))
    rows = (
        texts.join(F.broadcast(chosen), "_id")  # at most TOXIC + ORDINARY rows
        .groupBy("_id", "_y").agg(F.min("_text").alias("_text"))
        .mapInArrow(per_batch(words_of), schema).collect()
    )
    rows.sort(key=lambda r: r._id)
    return fit([(r.words.split(), r._y) for r in rows], counts.get(0, 0) / max(counts.get(1, 0), 1))


def score(
    df: DataFrame, model: Model | None, column: str = "text", names: tuple[str, str] = ("score", "predicted")
) -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 from 0.5), in place of columns of these ``names``. Nothing is shuffled."""
    kept = df.drop(*names)
    if model is None:
        return kept.withColumns({names[0]: F.lit(0.0), names[1]: F.lit(0)})
    schema = StructType([*kept.schema.fields]).add(names[0], "double").add(names[1], "integer")
    evidence = np.array(model.evidence)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        cells = LOADED.get((__name__, model), lambda: Cells(model.ordinary, model.toxic))
        known = cells.known
        scores = np.empty(batch.num_rows)
        for i, text in enumerate(batch.column(column)):
            found = [known[w] for w in windows(text.as_py())]
            strength = evidence[found].sum() / np.sqrt(len(found)) if found else 0.0
            scores[i] = 1 / (1 + np.exp(min(model.slope * (model.threshold - strength), 60.0)))
        predicted = pa.array((scores >= 0.5).astype("int32"))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), predicted], schema.names)

    return kept.mapInArrow(per_batch(one), schema)


def scored(df: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``documents``."""
    model = learn(df, labels, folds, held_out)
    out = F.coalesce(bucket_of("doc_id", folds) == held_out, F.lit(False))
    return score(df.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), "score", "predicted")
