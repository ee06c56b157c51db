"""Language of texts by error-correcting output codes.

Every language has a codeword. For each bit a linear classifier over hashed
byte n-grams says how likely the bit is set: its weights are the log odds of
an n-gram in the languages whose bit is set against the others. A text's
language is the one whose codeword gives the smallest sum of logistic losses,
each bit weighted by how well it told the training texts apart. The text is
ambiguous if another codeword is nearly as close, or if the bits' signs are
farther from the chosen word than the code can correct.

The n-gram frequencies are fitted on a bounded sample, about
`SAMPLE_PER_LANGUAGE` documents of each language chosen by a hash of the text;
whole texts count, each with the same weight. Prediction reads whole texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches

#: Bounds of the training sample: documents of a language, about.
SAMPLE_PER_LANGUAGE = 1500
#: Hashed n-grams; each length has half of the table.
BUCKETS = 1 << 14
#: N-grams that count as independent evidence at most.
EVIDENCE = 40.0
#: Loss by which the best codeword must be ahead.
MARGIN = 0.7

_LETTER = re.compile(r"[^\W\d_]")
_NO_LETTER = bytes(32 if i < 128 and not chr(i).isalpha() else i for i in range(256))
_BLOCK = 1 << 20


def _grams(text: str) -> np.ndarray:
    """Table places of the 3- and 4-byte grams of a text; empty without letters."""
    if not _LETTER.search(text):
        return np.empty(0, np.int32)
    out = []
    for at in range(0, len(text), _BLOCK):
        words = b" ".join(text[at : at + _BLOCK].lower().encode("utf-8", "replace").translate(_NO_LETTER).split())
        data = np.frombuffer(b" " + words + b" ", np.uint8).astype(np.uint32)
        three = data[:-2] * np.uint32(0x9E3779B1) + data[1:-1] * np.uint32(0x85EBCA77) + data[2:] * np.uint32(0xC2B2AE3D)
        four = three[:-1] * np.uint32(0x27D4EB2F) + data[3:] * np.uint32(0x165667B1)
        shift = np.uint32(32 - (BUCKETS.bit_length() - 2))
        out += [((three ^ three >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> shift), ((four ^ four >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> shift) + np.uint32(BUCKETS // 2)]
    return np.concatenate(out).astype(np.int32)


def codewords(languages: int) -> np.ndarray:
    """One row of +1 and -1 per language: all splits for up to six languages,
    beyond that the most distant of many random codes."""
    if languages < 2:
        return np.zeros((languages, 0))
    if languages <= 6:
        columns = [[1 if i == 0 or not s >> i - 1 & 1 else -1 for i in range(languages)] for s in range(1, 1 << languages - 1)]
        return np.array(columns, float).T
    draw, bits = np.random.default_rng(0), int(np.ceil(10 * np.log2(languages)))
    best, far = None, -1
    for _ in range(50):
        code = np.where(draw.random((languages, bits)) < 0.5, -1.0, 1.0)
        code[0, np.abs(code.sum(axis=0)) == languages] *= -1
        apart = (bits - code @ code.T) / 2 + np.eye(languages) * bits
        if apart.min() > far:
            best, far = code, apart.min()
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits, log odds
    trust: np.ndarray  # of each bit

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        names, scores, unsure = [], [], []
        bits = self.code.shape[1]
        apart = min(((a != b).sum() for i, a in enumerate(self.code) for b in self.code[:i]), default=0)
        for text in texts:
            grams = _grams(text) if text else np.empty(0, np.int32)
            if not len(grams) or not self.languages:
                names.append("und")
                scores.append(0.0)
                unsure.append(True)
                continue
            counts = np.bincount(grams, minlength=BUCKETS) if len(grams) > BUCKETS else None
            if counts is None:
                total = self.weights[grams].sum(axis=0)
            else:
                total = counts @ self.weights
            odds = total / len(grams) * min(len(grams), EVIDENCE)
            loss = (np.logaddexp(0, -self.code * odds) * self.trust).sum(axis=1)
            order = np.argsort(loss, kind="stable")
            best = order[0]
            scale = np.exp(-(loss - loss[best]))
            names.append(self.languages[best])
            scores.append(float(scale[best] / scale.sum()))
            wrong = int((np.sign(odds) != self.code[best]).sum()) if bits else 0
            near = len(order) > 1 and loss[order[1]] - loss[best] < MARGIN
            unsure.append(bool(near or wrong > max(0, (apart - 1) // 2)))
        return names, scores, unsure


def _counts(batches):
    """Sums of n-gram frequencies and of their use by language, over a task's rows."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for language, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            grams = _grams(text.as_py() or "")
            if len(grams):
                total = sums.setdefault(language, np.zeros(BUCKETS))
                total += np.bincount(grams, minlength=BUCKETS) / len(grams)
    for language, total in sums.items():
        places = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([language] * len(places), pa.string()), pa.array(places, pa.int32()), pa.array(total[places], pa.float64())],
            names=["lang", "place", "weight"],
        )


def train(docs: DataFrame, text_col: str = "text", label_col: str = "lang") -> Model:
    """Model of the languages that label the documents; rows without label or letters teach nothing."""
    bounded_batches(docs.sparkSession)
    rows = docs.filter(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(label_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")
    )
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], codewords(0), np.zeros((BUCKETS, 0)), np.zeros(0))
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, max(1, n // SAMPLE_PER_LANGUAGE))])
    sample = rows.filter(F.pmod(F.xxhash64("text"), share[F.col("lang")]) == 0)
    found = sample.mapInArrow(_counts, "lang string, place int, weight double").groupBy("lang", "place").agg(F.sum("weight").alias("weight"))
    # At most BUCKETS rows for each language.
    table = found.toPandas()
    languages = sorted(table["lang"].unique())
    code = codewords(len(languages))
    use = np.zeros((len(languages), BUCKETS))
    use[table["lang"].map({k: i for i, k in enumerate(languages)}), table["place"]] = table["weight"]
    use = use / use.sum(axis=1, keepdims=True) + 1e-5
    columns, trust = [], []
    for bit in code.T:
        odds = np.log(use[bit > 0].mean(axis=0) / use[bit < 0].mean(axis=0))
        margins = (use * odds).sum(axis=1) * bit
        columns.append(odds - (use * odds).sum(axis=1)[bit > 0].min() / 2 - (use * odds).sum(axis=1)[bit < 0].max() / 2)
        trust.append(max(1e-3, margins.mean()))
    weights = np.array(columns).T if columns else np.zeros((BUCKETS, 0))
    trust = np.array(trust)
    return Model(languages, code, weights.astype(np.float32), trust / trust.mean() if len(trust) else trust)


def detect(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (share of the chosen language, 0 to 1), ambiguous.

    Null texts and texts without a letter are `und` with score 0. A model
    without languages says `und` everywhere; one with a single language says
    that one with score 1. Other columns are not read; null and repeated ids
    are kept as they are; an empty table gives an empty result.
    """
    spark = bounded_batches(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)  # BUCKETS x bits numbers

    def run(batches):
        for batch in batches:
            names, scores, unsure = shared.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(unsure, pa.bool_())],
                names=["doc_id", "lang_pred", "score", "ambiguous"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, lang_pred string, score double, ambiguous boolean"
    )
