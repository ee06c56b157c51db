"""Toxicity of texts by a counterfactually regularised classifier.

A logistic classifier over words and word beginnings. Every training sentence
that names a group also comes with the group exchanged for others, and the
squared difference of the two scores' logits is part of the loss, so that
which group a sentence mentions cannot carry weight. A text's features are the
words and beginnings it has, each counted once.

Fitted on a bounded sample: about `SAMPLE_ROWS` labelled ids chosen by a hash
of id and label, one text of each. The labels are sampled before texts are
looked up, and the sample is written once. `FEATURES` features are kept, those
whose use differs most between the labels over the whole sample, and all group
terms. Scoring reads whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches
from tidemark.llm.hashing import part_hashes, prefix_sums, word_bounds
from tidemark.session import checkpointed, release

#: Bounds of what is fitted: labelled rows about, and features.
SAMPLE_ROWS = 20_000
FEATURES = 6000
#: Weights of the two penalties.
RIDGE = 2e-4
COUNTERFACTUAL = 1.0
#: Bytes of a word's beginning.
BEGINNINGS = (4, 5, 6)
THRESHOLD = 0.3

#: Terms that may be exchanged for each other, by kind. Fixed values.
GROUPS = (
    ("women", "men", "girls", "boys", "people"),
    ("woman", "man", "girl", "boy", "person"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("old", "young"), ("disabled", "deaf", "blind"), ("rich", "poor"),
    ("frauen", "männer"), ("mujeres", "hombres"), ("femmes", "hommes"),
    ("juden", "muslime", "christen"), ("judíos", "musulmanes", "cristianos"), ("juifs", "musulmans", "chrétiens"),
)

_APART = bytes(32 if i < 128 and not chr(i).isalnum() else i for i in range(256))
_BLOCK = 1 << 20


def features(text: str) -> np.ndarray:
    """Distinct 63-bit hashes of the words of a text and their beginnings."""
    out = []
    for at in range(0, len(text), _BLOCK):
        data = np.frombuffer(text[at : at + _BLOCK].lower().encode("utf-8", "replace").translate(_APART), np.uint8)
        starts, ends = word_bounds(data)
        if not len(starts):
            continue
        sums = prefix_sums(data)
        out.append(part_hashes(sums, starts, ends))
        for size in BEGINNINGS:
            long = ends - starts > size
            # A beginning is another feature than the word of the same letters.
            out.append(part_hashes(sums, starts[long], starts[long] + size) ^ np.uint64(0x5BD1E995))
    return np.unique(np.concatenate(out) >> np.uint64(1)).astype(np.int64) if out else np.empty(0, np.int64)


def _term(word: str) -> np.ndarray:
    return features(word)


def _swaps() -> list[tuple[np.ndarray, list[np.ndarray]]]:
    return [(_term(t), [_term(o) for o in group if o != t]) for group in GROUPS for t in group]


@dataclass
class Model:
    known: np.ndarray  # sorted feature hashes
    weights: np.ndarray
    bias: float

    def score(self, texts: list[str | None]) -> list[float]:
        out = []
        for text in texts:
            logit = self.bias
            if text and len(self.known):
                found = features(text)
                at = np.searchsorted(self.known, found)
                at[at == len(self.known)] = 0
                logit += self.weights[at[self.known[at] == found]].sum()
            out.append(float(1 / (1 + np.exp(-np.clip(logit, -40, 40)))))
        return out


def _explode(batches):
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            found = features(text.as_py() or "")
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.int64()), pa.array(np.full(len(found), label), pa.int32())], names=["feature", "label"]
            )


def _rows(known: np.ndarray):
    """Labels of a batch, numbers of known features and the features' places, packed."""

    def run(batches):
        for batch in batches:
            places = []
            for text in batch.column(1):
                f = features(text.as_py() or "")
                at = np.searchsorted(known, f)
                at[at == len(known)] = 0
                places.append(at[known[at] == f].astype(np.uint16))
            packed = (
                batch.column(0).to_numpy().astype(np.uint8), np.array([len(p) for p in places], np.uint16),
                np.concatenate([*places, np.empty(0, np.uint16)]),
            )
            yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in packed], names=["labels", "sizes", "places"])

    return run


def _fit(cells: np.ndarray, lengths: np.ndarray, labels: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch accelerated gradient descent; `cells` are the
    places of the rows' features, one row after the other, `lengths` of each."""
    number = {int(f): i for i, f in enumerate(known)}
    place = lambda hashes: [number[int(h)] for h in hashes if int(h) in number]
    swaps = [(place(t), [place(o) for o in others]) for t, others in _swaps()]
    # Differences of swapped and given sentences: feature places with signs.
    # A group term always teaches, also where the sample has it in no sentence.
    having = np.bincount(cells, minlength=len(known))
    pairs = []
    for mine, others in swaps:
        times = max(1, min((int(having[i]) for i in mine), default=0))
        for other in others:
            pairs.append((mine, other, times / len(others)))
    owner, rows = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths), len(lengths)
    sizes, n = len(known), max(1, rows)
    w, bias = np.zeros(sizes), float(np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5)))
    ahead_w, ahead_b, momentum = w.copy(), bias, 1.0

    def pulled(at: np.ndarray) -> np.ndarray:
        """Slope of the penalty on score changes."""
        out = np.zeros(sizes)
        for mine, other, times in pairs:
            pull = COUNTERFACTUAL * times / n * (at[other].sum() - at[mine].sum())
            out[other] += pull
            out[mine] -= pull
        return out

    # Its largest curvature, by power iteration, so that steps never overshoot.
    turn, curve = pulled(np.random.default_rng(1).normal(size=sizes)), 0.0
    for _ in range(30):
        if not turn.any():
            break
        turn /= np.linalg.norm(turn)
        turn, before = pulled(turn), turn
        curve = float(turn @ before)
    step = 1 / ((max(1.0, np.sqrt((lengths.astype(float) ** 2).mean() if rows else 1.0)) + 1) / 4 + curve)
    for _ in range(600):
        logits = np.bincount(owner, ahead_w[cells], rows) + ahead_b
        error = 1 / (1 + np.exp(-np.clip(logits, -40, 40))) - labels
        slope = np.bincount(cells, error[owner], sizes) / n + RIDGE * ahead_w + pulled(ahead_w)
        new_w, new_b = ahead_w - step * slope, ahead_b - step * error.mean()
        momentum, last = (1 + np.sqrt(1 + 4 * momentum**2)) / 2, momentum
        pace = (last - 1) / momentum
        ahead_w, ahead_b = new_w + pace * (new_w - w), new_b + pace * (new_b - bias)
        w, bias = new_w, new_b
    return w, float(bias)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label") -> DataFrame:
    """Label and text of about `SAMPLE_ROWS` labelled ids, at most twice as many, as a written table.

    Ids with two labels may come with both; of the texts of a repeated id the
    one with the smallest hash teaches. Null ids, labels and texts teach
    nothing. The sampled labels are small and meet the documents where those
    are; only sampled texts move.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).dropna().distinct()
    share = max(1, known.count() // SAMPLE_ROWS)
    chosen = checkpointed(known.filter(F.pmod(F.xxhash64("id", "label"), F.lit(share)) == 0).limit(2 * SAMPLE_ROWS))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    met = texts.join(chosen, "id").groupBy("id", "label").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("row"))
    sample = checkpointed(met.select("label", "row.text"))
    release(chosen)
    return sample


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "label") -> Model:
    """Classifier of the rows' 0/1 labels; rows without text or label teach nothing.

    Without rows every score is 0.5; with one label only, scores are near it.
    More than twice `SAMPLE_ROWS` rows are refused: give a `labelled_sample`.
    """
    bounded_batches(labelled.sparkSession)
    sample = labelled.filter(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(label_col).cast("int").alias("label"), F.col(text_col).cast("string").alias("text")
    )
    size = sample.agg(F.count("*").alias("n"), F.sum("label").alias("ones")).first()
    n, ones = size.n, size.ones or 0
    if not n:
        return Model(np.empty(0, np.int64), np.empty(0), 0.0)
    if n > 2 * SAMPLE_ROWS:
        raise ValueError(f"{n} labelled rows to fit; draw a labelled_sample")
    counts = (
        sample.mapInArrow(_explode, "feature long, label int").groupBy("feature")
        .agg(F.sum("label").alias("hit"), F.count("*").alias("use")).filter("use >= 3")
    )
    # Signed difference of the shares, in deviations from chance.
    base = ones / n
    strength = F.abs(F.col("hit") - base * F.col("use")) / F.sqrt(F.col("use") * base * (1 - base) + 1e-9)
    best = counts.orderBy(strength.desc(), "feature").limit(FEATURES).select("feature")
    terms = np.concatenate([_term(t) for group in GROUPS for t in group])
    known = np.unique(np.concatenate([np.array([r.feature for r in best.collect()], np.int64), terms]))
    packed = sample.mapInArrow(_rows(known), "labels binary, sizes binary, places binary").collect()
    sizes = np.concatenate([np.frombuffer(r.sizes, np.uint16) for r in packed]).astype(np.int64)
    places = np.concatenate([np.frombuffer(r.places, np.uint16) for r in packed]).astype(np.int32)
    labels = np.concatenate([np.frombuffer(r.labels, np.uint8) for r in packed]).astype(float)
    weights, bias = _fit(places, sizes, labels, known)
    return Model(known, weights, bias)


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """The rows with a score (0 to 1) and predicted (1 from THRESHOLD on).

    Null and empty texts get the score of a text without words. Columns named
    as the two new ones are replaced; all others, null and repeated rows stay.
    """
    spark = bounded_batches(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)  # at most FEATURES and the group terms

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(texts.to_pylist()), pa.float64())

    scored = docs.drop(score_col, predicted_col).withColumn(score_col, of(F.col(text_col).cast("string")))
    return scored.withColumn(predicted_col, F.when(F.col(score_col) >= THRESHOLD, 1).otherwise(0))
