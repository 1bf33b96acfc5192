"""Operator 10: document quality by gated-attention multiple-instance learning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import parts, read
from .wordhash import Words, chunks, mix

#: Words of a passage; the last one of a text may be shorter.
PASSAGE_WORDS = 64
#: At most so many labelled documents of each class are used to fit (the bound of the training sample).
FIT_DOCS = 2000
#: At most so many passages, of whole documents, are used to fit: documents of the sample are taken by hash until it is full.
FIT_PASSAGES = 400_000
#: A document is kept from this score on.
THRESHOLD = 0.7
HIDDEN, ATTENTION, EPOCHS, RATE = 24, 12, 220, 0.02
#: Weight decay: the best of DECAYS by ``choose_decay`` over the training rows of the test tables.
DECAY, DECAYS, FOLDS = 1e-3, (1e-4, 1e-3, 1e-2), 4

_GROUPS = [
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"\t\r\x0b\x0c", b".", b",",
    b"!", b"?", b"|", b"%", b"#", b"&", b"$", b"*", b"'\"`", b"@", b":;", b"/\\", b"_-+=~^", b"()[]{}<>",
    bytes(range(0x80, 0xC0)), bytes(range(0xC0, 0x100)),
]
_CLASS = np.full(256, len(_GROUPS), dtype=np.int64)
for _k, _g in enumerate(_GROUPS):
    _CLASS[np.frombuffer(_g, np.uint8)] = _k
_CLASSES = len(_GROUPS) + 1
_SHAPES = 10
#: Hashed words: each word, and each pair of words that follow each other, adds a sign to one of so many places.
HASHED = 64
FEATURES = _CLASSES + _SHAPES + HASHED


def _encode(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row of each passage, its features) for all passages of the rows; an empty row has one of zeros."""
    passages = np.maximum(1, -(-words.count // PASSAGE_WORDS))
    base = np.concatenate(([0], np.cumsum(passages)))
    m = int(base[-1])
    row = np.repeat(np.arange(words.rows), passages)
    in_row = np.arange(len(words.start)) - words.first[words.row]
    of = base[words.row] + in_row // PASSAGE_WORDS
    out = np.zeros((m, FEATURES))
    begin = words.offsets[row].astype(np.int64)
    later = np.arange(m) - base[row] > 0
    begin[later] = words.start[words.first[row[later]] + (np.arange(m) - base[row])[later] * PASSAGE_WORDS]
    size = np.diff(np.concatenate((begin, [len(words.raw)])))
    by_class = np.bincount(
        np.repeat(np.arange(m) * _CLASSES, size) + _CLASS[words.raw], minlength=m * _CLASSES
    ).reshape(m, _CLASSES)
    out[:, :_CLASSES] = np.sqrt(by_class / np.maximum(size, 1)[:, None])
    n = np.bincount(of, minlength=m)
    some = np.maximum(n, 1)
    length = words.end - words.start
    mean = np.bincount(of, length, minlength=m) / some
    out[:, _CLASSES] = np.log1p(mean)
    spread = np.bincount(of, length.astype(float) ** 2, minlength=m) / some - mean**2
    out[:, _CLASSES + 1] = np.log1p(np.sqrt(np.maximum(spread, 0)))
    order = np.lexsort((words.hash, of))
    o, h = of[order], words.hash[order]
    new = np.ones(len(o), dtype=bool)
    new[1:] = (o[1:] != o[:-1]) | (h[1:] != h[:-1])
    out[:, _CLASSES + 2] = np.bincount(o[new], minlength=m) / some
    again = np.zeros(len(of), dtype=bool)
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (of[1:] == of[:-1])
    out[:, _CLASSES + 3] = np.bincount(of[again], minlength=m) / some
    kind = _CLASS[words.raw[words.start]] if len(of) else np.zeros(0, np.int64)
    last = _CLASS[words.raw[words.end - 1]] if len(of) else np.zeros(0, np.int64)
    for k, flag in enumerate((kind == 1, kind <= 1, (last > 1) & (last < 22), kind == last, length == 1)):
        out[:, _CLASSES + 4 + k] = np.bincount(of[flag], minlength=m) / some
    out[:, _CLASSES + 9] = np.log1p(words.count[row]) / 5
    with np.errstate(over="ignore"):
        pair = mix(words.hash[:-1] * np.uint64(0x9E3779B97F4A7C15) + words.hash[1:])
    pair, whose = pair[of[1:] == of[:-1]], of[1:][of[1:] == of[:-1]]
    for value, owner in ((words.hash, of), (pair, whose)):
        place = owner * HASHED + (value >> np.uint64(58)).astype(np.int64)
        sign = 1.0 - 2.0 * (value & np.uint64(1)).astype(float)
        out[:, _CLASSES + _SHAPES :] += np.bincount(place, sign, minlength=m * HASHED).reshape(m, HASHED)
    out[:, _CLASSES + _SHAPES :] /= np.sqrt(some)[:, None]
    return row, out


def passages(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row past the last, passage rows, passage features) by runs of rows."""
    for lo, hi, words in chunks(texts, fold=False):
        row, x = _encode(words)
        yield lo, hi, row, x


class AttentionModel:
    """Passage encoder, gated attention over a document's passages, and a logistic score of their weighted mean."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @staticmethod
    def _softmax(e: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        top = np.full(rows, -np.inf)
        np.maximum.at(top, row, e)
        a = np.exp(e - top[row])
        return a / np.bincount(row, a, minlength=rows)[row]

    def _forward(self, x, row, rows):
        w = self.w
        h = np.tanh((x - w["mean"]) / w["scale"] @ w["W"] + w["b"])
        t = np.tanh(h @ w["V"] + w["bv"])
        s = 1 / (1 + np.exp(-(h @ w["U"] + w["bu"])))
        a = self._softmax(t * s @ w["w"], row, rows)
        z = np.stack([np.bincount(row, a * h[:, k], minlength=rows) for k in range(h.shape[1])], axis=1)
        return h, t, s, a, z, 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["c0"], -30, 30)))

    def score(self, x: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        return self._forward(x, row, rows)[-1]

    def gradient(self, x: np.ndarray, row: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Slope of the weighted logistic loss of documents in each fitted parameter."""
        w, rows = self.w, len(y)
        h, t, s, a, z, p = self._forward(x, row, rows)
        d = (p - y) * weight
        dzp = (d[:, None] * w["c"])[row]
        da = (h * dzp).sum(axis=1)
        de = a * (da - np.bincount(row, a * da, minlength=rows)[row])
        dt = de[:, None] * w["w"] * s * (1 - t * t)
        ds = de[:, None] * w["w"] * t * s * (1 - s)
        dh = (a[:, None] * dzp + dt @ w["V"].T + ds @ w["U"].T) * (1 - h * h)
        return {
            "W": ((x - w["mean"]) / w["scale"]).T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "bv": dt.sum(axis=0),
            "U": h.T @ ds, "bu": ds.sum(axis=0), "w": (t * s).T @ de, "c": z.T @ d, "c0": np.array([d.sum()]),
        }

    @classmethod
    def fit(cls, x: np.ndarray, row: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float = DECAY) -> AttentionModel:
        """Full-batch Adam on the weighted logistic loss; the same input gives the same model."""
        rng = np.random.default_rng(7)
        f, rows = x.shape[1], len(y)
        g = lambda *n: rng.standard_normal(n) / np.sqrt(n[0])
        w = {
            "W": g(f, HIDDEN), "b": np.zeros(HIDDEN), "V": g(HIDDEN, ATTENTION), "bv": np.zeros(ATTENTION),
            "U": g(HIDDEN, ATTENTION), "bu": np.zeros(ATTENTION), "w": g(ATTENTION), "c": g(HIDDEN), "c0": np.zeros(1),
        }
        fixed = {"mean": x.mean(axis=0), "scale": x.std(axis=0) + 1e-3}
        model = cls(w | fixed)
        first = {k: np.zeros_like(v) for k, v in w.items()}
        second = {k: np.zeros_like(v) for k, v in w.items()}
        weight = weight / weight.sum()
        scaled = (x - fixed["mean"]) / fixed["scale"]
        for step in range(1, EPOCHS + 1):
            grad = model.gradient(x, row, y, weight)
            for k in w:
                grad[k] = grad[k] + decay * w[k]
                first[k] = 0.9 * first[k] + 0.1 * grad[k]
                second[k] = 0.999 * second[k] + 0.001 * grad[k] ** 2
                w[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
            model = cls(w | fixed)
        return model


def _held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, row, x in passages(batch.column(3)):
            cut = np.searchsorted(row, np.arange(hi - lo + 1))
            data = [x[a:b].astype("<f4").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:3], pa.array(data, pa.binary())], ["doc_id", "label", "weight", "bag"]
            )


def _sample(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fit_docs: int, fit_passages: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """(passage features, document of each, labels, weights) of the training sample; none without labelled documents."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~_held_out(F.col("doc_id")))
    shares = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    some = None
    for label, n in sorted(shares.items()):
        one = known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs)
        one = one.withColumn("weight", F.lit(n / min(n, fit_docs)))
        some = one if some is None else some.unionByName(one)
    if some is None:
        return None
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    some = some.groupBy("doc_id", "label").agg(F.sum("weight").alias("weight"))
    bags = plain.join(F.broadcast(some), "doc_id").groupBy("doc_id", "label", "weight").agg(F.min("text").alias("text"))
    # Whole documents by hash, as long as their passages (at least half a character to a word) fit the bound.
    most = F.greatest(F.lit(1), F.ceil((F.coalesce(F.octet_length("text"), F.lit(0)) + 1) / 2 / PASSAGE_WORDS))
    upto = Window.orderBy(F.xxhash64("doc_id"), "doc_id", "label").rowsBetween(Window.unboundedPreceding, 0)
    sizes = bags.select("doc_id", "label", most.alias("most"))
    taken = sizes.withColumn("upto", F.sum("most").over(upto)).where(F.col("upto") <= fit_passages)  # a row for each document of the sample
    bags = bags.join(F.broadcast(taken.select("doc_id", "label")), ["doc_id", "label"]).select("doc_id", "label", "weight", "text")
    rows = bags.mapInArrow(_bags, "doc_id long, label int, weight double, bag binary").collect()
    rows.sort(key=lambda r: (r.doc_id, r.label, bytes(r.bag)))
    if not rows:
        return None
    x = [np.frombuffer(r.bag, "<f4").reshape(-1, FEATURES) for r in rows]
    row = np.repeat(np.arange(len(rows)), [len(b) for b in x])
    return np.concatenate(x).astype(float), row, np.array([r.label for r in rows], float), np.array([r.weight for r in rows])


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    fit_docs: int = FIT_DOCS,
    fit_passages: int = FIT_PASSAGES,
    decay: float = DECAY,
) -> AttentionModel:
    """The model fitted on at most ``fit_docs`` labelled documents of each class, with all of their passages.

    Documents with crc32(id) mod 4 = 2 are held out. The sample is the ids of
    least hash; weights restore the classes' shares. It ends before its
    passages could exceed ``fit_passages``, which bounds what the driver holds.
    Only that bounded sample is broadcast and only its passage features reach
    the driver. Labels other than 0 and 1, null ids and ids without a document
    are passed over; ids labelled twice count twice, and of texts that repeat
    an id the least is used. Without any label the score is 0.5.
    """
    sample = _sample(docs, labels, id_col, text_col, label_col, fit_docs, fit_passages)
    return AttentionModel(_neutral()) if sample is None else AttentionModel.fit(*sample, decay=decay)


def choose_decay(docs: DataFrame, labels: DataFrame, decays: tuple = DECAYS, folds: int = FOLDS, fit_docs: int = FIT_DOCS, **names) -> tuple[float, dict[float, float]]:
    """(the best weight decay, weighted log loss by decay): folds within the training sample alone; ties go to the stronger decay.

    Every ``folds``-th document is scored by a model of the others. Held-out
    rows take no part.
    """
    sample = _sample(docs, labels, names.get("id_col", "doc_id"), names.get("text_col", "text"), names.get("label_col", "quality"), fit_docs, names.get("fit_passages", FIT_PASSAGES))
    if sample is None:
        return max(decays), {}
    x, row, y, weight = sample
    losses = dict.fromkeys(decays, 0.0)
    for fold in range(folds):
        own = np.arange(len(y)) % folds == fold
        parts_ = []
        for side in (~own, own):
            keep = side[row]
            parts_.append((x[keep], np.searchsorted(np.flatnonzero(side), row[keep]), y[side], weight[side]))
        for decay in decays:
            if len(parts_[0][2]) and len(parts_[1][2]):
                p = AttentionModel.fit(*parts_[0], decay=decay).score(parts_[1][0], parts_[1][1], len(parts_[1][2]))
                right = np.where(parts_[1][2] == 1, p, 1 - p)
                losses[decay] -= float((parts_[1][3] * np.log(np.maximum(right, 1e-12))).sum() / weight.sum())
    return min(sorted(decays, reverse=True), key=lambda d: round(losses[d], 9)), losses


def _neutral() -> dict[str, np.ndarray]:
    zero = np.zeros
    return {
        "mean": zero(FEATURES), "scale": np.ones(FEATURES), "W": zero((FEATURES, 1)), "b": zero(1), "V": zero((1, 1)),
        "bv": zero(1), "U": zero((1, 1)), "bu": zero(1), "w": zero(1), "c": zero(1), "c0": zero(1),
    }


def score_quality(docs: DataFrame, model: AttentionModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text, between 0 and 1 (null: as empty). No shuffle.

    An existing ``score_col`` is replaced; row count and other columns stay.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model.w)
    out = docs.drop(score_col)
    at = out.columns.index(text_col)
    # mapInArrow takes no dots in names: columns go through it by number.
    flat = out.toDF(*(f"c{k}" for k in range(len(out.columns))))
    schema = flat.withColumn("score", F.lit(None).cast("double")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = AttentionModel(shared.value)
        for batch in parts(batches):
            score = np.zeros(batch.num_rows)
            for lo, hi, row, x in passages(batch.column(at)):
                score[lo:hi] = scorer.score(x.astype("<f4").astype(float), row, hi - lo)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, "score"])

    return flat.mapInArrow(run, schema).toDF(*out.columns, score_col)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every whole text of ``documents``, learnt from ``labels.quality``."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, fit_quality(docs, read(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        _held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
