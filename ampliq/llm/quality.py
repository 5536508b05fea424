"""Quality classifier by co-training of two views.

One classifier sees the text's content (which runs of five bytes occur), the other the page's metadata and layout (source, language, length, lines,
shares of kinds of characters). Both start from the labelled rows; over rounds each labels the unlabelled rows it is sure of for the other. Held-out
labels calibrate both views and the weights with which they are combined, and the combination scores every document.

Only the labelled rows are sampled (``LABELLED``). Every round labels all unlabelled rows in Spark tasks, which return sums of loss and gradient, so the
driver holds weights only; scoring covers all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import first_by_hash, stored
from .words import LOWER, U64, buffers, mix, pieces

#: Labelled rows of each class that the classifiers are fitted on at most; chosen by the hash of their ids.
LABELLED = 20_000
#: Places for hashed runs of bytes, runs that are kept, least score of a kept run, bytes in a run.
PLACES_BITS, FEATURES, LEAST_Z, GRAM = 19, 4_096, 4.0, 5
ROUNDS, SURE = 3, 0.98
#: Passes over the unlabelled rows in a round, at most.
PASSES = 8
#: Probability of good quality at and above which a document is kept.
KEEP_AT = 0.5
_LINES, _HASHED = 10, 64
#: Bytes of text whose runs are held at once: each takes a few numbers of eight bytes.
PIECE = 1 << 20


# -- views


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, place) of every run of ``GRAM`` bytes inside a text, lower-cased."""
    data, at = buffers(column)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = LOWER[data]
    runs = np.ndarray(shape=(len(data),), dtype="<u8", buffer=padded, strides=(1,))
    sizes = np.maximum(np.diff(at) - GRAM + 1, 0)
    text = np.repeat(np.arange(len(sizes)), sizes)
    start = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(at[:-1], sizes)
    place = mix(runs[start] & U64((1 << 8 * GRAM) - 1)) >> U64(64 - PLACES_BITS)
    return text, place.astype(np.int64)


def occurring(column: pa.Array, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of the distinct chosen features of each text; ``chosen`` maps places to features or -1."""
    text, place = grams(column)
    feature = chosen[place]
    held = feature >= 0
    pairs = np.unique(text[held] * (FEATURES + 1) + feature[held])
    return pairs // (FEATURES + 1), pairs % (FEATURES + 1)


def _fold(values: list) -> np.ndarray:
    """A place in ``_HASHED`` for each value, by a digest of the whole of it."""
    place = {v: int.from_bytes(blake2b((v or "").encode(), digest_size=8).digest(), "little") % _HASHED for v in set(values)}
    return np.fromiter(map(place.__getitem__, values), np.int64, len(values))


def layout(batch: pa.RecordBatch, text: str, source: str, lang: str) -> np.ndarray:
    """A row of numbers for each document: layout measures, then places for source and language."""
    data, at = buffers(batch.column(text))
    n = len(at) - 1
    sizes = np.diff(at)
    of = np.repeat(np.arange(n), sizes)
    letters = np.zeros((256,), np.int64)
    for kind, values in enumerate((range(97, 123), range(65, 91), range(48, 58), (32, 9), (10, 13), (44, 46), [b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ",."], range(128, 256)), 1):
        letters[list(values)] = kind
    counts = np.bincount(of * 9 + letters[data], minlength=9 * n).reshape(n, 9).astype(float)
    share = counts[:, 1:] / np.maximum(sizes, 1)[:, None]
    lines = counts[:, 5] + 1
    words = counts[:, 4] + counts[:, 5] + 1
    # Places where a byte equals the one a short word earlier tell of repetition.
    repeated = np.zeros(n)
    for lag in (1, 4, 5, 6, 8):
        if len(data) > lag:
            same = (data[lag:] == data[:-lag]) & (of[lag:] == of[:-lag])
            repeated = np.maximum(repeated, np.bincount(of[lag:][same], minlength=n) / np.maximum(sizes, 1))
    measures = np.column_stack([np.sqrt(share), np.log1p(sizes) / 10, np.log1p(lines) / 5, np.log1p(sizes / lines) / 5, np.log1p(sizes / words) / 3, repeated])
    out = np.zeros((n, measures.shape[1] * _LINES + 2 * _HASHED))
    # Each measure as a soft histogram: a linear model can then prefer any range of it.
    centres = np.linspace(0, 1, _LINES)
    soft = np.maximum(0, 1 - np.abs(measures[:, :, None] - centres) * (_LINES - 1))
    soft[:, :, -1] = np.where(measures >= 1, 1, soft[:, :, -1])
    out[:, : measures.shape[1] * _LINES] = soft.reshape(n, -1)
    base = measures.shape[1] * _LINES
    out[np.arange(n), base + _fold(batch.column(source).to_pylist())] = 1
    out[np.arange(n), base + _HASHED + _fold(batch.column(lang).to_pylist())] = 1
    return out


# -- linear models


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Sparse:
    """0/1 rows: the columns of the ones, and where each row's begin. Worked on some rows at a time, so that nothing grows but the ones themselves."""

    ROWS = 2_048

    def __init__(self, at: np.ndarray, column: np.ndarray, shape: tuple[int, int]):
        self.at, self.column, self.shape = at, column.astype(np.int32), shape

    def _parts(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        for low in range(0, self.shape[0], self.ROWS):
            at = self.at[low : low + self.ROWS + 1]
            yield slice(low, low + len(at) - 1), at - at[0], self.column[at[0] : at[-1]]

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(self.shape[0])
        for rows, at, column in self._parts():
            total = np.append(0.0, np.cumsum(w[column]))
            out[rows] = total[at[1:]] - total[at[:-1]]
        return out

    def back(self, r: np.ndarray) -> np.ndarray:
        out = np.zeros(self.shape[1])
        for rows, at, column in self._parts():
            out += np.bincount(column, np.repeat(r[rows], np.diff(at)), self.shape[1])
        return out


class Dense:
    def __init__(self, x: np.ndarray):
        self.x, self.shape = x.astype(np.float32), x.shape

    def dot(self, w: np.ndarray) -> np.ndarray:
        return (self.x @ w.astype(np.float32)).astype(float)

    def back(self, r: np.ndarray) -> np.ndarray:
        return (r.astype(np.float32) @ self.x).astype(float)


def fit_logistic(x: Sparse | Dense, y: np.ndarray, weight: np.ndarray, penalty: float = 0.1, steps: int = 200, start: np.ndarray | None = None) -> np.ndarray:
    """Weights and, last, the bias of a logistic regression with an L2 penalty, by gradient steps scaled for each weight."""
    w, squares = np.zeros(x.shape[1] + 1) if start is None else start.copy(), np.full(x.shape[1] + 1, 1e-8)
    total = weight.sum() or 1.0
    for _ in range(steps):
        r = weight * (_sigmoid(x.dot(w[:-1]) + w[-1]) - y)
        g = np.append(x.back(r) + penalty * w[:-1], r.sum()) / total
        squares += g * g
        w -= 0.5 * g / np.sqrt(squares)
    return w


def descend(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, passes: int) -> np.ndarray:
    """The best point found from ``start`` by a quasi-Newton method (L-BFGS) with so many calls of ``loss`` (value, gradient)."""
    value, g = loss(start)
    w, steps, step = start, [], 1.0
    for _ in range(passes - 1):
        d, back = g.copy(), []
        for s, y in reversed(steps):
            back.append((s @ d) / (s @ y))
            d -= back[-1] * y
        if steps:
            s, y = steps[-1]
            d *= (s @ y) / (y @ y)
        for (s, y), a in zip(steps, reversed(back)):
            d += (a - (y @ d) / (s @ y)) * s
        size = step if steps else step / max(1.0, float(np.linalg.norm(g)))
        at = w - size * d
        new, new_g = loss(at)
        if new > value - 1e-4 * size * (g @ d):
            step /= 4  # too far: try nearer
            continue
        if (at - w) @ (new_g - g) > 1e-12:
            steps.append((at - w, new_g - g))
        w, value, g, step = at, new, new_g, 1.0
    return w


def sums(x: Sparse | Dense, y: np.ndarray, weight: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Logistic loss and its gradient over weighted rows."""
    z = x.dot(w[:-1]) + w[-1]
    r = weight * (_sigmoid(z) - y)
    return float(weight @ (np.logaddexp(0, z) - y * z)), np.append(x.back(r), r.sum())


def taught(raw: np.ndarray, sure: float = SURE) -> tuple[np.ndarray, np.ndarray]:
    """(whether a view is sure of each row, the label it gives)."""
    p = _sigmoid(raw)
    return (p >= sure) | (p <= 1 - sure), (p >= 0.5).astype(float)


#: By the weights that label and the present ones of both views: for each view loss, gradient and number of the rows that the other one is sure of.
Far = Callable[[list[np.ndarray], list[np.ndarray]], list[tuple[float, np.ndarray, int]]]


@dataclass
class Model:
    """What scoring needs: the chosen runs, both views' weights, their calibration and combination."""

    chosen: np.ndarray = field(default_factory=lambda: np.full(1 << PLACES_BITS, -1, np.int32))
    text: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES + 1))
    page: np.ndarray = field(default_factory=lambda: np.zeros(1))
    calibration: tuple[tuple[float, float], tuple[float, float]] = ((1.0, 0.0), (1.0, 0.0))
    combine: tuple[float, float, float] = (1.0, 1.0, 0.0)
    pseudo_labels: list[tuple[int, int]] = field(default_factory=list)

    def score(self, text: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(combined, text view, page view): probabilities of good quality from both views' raw scores."""
        a, b = (s * slope + shift for s, (slope, shift) in zip((text, page), self.calibration))
        wa, wb, bias = self.combine
        return _sigmoid(wa * a + wb * b + bias), _sigmoid(a), _sigmoid(b)


def co_train(text: Sparse, page: Dense, label: np.ndarray, held: np.ndarray, rounds: int = ROUNDS, sure: float = SURE, far: Far | None = None) -> Model:
    """Fit both views. ``label``: 1 good, 0 bad, -1 unlabelled; ``held``: labelled rows kept back for calibration.

    With ``far`` the unlabelled rows are elsewhere and only their sums come here.
    """
    model = Model()
    known = (label >= 0) & ~held
    start = np.where(known, label, 0).astype(float)
    y = [start.copy(), start.copy()]
    weight = [known.astype(float), known.astype(float)]
    views: list[Sparse | Dense] = [text, page]
    fitted: list[np.ndarray] = []
    if far is not None:
        fitted = [fit_logistic(x, y[k], weight[k]) for k, x in enumerate(views)]
        for _ in range(rounds):
            fitted, told = _taught_by_far(views, start, known.astype(float), fitted, far)
            model.pseudo_labels.append((told[1], told[0]))
        raw = [x.dot(w[:-1]) + w[-1] for x, w in zip(views, fitted)]
    for step in range(rounds + 1 if far is None else 0):
        # Later rounds go on from where the first one ended.
        fitted = [fit_logistic(x, y[k], weight[k], steps=60 if step else 200, start=fitted[k] if step else None) for k, x in enumerate(views)]
        raw = [x.dot(w[:-1]) + w[-1] for x, w in zip(views, fitted)]
        if step == rounds or not (label < 0).any():
            break
        # Each view labels for the other what it is sure of; a label counts half as much as a given one.
        for k, other in ((0, 1), (1, 0)):
            certain, given = taught(raw[k], sure)
            told = (label < 0) & certain
            y[other] = np.where(told, given, y[other])
            weight[other] = np.where(label < 0, 0.5 * told, weight[other])
        model.pseudo_labels.append((int((weight[1][label < 0] > 0).sum()), int((weight[0][label < 0] > 0).sum())))
    model.text, model.page = fitted
    own = held & (label >= 0)
    if own.sum() >= 20 and 0 < label[own].mean() < 1:
        yy, one = label[own].astype(float), np.ones(int(own.sum()))
        for k in range(2):
            s, t = fit_logistic(Dense(raw[k][own, None]), yy, one, 0.01, 400)
            model.calibration = (model.calibration[0], (s, t)) if k else ((s, t), model.calibration[1])
        both = np.column_stack([raw[k][own] * s + t for k, (s, t) in enumerate(model.calibration)])
        a, b, bias = fit_logistic(Dense(both), yy, one, 0.01, 400)
        model.combine = (max(a, 0.0), max(b, 0.0), bias)
    return model


def _taught_by_far(views: list[Sparse | Dense], y: np.ndarray, weight: np.ndarray, fitted: list[np.ndarray], far: Far, penalty: float = 0.1) -> tuple[list[np.ndarray], list[int]]:
    """One round over all unlabelled rows: (weights of both views, numbers of rows each was taught).

    A told label counts half as much as a given one, and all of them together at most half as much as all given ones, however many they are.
    """
    cut, told = len(fitted[0]), [0, 0]

    def loss(joint: np.ndarray) -> tuple[float, np.ndarray]:
        value, gradient = 0.0, []
        now = [joint[:cut], joint[cut:]]
        for k, (own, own_g, n) in enumerate(far(fitted, now)):
            told[k] = n
            share = 0.5 * min(1.0, weight.sum() / max(n, 1))
            given, given_g = sums(views[k], y, weight, now[k])
            plain = np.append(now[k][:-1], 0.0)
            total = weight.sum() + share * n or 1.0
            value += (given + share * own + penalty / 2 * float(plain @ plain)) / total
            gradient.append((given_g + share * own_g + penalty * plain) / total)
        return value, np.concatenate(gradient)

    joint = descend(loss, np.concatenate(fitted), PASSES)
    return [joint[:cut], joint[cut:]], told


# -- Spark


def _named(labels: DataFrame, id: str, good: str) -> DataFrame:
    """One ``_label`` for each labelled ``_id``."""
    return labels.select(F.col(f"`{id}`").alias("_id"), F.expr(good).cast("int").alias("_label")).where("_id is not null and _label is not null").groupBy("_id").agg(F.min("_label").alias("_label"))


def _sample(docs: DataFrame, named: DataFrame, id: str) -> DataFrame:
    """Bounded rows of ``docs`` with ``_label``: for each class the first by the hash of the id."""
    ids = docs.select(F.col(f"`{id}`").alias("_id")).where("_id is not null")
    known = named.join(ids.distinct(), "_id", "left_semi")
    parts = [first_by_hash(known.where(F.col("_label") == k), "_id", LABELLED) for k in (0, 1)]
    chosen = stored(parts[0].union(parts[1]), "sample-ids")
    # At most 2 x LABELLED ids.
    return docs.join(F.broadcast(chosen), F.col(f"`{id}`") == F.col("_id"))


def _far(rows: DataFrame) -> Far:
    """Sums over stored rows of (bits: one for each chosen run, page: layout)."""
    spark, size = rows.sparkSession, 512

    def far(frozen: list[np.ndarray], now: list[np.ndarray]) -> list[tuple[float, np.ndarray, int]]:
        pairs = [np.column_stack([a, b]).astype(np.float32) for a, b in zip(frozen, now)]
        shared = spark.sparkContext.broadcast(pairs)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w = shared.value
            # For each view: gradient, then loss and number.
            total = [np.zeros(len(x) + 2) for x in w]
            for batch in batches:
                for low in range(0, batch.num_rows, size):
                    part = batch.slice(low, size)
                    bits, page = (np.frombuffer(b"".join(part.column(c).to_pylist()), kind).reshape(part.num_rows, -1) for c, kind in (("bits", np.uint8), ("page", np.float16)))
                    x = [np.unpackbits(bits, axis=1).astype(np.float32), page.astype(np.float32)]
                    z = [a @ b[:-1] + b[-1] for a, b in zip(x, w)]
                    for k in (0, 1):
                        certain, y = taught(z[1 - k][:, 0].astype(float))
                        own = z[k][:, 1].astype(float)
                        r = certain * (_sigmoid(own) - y)
                        total[k] += np.concatenate([r.astype(np.float32) @ x[k], [r.sum(), certain @ (np.logaddexp(0, own) - y * own), certain.sum()]])
            joint = np.concatenate(total)
            cuts = range(0, len(joint), 512)
            yield pa.RecordBatch.from_arrays([pa.array([c // 512 for c in cuts], pa.int32()), pa.array([joint[c : c + 512].tobytes() for c in cuts], pa.binary())], ["block", "sums"])

        def merge(group: pa.Table) -> pa.Table:
            total = np.sum([np.frombuffer(x) for x in group.column("sums").to_pylist()], axis=0)
            return pa.table([group.column("block").slice(0, 1), pa.array([total.tobytes()], pa.binary())], ["block", "sums"])

        schema = T.StructType().add("block", T.IntegerType()).add("sums", T.BinaryType())
        got = sorted((r.block, r.sums) for r in rows.mapInArrow(add, schema).groupBy("block").applyInArrow(merge, schema).collect())
        shared.unpersist()
        joint = np.frombuffer(b"".join(x for _, x in got)) if got else np.zeros(sum(len(x) + 2 for x in now))
        cut = len(now[0]) + 2
        return [(float(x[-2]), x[:-2], int(x[-1])) for x in (joint[:cut], joint[cut:])]

    return far


def _places(rows: DataFrame) -> np.ndarray:
    """For every place the number of bad and of good documents in which it occurs; a fixed number of counters."""
    size = 1 << PLACES_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size), np.int32)
        for batch in batches:
            for piece in pieces(batch, "_text", PIECE):
                label = piece.column("_label").to_numpy()
                text, place = grams(piece.column("_text"))
                pairs = np.unique(text * size + place)
                for k in (0, 1):
                    total[k] += np.bincount(pairs[label[pairs // size] == k] % size, minlength=size).astype(np.int32)
        blocks = total.reshape(-1, 4096)
        used = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([blocks[k].tobytes() for k in used], pa.binary())], ["block", "counts"])

    def add(group: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x, np.int32) for x in group.column("counts").to_pylist()], axis=0, dtype=np.int64)
        return pa.table([group.column("block").slice(0, 1), pa.array([total.astype(np.int32).tobytes()], pa.binary())], ["block", "counts"])

    schema = T.StructType().add("block", T.IntegerType()).add("counts", T.BinaryType())
    out = np.zeros((2 * size // 4096, 4096), np.int64)
    for r in rows.where("_label >= 0").select("_label", "_text").mapInArrow(count, schema).groupBy("block").applyInArrow(add, schema).collect():
        out[r.block] = np.frombuffer(r.counts, np.int32)
    return out.reshape(2, size)


def choose(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Places to features: those whose shares in bad and good documents differ most for their size, or -1."""
    n0, n1 = max(totals[0], 1), max(totals[1], 1)
    p0, p1, p = counts[0] / n0, counts[1] / n1, counts.sum(axis=0) / (n0 + n1)
    z = np.abs(p1 - p0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n0 + 1 / n1))
    best = np.argsort(-z, kind="stable")[:FEATURES]
    best = best[z[best] >= LEAST_Z]
    out = np.full(counts.shape[1], -1, np.int32)
    out[best] = np.arange(len(best))
    return out


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", good: str = "quality = 1 and toxic = 0", rounds: int = ROUNDS) -> Model:
    """Fit on a bounded sample of the labelled ``docs`` and on all unlabelled ones; ``good`` is the SQL condition on ``labels`` for good quality.

    A row labelled twice is bad if either label says so; labels without a document, or with null in them, don't count. Without labels of both
    classes nothing can be learned: the model then finds every document good.
    """
    spark = docs.sparkSession
    rows = docs.select(id, F.col(f"`{text}`").alias("_text"), F.col(f"`{source}`").cast("string").alias("_source"), F.col(f"`{lang}`").cast("string").alias("_lang"))
    named = _named(labels, id, good)
    # A fifth of the labelled rows is kept back for calibration; features, too, are chosen without them.
    back = (F.pmod(F.xxhash64(F.col("_id").cast("string")), F.lit(5)) == 0).alias("_held")
    sample = stored(_sample(rows, named, id).select("_id", "_label", "_text", "_source", "_lang", back).repartition(24), "sample")
    taught = sample.where("not _held")
    totals = {r[0]: r[1] for r in taught.groupBy("_label").count().collect()}
    if not totals.get(0) or not totals.get(1):
        return Model(combine=(0.0, 0.0, 9.0), page=np.zeros(0))
    chosen = choose(_places(taught), np.array([totals[0], totals[1]]))
    shared = spark.sparkContext.broadcast(chosen)

    def views(packed: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in pieces(batch, "_text", PIECE):
                    row, feature = occurring(piece.column("_text"), shared.value)
                    page = [x.astype(np.float16).tobytes() for x in layout(piece, "_text", "_source", "_lang")]
                    if packed:
                        ones = np.zeros((piece.num_rows, FEATURES), bool)
                        ones[row, feature] = True
                        found = [x.tobytes() for x in np.packbits(ones, axis=1)]
                    else:
                        at = np.searchsorted(row, np.arange(piece.num_rows + 1))
                        found = [feature[a:b].astype(np.int16).tobytes() for a, b in zip(at[:-1], at[1:])]
                    own = [] if packed else [piece.column("_label"), piece.column("_held")]
                    yield pa.RecordBatch.from_arrays([*own, piece.column("_id"), pa.array(found, pa.binary()), pa.array(page, pa.binary())], [*(["label", "held"] if own else []), "_id", "bits" if packed else "found", "page"])

        return run

    kind = rows.schema[id]
    schema = T.StructType().add("label", T.IntegerType()).add("held", T.BooleanType()).add("_id", kind.dataType).add("found", T.BinaryType()).add("page", T.BinaryType())
    got = sample.mapInArrow(views(False), schema).orderBy(F.xxhash64(F.col("_id").cast("string")), F.col("_id").cast("string")).toArrow()
    # Rows with any label are told apart by their views, which are far smaller than the texts.
    schema = T.StructType().add("_id", kind.dataType).add("bits", T.BinaryType()).add("page", T.BinaryType())
    made = rows.withColumnRenamed(id, "_id").mapInArrow(views(True), schema)
    rest = stored(made.join(named.select("_id"), "_id", "left_anti").select("bits", "page"), "unlabelled") if rounds else None
    label = got.column("label").to_numpy()
    found = [np.frombuffer(x, np.int16) for x in got.column("found").to_pylist()]
    sparse = Sparse(np.append(0, np.cumsum([len(f) for f in found])), np.concatenate(found), (len(found), FEATURES))
    page = Dense(np.stack([np.frombuffer(x, np.float16) for x in got.column("page").to_pylist()]))
    held = got.column("held").to_numpy().astype(bool)
    model = co_train(sparse, page, label, held, rounds, far=_far(rest) if rounds else None)
    model.chosen = chosen
    return model


_SCORES = ["score", "text_score", "page_score"]


def score(docs: DataFrame, model: Model, text: str = "text", source: str = "source", lang: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (by default all) with ``score``, the probability of good quality, and the two views' own, for every row.

    Null and empty texts are scored by what is left of them; null sources and languages count as empty ones; columns named like the three are replaced.
    """
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in _SCORES]
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(**shared.value)
        for batch in batches:
            for piece in pieces(batch, "_text", PIECE):
                row, feature = occurring(piece.column("_text"), m.chosen)
                a = np.bincount(row, m.text[feature], piece.num_rows) + m.text[-1]
                b = layout(piece, "_text", "_source", "_lang") @ m.page[:-1] + m.page[-1] if len(m.page) > 1 else np.zeros(piece.num_rows)
                made = [pa.array(x, pa.float64()) for x in m.score(a, b)]
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), *made], [*keep, *_SCORES])

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text"), F.col(f"`{source}`").cast("string").alias("_source"), F.col(f"`{lang}`").cast("string").alias("_lang"))
    return rows.mapInArrow(run, T.StructType([rows.schema[c] for c in keep] + [T.StructField(c, T.DoubleType()) for c in _SCORES]))
