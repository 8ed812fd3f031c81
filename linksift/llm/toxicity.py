"""Toxicity scores by a small convolutional text classifier, trained in numpy.

A word is the sum of two hashed embeddings: of the word and of its first four letters, which
inflected forms share. Filters of one, two and three words slide over the text, each keeps its
largest response (max pooling), and a logistic unit adds them up. Training reads every labelled row:
the rows are dealt into parts of about ``PART_ROWS``, each part trains the shared weights for a turn in
a task of its own, and what the parts changed is averaged before the next turn, an embedding over the
parts that met its word. Changes are added up as whole numbers in steps of 2^-``SCALE``, so the result
does not depend on the order of work. Scoring runs over every whole text, many texts at a time.

The cut-off is calibrated by language on all labelled rows left out of training, a fifth of each part: a text's language is
told from its own function words, and the score is shifted so that the best cut-off of that language
becomes ``CUT``. Only the text enters a score.

Null and empty texts score as texts without words. Labels that are null or belong to no document
are ignored; a repeated label of a document counts once, and of documents that share an id one text is
learned from. Without labels of both kinds all scores are the smoothed share of toxic labels. Repeated
rows score alike; very long texts are read whole, in overlapping chunks. An empty table gives no rows.
Carried columns travel in the struct ``row``, so that no names clash.
"""

from __future__ import annotations

import io
import json
import pickle
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linksift.llm.ranks import key_filter, maybe_in, small
from linksift.llm.tables import settle

#: Labelled rows that one task trains on; more rows make more parts.
PART_ROWS = 4_000
#: The parts' weights are averaged so many times, after at least so many steps in each part.
TURNS = 3
LEAST_STEPS = 150
SCALE = 30
#: Margins are counted in cells of 1 / ``FINE`` from -``REACH`` to ``REACH`` to find the cut-offs.
FINE, REACH = 1024, 32
CUT = 0.7
BUCKETS = 1 << 15
DEPTH = 16
WIDTHS = (1, 2, 3)
FILTERS = 16
STEPS = 1_200
BATCH = 32
LEFT_OUT = 5
KNOWN_WORDS = 300_000
CHUNK_WORDS = 20_000
SEED = 11
WORD = re.compile(r"[^\W_]+")
# Frequent function words by which a text's language is told.
FUNCTION_WORDS = {
    "en": ("the", "of", "and", "to", "in", "that", "is", "was", "for", "with"),
    "de": ("der", "die", "und", "den", "das", "von", "ist", "mit", "ein", "auf"),
    "fr": ("le", "les", "et", "des", "du", "une", "est", "pour", "dans", "que"),
    "es": ("el", "los", "y", "del", "una", "por", "con", "para", "las", "su"),
}


class Words:
    """Two embedding rows for every word of a text; remembers words."""

    def __init__(self):
        self.known: dict[str, tuple[int, int]] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = WORD.findall((text or "").lower())
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        for word in set(words).difference(self.known):
            whole = xxhash.xxh3_64_intdigest(word) % BUCKETS
            self.known[word] = (whole, BUCKETS + xxhash.xxh3_64_intdigest("^" + word[:4]) % BUCKETS)
        return np.array([self.known[w] for w in words], np.int64).reshape(-1, 2)


def language(text: str | None) -> str:
    words = WORD.findall((text or "").lower())
    counts = {}
    for word in words:
        counts[word] = counts.get(word, 0) + 1
    found = {k: sum(counts.get(w, 0) for w in ws) for k, ws in FUNCTION_WORDS.items()}
    best = max(found, key=found.get)
    return best if found[best] and list(found.values()).count(found[best]) == 1 else "other"


@dataclass
class Model:
    """Weights: embeddings (rows x DEPTH), one projection per filter and offset, output unit."""

    embed: np.ndarray
    filters: list[np.ndarray]  # by width: (width, DEPTH, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    base: float
    shift: dict[str, float] = field(default_factory=dict)

    def responses(self, words: np.ndarray) -> np.ndarray:
        """The response of every filter at every place of one padded stretch of words."""
        x = self.embed[words[:, 0]] + self.embed[words[:, 1]]
        n, parts = len(x) - max(WIDTHS) + 1, []
        for weights in self.filters:
            parts.append(sum(x[k : k + n] @ weights[k] for k in range(len(weights))))
        return np.concatenate(parts, axis=1)


def stored(model: Model) -> bytes:
    out = io.BytesIO()
    arrays = {f"filter{w}": weights for w, weights in zip(WIDTHS, model.filters)}
    np.savez(out, embed=model.embed, bias=model.bias, out=model.out, rest=json.dumps([model.base, model.shift]), **arrays)
    return out.getvalue()


def loaded(data: bytes) -> Model:
    found = np.load(io.BytesIO(data))
    base, shift = json.loads(str(found["rest"]))
    return Model(found["embed"], [found[f"filter{w}"] for w in WIDTHS], found["bias"], found["out"], base, shift)


def _start(rng: np.random.Generator, share: float) -> Model:
    embed = rng.normal(0, 0.1, (2 * BUCKETS + 1, DEPTH)).astype(np.float32)
    embed[-1] = 0  # the padding word
    filters = [rng.normal(0, 0.3, (w, DEPTH, FILTERS)).astype(np.float32) for w in WIDTHS]
    size = len(WIDTHS) * FILTERS
    out = rng.normal(0, 0.3, size).astype(np.float32)
    return Model(embed, filters, np.zeros(size, np.float32), out, float(np.log(share / (1 - share))))


def _stretch(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts joined with padding after each, and the place where each begins."""
    pad = np.full((max(WIDTHS) - 1, 2), 2 * BUCKETS, np.int64)
    blank = np.full((1, 2), 2 * BUCKETS, np.int64)
    parts, starts, at = [], [], 0
    for words in texts:
        words = words if len(words) else blank
        starts.append(at)
        parts += [words, pad]
        at += len(words) + len(pad)
    return np.concatenate(parts), np.array(starts)


def logits(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Of whole texts; long ones are read in overlapping chunks."""
    overlap = max(WIDTHS) - 1
    pieces, owner = [], []
    for at, words in enumerate(texts):
        for begin in range(0, max(1, len(words)), CHUNK_WORDS):
            pieces.append(words[begin : begin + CHUNK_WORDS + overlap])
            owner.append(at)
    best = np.full((len(texts), len(model.bias)), -np.inf, np.float32)
    first, held = 0, 0
    for last, piece in enumerate(pieces):
        held += len(piece) + overlap
        if held >= CHUNK_WORDS or last == len(pieces) - 1:
            stretch, starts = _stretch(pieces[first : last + 1])
            found = model.responses(stretch)
            for at in range(first, last + 1):
                # Places in the padding belong to no text, and where a text goes on its last
                # places belong to the next chunk.
                end = starts[at - first] + max(1, len(pieces[at]))
                goes_on = at + 1 < len(pieces) and owner[at + 1] == owner[at]
                found[end - overlap * goes_on : end + overlap] = -np.inf
            top = np.maximum.reduceat(found, starts, axis=0)
            np.maximum.at(best, owner[first : last + 1], top)
            first, held = last + 1, 0
    return np.maximum(best + model.bias, 0) @ model.out + model.base


class _Steps:
    """Adagrad steps for dense arrays and for single rows of the embeddings."""

    def __init__(self, rate: float):
        self.rate, self.sums = rate, {}

    def dense(self, name: str, weights: np.ndarray, grad: np.ndarray) -> None:
        total = self.sums.setdefault(name, np.full_like(weights, 1e-6))
        total += grad * grad
        weights -= self.rate * grad / np.sqrt(total)

    def rows(self, name: str, weights: np.ndarray, at: np.ndarray, grad: np.ndarray) -> None:
        total = self.sums.setdefault(name, np.full_like(weights, 1e-6))
        rows, inverse = np.unique(at, return_inverse=True)
        summed = np.zeros((len(rows), weights.shape[1]), np.float32)
        np.add.at(summed, inverse, grad)
        total[rows] += summed * summed
        weights[rows] -= self.rate * summed / np.sqrt(total[rows])


@dataclass
class Part:
    """The words, labels and languages of the rows that train in one task; every ``LEFT_OUT``-th row is left out."""

    number: int
    words: np.ndarray
    sizes: np.ndarray
    toxic: np.ndarray
    spoken: np.ndarray

    def ids(self, rows: np.ndarray | None = None, rare: np.ndarray | None = None) -> list[np.ndarray]:
        """The words of some texts (all), the rare ones as padding."""
        stops = np.cumsum(self.sizes)
        some = [self.words[stops[r] - self.sizes[r] : stops[r]] for r in (range(len(stops)) if rows is None else rows)]
        return some if rare is None else [np.where(rare[words], np.int32(2 * BUCKETS), words) for words in some]

    def left_out(self) -> np.ndarray:
        return np.arange(len(self.sizes)) % LEFT_OUT == LEFT_OUT - 1


LANGUAGES = [*FUNCTION_WORDS, "other"]


def _part(number: int, ids: list[np.ndarray], toxic: list[int], spoken: list[int]) -> Part:
    words = np.concatenate(ids).astype(np.int32)
    return Part(number, words, np.array([len(i) for i in ids], np.int64), np.array(toxic, np.int8), np.array(spoken, np.int8))


#: Adds up the arrays that some work gives for each part.
Sums = Callable[[Callable[[Part], list[np.ndarray]]], list[np.ndarray]]


def _sizes(part: Part) -> list[np.ndarray]:
    """Rows, toxic rows, the same of the rows trained on, and the texts that each embedding is met in."""
    y, inside = part.toxic.astype(np.int64), ~part.left_out()
    met = np.zeros(2 * BUCKETS + 1, np.int64)
    for found in part.ids():
        met[np.unique(found)] += 1
    return [np.array([len(y), y.sum(), inside.sum(), y[inside].sum()]), met]


def _whole(change: np.ndarray) -> np.ndarray:
    return np.rint(change.astype(np.float64) * (1 << SCALE)).astype(np.int64)


def _state(model: Model) -> dict[str, np.ndarray]:
    """All that a turn changes: the weights and, as ``sum:<name>``, their sums of squared gradients."""
    weights = {"embed": model.embed, "bias": model.bias, "out": model.out}
    weights |= {f"filter{number}": w for number, w in enumerate(model.filters)}
    sums = {f"sum:{name}": np.full_like(w, 1e-6) for name, w in weights.items()}
    return weights | sums | {"base": np.array([model.base])}


def _model(state: dict[str, np.ndarray]) -> Model:
    filters = [state[f"filter{number}"] for number in range(len(WIDTHS))]
    return Model(state["embed"], filters, state["bias"], state["out"], float(state["base"][0]))


def _turn(part: Part, state: dict[str, np.ndarray], rare: np.ndarray, weigh: tuple[float, float], turn: int, count: int) -> list[np.ndarray]:
    """The changes by some steps on one part, which embeddings changed, and the number of parts (one).

    Rare words have no embeddings that change, so only the others are told.
    """
    now = {name: values.copy() for name, values in state.items()}
    model, steps = _model(now), _Steps(0.05)
    steps.sums = {name[4:]: values for name, values in now.items() if name.startswith("sum:")}
    y, rows = part.toxic.astype(np.float32), np.flatnonzero(~part.left_out())
    weight = np.where(y == 1, *reversed(weigh))
    rng, order = np.random.default_rng([SEED, turn, part.number]), np.empty(0, np.int64)
    for _ in range(count):
        if len(order) < BATCH:
            order = np.append(order, rng.permutation(rows))
        batch, order = order[:BATCH], order[BATCH:]
        _train(model, steps, part.ids(batch, rare), y[batch], weight[batch])
    now["base"] = np.array([model.base])
    told = lambda name, values: values[~rare] if name.endswith("embed") else values
    changes = [_whole(told(name, now[name]) - told(name, state[name])) for name in state]
    moved = (now["embed"][~rare] != state["embed"][~rare]).any(axis=1)
    return [*changes, moved.astype(np.int64), np.array([1])]


def _margins(part: Part, model: Model, rare: np.ndarray) -> list[np.ndarray]:
    """The rows left out, counted by language, label and cell of their margin."""
    out = np.zeros((len(LANGUAGES), 2, 2 * REACH * FINE + 1), np.int64)
    held = np.flatnonzero(part.left_out())
    if len(held):
        found = np.clip(logits(model, part.ids(held, rare)), -REACH, REACH)
        np.add.at(out, (part.spoken[held], part.toxic[held], np.rint((found + REACH) * FINE).astype(np.int64)), 1)
    return [out]


def _fitted(over: Sums, parts: int, shared: Callable = lambda value: (lambda: value)) -> Model:
    """Train on all parts and calibrate the cut-offs on the rows left out; ``shared`` sends a value to the tasks."""
    (n, up, n_in, up_in), met = over(_sizes)
    model = _start(np.random.default_rng(SEED), float((up + 1) / (n + 2)))
    if up == 0 or up == n:
        model.out[:] = 0
        return model
    # Rows of the embeddings met in one text only say nothing about others; they stay zero.
    rare = met < 2
    model.embed[rare] = 0
    model.base = 0.0
    mean, state = up_in / n_in, _state(model)
    weigh = (0.5 / max(1 - mean, 1e-3), 0.5 / max(mean, 1e-3))  # of clean and toxic rows
    count = max(LEAST_STEPS, STEPS // TURNS // parts)
    for turn in range(TURNS):
        sent = shared((state, rare))
        *changes, moved, trained = over(lambda part, sent=sent, turn=turn: _turn(part, *sent(), weigh, turn, count))
        shares = {name: np.maximum(moved, 1)[:, None] if name.endswith("embed") else trained for name in state}
        for name, change in zip(state, changes):
            step = (change / shares[name] / (1 << SCALE)).astype(state[name].dtype)
            at = ~rare if name.endswith("embed") else slice(None)
            state[name][at] += step
    model = _model(state)
    sent = shared((model, rare))
    cells = over(lambda part: _margins(part, *sent()))[0]
    everywhere = _best_cut(cells.sum(axis=0), 0.0)
    model.shift = {name: _best_cut(own, everywhere) for name, own in zip(LANGUAGES, cells)}
    model.shift["other"] = everywhere
    return model


def fit(texts: list[str], toxic: list[int]) -> Model:
    """The model of a few rows, in one part on this machine."""
    words = Words()
    part = _part(0, [words(t) for t in texts] or [words("")], list(toxic) or [0], [LANGUAGES.index(language(t)) for t in texts] or [0])
    if not texts:
        part = Part(0, part.words[:0], part.sizes[:0], part.toxic[:0], part.spoken[:0])
    return _fitted(lambda work: work(part), 1)


def _train(model: Model, steps: _Steps, texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> None:
    stretch, starts = _stretch(texts)
    found = model.responses(stretch)
    stops = np.append(starts[1:] - max(WIDTHS) + 1, len(found))
    where = np.stack([a + found[a : max(b, a + 1)].argmax(0) for a, b in zip(starts, stops)])
    top = np.take_along_axis(found, where, 0) + model.bias
    pooled = np.maximum(top, 0)
    z = pooled @ model.out + model.base
    error = (weight * (1 / (1 + np.exp(-z)) - y) / len(y)).astype(np.float32)
    inner = error[:, None] * model.out[None, :] * (top > 0)
    steps.dense("out", model.out, pooled.T @ error)
    steps.dense("bias", model.bias, inner.sum(0))
    model.base -= 0.05 * float(error.sum())
    at, grads = [], []
    for number, weights in enumerate(model.filters):
        own = slice(number * FILTERS, (number + 1) * FILTERS)
        grad = np.empty_like(weights)
        for k in range(len(weights)):
            place = stretch[where[:, own] + k]  # (texts, filters, 2)
            x = model.embed[place[..., 0]] + model.embed[place[..., 1]]
            grad[k] = np.einsum("nfd,nf->df", x, inner[:, own])
            back = inner[:, own][..., None] * weights[k].T[None]
            for column in (0, 1):
                at.append(place[..., column].reshape(-1))
                grads.append(back.reshape(-1, DEPTH))
        steps.dense(f"filter{number}", weights, grad)
    steps.rows("embed", model.embed, np.concatenate(at), np.concatenate(grads))
    model.embed[-1] = 0


def _best_cut(cells: np.ndarray, default: float) -> float:
    """The cut-off with the fewest errors, in the lower part of the widest gap that has as few.

    ``cells`` are the clean and the toxic rows by cell of their margin.
    """
    if cells.sum(axis=1).min() < 5:
        return default
    met = np.flatnonzero(cells.sum(axis=0))
    z, (clean, toxic) = met / FINE - REACH, cells[:, met]
    below = np.concatenate([[0], np.cumsum(toxic)])  # toxic rows under the cut
    above = clean.sum() - np.concatenate([[0], np.cumsum(clean)])
    errors = below + above
    edges = np.concatenate([[z[0] - 2], z, [z[-1] + 2]])
    gaps = np.where(errors == errors.min(), edges[1:] - edges[:-1], -1)
    best = int(gaps.argmax())
    return float((2 * edges[best] + edges[best + 1]) / 3)


def score_texts(model: Model, texts: list[str | None], words: Words) -> np.ndarray:
    z = logits(model, [words(text) for text in texts])
    shift = np.array([model.shift.get(language(text), 0.0) for text in texts]) if model.shift else 0.0
    wanted = np.log(CUT / (1 - CUT)) if model.shift else 0.0
    return 1 / (1 + np.exp(-np.clip(z - shift + wanted, -30, 30)))


def _dealt(rows: DataFrame, parts: int) -> RDD:
    """Labelled texts (doc_id, text, toxic) as persisted ``Part``s, whatever their order."""
    number = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(parts))
    placed = rows.select(number.alias("number"), F.xxhash64("doc_id").alias("place"), "doc_id", "toxic", "text")
    placed = placed.repartition("number").sortWithinPartitions("number", "place", "doc_id", "toxic", "text")

    def packed(part: Part) -> pa.RecordBatch:
        arrays = [part.words, part.sizes, part.toxic, part.spoken]
        held = [pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in arrays]
        return pa.RecordBatch.from_arrays([pa.array([part.number]), *held], ["number", "words", "sizes", "toxic", "spoken"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, now, ids, toxic, spoken = Words(), None, [], [], []
        for batch in batches:
            for at, label, text in zip(*(batch.column(c).to_pylist() for c in ("number", "toxic", "text"))):
                if at != now and ids:
                    yield packed(_part(now, ids, toxic, spoken))
                    ids, toxic, spoken = [], [], []
                now = at
                ids.append(words(text).astype(np.int32))
                toxic.append(int(label == 1))
                spoken.append(LANGUAGES.index(language(text)))
        if ids:
            yield packed(_part(now, ids, toxic, spoken))

    def opened(row) -> Part:
        told = (np.frombuffer(row[c], kind) for c, kind in (("sizes", np.int64), ("toxic", np.int8), ("spoken", np.int8)))
        return Part(row["number"], np.frombuffer(row["words"], np.int32).reshape(-1, 2), *told)

    found = placed.mapInArrow(work, "number long, words binary, sizes binary, toxic binary, spoken binary")
    return found.rdd.map(opened).persist(StorageLevel.DISK_ONLY)


def fit_model(docs: DataFrame, labels: DataFrame) -> bytes:
    """The stored model, fitted on every labelled document; see the module's text.

    Of documents that share an id the one with the least hash of its text is taken, and a label that
    is repeated once, so that the labels bound the texts that are read.
    """
    context = docs.sparkSession.sparkContext
    chosen = settle(labels.where("toxic is not null and doc_id is not null").select("doc_id", "toxic").distinct(), "labels")
    met = maybe_in(docs.select("doc_id", "text"), "doc_id", key_filter(chosen, "doc_id")).where("_maybe").drop("_maybe")
    joined = met.join(small(chosen), "doc_id")
    joined = joined.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    joined = settle(joined, "labelled")
    parts = max(1, -(-chosen.count() // PART_ROWS))
    dealt = _dealt(joined, parts)
    groups = max(1, round(dealt.getNumPartitions() ** 0.5))

    def over(work: Callable[[Part], list[np.ndarray]]) -> list[np.ndarray]:
        """Sums of whole numbers by task, by group of tasks and in all, so that the driver receives them once."""

        def summed(at: int, rows: Iterator[Part]) -> Iterator[tuple[int, list[np.ndarray]]]:
            total = None
            for part in rows:
                total = work(part) if total is None else _added(total, work(part))
            if total is not None:
                yield at % groups, total

        some = dealt.mapPartitionsWithIndex(summed).reduceByKey(_added, groups).map(lambda told: (0, told[1]))
        found = some.reduceByKey(_added, 1).map(lambda told: zlib.compress(pickle.dumps(told[1]), 1)).first()
        context._jvm.System.gc()  # lets Spark free what the turn has shuffled
        return pickle.loads(zlib.decompress(found))

    sent = []

    def shared(value):
        for old in sent:
            old.unpersist()
        sent[:] = [context.broadcast(value)]  # a few megabytes by construction
        return lambda now=sent[0]: now.value

    try:
        return stored(_fitted(over, parts, shared) if not dealt.isEmpty() else fit([], []))
    finally:
        dealt.unpersist()


def _added(x: list[np.ndarray], y: list[np.ndarray]) -> list[np.ndarray]:
    return [a + b for a, b in zip(x, y)]


def score_documents(docs: DataFrame, model: bytes, columns: list[str]) -> DataFrame:
    """row (the carried ``columns``) and score of every document; no names clash."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few megabytes by construction
    source = docs.select("text", F.struct(*columns).alias("row"))
    schema = f"row {source.schema['row'].dataType.simpleString()}"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, words = loaded(shared.value), Words()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            parts = [score_texts(fitted, texts[a : a + 256], words) for a in range(0, len(texts), 256)]
            scores = np.concatenate(parts) if parts else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(scores, pa.float64())], ["row", "score"])

    return source.mapInArrow(work, f"{schema}, score double")
