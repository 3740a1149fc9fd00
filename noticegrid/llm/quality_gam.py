"""Quality classifier: a generalised additive model with pairwise interactions.

A text is measured by a few numbers, over all of it and at its worst window. The model is a lookup table per number,
and one per chosen pair of numbers, each grown by boosting shallow trees in turns (a small step on each number, round
after round, then on the pairs that lower the remaining loss most). A score is the logistic of a sum of table
entries, added for whole batches of texts at once.

The model is fitted on the driver on a bounded sample: at most `sample` labelled rows, those with the smallest hash of
their id. All texts are scored, whole, in one pass without a shuffle.

A null text is an empty text; both get the score of all-zero measures. Very long texts are measured
whole. Repeated rows get the same score each. Without usable labels every score is 0.5. An empty table gives no
rows; columns other than doc_id and text stay as they are where rows are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticegrid.llm.base import LOWER, SPACES, flat, hashed_share, hashed_words, length_slices

SAMPLE = 20_000
OVERSAMPLE = 2
BINS = 32
ROUNDS = 60
PAIR_ROUNDS = 20
PAIRS = 8
STEP = 0.2
LEAVES = 4
WINDOW_WORDS = 64
KEEP_AT = 0.3


def _class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


KINDS = {
    "upper": _class(bytes(range(65, 91))), "digit": _class(b"0123456789"), "symbol": _class(b"#*$%&|<>{}[]=^~\\/_"),
    "bang": _class(b"!?"), "stop": _class(b".,;:"), "wide": np.arange(256) >= 0xC0, "line": _class(b"\n"),
}
NAMES = ["words", "letters_per_word", "distinct", "distinct_near", "echo", "echo_worst", "per_line",
         *KINDS, *(f"{k}_worst" for k in ("upper", "digit", "symbol", "bang")), "stopless_worst", "capital_worst"]


def measures(raw: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """One row of numbers per text."""
    n = len(begin) - 1
    size = np.diff(begin)
    totals = {k: np.r_[0, np.cumsum(table[raw])] for k, table in KINDS.items()}
    totals["space"] = np.r_[0, np.cumsum(SPACES[raw])]
    hashes, doc, starts, stops = hashed_words(LOWER[raw], begin)
    words = np.bincount(doc, minlength=n)
    many = np.maximum(words, 1)
    echo = np.r_[False, (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])][:len(hashes)]
    order = np.lexsort((hashes, doc))
    first = np.r_[True, (hashes[order][1:] != hashes[order][:-1]) | (doc[order][1:] != doc[order][:-1])][:len(hashes)]
    distinct = np.bincount(doc[order], weights=first, minlength=n)
    # Windows of WINDOW_WORDS words inside a text; the last of a text may be shorter and counts by its share.
    begin_word = np.r_[0, np.cumsum(words)]
    place = np.arange(len(hashes)) - begin_word[doc]
    window = np.flatnonzero(place % WINDOW_WORDS == 0)
    stop = np.minimum(window + WINDOW_WORDS, begin_word[doc[window] + 1])
    of, held = doc[window], np.minimum(stop - window + 8.0, WINDOW_WORDS)
    worst = lambda x: _most(x, of, n)
    a, b = starts[window], stops[stop - 1] if len(window) else stops[:0]
    echoes = np.r_[0, np.cumsum(echo)]
    near = np.lexsort((hashes, np.repeat(np.arange(len(window)), stop - window)))
    in_window = np.repeat(np.arange(len(window)), stop - window)
    new = np.r_[True, (hashes[near][1:] != hashes[near][:-1]) | (in_window[near][1:] != in_window[near][:-1])][:len(near)]
    distinct_near = np.bincount(in_window[near], weights=new, minlength=len(window)) / np.maximum(stop - window, 1)
    chars = np.maximum(b - a, 1)
    capital = np.r_[0, np.cumsum(KINDS["upper"][raw[starts]])]
    columns = {
        "words": np.log1p(words), "letters_per_word": (size - np.diff(totals["space"][begin])) / many,
        "distinct": distinct / np.sqrt(many), "distinct_near": -worst(-distinct_near), "echo": np.bincount(doc, weights=echo, minlength=n) / many,
        "echo_worst": worst((echoes[stop] - echoes[window]) / held), "per_line": np.log1p(words / (1 + np.diff(totals["line"][begin]))),
        "stopless_worst": worst((stop - window - (totals["stop"][b] - totals["stop"][a])) / held),
        "capital_worst": worst((capital[stop] - capital[window]) / held),
    }
    for k in KINDS:
        columns[k] = np.diff(totals[k][begin]) / np.maximum(size, 1)
        columns[f"{k}_worst"] = worst((totals[k][b] - totals[k][a]) / np.maximum(chars, 64))
    return np.stack([columns[k] for k in NAMES], axis=1)


def _most(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, -np.inf)
    np.maximum.at(out, of, values)
    return np.where(np.isfinite(out), out, 0)


def measured(docs: DataFrame, *carried: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, begin = flat(batch["text"])
            rows = [measures(raw[begin[i]:begin[j]], begin[i:j + 1] - begin[i]) for i, j in length_slices(begin)]
            if rows:
                numbers = np.concatenate(rows).astype(np.float64)
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in carried), pa.array(list(numbers))], [*carried, "x"])
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)
    return docs.select(*carried, "text").mapInArrow(run, f"{schema}, x array<double>")


class Model:
    """Cut points per measure, a table per measure, and a table per pair."""

    def __init__(self, edges: list[np.ndarray], bias: float):
        self.edges, self.bias = edges, bias
        self.tables = [np.zeros(len(e) + 1) for e in edges]
        self.pairs: dict[tuple[int, int], np.ndarray] = {}

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)]

    def logit(self, bins: list[np.ndarray]) -> np.ndarray:
        total = np.full(len(bins[0]), self.bias)
        for table, b in zip(self.tables, bins, strict=True):
            total += table[b]
        for (f, g), table in self.pairs.items():
            total += table[bins[f], bins[g]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(self.bins(x)), -30, 30)))


def shallow_tree(gradient: np.ndarray, weight: np.ndarray, leaves: int) -> np.ndarray:
    """The step of each bin: a tree of a few leaves over ordered bins, split where the loss falls most."""
    g, h = np.r_[0, np.cumsum(gradient)], np.r_[0, np.cumsum(weight)]
    gain = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1)
    parts = [(0, len(gradient))]
    for _ in range(leaves - 1):
        best = (1e-9, None, None)
        for k, (a, b) in enumerate(parts):
            at = np.arange(a + 1, b)
            if len(at):
                better = gain(a, at) + gain(at, b) - gain(a, b)
                i = int(np.argmax(better))
                best = max(best, (float(better[i]), k, int(at[i])), key=lambda x: x[0])
        if best[1] is None:
            break
        a, b = parts[best[1]]
        parts[best[1]:best[1] + 1] = [(a, best[2]), (best[2], b)]
    out = np.zeros(len(gradient))
    for a, b in parts:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1)
    return out


def pair_tree(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """A tree of one cut on either measure of a pair (four leaves), and how much it lowers the loss."""
    pad = lambda m: np.pad(m.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    g, h = pad(gradient), pad(weight)
    gains = 0.0
    for rows in (slice(0, -1), None):
        for cols in (slice(0, -1), None):
            part = lambda m: (m[1:-1, 1:-1] if rows and cols else m[1:-1, -1:] - m[1:-1, 1:-1] if rows  # noqa: B023, E731
                              else m[-1:, 1:-1] - m[1:-1, 1:-1] if cols else m[-1, -1] - m[1:-1, -1:] - m[-1:, 1:-1] + m[1:-1, 1:-1])  # noqa: B023
            gains = gains + part(g) ** 2 / (part(h) + 1)
    if not np.size(gains):
        return 0.0, np.zeros_like(gradient)
    i, j = np.unravel_index(np.argmax(gains), gains.shape)
    out = np.zeros_like(gradient)
    for a in (slice(0, i + 1), slice(i + 1, None)):
        for b in (slice(0, j + 1), slice(j + 1, None)):
            out[a, b] = gradient[a, b].sum() / (weight[a, b].sum() + 1)
    return float(gains[i, j] - g[-1, -1] ** 2 / (h[-1, -1] + 1)), out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(x.shape[1])]
    if len(np.unique(y)) < 2:
        return Model(edges, 0.0 if not len(y) else 4.0 * (2 * float(y[0]) - 1))
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = Model(edges, float(np.log(rate / (1 - rate))))
    bins = model.bins(x)
    logit = np.full(len(y), model.bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f, b in enumerate(bins):
            r, w = slopes()
            size = len(model.tables[f])
            step = STEP * shallow_tree(np.bincount(b, r, size), np.bincount(b, w, size), LEAVES)
            model.tables[f] += step
            logit += step[b]
    r, w = slopes()
    grid = lambda f, g, v: np.bincount(bins[f] * (len(edges[g]) + 1) + bins[g], v, (len(edges[f]) + 1) * (len(edges[g]) + 1)) \
        .reshape(len(edges[f]) + 1, -1)
    ranked = sorted(((pair_tree(grid(f, g, r), grid(f, g, w))[0], f, g) for f in range(len(bins)) for g in range(f)), reverse=True)
    for _, f, g in ranked[:PAIRS]:
        model.pairs[f, g] = np.zeros((len(edges[f]) + 1, len(edges[g]) + 1))
    for _ in range(PAIR_ROUNDS):
        for f, g in model.pairs:
            r, w = slopes()
            step = STEP * pair_tree(grid(f, g, r), grid(f, g, w))[1]
            model.pairs[f, g] += step
            logit += step[bins[f], bins[g]]
    return model


def learn(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = SAMPLE) -> Model:
    """A model of `quality` from at most `sample` of the labelled rows for which `usable` (over doc_id) holds.

    Of many rows a share chosen by a hash is ordered, about OVERSAMPLE times what is wanted.
    """
    marked = labels.filter(usable & F.col("quality").isin(0, 1))
    share = hashed_share(F.col("doc_id"), OVERSAMPLE * sample, marked.count())
    chosen = marked.filter(share).groupBy("doc_id").agg(F.max("quality").alias("quality")) \
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most `sample` ids, by the limit above.
    rows = measured(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "quality").toPandas()
    rows = rows.iloc[np.lexsort(np.stack(rows["x"]).T)] if len(rows) else rows
    x = np.stack(rows["x"]) if len(rows) else np.zeros((0, len(NAMES)))
    return fit(x, rows["quality"].to_numpy(np.float64))


def scored(docs: DataFrame, model: Model, score: str = "score") -> DataFrame:
    """All columns of the documents, and their score in a column of that name."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, begin = flat(batch["text"])
            scores = [held.value.score(measures(raw[begin[i]:begin[j]], begin[i:j + 1] - begin[i])) for i, j in length_slices(begin)]
            if scores:
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), pa.array(np.concatenate(scores))], [*columns, score])
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.mapInArrow(run, f"{schema}, `{score}` double")
