"""Quality classifier: a generalised additive model with pairwise interactions.

Each text is described by `FEATURES`, computed with array operations over the
UTF-8 buffer of many texts. Cyclic boosting visits one feature after the other
and fits a shallow tree (at most three cuts) to the gradients of the logistic
loss; the trees of a feature add up to one lookup table over its bins. Then
the pairs of features whose tables explain most of what is left get tables
over two coarser bins, learned the same way. A score is the logistic function
of the sum of one table entry per feature and per pair.

Labels are learned from at most `MAX_LABELS` rows, the ones with the smallest
hashes of doc_id. All else covers all rows.

Results, also for odd input:

* a null text is scored as the empty text, which has a score like any other;
* labels that are null, or of null or unknown doc_ids, teach nothing; of
  repeated labels of a doc_id the mean counts, 0.5 or more being good;
* without labels of both kinds all scores are the share of good labels, or
  0.5 without any label;
* repeated rows get equal scores; very long texts are scored whole;
* an empty table gives no rows; columns named like an output are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from queuelens.llm.common import append_columns, in_small_batches
from queuelens.llm.textstats import buffers, hashes, per_text, spans

MAX_LABELS = 20_000
#: Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in is that it for as was with be by on are this at from or an have not they which you were "
    "le la les de des et est un une que qui dans pour pas sur au avec il en du "
    "der die das und ist von zu den mit sich auf ein eine nicht dem im für auch "
    "el los las que del se por con una su para es al lo como y"
).split()
FEATURES = (
    "log_bytes log_words word_length upper digits stops_marks symbols bangs bars new_lines high_bytes "
    "distinct_words top_word same_as_before repeated_lines stop_words marked_ends capital_starts line_length"
).split()


def features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text."""
    data, offsets = buffers(column)
    n = len(column)
    size = np.diff(offsets).astype(float)

    def of(chars: bytes) -> np.ndarray:
        table = np.zeros(256, bool)
        table[list(chars)] = True
        return table[data]

    white = of(b" \t\n\r\x0b\x0c")
    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    bars, bangs = data == ord("|"), data == ord("!")
    symbols = of(b"#$%&*+/<=>@[\\]^_`{|}~")
    start, end, text = spans(~white, offsets)
    words = np.bincount(text, minlength=n).astype(float)
    some, any_byte = np.maximum(words, 1), np.maximum(size, 1)
    folded = np.where(upper, data + 32, data).astype(np.uint8)
    word = hashes(folded, start, end)
    order = np.lexsort((word, text))
    w, t = word[order], text[order]
    new = np.append(True, (w[1:] != w[:-1]) | (t[1:] != t[:-1]))[: len(w)]
    heads = np.flatnonzero(new)
    runs = np.diff(np.append(heads, len(w)))
    top = np.zeros(n)
    np.maximum.at(top, t[heads], runs)
    again = np.append(False, (word[1:] == word[:-1]) & (text[1:] == text[:-1]))[: len(word)]
    stop_bytes = [s.encode() for s in STOP_WORDS]
    ends = np.cumsum([len(s) for s in stop_bytes])
    stop = hashes(np.frombuffer(b"".join(stop_bytes), np.uint8), ends - [len(s) for s in stop_bytes], ends)
    l_start, l_end, l_text = spans(data != 10, offsets)
    line = hashes(data, l_start, l_end)
    l_order = np.lexsort((line, l_text))
    l, lt = line[l_order], l_text[l_order]
    l_same = np.append(False, (l[1:] == l[:-1]) & (lt[1:] == lt[:-1]))[: len(l)]
    lines = np.bincount(l_text, minlength=n).astype(float)

    def words_that(flags: np.ndarray) -> np.ndarray:
        return np.bincount(text[flags], minlength=n) / some

    columns = [
        np.log1p(size),
        np.log1p(words),
        per_text(~white, offsets) / some,
        per_text(upper, offsets) / np.maximum(per_text(upper | lower, offsets), 1),
        per_text(of(b"0123456789"), offsets) / any_byte,
        per_text(of(b".,;:?"), offsets) / some,
        per_text(symbols, offsets) / any_byte,
        per_text(bangs, offsets) / some,
        per_text(bars, offsets) / some,
        per_text(data == 10, offsets) / some,
        per_text(data >= 128, offsets) / any_byte,
        np.bincount(t[heads], minlength=n) / some,
        top / some,
        words_that(again),
        np.bincount(lt[l_same], minlength=n) / np.maximum(lines, 1),
        words_that(np.isin(word, stop)),
        words_that(symbols[end - 1]),
        words_that(upper[start]),
        np.log1p(size / np.maximum(lines, 1)),
    ]
    return np.stack(columns, axis=1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> tuple[np.ndarray, float]:
    """Best-first piecewise constant step over ordered bins: (values, gain).

    g, h: sums of gradients and curvatures by bin.
    """
    cg, ch = np.append(0, np.cumsum(g)), np.append(0, np.cumsum(h))
    parts, gain = [(0, len(g))], 0.0

    def best(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, a
        k = np.arange(a + 1, b)
        left, right = (cg[k] - cg[a]) ** 2 / (ch[k] - ch[a] + ridge), (cg[b] - cg[k]) ** 2 / (ch[b] - ch[k] + ridge)
        won = left + right - (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
        return float(won.max()), int(k[won.argmax()])

    while len(parts) < leaves:
        won, cut, i = max((*best(*p), i) for i, p in enumerate(parts))
        if won <= 1e-9:
            break
        gain += won
        a, b = parts.pop(i)
        parts += [(a, cut), (cut, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out, gain


@dataclass
class Gam:
    """Cut points of features and lookup tables of features and of pairs."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for k, (cuts, table) in enumerate(zip(self.cuts, self.tables)):
            out += table[np.searchsorted(cuts, x[:, k], side="right")]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            out += table[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.raw(x))


def cut_points(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)


def fit(x: np.ndarray, y: np.ndarray, bins: int = 64, rounds: int = 150, rate: float = 0.15, pairs: int = 8, pair_bins: int = 12, pair_rounds: int = 60, ridge: float = 2.0) -> Gam:
    """Learn the tables from feature rows x and labels y (0 or 1)."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    cuts, coarse = ([cut_points(c, b) for c in x.T] for b in (bins, pair_bins))
    model = Gam(float(np.log(share / (1 - share))), cuts, [np.zeros(len(c) + 1) for c in cuts], coarse, [], [])
    if len(np.unique(y)) < 2:
        return model
    at = [np.searchsorted(c, v, side="right") for c, v in zip(cuts, x.T)]
    raw = np.full(len(y), model.base)
    for _ in range(rounds):
        for b, table in zip(at, model.tables):
            p = sigmoid(raw)
            step, _ = shallow_tree(np.bincount(b, y - p, len(table)), np.bincount(b, p * (1 - p), len(table)), 4, ridge)
            table += rate * step
            raw += rate * step[b]
    low = [np.searchsorted(c, v, side="right") for c, v in zip(coarse, x.T)]

    def cells(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[int, int]]:
        shape = len(coarse[i]) + 1, len(coarse[j]) + 1
        cell = low[i] * shape[1] + low[j]
        p = sigmoid(raw)
        n = shape[0] * shape[1]
        return cell, np.bincount(cell, y - p, n).reshape(shape), np.bincount(cell, p * (1 - p), n).reshape(shape), shape

    def crossed(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
        """A tree that cuts the first feature once and then each side by the second."""
        best = (np.zeros(g.shape), 0.0)
        for k in range(1, g.shape[0]):
            (lo, won), (hi, also) = (shallow_tree(g[s].sum(axis=0), h[s].sum(axis=0), 2, ridge) for s in (slice(k), slice(k, None)))
            if won + also > best[1]:
                best = (np.vstack([np.tile(lo, (k, 1)), np.tile(hi, (g.shape[0] - k, 1))]), won + also)
        return best

    ranked = sorted(((crossed(*cells(i, j)[1:3])[1], i, j) for i, j in combinations(range(x.shape[1]), 2)), reverse=True)
    model.pairs = [(i, j) for gain, i, j in ranked[:pairs] if gain > 0]
    model.pair_tables = [np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), table in zip(model.pairs, model.pair_tables):
            cell, g, h, _ = cells(i, j)
            step, _ = crossed(g, h)
            table += rate * step
            raw += rate * step.ravel()[cell]
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that labels must not be learned from; null doc_ids are among them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def learn(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> Gam:
    """Fit the model to the labelled documents outside the held-out fold."""
    known = labels.filter(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("labelled"), F.col("quality").cast("double").alias("quality"))
    known = known.groupBy("labelled").agg((F.avg("quality") >= 0.5).cast("int").alias("good"))
    known = known.orderBy(F.xxhash64("labelled"), "labelled").limit(max_labels)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("labelled")).select("doc_id", "good", "text")

    def run(batches):
        from queuelens.llm.common import slices

        for batch in batches:
            for part in slices(batch, "text"):
                x = features(part.column("text"))
                values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("good"), values], names=["doc_id", "good", "x"])

    found = in_small_batches(rows).mapInArrow(run, T.StructType([rows.schema["doc_id"], rows.schema["good"], T.StructField("x", T.ArrayType(T.DoubleType()))]))
    # Repeated doc_ids count once: the smallest feature row.
    got = found.groupBy("doc_id").agg(F.min(F.struct("x", "good")).alias("row")).orderBy("doc_id").collect()
    x = np.array([r.row.x for r in got], float).reshape(-1, len(FEATURES))
    return fit(x, np.array([r.row.good for r in got], float))


def score(docs: DataFrame, model: Gam, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """Append the score of each whole text. See the module's docstring."""

    def factory():
        return lambda part: [pa.array(model.score(features(part.column(text_col))))]

    return append_columns(docs, text_col, [T.StructField(out_col, T.DoubleType())], factory)
