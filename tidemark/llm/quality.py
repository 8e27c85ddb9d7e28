"""Quality scores by Bradley-Terry pairwise ranking.

Each text has a score w.x, and of two texts the first is the better one with probability 1 / (1 + exp(w.(x2 - x1))). The
weights are learned by logistic loss on differences of features over pairs of a text marked good and one marked bad, and the
cut lies at the quantile of the training scores that leaves as many below as are marked bad. A last step maps scores
to 0 to 1, monotonically, with the cut at a given value. Features are shares and shapes of the whole text's bytes, words and
lines; the label, language, source and id are never among them.

Every labelled row outside the held-out fold teaches, in all of its pairs. Features are worked out once and written in the shared folder; the
labelled ones are joined with their labels and read again for each step, without a row for a pair: the loss of all pairs depends on the
scores of either kind only, so each task counts its scores on a grid, whose convolution says what each row's pairs add.
Nulls: a null text is empty and scored as such; rows of `labels` with a null id or label, and labels without a text,
teach nothing; a null doc_id is not held out. A text that is labelled several times counts each time. Without two kinds of
labels every score is the cut. Equal texts have equal scores; a score at the cut counts as good. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Texts, id_and_text, run_hashes, word_hashes, word_spans, written

#: Every so many-th document by its checksum is held out.
FOLDS = 5
#: Where the cut lies among the scores.
CUT = 0.3
#: Newton steps at most, and the change of a weight that ends them.
STEPS, SETTLED, PENALTY = 40, 1e-7, 1e-3
#: Distance of the grid's points for scores (cubic interpolation errs by less than 1e-7), and of the coarse one for second derivatives.
GRID, COARSE, COARSE_HALF = 1 / 16, 1 / 4, 128
PIECE_BYTES = 1 << 20

_GROUPS = [[ord(c)] for c in "*#$%&!|.,;:?'\"-_/()<>=+@[]{}~^\\`"] + [list(range(ord("A"), ord("Z") + 1)), list(range(ord("a"), ord("z") + 1)), list(range(ord("0"), ord("9") + 1)), [0x20], [0x0A], [0x09, 0x0B, 0x0C, 0x0D], list(range(0x80, 0xC0)), list(range(0xC0, 0x100)), [*range(0x00, 0x09), *range(0x0E, 0x20), 0x7F]]
_GROUP_OF = np.zeros(256, np.int64)
for _k, _bytes in enumerate(_GROUPS):
    _GROUP_OF[_bytes] = _k
N_FEATURES = 2 * len(_GROUPS) + 16


def features(data: np.ndarray) -> np.ndarray:
    """The features of one text."""
    out = np.zeros(N_FEATURES)
    n = len(data)
    out[-1] = np.log1p(n)
    if not n:
        return out
    count = np.bincount(data, minlength=256)
    group = np.bincount(_GROUP_OF, count, len(_GROUPS))
    out[: len(_GROUPS)] = group / n
    out[len(_GROUPS) : 2 * len(_GROUPS)] = np.log1p(group) / np.log1p(n)
    begin, end = word_spans(data)
    m = len(begin)
    tail = 2 * len(_GROUPS)
    if m:
        size = end - begin
        hashes = word_hashes(data, begin, end)
        first, last = data[begin], data[end - 1]
        letter = lambda x: (x >= 0x80) | (x >= 0x41) & (x <= 0x5A) | (x >= 0x61) & (x <= 0x7A)
        out[tail : tail + 8] = [size.mean() / 10, size.std() / 10, min(1.0, size.max() / 100), len(np.unique(hashes)) / m, (~letter(last)).mean(), (~letter(first)).mean(), ((first >= 0x41) & (first <= 0x5A)).mean(), np.log1p(m) / 10]
        _, times = np.unique(hashes, return_counts=True)
        out[tail + 8] = times.max() / m
        if m >= 3:
            runs = run_hashes(hashes, 3)
            out[tail + 9] = len(np.unique(runs)) / len(runs)
    line = np.flatnonzero(data == 0x0A)
    begin = np.concatenate([[0], line + 1])
    end = np.concatenate([line, [n]])
    full = end > begin
    if full.any():
        begin, end = begin[full], end[full]
        hashes = word_hashes(data, begin, end)
        out[tail + 10 : tail + 14] = [np.log1p((end - begin).mean()) / 10, len(np.unique(hashes)) / len(hashes), np.isin(data[end - 1], [0x2E, 0x21, 0x3F]).mean(), ((data[begin] >= 0x41) & (data[begin] <= 0x5A)).mean()]
        out[tail + 14] = np.log1p(len(begin)) / 10
    return out


class Ranking:
    """Weights for standardised features, the cut of the raw scores, and their spread."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, cut: float, spread: float) -> None:
        self.mean, self.scale, self.weights, self.cut, self.spread = mean, scale, weights, cut, spread

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (np.clip((x - self.mean) / self.scale, -8, 8) * self.weights).sum(axis=1)  # row by row, so equal texts have equal scores

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, and CUT where the raw score is the cut."""
        z = np.clip((self.raw(x) - self.cut) / self.spread, -30, 30) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-z))


def pair_loss(weights: np.ndarray, differences: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean logistic loss of preferring the first of each pair, with a penalty, and its gradient."""
    margin = differences @ weights
    loss = np.logaddexp(0, -margin).mean() + PENALTY * weights @ weights / 2
    return float(loss), -(differences * (1 / (1 + np.exp(np.clip(margin, -50, 50))))[:, None]).mean(axis=0) + PENALTY * weights


def quantile_cut(scores: np.ndarray, share: float) -> float:
    """The score below which the given share lies, halfway between the two neighbours there."""
    ordered = np.sort(scores)
    k = int(round(share * len(ordered)))
    if k <= 0:
        return float(ordered[0] - 1e-9)
    if k >= len(ordered):
        return float(ordered[-1] + 1e-9)
    return float((ordered[k - 1] + ordered[k]) / 2)


def _places(at: np.ndarray, points: int):
    """Grid points around each place (given in steps from the first point) and their weights in cubic interpolation."""
    i = np.clip(at.astype(np.int64), 1, points - 3)
    f = at - i
    yield i - 1, -f * (f - 1) * (f - 2) / 6
    yield i, (f + 1) * (f - 1) * (f - 2) / 2
    yield i + 1, -(f + 1) * f * (f - 2) / 2
    yield i + 2, (f + 1) * f * (f - 1) / 6


def _met(counts: np.ndarray, kernel) -> np.ndarray:
    """For each point of the grid, the sum of kernel(other point - point) over the counts."""
    m = len(counts)
    k = kernel(GRID * np.arange(m - 1, -m, -1))
    size = 1 << (3 * m).bit_length()
    return np.fft.irfft(np.fft.rfft(counts, size) * np.fft.rfft(k, size), size)[m - 1 : 2 * m - 1]


def _logistic(d: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(d, -500, 500)))


def _ordinals(v: np.ndarray) -> np.ndarray:
    """Numbers as integers of the same order."""
    b = (v + 0.0).view(np.uint64)
    return np.where(b >> np.uint64(63) == 1, ~b, b | np.uint64(1 << 63))


def _value(ordinal: int) -> float:
    return float(np.array([ordinal ^ (1 << 63) if ordinal >> 63 else ordinal ^ ((1 << 64) - 1)], np.uint64).view(np.float64)[0])


def _at_rank(over, raw, rank: int) -> float:
    """The raw score at a rank from 0, exactly: 16 bits of its ordinal at a time."""
    found = 0
    for shift in (48, 32, 16, 0):

        def count(x, _, shift=shift, found=found):
            o = _ordinals(raw(x))
            own = o if shift == 48 else o[o >> np.uint64(shift + 16) == np.uint64(found)]
            return (np.bincount((own >> np.uint64(shift) & np.uint64(0xFFFF)).astype(np.int64), minlength=1 << 16),)

        upto = np.cumsum(over(count)[0])
        k = int(np.searchsorted(upto, rank, "right"))
        rank -= int(upto[k - 1]) if k else 0
        found = found << 16 | k
    return _value(found)


def learn(over) -> Ranking:
    """Learn from all pairs of a good and a bad text; over(f): the sums of what f gives for all parts (features, labels) of the texts."""
    n, total = over(lambda x, y: (np.bincount(y, minlength=2), x.sum(axis=0)))
    bad, good = n.tolist()
    k = len(total)
    if not good or not bad:
        return Ranking(np.zeros(k), np.ones(k), np.zeros(k), 0.0, 1.0)
    mean = total / (good + bad)
    scale = np.sqrt(over(lambda x, y: (((x - mean) ** 2).sum(axis=0),))[0] / (good + bad))
    scale = np.where(scale > 1e-9, scale, 1.0)
    standard = lambda x: np.clip((x - mean) / scale, -8, 8)

    def counted(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
        """Of bad and of good texts, how many scores lie at each point; the first point; the loss."""
        points = 2 * int(8 * np.abs(w).sum() / GRID) + 9
        low = -GRID * (points // 2)

        def count(x, y):
            at = ((standard(x) * w).sum(axis=1) - low) / GRID
            return tuple(sum(np.bincount(i, v, points) for i, v in _places(at[y == c], points)) for c in (0, 1))

        zero, one = over(count)
        return zero, one, low, float(one @ _met(zero, lambda d: np.logaddexp(0, d)) / good / bad + PENALTY * w @ w / 2)

    def turned(w: np.ndarray, zero: np.ndarray, one: np.ndarray, low: float) -> tuple[np.ndarray, np.ndarray]:
        """Gradient, and second derivatives (those between two texts from the coarse grid, which only changes the number of steps)."""
        slope = lambda d: _logistic(d) * _logistic(-d)
        first = _met(one, lambda d: _logistic(-d)) / good, _met(zero, _logistic) / bad
        second = _met(one, slope) / good, _met(zero, slope) / bad
        points = len(zero)
        weight = one * second[1]
        middle = float(weight @ (low + GRID * np.arange(points)) / max(1e-300, weight.sum()))

        def derive(x, y):
            z = standard(x)
            s = (z * w).sum(axis=1)
            g, h, sums = np.zeros(k), np.zeros((k, k)), []
            for c, share in ((0, 1 / bad), (1, -1 / good)):
                own, at = z[y == c], (s[y == c] - low) / GRID
                g += share * (own * sum(v * first[c][i] for i, v in _places(at, points))[:, None]).sum(axis=0)
                h += abs(share) * (own * sum(v * second[c][i] for i, v in _places(at, points))[:, None]).T @ own
                at = (s[y == c] - middle) / COARSE + COARSE_HALF
                near = (at >= 0) & (at < 2 * COARSE_HALF)
                i, f, many = at[near].astype(np.int64), (at[near] % 1)[:, None], np.zeros((2 * COARSE_HALF + 1, k))
                np.add.at(many, i, own[near] * (1 - f))
                np.add.at(many, i + 1, own[near] * f)
                sums.append(many)
            return g, h, *sums

        g, h, zeros, ones = over(derive)
        at = COARSE * np.arange(2 * COARSE_HALF + 1)
        both = ones.T @ slope(at[:, None] - at[None, :]) @ zeros / good / bad
        return g + PENALTY * w, h - both - both.T + PENALTY * np.eye(k)

    weights = np.zeros(k)
    zero, one, low, loss = counted(weights)
    for _ in range(STEPS):
        g, h = turned(weights, zero, one, low)
        size, axes = np.linalg.eigh((h + h.T) / 2)
        step = axes @ (axes.T @ g / np.maximum(size, PENALTY))
        before = loss
        while True:
            zero, one, low, loss = counted(weights - step)
            if loss <= before + 1e-9 or np.abs(step).max() < SETTLED:
                break
            step = step / 2
        weights = weights - step
        if np.abs(step).max() < SETTLED:
            break
    raw = lambda x: (standard(x) * weights).sum(axis=1)
    middle = over(lambda x, y: (raw(x).sum(),))[0] / (good + bad)
    spread = np.sqrt(over(lambda x, y: (((raw(x) - middle) ** 2).sum(),))[0] / (good + bad))
    # as many below as are bad: halfway between the scores at the ranks there
    cut = (_at_rank(over, raw, bad - 1) + _at_rank(over, raw, bad)) / 2
    return Ranking(mean, scale, weights, cut, max(1e-6, float(spread) / 3))


def fit_ranking(x: np.ndarray, label: np.ndarray) -> Ranking:
    """Learn from texts' features and labels 0 or 1."""
    label = np.asarray(label, np.int64)
    return learn(lambda f: f(x, label))


def remainder(doc_id):
    """crc32 of the id as text, modulo FOLDS."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def featured(docs: DataFrame) -> DataFrame:
    """doc_id, x (the features' bytes) of every row, written once."""

    def run(batches):
        for b in batches:
            texts = Texts(b.column(1))
            yield pa.record_batch({"doc_id": b.column(0), "x": pa.array([features(texts.row(i)).tobytes() for i in range(b.num_rows)], pa.binary())})

    return written(id_and_text(docs).mapInArrow(run, "doc_id long, x binary"), "features")


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist())).reshape(-1, N_FEATURES)


def train(made: DataFrame, labels: DataFrame) -> Ranking:
    """Learn from every labelled row outside the held-out fold; made: what `featured` gives."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id")) != 0))
    rows = written(made.join(known, "doc_id").sortWithinPartitions("doc_id", "label", "x").select("label", "x"), "labelled")

    def over(f):
        def run(batches):
            total = None
            for b in batches:
                part = f(_matrix(b.column(1)), b.column(0).to_numpy().astype(np.int64))
                total = part if total is None else tuple(p + q for p, q in zip(total, part, strict=True))
            if total is not None:
                yield pa.record_batch({"part": pa.array([pickle.dumps(total)], pa.binary())})

        total = f(np.zeros((0, N_FEATURES)), np.zeros(0, np.int64))
        for r in rows.mapInArrow(run, "part binary").collect():
            total = tuple(p + q for p, q in zip(total, pickle.loads(r.part), strict=True))
        return total

    return learn(over)


def scored(made: DataFrame, ranking: Ranking, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; made: what `featured` gives."""

    def run(batches):
        for b in batches:
            yield pa.record_batch({"doc_id": b.column(0), "score": pa.array(ranking.score(_matrix(b.column(1))))})

    held = F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False))
    out = made.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train and score all documents."""
    made = featured(docs)
    return scored(made, train(made, labels))


def best_share(scores: DataFrame, share: float) -> DataFrame:
    """The rows whose score reaches the quantile that leaves `share` of all rows above it (an approximate quantile, within 0.1 %)."""
    cut = scores.select(F.percentile_approx("score", 1.0 - share, 1000).alias("q")).first()["q"]
    return scores.where(F.col("score") >= F.lit(cut)) if cut is not None else scores
