"""Document quality by pairwise ranking (Bradley-Terry) on features of the text."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxrisk.llm.graphs import narrow
from voxrisk.session import scratch_tables, settle

THRESHOLD = 0.7
#: Strengths are noted at places so far apart, further if that were more than MOST_PLACES. Sums over pairs read between four places, with an
#: error of a chance below 10^-6.
SPACING, MOST_PLACES = 1 / 16, 1 << 13
BINS = 1024

#: Characters counted one by one; the others by class.
SYMBOLS = "&%$#*|!<>{}[]()/\\=+_@~^;:.,?-'\""
FEATURES = (
    *[f"char {c}" for c in SYMBOLS], "upper", "digit", "space", "line end", "other letter", "control", "words", "distinct words",
    "top word", "equal neighbours", "word length", "long words", "odd words", "upper words", "distinct lines", "line length", "entropy",
    "single letters", "bigrams seen again",
)
SCORE_TABLE = 0x250  # code points above are one class


def _classes() -> np.ndarray:
    table = np.full(SCORE_TABLE + 1, len(SYMBOLS) + 4, np.int64)
    for c in range(SCORE_TABLE):
        ch = chr(c)
        if ch in SYMBOLS:
            table[c] = SYMBOLS.index(ch)
        elif ch.isupper():
            table[c] = len(SYMBOLS)
        elif ch.isdigit():
            table[c] = len(SYMBOLS) + 1
        elif ch == "\n":
            table[c] = len(SYMBOLS) + 3
        elif ch.isspace():
            table[c] = len(SYMBOLS) + 2
        elif not ch.isalpha():
            table[c] = len(SYMBOLS) + 5
    return table


CLASSES = _classes()


def features(text: str | None) -> list[float]:
    """Shares and averages of one text, none of which grows with its length but "words" (logarithmic)."""
    text = text or ""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = max(1, len(codes))
    counts = np.bincount(CLASSES[np.minimum(codes, SCORE_TABLE)], minlength=len(SYMBOLS) + 6)
    words = text.split()
    seen = Counter(words)
    lines = [x for x in text.split("\n") if x]
    m, rare = max(1, len(words)), max(1, len(lines))
    pairs = Counter(zip(words, words[1:]))
    letters = np.bincount(np.minimum(codes, SCORE_TABLE), minlength=1) / n
    letters = letters[letters > 0]
    by_word = [
        math.log1p(len(words)), len(seen) / math.sqrt(m) / 10, max(seen.values(), default=0) / m, sum(a == b for a, b in zip(words, words[1:])) / m,
        sum(map(len, words)) / m / 10, sum(c for w, c in seen.items() if len(w) > 20) / m, sum(c for w, c in seen.items() if not w.isalpha()) / m,
        sum(c for w, c in seen.items() if w.isupper() and len(w) > 1) / m, len(set(lines)) / rare, math.log1p(n / rare),
        float(-(letters * np.log(letters)).sum()), sum(c for w, c in seen.items() if len(w) == 1) / m, sum(c - 1 for c in pairs.values()) / m,
    ]
    # the root sets small shares apart: a few stray symbols tell as much as many
    return [math.sqrt(c / n) for c in counts.tolist()] + by_word


@dataclass
class Ranking:
    """Weights over standardised features and the cut below which label 0 lies."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def standard(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((rows - self.mean) / self.scale, -8, 8)

    def strength(self, rows: np.ndarray) -> np.ndarray:
        return self.standard(rows) @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Monotone in the strength; the cut becomes THRESHOLD."""
        at = self.strength(rows) - self.cut + math.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(at, -60, 60)))


Part = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _values(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
    return x, batch.column("y").to_numpy(zero_copy_only=False)


def _summed(labelled: DataFrame, part: Part, count: int, width: int) -> np.ndarray:
    """``count`` rows of ``width`` sums over all rows of ``labelled``. ``part`` makes them of a batch (features, labels), tasks add up their
    batches and Spark the tasks."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((count, width))
        for batch in batches:
            total += part(*_values(batch))
        filled = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_pydict({"i": pa.array(filled, pa.int32()), "v": pa.array(list(total[filled]), pa.list_(pa.float64()))})

    sums = labelled.mapInArrow(read, "i int, v array<double>").groupBy("i").agg(F.array(*[F.sum(F.get("v", k)) for k in range(width)]).alias("v"))
    out = np.zeros((count, width))
    for r in sums.collect():
        out[r.i] = r.v
    return out


@dataclass
class Places:
    """Equidistant places that cover all strengths of some weights."""

    spacing: float
    half: int

    @classmethod
    def covering(cls, weights: np.ndarray) -> Places:
        reach = 8 * float(np.abs(weights).sum())  # standardised features lie between -8 and 8
        spacing = max(SPACING, 2 * reach / MOST_PLACES)
        return cls(spacing, math.ceil(reach / spacing) + 2)

    @property
    def count(self) -> int:
        return 2 * self.half + 1

    def at(self, numbers: np.ndarray) -> np.ndarray:
        return (numbers - self.half) * self.spacing

    def around(self, strengths: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """The numbers of the four places next to each strength, and their weights in a cubic between them."""
        u = strengths / self.spacing
        k = np.floor(u)
        f, first = u - k, k.astype(np.int64) + self.half - 1
        weights = (-f * (f - 1) * (f - 2) / 6, (f + 1) * (f - 1) * (f - 2) / 2, -(f + 1) * f * (f - 2) / 2, (f + 1) * f * (f - 1) / 6)
        return [(first + i, w) for i, w in enumerate(weights)]


class PairSums:
    """Loss, slope and curvature of the Bradley-Terry fit over all pairs of a label-1 and a label-0 row, at some weights.

    The chance of a pair depends on the difference of two strengths only. So rows are summed by place and label, and the pairs are those of
    the places, whose number does not grow with the rows."""

    def __init__(self, labelled: DataFrame, start: Ranking, weights: np.ndarray, ridge: float) -> None:
        self.labelled, self.ranking, self.ridge = labelled, Ranking(start.mean, start.scale, weights, 0.0), ridge
        self.places = places = Places.covering(weights)
        ranking, count, width = self.ranking, places.count, len(FEATURES) + 1

        def by_place(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            z = ranking.standard(x)
            rows, out = np.column_stack([np.ones(len(z)), z]), np.zeros(2 * count * width)
            for number, weight in places.around(z @ ranking.weights):
                to = ((number + y * count)[:, None] * width + np.arange(width)).ravel()
                out += np.bincount(to, (rows * weight[:, None]).ravel(), len(out))
            return out.reshape(2 * count, width)

        sums = _summed(labelled, by_place, 2 * count, width).reshape(2, count, width)
        self.bad, self.good = (np.flatnonzero(side.any(axis=1)) for side in sums)
        self.n_bad, self.sum_bad = sums[0][self.bad, 0], sums[0][self.bad, 1:]
        self.n_good, self.sum_good = sums[1][self.good, 0], sums[1][self.good, 1:]
        self.pairs = self.n_good.sum() * self.n_bad.sum()
        self.loss, self.slope = 0.0, -ridge * weights
        self.bend_good, self.bend_bad = np.zeros(len(self.good)), np.zeros(len(self.bad))
        self.mixed = np.zeros((len(FEATURES), len(FEATURES)))
        for some in np.array_split(np.arange(len(self.good)), max(1, len(self.good) // 256)):
            ahead = places.at(self.good[some])[:, None] - places.at(self.bad)
            wrong = 1 / (1 + np.exp(np.clip(ahead, -700, 700)))  # chance that the pair is ordered wrongly
            self.loss += self.n_good[some] @ np.logaddexp(0, -ahead) @ self.n_bad / self.pairs
            self.slope += (self.sum_good[some].T @ (wrong @ self.n_bad) - self.sum_bad.T @ (wrong.T @ self.n_good[some])) / self.pairs
            bend = wrong * (1 - wrong)
            self.bend_good[some] = bend @ self.n_bad / self.pairs
            self.bend_bad += bend.T @ self.n_good[some] / self.pairs
            self.mixed += self.sum_good[some].T @ bend @ self.sum_bad / self.pairs
        self.loss += ridge / 2 * float(weights @ weights)

    def curvature(self) -> np.ndarray:
        places, ranking, count = self.places, self.ranking, self.places.count
        bend = np.zeros(2 * count)
        bend[self.bad], bend[count + self.good] = self.bend_bad, self.bend_good

        def own(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            z = ranking.standard(x)
            here = sum(bend[number + y * count] * weight for number, weight in places.around(z @ ranking.weights))
            return (z * here[:, None]).T @ z

        return _summed(self.labelled, own, len(FEATURES), len(FEATURES)) - self.mixed - self.mixed.T + self.ridge * np.eye(len(FEATURES))


def share_cut(strengths: DataFrame, share_bad: float) -> float:
    """The ``share_bad`` quantile of the strengths (y, s), each label weighted by its share: midway between the last row below it and the
    first above, of which there is one each at least. Rows are counted by range, and the range with the quantile is divided again until it holds one value."""
    sums = [F.count(F.when(F.col("y") == y, 1)).alias(f"n{y}") for y in (0, 1)]
    ends = [F.min("s").alias("low"), F.max("s").alias("high")]
    whole = strengths.agg(*sums, *ends).first()
    weight = share_bad / whole.n0, (1 - share_bad) / whole.n1
    most = min(max(share_bad, *weight) * (1 + 1e-9), 1 - min(weight) / 2)
    low, high, n0, n1, last = whole.low, whole.high, 0, 0, whole.low
    while low < high:
        bin_ = F.least(F.floor((F.col("s") - low) / (high - low) * BINS), F.lit(BINS - 1))
        counted = strengths.where(F.col("s").between(low, high)).groupBy(bin_.alias("bin")).agg(*sums, *ends)
        for r in sorted(counted.collect(), key=lambda r: r.bin):
            low, high = r.low, r.high
            if (n0 + r.n0) * weight[0] + (n1 + r.n1) * weight[1] > most:
                here = r
                break
            n0, n1, last = n0 + r.n0, n1 + r.n1, r.high
        else:
            return last
        if here.low == here.high:
            first = weight[1] if here.n1 else weight[0]  # equal strengths count label 1 first
            if n0 * weight[0] + n1 * weight[1] + first <= most:
                last = here.low
    return (last + high) / 2


def fit_ranking(labelled: DataFrame, share_bad: float, ridge: float = 1e-3, rounds: int = 25) -> Ranking:
    """Bradley-Terry: P(a before b) = sigmoid(w . (a - b)) over all preference pairs of a label-1 and a label-0
    row of ``labelled`` (y, x), fitted by Newton steps on the ridge-penalised logistic loss; a step that raises the loss is halved. The cut is
    the ``share_bad`` quantile of the strengths, each label weighted by its share. Without rows of both labels every text gets THRESHOLD.

    Every step sums over all rows on Spark; the driver sees sums by place and feature only."""
    width = len(FEATURES)
    labels = [F.count(F.when(F.col("y") == y, 1)).alias(f"n{y}") for y in (0, 1)]
    moments = [f(F.get("x", i)) for f in (F.avg, F.stddev_pop) for i in range(width)]
    n0, n1, *found = labelled.agg(*labels, *moments).first()
    if not n0 or not n1:
        return Ranking(np.zeros(width), np.ones(width), np.zeros(width), 0.0)
    mean, scale = np.array(found[:width]), np.array(found[width:])
    scale[scale < 1e-9] = 1.0
    start = Ranking(mean, scale, np.zeros(width), 0.0)
    now = PairSums(labelled, start, start.weights, ridge)
    for _ in range(rounds):
        step = np.linalg.solve(now.curvature(), now.slope)
        then = PairSums(labelled, start, now.ranking.weights + step, ridge)
        while then.loss > now.loss + 1e-7 and np.abs(step).max() >= 1e-6:
            step = step / 2
            then = PairSums(labelled, start, now.ranking.weights + step, ridge)
        now = then
        if np.abs(step).max() < 1e-6:
            break
    fitted = now.ranking

    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _values(batch)
            yield pa.RecordBatch.from_pydict({"y": pa.array(y, pa.int32()), "s": pa.array(fitted.strength(x), pa.float64())})

    return Ranking(mean, scale, fitted.weights, share_cut(settle(labelled.mapInArrow(strengths, "y int, s double"), "quality-strengths"), share_bad))


def held_out(doc_id: Column) -> Column:
    """Rows that no fit may read: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[DataFrame, float]:
    """(y, x) of all rows of ``docs`` that have a label and are not held out, and the share of label 0 among the labels. Features are made
    where the texts are; only they are moved."""

    @F.pandas_udf("array<double>")
    def text_features(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts])

    own = docs.schema[id_col].dataType
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).try_cast(own).alias("id")).agg(F.max(label_col).cast("int").alias("y"))  # one label a document, 1 where they disagree
    known = settle(known, "quality-labels")
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull())
    read = narrow(texts, "id", known, "id").select("id", text_features("text").alias("x"))
    return settle(read.join(known, "id").select("y", "x"), "quality-rows"), counts.get(0, 0) / max(1, sum(counts.values()))


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> DataFrame:
    """All rows and columns of ``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if score >= THRESHOLD).

    The ranking is fitted on all labelled rows outside the held-out part; scores depend on the text alone. Null and empty texts are scored by their (zero) features;
    ids without a label, null labels and labels other than 0 and 1 are not learnt from; repeated rows are
    each scored. Columns named score or predicted are replaced. The fit runs when this is called."""
    with scratch_tables(docs.sparkSession):
        ranking = fit_ranking(*labelled_rows(docs, labels, id_col, text_col, label_col))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        rows = np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES))
        return pd.Series(ranking.score(rows))

    return docs.drop("score", "predicted").withColumn("score", score(F.col(text_col))).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that the ranking accepts, with the columns that came in."""
    columns = docs.columns
    return score_quality(docs, labels).where("predicted = 1").select(*columns)
