"""Quality classifier by co-training of a text view and a metadata view.

The text view is a logistic regression over hashed words and a few shape
ratios of the text; the metadata view is one over source, language and length
classes.  In each round both views score every unlabelled row of the table, and
each hands the rows that it is most sure of to the other.  Both are then
calibrated on held-out labelled rows and combined, weighted by how much each
improves on the base rate.

Rows labelled toxic also teach a lexicon: the weight of a hashed word is its
log-odds between toxic and other rows, less twice its standard error, and the
strongest word of a text is its toxicity.  A document is kept if its quality is good and it is not toxic.

Fitting uses at most ``max_labelled`` labelled rows and ``handed`` rows that a
view hands over in a round; candidates are all rows, and every document is
scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import _text
from millrace.llm._store import forget, stored

TEXT_DIMS = 1 << 16
META_DIMS = 1 << 12
SHAPES = 12
#: Labelled rows on which the views are fitted and calibrated.
MAX_LABELLED = 6000
ROUNDS = 3
#: Rows that each view hands to the other in a round.
HANDED = 300
#: Cost of rejecting a good labelled row, in bad rows kept.
GOOD_COST = 5.0
#: Words of the lexicon at most.
LEXICON = 4096


def text_features(buf: np.ndarray, offs: np.ndarray):
    """Sparse rows (row, column, value): distinct hashed words of unit length, and shape ratios."""
    h, starts, ends, first = _text.words(buf, offs)
    n = np.diff(first)
    owner = np.repeat(np.arange(len(n)), n)
    code = np.unique((owner.astype(np.uint64) << np.uint64(16)) | (h & np.uint64(TEXT_DIMS - 1)))
    row, col = (code >> np.uint64(16)).astype(np.int64), (code & np.uint64(TEXT_DIMS - 1)).astype(np.int64)
    distinct = np.bincount(row, minlength=len(n))
    size = np.maximum(np.diff(offs), 1)

    def share(mask):
        return np.diff(np.concatenate([[0], np.cumsum(mask)])[offs]) / size

    upper, digit = share((buf >= 65) & (buf <= 90)), share((buf >= 48) & (buf <= 57))
    marks = share(((buf >= 33) & (buf <= 47)) | ((buf >= 58) & (buf <= 64)) | ((buf >= 91) & (buf <= 96)) | ((buf >= 123) & (buf <= 126)))
    lines, bars = share(buf == 10), share(buf == 124)
    length = np.concatenate([[0], np.cumsum(ends - starts)])
    mean = (length[first[1:]] - length[first[:-1]]) / np.maximum(n, 1)
    ratio = distinct / np.maximum(n, 1)
    dense = np.column_stack([
        upper > 0.3, upper > 0.1, marks > 0.25, marks > 0.12, bars > 0.02, digit > 0.2, ratio < 0.2, ratio < 0.4,
        np.minimum(mean / 10, 2), np.minimum(marks * 4, 2), np.minimum(lines * 20, 2), np.log1p(n) / 10,
    ]).astype(np.float64)
    dense[n == 0] = 0
    rows = np.concatenate([row, np.repeat(np.arange(len(n)), SHAPES)])
    cols = np.concatenate([col, np.tile(TEXT_DIMS + np.arange(SHAPES), len(n))])
    values = np.concatenate([1 / np.sqrt(distinct[row]), dense.ravel()])
    return rows.astype(np.int32), cols.astype(np.int32), values


_BARE = np.arange(256, dtype=np.uint8)
_BARE[[i for i in range(128) if not chr(i).isalnum()]] = 32


def bare_words(buf: np.ndarray, offs: np.ndarray):
    """(32 bits of the hashes, first word of each text) of words without ASCII punctuation."""
    h, _, _, first = _text.words(_BARE[buf], offs)
    return h.astype(np.uint32), first


def meta_features(table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of hashed metadata: source, language, length class and their pairs."""
    import zlib

    source, lang = table.column("source").to_pylist(), table.column("lang").to_pylist()
    sizes = [int(x or 0).bit_length() for x in table.column("n_chars").to_pylist()]
    rows, cols = [], []
    for i, (s, g, n) in enumerate(zip(source, lang, sizes, strict=True)):
        for key in (f"s={s}", f"l={g}", f"n={n}", f"s={s} n={n}", f"l={g} n={n}"):
            rows.append(i)
            cols.append(zlib.crc32(key.encode()) % META_DIMS)
    return np.array(rows, np.int32), np.array(cols, np.int32), np.full(len(rows), 5**-0.5)


class Linear:
    """Logistic regression on sparse rows, by AdaGrad over a fixed order of batches."""

    def __init__(self, dims: int):
        self.w, self.b = np.zeros(dims), 0.0

    def fit(self, x, y: np.ndarray, weight: np.ndarray, epochs: int = 25, batch: int = 256, rate: float = 0.5, decay: float = 1e-5):
        rows, cols, values, n = x
        if (rows[1:] < rows[:-1]).any():
            order = np.argsort(rows, kind="stable")
            rows, cols, values = rows[order], cols[order], values[order]
        at = np.searchsorted(rows, np.arange(n + 1))
        gw, gb = np.full(len(self.w), 1e-6), 1e-6
        shuffle = np.random.default_rng(7)
        for _ in range(epochs):
            todo = shuffle.permutation(n)
            for s in range(0, n, batch):
                take = todo[s : s + batch]
                count = at[take + 1] - at[take]
                pick = np.repeat(at[take] - np.cumsum(count) + count, count) + np.arange(count.sum())
                own = np.repeat(np.arange(len(take)), count)
                z = np.bincount(own, self.w[cols[pick]] * values[pick], len(take)) + self.b
                err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[take]) * weight[take] / len(take)
                c, inverse = np.unique(cols[pick], return_inverse=True)
                grad = np.bincount(inverse, err[own] * values[pick], len(c)) + decay * self.w[c]
                gw[c] += grad * grad
                self.w[c] -= rate * grad / np.sqrt(gw[c])
                gb += err.sum() ** 2
                self.b -= rate * err.sum() / np.sqrt(gb)
        return self

    def logit(self, x) -> np.ndarray:
        rows, cols, values, n = x
        return np.bincount(rows, self.w[cols] * values, n) + self.b


def _calibrate(z: np.ndarray, y: np.ndarray):
    """Slope and intercept of Platt's scaling, by Newton steps."""
    a, b = 1.0, 0.0
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([((p - t) * z).sum() + 1e-3 * (a - 1), (p - t).sum()])
        w = p * (1 - p) + 1e-9
        m = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(m, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 0.0), b


def _loss(p, y):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()


def cheapest_cut(badness: np.ndarray, bad: np.ndarray) -> float:
    """The value above which to reject at the lowest cost: one for a bad row that stays, ``GOOD_COST`` for a good row that goes.

    It lies between two values; of equal costs the one that rejects least.
    """
    values = np.unique(badness)
    gone = len(badness) - bad.sum() - np.searchsorted(np.sort(badness[~bad]), values, "right")
    stay = np.searchsorted(np.sort(badness[bad]), values, "right")
    cost = GOOD_COST * gone + stay
    best = len(values) - 1 - int(np.argmin(cost[::-1]))
    return float(values[best] if best == len(values) - 1 else (values[best] + values[best + 1]) / 2)


class Lexicon:
    """Weights of words (32 bits of their hashes) for one class of rows against the others, and the threshold above which a text is of that class."""

    def __init__(self, words: list[np.ndarray], y: np.ndarray):
        """words: the distinct words of each row."""
        self.word, self.weight, self.threshold = np.zeros(0, np.uint32), np.zeros(0), np.inf
        held = np.arange(len(y)) % 4 == 0
        if len(y) < 20 or y[~held].min() == y[~held].max():
            return
        inside, outside = (np.unique(np.concatenate([words[i] for i in np.flatnonzero(~held & (y == k))]), return_counts=True) for k in (1, 0))
        if not len(inside[0]) or not len(outside[0]):  # texts without words on one side teach nothing
            return
        at = np.minimum(np.searchsorted(outside[0], inside[0]), len(outside[0]) - 1)
        other = np.where(outside[0][at] == inside[0], outside[1][at], 0)
        n, m = (y[~held] == 1).sum(), (y[~held] == 0).sum()
        odds = np.log((inside[1] + 0.5) / (n + 1)) - np.log((other + 0.5) / (m + 1))
        weight = odds - 2 * np.sqrt(1 / (inside[1] + 0.5) + 1 / (other + 0.5))  # a word seen a few times proves little
        best = np.sort(np.argsort(-weight, kind="stable")[:LEXICON])
        best = best[weight[best] > 0]
        self.word, self.weight = inside[0][best], weight[best]
        sizes = np.array([0, *(len(w) for w in words)])
        own = self.score(np.concatenate(words), np.cumsum(sizes))
        self.threshold = max(cheapest_cut(own[held], y[held] == 1), 1.0)

    def score(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Weight of the strongest word of each text ``h[first[i]:first[i + 1]]``."""
        out = np.zeros(len(first) - 1)
        if len(self.word) and len(h):
            at = np.minimum(np.searchsorted(self.word, h), len(self.word) - 1)
            hit = np.flatnonzero(self.word[at] == h)
            np.maximum.at(out, np.searchsorted(first, hit, "right") - 1, self.weight[at[hit]])
        return out


class CoTrained:
    """Both calibrated views, their weights, the threshold below which a document is rejected, and the toxic lexicon."""

    def __init__(self, text, meta, cal_text, cal_meta, weights, threshold, prior):
        self.text, self.meta, self.cal_text, self.cal_meta, self.weights, self.threshold, self.prior = text, meta, cal_text, cal_meta, weights, threshold, prior
        self.toxic: Lexicon | None = None

    def combined(self, zt, zm):
        return 1 / (1 + np.exp(-np.clip(self.prior + self.weights[0] * (zt - self.prior) + self.weights[1] * (zm - self.prior), -30, 30)))


def _rows(x, keep):
    """The rows of a sparse matrix that a mask or index array selects, in that order."""
    rows, cols, values, n = x
    keep = np.flatnonzero(keep) if keep.dtype == bool else keep
    place = np.full(n, -1)
    place[keep] = np.arange(len(keep))
    ok = place[rows] >= 0
    return place[rows[ok]], cols[ok], values[ok], len(keep)


def _joined(a, b):
    return np.concatenate([a[0], b[0] + a[3]]), np.concatenate([a[1], b[1]]), np.concatenate([a[2], b[2]]), a[3] + b[3]


def cotrain(xt, xm, y: np.ndarray, confident, rounds: int = ROUNDS) -> CoTrained | None:
    """Fit both views on labelled rows (xt, xm, y) and on the rows that each hands to the other; None without both classes.

    ``confident(views, good)`` takes (model, slope, intercept) of the text and
    the metadata view and the share of good rows, and returns new unlabelled
    rows for the text view and for the metadata view as (features, labels).
    """
    if len(y) < 20 or y.min() == y.max():
        return None
    held = np.arange(len(y)) % 4 == 0
    if y[held].min() == y[held].max():
        return None
    lt, lm, ly = _rows(xt, ~held), _rows(xm, ~held), y[~held]
    ht, hm = _rows(xt, held), _rows(xm, held)
    data = [(lt, ly, np.ones(len(ly))), (lm, ly, np.ones(len(ly)))]
    dims = (TEXT_DIMS + SHAPES, META_DIMS)
    for step in range(rounds + 1):
        text, meta = (Linear(d).fit(*own) for own, d in zip(data, dims, strict=True))
        if step == rounds:
            break
        # sureness is measured on rows that the views were not fitted on
        views = [(view, *_calibrate(view.logit(own), y[held])) for view, own in ((text, ht), (meta, hm))]
        more = confident(views, float(ly.mean()))
        data = [(_joined(x, new), np.concatenate([z, label]), np.concatenate([w, np.full(len(label), 0.5)])) for (x, z, w), (new, label) in zip(data, more, strict=True)]
    yh = y[held]
    zt, zm = text.logit(ht), meta.logit(hm)
    ct, cm = _calibrate(zt, yh), _calibrate(zm, yh)
    zt, zm = ct[0] * zt + ct[1], cm[0] * zm + cm[1]
    base = _loss(np.full(len(yh), yh.mean()), yh)
    gain = np.array([max(0.0, base - _loss(1 / (1 + np.exp(-np.clip(z, -30, 30))), yh)) for z in (zt, zm)])
    weights = gain / max(gain.max(), 1e-9)
    prior = float(np.log(yh.mean() / (1 - yh.mean())))
    model = CoTrained(text, meta, ct, cm, weights, 0.5, prior)
    model.threshold = min(0.5, -cheapest_cut(-model.combined(zt, zm), yh == 0))
    return model


def _view_columns(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"),
    )


_SPARSE = [(c, pa.list_(t)) for c, t in (("tc", pa.int32()), ("tv", pa.float32()), ("mc", pa.int32()), ("mv", pa.float32()))]


def _features(rows: DataFrame):
    """Rows (doc_id, th, y, toxic) of a bounded table with their features, on the driver, in the order of doc_id and th."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("y", pa.float64()), ("toxic", pa.float64()), ("words", pa.list_(pa.int32())), *_SPARSE])

    def run(batches):
        for b in _text.pieces(batches):
            lists = {}
            buf, offs = _text.column_bytes(b.column("text"))
            h, first = bare_words(buf, offs)
            own = [np.unique(h[s:e]).view(np.int32) for s, e in zip(first[:-1], first[1:], strict=True)]
            for name, (rows, cols, values) in (("t", text_features(buf, offs)), ("m", meta_features(b))):
                order = np.argsort(rows, kind="stable")
                at = pa.array(np.searchsorted(rows[order], np.arange(b.num_rows + 1)).astype(np.int32))
                lists[name + "c"] = pa.ListArray.from_arrays(at, pa.array(cols[order]))
                lists[name + "v"] = pa.ListArray.from_arrays(at, pa.array(values[order].astype(np.float32)))
            yield _text.batch_of(schema, **{c: b.column(c) for c in ("doc_id", "th", "y", "toxic")}, words=own, **lists)

    ddl = "doc_id long, th long, y double, toxic double, words array<int>, tc array<int>, tv array<float>, mc array<int>, mv array<float>"
    table = rows.mapInArrow(run, ddl).dropDuplicates(["doc_id", "th"]).orderBy("doc_id", "th").toArrow()  # of bounded size

    def matrix(c, v):
        lists = table.column(c).combine_chunks()
        at = lists.offsets.to_numpy()
        return np.repeat(np.arange(len(lists), dtype=np.int32), np.diff(at)), lists.flatten().to_numpy(), table.column(v).combine_chunks().flatten().to_numpy(), len(lists)

    if not table.num_rows:
        none = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32), 0
        return table, none, none
    return table, matrix("tc", "tv"), matrix("mc", "mv")


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS, handed: int = HANDED, sure: float = 0.95) -> CoTrained | None:
    """Co-train on a bounded sample of the labelled rows of ``docs`` (``labels``: doc_id, quality, toxic) and on all its other rows.

    Labelled rows are sampled by a hash of doc_id and text, so the same rows
    at every run; of several labels of one doc_id the larger one holds.  Rows
    alike in doc_id and text count once.
    """
    spark = docs.sparkSession
    view = _view_columns(docs).withColumn("th", F.xxhash64("text"))
    names = [c for c in ("quality", "toxic") if c in labels.columns]
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.max(c).cast("double").alias(c) for c in names))
    known = known.select("doc_id", F.col("quality").alias("y"), (F.col("toxic") if "toxic" in names else F.lit(None)).cast("double").alias("toxic"))
    keys = view.where("doc_id is not null and text is not null").select("doc_id", "th")
    labelled = keys.join(known.where("y is not null"), "doc_id").dropDuplicates(["doc_id", "th"])
    rank = F.xxhash64("doc_id", "th", F.lit(11))
    chosen = stored(labelled.orderBy(rank, "doc_id", "th").limit(max_labelled))
    # at most max_labelled rows: the bound of this broadcast
    table, xt, xm = _features(view.join(F.broadcast(chosen), ["doc_id", "th"]))
    if not table.num_rows:
        return None
    y, toxic = table.column("y").to_numpy(), table.column("toxic").fill_null(0.0).to_numpy()
    words = table.column("words").combine_chunks()
    at, flat = words.offsets.to_numpy(), words.flatten().to_numpy().view(np.uint32)
    lexicon = Lexicon([flat[s:e] for s, e in zip(at[:-1], at[1:], strict=True)], toxic)
    del table, words, at, flat
    used: list[DataFrame] = []

    def confident(views, good):
        """Of all unlabelled rows those that a view is most sure of, as many of each class as its share."""
        shared = spark.sparkContext.broadcast(views)
        schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("pt", pa.float64()), ("pm", pa.float64())])

        def judge(batches):
            (text, a, b0), (meta, c, d) = shared.value
            for b in _text.pieces(batches):
                zt = a * text.logit((*text_features(*_text.column_bytes(b.column("text"))), b.num_rows)) + b0
                zm = c * meta.logit((*meta_features(b), b.num_rows)) + d
                yield _text.batch_of(schema, doc_id=b.column("doc_id"), th=b.column("th"), pt=zt, pm=zm)

        judged = view.where("doc_id is not null and text is not null").mapInArrow(judge, "doc_id long, th long, pt double, pm double")
        judged = stored(judged.join(known.select("doc_id"), "doc_id", "left_anti"))
        fresh = judged
        for before in used:
            fresh = fresh.join(F.broadcast(before), ["doc_id", "th"], "left_anti")  # at most 4 * handed rows each
        bound, picks = float(np.log(sure / (1 - sure))), []
        for column, to in (("pt", "m"), ("pm", "t")):
            for label, order in ((1.0, F.desc(column)), (0.0, F.asc(column))):
                n = max(1, int(handed * (good if label else 1 - good)))
                some = fresh.where((F.col(column) >= bound) if label else (F.col(column) <= -bound))
                some = some.orderBy(order, rank, "doc_id", "th").limit(n)
                picks.append(some.select("doc_id", "th", F.lit(label).alias("y"), F.lit(to).alias("to")))
        pick = picks[0].unionByName(picks[1]).unionByName(picks[2]).unionByName(picks[3])
        # a row given to a view with both labels is given with none
        pick = pick.groupBy("doc_id", "th").agg(F.max(F.when(F.col("to") == "t", F.col("y"))).alias("y"), F.max(F.when(F.col("to") == "m", F.col("y"))).alias("toxic"))
        pick = stored(pick)
        forget(judged)
        used.append(pick.select("doc_id", "th"))
        shared.destroy()
        more, ut, um = _features(view.join(F.broadcast(pick), ["doc_id", "th"]))
        out = []
        for x, name in ((ut, "y"), (um, "toxic")):  # the label for the text view, the label for the metadata view
            label = more.column(name).fill_null(np.nan).to_numpy() if more.num_rows else np.zeros(0)
            keep = np.isfinite(label)
            out.append((_rows(x, keep), label[keep]))
        return out

    model = cotrain(xt, xm, y, confident, rounds)
    if model is not None:
        model.toxic = lexicon
    del xt, xm
    _text.trim()
    return model


def score(docs: DataFrame, model: CoTrained | None, keep_columns: bool = False) -> DataFrame:
    """Score every document.

    Columns: doc_id, text_score, meta_score, score (probability of good
    quality), toxicity (above 1: toxic), toxic, kept.  Null and empty texts
    have no text evidence: their text score is the base rate and they are
    kept.  Without a model (no labels, or labels of one class) every score is
    0.5 and everything is kept.  Repeated rows get a row each.  An empty table
    gives an empty table; extra columns are ignored.  ``keep_columns`` returns
    the kept rows of ``docs`` with their own columns instead.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.float64()) for c in ("text_score", "meta_score", "score", "toxicity")), ("toxic", pa.bool_()), ("kept", pa.bool_())])

    def judge(b):
        m = shared.value
        if m is None:
            half = np.full(b.num_rows, 0.5)
            return half, half, half, np.zeros(b.num_rows), np.ones(b.num_rows, bool)
        buf, offs = _text.column_bytes(b.column("text"))
        x = (*text_features(buf, offs), b.num_rows)
        zt = m.cal_text[0] * m.text.logit(x) + m.cal_text[1]
        zm = m.cal_meta[0] * m.meta.logit((*meta_features(b), b.num_rows)) + m.cal_meta[1]
        toxicity = m.toxic.score(*bare_words(buf, offs)) / m.toxic.threshold if m.toxic else np.zeros(b.num_rows)
        blank = np.bincount(np.repeat(np.arange(b.num_rows), np.diff(offs))[~_text.SPACE[buf]], minlength=b.num_rows) == 0
        zt[blank] = m.prior
        p = m.combined(zt, zm)
        return 1 / (1 + np.exp(-np.clip(zt, -700, 700))), 1 / (1 + np.exp(-np.clip(zm, -700, 700))), p, toxicity, ((p >= m.threshold) & (toxicity <= 1)) | blank

    def scores(batches):
        for b in _text.pieces(batches):
            t, m, p, toxicity, kept = judge(b)
            yield _text.batch_of(schema, doc_id=b.column("doc_id"), text_score=t, meta_score=m, score=p, toxicity=toxicity, toxic=toxicity > 1, kept=kept)

    def good(batches):
        for b in _text.pieces(batches):
            yield b.filter(pa.array(judge(b)[4]))

    if keep_columns:
        return docs.mapInArrow(good, docs.schema)
    return _view_columns(docs).mapInArrow(scores, "doc_id long, text_score double, meta_score double, score double, toxicity double, toxic boolean, kept boolean")
