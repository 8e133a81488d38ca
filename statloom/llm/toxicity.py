"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a seed lexicon and of a lexicon that is learnt
from the labelled rows, lexicon words near a second-person pronoun, lexicon words that
only appear once look-alike characters are undone, and rates of capitals, punctuation,
exclamation and question marks, digits and non-ASCII bytes.

A learnt word must meet toxic text in several different contexts (distinct words before
it), so that copies of one text don't make their words a lexicon.

Defined results: a null text is scored as an empty one. Labels that are null, or that
belong to a null id or to no document, teach nothing; contradicting labels of one id
count as toxic. Without both classes to learn from, every score is the share of toxic
rows (0 with no row). Repeated rows are scored alike, and texts with equal features tie;
an empty table gives none. Very long texts are scored whole. Columns other than id and text
are not read by the query; ``score`` replaces one of its name.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.llm.common import CHUNK, Words, held_out, learnable, spans, text_buffer, with_arrow_columns

SEED_LEXICON = "idiot moron stupid dumb loser fool scum trash garbage pathetic worthless disgusting ugly clown jerk liar filth hate kill shut"
SECOND_PERSON = "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch usted ustedes ti tus vosotros"
FEATURES = ("seed_density", "seed_count", "learnt_density", "learnt_count", "near_you", "obfuscated", "capitals", "punctuation", "exclamation", "question", "digits", "non_ascii", "log_words")

_ASCII = np.arange(256)
_LETTER_BYTE = ((_ASCII | 32) >= 97) & ((_ASCII | 32) <= 122)
_DIGIT_BYTE = (_ASCII >= 48) & (_ASCII <= 57)
_UPPER_BYTE = (_ASCII >= 65) & (_ASCII <= 90)
_NOT_WORD = (_ASCII < 128) & ~_LETTER_BYTE & ~_DIGIT_BYTE
_PUNCTUATION = (_ASCII > 32) & _NOT_WORD
_UNDISGUISED = _ASCII.astype(np.uint8)
for _a, _b in zip("013457@$!|", "oieastasil", strict=True):
    _UNDISGUISED[ord(_a)] = ord(_b)
_FILLER = np.zeros(256, bool)
_FILLER[list(b".-*_'\",;:?()")] = True


def _hash_words(words: str) -> np.ndarray:
    raw = np.frombuffer(words.encode(), np.uint8)
    return np.unique(Words(raw, np.array([0, len(raw)])).hashes())


def _member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return sorted_values[at] == x


def _views(column: pa.Array):
    """(first row, bytes, starts) of pieces of a string column; a null is an empty text."""
    raw, offsets, nulls = text_buffer(column)
    for i, j in spans(offsets, CHUNK):
        yield i, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def features(raw: np.ndarray, starts: np.ndarray, seed: np.ndarray, learnt: np.ndarray, you: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text."""
    n = len(starts) - 1
    words = Words(raw, starts, lower=True, space=_NOT_WORD)
    h, doc = words.hashes(), words.doc
    in_seed, in_learnt = _member(seed, h), _member(learnt, h)
    hit = in_seed | in_learnt
    per = lambda flag, who: np.bincount(who[flag], minlength=n).astype(np.float64)
    pronoun = np.flatnonzero(_member(you, h))
    where = np.flatnonzero(hit)
    near = np.zeros(len(where), bool)
    if len(pronoun) and len(where):
        at = np.searchsorted(pronoun, where)
        for side in (np.maximum(at - 1, 0), np.minimum(at, len(pronoun) - 1)):
            near |= (np.abs(pronoun[side] - where) <= 5) & (doc[pronoun[side]] == doc[where])
    # the same words with look-alikes undone and fillers inside words taken out
    keep = ~_FILLER[raw]
    place = np.concatenate([[0], np.cumsum(keep)])
    plain = Words(_UNDISGUISED[raw][keep], place[starts], lower=True)
    hidden = _member(seed, ph := plain.hashes()) | _member(learnt, ph)
    count = np.maximum(words.count, 1)

    def share(table: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(table[raw])])
        return (total[starts[1:]] - total[starts[:-1]]).astype(np.float64)

    letters, size = np.maximum(share(_LETTER_BYTE), 1), np.maximum(np.diff(starts), 1)
    mark = np.zeros((2, 256), bool)
    mark[0, 33] = mark[1, 63] = True
    seeds, learnts = per(in_seed, doc), per(in_learnt, doc)
    return np.column_stack([
        seeds / count, seeds, learnts / count, learnts, np.bincount(doc[where[near]], minlength=n),
        np.maximum(per(hidden, plain.doc) - per(hit, doc), 0), share(_UPPER_BYTE) / letters, share(_PUNCTUATION) / size,
        share(mark[0]) / count, share(mark[1]) / count, share(_DIGIT_BYTE) / size, share(_ASCII >= 128) / size, np.log1p(words.count),
    ])


@dataclass
class Trees:
    """Boosted regression trees of fixed depth for the logistic loss; histogram splits."""

    depth: int = 3
    rounds: int = 80
    rate: float = 0.2
    shrink: float = 1.0
    bins: int = 32
    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def _code(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(self.cuts)])

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.quantile(np.unique(c), np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) for c in x.T]
        code = self._code(x)
        mean = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(mean / (1 - mean)))
        z = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-z))
            g, h = p - y, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.zeros(2**self.depth, np.int64), np.full(2**self.depth, self.bins + 1)
            for level in range(self.depth):
                width, best = 2**level, np.full(2**level, 1e-6)
                for f in range(code.shape[1]):
                    key = node * (self.bins + 1) + code[:, f]
                    gs = np.bincount(key, g, width * (self.bins + 1)).reshape(width, -1)
                    hs = np.bincount(key, h, width * (self.bins + 1)).reshape(width, -1)
                    gl, hl = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1]
                    gt, ht = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                    gain = gl**2 / (hl + self.shrink) + (gt - gl) ** 2 / (ht - hl + self.shrink) - gt**2 / (ht + self.shrink)
                    gain[(hl < 0.5) | (ht - hl < 0.5)] = 0
                    at = gain.argmax(1)
                    top = gain[np.arange(width), at]
                    for k in np.flatnonzero(top > best):
                        best[k], feature[width + k], cut[width + k] = top[k], f, at[k]
                node = 2 * node + (code[np.arange(len(y)), feature[width + node]] > cut[width + node])
            leaf = -self.rate * np.bincount(node, g, 2**self.depth) / (np.bincount(node, h, 2**self.depth) + self.shrink)
            self.trees.append((feature, cut, leaf))
            z += leaf[node]
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        if not self.trees:
            return z
        code, row = self._code(x), np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                node = 2 * node + (code[row, feature[2**level + node]] > cut[2**level + node])
            z += leaf[node]
        return z


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and values of the best non-decreasing fit. One row
    of each class is added at the ends, so that no value is exactly 0 or 1."""
    knots, group = np.unique(score, return_inverse=True)
    weight = np.bincount(group).astype(float)
    value = np.bincount(group, y) / weight
    weight, value = np.concatenate([[1.0], weight, [1.0]]), np.concatenate([[0.0], value, [1.0]])
    knots = np.concatenate([[knots[0]], knots, [knots[-1]]])
    blocks: list[list[float]] = []
    for v, w in zip(value, weight, strict=True):
        blocks.append([v * w, w, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            a = blocks.pop()
            blocks[-1] = [x + z for x, z in zip(blocks[-1], a, strict=True)]
    fitted = np.concatenate([np.full(int(n), s / w) for s, w, n in blocks])
    return knots, np.clip(fitted, 1e-4, 1 - 1e-4)


@dataclass
class ToxicityModel:
    seed: np.ndarray
    learnt: np.ndarray
    you: np.ndarray
    trees: Trees | None
    knots: np.ndarray
    values: np.ndarray
    prior: float

    def score(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(starts) - 1, self.prior)
        return np.interp(self.trees.logit(features(raw, starts, self.seed, self.learnt, self.you)), self.knots, self.values)


def _contexts(column: pa.Array) -> list:
    """Distinct (word, word before it) of each text."""
    word, before = [], []
    for _, raw, starts in _views(column):
        words = Words(raw, starts, lower=True, space=_NOT_WORD)
        h = words.hashes()
        prior = np.concatenate([[0], h[:-1]]).astype(np.uint64) if len(h) else h
        if len(h):
            prior[words.first[:-1][words.count > 0]] = 0
        for a, b in zip(words.first[:-1], words.first[1:], strict=True):
            pair = np.unique(np.stack([h[a:b], prior[a:b]]), axis=1)
            word.append(pair[0].view(np.int64).tolist())
            before.append(pair[1].view(np.int64).tolist())
    return [word, before]


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", sample_rows: int = 6000, lexicon_size: int = 256) -> ToxicityModel:
    """Learn from about ``sample_rows`` labelled rows, chosen by a hash of their id; the
    bound keeps the driver's share constant. A quarter of them calibrates the scores."""
    seed, you = _hash_words(SEED_LEXICON), _hash_words(SECOND_PERSON)
    able = labels.filter(learnable(id_col) & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    total = able.select(F.count(F.lit(1))).first()[0]
    draw = F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(1 << 30))
    chosen = able.withColumn("draw", draw).filter(F.col("draw") < int((1 << 30) * min(1.0, sample_rows / max(total, 1))))
    # about sample_rows rows of three numbers: small enough to send to every task
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    sample = text.join(F.broadcast(chosen), "id").select("y", "draw", "t")
    pair = [T.StructField("word", T.ArrayType(T.LongType())), T.StructField("before", T.ArrayType(T.LongType()))]
    seen = with_arrow_columns(sample, "t", pair, _contexts).select("y", F.explode(F.arrays_zip("word", "before")).alias("p")).select("y", "p.word", "p.before").distinct()
    rows = seen.groupBy("word").agg(F.count_if(F.col("y") == 1).alias("bad"), F.count_if(F.col("y") == 0).alias("good")).filter("bad >= 8 and bad >= good").orderBy(F.desc(F.expr("(bad + 0.5) / (good + 0.5)")), "word").limit(lexicon_size).collect()
    learnt = np.unique(np.array([r.word for r in rows if (r.bad + 0.5) / (r.good + 0.5) >= 4], np.int64).view(np.uint64))

    def make(column: pa.Array) -> list:
        return [[row for _, raw, starts in _views(column) for row in features(raw, starts, seed, learnt, you).tolist()]]

    got = with_arrow_columns(sample, "t", [T.StructField("x", T.ArrayType(T.DoubleType()))], make).select("y", "draw", "x").collect()
    got = sorted(got, key=lambda r: (r.draw, r.y, r.x))
    y = np.array([float(r.y > 0) for r in got])
    if not len(y) or y.min() == y.max():
        return ToxicityModel(seed, learnt, you, None, np.zeros(0), np.zeros(0), float(y.mean()) if len(y) else 0.0)
    x = np.array([r.x for r in got])
    part = np.arange(len(y)) % 4 == 0
    if y[part].min() == y[part].max() or y[~part].min() == y[~part].max():
        part[:] = True  # too few rows to keep a part for calibration
        trees = Trees().fit(x, y)
    else:
        trees = Trees().fit(x[~part], y[~part])
    knots, values = isotonic(trees.logit(x[part]), y[part])
    return ToxicityModel(seed, learnt, you, trees, knots, values, float(y.mean()))


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score``, the calibrated probability of the toxic label."""
    share = docs.sparkSession.sparkContext.broadcast(model)  # trees and at most a few hundred words

    def make(column: pa.Array) -> list:
        parts = [share.value.score(raw, starts) for _, raw, starts in _views(column)]
        return [np.concatenate(parts) if parts else np.zeros(0)]

    return with_arrow_columns(docs, text_col, [T.StructField("score", T.DoubleType())], make)


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels)
    rows = score(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
