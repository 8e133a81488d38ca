"""Language identification: sparse multinomial logistic regression on TF-IDF character
n-grams, trained with follow-the-regularised-leader and elastic-net penalties, followed
by temperature calibration.

Features are hashed 2- and 3-grams of lower-cased letters (every non-letter counts as
one blank); a gram's weight is its relative frequency in the whole text times its idf.
Relative frequencies make a document's logits a mean over its grams, so scoring is one
table look-up a gram and needs no per-document vector.

Defined results: a null text, an empty one or one without a letter is ``und`` with score
0. With no labelled row to learn from, everything is ``und``. A null id is never learnt
from and never held out. Repeated rows are scored alike; of languages with equal scores the
first by name wins; an empty table gives none. Very long texts are read whole. ``identify``
replaces columns named like new ones; ``keep_identified`` leaves all columns, whatever their
names, as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.llm.common import CHUNK, fresh, held_out, learnable, spans, text_buffer, with_arrow_columns

BITS = 15
DIM = 1 << BITS
UNKNOWN = "und"
_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram index, text number, has-letter by text) of all grams of some texts."""
    lowered = [t.lower() for t in texts]
    size = np.fromiter(map(len, lowered), np.int64, len(lowered))
    code = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), size)
    has = np.zeros(len(texts), bool)
    has[doc[letter]] = True
    code = np.where(letter, code, np.uint32(32))
    # blanks that follow a blank carry nothing
    keep = letter.copy()
    keep[1:] |= letter[:-1] | (doc[1:] != doc[:-1])
    code, doc = code[keep], doc[keep]
    out, who = [], []
    for k, seed in ((2, 0x2C1B3C6D), (3, 0x297A2D39)):
        n = len(code) - k + 1
        if n <= 0:
            continue
        h = np.full(n, seed, np.uint32)
        for j in range(k):
            h = (h ^ code[j : j + n]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        same = doc[:n] == doc[k - 1 :]
        out.append((h[same] * np.uint32(0x85EBCA77) >> np.uint32(32 - BITS)).astype(np.int32))
        who.append(doc[:n][same])
    if not out:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), has
    return np.concatenate(out), np.concatenate(who), has


def _chunks(column: pa.Array):
    """(first row, texts) of pieces of a string column; a null is an empty text."""
    _, offsets, _ = text_buffer(column)
    for i, j in spans(offsets, CHUNK):
        yield i, [t or "" for t in column.slice(i, j - i).to_pylist()]


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # DIM x languages, idf included
    bias: np.ndarray
    temperature: float

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        index, who, has = _grams(texts)
        total = np.zeros((len(texts), len(self.languages)))
        count = np.bincount(who, minlength=len(texts))
        for k in range(len(self.languages)):
            total[:, k] = np.bincount(who, weights=self.weights[:, k][index], minlength=len(texts))
        return total / np.maximum(count, 1)[:, None] + self.bias, has

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        z, has = self.logits(texts)
        p = _softmax(z / self.temperature)
        best = p.argmax(1)
        return [self.languages[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)], [float(x) if h else 0.0 for x, h in zip(p.max(1), has, strict=True)]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _sparse_counts(column: pa.Array) -> list:
    index, value = [], []
    for _, texts in _chunks(column):
        gram, who, _ = _grams(texts)
        order = np.argsort(who, kind="stable")
        gram, edge = gram[order], np.searchsorted(who[order], np.arange(len(texts) + 1))
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            u, n = np.unique(gram[a:b], return_counts=True)
            index.append(u.astype(np.int32).tobytes())
            value.append((n / max(b - a, 1)).astype(np.float32).tobytes())
    return [index, value]


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_rows: int = 3000, epochs: int = 4, alpha: float = 0.5, l1: float = 1e-4, l2: float = 1e-3, scale: float = 40.0) -> LanguageModel:
    """Learn from about ``sample_rows`` labelled rows (a hash of the id chooses them, the
    same ones each time); the bound is what keeps the driver's share constant. A quarter
    of them sets the temperature and is not trained on."""
    able = docs.filter(learnable(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    total = able.select(F.count(F.lit(1))).first()[0]
    if not total:
        return LanguageModel([], np.zeros((DIM, 0)), np.zeros(0), 1.0)
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit("language")), F.lit(1 << 30))
    sample = able.select(F.col(lang_col).alias("y"), draw.alias("draw"), F.col(text_col).alias("t"))
    if total > sample_rows:
        sample = sample.filter(F.col("draw") < int((1 << 30) * sample_rows / total))
    fields = [T.StructField("index", T.BinaryType()), T.StructField("value", T.BinaryType())]  # packed: the driver holds the sample
    rows = with_arrow_columns(sample, "t", fields, _sparse_counts).select("y", "draw", "index", "value").collect()
    rows = sorted((r for r in rows if len(r["index"])), key=lambda r: (r.draw, r.y, bytes(r["index"])))
    languages = sorted({r.y for r in rows})
    if not languages:
        return LanguageModel([], np.zeros((DIM, 0)), np.zeros(0), 1.0)
    code = {y: k for k, y in enumerate(languages)}
    data = [(np.frombuffer(r["index"], np.int32), np.frombuffer(r["value"], np.float32).astype(np.float64), code[r.y]) for r in rows]
    check = data[::4] if len(data) >= 40 else data
    train = [d for k, d in enumerate(data) if k % 4] if len(data) >= 40 else data

    df = np.zeros(DIM)
    for index, _, _ in train:
        df[index] += 1
    idf = np.log((1 + len(train)) / (1 + df)) + 1

    # follow the regularised leader: z and n sum up gradients, weights are their closed form
    k = len(languages)
    z, n, w = np.zeros((DIM, k)), np.zeros((DIM, k)), np.zeros((DIM, k))
    zb, nb = np.zeros(k), np.zeros(k)
    for epoch in range(epochs):
        for at in np.random.default_rng(epoch).permutation(len(train)):
            index, value, y = train[at]
            x = value * idf[index] * scale
            bias = -zb * alpha / (1 + np.sqrt(nb))
            own = w[index]
            logit = x @ own + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            was = n[index]
            now = was + g * g
            z[index] += g - (np.sqrt(now) - np.sqrt(was)) / alpha * own
            n[index] = now
            zi = z[index]
            w[index] = np.where(np.abs(zi) <= l1, 0, -(zi - np.sign(zi) * l1) / ((1 + np.sqrt(now)) / alpha + l2))
            zb += p - (np.sqrt(nb + p * p) - np.sqrt(nb)) / alpha * bias
            nb += p * p
    bias = -zb * alpha / (1 + np.sqrt(nb))
    model = LanguageModel(languages, w * idf[:, None] * scale, bias, 1.0)
    logit = np.array([(model.weights[i] * v[:, None]).sum(0) + bias for i, v, _ in check])
    truth = np.array([y for _, _, y in check])
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 60))
    loss = [-np.log(_softmax(logit / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    return model


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the language and its probability (columns of those names are replaced)."""
    share = docs.sparkSession.sparkContext.broadcast(model)  # DIM x languages numbers

    def make(column: pa.Array) -> list:
        lang: list[str] = []
        score: list[float] = []
        for _, texts in _chunks(column):
            a, b = share.value.predict(texts)
            lang += a
            score += b
        return [lang, score]

    return with_arrow_columns(docs, text_col, [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())], make)


def language_query(docs: DataFrame) -> DataFrame:
    model = fit(docs)
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return identify(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents whose language is recognised: not ``und``, and with a calibrated
    probability of ``threshold`` or more. Columns stay as they are."""
    model = fit(docs)
    names = docs.columns
    lang, score = fresh(names, "__lang"), fresh(names, "__score")
    scored = identify(docs, model, "text", (lang, score))
    return scored.filter((F.col(lang) != UNKNOWN) & (F.col(score) >= threshold)).select(*[f"`{c}`" for c in names])
