"""Language identification by error-correcting output codes over byte n-gram classifiers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.llm.vectext import text_blocks

#: Hash buckets of three-byte sequences.
FEATURES = 1 << 15
#: Nats of summed log odds at which a bit's vote saturates the loss; longer texts don't count for more.
SHARPNESS = 12.0
#: One in so many texts judges the bits; and the most languages a model has.
JUDGED, MOST_LANGUAGES = 5, 512
#: Below this difference between the two smallest losses a prediction is called ambiguous.
MARGIN = 0.5

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def ngram_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature of every three bytes of the texts, each set between blanks, and the text it is in.

    ASCII letters are lower-cased, other ASCII is a blank; sequences that begin with two blanks are left out.
    """
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    padded = np.full(len(data) + 2 * n + 2, 32, np.uint8)
    padded[np.arange(len(data)) + 2 * doc + 1] = _FOLD[data]
    edge = offsets + 2 * np.arange(n + 1)
    b = padded.astype(np.uint32)
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    use = np.flatnonzero((code >> 8) != 0x2020)
    code = (code[use] * np.uint32(2654435761)) >> np.uint32(17)
    return code.astype(np.int64), np.searchsorted(edge, use, "right") - 1


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """A row of signs per class: all two-way splits up to six classes, else random splits far from each other."""
    if n < 2:
        return np.ones((n, 1), np.int8)
    if n <= 6:
        bits = np.array([[(b >> i) & 1 for b in range(1, 1 << (n - 1))] for i in range(n - 1)] + [[0] * ((1 << (n - 1)) - 1)])
        return (2 * bits - 1).astype(np.int8)
    rng, width = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    best, far = None, -1
    for _ in range(200):
        m = rng.choice(np.array([-1, 1], np.int8), (n, width))
        split = (np.abs(m.sum(0, dtype=np.int64)) < n).all()
        alike = m.astype(np.float32) @ m.T.astype(np.float32) - 2 * width * np.eye(n, dtype=np.float32)
        gap = int(width - alike.max()) // 2 if split else -1
        if gap > far:
            best, far = m, gap
    return best


@dataclass
class LanguageModel:
    """Languages, their codewords, a weight per feature and bit, and how far each bit is trusted for each language."""

    langs: list[str]
    codes: np.ndarray
    weights: np.ndarray
    trust: np.ndarray = field(default=None)

    @classmethod
    def from_counts(cls, langs: list[str], counts: np.ndarray) -> LanguageModel:
        """One binary naive Bayes classifier per column of the code; each language weighs the same."""
        share = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)
        codes = codewords(len(langs))
        w = np.zeros((counts.shape[1], codes.shape[1]), np.float32)
        for b in range(codes.shape[1]):
            one, zero = share[codes[:, b] > 0], share[codes[:, b] < 0]
            if len(one) and len(zero):
                w[:, b] = np.log(one.mean(0)) - np.log(zero.mean(0))
        return cls(langs, codes, w, np.full(codes.shape, 1.0 / codes.shape[1]))

    def votes(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Margin of each bit for each text."""
        f, doc = ngram_features(data, offsets)
        n = len(offsets) - 1
        out = np.zeros((n, self.weights.shape[1]))
        if len(f):
            has, first = np.unique(doc, return_index=True)
            for b in range(self.weights.shape[1]):
                out[has, b] = np.add.reduceat(self.weights[:, b][f], first)
        return SHARPNESS * np.tanh(out / SHARPNESS)

    def losses(self, votes: np.ndarray) -> np.ndarray:
        """Loss of each language for each text: logistic losses of the codeword's bits, weighted by trust."""
        z = votes[:, None, :] * self.codes[None]
        return (self.trust[None] * np.logaddexp(0, -z)).sum(-1)

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest codeword's language, a score from 0 to 1, and whether the second codeword is about as near."""
        loss = self.losses(self.votes(data, offsets))
        best = loss.argmin(1)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        two = np.sort(loss, 1)[:, :2]
        unsure = (two[:, -1] - two[:, 0] < MARGIN) if loss.shape[1] > 1 else np.zeros(len(loss), bool)
        return best, 1 / p.sum(1), unsure


def has_letter(text: Column) -> Column:
    """Whether there is a letter of any script."""
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fit on all rows with a text that has a letter and a language; nothing but these two columns is read.

    Both passes are distributed: n-gram counts by language, and the accuracy of each bit for each language. The latter is
    measured on a fifth of the texts, by a hash of them, with classifiers of the other four fifths, so that a bit is not
    judged on what it was fitted to. What comes to the driver is languages times twice ``FEATURES`` numbers, however many rows
    there are; a column with more than ``MOST_LANGUAGES`` values names no languages and is refused.
    """
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter(F.col("lang").isNotNull() & has_letter(F.col("text")))
    if labelled.filter(F.col(lang_col).isNotNull()).select(lang_col).distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"{lang_col} has more than {MOST_LANGUAGES} values")
    rows = rows.withColumn("judged", F.pmod(F.xxhash64("text"), F.lit(JUDGED)) == 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, bool], np.ndarray] = {}
        for batch in batches:
            names = list(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True))
            for a, b, data, offsets in text_blocks(batch.column(1)):
                f, doc = ngram_features(data, offsets)
                kinds = {k: i for i, k in enumerate(dict.fromkeys(names[a:b]))}
                of = np.array([kinds[k] for k in names[a:b]])[doc]
                for k, i in kinds.items():
                    sums.setdefault(k, np.zeros(FEATURES, np.int64))
                    sums[k] += np.bincount(f[of == i], minlength=FEATURES)
        for (lang, judged), v in sums.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array([judged] * len(at), pa.bool_()), pa.array(at, pa.int32()), pa.array(v[at], pa.int64())], ["lang", "judged", "f", "n"])

    sums = rows.mapInArrow(count, "lang string, judged boolean, f int, n long").groupBy("lang", "judged", "f").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(sums["lang"].unique())
    counts = np.zeros((2, len(langs), FEATURES))
    if langs:
        counts[sums["judged"].to_numpy().astype(int), np.searchsorted(np.array(langs, object), sums["lang"].to_numpy()), sums["f"].to_numpy()] = sums["n"].to_numpy()
    model = LanguageModel.from_counts(langs, counts.sum(0))
    if len(langs) < 2:
        return model
    fitted = LanguageModel.from_counts(langs, counts[0])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right, n = np.zeros(fitted.codes.shape, np.int64), np.zeros(len(langs), np.int64)
        for batch in batches:
            of = np.searchsorted(np.array(langs, object), np.array(batch.column(0).to_pylist(), object))
            for a, b, data, offsets in text_blocks(batch.column(1)):
                good = np.sign(fitted.votes(data, offsets)) == fitted.codes[of[a:b]]
                np.add.at(right, of[a:b], good.astype(np.int64))
                n += np.bincount(of[a:b], minlength=len(langs))
        i, j = np.indices(right.shape)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (i.ravel(), j.ravel(), right.ravel(), n[i.ravel()])], ["i", "j", "ok", "n"])

    trust = np.full(model.codes.shape, 0.5)
    for r in rows.filter("judged").select("lang", "text").mapInArrow(judge, "i long, j long, ok long, n long").groupBy("i", "j").agg(F.sum("ok").alias("ok"), F.sum("n").alias("n")).collect():
        trust[r["i"], r["j"]] = (r["ok"] + 1) / (r["n"] + 2)
    model.trust = trust
    model.trust /= model.trust.sum(1, keepdims=True)
    model.trust *= model.codes.shape[1]
    return model


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether the CRC-32 of the id as text is divisible by ``folds``; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``ambiguous``. Only the text is looked at, whole.

    A null text, one without a letter, or a model without languages gives ``und`` with score 0, not ambiguous. Repeated rows
    stay rows; other columns are kept, but for older ones of these three names. One scan, no shuffle.
    """
    docs = docs.drop("lang_pred", "score", "ambiguous", "_letter")
    names = [*docs.columns]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", _letter boolean, lang_pred string, score double, ambiguous boolean"
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.array([*model.langs, "und"], object)
        for batch in batches:
            lang, score, unsure = np.full(batch.num_rows, len(known) - 1), np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
            letter = np.array(batch.column(len(names)).to_pylist(), bool)
            if model.langs:
                for a, b, data, offsets in text_blocks(batch.column(at)):
                    lang[a:b], score[a:b], unsure[a:b] = model.predict(data, offsets)
            lang[~letter], score[~letter], unsure[~letter] = len(known) - 1, 0.0, False
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(known[lang], pa.string()), pa.array(score), pa.array(unsure)], [*batch.schema.names, "lang_pred", "score", "ambiguous"])

    return docs.withColumn("_letter", has_letter(F.col(text_col))).mapInArrow(run, schema).drop("_letter")
