"""Language identification with error-correcting output codes.

Each language gets a codeword; each bit of the code splits the languages in two and
has its own binary classifier over character n-grams: the log-odds of 2- and 3-grams
(hashed) between the two sides, averaged over the text. Decoding is loss-weighted: the
exponential loss of every bit against a codeword's bit, weighted by how often that bit
is right for that language on the training sample; the language of least loss wins. A
text is flagged ambiguous where the runner-up is nearly as good.

The sample holds about ``PER_LANGUAGE`` labelled documents per language, chosen by a
hash of the identifier; it is the only bounded part. N-gram counts are summed on the
cluster; the driver gets one row per language and hashed n-gram (2^15 at most).

Defined results: a null text, or one without a letter, is ``und`` with score 0, as is
every text where nothing could be learned (no labelled row); with one language known,
that one with score 1; null labels are not learned from; a null identifier hashes as
the empty string; extra columns are ignored by ``predict`` and kept by
``keep_identified``; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runfold.llm.common import settle, table

PER_LANGUAGE = 2000
GRAM_BITS = 14
N_FEATURES = 2 << GRAM_BITS
CHUNK = 1 << 20
#: loss advantage over the runner-up below which a text is ambiguous
AMBIGUOUS = 0.02
_LETTER = re.compile(r"[^\W\d_]")


# ------------------------------------------------------------------ features
@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


def _pieces(texts: list[str]) -> Iterator[tuple[str, list[int], list[int]]]:
    """Texts, long ones in pieces that overlap by two characters, joined into
    chunks: the joined string, and per piece its text's number and its start."""
    joined, owner, start, at = [], [], [], 0
    for k, text in enumerate(texts):
        text = text.lower()
        for i in range(0, max(1, len(text)), CHUNK):
            piece = f" {text[i:i + CHUNK + 2]} " if i == 0 else f"{text[i:i + CHUNK + 2]} "
            joined.append(piece)
            owner.append(k)
            start.append(at)
            at += len(piece)
            if at >= CHUNK:
                yield "".join(joined), owner, start
                joined, owner, start, at = [], [], [], 0
    if joined:
        yield "".join(joined), owner, start


def _grams(joined: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 2- and 3-grams that start at each character, and whether each counts
    (a 2-gram needs a letter, a 3-gram a letter in its middle). Other characters
    than letters are all one."""
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[code]
    code = np.where(letter, code, np.uint32(32))
    letter, code = np.append(letter, [False, False]), np.append(code, np.array([32, 32], dtype=np.uint32))
    a, b, c = code[:-2], code[1:-1], code[2:]
    two = (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA6B)) >> np.uint32(32 - GRAM_BITS)
    three = (a * np.uint32(0xC2B2AE35) + b * np.uint32(0x27D4EB2F) + c * np.uint32(0x165667B1)) >> np.uint32(32 - GRAM_BITS)
    grams = np.concatenate([two, three + np.uint32(1 << GRAM_BITS)])
    counts = np.concatenate([letter[:-2] | letter[1:-1], letter[1:-1]])
    return grams, counts


def margins(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """Mean log-odds per n-gram of each text for each bit (texts x bits)."""
    total, n = np.zeros((len(texts), weights.shape[1])), np.zeros(len(texts))
    for joined, owner, start in _pieces(texts):
        grams, counts = _grams(joined)
        half = len(joined)
        score = weights[grams[:half]] * counts[:half, None] + weights[grams[half:]] * counts[half:, None]
        np.add.at(total, owner, np.add.reduceat(score, start, axis=0))
        np.add.at(n, owner, np.add.reduceat(counts[:half].astype(np.int64) + counts[half:], start))
    return total / np.maximum(n, 1)[:, None]


# ------------------------------------------------------------------ training
def code_matrix(n: int, seed: int = 7) -> np.ndarray:
    """Codewords (n x bits, +1 and -1): the exhaustive code for up to 7 languages,
    else a seeded random dense code without constant columns."""
    if n < 2:
        return np.ones((n, 0))
    if n <= 7:
        return np.array([[1, *rest] for rest in product([1, -1], repeat=n - 1) if -1 in rest]).T.astype(float)
    rng = np.random.default_rng(seed)
    bits = int(np.ceil(10 * np.log2(n)))
    best, apart = None, -1
    for _ in range(50):
        m = rng.choice([-1.0, 1.0], size=(n, bits))
        d = min(int((m[i] != m[:i]).sum(axis=1).min()) for i in range(1, n))
        if d > apart and (abs(m.sum(axis=0)) < n).all():
            best, apart = m, d
    return best


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for b in batches:
        langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        for lang in set(langs):
            own = [t for k, t in zip(langs, texts) if k == lang]
            into = counts.setdefault(lang, np.zeros(N_FEATURES, dtype=np.int64))
            for joined, _, _ in _pieces(own):
                grams, counted = _grams(joined)
                into += np.bincount(grams[counted], minlength=N_FEATURES)
    for lang, n in counts.items():
        f = np.flatnonzero(n)
        yield pa.record_batch([pa.array([lang] * len(f), pa.string()), pa.array(f.astype(np.int32)), pa.array(n[f])],
                              names=["lang", "feature", "n"])


def sample(docs: DataFrame, may_learn: Column, id_col: str, text_col: str, lang_col: str,
           per_language: int = PER_LANGUAGE) -> DataFrame:
    """About ``per_language`` labelled rows of each language (all of a rare one)."""
    labelled = docs.filter(may_learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    share = F.lit(0.0)
    for r in labelled.groupBy(lang_col).count().collect():  # one row per language
        share = F.when(F.col(lang_col) == r[0], F.lit(per_language / r[1])).otherwise(share)
    spot = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("language sample")), F.lit(1 << 30)) / float(1 << 30)
    return labelled.filter(spot < share).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))


class Model:
    """Languages, their codewords, bit classifiers and decoding weights."""

    def __init__(self, langs: list[str], code: np.ndarray, weights: np.ndarray, trust: np.ndarray, scale: np.ndarray):
        self.langs, self.code, self.weights, self.trust, self.scale = langs, code, weights, trust, scale

    def losses(self, texts: list[str]) -> np.ndarray:
        """Weighted loss of each text against each codeword (texts x languages)."""
        z = np.clip(margins(texts, self.weights) / self.scale, -3, 3)
        return np.stack([(np.exp(-z * self.code[k]) * self.trust[k]).sum(axis=1) for k in range(len(self.langs))], axis=1)

    def decode(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and ambiguity of texts that have letters."""
        if len(self.langs) == 1:
            return [self.langs[0]] * len(texts), np.ones(len(texts)), np.zeros(len(texts), dtype=bool)
        loss = self.losses(texts)
        best = loss.argmin(axis=1)
        ranked = np.sort(loss, axis=1)
        p = np.exp(ranked[:, :1] - loss)
        return [self.langs[k] for k in best], 1 / p.sum(axis=1), ranked[:, 1] - ranked[:, 0] < AMBIGUOUS


def fit(docs: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        per_language: int = PER_LANGUAGE) -> Model | None:
    """Learn from rows where ``may_learn`` holds; None if there is no labelled one."""
    rows = settle(sample(docs, may_learn, id_col, text_col, lang_col, per_language), "language_sample")
    counted = rows.mapInArrow(_count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    got = counted.toPandas()  # languages x 2^15 rows at most
    if got.empty:
        return None
    langs = sorted(got["lang"].unique())
    n = np.zeros((len(langs), N_FEATURES))
    n[np.searchsorted(langs, got["lang"].to_numpy(dtype=str)), got["feature"]] = got["n"]
    p = (n + 0.5) / (n + 0.5).sum(axis=1, keepdims=True)
    code = code_matrix(len(langs))
    weights = np.zeros((N_FEATURES, code.shape[1]), dtype=np.float32)
    for b in range(code.shape[1]):
        weights[:, b] = np.log(p[code[:, b] > 0].mean(axis=0) / p[code[:, b] < 0].mean(axis=0))
    model = Model(langs, code, weights, np.ones(code.shape), np.ones(code.shape[1]))
    if len(langs) < 2:
        return model

    def judge(batches):
        for b in batches:
            own, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            at = [langs.index(x) for x in own]
            signed = margins(texts, weights) * code[at]
            yield pa.record_batch([pa.array(own, pa.string()),
                                   pa.array((signed > 0).astype(np.int64).tolist(), pa.list_(pa.int64())),
                                   pa.array(np.abs(signed).tolist(), pa.list_(pa.float64()))], names=["lang", "right", "size"])
    right = rows.mapInArrow(judge, "lang string, right array<long>, size array<double>") \
        .select("lang", F.posexplode(F.arrays_zip("right", "size"))).groupBy("lang", "pos") \
        .agg(F.avg("col.right").alias("right"), F.avg("col.size").alias("size")).collect()  # languages x bits
    size = np.zeros(code.shape)
    for r in right:
        model.trust[langs.index(r.lang), r.pos], size[langs.index(r.lang), r.pos] = max(r.right, 0.01), r["size"]
    model.trust /= model.trust.sum(axis=1, keepdims=True)
    model.scale = np.maximum(size.mean(axis=0), 1e-6)
    return model


# ---------------------------------------------------------------- prediction
def predict(docs: DataFrame, model: Model | None, keep: list[str], text_col: str = "text", prefix: str = "") -> DataFrame:
    """Columns ``keep`` with ``lang_pred``, ``score`` and ``ambiguous``, these three
    named with ``prefix``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x 2^15 weights at most
    source = docs.select(*keep, *[c for c in [text_col] if c not in keep])
    at_text, n_keep = source.columns.index(text_col), len(keep)
    names = [*keep, *(f"{prefix}{c}" for c in ("lang_pred", "score", "ambiguous"))]
    out = source.select(*keep).schema.add(names[-3], "string").add(names[-2], "double").add(names[-1], "boolean")

    def run(batches):
        known = shared.value
        for b in batches:
            texts = b.column(at_text).to_pylist()
            lang, score, unsure = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
            at = [i for i, t in enumerate(texts) if t is not None and _LETTER.search(t)] if known else []
            if at:
                told, score[at], unsure[at] = known.decode([texts[i] for i in at])
                for i, name in zip(at, told):
                    lang[i] = name
            yield pa.RecordBatch.from_arrays([*b.columns[:n_keep], pa.array(lang, pa.string()), pa.array(score),
                                              pa.array(unsure)], names=names)
    return source.mapInArrow(run, out)


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Documents whose language could be told (no ``und``); columns unchanged. An
    ambiguous text still has a language, so it stays."""
    model = fit(docs, ~held_out(id_col), id_col, text_col, lang_col)
    told = predict(docs, model, docs.columns, text_col, prefix="__told_")
    return told.filter(F.col("__told_lang_pred") != "und").select(*docs.columns)


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out())
    model = fit(docs, ~F.col("held_out"))
    return predict(docs, model, ["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
