"""Operator 10: language identification by error-correcting output codes.

Each language has a codeword of bits; for every bit a binary classifier over hashed character
n-grams (1 to 3, inside words and across their edges) tells which half of the languages a text
belongs to.  A text goes to the language with the smallest loss-weighted distance between the
classifiers' margins and its codeword; if the runner-up is close, the answer is flagged.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 12
CHUNK = 1 << 18
#: Labelled rows taken for each language, and of all languages, by hash order; the fit's work and memory are bounded by them.
SAMPLE_PER_LANGUAGE = 600
SAMPLE_ROWS = 12_000
#: Texts whose features are held at a time, 16 KB each.
GROUP = 256
UNDETERMINED = "und"
M1, M2, M3 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def features(text: str) -> np.ndarray | None:
    """Square roots of n-gram counts with length 1; None if the text has no letter."""
    counts = np.zeros(BUCKETS)
    letters = letter_table()
    seen = False
    for lo in range(0, len(text), CHUNK):
        codes = np.frombuffer(text[max(0, lo - 2) : lo + CHUNK].lower().encode("utf-32-le", "replace"), np.uint32)
        inside = letters[codes]
        if not inside.any():
            continue
        seen = True
        x = np.empty(len(codes) + 2, np.uint32)
        x[0] = x[-1] = 32
        x[1:-1] = np.where(inside, codes, 32)
        keep = np.ones(len(x), bool)
        keep[1:] = (x[1:] != 32) | (x[:-1] != 32)
        x = x[keep]
        one, two = x * M1, x[:-1] * M2 + x[1:] * M1
        three = x[:-2] * M3 + x[1:-1] * M2 + x[2:] * M1
        for salt, gram in ((np.uint32(1), one[x != 32]), (np.uint32(2), two), (np.uint32(3), three)):
            h = gram + np.uint32(int(salt) * int(M3) & 0xFFFFFFFF)
            h = (h ^ (h >> np.uint32(15))) * M2
            h ^= h >> np.uint32(13)
            counts += np.bincount((h % np.uint32(BUCKETS)).astype(np.int64), minlength=BUCKETS)
    if not seen:
        return None
    root = np.sqrt(counts)
    return (root / np.linalg.norm(root)).astype(np.float32)


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """n codewords of +1 and -1 as rows.  Up to 6 languages: every split of them is a bit;
    more: the random code with the largest least distance of 200 drawn."""
    if n <= 6:
        splits = [[1 if (mask >> i) & 1 else -1 for i in range(n)] for mask in range(1, 1 << (n - 1))]
        return np.array(splits, np.float32).T.reshape(n, -1)
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    best, most = None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, bits)).astype(np.float32)
        apart = (bits - (code @ code.T)[~np.eye(n, dtype=bool)]).min() / 2
        if apart > most and (np.abs(code.sum(axis=0)) < n).all():
            best, most = code, apart
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    strength: np.ndarray  # of each bit: how well it did on the sample
    ambiguous_under: float = 0.6

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages and scores of rows of features."""
        if len(self.languages) == 1:
            return self.languages * len(x), np.ones(len(x))
        margins = x @ self.weights + self.bias
        losses = np.log1p(np.exp(-margins[:, None, :] * self.code[None])) @ self.strength
        share = np.exp(losses.min(axis=1, keepdims=True) - losses)
        share /= share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        return [self.languages[i] for i in best], share[np.arange(len(x)), best]


def fit(x: np.ndarray, labels: list[str], steps: int = 150, rate: float = 40.0, decay: float = 1e-5) -> LanguageModel:
    """Logistic regression for each bit by gradient descent with momentum; no randomness."""
    languages = sorted(set(labels))
    if len(languages) < 2:
        return LanguageModel(languages, np.zeros((len(languages), 0)), np.zeros((BUCKETS, 0)), np.zeros(0), np.zeros(0))
    code = codewords(len(languages))
    at = np.array([languages.index(n) for n in labels])
    share = (1.0 / np.bincount(at, minlength=len(languages)))[at].astype(np.float32)
    share /= share.sum()
    y = code[at]
    w, b = np.zeros((BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        pull = share[:, None] * y / (1 + np.exp(y * (x @ w + b)))
        vw = 0.9 * vw + rate * (x.T @ pull - decay * w)
        vb = 0.9 * vb + 0.1 * rate * pull.sum(axis=0)
        w, b = w + vw, b + vb
    right = (share[:, None] * (y * (x @ w + b) > 0)).sum(axis=0).clip(0.5, 0.9999)
    strength = np.log(right / (1 - right))
    return LanguageModel(languages, code, w, b, strength / strength.max())


def _feature_rows(df: DataFrame) -> list:
    """Labels, places and features of the given rows (``label, h, text``); one row of BUCKETS numbers for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, GROUP):
                found = [(label, h, features(t or "")) for label, h, t in zip(*(c.to_pylist() for c in b.slice(lo, GROUP).columns), strict=True)]
                rows = [(label, h, f.astype(np.float16).tobytes()) for label, h, f in found if f is not None]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["label", "h", "x"])

    return df.mapInArrow(run, "label string, h long, x binary").collect()


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3


def train(df: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, most_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> LanguageModel:
    """Fits on about ``per_language`` rows of each label, and on ``most_rows`` of all labels together: those of the smallest
    hashes of id and text.  Rows without label, and texts without letters, teach nothing; repeated rows teach once.  More than
    ``most_rows`` labels raise.

    No label's rows meet in one task: a count of each label gives the share of its rows to take, and the
    rows under that share of the hashes pass a filter; only they (a quarter more than asked for, so that few labels
    fall short) are grouped, and the surplus goes on the driver."""
    known = df.where(F.col(label_col).isNotNull()).select(F.col(label_col).cast("string").alias("label"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string")).alias("h"), F.col(text_col).cast("string").alias("text"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().limit(most_rows + 1).collect()}
    if len(counts) > most_rows:
        raise ValueError(f"more than {most_rows} labels")
    each = min(per_language, most_rows // max(1, len(counts)))
    sample = 1.25 * each + 20
    limits = {label: round(min(1.0, sample / n) * 2**63) for label, n in counts.items()}
    cut = F.create_map(*[F.lit(x) for label, n in limits.items() for x in (label, min(n, 2**63 - 1))]) if limits else F.lit(None).cast("map<string,bigint>")
    picked = known.where(F.col("h").bitwiseAND(F.lit(2**63 - 1)) <= F.try_element_at(cut, F.col("label")))
    picked = picked.groupBy("label", "h").agg(F.min("text").alias("text"))
    found, taken = [], {}
    for r in sorted(_feature_rows(picked), key=lambda r: (r["label"], r["h"] & (2**63 - 1), zlib.crc32(r["x"]))):
        taken[r["label"]] = taken.get(r["label"], 0) + 1
        if taken[r["label"]] <= each:
            found.append(r)
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in found]).astype(np.float32) if found else np.zeros((0, BUCKETS), np.float32)
    return fit(x, [r["label"] for r in found])


def _answers(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
    found = [(i, f) for i, t in enumerate(texts) if t and model.languages and (f := features(t)) is not None]
    names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    if found:
        got, sure = model.predict(np.stack([f for _, f in found]))
        for (i, _), name, s in zip(found, got, sure, strict=True):
            names[i], scores[i] = name, float(s)
    return names, scores, [s < model.ambiguous_under for s in scores]


def identify(df: DataFrame, model: LanguageModel, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``df`` with ``lang_pred string, score double, ambiguous boolean`` (names take ``prefix``;
    columns of these names are replaced).  Text that is null, empty or without letters is
    ``und`` with score 0; so is everything if nothing was learned.  Rows are neither dropped nor merged."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, ambiguous boolean")
    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            parts = [_answers(shared.value, [t if isinstance(t, str) else None for t in texts.iloc[lo : lo + GROUP]]) for lo in range(0, len(texts), GROUP)]
            yield pd.DataFrame({name: [x for p in parts for x in p[k]] for k, name in enumerate(("lang", "score", "ambiguous"))})

    spare = "__lang"
    while spare in df.columns:
        spare += "_"
    found = df.withColumn(spare, answer(F.col(f"`{text_col}`").cast("string")))
    return found.withColumns({f"{prefix}lang_pred": F.col(f"{spare}.lang"), f"{prefix}score": F.col(f"{spare}.score"), f"{prefix}ambiguous": F.col(f"{spare}.ambiguous")}).drop(spare)
