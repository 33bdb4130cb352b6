"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts are taken over all labelled texts, task by task in numpy, and summed in Spark. The matrix of log probabilities, languages by BUCKETS, is
broadcast: its size depends on neither rows nor texts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

BUCKETS, ALPHA = 1 << 14, 0.5
#: Languages at most; more are an error, as the matrix would not be small.
LANGUAGES = 512
#: Characters handled at once; a longer text is handled alone, in pieces.
PIECE = 1 << 18
_fold: list[np.ndarray] = []


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its lower case, or a space if it is no letter; and whether it is a letter."""
    if not _fold:
        letter = np.zeros(0x110000, bool)
        to = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                letter[c] = True
                lo = ch.lower()
                to[c] = ord(lo) if len(lo) == 1 else c
        _fold.extend([to, letter])
    return _fold[0], _fold[1]


def _pieces(texts):
    """(text numbers, code points, text of each code point) in runs of about PIECE characters; a text longer than that comes in pieces
    that overlap by two characters, so that each n-gram of one to three characters is seen (the first two characters of a later piece are marked by -1)."""
    ids, got, size = [], [], 0

    def run():
        s = "".join(got)
        cps = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
        return ids, cps, np.repeat(np.arange(len(ids)), [len(x) for x in got])

    for i, t in enumerate(texts):
        if not t:
            continue
        if len(t) > PIECE:
            if got:
                yield (*run(), 0)
                ids, got, size = [], [], 0
            for lo in range(0, len(t), PIECE):
                back = 2 if lo else 0
                ids, got = [i], [t[lo - back : lo + PIECE]]
                yield (*run(), back)
            ids, got = [], []
            continue
        if size + len(t) > PIECE and got:
            yield (*run(), 0)
            ids, got, size = [], [], 0
        ids.append(i)
        got.append(t)
        size += len(t)
    if got:
        yield (*run(), 0)


def _features(cps: np.ndarray, of: np.ndarray, back: int):
    """(bucket, text) arrays for n-grams of one, two and three characters; `back`: characters at the front that an earlier piece had."""
    to, _ = _tables()
    c = to[cps].astype(np.uint64)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    h = c + np.uint64(1)
    for n in (1, 2, 3):
        if n > 1:
            h = h[:-1] * np.uint64(0x100000001B3) + c[n - 1 :]
        if not len(h):
            return
        at = of[: len(h)]
        ok = at == of[n - 1 :]
        if back:
            ok[: max(0, back - n + 1)] = False
        b = ((h * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)
        # runs of spaces say nothing
        ok &= ~((c[: len(h)] == 32) & (c[n - 1 :] == 32)) if n < 3 else ok
        yield b[ok], at[ok]


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities [languages, BUCKETS + 1]; the last column is the log prior) from all rows with text and lang."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").cast("string").alias("l")).filter("t is not null and l is not null")

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for pdf in batches:
            names, code = np.unique(pdf["l"].to_numpy(dtype=object), return_inverse=True)
            sums = np.zeros((len(names), BUCKETS + 1))
            sums[:, BUCKETS] = np.bincount(code, minlength=len(names))
            for ids, cps, of, back in _pieces(pdf["t"]):
                lang_of = code[np.array(ids)]
                for b, at in _features(cps, of, back):
                    sums[:, :BUCKETS] += np.bincount(lang_of[at] * BUCKETS + b, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
            for k, x in enumerate(names):
                total[x] = total[x] + sums[k] if x in total else sums[k]
        for x, s in total.items():
            at = np.flatnonzero(s)
            yield pd.DataFrame({"l": x, "b": at, "n": s[at].astype(np.int64)})

    if rows.select("l").distinct().limit(LANGUAGES + 1).count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    found = rows.mapInPandas(count, "l string, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).toPandas()  # languages x buckets
    langs = sorted(found["l"].unique())
    m = np.zeros((len(langs), BUCKETS + 1))
    m[found["l"].map({x: i for i, x in enumerate(langs)}).to_numpy(dtype=int), found["b"].to_numpy(dtype=int)] = found["n"]
    out = np.empty_like(m)
    body = m[:, :BUCKETS] + ALPHA
    out[:, :BUCKETS] = np.log(body / body.sum(1, keepdims=True)) if len(langs) else 0
    out[:, BUCKETS] = np.log(m[:, BUCKETS] / max(1, m[:, BUCKETS].sum()))
    return langs, out


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """docs with lang_pred and score (replacing columns of these names).

    score: the language's posterior probability. A text that is null, empty or without a letter gets `und` and 0, as does each text if there was
    nothing to learn from. Whole texts count, in bounded pieces. Ties go to the first language by name.
    """
    langs, table = model
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast((langs, table))
    cols = [c for c in docs.columns if c not in ("lang_pred", "score")]

    @F.pandas_udf("lang string, score double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        names, logs = held.value
        ll = np.zeros((len(texts), len(names)))
        letters = np.zeros(len(texts), bool)
        _, is_letter = _tables()
        for ids, cps, of, back in _pieces(texts):
            ids = np.array(ids)
            np.logical_or.at(letters, ids[np.unique(of[is_letter[cps]])], True)
            for b, at in _features(cps, of, back):
                if len(b):
                    edge = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                    for k in range(len(names)):
                        ll[ids[at[edge]], k] += np.add.reduceat(logs[k][b], edge)
        if not names:
            return pd.DataFrame({"lang": "und", "score": np.zeros(len(texts))})
        ll += logs[:, BUCKETS]
        best = ll.argmax(1)
        score = 1 / np.exp(ll - ll.max(1, keepdims=True)).sum(1)
        return pd.DataFrame({"lang": np.where(letters, np.array(names, object)[best], "und"), "score": np.where(letters, score, 0.0)})

    return docs.withColumn("__j", judge(F.col(f"`{text}`"))).select(*[F.col(f"`{c}`") for c in cols], F.col("__j.lang").alias("lang_pred"), F.col("__j.score").alias("score"))


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", folds: int = 5) -> DataFrame:
    """docs with held_out, lang_pred and score; learned from rows whose crc32 of the key's text is not divisible by `folds`."""
    fold = F.coalesce(F.crc32(F.col(f"`{key}`").cast("string")) % folds, F.lit(0))
    return predict(docs.withColumn("held_out", fold == 0), fit(docs.filter(fold != 0), text, lang), text)
