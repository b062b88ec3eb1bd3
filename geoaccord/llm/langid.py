"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed 1- to 4-grams of the lower-cased text give a matrix of log-probabilities, which is broadcast
(2 ** bits x languages floats, whatever the corpus). Batches of texts are scored in numpy as the product of their sparse
counts and the matrix.

Cases: a null text, or one without a letter, is ``und`` with score 0; ties go to the first language by name; repeated
rows get equal results; with no labelled row every text is ``und``; other columns are kept, but one named as the result is replaced
(:func:`predict`).
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, mix64, session, worker_state

BITS = 16
ORDERS = (1, 2, 3, 4)
#: Labelled documents a language that the model is fitted on, in the mean (chosen by a hash of the id).
TRAIN_DOCS = 4000
MAX_LANGUAGES = 500
#: N-grams of one order that are hashed at once, and numbers of the matrix that are gathered at once.
SLICE, GATHERED = 1 << 19, 1 << 20
UND = "und"


def _grams(codes: np.ndarray, bits: int, orders) -> list[np.ndarray]:
    """For each order, the bucket of the n-gram that starts at each of the first SLICE code points."""
    out, h = [], np.zeros(len(codes), np.uint64)
    for n in range(1, max(orders) + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        with np.errstate(over="ignore"):
            h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(n)
        if n in orders:
            out.append((mix64(h[:SLICE]) >> np.uint64(64 - bits)).astype(np.int32))
    return out


def _slices(texts: list[str | None], pad: int):
    """(index, code points) with a space on either side of a text, long texts in slices of SLICE n-gram starts, each with
    the ``pad - 1`` code points behind it that its last n-grams need."""
    for i, text in enumerate(texts):
        if not text:
            continue
        codes = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        for at in range(0, len(codes), SLICE):
            yield i, codes[at : at + SLICE + pad - 1]


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", train_docs: int = TRAIN_DOCS, bits: int = BITS, orders=ORDERS) -> dict:
    """Fit on at most about ``train_docs`` labelled rows a language; returns {langs, logp (buckets x langs), prior}."""
    session(labelled.sparkSession)
    known = labelled.where(F.col(lang_col).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(lang_col).count().orderBy(lang_col).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"{lang_col} has over {MAX_LANGUAGES} values")
    langs, size = sorted(sizes), 1 << bits
    if not langs:
        return {"langs": [], "logp": np.zeros((size, 0), np.float32), "prior": np.zeros(0), "bits": bits, "orders": tuple(orders)}
    share = F.lit(1.0)
    for lang in langs:
        share = F.when(F.col(lang_col) == lang, F.lit(min(1.0, train_docs / sizes[lang]))).otherwise(share)
    chosen = known.where(F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("langid")), F.lit(1 << 30)) < share * (1 << 30))

    def count(batches):
        totals = {}
        for batch in batches:
            for lang, group in batch.groupby("lang"):
                sums = totals.setdefault(lang, np.zeros(size, np.int64))
                for _, codes in _slices(group["text"].tolist(), max(orders)):
                    for buckets in _grams(codes, bits, orders):
                        sums += np.bincount(buckets, minlength=size)
        for lang, sums in totals.items():
            at = np.flatnonzero(sums)
            yield pd.DataFrame({"lang": lang, "bucket": at.astype(np.int32), "n": sums[at]})

    counted = chosen.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInPandas(count, "lang string, bucket int, n long")
    got = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most 2 ** bits x languages rows
    table = np.zeros((size, len(langs)))
    table[got["bucket"].to_numpy(np.int64), np.searchsorted(langs, got["lang"].to_numpy(str)) if len(got) else []] = got["n"].to_numpy(float)
    logp = np.log((table + 0.1) / (table.sum(axis=0) + 0.1 * size))
    share_of = np.array([sizes[x] for x in langs], float)

    return {"langs": langs, "logp": np.ascontiguousarray(logp.astype(np.float32)), "prior": np.log(share_of / share_of.sum()), "bits": bits, "orders": tuple(orders)}


def score_texts(texts: list[str | None], has_letter, model: dict) -> tuple[list[str], np.ndarray]:
    """Predicted language and its posterior probability for each text."""
    langs, logp = model["langs"], model["logp"]
    total = np.tile(model["prior"], (len(texts), 1))
    rows, held, n = [], [], 0

    def add() -> None:
        """The product of the sparse counts of what is held (a row of buckets each) and the matrix."""
        if held:
            starts = np.cumsum([0, *(len(h) for h in held[:-1])])
            np.add.at(total, rows, np.add.reduceat(logp[np.concatenate(held)], starts, axis=0, dtype=np.float64))
            rows.clear()
            held.clear()

    for i, codes in _slices(texts, max(model["orders"])) if langs else ():
        for buckets in _grams(codes, model["bits"], model["orders"]):
            if len(buckets) > len(logp):
                total[i] += np.bincount(buckets, minlength=len(logp)) @ logp.astype(np.float64)
            elif len(buckets):
                rows.append(i)
                held.append(buckets)
                n += len(buckets)
        if n * len(langs) >= GATHERED:
            add()
            n = 0
    add()
    named, score = [UND] * len(texts), np.zeros(len(texts))
    if langs and len(texts):
        best = total.argmax(axis=1)
        sure = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        for i, ok in enumerate(has_letter):
            if ok:
                named[i], score[i] = langs[best[i]], sure[i]
    return named, score


def predict(docs: DataFrame, model: dict, text_col: str = "text", out_col: str = "language") -> DataFrame:
    """``docs`` with a struct column ``out_col`` (lang_pred, score)."""
    spark = session(docs.sparkSession)
    shared = Shared(spark, pickle.dumps(model))

    @F.pandas_udf("lang_pred string, score double")
    def classify(text: pd.Series, letter: pd.Series) -> pd.DataFrame:
        fitted = worker_state("langid", shared.key, lambda: pickle.loads(shared.value))
        named, score = score_texts(text.where(text.notna(), None).tolist(), letter.tolist(), fitted)
        return pd.DataFrame({"lang_pred": named, "score": score})

    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    return docs.withColumn(out_col, classify(F.col(text_col), letter))
