"""The pipeline against its stages in plain Python, and on odd tables."""

import hashlib
import random
import sys

import corpus_pipeline
import numpy as np
import public_tokenizers

from geoaccord.llm import decontaminate, langid, substring
from geoaccord.llm.common import table
from geoaccord.llm.queries import learned_rows

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from test_llm_operators import RANKS, WORD, components_of, dense_language, word_spans  # noqa: E402


def least_distance(pattern, text):
    """Least edits between a pattern and a part of a text, a row of the table at a time (Sellers 1980)."""
    codes = np.array([ord(c) for c in text])
    row, at = np.zeros(len(text) + 1, int), np.arange(len(text) + 1)
    for k, c in enumerate(pattern, 1):
        new = np.concatenate([[k], np.minimum(row[1:] + 1, row[:-1] + (codes != ord(c)))])
        row = np.minimum.accumulate(new - at) + at
    return row.min()


def expected(docs, items, model):
    """Ids and texts after the stages, each in plain Python."""
    docs = [(i, t) for i, t in docs if t and any(c.isalpha() for c in t) and dense_language(t, model)[1] >= 0.5]
    groups = components_of(docs)
    docs = [(i, t) for i, t in docs if groups[i][1] == i]
    cut = word_spans(docs)
    docs = [(i, substring.cut_spans(t, *zip(*cut[i, t])) if (i, t) in cut else t) for i, t in docs]
    docs = [(i, t) for i, t in docs if WORD.search(t)]
    def near(text, item):
        text, edits = " ".join(text.lower().split()), len(item) * 8 // 100
        return least_distance(item, text) <= edits if edits else f" {item} " in f" {text} "

    return [(i, t) for i, t in docs if not any(near(t, item) for _, item in items)]


def test_run(spark, sf):
    """The pipeline on some hundred documents against the stages by brute force and a public tokenizer."""
    import base64

    import tiktoken

    source = table(spark, sf, "documents")
    docs = [(r["doc_id"], r["text"]) for r in source.collect()]
    items = [(r["item_id"], decontaminate.normal(r["text"])) for r in table(spark, sf, "benchmark").collect()]
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    encoding, want = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), {}
    for i, t in expected(docs, items, langid.fit(source.where(learned_rows()))):
        ids = encoding.encode_ordinary(t)
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want and 0 < len(got) < len(docs)


def test_repeated_ids(spark, sf):
    """Different texts of one id stay, copies of them go."""
    rng = random.Random(6)
    text = lambda: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * 3 + str(rng.randrange(99)) for _ in range(60))
    one, two, three = text(), text(), text()
    rows = [(0, one), (1, one), (1, two), (1, two), (2, three), (None, one), (3, two + " more"), (None, None)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, row_number_of string")
    got = corpus_pipeline.near_duplicates(spark, docs, sf)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(0, one), (1, two), (2, three), (None, one), (None, None)], key=str)


def test_stages_on_odd_tables(spark, sf, odd_docs, no_docs):
    for start in (odd_docs, no_docs):
        docs = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == start.columns and out.dtypes == start.dtypes, name
            docs = spark.createDataFrame(out.collect(), start.schema)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()
    assert len(corpus_pipeline.STAGES) == 5 and np.all([callable(f) for _, f in corpus_pipeline.STAGES])
