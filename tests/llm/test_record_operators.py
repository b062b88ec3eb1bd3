"""Golden records, line removal and vector codes against plain Python, on odd rows and on empty tables."""

import collections
import datetime
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoaccord.llm import golden, linededup, queries, vectorcodes

DAY = datetime.timedelta(days=1)
START = datetime.datetime(2024, 3, 1)
CLIENT = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double, cluster string, part int, id long, kept string, f0 int"


def clients(seed, n=600, clusters=25):
    rng = random.Random(seed)
    some = lambda *values: rng.choice(values)
    rows = []
    for k in range(n):
        at = some(None, START, *(START + DAY * rng.randrange(100) + datetime.timedelta(microseconds=rng.randrange(3)) for _ in range(4)))
        at = START + 60 * DAY + datetime.timedelta(microseconds=rng.choice((-1, 0, 1))) if rng.random() < 0.05 else at
        master = some(None, 7, 7, rng.randrange(clusters), rng.randrange(clusters))
        client = None if rng.random() < 0.02 else rng.randrange(n) if rng.random() < 0.1 else k + 1000
        name = some(None, "", " \t", "Ann", "Bob ", "漢字漢字", "Éva é", "a" * rng.randrange(6), "x" * 5)
        balance = some(None, float("nan"), float("inf"), 0.5, -0.005, round(rng.uniform(-9, 9), 3))
        rows.append((client, master, some("crm", "web", "store", "partner", "other", None), at, name, some(None, "\x0b", "a@b", "c@d", "e@f"), some(None, "", "Rome", "Oslo"), some(None, 1, 2), some(None, " ", "s", "t", "u"), balance, "c", 1, 2, "k", 3))
    return rows + rows[:20]


def best_records(rows):
    """Plain Python: every field by sorting all records of a cluster."""
    blank = lambda s: None if s is None or not re.search(r"[^\x20\x09-\x0D]", s) else s
    by = collections.defaultdict(list)
    for client, master, source, at, name, email, city, nation, segment, balance, *_ in rows:
        r = {"id": client, "trust": {"crm": 4, "web": 3, "store": 2, "partner": 1}.get(source, 0), "at": at, "name": blank(name), "email": blank(email), "city": blank(city), "nation": nation, "segment": blank(segment)}
        by[client if master is None else master].append(r | {"balance": None if balance is None or not math.isfinite(balance) else balance})
    out = set()
    for cluster, records in by.items():
        latest = max((r["at"] for r in records if r["at"]), default=None)
        for r in records:
            r["fresh"] = r["at"] is not None and latest - r["at"] <= 60 * DAY
        low = lambda x: (x is None, x if x is not None else 0)
        text = lambda x: (x is None, x or "")
        recent = lambda r: (r["at"] is None, -(r["at"] - START) / datetime.timedelta(microseconds=1) if r["at"] else 0, -r["trust"], low(r["id"]), text(r["segment"]), text(r["email"]), text(r["name"]), low(r["balance"]), text(r["city"]), low(r["nation"]))
        trusted = lambda r: (not r["fresh"], -r["trust"], recent(r))
        pick = lambda field, order: min((r for r in records if r[field] is not None), key=order, default={"id": None, field: None})
        segment, email, name = pick("segment", recent), pick("email", trusted), pick("name", lambda r: (-len(r["name"]), trusted(r)))
        balance = pick("balance", lambda r: (segment["segment"] is None or r["segment"] != segment["segment"], recent(r)))
        filled = lambda r: (r["city"] is not None) + (r["nation"] is not None)
        address = min(records, key=lambda r: (-filled(r), trusted(r)))
        cents = None if balance["balance"] is None else math.floor(100 * balance["balance"] + 0.5)
        out.add((cluster, len(records), sum(not r["fresh"] for r in records), name["name"], email["email"], segment["segment"], address["city"], address["nation"], cents, name["id"], email["id"], segment["id"], balance["id"], address["id"] if filled(address) else None))
    return out


@pytest.mark.parametrize("seed,fan_in,buffer", [(1, 64, 100_000), (2, 2, 100_000), (3, 2, 7)])
def test_golden_records(spark, monkeypatch, tmp_path, seed, fan_in, buffer):
    """Rows dealt over many partitions, with one level of pruning, with several, and with buffers of a few rows."""
    monkeypatch.setattr(golden, "FAN_IN", fan_in)
    original = golden._pruned

    def small(batches, rules):  # the worker has a module of its own
        golden.BUFFER = buffer
        return original((b.slice(k, 5) for b in batches for k in range(0, b.num_rows, 5)), rules)

    monkeypatch.setattr(golden, "_pruned", small)
    rows = clients(seed)
    spark.createDataFrame(rows, CLIENT).repartition(9).write.parquet(f"{tmp_path}/clients.parquet")
    found = queries.op11_golden_records(spark, str(tmp_path)).collect()
    assert len(found) == len({tuple(r) for r in found}) and {tuple(r) for r in found} == best_records(rows)


def test_golden_survivors_are_bounded(spark):
    """A cluster of very many rows leaves a few survivors a partition, and its counts stay whole."""
    rows = [(k, 7, ("crm", "web")[k % 2], START + DAY * (k % 90), "n", "e", "c", 1, ("s", "t")[k % 2], 1.0, "c", 1, 2, "k", 3) for k in range(8000)]
    rules = golden.Rules()
    records = golden._records(spark.createDataFrame(rows, CLIENT).repartition(4), F.col("master_id"), rules, "client_id", "source", "updated_at")
    kept = golden.survivors(records, rules)
    assert kept.where("kept").count() <= 4 * 12 and kept.agg(F.sum("n")).first()[0] == 8000
    assert kept.agg(F.sum("n_stale") + F.sum("n_open")).first()[0] == 8000 and kept.count() <= 4 * 61 + 48


def test_golden_empty(spark):
    assert golden.golden(spark.createDataFrame([], CLIENT), F.coalesce("master_id", "client_id")).count() == 0


# -- lines ------------------------------------------------------------------------------------------------------------


def without_shared(rows, min_docs=10, min_chars=1):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    held = collections.Counter(k for _, text in rows for k in {key(line) for line in (text or "").split("\n")} if len(k) >= min_chars)
    gone = {k for k, n in held.items() if n >= min_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        left = [line for line in lines if key(line) not in gone]
        out.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=str)


def line_docs():
    rng = random.Random(3)
    shared = ["Subscribe NOW", "é漢字 　", " all rights reserved\t", "ÀB", "x"]
    rows = [(k, "\n".join(rng.choice([*shared, rng.choice(shared).upper(), f" {rng.choice(shared)}\x0b", "", " ", f"line {rng.randrange(40)}", f"own {k}"]) for _ in range(rng.randrange(1, 12)))) for k in range(60)]
    return [*rows, *rows[:6], (None, None), (None, "Subscribe now"), (5, ""), (6, "\n\n"), (7, "a\r\nb\r\n"), (8, "Subscribe now\n" * 9), (9, "\n".join(f"long {k % 700}" for k in range(20_000))), (9, None)]


def test_lines(spark):
    rows = line_docs()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for limits in ({}, {"min_docs": 3}, {"min_docs": 2, "min_chars": 4}):
        found = linededup.remove(docs, **limits).select("doc_id", "lines.n_lines", "lines.n_dropped", "lines.text")
        assert sorted(map(tuple, found.collect()), key=str) == without_shared(rows, **limits)


def test_lines_columns(spark, odd_docs, no_docs):
    named = odd_docs.select("*", *(F.lit(k).alias(c) for k, c in enumerate(("k", "l", "at", "h", "a", "b", "gone", "row", "lines"))))
    out = linededup.remove(named, min_docs=2)
    assert out.columns == [*named.columns, "lines_"] and out.count() == named.count()
    expected = without_shared([(r["doc_id"], r["text"]) for r in odd_docs.collect()], 2)
    assert sorted(map(tuple, out.select("doc_id", "lines_.n_lines", "lines_.n_dropped", "lines_.text").collect()), key=str) == expected
    assert linededup.remove(no_docs).count() == 0


# -- vector codes -----------------------------------------------------------------------------------------------------


def coded(rows, parts=4, entries=256, rounds=4):
    """Plain Python and full searches."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    rows = [r for r in rows if len(r[1]) == len(rows[0][1])]
    whole = [[math.floor(1024 * x) for x in r[1]] for r in rows]
    width = len(whole[0]) // parts
    piece = lambda v, k: v[k * width : (k + 1) * width]
    books = [[piece(v, k) for v in whole[:entries]] for k in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, k: min((far(piece(v, k), e), j) for j, e in enumerate(books[k]))
    for _ in range(rounds):
        held = [collections.defaultdict(list) for _ in range(parts)]
        for v in whole:
            for k in range(parts):
                held[k][near(v, k)[1]].append(piece(v, k))
        for k in range(parts):
            for j, own in held[k].items():
                books[k][j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = [[near(v, k) for k in range(parts)] for v in whole]
    errors = collections.Counter()
    for r, f in zip(rows, found, strict=True):
        errors[r[2]] += sum(d for d, _ in f)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{j:02x}" for _, j in f), sum(d for d, _ in f), errors[r[2]], digest) for r, f in zip(rows, found, strict=True)), key=str)


def vectors(seed, n, width, scale=1.0):
    rng = random.Random(seed)
    make = lambda: [round(rng.gauss(0, scale), rng.choice((1, 6))) for _ in range(width)]
    rows = [(k, make(), rng.choice((None, 0, 1, 1))) for k in range(n)]
    rows += [(n, None, 1), (n + 1, [None] * width, 2), (n + 2, [float("nan")] * width, 2), (-1, [float("-inf")] * width, None), (n + 3, [], 1), (n + 4, [1.0], 1), (None, make(), 1)]
    return rows + [rows[3], rows[3], (5, make(), 0), (n + 5, rows[3][1], None), (n + 6, [0.0] * width, 1)]


@pytest.mark.parametrize("n,width,entries,scale", [(90, 8, 16, 1.0), (60, 4, 256, 3.0), (120, 12, 32, 100_000.0)])
def test_vector_codes(spark, n, width, entries, scale):
    rows = vectors(n, n, width, scale)
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("vector", F.lit("x")).withColumn("id", F.lit(1)).repartition(5)
    found = vectorcodes.compress(docs, entries=entries)
    assert sorted(map(tuple, found.select("id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str) == coded(rows, entries=entries)


def test_vector_codes_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vectorcodes.compress(spark.createDataFrame([], schema)).count() == 0
    assert vectorcodes.compress(spark.createDataFrame([(1, None, 1)], schema)).count() == 0
    with pytest.raises(ValueError, match="divide"):
        vectorcodes.compress(spark.createDataFrame([(1, [1.0] * 6, 1)], schema))


def test_annulus_gives_the_full_search():
    """Ties, entries that repeat, zero vectors and norms that all lie together."""
    rng = np.random.default_rng(5)
    for low, high, k in ((-3, 4, 40), (-1000, 1000, 256), (0, 1, 8), (5, 6, 3), (-2, 2, 1)):
        entries, parts = rng.integers(low, high, (k, 4)), rng.integers(low, high, (500, 4))
        apart = ((parts[:, None] - entries[None]) ** 2).sum(2)
        code, error, pairs = vectorcodes.nearest(parts, entries)
        assert (code == apart.argmin(1)).all() and (error == apart.min(1)).all() and pairs <= 500 * k
    spread, near = np.arange(256)[:, None] * 1000 + np.zeros((1, 4), int), rng.integers(0, 255_000, (500, 1)) + np.zeros((1, 4), int)
    assert vectorcodes.nearest(near, spread)[2] < 500 * 8
