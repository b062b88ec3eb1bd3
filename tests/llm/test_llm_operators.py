"""The training-data operators against brute force, on odd rows and on empty tables."""

import base64
import collections
import gzip
import hashlib
import itertools
import math
import pathlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from geoaccord.llm import bpe, components, decontaminate, jaccard, langid, quality, queries, sharding, shingles, substring, tokenfiles, warc, wordpiece
from geoaccord.llm.common import scratch_path, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
KEY = lambda row: tuple((v is None, str(v)) for v in row)


def texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


# -- quality rules --------------------------------------------------------------------------------------------------


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = collections.defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i : i + 3])].append(i)
    marked = {p for at in windows.values() if len(at) > 1 for i in at for p in (i, i + 1, i + 2)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(marked) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(marked), failed


@pytest.mark.parametrize("source", ["odd", "documents"])
def test_quality_base(spark, sf, odd_docs, source):
    docs = odd_docs if source == "odd" else table(spark, sf, "documents")
    got = quality.score(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    want = [(i, *base_counts(t)) for i, t in texts(docs)]
    assert sorted((tuple(r)[:7] for r in got), key=KEY) == sorted(want, key=KEY)
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_quality_em(spark):
    """The fitted model is that of the same rounds in plain Python."""
    rng, rows = random.Random(1), collections.Counter()
    for _ in range(4000):
        good = rng.random() < 0.7
        rows[tuple(0 if rng.random() < 0.2 else (1 if good else -1) * (1 if rng.random() < a else -1) for a in (0.9, 0.8, 0.6))] += 1
    frame = spark.createDataFrame([(list(v), n) for v, n in rows.items()], "votes array<int>, n long")
    got = {tuple(r["votes"]): r for r in quality.posteriors(frame, 3).collect()}
    pi, good, bad = quality.START["pi"], [quality.START["good"]] * 3, [quality.START["bad"]] * 3
    post = lambda v: 1 / (1 + math.exp(-(math.log(pi / (1 - pi)) + sum(math.log(good[j][x + 1] / bad[j][x + 1]) for j, x in enumerate(v)))))
    for _ in range(quality.EM_ROUNDS):
        q = {v: post(v) for v in rows}
        k = quality.ANCHOR
        fit = lambda w, s: [[((sum(w(v) for v in rows if v[j] == x) + 1) / (sum(w(v) for v in rows) + 3) + k * s[x + 1]) / (1 + k) for x in (-1, 0, 1)] for j in range(3)]
        pi = (sum(n * q[v] for v, n in rows.items()) + 1) / (sum(rows.values()) + 2)
        good, bad = fit(lambda v: rows[v] * q[v], quality.START["good"]), fit(lambda v: rows[v] * (1 - q[v]), quality.START["bad"])
    for v in rows:
        assert got[v]["posterior"] == pytest.approx(post(v), abs=1e-9)
    right = [pi * good[j][2] + (1 - pi) * bad[j][0] for j in range(3)]
    acc = [right[j] / (right[j] + pi * good[j][0] + (1 - pi) * bad[j][2]) for j in range(3)]
    assert got[(1, 1, 1)]["rule_accuracy"] == pytest.approx(acc, abs=1e-9)
    assert min(acc) == acc[2] > 0.5


def test_quality_empty(no_docs):
    assert quality.score(no_docs).count() == 0


# -- sharding -------------------------------------------------------------------------------------------------------


def test_sharding(spark, sf, odd_docs):
    def place(key, weights):
        u = [(int(hashlib.md5(f"{key}:{k}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for k in range(len(weights))]
        return max(range(len(weights)), key=lambda k: weights[k] / -math.log(u[k]))

    for docs in (odd_docs, table(spark, sf, "documents")):
        rows = sharding.shard(docs, [1.0] * 8).collect()
        assert len(rows) == docs.count()
        want = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts(docs)]
        assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=KEY) == sorted(want, key=KEY)
        slots = collections.defaultdict(list)
        for r in rows:
            key = "" if r["doc_id"] is None else r["doc_id"]
            assert r["shard"] == place(key, [1.0] * 8) and r["grown_shard"] in (r["shard"], 8) and r["grown_shard"] == place(key, [1.0] * 9)
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_weights(spark):
    rows = spark.range(20_000).select(sharding.shard_of(F.col("id"), [1.0, 2.0, 1.0]).alias("s")).groupBy("s").count().collect()
    share = {r["s"]: r["count"] / 20_000 for r in rows}
    assert abs(share[1] - 0.5) < 0.02 and abs(share[0] - 0.25) < 0.02


def test_sharding_empty(no_docs):
    assert sharding.shard(no_docs, [1.0]).count() == 0


# -- WARC fixity ----------------------------------------------------------------------------------------------------


def test_warc_audit(spark):
    rows = [(i, None if i == 3 else f"http://h/{i}", "WARC/1.1\r\n\r\nbody é\r\n\r\n" * (i % 4), "x") for i in range(300)] + [(None, None, None, "y"), (5, "u", "again", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, seq string")
    records = warc.archive(pages, file_bytes=9000)
    records = spark.createDataFrame(records.collect(), records.schema)
    paths = [scratch_path(spark, "r") for _ in range(3)]
    damage = {(0, 2), (1, 0)}
    hit = F.concat_ws(":", "file", "seq").isin([f"{a}:{b}" for a, b in damage])
    warc.write(records, paths[0])
    warc.write(records.withColumn("record", F.when(hit, F.regexp_replace("record", "text/html", "text/htmX")).otherwise(F.col("record"))), paths[1])
    last = records.agg(F.max("file")).first()[0]
    warc.write(records.where(f"file < {last}"), paths[2])
    one, two, three = (warc.leaves(spark, p).where(F.col("record_id") != warc.INDEX_ID) for p in paths)
    assert one.count() == 302 and one.where("record_id is null").count() == 0
    assert warc.audit(one, one, 4).count() == 0
    assert {(r["file"], r["seq"], r["state"]) for r in warc.audit(one, two, 4).collect()} == {(*d, "damaged") for d in damage}
    gone = {(r["file"], r["seq"]) for r in one.where(f"file = {last}").collect()}
    assert {(r["file"], r["seq"]) for r in warc.audit(one, three, 4).where("state = 'missing'").collect()} == gone
    for f, group in itertools.groupby(sorted(tuple(r) for r in one.select("file", "offset", "length").collect()), key=lambda r: r[0]):
        at = 0
        for _, offset, length in group:
            assert offset == at
            at += length


def test_warc_stored_damage(spark):
    """Flipped, lost and added bytes in the stored files are found as the records that they hit, and no others."""
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"page {i} " * (i % 50)) for i in range(120)], "page_id long, url string, html string")
    paths = [scratch_path(spark, "r") for _ in range(2)]
    warc.write(warc.archive(pages, file_bytes=8000), paths[0])
    warc.copy(spark, *paths)
    one = warc.leaves(spark, paths[0]).collect()
    assert warc.audit(warc.leaves(spark, paths[0]), warc.leaves(spark, paths[1]), 4).count() == 0
    place = {(r["file"], r["seq"]): (r["offset"], r["length"]) for r in one}
    last = {f: max(s for g, s in place if f == g) for f in range(6)}
    cut = last[3]
    file = lambda f: next(p for p in pathlib.Path(paths[1].removeprefix("file://")).glob(f"file={f}/part-*.txt"))
    raw = {f: bytearray(file(f).read_bytes()) for f in range(6)}
    assert gzip.decompress(raw[0]).count(b"WARC/1.1\r\n") == sum(f == 0 for f, _ in place)
    for f, seq, at in ((0, 0, 0), (0, 4, 1), (0, 7, 30)):
        raw[f][place[f, seq][0] + at] ^= 16
    del raw[1][place[1, 2][0] + 20]
    raw[2][place[2, 3][0] + 15 : place[2, 3][0] + 15] = b"added"
    del raw[3][place[3, cut][0] :]
    del raw[4][place[4, 2][0] : place[4, 3][0]]
    for seq in (last[5] - 1, 1):  # one copy of the index and a record
        raw[5][place[5, seq][0] + 12] ^= 1
    for f, content in raw.items():
        file(f).write_bytes(content)
        (file(f).parent / f".{file(f).name}.crc").unlink(missing_ok=True)
    got = {tuple(r) for r in warc.audit(warc.leaves(spark, paths[0]), warc.leaves(spark, paths[1]), 4).collect()}
    assert got == {(0, 0, "damaged"), (0, 4, "damaged"), (0, 7, "damaged"), (1, 2, "damaged"), (2, 3, "damaged"), (3, cut, "missing"), (4, 2, "missing"), (5, 1, "damaged"), (5, last[5] - 1, "damaged")}


def test_warc_records_that_were_never_written(spark):
    """A record that a replica was written without is missing alone, one that it has besides is extra; damage elsewhere in
    the same file, repeated records and a hit index are told apart."""
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"page {i // 2} " * (i % 9)) for i in range(100)] + [(7, "u", "twice")] * 3, "page_id long, url string, html string")
    records = warc.archive(pages, file_bytes=1 << 20)
    records = spark.createDataFrame(records.collect(), records.schema)
    one, two, three, four = (scratch_path(spark, "r") for _ in range(4))
    warc.write(records, one)
    warc.write(records.where("seq <> 10"), two)
    warc.write(records.where("seq not in (3, 8, 21)").withColumn("record", F.when(F.col("seq") == 60, F.regexp_replace("record", "text/html", "text/htmX")).otherwise(F.col("record"))), three)
    audited = lambda a, b: sorted(tuple(r) for r in warc.audit(warc.leaves(spark, a), warc.leaves(spark, b), 4).collect())
    assert audited(one, two) == [(0, 10, "missing")] and audited(two, one) == [(0, 10, "extra")]
    # Of the equal records 8 to 10 the last one counts as missing.
    assert audited(one, three) == [(0, 3, "missing"), (0, 10, "missing"), (0, 21, "missing"), (0, 60, "damaged")]
    warc.copy(spark, two, four)
    file = next(pathlib.Path(four.removeprefix("file://")).glob("file=0/part-*.txt"))
    raw, at = bytearray(file.read_bytes()), warc.leaves(spark, four).where("record_id = '<urn:index>'").agg(F.min("offset")).first()[0]
    raw[at + 30] ^= 1
    file.write_bytes(raw)
    (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    assert {r[2] for r in audited(one, four)} == {"missing", "damaged"} and (0, 10, "missing") in audited(one, four)


def test_warc_tree(spark):
    """Roots are those of a tree in plain Python."""
    rng = random.Random(9)
    rows = [(f, s, None if rng.random() < 0.1 else hashlib.sha256(f"{f}.{s}".encode()).hexdigest()) for f, n in ((0, 1), (1, 40), (2, 17)) for s in range(n)]
    got = {r["file"]: (r["root"], len(r["levels"])) for r in warc.tree(spark.createDataFrame(rows, "file long, seq long, hash string"), 3, 4).collect()}
    for f in range(3):
        nodes = [h for g, _, h in rows if f == g]
        for _ in range(3):
            nodes = [hashlib.sha256(";".join(f"{i + k}:{h or ''}" for k, h in enumerate(nodes[i : i + 4])).encode()).hexdigest() for i in range(0, len(nodes), 4)]
        assert got[f] == (nodes[0], 4)


def test_warc_foreign_files():
    """Files without an index are taken member by member, or record by record where they are plain text."""
    plain = [f"WARC/1.1\r\nWARC-Record-ID: <urn:record:{k}>\r\nContent-Length: 3\r\n\r\nab{k}\r\n\r\n".encode() for k in range(5)]
    packed = [gzip.compress(x, 6, mtime=0) for x in plain]
    assert [r[2] for r in warc.index_of(b"".join(plain))] == [r[2] for r in warc.index_of(b"".join(packed))] == list("01234")
    hit = bytearray(b"".join(packed))
    hit[len(packed[0]) + 15] ^= 4
    found = warc.index_of(bytes(hit))
    assert [r[2] for r in found] == ["0", None, "2", "3", "4"] and sum(r[1] for r in found) == len(hit)


def test_warc_parse_broken():
    got = list(warc.parse(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\ngarbage"))
    assert [(a, n) for a, n, *_ in got] == [(0, 38), (38, 7)] and got[1][2] is None


def test_warc_query(spark, sf):
    rows = queries.op3_warc_fixity(spark, sf)
    assert rows.where("page_id is not null").count() == table(spark, sf, "pages").count() and rows.where("state not in ('intact', 'damaged')").count() == 0
    # The drill by hand: the stored bytes of a record are its text, compressed.
    want = {}
    for r in table(spark, sf, "pages").collect():
        body = (r["html"] or "").encode()
        text = b"".join([b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:record:", str(r["page_id"]).encode(), b">\r\nWARC-Target-URI: ", (r["url"] or "").encode(), b"\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Type: text/html\r\nContent-Length: ", str(len(body)).encode(), b"\r\n\r\n", body, b"\r\n\r\n"])
        member = gzip.compress(text, 6, mtime=0)
        want[r["page_id"]] = (hashlib.sha256(member).hexdigest(), "damaged" if zlib.crc32(member) % queries.DRILL == 0 else "intact")
    got = {r["page_id"]: (r["sha256"], r["state"]) for r in rows.where("page_id is not null").collect()}
    assert got == want and "damaged" in {state for _, state in got.values()}


def test_warc_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    path = scratch_path(spark, "r")
    warc.write(warc.archive(pages), path)
    assert warc.audit(warc.leaves(spark, path), warc.leaves(spark, path)).count() == 0


# -- substring dedup ------------------------------------------------------------------------------------------------


def test_cuts():
    """The gear hash is that of its definition; words set before a text move no cut but those beside them."""
    rng = random.Random(2)
    raw = np.frombuffer(bytes(rng.choice(b"abcdefgh  ") for _ in range(6000)), np.uint8)
    for table, bits in ((substring._GEAR, 16), (substring._GEAR32, 32)):
        want = [sum(int(table[raw[i - k]]) << k for k in range(min(bits, i + 1))) & ((1 << bits) - 1) for i in range(200)]
        assert substring.gear(raw, table)[:200].tolist() == want
    cuts = lambda raw: {int(starts[k]) for starts, ends in [substring.words(raw)] for k in substring.chosen(raw, starts, ends)}
    before, more = cuts(raw), b"some new words "
    moved = cuts(np.concatenate([np.frombuffer(more, np.uint8), raw]))
    assert len(before) > 60 and len({c + len(more) for c in before} - moved) <= 2
    assert cuts(raw[:0]) == set() and cuts(raw[:60]) == set()


def test_planted_passages(spark):
    """Passages of 55 words and more are found in every document but the first; single lines and clean texts stay."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeioustrnlmdp") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(55 + 5 * k) for k in range(10)]
    line = "This work is licensed under the Example License, version 3."
    rows = [(k * 10 + j, f"{text(40 + j)} {p} {text(30)}") for k, p in enumerate(passages) for j in range(6)]
    clean = [(1000 + k, f"{text(150)}\n{line}") for k in range(60)]
    docs = spark.createDataFrame([*rows, *clean], "doc_id long, text string")
    found = {r["doc_id"] for r in substring.passages(docs).collect()}
    assert not found & {i for i, _ in clean}
    assert found == {i for i, _ in rows if i % 10}
    kept = {r["doc_id"]: r["text"] for r in substring.remove(docs).collect()}
    assert all(kept[i] == t for i, t in clean) and len(kept) == len(rows) + len(clean)
    assert all(sum(p in kept[k * 10 + j] for j in range(6)) == 1 for k, p in enumerate(passages))


def covered(docs):
    """The bytes of each (id, text) that later occurrences of 50 words cover, in plain Python."""
    first, grams = {}, {}
    for i, t in sorted({(i, t) for i, t in docs if i is not None and t}):
        raw = t.encode()
        starts, ends = (x.tolist() for x in substring.words(np.frombuffer(raw, np.uint8)))
        grams[i, t] = [(a, b, raw[a:b]) for a, b in zip(starts, ends[49:])]
        for a, _, g in grams[i, t]:
            first.setdefault(g, (i, t, a))
    return {(i, t): {k for a, b, g in found if first[g][:2] != (i, t) or first[g][2] + b - a <= a for k in range(a, b)} for (i, t), found in grams.items()}


def word_runs(docs):
    return {(i, k) for (i, _), at in covered(docs).items() for k in at}


def word_spans(docs):
    """The covered bytes as spans, of texts that have any."""
    return {key: list(zip(sorted(k for k in at if k - 1 not in at), sorted(k + 1 for k in at if k + 1 not in at))) for key, at in covered(docs).items() if at}


@pytest.mark.parametrize("source", ["odd", "documents"])
def test_passages(spark, sf, odd_docs, source):
    docs = odd_docs if source == "odd" else table(spark, sf, "documents")
    spans, by_id = substring.passages(docs).collect(), collections.defaultdict(set)
    for i, t in texts(docs):
        by_id[i].add((t or "").encode())
    assert {(r["doc_id"], k) for r in spans for k in range(r["start"], r["end"])} == word_runs(texts(docs))
    for r in spans:
        size = r["end"] - r["start"]
        own, earlier = ({t[r[c] : r[c] + size] for t in by_id[r[i]]} for i, c in (("doc_id", "start"), ("first_doc_id", "first_start")))
        assert any(len(t) == size for t in own & earlier)


def test_chance_chunks(spark):
    """A text whose parts all occur earlier, each in another place, holds no repeated passage and stays whole."""
    rng = random.Random(8)
    words = ["".join(rng.choice("aeioustrnlmdp") for _ in range(5)) for _ in range(200)]
    rows = [(k, " ".join(words[k * 5 : k * 5 + 49])) for k in range(40)] + [(1000, " ".join(words))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert substring.passages(docs).count() == 0
    assert {r["doc_id"]: r["text"] for r in substring.remove(docs).collect()} == dict(rows)


def test_short_words(spark):
    """Passages of 50 words of 1 to 4 letters, within other words, are found and cut whole."""
    rng = random.Random(9)
    text = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 4))) for _ in range(n))
    shared = [text(50) for _ in range(60)]
    rows = [(k * 2 + j, f"{text(60)} {p} {text(40)}") for k, p in enumerate(shared) for j in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    raw = np.frombuffer(rows[0][1].encode(), np.uint8)
    found = np.unique(substring.chosen(raw, *substring.words(raw)))
    assert np.diff(found).max() <= 26 and len(found) < 40
    kept = {r["doc_id"]: r["text"] for r in substring.remove(docs).collect()}
    assert all(kept[k * 2] == rows[k * 2][1] for k in range(60))
    # The words beside a passage may be equal by chance and go too.
    assert all(96 <= len(kept[k * 2 + 1].split()) <= 100 for k in range(60))


def test_remove_keeps_columns(odd_docs, no_docs):
    out = substring.remove(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    assert substring.remove(no_docs).count() == 0 and substring.passages(no_docs).count() == 0
    named = odd_docs.select("*", *(F.lit(k).alias(c) for k, c in enumerate(("_spans", "_id", "_key", "row", "spans", "key", "id", "short", "_gone", "_again", "cuts"))))
    again = substring.remove(named)
    assert again.columns == named.columns and sorted(map(str, again.select(*odd_docs.columns).collect())) == sorted(map(str, out.collect()))
    raw = "aéb漢c".encode()
    assert [substring.cut_spans("aéb漢c", [a], [b]) for a, b in ((1, 3), (3, 7), (1, 7), (0, len(raw)))] == ["ab漢c", "aéc", "ac", ""]


# -- language identification ----------------------------------------------------------------------------------------


def test_language(spark, sf):
    rows = queries.op5_language_id(spark, sf)
    lang = {r["doc_id"]: r["lang"] for r in table(spark, sf, "documents").collect()}
    got = rows.collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in lang if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.9 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got) and len(got) == len(lang)


def dense_language(text, model):
    """Posteriors by the whole counts and the whole matrix, n-gram by n-gram in plain Python."""
    mask, counts = (1 << 64) - 1, np.zeros(1 << model["bits"])
    codes = [ord(c) for c in f" {text.lower()} "]
    for n in model["orders"]:
        for k in range(len(codes) - n + 1):
            h = 0
            for m, c in enumerate(codes[k : k + n], 1):
                h = (h * 0x9E3779B97F4A7C15 + c + m) & mask
            h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & mask
            h = (h ^ h >> 27) * 0x94D049BB133111EB & mask
            counts[(h ^ h >> 31) >> (64 - model["bits"])] += 1
    total = model["prior"] + counts @ model["logp"].astype(float)
    return total.argmax(), 1 / np.exp(total - total.max()).sum()


def test_language_scores(spark, monkeypatch):
    """Batch scores are those of the dense product, in one slice and in many, gathered at once and in parts; texts with
    more n-grams than the matrix has rows too."""
    rows = [("ab ab ba", "x"), ("cd dc cd", "y"), ("ab cd", "x"), ("Élan dab", "z"), (None, "z"), ("dd", None)]
    docs = spark.createDataFrame([(k, t, g) for k, (t, g) in enumerate(rows)], "doc_id long, text string, lang string")
    model = langid.fit(docs, bits=8)
    rng = random.Random(3)
    given = ["abba cddc ab ab cd cd dc", None, "77", "ab", "", "É", "".join(rng.choice("abcd é") for _ in range(700))]
    letters = [bool(t) and any(c.isalpha() for c in t) for t in given]
    for size, gathered in ((1 << 19, 1 << 20), (7, 1 << 20), (64, 5)):
        monkeypatch.setattr(langid, "SLICE", size)
        monkeypatch.setattr(langid, "GATHERED", gathered)
        named, score = langid.score_texts(given, letters, model)
        for text, letter, lang, p in zip(given, letters, named, score):
            if letter:
                best, sure = dense_language(text, model)
                assert lang == model["langs"][best] and p == pytest.approx(sure, abs=1e-9)
            else:
                assert lang == "und" and p == 0


def test_language_odd(odd_docs, no_docs):
    out = langid.predict(odd_docs, langid.fit(odd_docs)).collect()
    assert len(out) == odd_docs.count()
    for r in out:
        letters = r["text"] is not None and any(c.isalpha() for c in r["text"])
        assert (r["language"]["lang_pred"] != "und") == letters
    empty = langid.fit(no_docs)
    assert langid.predict(no_docs, empty).count() == 0
    assert {r["language"]["lang_pred"] for r in langid.predict(odd_docs, empty).collect()} == {"und"}


# -- decontamination ------------------------------------------------------------------------------------------------


def least_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_myers():
    rng = random.Random(9)
    for _ in range(300):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(1, n))) for n in (9, 30))
        masks = {}
        for i, c in enumerate(p):
            masks[c] = masks.get(c, 0) | 1 << i
        got = decontaminate.myers(masks, len(p), t, len(p))
        assert (len(p) if got is None else got[0]) == least_distance(p, t)


def test_matches_brute_force():
    rng = random.Random(11)
    items = [(k, "".join(rng.choice("abcd ") for _ in range(60)).strip()) for k in range(5)]
    items = [(k, decontaminate.normal(t)) for k, t in items]
    matcher = decontaminate.Matcher(items, 0.1)
    for _ in range(120):
        k, t = rng.choice(items)
        t = list(t)
        for _ in range(rng.randint(0, 9)):
            at = rng.randrange(len(t))
            t[at : at + rng.randint(0, 1)] = rng.choice(["", "z", "q"])
        text = decontaminate.normal("xy zz " + "".join(t) + " tail of it")
        want = {i: d for i, p in items if (d := least_distance(p, text)) <= decontaminate.budget(p, 0.1)}
        assert {i: d for i, d, _ in matcher.find(text)} == want


def test_short_items():
    """Items without an edit by the rate match whole words, longer ones within their edits at every length; items with a
    null id are searched."""
    matcher = decontaminate.Matcher([(1, "two words"), (None, "ab"), (3, "c"), (4, "the answer is 42")], 0.1)
    found = lambda t: sorted((i, d) for i, d, _ in matcher.find(t) if i) + [(i, d) for i, d, _ in matcher.find(t) if i is None]
    assert found("these are two  WORDS") == [(1, 0)] and found("two wordsx ab") == [(None, 0)] and found("xab c") == [(3, 0)]
    assert found("abc two word s") == [] and found("") == [] and found(None) == []
    assert found("so the answr is 42!") == [(4, 1)] and found("the answer is 42") == [(4, 0)] and found("the answer was 43") == []
    rng = random.Random(2)
    for n in range(10, 34):
        item = decontaminate.normal("".join(rng.choice("abcde") for _ in range(n)))
        own = decontaminate.Matcher([(0, item)], 0.08)
        for _ in range(20):
            t = list(item)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = rng.choice(["", "z", "ab"])
            text, k = decontaminate.normal("yy " + "".join(t) + " yy"), decontaminate.budget(item, 0.08)
            want = f" {item} " in f" {text} " if k == 0 else least_distance(item, text) <= k
            assert bool(own.find(text)) == want


def test_matches_tables(spark, sf, odd_docs, no_docs):
    bench, docs = table(spark, sf, "benchmark"), table(spark, sf, "documents")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, bench).collect()}
    held = {(i, j) for i, t in texts(docs) for j, p in ((r["item_id"], r["text"]) for r in bench.collect()) if decontaminate.normal(p) in decontaminate.normal(t or "")}
    assert held and held <= got
    assert got == {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, bench, block_chars=500).collect()}
    base = odd_docs.where("doc_id = 0").first()["text"]
    odd_bench = spark.createDataFrame([(1, base, "x"), (2, None, "x"), (3, "", "x"), (None, base, "x"), (1, base, "x")], "item_id long, text string, doc_id string")
    assert {r["doc_id"] for r in decontaminate.matches(odd_docs, odd_bench).collect()} == {0, 1, 2, 12, None}
    assert decontaminate.matches(odd_docs, odd_bench.limit(0)).count() == 0 and decontaminate.matches(no_docs, odd_bench).count() == 0
    assert decontaminate.flag(odd_docs, odd_bench).where("contaminated").count() == 5


# -- Jaccard join ---------------------------------------------------------------------------------------------------


def components_of(docs, percent=75):
    sets = {}
    for i, t in docs:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.setdefault(i, []).append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations([i for i in sets if i is not None], 2):
        if any(s and t and 100 * len(s & t) >= percent * len(s | t) for s in sets[i] for t in sets[j]):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return {i: ({len(s) for s in sets[i]}, find(i)) for i in sets}


@pytest.mark.parametrize("source", ["odd", "documents"])
def test_jaccard(spark, sf, odd_docs, source):
    docs = odd_docs if source == "odd" else table(spark, sf, "documents")
    want, rows = components_of(texts(docs)), jaccard.join(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        sizes, least = want[r["doc_id"]]
        assert r["n_shingles"] in sizes and r["component_id"] == least


def test_jaccard_near_copies(spark, monkeypatch):
    """A family of edited copies, chains at the threshold and unrelated texts that share a passage; also with star
    rounds forced by a low limit."""
    rng = random.Random(21)
    word = lambda: f"w{rng.randrange(3000)}"
    base, passage = [word() for _ in range(90)], [word() for _ in range(20)]
    rows = []
    for k in range(70):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(90)] = word()
        rows.append(" ".join(w))
    rows += [" ".join([*(word() for _ in range(30)), *passage, *(word() for _ in range(30))]) for _ in range(40)]
    rows += [" ".join(base[k : k + 60]) for k in range(0, 30, 3)] + [" ".join(base[:60]).upper()]
    rng.shuffle(rows)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    want = {i: v[1] for i, v in components_of(list(enumerate(rows))).items()}
    for limit, sample in ((64, 8000), (0, 5)):
        monkeypatch.setattr(jaccard, "LARGE", limit)
        assert {r["doc_id"]: r["component_id"] for r in jaccard.join(docs, sample_docs=sample).collect()} == want


@pytest.mark.parametrize("bits", [1 << 25, 1 << 16])
def test_jaccard_likely(spark, bits):
    docs = spark.range(-20_000, 20_000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    docs = docs.union(docs.limit(1).select(F.lit(None).cast("long"), "text"))
    ids = spark.range(-20_000, 20_000, 40).select(F.col("id").alias("_n"))
    got = [r["doc_id"] for r in jaccard._likely(docs, ids, bits).collect()]
    assert set(range(-20_000, 20_000, 40)) <= set(got) and len(got) == len(set(got)) < 2_000
    assert jaccard._likely(docs, ids.limit(0), bits).isEmpty()


def test_jaccard_shuffles_needed_texts(spark, monkeypatch):
    """Most texts have no candidate: they are left out before the join that reads texts."""
    made = {}
    real = jaccard.materialize
    monkeypatch.setattr(jaccard, "materialize", lambda df, label: made.setdefault(label, df._jdf.queryExecution().optimizedPlan().toString()) and real(df, label))
    words = [" ".join(f"w{i}x{k}" for k in range(60)) for i in range(200)]
    docs = spark.createDataFrame([*enumerate(words), (1000, words[7] + " more"), (1001, "start " + words[9])], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(docs).collect()}
    assert got == {**{i: i for i in range(200)}, 1000: 7, 1001: 9}
    joins = [line for line in made["texts"].splitlines() if "Join" in line]
    assert "strategy=merge" in joins[0] and "strategy=broadcast" in joins[1] and "bitmap_construct_agg" in made["texts"]


def test_jaccard_empty(no_docs):
    assert jaccard.join(no_docs).count() == 0


def test_shingle_hashes():
    docs = ["a b c d e f", "A b C d e f", "", "x", " x\n", "a b c d", "é é é é é é é"]
    raw = [d.encode() for d in docs]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    got = [set(s.tolist()) for s in shingles.sets(np.frombuffer(b"".join(raw), np.uint8), off)]
    assert got[0] == got[1] and len(got[0]) == 2 and got[2] == set() and got[3] == got[4] and len(got[5]) == 1 and len(got[6]) == 1
    assert jaccard.prefix_size(100, 75) == 26 and jaccard.prefix_size(1, 75) == 1


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 360)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "x long, y long")).collect()}
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {n: find(n) for n in parent if any(n in (a, b) and a != b for a, b in links)}


# -- byte-level BPE -------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference_encoding():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark, sf, odd_docs, no_docs, reference_encoding):
    for docs in (odd_docs, table(spark, sf, "documents")):
        want = []
        for i, t in texts(docs):
            ids = reference_encoding.encode_ordinary(t or "")
            want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
        assert sorted((tuple(r) for r in bpe.digest(docs, RANKS, public_tokenizers.PATTERN).collect()), key=KEY) == sorted(want, key=KEY)
    back = bpe.decode(bpe.encode(odd_docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert sorted((bytes(r["decoded"]).decode() for r in back.collect())) == sorted(t or "" for _, t in texts(odd_docs))
    assert bpe.digest(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_random(reference_encoding):
    encoder, rng = bpe.Encoder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN), random.Random(5)
    for _ in range(2000):
        t = "".join(rng.choice(["a", "aa", "th", "é", "the", " ", "\n", "漢", "1", "'s", "!", "ing"]) for _ in range(rng.randint(0, 50)))
        assert encoder.encode(t) == np.array(reference_encoding.encode_ordinary(t), "<u4").tobytes()
    long = "".join(rng.choice("abcde") for _ in range(60_000))
    assert encoder.encode(long) == np.array(reference_encoding.encode_ordinary(long), "<u4").tobytes()


# -- token-id files -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("source", ["odd", "documents"])
def test_token_files(spark, sf, odd_docs, source):
    from tokenizers import Tokenizer

    docs = odd_docs if source == "odd" else table(spark, sf, "documents")
    tokenizer, path = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), scratch_path(spark, "t")
    tokenfiles.write(docs, path, public_tokenizers.path("word_bpe_49k.json"), shard_bytes=20_000, block_ids=3000)
    want = collections.defaultdict(list)
    for i, t in texts(docs):
        want[i].append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1])
    rows = sorted(tokenfiles.read(spark, path).collect(), key=lambda r: r["start"])
    at = 0
    for r in rows:
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert r["start"] == at and r["n_tokens"] == len(ids)
        want[r["doc_id"]].remove(ids)
        at += len(ids)
    assert not any(want.values())
    order = [r["doc_id"] for r in rows if r["doc_id"] is not None]
    assert order == sorted(order)
    sums = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in tokenfiles.read_checksums(spark, path).collect()}
    assert sums == {(r["doc_id"], r["start"]): zlib.crc32(bytes(r["ids"])) for r in rows}


def test_word_ids():
    """Ids of odd texts are those of the library; also with a cache of few words, and with a tokenizer of another kind."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    rng = random.Random(5)
    letters = [chr(k) for k in [*range(1, 0x250), 0x300, 0x301, 0x338, 0xA0, 0x3000, 0x2028, 0x1E9E, 0x3A3, 0x3C2, 0x4E2D, 0x1F600]]
    parts = ["don't", "'s", "a'tb", "éÉ.", "İx", "×", "÷a", "a×b", "AbC)", "ǅa;", "Σς", "x" * 90, "é", "...", "\x1c"]
    odd = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + [" ".join(rng.choice(parts) for _ in range(20)) for _ in range(200)] + ["", " \n", "  a  b "]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        words, tokenizer = tokenfiles.WordIds(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)
        assert words.wordwise == (name == "word_bpe_49k.json")
        for _ in range(2):
            ids, sizes = words.encode(pa.array(odd))
            at = np.concatenate([[0], np.cumsum(sizes)])
            assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [e.ids for e in tokenizer.encode_batch_fast(odd, add_special_tokens=False)]
        assert max(map(len, words.letters), default=0) <= tokenfiles.CACHE_LENGTH


def test_repair_ends():
    """No pair is left that occurs LEAST times, unless the symbols are used up."""
    rng = np.random.default_rng(5)
    passage = rng.integers(0, 49408, 3000)
    ids = np.concatenate([np.concatenate([passage, rng.integers(0, 3000, 40)]) for _ in range(60)]).astype(np.uint16)
    rules, sizes, symbols = tokenfiles.compress(ids, 49408)
    pairs = collections.Counter(zip(symbols[:-1].tolist(), symbols[1:].tolist()))
    assert max(pairs.values()) < tokenfiles.LEAST and 49408 + len(rules) < tokenfiles.SYMBOLS
    assert sizes.max() > 2900 and len(symbols) < len(ids) / 20
    assert tokenfiles.expand(symbols, rules, 49408).tolist() == ids.tolist()
    many = np.tile(rng.integers(0, 49408, 40000), 9).astype(np.uint16)
    rules, _, symbols = tokenfiles.compress(many, 49408)
    assert 49408 + len(rules) == tokenfiles.SYMBOLS and tokenfiles.expand(symbols, rules, 49408).tolist() == many.tolist()


def test_repair_round_trip():
    rng = np.random.default_rng(3)
    for ids in (np.tile([5, 6, 7, 8], 500), rng.integers(0, 30, 4000), np.full(1000, 9), np.zeros(0, int), np.array([3])):
        ids = ids.astype(np.uint16)
        rules, sizes, symbols = tokenfiles.compress(ids, 49408)
        assert tokenfiles.expand(symbols, rules, 49408).tolist() == ids.tolist()
        for k, (a, b) in enumerate(rules.tolist()):
            size = lambda s: 1 if s < 49408 else int(sizes[s - 49408])
            assert sizes[k] == size(a) + size(b)
        for _ in range(20):
            a, n = int(rng.integers(0, len(ids) + 1)), int(rng.integers(0, 50))
            assert tokenfiles.decode_range(symbols, rules, sizes, 49408, a, n).tolist() == ids[a : a + n].tolist()
    assert len(tokenfiles.compress(np.tile([5, 6, 7, 8], 500), 49408)[2]) < 200


def test_token_files_empty(spark, no_docs):
    path = scratch_path(spark, "t")
    tokenfiles.write(no_docs, path, public_tokenizers.path("word_bpe_49k.json"))
    assert tokenfiles.read(spark, path).count() == 0


# -- token counts ---------------------------------------------------------------------------------------------------


def greedy_count(word, vocabulary, longest):
    symbols, at, n = (*word, wordpiece.END), 0, 0
    while at < len(symbols):
        for size in range(min(longest, len(symbols) - at), 0, -1):
            if symbols[at : at + size] in vocabulary:
                at, n = at + size, n + 1
                break
        else:
            return 1
    return n


def test_longest_match_random():
    rng = random.Random(8)
    for _ in range(60):
        tokens = {("".join(rng.choice("ab") for _ in range(rng.randint(1, 5))).encode(), rng.random() < 0.4) for _ in range(rng.randint(1, 12))}
        if rng.random() < 0.5:
            tokens |= {(c, e) for c in (b"a", b"b") for e in (True, False)}
        spelled = {(*t, wordpiece.END) if e else tuple(t) for t, e in tokens}
        match = wordpiece.LongestMatch(sorted(tokens))
        for _ in range(60):
            word = "".join(rng.choice("abc" if rng.random() < 0.1 else "ab") for _ in range(rng.randint(1, 14))).encode()
            assert match.count(word) == greedy_count(word, spelled, 6), (tokens, word)


@pytest.mark.parametrize("source", ["odd", "documents"])
def test_token_counts(spark, sf, odd_docs, source):
    docs = odd_docs if source == "odd" else table(spark, sf, "documents")
    vocabulary = queries.word_vocabulary()
    spelled = {(*t, wordpiece.END) if e else tuple(t) for t, e in vocabulary}
    longest, cache = max(map(len, spelled)), {}
    want = []
    for i, t in texts(docs):
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        for w in words:
            cache.setdefault(w, None)
            if cache[w] is None:
                cache[w] = greedy_count(w.encode(), spelled, longest)
        want.append((i, len(words), sum(cache[w] for w in words)))
    assert sorted((tuple(r) for r in wordpiece.token_counts(docs, vocabulary).collect()), key=KEY) == sorted(want, key=KEY)


def test_token_counts_empty(no_docs):
    assert wordpiece.token_counts(no_docs, [(b"a", False)]).count() == 0
