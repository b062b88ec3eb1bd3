"""WARC files and their Merkle fixity audit.

The hashes of the stored bytes of a file's records, in order of their offsets, are the leaves of its tree; runs of
FAN_OUT leaves or nodes (offset ranges) are hashed into parents up to the file's root, and roots of files likewise up
to one root a replica. An audit compares the roots and descends only into branches whose hashes differ, down to the
damaged records. A file's tree is one row; the levels over files are tables of their own.

A record is a gzip member (several above MEMBER bytes). A file ends with two equal index records, which hold the place,
id and a short hash of every record before them, so reading a replica moves no file between tasks. Behind lost or added
bytes the next member that the index knows is looked for: a damaged file costs only the records that are hit, and the
index records are leaves like the others.

Cases: a null URL or body is written as the empty one; repeated rows are records of their own; an empty table gives
no file and equal roots; a record that one replica lacks is ``missing`` or ``extra``, also where it was
never written, and those behind it are intact; of a file without a readable index
(another writer's, or both copies are hit) the members, or the records of plain text, are taken as they follow one
another, and a stretch that cannot be read is one record; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, session

FAN_OUT = 16
#: Bytes of records in one file.
FILE_BYTES = 16 << 20
END = "\r\n\r\n"
#: Bytes of records in a gzip member: below 2 ** 24 the last byte of a member, the highest of its size, is 0.
MEMBER = (1 << 24) - 1
LEAVES = "file long, seq long, offset long, length long, record_id string, hash string"
#: What an index record has as its id, and its copies in a file.
INDEX_ID, COPIES = "<urn:index>", 2
_MAGIC = b"\x1f\x8b\x08\x00"


def record(record_id: Column, url: Column, body: Column, date: str = "2020-01-01T00:00:00Z") -> Column:
    """The text of a WARC resource record without the two line ends after it."""
    body = F.coalesce(body, F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:record:"), record_id, F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")))
    return F.concat(head, F.lit(f"\r\nWARC-Date: {date}\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(END), body)


def _store(members: DataFrame, path: str) -> None:
    """Write (file, seq, member) as one file a ``file``. The line separator of Spark's text writer is the byte 0 that
    ends every member."""
    rows = members.sortWithinPartitions("file", "seq").select("file", F.expr("cast(substring(member, 1, length(member) - 1) as string)").alias("member"))
    rows.write.partitionBy("file").option("lineSep", "\0").text(path)


def _members(raw: bytes) -> bytes:
    return b"".join(gzip.compress(raw[k : k + MEMBER], 6, mtime=0) for k in range(0, len(raw), MEMBER))


def write(records: DataFrame, path: str, dealt: bool = False) -> None:
    """Write (file, seq, record) as one WARC file of gzip members a ``file`` below ``path``, records in order of seq,
    each file with its index. ``dealt``: the rows of a file are in one partition already, in order."""
    session(records.sparkSession)
    records = records.select(F.col("file").cast("long"), F.col("seq").cast("long"), "record")
    if not dealt:
        files = max(1, (records.agg(F.max("file")).first()[0] or 0) + 1)
        records = records.repartition(int(files), "file").sortWithinPartitions("file", "seq")

    def pack(batches):
        current, at, last, index = None, 0, 0, []

        def ending():
            lines = "\n".join(json.dumps(row) for row in index).encode("utf-8")
            head = f"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: {INDEX_ID}\r\nContent-Type: application/json\r\nContent-Length: {len(lines)}{END}"
            member = _members(head.encode("utf-8") + lines + END.encode("utf-8"))
            return _batch([(current, last + 1 + k, member) for k in range(COPIES)])

        for batch in batches:
            found = []
            for file, seq, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if file != current:
                    if current is not None:
                        yield _batch(found)
                        yield ending()
                    current, at, index, found = file, 0, [], []
                raw = (text + END).encode("utf-8")
                member = _members(raw)
                index.append((at, len(member), next(parse(raw))[2], hashlib.sha256(member).hexdigest()[:16]))
                found.append((file, seq, member))
                at, last = at + len(member), seq
            yield _batch(found)
        if current is not None:
            yield ending()

    _store(records.mapInArrow(pack, "file long, seq long, member binary"), path)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["file", "seq", "member"])


def copy(spark: SparkSession, path: str, to: str, stored=lambda member: member) -> None:
    """Copy the files of a replica; ``stored`` maps the bytes of each record, to the same last byte."""

    def split(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = content.as_py()
                rows = index_of(raw)
                for k in range(0, len(rows), 256):
                    yield _batch([(file, seq, stored(raw[at : at + n])) for seq, (at, n, _, _) in enumerate(rows[k : k + 256], k)])

    _store(_files(spark, path).mapInArrow(split, "file long, seq long, member binary"), to)


def parse(raw: bytes):
    """(offset, length, record id, SHA-256) of each record of plain text; lengths include the line ends after a record. What cannot
    be read as a record goes, to the end of the file, as one record without id."""
    at = 0
    while at < len(raw):
        head = raw.find(b"\r\n\r\n", at)
        lines = raw[at:head].split(b"\r\n") if head >= 0 else []
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines[1:])}
        size = fields.get(b"content-length", b"")
        end = head + 4 + int(size) + 4 if head >= 0 and size.isdigit() else len(raw) + 1
        if not lines or not lines[0].startswith(b"WARC/") or end > len(raw) or raw[end - 4 : end] != b"\r\n\r\n":
            yield at, len(raw) - at, None, hashlib.sha256(raw[at:]).hexdigest()
            return
        named = fields.get(b"warc-record-id", b"").decode("utf-8", "replace").removeprefix("<urn:record:").removesuffix(">")
        yield at, end - at, named, hashlib.sha256(raw[at:end]).hexdigest()
        at = end


def member_end(raw: bytes, at: int) -> tuple[int, bytes] | None:
    """End and text of the gzip members of one record from ``at``; None where they cannot be read."""
    texts, view = [], memoryview(raw)
    while True:
        part, out = zlib.decompressobj(31), []
        while not part.eof and at < len(raw):
            try:
                out.append(part.decompress(view[at : at + (1 << 16)]))
            except zlib.error:
                return None
            at = min(at + (1 << 16), len(raw)) - len(part.unused_data)
        if not part.eof:
            return None
        texts.append(b"".join(out))
        if len(texts[-1]) < MEMBER or at == len(raw):
            return at, b"".join(texts)


def index_of(raw: bytes) -> list[tuple]:
    """(offset, length, record id, short hash) of the records of a file, index records included, by its index; by what
    can be read where there is none."""
    look = raw.rfind(_MAGIC)
    while look >= 0:
        found = member_end(raw, look)
        if found and found[1].startswith(f"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: {INDEX_ID}\r\n".encode()):
            body = found[1][found[1].index(END.encode()) + len(END) : -len(END)]
            rows = [tuple(json.loads(line)) for line in body.split(b"\n")]
            size, short = found[0] - look, hashlib.sha256(raw[look : found[0]]).hexdigest()[:16]
            at = rows[-1][0] + rows[-1][1]
            return rows + [(at + k * size, size, INDEX_ID, short) for k in range(COPIES)]
        look = raw.rfind(_MAGIC, 0, look + len(_MAGIC) - 1)
    if raw.startswith(b"WARC/"):
        return [(at, n, named, digest[:16]) for at, n, named, digest in parse(raw)]
    rows, at = [], 0
    while at < len(raw):
        found = member_end(raw, at)
        end, named = (found[0], next(parse(found[1]))[2] if found[1] else None) if found else (len(raw), None)
        if not found:
            look = raw.find(_MAGIC, at + 1)
            while look >= 0 and not member_end(raw, look):
                look = raw.find(_MAGIC, look + 1)
            end = look if look >= 0 else len(raw)
        rows.append((at, end - at, named, hashlib.sha256(raw[at:end]).hexdigest()[:16]))
        at = end
    return rows


def stored_records(raw: bytes, index: list[tuple]):
    """(seq, offset, length, record id, SHA-256) of the stored bytes of each indexed record; without offset, length and
    hash for a record of which nothing is left."""
    digest = lambda at, n: hashlib.sha256(raw[at : at + n]).hexdigest()
    k, shift, known = 0, 0, None
    while k < len(index):
        offset, length, named, short = index[k]
        at = offset + shift
        found = digest(at, length)
        if found[:16] == short:
            yield k, at, length, named, found
            k += 1
            continue
        # The next place at which a later record stands as the index has it.
        m, begin = k + 1, at + length
        if m >= len(index) or digest(begin, index[m][1])[:16] != index[m][3]:
            known = known or {row[3]: j for j, row in enumerate(index)}
            m, begin, look = len(index), len(raw), raw.find(_MAGIC, at)
            while look >= 0:
                met = member_end(raw, look)
                j = known.get(digest(look, met[0] - look)[:16], -1) if met else -1
                if j >= k:
                    m, begin = j, look
                    break
                look = raw.find(_MAGIC, look + 1)
        for j in range(k, m):
            a, b = min(index[j][0] + shift, begin), begin if j == m - 1 else min(index[j][0] + index[j][1] + shift, begin)
            yield (j, a, b - a, index[j][2], digest(a, b - a)) if a < b else (j, None, None, index[j][2], None)
        if m < len(index):
            shift = begin - index[m][0]
        k = m


def _files(spark: SparkSession, path: str, pattern: str = "part-*.txt", file: Column | None = None) -> DataFrame:
    """(file, content) of the WARC files below ``path``; ``file`` makes the number of a file from its ``path``."""
    number = F.regexp_extract("path", "/file=([0-9]+)/[^/]*$", 1) if file is None else file
    files = session(spark).read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select(number.cast("long").alias("file"), "content")


def leaves(spark: SparkSession, path: str, pattern: str = "part-*.txt", file: Column | None = None) -> DataFrame:
    """(file, seq, offset, length, record_id, hash) of the stored bytes of every record, one row a record of the index."""
    kinds = {"long": pa.int64(), "string": pa.string()}
    columns = [c.split() for c in LEAVES.split(", ")]

    def read(batches):
        for batch in batches:
            for number, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = content.as_py()
                found = [(number, *row) for row in stored_records(raw, index_of(raw))]
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kinds[kind]) for k, (_, kind) in enumerate(columns)], names=[name for name, _ in columns])

    return _files(spark, path, pattern, file).mapInArrow(read, LEAVES)


def _joined(nodes: Column, first: Column) -> Column:
    """The hash of a run of nodes (hash or null) with their numbers from ``first``."""
    numbered = F.transform(nodes, lambda x, i: F.concat_ws(":", (first + i).cast("string"), F.coalesce(x, F.lit(""))))
    return F.sha2(F.array_join(numbered, ";"), 256)


def _above(nodes: Column, fan_out: int) -> Column:
    starts = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / fan_out).cast("int"))
    return F.transform(starts, lambda i: _joined(F.slice(nodes, i * fan_out + 1, fan_out), i * fan_out))


def tree(records: DataFrame, height: int, fan_out: int = FAN_OUT) -> DataFrame:
    """(file, levels, root): the levels of each file's tree of ``height``, leaves (by seq) first."""
    run = F.sort_array(F.collect_list(F.struct("seq", "hash")))
    levels = records.groupBy("file").agg(F.transform(run, lambda x: x["hash"]).alias("l0"))
    for k in range(height):
        levels = levels.withColumn(f"l{k + 1}", _above(F.col(f"l{k}"), fan_out))
    return levels.select("file", F.array(*(F.col(f"l{k}") for k in range(height + 1))).alias("levels"), F.col(f"l{height}")[0].alias("root"))


def _height(n: int, fan_out: int) -> int:
    height = 0
    while n > 1:
        n, height = -(-n // fan_out), height + 1
    return height


def _parents(nodes: DataFrame, fan_out: int) -> DataFrame:
    """Hash runs of ``fan_out`` nodes (file, root) in order, files or ranges of them."""
    runs = nodes.groupBy(F.floor(F.col("file") / fan_out).cast("long").alias("_f")).agg(F.sort_array(F.collect_list(F.struct("file", "root"))).alias("o"))
    joined = F.array_join(F.transform("o", lambda x: F.concat_ws(":", x["file"].cast("string"), x["root"])), ";")
    return runs.select(F.col("_f").alias("file"), F.sha2(joined, 256).alias("root"))


def audit(one: DataFrame, two: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """(file, seq, state) of the records that differ between two replicas: damaged, missing (in two) or extra (the place is
    that in two). The trees lead to the places that differ; the records there are aligned by hash and id."""
    tops = [t.agg(F.coalesce(F.max("seq"), F.lit(0)), F.coalesce(F.max("file"), F.lit(0))).first() for t in (one, two)]
    inside, over = (_height(max(t[k] for t in tops) + 1, fan_out) for k in (0, 1))
    trees = [materialize(tree(t, inside, fan_out), "trees") for t in (one, two)]
    levels = [[t.select("file", "root")] for t in trees]
    for _ in range(over):
        for side in levels:
            side.append(materialize(_parents(side[-1], fan_out), "merkle"))
    suspect = None
    for level in range(over, -1, -1):
        a, b = (side[level].select(F.col("file").alias(f"f{k}"), F.col("root").alias(f"r{k}")) for k, side in enumerate(levels))
        if suspect is not None:
            a, b = (t.join(suspect, F.floor(F.col(f"f{k}") / fan_out) == F.col("_s"), "left_semi") for k, t in enumerate((a, b)))
        met = a.join(b, F.col("f0") == F.col("f1"), "full").where(~F.col("r0").eqNullSafe(F.col("r1")))
        suspect = materialize(met.select(F.coalesce("f0", "f1").alias("_s")), "suspect")
        if suspect.isEmpty():
            break
    # Inside the files that differ, from the root down to the leaves.
    a, b = (t.join(suspect, F.col("file") == F.col("_s"), "left_semi").select(F.col("file").alias(f"f{k}"), F.col("levels").alias(f"l{k}")) for k, t in enumerate(trees))
    met = a.join(b, F.col("f0") == F.col("f1"), "full").withColumn("at", F.array(F.lit(0)))
    differ = lambda level: lambda i: ~F.get(F.get(F.col("l0"), F.lit(level)), i).eqNullSafe(F.get(F.get(F.col("l1"), F.lit(level)), i))
    for level in range(inside - 1, -1, -1):
        children = F.flatten(F.transform("at", lambda i: F.sequence(i * fan_out, i * fan_out + (fan_out - 1))))
        met = met.withColumn("at", F.filter(children, differ(level)))
    places = materialize(met.select(F.coalesce("f0", "f1").alias("_f"), F.explode("at").alias("_s")), "places")
    return _aligned(*(t.join(places, (F.col("file") == F.col("_f")) & (F.col("seq") == F.col("_s")), "left_semi") for t in (one, two)))


def _aligned(one: DataFrame, two: DataFrame) -> DataFrame:
    """(file, seq, state) of the leaves at places that differ. Equal hashes of a file are one record that has moved, in
    the order of their places; of the rest those of equal ids are one record that was damaged, and others are missing or
    extra. Copies of an index that name other records than the other replica's, as they must behind a missing or an extra
    one, are no damage while they agree with one another."""
    sides = []
    for k, side in enumerate((one, two)):
        number = lambda key: F.row_number().over(Window.partitionBy("file", key).orderBy("seq"))
        sides.append(materialize(side.select(F.col("file").alias(f"f{k}"), F.col("seq").alias(f"s{k}"), F.col("record_id").alias(f"id{k}"), F.col("hash").alias(f"h{k}"), number("hash").alias(f"n{k}")), "differing"))
    rest = []
    for k, own in enumerate(sides):
        other = sides[1 - k].select(F.col(f"f{1 - k}").alias("_f"), F.col(f"h{1 - k}").alias("_h"), F.col(f"n{1 - k}").alias("_n"))
        left = own.join(other, (F.col(f"f{k}") == F.col("_f")) & (F.col(f"h{k}") == F.col("_h")) & (F.col(f"n{k}") == F.col("_n")), "left_anti")
        rest.append(left.withColumn(f"n{k}", F.row_number().over(Window.partitionBy(f"f{k}", f"id{k}").orderBy(f"s{k}"))))
    c = F.col
    met = rest[0].join(rest[1], (c("f0") == c("f1")) & c("id0").eqNullSafe(c("id1")) & (c("n0") == c("n1")), "full").where("h0 is not null or h1 is not null")
    state = F.when(c("h1").isNull(), "missing").when(c("h0").isNull(), "extra").otherwise("damaged")
    found = materialize(met.select(F.coalesce("f0", "f1").alias("file"), F.coalesce("s0", "s1").alias("seq"), state.alias("state"), F.coalesce("id0", "id1").eqNullSafe(INDEX_ID).alias("index"), "h0", "h1"), "found")
    changed = found.where("not index and state <> 'damaged'").select(c("file").alias("_f")).distinct()
    agreed = found.where("index").groupBy("file").agg(F.min(c("state") == "damaged").alias("whole"), F.countDistinct("h0").alias("a"), F.countDistinct("h1").alias("b"))
    renamed = agreed.where("whole and a = 1 and b = 1").join(changed, c("file") == c("_f"), "left_semi").select(c("file").alias("_f"))
    return found.join(renamed, (c("file") == c("_f")) & c("index"), "left_anti").select("file", "seq", "state")


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", file_bytes: int = FILE_BYTES) -> DataFrame:
    """(file, seq, record) of all pages in ranges of the id, files of about ``file_bytes``."""
    text = record(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(url_col), F.col(body_col))
    rows = pages.select(F.col(id_col).alias("_id"), text.alias("record"))
    total = rows.agg(F.sum(F.octet_length("record"))).first()[0] or 0
    files = max(1, -(-total // file_bytes))
    dealt = rows.repartitionByRange(int(files), F.col("_id"), F.xxhash64("record")).sortWithinPartitions("_id", "record")
    return dealt.select(F.spark_partition_id().cast("long").alias("file"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("seq"), "record")
