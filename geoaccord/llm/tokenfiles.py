"""Token-id files by Re-Pair grammar compression.

Documents are dealt by ranges of their id, encoded, and gathered into blocks of at least BLOCK_IDS ids. In each block
frequent pairs of ids are replaced by nonterminals, round after round (Larsson & Moffat 1999), until no pair occurs
LEAST times or the 16-bit symbols are used up: a round takes the most frequent pairs whose first and second symbols are
disjoint, so that occurrences cannot overlap, and replaces them together. A block stores its rules with their expansion
lengths, so any range of ids decodes without the rest; reading decodes runs of documents that way.

File format: a Parquet data set, one row a block: ``shard`` and ``block`` (order), ``doc_ids`` and ``doc_sizes``,
``rules`` (pairs of little-endian unsigned 16-bit symbols), ``rule_sizes`` (expansion lengths, unsigned 32-bit),
``symbols`` (unsigned 16-bit) and ``n_ids``. Symbols below ``base`` are ids; base + k is rule k.

Cases: a null text is the empty text and has just the end id; null ids come first; repeated rows are separate
documents; an empty table gives no block; a document is never split, so a block is as large as its largest document.
"""

from __future__ import annotations

import json
import zlib
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Shared, materialize, session, utf8, worker_state

BLOCK_IDS = 1 << 20
#: The fewest occurrences of a pair that is replaced.
LEAST = 8
#: Symbols of up to so many ids are spelled out once a block when it is read.
SPELLED = 256
#: Ids that are decoded at once when files are read (a longer document is decoded alone).
DECODE_IDS = 1 << 16
#: Bytes of text in one shard, and the shards whose sizes are summed in one task.
SHARD_BYTES, SHARD_GROUP = 8 << 20, 4096
#: Words (their letters) that a Python worker keeps with their ids, at about 200 bytes each; longer ones are not kept.
WORD_CACHE, CACHE_LENGTH = 1 << 20, 64
#: Bytes of texts that are encoded at once.
CHUNK_BYTES = 8 << 20
MAX_TOKENIZER_BYTES = 64 << 20
SYMBOLS = 1 << 16
BLOCK_SCHEMA = "shard int, block int, doc_ids array<long>, doc_sizes array<long>, base int, rules binary, rule_sizes binary, symbols binary, n_ids long"
#: How a tokenizer whose texts may be cut at white space normalises and splits them.
WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "split": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",
    "suffix": "</w>",
}
def _plain_letters() -> np.ndarray:
    """For each pair of bytes, whether it is a letter of U+00C0 to U+024F that has one lower-case form."""
    table = np.zeros(1 << 16, bool)
    for code in range(0xC0, 0x250):
        if code not in (0xD7, 0xF7, 0x130):
            first, second = chr(code).encode()
            table[first << 8 | second] = True
    return table


_LETTER, _MARK, _PAIR = np.zeros(256, bool), np.zeros(256, bool), _plain_letters()
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[list(b".,;:!?*#$%&|)\"")] = True


def _slices(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.StringArray:
    """Texts begin .. end of UTF-8 bytes; they follow one another without overlap."""
    step, some = np.zeros(len(raw) + 1, np.int8), end > begin
    step[begin[some]] = 1
    step[end[some]] -= 1
    off = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(begin), pa.py_buffer(off), pa.py_buffer(raw[np.cumsum(step[:-1], dtype=np.int8) > 0]))


def _gather(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of ``values`` from each start, one behind another."""
    before = np.cumsum(size) - size
    return values[np.repeat(start - before, size) + np.arange(int(size.sum()))]


class WordIds:
    """Ids by the tokenizers library, as unsigned 16-bit, which sees each word that repeats once.

    Where a tokenizer normalises and splits texts as WORDWISE does, none of its pre-tokens spans ASCII white space, so a
    text's ids are those of its words in a row. A word of plain letters and some marks is two parts, and the letters,
    lower-cased, are a pre-token that normalising leaves as it is: they go to the library's model many at a time, whose
    ids are told apart by the word ends. Marks and other words go through the whole tokenizer, and so do the whole
    texts where a tokenizer is of another kind. Distinct words of a chunk are found and put back as Arrow dictionaries.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.size = self.tokenizer.get_vocab_size()
        parsed = json.loads(definition)
        steps = (parsed.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        suffix = parsed["model"].get("end_of_word_suffix")
        self.wordwise = parsed.get("normalizer") == WORDWISE["normalizer"] and (steps[0].get("pattern") or {}).get("Regex") == WORDWISE["split"] and suffix == WORDWISE["suffix"] and len(steps) == 2 and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space")
        self.letters: dict[str, bytes] = {}
        self.others: dict[str, bytes] = {}
        if self.wordwise:
            parsed |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, steps[1]]}}
            self.model = Tokenizer.from_str(json.dumps(parsed))
            self.ends = np.zeros(self.size, bool)
            self.ends[[k for token, k in self.model.get_vocab().items() if token.endswith(suffix)]] = True

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has."""
        if not self.wordwise:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint16), *(np.array(f, np.uint16) for f in found)]), np.array([len(f) for f in found], np.int64)
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        ids, size = self._words(words.dictionary)
        start, at = np.cumsum(size) - size, words.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(size[at])])
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        return _gather(ids, start[at], size[at]), np.diff(ends[offsets])

    def _words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words in a row, and how many each has."""
        raw, off = utf8(words)
        start, end = off[:-1], off[1:]
        pair = _PAIR[(raw.astype(np.uint16) << 8) | np.append(raw[1:], [0]).astype(np.uint16)] if len(raw) else np.zeros(0, bool)
        letter = _LETTER[raw] | pair
        letter[1:] |= pair[:-1]
        last = np.concatenate([[-1], np.maximum.accumulate(np.where(_MARK[raw], -1, np.arange(len(raw))))])[end]
        edge = np.maximum(last + 1, start)  # behind the last byte that is no mark
        strange = np.concatenate([[0], np.cumsum(~letter)])
        plain = (edge > start) & (strange[edge] == strange[start])
        cores = pc.utf8_lower(_slices(raw, start[plain], edge[plain])).dictionary_encode()
        marks = _slices(raw, edge[plain], end[plain]).dictionary_encode()
        others = _slices(raw, start[~plain], end[~plain])
        names = cores.dictionary.to_pylist(), marks.dictionary.to_pylist() + others.to_pylist()
        parts = self._known(self.letters, names[0], self._letters) + self._known(self.others, names[1], self._others)
        flat, size = np.frombuffer(b"".join(parts), "<u2"), np.array([len(p) // 2 for p in parts], np.int64)
        # Two parts a word, of which the second may be none (an empty part at the end).
        size, none = np.append(size, 0), len(size)
        two = np.full((len(words), 2), none, np.int64)
        two[plain, 0], two[plain, 1] = cores.indices.to_numpy(), marks.indices.to_numpy() + len(names[0])
        two[~plain, 0] = np.arange(len(others)) + len(names[0]) + len(marks.dictionary)
        begin, order = np.cumsum(size) - size, two.ravel()
        return _gather(flat, begin[order], size[order]), size[two].sum(axis=1)

    def _known(self, cache: dict[str, bytes], names: list[str], make) -> list[bytes]:
        """The ids of each name, made where the cache lacks them."""
        if len(cache) >= WORD_CACHE:
            cache.clear()
        new = list(set(names).difference(cache))
        cache.update(zip(new, make(new)))
        found = list(map(cache.__getitem__, names))
        for name in new:
            if len(name) > CACHE_LENGTH:
                del cache[name]
        return found

    def _others(self, names: list[str]) -> list[bytes]:
        return [pack(f"<{len(e.ids)}H", *e.ids) for k in range(0, len(names), 8192) for e in self.tokenizer.encode_batch_fast(names[k : k + 8192], add_special_tokens=False)]

    def _letters(self, names: list[str]) -> list[bytes]:
        """The model ends each word of plain letters with a token that bears the mark of word ends."""
        out: list[bytes] = []
        for k in range(0, len(names), 8192):
            part = names[k : k + 8192]
            ids = np.array(self.model.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u2")
            raw, ends = ids.tobytes(), ((np.flatnonzero(self.ends[ids]) + 1) * 2).tolist()
            if len(ends) != len(part):
                raise ValueError("the model does not end each word by its mark of word ends")
            out += [raw[a:b] for a, b in zip([0, *ends], ends)]
        return out


def compress(ids: np.ndarray, base: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair of one block: (rules (n, 2), expansion lengths, symbols), all symbols below 2 ** 16."""
    seq = ids.astype(np.uint16)
    rules: list[np.ndarray] = []
    sizes = np.ones(SYMBOLS, np.uint32)
    made = base
    while len(seq) > 1 and made < SYMBOLS:
        keys = (seq[:-1].astype(np.uint32) << np.uint32(16)) | seq[1:]
        ordered = np.sort(keys)
        edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        count = np.diff(np.append(edge, len(ordered)))
        often = np.flatnonzero(count >= least)
        often = often[np.argsort(-count[often], kind="stable")][: 4 * (SYMBOLS - made)]
        first, second, chosen = np.zeros(SYMBOLS, bool), np.zeros(SYMBOLS, bool), []
        for key in ordered[edge[often]].tolist():
            a, b = key >> 16, key & 0xFFFF
            # A symbol is first or second in this round, or alone in a pair with itself.
            if not second[a] and not first[b] and (a != b or not (first[a] or second[a])):
                first[a] = second[b] = True
                chosen.append(key)
                if made + len(chosen) >= SYMBOLS:
                    break
        if not chosen:
            break
        pairs = np.sort(np.array(chosen, np.uint32))
        at = np.flatnonzero(first[seq[:-1]] & second[seq[1:]])
        rank = np.minimum(np.searchsorted(pairs, keys[at]), len(pairs) - 1)
        hit = pairs[rank] == keys[at]
        at, rank = at[hit], rank[hit]
        twin = seq[at] == seq[at + 1]
        if twin.any():  # in a run of one symbol, every second place starts a pair
            begin = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | ~twin[1:] | ~twin[:-1]]))
            place = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
            hit = ~twin | (place % 2 == 0)
            at, rank = at[hit], rank[hit]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq[at] = (made + rank).astype(np.uint16)
        seq = seq[keep]
        rule = np.stack([pairs >> np.uint32(16), pairs & np.uint32(0xFFFF)], axis=1).astype(np.uint16)
        sizes[made : made + len(pairs)] = sizes[rule[:, 0]] + sizes[rule[:, 1]]
        rules.append(rule)
        made += len(pairs)
    table = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint16)
    return table, sizes[base:made].copy(), seq


def expand(symbols: np.ndarray, rules: np.ndarray, base: int, through: np.ndarray | None = None) -> np.ndarray:
    """All ids of a symbol sequence; each pass replaces every nonterminal (of those in ``through``) by its pair."""
    seq = symbols
    while len(at := np.flatnonzero(seq >= base if through is None else through[seq])):
        pair = rules[seq[at].astype(np.int64) - base]
        width = np.ones(len(seq), np.int64)
        width[at] = 2
        place = np.cumsum(width) - width
        out = np.repeat(seq, width)
        out[place[at]], out[place[at] + 1] = pair[:, 0], pair[:, 1]
        seq = out
    return seq


class Block:
    """Random access to the ids of one block by the expansion lengths of its rules."""

    def __init__(self, symbols: np.ndarray, rules: np.ndarray, sizes: np.ndarray, base: int):
        self.symbols, self.rules, self.base = symbols, rules, base
        self.sizes = np.concatenate([np.ones(base, np.int64), sizes.astype(np.int64)])
        self.ends = np.cumsum(self.sizes[symbols])
        # The ids of all symbols of up to SPELLED ids, those of the rules made from the rules before them.
        self.flat, self.start = np.arange(base, dtype=np.uint16), np.full(len(self.sizes), -1, np.int64)
        self.start[:base] = np.arange(base)
        wanted = np.flatnonzero(sizes <= SPELLED)
        while len(wanted):
            ready = (self.start[rules[wanted]] >= 0).all(axis=1)
            parts = rules[wanted[ready]].ravel()
            self.start[base + wanted[ready]] = len(self.flat) + np.cumsum(sizes[wanted[ready]].astype(np.int64)) - sizes[wanted[ready]]
            self.flat = np.concatenate([self.flat, _gather(self.flat, self.start[parts], self.sizes[parts])])
            wanted = wanted[~ready]

    def ids(self, start: int, n: int) -> np.ndarray:
        """Ids start .. start + n - 1, as far as the block goes: only the symbols that cover them are expanded."""
        n = max(0, min(n, (int(self.ends[-1]) if len(self.ends) else 0) - start))
        if n <= 0:
            return np.zeros(0, np.uint16)
        lo, hi = np.searchsorted(self.ends, [start, start + n - 1], side="right")
        before = int(self.ends[lo] - self.sizes[self.symbols[lo]])
        seq = expand(self.symbols[lo : hi + 1], self.rules, self.base, self.start < 0)
        return _gather(self.flat, self.start[seq], self.sizes[seq])[start - before : start - before + n]


def decode_range(symbols: np.ndarray, rules: np.ndarray, sizes: np.ndarray, base: int, start: int, n: int) -> np.ndarray:
    """Ids start .. start + n - 1 of a block."""
    return Block(symbols, rules, sizes, base).ids(start, n)


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, block_ids: int = BLOCK_IDS) -> None:
    """Encode ``docs`` in ascending id order, ``end_id`` after each, into block files at ``path``."""
    spark = session(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read(MAX_TOKENIZER_BYTES + 1)
    if len(definition) > MAX_TOKENIZER_BYTES:
        raise ValueError(f"{tokenizer_path} has over {MAX_TOKENIZER_BYTES} characters")
    shared = Shared(spark, definition)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    dealt = rows.repartitionByRange(int(shards), F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id")

    def pack(batches):
        words = worker_state("tokenfiles", shared.key, lambda: WordIds(shared.value))
        base, shard, block = words.size, TaskContext.get().partitionId(), 0
        ids, doc_ids, sizes = np.zeros(0, np.uint16), [], np.zeros(0, np.int64)

        def row(n: int):
            """A block of the first n documents."""
            held = int(sizes[:n].sum())
            rules, lengths, symbols = compress(ids[:held], base)
            values = [shard, block, doc_ids[:n], sizes[:n], base, rules.astype("<u2").tobytes(), lengths.astype("<u4").tobytes(), symbols.astype("<u2").tobytes(), held]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=names)

        for part, texts in _chunks(batches):
            found, count = words.encode(texts)
            found = np.insert(found, np.cumsum(count), end_id).astype(np.uint16)
            ids, doc_ids, sizes = np.concatenate([ids, found]), doc_ids + part, np.concatenate([sizes, count + 1])
            while len(ids) >= block_ids:  # whole documents
                n = int(np.searchsorted(np.cumsum(sizes), block_ids)) + 1
                yield row(n)
                ids, doc_ids, sizes, block = ids[int(sizes[:n].sum()) :], doc_ids[n:], sizes[n:], block + 1
        if doc_ids:
            yield row(len(doc_ids))

    names = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")]
    types = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
    dealt.mapInArrow(pack, BLOCK_SCHEMA).write.parquet(path)


def _chunks(batches):
    """(ids, texts) of batches of (doc_id, text), as many together as make CHUNK_BYTES."""
    ids, texts, size = [], [], 0
    for batch in batches:
        ids += batch.column(0).to_pylist()
        texts.append(batch.column(1))
        size += batch.column(1).nbytes
        if size >= CHUNK_BYTES:
            yield ids, pa.concat_arrays(texts)
            ids, texts, size = [], [], 0
    if ids:
        yield ids, pa.concat_arrays(texts)


def read(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of the files; ``ids`` are little-endian unsigned 32-bit."""
    return _located(spark, path, "ids binary", lambda ids: ids.astype("<u4").tobytes(), pa.binary())


def read_checksums(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the files."""
    return _located(spark, path, "ids_crc32 long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), pa.int64())


def _located(spark, path: str, column: str, value, kind) -> DataFrame:
    blocks = session(spark).read.schema(BLOCK_SCHEMA).parquet(path)

    def unpack(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                one = {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}
                stored = Block(np.frombuffer(one["symbols"], "<u2"), np.frombuffer(one["rules"], "<u2").reshape(-1, 2), np.frombuffer(one["rule_sizes"], "<u4"), one["base"])
                sizes = np.array(one["doc_sizes"], np.int64)
                ends = np.cumsum(sizes)
                found, m, lo = [], len(sizes), 0
                while lo < m:  # documents of about DECODE_IDS ids at a time
                    at = int(ends[lo] - sizes[lo])
                    hi = max(lo + 1, int(np.searchsorted(ends, at + DECODE_IDS, side="right")))
                    ids = stored.ids(at, int(ends[hi - 1]) - at)
                    found += [value(ids[e - n - at : e - at]) for n, e in zip(sizes[lo:hi].tolist(), ends[lo:hi].tolist())]
                    lo = hi
                yield pa.RecordBatch.from_arrays([pa.array([one["shard"]] * m, pa.int32()), pa.array([one["block"]] * m, pa.int32()), pa.array(one["doc_ids"], pa.int64()), pa.array(ends - sizes), pa.array(sizes), pa.array(found, kind)], names=["_shard", "_block", "doc_id", "_at", "n_tokens", column.split()[0]])

    docs = blocks.mapInArrow(unpack, f"_shard int, _block int, doc_id long, _at long, n_tokens long, {column}")
    # Ids before a block: those of earlier groups of SHARD_GROUP shards, earlier shards of its group, and earlier blocks.
    sizes = blocks.select("shard", "block", "n_ids")
    group = F.floor(F.col("s") / SHARD_GROUP).alias("g")
    per_shard = sizes.groupBy(F.col("shard").alias("s")).agg(F.sum("n_ids").alias("n")).select("s", group, "n")
    earlier = lambda window: F.coalesce(F.sum("n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = per_shard.groupBy("g").agg(F.sum("n").alias("n")).select(F.col("g").alias("_g"), earlier(Window.orderBy("g")).alias("group_at"))
    shards = per_shard.select("s", "g", earlier(Window.partitionBy("g").orderBy("s")).alias("in_group")).join(groups, F.col("g") == F.col("_g")).select("s", (F.col("in_group") + F.col("group_at")).alias("shard_at"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.withColumn("block_at", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(shards, F.col("shard") == F.col("s"))
    begins = materialize(begins.select("shard", "block", (F.col("shard_at") + F.col("block_at")).alias("begin")), "begins")
    joined = docs.join(begins, (F.col("_shard") == F.col("shard")) & (F.col("_block") == F.col("block")))
    return joined.select("doc_id", (F.col("begin") + F.col("_at")).alias("start"), "n_tokens", column.split()[0])
