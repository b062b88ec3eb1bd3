"""Token counts by a linear longest-match automaton.

The vocabulary is a trie over bytes. Each node has a failure link to the node that is reached after popping the
tokens which the longest-match rule is then bound to take, and the count of those tokens (Song et al. 2021, Fast
WordPiece Tokenization). A word is followed by an end mark and read once: its greedy longest-match length comes out
without building a piece, and each byte is looked at a constant number of times in the mean.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; a word that the vocabulary cannot spell counts
as one unknown token.

Cases: a null text has no word; repeated rows get equal results; an empty table gives an empty result; a very long
word takes linear time.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, session, worker_state

#: Symbol after the last byte of a word.
END = 256
CACHE_SIZE, CACHE_LENGTH = 1 << 18, 64
MAX_VOCABULARY = 2_000_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class LongestMatch:
    """``vocabulary``: tokens as bytes, and whether each ends a word."""

    def __init__(self, vocabulary: list[tuple[bytes, bool]]):
        self.next: list[dict[int, int]] = [{}]
        token = [False]
        for spelled, ends in vocabulary:
            at = 0
            for symbol in (*spelled, *([END] if ends else [])):
                to = self.next[at].get(symbol)
                if to is None:
                    to = len(self.next)
                    self.next[at][symbol] = to
                    self.next.append({})
                    token.append(False)
                at = to
            token[at] = at != 0
        n = len(self.next)
        self.token, self.fail, self.popped = token, [-1] * n, [0] * n
        queue = [0]
        for at in queue:
            for symbol, to in self.next[at].items():
                queue.append(to)
                if token[to]:  # the whole prefix is the longest token
                    self.fail[to], self.popped[to] = 0, 1
                    continue
                link, pops = self.fail[at], self.popped[at]
                while link >= 0 and symbol not in self.next[link]:
                    link, pops = self.fail[link], pops + self.popped[link]
                if link >= 0:
                    self.fail[to], self.popped[to] = self.next[link][symbol], pops

    def count(self, word: bytes) -> int:
        """Tokens of the greedy longest-match split of ``word`` and its end mark; 1 where there is none."""
        step, fail, popped = self.next, self.fail, self.popped
        at = total = 0
        for symbol in (*word, END):
            while (to := step[at].get(symbol)) is None:
                if at == 0 or fail[at] < 0:
                    return 1
                total += popped[at]
                at = fail[at]
            at = to
        while at:
            if fail[at] < 0:
                return 1
            total += popped[at]
            at = fail[at]
        return total


def token_counts(docs: DataFrame, vocabulary: list[tuple[bytes, bool]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words and n_tokens (long) of every row. The vocabulary (size checked) is broadcast."""
    if len(vocabulary) > MAX_VOCABULARY:
        raise ValueError(f"the vocabulary has over {MAX_VOCABULARY} tokens")
    spark = session(docs.sparkSession)
    shared = Shared(spark, vocabulary)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))

    def run(batches):
        match, cache = worker_state("wordpiece", shared.key, lambda: (LongestMatch(shared.value), {}))
        for batch in batches:
            words, tokens = [], []
            for text in batch.column(1):
                seen = Counter((text.as_py() or b"").translate(_LOWER).split())  # of bytes, split() knows just the six spaces
                total = 0
                for word, times in seen.items():
                    n = cache.get(word)
                    if n is None:
                        n = match.count(word)
                        if len(word) <= CACHE_LENGTH:
                            if len(cache) >= CACHE_SIZE:
                                cache.clear()
                            cache[word] = n
                    total += n * times
                words.append(sum(seen.values()))
                tokens.append(total)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, n_words long, n_tokens long")


def word_end_vocabulary(tokens: list[str], alphabet: dict[str, int], mark: str = "</w>", special: tuple[str, ...] = ()) -> list[tuple[bytes, bool]]:
    """Byte spellings of a vocabulary that writes bytes as ``alphabet`` characters and word ends as ``mark``."""
    out = []
    for token in sorted(tokens):
        ends = token.endswith(mark)
        body = token[: -len(mark)] if ends else token
        if token not in special and body and all(c in alphabet for c in body):
            out.append((bytes(alphabet[c] for c in body), ends))
    return out


def byte_alphabet() -> dict[str, int]:
    """Character of each byte in byte-level vocabularies: printable bytes stand for themselves, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
