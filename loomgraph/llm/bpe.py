"""Encoding with a public byte-level BPE vocabulary by prefix-sharing trie traversal.

For a byte string only the *last* token of each prefix's encoding has to be known: the encoding of
a prefix of length n ends with a token t, and before it stands the encoding of the prefix of length
n - len(t).  t is the one suffix token that may follow that prefix's last token, i.e. the two stay
two tokens when their joined bytes are encoded.  Words in sorted order are a depth-first traversal
of their trie, so a stack with one last token per byte holds all states of the current branch, and
a prefix that several words share is worked out once.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words kept with their ids per Python worker, about 60 MB; then the memory starts anew.
CACHE_WORDS = 200_000
#: Longer words (characters) are encoded each time they occur.
CACHE_WORD_LEN = 64


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class TrieEncoder:
    """Encoder over a rank file (a line per token: base64 of its bytes, its rank)."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        lens: dict[bytes, set[int]] = {}
        for t in self.ranks:
            lens.setdefault(t[-2:], set()).add(len(t))
        #: lengths of tokens that end with these two bytes, longest first; one byte always fits
        self.lens = {k: sorted(v, reverse=True) for k, v in lens.items()}
        self.follows: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.cache: dict[str, tuple[int, ...]] = {}

    def merge(self, word: bytes) -> list[int]:
        """Plain BPE of a short string: merge the lowest-ranked neighbours until none is left."""
        parts = [word[i : i + 1] for i in range(len(word))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _may_follow(self, a: int, b: int) -> bool:
        ok = self.follows.get((a, b))
        if ok is None:
            if len(self.follows) > 1_000_000:
                self.follows.clear()
            ok = self.follows[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return ok

    def _is_whole(self, t: int) -> bool:
        ok = self.whole.get(t)
        if ok is None:
            ok = self.whole[t] = self.merge(self.bytes_of[t]) == [t]
        return ok

    def encode_words(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, tuple[int, ...]]]:
        """(word, ids) of distinct words, which must come in sorted order."""
        ranks, lens = self.ranks, self.lens
        follows = self.follows
        last: list[int] = []
        size: list[int] = []
        before = b""
        for word in words:
            n, same = len(word), 0
            for x, y in zip(word, before, strict=False):
                if x != y:
                    break
                same += 1
            del last[same:], size[same:]
            for i in range(same + 1, n + 1):
                for k in lens.get(word[i - 2 : i] if i > 1 else word[:1], ()):
                    if k > i:
                        continue
                    t = ranks.get(word[i - k : i])
                    if t is None:
                        continue
                    if k == i:
                        if not self._is_whole(t):
                            continue
                    else:
                        p = last[i - k - 1]
                        ok = follows.get((p, t))
                        if not (self._may_follow(p, t) if ok is None else ok):
                            continue
                    break
                else:
                    t, k = ranks[word[i - 1 : i]], 1
                last.append(t)
                size.append(k)
            ids, i = [], n
            while i:
                ids.append(last[i - 1])
                i -= size[i - 1]
            yield word, tuple(ids[::-1])
            before = word

    def encode_batch(self, texts: list[str | None]) -> tuple[list[int], list[int]]:
        """Flat ids of all texts, and the offset at which each text's ids begin (one more at the end)."""
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        split = [self.split(t) if t else () for t in texts]
        new = set().union(*split).difference(cache)
        long = []
        for w, ids in self.encode_words(sorted(w.encode("utf-8") for w in new)):
            s = w.decode("utf-8")
            cache[s] = ids
            if len(s) > CACHE_WORD_LEN:
                long.append(s)
        flat: list[int] = []
        offsets = [0]
        get = cache.__getitem__
        for ws in split:
            flat += chain.from_iterable(map(get, ws))
            offsets.append(len(flat))
        for s in long:
            del cache[s]
        return flat, offsets


_ENCODERS: dict[tuple[str, str], TrieEncoder] = {}


def encoder(ranks_path: str, pattern: str) -> TrieEncoder:
    """This process's encoder for a rank file; Python workers are reused, so it is read once each."""
    if (ranks_path, pattern) not in _ENCODERS:
        _ENCODERS[ranks_path, pattern] = TrieEncoder(ranks_path, pattern)
    return _ENCODERS[ranks_path, pattern]


#: Characters of text handled at once within an Arrow batch.
SLICE_CHARS = 4_000_000


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    begin = chars = 0
    for i, t in enumerate(texts):
        chars += len(t or "")
        if chars >= SLICE_CHARS:
            yield begin, i + 1
            begin, chars = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encode(docs: DataFrame, key: str, text: str, ranks_path: str | None = None, counts_only: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """``key``, the columns ``keep`` and ``ids`` (array of int), or ``n_tokens`` (bigint) with ``counts_only``.

    One row for each row of ``docs``, repeated keys included; an empty and a null text give an empty
    list.  Texts are encoded whole where they lie: no shuffle, no tokens added, strings that are
    special tokens elsewhere are ordinary text.
    """
    path, pattern = ranks_path or vocabulary_path(), _pattern()
    names = (key, *keep)
    fields = [T.StructField(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(names)]
    out = T.StructField("n_tokens", T.LongType()) if counts_only else T.StructField("ids", T.ArrayType(T.IntegerType()))

    def run(batches):
        enc = encoder(path, pattern)
        for b in batches:
            texts = b.column(len(names)).to_pylist()
            for i, j in _slices(texts):
                flat, offsets = enc.encode_batch(texts[i:j])
                if counts_only:
                    col = pa.array([y - x for x, y in zip(offsets, offsets[1:], strict=False)], pa.int64())
                else:
                    col = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(x).slice(i, j - i) for x in range(len(names))] + [col], names=[f.name for f in fields] + [out.name])

    src = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(names)], F.col(text).alias("t"))
    got = src.mapInArrow(run, T.StructType([*fields, out]))
    return got.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)], out.name)
