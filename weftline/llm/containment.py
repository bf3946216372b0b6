"""Evaluation texts leaking into training text.

Method: MinHash containment search with the sets partitioned by size, then verification by exact shingle
containment. A leak may be one passage of 12 words in a document of thousands, which no MinHash of
whole documents can show; so documents and items alike are partitioned into passages of one size, the
length that counts as a leak. A passage is a set of eight shingles of five words, and its MinHash under one
hash function is the least of their hashes: equal passages have equal minima, hence no leak is missed, and
overlapping passages mostly share theirs, hence few are looked up twice. Candidates are verified by
their words.
"""

from __future__ import annotations

import re
from collections import deque

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.columns import col, require, stored

__all__ = ["leaked_items", "PASSAGE_WORDS", "SHINGLE_WORDS", "BLOCK_MINIMA", "MAP_BITS"]

PASSAGE_WORDS = 12
SHINGLE_WORDS = 5

#: Minima of items that are broadcast as they are (32 MiB). Those of more items set bits in a map of fixed size (32 MiB).
BLOCK_MINIMA = 1 << 22
MAP_BITS = 1 << 28

#: Characters that are worked on together. A longer text is cut between words, with the words before each cut again.
PIECE_CHARACTERS = 4_000_000

_WORD = re.compile(r"[^\W_]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _pieces(text: str, overlap: int):
    """The text, in pieces that share ``overlap`` words if it is very long."""
    begin, before = 0, deque(maxlen=overlap)
    if len(text) > PIECE_CHARACTERS:
        for m in _WORD.finditer(text):
            if m.start() - begin >= PIECE_CHARACTERS:
                yield text[begin : m.start()]
                begin = before[0] if before else m.start()
            before.append(m.start())
    yield text[begin:]


def _loads(batch: pa.RecordBatch, overlap: int):
    """Lists of texts, with the rows that they are of, of bounded size."""
    rows, texts, size = [], [], 0
    for row, text in enumerate(batch.column(1)):
        for piece in _pieces(text.as_py() or "", overlap):
            rows.append(row), texts.append(piece)
            size += len(piece)
            if size >= PIECE_CHARACTERS:
                yield rows, texts
                rows, texts, size = [], [], 0
    if rows:
        yield rows, texts


class _Passages:
    """The words of a batch of texts, one after the other, and the minimum of every passage."""

    def __init__(self, texts: list[str], length: int, shingle: int):
        found = [_WORD.findall(t) for t in texts]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        self.doc = np.repeat(np.arange(len(found)), counts)
        coded = pa.array([w for words in found for w in words], pa.string()).dictionary_encode()
        self.words = [w.lower() for w in coded.dictionary.to_pylist()]
        self.codes = coded.indices.to_numpy()
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in self.words), np.uint64, len(self.words))
        h = hashes[self.codes]
        n = len(h) - length + 1
        if n <= 0:
            self.at, self.minima = np.zeros(0, np.int64), np.zeros(0, np.uint64)
            return
        grams = np.zeros(len(h) - shingle + 1, np.uint64)
        for i in range(shingle):
            grams = grams * _ODD + h[i : i + len(grams)]
        grams = _mixed(grams)
        width = length - shingle + 1
        least = grams[:n].copy()
        for i in range(1, width):
            np.minimum(least, grams[i : i + n], out=least)
        self.at = np.flatnonzero(self.doc[:n] == self.doc[length - 1 :])
        self.minima = least[self.at]

    def text(self, at: int, length: int) -> str:
        return " ".join(self.words[c] for c in self.codes[at : at + length])


class _Listed:
    """Some minima, sorted."""

    def __init__(self, minima: np.ndarray):
        self.minima = np.sort(minima)

    def has(self, asked: np.ndarray) -> np.ndarray:
        if not len(self.minima):
            return np.zeros(len(asked), bool)
        return self.minima[np.minimum(np.searchsorted(self.minima, asked), len(self.minima) - 1)] == asked


class _Mapped:
    """Any number of minima, as bits of a map: it knows all of them, and few or many others."""

    def __init__(self, minima: DataFrame, bits: int):
        at = F.col("minimum").bitwiseAND(F.lit(bits - 1))
        set_ = minima.select(at.alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toArrow()
        self.words = np.zeros(bits // 64, np.uint64)
        self.words[set_["word"].to_numpy()] = set_["bits"].to_numpy().view(np.uint64)

    def has(self, asked: np.ndarray) -> np.ndarray:
        p = asked & np.uint64(64 * len(self.words) - 1)
        return (self.words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1


def _schema(df: DataFrame, key: str) -> T.StructType:
    return T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("passage", T.StringType()), T.StructField("minimum", T.LongType())])


def _rows(df: DataFrame, key: str, text: str, length: int, shingle: int, wanted=None) -> DataFrame:
    """``(key, passage, minimum)``: all passages, or those whose minimum may be among the broadcast ``wanted`` ones."""

    def find(batches):
        for b in batches:
            for rows, texts in _loads(b, length - 1):
                p = _Passages(texts, length, shingle)
                at, minima = p.at, p.minima
                if wanted is not None and len(at):
                    hit = wanted.value.has(minima)
                    at, minima = at[hit], minima[hit]
                seen = {}
                for a, m in zip(at.tolist(), minima.view(np.int64).tolist()):
                    seen.setdefault((rows[p.doc[a]], p.text(a, length)), m)
                if seen:
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array([r for r, _ in seen], pa.int64())), pa.array([t for _, t in seen], pa.string()), pa.array(list(seen.values()), pa.int64())],
                        names=["key", "passage", "minimum"],
                    )

    return df.select(col(key).alias("key"), col(text).cast("string").alias("text")).mapInArrow(find, _schema(df, key))


def leaked_items(
    documents: DataFrame,
    items: DataFrame,
    *,
    document_id: str,
    document_text: str,
    item_id: str,
    item_text: str,
    passage_words: int = PASSAGE_WORDS,
    shingle_words: int = SHINGLE_WORDS,
    block_minima: int = BLOCK_MINIMA,
    map_bits: int = MAP_BITS,
) -> DataFrame:
    """``(document_id, item_id)``: each pair whose texts share ``passage_words`` consecutive words.

    A word is a longest run of letters or digits, in lower case; all between words is ignored. Whole
    texts are searched. Null and empty texts, and texts of fewer words than a passage, share nothing;
    repeated rows give a pair once; null identifiers are kept as they are; further columns are ignored,
    and an empty table gives an empty result.

    Documents are read once, however many items there are. Up to ``block_minima`` minima of the items are broadcast as a
    list; of more, a map of fixed size is, which lets further passages through to the exact join on passages.
    """
    require(documents, document_id, document_text)
    require(items, item_id, item_text)
    if not 0 < shingle_words <= passage_words:
        raise ValueError("a passage is at least as long as a shingle")
    spark = documents.sparkSession
    passages = stored(_rows(items, item_id, item_text, passage_words, shingle_words))
    minima = passages.select("minimum").distinct()
    if minima.count() <= block_minima:
        wanted = _Listed(minima.toArrow().column(0).to_numpy().view(np.uint64))
    else:
        wanted = _Mapped(minima, map_bits)
    hits = _rows(documents, document_id, document_text, passage_words, shingle_words, spark.sparkContext.broadcast(wanted))
    proven = hits.select(F.col("key").alias(document_id), "passage").join(passages.select(F.col("key").alias("__item"), "passage").distinct(), "passage")
    return proven.select(col(document_id), F.col("__item").alias(item_id)).distinct()
