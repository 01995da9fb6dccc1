"""Evaluation texts inside training text.

A passage is a window of ``words`` consecutive words of a test item.  With an
error budget of k words, each passage is split into k+1 pieces, of which at
least one occurs unchanged wherever the passage occurs with at most k edits
(pigeonhole).  One pass over the documents looks every window of a piece's
length up in a bit table of the pieces' hashes, whose size is bounded whatever
the number of items; what passes meets the pieces by a join on the hash, with
the words around it, and is verified there by Myers' bit-parallel edit distance
over words.  So no task holds all items, and none holds a document's pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Cut
from ..sources.tables import table

WORDS, ERRORS = 12, 1
#: Bits of the table per piece, and in all (32 MB): more pieces let more windows pass to the join, which is exact.
BITS_PER_PIECE, MOST_BITS = 32, 1 << 28
#: Distinct words whose hashes a worker remembers.
REMEMBERED = 1_000_000

_WORD_BYTES = bytes(b if chr(b).isascii() and chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str | None) -> list[str]:
    """Longest runs of ASCII letters and digits, in lower case; everything else separates."""
    if not text:
        return []
    return text.encode("utf-8", "replace").lower().translate(_WORD_BYTES).decode("ascii").split()


def myers(pattern: list[str], text: list[str]) -> int:
    """Least edit distance (whole words) of the pattern to any stretch of the text, bit-parallel."""
    m = len(pattern)
    if not m:
        return 0
    peq: dict[str, int] = {}
    for i, w in enumerate(pattern):
        peq[w] = peq.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    pv, mv, score, best = full, 0, m, m
    for w in text:
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += 1 if ph & top else -1 if mh & top else 0
        ph, mh = ph << 1 & full, mh << 1 & full  # a match may begin anywhere: the top row stays 0
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        best = min(best, score)
    return best


def cuts_of(words: int, errors: int) -> list[tuple[int, int]]:
    """Where a passage's pieces begin and end."""
    size = words // (errors + 1)
    return [(k * size, (k + 1) * size) for k in range(errors)] + [(errors * size, words)]


_STEP = np.uint64(0x9E3779B97F4A7C15)
_hashes: dict[str, int] = {}


def window_hashes(words: list[str], length: int) -> np.ndarray:
    """A 64-bit hash of every window of ``length`` consecutive words."""
    if len(_hashes) > REMEMBERED:
        _hashes.clear()
    for w in words:
        if w not in _hashes:
            _hashes[w] = xxhash.xxh3_64_intdigest(w)
    own = np.array([_hashes[w] for w in words], dtype=np.uint64)
    n = len(words) - length + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for i in range(length if n > 0 else 0):
        out = out * _STEP + own[i : i + n]
    return out ^ (out >> np.uint64(29))


def places(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """The two bits of each hash in a table of so many bits (a power of two)."""
    return [(h & np.uint64(bits - 1)).astype(np.int64), ((h >> np.uint64(32)) * np.uint64(0x85EBCA6B) & np.uint64(bits - 1)).astype(np.int64)]


def _pieces(words: int, errors: int):
    """Pieces of items with the words of all passages that hold them."""
    columns = ["h", "item_id", "item_words", "item_at", "length"]

    def rows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for item, text in zip(pdf["item_id"], pdf["item_text"]):
                w = words_of(text)
                for length in {b - a for a, b in cuts_of(words, errors)}:
                    h = window_hashes(w, length).view(np.int64)
                    starts = {at + a for at in range(len(w) - words + 1) for a, b in cuts_of(words, errors) if b - a == length}
                    for at in starts:
                        first = max(0, at + length - words)
                        out.append((h[at], item, " ".join(w[first : at + words]), at - first, length))
            yield pd.DataFrame(out, columns=columns)

    return rows


def _hits(shared, words: int, errors: int):
    """Windows of documents that the bit table knows, with the words around them."""

    def rows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for pdf in it:
            out = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                w = words_of(text)
                if len(w) < words - errors:
                    continue
                for length in {b - a for a, b in cuts_of(words, errors)}:
                    h = window_hashes(w, length)
                    one, two = places(h, len(known) * 8)
                    there = (known[one >> 3] >> (one & 7) & 1) & (known[two >> 3] >> (two & 7) & 1)
                    for at in np.flatnonzero(there).tolist():
                        first = max(0, at + length - words - errors)
                        out.append((h[at].astype(np.int64), doc, " ".join(w[first : at + words + errors]), at - first, length))
            yield pd.DataFrame(out, columns=["h", "doc_id", "doc_words", "doc_at", "length"])

    return rows


def distance(item: list[str], item_at: int, doc: list[str], doc_at: int, length: int, words: int, errors: int, known: int | None = None) -> int:
    """Least edits of a passage of the item that holds the piece at ``item_at`` to the document around the piece at ``doc_at``; errors + 1 if none is within the budget.

    Where a distance of 1 is ``known`` already, only 0 is looked for.
    """
    starts = range(max(0, item_at + length - words), min(item_at, len(item) - words) + 1)
    offsets = [(s, doc_at - item_at + s) for s in starts]
    if any(at >= 0 and doc[at : at + words] == item[s : s + words] for s, at in offsets):
        return 0
    if doc[doc_at : doc_at + length] != item[item_at : item_at + length]:
        return errors + 1  # equal hashes of different words
    if known == 1:
        return 1
    return min((myers(item[s : s + words], doc[max(0, at - errors) : max(0, at + words + errors)]) for s, at in offsets), default=errors + 1) if errors else 1


def _verify(words: int, errors: int):
    def rows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple[int, int], int] = {}
        for pdf in it:
            for doc, item, dw, da, iw, ia, length in zip(*(pdf[c].tolist() for c in ("doc_id", "item_id", "doc_words", "doc_at", "item_words", "item_at", "length"))):
                least = found.get((doc, item), errors + 1)
                if least and (d := distance(iw.split(), ia, dw.split(), da, length, words, errors, least)) < least:
                    found[doc, item] = d
            if len(found) > REMEMBERED:  # the least of a pair is taken once more behind it
                yield pd.DataFrame([(*k, d) for k, d in found.items()], columns=["doc_id", "item_id", "distance"])
                found.clear()
        yield pd.DataFrame([(*k, d) for k, d in found.items()], columns=["doc_id", "item_id", "distance"])

    return rows


def bit_table(pieces: DataFrame, n: int) -> np.ndarray:
    """The bits of all pieces; their number follows the pieces up to MOST_BITS."""
    bits = 1 << 10
    while bits < min(n * BITS_PER_PIECE, MOST_BITS):
        bits *= 2

    def marks(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            every = np.unique(np.concatenate(places(pdf["h"].to_numpy(dtype=np.int64).view(np.uint64), bits)))
            yield pd.DataFrame({"byte": every >> 3, "mark": 1 << (every & 7)})

    rows = pieces.select("h").mapInPandas(marks, "byte long, mark long").groupBy("byte").agg(F.bit_or("mark").alias("mark")).toPandas()  # no more than MOST_BITS / 8
    known = np.zeros(bits // 8, dtype=np.uint8)
    known[rows["byte"].to_numpy(dtype=np.int64)] = rows["mark"].to_numpy(dtype=np.uint8)
    return known


def leaks(documents: DataFrame, items: DataFrame, words: int = WORDS, errors: int = ERRORS) -> DataFrame:
    """(doc_id, item_id, distance): documents that hold a passage of ``words`` words of an item with at most ``errors`` word edits.

    ``documents`` has doc_id and text, ``items`` item_id and item_text.  The
    documents are read once, whatever the number of items.  Null and empty
    texts, null ids and items shorter than a passage find nothing; items with
    equal text each count.
    """
    spark = documents.sparkSession
    cut = Cut(spark, "leakage")
    asked = items.where("item_id IS NOT NULL AND item_text IS NOT NULL").select("item_id", "item_text").distinct()
    pieces, counts = cut.put_counted(asked.mapInPandas(_pieces(words, errors), "h long, item_id long, item_words string, item_at int, length int"), all=F.count(F.lit(1)))
    shared = spark.sparkContext.broadcast(bit_table(pieces, counts["all"]))
    texts = documents.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    hits = texts.mapInPandas(_hits(shared, words, errors), "h long, doc_id long, doc_words string, doc_at int, length int")
    met = hits.join(pieces, ["h", "length"])
    found = met.mapInPandas(_verify(words, errors), "doc_id long, item_id long, distance long")
    return found.where(F.col("distance") <= errors).groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))


def corpus_leaks(spark: SparkSession, where: str) -> DataFrame:
    return leaks(table(spark, where, "documents"), table(spark, where, "eval_items"))


def p7_found(spark: SparkSession, where: str) -> DataFrame:
    """Documents with at least 12 consecutive words of an item: the passages found without any edit."""
    return corpus_leaks(spark, where).where("distance = 0").select("doc_id", "item_id")


def p7_leaked_items(spark: SparkSession, where: str) -> DataFrame:
    """Per item that leaked: documents with an exact passage, and with one of one edited word."""
    leaked = corpus_leaks(spark, where).groupBy("item_id").agg(F.count_if(F.col("distance") == 0).alias("exact_documents"), F.count_if(F.col("distance") > 0).alias("edited_documents"))
    return leaked.join(table(spark, where, "eval_items").select("item_id", "suite"), "item_id")
