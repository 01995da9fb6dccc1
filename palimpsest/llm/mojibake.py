"""Garbled text from wrong character encoding.

Learning.  Documents are cut into windows of a few tokens.  A window's skeleton
is its text stripped of non-ASCII characters (a mark where a run was), its
filling the runs.  Windows of one skeleton are near-twins; the filling that most
of them have is the clean one, and every other filling is aligned with it run
by run and character by character.  Where a run has as many characters as its
clean twin has UTF-8 bytes, each character stands for one byte; where it has as
many characters, each stands for one character.  What the alignments agree on
is a mapping; alignments that contradict it teach the next one.  No encoding is
known beforehand.  Characters lost to U+FFFD are learned where all other
characters of the aligned runs agree.

Applying.  The learned mappings are applied to every record: sequences that
decode to characters of the corpus are repaired, again and again while anything
changes (text may be garbled twice).  A mapping of single characters, which
turns any text into some text, is applied where the corpus's own character
pairs prefer the repaired word.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lookup import skew_lookup
from ..session import Cut
from ..sources.tables import table

LOST = "�"

#: Garbled windows in documents that the first piece of a mapping needs, and how much more often than its garbled ones its clean windows must occur.
MIN_TWINS, CLEANER = 2, 2
#: Characters that a mapping of single characters must cover; fewer are variants in spelling, not another encoding.
MIN_LETTERS = 8
#: Documents of the corpus that must hold a character for it to count as one that texts are written in.
MIN_DOCUMENTS = 3
#: ASCII letters that make a skeleton telling by itself, and non-ASCII characters that a window without them needs.
TELLING, ENOUGH = 4, 10
#: Nats in favour of a repaired word, and of all repaired words of a text together.
WORD_GAIN, TEXT_GAIN = 4.0, 12.0
#: Characters from here on (symbols, CJK) have no part in the model of character pairs, so its size is bounded.
PAIR_LIMIT = 0x2600

#: Marks that close a quotation, a name or a clause.
CLOSING = "”’…™–—»®"

_RUN = re.compile(r"[^\x00-\x7f]+")
_LETTER = re.compile(r"[A-Za-z]")
#: Controls that stand for bytes which common encodings leave undefined; text garbled twice passes through them.
_PASSING = set("\x81\x8d\x8f\x90\x9d")
_MARK, _JOIN, _EXACT, _BYTES = "\x00", "\x01", "\x02", "\x04"


@dataclass(frozen=True)
class Mapping:
    """A learned mapping: of characters to the bytes of UTF-8 text (``bytes``), or to characters."""

    bytes: dict[str, int]
    letters: dict[str, str]

    @functools.cached_property
    def pattern(self) -> re.Pattern | None:
        """Sequences of characters whose bytes make up one UTF-8 character."""

        def some(a: int, b: int) -> str:
            found = "".join(re.escape(c) for c, x in self.bytes.items() if a <= x <= b)
            return f"[{found}]" if found else "(?!)"

        tail = some(0x80, 0xBF)
        return re.compile(f"{some(0xC2, 0xDF)}{tail}|{some(0xE0, 0xEF)}{tail}{{2}}|{some(0xF0, 0xF4)}{tail}{{3}}")

    @functools.cached_property
    def ends(self) -> tuple[frozenset, frozenset]:
        """Characters that begin such sequences, and those that go on with one."""
        return frozenset(c for c, b in self.bytes.items() if b >= 0xC2), frozenset(c for c, b in self.bytes.items() if b <= 0xBF)

    @functools.cached_property
    def _chars(self) -> dict[int, str]:
        return {b: c for c, b in reversed(self.bytes.items())}  # the first learned of a byte's characters

    def garble(self, text: str) -> str | None:
        """What the mapping would make of a text; None if a byte's character is unknown. ASCII stays."""
        chars = [chr(b) if b < 128 else self._chars.get(b) for b in text.encode("utf-8", "replace")]
        return None if None in chars else "".join(chars)

    def goes_with(self, pieces: set[tuple[str, str]]) -> bool:
        """Whether aligned pieces of bytes share an entry with the mapping and contradict none."""
        said = [(x, y) for g, c in pieces for x, y in zip(g, c.encode("utf-8", "replace"))]
        return any(self.bytes.get(x) == y >= 0xC2 for x, y in said) and all(self.bytes.get(x, y) == y and (y < 0xC2 or self._chars.get(y, x) == x) for x, y in said)

    def undo(self, text: str) -> str | None:
        """What the text was; None if some of its characters are not mapped, or no text. ASCII stays."""
        if self.letters:
            return "".join(self.letters[c] for c in text) if all(c in self.letters for c in text) else None
        back = [ord(c) if c < "\x80" else self.bytes.get(c, -1) for c in text]
        try:
            return bytes(back).decode()
        except ValueError:  # a character without byte, or bytes that are no UTF-8
            return None


def windows(text: str) -> set[tuple[str, str]]:
    """(skeleton, filling) of the windows around the tokens with non-ASCII characters.

    A window is a token with both neighbours.  Where it has too few ASCII
    letters to tell texts apart, the skeleton also holds the runs' lengths.  A
    token of a script without ASCII letters stands alone too, under the lengths
    of its runs and under their lengths in UTF-8: garbled text has as many
    characters as its clean twin has bytes.
    """
    found = set()
    for line in re.split(r"[\n\r]+", text):
        if line.isascii():
            continue
        tokens = re.split(r"[ \t]+", line)
        for i, token in enumerate(tokens):
            if token.isascii():
                continue
            window = " ".join(tokens[max(0, i - 1) : i + 2])
            runs = _RUN.findall(window)
            if len(_LETTER.findall(window)) >= TELLING:
                found.add((_RUN.sub(_MARK, window), _JOIN.join(runs)))
            if sum(map(len, runs)) >= ENOUGH:
                found.add((_EXACT + _RUN.sub(lambda m: f"{_MARK}{len(m.group())}{_MARK}", window), _JOIN.join(runs)))
            own = _RUN.findall(token)
            if sum(len(r.encode("utf-8", "replace")) for r in own) >= ENOUGH and len(_LETTER.findall(token)) < TELLING:
                found.add((_BYTES + _RUN.sub(lambda m: f"{_MARK}{len(m.group().encode('utf-8', 'replace'))}{_MARK}", token), _JOIN.join(own)))
                if sum(map(len, own)) >= ENOUGH:
                    found.add((_BYTES + _RUN.sub(lambda m: f"{_MARK}{len(m.group())}{_MARK}", token), _JOIN.join(own)))
    return found


def non_ascii(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL AND octet_length(text) <> length(text)")


def _read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Windows of documents, and after them the characters of the documents (in how many) and the pairs of non-ASCII characters (how often)."""
    columns = ["doc_id", "skeleton", "filling", "n"]
    seen: Counter = Counter()
    for pdf in it:
        for at in range(0, len(pdf), 200):
            part, rows = pdf.iloc[at : at + 200], []
            for d, text in zip(part["doc_id"], part["text"]):
                rows.extend((d, s, f, 1) for s, f in windows(text))
                runs = _RUN.findall(text)
                seen.update(set("".join(runs)))
                for run in runs:
                    seen.update(a + b for a, b in zip(run, run[1:]) if ord(a) < PAIR_LIMIT and ord(b) < PAIR_LIMIT)
            yield pd.DataFrame(rows, columns=columns)
    yield pd.DataFrame([(-1, None, what, n) for what, n in seen.items()], columns=columns)


def read(documents: DataFrame, cut: Cut) -> tuple[DataFrame, DataFrame]:
    """(windows per document, counts of characters and character pairs) in one pass over the texts, written once."""
    every = cut.put(non_ascii(documents).mapInPandas(_read, "doc_id long, skeleton string, filling string, n long"))[1]
    counts = every.where("skeleton IS NULL").groupBy(F.col("filling").alias("what")).agg(F.sum("n").alias("n"))
    return every.where("skeleton IS NOT NULL").select("doc_id", "skeleton", "filling"), counts


def align(garbled: str, clean: str) -> tuple[bool, set[tuple[str, str]]] | None:
    """Which pieces of a garbled filling stand for which of its clean one: (whether for UTF-8 characters, pairs of pieces).

    A piece of UTF-8 is what one clean character became, or two that follow each
    other in the filling; a piece of single characters is a pair of neighbours.
    None if the runs do not correspond,
    both kinds are mixed, or a character would stand for two things.
    """
    old, new = garbled.split(_JOIN), clean.split(_JOIN)
    if len(old) != len(new):
        return None
    kinds, pieces, one, back, last = set(), set(), {}, {}, None
    for g, c in zip(old, new):
        if g == c:
            continue
        raw = c.encode("utf-8", "replace")
        if len(g) == len(raw):
            kinds.add(True)
            said, at = zip(g, raw), 0
            for x in c:
                piece = g[at : (at := at + len(x.encode("utf-8", "replace")))]
                pieces.add((piece, x))
                if last is not None and last[1] != x:
                    pieces.add((last[0] + piece, last[1] + x))
                last = piece, x
        elif len(g) == len(c):
            kinds.add(False)
            said = zip(g, c)
            pieces.update((g[i : i + 2], c[i : i + 2]) for i in range(max(1, len(g) - 1)))
        else:
            return None
        for x, y in said:
            if one.setdefault(x, y) != y or back.setdefault(y, x) != x:
                return None
    return (kinds.pop(), pieces) if len(kinds) == 1 else None


def _aligner(mappings: list[Mapping]):
    """Aligns fillings with their clean ones; given mappings, also text garbled twice, through what a mapping makes of the clean one.

    Single characters are compared only then, as a clean filling that a mapping
    of bytes finds garbled teaches nothing.
    """

    def rows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for garbled, clean, n in zip(pdf["garbled"], pdf["clean"], pdf["n"]):
                found = align(garbled, clean)
                if mappings and not found:
                    found = next((f for m in mappings if (once := m.garble(clean)) and (f := align(garbled, once)) and f[0] and m.goes_with(f[1])), None)
                if found and (found[0] or mappings and not any(m.pattern.search(clean) for m in mappings)):
                    out.extend((found[0], g, c, n) for g, c in found[1])
            yield pd.DataFrame(out, columns=["is_bytes", "garbled", "clean", "n"])

    return rows


def twins(every: DataFrame, cut: Cut) -> DataFrame:
    """Windows beside the clean near-twin of their skeleton: skeleton, garbled, clean, and in how many documents (n).

    A skeleton has one clean filling, the one in most documents, so there is
    one row per other filling and never all pairs; a skeleton of very many
    fillings meets its clean one by broadcast.
    """
    variants, counts = cut.put_counted(every.groupBy("skeleton", "filling").agg(F.count(F.lit(1)).alias("n")), all=F.count(F.lit(1)))
    clean = variants.where(~F.col("filling").contains(LOST)).groupBy("skeleton").agg(F.max(F.struct("n", "filling")).alias("c"), F.count(F.lit(1)).alias("k")).where("k > 1")
    clean = clean.select("skeleton", F.col("c.filling").alias("clean"), F.col("c.n").alias("n_clean"))
    met = skew_lookup(variants.withColumnRenamed("filling", "garbled"), "skeleton", clean, counts["all"])
    met = met.where((F.col("garbled") != F.col("clean")) & ~F.col("garbled").contains(LOST) & (F.col("n_clean") >= CLEANER * F.col("n")))
    return cut.put(met.select("skeleton", "garbled", "clean", "n"))[1]


def learn(met: DataFrame) -> list[Mapping]:
    """The mappings of aligned twins: of text garbled once, and with these of text garbled again and of single characters."""
    once = agree(_pieces(met, []), True)
    every = _pieces(met, once or [Mapping({}, {})])
    return agree(every, True) + agree(every, False)


def _pieces(met: DataFrame, mappings: list[Mapping]) -> list:
    """Aligned pieces and how often documents have them; no more than pairs of characters or of neighbours that texts have."""
    return met.mapInPandas(_aligner(mappings), "is_bytes boolean, garbled string, clean string, n long").groupBy("is_bytes", "garbled", "clean").agg(F.sum("n").alias("n")).collect()


def agree(pieces: list, is_bytes: bool) -> list[Mapping]:
    """The mappings that aligned pieces agree on, the best supported first.

    A mapping grows from the piece that is most frequent: pieces that share an
    entry with it (of bytes: one that begins a sequence) and contradict none add
    theirs, the better supported first.  A character stands for one thing, and
    one character for a letter or for a byte that begins a sequence: there the
    pieces of another encoding contradict.  What a mapping explains starts no
    further one.
    """

    def entries(r) -> list[tuple]:
        return list(zip(r.garbled, r.clean.encode("utf-8", "replace") if is_bytes else r.clean))

    every = sorted(((entries(r), r.n) for r in pieces if r.is_bytes == is_bytes), key=lambda p: (-p[1], p[0]))
    left, found = every, []
    while left and left[0][1] >= MIN_TWINS:
        table, back, before = dict(left[0][0]), {y: x for x, y in reversed(left[0][0])}, 0
        while len(table) > before:
            before = len(table)
            for piece, _ in every:
                if any(table.get(x) == y and (not is_bytes or y >= 0xC2) for x, y in piece) and all(table.get(x, y) == y and (is_bytes and y < 0xC2 or back.get(y, x) == x) for x, y in piece):
                    for x, y in piece:
                        table[x] = y
                        back.setdefault(y, x)
        if is_bytes or sum(x != y for x, y in table.items()) >= MIN_LETTERS:
            found.append(Mapping(table, {}) if is_bytes else Mapping({}, table))
        left = [(piece, n) for piece, n in left if any(table.get(x) != y for x, y in piece)]
    return found


def lost_twins(every: DataFrame) -> DataFrame:
    """Windows with lost characters beside the most frequent clean twin of equal lengths: doc_id, skeleton, garbled, filling.

    There is one clean partner per skeleton and lengths of the runs, so no pair
    is formed.  Kept are twins whose other characters agree.
    """
    lengths = F.array_join(F.transform(F.split("filling", _JOIN), lambda r: F.length(r).cast("string")), ",")
    sized = every.where(~F.col("skeleton").startswith(_BYTES)).withColumn("at", F.concat_ws("\x03", lengths, "skeleton"))
    broken = sized.where(F.col("filling").contains(LOST)).withColumnRenamed("filling", "garbled")
    clean = sized.where(~F.col("filling").contains(LOST)).groupBy("at", "filling").agg(F.count(F.lit(1)).alias("n"))
    clean = clean.groupBy("at").agg(F.max_by("filling", F.struct("n", "filling")).alias("filling"))
    met = skew_lookup(broken, "at", clean, every.count()).where("filling IS NOT NULL")
    agree = F.expr(f"forall(sequence(1, length(garbled)), i -> substring(garbled, i, 1) IN ('{LOST}', substring(filling, i, 1)))")
    return met.where(agree).drop("at")


def statistics(counts: DataFrame) -> tuple[set[str], dict[str, int]]:
    """Characters that the corpus is written in, and counts of its pairs of non-ASCII characters.

    Both come from all documents and are bounded by the character set: at most
    one row per character, and pairs only below PAIR_LIMIT.
    """
    rows = counts.where(F.col("n") >= MIN_DOCUMENTS).collect()
    written = {r.what for r in rows if len(r.what) == 1 and r.what != LOST and not "\x7f" <= r.what <= "\x9f" and not 0xE000 <= ord(r.what) <= 0xF8FF}
    return written, {r.what: r.n for r in rows if len(r.what) == 2}


class Repairer:
    """Applies learned mappings to whole texts."""

    def __init__(self, learned: list[Mapping], written: set[str], pairs: dict[str, int]):
        self.utf8 = [m for m in learned if m.bytes]
        self.single = [m for m in learned if m.letters]
        self.written, self.pairs = written, pairs
        self.total = math.log(sum(pairs.values()) + 1.0)

    def _decodes(self, sequence: str, m: Mapping) -> str | None:
        fixed = m.undo(sequence)
        return fixed if fixed is not None and all(c in self.written or c in _PASSING for c in fixed) else None

    def _multi(self, text: str, m: Mapping) -> tuple[str, int]:
        hits: list[tuple[str, str, str]] = []

        def put(found: re.Match) -> str:
            fixed = self._decodes(found.group(), m)
            if fixed is None:
                return found.group()
            hits.append((text[max(0, found.start() - 1) : found.start()], found.group(), text[found.end() : found.end() + 1]))
            return fixed

        out = m.pattern.sub(put, text)
        if len(hits) == 1:  # capitals before a closing mark at a word's end, as in a quoted word, are no garbling by themselves
            before, hit, after = hits[0]
            if "A" <= before <= "Z" and hit[-1] in CLOSING and not after.isalnum():
                return text, 0
        return out, len(hits)

    def _worth(self, word: str) -> float:
        return sum(math.log(self.pairs.get(a + b, 0) + 0.1) - self.total for a, b in zip(word, word[1:]))

    def _words(self, text: str, m: Mapping) -> tuple[str, int]:
        gain, n = 0.0, 0

        def put(found: re.Match) -> str:
            nonlocal gain, n
            word = found.group()
            if len(word) < 3 or (fixed := m.undo(word)) is None:
                return word
            more = self._worth(fixed) - self._worth(word)
            if more < WORD_GAIN:
                return word
            gain += more
            n += 1
            return fixed

        out = _RUN.sub(put, text)
        if gain < TEXT_GAIN:
            return text, 0
        # short words beside repaired ones follow them where that is no worse
        return _RUN.sub(lambda x: f if (f := m.undo(x.group())) is not None and self._worth(f) >= self._worth(x.group()) else x.group(), text) if n else out, n

    def repair(self, text: str) -> tuple[str, int]:
        """(repaired text, number of garbled sequences found)."""
        found = 0
        met = {text}
        while True:  # each round undoes one decoding of the whole text
            best, most = text, 0
            there = set(text)
            for h in self.utf8:
                first, more = h.ends
                if there.isdisjoint(first) or there.isdisjoint(more):
                    continue
                out, n = self._multi(text, h)
                if n > most:
                    best, most = out, n
            if not most:
                for h in self.single:
                    out, n = self._words(text, h)
                    if n > most:
                        best, most = out, n
            if not most or best in met:  # mappings of single characters could turn in a circle
                return text, found
            met.add(best)
            text, found = best, found + most


def _restore_lost(text: str, pairs: list) -> str:
    """Lost characters of a text from its windows' clean twins."""
    for pair in pairs:
        skeleton = pair["skeleton"]
        whole = re.split(f"{_MARK}\\d+{_MARK}", skeleton[1:]) if skeleton.startswith(_EXACT) else skeleton.split(_MARK)
        old, new = pair["garbled"].split(_JOIN), pair["filling"].split(_JOIN)
        if len(old) == len(new) == len(whole) - 1:
            garbled = whole[0] + "".join(o + w for o, w in zip(old, whole[1:]))
            clean = whole[0] + "".join(o + w for o, w in zip(new, whole[1:]))
            text = text.replace(garbled, clean)
    return text


def garbled_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, sequences, restored): documents with garbled sequences, how many, and the text restored as far as possible.

    Null, empty and pure ASCII texts are never garbled; null ids are left out.  Lost characters whose
    window has no clean twin stay lost in ``restored``.  With no twins in the
    corpus nothing is learned and nothing found.  Copies are judged alike.
    """
    cut = Cut(documents.sparkSession, "mojibake")
    every, counts = read(documents, cut)
    learned = learn(twins(every, cut))
    lost = cut.put(lost_twins(every))[1]
    lossy = lost.select("garbled", "filling").distinct().limit(MIN_TWINS).count() >= MIN_TWINS
    written, pairs = statistics(counts)
    shared = documents.sparkSession.sparkContext.broadcast((learned, written, pairs if any(m.letters for m in learned) else {}))

    def judge(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repairer = Repairer(*shared.value)
        for pdf in it:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                fixed, n = repairer.repair(text)
                n += fixed.count(LOST) if lossy else 0
                if n:
                    rows.append((doc, n, fixed))
            yield pd.DataFrame(rows, columns=["doc_id", "sequences", "restored"])

    found = non_ascii(documents).mapInPandas(judge, "doc_id long, sequences long, restored string")
    if not lossy:
        return found
    per = lost.select("doc_id", F.struct("skeleton", "garbled", "filling").alias("w")).groupBy("doc_id").agg(F.collect_list("w").alias("w"))  # a document's own windows

    def restore(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            pdf["restored"] = [_restore_lost(t, w) if w is not None else t for t, w in zip(pdf["restored"], pdf["w"])]
            yield pdf[["doc_id", "sequences", "restored"]]

    return found.join(per, "doc_id", "left").mapInPandas(restore, "doc_id long, sequences long, restored string")


def p9_found(spark: SparkSession, where: str) -> DataFrame:
    return garbled_documents(table(spark, where, "documents")).select("doc_id")


def p9_restored(spark: SparkSession, where: str) -> DataFrame:
    return garbled_documents(table(spark, where, "documents"))


def p9_mappings(spark: SparkSession, where: str) -> DataFrame:
    """The learned mappings: what each garbled character stands for, a byte of UTF-8 text or a character, by mapping."""
    cut = Cut(spark, "mojibake")
    learned = learn(twins(read(table(spark, where, "documents"), cut)[0], cut))
    rows = [(k, x, f"{y:02x}" if m.bytes else y, bool(m.bytes)) for k, m in enumerate(learned) for x, y in (m.bytes or m.letters).items()]
    return spark.createDataFrame(rows, "mapping int, garbled string, stands_for string, is_byte boolean")
