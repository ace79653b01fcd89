"""Evaluation passages that stand, in part or whole, in corpus texts.

The unit of comparison is a window of as many passage words as must match (``length``). Every window gets a SimHash of its
words; fingerprints are indexed by ``radius + 1`` bit blocks, of which two fingerprints within the radius share at least one.
What a block brings together is verified: by the Hamming distance, by the weighted similarity of the windows' five-word
shingles, and by the words themselves.

Numbers between words don't matter, so a window is fingerprinted by its words that are no numbers; since passages hold numbers of
their own, those are from LEAST_WORDS to ``length`` words, and windows of each of these sizes that occurs are sought.

The passages' windows are a table. What is sent to every task are two bit sets of fixed size: of the passages' words, and
of their block keys. One pass over all texts keeps the windows that hit both; only these are shuffled and joined with the
passages' windows. A bit set that is full makes more windows pass, and loses none.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skydrift.tables import materialize

#: Passage windows with fewer words that aren't numbers are compared with their numbers as words.
LEAST_WORDS = 5
SHINGLE, SIMILARITY = 5, 0.8
#: Bits of a slot in a bit set; a set is 2 MB and comes to the driver as at most 2**18 rows.
SLOT_BITS = 24
#: Texts handled together, and words that a task remembers.
CHUNK, REMEMBERED = 64, 500_000
#: Kinds of words.
FOREIGN, WORD, NUMBER, FOREIGN_NUMBER = range(4)

_WORD = re.compile(r"[^\W_]+")
_BREAK = re.compile(r"</?(?:p|br|div|li|ul|ol|td|tr|h[1-6]|table|para|claim|section)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
#: A tag that can't be prose: every attribute has a value.
_SURE = re.compile(r"</?[A-Za-z][\w:.-]*+(?:\s++[\w:.-]++\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'<>]++))*+\s*+/?>")
_SOFT = re.compile("[­​‌‍⁠﻿]")
#: Letters that lines' ends and hyphens cut into pieces.
_PIECES = re.compile(r"(?<![^\W_])[^\W\d_]++(?:[-‐‑][ \t]*+\n\s*+[^\W\d_]++)++")
_CUT = re.compile(r"[-‐‑][ \t]*\n\s*")
_MIX = 0x9E3779B97F4A7C15


def _without_comments(text: str) -> str:
    out, at = [], 0
    while (start := text.find("<!--", at)) >= 0 and (end := text.find("-->", start)) >= 0:
        out.append(text[at:start])
        at = end + 3
    return "".join([*out, text[at:]])


def _rejoin(text: str, known, longest: int) -> tuple[str, bool]:
    """Joins words cut at lines' ends where ``known`` holds the joined word, of at most ``longest`` letters, the longest first; and
    whether its pieces may have been words of their own."""
    doubt = False

    def join(m):
        nonlocal doubt
        parts, out, a = _CUT.split(m[0]), [], 0
        while a < len(parts):
            ends, size = [], len(parts[a])
            for b in range(a + 1, len(parts)):
                size += len(parts[b])
                if size > longest:
                    break
                ends.append(b + 1)
            b = next((b for b in reversed(ends) if known("".join(parts[a:b]))), a + 1)
            doubt |= b > a + 1 and all(map(known, parts[a:b]))
            out.append("".join(parts[a:b]))
            a = b
        return " ".join(out)

    return _PIECES.sub(join, text), doubt


def _plain(text: str) -> str:
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        text = _SOFT.sub("", text)
    return text.casefold()


def readings(text: str, known=None, longest: int = 1 << 30) -> list[list[str]]:
    """The words of a text, runs of letters or digits, without regard to case, markup and typography; in every way that the text can be
    read.

    Tags are left out. What stands in angle brackets and may be prose is left out in one reading and kept in another. A word
    cut at lines' ends is joined if ``known`` accepts the joined word, else its parts are words; where it accepts the parts
    too, there is a reading with each. Without ``known`` parts stay words.
    """
    texts = [text]
    if "<" in text:
        text = _without_comments(text)
        texts = [_TAG.sub("", _BREAK.sub(" ", text))]
        if any(not _SURE.fullmatch(m[0]) for m in _TAG.finditer(text)):
            texts.append(_TAG.sub(lambda m: ("" if not _BREAK.fullmatch(m[0]) else " ") if _SURE.fullmatch(m[0]) else m[0], text))
    out = []
    for t in map(_plain, texts):
        if known is not None and "\n" in t:
            joined, doubt = _rejoin(t, known, longest)
            out += [joined, t] if doubt else [joined]
        else:
            out.append(t)
    return [_WORD.findall(t) for t in out]


def words(text: str) -> list[str]:
    """The words of a clean text."""
    return readings(text)[0]


def hash_of(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def simhashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """SimHash (64 bits) of each window of ``size`` consecutive word hashes."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32)
    total = np.zeros((len(hashes) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=total[1:])
    ones = total[size:] - total[:-size]
    return np.packbits(ones * 2 > size, axis=1).view(np.uint64).ravel()


def block_keys(prints: np.ndarray, kind: int, radius: int) -> np.ndarray:
    """A key for each fingerprint and bit block: equal for equal kinds, blocks and bits."""
    edges = np.linspace(0, 64, radius + 2).astype(int)
    keys = []
    for n, (lo, hi) in enumerate(zip(edges, edges[1:])):
        k = (prints << np.uint64(64 - hi)) >> np.uint64(64 - hi + lo)
        k = (k ^ np.uint64((kind << 8 | n) * _MIX % 2**64)) * np.uint64(_MIX)
        keys.append((k ^ (k >> np.uint64(31))) * np.uint64(_MIX))
    return np.stack(keys, 1)


class Bits:
    """A bit set over the upper bits of 64-bit keys."""

    def __init__(self, rows: list[tuple[int, int]]):
        self.words = np.zeros(1 << (SLOT_BITS - 6), np.uint64)
        for at, bits in rows:
            self.words[at] = np.uint64(bits & (2**64 - 1))

    def has(self, keys: np.ndarray) -> np.ndarray:
        slot = keys >> np.uint64(64 - SLOT_BITS)
        return (self.words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1

    def __contains__(self, key: int) -> bool:
        slot = key >> (64 - SLOT_BITS)
        return bool(int(self.words[slot >> 6]) >> (slot & 63) & 1)


def bit_set(keys: DataFrame, key: str) -> Bits:
    """The bit set of a table of keys."""
    slot = F.shiftrightunsigned(key, 64 - SLOT_BITS)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))
    return Bits([tuple(r) for r in keys.select(F.shiftright(slot, 6).alias("at"), one.alias("b")).groupBy("at").agg(F.bit_or("b")).collect()])


# Passages


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [words(p) for p in b.column(1).to_pylist()]
        hashes = [np.array([hash_of(w) for w in ws], np.uint64).view(np.int64) for ws in found]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hashes, pa.list_(pa.int64())), pa.array([[w.isdigit() for w in ws] for ws in found], pa.list_(pa.bool_())),
                                          pa.array([max(map(len, ws), default=0) for ws in found], pa.int32())], ["item_id", "hashes", "number", "longest"])


_PASSAGE = "item_id long, kind int, start int, place int, print long, keys array<long>, tokens array<long>, number array<boolean>, weight array<double>"


def _passage_windows(length: int, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for item, hashes, number, weight in zip(*[b.column(k).to_pylist() for k in range(4)]):
                h, no = np.array(hashes, np.int64).view(np.uint64), np.array(number, bool)
                rank = np.append(0, np.cumsum(~no))
                for at in range(len(h) - length + 1):
                    part, n = h[at:at + length], no[at:at + length]
                    kind = int((~n).sum())
                    own = part[~n] if kind >= LEAST_WORDS else part
                    kind = kind if kind >= LEAST_WORDS else 0
                    f = simhashes(own, len(own))
                    out.append((item, kind, at, int(rank[at]), int(f.view(np.int64)[0]), block_keys(f, kind, radius)[0].view(np.int64).tolist(),
                                part.view(np.int64).tolist(), n.tolist(), weight[at:at + length]))
            yield pa.RecordBatch.from_pylist([dict(zip(("item_id", "kind", "start", "place", "print", "keys", "tokens", "number", "weight"), r)) for r in out], schema=_PASSAGE_ARROW)

    return run


_PASSAGE_ARROW = pa.schema([("item_id", pa.int64()), ("kind", pa.int32()), ("start", pa.int32()), ("place", pa.int32()), ("print", pa.int64()), ("keys", pa.list_(pa.int64())),
                            ("tokens", pa.list_(pa.int64())), ("number", pa.list_(pa.bool_())), ("weight", pa.list_(pa.float64()))])


def passage_windows(items: DataFrame, length: int, radius: int) -> tuple[DataFrame, DataFrame, int]:
    """Windows of the passages (item_id, passage), the hashes ``h`` of all their words, and the length of the longest word. A word
    weighs the more, the fewer passages hold it."""
    tokens = materialize(items.mapInArrow(_tokens, "item_id long, hashes array<long>, number array<boolean>, longest int"))
    n, longest = tokens.agg(F.count(F.lit(1)), F.coalesce(F.max("longest"), F.lit(0))).first()
    each = tokens.select("item_id", F.posexplode("hashes").alias("at", "h"))
    held = each.groupBy("h").agg(F.count_distinct("item_id").alias("n"))
    weights = each.join(held, "h").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("at", F.log1p(F.lit(n) / F.col("n")).alias("w")))).alias("w"))
    rows = tokens.join(weights, "item_id").select("item_id", "hashes", "number", F.col("w.w").alias("weight"))
    return materialize(rows.mapInArrow(_passage_windows(length, radius), _PASSAGE)), held.select("h"), longest


# Texts


class Seen(dict):
    """Numbers of words, with the hash and kind of each; forgets all when there are too many."""

    def __init__(self, known: Bits, longest: int):
        super().__init__()
        self.known, self.longest, self.hashes, self.kinds = known, longest, [0], [FOREIGN]

    def accepts(self, word: str) -> bool:
        return self.kinds[self[word]] in (WORD, NUMBER)

    def __missing__(self, word: str) -> int:
        h = hash_of(word)
        held = h in self.known
        self.hashes.append(h)
        self.kinds.append((NUMBER if held else FOREIGN_NUMBER) if word.isdigit() else WORD if held else FOREIGN)
        self[word] = len(self.hashes) - 1
        return self[word]

    def trim(self) -> None:
        if len(self) > REMEMBERED:
            self.clear()
            self.hashes, self.kinds = [0], [FOREIGN]


_FOUND = "doc_id long, reading int, kind int, at long, print long, block int, key long, tokens array<long>, number array<boolean>"


def text_windows(texts: list[str], seen: Seen, wanted: Bits, kinds: list[int], length: int, radius: int) -> Iterator[list]:
    """Windows of some texts that may be those of a passage, for each kind as columns: number of the text, reading, kind, place, print, block, key,
    tokens, number flags.

    The tokens of a window are its words with the numbers before, between and behind them that some passage may hold.
    """
    seen.trim()
    tokens, starts, owner = [], [0], []
    for k, t in enumerate(texts):
        for n, ws in enumerate(readings(t, seen.accepts, seen.longest)):
            tokens += map(seen.__getitem__, ws)
            tokens.append(0)  # one foreign word between readings
            starts.append(len(tokens))
            owner.append((k, n))
    ids, owner = np.array(tokens, np.int64), np.array(owner, np.int64).reshape(-1, 2)
    hashes, kind_of = np.array(seen.hashes, np.uint64), np.array(seen.kinds, np.int8)
    what = kind_of[ids]
    usable = np.flatnonzero(what != FOREIGN_NUMBER)  # such numbers stand between words, and don't matter
    for kind in kinds:
        at = np.flatnonzero((what == WORD) | (what == FOREIGN)) if kind else usable
        c = ids[at]
        good = np.append(0, np.cumsum(kind_of[c] != FOREIGN))
        size = kind or length
        begin = np.flatnonzero(good[size:] - good[:-size] == size) if len(c) >= size else np.empty(0, np.int64)
        if not len(begin):
            continue
        # Stretches of known words are strung together; windows across two are left out.
        inside = np.zeros(len(c) + 1, np.int64)
        np.add.at(inside, begin, 1)
        np.add.at(inside, begin + size, -1)
        kept = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
        prints = simhashes(hashes[c[kept]], size)[np.searchsorted(kept, begin)]
        keys = block_keys(prints, kind, radius)
        w, block = np.nonzero(wanted.has(keys))
        if not len(w):
            continue
        # Of the usable tokens, from behind the word before the window to before the word after it.
        i, place = begin[w], np.concatenate([[-1], np.searchsorted(usable, at), [len(usable)]])
        lo, hi = (place[i] + 1, place[i + size + 1]) if kind else (i, i + size)
        ends = np.append(0, np.cumsum(hi - lo))
        part = ids[usable[np.arange(ends[-1]) + np.repeat(lo - ends[:-1], hi - lo)]]
        d = np.searchsorted(starts, at[i], "right") - 1
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), v) for v in (pa.array(hashes[part].view(np.int64)), pa.array(kind_of[part] == NUMBER))]
        yield [owner[d, 0], owner[d, 1], np.full(len(w), kind), i, prints[w].view(np.int64), block, keys[w, block].view(np.int64), *lists]


def _search(known, longest: int, wanted, kinds: list[int], length: int, radius: int):
    names = [x.split()[0] for x in _FOUND.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_())]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen(known.value, longest)
        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                rows = [(d, t) for d, t in zip(b.column(0)[at:at + CHUNK].to_pylist(), b.column(1)[at:at + CHUNK].to_pylist()) if t]
                ids = np.array([d for d, _ in rows], np.int64)
                for k, *rest in text_windows([t for _, t in rows], seen, wanted.value, kinds, length, radius):
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c).cast(t) for c, t in zip([ids[k], *rest], types)], names)

    return search


# Verification


def similarity(text: list[int], passage: list[int], weight: dict[int, float]) -> float:
    """Weighted Jaccard similarity of the five-word shingles of two windows; a shingle weighs as its words do. Words that the
    passage doesn't hold weigh as much as its heaviest."""
    def bag(ws):
        return Counter(tuple(ws[k:k + SHINGLE]) for k in range(max(1, len(ws) - SHINGLE + 1)))

    x, y = bag(text), bag(passage)
    top = max(weight.values(), default=1.0)
    weigh = {s: sum(weight.get(w, top) for w in s) for s in x | y}
    total = sum(weigh[s] * n for s, n in (x | y).items())
    return sum(weigh[s] * n for s, n in (x & y).items()) / total if total else 0.0


def stands_in(passage: list[int], text: list[int], number: list[bool]) -> bool:
    """Whether the passage's words stand in the text from its first to its last word, in order and without others than numbers between them."""
    at = 0
    for w in passage:
        while at < len(text) and text[at] != w and number[at]:
            at += 1
        if at == len(text) or text[at] != w:
            return False
        at += 1
    return all(number[at:])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose windows are the same (tokens is null), or similar with the same words."""
    for b in batches:
        cols = [b.column(n).to_pylist() for n in ("kind", "tokens", "number", "p_tokens", "p_number", "weight")]
        good = []
        for kind, text, number, passage, p_number, weight in zip(*cols):
            if text is not None:
                plain = [w for w, n in zip(text, number) if not n] if kind else text
                other = [w for w, n in zip(passage, p_number) if not n] if kind else passage
                good.append(similarity(plain, other, dict(zip(passage, weight))) >= SIMILARITY and stands_in(passage, text, number))
            else:
                good.append(True)
        names = ["doc_id", "reading", "item_id", "start", "shift"]
        yield pa.RecordBatch.from_arrays([b.column(n) for n in names], names).filter(pa.array(good, pa.bool_()))


def _first_block(block: str, differ: Column, radius: int) -> Column:
    """Whether a block is the first in which two fingerprints, that differ in some bits, are equal."""
    edges = np.linspace(0, 64, radius + 2).astype(int)
    earlier = [F.when(F.col(block) > n, differ.bitwiseAND(((1 << int(hi - lo)) - 1 << int(lo)) - (1 << 64 if hi == 64 else 0)) != 0).otherwise(True)
               for n, (lo, hi) in enumerate(zip(edges, edges[1:]))]
    return reduce(lambda a, b: a & b, earlier)


def leaked_items(docs: DataFrame, items: DataFrame, length: int = 12, radius: int = 1,
                 doc: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "passage") -> DataFrame:
    """(doc_id, item_id, n_words): items of which at least ``length`` consecutive words stand in a document.

    Words compare without regard to case, punctuation, markup and layout; numbers that stand between the words of a
    passage don't matter, however many. Where fewer than LEAST_WORDS of ``length`` passage words are no numbers, only numbers
    that no passage holds may stand between. Null and empty texts and passages, and passages of fewer words, match nothing. Documents
    in several rows with one id give one row per item, an item_id in several rows counts with one of them. Identifiers are integers.
    """
    rows = items.select(F.col(item).cast("long").alias("item_id"), F.col(passage).alias("p")).where("item_id is not null and p is not null").dropDuplicates(["item_id"])
    windows, held, longest = passage_windows(rows, length, radius)
    sc = docs.sparkSession.sparkContext
    kinds = sorted(r[0] for r in windows.select("kind").distinct().collect())  # at most length + 1
    known, wanted = sc.broadcast(bit_set(held, "h")), sc.broadcast(bit_set(windows.select(F.explode("keys").alias("k")), "k"))
    texts = docs.select(F.col(doc).cast("long"), F.col(text)).where(F.col(doc).isNotNull())
    found = texts.mapInArrow(_search(known, longest, wanted, kinds, length, radius), _FOUND)
    index = windows.select("item_id", "kind", "start", "place", F.col("print").alias("p_print"), F.explode("keys").alias("key"), F.col("tokens").alias("p_tokens"),
                           F.col("number").alias("p_number"), "weight")
    differ = F.col("print").bitwiseXOR(F.col("p_print"))
    near = found.join(index, ["key", "kind"]).where((F.bit_count(differ) <= radius) & _first_block("block", differ, radius))
    # Windows that follow each other in text and passage have one shift; numbers as words are counted apart.
    near = near.withColumn("shift", F.when(F.col("kind") > 0, F.col("at") - F.col("place")).otherwise(-1 - F.col("at") + F.col("start")))
    # Equal windows, nearly all, need no look at their words.
    other = F.col("tokens") != F.col("p_tokens")
    near = near.select("doc_id", "reading", "item_id", "start", "shift", "kind", *[F.when(other, F.col(c)).alias(c) for c in ("tokens", "number", "p_tokens", "p_number", "weight")])
    good = near.mapInArrow(_verify, "doc_id long, reading int, item_id long, start int, shift long").distinct()
    line = Window.partitionBy("doc_id", "reading", "item_id", "shift")
    runs = good.withColumn("run", F.col("start") - F.row_number().over(line.orderBy("start")))
    n = runs.groupBy("doc_id", "reading", "item_id", "shift", "run").agg((F.count(F.lit(1)) + length - 1).cast("int").alias("n"))
    return n.groupBy("doc_id", "item_id").agg(F.max("n").alias("n_words"))
