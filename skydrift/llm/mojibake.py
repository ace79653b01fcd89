"""Text that was decoded with the wrong character encoding: which records, and what they said.

1. Every text is cut into the words that hold characters beyond ASCII or question marks; a record is clean unless one of them
   holds a replacement or control character or is valid UTF-8 in the bytes of a one-byte encoding.
2. A smoothed character trigram model is trained on those words of all clean records. Its counts are hashed
   into a table of fixed size, so what is sent about doesn't grow with the data.
3. Each distinct word is put through every chain (encode as it was read, decode as it was meant, for UTF-8
   also twice); the likeliest result counts if it is likelier than the word as it stands by more than a margin.
   The margin is set on words of clean records, as they stand and garbled on purpose.
4. Replacement and control characters, and question marks, may stand for characters that were lost. The likeliest text with characters
   beyond ASCII in their place is compared with the word as it stands, a question mark counting as a rarer full stop.
5. A record is affected if words beyond the margin occur in it, or if what speaks for loss in all of its words adds up to more.
"""

from __future__ import annotations

import codecs
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skydrift.tables import materialize

#: Slots of the hashed counts: of characters, and twice (the lesser count holds) of bigrams and of trigrams.
BITS = 20
SLOTS = 1 << BITS
#: Weight of the shorter n-gram in smoothing.
SMOOTH = 4.0
#: (meant, read as): the encoding of the bytes, and the one-byte encoding in which they were read by mistake.
PAIRS = tuple((meant, read) for meant, reads in (
    ("utf-8", ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "koi8_r", "cp866")),
    ("cp1252", ("latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251")),
    ("mac_roman", ("cp1252", "latin-1", "cp437")),
    ("cp437", ("cp1252", "latin-1", "mac_roman")),
    ("cp850", ("cp1252", "latin-1")),
    ("cp1251", ("cp1252", "latin-1", "koi8_r", "cp866", "mac_roman")),
    ("koi8_r", ("cp1252", "latin-1", "cp1251", "cp866")),
    ("cp866", ("cp1252", "latin-1", "cp1251", "koi8_r")),
    ("euc_jp", ("cp1252", "latin-1", "mac_roman")),
    ("shift_jis", ("cp1252", "latin-1", "mac_roman")),
) for read in reads)
#: Encodings in which UTF-8 may have been read twice.
TWICE = ("cp1252", "latin-1", "mac_roman", "cp437")
#: A word of at most so many characters is taken with CONTEXT characters on either side.
SHORT, CONTEXT = 3, 2
#: Records with a word beyond STRICT nats are left out of the second training. The margin is the least of MARGINS that
#: at most FALSE_SHARE of the distinct clean words exceed as they stand.
STRICT, MARGINS, FALSE_SHARE = 5.0, (2.0, 2.5, 3.0, 4.0, 5.0), 0.002

#: What takes part in the search for lost characters: so many of the most frequent characters beyond ASCII, and so many beginnings of a word.
ALPHABET, BEAM = 256, 4
#: Nats of a question mark over a full stop, and of each further mark of a run.
QUESTION, REPEATED = -3.0, -1.2
#: Records with such a run are no training text.
_LOST = "????"
_RUN, _ALONE = re.compile(r"\?+"), re.compile(r" \?+")
#: Places of characters that may have been lost.
_GAP = re.compile("[?\ufffd\x80-\x84\x86-\x9f]")
#: No clean text has these; a soft hyphen or other invisible character alone makes no word garbled.
_BAD = re.compile("[�\x80-\x84\x86-\x9f]")
_VISIBLE = re.compile("[^\x00-\x7f\x85\xa0\xad\u200b-\u200f\u2060\ufeff]")


def _chars(encoding: str) -> str:
    """The 256 characters of a one-byte encoding; bytes that it leaves undefined stand for the control of their number."""
    return "".join(chr(b) if b < 128 else bytes([b]).decode(encoding, "ignore") or chr(b) for b in range(256))


_CHARS = {e: _chars(e) for e in sorted({r for _, r in PAIRS})}
_TABLES = {e: codecs.charmap_build(c) for e, c in _CHARS.items()}


def _encode(word: str, encoding: str) -> bytes | None:
    try:
        return codecs.charmap_encode(word, "strict", _TABLES[encoding])[0]
    except UnicodeEncodeError:
        return None


def _decode(raw: bytes, encoding: str) -> str | None:
    try:
        return raw.decode(encoding)
    except UnicodeDecodeError:
        return None


def candidates(word: str) -> dict[str, str]:
    """Restored text to chain, for every chain under which the word decodes without error to other printable text."""
    raw = {e: _encode(word, e) for e in _TABLES}
    out: dict[str, str] = {}
    for meant, read in PAIRS:
        if raw[read] is None or (text := _decode(raw[read], meant)) is None or text == word:
            continue
        if meant == "utf-8":
            for again in TWICE:
                twice = _encode(text, again)
                if twice is not None and (deep := _decode(twice, "utf-8")) is not None and deep != text and not _BAD.search(deep):
                    out.setdefault(deep, f"utf-8>{again}>{read}")
        if not _BAD.search(text):
            out.setdefault(text, f"{meant}>{read}")
    return out


def is_suspect(word: str) -> bool:
    """A word that no clean record holds: replacement or control characters, or UTF-8 read byte by byte."""
    if _BAD.search(word) or _LOST in word:
        return True
    for read in ("cp1252", "mac_roman", "cp437", "cp1250"):
        raw = _encode(word, read)
        if raw is not None and _decode(raw, "utf-8") is not None:
            return True
    return False


def foreign_words(text: str) -> list[str]:
    """Words of a text (between ASCII blanks and controls) that hold a character beyond ASCII or a question mark; short ones with what is
    on either side, since a character or two say little."""
    if text.isascii() and "?" not in text:
        return []
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    blanks = np.concatenate([[-1], np.flatnonzero(codes <= 32), [len(codes)]])
    odd = np.flatnonzero((codes > 127) | (codes == ord("?")))
    at = np.unique(np.searchsorted(blanks, odd))
    out = []
    for a, b in zip(blanks[at - 1].tolist(), blanks[at].tolist()):
        out.append(text[a + 1:b] if b - a - 1 > SHORT else text[max(0, a - CONTEXT):b + 1 + CONTEXT].replace("\n", " "))
    return out


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, bool] = {}
    for b in batches:
        ids, words, counts, clean = [], [], [], []
        for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            found = Counter(foreign_words(t)) if t else {}
            bad = False
            for w in found:
                s = known.get(w)
                if s is None:
                    s = is_suspect(w)
                    if len(known) < 200_000 and len(w) < 40:
                        known[w] = s
                bad |= s
            ids += [d] * len(found)
            words += found
            counts += found.values()
            clean += [not bad] * len(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([w.encode("utf-8", "replace").decode() for w in words], pa.string()),
             pa.array(counts, pa.int64()), pa.array(clean, pa.bool_())], ["doc_id", "word", "n", "clean"])


def _slots(codes: np.ndarray) -> list[np.ndarray]:
    """Slots of the unigram, of the bigram (two) and of the trigram (two) that end at each character."""
    c = codes.astype(np.uint64)
    b = np.append(np.uint64(32), c[:-1])
    return _slots_of(np.append(np.uint64(32), b[:-1]), b, c)


def _slots_of(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
    """The same of characters ``c`` after ``a`` and ``b``."""
    out = [(c & np.uint64(SLOTS - 1)).astype(np.int64)]
    for k, mix in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
        m, down = np.uint64(mix), np.uint64(64 - BITS)
        two = (b * m ^ c) * m
        out += [(two >> down).astype(np.int64) + SLOTS * (1 + k), ((((a * m ^ b) * m ^ c) * m) >> down).astype(np.int64) + SLOTS * (3 + k)]
    return [out[0], out[1], out[3], out[2], out[4]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(5 * SLOTS, np.int64)
    for b in batches:
        words, counts = b.column(0).to_pylist(), b.column(1).to_numpy()
        text = "".join(f"  {w} " for w in words)
        sizes = np.array([len(w) + 3 for w in words])
        weight = np.repeat(counts, sizes)
        first = np.append(0, np.cumsum(sizes)[:-1])
        weight[first] = weight[first + 1] = 0
        for s in _slots(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)):
            np.add.at(total, s, weight)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "n"])


class Model:
    """Smoothed trigram model over the hashed counts."""

    def __init__(self, slots: np.ndarray, counts: np.ndarray):
        self.table = np.zeros(5 * SLOTS, np.float32)
        self.table[slots] = counts
        self.total = max(1.0, float(self.table[:SLOTS].sum(dtype=np.float64)))
        beyond = np.flatnonzero(self.table[160:SLOTS]) + 160
        self.alphabet = beyond[np.lexsort((beyond, -self.table[beyond]))[:ALPHABET]].astype(np.uint64)

    def scores(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word, with the blank after it."""
        if not words:
            return np.empty(0)
        # Two blanks before each word keep the words apart; what is counted for those two is left out of the sums.
        text = "".join(f"  {w} " for w in words)
        sizes = np.array([len(w) + 3 for w in words])
        t = self.table.take(_slots(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))).astype(np.float64)
        one, two, three = t[0], np.minimum(t[1], t[2]), np.minimum(t[3], t[4])
        blank = float(self.table[32])
        p = (one + 0.5) / (self.total + 0.5 * 65536)
        p = (two + SMOOTH * p) / (np.maximum(np.append(blank, one[:-1]), two) + SMOOTH)
        p = (three + SMOOTH * p) / (np.maximum(np.append(blank, two[:-1]), three) + SMOOTH)
        p = np.log(p)
        first = np.append(0, np.cumsum(sizes)[:-1])
        p[first] = p[first + 1] = 0
        return np.add.reduceat(p, first)

    def after(self, z: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-probabilities of characters ``c`` after ``a`` and ``b``, before which ``z`` stood, and the counts of these three."""
        now, before = _slots_of(a, b, c), _slots_of(z, a, b)
        t, u = [self.table.take(x).astype(np.float64) for x in now], [self.table.take(x).astype(np.float64) for x in before[:3]]
        p = (t[0] + 0.5) / (self.total + 0.5 * 65536)
        two, three = np.minimum(t[1], t[2]), np.minimum(t[3], t[4])
        p = (two + SMOOTH * p) / (np.maximum(u[0], two) + SMOOTH)
        return np.log((three + SMOOTH * p) / (np.maximum(np.minimum(u[1], u[2]), three) + SMOOTH)), three

    def filled(self, word: str) -> float:
        """Log-probability of the likeliest text with characters beyond ASCII in the places of the word that may have lost theirs; minus infinity if there
        is none. What stands for a question mark must be known after the two characters before it."""
        texts, scores = np.full((1, 3), 32, np.uint64), np.zeros(1)
        for ch in word + " ":
            gap = _GAP.match(ch)
            options = self.alphabet if gap else np.array([ord(ch)], np.uint64)
            old, c = np.repeat(texts, len(options), axis=0), np.tile(options, len(texts))
            p, known = self.after(old[:, 0], old[:, 1], old[:, 2], c)
            total = np.repeat(scores, len(options)) + p
            top = np.argsort(-total, kind="stable")
            top = (top[known[top] > 0] if ch == "?" else top)[:BEAM]
            if not len(top):
                return -np.inf
            texts, scores = np.concatenate([old[top, 1:], c[top, None]], axis=1), total[top]
        return float(scores[0])

    def losses(self, words: list[str]) -> list[float | None]:
        """By how much each word is likelier with lost characters than as it stands, in nats; None if nothing in it may be lost.

        As it stands a run of question marks counts as a stop, or a comma, behind the text or the blank before it, that is rarer.
        """
        at = [k for k, w in enumerate(words) if _GAP.search(w)]
        plain = [[f(words[k]) for k in at] for f in (lambda w: _RUN.sub(".", w), lambda w: _RUN.sub(",", w), lambda w: _ALONE.sub(".", w))]
        stands = np.max([self.scores(p) for p in plain], axis=0) if at else []
        out: list[float | None] = [None] * len(words)
        for k, own in zip(at, stands):
            marks = [len(m[0]) for m in _RUN.finditer(words[k])]
            loss = self.filled(words[k]) - float(own) - QUESTION * len(marks) - REPEATED * (sum(marks) - len(marks))
            out[k] = loss if loss > -np.inf else None
        return out

    def best(self, words: list[str]) -> list[tuple[str | None, str | None, float, float]]:
        """Of each word the likeliest chain, the text it gives, its score, and the score of the word as it stands."""
        options = [candidates(w) if _VISIBLE.search(w) else {} for w in words]
        flat = [t for w, o in zip(words, options) if o for t in (w, *o)]
        scores, at, out = self.scores(flat), 0, []
        for o in options:
            top = (None, None, 0.0, 0.0)
            if o:
                own = scores[at:at + len(o) + 1]
                k = int(own[1:].argmax())
                text = flat[at + 1 + k]
                if own[k + 1] > own[0]:
                    top = (o[text], text, float(own[k + 1]), float(own[0]))
                at += len(o) + 1
            out.append(top)
        return out


def gain(restored: float, n_restored: float, word: float, n_word: float, total: float) -> float:
    """By how much a restored word is likelier, in nats. A word's probability is the mean of what the model gives and
    of its share among the clean words, for the trigrams of very short words say little."""
    def log_p(score, n):
        return float(np.logaddexp(score, np.log(n / total)) if n else score)

    return log_p(restored, n_restored) - log_p(word, n_word)


def train(words: DataFrame) -> Model:
    """The model of (word, n). Every count over all words; at most 5 * SLOTS sums reach the driver."""
    sums = words.mapInArrow(_count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    return Model(sums.column("slot").to_numpy(), sums.column("n").to_numpy())


def garble(word: str, chain: str) -> str | None:
    """What a chain makes of a clean word; None if the encoding that was meant can't hold it."""
    meant, *read = chain.split(">")
    for r in read:
        try:
            raw = codecs.charmap_encode(word, "strict", _TABLES[meant])[0] if meant in _TABLES else word.encode(meant)
        except UnicodeEncodeError:
            return None
        word = "".join(_CHARS[r][b] for b in raw)
    return word


def validated_margin(model: Model, clean: list[tuple[str, int]], total: float) -> float:
    """The least margin that at most FALSE_SHARE of clean words exceed as they stand."""
    found = model.best([w for w, _ in clean])
    gains = np.array([gain(f[2], 0, f[3], n, total) if f[0] else 0.0 for f, (_, n) in zip(found, clean)] or [0.0])
    return next((m for m in MARGINS if (gains > m).mean() <= FALSE_SHARE), MARGINS[-1])


def recall(model: Model, clean: list[tuple[str, int]], total: float, margin: float, chains: tuple[str, ...]) -> float:
    """Share of clean words, garbled by the chains that can hold them, that are found and restored."""
    pairs = [(w, n, b) for w, n in clean for c in chains if (b := garble(w, c)) and b != w]
    found = model.best([b for _, _, b in pairs])
    hits = [f[1] == w and gain(f[2], n, f[3], 0, total) > margin for f, (w, n, _) in zip(found, pairs)]
    return sum(hits) / max(1, len(hits))


def _explained(found: tuple) -> bool:
    return found[0] is not None and found[2] - found[3] > max(STRICT, MARGINS[-1])


def _judge(model):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column(0).to_pylist()
            best = model.value.best(words)
            # What a chain explains beyond any margin needs no other explanation.
            losses = iter(model.value.losses([w for w, f in zip(words, best) if not _explained(f)]))
            rows = []
            for w, n, found in zip(words, b.column(1).to_pylist(), best):
                loss = None if _explained(found) else next(losses)
                if found[0] or (loss is not None and loss > 0):
                    rows.append((w, n, *found, loss))
            cols = list(zip(*rows)) if rows else [()] * 7
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                             ["word", "n", "chain", "restored", "score", "own", "loss"])

    return judge


def _vocabulary(words: DataFrame) -> DataFrame:
    """(word, n): distinct words and their number in clean records."""
    return materialize(words.groupBy("word").agg(F.sum(F.when(F.col("clean"), F.col("n")).otherwise(0)).alias("n")))


def _log_p(score: Column, n: Column, total: float) -> Column:
    """As in ``gain``."""
    share = F.log(n / total)
    return F.when(n > 0, F.greatest(score, share) + F.log1p(F.exp(-F.abs(score - share)))).otherwise(score)


def margin_of_all(judged: DataFrame, total: float, distinct: int) -> float:
    """``validated_margin`` over all clean words (n > 0), in one aggregate over their judgements (n, chain, score, own)."""
    alone = F.col("score") - _log_p(F.col("own"), F.col("n"), total)
    beyond = judged.where("n > 0 and chain is not null").agg(*[F.count_if(alone > m).alias(f"n{k}") for k, m in enumerate(MARGINS)]).first()
    return next((m for m, k in zip(MARGINS, beyond) if k / max(1, distinct) <= FALSE_SHARE), MARGINS[-1])


def chain_margins(sure: dict[str, int], beyond: dict[str, list[int]], margin: float) -> dict[str, float]:
    """The margin of each chain: the least from ``margin`` on beyond which it explains no more distinct clean words than those
    by which the first model was sure of it; else STRICT.

    sure: distinct words of each chain in the first pass. beyond: its distinct clean words beyond each of ``_steps(margin)``. Both
    are counts over the same table, so that their ratio, which decides, doesn't depend on its size.
    """
    strict = max(margin, STRICT)
    return {c: next((m for m, k in zip(_steps(margin), n) if k <= sure.get(c, 0)), strict) for c, n in beyond.items()}


def _steps(margin: float) -> list[float]:
    return [margin, *[m for m in MARGINS if m > margin]]


def _find(words: DataFrame, vocabulary: DataFrame, margin: float | None, sure: dict[str, int] | None = None) -> tuple[DataFrame, float]:
    """(word, chain, restored, gain, loss) of the words that the model of the vocabulary's clean words takes for garbled, or that may have lost
    characters; and the margin.

    With the distinct words of each chain of which another model was ``sure``, each chain gets its own margin.
    """
    clean = vocabulary.where("n > 0")
    model = train(clean)
    total, distinct = clean.agg(F.sum("n"), F.count(F.lit(1))).first()
    total = float(total or 1)
    shared = words.sparkSession.sparkContext.broadcast(model)
    judged = materialize(vocabulary.mapInArrow(
        _judge(shared), "word string, n long, chain string, restored string, score double, own double, loss double"))
    if margin is None:
        margin = margin_of_all(judged, total, distinct)
    known = clean.select(F.col("word").alias("restored"), F.col("n").alias("n_restored"))
    scored = judged.join(known, "restored", "left").withColumn(
        "gain", _log_p(F.col("score"), F.coalesce("n_restored", F.lit(0)), total) - _log_p(F.col("own"), F.col("n"), total))
    need = F.lit(margin)
    if sure is not None:
        scored = materialize(scored)
        # No more rows than there are pairs and double readings.
        rows = scored.where("chain is not null").groupBy("chain").agg(
            *[F.count_if((F.col("n") > 0) & (F.col("gain") > m)).alias(f"n{k}") for k, m in enumerate(_steps(margin))]).collect()
        for chain, least in chain_margins(sure, {r[0]: list(r[1:]) for r in rows}, margin).items():
            if least > margin:
                need = F.when(F.col("chain") == chain, F.lit(least)).otherwise(need)
    found = (
        scored.withColumn("sure", F.col("chain").isNotNull() & (F.col("gain") > need))
        .where("sure or loss > 0")
        .select("word", F.when(F.col("sure"), F.col("chain")).alias("chain"), F.when(F.col("sure"), F.col("restored")).alias("restored"),
                F.when(F.col("sure"), F.col("gain")).otherwise(0.0).alias("gain"), F.greatest("loss", F.lit(0.0)).alias("loss"))
    )
    return materialize(found), margin


def _places(words: DataFrame, found: DataFrame, margin: float) -> DataFrame:
    """Found words with their records: those that a chain explains, and those of records in which the losses of all words add up to more than
    the margin."""
    here = materialize(words.select("doc_id", "word", "n").join(found, "word"))
    lost = here.groupBy("doc_id").agg(F.sum("loss").alias("l")).where(F.col("l") > margin).select("doc_id", F.lit(True).alias("loses"))
    here = here.join(lost, "doc_id", "left").withColumn("lost", F.coalesce("loses", F.lit(False)) & (F.coalesce("loss", F.lit(0.0)) > 0))
    return here.where("chain is not null or lost").select("doc_id", "word", "n", "chain", "restored", "gain", "lost", F.when(F.col("lost"), F.col("loss")).otherwise(0.0).alias("loss"))


def garbled_words(docs: DataFrame, doc: str = "doc_id", text: str = "text", margin: float | None = None) -> DataFrame:
    """(doc_id, word, n, chain, restored, gain, lost, loss) of all wrongly decoded words of all documents.

    chain is what made the word ('meant>read'), restored what it said; where ``lost`` is true characters of the word are lost, with
    ``loss`` nats for that, and chain and restored are null if no chain explains the rest. Null, empty and plain
    ASCII texts without question marks have none. Identifiers are integers; rows with a null identifier are left out.
    """
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    words = materialize(rows.mapInArrow(_words, "doc_id long, word string, n long, clean boolean"))
    found, _ = _find(words, _vocabulary(words), STRICT)
    # No more chains than there are pairs and double readings.
    sure = {r[0]: r[1] for r in found.where("chain is not null").groupBy("chain").agg(F.count(F.lit(1)).alias("n")).collect()}
    # What the first model is sure of leaves the training text of the second.
    bad = materialize(_places(words, found, STRICT).select("doc_id").distinct())
    clean = _vocabulary(words.join(bad, "doc_id", "left_anti"))
    every = materialize(words.select("word").distinct().join(clean, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n")))
    found, least = _find(words, every, margin, sure)
    return _places(words, found, least)


def affected(docs: DataFrame, **kwargs) -> DataFrame:
    """(doc_id, chain, gain, n_words, n_lost): each affected document, with the chain that explains most of it."""
    w = garbled_words(docs, **kwargs)
    by = w.groupBy("doc_id", "chain").agg(F.sum(F.col("gain") * F.col("n")).alias("gain"), F.sum("n").alias("n"),
                                          F.sum(F.when(F.col("lost"), F.col("n")).otherwise(0)).alias("lost"))
    return by.groupBy("doc_id").agg(F.max_by("chain", "gain").alias("chain"), F.sum("gain").alias("gain"),
                                    F.sum("n").alias("n_words"), F.sum("lost").alias("n_lost"))
