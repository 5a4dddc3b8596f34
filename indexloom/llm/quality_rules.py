"""Quality rules: repetition and size counts, then divergence from language references.

Everything that the divergence needs is learnt from the table itself, over all its rows, for each
language in turn, in three narrow passes whose sums Spark adds up:

1. how many documents hold each word; the TOP_WORDS most frequent are the language's common words;
2. each document's shares of character classes and of common words; their class-wise medians and, for
   words, means of the middle nine tenths are the language's reference, so that a mass of junk in one
   source hardly moves it;
3. each document's Jensen-Shannon distances to its language's reference; their median and lower
   quartile, among documents of like length, give the limit: the median plus SPREAD times the
   larger of their difference and the deviation that chance alone gives at that length.

A document passes if both its distances, of character classes and of common words, keep to its
language's limits, or if those that don't keep to another language's (it may carry a wrong
label). Short texts have histograms that say little, so below a minimum length, of its own for
either, a distance isn't used.

Null and empty texts have no words and fail the base rules. Repeated rows are judged alike, row by
row, as are ties. Where a document's language has no reference or no limit, for want of documents,
a distance says nothing of it and isn't used; so the base rules decide alone for rows without a
language or of a rare one, and in an empty table. Extra columns are left out (`keep_good` keeps
them), whatever their names. Texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from indexloom.llm import textops

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
TOP_WORDS = 100  # common words of a language
MAX_WORD_BYTES = 64  # longer words are never common
KINDS = ("char", "word")
LEAST = (200, 60)  # characters of a text, below which character classes aren't compared; words, below which common words aren't
SPREAD = 8.0
SHARE_BINS = 200
DISTANCE_BINS = 1000
MIN_REFERENCE_DOCS = 5
MIN_LIMIT_DOCS = 20  # of one length, for a limit of its own; else the next shorter length's holds

SPACES = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"

#: Character classes of a byte: lower-case, upper-case, letters beyond ASCII, digits, spaces, newlines, sentence marks, symbols, other.
CLASSES = 9
COMPARED = [0, 1, 2, 4, 5, 6, 7, 8]  # digits aren't: numbers say nothing of a text's quality
_CLASS = np.full(256, 8, dtype=np.int64)
_CLASS[0x61:0x7B] = 0
_CLASS[0x41:0x5B] = 1
_CLASS[0x80:] = 2
_CLASS[0x30:0x3A] = 3
_CLASS[[0x20, 0x09]] = 4
_CLASS[[0x0A, 0x0D]] = 5
_CLASS[list(b".,;:'\"-()?")] = 6
_CLASS[list(SYMBOLS)] = 7
_CODE_POINT = np.ones(256, dtype=bool)
_CODE_POINT[0x80:0xC0] = False
_NOT_SPACE = np.ones(256, dtype=bool)
_NOT_SPACE[list(SPACES)] = False
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])


def repeated_words(words: textops.Words, window: int = WINDOW) -> np.ndarray:
    """For each document the words that lie in a window found twice or more in it. Hashes propose, the words themselves decide."""
    n = len(words.id)
    covered = np.zeros(n + 1, dtype=np.int64)
    if n >= window:
        h = textops.shingle_hashes(words.hash, window)
        owner = words.doc_of_word()
        at = np.flatnonzero(owner[: len(h)] == owner[window - 1 :])
        h, doc = h[at], owner[at]
        order = np.lexsort((h, doc))
        same = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        twice = np.zeros(len(order), dtype=bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = np.sort(at[order[twice]])
        if len(hit):
            whole = np.concatenate([owner[hit][:, None], words.id[hit[:, None] + np.arange(window)]], axis=1)
            _, inverse, count = np.unique(whole, axis=0, return_inverse=True, return_counts=True)
            hit = hit[count[inverse.reshape(-1)] > 1]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + window, -1)
    return _per_doc(np.cumsum(covered)[:n] > 0, words.offsets)


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def base_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    buf, offsets = textops.utf8(texts)
    words = textops.Words(buf, offsets, word_byte=_NOT_SPACE, lower=False)
    n_words, n_repeat = words.counts, repeated_words(words)
    return {
        "n_words": n_words,
        "word_chars": _per_doc(_CODE_POINT[buf] & _NOT_SPACE[buf], offsets),
        "n_symbols": _per_doc(_SYMBOL[buf], offsets),
        "n_dup_lines": np.fromiter((duplicate_lines(t) for t in texts.to_pylist()), dtype=np.int64, count=len(texts)),
        "n_repeat_words": n_repeat,
        "base_failed": (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words),
    }


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row-wise square root of the Jensen-Shannon divergence (base 2); a row without mass is 0 away."""
    total = p.sum(axis=1, keepdims=True)
    p = p / np.where(total > 0, total, 1)
    q = (q / max(q.sum(), 1e-300))[None, :]
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = lambda a: np.where(a > 0, a * np.log2(a / m), 0).sum(axis=1)
        d = np.sqrt(np.maximum((kl(p) + kl(np.broadcast_to(q, p.shape))) / 2, 0))
    return np.where(total[:, 0] > 0, d, 0.0)


@dataclass
class References:
    """What is known of each language: common words, shares of classes and words, and limits by kind and length."""

    common: dict[str, list[bytes]] = field(default_factory=dict)
    shares: dict[str, tuple[np.ndarray | None, np.ndarray | None]] = field(default_factory=dict)
    limits: dict[tuple[str, int, int], tuple[float, float]] = field(default_factory=dict)  # (language, kind, length) -> (median, spread)

    def limit(self, lang: str, kind: int, sizes: np.ndarray) -> np.ndarray:
        """The limit for texts of each size; NaN where none is known."""
        out = np.full(len(sizes), np.nan)
        lengths = length_class(sizes)
        for c in np.unique(lengths):
            for near in range(c, -1, -1):
                if (found := self.limits.get((lang, kind, near))) is not None:
                    mine = lengths == c
                    out[mine] = found[0] + SPREAD * np.maximum(found[1], chance(sizes[mine]))
                    break
        return out


def length_class(sizes: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(sizes, 1))).astype(np.int64)


def chance(sizes: np.ndarray) -> np.ndarray:
    """The standard deviation of the distance between a sample of so many and what it is drawn from, whatever the number of classes (its square is about a chi-square's share of 8 n ln 2)."""
    return 1 / np.sqrt(16 * np.log(2) * np.maximum(sizes, 1))


class Measured:
    """Histograms of a slice of documents."""

    def __init__(self, texts: pa.Array):
        buf, offsets = textops.utf8(texts)
        docs = len(texts)
        owner = np.repeat(np.arange(docs), np.diff(offsets))
        points = _CODE_POINT[buf]
        self.chars = np.bincount(owner[points] * CLASSES + _CLASS[buf[points]], minlength=docs * CLASSES).reshape(docs, CLASSES)
        self.words = textops.Words(buf, offsets)
        self.sizes = (self.chars.sum(axis=1), self.words.counts)

    def common(self, words: list[bytes], docs: np.ndarray) -> np.ndarray:
        """Counts of each common word, and of all other words, in the documents at `docs` (ascending)."""
        k = len(words)
        slot = pc.fill_null(pc.index_in(self.words.distinct, value_set=pa.array(words, type=pa.large_binary())), k).to_numpy(zero_copy_only=False)
        place = np.full(len(self.sizes[0]), -1)
        place[docs] = np.arange(len(docs))
        owner = place[self.words.doc_of_word()]
        mine = owner >= 0
        return np.bincount(owner[mine] * (k + 1) + slot[self.words.id[mine]], minlength=len(docs) * (k + 1)).reshape(len(docs), k + 1)

    def distances(self, refs: References, lang: str, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances of the documents at `docs` to a language, of characters and of words; NaN where they aren't used."""
        out = []
        for kind, share in enumerate(refs.shares.get(lang, (None, None))):
            d = np.full(len(docs), np.nan)
            long = np.flatnonzero(self.sizes[kind][docs] >= LEAST[kind])
            if share is not None and len(long):
                counts = self.chars[docs[long]][:, COMPARED] if kind == 0 else self.common(refs.common[lang], docs[long])
                d[long] = js_distance(counts.astype(np.float64), share[COMPARED] if kind == 0 else share)
            out.append(d)
        return out[0], out[1]


def _langs(part: pa.RecordBatch) -> list[str | None]:
    return part.column(part.schema.get_field_index("lang")).cast(pa.string()).to_pylist()


def _by_lang(langs: list[str | None]) -> dict[str, np.ndarray]:
    out: dict[str, list[int]] = {}
    for i, lang in enumerate(langs):
        if lang is not None:
            out.setdefault(lang, []).append(i)
    return {k: np.array(v) for k, v in out.items()}


_WORD_ROWS = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64())])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of each language hold each word, slice by slice; Spark adds up."""
    for batch in batches:
        for part in textops.slices(batch):
            words = textops.Words(*textops.utf8(textops.text_column(part)))
            size = len(words.distinct)
            pairs = np.unique(words.doc_of_word() * max(size, 1) + words.id)
            short = pc.less_equal(pc.binary_length(words.distinct), MAX_WORD_BYTES).to_numpy(zero_copy_only=False)
            for lang, docs in _by_lang(_langs(part)).items():
                mine = pairs[np.isin(pairs // max(size, 1), docs)] % max(size, 1)
                n = np.bincount(mine, minlength=size)
                at = np.flatnonzero((n > 0) & short) if size else np.zeros(0, np.int64)
                yield textops.batch_of(_WORD_ROWS, pa.array([lang]).take(pa.array(np.zeros(len(at), dtype=np.int64))), words.distinct.take(pa.array(at)).cast(pa.binary()), n[at])


def common_words(docs: DataFrame, top: int = TOP_WORDS) -> dict[str, list[bytes]]:
    """The words that most documents of each language hold, the most frequent first (ties by their bytes)."""
    counts = textops.narrow(docs, "text", "lang").mapInArrow(_count_words, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    best = counts.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("place") <= top)  # each task keeps its first `top` before they meet
    out: dict[str, list[bytes]] = {}
    for r in sorted(best.collect(), key=lambda r: (r.lang, r.place)):  # languages x top
        out.setdefault(r.lang, []).append(bytes(r.word))
    return out


_SHARES = pa.schema([("lang", pa.string()), ("class", pa.int32()), ("bin", pa.int32()), ("n", pa.int64())])


def _collect_shares(refs: Broadcast):
    """Histograms of the documents' shares of each class, a bounded number of rows for each task and language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in textops.slices(batch):
                m = Measured(textops.text_column(part))
                for lang, docs in _by_lang(_langs(part)).items():
                    common = refs.value.common.get(lang, [])
                    used, width = [], CLASSES + len(common) + 1
                    for kind in range(2):
                        mine = docs[m.sizes[kind][docs] >= LEAST[kind]]
                        counts = m.chars[mine] if kind == 0 else m.common(common, mine)
                        share = counts / np.maximum(m.sizes[kind][mine], 1)[:, None]
                        # shares are binned on a square-root scale: small shares keep their resolution
                        slot = np.minimum((np.sqrt(share) * SHARE_BINS).astype(np.int64), SHARE_BINS - 1) + (np.arange(counts.shape[1]) + kind * CLASSES)[None, :] * SHARE_BINS
                        used.append(slot.reshape(-1))
                    sums[lang] = sums.get(lang, 0) + np.bincount(np.concatenate(used), minlength=width * SHARE_BINS)
        for lang, counts in sums.items():
            at = np.flatnonzero(counts)
            yield textops.batch_of(_SHARES, [lang] * len(at), at // SHARE_BINS, at % SHARE_BINS, counts[at])

    return run


def _reference(counts: np.ndarray, kind: int) -> np.ndarray | None:
    """Shares of classes or words from histograms of the documents' shares (class x bin)."""
    total = counts.sum(axis=1)
    if not len(counts) or total[0] < MIN_REFERENCE_DOCS:
        return None
    bins = np.arange(SHARE_BINS)
    value = np.where(bins == 0, 0.0, ((bins + 0.5) / SHARE_BINS) ** 2)
    upto = np.cumsum(counts, axis=1)
    if kind == 0:
        return value[(upto >= total[:, None] / 2).argmax(axis=1)]
    # the mean of the middle nine tenths: most common words are missing from half of the short texts
    low, high = 0.05 * total[:, None], 0.95 * total[:, None]
    middle = np.clip(upto, low, high) - np.clip(upto - counts, low, high)
    return (middle * value).sum(axis=1) / middle.sum(axis=1)


_DISTANCES = pa.schema([("lang", pa.string()), ("kind", pa.int32()), ("length", pa.int32()), ("bin", pa.int32()), ("n", pa.int64())])


def _collect_distances(refs: Broadcast):
    """Histograms of the documents' distances to their languages, by kind and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int, int], np.ndarray] = {}
        for batch in batches:
            for part in textops.slices(batch):
                m = Measured(textops.text_column(part))
                for lang, docs in _by_lang(_langs(part)).items():
                    for kind, d in enumerate(m.distances(refs.value, lang, docs)):
                        used = ~np.isnan(d)
                        lengths = length_class(m.sizes[kind][docs])
                        for c in np.unique(lengths[used]):
                            bins = np.minimum((d[used & (lengths == c)] * DISTANCE_BINS).astype(np.int64), DISTANCE_BINS - 1)
                            key = (lang, kind, int(c))
                            sums[key] = sums.get(key, 0) + np.bincount(bins, minlength=DISTANCE_BINS)
        for (lang, kind, length), counts in sums.items():
            at = np.flatnonzero(counts)
            yield textops.batch_of(_DISTANCES, [lang] * len(at), [kind] * len(at), [length] * len(at), at, counts[at])

    return run


def references(docs: DataFrame) -> References:
    """Common words, references and limits of every language of docs (text, lang), from all rows."""
    rows, send = textops.narrow(docs, "text", "lang"), docs.sparkSession.sparkContext.broadcast
    refs = References(common_words(docs))
    found = rows.mapInArrow(_collect_shares(send(refs)), "lang string, class int, bin int, n long").groupBy("lang", "class", "bin").agg(F.sum("n").alias("n")).collect()  # languages x classes x bins, whatever the number of documents
    tables: dict[str, np.ndarray] = {}
    for r in found:
        tables.setdefault(r.lang, np.zeros((CLASSES + len(refs.common.get(r.lang, [])) + 1, SHARE_BINS)))[r["class"], r.bin] = r.n
    refs.shares = {lang: (_reference(t[:CLASSES], 0), _reference(t[CLASSES:], 1)) for lang, t in tables.items()}
    spread = rows.mapInArrow(_collect_distances(send(refs)), "lang string, kind int, length int, bin int, n long").groupBy("lang", "kind", "length")
    quarter = spread.agg(F.sum("n").alias("n"), F.percentile("bin", F.array(F.lit(0.25), F.lit(0.5)), F.col("n")).alias("q")).where(F.col("n") >= MIN_LIMIT_DOCS)
    refs.limits = {(r.lang, r.kind, r.length): ((r.q[1] + 0.5) / DISTANCE_BINS, (r.q[1] - r.q[0]) / DISTANCE_BINS) for r in quarter.collect()}  # languages x kinds x lengths
    return refs


def verdicts(texts: pa.Array, langs: list[str | None], refs: References) -> dict[str, np.ndarray]:
    out = base_counts(texts)
    m = Measured(texts)
    distance, fits = np.full((2, len(texts)), np.nan), np.ones((2, len(texts)), dtype=bool)
    for lang, docs in _by_lang(langs).items():
        for kind, d in enumerate(m.distances(refs, lang, docs)):
            distance[kind, docs] = d
            fits[kind, docs] = ~(d > refs.limit(lang, kind, m.sizes[kind][docs]))
    far = np.flatnonzero(~fits.all(axis=0))
    for lang in sorted(refs.shares) if len(far) else []:  # a wrong label? another language then has to take what this one doesn't
        good = np.stack([d <= refs.limit(lang, kind, m.sizes[kind][far]) for kind, d in enumerate(m.distances(refs, lang, far))])
        fits[:, far] |= (good | fits[:, far]).all(axis=0)
    out["char_distance"], out["word_distance"] = np.nan_to_num(distance)
    out["kept"] = ~out["base_failed"] & fits.all(axis=0)
    return out


_COLUMNS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean", "char_distance": "double", "word_distance": "double"}
_RESULT = pa.schema([("doc_id", pa.int64()), *((k, {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[t]) for k, t in _COLUMNS.items())])


def judge(docs: DataFrame) -> DataFrame:
    """Counts, distances to the own language (0 where not used) and the verdict `kept` of every row of docs (doc_id, text, lang)."""
    refs = docs.sparkSession.sparkContext.broadcast(references(docs))  # languages x TOP_WORDS words and a few hundred numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textops.slices(batch):
                v = verdicts(textops.text_column(part), _langs(part), refs.value)
                yield textops.batch_of(_RESULT, part.column(0).cast(pa.int64()), *(v[k] for k in _COLUMNS))

    return textops.narrow(docs, "doc_id", "text", "lang").mapInArrow(run, "doc_id long, " + ", ".join(f"{k} {t}" for k, t in _COLUMNS.items()))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that pass."""
    refs = docs.sparkSession.sparkContext.broadcast(references(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textops.slices(batch):
                yield part.filter(pa.array(verdicts(textops.text_column(part), _langs(part), refs.value)["kept"]))

    return textops.narrow(docs).mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema]))
