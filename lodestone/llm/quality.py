"""Quality rules by distribution divergence from language references.

References, from all documents with a language: the histogram of character classes, and that of common words (words with at least
``share`` of a language's words, at most ``top``; the rest count as one).  A word that frequent is that frequent in some
input partition, so each partition reports the words with half that share (found with a bounded number of counters, whose counts
are upper bounds); those whose reported sum is below half the share are out, which leaves at most 3 / share words
a language, and these are then counted exactly.

A document is compared with its own language's reference (``lang``).  Another language's clears it only if it lies within
``other`` of the limits there: that is for texts with a wrong or unknown ``lang``, and keeps junk that is by chance a little
nearer to another language.  It is dropped if the Jensen-Shannon distance (base 2, so 0 to 1) of either histogram exceeds its limit.

Length guards: a histogram of n words in k bins has a squared distance of about k / (8 ln 2 n) from its own source, so that much is
taken off the squared distance of the common words, and ``char_noise`` / n off that of the classes.  Texts of fewer than ``least_words``
words are not judged by histograms at all (the base rules drop them).

Base rules come first: fewer than 10 words, or more than 20 per cent of the words in five-word windows that the text
repeats.  Null and empty texts have no words and fail them.  Words are ``[^\\x20\\x09-\\x0D]+``; case counts.  An
empty table has no references and no rows.  Repeated rows get equal results; of equal distances the first language's counts.  An output
column wins over a kept one of its name.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import SPACE, TEXT, Words, map_texts, mix, slices

CLASSES = 8
_KIND = np.full(256, 7, np.uint8)  # 7: control characters
_KIND[97:123] = 0
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[SPACE] = 3
_KIND[[ord(c) for c in ".,;:!?'\"()-"]] = 4
_KIND[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 5
_KIND[0xC0:] = 6  # a first byte of a longer code point
_KIND[0x80:0xC0] = CLASSES  # not a code point of its own
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
STRIP = b" \t\n\x0b\x0c\r"


def _per_doc(flags: np.ndarray, offset: np.ndarray) -> np.ndarray:
    c = np.concatenate((np.zeros(1, np.int64), np.cumsum(flags, dtype=np.int64)))
    return c[offset[1:] - 1] - c[offset[:-1]]  # without the line feed after each text


def class_counts(w: Words) -> np.ndarray:
    """Code points by class, texts x CLASSES."""
    owner = np.repeat(np.arange(len(w.counts)), np.diff(w.offset))
    out = np.bincount(owner * (CLASSES + 1) + _KIND[w.raw], minlength=len(w.counts) * (CLASSES + 1)).reshape(-1, CLASSES + 1)
    out[:, 3] -= 1  # the line feed after each text
    return out[:, :CLASSES]


def repeated_words(w: Words, n: int = 5) -> np.ndarray:
    """Words of each text that lie in an n-word window found twice or more in it."""
    h, doc = w.hash, w.doc
    full = len(h) - n + 1
    if full <= 0:
        return np.zeros(len(w.counts), np.int64)
    key = mix(doc[:full].astype(np.uint64) + np.uint64(1))
    for k in range(n):
        key = mix(key + h[k : full + k])
    at = np.flatnonzero(doc[:full] == doc[n - 1 :])
    order = at[np.argsort(key[at], kind="stable")]
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, order[twice], 1)
    np.add.at(edge, order[twice] + n, -1)
    return np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=len(w.counts))


def base_counts(texts: list[bytes], w: Words) -> dict[str, np.ndarray]:
    lines = []
    for t in texts:
        own = [x for x in t.split(b"\n") if x.strip(STRIP)]
        lines.append(len(own) - len(set(own)))
    inside = ~SPACE[w.raw] & ((w.raw & 0xC0) != 0x80)
    return {"n_words": w.counts, "word_chars": _per_doc(inside, w.offset), "n_symbols": _per_doc(_SYMBOL[w.raw], w.offset), "n_dup_lines": np.array(lines, np.int64), "n_repeat_words": repeated_words(w)}


@dataclass
class References:
    """Of each language its class shares, its common words' hashes (sorted) and their shares with that of the rest last."""

    langs: list[str]
    classes: list[np.ndarray]
    words: list[np.ndarray]
    shares: list[np.ndarray]


def _texts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias(TEXT))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["lang", "word", "n"])


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    groups = defaultdict(list)
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column(TEXT).to_pylist(), strict=True):
        groups[lang].append(text)
    yield from groups.items()


def references(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", share: float = 0.002, top: int = 64) -> References:
    spark, source = docs.sparkSession, _texts(docs, lang_col, text_col)

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, totals, missed = defaultdict(list), defaultdict(int), defaultdict(int)
        for part in slices(batches):
            for lang, texts in _by_lang(part):
                h = Words(texts, lower=False).hash
                totals[lang] += len(h)
                seen[lang].append(np.unique(h, return_counts=True))
                if len(seen[lang]) > 16:
                    *kept, less = bounded(*_sum(seen[lang]), int(8 / share))
                    seen[lang] = [tuple(kept)]
                    missed[lang] += less
        for lang, parts in seen.items():
            h, n = _sum(parts)
            n += missed[lang]
            often = n >= share / 2 * totals[lang]
            yield _rows([(lang, None, totals[lang]), *((lang, int(a), int(b)) for a, b in zip(h[often].view(np.int64), n[often], strict=True))])

    reported = source.mapInArrow(frequent, "lang string, word long, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    totals = F.broadcast(reported.where("word is null").select("lang", F.col("n").alias("total")))  # a row for each language
    candidates = defaultdict(list)
    for r in reported.where("word is not null").join(totals, "lang").where(F.col("n") >= F.col("total") * (share / 2)).select("lang", "word").toLocalIterator():
        candidates[r["lang"]].append(r["word"])
    wanted = spark.sparkContext.broadcast({k: np.sort(np.array(v, np.int64).view(np.uint64)) for k, v in candidates.items()})

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = defaultdict(int)
        for part in slices(batches):
            for lang, texts in _by_lang(part):
                w, words = Words(texts, lower=False), wanted.value.get(lang, np.zeros(0, np.uint64))
                for k, n in enumerate(class_counts(w).sum(0).tolist()):
                    totals[lang, k, True] += n
                place = places(w.hash, words)
                for k, n in enumerate(np.bincount(place, minlength=len(words) + 1).tolist()):
                    totals[lang, int(words[k : k + 1].view(np.int64)[0]) if k < len(words) else None, False] += n
        if totals:
            yield _rows([(("c" if kind else "w") + lang, key, n) for (lang, key, kind), n in totals.items()])

    classes, words = defaultdict(lambda: np.zeros(CLASSES)), defaultdict(list)
    for r in source.mapInArrow(exact, "lang string, word long, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).collect():  # CLASSES + 2 / share rows a language at most
        kind, lang = r["lang"][0], r["lang"][1:]
        if kind == "c":
            classes[lang][r["word"]] = r["n"]
        else:
            words[lang].append((r["word"], r["n"]))
    out = References([], [], [], [])
    for lang in sorted(classes):
        total = sum(n for _, n in words[lang])
        common = sorted(((n, k) for k, n in words[lang] if k is not None and n >= share * total), reverse=True)[:top]
        if not total or not common:
            continue
        h = np.array([k for _, k in common], np.int64).view(np.uint64)
        order = np.argsort(h)
        n = np.array([n for n, _ in common])[order]
        out.langs.append(lang)
        out.classes.append(classes[lang] / classes[lang].sum())
        out.words.append(h[order])
        out.shares.append(np.append(n, total - n.sum()) / total)
    return out


def bounded(h: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """At most ``size`` counters: all lose the count of the first one too many, which is returned as what may be missing."""
    if len(n) <= size:
        return h, n, 0
    less = int(np.partition(n, len(n) - size - 1)[len(n) - size - 1])
    left = n > less
    return h[left], n[left] - less, less


def _sum(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    h, inverse = np.unique(np.concatenate([a for a, _ in parts]), return_inverse=True)
    return h, np.bincount(inverse, np.concatenate([b for _, b in parts]), len(h)).astype(np.int64)


def places(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The index of each hash in sorted ``words``, or their number."""
    if not len(words):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
    return np.where(words[at] == h, at, len(words))


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of each row of ``p`` to ``q``."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


def divergences(w: Words, refs: References) -> tuple[np.ndarray, np.ndarray]:
    """Distances texts x languages of the class and of the common-word histograms (0 where a text has none)."""
    classes = class_counts(w)
    n = len(w.counts)
    p = classes / np.maximum(classes.sum(1, keepdims=True), 1)
    c = np.stack([js_distance(p, q) for q in refs.classes], 1)
    out = []
    for words, shares in zip(refs.words, refs.shares, strict=True):
        k = len(words) + 1
        hist = np.bincount(w.doc * k + places(w.hash, words), minlength=n * k).reshape(n, k)
        out.append(js_distance(hist / np.maximum(hist.sum(1, keepdims=True), 1), shares))
    return np.where(classes.sum(1, keepdims=True) > 0, c, 0), np.where(w.counts[:, None] > 0, np.stack(out, 1), 0)


def verdict(chars: np.ndarray, words: np.ndarray, n_words: np.ndarray, own: np.ndarray, bins: np.ndarray, *, char_limit: float, word_limit: float, char_noise: float, least_words: int, other: float) -> tuple[np.ndarray, np.ndarray]:
    """For distances texts x languages: the language that counts, and how far the text goes towards its limits (over 1: beyond).

    ``own`` is the number of the text's language, or -1; ``bins`` the number of common words of each language.
    """
    n = np.maximum(n_words, 1)[:, None]
    far = np.maximum(words**2 - bins / (8 * np.log(2) * n), 0) / word_limit**2
    far = np.maximum(far, np.maximum(chars**2 - char_noise / n, 0) / char_limit**2)
    far = np.where(n_words[:, None] >= least_words, far, 0)
    far = far / np.where(np.arange(far.shape[1]) == own[:, None], 1, other)
    first = np.where((own >= 0) & (far[np.arange(len(n)), own] <= 1), own, far.argmin(1))
    return first, far[np.arange(len(n)), first]


def quality(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", keep: Iterable[str] = ("doc_id",), char_limit: float = 0.18, word_limit: float = 0.265, char_noise: float = 4.0, least_words: int = 10, other: float = 0.8, share: float = 0.002, top: int = 64) -> DataFrame:
    """Kept columns, the base counts, ``base_failed``, ``char_distance``, ``word_distance`` and ``kept``."""
    refs = docs.sparkSession.sparkContext.broadcast(references(docs, text_col=text_col, lang_col=lang_col, share=share, top=top))
    limits = {"char_limit": char_limit, "word_limit": word_limit, "char_noise": char_noise, "least_words": least_words, "other": other}

    def judge(texts: list[bytes], batch: pa.RecordBatch) -> list:
        w = Words(texts, lower=False)
        counts = base_counts(texts, w)
        words = counts["n_words"]
        failed = (words < 10) | (100 * counts["n_repeat_words"] > 20 * words)
        kept, c, v = ~failed, np.zeros(len(texts)), np.zeros(len(texts))
        if (langs := refs.value.langs) and len(texts):
            number = {x: k for k, x in enumerate(langs)}
            own = np.array([number.get(x, -1) for x in batch.column("__lang").to_pylist()])
            c, v = divergences(w, refs.value)
            use, far = verdict(c, v, words, own, np.array([len(x) for x in refs.value.words]), **limits)
            c, v = c[np.arange(len(texts)), use], v[np.arange(len(texts)), use]
            kept = kept & (far <= 1)
        return [*(pa.array(x.astype(np.int64)) for x in counts.values()), pa.array(failed), pa.array(c), pa.array(v), pa.array(kept)]

    names = [(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    fields = [*names, ("base_failed", T.BooleanType()), ("char_distance", T.DoubleType()), ("word_distance", T.DoubleType()), ("kept", T.BooleanType())]
    return map_texts(docs.withColumn("__lang", F.col(lang_col)), judge, fields, text_col=text_col, keep=[*keep, "__lang"]).drop("__lang")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
