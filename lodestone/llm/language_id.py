"""Language identification by a linear-chain conditional random field over words.

Every word of a text gets a language: affixes (first and last 1 to 3 bytes), byte trigrams with word edges and the word itself (the
lexicon) score each language, learned transitions tie neighbours, and forward-backward gives each word's posterior
under the whole chain.  So code-switched texts are labelled word by word; a text's language is the one with the
largest mean posterior over its words that have a letter, and that mean is the score.

Chains have at most ``CHAIN`` words: longer texts are labelled in consecutive chains, whole, never by a prefix.

Training: only text and non-null ``lang`` of documents that are not held out, on a bounded sample - at most ``DOCS_PER_LANGUAGE``
documents of each language (chosen by a hash of the id) and ``CHUNKS`` chunks of ``CHAIN`` words from evenly spaced places
of each, words cut at ``WORD_BYTES``.  Half of the training chains join runs of several languages, from which the transitions learn.

``und`` with score 0: null or empty texts, texts without a letter, and all texts where nothing was learned.
Ties go to the first language in order.  Repeated rows get equal results, and count once in training.  An output column wins over a
kept one of its name; an empty table gives no rows.  The model is 2**TABLE_BITS x languages numbers.
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import TEXT, Words, cut, map_texts, mix, powers, prefix_hash, release

CHAIN = 64
DOCS_PER_LANGUAGE = 250
CHUNKS = 2
#: Longer words of the training sample are cut to so many bytes; prediction takes whole words.
WORD_BYTES = 200
TABLE_BITS = 17
ROUNDS = 40
AFFIX = 3


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # features x languages
    moves: np.ndarray  # languages x languages, from row to column


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - TABLE_BITS)).astype(np.int32)


def features(w: Words, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some words: feature slots (words x 7), the slots of their trigrams one word after the other, and where each word's begin."""
    s, e = w.start[some], w.end[some]
    p, inverse = prefix_hash(w.data), powers(len(w.data) + 1)[1]
    cols = [_slot(mix(w.hash[some] ^ np.uint64(0x77)))]
    for k in range(1, AFFIX + 1):
        to, back = np.minimum(s + k, e), np.maximum(e - k, s)
        cols.append(_slot(mix((p[to] - p[s]) * inverse[s] + np.uint64(1000 + k))))
        cols.append(_slot(mix((p[e] - p[back]) * inverse[back] + np.uint64(2000 + k))))
    edge = np.where(w.data <= 0x20, 0x20, w.data).astype(np.uint32)
    edge = np.concatenate((np.array([0x20], np.uint32), edge, np.array([0x20], np.uint32)))
    begin = np.concatenate((np.zeros(1, np.int64), np.cumsum(e - s)))
    at = np.arange(begin[-1]) - np.repeat(begin[:-1] - s, e - s)  # every byte of the words
    code = edge[at] << np.uint32(16) | edge[at + 1] << np.uint32(8) | edge[at + 2]  # with an edge byte at each side
    grams = _slot((code + np.uint64(0x3000000)) * np.uint64(0x9E3779B97F4A7C15))
    return np.stack(cols, 1), grams, begin[:-1]


def distinct(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each different word, and for every word the number of its own."""
    return np.unique(w.hash, return_index=True, return_inverse=True)[1:]


def emissions(w: Words, weights: np.ndarray) -> np.ndarray:
    """Scores words x languages: a word's depend on the word alone, so each different one is scored once."""
    some, which = distinct(w)
    slots, grams, begin = features(w, some)
    out = weights[slots[:, 0]]
    for k in range(1, slots.shape[1]):
        out += weights[slots[:, k]]
    if len(some):
        out += np.add.reduceat(weights[grams], begin, axis=0)
    return out[which]


def chains(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of the chains that texts (word index ``first``) are cut into."""
    counts = np.diff(first)
    n = -(-counts // CHAIN)
    owner = np.repeat(np.arange(len(counts)), n)
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    begin = first[:-1][owner] + rank * CHAIN
    return begin, np.minimum(CHAIN, first[1:][owner] - begin)


def forward_backward(scores: np.ndarray, begin: np.ndarray, length: np.ndarray, moves: np.ndarray, pairs: bool = False):
    """Posteriors words x languages; with ``pairs`` also the log likelihood's partition sum and expected transitions."""
    k, size = scores.shape[1], len(begin)
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    steps = int(length[0]) if size else 0
    alive = [int(np.searchsorted(-length, -t, "left")) for t in range(steps)]  # chains longer than t
    top = scores.max(1, keepdims=True) if len(scores) else scores
    like = np.exp(scores - top)
    trans = np.exp(moves)
    alpha, scale, post = [], [], np.zeros_like(like)
    for t in range(steps):
        n = alive[t]
        a = like[begin[:n] + t]
        if t:
            a = a * (alpha[-1][:n] @ trans)
        z = a.sum(1, keepdims=True)
        alpha.append(a / z)
        scale.append(z)
    expected = np.zeros((k, k))
    beta = np.ones((size, k), like.dtype)
    for t in range(steps - 1, -1, -1):
        n = alive[t]
        if t + 1 < steps:
            m = alive[t + 1]
            later = like[begin[:m] + t + 1] * beta[:m] / scale[t + 1]
            if pairs:
                expected += trans * (alpha[t][:m].T @ later)
            beta[:m] = later @ trans.T
        g = alpha[t] * beta[:n]
        post[begin[:n] + t] = g / g.sum(1, keepdims=True)
    if not pairs:
        return post
    total = float(sum(np.log(z).sum() for z in scale) + top.sum())
    return post, total, expected


def train(texts: list[tuple[str, str]], seed: int = 7) -> Model:
    """Fit on (language, text of at most CHAIN words) pairs; Adam on the whole sample."""
    langs = sorted({x for x, _ in texts})
    k = len(langs)
    if not k:
        return Model([], np.zeros((1 << TABLE_BITS, 0), np.float32), np.zeros((0, 0)))
    rnd = random.Random(seed)
    rows = [(langs.index(lang), [x for x in text.encode().replace(b"\n", b" ").split()]) for lang, text in sorted(texts)]
    rows = [r for r in rows if r[1]]
    rnd.shuffle(rows)
    seqs, labels = [], []
    for lang, words in rows:
        seqs.append(words)
        labels.append([lang] * len(words))
    for i in range(len(rows) if k > 1 else 0):  # runs of several languages
        words, tags = [], []
        for _ in range(rnd.randint(2, 4)):
            lang, other = rows[rnd.randrange(len(rows))]
            n = rnd.randint(4, 20)
            at = rnd.randrange(max(1, len(other) - n + 1))
            words += other[at : at + n]
            tags += [lang] * len(other[at : at + n])
        seqs.append(words[:CHAIN])
        labels.append(tags[:CHAIN])
    w = Words([b" ".join(x) for x in seqs])
    y = np.concatenate([np.array(x) for x in labels])
    begin, length = chains(w.first)
    some, which = distinct(w)
    slots, grams, at = features(w, some)
    flat = np.concatenate((slots.ravel(), grams))
    owner = np.concatenate((np.repeat(np.arange(len(some)), slots.shape[1]), np.repeat(np.arange(len(some)), np.diff(np.append(at, len(grams))))))
    words = len(w.start)
    inside = np.ones(words, bool)
    inside[begin] = False
    seen = np.zeros((k, k))
    np.add.at(seen, (y[np.flatnonzero(inside) - 1], y[inside]), 1)
    truth = np.eye(k, dtype=np.float32)[y]
    weights, moves = np.zeros((1 << TABLE_BITS, k), np.float32), np.zeros((k, k))
    state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(moves), np.zeros_like(moves)]
    for step in range(1, ROUNDS + 1):
        scores = np.zeros((len(some), k), np.float32)
        for c in range(k):
            scores[:, c] = np.bincount(owner, weights[flat, c], len(some))
        post, _, expected = forward_backward(scores[which], begin, length, moves, pairs=True)
        miss = np.stack([np.bincount(which, (truth - post)[:, c], len(some)) for c in range(k)], 1)
        grad = np.stack([np.bincount(flat, miss[owner, c], 1 << TABLE_BITS) for c in range(k)], 1).astype(np.float32) - 0.05 * weights
        for x, g, m, v in ((weights, grad, *state[:2]), (moves, seen - expected - 0.05 * moves, *state[2:])):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            x += 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return Model(langs, weights, moves.astype(np.float32))


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, *, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, str]]:
    """At most DOCS_PER_LANGUAGE * CHUNKS chunks of CHAIN words for each language."""
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    counts = {r[0]: r[1] for r in usable.groupBy(lang_col).count().collect()}  # a row for each language
    if not counts:
        return []
    place = F.xxhash64(F.col(id_col)).bitwiseAND(F.lit((1 << 40) - 1))
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, float(2 * DOCS_PER_LANGUAGE / n) * (1 << 40))))
    near = usable.where(place < share[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), place.alias("place"), F.col(text_col).cast("binary").alias(TEXT))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lang, at, text in zip(*(batch.column(c) for c in ("lang", "place", TEXT)), strict=True):
                words, parts = text.as_py().split(), []
                for k in range(CHUNKS):
                    begin = max(0, (len(words) - CHAIN) * (2 * k + 1) // (2 * CHUNKS)) if len(words) > CHAIN else 0
                    parts.append(b" ".join(x[:WORD_BYTES] for x in words[begin : begin + CHAIN]).decode("utf-8", "replace"))
                    if len(words) <= CHAIN:
                        break
                rows.append((lang.as_py(), at.as_py(), parts))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.list_(pa.string())))], names=["lang", "place", "parts"])

    made = near.mapInArrow(chunks, "lang string, place long, parts array<string>")
    # rows that repeat an id, or share its hash, count once
    made = cut(made.groupBy("lang", "place").agg(F.min("parts").alias("parts")), "sample")
    first = F.row_number().over(Window.partitionBy("lang").orderBy("place"))  # of about 2 * DOCS_PER_LANGUAGE rows
    rows = made.withColumn("rank", first).where(F.col("rank") <= DOCS_PER_LANGUAGE).orderBy("lang", "rank").select("lang", "parts").collect()
    release(made)
    return [(r["lang"], p) for r in rows for p in r["parts"]]


def _has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def predict(texts: list[bytes], model: Model) -> tuple[list[str], list[float], list[list[float]]]:
    """Language, score and mean posteriors of each text."""
    k = len(model.langs)
    if not k:
        return ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
    w = Words(texts)
    post = forward_backward(emissions(w, model.weights), *chains(w.first), model.moves)
    byte = w.data
    letter = ((byte >= 97) & (byte <= 122)) | (byte >= 0x80)
    n = np.concatenate((np.zeros(1, np.int32), np.cumsum(letter, dtype=np.int32)))
    lettered = n[w.end] > n[w.start]
    sums = np.stack([np.bincount(w.doc[lettered], post[lettered, c], len(texts)) for c in range(k)], 1)
    totals = sums.sum(1, keepdims=True)
    means = sums / np.where(totals == 0, 1, totals)
    ascii_letter = np.bincount(np.searchsorted(w.offset, np.flatnonzero((byte >= 97) & (byte <= 122)), "right") - 1, minlength=len(texts)) > 0
    some = [bool(a) or _has_letter(t) for a, t in zip(ascii_letter, texts, strict=True)]
    best = means.argmax(1)
    langs = [model.langs[b] if ok else "und" for b, ok in zip(best, some, strict=True)]
    scores = [float(min(1.0, means[i, b])) if ok else 0.0 for i, (b, ok) in enumerate(zip(best, some, strict=True))]
    return langs, scores, means.tolist()


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """Kept columns, ``held_out``, ``lang_pred`` and ``score``."""
    sample = training_sample(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    model = docs.sparkSession.sparkContext.broadcast(train(sample))

    def label(texts: list[bytes], _: pa.RecordBatch) -> list:
        return list(predict(texts, model.value)[:2])

    named = map_texts(docs.withColumn("held_out", held_out(id_col)), label, [("lang_pred", T.StringType()), ("score", T.DoubleType())], text_col=text_col, keep=[*(c for c in keep if c != "held_out"), "held_out"])
    return named


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "held_out", "lang_pred", "score")
