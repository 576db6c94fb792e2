"""Language identification with a linear-chain conditional random field (op 4).

Every word of a text gets a label: emissions come from affix, character n-gram, whole-word and
lexicon features, transitions between labels are learned, and forward-backward gives each
word's posterior over the languages.  A document's language is the one with the largest sum of
posteriors and its score is that sum's share.  Runs of words with the same best label show where
code-switched text changes language.

Training uses a bounded sample of labelled rows: at most ``DOCS_PER_LANG`` documents a language
(smallest hashes of the id), from each at most ``SEGMENTS`` evenly spread runs of
``SEGMENT_WORDS`` words.  Runs of different documents are strung together, so transitions see
changes of language.  Training minimises the exact negative log-likelihood on the driver.
Only text and lang of the sample are learned from; a prediction sees text alone.

Prediction runs where the text is read: a word's emissions are computed once and remembered, and
documents of an Arrow batch are stepped through together, longest first.

Defined results: ``und`` with score 0 where text is null or has no letter, and for every row if
nothing could be learned; a tie goes to the first language by name; a null doc_id is not held
out and not learned from; repeated rows each keep a row; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import once, rows_of

UNKNOWN = "und"
DOCS_PER_LANG = 150
SEGMENTS, SEGMENT_WORDS = 6, 40
BUCKETS = 1 << 17
LEXICON_WORDS = 300
SEQUENCE = 120
STEPS, RATE, DECAY = 80, 0.15, 0.02
SALTS = 32
#: Posteriors (words times languages) held at once while documents are stepped through.
HELD = 1 << 20
MEMO_WORDS = 200_000
#: Words whose features are listed at once.
WORDS_AT_ONCE = 4096
SEED = 11


def clean(token: str) -> str:
    """The token's letters in lower case."""
    return token.lower() if token.isalpha() else "".join([c for c in token.lower() if c.isalpha()])


def word_features(word: str, lexicon: dict[str, tuple[str, ...]]) -> list[int]:
    """Hashed features of a clean word: whole word, affixes, n-grams, length, lexicon.

    Affixes and n-grams are taken from the UTF-8 bytes; each family has a seed of its own.
    """
    crc, raw = zlib.crc32, word.encode("utf-8", "replace")
    padded, size = b"<" + raw + b">", len(raw)
    most = min(size, 4) + 1
    out = [crc(raw, 1), crc(b"#", min(size, 16))]
    out += [crc(raw[:n], 2) for n in range(1, most)]
    out += [crc(raw[-n:], 3) for n in range(1, most)]
    out += [crc(padded[i:i + 2], 4) for i in range(size + 1)]
    out += [crc(padded[i:i + 3], 5) for i in range(size)]
    if word in lexicon:
        out += [crc(lang.encode(), 6) for lang in lexicon[word]]
    return out


def feature_table(words: list[str], lexicon: dict[str, tuple[str, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all words' features in a row, where each word's features start)."""
    features = [word_features(w, lexicon) for w in words]
    counted = np.array([len(f) for f in features], dtype=np.int64)
    flat = np.fromiter(chain.from_iterable(features), dtype=np.int64, count=int(counted.sum()))
    return flat & (BUCKETS - 1), np.cumsum(counted) - counted


@dataclass
class Model:
    """Learned languages, feature weights, transitions (from, to), starts and lexicon."""

    langs: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray
    lexicon: dict[str, tuple[str, ...]]
    name: str = ""

    def emissions(self, words: list[str]) -> np.ndarray:
        """A row of label scores for every clean word."""
        out = np.zeros((len(words), len(self.langs)))
        for at in range(0, len(words), WORDS_AT_ONCE):
            flat, starts = feature_table(words[at:at + WORDS_AT_ONCE], self.lexicon)
            out[at:at + WORDS_AT_ONCE] = np.add.reduceat(self.weights[flat], starts, axis=0)
        return out


def _steps(scores: np.ndarray) -> np.ndarray:
    """Scores as factors, scaled row by row."""
    return np.exp(scores - scores.max(axis=1, keepdims=True))


def forward_backward(factors: np.ndarray, sizes: np.ndarray, transitions: np.ndarray, start: np.ndarray):
    """Posteriors of sequences stepped through together.

    ``factors`` holds the words' label factors step by step: first all first words, then all
    second words and so on; ``sizes[t]`` sequences (the longest first) have a word at step t.
    Returns posteriors in the same layout, and the pair sums over all steps.
    """
    at = np.concatenate([[0], np.cumsum(sizes)])
    alphas, scale = np.empty_like(factors), np.empty(len(factors))
    move = np.exp(transitions)
    before = np.exp(start - start.max())[None, :]
    for t, k in enumerate(sizes):
        here = (before if t == 0 else before[:k] @ move) * factors[at[t]:at[t] + k]
        total = here.sum(axis=1)
        before = here / total[:, None]
        alphas[at[t]:at[t] + k], scale[at[t]:at[t] + k] = before, total
    pairs = np.zeros_like(move)
    beta = np.ones((sizes[0] if len(sizes) else 0, factors.shape[1]))
    for t in range(len(sizes) - 1, -1, -1):
        k = sizes[t]
        later = sizes[t + 1] if t + 1 < len(sizes) else 0
        if later:
            span = slice(at[t + 1], at[t + 1] + later)
            pulled = beta[:later] * factors[span] / scale[span][:, None]
            pairs += move * (alphas[at[t]:at[t] + later].T @ pulled)
            beta[:later] = pulled @ move.T
        alphas[at[t]:at[t] + k] *= beta[:k]
    return alphas, pairs


def learn(samples: list[tuple[str, list[str]]], steps: int = STEPS) -> Model:
    """Fit the field to (language, clean words) runs."""
    samples = sorted((lang, words) for lang, words in samples if words)
    langs = sorted({lang for lang, _ in samples})
    size = len(langs)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0)), np.zeros(0), {})
    counts: dict[str, Counter] = defaultdict(Counter)
    for lang, words in samples:
        counts[lang].update(words)
    listed = defaultdict(list)
    for lang in langs:
        for word, n in sorted(counts[lang].items(), key=lambda x: (-x[1], x[0]))[:LEXICON_WORDS]:
            if n > 1:
                listed[word].append(lang)
    lexicon = {word: tuple(found) for word, found in listed.items()}

    rng = np.random.default_rng(SEED)
    stream, labels, kinds = [], [], {}
    for n in rng.permutation(len(samples)):
        lang, words = samples[n]
        stream += [kinds.setdefault(w, len(kinds)) for w in words]
        labels += [langs.index(lang)] * len(words)
    length = min(SEQUENCE, len(stream))
    rows = len(stream) // length
    # Step by step: the first words of all sequences, then the second words and so on.
    tokens = np.array(stream[:rows * length]).reshape(rows, length).T.ravel()
    truth = np.array(labels[:rows * length]).reshape(rows, length).T.ravel()
    sizes = np.full(length, rows)
    flat, starts = feature_table(list(kinds), lexicon)
    used, flat = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(len(kinds)), np.diff(starts, append=len(flat)))

    seen = np.zeros((len(kinds), size))
    np.add.at(seen, (tokens, truth), 1)
    follow = np.zeros((size, size))
    np.add.at(follow, (truth[:-rows], truth[rows:]) if length > 1 else (truth[:0], truth[:0]), 1)
    first = np.bincount(truth[:rows], minlength=size)

    shapes = [(len(used), size), (size, size), (size,)]
    params = [np.zeros(s) for s in shapes]
    mean, square = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    for step in range(1, steps + 1):
        weights, transitions, start = params
        scores = np.add.reduceat(weights[flat], starts, axis=0)
        post, pairs = forward_backward(_steps(scores)[tokens], sizes, transitions, start)
        expected = np.column_stack([np.bincount(tokens, post[:, k], len(kinds)) for k in range(size)])
        pull = (expected - seen)[owner]
        grads = [np.column_stack([np.bincount(flat, pull[:, k], len(used)) for k in range(size)]) + DECAY * weights,
                 pairs - follow + DECAY * transitions, post[:rows].sum(axis=0) - first + DECAY * start]
        for i, grad in enumerate(grads):  # Adam
            mean[i] = 0.9 * mean[i] + 0.1 * grad
            square[i] = 0.99 * square[i] + 0.01 * grad * grad
            params[i] = params[i] - RATE * (mean[i] / (1 - 0.9 ** step)) / (np.sqrt(square[i] / (1 - 0.99 ** step)) + 1e-8)
    whole = np.zeros((BUCKETS, size), np.float32)
    whole[used] = params[0]
    digest = zlib.crc32(whole.tobytes() + params[1].tobytes())
    return Model(langs, whole, params[1], params[2], lexicon, f"crf-{digest:08x}")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sampled(docs: DataFrame, per_lang: int) -> DataFrame:
    """(doc_id, lang) of at most ``per_lang`` rows a language; reads ids and languages only."""
    rows = (docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out())
            .select("doc_id", "lang", F.xxhash64("doc_id").alias("h")))
    rows = rows.withColumn("salt", F.pmod(F.col("h"), F.lit(SALTS)))
    for keys in (["lang", "salt"], ["lang"]):
        order = Window.partitionBy(*keys).orderBy("h", "doc_id")
        rows = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_lang)
    return rows.select("doc_id", "lang")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Evenly spread runs of each text's clean words, space-joined."""
    for lang, text in rows_of(batches, "lang", "text"):
        words = [c for c in map(clean, (text or "").split()) if c]
        gap = max(SEGMENT_WORDS, len(words) // SEGMENTS)
        runs = [" ".join(words[at:at + SEGMENT_WORDS]) for at in range(0, len(words), gap)][:SEGMENTS]
        yield pa.RecordBatch.from_pydict({"lang": [lang] * len(runs), "run": runs}, schema=pa.schema(
            [("lang", pa.string()), ("run", pa.string())]))


def train(docs: DataFrame, per_lang: int = DOCS_PER_LANG, steps: int = STEPS) -> Model:
    """A model of the rows of ``docs(doc_id, text, lang)`` that are not held out."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                         F.col("lang").cast("string").alias("lang"))
    picked = _sampled(narrow.select("doc_id", "lang"), per_lang).collect()  # at most per_lang a language
    ids = sorted({r.doc_id for r in picked})
    if not ids:
        return learn([])
    texts = narrow.where(F.col("doc_id").isin(ids) & F.col("lang").isNotNull()).dropDuplicates(["doc_id"])
    rows = texts.select("lang", "text").mapInArrow(_runs, "lang string, run string").collect()
    return learn([(r.lang, r.run.split(" ")) for r in rows], steps)


class Labeller:
    """A model at work in one Python process, with the emissions of words met so far."""

    def __init__(self, model: Model):
        self.model, self.row, self.factors = model, {}, np.zeros((0, len(model.langs)))

    @classmethod
    def of(cls, model: Model) -> Labeller:
        return once(("labeller", model.name), lambda: cls(model))

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """For each text the factor rows of its words with a letter."""
        row, split = self.row, [t.split() for t in texts]
        if len(row) > MEMO_WORDS:
            row.clear()
            self.factors = self.factors[:0]
        fresh = [w for w in {w for words in split for w in words} if w not in row]
        if fresh:
            cleaned = dict(zip(fresh, map(clean, fresh), strict=True))
            kinds = sorted({c for c in cleaned.values() if c})
            place = {c: i for i, c in enumerate(kinds, len(self.factors))}
            self.factors = np.concatenate([self.factors, _steps(self.model.emissions(kinds))]) if kinds else self.factors
            row.update((w, place.get(c, -1)) for w, c in cleaned.items())
        found = [np.fromiter(map(row.__getitem__, words), dtype=np.int64, count=len(words)) for words in split]
        return [n[n >= 0] for n in found]

    def label(self, texts: list[str]) -> list[tuple[str, float, np.ndarray]]:
        """(language, score, best label of every word with a letter) of every text."""
        size = len(self.model.langs)
        out: list = [(UNKNOWN, 0.0, np.zeros(0, dtype=np.int64))] * len(texts)
        if not size:
            return out
        words = self.numbers(texts)
        order = sorted((i for i in range(len(texts)) if len(words[i])), key=lambda i: -len(words[i]))
        while order:
            take, held = 1, len(words[order[0]]) * size
            while take < len(order) and held + len(words[order[take]]) * size <= HELD:
                held += len(words[order[take]]) * size
                take += 1
            for i, found in zip(order[:take], self._together([words[i] for i in order[:take]]), strict=True):
                out[i] = found
            order = order[take:]
        return out

    def _together(self, words: list[np.ndarray]) -> list[tuple[str, float, np.ndarray]]:
        lengths = np.array([len(w) for w in words])
        sizes = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), "right")
        at = np.cumsum(sizes) - sizes
        laid = np.empty(lengths.sum(), dtype=np.int64)
        for d, numbers in enumerate(words):
            laid[at[:len(numbers)] + d] = numbers
        post, _ = forward_backward(self.factors[laid], sizes, self.model.transitions, self.model.start)
        best, out = post.argmax(axis=1), []
        for d, numbers in enumerate(words):
            mine = at[:len(numbers)] + d
            mass = post[mine].sum(axis=0)
            k = int(mass.argmax())
            out.append((self.model.langs[k], float(min(1.0, max(0.0, mass[k] / mass.sum()))), best[mine]))
        return out


def batches_of_texts(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[list[str]]:
    """The batch's texts in order, in lists of about ``most`` characters."""
    held, size = [], 0
    for (text,) in rows_of([batch], "text"):
        held.append(text or "")
        size += len(held[-1])
        if size >= most:
            yield held
            held, size = [], 0
    yield held


LABELLED = "doc_id long, lang_pred string, score double, runs array<struct<lang:string,words:int>>"


def label(docs: DataFrame, model: Model, runs: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score, runs) of every row; ``runs`` are a text's changes of language."""
    kind = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int32())]))

    def shown(best: np.ndarray) -> list[dict] | None:
        if not runs:
            return None
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(best)) + 1, [len(best)]]) if len(best) else [0]
        return [{"lang": model.langs[best[a]], "words": int(b - a)} for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller.of(model)
        for batch in batches:
            found = [f for texts in batches_of_texts(batch) for f in labeller.label(texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64()), pa.array([shown(f[2]) for f in found], kind)],
                ["doc_id", "lang_pred", "score", "runs"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, LABELLED)


def identify(docs: DataFrame) -> DataFrame:
    """Train on the rows that are not held out and label every row."""
    return label(docs, train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """The rows of ``docs`` whose language is known with a score of ``least`` or more."""
    model = train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller.of(model)
        for batch in batches:
            found = [f for texts in batches_of_texts(batch) for f in labeller.label(texts)]
            yield batch.filter(pa.array([f[0] != UNKNOWN and f[1] >= least for f in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
