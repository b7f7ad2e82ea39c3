"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities of the pieces of a fixed public vocabulary. The probability of a word is the sum, over
all ways to segment it into pieces, of the products of their probabilities; a forward algorithm gives it in one pass. A
text's log-probability is the sum over its words, each preceded by the vocabulary's word mark. Piece probabilities
come from expected counts (forward-backward over all segmentations) in rounds of expectation maximisation over a bounded
sample of labelled texts; a round's counts are summed by Spark and only (language, piece) totals reach the driver.

Words are runs of letters in lower case, by Unicode; a run of over LONGEST letters, as in a script without spaces, counts as words of
LONGEST letters and a rest. A task scores each distinct word once, so a text costs one lookup a word.

Defined results: a text that is null or has no letter is `und` with score 0; without any labelled text every text is
`und`; ties go to the language that sorts first. A score is the probability of the language given the text, all
languages alike before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.bytewords import ALPHA, LOWER, boundaries, by_value, classes, column_of, first_use, hashes, restored, slices
from corpusloom.llm.common import checkpointed, table, text_batches

by_value(__name__)

SLICE = 4 << 20
#: About so many labelled texts of each language are learned from.
SAMPLE_TEXTS = 400
ROUNDS = 3
#: Most learned languages: the model has as many numbers for each piece.
MOST_LANGUAGES = 1_000
#: Probability of a character that is no piece, in every language.
UNKNOWN = 1e-7
SHORT = 40
#: Letters of a word; longer runs are cut. No letter is left out.
LONGEST = 64
LETTERS = re.compile(r"[^\W\d_]{1,%d}" % LONGEST)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def vocabulary(path: str | None = None) -> list[str]:
    """The distinct pieces, in lower case, without control and byte pieces."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    return sorted({model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))})


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Pieces:
    """Piece numbers of many substrings at once, by a rolling hash of code points; len(pieces) stands for none."""

    def __init__(self, pieces: list[str]):
        self.pieces, self.longest = pieces, max(map(len, pieces), default=1)
        h = np.array([self._hash(p) for p in pieces], np.uint64)
        self.order = np.argsort(h)
        self.hash = h[self.order]
        if (self.hash[1:] == self.hash[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(h >> np.uint64(44)).astype(np.int64)] = True

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(BASE) + ord(c) + 1) & (1 << 64) - 1
        return int(_mixed(np.array([h], np.uint64))[0])

    def find(self, h: np.ndarray) -> np.ndarray:
        h = _mixed(h)
        out = np.full(len(h), len(self.pieces), np.int64)
        may = np.flatnonzero(self.filter[(h >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hash, h[may]), len(self.hash) - 1)
        same = self.hash[at] == h[may]
        out[may[same]] = self.order[at[same]]
        return out

    def lattice(self, points: np.ndarray) -> Iterator[list[tuple[int, np.ndarray, np.ndarray]]]:
        """For words of one length (rows of code points), by end position: (begin, rows, piece numbers) of the pieces that end there."""
        n, m = points.shape
        prefix = np.zeros((m + 1, n), np.uint64)
        for i in range(m):
            prefix[i + 1] = prefix[i] * BASE + points[:, i] + np.uint64(1)
        power = [np.uint64(1)]
        for _ in range(self.longest):
            power.append(np.uint64(int(power[-1]) * int(BASE) & (1 << 64) - 1))
        for i in range(1, m + 1):
            here = []
            for size in range(1, min(i, self.longest) + 1):
                piece = self.find(prefix[i] - prefix[i - size] * power[size])
                rows = np.arange(n) if size == 1 else np.flatnonzero(piece < len(self.pieces))
                if len(rows):
                    here.append((i - size, rows, piece[rows]))
            yield here


def log_probability(pieces: Pieces, words: list[str], probability: np.ndarray) -> np.ndarray:
    """log P(word) for each word and language, by the forward algorithm; `probability` has a last row for an unknown character.

    Sums are of plain probabilities up to SHORT code points, where they cannot vanish, and of logarithms beyond."""
    kinds = probability.shape[1]
    out = np.zeros((len(words), kinds))
    logs = np.log(probability)
    for rows, points in by_length(words):
        long = points.shape[1] > SHORT
        sums = [np.zeros((len(rows), kinds)) if long else np.ones((len(rows), kinds))]
        for here in pieces.lattice(points):
            if long:
                total = np.full((len(rows), kinds), -np.inf)
                for begin, r, piece in here:
                    total[r] = np.logaddexp(total[r], sums[begin][r] + logs[piece])
            else:
                total = np.zeros((len(rows), kinds))
                for begin, r, piece in here:
                    if len(r) == len(rows):
                        total += sums[begin] * probability[piece]
                    else:
                        total[r] += sums[begin][r] * probability[piece]
            sums.append(total)
        out[rows] = sums[-1] if long else np.log(sums[-1])
    return out


def expected(pieces: Pieces, words: list[str], weight: np.ndarray, probability: np.ndarray) -> np.ndarray:
    """Expected counts of pieces over all segmentations of weighted words, in one language."""
    counts = np.zeros(len(pieces.pieces) + 1)
    for rows, points in by_length(words):
        lattice, n = list(pieces.lattice(points)), len(rows)
        a = [np.zeros(n)]
        for here in lattice:
            terms = np.full(n, -np.inf)
            for begin, r, piece in here:
                terms[r] = np.logaddexp(terms[r], a[begin][r] + np.log(probability[piece]))
            a.append(terms)
        b = [np.full(n, -np.inf) for _ in a]
        b[-1] = np.zeros(n)
        for i in range(len(lattice), 0, -1):
            for begin, r, piece in lattice[i - 1]:
                p = np.log(probability[piece])
                b[begin][r] = np.logaddexp(b[begin][r], b[i][r] + p)
                counts += np.bincount(piece, np.exp(a[begin][r] + p + b[i][r] - a[-1][r]) * weight[rows[r]], len(counts))
    return counts


def by_length(words: list[str]):
    """(row numbers, code points with the word mark in front) of the words of each length, a bounded number at a time."""
    sizes = np.array([len(w) for w in words], np.int64)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        step = max(1, (1 << 20) // (int(size) + 1))
        for i in range(0, len(rows), step):
            part = rows[i : i + step]
            flat = np.frombuffer("".join("▁" + words[j] for j in part).encode("utf-32-le", "surrogatepass"), np.uint32)
            yield part, flat.reshape(len(part), int(size) + 1).astype(np.uint64)


def words_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes in lower case; hash, start and end of each distinct word; the number of each word's distinct one; each text's first word."""
    lower = classes(buf, LOWER)
    starts, ends, words = boundaries(lower, offsets, ALPHA)
    h = hashes(lower, starts, ends)
    at, inverse = first_use(h)
    return lower, h[at], starts[at], ends[at], inverse, words


def spelled(lower: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    raw = lower.tobytes()
    return [raw[s:e].decode("utf-8").lower() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]


def parts(runs: list[str]) -> tuple[list[str], np.ndarray]:
    """The words of runs of letters and bytes outside ASCII, and the number of each word's run: those bytes may be marks that part words."""
    found = [[r] if len(r) <= LONGEST and r.isalpha() else LETTERS.findall(r) for r in runs]
    return [w for f in found for w in f], np.repeat(np.arange(len(runs)), [len(f) for f in found])


class Scored:
    """The words scored so far, by hash: log-probabilities, and whether there is a letter. Emptied when there are too many."""

    def __init__(self, pieces: Pieces, probability: np.ndarray, most: int = 1_000_000):
        self.pieces, self.probability, self.most = pieces, probability, most
        self.forget()

    def forget(self) -> None:
        self.hash, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.logs, self.lettered = np.zeros((0, self.probability.shape[1])), np.zeros(0, bool)

    def __call__(self, lower: np.ndarray, h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.hash) > self.most:
            self.forget()
        at = np.minimum(np.searchsorted(self.hash, h), max(0, len(self.hash) - 1))
        new = self.hash[at] != h if len(self.hash) else np.ones(len(h), bool)
        if new.any():
            runs = spelled(lower, starts[new], ends[new])
            words, run = parts(runs)
            each = log_probability(self.pieces, words, self.probability)
            logs = np.stack([np.bincount(run, each[:, k], len(runs)) for k in range(each.shape[1])], axis=1)
            self.slot = np.concatenate([self.slot, np.arange(len(runs), dtype=np.int32) + len(self.logs)])
            self.logs = np.concatenate([self.logs, logs])
            self.lettered = np.concatenate([self.lettered, np.bincount(run, minlength=len(runs)) > 0])
            every = np.concatenate([self.hash, h[new]])
            order = np.argsort(every)
            self.hash, self.slot = every[order], self.slot[order]
            at = np.searchsorted(self.hash, h)
        slot = self.slot[at]
        return self.logs[slot], self.lettered[slot]


class Model:
    def __init__(self, languages: list[str], pieces: Pieces, probability: np.ndarray):
        self.languages, self.pieces, self.probability = languages, pieces, probability

    def scored(self) -> Scored:
        return Scored(self.pieces, self.probability)

    def scores(self, column: pa.Array, scored: Scored) -> tuple[list[str], list[float]]:
        """The language and the score of each text."""
        names, scores = [], []
        for _, buf, offsets in slices(column, SLICE):
            lower, h, starts, ends, inverse, first = words_of(buf, offsets)
            logs, lettered = scored(lower, h, starts, ends)
            n = len(offsets) - 1
            total = np.zeros((n, len(self.languages)))
            row = np.repeat(np.arange(n), np.diff(first))
            for k in range(len(self.languages)):
                total[:, k] = np.bincount(row, logs[:, k][inverse], n)
            good = np.bincount(row, lettered[inverse], n) > 0
            best = total.argmax(axis=1)
            share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            names += [self.languages[b] if g else "und" for b, g in zip(best, good, strict=True)]
            scores += np.where(good, share, 0.0).tolist()
        return names, scores


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", texts: int = SAMPLE_TEXTS, rounds: int = ROUNDS) -> Model | None:
    """A model from about `texts` texts of each language (those with the smallest hashes of their keys); None if there are none."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return None
    languages = sorted(counts)
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, texts / counts[k]))])
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(11), key), 11) / F.lit(float(1 << 53))
    text_batches(labelled.sparkSession)
    sample = checkpointed(rows.where(chance < F.try_element_at(share, F.col(lang))).select(F.col(text).alias("text"), F.col(lang).alias("lang")))
    pieces = Pieces(vocabulary())
    probability = np.full((len(pieces.pieces) + 1, len(languages)), 1 / len(pieces.pieces))
    probability[-1] = UNKNOWN
    for _ in range(rounds):
        sent = labelled.sparkSession.sparkContext.broadcast((languages, vars(pieces), probability))

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            languages, state, p = sent.value
            own = restored(Pieces, state)
            sums = np.zeros(p.shape)
            for batch in batches:
                lang = np.array(column_of(batch, "lang").to_pylist(), object)
                for k, name in enumerate(languages):
                    chosen = column_of(batch, "text").filter(pa.array(lang == name))
                    for _, buf, offsets in slices(chosen, SLICE):
                        lower, _, starts, ends, inverse, _ = words_of(buf, offsets)
                        words, run = parts(spelled(lower, starts, ends))
                        sums[:, k] += expected(own, words, np.bincount(inverse, minlength=len(starts)).astype(float)[run], p[:, k])
            piece, k = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int64()), pa.array(k, pa.int64()), pa.array(sums[piece, k])], ["piece", "k", "n"])

        sums = np.zeros(probability.shape)
        for r in sample.mapInArrow(count, "piece long, k long, n double").groupBy("piece", "k").agg(F.sum("n").alias("n")).toLocalIterator():
            sums[r.piece, r.k] = r.n
        known = sums[:-1] + 0.05
        probability[:-1] = known / known.sum(axis=0)
    return Model(languages, pieces, probability)


def identified(docs: DataFrame, model: Model | None, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Columns of docs (`keep`, or all) with lang_pred and score. Columns of docs of these names are replaced."""
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score", "_text")]
    if model is None:
        return docs.select(*kept, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    text_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, vars(model.pieces), model.probability))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, state, probability = sent.value
        own = Model(languages, restored(Pieces, state), probability)
        scored = own.scored()
        for batch in batches:
            names, scores = own.scores(column_of(batch, "_text"), scored)
            yield pa.RecordBatch.from_arrays([*(column_of(batch, c) for c in kept), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*kept, "lang_pred", "score"])

    schema = T.StructType([docs.schema[c] for c in kept]).add("lang_pred", "string").add("score", "double")
    return docs.select(*kept, F.col(text).alias("_text")).mapInArrow(run, schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    model = train(docs.where(~F.col("held_out")))
    return identified(docs, model, ["doc_id", "held_out"])
