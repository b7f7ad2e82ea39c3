"""Benchmark decontamination with one FM-index per training shard.

A shard is a run of documents of a few MB. Its words become numbers of the benchmark's vocabulary; words outside it,
and the ends of documents, are separators that no window crosses, and stretches too short for any window are left
out. The shard's suffixes are sorted by prefix doubling, its Burrows-Wheeler transform goes into a wavelet matrix, and
all windows are searched backwards together by its ranks. Occurrences are located by walking to sampled suffix
positions; their spans are merged. Words are compared by two 64-bit hashes.

A window is `width` consecutive words of an item; an item of fewer words, but not none, is one window. The benchmark is
a test set; it is sent to the tasks in packets of about PACKET bytes, all of which each shard is searched for, so a large one
costs time and no answer.

Defined results: null and wordless texts have no words, null items no windows; items that share an id count once;
repeated documents are scanned each. An empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.bytewords import ALNUM, LOWER, boundaries, by_value, classes, column_of, hashes, ragged, restored, slices
from corpusloom.llm.common import table, text_batches

by_value(__name__)

WIDTH, LEAST_ITEMS = 8, 2
SLICE = 6 << 20
SAMPLE = 16
PACKET = 64 << 20


class FMIndex:
    """Of an array of symbols; 0 separates, is last, and differs from every other 0."""

    def __init__(self, text: np.ndarray, symbols: int, sample: int = SAMPLE):
        self.n, self.symbols = len(text), symbols
        order = suffix_order(text, symbols)
        self.bwt = text[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        self.levels = []
        row = self.bwt
        for level in reversed(range(symbols.bit_length())):
            bit = row >> level & 1
            zeros = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit == 0, out=zeros[1:])
            self.levels.append((level, zeros, int(zeros[-1])))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        self.sampled = (order % sample == 0) | (self.bwt == 0)  # no walk crosses a separator
        self.before = np.concatenate([[0], np.cumsum(self.sampled)])
        self.positions = order[self.sampled]

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol c stands among the first i of the transform."""
        low = np.zeros_like(i)
        for level, zeros, total in self.levels:
            one = (c >> level & 1).astype(bool)
            zi, zl = zeros[i], zeros[low]
            i, low = np.where(one, total + i - zi, zi), np.where(one, total + low - zl, zl)
        return i - low

    def search(self, patterns: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of rows of each pattern; a pattern's symbols stand at the right end of its row of `patterns`."""
        width = patterns.shape[1] if patterns.ndim == 2 else 0
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.flatnonzero(sizes > 0)
        for j in range(1, width + 1):
            live = live[(sizes[live] >= j) & (lo[live] < hi[live])]
            if not len(live):
                break
            c = patterns[live, width - j]
            ranks = self.rank(np.concatenate([c, c]), np.concatenate([lo[live], hi[live]]))
            lo[live], hi[live] = self.first[c] + ranks[: len(c)], self.first[c] + ranks[len(c) :]
        return lo, np.where(sizes > 0, hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text positions of rows."""
        out, steps, at, todo = np.empty(len(rows), np.int64), 0, rows.astype(np.int64), np.arange(len(rows))
        while len(todo):
            here = self.sampled[at]
            out[todo[here]] = self.positions[self.before[at[here]]] + steps
            todo, at = todo[~here], at[~here]
            c = self.bwt[at]
            at, steps = self.first[c] + self.rank(c, at), steps + 1
        return out


def suffix_order(text: np.ndarray, symbols: int) -> np.ndarray:
    """The suffix array by prefix doubling; after the first sort only suffixes that are still tied are sorted again."""
    n = len(text)
    apart = text == 0
    count = int(apart.sum())
    key = text.astype(np.int64) + count
    key[apart] = np.arange(count)
    pair = key * (count + symbols + 1)
    pair[:-1] += key[1:]
    order = np.argsort(pair)
    ordered = pair[order]
    head = np.ones(n, bool)
    np.not_equal(ordered[1:], ordered[:-1], out=head[1:])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    tied = np.flatnonzero(~(head & np.append(head[1:], True)))
    step = 2
    while len(tied):
        suffixes = order[tied]
        keys = rank[suffixes] * n + rank[suffixes + step]
        by = np.argsort(keys)
        suffixes, keys = suffixes[by], keys[by]
        order[tied] = suffixes
        head = np.ones(len(tied), bool)
        np.not_equal(keys[1:], keys[:-1], out=head[1:])
        rank[suffixes] = tied[np.maximum.accumulate(np.where(head, np.arange(len(tied)), 0))]
        tied = tied[~(head & np.append(head[1:], True))]
        step *= 2
    return order


class Windows:
    """The distinct windows of a benchmark as rows of vocabulary numbers, and the items of each."""

    def __init__(self, ids: list, texts: list[str | None], width: int = WIDTH):
        self.ids = sorted(set(ids), key=lambda i: (i is None, str(i)))
        number = {v: i for i, v in enumerate(self.ids)}
        buf, starts, ends, words, item = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64), 0
        for first, raw, offsets in slices(pa.array(texts, pa.large_string()), 1 << 62):
            assert not first
            buf = classes(raw, LOWER)
            starts, ends, words = boundaries(buf, offsets, ALNUM)
        h = hashes(buf, starts, ends)
        self.vocabulary, one, code = np.unique(h, return_index=True, return_inverse=True)
        self.check = hashes(buf, starts[one], ends[one], 1)
        sizes = np.diff(words)
        found: dict[tuple, set] = {}
        for item, (w, n) in enumerate(zip(words[:-1], sizes, strict=True)):
            row = (code[w : w + n] + 1).tolist()
            for j in range(max(1, n - width + 1) if n else 0):
                found.setdefault(tuple(row[j : j + width]), set()).add(number[ids[item]])
        self.width = max([len(w) for w in found], default=0)
        self.least = min([len(w) for w in found], default=0)
        self.patterns = np.array([(0,) * (self.width - len(w)) + w for w in found], np.int32).reshape(len(found), self.width)
        self.sizes = np.array([len(w) for w in found], np.int64)
        self.n_items = np.array([len(v) for v in found.values()], np.int64)
        self.items = np.array([i for v in found.values() for i in sorted(v)], np.int64)
        self.item_at = np.cumsum(self.n_items) - self.n_items


def shard_text(number: np.ndarray, words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The text to index and the word of each of its symbols: stretches of vocabulary words within a document, each ended by a 0."""
    known = number > 0
    begin = known.copy()
    begin[1:] &= ~known[:-1]
    cuts = words[1:-1]
    cuts = cuts[cuts < len(known)]
    begin[cuts] |= known[cuts]
    start = np.flatnonzero(begin)
    last = known.copy()
    last[:-1] &= ~known[1:] | begin[1:]
    size = np.flatnonzero(last) + 1 - start
    start, size = start[size >= least], size[size >= least]
    at = ragged(start, size + 1).astype(np.int64)
    text = np.zeros(len(at), np.int32)
    ends = np.cumsum(size + 1) - 1
    inside = np.ones(len(at), bool)
    inside[ends] = False
    text[inside] = number[at[inside]]
    return text, at


def scan_slice(buf: np.ndarray, offsets: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word starts and ends, first word of each text, hit (by word), and the distinct (text, item) pairs."""
    lower = classes(buf, LOWER)
    starts, ends, words = boundaries(lower, offsets, ALNUM)
    hit, none = np.zeros(len(starts), bool), np.zeros(0, np.int64)
    if not len(windows.vocabulary) or not len(starts):
        return starts, ends, words, hit, none, none
    h = hashes(lower, starts, ends)
    at = np.minimum(np.searchsorted(windows.vocabulary, h), len(windows.vocabulary) - 1)
    number = np.where(windows.vocabulary[at] == h, at + 1, 0).astype(np.int32)
    text, word = shard_text(number, words, windows.least)
    if not len(text):
        return starts, ends, words, hit, none, none
    index = FMIndex(text, len(windows.vocabulary))
    lo, hi = index.search(windows.patterns, windows.sizes)
    window = np.repeat(np.arange(len(lo)), hi - lo)
    place = word[index.locate(ragged(lo, hi - lo).astype(np.int64))]
    span = windows.sizes[window]
    covered = ragged(place, span)
    same = hashes(lower, starts[covered], ends[covered], 1) == windows.check[number[covered] - 1]
    if not same.all():
        good = np.logical_and.reduceat(same, np.cumsum(span) - span)
        window, place, span = window[good], place[good], span[good]
        covered = ragged(place, span)
    hit[covered] = True
    n = windows.n_items[window]
    doc = np.repeat(np.searchsorted(words, place, "right") - 1, n)
    item = windows.items[ragged(windows.item_at[window], n)]
    pairs = np.unique(doc * np.int64(len(windows.ids)) + item)
    return starts, ends, words, hit, pairs // max(1, len(windows.ids)), pairs % max(1, len(windows.ids))


def searched(buf: np.ndarray, offsets: np.ndarray, packets_: list[Windows]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """scan_slice over all packets: a word is hit if any packet hits it; items are told by their ids as text, each once a document."""
    every = [scan_slice(buf, offsets, w) for w in packets_]
    starts, ends, words = every[0][:3]
    pairs = sorted({(d, str(w.ids[i])) for w, (*_, doc, item) in zip(packets_, every, strict=True) for d, i in zip(doc.tolist(), item.tolist(), strict=True)})
    return starts, ends, words, np.logical_or.reduce([e[3] for e in every]), np.array([d for d, _ in pairs], np.int64), np.array([i for _, i in pairs], object)


def packets(benchmark: DataFrame) -> Iterator[tuple[list, list]]:
    """(item ids, texts) of the items, about PACKET bytes at a time; one packet at least."""
    ids, texts, size = [], [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        ids.append(r.item_id)
        texts.append(r.text)
        size += len(r.text or "")
        if size >= PACKET:
            yield ids, texts
            ids, texts, size = [], [], 0
    yield ids, texts


def merged_spans(buf: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray, hit: np.ndarray) -> list[dict[str, int]]:
    """Spans of code points, from the first to the last word of each stretch of hit words."""
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    a, b = starts[np.flatnonzero(edge == 1)] - base, ends[np.flatnonzero(edge == -1) - 1] - base
    points = np.concatenate([[0], np.cumsum(buf & 0xC0 != 0x80)])
    return [{"begin": int(points[x]), "end": int(points[y])} for x, y in zip(a, b, strict=True)]


def scan(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, text: str = "text", width: int = WIDTH, least_items: int = LEAST_ITEMS, spans: bool = False) -> DataFrame:
    """Columns of docs (`keep`, or all) with n_words, n_hit, n_items, items_sha256, contaminated and, if asked for, spans.

    Columns of docs of these names are replaced."""
    own = [("n_words", "long"), ("n_hit", "long"), ("n_items", "long"), ("items_sha256", "string"), ("contaminated", "boolean")] + [("spans", T.ArrayType(T.StructType().add("begin", "integer").add("end", "integer")))] * spans
    kept = [c for c in (docs.columns if keep is None else keep) if c not in dict(own) and c != "_text"]
    text_batches(docs.sparkSession)
    sent = [docs.sparkSession.sparkContext.broadcast(vars(Windows(*p, width))) for p in packets(benchmark)]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = [restored(Windows, s.value) for s in sent]
        for batch in batches:
            for first, buf, offsets in slices(column_of(batch, "_text"), SLICE):
                starts, ends, words, hit, doc, item = searched(buf, offsets, windows)
                hits = np.diff(np.concatenate([[0], np.cumsum(hit)])[words])
                n_items = np.bincount(doc, minlength=len(hits))
                digest, cuts = [hashlib.sha256(b"").hexdigest()] * len(hits), [[] for _ in hits] if spans else []
                found = np.cumsum(n_items)
                for i in np.flatnonzero(n_items):
                    ids = item[found[i] - n_items[i] : found[i]]
                    digest[i] = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
                    if spans:
                        w = slice(words[i], words[i + 1])
                        cuts[i] = merged_spans(buf[offsets[i] : offsets[i + 1]], offsets[i], starts[w], ends[w], hit[w])
                values = [np.diff(words), hits, n_items, digest, n_items >= least_items] + [cuts] * spans
                part = batch.slice(first, len(hits))
                made = [pa.array(v, k) for v, k in zip(values, kinds[: len(values)], strict=True)]
                yield pa.RecordBatch.from_arrays([*(column_of(part, c) for c in kept), *made], [*kept, *dict(own)])

    schema = T.StructType([docs.schema[c] for c in kept])
    for name, kind in own:
        schema = schema.add(name, kind)
    return docs.select(*kept, F.col(text).alias("_text")).mapInArrow(run, schema)


def cut(text: str = "text", spans: str = "spans"):
    """The text without its spans."""
    pieces = F.expr(
        f"transform(sequence(0, size({spans})), i -> substring({text}, 1 + if(i = 0, 0, {spans}[i - 1].end),"
        f" if(i = size({spans}), length({text}), {spans}[i].begin) - if(i = 0, 0, {spans}[i - 1].end)))"
    )
    return F.when(F.size(spans) > 0, F.array_join(pieces, "")).otherwise(F.col(text))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
