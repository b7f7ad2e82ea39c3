"""Packing token pieces into sequences by shortest-pack-first over the histogram of lengths.

Documents become ids of a public tokenizer plus an end id, and are cut at every `size` ids; what is left over is the
last piece. Only the histogram of piece lengths (at most `size` numbers) comes to the driver. Lengths are placed
longest first, each in the open patterns with the most room, and patterns carry counts, so the plan's cost does not
depend on the number of documents. Pieces get a rank within their length - a row number within (length, salt) plus the
counts of the salts before it - and the rank names the pattern's copy: the sequence and the offset there. A length has as
many salts as it has shares of SHARE pieces, or of one in MOST_SHARES of all pieces if that is more, so neither a task's
part nor what the driver counts grows out of bounds.

Each distinct chunk between white space is tokenised once per batch. Chunks of ASCII and U+00C0-U+00FF without
apostrophes take a byte-pair encoder that has the same merges (a zero byte marks the end of a word);
all others the tokenizer itself.

Defined results: a null text is empty and gives the end id alone; repeated rows are documents of their own; an empty
table gives no pieces.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.bytewords import NONSPACE, boundaries, by_value, classes, column_of, first_use, hashes, ragged, slices
from corpusloom.llm.common import checkpointed, table, text_batches

by_value(__name__)

SIZE, END_ID = 4096, 2
#: Pieces of one length that are ranked in one task, and most such shares in all (besides one a length).
SHARE, MOST_SHARES = 256, 1 << 18
SLICE = 6 << 20
#: Chunks with one of these go to the tokenizer itself.
SPECIAL = re.compile(r"[^\n!-~\u00c0-\u00ff]|'|<\|")
#: Of bytes in lower case: 0 newline, 1 letter, 2 digit, 3 any other.
KIND = np.array([0 if b == 10 else 1 if 97 <= b <= 122 or b >= 128 else 2 if 48 <= b <= 57 else 3 for b in range(256)], np.uint8)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself, or from U+0100 on in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordTokenizer:
    """Ids of chunks without white space, as the tokenizer in `path` gives them without special tokens."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        of = byte_characters()
        raw = lambda token: bytes(of[c] for c in token.removesuffix("</w>")) + b"\0" * token.endswith("</w>")
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        ordered = [*(c for c in of), *(f"{c}</w>" for c in of), *merged]
        ranks: dict[bytes, int] = {}
        for token in ordered:
            ranks.setdefault(raw(token), len(ranks))
        ids = {raw(t): i for t, i in model["vocab"].items()}
        self.id_of = np.array([ids.get(b, -1) for b in ranks], np.int64)
        self.ends = np.array([len(b) > 1 and b.endswith(b"\0") for b in ranks])
        self.newline = ranks[b"\n"]
        self.small = np.uint16 if self.id_of.max() < 1 << 16 and self.exact.get_vocab_size() < 1 << 16 else np.uint32
        self.fast = tiktoken.Encoding("words", pat_str="[^\\x00\\n]+\\x00|\\n", mergeable_ranks=ranks, special_tokens={})

    def __call__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, chunk after chunk, and their number in each chunk."""
        sizes = ends - starts + 1
        joined = np.full(int(sizes.sum()), 10, np.uint8)
        begins = np.cumsum(sizes) - sizes
        joined[ragged(begins, sizes - 1)] = buf[ragged(starts, sizes - 1)]
        text = joined.tobytes().decode("utf-8")
        if not SPECIAL.search(text):
            return self.plain(joined)
        chunks = text.split("\n")[:-1]
        odd = np.array([bool(SPECIAL.search(c)) for c in chunks])
        ids, counts = self.plain(joined[~np.repeat(odd, sizes)])
        more = [e.ids for e in self.exact.encode_batch([c for c, o in zip(chunks, odd, strict=True) if o], add_special_tokens=False)]
        all_counts = np.empty(len(chunks), np.int64)
        all_counts[~odd], all_counts[odd] = counts, [len(x) for x in more]
        at = np.cumsum(all_counts) - all_counts
        out = np.empty(int(all_counts.sum()), np.int64)
        out[ragged(at[~odd], counts)] = ids
        out[ragged(at[odd], all_counts[odd])] = np.fromiter((i for x in more for i in x), np.int64)
        return out, all_counts

    def plain(self, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for chunks that are each ended by a newline and hold nothing SPECIAL: pieces are runs of letters, single digits, runs of others."""
        lower = np.frombuffer(joined.tobytes().decode("utf-8").lower().encode("utf-8"), np.uint8)
        kind = classes(lower, KIND).copy()
        sign = np.flatnonzero((lower[1:] == 0x97) | (lower[1:] == 0xB7)) + 1  # U+00D7 and U+00F7 are no letters
        kind[sign], kind[sign - 1] = 3, 3
        last = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[:-1] > 0) | (kind[:-1] == 2))
        marked = np.zeros(len(lower) + len(last), np.uint8)
        marked[np.arange(len(lower)) + np.searchsorted(last, np.arange(len(lower)), "left")] = lower
        got = np.asarray(self.fast.encode_to_numpy(marked.tobytes().decode("utf-8"), disallowed_special=()), np.int64)
        stop = got == self.newline
        ids = self.id_of[got[~stop]]
        if len(ids) and ids.min() < 0:
            raise ValueError("the vocabulary lacks a merged token")
        return ids, np.diff(np.flatnonzero(stop), prepend=-1) - 1


class Known:
    """Ids of the chunks met so far, by hash; emptied when there are too many."""

    def __init__(self, tokenize: WordTokenizer, most: int = 1_500_000):
        self.tokenize, self.most = tokenize, most
        self.forget()

    def forget(self) -> None:
        self.hash, self.begin, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint16)

    def __call__(self, h: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in self.ids each chunk's ids begin, and how many they are."""
        if len(self.hash) > self.most:
            self.forget()
        at = np.minimum(np.searchsorted(self.hash, h), max(0, len(self.hash) - 1))
        new = self.hash[at] != h if len(self.hash) else np.ones(len(h), bool)
        if new.any():
            ids, sizes = self.tokenize(buf, starts[new], ends[new])
            begins = np.cumsum(sizes) - sizes + len(self.ids)
            order = np.argsort(every := np.concatenate([self.hash, h[new]]))
            self.hash = every[order]
            self.begin = np.concatenate([self.begin, begins]).astype(np.int32)[order]
            self.size = np.concatenate([self.size, sizes]).astype(np.int32)[order]
            self.ids = np.concatenate([self.ids, ids.astype(self.tokenize.small)])
            at = np.searchsorted(self.hash, h)
        return self.begin[at], self.size[at]


def token_slices(texts: pa.Array, known: Known):
    """(first row, ids, offsets by row) for runs of rows; each row ends with END_ID."""
    for first, buf, offsets in slices(texts, SLICE):
        starts, ends, words = boundaries(buf, offsets, NONSPACE)
        h = hashes(buf, starts, ends)
        at, inverse = first_use(h)
        begins, sizes = known(h[at], buf, starts[at], ends[at])
        per_word = sizes[inverse]
        total = np.concatenate([[0], np.cumsum(per_word, dtype=np.int64)])[words]
        rows = np.arange(len(offsets))
        out = known.ids[ragged(begins[inverse], per_word)].astype(np.uint32)
        yield first, np.insert(out, total[1:], END_ID), total + rows


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and, if asked for, ids: every document's ids cut at each `size`."""
    path = path or tokenizer_path()
    text_batches(docs.sparkSession)
    kind = docs.schema[key].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for batch in batches:
            known = known or Known(WordTokenizer(path))
            keys = column_of(batch, "doc_id")
            for first, ids, offsets in token_slices(column_of(batch, "text"), known):
                sizes = np.diff(offsets)
                n = -(-sizes // size)
                row = np.repeat(np.arange(len(sizes)), n)
                start = ragged(np.zeros(len(n), np.int64), n).astype(np.int64) * size
                length = np.minimum(size, sizes[row] - start)
                data, begin = memoryview(ids.astype("<u4")).cast("B"), offsets[row] + start
                crc = [zlib.crc32(data[4 * b : 4 * (b + m)]) for b, m in zip(begin.tolist(), length.tolist(), strict=True)]
                columns = [keys.take(pa.array(first + row)), *(pa.array(v, pa.int64()) for v in (start, length, crc, sizes[row]))]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(begin, ids.size), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(columns)])

    chosen = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return chosen.mapInArrow(cut, f"doc_id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids)


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns (count, lengths): every piece of the histogram in one place, no pattern over `size`.

    Lengths go longest first. A length takes the open patterns with the most room (the shortest packs) that holds it,
    as many of them as it has pieces; a pattern of which only a part is taken splits in two."""
    room: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        left, free = histogram[length], size
        while left:
            while free >= length and not room[free]:
                free -= 1
            if free < length:
                room[size - length].append((left, (length,)))
                break
            count, pattern = room[free].pop()
            used = min(count, left)
            if count > used:
                room[free].append((count - used, pattern))
            room[free - length].append((used, (*pattern, length)))
            left -= used
    return [p for free in sorted(room) for p in room[free]]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: the pieces of that length from that rank on go there, one a sequence."""
    taken: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for count, pattern in patterns:
        at = 0
        for length in pattern:
            rows.append((length, taken[length], sequence, at))
            taken[length] += count
            at += length
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def packed(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """Pieces with sequence_id and offset. `cut` is used several times: give a written table."""
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most `size` numbers
    share = max(SHARE, -(-sum(histogram.values()) // MOST_SHARES))
    salts = np.ones(size + 2, np.int64)
    for length, n in histogram.items():
        salts[length] = -(-n // share)
    first = np.cumsum(salts) - salts
    many = cut.sparkSession.createDataFrame(pd.DataFrame({"length": np.arange(size + 1), "_salts": salts[:-1]}))
    salted = cut.join(F.broadcast(many), "length").withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.spark_partition_id()), F.col("_salts")).cast("int")).drop("_salts")
    counts = salted.groupBy("length", "_salt").count().collect()  # at most size + MOST_SHARES numbers
    base, before = np.zeros(int(first[-1]) + 1, np.int64), defaultdict(int)
    for length, s, n in sorted(tuple(r) for r in counts):
        base[first[length] + s] = before[length]
        before[length] += n
    places = slots(plan(histogram, size))
    starts = places[:, 0] << 44 | places[:, 1]
    sent = cut.sparkSession.sparkContext.broadcast((first, base, places, starts))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, s: pd.Series, n: pd.Series) -> pd.DataFrame:
        first, base, places, starts = sent.value
        length = length.to_numpy()
        rank = base[first[length] + s.to_numpy()] + n.to_numpy() - 1
        slot = places[np.searchsorted(starts, length << 44 | rank, "right") - 1] if len(length) else np.zeros((0, 4), np.int64)
        return pd.DataFrame({"sequence_id": slot[:, 2] + rank - slot[:, 1], "offset": slot[:, 3]})

    by = Window.partitionBy("length", "_salt").orderBy("doc_id", "start", "ids_crc32")
    placed = salted.withColumn("_n", F.row_number().over(by)).withColumn("_at", place("length", "_salt", "_n"))
    return placed.select(*cut.columns, "_at.sequence_id", "_at.offset")


def sequences(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, size: int = SIZE, pad_id: int = 0) -> DataFrame:
    """sequence_id, n_tokens, input_ids (padded to `size`, except at a power of two) and the piece lengths in order."""
    done = packed(checkpointed(pieces(docs, key, text, path, size, with_ids=True)), size)
    rows = done.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    ids = F.flatten(F.transform("p", lambda x: x["ids"]))
    full = F.bit_count(F.size(ids)) == 1
    padded = F.when(full, ids).otherwise(F.concat(ids, F.array_repeat(F.lit(pad_id), F.lit(size) - F.size(ids))))
    return rows.select("sequence_id", F.size(ids).alias("n_tokens"), padded.alias("input_ids"), F.transform("p", lambda x: F.size(x["ids"])).alias("lengths"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(checkpointed(pieces(table(spark, sf_dir, "documents"))))
