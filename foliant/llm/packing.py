"""Packing by shortest-pack-first over the histogram of lengths."""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from tokenizers import Tokenizer

from foliant.llm.common import id_field, map_texts, stage, texts_of, worker_table

#: UTF-8 bytes of text that a worker turns into words at a time.
SLICE_BYTES = 1 << 20
#: Words in the newer half of a worker's table (some 40 MB); a full one takes the place of the older half.
TABLE_ENTRIES = 1_000_000
#: Longer words (bytes) are encoded where they stand and not kept.
LONG_WORD = 96
#: Words that are encoded as one text, and what stands between them there: a character with an id of its own.
WORDS_AT_ONCE, MARK = 1_000, "|"
#: Pieces of one length that one task puts in order.
BUCKET_ROWS = 200_000


_LETTER_RUNS, _AFTER_LETTER = json.dumps(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")[1:-1], re.compile(r"(?<=[A-Za-z])(?=[.,;:!?])")


class _Entries:
    """Words and their ids in two byte strings, found by sorted hashes: some 40 bytes a word.

    Hashes are sorted in runs; a new run is merged with those before it that are no longer than twice its length.
    """

    def __init__(self) -> None:
        self.words, self.ids = bytearray(), bytearray()
        self.word_ends, self.id_ends = array("I", [0]), array("I", [0])
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []

    def __len__(self) -> int:
        return len(self.word_ends) - 1

    def find(self, words: list[bytes], hashes: np.ndarray, found: dict[bytes, bytes]) -> None:
        """Adds the words that are here to ``found``; equal hashes are told apart by the words."""
        place = np.full(len(words), -1, np.int64)
        for keys, at in self.runs:
            near = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            place = np.where(keys[near] == hashes, at[near], place)
        at, word_ends, id_ends = np.flatnonzero(place >= 0), np.frombuffer(self.word_ends, np.uint32), np.frombuffer(self.id_ends, np.uint32)
        k = place[at]
        bounds = [x.tolist() for x in (at, word_ends[k], word_ends[k + 1], id_ends[k], id_ends[k + 1])]
        with memoryview(self.words) as text, memoryview(self.ids) as ids:
            for i, a, b, c, d in zip(*bounds, strict=True):
                if text[a:b] == words[i]:
                    found[words[i]] = ids[c:d].tobytes()

    def add(self, words: list[bytes], hashes: np.ndarray, ids: list[bytes]) -> None:
        first = len(self)
        self.word_ends.frombytes((np.cumsum([len(x) for x in words]) + len(self.words)).astype(np.uint32).tobytes())
        self.id_ends.frombytes((np.cumsum([len(x) for x in ids]) + len(self.ids)).astype(np.uint32).tobytes())
        self.words += b"".join(words)
        self.ids += b"".join(ids)
        keys, at = hashes, np.arange(first, first + len(words), dtype=np.uint32)
        while self.runs and len(self.runs[-1][0]) <= 2 * len(keys):
            before = self.runs.pop()
            keys, at = np.concatenate([before[0], keys]), np.concatenate([before[1], at])
        order = np.argsort(keys, kind="stable")
        self.runs.append((keys[order], at[order]))


class WordTable:
    """Ids of words as little-endian bytes.

    The tokenizer drops white space and no rule of it looks across ASCII white space, so a text's ids
    are those of its words in order.  Words are encoded once while the table knows them: those met
    lately stay, and the others go, so a worker's memory doesn't grow with the corpus.
    """

    def __init__(self, tokenizer_file: str, entries: int = TABLE_ENTRIES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer, self.entries = Tokenizer.from_file(tokenizer_file), entries
        self.newer, self.older = _Entries(), _Entries()
        self.parts_letters = _LETTER_RUNS in self.tokenizer.to_str()
        mark = self._ids(MARK)
        self.mark = mark[0] if len(mark) == 1 else None

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _encoded(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word; many words are encoded as one text, cut at the mark between them."""
        if self.mark is not None:
            ids = np.array(self._ids(f" {MARK} ".join([w.decode() for w in words])), "<u4")
            cuts = 4 * np.flatnonzero(ids == self.mark)
            if len(cuts) == len(words) - 1:
                data = ids.tobytes()
                return [data[a:b] for a, b in zip([0, *(cuts + 4).tolist()], [*cuts.tolist(), len(data)], strict=True)]
        # a word that holds the mark itself, whatever form of it
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

    def words_of(self, text: str) -> list[bytes]:
        """Words in order, whose ids one after another are the text's.

        Where the tokenizer takes runs of letters apart from what follows and lower-cases, a mark after an ASCII letter is
        a word of its own and A-Z are a-z, which leaves fewer words to encode.  Only texts of ASCII without special tokens
        are lower-cased: composed letters and special tokens depend on case.
        """
        if self.parts_letters:
            text = _AFTER_LETTER.sub(" ", text.lower() if text.isascii() and "<|" not in text else text)
        return text.encode("utf-8").split()

    def ids_of(self, words: set[bytes]) -> dict[bytes, bytes]:
        """The ids of these words."""
        if len(self.newer) > self.entries:
            self.newer, self.older = _Entries(), self.newer
        asked, found = list(words), {}
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, asked), np.uint64, len(asked))
        self.newer.find(asked, hashes, found)
        again: dict[bytes, bytes] = {}
        if len(self.older) and len(found) < len(asked):
            left = [i for i, w in enumerate(asked) if w not in found]
            self.older.find([asked[i] for i in left], hashes[left], again)
        new = [i for i, w in enumerate(asked) if w not in found]
        missing = [asked[i] for i in new if asked[i] not in again]
        for start in range(0, len(missing), WORDS_AT_ONCE):
            part = missing[start:start + WORDS_AT_ONCE]
            again.update(zip(part, self._encoded(part), strict=True))
        found |= again
        kept = [i for i in new if len(asked[i]) <= LONG_WORD]
        if kept:
            self.newer.add([asked[i] for i in kept], hashes[kept], [again[asked[i]] for i in kept])
        return found


def cut_pieces(docs: DataFrame, tokenizer_file: str, capacity: int, end_id: int) -> DataFrame:
    """Ids of each whole text and ``end_id``, cut into pieces of ``capacity`` ids and a rest."""
    schema = T.StructType([id_field(docs), *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens")]])
    last, name = end_id.to_bytes(4, "little"), f"words of {tokenizer_file}"

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = worker_table(name, lambda: WordTable(tokenizer_file))
        split = [words.words_of(t) for t in texts_of(batch)]
        table = words.ids_of(set().union(*split))
        rows, starts, lengths, sums, totals = [], [], [], [], []
        for i, parts in enumerate(split):
            ids = b"".join(map(table.__getitem__, parts)) + last
            for start in range(0, len(ids), 4 * capacity):
                part = ids[start:start + 4 * capacity]
                rows.append(i)
                starts.append(start // 4)
                lengths.append(len(part) // 4)
                sums.append(zlib.crc32(part))
                totals.append(len(ids) // 4)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(v, pa.int64()) for v in (starts, lengths, sums, totals)]],
                                          schema.names)

    return map_texts(docs.select("doc_id", "text"), work, schema, SLICE_BYTES, name)


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many packs follow each, from the number of pieces of each length.

    Lengths are placed longest first, each into the emptiest pack that has room, else into a new one.
    Packs with the same fill are handled together, so the work depends on the number of lengths and not
    on the number of pieces.
    """
    packs: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    fills: list[int] = []

    def put(pattern: tuple[int, ...], packs_of_it: int) -> None:
        fill = sum(pattern)
        if fill not in packs:
            packs[fill] = []
            insort(fills, fill)
        packs[fill].append((pattern, packs_of_it))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if fills and fills[0] + length <= capacity:
                fill = fills[0]
                pattern, n = packs[fill].pop()
                if not packs[fill]:
                    del packs[fill]
                    del fills[bisect_left(fills, fill)]
                used = min(n, left)
                put((*pattern, length), used)
                if n > used:
                    put(pattern, n - used)
                left -= used
            else:
                full, rest = divmod(left, each := capacity // length)
                if full:
                    put((length,) * each, full)
                if rest:
                    put((length,) * rest, 1)
                left = 0
    return [x for fill in fills for x in packs[fill]]


def pattern_rows(spark: SparkSession, patterns: list[tuple[tuple[int, ...], int]]) -> DataFrame:
    """One row for each pattern and length in it: the ranks of the pieces it takes, and where they go."""
    rows, taken, sequence = [], {}, 0
    for pattern, packs in patterns:
        offset = 0
        for length in sorted(set(pattern), reverse=True):
            times = pattern.count(length)
            first = taken.get(length, 0)
            rows.append((length, first, first + times * packs, sequence, times, offset))
            taken[length] = first + times * packs
            offset += times * length
        sequence += packs
    return spark.createDataFrame(rows, "length long, rank_from long, rank_to long, first_sequence long, times long, first_offset long")


def pack_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """Give each piece (doc_id, start, length, ids_crc32, doc_tokens) its sequence and offset.

    Only the histogram, at most ``capacity`` numbers, reaches the driver.  Pieces of one length are
    ranked in two levels, hash buckets and then rows in a bucket, so that a length that most pieces
    have is dealt to many tasks.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    buckets = max([1, *(-(-n // BUCKET_ROWS) for n in histogram.values())])
    patterns = pattern_rows(spark, shortest_pack_first(histogram, capacity))
    marked = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = marked.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = marked.withColumn("_in", F.row_number().over(inside) - 1).join(sizes, ["length", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_in") + F.col("_before"))
    ranges = patterns.groupBy("length").agg(F.collect_list(F.struct(*[c for c in patterns.columns if c != "length"])).alias("_ranges"))
    taken = F.expr("filter(_ranges, x -> _rank >= x.rank_from and _rank < x.rank_to)[0]")  # one row a piece, not one for each pattern of its length
    placed = ranked.join(ranges, "length").withColumn("_taken", taken).select("*", "_taken.*")
    place = F.col("_rank") - F.col("rank_from")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                         (F.col("first_sequence") + (place / F.col("times")).cast("long")).alias("sequence_id"),
                         (F.col("first_offset") + place % F.col("times") * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """Pack the ids of all whole texts into sequences of at most ``capacity`` ids.

    Each document is its ids and ``end_id``; documents longer than a sequence are cut into full
    sequences and a rest.  A null or empty text is ``end_id`` alone; repeated rows are packed one by
    one; an empty table gives no rows; a null id is carried along; columns other than doc_id and text
    are not read.
    """
    return pack_pieces(stage(cut_pieces(docs, tokenizer_file, capacity, end_id)), capacity)
