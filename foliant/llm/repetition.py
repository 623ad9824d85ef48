"""Quality rules on repetition: a suffix array per text, longest-common-prefix intervals, covered fraction."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from foliant.llm.common import filter_texts, id_field, map_texts, texts_of

WHITE = " \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
#: UTF-8 bytes of text under one suffix array; a longer text has one of its own.
SLICE_BYTES = 1 << 20


class _Numbers(dict):
    """Numbers words in order of appearance."""

    def __init__(self) -> None:
        super().__init__()
        self._next = count()

    def __missing__(self, word: bytes) -> int:
        value = self[word] = next(self._next)
        return value


def longest_repeats(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each word position, the longest run of words starting there that also starts elsewhere in its text.

    ``words`` holds the word numbers of several texts behind one another, ``ends`` the position where
    the text of each word ends.  One suffix array over all texts is built by prefix doubling with the
    text as leading key, sorting again only the suffixes that still share a rank.  The common prefix
    of neighbours in the array comes from the ranks of all doubling steps; the larger of the two
    neighbours' values is the depth of the deepest interval of common prefixes that holds the suffix.
    """
    n = len(words)
    if n < 2:
        return np.zeros(n, np.int64)
    key = ends * (int(words.max()) + 1) + words
    order = np.argsort(key, kind="stable")
    fresh = np.r_[True, key[order][1:] != key[order][:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    levels, h = [(1, rank)], 1
    active = order[~(fresh & np.r_[fresh[1:], True])]
    while len(active):
        after = active + h
        inside = after < ends[active]
        second = np.where(inside, rank[np.minimum(after, n - 1)], -1)
        first = rank[active]
        by = np.lexsort((second, first))
        active, first, second = active[by], first[by], second[by]
        place = np.arange(len(active))
        new_group = np.r_[True, first[1:] != first[:-1]]
        new_key = new_group | np.r_[True, second[1:] != second[:-1]]
        group_at = np.maximum.accumulate(np.where(new_group, place, 0))
        key_at = np.maximum.accumulate(np.where(new_key, place, 0))
        rank = rank.copy()
        rank[active] = first + key_at - group_at
        h *= 2
        levels.append((h, rank))
        active = active[~(new_key & np.r_[new_key[1:], True])]
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    pairs = np.flatnonzero(levels[0][1][suffixes[1:]] == levels[0][1][suffixes[:-1]])
    a, b = suffixes[pairs], suffixes[pairs + 1]
    common = np.zeros(len(pairs), np.int64)
    for h, ranks in reversed(levels):
        at_a, at_b = a + common, b + common
        same = (at_a < ends[a]) & (at_b < ends[b])
        same &= ranks[np.minimum(at_a, n - 1)] == ranks[np.minimum(at_b, n - 1)]
        common[same] += h
    depth = np.zeros(n, np.int64)
    np.maximum.at(depth, a, common)
    np.maximum.at(depth, b, common)
    return depth


def covered(depth: np.ndarray, least: int) -> np.ndarray:
    """Word positions inside the union of all repeats of ``least`` words or more."""
    starts = np.flatnonzero(depth >= least)
    change = np.zeros(len(depth) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + depth[starts], -1)
    return np.cumsum(change[:-1]) > 0


def _rules(docs: DataFrame, min_words: int = 10, window: int = 5, max_repeat_percent: int = 20, min_repeat: int = 4,
           max_covered_percent: int = 30, max_longest: int = 40) -> tuple[Callable[[pa.RecordBatch], pa.RecordBatch], T.StructType]:
    schema = T.StructType([id_field(docs), *[T.StructField(c, T.LongType()) for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()),
        T.StructField("n_covered_words", T.LongType()), T.StructField("longest_repeat", T.LongType())])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        numbers, parts, sizes, chars, symbols, lines = _Numbers(), [], [], [], [], []
        for text in texts_of(batch):
            raw = text.encode("utf-8", "surrogatepass")
            words = raw.split()  # bytes are split at ASCII white space only
            sizes.append(len(words))
            parts.extend(map(numbers.__getitem__, words))
            chars.append(len(text) - sum(map(text.count, WHITE)))
            symbols.append(sum(raw.count(s) for s in SYMBOLS))
            rows = [x for x in text.split("\n") if x.strip(WHITE)]
            lines.append(len(rows) - len(set(rows)))
        sizes = np.array(sizes, np.int64)
        bounds = np.r_[0, np.cumsum(sizes)]
        depth = longest_repeats(np.array(parts, np.int64), np.repeat(bounds[1:], sizes))
        total = lambda flags: np.diff(np.r_[0, np.cumsum(flags)][bounds])
        in_windows, in_repeats = total(covered(depth, window)), total(covered(depth, min_repeat))
        longest = np.zeros(len(sizes), np.int64)
        np.maximum.at(longest, np.repeat(np.arange(len(sizes)), sizes), depth)
        failed = (sizes < min_words) | (100 * in_windows > max_repeat_percent * sizes)
        kept = ~failed & (100 * in_repeats <= max_covered_percent * sizes) & (longest <= max_longest)
        values = [batch.column(0), *[pa.array(np.asarray(v, np.int64)) for v in (sizes, chars, symbols, lines, in_windows)],
                  pa.array(failed), pa.array(kept), pa.array(in_repeats.astype(np.int64)), pa.array(longest)]
        return pa.RecordBatch.from_arrays(values, schema.names)

    return work, schema


def repetition_rules(docs: DataFrame, **limits: int) -> DataFrame:
    """Judge each text by its repeated passages.

    A word is a run of characters other than ASCII white space.  A text fails the base rules with fewer
    than ``min_words`` words, or when more than ``max_repeat_percent`` of its words lie in windows of
    ``window`` words found twice or more.  The method's own limits: maximal repeated substrings of
    ``min_repeat`` words or more may cover ``max_covered_percent`` of the words at most, and the longest
    may have ``max_longest`` words at most.

    Null and empty texts have no words and fail; repeated rows are judged one by one; an empty table
    gives no rows; a null id is carried along; columns other than doc_id and text are not read.
    """
    work, schema = _rules(docs, **limits)
    return map_texts(docs.select("doc_id", "text"), work, schema, SLICE_BYTES)


def keep_by_repetition(docs: DataFrame, **limits: int) -> DataFrame:
    """The rows of ``docs``, all columns, that ``repetition_rules`` keeps."""
    return filter_texts(docs, _rules(docs, **limits)[0], "kept", SLICE_BYTES)
