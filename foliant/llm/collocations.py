"""Phrase collocations by stripes: each prefix keys a counter of next words; stripes travel by bucket and are merged elementwise."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from foliant.llm.common import slices, stage
from foliant.plans.ranking import top_per_group

#: Bytes of text, and distinct words, whose stripes a task counts before it hands them on.
FLUSH_BYTES, FLUSH_WORDS = 32 << 20, 1 << 20
#: Next words in one row of stripes on its way to be merged; a batch of such rows stays small.
PIECE = 256
#: Buckets of a language that stripes are dealt to, at least, and words of the texts for each where there are more.
BUCKETS, BUCKET_WORDS = 1024, 1_000_000
#: Rows of stripes that are merged at a time.
MERGE_ROWS = 1024
#: Bits of the filter of frequent phrases (8 MB); it lets some others through, which costs volume only.
FILTER_BITS = 1 << 26
#: A prefix this frequent has its stripe cut into segments by the hash of the next word.
HOT_PREFIX, HOT_BITS, SEGMENTS = 1 << 18, 1 << 22, 64
#: Segments of the stripe of the empty prefix, which holds the words themselves.
WORD_SEGMENTS = 256
#: Candidates that one task puts in order.
SORT_ROWS = 100_000
#: Piece ends become a full stop, which no word can hold, tabs become spaces, and A-Z become a-z.
_LETTERS = bytes.maketrans(bytes(range(65, 91)) + b",;:!?\x0a\x0b\x0c\x0d\x09", bytes(range(97, 123)) + b"." * 9 + b" ")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Stripes of one bucket: ``size`` next words each, which follow one another in ``next`` and ``count``.
_STRIPES = "lang string, bucket int, prefix array<string>, segment array<int>, size array<int>, next array<string>, count array<long>"


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _chain(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase with one more word."""
    return _mix(h * _FACTOR + word)


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = h & np.uint64(8 * len(bits) - 1)
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


class _Buffer(dict):
    """Texts of one language as numbers of words; 0 ends a piece."""

    def __init__(self, lang: str) -> None:
        self.lang, self.parts, self.bytes = lang, [], 0
        self[b"."] = 0

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number

    def add(self, texts: list[str]) -> None:
        joined = b".".join([t.encode("utf-8").translate(_LETTERS) for t in texts])
        words = joined.replace(b".", b" . ").split()
        self.parts.append(np.fromiter(map(self.__getitem__, words), np.int32, len(words)))
        self.bytes += len(joined)

    def stripes(self, size: int, buckets: int, known: np.ndarray | None, hot: np.ndarray | None) -> pa.RecordBatch | None:
        """Counts of the phrases of ``size`` words whose first and last ``size - 1`` words are frequent, as stripes.

        A row holds stripes of one bucket, and a stripe may run on into the next row.
        """
        seed = self.lang.encode("utf-8")
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(seed + b" " + w) for w in self), np.uint64, len(self))
        ids = np.concatenate([*self.parts, np.zeros(size, np.int32)]).astype(np.int64)
        if size == 1:
            counts = np.bincount(ids, minlength=len(self))
            counts[0] = 0
            nexts = np.flatnonzero(counts)
            counts, first = counts[nexts], None
            group, segment = np.zeros(len(nexts), np.int64), (hashes[nexts] % np.uint64(WORD_SEGMENTS)).astype(np.int64)
            bucket = segment
        else:
            part = len(ids) - size + 1
            inside, h = ids[:part + 1] > 0, hashes[ids[:part + 1]]
            for k in range(1, size - 1):
                inside &= ids[k:part + 1 + k] > 0
                h = _chain(h, hashes[ids[k:part + 1 + k]])
            frequent = np.zeros(len(h), bool)
            at = np.flatnonzero(inside)
            frequent[at] = _has(known, h[at])
            at = np.flatnonzero(frequent[:-1] & frequent[1:])
            code = ids[at]
            for k in range(1, size - 1):
                code = np.unique(code * len(self) + ids[at + k], return_inverse=True)[1].reshape(-1)
            code, place, counts = np.unique(code * len(self) + ids[at + size - 1], return_index=True, return_counts=True)
            first, group, nexts = at[place], code // len(self), code % len(self)
            split = _has(hot, h[first])
            segment = np.where(split, (hashes[nexts] % np.uint64(SEGMENTS)).astype(np.int64), 0)
            bucket = (_chain(h[first], segment.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        if not len(nexts):
            return None
        order = np.lexsort((nexts, segment, group, bucket))
        bucket, group, segment, nexts, counts = (x[order] for x in (bucket, group, segment, nexts, counts))
        same = bucket[1:] == bucket[:-1]
        begin = np.flatnonzero(np.r_[True, ~same])
        run = np.arange(len(nexts)) - np.repeat(begin, np.diff(np.r_[begin, len(nexts)]))
        row = run % PIECE == 0
        stripe = np.flatnonzero(row | np.r_[True, ~same | (group[1:] != group[:-1]) | (segment[1:] != segment[:-1])])
        begin = np.flatnonzero(row)
        words = pa.array([w.decode("utf-8") for w in self], pa.string())
        if first is None:
            prefix = pa.array([""] * len(stripe), pa.string())
        else:
            start = first[order][stripe]
            prefix = pc.binary_join_element_wise(*[words.take(pa.array(ids[start + k])) for k in range(size - 1)], " ")
        inner, ends = (pa.array(np.r_[x, n].astype(np.int32)) for x, n in ((np.searchsorted(stripe, begin), len(stripe)), (begin, len(nexts))))
        sizes = np.diff(np.r_[stripe, len(nexts)])
        lists = [pa.ListArray.from_arrays(inner, x) for x in (prefix, pa.array(segment[stripe].astype(np.int32)), pa.array(sizes.astype(np.int32)))]
        lists += [pa.ListArray.from_arrays(ends, x) for x in (words.take(pa.array(nexts)), pa.array(counts.astype(np.int64)))]
        return pa.RecordBatch.from_arrays([pa.array([self.lang] * len(begin), pa.string()), pa.array(bucket[begin].astype(np.int32)), *lists],
                                          ["lang", "bucket", "prefix", "segment", "size", "next", "count"])


def _partial_stripes(docs: DataFrame, size: int, buckets: int = BUCKETS, known: object = None, hot: object = None) -> DataFrame:
    """Stripes of phrases of ``size`` words, counted over some 32 MB of text at a time.

    A count over such a run of texts gives at most a row for each bucket of a language and one for every PIECE next words, however many
    prefixes there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = [np.frombuffer(x.value, np.uint8) if x is not None else None for x in (known, hot)]
        buffers: dict[str, _Buffer] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for buffer in buffers.values():
                out = buffer.stripes(size, buckets, *filters)
                if out is not None:
                    yield out
            buffers.clear()

        for batch in batches:
            for part in slices(batch, 1):
                langs = part.column(0).to_pylist()
                texts = part.column(1).to_pylist()
                for lang in dict.fromkeys(langs):
                    if lang not in buffers:
                        buffers[lang] = _Buffer(lang)
                    buffers[lang].add([t for t, x in zip(texts, langs, strict=True) if x == lang])
                if sum(b.bytes for b in buffers.values()) > FLUSH_BYTES or sum(map(len, buffers.values())) > FLUSH_WORDS:
                    yield from flush()
        yield from flush()

    return docs.mapInArrow(run, _STRIPES)


def _merged(partial: DataFrame, least: int) -> DataFrame:
    """One stripe for each prefix and segment: counts of next words added up, those of ``least`` or more kept, and the sum of all.

    Rows of a bucket follow one another in a partition, so a task merges some MERGE_ROWS rows at a time and holds the counts of the bucket that
    runs on into the next ones.
    """
    keys = ["lang", "bucket", "prefix", "segment"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in (b.slice(start, MERGE_ROWS) for b in batches for start in range(0, b.num_rows, MERGE_ROWS)):
            lang, bucket, prefix, segment, size, following, counts = batch.columns
            row, stripe = pc.list_parent_indices(prefix), pa.array(np.repeat(np.arange(len(prefix.flatten())), size.flatten().to_numpy()))
            of_stripe = [lang.take(row), bucket.take(row), prefix.flatten(), segment.flatten()]
            flat = pa.table([*(c.take(stripe) for c in of_stripe), following.flatten(), counts.flatten()], [*keys, "next", "count"])
            flat = flat if held is None else pa.concat_tables([held, flat])
            added = flat.group_by([*keys, "next"], use_threads=False).aggregate([("count", "sum")]).rename_columns([*keys, "next", "count"])
            running = pc.and_(pc.equal(added["lang"], lang[-1]), pc.equal(added["bucket"], bucket[-1]))
            held = added.filter(running).combine_chunks()
            yield from stripes_of(added.filter(pc.invert(running)))
        if held is not None:
            yield from stripes_of(held)

    def stripes_of(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        table = table.drop_columns("bucket").combine_chunks()
        codes = [c.dictionary_encode().indices.to_numpy() if i < 2 else c.to_numpy() for i, c in enumerate(table[k].chunk(0) for k in ("lang", "prefix", "segment"))]
        order = np.lexsort(codes[::-1])
        codes = [c[order] for c in codes]
        columns = [table[c].chunk(0).take(pa.array(order)) for c in table.column_names]
        begin = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in codes], axis=0)])
        counts = columns[4].to_numpy()
        keep = counts >= least
        totals = np.add.reduceat(counts, begin)
        kept = np.add.reduceat(keep.astype(np.int64), begin)
        ends = pa.array(np.r_[0, np.cumsum(kept)].astype(np.int32))
        mask = pa.array(keep)
        out = [c.take(pa.array(begin)) for c in columns[:3]]
        rows = pa.RecordBatch.from_arrays([*out, pa.array(totals), pa.ListArray.from_arrays(ends, columns[3].filter(mask)),
                                           pa.ListArray.from_arrays(ends, columns[4].filter(mask))], ["lang", "prefix", "segment", "total", "next", "count"])
        rows = rows.filter(pa.array((kept > 0) | (rows.column(1).to_numpy(zero_copy_only=False) == "")))
        if rows.num_rows:
            yield rows

    near = partial.repartition("lang", "bucket").sortWithinPartitions("lang", "bucket")
    return stage(near.mapInArrow(run, "lang string, prefix string, segment int, total long, next array<string>, count array<long>"))


def _entries(stripes: DataFrame) -> DataFrame:
    """(lang, phrase, a) of every entry of the stripes."""
    rows = stripes.select("lang", "prefix", F.explode(F.arrays_zip("next", "count")).alias("e"))
    phrase = F.when(F.col("prefix") == "", F.col("e.next")).otherwise(F.concat_ws(" ", "prefix", "e.next"))
    return rows.select("lang", phrase.alias("phrase"), F.col("e.count").alias("a"))


def _filters(entries: DataFrame) -> tuple[object, object]:
    """Broadcast bits of the frequent phrases and of the hot ones: FILTER_BITS and HOT_BITS, whatever the number of phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seed = lang.encode("utf-8") + b" "
                words = [xxhash.xxh3_64_intdigest(seed + w) for w in phrase.encode("utf-8").split(b" ")]
                h = np.array(words[:1], np.uint64)
                for w in words[1:]:
                    h = _chain(h, np.array([w], np.uint64))
                out.append(int(h[0]) & (FILTER_BITS - 1))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), batch.column(2)], ["place", "a"])

    spark = entries.sparkSession
    places = stage(entries.mapInArrow(run, "place long, a long"))
    hot = places.where(F.col("a") >= HOT_PREFIX).select((F.col("place") % HOT_BITS).alias("place"))
    return _bits(spark, places, FILTER_BITS), _bits(spark, hot, HOT_BITS)


def _bits(spark: SparkSession, places: DataFrame, bits: int) -> object:
    per_row = 32768
    rows = places.groupBy((F.col("place") / per_row).cast("int").alias("k")).agg(F.expr(f"bitmap_construct_agg(place % {per_row})").alias("bits"))
    out = bytearray(bits // 8)
    for r in rows.toLocalIterator():
        out[r["k"] * per_row // 8:(r["k"] + 1) * per_row // 8] = r["bits"]
    return spark.sparkContext.broadcast(bytes(out))


def _first_rows(rows: DataFrame, keep: int) -> DataFrame:
    """The first ``keep`` of each language; a language's rows are dealt to ever fewer groups that each keep their first."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salts = max(1, math.ceil(rows.count() / SORT_ROWS))
    while salts > 1:
        rows = top_per_group(rows.withColumn("_salt", F.pmod(F.xxhash64("phrase", F.lit(salts)), F.lit(salts))), ["lang", "_salt"], order, keep).drop("_salt", "rank")
        salts = min(salts // 2, math.ceil(salts * keep / SORT_ROWS))
    return top_per_group(rows, ["lang"], order, keep)


def mine_collocations(docs: DataFrame, longest: int = 4, least: int = 30, keep: int = 2000, subsumed: int = 80) -> DataFrame:
    """Phrases of 2 to ``longest`` words that stand together more often than their parts would.

    A phrase is counted in the stripe of its prefix: (language, prefix) keys a counter of next words.
    Tasks count stripes of their texts and deal them to buckets by prefix; stripes of a bucket travel in one row, and equal prefixes' stripes are merged
    elementwise.  Extensions
    are a stripe's entries, the total of a prefix is its entry in the stripe one word shorter, and the
    largest entry of the stripe, or among phrases with the same words after their first, says whether
    a phrase is subsumed.  A phrase can't be frequent unless both its parts one word shorter are, so each
    length counts only phrases whose parts passed the filter of the length before: exact, as the filter
    only errs by letting more through.

    Lower-case A-Z, pieces end at ``.,;:!?`` and line ends, words at spaces and tabs.  Phrases with a
    count below ``least`` are no candidates; one inside a longer candidate with ``subsumed`` percent of its count or more is dropped.
    The score of a cut is floor(2000000 a / (l + r)), the lowest cut counts; the first ``keep`` per
    language come out with ``n``, the words of the language.

    A null text is empty; a null language is ``und``; repeated rows count as often as they stand; an empty table gives no
    rows; columns other than lang and text, ids included, are not read.
    """
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text is not null")
    levels = [_merged(_partial_stripes(docs, 1), least)]
    n = levels[0].agg(F.sum("total")).first()[0] or 0
    for size in range(2, longest + 1):
        known, hot = _filters(_entries(levels[-1]))
        levels.append(_merged(_partial_stripes(docs, size, max(BUCKETS, n // BUCKET_WORDS), known, hot), least))
    words = levels[0].groupBy("lang").agg(F.sum("total").alias("n"))
    entries = [_entries(x) for x in levels]
    phrases = stage(_union([e.select("*", F.lit(k).alias("words")) for k, e in enumerate(entries, 1)]))
    candidates = phrases.where("words > 1")

    after = _union([x.select("lang", F.col("prefix").alias("phrase"), F.array_max("count").alias("most")) for x in levels[1:]])
    before = phrases.where("words > 2").select("lang", F.expr("substring(phrase, instr(phrase, ' ') + 1)").alias("phrase"), F.col("a").alias("most"))
    within = after.union(before).groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    wide = lambda c: F.col(c).cast("decimal(24,0)")
    alone = candidates.join(within, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * wide("most") < subsumed * wide("a")))

    w = F.split("phrase", " ")
    cuts = alone.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"), w.alias("w"))
    sides = F.array(F.struct(F.lit(0).alias("side"), F.expr("array_join(slice(w, 1, k), ' ')").alias("part"), F.col("k").alias("size")),
                    F.struct(F.lit(1).alias("side"), F.expr("array_join(slice(w, k + 1, words), ' ')").alias("part"), (F.col("words") - F.col("k")).alias("size")))
    parts = cuts.select("lang", "phrase", "a", "k", F.explode(sides).alias("s")).select("lang", "phrase", "a", "k", "s.side", "s.part", "s.size")
    # a common word is part of many phrases: its row is repeated for the salts, and the phrases are dealt to them
    salted = parts.withColumn("salt", F.when(F.col("size") == 1, F.pmod(F.xxhash64("phrase"), F.lit(16)).cast("int")).otherwise(0))
    found = phrases.withColumn("salt", F.explode(F.when(F.col("words") == 1, F.sequence(F.lit(0), F.lit(15))).otherwise(F.array(F.lit(0)))))
    met = salted.join(found.select("lang", F.col("phrase").alias("part"), "salt", F.col("a").alias("f")), ["lang", "part", "salt"])
    cut = met.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    cut = cut.withColumn("score", F.expr("2000000 * cast(a as decimal(24,0)) div (cast(l as decimal(24,0)) + cast(r as decimal(24,0)))"))
    least_cut = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    scored = stage(least_cut.select("lang", "phrase", "a", "c.l", "c.r", "c.score"))
    best = _first_rows(scored, keep)
    return best.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
