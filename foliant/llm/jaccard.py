"""N-gram Jaccard join by vertical partitioning: the n-gram order is cut into fragments, overlaps are counted in each and summed."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from foliant.llm.common import anchors, connected_components, id_field, map_texts, stage, texts_of, unstage

#: Fragments of the n-gram order in which the overlap of a candidate pair is counted.
PARTS = 8
#: Documents with as many n-grams at most use every n-gram as a fragment of its own.
SMALL_SET = 64
#: Larger documents use fragments of 0.9 to 1.8 n-grams up to this size, of 1.8 to 3.6 beyond it ...
MIDDLE_SET = 256
#: ... and of those the first so many; see ``signatures`` for what that means for a pair.
FRAGMENTS = 128
#: Parts of the signature space that are worked through one after the other.
SLICES = 4
#: Bits of the filter that keeps unlinked documents from being read again; 4 MB at most reach the driver.
FILTER_BITS = 1 << 25
#: Documents and n-grams of a block, and n-grams of a slice, where families of components are compared.
BLOCK_ROWS, BLOCK_GRAMS, SLICE_GRAMS = 1024, 1 << 20, 4096
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    """Hashes of words, kept for a slice of texts."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word n-grams of each text; of the whole sequence where it is shorter.

    The hash is the global order of n-grams.
    """
    table, out = _WordHashes(), []
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
        w = np.fromiter(map(table.__getitem__, words), np.uint64, len(words))
        size = min(n, len(w))
        if not size:
            out.append(w)
            continue
        h = np.full(len(w) - size + 1, size, np.uint64)
        for k in range(size):
            h = h * _FACTOR + w[k:len(w) - size + 1 + k]
        out.append(np.unique(_mix(h)))
    return out


def _levels(size: int) -> list[int]:
    """Numbers of fragments (powers of two; 0: each n-gram alone) at which a set of this size meets all partners.

    A partner has 0.8 to 1.25 times the size.  The level of a size never falls, and sizes within that
    factor lie at one level or two neighbouring ones, so the levels of the size and of 1.25 times it do.
    """
    def level(s: float) -> int:
        if s <= SMALL_SET:
            return 0
        share = 0.56 if s <= MIDDLE_SET else 0.28
        return 1 << math.ceil(math.log2(share * s))

    return sorted({level(size), level(1.25 * size)})


def signatures(grams: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """Hashes of the contents of the set's fragments, and how many of them a linked partner must share at least.

    Two sets with a Jaccard similarity of 0.8 differ in a quarter of the smaller one's n-grams at most,
    which the hash order spreads over the fragments like balls over bins: a fragment with g n-grams on
    average is equal in both with a chance of exp(-g / 4) or more.  With F fragments that hold n-grams,
    the number of equal ones is binomial, and the second result lies 6.5 standard deviations below its
    mean (a chance under 1e-9 at the very threshold, and far less above it).  Small sets need no
    chance: they share as many n-grams as the similarity asks for.
    """
    out, need = [], []
    for fragments in _levels(len(grams)):
        if not fragments:
            out.append(grams)
            need.append(-(-percent * len(grams) // 100))
            continue
        bits = fragments.bit_length() - 1
        grams_here = grams[:np.searchsorted(grams, np.uint64(FRAGMENTS << (64 - bits)))] if fragments > FRAGMENTS else grams
        place = (grams_here >> np.uint64(64 - bits)).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else place
        sums = np.add.reduceat(_mix(grams_here + _FACTOR), starts) if len(place) else grams_here
        out.append(_mix(sums ^ (place[starts].astype(np.uint64) * _FACTOR) ^ np.uint64(fragments)))
        chance = math.exp(-len(grams) / fragments / 4)
        need.append(max(1, math.floor(len(starts) * chance - 6.5 * math.sqrt(len(starts) * chance * (1 - chance)))))
    return np.concatenate(out), min(need)


def _signature_rows(docs: DataFrame, n: int, percent: int) -> DataFrame:
    schema = T.StructType([id_field(docs), T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()),
                           T.StructField("need", T.LongType()), *[T.StructField(f"signatures_{k}", T.ArrayType(T.LongType())) for k in range(SLICES)]])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(texts_of(batch), n)
        signed = [signatures(s, percent) if len(s) else (s, 0) for s in sets]
        digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        lists = [_lists([s[s % np.uint64(SLICES) == k] for s, _ in signed]) for k in range(SLICES)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()),
                                           pa.array([k for _, k in signed], pa.int64()), *lists], schema.names)

    return map_texts(docs.select("doc_id", "text"), work, schema)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))


def _filter_of(spark: SparkSession, nodes: DataFrame) -> bytes:
    """A bit for each hash value that a node has: at most FILTER_BITS bits, whatever the number of nodes."""
    place = F.pmod(F.xxhash64("node"), F.lit(FILTER_BITS))
    per_row = 32768
    rows = nodes.select(place.alias("p")).groupBy((F.col("p") / per_row).cast("int").alias("k")).agg(
        F.expr(f"bitmap_construct_agg(p % {per_row})").alias("bits")).collect()
    out = bytearray(FILTER_BITS // 8)
    for r in rows:
        out[r["k"] * per_row // 8:(r["k"] + 1) * per_row // 8] = r["bits"]
    return bytes(out)


def _sets_of(docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(node, part, grams) of the nodes, read again from their texts.

    Texts whose id the filter does not know are dropped where they are read; those it lets through by
    chance are in no pair.
    """
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(_filter_of(spark, nodes))
    schema = T.StructType([id_field(docs), T.StructField("digest", T.BinaryType()), T.StructField("part", T.IntegerType()),
                           T.StructField("grams", T.ArrayType(T.LongType()))])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        place = batch.column(2).to_numpy()
        bits = np.frombuffer(known.value, np.uint8)
        batch = batch.filter(pa.array((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1))
        if not batch.num_rows:
            return None
        sets = shingle_sets(texts_of(batch), n)
        rows, parts, grams = [], [], []
        for i, s in enumerate(sets):
            cut = np.searchsorted(s, np.arange(1, PARTS, dtype=np.uint64) << np.uint64(64 - (PARTS.bit_length() - 1)))
            for k, part in enumerate(np.split(s, cut)):
                if len(part):
                    rows.append(i)
                    parts.append(k)
                    grams.append(part)
        digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array([digests[i] for i in rows], pa.binary()),
                                           pa.array(parts, pa.int32()), _lists(grams)], schema.names)

    place = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    read = map_texts(docs.where("doc_id is not null").select("doc_id", "text", place.alias("place")), work, schema)
    sets = stage(read.withColumnRenamed("doc_id", "node"))
    if sets.groupBy("node", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return sets.drop("digest")
    return stage(sets.join(nodes, ["node", "digest"]).drop("digest").dropDuplicates(["node", "part"]))  # rows that share an id


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, n_a, b, n_b) with their overlap: counted in each fragment of the n-gram order, then summed."""
    left = sets.select(F.col("node").alias("a"), "part", F.col("grams").alias("grams_a"))
    right = sets.select(F.col("node").alias("b"), "part", F.col("grams").alias("grams_b"))
    partial = pairs.join(left, "a").join(right, ["b", "part"]).select(
        "a", "b", "n_a", "n_b", F.size(F.array_intersect("grams_a", "grams_b")).alias("overlap"))
    shared = partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("overlap").alias("shared"))
    return shared.select("a", "b", (100 * F.col("shared") >= percent * (F.col("n_a") + F.col("n_b") - F.col("shared"))).alias("linked"))


def _ordered(pairs: DataFrame, percent: int) -> DataFrame:
    """(x, n_x, y, n_y) as (a, n_a, b, n_b) with a < b, where the sizes allow a link."""
    swap = F.col("x") > F.col("y")
    pick = lambda p, q: F.when(swap, F.col(q)).otherwise(F.col(p))
    fits = pairs.where(f"x <> y and 100 * least(n_x, n_y) >= {percent} * greatest(n_x, n_y)")
    return fits.select(pick("x", "y").alias("a"), pick("n_x", "n_y").alias("n_a"), pick("y", "x").alias("b"), pick("n_y", "n_x").alias("n_b"))


def _met_signatures(first: DataFrame) -> DataFrame:
    """(sig, node, n) of the signatures that more than one node has.

    Nearly all signatures have one node only, and all must be shuffled to know.  The signature space is cut into ``SLICES``, a
    column each, one after the other: what a slice shuffles is gone when its survivors are written.
    """
    parts = []
    for k in range(SLICES):
        entries = first.select("node", "n", F.explode(f"signatures_{k}").alias("sig"))
        often = entries.groupBy("sig").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select("sig")
        parts.append(stage(entries.join(often, "sig").select("sig", "node", "n")))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _rarest(shared: DataFrame) -> DataFrame:
    """The signatures of each node, rarest first, without its last ``need - 1``.

    Two nodes that share ``need`` signatures share one of these, so common passages drop out.
    """
    often = shared.groupBy("sig").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    own = Window.partitionBy("node")
    ranked = shared.join(often, "sig").withColumn("have", F.count(F.lit(1)).over(own)).withColumn("k", F.row_number().over(own.orderBy("df", "sig")))
    return ranked.where("k <= have - need + 1").select("sig", "node", "n")


def _overlaps(left: pd.DataFrame, right: pd.DataFrame, n_left: int, n_right: int) -> np.ndarray:
    """Common n-grams of each pair of documents from two blocks of (place, grams), by products of slices of the incidence matrices."""
    grams = [np.concatenate(list(x["grams"])).view(np.uint64) for x in (left, right)]
    owner = [np.repeat(x["place"].to_numpy(), x["grams"].map(len)) for x in (left, right)]
    common = np.intersect1d(*grams)
    out = np.zeros((n_left, n_right), np.float32)
    at = [np.searchsorted(common, g) for g in grams]
    held = [(a < len(common)) & (common[np.minimum(a, len(common) - 1)] == g) if len(common) else np.zeros(len(g), bool) for a, g in zip(at, grams, strict=True)]
    column, owner = [a[h] for a, h in zip(at, held, strict=True)], [o[h] for o, h in zip(owner, held, strict=True)]
    order = [np.argsort(c, kind="stable") for c in column]
    column, owner = [c[o] for c, o in zip(column, order, strict=True)], [w[o] for w, o in zip(owner, order, strict=True)]
    for start in range(0, len(common), SLICE_GRAMS):
        parts = []
        for c, w, n in zip(column, owner, (n_left, n_right), strict=True):
            lo, hi = np.searchsorted(c, [start, start + SLICE_GRAMS])
            part = np.zeros((n, min(SLICE_GRAMS, len(common) - start)), np.float32)
            part[w[lo:hi], c[lo:hi] - start] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def _between_components(shared: DataFrame, components: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join the components further: a spanning forest of all links between components that share a signature.

    Components that share a signature make up a family.  A family's documents are dealt to blocks, and a
    task counts the overlaps of all pairs of two blocks at once; it returns one row per document that
    moves to another component, never the pairs.
    """
    placed = shared.join(components, "node", "left").select("sig", "node", "n", F.coalesce("component", "node").alias("component"))
    top = placed.groupBy("sig").agg(F.min("component").alias("top"), F.max("component").alias("last")).where("top < last")
    mixed = stage(placed.join(top.select("sig", "top"), "sig"))
    families = connected_components(mixed.select(F.col("component").alias("a"), F.col("top").alias("b")))
    nodes = mixed.select("node", "n", "component").distinct().join(families.toDF("component", "family"), "component", "left")
    nodes = stage(nodes.withColumn("family", F.coalesce("family", "component")))
    blocks = nodes.groupBy("family").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_ROWS, F.sum("n") / BLOCK_GRAMS)).cast("int").alias("blocks"))
    dealt = nodes.join(blocks, "family").withColumn("own", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int"))
    dealt = dealt.join(sets.select("node", "grams"), "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        i, j = group["i"].iat[0], group["j"].iat[0]
        first = group.drop_duplicates("node")
        sides, places = [], []
        for block in (i, j):
            ids = first[first["own"] == block].reset_index(drop=True)
            rows = group[group["own"] == block]
            sides.append(ids)
            places.append(rows.assign(place=rows["node"].map(pd.Series(ids.index, ids["node"]))))
        if sides[0].empty or sides[1].empty:
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        shared_grams = _overlaps(places[0], places[1], len(sides[0]), len(sides[1])).astype(np.int64)
        n_a, n_b = (x["n"].to_numpy(np.int64) for x in sides)
        linked = (100 + percent) * shared_grams >= percent * (n_a[:, None] + n_b[None, :])
        linked &= sides[0]["component"].to_numpy()[:, None] != sides[1]["component"].to_numpy()[None, :]
        a, b = np.nonzero(linked)
        ids = np.r_[sides[0]["node"].to_numpy(), sides[1]["node"].to_numpy()]
        joined = anchors(ids, a, b + len(sides[0]))
        moved = ids != joined
        return pd.DataFrame({"a": ids[moved], "b": joined[moved]})

    found = dealt.select("family", "i", "j", "own", "node", "n", "component", "grams")
    return stage(found.groupBy("family", "i", "j").applyInPandas(compare, "a long, b long"))


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents whose sets of word n-grams have a Jaccard similarity of ``percent`` or more.

    Documents with equal sets are one class.  Each class signs the fragments of the n-gram order that
    its set is cut into; classes that share fewer signatures than a link needs are done.  The others
    are first compared with one representative of each signature they share, and the links found are
    joined to components.  Then all documents of components that still share a signature are compared in
    blocks, so that no link between components is lost while copies are never expanded into pairs.
    Of a class's signatures only the rarest count, as many as a partner cannot avoid.
    A pair is compared by counting the overlap in each of ``PARTS`` fragments and summing.

    A null text, and one without words, has an empty set and links with nothing; rows of one id count as
    one document; a null id joins the component of its copies and is null without any; an empty table
    gives no rows; columns other than doc_id and text are not read.  The fragments are laid out for a
    ``percent`` of 80 to 100; others are an error.
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent must be 80 to 100: below, pairs share fewer fragments than are asked for")
    signed = stage(_signature_rows(docs, n, percent))
    parts = [f"signatures_{k}" for k in range(SLICES)]
    rows = stage(signed.drop(*parts))
    classes = rows.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("node"))
    first = stage(signed.join(classes.select("digest", F.col("node").alias("doc_id")), ["digest", "doc_id"]).select(
        F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "digest", "need", *parts))
    unstage(signed)
    shared = _met_signatures(first)
    having = shared.groupBy("node").agg(F.count(F.lit(1)).alias("have"))
    nodes = stage(first.select("node", "digest", "need").join(having, "node").where("have >= need").groupBy("node").agg(F.min("need").alias("need"), F.min("digest").alias("digest")))
    unstage(first)
    met, shared = shared, stage(_rarest(shared.join(nodes.select("node", "need"), "node")))
    unstage(met)
    sets = _sets_of(docs, nodes, n)

    heads = shared.groupBy("sig").agg(F.min(F.struct(F.xxhash64("node").alias("h"), "node", "n")).alias("head"))
    pairs = shared.join(heads, "sig").select(F.col("node").alias("x"), F.col("n").alias("n_x"), F.col("head.node").alias("y"), F.col("head.n").alias("n_y"))
    compared = stage(_verified(_ordered(pairs, percent).distinct(), sets, percent))
    components = connected_components(compared.where("linked").select("a", "b"))
    more = _between_components(shared, components, sets, percent)
    if not more.isEmpty():
        components = connected_components(compared.where("linked").select("a", "b").union(more))
    member = rows.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left").join(components, "node", "left")
    return member.select("doc_id", "n_shingles", F.coalesce("component", "node", "doc_id").alias("component_id"))
