"""N-gram Jaccard join: documents whose sets of five-word shingles are alike, and the groups that such links form.

1. Shingle sets are hashed and sorted in vectorised passes over the bytes of a batch. Equal sets are one class; only the
   first document of a class goes on.
2. Each class is put on tiles, one for every shingle of its prefix: the first floor(n / 5) + 1 shingles in an order in which
   frequent ones come last, the most frequent at the very end. The first shingle that two sets share in that order can stand
   at place p (from 0) of a set of n only if 4 (n + m) <= 9 (n - p), where m is the size of the other; so every row of a tile
   knows the largest partner it can have there. Of two sets the smaller meets the larger only by its first floor(n / 9) + 1
   shingles: a passage that makes up less than 8 / 9 of the documents that share it does not bring them together.
3. On a tile only sizes within the band 0.8 to 1.25 can link: rows are joined by shingle and band, the smaller set in its own
   band, the larger in each band that its smaller partners can be in. Rows of a (shingle, band) beyond BLOCK are dealt out to several tasks. The
   bit counts of hashed bitmap signatures bound the overlap from above: every bit in which two signatures differ stands for at
   least one shingle that only one set has. Bits are parities, so what both sets have leaves no trace in the difference and
   few bits give a close bound.
4. What remains is intersected exactly on sorted arrays.

First every class is compared with the least class of its tiles, and the links found are contracted to groups; then
classes of different groups that still share a tile are compared. Within a group nothing more is asked, so thousands of
near copies cost a few comparisons each, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermill.llm.components import components
from ledgermill.llm.sizes import broadcast_if_small
from ledgermill.session import materialise

SHINGLE, PERCENT = 5, 80
#: Bytes hashed at a time, to bound memory.
PIECE_BYTES = 1 << 21
#: Shingles in at least so many documents of one batch and in total count as frequent; at most so many are remembered, the
#: most frequent ones. This orders prefixes and changes no result.
FREQUENT_IN_BATCH, FREQUENT, MOST_FREQUENT = 4, 24, 1_000_000
#: Rows of a (shingle, band) that one task compares with the others there; pairs of a first document that one task verifies;
#: copies from which a class is joined apart from the others. These deal out the work and change no result.
BLOCK, PARTNERS, HOT_CLASS = 512, 256, 1000
#: Ratio of two bands of sizes. At 2 a third of the sizes have partners in two bands.
BAND = 2.0
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (a published finaliser of three shifts and two multiplications)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE = _mix(_LOWER.astype(_U) + _U(0x9E3779B97F4A7C15))
_STEP = _U(0xD6E8FEB86659FD93)
_PLACE = _mix(np.arange(1, SHINGLE + 1, dtype=_U)) | _U(1)


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word in a buffer of texts with A-Z lowered, and the position where it starts. `bounds` are the starts of the texts
    and the end of the last. The buffer is worked on in pieces that end at white space or at the end of a text."""
    hashes, starts, lo, size = [np.empty(0, _U)], [np.empty(0, np.int64)], int(bounds[0]), int(bounds[-1])
    while lo < size:
        hi = min(lo + PIECE_BYTES, size)
        while hi < size and not _SPACE[data[hi]]:
            end = int(bounds[np.searchsorted(bounds, hi)])          # the next end of a text
            gaps = np.flatnonzero(_SPACE[data[hi:min(hi + 65536, end)]])
            if len(gaps):
                hi += int(gaps[0])
                break
            hi = min(hi + 65536, end)
            if hi == end:
                break
        inside = ~_SPACE[data[lo:hi]]
        first = np.zeros(hi - lo, bool)
        edges = bounds[np.searchsorted(bounds, lo):np.searchsorted(bounds, hi)] - lo
        first[edges] = True
        first[0] = True
        first[1:] |= ~inside[:-1]
        at = np.flatnonzero(inside)
        begin = np.flatnonzero(first[at])
        if len(begin):
            length = np.diff(np.append(begin, len(at)))
            place = np.arange(len(at)) - np.repeat(begin, length)
            powers = np.cumprod(np.full(int(length.max()), _STEP))
            values = _BYTE[data[lo:hi][at]] * powers[place]
            hashes.append(_mix(np.add.reduceat(values, begin) + length.astype(_U)))
            starts.append(at[begin] + lo)
        lo = hi
    return np.concatenate(hashes), np.concatenate(starts)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text of an Arrow array; empty for null and for texts without words."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    buffers = texts.buffers()
    bounds = np.frombuffer(buffers[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    words, starts = word_hashes(data, bounds)
    cut = np.searchsorted(starts, bounds)
    full = np.zeros(max(len(words) - SHINGLE + 1, 0), _U)
    for j in range(SHINGLE):
        full += words[j:len(full) + j] * _PLACE[j]
    full = _mix(full)
    sets = []
    for a, b in zip(cut[:-1], cut[1:]):
        if b - a >= SHINGLE:
            own = np.sort(full[a:b - SHINGLE + 1])
            sets.append(own[np.append(True, own[1:] != own[:-1])])
        elif b > a:
            sets.append(_mix((words[a:b] * _PLACE[:b - a]).sum(dtype=_U, keepdims=True) + _U(b - a)))
        else:
            sets.append(np.empty(0, _U))
    return sets


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """Signature of 64-bit words: one to two bits per shingle, a power of two of words. A bit is the parity of the shingles hashed to
    it, so shingles of both sets cancel when two signatures are compared and only those of one set can hide one another. A longer
    signature folded in halves by XOR equals the shorter one of the same set."""
    words = 1 << max(0, (len(shingles) - 1) // 64).bit_length()
    counts = np.bincount((shingles & _U(words * 64 - 1)).astype(np.int64), minlength=words * 64)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view("<i8")


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Ids and shingle sets, a bounded number of bytes at a time."""
    for batch in batches:
        lo, sizes = 0, np.cumsum(np.append(0, pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)))
        while lo < len(batch):
            hi = max(lo + 1, int(np.searchsorted(sizes, sizes[lo] + 8 * PIECE_BYTES, "right")) - 1)
            part = batch.slice(lo, hi - lo)
            yield part.column(0).to_numpy(zero_copy_only=False), shingle_sets(part.column(1))
            lo = hi


def describe(texts: DataFrame) -> DataFrame:
    """One row per document: kind 0, id, n (size of its set), a, b (two hashes of the set); and rows of kind 1 with a shingle `a`
    in n documents of one batch, if it is frequent there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _columns(batches):
            n = np.array([len(s) for s in sets], np.int64)
            a = np.array([s.sum(dtype=_U) for s in sets], _U).view(np.int64)
            b = np.array([np.bitwise_xor.reduce(_mix(s + _STEP)) if len(s) else 0 for s in sets], _U).view(np.int64)
            yield pa.RecordBatch.from_pydict({"kind": np.zeros(len(ids), np.int32), "id": ids, "n": n, "a": a, "b": b})
            every = np.sort(np.concatenate(sets))
            if len(every) >= FREQUENT_IN_BATCH:
                far = FREQUENT_IN_BATCH - 1
                often, times = np.unique(every[:-far][every[:-far] == every[far:]], return_counts=True)
                if len(often):
                    zero = np.zeros(len(often), np.int64)
                    yield pa.RecordBatch.from_pydict({"kind": np.ones(len(often), np.int32), "id": zero, "n": times.astype(np.int64) + far,
                                                      "a": often.view(np.int64), "b": zero})
    return texts.mapInArrow(run, "kind int, id long, n long, a long, b long")


def prefixes(texts: DataFrame, frequent: np.ndarray) -> DataFrame:
    """id, n, bits, keys: size, bitmap signature and prefix shingles, in order, of every document that has words. `frequent` has
    the frequent shingles, the most frequent first."""
    order = np.argsort(frequent)
    shared = texts.sparkSession.sparkContext.broadcast((frequent[order], order))        # at most MOST_FREQUENT numbers each

    def prefix(s: np.ndarray) -> np.ndarray:
        known, place = shared.value
        if len(known):
            at = np.minimum(np.searchsorted(known, s), len(known) - 1)
            common = known[at] == s
            s = np.concatenate([s[~common], s[common][np.argsort(-place[at[common]])]])
        return s[:len(s) * (100 - PERCENT) // 100 + 1].view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _columns(batches):
            keep = [i for i, s in enumerate(sets) if len(s)]
            yield pa.RecordBatch.from_pydict({
                "id": ids[keep], "n": np.array([len(sets[i]) for i in keep], np.int64),
                "bits": pa.array([bitmap(sets[i]) for i in keep], pa.list_(pa.int64())),
                "keys": pa.array([prefix(sets[i]) for i in keep], pa.list_(pa.int64()))})
    return texts.mapInArrow(run, "id long, n long, bits array<long>, keys array<long>")


def _fold(bits: Column, other: Column) -> Column:
    """The longer of two signatures folded to the length of the shorter; classes within a size band differ by one doubling."""
    half = (F.size(bits) / 2).cast("int")
    return F.when(F.size(bits) > F.size(other), F.zip_with(F.slice(bits, 1, half), F.slice(bits, half + 1, half), lambda x, y: x.bitwiseXOR(y))).otherwise(bits)


def may_link(n1: Column, bits1: Column, n2: Column, bits2: Column) -> Column:
    """Whether sizes are in one band and the bit counts leave an overlap of 80 % of the union possible: the two sets may differ
    in at most (n1 + n2) / 9 shingles."""
    apart = F.aggregate(F.zip_with(_fold(bits1, bits2), _fold(bits2, bits1), lambda x, y: F.bit_count(x.bitwiseXOR(y))),
                        F.lit(0), lambda s, x: s + x)
    in_band = (F.least(n1, n2) * 100 >= F.greatest(n1, n2) * PERCENT)
    return in_band & (apart * (100 + PERCENT) <= (n1 + n2) * (100 - PERCENT))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link, by exact intersection of sorted arrays. Texts travel, which are smaller than their
    hashed sets: that of b with each pair, that of a once."""
    def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo = 0
            while lo < len(batch):                  # some rows at a time, as texts can be long
                part = batch.slice(lo, 256)
                lo += 256
                keep = []
                for x, y in zip(shingle_sets(part.column(2)), shingle_sets(part.column(3))):
                    short, long = (x, y) if len(x) <= len(y) else (y, x)
                    same = int((long[np.minimum(np.searchsorted(long, short), len(long) - 1)] == short).sum()) if len(short) else 0
                    keep.append(same > 0 and 100 * same >= PERCENT * (len(x) + len(y) - same))
                chosen = part.filter(pa.array(keep, pa.bool_()))
                yield pa.RecordBatch.from_arrays(chosen.columns[:2], names=["a", "b"])
    # a document with many partners is verified in several tasks
    heads = broadcast_if_small(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("parts")))
    dealt = broadcast_if_small(pairs.join(heads, "a").select("a", F.col("b").alias("id"), F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part")))
    right = texts.join(dealt, "id").select("a", "part", F.col("id").alias("b"), F.col("text").alias("y"))
    left = texts.join(heads.withColumnRenamed("a", "id"), "id").select(
        F.col("id").alias("a"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("text").alias("x"))
    return right.join(left, ["a", "part"]).select("a", "b", "x", "y").mapInArrow(intersect, "a long, b long")


def largest_partner(n: Column, place: Column) -> Column:
    """Size up to which another set can link with a set of n, if the first shingle they share is at this place (from 0)."""
    return F.floor(((100 + PERCENT) * (n - place) - PERCENT * n) / PERCENT)


def _with_class(sizes: DataFrame, classes: DataFrame) -> DataFrame:
    """`sizes` left-joined with its classes; classes of many copies by themselves, as one key would be one task."""
    keys = ["n", "a", "b"]
    hot = broadcast_if_small(classes.where(F.col("m") > HOT_CLASS).drop("m").withColumn("hot", F.lit(True)))
    marked = sizes.join(hot, keys, "left")
    value = [c for c in classes.columns if c not in (*keys, "m")]
    cold = marked.where("hot IS NULL").drop("hot", *value).join(classes.where(F.col("m") <= HOT_CLASS).drop("m"), keys, "left")
    return cold.unionByName(marked.where("hot").drop("hot"))


def _meetings(rows: DataFrame, signed: DataFrame) -> DataFrame:
    """a, b: pairs of different components on a tile that sizes, places and signatures allow. `rows` has key, id, n, most, component."""
    def band(size: Column) -> Column:
        return F.floor(F.log(size) / F.log(F.lit(BAND))).cast("int")
    least = F.ceil(F.col("n") * PERCENT / 100)
    full = broadcast_if_small(rows.where("most >= n").groupBy("key", band(F.col("n")).alias("band")).agg(
        F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("blocks > 1"))
    rows = rows.join(signed.select("id", "bits"), "id")
    smaller = rows.where("most >= n").withColumn("band", band(F.col("n")))
    larger = rows.where(F.col("most") >= least).withColumn("band", F.explode(F.sequence(band(least), band(F.least("n", "most")))))
    smaller = smaller.join(full, ["key", "band"], "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("id"), "blocks"), F.lit(0)).cast("int"))
    larger = larger.join(full, ["key", "band"], "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks") - 1, F.lit(0)))))
    at = ["key", "band", "block"]
    one, two = (t.select(*at, *[F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "most", "component", "bits")]) for t, s in ((smaller, "x"), (larger, "y")))
    ordered = (F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("id_x") < F.col("id_y")))
    met = one.join(two, at).where(ordered & (F.col("id_x") != F.col("id_y")) & (F.col("n_y") <= F.col("most_x")) & (F.col("n_x") <= F.col("most_y"))
                                  & (F.col("component_x") != F.col("component_y")) & may_link(F.col("n_x"), F.col("bits_x"), F.col("n_y"), F.col("bits_y")))
    return met.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, one row per row of `docs`.

    Null, empty and wordless texts: 0 shingles, linked with nothing, a group of their own. Texts of one to four words are
    one shingle. Repeated rows are in one class. A null doc_id gets a row of its own values with component null and links
    nothing. Extra columns are not read; an empty table gives an empty result.
    """
    texts = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    described = materialise(describe(texts))
    heavy = (described.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
             .orderBy(F.desc("n"), "a").limit(MOST_FREQUENT).select("a").toPandas()["a"].to_numpy(np.int64))
    sizes = described.where("kind = 0").select("id", "n", "a", "b")
    classes = materialise(sizes.where("n > 0").groupBy("n", "a", "b").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("m")).where("m > 1"))
    copies = broadcast_if_small(_with_class(sizes, classes).where(F.col("id") != F.col("rep")).select("id"))
    reps = materialise(prefixes(texts, heavy.view(_U)).join(copies, "id", "left_anti"))
    # dealt out by tile once: counted, and joined with the counts; only rows that can have a partner on their tile stay. The
    # condition on them is written so that Spark derives no filter from it, which would deal the tiles out a second time.
    tiles = (reps.select("id", "n", F.posexplode("keys").alias("place", "key"))
             .select("id", "n", "key", largest_partner(F.col("n"), F.col("place")).alias("most")).repartition("key"))
    smaller = F.col("most") >= F.col("n")
    several = tiles.groupBy("key").agg(
        F.count(F.lit(1)).alias("m"), F.min("id").alias("least"), F.max("id").alias("last"), F.min(F.when(smaller, F.col("n"))).alias("least_n"),
        F.min(F.when(smaller, F.col("id"))).alias("head"), F.min_by("n", F.when(smaller, F.col("id"))).alias("head_n"),
        F.min_by("most", F.when(smaller, F.col("id"))).alias("head_most"))
    met_on = materialise(tiles.join(several.where("least < last AND head IS NOT NULL").drop("least", "last").hint("shuffle_hash"), "key")
                         .where(F.coalesce(F.col("least_n") <= F.col("most"), F.lit(False))).drop("least_n"))
    signed = reps.select("id", "n", "bits")

    def with_signatures(pairs: DataFrame) -> DataFrame:
        left = signed.select(F.col("id").alias("a"), F.col("n").alias("n1"), F.col("bits").alias("bits1"))
        right = signed.select(F.col("id").alias("b"), F.col("n").alias("n2"), F.col("bits").alias("bits2"))
        return (pairs.join(left, "a").join(right, "b").where(may_link(F.col("n1"), F.col("bits1"), F.col("n2"), F.col("bits2")))
                .select("a", "b"))
    # pairs that sizes and places do not allow go before any signature is moved
    stars = met_on.where("id <> head AND n <= head_most AND head_n <= most").select(F.col("head").alias("a"), F.col("id").alias("b"))
    first = materialise(with_signatures(stars.distinct()).distinct())
    links = materialise(_verified(first, texts))
    labels = materialise(components(links))
    # tiles on which classes of different groups meet
    member = met_on.where("m > 2").select("key", "id", "n", "most").join(labels.select(F.col("node").alias("id"), "component"), "id", "left").withColumn(
        "component", F.coalesce("component", "id"))
    open_tiles = member.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    open_rows = materialise(member.join(open_tiles, "key", "left_semi"))
    if open_rows.limit(1).count():
        known_pairs = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        second = materialise(_meetings(open_rows, signed).join(known_pairs, ["a", "b"], "left_anti"))
        if second.limit(1).count():
            more = materialise(_verified(second, texts))
            labels = materialise(components(links.unionByName(more)))
    group = labels.select(F.col("node").alias("rep"), "component")
    named = classes.join(group, "rep", "left").select("n", "a", "b", "m", F.coalesce("component", "rep").alias("of_class"))
    known = _with_class(sizes, named).join(group.withColumnRenamed("rep", "id"), "id", "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("of_class", "component", "id").alias("component_id"))
    nameless = docs.where(F.col(doc_id).isNull()).select(F.lit(None).cast("long").alias("id"), F.col(text).alias("text"))
    loose = describe(nameless).where("kind = 0").select(F.lit(None).cast("long").alias("doc_id"), F.col("n").alias("n_shingles"),
                                                        F.lit(None).cast("long").alias("component_id"))
    return known.unionByName(loose)


def one_per_group(docs: DataFrame) -> DataFrame:
    """The rows of `docs` whose doc_id is the least of its group; rows that repeat this doc_id are reduced to one. Documents
    without words and null doc_ids stay."""
    found = groups(docs.select("doc_id", "text"))
    first = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_keep")).distinct()
    kept = docs.join(first, F.col("doc_id") == F.col("_keep"), "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))
