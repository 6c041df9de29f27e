"""Near-duplicates by 64-bit SimHash with deletion-variant signatures.

A fingerprint is cut into two halves. If two fingerprints differ in two bits at most, one half
differs in one bit at most, so both have that half, or that half with one bit deleted, in common.
Every distinct fingerprint is indexed once per half as it is and once per half and deleted bit; an
equality join finds the pairs and the full distance confirms them. For a deleted bit only rows with
that bit clear meet rows with it set, so equal halves meet once and not 33 times.

Copies share one fingerprint and are one row here, so groups of copies cost nothing. Halves shared
by more than ``CROWD`` different fingerprints are not joined pairwise: their fingerprints look up
every fingerprint in reach instead, a fixed number of exact keys each. Both ways are exact.

``keep_one`` is after texts that share four fifths of their five-word shingles, which no number of
bits tells surely. Fingerprints come first: texts of one fingerprint or of two that are linked are
candidates and are confirmed on their shingles. An exact join finds the rest: shingles are put into one order, rare ones first, and of two
such texts a fixed first part of both must have a shingle in common (prefix filter). All texts of
such a shingle are first compared with one of them; only texts that this left in different groups
are compared pair by pair, so a large group of near copies costs a multiple of its size. Every link
is confirmed on the whole lists; these travel only if their parity sketches, a small part of their
size, leave it possible (bitmap filter), which drops no link.
"""

from __future__ import annotations

import zlib
from itertools import combinations
from typing import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from courtlens.llm.common import bit_map, is_set, merged, sliced, stage, tidy, unstage, words_of
from courtlens.llm.components import components

SHINGLE = 3
SEED = 42
REACH = 2
SEGMENTS = 2
#: Different fingerprints that may share a half before look-ups replace the join.
CROWD = 20_000
#: For ``keep_one``: words of a shingle, and the similarity of linked texts as a fraction.
NEAR_SHINGLE = 5
NEAR = (4, 5)
#: Counters that tell rare shingles from frequent ones, and blocks they are summed in. Shingles that
#: share a counter only change the order, which may be any.
COUNTERS, BLOCKS = 1 << 20, 16
#: Bits of the filter that spares most lists the way to a join.
MARKS = 1 << 25
_PIECE = 1 << 17


def fingerprint(text: str | None) -> int:
    """Bitwise majority of the hashes of all word shingles, as a signed 64-bit number.

    Fewer words than a shingle make one shingle of what there is; no word gives 0.
    """
    words = words_of(text)
    return _majority(_hashes(words, SHINGLE)) if words else 0


def _hashes(words: list[bytes], size: int) -> np.ndarray:
    """Hash of every run of ``size`` words, or of all words if there are fewer."""
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > size:
        ends = ends[size - 1:]
        starts = starts[:len(ends)]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())), dtype=np.uint64, count=len(starts))


def _majority(hashes: np.ndarray) -> int:
    set_bits = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _PIECE):
        part = hashes[at:at + _PIECE].view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(set_bits * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fp) per row; a null text counts as empty; texts are read whole."""
    inner = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = dict(inner.dtypes)["doc_id"]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.int64())], ["doc_id", "fp"])

    return inner.mapInArrow(work, f"doc_id {kind}, fp long")


def _shingles(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, fp, print, shingles) per row: the different hashes, cut to 32 bits, of the runs of
    ``NEAR_SHINGLE`` words, none for a text without a word; ``fp`` is the 64-bit hash of that list
    and ``print`` the fingerprint of the text."""
    inner = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = dict(inner.dtypes)["doc_id"]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            fps, prints, sizes, parts = [], [], [0], [np.zeros(0, np.int32)]
            for text in batch.column("text"):
                words = words_of(text.as_py())
                part = np.unique(_hashes(words, NEAR_SHINGLE).astype(np.uint32).view(np.int32)) if words else parts[0]
                fps.append(xxhash.xxh64_intdigest(part.tobytes(), SEED))
                prints.append(_majority(_hashes(words, SHINGLE)) if words else 0)
                parts.append(part)
                sizes.append(len(part))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(np.concatenate(parts)))
            made = pa.array(np.array(fps, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), made, pa.array(prints, pa.int64()), lists], ["doc_id", "fp", "print", "shingles"])

    return inner.mapInArrow(work, f"doc_id {kind}, fp long, print long, shingles array<int>")


def _only(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows (fp, shingles) whose fp is asked, and a few more: a filter ahead of a join."""
    bits = rows.sparkSession.sparkContext.broadcast(bit_map(asked, MARKS))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(is_set(bits.value, batch.column("fp").to_numpy(zero_copy_only=False))))

    return rows.select("fp", "shingles").mapInArrow(work, "fp long, shingles array<int>")


def _sketch(shingles: np.ndarray) -> bytes:
    """For each of as many bits as there are shingles, made a power of two: whether an odd number falls to it."""
    width = max(64, 1 << max(0, len(shingles) - 1).bit_length())
    return np.packbits(np.bincount(shingles & (width - 1), minlength=width) & 1, bitorder="little").tobytes()


def _least_apart(a: bytes, b: bytes) -> int:
    """How many shingles at least are in one list only: a bit that differs takes one. The wider sketch is folded."""
    a, b = sorted((a, b), key=len)
    narrow, wide, width = int.from_bytes(a, "little"), int.from_bytes(b, "little"), len(b) * 8
    while width > len(a) * 8:
        width //= 2
        wide = wide >> width ^ wide & (1 << width) - 1
    return (narrow ^ wide).bit_count()


def _sketches(rows: DataFrame) -> DataFrame:
    """(fp, size, sketch) per list."""
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [x.values.to_numpy(zero_copy_only=False) for x in batch.column("shingles")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("fp"), pa.array(map(len, lists), pa.int32()), pa.array(map(_sketch, lists), pa.binary())], ["fp", "size", "sketch"])

    return rows.select("fp", "shingles").mapInArrow(work, "fp long, size int, sketch binary")


def _counters(rows: DataFrame) -> np.ndarray:
    """How many shingles of all rows fall to each counter; one small table whatever the input."""
    width = COUNTERS // BLOCKS

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            values = batch.column("shingles").flatten().to_numpy(zero_copy_only=False)
            made += np.bincount(values & (COUNTERS - 1), minlength=COUNTERS)
        yield pa.RecordBatch.from_pydict({"block": pa.array(range(BLOCKS), pa.int32()), "counts": pa.array(
            [zlib.compress(made[i:i + width].tobytes(), 1) for i in range(0, COUNTERS, width)], pa.binary())})

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = np.zeros(width, np.int64)
        for batch in batches:
            for raw in batch.column("counts").to_pylist():
                made += np.frombuffer(zlib.decompress(raw), np.int64)
        yield pa.RecordBatch.from_pydict({"block": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([made.tobytes()], pa.binary())})

    kind = "block int, counts binary"
    with tidy(rows.sparkSession):
        parts = rows.select("shingles").mapInArrow(count, kind).groupBy("block").applyInArrow(add, kind).collect()
    out = np.zeros(COUNTERS, np.int64)
    for r in parts:
        out[r["block"] * width:(r["block"] + 1) * width] = np.frombuffer(r["counts"], np.int64)
    return out


def _prefixes(rows: DataFrame) -> DataFrame:
    """(fp, size, prefix) per different list: its size and as many of its rarest shingles, in order,
    as it can have before the first one shared with a similar list that is no larger."""
    shared = rows.sparkSession.sparkContext.broadcast(_counters(rows))
    over, under = NEAR

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            fps, parts = batch.column("fp"), []
            sizes = []
            for values in batch.column("shingles"):
                values = values.values.to_numpy(zero_copy_only=False)
                least = -(-len(values) * over // under)
                order = np.lexsort((values, counts[values & (COUNTERS - 1)]))
                parts.append(values[order[:len(values) - least + 1]])
                sizes.append(len(values))
            yield pa.RecordBatch.from_arrays([fps, pa.array(sizes, pa.int32()), pa.array(parts, pa.list_(pa.int32()))], ["fp", "size", "prefix"])

    made = rows.select("fp", "shingles").mapInArrow(work, "fp long, size int, prefix array<int>")
    return made.dropDuplicates(["fp"])


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _variants(cut: DataFrame) -> DataFrame:
    """(fp, own, whole, key) for each segment as it is (``whole``) and with each of its bits deleted;
    own is the deleted bit. A key is segment, deleted bit (its width: none) and the rest."""
    deleted = cut.select("fp", "side", "width", "part", F.explode(F.sequence(F.lit(0), F.col("width"))).alias("bit"))
    return deleted.select(
        "fp", F.expr("shiftright(part, bit) & 1").alias("own"), (F.col("bit") == F.col("width")).alias("whole"),
        F.expr("shiftleft(CAST(side * 64 + bit AS BIGINT), 32) | IF(bit = width, part, part & ~shiftleft(1L, bit))").alias("key"))


def _cut(fps: DataFrame, segments: int) -> DataFrame:
    """(fp, side, width, part): the segments of each fingerprint, of 32 bits at most."""
    bounds = [64 * i // segments for i in range(segments + 1)]
    parts = [F.struct(F.lit(i).alias("side"), F.lit(b - a).alias("width"),
                      F.shiftrightunsigned("fp", a).bitwiseAND((1 << (b - a)) - 1).alias("part"))
             for i, (a, b) in enumerate(zip(bounds, bounds[1:]))]
    return fps.select("fp", F.explode(F.array(*parts)).alias("s")).select("fp", "s.*")


def _meeting(cut: DataFrame, bits: int) -> DataFrame:
    """(u, v) of fingerprints that share a variant and differ in ``bits`` at most."""
    variants = _variants(cut)
    left = variants.where("whole OR own = 0").select(F.col("fp").alias("u"), "key")
    right = variants.where("whole OR own = 1").select(F.col("fp").alias("v"), "key")
    return left.join(merged(right), "key").where((F.col("u") != F.col("v")) & (_distance("u", "v") <= bits)).select("u", "v")


def links(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(u, v) of different fingerprints of column ``fp`` at distance 1 or 2; a pair may come twice."""
    halves = _cut(fps, SEGMENTS)
    crowded = halves.groupBy("side", "part").count().where(F.col("count") > crowd).select("side", "part")
    crowded = stage(crowded, "crowded")
    if crowded.isEmpty():
        return _meeting(halves, REACH)
    lookups = _look_up(halves.join(crowded, ["side", "part"], "left_semi"), fps)
    return _meeting(halves.join(crowded, ["side", "part"], "left_anti"), REACH).union(lookups)


def _near_prints(rows: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(u, v) of lists whose texts have one fingerprint or linked ones: every list with the first of its
    fingerprint, and the first lists of linked fingerprints. Candidates only, for ``_confirmed``."""
    lists = stage(rows.select("print", "fp").distinct(), "prints")
    firsts = stage(lists.groupBy("print").agg(F.min("fp").alias("first")), "firsts")
    same = lists.join(merged(firsts), "print").where("fp <> first").select(F.col("first").alias("u"), F.col("fp").alias("v"))
    linked = links(firsts.select(F.col("print").alias("fp")), crowd).distinct()
    ends = linked.join(merged(firsts.toDF("u", "a")), "u").join(merged(firsts.toDF("v", "b")), "v").where("a <> b")
    return same.union(ends.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")))


def _shared(placed: DataFrame) -> DataFrame:
    """The rows whose shingle may be in the first parts of several lists: most are in one only and
    need not travel with their places. A map of fixed size lets a few more through."""
    several = placed.groupBy("token").count().where("count > 1").select(F.col("token").cast("long"))
    bits = placed.sparkSession.sparkContext.broadcast(bit_map(several))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column("token").to_numpy(zero_copy_only=False).astype(np.int64)
            yield batch.filter(pa.array(is_set(bits.value, tokens)))

    return placed.select("fp", "size", "at", "token").mapInArrow(work, "fp long, size int, at int, token int")


def _similar(rows: DataFrame) -> DataFrame:
    """(u, v) of lists that share ``NEAR`` of their shingles, enough of them to connect all such lists."""
    every = stage(_prefixes(rows).select("fp", "size", F.posexplode("prefix").alias("at", "token")), "placed")
    placed = stage(_shared(every), "shared")
    unstage(every)
    # Bounds of a shingle are pre-aggregated and joined back: Spark may split the rows of a very common one.
    # The pivot is the text with the fewest rarer shingles: what near copies were made from has none of
    # their edits, so they link to it where they may not link to one another.
    bounds = placed.groupBy("token").agg(F.count("*").alias("n"), F.min(F.struct("at", "fp", "size")).alias("p")).where("n > 1")
    met = stage(placed.join(merged(bounds.select("token", F.col("p.fp").alias("pivot"), "p", (F.col("n") > 2).alias("many"))), "token"), "met")
    unstage(placed)
    star = met.where(F.col("fp") != F.col("pivot")).where(_may_be_similar("p.size", "p.at", "size", "at")).select(
        F.least("fp", "pivot").alias("u"), F.greatest("fp", "pivot").alias("v"))
    first = stage(_confirmed(rows, _near_prints(rows).union(star)), "links")
    # Two texts alone with a shingle have been compared.
    many = met.where("many").select("token", "fp", "size", "at", (F.col("fp") == F.col("pivot")).alias("is_pivot"))
    named = stage(_named(many, components(first).toDF("fp", "root")), "named")
    unstage(met)
    # A pair of different groups has a side that is not of the pivot's group; that side is the left one.
    split = named.groupBy("token").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.max(F.when(F.col("is_pivot"), F.col("root"))).alias("main"))
    open_rows = named.join(merged(split.where("a <> b").select("token", "main")), "token")
    left = open_rows.where("root <> main").select("token", *[F.col(c).alias(f"l_{c}") for c in ("fp", "size", "at", "root")])
    right = open_rows.select("token", "fp", "size", "at", "root", (F.col("root") == F.col("main")).alias("of_main"))
    apart = left.join(merged(right), "token").where((F.col("l_root") != F.col("root")) & (F.col("of_main") | (F.col("l_fp") < F.col("fp"))))
    rest = apart.where(_may_be_similar("l_size", "l_at", "size", "at")).select(
        F.least("l_fp", "fp").alias("u"), F.greatest("l_fp", "fp").alias("v"))
    second = _confirmed(rows, rest)
    unstage(named)
    return first.union(second)


def _named(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows with the root of their fp, which is the fp itself if it has no link. Only rows that
    a map of the linked ones has travel to be looked up."""
    bits = rows.sparkSession.sparkContext.broadcast(bit_map(roots.select("fp"), MARKS))

    @F.pandas_udf("boolean")
    def is_linked(fps: pd.Series) -> pd.Series:
        return pd.Series(is_set(bits.value, fps.to_numpy()))

    linked = is_linked("fp")
    found = rows.where(linked).join(merged(roots), "fp", "left").select(*rows.columns, F.coalesce("root", "fp").alias("root"))
    return rows.where(~linked).withColumn("root", F.col("fp")).unionByName(found)


def _may_be_similar(size: str, at: str, other_size: str, other_at: str) -> Column:
    """Whether lists of these sizes can be similar if the shingle at these places is the first that
    they share: all they share is then in the rests from there on. Similar lists pass at that
    shingle, whatever becomes of their later ones."""
    over, under = NEAR
    a, i, b, j = (F.col(c).cast("long") for c in (size, at, other_size, other_at))
    most = F.least(a - i, b - j)
    return (F.least(a, b) * under >= F.greatest(a, b) * over) & (most * (over + under) >= (a + b) * over)


def _confirmed(rows: DataFrame, met: DataFrame) -> DataFrame:
    """The pairs (u, v) of ``met`` whose lists are similar; a pair may come several times."""
    over, under = NEAR
    candidates = stage(met.select("u", "v").distinct(), "candidates")
    pairs = stage(_possible(rows, candidates), "possible")
    asked = _ends(pairs)
    lists = _only(rows, asked).join(merged(asked), "fp", "left_semi").dropDuplicates(["fp"])
    both = pairs.join(merged(lists.toDF("u", "a")), "u").join(merged(lists.toDF("v", "b")), "v")
    shared = F.size(F.array_intersect("a", "b"))
    return both.where(shared * under >= over * (F.size("a") + F.size("b") - shared)).select("u", "v")


def _possible(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (u, v) but those whose sizes or sketches tell that too few of their shingles are shared."""
    over, under = NEAR
    asked = _ends(pairs)
    sketches = _sketches(_only(rows, asked)).join(merged(asked), "fp", "left_semi").dropDuplicates(["fp"])

    @F.pandas_udf("long")
    def least_apart(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_least_apart(x, y) for x, y in zip(a, b)], dtype="int64")

    both = pairs.join(merged(sketches.toDF("u", "n", "a")), "u").join(merged(sketches.toDF("v", "m", "b")), "v")
    both = both.withColumns({x: F.col(x).cast("long") for x in "nm"}).where(F.least("n", "m") * under >= F.greatest("n", "m") * over)
    return both.where(least_apart("a", "b") * (under + over) <= (F.col("n") + F.col("m")) * (under - over)).select("u", "v")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").alias("fp")).union(pairs.select(F.col("v").alias("fp"))).distinct()


def _masks() -> list[int]:
    """All differences of one or two bits as signed 64-bit numbers."""
    both = [1 << a for a in range(64)] + [1 << a | 1 << b for a, b in combinations(range(64), 2)]
    return [m - (1 << 64) if m >> 63 else m for m in both]


def _look_up(crowd: DataFrame, fps: DataFrame) -> DataFrame:
    """Pairs of crowded fingerprints with any other, by looking up every possible neighbour."""
    masks = F.broadcast(fps.sparkSession.createDataFrame([(_masks(),)], "masks array<long>"))
    asked = crowd.select(F.col("fp").alias("u")).distinct().join(masks).select("u", F.explode("masks").alias("mask"))
    return asked.select("u", F.col("u").bitwiseXOR(F.col("mask")).alias("v")).join(merged(fps.select(F.col("fp").alias("v"))), "v").select("u", "v")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", crowd: int = CROWD) -> DataFrame:
    """(doc_id, fingerprint, component_id, group) per row; group is a fingerprint that names the component.

    Rows whose fingerprints differ in ``REACH`` bits at most are linked; component_id is the smallest
    doc_id reachable. Null and empty texts share fingerprint 0 and are linked like any other. Null
    ids are never the smallest; repeated rows get equal answers; other columns are not read.
    """
    rows = stage(fingerprints(docs, id_column, text_column), "fingerprints")
    classes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    return _grouped(rows, classes, links(classes.select("fp"), crowd))


def _grouped(rows: DataFrame, classes: DataFrame, edges: DataFrame) -> DataFrame:
    roots = components(edges)
    joined = classes.join(merged(roots), classes["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stage(joined.join(merged(smallest), "root").select("fp", "component_id", "root"), "named")
    return rows.join(merged(named), "fp").select("doc_id", _digits("fp").alias("fingerprint"), "component_id", _digits("root").alias("group"))


def _digits(fp: str) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of the smallest id of every group of similar texts, all columns; of a repeated id one row stays.

    Texts are linked if ``NEAR`` of their different runs of ``NEAR_SHINGLE`` words (Jaccard) are
    shared, all such pairs and no others. Texts without a word are copies of one another.
    Rows with a null id give way to any other row of their group; a group without an id keeps the
    row of its smallest text.
    """
    rows = stage(_shingles(docs, id_column, text_column), "shingled")
    classes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    found = stage(_grouped(rows, classes, _similar(rows)), "groups")
    unstage(rows, classes)
    chosen = _kept(docs, found, id_column, text_column)
    nameless = found.where("component_id IS NULL").select(F.col("fingerprint").alias("__fp"), F.col("group").alias("__group")).distinct()
    if nameless.isEmpty():
        return chosen
    rows = docs.where(F.col(id_column).isNull())
    texts = _shingles(rows.select(text_column).distinct(), text_column, text_column).select(
        F.col("doc_id").alias("__text"), _digits("fp").alias("__fp"))
    least = texts.join(merged(nameless), "__fp").groupBy("__group").agg(F.min("__text").alias("__text"))
    return chosen.unionByName(_one_each(rows.join(merged(least), rows[text_column].eqNullSafe(least["__text"]), "left_semi"), text_column, id_column))


def _kept(docs: DataFrame, found: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """One row of every id that is the smallest of its group. Ids that go or come several times are
    put into a map of fixed size; rows that it does not have stay where they are, and only the
    others travel with their texts to be looked up."""
    ids = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.count("*").alias("n"), F.max(F.col("doc_id") == F.col("component_id")).alias("stays"))
    bits = docs.sparkSession.sparkContext.broadcast(bit_map(ids.where("n > 1 OR NOT stays").select(F.xxhash64("doc_id"))))

    @F.pandas_udf("boolean")
    def open_id(hashes: pd.Series) -> pd.Series:
        return pd.Series(is_set(bits.value, hashes.to_numpy()))

    named = docs.where(F.col(id_column).isNotNull())
    is_open = open_id(F.xxhash64(id_column))
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias("__kept")).distinct()
    several = named.where(is_open).join(merged(kept), F.col(id_column) == F.col("__kept"), "left_semi")
    return named.where(~is_open).unionByName(_one_each(several, id_column, text_column))


def _one_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.select("*", place.alias("__place")).where("__place = 1").drop("__place")
