"""Near-duplicate documents by an inverted join of MinHash signature coordinates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import BROADCAST_IDS, Scratch, giving_back, on_hubs, words
from lodestream.llm.components import components

SIGNED = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("signature", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64())), ("sketch_more", pa.list_(pa.int64()))])
SIGNED_DDL = "doc_id long, text_key long, n_shingles long, set_key binary, signature array<long>, sketch array<long>, sketch_more array<long>"
PLACES = np.arange(64, dtype=np.uint64)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of ``width`` words; of all words if there are fewer."""
    found = words(text)
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    w = min(width, len(h))
    n = len(h) - w + 1
    out = np.full(n, w, np.uint64)
    for j in range(w):
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out += h[j : j + n]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(29)
    return np.unique(out)


class Signer:
    """MinHash coordinates of 64 bits, each mixed with its number so that a value stands for (coordinate, value), and more of 32 bits for the sketch."""

    def __init__(self, coordinates: int, sketched: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.flip = rng.integers(0, 1 << 63, (coordinates, 1), dtype=np.uint64)
        self.times = rng.integers(0, 1 << 63, (coordinates, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.own = rng.integers(0, 1 << 63, coordinates, dtype=np.uint64)
        self.small_flip = rng.integers(0, 1 << 32, (sketched, 1), dtype=np.uint32)
        self.small_times = rng.integers(0, 1 << 31, (sketched, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)

    def sign(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, small = None, None
        for i in range(0, len(shingles), 1024):
            x = shingles[i : i + 1024]
            part = ((x ^ self.flip) * self.times).min(axis=1)
            few = (((x ^ x >> np.uint64(32)).astype(np.uint32) ^ self.small_flip) * self.small_times).min(axis=1)
            low, small = (part, few) if low is None else (np.minimum(low, part), np.minimum(small, few))
        return (low ^ self.own).view(np.int64), sketch_of(small)


def sketch_of(values: np.ndarray) -> np.ndarray:
    """Four bits of each coordinate, as four planes of one bit for each 64 coordinates: equal coordinates have equal bits."""
    bits = (values.reshape(-1, 1, 64) >> np.arange(4, dtype=np.uint32).reshape(1, 4, 1)) & np.uint32(1)
    return (bits.astype(np.uint64) << PLACES).sum(axis=2, dtype=np.uint64).ravel().view(np.int64)


def sketch_matches(a: str, b: str, coordinates: int) -> Column:
    """Coordinates whose four bits agree; at least as many as agree."""
    differ = F.lit(0)
    for k in range(0, coordinates // 16, 4):
        planes = [F.col(a)[k + j].bitwiseXOR(F.col(b)[k + j]) for j in range(4)]
        differ = differ + F.bit_count(planes[0].bitwiseOR(planes[1]).bitwiseOR(planes[2]).bitwiseOR(planes[3]))
    return F.lit(coordinates) - differ


def signatures(rows: DataFrame, width: int, coordinates: int, sketched: int) -> DataFrame:
    """doc_id and text_key as they are, n_shingles, set_key (128-bit hash of the whole set), signature of ``coordinates`` and sketch of twice ``sketched`` more in two parts (all empty for an empty set)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer, half, none = Signer(coordinates, 2 * sketched), sketched // 16, np.empty(0, np.int64)
        for batch in batches:
            counts, keys, signs, sketches = [], [], [], []
            for text in batch.column(2):
                s = shingle_set(text.as_py(), width)
                counts.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                sign, sketch = signer.sign(s) if len(s) else (none, none)
                signs.append(sign)
                sketches.append(sketch)
            lists = [_lists(signs), _lists([x[:half] for x in sketches]), _lists([x[half:] for x in sketches])]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), *lists], schema=SIGNED)

    return rows.select("doc_id", "text_key", "text").mapInArrow(giving_back(sign), SIGNED_DDL)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.empty(0, np.int64)))


def shingle_sets(rows: DataFrame, width: int) -> DataFrame:
    """(node, text) to (node, shingles): the whole set as an array of longs."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [shingle_set(t.as_py(), width).view(np.int64) for t in part.column(1)]
                yield pa.record_batch([part.column(0), _lists(found)], names=["node", "shingles"])

    return rows.select("node", "text").mapInArrow(giving_back(sets), "node long, shingles array<long>")


def live_prefixes(reps: DataFrame, least: int) -> DataFrame:
    """(node, posts, weight) of (node, signature): each document's posts that can be the first of ``least`` common coordinates.

    Values that one document alone holds are dropped from a document's list; two documents with
    ``least`` values in common both hold that many shared ones, and, in the one order of all values
    from rare to frequent, have a common value among all but the last ``least - 1`` of their lists. The
    frequent values beyond are skipped: they are never joined, but probed in the pairs found.
    weight: how often the document's values are held in all; the text that copies derive from has much.
    """
    posts = reps.select("node", F.explode("signature").alias("key"))
    shared = posts.groupBy("key").agg(F.count("*").alias("f")).filter("f > 1")
    mine = posts.join(shared, "key").groupBy("node").agg(F.sort_array(F.collect_set(F.struct("f", "key"))).alias("posts"), F.sum("f").alias("weight"))
    mine = mine.filter(F.size("posts") >= least)
    return mine.select("node", F.slice("posts", F.lit(1), F.size("posts") - (least - 1))["key"].alias("posts"), "weight")


def alike(a: Column | str, b: Column | str, percent: int) -> Column:
    """Whether sets of these sizes can reach the similarity."""
    return F.lit(100) * F.least(a, b) >= F.lit(percent) * F.greatest(a, b)


def linked(docs: DataFrame, id_col: str, text_col: str, percent: int, width: int, coordinates: int, match: int, sketched: int, sketch_match: int, both_match: int) -> DataFrame:
    """A row for each row of ``docs``: doc_id, text_key (a hash of the text), n_shingles, component (a number of its own), component_id."""
    scratch = Scratch(docs.sparkSession, "minhash")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    # the number of a row is written with it, so it is the same in every later read
    signed = scratch.keep(signatures(rows, width, coordinates, sketched).withColumn("node", F.monotonically_increasing_id()), "signed")
    some = signed.filter("n_shingles > 0 and doc_id is not null")
    first = F.min(F.struct("doc_id", "node"))
    classes = scratch.keep(some.groupBy("set_key").agg(first.alias("first")).select("set_key", F.col("first.doc_id").alias("rep"), F.col("first.node").alias("node")), "classes")
    near = lambda ids: F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    prefixes = live_prefixes(some.select("node", "signature").join(near(classes.select("node")), "node", "left_semi"), match)
    prefixes = scratch.keep(prefixes.join(signed.select("node", F.col("n_shingles").alias("n")), "node"), "prefixes")
    posts = prefixes.select("node", "n", "weight", F.explode("posts").alias("key"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Of kept pairs (a, b), those whose signatures match and whose full sets are similar."""
        ends = scratch.keep(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct(), "ends")
        members = scratch.keep(some.select("node", "doc_id", "text_key", "signature").join(near(ends), "node", "left_semi"), "members")
        signs = members.select("node", "signature")
        both = on_hubs(pairs, signs.select(F.col("node").alias("a"), F.col("signature").alias("sig_a")), scratch).join(signs.select(F.col("node").alias("b"), F.col("signature").alias("sig_b")), "b")
        pairs = scratch.keep(both.filter(F.size(F.array_intersect("sig_a", "sig_b")) >= match).select("a", "b"), "matched")
        sets = scratch.keep(shingle_sets(rows.join(near(members.select("node", "doc_id", "text_key")), ["doc_id", "text_key"]), width), "sets")
        if sets.count() > members.count():  # repeated rows
            sets = scratch.keep(sets.dropDuplicates(["node"]), "sets")
        both = on_hubs(pairs, sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), scratch).join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b")
        both = both.withColumn("common", F.size(F.array_intersect("set_a", "set_b")))
        return scratch.keep(both.filter(F.col("common") * 100 >= (F.size("set_a") + F.size("set_b") - F.col("common")) * percent).select("a", "b"), "edges")

    size = F.log("n") * F.lit(2 / np.log(100 / percent))
    sized = posts.select("*", F.explode(F.array(F.struct(F.lit(0).alias("half"), F.floor(size).alias("size")), F.struct(F.lit(1).alias("half"), F.floor(size + 0.5).alias("size")))).alias("s")).select("key", "s.half", "s.size", "node", "n", "weight")
    hub = F.max(F.struct("weight", F.negative("node").alias("first"), "node", "n")).alias("hub")
    hubs = sized.groupBy("key", "half", "size").agg(hub).select("key", "half", "size", F.col("hub.node").alias("a"), F.col("hub.n").alias("n_a"))
    stars = sized.join(hubs, ["key", "half", "size"]).filter((F.col("node") != F.col("a")) & alike("n", "n_a", percent)).select("a", F.col("node").alias("b")).distinct()
    stars = scratch.keep(stars, "stars")
    sketches = signed.select("node", "sketch")
    met = on_hubs(stars, sketches.select(F.col("node").alias("a"), F.col("sketch").alias("sketch_a")), scratch).join(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("sketch_b")), "b")
    edges = confirmed(scratch.keep(met.filter(sketch_matches("sketch_a", "sketch_b", sketched) >= sketch_match).select("a", "b"), "pairs"))
    found = components(edges, scratch)

    here = prefixes.join(found, "node", "left").select("node", "n", "weight", "posts", F.coalesce("component", "node").alias("c"))
    here = scratch.keep(here, "placed")
    keys = here.select("node", "c", F.explode("posts").alias("key"))
    mixed = keys.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high").select("key")
    mixed = scratch.keep(keys.join(mixed, "key").select("key", "node"), "mixed-keys")
    columns = ["node", "n", "weight", "c", "sketch", "sketch_more", "posts"]
    members = here.join(near(mixed.select("node").distinct()), "node", "left_semi").join(signed.select("node", "sketch", "sketch_more"), "node")
    here = scratch.keep(mixed.join(members, "node").select("key", *columns), "mixed")
    other = here.select("key", *(F.col(x).alias(f"{x}_b") for x in columns))
    matches = sketch_matches("sketch", "sketch_b", sketched) + sketch_matches("sketch_more", "sketch_more_b", sketched)
    once = F.array_min(F.array_intersect("posts", "posts_b")) == F.col("key")
    heavier = F.struct("weight", "node") > F.struct("weight_b", "node_b")
    left = here.join(other, "key").filter(heavier & (F.col("c") != F.col("c_b")) & alike("n", "n_b", percent) & (matches >= both_match) & once)
    edges = edges.unionByName(confirmed(scratch.keep(left.select(F.col("node").alias("a"), F.col("node_b").alias("b")), "pairs")))
    found = components(edges, scratch)
    named = scratch.keep(classes.join(found, "node", "left").select(F.coalesce("component", "node").alias("a"), F.col("node").alias("b"), "set_key", "rep"), "named")
    lowest = named.groupBy("a").agg(F.min("rep").alias("component_id"))
    labels = scratch.keep(on_hubs(named, lowest, scratch).select("set_key", F.col("a").alias("component"), "component_id"), "labels-of-sets")
    scratch.release(signed, labels)
    out = signed.select("doc_id", "text_key", "n_shingles", F.when(F.expr("n_shingles > 0 and doc_id is not null"), F.col("set_key")).alias("set_key"), "node").join(labels, "set_key", "left")
    return out.select("doc_id", "text_key", "n_shingles", F.coalesce("component", "node").alias("component"), F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, width: int = 5, coordinates: int = 64, match: int = 33, sketched: int = 256, sketch_match: int = 167, both_match: int = 351
) -> DataFrame:
    """Link documents whose shingle sets have 100 * intersection >= percent * union; doc_id, n_shingles, component_id, kept.

    1. Equal sets fold into one class. 2. Class representatives are posted under each (coordinate,
    value) of their signatures; posts that can matter are selected by ``live_prefixes``. 3. Stars:
    in each posting and class of set sizes (steps of the root of 4/3, and once more by half a step) the
    document of the most weight meets each other one. A pair whose sketches (four bits of each of ``sketched`` coordinates)
    agree in ``sketch_match`` and whose signatures agree in ``match`` coordinates at least is compared on full
    sets; links contract to components. 4. All pairs of a posting that lie in different components meet likewise, once
    each, so no link between components is lost, while a group of thousands of near copies costs a few stars, not all
    pairs. The bounds turn away a pair of the very least
    similarity with a chance of 1.5 (signature), 1.5 and 1.4 (sketches) in a hundred thousand; a pair passes the first and one of the others.

    Null or empty texts and texts of white space have an empty set and link with nothing, nor does a row of a null id. Each
    row is a document of its own: rows of one id and unlike texts may lie in two components, and kept (the row's id is the
    smallest of its component) holds for each such row; equal rows are linked and have equal results. An
    empty table gives no rows; other columns are not read.
    """
    out = linked(docs, id_col, text_col, percent, width, coordinates, match, sketched, sketch_match, both_match)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, width: int = 5, coordinates: int = 64, match: int = 33, sketched: int = 256, sketch_match: int = 167, both_match: int = 351
) -> DataFrame:
    """``docs`` with one row of each component, all columns: the row of the smallest id, of several such the one of the lowest text hash.

    Rows without words and rows of a null id stay, as they link with nothing; repeated rows are one component, so one stays;
    rows of one id whose texts are no near copies stay all. An empty table gives no rows; columns may have any names.
    """
    scratch = Scratch(docs.sparkSession, "near-duplicates")
    out = linked(docs, id_col, text_col, percent, width, coordinates, match, sketched, sketch_match, both_match)
    marks = scratch.keep(out.filter("n_shingles > 0 and doc_id is not null").select("doc_id", "text_key", "component", F.expr("component_id = doc_id").alias("kept")), "marks")
    near = lambda ids: F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    keys = ["doc_id", "text_key"]
    lost = scratch.keep(marks.filter("not kept").select(*keys).distinct(), "lost")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_key"))
    rows = rows.join(near(lost), keys, "left_anti")
    # components with several rows of the smallest id
    again = marks.filter("kept").groupBy("component", "doc_id").agg(F.min("text_key").alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = scratch.keep(again.select("component", "first"), "again")
    if not again.isEmpty():
        of = scratch.keep(marks.filter("kept").join(again, "component").select(*keys, (F.col("text_key") == F.col("first")).alias("stays")).distinct(), "of-again")
        one = rows.join(near(of.filter("stays").select(*keys)), keys, "left_semi").dropDuplicates(keys)
        rows = rows.join(near(of.select(*keys)), keys, "left_anti").unionByName(one)
    return rows.select("row.*")
