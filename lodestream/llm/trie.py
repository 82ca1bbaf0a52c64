"""Prefix trie of conversations, built level by level and rolled up from its leaves."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.llm.common import Scratch, giving_back, ship

BLOCK = 4096  # turns of a conversation, and ids of a list, that one row or group stands for
HOT_SHARE = 1000  # groups that hold at least one in so many of a level's conversations are broadcast: there are at most so many of them
EMPTY = hashlib.sha256(b"").hexdigest()
ENDS_DDL = "class long, ends_sha256 string"


def _unsigned_crc(c: Column) -> Column:
    return F.crc32(c.cast("string").cast("binary"))


def numbered_turns(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, part, copies, words, upto, words_upto) of distinct turns (conv_id, turn, digest, words, copies): places in the order (turn, null first; digest) within the conversation.

    Rows are dealt over ranges of (conv_id, turn, digest), so a conversation of any length spreads over several parts; each part numbers its rows, and is told
    what the conversation's parts before it hold.
    """
    order = ["conv_id", F.col("turn").asc_nulls_first(), "digest"]
    ranged = scratch.keep(turns.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranged")
    per = ranged.groupBy("conv_id", "part").agg(F.sum("copies").alias("n"), F.sum(F.col("copies") * F.col("words")).alias("w"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = per.select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w0"))
    here = Window.partitionBy("conv_id", "part").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.withColumn("upto", F.sum("copies").over(here)).withColumn("words_upto", F.sum(F.col("copies") * F.col("words")).over(here))
    return placed.join(bases, ["conv_id", "part"]).select("conv_id", "part", "digest", "words", "copies", (F.col("upto") + F.col("n0")).alias("upto"), (F.col("words_upto") + F.col("w0")).alias("words_upto"))


def rebuild(conversations: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(convs, turns) of the rebuilt conversations.

    convs: conv_id, length, total (words of all turns). turns: conv_id, depth (from 0, the root, which has no turn), digest (sha256 of role and text), words, upto (words down to that depth).
    Each takes its first h turns from conversation ``conv_id - conv_id % 20``, h = crc32(conv_id) % 4, and goes on after its own first h.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).filter("conv_id is not null")
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    same = rows.select("conv_id", "turn", digest.alias("digest"), words.alias("words")).groupBy("conv_id", "turn", "digest").agg(F.max("words").alias("words"), F.count("*").alias("copies"))
    places = scratch.keep(numbered_turns(same, scratch), "places")
    head = F.greatest(F.lit(0), F.least("copies", F.lit(3) - F.col("upto") + F.col("copies")))  # copies among the first three turns
    heads = places.filter("upto - copies < 3").select("conv_id", "digest", "words", F.explode(F.sequence(F.col("upto") - F.col("copies") + 1, F.col("upto") - F.col("copies") + head)).alias("depth"))
    heads = scratch.keep(heads, "heads")
    own = places.groupBy("conv_id").agg(F.sum("copies").alias("n"), F.sum(F.col("copies") * F.col("words")).alias("w"))
    first = heads.groupBy("conv_id").agg(*(F.sum(F.when(F.col("depth") <= k, F.col("words"))).alias(f"w{k}") for k in (1, 2, 3)), F.count("*").alias("n_head"))
    sizes = scratch.keep(own.join(first, "conv_id"), "sizes")
    head_words = lambda h, prefix="": F.coalesce(F.element_at(F.array(*(F.coalesce(F.col(f"{prefix}w{k}"), F.lit(0)) for k in (1, 2, 3))), F.when(h > 0, h)), F.lit(0))
    donors = sizes.select(F.col("conv_id").alias("donor"), *(F.col(c).alias(f"d_{c}") for c in ("w1", "w2", "w3", "n_head")))
    convs = sizes.withColumn("h", (_unsigned_crc(F.col("conv_id")) % 4).cast("int")).withColumn("donor", F.expr("conv_id - conv_id % 20")).join(donors, "donor", "left")
    convs = convs.withColumn("taken", F.least("h", F.coalesce("d_n_head", F.lit(0))).cast("int")).withColumn("dropped", F.least("h", "n_head").cast("int"))
    convs = convs.withColumn("shift", F.col("taken") - F.col("h")).withColumn("shift_words", head_words(F.col("taken"), "d_") - head_words(F.col("dropped")))
    convs = convs.withColumn("length", F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).withColumn("total", head_words(F.col("taken"), "d_") + F.col("w") - head_words(F.col("dropped")))
    convs = scratch.keep(convs.select("conv_id", "donor", "h", "taken", "shift", "shift_words", "length", "total"), "convs")
    # the turns that are taken over: a donor gives at most three turns to at most twenty conversations
    given = heads.select(F.col("conv_id").alias("donor"), "depth", "digest", "words").join(convs.filter("taken > 0").select("conv_id", "donor", "taken"), "donor").filter("depth <= taken")
    so_far = F.sum("words").over(Window.partitionBy("conv_id").orderBy("depth"))
    given = given.select("conv_id", F.col("depth").cast("long").alias("depth"), "digest", "words", so_far.alias("upto"))
    # the own turns: one row of each conversation and part tells how far they move
    moved = places.select("conv_id", "part").distinct().join(convs.select("conv_id", "h", "shift", "shift_words"), "conv_id")
    kept = places.join(moved, ["conv_id", "part"]).filter("upto > h")
    place = F.explode(F.sequence(F.greatest(F.col("upto") - F.col("copies"), F.col("h").cast("long")) + 1, F.col("upto"))).alias("place")
    kept = kept.select("conv_id", "digest", "words", "upto", "words_upto", "shift", "shift_words", place)
    kept = kept.select("conv_id", (F.col("place") + F.col("shift")).alias("depth"), "digest", "words", (F.col("words_upto") - F.col("words") * (F.col("upto") - F.col("place")) + F.col("shift_words")).alias("upto"))
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.unhex(F.lit("")).alias("digest"), F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("upto"))
    all_turns = root.unionByName(given).unionByName(kept)
    return convs.select("conv_id", "length", "total"), scratch.keep(all_turns.repartitionByRange("depth", F.xxhash64("conv_id")).sortWithinPartitions("depth"), "turns")


def classes_of(convs: DataFrame, turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(classes, members): conversations of the same turns are one class, named by its least conv_id, with m members; members: conv_id, class key.

    A sequence is told by its length and 128 bits that all its turns at their depths add to, so no conversation is gathered in one place.
    """
    prints = [F.bit_xor(F.xxhash64(F.lit(seed), "depth", "digest")).alias(f"p{seed}") for seed in (1, 2)]
    keyed = scratch.keep(turns.groupBy("conv_id").agg(*prints).join(convs, "conv_id"), "keyed")
    classes = keyed.groupBy("p1", "p2", "length").agg(F.min("conv_id").alias("class"), F.count("*").alias("m"), F.max("total").alias("total"))
    return scratch.keep(classes, "classes"), keyed.select("conv_id", "p1", "p2", "length")


def ends_of(classes: DataFrame, members: DataFrame, scratch: Scratch) -> DataFrame:
    """(class, ends_sha256): sha256 of the members' ids in order, joined by commas. Ids are ordered in ranges and joined in blocks; one hash then reads a class's blocks as they come."""
    ship(members.sparkSession)
    key = ["p1", "p2", "length"]
    ranged = scratch.keep(members.repartitionByRange(*key, "conv_id").withColumn("part", F.spark_partition_id()), "members")
    block = F.floor((F.row_number().over(Window.partitionBy(*key, "part").orderBy("conv_id")) - 1) / BLOCK)
    joined = ranged.withColumn("block", block).groupBy(*key, "part", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"), F.min("conv_id").alias("class"))
    blocks = joined.withColumn("only", F.count("*").over(Window.partitionBy(*key)) == 1)
    blocks = scratch.keep(blocks, "blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, sha = None, 0, None
        for batch in batches:
            out: list[tuple[int, str]] = []
            for p1, p2, n, name, ids in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if (p1, p2, n) != now:
                    if sha:
                        out.append((first, sha.hexdigest()))
                    now, first, sha = (p1, p2, n), name, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], names=["class", "ends_sha256"])
        if sha:
            yield pa.record_batch([pa.array([first], pa.int64()), pa.array([sha.hexdigest()], pa.string())], names=["class", "ends_sha256"])

    alone = blocks.filter("only").select("class", F.sha2("ids", 256).alias("ends_sha256"))
    several = blocks.filter("not only").select(*key, "class", "ids", "part", "block").repartition(*key).sortWithinPartitions(*key, "part", "block")
    return alone.unionByName(several.mapInArrow(giving_back(run), ENDS_DDL))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per distinct sequence of first turns of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Level by level, live conversations are grouped by (parent node, next turn) and the least conv_id names the new node; then nodes are joined with
    their parents from the deepest level up. Conversations of the same turns go as one, and one that is alone in its node leaves the loop: the rest of it is a
    chain whose numbers follow from running sums. So the rounds are as many as turns that two different conversations share.

    Turns of equal number are ordered by a hash of role and text, and null numbers come first; null role or text counts as empty; repeated rows are turns of
    their own; rows without a conv_id belong to no conversation and are left out; an empty table gives no rows. Other columns are not read, whatever their names.
    """
    spark = conversations.sparkSession
    scratch = Scratch(spark, "trie")
    convs, turns = rebuild(conversations, scratch)
    classes, members = classes_of(convs, turns, scratch)
    ends = scratch.keep(ends_of(classes, members, scratch), "ends")
    live = classes.select("class", "m", "length", F.lit(None).cast("long").alias("parent"))
    branches, singles, depth = [], [], 0
    while True:
        step = turns.filter(F.col("depth") == depth).select(F.col("conv_id").alias("class"), "digest", "words")
        rows = scratch.keep(live.join(step, "class"), "level")
        n = rows.count()
        if not n:
            break
        at_end = F.min(F.when(F.col("length") == depth, F.col("class"))).alias("end_class")
        groups = rows.groupBy("parent", "digest").agg(F.min("class").alias("node"), F.sum("m").alias("n_convs"), F.count("*").alias("k"), F.max("words").alias("words"), at_end)
        groups = scratch.keep(groups, "groups")
        singles.append(groups.filter("k = 1").select(F.col("node").alias("class"), F.lit(depth).cast("long").alias("depth"), "parent"))
        branches.append(groups.filter("k > 1").select("node", "parent", "n_convs", "words", "end_class"))
        onward = groups.filter("k > 1").select(F.col("parent").alias("p"), F.col("digest").alias("d"), "node", "k")
        on = F.col("parent").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d"))
        hot = F.col("k") * HOT_SHARE >= n
        parts = [rows.join(F.broadcast(onward.filter(hot)), on), rows.join(onward.filter(~hot), on)]
        live = parts[0].unionByName(parts[1]).select("class", "m", "length", F.col("node").alias("parent"))
        depth += 1
    chains = _chains(classes, turns, singles)
    if chains is None:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    chains = scratch.keep(chains, "chains")
    done, below = [], None
    for d in range(depth - 1, -1, -1):
        heads = chains.filter((F.col("depth") == d + 1) & F.col("head")).select("parent_conv_id", "n_leaves", "saved_tokens")
        below = heads if below is None else heads.unionByName(below.select("parent_conv_id", "n_leaves", "saved_tokens"))
        sums = below.groupBy(F.col("parent_conv_id").alias("node")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
        nodes = branches[d].join(sums, "node", "left").select(
            F.col("node").alias("conv_id"), F.lit(d).cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
            F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words") + F.coalesce("below", F.lit(0))).alias("saved_tokens"), "end_class",
        )
        below = scratch.keep(nodes, "nodes")
        done.append(below)
    out = chains.drop("head")
    for nodes in done:
        out = out.unionByName(nodes)
    ended = out.filter("end_class is not null").join(ends, F.col("end_class") == F.col("class")).drop("class", "end_class")
    return out.filter("end_class is null").drop("end_class").withColumn("ends_sha256", F.lit(EMPTY)).unionByName(ended)


def _chains(classes: DataFrame, turns: DataFrame, singles: list[DataFrame]) -> DataFrame | None:
    """Nodes with members of one class alone, from the first such node of each (``head``) to its end."""
    if not singles:
        return None
    alone = singles[0]
    for more in singles[1:]:
        alone = alone.unionByName(more)
    alone = alone.withColumnRenamed("depth", "from").join(classes.select("class", "m", "length", "total"), "class")
    blocks = F.explode(F.sequence(F.floor(F.col("from") / BLOCK), F.floor(F.col("length") / BLOCK))).alias("block")
    alone = alone.select("class", "from", "parent", "m", "length", "total", blocks)
    steps = turns.select(F.col("conv_id").alias("class"), "depth", "words", "upto", F.floor(F.col("depth") / BLOCK).alias("block"))
    head = F.col("depth") == F.col("from")
    rows = steps.join(alone, ["class", "block"]).filter("depth >= from")
    return rows.select(
        F.col("class").alias("conv_id"), "depth", F.when(head, F.col("parent")).otherwise(F.col("class")).alias("parent_conv_id"), F.col("m").alias("n_convs"), (F.col("depth") < F.col("length")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("m") - 1) * (F.col("total") - F.col("upto") + F.col("words"))).alias("saved_tokens"), F.when(F.col("depth") == F.col("length"), F.col("class")).alias("end_class"), head.alias("head"),
    )
