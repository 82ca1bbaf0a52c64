"""Benchmark decontamination by spaced-seed hashing; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import BROADCAST_IDS, Scratch

#: Token offsets that each mask compares; the offsets left out may be substituted.
MASKS = ((0, 1, 4, 6), (0, 2, 3, 7), (0, 1, 3, 8), (0, 2, 5, 6), (0, 1, 2, 5), (0, 4, 5, 7))
SHORT = 8  # items of fewer tokens are looked up whole
BREAKS = r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E\x09-\x0D\x20]+"
BROADCAST_SEEDS = 1_000_000  # seed rows (32 bytes each) up to which the benchmark is broadcast; beyond it the join is shuffled
STRETCH = 4096  # tokens of a document whose hits are verified together


def token_hashes(text: Column) -> Column:
    """64-bit hashes of the lower-case tokens between ASCII punctuation and white space; of a text without any, one of the empty token."""
    tokens = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), BREAKS, " ")), " ")
    return F.transform(tokens, lambda w: F.xxhash64(w))


def seeds(rows: DataFrame, hashes: str, keep: list[str], masks: Iterable[tuple[int, ...]]) -> DataFrame:
    """A row for each position and mask: ``keep``, at (from 0), seed (null where the mask passes the end)."""
    h, masks = F.col(hashes), list(masks)
    span = 1 + max(m[-1] for m in masks)
    # the end is padded, so that each position has a token or null at every offset
    padded = F.concat(h, F.array_repeat(F.lit(None).cast("long"), span - 1))
    shifted = F.arrays_zip(*(F.slice(padded, o + 1, F.size(h)).alias(f"o{o}") for o in range(span)))
    at = rows.select(*keep, F.posexplode(shifted).alias("at", "t"))
    made = [f"CASE WHEN t.o{m[-1]} IS NOT NULL THEN xxhash64('{'.'.join(map(str, m))}', {', '.join(f't.o{o}' for o in m)}) END" for m in masks]
    return at.select(*keep, "at", F.expr(f"stack({len(made)}, {', '.join(made)}) as (seed)")).filter("seed is not null")


def held(agree: Column, n: Column, share: float, least: int, window: int, in_window: int) -> Column:
    """Whether the flags of an item of ``n`` tokens agree often enough: in all, or within a window."""
    places = F.filter(F.transform(agree, lambda x, i: F.when(x, i)), lambda i: i.isNotNull())
    ahead = F.slice(places, in_window, F.greatest(F.size(places) - (in_window - 1), F.lit(0)))
    close = F.exists(F.arrays_zip(ahead.alias("b"), F.slice(places, 1, F.size(ahead)).alias("a")), lambda x: x["b"] - x["a"] < window)
    return (F.size(places) >= F.greatest(F.ceil(F.lit(share) * n), F.least(n, F.lit(least)))) | close


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", share: float = 0.6, least: int = 7, window: int = 24, in_window: int = 17) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds: doc_id, item_id, n_match, n_words, first_at.

    Documents and items meet where a masked seed agrees: four tokens of a span of six to nine, by six masks, which
    tolerates substituted tokens in the places left out. Each meeting lays the item on the document along
    the seed's diagonal: the pair counts if ``share`` of the item's tokens agree, and ``least`` at least, or ``in_window``
    of ``window`` tokens in a row. Items of fewer than ``least`` + 1 tokens, which the masks cannot carry, are looked up whole at every
    place. n_match: most agreeing tokens of a counting diagonal; first_at:
    the first document token (from 0) of those diagonals that the item may start at.

    The benchmark's seeds are broadcast where their counted number is within a bound and joined by
    shuffle beyond it, where a common seed is split as a skewed join. Hits are verified by stretches of a document, so
    a document with many has no large row. Texts without a token, null ones as well, hold nothing and are held nowhere;
    null ids give no pair; repeated rows give one; empty tables give no rows; other columns
    are not read.
    """
    scratch = Scratch(docs.sparkSession, "decontamination")
    some = F.regexp_replace(F.col("text"), BREAKS, "") != ""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).filter(F.col("item_id").isNotNull() & some)
    items = items.select("item_id", token_hashes(F.col("text")).alias("item")).distinct().withColumn("version", F.xxhash64("item"))
    items = scratch.keep(items.withColumn("n_words", F.size("item")), "items")
    lengths = [r[0] for r in items.filter(F.col("n_words") < SHORT).select("n_words").distinct().collect()]
    whole = [tuple(range(n)) for n in sorted(lengths)]
    known = seeds(items.filter(F.col("n_words") >= SHORT), "item", ["item_id", "version"], MASKS)
    for mask in whole:
        known = known.union(seeds(items.filter(F.col("n_words") == len(mask)), "item", ["item_id", "version"], [mask]))
    known = known.select("seed", "item_id", "version", F.col("at").alias("item_at")).distinct()
    known = scratch.keep(known, "seeds")
    known = F.broadcast(known) if known.count() <= BROADCAST_SEEDS else known
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id is not null and text is not null")
    hashed = rows.select("doc_id", token_hashes(F.col("text")).alias("h"))
    hits = seeds(hashed, "h", ["doc_id"], [*MASKS, *whole]).join(known, "seed").select("doc_id", "item_id", "version", (F.col("at") - F.col("item_at")).alias("start"))
    hits = scratch.keep(hits.distinct(), "hits")
    # the documents with a hit once more, each with its hits: only a hit's stretch of tokens is copied, never the document
    hits = hits.join(items.select("item_id", "version", "n_words"), ["item_id", "version"])
    by_doc = hits.groupBy("doc_id", F.floor(F.col("start") / STRETCH).alias("stretch")).agg(F.collect_list(F.struct("item_id", "version", "start", "n_words")).alias("hits"))
    by_doc = scratch.keep(by_doc, "by-document")
    near = by_doc.select("doc_id").distinct()
    near = F.broadcast(near) if by_doc.count() <= BROADCAST_IDS else near
    found = rows.join(near, "doc_id", "left_semi").select("doc_id", token_hashes(F.col("text")).alias("h")).join(by_doc, "doc_id")
    stretch = F.transform("hits", lambda x: F.struct(x["item_id"].alias("item_id"), x["version"].alias("version"), x["start"].alias("start"), F.slice("h", F.greatest(x["start"], F.lit(0)) + 1, F.greatest(x["n_words"] + F.least(x["start"], F.lit(0)), F.lit(0))).alias("part")))
    laid = found.select("doc_id", F.explode(stretch).alias("x")).select("doc_id", "x.*").join(items, ["item_id", "version"])
    agree = F.zip_with("part", F.slice("item", F.greatest(-F.col("start"), F.lit(0)) + 1, F.size("item")), lambda a, b: F.coalesce(a == b, F.lit(False)))
    laid = laid.select("doc_id", "item_id", "start", agree.alias("agree"), "n_words")
    laid = laid.filter(held(F.col("agree"), F.col("n_words"), share, least, window, in_window)).withColumn("n_match", F.size(F.filter("agree", lambda x: x)))
    return laid.groupBy("doc_id", "item_id").agg(F.max("n_match").cast("long").alias("n_match"), F.max("n_words").cast("long").alias("n_words"), F.min("start").cast("long").alias("first_at"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows of each id that holds an item of the benchmark; rows of a null id stay; columns may have any names."""
    held_ids = Scratch(docs.sparkSession, "contaminated").keep(overlaps(docs, benchmark, id_col, text_col, **options).select("doc_id").distinct(), "ids")
    held_ids = F.broadcast(held_ids) if held_ids.count() <= BROADCAST_IDS else held_ids
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).cast("long").alias("doc_id"))
    return rows.join(held_ids, "doc_id", "left_anti").select("row.*")
