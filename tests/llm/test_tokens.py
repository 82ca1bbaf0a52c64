"""Encoding, the token store and packing."""

import os
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from lodestream.llm.common import Scratch
from lodestream.llm.packing import best_fit_decreasing, lower_bound, pack
from lodestream.llm.token_store import read_tokens, token_index, write_tokens
from lodestream.llm.tokens import WordEncoder, default_tokenizer

ROWS = [(5, "Hello, world's İstanbul."), (3, None), (4, ""), (4, "twice"), (4, "twice"), (None, "no id"), (9, "word " * 9000)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_tokenizer())


def test_words_encode_as_the_library_does(library):
    rng = random.Random(1)
    letters = "aAbZé́İΣß.,,..'s 're don't!?  \x1c\x85\t\r\n　12٣½漢к\U0001f600<|endoftext|>K"
    ours = WordEncoder(default_tokenizer(), cache_words=200)
    for _ in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def ids_of(library, text, end):
    return [*library.encode(text or "", add_special_tokens=False).ids, end]


def test_store_round_trip(spark, library):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS segment", "'x' AS ids")
    path = Scratch(spark, "t").path("orc")
    write_tokens(df, path)
    stored = sorted((r.ids for r in read_tokens(spark, path).collect()), key=str)
    assert stored == sorted((ids_of(library, t, 2) for _, t in ROWS), key=str)
    index = token_index(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in index] == sorted((d for d, _ in ROWS), key=lambda d: (d is not None, d))
    assert [r.start for r in index] == np.cumsum([0, *(r.n_tokens for r in index)])[:-1].tolist()
    crcs = sorted(zlib.crc32(np.array(ids_of(library, t, 2), "<u4").tobytes()) for _, t in ROWS)
    assert sorted(r.ids_crc32 for r in index) == crcs
    assert read_tokens(spark, path).filter("doc_id = 9").count() == 1


def test_store_has_bloom_filters_and_indexes(spark):
    """A reader of the files is turned away by the Bloom filters alone: the ids asked for lie between the least and the greatest of a group of rows."""
    path, first = Scratch(spark, "t").path("orc"), 1 << 33
    rows = [(first + i * 3, "some words of a text") for i in range(5000)]
    write_tokens(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), path, index_rows=1000)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    orc, sarg = jvm.org.apache.orc, jvm.org.apache.hadoop.hive.ql.io.sarg
    kind = getattr(sarg, "PredicateLeaf$Type").LONG
    columns = spark.sparkContext._gateway.new_array(jvm.java.lang.String, 1)
    columns[0] = "doc_id"

    def read(doc_id):
        n = 0
        for f in os.listdir(path):
            if f.endswith(".orc"):
                reader = orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(f"{path}/{f}"), orc.OrcFile.readerOptions(conf))
                asked = sarg.SearchArgumentFactory.newBuilder().startAnd().equals("doc_id", kind, doc_id).end().build()
                found, batch = reader.rows(reader.options().searchArgument(asked, columns)), reader.getSchema().createRowBatch()
                while found.nextBatch(batch):
                    n += batch.count()
        return n

    there, absent = [read(first + 3 * k) for k in range(10, 4000, 400)], [read(first + 3 * k + 1) for k in range(10, 4000, 100)]
    assert set(there) == {1000}
    assert sum(n == 0 for n in absent) >= 0.9 * len(absent)
    assert read_tokens(spark, path).filter(f"doc_id = {first + 3001}").count() == 0 and read_tokens(spark, path).filter(f"doc_id = {first + 3000}").count() == 1


def test_store_of_nothing(spark):
    path = Scratch(spark, "t").path("orc")
    write_tokens(spark.createDataFrame([], "doc_id long, text string"), path)
    assert token_index(spark, path).count() == 0


def test_bounds_and_fits():
    rng = random.Random(2)
    for _ in range(200):
        capacity = rng.choice([10, 64, 100])
        lengths = np.array(sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 60))), reverse=True))
        bins, room = best_fit_decreasing(lengths, capacity)
        used = np.bincount(bins, lengths)
        assert (used <= capacity).all() and (used + room == capacity).all()
        assert -(-lengths.sum() // capacity) <= lower_bound(lengths, capacity) <= len(room)
    assert lower_bound(np.array([6, 6, 6]), 10) == 3
    assert lower_bound(np.array([], np.int64), 10) == 0


def packed(spark, rows, **options):
    out = pack(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 AS piece", "0 AS grp"), **options).toPandas().sort_values(["sequence_id", "offset"])
    by = out.groupby("sequence_id")
    assert (out["offset"] == by["length"].cumsum() - out["length"]).all()
    assert (by["length"].sum() <= options.get("capacity", 4096)).all()
    return out


def test_pieces(spark, library):
    out = packed(spark, ROWS)
    want = []
    for d, t in ROWS:
        ids = ids_of(library, t, 1)
        want += [(d, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())) for k in range(0, len(ids), 4096)]
    got = [(None if d != d else int(d), *r) for d, *r in out[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_rounds_reach_the_bound(spark):
    table = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"])
    rows = list(zip(table["doc_id"].to_pylist(), table["text"].to_pylist()))
    out = packed(spark, rows, bins_in_group=4)
    assert out["sequence_id"].nunique() <= lower_bound(out["length"].to_numpy(), 4096) + 1


def test_packing_nothing(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_hot_id_is_cut_into_segments(spark):
    """A third of the rows are equal and have no id; no segment holds a third of all rows."""
    df = spark.range(2000).selectExpr("if(id % 3 = 0, null, id) AS doc_id", "if(id % 3 = 0, 'the same words', concat('words ', id)) AS text").repartition(4)
    path, name = Scratch(spark, "t").path("orc"), "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        write_tokens(df, path)
    finally:
        spark.conf.unset(name)
    sizes = [r["count"] for r in read_tokens(spark, path).groupBy("segment").count().collect()]
    assert sum(sizes) == 2000 and max(sizes) < 640
    index = token_index(spark, path).orderBy("start").collect()
    assert [r.start for r in index] == np.cumsum([0, *(r.n_tokens for r in index)])[:-1].tolist()
    assert [r.doc_id for r in index] == sorted((r.doc_id for r in index), key=lambda d: (d is not None, d or 0))


def test_equal_rows_are_packed_in_many_groups(spark):
    df = spark.range(1500).selectExpr("CAST(null AS long) AS doc_id", "repeat('word ', 99) AS text").repartition(4)
    out = pack(df, capacity=400, bins_in_group=8).collect()
    length = out[0].length
    assert len(out) == 1500 and {r.length for r in out} == {length}
    groups, places = {}, {}
    for r in out:
        places.setdefault(r.sequence_id, []).append(r.offset)
        groups[r.sequence_id >> 24] = groups.get(r.sequence_id >> 24, 0) + 1
    assert len(groups) > 20 and max(groups.values()) < 150
    fit = 400 // length
    assert all(sorted(p) == [i * length for i in range(len(p))] for p in places.values())
    assert len(places) == -(-1500 // fit)
