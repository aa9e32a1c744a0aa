"""Sharding: bijection, law of rows, independence of the partitioning, odd inputs."""

import pytest
from pyspark.sql import functions as F

from rewardloom.llm import queries, shards


@pytest.mark.parametrize("total", [1, 3, 7, 4097])
def test_permutation_is_a_bijection(spark, total):
    p, other = shards.permutation_of(spark, total), shards.permutation_of(spark, total, seed=12)
    rows = spark.range(total).withColumn("at", p.apply(F.col("id"))).withColumn("other", other.apply(F.col("id")))
    rows = rows.withColumn("back", p.apply(F.col("at"), back=True)).collect()
    assert sorted(r["at"] for r in rows) == sorted(r.other for r in rows) == list(range(total))
    assert all(r.back == r.id for r in rows)
    assert total < 40 or sum(r["at"] == r.other for r in rows) < total / 20


def placed(frame, **options):
    return shards.sharded(frame, **options).collect()


def check_law(rows, count):
    by = {}
    for r in rows:
        by.setdefault(r.place["shard"], []).append(r.place["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = [len(by.get(n, [])) for n in range(count)]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1


def test_places_do_not_depend_on_partitions(spark, root):
    docs = queries.table(spark, root, "documents").select("doc_id", "text")
    rows = placed(docs)
    one = {(r.doc_id, r.place) for r in rows}
    many = {(r.doc_id, r.place) for r in placed(docs.repartition(13).orderBy(F.desc("text")))}
    assert one == many and len({p["position"] for _, p in one}) == len(one)
    check_law(rows, 40)
    numbers = sorted((r.doc_id, r.place["row_number"]) for r in rows)
    assert [n for _, n in numbers] == list(range(len(numbers)))


def test_rows_are_found_from_shard_and_slot(spark, root):
    rows = shards.sharded(queries.table(spark, root, "documents").select("doc_id"), shards=7, seed=3)
    total = rows.count()
    p = shards.permutation_of(spark, total, seed=3)
    places = rows.select("place.shard", "place.slot", F.col("place.row_number").alias("want"))
    assert shards.rows_at(places, p, 7).filter("row_number <> want").count() == 0
    beyond = spark.createDataFrame([(0, total), (9, 0), (-1, 0)], "shard long, slot long")
    assert [r.row_number for r in shards.rows_at(beyond, p, 7).collect()] == [None] * 3


def test_odd_inputs(spark, tmp_path):
    long = "word " * 300000
    rows = [(None, None, 1, 1, {"a": 1})] * 3 + [(5, "same", 1, 1, {})] * 50 + [(6, "", 1, 1, None), (7, long, 1, 1, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, row int, position int, place map<string,int>")
    got = placed(frame.drop("place"), shards=4)
    assert len(got) == len(rows) and got[0]["position"] == 1 and got[0]["row"] == 1
    check_law(got, 4)
    assert sorted((str(r.doc_id), r.text) for r in got if r.text) == sorted((str(r[0]), r[1]) for r in rows if r[1])
    check_law(placed(frame, shards=4), 4)  # a column named like the result is replaced
    assert placed(frame.limit(0)) == []
    with pytest.raises(ValueError):
        shards.sharded(frame, shards=0)
    folder = str(tmp_path / "shards")
    shards.write_shards(shards.sharded(frame.drop("place", "position"), shards=4), folder)
    back = spark.read.parquet(folder)
    assert back.count() == len(rows) and set(back.columns) == {"doc_id", "text", "row", "shard", "slot"}


def test_query_states_sizes_and_checksums(spark, root):
    import zlib

    texts = {r.doc_id: r.text or "" for r in queries.table(spark, root, "documents").collect()}
    rows = queries.op11_sharding(spark, root).collect()
    assert {r.doc_id: (r["size"], r.text_crc32, r.law, r.grown_shard) for r in rows} == {
        k: (len(t.encode()) + 16, zlib.crc32(t.encode()), "rows", None) for k, t in texts.items()}
