"""Entry points at the smallest scale, against the operators' own results or plain Python."""

import pytest
from pyspark.sql import functions as F

from tallyloom import api
from tallyloom.sources.tables import table

SF = "/root/testdata/sf0.001"


def test_cost_report(spark):
    rows = api.cost_report(spark, SF, "project", "2026-06-01").collect()
    names = [r.group_key for r in rows[:-1]]
    assert rows[-1].group_key == "TOTAL" and names == sorted(names) and rows[-1].calls == sum(r.calls for r in rows[:-1])
    with pytest.raises(ValueError):
        api.cost_report(spark, SF, "raw")


def test_ledger_is_loaded_once(spark):
    raw = table(spark, SF, "usage_rows").select(F.col("raw").alias("line")).where("line is not null")
    new = api.load_ledger(spark, SF, raw)
    loaded = new.count()
    assert loaded <= raw.distinct().count() and new.select("event_id").distinct().count() == loaded
    assert api.load_ledger(spark, SF, raw.limit(0)).count() == 0


def test_cache(spark):
    asked = table(spark, SF, "cache_rows").where("response is not null").select(F.col("key").alias("request"), "model", "prompt")
    old = api.cache_lookup(spark, SF, asked, "2027-06-15 12:00:00", 60)
    assert old.count() == asked.count() and old.where("hit").count() == 0
    assert api.cache_lookup(spark, SF, asked, "2027-06-15 12:00:00", 10**9).where("hit").count() == asked.count()
    kept = table(spark, SF, "cache_rows").count() - api.cache_prune(spark, SF, "2000-01-01", 5).count()
    assert kept == 5


def test_status_and_receipt(spark):
    rows = api.status(spark, SF).collect()
    assert sum(r.chunks for r in rows) == sum(table(spark, SF, t).count() for t in api.COLLECTIONS.values())
    assert all(0 <= r.stale_files <= r.files for r in rows)
    one = table(spark, SF, "rules_chunks", "repo", "path").where("path is not null and repo is not null").orderBy("path").first()
    got = api.receipt(spark, SF, "rules", one.path, one.repo).collect()
    assert [(r.repo, r.path, len(r.receipt)) for r in got] == [(one.repo, one.path, 12)]
    assert api.receipt(spark, SF, "rules", "no/such/file").count() == 0
    with pytest.raises(ValueError):
        api.receipt(spark, SF, "other", "x")


def test_lookup_and_graph(spark):
    asked = table(spark, SF, "code_chunks", "id", "embedding").where("id % 50 = 0")
    rows = api.lookup(spark, SF, asked, "code", k=3).collect()
    by_query = {}
    for r in rows:
        by_query.setdefault(r.query_id, []).append(r)
    assert by_query and all(len(v) == 3 and max(v, key=lambda r: r.similarity).similarity >= 0.999 for v in by_query.values())
    under = api.lookup(spark, SF, asked, "code", k=3, under="lib/").collect()
    assert all(r.path.startswith("lib/") for r in under)
    hits = spark.createDataFrame([(r.query_id, r.id) for r in rows], "query_id long, id long")
    graph = api.code_graph(spark, SF, hits).collect()
    assert {(r.query_id, r.id) for r in graph if r.role == "hit"} == {(r.query_id, r.id) for r in rows}
    assert api.lookup(spark, SF, asked.limit(0)).count() == 0
    with pytest.raises(ValueError):
        api.lookup(spark, SF, asked, k=0)


def test_reindex_of_the_same_corpus_changes_nothing(spark):
    for collection, sha in (("rules", "chunk_sha"), ("code", "chunk_hash")):
        same = table(spark, SF, api.COLLECTIONS[collection], "id", "repo", "path", F.col(sha).alias("chunk_sha"), "repo_commit").where(f"repo is not null and path is not null and {sha} is not null")
        changes = api.reindex(spark, SF, collection, same)
        assert changes.chunks.where("is_new").count() == 0
        assert changes.stats.agg(F.sum("written")).first()[0] == 0
        assert api.reindex(spark, SF, collection, same.limit(0)).stale.where("reason = 'path_gone'").count() == table(spark, SF, api.COLLECTIONS[collection]).count()


def test_identifiers(spark):
    wanted = spark.createDataFrame([("D", 1), ("D", 2), ("ZZ", 1)], "prefix string, request long")
    got = {(r.prefix, r.request): r.ident for r in api.free_ids(spark, SF, wanted).collect()}
    assert len(set(got.values())) == 3
    assert all(r.more >= 0 for r in api.missing_ids(spark, SF).collect())
