"""The operators' queries on the smallest tables: against SQL where there is some, else for their contract."""

import os
import re
from pathlib import Path

import pytest

from attestor.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def shown(rows, order):
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    got, want = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = shown([tuple(r) for r in got.collect()], [got.columns.index(c) for c in columns])
    assert rows == shown(want.fetchall(), [want.columns.index(c) for c in columns])


CONTRACT = {
    "op3_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op4_minhash_near_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op5_toxicity": "doc_id bigint, held_out boolean, score double, predicted int, n_passages int",
    "op7_substring_dedup": "doc_id bigint, text string, n_removed bigint, changed boolean, removed array<struct<start:int,end:int>>",
    "op9_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op10_packing": "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids_crc32 bigint",
}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_columns_and_rows(spark, name):
    got = queries.QUERIES[name](spark, SF)
    assert ", ".join(f"{c} {t}" for c, t in got.dtypes) == CONTRACT[name]
    ids = {r.doc_id for r in got.select("doc_id").collect()}
    assert ids == {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    if name != "op10_packing":
        assert got.count() == len(ids)


def test_near_copies_against_all_pairs(spark):
    """Links of all pairs of documents of sf0.01, by their full sets: recall and precision are 1."""
    sf = SF.replace("0.001", "0.01")
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in queries.op4_minhash_near_dedup(spark, sf).collect()}
    fold = {c: c + 32 for c in range(65, 91)}
    sets = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        words = re.findall("[^\x20\x09-\x0d]+", (r.text or "").translate(fold))
        sets[r.doc_id] = frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted((i for i in sets if sets[i]), key=lambda i: len(sets[i]))
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if 100 * len(sets[a]) < 75 * len(sets[b]):
                break
            common = len(sets[a] & sets[b])
            if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert got == {i: (find(i), len(sets[i])) for i in sets}
