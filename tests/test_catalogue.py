"""Queries against their SQL in DuckDB, typed and regardless of order; and the plans that scale depends on."""

import contextlib
import io
from pathlib import Path

import pytest

import __spark_entry__ as entry
from senseloom.plans import corpus

duckdb = pytest.importorskip("duckdb")
DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: The rest is compared by the same means in longer runs.
QUICK = [
    "tokens_wordpiece", "vocab_stats", "inverted_index", "index_lookup", "context_fillers", "sampled_instances", "substitutes_clean", "paragraph_of_position", "sentence_around_token", "pack_paragraphs", "pack_sentences", "detokenize",
    "strip_spans", "cooccurrence_edges", "sense_inventory_cc", "assign_senses", "closest_senses", "cosine_pairs", "knn_vectors", "merge_small_clusters", "sense_keys", "outlier_plain", "wic_predict", "v_measure", "paired_fscore", "b_cubed", "gold_crosstab",
]
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
needs_data = pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return connection


@needs_data
@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, duck, name):
    frame = entry.queries()[name](spark, str(DATA))
    columns = sorted(frame.columns)
    relation = duck.sql(entry.oracle_sql()[name])
    assert sorted(relation.columns) == columns
    kinds = dict(zip(relation.columns, map(str, relation.types), strict=True))
    assert {c: TYPES.get(t, t) for c, t in frame.dtypes} == kinds
    place = [relation.columns.index(c) for c in columns]
    assert sorted(repr([r[c] for c in columns]) for r in frame.collect()) == sorted(repr([r[i] for i in place]) for r in relation.fetchall())


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan(frame):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        frame.explain("formatted")
    return out.getvalue()


@needs_data
def test_plans(spark):
    tokens = plan(entry.queries()["tokens_wordpiece"](spark, str(DATA)))
    assert "Exchange" not in tokens and "Python" not in tokens
    held = corpus.Corpus(spark, str(DATA))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan(held.index)
    edges = plan(held.edges)
    assert "ReadSchema: struct<prev:string,next:string,token:string,lemma:string,cnt:bigint,rank:bigint>" in edges  # the stored fillers
    assert "Python" not in edges and "CartesianProduct" not in edges and "NestedLoop" not in edges
