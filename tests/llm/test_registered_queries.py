"""Every registered query on odd rows and on empty tables: columns, types, rows and the columns that follow from the contract alone."""

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from senseloom.llm import queries

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
DOCS = [
    (1, "one two three four five six seven", "a"), (2, None, "a"), (3, "", None), (4, " \t\n ", "b"), (5, LONG, "b"), (6, LONG + " more", "c"), (7, "Straße 𝔘𝔫𝔦 <|endoftext|> it's 3.5", "c"), (8, "same text again and again", "c"),
    (9, "same text again and again", "c"), (9, "same text again and again", "c"), (None, "no id at all here", "d"), (11, "bad idiot words here", "d"), (12, "password = abcdefghijklmnop and more words", "d"), (None, None, None),
]
VECTORS = [(i, [float((i * j) % 7 - 3) for j in range(1, 9)], i % 3) for i in range(60)] + [(60, None, 1), (61, [0.0] * 8, None), (62, [float("nan")] * 8, 1), (None, [1.0] * 8, 2)]
PAGES = [(i, f"http://h{i % 3}.example/{i}", h) for i, h in enumerate([None, "", "<p>x</p>", "<p>x</p>", "ü" * 5000])]
NAMES = "_source cut score predicted size copies spans fingerprint row part code kept word n root shard slot _bucket length payload rank query_id held".split()
COLUMNS = {
    "op1_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op2_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op3_winnowing": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op4_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op5_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op6_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op7_neighbours": "query_id bigint, rank int, vec_id bigint, score double",
    "op8_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op9_secrets": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op10_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op11_spelling": "word string, form string, root string, n bigint, n_near bigint, form_n bigint",
    "op12_veccodes": "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string",
    "op13_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
}
ROWS = {"op6_warc": len(PAGES), "op12_veccodes": 62}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    tables = {
        "documents": spark.createDataFrame(DOCS, "doc_id long, text string, source string").withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("long")),
        "embeddings": spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>, label int"),
        "pages": spark.createDataFrame(PAGES, "page_id long, url string, html string"),
        "labels": spark.createDataFrame([(i, int(i != 7), int(i == 11)) for i in range(1, 13)] + [(None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int"),
    }
    odd, none = tmp_path_factory.mktemp("odd"), tmp_path_factory.mktemp("none")
    for name, frame in tables.items():
        taken = {c.lower() for c in frame.columns}
        frame = frame.select("*", *(F.lit(f"user's {n}").alias(n) for n in NAMES if n not in taken))
        frame.repartition(3).write.parquet(f"{odd}/{name}.parquet")
        frame.where("false").write.parquet(f"{none}/{name}.parquet")
    return str(odd), str(none)


def test_all_are_described():
    assert set(COLUMNS) == set(queries.QUERIES) and all(f.__doc__ for f in queries.QUERIES.values())


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, folders, name):
    if name == "op5_packing":
        pytest.importorskip("public_tokenizers")
    odd, none = folders
    frame = queries.QUERIES[name](spark, odd)
    kinds = dict(frame.dtypes)
    assert [(c, kinds.get(c)) for c in (x.split()[0] for x in COLUMNS[name].split(", "))] == [tuple(x.split()) for x in COLUMNS[name].split(", ")]
    found = frame.collect()
    empty = queries.QUERIES[name](spark, none)
    assert empty.dtypes == frame.dtypes and empty.count() == 0
    if name not in ("op5_packing", "op7_neighbours", "op11_spelling"):
        assert len(found) == ROWS.get(name, len(DOCS))
    ids = Counter(i for i, _, _ in DOCS)
    texts = {i: t for i, t, _ in DOCS if i is not None}
    if "doc_id" in kinds and name != "op5_packing":
        assert Counter(r["doc_id"] for r in found) == ids
    if "held_out" in kinds:
        folds, held = (3, 1) if name == "op2_quality" else (5, 0)
        assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % folds == held) for r in found)
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    if name == "op8_sharding":
        known = [r for r in found if r["doc_id"] is not None]
        assert all(r["size"] == len((texts[r["doc_id"]] or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode()) for r in known)
        shards = Counter(r["shard"] for r in found)
        assert max(shards.values()) - min(shards.get(s, 0) for s in range(8)) <= 1 and all(r["law"] == "rows" and r["grown_shard"] is None for r in found)
        assert all(sorted(r["slot"] for r in found if r["shard"] == s) == list(range(n)) for s, n in shards.items())
    if name == "op1_mixing":
        assert all(r["taken"] <= 3 * r["size"] and r["taken"] % max(1, r["size"]) == 0 for r in found)
    if name == "op5_packing":
        assert Counter(r["doc_id"] for r in found if r["start"] == 0) == ids
    if name == "op7_neighbours":
        assert {r["query_id"] for r in found} <= {0, 20, 40} and all(r["vec_id"] not in (60, 61, 62) for r in found)
