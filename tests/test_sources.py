import bz2
import json

from senseloom.sources import readers, writers


def put(path, text):
    path.parent.mkdir(exist_ok=True)
    path.write_text(text)
    return str(path)


def test_wiki_and_cord(spark, tmp_path):
    wiki = put(tmp_path / "w.jsonl", json.dumps({"id": "12:3", "metadata": {"paragraph_": "text"}}) + "\n")
    assert [tuple(r) for r in readers.wiki_jsonl(spark, wiki).collect()] == [("12", "text")]
    cord = put(tmp_path / "c.jsonl", "".join(json.dumps({"text": f"t{i}"}) + "\n" for i in range(5)))
    assert [(r.guid, r.text) for r in readers.cord_jsonl(spark, cord).orderBy("guid").collect()] == [(i, f"t{i}") for i in range(5)]
    body = put(tmp_path / "b.json", json.dumps({"body_text": [{"text": "AB (1) cd", "cite_spans": [{"start": 3, "end": 6, "text": "(1)"}]}, {"text": "x", "cite_spans": []}]}))
    assert [r.text for r in readers.cord_bodies(spark, body).orderBy("section").collect()] == ["AB cd", "x"]
    names = ",".join(f"c{i}" for i in range(16))
    csv = put(tmp_path / "m.csv", names + "\nu1" + "," * 8 + '"An ""abstract"", of\nlines"' + "," * 7 + "a.json; b.json\nu2" + "," * 15 + "\n")
    assert [tuple(r) for r in readers.cord_metadata(spark, csv).collect()] == [("u1", 'An "abstract", of\nlines', "a.json")]


def test_line_numbers_follow_the_file(spark, tmp_path):
    path = put(tmp_path / "n.txt", "".join(f"{i}\n" for i in range(2000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert readers.lines(spark, path).where("line <> cast(value AS bigint)").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_file_selection(spark, tmp_path):
    for name in ("a-1.txt", "a-12.txt", "b-2.txt"):
        put(tmp_path / "in" / name, name)
    rows = spark.read.text(str(tmp_path / "in"))
    assert [r.value for r in readers.select_files(rows, "a", 2, 20).collect()] == ["a-12.txt"]


def test_xml_and_keys(spark, tmp_path):
    x10 = put(tmp_path / "x.xml", "<r><run.v.1><TargetSentence>They ran .</TargetSentence></run.v.1></r>")
    assert [tuple(r) for r in readers.semeval_2010(spark, x10).collect()] == [("run.v.1", "run", "They ran .", 0)]
    key = put(tmp_path / "g.key", "bank.n bank.n.1 s1/2 s2\nbank.n bank.n.2 s1\n")
    gold = readers.gold_key(spark, key)
    assert [r.senses for r in gold.orderBy("inst_id").collect()] == [["s1/2", "s2"], ["s1"]]
    x13 = put(tmp_path / "y.xml", '<r><w><instance id="bank.n.1"><context>a bank or a <h>Bank</h> here</context></instance><instance id="other.n.1"><context>a <h>b</h> c</context></instance></w></r>')
    assert [tuple(r) for r in readers.semeval_2013(spark, x13, gold).collect()] == [("bank.n.1", "a bank or a bank here", "bank", 0)]
    hard = spark.createDataFrame([("bank.n.1", 3)], "inst_id string, label long")
    assert writers.hard_key_lines(hard).first().value == "bank.n bank.n.1 3"
    soft = spark.createDataFrame([("bank.n.1", {0: 5, 1: 2})], "inst_id string, labels map<long,long>")
    assert writers.soft_key_lines(soft).first().value == "bank.n bank.n.1 1/2 0/5"


def test_wic_outliers_vectors(spark, tmp_path):
    data = put(tmp_path / "d.txt", "play\tV\t1-0\tthey play it\tplay now\nrun\tV\t0-1\trun on\tto run\n")
    gold = put(tmp_path / "gold.txt", "T\nF\n")
    assert [(r.word, r.loc1, r.loc2, r.sent2, r.gold) for r in readers.wic(spark, data, gold).orderBy("item").collect()] == [("play", 1, 0, ["play", "now"], True), ("run", 0, 1, ["to", "run"], False)]
    group = put(tmp_path / "animals.txt", "dog\ncat\nmouse\n\nbus\ncar\n")
    assert [tuple(r) for r in readers.outlier_groups(spark, group).collect()] == [("animals", ["dog", "cat"], "mouse", ["bus", "car"])]
    senses = put(tmp_path / "s.txt", "child\tc.1 c.2\nskyscraper\ts.1\nother\to.1\n")
    path = tmp_path / "v.txt.bz2"
    path.write_bytes(bz2.compress(b"4 2\nc.1 1 2\nc.2 3 4\ns.1 5 6\no.1 7 8\n"))
    found = readers.sense_vectors(spark, senses, str(path), ["skyscraper"])
    assert sorted((r.word, r.key, r.vector) for r in found.collect()) == [("children", "c.1", [1, 2]), ("children", "c.2", [3, 4]), ("skyscraper", "s.1", [5, 6]), ("skyscrapers", "s.1", [5, 6])]
    nasari = put(tmp_path / "n.json", json.dumps({"dog": {"id1": {"embs": [1.0, 2.0], "full_lemma": "dog_n"}}}))
    assert [tuple(r) for r in readers.nasari(spark, nasari).collect()] == [("dog", "id1", [1.0, 2.0], "dog_n")]
    said = spark.createDataFrame([(1, False), (0, True)], "item long, same boolean")
    writers.write_predictions(said, str(tmp_path / "out"))
    assert [r.value for r in readers.lines(spark, str(tmp_path / "out")).orderBy("file", "line").collect()] == ["T", "F"]
