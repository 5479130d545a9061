import numpy as np
import pytest
from pyspark.sql import functions as F

from senseloom.functions.arrays import greedy_packs
from senseloom.operators import evaluation, graph, index, instances, itemsets, link, senses, substitutes, text, vectors


def rows(df, *columns):
    return sorted(tuple(r[c] for c in (columns or df.columns)) for r in df.collect())


C9 = [(1, ["10", "11", "12"]), (2, ["11", "10"]), (3, ["12", "13"]), (4, ["20", "21"])]


@pytest.fixture
def c9(spark):
    return spark.createDataFrame([("w", i, 0, r) for i, r in C9], "lemma string, file_id long, pos long, reps array<string>")


def test_pieces_and_neighbours(spark):
    docs = spark.createDataFrame([(1, "Wonderfully odd"), (2, None), (3, "")], "doc_id long, text string")
    found = text.tokens(docs).orderBy("pos").collect()
    assert [(r.token, r.is_half, r.prev, r.next) for r in found] == [("wonderfu", False, None, "##lly"), ("##lly", True, "wonderfu", "odd"), ("odd", False, "##lly", None)]


def test_index_skips_half_words_and_uses_lemmas(spark):
    tokens = [("f", 0, "play", None, "##ing"), ("f", 1, "##ing", "play", "ball"), ("f", 2, "ball", "##ing", "balls"), ("f", 3, "balls", "ball", "the"), ("f", 4, "the", "balls", None)]
    frame = spark.createDataFrame(tokens, "file_id string, pos long, token string, prev string, next string")
    found = index.inverted_index(frame, text.vocabulary(frame))
    assert rows(found, "lemma", "file_id", "pos") == [("ball", "f", 2), ("ball", "f", 3)]
    assert rows(index.instances(found), "lemma", "file_id", "pos") == [("ball", "f", 2)]
    assert index.instances(found, 0).count() == 0 and index.instances(found, -1).count() == 1
    assert index.look_up(found, ["ball"]).count() == 2
    with pytest.raises(ValueError, match="bat"):
        index.look_up(found, ["ball", "bat"])


def test_substitutes_drop_identity_and_renormalise(spark):
    vocab = spark.createDataFrame([(t, t) for t in "vw wx xy yz".split()], "token string, lemma string")
    there = spark.createDataFrame([("xy", 1, 0, "xy"), ("zz", 2, 0, "zz")], "lemma string, file_id long, pos long, token string")
    table = spark.createDataFrame([(i, 0, ["vw", "xy", "wx", "yz"], [0.4, 0.3, 0.2, 0.1]) for i in (1, 2)], "file_id long, pos long, reps array<string>, probs array<double>")
    found = substitutes.flat(substitutes.clean(substitutes.from_table(there, table, vocab, 3), 3)).collect()
    got = {i: [(r.token, round(r.prob, 6)) for r in sorted(found, key=lambda r: r["rank"]) if r.file_id == i] for i in (1, 2)}
    assert got == {1: [("vw", 0.571429), ("wx", 0.285714), ("yz", 0.142857)], 2: [("vw", 0.444444), ("xy", 0.333333), ("wx", 0.222222)]}


def test_clean_keeps_the_first_of_each_lemma(spark):
    reps = [("tests", "test", 5), ("the", "the", 4), ("bench", "bench", 3), ("test", "test", 2), ("##x", "##x", 1)]
    frame = spark.createDataFrame([("bench", 1, 0, reps), ("q", 2, 0, [("the", "the", 1)])], "lemma string, file_id long, pos long, reps array<struct<token:string,lemma:string,cnt:long>>")
    assert [(r.file_id, r.reps) for r in substitutes.clean(frame, 5).collect()] == [(1, ["test"])]
    assert [r.reps for r in substitutes.clean(frame, 5, drop_query=False).collect()] == [["test", "bench"]]


@pytest.mark.parametrize(("sizes", "packs"), [([4, 6, 1, 12, 3, 3, 5], [0, 0, 1, 2, 3, 3, 4]), ([0, 0, 11, 0], [0, 0, 1, 2]), ([], [])])
def test_greedy_packs(spark, sizes, packs):
    frame = spark.createDataFrame([(sizes,)], "s array<long>")
    assert frame.select(greedy_packs(F.col("s"), 10).alias("p")).first()["p"] == packs


def test_strip_spans_deletes_one_more_character(spark):
    frame = spark.createDataFrame([("AB (1) cd (2) ef", [(3, 6), (10, 13)])], "t string, s array<struct<start:int,end:int>>")
    assert frame.select(text.strip_spans(F.col("t"), F.col("s")).alias("t")).first()["t"] == "AB cd ef"


def test_sentences(spark):
    docs = spark.createDataFrame([(1, "a bb cc. dd cc. cc\ncc")], "doc_id long, text string")
    found = rows(text.sentences_around(docs, ["cc"]), "paragraph", "pos", "sentence", "local_pos")
    assert found == [(0, 2, "a bb cc .", 2), (0, 5, "dd cc .", 1), (0, 7, "cc", 0), (1, 0, "cc", 0)]
    assert rows(text.sentences_around(docs, ["dd"], None), "sentence") == [("a bb cc . dd cc . cc",)]


def test_detokenise(spark):
    frame = spark.createDataFrame([("He 's here , is n't he ? -LRB- 5 % -RRB-",)], "t string")
    assert frame.select(text.detokenise(F.col("t")).alias("t")).first()["t"] == "He's here, isn't he ? ( 5% )"


def test_edges_components_votes_inventory(spark, c9):
    edges = graph.edges(c9)
    assert rows(edges, "u", "v", "w") == [("10", "11", 2), ("10", "12", 1), ("11", "12", 1), ("12", "13", 1), ("20", "21", 1)]
    found = graph.components(edges)
    assert rows(found, "token", "community") == [("10", 0), ("11", 0), ("12", 0), ("13", 0), ("20", 1), ("21", 1)]
    votes = senses.votes(c9, found)
    assert rows(senses.argmax(votes), "file_id", "community", "votes") == [(1, 0, 3), (2, 0, 2), (3, 0, 2), (4, 1, 2)]
    assert rows(graph.nodes(c9), "token", "cnt") == [("10", 2), ("11", 2), ("12", 2), ("13", 1), ("20", 1), ("21", 1)]
    assert {r.sense_id for r in senses.inventory(c9, found, 1).collect()} == {0}
    assert senses.inventory(c9, found).count() == 0


def test_ties_go_to_the_community_met_first(spark):
    votes = spark.createDataFrame([("w", 1, 0, 1, 1, 2), ("w", 1, 0, 2, 1, 1)], "lemma string, file_id long, pos long, community long, votes long, first_rank long")
    assert senses.argmax(votes).first().community == 2


def test_assignment(spark):
    inventory = spark.createDataFrame([("word", 0, i + 1, t, 9) for i, t in enumerate(["10", "11", "12", "13"])] + [("word", 1, i + 1, t, 9) for i, t in enumerate(["20", "21"])], "lemma string, sense_id long, rank long, token string, cnt long")
    near = spark.createDataFrame([("word", i, 0, r) for i, r in enumerate([["11", "13", "99"], ["20", "10"], ["99"]])], "lemma string, file_id long, pos long, reps array<string>")
    found = senses.assign(near, inventory)
    assert rows(found, "file_id", "sense_id", "score") == [(0, 0, 0.4), (1, 1, 1 / 3)]
    tokens = spark.createDataFrame([(i, 0) for i in range(3)], "file_id long, pos long")
    assert rows(senses.aligned(tokens, found), "file_id", "sense_id") == [(0, 0), (1, 1), (2, -1)]
    assert rows(senses.positions_by_sense(found), "file_id", "found") == [(0, "0,0.40"), (1, "0,0.33")]


def test_links_keep_eleven_and_fill_up(spark):
    many = spark.createDataFrame([(f"w{i:02d}", 0, [f"w{i:02d}", "shared" if i < 3 else f"x{i}"]) for i in range(14)], "lemma string, sense_id long, tokens array<string>")
    found = link.closest(many).where("sense = 'w00_0'").orderBy("rank").collect()
    assert len(found) == 11
    assert [r.neighbour for r in found[:4]] == ["w02_0", "w01_0", "w13_0", "w12_0"]
    start = spark.createDataFrame([("w00_0",)], "sense string")
    assert rows(link.expand(link.closest(many), start), "sense", "depth") == [("w00_0", 0), ("w01_0", 1), ("w02_0", 1)]
    chosen = spark.createDataFrame([("a", 0, 1, "x", 1), ("a", 1, 1, "y", 1), ("b", 0, 1, "y", 1)], "lemma string, sense_id long, rank long, token string, cnt long")
    best = link.infer_by_list(chosen, ["a", "b"]).orderBy(F.desc("score")).first()
    assert best.senses == "a_1 b_0"


def two_groups(n, seed=0):
    rng = np.random.default_rng(seed)
    u, v = np.triu_indices(2 * n, 1)
    inside = (u < n) == (v < n)
    keep = rng.random(len(u)) < np.where(inside, 0.9, 0.05)
    return u[keep], v[keep], np.ones(keep.sum())


@pytest.mark.parametrize("refine", [False, True])
def test_louvain_recovers_planted_groups(refine):
    u, v, w = two_groups(12)
    label = graph.louvain_labels(24, u, v, w, refine=refine)
    assert len(set(label[:12])) == len(set(label[12:])) == 1 and label[0] != label[12]
    assert graph.modularity(label, u, v, w) > graph.modularity(np.zeros(24, int), u, v, w)


def test_louvain_does_not_depend_on_partitions(spark, c9):
    edges = graph.edges(c9)
    assert rows(graph.louvain(edges)) == rows(graph.louvain(edges.repartition(1))) == rows(graph.louvain(edges.repartition(7, "u")))
    with pytest.raises(ValueError, match="unknown"):
        graph.louvain(edges, algorithm="other")


def test_itemsets(spark, c9):
    found = rows(itemsets.apriori(c9, 2), "items", "size", "support")
    assert found == [("10", 1, 2), ("10 11", 2, 2), ("11", 1, 2), ("12", 1, 2)]
    assert {("10", "11"): 2}.items() <= {tuple(sorted(r["items"])): r.freq for r in itemsets.fp_growth(c9, 0.5).collect()}.items()


def test_tfidf(spark, c9):
    found = {r.token: r.idf for r in vectors.tfidf(c9).collect()}
    assert found["10"] == pytest.approx(1.5108256237659907) and found["13"] == pytest.approx(1.916290731874155)


def test_merge_close():
    names, kept, home = vectors.merge_close(["w_0", "w_1", "w_2"], np.array([[1, 0], [0.96, 0.28], [0, 1]]))
    assert names == ["w_0", "w_2"] and home == ["w_0", "w_0", "w_2"]
    assert kept[0] == pytest.approx([0.98, 0.14])


def test_average_linkage():
    x = np.array([[1, 0.01 * i] for i in range(5)] + [[0.01 * i, 1] for i in range(5)])
    label = vectors.average_linkage(x, 2)
    assert len(set(label[:5])) == len(set(label[5:])) == 1 and label[0] != label[5]
    assert vectors.average_linkage(x[:1]).tolist() == [0]


def test_small_clusters_merge(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0])] * 3 + [(4, [0.0, 1.0])] * 3 + [(2, [0.1, 1.0])], "c int, v array<double>")
    assert rows(vectors.merge_small_clusters(frame, "c", "v"), "cluster", "merged") == [(0, 0), (2, 1), (4, 1)]


def test_sense_keys(spark):
    frame = spark.createDataFrame([("bass",), ("bass_1",), ("bass_0",), ("_",)], "key string")
    assert [r.key for r in vectors.sense_keys(frame).orderBy("rank").collect()] == ["bass_0", "bass_1", "bass"]


def test_metrics(spark):
    items = spark.createDataFrame(list(zip("aaabbc", [0, 0, 1, 1, 1, 2], strict=True)), "g string, p int")
    cells = evaluation.contingency(items, "g", "p")
    v = evaluation.v_measure(cells).first()
    assert v.v_measure == pytest.approx(0.6853314789615865) and v.homogeneity == pytest.approx(v.completeness)
    f = evaluation.paired_f_score(cells).first()
    assert (f.shared, f.predicted_pairs, f.gold_pairs, f.f_score) == (2, 4, 4, 0.5)
    assert evaluation.b_cubed(cells).first().f_score == pytest.approx(0.7777777777777778)


def test_same_sense_is_strict(spark):
    frame = spark.createDataFrame([(1, 2, 0.5), (2, 2, 0.51), (3, 1, None), (4, 2, None)], "item long, senses long, similarity double")
    assert [r.same for r in frame.select("item", evaluation.same_sense(0.5).alias("same")).orderBy("item").collect()] == [False, True, True, False]


def test_outliers_rank_ties_by_larger_word(spark):
    frame = spark.createDataFrame([("c", "a", False, 1.0), ("c", "b", True, 1.0), ("c", "d", False, 1.0)], "case string, word string, is_outlier boolean, score double")
    assert evaluation.outlier_positions(frame).first().position == 1


def test_tagged_sentences(spark):
    tokens = spark.createDataFrame([(1, i, t) for i, t in enumerate(["un", "##fold", "bass"])], "file_id long, pos long, token string")
    senses_of = spark.createDataFrame([(1, 0, -1), (1, 1, -1), (1, 2, 2)], "file_id long, pos long, sense_id long")
    spans = spark.createDataFrame([(1, 0, 0, 3)], "file_id long, paragraph long, start long, end long")
    assert vectors.tag_sentences(tokens, spans, senses_of).first()["words"] == ["unfold", "bass_2"]


def test_instances(spark):
    sentences = [("f", 0, "run", "s", ["run", "x", "run"]), ("f", 1, "run", "s", ["run", "x", "run"]), ("f", 2, "run", "s", ["run", "x", "run"]), ("f", 3, "lie", "t", ["x", "lay"]), ("f", 4, "go", "u", ["x"])]
    frame = spark.createDataFrame(sentences, "file string, nth long, lemma string, sentence string, lemmas array<string>")
    assert [r.target for r in instances.find_targets(frame).orderBy("nth").collect()] == [0, 2, 2, 1, None]
    paragraphs = spark.createDataFrame([("f", 0, 5, "run.v.1", 2), ("f", 1, 4, "go.v.2", 1)], "file_id string, nth long, length long, inst_id string, target long")
    assert rows(instances.index_by_target(paragraphs), "lemma", "pos") == [("go", 6), ("run", 2)]
    tokens = spark.createDataFrame([("f", 7, i, t) for i, t in enumerate(["bank", "of", "bank"])], "file_id string, doc_id long, pos long, token string")
    wanted = spark.createDataFrame([("bank.n.3", 7, "bank", 1)], "inst_id string, doc_id long, target string, which long")
    assert rows(instances.index_by_occurrence(tokens, wanted), "inst_id", "lemma", "pos") == [("bank.n.3", "bank.n", 2)]


def test_lemma_exceptions(spark):
    cases = [("iOS", "io", []), ("CDs", "cd", []), ("#x", "x", []), ("him", "-PRON-", []), ("Dogs", "dog", ["Dog"]), ("NASAs", "nasa", ["NASA"]), ("dogs", "dog", [])]
    frame = spark.createDataFrame(cases, "t string, l string, k array<string>")
    found = [r.x for r in frame.select(instances.lemma_with_exceptions(F.col("t"), F.col("l"), F.col("k")).alias("x")).collect()]
    assert found == ["iOS", "CD", None, "him", "Dog", "NASA", "dogs"]
