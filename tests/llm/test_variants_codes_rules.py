"""Spelling variants, vector codes and quality rules against plain versions, on odd rows and on empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from senseloom.llm import queries, rules, spelling, veccodes

CLASHES = ["word", "key", "n", "form", "Root", "_source", "kept", "N_Words", "rejected_by", "row", "part", "code", "ERROR"]


def clash(df):
    return df.withColumns({c: F.lit(f"user's {c}") for c in CLASHES if c.lower() not in {x.lower() for x in df.columns}})


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(words):
    n = {w: c for w, c in Counter(w for w in words if w is not None and len(w) >= 7).items() if c >= 2}
    near = {w: [v for v in n if one_edit(v, w)] for w in n}
    best = {w: min(near[w], key=lambda v: (-n[v], v)) for w in n if near[w]}
    form = {w: best[w] if w in best and n[best[w]] >= 10 * n[w] else None for w in n}

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (n[w], len(near[w]), form[w], form[w] and n[form[w]], root(w)) for w in n}


def test_variants_by_all_pairs(spark):
    rng = np.random.default_rng(11)
    words = [None, "", "short", "éêèàçùÿ×÷", "éêèàçù×÷"] * 3
    for base in ("aaaaaaaa", "abababab", "spelling", "crémeuses", "variants"):
        words += [base] * 900
        for _ in range(40):
            w = list(base)
            for _ in range(rng.integers(1, 3)):
                at = rng.integers(len(w))
                kind = rng.integers(3)
                if kind == 0:
                    del w[at]
                elif kind == 1:
                    w.insert(at, rng.choice(list("abcdeé")))
                else:
                    w[at] = rng.choice(list("abcdeé"))
            words += ["".join(w)] * int(rng.choice([1, 2, 3, 9, 30, 95]))
    frame = clash(spark.createDataFrame([(w,) for w in words], "word string").repartition(5))
    found = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in spelling.variants(frame).collect()}
    expected = plain_variants(words)
    assert found == expected
    assert any(v[2] and v[4] != v[2] for v in expected.values())  # a chain of forms
    assert spelling.variants(frame.limit(0)).count() == 0


def test_a_pair_at_distance_one_shares_one_key(spark):
    words = ["aabbaabb"[:n] for n in range(1, 9)] + ["abab", "baba", "aaaa", "aaab", "aab", "bba", "ab", "ba", "abba"]
    vocab = spark.createDataFrame([(w, 2) for w in sorted(set(words))], "word string, n long")
    found = sorted((r["a"], r["b"]) for r in spelling.near_pairs(vocab).collect())
    names = sorted(set(words))
    assert found == [(a, b) for a in names for b in names if a < b and one_edit(a, b)]


def slipped(doc_id, text):
    for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
        w = run.translate(str.maketrans(spelling.CAPITALS, spelling.SMALL))
        h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
        yield w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w


def test_op11_on_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(3)
    made = ["".join(rng.choice(list("abÄé"), 8)) for _ in range(20)]
    rows = [(None, "Überlänge Überlänge ÜBERLÄNGE"), (1, None), (2, ""), (3, " \n "), (4, "Wörterbuch×Wörterbuch ÷"), (-5, "x" * 5000)]
    rows += [(int(i) // 2, " ".join(rng.choice(made, 300))) for i in range(60)]
    clash(spark.createDataFrame(rows, "doc_id long, text string")).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in queries.op11_spelling(spark, str(tmp_path)).collect()}
    assert found == plain_variants([w for i, t in rows for w in slipped(i, t)])
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op11_spelling(spark, f"{tmp_path}/none").count() == 0


def plain_codes(rows):
    kept = [(i, label, [math.floor(4096 * x) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(kept[0][2]) // 8
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, _, v in order[:16]] for p in range(8)]
    far = lambda x, e: sum((a - b) ** 2 for a, b in zip(x, e, strict=True))
    best = lambda x, p: min(range(len(books[p])), key=lambda k: (far(x, books[p][k]), k))
    for _ in range(6):
        for p in range(8):
            groups = {}
            for _, _, v in kept:
                groups.setdefault(best(cut(v, p), p), []).append(cut(v, p))
            books[p] = [[sum(c) // len(c) for c in zip(*groups[k], strict=True)] if k in groups else e for k, e in enumerate(books[p])]
    out = []
    for i, label, v in kept:
        codes = [best(cut(v, p), p) for p in range(8)]
        out.append([i, label, "".join(f"{c:02x}" for c in codes), sum(far(cut(v, p), books[p][c]) for p, c in enumerate(codes))])
    sums = Counter()
    for _, label, _, e in out:
        sums[label] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, sums[label], sha) for i, label, c, e in out), key=str)


def vectors_of(spark, rows, path):
    clash(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)).write.parquet(f"{path}/embeddings.parquet")
    return sorted((tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in queries.op12_veccodes(spark, str(path)).collect()), key=str)


def test_op12_on_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(5)
    f = lambda *s: rng.normal(size=s).astype(np.float32).tolist()
    rows = [(int(i), v, int(i) % 3 if i % 7 else None) for i, v in enumerate(f(120, 16))]
    same = [0.25, -0.25] * 8
    rows += [(1000 + i, same, 1) for i in range(80)] + [(7, f(16), 2), (None, f(16), None), (None, same, 2)]
    rows += [(500, None, 1), (-2, [float("nan"), *f(15)], 1), (-3, [None, *f(15)], 1), (-4, [float("inf"), *f(15)], 1), (-1, [-1e-7] * 16, 0)]
    assert vectors_of(spark, rows, tmp_path / "a") == plain_codes(rows)
    few = rows[:5]
    assert vectors_of(spark, few, tmp_path / "few") == plain_codes(few)
    assert vectors_of(spark, [], tmp_path / "none") == []
    assert vectors_of(spark, [(1, None, 1)], tmp_path / "unusable") == []
    # Uneven lengths are filled up with zeros; absurd components are cut, nothing overflows.
    assert len(vectors_of(spark, [(1, [], 1), (2, [1.0] * 3, 1), (3, [3e38] * 16, 1), (4, [-3e38] * 16, 1)], tmp_path / "uneven")) == 4
    assert [r[1:3] for r in vectors_of(spark, [(1, [], 1), (2, [], 1)], tmp_path / "blank")] == [("00" * 8, 0)] * 2


def test_codebooks_do_not_hang_on_partitions(spark):
    rng = np.random.default_rng(8)
    rows = [(int(i), v, 0) for i, v in enumerate(rng.normal(size=(200, 24)).tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert len({r["codebooks_sha256"] for n in (1, 7) for r in veccodes.compress(frame.repartition(n), entries=5).collect()}) == 1
    with pytest.raises(ValueError):
        veccodes.compress(frame, entries=257)


WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None, "", " \n\t ", "one", "a b c d e f g h i j", "the cat sat on the mat and the dog lay on the rug by the door", "same line here\n" * 12, "same line here \nsame line here\n\n\n \n \nx",
    "SHOUTED WORDS ARE NOT LIKED BY ANYONE AT ALL HERE TODAY", "we *** like ### these $$$ symbols &&& a bit || too <<>> much %%%", "1 2 3 4 5 6 7 8 9 10 11 12 13 14", "wait for it...\nand again…\nand then...\n more words to come here now " + "é" * 30,
    "- one two\n- three four\n- five six\n* seven eight\n• nine ten eleven", "Wörter über\x0bviele\x1cZeilen hinweg und noch\x85mehr 中文字 ohne Ende\r\nneue Zeile", "averyveryverylongword " * 12, "a " * 400, "ab cd ef gh ij " * 3, "ab ab ab cd cd cd ef ef ef gh gh gh",
    " ".join(f"w{i}" for i in range(9000)) + " " + " ".join(f"w{i}" for i in range(1800)),
]


def plain_base(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    places = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), dup, len(places)


def plain_verdict(text):
    n, chars, symbols, dup, rep = plain_base(text)
    words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    trimmed = [x.strip(" \t\n\r\x0b\x0c") for x in lines]
    bad = [
        n < 10, 100 * rep > 20 * n, chars < 2 * n or chars > 12 * n, 10 * symbols > n, 10 * sum(len(x.encode()) for i, x in enumerate(lines) if x in lines[:i]) > 3 * sum(len(x.encode()) for x in lines), 10 * sum(words[i] == words[i - 1] for i in range(1, n)) > 2 * n, 10 * sum(bool(re.search("[A-Za-z\x80-\U0010ffff]", w)) for w in words) < 5 * n,
        10 * sum(len(re.findall("[A-Z]", w)) > 1 and not re.search("[a-z]", w) for w in words) > 3 * n, 10 * sum(x.endswith(("...", "…")) for x in trimmed) > 3 * len(lines),
        10 * sum(x.lstrip(" \t\r\x0b\x0c").startswith(("- ", "* ", "• ")) for x in lines) > 9 * len(lines),
    ]
    return not any(bad)


def test_op13_on_odd_rows(spark, tmp_path):
    rows = [*enumerate(TEXTS), (None, TEXTS[5]), (3, TEXTS[5]), (3, TEXTS[5])]
    clash(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op13_rules(spark, str(tmp_path)).collect()
    assert len(found) == len(rows)
    by_id = dict(rows[: len(TEXTS)])
    for r in found:
        text = TEXTS[5] if r["doc_id"] is None or r["doc_id"] == 3 and r["n_words"] > 1 else by_id[r["doc_id"]]
        base = plain_base(text)
        assert tuple(r[m] for m in rules.MEASURES) == base
        assert r["base_failed"] == (base[0] < 10 or 100 * base[4] > 20 * base[0])
        assert r["kept"] == plain_verdict(text)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op13_rules(spark, f"{tmp_path}/none").count() == 0


def test_the_order_of_rules_changes_work_only(spark):
    frame = clash(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"))
    estimates = rules.estimate(frame)
    assert [e["name"] for e in estimates] == [r.name for r in rules.RULES] and sorted(e["rank"] for e in estimates) == list(range(len(rules.RULES)))
    gain = [e["rejected"] / max(e["seconds"], 1e-9) for e in sorted(estimates, key=lambda e: e["rank"])]
    assert gain == sorted(gain, reverse=True)
    share = {e["name"]: e["rejected"] for e in estimates}
    short = [t for t in TEXTS if len(t or "") <= rules.SAMPLE_CHARS]
    assert share["few_words"] == pytest.approx(sum(plain_base(t)[0] < 10 for t in short) / len(short))
    one = rules.cascade(frame, rules.RULES).collect()
    other = rules.cascade(frame, rules.RULES[::-1]).collect()
    assert [r["kept"] for r in one] == [r["kept"] for r in other] == [plain_verdict(t) for t in TEXTS]
    assert {r["rejected_by"] for r in one} != {r["rejected_by"] for r in other}
    assert one[0]["_source"] == "user's _source" and one[0]["kept"] is not None


def test_repeated_windows_of_many_kinds():
    rng = np.random.default_rng(2)
    for kinds in (2, 50, 1 << 14):
        ids = rng.integers(0, kinds, 400)
        ids = np.concatenate([ids, ids[37:90], rng.integers(0, kinds, 50)])
        windows = Counter(tuple(ids[i : i + 5]) for i in range(len(ids) - 4))
        places = {j for i in range(len(ids) - 4) if windows[tuple(ids[i : i + 5])] > 1 for j in range(i, i + 5)}
        assert rules.repeated_words(ids, kinds) == len(places)
