"""Spelling variant grouping by a symmetric-delete join.

Every word emits itself and its distinct single deletions. Words that share such a key are at most two edits apart; an equi-join on the keys finds them and the exact
distance decides. Two words at distance one share exactly one key (the shorter word itself, or what is left without the replaced letter), so the join makes every
pair once and nothing has to be made distinct. A key belongs to at most one word for each place and letter of the alphabet: no key is hot, however large the corpus.

Occurrences are counted before they are shuffled. Forms have at least ``ratio`` times their word's occurrences, so a chain of forms is as long as the logarithm of the
largest count, and joining roots with themselves ends in the logarithm of that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from senseloom.llm.common import materialize

#: Letters of a word; only A-Z are lower-cased.
RUN = r"[A-Za-zÀ-ÿ]"
LEAST_LENGTH = 7
LEAST_COUNT = 2
RATIO = 10
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The typing slips that are planted in the words before they are counted: one run in so many loses a code point.
SLIP = 31


def runs(docs: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """Lower-cased maximal runs of letters of at least ``least`` code points: (doc_id, word). Shorter ones are never made. Null texts have none."""
    found = F.regexp_extract_all("text", F.lit(f"{RUN}{{{least},}}"), F.lit(0))
    return docs.select("doc_id", F.explode(found).alias("word")).select("doc_id", F.translate("word", CAPITALS, SMALL).alias("word"))


def slip(doc_id: Column, word: Column, one_in: int = SLIP) -> Column:
    """The word, without one of its code points if the CRC-32 of ``<doc_id>:<word>`` is divisible by ``one_in``. A null id counts as an empty one."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = (h % F.char_length(word)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))).otherwise(word)


def counted(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words of at least so many code points and occurrences; counts are summed before the shuffle."""
    return words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def near_pairs(vocab: DataFrame) -> DataFrame:
    """All pairs of words that differ by one inserted, deleted or replaced code point, once each: (a, an, b, bn) with a < b. ``vocab`` has distinct words and n."""
    word = F.col("word")
    cut = F.transform(F.sequence(F.lit(1), F.char_length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.char_length(word))))
    keys = vocab.where(F.char_length(word) > 0).select("word", "n", F.explode(F.array_distinct(F.concat(F.array(word), cut))).alias("key"))
    a, b = (keys.select("key", word.alias(x), F.col("n").alias(f"{x}n")) for x in "ab")
    return a.join(b, "key").where((F.col("a") < F.col("b")) & (F.levenshtein("a", "b", 1) == 1)).select("a", "an", "b", "bn")


def with_forms(vocab: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Add ``n_near``, ``form`` and ``form_n`` to the words of ``vocab`` (word, n): the near word of largest n, of equal ones the first in code-point order, if its n is
    at least ``ratio`` times the word's; else null."""
    both = F.array(F.struct(F.col("a").alias("word"), F.col("bn").alias("m"), F.col("b").alias("near")), F.struct(F.col("b").alias("word"), F.col("an").alias("m"), F.col("a").alias("near")))
    near = near_pairs(vocab).select(F.explode(both).alias("x")).groupBy("x.word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("x.m")).alias("down"), F.col("x.near").alias("near"))).alias("best"))
    joined = vocab.join(near, "word", "left")
    good = -F.col("best.down") >= ratio * F.col("n")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("best.near")).alias("form"), F.when(good, -F.col("best.down")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: the last word along the forms. The table is joined with itself until no root has a form; each round is stored."""
    chains = materialize(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "chains")
    while True:
        further = chains.select(F.col("word").alias("root"), F.col("root").alias("next"))
        chains = materialize(chains.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "chains")
        if chains.where("moved").isEmpty():
            return chains.select("word", "root")
        chains = chains.select("word", "root")


def variants(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """Group the words of a table (word: one row per occurrence) by spelling: (word, n, n_near, form, form_n, root), one row per word.

    Null words do not count, words of other lengths or counts neither; repeated rows are occurrences; ties of counts go to the first form in code-point order. An empty
    table gives an empty one. Other columns are ignored.
    """
    vocab = materialize(counted(words.where("word IS NOT NULL").select("word"), least_length, least_count), "vocabulary")
    forms = materialize(with_forms(vocab, ratio), "forms")
    return forms.join(roots(forms), "word", "left").withColumn("root", F.coalesce("root", "word"))


def _variants_sql() -> str:
    """CRC-32 is folded over a word's UTF-8 bytes with the table of its reflected polynomial; pairs come from places of deletions, not from keys and distances."""
    step = "CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return rf"""
WITH RECURSIVE steps AS (SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, {step}, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT i, c AS x FROM steps WHERE k = 8),
raw AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]{{7,}}')) AS run FROM documents),
low AS (SELECT doc_id, translate(run, '{CAPITALS}', '{SMALL}') AS w, count(*) AS c FROM raw GROUP BY ALL),
named AS (SELECT row_number() OVER () AS id, w, c, list_concat(list_transform(string_split(doc_id::VARCHAR || ':', ''), lambda y: [ord(y)]),
    list_transform(string_split(w, ''), lambda y: CASE WHEN ord(y) < 128 THEN [ord(y)] ELSE [192 + ord(y) // 64, 128 + ord(y) % 64] END)) AS parts FROM low),
bytes AS (SELECT id, flatten(parts) AS b FROM named),
fold AS (SELECT id, b, 1 AS at, 4294967295::BIGINT AS c FROM bytes UNION ALL SELECT f.id, f.b, f.at + 1, xor(t.x, f.c >> 8) FROM fold f JOIN crc t ON t.i = xor(f.c, f.b[f.at]::BIGINT) % 256 WHERE f.at <= len(f.b)),
hashed AS (SELECT n.w, n.c, xor(f.c, 4294967295) AS h FROM fold f JOIN named n USING (id) WHERE f.at = len(f.b) + 1),
slipped AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, c FROM hashed),
vocab AS (SELECT word, sum(c)::BIGINT AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
dels AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM vocab, range(1, 64) r(i) WHERE i <= length(word)),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM dels a JOIN dels b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, v.word, v.n FROM dels d JOIN vocab v ON d.d = v.word UNION SELECT v.word, d.word, d.n FROM dels d JOIN vocab v ON d.d = v.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS m, min(other) FILTER (m = top) AS other FROM (SELECT *, max(m) OVER (PARTITION BY word) AS top FROM near) GROUP BY word),
forms AS (SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 10 * v.n THEN b.other END AS form, CASE WHEN b.m >= 10 * v.n THEN b.m END AS form_n FROM vocab v LEFT JOIN best b USING (word)),
walk AS (SELECT word, word AS at FROM forms UNION ALL SELECT w.word, f.form FROM walk w JOIN forms f ON f.word = w.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN walk w USING (word) JOIN forms e ON e.word = w.at AND e.form IS NULL"""


VARIANTS_SQL = _variants_sql()
