"""From documents to tokens: word pieces, vocabulary, sentences, packing and clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from senseloom.functions.arrays import greedy_packs, let, pack_starts, packs_of
from senseloom.functions.stopwords import STOP_WORDS

PIECE = 8
#: Positions of a bin in which positions and spans meet.
BIN = 256
WORD_PATTERN = r"\p{L}+"
#: The space characters of Unicode (category Zs), which are no part of a sentence's ends.
SPACES = " \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"

# Literal replacements that undo treebank tokenisation, applied in this order.
DETOKENISE = ((" 's ", "'s "), (" , ", ", "), (" . ", ". "), (" % ", "% "), (" $ ", " $"), (" n't ", "n't "), ("-LRB-", "("), ("-RRB-", ")"), ("   ", " "), ("  ", " "))


def pieces(text: Column, pattern: str = WORD_PATTERN, width: int = PIECE) -> Column:
    """Word pieces of a text in order: words in lower case cut to ``width`` letters, later pieces marked with ##."""
    if pattern == WORD_PATTERN:
        # All in two passes of the text, no work per word: the mark is put in where a word goes on, and as no other ``#`` is left it is found with its piece.
        marked = F.regexp_replace(F.replace(F.lower(text), F.lit("#"), F.lit(" ")), rf"(\p{{L}}{{{width}}})(?=\p{{L}})", "$1##")
        return F.regexp_extract_all(marked, F.lit(rf"(?:##)?\p{{L}}{{1,{width}}}"), 0)
    words = F.regexp_extract_all(F.lower(text), F.lit(pattern), 0)
    cut = lambda w: F.transform(F.regexp_extract_all(w, F.lit(f".{{1,{width}}}"), 0), lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit("##"), p)))
    return F.flatten(F.transform(words, cut))


def raw_pieces(text: Column) -> Column:
    """The same pieces in one pass of the text, unmarked: a word's first piece has the character before the word with it (a space at the text's start), so that a later one begins with a letter. See :func:`marked`."""
    return F.regexp_extract_all(F.concat(F.lit(" "), F.lower(text)), F.lit(rf"\P{{L}}?\p{{L}}{{1,{PIECE}}}"), F.lit(0))


def marked(raw: Column) -> Column:
    """A piece from :func:`raw_pieces` as :func:`pieces` has it. Of ASCII characters the code alone tells whether they are letters, as the text is in lower case."""
    later = F.when(raw < "a", False).when(raw < "{", True).otherwise(raw.rlike(r"^\p{L}"))
    return F.when(later, F.concat(F.lit("##"), raw)).otherwise(F.substring(raw, 2, 1 << 20))


def tokens(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: file_id, pos, token, is_half, and its neighbours prev and next (null at the ends). One projection, no shuffle.

    Pieces are laid beside the shifted lists of their neighbours before they become rows, and are marked after that, where it is no work per element of an array.
    """
    held = docs.select(F.col(id_column).alias("file_id"), raw_pieces(F.col(text)).alias("s"))
    before, after = F.concat(F.array(F.lit(None).cast("string")), "s"), F.slice("s", 2, F.size("s"))
    rows = held.select("file_id", F.posexplode(F.arrays_zip(F.col("s").alias("token"), before.alias("prev"), after.alias("next"))).alias("pos", "t")).where("t.token IS NOT NULL")  # the list before has one more
    cut = rows.select("file_id", F.col("pos").cast("long").alias("pos"), *(marked(F.col(f"t.{c}")).alias(c) for c in ("token", "prev", "next")))
    return cut.select("file_id", "pos", "token", F.col("token").startswith("##").alias("is_half"), "prev", "next")


def is_stop(token: Column) -> Column:
    """Function words and single letters."""
    return token.isin(*STOP_WORDS) | (F.char_length(token) == 1)


def is_valid(token: Column) -> Column:
    """A token that may be a target or a substitute: neither half word nor stop word."""
    return ~token.startswith("##") & ~is_stop(token)


def stem(token: Column) -> Column:
    """What is left of a token without one of the endings ing, ed, s; null without such an ending."""
    return F.when(token.startswith("##"), None).when(token.endswith("ing"), F.regexp_replace(token, "ing$", "")).when(token.endswith("ed"), F.regexp_replace(token, "ed$", "")).when(token.endswith("s"), F.regexp_replace(token, "s$", ""))


def counted_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """token, n: the tokens of all documents; counts are summed before the shuffle."""
    return docs.select(F.explode(raw_pieces(F.col(text))).alias("raw")).select(marked(F.col("raw")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def vocabulary(tokens: DataFrame) -> DataFrame:
    """:func:`vocabulary_of` the tokens' counts, which are summed before the shuffle."""
    return vocabulary_of(tokens.groupBy("token").agg(F.count("*").alias("n")))


def vocabulary_of(counted: DataFrame) -> DataFrame:
    """token, lemma, is_half, is_stop, n from (token, n). A token's lemma is its stem if that is a token too, else itself. The counts are read twice."""
    known = counted.select(F.col("token").alias("lemma"))
    joined = counted.join(known, stem(F.col("token")) == F.col("lemma"), "left")
    return joined.select("token", F.coalesce("lemma", "token").alias("lemma"), F.col("token").startswith("##").alias("is_half"), is_stop(F.col("token")).alias("is_stop"), "n")


def vocabulary_stats(vocab: DataFrame) -> DataFrame:
    """Counts of kinds of tokens and of lemmas that differ from their token."""
    n = lambda when, name: F.count_if(when).alias(name)
    same = F.col("token") == F.col("lemma")
    return vocab.agg(F.count("*").alias("n_tokens"), n(F.col("is_half"), "n_half"), n(F.col("is_stop"), "n_stop"), n(~F.col("is_half") & ~F.col("is_stop"), "n_valid"), n(same, "n_unchanged"), n(~same, "n_changed"))


def annotatable_lemmas(vocab: DataFrame) -> DataFrame:
    """Distinct lemmas that are valid tokens themselves."""
    return vocab.select("lemma").where(is_valid(F.col("lemma"))).distinct()


def paragraphs(docs: DataFrame) -> DataFrame:
    """file_id, paragraph, start, end: the positions [start, end) that each line of a document takes in its token stream.

    A line's pieces are counted without being made; starts are one running sum over a file's lines.
    """
    lines = docs.select(F.col("doc_id").alias("file_id"), F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
    sized = lines.select("file_id", F.col("paragraph").cast("long").alias("paragraph"), F.regexp_count(F.lower("line"), F.lit(rf"\p{{L}}{{1,{PIECE}}}")).cast("long").alias("n"))
    end = F.sum("n").over(Window.partitionBy("file_id").orderBy("paragraph").rowsBetween(Window.unboundedPreceding, 0))
    return sized.withColumn("end", end).select("file_id", "paragraph", (F.col("end") - F.col("n")).alias("start"), "end")


def locate(positions: DataFrame, paragraphs: DataFrame, width: int = BIN) -> DataFrame:
    """Interval join of (file_id, pos) with paragraphs of the same file: adds paragraph and local_pos.

    Positions and spans are cut into bins of ``width`` positions and meet by file and bin, so a position is compared with the spans of its bin alone and a long file is spread over many keys.
    Spans of one file do not overlap, so a bin has at most ``width`` spans that are not empty.
    """
    spans = paragraphs.where(F.col("end") > F.col("start")).select(F.col("file_id").alias("_file"), "paragraph", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))).alias("_bin"))
    inside = (F.col("file_id") == F.col("_file")) & (F.floor(F.col("pos") / width) == F.col("_bin")) & (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("end"))
    return positions.join(spans, inside).select(*positions.columns, "paragraph", (F.col("pos") - F.col("start")).alias("local_pos"))


def sentences_around(docs: DataFrame, words: list[str], stop: str | None = ".") -> DataFrame:
    """The sentence around each occurrence of ``words``: doc_id, paragraph, pos (in the paragraph), sentence and local_pos in it.

    A full stop ends its sentence and belongs to it; without ``stop`` the sentence is the paragraph. Array functions of one row, no shuffle.
    """
    stream = F.regexp_extract_all(F.lower("line"), F.lit(r"\p{L}+|\."), 0)
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "line")).select("doc_id", F.col("paragraph").cast("long").alias("paragraph"), stream.alias("s"))
    ends = F.filter(F.transform("s", lambda t, i: F.when(t == F.lit(stop), i)), lambda i: i.isNotNull()) if stop else F.array().cast("array<int>")
    hits = F.filter(F.transform("s", lambda t, i: F.when(t.isin(*words), i)), lambda i: i.isNotNull())
    found = lines.select("doc_id", "paragraph", "s", ends.alias("ends"), F.explode(hits).alias("pos"))
    before = F.coalesce(F.array_max(F.filter("ends", lambda e: e < F.col("pos"))) + 1, F.lit(0))
    after = F.coalesce(F.array_min(F.filter("ends", lambda e: e >= F.col("pos"))), F.size("s") - 1)
    bounded = found.withColumn("a", before).withColumn("b", after)
    return bounded.select("doc_id", "paragraph", F.col("pos").cast("long").alias("pos"), F.array_join(F.slice("s", F.col("a") + 1, F.col("b") - F.col("a") + 1), " ").alias("sentence"), (F.col("pos") - F.col("a")).cast("long").alias("local_pos"))


def pack_consecutive(rows: DataFrame, keys: list[str], order: str, size: Column, cap: int) -> DataFrame:
    """Number the packs of consecutive rows of each key: (keys, order, size, pack). See :func:`greedy_packs` for the rule."""
    held = rows.select(*keys, F.struct(F.col(order), size.cast("long").alias("size")).alias("item")).groupBy(*keys).agg(F.array_sort(F.collect_list("item")).alias("items"))
    packed = held.select(*keys, F.explode(F.arrays_zip("items", greedy_packs(F.col("items.size"), cap).alias("packs"))).alias("x"))
    return packed.select(*keys, F.col(f"x.items.{order}").alias(order), F.col("x.items.size").alias("size"), F.col("x.packs").cast("long").alias("pack"))


def split_sentences(text: Column) -> Column:
    """Rule-based sentences: a text is cut at white space after . ! or ?"""
    return F.filter(F.transform(F.split(F.regexp_replace(text, r"([.!?])[ \t]+", "$1\u0001"), "\u0001"), lambda s: F.trim(s, F.lit(SPACES))), lambda s: s != "")


def pack_sentences(docs: DataFrame, cap: int = 512) -> DataFrame:
    """Pack sentences of each section (line) of a document up to ``cap`` words, joined with a space: doc_id, section, offset, text. All in one row's arrays."""
    sections = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("section", "line")).select("doc_id", F.col("section").cast("long").alias("section"), split_sentences(F.col("line")).alias("sents"))
    packs = let(pack_starts(F.transform("sents", lambda s: F.size(F.split(s, " ")).cast("long")), cap), lambda starts: packs_of(F.col("sents"), starts))
    texts = F.transform(packs, lambda p, i: F.struct(i.cast("long").alias("offset"), F.array_join(p, " ").alias("text")))
    return sections.select("doc_id", "section", F.explode(texts).alias("p")).select("doc_id", "section", "p.offset", "p.text")


def detokenise(text: Column) -> Column:
    for old, new in DETOKENISE:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def strip_spans(text: Column, spans: Column) -> Column:
    """Delete spans (array of struct start, end) and the one character after each, from the last to the first."""
    return F.aggregate(F.reverse(spans), text, lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"]), F.substring(t, s["end"] + 2, F.char_length(t))))


def word_spans(text: Column, words: list[str]) -> Column:
    """Spans of the space-separated words of a text that are among ``words``."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(state: Column, word: Column) -> Column:
        end = state["at"] + F.char_length(word)
        return F.struct((end + 1).alias("at"), F.when(word.isin(*words), F.concat(state["spans"], F.array(F.struct(state["at"].alias("start"), end.alias("end"))))).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(F.split(text, " "), start, step, lambda s: s["spans"])


def first_rows(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each key."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_nth") <= n).drop("_nth")
