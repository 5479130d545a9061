"""Evaluation instances: their targets, positions and lemmas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from senseloom.operators.text import pieces

# Lemmas a lemmatizer gives for forms whose instances are filed under another lemma.
OTHER_LEMMAS = {
    "stuck": "stick", "swam": "swim", "lain": "lie", "swore": "swear", "lie": "lay", "lay": "lie", "commissions": "commission", "shaving": "shave",
    "observing": "observe", "swimming": "swim", "separating": "separate", "questioning": "question", "waiting": "wait", "happening": "happen",
    "rooting": "root", "sniffing": "sniff", "laying": "lay", "straightened": "straighten", "account": "accounting", "committed": "commit",
    "regained": "regain", "figgere": "figure", "figger": "figure", "lah": "lie",
}
# Forms written for lemmas that have no single piece of their own.
WRITTEN_AS = {"cultivate": "cultivated", "presume": "presumed", "reap": "[MASK]"}
# Words that are their own lemma, and plural acronyms that lose their s.
KEPT_AS_IS = """McGee McGraw McPherson McCartney McCarthy MacDonald PlayStation McKenna McMahon McIntyre McKinley McGrath iOS McCoy McLean McLaren MiG McCormick GmbH PhD
McCain McLaughlin McGuire McDonnell McGregor MHz MacArthur AllMusic YouTube McGill SmackDown McDonald McKenzie MacKenzie McKay McBride""".split()
PLURAL_ACRONYMS = ["DVDs", "MPs", "CDs", "DJs", "RBIs", "NGOs"]
UNLEMMATISED = ["cannot", "gotta", ""]


def lemma_with_exceptions(token: Column, lemma: Column, known: Column) -> Column:
    """Lemma of a vocabulary token from a lemmatizer's ``lemma`` (-PRON- for pronouns): null for special tokens and half words, fixed exceptions,
    the token's capitals restored, and the token itself if the result is not a known token (``known`` is an array of the candidates that are).
    """
    capitals = F.regexp_count(token, F.lit(r"\p{Lu}"))
    cased = F.when(capitals == 0, lemma).when(capitals == 1, F.concat(F.upper(F.substring(lemma, 1, 1)), F.lower(F.substring(lemma, 2, 1 << 20)))).otherwise(F.upper(lemma))
    special = token.startswith("#") | token.startswith("[unused") | token.rlike(r"^\[[A-Z]+\]$")
    return (
        F.when(special, None).when(token.isin(*KEPT_AS_IS), token).when(token.isin(*PLURAL_ACRONYMS), F.substring(token, F.lit(1), F.char_length(token) - 1))
        .when(token.isin(*UNLEMMATISED) | (lemma == "-PRON-"), token).when(F.array_contains(known, cased), cased).otherwise(token)
    )


def written_target(target: Column, lemma: Column, target_is_piece: Column, lower_is_piece: Column) -> Column:
    """The form of a target that is put to a model: itself if it is one piece, else a fixed form, its lower case or its lemma."""
    fixed = F.create_map(*(F.lit(x) for pair in WRITTEN_AS.items() for x in pair))[lemma]
    return F.when(target_is_piece, target).when(fixed.isNotNull(), fixed).when(lower_is_piece, F.lower(target)).otherwise(lemma)


def find_targets(sentences: DataFrame) -> DataFrame:
    """Add ``target``: the place of the target among the sentence's tokens.

    ``sentences`` has file, nth, lemma, sentence and ``lemmas`` (of its tokens). The k-th of equal consecutive sentences takes the k-th token of the lemma,
    or the last if there are fewer; a sentence without any gets null.
    """
    order = Window.partitionBy("file").orderBy("nth")
    other = F.create_map(*(F.lit(x) for pair in OTHER_LEMMAS.items() for x in pair))
    new = (F.lag("sentence").over(order) != F.col("sentence")) | F.lag("sentence").over(order).isNull()
    runs = sentences.withColumn("_run", F.sum(new.cast("int")).over(order)).withColumn("_k", F.row_number().over(Window.partitionBy("file", "_run").orderBy("nth")))
    hits = F.filter(F.transform("lemmas", lambda x, i: F.when((x == F.col("lemma")) | (other[x] == F.col("lemma")), i)), lambda i: i.isNotNull())
    return runs.withColumn("_hits", hits).withColumn("target", F.get("_hits", F.least(F.col("_k"), F.size("_hits")) - 1)).drop("_run", "_k", "_hits")


def index_by_target(paragraphs: DataFrame, lemma_parts: int = 1) -> DataFrame:
    """Global positions from (file_id, nth, length, inst_id, target): (lemma, file_id, pos), the running length before each paragraph plus the target's place."""
    before = F.coalesce(F.sum("length").over(Window.partitionBy("file_id").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return paragraphs.select(F.substring_index("inst_id", ".", lemma_parts).alias("lemma"), "file_id", (before + F.col("target")).cast("long").alias("pos"), "inst_id")


def index_by_occurrence(tokens: DataFrame, instances: DataFrame) -> DataFrame:
    """Position of each instance's target: (inst_id, lemma, file_id, pos) from tokens (file_id, doc_id, pos, token) and instances (inst_id, doc_id, target, which).

    The target is occurrence number ``which`` (from 0) of the token in its document. A target of several pieces is looked up by the first piece of its lemma, the inst_id's first part.
    """
    piece = single_piece(F.col("target"), F.substring_index("inst_id", ".", 1))
    numbered = tokens.withColumn("which", F.row_number().over(Window.partitionBy("file_id", "doc_id", "token").orderBy("pos")).cast("long") - 1)
    return numbered.join(instances.withColumn("token", piece).drop("target"), ["doc_id", "token", "which"]).select("inst_id", F.substring_index("inst_id", ".", 2).alias("lemma"), "file_id", "pos")


def single_piece(target: Column, lemma: Column) -> Column:
    """The piece by which a target is looked up: itself if it is one piece, else the first piece of its lemma."""
    return F.when(F.size(pieces(target)) == 1, F.lower(target)).otherwise(F.get(pieces(lemma), F.lit(0)))


def require_single_pieces(words: DataFrame) -> DataFrame:
    """``words`` (word) as they are; ValueError if one of them is not a single piece."""
    split = words.where(F.size(pieces(F.col("word"))) != 1).select("word").limit(10).collect()
    if split:
        raise ValueError(f"more or less than one piece: {', '.join(sorted(str(r['word']) for r in split))}")
    return words


def merge(one: DataFrame, other: DataFrame) -> DataFrame:
    """Two sets of instances as one; columns that one of them lacks are null there, and instances in both (of one inst_id) are taken from the first."""
    return one.unionByName(other.join(one.select("inst_id").distinct(), "inst_id", "left_anti"), allowMissingColumns=True)


def with_documents(instances: DataFrame, positions: DataFrame) -> DataFrame:
    """Instances (inst_id) with the file that each is in; ``positions`` has inst_id and file_id. An instance has one document: others are an error."""
    found = positions.groupBy("inst_id").agg(F.countDistinct("file_id").alias("_n"), F.min("file_id").alias("file_id"))
    one = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("instance of several documents: "), "inst_id"))).otherwise(F.col("file_id"))
    return instances.join(found.select("inst_id", one.alias("file_id")), "inst_id")


def distinct_words(df: DataFrame, *columns: str) -> DataFrame:
    """The words of several columns (arrays of words), each once: (word)."""
    return df.select(F.explode(F.array_distinct(F.concat(*(F.coalesce(c, F.array().cast("array<string>")) for c in columns)))).alias("word")).where("word IS NOT NULL").distinct()


def target_substitutes(replacements: DataFrame, targets: DataFrame, kept: int = 100) -> DataFrame:
    """Substitutes at target positions only, identity included: (inst_id, reps)."""
    return replacements.join(targets, ["file_id", "pos"]).select("inst_id", F.slice("reps", 1, kept).alias("reps"))
