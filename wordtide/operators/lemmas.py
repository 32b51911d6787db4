"""Lemmas of tagged tokens by dictionaries given as tables: a word list per part of speech, and verbs that nouns derive from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

# Nouns that are not replaced by the verb they derive from.
KEPT_NOUNS = (
    "opinion luggage tender ignorance subsistence institution population continent tendency division abundance civilisation "
    "building servant letter statement insurance student provision competition standard"
).split()


def dictionary_pos(coarse: Column) -> Column:
    """'NOUN' -> 'n' and so on; null for tags whose words stay as they are."""
    return F.create_map(*(F.lit(x) for pair in text.COARSE.items() for x in pair))[coarse]


def shortest_verbs(derivations: DataFrame, kept: list[str] | None = None) -> DataFrame:
    """(lemma, verb): of a noun's related verbs (lemma, verb) the shortest that is shorter and begins alike, of equal
    length the first; none for nouns that are kept."""
    fits = (F.length("verb") < F.length("lemma")) & (F.substring("verb", 1, 1) == F.substring("lemma", 1, 1)) & ~F.col("lemma").isin(KEPT_NOUNS if kept is None else kept)
    return derivations.where(fits).groupBy("lemma").agg(F.min(F.struct(F.length("verb").alias("n"), "verb")).alias("v")).select("lemma", "v.verb")


def lemmatised(tokens: DataFrame, lemmas: DataFrame, derivations: DataFrame) -> DataFrame:
    """Adds `clean` and `lemma` to tokens with `token` and `coarse` tag.

    lemmas (token, pos, lemma) is a dictionary; a word it lacks is its own lemma, and so is a word without a dictionary
    part of speech. A token without letters has the empty lemma, so that places stay. Null tokens have null lemmas.
    """
    rows = tokens.withColumn("clean", text.respell(text.clean(F.col("token")))).withColumn("_pos", F.when(F.col("clean") != "", dictionary_pos(F.col("coarse"))))
    known = lemmas.groupBy(F.col("token").alias("clean"), F.col("pos").alias("_pos")).agg(F.min("lemma").alias("_lemma"))
    rows = rows.join(known, ["clean", "_pos"], "left").withColumn("_lemma", F.coalesce("_lemma", "clean"))
    verbs = shortest_verbs(derivations).select(F.col("lemma").alias("_lemma"), F.col("verb").alias("_verb"))
    rows = rows.join(verbs, "_lemma", "left")
    lemma = F.when((F.col("_pos") == "n") & F.col("_verb").isNotNull(), F.col("_verb")).otherwise(F.col("_lemma"))
    return rows.select(*(F.col(c) for c in tokens.columns), "clean", lemma.alias("lemma"))
