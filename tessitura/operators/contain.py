"""Many texts against many needles: which text contains which needle.

Each needle is looked up by one of its grams (pieces of `gram` characters, or the whole needle if it is
shorter): the one that the fewest texts have. Texts give their different grams; only those that some
needle has are counted, and only those chosen by a needle meet needles, by equality. Each pair met
is then verified. Equal texts and equal needles are one until the end. A gram that very many texts
have is spread over as many salts as it takes for `per_salt` texts each, so neither a frequent gram nor
a repeated text makes one task large.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import fold_key, normalize_name, text
from ..sources.staging import stage

GRAM = 3


def _grams(c: Column, n: int | Column) -> Column:
    """The different pieces of n characters."""
    last = F.length(c) - F.lit(n) + 1
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))
    return F.when(last > 0, F.array_distinct(pieces)).otherwise(F.array().cast("array<string>"))


def contains_join(
    texts: DataFrame, needles: DataFrame, *, text_id: str = "id", text_col: str = "text", needle_id: str = "needle", needle_col: str = "needle",
    fold: Callable[[Column], Column] = fold_key, gram: int = GRAM, per_salt: int = 100_000,
) -> DataFrame:
    """Distinct (text_id, needle_id) pairs where the folded text contains the folded needle, literally.

    A null or blank needle is contained in nothing, a null text contains nothing. Ids may repeat: a pair is in the
    result if any of the texts of an id contains any of the needles of the other."""
    named = texts.select(F.col(text_id).alias("tid"), fold(F.col(text_col)).alias("t")).where("t is not null")
    asked = needles.select(F.col(needle_id).alias("nid"), fold(F.col(needle_col)).alias("n")).where("trim(n) <> ''")
    wanted = asked.select("n").distinct()
    width = F.least(F.length("n"), F.lit(gram))
    sizes = [r[0] for r in wanted.select(width).distinct().collect()] or [gram]  # at most `gram` numbers
    of_needles = stage(wanted.select("n", F.explode(_grams(F.col("n"), width)).alias("g")))
    every = reduce(F.concat, [_grams(F.col("t"), k) for k in sorted(sizes)])
    of_texts = stage(named.select("t").distinct().select("t", F.explode(every).alias("g")).join(of_needles.select("g").distinct(), "g", "left_semi"))
    counts = of_texts.groupBy("g").agg(F.count("*").alias("df"))
    held = of_needles.join(counts, "g", "left").groupBy("n").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "g")).alias("best"))
    chosen = stage(held.where("best.df > 0").select("n", "best.g", F.ceil(F.col("best.df") / per_salt).cast("int").alias("salts")))
    met = of_texts.join(chosen.select("g", "salts").distinct(), "g").withColumn("salt", F.pmod(F.xxhash64("t"), F.col("salts")).cast("int")).drop("salts")
    spread = chosen.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    pairs = met.join(spread, ["g", "salt"]).where(F.contains("t", "n")).select("t", "n")
    ids = pairs.join(named.distinct(), "t").join(asked.distinct(), "n").select("tid", "nid").distinct()
    return ids.select(F.col("tid").alias(text_id), F.col("nid").alias(needle_id if needle_id != text_id else f"needle_{needle_id}"))


def catalogues_containing(catalogues: DataFrame, needles: DataFrame, *, id: str = "id", composer: str = "composer", needle: str = "needle") -> DataFrame:
    """P7 for many needles: (id, needle) where the composer's normal name holds the needle's normal form."""
    return contains_join(catalogues, needles, text_id=id, text_col=composer, needle_id=needle, needle_col=needle, fold=normalize_name)


def composers_like_any(composers: DataFrame, aliases: DataFrame, needles: DataFrame, *, needle: str = "needle") -> DataFrame:
    """P3 and J3 for many needles: (id, needle) of active entities whose name holds the needle, case and accents
    aside, or with an alias whose normal form holds the needle's."""
    active = composers.where("status = 'active'").select("id", "name")
    by_name = contains_join(active.withColumn("name", text(F.col("name"))), needles, text_col="name", needle_id=needle, needle_col=needle)
    by_alias = contains_join(aliases, needles, text_id="composer_id", text_col="normalized_alias", needle_id=needle, needle_col=needle, fold=normalize_name)
    of_active = by_alias.withColumnRenamed("composer_id", "id").join(active.select("id").distinct(), "id", "left_semi")
    return by_name.unionByName(of_active).distinct()
