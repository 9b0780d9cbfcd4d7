"""Noise filters as flags, their funnel, and the names of persons."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelight.functions import text as tx
from sievelight.sources.storage import settled


def any_flag(flags: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.coalesce(F.col(f), F.lit(False)) for f in flags))


def log_flags(log: DataFrame, text: str = "query", min_clicks: int = 1, short: int = 4) -> DataFrame:
    """The log with a drop flag for each noise rule and drop_any; the costly rules come last."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    shorthand = (F.length("query_key") <= short) & (n("clicks_site1_ga4") == 0) & (n("clicks_site1_internal") > 0)
    flagged = log.withColumns(
        {
            "drop_clicks": n("clicks") < min_clicks,
            "drop_digits": tx.is_digits(F.col(text)),
            "drop_shorthand": F.coalesce(shorthand, F.lit(False)),
            "drop_title": tx.has_title(F.col(text)),
            "drop_spam": tx.is_spam(F.col(text)),
        }
    )
    return flagged.withColumn("drop_any", any_flag([c for c in flagged.columns if c.startswith("drop_")]))


def split_by(flagged: DataFrame, flag: str = "drop_any") -> tuple[DataFrame, DataFrame]:
    """Kept and dropped rows; a null flag keeps."""
    flag_ = F.coalesce(F.col(flag), F.lit(False))
    return flagged.filter(~flag_), flagged.filter(flag_)


def funnel(flagged: DataFrame, flags: list[str], clicks: str = "clicks") -> DataFrame:
    """rule, n_dropped and clicks_dropped for every flag and for what is kept, in one pass."""
    rules = [(f, F.coalesce(F.col(f), F.lit(False))) for f in flags] + [("kept", ~any_flag(flags))]
    row = flagged.agg(
        *(
            F.struct(
                F.count_if(c).alias("n"), F.coalesce(F.sum(F.when(c, F.col(clicks))), F.lit(0)).alias("clicks")
            ).alias(f)
            for f, c in rules
        )
    )
    each = F.explode(
        F.array(
            *(
                F.struct(F.lit(f).alias("rule"), F.col(f)["n"].alias("n_rows"), F.col(f)["clicks"].alias("clicks"))
                for f, _ in rules
            )
        )
    )
    return row.select(each.alias("e")).select("e.*")


def not_listed(df: DataFrame, blocked: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``blocked``; Spark broadcasts the list where its size allows."""
    return df.join(blocked.select(key).distinct(), key, "left_anti")


def indel_ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence as a percentage of both lengths."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    # Bit-parallel: a zero bit of ``row`` marks a place of ``a`` that the subsequence uses.
    masks: dict[str, int] = {}
    for k, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        used = row & masks.get(c, 0)
        row = ((row + used) | (row - used)) & full
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def indel_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(
        [None if x is None or y is None else indel_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64"
    )


#: Letters that a text loses at most, and forms that it then has at most; lengths that need more meet by parts.
DELETIONS, FORMS = 3, 1200


def _reached(common: Column, n: Column, m: Column, cutoff: float) -> Column:
    """Whether texts of these lengths with a common subsequence of this one reach the cutoff, as indel_ratio says."""
    return (n + m == 0) | (200.0 * common / F.greatest(n + m, F.lit(1)) >= cutoff)


def _length_classes(keys: DataFrame, names: DataFrame, key: str, name: str, cutoff: float) -> DataFrame:
    """Lengths m of keys and n of names that can reach the cutoff, the least common subsequence that does, and by_form."""
    n, m = F.col("n"), F.col("m")
    guess = F.ceil(cutoff * (n + m) / 200).cast("int")
    least = F.when(_reached(guess - 1, n, m, cutoff), guess - 1).when(
        _reached(guess, n, m, cutoff), guess
    ).otherwise(guess + 1)

    def forms(a: Column, lost: Column) -> Column:
        """Ways to delete so many letters; null beyond DELETIONS."""
        a, ways, out = a.cast("double"), F.lit(1.0), F.when(lost == 0, 1.0)
        for k in range(1, DELETIONS + 1):
            ways = ways * (a - (k - 1)) / k
            out = out.when(lost == k, ways)
        return out

    fits = lambda a: F.coalesce(forms(a, a - F.col("least")) <= FORMS, F.lit(False))
    lengths = lambda df, c, to: df.select(F.length(c).alias(to)).distinct()
    return lengths(names, name, "n").crossJoin(lengths(keys, key, "m")).withColumn(
        "least", F.greatest(least, F.lit(0))
    ).filter(F.col("least") <= F.least(n, m)).withColumn("by_form", fits(n) & fits(m))


def _forms(texts: DataFrame, text: str, size: str, classes: DataFrame) -> DataFrame:
    """Every subsequence (form) of a text that has a length ``least`` of its class, once.

    Letters go from left to right, of equal neighbours the first ones, so no form comes twice.
    """
    wanted = classes.filter("by_form").select(size, "least").distinct()
    # A text becomes hundreds of rows, so tasks get few texts.
    tasks = max(4 * texts.sparkSession.sparkContext.defaultParallelism, 16 * texts.rdd.getNumPartitions())
    df = texts.repartition(tasks, text).withColumn(size, F.length(text)).join(F.broadcast(wanted), size)
    df = df.select(text, size, "least", F.col(text).alias("form"), F.lit(1).alias("at"))
    letter = lambda k: F.substring(F.col("form"), k, F.lit(1))
    at = F.col("at")
    for _ in range(DELETIONS):
        places = F.when(F.length("form") > F.col("least"), F.sequence("at", F.col("least") + 1))
        df = df.select(text, size, "least", "form", F.explode(F.coalesce(places, F.array(F.lit(0)))).alias("at")).filter(
            (at <= 1) | (letter(at) != letter(at - 1))
        )
        shorter = F.concat(
            F.substring(F.col("form"), F.lit(1), at - 1), F.substring(F.col("form"), at + 1, F.length("form"))
        )
        df = df.withColumns({"form": F.when(at > 0, shorter).otherwise(F.col("form")), "at": F.greatest(at, F.lit(1))})
    return df.select(text, size, "form")


def _pairs_by_parts(keys: DataFrame, names: DataFrame, classes: DataFrame, key: str, name: str, cutoff: float) -> DataFrame:
    """Candidates among lengths that are not compared by form.

    An edit script of d insertions and deletions leaves one of d + 1 parts of a name whole;
    keys meet names on such a part and on its shift.
    """
    share = 1 - cutoff / 100
    reach = classes.filter("not by_form").select("n", "m")

    def edits(a: Column) -> Column:
        """Insertions and deletions at most between a text of this length and any that reaches the cutoff."""
        return F.floor(a * (2 * share) / (1 - share) + 1e-9).cast("int")

    names = names.withColumn("n", F.length(name)).join(F.broadcast(reach.select("n").distinct()), "n", "left_semi")
    n = F.col("n")
    parts = edits(n) + 1
    width = F.floor(n / parts)
    cut = F.transform(
        F.sequence(F.lit(0), parts - 1),
        lambda k: F.struct(
            F.when(
                k < parts - 1, F.substring(F.col(name), (k * width + 1).cast("int"), width.cast("int"))
            ).otherwise(F.substring(F.col(name), (k * width + 1).cast("int"), n)).alias("part"),
            (k * width).cast("int").alias("at"),
        ),
    )
    indexed = names.select(
        name, "n", edits(n).alias("d"), F.explode(cut).alias("p")
    ).select(name, "n", "d", "p.*", F.length("p.part").alias("w"))
    # Every shape of a name meets the key lengths it can reach.
    shapes = indexed.select("n", "d", "at", "w").distinct().join(reach, "n")
    windows = keys.withColumn("m", F.length(key)).join(shapes, "m").select(
        key,
        "n",
        "at",
        "w",
        F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - F.col("d")), F.col("at") + F.col("d"))).alias("from"),
    )
    windows = windows.select(
        key, "n", "at", F.substring(F.col(key), F.col("from") + 1, F.col("w")).alias("part")
    ).distinct()
    return windows.join(indexed, ["n", "at", "part"]).select(key, name).distinct()


def _sides(left: DataFrame, right: DataFrame, key: str, name: str, cutoff: float) -> tuple[DataFrame, ...]:
    """Distinct keys and names as written tables, and the classes of their lengths."""
    keys, names = (settled(df.select(c).filter(F.col(c).isNotNull()).distinct()) for df, c in ((left, key), (right, name)))
    return keys, names, settled(_length_classes(keys, names, key, name, cutoff))


def fuzzy_matches(left: DataFrame, right: DataFrame, key: str, name: str, cutoff: float = 88.0) -> DataFrame:
    """For each key of ``left`` the most similar name of ``right`` at ``cutoff`` or above: key, name, ratio.

    Texts at or above the cutoff have a common subsequence of a length that theirs tell, and
    short ones have few of that length: keys meet names on it, so what all names have in
    common forms no pairs.  Longer texts meet on aligned parts.  Nothing that reaches the
    cutoff is missed.
    """
    keys, names, classes = _sides(left, right, key, name, cutoff)
    same = _forms(keys, key, "m", classes).join(_forms(names, name, "n", classes), "form").filter(
        _reached(F.length("form"), F.col("n"), F.col("m"), cutoff)
    )
    pairs = same.select(key, name).union(_pairs_by_parts(keys, names, classes, key, name, cutoff)).distinct()
    rated = pairs.withColumn("ratio", indel_ratio_udf(key, name)).filter(F.col("ratio") >= cutoff)
    return rated.groupBy(key).agg(
        F.min_by(F.struct(name, "ratio"), F.struct((-F.col("ratio")).alias("r"), F.col(name).alias("s"))).alias("b")
    ).select(key, "b.*")


def fuzzy_keys(left: DataFrame, right: DataFrame, key: str, name: str, cutoff: float = 88.0) -> DataFrame:
    """The keys of :func:`fuzzy_matches`, without a search for the most similar of their names."""
    keys, names, classes = _sides(left, right, key, name, cutoff)
    known = _forms(names, name, "n", classes).select(F.col("form").alias("known"), "n").distinct()
    same = F.col("form") == F.col("known")
    short = _forms(keys, key, "m", classes).join(
        known, same & _reached(F.length("form"), F.col("n"), F.col("m"), cutoff), "left_semi"
    )
    longer = _pairs_by_parts(keys, names, classes, key, name, cutoff).filter(indel_ratio_udf(key, name) >= cutoff)
    return short.select(key).union(longer.select(key)).distinct()


def person_flags(log: DataFrame, people: DataFrame, text: str = "query", cutoff: float = 88.0) -> DataFrame:
    """Keys of the log that name a person of ``people`` (firstname, lastname), with match: full, token or fuzzy.

    The names are first names, last names and both in either order.  A key matches as a
    whole, by a token of four letters or more, or, having three tokens or fewer, by
    similarity.
    """
    names = people.select(
        *(F.nullif(tx.normalize_name(F.coalesce(c, F.lit(""))), F.lit("")).alias(c) for c in ("firstname", "lastname"))
    )
    both = lambda a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.concat_ws(" ", a, b))
    whole = names.select(
        F.explode(
            F.array("firstname", "lastname", both("firstname", "lastname"), both("lastname", "firstname"))
        ).alias("name")
    ).filter("name is not null").distinct()
    last = whole.select(F.col("name").alias("token")).filter("length(token) >= 4")
    keys = log.select(tx.normalize_name(F.col(text)).alias("key")).filter("length(key) > 0").distinct()
    full = keys.join(whole.withColumnRenamed("name", "key"), "key", "left_semi").withColumn("match", F.lit("full"))
    token = keys.select(
        "key", F.explode(tx.tokens(F.col("key"))).alias("token")
    ).join(last, "token", "left_semi").select("key").distinct().withColumn("match", F.lit("token"))
    few = keys.filter(F.size(tx.tokens(F.col("key"))) <= 3)
    fuzzy = fuzzy_keys(few, whole, "key", "name", cutoff).withColumn("match", F.lit("fuzzy"))
    order = F.when(F.col("match") == "full", 0).when(F.col("match") == "token", 1).otherwise(2)
    return full.union(token).union(fuzzy).groupBy("key").agg(F.min_by("match", order).alias("match"))


def recognised(c: Column, load: Callable[[], Callable[[list[str]], list[bool]]]) -> Column:
    """Whether a recogniser finds a person's name in a text; null counts as no text.

    ``load`` makes the recogniser, once in each task and on the executor, so a model of any
    library can be behind it; it is asked for a batch of texts at a time.
    """

    @F.pandas_udf("boolean")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        recogniser = load()
        for texts in batches:
            yield pd.Series(recogniser(texts.fillna("").tolist()), dtype=bool)

    return found(c)


def capitalised_names(c: Column) -> Column:
    """Stand-in for a name recogniser: pairs of capitalised words of letters."""
    return F.regexp_count(c, F.lit(r"(?U)\b\p{Lu}\p{Ll}+\s+\p{Lu}\p{Ll}+\b")) > 0
