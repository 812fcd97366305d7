"""Features of candidate pairs. Records have country, id, name, addr (normalised) and business_name, business_address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions import similarity as sim
from kinweave.functions import text as T
from kinweave.session import cut


def pair_columns(pairs: DataFrame, s1: DataFrame, r: DataFrame) -> DataFrame:
    """pairs (country, s1, r) with both records' texts, as name_1, addr_1, name_2, ..."""
    names = ["name", "addr", "business_name", "business_address"]
    a = s1.select("country", F.col("id").alias("s1"), *[F.col(c).alias(f"{c}_1") for c in names])
    b = r.select("country", F.col("id").alias("r"), *[F.col(c).alias(f"{c}_2") for c in names])
    return pairs.join(a, ["country", "s1"]).join(b, ["country", "r"])


def number_jaccard(a: Column, b: Column) -> Column:
    """Shared share of two texts' numbers; -1 if neither has one."""
    x, y = T.numbers(a), T.numbers(b)
    either = F.size(F.array_union(x, y))
    return F.when(either == 0, F.lit(-1.0)).otherwise(F.size(F.array_intersect(x, y)) / either)


def house_equal(a: Column, b: Column) -> Column:
    """Whether the first numbers are equal, as 1 or 0; -1 if a text has none."""
    x, y = T.house(a), T.house(b)
    return F.when((x == "") | (y == ""), F.lit(-1)).otherwise((x == y).cast("int"))


def region_overlap(a: Column, b: Column) -> Column:
    """Whether two arrays of regions share one, as 1 or 0; -1 if a side has none or is null."""
    known = (F.size(F.coalesce(a, F.array().cast("array<string>"))) > 0) & (F.size(F.coalesce(b, F.array().cast("array<string>"))) > 0)
    return F.when(known, F.arrays_overlap(a, b).cast("int")).otherwise(-1)


def string_features(pairs: DataFrame) -> DataFrame:
    """pair_columns() rows with all similarities and structural features."""
    core = {k: T.core_name(F.col(f"name_{k}")) for k in (1, 2)}
    return pairs.withColumns({"core_1": core[1], "core_2": core[2]}).withColumns({
        "name_ratio": sim.indel_ratio_column("name_1", "name_2"),
        "name_tset": sim.token_set_ratio_column("name_1", "name_2"),
        "name_partial": sim.partial_ratio_column("core_1", "core_2"),
        "core_jw": sim.jaro_winkler_column("core_1", "core_2"),
        "core_equal": (F.col("core_1") == F.col("core_2")) & (F.col("core_1") != ""),
        "addr_tset": sim.token_set_ratio_column("addr_1", "addr_2"),
        "addr_tsort": sim.token_sort_ratio_column("addr_1", "addr_2"),
        "addr_partial": sim.partial_ratio_column("addr_1", "addr_2"),
        "name_len_diff": F.abs(F.length("name_1") - F.length("name_2")),
        "num_jacc": number_jaccard(F.col("addr_1"), F.col("addr_2")),
        "house_eq": house_equal(F.col("addr_1"), F.col("addr_2")),
        "r_addr_empty": F.col("addr_2") == "",
        "r_nonlatin": T.non_latin("business_name_2", "business_address_2"),
    })


def token_idf(records: DataFrame, tokens: Column) -> DataFrame:
    """(country, token, idf) over all records of a country: ln((n + 1) / (df + 1)) + 1."""
    n = records.groupBy("country").agg(F.count("*").alias("n"))
    df = records.select("country", F.explode(tokens).alias("token")).groupBy("country", "token").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(n), "country").select("country", "token", (F.log((F.col("n") + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf"))


def weighted_overlap(pairs: DataFrame, a: Column, b: Column, idf: DataFrame) -> DataFrame:
    """(country, s1, r, wjacc, rare_miss_s1, rare_miss_r, idf_match) of pairs' token arrays.

    A token that idf lacks weighs 1. wjacc is -1 for pairs without a token; a missing side's rarest is 0.
    """
    sides = pairs.select("country", "s1", "r", a.alias("a"), b.alias("b"))
    long = sides.select("country", "s1", "r", "a", "b", F.explode_outer(F.array_union("a", "b")).alias("token"))
    long = long.select("country", "s1", "r", "token", F.array_contains("a", F.col("token")).alias("in_a"), F.array_contains("b", F.col("token")).alias("in_b"))
    w = F.coalesce("idf", F.lit(1.0))
    long = long.join(idf, ["country", "token"], "left").withColumn("w", F.when(F.col("token").isNotNull(), w).otherwise(0.0))
    both, total = F.sum(F.when(F.col("in_a") & F.col("in_b"), F.col("w")).otherwise(0.0)), F.sum("w")
    return long.groupBy("country", "s1", "r").agg(
        F.when(total > 0, both / total).otherwise(-1.0).alias("wjacc"),
        F.coalesce(F.max(F.when(F.col("in_a") & ~F.col("in_b"), F.col("w"))), F.lit(0.0)).alias("rare_miss_s1"),
        F.coalesce(F.max(F.when(F.col("in_b") & ~F.col("in_a"), F.col("w"))), F.lit(0.0)).alias("rare_miss_r"),
        both.alias("idf_match"),
    )


def record_frequency(records: DataFrame, key: Column, least: int) -> DataFrame:
    """(country, id, freq): how many records of the country have the same key; 0 for keys of under `least` characters.

    Counts are aggregated and joined rather than windowed. Blank and short keys, which very many records may share, are set
    to 0 before the join meets them.
    """
    keyed = cut(records.select("country", "id", key.alias("key")))  # three readers
    long = keyed.where(F.length("key") >= least)
    n = long.groupBy("country", "key").agg(F.count("*").alias("freq"))
    none = keyed.where(F.coalesce(F.length("key"), F.lit(0)) < least).select("country", "id", F.lit(0).cast("long").alias("freq"))
    return long.join(n, ["country", "key"]).select("country", "id", "freq").unionByName(none)
