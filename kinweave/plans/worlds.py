"""The reference's concepts laid over the test tables, in Spark and as SQL. Every row of a table belongs to a source.

records: parts as businesses, the source by key, with noise; vectors: embeddings, every fifth an anchor, countries by label; edges:
orders as scored candidates, customers being anchors and parts records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions import text as T
from kinweave.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in threes: an anchor, and two records that name it in their own way, with other words for its region, a blank
    address or nothing in common; every tenth part is a record of no anchor. Column anchor tells of which one."""
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    # Dealt anew, as a small file of many rows is read by few tasks, which would do all the normalising.
    own = part.select("p_partkey", *[F.col(c).alias(f"own_{c}") for c in ("p_name", "p_brand", "p_type", "p_size")]).repartition("p_partkey")
    rows = own.join(part.withColumnRenamed("p_partkey", "first"), k - k % 3 == F.col("first"), "left")
    follows = (k % 3 > 0) & (k % 10 != 7) & F.col("first").isNotNull()
    of = lambda c: F.when(follows, F.col(c)).otherwise(F.col(f"own_{c}"))
    rows = rows.select("p_partkey", F.when(follows, F.concat(F.lit("S1-"), F.col("first").cast("string"))).alias("anchor"), *[of(c).alias(c) for c in ("p_name", "p_brand", "p_type", "p_size")])
    word = F.split("p_name", " ")
    plain = F.concat_ws(" ", "p_name", "p_brand", F.lit("Ltd."))
    name = F.when(k % 3 == 0, plain).when(k % 50 == 11, F.lit("Zzyzx Qqq")).when(k % 40 == 23, F.concat(plain, F.lit(" कॉलोनी")))
    name = name.when(k % 4 == 1, F.concat(F.upper("p_name"), F.lit(" "), F.col("p_brand"), F.lit(" LIMITED"))).when(k % 4 == 2, F.concat_ws(" ", word[1], word[0], "p_brand")).when(k % 4 == 3, F.concat_ws(" ", F.replace("p_name", F.lit("i"), F.lit("ee")), "p_brand")).otherwise(plain)
    region = F.element_at(F.array(*map(F.lit, REGIONS)), (F.col("p_size") % len(REGIONS) + 1).cast("int"))
    short = F.element_at(F.array(*map(F.lit, SHORT)), (F.col("p_size") % len(REGIONS) + 1).cast("int"))
    street = F.concat(F.col("p_size").cast("string"), F.lit(" Main Road"))
    address = F.when(k % 33 == 0, street).when(k % 3 == 0, F.concat_ws(", ", street, region)).when((k % 50 == 11) | (k % 6 == 5), F.lit(""))
    address = address.when(k % 4 == 0, F.concat_ws(", ", street, region)).when(k % 4 == 2, F.concat_ws(", ", street, short)).otherwise(F.concat_ws(", ", region, street))
    raw = rows.select(F.concat(F.lit("S"), (k % 3 + 1).cast("string"), F.lit("-"), k.cast("string")).alias("id"), F.lower("p_type").alias("country"), name.alias("business_name"), address.alias("business_address"), "anchor")
    return raw.withColumns({"name": T.norm_latin("business_name"), "addr": T.norm_latin("business_address")})


REGIONS, SHORT = ("Alder Valley", "Birch County"), ("Aldr V.", "Brch Cty")


def sides(all_records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Anchors (S1) and the records that may match them (S2, S3)."""
    return all_records.where("id LIKE 'S1-%'"), all_records.where("id NOT LIKE 'S1-%'")


def true_pairs(all_records: DataFrame) -> DataFrame:
    """(country, s1, r) of records and their anchors."""
    s1, r = sides(all_records)
    return s1.select("country", F.col("id").alias("s1")).join(r.select("country", F.col("anchor").alias("s1"), F.col("id").alias("r")), ["country", "s1"])


def record_vectors(spark: SparkSession, sf_dir: str, all_records: DataFrame) -> DataFrame:
    """(country, id, v) of records: the embedding of the anchor's number mixed with that of the own one. Of numbered ones the
    names are in entity_id."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = rows.count()
    number = lambda c: F.element_at(F.split(c, "-"), 2).cast("long") % n
    name = "entity_id" if "entity_id" in all_records.columns else "id"
    keyed = all_records.select("country", "id", number(name).alias("mine"), number(F.coalesce("anchor", name)).alias("shared"))
    keyed = keyed.join(rows.select(F.col("vec_id").alias("shared"), F.col("embedding").alias("x")), "shared").join(rows.select(F.col("vec_id").alias("mine"), F.col("embedding").alias("y")), "mine")
    return keyed.select("country", "id", F.zip_with("x", "y", lambda x, y: x.cast("double") * 0.75 + y.cast("double") * 0.25).alias("v"))


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("c"), (F.col("label") % 3).cast("string")).alias("country"), "label", F.col("embedding").alias("v"))
    return rows.where("id % 5 = 0"), rows.where("id % 5 <> 0")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(country, s1, r, p, is_s3), one for each customer and part that an order line joins."""
    t = lambda name: table(spark, sf_dir, name)
    lines = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    lines = lines.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    p = ((F.col("l_orderkey") * 31 + F.col("l_partkey") * 17 + F.col("l_linenumber")) % 1000).cast("double") / 1000.0
    out = lines.groupBy(F.col("r_name").alias("country"), F.col("o_custkey").alias("s1"), F.col("l_partkey").alias("r")).agg(F.max(p).alias("p"))
    return out.withColumn("is_s3", (F.col("r") % 2).cast("int"))


def edge_truth(all_edges: DataFrame) -> DataFrame:
    return all_edges.where("p >= 0.6 AND r % 3 <> 0").select("country", "s1", "r")


def edge_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("s1"))


# The same as SQL for DuckDB.


def sql_squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def sql_norm(x: str) -> str:
    """Normalisation by another route: without look-around, runs of signs first, then signs at a space."""
    for one, more in T.LIGATURES.items():
        x = f"replace({x}, '{one}', '{more.replace(chr(39), chr(39) * 2)}')"
    x = f"regexp_replace(replace(lower({x}), '&', ' and '), '[^a-z0-9/ ,.-]', ' ', 'g')"
    x = f"' ' || regexp_replace({x}, '[-.,/]{{2,}}', ' ', 'g') || ' '"
    return sql_squeeze(f"regexp_replace(regexp_replace({x}, '[-.,/] ', ' ', 'g'), ' [-.,/]', ' ', 'g')")


def sql_core(x: str, gap: str = " ") -> str:
    return sql_squeeze(rf"regexp_replace(regexp_replace({x}, '\b({T.LEGAL})\b', ' ', 'g'), '[^a-z0-9 ]', '{gap}', 'g')")


_CHOICE = lambda names: "[" + ", ".join(f"'{x}'" for x in names) + f"][p_size % {len(REGIONS)} + 1]"
_PLAIN = "p_name || ' ' || p_brand || ' Ltd.'"
RECORDS = f"""
    own AS (SELECT a.p_partkey AS k, CASE WHEN a.p_partkey % 3 > 0 AND a.p_partkey % 10 <> 7 THEN 'S1-' || b.p_partkey END AS anchor, a AS a, b AS b FROM part a LEFT JOIN part b ON b.p_partkey = a.p_partkey - a.p_partkey % 3),
    pick AS (SELECT k, anchor, CASE WHEN anchor IS NULL THEN a ELSE b END AS p FROM own),
    flat AS (SELECT k, anchor, p.p_name AS p_name, p.p_brand AS p_brand, p.p_type AS p_type, p.p_size AS p_size FROM pick),
    raw AS (SELECT 'S' || (k % 3 + 1) || '-' || k AS id, lower(p_type) AS country,
        CASE WHEN k % 3 = 0 THEN {_PLAIN} WHEN k % 50 = 11 THEN 'Zzyzx Qqq' WHEN k % 40 = 23 THEN {_PLAIN} || ' कॉलोनी' WHEN k % 4 = 1 THEN upper(p_name) || ' ' || p_brand || ' LIMITED'
            WHEN k % 4 = 2 THEN string_split(p_name, ' ')[2] || ' ' || string_split(p_name, ' ')[1] || ' ' || p_brand WHEN k % 4 = 3 THEN replace(p_name, 'i', 'ee') || ' ' || p_brand ELSE {_PLAIN} END AS business_name,
        CASE WHEN k % 33 = 0 THEN p_size || ' Main Road' WHEN k % 3 = 0 THEN p_size || ' Main Road, ' || {_CHOICE(REGIONS)} WHEN k % 50 = 11 OR k % 6 = 5 THEN '' WHEN k % 4 = 0 THEN p_size || ' Main Road, ' || {_CHOICE(REGIONS)} WHEN k % 4 = 2 THEN p_size || ' Main Road, ' || {_CHOICE(SHORT)} ELSE {_CHOICE(REGIONS)} || ', ' || p_size || ' Main Road' END AS business_address,
        anchor FROM flat),
    rec AS (SELECT *, {sql_norm('business_name')} AS name, {sql_norm('business_address')} AS addr FROM raw),
    s1 AS (SELECT * FROM rec WHERE id LIKE 'S1-%'),
    rr AS (SELECT * FROM rec WHERE id NOT LIKE 'S1-%'),
    truth AS (SELECT s1.country, s1.id AS s1, rr.id AS r FROM s1 JOIN rr ON rr.anchor = s1.id)
"""
RECORD_VECTORS = """
    nv AS (SELECT count(*) AS n FROM embeddings),
    rvec AS (SELECT rec.country, rec.id, list_transform(x.embedding, lambda c, i: c::DOUBLE * 0.75 + y.embedding[i]::DOUBLE * 0.25) AS v FROM rec, nv, embeddings x, embeddings y
        WHERE x.vec_id = string_split(coalesce(anchor, id), '-')[2]::BIGINT % nv.n AND y.vec_id = string_split(id, '-')[2]::BIGINT % nv.n)
"""
VECTORS = """
    vec AS (SELECT vec_id AS id, 'c' || (label % 3) AS country, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
    s1 AS (SELECT * FROM vec WHERE id % 5 = 0),
    rr AS (SELECT * FROM vec WHERE id % 5 <> 0)
"""
EDGES = """
    e AS (SELECT r_name AS country, o_custkey AS s1, l_partkey AS r, max(((l_orderkey * 31 + l_partkey * 17 + l_linenumber) % 1000)::DOUBLE / 1000.0) AS p, (l_partkey % 2)::INTEGER AS is_s3
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        GROUP BY r_name, o_custkey, l_partkey),
    et AS (SELECT country, s1, r FROM e WHERE p >= 0.6 AND r % 3 <> 0)
"""
