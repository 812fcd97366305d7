"""Benchmark decontamination by winnowing, on DataFrame functions alone (operator 4).

Of every SPAN consecutive words, the smallest hash of the GRAM-word grams inside is a fingerprint. Two texts that share
SPAN words choose the same smallest hash there, so the join on fingerprints misses no shared span. A fingerprint carries
the run of spans that chose it, so what it may hit is known without a search through the text: all work is linear in a
text's length, however many items it holds. The spans of matched runs are then joined on their very words. Items of fewer
words than a span are one gram of their own length; all grams of that length are then fingerprints of the documents.

explode_outer() is used throughout: for explode() the optimizer infers a filter on the array's size and, pushing it down,
writes the fingerprints' expressions out inside one another, which makes them quadratic in a text's length.

Texts stay where they are read: fingerprints meet a broadcast table where the benchmark's size, counted first, allows it,
and documents with a match, which are read again for their words, meet one where their number does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import cut

SPAN, GRAM = 10, 5
#: Spans of a benchmark up to which its tables are broadcast: about 30 MB. Runs of matched documents up to which these are.
BROADCAST_SPANS, BROADCAST_RUNS = 200_000, 500_000
#: Rows of equal id and text that one array stands for.
COPIES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text in lower case (A-Z alone are lowered): runs of ASCII letters, digits and non-ASCII characters."""
    text = F.coalesce(text, F.lit(""))
    # lower() is A-Z alone where every character is one byte, and far cheaper than translate().
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.filter(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def positions(n: Column, size: int | Column) -> Column:
    """0 .. n - size, or nothing."""
    return F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))


def gram(hashes: Column, at: Column, size: int | Column) -> Column:
    return F.xxhash64(F.slice(hashes, at + 1, size))


def with_words(df: DataFrame, keep: list[Column], text: Column) -> DataFrame:
    """Columns to keep, with words, n_words and the words' hashes."""
    df = df.select(*keep, words(text).alias("words"))
    return df.select("*", F.size("words").alias("n_words"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))


def with_prints(df: DataFrame, span: int, size: int, short: list[int]) -> DataFrame:
    """df of with_words() with column prints: fingerprints, each with the length of the spans that it stands for and the
    run [at, upto) of places where these begin."""
    # Size is asked of the hashes themselves: with two uses the optimizer computes them once, not within the lambda.
    h, n = F.col("hashes"), F.size("hashes")
    grams = lambda of: F.transform(positions(n, of), lambda i: gram(h, i, of))
    of = lambda value, length, at, upto: F.struct(value.alias("print"), F.lit(length).alias("length"), at.alias("at"), upto.alias("upto"))
    df = df.withColumn("grams", grams(size))
    df = df.withColumn("least", F.transform(positions(n, span), lambda i: F.least(*[F.get("grams", i + k) for k in range(span - size + 1)])))
    spans = F.size("least")
    df = df.withColumn("starts", F.filter(positions(spans, 1), lambda i: (i == 0) | (F.get("least", i) != F.get("least", i - 1))))
    runs = F.transform("starts", lambda i, k: of(F.get("least", i), span, i, F.coalesce(F.get("starts", k + 1), spans)))
    alone = lambda s: F.transform(grams(s), lambda x, i: of(x, s, i, i + 1))
    parts = [runs, *(alone(s) for s in short)]
    return df.withColumn("prints", F.concat(*parts)).drop("grams", "least", "starts")


def benchmark_tables(benchmark: DataFrame, id_col: str, text_col: str, span: int, size: int) -> tuple[DataFrame, DataFrame, list[int]]:
    """(window, length, item), (print, length) and the lengths of items shorter than a span."""
    items = with_words(benchmark, [F.col(id_col).cast("string").alias("item")], F.col(text_col)).where("n_words > 0")
    long_enough = F.col("n_words") >= span
    starts = F.when(long_enough, positions(F.col("n_words"), span)).otherwise(F.array(F.lit(0)))
    length = F.least(F.col("n_words"), F.lit(span))
    windows = items.select("item", "words", length.alias("length"), F.explode_outer(starts).alias("at")).select(F.array_join(F.slice("words", F.col("at") + 1, F.col("length")), " ").alias("window"), "length", "item").distinct()
    short = [r[0] for r in items.where(~long_enough).select("n_words").distinct().collect()]
    prints = with_prints(items.where(long_enough), span, size, []).select(F.explode_outer("prints").alias("p")).where("p IS NOT NULL").select("p.print", "p.length")
    whole = items.where(~long_enough).select(gram(F.col("hashes"), F.lit(0), F.col("n_words")).alias("print"), F.col("n_words").alias("length"))
    return cut(windows), cut(prints.union(whole).distinct()), sorted(short)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = SPAN, size: int = GRAM, broadcast_spans: int = BROADCAST_SPANS, broadcast_runs: int = BROADCAST_RUNS, with_hash: bool = False) -> DataFrame:
    """Per row of docs: id, n_words, n_hit, n_items, items_sha256, contaminated; with_hash adds text_hash, xxhash64 of the
    text, which with the id tells rows apart.

    A word is hit if it lies in an occurrence of any `span` consecutive words of an item, or of a whole item that has
    fewer. items_sha256 is the digest of the ids of the items found, as strings, sorted, joined by commas (of no bytes,
    if none). Null and wordless texts have no words and no hits; null and wordless items hit nothing; an item without an
    id hits words and is neither counted nor named. Rows without an id and rows of one id with different texts are
    judged each by its own text; repeated rows get the same result each; empty tables give no hits or no rows. Columns
    other than ids and texts are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    windows, prints, short = benchmark_tables(benchmark, item_col, item_text_col, span, size)
    near = F.broadcast if windows.count() <= broadcast_spans else lambda x: x
    key = [F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash")]
    rows = with_prints(with_words(docs, key, F.col(text_col)), span, size, short)
    # A fingerprint of length 0, which no item has, carries each document through the same pass.
    marker = F.array(F.struct(F.col("text_hash").alias("print"), F.lit(0).alias("length"), F.lit(0).alias("at"), F.lit(0).alias("upto")))
    rows = rows.select("id", "text_hash", "n_words", F.explode_outer(F.concat("prints", marker)).alias("p")).select("id", "text_hash", "n_words", "p.*")
    held = prints.select(F.col("print").alias("own"), F.col("length").alias("own_length"), F.lit(True).alias("found"))
    matched = rows.join(near(held), (F.col("print") == F.col("own")) & (F.col("length") == F.col("own_length")), "left").where("found OR length = 0")
    run = F.when(F.col("length") > 0, F.struct("length", "at", "upto"))
    told = cut(matched.groupBy("id", "text_hash").agg(F.max("n_words").alias("n_words"), F.count(F.when(F.col("length") == 0, 1)).alias("copies"), F.collect_set(run).alias("runs")))

    # Documents with a match are read again for the words of the spans that may hit.
    some = told.where(F.size("runs") > 0).select(F.col("id").alias("own_id"), F.col("text_hash").alias("own_hash"), "runs")
    few = (some.agg(F.sum(F.size("runs"))).first()[0] or 0) <= broadcast_runs
    own = docs.select(*key, F.col(text_col).alias("text")).join(F.broadcast(some) if few else some, F.col("id").eqNullSafe(F.col("own_id")) & (F.col("text_hash") == F.col("own_hash")))
    own = own.select("id", "text_hash", "runs", words(F.col("text")).alias("words"))
    places = F.flatten(F.transform("runs", lambda r: F.transform(F.sequence(r["at"], r["upto"] - 1), lambda i: F.struct(i.alias("at"), r["length"].alias("length")))))
    spans = F.transform(places, lambda p: F.struct(p["at"].alias("at"), p["length"].alias("length"), F.array_join(F.slice("words", p["at"] + 1, p["length"]), " ").alias("window")))
    found = own.where(F.size("words") > 0).select("id", "text_hash", F.explode_outer(spans).alias("s")).select("id", "text_hash", "s.*")
    there = windows.select("window").distinct().withColumn("hit", F.lit(True))
    hits = cut(found.join(near(there), "window").select("id", "text_hash", "at", "length", "window").distinct())
    # Spans sorted by where they begin, each adding the words beyond those before it.
    sorted_spans = F.array_sort(F.collect_set(F.struct("at", (F.col("at") + F.col("length")).alias("end"))))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    n_hit = F.aggregate("spans", start, lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["at"], a["upto"]))).alias("n"), F.greatest(a["upto"], x["end"]).alias("upto")), lambda a: a["n"])
    of_doc = hits.groupBy("id", "text_hash").agg(sorted_spans.alias("spans")).select(F.col("id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), n_hit.cast("long").alias("hit"))
    items = hits.select("id", "text_hash", "window").distinct().join(near(windows.select("window", "item")), "window").select("id", "text_hash", "item").distinct()
    items = items.groupBy("id", "text_hash").agg(F.array_sort(F.collect_set("item")).alias("items")).select(F.col("id").alias("item_of"), F.col("text_hash").alias("item_hash"), "items")
    same = lambda a, b: F.col("id").eqNullSafe(F.col(a)) & (F.col("text_hash") == F.col(b))
    out = told.drop("runs").join(of_doc, same("hit_id", "hit_hash"), "left").join(items, same("item_of", "item_hash"), "left")
    named, n_hit = F.coalesce("items", F.array().cast("array<string>")), F.coalesce("hit", F.lit(0))
    out = out.select(
        F.col("id").cast(kind).alias(id_col),
        *[F.col("text_hash")] * with_hash,
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.cast("long").alias("n_hit"),
        F.size(named).cast("long").alias("n_items"),
        F.sha2(F.array_join(named, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        "copies",
        F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / COPIES))).alias("lot"),
    )
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.lit(COPIES), F.col("copies") - F.col("lot") * COPIES).cast("int")))).drop("copies", "lot", "copy")
