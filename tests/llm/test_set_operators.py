"""Near duplicates, decontamination, neighbours, sharding, WARC and the pipeline against brute force and odd rows."""

import hashlib
import base64
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinweave.llm import ann, components, decontam, neardup, registry, sharding, warc


def words(draw, n, pool=4000):
    return [f"w{draw.randrange(pool)}" for _ in range(n)]


def shingle_set(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(docs, n, percent=80):
    """Of each key: size of the set, the smallest key reachable. Keys may be anything that has an order."""
    sets = {i: shingle_set(t, n) for i, t in docs}
    part = {i: i for i in sets}

    def top(x):
        while part[x] != x:
            x = part[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                part[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


def near_copies(seed):
    draw = random.Random(seed)
    docs = []
    for _ in range(25):
        base = words(draw, draw.choice([1, 2, 4, 9, 30, 120]))
        for _ in range(draw.randrange(1, 7)):
            w = list(base)
            for _ in range(draw.randrange(0, max(2, len(w) // 12))):
                w[draw.randrange(len(w))] = f"x{draw.randrange(99)}"
            docs.append((len(docs), " ".join(w) if draw.random() < 0.7 else "  ".join(w).upper()))
    # A chain: each a near copy of the one before, the ends unlike.
    w = words(draw, 60)
    for k in range(8):
        docs.append((len(docs), " ".join(w)))
        for j in range(3):
            w[(7 * k + 20 * j) % 60] = f"y{k}{j}"
    return [*docs, (9000, None), (9001, ""), (9002, " \n\t"), (9003, "Solo"), (9004, "solo"), (9005, "w1 w2 " * 20_000)]


@pytest.mark.parametrize(("n", "seed"), [(2, 1), (5, 2)])
def test_near_duplicates_equal_brute_force(spark, n, seed):
    docs = near_copies(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": F.lit(1), "component_id": F.lit("x")}).repartition(5)
    rows = neardup.near_duplicates(df, n).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute_components(docs, n)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


@pytest.mark.parametrize(("texts", "buckets"), [(4, 4), (3, 8), (12, 2)])
def test_near_duplicates_in_blocks(spark, monkeypatch, texts, buckets):
    """Groups much larger than a block: in one only neighbours are near, in one all, in one there are several kinds."""
    monkeypatch.setattr(neardup, "TEXT_BLOCK", texts)
    monkeypatch.setattr(neardup, "BUCKET_BLOCK", buckets)
    docs = near_copies(4)
    draw = random.Random(6)
    for base in (words(draw, 100), words(draw, 100)):
        for k in range(30):
            w = list(base)
            w[draw.randrange(100)] = f"z{k}"
            # Half of them go half way to another text, under the threshold between but over it on either side.
            docs.append((20_000 + len(docs), " ".join(w if k % 2 else w[: 100 - 3 * (k % 5)])))
    rows = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 2).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute_components(docs, 2)


def test_links_survive_repeated_ids(spark):
    """Rows of one id with different texts keep the links of either."""
    draw = random.Random(9)
    a, b = words(draw, 80), words(draw, 80)
    other = lambda w, k: [*w[:k], "new", *w[k + 1 :]]
    docs = [(5, " ".join(a)), (5, " ".join(b)), (9, " ".join(other(a, 20))), (7, " ".join(other(b, 20))), (3, " ".join(other(other(b, 20), 60))), (5, " ".join(a)), (None, " ".join(a)), (5, None), (None, None)]
    rows = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), 2).collect()
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"], r["kept"]) for r in rows)
    assert got == sorted([(5, 79, 5, True), (5, 79, 3, False), (9, 79, 5, False), (7, 79, 3, False), (3, 79, 3, True), (5, 79, 5, True), (-1, 79, None, True), (5, 0, 5, True), (-1, 0, None, True)])


def test_registered_near_duplicates_equal_brute_force(spark):
    """The query as it is registered, over a whole table."""
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = registry.QUERIES["op2_near_duplicates"](spark, sf).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows} == {i: (n, c, i == c) for i, (n, c) in brute_components(docs, 2).items()}


def test_near_duplicates_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (3, "a b c")], "doc_id long, text string")
    rows = sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in neardup.near_duplicates(df, 2).collect())
    assert rows == [(-1, None, True), (1, 1, True), (1, 1, True), (3, 1, False)]
    assert neardup.near_duplicates(df.limit(0), 2).count() == 0


def test_keys_meet_within_the_guarantee():
    """Signatures that differ in up to 15 symbols, wherever, share a key."""
    draw = np.random.default_rng(0)
    a = draw.integers(0, 1 << 16, (300, neardup.SYMBOLS), dtype=np.uint16)
    b = a.copy()
    for row in b:
        at = draw.choice(neardup.SYMBOLS, 15, replace=False)
        row[at] ^= 1
    assert ((neardup.keys(a) == neardup.keys(b)).any(1)).all()


@pytest.mark.parametrize(("hubs", "small"), [(20_000, 160_000), (1, 0)])
def test_components_of_paths_and_stars(spark, monkeypatch, hubs, small):
    monkeypatch.setattr(components, "HUBS", hubs)
    monkeypatch.setattr(components, "SMALL", small)
    monkeypatch.setattr(components, "FEW", 3)
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, k) for k in range(8, 30)] + [(3, 3)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {k: 7 for k in range(7, 30)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_hits(docs, items, span=10):
    split = lambda t: __import__("re").findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    out = {}
    grams = {}
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - span + 1)) if w else ():
            grams.setdefault(tuple(w[k : k + span]), set()).add(i)
    for i, t in docs:
        w, hit, found = split(t), set(), set()
        for size in {len(g) for g in grams}:
            for k in range(len(w) - size + 1):
                g = tuple(w[k : k + size])
                if g in grams:
                    hit.update(range(k, k + size))
                    found |= {str(x) for x in grams[g] if x is not None}
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize(("broadcast_spans", "broadcast_runs"), [(200_000, 500_000), (0, 0)])
def test_decontamination_equals_brute_force(spark, monkeypatch, broadcast_spans, broadcast_runs):
    draw = random.Random(8)
    items = [(k, " ".join(words(draw, draw.choice([1, 3, 5, 9, 10, 14, 40]), 60))) for k in range(12)] + [(50, None), (51, ""), (None, " ".join(words(draw, 12))), (52, "same same same same same same same same same same same"), (2, "déjà Vu déjà Vu"), (53, "Äb " * 12)]
    docs = []
    for i in range(80):
        w = words(draw, draw.choice([0, 2, 8, 30, 200]), 60)
        if draw.random() < 0.6 and (t := draw.choice(items)[1]):
            own = t.split()
            a = draw.randrange(len(own) + 1) if draw.random() < 0.5 else 0
            at = draw.randrange(len(w) + 1)
            w[at:at] = [x.upper() if draw.random() < 0.2 and x.isascii() else x for x in own[a:]]
        docs.append((i, ", ".join(w) if i % 3 else "\n".join(w)))
    docs += [(900, None), (901, ""), (902, "same " * 30), (903, "ÄB äb Äb " * 20), (None, docs[3][1])]
    monkeypatch.setattr(decontam, "COPIES", 2)
    df = spark.createDataFrame([*docs, docs[5], docs[5], docs[5], docs[5]], "doc_id long, text string").withColumns({"print": F.lit(1), "at": F.lit("x"), "n_hit": F.lit(0)}).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("window", F.lit("w"))
    rows = decontam.decontaminate(df, bench, broadcast_spans=broadcast_spans, broadcast_runs=broadcast_runs).collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in rows}
    assert len(rows) == len(docs) + 4
    assert got == brute_hits(docs, items)


def test_a_document_of_two_thousand_items(spark):
    """A leaked benchmark in one document takes time in proportion to its length."""
    draw = random.Random(12)
    items = [(k, " ".join(words(draw, 30, 900))) for k in range(2000)]
    docs = [(1, " ".join(t for _, t in items)), (1, "another text of this id " * 30), (3, items[7][1])]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    began = time.monotonic()
    rows = {(r["doc_id"], r["n_words"]): r for r in decontam.decontaminate(df, bench, with_hash=True).collect()}
    assert time.monotonic() - began < 60
    want = brute_hits([(1, docs[0][1])], items)[1]
    assert tuple(rows[1, 60_000])[2:] == want and want[1:3] == (60_000, 2000)
    assert not rows[1, 150]["contaminated"] and rows[3, 30]["n_items"] == 1


def test_decontamination_of_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [r["contaminated"] for r in decontam.decontaminate(docs, bench).collect()] == [False]
    assert decontam.decontaminate(docs.limit(0), bench).count() == 0


def test_hilbert_is_a_curve():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[range(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        order = ann.hilbert(cells, bits)
        assert sorted(order) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(order)], axis=0)).sum(1) == 1).all()


def test_neighbours(spark):
    draw = np.random.default_rng(2)
    v = draw.normal(size=(900, 16)) * draw.uniform(0.5, 2, (900, 1))  # norms differ
    v[100:160] = v[100]
    rows = [(i, [float(x) for x in v[i]]) for i in range(900)] + [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [1.0] * 15 + [None]), (2080, [float("inf")] * 16), (2100, [1.0]), (None, [1.0] * 16), (20, [float(x) for x in v[20]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"rank": F.lit(1), "id": F.lit(2), "v": F.lit(3)})
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert sorted(got) == list(range(0, 900, 20))
    hits = 0
    for q, found in got.items():
        assert sorted(found) == list(range(1, 21))
        # Scores are the exact inner products, in order, ties by id; and nearly all of the true ones are there.
        assert all(abs(s - v[q] @ v[i]) < 1e-9 for i, s in found.values())
        assert [found[k] for k in range(1, 21)] == sorted(found.values(), key=lambda x: (-x[1], x[0]))
        true = sorted((i for i in range(900) if i != q), key=lambda i: (-(v[i] * v[q]).sum(), i))[:20]
        hits += len({i for i, _ in found.values()} & set(true))
    assert hits / (20 * len(got)) >= 0.9


def test_few_vectors(spark):
    df = spark.createDataFrame([(20, [1.0, 0.0]), (21, [0.5, 0.5]), (22, [0.5, 0.5])], "vec_id long, embedding array<float>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(df, F.col("vec_id") % 20 == 0, 20).collect()]
    assert sorted(got) == [(20, 1, 21), (20, 2, 22)]
    assert ann.nearest(df.where("vec_id > 20"), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_vectors_of_large_products_and_text_ids(spark):
    """Finite vectors whose norms or products overflow are ranked by the product, infinities first; ids may be strings."""
    big = 1e200
    rows = [("q0", [big, 0.0]), ("a", [big, big]), ("b", [2 * big, 1.0]), ("c", [1.0, 0.0]), ("d", [-big, 0.0]), ("e", [0.5, 3.0])]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    got = [(r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(df, F.col("vec_id").startswith("q"), 20).orderBy("rank").collect()]
    assert got == [(1, "a", float("inf")), (2, "b", float("inf")), (3, "c", big), (4, "e", big / 2), (5, "d", float("-inf"))]


def test_sharded_store(spark, tmp_path):
    rows = [(i, None if i % 7 == 0 else f"t{i} " * (i % 50), i % 3) for i in range(400)] + [(5, "twice", 1), (5, "twice", 1), (None, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, run int")
    store = sharding.Store(spark, f"file://{tmp_path}/s", target=4 << 10)
    for k in range(9):
        store.append(df.where(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(9)) == k))
    before = store.manifest()
    assert before[0] == 9 and len(before[1]) == 9
    after = store.compact()
    _, runs, _ = store.manifest()
    assert after > 9 and len(runs) < 9 and max(r.level for r in runs) >= 1
    assert all(len(g) == store.fanout for g in store._alike(runs)) is True and not store._alike(runs)
    key = lambda d: sorted(map(repr, d.collect()))
    assert key(store.read()) == key(df) == key(store.read(9))  # older versions stay readable until vacuum
    assert store.vacuum() >= 4 and key(store.read()) == key(df)
    assert key(sharding.Store(spark, f"file://{tmp_path}/s").read()) == key(df)
    assert store.versions() == [after]
    with pytest.raises(sharding.Conflict):
        store._commit(after, runs, df.schema)
    with pytest.raises(ValueError):
        store.append(df.drop("run"))
    assert store.manifest()[0] == after


def test_vacuum_spares_what_is_not_committed_yet(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "doc_id long, text string")
    one, two = (sharding.Store(spark, f"file://{tmp_path}/r") for _ in range(2))
    one.append(df.where("doc_id < 10"))
    version, runs, schema = two.manifest()
    new = two._write(df.where("doc_id >= 10").withColumn("run", F.lit(0)), "run", 0)
    assert one.vacuum() == 0
    two._commit(version + 1, runs + new, schema)
    assert one.read().count() == 20
    # What nobody commits goes when it is old; a commit of what is gone fails, and leaves the store as it was.
    left = two._write(df.withColumn("run", F.lit(0)), "run", 0)
    assert one.vacuum(grace=-1) == 1
    with pytest.raises(sharding.Conflict):
        two._commit(version + 2, runs + new + left, schema)
    assert one.read().count() == 20
    # A writer that is late by more than the manifests which vacuum() keeps.
    late = two.manifest()
    one.append(df.where("doc_id < 3"))
    one.append(df.where("doc_id < 3"))
    one.vacuum()
    with pytest.raises(sharding.Conflict):
        two._commit(late[0] + 1, late[1], late[2])
    assert one.read().count() == 26


def test_runs_that_are_alike_are_merged_whatever_is_smaller(spark, tmp_path):
    store = sharding.Store(spark, f"file://{tmp_path}/a")
    run = lambda n: sharding.Run(f"r{n}", n, 1, 0)
    assert [[r.bytes for r in g] for g in store._alike([run(n) for n in (10, 19, 21, 22, 23, 90)])] == [[19, 21, 22, 23]]


def test_shard_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.shard(df, f"file://{tmp_path}/e", F.lit(1)).count() == 0


def test_warc_round_trip(spark, tmp_path):
    html = [(1, "u1", "<p>a</p>"), (2, None, None), (3, "u3", ""), (4, "u\r\nX: 4", "<p>a</p>"), (5, "u5", "é漢\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"), (6, "u6", "x" * 2_000_000), (7, "u7", "<p>a</p>"), (7, "u7", "<p>a</p>"), (8, "u8", "é漢"), (None, "u9", "é漢"), (None, "u0", "alone")]
    df = spark.createDataFrame(html, "page_id long, url string, html string").withColumns({"record_type": F.lit(0), "id": F.lit("x")}).repartition(3)
    rows = warc.archive(df, f"file://{tmp_path}/w").collect()
    want = []
    for i, _, h in html:
        h = h or ""
        newest = max((j for j, _, g in html if (g or "") == h and j is not None), default=None)
        want.append((i, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "response" if i == newest else "revisit", None if i == newest else newest))
    assert sorted(map(repr, (tuple(r)[:5] for r in rows))) == sorted(map(repr, want))
    # Predicates reach the reader, which returns only what they let through.
    reader = warc.read_warc(spark, f"file://{tmp_path}/w").where("record_type = 'revisit' AND target_uri LIKE 'u%'")
    assert sorted(r["target_uri"] for r in reader.collect()) == ["u X: 4", "u1", "u9"]
    assert warc.read_warc(spark, f"file://{tmp_path}/w").where("record_type = 'response'").select(F.max(F.octet_length("payload"))).first()[0] is None
    large = warc.archive(df, f"file://{tmp_path}/v", least=100).where("record_type = 'revisit'")
    assert large.count() == 0
    assert warc.archive(df.limit(0), f"file://{tmp_path}/z").count() == 0


def test_pushed_filters_skip_records(tmp_path):
    from pyspark.sql.datasource import EqualTo, IsNotNull

    block = "HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nhi"
    record = lambda kind: f"WARC/1.1\r\nWARC-Type: {kind}\r\nContent-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n{block}\r\n\r\n"
    (tmp_path / "a.warc").write_text(record("response") + record("request") + record("response"), newline="")
    reader = warc.WarcReader({"path": f"file://{tmp_path}", "payload": "true"}, [c.split(" ")[0] for c in warc.SCHEMA.split(", ")])
    assert [*reader.pushFilters([EqualTo(("record_type",), "request"), IsNotNull(("record_type",)), EqualTo(("offset",), 3)])] == [EqualTo(("offset",), 3)]
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [(r["record_type"], r["payload"], r["payload_length"]) for r in rows] == [("request", b"hi", 2)]


def test_pipeline_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = corpus_pipeline.run(spark, sf).collect()
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = [(i, t) for i, t in docs if t and any(c.isalpha() for c in t)]
    near = brute_components(docs, 5)
    docs = [(i, t) for i, t in docs if near[i][1] == i]
    hits = brute_hits(docs, items)
    want = {i: hashlib.sha256(t.encode()).hexdigest() for i, t in docs if not hits[i][4]}
    assert {r["doc_id"]: r["decoded_sha256"] for r in rows} == want


def test_stages_keep_columns_and_bear_odd_rows(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", None, None, 0), (None, "ein Text mit Worten", "de", "s", 3), (4, "a text with words", None, "s", 3), (4, "a text with words", None, "s", 3)], "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        out.collect()
    assert corpus_pipeline.STAGES[0][1](spark, docs, sf).count() == 3
    assert corpus_pipeline.STAGES[0][1](spark, docs.limit(0), sf).count() == 0


def test_stages_tell_rows_of_one_id_apart(spark):
    """Rows of one id, and rows without one, stay or go each by its own text."""
    sf = "/root/testdata/sf0.001"
    item = spark.read.parquet(f"{sf}/benchmark.parquet").where("size(split(text, ' ')) > 12").first()["text"]
    draw = random.Random(3)
    a, b, c = (" ".join(words(draw, 60)) for _ in range(3))
    rows = [(1, a), (1, b), (2, a + " more"), (None, b + " more"), (None, c), (None, c + " more"), (3, item), (3, c[:200]), (None, item)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    told = lambda df: sorted((r["doc_id"] or -1, r["text"]) for r in df.collect())
    near = told(corpus_pipeline.near_duplicate(spark, docs, sf))
    assert len([t for _, t in near if t.startswith(c)]) == 1
    assert [x for x in near if not x[1].startswith(c)] == sorted([(1, a), (1, b), (3, item), (3, c[:200])])
    clean = told(corpus_pipeline.benchmark_decontamination(spark, docs, sf))
    assert clean == sorted((i or -1, t) for i, t in rows if t != item)


def test_every_operator_is_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in registry.QUERIES) == list(range(1, 11))
