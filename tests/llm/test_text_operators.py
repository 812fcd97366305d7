"""Language ID, BPE, token counts, LM scores and licences, with the odd rows that each must bear."""

import hashlib
import math
import random
import sys
import textwrap
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinweave.llm import bpe, langid, licences, lm, tokencount

LONG = "alpha beta gamma. " * 20_000
ODD = [(1, None), (2, ""), (3, "   \n"), (4, "1234 !!"), (5, LONG), (6, "same text here"), (6, "same text here"), (None, "no id"), (8, "tab\tand\x00nul\r\nline ½ é 漢字 🙂 <|endoftext|> x"), (9, "’s 's '’LL  　 ͸՘")]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with columns whose names clash with results."""
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"score": F.lit("mine"), "n_tokens": F.lit(-1), "id": F.lit(0), "lang": F.lit(None).cast("string")})


def texts():
    draw = random.Random(5)
    pools = ["abcdefgh THEre's 'll  \n\n019", "äöüßéñ çàô", "漢字かなкириллица", "՘͸⃀\U0001f9ff  \x85\x1c\xa0 ", "!?#%&*()[]{}"]
    return ["".join(draw.choice(draw.choice(pools)) for _ in range(draw.randrange(60))) for _ in range(3000)]


def test_bpe_equals_tiktoken():
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    encode = bpe.encoder(path, P.PATTERN)
    for t in [*texts(), LONG[:5000], "a" * 3000, "".join(map(chr, range(0x20, 0x2FF)))]:
        assert encode(t) == np.array(lib.encode_ordinary(t), dtype="<u4").tobytes(), t


def test_bpe_equals_plain_merges():
    """Against merging the lowest rank again and again, over a vocabulary small enough to reach its corners."""
    draw = random.Random(2)
    ranks = {bytes([b]): b for b in range(256)}
    while len(ranks) < 330:
        a, b = draw.choice(list(ranks)[97:100] + list(ranks)[256:]), draw.choice(list(ranks)[97:100] + list(ranks)[256:])
        if a + b not in ranks and len(a + b) < 9:
            own = bpe_plain(a + b, ranks)
            if len(own) == 2:
                ranks[a + b] = len(ranks)
    coder = bpe.Coder(ranks)
    for _ in range(3000):
        piece = bytes(draw.choice(b"abc") for _ in range(draw.randrange(1, 25)))
        assert coder.encode(piece) == ([ranks[piece]] if piece in ranks else bpe_plain(piece, ranks)), piece


def bpe_plain(piece, ranks):
    parts = [bytes([b]) for b in piece]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_bpe_rows(spark, odd):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    out = bpe.encode_decode(odd, path, P.PATTERN, keep=("score",), with_ids=True)
    assert out.columns == ["score", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"]
    rows = out.collect()
    assert len(rows) == len(ODD)
    by = {r["doc_id"]: r for r in rows}
    for i, t in ODD:
        assert by[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
        assert by[i]["n_tokens"] == len(by[i]["token_ids"])
        assert by[i]["ids_sha256"] == hashlib.sha256(np.array(by[i]["token_ids"], "<u4").tobytes()).hexdigest()
    back = {r["doc_id"]: r["text"] for r in bpe.decode(out, path).collect()}
    assert all(back[i] == (t or "") for i, t in ODD)
    assert bpe.encode_decode(odd.limit(0), path, P.PATTERN).count() == 0


def test_counts_equal_tokenizers(spark, odd):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    lib, count = Tokenizer.from_file(path), tokencount.counter(path)
    for t in [*texts(), "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "a" * 2000]:
        assert count(t) == len(lib.encode(t, add_special_tokens=False).ids), t
    rows = {r["doc_id"]: r for r in tokencount.count_tokens(odd, path, 1024).collect()}
    for i, t in ODD:
        assert rows[i]["n_bytes"] == len((t or "").encode())
        assert rows[i]["over_limit"] == (rows[i]["n_tokens"] > 1024)
    assert rows[1]["n_tokens"] == 0 and rows[5]["over_limit"]


def test_trees_code_every_byte(spark):
    trees = langid.ContextTrees({"a": [b"the cat sat on the mat", b"the hat"], "b": [b"der hund und die katze"]}, depth=3, most=40)
    cost = trees.cost.reshape(-1, trees.size + 1, 2)[:-1]
    mass = np.exp2(-cost[:, 1 : trees.size]).sum(1) + np.exp2(-cost[:, 0]) * (256 - trees.size + 1)
    assert np.allclose(mass, 1, atol=1e-5)
    bits = trees.bits([b"the cat", b"und der hund", b"\xff"])
    assert bits[0].argmin() == 0 and bits[1].argmin() == 1


def ppm_bits(sample, text, depth):
    """Code length by simulation: PPM-C with full exclusion under frozen counts, symbol by symbol."""
    counts = {}
    for t in sample:
        for i, s in enumerate(t):
            for d in range(min(i, depth) + 1):
                c = counts.setdefault(t[i - d : i], {})
                c[s] = c.get(s, 0) + 1
    bits = 0.0
    for i, s in enumerate(text):
        gone = set()
        for d in range(min(i, depth), -2, -1):
            if d < 0:
                bits += np.log2(256 - len(gone))
                break
            own = {k: n for k, n in counts.get(text[i - d : i], {}).items() if k not in gone}
            if not own:
                continue
            total = sum(own.values()) + len(own)
            if s in own:
                bits += np.log2(total / own[s])
                break
            bits += np.log2(total / len(own))
            gone |= set(own)
    return bits


def test_trees_equal_simulation():
    draw = random.Random(3)
    sample = [bytes(draw.choice(b"abcd ") for _ in range(60)) for _ in range(6)]
    trees = langid.ContextTrees({"x": sample}, depth=3, most=10_000)
    for _ in range(50):
        text = bytes(draw.choice(b"abcde ") for _ in range(draw.randrange(1, 30)))
        assert abs(trees.bits([text])[0, 0] - ppm_bits(sample, text, 3)) < 1e-3


def test_identify_learns_and_bears_odd_rows(spark, odd):
    draw = random.Random(1)
    made = [(100 + i, " ".join(draw.choice(w) for _ in range(30)), g) for i in range(120) for g, w in [[("en", ["the", "house", "with", "thing"]), ("de", ["der", "nicht", "haus", "schön"])][i % 2]]]
    docs = odd.unionByName(spark.createDataFrame(made, "doc_id long, text string, lang string"), allowMissingColumns=True)
    rows = langid.identify(docs, langid.crc_is(2)).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(ODD) + len(made)
    assert all(by[i]["lang_pred"] == g for i, _, g in made)
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (1, 2, 3, 4))
    assert all(0 <= r["score"] <= 1 for r in rows) and by[None]["held_out"] is False
    assert {r["lang_pred"] for r in langid.identify(odd, langid.crc_is(2)).collect()} == {"und"}  # nothing to learn from
    assert langid.identify(docs.limit(0), langid.crc_is(2)).count() == 0


@pytest.mark.parametrize("same", [None, 4])
def test_samples_are_bounded_whatever_the_ids(spark, same):
    """Rows without an id, or all of one id, are sampled by their texts: no more than the bound, and enough to learn."""
    pool = {"en": ["the", "house", "with", "thing"], "de": ["der", "nicht", "haus", "schön"]}
    draw = random.Random(1)
    rows = [(same, " ".join(draw.choice(w) for _ in range(30)), g) for _ in range(3000) for g, w in pool.items()] + [(same, "one text", "en")] * 2000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = langid.training_rows(docs, "doc_id", "lang", "text", langid.crc_is(9, 16), 50, 8000, 100)
    assert 50 <= len(sample) <= 160 and len(set(sample)) == len(sample)
    few = langid.training_rows(docs, "doc_id", "lang", "text", langid.crc_is(9, 16), 50, 10, 100)
    assert 2 <= len(few) <= 20
    long = langid.training_rows(docs.select("doc_id", "lang", F.repeat("text", 100).alias("text")), "doc_id", "lang", "text", langid.crc_is(9, 16), 50, 8000, 100)
    assert {len(r["text"]) for r in long} == {100}
    by = langid.identify(docs.dropDuplicates(), langid.crc_is(9, 16)).join(docs.select("lang").distinct(), F.col("lang") == F.col("lang_pred")).count()
    assert by == docs.dropDuplicates().count()
    assert {r["licences"] for r in licences.scan_licences(docs.select("doc_id", "text")).collect()} == {""}


def test_long_texts_are_walked_in_parts(monkeypatch):
    """Parts of any size give the same code lengths, and equal texts equal ones wherever they stand."""
    trees = langid.ContextTrees({"a": [b"the cat sat on the mat"], "b": [b"le chat est sur le tapis"]}, 3, 50)
    texts = [b"the chat " * 30, b"", b"x", b"le tapis", b"the chat " * 30]
    whole = trees.bits(texts)
    for part in (1, 2, 7, 64):
        monkeypatch.setattr(langid, "PART", part)
        own = trees.bits(texts)
        assert np.allclose(own, whole, rtol=1e-12) and (own[0] == own[4]).all() and (own[1] == 0).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(docs, langid.crc_is(2)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.98


def by_definition(net, s):
    """log p of each symbol of a text, one at a time and in double precision, from a softmax over all symbols."""
    p = {k: v.astype(float) for k, v in net.parts.items()}
    s = [0] * lm.WINDOW + list(s) + [0] * lm.WINDOW
    out = []
    for i in range(lm.WINDOW, len(s) - lm.WINDOW):
        h = np.round(np.tanh(sum(p["near"][k][s[i + d]] for k, d in enumerate(lm.PLACES)) + p["inner"]) * 64) / 64
        group, member = p["group"] @ h + p["group_bias"], p["member"] @ h + p["member_bias"]
        every = (group - np.log(np.exp(group).sum()))[:, None] + member - np.log(np.exp(member).sum(1, keepdims=True))
        assert abs(np.exp(every).sum() - 1) < 1e-9
        out.append(every.ravel()[s[i]])
    return out


def test_network_learns_the_gap(spark, odd):
    words = [f"w{k}" for k in range(20)]
    docs = spark.createDataFrame([(i, " ".join(words[(i + j) % 20] for j in range(40))) for i in range(60)] + [(1000, " ".join(words[(7 * j * j) % 20] for j in range(40)))], "doc_id long, text string")
    model = lm.train(docs)
    by = {r["doc_id"]: r for r in lm.score(docs, model).collect()}
    # Under a model that did not see it, the document of another order is far less likely.
    unseen = {r["doc_id"]: r["mean_log_likelihood"] for r in lm.score(docs, lm.train(docs.where("doc_id < 1000"))).collect()}
    assert unseen[1000] < min(unseen[i] for i in range(60)) - 1
    # Against the sum over tokens, one at a time.
    of = lm.symbol_of(model.vocabulary)
    assert abs(by[3]["log_likelihood"] - sum(by_definition(model.network, [of(w.encode()) for w in docs.where("doc_id = 3").first()["text"].split()]))) < 1e-3
    rows = {r["doc_id"]: r for r in lm.pseudo_likelihood(odd).collect()}
    assert rows[1]["n_tokens"] == 0 and rows[2]["log_likelihood"] == 0 and rows[3]["mean_log_likelihood"] is None
    assert lm.pseudo_likelihood(odd.limit(0)).count() == 0


def test_network_steps_down_the_gradient():
    """The loss is the mean negative log-probability by definition, its gradient the slope taken by small differences, and
    steps lessen it."""
    draw = np.random.default_rng(4)
    token = draw.integers(0, lm.SYMBOLS, 300) // 40 * 40
    context = draw.integers(0, lm.SYMBOLS, (2 * lm.WINDOW, 300)) // 40 * 40
    n = draw.integers(1, 9, 300)
    weight = n / n.sum()
    net = lm.Network(np.bincount(token, weights=n, minlength=lm.SYMBOLS))
    net.parts = {k: v.astype(np.float64) for k, v in net.parts.items()}

    def loss():
        p = net.parts
        h = np.tanh(sum(p["near"][k][context[k]] for k in range(2 * lm.WINDOW)) + p["inner"])
        group, member = h @ p["group"].T + p["group_bias"], np.einsum("nh,gmh->ngm", h, p["member"]) + p["member_bias"]
        every = (group - np.log(np.exp(group).sum(1, keepdims=True)))[:, :, None] + member - np.log(np.exp(member).sum(2, keepdims=True))
        return -float(weight @ every.reshape(300, -1)[np.arange(300), token])

    told, grad = net.gradient(context, token, weight)
    assert abs(told - loss()) < 1e-9
    for name, own in net.parts.items():
        largest = np.argsort(-np.abs(grad[name]), axis=None)[:4]
        for at in [*largest, *draw.integers(0, own.size, 4)]:
            place = np.unravel_index(at, own.shape)
            kept = own[place]
            own[place] = kept + 1e-5
            up = loss()
            own[place] = kept - 1e-5
            slope = (up - loss()) / 2e-5
            own[place] = kept
            assert abs(slope - grad[name][place]) < 1e-7, (name, place)
    code = np.zeros(300, np.int64)
    for column in [*context, token]:
        code = code * lm.SYMBOLS + column
    net = lm.Network(np.bincount(token, weights=n, minlength=lm.SYMBOLS))
    back = lm.digits(code)
    assert (back[0] == context).all() and (back[1] == token).all()
    losses = net.fit(code, n)
    assert len(losses) == lm.STEPS and losses[-1] < losses[0] - 0.5


def test_a_token_scores_alike_in_any_batch():
    draw = np.random.default_rng(5)
    net = lm.Network(draw.integers(1, 99, lm.SYMBOLS))
    net.parts["member"] *= 20  # too large to do without a shift
    alike, net = lm.Network(draw.integers(1, 99, lm.SYMBOLS)).rounded(), net.rounded()
    token, context = draw.integers(0, lm.SYMBOLS, 40_000), draw.integers(0, lm.SYMBOLS, (2 * lm.WINDOW, 40_000))
    for own in (net, alike):
        whole = own.log_p(context, token)
        assert (whole < 0).all()
        for lo, hi in [(0, 1), (5, 12), (777, 20_001), (39_990, 40_000)]:
            assert (own.log_p(context[:, lo:hi], token[lo:hi]) == whole[lo:hi]).all()


def test_windows_mask_every_text(spark):
    """Each text's masked windows, counted over all partitions alike."""
    texts = ["a b a c d e f g h i j", "a b a c d e f g h i j", None, "", "b", "x " * 50]
    voc = ["a", "b"]
    of = lm.symbol_of(voc)
    want = Counter()
    for text in texts:
        s = [0] * lm.WINDOW + [of(w.encode()) for w in (text or "").split()] + [0] * lm.WINDOW
        for i in range(lm.WINDOW + zlib.crc32((text or "").encode()) % lm.MASKED, len(s) - lm.WINDOW, lm.MASKED):
            code = 0
            for x in [s[i - 2], s[i - 1], s[i + 1], s[i + 2], s[i]]:
                code = code * lm.SYMBOLS + x
            want[code] += 1
    docs = spark.createDataFrame([(1, t) for t in texts], "doc_id long, text string")
    for parts in (1, 3):
        got = Counter()
        for r in lm.windows(docs.repartition(parts), "text", voc).collect():
            got[r["code"]] += r["n"]
        assert got == want
    assert sum(want.values()) >= 2 + 6


def test_every_token_is_trained_on(spark, monkeypatch):
    """In MASKED turns each token of each text is masked once, and all turns are trained: whatever its hash, a text of a
    single word moves the network."""
    texts = ["a b a c d e f g h i j", "a b a c d e f g h i j", None, "", "b", "x " * 50]
    voc = ["a", "b"]
    of = lm.symbol_of(voc)
    want = Counter()
    for text in texts:
        s = [0] * lm.WINDOW + [of(w.encode()) for w in (text or "").split()] + [0] * lm.WINDOW
        for i in range(lm.WINDOW, len(s) - lm.WINDOW):
            code = 0
            for x in [s[i - 2], s[i - 1], s[i + 1], s[i + 2], s[i]]:
                code = code * lm.SYMBOLS + x
            want[(i - lm.WINDOW - zlib.crc32((text or "").encode())) % lm.MASKED, code] += 1
    docs = spark.createDataFrame([(1, t) for t in texts], "doc_id long, text string")
    found = lm.windows(docs.repartition(3), "text", voc, lm.MASKED)
    got = Counter()
    for r in found.collect():
        got[r["turn"], r["code"]] += r["n"]
    assert got == want and sum(got.values()) == 11 + 11 + 1 + 50
    dealt = Counter()
    monkeypatch.setattr(lm, "SHARD", 3)
    bundles = lm.deal(lm.windows(docs, "text", voc, lm.MASKED, lm.shard_count(73)), 73).collect()
    assert {r["shard"] for r in bundles} == {0, 1, 2, 3}
    for r in bundles:
        for code, n in zip(lm.unpacked(pa.py_buffer(r["codes"]), r["size"]).tolist(), lm.unpacked(pa.py_buffer(r["n"]), r["size"]).tolist(), strict=True):
            dealt[r["turn"], code] += n
    assert dealt == want
    for word in [next(w for w in "abcdefghij" if zlib.crc32(w.encode()) % lm.MASKED), *"ab"]:
        model = lm.train(spark.createDataFrame([(1, word)], "doc_id long, text string"))
        assert not np.allclose(model.network.flat(), lm.Network(model.totals).rounded().flat(), atol=1e-2)


def test_words_and_their_symbols():
    """Words, checksums and symbols that are found for a whole batch at once, against one text and word at a time."""
    texts = pa.array([None, "", " ", " a  B\tc ", "É x\x0by\x1cz q", "x" * 200 + " y", None, "d" * 63 + " " + "e" * 64 + " " + "f" * 65], pa.string())
    voc = ["a", "q", "é"]
    of = lm.symbol_of(voc)
    for own in (texts, texts.slice(1), texts.slice(3, 2), texts.slice(0, 3), texts.cast(pa.large_string())):
        want = [(t.as_py() or "").encode().lower().split() for t in own]
        words, counts = lm.split(own)
        assert [w.encode() for w in words.to_pylist()] == [w for ws in want for w in ws] and counts.tolist() == [len(ws) for ws in want]
        place, found = lm.symbols(words, pa.array(voc), 1 + lm.CLASSES + np.arange(3))
        assert found.tolist() == [of(w) for ws in want for w in ws] and ((place < 0) == (found <= lm.CLASSES)).all()
        assert lm.crc32(words.take(pa.array(range(len(words)), pa.int64()))).tolist() == [zlib.crc32(w) for ws in want for w in ws]


def test_no_call_for_each_word(spark):
    """Counting words and finding windows are steps over batches: they make fewer calls than there are words."""

    class Caught:
        def mapInArrow(self, run, _):
            self.run = run
            return self

        select = groupBy = agg = lambda self, *_: self

    draw = random.Random(3)
    texts = pa.array([" ".join(f"w{int(draw.paretovariate(0.6)) % 5000}" for _ in range(500)) for _ in range(40)])
    docs, made = Caught(), Counter()
    for call in (lambda: lm.word_counts(docs, "text"), lambda: lm.windows(docs, "text", [f"w{k}" for k in range(300)], lm.MASKED, 2)):
        call()
        made.clear()
        sys.setprofile(lambda _, event, __: made.update([event]))
        rows = list(docs.run(iter([pa.RecordBatch.from_arrays([texts], ["text"])])))
        sys.setprofile(None)
        assert rows and made["call"] + made["c_call"] < 20_000 / 4


def test_a_step_is_adams(monkeypatch):
    """Against Adam as it is written, in parts that don't divide the stretches, one of which has a prior."""
    monkeypatch.setattr(lm, "PART", 7)
    draw = np.random.default_rng(9)
    flat = draw.normal(size=30)
    want, m, v, first, second = flat.copy(), 0.0, 0.0, np.zeros(30), np.zeros(30)
    pull = np.where(np.arange(30) < 20, 0.3, 0)
    for step in range(1, 6):
        slope = draw.normal(size=30)
        g = slope + pull * want
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        want -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9 / np.sqrt(1 - 0.99**step))
        lm.descend(flat, slope, first, second, [(0, 20, 0.3), (20, 30, 0)], 0.02 * np.sqrt(1 - 0.99**step) / (1 - 0.9**step))
        assert np.allclose(flat, want, rtol=1e-12, atol=1e-12)


def test_shards_are_trained_apart_and_averaged(spark, monkeypatch):
    """Against training them one after the other, however the windows are split."""
    draw = np.random.default_rng(6)
    start = lm.Network(draw.integers(1, 99, lm.SYMBOLS))
    monkeypatch.setattr(lm, "SHARD", 200)
    rows = [(int(c), 1 + int(c) % 4) for c in draw.integers(0, lm.SYMBOLS**5, 500)]
    df = spark.createDataFrame(rows + rows[:50], "code long, n long")
    shard_of = dict(df.select("code", F.pmod(F.xxhash64("code"), F.lit(3))).collect())
    counts = Counter()
    for c, n in rows + rows[:50]:
        counts[c] += n
    want, total = 0.0, 0
    for shard in range(3):
        own = start.take(start.flat())
        codes = sorted((c for c in counts if shard_of[c] == shard), key=lambda c: c * 0x9E3779B97F4A7C15 % 2**64)
        own.fit(np.array(codes), np.array([counts[c] for c in codes]), 1)
        want, total = want + own.flat().astype(float) * len(codes), total + len(codes)
    for parts in (1, 4):
        got = lm.trained(lm.deal(df.repartition(parts), 600 * lm.MASKED - 1), start, 1)
        assert np.allclose(got.flat(), want / total, atol=1e-4)


def test_many_shards_are_averaged_in_steps(spark, monkeypatch):
    """Three levels of averages of two make the mean of all, with several shards in a partition; a corpus whose few words
    are not masked leaves the network as it is."""
    draw = np.random.default_rng(8)
    start = lm.Network(draw.integers(1, 99, lm.SYMBOLS))
    monkeypatch.setattr(lm, "SHARD", 50)
    df = spark.createDataFrame([(int(c), 1) for c in draw.integers(0, lm.SYMBOLS**5, 300)], "code long, n long")
    whole = lm.trained(lm.deal(df, 250 * lm.MASKED - 1), start, 0)
    monkeypatch.setattr(lm, "FAN", 2)
    monkeypatch.setattr(lm, "PARTITIONS", 2)
    steps = lm.trained(lm.deal(df, 250 * lm.MASKED - 1), start, 0)
    assert np.allclose(whole.flat(), steps.flat(), atol=1e-5) and not np.allclose(steps.flat(), start.flat(), atol=1e-2)
    word = next(w for w in "abcdefghij" if zlib.crc32(w.encode()) % lm.MASKED)
    docs = spark.createDataFrame([(1, word)], "doc_id long, text string")
    assert lm.pseudo_likelihood(docs).first()["n_tokens"] == 1


def test_every_word_is_predicted(spark, monkeypatch):
    """Against the definition, with rare words that are joined and, by HEAD, ones that are broadcast."""
    draw = random.Random(2)
    texts = [" ".join(f"w{int(draw.paretovariate(0.6)) % 900}" for _ in range(50)) for _ in range(120)] + ["solo0 w1 w2", "w1 Twice3 w2", "twice3"]
    docs = spark.createDataFrame([(None if i == 5 else i // 2, t) for i, t in enumerate(texts)] + [(7, "w1 unseen4 w2")], "doc_id long, text string")
    counts = Counter(w for t in texts for w in t.lower().split())
    monkeypatch.setattr(lm, "VOCABULARY", 128)  # leaves words of so small a corpus to the classes
    model = lm.train(docs.where("text NOT LIKE '%unseen%'"))
    of = lm.symbol_of(model.vocabulary)
    total = Counter()
    for w, n in counts.items():
        total[of(w.encode())] += n
    assert len(counts) > lm.VOCABULARY + 100

    def by_hand(text):
        w = text.lower().split()
        s = [of(x.encode()) for x in w]
        inside = [0.0 if x in model.vocabulary else math.log(max(counts[x], 1) / (1 + total[k])) for x, k in zip(w, s, strict=True)]
        return sum(inside) + sum(by_definition(model.network, s))

    want = sorted(by_hand(r["text"]) for r in docs.collect())
    for head in (lm.HEAD, 300):
        monkeypatch.setattr(lm, "HEAD", head)
        rows = lm.score(docs, model).collect()
        assert np.allclose(sorted(r["log_likelihood"] for r in rows), want, atol=1e-3)
    # A rare word for another of its class changes the score.
    rare = next(w for w in counts if counts[w] > 1 and w not in model.vocabulary)
    twin = next(f"x{k}" for k in range(9999) if of(f"x{k}".encode()) == of(rare.encode()))
    got = {r["doc_id"]: r["log_likelihood"] for r in lm.score(spark.createDataFrame([(1, f"w1 {rare} w2"), (2, f"w1 {twin} w2")], "doc_id long, text string"), model).collect()}
    assert abs(got[1] - got[2] - math.log(counts[rare])) < 1e-6


def test_licences(spark, odd):
    plain = spark.createDataFrame([(100 + i, f"word{i} stone river lamp\nthe hill of {i} and a cloud in the night") for i in range(60)], "doc_id long, text string")
    marked = [(500, "one\nReleased under the MIT License.\ntwo"), (501, "Licensed under the Apache License, Version 2.0."), (502, "This work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0."), (503, "Licensed under the Zope Public License 2.1"), (504, "The licence of poets to lie."), (505, "RELEASED UNDER THE MIT LICENSE")]
    docs = odd.select("doc_id", "text", "score").unionByName(plain, allowMissingColumns=True).unionByName(spark.createDataFrame(marked, "doc_id long, text string"), allowMissingColumns=True)
    by = {r["doc_id"]: r for r in licences.scan_licences(docs).collect()}
    assert [by[i]["licences"] for i in range(500, 506)] == ["MIT", "Apache-2.0", "CC-BY-NC-4.0,GPL-3.0", "unknown", "", "MIT"]
    assert by[500]["n_paragraphs"] == 3 and by[502]["n_licence"] == 2
    assert all(by[100 + i]["licences"] == "" for i in range(60))
    assert all(by[i]["n_paragraphs"] == 0 for i in (1, 2, 3))
    assert licences.scan_licences(docs.limit(0)).count() == 0


def scan_plainly(scanner, text):
    """Scanner.scan() of a text, by definition: n-grams as sets, a dense sum of weights, every line at a time."""
    weights = {(w,): scanner.weights[i + scanner.bases[0]] for w, i in scanner.word.items()}
    named = {i: w for w, i in scanner.word.items()}
    pairs = {}
    for a, b in np.argwhere(scanner.pair):
        pairs[scanner.pair[a, b]] = (named[a], named[b])
        weights[named[a], named[b]] = scanner.weights[scanner.pair[a, b] + scanner.bases[1]]
    for p, c in np.argwhere(scanner.triple):
        weights[(*pairs[p], named[c])] = scanner.weights[scanner.triple[p, c] + scanner.bases[2]]

    def chances(tokens):
        known = [g for g in licences.ngrams(tokens) if g in weights]
        z = sum((weights[g] for g in known), np.zeros(len(scanner.families))) / math.sqrt(max(len(tokens), 4)) * scanner.scale + scanner.bias
        return licences.softmax(z[None] / scanner.temperature)[0], bool(known)

    found, most, n = Counter(), 0.0, 0
    for block in [[]] if not text else [[x for x in b if x] for b in split_blocks(text)]:
        n += len(block)
        taken = set()
        if len(block) > 1:
            for i, j in licences.runs(block, scanner.templates):
                tokens = [w for x in block[i:j] for w in x]
                name, sure = scanner.verdict(tokens, chances(tokens)[0])
                if name != licences.UNKNOWN:
                    taken.update(range(i, j))
                    found[name] += 1
                    most, n = max(most, sure), n - (j - i - 1)
        for k, tokens in enumerate(block):
            p, known = chances(tokens)
            if k not in taken and known and p[0] < 0.5:
                name, sure = scanner.verdict(tokens, p)
                found[name] += 1
                most = max(most, sure)
    return n, dict(found), most


def split_blocks(text):
    out = [[]]
    for x in text.split("\n"):
        w = licences.words(x)
        out.append([]) if not w else out[-1].append(w)
    return out


def test_scanner_equals_a_plain_one(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    draw = random.Random(7)
    notices = [t for ts in licences.TEMPLATES.values() for t in ts]
    lines = [x for t in texts if t for x in t.split("\n") if len(x) < 200][:400]
    for _ in range(60):
        own = [draw.choice(lines) for _ in range(draw.randrange(6))]
        for _ in range(draw.randrange(3)):
            t = draw.choice(notices)
            own[draw.randrange(len(own) + 1) : 0] = textwrap.wrap(t, draw.choice([40, 60, 400])) + [""] * draw.randrange(2)
        texts.append("\n".join(own))
    scanner = licences.Scanner(sorted(lines)[:200])
    got = scanner.scan(texts)
    assert sum(bool(x[1]) for x in got) > 40
    for text, (n, found, most) in zip(texts, got, strict=True):
        want = scan_plainly(scanner, text)
        assert (n, found) == want[:2] and abs(most - want[2]) < 1e-4, text


def test_wrapped_notices():
    plain = [f"word{i} stone river lamp and a cloud in the night" for i in range(60)]
    scanner = licences.Scanner(plain)
    missed = []
    for family, notices in licences.TEMPLATES.items():
        for notice in notices:
            for width in (35, 50, 65, 79):
                for mark in ("", "# ", " * "):
                    lines = textwrap.wrap(notice, width)
                    text = "\n".join([*(mark + x for x in lines), "", "word3 lamp", "word1 stone river lamp"])
                    n, found, _ = scanner.scan(["some text", text, None])[1]
                    if found != {family: 1} or n != 3:
                        missed.append((family, width, mark, n, found, notice))
    assert not missed, missed
    # Within a block; two one-line notices side by side; a blank line and a text's end part paragraphs.
    gpl = textwrap.wrap(licences.TEMPLATES["GPL-3.0"][1], 70)
    n, found, _ = scanner.scan(["\n".join(["word1 stone river lamp", *gpl, "word2 stone river lamp"])])[0]
    assert (n, found) == (3, {"GPL-3.0": 1}), (n, found)
    assert scanner.scan(["Released under the MIT License.\nLicensed under CC BY-NC 4.0."])[0][1] == {"MIT": 1, "CC-BY-NC-4.0": 1}
    assert all("GPL-3.0" not in x[1] for x in scanner.scan(["\n".join(gpl[:1]), "\n".join(gpl[1:2]), "\n\n".join(gpl)]))
    # Wrapped notices of the corpus don't teach `none`.
    assert licences.plain_lines("\n".join(["one", "", *gpl, "", "two"]), scanner.templates) == ["one", "two"]


def test_a_worker_keeps_the_tables_of_one_operator():
    """A worker that encoded and then identifies languages has no encoder any more; one that goes on encoding keeps it."""
    from kinweave.llm import base

    path = P.path("byte_bpe_multi_50k.tiktoken")
    base.turn("bpe")
    bpe.encoder(path, P.PATTERN)("some text")
    base.turn("bpe")
    assert bpe.encoder.cache_info().currsize > 0 and bpe.coder.cache_info().currsize > 0
    base.turn("langid")
    assert bpe.encoder.cache_info().currsize == bpe.coder.cache_info().currsize == 0
