"""Language identification by prediction by partial matching (operator 1).

For each language a variable-order tree of byte contexts is learned and then frozen. A byte costs what PPM with escape
method C and full exclusion would spend on it: the longest context seen predicts it, or spends an escape and leaves it,
without the bytes it has ruled out, to the next shorter one, down to a uniform code over 256 bytes. The language whose
tree codes the whole text shortest is predicted.

Statistics are frozen, so the cost of every (context, byte) is a constant. They are laid out once as a table over the
union of the languages' contexts, and a text is scored by walking all its positions down the tree at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import pieces, ship, turn

LETTER = regex.compile(r"\p{L}")
#: Numbers in the table of costs: 128 MB.
CELLS = 32_000_000
#: Positions that are walked at once.
PART = 1 << 17


class ContextTrees:
    """Frozen trees of several languages: samples maps a language to the texts that it is learned from.

    depth is the longest context in bytes. For each language `most` contexts are held, those with the largest share of some
    language's bytes, unless the table of all languages would exceed CELLS numbers.
    """

    def __init__(self, samples: dict[str, list[bytes]], depth: int = 4, most: int = 3_000):
        self.langs, self.depth = sorted(samples), depth
        joined = {g: b"".join(samples[g]) for g in self.langs}
        seen = np.zeros(256, bool)
        for text in joined.values():
            seen[np.unique(np.frombuffer(text, np.uint8))] = True
        self.size = int(seen.sum()) + 1  # symbol 0 stands for the bytes that no sample has
        self.symbol = np.zeros(257, np.int32)
        self.symbol[:256][seen] = np.arange(1, self.size)
        self.symbol[256] = self.size  # stands between texts
        grams = {g: self._grams(samples[g]) for g in self.langs}
        self._build(grams, most)

    def _stream(self, texts: list[bytes]) -> np.ndarray:
        """Symbols of the texts, each after `depth` separators."""
        gap = np.full(self.depth, self.size, np.int32)
        parts = [x for t in texts for x in (gap, self.symbol[np.frombuffer(t, np.uint8)])]
        return np.concatenate([*parts, gap])

    def _grams(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """By length from 0 to depth: codes of (context, next symbol) and their counts; the nearest symbol counts lowest."""
        base, s = self.size + 1, self._stream(texts).astype(np.int64)
        at = np.flatnonzero(s != self.size)
        out = []
        context, whole = np.zeros(len(at), np.int64), np.ones(len(at), bool)
        for d in range(self.depth + 1):
            if d:
                before = s[at - d]
                whole &= before != self.size
                context = context + before * base ** (d - 1)
            out.append(np.unique(context[whole] * base + s[at[whole]], return_counts=True))
        return out

    def _build(self, grams: dict, most: int) -> None:
        base, langs = self.size + 1, self.langs
        # Contexts by level, those of the largest share in a language; a context's suffixes have at least its own.
        most = min(most * len(langs), CELLS // (base * len(langs)))
        levels, totals = [], []
        for d in range(self.depth + 1):
            codes = np.concatenate([grams[g][d][0] // base for g in langs])
            nodes, back = np.unique(codes, return_inverse=True)
            # The counts of a language's contexts, then the largest share that one has in any.
            own = back + np.repeat(np.arange(len(langs)), [len(grams[g][d][0]) for g in langs]) * len(nodes)
            counts = np.bincount(own, weights=np.concatenate([grams[g][d][1] for g in langs]), minlength=len(nodes) * len(langs)).reshape(len(langs), -1)
            levels.append(nodes)
            totals.append((counts / np.array([max(1, int(grams[g][0][1].sum())) for g in langs])[:, None]).max(0, initial=0))
        least = np.sort(np.concatenate(totals[1:]))[::-1][most - 1] if sum(map(len, totals[1:])) > most else 0
        levels = [n[t > least] if d else n for d, (n, t) in enumerate(zip(levels, totals, strict=True))]
        starts = np.cumsum([0, *map(len, levels)])
        n = int(starts[-1])
        self.dead = n
        self.child = np.full((n + 1, base), n, np.int32)
        self.cost = np.zeros((n + 1, base, len(langs)), np.float32)
        parents = [np.zeros(1, np.int64)]
        for d in range(1, self.depth + 1):
            far, suffix = levels[d] // base ** (d - 1), levels[d] % base ** (d - 1)
            up = np.searchsorted(levels[d - 1], suffix)
            parents.append(up)
            self.child[starts[d - 1] + up, far] = starts[d] + np.arange(len(far))
        for k, g in enumerate(langs):
            above = None
            for d in range(self.depth + 1):
                count = np.zeros((len(levels[d]), self.size))
                codes, n_of = grams[g][d]
                row = np.searchsorted(levels[d], codes // base)
                row[row == len(levels[d])] = 0
                held = levels[d][row] == codes // base if len(levels[d]) else np.zeros(len(codes), bool)
                count[row[held], codes[held] % base] = n_of[held]
                above = self._costs(count, *(x[parents[d]] for x in above)) if above else self._root(count)
                self.cost[starts[d] : starts[d + 1], : self.size, k] = above[0]
        self.cost = self.cost.reshape(-1, len(langs))

    @staticmethod
    def _own(count: np.ndarray, below: np.ndarray) -> np.ndarray:
        total, kinds, seen = count.sum(1, keepdims=True), (count > 0).sum(1, keepdims=True), count > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(seen, np.log2((total + kinds) / np.where(seen, count, 1)), np.log2((total + kinds) / kinds) + below)

    def _root(self, count: np.ndarray) -> tuple:
        kinds = int((count > 0).sum())
        below = np.full(count.shape, np.log2(256 - kinds) if kinds < 256 else 0.0)
        return (self._own(count, below) if kinds else np.full(count.shape, 8.0)), below, count

    def _costs(self, count: np.ndarray, up_cost: np.ndarray, up_below: np.ndarray, up_count: np.ndarray) -> tuple:
        """Of each context of a level: bits of every symbol, bits after an escape, counts."""
        seen = count > 0
        left = np.where(seen, 0, up_count)
        total, kinds = left.sum(1, keepdims=True), (left > 0).sum(1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(kinds > 0, np.log2((total + kinds) / np.maximum(kinds, 1)), 0.0)
            below = np.where(left > 0, np.log2((total + kinds) / np.where(left > 0, left, 1)), escape + up_below)
        unseen = ~seen.any(1, keepdims=True)  # this language never met the context: its longest suffix decides
        return np.where(unseen, up_cost, self._own(count, below)), np.where(unseen, up_below, below), np.where(unseen, up_count, count)

    def _each(self, s: np.ndarray) -> np.ndarray:
        """What each position of a stream costs after its first `depth`."""
        width, depth = self.size + 1, self.depth
        now = s[depth:]
        at = np.zeros(len(now), np.int32)
        best = at
        flat = self.child.ravel()
        for d in range(1, depth + 1):
            at = flat[at * width + s[depth - d : len(s) - d]]
            best = np.where(at == self.dead, best, at)
        return self.cost[best * width + now]

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths: a row for each text, a column for each language. Texts are walked, and summed, in parts of PART
        positions from their own start, so a long one takes little more memory than a short one."""
        if not texts:
            return np.zeros((0, len(self.langs)))
        s = self._stream(texts)
        lengths = np.array([len(t) + self.depth for t in texts])
        ends, parts = np.cumsum(lengths), -(-lengths // PART)
        cuts = np.concatenate([np.arange(b - n, b, PART) for b, n in zip(ends, lengths, strict=True)])
        sums = np.empty((len(cuts), len(self.langs)))
        lo = 0
        while lo < len(cuts):
            hi = int(np.searchsorted(cuts, cuts[lo] + PART))
            end = cuts[hi] if hi < len(cuts) else ends[-1]
            each = self._each(s[cuts[lo] : end + self.depth])
            sums[lo:hi] = np.add.reduceat(each, cuts[lo:hi] - cuts[lo], axis=0, dtype=np.float64)
            lo = hi
        return np.add.reduceat(sums, np.cumsum(parts) - parts, axis=0)


def training_rows(docs: DataFrame, id_col: str, lang_col: str, text_col: str, held_out, per_lang: int, in_all: int, longest: int) -> list:
    """The sample that trees are learned from: distinct texts with the smallest hashes among labelled rows that aren't
    held out, about per_lang of each language and at most 2 * in_all together, of each its first `longest` characters.

    Rows are chosen by their text, so that neither repeated rows nor repeated or missing ids weigh on the sample. Of more
    than in_all languages the in_all most frequent are learned.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where((F.length(text_col) > 0) & F.col("lang").isNotNull() & ~F.coalesce(held_out(F.col("id")), F.lit(False)))
    rows = rows.select("lang", "text", F.pmod(F.xxhash64("text"), F.lit(1 << 30)).alias("h"))
    found = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"), F.min("h").alias("least")).orderBy(F.desc("n"), "lang").limit(in_all).collect()
    if not found:
        return []
    wanted = min(per_lang, max(1, in_all // len(found)))
    # A text of the smallest hash passes in any case, so that no language goes without.
    share = F.create_map(*[F.lit(x) for r in found for x in (r["lang"], max(r["least"], int(min(1.0, wanted / r["n"]) * (1 << 30))))])
    near = rows.where(F.col("h") <= share[F.col("lang")]).select("lang", "h", F.substring("text", 1, longest).alias("text"))
    return near.groupBy("lang", "h").agg(F.min("text").alias("text")).orderBy("h", "lang").limit(2 * in_all).select("lang", "text").collect()


def identify(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] = (), depth: int = 4, contexts: int = 3_000, per_lang: int = 400, in_all: int = 8_000, longest: int = 40_000) -> DataFrame:
    """Per row: the columns to keep, the id, held_out, lang_pred, score, bits_per_byte.

    held_out maps an id column to a boolean column; such rows are never learned from. lang_pred is the language with the
    shortest code (the smaller name, if tied); score is its posterior under equal priors, from 0 to 1. bits_per_byte is
    that code's length. A text that is null, empty or without a letter is `und`, with score 0 and null bits_per_byte; so
    is every text where no row has a label. Texts are scored whole and without regard to case of ASCII letters; equal
    texts get equal results. Rows are independent, and columns of docs other than these are not read.
    """
    ship(docs.sparkSession)
    sample: dict[str, list[bytes]] = {}
    for r in sorted(training_rows(docs, id_col, lang_col, text_col, held_out, per_lang, in_all, longest)):
        sample.setdefault(r["lang"], []).append(r["text"].encode().lower())
    trees = docs.sparkSession.sparkContext.broadcast(ContextTrees(sample, depth, contexts) if sample else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("langid")
        model = trees.value
        for batch in pieces(batches, 4096):
            column = batch.column(batch.num_columns - 1)
            lang, score, rate = [None] * len(column), [0.0] * len(column), [None] * len(column)
            at, texts, held = [], [], 0

            def flush():
                bits = model.bits(texts)
                first = bits.argmin(1)
                odds = np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000))
                share = 1 / odds.sum(1)
                for i, k, p, b, text in zip(at, first, share, bits.min(1), texts, strict=True):
                    lang[i], score[i], rate[i] = model.langs[k], float(p), float(b) / len(text)

            for i, text in enumerate(column):
                text = text.as_py()
                if model is not None and text and LETTER.search(text):
                    at.append(i)
                    texts.append(text.encode().lower())
                    held += len(texts[-1])
                    if held > PART:
                        flush()
                        at, texts, held = [], [], 0
            if texts:
                flush()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([g or "und" for g in lang], pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score", "bits_per_byte"])

    wanted = docs.select(*keep, id_col, F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), F.col(text_col).alias("text to score"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema.fields[:-1])
    return wanted.mapInArrow(run, f"{schema}, lang_pred string, score double, bits_per_byte double")


def crc_is(remainder: int, modulus: int = 4):
    """held_out for identify(): crc32 of the id as text has this remainder."""
    return lambda c: F.crc32(c.cast("string").cast("binary")) % modulus == remainder
