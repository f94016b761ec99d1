"""Linear models over term blocks: the terms are counted once, written as blocks, and read again for each step of the fit.

What a step holds in memory is a few blocks and the weights, whatever the number of rows; each core sends one sum of
gradients to the driver.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Generator, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import terms as R
from corpusloom.plans.durable import keep

#: Terms go to so many buckets a partition when they are summed, and to as many as this at the least.
BUCKETS, LEAST_BUCKETS = 4, 64
#: Blocks that go to a Python worker at once.
BLOCKS_AT_ONCE = 2
#: Characters of a block, of both columns.
BLOCK_CHARS = 1 << 23
#: What a block holds, and as what: words of the rows, and which of them a row has several times; their tokens; n-grams of the tokens, and which of them a token has several times; n-grams that a row has several times.
PARTS = {
    "words_low": np.uint16, "words_high": np.uint8, "words_n": np.int32, "more": np.int32, "more_tf": np.int32, "tokens": np.int32, "tokens_n": np.int32, "grams_low": np.uint16, "grams_high": np.uint8, "grams_n": np.int32, "twice": np.int32, "twice_tf": np.int32,
    "over_low": np.uint16, "over_high": np.uint8, "over_tf": np.int32, "over_n": np.int32, "norm": float, "lex": float, "label": float, "weight": float, "fold": np.int8,
}
#: Of a block's bytes: little is gained by others, which take longer to undo at each step.
CODEC = "lz4_raw"


@contextmanager
def few_at_once(spark: SparkSession, n: int = BLOCKS_AT_ONCE) -> Iterator[None]:
    """Rows that hold blocks go to Python workers a few at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _texts(batch: pa.RecordBatch, *names: str) -> list[list[str]]:
    return [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names]


def _counted(b: int, words: list[str], chars: list[str], ngrams: tuple[int, int]) -> list[R.Counts]:
    return R.char_counts(chars, *ngrams) if b else R.word_counts(words)


def frequencies(df: DataFrame, ngrams: tuple[int, int], least: float) -> tuple[DataFrame, int]:
    """Of _w and _c: a written table (block, code, df, tf) of the terms of `least` rows or more, or that share of the rows if it is under 1; and the number of rows."""
    buckets = max(LEAST_BUCKETS, BUCKETS * df.rdd.getNumPartitions())

    def count(batches):
        totals, n = (R.Totals(), R.Totals()), 0
        for batch in batches:
            words, chars = _texts(batch, "_w", "_c")
            n += len(words)
            for s in R.chunks(words, chars):
                for b, t in enumerate(totals):
                    for c in _counted(b, words[s], chars[s], ngrams):
                        t.add(c)
        for b, t in enumerate(totals):
            every = t.get()
            of = (R.mixed(every[0]) % R.U(buckets)).astype(np.int64)
            order = np.argsort(of, kind="stable")
            every, ends = every[:, order], np.searchsorted(of[order], np.arange(buckets + 1))
            for k in range(buckets):
                if ends[k] < ends[k + 1]:
                    yield pa.RecordBatch.from_pydict({"block": [b], "bucket": [k], "n": [0], "sums": [np.ascontiguousarray(every[:, ends[k] : ends[k + 1]]).tobytes()]}, pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64()), ("sums", pa.binary())]))
        yield pa.RecordBatch.from_pydict({"block": [-1], "bucket": [0], "n": [n], "sums": [b""]}, pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64()), ("sums", pa.binary())]))

    def add(key, table):
        block = key[0].as_py()
        every = R.summed(np.frombuffer(x, R.U).reshape(3, -1) for x in table.column("sums").to_pylist())
        every = every[:, every[1] >= floor] if block >= 0 else np.array([[0], [sum(table.column("n").to_pylist())], [0]], R.U)
        return pa.table({"block": np.full(every.shape[1], block, np.int32), "code": every[0].view(np.int64), "df": every[1].astype(np.int64), "tf": every[2].astype(np.int64)})

    floor = least if least >= 1 else 1
    summed = df.select("_w", "_c").mapInArrow(count, "block int, bucket int, n long, sums binary").groupBy("block", "bucket").applyInArrow(add, "block int, code long, df long, tf long")
    out = keep(summed, "terms")
    n = out.where("block = -1").agg(F.sum("df")).first()[0] or 0
    kept = out.where(F.col("block") >= 0).where(F.col("df") >= (floor if least >= 1 else least * n))
    kept.kept_at = out.kept_at
    return kept, n


def most_frequent(table: DataFrame, block: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, document frequencies) of a block's most frequent terms, which are at most `size`; ties go by code."""
    got = table.where(F.col("block") == block).orderBy(F.desc("tf"), "code").limit(size).select("code", "df").toArrow()
    return got.column("code").to_numpy().view(R.U), got.column("df").to_numpy()


def spellings(df: DataFrame, vocabularies: Sequence[R.Vocabulary], ngrams: tuple[int, int]) -> list[list[str]]:
    """The terms of each vocabulary as text; those whose code is their characters need no search."""
    out: list[list[str | None]] = [[None] * len(v.codes) for v in vocabularies]
    for v, texts in zip(vocabularies, out):
        for code, k in zip(v.codes.tolist(), v.place.tolist()):
            if not code >> 63:
                texts[k] = "".join(chr(c) for j in (4, 3, 2, 1, 0) if (c := code >> 12 * j & 4095))
    shared = df.sparkSession.sparkContext.broadcast([R.Vocabulary(v.codes[(m := v.codes >= R.HASHED)], v.place[m]) for v in vocabularies])

    def spell(batches):
        # A term is told once by each task.
        seen = [np.zeros(int(v.place.max()) + 1 if len(v.place) else 0, bool) for v in shared.value]
        for batch in batches:
            words, chars = _texts(batch, "_w", "_c")
            rare = [c if any(x > "\u0fff" for x in c) or ngrams[1] > 5 else "" for c in chars]
            for s in R.chunks(words, chars):
                for b, v in enumerate(shared.value):
                    for c in _counted(b, words[s], rare[s], ngrams) if len(v.codes) else ():
                        place = v.find(c.codes)
                        new = np.flatnonzero(place >= 0)
                        new = new[~seen[b][place[new]]]
                        seen[b][place[new]] = True
                        yield pa.RecordBatch.from_pydict({"block": np.full(len(new), b, np.int32), "place": place[new], "term": pa.array(c.spell(new), pa.string())})

    found = df.select("_w", "_c").mapInArrow(spell, "block int, place long, term string").groupBy("block", "place").agg(F.min("term").alias("term")).toArrow()
    for b, k, term in zip(*(found.column(c).to_pylist() for c in ("block", "place", "term"))):
        out[b][k] = term
    shared.destroy()
    return out


def weigh(tf: np.ndarray, sublinear: bool) -> np.ndarray:
    return 1.0 + np.log(np.maximum(tf, 1)) if sublinear else tf.astype(float)


def norms(rows: R.Rows, idf: np.ndarray, sublinear: bool) -> np.ndarray:
    """One over the length of each part's vector; 1 of an empty one."""
    x = weigh(rows.tf, sublinear) * idf[rows.at]
    return 1.0 / (np.sqrt(R.part_sums(x * x, rows.starts)) + (np.diff(rows.starts) == 0))


class Design:
    """What turns texts into entries: vocabularies, idf of both blocks in one array, kinds of n-grams and weights."""

    def __init__(self, vocabularies: Sequence[R.Vocabulary], idf: np.ndarray, ngrams: tuple[int, int], sublinear: bool, binary: bool, lexicon_columns: int) -> None:
        self.vocabularies, self.idf, self.ngrams, self.sublinear, self.binary, self.lexicon_columns = vocabularies, idf, tuple(ngrams), sublinear, binary, lexicon_columns

    def __len__(self) -> int:
        return len(self.idf) + self.lexicon_columns

    def encode(self, words: Sequence[str], chars: Sequence[str]) -> R.Rows:
        rows = R.encode(words, chars, self.vocabularies, self.ngrams)
        return R.Rows(rows.n, rows.at, np.ones_like(rows.tf), rows.starts) if self.binary else rows

    def of_batch(self, batch: pa.RecordBatch) -> Iterator[tuple[slice, R.Rows, np.ndarray]]:
        """(rows, their entries, their lexicon columns) of each chunk of a batch."""
        words, chars, lex = _texts(batch, "_w", "_c", "_l")
        for s in R.chunks(words, chars):
            yield s, self.encode(words[s], chars[s]), np.array(lex[s], float).reshape(s.stop - s.start, self.lexicon_columns)


def blocks(df: DataFrame, design: Design) -> DataFrame:
    """Written blocks of the rows of df: _w, _c, _l, label, weight and fold.

    A row's characters are its tokens, whose n-grams are kept once a block, and what n-grams of several occurrences
    differ by from their number; so a block has a fraction of the entries of its rows.  All rows of a block have one fold.
    """
    shared = df.sparkSession.sparkContext.broadcast(design)

    def write(batches):
        d, waiting, sizes = shared.value, defaultdict(list), defaultdict(int)
        for batch in batches:
            for row in zip(*_texts(batch, "_w", "_c", "_l", "label", "weight", "fold")):
                fold = row[-1]
                waiting[fold].append(row)
                sizes[fold] += len(row[0]) + len(row[1])
                if sizes[fold] > BLOCK_CHARS:
                    yield block_of(waiting.pop(fold), d)
                    del sizes[fold]
        for rows in waiting.values():
            yield block_of(rows, d)

    return keep(df.select("_w", "_c", "_l", "label", "weight", "fold").mapInArrow(write, "n int, data binary"), "blocks")


def block_of(rows: list[tuple], d: Design) -> pa.RecordBatch:
    words, chars, lex, label, weight, fold = map(list, zip(*rows))
    words_at, words_tf, words_n, over_at, over_tf, over_n, norm = [], [], [], [], [], [], []
    for s in R.chunks(words, chars):
        e = R.encode(words[s], chars[s], d.vocabularies, d.ngrams)
        norm.append(norms(R.Rows(e.n, e.at, np.ones_like(e.tf) if d.binary else e.tf, e.starts), d.idf, d.sublinear))
        part = np.repeat(np.arange(2 * e.n), np.diff(e.starts))
        for mine, at, tf, n in ((part % 2 == 0, words_at, words_tf, words_n), ((part % 2 == 1) & (e.tf > 1), over_at, over_tf, over_n)):
            at.append(e.at[mine])
            tf.append(e.tf[mine])
            n.append(np.bincount(part[mine] // 2, minlength=e.n))
    split = pc.split_pattern(pa.array([c[1:-1] for c in chars], pa.string()), "  ")
    tokens = split.flatten().dictionary_encode()
    grams = [np.zeros((3, 0), np.int64)]
    spelled = [f" {t} " if t else "" for t in tokens.dictionary.to_pylist()]
    for s in R.chunks(spelled):
        for c in R.char_counts(spelled[s], *d.ngrams):
            place = d.vocabularies[1].find(c.codes)[c.term]
            there = place >= 0
            grams.append(np.stack([c.row[there] + s.start, place[there] + len(d.vocabularies[0].codes), c.tf[there]]))
    grams = np.concatenate(grams, axis=1)
    grams = grams[:, np.argsort(grams[0], kind="stable")]
    of_words, of_over, tf, gram, gram_tf = np.concatenate(words_at), np.concatenate(over_at), np.concatenate(words_tf), grams[1], grams[2]
    more, twice = np.flatnonzero(tf != 1), np.flatnonzero(gram_tf != 1)
    values = (
        of_words, of_words >> 16, np.concatenate(words_n), more, tf[more], tokens.indices.to_numpy(zero_copy_only=False), np.diff(split.offsets.to_numpy()), gram, gram >> 16, np.bincount(grams[0], minlength=len(spelled)), twice, gram_tf[twice],
        of_over, of_over >> 16, np.concatenate(over_tf), np.concatenate(over_n), np.concatenate(norm), np.array(lex).ravel(), label, weight, fold,
    )
    return pa.RecordBatch.from_pydict({"n": pa.array([len(rows)], pa.int32()), "data": pa.array([packed([np.asarray(v).astype(t) for v, t in zip(values, PARTS.values(), strict=True)])], pa.binary())})


def packed(parts: list[np.ndarray]) -> bytes:
    """The parts' bytes, compressed one by one, after the lengths of each without and with that."""
    small = [pa.compress(x.tobytes(), CODEC, asbytes=True) if x.nbytes else b"" for x in parts]
    return b"".join([np.array([(x.nbytes, len(y)) for x, y in zip(parts, small)], np.int64).tobytes(), *small])


def unpacked(data: bytes) -> dict[str, np.ndarray]:
    lengths, out = np.frombuffer(data, np.int64, 2 * len(PARTS)).reshape(-1, 2), {}
    at, view = lengths.nbytes, memoryview(data)
    for (name, t), (n, small) in zip(PARTS.items(), lengths.tolist()):
        out[name] = np.frombuffer(pa.decompress(view[at : at + small], n, CODEC) if n else b"", t)
        at += small
    return out


def apart(counts: np.ndarray) -> np.ndarray:
    """Starts of parts of such lengths, and the end."""
    return np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])


class Block:
    """A block that was read: entries x = tf * norm * idf, where idf is left to the weights."""

    def __init__(self, row: dict, sublinear: bool = True, binary: bool = False, lexicon_columns: int = 0) -> None:
        p = unpacked(row["data"])
        places = lambda x: p[f"{x}_low"] | p[f"{x}_high"].astype(np.int64) << 16
        self.n = row["n"]
        self.words, self.words_n, self.more = places("words"), p["words_n"], p["more"]
        self.more_x = np.ones(len(self.more)) if binary else weigh(p["more_tf"], sublinear)
        self.tokens, self.tokens_n = p["tokens"].astype(np.int64), p["tokens_n"]
        self.grams, self.grams_n, self.twice, self.twice_x = places("grams"), p["grams_n"], p["twice"], p["twice_tf"].astype(float)
        self.over, self.over_n, tf = places("over"), p["over_n"], p["over_tf"]
        self.over_tf = tf.astype(float)
        self.over_x = np.ones(len(tf)) if binary else weigh(np.arange(tf.max() + 1), sublinear)[tf] if len(tf) and tf.max() < len(tf) else weigh(tf, sublinear)
        self.norm = p["norm"].reshape(-1, 2)
        self.lex = p["lex"].reshape(self.n, lexicon_columns)
        self.label, self.weight, self.fold = p["label"], p["weight"], p["fold"]

    def margins(self, w: np.ndarray, dims: int) -> np.ndarray:
        """w: by term with idf in it, then by lexicon column, then the intercept."""
        x = w[self.words]
        x[self.more] *= self.more_x
        g = w[self.grams]
        g[self.twice] *= self.twice_x
        of_token = R.part_sums(g, apart(self.grams_n))
        chars = R.part_sums(of_token[self.tokens], apart(self.tokens_n)) + R.part_sums(w[self.over] * (self.over_x - self.over_tf), apart(self.over_n))
        return R.part_sums(x, apart(self.words_n)) * self.norm[:, 0] + chars * self.norm[:, 1] + self.lex @ w[dims:-1] + w[-1]

    def gathered(self, r: np.ndarray, dims: int, power: int = 1) -> np.ndarray:
        """Sum of r times x, or its square, by weight; without idf."""
        words, chars = (r * self.norm[:, k] ** power for k in (0, 1))
        x = np.repeat(words, self.words_n)
        x[self.more] *= self.more_x**power
        # Occurrences count one by one in either power; what terms of several differ by is added.
        of_token = np.bincount(self.tokens, np.repeat(chars, self.tokens_n), len(self.grams_n))
        g = np.repeat(of_token, self.grams_n)
        g[self.twice] *= self.twice_x
        out = np.bincount(self.words, x, dims) + np.bincount(self.grams, g, dims) + np.bincount(self.over, np.repeat(chars, self.over_n) * (self.over_x**power - self.over_tf), dims)
        return np.concatenate([out, r @ self.lex**power, [r.sum()]])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0, -z))


def logistic(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Losses and their derivatives by margin."""
    s = 2 * y - 1
    return np.logaddexp(0, -s * z), -s * sigmoid(-s * z)


def squared_hinge(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = 2 * y - 1
    gap = np.maximum(0, 1 - s * z)
    return gap * gap, -2 * s * gap


#: Of each kind: loss, the greatest second derivative of a loss, and whether the intercept is held small too, as the reference's estimators do it.
LOSSES = {"logreg": (logistic, 0.25, False), "svm": (squared_hinge, 2.0, True)}
#: Of each kind: the power of a weight's variance in its scale, past steps that are kept, and as what.  They shape the way to the least alone.
WAYS = {"logreg": (1.0, 20, np.float64), "svm": (0.5, 40, np.float32)}


def lbfgs(x: np.ndarray, done, max_iter: int, memory: int = 20, kept_as: type = float) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """Yields points and is sent value and gradient of each; returns the point where done(value, gradient), or after max_iter steps.

    kept_as: what numbers past steps are kept as; they shape the direction alone.
    """
    f, g = yield x
    past: deque = deque(maxlen=memory)
    for _ in range(max_iter):
        if done(f, g):
            break
        d, kept = g.copy(), []
        for s, y, rho in reversed(past):
            kept.append(a := rho * (s @ d))
            d -= a * y
        if past:
            d *= 1 / (past[-1][2] * (past[-1][1] @ past[-1][1]))
        for (s, y, rho), a in zip(past, reversed(kept)):
            d += (a - rho * (y @ d)) * s
        slope, t, low, high = -(g @ d), 1.0, 0.0, np.inf
        for _ in range(30):
            new_f, new_g = yield x - t * d
            if new_f > f + 1e-4 * t * slope:
                high = t
            elif -(new_g @ d) < 0.9 * slope:
                low = t
            else:
                break
            t = (low + high) / 2 if high < np.inf else 2 * low
        if new_f >= f:  # as low as numbers go
            break
        s, y = (-t * d).astype(kept_as), (new_g - g).astype(kept_as)
        x, f, g = x - t * d, new_f, new_g
        if s @ y > 0:
            past.append((s, y, 1 / (s @ y)))
    return x


def fit(table: DataFrame, design: Design, kind: str, left_out: Sequence[int | None], c: float = 1.0, reg: float | None = None, tol: float = 1e-4, max_iter: int = 1000) -> list[np.ndarray]:
    """Weights, then lexicon columns, then the intercept, of a model for each entry of left_out: the fold whose rows it is not fitted on.

    All models are fitted side by side, so blocks are read once a step.  The least of the weighted mean loss plus
    |w|^2 / (2 c total weight) is found by L-BFGS, with entries less their mean, which frees the intercept, and each
    weight scaled by its curvature; a model is done when the length of its gradient is at most tol times the value.
    """
    spark, dims, size, sublinear, binary, extra = table.sparkSession, len(design.idf), len(design) + 1, design.sublinear, design.binary, design.lexicon_columns
    loss, steepest, with_intercept = LOSSES[kind]
    power, memory, kept_as = WAYS[kind]
    scale = np.concatenate([design.idf, np.ones(extra + 1)])
    source = table.coalesce(spark.sparkContext.defaultParallelism)

    def run(points: dict[int, np.ndarray] | None) -> dict[int, np.ndarray]:
        """Sums by model: value and gradient at the model's point, or total weight, the positive rows' weight, sums of x and of its square."""
        shared = spark.sparkContext.broadcast(points)

        def part(batches):
            points, sums = shared.value, {}
            for batch in batches:
                for row in batch.to_pylist():
                    b = Block(row, sublinear, binary, extra)
                    fitted = [k for k in (range(len(left_out)) if points is None else points) if left_out[k] != b.fold[0]]
                    if points is None and fitted:
                        x = np.concatenate([[b.weight.sum(), b.weight @ (b.label > 0)], b.gathered(b.weight, dims), b.gathered(b.weight, dims, 2)])
                    for k in fitted:
                        if points is not None:
                            losses, r = loss(b.margins(points[k], dims), b.label)
                            x = np.concatenate([[b.weight @ losses], b.gathered(b.weight * r, dims)])
                        sums[k] = sums[k] + x if k in sums else x
            for k, x in sums.items():
                yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "sums": [x.tobytes()]})

        out: dict[int, np.ndarray] = {}
        # Blocks go to Python as Arrow's bytes: as an RDD of rows they are pickled, which takes longer than the sums.
        with few_at_once(spark):
            got = source.mapInArrow(part, "k int, sums binary").toArrow()
        for k, x in zip(got.column("k").to_pylist(), got.column("sums")):
            out[k] = out.get(k, 0) + np.frombuffer(x.as_buffer())
        shared.destroy()
        return out

    walks, at, out = {}, {}, [np.zeros(size) for _ in left_out]
    for k, x in run(None).items():
        total = x[0] or 1.0
        if kind == "logreg" and x[1] in (0.0, x[0]):  # one label alone
            out[k][-1] = np.inf if x[1] else -np.inf
            continue
        held = np.full(size, 1 / (c * total) if reg is None else reg)
        held[-1] *= with_intercept
        mean, square = x[2 : size + 2] * scale / total, x[size + 2 :] * scale**2 / total
        mean[-1] = 0.0
        varied = np.maximum(square - mean * mean, 0.0)
        unit = 1 / np.sqrt(steepest * varied**power * varied.mean() ** (1 - power) + held + 1e-12)

        def done(f, g, unit=unit, mean=mean):
            g = g / unit
            return np.linalg.norm(g + mean * g[-1]) <= tol * abs(f)

        walks[k] = (lbfgs(np.zeros(size), done, max_iter, memory, kept_as), unit, held, mean, total)
        at[k] = next(walks[k][0])

    def weights_at(k: int, u: np.ndarray) -> np.ndarray:
        w = u * walks[k][1]
        w[-1] -= walks[k][3] @ w
        return w

    while at:
        got = run({k: weights_at(k, u) * scale for k, u in at.items()})
        for k in list(at):
            walk, unit, held, mean, total = walks[k]
            w = weights_at(k, at[k])
            g = got[k][1:] * scale / total + held * w
            try:
                at[k] = walk.send((got[k][0] / total + held @ (w * w) / 2, (g - mean * g[-1]) * unit))
            except StopIteration as end:
                out[k] = weights_at(k, end.value)
                del at[k]
    return out


def margins(table: DataFrame, design: Design, weights: Sequence[np.ndarray]) -> DataFrame:
    """(fold, y_score, y_true) of all rows of the blocks: the margin by the model of the row's own fold.  A written table."""
    spark, dims, sublinear, binary, extra = table.sparkSession, len(design.idf), design.sublinear, design.binary, design.lexicon_columns
    shared = spark.sparkContext.broadcast([w * np.concatenate([design.idf, np.ones(extra + 1)]) for w in weights])

    def score(batches):
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row, sublinear, binary, extra)
                z = b.margins(shared.value[b.fold[0]], dims)
                yield pa.RecordBatch.from_pydict({"fold": b.fold.astype(np.int32), "y_score": z, "y_true": b.label.astype(np.int32)})

    with few_at_once(spark):
        return keep(table.mapInArrow(score, "fold int, y_score double, y_true int"), "margins")


def score(df: DataFrame, design: Design, weights: Sequence[np.ndarray], of) -> DataFrame:
    """df without _w, _c and _l, with y_score: of(the models' margins, a row a model)."""
    dims, sublinear, extra = len(design.idf), design.sublinear, design.lexicon_columns
    shared = df.sparkSession.sparkContext.broadcast((design, [w * np.concatenate([design.idf, np.ones(extra + 1)]) for w in weights]))
    kept = [c for c in df.columns if c not in ("_w", "_c", "_l")]

    def add(batches):
        design, scaled = shared.value
        for batch in batches:
            z = np.zeros((len(scaled), batch.num_rows))
            for s, rows, lex in design.of_batch(batch):
                x, norm = weigh(rows.tf, sublinear), norms(rows, design.idf, sublinear)
                for k, w in enumerate(scaled):
                    z[k, s] = (R.part_sums(x * w[rows.at], rows.starts) * norm).reshape(-1, 2).sum(axis=1) + lex @ w[dims:-1] + w[-1]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], pa.array(of(z))], [*kept, "y_score"])

    schema = df.select(*kept).schema.add("y_score", "double")
    return df.mapInArrow(add, schema)
