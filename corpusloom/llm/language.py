"""Problem 1: language of documents and of passages (string-kernel classification).

Kernel: blended spectrum of character n-grams (LENGTHS), presence only: an n-gram counts once for each
distinct word that holds it, the counts of two texts are multiplied and summed, and the sum is divided by the
roots of the texts' numbers of n-grams.  Nystroem landmarks turn it into features, one-versus-rest kernel ridge
regression gives a weight of each landmark for each language.  The product of landmarks and weights is one
matrix over n-grams.  A batch is scored by two matrix products: the sparse n-gram presence of its new words with
that matrix, and the presence of words in its texts with the words' scores, which a worker keeps.

Passages: the same matrix gives each word a score for each language, and the best sequence of languages is
found by dynamic programming with a price for each change.  The price is chosen on mixed texts made from the
sample.  A run of LEAST_WORDS words (or, where words are not spaced, twice as many characters) is a passage.

The sample is bounded: SAMPLE labelled rows of LEAST_CHARS characters or more, shared among the languages by the
root of their numbers of rows and chosen by the hash of their id over the whole table, beside a few seed sentences.
Its labels are noisy: each row is predicted by a fit on the other folds, and rows that contradict it are left out of
the final fit.  The same predictions calibrate the confidence: it is the share of labels that agree at a margin.
Everything else is computed for every row.

The languages are a closed set; a text in another one gets the nearest, with little confidence.  Null and wordless
texts get no language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import forms, garble

#: Bounds of the fit: labelled rows, and landmarks among them, of all languages together.
SAMPLE, LANDMARKS = 6000, 1000
#: Texts of the sample have so many characters; shorter ones tell little of a language.
LEAST_CHARS = 31
#: Folds of the sample, to find wrong labels.
FOLDS = 5
#: A row whose margin is below this share of the median one is not fitted on.
DOUBT = 0.35
LENGTHS = (1, 2, 3, 4, 5)
RIDGE = 0.3
LEAST_WORDS = 5
#: Mixed texts are rare: the share of errors on single texts weighs as much as so many times that on mixed ones.
PURE = 30

# Names of the languages, besides their codes with or without a region.
NAMES = {
    "en": ("eng", "english", "inglês", "ingles", "anglais", "englisch", "inglese"),
    "pt": ("por", "portuguese", "português", "portugues", "portugais", "portugiesisch", "brazilian", "ptbr"),
    "es": ("spa", "esp", "spanish", "español", "espanol", "castellano", "espanhol", "castilian", "espagnol", "spanisch"),
    "fr": ("fra", "fre", "french", "français", "francais", "francês", "frances", "französisch"),
    "it": ("ita", "italian", "italiano", "italien", "italienisch"),
    "de": ("deu", "ger", "german", "deutsch", "alemão", "alemao", "allemand", "alemán", "tedesco"),
    "ru": ("rus", "russian", "русский", "russo", "russe", "russisch"),
    "ja": ("jpn", "japanese", "日本語", "japonês", "japones", "japonais", "jp", "japanisch"),
}
LANGUAGES = tuple(NAMES)

# Sentences of common words, so that each language has examples in any table.
SEEDS = {
    "en": ("the people who were there said that it was not what they had thought", "you should have been with us when she came back from her house this morning", "and if this is all there is then why would anyone want more of it"),
    "pt": ("as pessoas que estavam ali disseram que não era isso o que elas pensavam", "você devia ter ficado com a gente quando ela voltou da sua casa hoje de manhã", "e se isso é tudo o que há então por que alguém iria querer mais do mesmo"),
    "es": ("las personas que estaban allí dijeron que no era eso lo que ellas pensaban", "tú deberías haber estado con nosotros cuando ella volvió de su casa esta mañana", "y si esto es todo lo que hay entonces por qué alguien querría más de lo mismo"),
    "fr": ("les gens qui étaient là ont dit que ce n'était pas ce qu'ils avaient pensé", "vous auriez dû être avec nous quand elle est rentrée de chez elle ce matin", "et si c'est tout ce qu'il y a alors pourquoi quelqu'un en voudrait encore plus"),
    "it": ("le persone che erano lì hanno detto che non era quello che avevano pensato", "tu avresti dovuto essere con noi quando lei è tornata dalla sua casa questa mattina", "e se questo è tutto quello che c'è allora perché qualcuno dovrebbe volerne di più"),
    "de": ("die Leute die dort waren haben gesagt dass es nicht das war was sie dachten", "du hättest bei uns sein sollen als sie heute morgen aus ihrem Haus zurückkam", "und wenn das alles ist was es gibt warum sollte dann jemand mehr davon wollen"),
    "ru": ("люди которые были там сказали что это было не то что они думали", "ты должен был быть с нами когда она вернулась из своего дома сегодня утром", "и если это всё что есть то почему кто-нибудь захочет ещё больше этого"),
    "ja": ("そこにいた人たちは、それは思っていたものではないと言いました", "彼女が今朝家から帰ってきたとき、あなたは私たちと一緒にいるべきでした", "もしこれがすべてなら、なぜ誰かがもっと欲しがるのでしょうか"),
}

_MARKER = re.compile(r"<[a-z]+>|https?://\S+", re.I)
_CLAUSE_END = re.compile(r"[^\w\s'’-]+|\s[-–—]+\s|[\n\r]+")
_NOT_LETTER = re.compile(r"(?:[^\w\n]|[\d_])+")
_WORD = re.compile(r"[^\W_]")


def code_of(label: str | None) -> str | None:
    """The code of a language label, whatever its case, region or language of naming; null for placeholders and others."""
    if label is None:
        return None
    s = re.split(r"[-_ (/]", label.strip().lower())[0]
    return next((c for c, names in NAMES.items() if s == c or s in names), None)


def prepared(text: str) -> str:
    """Lower-case words, with a line for each clause; markers, digits and signs go, damaged characters are restored first."""
    if not text.isascii():
        text = forms.plain(garble.repair(text)[0])[0]
    return _NOT_LETTER.sub(" ", _CLAUSE_END.sub("\n", _MARKER.sub(" ", text).lower())).strip()


def clause_starts(text: str) -> np.ndarray:
    """For each word of a prepared text, whether it begins a clause."""
    sizes = [n for line in text.split("\n") if (n := len(line.split()))]
    out = np.zeros(sum(sizes), bool)
    out[np.cumsum([0, *sizes])[:-1]] = True
    return out


_P, _M = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram hashes, word index) of words with a space on either side; an n-gram is there once for a word."""
    flat = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words])
    row = np.repeat(np.arange(len(words)), size)
    end = np.cumsum(size)[row]
    n, at = len(flat), np.arange(len(flat))
    flat = np.r_[flat, np.zeros(max(LENGTHS), np.uint64)]
    h = np.zeros(n, np.uint64)
    out_h, out_r = [], []
    for k in range(1, max(LENGTHS) + 1):
        h = h * _P + flat[k - 1 : k - 1 + n] + np.uint64(k)
        if k in LENGTHS:
            ok = at + k <= end
            out_h.append((h[ok] * _M) >> np.uint64(8))
            out_r.append(row[ok])
    h, r = np.concatenate(out_h), np.concatenate(out_r)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])]
    return h[new], r[new]


class KernelModel:
    """Weights of n-grams for each language."""

    #: Words whose scores a worker keeps; beyond, the table is emptied.
    KEPT = 200_000

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, price: float = 0.0, sigmoid: tuple[float, float] = (6.0, 0.0)):
        self.hashes, self.weights, self.price, self.sigmoid = hashes, weights.astype(np.float32), price, sigmoid
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.scored = np.zeros((0, self.weights.shape[1]), np.float32)
        self.grams = np.zeros(0, np.int64)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "scored", "grams")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    def _learn(self, words: list[str]) -> None:
        """Scores of new words: their sparse n-gram presence matrix times the matrix of weights."""
        h, r = word_grams(words)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = self.hashes[at] == h
        out = np.zeros((len(words), self.weights.shape[1]), np.float32)
        if hit.any():
            rows = r[hit]
            starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            out[rows[starts]] = np.add.reduceat(self.weights[at[hit]], starts, axis=0)
        for w in words:
            self.known[w] = len(self.known)
        self.scored = np.vstack([self.scored, out])
        self.grams = np.r_[self.grams, np.bincount(r, minlength=len(words))]

    def scores(self, texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """(kernel scores of each text, scores of each of its words).  texts: prepared."""
        split = [t.split() for t in texts]
        if len(self.known) > self.KEPT:
            self._forget()
        new = {w for ws in split for w in ws if w not in self.known}
        if new:
            self._learn(sorted(new))
        get = self.known.__getitem__
        idx = [np.fromiter(map(get, ws), np.int64, len(ws)) for ws in split]
        # the batch's presence matrix over distinct words times the words' scores
        own = [np.fromiter(map(get, dict.fromkeys(ws)), np.int64) for ws in split]
        size = np.array([len(x) for x in own])
        flat = np.concatenate(own) if own else np.zeros(0, np.int64)
        total = np.zeros((len(texts), self.weights.shape[1]), np.float32)
        some = np.flatnonzero(size)
        if len(some):
            starts = (np.cumsum(size) - size)[some]
            total[some] = np.add.reduceat(self.scored[flat], starts, axis=0) / np.sqrt(np.add.reduceat(self.grams[flat], starts))[:, None]
        return total, [self.scored[i] for i in idx]


def _features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text: its n-grams and in how many of its distinct words each is."""
    out = []
    for t in texts:
        words = list(dict.fromkeys(t.split()))
        out.append(np.unique(word_grams(words)[0], return_counts=True) if words else (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    return out


def fit(texts: list[str], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> KernelModel:
    """Fit on prepared texts; the seeds are added.  The same input gives the same model."""
    texts, labels = list(texts), list(labels)
    seeds = [(prepared(s), c) for c, own in SEEDS.items() for s in own]
    texts, labels = texts + [t for t, _ in seeds], labels + [c for _, c in seeds]
    grams = _features(texts)
    norm = np.sqrt([max(1, c.sum()) for _, c in grams])
    y = np.array([LANGUAGES.index(c) for c in labels])
    quota = [max(12, round(landmarks * (y == k).mean())) for k in range(len(LANGUAGES))]
    marks = np.concatenate([np.flatnonzero(y == k)[-quota[k] :] for k in range(len(LANGUAGES))])
    # n-gram -> the landmarks that hold it, as one array with offsets
    pair_g = np.concatenate([grams[i][0] for i in marks])
    pair_m = np.repeat(np.arange(len(marks)), [len(grams[i][0]) for i in marks])
    pair_c = np.concatenate([grams[i][1] / norm[i] for i in marks])
    order = np.argsort(pair_g, kind="stable")
    vocab, at = np.unique(pair_g[order], return_index=True)
    holders, held, bounds = pair_m[order], pair_c[order], np.r_[at, len(order)]

    def against(i: int) -> np.ndarray:
        g, c = grams[i]
        k = np.minimum(np.searchsorted(vocab, g), len(vocab) - 1)
        hit = vocab[k] == g
        k, c = k[hit], c[hit]
        n = bounds[k + 1] - bounds[k]
        at = np.repeat(bounds[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(holders[at], np.repeat(c, n) * held[at], minlength=len(marks)) / norm[i]

    k_nm = np.array([against(i) for i in range(len(texts))])
    val, vec = np.linalg.eigh(k_nm[marks])
    root = vec @ np.diag(1 / np.sqrt(np.maximum(val, 1e-6))) @ vec.T
    feats = k_nm @ root
    goal = np.where(y[:, None] == np.arange(len(LANGUAGES)), 1.0, -1.0)

    def solved(rows: np.ndarray) -> np.ndarray:
        f = feats[rows]
        return np.linalg.solve(f.T @ f + ridge * np.eye(f.shape[1]), f.T @ goal[rows])

    # A row is judged by the other folds alone; seeds are in every fit.
    seed = np.arange(len(texts)) >= len(texts) - len(seeds)
    fold = np.arange(len(texts)) % FOLDS
    told = np.zeros((len(texts), len(LANGUAGES)))
    for k in range(FOLDS):
        told[fold == k] = feats[fold == k] @ solved((fold != k) | seed)
    agree = told.argmax(axis=1) == y
    two = np.sort(told, axis=1)[:, -2:]
    margin = two[:, 1] - two[:, 0]
    # A text in doubt between two languages may hold both.
    keep_ = agree & (margin >= DOUBT * np.median(margin)) | seed
    alpha = root @ solved(keep_)
    # the matrix over n-grams: the landmarks' presence, transposed, times their weights
    weights = np.add.reduceat(alpha[holders] * held[:, None], bounds[:-1], axis=0).astype(np.float32)
    weights -= weights.mean(axis=1, keepdims=True)
    model = KernelModel(vocab, weights, sigmoid=_calibrated(margin[~seed], agree[~seed]))
    _tune(model, [t for t, k in zip(texts, keep_) if k], [c for c, k in zip(labels, keep_) if k])
    return model


def _calibrated(margin: np.ndarray, agree: np.ndarray) -> tuple[float, float]:
    """(a, b) of the sigmoid of a margin that is the share of labels that agree: logistic regression by Newton's steps, with one wrong and one right row added."""
    x = np.c_[np.r_[margin, 0.0, 1.0], np.ones(len(margin) + 2)]
    t = np.r_[agree.astype(float), 0.0, 1.0]
    w = np.zeros(2)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), x.T @ (t - p))
    return float(max(w[0], 0.0)), float(w[1])


def _tune(model: KernelModel, texts: list[str], labels: list[str]) -> None:
    """Choose the price of a change of language: least errors on single texts and on texts with clauses of another language.

    Texts that hold several languages even at the highest price are no single texts, whatever their label says.
    """
    r = np.random.default_rng(7)
    clauses = [[c for c in t.split("\n") if c.strip()] for t in texts]
    pure = r.permutation(len(texts))[:4000]
    made, want = [texts[i] for i in pure], [{labels[i]} for i in pure]
    for a, b in r.integers(0, len(texts), (2400, 2)):
        if labels[a] == labels[b] or len(texts[a].split()) < 12:
            continue
        part = [c for c in clauses[b] if len(c.split()) >= LEAST_WORDS and labels[b] != "ja"][: int(r.integers(1, 4))]
        if part:
            at = int(r.integers(0, len(clauses[a]) + 1))
            left = [clauses[a][:at], clauses[a][at:]]
            if any(sum(len(c.split()) for c in x) >= LEAST_WORDS for x in left):
                made.append("\n".join([*left[0], *part, *left[1]]))
                want.append({labels[a], labels[b]})
    _, words = model.scores(made)
    starts = [clause_starts(t) for t in made]
    step = float(np.median(np.concatenate([np.abs(w).max(axis=1) for w in words if len(w)])))
    factors = (0.75, 1, 1.5, 2, 2.5, 3, 3.5, 4, 6)  # the last only tells single texts
    order = np.argsort([len(w) for w in words], kind="stable")
    wrong = np.zeros((len(factors), len(made)), bool)
    for lo in range(0, len(order), 250):  # texts of like length share one pass
        part = order[lo : lo + 250]
        for j, f in enumerate(factors):
            for i, path in zip(part, paths([words[i] for i in part], [starts[i] for i in part], f * step)):
                wrong[j, i] = {LANGUAGES[k] for k, _, _ in passages(path, made[i], starts[i])} != want[i]
    single = np.flatnonzero(~wrong[-1, : len(pure)])
    tried = [(PURE * w[single].mean() + w[len(pure) :].sum() / max(1, len(made) - len(pure)), f) for w, f in zip(wrong, factors[:-1])]
    best = min(e for e, _ in tried)
    model.price = step * float(np.median([f for e, f in tried if e <= best * 1.1 + 0.005]))


#: A change of language within a clause costs so many times that at its start.
INNER = 4


def paths(words: list[np.ndarray], starts: list[np.ndarray], price: float) -> list[np.ndarray]:
    """The best language of each word, for a batch of texts at once.  starts: where clauses begin."""
    if not words:
        return []
    longest = max(map(len, words))
    n, k = len(words), len(LANGUAGES)
    score = np.zeros((longest, n, k), np.float32)
    cost = np.full((longest, n), price * INNER, np.float32)
    for i, (w, s) in enumerate(zip(words, starts)):
        score[: len(w), i] = w
        cost[: len(w), i][s] = price
    back = np.zeros((longest, n, k), np.int8)
    now = np.zeros((n, k), np.float32)
    own = np.arange(k, dtype=np.int8)
    for t in range(longest):
        top = now.argmax(axis=1)
        best = now[np.arange(n), top] - cost[t]
        change = best[:, None] > now
        back[t] = np.where(change, top[:, None], own)
        now = np.maximum(now, best[:, None]) + score[t]
    out = np.zeros((longest, n), np.int8)
    state = now.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        out[t] = state
        state = back[t][np.arange(n), state]
    return [out[: len(w), i] for i, w in enumerate(words)]


_UNSPACED = re.compile("[぀-ヿ㐀-鿿]")


def passages(path: np.ndarray, text: str, starts: np.ndarray, least: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """(language, first word, end) of the passages of a prepared text; at least one if it has words.

    A clause of one word, a name that is called, does not count at the edges of a run.
    """
    n = len(path)
    if not n:
        return []
    cuts = np.flatnonzero(np.r_[True, path[1:] != path[:-1], True])
    runs = [[int(path[a]), int(a), int(b)] for a, b in zip(cuts, cuts[1:])]
    if len(runs) == 1:
        return [tuple(runs[0])]
    words = text.split()

    def weight(r: list[int]) -> int:
        a, b = r[1], r[2]
        while a + 1 < b and starts[a] and starts[a + 1]:
            a += 1
        while b - 1 > a and starts[b - 1] and (b == n or starts[b]):
            b -= 1
        return max(b - a, sum(len(_UNSPACED.findall(w)) for w in words[a:b]) // 2)

    long = [r for r in runs if weight(r) >= least]
    if not long:
        total: dict[int, int] = {}
        for r in runs:
            total[r[0]] = total.get(r[0], 0) + weight(r)
        return [(max(total, key=lambda k: total[k]), 0, n)]
    out = [list(long[0])]
    out[0][1] = 0
    for r in long[1:]:  # short runs go to the passage before them
        if r[0] == out[-1][0]:
            continue
        out[-1][2] = r[1]
        out.append(list(r))
    out[-1][2] = n
    return [tuple(r) for r in out]


def code_column(label: Column) -> Column:
    """code_of as a column."""
    s = F.element_at(F.split(F.lower(F.trim(label)), "[-_ (/]"), 1)
    return F.coalesce(*[F.when(s.isin(c, *names), F.lit(c)) for c, names in NAMES.items()])


def sample(df: DataFrame, text_col: str, label_col: str, id_col: str, size: int = SAMPLE) -> tuple[list[str], list[str]]:
    """Labelled texts for the fit, about `size` and at most 1.5 times as many, spread over the whole table by hash; whatever the table's order, the same rows."""
    rows = df.select(F.col(text_col).alias("t"), code_column(F.col(label_col)).alias("l"), F.col(id_col).cast("string").alias("i"))
    rows = rows.where((F.col("l").isNotNull()) & (F.length("t") >= LEAST_CHARS))
    by_code = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not by_code:
        return [], []
    # a row is in if its hash is in the first share of hashes that gives its language's part of the sample
    whole = sum(n**0.5 for n in by_code.values())
    place = F.xxhash64("i").bitwiseAND(F.lit((1 << 63) - 1))
    share = {c: min(1.0, size * n**0.5 / whole / n) for c, n in by_code.items()}
    cond = F.lit(False)
    for c, x in share.items():
        cond = cond | ((F.col("l") == c) & (place <= F.lit(min((1 << 63) - 1, int(x * 2.0**63)))))
    rows = rows.where(cond).orderBy(place, "i", "t").limit(3 * size // 2).collect()
    seen, texts, labels = set(), [], []
    for r in sorted(rows, key=lambda r: (r["i"], r["t"])):
        t = prepared(r["t"])
        if t not in seen and t.strip():
            seen.add(t)
            texts.append(t)
            labels.append(r["l"])
    return texts, labels


def detect(df: DataFrame, model: KernelModel, id_col: str = "id", text_col: str = "text_clean", carry: str | None = None) -> DataFrame:
    """(id, lang, confidence, langs, segments, carried) of each row; lang and langs are null for texts without words.

    lang is the language of most of the text, langs all languages of its passages in order of appearance,
    segments their (lang, first word, number of words).  confidence is that of lang, 0 to 1.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the landmarks, about 5 MB

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                raw = b.column(1).to_pylist()
                at = [i for i, t in enumerate(raw) if t and _WORD.search(t)]
                texts = [prepared(raw[i]) for i in at]
                short = [i for i, t in enumerate(texts) if not t.strip()]
                for i in short:
                    texts[i] = raw[at[i]].lower().strip()
                lang: list = [None] * len(raw)
                conf: list = [None] * len(raw)
                langs: list = [None] * len(raw)
                segs: list = [None] * len(raw)
                if at:
                    total, words = m.scores(texts)
                    order = np.argsort([len(w) for w in words], kind="stable")
                    for s in range(0, len(order), 250):
                        part = order[s : s + 250]
                        starts = [clause_starts(texts[i]) for i in part]
                        for i, path, c in zip(part, paths([words[i] for i in part], starts, m.price), starts):
                            runs = passages(path, texts[i], c) or [(int(total[i].argmax()), 0, 0)]
                            size: dict[int, int] = {}
                            for k, a, z in runs:
                                size[k] = size.get(k, 0) + z - a
                            top = int(total[i].argmax()) if len(size) == 1 and len(words[i]) < LEAST_WORDS else max(size, key=lambda k: size[k])
                            if len(size) == 1:
                                runs = [(top, 0, runs[-1][2])]
                                size = {top: 1}
                            others = np.delete(total[i], top).max()
                            j = at[i]
                            lang[j], langs[j] = LANGUAGES[top], [LANGUAGES[k] for k in size]
                            conf[j] = float(1 / (1 + np.exp(-np.clip(m.sigmoid[0] * (total[i][top] - others) + m.sigmoid[1], -30, 30))))
                            segs[j] = [{"lang": LANGUAGES[k], "first_word": a, "words": z - a} for k, a, z in runs]
                seg = pa.array(segs, pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("words", pa.int32())])))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(lang, pa.string()), pa.array(conf, pa.float64()), pa.array(langs, pa.list_(pa.string())), seg, b.column(2)],
                    names=["id", "lang", "confidence", "langs", "segments", "carried"],
                )

    src = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), (F.col(carry) if carry else F.lit(None)).cast("string").alias("carried"))
    return src.mapInArrow(one, "id string, lang string, confidence double, langs array<string>, segments array<struct<lang:string,first_word:int,words:int>>, carried string")


def languages(df: DataFrame, id_col: str = "id", text_col: str = "text_clean", label_col: str = "language") -> DataFrame:
    """Fit on the bounded sample of df's own labels, then (id, lang, confidence, langs, segments, carried: the old label) of every row."""
    return detect(df, fit(*sample(df, text_col, label_col, id_col)), id_col, text_col, label_col)


def found(df: DataFrame, id_col: str = "id", text_col: str = "text_clean", label_col: str = "language") -> DataFrame:
    """(id, lang): one row per language of the text of each row whose label is missing, names another language, or that mixes languages."""
    rows = languages(df, id_col, text_col, label_col).where("lang is not null")
    code = code_column(F.col("carried"))
    wrong = code.isNull() | ~F.array_contains("langs", code)
    return rows.where(wrong | (F.size("langs") > 1)).select("id", F.explode("langs").alias("lang")).dropDuplicates(["id", "lang"])
