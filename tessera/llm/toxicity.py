"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text, all computed on whole batches in NumPy: densities of four known lexicons (insults, profanity,
threats, contempt), densities and log odds of two learned ones (words; beginnings of words), number of hits and of
distinct hits, second-person pronouns and hits within `NEAR` words of one, capital letters and words, exclamation,
question and other punctuation marks, tokens with inner symbols or digits, lexicon words found behind such spellings
(m0r0n, i.d.i.o.t), stretched letters and length.

Lexicons. The known word lists hold one language well and others hardly, so a lexicon is learned from the labelled
documents: words, and word beginnings of `PREFIXES` bytes, that toxic documents hold `LIFT` times as often as others,
with a support that grows with the number of labelled documents. A known word that the labelled documents show to be
common and harmless (a word of another language, say) is dropped. The learned entries enter the features of a labelled
document without that document's own fold (`FOLDS`), so trees and calibration see densities as honest as those of an
unlabelled document. At most `ENTRIES` entries travel with the task.

The model is fitted on at most `MAX_LABELLED` labelled documents (those whose id has the smallest hash, so the choice is
the same on every run): histogram trees on logistic loss on four fifths, isotonic regression (pool adjacent violators)
of the outcome on the score on the held-out fifth. Fitting reads the documents once, for the labelled ones, which are
written to the shared folder; scoring is one pass without a shuffle over all documents, from which only the score
comes back from Python.

Defined cases: a null or empty text has zero features and is scored like any other; labels that are null are ignored,
several labels of a document count as their maximum; without labels, or with one class only, the probability is the
share of toxic labels (0 if there are none); equal rows get equal scores; a null doc_id is scored, never used to fit;
texts of any length count whole; an empty table gives an empty result; other columns pass through `reject_toxic`
untouched, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import textkit as tk
from tessera.session import materialize, release, small_batches

MAX_LABELLED = 20_000
CUT = 0.5
NEAR = 5
ROUNDS, DEPTH, RATE, BINS, MIN_CHILD, L2 = 60, 3, 0.2, 32, 1.0, 2.0
#: A split must gain so much; splits on noise gain less.
MIN_GAIN = 6.0

LEXICONS = {
    "insult": "idiot idiots moron morons clown clowns loser losers stupid dumb fool fools imbecile jerk dimwit halfwit simpleton cretin buffoon dunce nitwit pathetic worthless useless coward liar creep freak weirdo brainless clueless ignorant trottel dummkopf depp idiotisch blödmann versager vollidiot imbécile crétin abruti débile idiota imbécil estúpido tonto payaso perdedor inútil",
    "profanity": "damn damned crap bullshit shit shitty fuck fucking fucker bastard bitch asshole arsehole bollocks piss prick scheiße scheisse arschloch verdammt wichser merde connard salope putain enculé mierda cabrón puta joder gilipollas",
    "threat": "kill murder hang shoot strangle smash destroy hurt punch stab töten umbringen sterben schlagen tuer crever frapper mourir matar muere morir golpear",
    "contempt": "trash scum disgusting garbage filth filthy vermin vile repulsive despicable parasite parasites subhuman rubbish abscheulich abschaum ekelhaft dreck müll widerlich ordure racaille dégoûtant vermine immonde basura escoria asqueroso repugnante",
}
SECOND = "you your yours yourself ur thou thee du dich dir dein deine deiner ihr euch euer tu toi te ton ta tes vous votre vos tú ti tus usted ustedes vosotros"
NAMES = [
    *LEXICONS, "learned_words", "learned_begins", "odds", "odds_density", "best_odds", "hits", "distinct", "second", "near_second",
    "capitals", "capital_words", "exclaim", "question", "punctuation", "mixed", "hidden", "stretched", "length",
]
#: Bytes of a word's beginning; the word must go on.
PREFIXES = (4, 5, 6, 7, 8)
FOLDS = 5
#: How much more of the toxic documents than of the others must hold a learned entry.
LIFT = 8.0
#: A learned entry is in so many toxic documents at least, and in one of `SUPPORT_SHARE` of them.
SUPPORT, SUPPORT_SHARE = 3, 120
ENTRIES = 16_384
_WORD_KIND, _BEGIN_KIND = 4, 5

_LEET = str.maketrans("013457@$!|€", "oleastasile")
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[65:91] = _LETTER[128:] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[i for i in range(33, 127) if not chr(i).isalnum()]] = True
_SALT = np.random.default_rng(11).integers(1, 1 << 63, len(PREFIXES), dtype=np.uint64)
#: Held by every document: what is counted under it is the number of documents.
_ALL = np.uint64(0)


def _hashes(words: list[str]) -> np.ndarray:
    return tk.words(pa.array(words)).hash


_KNOWN = np.concatenate([_hashes(ws.split()) for ws in LEXICONS.values()])
_KNOWN_KIND = np.repeat(np.arange(4), [len(ws.split()) for ws in LEXICONS.values()])
_SECOND = np.sort(_hashes(SECOND.split()))


def _among(h: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in h whose value is known, and where in `known`."""
    if not len(known):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # most values fail on sixteen of their bits already
    maybe = np.zeros(1 << 16, bool)
    maybe[(known & np.uint64(0xFFFF)).astype(np.int64)] = True
    some = np.flatnonzero(maybe[(h & np.uint64(0xFFFF)).astype(np.int64)])
    k = np.minimum(np.searchsorted(known, h[some]), len(known) - 1)
    same = known[k] == h[some]
    return some[same], k[same]


class Lexicon:
    """Entries by their hash: kind (0 to 3 a known list, 4 a learned word, 5 a learned beginning) and log odds."""

    def __init__(self, key: np.ndarray, kind: np.ndarray, odds: np.ndarray) -> None:
        order = np.argsort(key, kind="stable")
        self.key, self.kind, self.odds = key[order], kind[order], odds[order]
        self.words = self.key[self.kind < _BEGIN_KIND]


KNOWN = Lexicon(_KNOWN, _KNOWN_KIND, np.zeros(len(_KNOWN)))


def letter_words(low: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tk.split(low, offs, ~_LETTER[low])


def begins(low: np.ndarray, start: np.ndarray, end: np.ndarray, sums: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: words that go on beyond it, and the hash of their beginning."""
    for salt, n in zip(_SALT, PREFIXES, strict=True):
        at = np.flatnonzero(end - start > n)
        yield at, tk.token_hashes(low, start[at], start[at] + n, sums) ^ salt


def features(texts: pa.Array, lexicon: Lexicon = KNOWN) -> np.ndarray:
    """One row a text, columns as in NAMES."""
    plain = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    plain = pc.fill_null(plain.cast(pa.large_string()), "")
    low, offs = tk.flat(pc.utf8_lower(plain))
    raw, roffs = tk.flat(plain)
    n = len(offs) - 1
    start, end = letter_words(low, offs)
    sums = tk.byte_sums(low)
    h = tk.token_hashes(low, start, end, sums)
    bounds = np.searchsorted(start, offs)
    count = np.diff(bounds)
    doc = np.repeat(np.arange(n), count)
    size = np.maximum(count, 1)
    out = {name: np.zeros(n) for name in NAMES}

    def per_doc(mask: np.ndarray, o: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[o])

    found = [_among(h, lexicon.key)]
    for at, beginning in begins(low, start, end, sums):
        k, which = _among(beginning, lexicon.key)
        found.append((at[k], which))
    at, which = (np.concatenate(x) for x in zip(*found, strict=True))
    kind, odds = lexicon.kind[which], lexicon.odds[which]
    for k, name in enumerate([*LEXICONS, "learned_words", "learned_begins"]):
        out[name] = np.bincount(doc[np.unique(at[kind == k])], minlength=n) / size
    # a word's strongest entry counts once, however many of its beginnings are entries
    order = np.lexsort((-odds, at))
    first = order[np.concatenate([[True], np.diff(at[order]) != 0])] if len(order) else order
    hit, strength = at[first], odds[first]
    out["odds"] = np.bincount(doc[hit], strength, minlength=n)
    out["odds_density"] = out["odds"] / size
    np.maximum.at(out["best_odds"], doc[hit], strength)
    out["hits"] = np.log1p(np.bincount(doc[hit], minlength=n))
    out["distinct"] = np.bincount(np.unique(doc[hit] * np.int64(len(lexicon.key) + 1) + which[first]) // (len(lexicon.key) + 1), minlength=n).astype(float)
    you, _ = _among(h, _SECOND)
    out["second"] = np.bincount(doc[you], minlength=n) / size
    if len(you) and len(hit):
        k = np.searchsorted(you, hit)
        after, before = you[np.minimum(k, len(you) - 1)], you[np.maximum(k - 1, 0)]
        near = [(np.abs(p - hit) <= NEAR) & (doc[p] == doc[hit]) for p in (after, before)]
        out["near_second"] = np.log1p(np.bincount(doc[hit[near[0] | near[1]]], minlength=n))
    upper = (raw >= 65) & (raw <= 90)
    letters = np.maximum(per_doc(_LETTER[raw], roffs), 1)
    out["capitals"] = per_doc(upper, roffs) / letters
    s, e = letter_words(raw, roffs)
    ups = np.concatenate([[0], np.cumsum(upper, dtype=np.int64)])
    loud = np.flatnonzero((ups[e] - ups[s] == e - s) & (e - s >= 2))
    out["capital_words"] = np.bincount(np.searchsorted(roffs, s[loud], "right") - 1, minlength=n) / size
    out["exclaim"] = per_doc(raw == 33, roffs) / size
    out["question"] = per_doc(raw == 63, roffs) / size
    out["punctuation"] = per_doc(_SYMBOL[raw], roffs) / size
    # tokens between white space whose letters are interrupted
    ts, te = tk.split(low, offs, tk._SPACE[low])
    if len(start):
        runs = np.searchsorted(start, te) - np.searchsorted(start, ts)
        broken = np.flatnonzero((runs >= 2) & (te - ts <= 40))
        where = np.searchsorted(offs, ts[broken], "right") - 1
        out["mixed"] = np.bincount(where, minlength=n) / size
        out["hidden"] = np.log1p(np.bincount(where[_hidden(low, ts[broken], te[broken], lexicon)], minlength=n))
    same = np.zeros(len(low), bool)
    if len(low) > 2:
        same[2:] = (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2]) & (low[2:] >= 97) & (low[2:] <= 122)
    out["stretched"] = per_doc(same, offs) / size
    out["length"] = np.log1p(count)
    return np.stack([out[name] for name in NAMES], 1)


def _hidden(low: np.ndarray, ts: np.ndarray, te: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """Which of the broken tokens are a lexicon word once symbols are taken for letters or left out."""
    forms, of = [], []
    for i, (a, b) in enumerate(zip(ts, te, strict=True)):
        token = low[a:b].tobytes().decode("utf-8", "ignore").strip(".,;:?\"'()[]")
        parts = token.translate(_LEET)
        for form in {parts, "".join(c for c in parts if c.isalpha()), "".join(c for c in token if c.isalpha())}:
            if form and not any(c.isspace() for c in form):
                forms.append(form)
                of.append(i)
    if not forms:
        return np.zeros(0, np.int64)
    w = tk.words(pa.array(forms, pa.large_string()), lower=False)
    ok, _ = _among(w.hash, lexicon.words)
    return np.unique(np.array(of, np.int64)[w.doc[ok]])


@dataclass
class Model:
    """Trees as arrays in heap order; a leaf's feature is -1."""

    base: float = 0.0
    constant: float | None = None
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    steps: tuple[np.ndarray, np.ndarray] | None = None
    lexicon: Lexicon = field(default_factory=lambda: KNOWN)

    def raw(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        for feat, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f = feat[node]
                go = f >= 0
                right = x[np.arange(len(x)), np.maximum(f, 0)] > cut[node]
                node = np.where(go, 2 * node + 1 + right, node)
            score += leaf[node]
        return score

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        s = self.raw(x)
        if self.steps is None:
            return 1 / (1 + np.exp(-s))
        return np.interp(s, *self.steps)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; knots (score, value) to interpolate between. Equal scores are pooled first."""
    knots, back = np.unique(score, return_inverse=True)
    w = np.bincount(back).astype(float)
    v = np.bincount(back, weights=y) / w
    blocks: list[list[float]] = []
    for i in range(len(knots)):
        blocks.append([v[i], w[i], knots[i], knots[i]])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2], b[3]])
    xs = np.array([x for b in blocks for x in (b[2], b[3])])
    ys = np.array([b[0] for b in blocks for _ in range(2)])
    keep = np.concatenate([[True], np.diff(xs) > 0])
    return xs[keep], ys[keep]


def boost(x: np.ndarray, y: np.ndarray) -> Model:
    p = y.mean() if len(y) else 0.0
    if p in (0.0, 1.0):
        return Model(constant=float(p))
    model = Model(base=float(np.log(p / (1 - p))))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    # rare counts vanish in quantiles of all rows: add quantiles of what isn't 0
    cuts = [np.unique(np.concatenate([[0.0], c, np.quantile(z, np.linspace(0, 1, 9))])) if len(z := x[x[:, j] > 0, j]) else c for j, c in enumerate(cuts)]
    binned = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], 1)
    score = np.full(len(y), model.base)
    for _ in range(ROUNDS):
        q = 1 / (1 + np.exp(-score))
        g, hs = y - q, np.maximum(q * (1 - q), 1e-9)
        size = 2 ** (DEPTH + 1) - 1
        feat, cut, leaf = np.full(size, -1), np.zeros(size), np.zeros(size)
        node = np.zeros(len(y), np.int64)
        for k in range(size):
            rows = np.flatnonzero(node == k)
            if not len(rows):
                continue
            gs, ws = g[rows].sum(), hs[rows].sum()
            leaf[k] = RATE * gs / (ws + L2)
            if k >= 2**DEPTH - 1:
                continue
            best = (MIN_GAIN, -1, 0)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                b = binned[rows, j]
                gl = np.cumsum(np.bincount(b, g[rows], len(c) + 1))[:-1]
                wl = np.cumsum(np.bincount(b, hs[rows], len(c) + 1))[:-1]
                gain = gl**2 / (wl + L2) + (gs - gl) ** 2 / (ws - wl + L2) - gs**2 / (ws + L2)
                gain[(wl < MIN_CHILD) | (ws - wl < MIN_CHILD)] = 0
                if gain[i := int(np.argmax(gain))] > best[0]:
                    best = (gain[i], j, i)
            if best[1] >= 0:
                feat[k], cut[k] = best[1], cuts[best[1]][best[2]]
                node[rows] = 2 * k + 1 + (binned[rows, best[1]] > best[2])
        if feat[0] < 0:
            break
        model.trees.append((feat, cut, leaf))
        score += leaf[node]
    return model


def fit_arrays(x: np.ndarray, y: np.ndarray) -> Model:
    """Trees on four of five rows, calibration on the fifth."""
    out = np.arange(len(y)) % 5 == 4
    model = boost(x[~out], y[~out])
    if model.constant is None and out.any():
        model.steps = isotonic(model.raw(x[out]), y[out])
    elif model.constant is not None and len(y):
        model.constant = float(y.mean())
    return model


@dataclass
class Counts:
    """In how many toxic and other labelled documents of each fold an entry is; `total` is the number of documents."""

    key: np.ndarray
    kind: np.ndarray
    toxic: np.ndarray
    other: np.ndarray
    total: tuple[np.ndarray, np.ndarray]

    def lexicon(self, without: int | None = None) -> Lexicon:
        """Learned entries and known words by the documents of all folds but one."""
        use = np.arange(FOLDS) != (-1 if without is None else without)
        t, c = self.toxic[:, use].sum(1), self.other[:, use].sum(1)
        nt, nc = self.total[0][use].sum(), self.total[1][use].sum()
        odds = np.log((t + 0.5) / (nt + 1)) - np.log((c + 0.5) / (nc + 1))
        enough = max(SUPPORT, nt / SUPPORT_SHARE)
        known = np.isin(self.key, _KNOWN)
        learned = np.flatnonzero((t >= enough) & (odds >= np.log(LIFT)) & ~known)
        learned = learned[np.lexsort((self.key[learned], -odds[learned] * t[learned]))[:ENTRIES]]
        # a known word that the others hold about as often as the toxic ones is no hit
        harmless = np.sort(self.key[known & (c >= enough) & (odds < 1)])
        keep = ~np.isin(_KNOWN, harmless)
        at = {int(k): float(o) for k, o in zip(self.key[known], odds[known], strict=True)}
        weight = np.array([max(at.get(int(k), 1.0), 1.0) for k in _KNOWN[keep]])
        return Lexicon(np.concatenate([_KNOWN[keep], self.key[learned]]), np.concatenate([_KNOWN_KIND[keep], self.kind[learned]]), np.concatenate([weight, odds[learned]]))


def folds(ids: np.ndarray) -> np.ndarray:
    return (tk.mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(FOLDS)).astype(np.int64)


def entries(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, hash, kind) of all words and beginnings, and `_ALL` for each document."""
    low, offs = tk.flat(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    start, end = letter_words(low, offs)
    sums = tk.byte_sums(low)
    doc = np.searchsorted(offs, start, "right") - 1
    n = len(offs) - 1
    docs, keys, kinds = [np.arange(n)], [np.full(n, _ALL)], [np.zeros(n, np.int64)]
    for at, key, kind in [(slice(None), tk.token_hashes(low, start, end, sums), _WORD_KIND), *((at, key, _BEGIN_KIND) for at, key in begins(low, start, end, sums))]:
        order = np.lexsort((key, d := doc[at]))
        d, key = d[order], key[order]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (key[1:] != key[:-1])
        docs.append(d[new])
        keys.append(key[new])
        kinds.append(np.full(new.sum(), kind))
    return np.concatenate(docs), np.concatenate(keys), np.concatenate(kinds)


def _entry_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, kind, part (fold, toxic or not) and documents, summed up within a slice."""
    for batch in batches:
        for part in tk.slices(batch, "text"):
            doc, key, kind = entries(part.column("text"))
            side = 2 * folds(part.column("doc_id").to_numpy()) + part.column("toxic").to_numpy()
            order = np.lexsort((side[doc], key))
            key, kind, side = key[order], kind[order], side[doc][order]
            head = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), (np.diff(side) != 0) | (key[1:] != key[:-1])]))
            n = np.diff(np.append(head, len(key)))
            yield pa.RecordBatch.from_arrays([tk.signed(key[head]), pa.array(kind[head].astype(np.int32)), pa.array(side[head].astype(np.int32)), pa.array(n)], names=["key", "kind", "side", "n"])


def learn(labelled: DataFrame) -> Counts:
    """Counts of what may become an entry; labelled: doc_id, text, toxic."""
    rows = labelled.mapInArrow(_entry_rows, "key long, kind int, side int, n long")
    sides = [F.sum(F.when(F.col("side") == s, F.col("n")).otherwise(0)).alias(f"s{s}") for s in range(2 * FOLDS)]
    counted = rows.groupBy("key", "kind").agg(*sides)
    toxic, other = (sum(F.col(f"s{2 * f + k}") for f in range(FOLDS)) for k in (1, 0))
    known = F.col("key").isin([int(k) for k in _KNOWN.view(np.int64)])
    everyone = labelled.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count(F.lit(1))).first()
    t, c = int(everyone[0]), int(everyone[1]) - int(everyone[0])
    # without one fold a rate may be twice that of all; the exact test is `lexicon`'s
    lift = (toxic + 0.5) / (t + 1) >= (LIFT / 2) * ((other + 0.5) / (c + 1))
    may = counted.where((F.col("key") == int(_ALL)) | known | ((toxic >= SUPPORT) & (toxic >= t * (FOLDS - 1) / FOLDS / SUPPORT_SHARE / 2) & lift))
    got = may.orderBy((F.col("key") == int(_ALL)).desc(), known.desc(), (toxic * F.log((toxic + 0.5) / (other + 0.5))).desc(), "key").limit(2 * ENTRIES).toPandas()
    n = got[[f"s{s}" for s in range(2 * FOLDS)]].to_numpy(np.int64).reshape(-1, FOLDS, 2)
    key = got["key"].to_numpy(np.int64).view(np.uint64)
    total = n[key == _ALL].sum(0)
    real = key != _ALL
    return Counts(key[real], got["kind"].to_numpy(np.int64)[real], n[real, :, 1], n[real, :, 0], (total[:, 1], total[:, 0]))


def _feature_rows(counts: Counts):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicons = [counts.lexicon(k) for k in range(FOLDS)]
        for batch in batches:
            for part in tk.slices(batch, "text"):
                fold = folds(part.column("doc_id").to_numpy())
                for k in np.unique(fold):
                    rows = part.take(pa.array(np.flatnonzero(fold == k)))
                    f = features(rows.column("text"), lexicons[k])
                    yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("toxic"), tk.lists(pa.array(f.ravel()), np.full(len(f), f.shape[1]))], names=["doc_id", "toxic", "f"])

    return run


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Model:
    """The bound `most` is on labelled documents; which ones depends on their ids alone."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    labelled = materialize(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").cast("long"), "text", "toxic"), "labelled")
    counts = learn(labelled)
    rows = labelled.mapInArrow(_feature_rows(counts), "doc_id long, toxic int, f array<double>").toPandas()
    release(labelled)
    if rows.empty:
        return Model(constant=0.0)
    x, y = np.array(rows["f"].tolist()), rows["toxic"].to_numpy().astype(float)
    order = np.lexsort((*x.T, y, rows["doc_id"].to_numpy()))
    model = fit_arrays(x[order], y[order])
    model.lexicon = counts.lexicon()
    return model


def scorer(model: Model):  # noqa: ANN202
    """Probability of each text, from Arrow to Arrow; texts don't come back from Python."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        parts = [model.probability(features(part.column(0), model.lexicon)) for part in tk.slices(pa.RecordBatch.from_arrays([texts], names=["text"]), "text")]
        return pa.array(np.concatenate([np.zeros(0), *parts]))

    return score


def toxicity(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """doc_id, score (calibrated probability) and toxic for every document."""
    small_batches(docs.sparkSession)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), scorer(model)(docs["text"]).alias("score"))
    return scored.withColumn("toxic", F.col("score") >= cut)


def reject_toxic(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """The documents that aren't toxic, all columns, in one pass."""
    small_batches(docs.sparkSession)
    return docs.where(scorer(model)(docs["text"]) < cut)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity(docs, fit(docs, labels))


QUERIES = {"op5_toxicity": query}
SQL: dict[str, str] = {}
