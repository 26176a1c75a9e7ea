"""Scores for abusive, hateful or sexual content: boosted trees over dense features, isotonically calibrated.

Features come from one segment-wise pass over a whole text: densities of fixed lexicons, of a lexicon induced from the
labelled documents (log-odds of words and word pairs), proximity of second-person words, capitals, punctuation, and what
it took to undo spellings meant to hide a word. The model is fitted on at most ``LABELLED`` labelled documents; scoring is
row by row in Arrow batches and moves no text between workers.
"""

from __future__ import annotations

import math
import pickle
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from allelica.functions.keys import require_columns

#: Most labelled documents that are fitted on (a sample by hash beyond that). Their texts are read whole, as in scoring.
LABELLED = 6_000

# Words per kind in English, German, French and Spanish, written down from general knowledge of the languages.
# A word of up to four letters counts if it is one of them, a longer one if it starts with one of them.
LEXICON = {
    "insult": "idiot moron imbecile stupid dumb dumbass retard loser scum scumbag jackass bastard asshole arsehole bitch twat prick dickhead wanker tosser pathetic worthless fatso coward liar freak pervert "
    "arschloch trottel depp vollidiot dummkopf schwachkopf blödmann wichser hurensohn missgeburt mistkerl drecksau dreckskerl penner spast versager feigling "
    "connard connasse salaud salopard enculé abruti crétin débile imbécile bâtard minable lâche "
    "cabrón gilipollas imbécil estúpido pendejo capullo hijoputa tonto cretino cobarde inútil",
    "profane": "fuck fucking shit shitty crap bullshit piss damn damned bollocks ass arse "
    "scheiße scheiss verdammt kacke fick fresse halt's verpiss merde putain foutre bordel chier chiant mierda coño joder hostia carajo chingar",
    "sexual": "porn sex sexy naked nude cock dick penis pussy vagina cunt tits boobs cum orgasm blowjob handjob horny masturbate anal slut whore erotic "
    "schwanz fotze titten möpse nackt hure nutte bumsen ficken geil wichsen bite chatte nichons baiser pute sucer branler seins polla coño tetas follar puta verga chupar desnud",
    "threat": "kill murder stab shoot strangle rape behead hang bleed die dead burn bullet knife throat beat "
    "töten umbringen erschießen abstechen sterben stirb tot blut messer tuer crever égorger mourir mort brûler couteau matar mataré degollar morir muere muerto sangre cuchillo",
    "degrade": "subhuman vermin cockroach parasite rats animals filth filthy inferior savages deport exterminate scum plague "
    "untermensch ungeziefer abschaum parasiten ausrotten vertreiben dreck vermine cafard sous-homme racaille exterminer sale escoria cucaracha plaga parásito infrahumano exterminar basura",
    "slur": "nigger nigga kike faggot fag chink spic paki tranny dyke kanake schwuchtel neger bougnoule youpin pédé sudaca maricón",
    "second": "you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch euer tu toi te ton ta tes vous votre vos tú ti tus usted ustedes vosotros",
    "report": "according said says wrote called calls quoted reported stated claimed alleged sagte laut nannte zufolge schrieb behauptete selon dit déclaré appelé écrit según dijo llamó escribió afirmó",
}
FLAT = lambda w: unicodedata.normalize("NFKD", w).encode("ascii", "ignore").decode()
LEX = {k: tuple(FLAT(w) for w in v.replace("ß", "ss").split()) for k, v in LEXICON.items()}
WHOLE = {k: frozenset(w for w in v if len(w) <= 4 or k in ("second", "report")) for k, v in LEX.items()}
START = {k: tuple(w for w in v if len(w) > 4 and k not in ("second", "report")) for k, v in LEX.items()}
# Look-alike letters of other scripts, and signs that stand for letters inside a word.
LOOK_ALIKE = str.maketrans("абвгдеіјкмнорстухѕѵүԁԛԝαβεικνορτυχ", "abbrdeijkmhopctyxsvydqwabeiknoptux")
SIGNS = str.maketrans("013457@$!€", "oieastasie")

_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][-._*· ]){3,}[^\W\d_](?![^\W_])")
_TOKEN = re.compile(r"[^\W_]+(?:[*#@$!€]+[^\W_]+)*|[\n.!?;|{}<>\[\]\"“”„«»]")
_MIXED = re.compile(r"[a-z][0-9@$!€]+[a-z]|^[@$][a-z]")
_RUN = re.compile(r"(.)\1{2,}")
_FLAT = re.compile(r"[\u0300-\u036f]+")
KINDS = list(LEX)
BAD = ("insult", "profane", "sexual", "threat", "degrade", "slur")
ENDS, BANG, QUOTES = set("\n.?;|{}<>[]"), "!", set("\"“”„«»")


def plain(word: str) -> tuple[str, int]:
    """A token in plain spelling, and 1 if that took more than case and accents."""
    w = word.casefold()
    hidden = 0
    if not w.isascii():
        w = _FLAT.sub("", unicodedata.normalize("NFKD", w))
        x = w.translate(LOOK_ALIKE)
        # letters of another script are look-alikes only where the word then reads as Latin
        if x != w and x.isascii():
            w, hidden = x, 1
    if "*" in w or "#" in w:
        return "<mask>", 1
    if not w.isalpha() and not w.isdigit() and _MIXED.search(w):
        w, hidden = w.translate(SIGNS), 1
    if len(w) > 3 and w.isalpha() and _RUN.search(w):
        w, hidden = _RUN.sub(r"\1", w), 1
    if w.isdigit():
        w = "9"
    if len(word) > 2:
        up = sum(c.isupper() for c in word[1:])
        if up and up < len(word) - 1:
            hidden = 1
    return w, hidden


class Coder(dict):
    """Codes of raw tokens, with what is known of each code in arrays. Cleared when it has ``most`` tokens, so that a
    worker's memory doesn't grow with the corpus."""

    def __init__(self, vocabulary: dict[str, int], most: int = 1 << 19):
        super().__init__()
        self.vocabulary, self.most = vocabulary, most
        self.rows: list[tuple] = []

    def __missing__(self, t: str) -> int:
        if len(t) == 1 and (t in ENDS or t == BANG or t in QUOTES):
            row = (0, 1 if t in ENDS else 2 if t == BANG else 3, 0, 0, 0, 0, 0)
        else:
            w, hidden = plain(t)
            kinds = sum(1 << i for i, k in enumerate(KINDS) if w in WHOLE[k] or w.startswith(START[k]))
            row = (self.vocabulary.get(w, 0), 0, kinds, hidden, sum(c.isupper() for c in t), len(t), int(w == "<mask>"))
        self[t] = code = len(self.rows)
        self.rows.append(row)
        return code

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(one row of properties per token of all texts, the document each belongs to)."""
        if len(self.rows) > self.most:
            self.clear()
            self.rows = []
        look, parts = self.__getitem__, []
        for t in texts:
            ts = _TOKEN.findall(_SPACED.sub(_join, t)) if t else []
            parts.append(np.fromiter(map(look, ts), "int32", len(ts)))
        table = np.array(self.rows, "int32").reshape(-1, 7)
        codes = np.concatenate(parts) if parts else np.zeros(0, "int32")
        return table[codes], np.repeat(np.arange(len(texts)), [len(p) for p in parts])


def _join(m: re.Match) -> str:
    return re.sub(r"[-._*· ]", "", m.group())


#: Gram kinds: word, pair, pair with one word between. Ids: kind * SPAN^2 + first * SPAN + second.
SPAN = 1 << 20


def grams(word: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gram ids, places of their last words). Words outside the vocabulary (names) are all word 0, which alone is no gram."""
    word, at = word.astype("int64"), np.arange(len(word), dtype="int32")
    ids, where = [word[word > 0]], [at[word > 0]]
    for gap in (1, 2):
        a, b = word[:-gap], word[gap:]
        ok = (seg[:-gap] == seg[gap:]) & ((a > 0) | (b > 0))
        ids.append(gap * SPAN * SPAN + a[ok] * SPAN + b[ok])
        where.append(at[gap:][ok])
    return np.concatenate(ids), np.concatenate(where)


@dataclass
class Induced:
    """Log-odds of grams (sorted ids). Counts are of pages, so that a page's own names and copies weigh little."""

    vocabulary: dict[str, int]
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, "int64"))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def __post_init__(self) -> None:
        # most grams of a text have no weight: a bit table answers that before the sorted ids are searched
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[self.slot(self.ids)] = True

    def __reduce__(self):
        return Induced, (self.vocabulary, self.ids, self.weights)

    @staticmethod
    def slot(ids: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = ids.astype("uint64") * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(42)).astype("int64")

    def look(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids))
        if len(self.ids):
            near = np.flatnonzero(self.sieve[self.slot(ids)])
            at = np.minimum(np.searchsorted(self.ids, ids[near]), len(self.ids) - 1)
            out[near] = np.where(self.ids[at] == ids[near], self.weights[at], 0.0)
        return out


def log_odds(pos: np.ndarray, neg: np.ndarray, ratio: float) -> np.ndarray:
    """Weight of a gram seen on ``pos`` and ``neg`` pages; 0 where seen too seldom or about equally on both."""
    w = np.clip(np.log((np.maximum(pos, 0) * ratio + 1.5) / (np.maximum(neg, 0) + 1.5)), -4, 4)
    return np.where((pos + neg < 2.5) | (np.abs(w) < 0.7), 0.0, w)


NAMES = (
    ["best", "second_best", "best_top", "best_n", "total", "worst", "n_hot"]
    + [f"{k}_best" for k in KINDS] + [f"{k}_rate" for k in KINDS]
    + ["near_second", "caps_best", "caps", "bang_best", "bang", "hidden_best", "hidden", "mask", "quote_best", "repeat", "words", "best_len"]
)


def layout(rows: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word tokens' places, their segments, the documents of all segments): segments end at marks and documents."""
    cut = (rows[:, 1] == 1) | (rows[:, 1] == 2)
    seg = np.cumsum(cut | np.concatenate([[True], np.diff(doc) > 0])) - 1 if len(rows) else np.zeros(0, "int64")
    first = np.flatnonzero(np.concatenate([[True], np.diff(seg) > 0])) if len(rows) else np.zeros(0, "int64")
    return np.flatnonzero(rows[:, 1] == 0), seg, doc[first]


def features(rows: np.ndarray, doc: np.ndarray, n_docs: int, weigh) -> np.ndarray:
    """Documents x NAMES. ``weigh(gram ids, their documents)`` gives the grams' weights."""
    x = np.zeros((n_docs, len(NAMES)))
    if not len(rows):
        return x
    places, seg_all, seg_doc = layout(rows, doc)
    if not len(places):
        return x
    n_seg = len(seg_doc)
    t, seg, tdoc = rows[places], seg_all[places], doc[places]
    ids, where = grams(t[:, 0], seg)
    w, gseg = weigh(ids, tdoc[where]), seg[where]
    hot = w != 0
    w, gseg = w[hot], gseg[hot]
    up = np.bincount(gseg, np.maximum(w, 0), n_seg)
    down = np.bincount(gseg, np.minimum(w, 0), n_seg)
    top = np.zeros(n_seg)
    np.maximum.at(top, gseg, w)
    n_up = np.bincount(gseg, w > 1.5, n_seg)
    length = np.bincount(seg, minlength=n_seg)
    kind = np.stack([np.bincount(seg, (t[:, 2] >> i) & 1, n_seg) for i in range(len(KINDS))], 1)
    bad_mask = sum(1 << KINDS.index(k) for k in BAD)
    bad = np.flatnonzero(t[:, 2] & bad_mask)
    near = np.full(n_seg, 20.0)
    if len(bad):
        you = np.flatnonzero((t[:, 2] >> KINDS.index("second")) & 1)
        for side in (0, -1):
            if len(you):
                at = np.searchsorted(you, bad) + side
                ok = (at >= 0) & (at < len(you))
                b, y = bad[ok], you[at[ok]]
                same = seg[b] == seg[y]
                np.minimum.at(near, seg[b[same]], np.abs(b - y)[same].astype(float))
    caps = np.bincount(seg, t[:, 4], n_seg) / np.maximum(1, np.bincount(seg, t[:, 5], n_seg))
    hidden = np.bincount(seg, t[:, 3], n_seg)
    # a mark belongs to the segment before it
    bang_at = seg_all[rows[:, 1] == 2] - 1
    bang_at = bang_at[bang_at >= 0]
    bang = np.bincount(bang_at[seg_doc[bang_at] == seg_doc[np.minimum(bang_at + 1, n_seg - 1)]], minlength=n_seg)
    quote = np.bincount(seg_all[rows[:, 1] == 3], minlength=n_seg)
    with np.errstate(over="ignore"):
        mark = (t[:, 0] + 1).astype("uint64") * np.uint64(0xD6E8FEB86659FD93)
        mark ^= mark >> np.uint64(29)
    alike = np.zeros(n_seg, "uint64")
    np.add.at(alike, seg, mark)
    key = alike * np.uint64(31) + seg_doc.astype("uint64")
    full = length >= 3
    _, back, n_alike = np.unique(key[full], return_inverse=True, return_counts=True)
    repeat = np.ones(n_seg)
    repeat[full] = n_alike[back]
    score = up + down
    rank = score + 0.5 * kind[:, [KINDS.index(k) for k in BAD]].sum(1) + hidden
    order = np.lexsort((np.arange(n_seg), -rank, seg_doc))
    firsts = np.flatnonzero(np.concatenate([[True], np.diff(seg_doc[order]) > 0]))
    d, best = seg_doc[order][firsts], order[firsts]
    words = np.bincount(tdoc, minlength=n_docs)
    by = lambda v: np.bincount(seg_doc, v, n_docs)
    x[d, 0] = score[best]
    has2 = np.append(np.diff(firsts), n_seg - firsts[-1]) > 1
    x[d[has2], 1] = score[order[firsts[has2] + 1]]
    x[d, 2], x[d, 3] = top[best], n_up[best]
    x[:, 4] = by(np.maximum(score, 0)) / np.maximum(1, words)
    np.minimum.at(x[:, 5], seg_doc, down)
    x[:, 6] = by(score > 3)
    k = len(KINDS)
    x[d, 7 : 7 + k] = kind[best]
    for i in range(k):
        x[:, 7 + k + i] = 100.0 * by(kind[:, i]) / np.maximum(1, words)
    o = 7 + 2 * k
    x[:, o] = 20
    x[d, o], x[d, o + 1] = near[best], caps[best]
    x[:, o + 2] = by(np.bincount(seg, t[:, 4], n_seg)) / np.maximum(1, by(np.bincount(seg, t[:, 5], n_seg)))
    x[d, o + 3] = bang[best]
    x[:, o + 4] = by(bang)
    x[d, o + 5] = hidden[best]
    x[:, o + 6] = by(hidden)
    x[:, o + 7] = np.bincount(tdoc, t[:, 6], n_docs)
    x[d, o + 8] = quote[best]
    np.maximum.at(x[:, o + 9], seg_doc, repeat)
    x[:, o + 10] = np.log1p(words)
    x[d, o + 11] = length[best]
    return x


@dataclass
class Trees:
    """Boosted regression trees on binned features (logistic loss). Each tree is arrays of a full binary tree."""

    edges: list[np.ndarray]
    base: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1) if len(x) else np.zeros((0, len(self.edges)), int)
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feat, cut, leaf in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                at = 2 * at + 1 + (b[rows, feat[at]] > cut[at])
            out += leaf[at - (2**self.depth - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 150, depth: int = 3, rate: float = 0.08, bins: int = 48, ridge: float = 8.0) -> Trees:
    """Gradient boosting with second-order leaves; deterministic."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    b = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    mean = min(max(float((w * y).sum() / w.sum()), 1e-4), 1 - 1e-4)
    model = Trees(edges, math.log(mean / (1 - mean)), [], depth)
    f = np.full(len(y), model.base)
    inner, leaves = 2**depth - 1, 2**depth
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        g, h = w * (p - y), w * p * (1 - p)
        feat, cut, at = np.zeros(inner, int), np.full(inner, bins), np.zeros(len(y), int)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            node = at - first
            gain = np.zeros(width)
            for j in range(x.shape[1]):
                k = len(edges[j]) + 1
                key = node * k + b[:, j]
                gs = np.bincount(key, g, width * k).reshape(width, k).cumsum(1)
                hs = np.bincount(key, h, width * k).reshape(width, k).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                s = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                s[(hs < 2) | (ht - hs < 2)] = 0
                best = s.argmax(1)
                better = s[np.arange(width), best] > gain + 1e-9
                gain[better] = s[np.arange(width), best][better]
                feat[first : first + width][better] = j
                cut[first : first + width][better] = best[better]
            at = 2 * at + 1 + (b[np.arange(len(y)), feat[at]] > cut[at])
        leaf_of = at - inner
        leaf = -rate * np.bincount(leaf_of, g, leaves) / (np.bincount(leaf_of, h, leaves) + ridge)
        f = f + leaf[leaf_of]
        model.trees.append((feat, cut, leaf))
    return model


def isotonic(score: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: (thresholds, values) of a non-decreasing step function, read by interpolation."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v, u in zip(score[order], y[order], w[order]):
        blocks.append([v * u, u, s, s])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            a, c, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a, blocks[-1][1] + c, blocks[-1][2], hi]
    xs = np.array([(b[2] + b[3]) / 2 for b in blocks])
    return xs, np.array([b[0] / b[1] for b in blocks])


@dataclass
class Model:
    induced: Induced
    trees: Trees
    knots: tuple[np.ndarray, np.ndarray]

    def scores(self, texts: list[str | None], coder: Coder) -> np.ndarray:
        rows, doc = coder.encode(texts)
        x = features(rows, doc, len(texts), lambda ids, _: self.induced.look(ids))
        p = np.interp(self.trees.margin(x), *self.knots) if len(texts) else np.zeros(0)
        return np.where([t is None or not t.strip() for t in texts], 0.0, p)


def _vocabulary(texts: list[str], pages: np.ndarray, least: int = 4) -> dict[str, int]:
    """Plain words seen on ``least`` pages, numbered from 1 in sorted order."""
    seen: dict[str, set] = {}
    cache: dict[str, str] = {}
    for text, page in zip(texts, pages.tolist()):
        for t in set(_TOKEN.findall(_SPACED.sub(_join, text))):
            w = cache.get(t)
            if w is None:
                w = cache[t] = plain(t)[0]
            s = seen.setdefault(w, set())
            if len(s) < least:
                s.add(page)
    return {w: i + 1 for i, w in enumerate(sorted(w for w, s in seen.items() if len(s) >= least))}


def fit(texts: list[str], labels: np.ndarray, weights: np.ndarray, pages: list) -> Model:
    """Induce the lexicon, boost, calibrate. Each document's features while fitting leave its own page out of the
    lexicon's counts; calibration uses margins from folds of pages that were left out."""
    names = {p: i for i, p in enumerate(dict.fromkeys(pages))}
    page = np.array([names[p] for p in pages], "int64")
    vocabulary = _vocabulary(texts, page)
    rows, doc = Coder(vocabulary).encode(texts)
    places, seg_all, _ = layout(rows, doc)
    ids, where = grams(rows[places, 0], seg_all[places])
    gdoc = doc[places][where]
    del where, places, seg_all
    kinds, times = np.unique(ids, return_counts=True)
    kinds = kinds[times >= 3]
    # grams seen less often than on three pages have no weight
    inv = np.searchsorted(kinds, ids)
    inv[inv == len(kinds)] = 0
    common = np.flatnonzero(kinds[inv] == ids) if len(kinds) else np.zeros(0, "int64")
    n_grams = len(ids)
    del ids, times
    inv, gdoc = inv[common], gdoc[common]
    key = page[gdoc] * len(kinds) + inv
    cells, cell = np.unique(key, return_inverse=True)
    # a page is as abusive as its most abusive document with the gram, and as clean as its cleanest
    pos, neg = np.zeros(len(cells)), np.zeros(len(cells))
    np.maximum.at(pos, cell, labels[gdoc])
    np.maximum.at(neg, cell, 1 - labels[gdoc])
    gram_of = cells % max(1, len(kinds))
    p, n = np.bincount(gram_of, pos, len(kinds)), np.bincount(gram_of, neg, len(kinds))
    ratio = max(1.0, float((1 - labels).sum() / max(1.0, labels.sum())))
    own = np.zeros(n_grams)
    own[common] = log_odds(p[gram_of] - pos, n[gram_of] - neg, ratio)[cell]
    del key, cells, cell, inv, gdoc, common
    x = features(rows, doc, len(texts), lambda i, d: own)
    w = log_odds(p, n, ratio)
    induced = Induced(vocabulary, kinds[w != 0], w[w != 0])
    fold = page * 2654435761 % 2**32 // 65536 % 4
    margin = np.zeros(len(texts))
    for k in range(4):
        held = fold == k
        if held.any() and not held.all():
            margin[held] = boost(x[~held], labels[~held], weights[~held]).margin(x[held])
    trees = boost(x, labels, weights)
    if len(set(fold.tolist())) < 2:
        margin = trees.margin(x)
    return Model(induced, trees, isotonic(margin, labels, weights))


def _fit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [r for b in batches for r in b.to_pylist()]
    rows.sort(key=lambda r: r["doc_id"])
    y = np.array([r["_y"] for r in rows], float)
    if len(y) and y.min() < 0.5 <= y.max():
        model = fit([r["_text"] for r in rows], y, np.array([r["_n"] for r in rows], float), [r["_page"] for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])


def train(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> Model | None:
    """Model from the labelled documents: mean label over raters, weighted by their number. None without both classes."""
    votes = labels.where("doc_id is not null and abusive is not null").groupBy("doc_id").agg(F.avg("abusive").alias("_y"), F.count(F.lit(1)).cast("double").alias("_n"))
    some = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    page = F.col("page_id") if "page_id" in docs.columns else F.col("doc_id")
    rows = docs.where("text is not null").select("doc_id", F.coalesce(page, -F.col("doc_id") - 1).alias("_page"), F.col("text").alias("_text")).join(F.broadcast(some), "doc_id")
    # a bounded number of texts: one task fits them, only the model comes to the driver
    got = rows.dropDuplicates(["doc_id"]).repartition(1).mapInArrow(_fit_task, "model binary").collect()
    return pickle.loads(bytes(got[0]["model"])) if got else None


def _score(shared, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        coder = Coder(model.induced.vocabulary)
        for b in batches:
            texts, parts, at, size = b.column("text").to_pylist(), [], 0, 0
            for i, t in enumerate(texts):
                size += len(t or "")
                if size > 1 << 21 or i + 1 == len(texts):
                    parts.append(model.scores(texts[at : i + 1], coder))
                    at, size = i + 1, 0
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(score, pa.float64())], [*keep, "score"])

    return run


def score_documents(docs: DataFrame, labels: DataFrame, keep: list[str], model: Model | None = None) -> DataFrame:
    """``keep`` and ``score`` (calibrated probability, 0..1) of every document row.

    Null, empty and blank texts score 0, repeated rows score alike, texts of any length are read whole. Labels of unknown
    documents, null labels and null ids are ignored; without labels of both kinds there is no model and every score is
    null. ``model`` is one that ``train`` has given before. Columns other than doc_id, page_id (optional), text and ``keep``
    aren't read.
    """
    require_columns(docs, "doc_id", "text", *keep)
    require_columns(labels, "doc_id", "abusive")
    model = model or train(docs, labels)
    if model is None:
        return docs.select(*keep, F.lit(None).cast("double").alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("score", T.DoubleType())])
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(_score(shared, keep), schema)
