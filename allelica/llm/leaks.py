"""Documents that hold passages of held-out test items, found by spaced seeds and verified by alignment.

Both sides are reduced to words (case, accents, punctuation, entities, layout, hyphens, markup, references and comments
don't count). Fixed masks over consecutive words ignore selected positions; the hashes of masked words of items and
documents are joined. Hits on nearby diagonals must cover as many of the item's words as every true passage does; those
candidates are aligned word by word on the band's diagonals.

Scale: the corpus is read once, whatever the number of items. A register-blocked Bloom filter of the items' seeds, of
bounded size, lets only seeds through that (almost surely) some item has; a document with such a seed sends the words around
it, the rest of the corpus never leaves its task. Seeds are then joined by hash, frequent ones salted, hits are counted per
stretch of a document, item and band of diagonals, and only candidates meet the words of both sides. Nothing but the filter
comes to the driver.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from allelica.functions.keys import materialize, require_columns
from allelica.operators.skew import salted_sides

#: Words a seed looks at; the others are ignored, so that a substituted one there costs no hit. A passage of n words with at
#: most n / 10 edits always holds seven words in a row, in which the first mask fits, but for some short lengths. The rest
#: serve short items, whose passages may hold no longer run; runs of one or two words have no room for a gap.
MASKS = ((0, 1, 2, 4, 5, 6), (0, 1, 2, 4, 5), (0, 1, 3, 4), (0, 1, 3), (0, 2), (0, 1), (0,))
#: Span of the first mask.
RUN = 7
#: At least this share of an item's words must lie in a passage, and at most this share of the passage may be edited.
LEAST, EDITS = 0.5, 0.1
#: Least width of a band of diagonals, in words.
BAND = 16
#: Most words of 64 bits in the filter (32 MB); at one word a seed up to that, it lets hardly any other seed through. A
#: larger set of items only makes it less selective: what passes is joined exactly.
FILTER_WORDS = 1 << 22

_COMMENT = re.compile(r"<!--(.*?)(?:-->|\Z)", re.S)
_REF = re.compile(r"<(ref|sup)\b(?:[^>]*/>|[^>]*>(.*?)</\1\s*>)", re.S | re.I)
_TEMPLATE = re.compile(r"\{\{([^{}]*)\}\}")
_PIPED = re.compile(r"\[\[[^\[\]|]*\|([^\[\]]*)\]\]")
_EXTERNAL = re.compile(r"\[(?:https?:)?//\S+\s*([^\]]*)\]")
_INLINE = re.compile(r"</?(?:i|b|em|strong|u|s|small|big|span|font|nowiki|code|tt|mark)\b[^>]*>", re.I)
_TAG = re.compile(r"<[^<>]*>")
_JOINED = re.compile(r"(?<=\w)[-‐‑­​-‍](?:[ \t]*\r?\n[ \t]*)?(?=\w)|(?<=\d),(?=\d\d\d)|(?<=\w)­|'{2,}|\[\[|\]\]")
_MARK = re.compile(r"[̀-ͯ]+")
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Words of a text with markup, references and comments taken out of its flow; their contents follow at the end, so
    that passages inside them are found as well. A null text has none."""
    if not text:
        return []
    aside: list[str] = []

    def out(m: re.Match) -> str:
        part = m.group(m.lastindex) if m.lastindex else None
        if part and len(part) > 20:
            aside.append(part)
        return " "

    if "&" in text:
        text = html.unescape(text)
    if "<!--" in text:
        text = _COMMENT.sub(out, text)
    if "{{" in text:
        while True:
            text, n = _TEMPLATE.subn(out, text)
            if not n:
                break
    if "<" in text:
        text = _REF.sub(lambda m: out(m) if m.group(2) else " ", text)
    text = " \n".join([text, *aside])
    if "[" in text:
        text = _EXTERNAL.sub(r" \1 ", _PIPED.sub(r"\1", text))
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    text = _JOINED.sub("", text)
    if not text.isascii():
        text = _MARK.sub("", unicodedata.normalize("NFKD", text))
    return _WORD.findall(text.casefold())


def _band(item: np.ndarray, doc: np.ndarray, low: int, high: int) -> np.ndarray:
    """Whether item word i equals the document's word on diagonal low + d, as an (i, d) table. Code 0 equals nothing."""
    width = high - low + 1
    padded = np.zeros(len(item) + width - 1, "uint64")
    part = doc[max(0, low) : max(0, low + len(padded))]
    padded[max(0, -low) : max(0, -low) + len(part)] = part
    return np.lib.stride_tricks.sliding_window_view(padded, width)[: len(item)] == item[:, None]


def passage(item: list[str] | np.ndarray, doc: list[str] | np.ndarray, low: int | None = None, high: int | None = None, least: int = 1, edits: float = EDITS) -> tuple[int, int]:
    """(item words, edits) of the longest stretch of an item, of ``least`` words or more, that stands in a document with at
    most one in ``1 / edits`` of its words changed, added or dropped; (0, 0) if there is none. Words or codes (0: a word
    that the item hasn't). Its diagonals (document place less item place) lie between ``low`` and ``high``.

    Exact: for each number of edits, the furthest item word reached from every start on every diagonal (a stretch starts
    and ends with an equal word, so a start is the first word of a run)."""
    if not isinstance(item, np.ndarray):
        code = {w: i + 1 for i, w in enumerate(dict.fromkeys(item))}
        item, doc = np.array([code[w] for w in item], "uint64"), np.array([code.get(w, 0) for w in doc], "uint64")
    n = len(item)
    low, high = max(1 - n, -n if low is None else low), min(len(doc) - 1, len(doc) if high is None else high)
    if not n or high < low:
        return 0, 0
    same = _band(item, doc, low, high)
    run = np.zeros((n + 1, high - low + 1), "int32")
    for i in range(n - 1, -1, -1):
        run[i] = (run[i + 1] + 1) * same[i]
    first = same.copy()
    first[1:] &= ~same[:-1]
    # a diagonal's equal words up to the furthest one are reached with no more edits: the last of them ends the stretch
    last = np.zeros_like(run)
    last[1:] = np.maximum.accumulate(np.where(same, np.arange(1, n + 1, dtype="int32")[:, None], 0), 0)
    i0, d0 = np.nonzero(first[: n - least + 1])
    most, best = int(edits * n), (0, 0)
    chunk = max(1, (1 << 20) // (2 * most + 1))
    for at in range(0, len(i0), chunk):
        i, d = i0[at : at + chunk, None], d0[at : at + chunk, None] + np.arange(-most, most + 1)
        inside = (d >= 0) & (d < run.shape[1])
        d = np.clip(d, 0, run.shape[1] - 1)
        reach = np.full(d.shape, -1, "int64")
        reach[:, most] = i[:, 0]
        for e in range(most + 1):
            if e:
                on = np.where(reach >= 0, np.minimum(reach + 1, n), -1)
                new = on.copy()
                np.maximum(new[:, 1:], reach[:, :-1], out=new[:, 1:])
                np.maximum(new[:, :-1], on[:, 1:], out=new[:, :-1])
                reach = np.where(inside, new, -1)
            reach += np.where(reach >= 0, run[reach, d], 0)
            got = np.where(reach >= 0, last[reach, d] - i, 0)
            got = int(np.where(e <= edits * got, got, 0).max())
            if got >= least and got > best[0]:
                best = (got, e)
    return best


class Codes(dict):
    """64-bit hashes of words, kept for as many words as a worker's memory bears."""

    MOST = 1 << 19

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = code = xxhash.xxh64_intdigest(word) or 1
        return code

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), "uint64", len(words))


def least_run(length: int, least: float = LEAST, edits: float = EDITS) -> int:
    """Words that every passage of at least ``least`` of an item holds in a row between its edits."""
    return min(-(-(m - int(edits * m)) // (int(edits * m) + 1)) for m in range(max(1, int(np.ceil(least * length))), length + 1))


def mask_of(length: int, least: float = LEAST, edits: float = EDITS) -> int:
    """The mask for an item of this length: the longest that fits into the shortest run a passage must hold."""
    return RUN - min(RUN, max(1, least_run(length, least, edits)))


def least_hits(length: int, least: float = LEAST, edits: float = EDITS) -> int:
    """Seeds that every passage of an item shares with it at least: a run of r words between edits holds r - span + 1."""
    span = MASKS[mask_of(length, least, edits)][-1] + 1
    return max(1, min(m - int(edits * m) - (span - 1) * (int(edits * m) + 1) for m in range(max(1, int(np.ceil(least * length))), length + 1)))


def seed_hashes(codes: np.ndarray, m: int) -> np.ndarray:
    """Hash of the masked words from each position on."""
    mask = MASKS[m]
    n = len(codes) - mask[-1]
    if n <= 0:
        return np.zeros(0, "uint64")
    h = np.full(n, 0x9E3779B97F4A7C15 * (m + 1) & (2**64 - 1), "uint64")
    with np.errstate(over="ignore"):
        for o in mask:
            h = (h ^ codes[o : o + n]) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
    return h


ITEM = T.StructType(
    [
        T.StructField("iid", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("need", T.IntegerType()), T.StructField("mask", T.IntegerType()),
        T.StructField("words", T.ArrayType(T.LongType())), T.StructField("h", T.ArrayType(T.LongType())),
    ]
)


def _items(least: float, edits: float):
    """Words and seeds of items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for b in batches:
            rows = []
            for iid, item_id, text in zip(*(b.column(c).to_pylist() for c in ("iid", "item_id", "text"))):
                c = codes.of(words(text))
                if len(c):
                    m = mask_of(len(c), least, edits)
                    rows.append((iid, item_id, len(c), least_hits(len(c), least, edits), m, c.view("int64"), seed_hashes(c, m).view("int64")))
            cols = list(zip(*rows)) or [()] * len(ITEM)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], ITEM.names)

    return run


class Filter:
    """Register-blocked Bloom filter of a column of 64-bit hashes: a key sets five bits of one 64-bit word."""

    SHIFTS = (58, 52, 46, 40, 34)

    def __init__(self, keys: DataFrame, most: int = FILTER_WORDS):
        n = keys.select(F.approx_count_distinct("h")).first()[0] or 0
        self.words = min(most, 1 << max(10, int(np.ceil(np.log2(n + 1)))))
        mask = F.lit(0).cast("long")
        for s in self.SHIFTS:
            mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned("h", s).bitwiseAND(F.lit(63)).cast("int")))
        t = keys.groupBy(F.col("h").bitwiseAND(F.lit(self.words - 1)).alias("w")).agg(F.bit_or(mask).alias("b")).toArrow()
        self.bits = np.zeros(self.words, "uint64")
        self.bits[np.asarray(t.column("w"))] = np.asarray(t.column("b")).view("uint64")

    def passes(self, h: np.ndarray) -> np.ndarray:
        """Places of the hashes that may be seeds."""
        got = self.bits[h & np.uint64(self.words - 1)]
        near = np.flatnonzero(got)
        got, h = got[near], h[near]
        ok = np.ones(len(near), bool)
        for s in self.SHIFTS:
            ok &= (got >> ((h >> np.uint64(s)) & np.uint64(63))) & np.uint64(1) > 0
        return near[ok]


#: Words of documents that are searched at once; a longer document is searched by itself.
CHUNK = 1 << 18
STRETCH = T.StructType([T.StructField("rid", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("words", T.ArrayType(T.LongType())), T.StructField("h", T.ArrayType(T.LongType())), T.StructField("pos", T.ArrayType(T.IntegerType()))])


def stretches(docs: list[np.ndarray], masks: list[int], seeds: Filter, known: Filter, reach: int) -> Iterator[tuple]:
    """(document's place in the list, start, word hashes, seed hashes, their places from start) of the stretches of documents
    that hold seeds of items, with ``reach`` words on either side. Words that no item has become 0."""
    sizes = np.array([len(ws) + RUN for ws in docs], "int64")
    starts = np.cumsum(sizes) - sizes
    flat = np.zeros(int(sizes.sum()), "uint64")
    for ws, at in zip(docs, starts):
        flat[at : at + len(ws)] = ws
    hs, ps = [], []
    for m in masks:
        h = seed_hashes(flat, m)
        near = seeds.passes(h)
        hs.append(h[near])
        ps.append(near)
    h, pos = np.concatenate(hs), np.concatenate(ps)
    if not len(pos):
        return
    order = np.argsort(pos, kind="stable")
    h, pos = h[order], pos[order]
    word = np.zeros(len(flat), "uint64")
    keep = known.passes(flat)
    word[keep] = flat[keep]
    word, h = word.view("int64"), h.view("int64")
    doc = np.searchsorted(starts, pos, side="right") - 1
    cut = np.flatnonzero((np.diff(doc) > 0) | (np.diff(pos) > 2 * reach))
    for a, z in zip(np.append(0, cut + 1), np.append(cut + 1, len(pos))):
        d = int(doc[a])
        lo, hi = max(int(pos[a]) - reach, int(starts[d])), min(int(pos[z - 1]) + reach, int(starts[d]) + len(docs[d]))
        yield d, lo - int(starts[d]), word[lo:hi], h[a:z], (pos[a:z] - lo).astype("int32")


def _probe(shared, masks: list[int], reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, (seeds, known) = Codes(), shared.value
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
        for b in batches:
            rid, ids = b.column("rid").to_pylist(), b.column("doc_id").to_pylist()
            chunk, size, at = [], 0, 0
            for i, text in enumerate(b.column("text")):
                chunk.append(codes.of(words(text.as_py())))
                size += len(chunk[-1])
                if size >= CHUNK or i + 1 == len(ids):
                    rows = [(rid[at + d], ids[at + d], *x) for d, *x in stretches(chunk, masks, seeds, known, reach)]
                    cols = list(zip(*rows)) or [()] * len(STRETCH)
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], STRETCH.names)
                    chunk, size, at = [], 0, i + 1

    return run


def _enough(item: np.ndarray, doc: np.ndarray, low: int, high: int, least: float, edits: float) -> bool:
    """Whether enough of the item's words stand on these diagonals for a passage: a bound that costs far less than an
    alignment."""
    return _band(item, doc, low, high).any(1).sum() >= least * (1 - edits) * len(item)


OUT = T.StructType([T.StructField(n, T.LongType()) for n in ("rid", "doc_id", "item_id")] + [T.StructField(n, T.IntegerType()) for n in ("n_words", "n_edits", "item_words")])


def _verify(least: float, edits: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            heads = zip(*(b.column(c).to_pylist() for c in ("rid", "doc_id", "item_id", "low", "high")))
            for i, (rid, doc, item_id, low, high) in enumerate(heads):
                item, text = (b.column(c)[i].values.to_numpy().view("uint64") for c in ("item", "text"))
                if _enough(item, text, low, high, least, edits):
                    n, e = passage(item, text, low, high, int(np.ceil(least * len(item))), edits)
                    if n:
                        rows.append((rid, doc, item_id, n, e, len(item)))
            cols = list(zip(*rows)) or [()] * len(OUT)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 3 else pa.int32()) for i, c in enumerate(cols)], OUT.names)

    return run


def leaked_items(docs: DataFrame, items: DataFrame, least: float = LEAST, edits: float = EDITS, filter_words: int = FILTER_WORDS) -> DataFrame:
    """doc_id, item_id, n_words (item words in the longest passage), n_edits, item_words, share (n_words / item_words): one
    row for each document and item of which it holds a passage of at least ``least`` of its words, with at most ``edits``
    of them edited.

    Null and empty texts hold and are nothing; an item repeated under one id counts once, equal items under different
    ids each; every document row counts by itself, repeated rows too. Short items have shorter seeds, so that none
    is left out. An empty table on either side gives no rows. Other columns aren't read. Reads the items and builds their
    filter when called.
    """
    require_columns(docs, "doc_id", "text")
    require_columns(items, "item_id", "text")
    spark = docs.sparkSession
    it = items.select("item_id", "text").where("text is not null").distinct().withColumn("iid", F.monotonically_increasing_id())
    it = materialize(it.mapInArrow(_items(least, edits), ITEM), "items")
    head = it.agg(F.max("n"), F.array_sort(F.collect_set("mask"))).first()
    if head[0] is None:
        return spark.createDataFrame([], T.StructType([*OUT.fields[1:], T.StructField("share", T.DoubleType())]))
    # a passage goes no farther from a hit than the longest item with its edits
    reach = int(head[0] * (1 + edits)) + 2 * BAND
    seeds = it.select("iid", "n", "need", F.posexplode("h").alias("at", "seed"))
    shared = spark.sparkContext.broadcast((Filter(seeds.select(F.col("seed").alias("h")), filter_words), Filter(it.select(F.explode("words").alias("h")), filter_words)))
    d = docs.where("text is not null").select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    found = materialize(d.mapInArrow(_probe(shared, head[1], reach), STRETCH), "stretches")
    hits = found.select("rid", "start", F.explode(F.arrays_zip("h", "pos")).alias("s")).select("rid", "start", "s.h", F.col("s.pos").alias("pos"))
    left, right = salted_sides(hits, seeds, "h", "rid", "seed")
    x = left.join(right, (left["h"] == right["seed"]) & (left["_salt"] == right["_salt"]))
    # edits can't take a passage over more than two bands that lie side by side
    drift = (F.floor(F.col("n") * edits) + 1).cast("int")
    x = x.withColumn("drift", drift).withColumn("step", F.greatest(F.lit(BAND), drift)).withColumn("band", F.floor((F.col("pos") - F.col("at")) / F.col("step")).cast("int"))
    c = x.groupBy("rid", "start", "iid", "band", "need", "step", "drift").agg(F.count(F.lit(1)).alias("hits"))
    w = W.partitionBy("rid", "start", "iid").orderBy("band")
    after = F.when(F.lead("band").over(w) == F.col("band") + 1, F.lead("hits").over(w)).otherwise(0)
    c = c.withColumn("_both", F.col("hits") + after).where("_both >= need")
    c = c.select("rid", "start", "iid", (F.col("band") * F.col("step") - F.col("drift")).alias("low"), ((F.col("band") + 2) * F.col("step") + F.col("drift")).alias("high"))
    c = c.join(it.select("iid", "item_id", F.col("words").alias("item")), "iid").join(found.select("rid", "start", "doc_id", F.col("words").alias("text")), ["rid", "start"])
    v = c.select("rid", "doc_id", "item_id", "low", "high", "item", "text").mapInArrow(_verify(least, edits), OUT)
    best = v.groupBy("rid", "doc_id", "item_id").agg(F.max(F.struct("n_words", (-F.col("n_edits")).alias("e"), "item_words")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_words", (-F.col("b.e")).alias("n_edits"), "b.item_words", (F.col("b.n_words") / F.col("b.item_words")).alias("share"))
