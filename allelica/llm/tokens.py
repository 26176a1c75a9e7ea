"""Encoding of a whole corpus with a public byte-level BPE vocabulary, by a table of distinct words.

The corpus is split into words (pre-tokens) in generated code. Every distinct word is encoded once. The ids come back by
position: the commonest words (at most ``hot_words``, a fixed bound, whatever the corpus) are looked up in a broadcast
table by vectorised hash lookup, the rest of the words is joined by word in Spark and put into its places. Word
frequencies fall steeply, so the join carries a few per cent of the positions, and no word can skew it: a word frequent
enough to do so is in the broadcast table. Only documents with such words are joined, each by a key of its own row, so that
empty texts and copies of one text meet in no task.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from allelica.functions.keys import materialize, require_columns

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split of the vocabulary's publisher, for the Rust engine and for Java's.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPLIT_JAVA = SPLIT.replace(r"[^\s", r"[^\p{IsWhite_Space}").replace(r"\S", r"\P{IsWhite_Space}").replace(r"\s", r"\p{IsWhite_Space}")
HOT_WORDS = 1 << 18


@lru_cache(maxsize=4)
def encoder(path: str = VOCABULARY):
    """Encoder without special tokens, once per process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("corpus", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def _ragged(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[starts[i] : starts[i] + sizes[i]] one after another."""
    ends = np.cumsum(sizes)
    if not len(sizes) or ends[-1] == 0:
        return values[:0]
    return values[np.arange(ends[-1]) - np.repeat(ends - sizes - starts, sizes)]


def _lists(sizes: np.ndarray, values: np.ndarray) -> pa.ListArray:
    offsets = np.zeros(len(sizes) + 1, "int32")
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype("int32", copy=False)))


def _encode_words(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            ids = [enc.encode_ordinary(w) for w in b.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), pa.array(ids, pa.list_(pa.int32()))], ["word", "n", "ids"])

    return run


def word_table(docs: DataFrame, text: str, path: str = VOCABULARY) -> DataFrame:
    """Distinct words of the corpus: word, n (occurrences), ids. Written to the shared folder."""
    words = docs.select(F.explode(_words(text)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return materialize(words.mapInArrow(_encode_words(path), "word string, n long, ids array<int>"), "words")


def _words(text: str):
    # where Java doesn't know a character yet, the two engines might split differently: such texts are encoded whole
    return F.when(~F.col(text).rlike(r"\p{Cn}"), F.regexp_extract_all(text, F.lit(SPLIT_JAVA), F.lit(0)))


def _hot(table: DataFrame, most: int) -> tuple[pa.Table, int]:
    """The commonest words, at most ``most``, and the count from which a word is among them."""
    steps = table.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n"))
    # few distinct counts are large; the cut is found on a histogram in powers of two, then exactly within one step
    hist = dict(table.groupBy(F.floor(F.log2("n")).alias("b")).agg(F.count(F.lit(1)).alias("c")).collect())
    total, low = 0, 63
    while low >= 0 and total + hist.get(low, 0) <= most:
        total += hist.get(low, 0)
        low -= 1
    least = 1 << (low + 1)
    if low >= 0 and hist.get(low, 0) and low < 16:
        for r in steps.where(F.col("n") < least).limit(1 << 15).toLocalIterator():
            if total + r["words"] > most:
                break
            total, least = total + r["words"], r["n"]
    return table.where(F.col("n") >= least).select("word", "ids").toArrow(), least


OUT = T.StructType(
    [
        T.StructField("rid", T.LongType()), T.StructField("doc_id", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("rare", T.ArrayType(T.StringType())),
    ]
)


def _place_hot(shared, path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, flat, starts, sizes = shared.value
        for b in batches:
            col = b.column("words")
            lens = np.asarray(pc.fill_null(pc.list_value_length(col), 0), dtype="int64")
            tokens = pc.list_flatten(col)
            at = pc.index_in(tokens, value_set=words).to_numpy(zero_copy_only=False)
            known = ~np.isnan(at) if at.dtype.kind == "f" else at >= 0
            at = np.where(known, at, 0).astype("int64")
            size = np.where(known, sizes[at], 1) if len(sizes) else np.ones(len(at), "int64")
            ends = np.concatenate([[0], np.cumsum(size)])
            ids = np.full(ends[-1], -1, "int32")
            if known.any():
                inner = np.repeat(known, size)
                ids[inner] = _ragged(flat, starts[at[known]], sizes[at[known]])
            rows = np.concatenate([[0], np.cumsum(lens)])
            per_doc = ends[rows[1:]] - ends[rows[:-1]]
            lost = np.flatnonzero(~known)
            doc = np.searchsorted(rows, lost, side="right") - 1
            places = (ends[lost] - ends[rows[doc]]).astype("int32")
            n_lost = np.bincount(doc, minlength=len(lens)) if len(lens) else np.zeros(0, "int64")
            rare = tokens.take(pa.array(lost))
            out, off = _lists(per_doc, ids), pa.array(np.concatenate([[0], np.cumsum(n_lost)]).astype("int32"))
            whole = b.column("whole")
            if whole.null_count < len(whole):
                enc, some = encoder(path), out.to_pylist()
                for i, t in enumerate(whole.to_pylist()):
                    if t is not None:
                        some[i] = enc.encode_ordinary(t)
                out = pa.array(some, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("doc_id"), out, _lists(n_lost, places), pa.ListArray.from_arrays(off, rare)], OUT.names)

    return run


def _put_rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column("ids")
        flat, lens = np.asarray(pc.list_flatten(ids)), np.asarray(pc.list_value_length(ids), dtype="int64")
        starts = np.concatenate([[0], np.cumsum(lens)])
        out = []
        for i, fill in enumerate(b.column("fill").to_pylist()):
            mine = flat[starts[i] : starts[i + 1]]
            if fill:
                parts, last = [], 0
                for f in sorted(fill, key=lambda f: f["place"]):
                    parts += [mine[last : f["place"]], np.asarray(f["ids"], "int32")]
                    last = f["place"] + 1
                mine = np.concatenate([*parts, mine[last:]])
            out.append(mine)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), _lists(np.array([len(x) for x in out], "int64"), np.concatenate(out) if out else np.zeros(0, "int32"))], ["doc_id", "ids"])


def encode_corpus(docs: DataFrame, path: str = VOCABULARY, hot_words: int = HOT_WORDS) -> DataFrame:
    """doc_id and ids (array of int, never null) of each document; special tokens' strings are ordinary text.

    An empty or null text has an empty list; blanks are text. Repeated rows and repeated ids stay as they
    are, a null doc_id stays null. Columns other than doc_id and text aren't read. Texts of any length are encoded whole.
    """
    require_columns(docs, "doc_id", "text")
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    table = word_table(d, "text", path)
    hot, least = _hot(table, hot_words)
    ids = hot.column("ids").combine_chunks()
    sizes = np.asarray(pc.list_value_length(ids), dtype="int64")
    words = hot.column("word").combine_chunks().cast(pa.string())
    shared = d.sparkSession.sparkContext.broadcast((words, np.asarray(pc.list_flatten(ids), dtype="int32"), np.cumsum(sizes) - sizes, sizes))
    w = _words("text")
    placed = d.select(F.monotonically_increasing_id().alias("rid"), "doc_id", w.alias("words"), F.when(w.isNull(), F.col("text")).alias("whole"))
    placed = placed.mapInArrow(_place_hot(shared, path), OUT)
    rare = table.where(F.col("n") < least).select("word", F.col("ids").alias("rare_ids"))
    if rare.isEmpty():
        return placed.select("doc_id", "ids")
    placed = materialize(placed, "placed")
    some = placed.where(F.size("rare") > 0)
    lost = some.select("rid", F.explode(F.arrays_zip("places", "rare")).alias("x")).select("rid", F.col("x.places").alias("place"), F.col("x.rare").alias("word"))
    found = lost.join(rare, "word").groupBy("rid").agg(F.collect_list(F.struct("place", F.col("rare_ids").alias("ids"))).alias("fill"))
    filled = some.select("rid", "doc_id", "ids").join(found, "rid").select("doc_id", "ids", "fill").mapInArrow(_put_rare, "doc_id long, ids array<int>")
    return placed.where(F.size("rare") == 0).select("doc_id", "ids").unionByName(filled)


def decode_corpus(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id and text of each row, by a join of ids with the vocabulary's pieces (a table of fixed size). Rows of one doc_id
    or without one stay apart; an empty list gives an empty text."""
    spark = encoded.sparkSession
    enc = encoder(path)
    pieces = spark.createDataFrame([(i, bytearray(enc.decode_single_token_bytes(i))) for i in range(enc.n_vocab)], "id int, piece binary")
    rows = encoded.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "ids").select("rid", "doc_id", F.posexplode_outer("ids").alias("at", "id"))
    packed = rows.join(F.broadcast(pieces), "id", "left").groupBy("rid", "doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("p"))
    hexed = F.concat_ws("", F.transform("p", lambda x: F.hex(x["piece"])))
    return packed.select("doc_id", F.decode(F.unhex(hexed), "UTF-8").alias("text"))
