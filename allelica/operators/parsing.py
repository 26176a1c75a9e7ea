"""Delimited records that fail to parse, told from valid ones by a minimum-cost error parse.

A record's cheapest repair is found by dynamic programming over its characters: quotes may be inserted or deleted, and
delimiters inserted or deleted so that the wanted number of fields comes out. Costs are ordered (quote edits, then
delimiter edits, then edits as late in the record as possible), so that a record has quote cost zero exactly if its quoting
is right, and total cost zero exactly if it is a well-formed record. Runs of ordinary characters are one symbol, so long
texts cost as little as their punctuation.

Records of cost zero, quoted or not, are recognised by a pattern and split in generated code; only those that need an edit
reach the dynamic programme.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from allelica.functions.keys import plain_chr, require_columns

START, BARE, QUOTED, CLOSED = range(4)

RESULT = T.StructType(
    [
        T.StructField("quote_edits", T.IntegerType()),
        T.StructField("delimiter_edits", T.IntegerType()),
        T.StructField("edits", T.StringType()),
        T.StructField("fields", T.ArrayType(T.StringType())),
    ]
)


@lru_cache(maxsize=64)
def _symbols(sep: str) -> re.Pattern:
    return re.compile('"|' + re.escape(sep) + f"|(?:(?!{re.escape(sep)})[^\"])+", re.DOTALL) if sep else re.compile('"|[^"]+', re.DOTALL)


def error_parse(line: str, sep: str, want: int) -> tuple[int, int, str]:
    """(quote edits, delimiter edits, edits as text) of the cheapest parse into ``want`` fields.

    ``edits`` lists operations with the character offset at which they apply, e.g. ``-quote@4;+delimiter@20``.
    """
    # state (kind, fields) -> (quote edits, delimiter edits, minus the sum of offsets, edits as linked list)
    best: dict[tuple[int, int], tuple] = {(START, 1): (0, 0, 0, None)}
    at = 0

    def put(into: dict, kind: int, n: int, q: int, d: int, late: int, ops: tuple | None) -> None:
        old = into.get((kind, n))
        if n <= want and (old is None or (q, d, late) < old[:3]):
            into[kind, n] = (q, d, late, ops)

    def with_delimiters(states: dict, ends: bool) -> dict:
        """The states and those that inserted delimiters lead to from them. They go where a field begins or ends anyway, so
        that they add empty fields but never mend quoting."""
        for n in range(1, want):
            for kind in (START, BARE, CLOSED) if ends else (START,):
                if (kind, n) in states:
                    q, d, late, ops = states[kind, n]
                    put(states, START, n + 1, q, d + 1, late - at, ("+delimiter", at, ops))
        return states

    for m in _symbols(sep).finditer(line):
        sym, nxt = m.group(), {}
        for (kind, n), (q, d, late, ops) in with_delimiters(best, sym == sep).items():
            if sym == '"':
                if kind == START:
                    put(nxt, QUOTED, n, q, d, late, ops)
                elif kind == QUOTED:
                    put(nxt, CLOSED, n, q, d, late, ops)
                    put(nxt, QUOTED, n, q + 1, d, late - at, ("+quote", at, ops))  # doubled, it is part of the text
                elif kind == CLOSED:
                    put(nxt, QUOTED, n, q, d, late, ops)
                put(nxt, kind, n, q + 1, d, late - at, ("-quote", at, ops))
            elif sym == sep:
                if kind == QUOTED:
                    put(nxt, QUOTED, n, q, d, late, ops)
                    put(nxt, START, n + 1, q + 1, d, late - at, ("+quote", at, ops))
                else:
                    put(nxt, START, n + 1, q, d, late, ops)
                    put(nxt, kind, n, q, d + 1, late - at, ("-delimiter", at, ops))
            elif kind == START:
                put(nxt, BARE, n, q, d, late, ops)
                put(nxt, QUOTED, n, q + 1, d, late - at, ("+quote", at, ops))
            elif kind in (BARE, QUOTED):
                put(nxt, kind, n, q, d, late, ops)
        best, at = nxt, m.end()
    for (kind, n), (q, d, late, ops) in list(best.items()):
        if kind == QUOTED:
            del best[kind, n]
            put(best, CLOSED, n, q + 1, d, late - at, ("+quote", at, ops))
    q, d, _, ops = min((v for (_, n), v in with_delimiters(best, True).items() if n == want), key=lambda v: v[:3])
    steps = []
    while ops is not None:
        steps.append(f"{ops[0]}@{ops[1]}")
        ops = ops[2]
    return q, d, ";".join(reversed(steps))


def _parser(want: int):
    @F.pandas_udf(RESULT)
    def parse(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for lines, seps in batches:
            rows = [(None,) * 4 if line is None else (*(e := error_parse(line, sep or "", want)), None if e[2] else _fields_of(line, sep or "")) for line, sep in zip(lines, seps)]
            yield pd.DataFrame(rows, columns=RESULT.names)

    return parse


#: A field of a record whose separator has been put as U+0001. Possessive, so that no text makes the matcher go back.
_FIELD = '(?:"[^"]*+(?:""[^"]*+)*+"|[^"\\x01]*+)'


def parse_records(df: DataFrame, line: str, sep: str, want: int) -> DataFrame:
    """Adds ``_reason`` (null, ``quoting`` or ``columns``), ``_edits`` (the repair that the cheapest parse makes) and
    ``_fields`` (array of text; null for a failing record).

    One carriage return at the end is dropped. A null record has no fields (``columns``, without edits), an empty one has
    one; with a null or empty separator all text is one field.
    """
    text = F.regexp_replace(F.col(line), "\r\\z", "")
    d = df.withColumn("_text", text).withColumn("_sep", F.coalesce(F.col(sep), F.lit("")))
    # a record that holds U+0001 itself can't be split this way and takes the long one
    marked = F.when(~F.contains("_text", F.lit("\x01")) | (F.col("_sep") == "\x01"), F.when(F.col("_sep") == "", F.col("_text")).otherwise(F.replace("_text", F.col("_sep"), F.lit("\x01"))))
    d = d.withColumn("_m", marked)
    d = d.withColumn("_ok", F.coalesce(F.col("_m").rlike(f"\\A{_FIELD}(?:\\x01{_FIELD}){{{want - 1}}}\\z"), F.lit(False)))
    # each record goes one way: those of cost zero stay in the JVM
    parts = F.regexp_extract_all(F.concat(F.lit("\x01"), "_m"), F.lit(f"\\x01({_FIELD})"), F.lit(1))
    bare = lambda x: F.when(F.startswith(x, F.lit('"')), F.replace(F.substr(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x)
    inside = lambda x: F.replace(bare(x), F.lit("\x01"), F.col("_sep"))
    good = d.where("_ok").select(*df.columns, F.lit(None).cast("string").alias("_reason"), F.lit("").alias("_edits"), F.transform(parts, inside).alias("_fields"))
    bad = d.where("not _ok").withColumn("_p", _parser(want)("_text", "_sep"))
    reason = F.when(F.col("_text").isNull(), "columns").when(F.col("_p.quote_edits") > 0, "quoting").when(F.col("_p.delimiter_edits") > 0, "columns")
    # a record with U+0001 may turn out to be right and has its fields
    bad = bad.select(*df.columns, reason.alias("_reason"), F.col("_p.edits").alias("_edits"), F.col("_p.fields").alias("_fields"))
    return good.unionByName(bad)


def _fields_of(line: str, sep: str) -> list[str]:
    """Fields of a well-formed record."""
    fields, text, quoted, closed = [], [], False, False
    for m in _symbols(sep).finditer(line):
        sym = m.group()
        if sym == '"':
            if quoted and closed:
                text.append('"')
                closed = False
            elif quoted:
                closed = True
            else:
                quoted = True
        elif sym == sep and (not quoted or closed):
            fields.append("".join(text))
            text, quoted, closed = [], False, False
        else:
            text.append(sym)
    return [*fields, "".join(text)]


def parse_variants(raw: DataFrame, chrom_list: DataFrame) -> DataFrame:
    """Records of SNP, CHR, POS, REF, ALT: typed where valid, otherwise with the reason of failure.

    Returns line_id, reason (null if valid; the first that applies of quoting, columns, value), edits, and for valid
    rows snp, chr (plain), pos, ref_allele, alt_allele. ``value``: SNP holds white space or a control character, the
    plain chromosome is unknown, or POS isn't digits with a value on it. Repeated lines are separate rows.
    """
    require_columns(raw, "line_id", "sep", "line")
    d = parse_records(raw.select("line_id", "sep", "line"), "line", "sep", 5)
    f = [F.trim(F.get("_fields", F.lit(i))) for i in range(5)]
    d = d.select("line_id", "_reason", "_edits", f[0].alias("_snp"), plain_chr(f[1]).alias("_chr"), f[2].alias("_pos"), f[3].alias("_ref"), f[4].alias("_alt"))
    known = chrom_list.where(F.col("chr").isNotNull()).groupBy(F.col("chr").alias("_known")).agg(F.max("length_bp").alias("_length"))
    d = d.join(known, d["_chr"] == known["_known"], "left")
    pos = F.expr("try_cast(_pos as decimal(38, 0))")
    digits = F.col("_pos").rlike("^0*[0-9]{1,30}$")
    good = ~F.col("_snp").rlike("(?U)[\\s\\p{Cc}]") & F.col("_known").isNotNull() & F.when(digits, pos.between(1, F.col("_length"))).otherwise(False)
    reason = F.coalesce("_reason", F.when(~F.coalesce(good, F.lit(False)), F.lit("value")))
    d = d.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    return d.select(
        "line_id", "reason", F.when(ok, F.lit(None)).otherwise(F.col("_edits")).alias("edits"),
        F.when(ok, F.col("_snp")).alias("snp"), F.when(ok, F.col("_chr")).alias("chr"), F.when(ok, F.expr("try_cast(_pos as int)")).alias("pos"),
        F.when(ok, F.col("_ref")).alias("ref_allele"), F.when(ok, F.col("_alt")).alias("alt_allele"),
    )
