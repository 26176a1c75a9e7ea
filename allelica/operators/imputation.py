"""Filling missing values from similar records by a Chow-Liu dependency tree.

Fields are discretised (numeric ones into quantile bins, categorical ones into their commonest values and a rest), the
tree of largest total mutual information is built from pairwise counts over all rows, and belief propagation on it gives
the posterior of every missing field from whatever fields a row has. Posteriors are decoded to the commonest category or
to the bin's median.

Only counts leave the executors: at most ``(bins + 1)^2`` cells per pair of fields. Filling is row by row (Arrow
batches), so it needs no shuffle at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from allelica.functions.keys import materialize, plain_chr, require_columns

SMOOTH = 0.5


@dataclass
class Tree:
    """sizes: states per field; parent: of each field (-1: root); order: root first; prior of the root; cond[f][parent state, state]."""

    fields: list[str]
    sizes: list[int]
    parent: list[int]
    order: list[int]
    prior: np.ndarray
    cond: dict[int, np.ndarray]

    def posteriors(self, codes: np.ndarray, want: list[int]) -> dict[int, np.ndarray]:
        """codes: rows x fields, -1 where missing. Belief of the wanted fields by one upward and one downward pass."""
        n = len(codes)
        local = []
        for f, k in enumerate(self.sizes):
            e = np.zeros((n, k))
            known = codes[:, f] >= 0
            e[known, codes[known, f]] = 1.0
            e[~known] = 1.0
            local.append(e)
        up, sent = [e.copy() for e in local], {}
        for f in reversed(self.order):
            if self.parent[f] >= 0:
                m = up[f] @ self.cond[f].T
                sent[f] = m / m.sum(1, keepdims=True)
                up[self.parent[f]] = up[self.parent[f]] * sent[f]
        belief = {}
        for f in self.order:
            p = self.parent[f]
            b = up[f] * self.prior if p < 0 else up[f] * ((belief[p] / np.maximum(sent[f], 1e-300)) @ self.cond[f])
            belief[f] = b / np.maximum(b.sum(1, keepdims=True), 1e-300)
        return {f: belief[f] for f in want}


def fit_tree(coded: DataFrame, fields: list[str], sizes: list[int], weight: str | None = None) -> Tree:
    """Chow-Liu tree of coded fields (int, null where missing) from the pairwise counts of all rows."""
    w = F.sum(weight) if weight else F.count(F.lit(1))
    pairs = [(i, j) for i in range(len(fields)) for j in range(i + 1, len(fields))]
    if not pairs:
        alone = np.full(sizes[0], SMOOTH)
        for r in coded.where(F.col(fields[0]).isNotNull()).groupBy(fields[0]).agg(w.alias("n")).collect():
            alone[r[0]] += float(r["n"])
        return Tree(fields, sizes, [-1], [0], alone / alone.sum(), {})
    cells = F.array(*[F.struct(F.lit(k).alias("k"), F.col(fields[i]).cast("int").alias("a"), F.col(fields[j]).cast("int").alias("b")) for k, (i, j) in enumerate(pairs)])
    # equal rows are counted once before the pairs are spread
    seen = coded.groupBy(*fields).agg(w.alias("_w"))
    counts = seen.select(F.explode(cells).alias("c"), "_w").where("c.a is not null and c.b is not null").groupBy("c").agg(F.sum("_w").alias("n")).collect()
    joint = [np.full((sizes[i], sizes[j]), SMOOTH) for i, j in pairs]
    for r in counts:
        joint[r["c"]["k"]][r["c"]["a"], r["c"]["b"]] += float(r["n"])
    gain = {}
    for (i, j), t in zip(pairs, joint):
        p = t / t.sum()
        # information times the rows that have both fields: a field seldom present can't stand between two common ones
        support = max(0.0, t.sum() - SMOOTH * t.size)
        gain[i, j] = support * float((p * np.log(p / (p.sum(1, keepdims=True) * p.sum(0, keepdims=True)))).sum())
    parent, order = [-1] * len(fields), [0]
    while len(order) < len(fields):
        f, g = max(((f, g) for f in order for g in range(len(fields)) if g not in order), key=lambda e: (gain[min(e), max(e)], -e[1]))
        parent[g] = f
        order.append(g)
    cond, prior = {}, np.ones(sizes[0]) / sizes[0]
    for g in order[1:]:
        f = parent[g]
        t = joint[pairs.index((min(f, g), max(f, g)))]
        t = t if f < g else t.T
        cond[g] = t / t.sum(1, keepdims=True)
    if len(order) > 1:
        best = max((joint[pairs.index((0, g))] for g in order[1:]), key=lambda t: t.sum() - SMOOTH * t.size)
        prior = best.sum(1) / best.sum()
    return Tree(fields, sizes, parent, order, prior, cond)


def fill_codes(coded: DataFrame, tree: Tree, target: str, keep: list[str]) -> DataFrame:
    """``keep`` and the likeliest state of ``target`` with its probability (``<target>_fill``, ``<target>_prob``) for each row."""
    at = tree.fields.index(target)
    schema = T.StructType([coded.schema[c] for c in keep] + [T.StructField(f"{target}_fill", T.IntegerType()), T.StructField(f"{target}_prob", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            codes = pdf[tree.fields].astype("float64").fillna(-1).to_numpy().astype(int)
            post = tree.posteriors(codes, [at])[at]
            out = pdf[keep].copy()
            out[f"{target}_fill"] = post.argmax(1).astype("int32")
            out[f"{target}_prob"] = post.max(1)
            yield out

    return coded.select(*dict.fromkeys([*keep, *tree.fields])).mapInPandas(run, schema)


def fill_missing(df: DataFrame, categorical: list[str], numeric: list[str], bins: int = 16) -> DataFrame:
    """Fill nulls (and NaN) of the named fields; adds ``<field>_filled`` (boolean) for each.

    Numeric fields are cut at quantiles into at most ``bins`` bins and filled by the median of the likeliest bin;
    categorical ones keep their ``bins`` commonest values (ties: smallest first), rarer ones form a state that is
    evidence but never filled in. A field without any value stays null, unmarked. All other columns pass unchanged.
    """
    require_columns(df, *categorical, *numeric)
    fields = [*categorical, *numeric]
    clean = df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in numeric and dict(df.dtypes)[c] in ("double", "float") else F.col(c) for c in df.columns])
    states: dict[str, list] = {}
    cuts: dict[str, list[float]] = {}
    for c in categorical:
        top = clean.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(bins)
        states[c] = [r[0] for r in top.collect()]
    if numeric:
        row = clean.agg(*[F.percentile_approx(F.col(c).cast("double"), [i / bins for i in range(1, bins)]).alias(c) for c in numeric]).first()
        cuts = {c: sorted(set(row[c] or [])) for c in numeric}

    def code(c: str) -> Column:
        v = F.col(c)
        if c in categorical:
            e = F.when(v.isNull(), F.lit(None).cast("int"))
            for i, s in enumerate(states[c]):
                e = e.when(v == F.lit(s), F.lit(i))
            return e.otherwise(F.lit(len(states[c])))
        e = F.when(v.isNull(), F.lit(None).cast("int"))
        for i, x in enumerate(cuts[c]):
            e = e.when(v <= F.lit(x), F.lit(i))
        return e.otherwise(F.lit(len(cuts[c])))

    codes = [f"_c{i}" for i in range(len(fields))]
    coded = clean.select("*", *[code(c).alias(a) for c, a in zip(fields, codes)])
    sizes = [len(states[c]) + 1 if c in categorical else len(cuts[c]) + 1 for c in fields]
    tree = fit_tree(coded.select(*codes), codes, sizes)
    medians: dict[str, dict[int, float]] = {c: {} for c in numeric}
    for i, c in enumerate(fields):
        if c in numeric:
            rows = coded.where(F.col(c).isNotNull()).groupBy(codes[i]).agg(F.percentile_approx(F.col(c).cast("double"), 0.5, F.lit(10000)).alias("m")).collect()
            medians[c] = {r[0]: r["m"] for r in rows}
    kinds = dict(df.dtypes)
    out_schema = T.StructType([*df.schema.fields, *[T.StructField(f"{c}_filled", T.BooleanType()) for c in fields]])
    out_schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in out_schema])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            m = pdf[codes].astype("float64").fillna(-1).to_numpy().astype(int)
            post = tree.posteriors(m, list(range(len(fields))))
            out = pdf.drop(columns=codes)
            for i, c in enumerate(fields):
                choices: dict | list = states[c] if c in categorical else [medians[c].get(k) for k in range(sizes[i])]
                p = post[i][:, : len(choices)].copy()
                p[:, [k for k, s in enumerate(choices) if s is None]] = -1
                gone = (m[:, i] < 0) & (len([s for s in choices if s is not None]) > 0)
                if gone.any():
                    best = p[gone].argmax(1)
                    vals = [choices[k] for k in best]
                    if kinds[c] in ("int", "bigint", "smallint", "tinyint"):
                        vals = [round(v) for v in vals] if c in numeric else vals
                    col = out[c].astype(object)
                    col[gone] = pd.Series(vals, index=out.index[gone], dtype=object)
                    out[c] = col
                out[f"{c}_filled"] = gone
            for c in fields:
                out[c] = [None if v is None or v is pd.NA or v != v else v for v in out[c].astype(object)]
            yield out

    return coded.mapInPandas(run, out_schema)


def call_dosage(gt: Column) -> Column:
    """Non-zero alleles (0..2) of a genotype string, null unless the part up to ``:`` is two allele numbers parted by / or |."""
    g = F.trim(F.substring_index(gt, ":", 1))
    ok = g.rlike("^[0-9]+[/|][0-9]+$")
    a = F.regexp_extract(g, "^([0-9]+)[/|]", 1).rlike("[1-9]").cast("int")
    b = F.regexp_extract(g, "[/|]([0-9]+)$", 1).rlike("[1-9]").cast("int")
    return F.when(ok, a + b)


def _mode_code(n: list[Column], levels: tuple[float, ...]) -> Column:
    """3 x (certainty level) + commonest dosage; null without calls. Ties go to the smaller dosage."""
    total = n[0] + n[1] + n[2]
    top = F.greatest(*n)
    mode = F.when(n[0] == top, 0).when(n[1] == top, 1).otherwise(2)
    level = F.lit(0)
    for x in levels:
        level = level + (top >= total * x).cast("int")
    level = level * 2 + F.when(total >= 3, 1).otherwise(0)
    return F.when(total > 0, level * 3 + mode).cast("int")


#: States of the coded fields of fill_genotypes.
GENOTYPE_FIELDS = {"dosage": 3, "same_sample": 18, "same_group": 18, "elsewhere": 33, "depth_bin": 5}


def genotype_evidence(calls: DataFrame, samples: DataFrame, groups_max: int = 500_000) -> DataFrame:
    """Coded evidence: one row (``call_id`` set, ``dosage`` null) for every call without genotype, and one row
    (``call_id`` null, ``weight``) for every combination of codes among the calls that have one.

    Evidence of a call never includes itself: other calls of its sample at the variant, calls of other samples of its
    line group, calls of all other groups, and the call's depth. One shuffle moves the calls; group and variant counts
    are pre-aggregated before theirs, and the result has a few thousand rows besides the missing calls.
    """
    require_columns(calls, "call_id", "sample_id", "chr", "pos", "gt", "depth")
    require_columns(samples, "sample_id", "line_grp")
    # a sample's group may be on another of its rows; without any it is a group of its own
    groups = samples.where(F.col("sample_id").isNotNull() & F.col("line_grp").isNotNull()).groupBy("sample_id").agg(F.max("line_grp").alias("grp"))
    if groups.count() <= groups_max:
        groups = F.broadcast(groups)
    depth = F.when(F.col("depth").isNotNull(), F.least(F.greatest(F.floor(F.col("depth") / 8), F.lit(0)), F.lit(4)).cast("int"))
    base = calls.select("call_id", "sample_id", plain_chr("chr").alias("c"), "pos", call_dosage(F.col("gt")).alias("d"), depth.alias("depth_bin"))
    base = base.join(groups, "sample_id", "left").withColumn("grp", F.coalesce("grp", F.concat(F.lit("sample "), F.col("sample_id"))))
    base = base.withColumn("call_id", F.when(F.col("d").isNull(), F.col("call_id")))
    by_grp = base.groupBy("c", "pos", "grp").agg(*[F.count_if(F.col("d") == i).alias(f"g{i}") for i in range(3)])
    by_var = by_grp.groupBy(F.col("c").alias("vc"), F.col("pos").alias("vpos")).agg(*[F.sum(f"g{i}").alias(f"v{i}") for i in range(3)])
    both = by_grp.join(by_var, F.expr("c <=> vc and pos <=> vpos")).select(F.col("c").alias("gc"), F.col("pos").alias("gpos"), F.col("grp").alias("ggrp"), *[f"{x}{i}" for x in "gv" for i in range(3)])
    d = base.join(both, F.expr("c <=> gc and pos <=> gpos and grp <=> ggrp"), "left")
    w = W.partitionBy("c", "pos", "grp", "sample_id")
    d = d.select("*", *[F.sum((F.col("d") == i).cast("long")).over(w).alias(f"s{i}") for i in range(3)])
    # without any genotype a window's sum is null
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    own = [F.coalesce((F.col("d") == i).cast("long"), F.lit(0)) for i in range(3)]
    same_sample = _mode_code([z(f"s{i}") - own[i] for i in range(3)], (0.75, 0.95))
    same_group = _mode_code([z(f"g{i}") - z(f"s{i}") for i in range(3)], (0.75, 0.95))
    rest = [z(f"v{i}") - z(f"g{i}") for i in range(3)]
    total = rest[0] + rest[1] + rest[2]
    # allele frequency in ten steps, and which dosage is commonest
    freq = F.floor((rest[1] + 2 * rest[2]) / (2 * F.greatest(total, F.lit(1))) * 10)
    elsewhere = F.when(total > 0, freq * 3 + F.when((rest[0] >= rest[1]) & (rest[0] >= rest[2]), 0).when(rest[1] >= rest[2], 1).otherwise(2)).cast("int")
    coded = d.select("call_id", F.col("d").alias("dosage"), same_sample.alias("same_sample"), same_group.alias("same_group"), elsewhere.alias("elsewhere"), "depth_bin")
    return coded.groupBy(*coded.columns).agg(F.count(F.lit(1)).alias("weight"))


def fill_genotypes(calls: DataFrame, samples: DataFrame) -> DataFrame:
    """Filled dosage (0, 1, 2) of every call without genotype: call_id, dosage, prob.

    Nulls in any column are allowed: a call without sample, group, place or depth is filled from what it has, at worst
    from the overall frequencies. Repeated and replicate calls are evidence for one another. Calls with a null call_id
    are kept as one row. An empty table, or one without missing calls, gives no rows.
    """
    names = list(GENOTYPE_FIELDS)
    calls = calls.withColumn("call_id", F.coalesce("call_id", F.lit(-(1 << 63))))
    coded = materialize(genotype_evidence(calls, samples), "genotype-evidence")
    tree = fit_tree(coded.where("call_id is null"), names, list(GENOTYPE_FIELDS.values()), "weight")
    out = fill_codes(coded.where("call_id is not null"), tree, "dosage", ["call_id"])
    return out.select(F.when(F.col("call_id") != -(1 << 63), F.col("call_id")).alias("call_id"), F.col("dosage_fill").alias("dosage"), F.col("dosage_prob").alias("prob"))


def all_dosages(calls: DataFrame, samples: DataFrame) -> DataFrame:
    """Every call with its allele count, the filled ones marked: call_id, dosage, filled."""
    have = calls.select("call_id", call_dosage(F.col("gt")).alias("dosage")).where("dosage is not null").withColumn("filled", F.lit(False))
    return have.unionByName(fill_genotypes(calls, samples).select("call_id", "dosage", F.lit(True).alias("filled")))
