"""Exploration operators (survey section 2.14)."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrix.operators.aggregates import attach_rows, category_dispersion, category_target_connection, with_scalar
from attrix.operators.evaluate import density_points
from attrix.operators.kernels import qcut
from attrix.operators.neighbours import neighbour_information
from attrix.session import materialize, ship_code

HIGH_CORRELATION = 0.98
MIN_SUPPORT = 0.1
MIN_LIFT = 2.0
MAX_DUMMY_LEVELS = 10_000


def dummy_levels(df: DataFrame, categorical: Sequence[str]) -> dict[str, tuple[list[str], bool]]:
    """Observed levels of each categorical column and whether it has nulls.

    The level lists define the columns of a wide dummy frame, so they are
    collected (one pass, one row per distinct level)."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in categorical]).unpivot(
        [], list(categorical), "category", "level"
    )
    # a wide dummy frame needs one column per level, so the level count is bounded by design
    rows = long.groupBy("category", "level").agg(F.count(F.lit(1)).alias("n")).limit(MAX_DUMMY_LEVELS + 1).collect()
    if len(rows) > MAX_DUMMY_LEVELS:
        raise ValueError(f"more than {MAX_DUMMY_LEVELS} dummy levels: combine sparse levels first (ENC-1)")
    out: dict[str, tuple[list[str], bool]] = {c: ([], False) for c in categorical}
    for r in rows:
        levels, has_null = out[r["category"]]
        if r["level"] is None:
            out[r["category"]] = (levels, True)
        else:
            levels.append(r["level"])
    return {c: (sorted(v[0]), v[1]) for c, v in out.items()}


def dummies(df: DataFrame, categorical: Sequence[str], keep: Sequence[str] = (), levels=None) -> DataFrame:
    """ENC-3 wide form: 0/1 column '<col>_<level>' per level and '<col>_nan'
    for columns that have nulls; ``keep`` columns pass through."""
    levels = levels or dummy_levels(df, categorical)
    cols = []
    for c in categorical:
        lv, has_null = levels[c]
        cols += [F.when(F.col(c) == v, 1).otherwise(0).alias(f"{c}_{v}") for v in lv]
        if has_null:
            cols.append(F.when(F.col(c).isNull(), 1).otherwise(0).alias(f"{c}_nan"))
    return df.select(*keep, *cols)


def dummies_long(df: DataFrame, key: str, categorical: Sequence[str]) -> DataFrame:
    """ENC-3 long form: (key, feature='<col>_<level>' or '<col>_nan', value=1)
    for the indicators that are 1 — no level list needed."""
    long = df.select(key, *[F.col(c).cast("string").alias(c) for c in categorical]).unpivot(
        [key], list(categorical), "category", "level"
    )
    return long.select(
        key,
        F.concat_ws("_", "category", F.coalesce("level", F.lit("nan"))).alias("feature"),
        F.lit(1).alias("value"),
    )


def _pairwise_moments(cols: Sequence[str]):
    """mapInPandas body: per partition, pairwise-complete sufficient statistics
    of every column pair (i < j) by dense matrix products.  Columns arrive
    centred on their global means, so the one-pass sums stay well conditioned."""
    import numpy as np
    import pandas as pd

    k = len(cols)
    iu = np.triu_indices(k, 1)

    def run(batches):
        n = s1 = s2 = p = None
        for pdf in batches:
            x = pdf[list(cols)].to_numpy(dtype="float64")
            m = (~np.isnan(x)).astype("float64")
            x0 = np.where(m > 0, x, 0.0)
            if n is None:
                n = np.zeros((k, k)); s1 = np.zeros((k, k)); s2 = np.zeros((k, k)); p = np.zeros((k, k))
            n += m.T @ m
            s1 += x0.T @ m
            s2 += (x0 * x0).T @ m
            p += x0.T @ x0
        if n is None:
            return
        i, j = iu
        yield pd.DataFrame(
            {
                "i": i.astype("int32"),
                "j": j.astype("int32"),
                "n": n[i, j],
                "sx": s1[i, j],
                "sy": s1[j, i],
                "sxx": s2[i, j],
                "syy": s2[j, i],
                "sxy": p[i, j],
            }
        )

    return run


def correlated_features(
    df: DataFrame,
    categorical: Sequence[str],
    numeric: Sequence[str],
    cutoff: float = HIGH_CORRELATION,
) -> DataFrame:
    """EXP-2: |Pearson r| for every unordered pair of dummy-coded and numeric
    columns over pairwise-complete rows (as pandas), flagged when >= cutoff.
    Each pair appears once with feature1 < feature2.

    A row has one level a column, so the moments of two dummies are how often
    their levels meet (C * C / 2 pairs a row for C columns, added up before the
    shuffle) and those of a dummy and a number are the number's sums by level.
    Only the numbers among themselves need dense products (numpy, by
    partition).  The result has a row a pair, so its size is levels squared;
    the work on rows doesn't grow with the levels."""
    parts = []
    levels = _level_names(df, categorical) if categorical else None
    if categorical:
        parts.append(_level_pairs(df, categorical, levels))
    if numeric:
        means = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in numeric]).first()
        centred = [(F.col(c).cast("double") - F.lit(means[c] or 0.0)).alias(c) for c in numeric]
        if categorical:
            parts.append(_level_number_pairs(df, categorical, numeric, centred))
        if len(numeric) > 1:
            parts.append(_number_pairs(df.select(*centred), sorted(numeric)))
    out = reduce(DataFrame.unionByName, parts)
    in_order = F.col("f") < F.col("g")
    out = out.select(F.when(in_order, F.col("f")).otherwise(F.col("g")).alias("feature1"), F.when(in_order, F.col("g")).otherwise(F.col("f")).alias("feature2"), F.abs("r").alias("correlation"))
    return out.withColumn("high_correlation", F.when(F.col("correlation") >= cutoff, "yes").otherwise("no"))


def _dummy_name(c: str) -> Column:
    return F.concat_ws("_", F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit("nan")))


def _level_names(df: DataFrame, categorical: Sequence[str]) -> DataFrame:
    """(f, n): rows of each level, at most MAX_DUMMY_LEVELS of them."""
    long = df.select(F.explode(F.array(*[_dummy_name(c) for c in categorical])).alias("f"))
    levels = materialize(long.groupBy("f").agg(F.count(F.lit(1)).cast("double").alias("n")), "dummy-levels")
    if levels.limit(MAX_DUMMY_LEVELS + 1).count() > MAX_DUMMY_LEVELS:
        raise ValueError(f"more than {MAX_DUMMY_LEVELS} dummy levels: combine sparse levels first (ENC-1)")
    return levels


def _pearson(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    return F.try_divide(n * sxy - sx * sy, F.sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)))


def _level_pairs(df: DataFrame, categorical: Sequence[str], levels: DataFrame) -> DataFrame:
    names = [_dummy_name(c) for c in categorical]
    met = [F.struct(F.least(a, b).alias("f"), F.greatest(a, b).alias("g")) for i, a in enumerate(names) for b in names[i + 1 :]]
    total = levels.sparkSession.range(1).select(F.lit(float(df.count())).alias("_t"))
    # the levels, of a checked number, as one constant
    others = json.dumps([{"g": r["f"], "m": r["n"]} for r in levels.collect()])
    pairs = levels.select("f", "n", F.explode(F.from_json(F.lit(others), "array<struct<g: string, m: double>>")).alias("_o")).select("f", "n", "_o.*").where("f < g")
    if met:
        both = df.select(F.explode(F.array(*met)).alias("_p")).groupBy(F.col("_p.f").alias("_f"), F.col("_p.g").alias("_g")).agg(F.count(F.lit(1)).cast("double").alias("both"))
        pairs = pairs.join(both, (F.col("f") == F.col("_f")) & (F.col("g") == F.col("_g")), "left")
    else:
        pairs = pairs.withColumn("both", F.lit(None).cast("double"))
    n, m = F.col("n"), F.col("m")
    return with_scalar(pairs, total).select("f", "g", _pearson(F.col("_t"), n, m, n, m, F.coalesce("both", F.lit(0.0))).alias("r"))


def _level_number_pairs(df: DataFrame, categorical: Sequence[str], numeric: Sequence[str], centred: Sequence[Column]) -> DataFrame:
    rows = df.select(F.array(*[_dummy_name(c) for c in categorical]).alias("_names"), *centred)
    whole = rows.agg(*[e for c in numeric for e in (F.count(c).cast("double").alias(f"n_{c}"), F.sum(c).alias(f"s_{c}"), F.sum(F.col(c) * F.col(c)).alias(f"q_{c}"))]).first()
    by = rows.select(F.explode("_names").alias("f"), *numeric).groupBy("f").agg(
        *[e for c in numeric for e in (F.count(c).cast("double").alias(f"n_{c}"), F.sum(c).alias(f"s_{c}"))]
    )

    def r(c):
        n, s, q = (F.lit(whole[f"{k}_{c}"] or 0.0) for k in "nsq")
        here = F.col(f"n_{c}")
        return _pearson(n, here, s, here, q, F.coalesce(F.col(f"s_{c}"), F.lit(0.0)))

    pairs = F.array(*[F.struct(F.lit(c).alias("g"), r(c).alias("r")) for c in numeric])
    return by.select("f", F.explode(pairs).alias("_p")).select("f", "_p.g", "_p.r")


def _number_pairs(centred: DataFrame, names: Sequence[str]) -> DataFrame:
    cols = [f"c{i}" for i in range(len(names))]
    schema = "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double"
    parts = centred.select(*[F.col(c).alias(k) for c, k in zip(names, cols)]).mapInPandas(_pairwise_moments(cols), schema)
    tot = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    lookup = F.array(*[F.lit(c) for c in names])
    return tot.select(F.get(lookup, F.col("i")).alias("f"), F.get(lookup, F.col("j")).alias("g"), _pearson(*[F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")]).alias("r"))


def _indicator_mi(present: DataFrame, classes: DataFrame) -> DataFrame:
    """Plug-in mutual information (nats) of indicators with the class, from the
    (attribute, class, n1) counts that there are and (class, ny).

    A class without the indicator adds ny ln(N / n0), and these add up by what
    the other classes leave, so no (attribute, class) grid is needed."""
    total = classes.agg(F.sum("ny").cast("double").alias("_n"))
    j = with_scalar(present.join(classes, "_y"), total)
    ones = j.groupBy("attribute").agg(F.sum("n1").cast("double").alias("_n1"))
    j = j.join(ones, "attribute")
    n, n1, ny, n_1 = (F.col(c).cast("double") for c in ("_n", "n1", "ny", "_n1"))
    n_0 = n - n_1

    def term(cell, side):
        return F.when(cell > 0, cell * F.log(cell * n / (side * ny))).otherwise(0.0)

    g = j.groupBy("attribute").agg(F.sum(term(n1, n_1) + term(ny - n1, n_0)).alias("_s"), F.sum(ny).alias("_seen"), F.max(n).alias("_n"), F.max(n_0).alias("_n0"))
    rest = F.when(F.col("_n") > F.col("_seen"), (F.col("_n") - F.col("_seen")) * F.log(F.col("_n") / F.col("_n0"))).otherwise(0.0)
    return g.select("attribute", F.greatest((F.col("_s") + rest) / F.col("_n"), F.lit(0.0)).alias("score"))


def mutual_information(
    df: DataFrame, target: str, categorical: Sequence[str], numeric: Sequence[str], key: str = "key", neighbours: int = 3
) -> DataFrame:
    """EXP-3: MI (nats) of each dummy indicator and each numeric feature with the target.

    Dummies: exact plug-in MI of the 0/1 indicator, built from sparse
    (column, level, y) counts — the zero cells come from the class totals, so
    no dense indicator matrix is formed.  Numerics: mean-imputed, then the
    nearest-neighbour estimator, with ties broken by a hash of ``key`` (unique)
    where the reference adds random noise.  Columns without a value go.
    """
    y = F.coalesce(F.col(target).cast("string"), F.lit("nan")).alias("_y")
    parts = []
    if categorical:
        long = df.select(y, *[F.col(c).cast("string").alias(c) for c in categorical]).unpivot(
            ["_y"], list(categorical), "category", "level"
        )
        long = long.select("_y", F.concat_ws("_", "category", F.coalesce("level", F.lit("nan"))).alias("attribute"))
        ly = long.groupBy("attribute", "_y").agg(F.count(F.lit(1)).alias("n1"))
        cy = df.groupBy(y).agg(F.count(F.lit(1)).alias("ny"))
        parts.append(_indicator_mi(ly, cy))
    if numeric:
        means = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in numeric])
        imp = with_scalar(df.select(F.col(key).alias("key"), y, *numeric), means).select(
            "key", F.col("_y").alias("class"), *[F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}")).alias(c) for c in numeric]
        )
        long = imp.unpivot(["key", "class"], list(numeric), "attribute", "x")
        parts.append(neighbour_information(long, neighbours))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("attribute", "score")


def with_scalar_join(levels: DataFrame, classes: DataFrame) -> DataFrame:
    """Every (level, class) combination: the class table (one row per target
    class, or folds x classes) is bounded, so it is collected and exploded."""
    return attach_rows(levels, classes)


def to_transactions(df: DataFrame, key: str, categorical: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """Rows -> (key, item) as the reference prepares them: numerics cut into
    quartiles labelled '1'..'4', then every column dummy-coded '<col>_<value>'."""
    parts = []
    if categorical:
        long = df.select(key, *[F.col(c).cast("string").alias(c) for c in categorical]).unpivot(
            [key], list(categorical), "category", "level"
        )
        parts.append(long.where(F.col("level").isNotNull()).select(key, F.concat_ws("_", "category", "level").alias("item")))
    if numeric:
        long = df.select(key, *[F.col(c).cast("double").alias(c) for c in numeric]).unpivot(
            [key], list(numeric), "category", "_x"
        )
        b = qcut(long, "_x", 4, groups=["category"], out="_q")
        parts.append(
            b.select(key, F.concat_ws("_", "category", F.coalesce(F.col("_q").cast("string"), F.lit("nan"))).alias("item"))
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def association_rules(
    transactions: DataFrame, key: str = "key", item: str = "item", min_support: float = MIN_SUPPORT, min_lift: float = MIN_LIFT
) -> DataFrame:
    """EXP-6: frequent itemsets by MLlib FP-growth, then every rule A -> S\\A
    for each frequent itemset S and non-empty proper subset A (multi-item
    consequents included), with support, confidence, lift, leverage and
    conviction; lift >= min_lift.  Itemset supports are joined on the
    sorted item array."""
    baskets = transactions.groupBy(key).agg(F.array_sort(F.collect_set(item)).alias("items"))
    fp = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=0.0)
    model = fp.fit(baskets)
    n = baskets.count()
    freq = model.freqItemsets.select(F.array_sort("items").alias("items"), (F.col("freq") / F.lit(n)).alias("support"))
    multi = freq.where(F.size("items") >= 2)
    # masks in two halves, so that no array has one element a subset
    halves = multi.select("items", "support", F.expr("size(items) div 2").alias("_low"))
    halves = halves.select("*", F.explode(F.expr("sequence(0L, shiftleft(1L, CAST(size(items) - _low AS INT)) - 1L)")).alias("_high"))
    masks = halves.select("items", "support", F.expr("explode(transform(sequence(0L, shiftleft(1L, CAST(_low AS INT)) - 1L), x -> shiftleft(_high, CAST(_low AS INT)) + x))").alias("_mask"))
    subsets = masks.where("_mask > 0 AND _mask < shiftleft(1L, size(items)) - 1L").select(
        "support",
        F.expr("filter(items, (x, i) -> (shiftright(_mask, i) & 1L) = 1L)").alias("antecedents"),
        F.expr("filter(items, (x, i) -> (shiftright(_mask, i) & 1L) = 0L)").alias("consequents"),
    )
    a = freq.select(F.col("items").alias("antecedents"), F.col("support").alias("antecedent_support"))
    c = freq.select(F.col("items").alias("consequents"), F.col("support").alias("consequent_support"))
    r = subsets.join(a, "antecedents").join(c, "consequents")
    conf = F.col("support") / F.col("antecedent_support")
    r = r.select(
        "antecedents",
        "consequents",
        "antecedent_support",
        "consequent_support",
        "support",
        conf.alias("confidence"),
        (conf / F.col("consequent_support")).alias("lift"),
        (F.col("support") - F.col("antecedent_support") * F.col("consequent_support")).alias("leverage"),
        F.when(conf < 1.0, (1.0 - F.col("consequent_support")) / (1.0 - conf)).alias("conviction"),
    )
    return r.where(F.col("lift") >= min_lift)


#: Items of all rules together that a prefix tree may have; beyond, rules are walked in blocks of that size.
MAX_TREE_ITEMS = 1 << 20


class ItemTree:
    """Prefix tree over item sets: children by item, and the sets that end at a node."""

    def __init__(self, sets: Sequence[Sequence[str]]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        for number, items in enumerate(sets):
            at = 0
            for i in sorted(set(items)):
                if i not in self.children[at]:
                    self.children[at][i] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                at = self.children[at][i]
            self.ends[at].append(number)

    def within(self, basket: Sequence[str]) -> list[int]:
        """Numbers of the sets that the basket holds: from each node only to
        children whose item is there, so other branches are never entered."""
        items = sorted(set(basket))
        found, stack = [], [(0, 0)]
        while stack:
            node, start = stack.pop()
            found += self.ends[node]
            below = self.children[node]
            if not below:
                continue
            if len(below) < len(items) - start:
                have = set(items[start:])
                stack += [(to, start) for i, to in below.items() if i in have]
            else:
                stack += [(below[items[k]], k + 1) for k in range(start, len(items)) if items[k] in below]
        return found


def rule_outcomes(rules: DataFrame, transactions: DataFrame, outcomes: DataFrame, key: str, item: str, col: str) -> DataFrame:
    """EXP-7 / JN-9: per rule, mean of ``col`` and count over the rows that hold
    every item of the rule.

    A prefix tree over the rules' items is walked once a basket, and a task
    sends (rule, sum, count) on, so no row meets a rule through a common item.
    Rules come to the driver in blocks of at most MAX_TREE_ITEMS items; each
    block reads the baskets, which are written once, again."""
    ship_code(rules.sparkSession)
    named = rules.select(
        F.concat(F.array_join("antecedents", ","), F.lit(" -> "), F.array_join("consequents", ",")).alias("rules"),
        F.array_union("antecedents", "consequents").alias("_items"),
    ).distinct()
    named = materialize(named.withColumn("_no", F.monotonically_increasing_id()), "rule-items")
    total = named.agg(F.coalesce(F.sum(F.size("_items")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // MAX_TREE_ITEMS))
    baskets = transactions.groupBy(key).agg(F.collect_set(F.col(item).cast("string")).alias("_basket"))
    baskets = baskets.join(outcomes.select(key, F.col(col).cast("double").alias("_y")), key).select("_basket", "_y")
    baskets = materialize(baskets, "rule-baskets")
    parts = []
    for k in range(blocks):
        block = named.where(F.pmod(F.xxhash64("_no"), F.lit(blocks)) == k).select("_no", "_items").collect()
        parts.append(baskets.mapInArrow(_walking([r["_no"] for r in block], ItemTree([r["_items"] for r in block])), "_no long, _sum double, _known long, _n long"))
    sums = reduce(DataFrame.unionByName, parts).groupBy("_no").agg(F.sum("_sum").alias("_sum"), F.sum("_known").alias("_known"), F.sum("_n").alias("_n"))
    return sums.join(named.select("_no", "rules"), "_no").groupBy("rules").agg(
        F.try_divide(F.sum("_sum"), F.sum("_known")).alias("outcome"), F.sum("_n").alias("outcome_count")
    )


def _walking(numbers: list[int], tree: ItemTree):
    """Task body: sums of the outcome by rule over the task's baskets."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        total, known, n = np.zeros(len(numbers)), np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
        for batch in batches:
            for basket, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = tree.within(basket)
                n[found] += 1
                if y is not None:
                    total[found] += y
                    known[found] += 1
        held = np.flatnonzero(n)
        columns = [np.array(numbers, dtype=np.int64)[held], total[held], known[held], n[held]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["_no", "_sum", "_known", "_n"])

    return run


def category_connection(
    df: DataFrame, features: Sequence[str], target: str, positive: str = "yes"
) -> DataFrame:
    """EXP-8: dispersion left-joined to target connection (missing -> 0), melted
    to (feature, category, variable, value) for the two plotted variables."""
    disp = category_dispersion(df, features)
    conn = category_target_connection(df, features, target, positive)
    j = disp.join(conn, "feature", "left").select(
        "feature",
        "category",
        F.col("percentage_of_category_level").cast("double").alias("percentage_of_category_level"),
        F.coalesce("diff_from_expectation", F.lit(0.0)).alias("diff_from_expectation"),
    )
    return j.unpivot(
        ["feature", "category"], ["percentage_of_category_level", "diff_from_expectation"], "variable", "value"
    )


def density_by_target(df: DataFrame, feature: str, target: str, grid: int = 200) -> DataFrame:
    """EXP-9: KDE of a mean-imputed numeric feature per target class."""
    mean = df.agg(F.avg(feature).alias("_m"))
    imp = with_scalar(df.select(target, feature), mean).select(
        F.col(target).cast("string").alias("level"), F.coalesce(F.col(feature).cast("double"), F.col("_m")).alias("x")
    )
    return density_points(imp, "x", groups=["level"], grid=grid)


# ---------------------------------------------------------------- EXP-1 / EXP-5 (MLlib fits)
def projection_2d(df: DataFrame, key: str, target: str, numeric: Sequence[str], sample: int | None = None, seed: int = 19):
    """EXP-1 (re-aimed t-SNE view): all rows (or a hash-ordered sample), all-null numerics
    dropped, mean-imputed, standardised, 2 principal components + target."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler

    from attrix.operators.windows import head_hash_ordered

    s = df if sample is None else head_hash_ordered(df, key, sample, seed)
    nn = s.agg(*[F.count(c).alias(c) for c in numeric]).first()
    cols = [c for c in numeric if nn[c] > 0]
    pipe = Pipeline(stages=[
        Imputer(inputCols=cols, outputCols=[f"{c}__m" for c in cols], strategy="mean"),
        VectorAssembler(inputCols=[f"{c}__m" for c in cols], outputCol="_v"),
        StandardScaler(inputCol="_v", outputCol="_z", withMean=True, withStd=True),
        PCA(k=2, inputCol="_z", outputCol="_pc"),
    ])
    from pyspark.ml.functions import vector_to_array

    out = pipe.fit(s).transform(s)
    return out.select(key, vector_to_array("_pc")[0].alias("x"), vector_to_array("_pc")[1].alias("y"), target)


def kmeans_clusters(
    df: DataFrame, key: str, categorical: Sequence[str], numeric: Sequence[str], max_clusters: int = 7,
    sample: int | None = None, seed: int = 19,
):
    """EXP-5: dummies + numerics (missing -> 0), standardised; k = 2..max by
    best silhouette (MLlib's squared-Euclidean silhouette), refit, cluster id.
    Returns (rows with ``cluster``, {k: silhouette})."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    from attrix.operators.windows import head_hash_ordered

    s = df if sample is None else head_hash_ordered(df, key, sample, seed)
    wide = dummies(s, categorical, keep=[key, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in numeric]])
    feats = [c for c in wide.columns if c != key]
    v = VectorAssembler(inputCols=feats, outputCol="_v").transform(wide)
    z = StandardScaler(inputCol="_v", outputCol="features", withMean=True, withStd=True).fit(v).transform(v).cache()
    ev_ = ClusteringEvaluator(featuresCol="features")
    scores = {}
    for k in range(2, max_clusters + 1):
        m = KMeans(k=k, seed=seed, featuresCol="features").fit(z)
        scores[k] = ev_.evaluate(m.transform(z))
    best = max(scores, key=scores.get)
    m = KMeans(k=best, seed=seed, featuresCol="features").fit(z)
    out = m.transform(z).withColumnRenamed("prediction", "cluster").drop("_v", "features")
    return out, scores


# ---------------------------------------------------------------- EXP-4
PPS_FOLDS = 4


def predictive_power(
    df: DataFrame,
    key: str,
    target: str,
    categorical: Sequence[str],
    numeric: Sequence[str],
    folds: int = PPS_FOLDS,
    numeric_bins: int = 10,
) -> DataFrame:
    """EXP-4 (re-aimed predictive power score): for each dummy indicator and
    each numeric feature, a univariate majority-class model per feature value
    (what a full-depth tree on a single binary feature predicts; numerics use
    qcut bins), cross-validated over md5 folds; score = weighted F1 averaged
    over folds, normalised against always predicting the most common class:
    pps = max(0, (model - baseline) / (1 - baseline)).  Ties pick the
    smallest class; values unseen in the training folds get the training
    majority.  Everything is built from sparse (attribute, fold, value, class)
    counts — no per-feature loop, no dense indicator matrix."""
    from attrix.operators.kernels import hash_order

    y = F.col(target).cast("string").alias("_y")
    base = df.select((hash_order(F.col(key)) % folds).cast("int").alias("_fold"), y, *categorical, *numeric)
    parts = []
    if categorical:
        long = base.select("_fold", "_y", *[F.col(c).cast("string").alias(c) for c in categorical]).unpivot(
            ["_fold", "_y"], list(categorical), "category", "level"
        )
        long = long.select("_fold", "_y", F.concat_ws("_", "category", F.coalesce("level", F.lit("nan"))).alias("attribute"))
        n1 = long.groupBy("attribute", "_fold", "_y").agg(F.count(F.lit(1)).alias("n1"))
        nt = base.groupBy("_fold", "_y").agg(F.count(F.lit(1)).alias("nt"))  # folds x classes rows
        grid = with_scalar_join(n1.select("attribute").distinct(), nt)
        cells = grid.join(n1, ["attribute", "_fold", "_y"], "left").withColumn("n1", F.coalesce("n1", F.lit(0)))
        parts.append(cells.select("attribute", "_fold", F.lit(1).alias("v"), "_y", F.col("n1").alias("n")))
        parts.append(cells.select("attribute", "_fold", F.lit(0).alias("v"), "_y", (F.col("nt") - F.col("n1")).alias("n")))
    if numeric:
        long = base.select("_fold", "_y", *[F.col(c).cast("double").alias(c) for c in numeric]).unpivot(
            ["_fold", "_y"], list(numeric), "attribute", "_x"
        ).where(F.col("_x").isNotNull())
        b = qcut(long, "_x", numeric_bins, groups=["attribute"], out="v")
        parts.append(b.groupBy("attribute", "_fold", "v", "_y").agg(F.count(F.lit(1)).alias("n")))
    cells = parts[0]
    for p in parts[1:]:
        cells = cells.unionByName(p)
    cells = cells.where(F.col("n") > 0)
    allc = cells.groupBy("attribute", "v", "_y").agg(F.sum("n").alias("na"))
    tr = allc.select("*", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("_fold")).join(
        cells.withColumnRenamed("n", "nk"), ["attribute", "_fold", "v", "_y"], "left"
    ).withColumn("t", F.col("na") - F.coalesce("nk", F.lit(0)))
    pick = lambda cnt: F.min_by("_y", F.struct((-F.col(cnt)).alias("c"), F.col("_y")))
    pred = tr.where(F.col("t") > 0).groupBy("attribute", "_fold", "v").agg(pick("t").alias("_yhat"))
    dflt = tr.groupBy("attribute", "_fold", "_y").agg(F.sum("t").alias("tc")).where(F.col("tc") > 0).groupBy(
        "attribute", "_fold"
    ).agg(pick("tc").alias("_ydef"))
    held = cells.join(pred, ["attribute", "_fold", "v"], "left").join(dflt, ["attribute", "_fold"], "left")
    held = held.withColumn("_yp", F.coalesce("_yhat", "_ydef"))
    conf = held.groupBy("attribute", "_fold", "_y", "_yp").agg(F.sum("n").alias("c"))
    per_cls = conf.select(
        "attribute", "_fold", F.col("_y").alias("cls"), F.col("c").alias("sup"),
        F.when(F.col("_y") == F.col("_yp"), F.col("c")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("pc"),
    ).unionByName(
        conf.select("attribute", "_fold", F.col("_yp").alias("cls"), F.lit(0).cast("long").alias("sup"),
                    F.lit(0).cast("long").alias("tp"), F.col("c").alias("pc"))
    ).groupBy("attribute", "_fold", "cls").agg(F.sum("sup").alias("sup"), F.sum("tp").alias("tp"), F.sum("pc").alias("pc"))
    den = 2 * F.col("tp") + (F.col("pc") - F.col("tp")) + (F.col("sup") - F.col("tp"))
    f1 = F.when(den > 0, 2.0 * F.col("tp") / den).otherwise(F.lit(0.0))
    wf1 = per_cls.groupBy("attribute", "_fold").agg((F.sum(F.col("sup") * f1) / F.sum("sup")).alias("wf1"))
    model = wf1.groupBy("attribute").agg(F.avg("wf1").alias("model_score"))
    cls_tot = cells.groupBy("attribute", "_y").agg(F.sum("n").alias("nc"))
    bl = cls_tot.groupBy("attribute").agg(
        F.sum("nc").alias("_n"), F.max("nc").alias("_nmax")
    ).select(
        "attribute",
        (F.col("_nmax") / F.col("_n") * (2.0 * F.col("_nmax") / (2.0 * F.col("_nmax") + (F.col("_n") - F.col("_nmax"))))).alias(
            "baseline_score"
        ),
    )
    out = model.join(bl, "attribute")
    pps = F.when(F.col("model_score") <= F.col("baseline_score"), F.lit(0.0)).otherwise(
        (F.col("model_score") - F.col("baseline_score")) / (1.0 - F.col("baseline_score"))
    )
    return out.select(F.col("attribute").alias("feature"), pps.alias("pps"), "model_score", "baseline_score")


def explore_all(df: DataFrame, key: str, target: str, categorical: Sequence[str], numeric: Sequence[str],
                positive: str = "yes", max_clusters: int = 7) -> dict[str, DataFrame]:
    """EXP-10: the exploration reports of the reference, by name (fits run
    eagerly; aggregations stay lazy until written)."""
    from attrix.operators.aggregates import summary_statistics, target_balance

    y01 = df.withColumn("_y01", F.when(F.col(target).cast("string").startswith(positive[:1]), 1).otherwise(0))
    trans = to_transactions(df, key, categorical, numeric)
    rules = association_rules(trans, key, "item")
    clustered, _ = kmeans_clusters(df, key, categorical, numeric, max_clusters)
    out = {
        "projection": projection_2d(df, key, target, numeric),
        "summary": summary_statistics(df, target, numeric, categorical),
        "correlation": correlated_features(df, categorical, numeric),
        "mutual_information": mutual_information(df, target, categorical, numeric, key),
        "predictive_power": predictive_power(df, key, target, categorical, numeric),
        "clusters": clustered,
        "rules": rules,
        "rule_outcomes": rule_outcomes(rules, trans, y01, key, "item", "_y01"),
        "target_balance": target_balance(df, target),
        "category_connection": category_connection(df, categorical, target, positive),
    }
    for c in numeric:
        out[f"density_{c}"] = density_by_target(df, c, target)
    return out
