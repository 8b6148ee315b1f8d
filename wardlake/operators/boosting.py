"""Gradient-boosted trees with one softmax loss over all classes (I9), as Spark jobs, and fitted
trees as columns or as a table (I10).

Features are cut into bins.  All classes share a tree: a leaf holds one value per class.  A level of
a tree is one job: every task sums the gradients of its rows by (node, feature, bin), the sums are
added up in the cluster, a feature in one task, and the best split of each node is read off them.  Only
one set of sums a level reaches the driver; its size depends on depth, features and bins, not on rows or tasks.
Rows carry their scores from tree to tree, so that a level costs the same in each round, and below the root
only the lighter half of each split node is summed: the other half is what is left of its parent.
Gradients are whole numbers (units of 1 / SCALE), so a sum is the same in any order and a fit the
same on any number of partitions.

A fitted model scores rows in column expressions: no Python, no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.session import write_table
from wardlake.sources.tables import spread

#: Units of a gradient.
SCALE = 1 << 20
#: Tasks whose sums the driver adds up by itself; those of more tasks are added in the cluster.
DIRECT = 8
#: Bins lie between mean -+ so many standard deviations, or the least and most value.
SPREAD = 4


@dataclass
class Setting:
    classes: int = 3
    rounds: int = 20
    depth: int = 4
    rate: float = 0.3
    bins: int = 64
    penalty: float = 1.0  # added to the second derivatives of a leaf
    least_weight: float = 1.0  # of the second derivatives on either side of a split


@dataclass
class Booster:
    features: list[str]
    low: list[float]
    high: list[float]
    setting: Setting
    #: Per tree: for each level the split feature and bin of each node (bin = bins: no split), and
    #: the leaf values (leaf x class).
    trees: list[tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]] = field(default_factory=list)


def bin_ends(df: DataFrame, features: list[str]) -> tuple[list[float], list[float]]:
    """Where the bins of each feature begin and end."""
    r = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(features)
                 for n, f in (("a", F.min), ("b", F.max), ("m", F.avg), ("s", F.stddev_pop))]).first()
    at = range(len(features))
    return ([max(r[f"a{i}"] or 0.0, round((r[f"m{i}"] or 0.0) - SPREAD * (r[f"s{i}"] or 0.0), 6)) for i in at],
            [min(r[f"b{i}"] or 0.0, round((r[f"m{i}"] or 0.0) + SPREAD * (r[f"s{i}"] or 0.0), 6)) for i in at])


def bin_column(x: Column, low: float, high: float, bins: int) -> Column:
    """The bin of a value; null lies in the first."""
    if not high > low:
        return F.lit(0)
    at = F.floor((x.cast("double") - F.lit(low)) * bins / F.lit(high - low))
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.coalesce(at, F.lit(0)))).cast("int")


def _leaves(tree, bins: np.ndarray) -> np.ndarray:
    """The node of each row after the levels of a tree (all of them, or as far as it is grown)."""
    node = np.zeros(len(bins), np.int64)
    for feature, cut in tree:
        node = 2 * node + (bins[np.arange(len(bins)), feature[node]] > cut[node])
    return node


def _gradients(labels: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the softmax loss in units of 1 / SCALE, at the scores ``f`` (row x class)."""
    classes = f.shape[1]
    e = np.exp(f - f.max(axis=1, keepdims=True, initial=-np.inf))
    total = e[:, 0].copy()
    for k in range(1, classes):
        total += e[:, k]
    p = e / total[:, None]
    y = labels[:, None] == np.arange(classes)
    return np.floor((p - y) * SCALE + 0.5), np.floor(p * (1 - p) * SCALE + 0.5)


def _sums(blocks, levels, side: np.ndarray, setting: Setting, n_features: int) -> np.ndarray:
    """Sums of both derivatives (first, then second, per class) by parent, feature and bin, over the rows
    that lie on the ``side`` (0 left, 1 right) of their parent; at the root over all."""
    nodes, k = len(side), setting.classes
    out = np.zeros((2 * k, n_features, nodes * setting.bins), np.int64)
    for bins, labels, f in blocks:
        node = _leaves(levels, bins)
        if levels:
            some = np.flatnonzero((node & 1) == side[node >> 1])
            node, bins, labels, f = node[some] >> 1, bins[some], labels[some], f[some]
        both = np.ascontiguousarray(np.hstack(_gradients(labels, f)).T)
        for j in range(n_features):
            at = node * setting.bins + bins[:, j]
            for i in range(2 * k):
                out[i, j] += np.bincount(at, both[i], out.shape[2]).astype(np.int64)
    return out.reshape(2 * k, n_features, nodes, setting.bins)


def _lighter(sums: np.ndarray, feature: np.ndarray, cut: np.ndarray, setting: Setting) -> np.ndarray:
    """The side (0 left, 1 right) of each split node with the smaller second derivatives."""
    after = _grown(sums, feature, cut, setting)[setting.classes:, 0, :, 0].sum(axis=0)
    return (after[1::2] < after[::2]).astype(np.int64)


def _children(parents: np.ndarray, half: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Sums by node of a level, from those of the level above and of one side of each."""
    right = side[:, None] == 1
    both = np.stack((np.where(right, parents - half, half), np.where(right, half, parents - half)), axis=3)
    return both.reshape(*parents.shape[:2], 2 * parents.shape[2], parents.shape[3])


def _added(rows, levels, side: np.ndarray, setting: Setting, n_features: int) -> np.ndarray:
    """``_sums`` over all tasks, each feature added up in one task of the cluster."""
    if rows.getNumPartitions() <= DIRECT:
        return rows.mapPartitions(lambda part: [_sums(part, levels, side, setting, n_features)]).reduce(np.add)

    def by_feature(part):
        sums = _sums(part, levels, side, setting, n_features)
        return [(j, sums[:, j]) for j in range(n_features)]

    added = dict(rows.mapPartitions(by_feature).reduceByKey(np.add, n_features).collect())
    return np.stack([added[j] for j in range(n_features)], axis=1)


def _term(g: np.ndarray, h: np.ndarray, penalty: float) -> np.ndarray:
    parts = g.astype(float) * g / (h + penalty)
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return total


def best_splits(sums: np.ndarray, setting: Setting) -> tuple[np.ndarray, np.ndarray]:
    """Feature and bin of each node's best split; ties to the first feature, then bin."""
    k, lam = setting.classes, setting.penalty * SCALE
    left = sums.cumsum(axis=3)
    total = left[..., -1:]
    right = total - left
    gain = _term(left[:k], left[k:], lam) + _term(right[:k], right[k:], lam) - _term(total[:k], total[k:], lam)
    least = setting.least_weight * SCALE
    gain = np.where((left[k:].sum(axis=0) >= least) & (right[k:].sum(axis=0) >= least), gain, 0.0)
    flat = gain.transpose(1, 0, 2).reshape(sums.shape[2], -1)
    at, most = flat.argmax(axis=1), flat.max(axis=1)
    split = most > 0
    return np.where(split, at // setting.bins, 0), np.where(split, at % setting.bins, setting.bins)


def leaf_values(sums: np.ndarray, setting: Setting) -> np.ndarray:
    """Leaf x class, from the sums by node (any one feature's bins together)."""
    by_node = sums[:, 0].sum(axis=2)
    g, h = by_node[:setting.classes], by_node[setting.classes:]
    return ((setting.rate * -g.astype(float)) / (h + setting.penalty * SCALE)).T


def _grown(sums: np.ndarray, feature: np.ndarray, cut: np.ndarray, setting: Setting) -> np.ndarray:
    """Sums by node after the last split, from those before it: shape as ``sums`` with one feature and
    one bin."""
    at = np.arange(sums.shape[2])
    chosen = sums[:, feature, at]  # derivative, node, bin
    below = np.arange(setting.bins) <= cut[:, None]
    left = np.where(below, chosen, 0).sum(axis=2)
    both = np.stack((left, chosen.sum(axis=2) - left), axis=2).reshape(len(sums), -1)
    return both[:, None, :, None]


def fit(df: DataFrame, features: list[str], label: str, setting: Setting | None = None) -> Booster:
    """Fit on all rows of ``df``; ``label`` holds the class number.  Rows without a label
    take no part; a null feature counts as the least value; no rows are an error."""
    setting = setting or Setting()
    df = df.filter(F.col(label).isNotNull())
    if df.isEmpty():
        raise ValueError("no training rows")
    low, high = bin_ends(df, features)
    model = Booster(list(features), low, high, setting)
    binned = spread(df).select(*[bin_column(F.col(c), a, b, setting.bins).cast("short").alias(f"b{i}")
                                 for i, (c, a, b) in enumerate(zip(features, low, high, strict=True))],
                               F.col(label).cast("short").alias("y"))

    def packed(batches):
        for batch in batches:
            values = np.stack([np.asarray(c, dtype=np.uint8) for c in batch.columns], axis=1)
            yield pa.RecordBatch.from_pydict({"rows": pa.array([values.tobytes()], pa.binary())})

    table = write_table(binned.mapInArrow(packed, "rows binary"), "binned")
    n = len(features)

    def blocks(r):
        values = np.frombuffer(r[0], np.uint8).reshape(-1, n + 1)
        return values[:, :n], values[:, n], np.zeros((len(values), setting.classes))

    def scored(block, tree):
        bins, labels, f = block
        return bins, labels, f + tree[1][_leaves(tree[0], bins)]

    rows = table.rdd.map(blocks).persist(StorageLevel.MEMORY_AND_DISK)
    old = None
    try:
        for at in range(setting.rounds):
            levels, sums, side = [], None, np.zeros(1, np.int64)
            for _ in range(setting.depth):
                half = _added(rows, list(levels), side, setting, n)
                if old is not None:  # the first job of a round has read the scores of the round before
                    old.unpersist()
                    old = None
                sums = half if sums is None else _children(sums, half, side)
                levels.append(best_splits(sums, setting))
                side = _lighter(sums, *levels[-1], setting)
            model.trees.append((levels, leaf_values(_grown(sums, *levels[-1], setting), setting)))
            if at + 1 < setting.rounds:
                old, rows = rows, rows.map(lambda b, tree=model.trees[-1]: scored(b, tree)).persist(StorageLevel.MEMORY_AND_DISK)
    finally:
        for r in (old, rows):
            if r is not None:
                r.unpersist()
    return model


def _leaf_number(levels, no_split: int) -> str:
    """The leaf number of a row as nested conditions, in SQL (one text costs one call to the JVM)."""
    def below(level: int, node: int) -> str:
        if level == len(levels):
            return str(node)
        feature, cut = (int(x[node]) for x in levels[level])
        left = below(level + 1, 2 * node)
        return left if cut == no_split else f"if(_bins._bin{feature} <= {cut}, {left}, {below(level + 1, 2 * node + 1)})"

    return below(0, 0)


def _once(df: DataFrame, keep: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with ``value`` worked out once a row: a projection under an ``explode`` of one element, which the
    optimizer does not merge with what stands above, so that conditions and filters do not copy it."""
    return df.select(*keep, value.alias(name)).select(*keep, F.explode(F.array(name)).alias(name))


def with_probabilities(df: DataFrame, model: Booster, name: str = "probability",
                       inputs: dict[str, Column] | None = None) -> DataFrame:
    """``df`` plus an array with the probability of each class.  ``inputs`` gives the features that are
    no columns of ``df``."""
    keep = df.columns
    s = model.setting
    bins = [f"_bin{i}" for i in range(len(model.features))]
    inputs = inputs or {c: F.col(c) for c in model.features}
    found = [bin_column(inputs[c], low, high, s.bins).alias(b)
             for b, c, low, high in zip(bins, model.features, model.low, model.high, strict=True)]
    out = _once(df, keep, F.struct(*found), "_bins")
    out = _once(out, keep, F.expr(f"array({', '.join(_leaf_number(levels, s.bins) for levels, _ in model.trees)})"), "_leaves")

    def margin(k: int) -> Column:
        values = [", ".join(f"{float(v)!r}D" for v in values[:, k]) for _, values in model.trees]
        return F.expr(" + ".join(["0D", *(f"element_at(array({v}), _leaves[{t}] + 1)" for t, v in enumerate(values))]))

    out = out.withColumns({f"_f{k}": margin(k) for k in range(s.classes)})
    top = F.greatest(*[F.col(f"_f{k}") for k in range(s.classes)])
    out = out.withColumns({f"_e{k}": F.exp(F.col(f"_f{k}") - top) for k in range(s.classes)})
    total = F.col("_e0")
    for k in range(1, s.classes):
        total = total + F.col(f"_e{k}")
    return _once(out, keep, F.array(*[F.col(f"_e{k}") / total for k in range(s.classes)]), name)


def node_table(spark: SparkSession, model: Booster) -> DataFrame:
    """The fitted trees as rows: tree, node (1 = root, children 2n and 2n + 1), feature and the value
    up to which rows go left (null: all do), and the class values of leaves."""
    rows, s = [], model.setting
    for t, (levels, values) in enumerate(model.trees):
        for level, (feature, cut) in enumerate(levels):
            for i, (f, c) in enumerate(zip(feature, cut, strict=True)):
                f, c = int(f), int(c)
                split = c < s.bins
                most = model.low[f] + (model.high[f] - model.low[f]) * (c + 1) / s.bins if split else None
                rows.append((t, (1 << level) + i, model.features[f] if split else None, most, None))
        rows += [(t, (1 << s.depth) + i, None, None, [float(x) for x in v]) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "tree int, node int, feature string, below double, value array<double>")


def sql_fit(source: str, features: list[str], setting: Setting | None = None) -> dict[str, str]:
    """The same fit and its scores in SQL: CTEs over a CTE ``source`` with id, the features, label (class
    number) and train (boolean); ``boosted`` has id and p0, p1, ...  Each recursion step is one level
    of a tree, or the leaves of one."""
    s = setting or Setting()
    ks, steps = range(s.classes), s.depth + 1
    each = lambda text, sep=", ": sep.join(text.format(k=k) for k in ks)
    lam = repr(s.penalty * SCALE)
    ends = ", ".join(f"greatest(min({c}), round(avg({c}) - {SPREAD} * stddev_pop({c}), 6)) AS a{i}, "
                     f"least(max({c}), round(avg({c}) + {SPREAD} * stddev_pop({c}), 6)) AS z{i}" for i, c in enumerate(features))
    bins = ", ".join(f"CASE WHEN z{i} > a{i} THEN greatest(0, least({s.bins - 1}, coalesce(CAST(floor(({c} - a{i}) * {s.bins} / (z{i} - a{i})) AS INTEGER), 0))) "
                     f"ELSE 0 END" for i, c in enumerate(features))
    total = " + ".join(f"e{k}" for k in ks)
    derived = f"""SELECT id, b, train, node, step, {each('floor((p{k} - CASE WHEN y = {k} THEN 1 ELSE 0 END) * ' + str(SCALE) + ' + 0.5) AS g{k}')},
        {each('floor(p{k} * (1 - p{k}) * ' + str(SCALE) + ' + 0.5) AS h{k}')}
        FROM (SELECT *, {each('e{k} / (' + total + ') AS p{k}')}
          FROM (SELECT *, {each('exp(f{k} - greatest(' + ', '.join(f'f{j}' for j in ks) + ')) AS e{k}')} FROM boost_state WHERE train) x) x"""
    term = lambda side: "(" + each("g{k}" + side + " * g{k}" + side + " / (h{k}" + side + " + " + lam + ")", " + ") + ")"
    heavy = lambda side: each("h{k}" + side, " + ") + f" >= {s.least_weight * SCALE}"
    names = [f"{d}{k}" for d in "gh" for k in ks]
    split = f"""SELECT node, feature, bin FROM (
        SELECT *, {', '.join(f'{n}t - {n}l AS {n}r' for n in names)} FROM (
          SELECT node, feature, bin, {', '.join(f'sum({n}) OVER (PARTITION BY node, feature ORDER BY bin) AS {n}l, sum({n}) OVER (PARTITION BY node, feature) AS {n}t' for n in names)}
          FROM (SELECT node, feature, bin, {', '.join(f'sum({n}) AS {n}' for n in names)}
            FROM (SELECT node, unnest(range(1, {len(features) + 1})) AS feature, unnest(b) AS bin, {', '.join(names)} FROM derived) x GROUP BY 1, 2, 3) x) x) x
        WHERE {heavy('l')} AND {heavy('r')} AND {term('l')} + {term('r')} - {term('t')} > 0
        QUALIFY row_number() OVER (PARTITION BY node ORDER BY {term('l')} + {term('r')} - {term('t')} DESC, feature, bin) = 1"""
    leaf = f"SELECT node, {each('(' + repr(s.rate) + ' * -sum(g{k})) / (sum(h{k}) + ' + lam + ') AS v{k}')} FROM derived GROUP BY 1"
    state = f"""SELECT id, b, y, train, {each('CAST(0 AS DOUBLE) AS f{k}')}, 0 AS node, 0 AS step FROM boost_bins
        UNION ALL (WITH derived AS ({derived}), split AS ({split}), leaf AS ({leaf})
          SELECT id, b, y, train, {each('CASE WHEN step % ' + str(steps) + ' = ' + str(s.depth) + ' THEN f{k} + coalesce(v{k}, 0) ELSE f{k} END')},
            CASE WHEN step % {steps} = {s.depth} THEN 0 ELSE 2 * s.node + CASE WHEN b[feature] > bin THEN 1 ELSE 0 END END, step + 1
          FROM boost_state s LEFT JOIN split ON split.node = s.node LEFT JOIN leaf ON leaf.node = s.node
          WHERE step < {s.rounds * steps})"""
    exps = each("exp(f{k} - greatest(" + ", ".join(f"f{j}" for j in ks) + ")) AS e{k}")
    return {
        "boost_ends": f"SELECT {ends} FROM {source} WHERE train",
        "boost_bins": f"SELECT id, [{bins}] AS b, label AS y, train FROM {source}, boost_ends",
        "boost_state": state,
        "boosted": f"SELECT id, {', '.join(f'e{k} / ({total}) AS p{k}' for k in ks)} FROM (SELECT id, {exps} FROM boost_state WHERE step = {s.rounds * steps}) x",
    }
