"""Boosted trees for many fits in one job.

The rows are binned once and stored. Every fit (configuration, fold, target) is dealt over shards: hash shares of all rows, two at least and
at most ``SHARD_ROWS`` rows each. A task takes one (fit, shard) and grows the whole schedule on it; a fit's model is the mean of
its shards' scores. So one job serves all open fits, nothing is exchanged between rounds, no task holds more than a shard
whatever the size of the table, and a lost executor costs the shards it was growing. (Exchanging sums for every level of every tree
takes thousands of jobs or barrier steps in sequence, of 0.1 to 0.9 s each.) Scoring grows with the number of shards.

Trees grow leaf by leaf: the leaf with the largest gain is split until ``num_leaves`` is reached; only the smaller child of a split is
summed up, its sibling is the difference. Rows are taken in the order of their keys, and bags and feature subsets follow from
hashes of keys, rounds and seeds, so a shard that is grown again gives the same trees.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import heapq
import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.schemas import SALES_GRAIN
from shelfcast.session import shared_folder
from shelfcast.sources.files import path_exists

#: Stands for a missing value; all features are at least zero, so it has a bin of its own.
MISSING = -1.0
#: Rows of a shard, on average; no fit has fewer than ``LEAST_SHARDS``.
SHARD_ROWS, LEAST_SHARDS = 1 << 20, 2
#: Part of the key of a stored fit; another way to grow trees takes another number.
METHOD = 1
#: Blocks of fewer rows are summed up for all features in one call.
WIDE_ROWS = 300
_ACCURACY = 1000


@dataclass(frozen=True)
class TreeParameters:
    """Boosting settings; the defaults follow a slow, lightly regularised schedule."""

    step_size: float = 0.05
    rounds: int = 250
    num_leaves: int = 31
    max_depth: int = -1
    min_rows_per_leaf: int = 100
    feature_fraction: float = 0.9
    row_fraction: float = 0.9
    lambda_l1: float = 0.0
    lambda_l2: float = 1.0
    seed: int = 42
    max_bins: int = 64

    def as_row(self) -> dict[str, float]:
        return {k: v for k, v in asdict(self).items() if k not in ("seed", "max_bins")}


@dataclass(frozen=True)
class Fit:
    """One model to grow: rows up to the cutoff, on one target."""

    name: str
    cutoff: dt.date
    parameters: TreeParameters
    features: tuple[str, ...]
    target: str = "log_sales"

    def text(self) -> str:
        return json.dumps([str(self.cutoff), asdict(self.parameters), self.features, self.target], sort_keys=True)


#: Targets: regression on log1p(sales), on that of positive sales only, and whether there was any sale.
TARGETS = ("log_sales", "log_positive", "any_sale")


@dataclass
class Ensemble:
    """Trees of one fit as flat arrays, one row per tree; unused places are leaves of value 0."""

    features: list[str]
    base: float
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    target: str = "log_sales"

    def score(self, inputs: dict[str, np.ndarray]) -> np.ndarray:
        """Raw score per row; all trees are walked together, one level at a time."""
        n = len(next(iter(inputs.values())))
        table = np.stack([np.asarray(inputs[c], float) for c in self.features], axis=1) if n else np.empty((0, len(self.features)))
        out, tree = np.full(n, self.base), np.arange(len(self.feature))[None, :]
        for begin in range(0, n, 4096):
            rows = table[begin:begin + 4096]
            at = np.zeros((len(rows), len(self.feature)), np.int64)
            index = np.arange(len(rows))[:, None]
            while True:
                split = self.feature[tree, at]
                if (split < 0).all():
                    break
                low = rows[index, np.maximum(split, 0)] <= self.threshold[tree, at]
                at = np.where(split < 0, at, np.where(low, self.left[tree, at], self.right[tree, at]))
            out[begin:begin + 4096] += self.value[tree, at].sum(axis=1)
        return out

    def predict(self, inputs: dict[str, np.ndarray]) -> np.ndarray:
        """Sales, never negative, or the chance of any sale."""
        score = self.score(inputs)
        return 1 / (1 + np.exp(-score)) if self.target == "any_sale" else np.maximum(np.expm1(score), 0.0)

    def gains(self) -> dict[str, float]:
        used = self.feature >= 0
        sums = np.bincount(self.feature[used], weights=self.gain[used], minlength=len(self.features))
        return dict(zip(self.features, sums.tolist(), strict=True))


# ---------------------------------------------------------------- binned rows


@dataclass
class Bins:
    """Upper bounds of the bins of each feature; the last bin is open."""

    features: list[str]
    bounds: list[np.ndarray]

    def codes(self, columns: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(b, x, side="left") for b, x in zip(self.bounds, columns, strict=True)], axis=1).astype(np.uint8)


def bins_by_cutoff(rows: DataFrame, features: list[str], cutoffs: list[dt.date], max_bins: int) -> list[Bins]:
    """Bounds at even shares of the rows up to each cutoff, from sketches that tasks merge, in one pass.

    So what a fit learns from depends on its own rows alone, not on the fits it is grown with. Sketches have an error of
    one part in ``_ACCURACY``, within which another partitioning of the rows may move a bound."""
    shares = F.array(*[F.lit(i / (max_bins - 2)) for i in range(1, max_bins - 2)])  # built once for all sketches
    sketches = [F.percentile_approx(F.when(F.col("date") <= F.lit(cutoff), F.col(c)), shares, _ACCURACY).alias(f"{i}_{c}")
                for i, cutoff in enumerate(cutoffs) for c in features]
    found = rows.agg(*sketches).first()
    return [Bins(features, [np.unique([MISSING / 2, *[x for x in found[f"{i}_{c}"] or [] if x > MISSING / 2]]) for c in features])
            for i in range(len(cutoffs))]


def binned(rows: DataFrame, bins: list[Bins], cutoffs: list[dt.date]) -> DataFrame:
    """(cutoff_no, key, sales, bins): the rows up to each cutoff, one byte per feature; ``rows`` has the grain, sales and the features."""
    names, shared = bins[0].features, rows.sparkSession.sparkContext.broadcast(bins)
    days = [(x - dt.date(1970, 1, 1)).days for x in cutoffs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            day = batch["day"].to_numpy()
            columns = [batch[c].to_numpy(zero_copy_only=False) for c in names]
            for i, last in enumerate(days):
                seen = np.flatnonzero(day <= last)
                if not len(seen):
                    continue
                codes = np.ascontiguousarray(shared.value[i].codes([x[seen] for x in columns]))
                offsets = np.arange(0, codes.size + 1, len(names), dtype=np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(seen), [None, pa.py_buffer(offsets), pa.py_buffer(codes)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), i, np.int32)), batch["key"].take(pa.array(seen)), batch["sales"].take(pa.array(seen)), packed],
                                                 ["cutoff_no", "key", "sales", "bins"])

    keyed = rows.select(F.xxhash64(*SALES_GRAIN).alias("key"), F.unix_date("date").alias("day"), F.col("sales").cast("double").alias("sales"), *names)
    return keyed.mapInArrow(run, "cutoff_no int, key long, sales double, bins binary")


# ---------------------------------------------------------------- growing


def shrunk(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


@dataclass(eq=False)
class Node:
    """A node while its tree grows."""

    rows: np.ndarray
    depth: int
    sums: np.ndarray
    total: np.ndarray | None = None
    gain: float = -np.inf
    split: tuple[int, int] | None = None
    left_rows: float = 0.0
    children: tuple[Node, Node] | None = None


class Growth:
    """One fit on one shard: scores of its rows and the trees so far."""

    def __init__(self, fit: Fit, data: dict[str, np.ndarray], names: list[str]):
        self.p, self.columns = fit.parameters, np.array([names.index(c) for c in fit.features])
        order = np.argsort(data["key"], kind="stable")
        rows = order[data["sales"][order] > 0] if fit.target == "log_positive" else order
        self.codes = np.ascontiguousarray(data["codes"][rows][:, self.columns])
        self.by_feature = np.ascontiguousarray(self.codes.T)
        self.key, sales = data["key"][rows].astype(np.uint64), data["sales"][rows]
        self.logistic = fit.target == "any_sale"
        self.y = (sales > 0).astype(float) if self.logistic else np.log1p(sales)
        widths = self.codes.max(axis=0, initial=0).astype(np.int64) + 1
        self.offsets = np.cumsum(widths) - widths  # where each feature's bins begin
        self.widths, self.owner = widths, np.repeat(np.arange(len(self.columns)), widths)
        mean = float(self.y.mean()) if len(rows) else 0.0
        if self.logistic:
            mean = min(max(mean, 1e-6), 1 - 1e-6)
        self.base = float(np.log(mean / (1 - mean))) if self.logistic else mean
        self.score = np.full(len(self.y), self.base)

    def tree(self, number: int) -> dict[str, list]:
        """The next tree; its leaf values are added to the scores."""
        p = self.p
        count = max(1, round(p.feature_fraction * len(self.columns)))
        used = np.random.default_rng([p.seed, number]).permutation(len(self.columns))[:count]
        self.closed = ~np.isin(self.owner, used)  # bins of features that this tree doesn't use
        self.bag = unit_hash(self.key, p.seed, number) < p.row_fraction
        guess = 1 / (1 + np.exp(-self.score)) if self.logistic else self.score
        self.weights = [guess - self.y, guess * (1 - guess)] if self.logistic else [guess - self.y]
        rows = np.arange(len(self.y))
        root = Node(rows, 0, self.sums(rows))
        self.best_splits([root])
        waiting, leaves, made = [(-root.gain, 0, root)] if root.split else [], 1, 1
        while waiting and leaves < p.num_leaves:
            node = heapq.heappop(waiting)[2]
            leaves += 1
            self.split(node)
            for child in node.children:
                if child.split:
                    heapq.heappush(waiting, (-child.gain, made, child))
                    made += 1
        return self.flat(root)

    def sums(self, rows: np.ndarray) -> np.ndarray:
        """(gradient, rows, curvature if it is not the row count) by feature and bin, of the rows in the bag."""
        size = len(self.owner)
        out = np.zeros((len(self.weights) + 1, size))
        rows = rows[self.bag[rows]]
        for begin in range(0, len(rows), 1 << 16):
            part = rows[begin:begin + (1 << 16)]
            weights = [w[part] for w in self.weights]
            if len(part) < WIDE_ROWS:  # too few rows to be worth a call per feature
                places = (self.codes[part] + self.offsets).ravel()
                out[1] += np.bincount(places, minlength=size)
                for kind, w in zip((0, 2), weights):
                    out[kind] += np.bincount(places, weights=np.repeat(w, len(self.columns)), minlength=size)
                continue
            counted = weights[0] + 1j  # gradient and row count are added up together
            for codes, first, width in zip(self.by_feature, self.offsets.tolist(), self.widths.tolist(), strict=True):
                places, bins, both = codes.take(part).astype(np.intp), slice(first, first + width), np.zeros(width, complex)
                np.add.at(both, places, counted)
                out[0, bins] += both.real
                out[1, bins] += both.imag
                for w in weights[1:]:
                    out[2, bins] += np.bincount(places, weights=w, minlength=width)
        return out

    def split(self, node: Node) -> None:
        feature, cut = node.split
        low = self.by_feature[feature].take(node.rows) <= cut
        parts, first = (node.rows[low], node.rows[~low]), 0 if 2 * node.left_rows <= node.total[1] else 1
        known = self.sums(parts[first])
        sums = (known, node.sums - known) if first == 0 else (node.sums - known, known)
        node.children = tuple(Node(r, node.depth + 1, s) for r, s in zip(parts, sums, strict=True))
        node.sums = np.empty(0)
        self.best_splits(list(node.children))

    def curvature(self, sums: np.ndarray) -> np.ndarray:
        return sums[..., 2 if self.logistic else 1, :]

    def strength(self, sums: np.ndarray) -> np.ndarray:
        g = sums[..., 0, :]
        if self.p.lambda_l1:
            g = shrunk(g, self.p.lambda_l1)
        return g * g / (self.curvature(sums) + self.p.lambda_l2)

    def best_splits(self, nodes: list[Node]) -> None:
        """The best cut of each node: sums up to every bin of a feature against those above it."""
        p, sums = self.p, np.stack([n.sums for n in nodes])
        end = self.offsets[1] if len(self.offsets) > 1 else sums.shape[2]
        totals = sums[:, :, :end].sum(axis=2)[:, :, None]
        low = np.cumsum(sums, axis=2)
        low -= (low - sums)[:, :, self.offsets][:, :, self.owner]
        high = totals - low
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = self.strength(low) + self.strength(high) - self.strength(totals)
        least = max(p.min_rows_per_leaf, 1)
        gain[(low[:, 1] < least) | (high[:, 1] < least) | self.closed | ~np.isfinite(gain)] = -np.inf
        best = gain.argmax(axis=1)
        for i, (node, place) in enumerate(zip(nodes, best.tolist(), strict=True)):
            node.total = totals[i, :, 0]
            if gain[i, place] > 1e-9 and (p.max_depth < 0 or node.depth < p.max_depth):
                feature = int(self.owner[place])
                node.gain, node.split = float(gain[i, place]), (feature, place - int(self.offsets[feature]))
                node.left_rows = float(low[i, 1, place])

    def flat(self, root: Node) -> dict[str, list]:
        tree: dict[str, list] = {k: [] for k in ("feature", "bin", "left", "right", "value", "gain")}
        queue = [root]
        for node in queue:  # grows while it is walked
            if node.children:
                row = (*node.split, len(queue), len(queue) + 1, 0.0, node.gain)
                queue += node.children
            else:
                h = float(self.curvature(node.total[:, None])[0]) + self.p.lambda_l2
                value = -self.p.step_size * float(shrunk(node.total[0], self.p.lambda_l1)) / h if h > 0 else 0.0
                self.score[node.rows] += value
                row = (-1, 0, 0, 0, value, 0.0)
            for k, v in zip(tree, row, strict=True):
                tree[k].append(v)
        return tree


def unit_hash(keys: np.ndarray, *seeds: int) -> np.ndarray:
    """A number from 0 to 1 for each key."""
    for seed in seeds:
        keys = (keys ^ np.uint64(seed + 1)) * np.uint64(0x9E3779B97F4A7C15)
        keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        keys = keys ^ (keys >> np.uint64(29))
    return (keys >> np.uint64(11)).astype(float) / float(1 << 53)


def read_rows(held: list[pa.RecordBatch], width: int) -> dict[str, np.ndarray]:
    columns = {c: np.concatenate([b[c].to_numpy(zero_copy_only=False) for b in held]) for c in ("key", "sales")}
    return columns | {"codes": np.frombuffer(b"".join(x for b in held for x in b["bins"].to_pylist()), np.uint8).reshape(-1, width)}


def dealt(table: DataFrame, fits: list[Fit], cutoffs: list[dt.date], shards: dict[int, int]) -> tuple[list[tuple[int, int]], DataFrame]:
    """All (fit number, shard), and their rows: (unit, key, sales, bins), one partition each."""
    units = [(fit_no, shard) for fit_no, f in enumerate(fits) for shard in range(shards[cutoffs.index(f.cutoff)])]
    first = [next(i for i, u in enumerate(units) if u[0] == n) for n in range(len(fits))]
    firsts = F.array(*[F.array(*[F.lit(first[n]) for n, f in enumerate(fits) if f.cutoff == c]) for c in cutoffs])
    counts = F.array(*[F.lit(shards[i]) for i in range(len(cutoffs))])
    mine = F.col("cutoff_no")
    rows = table.select("*", F.explode(firsts[mine]).alias("first"), counts[mine].alias("shards")).select(
        (F.col("first") + F.pmod(F.xxhash64("key", F.lit(1)), F.col("shards"))).cast("int").alias("unit"), "key", "sales", "bins")
    return units, rows.repartitionById(len(units), "unit")  # ranges found by sampling would put several units into one task


def grown(table: DataFrame, bins: Bins, fits: list[Fit], cutoffs: list[dt.date], shards: dict[int, int]) -> DataFrame:
    """(fit, shard, base, trees) for every fit and shard: each is one task."""
    shared = table.sparkSession.sparkContext.broadcast(fits)
    names = bins.features
    units, rows = dealt(table, fits, cutoffs, shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value

        held = [batch for batch in batches if batch.num_rows]
        if held:
            fit_no, shard = units[held[0]["unit"][0].as_py()]
            growth = Growth(wanted[fit_no], read_rows(held, len(names)), names)
            trees = [growth.tree(i) for i in range(wanted[fit_no].parameters.rounds)] if len(growth.y) else []
            row = {"fit": wanted[fit_no].name, "shard": shard, "base": growth.base, "rows": len(growth.y), "trees": json.dumps(trees)}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("fit", pa.string()), ("shard", pa.int32()), ("base", pa.float64()), ("rows", pa.int64()), ("trees", pa.string())]))

    return rows.mapInArrow(run, "fit string, shard int, base double, rows long, trees string")


def ensemble(fit: Fit, parts: list[tuple[float, int, list[dict]]], bins: Bins) -> Ensemble:
    """The mean of the shards' models; shards without rows have none."""
    parts = [x for x in parts if x[1]]
    bounds = [bins.bounds[bins.features.index(c)] for c in fit.features]
    trees = [t for _, _, grown_trees in parts for t in grown_trees]
    size = max([len(t["feature"]) for t in trees], default=1)

    def stacked(k: str, kind, empty) -> np.ndarray:
        return np.array([[*t[k], *[empty] * (size - len(t[k]))] for t in trees], kind).reshape(len(trees), size)

    feature, cut = stacked("feature", np.int64, -1), stacked("bin", np.int64, 0)
    threshold = np.array([[bounds[f][min(b, len(bounds[f]) - 1)] if f >= 0 else 0.0 for f, b in zip(fs, bs)] for fs, bs in zip(feature, cut)], float)
    share = max(len(parts), 1)
    return Ensemble(list(fit.features), sum(x[0] for x in parts) / share, feature, threshold.reshape(feature.shape), stacked("left", np.int64, 0),
                    stacked("right", np.int64, 0), stacked("value", float, 0.0) / share, stacked("gain", float, 0.0) / share, fit.target)


def fit_all(rows: DataFrame, fits: Sequence[Fit], path: str) -> dict[str, Ensemble]:
    """Grow all fits over ``rows`` (grain, sales, encoded features); binned rows and trees are stored below ``path``.

    What comes back to the driver are the models. A fit without rows fails."""
    spark = rows.sparkSession
    features, cutoffs = sorted({c for f in fits for c in f.features}), sorted({f.cutoff for f in fits})
    used = rows.where((F.col("date") <= F.lit(cutoffs[-1])) & F.col("sales").isNotNull())
    bins = bins_by_cutoff(used, features, cutoffs, min(f.parameters.max_bins for f in fits))
    binned(used, bins, cutoffs).write.mode("overwrite").parquet(f"{path}/rows")
    table = spark.read.parquet(f"{path}/rows")
    sizes = {r["cutoff_no"]: r["n"] for r in table.groupBy("cutoff_no").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < len(cutoffs):
        raise ValueError("no training rows are available up to the cutoff")
    shards = {i: max(LEAST_SHARDS, -(-n // SHARD_ROWS)) for i, n in sizes.items()}
    grown(table, bins[0], list(fits), cutoffs, shards).write.mode("overwrite").parquet(f"{path}/trees")
    parts: dict[str, list] = {f.name: [] for f in fits}
    for r in spark.read.parquet(f"{path}/trees").orderBy("fit", "shard").toLocalIterator():
        parts[r["fit"]].append((r["base"], r["rows"], json.loads(r["trees"])))
    return {f.name: ensemble(f, parts[f.name], bins[cutoffs.index(f.cutoff)]) for f in fits}


# ---------------------------------------------------------------- stored fits

_STORED = "fit string, features array<string>, base double, target string, trees string"
_ARRAYS = ("feature", "threshold", "left", "right", "value", "gain")


def write_models(spark: SparkSession, models: dict[str, Ensemble], path: str, mode: str = "overwrite") -> None:
    """One row per model."""
    rows = [(name, m.features, m.base, m.target, json.dumps({k: getattr(m, k).tolist() for k in _ARRAYS})) for name, m in models.items()]
    spark.createDataFrame(rows, _STORED).coalesce(1).write.mode(mode).parquet(path)


def read_models(spark: SparkSession, path: str, names: Sequence[str] | None = None) -> dict[str, Ensemble]:
    """The models stored below ``path`` (only those of ``names``); nothing where nothing has been stored."""
    if not path_exists(spark, path):
        return {}
    stored = spark.read.schema(_STORED).parquet(path)
    out = {}
    for r in (stored if names is None else stored.where(F.col("fit").isin(list(names)))).toLocalIterator():
        values = json.loads(r["trees"])
        shape = (len(values["feature"]), -1) if values["feature"] else (0, 1)
        arrays = [np.array(values[k], float if k in ("threshold", "value", "gain") else np.int64).reshape(shape) for k in _ARRAYS]
        out[r["fit"]] = Ensemble(list(r["features"]), r["base"], *arrays, r["target"])
    return out


def table_version(rows: DataFrame) -> str:
    """Fingerprint of a table's rows and columns, whatever their order: one pass, combined by tasks."""
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*sorted(rows.columns)).cast("decimal(38,0)")).alias("s")).first()
    return hashlib.sha256(json.dumps([sorted(rows.columns), found["n"], str(found["s"])]).encode()).hexdigest()[:24]


def fitted(rows: DataFrame, fits: Sequence[Fit]) -> dict[str, Ensemble]:
    """All fits over ``rows``: those that were grown before on the same rows with the same settings are read, the others grown and stored.

    The key of a stored fit is the fingerprint of rows, cutoff, settings, features and target, so jobs of other sessions find it."""
    spark = rows.sparkSession
    folder, version = f"{shared_folder(spark)}/shelfcast-fits", table_version(rows)
    keys = {f.name: hashlib.sha256(f"{version} {METHOD} {SHARD_ROWS} {LEAST_SHARDS} {f.text()}".encode()).hexdigest() for f in fits}
    known = read_models(spark, f"{folder}/models", sorted(set(keys.values())))
    open_fits = {keys[f.name]: f for f in fits if keys[f.name] not in known}
    if open_fits:
        named = [replace(f, name=key) for key, f in open_fits.items()]
        label = hashlib.sha256("".join(sorted(open_fits)).encode()).hexdigest()[:24]
        made = fit_all(rows, named, f"{folder}/runs/{label}")
        write_models(spark, made, f"{folder}/models", "append")
        known |= made
    return {name: known[key] for name, key in keys.items()}
