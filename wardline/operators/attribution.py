"""Per-event feature attribution: interventional Shapley values of the forest's mean path length.

For one event, one background row and one leaf, let A be the path features only the event meets
and B those only the background row meets. If some path feature is met by neither, the leaf adds
nothing; otherwise a member of A gets +(|A|-1)!|B|!/(|A|+|B|)! of the leaf's path length and a
member of B the same with opposite sign and roles (Lundberg et al., Nature MI 2020). Averaged over
the background, the values of an event add up to its mean path length minus the background's.
Negative values push towards "anomalous".
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from wardline.functions.numeric import round_to
from wardline.operators.forest import Forest, seeded_sample

TOP = 3
BACKGROUND = 50
ROWS_AT_ONCE = 2_048  # rows that go through a tree together
BLOCK_CODES = 2_048  # ways in which a row can lie towards the leaves of one block


def leaf_table(model: dict) -> dict:
    """Every leaf with the interval (low, high] each of its path features must lie in, and the trees' blocks."""
    feats, lows, highs, values = [], [], [], []
    for root in model["roots"]:
        stack = [(int(root), {})]
        while stack:
            at, box = stack.pop()
            if model["is_leaf"][at]:
                feats.append(list(box))
                lows.append([b[0] for b in box.values()])
                highs.append([b[1] for b in box.values()])
                values.append(model["path"][at])
                continue
            f, cut, left = int(model["feature"][at]), model["threshold"][at], int(model["left"][at])
            lo, hi = box.get(f, (-math.inf, math.inf))
            stack.append((left, {**box, f: (lo, min(hi, cut))}))
            stack.append((left + 1, {**box, f: (max(lo, cut), hi)}))
    width, inner = max(1, max(map(len, feats))), ~model["is_leaf"]
    pad = lambda rows, fill: np.array([r + [fill] * (width - len(r)) for r in rows])
    table = {
        "feature": pad(feats, 0).astype(np.int64),
        "low": pad(lows, -math.inf).astype(float),
        "high": pad(highs, math.inf).astype(float),
        "value": np.array(values) / len(model["roots"]),
        "width": width,
        "cuts": {int(f): np.unique(model["threshold"][inner & (model["feature"] == f)]) for f in np.unique(model["feature"][inner])},
        "trees": [],
    }
    leaf = 0
    for root in model["roots"]:
        blocks = _blocks(model, int(root))
        if blocks[0][0] or blocks[0][1]:  # else the tree is a single leaf
            table["trees"].append(_tree_codes(blocks, table["cuts"], leaf))
        leaf += sum(b[3] for b in blocks)
    return table


def _blocks(model: dict, root: int) -> list[tuple[dict, dict, int, int]]:
    """The tree cut into subtrees towards which a row can lie in at most ``BLOCK_CODES`` ways, or single leaves.

    Each block is (cuts inside it by feature, box of its path, ways, leaves), in the order of the leaves.
    """
    inside: dict[int, tuple[dict, int]] = {}

    def below(at: int) -> tuple[dict, int]:
        if at not in inside:
            cuts: dict[int, set] = {}
            leaves = 1
            if not model["is_leaf"][at]:
                left = int(model["left"][at])
                parts = below(left), below(left + 1)
                for f, some in [x for part in parts for x in part[0].items()]:
                    cuts.setdefault(f, set()).update(some)
                cuts.setdefault(int(model["feature"][at]), set()).add(float(model["threshold"][at]))
                leaves = parts[0][1] + parts[1][1]
            inside[at] = cuts, leaves
        return inside[at]

    found, stack = [], [(root, {})]
    while stack:
        at, box = stack.pop()
        cuts, leaves = below(at)
        ways = math.prod(len(cuts.get(f, ())) + 1 + (f in box) for f in {*cuts, *box})
        if ways <= BLOCK_CODES or leaves == 1:
            found.append((cuts, box, ways, leaves))
            continue
        f, cut, left = int(model["feature"][at]), float(model["threshold"][at]), int(model["left"][at])
        lo, hi = box.get(f, (-math.inf, math.inf))
        stack.append((left, {**box, f: (lo, min(hi, cut))}))
        stack.append((left + 1, {**box, f: (max(lo, cut), hi)}))
    return found


def _tree_codes(blocks: list[tuple], cuts: dict[int, np.ndarray], leaf: int) -> dict:
    """How to add up a row's code in each block of a tree from its features' places among the forest's cuts.

    Towards a block a feature is either outside its path's interval or between two cuts inside the block.
    """
    features = sorted({f for inside, box, *_ in blocks for f in (*inside, *box)})
    first = np.cumsum([0] + [ways for *_, ways, _ in blocks])
    stride = [1] * len(blocks)
    steps = []
    for f in features:
        # a row at place r lies in (cuts[r - 1], cuts[r]]; only the tree's own cuts make a difference
        own = np.unique([c for inside, box, *_ in blocks for c in (*inside.get(f, ()), *box.get(f, ())) if np.isfinite(c)])
        upper = np.append(own, math.inf)
        digits = np.zeros((len(upper), len(blocks)), np.int32)
        for b, (inside, box, *_) in enumerate(blocks):
            if f not in inside and f not in box:
                continue
            digit = np.searchsorted(np.sort(list(inside.get(f, ()))), upper)
            if f in box:
                low, high = box[f]
                digit = np.where((upper > low) & (upper <= high), digit + 1, 0)
            digits[:, b] = digit * stride[b]
            stride[b] *= len(inside.get(f, ())) + 1 + (f in box)
        steps.append((f, np.searchsorted(own, np.append(cuts[f], math.inf)), digits))
    return {
        "features": np.array(features),
        "steps": steps,
        "first": first.astype(np.int32),
        "leaves": leaf + np.cumsum([0] + [n for *_, n in blocks]),
    }


def met_bits(z: np.ndarray, leaves: dict) -> np.ndarray:
    """For each row and leaf, a bit mask of the path features whose interval the row lies in."""
    kind = np.uint8 if leaves["width"] <= 8 else np.uint32
    out = np.zeros((len(z), len(leaves["value"])), dtype=kind)
    for j in range(leaves["width"]):
        v = z[:, leaves["feature"][:, j]]
        met = (v > leaves["low"][:, j]) & (v <= leaves["high"][:, j])
        out |= met.astype(kind) << kind(j)
    return out


def background_masks(met: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (leaf, mask) pairs over the background rows, each with its share of the rows."""
    leaf = np.broadcast_to(np.arange(met.shape[1], dtype=np.int64), met.shape)
    keys, counts = np.unique((leaf << 32) | met.astype(np.int64), return_counts=True)
    masks = (keys & 0xFFFFFFFF).astype(met.dtype)
    return keys >> 32, masks, counts / len(met)


def shapley_weights(width: int) -> np.ndarray:
    """weights[a, b] = (a-1)! b! / (a+b)!, zero for a = 0."""
    f = [math.factorial(i) for i in range(2 * width + 2)]
    return np.array(
        [[f[a - 1] * f[b] / f[a + b] if a else 0.0 for b in range(width + 1)] for a in range(width + 1)]
    )


class LeafValues:
    """What the leaves of each block add to the features, by the code of a row; worked out once per block and code.

    Memory is bounded by the model: at most ``BLOCK_CODES`` codes for each block.
    """

    def __init__(self, background: tuple, leaves: dict):
        self.leaves, (self.leaf_of, self.mask_of, self.share_of) = leaves, background
        width, n = leaves["width"], len(leaves["value"])
        self.weights = shapley_weights(width)
        self.set_bits = np.array([bin(m).count("1") for m in range(1 << width)], dtype=np.int64)
        self.first = np.searchsorted(self.leaf_of, np.arange(n + 1))  # background masks lie by leaf
        self.place = [np.full(t["first"][-1], -1, np.int32) for t in leaves["trees"]]  # row of ``values`` by code
        self.values = [np.zeros((1, len(t["features"]))) for t in leaves["trees"]]

    def of_leaves(self, codes: np.ndarray) -> np.ndarray:
        """Values of distinct codes (leaf << width | mask): the sum over the background masks of the leaf."""
        width = self.leaves["width"]
        leaf, mask = codes >> width, (codes & ((1 << width) - 1)).astype(self.mask_of.dtype)
        n = self.first[leaf + 1] - self.first[leaf]
        one = np.repeat(np.arange(len(codes)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[leaf], n)
        x, b = mask[one], self.mask_of[at]
        covered = (x | b) == (1 << width) - 1
        one, at, x, b = one[covered], at[covered], x[covered], b[covered]
        only_x, only_b = x & ~b, b & ~x
        n_x, n_b = self.set_bits[only_x], self.set_bits[only_b]
        value = self.leaves["value"][leaf[one]] * self.share_of[at]
        gain, loss = self.weights[n_x, n_b] * value, self.weights[n_b, n_x] * value
        return np.stack(
            [np.bincount(one, gain * (only_x >> j & 1) - loss * (only_b >> j & 1), len(codes)) for j in range(width)],
            axis=1,
        )

    def learn(self, tree: int, z: np.ndarray, codes: np.ndarray) -> None:
        """Values of the codes of a tree's blocks that are new among those of the rows ``z``."""
        shape, leaves = self.leaves["trees"][tree], self.leaves
        new, at = np.unique(np.where(self.place[tree][codes] < 0, codes, -1), return_index=True)
        new, at = new[new >= 0], at[new >= 0]
        row, block = np.divmod(at, codes.shape[1])
        n = shape["leaves"][block + 1] - shape["leaves"][block]
        one = np.repeat(np.arange(len(new)), n)
        leaf = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(shape["leaves"][block], n)
        v = z[row[one][:, None], leaves["feature"][leaf]]
        met = (v > leaves["low"][leaf]) & (v <= leaves["high"][leaf])
        masks = met @ (1 << np.arange(leaves["width"], dtype=np.int64))
        known, back = np.unique((leaf << leaves["width"]) | masks, return_inverse=True)
        own = np.searchsorted(shape["features"], leaves["feature"][leaf])
        own = np.minimum(own, len(shape["features"]) - 1)  # padding adds nothing, whatever feature it names
        target = one[:, None] * len(shape["features"]) + own
        found = np.bincount(target.ravel(), self.of_leaves(known)[back].ravel(), len(new) * len(shape["features"]))
        self.place[tree][new] = np.arange(len(new)) + len(self.values[tree])
        self.values[tree] = np.concatenate([self.values[tree], found.reshape(len(new), -1)])

    def sums(self, z: np.ndarray) -> np.ndarray:
        out = np.zeros(z.shape)
        for lo in range(0, len(z), ROWS_AT_ONCE):
            part = z[lo : lo + ROWS_AT_ONCE]
            places = {f: np.searchsorted(cuts, part[:, f]) for f, cuts in self.leaves["cuts"].items()}
            for t, shape in enumerate(self.leaves["trees"]):
                codes = np.repeat(shape["first"][None, :-1], len(part), axis=0)
                for f, own, digits in shape["steps"]:
                    codes += digits.take(own.take(places[f]), axis=0)
                if (self.place[t].take(codes) < 0).any():
                    self.learn(t, part, codes)
                place = self.place[t].take(codes.T)
                total = self.values[t].take(place[0], axis=0)
                for one in place[1:]:
                    total += self.values[t].take(one, axis=0)
                out[lo : lo + len(part), shape["features"]] += total
        return out


def attribute_rows(z: np.ndarray, background: tuple, leaves: dict) -> np.ndarray:
    """Attributions of standardised rows against the distinct leaf masks of the background."""
    return LeafValues(background, leaves).sums(z)


def background_rows(df: DataFrame, forest: Forest, id_col: str, n: int) -> np.ndarray:
    """At most ``n`` seeded rows of the training table, on the driver (n is a small constant)."""
    rows = seeded_sample(df.select(id_col, *forest.features), id_col, n, forest.seed)
    return rows.select(*forest.features).toPandas().to_numpy(float)


_kept: dict[str, LeafValues] = {}


def values_of(name: str, background: tuple, leaves: dict) -> LeafValues:
    """The values of the forest explained last; a Python worker keeps what it has learnt from task to task."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = LeafValues(background, leaves)
    return _kept[name]


def attribution(forest: Forest, background: np.ndarray) -> Column:
    """array<double>, one value per feature in model order."""
    model = forest.arrays()
    leaves = leaf_table(model)
    masks = background_masks(met_bits((background - model["mean"]) / model["std"], leaves))
    shared, name = forest.spark.sparkContext.broadcast((model["mean"], model["std"], leaves, masks)), uuid.uuid4().hex

    @F.pandas_udf("array<double>")
    def attribute(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        mean, std, table, masks = shared.value
        values = values_of(name, masks, table)
        for cols in batches:
            x = np.column_stack([c.to_numpy(float) for c in cols])
            yield pd.Series(list(values.sums((x - mean) / std)))

    # a filter inferred from what is done with the array would else run the function a second time, before the shuffle
    return attribute.asNondeterministic()(*[F.col(f) for f in forest.features])


def explain(flagged: DataFrame, forest: Forest, background: np.ndarray) -> DataFrame:
    """Add ``attribution``: (feature, shap_value, event_value) for every feature, model order.

    Filter and limit before calling this: neither is pushed through an Arrow stage. Few rows cost
    much work here, so they are spread over all cores by a fixed partition count, which adaptive
    execution does not merge again.
    """
    cores = forest.spark.sparkContext.defaultParallelism
    values = flagged.repartition(cores, "access_id").withColumn("_phi", attribution(forest, background))
    entries = [
        F.struct(
            F.lit(f).alias("feature"),
            round_to(F.get(F.col("_phi"), F.lit(i)), 6).alias("shap_value"),
            round_to(F.col(f).cast("double"), 4).alias("event_value"),
        )
        for i, f in enumerate(forest.features)
    ]
    return values.withColumn("attribution", F.array(*entries)).drop("_phi")


def top_features(attribution: Column, n: int = TOP) -> Column:
    """The ``n`` entries of largest absolute value, ties in the order of the array."""
    ranked = F.transform(
        attribution,
        lambda e, i: F.struct((-F.abs(e["shap_value"])).alias("k"), i.alias("i"), e.alias("e")),
    )
    return F.transform(F.slice(F.array_sort(ranked), 1, n), lambda r: r["e"])


def global_importance(explained: DataFrame) -> DataFrame:
    """Mean absolute attribution per feature, ranked, with a mark for those above the median.

    Median and list are over features: one row each, a handful in all.
    """
    means = (
        explained.select(F.inline("attribution"))
        .groupBy("feature")
        .agg(F.avg(F.abs("shap_value")).alias("importance"))
    )
    gathered = means.agg(
        F.percentile("importance", 0.5).alias("_median"),
        F.collect_list(F.struct("feature", "importance")).alias("_rows"),
    )
    return gathered.select("_median", F.inline("_rows")).select(
        "feature", "importance", (F.col("importance") > F.col("_median")).alias("above_median")
    ).orderBy(F.desc("importance"), "feature")
