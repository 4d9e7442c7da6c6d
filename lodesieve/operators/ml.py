"""Trained match models on Spark MLlib: pair synthesis, split by entity, fit, calibration, voting, persistence."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import similarity as sim

FEATURES = ("token_sort", "token_set", "wratio", "jaro_winkler", "len_ratio", "token_gap")


def split_of(key: str, seed: int = 7, parts: int = 4):
    """0..parts-1 by a hash of the entity: all pairs of an entity fall on one side."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(parts)).cast("int")


def noisy(c: str, seed: int, *salt: str):
    """A spelling mistake placed by a hash of the row: a letter dropped, doubled, or two swapped."""
    n, h = F.length(c), F.pmod(F.xxhash64(c, F.lit(seed), *salt), F.lit(1 << 20))
    at = (h % F.greatest(n - 2, F.lit(1))).cast("int") + 2
    head, ch, rest = F.substring(F.col(c), F.lit(1), at - 1), F.substring(F.col(c), at, F.lit(1)), F.substring(F.col(c), at + 1, n)
    swap = F.concat(F.substring(F.col(c), F.lit(1), at - 2), ch, F.substring(F.col(c), at - 1, F.lit(1)), rest)
    kind = h % 3
    return F.when(n < 4, F.col(c)).when(kind == 0, F.concat(head, rest)).when(kind == 1, F.concat(head, ch, ch, rest)).otherwise(swap)


def shuffled(c: str):
    """Words in another order."""
    w = F.split(c, " ")
    return F.when(F.size(w) > 1, F.array_join(F.concat(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(1))), F.slice(w, 1, 1)), " ")).otherwise(F.col(c))


def training_pairs(names: DataFrame, recalled: DataFrame, seed: int = 7) -> DataFrame:
    """(entity_id, query, candidate, label): two positives per entity (misspelt, reordered), the best recalled other
    entity as hard negative, and for a quarter of the entities another entity's name as easy one.

    ``names``: (entity_id, name); ``recalled``: (query_id, entity_id, rank) with query_id an entity of ``names``."""
    pos = names.select("entity_id", F.explode(F.array(noisy("name", seed, "entity_id"), shuffled("name"))).alias("query"), F.col("name").alias("candidate"), F.lit(1).alias("label"))
    hard = recalled.where("query_id <> entity_id").groupBy("query_id").agg(F.min_by("entity_id", F.struct("rank", "entity_id")).alias("other"))
    other = names.select(F.col("entity_id").alias("other"), F.col("name").alias("candidate"))
    hard = names.join(hard, names["entity_id"] == hard["query_id"]).join(other, "other").select("entity_id", noisy("name", seed + 1, "entity_id").alias("query"), "candidate", F.lit(0).alias("label"))
    # easy negatives: each entity meets the one that shares its bucket of a second hash, an equi-join of few per bucket
    n = max(1, names.count())
    slot = lambda s: F.pmod(F.xxhash64("entity_id", F.lit(s)), F.lit(n))
    a = names.where(split_of("entity_id", seed + 2) == 0).select("entity_id", F.col("name").alias("query"), slot(seed + 3).alias("slot"))
    b = names.select(F.col("entity_id").alias("other"), F.col("name").alias("candidate"), slot(seed + 4).alias("slot"))
    easy = a.join(b, "slot").where("entity_id <> other").select("entity_id", "query", "candidate", F.lit(0).alias("label"))
    return pos.unionByName(hard).unionByName(easy)


def with_features(pairs: DataFrame) -> DataFrame:
    q, c = "query", "candidate"
    ln = F.length(q), F.length(c)
    return pairs.withColumns({
        "token_sort": sim.token_sort_ratio(q, c), "token_set": sim.token_set_ratio(q, c), "wratio": sim.weighted_ratio(q, c), "jaro_winkler": 100 * sim.jaro_winkler(q, c),
        "len_ratio": F.least(*ln) / F.greatest(*ln, F.lit(1)), "token_gap": F.abs(F.size(F.split(q, " ")) - F.size(F.split(c, " "))).cast("double"),
    })


def fit(train: DataFrame, kind: str = "logistic", columns: Sequence[str] = FEATURES) -> PipelineModel:
    """Scaled, class-balanced logistic regression, boosted trees, or a forest."""
    share = train.agg(F.avg("label").alias("p")).first().p or 0.5
    weighted = train.withColumn("weight", F.when(F.col("label") == 1, 0.5 / max(share, 1e-6)).otherwise(0.5 / max(1 - share, 1e-6)))
    stages = [VectorAssembler(inputCols=list(columns), outputCol="raw_features", handleInvalid="keep"), StandardScaler(inputCol="raw_features", outputCol="features")]
    last = {
        "logistic": lambda: LogisticRegression(labelCol="label", weightCol="weight", maxIter=30), "trees": lambda: GBTClassifier(labelCol="label", weightCol="weight", maxIter=15, maxDepth=4, seed=7),
        "forest": lambda: RandomForestClassifier(labelCol="label", weightCol="weight", numTrees=30, maxDepth=6, seed=7),
    }[kind]()
    return Pipeline(stages=[*stages, last]).fit(weighted)


def scores(model: PipelineModel, rows: DataFrame, name: str) -> DataFrame:
    out = model.transform(rows).withColumn(name, vector_to_array("probability")[1])
    return out.drop("raw_features", "features", "rawPrediction", "probability", "prediction")


def calibrator(held: DataFrame, column: str):
    """Isotonic regression of the label on the score of rows that weren't fitted on."""
    return IsotonicRegression(featuresCol=column, labelCol="label", predictionCol=f"{column}_calibrated").fit(held)


def soft_vote(rows: DataFrame, columns: Sequence[str], name: str = "prob") -> DataFrame:
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    return rows.withColumn(name, total / len(columns))


def save(model: PipelineModel, path: str, facts: dict) -> None:
    model.write().overwrite().save(f"{path}/model")
    SparkSession.getActiveSession().createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")


def load(spark, path: str) -> tuple[PipelineModel, dict]:
    return PipelineModel.load(f"{path}/model"), json.loads(spark.read.text(f"{path}/facts").first().value)


# ---- training of the payment model on all features of a pair


def training_queries(vs: DataFrame, entities: DataFrame, df: DataFrame, seed: int = 7) -> DataFrame:
    """(owner, kind, query_norm, country): what payers might type.

    ``alias``: an alias of the owner; ``slip``: a misspelt variant of it; ``bait``: two usual words of different names, which
    collide with many entities and denote none; ``clean``: the first word of one name with the last of another. Countries
    are the owner's for part of the positives, anything or nothing for the rest, so that a country is no gate. Everything is
    chosen by hashes of the keys, so a repetition gives the same rows."""
    h = lambda *s: F.pmod(F.xxhash64("entity_id", *[F.lit(x) for x in s], F.lit(seed)), F.lit(1000))
    own = entities.select("entity_id", F.try_element_at(F.coalesce("countries", F.array().cast("array<string>")), F.lit(1)).alias("own"))
    pool = F.array(*[F.lit(c) for c in ("us", "gb", "de", "fr", "ng", "in", "br", "jp", "ae", "sg", "za", "mx")])
    any_ = F.element_at(pool, (F.pmod(F.xxhash64("entity_id", F.lit("c"), F.lit(seed)), F.lit(12)) + 1).cast("int"))
    country = F.when(F.col("own").isNotNull() & (h("p") < 450), F.col("own")).when(h("p") < 850, any_).otherwise(F.lit(""))
    pick = lambda where, salt: vs.where(where).groupBy("entity_id").agg(F.min_by("variant_norm", F.xxhash64("variant_norm", F.lit(salt), F.lit(seed))).alias("v"))
    alias = pick("not is_primary", "a").select("entity_id", F.lit("alias").alias("kind"), F.col("v").alias("query_norm"))
    slip = pick("true", "s").select("entity_id", F.lit("slip").alias("kind"), noisy("v", seed, "entity_id").alias("query_norm"))
    pos = alias.unionByName(slip).join(own, "entity_id").select(F.col("entity_id").alias("owner"), "kind", "query_norm", country.alias("country"))
    # thirty usual words, each beside another: a bounded list
    usual = df.orderBy(F.col("df").desc(), "token").limit(30).withColumn("i", F.row_number().over(W.orderBy(F.col("df").desc(), "token")))
    other = usual.select(F.col("token").alias("second"), (F.pmod(F.col("i") * 7 + 3, F.lit(30)) + 1).alias("i"))
    bait = usual.join(other, "i").where("token <> second").select(F.lit(None).cast("string").alias("owner"), F.lit("bait").alias("kind"), F.concat_ws(" ", "token", "second").alias("query_norm"), F.lit("us").alias("country"))
    names = vs.where("is_primary").select("entity_id", F.split("variant_norm", " ").alias("w")).where("size(w) > 1")
    n = max(1, names.count())
    slot = lambda s: F.pmod(F.xxhash64("entity_id", F.lit(s), F.lit(seed)), F.lit(n))
    a = names.where(h("e") < 400).select(F.col("entity_id").alias("x"), F.element_at("w", 1).alias("first"), slot("l").alias("slot"))
    b = names.select(F.col("entity_id").alias("y"), F.element_at("w", -1).alias("last"), slot("r").alias("slot"))
    clean = a.join(b, "slot").where("x <> y").select(F.lit(None).cast("string").alias("owner"), F.lit("clean").alias("kind"), F.concat_ws(" ", "first", "last").alias("query_norm"), F.lit("de").alias("country"))
    return pos.unionByName(bait).unionByName(clean).where("query_norm <> ''").distinct()


def labelled(queries: DataFrame, hits: DataFrame, seed: int = 7) -> DataFrame:
    """(owner, kind, query_norm, country, entity_id, rank, label): the owner as positive; of the entities recalled for the same
    spelling the first other one as hard negative, the first six for bait, and one of the first four for clean names."""
    j = queries.join(hits, "query_norm")
    hard = j.where("owner is not null and kind = 'slip' and entity_id <> owner").groupBy("owner", "kind", "query_norm", "country").agg(F.min_by(F.struct("entity_id", "rank"), "rank").alias("b")).select("owner", "kind", "query_norm", "country", "b.*")
    bait = j.where("kind = 'bait' and rank <= 6").select(*hard.columns)
    clean = j.where("kind = 'clean' and rank <= 4").groupBy("owner", "kind", "query_norm", "country").agg(F.min_by(F.struct("entity_id", "rank"), F.xxhash64("entity_id", F.lit(seed))).alias("b")).select("owner", "kind", "query_norm", "country", "b.*")
    pos = queries.where("owner is not null").select("owner", "kind", "query_norm", "country", F.col("owner").alias("entity_id"), F.lit(1).alias("rank"), F.lit(1).alias("label"))
    return pos.unionByName(hard.unionByName(bait).unionByName(clean).withColumn("label", F.lit(0)))


MEMBERS = ("logistic", "trees", "forest")


def fit_members(rows: DataFrame, columns: Sequence[str]) -> dict:
    """Three members, each fitted on three parts of the keys and calibrated on the fourth. ``rows``: columns, label, part."""
    train, held = rows.where("part > 0"), rows.where("part = 0")
    out = {}
    for kind in MEMBERS:
        model = fit(train, kind, columns)
        out[kind] = (model, calibrator(scores(model, held, kind), kind))
    return out


def _tree(root, leaf) -> tuple[np.ndarray, ...]:
    """A fitted tree as arrays: column (-1: leaf), threshold, left, right, value."""
    rows: list[list[float]] = []

    def walk(node) -> int:
        at = len(rows)
        rows.append([-1, 0.0, at, at, 0.0])
        if node.getClass().getSimpleName() == "LeafNode":
            rows[at][4] = leaf(node)
        else:
            rows[at][:2] = node.split().featureIndex(), node.split().threshold()
            rows[at][2:4] = walk(node.leftChild()), walk(node.rightChild())
        return at

    walk(root)
    c = list(zip(*rows, strict=True))
    return tuple(np.array(x, t) for x, t in zip(c, (int, float, int, int, float), strict=True)) if rows else ()


def _share(node) -> float:
    n, y = list(node.impurityStats().stats())
    return y / (n + y)


class ArrayMember:
    """A fitted and calibrated member that takes features as arrays."""

    def __init__(self, model: PipelineModel, cal, kind: str):
        scaler, last = model.stages[1], model.stages[2]
        std = np.array(scaler.std)
        self.kind, self.columns, self.scale = kind, model.stages[0].getInputCols(), np.where(std > 0, 1 / np.where(std > 0, std, 1), 0.0)
        self.at, self.value = np.array(cal.boundaries), np.array(cal.predictions)
        if kind == "logistic":
            self.weights, self.bias = np.array(last.coefficients), last.intercept
        else:
            self.trees = [_tree(t._java_obj.rootNode() if hasattr(t, "_java_obj") else t.rootNode(), _share if kind == "forest" else lambda n: n.prediction()) for t in last.trees]
            self.shares = list(last.treeWeights)

    def score(self, f: dict[str, np.ndarray]) -> np.ndarray:
        x = np.stack([f[c] * s for c, s in zip(self.columns, self.scale, strict=True)])
        n = np.arange(x.shape[1])
        if self.kind == "logistic":
            return 1 / (1 + np.exp(-(self.weights @ x + self.bias)))
        total = np.zeros(len(n))
        for (column, bound, left, right, value), share in zip(self.trees, self.shares, strict=True):
            at = np.zeros(len(n), np.int64)
            open_ = n
            while len(open_ := open_[column[at[open_]] >= 0]):
                k = at[open_]
                at[open_] = np.where(x[column[k], open_] <= bound[k], left[k], right[k])
            total += share * value[at]
        return total / len(self.trees) if self.kind == "forest" else 1 / (1 + np.exp(-2 * total))

    def __call__(self, f: dict[str, np.ndarray]) -> np.ndarray:
        return np.interp(self.score(f), self.at, self.value)

    def most(self, f: dict[str, tuple]) -> np.ndarray:
        """No features between the two values that each of ``f`` has, and none at all of the others, give more."""
        given = [tuple(np.asarray(x, float) * s for x in f.get(c, (-np.inf, np.inf))) if s else (0.0, 0.0) for c, s in zip(self.columns, self.scale, strict=True)]
        if self.kind == "logistic":
            z = self.bias + sum(np.maximum(w * lo, w * hi) for w, (lo, hi) in zip(self.weights, given, strict=True) if w)
            return np.interp(1 / (1 + np.exp(-z)), self.at, self.value)
        total = 0.0
        for (column, bound, left, right, value), share in zip(self.trees, self.shares, strict=True):

            def best(k: int) -> np.ndarray:
                if column[k] < 0:
                    return value[k]
                lo, hi = given[column[k]]
                a, b = best(left[k]), best(right[k])
                return np.where(hi > bound[k], np.where(lo <= bound[k], np.maximum(a, b), b), a)

            total = total + share * best(0)
        return np.interp(total / len(self.trees) if self.kind == "forest" else 1 / (1 + np.exp(-2 * total)), self.at, self.value)


class ArrayVote:
    """The vote of ``vote_with`` over features as arrays. ``most`` bounds it from above: the members of trees by a table over
    bounds of features, which are rounded up to thresholds of the trees, the others by their sum. No vote is below ``least``."""

    TABLE = (("wratio", 12), ("jaro_winkler", 12), ("token_sort", 9), ("token_set", 5), ("token_coverage", 4), ("phonetic_agreement", 4))
    STEP = 400  # parts of the range of a feature

    def __init__(self, members: dict):
        self.members = [ArrayMember(model, cal, kind) for kind, (model, cal) in members.items()]
        self.least = sum(m.value[0] for m in self.members) / len(self.members)
        trees = [m for m in self.members if m.kind != "logistic"]
        self.sums = [m for m in self.members if m.kind == "logistic"]
        columns = self.members[0].columns
        self.dims = [(c, n) for c, n in self.TABLE if trees and c in columns]
        self.place, ends, stride = [], [], 1
        for c, n in self.dims:
            k = columns.index(c)
            scale = self.members[0].scale[k]
            cuts = np.unique([b / scale for m in trees for column, bound, *_ in m.trees for b in bound[column == k]]) if scale else np.zeros(0)
            cuts = cuts[np.unique(np.linspace(0, len(cuts) - 1, n - 1).round().astype(int))] if len(cuts) else cuts
            span = 1.0 if c in ("token_coverage", "phonetic_agreement") else 100.0
            self.place.append((c, self.STEP / span, np.searchsorted(cuts, np.arange(self.STEP + 2) * span / self.STEP - 1e-6) * stride))
            ends.append(np.append(cuts, np.inf))
            stride *= len(cuts) + 1
        grid = np.meshgrid(*reversed(ends), indexing="ij")
        box = {c: (-np.inf, g.ravel()) for (c, _), g in zip(self.dims, reversed(grid), strict=True)}
        self.table = np.stack([sum((m.most(box | {"is_person": (p, p)}) for m in trees), np.zeros(stride)) for p in (0.0, 1.0)])

    def __call__(self, f: dict[str, np.ndarray]) -> np.ndarray:
        return sum(m(f) for m in self.members) / len(self.members)

    def closer(self, f: dict[str, tuple]) -> np.ndarray:
        """As ``most``, by the trees themselves: dearer, and nearer."""
        return sum(m.most(f) for m in self.members) / len(self.members)

    def most(self, f: dict[str, tuple]) -> np.ndarray:
        """No features between the two values of each of ``f`` give more."""
        at = sum(where[np.minimum(np.ceil(f[c][1] * scale).astype(np.int64), self.STEP + 1)] for c, scale, where in self.place)
        return (self.table[f["is_person"][0].astype(np.int64), at] + sum(m.most(f) for m in self.sums)) / len(self.members)


def vote_with(members: dict):
    """A function that adds ``prob``, the mean of the calibrated members; its ``arrays`` gives the same from arrays."""

    def vote(rows: DataFrame) -> DataFrame:
        out = rows
        for kind, (model, cal) in members.items():
            out = cal.transform(scores(model, out, kind))
        return soft_vote(out, [f"{k}_calibrated" for k in members]).drop(*members, *[f"{k}_calibrated" for k in members])

    vote.arrays = ArrayVote(members)
    return vote
