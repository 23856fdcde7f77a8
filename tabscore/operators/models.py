"""Model families and the suite that fits and applies them side by side.

Spark's own boosted trees are level-wise, for numbers and two classes. Joint softmax for several
classes and leaf-wise trees are in ``boosting``.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscore.operators.boosting import Booster, leaf_wise, level_wise
from tabscore.operators.forest import Forest
from tabscore.session import materialize

SEED = 42
# Names of the two boosted profiles in results.
BOOSTED, BOOSTED_ALT = "BoostedTrees", "BoostedTreesLargeLeaves"
# Candidate split points of a numeric feature.
BINS = 256
# Partitions that a fit reads: bagging and bins depend on how rows are dealt, so the number is stated.
FIT_PARTITIONS = 32
# The deepest tree Spark grows; the usual default elsewhere is unlimited.
MAX_DEPTH = 30
# Members of a suite that are fitted at the same time.
PARALLEL_FITS = 4
# Different rows, and their share of all rows, up to which a fit reads each once with its count; different rows of a partition then.
CELLS, CELLS_SHARE, CELLS_EACH = 1 << 16, 0.5, 1 << 12
COUNT = "__rows"


def forest_regressor(trees: int = 200, depth: int = MAX_DEPTH, seed: int = SEED) -> RandomForestRegressor:
    return RandomForestRegressor(maxBins=BINS, numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="all")


def forest_classifier(trees: int = 100, depth: int = MAX_DEPTH, seed: int = SEED) -> RandomForestClassifier:
    return RandomForestClassifier(maxBins=BINS, numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt")


def deep_forest(trees: int = 100, depth: int = MAX_DEPTH, seed: int = SEED) -> Forest:
    """The same forest for many classes and nodes: small nodes are finished where their rows are."""
    return Forest(trees, depth, BINS, seed)


def boosted_regressor(rounds: int = 200, depth: int = 6, rate: float = 0.3, seed: int = SEED) -> GBTRegressor:
    return GBTRegressor(maxBins=BINS, maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed, featureSubsetStrategy="all")


def boosted_regressor_alt(rounds: int = 200, depth: int = 5, rate: float = 0.1, seed: int = SEED) -> GBTRegressor:
    """Second boosted profile: smaller steps, larger leaves."""
    return GBTRegressor(
        maxBins=BINS, maxIter=rounds, maxDepth=depth, stepSize=rate, minInstancesPerNode=20, seed=seed, featureSubsetStrategy="all"
    )


def boosted_classifier(
    rounds: int = 200, depth: int = 6, rate: float = 0.1, rows: float = 1.0, columns: str = "all", seed: int = SEED
) -> GBTClassifier:
    return GBTClassifier(
        maxBins=BINS, maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=rows, featureSubsetStrategy=columns, seed=seed
    )


def boosted_classifier_alt(rounds: int = 200, depth: int = 6, rate: float = 0.1, seed: int = SEED) -> GBTClassifier:
    return GBTClassifier(
        maxBins=BINS, maxIter=rounds, maxDepth=depth, stepSize=rate, minInstancesPerNode=20, seed=seed, featureSubsetStrategy="all"
    )


def boosted_classes(
    classes: int, rounds: int = 200, depth: int = 6, rate: float = 0.1, rows: float = 1.0, columns: float = 1.0, seed: int = SEED
) -> Booster:
    """Level-wise trees for any number of classes: one softmax, a tree per class and round."""
    return level_wise(classes, rounds, rate, depth, rows, columns, seed)


def leaf_wise_trees(classes: int = 0, rounds: int = 200, depth: int | None = None, rate: float = 0.1, seed: int = SEED) -> Booster:
    """Leaf-wise trees of up to 31 leaves, for numbers (0 classes) or classes."""
    return leaf_wise(classes, rounds, rate, 31, depth, seed)


def per_class(binary: GBTClassifier, parallelism: int = 2) -> OneVsRest:
    """Boosted trees for any number of classes: one binary model per class."""
    return OneVsRest(classifier=binary, parallelism=parallelism)


def logistic(rows: int, max_iter: int = 100, c: float = 1.0, family: str = "auto") -> LogisticRegression:
    """L2 with strength ``c``: the penalty is 1 / (c * rows), since Spark averages the loss."""
    return LogisticRegression(
        maxIter=max_iter, regParam=1.0 / (c * max(rows, 1)), elasticNetParam=0.0, standardization=False, family=family
    )


@dataclass
class Member:
    """One model of a suite.

    ``make`` gets the number of train rows and returns an unfitted estimator.
    ``target`` is the column it learns and ``decode`` turns its prediction into
    the scale of ``y``.
    """

    name: str
    make: Callable[[int], Estimator]
    features: str = "features"
    target: str = "y"
    decode: Callable[[Column], Column] | None = None


def reads_cells(est: Estimator) -> str | None:
    """Whether rows that agree may be one row with a count: ``same`` in features and target, ``means`` in features alone with their mean target.

    Sums of gradients and counts stay the same then. With squared errors a split's gain holds means and counts of the sides alone.
    A fit that draws rows, or that bounds the rows of a leaf otherwise than by counts, reads each row.
    """
    if isinstance(est, Booster):
        return None if est.growth.rows < 1 else "same" if est.growth.classes else "means"
    if isinstance(est, LogisticRegression):
        return None if est.isDefined("weightCol") else "same"
    if isinstance(est, (RandomForestClassifier, RandomForestRegressor, GBTRegressor)):
        draws = est.getSubsamplingRate() < 1 or (not isinstance(est, GBTRegressor) and est.getBootstrap())
        other = est.isDefined("weightCol") or est.getMinInstancesPerNode() > 1 or est.getMinInfoGain() > 0
        if draws or other or (isinstance(est, GBTRegressor) and (est.getLossType() != "squared" or est.isDefined("validationIndicatorCol"))):
            return None
        return "same" if isinstance(est, RandomForestClassifier) else "means"
    return None


Way = tuple[str, str, str]


def _way(m: Member, train: DataFrame) -> Way | None:
    """Kind, features and target of the cells that a member can be fitted on."""
    try:
        kind = reads_cells(m.make(1))
    except Exception:  # noqa: BLE001 - noted when the member is fitted
        return None
    return (kind, m.features, m.target) if kind and {m.features, m.target} <= set(train.columns) else None


def _cell(way: Way) -> Column:
    kind, features, target = way
    return F.xxhash64(F.unwrap_udt(features), *([F.col(target)] if kind == "same" else []))


def _cells(train: DataFrame, way: Way, different: int) -> DataFrame:
    """The different rows with their counts, in an order that depends on the rows alone."""
    kind, features, target = way
    if kind == "same":
        cells = train.groupBy(features, target).agg(F.count("*").alias(COUNT))
    else:
        cells = train.groupBy(features).agg(F.avg(F.col(target).cast("double")).alias(target), F.count("*").alias(COUNT))
    return cells.repartition(-(-different // CELLS_EACH) or 1, _cell(way)).sortWithinPartitions(_cell(way), target)


@dataclass
class Suite:
    members: list[Member]
    partitions: int = FIT_PARTITIONS
    fitted: dict[str, Model] = field(default_factory=dict)
    failures: dict[str, str] = field(default_factory=dict)
    # Vector columns of which the fit met few different ones.
    repeated: set[str] = field(default_factory=set)

    def fit(self, train: DataFrame, key: str | None = None) -> "Suite":
        """Fit all members on the same rows, some at a time; a failing one is noted and left out.

        With a ``key`` the rows are dealt by it to a stated number of partitions and
        sorted there, so that the models do not depend on files or cores.
        """
        spark, kept = train.sparkSession, []

        def keep(df: DataFrame) -> DataFrame:
            kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
            return df

        def dealt() -> DataFrame:
            return keep(train if key is None else train.repartition(self.partitions, key).sortWithinPartitions(key))

        try:
            # How each member reads its rows; one that can not be made fails in its fit.
            ways = {m.name: _way(m, train) for m in self.members}
            rows_of = None if all(ways.values()) else dealt()
            counted = train if rows_of is None else rows_of
            sets = {w: F.approx_count_distinct(_cell(w)) for w in ways.values() if w}
            valid = {t: F.count(F.nanvl(F.col(t).cast("double"), F.lit(None))) for t in {t for _, _, t in sets}}
            told = counted.agg(F.count("*"), *sets.values(), *valid.values()).first()
            rows, different = told[0], dict(zip(sets, told[1:]))
            whole = {t for t, n in zip(valid, told[1 + len(sets) :]) if n == rows}
            few = {w: n for w, n in different.items() if n <= min(CELLS, CELLS_SHARE * rows) and w[2] in whole}
            cells = {w: keep(_cells(counted, w, n)) for w, n in few.items()}
            self.repeated |= {w[1] for w in few}
            if rows_of is None and not all(w in cells for w in ways.values()):
                rows_of = dealt()

            def one(m: Member) -> Model | str:
                # With fair scheduling each member has a pool of its own; else jobs share the cores as they come.
                spark.sparkContext.setLocalProperty("spark.scheduler.pool", m.name)
                try:
                    est = m.make(rows).setFeaturesCol(m.features).setLabelCol(m.target)
                    found = cells.get(ways[m.name])
                    return est.fit(rows_of) if found is None else est.setWeightCol(COUNT).fit(found)
                except MemoryError:
                    raise
                except Exception as e:  # noqa: BLE001 - one model must not end the job
                    if "OutOfMemoryError" in str(e):
                        raise
                    return str(e).splitlines()[0] if str(e) else type(e).__name__

            with ThreadPoolExecutor(PARALLEL_FITS) as pool:
                waiting = [pool.submit(inheritable_thread_target(spark)(one), m) for m in self.members]
                for m, found in zip(self.members, [w.result() for w in waiting]):
                    if isinstance(found, str):
                        self.failures[m.name] = found
                    else:
                        self.fitted[m.name] = found
        finally:
            for df in kept:
                df.unpersist()
        return self

    @property
    def names(self) -> list[str]:
        return [m.name for m in self.members if m.name in self.fitted]

    def predict_wide(self, test: DataFrame) -> DataFrame:
        """Append one prediction column per fitted member, in one pass over the rows; vectors that repeat are scored once."""
        out = test
        for vector in dict.fromkeys(m.features for m in self.members if m.name in self.fitted):
            cells = self._vectors(test, vector) if vector in self.repeated else None
            if cells is None:
                out = self._scored(out, vector)
            else:
                scored = self._scored(cells, vector).withColumn("__vector", F.unwrap_udt(vector)).drop(vector)
                out = out.join(F.broadcast(scored), F.unwrap_udt(out[vector]).eqNullSafe(scored["__vector"]), "left").drop("__vector")
        return out.select(*test.columns, *self.names)

    def _vectors(self, test: DataFrame, vector: str) -> DataFrame | None:
        """The different vectors, if they are few."""
        cells = materialize(test.select(vector).distinct().limit(CELLS + 1), "vectors")
        return cells if cells.count() <= CELLS else None

    def _scored(self, out: DataFrame, vector: str) -> DataFrame:
        for m in self.members:
            if m.name not in self.fitted or m.features != vector:
                continue
            out = apply_model(self.fitted[m.name], out, m.name)
            if m.decode is not None:
                out = out.withColumn(m.name, m.decode(F.col(m.name)))
        return out

    def predict(self, test: DataFrame, keep: list[str]) -> DataFrame:
        """Long predictions: the kept columns, ``model`` and ``pred``."""
        wide = self.predict_wide(test).select(*keep, *self.names)
        return wide.unpivot(keep, self.names, "model", "pred")

    def failure_table(self, spark) -> DataFrame:
        return spark.createDataFrame(list(self.failures.items()), "model string, error string")


def apply_model(model: Model, df: DataFrame, out: str) -> DataFrame:
    """Append the prediction alone, as ``out``."""
    scored = model.transform(df)
    extra = [c for c in scored.columns if c not in df.columns and c != "prediction"]
    return scored.drop(*extra).withColumnRenamed("prediction", out)


def boosted_for(classes: int, binary: GBTClassifier) -> Estimator:
    return binary if classes <= 2 else per_class(binary)
