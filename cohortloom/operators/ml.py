"""Model comparison on MLlib: folds by hash, metrics from confusion counts, tuning, ensembles, calibration."""

from __future__ import annotations

import itertools
import math
import time
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, FMClassifier, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import PCA, IndexToString, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, IsotonicRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import exact_quantiles, numeric_columns, quoted
from ..model import KEYS
from ..session import broadcast_if_small, settled
from .additive import AdditiveBoost
from .discriminant import Discriminant
from .estimators import AdaBoost, Nearest
from .shap import shap_values
from .stats import rank_auc

# Ids of candidate models; xgb and lgbm are names in use for xgboost and lightgbm.
ALIASES = {"xgb": "xgboost", "lgbm": "lightgbm"}
CANDIDATES = ("lr", "rf", "et", "gbc", "dt", "nb", "svm", "ridge", "lda", "qda", "xgboost", "lightgbm", "catboost", "mlp", "fm", "knn", "ada", "ebm")
REGRESSORS = ("lr", "ridge", "lasso", "en", "rf", "et", "gbr", "dt", "xgboost", "lightgbm", "catboost")


def classifier(name: str, n_classes: int, seed: int = 42, **params):
    """An MLlib estimator; binary-only ones are wrapped one-against-rest. Boosting libraries are stood in for by GBT."""
    name = ALIASES.get(name, name)
    made = {
        "lr": lambda: LogisticRegression(maxIter=100),
        "ridge": lambda: LogisticRegression(maxIter=100, regParam=0.1),
        "rf": lambda: RandomForestClassifier(numTrees=50, seed=seed),
        "et": lambda: RandomForestClassifier(numTrees=50, seed=seed, bootstrap=False, featureSubsetStrategy="sqrt"),
        "dt": lambda: DecisionTreeClassifier(seed=seed),
        "nb": lambda: NaiveBayes(modelType="gaussian"),
        "svm": lambda: LinearSVC(maxIter=50),
        "gbc": lambda: GBTClassifier(maxIter=20, seed=seed),
        "xgboost": lambda: GBTClassifier(maxIter=30, maxDepth=6, seed=seed),
        "lightgbm": lambda: GBTClassifier(maxIter=30, maxDepth=4, seed=seed),
        "catboost": lambda: GBTClassifier(maxIter=40, maxDepth=4, seed=seed),
        "mlp": lambda: MultilayerPerceptronClassifier(maxIter=50, seed=seed),
        "fm": lambda: FMClassifier(maxIter=20, seed=seed),
        "lda": lambda: Discriminant(),
        "qda": lambda: Discriminant(quadratic=True),
        "knn": lambda: Nearest(),
        "ada": lambda: AdaBoost(seed=seed),
        "ebm": lambda: AdditiveBoost(),
    }
    if name not in made:
        raise ValueError(f"unknown model {name}")
    model = made[name]()
    for k, v in params.items():
        model = model.copy({model.getParam(k): v})
    if name in ("svm", "gbc", "xgboost", "lightgbm", "catboost", "fm") and n_classes > 2:
        return OneVsRest(classifier=model)
    return model


def regressor(name: str, seed: int = 42):
    made = {"lr": LinearRegression(), "ridge": LinearRegression(regParam=0.1), "lasso": LinearRegression(regParam=0.1, elasticNetParam=1.0), "en": LinearRegression(regParam=0.1, elasticNetParam=0.5), "rf": RandomForestRegressor(seed=seed), "et": RandomForestRegressor(seed=seed, bootstrap=False), "dt": DecisionTreeRegressor(seed=seed)}
    return made.get(ALIASES.get(name, name)) or GBTRegressor(seed=seed, maxIter=20)


#: Cells of scores from 0 to 1 in which Venn-Abers calibration counts.
SCORE_CELLS = 1000


def pool_adjacent(n: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """The least-squares rising fit of hit / n, weighted by n, for cells that hold something."""
    blocks: list[list] = []  # rows, hits, cells
    for w, h in zip(n.tolist(), hit.tolist(), strict=True):
        blocks.append([w, h, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w2, h2, c2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w2, blocks[-1][1] + h2, blocks[-1][2] + c2]
    return np.repeat([h / w for w, h, _ in blocks], [c for *_, c in blocks])


def venn_abers_cells(n: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """By cell p1 / (1 - p0 + p1): the fits at the cell with one more row there, of class 0 and of class 1."""
    out = np.empty(len(n))
    for k in range(len(n)):
        more = n.copy()
        more[k] += 1
        full = more > 0
        at = int(full[:k].sum())
        p0 = pool_adjacent(more[full], hit[full])[at]
        own = hit.copy()
        own[k] += 1
        p1 = pool_adjacent(more[full], own[full])[at]
        out[k] = p1 / (1 - p0 + p1)
    return out


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(quoted(label).alias("label"), quoted(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def metrics_from_counts(counts: dict[tuple, int]) -> dict[str, float]:
    """Accuracy, weighted recall, precision and F1, kappa and MCC of a confusion table."""
    n = sum(counts.values())
    if not n:
        return dict.fromkeys(("Accuracy", "Recall", "Prec.", "F1", "Kappa", "MCC"), math.nan)
    labels = sorted({x for k in counts for x in k})
    t = {x: sum(v for (a, _), v in counts.items() if a == x) for x in labels}
    p = {x: sum(v for (_, b), v in counts.items() if b == x) for x in labels}
    hit = {x: counts.get((x, x), 0) for x in labels}
    acc = sum(hit.values()) / n
    rec = {x: hit[x] / t[x] if t[x] else 0.0 for x in labels}
    pre = {x: hit[x] / p[x] if p[x] else 0.0 for x in labels}
    f1 = {x: 2 * pre[x] * rec[x] / (pre[x] + rec[x]) if pre[x] + rec[x] else 0.0 for x in labels}
    weigh = lambda d: sum(t[x] * d[x] for x in labels) / n
    chance = sum(t[x] * p[x] for x in labels) / n**2
    root = math.sqrt((n**2 - sum(v * v for v in p.values())) * (n**2 - sum(v * v for v in t.values())))
    mcc = (sum(hit.values()) * n - sum(t[x] * p[x] for x in labels)) / root if root else 0.0
    return {"Accuracy": acc, "Recall": weigh(rec), "Prec.": weigh(pre), "F1": weigh(f1), "Kappa": (acc - chance) / (1 - chance) if chance < 1 else 0.0, "MCC": mcc}


def evaluate(scored: DataFrame, label: str = "label", classes: int = 2) -> dict[str, float]:
    """Rows are scored once: what is asked of them is asked of the counts of equal ones."""
    own = ([1] if classes == 2 else list(range(classes))) if "probability" in scored.columns else []
    shares = [vector_to_array("probability")[k].alias(f"s{k}") for k in own]
    met = scored.select(quoted(label).alias("label"), "prediction", *shares)
    cells = settled(met.groupBy("label", "prediction", *[f"s{k}" for k in own]).agg(F.count("*").alias("n")), "scores")
    counts = {(r.label, r.prediction): r.n for r in cells.groupBy("label", "prediction").agg(F.sum("n").alias("n")).collect()}
    out = metrics_from_counts(counts)
    out["AUC"] = math.nan
    if own:
        out["AUC"] = float(np.mean([rank_auc(cells.select(F.col(f"s{k}").alias("s"), (F.col("label") == k).cast("int").alias("g"), "n"), "s", "g", "n") for k in own]))
    return out


def folded(df: DataFrame, label: str, k: int, seed: int = 42, name: str = "_fold", cells: int = 64) -> DataFrame:
    """A fold for every row: rank in a hashed cell of its class modulo ``k``, so folds are stratified without a global order."""
    own = F.xxhash64(*[quoted(c) for c in df.columns], F.lit(seed))
    rows = df.withColumns({"_h": own, "_cell": F.pmod(own, F.lit(cells))})
    order = Window.partitionBy(label, "_cell").orderBy("_h")
    return rows.withColumn(name, F.pmod(F.row_number().over(order) + F.col("_cell"), F.lit(k)).cast("int")).drop("_h", "_cell")


def stratified_split(df: DataFrame, label: str, test_share: float = 0.2, seed: int = 42, group: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, test), exact by class up to a row; with ``group`` all rows of a subject go the same way."""
    if group:
        side = F.pmod(F.xxhash64(quoted(group), F.lit(seed)), F.lit(10_000)) < int(test_share * 10_000)
        return df.filter(~side), df.filter(side)
    own = F.xxhash64(*[quoted(c) for c in df.columns], F.lit(seed))
    rows = df.withColumns({"_h": own, "_cell": F.pmod(own, F.lit(64))})
    per = rows.groupBy(label, "_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(label).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(quoted(label).alias("_t"), F.col("_cell").alias("_c"), "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"), F.round(F.sum("_n").over(Window.partitionBy(label)) * test_share).alias("_wanted"))
    met = rows.join(broadcast_if_small(settled(offsets, "split-cells")), quoted(label).eqNullSafe(F.col("_t")) & (F.col("_cell") == F.col("_c")))
    # Cells lie on one side, but for the one of each class in which the test part ends: only its rows are ranked.
    inside, outside = F.col("_o") + F.col("_n") <= F.col("_wanted"), F.col("_o") >= F.col("_wanted")
    ranked = met.filter(~inside & ~outside).withColumn("_r", F.row_number().over(Window.partitionBy(label, "_cell").orderBy("_h")) + F.col("_o"))
    ends = settled(ranked.select(*map(quoted, df.columns), (F.col("_r") <= F.col("_wanted")).alias("_test")), "split-ends")
    side = lambda whole, test: met.filter(whole).select(*map(quoted, df.columns)).union(ends.filter(test).drop("_test"))
    return side(outside, ~F.col("_test")), side(inside, F.col("_test"))


def stratified_sample(df: DataFrame, by: str, size: int, key: str | list[str], seed: int = 42) -> DataFrame:
    """At most ``size`` rows, the classes in their shares (what rounding leaves goes to the largest remainders), each class's rows the
    least by MD5 of ``key`` and the seed. Rows of equal keys are told apart by their other columns; a table of up to ``size`` rows stays whole.

    A task passes on at most ``size`` rows a class.
    """
    counts = sorted((r for r in df.groupBy(quoted(by).alias("c")).agg(F.count("*").alias("n")).collect()), key=lambda r: (r.c is None, r.c))  # a row a class
    total = sum(r.n for r in counts)
    if total <= size:
        return df
    share = [divmod(size * r.n, total) for r in counts]
    more = sorted(range(len(counts)), key=lambda k: (-share[k][1], k))[: size - sum(q for q, _ in share)]
    limit = F.lit(0)
    for k, r in enumerate(counts):
        limit = F.when(quoted(by).eqNullSafe(F.lit(r.c)), share[k][0] + (k in more)).otherwise(limit)
    mark = F.md5(F.concat_ws("|", *[quoted(c).cast("string") for c in ([key] if isinstance(key, str) else key)], F.lit(str(seed))).cast("binary"))
    place = F.row_number().over(Window.partitionBy(by).orderBy("_mark", F.xxhash64(*[quoted(c) for c in df.columns])))
    ranked = df.withColumn("_mark", mark).withColumn("_place", place).filter(F.col("_place") <= size)
    return ranked.filter(F.col("_place") <= limit).select(*[quoted(c) for c in df.columns])


@dataclass
class Experiment:
    train: DataFrame
    test: DataFrame
    features: list[str]
    target: str
    labels: list[str]
    seed: int = 42
    folds: int = 5
    flags: dict = field(default_factory=dict)
    folded: dict[int, DataFrame] = field(default_factory=dict)

    def in_folds(self, k: int) -> DataFrame:
        """The training rows with their fold, written once for all models."""
        if k not in self.folded:
            self.folded[k] = settled(folded(self.train.select("features", "label"), "label", k, self.seed), "folds")
        return self.folded[k]


class Classifier:
    """setup, compare, create, tune, predict, finalize, ensemble, calibrate, explain."""

    def __init__(self):
        self.exp: Experiment | None = None
        self.leaderboard: list[dict] = []
        self.models: dict[str, object] = {}

    def setup_experiment(self, df: DataFrame, target: str, test: DataFrame | None = None, test_share: float = 0.2, folds: int = 5, seed: int = 42, ignore: list[str] = (), **flags) -> Experiment:
        """Other flags (normalize, pca, outliers and so on) are recorded, not applied."""
        df = df.filter(quoted(target).isNotNull())
        features = numeric_columns(df, (*KEYS, target, *ignore))
        both = df if test is None else df.select(target).union(test.select(target))
        labels = StringIndexer(inputCol=target, outputCol="label", stringOrderType="alphabetAsc").fit(both.select(quoted(target).cast("string").alias(target))).labels
        train, test = stratified_split(df, target, test_share, seed) if test is None else (df, test)
        self.exp = Experiment(self._encoded(train, features, target, labels), self._encoded(test, features, target, labels), features, target, list(labels), seed, folds, flags)
        return self.exp

    def _encoded(self, df, features, target, labels):
        code = F.create_map(*[F.lit(x) for k, v in enumerate(labels) for x in (v, float(k))])[quoted(target).cast("string")]
        rows = df.fillna(0, subset=features).withColumn("label", code).filter("label is not null")
        return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(rows)

    def _estimator(self, name, **params):
        est = classifier(name, len(self.exp.labels), self.exp.seed, **params) if isinstance(name, str) else name
        if isinstance(est, MultilayerPerceptronClassifier):
            est = est.setLayers([len(self.exp.features), 8, len(self.exp.labels)])
        return est

    def get_available_models(self, task: str = "classification") -> list[str]:
        return list(CANDIDATES if task == "classification" else REGRESSORS)

    def get_config(self, name: str):
        return getattr(self.exp, name)

    def cross_validate(self, name, k: int | None = None, deadline: float = math.inf, **params) -> dict[str, float]:
        k = k or self.exp.folds
        rows = self.exp.in_folds(k)
        out = []
        for fold in range(k):
            if time.time() > deadline:
                break
            model = self._estimator(name, **params).fit(rows.filter(F.col("_fold") != fold))
            out.append(evaluate(model.transform(rows.filter(F.col("_fold") == fold)), "label", len(self.exp.labels)))
        return {m: round(float(np.nanmean([x[m] for x in out])), 4) if not all(math.isnan(x[m]) for x in out) else math.nan for m in out[0]} if out else {}

    def compare_models(self, include=None, exclude=(), n_select: int = 1, sort: str = "Accuracy", budget_minutes: float | None = None, turbo: bool = True, progress=None) -> list:
        """The leaderboard's first ``n_select`` models, refitted; failing models are left out. ``exclude`` counts without ``include``."""
        deadline = time.time() + budget_minutes * 60 if budget_minutes else math.inf
        names = list(include) if include else [m for m in CANDIDATES if m not in exclude and not (turbo and m in ("mlp", "fm", "catboost", "knn", "ebm"))]
        self.leaderboard = []
        for i, name in enumerate(names):
            if time.time() > deadline:
                break
            began = time.time()
            try:
                scores = self.cross_validate(name, deadline=deadline)
            except Exception as e:
                scores = {}
                self._tell(progress, {"model": name, "error": str(e)[:200]})
            if scores:
                self.leaderboard.append({"model": ALIASES.get(name, name), **scores, "TT (Sec)": round(time.time() - began, 3)})
            self._tell(progress, {"model": name, "done": i + 1, "of": len(names)})
        self.leaderboard.sort(key=lambda r: -(r[sort] if not math.isnan(r[sort]) else -1))
        return [self.create_model(r["model"]) for r in self.leaderboard[:n_select]]

    @staticmethod
    def _tell(progress, event):
        if progress is not None:
            try:
                progress(event)
            except Exception:
                pass

    def create_model(self, name, **params):
        model = self._estimator(name, **params).fit(self.exp.train)
        self.models[name if isinstance(name, str) else type(name).__name__] = model
        return model

    def tune_model(self, name: str, grid: dict[str, list] | None = None, n_iter: int = 5, sort: str = "Accuracy", choose_better: bool = True):
        """Random search over ``grid``; with ``choose_better`` the defaults stay unless beaten."""
        grid = grid or TUNING.get(ALIASES.get(name, name), {})
        combos = [dict(zip(grid, x, strict=True)) for x in itertools.product(*grid.values())] if grid else [{}]
        rng = np.random.default_rng(self.exp.seed)
        tried = [combos[k] for k in rng.permutation(len(combos))[:n_iter]] + ([{}] if choose_better else [])
        best = max(tried, key=lambda p: self.cross_validate(name, **p).get(sort, -1))
        return self.create_model(name, **best)

    def predict_model(self, model, df: DataFrame | None = None) -> DataFrame:
        """The rows with prediction_label and prediction_score_<class>."""
        rows = self.exp.test if df is None else self._encoded(df, self.exp.features, self.exp.target, self.exp.labels) if "features" not in df.columns else df
        out = IndexToString(inputCol="prediction", outputCol="prediction_label", labels=self.exp.labels).transform(model.transform(rows))
        if "probability" in out.columns:
            out = out.withColumns({f"prediction_score_{x}": vector_to_array("probability")[k] for k, x in enumerate(self.exp.labels)})
        return out.drop("features", "rawPrediction", "probability", "prediction")

    def evaluate_model(self, model) -> dict[str, float]:
        return evaluate(model.transform(self.exp.test), "label", len(self.exp.labels))

    def finalize_model(self, name):
        return self._estimator(name).fit(self.exp.train.select("features", "label").union(self.exp.test.select("features", "label")))

    # Presets

    def auto_ml(self, time_limit: float = 3600, **kw):
        return self.compare_models(budget_minutes=time_limit / 60, turbo=False, **kw)

    def quick_compare_models(self):
        return self.compare_models(include=["lr", "rf", "dt", "nb"])

    def quick_classify(self):
        return self.quick_compare_models()[0]

    # Ensembles

    def out_of_fold(self, names: list[str]) -> DataFrame:
        """Training rows with every model's out-of-fold class probabilities as ``meta``."""
        rows = self.exp.in_folds(self.exp.folds)
        parts = []
        for fold in range(self.exp.folds):
            own = rows.filter(F.col("_fold") == fold)
            for j, name in enumerate(names):
                own = self._scored(self._estimator(name).fit(rows.filter(F.col("_fold") != fold).select("features", "label")), own, f"_p{j}")
            parts.append(own)
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return VectorAssembler(inputCols=[f"_p{j}" for j in range(len(names))], outputCol="meta").transform(out)

    @staticmethod
    def _scored(model, rows, name):
        source = "probability" if "probability" in model.transform(rows.limit(0)).columns else "rawPrediction"
        return model.transform(rows).withColumnRenamed(source, name).drop("rawPrediction", "probability", "prediction")

    def create_ensemble(self, names: list[str], method: str = "super_learner", rounds: int = 5):
        """super_learner stacks out-of-fold scores, blending those of a held-out fifth; bma weighs by log-likelihood on a
        held-out fifth; bagging and boosting repeat the first."""
        exp = self.exp
        held = F.pmod(F.xxhash64("features"), F.lit(5)) == 0  # equal rows are on one side
        if method in ("super_learner", "blending"):
            names_of = [f"_p{j}" for j in range(len(names))]
            assemble = VectorAssembler(inputCols=names_of, outputCol="meta")

            def stacked(models, rows):
                for m, name in zip(models, names_of, strict=True):
                    rows = self._scored(m, rows, name)
                return assemble.transform(rows)

            if method == "blending":
                base = [self._estimator(n).fit(exp.train.filter(~held)) for n in names]
                scores = stacked(base, exp.train.filter(held).select("features", "label"))
            else:
                base, scores = [self.create_model(n) for n in names], self.out_of_fold(names)
            meta = LogisticRegression(featuresCol="meta", labelCol="label").fit(scores.select("meta", "label"))

            def predict(rows):
                return meta.transform(stacked(base, rows)).drop("meta", *names_of)
        else:
            if method == "bagging":
                frac = [exp.train.withColumn("_w", F.floor(-F.ln(1 - F.rand(exp.seed + r)) + F.rand(exp.seed + 100 + r))) for r in range(rounds)]
                base = [self._estimator(names[0]).fit(f.filter("_w > 0")) for f in frac]
                weight = [1.0] * rounds
            elif method == "boosting":
                base, weight, rows = [], [], exp.train.select("features", "label").withColumn("w", F.lit(1.0))
                for _ in range(rounds):
                    est = self._estimator(names[0])
                    model = est.setWeightCol("w").fit(rows) if est.hasParam("weightCol") else est.fit(rows)
                    scored = model.transform(rows).select("features", "label", "w", (F.col("prediction") != F.col("label")).alias("wrong"))
                    err = scored.agg(F.sum(F.when(F.col("wrong"), F.col("w")).otherwise(0.0)) / F.sum("w")).first()[0]
                    alpha = math.log(max(1e-9, 1 - err) / max(1e-9, err)) + math.log(max(1, len(exp.labels) - 1))
                    base.append(model)
                    weight.append(max(alpha, 1e-3))
                    rows = scored.withColumn("w", F.col("w") * F.when(F.col("wrong"), F.exp(F.lit(min(alpha, 10.0)))).otherwise(1.0)).select("features", "label", "w")
            elif method == "bma":
                base, rest, hold = [self.create_model(n) for n in names], exp.train.filter(~held), exp.train.filter(held)
                ll = [self._estimator(n).fit(rest).transform(hold).agg(F.sum(F.ln(F.greatest(vector_to_array("probability")[F.col("label").cast("int")], F.lit(1e-12))))).first()[0] or 0.0 for n in names]
                weight = [math.exp(x - max(ll)) for x in ll]
            else:
                raise ValueError(f"unknown ensemble {method}")
            total = sum(weight)

            def predict(rows):
                for j, m in enumerate(base):
                    rows = self._scored(m, rows, f"_p{j}")
                k = len(exp.labels)
                mean = F.array(*[sum((w / total * vector_to_array(f"_p{j}")[c] for j, w in enumerate(weight)), F.lit(0.0)) for c in range(k)])
                rows = rows.withColumn("scores", mean).drop(*[f"_p{j}" for j in range(len(base))])
                return rows.withColumn("prediction", (F.array_position("scores", F.array_max("scores")) - 1).cast("double"))

        return predict

    # Calibration

    def calibrate_model(self, name: str, method: str = "isotonic"):
        """A function from rows to rows with ``calibrated``: the probability of class 1, with more than two classes an array of all
        classes' probabilities, each calibrated against the rest and scaled to sum to one; for conformal, the set of labels.

        venn_abers fits isotonically twice, once with the row's score added as class 0 and once as class 1, and merges both; scores
        are counted in ``SCORE_CELLS`` cells, so only these counts are collected.
        """
        oof = self.out_of_fold([name]).select("label", vector_to_array("meta").alias("p"))
        if method not in ("conformal", "temperature_scaling", "platt", "isotonic", "venn_abers"):
            raise ValueError(f"unknown calibration {method}")
        base = self.create_model(name)
        k = len(self.exp.labels)
        if method == "conformal":
            own = oof.select((1 - F.col("p")[F.col("label").cast("int")]).alias("s"))
            q = exact_quantiles(own, "s", {"q": 0.9}).first().q
            return lambda rows: base.transform(rows).withColumn("label_set", F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda c: 1 - F.get(vector_to_array("probability"), c) <= q))
        if method == "temperature_scaling":
            power = lambda p, t: F.transform(p, lambda x: F.pow(F.greatest(x, F.lit(1e-9)), F.lit(1 / t)))
            share = lambda p, t, c: F.get(power(p, t), c) / F.aggregate(power(p, t), F.lit(0.0), lambda a, x: a + x)
            grid = [0.25 * 1.2**j for j in range(20)]
            nll = oof.agg(*[F.sum(-F.ln(share(F.col("p"), t, F.col("label").cast("int")))) for t in grid]).first()
            t, p = grid[int(np.argmin(nll))], vector_to_array("probability")
            scaled = share(p, t, F.lit(1)) if k == 2 else F.array(*[share(p, t, F.lit(c)) for c in range(k)])
            return lambda rows: base.transform(rows).withColumn("calibrated", scaled)
        if k == 2:
            step = self._calibrator(oof, 1, method, "calibrated")
            return lambda rows: step(base.transform(rows))
        steps = [self._calibrator(oof, c, method, f"_c{c}") for c in range(k)]

        def calibrated(rows):
            rows = base.transform(rows)
            for step in steps:
                rows = step(rows)
            total = sum((F.col(f"_c{c}") for c in range(k)), F.lit(0.0))
            return rows.withColumn("calibrated", F.array(*[F.when(total > 0, F.col(f"_c{c}") / total).otherwise(1 / k) for c in range(k)])).drop(*[f"_c{c}" for c in range(k)])

        return calibrated

    @staticmethod
    def _calibrator(oof: DataFrame, c: int, method: str, out: str):
        """A function that adds ``out``, the calibrated probability of class ``c`` against the rest."""
        own = oof.select((F.col("label") == c).cast("double").alias("label"), F.col("p")[c].alias("s"))
        score = vector_to_array("probability")[c]
        if method == "platt":
            logit = lambda x: F.ln(F.greatest(x, F.lit(1e-9)) / F.greatest(1 - x, F.lit(1e-9)))
            m = LogisticRegression(featuresCol="x", labelCol="label").fit(VectorAssembler(inputCols=["z"], outputCol="x").transform(own.withColumn("z", logit(F.col("s")))))
            a, b = float(m.coefficients[0]), float(m.intercept)
            return lambda rows: rows.withColumn(out, 1 / (1 + F.exp(-(a * logit(score) + b))))
        if method == "isotonic":
            iso = IsotonicRegression(featuresCol="_s", labelCol="label", predictionCol=out).fit(own.withColumnRenamed("s", "_s"))
            return lambda rows: iso.transform(rows.withColumn("_s", score)).drop("_s")
        cell = lambda x: F.floor(x * SCORE_CELLS).cast("int")
        n, hit = np.zeros(SCORE_CELLS + 1), np.zeros(SCORE_CELLS + 1)
        for r in own.groupBy(cell(F.col("s")).alias("k")).agg(F.count("*").alias("n"), F.sum("label").alias("hit")).collect():
            n[r.k], hit[r.k] = r.n, r.hit
        merged = F.array(*[F.lit(float(x)) for x in venn_abers_cells(n, hit)])
        return lambda rows: rows.withColumn(out, F.get(merged, cell(score)))

    # Explanation and validation

    def explain_model(self, model, top: int = 20) -> list[tuple[str, float]]:
        """The features that count most: importances of trees, sizes of coefficients, else the accuracy that is lost when a feature's
        values move to other test rows."""
        last = model
        if hasattr(last, "featureImportances"):
            w = last.featureImportances.toArray()
        elif hasattr(last, "coefficientMatrix"):
            w = np.abs(last.coefficientMatrix.toArray()).mean(0)
        else:
            w = self._shuffled_loss(model)
        return sorted(zip(self.exp.features, map(float, w), strict=True), key=lambda x: -x[1])[:top]

    def _shuffled_loss(self, model) -> list[float]:
        from .select import hashed_shuffle, shuffle_buckets

        raw = settled(self.exp.test.select(*map(quoted, self.exp.features), "label"), "explained")
        assemble = VectorAssembler(inputCols=self.exp.features, outputCol="features", handleInvalid="keep")
        right = lambda rows: model.transform(assemble.transform(rows)).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0] or 0.0
        base, buckets = right(raw), shuffle_buckets(raw)
        return [base - right(hashed_shuffle(raw, [c], self.exp.seed + j, buckets)) for j, c in enumerate(self.exp.features)]

    def shap_values(self, model, df: DataFrame | None = None) -> DataFrame:
        """The test rows (or ``df``'s) with ``shap``, for models of trees: of each class an array with a value for each feature."""
        rows = self.exp.test if df is None else self._encoded(df, self.exp.features, self.exp.target, self.exp.labels)
        return shap_values(model, rows)

    def partial_dependence(self, model, feature: str, points: int = 10) -> list[tuple[float, float]]:
        """Mean probability of class 1 at quantiles of one feature: a prediction for each point over all rows."""
        raw = self.exp.test.drop("features")
        grid = raw.agg(F.percentile_approx(quoted(feature), [k / points for k in range(points + 1)])).first()[0]
        assemble = VectorAssembler(inputCols=self.exp.features, outputCol="features", handleInvalid="keep")
        out = []
        for v in grid:
            rows = model.transform(assemble.transform(raw.withColumn(feature, F.lit(float(v)))))
            out.append((float(v), rows.agg(F.avg(vector_to_array("probability")[1])).first()[0]))
        return out

    def validate_drift(self) -> dict:
        """How well train and test can be told apart: AUC near 0.5 means no drift."""
        rows = self.exp.train.select("features").withColumn("label", F.lit(0.0)).union(self.exp.test.select("features").withColumn("label", F.lit(1.0)))
        scored = LogisticRegression(maxIter=50).fit(rows).transform(rows)
        auc = evaluate(scored)["AUC"]
        return {"auc": auc, "drift": auc > 0.6}

    def nested_cv(self, name: str, outer: int = 3, inner: int = 3, grid: dict | None = None) -> list[float]:
        grid = grid or TUNING.get(name, {})
        combos = [dict(zip(grid, x, strict=True)) for x in itertools.product(*grid.values())][:4] if grid else [{}]
        rows, out, whole = folded(self.exp.train.select("features", "label"), "label", outer, self.exp.seed, "_outer"), [], self.exp
        for fold in range(outer):
            own = rows.filter(F.col("_outer") != fold).drop("_outer")
            self.exp = Experiment(own, own, whole.features, whole.target, whole.labels, whole.seed, inner)
            best = max(combos, key=lambda p: self.cross_validate(name, **p)["Accuracy"])
            out.append(evaluate(self._estimator(name, **best).fit(own).transform(rows.filter(F.col("_outer") == fold)), "label", len(whole.labels))["Accuracy"])
            self.exp = whole
        return out

    def detect_noise(self, name: str = "lr", method: str = "confident_learning") -> DataFrame:
        """Training rows' labels with noisy: out-of-fold class beats the class means' thresholds, or models disagree with it."""
        names = [name] if method != "consensus" else ["lr", "dt", "nb"]
        oof = self.out_of_fold(names).select("features", "label", *[vector_to_array(f"_p{j}").alias(f"p{j}") for j in range(len(names))])
        best = lambda p: F.array_position(p, F.array_max(p)) - 1
        if method == "confident_learning":
            means = {r.label: r.m for r in oof.groupBy("label").agg(F.avg(F.col("p0")[F.col("label").cast("int")]).alias("m")).collect()}
            cut = F.create_map(*[F.lit(x) for k, v in means.items() for x in (float(k), float(v))])
            top = best(F.col("p0"))
            return oof.withColumn("noisy", (top != F.col("label")) & (F.array_max("p0") >= F.coalesce(F.try_element_at(cut, top.cast("double")), F.lit(1.0))))
        wrong = [(best(F.col(f"p{j}")) != F.col("label")).cast("int") for j in range(len(names))]
        return oof.withColumn("noisy", sum(wrong[1:], wrong[0]) * 2 > len(names))


# Search grids.
TUNING = {
    "lr": {"regParam": [0.001, 0.01, 0.1], "elasticNetParam": [0.0, 0.5]},
    "rf": {"numTrees": [50, 100], "maxDepth": [5, 10]},
    "et": {"numTrees": [50, 100], "maxDepth": [5, 10]},
    "dt": {"maxDepth": [3, 5, 10], "minInstancesPerNode": [1, 5]},
    "gbc": {"maxIter": [20, 50], "maxDepth": [3, 5]},
    "svm": {"regParam": [0.001, 0.01, 0.1]},
}


def slow_models(n_rows: int, n_features: int) -> list[str]:
    out = ["svm", "qda"] if n_rows > 5000 or n_features > 100 else []
    return out + (["knn"] if n_rows > 10_000 else [])


def pca2(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with pc1 and pc2 of the standardised columns."""
    steps = [VectorAssembler(inputCols=columns, outputCol="_v", handleInvalid="keep"), StandardScaler(inputCol="_v", outputCol="_z", withMean=True), PCA(k=2, inputCol="_z", outputCol="_pc")]
    out = Pipeline(stages=steps).fit(df).transform(df)
    xy = vector_to_array("_pc")
    return out.withColumns({"pc1": xy[0], "pc2": xy[1]}).drop("_v", "_z", "_pc")


def quick_accuracy(df: DataFrame, columns: list[str], target: str) -> float:
    from .select import _assembled

    rows = _assembled(df, columns, target).withColumn("_part", F.pmod(F.xxhash64("_x"), F.lit(4)))
    model = LogisticRegression(featuresCol="_x", labelCol=target, maxIter=20).fit(rows.filter("_part > 0"))
    return model.transform(rows.filter("_part = 0")).agg(F.avg((F.col("prediction") == quoted(target)).cast("double"))).first()[0] or 0.0
