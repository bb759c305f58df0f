"""Estimators of scikit-learn style programs: learned by aggregates or pyspark.ml, applied as columns.

A fitted estimator holds statistics or a model, never rows. Tables and targets of one program are
brought together by the hidden row position.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import functions as F

from sparkloom.errors import UnsupportedError
from sparkloom.functions import modes
from sparkloom.functions.formula import quoted

POS = "__pos"

MODELS = {
    "LinearRegression": ("linear", {}), "Ridge": ("linear", {"alpha": "regParam"}), "Lasso": ("linear", {"alpha": "regParam"}), "LogisticRegression": ("logistic", {"max_iter": "maxIter"}), "LinearSVC": ("linear_svc", {"max_iter": "maxIter", "C": None}), "SVC": ("linear_svc", {"max_iter": "maxIter", "C": None, "kernel": None}),
    "RandomForestClassifier": ("random_forest_classifier", {"n_estimators": "numTrees", "max_depth": "maxDepth"}), "RandomForestRegressor": ("random_forest_regressor", {"n_estimators": "numTrees", "max_depth": "maxDepth"}), "DecisionTreeClassifier": ("decision_tree_classifier", {"max_depth": "maxDepth"}), "DecisionTreeRegressor": ("decision_tree_regressor", {"max_depth": "maxDepth"}),
    "GradientBoostingClassifier": ("gbt_classifier", {"n_estimators": "maxIter", "max_depth": "maxDepth"}), "GradientBoostingRegressor": ("gbt_regressor", {"n_estimators": "maxIter", "max_depth": "maxDepth"}),
    "KMeans": ("kmeans", {"n_clusters": "k", "max_iter": "maxIter", "n_init": None}), "MiniBatchKMeans": ("kmeans", {"n_clusters": "k", "max_iter": "maxIter", "batch_size": None, "n_init": None}), "AgglomerativeClustering": ("bisecting_kmeans", {"n_clusters": "k"}),
}
SEEDED = {"kmeans", "bisecting_kmeans", "random_forest_classifier", "random_forest_regressor", "decision_tree_classifier", "decision_tree_regressor", "gbt_classifier", "gbt_regressor"}
CLUSTERS = {"kmeans", "bisecting_kmeans"}
REGRESSORS = {"linear", "random_forest_regressor", "decision_tree_regressor", "gbt_regressor"}
SCALERS = {"StandardScaler", "MinMaxScaler", "RobustScaler", "MaxAbsScaler"}
STEPS = {*SCALERS, "Normalizer", "OneHotEncoder", "OrdinalEncoder", "LabelEncoder", "LabelBinarizer", "SimpleImputer", "PCA", "SelectKBest", "Pipeline", "ColumnTransformer", "GridSearchCV"}
#: Positional parameters of what takes any.
FIRST = {"Pipeline": ["steps"], "ColumnTransformer": ["transformers"], "GridSearchCV": ["estimator", "param_grid"], "PCA": ["n_components"], "SelectKBest": ["score_func", "k"], "KMeans": ["n_clusters"]}


@dataclass
class Estimator:
    """An estimator of a program: its class, parameters and, once fitted, what it has learned."""

    kind: str
    params: dict = field(default_factory=dict)
    state: Any = None

    def copy(self, **params: Any) -> Estimator:
        steps = {"steps": [(n, e.copy()) for n, e in self.params["steps"]]} if self.kind == "Pipeline" else {}
        return Estimator(self.kind, {**self.params, **steps, **params})


def create(compiler, name: str, args: list, kw: dict) -> Any:
    """What a call of a name imported from the library gives."""
    if name == "train_test_split":
        return split(compiler, args, **kw)
    if name == "cross_val_score":
        return cross_val(compiler, *args, **kw)
    if name in METRICS:
        return measured(compiler, name, args[0], args[1])
    if name in ("f_classif", "f_regression", "chi2"):
        return name
    if name == "make_pipeline":
        return Estimator("Pipeline", {"steps": [(str(i), e) for i, e in enumerate(args)]})
    if name not in MODELS and name not in STEPS:
        raise UnsupportedError(f"sklearn {name}")
    return Estimator(name, {**dict(zip(FIRST.get(name, []), args, strict=False)), **kw})


def split(compiler, tables: list, test_size: float = 0.25, random_state: int | None = 0, stratify: Any = None, shuffle: bool = True, train_size: float | None = None) -> list:
    """Parts for training and test of each table, the same rows of all, by a hash of the position."""
    if stratify is not None or not shuffle:
        raise UnsupportedError("train_test_split with stratify or without shuffle")
    share = 1 - train_size if train_size is not None else test_size
    hit = F.pmod(F.xxhash64(F.col(POS), F.lit(int(random_state or 0))), F.lit(1_000_000)) < int(share * 1_000_000)
    out = []
    for t in tables:
        for part in (~hit, hit):
            out.append(compiler.filtered(t, part))
    return out


METRICS = {"accuracy_score", "mean_squared_error", "mean_absolute_error", "r2_score"}
SCORING = {"accuracy": "accuracy_score", "neg_mean_squared_error": "mean_squared_error", "neg_mean_absolute_error": "mean_absolute_error", "r2": "r2_score"}


def measured(compiler, name: str, truth, guess) -> float:
    """One figure over all rows that both columns have."""
    both = guess.frame.df.select(POS, guess.col.cast("double").alias("g")).join(truth.frame.df.select(POS, truth.col.cast("double").alias("t")), POS)
    e = F.col("t") - F.col("g")
    mean = F.avg("t")
    value = {"accuracy_score": lambda: F.avg((e == 0).cast("double")), "mean_squared_error": lambda: F.avg(e * e), "mean_absolute_error": lambda: F.avg(F.abs(e)), "r2_score": lambda: 1 - F.try_divide(F.sum(e * e), F.sum(F.col("t") * F.col("t")) - F.count("t") * mean * mean)}[name]()
    return float(both.agg(value).first()[0] or 0.0)


def cross_val(compiler, est: Estimator, x, y, cv: int = 5, scoring: str | None = None, n_jobs: Any = None) -> list[float]:
    """The score of each of ``cv`` folds by a hash of the position, learned on the others."""
    fold = F.pmod(F.xxhash64(F.col(POS)), F.lit(int(cv)))
    out = []
    for k in range(int(cv)):
        model = fit(compiler, est.copy(), compiler.filtered(x, fold != k), compiler.filtered(y, fold != k))
        out.append(score(compiler, model, compiler.filtered(x, fold == k), compiler.filtered(y, fold == k), scoring))
    return out


def score(compiler, est: Estimator, x, y, scoring: str | None = None) -> float:
    name = SCORING.get(scoring or "", None) if scoring else "r2_score" if _last(est) in REGRESSORS else "accuracy_score"
    if name is None:
        raise UnsupportedError(f"scoring {scoring!r}")
    value = measured(compiler, name, y, method(compiler, est, "predict", [x], {}))
    return -value if (scoring or "").startswith("neg_") else value


def _last(est: Estimator) -> str:
    if est.kind == "Pipeline":
        return _last(est.params["steps"][-1][1])
    if est.kind == "GridSearchCV":
        return _last(est.params["estimator"])
    return MODELS[est.kind][0] if est.kind in MODELS else ""


def method(compiler, est: Estimator, name: str, args: list, kw: dict) -> Any:
    """A method of an estimator."""
    if name == "fit":
        return fit(compiler, est, *args, **kw)
    if name == "fit_transform":
        return transform(compiler, fit(compiler, est, *args, **kw), args[0])
    if name == "fit_predict":
        return predict(compiler, fit(compiler, est, *args, **kw), args[0])
    if est.state is None:
        raise UnsupportedError(f"{est.kind}.{name} before fit")
    table = {"transform": transform, "predict": predict, "predict_proba": probabilities, "score": score}
    if name not in table:
        raise UnsupportedError(f"{est.kind}.{name}")
    return table[name](compiler, est, *args, **kw)


def fit(compiler, est: Estimator, x, y=None) -> Estimator:
    """Learn from a table, or a column for encoders of targets; ``est`` itself with what it learned."""
    kind, p = est.kind, est.params
    if kind in SCALERS:
        cols = [F.col(quoted(c)).cast("double") for c in x.columns]
        stats = {
            "StandardScaler": lambda c: F.array(F.avg(c), F.stddev_pop(c)), "MinMaxScaler": lambda c: F.array(F.min(c), F.max(c) - F.min(c)), "MaxAbsScaler": lambda c: F.array(F.lit(0.0), F.max(F.abs(c))),
            "RobustScaler": lambda c: F.transform(F.array(F.percentile(c, F.array(*[F.lit(q) for q in (0.25, 0.5, 0.75)]))), lambda q: F.array(q[1], q[2] - q[0]))[0],
        }[kind]
        row = x.df.agg(*[stats(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
        est.state = {c: (row[i][0] or 0.0, row[i][1] or 1.0) for i, c in enumerate(x.columns)}
    elif kind in ("LabelEncoder", "LabelBinarizer"):
        est.state = modes.distinct_values(x.frame.df.select(x.col.alias("v")), "v")
    elif kind in ("OneHotEncoder", "OrdinalEncoder"):
        est.state = {c: modes.distinct_values(x.df, c) for c in x.columns}
    elif kind == "SimpleImputer":
        how = p.get("strategy", "mean")
        f = {"mean": F.avg, "median": F.median, "most_frequent": lambda c: F.mode(c, deterministic=True), "constant": lambda c: F.first(F.lit(p.get("fill_value", 0)))}
        if how not in f:
            raise UnsupportedError(f"strategy {how!r}")
        row = x.df.agg(*[f[how](F.col(quoted(c))).alias(f"s{i}") for i, c in enumerate(x.columns)]).first()
        est.state = {c: row[i] for i, c in enumerate(x.columns)}
    elif kind == "Normalizer":
        est.state = True
    elif kind == "PCA":
        est.state = _pca(x, int(p.get("n_components") or len(x.columns)))
    elif kind == "SelectKBest":
        est.state = _best(compiler, x, y, int(p.get("k", 10)), p.get("score_func", "f_classif"))
    elif kind == "Pipeline":
        for _, step in p["steps"][:-1]:
            x = transform(compiler, fit(compiler, step, x, y), x)
        fit(compiler, p["steps"][-1][1], x, y)
        est.state = True
    elif kind == "ColumnTransformer":
        for _, step, cols in p["transformers"]:
            if isinstance(step, Estimator):
                fit(compiler, step, compiler.columns_of(x, cols), y)
        est.state = True
    elif kind == "GridSearchCV":
        grid = p["param_grid"]
        tried = []
        for values in itertools.product(*grid.values()):
            chosen = dict(zip(grid, values, strict=True))
            scores = cross_val(compiler, _with(p["estimator"], chosen), x, y, p.get("cv") or 5, p.get("scoring"))
            tried.append((sum(scores) / len(scores), chosen))
        best = max(tried, key=lambda t: t[0])
        est.state = {"best_score_": best[0], "best_params_": best[1], "best_estimator_": fit(compiler, _with(p["estimator"], best[1]), x, y)}
    else:
        est.state = _model(compiler, est, x, y)
    return est


def _with(est: Estimator, chosen: dict) -> Estimator:
    """A copy with other parameters; ``step__name`` is that of a step of a pipeline."""
    made = est.copy(**{k: v for k, v in chosen.items() if "__" not in k})
    for k, v in chosen.items():
        if "__" in k:
            step, _, name = k.partition("__")
            dict(made.params["steps"])[step].params[name] = v
    return made


def _model(compiler, est: Estimator, x, y):
    from sparkloom.functions import ml

    kind, names = MODELS[est.kind]
    params = {}
    for k, v in est.params.items():
        if k in ("random_state", "n_jobs", "verbose", "fit_intercept"):
            continue
        if k not in names:
            raise UnsupportedError(f"{est.kind}({k}=)")
        if names[k] and v is not None:
            params[names[k]] = v
    if kind in SEEDED:
        params["seed"] = int(est.params.get("random_state") or 0)
    if est.kind == "Lasso":
        params["elasticNetParam"] = 1.0
    if est.kind == "SVC" and est.params.get("kernel", "linear") != "linear":
        raise UnsupportedError("SVC with a kernel")
    df = x.df
    if kind not in CLUSTERS:
        if y is None:
            raise UnsupportedError(f"{est.kind}.fit without a target")
        df = df.join(y.frame.df.select(POS, y.col.cast("double").alias("label")), POS).where("label is not null")
    return ml.fit(df, x.columns, kind, **params)


def _pca(x, k: int):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler

    parts = [VectorAssembler(inputCols=x.columns, outputCol="__v", handleInvalid="skip"), StandardScaler(withMean=True, withStd=False, inputCol="__v", outputCol="__c"), PCA(k=k, inputCol="__c", outputCol="__p")]
    return Pipeline(stages=parts).fit(x.df), k


def _best(compiler, x, y, k: int, how: str) -> list[str]:
    from pyspark.ml.feature import UnivariateFeatureSelector, VectorAssembler

    df = x.df.join(y.frame.df.select(POS, y.col.cast("double").alias("label")), POS)
    df = VectorAssembler(inputCols=x.columns, outputCol="features", handleInvalid="skip").transform(df)
    selector = UnivariateFeatureSelector(selectionMode="numTopFeatures").setFeatureType("categorical" if how == "chi2" else "continuous").setLabelType("continuous" if how == "f_regression" else "categorical").setSelectionThreshold(min(k, len(x.columns)))
    return [x.columns[i] for i in sorted(selector.fit(df).selectedFeatures)]


def transform(compiler, est: Estimator, x) -> Any:
    """A table, or a column for encoders of targets, as the fitted estimator sees it."""
    kind, p, s = est.kind, est.params, est.state
    if kind in ("LabelEncoder", "LabelBinarizer"):
        code = F.element_at(F.create_map(*[v for i, c in enumerate(s) for v in (F.lit(c), F.lit(i))]), x.col) if s else F.lit(None).cast("int")
        return compiler.series(x, F.when(x.col.isNotNull(), code))
    if kind in SCALERS:
        lo, hi = p.get("feature_range", (0, 1))
        scaled = {c: (F.col(quoted(c)).cast("double") - F.lit(a)) / F.lit(b) for c, (a, b) in s.items()}
        return compiler.columns(x, {c: v * (hi - lo) + lo for c, v in scaled.items()} if kind == "MinMaxScaler" else scaled)
    if kind == "Normalizer":
        norm = p.get("norm", "l2")
        cs = [F.coalesce(F.col(quoted(c)).cast("double"), F.lit(0.0)) for c in x.columns]
        size = {"l1": lambda: sum((F.abs(c) for c in cs[1:]), F.abs(cs[0])), "l2": lambda: F.sqrt(sum((c * c for c in cs[1:]), cs[0] * cs[0])), "max": lambda: F.array_max(F.array(*[F.abs(c) for c in cs]))}[norm]()
        return compiler.columns(x, {c: F.coalesce(F.try_divide(v, size), F.lit(0.0)) for c, v in zip(x.columns, cs, strict=True)})
    if kind == "OrdinalEncoder":
        return compiler.columns(x, {c: F.element_at(F.create_map(*[v for i, k in enumerate(vs) for v in (F.lit(k), F.lit(float(i)))]), F.col(quoted(c))) for c, vs in s.items() if vs})
    if kind == "OneHotEncoder":
        first = 1 if p.get("drop") == "first" else 0
        made = {f"{c}_{v}": F.coalesce((F.col(quoted(c)) == F.lit(v)).cast("double"), F.lit(0.0)) for c, vs in s.items() for v in vs[first:]}
        return compiler.columns(x, made, gone=list(s))
    if kind == "SimpleImputer":
        return compiler.columns(x, {c: F.coalesce(F.col(quoted(c)), F.lit(v)) for c, v in s.items()})
    if kind == "PCA":
        from pyspark.ml.functions import vector_to_array

        model, k = s
        df = model.transform(x.df).withColumn("__a", vector_to_array("__p"))
        return compiler.table(df.select(POS, *[F.get("__a", F.lit(i)).alias(f"pca{i}") for i in range(k)]), x)
    if kind == "SelectKBest":
        return compiler.columns_of(x, s)
    if kind == "Pipeline":
        for _, step in p["steps"]:
            x = transform(compiler, step, x)
        return x
    if kind == "ColumnTransformer":
        return _by_columns(compiler, est, x)
    raise UnsupportedError(f"{kind}.transform")


def _by_columns(compiler, est: Estimator, x):
    """Parts one after the other on the same rows, so that no join is needed: a column that a part
    has made is kept apart until all are done."""
    df, names = x.df, []
    for i, (_, step, cols) in enumerate(est.params["transformers"]):
        if step == "drop":
            continue
        part = compiler.table(df.select("*"), x)
        if step == "passthrough":
            made, outs = part, cols
        else:
            made = transform(compiler, step, compiler.table(part.df.select(POS, *[quoted(c) for c in cols], *[quoted(c) for c in df.columns if c.startswith("__ct")], *[F.col(quoted(c)).alias(f"__keep_{c}") for c in x.columns]), x))
            outs = [c for c in made.columns if not c.startswith(("__ct", "__keep_"))]
        df = made.df if step == "passthrough" else made.df.select(POS, *[F.col(quoted(f"__keep_{c}")).alias(c) for c in x.columns], *[quoted(c) for c in made.df.columns if c.startswith("__ct")], *[F.col(quoted(c)).alias(f"__ct{i}_{c}") for c in outs])
        names += [(f"__ct{i}_{c}" if step != "passthrough" else c, c) for c in outs]
    if est.params.get("remainder") == "passthrough":
        used = {c for _, _, cols in est.params["transformers"] for c in cols}
        names += [(c, c) for c in x.columns if c not in used]
    return compiler.table(df.select(POS, *[F.col(quoted(a)).alias(b) for a, b in names]), x)


def _scored(compiler, est: Estimator, x):
    from sparkloom.functions import ml

    if est.kind == "GridSearchCV":
        return _scored(compiler, est.state["best_estimator_"], x)
    if est.kind == "Pipeline":
        for _, step in est.params["steps"][:-1]:
            x = transform(compiler, step, x)
        return _scored(compiler, est.params["steps"][-1][1], x)
    if est.kind not in MODELS:
        raise UnsupportedError(f"{est.kind}.predict")
    return ml.score(x.df, {"model": est.state})


def predict(compiler, est: Estimator, x):
    return compiler.made(_scored(compiler, est, x), "prediction", x)


def probabilities(compiler, est: Estimator, x):
    df = _scored(compiler, est, x)
    if "probability" not in df.columns:
        raise UnsupportedError(f"{est.kind}.predict_proba")
    n = int(df.agg(F.max(F.size("probability"))).first()[0] or 0)
    return compiler.table(df.select(POS, *[F.get("probability", F.lit(i)).alias(f"proba_{i}") for i in range(n)]), x)
