"""Trained classifiers: scoring to a probability array, saving and loading."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlab.functions.decisions import hierarchical_decision
from flowlab.functions.ranking import argmax_class, ranked_indices
from flowlab.plans.missing import FILLED, MISSING
from flowlab.schema import quoted, require_columns, ticked

# --- Fixed values: the model choices offered for scoring ---
MODEL_FOLDERS = {
    "Boosted Trees": "archive_boosted",
    "Logistic Regression": "archive_logreg",
    "Random Forest": "archive_random_forest",
    "Hierarchical Family + Subtype": "hierarchical_bundle",
}
DEFAULT_MODEL = "Hierarchical Family + Subtype"
THRESHOLD_FILES = {
    "Logistic Regression": "archive_logreg_thresholds.json",
    "Random Forest": "archive_random_forest_thresholds.json",
}
# --- End of fixed values ---


def available_models() -> list[str]:
    return list(MODEL_FOLDERS)


@dataclass
class FlatModel:
    """One classifier over all classes: a fitted pipeline, or one boosted binary model per class."""

    classes: list[str]
    features: list[str]
    pipeline: PipelineModel
    per_class: list[GBTClassificationModel] = field(default_factory=list)
    #: Validation log loss after each round of an early-stopped fit; not saved.
    losses: list[float] = field(default_factory=list)

    def vectors(self, df: DataFrame) -> DataFrame:
        """The feature columns in order as doubles, assembled by the pipeline; other columns pass through."""
        require_columns(df, self.features)
        types = dict(df.dtypes)
        casts = {c: quoted(c).cast("double") for c in self.features if types[c] != "double"}
        return df.withColumns(casts) if casts else df

    def assemble(self, df: DataFrame) -> DataFrame:
        """Add the feature vector, in place of another model's: the first stages of the pipeline."""
        out = self.vectors(df.drop("_features"))
        for stage in self.pipeline.stages[: self._assembling]:
            out = stage.transform(out)
        return out.drop(*[c for c in out.columns if c.startswith((FILLED, MISSING)) and c not in df.columns])

    @property
    def _assembling(self) -> int:
        """How many stages make the feature vector."""
        return 1 + next(i for i, s in enumerate(self.pipeline.stages) if isinstance(s, VectorAssembler))

    @property
    def filling(self) -> str:
        """How missing values are filled; models that fill alike share a feature vector."""
        return "".join(s.getStatement() for s in self.pipeline.stages if isinstance(s, SQLTransformer))

    def score(
        self, df: DataFrame, out: str = "probs", when: Column | None = None, assembled: bool = False
    ) -> DataFrame:
        """Add ``out: array<double>`` with one probability per class, in the order of ``classes``.

        With ``when``, rows for which it is false get null and are not scored. ``assembled`` rows hold the feature
        vector already.
        """
        kept = [ticked(c) for c in df.columns]
        scored = df if assembled else self.assemble(df)
        for stage in self.pipeline.stages[self._assembling :]:
            scored = stage.transform(scored)

        def guarded(value: Column) -> Column:
            return value if when is None else F.when(when, value)

        if not self.per_class:
            return scored.select(*kept, guarded(vector_to_array("probability")).alias(out))
        for i, model in enumerate(self.per_class):
            one = model.copy().setRawPredictionCol(f"_raw_{i}").setProbabilityCol(f"_prob_{i}").setPredictionCol("")
            scored = one.transform(scored)
        # Each binary model gives P(class against the rest); they are normalised to sum to one.
        each = F.array(*[F.get(vector_to_array(f"_prob_{i}"), F.lit(1)) for i in range(len(self.per_class))])
        scored = scored.select(*kept, guarded(each).alias(out))
        total = F.aggregate(F.col(out), F.lit(0.0), lambda a, p: a + p)
        return scored.withColumn(out, F.transform(F.col(out), lambda p: p / total))

    def predict(self, df: DataFrame, out: str = "y_pred", probs: str = "probs") -> DataFrame:
        return self.score(df, probs).withColumn(out, argmax_class(F.col(probs), self.classes))

    def feature_importance(self, spark: SparkSession) -> DataFrame:
        """(feature, importance); a boosted model averages its binary models. A feature's indicator counts for it."""
        trained = self.per_class or [self.pipeline.stages[-1]]
        vectors = [m.featureImportances.toArray() for m in trained]
        means = [sum(float(v[i]) for v in vectors) / len(vectors) for i in range(len(vectors[0]))]
        values = means[: len(self.features)]
        indicators = self.pipeline.stages[self._assembling - 1].getInputCols()[len(self.features) :]
        for name, value in zip(indicators, means[len(self.features) :]):
            values[int(name.removeprefix(MISSING))] += value
        rows = [(name, float(value)) for name, value in zip(self.features, values)]
        return spark.createDataFrame(rows, "feature string, importance double")

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        for i, model in enumerate(self.per_class):
            model.write().overwrite().save(f"{path}/class_{i}")
        about = {"kind": "flat", "classes": self.classes, "features": self.features, "per_class": len(self.per_class)}
        _write_about(spark, path, about)


@dataclass
class HierarchicalModel:
    """A family classifier and one subtype classifier per family with several subtypes."""

    family: FlatModel
    subtypes: dict[str, FlatModel]
    passthrough: dict[str, str]
    top_k: int = 2

    def score(self, df: DataFrame, *, benign: str | None = None) -> DataFrame:
        """Input columns plus the hierarchical output columns; map-only.

        The beam of ``top_k`` families is known before the subtype models run, and a subtype model is evaluated only
        on rows that hold its family in the beam.
        """
        kept = [ticked(c) for c in df.columns]
        scored = self.family.score(self.family.assemble(df), "_family_probs", assembled=True)
        scored = scored.withColumn(
            "_families", ranked_indices(F.col("_family_probs"), len(self.family.classes), self.top_k)["i"]
        )
        columns: dict[str, tuple[str, Sequence[str]]] = {}
        filling = self.family.filling
        for i, (name, model) in enumerate(self.subtypes.items()):
            column = f"_subtype_{i}"
            if name not in self.family.classes:
                continue
            position = self.family.classes.index(name)
            if model.filling != filling:
                scored, filling = model.assemble(scored), model.filling
            scored = model.score(scored, column, when=F.array_contains("_families", F.lit(position)), assembled=True)
            columns[name] = (column, model.classes)
        extra = {} if benign is None else {"benign": benign}
        decided = hierarchical_decision(
            scored.select(*kept, "_family_probs", *[c for c, _ in columns.values()]),
            "_family_probs",
            self.family.classes,
            columns,
            self.passthrough,
            top_k=self.top_k,
            **extra,
        )
        return decided

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        self.family.save(f"{path}/family")
        names = list(self.subtypes)
        for i, name in enumerate(names):
            self.subtypes[name].save(f"{path}/subtype_{i}")
        about = {
            "kind": "hierarchical",
            "subtypes": names,
            "passthrough": dict(self.passthrough),
            "top_k": self.top_k,
            "features": self.family.features,
        }
        _write_about(spark, path, about)


def _write_about(spark: SparkSession, path: str, about: Mapping) -> None:
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(
        f"{path}/about"
    )


def load(spark: SparkSession, path: str) -> FlatModel | HierarchicalModel:
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    if about["kind"] == "hierarchical":
        return HierarchicalModel(
            load(spark, f"{path}/family"),
            {name: load(spark, f"{path}/subtype_{i}") for i, name in enumerate(about["subtypes"])},
            about["passthrough"],
            about["top_k"],
        )
    return FlatModel(
        about["classes"],
        about["features"],
        PipelineModel.load(f"{path}/pipeline"),
        [GBTClassificationModel.load(f"{path}/class_{i}") for i in range(about["per_class"])],
    )


def model_path(root: str, name: str) -> str:
    if name not in MODEL_FOLDERS:
        raise ValueError(f"Unknown model '{name}'. Available: {available_models()}")
    return f"{root.rstrip('/')}/{MODEL_FOLDERS[name]}"


def load_model(spark: SparkSession, root: str, name: str = DEFAULT_MODEL) -> FlatModel | HierarchicalModel:
    """One of the named models below ``root``."""
    return load(spark, model_path(root, name))


def threshold_path(root: str, name: str) -> str | None:
    """Where a flat model's thresholds live; None for models that use none."""
    return f"{root.rstrip('/')}/{THRESHOLD_FILES[name]}" if name in THRESHOLD_FILES else None

