"""The classification run: balanced sample, split, model, scores."""

from pyspark.sql import DataFrame

from wakeline.constants import EXCLUDED_MMSI_ML, FEATURES
from wakeline.models.classifiers import CLASSIFIERS
from wakeline.models.neighbours import knn_predictions
from wakeline.operators.prepare import in_focus_area, real_vessels
from wakeline.operators.sampling import balanced_sample, stratified_split
from wakeline.operators.scaling import standardised
from wakeline.session import checkpointed

# Learners pass over the sample many times: enough tasks to share the work, few enough to start fast.
SAMPLE_PARTITIONS = 8


def training_rows(reports: DataFrame) -> DataFrame:
    """Reports of real vessels inside the area, as the learners expect them."""
    return reports.transform(real_vessels, EXCLUDED_MMSI_ML).transform(in_focus_area)


def split_sample(reports: DataFrame) -> DataFrame:
    """The balanced sample with its train/test mark. It has at most 30000 rows and is stored before use."""
    rows = reports.select("id", "Type", *FEATURES).na.drop(subset=FEATURES)
    parts = stratified_split(checkpointed(balanced_sample(rows)))
    return checkpointed(parts.repartition(SAMPLE_PARTITIONS, "id"))


def train_and_test(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = split_sample(reports)
    return tuple(rows.where(f"split = '{part}'").drop("split") for part in ("train", "test"))


def knn(train: DataFrame, test: DataFrame) -> DataFrame:
    return knn_predictions(standardised(train, train, FEATURES), standardised(train, test, FEATURES), FEATURES)


def predictions(reports: DataFrame, classifier: str) -> DataFrame:
    train, test = train_and_test(training_rows(reports))
    return knn(train, test) if classifier == "knn" else CLASSIFIERS[classifier](train, test)
