"""Declared schemas of the pipeline tables; nothing is inferred from a file."""

from pyspark.sql import types as T

from linksift.functions.vocabulary import FEATURES, PAGE_FEATURES


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


LINKS = _struct(id=T.LongType(), url=T.StringType(), label=T.IntegerType())
PLAIN_LINKS = _struct(url=T.StringType(), label=T.IntegerType())
LINK_FEATURES = _struct(
    id=T.LongType(), **{f: T.IntegerType() for f in FEATURES}, label=T.IntegerType()
)
PLAIN_FEATURES = T.StructType([f for f in LINK_FEATURES if f.name != "id"])
PAGES = _struct(
    id=T.LongType(), **{f: T.DoubleType() for f in PAGE_FEATURES}, CLASS_LABEL=T.IntegerType()
)
METRICS = _struct(
    model=T.StringType(),
    accuracy=T.DoubleType(),
    precision=T.DoubleType(),
    recall=T.DoubleType(),
    f1_score=T.DoubleType(),
    auc_roc=T.DoubleType(),
    confusion_matrix=T.ArrayType(T.ArrayType(T.LongType())),
    cv_mean=T.DoubleType(),
    cv_std=T.DoubleType(),
)
ROC = _struct(
    model=T.StringType(),
    auc_roc=T.DoubleType(),
    rank=T.LongType(),
    threshold=T.DoubleType(),
    fpr=T.DoubleType(),
    tpr=T.DoubleType(),
)
IMPORTANCE = _struct(
    model=T.StringType(),
    feature=T.StringType(),
    importance=T.DoubleType(),
    rank=T.IntegerType(),
)
FEATURE_NAMES = _struct(position=T.IntegerType(), feature=T.StringType())
