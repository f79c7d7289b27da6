"""Fixed schemas of the stage tables; nothing is ever inferred from data."""

from pyspark.sql.types import (
    ArrayType, DoubleType, IntegerType, StringType, StructField, StructType,
)


def _struct(**cols) -> StructType:
    return StructType([StructField(name, dtype) for name, dtype in cols.items()])


RAW = _struct(
    book=StringType(), chapter=StringType(), verse=StringType(),
    subtitle=StringType(), text=StringType(), source_url=StringType(),
)

PROCESSED = _struct(
    id=IntegerType(), book=StringType(), chapter=IntegerType(), verse=IntegerType(),
    subtitle=StringType(), text=StringType(), verse_id=StringType(),
    source_url=StringType(), theme=StringType(), emotion=StringType(),
)

LABELED = PROCESSED

ANNOTATION = _struct(id=StringType(), verse_id=StringType(), label=StringType())

SAMPLE = _struct(id=IntegerType(), verse_id=StringType(), verse=StringType())

EVAL_INPUT = _struct(
    input_text=StringType(), expected_emotion=StringType(), expected_theme=StringType(),
)

EVAL_RESULT = StructType(EVAL_INPUT.fields + _struct(
    pred_emotion=StringType(), emotion_score=DoubleType(),
    pred_theme=StringType(), theme_score=DoubleType(),
    emotion_match=StringType(), theme_match=StringType(),
).fields)

REQUIRED_RAW = ["book", "chapter", "verse", "text"]

PREDICTIONS = ArrayType(_struct(label=StringType(), score=DoubleType()))
