"""Schemas of the tables that operators exchange and publish."""

from pyspark.sql import types as T


def _schema(**fields: tuple[T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, null) for name, (kind, null) in fields.items()])


_TEXT, _INT, _REAL, _BOOL = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()

CORPUS = _schema(doc_id=(_TEXT, False), text=(_TEXT, False))
QUERIES = _schema(query_id=(_TEXT, False), text=(_TEXT, False))
QRELS = _schema(query_id=(_TEXT, False), doc_id=(_TEXT, False), relevance=(_INT, False))
RUN = _schema(query_id=(_TEXT, False), doc_id=(_TEXT, False), rank=(_INT, False), score=(_REAL, False))
CHUNKS = _schema(chunk_id=(_TEXT, False), doc_id=(_TEXT, False), text=(_TEXT, False))
METRICS = _schema(query_id=(_TEXT, False), measure=(_TEXT, False), value=(_REAL, False))
EVIDENCE = _schema(
    query_id=(_TEXT, False),
    symptom=(_TEXT, False),
    gold_rank=(_INT, True),
    best_relevant=(_TEXT, True),
    top1=(_TEXT, False),
    top1_is_relevant=(_BOOL, False),
    score_margin=(_REAL, True),
    query_gold_overlap=(_REAL, False),
    competitor_gold_overlap=(_REAL, False),
    query_token_count=(_INT, False),
    tied_with_top1=(_BOOL, False),
    gold_score_is_zero=(_BOOL, False),
    retrieved_with_zero_score=(_INT, False),
    rank_before_rerank=(_INT, True),
)
HYPOTHESES = _schema(query_id=(_TEXT, False), kind=(_TEXT, False), confidence=(_REAL, False), producer=(_TEXT, False), because=(_TEXT, False))
DELTAS = _schema(query_id=(_TEXT, False), left_rank=(_INT, True), right_rank=(_INT, True), direction=(_TEXT, False), arbitrary=(_BOOL, False))

SYMPTOMS = ("ok", "rank", "miss")
# The closed vocabularies.
CAUSES = ("hard_negative", "lexical_mismatch", "cross_lingual", "cross_modal", "chunking", "duplicate_collision", "outlier", "rerank_regression", "generation", "unexplained", "score_tie")
#: Causes that a person may name on a labelling sheet.
LABELLABLE = ("hard_negative", "lexical_mismatch", "chunking", "duplicate_collision", "cross_lingual", "outlier", "unexplained")
PRODUCERS = ("rule", "judge", "human")
