"""Schemas of the tables that operators exchange."""

from pyspark.sql import types as T


def _s(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


L, D, S, B, I = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.IntegerType()

CLIPS = _s(("clip", S), ("path", S), ("fps", D), ("duration_s", D), ("split", S))
FRAMES = _s(("clip", S), ("idx", L), ("mag", T.ArrayType(D)))
DETECTIONS = _s(("clip", S), ("id", L), ("t", L), ("frame", L), ("fps", D), ("conf", D), ("onset", D), ("r1", D), ("r2", D), ("flatness", D), ("attack", D), ("score", D), ("e_low_ratio", D), ("e_high_ratio", D), ("motion_confirmed", B), ("pov_dominant", B))
REFERENCES = _s(("clip", S), ("id", L), ("t", L), ("source", S))
EVALUATION = _s(("clip", S), ("n_gt", L), ("n_det", L), ("tp", L), ("fp", L), ("fn", L), ("precision", D), ("recall", D), ("f1", D))
MANIFEST = _s(("record_type", S), ("audit_id", S), ("clip", S), ("reason", S), ("t", L), ("conf", D), ("distance", L), ("hints", T.MapType(S, S)), ("human_primary", S), ("notes", S))
SPLIT = _s(("rel_path", S), ("split", S))
LOGREG = _s(("weights", T.ArrayType(D)), ("bias", D), ("mean", T.ArrayType(D)), ("std", T.ArrayType(D)))
