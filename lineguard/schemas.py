"""Explicit schemas of every stored table; nothing is inferred on read."""

from __future__ import annotations

from pyspark.sql import types as T

from lineguard.params import FEATURE_NAMES

_D, _S, _I, _L, _B, _TS = (
    T.DoubleType(),
    T.StringType(),
    T.IntegerType(),
    T.LongType(),
    T.BooleanType(),
    T.TimestampType(),
)


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


STATS = {f: _D for f in FEATURE_NAMES}

SCAN = _schema(
    relpath=_S, class_name=_S, label=_I, file_bytes=_L, width=_I, height=_I, format=_S, mode=_S,
    sha256=_S, dhash=_S, **STATS, issues=T.ArrayType(_S), issue_text=_S, is_valid=_B,
)
#: CSV cannot hold arrays, so its scan keeps the joined issue text only.
SCAN_CSV = T.StructType([f for f in SCAN.fields if f.name != "issues"])

MANIFEST = _schema(
    relpath=_S, class_name=_S, label=_I, split=_S, group=_S, sha256=_S, dhash=_S,
    width=_I, height=_I, file_bytes=_L,
)

PREDICTION = _schema(
    id=_L, request_id=_S, ts=_TS, ts_iso=_S, model_name=_S, model_run_id=_S, model_threshold=_D,
    source=_S, filename=_S, width=_I, height=_I, file_bytes=_L, **STATS, probability=_D,
    predicted_label=_I, predicted_class=_S, decision=_S, latency_ms=_D, scenario=_S,
)

FEEDBACK = _schema(request_id=_S, ground_truth=_I, arrival=_TS, source=_S)

REFERENCE_STATS = _schema(
    feature=_S, n=_L, mean=_D, std=_D, min=_D, max=_D, p01=_D, p05=_D, p25=_D, p50=_D, p75=_D, p95=_D,
    p99=_D, bin_edges=T.ArrayType(_D), bin_shares=T.ArrayType(_D),
)
REFERENCE_VALUES = _schema(feature=_S, value=_D, n=_L)
REFERENCE_CLASSES = _schema(category=_S, n=_L)
REFERENCE_BASELINE = _schema(name=_S, value=_D)

RUNS = _schema(
    model=_S, arch=_S, run_id=_S, start_time=_L, total_params=_D, threshold=_D, test_f1=_D,
    test_recall=_D, test_precision=_D, test_accuracy=_D, test_roc_auc=_D, latency_p95_ms=_D,
    throughput_ips=_D, train_s=_D, best_epoch=_D, ci_lo=_D, ci_hi=_D,
)

RETRAIN_HISTORY = _schema(ts=_D, ts_iso=_S, reason=_S)
