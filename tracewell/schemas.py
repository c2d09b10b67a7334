"""The tables of the audit trail. Column names and status words are fixed values that readers rely on."""

from __future__ import annotations

from pyspark.sql import types as T

_FEATURES = """subject_id string NOT NULL, as_of_ts timestamp NOT NULL, ingest_batch_id string NOT NULL, source_row_digest string NOT NULL, split string NOT NULL,
age int, workclass string, fnlwgt int, education string, education_num int, marital_status string, occupation string, relationship string, race string, sex string,
capital_gain int, capital_loss int, hours_per_week int, native_country string, label int NOT NULL"""

_COLUMNS = {
    "features.credit_applications": _FEATURES,
    "features.eval_holdout": _FEATURES,
    "audit.data_snapshots": """data_snapshot_uuid string NOT NULL, table_identifier string NOT NULL, version long NOT NULL, captured_at timestamp NOT NULL, split_filter string, row_count long NOT NULL,
min_as_of_ts timestamp, max_as_of_ts timestamp, content_digest string NOT NULL, schema_json string, status string NOT NULL, expired_at timestamp""",
    "audit.model_versions": """model_version_id string NOT NULL, registered_name string, data_snapshot_uuid string NOT NULL, eval_snapshot_uuid string NOT NULL, trained_at timestamp NOT NULL,
estimator_class string NOT NULL, hyperparams_json string NOT NULL, config_digest string NOT NULL, seed int NOT NULL, artifact_digest string NOT NULL, env_digest string NOT NULL, code_git_sha string NOT NULL,
metrics_json string, status string NOT NULL, retired_at timestamp, retire_reason string, recipe string NOT NULL""",
    "audit.model_coefficients": "model_version_id string NOT NULL, pos int NOT NULL, feature_name string NOT NULL, source_feature string NOT NULL, category string, coefficient double NOT NULL, mean double NOT NULL, centre double NOT NULL, scale double NOT NULL",
    "audit.training_membership": "model_version_id string NOT NULL, subject_id string NOT NULL, role string NOT NULL, row_digest string",
    "audit.predictions": """prediction_id string NOT NULL, prediction_ts timestamp NOT NULL, model_version_id string NOT NULL, subject_id string, input_json string NOT NULL, input_digest string NOT NULL,
score double NOT NULL, threshold double NOT NULL, decision string NOT NULL, explainer_status string NOT NULL, latency_ms double, shap_ms double""",
    "audit.attributions": """prediction_id string NOT NULL, prediction_ts timestamp NOT NULL, model_version_id string NOT NULL, feature_name string NOT NULL, feature_value_str string, shap_value double NOT NULL,
base_value double NOT NULL, abs_rank int NOT NULL, explainer_type string NOT NULL""",
    "audit.fairness_evaluations": """evaluation_id string NOT NULL, model_version_id string NOT NULL, eval_snapshot_uuid string NOT NULL, sensitive_attribute string NOT NULL, group_value string, metric_name string NOT NULL,
metric_value double NOT NULL, n long NOT NULL, evaluated_at timestamp NOT NULL, decision_threshold double NOT NULL, min_group_n int""",
    "audit.fairness_decompositions": """decomposition_id string NOT NULL, baseline_model_id string NOT NULL, candidate_model_id string NOT NULL, counterfactual_a_prime_id string NOT NULL, counterfactual_b_prime_id string NOT NULL,
eval_snapshot_uuid string NOT NULL, sensitive_attribute string NOT NULL, metric_name string NOT NULL, total_delta double NOT NULL, model_effect double NOT NULL, data_effect double NOT NULL, method string NOT NULL,
comparable boolean NOT NULL, computed_at timestamp NOT NULL, decision_threshold double NOT NULL, min_group_n int NOT NULL""",
    "audit.erasure_requests": """request_id string NOT NULL, subject_id string NOT NULL, requested_at timestamp NOT NULL, completed_at timestamp, status string NOT NULL, live_rows_deleted long,
contaminated_model_count int, contaminated_model_ids array<string>, resolution_json string""",
    "audit.snapshot_tombstones": """data_snapshot_uuid string NOT NULL, version long NOT NULL, table_identifier string NOT NULL, expired_at timestamp NOT NULL, reason string NOT NULL, row_count_at_expiry long NOT NULL,
content_digest string NOT NULL, schema_json string NOT NULL, pinned_model_version_ids array<string>, erasure_request_id string""",
    "audit.content_sums": "table_identifier string NOT NULL, split string NOT NULL, n_rows long NOT NULL, lanes array<long> NOT NULL, min_as_of_ts timestamp, max_as_of_ts timestamp",
    "audit.decision_ids": "prediction_id string NOT NULL, prediction_ts timestamp NOT NULL",
    "audit.rejects": "reject_id string NOT NULL, reason string NOT NULL, line string NOT NULL, rejected_at timestamp NOT NULL",
    "audit.commits": "table_identifier string NOT NULL, kind string NOT NULL, at timestamp NOT NULL, buckets array<int>",
}

#: Every stored row also carries the commit that wrote it. Subject and identity tables carry their bucket; subject tables,
#: and the sums of their content, the generation that wrote the file, which is a commit, too.
COMMIT, BUCKET, GENERATION = "commit_seq", "subject_bucket", "generation"
_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType()), "array<int>": T.ArrayType(T.IntegerType()), "array<long>": T.ArrayType(T.LongType())}


def _schema(columns: str) -> T.StructType:
    words = [c.split() for c in columns.split(",")]
    return T.StructType([T.StructField(w[0], _TYPES[w[1]], len(w) == 2) for w in words])


SCHEMAS: dict[str, T.StructType] = {name: _schema(columns) for name, columns in _COLUMNS.items()}
SUBJECT_TABLES = ("features.credit_applications", "features.eval_holdout", "audit.training_membership")
GENERATION_TABLES = (*SUBJECT_TABLES, "audit.content_sums")
ID_TABLES = {"audit.decision_ids": "prediction_id", "audit.rejects": "reject_id"}
DAY_TABLES = {"audit.predictions": "prediction_ts", "audit.attributions": "prediction_ts"}

NUMERIC = ("age", "fnlwgt", "education_num", "capital_gain", "capital_loss", "hours_per_week")
CATEGORICAL = ("workclass", "education", "marital_status", "occupation", "relationship", "race", "sex", "native_country")
BOOKKEEPING = ("subject_id", "as_of_ts", "ingest_batch_id", "source_row_digest", "split", "label")
RAW_FIELDS = ("age", "workclass", "fnlwgt", "education", "education_num", "marital_status", "occupation", "relationship", "race", "sex", "capital_gain", "capital_loss", "hours_per_week", "native_country", "income")
