"""Model ranking, costs, failures and guards over tables derived from parts, suppliers, customers and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.inputs import register
from catalog.sqltext import BLANK, in_list, map_case, quote
from foliant import vocab
from foliant.operators import operations as op

CATALOG = """cat AS (SELECT m.*, o.model_name, o.enabled AS model_enabled, o.sort_order AS model_order, o.provider_id, p.provider_type,
    p.enabled AS provider_enabled, p.sort_order AS provider_order FROM metrics m LEFT JOIN models o ON o.model_id = m.model_id
    LEFT JOIN providers p ON p.provider_id = o.provider_id),
  scored AS (SELECT r.request_id, r.profile_id, r.excluded_provider_type, c.*, c.cost_score * f.cost_weight + c.speed_score * f.speed_weight
      + c.quality_score * f.quality_weight AS score FROM model_requests r JOIN profiles f ON f.profile_id = r.profile_id
    JOIN cat c ON c.capability = r.capability AND c.enabled AND c.model_enabled AND c.provider_enabled)"""
RANKS = ["metrics", "models", "providers", "profiles", "model_requests", "profile_providers"]


def ranked(where: str, ties: str) -> str:
    return f"""SELECT request_id, metric_id, model_id, provider_id, CAST(score AS INTEGER) AS score, CAST(row_number() OVER (PARTITION BY
        request_id ORDER BY score DESC, {ties}, metric_id) AS INTEGER) AS rank FROM scored s WHERE {where}"""


register("rank_models",
         lambda t: op.rank_models(t.model_requests, t.metrics, t.models, t.providers, t.profiles, t.profile_providers),
         ranked("capability IN ('Embeddings', 'Audio') OR NOT EXISTS (SELECT 1 FROM profile_providers x WHERE x.profile_id = s.profile_id) "
                "OR EXISTS (SELECT 1 FROM profile_providers x WHERE x.profile_id = s.profile_id AND x.provider_id = s.provider_id)",
                "model_order, provider_order"), RANKS, CATALOG)
register("rank_models_excluding",
         lambda t: op.rank_models_excluding(t.model_requests, t.metrics, t.models, t.providers, t.profiles),
         ranked("provider_type <> excluded_provider_type", "model_order"), RANKS, CATALOG)
register("exclusion_reason", lambda t: op.exclusion_reason(t.metrics, t.models, t.providers),
         """SELECT metric_id, CASE WHEN NOT enabled THEN 'MetricDisabled' WHEN model_name IS NULL THEN 'ModelMissing'
              WHEN NOT model_enabled THEN 'ModelDisabled' WHEN provider_type IS NULL THEN 'ProviderMissing'
              WHEN NOT provider_enabled THEN 'ProviderDisabled' ELSE 'None' END AS reason FROM cat""", RANKS, CATALOG)
register("resolve_profile", lambda t: op.resolve_profile(t.profile_requests, t.profiles, t.settings, t.users),
         """SELECT r.request_id, coalesce(p.profile_id, (SELECT arg_min(s.active_profile_id, s.setting_id) FROM settings s JOIN profiles a
              ON a.profile_id = s.active_profile_id WHERE a.enabled), (SELECT min(profile_id) FROM profiles WHERE enabled AND is_default)) AS profile_id
            FROM profile_requests r LEFT JOIN users u ON u.user_id = r.user_id
            LEFT JOIN profiles p ON p.profile_id = coalesce(r.profile_id, u.profile_id) AND p.enabled""",
         ["profile_requests", "profiles", "settings", "users"])
register("model_price_lookup",
         lambda t: op.model_price_lookup(
             t.request_log_in.join(t.models, "model_id", "left").select(F.coalesce("provider_type", F.lit("Local")).alias("provider_type"),
                                                                       F.coalesce("model_name", F.lit("none")).alias("model_name")),
             t.models, t.providers).select("provider_type", "model_name", *[F.col(c).cast("double").alias(c) for c in (
                 "input_price", "output_price", "embedding_price", "image_price")]),
         """SELECT k.provider_type, k.model_name, m.input_price, m.output_price, m.embedding_price, m.image_price FROM (SELECT DISTINCT
              coalesce(r.provider_type, 'Local') AS provider_type, coalesce(o.model_name, 'none') AS model_name FROM request_log_in r
              LEFT JOIN models o ON o.model_id = r.model_id) k LEFT JOIN (SELECT p.provider_type, o.model_name,
              CAST(o.input_price AS DOUBLE) AS input_price, CAST(o.output_price AS DOUBLE) AS output_price,
              CAST(o.embedding_price AS DOUBLE) AS embedding_price, CAST(o.image_price AS DOUBLE) AS image_price FROM models o JOIN providers p
              ON p.provider_id = o.provider_id) m ON m.provider_type = k.provider_type AND m.model_name = k.model_name""",
         ["request_log_in", "models", "providers"])


def log_rows(t):
    priced = t.request_log_in.drop("provider_type").join(t.models.drop("provider_id", "enabled", "sort_order"), "model_id", "left")
    return priced.withColumn("cost", op.request_cost("capability", F.col("model_name").isNotNull()))


def _units(price: str) -> str:
    return f"CAST(coalesce({price}, 0) * 1000000 AS HUGEINT)"


# whole millionths of a millionth of a dollar: exact on both sides
COST = f"""CASE WHEN model_name IS NULL THEN 0 WHEN capability = 'Embeddings' THEN prompt_tokens * {_units('embedding_price')}
   WHEN capability = 'ImageGeneration' THEN {_units('image_price')} * 1000000
   ELSE prompt_tokens * {_units('input_price')} + completion_tokens * {_units('output_price')} END"""
LOGGED = "request_log_in r LEFT JOIN models m ON m.model_id = r.model_id"


def pico():
    return (F.col("cost").cast("decimal(24,12)") * F.lit(10 ** 12).cast("decimal(13,0)")).cast("bigint").alias("cost_pico")


register("request_cost", lambda t: log_rows(t).select("request_id", pico()),
         f"SELECT request_id, CAST({COST} AS BIGINT) AS cost_pico FROM {LOGGED}", ["request_log_in", "models"])


def failures(t):
    return op.classify_failure(t.request_log_in)


FAILED = """fields AS (SELECT *, CASE WHEN json_valid(body) THEN body END AS j FROM request_log_in),
  coded AS (SELECT *, CASE WHEN json_type(j, '$.detail') = 'OBJECT' AND json_type(j, '$.detail.error') IS NOT NULL THEN j ->> '$.detail.error.code'
      WHEN json_type(j, '$.detail') = 'VARCHAR' THEN NULL WHEN json_type(j, '$.error') = 'OBJECT' THEN j ->> '$.error.code' END AS error_code,
    CASE WHEN json_type(j, '$.detail') = 'OBJECT' AND json_type(j, '$.detail.error') IS NOT NULL THEN j ->> '$.detail.error.message'
      WHEN json_type(j, '$.detail') = 'VARCHAR' THEN j ->> '$.detail' WHEN json_type(j, '$.error') = 'OBJECT' THEN j ->> '$.error.message' END AS error_message
    FROM fields),
  classed AS (SELECT *, CASE WHEN status_code = 429 AND (coalesce(error_code, '') IN ('insufficient_quota', 'quota_exceeded') OR contains(m, 'quota'))
      THEN 'QuotaExceeded' WHEN status_code = 429 THEN 'RateLimited' WHEN status_code IN (401, 403) THEN 'AuthenticationFailure'
    WHEN status_code = 408 THEN 'Timeout' WHEN status_code = 400 AND (coalesce(error_code, '') IN ('moderation_blocked', 'content_policy_violation')
      OR (lower(coalesce(provider_type, '')) = 'gemini' AND (contains(m, 'safety') OR contains(coalesce(body, ''), 'SAFETY') OR contains(lower(coalesce(body, '')), 'blocked')))
      OR contains(m, 'moderation') OR contains(m, 'content policy') OR contains(m, 'safety system')) THEN 'ModerationBlocked'
    WHEN status_code = 400 AND (coalesce(error_code, '') IN ('invalid_prompt', 'prompt_too_long') OR contains(m, 'invalid prompt')) THEN 'InvalidPrompt'
    WHEN status_code IN (500, 502, 503, 504) THEN 'ProviderUnavailable' ELSE 'Unknown' END AS failure
    FROM (SELECT *, lower(coalesce(error_message, '')) AS m FROM coded) z)"""
register("classify_failure", lambda t: failures(t).select("request_id", "error_code", "error_message", "failure"),
         "SELECT request_id, error_code, error_message, failure FROM classed", ["request_log_in"], FAILED)
register("retryable_flag",
         lambda t: failures(t).select("request_id", op.retryable_flag("failure").alias("retryable"), op.user_message("failure").alias("message")),
         f"""SELECT request_id, failure IN ({in_list(vocab.RETRYABLE_FAILURES)}) AS retryable,
               coalesce({map_case('failure', vocab.FAILURE_MESSAGES)}, {quote(vocab.DEFAULT_FAILURE_MESSAGE)}) AS message FROM classed""",
         ["request_log_in"], FAILED)
GUARD = """verdicts AS (SELECT d.doc_id, s.step, s.step_order, v.action, v.reason, v.step IS NULL AS silent FROM documents d, guard_steps s
    LEFT JOIN guard_verdicts v ON v.doc_id = d.doc_id AND v.step = s.step WHERE s.enabled),
  stops AS (SELECT doc_id, arg_min(step, step_order) AS stopped_by, arg_min(CASE WHEN silent THEN 'Error' ELSE action END, step_order) AS action,
    arg_min(CASE WHEN silent THEN 'Pipeline component returned empty response.' ELSE coalesce(reason, '') END, step_order) AS error_message
    FROM verdicts WHERE silent OR action IN ('Block', 'Error') GROUP BY doc_id)"""
register("guard_verdict", lambda t: op.guard_verdict(t.documents, t.guard_steps, t.guard_verdicts),
         """SELECT d.doc_id, s.doc_id IS NULL AS should_continue, stopped_by, action, error_message FROM documents d
            LEFT JOIN stops s ON s.doc_id = d.doc_id""", ["guard_steps", "guard_verdicts"], GUARD)
register("triggered_filters", lambda t: op.triggered_filters(t.findings),
         f"""SELECT request_id, string_agg(name, ',' ORDER BY position) AS filters FROM (SELECT request_id, name, min(position) AS position FROM (
               SELECT *, coalesce(CASE WHEN NOT {BLANK('filter_name')} THEN filter_name END, CASE WHEN NOT {BLANK('processor')} THEN processor END,
                 CASE WHEN NOT {BLANK('code')} THEN code END, type_name) AS name FROM findings) z GROUP BY ALL) y GROUP BY request_id""", ["findings"])
