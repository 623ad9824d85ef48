"""Model ranking, request cost, failures and guard verdicts.

models   model_id, provider_id, model_name, enabled, sort_order, prices…   providers provider_id, provider_type, enabled, sort_order
metrics  metric_id, model_id, capability, enabled, cost_score, speed_score, quality_score
profiles profile_id, enabled, is_default, cost_weight, speed_weight, quality_weight
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from foliant import vocab
from foliant.functions.text import is_blank
from foliant.plans.ranking import join_text

MONEY = "decimal(38,18)"


# ── model ranking ─────────────────────────────────────────────────────────────


def _catalog(metrics: DataFrame, models: DataFrame, providers: DataFrame) -> DataFrame:
    m = models.select("model_id", "provider_id", "model_name", F.col("enabled").alias("model_enabled"),
                      F.col("sort_order").alias("model_order"))
    p = providers.select("provider_id", "provider_type", F.col("enabled").alias("provider_enabled"),
                         F.col("sort_order").alias("provider_order"))
    return metrics.join(m, "model_id", "left").join(p, "provider_id", "left")


def exclusion_reason(metrics: DataFrame, models: DataFrame, providers: DataFrame) -> DataFrame:
    """First reason why a metric is no candidate, or None."""
    reason = (F.when(~F.col("enabled"), "MetricDisabled").when(F.col("model_name").isNull(), "ModelMissing")
              .when(~F.col("model_enabled"), "ModelDisabled").when(F.col("provider_type").isNull(), "ProviderMissing")
              .when(~F.col("provider_enabled"), "ProviderDisabled").otherwise("None"))
    return _catalog(metrics, models, providers).select("metric_id", reason.alias("reason"))


def _scored(requests: DataFrame, metrics: DataFrame, models: DataFrame, providers: DataFrame, profiles: DataFrame) -> DataFrame:
    usable = (_catalog(metrics, models, providers)
              .where(F.col("enabled") & F.col("model_enabled") & F.col("provider_enabled")))
    weighted = requests.join(profiles.select("profile_id", "cost_weight", "speed_weight", "quality_weight"), "profile_id")
    score = (F.col("cost_score") * F.col("cost_weight") + F.col("speed_score") * F.col("speed_weight")
             + F.col("quality_score") * F.col("quality_weight"))
    return weighted.join(usable, "capability").withColumn("score", score)


def rank_models(requests: DataFrame, metrics: DataFrame, models: DataFrame, providers: DataFrame, profiles: DataFrame,
                profile_providers: DataFrame) -> DataFrame:
    """Candidates per request (request_id, profile_id, capability) by weighted score.

    A profile that names providers admits only those, except for embeddings and
    audio, which serve every profile.  A list is ranked once for all requests of a
    profile and capability.
    """
    keys = ["profile_id", "capability"]
    scored = _scored(requests.select(*keys).distinct(), metrics, models, providers, profiles)
    restricted = profile_providers.select("profile_id").distinct().withColumn("_restricted", F.lit(True))
    allowed = profile_providers.select("profile_id", "provider_id").distinct().withColumn("_allowed", F.lit(True))
    free = F.col("capability").isin("Embeddings", "Audio") | F.col("_restricted").isNull()
    kept = (scored.join(restricted, "profile_id", "left").join(allowed, ["profile_id", "provider_id"], "left")
            .where(free | F.col("_allowed")))
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "model_order", "provider_order", "metric_id")
    ranked = kept.select(*keys, "metric_id", "model_id", "provider_id", "score", F.row_number().over(w).alias("rank"))
    return requests.select("request_id", *keys).join(ranked, keys).drop(*keys)


def rank_models_excluding(requests: DataFrame, metrics: DataFrame, models: DataFrame, providers: DataFrame,
                          profiles: DataFrame) -> DataFrame:
    """Candidates without the request's excluded provider type; no profile restriction, ties by model order."""
    keys = ["profile_id", "capability", "excluded_provider_type"]
    kept = (_scored(requests.select(*keys).distinct(), metrics, models, providers, profiles)
            .where(F.col("provider_type") != F.col("excluded_provider_type")))
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "model_order", "metric_id")
    ranked = kept.select(*keys, "metric_id", "model_id", "provider_id", "score", F.row_number().over(w).alias("rank"))
    return requests.select("request_id", *keys).join(ranked, keys).drop(*keys)


def resolve_profile(requests: DataFrame, profiles: DataFrame, settings: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Explicit enabled profile, else the active one of the settings, else the default.

    ``requests``: request_id, profile_id (nullable)[, user_id].  With ``users`` (user_id,
    profile_id) the user's own profile stands in for a missing explicit one.
    """
    asked = requests
    if users is not None:
        asked = (asked.join(users.select("user_id", F.col("profile_id").alias("_own")), "user_id", "left")
                 .withColumn("profile_id", F.coalesce("profile_id", "_own")).drop("_own"))
    enabled = profiles.where(F.col("enabled"))
    active = (settings.join(enabled.select(F.col("profile_id").alias("active_profile_id")), "active_profile_id", "left_semi")
              .agg(F.min_by("active_profile_id", "setting_id").alias("_active")))
    default = enabled.where(F.col("is_default")).agg(F.min("profile_id").alias("_default"))
    explicit = enabled.select("profile_id", F.col("profile_id").alias("_explicit"))
    fallback = F.coalesce(active.scalar(), default.scalar())  # one value each, as scalar subqueries
    return (asked.join(explicit, "profile_id", "left")
            .select("request_id", F.coalesce(F.col("_explicit"), fallback).alias("profile_id")))


def model_price_lookup(keys: DataFrame, models: DataFrame, providers: DataFrame) -> DataFrame:
    """Prices once per distinct (provider_type, model_name); nulls where unknown."""
    known = (models.join(providers.select("provider_id", "provider_type"), "provider_id")
             .groupBy("provider_type", "model_name")
             .agg(F.min_by(F.struct("input_price", "output_price", "embedding_price", "image_price"), "model_id").alias("p")))
    return (keys.select("provider_type", "model_name").distinct().join(known, ["provider_type", "model_name"], "left")
            .select("provider_type", "model_name", "p.*"))


# ── requests ──────────────────────────────────────────────────────────────────


def request_cost(capability: Column | str, priced: Column) -> Column:
    """Cost in dollars from token counts and prices per million; missing prices cost nothing."""
    capability = F.col(capability) if isinstance(capability, str) else capability

    def per_million(tokens: str, price: str) -> Column:
        return (F.col(tokens).cast("decimal(18,6)") / F.lit(1000000).cast("decimal(7,0)")
                * F.coalesce(F.col(price), F.lit(0)).cast("decimal(18,6)"))
    cost = (F.when(capability == "Embeddings", per_million("prompt_tokens", "embedding_price").cast(MONEY))
            .when(capability == "ImageGeneration", F.coalesce(F.col("image_price"), F.lit(0)).cast(MONEY))
            .otherwise((per_million("prompt_tokens", "input_price") + per_million("completion_tokens", "output_price")).cast(MONEY)))
    return F.when(priced, cost).otherwise(F.lit(0).cast(MONEY))


def error_fields(body: Column | str) -> tuple[Column, Column]:
    """Code and message of a JSON error body, wrapped in "detail" or bare."""
    body = F.col(body) if isinstance(body, str) else body

    def at(path: str) -> Column:
        return F.get_json_object(body, path)
    # a JSON object or array comes back as its text, so the first letter tells it from a string
    detail, wrapped, bare = at("$.detail"), at("$.detail.error"), at("$.error")
    is_object = F.startswith(detail, F.lit("{"))
    code = (F.when(is_object & wrapped.isNotNull(), at("$.detail.error.code"))
            .when(detail.isNotNull() & ~is_object, F.lit(None).cast("string"))
            .when(F.startswith(bare, F.lit("{")), at("$.error.code")))
    message = (F.when(is_object & wrapped.isNotNull(), at("$.detail.error.message"))
               .when(detail.isNotNull() & ~is_object, detail)
               .when(F.startswith(bare, F.lit("{")), at("$.error.message")))
    return code, message


def classify_failure(df: DataFrame) -> DataFrame:
    """Adds error_code, error_message and failure from status_code, body and provider_type."""
    code, message = error_fields("body")
    coded = df.withColumn("error_code", code).withColumn("error_message", message)
    status, low = F.col("status_code"), F.coalesce(F.lower("error_message"), F.lit(""))
    ec = F.coalesce("error_code", F.lit(""))
    body = F.coalesce("body", F.lit(""))

    def says(*words: str) -> Column:
        return low.rlike("|".join(words))
    quota = ec.isin("insufficient_quota", "quota_exceeded") | says("quota")
    gemini = (F.lower("provider_type") == "gemini") & (says("safety") | F.contains(body, F.lit("SAFETY"))
                                                       | F.contains(F.lower(body), F.lit("blocked")))
    moderated = (ec.isin("moderation_blocked", "content_policy_violation") | F.coalesce(gemini, F.lit(False))
                 | says("moderation", "content policy", "safety system"))
    invalid = ec.isin("invalid_prompt", "prompt_too_long") | says("invalid prompt")
    return coded.withColumn("failure", F.when((status == 429) & quota, "QuotaExceeded").when(status == 429, "RateLimited")
                            .when(status.isin(401, 403), "AuthenticationFailure").when(status == 408, "Timeout")
                            .when((status == 400) & moderated, "ModerationBlocked").when((status == 400) & invalid, "InvalidPrompt")
                            .when(status.isin(500, 502, 503, 504), "ProviderUnavailable").otherwise("Unknown"))


def retryable_flag(failure: Column | str) -> Column:
    return (F.col(failure) if isinstance(failure, str) else failure).isin(vocab.RETRYABLE_FAILURES)


def user_message(failure: Column | str) -> Column:
    table = F.create_map(*[F.lit(x) for kv in vocab.FAILURE_MESSAGES.items() for x in kv])
    key = F.col(failure) if isinstance(failure, str) else failure
    return F.coalesce(F.try_element_at(table, key), F.lit(vocab.DEFAULT_FAILURE_MESSAGE))


# ── guards ────────────────────────────────────────────────────────────────────


def guard_verdict(documents: DataFrame, steps: DataFrame, verdicts: DataFrame) -> DataFrame:
    """First enabled step, in order, that stops a document; a missing response stops it too.

    ``steps``: step, step_order, enabled.  ``verdicts``: doc_id, step, action, reason.
    Steps a document has verdicts for are aggregated first, so documents are not
    multiplied by steps: the first unanswered step follows from the set of answered ones.
    """
    ordered = steps.where("enabled").agg(F.sort_array(F.collect_list(F.struct("step_order", "step"))).alias("steps"))
    given = (verdicts.join(steps.where("enabled").select("step", "step_order"), "step").groupBy("doc_id").agg(
        F.collect_set("step").alias("answered"),
        F.min(F.when(F.col("action").isin("Block", "Error"),
                     F.struct("step_order", "step", "action", F.coalesce("reason", F.lit("")).alias("reason")))).alias("stop")))
    joined = documents.select("doc_id").join(given, "doc_id", "left").withColumn("steps", ordered.scalar())
    missing = F.get(F.filter("steps", lambda s: ~F.coalesce(F.array_contains("answered", s["step"]), F.lit(False))), F.lit(0))
    silent = F.when(missing.isNotNull(), F.struct(
        missing["step_order"].alias("step_order"), missing["step"].alias("step"), F.lit("Error").alias("action"),
        F.lit("Pipeline component returned empty response.").alias("reason")))
    first = F.array_min(F.array_compact(F.array("stop", silent)))
    return (joined.withColumn("_first", first)
            .select("doc_id", F.col("_first").isNull().alias("should_continue"), F.col("_first.step").alias("stopped_by"),
                    F.col("_first.action").alias("action"), F.col("_first.reason").alias("error_message")))


def triggered_filters(findings: DataFrame) -> DataFrame:
    """Distinct finding names per request in first-seen order, comma-joined.

    ``findings``: request_id, position, type_name and the optional name fields.
    """
    fields = [c for c in vocab.FINDING_NAME_FIELDS if c in findings.columns]
    name = F.coalesce(*[F.when(~is_blank(c), F.col(c)) for c in fields], F.col("type_name"))
    one = (findings.withColumn("name", name).where(~is_blank("name")).groupBy("request_id", "name")
           .agg(F.min("position").alias("position")))
    return one.groupBy("request_id").agg(join_text("name", "position", ",").alias("filters"))
