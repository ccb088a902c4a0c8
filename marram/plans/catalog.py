"""Semantic metrics: versioned definitions that compile to DataFrames.

A metric names a model, one of five aggregations and an expression, or a ratio of two other metrics; its dimensions
come from a closed vocabulary. All definitions here are this library's own.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

VERSION = "1.0.0"
PROFILES = ("ecommerce", "non_ecommerce")
AGGREGATIONS = ("average", "count", "count_distinct", "min", "sum")

#: The closed vocabulary of dimensions, with their types. Fixed values.
DIMENSIONS = {
    "session_date": "date",
    "event_date": "date",
    "session_source": "string",
    "session_medium": "string",
    "session_campaign": "string",
    "device_category": "string",
    "country": "string",
    "region": "string",
    "user_label": "string",
    "page_title": "string",
    "page_location_clean": "string",
    "first_page_title": "string",
    "search_term": "string",
    "event_hour": "integer",
    "event_day_of_week": "integer",
    "traffic_flow_source": "string",
    "traffic_flow_target": "string",
    "item_name": "string",
    "order_label": "string",
    "revenue_range": "string",
    "purchase_count": "integer",
}

#: The date column that a requested period bounds, by model; models without one cover all available data.
TIME = {"sessions": "session_date", "web_events": "event_date", "traffic_flows": "session_date", "labelled_orders": "order_date", "all_orders": "order_date", "users": None}


class CatalogError(ValueError):
    def __init__(self, code: str, detail: str):
        super().__init__(f"{code}: {detail}")
        self.code = code


@dataclass(frozen=True)
class Metric:
    id: str
    model: str
    aggregation: str = "count"
    expression: str = "*"
    dimensions: tuple[str, ...] = ()
    filter: str | None = None
    #: For ratios: (numerator, denominator) as (aggregation, expression, filter).
    ratio: tuple[tuple[str, str, str | None], tuple[str, str, str | None]] | None = None
    profiles: tuple[str, ...] = PROFILES
    label: str = ""
    aliases: tuple[str, ...] = field(default=())
    #: Filters of profiles whose meaning of the metric differs: such a metric is asked for with a profile only.
    filters: tuple[tuple[str, str], ...] = ()
    #: Profiles in which the definitions found so far disagree: nothing is published there.
    conflicts: tuple[str, ...] = ()

    def __post_init__(self):
        if self.aggregation not in AGGREGATIONS or self.model not in TIME:
            raise CatalogError("invalid_metric_definition", self.id)
        if unknown := set(self.dimensions) - set(DIMENSIONS):
            raise CatalogError("invalid_metric_definition", f"{self.id}: {sorted(unknown)}")

    @property
    def date_scope(self) -> str:
        return "requested_period" if TIME[self.model] else "all_available_data"


def _by(base: str, model: str, dimensions: tuple[str, ...], name: str, **more) -> Metric:
    return Metric(name, model, dimensions=dimensions, label=base, **more)


_USERS = {"aggregation": "count_distinct", "expression": "user_pseudo_id"}
_SHOP = {"profiles": ("ecommerce",)}
#: Whole cents, so that a sum does not depend on the order of rows.
_CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"

METRICS = {
    m.id: m
    for m in (
        Metric("total_sessions", "sessions", "count_distinct", "session_uid", label="Sessions", aliases=("工作階段",)),
        Metric("total_users", "sessions", **_USERS, label="Users", aliases=("使用者",)),
        Metric("users_by_label", "sessions", **_USERS, dimensions=("user_label",), label="New and returning users"),
        _by("Sessions by day", "sessions", ("session_date",), "sessions_by_date"),
        _by("Sessions by source", "sessions", ("session_source",), "sessions_by_source"),
        _by("Sessions by source and medium", "sessions", ("session_source", "session_medium"), "sessions_by_source_medium"),
        _by("Sessions by campaign", "sessions", ("session_campaign",), "sessions_by_campaign"),
        _by("Sessions by device", "sessions", ("device_category",), "sessions_by_device"),
        _by("Users by country and region", "sessions", ("country", "region"), "users_by_country_region", **_USERS),
        _by("Sessions by landing page", "sessions", ("first_page_title",), "sessions_by_landing_page"),
        Metric("engagement_by_source_medium", "sessions", "sum", "n_events", ("session_source", "session_medium"), "NOT bounced", label="Engaged events"),
        Metric("bounce_rate_by_landing_page", "sessions", dimensions=("first_page_title",), ratio=(("count", "*", "bounced"), ("count", "*", None)), label="Bounce rate"),
        Metric("returning_user_share", "sessions", ratio=(("count_distinct", "user_pseudo_id", "user_label = 'returning_user'"), ("count_distinct", "user_pseudo_id", None)), label="Returning user share"),
        _by("Events by page", "web_events", ("page_title",), "events_by_page"),
        _by("Events by address", "web_events", ("page_location_clean",), "events_by_address"),
        _by("Events by day", "web_events", ("event_date",), "events_by_date"),
        _by("Events by hour", "web_events", ("event_hour",), "events_by_hour"),
        _by("Events by weekday", "web_events", ("event_day_of_week",), "events_by_dow"),
        _by("Events by hour and weekday", "web_events", ("event_hour", "event_day_of_week"), "events_by_hour_dow"),
        Metric("search_terms_count", "web_events", dimensions=("search_term",), filter="search_term IS NOT NULL", label="Site searches"),
        Metric("count_generate_leads", "web_events", filter="event_type = 'signup'", label="Leads", aliases=("潛在客戶",)),
        Metric("total_conversions", "web_events", label="Conversions", filters=(("ecommerce", "event_type = 'purchase'"), ("non_ecommerce", "event_type = 'signup'"))),
        Metric("engagement", "sessions", "sum", "n_events", filter="NOT bounced", label="Engaged events of all sources"),
        Metric("attributed_conversions_by_source", "sessions", "sum", "n_purchases", ("session_source",), "n_purchases > 0", label="Conversions by source", **_SHOP),
        Metric("attributed_conversions_by_campaign", "sessions", "sum", "n_purchases", ("session_campaign",), "n_purchases > 0", label="Conversions by campaign", **_SHOP),
        Metric("session_value", "sessions", profiles=(), conflicts=PROFILES, label="Session value"),
        Metric("total_revenue", "all_orders", "sum", _CENTS, label="Revenue in cents", aliases=("營收",), **_SHOP),
        Metric("aov", "all_orders", ratio=(("sum", _CENTS, None), ("count", "*", None)), label="Average order value in cents", aliases=("客單價",), **_SHOP),
        Metric("first_event_by_page", "web_events", "min", "event_date", ("page_title",), label="First seen by page"),
        _by("Steps between pages", "traffic_flows", ("traffic_flow_source", "traffic_flow_target"), "traffic_flow_edges"),
        _by("Orders by kind", "labelled_orders", ("order_label",), "orders_by_label", **_SHOP),
        Metric("buyers_by_order_label", "labelled_orders", "count_distinct", "o_custkey", ("order_label",), label="Buyers by order kind", **_SHOP),
        _by("Users by purchases", "users", ("purchase_count",), "purchase_count_hist", **_SHOP),
        _by("Users by revenue", "users", ("revenue_range",), "revenue_range_hist", **_SHOP),
        Metric("avg_repurchase_count", "users", "average", "purchase_count", filter="purchase_count > 1", label="Average repurchase count", aliases=("平均回購次數",), **_SHOP),
        Metric("repurchase_rate", "users", ratio=(("count", "*", "purchase_count > 1"), ("count", "*", "purchase_count > 0")), label="Repurchase rate", **_SHOP),
    )
}


def metric(metric_id: str, profile: str | None = None) -> Metric:
    """A published metric, as ``profile`` defines it. One that profiles define differently needs a profile."""
    if metric_id not in METRICS:
        raise CatalogError("unsupported_metric", metric_id)
    if profile is not None and profile not in PROFILES:
        raise CatalogError("invalid_semantic_profile", profile)
    m = METRICS[metric_id]
    wanted = PROFILES if profile is None else (profile,)
    if not set(wanted) & set(m.profiles):
        conflict = set(wanted) & set(m.conflicts)
        raise CatalogError("metric_definition_conflict" if conflict else "unsupported_metric", f"{metric_id} in {', '.join(wanted)}")
    if not m.filters:
        return m
    if profile is None:
        raise CatalogError("semantic_profile_required", metric_id)
    return replace(m, filter=dict(m.filters)[profile], filters=())


def published(metric_id: str) -> list[str]:
    """Profiles in which a metric is published; none is an error that says why."""
    if metric_id not in METRICS or not METRICS[metric_id].profiles:
        metric(metric_id)
    return [p for p in PROFILES if p in METRICS[metric_id].profiles]


def common_profiles(metric_ids: list[str]) -> list[str]:
    """Profiles in which all of the metrics are published; without any, the selection is not supported."""
    each = [published(m) for m in metric_ids]
    common = [p for p in PROFILES if all(p in ps for ps in each)]
    if not common:
        raise CatalogError("unsupported_metric", f"no common profile of {', '.join(metric_ids)}")
    return common


def resolved_profile(metric_ids: list[str], profile: str | None) -> tuple[str, str]:
    """(profile, how it was found): the one asked for, the only common one, or any if all define the metrics alike."""
    common = common_profiles(metric_ids)
    if profile is not None:
        for m in metric_ids:
            metric(m, profile)
        return profile, "requested"
    if len(common) == 1:
        return common[0], "only_common_profile"
    if any(METRICS[m].filters for m in metric_ids):
        raise CatalogError("semantic_profile_required", ", ".join(metric_ids))
    return common[0], "same_in_all_profiles"
