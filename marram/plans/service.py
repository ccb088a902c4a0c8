"""The two calls of the service: a tenant's traffic report, and metrics of the catalog, from request to answer.

Either resolves the tenant, checks dates and cost before a query is made, makes and runs it under a time limit, and shapes
the rows. The service only reads: a dataset whose session table has not been built (``sessions.prepare``) is not available.
An error carries what was known of the tenant by then in ``request``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marram.operators import metrics, registry, traffic
from marram.plans import sessions
from marram.plans.catalog import VERSION, metric, resolved_profile
from marram.plans.policy import Make, Policy, Run, execute
from marram.sources.tables import listing

#: The tables that a model reads besides sessions, whose files cost.
SOURCES = {"web_events": ("events",), "traffic_flows": ("events",), "users": ("orders", "customer"), "labelled_orders": ("orders",), "all_orders": ("orders",)}


@dataclass(frozen=True)
class Service:
    spark: SparkSession
    tenants: DataFrame
    #: The dataset directory of a tenant.
    directory: Callable[[registry.Tenant], str]
    today: date
    policy: Policy = Policy()
    #: Bytes that this service's queries have read so far, by day.
    spent: dict[date, int] = field(default_factory=dict)

    def traffic_summary(self, customer: str, start: str, end: str, include_query: bool = False) -> dict:
        """The period-over-period report of a customer as its validated contract."""
        request = {"requested_name": customer, "resolved_name": None, "match_type": None}
        try:
            first, last = self.policy.dates(start, end, self.today, comparison_periods=1)
            tenant = self._resolve(customer, request)
            directory, before = self.directory(tenant), first - (last - first) - timedelta(days=1)
            make: Make = lambda watch: traffic.traffic_summary(self.spark, directory, first, last, watch)
            runs = self._execute({"traffic_summary": make}, {"traffic_summary": lambda: sessions.cost(self.spark, directory, before, last, "visitors")}, 1, start, end)
            answer = {"customer": request, "report": traffic.contract(runs[0].rows)}
        except Exception as e:
            e.request = request
            raise
        return answer | self._provenance(runs, include_query)

    def metrics(self, customer: str, metric_ids: list[str], start: str, end: str, limit: int = metrics.ROWS, include_query: bool = False) -> dict:
        """Up to five metrics of a customer. Those without dimensions that share a model are computed in one aggregation."""
        request = {"requested_name": customer, "resolved_name": None, "match_type": None}
        try:
            ids = metrics.request_ids(metric_ids)
            period = self.policy.dates(start, end, self.today)
            limit = max(1, min(metrics.MOST_ROWS, limit))
            tenant = self._resolve(customer, request)
            profile, _ = resolved_profile(ids, tenant.profile)
            own, directory = [metric(i, profile) for i in ids], self.directory(tenant)
            single: dict[str, list[str]] = {}
            for m in own:
                if not m.dimensions:
                    single.setdefault(m.model, []).append(m.id)
            queries: dict[str, Make] = {f"{model}_totals": lambda watch, names=names: metrics.fused(self.spark, directory, names, period, profile, watch) for model, names in single.items()}
            of = {f"{model}_totals": model for model in single}
            for m in own:
                if m.dimensions:
                    queries[m.id] = lambda watch, m=m: metrics.compute(self.spark, directory, m.id, period, profile, watch).orderBy(F.desc(m.id), *m.dimensions).limit(limit + 1)
                    of[m.id] = m.model
            costs = {name: lambda model=model: self._cost(directory, model, period) for name, model in of.items()}
            runs = self._execute(queries, costs, limit, start, end)
        except Exception as e:
            e.request = request
            raise
        found, answers = {r.name: r.rows for r in runs}, []
        for m in own:
            rows = [r.asDict(recursive=True) for r in found[m.id if m.dimensions else f"{m.model}_totals"]]
            rows = [{c: r[c] for c in (*m.dimensions, m.id)} for r in rows]
            answers.append({"metric_id": m.id, "date_scope": m.date_scope, "dimensions": list(m.dimensions), "rows": rows[:limit], "truncated": len(rows) > limit})
        head = {"customer": request, "catalog_version": VERSION, "profile": profile, "profile_resolution": "tenant", "period": {"start_date": start, "end_date": end}}
        return head | {"metrics": answers} | self._provenance(runs, include_query)

    def _cost(self, directory: str, model: str, period: tuple[date, date]) -> int:
        """File bytes that a model's rows of a period can need: of sessions the wanted days', of other tables all."""
        if model == "sessions":
            return sessions.cost(self.spark, directory, *period)
        return sum(listing(self.spark, f"{directory}/{t}.parquet").agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0] for t in SOURCES[model])

    def _execute(self, queries: dict[str, Make], costs: dict[str, Callable[[], int]], most_rows: int, start: str, end: str) -> list[Run]:
        runs = execute(self.spark, queries, costs, self.policy, most_rows, {"start_date": start, "end_date": end}, self.spent.get(self.today, 0))
        self.spent[self.today] = self.spent.get(self.today, 0) + sum(r.estimated_bytes for r in runs)
        return runs

    def _resolve(self, customer: str, request: dict) -> registry.Tenant:
        try:
            tenant = registry.resolve(self.tenants, customer)
        except registry.TenantError as e:
            request |= {k: v for k, v in e.context.items() if k in request}
            raise
        request |= {"resolved_name": tenant.name, "match_type": tenant.match_type}
        return tenant

    @staticmethod
    def _provenance(runs: list, wanted: bool) -> dict:
        return {"query_provenance": [r.record() for r in runs]} if wanted else {}
