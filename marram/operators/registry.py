"""Customer registry: name resolution, listings, and data-quality rules.

A registry row has tenant_id, tenant_name, project_id, status, ec, aliases (delimited by ``|``).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marram.functions.text import aliases, blank_to_null, fold, folded, folded_any, folded_lists, folded_plain, is_plain
from marram.sources.tables import shared_dir

SCHEMA = "tenant_id string, tenant_name string, project_id string, status string, ec boolean, aliases string"
CANDIDATES = 22
MATCHES = ("exact", "alias", "partial")

#: Words too general to name a customer. Fixed values.
GENERIC = ("公司", "企業", "集團", "有限公司", "股份有限公司", "有限責任公司", "company", "co", "co.", "corporation", "corp", "inc", "inc.", "incorporated", "ltd", "ltd.", "limited", "group")
#: Characters of the substrings that names are looked up by.
GRAM = 3
#: Names that one task of the index takes; each gives some forty rows.
NAMES_A_TASK = 50_000
#: Bytes of lookups that are sent to the index at most; more meet it in a join that deals frequent substrings to several tasks.
SENT_BYTES = 8 << 20
#: Tenants that an issue names at most, the smallest ids; all are counted.
SHOWN = 100


def prepared(registry: DataFrame) -> DataFrame:
    """The registry with what all its queries ask for: ``normalized_name`` (null without a name) and ``alias_keys``, a tenant's aliases as
    (alias_no, alias, normalized_alias). Store it: only names and aliases beyond ASCII are folded in Python, and only here.
    """
    parts = aliases(F.col("aliases"))
    keys = lambda folds: F.transform(F.arrays_zip(parts.alias("alias"), folds.alias("key")), lambda x, i: F.struct(i.alias("alias_no"), x["alias"].alias("alias"), x["key"].alias("normalized_alias")))
    name = F.when(blank_to_null(F.col("tenant_name")).isNotNull(), F.col("tenant_name"))
    plain = is_plain(F.col("tenant_name")) & is_plain(F.col("aliases"))
    own = registry.where(plain).withColumns({"normalized_name": folded_plain(name), "alias_keys": keys(F.transform(parts, folded_plain))})
    other = registry.where(~plain).withColumns({"normalized_name": folded_any(name), "alias_keys": keys(folded_lists(parts))})
    return own.unionByName(other)


def _ready(registry: DataFrame) -> DataFrame:
    return registry if "alias_keys" in registry.columns else prepared(registry)


def named(registry: DataFrame) -> DataFrame:
    """Rows with a name, and its folded form; rows without are left out."""
    if "normalized_name" in registry.columns:
        return registry.where("normalized_name IS NOT NULL")
    rows = registry.where(blank_to_null(F.col("tenant_name")).isNotNull())
    return rows.withColumn("normalized_name", folded(F.col("tenant_name")))


def alias_rows(registry: DataFrame) -> DataFrame:
    """A row per alias of a named tenant, with its folded form; tenants without aliases have none."""
    return named(_ready(registry)).select("*", F.inline("alias_keys")).drop("alias_keys")


def matches(registry: DataFrame, name: str) -> DataFrame:
    """Exact, alias and partial matches of a name; a tenant can match in several ways, once for each alias."""
    wanted = F.lit(fold(name))
    columns = [*SCHEMA.replace(",", "").split()[::2], "normalized_name"]
    kinds = (
        (named(registry).where(F.col("normalized_name") == wanted), "exact"),
        (alias_rows(registry).where(F.col("normalized_alias") == wanted), "alias"),
        (named(registry).where(F.contains("normalized_name", wanted)), "partial"),
    )
    out = None
    for i, (rows, kind) in enumerate(kinds):
        rows = rows.select(*columns, F.lit(kind).alias("match_type"), F.lit(i).alias("match_order"))
        out = rows if out is None else out.unionByName(rows)
    return out


def candidates(registry: DataFrame, name: str) -> DataFrame:
    """The first matches by kind, name and id: a top-k that never sorts the whole registry."""
    return matches(registry, name).orderBy("match_order", "normalized_name", "tenant_id").limit(CANDIDATES)


def matches_of(registry: DataFrame, requests: DataFrame) -> DataFrame:
    """Batch resolution of ``requests`` (name): exact and alias matches by an equi-join on the folded key."""
    registry, wanted = _ready(registry), requests.select("name", folded(F.col("name")).alias("key"))
    keys = named(registry).select("tenant_id", F.col("normalized_name").alias("key"), F.lit("exact").alias("match_type"))
    keys = keys.unionByName(alias_rows(registry).select("tenant_id", F.col("normalized_alias").alias("key"), F.lit("alias").alias("match_type")))
    return wanted.join(keys, "key").select("name", "tenant_id", "match_type")


def _grams(text: Column, sizes: Column) -> Column:
    """Distinct substrings of a text, of the given sizes."""
    of = lambda k: F.transform(F.when(F.length(text) >= k, F.sequence(F.lit(1), F.length(text) - k + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.substr(text, i, k))
    return F.array_distinct(F.flatten(F.transform(sizes, of)))


def postings(registry: DataFrame) -> DataFrame:
    """(gram, tenant_id, normalized_name): a row for every distinct substring of up to ``GRAM`` characters of a tenant's folded name.

    Its files are tiny for the rows they hold, so names are dealt by their number: no task writes or reads back most of the index.
    """
    rows = named(_ready(registry)).select("tenant_id", "normalized_name")
    rows = rows.repartition(rows.count() // NAMES_A_TASK + 1)
    return rows.select(F.explode(_grams(F.col("normalized_name"), F.sequence(F.lit(1), F.lit(GRAM)))).alias("gram"), "*")


def partial_matches(index: DataFrame, requests: DataFrame) -> DataFrame:
    """(name, tenant_id, normalized_name): tenants whose folded name holds a requested one; ``index`` as ``postings``, ``requests`` has name.

    A request is looked up by its rarest gram alone, and what that finds is verified. Repeated requests count once; null and blank ones
    match nothing. The lookups are stored before they meet the index, so that their size is known: up to ``SENT_BYTES`` of them are sent to
    the index, whatever the session broadcasts by itself, and it is read in place and never shuffled.
    """
    wanted = requests.select("name").distinct().withColumn("key", folded(F.col("name"))).where("key <> ''")
    own = wanted.select("name", "key", F.explode(_grams(F.col("key"), F.array(F.least(F.length("key"), F.lit(GRAM))))).alias("gram"))
    counts = index.groupBy("gram").agg(F.count("*").alias("n"))
    # A gram that no name has leaves a request without a match: it is the rarest.
    rarest = own.join(counts, "gram", "left").groupBy("name", "key").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("x")).where("x.n > 0")
    path = f"{shared_dir(index.sparkSession)}/lookups-{uuid.uuid4().hex}"
    rarest.select("name", "key", "x.gram", "x.n").write.parquet(path)
    lookups = index.sparkSession.read.schema("name string, key string, gram string, n long").parquet(path)
    size = lookups.agg(F.coalesce(F.sum(F.octet_length("name") + F.octet_length("key") + 64), F.lit(0))).first()[0]
    if size <= SENT_BYTES:
        found = index.join(F.broadcast(lookups), "gram")
    else:
        every = lookups.withColumn("group", F.explode(F.sequence(F.lit(0), _last_group())))
        found = _in_groups(index, counts, lookups).join(every, ["gram", "group"])
    return found.where(F.contains("normalized_name", F.col("key"))).select("name", "tenant_id", "normalized_name")


def _last_group() -> Column:
    return F.floor(F.col("n") / NAMES_A_TASK).cast("int")


def _in_groups(index: DataFrame, counts: DataFrame, lookups: DataFrame) -> DataFrame:
    """``index`` with a ``group``. All names may share a gram, so a frequent one's rows are dealt to groups of some ``NAMES_A_TASK``, which its
    lookups all meet, and no task takes the gram whole. Rows of a frequent gram that no lookup has are left out.
    """
    asked = lookups.select("gram").distinct().withColumn("asked", F.lit(True))
    frequent = counts.select("gram", _last_group().alias("last")).where("last > 0").join(asked, "gram", "left")  # at most one for NAMES_A_TASK rows of the index
    group = F.pmod(F.xxhash64("tenant_id", "normalized_name"), F.coalesce("last", F.lit(0)) + 1).cast("int")
    return index.join(F.broadcast(frequent), "gram", "left").where("last IS NULL OR asked").withColumn("group", group).drop("last", "asked")


def resolutions(registry: DataFrame, index: DataFrame, requests: DataFrame) -> DataFrame:
    """(name, rank, tenant_id, match_type): the first ``CANDIDATES`` matches of each request, as ``candidates`` has them for one."""
    names = named(_ready(registry)).select("tenant_id", "normalized_name").distinct()
    known = matches_of(registry, requests.select("name").distinct()).join(names, "tenant_id")
    every = known.unionByName(partial_matches(index, requests).withColumn("match_type", F.lit("partial")))
    order = F.array_position(F.lit(list(MATCHES)), F.col("match_type"))
    rank = F.row_number().over(Window.partitionBy("name").orderBy(order, "normalized_name", "tenant_id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= CANDIDATES).select("name", "rank", "tenant_id", "match_type")


class TenantError(LookupError):
    """An unresolved name; ``code`` says why, ``context`` what is known so far."""

    def __init__(self, code: str, requested: str, **context):
        super().__init__(f"{code}: {requested}")
        self.code, self.context = code, {"requested_name": requested, "resolved_name": None, "match_type": None} | context


@dataclass(frozen=True)
class Tenant:
    tenant_id: str
    name: str
    project_id: str
    profile: str
    match_type: str


def resolve(registry: DataFrame, name: str) -> Tenant:
    """The one active tenant of a name: a formal name before an alias; a partial match only asks back."""
    if not isinstance(name, str) or not fold(name):
        raise TenantError("invalid_customer_name", str(name))
    rows = candidates(registry, name).collect()
    best = [r for r in rows if r.match_type == rows[0].match_type] if rows else []
    if not best:
        raise TenantError("tenant_not_found", name)
    kind = best[0].match_type
    if kind == "partial":
        if fold(name) in GENERIC or len(fold(name)) < 2 or len(best) > CANDIDATES - 2:
            raise TenantError("customer_name_too_broad", name)
        code = "tenant_confirmation_required" if len(best) == 1 else "ambiguous_tenant"
        raise TenantError(code, name, candidates=[r.tenant_name for r in best])
    if len(best) > 1:
        raise TenantError("ambiguous_tenant", name, candidates=[r.tenant_name for r in best])
    r = best[0]
    known = {"resolved_name": r.tenant_name, "match_type": kind}
    if (r.status or "").strip().lower() != "active":
        raise TenantError("tenant_inactive", name, **known)
    if not (r.project_id or "").strip():
        raise TenantError("data_unavailable", name, **known)
    if not all(c.isascii() and (c.isalnum() or c in "_-") for c in r.project_id):
        raise TenantError("invalid_tenant_routing", name, **known)
    return Tenant(r.tenant_id, r.tenant_name, r.project_id, "ecommerce" if r.ec else "non_ecommerce", kind)


def active_customers(registry: DataFrame) -> DataFrame:
    """Active tenants whose folded name only one row has, whatever that row's status."""
    rows = named(registry)
    once = rows.groupBy("normalized_name").agg(F.count("*").alias("n")).where("n = 1").select("normalized_name")
    active = F.lower(F.trim("status")) == "active"
    profile = F.when(F.col("ec"), "ecommerce").otherwise("non_ecommerce")
    return rows.where(active).join(once, "normalized_name", "left_semi").select("tenant_id", "tenant_name", "normalized_name", profile.alias("profile"))


def quality_issues(registry: DataFrame) -> DataFrame:
    """(code, tenant_ids, n_tenants, alias) of every violated rule. Rows without a name are not judged.

    An alias that very many tenants have is one issue: its tenants are counted, and the ``SHOWN`` smallest ids are listed,
    so that no row grows with the registry.
    """
    none = F.lit(None).cast("string")
    registry = _ready(registry)
    names, parts = named(registry), alias_rows(registry)
    raw = F.split("aliases", "[|]")
    repeated = parts.groupBy("tenant_id", "normalized_name", "normalized_alias").agg(F.count("*").alias("n"), F.max_by("alias", "alias_no").alias("alias")).where("n > 1")
    # A row a key and tenant: how often it is a formal name and an alias there.
    formal = names.select(F.col("normalized_name").alias("key"), "tenant_id", F.lit(1).alias("formal"), F.lit(0).alias("aliased"), none.alias("alias"), F.lit(0).alias("alias_no"))
    pairs = formal.unionByName(parts.select(F.col("normalized_alias").alias("key"), "tenant_id", F.lit(0).alias("formal"), F.lit(1).alias("aliased"), "alias", "alias_no"))
    shown = F.min(F.when(F.col("aliased") == 1, F.struct("alias_no", "alias")))
    pairs = pairs.groupBy("key", "tenant_id").agg(F.sum("formal").alias("formal"), F.sum("aliased").alias("aliased"), shown.alias("shown"))
    is_formal, is_alias = F.col("formal") > 0, F.col("aliased") > 0
    first = F.min(F.when(is_alias, F.struct("tenant_id", F.col("shown.alias").alias("alias"))))["alias"]
    keys = pairs.groupBy("key").agg(F.sum("formal").alias("formal_rows"), F.sum("aliased").alias("alias_rows"), F.count_if(is_formal).alias("n_formal"), F.count_if(is_alias).alias("n_alias"), F.count("*").alias("n_all"), first.alias("alias"))
    # The same tenants are on both sides only if each is as many as all.
    conflict = (F.col("n_formal") > 0) & (F.col("n_alias") > 0) & ((F.col("n_formal") < F.col("n_all")) | (F.col("n_alias") < F.col("n_all")))
    kinds = (
        ("duplicate_formal_name", F.col("formal_rows") > 1, is_formal, "n_formal", none),
        ("duplicate_alias_across_tenants", F.col("alias_rows") > 1, is_alias, "n_alias", F.col("alias")),
        ("alias_conflicts_with_formal_name", conflict, F.lit(True), "n_all", F.col("alias")),
    )
    cases = F.array_compact(F.array(*[F.when(broken, F.struct(F.lit(code).alias("code"), F.col(n).alias("n_tenants"), alias.alias("alias"))) for code, broken, _, n, alias in kinds]))
    broken = keys.select("key", F.explode(cases).alias("case"))
    member = F.create_map(*[x for code, _, belongs, _, _ in kinds for x in (F.lit(code), belongs)])
    listed = broken.join(pairs, "key").where(member[F.col("case.code")])
    rank = F.row_number().over(Window.partitionBy("case.code", "key").orderBy("tenant_id"))
    listed = listed.withColumn("rank", rank).where(F.col("rank") <= SHOWN)
    many = listed.groupBy("key", "case").agg(F.array_sort(F.collect_list("tenant_id")).alias("tenant_ids")).select("case.code", "tenant_ids", "case.n_tenants", "case.alias")
    # What a row tells by itself comes from one scan.
    issue = lambda code, alias: F.struct(F.lit(code).alias("code"), alias.cast("string").alias("alias"))
    empty = F.when(blank_to_null(F.col("aliases")).isNotNull() & F.exists(raw, lambda a: F.trim(a) == ""), F.array(issue("empty_alias", none)))
    of_alias = lambda code, broken: F.transform(F.filter("alias_keys", broken), lambda k: issue(code, k["alias"]))
    own = F.concat(F.coalesce(empty, F.array().cast("array<struct<code:string,alias:string>>")), of_alias("generic_alias", lambda k: k["normalized_alias"].isin(*GENERIC)), of_alias("alias_matches_formal_name", lambda k: k["normalized_alias"] == F.col("normalized_name")))
    single = names.select("tenant_id", F.inline(own)).unionByName(repeated.select("tenant_id", F.lit("duplicate_alias_within_tenant").alias("code"), "alias"))
    return single.select("code", F.array("tenant_id").alias("tenant_ids"), F.lit(1).cast("long").alias("n_tenants"), "alias").unionByName(many)


def quality_report(registry: DataFrame) -> DataFrame:
    """One row of counts: tenants, unnamed ones, aliases, issues, and whether the registry passes."""
    unnamed = blank_to_null(F.col("tenant_name")).isNull()
    counts = registry.agg(F.count("*").alias("tenant_count"), F.count_if(unnamed).alias("skipped_unnamed_tenant_count"), F.coalesce(F.sum(F.when(~unnamed, F.size(aliases(F.col("aliases"))))), F.lit(0)).alias("alias_count"))
    issues = quality_issues(registry).agg(F.count("*").alias("issue_count"))
    return counts.crossJoin(issues).withColumn("status", F.when(F.col("issue_count") == 0, "passed").otherwise("failed"))  # two single rows


def from_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, SCHEMA)


def from_customers(customers: DataFrame) -> DataFrame:
    """A registry of the customer table's size: names as they are, the market segment as alias, a generic one for some, one in three not active."""
    key = F.col("c_custkey")
    return customers.select(
        key.cast("string").alias("tenant_id"),
        F.when(key % 11 == 0, " ").otherwise(F.col("c_name")).alias("tenant_name"),
        F.concat(F.lit("project-"), (key % 5).cast("string")).alias("project_id"),
        F.when(key % 3 == 0, "provisioning").otherwise(" Active ").alias("status"),
        F.when(key % 4 == 0, F.lit(True)).when(key % 4 == 1, F.lit(False)).alias("ec"),
        F.concat(F.lit("client "), key.cast("string"), F.lit("| |"), F.col("c_mktsegment"), F.when(key % 50 == 0, "|Ltd.").otherwise("")).alias("aliases"),
    )
