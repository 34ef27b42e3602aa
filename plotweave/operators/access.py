"""Role-based projections, review queue and paging over layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Columns each role sees (None: all) and actions it may take.
VISIBLE = {
    "public": ["fid", "KHSRA_NUM", "LU_CODE", "WARD", "PARCEL_UID", "area_sqm", "confidence", "relation"],
    "surveyor": ["fid", "KHSRA_NUM", "LU_CODE", "WARD", "PARCEL_UID", "area_sqm", "AREA_BIGHA", "confidence", "relation", "TENURE_TYP"],
    "clerk": None,
    "tehsildar": None,
}
MAY_ACT = {"public": [], "surveyor": ["survey"], "clerk": ["escalate", "survey"], "tehsildar": ["accept", "escalate", "reject", "survey"]}
OWNER_COLUMNS = ("owner", "owner_name", "KHATEDAR_NM", "holder")


def redact(df: DataFrame, role: str, keep: tuple[str, ...] = ("geom",)) -> DataFrame:
    """Allow-listed columns, and the names of those withheld in ``_redacted``; unknown roles are refused."""
    if role not in VISIBLE:
        raise ValueError(f"unknown role {role!r}")
    seen = VISIBLE[role]
    if seen is None:
        return df
    held = [c for c in df.columns if c not in seen and c not in keep]
    out = df.select(*[c for c in df.columns if c not in held])
    return out.withColumn("_redacted", F.array(*[F.lit(c) for c in held])) if held else out


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """A page in a total order, and one row ``numberMatched, numberReturned``; limit 0 returns all."""
    ordered = df.orderBy(*order)
    got = ordered.offset(offset) if offset else ordered
    got = got.limit(limit) if limit else got
    n = df.agg(F.count(F.lit(1)).alias("numberMatched"))
    rest = F.greatest(F.col("numberMatched") - offset, F.lit(0))
    return got, n.withColumn("numberReturned", F.least(rest, F.lit(limit)) if limit else rest)


def review_queue(conflicts: DataFrame, role: str, status: str | None = None, limit: int = 500, order: list | None = None) -> DataFrame:
    """Open conflicts of a status; owner columns are withheld from every role that may not see owners."""
    d = conflicts.filter(F.col("status") == status) if status else conflicts
    if VISIBLE[role] is not None:
        held = [c for c in d.columns if c in OWNER_COLUMNS]
        d = d.drop(*held).withColumn("_redacted", F.array(*[F.lit(c) for c in held]))
    return (d.orderBy(*order) if order else d).limit(limit).withColumn("may_act", F.array(*[F.lit(a) for a in MAY_ACT[role]]).cast("array<string>"))


def review(conflicts: DataFrame, conflict_id: str, role: str, action: str, reason: str, actor: str = "demo.user") -> dict:
    """The audit entry of a permitted action on an existing conflict."""
    if action not in MAY_ACT.get(role, []):
        raise PermissionError(f"role {role!r} may not {action!r}")
    if not 3 <= len(reason) <= 500:
        raise ValueError("a reason has 3 to 500 characters")
    found = conflicts.filter(F.col("id") == conflict_id).select("id", "status").head()
    if found is None:
        raise KeyError(conflict_id)
    return {"actor": actor, "role": role, "action": action, "target": conflict_id, "reason": reason, "before": {"status": found["status"]}, "after": {"action": action}}


def search(df: DataFrame, text: str, columns: list[str], owner: str | None, role: str, top: int = 6, order: list | None = None) -> DataFrame:
    """The first rows, by ``order`` or the first column, whose columns contain a text, whatever its case; owners count only for roles that see them."""
    cols = [*columns, *([owner] if owner and VISIBLE[role] is None else [])]
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.coalesce(F.lower(F.col(c).cast("string")).contains(text.lower()), F.lit(False))
    return df.filter(hit).orderBy(*(order or columns[:1])).limit(top)


def confidence_tier(c) -> F.Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c >= 0.95, "ok").when(c >= 0.70, "warn").otherwise("critical")


def catalogue(layers: dict[str, str], available: set[str], df_of) -> DataFrame:
    """``id, file, available`` of the served layers."""
    return df_of([(k, v, v in available) for k, v in layers.items()], "id string, file string, available boolean")


def endpoints(layers: dict[str, str], available: set[str], chain_head: str, df_of) -> dict[str, DataFrame]:
    """The service's static answers as tables: health, landing links, conformance, collections and export formats."""
    health = df_of([("ok", len(available), chain_head)], "status string, artifacts int, audit_chain_head string")
    links = df_of([(rel, href) for rel, href in (("self", "/"), ("conformance", "/conformance"), ("data", "/collections"), ("service-desc", "/openapi.json"))], "rel string, href string")
    # The conformance classes of the feature interface.
    classes = ["core", "geojson", "oas30"]
    conformance = df_of([(f"http://www.opengis.net/spec/ogcapi-features-1/1.0/conf/{c}",) for c in classes], "conformsTo string")
    collections = df_of([(k, "http://www.opengis.net/def/crs/OGC/1.3/CRS84", f"/collections/{k}/items") for k in sorted(layers) if layers[k] in available], "id string, crs string, items string")
    exports = df_of([(k, f, f"/export/{k}.{f}") for k in sorted(layers) if layers[k] in available for f in ("geojson", "csv", "zip")], "id string, format string, href string")
    return {"health": health, "landing": links, "conformance": conformance, "collections": collections, "exports": exports}
