"""Queries of the llm operators and the SQL of those that have one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..common import table
from . import abuse, groups, leakage, resolution, survivors, tokens


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return groups.match_groups(table(spark, d, "matches"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.surviving_claims(table(spark, d, "claims"), table(spark, d, "sources")).select("fid", "field", "claim_id")


def p7_records(spark: SparkSession, d: str) -> DataFrame:
    return survivors.surviving_records(table(spark, d, "claims"), table(spark, d, "sources"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"))


def p8_tokens(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_counts(table(spark, d, "documents"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return resolution.same_land(table(spark, d, "parcels_legacy"), table(spark, d, "parcels")).select("legacy_fid", "parcel_fid")


def p3_matches(spark: SparkSession, d: str) -> DataFrame:
    return resolution.same_land(table(spark, d, "parcels_legacy"), table(spark, d, "parcels"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return abuse.score_documents(docs, abuse.train(docs, table(spark, d, "labels")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_scores(spark, d).filter("abusive").select("doc_id").distinct()


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.source_rates(p10_scores(spark, d))


QUERIES = {f.__name__: f for f in (p3_found, p3_matches, p4_found, p7_found, p7_records, p8_ids, p8_tokens, p9_found, p10_found, p10_scores, p10_rates)}


def _fid(c: str) -> str:
    s = f"upper(regexp_replace(translate({c},'०१२३४५६७८९','0123456789'),'[^A-Za-z0-9_]','','g'))"
    return f"nullif(regexp_replace({s},'^GOVT_?','govt_'),'')"


# a label travels along links to greater records only, so each record ends with the smallest of its group
GROUPS = f"""WITH RECURSIVE m AS (SELECT {_fid('src_fid')} AS a, {_fid('t')} AS b, lower(trim(relation)) AS r FROM (SELECT src_fid, relation, unnest(CASE WHEN len(tgt_fids)>0 THEN tgt_fids ELSE [NULL] END) AS t FROM matches)),
 n AS (SELECT a AS f FROM m WHERE a IS NOT NULL UNION SELECT b FROM m WHERE b IS NOT NULL), l AS (SELECT a, b FROM m WHERE a IS NOT NULL AND b IS NOT NULL AND a<>b AND coalesce(r,'')<>'spurious'), e AS (SELECT a AS x, b AS y FROM l UNION SELECT b, a FROM l),
 reach(f, root) AS (SELECT f, f FROM n UNION SELECT e.y, reach.root FROM reach JOIN e ON e.x=reach.f WHERE reach.root<e.y)
 SELECT min(root) AS group_fid, f AS fid FROM reach GROUP BY f"""
_SAID = r"trim(regexp_replace(lower(regexp_replace(value,'[\x{00A0}\x{200B}-\x{200D}\x{FEFF}]',' ','g')),'[^\p{L}\p{M}\p{N}]+',' ','g'))"
_SOURCE = r"regexp_replace(lower(trim(source_id)),'[\s_-]+','_','g')"
_UNKNOWN = ", ".join("'" + v + "'" for v in survivors.UNKNOWN)
SURVIVORS = f"""WITH so AS (SELECT {_SOURCE} AS source, min(accuracy_m) AS acc, max(vintage) AS vin, max(authority) AS auth FROM sources WHERE source_id IS NOT NULL GROUP BY 1),
 c AS (SELECT claim_id, {_fid('fid')} AS fid, lower(trim(field)) AS field, {_SOURCE} AS source, trim(value) AS value, claimed_at FROM claims WHERE value IS NOT NULL AND {_SAID} NOT IN ({_UNKNOWN})),
 u AS (SELECT c.*, acc, vin, coalesce(list_contains(auth, field), false) AS lawful FROM c JOIN so USING (source) WHERE claim_id IS NOT NULL AND fid IS NOT NULL AND field IS NOT NULL),
 r AS (SELECT *, row_number() OVER (PARTITION BY fid, field ORDER BY lawful DESC, CASE WHEN lawful THEN coalesce(vin,-1e18) ELSE -coalesce(acc,1e18) END DESC, CASE WHEN lawful THEN -coalesce(acc,1e18) ELSE coalesce(vin,-1e18) END DESC, source DESC, claimed_at DESC, claim_id DESC) AS r FROM u)"""
#: Of claims that all have times, as those of the test tables do.
ORACLE: dict[str, str] = {"p4_found": GROUPS, "p7_found": SURVIVORS + " SELECT fid, field, claim_id FROM r WHERE r=1", "p7_records": SURVIVORS + " SELECT fid, " + ", ".join(f"max(CASE WHEN field='{f}' THEN value END) AS {f}" for f in survivors.FIELDS) + " FROM r WHERE r=1 GROUP BY fid"}
