"""Registered queries of readers, pipelines and streams: files that Spark writes from the given tables
are read again, and entity flows run over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys, names
from ..operators import content, profile, ratings, search
from ..sources import readers, registry
from ..sources.staging import shared_dir
from ..streaming import votes as streams
from . import catalogue, identity
from .name_queries import BAD, CLEAN, EXTRACTED, LABEL, VALIDATED, quoted
from .queries import SQL, nodes, query, rounded, uuid5_sql, votes

DOCUMENTS = "nm AS (SELECT doc_id AS k, text AS s FROM documents)"
SQL["e14_clean_names"] = (
    "WITH d AS (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(text, '[^\\p{L}-]', ' ', 'g'), '^[ -]+|[ -]+$', '', 'g'), ' +', ' ', 'g') AS clean FROM documents),"
    " h AS (SELECT doc_id, clean, row_number() OVER (PARTITION BY rtrim(lower(strip_accents(clean))) ORDER BY (text <> clean)::INT, doc_id) AS turn FROM d WHERE clean <> '')"
    " SELECT d.doc_id AS id, CASE WHEN h.turn = 1 THEN h.clean ELSE d.text END AS name FROM d LEFT JOIN h USING (doc_id)"
)
SQL["f10_extract_name"] = (
    f"WITH {DOCUMENTS}, {EXTRACTED}, {LABEL}, {VALIDATED.replace('tk AS', 'tk2 AS').replace('pt AS', 'pt2 AS').replace('v AS', 'v2 AS').replace('FROM tk)', 'FROM tk2)').replace('FROM pt)', 'FROM pt2)').replace('FROM c)', 'FROM (SELECT k, 0 AS turn, s AS x FROM nm))')}"
    f" SELECT nm.k AS doc_id, CASE WHEN NOT ({BAD.replace('(s,', '(nm.s,')}) AND trim(nm.s) <> '' THEN ex.name END AS name, v2.points AS score, la.label FROM nm JOIN v2 ON v2.k = nm.k JOIN la ON la.k = nm.k LEFT JOIN ex ON ex.k = nm.k"
)


def files(frame: DataFrame, kind: str) -> str:
    """The frame as files of a kind in the shared folder."""
    path = f"{shared_dir(frame.sparkSession)}/{kind}-{uuid.uuid4().hex}"
    if kind == "csv":
        frame.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    elif kind == "text":
        frame.write.text(path)
    else:
        frame.write.parquet(path)
    return path


@query("SELECT url AS relative_path, 'a' || page_id % 5 AS archive_name, url AS archive_url, nullif(page_id % 3, 0)::VARCHAR AS logical_id, sha256(html) AS title FROM pages WHERE page_id % 4 > 0")
def s1_read_index_csv(t):
    rows = t("pages").selectExpr("if(page_id % 4 > 0, url, ' NA ') as ` Relative_Path`", "concat('a', page_id % 5) as Archive", "url", "if(page_id % 3 = 0, 'null', cast(page_id % 3 as string)) as key", "html as title", "cast(null as string) as composer")
    out = readers.read_index_csv(t("pages").sparkSession, files(rows, "csv"))
    return out.select("relative_path", "archive_name", "archive_url", "logical_id", F.sha2("title", 256).alias("title"))


@query("SELECT p_name AS name, count(*) AS n FROM part WHERE p_partkey % 6 > 0 GROUP BY 1")
def s2_read_name_csv(t):
    rows = t("part").selectExpr("p_partkey as id", "if(p_partkey % 6 > 0, concat(' ', p_name, ' '), 'NaN') as composer", "p_brand as artist")
    return readers.read_name_csv(t("part").sparkSession, files(rows, "csv"), multi_line=False).groupBy("name").agg(F.count("*").alias("n"))


@query("SELECT 'part-' || p_partkey AS content_key, p_name AS title, p_size AS complexity, CASE WHEN p_partkey % 2 = 0 THEN 'a|b' ELSE 'x|y' END AS genres FROM part")
def s3_read_metadata_csv(t):
    rows = t("part").selectExpr("concat('d/part-', p_partkey, '.mxl') as mxl", "p_name as title", "p_size as complexity", "if(p_partkey % 2 = 0, \"['a', 'b']\", 'x; y') as genres")
    old = rows.withColumns({"title": F.lit("old"), "complexity": F.lit(0)})
    path = files(old.unionByName(rows).withColumn("turn", F.col("title") != "old").repartition(1).sortWithinPartitions("turn").drop("turn"), "csv")
    out = readers.read_metadata_csv(t("part").sparkSession, path)
    return out.select("content_key", "title", F.col("complexity").cast("long").alias("complexity"), F.array_join("genres", "|").alias("genres"))


@query("SELECT n_nationkey % 4 < 3 AS readable, CASE WHEN n_nationkey % 4 < 3 THEN n_nationkey % 2 = 0 ELSE false END AS public_domain, CASE WHEN n_nationkey % 4 = 0 THEN n_name || '|b' WHEN n_nationkey % 4 = 1 THEN n_name || '|c' WHEN n_nationkey % 4 = 2 THEN 'one|two' ELSE '' END AS genres, CASE WHEN n_nationkey % 4 < 3 THEN n_regionkey ELSE NULL END AS pages FROM nation")
def s4_read_metadata_json(t):
    genres = "case n_nationkey % 4 when 0 then concat('[{\"name\":\"', n_name, '\"},{\"name\":\"b\"},{}]') when 1 then concat('[\"', n_name, '\", \"c\", \"\"]') else '\"one; two\"' end"
    body = f"if(n_nationkey % 4 = 3, concat('{{broken ', n_name), concat('{{\"data\":{{\"score\":{{\"pages_count\":\"', n_regionkey, '\",\"is_public_domain\":', n_nationkey % 2 = 0, '}}}},\"genres\":', {genres}, '}}')) as value"
    path = files(t("nation").selectExpr(body).repartition(F.lit(25), F.xxhash64("value")), "text")
    spark = t("nation").sparkSession
    lines = spark.read.text(path)
    each = f"{shared_dir(spark)}/json-{uuid.uuid4().hex}"
    lines.write.option("maxRecordsPerFile", 1).text(each)
    out = readers.read_metadata_json(spark, each)
    return out.select("readable", "public_domain", F.array_join("genres", "|").alias("genres"), F.col("pages").cast("long").alias("pages"))


@query("SELECT c_name AS name, 'Q' || c_custkey AS wikidata_id, 'V' || c_nationkey AS viaf_id FROM customer WHERE c_custkey % 3 > 0")
def s5_read_authority_json(t):
    item = F.to_json(F.struct(F.col("c_name").alias("nombre"), F.expr("if(c_custkey % 3 > 0, concat('Q', c_custkey), '')").alias("wikidata_id"), F.concat(F.lit("V"), "c_nationkey").alias("viaf_id")))
    per = t("customer").groupBy((F.col("c_custkey") % 50).alias("g")).agg(F.array_join(F.collect_list(item), ",").alias("items"))
    path = files(per.selectExpr("if(g % 2 = 0, concat('[', items, ']'), concat('{\"items\":[', items, ']}')) as value"), "text")
    each = f"{shared_dir(per.sparkSession)}/json-{uuid.uuid4().hex}"
    per.sparkSession.read.text(path).write.option("maxRecordsPerFile", 1).text(each)
    return readers.read_authority_json(per.sparkSession, each).select("name", "wikidata_id", "viaf_id")


@query("SELECT 'e' || c_custkey AS entity_id, 'viaf' AS scheme, 'V' || c_nationkey AS value FROM customer UNION ALL SELECT 'e' || c_custkey, 'isni', 'I' || c_custkey FROM customer WHERE c_custkey % 2 = 0")
def s6_read_authority_snapshot(t):
    pair = F.expr("concat('\"e', c_custkey, '\":{\"viaf\":\"V', c_nationkey, '\",\"isni\":', if(c_custkey % 2 = 0, concat('\"I', c_custkey, '\"'), '\" \"'), ',\"source\":\"x\"}')")
    per = t("customer").groupBy((F.col("c_custkey") % 10).alias("g")).agg(F.concat(F.lit("{"), F.array_join(F.collect_list(pair), ","), F.lit("}")).alias("value")).select("value")
    each = f"{shared_dir(per.sparkSession)}/json-{uuid.uuid4().hex}"
    per.write.option("maxRecordsPerFile", 1).text(each)
    return readers.read_authority_snapshot(per.sparkSession, each).select("entity_id", "scheme", "value")


@query("SELECT o_orderkey AS work_id, 'p' || o_custkey % 3 AS provider, 'Name ' || o_custkey AS composer, round((o_orderkey % 10) / 10.0, 6) AS provider_confidence FROM orders WHERE o_orderkey % 2 = 0")
def s8_flatten_provider_evidence(t):
    body = "concat('{\"status\":\"done\",\"data\":{\"results\":[{\"id\":\"i\",\"status\":\"resolved\",\"confidence\":0.5,\"resolved\":{\"composer\":{\"name\":\"Name ', o_custkey, '\"}},\"evidence\":[{\"kind\":\"', if(o_orderkey % 2 = 0, 'universe_match', 'other'), '\",\"provider\":\"p', o_custkey % 3, '\",\"confidence\":0.', o_orderkey % 10, '},{\"kind\":\"name\"}]}]}}') as body"
    out = readers.flatten_provider_evidence(t("orders").selectExpr("o_orderkey as work_id", body))
    return rounded(out.select("work_id", "provider", "composer", "provider_confidence"), "provider_confidence")


@query("SELECT source AS folder, count(*) > 0 AS listed FROM documents GROUP BY 1")
def s9_list_files(t):
    path = f"{shared_dir(t('documents').sparkSession)}/listed-{uuid.uuid4().hex}"
    t("documents").select("doc_id", "source").write.partitionBy("source").parquet(path)
    found = readers.list_files(t("documents").sparkSession, path, "*.parquet")
    return found.groupBy(F.regexp_extract("relative_path", "^source=([^/]*)/", 1).alias("folder")).agg((F.min("length") > 0).alias("listed"))


@query("SELECT o_orderkey AS id, o_custkey AS composer_id FROM orders ORDER BY o_orderkey LIMIT 40 OFFSET 25")
def s10_registry_rows(t):
    spark, root = t("orders").sparkSession, f"{shared_dir(t('orders').sparkSession)}/registry-{uuid.uuid4().hex}"
    t("orders").selectExpr("o_orderkey as id", "o_custkey as composer_id").write.parquet(f"{root}/works.parquet")
    return registry.rows(spark, root, "works", 40, 25).select(*registry.columns(spark, root, "works"))


@query("SELECT o_orderkey AS work_id, CASE WHEN o_orderkey % 2 = 0 THEN 'first' ELSE 'second' END AS run_id FROM orders")
def s11_append_results(t):
    spark, path = t("orders").sparkSession, f"{shared_dir(t('orders').sparkSession)}/results-{uuid.uuid4().hex}"
    rows = t("orders").selectExpr("o_orderkey as work_id")
    readers.append_results(rows.where("work_id % 2 = 0"), path, "first")
    readers.append_results(rows.join(spark.read.parquet(path).select("work_id"), "work_id", "left_anti"), path, "second")
    return spark.read.parquet(path).select("work_id", "run_id")


@query("SELECT 'p' AS provider, CAST(NULL AS VARCHAR) AS version, 'x.csv' AS csv_path, count(*) AS imported FROM pages")
def s12_import_source(t):
    rows = t("pages").agg(F.count("*").alias("imported"))
    return readers.import_source(rows.sparkSession, "p", None, "x.csv").crossJoin(rows).select("provider", "version", "csv_path", "imported")


@query("SELECT c_custkey AS work_id, c_acctbal AS rating FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def j6_drop_orphans(t):
    stats = t("customer").selectExpr("c_custkey as work_id", "c_acctbal as rating")
    return ratings.drop_orphans(stats, t("orders").selectExpr("o_custkey as work_id"), "work_id")


@query("SELECT o_orderkey AS id, CASE WHEN c_custkey IS NOT NULL THEN c_mktsegment ELSE 'old' END AS title, CASE WHEN c_custkey IS NOT NULL THEN CASE WHEN c_custkey % 2 = 0 THEN c_name END ELSE 'kept' END AS composer FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0")
def j7_backfill_by_key(t):
    works = t("orders").selectExpr("o_orderkey as id", "o_custkey as content_key", "'old' as title", "'kept' as composer")
    meta = t("customer").where("c_acctbal > 0").selectExpr("c_custkey as content_key", "c_mktsegment as title", "if(c_custkey % 2 = 0, c_name, null) as composer")
    return catalogue.backfill_by_key(works, meta, "content_key", ["title", "composer"]).works.select("id", "title", "composer")


@query("SELECT count(*) AS matched, count(*) FILTER (c_mktsegment <> 'old' OR c_name IS NULL OR c_name <> 'kept') AS updated FROM orders JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0")
def j7_backfill_counts(t):
    works = t("orders").selectExpr("o_orderkey as id", "o_custkey as content_key", "'old' as title", "'kept' as composer")
    meta = t("customer").where("c_acctbal > 0").selectExpr("c_custkey as content_key", "c_mktsegment as title", "c_name as composer")
    return catalogue.backfill_by_key(works, meta, "content_key", ["title", "composer"]).counts


def enrichment(t) -> catalogue.Merged:
    csv = t("customer").where("c_custkey % 5 > 0").selectExpr("c_custkey as content_key", "if(c_custkey % 2 = 0, '', c_name) as title", "if(c_custkey % 3 = 0, array(), array(c_mktsegment)) as tags")
    json = t("customer").where("c_custkey % 7 > 0").selectExpr("c_custkey as content_key", "c_custkey % 11 > 0 as readable", "concat('json ', c_custkey) as title", "array('j', 'k') as tags", "c_nationkey as pages")
    return catalogue.merge_enrichment(csv, json)


@query("WITH c AS (SELECT c_custkey AS k, nullif(CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_name END, '') AS title, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS tags FROM customer WHERE c_custkey % 5 > 0), j AS (SELECT c_custkey AS k, 'json ' || c_custkey AS title, c_nationkey AS pages FROM customer WHERE c_custkey % 7 > 0 AND c_custkey % 11 > 0) SELECT coalesce(c.k, j.k) AS content_key, coalesce(c.title, j.title, '') AS title, coalesce(c.tags, CASE WHEN j.k IS NOT NULL THEN 'j|k' END, '') AS tags, j.pages FROM c FULL JOIN j ON c.k = j.k")
def j8_merge_enrichment(t):
    return enrichment(t).rows.select("content_key", "title", F.array_join("tags", "|").alias("tags"), "pages")


@query("SELECT c_custkey AS content_key FROM customer WHERE c_custkey % 7 > 0 AND c_custkey % 11 = 0")
def j8_merge_rejects(t):
    return enrichment(t).rejects


@query("SELECT max(o_orderkey) AS id, arg_max(o_custkey, o_orderkey) AS entries FROM orders")
def a5_latest_or(t):
    stored = t("orders").selectExpr("o_orderkey as id", "o_custkey as entries")
    return profile.latest_or(stored, t("orders").agg(F.count("*").alias("entries")))


@query("SELECT CAST(NULL AS BIGINT) AS id, count(*) AS entries FROM orders")
def a5_latest_or_computed(t):
    stored = t("orders").where("o_orderkey < 0").selectExpr("o_orderkey as id", "o_custkey as entries")
    return profile.latest_or(stored, t("orders").agg(F.count("*").alias("entries")))


@query(f"WITH p AS (SELECT p_partkey, {uuid5_sql("'alias:' || lower(p_name)")} AS target FROM part WHERE p_partkey % 3 = 0) SELECT coalesce(p.target, CAST(l_partkey AS VARCHAR)) AS composer_id, count(*) AS works FROM lineitem LEFT JOIN p ON p.p_partkey = l_partkey AND l_returnflag = 'N' GROUP BY 1")
def x9_promote_aliases(t):
    composers = t("part").selectExpr("cast(p_partkey as string) as id", "p_name as name", "'active' as status", "true as visible")
    aliases = t("part").selectExpr("cast(p_partkey as string) as composer_id", "p_name as alias", "lower(p_name) as normalized_alias")
    works = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).selectExpr("cast(l_partkey as string) as composer_id", "if(l_returnflag = 'N', p_name, 'other') as composer")
    picks = t("part").where("p_partkey % 3 = 0").selectExpr("cast(p_partkey as string) as composer_id", "p_name as alias")
    moved = identity.promote_aliases(composers, aliases, works, picks.unionByName(picks))[2]
    return moved.groupBy("composer_id").agg(F.count("*").alias("works"))


CANDIDATES = "c AS (SELECT p_brand AS name_key, p_name AS attribution, p_size AS n, p_partkey AS k FROM part WHERE p_size % 4 > 0)"


@query(
    f"WITH {CANDIDATES}, g AS (SELECT name_key, arg_min(upper(attribution) || ' ' || k, (-n, attribution || ' ' || k)) AS name, sum(n) >= 5 AS visible FROM c GROUP BY 1) SELECT {uuid5_sql("'candidate:' || name_key")} AS id, name, visible FROM g"
)
def e5_incorporate_candidates(t):
    return incorporated(t).composers.where("source_system is not null").select("id", "name", "visible")


@query(f"WITH {CANDIDATES}, g AS (SELECT DISTINCT name_key FROM c) SELECT o_orderkey AS id, CASE WHEN name_key IS NOT NULL THEN {uuid5_sql("'candidate:' || name_key")} END AS composer_id FROM orders LEFT JOIN g ON name_key = 'Brand#' || o_custkey % 60")
def e5_incorporated_works(t):
    return incorporated(t).works


def incorporated(t) -> identity.Incorporated:
    rows = t("part").selectExpr("p_brand as name_key", "concat(p_name, ' ', p_partkey) as attribution", "concat(upper(p_name), ' ', p_partkey) as cleaned_name", "p_size as work_count", "if(p_size % 4 > 0, 'resolved_by_prolific', 'unknown') as resolved_status")
    composers = t("nation").selectExpr("n_name as id", "n_name as name", "'active' as status", "true as visible", "cast(null as string) as source_system")
    aliases = t("nation").selectExpr("n_name as composer_id", "n_name as alias", "lower(n_name) as normalized_alias")
    keyed = t("part").where("p_size % 4 > 0").select("p_brand").distinct()
    resolutions = t("orders").selectExpr("o_orderkey as work_id", "concat('Brand#', o_custkey % 60) as brand").join(keyed, F.col("brand") == F.col("p_brand"), "left_semi")
    works = t("orders").selectExpr("o_orderkey as id", "cast(null as string) as composer_id")
    key = names.name_key(F.col("brand"), names.ANONYMOUS_IN_CANDIDATES)
    rows = rows.withColumn("plain", F.col("name_key"))
    done = identity.incorporate_candidates(rows.drop("plain"), resolutions.select("work_id", F.col("brand").alias("attribution")).where(key.isNotNull()), composers, aliases, works)
    by_brand = resolutions.select(F.col("work_id").alias("id"), keys.uuid5(F.concat(F.lit("candidate:"), F.col("brand"))).alias("composer_id"))
    return done._replace(works=identity.edit_rows(done.works, by_brand, "id"))


def resolved(t) -> identity.Incorporated:
    evidence = "concat('{\"maestro\":{\"composer_id\":\"m', o_custkey, '\"},\"open\":{\"canonical_name\":\"Person ', o_custkey, '\",\"viaf\":\"V', o_custkey, '\"}}') as evidence_json"
    status = "case o_orderkey % 4 when 0 then 'matched_existing' when 1 then 'resolved_by_viaf' when 2 then 'ambiguous' else 'unknown' end as status"
    rows = t("orders").selectExpr("o_orderkey as work_id", status, "cast(null as string) as decision_reason", evidence, "concat('A. Maker', o_custkey) as attribution")
    composers = t("customer").selectExpr("concat('m', c_custkey) as id", "c_name as name", "'active' as status", "true as visible", "cast(null as string) as musicbrainz_id", "cast(null as string) as source_system")
    aliases = t("customer").selectExpr("concat('m', c_custkey) as composer_id", "c_name as alias", "lower(c_name) as normalized_alias")
    ids = t("customer").where("c_acctbal > 5000").selectExpr("concat('m', c_custkey) as composer_id", "'viaf' as id_type", "concat('V', c_custkey) as id_value", "true as is_identity_anchor", "'strong' as strength")
    works = t("orders").selectExpr("o_orderkey as id", "cast(null as string) as composer_id")
    return identity.incorporate_resolutions(rows, composers, aliases, ids, works)


@query(f"SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'm' || o_custkey WHEN 1 THEN CASE WHEN c_acctbal > 5000 THEN 'm' || o_custkey ELSE {uuid5_sql("'viaf:V' || o_custkey")} END END AS composer_id FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def e6_incorporate_resolutions(t):
    return resolved(t).works


@query("SELECT CASE o_orderkey % 4 WHEN 0 THEN 'matched' WHEN 1 THEN 'resolved' WHEN 2 THEN 'ambiguous' ELSE 'unknown' END AS outcome, count(*) AS n FROM orders GROUP BY 1")
def e6_resolution_counts(t):
    return resolved(t).counts


@query(
    f"SELECT o_orderkey AS work_id, CASE WHEN o_orderkey % 6 = 0 THEN 'no_title' WHEN o_orderkey % 6 = 1 THEN 'error' WHEN o_orderkey % 6 = 2 THEN 'not_applicable' WHEN o_orderkey % 6 = 3 THEN 'no_match' WHEN c_acctbal > 5000 THEN 'matched_existing' ELSE 'composer_created' END AS outcome, CASE WHEN o_orderkey % 6 < 4 THEN NULL WHEN c_acctbal > 5000 THEN 'm' || c_custkey ELSE {uuid5_sql("'250k:viaf:V' || o_custkey")} END AS composer_id FROM orders LEFT JOIN customer ON c_custkey = o_custkey"
)
def e7_match_works(t):
    works = t("orders").selectExpr("o_orderkey as id", "if(o_orderkey % 6 = 0, ' ', 'A title') as title", "if(o_orderkey % 6 = 2, 'Anonymous', concat('Maker ', o_custkey)) as composer", "cast(null as string) as composer_id")
    candidate = "array(named_struct('name', concat('maker  ', o_custkey), 'external_ids', map('VIAF', concat('V', o_custkey)))) as candidates"
    responses = t("orders").where("o_orderkey % 6 <> 1").selectExpr("o_orderkey as work_id", "if(o_orderkey % 6 = 3, 'unknown', 'resolved') as status", candidate)
    composers = t("customer").selectExpr("concat('m', c_custkey) as id", "c_name as name", "'active' as status", "true as visible", "cast(null as string) as merged_into")
    aliases = t("customer").selectExpr("concat('m', c_custkey) as composer_id", "c_name as alias", "lower(c_name) as normalized_alias")
    ids = t("customer").where("c_acctbal > 5000").selectExpr("concat('m', c_custkey) as composer_id", "'viaf' as id_type", "concat('V', c_custkey) as id_value", "true as is_identity_anchor")
    return identity.match_works(works, responses, composers, aliases, ids).outcomes


@query(
    f"SELECT o_orderkey AS work_id, CASE WHEN o_orderkey % 4 = 0 THEN 'resolved' ELSE 'pending_human' END AS decision, CASE o_orderkey % 4 WHEN 0 THEN 'resolved' WHEN 1 THEN 'no_title' WHEN 2 THEN 'error' ELSE 'ambiguous' END AS reason FROM orders WHERE o_custkey % 2 = 0"
)
def e8_recover_identities(t):
    works = t("orders").selectExpr("o_orderkey as id", "if(o_orderkey % 4 = 1, '', 'T') as title", "cast(o_custkey as string) as composer_id", "'?' as composer")
    responses = t("orders").where("o_orderkey % 4 <> 2").selectExpr("o_orderkey as work_id", "if(o_orderkey % 4 = 3, 'ambiguous', 'resolved') as status", "concat('Person ', o_custkey % 9) as name", "concat('mb', o_custkey % 9) as mbid", "array(concat('P. ', o_custkey % 9)) as aliases")
    composers = t("customer").selectExpr("cast(c_custkey as string) as id", "c_name as name", "'active' as status", "true as visible", "cast(null as string) as musicbrainz_id")
    aliases = t("customer").selectExpr("cast(c_custkey as string) as composer_id", "c_name as alias", "lower(c_name) as normalized_alias")
    suspicious = composers.unionByName(t("orders").selectExpr("cast(o_custkey as string) as id", "'' as name", "'active' as status", "true as visible", "cast(null as string) as musicbrainz_id").distinct()).where("cast(id as long) % 2 = 0").select("id").distinct()
    return identity.recover_identities(works, suspicious, responses, composers, aliases)[3]


def looked_up(t) -> identity.LookedUp:
    composers = t("customer").selectExpr("c_custkey as id", "c_name as name", "'active' as status", "true as visible", "cast(null as bigint) as merged_into", "cast(null as string) as musicbrainz_id", "cast(null as string) as review_status")
    aliases = t("customer").where("c_custkey < 0").selectExpr("c_custkey as composer_id", "c_name as alias", "c_name as normalized_alias")
    payload = "concat('[{\"id\":\"g\",\"name\":\"', c_name, '\",\"type\":\"Group\",\"score\":100},{\"id\":\"m', c_custkey div 3, '\",\"name\":\"Canon ', c_custkey div 3, '\",\"type\":\"person\",\"score\":90}]') as payload"
    lookups = t("customer").where("c_custkey % 5 > 0").selectExpr("c_name as query_key", payload)
    works = t("orders").selectExpr("o_orderkey as id", "o_custkey as composer_id")
    return identity.enrich_from_lookups(composers, aliases, lookups, works)


@query("WITH h AS (SELECT c_custkey, c_custkey // 3 AS g FROM customer WHERE c_custkey % 5 > 0), m AS (SELECT c_custkey, min(c_custkey) OVER (PARTITION BY g) AS target FROM h) SELECT o_orderkey AS id, coalesce(m.target, o_custkey) AS composer_id FROM orders LEFT JOIN m ON m.c_custkey = o_custkey")
def e9_enriched_works(t):
    return looked_up(t).works


@query("WITH h AS (SELECT c_custkey, c_custkey // 3 AS g FROM customer WHERE c_custkey % 5 > 0), m AS (SELECT c_custkey, g, min(c_custkey) OVER (PARTITION BY g) AS target FROM h) SELECT c.c_custkey AS id, CASE WHEN m.target = m.c_custkey THEN 'Canon ' || m.g ELSE c.c_name END AS name, CASE WHEN m.target <> m.c_custkey THEN 'merged' ELSE 'active' END AS status FROM customer c LEFT JOIN m ON m.c_custkey = c.c_custkey")
def e9_enriched_composers(t):
    return looked_up(t).composers.select("id", "name", "status")


@query("SELECT 'ext:' || sha1(url) AS work_key, min(CAST(page_id AS VARCHAR)) AS title, row_number() OVER (ORDER BY 'ext:' || sha1(url)) + 5 AS id FROM pages WHERE page_id % 4 > 0 GROUP BY url")
def e11_register_external(t):
    works = t("nation").where("n_nationkey = 0").selectExpr("cast(5 as bigint) as id", "'w' as work_key", "'t' as title", "'c' as composer", "cast(null as string) as tags")
    requests = t("pages").selectExpr("if(page_id % 4 > 0, concat(' ', url), ' ') as reference", "cast(page_id as string) as title", "'c' as composer", "'prov' as provider", "cast(page_id as string) as pos")
    return catalogue.register_external(works, requests).rows.where("id > 5").select("work_key", "title", "id")


@query(
    "SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN p_type ELSE p_type END AS title, CASE WHEN p_size % 2 = 0 THEN p_brand || ', b' END AS tags, p_size % 2 = 0 AS public_domain, p_size AS pages FROM part"
)
def e12_enrich_works(t):
    works = t("part").selectExpr("p_partkey as id", "cast(p_partkey as string) as work_key", "p_type as title", "cast(null as string) as composer", "cast(null as bigint) as composer_id", "cast(null as string) as tags", "false as public_domain", "0 as pages")
    rows = t("part").selectExpr(
        "cast(p_partkey as string) as work_key", "case p_size % 3 when 0 then p_name when 1 then '  ' end as title", "cast(null as string) as composer", "if(p_size % 2 = 0, array(p_brand, 'b'), array()) as tags",
        "array(p_type) as genres", "array(cast(null as string)) as instruments", "array('p') as parts_names", "p_size % 2 = 0 as public_domain", "p_size as pages",
    )
    none = t("nation").where("false").selectExpr("cast(n_nationkey as bigint) as work_id", "0 as position", "n_name as tag", "n_name as genre", "n_name as instrument", "n_name as part_name")
    lists = {n: none.select("work_id", "position", c) for n, c in (("tags", "tag"), ("genres", "genre"), ("instruments", "instrument"), ("parts", "part_name"))}
    composers = t("customer").selectExpr("c_custkey as id", "c_name as name", "'active' as status", "cast(null as bigint) as merged_into")
    aliases = t("customer").selectExpr("c_custkey as composer_id", "lower(c_name) as normalized_alias")
    out = catalogue.enrich_works(works, rows, aliases, composers, lists).works
    return out.select("id", "title", "tags", "public_domain", F.col("pages").cast("long").alias("pages"))


@query(f"SELECT doc_id AS id, CASE WHEN {BAD} THEN 'incorrect' END AS review_status FROM (SELECT doc_id, text AS s FROM documents)")
def e15_flag_mojibake(t):
    rows = t("documents").selectExpr("doc_id as id", "text as name", "'active' as status", "cast(null as string) as review_status")
    return identity.flag_mojibake(rows).select("id", "review_status")


@query("SELECT CASE p_partkey % 4 WHEN 0 THEN 'TRADICIONAL' WHEN 1 THEN 'ANONIMA' WHEN 2 THEN 'DESCONOCIDO' END AS attribution_type, count(*) AS n, count(*) FILTER (p_partkey % 4 = 3) AS with_composer FROM part GROUP BY 1")
def e16_backfill_attribution(t):
    works = t("part").selectExpr("p_partkey as id", "case p_partkey % 4 when 0 then 'Trad. air' when 1 then 'anon' when 3 then p_name end as composer", "p_partkey as composer_id", "cast(null as string) as attribution_type", "if(p_partkey % 4 = 2, 'unknown', null) as attribution_note")
    out = identity.backfill_attribution(works)[0]
    return out.groupBy("attribution_type").agg(F.count("*").alias("n"), F.count("composer_id").alias("with_composer"))


@query("SELECT row_number() OVER (ORDER BY c_name, c_custkey) AS authority_id, lower(c_name) AS normalized_name FROM customer")
def e17_load_authority(t):
    rows = t("customer").selectExpr("c_name as name", "lpad(c_custkey, 12, '0') as wikidata_id")
    return catalogue.load_authority(rows.unionByName(rows)).names.select("authority_id", "normalized_name")


@query("SELECT 22 + count(*) AS n, count(*) AS own FROM (SELECT DISTINCT n_name FROM nation)")
def e18_seed_catalogues(t):
    own = t("nation").selectExpr("n_name as prefix", "'c' as composer", "n_name as catalogue_name", "'x' as creator", "'y' as ordering_criterion").distinct()
    both = catalogue.seed_catalogues(own.sparkSession, catalogue.seed_catalogues(own.sparkSession, own))
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("creator") == "x").alias("own"))


@query("SELECT doc_id AS id, doc_id % 3 > 0 AND doc_id % 5 > 0 AS ready, CASE WHEN doc_id % 3 > 0 AND doc_id % 5 > 0 THEN sha256(text) END AS sha256 FROM documents")
def c3_expand_archives(t):
    entries = t("documents").selectExpr("doc_id as id", "doc_id % 3 as archive_id", "concat('./', doc_id, '.mxl') as relative_path")
    archives = entries.select(F.col("archive_id").alias("id"), F.lit("imported").alias("status")).distinct()
    members = t("documents").where("doc_id % 3 > 0 and doc_id % 5 > 0").selectExpr("doc_id % 3 as archive_id", "concat(doc_id, '.mxl') as relative_path", "sha2(text, 256) as sha256", "n_chars as size")
    done = content.expand_archives(archives, entries, members)
    return done.entries.select("id", (F.col("status") == "ready").alias("ready"), "sha256")


@query("SELECT doc_id % 3 AS id, CASE WHEN doc_id % 3 > 0 THEN 'materialized' ELSE 'failed' END AS status FROM documents GROUP BY 1")
def c3_archive_states(t):
    entries = t("documents").selectExpr("doc_id as id", "doc_id % 3 as archive_id", "concat('./', doc_id, '.mxl') as relative_path")
    archives = entries.select(F.col("archive_id").alias("id"), F.lit("imported").alias("status")).distinct()
    members = t("documents").where("doc_id % 3 > 0").selectExpr("doc_id % 3 as archive_id", "concat(doc_id, '.mxl') as relative_path", "sha2(text, 256) as sha256", "n_chars as size")
    return content.expand_archives(archives, entries, members).archives.select("id", "status")


@query("SELECT (SELECT count(*) FROM documents) AS n_entries, (SELECT count(*) FROM labels) AS n_files, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS missing, false AS consistent")
def c6_consistency_report(t):
    from ..operators import tables

    manifest = tables.manifest_diff(t("documents"), t("documents"), t("labels"), "doc_id")
    places = t("documents").selectExpr("doc_id as id", "1 as provider_id", "cast(doc_id as string) as object_key", "'stored' as status")
    links = content.check_links(places, t("labels").selectExpr("1 as provider_id", "cast(doc_id as string) as object_key")).summary
    return content.consistency_report({"entries": t("documents"), "files": t("labels")}, manifest, links).selectExpr("n_entries", "n_files", "links_missing as missing", "consistent")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'Unknown composer' ELSE c_name END AS composer, 'a|b' AS tags, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 2 = 0) AS resources FROM customer")
def p12_work_record(t):
    works = t("customer").selectExpr("c_custkey as id", "c_name as title", "if(c_custkey % 3 = 0, ' ', c_name) as composer", "c_custkey as composer_id", "'K 1' as catalogue", "'a, ,b,' as tags")
    entries = t("orders").selectExpr("o_orderkey as id", "o_custkey as work_id", "concat('a/', o_orderkey, '.pdf') as relative_path", "if(o_orderkey % 2 = 0, o_orderkey, null) as file_id", "if(o_orderkey % 2 = 0, 'ready', 'missing') as status")
    none = t("nation").where("false").selectExpr("cast(n_nationkey as bigint) as id", "cast(n_nationkey as bigint) as work_id", "n_name as genre", "n_name as instrument", "n_name as part_name")
    detail = search.assemble_works(works, entries, none.select("id", "work_id", "genre"), none.select("id", "work_id", "instrument"), none.select("id", "work_id", "part_name"))
    out = search.work_record(detail)
    return out.select("id", "composer", F.array_join("metadata.tags", "|").alias("tags"), F.size("resources").cast("long").alias("resources"))


@query("WITH v AS (SELECT DISTINCT user_id, event_id % 200 AS work_id, CAST(ts AS DATE) AS d FROM events) SELECT work_id, count(*) AS n FROM v GROUP BY 1")
def st1_vote_stream(t):
    spark = t("events").sparkSession
    root = f"{shared_dir(spark)}/votes-{uuid.uuid4().hex}"
    given = votes(t).withColumn("voted_at", F.col("voted_at").cast("timestamp"))
    given.repartition(6, "id").write.parquet(f"{root}/in")  # files in any order of time, two to a batch
    stream = streams.vote_stream(spark.readStream.schema(given.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in"), votes(t).select("work_id").distinct(), watermark="3650 days")
    streams.running_counts(stream, f"{root}/out", f"{root}/state").awaitTermination()
    return streams.total_counts(spark, f"{root}/out").select("work_id", "n")


@query("SELECT o_orderkey AS work_id, o_custkey % 2 = 0 AS matched FROM orders")
def st2_incremental_match(t):
    spark = t("orders").sparkSession
    root = f"{shared_dir(spark)}/match-{uuid.uuid4().hex}"
    rows = t("orders").selectExpr("o_orderkey as work_id", "o_custkey")
    for part in (0, 1):  # the second run takes up only what is new
        rows.where(F.col("work_id") % 2 == part).write.mode("append").parquet(f"{root}/in")
        streams.run_incremental_match(spark, f"{root}/in", rows.schema, root, lambda batch: batch.selectExpr("work_id", "o_custkey % 2 = 0 as matched")).awaitTermination()
    return spark.read.parquet(f"{root}/outcomes").select("work_id", "matched")


@query("WITH RECURSIVE w(id, at_id) AS (SELECT p_partkey, p_partkey FROM part WHERE p_partkey > 0 UNION ALL SELECT w.id, w.at_id // 4 FROM w WHERE w.at_id % 4 <> 0 AND w.at_id // 4 > 0) SELECT count(*) FILTER (at_id % 4 = 0) AS resolved, (SELECT count(*) FROM part WHERE p_partkey > 0) - count(*) FILTER (at_id % 4 = 0) AS rejected FROM w")
def j2_canonical_counts(t):
    from ..operators import resolve

    found = resolve.canonical_map(nodes(t))
    return found.map.agg(F.count("*").alias("resolved")).crossJoin(found.rejects.agg(F.count("*").alias("rejected")))


KEY = "CASE WHEN len(w) = 0 THEN '' WHEN len(w) > 1 AND w[-2] = 'o' THEN trim(array_to_string(list_transform(w[:-3], lambda x: x[1]), '') || ' o' || w[-1]) ELSE trim(array_to_string(list_transform(w[:-2], lambda x: x[1]), '') || ' ' || w[-1]) END"
SQL["e4_clean_candidates"] = (
    f"WITH nm AS (SELECT row_number() OVER () AS k, min(text) AS s, count(*) AS n FROM documents WHERE trim(text) <> '' GROUP BY rtrim(lower(strip_accents(text)))), {LABEL},"
    f" nk AS (SELECT k, {KEY} AS name_key FROM (SELECT k, regexp_extract_all(replace(replace(lower(trim(s)), '''', ''), '’', ''), '[a-zà-ÿ]+') AS w FROM nm))"
    " SELECT name_key, label, n AS work_count FROM nm JOIN la USING (k) JOIN nk USING (k) WHERE label IN ('real', 'review')"
)
SQL["e2_populate_composers"] = (
    f"WITH nm AS (SELECT row_number() OVER () AS k, text AS s, count(*) AS n FROM documents WHERE lower(trim(text)) NOT IN ({quoted(names.NULL_WORDS)}) GROUP BY text), {EXTRACTED},"
    f" fd AS (SELECT nm.s AS raw, nm.n, coalesce(ex.name, {CLEAN.format('nm.s')}) AS found FROM nm LEFT JOIN ex USING (k) WHERE NOT ({BAD.replace('(s,', '(nm.s,')})),"
    " ky AS (SELECT *, trim(regexp_replace(translate(lower(strip_accents(found)), '.,;:''\"·´`-_()', '             '), '[\\s]+', ' ', 'g')) AS key FROM fd),"
    " us AS (SELECT * FROM ky WHERE key <> '' AND key NOT IN (SELECT lower(c_name) FROM customer) QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, length(raw) DESC, raw) = 1)"
    f" SELECT {uuid5_sql("'name:' || key")} AS id, found AS name FROM us"
)
