"""Registered queries: operators over the whole driver tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, names
from ..operators import content, profile, ratings, resolve, search, tables
from . import catalogue, identity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of a table reader under its name."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def votes(t) -> DataFrame:
    return t("events").selectExpr("event_id as id", "user_id", "event_id % 200 as work_id", "1 + cast(floor(value) as bigint) % 5 as vote", "ts as voted_at")


VOTES = "v0 AS (SELECT event_id AS id, user_id, event_id % 200 AS work_id, 1 + CAST(floor(value) AS BIGINT) % 5 AS vote, ts AS voted_at, CAST(ts AS DATE) AS d FROM events), v AS (SELECT * FROM v0 QUALIFY row_number() OVER (PARTITION BY user_id, work_id, d ORDER BY voted_at, id) = 1)"
RATED = VOTES + ", g AS (SELECT avg(vote) AS g FROM v), r AS (SELECT work_id, avg(vote) AS rating, (count(*) * avg(vote) + 5 * max(g.g)) / (count(*) + 5) AS adj, count(*) AS n FROM v, g GROUP BY work_id)"


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in cols})


def longs(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


@query(f"WITH {RATED} SELECT work_id, round(rating, 6) AS rating, round(adj, 6) AS adjusted_rating, n AS vote_count, CAST(1 AS BIGINT) AS work_count, round(least(1.0, n / 5.0), 6) AS confidence FROM r")
def a1_item_ratings(t):
    return longs(rounded(ratings.item_ratings(votes(t)), "rating", "adjusted_rating", "confidence"), "work_count")


@query(
    f"WITH {RATED}, i AS (SELECT DISTINCT event_id % 200 AS work_id, (event_id % 200) % 25 AS nation FROM events) SELECT nation, round(sum(adj * sqrt(n)) / sum(sqrt(n)), 6) AS rating, coalesce(sum(n), 0)::BIGINT AS vote_count, count(DISTINCT i.work_id) AS work_count, round(least(1.0, coalesce(sum(n), 0) / 5.0), 6) AS confidence FROM i LEFT JOIN r USING (work_id) GROUP BY nation"
)
def a2_group_ratings(t):
    items = votes(t).selectExpr("work_id", "work_id % 25 as nation").distinct()
    out = ratings.group_ratings(items, t("nation").select(F.col("n_nationkey").cast("long").alias("nation")), ratings.item_ratings(votes(t)), group="nation")
    return rounded(out.drop("adjusted_rating"), "rating", "confidence")


@query(f"WITH {RATED}, i AS (SELECT DISTINCT event_id % 400 AS work_id FROM events) SELECT i.work_id, round(rating, 6) AS rating, coalesce(n, 0) AS vote_count FROM i LEFT JOIN r USING (work_id)")
def a3_ratings_with_zero_rows(t):
    items = t("events").selectExpr("event_id % 400 as work_id").distinct()
    return rounded(ratings.ratings_for(items, ratings.item_ratings(votes(t))), "rating").select("work_id", "rating", "vote_count")


@query(f"WITH {VOTES} SELECT id, user_id, work_id, vote, d AS vote_day FROM v")
def w6_first_vote_of_day(t):
    return ratings.first_vote_of_day(votes(t)).kept.select("id", "user_id", "work_id", "vote", "vote_day")


@query(f"WITH {RATED} SELECT count(*) AS works_updated FROM r WHERE work_id % 3 <> 0")
def e19_refresh_statistics(t):
    works = votes(t).select("work_id").where("work_id % 3 <> 0").distinct()
    return ratings.refresh_statistics(votes(t), works).run.select("works_updated")


def nodes(t) -> DataFrame:
    return t("part").where("p_partkey > 0").selectExpr("p_partkey as id", "p_name as name", "if(p_partkey % 4 <> 0, 'merged', 'active') as status", "if(p_partkey % 4 <> 0, p_partkey div 4, null) as merged_into", "p_partkey % 2 = 0 as visible")


CANON = "w(id, at_id) AS (SELECT p_partkey, p_partkey FROM part WHERE p_partkey > 0 UNION ALL SELECT w.id, w.at_id // 4 FROM w WHERE w.at_id % 4 <> 0 AND w.at_id // 4 > 0), c AS (SELECT id, at_id AS canonical_id FROM w WHERE at_id % 4 = 0)"


@query(f"WITH RECURSIVE {CANON} SELECT id, canonical_id FROM c")
def j2_canonical_map(t):
    return resolve.canonical_map(nodes(t)).map


@query(f"WITH RECURSIVE {CANON} SELECT p_partkey AS id FROM part WHERE p_partkey > 0 AND p_partkey NOT IN (SELECT id FROM c)")
def j2_canonical_rejects(t):
    return resolve.canonical_map(nodes(t)).rejects


@query(
    f"WITH RECURSIVE {CANON}, a AS (SELECT p_partkey AS composer_id, lower(regexp_replace(p_name, '[^A-Za-z0-9]+', ' ', 'g')) AS k FROM part), o AS (SELECT k, min(canonical_id) AS composer_id, count(DISTINCT canonical_id) > 1 AS ambiguous FROM a JOIN c ON a.composer_id = c.id GROUP BY k) SELECT n.name, o.composer_id, coalesce(o.ambiguous, false) AS ambiguous FROM (SELECT DISTINCT upper(p_name) AS name FROM part) n LEFT JOIN o ON lower(regexp_replace(n.name, '[^A-Za-z0-9]+', ' ', 'g')) = o.k"
)
def j1_resolve_names(t):
    aliases = t("part").select(F.col("p_partkey").alias("composer_id"), names.normalize_name(F.col("p_name")).alias("normalized_alias"))
    return resolve.resolve_names(t("part").select(F.upper("p_name").alias("name")), aliases, nodes(t)).select("name", "composer_id", "ambiguous")


@query(
    "SELECT id, title, score FROM (SELECT p_partkey AS id, p_name AS title, CAST(CASE WHEN lower(p_name) = 'pro' THEN 100 WHEN lower(p_name) LIKE 'pro%' THEN 90 WHEN contains(lower(p_name), 'pro') THEN 70 WHEN contains(lower(p_brand), 'pro') THEN 40 WHEN contains(lower(p_type), 'pro') THEN 30 END AS BIGINT) AS score FROM part) WHERE score IS NOT NULL ORDER BY score DESC, id LIMIT 200"
)
def p1_search_works(t):
    works = t("part").selectExpr("p_partkey as id", "p_name as title", "p_brand as composer", "p_type as catalogue")
    return longs(search.search_works(works, "Pro", limit=200, others={"composer": 40, "catalogue": 30}), "score").select("id", "title", "score")


@query(
    "SELECT c_custkey AS id, c_name AS name, CAST(1 AS BIGINT) AS alias_count, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS work_count FROM customer WHERE c_acctbal > 0 AND contains(lower(c_name), '0001') ORDER BY c_name, c_custkey LIMIT 100"
)
def p3_list_composers(t):
    composers = t("customer").selectExpr("c_custkey as id", "c_name as name", "'active' as status", "c_acctbal > 0 as visible", "null as review_status")
    aliases = t("customer").select(F.col("c_custkey").alias("composer_id"), names.normalize_name(F.col("c_name")).alias("normalized_alias"))
    works = t("orders").selectExpr("o_orderkey as id", "o_custkey as composer_id")
    return search.list_composers(composers, aliases, works, q="0001", limit=100).select("id", "name", "alias_count", "work_count")


@query("SELECT count(*) AS total FROM customer WHERE c_acctbal <= 0 AND contains(lower(c_name), '0001')")
def p4_count_composers(t):
    composers = t("customer").selectExpr("c_custkey as id", "c_name as name", "'active' as status", "c_acctbal > 0 as visible", "null as review_status")
    aliases = t("customer").select(F.col("c_custkey").alias("composer_id"), names.normalize_name(F.col("c_name")).alias("normalized_alias"))
    return search.count_composers(composers, aliases, q="0001", visible="hidden")


@query("SELECT o_orderkey AS id, o_custkey AS composer_id FROM orders SEMI JOIN customer ON c_custkey = o_custkey QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) BETWEEN 2 AND 3")
def p6_works_of(t):
    works = t("orders").selectExpr("o_orderkey as id", "o_custkey as composer_id")
    return search.works_of(works, t("customer").selectExpr("c_custkey as composer_id"), per_key_limit=2, per_key_offset=1).select("id", "composer_id")


@query("SELECT n_nationkey AS id, n_name AS composer FROM nation WHERE contains(lower(regexp_replace(n_name, '[_]', ' ')), 'ion 1')")
def p7_catalogues_by_composer(t):
    rows = t("nation").selectExpr("n_nationkey as id", "n_name as composer", "left(n_name, 1) as prefix")
    return search.catalogues_by(rows, composer="Ion 1").select("id", "composer")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 50")
def p8_keyset(t):
    return tables.keyset(t("orders").select("o_orderkey"), "o_orderkey", 1000, 50)


@query(
    "WITH q AS (SELECT url AS relative_path FROM pages UNION SELECT url || 'x' FROM pages), e AS (SELECT url AS relative_path, min(page_id) AS entry_id FROM pages GROUP BY url) SELECT q.relative_path, e.entry_id, e.entry_id IS NOT NULL AS found, coalesce(e.entry_id % 2 = 0, false) AS available FROM q LEFT JOIN e USING (relative_path)"
)
def p10_resolve_entries(t):
    entries = t("pages").selectExpr("page_id as id", "url as relative_path", "if(page_id % 2 = 0, 'ready', 'missing') as status", "page_id as file_id", "page_id % 5 as archive_id")
    archives = t("nation").selectExpr("cast(n_nationkey as bigint) as id", "n_name as name")
    asked = entries.select("relative_path").unionByName(entries.selectExpr("concat(relative_path, 'x') as relative_path"))
    return search.resolve_entries(asked, entries, archives).select("relative_path", "entry_id", "found", "available")


@query(
    "SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS base, CASE WHEN regexp_matches(regexp_extract(url, '([^/]*)$', 1), '[^.]\\.[^.]*$') THEN regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\\.[^.]*$', '') ELSE regexp_extract(url, '([^/]*)$', 1) END AS content_key, 'https://cdn.example/p/' || regexp_replace(url, '^[./]+', '') AS link FROM pages"
)
def f13_content_keys(t):
    url = F.col("url")
    link = keys.resource_url(url, F.col("page_id"), keys.Links(public_url="https://cdn.example/", prefix="/p/"))
    return t("pages").select("page_id", keys.basename(url).alias("base"), keys.content_key(url).alias("content_key"), link.alias("link"))


@query(
    f"SELECT doc_id, trim(regexp_replace(translate(lower(strip_accents(text)), '.,;:''\"·´`-_()', '             '), '[\\s]+', ' ', 'g')) AS k FROM documents"
)
def f3_normalize_name(t):
    return t("documents").select("doc_id", names.normalize_name(F.col("text")).alias("k"))


@query(f"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[^\\p{{L}}-]', ' ', 'g'), '^[ -]+|[ -]+$', '', 'g'), ' +', ' ', 'g') AS k FROM documents")
def f5_clean_name(t):
    return t("documents").select("doc_id", names.clean_name(F.col("text")).alias("k"))


@query(f"SELECT doc_id, contains(text, chr(65533)) OR regexp_matches(text, '[ÐÃ]') OR length(regexp_replace(text, '[^ÐÃÅãåçêëîíì]', '', 'g')) >= 2 AS bad FROM documents")
def f6_is_mojibake(t):
    return t("documents").select("doc_id", names.is_mojibake(F.col("text")).alias("bad"))


NOISE = " OR ".join(f"contains(lower(s), '{n}')" for n in names.NOISE)
CLASSIFY = f"CASE WHEN length(s) < 2 OR NOT regexp_matches(s, '\\p{{L}}') OR contains(s, chr(65533)) OR regexp_matches(s, '[ÐÃ]') OR length(regexp_replace(s, '[^ÐÃÅãåçêëîíì]', '', 'g')) >= 2 OR {NOISE} OR regexp_matches(s, '[0-9]') THEN 'incorrect' WHEN regexp_matches(s, '^[A-Za-zÀ-ÿ''.\\-, ]+$') AND len(list_filter(regexp_split_to_array(s, '[\\s,]+'), lambda x: x <> '')) >= 2 THEN 'correct' ELSE 'not_reviewed' END"


@query(
    f"SELECT doc_id, {CLASSIFY} AS verdict FROM (SELECT doc_id, trim(text, ' \n\t\r') AS s FROM documents)"
)
def f7_classify_name(t):
    return t("documents").select("doc_id", names.classify_name(F.col("text")).alias("verdict"))


@query(
    f"SELECT doc_id, CASE WHEN len(w) = 0 THEN '' WHEN len(w) > 1 AND w[-2] = 'o' THEN trim(array_to_string(list_transform(w[:-3], lambda x: x[1]), '') || ' o' || w[-1]) ELSE trim(array_to_string(list_transform(w[:-2], lambda x: x[1]), '') || ' ' || w[-1]) END AS k FROM (SELECT doc_id, regexp_extract_all(replace(replace(lower(text), '''', ''), '’', ''), '[a-zà-ÿ]+') AS w FROM documents)"
)
def f8_name_key(t):
    return t("documents").select("doc_id", names.name_key(F.col("text")).alias("k"))


@query(f"SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(text, '[;,]'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), '|') AS items FROM documents")
def f14_parse_list(t):
    return t("documents").select("doc_id", F.array_join(names.parse_list(F.col("text")), "|").alias("items"))


@query("SELECT doc_id, left(sha256(text), 2) || '/' || sha256(text) AS k FROM documents")
def f29_storage_keys(t):
    return t("documents").select("doc_id", keys.storage_key(keys.valid_sha256(F.upper(F.sha2("text", 256)))).alias("k"))


def states(t) -> DataFrame:
    return t("orders").selectExpr("case o_orderstatus when 'F' then 'correct' when 'O' then 'incorrect' end as review_status")


@query(
    "WITH s AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'correct' WHEN 'O' THEN 'incorrect' ELSE 'not_reviewed' END AS state FROM orders) SELECT x.state, CASE WHEN x.state = 'total' THEN (SELECT count(*) FROM s) ELSE (SELECT count(*) FROM s WHERE s.state = x.state) END AS n FROM (VALUES ('total'), ('correct'), ('incorrect'), ('reviewed'), ('not_reviewed')) AS x(state)"
)
def a6_review_counts(t):
    return profile.review_counts(states(t))


@query("SELECT count(*) AS total, count(l.quality) AS with_key, count(*) - count(l.quality) AS without_key, round(100.0 * count(l.quality) / count(*), 6) AS with_key_pct FROM documents d LEFT JOIN labels l USING (doc_id)")
def a7_coverage(t):
    rows = t("documents").select("doc_id").join(t("labels"), "doc_id", "left")
    return rounded(profile.coverage(rows, "quality"), "with_key_pct").drop("without_key_pct")


@query("SELECT o_orderstatus AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders)::DOUBLE, 6) AS share FROM orders GROUP BY 1")
def a8_distribution(t):
    return rounded(profile.distribution(t("orders"), "o_orderstatus"), "share")


@query("SELECT p_brand AS source, count(*) AS total, count(*) FILTER (p_size % 2 = 0) AS visible, count(*) FILTER (p_size % 2 <> 0) AS hidden FROM part GROUP BY 1 UNION ALL SELECT '*', count(*), count(*) FILTER (p_size % 2 = 0), count(*) FILTER (p_size % 2 <> 0) FROM part")
def a9_shape(t):
    return profile.shape(t("part").selectExpr("p_size % 2 = 0 as visible", "p_brand as source_system"))


@query("SELECT c_custkey, c_name, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2 ORDER BY n DESC, c_custkey LIMIT 12")
def a10_top_by_children(t):
    return profile.top_by_children(t("customer").select("c_custkey", "c_name"), t("orders"), "c_custkey", "o_custkey")


@query("SELECT 'lang' AS column_name, count(*) FILTER (coalesce(trim(lang), '') = '') AS gaps FROM documents UNION ALL SELECT 'quality', count(*) - count(l.quality) FROM documents d LEFT JOIN labels l USING (doc_id) UNION ALL SELECT 'toxic', count(*) - count(l.toxic) FROM documents d LEFT JOIN labels l USING (doc_id)")
def a11_gap_profile(t):
    return profile.gap_profile(t("documents").select("doc_id", "lang").join(t("labels"), "doc_id", "left"), ["lang", "quality", "toxic"])


@query("SELECT lower(strip_accents(p_name)) AS key, min(p_name) AS name, count(*) AS n FROM part WHERE trim(p_name) <> '' GROUP BY 1 ORDER BY n DESC, key LIMIT 20")
def a12_long_tail(t):
    return profile.long_tail(t("part"), "p_name").top


@query("WITH v AS (SELECT p_brand AS name_key, p_type AS a, sum(p_size) AS w FROM part GROUP BY 1, 2) SELECT name_key, CAST(sum(w) AS BIGINT) AS works, count(*) AS variants, arg_min(a, (-w, a)) AS name FROM v GROUP BY 1 ORDER BY works DESC, name_key LIMIT 200")
def a13_candidate_priority(t):
    rows = t("part").selectExpr("p_brand as name_key", "p_type as attribution", "p_size as work_count")
    return profile.candidate_priority(rows, label=None)


@query("SELECT event_type AS outcome, count(*) AS n FROM events GROUP BY 1")
def a15_outcome_counts(t):
    return profile.outcome_counts(t("events").withColumnRenamed("event_type", "outcome"))


@query("SELECT o_custkey AS archive_id, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def a16_entries_per_archive(t):
    return profile.entries_per_archive(t("orders").selectExpr("o_custkey as archive_id", "o_orderstatus as status"), "O")


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS works FROM customer")
def a17_with_child_count(t):
    return profile.with_child_count(t("customer").select("c_custkey"), t("orders"), "c_custkey", "o_custkey", "works")


@query("WITH c AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, length(l_returnflag) DESC, l_returnflag) = 1")
def w1_pick_spelling(t):
    return tables.pick_spelling(t("lineitem"), ["l_suppkey"], "l_returnflag")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) = 1")
def w2_first_per_key(t):
    rows = tables.with_position(t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey"))
    return tables.first_per_key(rows, ["l_orderkey"], ["l_linenumber", *tables.POSITION]).drop(*tables.POSITION)


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) = 1")
def w3_last_per_key(t):
    rows = tables.with_position(t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey"))
    return tables.last_per_key(rows, ["l_orderkey"], ["l_linenumber"], ties=tables.POSITION).drop(*tables.POSITION)


@query("WITH f AS (SELECT l_partkey, l_suppkey, first_value(l_suppkey) OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS o FROM lineitem) SELECT l_suppkey, count(*) AS n, count(*) FILTER (o <> l_suppkey) AS conflicts FROM f GROUP BY 1")
def w4_flag_conflicts(t):
    flagged = tables.flag_conflicts(tables.with_position(t("lineitem")), ["l_partkey"], "l_suppkey", ["l_orderkey", "l_linenumber", *tables.POSITION])
    return flagged.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if("conflict").alias("conflicts"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def w5_best_per_key(t):
    return tables.best_per_key(t("orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice", ["o_orderkey"])


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey, o_orderkey LIMIT 100 OFFSET 50")
def t1_page(t):
    return tables.page(t("orders").select("o_orderkey", "o_custkey"), ["o_custkey", "o_orderkey"], 100, 50)


@query("SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS value FROM part GROUP BY 1 ORDER BY value DESC, p_brand LIMIT 10")
def t3_top_groups(t):
    return tables.top_groups(t("part"), ["p_brand"], F.sum("p_size"), 10)


def old_new(t) -> tuple[DataFrame, DataFrame]:
    rows = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return rows.where("o_orderkey % 3 <> 0"), rows.where("o_orderkey % 2 = 0").selectExpr("o_orderkey", "o_custkey + 1 as o_custkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 3 <> 0 THEN greatest(o_custkey, o_custkey + 1) ELSE o_custkey + 1 END ELSE o_custkey END AS o_custkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0")
def x2_upsert(t):
    old, new = old_new(t)
    return tables.upsert(old, new, ["o_orderkey"], rules={"o_custkey": F.greatest})


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey ELSE o_custkey + 1 END AS o_custkey FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0")
def x3_insert_ignore(t):
    old, new = old_new(t)
    return tables.insert_ignore(old.select("o_orderkey", "o_custkey"), new, ["o_orderkey"])


@query("SELECT (SELECT count(DISTINCT doc_id) FROM documents) AS csv, (SELECT count(DISTINCT doc_id) FROM documents WHERE doc_id % 2 = 0) AS entries, (SELECT count(DISTINCT doc_id) FROM labels) AS files, (SELECT count(*) FROM (SELECT doc_id FROM documents WHERE doc_id % 2 = 0 EXCEPT SELECT doc_id FROM labels)) AS missing, (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents WHERE doc_id % 2 = 0)) AS extra, false AS ok")
def x4_manifest_diff(t):
    return tables.manifest_diff(t("documents"), t("documents").where("doc_id % 2 = 0"), t("labels"), "doc_id")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey FROM orders WHERE o_orderkey % 3 <> 0")
def x6_bulk_set(t):
    old, new = old_new(t)
    return tables.bulk_set(old.select("o_orderkey", "o_custkey"), new, "o_orderkey", "o_custkey")


def merge_inputs(t):
    composers = nodes(t).withColumn("status", F.lit("active")).withColumn("merged_into", F.lit(None).cast("long"))
    aliases = t("part").select(F.col("p_partkey").alias("composer_id"), names.normalize_name(F.col("p_name")).alias("normalized_alias"))
    ids = t("part").selectExpr("p_partkey as composer_id", "'viaf' as id_type", "cast(p_size as string) as id_value")
    works = t("lineitem").selectExpr("l_orderkey * 10 + l_linenumber as id", "l_partkey as composer_id")
    merges = t("part").where("p_partkey % 5 = 1").selectExpr("p_partkey as source", "p_partkey - 1 as target", "'op' as operation_id")
    return composers, aliases, ids, works, merges


@query("SELECT CASE WHEN l_partkey % 5 = 1 AND l_partkey > 1 THEN l_partkey - 1 ELSE l_partkey END AS composer_id, count(*) AS works FROM lineitem GROUP BY 1")
def x7_merged_works(t):
    return identity.apply_merges(*merge_inputs(t)).works.groupBy("composer_id").agg(F.count("*").alias("works"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 1 AND p_partkey > 1 THEN 'merged' ELSE 'active' END AS status, CASE WHEN p_partkey % 5 = 1 AND p_partkey > 1 THEN p_partkey - 1 END AS merged_into FROM part WHERE p_partkey > 0")
def x7_merged_composers(t):
    return identity.apply_merges(*merge_inputs(t)).composers.select("id", "status", "merged_into")


@query("SELECT c_custkey AS composer_id, min(o_orderkey) AS work_id FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 7 <> 0 GROUP BY 1")
def j4_first_child_evidence(t):
    composers = t("customer").selectExpr("c_custkey as id", "'active' as status")
    evidence = t("customer").where("c_custkey % 7 = 0").selectExpr("c_custkey as composer_id", "'index' as provider")
    return resolve.first_child_evidence(composers, t("orders").selectExpr("o_orderkey as id", "o_custkey as composer_id"), evidence, "index").drop("provider")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) AND c_custkey <> 3")
def j5_prune_childless(t):
    return profile.prune_childless(t("customer").select("c_custkey"), t("orders"), "c_custkey", "o_custkey", keep_ids=[3]).removed


@query("WITH b AS (SELECT p_brand, upper(left(p_type, 1)) AS prefix FROM part), c AS (SELECT lower(prefix) AS k, min(p_brand) AS composer FROM (SELECT DISTINCT prefix, p_brand FROM b) GROUP BY 1 HAVING count(*) = 1) SELECT p.p_partkey, c.composer FROM part p LEFT JOIN c ON c.k = lower(left(p.p_type, 1))")
def j12_infer_from_catalogue(t):
    seeds = t("part").selectExpr("upper(left(p_type, 1)) as prefix", "p_brand as composer").distinct()
    refs = t("part").selectExpr("p_partkey", "concat(left(p_type, 1), '. 5') as ref")
    return resolve.infer_from_catalogue(refs, seeds).select("p_partkey", "composer")


@query("SELECT c_custkey AS id, array_to_string(list_sort(list(o_orderkey) FILTER (o_orderkey IS NOT NULL)), ',') AS orders, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def j13_assemble_works(t):
    works = t("customer").selectExpr("c_custkey as id", "c_name as title")
    entries = t("orders").selectExpr("o_orderkey as id", "o_custkey as work_id", "concat('a/', o_orderkey, '.pdf') as relative_path", "o_orderkey as file_id")
    none = t("nation").where("false").selectExpr("cast(n_nationkey as bigint) as id", "cast(n_nationkey as bigint) as work_id", "n_name as genre", "n_name as instrument", "n_name as part_name")
    out = search.assemble_works(works, entries, none.select("id", "work_id", "genre"), none.select("id", "work_id", "instrument"), none.select("id", "work_id", "part_name"))
    ids = F.transform("resources", lambda r: r["id"].cast("string"))
    return out.select("id", F.nullif(F.array_join(ids, ","), F.lit("")).alias("orders"), F.size("resources").cast("long").alias("n"))


@query("SELECT p_partkey, CASE WHEN k.q IS NULL THEN 'not_found' WHEN k.u = 1 THEN 'resolved' ELSE 'ambiguous' END AS status FROM part LEFT JOIN (SELECT s_nationkey AS q, count(DISTINCT s_suppkey) AS u FROM supplier WHERE s_nationkey < 20 GROUP BY 1) k ON k.q = p_size % 25")
def j9_authority_coverage(t):
    works = t("part").selectExpr("p_partkey", "cast(p_size % 25 as string) as name_key")
    authority = t("supplier").where("s_nationkey < 20").selectExpr("cast(s_nationkey as string) as name_key", "cast(s_suppkey as string) as viaf_id")
    return profile.authority_coverage(works, authority, authority.select("viaf_id").where("false")).detail.select("p_partkey", "status")


@query("SELECT doc_id, octet_length(encode(text)) AS bytes, sha256(text) AS sha256, sha256(text) = (SELECT max(sha256(b.text)) FROM documents b WHERE b.doc_id = d.doc_id) AS ok FROM documents d")
def c1_verify_copies(t):
    docs = t("documents").select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha256"))
    files = docs.select(F.col("doc_id").alias("id"), F.upper("sha256").alias("sha256"))
    places = docs.select(F.col("doc_id").alias("file_id"), F.col("doc_id").cast("string").alias("object_key"), F.lit("stored").alias("status"))
    checked = content.verify_copies(files, places, docs.select(F.col("doc_id").cast("string").alias("object_key"), "sha256"))
    return docs.join(checked.select(F.col("file_id").alias("doc_id"), "ok"), "doc_id")


@query("SELECT sha256(text) AS sha256, row_number() OVER (ORDER BY sha256(text)) + 10 AS id FROM documents GROUP BY text")
def c2_register_content(t):
    new = t("documents").select(F.sha2("text", 256).alias("sha256"), F.concat(F.lit("d"), F.col("doc_id")).alias("name"), F.col("n_chars").alias("size_bytes"), F.lit("text/plain").alias("mime_type"), F.col("doc_id").alias("pos"))
    empty = t("nation").limit(1).select(F.lit(10).cast("long").alias("id"), F.lit("-").alias("sha256"))
    return content.register_content(empty, new).files.where("id > 10").select("sha256", "id")


@query("SELECT count(*) AS checked, count(l.doc_id) AS found, count(*) - count(l.doc_id) AS missing FROM documents d LEFT JOIN labels l USING (doc_id)")
def c5_check_links(t):
    places = t("documents").selectExpr("doc_id as id", "1 as provider_id", "cast(doc_id as string) as object_key", "'stored' as status")
    return content.check_links(places, t("labels").selectExpr("1 as provider_id", "cast(doc_id as string) as object_key")).summary


def composers_of_documents(t) -> DataFrame:
    return t("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("name"), F.lit("active").alias("status"), F.lit(None).cast("string").alias("review_status"))


@query("SELECT verdict, count(*) AS n FROM (" + SQL["f7_classify_name"] + ") GROUP BY 1")
def e13_classify_pending(t):
    return identity.classify_pending(composers_of_documents(t))[1]


@query()
def e2_populate_composers(t):
    aliases = t("customer").select(F.col("c_custkey").cast("string").alias("composer_id"), F.col("c_name").alias("alias"), names.normalize_name(F.col("c_name")).alias("normalized_alias"))
    composers = t("customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.lit("active").alias("status"))
    rows = t("documents").select(F.col("text").alias("name"))
    return catalogue.populate_composers(rows, composers, aliases).composers.where("visible").select("id", "name")


@query()
def e14_clean_names(t):
    return identity.clean_names(composers_of_documents(t)).composers.select("id", "name")


def _words(kind: str, words: str) -> str:
    return f"WHEN regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])({words})($|[^\\p{{L}}\\p{{N}}_])') THEN '{kind}'"


@query(
    "SELECT CASE " + " ".join(_words(kind, pattern.split("(")[1].split(")")[0]) for kind, pattern in names.ATTRIBUTION_TYPES)
    + " END AS kind, count(*) AS n FROM documents GROUP BY 1"
)
def f21_attribution_types(t):
    return t("documents").select(names.attribution_type(F.col("text")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query(
    "WITH s AS (SELECT c_custkey AS e, c_nationkey AS v FROM customer), f AS (SELECT e, v, first_value(e) OVER (PARTITION BY v ORDER BY e) AS o FROM s) SELECT CASE WHEN o = e THEN 'inserted' ELSE 'conflict' END AS outcome, count(*) AS n FROM f GROUP BY 1"
)
def e10_ingest_identifiers(t):
    snapshot = t("customer").selectExpr("cast(c_custkey as string) as entity_id", "'viaf' as scheme", "cast(c_nationkey as string) as value", "'x' as source", "c_custkey as pos")
    current = snapshot.where("false").selectExpr("'composer' as entity_type", "entity_id", "scheme", "value", "source")
    return identity.ingest_identifiers(current, snapshot, "composer").outcomes


def entries_of_pages(t) -> DataFrame:
    return t("pages").selectExpr("page_id as id", "page_id % 5 as archive_id", "url as relative_path", "cast(page_id as string) as logical_id", "'c' as composer", "html as title", "if(page_id % 2 = 0, 'ready', 'missing') as status", "page_id as file_id")


@query("SELECT page_id AS id, n_name AS archive_name, page_id % 2 = 0 AS available FROM pages JOIN nation ON n_nationkey = page_id % 5 WHERE contains(lower(url), 'blog') OR contains(lower(html), 'blog') ORDER BY page_id LIMIT 60")
def p2_search_entries(t):
    archives = t("nation").selectExpr("cast(n_nationkey as bigint) as id", "n_name as name")
    return search.search_entries(entries_of_pages(t), archives, "Blog", limit=60).select("id", "archive_name", "available")


@query("SELECT p_partkey AS id FROM part WHERE p_size % 3 = 0 ORDER BY p_partkey LIMIT 80 OFFSET 10")
def p5_pending_review(t):
    rows = t("part").selectExpr("p_partkey as id", "'active' as status", "if(p_size % 3 = 0, null, 'correct') as review_status")
    return search.pending_review(rows, 80, 10).select("id")


@query("SELECT c_custkey AS id FROM customer WHERE contains(lower(c_name), '012')")
def j3_has_alias_like(t):
    aliases = t("customer").select(F.col("c_custkey").alias("composer_id"), names.normalize_name(F.col("c_name")).alias("normalized_alias"))
    return resolve.has_alias_like(t("customer").selectExpr("c_custkey as id"), aliases, "012")


@query(
    "SELECT s_suppkey AS key, coalesce((SELECT min(c_custkey) FROM customer WHERE c_custkey = s_suppkey * 3), (SELECT min(c_custkey) FROM customer WHERE c_nationkey = s_nationkey)) AS composer_id FROM supplier WHERE coalesce((SELECT min(c_custkey) FROM customer WHERE c_custkey = s_suppkey * 3), (SELECT min(c_custkey) FROM customer WHERE c_nationkey = s_nationkey)) IS NOT NULL"
)
def j10_find_existing(t):
    who = t("supplier").selectExpr("s_suppkey as key", "cast(s_suppkey * 3 as string) as mbid", "cast(s_nationkey as string) as viaf", "cast(null as string) as qid", "cast(null as string) as name")
    composers = t("customer").selectExpr("c_custkey as id", "c_name as name", "'active' as status", "cast(c_custkey as string) as musicbrainz_id")
    ids = t("customer").selectExpr("c_custkey as composer_id", "'viaf' as id_type", "cast(c_nationkey as string) as id_value")
    return resolve.find_existing(who, composers, ids)


@query("SELECT s_suppkey AS request_id, (SELECT string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey) FROM customer WHERE c_nationkey = s_nationkey) AS ids FROM supplier")
def j11_find_candidates(t):
    asked = t("supplier").select(F.col("s_suppkey").alias("request_id"), F.col("s_name").alias("name"), F.array(F.struct(F.lit("viaf").alias("id_type"), F.col("s_nationkey").cast("string").alias("id_value"))).alias("identifiers"))
    composers = t("customer").selectExpr("c_custkey as id", "c_name as name", "'active' as status", "cast(null as bigint) as merged_into")
    ids = t("customer").selectExpr("c_custkey as composer_id", "'viaf' as id_type", "cast(c_nationkey as string) as id_value")
    aliases = t("customer").where("false").selectExpr("c_custkey as composer_id", "c_name as normalized_alias")
    found = resolve.find_candidates(asked, composers, aliases, ids, shape=lambda c: F.nullif(F.array_join(c, ","), F.lit("")))
    return found.withColumnRenamed("composer_ids", "ids")


@query("SELECT p_partkey AS id, count(l_orderkey) AS places, p_size % 5 <> 0 AND count(l_orderkey) > 0 AS available FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_returnflag = 'N' GROUP BY p_partkey, p_size")
def j14_file_details(t):
    files = t("part").selectExpr("p_partkey as id", "if(p_size % 5 = 0, 'failed', 'available') as status")
    places = t("lineitem").selectExpr("l_partkey as file_id", "l_suppkey as provider_id", "concat(l_orderkey, '-', l_linenumber) as object_key", "if(l_returnflag = 'N', 'stored', 'removed') as status")
    out = search.file_details(files, places, t("supplier").selectExpr("s_suppkey as id", "s_name as name"))
    return out.select("id", F.size("places").cast("long").alias("places"), "available")


@query("SELECT c_custkey AS id, lower(c_name) AS aliases, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS work_count FROM customer")
def j15_composer_details(t):
    ids = t("customer").where("false").selectExpr("c_custkey as composer_id", "'viaf' as id_type", "'x' as id_value")
    evidence = t("customer").where("false").selectExpr("c_custkey as composer_id", "'r' as rule", "'d' as decision")
    aliases = t("customer").selectExpr("c_custkey as composer_id", "lower(c_name) as alias")
    out = search.composer_details(t("customer").selectExpr("c_custkey as id"), aliases, t("orders").selectExpr("o_custkey as composer_id"), ids, evidence)
    return out.select("id", F.array_join("aliases", ",").alias("aliases"), "work_count")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def j16_lookup(t):
    return resolve.lookup_ids(t("orders").select("o_orderkey", "o_custkey"), t("customer").where("c_acctbal > 5000").selectExpr("c_custkey as o_custkey"), "o_custkey")


@query("SELECT (SELECT count(*) FROM supplier) AS archives, (SELECT count(*) FROM supplier WHERE s_suppkey % 2 = 0) AS downloaded, (SELECT count(*) FROM orders) AS entries, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS ready, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS missing, (SELECT count(*) FROM documents) AS files, (SELECT sum(n_chars)::BIGINT FROM documents) AS bytes")
def a4_snapshot(t):
    archives = t("supplier").selectExpr("if(s_suppkey % 2 = 0, 'x', null) as local_path", "'imported' as status")
    entries = t("orders").selectExpr("case o_orderstatus when 'F' then 'ready' when 'O' then 'missing' else 'failed' end as status")
    return profile.snapshot(archives, entries, t("documents").selectExpr("n_chars as size_bytes")).drop("materialized")


@query("SELECT (SELECT count(*) FROM customer) AS rows, round(100.0 * count(*) FILTER (c_acctbal > 0) / count(*), 6) AS viaf_id_pct, count(DISTINCT c_nationkey) AS keys, count(DISTINCT c_nationkey) AS keys_with_several FROM customer")
def a14_authority_profile(t):
    rows = t("customer").selectExpr("cast(c_nationkey as string) as name_key", "if(c_acctbal > 0, 'v', '') as viaf_id")
    return rounded(profile.authority_profile(rows, fields=("viaf_id",)), "viaf_id_pct")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 30")
def t2_page_desc(t):
    return tables.page_desc(t("orders").select("o_orderkey"), ["o_orderkey"], 30)


@query("SELECT row_number() OVER (ORDER BY a.archive_id, url) AS id, url AS relative_path, title FROM (SELECT DISTINCT ON (page_id % 5, url) page_id % 5 AS k, url, html AS title FROM pages ORDER BY page_id % 5, url, page_id DESC) p JOIN (SELECT k, row_number() OVER (ORDER BY 'a' || k) AS archive_id FROM (SELECT DISTINCT page_id % 5 AS k FROM pages)) a USING (k)")
def x1_build_index(t):
    rows = t("pages").orderBy("page_id").selectExpr("url as relative_path", "concat('a', page_id % 5) as archive_name", "null as archive_url", "null as logical_id", "null as composer", "html as title")
    rows = rows.withColumns({c: F.col(c).cast("string") for c in ("archive_url", "logical_id", "composer")})
    archives = t("nation").where("false").selectExpr("cast(n_nationkey as bigint) as id", "n_name as name", "n_name as url", "n_name as status")
    entries = t("nation").where("false").selectExpr("cast(n_nationkey as bigint) as id", "cast(n_nationkey as bigint) as archive_id", "n_name as relative_path", "n_name as logical_id", "n_name as composer", "n_name as title", "n_name as status")
    return catalogue.build_index(rows, archives, entries).entries.select("id", "relative_path", "title")


@query("SELECT doc_id, position, tag FROM (SELECT doc_id, unnest(range(0, len(l))) AS position, unnest(l) AS tag FROM (SELECT doc_id, list_filter([lang, source], lambda x: x IS NOT NULL) AS l FROM documents WHERE doc_id % 2 = 0)) UNION ALL SELECT doc_id, 0, 'old' FROM documents WHERE doc_id % 2 = 1")
def x5_replace_list(t):
    old = t("documents").selectExpr("doc_id", "0 as position", "'old' as tag")
    new = t("documents").where("doc_id % 2 = 0").selectExpr("doc_id", "array(concat(' ', lang), '', source, lang) as tag")
    return longs(tables.replace_list(old, new, "doc_id", "tag"), "position")


@query("SELECT CASE WHEN l_partkey % 3 = 0 AND l_returnflag = 'N' THEN l_partkey + 1 ELSE l_partkey END AS composer_id, count(*) AS works FROM lineitem GROUP BY 1")
def x8_move_aliases(t):
    aliases = t("part").selectExpr("p_partkey as composer_id", "'N' as alias", "'n' as normalized_alias")
    works = t("lineitem").selectExpr("l_partkey as composer_id", "l_returnflag as composer")
    moves = t("part").where("p_partkey % 3 = 0").selectExpr("p_partkey as composer_id", "'N' as alias", "p_partkey + 1 as target")
    return identity.move_aliases(aliases, works, moves).works.groupBy("composer_id").agg(F.count("*").alias("works"))


@query("SELECT CASE WHEN l_partkey % 50 = 0 THEN 'ANONIMA' END AS attribution_type, count(*) AS n, count(*) FILTER (l_partkey % 50 <> 0) AS with_composer FROM lineitem GROUP BY 1")
def x10_to_attribution(t):
    composers = nodes(t).drop("merged_into")
    works = t("lineitem").where("l_partkey > 0").selectExpr("l_partkey as composer_id", "cast(null as string) as attribution_type", "cast(null as string) as attribution_note")
    works = works.unionByName(t("lineitem").where("l_partkey = 0").selectExpr("cast(null as bigint) as composer_id", "'ANONIMA' as attribution_type", "'' as attribution_note"))
    out = identity.to_attribution(composers, works, composers.where("id % 50 = 0").select("id"), "ANONIMA")[1]
    return out.groupBy("attribution_type").agg(F.count("*").alias("n"), F.count("composer_id").alias("with_composer"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 9 = 0 THEN 'correct' WHEN p_partkey % 2 = 0 THEN 'x' END AS review_status FROM part WHERE p_partkey > 0")
def x11_edit_composers(t):
    rows = nodes(t).selectExpr("id", "if(id % 2 = 0, 'x', null) as review_status")
    return tables.edit_rows(rows, rows.where("id % 9 = 0").selectExpr("id", "'correct' as review_status"), "id")


@query("WITH n AS (SELECT DISTINCT o_custkey AS composer_id, lower(o_orderpriority) AS alias FROM orders) SELECT composer_id, count(*) AS n FROM (SELECT composer_id, trim(regexp_replace(translate(alias, '-', ' '), ' +', ' ', 'g')) AS k FROM n UNION SELECT c_custkey, lower(c_name) FROM customer) GROUP BY 1")
def x12_add_aliases(t):
    aliases = t("customer").select(F.col("c_custkey").alias("composer_id"), F.col("c_name").alias("alias"), names.normalize_name(F.col("c_name")).alias("normalized_alias"))
    new = t("orders").selectExpr("o_custkey as composer_id", "lower(o_orderpriority) as alias")
    return identity.add_aliases(aliases, new)[0].groupBy("composer_id").agg(F.count("*").alias("n"))


@query(
    "WITH k AS (SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS b FROM pages), c AS (SELECT page_id, CASE WHEN regexp_matches(b, '[^.]\\.[^.]*$') THEN regexp_replace(b, '\\.[^.]*$', '') ELSE b END AS work_key FROM k) SELECT work_key, row_number() OVER (ORDER BY work_key) AS id, min(page_id) AS first_entry, count(*) AS entries FROM c WHERE work_key <> '' GROUP BY 1"
)
def e1_build_works(t):
    entries = t("pages").selectExpr("page_id as id", "url as relative_path", "cast(null as string) as composer", "cast(page_id as string) as title", "cast(null as bigint) as work_id")
    works = t("nation").where("false").selectExpr("cast(n_nationkey as bigint) as id", "n_name as work_key", "n_name as relative_path", "n_name as composer", "n_name as composer_id", "n_name as title")
    people = t("nation").where("false").selectExpr("n_name as id", "n_name as name", "n_name as status", "n_name as merged_into")
    aliases = people.selectExpr("id as composer_id", "name as alias", "name as normalized_alias")
    done = catalogue.build_works(entries, works, aliases, people)
    linked = done.entries.where("work_id is not null").groupBy(F.col("work_id").alias("id")).agg(F.count("*").alias("entries"))
    return done.works.select("work_key", "id", F.col("title").cast("long").alias("first_entry")).join(linked, "id")


@query(
    "SELECT coalesce(c.composer, 'unknown') AS owner, count(*) AS n FROM part p LEFT JOIN (SELECT lower(prefix) AS k, min(p_brand) AS composer FROM (SELECT DISTINCT upper(left(p_type, 1)) AS prefix, p_brand FROM part) GROUP BY 1 HAVING count(*) = 1) c ON c.k = lower(left(p.p_type, 1)) GROUP BY 1"
)
def e3_backfill_composer_ids(t):
    seeds = t("part").selectExpr("upper(left(p_type, 1)) as prefix", "p_brand as composer").distinct()
    people = t("part").selectExpr("p_brand as id", "p_brand as name", "'active' as status", "cast(null as string) as merged_into").distinct()
    aliases = people.select(F.col("id").alias("composer_id"), F.col("name").alias("alias"), names.normalize_name(F.col("name")).alias("normalized_alias"))
    works = t("part").selectExpr("p_partkey as id", "cast(null as string) as composer", "concat(left(p_type, 1), '. 5') as catalogue", "cast(null as string) as composer_id")
    out = catalogue.backfill_composer_ids(works, aliases, people, seeds, unknown_id="unknown").works
    return out.groupBy(F.col("composer_id").alias("owner")).agg(F.count("*").alias("n"))


@query()
def e4_clean_candidates(t):
    rows = t("documents").select(F.lit("unknown").alias("status"), F.col("text").alias("attribution"))
    return identity.clean_candidates(rows).select("name_key", "label", "work_count")


@query("SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) + 7 AS file_id FROM orders WHERE o_orderkey % 2 = 0")
def c4_register_mirror(t):
    entries = t("orders").selectExpr("o_orderkey as id", "concat('a/', o_orderkey, '.mxl') as relative_path", "if(o_orderkey % 2 = 0, null, 1L) as file_id")
    return content.register_mirror(entries, 3, start=7).entries.where("id % 2 = 0").select("id", "file_id")


@query("SELECT doc_id, CAST(nullif(regexp_extract(text, '(^|[^\\p{L}\\p{N}_])(1[89][0-9][0-9]|20[0-9][0-9])($|[^\\p{L}\\p{N}_])', 2), '') AS BIGINT) AS year FROM documents")
def f22_extract_year(t):
    return longs(t("documents").select("doc_id", names.extract_year(F.col("text")).alias("year")), "year")


@query()
def f10_extract_name(t):
    rows = t("documents").select("doc_id", F.col("text").alias("s"))
    return rows.select("doc_id", names.extract_name(F.col("s")).alias("name"), names.validate_name(F.col("s"))["score"].alias("score"), names.candidate_label(F.col("s"))["label"].alias("label"))


def uuid5_sql(name: str) -> str:
    """The name-based UUID of a text expression, in SQL."""
    h = f"sha1(unhex('{keys.IDENTITY_NAMESPACE.hex}') || encode({name}))"
    return f"{h}[1:8] || '-' || {h}[9:12] || '-5' || {h}[14:16] || '-' || ('89ab')[(instr('0123456789abcdef', {h}[17:17]) - 1) % 4 + 1] || {h}[18:20] || '-' || {h}[21:32]"


@query(f"SELECT c_custkey, {uuid5_sql("'name:' || lower(c_name)")} AS id, 'ext:' || sha1(c_name) AS external FROM customer")
def f27_entity_ids(t):
    return t("customer").select("c_custkey", identity.entity_ids(F.col("c_name")).alias("id"), keys.external_key(F.col("c_name")).alias("external"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["a1_item_ratings"](spark, sf_dir)
