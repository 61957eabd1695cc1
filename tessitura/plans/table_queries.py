"""Registered queries of published table sets, typed tables, sinks and files that Spark or its tasks write from
the given tables."""

from __future__ import annotations

import uuid

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from ..operators import contain, content, resolve, search
from ..sources import readers, registry
from ..sources.publish import TableSet
from ..sources.staging import shared_dir
from ..streaming import votes as streams
from . import catalogue, identity
from .name_queries import quoted
from .queries import merge_inputs, query, uuid5_sql, votes


def own_folder(frame: DataFrame, kind: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(frame.sparkSession)}/{kind}-{uuid.uuid4().hex}"


class Interrupted(RuntimeError):
    pass


def fail_after(name: str):
    """A hook that stops a publication once the table of that name is written."""

    def written(table: str) -> None:
        if table == name:
            raise Interrupted(table)

    return written


def publish_failing_once(tables: TableSet, frames: dict[str, DataFrame], run_id: str, after: str) -> None:
    """A first attempt that stops midway, then a second one, then a repetition of the whole run."""
    before = tables.version()
    try:
        tables.publish(frames, run_id=run_id, written=fail_after(after))
    except Interrupted:
        if tables.version() != before:
            raise RuntimeError("a failed publication is visible") from None
    else:
        raise RuntimeError("the publication did not stop")
    done = tables.publish(frames, run_id=run_id)
    if tables.publish(frames, run_id=run_id) != done:
        raise RuntimeError("a run was published twice")


@query(
    "SELECT * FROM (SELECT 1 AS version, 'works' AS name, l_partkey AS id, count(*) AS n FROM lineitem GROUP BY l_partkey"
    " UNION ALL SELECT 2, 'works', CASE WHEN l_partkey % 5 = 1 AND l_partkey > 1 THEN l_partkey - 1 ELSE l_partkey END, count(*) FROM lineitem GROUP BY 3"
    " UNION ALL SELECT 1, 'merged', p_partkey, 0 FROM part WHERE p_partkey > 0"
    " UNION ALL SELECT 2, 'merged', p_partkey, CASE WHEN p_partkey % 5 = 1 AND p_partkey > 1 THEN 1 ELSE 0 END FROM part WHERE p_partkey > 0)"
)
def x7_published_merge(t):
    """Entities before and after a merge that was interrupted once, read back from the published set."""
    composers, aliases, ids, works, merges = merge_inputs(t)
    tables = TableSet(works.sparkSession, own_folder(works, "catalogue"))
    tables.publish({"composers": composers, "aliases": aliases, "identifiers": ids, "works": works}, run_id="import")
    old = tables.read_all()
    merged = identity.apply_merges(old["composers"], old["aliases"], old["identifiers"], old["works"], merges)
    frames = {"works": merged.works, "composers": merged.composers, "aliases": merged.aliases, "identifiers": merged.identifiers, "history": merged.history}
    publish_failing_once(tables, frames, "merge", "works")
    found = None
    for version in (1, 2):
        seen = tables.read_all(version)
        counts = seen["works"].groupBy(F.col("composer_id").alias("id")).agg(F.count("*").alias("n"))
        states = seen["composers"].select("id", (F.col("status") == "merged").cast("long").alias("n"))
        both = counts.select(F.lit("works").alias("name"), "id", "n").unionByName(states.select(F.lit("merged").alias("name"), "id", "n"))
        both = both.withColumn("version", F.lit(version))
        found = both if found is None else found.unionByName(both)
    return found.select("version", "name", "id", "n")


@query(
    "WITH f AS (SELECT k, url, min(page_id % 2) AS later, max(page_id) AS last FROM (SELECT *, page_id % 5 AS k FROM pages) GROUP BY k, url)"
    " SELECT row_number() OVER (ORDER BY later, 'a' || k, url) AS id, 'a' || k AS archive, url AS relative_path, CAST(last AS VARCHAR) AS title FROM f"
)
def x1_published_index(t):
    """An index of two imports: the second one meets entries and archives of the first, and is published
    over them after an interrupted attempt."""
    rows = t("pages").selectExpr("page_id as pos", "url as relative_path", "concat('a', page_id % 5) as archive_name", "cast(null as string) as archive_url", "cast(page_id as string) as logical_id", "cast(null as string) as composer", "cast(page_id as string) as title")
    tables = TableSet(rows.sparkSession, own_folder(rows, "index"))
    archives = t("nation").where("false").selectExpr("cast(n_nationkey as bigint) as id", "n_name as name", "n_name as url", "n_name as status")
    entries = t("nation").where("false").selectExpr("cast(n_nationkey as bigint) as id", "cast(n_nationkey as bigint) as archive_id", "n_name as relative_path", "n_name as logical_id", "n_name as composer", "n_name as title", "n_name as status")
    first = catalogue.build_index(rows.where("pos % 2 = 0"), archives, entries)
    tables.publish({"archives": first.archives, "entries": first.entries}, run_id="first import")
    both = catalogue.build_index(rows, tables.read("archives"), tables.read("entries"))
    publish_failing_once(tables, {"archives": both.archives, "entries": both.entries}, "second import", "archives")
    named = tables.read("archives").select(F.col("id").alias("archive_id"), F.col("name").alias("archive"))
    return tables.read("entries").join(named, "archive_id").select("id", "archive", "relative_path", "title")


EARLY, SWITCHES = "event_id % 97 = 0 AND ts < TIMESTAMP '2024-01-06'", ("2024-01-11", "2024-01-21")


@query(
    f"WITH v AS (SELECT DISTINCT user_id, event_id % 200 AS work_id, CAST(ts AS DATE) AS d FROM events WHERE NOT ({EARLY}))"
    f" SELECT work_id, count(*) AS n, (SELECT count(*) FROM events WHERE {EARLY}) AS late FROM v GROUP BY work_id"
)
def st1_late_votes(t):
    """Votes that come in three lots, each a run from the checkpoint of the last. Some of the first days
    come with the last lot, too late; some of one day come with the next lot, within the watermark."""
    spark = t("events").sparkSession
    root = own_folder(t("events"), "votes")
    given = votes(t).withColumn("voted_at", F.col("voted_at").cast("timestamp"))
    day = F.date_format("voted_at", "yyyy-MM-dd")
    late = (F.col("id") % 97 == 0) & (day < "2024-01-06")
    slow = (F.col("id") % 50 == 1) & (day == "2024-01-10")
    lot = F.when(late, 2).when(slow, 1).when(day < SWITCHES[0], 0).when(day < SWITCHES[1], 1).otherwise(2)
    items = votes(t).select("work_id").distinct()
    dropped = 0
    for k in range(3):
        given.where(lot == k).write.mode("append").parquet(f"{root}/in")
        stream = streams.vote_stream(spark.readStream.schema(given.schema).parquet(f"{root}/in"), items)
        intake = streams.take_votes(stream, f"{root}/accepted", f"{root}/state/accepted")
        intake.awaitTermination()
        dropped += streams.late_votes(intake)
        accepted = spark.readStream.schema(stream.schema).parquet(f"{root}/accepted")
        streams.count_votes(accepted, f"{root}/totals", f"{root}/state/totals").awaitTermination()
    return streams.total_counts(spark, root).select("work_id", "n", F.lit(dropped).cast("long").alias("late"))


@query(
    "WITH b AS (SELECT o_orderkey, o_custkey, o_orderkey % 6 AS kind, o_orderkey // 6 % 3 AS lot, coalesce(c_acctbal > 5000, false) AS known FROM orders LEFT JOIN customer ON c_custkey = o_custkey),"
    " f AS (SELECT o_custkey, min(lot) AS first FROM b WHERE kind >= 4 AND NOT known GROUP BY o_custkey)"
    " SELECT o_orderkey AS work_id, CASE kind WHEN 0 THEN 'no_title' WHEN 1 THEN 'error' WHEN 2 THEN 'not_applicable' WHEN 3 THEN 'no_match' ELSE CASE WHEN known OR lot > first THEN 'matched_existing' ELSE 'composer_created' END END AS outcome,"
    f" CASE WHEN kind >= 4 THEN CASE WHEN known THEN 'm' || o_custkey ELSE {uuid5_sql("'250k:viaf:V' || o_custkey")} END END AS composer_id FROM b LEFT JOIN f USING (o_custkey)"
)
def st2_matched_stream(t):
    """E7 over three lots of works. The second run fails after its publication and is run again; the entities
    that a lot makes are there for the next."""
    orders, spark = t("orders"), t("orders").sparkSession
    root = own_folder(orders, "matching")
    candidate = "array(named_struct('name', concat('maker  ', o_custkey), 'external_ids', map('VIAF', concat('V', o_custkey)))) as candidates"
    works = orders.selectExpr(
        "o_orderkey as id", "if(o_orderkey % 6 = 0, ' ', 'A title') as title", "if(o_orderkey % 6 = 2, 'Anonymous', concat('Maker ', o_custkey)) as composer",
        "cast(null as string) as composer_id", "case o_orderkey % 6 when 1 then null when 3 then 'unknown' else 'resolved' end as status", candidate,
    )
    tables = TableSet(spark, f"{root}/set")
    tables.publish(
        {
            "composers": t("customer").selectExpr("concat('m', c_custkey) as id", "c_name as name", "'active' as status", "true as visible", "cast(null as string) as merged_into"),
            "aliases": t("customer").selectExpr("concat('m', c_custkey) as composer_id", "c_name as alias", "lower(c_name) as normalized_alias"),
            "identifiers": t("customer").where("c_acctbal > 5000").selectExpr("concat('m', c_custkey) as composer_id", "'viaf' as id_type", "concat('V', c_custkey) as id_value", "true as is_identity_anchor"),
        },
        run_id="import",
    )

    def fail(batch_id: int) -> None:
        raise Interrupted(f"batch {batch_id}")

    def run(published=None) -> None:
        stream = spark.readStream.schema(works.schema).parquet(f"{root}/in")
        streams.match_stream(stream, tables, f"{root}/checkpoint", published=published).awaitTermination()

    for k in range(3):
        works.where(f"id div 6 % 3 = {k}").write.mode("append").parquet(f"{root}/in")
        if k == 1:
            try:
                run(fail)
            except StreamingQueryException:
                pass
            else:
                raise RuntimeError("the run did not stop")
        run()
    return streams.match_outcomes(tables)


PIECE = "substr(p_name, 1 + p_partkey % 5, 1 + p_partkey % 7)"


@query(f"SELECT DISTINCT p.p_partkey AS id, n.needle FROM part p JOIN (SELECT DISTINCT {PIECE} AS needle FROM part UNION SELECT DISTINCT lower(mktsegment) FROM (SELECT c_mktsegment AS mktsegment FROM customer)) n ON trim(n.needle) <> '' AND contains(trim(regexp_replace(lower(p.p_name), '[\\s]+', ' ', 'g')), trim(regexp_replace(lower(n.needle), '[\\s]+', ' ', 'g')))")
def p7_containment_join(t):
    """All names of parts with all needles, pieces of one to seven signs of the names among them."""
    needles = t("part").selectExpr(f"{PIECE} as needle").unionByName(t("customer").selectExpr("lower(c_mktsegment) as needle")).distinct()
    return contain.catalogues_containing(t("part").selectExpr("p_partkey as id", "p_name as composer"), needles)


@query("SELECT DISTINCT c.c_custkey AS id, n.needle FROM (SELECT DISTINCT right(c_name, 3 + c_custkey % 5) AS needle FROM customer) n JOIN customer c ON contains(lower(c.c_name), n.needle) WHERE c.c_custkey % 3 > 0 OR c.c_custkey % 2 = 0")
def p3_composers_like_any(t):
    """Entities by name (a third of them has another name, and two thirds an alias) with the last digits of all names."""
    composers = t("customer").selectExpr("c_custkey as id", "if(c_custkey % 3 = 0, '?', c_name) as name", "'active' as status")
    aliases = t("customer").where("c_custkey % 2 = 0").selectExpr("c_custkey as composer_id", "lower(c_name) as normalized_alias")
    return contain.composers_like_any(composers, aliases, t("customer").selectExpr("right(c_name, 3 + c_custkey % 5) as needle"))


@query("SELECT l_suppkey AS supplier, sum(length(line)) AS length, sha256(string_agg(line, '' ORDER BY l_orderkey, l_linenumber, l_partkey)) AS sha256 FROM (SELECT *, concat(l_orderkey, ',', l_linenumber, ',', l_partkey, chr(10)) AS line FROM lineitem) GROUP BY l_suppkey")
def c1_hashed_files(t):
    """A file for each supplier, written by Spark and hashed as a stream."""
    root, own = own_folder(t("lineitem"), "files"), ["l_suppkey", "l_orderkey", "l_linenumber", "l_partkey"]
    lines = t("lineitem").select(*own, F.concat_ws(",", "l_orderkey", "l_linenumber", "l_partkey").alias("value"))
    lines.repartition("l_suppkey").sortWithinPartitions(*own).select(F.col("l_suppkey").alias("supplier"), "value").write.partitionBy("supplier").text(root)
    hashes = content.hash_files(lines.sparkSession, root, "*.txt")
    return hashes.select(F.regexp_extract("path", "supplier=(\\d+)", 1).cast("long").alias("supplier"), "length", "sha256")


@query(
    "WITH e AS (SELECT doc_id, doc_id // 50 AS archive, text, row_number() OVER (PARTITION BY doc_id // 50 ORDER BY './' || lpad(CAST(doc_id AS VARCHAR), 12, '0')) AS turn FROM documents),"
    " r AS (SELECT *, archive % 7 <> 3 OR turn <= 3 AS ready FROM e)"
    " SELECT doc_id AS id, archive AS archive_id, ready, CASE WHEN ready THEN sha256(text) END AS sha256, CASE WHEN ready THEN strlen(text) END AS size, CASE WHEN bool_or(ready) OVER (PARTITION BY archive) THEN 'materialized' ELSE 'failed' END AS archive_status FROM r"
)
def c3_archives_on_disk(t):
    """Documents packed into TAR files, of which every seventh breaks off in the header of its fourth member;
    listed, read by offsets, and joined to their entries."""
    spark, root = t("documents").sparkSession, own_folder(t("documents"), "archives")
    path = F.concat(F.lit("./"), F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    entries = t("documents").select(F.col("doc_id").alias("id"), F.expr("doc_id div 50").alias("archive_id"), path.alias("relative_path"))
    members = entries.join(t("documents").select(F.col("doc_id").alias("id"), F.encode("text", "UTF-8").alias("content")), "id")
    content.pack_archives(members, root).write.format("noop").mode("overwrite").save()

    def archives():
        files = readers.list_files(spark, root, "*.tar")
        return files.select(F.regexp_extract("relative_path", "(\\d+)", 1).cast("long").alias("id"), F.concat(F.lit(f"{root}/"), "relative_path").alias("path"))

    fourth = content.archive_index(archives().where("id % 7 = 3")).withColumn("turn", F.row_number().over(Window.partitionBy("archive_id").orderBy("offset"))).where("turn = 4")
    content.truncate_files(fourth.select("path", (F.col("offset") - 256).alias("length"))).write.format("noop").mode("overwrite").save()
    listed = archives()
    done = content.expand_archives(listed.withColumn("status", F.lit("imported")), entries, content.archive_members_by_range(listed))
    states = done.archives.select(F.col("id").alias("archive_id"), F.col("status").alias("archive_status"))
    return done.entries.join(states, "archive_id").select("id", "archive_id", (F.col("status") == "ready").alias("ready"), "sha256", "size", "archive_status")


@query(
    "WITH v AS (SELECT event_id AS id, CASE WHEN event_id % 101 > 0 THEN CAST(user_id AS VARCHAR) END AS user_id, event_id % 200 AS work_id, CAST(floor(value) AS BIGINT) % 7 AS vote, CAST(ts AS DATE) AS d FROM events),"
    " vr AS (SELECT *, concat_ws(',', CASE WHEN user_id IS NULL THEN 'null:user_id' END, CASE WHEN vote NOT BETWEEN 1 AND 5 THEN 'value:vote' END) AS reason FROM v),"
    " vk AS (SELECT id, row_number() OVER (PARTITION BY user_id, work_id, d ORDER BY id) AS turn FROM vr WHERE reason = ''),"
    " a AS (SELECT p_partkey AS id, 'c' || p_partkey % 40 AS composer_id, p_name, CASE WHEN p_partkey % 11 > 0 THEN 'name' END AS name_type FROM part),"
    " ak AS (SELECT id, row_number() OVER (PARTITION BY composer_id, p_name ORDER BY id) AS turn FROM a WHERE name_type IS NOT NULL)"
    " SELECT 'votes' AS name, id, reason FROM vr WHERE reason <> '' UNION ALL SELECT 'votes', id, 'key:user_id,work_id,vote_day' FROM vk WHERE turn > 1"
    " UNION ALL SELECT 'aliases', id, 'null:name_type' FROM a WHERE name_type IS NULL UNION ALL SELECT 'aliases', id, 'key:composer_id,normalized_alias' FROM ak WHERE turn > 1"
)
def s10_typed_rejects(t):
    """Two tables written under the registry's names and scanned in its types; what breaks its rules."""
    spark, root = t("events").sparkSession, own_folder(t("events"), "typed")
    given = t("events").selectExpr(
        "event_id as id", "if(event_id % 101 > 0, cast(user_id as string), null) as user_id", "event_id % 200 as work_id", "cast(cast(floor(value) as bigint) % 7 as int) as vote",
        "cast(ts as timestamp) as voted_at", "cast(ts as date) as vote_day",
    )
    given.write.parquet(f"{root}/votes.parquet")
    t("part").selectExpr(
        "p_partkey as id", "concat('c', p_partkey % 40) as composer_id", "p_name as alias", "p_name as normalized_alias", "if(p_partkey % 11 > 0, 'name', null) as name_type",
        "cast(null as string) as language", "'part' as source", "p_size as more",
    ).write.parquet(f"{root}/composer_aliases.parquet")
    found = [registry.scan_typed(spark, root, table).rejects.select(F.lit(name).alias("name"), "id", "reason") for name, table in (("votes", "votes"), ("aliases", "composer_aliases"))]
    return found[0].unionByName(found[1])


@query(
    "WITH o AS (SELECT o_orderkey % 2 AS run, CASE o_orderkey % 5 WHEN 0 THEN 'matched_existing' WHEN 1 THEN 'no_match' WHEN 2 THEN 'error' ELSE 'other' END AS outcome FROM orders)"
    " SELECT CASE run WHEN 0 THEN '01' ELSE 'second run' END AS run_id, outcome, count(*) AS n, sum(count(*)) OVER (PARTITION BY run)::BIGINT AS rows FROM o GROUP BY run, outcome"
)
def s11_run_counters(t):
    """Outcomes of two runs, the first one written twice, counted while they are written and again in the rows."""
    spark, path = t("orders").sparkSession, own_folder(t("orders"), "runs")
    outcome = "case o_orderkey % 5 when 0 then 'matched_existing' when 1 then 'no_match' when 2 then 'error' when 3 then 'unheard' end as outcome"
    rows, known = t("orders").selectExpr("o_orderkey as work_id", outcome), ("matched_existing", "no_match", "error")
    lots = (("01", "work_id % 2 = 0 and work_id % 3 = 0"), ("01", "work_id % 2 = 0"), ("second run", "work_id % 2 = 1"))
    runs = {run_id: readers.append_results(rows.where(where), path, run_id, outcome="outcome", outcomes=known) for run_id, where in lots}
    observed = readers.run_summary(spark, list(runs.values())).select("run_id", "outcome", "n", "rows")
    listed = F.when(F.col("outcome").isin(*known), F.col("outcome")).otherwise("other")
    stored = readers.read_results(spark, path).groupBy("run_id", listed.alias("outcome")).agg(F.count("*").alias("stored"))
    return observed.join(stored, ["run_id", "outcome"]).where("n = stored").drop("stored")


@query("SELECT name, count(*) AS n FROM documents, (SELECT unnest(['normalize_name', 'clean_name', 'is_mojibake', 'classify_name', 'catalogue_prefix', 'validate_name', 'extract_name', 'name_key']) AS name) GROUP BY name")
def u2_sql_functions(t):
    """Rows on which each function gives the same from SQL as from its Column form."""
    spark = t("documents").sparkSession
    names.register_functions(spark)
    forms = {
        "normalize_name": names.normalize_name, "clean_name": names.clean_name, "is_mojibake": names.is_mojibake, "classify_name": names.classify_name,
        "catalogue_prefix": names.catalogue_prefix, "validate_name": names.validate_name, "extract_name": names.extract_name, "name_key": names.name_key,
    }
    both = t("documents").select(*(F.expr(f"{name}(text)").eqNullSafe(form(F.col("text"))).alias(name) for name, form in forms.items()))
    counts = both.agg(*(F.count_if(F.col(name)).alias(name) for name in forms))
    return counts.select(F.explode(F.create_map(*(part for name in forms for part in (F.lit(name), F.col(name))))).alias("name", "n"))


@query("SELECT p_partkey AS id, p_name AS name, p_size AS size FROM part WHERE p_size > 5")
def s7_jdbc_index(t):
    """Parts in a Derby database of this JVM, read back in ranges of their key. Such a database is not there for
    executors of their own, so this query is one for local mode."""
    spark, url = t("part").sparkSession, f"jdbc:derby:memory:index{uuid.uuid4().hex};create=true"
    props = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    t("part").selectExpr("p_partkey as id", "p_name as name", "cast(p_size as int) as size").write.jdbc(url, "works", properties=props)
    found = readers.read_jdbc_index(spark, url, "works", props, key="id", rows_per_task=500, columns=("id", "name", "size"), where='"size" > 5')
    return found


OWNER = "if(o_orderkey % 3 = 0, 1, o_custkey)"
PAGED = "o.o_orderkey, CASE WHEN o.o_orderkey % 3 = 0 THEN 1 ELSE o.o_custkey END AS work_id"


@query(
    f"WITH c AS (SELECT {PAGED}, o_orderstatus FROM orders o), own AS (SELECT * FROM c WHERE work_id IN (SELECT c_custkey FROM customer)),"
    " r AS (SELECT work_id, (row_number() OVER (PARTITION BY work_id ORDER BY o_orderkey) - 1) // 7 AS page, o_orderkey FROM own),"
    " g AS (SELECT work_id, (row_number() OVER (PARTITION BY work_id ORDER BY o_orderkey) - 1) // 7 AS page, o_orderstatus AS v, o_orderkey FROM own WHERE o_orderkey % 2 = 0),"
    " i AS (SELECT work_id, (row_number() OVER (PARTITION BY work_id ORDER BY o_orderkey) - 1) // 7 AS page, 'i' || o_orderkey % 9 AS v, o_orderkey FROM own WHERE o_orderkey % 5 <> 0),"
    " p AS (SELECT work_id, (row_number() OVER (PARTITION BY work_id ORDER BY o_orderkey) - 1) // 7 AS page, 'p' || o_orderkey % 4 AS v, o_orderkey FROM own WHERE o_orderkey % 7 = 0),"
    " k AS (SELECT c_custkey AS id, 0 AS page FROM customer UNION SELECT work_id, page FROM r),"
    " rl AS (SELECT work_id, page, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS s FROM r GROUP BY ALL), gl AS (SELECT work_id, page, string_agg(v, ',' ORDER BY o_orderkey) AS s FROM g GROUP BY ALL),"
    " il AS (SELECT work_id, page, string_agg(v, ',' ORDER BY o_orderkey) AS s FROM i GROUP BY ALL), pl AS (SELECT work_id, page, string_agg(v, ',' ORDER BY o_orderkey) AS s FROM p GROUP BY ALL)"
    " SELECT k.id, k.page, coalesce(rl.s, '') AS resources, coalesce(gl.s, '') AS genres, coalesce(il.s, '') AS instruments, coalesce(pl.s, '') AS parts FROM k"
    " LEFT JOIN rl ON rl.work_id = k.id AND rl.page = k.page LEFT JOIN gl ON gl.work_id = k.id AND gl.page = k.page LEFT JOIN il ON il.work_id = k.id AND il.page = k.page LEFT JOIN pl ON pl.work_id = k.id AND pl.page = k.page"
)
def j13_work_pages(t):
    """Works with a third of all resources on one of them, seven children of each kind to a page."""
    works = t("customer").selectExpr("c_custkey as id", "c_name as title")
    rows = t("orders").selectExpr("o_orderkey as id", f"{OWNER} as work_id", "concat('a/', o_orderkey, '.pdf') as relative_path", "o_orderkey as file_id", "o_orderstatus as genre", "concat('i', o_orderkey % 9) as instrument", "concat('p', o_orderkey % 4) as part_name")
    out = search.work_pages(works, rows, rows.where("id % 2 = 0"), rows.where("id % 5 <> 0"), rows.where("id % 7 = 0"), per_page=7)
    listed = {"resources": F.transform("resources", lambda r: r["id"].cast("string")), "genres": F.col("genres"), "instruments": F.col("instruments"), "parts": F.col("parts_names")}
    return out.select("id", "page", *(F.array_join(value, ",").alias(name) for name, value in listed.items()))


@query(
    "WITH o AS (SELECT DISTINCT CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE o_custkey END AS id, o_orderkey FROM orders), own AS (SELECT * FROM o WHERE id IN (SELECT c_custkey FROM customer)),"
    " a AS (SELECT id, (row_number() OVER (PARTITION BY id ORDER BY 'a' || o_orderkey) - 1) // 5 AS page, 'a' || o_orderkey AS v FROM own),"
    " i AS (SELECT id, (row_number() OVER (PARTITION BY id ORDER BY CAST(o_orderkey AS VARCHAR)) - 1) // 5 AS page, CAST(o_orderkey AS VARCHAR) AS v FROM own WHERE o_orderkey % 2 = 0),"
    " e AS (SELECT id, (row_number() OVER (PARTITION BY id ORDER BY 'r' || o_orderkey) - 1) // 5 AS page, 'r' || o_orderkey AS v FROM own WHERE o_orderkey % 5 = 0),"
    " k AS (SELECT c_custkey AS id, 0 AS page FROM customer UNION SELECT id, page FROM a), w AS (SELECT id, count(*) AS n FROM own GROUP BY id)"
    " SELECT k.id, k.page, coalesce((SELECT string_agg(v, ',' ORDER BY v) FROM a WHERE a.id = k.id AND a.page = k.page), '') AS aliases, coalesce((SELECT string_agg(v, ',' ORDER BY v) FROM i WHERE i.id = k.id AND i.page = k.page), '') AS identifiers,"
    " coalesce((SELECT string_agg(v, ',' ORDER BY v) FROM e WHERE e.id = k.id AND e.page = k.page), '') AS evidence, coalesce(w.n, 0) AS work_count FROM k LEFT JOIN w ON w.id = k.id"
)
def j15_composer_pages(t):
    """Entities with a third of all aliases on one of them, five of each list to a page."""
    rows = t("orders").selectExpr("o_orderkey as k", f"{OWNER} as composer_id", "concat('a', o_orderkey) as alias", "'viaf' as id_type", "cast(o_orderkey as string) as id_value", "concat('r', o_orderkey) as rule", "'d' as decision")
    out = search.composer_pages(t("customer").selectExpr("c_custkey as id"), rows, rows, rows.where("k % 2 = 0"), rows.where("k % 5 = 0"), per_page=5)
    listed = {"aliases": F.col("aliases"), "identifiers": F.transform("identifiers", lambda i: i["id_value"]), "evidence": F.transform("evidence", lambda e: e["rule"])}
    return out.select("id", "page", *(F.array_join(value, ",").alias(name) for name, value in listed.items()), "work_count")


@query(
    "WITH s AS (SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'V' || c_custkey WHEN 1 THEN 'old' || c_custkey END AS old, c_custkey % 10 >= 8 AS bad FROM customer)"
    " SELECT CAST(k AS VARCHAR) AS entity_id, CASE WHEN bad THEN old ELSE 'V' || k END AS value FROM s WHERE NOT bad OR old IS NOT NULL UNION ALL SELECT 'other' || k, 'W' || k FROM s WHERE k % 10 = 8"
)
def e10_ingested_table(t):
    """Identifiers that meet a table: equal, changed, new, blank ones, and values that another entity has."""
    old = t("customer").selectExpr("cast(c_custkey as string) as entity_id", "case c_custkey % 3 when 0 then concat('V', c_custkey) when 1 then concat('old', c_custkey) end as value").where("value is not null")
    others = t("customer").where("c_custkey % 10 = 8").selectExpr("concat('other', c_custkey) as entity_id", "concat('W', c_custkey) as value")
    current = old.unionByName(others).selectExpr("'composer' as entity_type", "entity_id", "'viaf' as scheme", "value", "'x' as source")
    value = "case c_custkey % 10 when 9 then ' ' when 8 then concat('W', c_custkey) else concat('V', c_custkey) end as value"
    snapshot = t("customer").selectExpr("cast(c_custkey as string) as entity_id", "'viaf' as scheme", value, "'y' as source", "c_custkey as pos")
    return identity.ingest_identifiers(current, snapshot, "composer")[0].select("entity_id", "value")


@query(
    "WITH b AS (SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS b FROM pages), c AS (SELECT page_id, CASE WHEN regexp_matches(b, '[^.]\\.[^.]*$') THEN regexp_replace(b, '\\.[^.]*$', '') ELSE b END AS work_key FROM b),"
    " w AS (SELECT work_key, min(page_id % 2) AS round, coalesce(min(page_id) FILTER (page_id % 2 = 0), min(page_id)) AS first_entry, count(*) AS entries FROM c WHERE work_key <> '' GROUP BY 1)"
    " SELECT work_key, row_number() OVER (ORDER BY round, work_key) AS id, first_entry, entries FROM w"
)
def e1_works_in_two_rounds(t):
    """Works of half of the entries, then of all: keys that have a work keep it, and linked entries stay."""
    entries = t("pages").selectExpr("page_id as id", "url as relative_path", "cast(null as string) as composer", "cast(page_id as string) as title", "cast(null as bigint) as work_id")
    works = t("nation").where("false").selectExpr("cast(n_nationkey as bigint) as id", "n_name as work_key", "n_name as relative_path", "n_name as composer", "n_name as composer_id", "n_name as title")
    people = t("nation").selectExpr("n_name as id", "n_name as name", "'active' as status", "cast(null as string) as merged_into")
    aliases = people.selectExpr("id as composer_id", "name as alias", "lower(name) as normalized_alias")
    first = catalogue.build_works(entries.where("id % 2 = 0"), works, aliases, people)
    done = catalogue.build_works(first.entries.unionByName(entries.where("id % 2 = 1")), first.works, aliases, people)
    linked = done.entries.where("work_id is not null").groupBy(F.col("work_id").alias("id")).agg(F.count("*").alias("entries"))
    return done.works.select("work_key", "id", F.col("title").cast("long").alias("first_entry")).join(linked, "id")


@query(
    "WITH c AS (SELECT c_custkey, c_nationkey, c_acctbal > 5000 AS rich, CASE WHEN c_custkey % 4 = 1 THEN c_custkey - 1 ELSE c_custkey END AS canonical FROM customer),"
    " h AS (SELECT s_suppkey, canonical FROM supplier JOIN c ON c_custkey % 50 = s_suppkey UNION SELECT s_suppkey, canonical FROM supplier JOIN c ON rich AND c_nationkey = s_nationkey)"
    " SELECT s_suppkey AS request_id, coalesce(string_agg(canonical, ',' ORDER BY canonical), '') AS ids FROM supplier LEFT JOIN h USING (s_suppkey) GROUP BY s_suppkey"
)
def j11_candidates_by_alias(t):
    """Requests that meet entities by alias and by identifier, some of these merged into others."""
    owners = t("customer").join(t("supplier").select("s_suppkey", "s_name"), F.col("c_custkey") % 50 == F.col("s_suppkey"))
    aliases = owners.select(F.col("c_custkey").alias("composer_id"), names.normalize_name(F.col("s_name")).alias("normalized_alias"))
    composers = t("customer").selectExpr("c_custkey as id", "c_name as name", "if(c_custkey % 4 = 1, 'merged', 'active') as status", "if(c_custkey % 4 = 1, c_custkey - 1, null) as merged_into")
    ids = t("customer").where("c_acctbal > 5000").selectExpr("c_custkey as composer_id", "'viaf' as id_type", "cast(c_nationkey as string) as id_value")
    asked = t("supplier").selectExpr("s_suppkey as request_id", "s_name as name", "array(named_struct('id_type', 'viaf', 'id_value', cast(s_nationkey as string))) as identifiers")
    return resolve.find_candidates(asked, composers, aliases, ids, shape=lambda c: F.array_join(c, ",")).withColumnRenamed("composer_ids", "ids")


SEEDS = ", ".join(f"({', '.join(quoted([v]) for v in row)})" for row in catalogue.CATALOGUES)


@query(
    f"WITH s(prefix, composer, catalogue_name, creator, ordering_criterion) AS (VALUES {SEEDS}), own AS (SELECT 'K' || n_nationkey AS prefix, n_name AS composer, 'Own' AS catalogue_name, 'x' AS creator, 'y' AS ordering_criterion FROM nation)"
    " SELECT * FROM own UNION ALL SELECT prefix, composer, catalogue_name, 'kept', 'kept' FROM s WHERE prefix = 'BWV' UNION ALL SELECT * FROM s WHERE prefix <> 'BWV'"
)
def e18_seeded_rows(t):
    """Seeds beside rows of the nations and one that is there already, which stays as it is."""
    spark, columns = t("nation").sparkSession, ["prefix", "composer", "catalogue_name", "creator", "ordering_criterion"]
    own = t("nation").selectExpr("concat('K', n_nationkey) as prefix", "n_name as composer", "'Own' as catalogue_name", "'x' as creator", "'y' as ordering_criterion")
    there = catalogue.seed_catalogues(spark, own.where("false")).where("prefix = 'BWV'").withColumns({"creator": F.lit("kept"), "ordering_criterion": F.lit("kept")})
    return catalogue.seed_catalogues(spark, own.unionByName(there)).select(*columns)
