"""Registered queries of the name and key functions, over names that are made of the names of parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys, names
from ..operators import search
from .queries import CLASSIFY, query, uuid5_sql

#: Forms of names as catalogues have them; `@` is the name of a part.
FORMS = [
    "arr. by @", "@ (1756-1791)", "Mozart, W. A.", "J. S. Bach", "attributed to @ Jones", "Anon.", "Trad.", "Beethoven, Ludwig van", "@ y Perez", "traditional irish",
    "SMITH", "o'Brien, Pat", "Sean O Neill", "Ã©tude @", "NULL", "", "  -  ", "N/A", "Song by", "By Mary @", "words by Ann Jones", "Ann @ Jones", "Op. 12 @", "Antonín Dvořák",
    "@123", "“@”", "Book of @", "after @", "Urheber unbekannt (@)", "Van der Berg", "harmonized @ [x]", "Symphony @", "Unknown?", "JohnSmith", "Title @ arranged by X Y", "John Field arr. @",
    "Clara Schumann 1819", "de la Rue", "a", "music by Carl Maria von Weber", "@ & Sons",
]


def named(t) -> DataFrame:
    """(k, s): a key and a name."""
    form = F.element_at(F.array(*map(F.lit, FORMS)), (F.col("p_partkey") % len(FORMS) + 1).cast("int"))
    return t("part").select(F.col("p_partkey").alias("k"), F.replace(form, F.lit("@"), F.col("p_name")).alias("s"))


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def one_of(values: list[str], key: str = "p_partkey") -> str:
    return f"list_extract([{quoted(values)}], CAST({key} % {len(values)} + 1 AS INT))"


NAMED = f"nm AS (SELECT p_partkey AS k, replace({one_of(FORMS)}, '@', p_name) AS s FROM part)"
CLEAN = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '[–—]', '-', 'g'), '[^\\p{{L}}-]', ' ', 'g'), '^[ -]+|[ -]+$', '', 'g'), ' +', ' ', 'g')"
UPPER = "regexp_matches(t, '\\p{Lu}') AND NOT regexp_matches(t, '[\\p{Ll}\\p{Lt}]')"
TITLE = "regexp_full_match(t, '\\P{L}*(?:[\\p{Lu}\\p{Lt}]\\p{Ll}*(?:\\P{L}+|$))+')"
#: From a table `c` (k, turn, x): the verdict on each x.
VALIDATED = f"""
tk AS (SELECT k, turn, x, list_filter(regexp_split_to_array(regexp_replace(trim(x), '([a-z])([A-Z])', '\\1 \\2', 'g'), '\\s+'), lambda t: t <> '') AS w FROM c),
pt AS (SELECT k, turn, x, w, len(w) AS n,
  coalesce(list_sum(list_transform(w, lambda t: CASE WHEN length(t) = 1 AND {UPPER} THEN 1.0 WHEN {TITLE} THEN 1.5 WHEN {UPPER} THEN 1.2 WHEN lower(t) IN ({quoted(names.PARTICLES)}) THEN 0.8 ELSE 0.0 END::DOUBLE)), 0) AS score,
  len(list_filter(w, lambda t: ({TITLE}) OR ({UPPER}))) AS capitals,
  len(list_filter(w, lambda t: lower(t) IN ({quoted(names.FORBIDDEN_WORDS)}))) > 0 AS forbidden,
  len(list_filter(w[1:1], lambda t: ({TITLE}) AND length(t) > 1 AND NOT regexp_full_match(t, '[0-9]+'))) > 0 AS lone FROM tk),
v AS (SELECT k, turn, x,
  CASE WHEN n = 0 THEN 'empty' WHEN n = 1 AND lone AND NOT forbidden THEN 'single surname' WHEN n = 1 THEN 'single word' WHEN forbidden THEN 'forbidden word'
       WHEN n = 2 AND capitals >= 1 AND score >= 2.0 THEN 'two words' WHEN score >= 2.5 THEN 'person' ELSE 'score too low' END AS reason,
  CASE WHEN n = 0 OR forbidden OR (n = 1 AND NOT lone) THEN 0.0 WHEN n = 1 THEN 0.7 ELSE score END AS points FROM pt)"""
GOOD = "reason IN ('single surname', 'two words', 'person')"


@query(f"WITH {NAMED} SELECT k, rtrim(lower(strip_accents(s))) AS key FROM nm")
def f1_fold_key(t):
    return named(t).select("k", names.fold_key(F.col("s")).alias("key"))


@query(f"WITH {NAMED} SELECT k, CASE WHEN lower(trim(s)) NOT IN ({quoted(names.NULL_WORDS)}) THEN trim(s) END AS name FROM nm")
def f2_clean_null(t):
    return named(t).select("k", names.clean_null(F.col("s")).alias("name"))


@query(f"WITH {NAMED} SELECT k, lower(regexp_replace(trim(s), '\\s+', ' ', 'g')) AS name FROM nm")
def f4_norm_light(t):
    return named(t).select("k", names.norm_light(F.col("s")).alias("name"))


@query(f"WITH {NAMED}, c AS (SELECT k, 0 AS turn, s AS x FROM nm), {VALIDATED} SELECT k, {GOOD} AS valid, round(points, 6) AS score, reason FROM v")
def f9_validate_name(t):
    v = names.validate_name(F.col("s"))
    return named(t).select("k", v["valid"].alias("valid"), F.round(v["score"], 6).alias("score"), v["reason"].alias("reason"))


_AFTER = ", ".join(f"CASE WHEN instr(lower(s), '{m}') > 0 THEN substr(s, instr(lower(s), '{m}') + {len(m)}) END" for m in names.NAME_FOLLOWS)
EXTRACTED = f"""
mk AS (SELECT k, s, coalesce({_AFTER}, CASE WHEN regexp_matches(s, '(?is)^(.*?)\\barr(?:\\.|anged)') THEN regexp_extract(s, '(?is)^(.*?)\\barr(?:\\.|anged)', 1) END,
  CASE WHEN regexp_matches(s, '(?is)^.*\\bby\\b(.*)$') THEN regexp_extract(s, '(?is)^.*\\bby\\b(.*)$', 1) END) AS m FROM (SELECT k, trim(s) AS s FROM nm)),
c AS (SELECT k, 0 AS turn, {CLEAN.format("regexp_replace(m, '^[ \\[\\]()\\t.:]+|[ \\[\\]()\\t.:]+$', '', 'g')")} AS x FROM mk WHERE nullif(m, '') IS NOT NULL
      UNION ALL SELECT k, 1, {CLEAN.format('s')} FROM mk), {VALIDATED},
ex AS (SELECT k, arg_min(x, turn) AS name FROM v WHERE {GOOD} AND x <> '' GROUP BY k)"""
BAD = "contains(s, chr(65533)) OR regexp_matches(s, '[ÐÃ]') OR length(regexp_replace(s, '[^ÐÃÅãåçêëîíì]', '', 'g')) >= 2"


@query(f"WITH {NAMED}, {EXTRACTED} SELECT nm.k, CASE WHEN NOT ({BAD}) AND trim(s) <> '' THEN ex.name END AS name FROM nm LEFT JOIN ex USING (k)")
def f10_extract_part_names(t):
    return named(t).select("k", names.extract_name(F.col("s")).alias("name"))


@query(f"WITH {NAMED}, {EXTRACTED} SELECT nm.k, CASE WHEN NOT ({BAD}) AND trim(s) <> '' THEN coalesce(CASE WHEN NOT EXISTS (SELECT 1 FROM mk WHERE mk.k = nm.k AND nullif(m, '') IS NOT NULL) THEN 'Ada Lovelace' END, ex.name) END AS name FROM nm LEFT JOIN ex USING (k)")
def u1_extract_with_recogniser(t):
    """The recogniser is asked only where no mark is found; here it always gives one name."""
    return named(t).select("k", names.extract_name(F.col("s"), lambda c: F.lit("Ada Lovelace")).alias("name"))


@query(f"WITH {NAMED} SELECT k, {CLASSIFY} <> 'correct' AS suspicious FROM (SELECT k, trim(s) AS s FROM nm)")
def f11_is_suspicious(t):
    return named(t).select("k", names.is_suspicious(F.col("s")).alias("suspicious"))


def _regex(patterns: list[str]) -> str:
    return "'" + "|".join(patterns).replace("'", "''") + "'"


LABEL = f"""lb AS (SELECT k, s, low, {CLASSIFY} AS form, list_filter(string_split({CLEAN.format('s')}, ' '), lambda w: w <> '') AS w FROM (SELECT k, trim(s) AS s, lower(trim(s)) AS low FROM nm)),
la AS (SELECT k, s, CASE WHEN low IN ({quoted(names.ANONYMOUS_IN_CANDIDATES)}) OR starts_with(low, '{names.ANONYMOUS_PREFIX}') THEN 'no_persona' WHEN {BAD} THEN 'mojibake' WHEN regexp_matches(low, {_regex(names.QUALIFIERS)}) THEN 'qualifier'
  WHEN regexp_matches(low, {_regex(names.NO_PERSON)}) OR regexp_matches(s, '^["“]|["”]$') OR len(w) = 0 OR len(list_filter(w, lambda x: length(x) > 1)) = 0 OR length(array_to_string(w, '')) <= 2 THEN 'no_persona'
  WHEN form = 'correct' THEN 'real' WHEN form = 'incorrect' THEN 'no_persona' ELSE 'review' END AS label FROM lb)"""
VERDICT = "CASE label WHEN 'real' THEN 'correct' WHEN 'review' THEN 'not_reviewed' ELSE 'incorrect' END"


@query(f"WITH {NAMED}, {LABEL} SELECT k, label, {VERDICT} AS verdict FROM la")
def f12_candidate_label(t):
    return named(t).select("k", names.candidate_label(F.col("s"))["label"].alias("label"), names.candidate_label(F.col("s"))["verdict"].alias("verdict"))


@query("SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN p_size WHEN 1 THEN NULL ELSE -p_partkey END AS n FROM part")
def f15_to_int(t):
    given = F.expr("case p_partkey % 3 when 0 then concat(' ', p_size, ' ') when 1 then p_name else concat('-', p_partkey) end")
    return t("part").select(F.col("p_partkey").alias("k"), names.to_int(given).cast("long").alias("n"))


ENDS = [".mxl", ".PDF", ".mid", ".tar.gz", "", ".x", ".MuseScore", "/.hidden", ".mscz"]


@query(
    f"SELECT k, CASE e WHEN '.mxl' THEN 'MusicXML' WHEN '.pdf' THEN 'PDF' WHEN '.mid' THEN 'MIDI' WHEN '.mscz' THEN 'MuseScore' ELSE nullif(upper(regexp_replace(e, '^\\.+', '')), '') END AS format FROM (SELECT p_partkey AS k, lower(regexp_extract(p_brand || '/' || p_name || {one_of(ENDS)}, '[^./](\\.[^./]*)$', 1)) AS e FROM part)"
)
def f16_format_of(t):
    end = F.element_at(F.array(*map(F.lit, ENDS)), (F.col("p_partkey") % len(ENDS) + 1).cast("int"))
    return t("part").select(F.col("p_partkey").alias("k"), keys.format_of(F.concat("p_brand", F.lit("/"), "p_name", end)).alias("format"))


REFERENCES = ["BWV 846", "K. 15h", "Op. 12", "No 3", "Hob XVI", "12", "op.", "RV 5 @", " WoO  59", "Nos 1-3", "", "@"]


@query(
    f"SELECT k, CASE WHEN lower(p) NOT IN ({quoted(names.GENERIC_PREFIXES)}) THEN p END AS prefix FROM (SELECT p_partkey AS k, coalesce(nullif(regexp_extract(s, '^([A-Za-z]+)\\.', 1), ''), nullif(regexp_extract(s, '^([A-Za-z]+)\\s+[0-9]', 1), '')) AS p FROM (SELECT p_partkey, trim(replace({one_of(REFERENCES)}, '@', p_name)) AS s FROM part))"
)
def f17_catalogue_prefix(t):
    form = F.element_at(F.array(*map(F.lit, REFERENCES)), (F.col("p_partkey") % len(REFERENCES) + 1).cast("int"))
    return t("part").select(F.col("p_partkey").alias("k"), names.catalogue_prefix(F.replace(form, F.lit("@"), F.col("p_name"))).alias("prefix"))


@query(f"WITH {NAMED} SELECT k, nullif(left(trim(s), 7), '') AS name FROM nm")
def f18_clip(t):
    return named(t).select("k", names.clip(F.col("s"), 7).alias("name"))


@query(f"WITH {NAMED} SELECT k, trim(s) <> '' AND k % 3 <> 0 AND NOT regexp_matches(trim(s), '(?i){names.WORK_TITLES}') AS person FROM nm")
def f19_is_person_entry(t):
    return named(t).select("k", names.is_person_entry(F.col("s"), F.when(F.col("k") % 3 != 0, "Q1")).alias("person"))


@query(f"WITH {NAMED} SELECT k, low IN ({quoted(names.ANONYMOUS_IN_MATCHING)}) OR starts_with(low, '{names.ANONYMOUS_PREFIX}') AS anonymous FROM (SELECT k, regexp_replace(lower(trim(s)), '[?¿¡!.]+\\s*$', '') AS low FROM nm)")
def f20_is_anonymous(t):
    return named(t).select("k", names.is_anonymous(F.col("s")).alias("anonymous"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN CAST(year(o_orderdate) AS VARCHAR) END AS year FROM orders")
def f23_year_of(t):
    return t("orders").select("o_orderkey", names.year_of(F.expr("if(o_orderkey % 4 > 0, cast(o_orderdate as string), concat('c. ', o_orderdate))")).alias("year"))


@query(f"WITH {NAMED} SELECT k, trim(regexp_replace(regexp_replace(trim(s), '\\s+[0-9]{{3,4}}\\s*$', ''), '\\([^)]*\\)', '', 'g')) AS name FROM nm")
def f24_display_name(t):
    return named(t).select("k", names.display_name_from_attribution(F.col("s")).alias("name"))


KINDS = ["mbid", "MusicBrainz", "viaf", "wikidata", "Wikidata_QID", "isni", "ipi", "imslp", "other", ""]


@query(f"SELECT p_partkey AS k, CASE i WHEN 'musicbrainz' THEN 'mbid' WHEN 'wikidata' THEN 'qid' WHEN 'wikidata_qid' THEN 'qid' WHEN 'other' THEN NULL WHEN '' THEN NULL ELSE i END AS kind, i NOT IN ('other', '') AS strong FROM (SELECT p_partkey, lower({one_of(KINDS)}) AS i FROM part)")
def f25_id_type(t):
    kind = keys.id_type(F.element_at(F.array(*map(F.lit, KINDS)), (F.col("p_partkey") % len(KINDS) + 1).cast("int")))
    return t("part").select(F.col("p_partkey").alias("k"), kind.alias("kind"), F.coalesce(keys.is_strong(kind), F.lit(False)).alias("strong"))


@query(f"SELECT page_id, 'ext:' || sha1(url) AS key, {uuid5_sql('html')} AS uuid FROM pages")
def f26_external_keys(t):
    return t("pages").select("page_id", keys.external_key(F.col("url")).alias("key"), keys.uuid5(F.col("html")).alias("uuid"))


@query("SELECT page_id, CASE WHEN page_id % 3 < 2 THEN sha256(html) END AS sha256 FROM pages")
def f28_valid_sha256(t):
    given = F.expr("case page_id % 3 when 0 then upper(sha2(html, 256)) when 1 then concat(' ', sha2(html, 256), ' ') else left(sha2(html, 256), 63) end")
    return t("pages").select("page_id", keys.valid_sha256(given).alias("sha256"))


@query(
    "WITH e AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'V' || c_custkey END AS rv, CASE WHEN c_custkey % 5 = 0 THEN 'W' || c_custkey END AS ov, CASE WHEN c_custkey % 2 = 0 THEN 'Q' || c_nationkey END AS q, CASE WHEN c_custkey % 7 = 0 THEN 'm' || c_nationkey END AS m FROM customer) SELECT k, CASE WHEN coalesce(rv, ov) IS NOT NULL THEN 'viaf:' || coalesce(rv, ov) WHEN m IS NOT NULL THEN 'mbid:' || m ELSE 'qid:' || q END AS key, CASE WHEN coalesce(rv, ov, m, q) IS NOT NULL THEN 'Name ' || k END AS name, CASE WHEN coalesce(rv, ov, m, q) IS NOT NULL THEN coalesce(rv, ov, m) IS NOT NULL END AS strong FROM e"
)
def f30_identity_payload(t):
    field = lambda name, prefix, by, col: f"case when c_custkey % {by} = 0 then concat(',\"{name}\":\"{prefix}', {col}, '\"') else '' end"
    evidence = F.expr(f"concat('{{\"open\":{{\"canonical_name\":\"Name ', c_custkey, '\"', {field('viaf', 'W', 5, 'c_custkey')}, {field('qid', 'Q', 2, 'c_nationkey')}, {field('mbid', 'm', 7, 'c_nationkey')}, '}}}}')")
    p = keys.identity_payload(F.expr("if(c_custkey % 3 = 0, concat('by viaf=V', c_custkey), null)"), evidence)
    return t("customer").select(F.col("c_custkey").alias("k"), p["key"].alias("key"), p["name"].alias("name"), p["strong"].alias("strong"))


@query("SELECT o_orderkey, round((o_custkey * coalesce(nullif(o_orderkey % 6, 0), 0) + 5 * 2.5) / (o_custkey + 5), 6) AS rating, round(least(1.0, o_custkey / 5.0), 6) AS confidence FROM orders")
def f31_adjusted_rating(t):
    given = F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderkey") % 6)
    return t("orders").select("o_orderkey", F.round(keys.adjusted_rating(F.col("o_custkey"), given.cast("double"), F.lit(2.5)), 6).alias("rating"), F.round(keys.confidence(F.col("o_custkey")), 6).alias("confidence"))


@query("SELECT page_id, page_id % 2 = 0 AND page_id % 3 <> 0 AS available FROM pages")
def p9_entry_available(t):
    return t("pages").selectExpr("page_id", "if(page_id % 2 = 0, 'ready', 'missing') as status", "if(page_id % 3 = 0, null, page_id) as file_id").select("page_id", search.entry_available().alias("available"))


@query("SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN 'http://x/api/v1/files/' || page_id || '/content' END AS link FROM pages")
def p11_resource_url(t):
    return t("pages").select("page_id", keys.resource_url(F.col("url"), F.expr("if(page_id % 3 = 0, null, page_id)"), keys.Links(base_url="http://x/")).alias("link"))


@query(
    f"WITH {NAMED}, d AS (SELECT k, CASE WHEN k % 4 = 0 THEN '' ELSE 'f' || k || '.pdf' END AS f, CASE WHEN k % 3 > 0 THEN s END AS title, CASE WHEN k % 5 > 0 THEN 'id/' || k END AS lid, CASE k % 2 WHEN 0 THEN 'Bach' ELSE '' END AS composer FROM nm), l AS (SELECT *, coalesce(nullif(title, ''), nullif(lid, '')) AS label FROM d), n AS (SELECT *, regexp_replace(trim(regexp_replace(CASE WHEN composer <> '' AND NOT contains(label, composer) THEN composer || ' - ' || label ELSE label END, '[\\\\/:*?\"<>|\\x00-\\x1f]+', '-', 'g')), '^\\.+|\\.+$', '', 'g') AS safe FROM l) SELECT k, CASE WHEN coalesce(safe, '') <> '' THEN safe || CASE WHEN f = '' THEN '.mxl' ELSE '.pdf' END ELSE coalesce(nullif(f, ''), 'file') END AS name FROM n"
)
def p13_download_names(t):
    rows = named(t).selectExpr("k", "if(k % 4 = 0, '', concat('f', k, '.pdf')) as f", "if(k % 3 > 0, s, null) as title", "if(k % 5 > 0, concat('id/', k), null) as lid", "if(k % 2 = 0, 'Bach', '') as composer")
    return rows.select("k", keys.download_name(F.col("f"), F.col("title"), F.col("lid"), F.col("composer")).alias("name"))


@query(f"WITH {NAMED}, {LABEL}, g AS (SELECT rtrim(lower(strip_accents(s))) AS key, min(s) AS s, count(*) AS n FROM nm WHERE trim(s) <> '' GROUP BY 1) SELECT attribution, label, work_count FROM (SELECT g.s AS attribution, g.n AS work_count, (SELECT any_value(label) FROM la JOIN nm USING (k) WHERE nm.s = g.s) AS label FROM g) WHERE label IN ('real', 'review')")
def e4_candidates_of_parts(t):
    from . import identity

    return identity.clean_candidates(named(t).select(F.lit("unknown").alias("status"), F.col("s").alias("attribution"))).select("attribution", "label", "work_count")


@query(
    "WITH d AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[^\\p{L}-]', ' ', 'g'), '^[ -]+|[ -]+$', '', 'g'), ' +', ' ', 'g') AS clean, text FROM documents), r AS (SELECT *, rtrim(lower(strip_accents(clean))) AS key FROM d WHERE clean <> ''), h AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY (text <> clean)::INT, doc_id) AS turn, min(doc_id) OVER (PARTITION BY key) AS first_id FROM r) SELECT d.doc_id AS id, CASE WHEN h.turn > 1 THEN 'merged' ELSE 'active' END AS status, sha256(CASE WHEN h.turn = 1 THEN h.clean ELSE d.text END) AS name_hash FROM d LEFT JOIN h USING (doc_id)"
)
def e14_clean_and_merge(t):
    from . import identity

    composers = t("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("name"), F.lit("active").alias("status"), F.lit(True).alias("visible"), F.lit(None).cast("long").alias("merged_into"))
    aliases = t("labels").selectExpr("doc_id as composer_id", "cast(doc_id as string) as alias", "cast(doc_id as string) as normalized_alias")
    works = t("labels").selectExpr("doc_id as id", "doc_id as composer_id")
    done = identity.clean_names(composers, aliases, works)
    return done.composers.select("id", "status", F.sha2("name", 256).alias("name_hash"))
