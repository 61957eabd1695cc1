"""Scored search, listings, availability, and complete nested records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import Links, basename, format_of, mime_of, number_rows, resource_url
from ..functions.names import fold_key, normalize_name, text
from .tables import first_per_key, page

# Points of a hit, by the column that holds it.
TITLE_POINTS = {"equal": 100, "prefix": 90, "inside": 70}
OTHER_POINTS = {"composer": 40, "attribution_type": 35, "attribution_note": 35, "catalogue": 30}


def _folded(q: str) -> Column:
    return fold_key(F.lit(q.strip()))


def search_works(works: DataFrame, q: str | None, *, limit: int = 50, offset: int = 0, title: str = "title", others: dict[str, int] | None = None, id: str = "id", score_col: str = "score") -> DataFrame:
    """Works with the text in title or another column, by points, then id. A blank text lists all by id.

    The text is literal: `%` and `_` are ordinary characters.
    """
    if not (q or "").strip():
        return page(works.withColumn(score_col, F.lit(0)), [id], limit, offset)
    others = OTHER_POINTS if others is None else others
    key, t = _folded(q), fold_key(text(F.col(title)))
    score = F.when(t == key, TITLE_POINTS["equal"]).when(F.startswith(t, key), TITLE_POINTS["prefix"]).when(F.contains(t, key), TITLE_POINTS["inside"])
    for column, points in others.items():
        score = score.when(F.contains(fold_key(text(F.col(column))), key), points)
    return page(works.withColumn(score_col, score).where(F.col(score_col).isNotNull()), [F.desc(score_col), id], limit, offset)


def search_entries(entries: DataFrame, archives: DataFrame, q: str | None, *, limit: int = 50, offset: int = 0) -> DataFrame:
    """Entries with the text in path, logical id, composer or title, with archive name and availability."""
    if not (q or "").strip():
        hits = entries.where(F.lit(False))
    else:
        hit = F.lit(False)
        for column in ("relative_path", "logical_id", "composer", "title"):
            hit = hit | F.contains(fold_key(text(F.col(column))), _folded(q))
        hits = entries.where(hit)
    hits = page(hits, ["id"], limit, offset)
    names = archives.select(F.col("id").alias("archive_id"), F.col("name").alias("archive_name"))
    return hits.join(names, "archive_id", "left").withColumn("available", entry_available()).orderBy("id")


def entry_available() -> Column:
    """Ready and with a file."""
    return F.coalesce((F.col("status") == "ready") & F.col("file_id").isNotNull(), F.lit(False))


def _listed(composers: DataFrame, aliases: DataFrame, q: str | None, review: str | None, visible: str) -> DataFrame:
    rows = composers.where("status = 'active'")
    if visible != "all":
        rows = rows.where(F.coalesce(F.col("visible"), F.lit(True)) == (visible == "visible"))
    if review == "reviewed":
        rows = rows.where(F.col("review_status").isin("correct", "incorrect"))
    elif review:
        rows = rows.where(F.coalesce(F.col("review_status"), F.lit("not_reviewed")) == review)
    if (q or "").strip():
        owners = aliases.where(F.contains(F.col("normalized_alias"), normalize_name(F.lit(q)))).select(F.col("composer_id").alias("id"), F.lit(True).alias("_hit")).distinct()
        rows = rows.join(owners, "id", "left").where(F.contains(fold_key(text(F.col("name"))), _folded(q)) | F.coalesce("_hit", F.lit(False))).drop("_hit")
    return rows


def list_composers(composers: DataFrame, aliases: DataFrame, works: DataFrame, *, q: str | None = None, review: str | None = None, visible: str = "visible", limit: int = 50, offset: int = 0) -> DataFrame:
    """Entities by name and id, filtered, with counts of aliases and works."""
    rows = page(_listed(composers, aliases, q, review, visible), ["name", "id"], limit, offset)
    for table, name in ((aliases, "alias_count"), (works, "work_count")):
        counts = table.join(F.broadcast(rows.select(F.col("id").alias("composer_id"))), "composer_id", "left_semi").groupBy(F.col("composer_id").alias("id")).agg(F.count("*").alias(name))
        rows = rows.join(counts, "id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return rows.orderBy("name", "id")


def count_composers(composers: DataFrame, aliases: DataFrame, *, q: str | None = None, review: str | None = None, visible: str = "visible") -> DataFrame:
    """How many rows P3 has without paging."""
    return _listed(composers, aliases, q, review, visible).agg(F.count("*").alias("total"))


def pending_review(composers: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """P5: active and not reviewed, by id."""
    rows = composers.where((F.col("status") == "active") & (F.coalesce(F.col("review_status"), F.lit("not_reviewed")) == "not_reviewed"))
    return page(rows, ["id"], limit, offset)


def suspicious(composers: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """P5: active and with a reason for review, by id."""
    return page(composers.where((F.col("status") == "active") & F.col("review_reason").isNotNull()), ["id"], limit, offset)


def works_of(works: DataFrame, ids: DataFrame, *, owner: str = "composer_id", id: str = "id", per_key_limit: int | None = None, per_key_offset: int = 0) -> DataFrame:
    """Works of a set of owners, by id, a page for each owner."""
    rows = works.join(ids.select(owner).distinct(), owner, "left_semi")
    if per_key_limit is None and not per_key_offset:
        return rows
    turn = F.row_number().over(Window.partitionBy(owner).orderBy(id))
    last = per_key_offset + (per_key_limit if per_key_limit is not None else 2**31)
    return rows.withColumn("_turn", turn).where((F.col("_turn") > per_key_offset) & (F.col("_turn") <= last)).drop("_turn")


def catalogues_by(catalogues: DataFrame, *, prefix: str | None = None, composer: str | None = None) -> DataFrame:
    """Catalogues of a prefix, or of a composer whose normal name holds the normal text."""
    rows = catalogues
    if prefix is not None:
        rows = rows.where(fold_key(F.col("prefix")) == _folded(prefix))
    if composer is not None:
        rows = rows.where(F.contains(normalize_name(F.col("composer")), normalize_name(F.lit(composer))))
    return rows


def resolve_entries(requests: DataFrame, entries: DataFrame, archives: DataFrame, *, by: str = "relative_path") -> DataFrame:
    """P10: per asked path or logical id the first entry by id: found, available, archive name."""
    asked = requests.select(by).distinct()
    first = first_per_key(entries.join(asked, by, "left_semi"), [by], ["id"])
    names = archives.select(F.col("id").alias("archive_id"), F.col("name").alias("archive_name"))
    out = asked.join(first, by, "left").join(names, "archive_id", "left")
    return out.select(by, F.col("id").alias("entry_id"), F.col("id").isNotNull().alias("found"), entry_available().alias("available"), "file_id", "archive_name")


def _list(rows: DataFrame, key: str, value: str, into: str) -> DataFrame:
    """Values per key in the order of their row ids."""
    pairs = F.array_sort(F.collect_list(F.struct("id", value)))
    return rows.groupBy(key).agg(F.transform(pairs, lambda p: p[value]).alias(into))


def assemble_works(works: DataFrame, entries: DataFrame, genres: DataFrame, instruments: DataFrame, parts: DataFrame, links: Links = Links()) -> DataFrame:
    """Works with arrays of genres, instruments, parts and resources; no list is null. Apply limits before."""
    ids = works.select(F.col("id").alias("work_id"))
    url = resource_url(F.col("relative_path"), F.col("file_id"), links)
    resource = F.struct("id", "relative_path", format_of(F.col("relative_path")).alias("format"), "file_id", url.alias("url"), url.isNotNull().alias("available"))
    own = entries.join(ids, "work_id", "left_semi")
    out = works
    lists = [own.groupBy("work_id").agg(F.array_sort(F.collect_list(resource)).alias("resources"))]
    for rows, value, into in ((genres, "genre", "genres"), (instruments, "instrument", "instruments"), (parts, "part_name", "parts_names")):
        lists.append(_list(rows.join(ids, "work_id", "left_semi"), "work_id", value, into))
    for rows in lists:
        into = rows.columns[1]
        out = out.join(rows.withColumnRenamed("work_id", "id"), "id", "left").withColumn(into, F.coalesce(into, F.array().cast(rows.schema[into].dataType)))
    return out


def _paged(rows: DataFrame, key: str, order: list[str], value: Column, into: str, per_page: int, parts: int = 64) -> DataFrame:
    """(id, page, array): the values of each key in order, at most `per_page` to an array. Rows are numbered
    through range partitions, so the children of one key are never one task's."""
    numbered = number_rows(rows.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), *order, value.alias(into)), ["id", *order], 0, into="_n", parts=parts)
    first = numbered.groupBy("id").agg(F.min("_n").alias("_first"))
    page = F.floor((F.col("_n") - F.col("_first")) / per_page).cast("int")
    placed = numbered.join(first, "id").withColumn("page", page)
    lists = placed.groupBy("id", "page").agg(F.array_sort(F.collect_list(F.struct("_n", into))).alias("_list"))
    return lists.select("id", "page", F.transform("_list", lambda p: p[into]).alias(into))


def _pages(owners: DataFrame, lists: list[DataFrame]) -> DataFrame:
    """Owners with page 0, and the further pages that a list of theirs has."""
    every = owners.select("id", F.lit(0).alias("page"))
    for rows in lists:
        every = every.unionByName(rows.select("id", "page"))
    out = every.distinct().join(owners, "id")
    for rows in lists:
        into = rows.columns[2]
        out = out.join(rows, ["id", "page"], "left").withColumn(into, F.coalesce(into, F.array().cast(rows.schema[into].dataType)))
    return out


def work_pages(works: DataFrame, entries: DataFrame, genres: DataFrame, instruments: DataFrame, parts: DataFrame, links: Links = Links(), *, per_page: int = 1_000) -> DataFrame:
    """J13 for works with any number of children: a row per work and page, from 0, with at most `per_page`
    of each kind of child, in the order of their ids. All children are on some page; a work's first page
    is what `assemble_works` gives if no list is longer."""
    url = resource_url(F.col("relative_path"), F.col("file_id"), links)
    resource = F.struct("id", "relative_path", format_of(F.col("relative_path")).alias("format"), "file_id", url.alias("url"), url.isNotNull().alias("available"))
    kinds = [(entries, resource, "resources"), (genres, F.col("genre"), "genres"), (instruments, F.col("instrument"), "instruments"), (parts, F.col("part_name"), "parts_names")]
    ids = works.select(F.col("id").alias("work_id"))
    return _pages(works, [_paged(rows.join(ids, "work_id", "left_semi").select(F.col("work_id"), F.col("id").alias("child"), value.alias(into)), "work_id", ["child"], F.col(into), into, per_page) for rows, value, into in kinds])


def composer_pages(composers: DataFrame, aliases: DataFrame, works: DataFrame, identifiers: DataFrame, evidence: DataFrame, *, per_page: int = 1_000) -> DataFrame:
    """J15 likewise: aliases, identifiers and evidence in pages, with the number of works on each page."""
    lists = [
        _paged(aliases.select(F.col("composer_id").alias("owner"), "alias"), "owner", ["alias"], F.col("alias"), "aliases", per_page),
        _paged(identifiers.select(F.col("composer_id").alias("owner"), "id_type", "id_value"), "owner", ["id_type", "id_value"], F.struct("id_type", "id_value"), "identifiers", per_page),
        _paged(evidence.select(F.col("composer_id").alias("owner"), "rule", "decision"), "owner", ["rule", "decision"], F.struct("rule", "decision"), "evidence", per_page),
    ]
    counts = works.groupBy(F.col("composer_id").alias("id")).agg(F.count("*").alias("work_count"))
    return _pages(composers, lists).join(counts, "id", "left").withColumn("work_count", F.coalesce("work_count", F.lit(0).cast("long")))


def work_record(detail: DataFrame, unknown: str = "Unknown composer") -> DataFrame:
    """Id, title, composer label, metadata, and available resources with type and link."""
    tags = F.filter(F.transform(F.split(text(F.col("tags")), ","), lambda t: F.trim(t)), lambda t: t != "")
    name = lambda r: F.coalesce(r["file_id"].cast("string"), F.concat(F.lit("res-"), basename(r["relative_path"])))
    resources = F.transform(
        F.filter("resources", lambda r: r["available"]),
        lambda r: F.struct(name(r).alias("id"), r["format"].alias("format"), mime_of(r["format"]).alias("mime_type"), F.concat(F.lit("/api/download/"), name(r)).alias("download")),
    )
    composer = F.coalesce(F.nullif(F.trim("composer"), F.lit("")), F.lit(unknown))
    meta = F.struct(tags.alias("tags"), "genres", "instruments", "parts_names", *(c for c in ("license", "subtitle", "opus", "musical_key") if c in detail.columns))
    return detail.select("id", "title", composer.alias("composer"), "composer_id", "catalogue", meta.alias("metadata"), resources.alias("resources"))


def file_details(files: DataFrame, locations: DataFrame, providers: DataFrame) -> DataFrame:
    """Files with their stored places; available if not failed and stored somewhere."""
    stored = locations.where("status = 'stored'").select("file_id", "provider_id", "object_key")
    named = stored.join(providers.select(F.col("id").alias("provider_id"), F.col("name").alias("provider")), "provider_id", "left")
    places = named.groupBy(F.col("file_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("provider_id", "provider", "object_key"))).alias("places"))
    out = files.join(places, "id", "left").withColumn("places", F.coalesce("places", F.array().cast(places.schema["places"].dataType)))
    return out.withColumn("available", (F.coalesce(F.col("status"), F.lit("")) != "failed") & (F.size("places") > 0))


def composer_details(composers: DataFrame, aliases: DataFrame, works: DataFrame, identifiers: DataFrame, evidence: DataFrame) -> DataFrame:
    """All entities with alias, identifier and evidence lists and the number of works."""
    out = composers
    own = F.col("composer_id").alias("id")
    lists = [
        aliases.groupBy(own).agg(F.array_sort(F.collect_list("alias")).alias("aliases")),
        identifiers.groupBy(own).agg(F.array_sort(F.collect_list(F.struct("id_type", "id_value"))).alias("identifiers")),
        evidence.groupBy(own).agg(F.array_sort(F.collect_list(F.struct("rule", "decision"))).alias("evidence")),
        works.groupBy(own).agg(F.count("*").alias("work_count")),
    ]
    for rows in lists:
        into = rows.columns[1]
        empty = F.lit(0).cast("long") if into == "work_count" else F.array().cast(rows.schema[into].dataType)
        out = out.join(rows, "id", "left").withColumn(into, F.coalesce(into, empty))
    return out
