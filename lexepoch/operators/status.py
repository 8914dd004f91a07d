"""Legal status of documents and provisions at a date.

Intervals are closed at both ends and a null end is open. Each (document, date) is evaluated once: edges active at a
date are folded to four flags per target before they meet the documents, so no document is read per provision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Natures that are never law, and document states that all provisions inherit.
NOT_LAW = ("draft", "proposal", "consultation")
INHERITED = ("repealed", "replaced", "not_yet_effective", "expired", "suspended")
#: States that edges decide.
REACHED = ("repealed", "replaced", "suspended", "partially_effective", "effective")
AFFECTING = ("repeals", "replaces", "suspends", "partially_repeals")


def at_dates(df: DataFrame, dates: list[str], name: str = "as_of") -> DataFrame:
    """df once for each of a short list of dates."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(d).cast("date") for d in dates])))


def within(day: Column, start: Column, end: Column) -> Column:
    return (start.isNull() | (start <= day)) & (end.isNull() | (day <= end))


def digits(locator: Column) -> Column:
    """'Khoản 2' and '2' are the same clause; empty is null (a wildcard)."""
    return F.nullif(F.regexp_extract(locator, r"([0-9]+[a-zA-Z]?)", 1), F.lit(""))


def active_edges(rels: DataFrame, dates: list[str]) -> DataFrame:
    """Edges in force at each date."""
    return at_dates(rels, dates).where(within(F.col("as_of"), F.col("effective_from"), F.col("effective_to")))


def documents_at(docs: DataFrame, rels: DataFrame, dates: list[str], with_edges: bool = False) -> DataFrame:
    """(document_id, as_of, status, is_effective, warning, n_affecting): how many active edges bear on the document.

    With ``with_edges`` a last column, affecting, lists them with their source documents; it grows with the edges of
    one document, so it is made on request only.
    """
    edges = [F.sort_array(F.collect_list(F.struct("relationship_type", "source_document_id", "effective_from"))).alias("edges")] if with_edges else []
    flags = active_edges(rels.where(F.col("relationship_type").isin(*AFFECTING)), dates).groupBy(
        F.col("target_document_id").alias("document_id"), "as_of").agg(
        *[F.bool_or(F.col("relationship_type") == t).alias(t) for t in AFFECTING], F.count(F.lit(1)).alias("n"), *edges)
    base = at_dates(docs.select("document_id", "document_nature", "effective_from", "effective_to"), dates)
    joined = base.join(flags, ["document_id", "as_of"], "left")
    listed = [F.when(F.col("status").isin(*REACHED), F.col("edges")).alias("affecting")] if with_edges else []
    return joined.select("*", *judged(F.col("as_of"), {t: F.col(t) for t in AFFECTING})).select(
        "document_id", "as_of", "status", "is_effective", "warning", "n_affecting", *listed)


def judged(day: Column, active: dict[str, Column]) -> list[Column]:
    """status, is_effective, warning and n_affecting of a document (document_nature, effective_from, effective_to) on a day,
    by which kinds of edges are active and their number n."""
    nature, start = F.col("document_nature"), F.col("effective_from")
    status = (F.when(nature.isin(*NOT_LAW), "not_yet_effective").when(start.isNull(), "unknown").when(day < start, "not_yet_effective")
              .when(day > F.col("effective_to"), "expired").when(active["repeals"], "repealed").when(active["replaces"], "replaced")
              .when(active["suspends"], "suspended").when(active["partially_repeals"], "partially_effective").otherwise("effective"))
    warning = (F.when(nature.isin(*NOT_LAW), "NOT_LAW").when(start.isNull(), "MISSING_EFFECTIVE_DATE")
               .when(status == "not_yet_effective", "FUTURE").when(status != "effective", F.upper(status)))
    none = F.lit(0).cast("long")
    return [status.alias("status"), status.isin("effective", "partially_effective").alias("is_effective"), warning.alias("warning"),
            F.when(status.isin(*REACHED), F.coalesce(F.col("n").cast("long"), none)).otherwise(none).alias("n_affecting")]


def partial_repeals(provs: DataFrame, rels: DataFrame, dates: list[str]) -> DataFrame:
    """(provision_id, as_of) hit by an active partial repeal; a locator without article or clause matches any."""
    edges = active_edges(rels.where("relationship_type = 'partially_repeals'"), dates).select(
        F.col("target_document_id").alias("document_id"), "as_of", digits(F.col("target_article")).alias("t_article"),
        digits(F.col("target_clause")).alias("t_clause")).distinct()
    own = provs.select("provision_id", "document_id", digits(F.col("article")).alias("p_article"), digits(F.col("clause")).alias("p_clause"))
    hit = own.join(edges, "document_id").where(
        (F.col("t_article").isNull() | (F.col("t_article") == F.col("p_article")))
        & (F.col("t_clause").isNull() | (F.col("t_clause") == F.col("p_clause"))))
    return hit.select("provision_id", "as_of").distinct()


def provisions_at(provs: DataFrame, doc_status: DataFrame, rels: DataFrame, dates: list[str], respect_repeal_date: bool = False) -> DataFrame:
    """(provision_id, document_id, article, clause, as_of, status, is_effective, inherited).

    With respect_repeal_date an override of repealed counts only after the provision's own valid_to.
    """
    day = F.col("as_of")
    # The dates of a provision's repeals are folded and meet it before it is repeated for each date: what is shuffled is one row a provision.
    struck = partial_repeals(provs, rels, dates).groupBy("provision_id").agg(F.collect_set("as_of").alias("_struck"))
    joined = (provs.select("provision_id", "document_id", "article", "clause", "valid_from", "valid_to", "status_override")
              .join(struck, "provision_id", "left")
              .join(doc_status.select("document_id", "as_of", F.col("status").alias("doc_status")), "document_id")
              .withColumn("hit", F.array_contains("_struck", day)))
    override = F.col("status_override") == "repealed"
    if respect_repeal_date:
        override = override & (F.col("valid_to").isNull() | (day > F.col("valid_to")))
    status = (F.when(F.col("doc_status").isin(*INHERITED), F.col("doc_status")).when(override, "repealed")
              .when(day < F.col("valid_from"), "not_yet_effective").when(day > F.col("valid_to"), "expired")
              .when(F.col("hit"), "repealed").otherwise("effective"))
    return joined.withColumn("status", status).select(
        "provision_id", "document_id", "article", "clause", "as_of", "status", (F.col("status") == "effective").alias("is_effective"),
        F.col("doc_status").isin(*INHERITED).alias("inherited"))


def as_known(rows: DataFrame, knowledge_at: str, created: str = "created_at") -> DataFrame:
    """Rows that had been recorded by a moment: applied before status or verification for a bitemporal answer."""
    return rows.where(F.col(created) <= F.lit(knowledge_at).cast("timestamp_ntz"))
