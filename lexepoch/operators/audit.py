"""Corpus accounting, quality metrics, drift gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions import text as T


def distribution(docs: DataFrame, dims: list[str]) -> DataFrame:
    """(dimension, value, n) for every dimension in one pass over docs."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims])).alias("e")
    return docs.select(pairs).groupBy("e.dimension", "e.value").agg(F.count(F.lit(1)).alias("n"))


def by_year(docs: DataFrame) -> DataFrame:
    published = F.col("publication_date") if "publication_date" in docs.columns else F.lit(None).cast("date")
    return docs.groupBy(F.coalesce(F.substring(F.coalesce("issued_date", published).cast("string"), 1, 4), F.lit("UNKNOWN")).alias("year")).agg(F.count(F.lit(1)).alias("n"))


def blank(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")


def missing(docs: DataFrame, fields: list[str]) -> DataFrame:
    """Rows that lack any of the fields, with the list of those."""
    lacking = F.filter(F.array(*[F.when(blank(f), f) for f in fields]), lambda x: x.isNotNull())
    return docs.select("document_id", F.array_join(lacking, ",").alias("missing")).where("missing <> ''")


def missing_counts(docs: DataFrame, fields: list[str]) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(blank(f)).alias(f"missing_{f}") for f in fields])


def unknown_year(docs: DataFrame) -> DataFrame:
    return docs.where((F.length(F.coalesce(F.col("issued_date").cast("string"), F.lit(""))) < 4) & ~F.coalesce(F.col("document_number"), F.lit("")).rlike("(19|20)[0-9]{2}"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("n")) for n, df in tables.items()])


def run_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    b, a = before.withColumnRenamed("n", "n_before"), after.withColumnRenamed("n", "n_after")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return b.join(a, "table_name", "full").select("table_name", zero("n_before").alias("n_before"), zero("n_after").alias("n_after"),
                                                  (zero("n_after") - zero("n_before")).alias("delta"))


def provision_distribution(provs: DataFrame) -> DataFrame:
    """Provisions per document: documents, total, mean, median (of an even count the rounded mean of the middle two), p95, max."""
    per = provs.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("clause").isNull()).alias("plain"))
    return per.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("total"), F.round(F.avg("n"), 6).alias("mean"),
                   F.floor(F.percentile("n", F.lit(0.5)) + 0.5).alias("median"), F.round(F.percentile("n", F.lit(0.95)), 6).alias("p95"),
                   F.max("n").alias("max"), F.count_if(F.col("n") == F.col("plain")).alias("fallback_only"))


# -- cross-verification of a corpus -----------------------------------------------------------------------------------
def audit(docs: DataFrame, records: DataFrame) -> DataFrame:
    """(document_id, state): MATCHED, MISMATCH, NOT_YET_INDEXED, NO_MATCH or UNAVAILABLE against a second source's records."""
    r = records.select(T.normalize_number(F.col("document_number")).alias("n"), F.col("issued_date").alias("r_issued"), F.col("available"))
    r = r.groupBy("n").agg(F.min("r_issued").alias("r_issued"), F.bool_or("available").alias("available"))
    newest = records.agg(F.max("issued_date")).first()[0]
    j = docs.withColumn("n", T.normalize_number(F.col("document_number"))).join(r, "n", "left")
    state = (F.when(F.col("available").isNull(), F.when(F.col("issued_date") > F.lit(newest), "NOT_YET_INDEXED").otherwise("NO_MATCH"))
             .when(~F.col("available"), "UNAVAILABLE").when(F.col("r_issued") == F.col("issued_date"), "MATCHED").otherwise("MISMATCH"))
    return j.select("document_id", "document_type", "document_nature", "issuer_name", F.year("issued_date").cast("string").alias("year"), state.alias("state"))


STATES = ("MATCHED", "MISMATCH", "NOT_YET_INDEXED", "NO_MATCH", "UNAVAILABLE")


def accounting(audited: DataFrame) -> DataFrame:
    """One row: documents per state and silent drops (documents in no state)."""
    n = [F.count_if(F.col("state") == s).alias(s.lower()) for s in STATES]
    one = audited.agg(F.count(F.lit(1)).alias("total"), *n)
    return one.withColumn("silent_drops", F.col("total") - sum((F.col(s.lower()) for s in STATES), F.lit(0)))


def accounting_by(audited: DataFrame, dims: list[str]) -> DataFrame:
    """(dimension, value, total, matched, match_rate) of every dimension in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims])).alias("e")
    return audited.select("state", pairs).groupBy("e.dimension", "e.value").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("state") == "MATCHED").alias("matched")).withColumn(
        "match_rate", F.round(F.col("matched") * 100.0 / F.col("total"), 6))


def gates(summary: DataFrame, min_match: float = 98.0) -> DataFrame:
    """(gate, target, actual, passed) of a one-row summary."""
    rate = F.round(F.col("matched") * 100.0 / F.greatest(F.col("total") - F.col("not_yet_indexed") - F.col("unavailable"), F.lit(1)), 6)
    rows = [("match_rate", F.lit(min_match), rate, rate >= min_match), ("silent_drops", F.lit(0.0), F.col("silent_drops").cast("double"), F.col("silent_drops") == 0),
            ("mismatches", F.lit(0.0), F.col("mismatch").cast("double"), F.col("mismatch") == 0)]
    return summary.select(F.explode(F.array(*[F.struct(F.lit(g).alias("gate"), t.alias("target"), a.alias("actual"), p.alias("passed")) for g, t, a, p in rows])).alias("e")).select("e.*")


def backfill(docs: DataFrame, evidence: DataFrame, default_year: int) -> DataFrame:
    """(document_id, issued_date, imputed): issue dates by evidence, title or default; imputed ones are never verified."""
    said = evidence.where("field_name = 'issued_date'").groupBy("document_id").agg(F.min(F.try_to_date("asserted_value", "yyyy-MM-dd")).alias("said"))
    when, imputed = T.backfill_date(F.col("issued_date"), F.col("said"), F.col("title"), default_year)
    return docs.join(said, "document_id", "left").select("document_id", "verification_status", when.alias("issued_date"), imputed.alias("imputed"))


def review_queue(conflicts: DataFrame, verdicts: DataFrame, changed: DataFrame, errors: DataFrame) -> DataFrame:
    """(queue, item): conflicts, unverified documents, changed sources and rejected records in one table."""
    one = lambda df, q, c: df.select(F.lit(q).alias("queue"), F.col(c).cast("string").alias("item"))
    return one(conflicts.select("document_id").distinct(), "conflicts", "document_id").unionByName(
        one(verdicts.where("status = 'unverified'"), "unverified", "document_id")).unionByName(
        one(changed.where("change = 'CHANGED'"), "source_changes", "source_id")).unionByName(one(errors, "parser_errors", "item"))


def staleness(marks: DataFrame, now: str, hours: int = 24) -> DataFrame:
    """(source_name, last_success, stale): stale when the last success is older than some hours or there is none."""
    limit = F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL '{hours}' HOUR")
    return marks.select("source_name", "last_success", (F.col("last_success").isNull() | (F.col("last_success") < limit)).alias("stale"))


def diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one side has: (keys, side)."""
    return after.select(*keys).distinct().join(before, keys, "left_anti").withColumn("side", F.lit("added")).unionByName(
        before.select(*keys).distinct().join(after, keys, "left_anti").withColumn("side", F.lit("removed")))


# -- quality ----------------------------------------------------------------------------------------------------------
def retrieval(ranked: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """One row of means over queries: precision at 5 and k, recall at k, MRR, nDCG at k, duplicate rate.

    ranked (query_id, rank, item), judged (query_id, item, relevant). Repeated items count once, at their best rank.
    """
    first = ranked.groupBy("query_id", "item").agg(F.min("rank").alias("rank"), F.count(F.lit(1)).alias("times"))
    j = first.join(judged, ["query_id", "item"], "left").withColumn("rel", F.coalesce(F.col("relevant").cast("int"), F.lit(0)))
    top = F.col("rank") <= k
    gain = F.when(top & (F.col("rel") == 1), 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)
    per = j.groupBy("query_id").agg(
        F.sum(F.when(F.col("rank") <= 5, F.col("rel")).otherwise(0)).alias("h5"), F.sum(F.when(top, F.col("rel")).otherwise(0)).alias("hk"),
        F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("best"), F.sum(gain).alias("dcg"), F.sum(F.col("times") - 1).alias("dups"), F.sum("times").alias("shown"))
    total = judged.where("relevant").groupBy("query_id").agg(F.count(F.lit(1)).alias("n_rel"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_rel"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + F.lit(1.0)))
    m = total.join(per, "query_id", "left").withColumn("idcg", ideal)
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return m.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg(z("h5") / 5.0), 6).alias("p_at_5"), F.round(F.avg(z("hk") / float(k)), 6).alias("p_at_k"),
                 F.round(F.avg(z("hk") / F.col("n_rel")), 6).alias("recall_at_k"), F.round(F.avg(F.coalesce(1.0 / F.col("best"), F.lit(0.0))), 6).alias("mrr"),
                 F.round(F.avg(z("dcg") / F.col("idcg")), 6).alias("ndcg_at_k"), F.round(F.coalesce(F.sum("dups") / F.sum("shown"), F.lit(0.0)), 6).alias("duplicate_rate"))


def safety(results: DataFrame, docs: DataFrame, conflicts: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row of counts over answered results (document_id, as_of, is_effective, answerable) that must all be 0."""
    d = docs.select("document_id", "document_nature", "effective_from", "effective_to")
    c = conflicts.select("document_id").distinct().withColumn("in_conflict", F.lit(True))
    e = evidence.select("document_id").distinct().withColumn("has_evidence", F.lit(True))
    j = results.join(d, "document_id").join(c, "document_id", "left").join(e, "document_id", "left")
    live = F.col("is_effective")
    return j.agg(F.count(F.lit(1)).alias("results"), F.count_if(live & F.col("document_nature").isin("draft", "proposal", "consultation")).alias("draft_as_law"),
                 F.count_if(live & (F.col("as_of") < F.col("effective_from"))).alias("future_as_current"),
                 F.count_if(live & (F.col("as_of") > F.col("effective_to"))).alias("expired_as_current"),
                 F.count_if(F.col("answerable") & F.col("has_evidence").isNull()).alias("unsupported_answerable"),
                 F.count_if(F.col("answerable") & F.coalesce("in_conflict", F.lit(False))).alias("hidden_conflict"))


def temporal(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """(cases, found, accuracy) of predicted against expected states by document and date."""
    j = gold.join(pred.select("document_id", "as_of", F.col("status").alias("got")), ["document_id", "as_of"], "left")
    return j.agg(F.count(F.lit(1)).alias("cases"), F.count("got").alias("found"),
                 F.round(F.avg(F.when(F.col("got") == F.col("expected_status"), 1.0).otherwise(0.0)), 6).alias("accuracy"))


def coverage(docs: DataFrame, provs: DataFrame) -> DataFrame:
    """(class, n): structured (several provisions), fallback (one), metadata_only (none)."""
    n = provs.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("n").isNull(), "metadata_only").when(F.col("n") == 1, "fallback").otherwise("structured")
    return docs.select("document_id").join(n, "document_id", "left").groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("n"))


def domain_integrity(docs: DataFrame, srcs: DataFrame) -> DataFrame:
    """One row: documents without sources, canonical ids with several documents, sources without a document."""
    orphans = docs.select("document_id").join(srcs, "document_id", "left_anti").agg(F.count(F.lit(1)).alias("orphan_documents"))
    doubles = docs.groupBy("canonical_id").count().where("count > 1").agg(F.count(F.lit(1)).alias("duplicate_canonical_ids"))
    stray = srcs.select("document_id", "source_id").join(docs, "document_id", "left_anti").agg(F.count(F.lit(1)).alias("sources_without_document"))
    key = F.lit(1).alias("_k")
    return (orphans.select("*", key).join(doubles.select("*", key), "_k").join(stray.select("*", key), "_k").drop("_k"))


def ingestion(changes: DataFrame) -> DataFrame:
    """One row of rates over the snapshot log: created, mutated and duplicate snapshots."""
    n = F.count(F.lit(1))
    rate = lambda s: F.round(F.count_if(F.col("change") == s) / n, 6)
    return changes.agg(n.alias("snapshots"), rate("CREATED").alias("created_rate"), rate("CHANGED").alias("mutation_rate"), rate("UNCHANGED").alias("duplicate_rate"))


# -- drift ------------------------------------------------------------------------------------------------------------
def validate(records: DataFrame) -> DataFrame:
    """(item, reason): reason is null for records with a number, a title and a web address."""
    reason = (F.when(blank("document_number"), "FAIL_CLOSED: Missing required document_number").when(blank("title"), "FAIL_CLOSED: Missing required title")
              .when(F.col("url").isNull() | ~F.col("url").startswith("http"), "FAIL_CLOSED: Missing valid source locator URL"))
    return records.select("item", reason.alias("reason"))


def fingerprint(pages: DataFrame) -> DataFrame:
    """(page_id, fingerprint): hash of the first 100 tag names but script and style."""
    names = F.transform(F.regexp_extract_all("html", F.lit("<([a-zA-Z0-9]+)[^>]*>"), 1), lambda t: F.lower(t))
    first = F.slice(F.filter(names, lambda t: ~t.isin("script", "style")), 1, 100)
    return pages.select("page_id", F.substring(F.sha2(F.array_join(first, ">"), 256), 1, 16).alias("fingerprint"))


def fingerprint_shifts(marked: DataFrame, group: str, order: str) -> DataFrame:
    """Pages whose fingerprint differs from the one before in their group."""
    w = Window.partitionBy(group).orderBy(order)
    return marked.withColumn("previous", F.lag("fingerprint").over(w)).withColumn("shifted", F.coalesce(F.col("previous") != F.col("fingerprint"), F.lit(False)))


def drift(records: DataFrame, group: str | None, min_extraction: float = 98.0, min_effective: float = 95.0, max_failures: int = 1, expected: DataFrame | None = None) -> DataFrame:
    """Coverage, failures and circuit of each group of records (document_number, title, effective_date, issuer), or of all of them as one batch.

    A batch without records is degraded: NO_SAMPLES_EVALUATED. With groups, those of ``expected`` (the group's column)
    that have no records are such batches.
    """
    has = lambda c: ~blank(c)
    core = has("document_number") & has("title") & has("effective_date")
    n = F.count(F.lit(1))
    pct = lambda c: F.round(F.coalesce(F.try_divide(F.count_if(c) * 100.0, n), F.lit(0.0)), 6)
    per = records.groupBy(*([group] if group else [])).agg(
        n.alias("total"), pct(core).alias("extraction_rate"), pct(has("document_number")).alias("identity_rate"),
        pct(has("effective_date")).alias("effective_rate"), pct(has("issuer")).alias("issuer_rate"), F.count_if(~core).alias("failures"))
    if expected is not None:
        names = expected.select(F.col(group).alias("_g")).distinct()
        per = names.join(per, F.col("_g").eqNullSafe(F.col(group)), "full").withColumn(group, F.coalesce(group, "_g")).drop("_g").select(
            group, *[F.coalesce(c, F.lit(0).cast(per.schema[c].dataType)).alias(c) for c in per.columns if c != group])
    flags = F.when(F.col("total") == 0, F.array(F.lit("NO_SAMPLES_EVALUATED"))).otherwise(F.array_compact(F.array(
        F.when(F.col("extraction_rate") < min_extraction, "SCHEMA_CHANGED"), F.when(F.col("effective_rate") < min_effective, "EFFECTIVE_DATE_COVERAGE_LOW"),
        F.when((F.col("failures") > max_failures) & (F.col("total") > 10), "SELECTOR_FAILURES"))))
    return per.withColumn("flags", F.array_join(flags, ",")).withColumn("circuit", F.when(F.size(flags) > 0, "DEGRADED").otherwise("HEALTHY"))
