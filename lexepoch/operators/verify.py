"""What sources assert against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..sources.ledger import Ledger
from ..sources.scratch import kept
from ..sources.sinks import new_rows
from . import snapshots

OFFICIAL = ("tier_a", "tier_b")
ORIGINS = ("live_official", "imported_official")
#: Flags of an evidence locator, any of which silences it.
LOCATOR_FLAGS = ("is_fixture", "quarantined", "is_test_fixture", "is_quarantined")
#: Fields compared between sources: (field, severity, only between official sources).
RULES = (("document_number", "high", False), ("issued_date", "medium", False), ("effective_from", "high", True), ("effective_to", "high", False))


def admissible(evidence: DataFrame) -> DataFrame:
    """Evidence that may speak: not quarantined, from production, of official origin, not typed as a fixture."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    ok = no(F.col("is_quarantined")) & (F.col("environment") == "production") & F.col("evidence_origin").isin(*ORIGINS)
    if "evidence_type" in evidence.columns:
        kind = F.coalesce(F.col("evidence_type"), F.lit(""))
        ok = ok & ~kind.startswith("synthetic") & (kind != "test_fixture")
    if "evidence_locator" in evidence.columns:
        said = lambda flag, kind: F.try_variant_get(F.try_parse_json("evidence_locator"), f"$.{flag}", kind)
        for flag in LOCATOR_FLAGS:
            ok = ok & no(said(flag, "boolean"))
        ok = ok & no(said("evidence_origin", "string") == "test_fixture")
    return evidence.where(ok)


def first_values(evidence: DataFrame, fields: list[str]) -> DataFrame:
    """One column per field: the first value (by created_at if there is one, then value) of each document and snapshot."""
    order = F.struct(*[c for c in ("created_at", "evidence_id", "asserted_value") if c in evidence.columns])
    return evidence.groupBy("document_id", "snapshot_id").agg(
        *[F.min_by(F.when(F.col("field_name") == f, F.col("asserted_value")), F.when((F.col("field_name") == f) & F.col("asserted_value").isNotNull(), order)).alias(f) for f in fields])


def pairs(asserts: DataFrame) -> DataFrame:
    """Pairs of different sources of one document, each once; the join is on the document, never across documents."""
    fields = [f for f, _, _ in RULES]
    side = lambda p: asserts.select("document_id", F.col("source_id").alias(f"{p}_source"), F.col("source_authority").alias(f"{p}_authority"),
                                    *[F.col(f).cast("string").alias(f"{p}_{f}") for f in fields])
    return side("a").join(side("b"), "document_id").where("a_source < b_source")


def conflicts(asserts: DataFrame) -> DataFrame:
    """(document_id, field_name, source_a, value_a, source_b, value_b, severity): one row per pair and field that differ."""
    official = F.col("a_authority").isin(*OFFICIAL) & F.col("b_authority").isin(*OFFICIAL)
    found = []
    for field, severity, only_official in RULES:
        a, b = F.col(f"a_{field}"), F.col(f"b_{field}")
        differ = a.isNotNull() & b.isNotNull() & (a != b) & (official if only_official else F.lit(True))
        found.append(F.when(differ, F.struct(F.lit(field).alias("field_name"), a.alias("value_a"), b.alias("value_b"), F.lit(severity).alias("severity"))))
    return (pairs(asserts).select("document_id", "a_source", "b_source", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("c"))
            .select("document_id", "c.field_name", F.col("a_source").alias("source_a"), "c.value_a", F.col("b_source").alias("source_b"), "c.value_b", "c.severity"))


def verdicts(asserts: DataFrame) -> DataFrame:
    """(document_id, n_sources, n_official, n_conflicts, identity_passed, date_passed, validity_passed, date_status, status, answerable)."""
    dated = F.col("effective_from").isNotNull()
    per = asserts.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("n_sources"), F.count_if(F.col("source_authority").isin(*OFFICIAL)).alias("n_official"),
        F.count_if(dated).alias("n_dated"), F.count_if(dated & F.col("source_authority").isin(*OFFICIAL)).alias("n_official_dated"))
    field = F.col("field_name")
    against = conflicts(asserts).groupBy("document_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "high").alias("high"),
        F.count_if((field == "document_number")).alias("identity_high"), F.count_if(field == "effective_from").alias("date"),
        F.count_if(field == "effective_to").alias("validity"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    j = per.join(against, "document_id", "left")
    identity, date, validity = n("identity_high") == 0, (F.col("n_dated") > 0) & (n("date") == 0), n("validity") == 0
    date_status = (F.when(F.col("n_dated") == 0, "unverified").when(n("date") > 0, "conflicting")
                   .when(F.col("n_official_dated") >= 2, "cross_verified").otherwise("single_source_verified"))
    status = (F.when(n("n") > 0, "conflicting")
              .when(identity & date & validity, F.when(F.col("n_sources") >= 2, "cross_verified").otherwise("single_source_verified"))
              .when(identity, "single_source_verified").otherwise("unverified"))
    return j.select("document_id", "n_sources", "n_official", n("n").cast("long").alias("n_conflicts"), identity.alias("identity_passed"),
                    date.alias("date_passed"), validity.alias("validity_passed"), date_status.alias("date_status"), status.alias("status"),
                    ((n("high") == 0) & status.isin("cross_verified", "single_source_verified")).alias("answerable"))


def on_current(srcs: DataFrame, snaps: DataFrame) -> DataFrame:
    """srcs (source_id, current_snapshot_id) with snapshot_id, the snapshot that speaks for each; sources without one stay silent."""
    return srcs.drop("snapshot_id").join(snapshots.current(srcs, snaps).select("source_id", "snapshot_id"), "source_id")


def assertions(docs: DataFrame, srcs: DataFrame, evidence: DataFrame, fallback: bool = True, snaps: DataFrame | None = None) -> DataFrame:
    """One assertion per (document, source): admissible evidence, else with fallback the document's own value.

    With ``snaps`` only evidence of a source's current snapshot speaks, and srcs has source_id (one document each) and
    current_snapshot_id; without, evidence names its source as snapshot_id. asserted_fields counts what the source
    itself says, so agreement by fallback stays visible.
    """
    fields = [f for f, _, _ in RULES]
    said = first_values(admissible(evidence), fields)
    srcs = on_current(srcs, snaps) if snaps is not None else srcs.withColumn("snapshot_id", F.col("source_id"))
    j = srcs.join(docs.select("document_id", *[F.col(f).cast("string").alias(f"d_{f}") for f in fields]), "document_id").join(
        said, ["document_id", "snapshot_id"], "left")
    value = lambda f: F.coalesce(F.col(f), F.col(f"d_{f}")) if fallback else F.col(f)
    snap = ["snapshot_id"] if snaps is not None else []
    return j.select("document_id", "source_id", "source_authority", *[value(f).alias(f) for f in fields],
                    sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0)).alias("asserted_fields"), *snap)


def corpus(docs: DataFrame, srcs: DataFrame, evidence: DataFrame, snaps: DataFrame | None = None) -> DataFrame:
    """Verdict of every document of the corpus; documents without a source are unverified and not answerable."""
    # Written once: sources are counted, and compared with each other on both sides.
    return _of_all(docs, verdicts(kept(assertions(docs, srcs, evidence, snaps=snaps), "assertions")))


def _of_all(docs: DataFrame, found: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return docs.select("document_id").join(found, "document_id", "left").select(
        "document_id", F.coalesce("n_sources", zero).alias("n_sources"), F.coalesce("n_conflicts", zero).alias("n_conflicts"),
        F.coalesce("status", F.lit("unverified")).alias("status"), F.coalesce("answerable", F.lit(False)).alias("answerable"))


# -- the corpus again after some snapshots have changed ---------------------------------------------------------------
#: Tables of a ledger that keeps verdicts, and the conflicts recorded so far, each under its key once.
LEDGER = {"verdicts": "document_id long, n_sources long, n_conflicts long, status string, answerable boolean",
          "conflicts": "document_id long, field_name string, snapshot_a long, value_a string, snapshot_b long, value_b string, severity string"}
CONFLICT_KEY = ["document_id", "field_name", "snapshot_a", "value_a", "snapshot_b", "value_b"]


def touched(srcs: DataFrame, changed: DataFrame) -> DataFrame:
    """(document_id) of the documents that the changed sources (source_id) speak about."""
    return srcs.join(changed.select("source_id").distinct(), "source_id", "left_semi").select("document_id").distinct()


def reverify(ledger: Ledger, batch_id: int, docs: DataFrame, srcs: DataFrame, snaps: DataFrame, evidence: DataFrame, changed: DataFrame | None = None) -> bool:
    """Verify what the changed sources (all without ``changed``) touch, as one batch: new verdicts of those documents, and
    those of their conflicts that are not recorded yet.

    Every table is first cut down to the touched documents, so the joins, pairs and shuffles grow with them. Documents
    whose last source went away are touched too if ``changed`` names it.
    """
    def build() -> dict[str, DataFrame]:
        d, s, p, e, known = docs, srcs, snaps, evidence, ledger.table("conflicts")
        if changed is not None:
            ids = ledger.staged("touched", touched(srcs, changed))
            d, s, e, known = (t.join(ids, "document_id", "left_semi") for t in (docs, srcs, evidence, known))
            p = snaps.join(s.select("source_id"), "source_id", "left_semi")
        said = ledger.staged("assertions", assertions(d, s, e, snaps=p))
        ends = lambda x: said.select("document_id", F.col("source_id").alias(f"source_{x}"), F.col("snapshot_id").alias(f"snapshot_{x}"))
        found = conflicts(said).join(ends("a"), ["document_id", "source_a"]).join(ends("b"), ["document_id", "source_b"])
        return {"verdicts": _of_all(d, verdicts(said)), "conflicts": new_rows(found, known.select(*CONFLICT_KEY), CONFLICT_KEY)}

    return ledger.run(batch_id, build)


def verdicts_now(ledger: Ledger) -> DataFrame:
    return ledger.latest("verdicts", ["document_id"])


def active_conflicts(found: DataFrame) -> DataFrame:
    return found.where((F.coalesce(F.col("conflict_type"), F.lit("")) != "SYNTHETIC_TEST_CONFLICT") & ~F.coalesce(F.col("resolved"), F.lit(False)))


def unique_conflicts(found: DataFrame) -> DataFrame:
    """The first conflict of each (document, field), by source_a, source_b."""
    w = Window.partitionBy("document_id", "field_name").orderBy("source_a", "source_b")
    return found.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def candidates(docs: DataFrame, n: int) -> DataFrame:
    """Documents to verify next: normative ones with a single source, newest first."""
    return (docs.where("verification_status = 'single_source_verified' AND document_nature = 'normative_legal_document'")
            .orderBy(F.col("issued_date").desc(), "document_id").limit(n))


def dossiers(found: DataFrame, srcs: DataFrame) -> DataFrame:
    """One dossier per conflicting (document, field): both sides with authority, sorted dates, claim-level answers."""
    u = unique_conflicts(found)
    side = lambda p: srcs.select(F.col("document_id"), F.col("source_id").alias(f"source_{p}"), F.col("source_authority").alias(f"authority_{p}"))
    j = u.join(side("a"), ["document_id", "source_a"], "left").join(side("b"), ["document_id", "source_b"], "left")
    is_date = F.col("field_name").isin("issued_date", "effective_from", "effective_to")
    return j.select(
        F.concat_ws("-", F.lit("DOSSIER"), F.col("document_id").cast("string"), F.upper(F.regexp_replace("field_name", "_", "-"))).alias("dossier_id"),
        "document_id", "field_name", "severity", "source_a", "authority_a", "value_a", "source_b", "authority_b", "value_b",
        F.when(is_date, F.least("value_a", "value_b")).alias("uncertain_from"), F.when(is_date, F.greatest("value_a", "value_b")).alias("uncertain_to"),
        F.lit(False).alias("field_answerable"))


def claims(docs: DataFrame, found: DataFrame, fields: list[str]) -> DataFrame:
    """(document_id, field_name, value, answerable): a field answers if it has a value and no open conflict."""
    pairs_ = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("value")) for f in fields])).alias("e")
    base = docs.select("document_id", pairs_).select("document_id", "e.*")
    open_ = found.select("document_id", "field_name").distinct().withColumn("open", F.lit(True))
    return base.join(open_, ["document_id", "field_name"], "left").select(
        "document_id", "field_name", "value", (F.col("value").isNotNull() & F.col("open").isNull()).alias("answerable"))


def verify_claims(asked: DataFrame, evidence: DataFrame) -> DataFrame:
    """Structured claims (claim_id, document_id, field_name, value) -> supported, contradicted or insufficient_evidence."""
    said = admissible(evidence).groupBy("document_id", "field_name").agg(F.collect_set("asserted_value").alias("said"))
    j = asked.join(said, ["document_id", "field_name"], "left")
    supports = F.array_contains("said", F.col("value"))
    verdict = (F.when(F.col("said").isNull() | F.col("value").isNull(), "insufficient_evidence").when(supports & (F.size("said") == 1), "supported")
               .when(~supports, "contradicted").otherwise("insufficient_evidence"))
    return j.select("claim_id", "document_id", "field_name", "value", verdict.alias("verdict"))


def official(column: str = "source_authority") -> Column:
    return F.col(column).isin(*OFFICIAL)
