"""Retrieval: filters, scores, ranked search, detail, recent updates, rules in force."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..sources.scratch import kept
from . import status

DRAFTS = ("draft", "proposal", "consultation")


def bound(n: int, low: int, high: int, name: str) -> int:
    if not low <= n <= high:
        raise ValueError(f"{name} must be from {low} to {high}, not {n}")
    return n


def filters(docs: DataFrame, natures: list[str] | None = None, types: list[str] | None = None, issued_from: str | None = None,
            issued_to: str | None = None, issuer: str | None = None, effective_only: bool = False, topics: list[str] | None = None) -> DataFrame:
    """Only the filters that are given apply; effective_only drops drafts unless natures are asked for."""
    if natures:
        docs = docs.where(F.col("document_nature").isin(*natures))
    elif effective_only:
        docs = docs.where(~F.col("document_nature").isin(*DRAFTS))
    if types:
        docs = docs.where(F.col("document_type").isin(*types))
    if issued_from:
        docs = docs.where(F.col("issued_date") >= F.lit(issued_from).cast("date"))
    if issued_to:
        docs = docs.where(F.col("issued_date") <= F.lit(issued_to).cast("date"))
    if issuer:
        docs = docs.where(F.lower("issuer_name").contains(issuer.lower()))
    if topics:
        docs = docs.where(F.arrays_overlap(T.topics(F.col("title")), F.array(*[F.lit(t) for t in topics])))
    return docs


def window(events: DataFrame, today: str, days: int = 30, kinds: list[str] | None = None) -> DataFrame:
    """Events of the last days up to a given date."""
    bound(days, 1, 365, "days")
    out = events.where(F.col("event_date") >= F.date_sub(F.lit(today).cast("date"), days))
    return out.where(F.col("event_type").isin(*kinds)) if kinds else out


def by_topic(docs: DataFrame, doc_topics: DataFrame, topics: list[str]) -> DataFrame:
    return docs.join(doc_topics.where(F.col("topic").isin(*topics)).select("document_id").distinct(), "document_id", "left_semi")


def latest_updates(events: DataFrame, docs: DataFrame, today: str, days: int = 30, limit: int = 20, kinds: list[str] | None = None,
                   natures: list[str] | None = None) -> DataFrame:
    """Newest events with their documents; ties by event id."""
    bound(limit, 1, 100, "limit")
    d = filters(docs, natures=natures).select("document_id", "document_number", "title", "document_nature", F.col("effective_from").alias("doc_effective"))
    j = window(events, today, days, kinds).join(d, "document_id")
    own = F.col("effective_from") if "effective_from" in events.columns else F.lit(None).cast("date")
    return (j.select("event_id", "document_id", "event_type", "event_date", "document_number", "title", "document_nature",
                     F.coalesce(own, "doc_effective").alias("effective_from"))
            .orderBy(F.col("event_date").desc(), "event_id").limit(limit))


def resolve(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(asked, document_id): ids of digits are document ids, others canonical ids; two equi-joins, no OR."""
    plain = ids.where(F.col("asked").rlike("^[0-9]+$")).select("asked", F.col("asked").cast("long").alias("document_id"))
    named = ids.where(~F.col("asked").rlike("^[0-9]+$"))
    one = plain.join(docs.select("document_id"), "document_id", "left_semi").select("asked", "document_id")
    two = named.join(docs.select("document_id", "canonical_id"), named.asked == docs.canonical_id).select("asked", "document_id")
    return one.unionByName(two)


def relationships_of(docs: DataFrame, rels: DataFrame) -> DataFrame:
    """Edges of documents as source or target: (document_id, relationship_id, direction, other_document_id, relationship_type)."""
    ids = docs.select("document_id").distinct()
    out = rels.select(F.col("source_document_id").alias("document_id"), "relationship_id", F.lit("outgoing").alias("direction"),
                      F.col("target_document_id").alias("other_document_id"), "relationship_type")
    into = rels.where("source_document_id <> target_document_id").select(
        F.col("target_document_id").alias("document_id"), "relationship_id", F.lit("incoming").alias("direction"),
        F.col("source_document_id").alias("other_document_id"), "relationship_type")
    return out.join(ids, "document_id", "left_semi").unionByName(into.join(ids, "document_id", "left_semi"))


def _has(c: Column, q: Column) -> Column:
    return F.coalesce(F.lower(c).contains(q), F.lit(False))


#: Letters of a question's key, by which texts that may hold it are found; at most so many questions are broadcast, and
#: at most so many keys are looked for one by one (with more, all runs of letters of a text are keys; both find the same).
KEY, MAX_QUESTIONS, FEW_KEYS = 3, 10_000, 64


def questions(queries: DataFrame) -> tuple[DataFrame, bool]:
    """(query_id, q, q_number, q_tokens) of the questions that have letters or digits, and whether they are few."""
    q = queries.select("query_id", F.lower(F.trim("query")).alias("q")).where(F.col("q").rlike(r"[\p{L}\p{N}]"))
    number = T.normalize_number(F.regexp_extract("q", r"([0-9]+/[0-9]{4}/[\p{L}0-9_.-]+)", 1))
    q = q.select("query_id", "q", F.nullif(number, F.lit("")).alias("q_number"), T.tokens(F.col("q")).alias("q_tokens"))
    return q, q.limit(MAX_QUESTIONS + 1).count() <= MAX_QUESTIONS


def _keyed(queries: DataFrame) -> tuple[DataFrame, list[int], list[str], bool]:
    """Questions (query_id, q, q_number, q_tokens, key, token), the lengths of their keys, the first FEW_KEYS + 1 keys, and
    whether the questions are few.

    A question's key is one of its runs of KEY letters (the last in code point order, as accented letters are rarer):
    a text that holds the question holds the key, so texts meet questions by equal keys.
    """
    q, few = questions(queries)
    q = q.select("query_id", "q", "q_number", "q_tokens",
                 F.when(F.length("q") <= KEY, F.col("q")).otherwise(F.array_max(_runs(F.col("q"), [KEY]))).alias("key"),
                 F.array_max(F.transform("q_tokens", lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"].alias("token"))
    lengths = q.agg(F.collect_set(F.length("key")).alias("lengths")).first().lengths
    keys = sorted(r.key for r in q.select("key").distinct().limit(FEW_KEYS + 1).collect())
    return q, sorted(lengths), keys, few


def _runs(c: Column, lengths: list[int]) -> Column:
    """All distinct runs of letters of the lengths in a text."""
    of = lambda n: F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array())
    return F.array_distinct(F.concat(*[of(n) for n in lengths])) if lengths else F.array().cast("array<string>")


def _keys_in(c: Column, lengths: list[int], keys: list[str], few_keys: int = FEW_KEYS) -> Column:
    """The keys that a text may meet questions by."""
    if len(keys) > few_keys or not keys:
        return _runs(c, lengths)
    return T.let(c, lambda low: F.array_compact(F.array(*[F.when(low.contains(k), F.lit(k)) for k in keys])))


def search(queries: DataFrame, docs: DataFrame, provs: DataFrame, k: int = 10, effective_only: bool = False, topics: list[str] | None = None) -> DataFrame:
    """Ranked documents of one or many queries (query_id, query): number, title phrase, all tokens, or a provision that
    holds the phrase, only documents of one of the topics if any are asked for. A query without letters or digits finds
    nothing.

    Texts meet queries by equi-joins, on the number, on a key that holders of the phrase share with it, and on the
    query's longest token; what met is then checked. Texts are not copied for their keys: ids meet, and the contents of
    what met are joined. Queries are broadcast if they are few, by count. Where the same tables are searched again and
    again, ``postings`` writes an index of them once.
    """
    bound(k, 1, 50, "k")
    q, lengths, keys, few = _keyed(queries)
    q = F.broadcast(q) if few else q
    title = F.lower("title")
    d = filters(docs, effective_only=effective_only, topics=topics).withColumn("n_number", T.normalize_number(F.col("document_number")))
    heading = F.col("heading") if "heading" in provs.columns else F.lit(None).cast("string")
    wanted = provs.select("document_id", "provision_id", "article", heading.alias("heading"), "content", "sort_key")
    if few:
        held = wanted.withColumn("key", F.explode(_keys_in(F.lower("content"), lengths, keys))).join(q.select("query_id", "q", "key"), "key").where(_has(F.col("content"), F.col("q")))
    else:
        met = wanted.select("provision_id", F.explode(_keys_in(F.lower("content"), lengths, keys)).alias("key")).join(q.select("query_id", "q", "key"), "key").drop("key")
        held = met.join(wanted, "provision_id").where(_has(F.col("content"), F.col("q")))
    by_number = d.join(q.select("query_id", F.col("q_number").alias("n_number")), "n_number").select("query_id", "document_id")
    by_title = (d.select("document_id", "title", F.explode(_keys_in(title, lengths, keys)).alias("key")).join(q.select("query_id", "q", "key"), "key")
                .where(_has(F.col("title"), F.col("q"))).select("query_id", "document_id"))
    d_tokens = d.select("document_id", T.tokens(F.col("title")).alias("d_tokens"))
    by_tokens = (d_tokens.select("document_id", "d_tokens", F.explode("d_tokens").alias("token")).join(q.select("query_id", "q_tokens", "token"), "token")
                 .where(F.size(F.array_except("q_tokens", "d_tokens")) == 0).select("query_id", "document_id"))
    return ranked(q, d, by_number.union(by_title).union(by_tokens), snippets(held), k)


def snippets(held: DataFrame) -> DataFrame:
    """(query_id, document_id, snippets): the first two provisions of each document that hold the question."""
    w = Window.partitionBy("query_id", "document_id").orderBy("sort_key", "provision_id")
    return (held.withColumn("n", F.row_number().over(w)).where("n <= 2").groupBy("query_id", "document_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", T.snippet(F.col("article"), F.col("heading"), F.col("content")).alias("s")))), lambda x: x["s"]), " | ").alias("snippets")))


def ranked(q: DataFrame, d: DataFrame, found: DataFrame, top: DataFrame, k: int) -> DataFrame:
    """The k best documents of each question, from (query_id, document_id) found in titles and numbers and from provisions with snippets."""
    found = found.withColumn("snippets", F.lit(None).cast("string")).unionByName(top)
    found = found.groupBy("query_id", "document_id").agg(F.max("snippets").alias("snippets"))
    score = (F.lit(0.1) + F.when(F.col("n_number") == F.col("q_number"), 0.8).otherwise(0.0) + F.when(_has(F.col("title"), F.col("q")), 0.4).otherwise(0.0)
             + F.when(F.col("document_nature") == "normative_legal_document", 0.15).when(F.col("document_nature") == "official_guidance", 0.05).otherwise(0.0))
    scored = found.join(d, "document_id").join(q.select("query_id", "q", "q_number"), "query_id").withColumn("score", F.round(score, 6))
    rank = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "document_id")
    return (scored.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
            .select("query_id", "rank", "document_id", "document_number", "document_nature", "title", "score", F.coalesce("snippets", F.lit("")).alias("snippets")))


def provision_score(content: Column, heading: Column, terms: Column, q: Column, in_document: Column) -> Column:
    """phrase 3 in the content, else 2.5 in the heading; per term 0.5 and 0.8; 1 for the document's title or number."""
    c, h = F.lower(F.coalesce(content, F.lit(""))), F.lower(F.coalesce(heading, F.lit("")))
    phrase = F.when(c.contains(q), 3.0).when(h.contains(q), 2.5).otherwise(0.0)
    per = F.aggregate(terms, F.lit(0.0), lambda s, t: s + F.when(c.contains(t), 0.5).otherwise(0.0) + F.when(h.contains(t), 0.8).otherwise(0.0))
    return F.round(phrase + per + F.when(in_document, 1.0).otherwise(0.0), 6)


def effective_rules(queries: DataFrame, docs: DataFrame, provs: DataFrame, rels: DataFrame, as_of: str, k: int = 10, evidence: DataFrame | None = None,
                    topics: list[str] | None = None, verdicts: DataFrame | None = None) -> DataFrame:
    """Provisions in force at a date for each query, rules and guidance ranked apart, k of each.

    Relevance is decided before status. The candidates, at most 20 of each query, are written once; the rest starts from
    them: only their edges and provisions are read. With evidence (document_id, provision_id, field_name) rows have the
    number and fields of theirs and a snippet; with verdicts, too, whether a row may be an answer: its document's sources
    agree and something admissible speaks for it.
    """
    cands = kept(search(queries, docs, provs, 20, effective_only=True, topics=topics).select(
        "query_id", "document_id", "title", "document_number", "document_nature", F.col("score").alias("doc_score")), "candidates")
    ids = cands.select("document_id").distinct()
    edges = rels.join(ids.withColumnRenamed("document_id", "target_document_id"), "target_document_id", "left_semi")
    state = kept(status.documents_at(docs.join(ids, "document_id", "left_semi"), edges, [as_of]), "state")
    q = queries.select("query_id", F.lower(F.trim("query")).alias("q"), T.query_terms(F.col("query")).alias("terms"))
    live = cands.join(state.where("is_effective").select("document_id"), "document_id").join(q, "query_id")
    heading = F.col("heading") if "heading" in provs.columns else F.lit("")
    relevant = kept(provs.join(live.select("document_id").distinct(), "document_id", "left_semi"), "provisions")
    scored = (live.join(relevant.select("provision_id", "document_id", "article", "clause", "content", heading.alias("heading")), "document_id")
              .withColumn("score", provision_score(F.col("content"), F.col("heading"), F.col("terms"), F.col("q"),
                                                   _has(F.col("title"), F.col("q")) | _has(F.col("document_number"), F.col("q"))))
              .where("score > 0"))
    prov_state = status.provisions_at(relevant, state, edges, [as_of]).where("is_effective").select("provision_id")
    lane = F.when(F.col("document_nature") == "official_guidance", "guidance").otherwise("rules")
    ranked = scored.join(prov_state, "provision_id").withColumn("lane", lane).withColumn(
        "total_score", F.round(F.col("doc_score") * 0.4 + F.col("score") * 0.6, 6))
    w = Window.partitionBy("query_id", "lane").orderBy(F.col("total_score").desc(), "provision_id")
    top = ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= bound(k, 1, 50, "k"))
    out = top.select("query_id", "lane", "rank", "provision_id", "document_id", "article", "clause", "total_score",
                     *([F.substring("content", 1, F.when(F.col("lane") == "guidance", 300).otherwise(250)).alias("snippet")] if evidence is not None else []))
    if evidence is None:
        return out
    from .evidence import for_provisions
    own = evidence.join(ids, "document_id", "left_semi")
    out = out.join(for_provisions(relevant, own), "provision_id", "left").withColumn("n_evidence", F.coalesce("n_evidence", F.lit(0)))
    if verdicts is None:
        return out
    judged = verdicts.join(ids, "document_id", "left_semi").select("document_id", F.col("status").alias("verification"), F.col("answerable").alias("_agreed"))
    return out.join(judged, "document_id", "left").withColumn("verification", F.coalesce("verification", F.lit("unverified"))).withColumn(
        "answerable", F.coalesce("_agreed", F.lit(False)) & (F.col("n_evidence") > 0)).drop("_agreed")


def answerability(queries: DataFrame, rules: DataFrame, strict: bool = False) -> DataFrame:
    """(query_id, n_rules, n_guidance, answerable, code). With strict only rows that may be answers (see ``effective_rules``
    with verdicts) make a query answerable; the code tells what keeps the others from it."""
    n = rules.groupBy("query_id").agg(
        F.count_if(F.col("lane") == "rules").alias("n_rules"), F.count_if(F.col("lane") == "guidance").alias("n_guidance"),
        *([F.count_if("answerable").alias("ok"), F.count_if(F.col("verification") == "conflicting").alias("against"), F.count_if(F.col("n_evidence") > 0).alias("spoken")] if strict else []))
    c = lambda x: F.coalesce(F.col(x), F.lit(0))
    found = c("n_rules") + c("n_guidance")
    code = F.when(found == 0, "INSUFFICIENT_EVIDENCE")
    if strict:
        code = code.when(c("ok") > 0, None).when(c("against") > 0, "SOURCE_CONFLICT").when(c("spoken") == 0, "INSUFFICIENT_EVIDENCE").otherwise("VERIFICATION_PENDING")
    return queries.select("query_id").join(n, "query_id", "left").select(
        "query_id", c("n_rules").alias("n_rules"), c("n_guidance").alias("n_guidance"), ((c("ok") if strict else found) > 0).alias("answerable"), code.alias("code"))


def detail(docs: DataFrame, srcs: DataFrame, provs: DataFrame, rels: DataFrame, evidence: DataFrame, conflicts: DataFrame) -> DataFrame:
    """One nested record per document; every child is folded to an array before it is joined."""
    fold = lambda df, name, *cols: df.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    return (docs.join(fold(srcs, "sources", "source_id", "source_authority"), "document_id", "left")
            .join(fold(provs, "provisions", "sort_key", "provision_id", "article", "clause", "content"), "document_id", "left")
            .join(fold(relationships_of(docs, rels), "relationships", "relationship_id", "direction", "other_document_id", "relationship_type"), "document_id", "left")
            .join(fold(evidence, "evidence", "field_name", "source_id", "asserted_value"), "document_id", "left")
            .join(fold(conflicts, "conflicts", "field_name", "source_a", "source_b", "severity"), "document_id", "left"))


def flat_detail(nested: DataFrame) -> DataFrame:
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return nested.select("document_id", "document_number", *[F.greatest(size(c), F.lit(0)).alias(f"n_{c}") for c in ("sources", "provisions", "relationships", "evidence", "conflicts")],
                         F.element_at(F.col("provisions.sort_key"), 1).alias("first_sort_key"))


def contract(docs: DataFrame, doc_status: DataFrame, verdicts: DataFrame, evidence: DataFrame) -> DataFrame:
    """(document_id, as_of, status, blockers, answerable): what keeps a document's status from being an answer."""
    n = evidence.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    j = doc_status.join(docs.select("document_id", "effective_from", "document_number"), "document_id").join(
        verdicts.select("document_id", F.col("status").alias("v")), "document_id", "left").join(n, "document_id", "left")
    codes = F.array(
        F.when(F.col("v") == "conflicting", "SOURCE_CONFLICT"), F.when(F.col("status") == "unknown", "UNKNOWN_STATUS"),
        F.when(F.col("effective_from").isNull(), "MISSING_EFFECTIVE_DATE"), F.when(F.col("document_number").isNull(), "UNRESOLVED_IDENTITY"),
        F.when(F.col("n").isNull(), "NO_EVIDENCE"), F.when(F.coalesce(F.col("v"), F.lit("unverified")) == "unverified", "VERIFICATION_PENDING"))
    blockers = F.filter(codes, lambda x: x.isNotNull())
    return j.select("document_id", "as_of", "status", F.array_join(blockers, ",").alias("blockers"), (F.size(blockers) == 0).alias("answerable"))
