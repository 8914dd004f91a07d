"""Text to provisions (C1, W1, W2) and to relationships."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions import text as T


@dataclass(frozen=True)
class Rules:
    """Heading patterns: group 1 is the number, for articles group 2 the heading."""

    chapter: str = r"(?iu)^Chương\s+([IVXLCDM0-9]+)[\s:.-]*"
    section: str = r"(?iu)^Mục\s+([IVXLCDM0-9]+)[\s:.-]*"
    article: str = r"(?iu)^Điều\s+([0-9]+[a-z]?)[\s:.-]*(.*)"
    clause: str = r"^(?:Khoản\s+)?([0-9]+)\.\s*"
    chapter_name: str = "Chương "
    section_name: str = "Mục "
    article_name: str = "Điều "
    whole: str = "Toàn văn"


VN_RULES = Rules()


#: Lines from which on a document's lines are scanned in chunks, and lines of a chunk.
LONG, CHUNK = 20_000, 5_000


def _carried(lines: DataFrame, sums: dict[str, Column], lasts: dict[str, Column], chunk: int | None) -> DataFrame:
    """lines (document_id, pos, ...) with running sums and last known values over each document, in the order of pos.

    With ``chunk`` a document is as many window tasks as it has chunks of lines: values are carried within chunks, the
    chunks' ends are carried over the document (one row a chunk), and what came before a chunk is added to its lines.
    """
    given = lines.withColumns({f"_s_{n}": c for n, c in sums.items()} | {f"_l_{n}": c for n, c in lasts.items()})

    def over(df: DataFrame, keys: list[str], order: str, frame_end: int, prefix: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, frame_end)
        return df.withColumns({f"{prefix}{n}": F.sum(f"_s_{n}").over(w) for n in sums} | {f"{prefix}{n}": F.last(f"_l_{n}", True).over(w) for n in lasts})

    if not chunk:
        return over(given, ["document_id"], "pos", 0, "").drop(*[f"_s_{n}" for n in sums], *[f"_l_{n}" for n in lasts])
    dealt = given if "_chunk" in given.columns else given.withColumn("_chunk", F.floor(F.col("pos") / chunk).cast("int"))
    ends = dealt.groupBy("document_id", "_chunk").agg(*[F.sum(f"_s_{n}").alias(f"_s_{n}") for n in sums], *[
        F.max_by(f"_l_{n}", F.when(F.col(f"_l_{n}").isNotNull(), F.col("pos"))).alias(f"_l_{n}") for n in lasts])
    before = over(ends, ["document_id"], "_chunk", -1, "_b_").select("document_id", "_chunk", *[f"_b_{n}" for n in (*sums, *lasts)])
    own = over(dealt, ["document_id", "_chunk"], "pos", 0, "_o_").join(before, ["document_id", "_chunk"])
    return own.select(*lines.columns, *[(F.col(f"_o_{n}") + F.coalesce(F.col(f"_b_{n}"), F.lit(0))).alias(n) for n in sums], *[F.coalesce(f"_o_{n}", f"_b_{n}").alias(n) for n in lasts])


#: White space around a line's end, matched from where it begins: lines are trimmed and empty ones vanish as texts are split by it.
_BREAK, _AROUND = r"(?U)(?<!\s)(?=[\s&&[^\n]]*+\n)\s++", r"(?U)\A\s++|(?<!\s)\s++\z"


def provisions(docs: DataFrame, rules: Rules = VN_RULES, long: int = LONG, chunk: int = CHUNK) -> DataFrame:
    """Provisions of docs (document_id, text): one shuffle, on document_id, for texts of up to ``long`` lines.

    Articles begin at article headings and end at any heading; lines before the first article and lines between a
    chapter or section heading and the next article belong to none. In an article with clauses the text before the
    first is a provision of its own. A text without articles is one provision. Longer texts give the same rows, their
    lines being scanned in chunks by many tasks.
    """
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    # Filters would move below and work the text out again for each of them, so texts are told apart by columns, and parts that are not wanted are empty.
    given = docs.select("document_id", (breaks >= long).alias("_long"), _composed().alias("text"))
    lines = given.select("document_id", "_long", "text", F.split(F.regexp_replace("text", _AROUND, ""), _BREAK).alias("lines"))
    told = lines.select("*", F.exists("lines", lambda x: x.rlike(rules.article)).alias("_articles"))
    cut = told.select("document_id", "_articles", F.when(F.col("_articles"), F.when(~F.col("_long"), _cut(F.col("lines"), rules))).when(
        F.trim("text") != "", F.array(F.trim("text"))).alias("cut"))
    # An outer explode: for a plain one Spark infers a filter on the array, which moves below and works everything out once more for each use.
    parts = cut.select("document_id", "_articles", F.posexplode_outer("cut").alias("pos", "content")).where("pos IS NOT NULL")
    head = F.element_at(F.split("content", "\n", 2), 1)
    short = _carried_on(_marked(parts.select("document_id", "pos", "_articles", "content", F.when(F.col("_articles"), head).otherwise("").alias("line")), rules), rules, None)
    # What an article holds before its first clause is followed by that clause.
    following = F.lead("c").over(Window.partitionBy("document_id").orderBy("pos"))
    short = short.withColumn("has", (F.col("starts") > 0) | following.isNotNull()).where("in_article OR NOT _articles")
    whole = ~F.col("_articles")
    own = _provision(rules)
    null = {"chapter": None, "section": None, "article": F.lit(rules.whole), "clause": None, "heading": None, "content": F.col("content"), "valid_from": None, "valid_to": None,
            "status_override": None, "sort_key": F.lit("0001.0000")}
    rows = short.select("document_id", *[F.when(whole, null[n]).otherwise(c).alias(n) if null[n] is not None else F.when(~whole, c).alias(n) for n, c in own.items()])
    found = _articles(docs.where(breaks >= long).select("document_id", _composed().alias("text")), rules, chunk)
    return rows.unionByName(found.select("document_id", *[c.alias(n) for n, c in own.items()])).withColumn(
        "normalized_content", T.normalized_text(F.col("content"))).withColumn("content_hash", F.sha2("content", 256))


def _composed() -> Column:
    return T.composed(F.regexp_replace("text", r"\r\n", "\n"))


def _clause(rules: Rules, line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, rules.clause, 1), F.lit(""))


def _cut(lines: Column, rules: Rules) -> Column:
    """Lines joined to parts, each of which begins at a heading or a clause and goes on to the next; those before the first are left out."""
    begins = lambda x: x.rlike(rules.article) | x.rlike(rules.chapter) | x.rlike(rules.section) | _clause(rules, x).isNotNull()
    places = F.filter(F.transform(lines, lambda x, i: F.when(begins(x), i)), lambda i: i.isNotNull())
    part = lambda at: lambda p, k: F.array_join(F.slice(lines, p + 1, F.coalesce(F.get(at, k + 1), F.size(lines)) - p), "\n")
    return T.let(places, lambda at: F.transform(at, part(at)))


def _marked(lines: DataFrame, rules: Rules) -> DataFrame:
    """lines with what each of them is: an article heading (a), any other heading (stop), the number of a clause (c)."""
    is_a, is_c, is_s = F.col("line").rlike(rules.article), F.col("line").rlike(rules.chapter), F.col("line").rlike(rules.section)
    marked = lines.select("*", is_a.alias("a"), (is_c | is_s).alias("stop"), is_c.alias("is_c"), is_s.alias("is_s"))
    return marked.withColumn("c", F.when(~F.col("a") & ~F.col("stop"), _clause(rules, F.col("line"))))


def _carried_on(marked: DataFrame, rules: Rules, chunk: int | None) -> DataFrame:
    """Marked lines with the article, the chapter and the section that they stand in, and how many clauses of the article have begun (starts)."""
    head = F.col("a") | F.col("stop")
    carried = _carried(marked, {"article_no": F.col("a").cast("int"), "clauses": F.col("c").isNotNull().cast("int")}, {
        "chapter": F.when(F.col("is_c"), F.concat(F.lit(rules.chapter_name), F.regexp_extract("line", rules.chapter, 1))),
        "section": F.when(F.col("is_s"), F.concat(F.lit(rules.section_name), F.regexp_extract("line", rules.section, 1))),
        "number": F.when(F.col("a"), F.regexp_extract("line", rules.article, 1)), "heading": F.when(F.col("a"), F.trim(F.regexp_extract("line", rules.article, 2))),
        "in_article": F.when(head, F.col("a"))}, chunk)
    # Clauses of an article: those so far, less those before its heading.
    counted = _carried(carried, {}, {"earlier": F.when(F.col("a"), F.col("clauses"))}, chunk)
    return counted.withColumn("starts", F.col("clauses") - F.col("earlier"))


def _provision(rules: Rules) -> dict[str, Column]:
    """The columns of a provision, of its content and what was carried to it."""
    valid_to = T.clause_date(F.col("content"), "bãi bỏ|hết hiệu lực")
    pad = lambda c: F.lpad(c.cast("string"), 4, "0")
    return {"chapter": F.col("chapter"), "section": F.col("section"), "article": F.concat(F.lit(rules.article_name), "number"), "clause": F.col("c"),
            "heading": F.nullif("heading", F.lit("")), "content": F.col("content"), "valid_from": F.when(F.col("has"), T.clause_date(F.col("content"), "có hiệu lực|áp dụng")),
            "valid_to": F.when(F.col("has"), valid_to), "status_override": F.when(F.col("has") & valid_to.isNotNull(), "repealed"),
            "sort_key": F.concat(pad(F.col("article_no")), F.lit("."), F.when(F.col("has"), pad(F.col("starts") + 1)).otherwise("0000"))}


def _articles(given: DataFrame, rules: Rules, chunk: int) -> DataFrame:
    """Articles and clauses of very long texts that have article headings; lines are scanned by chunks."""
    exploded = given.select("document_id", F.posexplode_outer(F.split(F.regexp_replace("text", _AROUND, ""), _BREAK)).alias("pos", "line")).where("pos IS NOT NULL")
    # Dealt once by what all steps below group by: they read one shuffle, and the texts are scanned once.
    lines = exploded.withColumn("_chunk", F.floor(F.col("pos") / chunk).cast("int")).repartition("document_id", "_chunk")
    parts = _carried_on(_marked(lines, rules), rules, chunk).where("in_article")
    grouped = parts.groupBy("document_id", "article_no", "starts").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("content"),
        F.min_by("c", "pos").alias("c"), F.first("chapter").alias("chapter"), F.first("section").alias("section"),
        F.first("number").alias("number"), F.first("heading").alias("heading"))
    return grouped.withColumn("has", F.max("starts").over(Window.partitionBy("document_id", "article_no")) > 0)


_KIND = r"(?:thông\s+tư|nghị\s+định|luật|quyết\s+định)"
_NUMBER = r"(?:số\s+)?([0-9]+(?:/[0-9]+)?/[A-Za-z0-9Đđ_.-]+)"
#: Ordered patterns, and the groups with number, clause and article.
EDGE_RULES = [
    ("partially_repeals", r"(?iu)bãi\s+bỏ\s+(?:khoản\s+([0-9]+)\s+)?(?:điều\s+([0-9]+)\s+)?(?:của\s+)?"
                          r"(?:thông\s+tư|nghị\s+định|luật(?:\s+[^0-9\n]+)?|quyết\s+định)\s+" + _NUMBER, 3),
    ("repeals", r"(?iu)bãi\s+bỏ\s+" + _KIND + r"\s+" + _NUMBER, 1),
    ("replaces", r"(?iu)thay\s+thế\s+" + _KIND + r"\s+" + _NUMBER, 1),
    ("amends", r"(?iu)(?:sửa\s+đổi|bổ\s+sung|sửa\s+đổi,\s*bổ\s+sung)\s+.*?" + _KIND + r"\s+" + _NUMBER, 1),
    ("guides", r"(?iu)hướng\s+dẫn\s+(?:thi\s+hành\s+)?(?:thông\s+tư|nghị\s+định|luật)\s+" + _NUMBER, 1)]


#: Verbs and the edges they give, in the order in which a line is searched for them.
VERBS = [("bãi bỏ", "repeals"), ("thay thế", "replaces"), ("sửa đổi", "amends"), ("bổ sung", "amends"), ("hướng dẫn", "guides")]
_WORDS = r"\s+".join
#: Words of a line: verbs, places in a document, documents with a number, numbers after "số" only, words that join a list, others.
_TOKENS = "(?iu)" + "|".join([
    *(_WORDS(v.split()) for v, _ in VERBS), r"thi\s+hành", r"khoản\s+[0-9]+", r"điều\s+[0-9]+",
    r"(?:thông\s+tư|nghị\s+định|quyết\s+định)\s+" + _NUMBER, r"luật(?:\s+(?!số\s|bãi\s|thay\s|sửa\s|bổ\s|hướng\s)\p{L}+)*\s+" + _NUMBER, r"số\s+" + _NUMBER.removeprefix(r"(?:số\s+)?"),
    r"(?:và|của|các|hoặc)(?![\p{L}\p{N}])", r"[\p{L}\p{N}]+"])


def relationships(docs: DataFrame, first_only: bool = False) -> DataFrame:
    """(document_id, line_no, relationship_type, target_number, target_article, target_clause, snippet): every document that a line names after a verb.

    A number belongs to the verb before it. The first one must follow its verb at once (places, and words that join a
    list, aside; after "amends" anything may stand between), later ones belong to it until the next verb. A repeal of a
    named clause or article is partial. With first_only the first rule that matches a line gives its one edge.
    """
    lines = docs.select("document_id", F.posexplode(F.split(T.composed(F.col("text")), r"\r?\n")).alias("line_no", "raw")).select("document_id", "line_no", F.trim("raw").alias("line"))
    found = (lines.withColumn("e", _first_edge()).where("e IS NOT NULL") if first_only
             else lines.where(F.col("line").rlike("(?iu)" + "|".join(_WORDS(v.split()) for v, _ in VERBS))).withColumn("e", F.explode(_edges(F.col("line")))))
    return found.select("document_id", "line_no", F.col("e.t").alias("relationship_type"), T.normalize_number(F.col("e.n")).alias("target_number"),
                        F.when(F.col("e.a").isNotNull(), F.concat(F.lit("Điều "), "e.a")).alias("target_article"), F.col("e.c").alias("target_clause"),
                        F.col("line").alias("snippet"))


def _first_edge() -> Column:
    choices = []
    for name, pattern, group in EDGE_RULES:
        number = F.regexp_extract("line", pattern, group)
        clause = F.nullif(F.regexp_extract("line", pattern, 1), F.lit("")) if group == 3 else F.lit(None).cast("string")
        article = F.nullif(F.regexp_extract("line", pattern, 2), F.lit("")) if group == 3 else F.lit(None).cast("string")
        hit = (number != "") & ((clause.isNotNull() | article.isNotNull()) if group == 3 else F.lit(True))
        choices.append(F.when(hit, F.struct(F.lit(name).alias("t"), number.alias("n"), clause.alias("c"), article.alias("a"))))
    return F.coalesce(*choices)


def _edges(line: Column) -> Column:
    """All edges of a line, by a fold over its tokens that carries the verb, whether it is open, and the places named since."""
    none, edge = F.lit(None).cast("string"), "array<struct<t:string,n:string,c:string,a:string>>"
    start = F.struct(none.alias("verb"), F.lit(False).alias("open"), F.lit(False).alias("sure"), none.alias("clause"), none.alias("article"), F.array().cast(edge).alias("out"))

    def step(s: Column, token: Column) -> Column:
        low = F.regexp_replace(F.lower(token), r"\s+", " ")
        verb = F.coalesce(*[F.when(low == v, F.lit(kind)) for v, kind in VERBS])
        place = lambda word: F.nullif(F.regexp_extract(low, rf"^{word} ([0-9]+)$", 1), F.lit(""))
        number = F.nullif(F.regexp_extract(token, r"(?iu)\s" + _NUMBER + "$", 1), F.lit(""))
        named = low.rlike(r"^luật (?!số )[^0-9]")  # a law by its name: only where a place in it or a document before it was named
        bare = low.startswith("số ")
        placed = s["clause"].isNotNull() | s["article"].isNotNull()
        fits = s["open"] & (s["sure"] | (~bare & (~named | placed | (s["verb"] == "amends")) & ~((s["verb"] == "guides") & low.startswith("quyết"))))
        partial = (s["verb"] == "repeals") & placed
        new = F.struct(F.when(partial, "partially_repeals").otherwise(s["verb"]).alias("t"), number.alias("n"), F.when(partial, s["clause"]).alias("c"), F.when(partial, s["article"]).alias("a"))
        state = lambda verb, open_, sure, clause, article, out: F.struct(
            verb.alias("verb"), open_.alias("open"), sure.alias("sure"), clause.alias("clause"), article.alias("article"), out.alias("out"))
        true, false = F.lit(True), F.lit(False)
        return (F.when(verb.isNotNull(), state(verb, true, false, none, none, s["out"]))
                .when(number.isNotNull(), state(s["verb"], s["open"], s["sure"] | fits, none, none, F.when(fits, F.concat(s["out"], F.array(new))).otherwise(s["out"])))
                .when(place("khoản").isNotNull(), state(s["verb"], s["open"], s["sure"], place("khoản"), none, s["out"]))
                .when(place("điều").isNotNull(), state(s["verb"], s["open"], s["sure"], s["clause"], place("điều"), s["out"]))
                .when(low.isin("và", "của", "các", "hoặc", "thi hành"), s)
                .otherwise(state(s["verb"], s["open"] & (s["sure"] | (s["verb"] == "amends")), s["sure"], s["clause"], s["article"], s["out"])))

    return F.aggregate(F.regexp_extract_all(line, F.lit(_TOKENS), 0), start, step)["out"]


def resolve(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """Edges with target_document_id by normalised number (null if unknown) and the source's effective_from."""
    by_number = docs.groupBy(T.normalize_number(F.col("document_number")).alias("target_number")).agg(F.min("document_id").alias("target_document_id"))
    source = docs.select("document_id", "effective_from")
    return edges.join(by_number, "target_number", "left").join(source, "document_id", "left")
