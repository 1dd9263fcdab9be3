"""Keyword, fuzzy, qualified and ranked search over symbols and texts."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.text_index import K1, SHORT_TERM, B, TextIndex
from lodestone.sources.storage import kept


@dataclass
class ParsedQuery:
    terms: list[str] = field(default_factory=list)
    kind: str | None = None
    file: str | None = None
    lang: str | None = None
    name: str | None = None
    role: str | None = None
    exported: bool | None = None

    @property
    def filters(self) -> bool:
        return any(x is not None for x in (self.kind, self.file, self.lang, self.name, self.role, self.exported))


def parse_query(raw: str) -> ParsedQuery:
    """`field:value` parts (kind, lang, language, path, file, name, role, exported), the rest as terms."""
    q = ParsedQuery()

    def take(m: re.Match) -> str:
        key, value = m[1].lower(), m[2]
        if key == "kind":
            q.kind = value.lower()
        elif key in ("lang", "language"):
            q.lang = value.lower()
        elif key in ("path", "file"):
            q.file = value
        elif key == "name":
            q.name = value
        elif key == "role":
            q.role = value.lower()
        else:
            q.exported = value.lower() in ("true", "1")
        return " "

    rest = re.sub(r"(?i)\b(kind|language|lang|path|file|name|role|exported):(\S+)", take, raw)
    q.terms = re.sub(r"[^\w\s]", " ", rest, flags=re.ASCII).split()
    if q.name and q.name not in q.terms:
        q.terms.insert(0, q.name)
    return q


def camel_tokens(text: str, punctuation: str = T.INDEX_PUNCTUATION) -> list[str]:
    """The driver's twin of text.tokens, for queries."""
    spaced = re.sub(punctuation, " ", re.sub("([a-z])([A-Z])", r"\1 \2", text)).lower()
    return [t for t in spaced.split() if len(t) >= 2]


def document_tokens(*columns: str, punctuation: str = T.INDEX_PUNCTUATION) -> Column:
    return T.tokens(F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in columns)), punctuation)


def inverted_index(rows: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """(token, id), each pair once."""
    return rows.select(F.explode(F.array_distinct(tokens)).alias("token"), F.col(id_col).alias("id"))


def _any_begins(tokens: Column, term: str) -> Column:
    return F.exists(tokens, lambda t: t.startswith(term))


def _occurrences(tokens: Column, term: str) -> Column:
    return F.size(F.filter(tokens, lambda t: t == term))


def has_candidate(tokens: Column, terms: list[str]) -> Column:
    """Whether any token is a term, or begins with one of four letters or fewer."""
    hit = F.arrays_overlap(tokens, F.array(*map(F.lit, terms)))
    for term in terms:
        if len(term) <= SHORT_TERM:
            hit = hit | _any_begins(tokens, term)
    return F.coalesce(hit, F.lit(False))


def may_have(texts: list[Column], terms: list[str]) -> Column:
    """True wherever a token of the texts is a term or begins with one, and where that can't be told without tokens; much cheaper than those."""
    out = F.lit(False)
    for term in terms:
        for text in texts:
            # lower-casing depends on what stands around a letter for other letters than these
            out = out | (F.lower(text).contains(term) if term.isascii() else F.lit(True))
    return F.coalesce(out, F.lit(False))


def keyword_search(rows: DataFrame, query: str, limit: int | None = 20, columns: tuple[str, ...] = ("name", "qualified_name", "signature", "doc"), exported: str | None = "exported", index: TextIndex | None = None) -> DataFrame:
    """rows with rank (the negated score), best first; the first of the columns is the name. index: a stored one of the columns' tokens (document_tokens), so that only candidates are read whole."""
    raw = [t.lower() for t in re.sub(r"[^\w\s]", " ", query, flags=re.ASCII).split()]
    if not raw:
        return rows.limit(0).withColumn("rank", F.lit(0.0))
    terms = list(dict.fromkeys(raw + camel_tokens(query)))
    if index is not None:
        found = rows.join(index.candidates(terms), "id", "left_semi")
    else:
        found = rows.filter(may_have([F.coalesce(F.col(c), F.lit("")) for c in columns], terms) & has_candidate(document_tokens(*columns), terms))
    lower = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in columns]
    score = F.lit(0)
    for term in raw:
        elsewhere = F.lit(False)
        for c in lower[1:]:
            elsewhere = elsewhere | c.contains(term)
        score = score + F.when(lower[0] == term, 100).when(lower[0].startswith(term), 50).when(lower[0].contains(term), 20).when(elsewhere, 5).otherwise(0)
    if exported:
        score = score + F.when(F.col(exported) == 1, 10).otherwise(0)
    ranked = found.withColumn("rank", -score).filter("rank < 0")
    return ranked.orderBy("rank", "id").limit(limit) if limit else ranked


def fuzzy_search(rows: DataFrame, query: str, limit: int | None = 20, threshold: float = 0.3, name: str = "name") -> DataFrame:
    """rows with rank: trigram likeness of names, at least the threshold, and edit distance."""
    wanted = query.strip().lower()
    own = F.lower(F.col(name))
    likeness = T.jaccard(T.trigrams(F.lit(wanted)), T.trigrams(own))
    longest = F.greatest(F.length(own), F.lit(len(wanted)))
    rank = -(likeness * 0.6 + (1 - F.levenshtein(own, F.lit(wanted)) / longest) * 0.4)
    ranked = rows.withColumn("likeness", likeness).filter(F.col("likeness") >= threshold).withColumn("rank", rank)
    return ranked.orderBy("rank", "id").limit(limit) if limit else ranked


def matches(q: ParsedQuery, roles: bool = True) -> Column:
    """The predicate of a query's filters."""
    out = F.lit(True)
    if q.kind:
        out = out & (F.col("kind") == q.kind)
    if q.file:
        out = out & F.col("path").contains(q.file)
    if q.lang:
        out = out & (T.language_of(F.col("path")) == q.lang)
    if roles and q.role:
        out = out & (F.col("role") == q.role)
    if roles and q.exported is not None:
        out = out & (F.col("exported") == int(q.exported))
    return out


def symbol_search(rows: DataFrame, query: str, limit: int = 20, kind: str | None = None, file: str | None = None, index: TextIndex | None = None) -> DataFrame:
    """Qualified search: twice the limit of ranked rows, then the filters; fewer than three are filled up by fuzzy rows.

    Filters come after the first limit on purpose: a query can have fewer rows
    than match its filters.
    """
    q = parse_query(query)
    q.kind, q.file = kind or q.kind, file or q.file
    columns = rows.columns
    if not q.terms:
        if not q.filters:
            return rows.limit(0).withColumn("rank", F.lit(0.0))
        return rows.filter(matches(q)).orderBy("id").limit(limit).withColumn("rank", F.lit(0.0))
    exact = keyword_search(rows, " ".join(q.terms), 2 * limit, index=index).filter(matches(q)).select(*columns, F.col("rank").cast("double").alias("rank"))
    if exact.limit(3).count() >= 3:
        return exact.orderBy("rank", "id").limit(limit)
    near = fuzzy_search(rows, " ".join(q.terms), limit).filter(matches(q)).join(exact.select("id"), "id", "left_anti").select(*columns, "rank")
    both = exact.withColumn("_late", F.lit(0)).unionByName(near.withColumn("_late", F.lit(1)))
    return both.orderBy("_late", "rank", "id").limit(limit).drop("_late")


def bm25(rows: DataFrame, query: str, tokens: Column, id_col: str = "id", candidates: Column | None = None, total: int | None = None) -> DataFrame:
    """(id, score, matched) of rows with a score over 0, to three places, and the terms that they have.

    candidates: which rows are scored (else those with a candidate token); what is
    counted by term and the mean length are of those, the number of documents is of
    all rows (total, if at hand). Texts are read and cut once: what a row counts is
    written, some bytes a row, and the counts and the scores are taken from that.
    """
    terms = camel_tokens(query, T.QUERY_PUNCTUATION)
    cut = rows.withColumn("_t", tokens)
    hit = candidates if candidates is not None else has_candidate(F.col("_t"), list(dict.fromkeys(terms)))
    if not terms:
        return _scored(rows.select(F.col(id_col).alias("id"), F.lit(0).alias("size")).limit(0), [], 0)
    every = kept(cut.select(F.col(id_col).alias("id"), F.size("_t").alias("size"), hit.alias("hit"), *(_occurrences(F.col("_t"), t).alias(f"tf{k}") for k, t in enumerate(terms))))
    return _scored(every.filter("hit"), terms, every.count() if total is None else total)


def bm25_indexed(index: TextIndex, query: str) -> DataFrame:
    """What bm25 gives of the rows that a stored index holds, from the postings of the query's terms alone."""
    terms = camel_tokens(query, T.QUERY_PUNCTUATION)
    return _scored(kept(index.bm25_parts(terms)), terms, index.counts()[0])


def _scored(parts: DataFrame, terms: list[str], total: int) -> DataFrame:
    """(id, score, matched) of parts (id, size, a count for each term)."""
    counts = parts.agg(F.avg("size").alias("mean"), *(F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(terms))))
    n = F.lit(total)
    scored = parts.crossJoin(F.broadcast(counts))  # one row of counts
    score = F.lit(0.0)
    for k in range(len(terms)):
        tf, df = F.col(f"tf{k}").cast("double"), F.col(f"df{k}").cast("double")
        idf = F.ln((n - df + 0.5) / (df + 0.5) + 1)
        score = score + idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    matched = F.array_distinct(F.array_compact(F.array(*(F.when(F.col(f"tf{k}") > 0, F.lit(t)) for k, t in enumerate(terms))).cast("array<string>")))
    return scored.select("id", score.alias("score"), matched.alias("matched")).filter("score > 0").withColumn("score", T.half_up(F.col("score"), 3))


def first_neighbours(edges: DataFrame, most: int, of: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, others) of each node's first callers, and of its first callees, by edge id; of: (id) the nodes that are asked for. A node's neighbours are cut to `most` before they are sent."""
    calls = edges.filter("kind = 'calls'")

    def first(own: str, other: str) -> DataFrame:
        mine = calls.select(F.col(own).alias("id"), F.col("id").alias("e"), F.col(other).alias("o"))
        if of is not None:
            mine = mine.join(of.select("id").distinct(), "id", "left_semi")
        ranked = mine.withColumn("_k", F.row_number().over(Window.partitionBy("id").orderBy("e"))).filter(F.col("_k") <= most)
        listed = ranked.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("_k", "o"))).alias("all"))
        return listed.select("id", F.transform("all", lambda x: x["o"]).alias("others"))

    return first("target_id", "source_id"), first("source_id", "target_id")


def intent_search(nodes: DataFrame, edges: DataFrame, query: str, kind: str | None = None, index: TextIndex | None = None) -> DataFrame:
    """(id, score, matched) of symbols by BM25 over their own words and their neighbours' names.

    Candidates are widened by the first three callers and callees of each. index: a
    stored one of the symbols' own words.
    """
    terms = list(dict.fromkeys(camel_tokens(query, T.QUERY_PUNCTUATION)))
    if not terms:
        return nodes.select("id").limit(0).withColumn("score", F.lit(0.0)).withColumn("matched", F.array().cast("array<string>"))
    total = nodes.count()
    own = [c for c in ("name", "qualified_name", "signature", "doc") if c in nodes.columns]
    found = kept(index.candidates(terms) if index is not None else nodes.filter(has_candidate(document_tokens(*own), terms)).select("id"))
    wide = found
    for near in first_neighbours(edges, 3, found):
        wide = wide.union(found.join(near, "id").select(F.explode("others").alias("id")))
    wide = kept(wide.distinct())
    chosen = nodes.join(wide, "id", "left_semi")
    if kind:
        chosen = chosen.filter(F.col("kind") == kind)
    names = nodes.select(F.col("id").alias("o"), F.col("name").alias("other_name"))
    for label, near in zip(("callers", "callees"), first_neighbours(edges, 5, wide), strict=True):
        words = near.select("id", F.posexplode("others").alias("k", "o")).join(names, "o")
        words = words.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "other_name"))), lambda x: x["other_name"]), " ").alias(label))
        chosen = chosen.join(words, "id", "left")
    tokens = document_tokens(*own, "callers", "callees", punctuation=T.QUERY_PUNCTUATION)
    return bm25(chosen, query, tokens, candidates=F.lit(True), total=total)
