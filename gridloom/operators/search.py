"""Ranked search over a stored inverted index: postings (doc_id, field, term, tf, positions), document lengths, and the vocabulary."""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import segments
from .lineage import cut
from .text import gathered, gathered_again, token_counts

#: BM25's two constants.
K1, B = 1.2, 0.75
#: Folders of the postings by hash of term, and parts of a term's documents that different tasks gather.
BUCKETS, SALTS = 64, 8
#: Terms that match a pattern up to which only their folders are read; with more all postings are joined with them.
FEW = 1000


@dataclass(frozen=True)
class Index:
    postings: DataFrame
    lengths: DataFrame
    vocabulary: DataFrame


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def salt_of(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(SALTS))


def _repeated(docs: DataFrame) -> bool:
    """Whether an id has several rows."""
    return not docs.groupBy("doc_id").count().where("count > 1").isEmpty()


def dealt(lists: DataFrame) -> DataFrame:
    """Lists as a segment stores them: (bucket, field, term, n, ids, ends, positions), n entries each, by term and part of the lists, so that no task holds a common term alone, and sorted by term."""
    placed = lists.withColumns({"bucket": bucket_of(F.col("term")), "n": F.size("ids").cast("long"), "salt": salt_of(F.col("ids")[0])})
    return placed.repartition("bucket", "salt").sortWithinPartitions("bucket", "field", "term").select("bucket", "field", "term", "n", "ids", "ends", "positions")


def lists(docs: DataFrame, fields: list[str]) -> DataFrame:
    """As ``dealt``: terms are gathered where the documents are read, so what is shuffled, sorted and stored has a row for each term and piece of the documents, not for each token or posting.
    Only where an id has several rows are these put together after that."""
    found = gathered(docs, fields)
    if _repeated(docs):
        one = segments.rows_of(found).groupBy("field", "term", "doc_id").agg(F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))
        found = gathered_again(one.sortWithinPartitions("field", "term"))
    return dealt(found)


def index(docs: DataFrame, fields: list[str]) -> DataFrame:
    """(bucket, field, term, doc_id, tf, positions): the entries of ``lists``."""
    return segments.rows_of(lists(docs, fields))


def lengths(docs: DataFrame, fields: list[str]) -> DataFrame:
    """(doc_id, field, len) of documents with a token."""
    return token_counts(docs, fields).groupBy("doc_id", "field").agg(F.sum("len").alias("len"))


def build(docs: DataFrame, fields: list[str], path: str, mode: str = "overwrite") -> None:
    """Stores an index; with mode "append" it adds documents to one, as a segment of their own. A term is found in one folder of each segment, in sorted files."""
    segments.add(docs, fields, path, fresh=mode != "append")


def read(spark: SparkSession, path: str) -> Index:
    """The index as it is now: what is added, deleted or merged later is not seen."""
    return Index(*segments.tables(spark, path))


@dataclass(frozen=True)
class Clause:
    """One part of a query: a term, phrase, prefix pattern or fuzzy term, in a field, with a weight and a sign."""

    text: str
    field: str | None = None
    sign: str = ""
    kind: str = "term"
    boost: float = 1.0
    edits: int = 0


_CLAUSE = re.compile(r'([+-]?)(?:(\w+):)?(?:"([^"]*)"|([^\s"^~]+))(?:~(\d*))?(?:\^([0-9.]+))?')


def parse(query: str) -> list[Clause]:
    """``+must -not field:term "a phrase" wild* fuzzy~1 boost^2``; clauses are alternatives unless signed."""
    out = []
    for sign, name, phrase, word, fuzz, boost in (m.groups() for m in _CLAUSE.finditer(query)):
        kind = "phrase" if phrase is not None else "wild" if "*" in word or "?" in word else "fuzzy" if fuzz is not None else "term"
        out.append(Clause((phrase if phrase is not None else word).lower(), name, sign, kind, float(boost or 1), int(fuzz or 1) if kind == "fuzzy" else 0))
    return out


def _matches(clause: Clause, term: Column) -> Column:
    if clause.kind == "wild":
        return term.rlike("^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in clause.text) + "$")
    if clause.kind == "fuzzy":
        return F.levenshtein(term, F.lit(clause.text), clause.edits) >= 0
    return term == clause.text


def _postings(stored: Index, term: str, field: str) -> DataFrame:
    """Of one term, from its folder alone."""
    here = stored.postings.sparkSession.range(1).select(bucket_of(F.lit(term))).first()[0]
    return stored.postings.where((F.col("bucket") == here) & (F.col("field") == field) & (F.col("term") == term))


def _hits(stored: Index, clause: Clause, field: str) -> DataFrame:
    """(doc_id, tf, df) of a clause, a row for each term and document."""
    field = clause.field or field
    if clause.kind == "term":
        df = stored.vocabulary.where((F.col("field") == field) & (F.col("term") == clause.text)).select("term", "df")
        return _postings(stored, clause.text, field).join(F.broadcast(df), "term").select("doc_id", "tf", "df")  # one row
    if clause.kind != "phrase":
        # Patterns are matched with the vocabulary, not with all postings.
        terms = stored.vocabulary.where((F.col("field") == field) & _matches(clause, F.col("term"))).select("term", "df", bucket_of(F.col("term")).alias("bucket"))
        terms = cut(terms)  # so that a join knows how few they are; the vocabulary may be large
        few, here = terms.limit(FEW + 1).collect(), stored.postings.where(F.col("field") == field)
        if len(few) <= FEW:
            here, terms = here.where(F.col("bucket").isin({r["bucket"] for r in few}) & F.col("term").isin([r["term"] for r in few])), F.broadcast(terms)
        return here.join(terms, ["bucket", "term"]).select("doc_id", "tf", "df")
    words = re.findall(r"[a-z0-9_\-]+", clause.text)
    rows = [_postings(stored, w, field).select("doc_id", F.expr(f"transform(positions, p -> p - {k})").alias(f"p{k}")) for k, w in enumerate(words)]
    found = functools.reduce(lambda a, b: a.join(b, "doc_id"), rows)
    at = functools.reduce(F.array_intersect, [F.col(f"p{k}") for k in range(len(words))])
    hits = found.select("doc_id", F.size(at).cast("long").alias("tf")).where("tf > 0")
    return hits.crossJoin(F.broadcast(hits.agg(F.count("*").alias("df"))))  # one row


def search(stored: Index, query: str, field: str, limit: int | None = 10) -> DataFrame:
    """(doc_id, score) by BM25, best first, ties by doc_id."""
    sizes = stored.lengths.where(F.col("field") == field).select("doc_id", "len")
    stats = sizes.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    scored, must, never = None, [], None
    for clause in parse(query):
        hits = _hits(stored, clause, field)
        if clause.sign == "-":
            never = hits.select("doc_id") if never is None else never.union(hits.select("doc_id"))
            continue
        if clause.sign == "+":
            must.append(hits.select("doc_id").distinct())
        one = hits.withColumn("boost", F.lit(clause.boost))
        scored = one if scored is None else scored.union(one)
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    each = scored.join(sizes, "doc_id").crossJoin(F.broadcast(stats))
    each = each.select("doc_id", (F.col("boost") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))).alias("s"))
    out = each.groupBy("doc_id").agg(F.sum("s").alias("score"))
    for docs in must:
        out = out.join(docs, "doc_id", "left_semi")
    if never is not None:
        out = out.join(never.distinct(), "doc_id", "left_anti")
    ranked = out.orderBy(F.desc(F.round("score", 9)), "doc_id")
    return ranked.limit(limit) if limit is not None else ranked


def exact(docs: DataFrame, field: str, value: str) -> DataFrame:
    """Documents whose whole field is the value."""
    return docs.where(F.col(field) == value)


def first_exact(docs: DataFrame, field: str, value: str) -> DataFrame:
    return exact(docs, field, value).orderBy("doc_id").limit(1)


def field_values(docs: DataFrame, field: str) -> DataFrame:
    return docs.select(field).where(F.col(field).isNotNull()).distinct()


def field_map(docs: DataFrame, key: str, value: str) -> DataFrame:
    return docs.groupBy(key).agg(F.min(value).alias(value))


def highlighted(text: Column, term: str, around: int = 20) -> Column:
    """The first fragment with a term, the term between double asterisks."""
    found = F.regexp_extract(text, rf"(?i)(?s).{{0,{around}}}\b{re.escape(term)}\b.{{0,{around}}}", 0)
    return F.regexp_replace(found, rf"(?i)\b({re.escape(term)})\b", "**$1**")


def listing(docs: DataFrame, by: str, block: int = 10) -> DataFrame:
    """Names in order, ten to a block."""
    from .lineage import numbered

    return numbered(docs.select(by).distinct(), "rank", F.col(by)).withColumn("block", F.floor(F.col("rank") / block))


def rebuild_if_broken(read, rebuild) -> DataFrame:
    """What read() gives; if the index is missing or broken, it is built anew and read once more."""
    from pyspark.errors import PySparkException

    try:
        df = read()
        df.count()  # opens every file
        return df
    except (PySparkException, FileNotFoundError):
        rebuild()
        return read()
