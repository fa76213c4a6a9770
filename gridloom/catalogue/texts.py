"""Text and search over the documents table."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import functions as F

from ..operators import search, segments, text
from ..operators.lineage import shared_folder
from . import query, table

TOKENS = r"""
WITH toks AS (
  SELECT doc_id, pos, term FROM (
    SELECT doc_id, unnest(list) AS term, generate_subscripts(list, 1) - 1 AS pos FROM (
      SELECT doc_id, list_filter(string_split(lower(regexp_replace(coalesce(text, ''), '[^a-zA-Z0-9_\-]+', ' ', 'g')), ' '), lambda x: x <> '') AS list FROM documents)))"""
BAG = TOKENS + ", bag AS (SELECT doc_id, term, count(*) AS cnt FROM toks GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM bag GROUP BY term)"


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def toks(spark, sf_dir):
    return text.tokens(docs(spark, sf_dir).select("doc_id", "text"))


def bag(spark, sf_dir):
    return text.bag_of_words(toks(spark, sf_dir))


@query("text_tokens", TOKENS + " SELECT doc_id, count(*) AS n, count(DISTINCT term) AS distinct_n, md5(string_agg(term, ' ' ORDER BY pos)) AS digest FROM toks GROUP BY doc_id")
def text_tokens(spark, sf_dir):
    t = docs(spark, sf_dir).select("doc_id", text.tokens_of(F.col("text")).alias("t")).where(F.size("t") > 0)
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("distinct_n"), F.md5(F.array_join("t", " ")).alias("digest"))


@query("text_vocab", TOKENS + " SELECT term, row_number() OVER (ORDER BY f) - 1 AS term_id FROM (SELECT term, min((doc_id, pos)) AS f FROM toks GROUP BY term)")
def text_vocab(spark, sf_dir):
    return text.vocabulary(toks(spark, sf_dir))


@query("text_bow", BAG + " SELECT doc_id, term, cnt FROM bag")
def text_bow(spark, sf_dir):
    return bag(spark, sf_dir)


@query("text_df", BAG + " SELECT term, df FROM df")
def text_df(spark, sf_dir):
    return text.document_frequency(bag(spark, sf_dir))


@query("text_prune", BAG + " SELECT doc_id, term, cnt FROM bag JOIN df USING (term) WHERE df > 5")
def text_prune(spark, sf_dir):
    return text.pruned(bag(spark, sf_dir), 5).select("doc_id", "term", "cnt")


@query("text_stopwords", TOKENS + " SELECT doc_id, count(*) AS n FROM toks WHERE term NOT IN ('the', 'of', 'and', 'de') GROUP BY doc_id")
def text_stopwords(spark, sf_dir):
    stop = spark.createDataFrame([("the",), ("of",), ("and",), ("de",)], "term string")
    return text.without_stopwords(toks(spark, sf_dir), stop).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("text_stream", TOKENS + " SELECT term, count(*) AS n FROM toks GROUP BY term")
def text_stream(spark, sf_dir):
    return text.stream_of(bag(spark, sf_dir)).groupBy("term").agg(F.count("*").alias("n"))


@query("text_split", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 < CAST(floor(count(*) OVER () * 0.8) AS BIGINT) AS is_train FROM documents")
def text_split(spark, sf_dir):
    return text.split(docs(spark, sf_dir).select("doc_id"), 0.8)


@query("text_props", BAG + ", l AS (SELECT doc_id, sum(cnt) AS len, count(*) AS nnz FROM bag GROUP BY doc_id) SELECT CAST(sum(nnz) AS BIGINT) AS nnz, count(*) AS n_docs, round_even(avg(len), 6) AS mean_len, round_even(var_pop(len), 2) AS var_len, (SELECT count(*) FROM df) AS n_terms FROM l")
def text_props(spark, sf_dir):
    return text.properties(bag(spark, sf_dir)).select("nnz", "n_docs", F.bround("mean_len", 6).alias("mean_len"), F.bround("var_len", 2).alias("var_len"), "n_terms")


@query("text_sample", BAG + ", k AS (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100) SELECT doc_id, term, cnt FROM bag SEMI JOIN k USING (doc_id) ANTI JOIN (SELECT DISTINCT doc_id FROM bag WHERE cnt >= 6000) USING (doc_id)")
def text_sample(spark, sf_dir):
    """Sampling the first hundred documents is the operator itself."""
    return text.sample(bag(spark, sf_dir), 100, docs(spark, sf_dir)).select("doc_id", "term", "cnt")


LENGTHS = ", len AS (SELECT doc_id, sum(cnt) AS len FROM bag GROUP BY doc_id), st AS (SELECT count(*) AS n, avg(len) AS al FROM len)"


def _bm25(hits: str) -> str:
    return f"""
SELECT doc_id, round_even(sum(b * ln(1 + (n - df + 0.5) / (df + 0.5)) * cnt * 2.2 / (cnt + 1.2 * (0.25 + 0.75 * len / al))), 6) AS score
FROM (SELECT *, count(*) OVER (PARTITION BY term, b) AS df FROM ({hits})) JOIN len USING (doc_id), st GROUP BY doc_id"""


def stored(spark, sf_dir) -> search.Index:
    """The index of the documents, built when it is first asked for: stored under a name made of the table's files, their sizes and times."""
    jvm, found = spark.sparkContext._jvm, docs(spark, sf_dir)
    files = []
    for name in sorted(found.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(name)
        state = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
        files.append(f"{name} {state.getLen()} {state.getModificationTime()}")
    path = f"{shared_folder(spark)}/index-{hashlib.md5(chr(10).join(files).encode()).hexdigest()}"
    if segments.manifest(spark, path) is None:
        search.build(found.select("doc_id", "text"), ["text"], path)
    return search.read(spark, path)


def _found(spark, sf_dir, q):
    return search.search(stored(spark, sf_dir), q, "text", None).select("doc_id", F.bround("score", 6).alias("score"))


for _name, _query, _hits in (
    ("search_bm25", "idiot moron^2", "SELECT doc_id, term, cnt, CASE term WHEN 'moron' THEN 2.0 ELSE 1.0 END AS b FROM bag WHERE term IN ('idiot', 'moron')"),
    ("search_wildcard", "stup* clow?", "SELECT doc_id, term, cnt, 1.0 AS b FROM bag WHERE regexp_full_match(term, 'stup.*') UNION ALL SELECT doc_id, term, cnt, 1.0 FROM bag WHERE regexp_full_match(term, 'clow.')"),
    ("search_fuzzy", "idiet~1", "SELECT doc_id, term, cnt, 1.0 AS b FROM bag WHERE levenshtein(term, 'idiet') <= 1"),
):
    query(_name, BAG + LENGTHS + _bm25(_hits))(lambda spark, sf_dir, q=_query: _found(spark, sf_dir, q))


@query("search_bool", BAG + " SELECT DISTINCT doc_id FROM bag WHERE term = 'idiot' AND doc_id IN (SELECT doc_id FROM bag WHERE term = 'the') AND doc_id NOT IN (SELECT doc_id FROM bag WHERE term = 'moron')")
def search_bool(spark, sf_dir):
    return _found(spark, sf_dir, "+idiot +the -moron").select("doc_id")


@query("search_phrase", TOKENS + " SELECT DISTINCT a.doc_id FROM toks a JOIN toks b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 JOIN toks c ON a.doc_id = c.doc_id AND c.pos = a.pos + 2 WHERE a.term = 'of' AND b.term = 'the' AND c.term = 'and' ")
def search_phrase(spark, sf_dir):
    return _found(spark, sf_dir, '"of the and"').select("doc_id")


@query("search_topk", BAG + LENGTHS + ", s AS (" + _bm25("SELECT doc_id, term, cnt, 1.0 AS b FROM bag WHERE term = 'idiot'") + ") SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT 10")
def search_topk(spark, sf_dir):
    return search.search(stored(spark, sf_dir), "idiot", "text", 10).select("doc_id", F.bround("score", 6).alias("score"))


@query("search_exact", "SELECT p_partkey, p_name FROM part WHERE p_type = (SELECT min(p_type) FROM part)")
def search_exact(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return search.exact(part, "p_type", part.agg(F.min("p_type")).first()[0]).select("p_partkey", "p_name")


@query("search_first", "SELECT p_partkey AS doc_id, p_type FROM part WHERE p_brand = 'Brand#11' ORDER BY p_partkey LIMIT 1")
def search_first(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "doc_id")
    return search.first_exact(part, "p_brand", "Brand#11").select("doc_id", "p_type")


@query("search_field_values", "SELECT DISTINCT source FROM documents")
def search_field_values(spark, sf_dir):
    return search.field_values(docs(spark, sf_dir), "source")


@query("search_field_map", "SELECT source, min(lang) AS lang FROM documents GROUP BY source")
def search_field_map(spark, sf_dir):
    return search.field_map(docs(spark, sf_dir), "source", "lang")


@query("search_listing", "SELECT p_name, r AS rank, CAST(r // 10 AS BIGINT) AS block FROM (SELECT p_name, row_number() OVER (ORDER BY p_name) - 1 AS r FROM (SELECT DISTINCT p_name FROM part))")
def search_listing(spark, sf_dir):
    return search.listing(table(spark, sf_dir, "part"), "p_name").select("p_name", "rank", "block")


@query("search_highlight", r"SELECT doc_id, regexp_replace(f, '(?i)\b(idiot)\b', '**\1**', 'g') AS fragment FROM (SELECT doc_id, regexp_extract(text, '(?is).{0,20}\bidiot\b.{0,20}', 0) AS f FROM documents) WHERE f <> ''")
def search_highlight(spark, sf_dir):
    found = docs(spark, sf_dir).select("doc_id", search.highlighted(F.col("text"), "idiot").alias("fragment"))
    return found.where("fragment <> ''")


MARKED = r"list_filter(regexp_split_to_array(regexp_replace(coalesce(text, ''), '[.,;:!?(){}\[\]''\"`]+', ' ', 'g'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '')"


@query("text_marked", f"SELECT doc_id, len(w) AS n, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, {MARKED} AS w FROM documents) WHERE len(w) > 0")
def text_marked(spark, sf_dir):
    w = docs(spark, sf_dir).select("doc_id", text.marked_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    return w.select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", " ")).alias("digest"))


VOCAB = BAG + ", vocab AS (SELECT term, row_number() OVER (ORDER BY f) - 1 AS term_id FROM (SELECT term, min((doc_id, pos)) AS f FROM toks GROUP BY term))"


@query("text_ids", VOCAB + " SELECT doc_id, CAST(sum(term_id * cnt) AS BIGINT) AS id_sum, CAST(sum(cnt) AS BIGINT) AS n FROM bag JOIN vocab USING (term) GROUP BY doc_id")
def text_ids(spark, sf_dir):
    """To ids, back to terms, and to ids again: lists of documents by term, which become rows at the end."""
    gathered = text.gathered(docs(spark, sf_dir).select("doc_id", "text"), ["text"])
    vocab = text.vocabulary(text.first_places(gathered))
    lists = gathered.select("term", "ids", F.transform("ends", lambda e, k: (e - text.begin_of(k)).cast("long")).alias("counts"))
    again = text.ids_of(text.terms_of(text.ids_of(lists, vocab), vocab), vocab)
    rows = again.select("term_id", F.inline(F.arrays_zip(F.col("ids").alias("doc_id"), F.col("counts").alias("cnt"))))
    return rows.groupBy("doc_id").agg(F.sum(F.col("term_id") * F.col("cnt")).alias("id_sum"), F.sum("cnt").alias("n"))


@query("text_prune_ids", VOCAB + " SELECT term, row_number() OVER (ORDER BY term_id) - 1 AS term_id FROM vocab JOIN df USING (term) WHERE df > 5")
def text_prune_ids(spark, sf_dir):
    t = toks(spark, sf_dir)
    return text.pruned_vocabulary(text.bag_of_words(t), text.vocabulary(t), 5)


@query("text_recovered", TOKENS + " SELECT doc_id, count(*) FILTER (term IN ('ha', 'has')) AS has, count(*) FILTER (term IN ('wa', 'was')) AS was FROM toks GROUP BY doc_id")
def text_recovered(spark, sf_dir):
    return text.lemmas(toks(spark, sf_dir)).groupBy("doc_id").agg(F.count_if(F.col("term") == "has").alias("has"), F.count_if(F.col("term") == "was").alias("was"))


@query("text_shuffled", "SELECT doc_id, row_number() OVER (ORDER BY md5('0|' || doc_id), doc_id) - 1 AS place FROM documents")
def text_shuffled(spark, sf_dir):
    return text.loaded_corpus(docs(spark, sf_dir).select("doc_id"), "all", shuffle=True)


@query("search_appended", BAG + LENGTHS + _bm25("SELECT doc_id, term, cnt, 1.0 AS b FROM bag WHERE term IN ('idiot', 'moron')"))
def search_appended(spark, sf_dir):
    """An index of the even documents to which the odd ones are added."""
    path, d = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", docs(spark, sf_dir).select("doc_id", "text")
    search.build(d.where("doc_id % 2 = 0"), ["text"], path)
    search.build(d.where("doc_id % 2 <> 0"), ["text"], path, mode="append")
    return search.search(search.read(spark, path), "idiot moron", "text", None).select("doc_id", F.bround("score", 6).alias("score"))


@query("search_deleted", BAG.replace("FROM toks", "FROM toks WHERE doc_id % 7 <> 3") + LENGTHS + _bm25("SELECT doc_id, term, cnt, 1.0 AS b FROM bag WHERE term IN ('idiot', 'moron')"))
def search_deleted(spark, sf_dir):
    """Nine additions, every seventh document deleted in between or after, merged where due."""
    path, d = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", docs(spark, sf_dir).select("doc_id", "text")
    gone = d.where("doc_id % 7 = 3").select("doc_id")
    for k in range(9):
        segments.add(d.where(F.pmod("doc_id", F.lit(9)) == k), ["text"], path)
        if k == 4:
            segments.delete(gone, path)
    segments.delete(gone, path)
    segments.merge(spark, path)
    return search.search(search.read(spark, path), "idiot moron", "text", None).select("doc_id", F.bround("score", 6).alias("score"))


#: The twenty newsgroups in order: fixed values.
GROUPS = "alt.atheism comp.graphics comp.os.ms-windows.misc comp.sys.ibm.pc.hardware comp.sys.mac.hardware comp.windows.x misc.forsale rec.autos rec.motorcycles rec.sport.baseball rec.sport.hockey sci.crypt sci.electronics sci.med sci.space soc.religion.christian talk.politics.guns talk.politics.mideast talk.politics.misc talk.religion.misc".split()


@query("text_newsgroups", "SELECT name, ['soc', 'comp', 'comp', 'comp', 'comp', 'comp', 'misc', 'rec', 'rec', 'rec', 'rec', 'sci', 'sci', 'sci', 'sci', 'soc', 'talk', 'talk', 'talk', 'soc'][i] AS label FROM (SELECT unnest([" + ", ".join(f"'{g}'" for g in GROUPS) + "]) AS name, unnest(range(1, 21)) AS i)")
def text_newsgroups(spark, sf_dir):
    names = spark.range(1).select(F.explode(F.array(*[F.lit(g) for g in GROUPS])).alias("name"))
    return names.select("name", text.newsgroup_group(F.col("name")).alias("label"))
