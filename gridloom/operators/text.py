"""Text: tokens, vocabularies, bags of words, pruning and samples, all in long form (doc_id, term, cnt)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut, numbered

#: What a token is made of, and the count from which a document is left out of a sample.
NOT_TOKEN, MOST_COUNT = r"[^a-zA-Z0-9_\-]+", 6000
#: Bytes of text whose terms are gathered at a time; a longer text is a piece of its own.
PIECE = 16 << 20
#: Entries of a list at most; a longer one becomes several, so that a reader's batch of lists is bounded too.
ENTRIES = 512


def tokens_of(text: Column) -> Column:
    """ASCII tokens in lower case, in order."""
    return F.array_remove(F.split(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), NOT_TOKEN, " ")), " "), "")


def tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, term)."""
    return docs.select("doc_id", F.posexplode(tokens_of(F.col("text"))).alias("pos", "term"))


def token_counts(docs: DataFrame, fields: list[str]) -> DataFrame:
    """(doc_id, field, len): how many tokens ``tokens_of`` gives, for each row of docs and field that has one."""
    return _texts(docs, fields).mapInArrow(_by_piece(fields, _counted(), PIECE), f"doc_id {dict(docs.dtypes)['doc_id']}, field string, len long")


def gathered(docs: DataFrame, fields: list[str]) -> DataFrame:
    """(field, term, ids, ends, positions): of each piece of the documents a row for each term and ``ENTRIES`` entries, an entry for each row of docs that has it; made where the text is read, without a shuffle.

    Entry k is of document ids[k], and its positions are those from ends[k - 1] (0 for the first) to ends[k], without the latter.
    """
    return _texts(docs, fields).mapInArrow(_by_piece(fields, _listed(ENTRIES), PIECE), _lists_of(dict(docs.dtypes)["doc_id"]))


def _lists_of(kind: str) -> str:
    return f"field string, term string, ids array<{kind}>, ends array<int>, positions array<int>"


def begin_of(k: Column) -> Column:
    """Where the positions of a list's entry k begin."""
    return F.coalesce(F.get("ends", k - 1), F.lit(0))


def gathered_again(rows: DataFrame) -> DataFrame:
    """Lists of rows (field, term, doc_id, positions), without a shuffle: as long as a batch of rows allows, so the rows of a term should follow each other."""
    most = ENTRIES

    def each(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            fields, terms = (batch[c].dictionary_encode() for c in ("field", "term"))
            code = fields.indices.to_numpy().astype(np.int64) * len(terms.dictionary) + terms.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            batch, code = batch.take(pa.array(order)), code[order]
            heads = _heads(np.concatenate([[True], code[1:] != code[:-1]]), most)
            at = pa.array(heads)
            yield _packed(batch["field"].take(at), batch["term"].take(at), heads, batch["doc_id"], batch["positions"].value_lengths().to_numpy(), batch["positions"].flatten())

    return rows.select("field", "term", "doc_id", "positions").mapInArrow(each, _lists_of(dict(rows.dtypes)["doc_id"]))


def without(lists: DataFrame, gone: DataFrame) -> DataFrame:
    """Lists without the entries of documents (doc_id) that are gone, few enough for the memory of each task."""
    spark, kind = lists.sparkSession, lists.schema["ids"].dataType.elementType.simpleString()
    held = spark.sparkContext.broadcast(gone.where("doc_id is not null").select(F.col("doc_id").cast(kind)).toArrow()["doc_id"].combine_chunks())

    def each(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            ids, ends = batch["ids"].flatten(), batch["ends"].flatten().to_numpy()
            if not len(ids):
                continue
            kept = ~pc.is_in(ids, value_set=held.value).to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(batch.num_rows), batch["ids"].value_lengths().to_numpy())
            sizes = np.diff(ends, prepend=np.int32(0))
            first = np.concatenate([[True], owner[1:] != owner[:-1]])
            sizes[first] = ends[first]
            places = batch["positions"].flatten().filter(pa.array(np.repeat(kept, sizes)))
            owner = owner[kept]
            if len(owner):
                heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                at = pa.array(owner[heads])
                yield _packed(batch["field"].take(at), batch["term"].take(at), heads, ids.filter(pa.array(kept)), sizes[kept], places)

    return lists.select("field", "term", "ids", "ends", "positions").mapInArrow(each, _lists_of(kind))


def _heads(new, most: int):
    """Where lists begin: at each new term, and after as many entries as a list has at most."""
    import numpy as np

    begins = np.flatnonzero(new)
    before = np.repeat(begins, np.diff(np.append(begins, len(new))))
    return np.flatnonzero((np.arange(len(new)) - before) % most == 0)


def _packed(fields, terms, heads, ids, sizes, positions):
    """Lists that begin at these entries, of ids, numbers of positions and positions of all entries."""
    import numpy as np
    import pyarrow as pa

    to, total = np.append(heads, len(ids)), np.concatenate([[0], np.cumsum(sizes)])
    ends = total[1:] - np.repeat(total[heads], np.diff(to))
    offsets, places = pa.array(to, pa.int32()), pa.array(total[to], pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, ids), pa.ListArray.from_arrays(offsets, pa.array(ends, pa.int32())), pa.ListArray.from_arrays(places, positions)]
    return pa.RecordBatch.from_arrays([fields, terms, *lists], ["field", "term", "ids", "ends", "positions"])


def first_places(lists: DataFrame) -> DataFrame:
    """(term, doc_id, pos) of the first entry of each row of ``gathered``: all that a vocabulary needs of the tokens."""
    first = F.array_min(F.transform("ids", lambda d, k: F.struct(d.alias("doc_id"), F.get("positions", begin_of(k)).alias("pos"))))
    return lists.select("term", first.alias("first")).select("term", "first.doc_id", "first.pos")


def _texts(docs: DataFrame, fields: list[str]) -> DataFrame:
    return docs.select("doc_id", *[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f"f{k}") for k, f in enumerate(fields)])


def _by_piece(fields: list[str], rows, piece: int):
    """rows(ids, bounds of texts, starts of tokens, their ends, bytes in lower case, which are of tokens, field) gives a record batch for each piece with a token."""

    def each(batches):
        import numpy as np
        import pyarrow as pa

        lower = np.full(256, 32, np.uint8)  # by byte: tokens are ASCII, and no byte of another character is
        for c in b"abcdefghijklmnopqrstuvwxyz0123456789_-":
            lower[[c, ord(chr(c).upper())]] = c
        for batch in batches:
            for k, field in enumerate(fields if batch.num_rows else []):
                texts = batch[f"f{k}"].cast(pa.large_string())
                all_at, data = (np.frombuffer(b or b"", kind) for b, kind in zip(texts.buffers()[1:], (np.int64, np.uint8), strict=True))
                all_at, begin = all_at[texts.offset : texts.offset + len(texts) + 1], 0
                while begin < len(texts):
                    end = max(begin + 1, int(np.searchsorted(all_at, all_at[begin] + piece, "right")) - 1)
                    at = all_at[begin : end + 1] - all_at[begin]
                    chars = lower[data[all_at[begin] : all_at[end]]]
                    kept = chars != 32
                    first, last = kept.copy(), kept.copy()
                    first[1:] &= ~kept[:-1]
                    last[:-1] &= ~kept[1:]
                    border = at[(at > 0) & (at < len(chars))]  # a token ends with its text
                    first[border], last[border - 1] = kept[border], kept[border - 1]
                    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
                    if len(starts):
                        yield rows(batch["doc_id"].slice(begin, end - begin), at, starts, ends, chars[kept], field)
                    begin = end

    return each


def _counted():
    def counted(ids, at, starts, ends, chars, field):
        import numpy as np
        import pyarrow as pa

        n = np.diff(np.searchsorted(starts, at))
        some = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(some)), pa.repeat(field, len(some)), pa.array(n[some])], ["doc_id", "field", "len"])

    return counted


def _listed(most: int):
    def listed(ids, at, starts, ends, chars, field):
        import numpy as np
        import pyarrow as pa

        bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        tokens = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(chars)).dictionary_encode()
        before = np.searchsorted(starts, at)
        doc = np.repeat(np.arange(len(ids)), np.diff(before))
        code = tokens.indices.to_numpy()
        order = np.argsort(code.astype(np.uint16) if len(tokens.dictionary) <= 1 << 16 else code, kind="stable")  # documents and positions rise in each term
        code, doc = code[order], doc[order]
        places = (order - before[doc]).astype(np.int32)
        new_term = np.concatenate([[True], code[1:] != code[:-1]])
        begins = np.flatnonzero(new_term | np.concatenate([[True], doc[1:] != doc[:-1]]))
        heads = _heads(new_term[begins], most)
        return _packed(pa.repeat(field, len(heads)), tokens.dictionary.take(pa.array(code[begins[heads]])), heads, ids.take(pa.array(doc[begins])), np.diff(np.append(begins, len(order))), pa.array(places))

    return listed


def without_stopwords(toks: DataFrame, stop: DataFrame) -> DataFrame:
    return toks.join(stop.select("term").distinct(), "term", "left_anti")


def vocabulary(toks: DataFrame) -> DataFrame:
    """(term, term_id): ids from 0 in the order of first appearance."""
    if dict(toks.dtypes)["doc_id"] in ("bigint", "int", "smallint", "tinyint"):
        # One number in the order of both: it is aggregated by hash, where a struct would have all tokens sorted.
        place = F.col("doc_id").cast("decimal(19,0)") * F.lit(2**31).cast("decimal(10,0)") + F.col("pos").cast("decimal(10,0)")
        return numbered(toks.groupBy("term").agg(F.min(place).alias("first")), "term_id", F.col("first")).select("term", "term_id")
    first = toks.groupBy("term").agg(F.min(F.struct("doc_id", "pos")).alias("first"))
    return numbered(first, "term_id", F.col("first.doc_id"), F.col("first.pos")).select("term", "term_id")


def bag_of_words(toks: DataFrame) -> DataFrame:
    return toks.groupBy("doc_id", "term").agg(F.count("*").alias("cnt"))


def document_frequency(bag: DataFrame) -> DataFrame:
    return bag.groupBy("term").agg(F.count("*").alias("df"))


def pruned(bag: DataFrame, least: int) -> DataFrame:
    """Rows of terms in more than ``least`` documents. The bag is made once and written, since it is read twice."""
    bag = cut(bag)
    return bag.join(document_frequency(bag).where(F.col("df") > least).select("term"), "term", "left_semi")


def stream_of(bag: DataFrame) -> DataFrame:
    """Each term as often as it counts."""
    return bag.select("doc_id", F.explode(F.array_repeat("term", F.col("cnt").cast("int"))).alias("term"))


def split(docs: DataFrame, ratio: float) -> DataFrame:
    """``is_train`` for the first int(n * ratio) documents by id."""
    ranked = numbered(docs, "rank", F.col("doc_id"))
    return ranked.withColumn("is_train", F.col("rank") < int(docs.count() * ratio)).drop("rank")


def sample(bag: DataFrame, first: int, ids: DataFrame) -> DataFrame:
    """The first documents by id, without those that have a term ``MOST_COUNT`` times or more."""
    kept = ids.select("doc_id").orderBy("doc_id").limit(first)
    part = bag.join(F.broadcast(kept), "doc_id", "left_semi") if first <= 10_000 else bag.join(kept, "doc_id", "left_semi")
    return part.join(part.where(F.col("cnt") >= MOST_COUNT).select("doc_id").distinct(), "doc_id", "left_anti")


def properties(bag: DataFrame) -> DataFrame:
    """One row: non-zeros, documents, terms, mean and variance of document lengths."""
    lengths = bag.groupBy("doc_id").agg(F.sum("cnt").alias("len"), F.count("*").alias("nnz"))
    return lengths.agg(F.sum("nnz").alias("nnz"), F.count("*").alias("n_docs"), F.avg("len").alias("mean_len"), F.var_pop("len").alias("var_len")).crossJoin(bag.agg(F.countDistinct("term").alias("n_terms")))


#: Six groups of the twenty newsgroups, by the first part of their names, and the one that goes elsewhere: fixed values.
NEWSGROUPS = {"comp": "comp", "misc": "misc", "rec": "rec", "sci": "sci", "talk": "talk", "soc": "soc", "alt": "soc"}
ELSEWHERE = {"talk.religion.misc": "soc"}


def newsgroup_group(name: Column) -> Column:
    table = lambda pairs: F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    return F.coalesce(F.element_at(table(ELSEWHERE), name), F.element_at(table(NEWSGROUPS), F.element_at(F.split(name, r"\."), 1)))


def assign_topics(confusion: list[list[int]]) -> list[int]:
    """A class for each row of a square confusion matrix, row by row. K x K numbers, on the driver.

    The first row not yet done asks for its largest free class; where a later row has more of that class, the two rows change places and it is that row's turn. The last
    row keeps the class of its number, as in the rule this follows. The answer is by the rows' old numbers.
    """
    cells, k = [list(row) for row in confusion], len(confusion)
    rows, taken = list(range(k)), [i for i in range(k)]
    now = 0
    while now < k - 1:
        free = [c for c in range(k) if c not in taken[:now]]
        c = max(free, key=lambda c: (cells[now][c], -c))
        best = max(range(now, k), key=lambda r: (cells[r][c], -r))
        if cells[best][c] > cells[now][c]:
            for x in (cells, rows):
                x[now], x[best] = x[best], x[now]
            taken[now], taken[best] = taken[best], taken[now]
        else:
            taken[now] = c
            now += 1
    return [c for _, c in sorted(zip(rows, taken, strict=True))]


#: Marks at which a text is split for its bag of words, and words that a lemmatiser spoils.
MARKS, RECOVERED = r"[.,;:!?(){}\[\]'\"`]+", {"wa": "was", "ha": "has"}


def marked_words(text: Column) -> Column:
    """Words between white space and punctuation marks, as they are written."""
    return F.filter(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), MARKS, " "), r"[ \t\n\x0B\f\r]+"), lambda x: x != "")


def lemmas(toks: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """Tokens with their lemma of a table (term, lemma), where it has one; spoiled words are recovered."""
    if table is not None:
        toks = toks.join(table, "term", "left").withColumn("term", F.coalesce("lemma", "term")).drop("lemma")
    fixed = F.create_map(*[F.lit(x) for pair in RECOVERED.items() for x in pair])
    return toks.withColumn("term", F.coalesce(F.element_at(fixed, F.col("term")), F.col("term")))


def ids_of(rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """Terms replaced by their ids; terms without one go. Only the vocabulary is held, by hash: rows are not sorted."""
    return rows.join(vocab.select("term", "term_id").hint("shuffle_hash"), "term").drop("term")


def terms_of(rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """Ids replaced by their terms."""
    return rows.join(vocab.select("term", "term_id").hint("shuffle_hash"), "term_id").drop("term_id")


def pruned_vocabulary(bag: DataFrame, vocab: DataFrame, least: int) -> DataFrame:
    """(term, term_id) of terms in more than ``least`` documents, numbered anew in the old order."""
    kept = vocab.join(document_frequency(bag).where(F.col("df") > least).select("term"), "term", "left_semi")
    return numbered(kept.withColumnRenamed("term_id", "old"), "term_id", F.col("old")).select("term", "term_id")


def loaded_corpus(docs: DataFrame, n: int | str | None = None, shuffle: bool = False, seed: int = 0) -> DataFrame:
    """The first n documents of a corpus ("all" or None for every one), with ``place``: by id, or by an md5 draw if shuffled. Asking for more than there are is an error."""
    if n is not None and str(n).isdigit() and int(n) > docs.count():
        raise ValueError(f"the corpus has fewer than {n} documents")
    order = [F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string")))] if shuffle else []
    placed = numbered(docs.withColumn("draw", order[0]) if shuffle else docs, "place", *([F.col("draw")] if shuffle else []), F.col("doc_id"))
    placed = placed.drop("draw")
    return placed.where(F.col("place") < int(n)) if n is not None and str(n).isdigit() else placed


def topics(bag: DataFrame, vocab: DataFrame, k: int, rounds: int = 10, seed: int = 0):
    """A topic model (LDA) of a bag of words: the fitted model, and (doc_id, features) it was fitted on."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.functions import array_to_vector

    n = vocab.count()
    counts = ids_of(bag, vocab).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term_id", "cnt"))).alias("m"))
    rows = counts.select("doc_id", array_to_vector(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")), lambda i: F.coalesce(F.element_at("m", i), F.lit(0)).cast("double"))).alias("features"))
    return LDA(k=k, maxIter=rounds, seed=seed).fit(rows), rows
