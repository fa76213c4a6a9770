"""Sources and sinks: files are written into the shared folder in the formats that the readers take, then read back."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import search
from ..operators.lineage import cut, numbered, parts, shared_folder
from ..sources import graphs, logs, matrices, tables
from ..streaming import logs as live
from . import query, sql, table
from .graphs import nextpart
from .results import STEPS, TYPES, log

LINE = "SELECT l_orderkey % 500 AS i, l_partkey % 500 AS j, CAST(l_linenumber AS BIGINT) AS w FROM lineitem"
MOVED = f"WITH e AS ({LINE}), lo AS (SELECT least(min(i), min(j)) AS lo FROM e)"


def _pairs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).alias("i"), (F.col("l_partkey") % 500).alias("j"), F.col("l_linenumber").cast("long").alias("w"))


def _file(spark, lines: DataFrame) -> str:
    path = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    lines.write.text(path)
    return path


def _headed(lines: DataFrame, *header: str) -> DataFrame:
    """Lines (value) with a header at the beginning of each partition, so of each file that is written."""

    def run(batches):
        yield pa.RecordBatch.from_arrays([pa.array(header, pa.string())], ["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["value"])

    return lines.mapInArrow(run, "value string")


@query("edges_tnet2", MOVED + " SELECT i - lo AS src, j - lo AS dst, count(*) AS w FROM e, lo GROUP BY ALL")
def edges_tnet2(spark, sf_dir):
    return graphs.read_tnet(spark, _file(spark, _pairs(spark, sf_dir).select(F.concat_ws(" ", "i", "j"))))


@query("edges_tnet5", MOVED + " SELECT i - lo AS src, j - lo AS dst, CAST(sum(w) AS BIGINT) AS w FROM e, lo GROUP BY ALL")
def edges_tnet5(spark, sf_dir):
    return graphs.read_tnet(spark, _file(spark, _pairs(spark, sf_dir).select(F.concat(F.lit('"2004-04-15 07:56:00" '), F.concat_ws(" ", "i", "j", "w")))))


@query("edges_csv", MOVED + " SELECT i - lo AS src, j - lo AS dst, count(*) AS w FROM e, lo GROUP BY ALL")
def edges_csv(spark, sf_dir):
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    _pairs(spark, sf_dir).write.csv(path, sep=";", header=True)
    return graphs.read_csv(spark, path)


@query("edges_attributed", f"WITH e AS ({LINE}) SELECT i AS src, j AS dst, count(*) AS w FROM e GROUP BY ALL")
def edges_attributed(spark, sf_dir):
    e = _pairs(spark, sf_dir)
    lines = e.select(F.concat_ws(";", "i", "j").alias("value")).union(e.select(F.concat(F.col("i").cast("string"), F.lit(";0.5|1.5;3"))).distinct())
    edges, _ = graphs.read_attributed(spark, _file(spark, lines))
    return edges


@query("vertices_attributed", f"WITH e AS ({LINE}) SELECT DISTINCT i AS id, 2.0 AS feature_sum, 3 AS cluster FROM e")
def vertices_attributed(spark, sf_dir):
    lines = _pairs(spark, sf_dir).select(F.concat(F.col("i").cast("string"), F.lit(";0.5|1.5;3"))).distinct()
    _, vertices = graphs.read_attributed(spark, _file(spark, lines))
    return vertices.select("id", (F.col("features")[0] + F.col("features")[1]).alias("feature_sum"), "cluster")


@query("edges_dat", f"WITH e AS ({LINE}) SELECT i AS src, j AS dst, CAST(sum(w) AS BIGINT) AS w FROM e GROUP BY ALL")
def edges_dat(spark, sf_dir):
    lines = _pairs(spark, sf_dir).select(F.concat_ws(" ", "i", "j", "w").alias("value")).repartition(4)
    return graphs.read_dat(spark, _file(spark, _headed(lines, "ROW LABELS:", "a", "b", "DATA")))


@query("edges_generated", "SELECT a.i AS src, b.i AS dst, CAST(1 AS BIGINT) AS w FROM range(40) a(i), range(40) b(i) WHERE a.i // 5 = b.i // 5")
def edges_generated(spark, sf_dir):
    return graphs.load(spark, "clique2", n=40, block=5)


@query("edges_assembled", f"WITH e AS ({LINE}) SELECT i AS src, j AS dst, CAST(sum(w) AS BIGINT) AS w FROM e GROUP BY ALL")
def edges_assembled(spark, sf_dir):
    edges, _, _ = graphs.assemble(_pairs(spark, sf_dir).select(F.col("i").alias("src"), F.col("j").alias("dst"), "w"))
    return edges


@query("log_measure_grammar", "SELECT event_id AS id, m.measure, m.v AS values FROM (SELECT event_id, unnest([{measure: '_entropy', v: CAST(user_id AS VARCHAR)}, {measure: 'K', v: '2'}, {measure: 'counts', v: CAST(user_id % 7 AS VARCHAR) || ' ' || CAST(user_id % 5 AS VARCHAR)}]) AS m FROM events)")
def log_measure_grammar(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    lines = e.select(F.col("event_id").alias("id"), F.concat(F.lit(" "), F.concat_ws("  ", F.col("user_id").cast("string"), F.lit("2"), (F.col("user_id") % 7).cast("string"), (F.col("user_id") % 5).cast("string"))).alias("line"))
    return logs.parse_lines(lines, "#_entropy K {counts}").select("id", "measure", F.array_join("values", " ").alias("values"))


@query("log_text_round_trip", STEPS + " SELECT run, measure, it, value FROM l")
def log_text_round_trip(spark, sf_dir):
    path = f"{shared_folder(spark)}/logs-{uuid.uuid4().hex}"
    logs.write_text_log(log(spark, sf_dir), path, TYPES, "run", "it")
    back = logs.read_log(spark, f"{path}/*")
    run = F.regexp_extract("path", r"run=(\d+)", 1).cast("long")
    return back.where("values[0] <> 'None'").select(run.alias("run"), "measure", F.col("it").cast("long").alias("it"), F.col("values")[0].cast("double").alias("value"))


@query("measures", "SELECT user_id, round_even(avg(value), 6) AS mean, round_even(-sum(value * ln(value)), 4) AS entropy FROM events WHERE value > 0 GROUP BY user_id")
def measures(spark, sf_dir):
    e = logs.evaluate(table(spark, sf_dir, "events").where("value > 0"), ["user_id"], ["mean@column=value", "entropy"])
    return e.select("user_id", F.bround("mean", 6).alias("mean"), F.bround("entropy", 4).alias("entropy"))


@query("result_tree", "SELECT CAST(s_nationkey AS VARCHAR) AS corpus, round_even(avg(s_acctbal), 4) AS p, count(*) AS n FROM supplier GROUP BY s_nationkey")
def result_tree(spark, sf_dir):
    path = f"{shared_folder(spark)}/tree-{uuid.uuid4().hex}"
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("corpus"), F.to_json(F.struct(F.col("s_acctbal").alias("Precision"), F.lit(1.0).alias("Recall"))).alias("value"))
    s.repartition(parts(spark)).write.option("maxRecordsPerFile", 1).partitionBy("corpus").text(path)
    rows = tables.result_tree(spark, path, ["folder"]).where("measure = 'Precision'")
    return rows.groupBy(F.regexp_replace("folder", "corpus=", "").alias("corpus")).agg(F.bround(F.avg("value"), 4).alias("p"), F.count("*").alias("n"))


@query("dimension_sizes", "SELECT count(DISTINCT p_brand) AS p_brand, count(DISTINCT p_type) AS p_type, count(DISTINCT p_size) AS p_size FROM part")
def dimension_sizes(spark, sf_dir):
    return tables.dimension_sizes(table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size"])


@query("slice_cube", "SELECT p_partkey FROM (SELECT p_partkey, p_brand, dense_rank() OVER (ORDER BY p_size) - 1 AS z FROM part) WHERE z BETWEEN 2 AND 4 AND p_brand = 'Brand#11'")
def slice_cube(spark, sf_dir):
    from ..operators.results import axis_positions

    cube = axis_positions(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_type"), ["p_size"])
    return tables.slice_cube(cube, {"p_size": "2:5", "p_brand": "Brand#11", "p_type": "*"}).select("p_partkey")


@query("tail_lines", "SELECT CAST(r AS INT) AS line_no, CAST(o_orderkey AS VARCHAR) AS line FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders) WHERE r >= n - 5")
def tail_lines(spark, sf_dir):
    path = f"{shared_folder(spark)}/tail-{uuid.uuid4().hex}"
    table(spark, sf_dir, "orders").orderBy("o_orderkey").select(F.col("o_orderkey").cast("string")).write.text(path)
    return tables.tail(spark, path, 5, across=True)


@query("matrix_file", f"WITH e AS ({LINE}) SELECT i AS row, j AS col, CAST(sum(w) AS BIGINT) AS value, CAST(500 AS BIGINT) AS rows, (SELECT count(*) FROM (SELECT DISTINCT i, j FROM e)) AS entries FROM e GROUP BY i, j")
def matrix_file(spark, sf_dir):
    path = f"{shared_folder(spark)}/matrix-{uuid.uuid4().hex}"
    cells = _pairs(spark, sf_dir).groupBy(F.col("i").alias("row"), F.col("j").alias("col")).agg(F.sum("w").alias("value"))
    matrices.write_matrix(cells, path, 500, 500)
    found, (rows, _, n) = matrices.read_matrix(spark, path)
    return found.select("*", F.lit(rows).cast("long").alias("rows"), F.lit(n).cast("long").alias("entries"))


@query("corpus_files", "WITH b AS (SELECT o_custkey, o_orderpriority, count(*) AS cnt FROM orders GROUP BY ALL) SELECT o_custkey AS doc_id, o_orderpriority AS term, cnt FROM b")
def corpus_files(spark, sf_dir):
    """A matrix with its terms beside it: the priorities of each customer's orders."""
    path = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    o = table(spark, sf_dir, "orders")
    terms = numbered(o.select(F.col("o_orderpriority").alias("term")).distinct(), "term_id", F.col("term"))
    bag = o.groupBy(F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("term")).agg(F.count("*").alias("cnt")).join(terms, "term")
    matrices.write_corpus(bag.select("doc_id", "term_id", "cnt"), terms.select("term_id", "term"), path)
    cells, names = matrices.read_corpus(spark, path)
    return cells.join(names, "term_id").select("doc_id", "term", "cnt")


@query("triplets", "SELECT o_orderkey % 50 AS doc_id, l_partkey % 40 AS term_id, CAST(l_linenumber AS INT) AS cnt FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def triplets(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.concat_ws(" ", F.col("l_orderkey") % 50 + 1, F.col("l_partkey") % 40 + 1, "l_linenumber").alias("value"))
    return tables.read_triplets(spark, _file(spark, _headed(rows.repartition(4), "50", "40", "99")), header=3)


@query("cached_table", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand")
def cached_table(spark, sf_dir):
    path = f"{shared_folder(spark)}/cache-{uuid.uuid4().hex}"
    make = lambda: table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    tables.cached(spark, path, make)
    return tables.cached(spark, path, make)


def _log_files(spark, sf_dir, files: int = 1) -> str:
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    log(spark, sf_dir).repartition(files, "run").sortWithinPartitions("it").write.parquet(path)
    return path


@query("stream_log_append", STEPS + " SELECT run, measure, it, value FROM l")
def stream_log_append(spark, sf_dir):
    base = f"{shared_folder(spark)}/append-{uuid.uuid4().hex}"
    live.drained(live.append_logs(live.log_stream(spark, _log_files(spark, sf_dir, 2)), f"{base}/out", f"{base}/check"))
    return spark.read.parquet(f"{base}/out").select(F.col("run").cast("long").alias("run"), "measure", "it", "value")


@query("stream_edge_agg", f"WITH e AS ({LINE}) SELECT i AS src, j AS dst, CAST(sum(w) AS BIGINT) AS w FROM e GROUP BY ALL")
def stream_edge_agg(spark, sf_dir):
    path = f"{shared_folder(spark)}/edges-{uuid.uuid4().hex}"
    _pairs(spark, sf_dir).select(F.col("i").alias("src"), F.col("j").alias("dst"), "w").repartition(3).write.parquet(path)
    live.drained(live.edge_weights(live.log_stream(spark, path, graphs.EDGES), f"{path}-out", f"{path}-check"))
    return live.edge_table(spark, f"{path}-out")


@query("stream_deltas", STEPS + ", k AS (SELECT * FROM l WHERE it % 2 = 0) SELECT run, measure, it, value, round_even(value - coalesce(lag(value) OVER (PARTITION BY run, measure ORDER BY it), 0), 6) AS delta FROM k")
def stream_deltas(spark, sf_dir):
    base = f"{shared_folder(spark)}/deltas-{uuid.uuid4().hex}"
    stream = live.measure_deltas(live.log_stream(spark, _log_files(spark, sf_dir)), 2)
    live.drained(stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start())
    return spark.read.parquet(f"{base}/out").select("run", "measure", "it", "value", F.bround("delta", 6).alias("delta"))


@query("stream_edges_text", f"WITH e AS ({LINE}) SELECT i AS src, j AS dst, CAST(sum(w) AS BIGINT) AS w FROM e GROUP BY ALL")
def stream_edges_text(spark, sf_dir):
    path = f"{shared_folder(spark)}/edgelines-{uuid.uuid4().hex}"
    _pairs(spark, sf_dir).select(F.concat(F.lit('"2004-04-15 07:56:00" '), F.concat_ws(" ", "i", "j", "w"))).repartition(3).write.text(path)
    return _summed(spark, path, "tnet")


def _summed(spark, path: str, form: str) -> DataFrame:
    live.drained(live.edge_weights(live.edge_stream(spark, path, form), f"{path}-out", f"{path}-check"))
    return live.edge_table(spark, f"{path}-out")


@query("stream_edges_csv", f"WITH e AS ({LINE}) SELECT i AS src, j AS dst, count(*) AS w FROM e GROUP BY ALL")
def stream_edges_csv(spark, sf_dir):
    return _summed(spark, _file(spark, _headed(_pairs(spark, sf_dir).select(F.concat_ws(";", "i", "j", "w").alias("value")).repartition(3), "a;b;c")), "csv")


@query("stream_edges_dat", f"WITH e AS ({LINE}) SELECT i AS src, j AS dst, CAST(sum(w - 1) AS BIGINT) AS w FROM e WHERE w > 1 GROUP BY ALL")
def stream_edges_dat(spark, sf_dir):
    """Weights from 0 on, in files whose label section has lines that look like edges: those and the zero weights are no edges."""
    lines = _pairs(spark, sf_dir).select(F.concat_ws(" ", "i", "j", F.col("w") - 1).alias("value")).repartition(3)
    return _summed(spark, _file(spark, _headed(lines, "*vertices", "1 2", "3 4 5", "*edges")), "dat")


@query("stream_graph_attributed", f"WITH e AS ({LINE}), v AS (SELECT DISTINCT i FROM e) SELECT i AS src, j AS dst, count(*) AS w, NULL AS feature_sum, NULL AS cluster FROM e GROUP BY ALL UNION ALL SELECT i, NULL, NULL, i + 1.5, CAST(i % 3 AS INT) FROM v")
def stream_graph_attributed(spark, sf_dir):
    """Edge and vertex rows of the same files."""
    e = _pairs(spark, sf_dir)
    lines = e.select(F.concat_ws(";", "i", "j").alias("value")).union(e.select("i").distinct().select(F.concat(F.col("i").cast("string"), F.lit(";"), F.col("i").cast("string"), F.lit("|1.5;"), (F.col("i") % 3).cast("string"))))
    path = _file(spark, _headed(lines.repartition(3), "# Vertices and edges"))
    vertices = live.vertex_stream(spark, path).writeStream.format("parquet").option("path", f"{path}-vertices").option("checkpointLocation", f"{path}-seen").trigger(availableNow=True).start()
    live.drained(vertices)
    seen = spark.read.schema("id long, features array<double>, cluster int").parquet(f"{path}-vertices")
    none = F.lit(None)
    return _summed(spark, path, "attributed").select("*", none.cast("double").alias("feature_sum"), none.cast("int").alias("cluster")).union(seen.select("id", none, none, F.aggregate("features", F.lit(0.0), lambda a, x: a + x), "cluster"))


@query("vocabulary_file", "SELECT p_name AS term, row_number() OVER (ORDER BY p_name) - 1 AS term_id FROM (SELECT DISTINCT p_name FROM part)")
def vocabulary_file(spark, sf_dir):
    return tables.read_vocabulary(spark, _file(spark, table(spark, sf_dir, "part").select("p_name").distinct().orderBy("p_name")))


@query("token_files", "SELECT md5(string_agg(term, ' ' ORDER BY pos)) AS digest FROM (SELECT n_nationkey, unnest(list) AS term, generate_subscripts(list, 1) AS pos FROM (SELECT n_nationkey, list_filter(string_split(lower(regexp_replace(n_name || ' of region ' || n_regionkey, '[^a-zA-Z0-9_\\-]+', ' ', 'g')), ' '), lambda x: x <> '') AS list FROM nation)) GROUP BY n_nationkey")
def token_files(spark, sf_dir):
    path = f"{shared_folder(spark)}/texts-{uuid.uuid4().hex}"
    table(spark, sf_dir, "nation").select("n_nationkey", F.concat("n_name", F.lit(" of region "), F.col("n_regionkey").cast("string")).alias("value")).repartition("n_nationkey").write.partitionBy("n_nationkey").text(path)
    toks = tables.read_corpus(spark, [f"{path}/n_nationkey={k}" for k in range(25)])
    return toks.groupBy("path").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]), " ")).alias("digest")).select("digest")


@query("edges_mirrored", f"WITH e AS ({LINE}), c AS (SELECT i, j, count(*) AS w FROM e GROUP BY ALL) SELECT i AS src, j AS dst, w FROM c UNION SELECT j, i, w FROM c")
def edges_mirrored(spark, sf_dir):
    lines = _pairs(spark, sf_dir).select(F.concat_ws(";", "i", "j"))
    return graphs.read_attributed(spark, _file(spark, lines), mirror=True)[0]


@query("edges_unshifted", "SELECT l_orderkey % 500 + 7 AS src, l_partkey % 500 + 7 AS dst, count(*) AS w FROM lineitem GROUP BY ALL")
def edges_unshifted(spark, sf_dir):
    return graphs.read_tnet(spark, _file(spark, _pairs(spark, sf_dir).select(F.concat_ws(" ", F.col("i") + 7, F.col("j") + 7))), shift=False)


@query("edges_dat_zeros", "SELECT l_orderkey % 500 AS src, l_partkey % 500 AS dst, CAST(sum(l_linenumber - 1) AS BIGINT) AS w FROM lineitem GROUP BY ALL")
def edges_dat_zeros(spark, sf_dir):
    e = _pairs(spark, sf_dir).withColumn("w", F.col("w") - 1)
    lines = e.select(F.concat_ws(" ", "i", "j", "w").alias("value")).repartition(4)
    return graphs.read_dat(spark, _file(spark, _headed(lines, "*vertices", "a", "*edges")), zeros=True)


BA = """WITH e AS (SELECT unnest(range(600)) AS id), f AS (SELECT id // 2 AS src,
  list_reduce(list_prepend(2 * id + 1, range(64)), lambda r, i: CASE WHEN r % 2 = 0 THEN r ELSE CAST('0x' || substr(md5('0|' || r), 1, 15) AS BIGINT) % r END) // 4 AS dst FROM e)"""


@query("edges_ba", BA + " SELECT DISTINCT src, dst, CAST(1 AS BIGINT) AS w FROM f WHERE src <> dst")
def edges_ba(spark, sf_dir):
    return graphs.load(spark, "ba", n=300)


@query("edges_dispatched", MOVED + " SELECT i - lo AS src, j - lo AS dst, count(*) AS w FROM e, lo GROUP BY ALL")
def edges_dispatched(spark, sf_dir):
    """A file that its ending sends to the reader of its format."""
    path = f"{shared_folder(spark)}/named-{uuid.uuid4().hex}.csv"
    _pairs(spark, sf_dir).write.csv(path, sep=";", header=True)
    return graphs.load(spark, "some_network", path)


@query("files_by_extension", " UNION ALL ".join(f"SELECT '{k}' AS kind, CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation" for k in ("csv", "json", "orc", "parquet")))
def files_by_extension(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    out = None
    for kind in ("csv", "json", "orc", "parquet"):
        path = f"{shared_folder(spark)}/any-{uuid.uuid4().hex}.{kind}"
        n.write.format(kind).options(**({"header": "true"} if kind == "csv" else {})).save(path)
        one = tables.read_any(spark, path).select(F.lit(kind).alias("kind"), F.col("id").cast("long").alias("id"), "name")
        out = one if out is None else out.unionByName(one)
    return out


@query("outputs_empty", "SELECT CAST(n_nationkey AS VARCHAR) AS run, n_nationkey % 3 = 0 AS empty FROM nation")
def outputs_empty(spark, sf_dir):
    path = f"{shared_folder(spark)}/outs-{uuid.uuid4().hex}"
    key = F.col("n_nationkey") % 3
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("run"), F.when(key == 0, "# terminated").otherwise("0.5 2").alias("value"))
    rows.repartition("run").write.partitionBy("run").text(path)
    return tables.outputs(spark, path).select(F.regexp_extract("path", r"run=(\d+)", 1).alias("run"), "empty")


@query("log_extract", "SELECT event_id, CAST(user_id AS VARCHAR) AS plain, CAST(value AS VARCHAR) AS hidden, '2 ' || user_id % 7 || ' ' || user_id % 5 AS list, CAST(user_id % 3 AS VARCHAR) AS item, 'None' AS missing FROM events")
def log_extract(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumns({"_entropy": F.col("value"), "counts": F.array(F.col("user_id") % 7, F.col("user_id") % 5), "parts": F.create_map(F.lit("a"), F.struct((F.col("user_id") % 3).alias("m")))})
    kinds = dict(e.dtypes)
    got = {"plain": "user_id", "hidden": "entropy", "list": "{counts}", "item": "{parts[m]}", "missing": "nothing"}
    return e.select("event_id", *[logs.extract(x, kinds).alias(n) for n, x in got.items()])


@query("stream_minibatch", "WITH t AS (SELECT unnest(range(200)) AS value), e AS (SELECT l_orderkey % 500 AS src, l_partkey % 500 AS dst, CAST(sum(l_linenumber) AS BIGINT) AS w FROM lineitem GROUP BY ALL), d AS (SELECT value, CAST('0x' || substr(md5('0|' || value || '|node'), 1, 15) AS BIGINT) % 500 AS src, CAST('0x' || substr(md5('0|' || value || '|set'), 1, 15) AS BIGINT) % 2 = 0 AS links FROM t), m AS (SELECT * FROM d JOIN e USING (src)) SELECT value, src, dst, w FROM m WHERE links UNION ALL SELECT value, src, o AS dst, 0 FROM (SELECT value, src, CAST('0x' || substr(md5('0|' || value || '|' || dst), 1, 15) AS BIGINT) % 500 AS o FROM m WHERE NOT links) x WHERE src <> o AND NOT EXISTS (SELECT 1 FROM e WHERE e.src = x.src AND e.dst = x.o)")
def stream_minibatch(spark, sf_dir):
    base = f"{shared_folder(spark)}/ticks-{uuid.uuid4().hex}"
    spark.range(200).select(F.col("id").alias("value")).repartition(2).write.parquet(f"{base}/in")
    edges = _pairs(spark, sf_dir).groupBy(F.col("i").alias("src"), F.col("j").alias("dst")).agg(F.sum("w").alias("w"))
    stream = live.minibatch_stream(live.log_stream(spark, f"{base}/in", "value long"), edges, 500)
    live.drained(stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start())
    return spark.read.schema("value long, src long, dst long, w long").parquet(f"{base}/out")


@query("stream_minibatch_whole", sql("net_minibatch"))
def stream_minibatch_whole(spark, sf_dir):
    base = f"{shared_folder(spark)}/draws-{uuid.uuid4().hex}"
    spark.range(40).select(F.col("id").alias("value")).repartition(2).write.parquet(f"{base}/in")
    live.drained(live.minibatches_to(live.log_stream(spark, f"{base}/in", "value long"), cut(nextpart(spark, sf_dir)), f"{base}/out", f"{base}/check"))
    return spark.read.parquet(f"{base}/out").drop("micro_batch")


@query("stream_index", "SELECT CAST(count(*) AS BIGINT) AS postings, CAST(sum(tf) AS BIGINT) AS tokens FROM (SELECT p_partkey, t, count(*) AS tf FROM (SELECT p_partkey, unnest(string_split(lower(regexp_replace(p_name || ' ' || p_brand, '[^a-zA-Z0-9_\\-]+', ' ', 'g')), ' ')) AS t FROM part) WHERE t <> '' GROUP BY ALL)")
def stream_index(spark, sf_dir):
    base = f"{shared_folder(spark)}/online-{uuid.uuid4().hex}"
    table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat_ws(" ", "p_name", "p_brand").alias("text")).repartition(3).write.parquet(f"{base}/in")
    live.drained(live.index_writer(live.log_stream(spark, f"{base}/in", "doc_id long, text string"), ["text"], f"{base}/out", f"{base}/check"))
    return search.read(spark, f"{base}/out").postings.agg(F.count("*").alias("postings"), F.sum("tf").alias("tokens"))
