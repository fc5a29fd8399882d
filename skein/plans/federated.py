"""Queries over partitioned clients, attention and gradients, and files.

Files are written from the driver's tables to the shared folder, and read with the operators under test.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.hashing import uniform, uniform_of
from skein.functions.storage import scratch, written
from skein.operators import federate, gnn, graph, learn, logs, partition, privacy, sketches, train, whole_graph
from skein.plans.catalog import _W, Fixtures, _gcn, _graph, _matrix, _record, _size, query  # noqa: F401
from skein.sources import datasets, files
from skein.streaming import round_log, run_totals

_U = "(('0x'||substr(sha256({key}),1,13))::UBIGINT::DOUBLE+0.5)/4503599627370496"

# Five rounds of label propagation, clients in turn, a tenth of the nodes shared, splits and local ids.
_ROUNDS = ", ".join(f"l{r} AS MATERIALIZED (SELECT i id, l FROM (SELECT i, l, row_number() OVER (PARTITION BY i ORDER BY n DESC, l) rk FROM (SELECT adj.i, l{r - 1}.l, count(*) n FROM adj JOIN l{r - 1} ON adj.j=l{r - 1}.id GROUP BY adj.i, l{r - 1}.l)) WHERE rk=1)" for r in range(1, 6))
_CLIENTS = f"""WITH l0 AS (SELECT vec_id id, vec_id l FROM embeddings), {_ROUNDS},
s AS (SELECT l, ((row_number() OVER (ORDER BY count(*) DESC, l)-1) % 5)::INT cid FROM l5 GROUP BY l),
m0 AS MATERIALIZED (SELECT id gid, cid FROM l5 JOIN s USING (l)),
pool AS MATERIALIZED (SELECT cid, gid FROM m0 ORDER BY sha256('42-overlap|'||gid), gid LIMIT (SELECT floor(count(*)*0.1::DOUBLE)::BIGINT FROM m0)),
m1 AS MATERIALIZED (SELECT cid, gid FROM m0 UNION SELECT ((cid+1+floor({_U.format(key="'42-second|'||gid")}*4))::INT % 5) cid, gid FROM pool),
m2 AS (SELECT m1.cid, m1.gid, pool.gid IS NOT NULL is_overlap, row_number() OVER (PARTITION BY m1.cid ORDER BY m1.gid)-1 lid, count(*) OVER (PARTITION BY m1.cid) n,
  row_number() OVER (PARTITION BY m1.cid ORDER BY sha256('42-split|'||m1.cid||'|'||m1.gid), m1.gid) rn FROM m1 LEFT JOIN pool ON pool.gid=m1.gid),
cn AS MATERIALIZED (SELECT cid, gid, lid, is_overlap, CASE WHEN rn<=floor(0.6::DOUBLE*n) THEN 'train' WHEN rn<=floor(0.6::DOUBLE*n)+floor(0.2::DOUBLE*n) THEN 'val' ELSE 'test' END AS split FROM m2),
ce AS MATERIALIZED (SELECT a.cid, e.u, e.v FROM e JOIN cn a ON a.gid=e.u JOIN cn b ON b.gid=e.v AND a.cid=b.cid),
cd AS (SELECT cn.cid, cn.gid, coalesce(d, 0) d FROM cn LEFT JOIN (SELECT cid, gid, count(*) d FROM (SELECT cid, u gid FROM ce UNION ALL SELECT cid, v FROM ce) GROUP BY 1, 2) q USING (cid, gid)),
ep AS (SELECT cid, gid, least(2::DOUBLE, greatest(0.5::DOUBLE, 2-d/greatest(max(d) OVER (PARTITION BY cid), 1)::DOUBLE*1.5::DOUBLE)) eps FROM cd),
nz AS (SELECT cn.cid, gid, is_overlap, eps, k, greatest(-1, least(1, x)) - (1/eps)*sign(u)*ln(1-2*abs(u)) z FROM (
  SELECT cn.cid, cn.gid, cn.is_overlap, ep.eps, x.k, x.x, {_U.format(key="'42|'||cn.cid||'|'||cn.gid||'|'||x.k")}-0.5::DOUBLE u FROM cn JOIN ep USING (cid, gid) JOIN x ON x.id=cn.gid) cn)
"""


def _clients(t: Fixtures) -> partition.Clients:
    return partition.partition_federated(_graph(t), 5, 0.1, "42")


def _noisy(t: Fixtures) -> DataFrame:
    found = _clients(t)
    return privacy.na_encode(found.nodes, found.edges)


query("partition_federated", _CLIENTS + "SELECT cid, gid, lid, split, is_overlap FROM cn")(lambda t: _clients(t).nodes.select("cid", "gid", "lid", "split", "is_overlap"))
query("client_edges", _CLIENTS + "SELECT cid, u, v FROM ce")(lambda t: _clients(t).edges)
query("client_stats", _CLIENTS + "SELECT cid, count(*) nodes, (SELECT count(*) FROM ce WHERE ce.cid=cn.cid) edges, count(*) FILTER (is_overlap) overlap, count(*) FILTER (split='train') train, count(*) FILTER (split='val') val, count(*) FILTER (split='test') test FROM cn GROUP BY cid")(lambda t: partition.client_stats(_clients(t)))
query("na_encode", _CLIENTS + "SELECT cid, gid, is_overlap, eps, k, z FROM nz", ("eps", "z"))(lambda t: _noisy(t).select("cid", "gid", "is_overlap", "eps", F.posexplode("z").alias("k", "z")))
query("overlap_average", _CLIENTS + "SELECT gid, k, count(*) AS clients, avg(z) AS z FROM nz WHERE is_overlap GROUP BY gid, k", ("z",))(lambda t: privacy.overlap_merge(_noisy(t).where("is_overlap")).select("gid", "clients", F.posexplode("z").alias("k", "z")))

# Every client's sketch has a salt of its own.
_BITS = "SELECT DISTINCT cid, (('0x'||substr(sha256(unhex(lpad(hex(i),8,'0'))||unhex(substr(sha256('salt|'||cid),1,32))||encode(least(u,v)||'-'||greatest(u,v))),1,16))::UBIGINT % 8192)::INT AS pos FROM ce, range(4) r(i)"
query("bloom_encode", _CLIENTS + _BITS)(lambda t: sketches.positions(privacy.bloom_encode(_clients(t).edges)))
query("bloom_merge", _CLIENTS + f"SELECT DISTINCT pos FROM ({_BITS})")(lambda t: sketches.positions(sketches.merged(privacy.bloom_encode(_clients(t).edges))))
query("sketch_stats", _CLIENTS + f"SELECT count(DISTINCT pos)/8192.0::DOUBLE AS density, pow(count(DISTINCT pos)/8192.0::DOUBLE, 4) AS est_fpr, count(DISTINCT cid) AS num_clients, 8192 AS m FROM ({_BITS})", ("density", "est_fpr"))(lambda t: privacy.sketch_stats(privacy.bloom_encode(_clients(t).edges)))

# Attention: two heads of size four, then one of ten classes; weights made of hashes.
_HEADS = f"""WITH wh AS MATERIALIZED (SELECT x.id, h, c, sum(x*({_U.format(key="'gw'||h||'|'||k||'|'||c")}-0.5::DOUBLE)) z FROM x, range(2) r(h), range(4) q(c) GROUP BY x.id, h, c),
st AS (SELECT id, h, sum(z*({_U.format(key="'gs'||h||'|'||c")}-0.5::DOUBLE)) s, sum(z*({_U.format(key="'gt'||h||'|'||c")}-0.5::DOUBLE)) t FROM wh GROUP BY id, h),
sc AS (SELECT u, v, a.h, CASE WHEN a.s+b.t>=0 THEN a.s+b.t ELSE 0.2::DOUBLE*(a.s+b.t) END s FROM e JOIN st a ON a.id=u JOIN st b ON b.id=v AND b.h=a.h),
ex AS (SELECT u, v, h, exp(s-max(s) OVER (PARTITION BY u, h)) x FROM sc),
al AS MATERIALIZED (SELECT u, v, h, x/(sum(x) OVER (PARTITION BY u, h)+1e-10) alpha FROM ex),
o1 AS (SELECT u id, al.h, c, sum(alpha*z) z FROM al JOIN wh ON wh.id=v AND wh.h=al.h GROUP BY u, al.h, c),
g1 AS MATERIALIZED (SELECT wh.id, (wh.h*4+wh.c)::INT k, coalesce(o1.z, wh.z) x FROM wh LEFT JOIN o1 ON o1.id=wh.id AND o1.h=wh.h AND o1.c=wh.c),
w2 AS MATERIALIZED (SELECT id, c, sum(greatest(0, x)*({_U.format(key="'gw9|'||k||'|'||c")}-0.5::DOUBLE)) z FROM g1, range(10) q(c) GROUP BY id, c),
s2 AS (SELECT id, sum(z*({_U.format(key="'gs9|'||c")}-0.5::DOUBLE)) s, sum(z*({_U.format(key="'gt9|'||c")}-0.5::DOUBLE)) t FROM w2 GROUP BY id),
c2 AS (SELECT u, v, CASE WHEN a.s+b.t>=0 THEN a.s+b.t ELSE 0.2::DOUBLE*(a.s+b.t) END s FROM e JOIN s2 a ON a.id=u JOIN s2 b ON b.id=v),
e2 AS (SELECT u, v, exp(s-max(s) OVER (PARTITION BY u)) x FROM c2),
a2 AS (SELECT u, v, x/(sum(x) OVER (PARTITION BY u)+1e-10) alpha FROM e2),
o2 AS (SELECT u id, c, sum(alpha*z) z FROM a2 JOIN w2 ON w2.id=v GROUP BY u, c),
g2 AS (SELECT w2.id, w2.c::INT k, coalesce(o2.z, w2.z) x FROM w2 LEFT JOIN o2 ON o2.id=w2.id AND o2.c=w2.c),
y2 AS (SELECT id, k, exp(x-max(x) OVER (PARTITION BY id)) x FROM g2)
"""


def _head(name: str, rows: int, cols: int) -> gnn.Head:
    vector = lambda part: [uniform_of(f"g{part}{name}", c) - 0.5 for c in range(cols)]
    return gnn.Head([[uniform_of(f"gw{name}", k, c) - 0.5 for c in range(cols)] for k in range(rows)], vector("s"), vector("t"))


def _heads(t: Fixtures) -> list[gnn.Head]:
    return [_head(str(h), _size(t), 4) for h in range(2)]


query("gat_softmax", _HEADS + "SELECT u, v, h::INT AS h, alpha FROM al", ("alpha",))(lambda t: gnn.attention(t.edges, t.v, _heads(t)).select("u", "v", "h", "alpha"))
query("gat_layer", _HEADS + "SELECT id, k, x FROM g1", ("x",))(lambda t: graph.long_form(gnn.gat_layer(t.edges, t.v, _heads(t))))
query("gat_forward", _HEADS + "SELECT id, k, x/(sum(x) OVER (PARTITION BY id)+1e-10) AS p FROM y2", ("p",))(lambda t: gnn.gat_forward(t.edges, t.v, _heads(t), _head("9", 8, 10)).select("id", F.posexplode("p").alias("k", "p")))

# One gradient of the two-layer network; three in five nodes train.
_GRADIENT = f"""WITH ax AS MATERIALIZED (SELECT i id, k, sum(a*x) x FROM ahat JOIN x ON j=id GROUP BY i, k),
h1 AS MATERIALIZED (SELECT id, c::INT c, greatest(0, sum(x*({_W.format(s='w0', a='k', b='c')}))) h FROM ax, range(8) r(c) GROUP BY id, c),
ah AS MATERIALIZED (SELECT i id, c, sum(a*h) h FROM ahat JOIN h1 ON j=id GROUP BY i, c),
z AS (SELECT id, q.c::INT k, sum(h*({_W.format(s='w1', a='ah.c', b='q.c')})) z FROM ah, range(10) q(c) GROUP BY id, q.c),
ez AS (SELECT id, k, exp(z-max(z) OVER (PARTITION BY id)) e FROM z),
pz AS (SELECT id, k, e/(sum(e) OVER (PARTITION BY id)+1e-10) p FROM ez),
tr AS (SELECT vec_id id, label y, {_U.format(key="'tr|'||vec_id")} < 0.6 AS train FROM embeddings),
dl AS MATERIALIZED (SELECT pz.id, k, CASE WHEN train THEN (p-(k=y)::INT)/(SELECT count(*) FROM tr WHERE train) ELSE p END d FROM pz JOIN tr USING (id)),
ad AS (SELECT i id, k, sum(a*d) d FROM ahat JOIN dl ON j=id GROUP BY i, k),
bk AS (SELECT ad.id, r.c::INT c, sum(d*({_W.format(s='w1', a='r.c', b='k')})) b FROM ad, range(8) r(c) GROUP BY ad.id, r.c),
bg AS (SELECT bk.id, bk.c, CASE WHEN h>0 THEN b ELSE 0 END b FROM bk JOIN h1 USING (id, c)),
gr AS MATERIALIZED (SELECT 'W0' AS matrix, k r, c, sum(x*b) g FROM ax JOIN bg USING (id) GROUP BY k, c UNION ALL SELECT 'W1', ah.c, dl.k, sum(h*d) FROM ah JOIN dl USING (id) GROUP BY ah.c, dl.k)
"""


def _gradient(t: Fixtures) -> DataFrame:
    labels = t.labels.select("id", F.col("label").alias("y"), (uniform(F.lit("tr"), F.col("id")) < 0.6).alias("train"))
    return gnn.gcn_gradient(t.a_hat, t.v, labels, _matrix("w0", _size(t), 8), _matrix("w1", 8, 10))


query("gcn_gradient", _GRADIENT + "SELECT matrix, r, c, g FROM gr", ("g",))(_gradient)


def _trained_whole(t: Fixtures) -> DataFrame:
    """The loss before each of three steps on the whole embedding graph and after the last; three of four nodes train."""
    labels = t.labels.select("id", F.col("label").alias("y"), (F.col("id") % 4 != 0).alias("train"))
    found = whole_graph.train_gcn(t.a_hat, t.v, labels, train.Config(hidden=8, rate=0.5, masked=True), 10, 3)
    return t.nodes.sparkSession.createDataFrame(list(enumerate(found.losses)), "epoch int, loss double")


query("gcn_train_whole", doubles=("loss",))(_trained_whole)
query("grad_clip", _GRADIENT + "SELECT matrix, r, c, g*CASE WHEN norm>1 THEN 1/norm ELSE 1 END AS g FROM gr JOIN (SELECT matrix, sqrt(sum(g*g)) norm FROM gr GROUP BY matrix) USING (matrix)", ("g",))(lambda t: gnn.clipped(_gradient(t)))

# A vector of 64 as two matrices of 8 x 4, one after the other in order of their names.
_PARTS = "SELECT cid, CASE WHEN k < 32 THEN 'layer1.W' ELSE 'layer2.W' END AS path, (k % 32) // 4 AS i, k % 4 AS j, k, w FROM upd"
query("flatten", "SELECT cid, k::BIGINT AS k, w FROM upd", ("w",))(lambda t: federate.flattened(t.updates.select("cid", F.when(F.col("k") < 32, "layer1.W").otherwise("layer2.W").alias("path"), F.floor(F.col("k") % 32 / 4).alias("i"), (F.col("k") % 4).alias("j"), "w")))
query("unflatten", f"SELECT cid, path, i::BIGINT AS i, j::BIGINT AS j, w FROM ({_PARTS})", ("w",))(lambda t: federate.unflattened(t.updates, [("layer1.W", 8, 4), ("layer2.W", 8, 4)]))
query("xavier", doubles=("w",))(lambda t: t.nodes.sparkSession.createDataFrame([(i, float(w)) for i, w in enumerate(train.initial([(100, 100)], 42))], "i long, w double"))
query("feature_join", "SELECT e0.id, coalesce(n, 0) AS n_features, coalesce(last, -1) AS last FROM (SELECT vec_id id FROM embeddings) e0 LEFT JOIN (SELECT user_id id, count(DISTINCT (json_extract_string(props, '$.k'))::INT) n, max((json_extract_string(props, '$.k'))::INT) last FROM events GROUP BY user_id) f ON f.id=e0.id")(
    lambda t: _joined(t).select("id", F.aggregate("x", F.lit(0.0), lambda s, v: s + v).cast("long").alias("n_features"), F.array_max(F.transform("x", lambda v, k: F.when(v > 0, k).otherwise(-1))).alias("last"))
)


def _fids(t: Fixtures) -> DataFrame:
    return t.read("events").select(F.col("user_id").alias("id"), F.get_json_object("props", "$.k").cast("int").alias("fid")).distinct()


def _joined(t: Fixtures) -> DataFrame:
    """Binary features of the embedding graph's nodes, by the users of events."""
    fids = _fids(t)
    return datasets.binary_features(fids, t.nodes, datasets.feature_size(fids, datasets.CAP))


# Files
def _csv(df: DataFrame, label: str) -> str:
    path = scratch(df.sparkSession, label)
    df.write.option("header", True).csv(path)
    return path


def _json(fids: DataFrame) -> str:
    """{"node": [feature ids]}, one object a file."""
    path = scratch(fids.sparkSession, "features")
    lists = fids.groupBy("id").agg(F.array_sort(F.collect_set("fid")).alias("f"))
    entries = lists.select(F.concat(F.lit('"'), F.col("id").cast("string"), F.lit('":['), F.array_join(F.col("f").cast("array<string>"), ","), F.lit("]")).alias("s"), (F.col("id") % 7).alias("part"))
    entries.groupBy("part").agg(F.concat(F.lit("{"), F.array_join(F.collect_list("s"), ","), F.lit("}")).alias("value")).select("value").write.text(path)
    return path


def _matrix_csv(t: Fixtures) -> str:
    """The adjacency matrix of the embedding graph with an index column, compressed. A row of the matrix is one text, made
    of runs of zeros: a frame can't have a column for every node."""
    n = t.nodes.count()
    both = t.edges.select(F.col("u").alias("i"), F.col("v").alias("j")).unionByName(t.edges.select(F.col("v").alias("i"), F.col("u").alias("j")))
    ones = both.where((F.col("j") >= 0) & (F.col("j") < n)).groupBy(F.col("i").alias("id")).agg(F.array_sort(F.collect_set("j")).alias("js"))
    rows = t.nodes.join(ones, "id", "left").select("id", F.coalesce("js", F.array().cast("array<bigint>")).alias("js"))
    zeros = lambda count: F.repeat(F.lit(",0"), count.cast("int"))
    upto = F.transform("js", lambda j, k: F.concat(zeros(j - F.coalesce(F.get("js", k - 1), F.lit(-1)) - 1), F.lit(",1")))
    line = F.concat(F.col("id").cast("string"), F.array_join(upto, ""), zeros(n - 1 - F.coalesce(F.get("js", F.size("js") - 1), F.lit(-1))))
    path, cells = scratch(t.nodes.sparkSession, "matrix"), 1 << 27
    dealt = rows.repartition(max(t.nodes.sparkSession.sparkContext.defaultParallelism, n * n // cells), "id")
    wide = dealt.select(line.alias(",".join(["id", *(f"c{k}" for k in range(n))])))
    wide.write.option("header", True).option("sep", "\u0001").option("compression", "gzip").csv(path)
    return path


def _graphml(t: Fixtures) -> str:
    path = scratch(t.nodes.sparkSession, "graph") + ".graphml"
    nodes = t.labels.join(t.v, "id").select(F.col("id").alias("o"), F.lit(1).alias("kind"), F.format_string('<node id="n%d"><data key="d0">%d</data><data key="d1">%s</data></node>', F.col("id"), F.col("label"), F.round(F.col("x")[0], 6).cast("string")).alias("value"))
    edges = t.edges.select(F.col("u").alias("o"), F.lit(2).alias("kind"), F.format_string('<edge source="n%d" target="n%d"/>', F.col("u"), F.col("v")).alias("value"))
    frame = t.nodes.sparkSession.createDataFrame([(-1, 0, '<graphml><key id="d0" for="node" attr.name="label" attr.type="int"/><key id="d1" for="node" attr.name="first" attr.type="double"/><graph edgedefault="undirected">'), (1 << 60, 3, "</graph></graphml>")], "o long, kind int, value string")
    frame.unionByName(nodes).unionByName(edges).coalesce(1).sortWithinPartitions("kind", "o").select("value").write.text(path)
    return path


query("edges_scan", "SELECT u AS src, v AS dst FROM e")(lambda t: files.edge_list(t.nodes.sparkSession, _csv(t.edges, "edges")))
query("labels_scan", "SELECT vec_id AS id, label::VARCHAR AS label FROM embeddings")(lambda t: files.labels(t.nodes.sparkSession, _csv(t.labels, "labels")))
query("features_scan", "SELECT DISTINCT user_id AS id, (json_extract_string(props, '$.k'))::INT AS fid FROM events")(lambda t: files.sparse_features(t.nodes.sparkSession, _json(_fids(t))))
query("features_dense", "SELECT id, k, x FROM x", ("x",))(lambda t: files.dense_features(t.nodes.sparkSession, _csv(t.v.select("id", *[F.col("x")[k].alias(f"feat_{k}") for k in range(_size(t))]), "dense")))
query("adj_matrix_edges", "SELECT u, v FROM e")(lambda t: files.adjacency_csv(t.nodes.sparkSession, _matrix_csv(t)))
query("graphml_scan", "SELECT 'n'||u AS source, 'n'||v AS target FROM e")(lambda t: files.graphml_edges(t.nodes.sparkSession, _graphml(t)))
query("attr_set", "SELECT unnest(['first']) AS name")(lambda t: t.nodes.sparkSession.createDataFrame([(n,) for n in datasets.attribute_names(files.graphml_nodes(t.nodes.sparkSession, _graphml(t)), "label")], "name string"))
query("catalog")(lambda t: datasets.catalogue(t.nodes.sparkSession))
query("log_demo", doubles=("global_acc", "global_f1", "worst_client_f1", "cumulative_eps", "comms_mb", "fairness_gap"))(lambda t: logs.demo(t.nodes.sparkSession))
query("log_file", "SELECT count(*) AS rounds, 'global_acc' AS first_metric FROM (SELECT DISTINCT round FROM lg)")(lambda t: _log_file(t))


def _log_file(t: Fixtures) -> DataFrame:
    log = logs.read_csv(t.nodes.sparkSession, _csv(_record(t), "log"))
    return log.agg(F.count("*").alias("rounds")).withColumn("first_metric", F.lit(logs.first_metric(log)))


# A graph of edges, sparse features and labels from three files: scaled features of nodes that an edge has.
_LOADED = """WITH ends AS (SELECT u id FROM e UNION SELECT v FROM e), ix AS (SELECT id, row_number() OVER (ORDER BY id)-1 n FROM ends),
f AS (SELECT DISTINCT user_id id, (json_extract_string(props, '$.k'))::INT fid FROM events), dim AS (SELECT least(max(fid)+1, 1024) d FROM f),
m AS (SELECT ix.n id, k.k::INT k, (f.fid IS NOT NULL)::INT::DOUBLE x FROM ix CROSS JOIN (SELECT unnest(range(0, (SELECT d FROM dim)::BIGINT)) k) k LEFT JOIN f ON f.id=ix.id AND f.fid=k.k),
sd AS (SELECT k, avg(x) a, stddev_pop(x) s FROM m GROUP BY k), y AS (SELECT label, dense_rank() OVER (ORDER BY label)-1 y FROM (SELECT DISTINCT label FROM embeddings JOIN ends ON id=vec_id))
"""


def _loaded(t: Fixtures) -> partition.GraphData:
    spark = t.nodes.sparkSession
    return datasets.sparse_graph(spark, _csv(t.edges, "edges"), _json(_fids(t)), _csv(t.labels, "labels"))


query("graph_load", _LOADED + "SELECT m.id, y.y::INT AS y, m.k, (x-a)/CASE WHEN s=0 THEN 1 ELSE s END AS x FROM m JOIN sd USING (k) JOIN ix ON ix.n=m.id JOIN embeddings ON vec_id=ix.id JOIN y USING (label)", ("x",))(lambda t: _loaded(t).nodes.select("id", "y", F.posexplode("x").alias("k", "x")))
query("graph_load_edges", _LOADED + "SELECT least(a.n, b.n) AS u, greatest(a.n, b.n) AS v FROM e JOIN ix a ON a.id=u JOIN ix b ON b.id=v")(lambda t: _loaded(t).edges)
query("synthetic_graph", doubles=("x",))(lambda t: datasets.synthetic_graph(t.nodes.sparkSession).nodes.select("id", "y", F.posexplode("x").alias("k", "x")))


def _streamed(t: Fixtures) -> DataFrame:
    """The round log read as a stream of files until nothing is left, summed up as a live view is."""
    spark = t.nodes.sparkSession
    source, out = scratch(spark, "stream"), scratch(spark, "live")
    rows = _record(t).select("round", "global_acc", "comms_mb")
    rows.write.parquet(source)
    live = round_log.latest(round_log.round_log(spark, source, rows.schema))

    def keep(batch: DataFrame, number: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(out)

    query = live.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", scratch(spark, "streamstate")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)


query("stream_round_log", "SELECT max(round) AS last_round, max(round(global_acc, 4)) AS best_acc, sum(round(comms_mb, 4)) AS comms_mb FROM rd", ("best_acc", "comms_mb"))(_streamed)


def _run_records(t: Fixtures) -> DataFrame:
    """Records of four runs, users by remainder: every day is a round, every kind of event a client."""
    rows = t.read("events").select(F.concat(F.lit("run"), F.col("user_id") % 4).alias("run"), F.to_date("ts").alias("day"), "event_type", "value")
    cells = rows.groupBy("run", "day", "event_type").agg(F.count("*").alias("n"), F.avg(F.col("value") / (1 + F.col("value"))).alias("acc"))
    days = rows.select("day").distinct().select("day", F.dense_rank().over(Window.orderBy("day")).cast("int").alias("round"))  # one row a day
    per = cells.groupBy("run", "day").agg((F.sum(F.col("acc") * F.col("n")) / F.sum("n")).alias("global_acc"), F.avg(0.5 + F.col("n") / 100.0).alias("mean_eps"), (F.count("*") * 25600 / 1024 / 1024).alias("comms_mb"))
    return per.join(days, "day").select("run", "round", "global_acc", "mean_eps", "comms_mb")


def _streamed_totals(t: Fixtures) -> DataFrame:
    """The records come in three feeds, each by a stream that starts again from the checkpoint: rounds come late, and
    the last feed repeats those of the first with other figures, which must not count."""
    spark = t.nodes.sparkSession
    source, out, state = (scratch(spark, x) for x in ("runs", "totals", "totalstate"))
    rows = written(_run_records(t), "records")
    for k in range(3):
        part = rows.where(F.col("round") * 7 % 3 == k)
        if k == 2:
            again = rows.where(F.col("round") * 7 % 3 == 0)
            part = part.unionByName(again.withColumns({c: F.col(c) + 1 for c in ("global_acc", "mean_eps", "comms_mb")}))
        part.write.mode("append").parquet(source)
        run_totals.feed(spark, source, out, state)
    return run_totals.totals(spark, out)


_RUNS = """(SELECT run, (dense_rank() OVER (ORDER BY d))::INT AS round, acc, eps, mb FROM (SELECT run, d, sum(a*n)/sum(n) acc, avg(0.5::DOUBLE+n/100.0::DOUBLE) eps, count(*)*25600/1024.0::DOUBLE/1024 mb
  FROM (SELECT 'run' || (user_id % 4) AS run, ts::DATE d, event_type, count(*) n, avg(value/(1+value)) a FROM events GROUP BY ALL) GROUP BY run, d))"""
query("stream_run_totals", f"SELECT run, round, sum(eps) OVER w AS cumulative_eps, sum(mb) OVER w AS total_mb, max(acc) OVER w AS best_acc, arg_max(round, (acc, -round)) OVER w AS best_round FROM {_RUNS} WINDOW w AS (PARTITION BY run ORDER BY round)", ("cumulative_eps", "total_mb", "best_acc"))(_streamed_totals)
