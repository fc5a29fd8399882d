"""The registry of queries over the reference's operators and their DuckDB equivalents.

Each entry applies an operator of ``skein.operators`` to a fixture made of the driver's tables:
E, the graph of ``embeddings`` (same-label neighbours and one long edge for each vector); T, customers
and suppliers joined by line items; P, customers by region; R, ``events`` by day and type as a round log;
U, every vector as a client's update.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions.hashing import digest, sketch_positions, uniform, uniform_of
from skein.functions.storage import written
from skein.operators import federate, generate, gnn, graph, learn, logs, modularity, partition, privacy, sketches, train
from skein.sources import datasets

SALT = bytes(16)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Fixtures:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")

    @property
    def nodes(self) -> DataFrame:
        return self.read("embeddings").select(F.col("vec_id").alias("id"))

    @property
    def pairs(self) -> DataFrame:
        rows = self.read("embeddings").select(F.col("vec_id").alias("a"), "label")
        w = Window.partitionBy("label").orderBy("a")
        near = rows.select("a", F.array(F.lead("a", 1).over(w), F.lead("a", 2).over(w)).alias("bs")).select("a", F.explode("bs").alias("b"))
        n = rows.agg(F.count("*").alias("n"))
        far = rows.join(F.broadcast(n)).select("a", ((F.col("a") * 7 + 3) % F.col("n")).alias("b"))
        return near.unionByName(far).where("a <> b")

    @property
    def edges(self) -> DataFrame:
        return graph.undirected_edges(self.pairs, "a", "b")

    @property
    def x(self) -> DataFrame:
        rows = self.read("embeddings").select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("k", "x"))
        return rows.select("id", "k", F.col("x").cast("double").alias("x"))

    @property
    def v(self) -> DataFrame:
        """id, x array<double>."""
        return self.read("embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda e: e.cast("double")).alias("x"))

    @property
    def labels(self) -> DataFrame:
        return self.read("embeddings").select(F.col("vec_id").alias("id"), "label")

    @property
    def a_hat(self) -> DataFrame:
        return graph.norm_adj(self.edges, self.nodes)

    @property
    def trade(self) -> DataFrame:
        most = self.read("customer").agg((F.max("c_custkey") + 1).alias("o"))
        rows = self.read("lineitem").join(self.read("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        return rows.join(F.broadcast(most)).select(F.col("o_custkey").alias("u"), (F.col("o") + F.col("l_suppkey")).alias("v")).distinct()

    @property
    def membership(self) -> DataFrame:
        rows = self.read("customer").join(F.broadcast(self.read("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
        return rows.select(F.col("n_regionkey").alias("cid"), F.col("c_custkey").alias("gid"))

    @property
    def log(self) -> DataFrame:
        rows = self.read("events").select(F.to_date("ts").alias("day"), "event_type", "value")
        cells = rows.groupBy("day", "event_type").agg(F.count("*").alias("n"), F.avg(F.col("value") / (1 + F.col("value"))).alias("val_acc"), F.avg(F.col("value") / (2 + F.col("value"))).alias("test_acc"), F.avg(F.col("value") / (1 + 2 * F.col("value"))).alias("val_f1"), F.avg(1 / (1 + F.col("value"))).alias("loss"))
        days = cells.select("day").distinct().select("day", F.dense_rank().over(Window.orderBy("day")).cast("int").alias("round"))
        rows = cells.join(F.broadcast(days), "day")
        return rows.select("round", F.col("event_type").alias("cid"), "n", "val_acc", "test_acc", "val_f1", "loss", (0.5 + F.col("n") / 100.0).alias("eps"))

    @property
    def rounds(self) -> DataFrame:
        return self.log.groupBy("round").agg((F.sum(F.col("val_acc") * F.col("n")) / F.sum("n")).alias("global_acc"), F.min("val_acc").alias("worst"), (F.max("val_acc") - F.min("val_acc")).alias("fairness_gap"), F.avg("eps").alias("mean_eps"), (F.count("*") * 25600 / 1024 / 1024).alias("comms_mb"))

    @property
    def updates(self) -> DataFrame:
        rows = self.read("embeddings")
        return rows.select(F.col("vec_id").alias("cid"), F.posexplode("embedding").alias("k", "w"), (10 + 3 * F.col("vec_id")).alias("n"), (0.1 * (F.col("label") + 1)).alias("loss")).withColumn("w", F.col("w").cast("double"))

    @property
    def predicted(self) -> DataFrame:
        """id, y, p: the values of a vector through softmax, one a class."""
        rows = self.read("embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("y"), F.transform("embedding", lambda v: v.cast("double")).alias("v"))
        return rows.select("id", "y", learn.softmax(F.col("v")).alias("p"))


    @property
    def clients(self) -> tuple[DataFrame, DataFrame]:
        """Five clients by community of the embedding graph, a tenth of the nodes shared."""
        found = partition.partition_federated(_graph(self), 5, 0.1, "42")
        return found.nodes, found.edges


# The same fixtures as common table expressions.
WITH = """WITH e0 AS (SELECT vec_id a, lead(vec_id,1) OVER (PARTITION BY label ORDER BY vec_id) b FROM embeddings
  UNION ALL SELECT vec_id, lead(vec_id,2) OVER (PARTITION BY label ORDER BY vec_id) FROM embeddings
  UNION ALL SELECT vec_id, (vec_id*7+3) % (SELECT count(*) FROM embeddings) FROM embeddings),
e AS (SELECT DISTINCT least(a,b) u, greatest(a,b) v FROM e0 WHERE b IS NOT NULL AND a <> b),
adj AS (SELECT u i, v j FROM e UNION SELECT v, u FROM e UNION SELECT vec_id, vec_id FROM embeddings),
deg AS (SELECT i, count(*) c FROM adj GROUP BY i),
ahat AS (SELECT adj.i, adj.j, 1.0/sqrt((d1.c*d2.c)::DOUBLE) a FROM adj JOIN deg d1 ON adj.i=d1.i JOIN deg d2 ON adj.j=d2.i),
x AS (SELECT vec_id id, (generate_subscripts(embedding,1)-1)::INT k, unnest(embedding)::DOUBLE x FROM embeddings),
dg AS (SELECT vec_id id, coalesce(c,0)::BIGINT degree FROM embeddings LEFT JOIN (SELECT id, count(*) c FROM (SELECT u id FROM e UNION ALL SELECT v FROM e) GROUP BY id) z ON id=vec_id),
trade AS (SELECT DISTINCT o_custkey u, (SELECT max(c_custkey)+1 FROM customer)+l_suppkey v FROM lineitem JOIN orders ON l_orderkey=o_orderkey),
mem AS (SELECT n_regionkey cid, c_custkey gid FROM customer JOIN nation ON c_nationkey=n_nationkey),
lg0 AS (SELECT ts::DATE d, event_type cid, count(*) n, avg(value/(1+value)) val_acc, avg(value/(2+value)) test_acc, avg(value/(1+2*value)) val_f1, avg(1/(1+value)) loss FROM events GROUP BY 1,2),
lg AS (SELECT (dense_rank() OVER (ORDER BY d))::INT round, cid, n, val_acc, test_acc, val_f1, loss, 0.5::DOUBLE+n/100.0::DOUBLE eps FROM lg0),
rd AS (SELECT round, sum(val_acc*n)/sum(n) global_acc, min(val_acc) worst, max(val_acc)-min(val_acc) fairness_gap, avg(eps) mean_eps, count(*)*25600/1024.0::DOUBLE/1024 comms_mb FROM lg GROUP BY round),
upd AS (SELECT vec_id cid, (generate_subscripts(embedding,1)-1)::INT k, unnest(embedding)::DOUBLE w, 10+3*vec_id n, 0.1::DOUBLE*(label+1) loss FROM embeddings),
p0 AS (SELECT vec_id id, label y, generate_subscripts(embedding,1)-1 k, unnest(embedding)::DOUBLE v FROM embeddings),
p1 AS (SELECT id, y, k, v, exp(v - max(v) OVER (PARTITION BY id)) e FROM p0),
p AS (SELECT id, y, k, v, e/(sum(e) OVER (PARTITION BY id)+1e-10) p FROM p1),
pr AS (SELECT id, y, (max_by(k, (p, -k)))::INT pred FROM (SELECT id, y, k, p FROM p) GROUP BY id, y)
"""


def query(name: str, sql: str | None = None, doubles: tuple[str, ...] = ()):
    """Registers a query; columns in ``doubles`` are rounded to six places on both sides."""

    def add(f: Callable[[Fixtures], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            rows = f(Fixtures(spark, sf_dir))
            return rows.select(*[(F.round(c, 6) + 0.0).alias(c) if c in doubles else F.col(c) for c in rows.columns])

        QUERIES[name] = run
        if sql:
            cols = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in doubles)
            SQL[name] = f"{WITH} SELECT {f'* REPLACE ({cols})' if doubles else '*'} FROM ({sql}) q"
        return f

    return add


def col(sql: str, *names: str):
    return F.expr(sql).alias(names[0])


def _graph(t: Fixtures) -> partition.GraphData:
    """The embedding graph with its vectors as features and its labels."""
    classes = tuple(str(r["label"]) for r in t.labels.select("label").distinct().orderBy("label").collect())  # ten
    return partition.GraphData(t.v.join(t.labels.select("id", F.col("label").alias("y")), "id"), t.edges, classes)


# Graph
query("undirected_edges", "SELECT u, v FROM e")(lambda t: t.edges)
query("node_set", "SELECT u id FROM e UNION SELECT v FROM e")(lambda t: graph.node_set(t.edges))
query("node_index", "SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM (SELECT u id FROM trade UNION SELECT v FROM trade)")(lambda t: graph.node_index(graph.node_set(t.trade)))
query("edge_reindex", "SELECT a.idx iu, b.idx iv FROM trade JOIN (SELECT id, row_number() OVER (ORDER BY id)-1 idx FROM (SELECT u id FROM trade UNION SELECT v FROM trade)) a ON a.id=u JOIN (SELECT id, row_number() OVER (ORDER BY id)-1 idx FROM (SELECT u id FROM trade UNION SELECT v FROM trade)) b ON b.id=v")(lambda t: graph.reindexed(t.trade, graph.node_index(graph.node_set(t.trade))))
query("degree", "SELECT id, degree FROM dg")(lambda t: graph.degree(t.edges, t.nodes))
query("degree_features", "SELECT id, degree::DOUBLE AS x FROM dg")(lambda t: graph.degree(t.edges, t.nodes).select("id", F.col("degree").cast("double").alias("x")))
query("norm_degree", "SELECT i AS id, c AS degree FROM deg")(lambda t: graph.adjacency(t.edges, t.nodes).groupBy(F.col("i").alias("id")).agg(F.count("*").alias("degree")))
query("norm_adj", "SELECT i, j, a FROM ahat", ("a",))(lambda t: t.a_hat)
query("gcn_propagate", "SELECT i, k, sum(a*x) x FROM ahat JOIN x ON j=id GROUP BY i, k", ("x",))(lambda t: graph.propagate(t.a_hat, t.v).select(F.col("id").alias("i"), F.posexplode("x").alias("k", "x")))
query("induced_subgraph", "WITH ce AS (SELECT o_custkey u, lead(o_custkey) OVER (PARTITION BY o_orderdate::DATE ORDER BY o_orderkey) v FROM orders), ee AS (SELECT DISTINCT least(u,v) u, greatest(u,v) v FROM ce WHERE v IS NOT NULL) SELECT a.cid, ee.u, ee.v FROM ee JOIN mem a ON a.gid=ee.u JOIN mem b ON b.gid=ee.v AND a.cid=b.cid")(
    lambda t: graph.induced(graph.undirected_edges(t.read("orders").select(F.col("o_custkey").alias("a"), F.lead("o_custkey").over(Window.partitionBy(F.to_date("o_orderdate")).orderBy("o_orderkey")).alias("b")), "a", "b"), t.membership)
)
query("local_ids", "SELECT cid, gid, row_number() OVER (PARTITION BY cid ORDER BY gid)-1 AS lid FROM mem")(lambda t: graph.local_ids(t.membership))
query("split_masks", "SELECT cid, gid, CASE WHEN rn<=floor(0.6::DOUBLE*n) THEN 'train' WHEN rn<=floor(0.6::DOUBLE*n)+floor(0.2::DOUBLE*n) THEN 'val' ELSE 'test' END AS split FROM (SELECT cid, gid, row_number() OVER (PARTITION BY cid ORDER BY sha256('42|'||gid), gid) rn, count(*) OVER (PARTITION BY cid) n FROM mem)")(
    lambda t: graph.split_masks(t.membership, F.sha2(F.concat(F.lit("42|"), F.col("gid").cast("string")).cast("binary"), 256))
)
_lpa = ", ".join(f"l{r} AS (SELECT i id, l FROM (SELECT i, l, row_number() OVER (PARTITION BY i ORDER BY n DESC, l) rk FROM (SELECT adj.i, l{r - 1}.l, count(*) n FROM adj JOIN l{r - 1} ON adj.j=l{r - 1}.id GROUP BY adj.i, l{r - 1}.l)) WHERE rk=1)" for r in range(1, 4))
_LPA = f"WITH l0 AS (SELECT vec_id id, vec_id l FROM embeddings), {_lpa} "
query("communities_lpa", _LPA + "SELECT id, l AS label FROM l3")(lambda t: graph.label_propagation(graph.adjacency(t.edges, t.nodes), t.nodes, 3))
query("community_assign", _LPA + ", s AS (SELECT l, ((row_number() OVER (ORDER BY count(*) DESC, l)-1) % 5)::INT cid FROM l3 GROUP BY l) SELECT id AS gid, cid FROM l3 JOIN s USING (l)")(
    lambda t: graph.community_clients(graph.label_propagation(graph.adjacency(t.edges, t.nodes), t.nodes, 3), 5)
)
_POOL = "SELECT cid, gid FROM mem ORDER BY sha256('7|'||gid), gid LIMIT (SELECT floor(count(*)*0.1::DOUBLE)::BIGINT FROM mem)"


def _by_hash(seed: str):
    return F.sha2(F.concat(F.lit(f"{seed}|"), F.col("gid").cast("string")).cast("binary"), 256)


query("overlap_pool", _POOL)(lambda t: graph.sampled(t.membership, 0.1, _by_hash("7")))
query("overlap_inject", f"WITH pool AS ({_POOL}), second AS (SELECT ((cid+1+floor(((('0x'||substr(sha256('9|'||gid),1,13))::UBIGINT::DOUBLE+0.5)/4503599627370496)*4))::INT % 5) cid, gid FROM pool), u AS (SELECT cid, gid FROM mem UNION SELECT cid, gid FROM second) SELECT u.cid, u.gid, pool.gid IS NOT NULL AS is_overlap FROM u LEFT JOIN pool ON pool.gid=u.gid")(
    lambda t: graph.overlapping(t.membership, 5, 0.1, _by_hash("7"), uniform(F.lit("9"), F.col("gid")))
)
query("random_partition", "SELECT gid, least(((rn-1)//(n//5)),4)::INT AS cid FROM (SELECT gid, row_number() OVER (ORDER BY sha256('3|'||gid), gid) rn, count(*) OVER () n FROM mem)")(
    lambda t: graph.equal_clients(t.membership, 5, _by_hash("3"))
)
query("overlap_owner", f"SELECT pool.gid, pool.cid AS owner FROM ({_POOL}) pool")(lambda t: graph.second_client(graph.sampled(t.membership, 0.1, _by_hash("7")), 5, uniform(F.lit("9"), F.col("gid"))).select("gid", "owner"))
query("global_summary", "SELECT (SELECT count(*) FROM embeddings) num_nodes, (SELECT count(*) FROM e) num_edges, (SELECT max(label)+1 FROM embeddings)::INT num_classes, (SELECT max(len(embedding)) FROM embeddings)::INT in_dim, 5 AS num_clients, (SELECT string_agg(label, ',' ORDER BY label) FROM (SELECT DISTINCT label FROM embeddings)) label_classes")(
    lambda t: partition.global_summary(_graph(t), 5).withColumn("label_classes", F.array_join("label_classes", ","))
)

# Features, labels, scalars
query("label_lookup", "SELECT id, coalesce(c_mktsegment, 'unknown') AS label FROM (SELECT u id FROM trade UNION SELECT v FROM trade) LEFT JOIN customer ON c_custkey=id")(
    lambda t: graph.node_set(t.trade).join(t.read("customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("l")), "id", "left").select("id", F.coalesce("l", F.lit("unknown")).alias("label"))
)
query("label_encode", "SELECT c_mktsegment AS label, (dense_rank() OVER (ORDER BY c_mktsegment)-1)::INT AS code FROM (SELECT DISTINCT c_mktsegment FROM customer)")(lambda t: learn.label_codes(t.read("customer").select(F.col("c_mktsegment").alias("label")), "label"))
query("standard_scale", "SELECT id, k, (x-m)/CASE WHEN s=0 THEN 1 ELSE s END AS x FROM x JOIN (SELECT k, avg(x) m, stddev_pop(x) s FROM x GROUP BY k) USING (k)", ("x",))(lambda t: learn.standard_scale(t.x))
_FEATURES = "SELECT DISTINCT user_id id, (json_extract_string(props, '$.k'))::INT fid FROM events"
_features = lambda t: t.read("events").select(F.col("user_id").alias("id"), F.get_json_object("props", "$.k").cast("int").alias("fid")).distinct()
query("features_json", _FEATURES)(_features)
query("feature_dim", f"SELECT least(max(fid)+1, 1024)::INT AS dim FROM ({_FEATURES})")(lambda t: _features(t).agg(F.least(F.max("fid") + 1, F.lit(1024)).cast("int").alias("dim")))
query("features_capped", f"SELECT id, fid FROM ({_FEATURES}) WHERE fid < least((SELECT max(fid)+1 FROM ({_FEATURES})), 1024)")(lambda t: _features(t).where(F.col("fid") < datasets.feature_size(_features(t), 1024)))
query("features_semi", f"SELECT id, fid FROM ({_FEATURES}) WHERE id IN (SELECT gid FROM mem)")(lambda t: _features(t).join(t.membership.select(F.col("gid").alias("id")), "id", "left_semi"))
query("client_features", f"SELECT cid, gid, count(fid) AS n_features FROM mem LEFT JOIN ({_FEATURES}) f ON f.id=gid GROUP BY cid, gid")(lambda t: t.membership.join(_features(t).withColumnRenamed("id", "gid"), "gid", "left").groupBy("cid", "gid").agg(F.count("fid").alias("n_features")))
query("attr_cast", "SELECT event_id, coalesce(try_cast(event_type AS DOUBLE), 0) AS a, coalesce(try_cast(user_id::VARCHAR AS DOUBLE), 0) AS b FROM events")(lambda t: t.read("events").select("event_id", col("coalesce(try_cast(event_type AS double), 0D)", "a"), col("coalesce(try_cast(cast(user_id AS string) AS double), 0D)", "b")))
query("edge_key", "SELECT u, v, least(u,v)||'-'||greatest(u,v) AS key FROM e")(lambda t: t.edges.select("u", "v", privacy.edge_key(F.col("u"), F.col("v")).alias("key")))
query("emb_clip", "SELECT id, k, greatest(-1, least(1, x)) AS x FROM x", ("x",))(lambda t: t.x.select("id", "k", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("x"))).alias("x")))

# Vectors and models
_vector = lambda t: t.read("embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("v"))
query("relu", "SELECT id, k, greatest(0, x) AS x FROM x", ("x",))(lambda t: _vector(t).select("id", F.posexplode(learn.relu(F.col("v"))).alias("k", "x")))
query("leaky_relu", "SELECT id, k, CASE WHEN x>=0 THEN x ELSE 0.2::DOUBLE*x END AS x FROM x", ("x",))(lambda t: _vector(t).select("id", F.posexplode(learn.leaky_relu(F.col("v"))).alias("k", "x")))
query("softmax", "SELECT id, k::INT AS k, p FROM p", ("p",))(lambda t: t.predicted.select("id", F.posexplode("p").alias("k", "p")))
query("cross_entropy", "SELECT avg(-ln(p+1e-10)) AS loss FROM p WHERE k=y", ("loss",))(lambda t: t.predicted.agg(learn.cross_entropy("p", "y").alias("loss")))
query("accuracy", "SELECT avg((pred=y)::INT::DOUBLE) AS acc FROM pr", ("acc",))(lambda t: t.predicted.agg(F.avg((learn.argmax(F.col("p")) == F.col("y")).cast("double")).alias("acc")))
query("f1_macro", "SELECT avg(2*p*r/(p+r+1e-10)) AS f1 FROM (SELECT tp/(said+1e-10) p, tp/(pos+1e-10) r FROM (SELECT y, count(*) pos, count(*) FILTER (pred=y) tp FROM pr GROUP BY y) a LEFT JOIN (SELECT pred, count(*) said FROM pr GROUP BY pred) b ON a.y=b.pred)".replace("tp/(said+1e-10)", "tp/(coalesce(said,0)+1e-10)"), ("f1",))(lambda t: learn.macro_f1(t.predicted.select("y", learn.argmax(F.col("p")).alias("pred"))))
query("dropout", "SELECT id, k, CASE WHEN (('0x'||substr(sha256('5|'||id||'|'||k),1,13))::UBIGINT::DOUBLE+0.5)/4503599627370496 > 0.5 THEN x/0.5::DOUBLE ELSE 0 END AS x FROM x", ("x",))(lambda t: t.x.select("id", "k", F.when(uniform(F.lit("5"), F.col("id"), F.col("k")) > 0.5, F.col("x") / 0.5).otherwise(0.0).alias("x")))
_W = "(('0x'||substr(sha256('{s}|'||{a}||'|'||{b}),1,13))::UBIGINT::DOUBLE+0.5)/4503599627370496-0.5::DOUBLE"
def _matrix(seed: str, rows: int, cols: int) -> list[list[float]]:
    """Weights that SQL can make as well."""
    return [[uniform_of(seed, r, c) - 0.5 for c in range(cols)] for r in range(rows)]


def _size(t: Fixtures) -> int:
    return t.v.agg(F.max(F.size("x"))).first()[0]


query("matmul", f"SELECT x.id, c::INT AS c, sum(x*({_W.format(s='w0', a='k', b='c')})) AS x FROM x, range(8) r(c) GROUP BY x.id, c", ("x",))(lambda t: graph.multiply(t.v, _matrix("w0", _size(t), 8)).select("id", F.posexplode("x").alias("c", "x")))


def _gcn(t: Fixtures) -> DataFrame:
    """softmax(A relu(A X W0) W1) with hidden size 8 and 10 classes and weights made of hashes."""
    return gnn.gcn_forward(t.a_hat, t.v, _matrix("w0", _size(t), 8), _matrix("w1", 8, 10)).select("id", F.posexplode("p").alias("k", "p"))


query("gcn_forward", f"WITH xw AS (SELECT x.id, c::INT k, sum(x*({_W.format(s='w0', a='k', b='c')})) x FROM x, range(8) r(c) GROUP BY x.id, c), h AS (SELECT i id, k, greatest(0, sum(a*x)) x FROM ahat JOIN xw ON j=id GROUP BY i, k), hw AS (SELECT h.id, c::INT k, sum(x*({_W.format(s='w1', a='k', b='c')})) x FROM h, range(10) r(c) GROUP BY h.id, c), z AS (SELECT i id, k, sum(a*x) x FROM ahat JOIN hw ON j=id GROUP BY i, k), y AS (SELECT id, k, exp(x-max(x) OVER (PARTITION BY id)) ex FROM z) SELECT id, k, ex/(sum(ex) OVER (PARTITION BY id)+1e-10) AS p FROM y", ("p",))(_gcn)


# Aggregation of updates
query("fedavg", "SELECT k, sum(w*n)/sum(n) AS w FROM upd GROUP BY k", ("w",))(lambda t: federate.fedavg(t.updates))
query("qfedavg", "SELECT k, sum(w*wt)/(sum(wt)+1e-10) AS w FROM (SELECT *, n::DOUBLE*pow(loss+0.001::DOUBLE, 0.3::DOUBLE) wt FROM upd) GROUP BY k", ("w",))(lambda t: federate.qfedavg(t.updates))
query("krum_dist", "SELECT a.cid i, b.cid j, sum((a.w-b.w)*(a.w-b.w)) AS d FROM upd a JOIN upd b ON a.k=b.k AND a.cid<>b.cid GROUP BY 1,2", ("d",))(lambda t: federate.distances(t.updates))
_KRUM = "WITH dist AS (SELECT a.cid i, b.cid j, sum((a.w-b.w)*(a.w-b.w)) d FROM upd a JOIN upd b ON a.k=b.k AND a.cid<>b.cid GROUP BY 1,2), rk AS (SELECT i, d, row_number() OVER (PARTITION BY i ORDER BY d, j) rn FROM dist), sc AS (SELECT i cid, sum(d) score FROM rk WHERE rn<=(SELECT count(DISTINCT cid) FROM upd)-3 GROUP BY i) "
query("krum_scores", _KRUM + "SELECT cid, score FROM sc", ("score",))(lambda t: federate.krum_scores(t.updates))
query("krum", _KRUM + "SELECT k, w FROM upd WHERE cid=(SELECT cid FROM sc ORDER BY round(score, 9), cid LIMIT 1)", ("w",))(lambda t: federate.krum(t.updates))
query("krum_fallback", "SELECT k, sum(w*n)/sum(n) AS w FROM upd GROUP BY k", ("w",))(lambda t: federate.krum(t.updates, f=t.nodes.count()))
query("trimmed_mean", "SELECT k, avg(w) AS w FROM (SELECT k, w, row_number() OVER (PARTITION BY k ORDER BY w, cid) rn, count(*) OVER (PARTITION BY k) m FROM upd) WHERE rn>greatest(1, floor(m*0.1::DOUBLE)) AND rn<=m-greatest(1, floor(m*0.1::DOUBLE)) GROUP BY k", ("w",))(lambda t: federate.trimmed_mean(t.updates))
query("coordinate_median", "SELECT k, median(w) AS w FROM upd GROUP BY k", ("w",))(lambda t: federate.coordinate_median(t.updates))
query("clip_update", "SELECT cid, k, CASE WHEN norm>1 THEN w*(1.0::DOUBLE/norm) ELSE w END AS w FROM upd JOIN (SELECT cid, sqrt(sum(w*w)) norm FROM upd GROUP BY cid) USING (cid)", ("w",))(lambda t: federate.clip_update(t.updates))
query("axpy", "SELECT a.k, a.w+0.5::DOUBLE*coalesce(b.w,0) AS w FROM (SELECT k, sum(w*n)/sum(n) w FROM upd GROUP BY k) a LEFT JOIN (SELECT k, w FROM (SELECT k, median(w) w FROM upd GROUP BY k) WHERE w>0) b ON a.k=b.k", ("w",))(lambda t: federate.add_scaled(federate.fedavg(t.updates), federate.coordinate_median(t.updates).where("w > 0"), 0.5))
query("aggregate_all", _KRUM + """SELECT 'fedavg' AS method, k, sum(w*n)/sum(n) AS w FROM upd GROUP BY k UNION ALL SELECT 'median', k, median(w) FROM upd GROUP BY k
  UNION ALL SELECT 'qfedavg', k, sum(w*wt)/(sum(wt)+1e-10) FROM (SELECT *, n::DOUBLE*pow(loss+0.001::DOUBLE, 0.3::DOUBLE) wt FROM upd) GROUP BY k
  UNION ALL SELECT 'krum', k, w FROM upd WHERE cid=(SELECT cid FROM sc ORDER BY round(score, 9), cid LIMIT 1)
  UNION ALL SELECT 'trimmed_mean', k, avg(w) FROM (SELECT k, w, row_number() OVER (PARTITION BY k ORDER BY w, cid) rn, count(*) OVER (PARTITION BY k) m FROM upd) WHERE rn>greatest(1, floor(m*0.1::DOUBLE)) AND rn<=m-greatest(1, floor(m*0.1::DOUBLE)) GROUP BY k""", ("w",))(
    lambda t: reduce(DataFrame.unionByName, [federate.aggregate(t.updates, m).select(F.lit(m).alias("method"), "k", "w") for m in federate.METHODS])
)

# Privacy and sketches
query("degree_sensitivity", "SELECT id, degree/(SELECT max(degree) FROM dg)::DOUBLE AS sens FROM dg", ("sens",))(lambda t: privacy.sensitivity(graph.degree(t.edges, t.nodes)))
query("node_epsilon", "SELECT id, least(2, greatest(0.5, 2-degree/(SELECT max(degree) FROM dg)::DOUBLE*1.5)) AS eps FROM dg", ("eps",))(lambda t: privacy.sensitivity(graph.degree(t.edges, t.nodes)).select("id", privacy.epsilon(F.col("sens")).alias("eps")))
_U = "(('0x'||substr(sha256('42|'||id||'|'||k),1,13))::UBIGINT::DOUBLE+0.5)/4503599627370496-0.5::DOUBLE"
query("laplace_noise", f"SELECT id, k, greatest(-1,least(1,x)) + (-(1/eps)*sign(u)*ln(1-2*abs(u))) AS x FROM (SELECT id, k, x, {_U} u, least(2::DOUBLE, greatest(0.5::DOUBLE, 2-degree/(SELECT max(degree) FROM dg)::DOUBLE*1.5::DOUBLE)) eps FROM x JOIN dg USING (id))", ("x",))(
    lambda t: privacy.noisy(t.x.join(privacy.sensitivity(graph.degree(t.edges, t.nodes)).select("id", privacy.epsilon(F.col("sens")).alias("eps")), "id"))
)


def _same_label(t: Fixtures) -> DataFrame:
    """Edges whose ends have the same label."""
    a, b = t.labels.select(F.col("id").alias("u"), F.col("label").alias("a")), t.labels.select(F.col("id").alias("v"), F.col("label").alias("b"))
    return t.edges.join(a, "u").join(b, "v").where("a = b").select("u", "v")


_POS = "SELECT u, v, i::INT AS i, (('0x'||substr(sha256(unhex(lpad(hex(i),8,'0'))||unhex(repeat('00',16))||encode(least(u,v)||'-'||greatest(u,v))),1,16))::UBIGINT % 8192)::INT AS pos FROM e, range(4) r(i)"
query("bloom_positions", _POS)(lambda t: t.edges.select("u", "v", F.posexplode(sketch_positions(SALT, privacy.edge_key(F.col("u"), F.col("v")), 8192, 4)).alias("i", "pos")))
_SAME = "e JOIN embeddings ea ON ea.vec_id=u JOIN embeddings eb ON eb.vec_id=v WHERE ea.label=eb.label"
query("bloom_contains", f"WITH near AS (SELECT u, v FROM {_SAME}), b AS (SELECT DISTINCT pos FROM ({_POS}) JOIN near USING (u, v)) SELECT u, v, bool_and(b.pos IS NOT NULL) AS found FROM ({_POS}) q LEFT JOIN b ON b.pos=q.pos GROUP BY u, v")(lambda t: privacy.might_contain(t.edges, privacy.sketch(_same_label(t), SALT), SALT))
query("bloom_density", f"SELECT count(DISTINCT pos)/8192.0::DOUBLE AS density FROM ({_POS})", ("density",))(lambda t: sketches.density(privacy.sketch(t.edges, SALT)))
query("bloom_fpr", "SELECT pow(1-exp(-4*count(*)/8192.0::DOUBLE), 4) AS fpr FROM e", ("fpr",))(lambda t: t.edges.agg(F.pow(1 - F.exp(-4 * F.count("*") / 8192), F.lit(4.0)).alias("fpr")))
query("privacy_ledger", "SELECT round, mean_eps, sum(mean_eps) OVER (ORDER BY round) AS cumulative_eps FROM rd", ("mean_eps", "cumulative_eps"))(lambda t: privacy.ledger(t.log))

# Round logs
query("log_scan", "SELECT round, global_acc, worst, fairness_gap, mean_eps, comms_mb FROM rd", ("global_acc", "worst", "fairness_gap", "mean_eps", "comms_mb"))(lambda t: t.rounds)
query("weighted_metrics", "SELECT round, sum(val_acc*n)/sum(n) AS val_acc, sum(loss*n)/sum(n) AS loss FROM lg GROUP BY round", ("val_acc", "loss"))(lambda t: logs.weighted_metrics(t.log, ["val_acc", "loss"]))
query("fairness_metrics", "SELECT round, avg(val_acc) AS mean_acc, min(val_acc) AS min_acc, max(val_acc) AS max_acc, stddev_pop(val_acc) AS std_acc, max(val_acc)-min(val_acc) AS gap FROM lg GROUP BY round", ("mean_acc", "min_acc", "max_acc", "std_acc", "gap"))(lambda t: logs.fairness(t.log))
query("comm_cost", "SELECT round, count(*)*25600/1024.0::DOUBLE/1024 AS comms_mb FROM lg GROUP BY round", ("comms_mb",))(lambda t: logs.communication(t.log, 4352, 8192))
query("cumulative_comms", "SELECT round, sum(comms_mb) OVER (ORDER BY round) AS total_mb FROM rd", ("total_mb",))(lambda t: logs.cumulative(t.rounds, "comms_mb", "total_mb"))
_RECORD = """(SELECT round, round(sum(val_acc*n)/sum(n), 4) global_acc, round(sum(test_acc*n)/sum(n), 4) global_test_acc, round(sum(val_f1*n)/sum(n), 4) global_f1,
  round(min(val_acc), 4) worst_client_f1, round(max(val_acc), 4) best_client_f1, round(max(val_acc)-min(val_acc), 4) fairness_gap, round(avg(eps), 4) mean_eps,
  round(sum(avg(eps)) OVER (ORDER BY round), 4) cumulative_eps, round(count(*)*25600/1024.0::DOUBLE/1024, 4) comms_mb, round(sum(n)/100.0::DOUBLE, 2) round_time_s FROM lg GROUP BY round)"""
_RECORDED = ("global_acc", "global_test_acc", "global_f1", "worst_client_f1", "best_client_f1", "fairness_gap", "mean_eps", "cumulative_eps", "comms_mb", "round_time_s")


def _record(t: Fixtures) -> DataFrame:
    """The whole round log; a round's seconds are a hundredth of its events."""
    rows = t.log.withColumn("bytes", F.lit(25600).cast("long"))
    return logs.round_records(rows, rows.groupBy("round").agg((F.sum("n") / 100.0).alias("seconds")))


query("round_log", f"SELECT * FROM {_RECORD}", _RECORDED)(_record)
query("best_round", f"SELECT max_by(round, (global_acc, -round)) AS best_round, max(global_acc) AS best_acc, max_by(global_test_acc, (global_acc, -round)) AS test_acc, min(worst_client_f1) AS worst_client, sum(comms_mb) AS total_mb, max_by(cumulative_eps, round) AS final_eps FROM {_RECORD}", ("best_acc", "test_acc", "worst_client", "total_mb", "final_eps"))(lambda t: logs.run_summary(_record(t)))
query("log_project", f"SELECT round, global_acc, global_f1, worst_client_f1, fairness_gap, cumulative_eps, comms_mb, round_time_s FROM {_RECORD}", _RECORDED[:1] + _RECORDED[2:4] + ("fairness_gap", "cumulative_eps", "comms_mb", "round_time_s"))(lambda t: logs.project(_record(t), [*logs.SHOWN, "no_such_column"]))
query("log_numeric_cols", "SELECT unnest(['global_acc', 'global_test_acc', 'global_f1', 'worst_client_f1', 'best_client_f1', 'fairness_gap', 'mean_eps', 'cumulative_eps', 'comms_mb', 'round_time_s']) AS name")(lambda t: t.nodes.sparkSession.createDataFrame([(c,) for c in logs.numeric_columns(_record(t))], "name string"))
query("log_kpis", "SELECT max(global_acc) AS best_acc, max_by(worst, round) AS last_worst, sum(comms_mb) AS total_mb, max_by(fairness_gap, round) AS last_gap, min(fairness_gap) AS best_gap FROM rd", ("best_acc", "last_worst", "total_mb", "last_gap", "best_gap"))(lambda t: t.rounds.agg(F.max("global_acc").alias("best_acc"), F.max_by("worst", "round").alias("last_worst"), F.sum("comms_mb").alias("total_mb"), F.max_by("fairness_gap", "round").alias("last_gap"), F.min("fairness_gap").alias("best_gap")))
query("log_latest", "SELECT round, global_acc FROM rd ORDER BY round DESC LIMIT 1", ("global_acc",))(lambda t: logs.tail(t.rounds, 1).select("round", "global_acc"))
query("log_tail5", "SELECT round, global_acc FROM rd ORDER BY round DESC LIMIT 5", ("global_acc",))(lambda t: logs.tail(t.rounds, 5).select("round", "global_acc"))
query("log_highlight", "SELECT round, global_acc, global_acc=max(global_acc) OVER () AS is_max, global_acc=min(global_acc) OVER () AS is_min FROM rd", ("global_acc",))(lambda t: logs.highlighted(t.rounds, "global_acc"))
query("log_series", "SELECT round, 'global_acc' AS metric, global_acc AS value FROM rd UNION ALL SELECT round, 'worst', worst FROM rd", ("value",))(lambda t: t.rounds.unpivot("round", ["global_acc", "worst"], "metric", "value"))
query("eps_series", "SELECT round, mean_eps AS per_round_eps FROM rd", ("per_round_eps",))(lambda t: t.rounds.select("round", F.col("mean_eps").alias("per_round_eps")))
query("ablation_summary", f"SELECT (round % 3)::INT AS config, max(global_acc) AS best_val_acc, max_by(global_test_acc, (global_acc, -round)) AS best_test_acc, min(worst_client_f1) AS worst_client, max(fairness_gap) AS fairness_gap, max_by(cumulative_eps, round) AS final_eps, sum(comms_mb) AS total_comms_mb FROM {_RECORD} GROUP BY round % 3", ("best_val_acc", "best_test_acc", "worst_client", "fairness_gap", "final_eps", "total_comms_mb"))(lambda t: logs.ablation_summary(_record(t).withColumn("config", (F.col("round") % 3).cast("int"))))
query("client_sampling", "SELECT cid FROM (SELECT DISTINCT cid FROM lg) ORDER BY sha256('11|'||cid) LIMIT 3")(lambda t: t.log.select("cid").distinct().orderBy(F.sha2(F.concat(F.lit("11|"), F.col("cid")).cast("binary"), 256)).limit(3))

# Generated graphs and training with the defaults; no SQL. Attention is trained by differences, two runs of the
# network a weight, so its query has few weights.
_DEFAULT = train.Config()
query("communities_greedy")(lambda t: generate.greedy_communities(t.edges, t.nodes))
query("communities_modularity")(lambda t: modularity.modularity_communities(t.edges, t.nodes))
query("ba_graph", doubles=())(lambda t: generate.preferential_graph(t.nodes.sparkSession, 1000))
query("block_features", doubles=("x",))(lambda t: generate.block_features(t.labels.select("id", F.col("label").alias("y")), 64, 10))


def _updated(t: Fixtures, cfg: train.Config) -> DataFrame:
    nodes, edges = t.clients
    features, classes = nodes.agg(F.max(F.size("x")), F.max("y") + 1).first()
    return train.client_updates(written(nodes, "clients"), edges, train.initial(train.shapes(cfg, features, classes), cfg.seed), cfg, classes)


query("client_train")(lambda t: _updated(t, _DEFAULT).drop("w", "overlap"))
query("sgd_step", doubles=("w",))(lambda t: train.long_updates(_updated(t, _DEFAULT)).select("cid", "k", "w"))
query("gat_train")(lambda t: _updated(t, train.Config(model="gat", hidden=8, heads=2, local_epochs=1)).drop("w", "overlap"))
query("federated_run")(lambda t: train.federated_run(*t.clients, _DEFAULT).log.drop("round_time_s"))
query("ablation_run")(lambda t: train.ablation(*t.clients))


def _all() -> None:
    """The other modules register their queries when they are imported."""
    from skein.plans import federated  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(SQL)
