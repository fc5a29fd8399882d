"""Client training of graph networks and the federated loop.

A client is a group of rows: its nodes (cid, gid, x array<double>, y, split) and the edges between them
(cid, u, v by gid). Clients train side by side, one task each, from weights that the closure carries (a
few kilobytes, whatever the data); what comes back is one row a client, aggregated as a DataFrame. A
client's graph has to fit one task, a whole graph never does.

A network's weights are one flat vector; ``shapes`` says where its matrices lie. Randomness comes from
generators seeded by (seed, round, client), so a lost task repeats its own work exactly.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.storage import removed, written
from skein.operators import federate, logs, privacy
from skein.sources.sinks import RunStore

#: What a client sends back.
FIELDS = {
    "cid": "long", "w": "array<double>", "num_train": "long", "train_loss": "double", "val_acc": "double", "test_acc": "double", "val_f1": "double",
    "mean_eps": "double", "comm_bytes": "long", "overlap": "array<struct<gid: long, z: array<double>>>",
}
UPDATE = ", ".join(f"{name} {kind}" for name, kind in FIELDS.items())
LOG = "round int, global_acc double, global_test_acc double, global_f1 double, worst_client_f1 double, best_client_f1 double, fairness_gap double, mean_eps double, cumulative_eps double, comms_mb double, round_time_s double"


@dataclass(frozen=True)
class Config:
    """What a run does; ``method`` and ``options`` are those of ``federate.aggregate``."""

    model: str = "gcn"
    hidden: int = 64
    heads: int = 4
    dropout: float = 0.5
    rounds: int = 20
    local_epochs: int = 5
    fraction: float = 1.0
    rate: float = 0.01
    clip: float = 1.0
    method: str = "fedavg"
    options: tuple[tuple[str, float], ...] = ()
    eps_least: float = 0.5
    eps_most: float = 2.0
    #: Whether shared nodes' embeddings are sent, with noise, and whether a sketch of the edges is.
    noise: bool = True
    emb_clip: float = 1.0
    sketch: bool = True
    sketch_bits: int = 8192
    sketch_hashes: int = 4
    #: Whether rows outside the training mask are left out of the GCN's gradient; the results to match have them in.
    masked: bool = False
    seed: int = 42


def shapes(cfg: Config, features: int, classes: int) -> list[tuple[int, int]]:
    if cfg.model == "gcn":
        return [(features, cfg.hidden), (cfg.hidden, classes)]
    if cfg.model == "gat":
        if cfg.hidden % cfg.heads:
            raise ValueError("heads must divide the hidden size")
        per = cfg.hidden // cfg.heads
        layer = [(features, per), (per, 1), (per, 1)] * cfg.heads
        return layer + [(cfg.hidden, classes), (classes, 1), (classes, 1), (classes, classes)]
    raise ValueError(f"no model {cfg.model}")


def cut(flat: np.ndarray, sizes: list[tuple[int, int]]) -> list[np.ndarray]:
    ends = np.cumsum([a * b for a, b in sizes])
    return [part.reshape(s) for part, s in zip(np.split(flat, ends[:-1]), sizes, strict=True)]


def initial(sizes: list[tuple[int, int]], seed: int) -> np.ndarray:
    """Uniform within sqrt(6 / (rows + columns)) for each matrix."""
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.uniform(-1, 1, a * b) * np.sqrt(6 / (a + b)) for a, b in sizes])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / (e.sum(axis=1, keepdims=True) + 1e-10)


class Graph:
    """One client's nodes, 0 to n - 1, and its edges."""

    def __init__(self, x: np.ndarray, y: np.ndarray, split: np.ndarray, u: np.ndarray, v: np.ndarray):
        self.x, self.y, self.split, self.u, self.v, self.n = x, y, split, u, v, len(x)
        ids, n = np.arange(self.n), max(self.n, 1)
        u, v = (np.asarray(x, np.int64) for x in (u, v))
        self.i, self.j = np.divmod(np.unique(np.concatenate([u * n + v, v * n + u, ids * n + ids])), n)
        d = np.bincount(self.i, minlength=self.n)
        self.a = 1 / np.sqrt(d[self.i] * d[self.j]) if len(self.i) else np.zeros(0)
        #: Where each node's neighbours begin; every node has itself.
        self.starts = np.searchsorted(self.i, ids)

    def spread(self, h: np.ndarray) -> np.ndarray:
        """The normalised adjacency times h."""
        return np.add.reduceat(self.a[:, None] * h[self.j], self.starts, axis=0) if self.n else np.zeros((0, h.shape[1]))

    @cached_property
    def around(self) -> np.ndarray:
        """The normalised adjacency times the features, the same in every epoch."""
        return self.spread(self.x)

    def attend(self, h: np.ndarray, w: np.ndarray, to: np.ndarray, at: np.ndarray) -> np.ndarray:
        """One attention head: every node's out-neighbours, by the softmax of their scores; h w without any."""
        out = h @ w
        if not len(self.u):
            return out
        score = (out[self.u] @ to + out[self.v] @ at)[:, 0]
        score = np.where(score >= 0, score, 0.2 * score)
        top = np.full(self.n, -np.inf)
        np.maximum.at(top, self.u, score)
        e = np.exp(score - top[self.u])
        share = e / (np.bincount(self.u, e, self.n)[self.u] + 1e-10)
        mixed = np.zeros_like(out)
        np.add.at(mixed, self.u, share[:, None] * out[self.v])
        return np.where(np.isfinite(top)[:, None], mixed, out)


def forward(cfg: Config, g: Graph, parts: list[np.ndarray], rng: np.random.Generator | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Class probabilities and hidden values; a generator turns dropout on (GCN alone has it)."""

    def dropped(h: np.ndarray) -> np.ndarray:
        return h if rng is None or not cfg.dropout else h * (rng.random(h.shape) > cfg.dropout) / (1 - cfg.dropout)

    if cfg.model == "gcn":
        hidden = dropped(np.maximum(g.spread(dropped(g.x)) @ parts[0], 0))
        return _softmax(g.spread(hidden) @ parts[1]), hidden
    heads = [g.attend(g.x, *parts[3 * k : 3 * k + 3]) for k in range(cfg.heads)]
    hidden = np.maximum(np.concatenate(heads, axis=1), 0)
    return _softmax(g.attend(hidden, *parts[3 * cfg.heads : 3 * cfg.heads + 3])), hidden


def loss_of(probs: np.ndarray, y: np.ndarray, mask: np.ndarray) -> float:
    return float(-np.log(probs[mask, y[mask]] + 1e-10).mean()) if mask.any() else 0.0


def _within(grad: np.ndarray, most: float) -> np.ndarray:
    size = np.linalg.norm(grad)
    return grad * (most / size) if size > most else grad


def gradient(cfg: Config, g: Graph, flat: np.ndarray, sizes: list[tuple[int, int]], mask: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """Clipped gradient and the loss before the step.

    GCN: in closed form, clipped for each matrix. Rows outside the mask contribute their probabilities
    unless ``masked``; dropout isn't traced back, as the results to match have it. GAT: central differences on a random
    tenth of the weights, clipped as a whole.
    """
    if cfg.model == "gcn":
        w0, w1 = cut(flat, sizes)
        probs, hidden = forward(cfg, g, [w0, w1], rng)
        wrong = probs - np.where(mask[:, None], np.eye(probs.shape[1])[g.y], 0)
        wrong[mask] /= max(mask.sum(), 1)
        if cfg.masked:
            wrong[~mask] = 0
        back = g.spread(wrong)
        grads = [g.around.T @ ((back @ w1.T) * (hidden > 0)), hidden.T @ back]
        return np.concatenate([_within(m, cfg.clip).ravel() for m in grads]), loss_of(probs, g.y, mask)
    step, grad = 1e-4, np.zeros_like(flat)
    value = lambda w: loss_of(forward(cfg, g, cut(w, sizes))[0], g.y, mask)
    for at in rng.choice(len(flat), max(1, len(flat) // 10), replace=False):
        push = np.zeros_like(flat)
        push[at] = step
        grad[at] = (value(flat + push) - value(flat - push)) / (2 * step)
    return _within(grad, cfg.clip), value(flat)


def _scores(probs: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, float]:
    """Accuracy and macro F1 over the classes that the truth holds; 0 without rows."""
    if not mask.any():
        return 0.0, 0.0
    said, true = probs[mask].argmax(1), y[mask]
    each = []
    for c in np.unique(true):
        hit = ((said == c) & (true == c)).sum()
        precision, recall = hit / ((said == c).sum() + 1e-10), hit / ((true == c).sum() + 1e-10)
        each.append(2 * precision * recall / (precision + recall + 1e-10))
    return float((said == true).mean()), float(np.mean(each))


def _client(cfg: Config, flat: np.ndarray, classes: int, turn: int) -> Callable:
    def train(nodes, edges):
        import pandas as pd

        names = list(FIELDS)
        if not len(nodes):
            return pd.DataFrame({n: [] for n in names})
        cid = int(nodes["cid"].iloc[0])
        nodes = nodes.sort_values("gid")
        place = pd.Series(np.arange(len(nodes)), index=nodes["gid"])
        u, v = (place.reindex(edges[c]).to_numpy() for c in "uv")
        inside = ~(np.isnan(u.astype(float)) | np.isnan(v.astype(float)))
        g = Graph(np.stack(nodes["x"].to_numpy()).astype(float), nodes["y"].to_numpy(int), nodes["split"].to_numpy(), u[inside].astype(int), v[inside].astype(int))
        sizes, rng, w = shapes(cfg, g.x.shape[1], classes), np.random.default_rng([cfg.seed, turn, cid]), flat.copy()
        masks, losses = {s: g.split == s for s in ("train", "val", "test")}, []
        for _ in range(cfg.local_epochs):
            grad, loss = gradient(cfg, g, w, sizes, masks["train"], rng)
            w -= cfg.rate * grad
            losses.append(loss)
        probs, hidden = forward(cfg, g, cut(w, sizes))
        (val, f1), (test, _) = _scores(probs, g.y, masks["val"]), _scores(probs, g.y, masks["test"])
        mean_eps, overlap = cfg.eps_most, []
        if cfg.noise:  # embeddings of the last forward pass, with noise by degree; those of shared nodes are sent
            deg = np.bincount(np.concatenate([g.u, g.v]), minlength=g.n)
            eps = np.clip(cfg.eps_most - deg / max(deg.max(), 1) * (cfg.eps_most - cfg.eps_least), cfg.eps_least, cfg.eps_most)
            noise = rng.laplace(0.0, 1.0, hidden.shape) * (cfg.emb_clip / np.maximum(eps, 1e-8))[:, None]
            noisy = np.clip(hidden, -cfg.emb_clip, cfg.emb_clip) + noise
            shared = np.flatnonzero(nodes["is_overlap"].to_numpy(bool))
            mean_eps, overlap = float(eps.mean()), [{"gid": int(nodes["gid"].iloc[k]), "z": noisy[k]} for k in shared]
        sent = 4 * len(w) + (cfg.sketch_bits if cfg.sketch else 0)
        return pd.DataFrame([(cid, w, int(masks["train"].sum()), float(np.mean(losses)) if losses else 0.0, val, test, f1, mean_eps, sent, overlap)], columns=names)

    return train


def client_updates(nodes: DataFrame, edges: DataFrame, flat: np.ndarray, cfg: Config, classes: int, turn: int = 1) -> DataFrame:
    """One row (UPDATE) a client after its local epochs from the weights ``flat``."""
    shared = F.col("is_overlap") if "is_overlap" in nodes.columns else F.lit(False).alias("is_overlap")
    rows = nodes.select(F.col("cid").cast("long").alias("cid"), "gid", "x", "y", "split", shared).groupBy("cid")
    return rows.cogroup(edges.select(F.col("cid").cast("long").alias("cid"), "u", "v").groupBy("cid")).applyInPandas(_client(cfg, flat, classes, turn), UPDATE)


def long_updates(updates: DataFrame) -> DataFrame:
    """cid, k, w, n, loss: what ``federate`` aggregates."""
    return updates.select("cid", F.posexplode("w").alias("k", "w"), F.col("num_train").alias("n"), F.col("train_loss").alias("loss"))


class Run(NamedTuple):
    """Final weights, the round log (LOG), of the last round the merged embeddings of shared nodes (gid, clients, z)
    and the clients' sketches (cid, part, bits), and what every round merged (MERGES)."""

    weights: np.ndarray
    log: DataFrame
    overlaps: DataFrame | None
    sketches: DataFrame | None
    merges: DataFrame


#: What the rounds merged: nodes whose embeddings several clients sent, and the sketch of all clients.
MERGES = "round int, shared_nodes long, density double, est_fpr double, sketches long"


def federated_run(nodes: DataFrame, edges: DataFrame, cfg: Config = Config(), store: RunStore | None = None, resume: bool = False) -> Run:
    """Rounds of sampling clients, training them side by side, merging and aggregating.

    The clients are written and dealt out once, so a round moves weights and updates alone; updates stay a
    table, which goes once its round is done and of which the driver reads one row of figures a client. All that
    is random depends on the seed and the round, so with ``resume`` a run goes on after the last round that its
    store has committed as if it had never stopped; without, it starts anew."""
    spark = nodes.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = [written(frame.withColumn("cid", F.col("cid").cast("long")), "clients").repartition(tasks, "cid").persist() for frame in (nodes, edges)]
    nodes, edges = kept
    features, classes = nodes.agg(F.max(F.size("x")), F.max("y") + 1).first()
    clients = [r["cid"] for r in nodes.select("cid").distinct().orderBy("cid").collect()]  # one value a client
    flat, rows, spent, first = initial(shapes(cfg, features or 1, classes or 1), cfg.seed), [], 0.0, 1
    overlaps = sent = encoded = None
    merges = []
    if store is not None and not resume:
        store.forget()
    if store is not None and (done := store.committed()):
        first, flat, spent = done[0] + 1, np.array(done[1], float), done[2]["spent"]
        rows, merges = [tuple(r) for r in store.read_log().orderBy("round").collect()], [tuple(m) for m in done[2]["merges"]]  # one row a round
    for turn in range(first, cfg.rounds + 1):
        began = time.time()
        chosen = np.random.default_rng(cfg.seed + turn).permutation(len(clients))[: max(1, int(len(clients) * cfg.fraction))]
        some = F.col("cid").isin([clients[k] for k in chosen])
        updates = written(client_updates(nodes.where(some), edges.where(some), flat, cfg, classes, turn), "updates")
        got = updates.drop("w", "overlap").toPandas()  # one row a client
        if not len(got):
            break
        old = [] if overlaps is None else [overlaps]
        shared, figures = 0, (None, None, 0)
        if cfg.noise:
            overlaps = written(privacy.overlap_merge(updates.select("cid", F.explode("overlap").alias("o")).select("cid", "o.gid", "o.z")), "overlaps")
            shared = overlaps.count()
        if cfg.sketch:
            if encoded is None:  # a client's sketch is that of its edges, the same in every round
                encoded = written(privacy.bloom_encode(edges.select("cid", "u", "v"), cfg.sketch_bits, cfg.sketch_hashes), "sketches")
            sent = encoded.where(some)
            figures = privacy.sketch_stats(sent, cfg.sketch_bits, cfg.sketch_hashes).select("density", "est_fpr", "num_clients").first()
        merges.append((turn, shared, *figures))
        flat = np.array([r["w"] for r in federate.aggregate(long_updates(updates), cfg.method, **dict(cfg.options)).select("k", "w").orderBy("k").collect()], float)  # a model's size
        share = got["num_train"] / max(got["num_train"].sum(), 1)
        spent += got["mean_eps"].mean()
        val, test, f1 = (float((got[c] * share).sum()) for c in ("val_acc", "test_acc", "val_f1"))
        low, high = float(got["val_acc"].min()), float(got["val_acc"].max())
        record = (val, test, f1, low, high, high - low, float(got["mean_eps"].mean()), float(spent), float(got["comm_bytes"].sum()) / 1024 / 1024)
        rows.append((turn, *(round(x, 4) for x in record), round(time.time() - began, 2)))
        if store is not None:
            store.checkpoint(turn, flat.tolist())
            store.commit(turn, flat.tolist(), spark.createDataFrame(rows, LOG), spent=float(spent), merges=merges)
        for table in (updates, *old):
            removed(table)
    log = spark.createDataFrame(rows, LOG)
    if store is not None:
        store.history(log)
    for frame in kept:
        frame.unpersist()
    return Run(flat, log, overlaps, sent, spark.createDataFrame(merges, MERGES))


#: Settings of the ablation, as its table names them. "Local Only" trains one client of five a round.
SETTINGS: dict[str, dict] = {
    "Full System": {}, "- SecureSA": {"sketch": False}, "- SecureNA": {"noise": False}, "- Adaptive ε": {"eps_least": 1.0, "eps_most": 1.0},
    "FedAvg (baseline)": {"method": "fedavg", "options": ()}, "Local Only": {"fraction": 0.2},
}


def ablation(nodes: DataFrame, edges: DataFrame, cfg: Config = Config(rounds=5), store: RunStore | None = None) -> DataFrame:
    """One row for each of SETTINGS: scores of its best round, worst client, gap, privacy and bytes."""
    written_nodes, written_edges = written(nodes, "clients"), written(edges, "clients")
    tagged = None
    for name, change in SETTINGS.items():
        log = federated_run(written_nodes, written_edges, replace(cfg, **change)).log.withColumn("config", F.lit(name))
        tagged = log if tagged is None else tagged.unionByName(log)
    table = logs.ablation_summary(tagged)
    if store is not None:
        store.ablation(table)
    return table
