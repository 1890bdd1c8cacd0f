import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leaguelens.operators import boosting as B
from leaguelens.operators import embedding as E
from leaguelens.operators import families as FM
from leaguelens.operators import models as M
from tests.league.test_boosting import boards as plain_boards

KEYS = ("a_player_id", "b_player_id", "a_hall_id", "b_hall_id")


def rows(n, rounds, seed=3, draws=0.1):
    """(seq, outcome_a, keys): players 0 to 8 beat the next ones modulo 3 but for chance."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        a, b = rng.choice(9, 2, replace=False)
        y = 0.5 if rng.random() < draws else float((a - b) % 3 == 1 if (a - b) % 3 else rng.random() < 0.5)
        out.append((i % rounds, y, f"p{a}", f"p{b}", str(a % 2), str(b % 2)))
    return out


def table(data):
    return pa.table({c: [r[k] for r in data] for k, c in enumerate(("seq", "outcome_a", *KEYS))})


def slow(data, dim, epochs):
    """Board by board: (dense parts, vectors by key) of the epoch, among so many, of least loss on the validation rounds; the
    last one if there are none."""
    dense = E.Dense.new(dim)
    w1, b1, w2, b2 = (x.copy() for x in dense.parts())
    vec = {("player", k): E.start(f"player:{k}", dim) for r in data for k in r[2:4]} | {("hall", k): E.start(f"hall:{k}", 2) for r in data for k in r[4:6]}
    decisive = [r for r in data if r[1] != 0.5]
    seqs = sorted({r[0] for r in decisive})
    split = seqs[int(max(1, len(seqs) * 0.8))] if len(seqs) >= 6 else 10**9
    examples = lambda keep: [e for r in decisive if keep(r[0]) for e in ((r[2], r[3], r[4], r[5], r[1]), (r[3], r[2], r[5], r[4], 1 - r[1]))]
    fit, val = examples(lambda s: s < split), examples(lambda s: s >= split)
    names = lambda e: (("player", e[0]), ("player", e[1]), ("hall", e[2]), ("hall", e[3]))
    raw = lambda e: float(w2 @ np.tanh(w1 @ np.concatenate([vec[k] for k in names(e)]) + b1) + b2[0])
    speed, least, best = {}, np.inf, None
    for _ in range(epochs):
        g = {"w1": np.zeros_like(w1), "b1": np.zeros_like(b1), "w2": np.zeros_like(w2), "b2": np.zeros(1)}
        for e in fit:
            x = np.concatenate([vec[k] for k in names(e)])
            h = np.tanh(w1 @ x + b1)
            off = 1 / (1 + np.exp(-(w2 @ h + b2[0]))) - e[4]
            dz = off * w2 * (1 - h * h)
            dx = w1.T @ dz
            for name, part in (("w1", np.outer(dz, x)), ("b1", dz), ("w2", off * h), ("b2", np.array([off]))):
                g[name] = g[name] + part
            for k, part in zip(names(e), np.split(dx, np.cumsum([dim, dim, 2])), strict=True):
                g[k] = g.get(k, 0) + part
        for k, own in g.items():
            target = {"w1": w1, "b1": b1, "w2": w2, "b2": b2}.get(k) if isinstance(k, str) else vec[k]
            speed[k] = 0.9 * speed.get(k, 0) - 0.05 * (own / len(fit) + (0 if k == "b2" else 1e-3 * target))
            target += speed[k]
        p = [(1 / (1 + np.exp(-raw(e))), e[4]) for e in val]
        lost = np.mean([-np.log(max(q if y > 0.5 else 1 - q, 1e-12)) for q, y in p]) if val else -epochs
        if lost < least - 1e-6 or not val:
            least, best = lost, (tuple(x.copy() for x in (w1, b1, w2, b2)), {k: v.copy() for k, v in vec.items()})
    return best


@pytest.mark.parametrize("rounds", [4, 10])
def test_both_ways_equal_a_slow_net(spark, monkeypatch, rounds):
    monkeypatch.setattr(E, "EPOCHS", 5)
    monkeypatch.setattr(E, "FEW_EPOCHS", 5)
    data = rows(120, rounds)
    dense, vec = slow(data, 3, 5)
    here = E.learned(E.Boards.of(table(data)), 3)
    df = spark.createDataFrame(data, "seq long, outcome_a double, a_player_id string, b_player_id string, a_hall_id string, b_hall_id string")
    there = E.spread(df, 3)
    own = {(r.kind, r.key): r.vector for r in there.vectors.collect()}
    for got, also, want in zip(here.dense.parts(), there.dense.parts(), dense, strict=True):
        assert np.allclose(got, want, atol=1e-9) and np.allclose(also, want, atol=1e-9)
    assert own.keys() == vec.keys()
    for (kind, k), want in vec.items():
        assert np.allclose((here.players if kind == "player" else here.halls)[k], want, atol=1e-9) and np.allclose(own[kind, k], want, atol=1e-9)


def test_early_stop_keeps_the_best_both_ways(spark, monkeypatch):
    monkeypatch.setattr(E, "PATIENCE", 2)
    monkeypatch.setattr(E, "RATE", 2.0)  # overshoots soon
    monkeypatch.setattr(E, "EPOCHS", 12)
    data = rows(60, 8, draws=0.0)
    df = spark.createDataFrame(data, "seq long, outcome_a double, a_player_id string, b_player_id string, a_hall_id string, b_hall_id string")
    here, there = E.learned(E.Boards.of(table(data)), 2), E.spread(df, 2)
    assert np.allclose(here.dense.w1, there.dense.w1, atol=1e-9)


def test_strength_is_learned_and_swaps_flip_the_sign(spark):
    data = [(s, float(a < b), a, b, h, k) for s, _, a, b, h, k in rows(900, 12, draws=0.0)]
    df = spark.createDataFrame(data, "seq long, outcome_a double, a_player_id string, b_player_id string, a_hall_id string, b_hall_id string")
    net = E.fit(df, 4)
    swapped = df.select("seq", "outcome_a", F.col("b_player_id").alias("a_player_id"), F.col("a_player_id").alias("b_player_id"), F.col("b_hall_id").alias("a_hall_id"), F.col("a_hall_id").alias("b_hall_id"))
    one, other = ([(r.a_player_id, r.b_player_id, r.outcome_a, r.embedded) for r in E.with_features(d, net).collect()] for d in (df, swapped))
    assert np.mean([(x[3][0] > 0) == (x[2] == 1.0) for x in one]) > 0.85
    back = {(x[1], x[0]): x[3] for x in other}
    assert all(np.allclose(np.array(x[3]), -np.array(back[x[0], x[1]])) for x in one)
    start = E.Learned(E.Dense.new(4), {}, {})
    trained = E.learned(E.Boards.of(table(data)), 4)
    y = np.array([r[1] for r in data])
    score = lambda n: E.loss(2 * n.features(E.Boards.of(table(data)))[:, 0], y).mean()
    assert score(trained) < 0.9 * score(start)
    unknown = df.limit(1).withColumns({c: F.lit("?") for c in KEYS})
    assert E.with_features(unknown, net).first().embedded == [0.0] * 7
    assert E.fit(df.limit(0), 4).vectors.count() == 0


def named(b):
    """The boards with players of a cycle in place of the two of the fixture."""
    who = lambda k, c: F.concat(F.lit("p"), F.pmod(F.xxhash64(F.lit(k), "match_id"), F.lit(3)) + (3 if c else 0))
    return b.withColumns({"a": F.col("a").withField("player_id", who(1, 0)), "b": F.col("b").withField("player_id", who(2, 1))})


def test_vectors_in_the_grid_and_their_gate(spark, monkeypatch):
    monkeypatch.setattr(B, "MAX_TREES", 60)
    b = named(plain_boards(spark, 1500, 12, lambda x, rng: True)).cache()
    a, o = F.substring("a.player_id", 2, 1).cast("int"), F.substring("b.player_id", 2, 1).cast("int")
    b = b.withColumn("outcome_a", F.when((a + o) % 2 == 0, 1.0).otherwise(0.0))  # by who meets whom alone
    grid = (M.Candidate("baseline", M.BASELINE), M.Candidate("g", M.BOOSTED, 6.0, 1.0), M.Candidate("v", M.EMBEDDED, 6.0, 1.0, 4))
    q = {r.model: r for r in M.scores(M.walk_forward(b, grid, [11]), ["model"]).collect()}
    assert q["v"].brier < 0.6 * q["g"].brier
    fam = FM.family(M.EMBEDDED)
    model = fam.fit(b.where("seq < 11"), grid[2])
    p = {r.match_id: r.p_win for r in fam.predict(b.where("seq = 11"), model, ["match_id"]).collect()}
    w = {r.match_id: r.p_win for r in M.walk_forward(b, grid[2:], [11]).collect()}
    assert p.keys() == w.keys() and all(abs(p[k] - w[k]) < 1e-9 for k in p)
    rows = [("baseline", 60, 0.5), ("g", 10, 0.3), ("v", 60, 0.3), ("l", 60, 0.4)]
    quality = spark.createDataFrame(rows, "model string, boards long, brier double")
    assert [r.model for r in M.champion(quality, "baseline", grid=grid).collect()] == ["l"]  # v doesn't beat g
    better = spark.createDataFrame([*rows[:2], ("v", 60, 0.29), rows[3]], quality.schema)
    assert [r.model for r in M.champion(better, "baseline", grid=grid).collect()] == ["v"]


def slow_trees(x, y, sides, trees, ridge=1.0):
    """Margins after so many trees by a plain search over all gaps; x: rows by feature. sides: 1, or 2 if rows come in pairs."""
    m = np.zeros(len(y))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-m))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)

        def leaf(at, level, g=g, h=h):
            part = lambda i: g[i].sum() ** 2 / (h[i].sum() + ridge)
            best = (0.0, None)
            if level < 3 and h[at].sum() >= 8:
                for f in range(x.shape[1]):
                    v = np.unique(x[:, f])
                    for cut in (v[1:] + v[:-1]) / 2:
                        left, right = at[x[at, f] < cut], at[x[at, f] >= cut]
                        if len(left) and len(right) and min(h[left].sum(), h[right].sum()) >= 4:
                            gain = 0.5 * (part(left) + part(right) - part(at)) - 1e-4
                            if gain > best[0] + 1e-12:
                                best = (gain, (left, right))
            if best[1] is None:
                m[at] += 0.1 * -g[at].sum() / (h[at].sum() + ridge)
            else:
                for part_of in best[1]:
                    leaf(part_of, level + 1)

        leaf(np.arange(len(y)), 0)
    return m


def test_trees_equal_a_plain_search():
    rng = np.random.default_rng(4)
    anti = rng.integers(-3, 4, (300, 3)).astype(float)
    outcome = (anti @ [1.0, -0.5, 0.2] + rng.normal(size=300) > 0).astype(float)
    seq = np.sort(rng.integers(0, 4, 300))  # too few rounds for validation: a fixed number of trees
    m = B.grown(seq, outcome, np.zeros((300, 1)), anti, 9, 6.0, [("g", 1.0)], B.alone, most=6)["g"]
    assert len(m.win.trees) == 6 and not m.draw.trees or len(m.draw.trees) == 6
    both = np.stack([anti, -anti], axis=1).reshape(600, 3)
    want = slow_trees(both, np.stack([outcome, 1 - outcome], axis=1).ravel(), 2, 6)
    e = m.edges[B.WIN, 6.0]
    got = m.win.margin(B.binned(anti, e), B.binned(-anti, e))
    assert np.allclose(got, (want[::2] - want[1::2]) / 2, atol=1e-9)


def test_blocks_grow_the_same_trees_as_one_task(spark, monkeypatch):
    monkeypatch.setattr(B, "MAX_TREES", 5)  # tasks get the number from here
    b = plain_boards(spark, 900, 10, lambda x, rng: rng.random() < (0.8 if x[0] > 0 else 0.2), draws=0.1).cache()
    one, many = (B.worked(b, [("g", 6.0, 1.0), ("h", 6.0, 3.0)], [9], n) for n in (None, 300))
    p, q = ({(r.model, r.match_id): r.p_win for r in B.predicted(x).collect()} for x in (one, many))
    assert p.keys() == q.keys() and max(abs(p[k] - q[k]) for k in p) < 1e-9


def test_later_rounds_change_no_fit(spark):
    b = plain_boards(spark, 500, 12, lambda x, rng: rng.random() < (0.8 if x[0] > 0 else 0.3)).cache()
    odd = b.where("seq <= 10").unionByName(b.where("seq > 10").withColumns({s: F.col(s).withField("trajectory", F.col(f"{s}.trajectory") * 17.3) for s in "ab"}))
    p, q = ({r.match_id: r.p_win for r in M.walk_forward(d, (M.Candidate("g", M.BOOSTED, 6.0, 1.0),), [10]).collect()} for d in (b, odd))
    assert p == q


class Even(FM.Family):
    """Says the share of draws, and halves of the rest; `bias` breaks its symmetry."""

    def __init__(self, name, bias=0.0):
        self.name, self.bias = name, bias

    def fit(self, b, candidate):
        return M.draw_rate(b)

    def predict(self, b, model, keys):
        return b.select(*keys, F.lit((1 - model) / 2 + self.bias).alias("p_win"), F.lit(model).alias("p_draw"), F.lit((1 - model) / 2 - self.bias).alias("p_loss"))


def test_families_of_ones_own(spark):
    b = plain_boards(spark, 120, 6, lambda x, rng: x[0] > 0, draws=0.2).cache()
    with pytest.raises(ValueError, match="no family"):
        M.walk_forward(b, (M.Candidate("x", "unheard of"),), [5])
    with pytest.raises(ValueError, match="swapped"):
        FM.register(Even("tilted", 0.1), b, M.Candidate("x", "tilted"))
    with pytest.raises(ValueError, match="taken"):
        FM.register(Even(M.BASELINE), b, M.Candidate("x", M.BASELINE))
    try:
        FM.register(Even("even"), b, M.Candidate("x", "even"))
        p = M.walk_forward(b, (M.Candidate("baseline", M.BASELINE), M.Candidate("mine", "even")), [4, 5])
        assert {(r.model, r.seq): r.n for r in p.groupBy("model", "seq").agg(F.count("*").alias("n")).collect()} == {(m, s): 20 for m in ("baseline", "mine") for s in (4, 5)}
    finally:
        FM.FAMILIES.pop("even", None)
    assert M.walk_forward(b, (), [5]).count() == 0


def test_a_step_needs_little_memory_beside_its_rows():
    import tracemalloc

    rng, n = np.random.default_rng(1), 200_000
    d, x, y = E.Dense.new(4), rng.normal(size=(n, 12)), rng.random(n).round()
    tracemalloc.start()
    try:
        sums, dx = d.gradients(x, y)
        assert tracemalloc.get_traced_memory()[1] < 1.2 * x.nbytes  # dx alone is as large as x
    finally:
        tracemalloc.stop()
    few = [d.gradients(x[i : i + 1], y[i : i + 1]) for i in range(0, n, 20_000)]
    assert all(np.allclose(dx[20_000 * k], v[0]) for k, (_, v) in enumerate(few)) and np.isclose(sums[0].sum(), (d.gradients(x[::-1], y[::-1])[0][0]).sum())
