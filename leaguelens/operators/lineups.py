"""Lineups: where an opponent's players sit, and which order of ours answers best; for many pairs of halls at once.

Orders of five are an array of 120 permutations in the plan, applied by array functions to each hall's roster, so a hall
is one row until its orders are exploded, and no roster is joined with a table of orders.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leaguelens.operators.running import recency_weight

SEATS, SMOOTHING, ORDERINGS = 5, 0.02, 24
#: A pool of more players than the first is cut to the second.
PRUNE_OVER, POOL = 16, 12
#: Chance from which a board is favoured, and the gap to the worst case from which a lineup is fragile.
FAVOURED, FRAGILE = 0.5, 0.15


def permutations(n: int = SEATS) -> Column:
    return F.array(*(F.array(*(F.lit(i) for i in p)) for p in itertools.permutations(range(n))))


def seat_distribution(played: DataFrame, now: int) -> DataFrame:
    """LIN-1: hall_id, player_id, last_seq, probs: share of each seat by recency-weighted counts with smoothing."""
    w = played.where("seat is not null").groupBy("hall_id", "player_id").pivot("seat", list(range(1, SEATS + 1))).agg(F.sum(recency_weight(F.lit(now) - F.col("seq"))))
    last = played.groupBy("hall_id", "player_id").agg(F.max("seq").alias("last_seq"))
    raw = [F.coalesce(F.col(str(s)), F.lit(0.0)) + SMOOTHING for s in range(1, SEATS + 1)]
    total = sum(raw[1:], raw[0])
    return w.join(last, ["hall_id", "player_id"]).select("hall_id", "player_id", "last_seq", F.array(*(r / total for r in raw)).alias("probs"))


def expected_roster(distribution: DataFrame) -> DataFrame:
    """LIN-2: the five players of each hall seated most recently; ties to the smaller id."""
    n = F.row_number().over(Window.partitionBy("hall_id").orderBy(F.col("last_seq").desc(), "player_id"))
    return distribution.withColumn("place", n).where(F.col("place") <= SEATS)


def top_orderings(roster: DataFrame, k: int = ORDERINGS) -> DataFrame:
    """LIN-3: for each hall with a full roster its k likeliest orders and their probabilities; ordering is the array of
    player ids by seat, ties go to the smaller array."""
    team = roster.groupBy("hall_id").agg(F.array_sort(F.collect_list(F.struct("place", "player_id", "probs"))).alias("t")).where(F.size("t") == SEATS)
    weight = F.aggregate(F.transform(F.col("p"), lambda i, seat: F.col("t")[i]["probs"][seat]), F.lit(1.0), lambda s, x: s * x)
    each = team.withColumn("p", F.explode(permutations())).select("hall_id", F.transform("p", lambda i: F.col("t")[i]["player_id"]).alias("ordering"), weight.alias("weight"))
    each = each.withColumn("probability", F.col("weight") / F.sum("weight").over(Window.partitionBy("hall_id")))
    n = F.row_number().over(Window.partitionBy("hall_id").orderBy(F.round("weight", 12).desc(), "ordering"))
    return each.withColumn("n", n).where(F.col("n") <= k).select("hall_id", "n", "ordering", "probability")


def team_result(boards: Column) -> Column:
    """LIN-7: struct (win, tie, loss) of a match from an array of structs (p_win, p_draw): the distribution of the sum of
    half points, one board after another."""
    size = 2 * SEATS + 1
    start = F.array(*(F.lit(1.0 if i == 0 else 0.0) for i in range(size)))

    def step(s, b):
        at = lambda i: F.when(i >= 0, F.element_at(s, F.greatest(i, F.lit(0)) + 1)).otherwise(0.0)
        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: at(i) * (1 - b["p_win"] - b["p_draw"]) + at(i - 1) * b["p_draw"] + at(i - 2) * b["p_win"])

    d = F.aggregate(boards, start, step)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    return F.struct(total(F.slice(d, SEATS + 2, SEATS)).alias("win"), F.element_at(d, SEATS + 1).alias("tie"), total(F.slice(d, 1, SEATS)).alias("loss"))


def pool(players: DataFrame) -> DataFrame:
    """The players of each hall that a lineup may be made of: hall_id, player_id, rating and further columns of players;
    of more than PRUNE_OVER the POOL best."""
    w = Window.partitionBy("hall_id")
    n = F.row_number().over(w.orderBy(F.col("rating").desc(), "player_id"))
    out = players.withColumns({"_n": n, "_of": F.count("*").over(w)})
    return out.where((F.col("_of") >= SEATS) & ((F.col("_of") <= PRUNE_OVER) | (F.col("_n") <= POOL))).drop("_n", "_of")


def tensor(met: DataFrame, ours: DataFrame, theirs: DataFrame, columns: list[str]) -> DataFrame:
    """LIN-5: each player of ours against each of theirs at each seat, for many pairs of halls: hall_id, opp_hall_id,
    player_id, opp_player_id, seat and structs a and b of `columns` with that seat."""
    side = lambda df, hall, player, s: df.select(F.col("hall_id").alias(hall), F.col("player_id").alias(player), F.struct(*columns).alias(s))
    both = met.join(side(ours, "hall_id", "player_id", "a"), "hall_id").join(side(theirs, "opp_hall_id", "opp_player_id", "b"), "opp_hall_id")
    t = both.withColumn("seat", F.explode(F.sequence(F.lit(1), F.lit(SEATS))))
    return t.withColumns({s: F.col(s).withField("seat", F.col("seat")) for s in "ab"}) if "seat" in columns else t


def candidates(players: DataFrame) -> DataFrame:
    """LIN-6: hall_id, lineup (array of ids by seat): every order of every five of a hall's pool."""
    spark = players.sparkSession
    few = [(n, list(c)) for n in range(SEATS, PRUNE_OVER + 1) for c in itertools.combinations(range(n), SEATS)]
    index = F.broadcast(spark.createDataFrame(few, "n int, c array<int>"))  # fixed size: subsets of up to PRUNE_OVER
    teams = pool(players).groupBy("hall_id").agg(F.array_sort(F.collect_list("player_id")).alias("ids")).withColumn("n", F.size("ids"))
    five = teams.join(index, "n").select("hall_id", F.transform("c", lambda i: F.get("ids", i)).alias("five"))
    return five.select("hall_id", F.explode(permutations()).alias("p"), "five").select("hall_id", F.transform("p", lambda i: F.get("five", i)).alias("lineup"))


class Search:
    """All lineups of a pool of n players as a tree of seats: the players of a level's prefixes and their parents."""

    def __init__(self, n: int) -> None:
        rows, self.levels = np.zeros((1, 0), np.int16), []
        for _ in range(SEATS):
            taken = np.zeros((len(rows), n), bool)
            np.put_along_axis(taken, rows.astype(np.int64), True, axis=1)
            parent, player = np.nonzero(~taken)  # in order, so that ties go to the smaller ids
            rows = np.concatenate([rows[parent], player[:, None].astype(np.int16)], axis=1)
            self.levels.append((parent, player))
        self.lineups = rows

    def wins(self, w: np.ndarray, d: np.ndarray, orders: np.ndarray) -> np.ndarray:
        """Probability to win of each lineup against each order; w, d: player x opponent x seat. Prefixes share their
        half-point distribution, and of the last seat only what tips the balance is added up."""
        state = np.ones((1, len(orders), 1))
        for s, (parent, player) in enumerate(self.levels[:-1]):
            win, draw = (x[player][:, orders[:, s], s][:, :, None] for x in (w, d))
            old = state[parent]
            state = np.zeros((len(parent), len(orders), old.shape[2] + 2))
            state[:, :, :-2] += old * (1 - win - draw)
            state[:, :, 1:-1] += old * draw
            state[:, :, 2:] += old * win
        parent, player = self.levels[-1]
        win, draw = (x[player][:, orders[:, SEATS - 1], SEATS - 1] for x in (w, d))
        tail = [state[:, :, k:].sum(axis=2)[parent] for k in (SEATS - 1, SEATS, SEATS + 1)]
        return win * tail[0] + draw * tail[1] + (1 - win - draw) * tail[2]


#: Prefixes of three seats that are extended at once; pools up to which trying all lineups takes less than bounding them,
#: and as little memory.
PREFIXES, SMALL_POOL = 64, 8


class Bounded:
    """The best and the safest lineup of a pool without trying all: prefixes are extended seat by seat, and one is left as soon
    as neither can be among its lineups. What a prefix can still reach, against each order, is bounded by setting the
    remaining seats with players who don't exist: as likely to win there as the likeliest of the pool, and as likely not to
    lose. A block of prefixes takes some MB, whatever the pool's size."""

    def __init__(self, w: np.ndarray, d: np.ndarray, orders: np.ndarray, share: np.ndarray) -> None:
        self.n, self.share = len(w), share
        seats = np.arange(SEATS)
        self.win, self.draw = (np.moveaxis(x[:, orders, seats], 2, 0) for x in (w, d))  # seat x player x order
        win = self.win.max(axis=1)
        draw = np.maximum((self.win + self.draw).max(axis=1) - win, 0)
        after = np.zeros((len(orders), 2 * SEATS + 3))
        after[:, SEATS + 1 :] = 1
        self.reach = [after]  # chance to win by half points so far, with seats from s on still to come, for s from the last
        for s in range(SEATS - 1, -1, -1):
            now = after.copy()
            now[:, :-2] = (1 - win[s] - draw[s])[:, None] * after[:, :-2] + draw[s][:, None] * after[:, 1:-1] + win[s][:, None] * after[:, 2:]
            after = now
            self.reach.insert(0, after)
        self.found = [(-1.0, ()), (-1.0, ())]  # of most expected wins, of best worst case

    def extended(self, rows: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every prefix with every further player, and their half-point distributions."""
        s = rows.shape[1]
        free = np.ones((len(rows), self.n), bool)
        np.put_along_axis(free, rows.astype(np.int64), False, axis=1)
        parent, player = np.nonzero(free)
        old, win, draw = state[parent], self.win[s][player][:, :, None], self.draw[s][player][:, :, None]
        new = np.zeros((*old.shape[:2], old.shape[2] + 2))
        new[:, :, :-2] = old * (1 - win - draw)
        new[:, :, 1:-1] += old * draw
        new[:, :, 2:] += old * win
        return np.concatenate([rows[parent], player[:, None].astype(np.int16)], axis=1), new

    def bounds(self, state: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
        """(expected, worst) chance to win at most of each prefix of s seats; what they are, of a whole lineup."""
        each = np.einsum("pok,ok->po", state, self.reach[s][:, : state.shape[2]])
        return each @ self.share, each.min(axis=1)

    def open(self, state: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
        """Prefixes that may hold one of the two, and their bounds of expected wins; nine places count."""
        both = self.bounds(state, s)
        keep = np.zeros(len(state), bool)
        for value, (least, _) in zip(both, self.found, strict=True):
            keep |= value + 1e-9 >= least
        return np.flatnonzero(keep), both[0]

    def take(self, rows: np.ndarray, state: np.ndarray) -> None:
        for k, value in enumerate(self.bounds(state, SEATS)):
            value = np.round(value, 9)
            top = value.max(initial=-1.0)
            if top >= self.found[k][0]:
                lineup = min(map(tuple, rows[value == top].tolist()))
                self.found[k] = min(self.found[k], (top, lineup), key=lambda x: (-x[0], x[1]))

    def run(self, tries: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """(best, safest); tries: some lineups to begin with. Of equal ones the one of smaller places in the pool."""
        for lineup in tries:
            rows, state = np.zeros((1, 0), np.int16), np.ones((1, self.win.shape[2], 1))
            for i in lineup:
                rows, state = self.extended(rows, state)
                state, rows = state[rows[:, -1] == i], rows[rows[:, -1] == i]
            self.take(rows, state)
        rows, state = np.zeros((1, 0), np.int16), np.ones((1, self.win.shape[2], 1))
        for s in range(1, 4):
            rows, state = self.extended(rows, state)
            keep, value = self.open(state, s)
            keep = keep[np.argsort(-value[keep], kind="stable")]  # those of most promise first
            rows, state = rows[keep], state[keep]
        for at in range(0, len(rows), PREFIXES):
            some, held = rows[at : at + PREFIXES], state[at : at + PREFIXES]
            for s in range(3, SEATS + 1):
                if s > 3:
                    some, held = self.extended(some, held)
                keep, _ = self.open(held, s)  # again, as others have been found since
                some, held = some[keep], held[keep]
                if not len(some):
                    break
            if len(some):
                self.take(some, held)
        return np.array(self.found[0][1]), np.array(self.found[1][1])


def team_results(w: np.ndarray, d: np.ndarray, lineup: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """LIN-7 in a task: win, tie and loss of one lineup against each order."""
    state = np.zeros((len(orders), 2 * SEATS + 1))
    state[:, 0] = 1
    for s in range(SEATS):
        win, draw = w[lineup[s], orders[:, s], s][:, None], d[lineup[s], orders[:, s], s][:, None]
        new = state * (1 - win - draw)
        new[:, 1:] += state[:, :-1] * draw
        new[:, 2:] += state[:, :-2] * win
        state = new
    return np.stack([state[:, SEATS + 1 :].sum(axis=1), state[:, SEATS], state[:, :SEATS].sum(axis=1)], axis=1)


# Whom our players, strongest first, are set against by rank.
ARCHETYPES = (("mirror", (0, 1, 2, 3, 4)), ("single sacrifice", (1, 2, 3, 4, 0)), ("double sacrifice", (2, 3, 4, 1, 0)))


def search(cells: DataFrame) -> DataFrame:
    """LIN-8, LIN-9 and LIN-11: for each pair of halls the lineup of most expected wins over the opponent's likely orders,
    the one whose worst case is best, and the fixed patterns; ties, to nine places, go to the smaller array of ids.

    cells: hall_id, opp_hall_id, ids, ratings (our pool, sorted by id), opp_ids, opp_ratings (their five, sorted by id),
    orders (array of arrays of ids by seat, likeliest first), shares, and p_win, p_draw: flat arrays of our player x
    theirs x seat, or x 1 if the seat doesn't matter. boards: the best lineup's chances against the likeliest order.
    """
    names = ["ids", "ratings", "opp_ids", "opp_ratings", "orders", "shares", "p_win", "p_draw"]
    one = "lineup: array<string>, win: double, tie: double, loss: double"
    schema = f"hall_id long, opp_hall_id long, n_candidates long, best struct<{one}, worst: double>, safe struct<{one}, worst: double>, boards array<double>, patterns array<struct<name: string, {one}>>"

    def run(batches):
        trees: dict[int, Search] = {}
        for batch in batches:
            out = []
            for hall, opp, ids, ratings, opp_ids, opp_ratings, orders, shares, w, d in zip(*(batch.column(k).to_pylist() for k in range(10)), strict=True):
                n = len(ids)
                w, d = (np.broadcast_to(np.array(x).reshape(n, SEATS, -1), (n, SEATS, SEATS)) for x in (w, d))
                seat_of = {p: k for k, p in enumerate(opp_ids)}
                order = np.array([[seat_of[p] for p in o] for o in orders])
                share = np.array(shares) / sum(shares) if sum(shares) > 0 else np.full(len(order), 1 / len(order))
                def told(lineup, w=w, d=d, order=order, share=share, ids=ids):
                    r = team_results(w, d, lineup, order)
                    win, tie, loss = (float(x) for x in np.round(share @ r, 9))
                    return {"lineup": [ids[i] for i in lineup], "win": win, "tie": tie, "loss": loss, "worst": float(np.round(r[:, 0].min(), 9))}

                strong = sorted(range(n), key=lambda i: (-ratings[i], ids[i]))[:SEATS]  # noqa: B023
                rank = sorted(range(SEATS), key=lambda i: (-opp_ratings[i], opp_ids[i]))  # noqa: B023
                seats = [int(np.flatnonzero(order[0] == i)[0]) for i in rank]
                fixed = [("strength order", strong)]
                for name, against in ARCHETYPES:
                    lineup = [0] * SEATS
                    for r, other in enumerate(against):
                        lineup[seats[other]] = strong[r]
                    fixed.append((name, lineup))
                patterns = [{"name": name, **told(lineup)} for name, lineup in fixed]
                if n <= SMALL_POOL:
                    tree = trees[n] = trees.get(n) or Search(n)
                    won = tree.wins(w, d, order)
                    best, safe = tree.lineups[int(np.round(won @ share, 9).argmax())], tree.lineups[int(np.round(won.min(axis=1), 9).argmax())]
                else:
                    best, safe = Bounded(w, d, order, share).run([lineup for _, lineup in fixed])
                patterns.append({"name": "free optimum", **told(best)})
                out.append((hall, opp, math.perm(n, SEATS), told(best), told(safe), [float(w[best[s], order[0][s], s]) for s in range(SEATS)], patterns))
            columns = [list(c) for c in zip(*out, strict=True)] if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, kinds, strict=True)], schema=kinds)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = to_arrow_schema(StructType.fromDDL(schema))
    return cells.select("hall_id", "opp_hall_id", *names).mapInArrow(run, schema)


def cells(met: DataFrame, ours: DataFrame, theirs: DataFrame, orderings: DataFrame, chances: DataFrame | None = None, probability=None) -> DataFrame:
    """The rows of search for pairs (hall_id, opp_hall_id); chances: the tensor with p_win and p_draw, or else
    probability(rating, other rating), a struct of them for a pair of players at any seat."""
    team = lambda df, hall, ids: df.groupBy("hall_id").agg(F.array_sort(F.collect_list(F.struct("player_id", "rating"))).alias("_t")).select(F.col("hall_id").alias(hall), F.col("_t.player_id").alias(ids), F.col("_t.rating").alias(ids.replace("ids", "ratings")))
    o = orderings.groupBy("hall_id").agg(F.array_sort(F.collect_list(F.struct("n", "ordering", "probability"))).alias("_o"))  # ORDERINGS rows
    o = o.select(F.col("hall_id").alias("opp_hall_id"), F.col("_o.ordering").alias("orders"), F.col("_o.probability").alias("shares"))
    both = met.join(team(ours, "hall_id", "ids"), "hall_id").join(team(theirs, "opp_hall_id", "opp_ids"), "opp_hall_id").join(o, "opp_hall_id").where(F.size("opp_ids") == SEATS)
    if chances is None:
        flat = F.flatten(F.transform("ratings", lambda a: F.transform("opp_ratings", lambda b: probability(a, b))))
        return both.withColumn("_c", flat).withColumns({p: F.col(f"_c.{p}") for p in ("p_win", "p_draw")})
    each = chances.groupBy("hall_id", "opp_hall_id").agg(F.array_sort(F.collect_list(F.struct("player_id", "opp_player_id", "seat", "p_win", "p_draw"))).alias("_c"))  # PRUNE_OVER x 5 x 5
    return both.join(each, ["hall_id", "opp_hall_id"]).withColumns({p: F.col(f"_c.{p}") for p in ("p_win", "p_draw")})


def explained(boards: Column) -> Column:
    """LIN-10: struct (sacrifice, sacrifice_win, favoured) of a lineup's chances by seat: the seat of the lowest chance if
    that is below a half, else null, and the other seats with a half or more; seats count from 1."""
    low = F.array_min(boards)
    worst = F.array_position(boards, low).cast("int")
    favoured = F.filter(F.transform(boards, lambda p, i: F.when((p >= FAVOURED) & (i + 1 != worst), i + 1)), lambda i: i.isNotNull())
    return F.struct(F.when(low < FAVOURED, worst).alias("sacrifice"), low.alias("sacrifice_win"), favoured.alias("favoured"))


def reactivity(played: DataFrame) -> DataFrame:
    """AGG-18: hall_id, reactivity, rematches: the share of a hall's meetings with an opponent in which its players sat
    otherwise than in the meeting before; null for a hall without a second meeting."""
    seats = played.where("seat is not null").groupBy("hall_id", "opp_hall_id", "seq").agg(F.array_sort(F.collect_list(F.struct("seat", "player_id"))).alias("map"))
    before = F.lag("map").over(Window.partitionBy("hall_id", "opp_hall_id").orderBy("seq"))
    m = seats.withColumn("before", before)
    changed = F.when(F.col("before").isNotNull(), (F.col("map") != F.col("before")).cast("double"))
    return m.groupBy("hall_id").agg(F.avg(changed).alias("reactivity"), F.count(changed).alias("rematches"))


def best_response(pairs: DataFrame, nominal: DataFrame, orderings: DataFrame, probability) -> DataFrame:
    """LIN-8 for a given team: for each pair (hall_id, opp_hall_id) our order of most expected wins and the one whose worst
    case is best.

    nominal: hall_id, team: an array of structs with player_id first and what probability needs. orderings: hall_id,
    ordering (an array of such structs by seat), probability. probability(ours, theirs, seat) gives struct (p_win, p_draw).
    """
    lists = orderings.groupBy(F.col("hall_id").alias("opp_hall_id")).agg(F.array_sort(F.collect_list(F.struct((-F.col("probability")).alias("_p"), "ordering"))).alias("_o"))  # ORDERINGS rows
    met = pairs.join(nominal.select("hall_id", F.array_sort("team").alias("_t")), "hall_id").join(lists.withColumn("_b", F.array_sort(F.col("_o")[0]["ordering"])), "opp_hall_id")
    flat = F.flatten(F.flatten(F.transform("_t", lambda a: F.transform("_b", lambda b: F.transform(F.sequence(F.lit(0), F.lit(SEATS - 1)), lambda s: probability(a, b, s))))))
    none = lambda c: F.transform(c, lambda _: F.lit(0.0))
    rows = met.withColumn("_c", flat).select(
        "hall_id", "opp_hall_id", F.col("_t.player_id").alias("ids"), none("_t").alias("ratings"), F.col("_b.player_id").alias("opp_ids"), none("_b").alias("opp_ratings"),
        F.transform("_o", lambda o: F.transform(o["ordering"], lambda x: x["player_id"])).alias("orders"), F.transform("_o", lambda o: -o["_p"]).alias("shares"), F.col("_c.p_win").alias("p_win"), F.col("_c.p_draw").alias("p_draw"),
    )
    return search(rows).select("hall_id", "opp_hall_id", F.col("best.win").alias("expected_win"), F.col("best.lineup").alias("best_lineup"), F.col("safe.worst").alias("safe_win"), F.col("safe.lineup").alias("safe_lineup"))
