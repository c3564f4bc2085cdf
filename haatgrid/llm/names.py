"""Variant spellings of names typed by people, linked to the entity they are taken for."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import QUALIFIER, deletes, fold, split_name, words
from ..util import cut, small

_PARTS = T.StructType([T.StructField("place", T.StringType()), T.StructField("tokens", T.ArrayType(T.StringType()))])
_QUALIFIER_WORDS = {w for q in QUALIFIER for w in q.split()}

#: Cost from which two names are never taken for one, and the lead that the best candidate needs to be taken without further evidence.
MOST_COST = 3.6
CLEAR_LEAD = 1.2
#: Cost of an edit of the district.
DISTRICT_EDIT = 0.6
#: Most entities and about the most names that meet in one call; larger districts are dealt into several.
BLOCK_ENTITIES, BLOCK_NAMES = 2_000, 20_000


def index_keys(place: str) -> set[str]:
    """Keys by which a place is looked up, of the whole and of each of its words: what up to two deletions leave of the first and of the last seven letters, so
    edits are found where two at most lie in either; the first four letters, for abbreviations; a short word as it is."""
    own: set[str] = set()
    for t in {place.replace(" ", ""), *place.split()}:
        f = fold(t)
        if len(t) < 4:
            own.add(f"={f}")
            continue
        own.update(deletes(f))
        own.add(f"^{f[:4]}")
        if len(f) > 7:
            own.update(f"${x}" for x in deletes(f[-7:]))
    return own


@F.pandas_udf(_PARTS)
def _parts(names: pd.Series) -> pd.DataFrame:
    """Place of a name and all its tokens."""
    split = [split_name(x) for x in names]
    return pd.DataFrame({"place": [p for p, _ in split], "tokens": [[*p.split(), *q.split()] for p, q in split]})


@F.pandas_udf(T.StringType())
def _folded(names: pd.Series) -> pd.Series:
    return pd.Series([fold(words(x)) for x in names])


def edits(a: str, b: str) -> int:
    """Edit distance with swaps of neighbouring letters."""
    if a == b:
        return 0
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            best = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            new.append(best)
        before, row = row, new
    return row[-1]


def edits_of_all(a: list[str], b: list[str]) -> np.ndarray:
    """``edits`` of many pairs at once."""
    if not a:
        return np.zeros(0, np.int64)
    size = [np.array([len(x) for x in side]) for side in (a, b)]
    x, y = (np.array([[*map(ord, t), *[0] * (int(n.max()) - len(t))] for t in side], np.int32).reshape(len(side), -1).T for side, n in zip((a, b), size))
    d = np.zeros((len(x) + 1, len(y) + 1, len(a)), np.int16)
    d[:, 0], d[0] = np.arange(len(x) + 1)[:, None], np.arange(len(y) + 1)[:, None]
    for i in range(1, len(x) + 1):
        for j in range(1, len(y) + 1):
            best = np.minimum(np.minimum(d[i - 1, j], d[i, j - 1]) + 1, d[i - 1, j - 1] + (x[i - 1] != y[j - 1]))
            if i > 1 and j > 1:
                swap = (x[i - 1] == y[j - 2]) & (x[i - 2] == y[j - 1])
                best = np.where(swap, np.minimum(best, d[i - 2, j - 2] + 1), best)
            d[i, j] = best
    return d[size[0], size[1], np.arange(len(a))].astype(np.int64)


def _short_for(a: str, b: str) -> bool:
    """a is an initial or another beginning of b, or its letters occur in b in order with the same first one."""
    if not a or len(a) >= len(b) or a[0] != b[0]:
        return False
    if b.startswith(a):
        return True
    it = iter(b)
    return len(a) >= 2 and all(x in it for x in a) and len(a) * 2 <= len(b) + 1


def token_cost(a: str, b: str) -> float:
    """Cost of taking one token for the other: edits of their folded forms, little for abbreviations and initials."""
    if a == b:
        return 0.0
    fa, fb = fold(a), fold(b)
    if fa == fb:
        return 0.1
    if _short_for(a, b) or _short_for(b, a):
        return 0.5
    d = edits(fa, fb)
    return float(d) if d <= max(1, min(len(fa), len(fb)) // 3 + 1) else 9.0


def _assignment(cost: list[list[float]]) -> float:
    """Least sum of a square matrix with one entry taken from each row and column, by shortest augmenting paths."""
    n, none = len(cost), 1e9
    row_of, u, v = [-1] * (n + 1), [0.0] * n, [0.0] * (n + 1)
    for i in range(n):
        row_of[n], j0 = i, n
        least, way, done = [none] * (n + 1), [n] * (n + 1), [False] * (n + 1)
        while row_of[j0] >= 0:
            done[j0], i0, step, j1 = True, row_of[j0], none, n
            for j in range(n):
                if not done[j]:
                    x = cost[i0][j] - u[i0] - v[j]
                    if x < least[j]:
                        least[j], way[j] = x, j0
                    if least[j] < step:
                        step, j1 = least[j], j
            for j in range(n + 1):
                if done[j]:
                    u[row_of[j]] += step
                    v[j] -= step
                else:
                    least[j] -= step
            j0 = j1
        while j0 != n:
            row_of[j0], j0 = row_of[way[j0]], way[j0]
    return sum(cost[row_of[j]][j] for j in range(n))


def align(a: list[str], b: list[str]) -> float:
    """Least cost of an assignment of the tokens of a to those of b, of any number.

    A token left alone costs 3 where it tells yards of one town apart, else 2.5. The order of tokens does not count."""
    rest_a, rest_b = list(a), list(b)
    for t in a:  # equal tokens meet: no other use of one costs less
        if t in rest_b:
            rest_a.remove(t)
            rest_b.remove(t)
    alone = lambda t: 3.0 if t in _QUALIFIER_WORDS else 2.5
    n, m = len(rest_a), len(rest_b)
    if not n or not m:
        return sum(map(alone, rest_a + rest_b), 0.0)
    if n == m == 1:
        return min(token_cost(rest_a[0], rest_b[0]), alone(rest_a[0]) + alone(rest_b[0]))
    rows = [[token_cost(t, x) for x in rest_b] + [alone(t)] * n for t in rest_a] + [[alone(x) for x in rest_b] + [0.0] * n for _ in range(m)]
    return _assignment(rows)


def name_cost(a: list[str], b: list[str]) -> float:
    """Cost of two names: the better of the alignment of their tokens and of the comparison of their places written in one word,
    which forgives blanks in the wrong place."""
    cost = align(a, b)
    qa, qb = [t for t in a if t in _QUALIFIER_WORDS], [t for t in b if t in _QUALIFIER_WORDS]
    if sorted(qa) == sorted(qb):
        pa, pb = "".join(t for t in a if t not in _QUALIFIER_WORDS), "".join(t for t in b if t not in _QUALIFIER_WORDS)
        d = edits(fold(pa), fold(pb))
        if d <= max(1, min(len(pa), len(pb)) // 3):
            cost = min(cost, d + 0.05 * edits(pa, pb))
    return cost


@F.pandas_udf(T.DoubleType())
def _district_cost(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(DISTRICT_EDIT * edits_of_all(list(a), list(b)), dtype="float64")


def _score(names: pa.Table, entities: pa.Table) -> pa.Table:
    """Candidates that cost at most ``bound`` of the names and entities of a block: the entities that a key of the name leads to, each scored once."""
    at: dict[str, list[int]] = {}
    for i, place in enumerate(entities["place"].to_pylist()):
        for k in index_keys(place):
            at.setdefault(k, []).append(i)
    tokens, row, entity, cost = entities["tokens"].to_pylist(), [], [], []
    for r, (place, own, apart, bound) in enumerate(zip(*(names[c].to_pylist() for c in ("place", "tokens", "apart", "bound")))):
        for i in {i for k in index_keys(place) for i in at.get(k, ())}:
            c = apart + name_cost(own, tokens[i])
            if c <= bound:
                row.append(r)
                entity.append(i)
                cost.append(c)
    take = lambda t, c, rows: t[c].take(pa.array(rows, pa.int64()))
    return pa.table({"id": take(names, "id", row), "entity": take(entities, "entity", entity), "cost": pa.array(cost, pa.float64())})


def _tasks(df: DataFrame) -> int:
    """Partitions for steps that read little and compute much: a number that is given isn't made less by the planner."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _candidates(n: DataFrame, a: DataFrame) -> DataFrame:
    """Scored candidates of names ``n`` (id, fs, ad, place, tokens, apart, bound: sent to a district ``ad`` of the registry) among the entities ``a`` of that district.

    They meet by district and are told by their keys there, so neither keys nor pairs are shuffled."""
    by = ["fs", "ad"]
    deal = lambda x, most, key: x.groupBy(*by).agg(F.ceil(F.count("*") / most).cast("int").alias(key))
    parts = deal(n, BLOCK_NAMES, "n_parts").join(deal(a, BLOCK_ENTITIES, "a_parts"), by)
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    x = n.join(parts, by).withColumns({"n_part": F.pmod(F.xxhash64("id"), "n_parts").cast("int"), "a_part": every("a_parts")}).select(*by, "n_part", "a_part", "id", "place", "tokens", "apart", "bound")
    y = a.join(parts, by).withColumns({"a_part": F.pmod(F.xxhash64("entity"), "a_parts").cast("int"), "n_part": every("n_parts")}).select(*by, "n_part", "a_part", "entity", "place", "tokens")
    block = [*by, "n_part", "a_part"]
    x, y = x.repartition(_tasks(n), *block), y.repartition(_tasks(n), *block)
    return x.groupBy(*block).cogroup(y.groupBy(*block)).applyInArrow(_score, f"id {n.schema['id'].dataType.simpleString()}, entity string, cost double")


def link_names(names: DataFrame, registry: DataFrame, reports: DataFrame | None = None, id_col: str = "name_id") -> DataFrame:
    """Each name with the ``entity`` (a string) it is taken for and the ``cost`` of that (null where no entity of the registry fits).

    ``names`` has ``id_col``, state, district and market; ``registry`` the known markets under the last three columns. Candidates come
    from a symmetric-delete index on the tokens of the place, within the state; every one is scored by the optimal assignment of tokens,
    which permits other orders, abbreviations and initials, and by the edits of the district. A name takes the entity of least cost.

    A candidate costs at least what its district does, and beyond the least cost and CLEAR_LEAD none counts. So names meet the entities of districts that cost at most that lead first, and
    then those of the other districts that their best candidate so far permits: the result is that of all candidates of the state, whose number grows with the square of its names.

    Where the second candidate is nearly as good, ``reports`` decides if given: it has state, district, market, and ``series`` and
    ``day`` of what the name reports on (the columns of a report that a market sends at most one of a day). A candidate
    that has reports of the same series and day under its own spelling is another market; otherwise each name is drawn to the candidate
    that reports on the same series. Remaining ties go to the alphabetically first entity. Names that fit no entity
    are entities by their normal form. Null names count as empty. An empty input gives no rows.
    """
    n = names.select(F.col(id_col).alias("id"), "state", "district", "market", _parts("market").alias("p"), _folded("district").alias("fd"), _folded("state").alias("fs"))
    n = cut(n.select("id", "state", "district", "market", "p.place", "p.tokens", "fd", "fs"))
    a = registry.select("state", "district", "market").distinct().select(F.concat_ws("|", "state", "district", "market").alias("entity"), _parts("market").alias("p"), _folded("district").alias("ad"), _folded("state").alias("fs"), "state", "district", "market")
    a = cut(a.select("entity", "p.place", "p.tokens", "ad", "fs", "state", "district", "market"))
    towns = n.select("fs", "fd").distinct().repartition(_tasks(n), "fs", "fd")
    d = towns.join(small(cut(a.select("fs", "ad").distinct())), "fs").withColumn("apart", _district_cost("fd", "ad"))
    d = cut(d.filter(F.col("apart") <= MOST_COST))
    close = _candidates(n.withColumn("bound", F.lit(MOST_COST)).join(d.filter(F.col("apart") <= CLEAR_LEAD), ["fs", "fd"]), a)
    close = cut(close)
    bound = F.least(F.lit(MOST_COST), F.coalesce(F.col("least") + CLEAR_LEAD + 1e-9, F.lit(MOST_COST)))  # the exact lead is held below
    open_ = n.join(close.groupBy("id").agg(F.min("cost").alias("least")), "id", "left").withColumn("bound", bound).filter(F.col("bound") > CLEAR_LEAD)
    far = _candidates(cut(open_.join(d.filter(F.col("apart") > CLEAR_LEAD), ["fs", "fd"]).filter(F.col("apart") <= F.col("bound")).select("id", "fs", "ad", "place", "tokens", "apart", "bound")), a)
    by_id = Window.partitionBy("id")
    scored = close.unionByName(far)
    scored = scored.withColumn("lead", F.col("cost") - F.min("cost").over(by_id)).filter(F.col("lead") <= CLEAR_LEAD).withColumn("rivals", F.count("*").over(by_id))
    scored = cut(scored)
    if reports is not None:
        scored = _weigh(scored, n, a, reports)
    best = scored.withColumn("rn", F.row_number().over(by_id.orderBy("cost", "entity"))).filter("rn = 1").select("id", "entity", "cost")
    alone = F.concat_ws("|", F.lit("?"), "fs", "fd", F.array_join(F.array_sort("tokens"), " "))
    return n.join(best, "id", "left").select(F.col("id").alias(id_col), F.coalesce("entity", alone).alias("entity"), "cost")


def _weigh(scored: DataFrame, n: DataFrame, a: DataFrame, reports: DataFrame) -> DataFrame:
    """Costs of contested candidates corrected by what the names report.

    A name and the candidate's own spelling are compared by the hash of series and of series and day; only the reports of contested names and
    of their candidates are looked at, each once per series and day. Names, candidates and reports are shuffled as numbers (64-bit hashes)."""
    name = ["state", "district", "market"]
    number = F.xxhash64(*name).alias("name")
    given = lambda df: df.dropna(subset=name)  # noqa: E731  a missing name is no name's own
    of = lambda kind, c: F.xxhash64(F.lit(kind), c)
    contested = scored.filter("rivals > 1")
    who = contested.select("id").distinct().join(n.select("id", *name), "id").select(of("n", "id").alias("who"), *name)
    what = contested.select("entity").distinct().join(a.select("entity", *name), "entity").select(of("e", "entity").alias("who"), *name)
    side = cut(given(who.unionByName(what)))
    r = given(reports).select(number, F.xxhash64("series").alias("series"), F.xxhash64("series", "day").alias("at"))
    r = r.join(small(side.select(number, "who")), "name").select("who", "series", "at").distinct()
    r = cut(r)
    pairs = contested.select(of("n", "id").alias("x"), of("e", "entity").alias("y"), "id", "entity").distinct()
    # a name equal to the entity's own spelling is no evidence against itself
    own = side.alias("p").join(side.alias("q"), [F.col(f"p.{c}") == F.col(f"q.{c}") for c in name]).select(F.col("p.who").alias("x"), F.col("q.who").alias("y"))
    itself = pairs.join(own, ["x", "y"], "left_semi").select("id", "entity", F.lit(True).alias("itself"))
    pairs = pairs.join(own, ["x", "y"], "left_anti")
    both = pairs.join(r.select(F.col("who").alias("x"), "series", "at"), "x")
    clash = both.join(r.select(F.col("who").alias("y"), "at"), ["y", "at"], "left_semi").groupBy("id", "entity").agg(F.count("*").alias("clashes"))
    series = r.select("who", "series").distinct()
    shared = both.join(series.select(F.col("who").alias("y"), "series"), ["y", "series"], "left_semi").groupBy("id", "entity").agg(F.count("*").alias("hits"))
    total = contested.select("id", of("n", "id").alias("who")).distinct().join(r.groupBy("who").agg(F.count("*").alias("n")), "who").select("id", "n")
    w = scored.join(itself, ["id", "entity"], "left").join(clash, ["id", "entity"], "left").join(shared, ["id", "entity"], "left").join(total, "id", "left")
    part = F.coalesce(F.col("hits") / F.greatest(F.col("n"), F.lit(1)), F.lit(0.0))
    w = w.withColumn("cost", F.col("cost") + F.when((F.col("rivals") > 1) & F.col("itself").isNull(), F.when(F.coalesce("clashes", F.lit(0)) > 0, 5.0).otherwise(1.5 * (1 - part))).otherwise(0.0))
    return w.select("id", "entity", "cost", "rivals")


def same_entity_pairs(links: DataFrame, id_col: str = "name_id") -> DataFrame:
    """All pairs of names of one entity, ``id_a`` < ``id_b``: the rows asked for, and no others are generated."""
    x = links.select(F.col(id_col).alias("id"), "entity")
    a, b = x.select(F.col("id").alias("id_a"), "entity"), x.select(F.col("id").alias("id_b"), "entity")
    return a.join(b, "entity").filter(F.col("id_a") < F.col("id_b")).select("id_a", "id_b")
