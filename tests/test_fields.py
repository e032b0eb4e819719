"""Sums over the pairs of many different states: equal to SQL and to sums pair by pair, with few pairs met."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from wakeline.operators import fields, interactions
from wakeline.plans import graphs

MANY_QUERIES = ["sparse_adjacency", "graph_features", "nearness", "attention", "interaction_scores"]


def states(count: int, columns: int = 4) -> interactions.States:
    """Different states as the events give them, some of several entities, some without a name."""
    rng = np.random.default_rng(count)
    value, k = np.round(rng.exponential(50, count), 2), rng.integers(0, 100, count)
    x = np.stack([value / 500, k / 100, value % 40 / 40, value * 7 % 360 / 360], 1)[:, :columns]
    x = np.unique(np.concatenate([np.zeros((1, columns)), x]), axis=0)
    return interactions.States(x, rng.integers(1, 4, len(x)), rng.permutation(len(x)) + 100, np.arange(len(x)) % 50 > 0)


def equal_to_singly(work: interactions.Work, whole: interactions.States, near: float, exact: tuple[str, ...] = ()) -> None:
    some = np.flatnonzero(whole.named)[::37]
    with np.errstate(all="ignore"):
        many = work.many(whole, whole)
        for at in np.array_split(some, 20):
            for c, y in work.singly(whole[at], whole).items():
                got = np.broadcast_to(many[c], len(whole.members))[at]
                assert (got == y).all() if c in exact else np.allclose(got, y, rtol=near, atol=near), c


@pytest.fixture(scope="module")
def hours(tmp_path_factory):
    """Two hours of 900 vessels in nearly as many states, some at the place of another; in the second folder some lack a measurement."""
    folders = [str(tmp_path_factory.mktemp("hours")) for _ in range(2)]
    for lacking, folder in enumerate(folders):
        duckdb.execute(f"""copy (select i event_id, timestamp '2024-01-01' + to_minutes(60 * (i // 900)) ts, i % 900 user_id, 'view' event_type,
          case when {lacking} and i % 97 = 0 then null when i % 50 = 3 then 12.5 when i % 41 = 2 then 0.0 else round(-50 * ln(1 - (hash(i) % 9973) / 9973.0), 2) end::double as value,
          case when {lacking} and i % 89 = 0 then '{{}}' else '{{"k": ' || case when i % 50 = 3 then i % 3 else hash(i + 5000) % 100 end || '}}' end props from range(1800) t(i)) to '{folder}/events.parquet'""")
    return folders


@pytest.mark.parametrize("name", MANY_QUERIES)
def test_many_states_equal_sql(spark, hours, monkeypatch, name):
    """(A null weight is the largest in SQL, none here, so attention has none.)"""
    monkeypatch.setattr(interactions, "MET_STATES", 100)
    folder = hours[name != "attention"]
    query, sql = graphs.QUERIES[name]
    df = query(spark, folder)
    columns = sorted(df.columns)
    db = duckdb.connect()
    db.execute(f"create view events as select * from '{folder}/events.parquet'")
    told = db.execute(f"select {', '.join(columns)} from ({sql})").fetchall()
    key = lambda r: [r[columns.index(c)] for c in ("ts", "vessel_id", "head") if c in columns]
    got, told = sorted(map(tuple, df.select(*columns).collect()), key=key), sorted(told, key=key)
    assert len(got) == len(told) and [key(r) for r in got] == [key(r) for r in told]
    for a, b in zip(got, told, strict=True):
        assert all(x == pytest.approx(y, abs=2e-6 if name != "nearness" else 2e-5) if isinstance(y, float) else x == y for x, y in zip(a, b, strict=True)), (a, b)


def test_adjacency_of_many_states_meets_few_pairs(monkeypatch):
    """(Before: every pair.) Scores on both sides of zero, a state without features, states without names."""
    whole, met = states(8000), []
    sums = fields.positive_sums
    counted = lambda a, b, weight, value, least: sums(a, b, weight, lambda s, rows: met.append(s.size) or value(s, rows), least)
    monkeypatch.setattr(fields, "positive_sums", counted)
    equal_to_singly(interactions.adjacency_sums(*graphs.MAPS), whole, 1e-10, ("zeros",))
    assert sum(met) < 0.5 * len(whole.members) ** 2


def test_scores_of_many_states():
    equal_to_singly(interactions.score_sums(*graphs.MAPS, 2), states(8000), 1e-11)


def test_nearness_of_many_states():
    """(Before: every pair.) Places on lines, places nearer than the cap, and the place itself."""
    equal_to_singly(interactions.inverse_distance_sums(1000.0), states(20000, 2), 1e-12)


def test_attention_of_many_states_looks_at_few_for_the_largest_weight(monkeypatch):
    """(Before: every pair.) Also of states so close that all weights are equal when rounded: the largest partner with a name."""
    whole, met = states(8000), []
    work, found = interactions.attention_sums(*graphs.MAPS, 9), fields.contenders
    monkeypatch.setattr(fields, "contenders", lambda *x: (met.append(len(rows) * len(some)) or (rows, some) for rows, some in found(*x)))
    equal_to_singly(work, whole, 1e-12, ("top",))
    assert sum(met) < 0.05 * len(whole.members) ** 2
    close = interactions.States(whole.values * 1e-7, whole.members, whole.entity, whole.named)
    equal_to_singly(work, close, 1e-12, ("top",))


@pytest.mark.parametrize("stretch", [(1.0, 1.0), (1.0, 0.0), (1.0, 1e-3), (1e6, 3e6)])
def test_inverse_distances_of_other_places(stretch):
    rng = np.random.default_rng(2)
    a, b = (rng.random((n, 2)) * stretch + np.array([5.0, -7.0]) for n in (300, 9000))
    b[:9] = a[:9]
    weight, most = rng.integers(1, 5, 9000), 400 / stretch[0]
    d = np.sqrt(((a[:, None] - b) ** 2).sum(2))
    with np.errstate(divide="ignore"):
        told = np.where(d == 0, 0, np.minimum(1 / d, most)) @ weight
    assert np.allclose(fields.inverse_distance_sums(a, b, weight, most), told, rtol=1e-11, atol=0)
    assert fields.inverse_distance_sums(a, np.concatenate([b / 1e6, [[9e9, 9e9]]]), np.ones(9001), most) is None


def test_a_few_far_states_do_not_make_all_meet(monkeypatch):
    """States of far larger features than the others' are cut off; sums are those of every pair."""
    whole, met = states(8000), []
    whole.values[-3:] = [[2.5, 0.9, 0.8, 0.7], [6.0, 0.5, 0.5, 0.1], [3.0, 3.0, 0.0, 0.0]]
    raised = fields._positive_sums
    monkeypatch.setattr(fields, "_positive_sums", lambda a, b, *x: met.append((len(a) * len(b), raised(a, b, *x))) or met[-1][1])
    equal_to_singly(interactions.adjacency_sums(*graphs.MAPS), whole, 1e-10, ("zeros",))
    equal_to_singly(interactions.attention_sums(*graphs.MAPS, 9), whole, 1e-10, ("top",))
    assert met[0][1] is None and sum(size for size, found in met if found) > 0.9 * len(whole.members) ** 2


def test_expansions_refuse_what_they_cannot_bound():
    far = np.array([[0.0, 0.0], [100.0, 3.0]])
    one = np.ones(2)
    assert fields.exponential_sums(far, far, one) is None
    assert fields.exponential_sums(far * np.nan, far, one) is None
    assert fields.positive_sums(far, far, one, lambda s, rows: 1 / (s - 1.5) ** 2, one, cuts=0) is None
