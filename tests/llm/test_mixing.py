import random
import time
from fractions import Fraction

import pytest
from tidelog.llm import mixing
from tidelog.llm.mixing import mix, plan, schedule


def fluid(blocks, weights):
    """Shares of each source at every slot, by walking from one end of a source to the next."""
    left, t, now = [Fraction(b) for b in blocks], Fraction(0), [Fraction(0)] * len(blocks)
    points = [(t, list(now))]
    while any(left):
        active = [i for i, x in enumerate(left) if x]
        total = sum(Fraction(weights[i]) for i in active)
        step = min(left[i] * total / Fraction(weights[i]) for i in active)
        for i in active:
            now[i] += step * Fraction(weights[i]) / total
            left[i] -= step * Fraction(weights[i]) / total
        t += step
        points.append((t, list(now)))
    at = 0
    for slot in range(sum(blocks) + 1):
        while at + 1 < len(points) - 1 and points[at + 1][0] < slot:
            at += 1
        (t0, a), (t1, b) = points[at], points[min(at + 1, len(points) - 1)]
        part = (slot - t0) / (t1 - t0) if t1 > t0 else Fraction(0)
        yield [x + (y - x) * part for x, y in zip(a, b, strict=True)]


def worst(blocks, weights):
    done, out = [0] * len(blocks), Fraction(0)
    order = list(schedule(blocks, weights))
    assert len(order) == sum(blocks)
    for slot, shares in enumerate(fluid(blocks, weights)):
        out = max(out, *(abs(d - x) for d, x in zip(done, shares, strict=True)))
        if slot < len(order):
            done[order[slot]] += 1
    assert done == blocks
    return out


@pytest.mark.parametrize("seed", range(8))
def test_less_than_one_block_from_the_fluid_mix(seed):
    rnd = random.Random(seed)
    n = rnd.randint(1, 12)
    blocks = [rnd.choice([0, 1, 2, 7, 60, 300]) for _ in range(n)]
    blocks[0] = blocks[0] or 3
    assert worst(blocks, [rnd.choice([1.0, 0.5, rnd.random() ** 3 + 0.001]) for _ in range(n)]) < 1


def test_exact_weights_over_a_long_mix():
    assert worst([4_000, *[300] * 12], [n**0.5 for n in [4_000, *[300] * 12]]) < 1
    assert worst([20, 3_000, 3_000], [0.0001, 0.6, 0.3999]) < 1
    assert worst([10] * 200, [1 + i % 7 for i in range(200)]) < 1


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_every_block_once(seed):
    rnd = random.Random(seed)
    blocks = [rnd.choice([0, 1, 5, 300, 2000]) for _ in range(8)]
    weights = [rnd.random() + 0.01 for _ in blocks]
    order = {}
    for s, group, slots in plan(blocks, weights, 64):
        for k, slot in enumerate(slots):
            assert slot not in order
            order[slot] = s, 64 * group + k
    used = [0] * 8
    for slot, s in enumerate(schedule(blocks, weights)):
        assert order[slot] == (s, used[s])
        used[s] += 1
    assert used == blocks


def test_ten_thousand_sources():
    rnd = random.Random(1)
    blocks = [rnd.choice([1, 1, 2, 20]) for _ in range(10_000)]
    began = time.process_time()
    rows = plan(blocks, [b**0.5 for b in blocks])
    assert time.process_time() - began < 10 and len(rows) == 10_000 and sum(len(x) for _, _, x in rows) == sum(blocks)


def rows_of(n=500):
    rnd = random.Random(1)
    rows = [(i, f"t{i}", "en", rnd.choice(["a", "a", "a", "b", "c", None])) for i in range(n)]
    return rows + [(None, "x", None, "a"), (None, "x", None, "a"), (None, "y" * 300_000, None, "b"), (7, "t7", "en", "a"), (7, "other", "en", "a"), (8, None, "en", "b"), (8, "", "en", "b")]


def test_frame(spark, docs_of, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 40)
    rows = rows_of()
    frame = docs_of(rows).selectExpr("*", "1 as mix_slot", "2 as count", "3 as _mix")
    got = sorted(mix(frame, block_docs=4, period=16).collect(), key=lambda r: r.mix_pos)
    assert sorted(str((r.doc_id, r.text, r.source)) for r in got) == sorted(str((i, t, s)) for i, t, _, s in rows)
    # By one plain pass: the sizes alone give the sources of all places.
    names = sorted({r[3] for r in rows}, key=lambda s: (s is not None, s or ""))
    sizes = [sum(r[3] == s for r in rows) for s in names]
    want, used = [], [0] * len(names)
    for slot, i in enumerate(schedule([-(-n // 4) for n in sizes], [n**0.5 for n in sizes])):
        want += [(names[i], used[i], slot, 4 * slot + k) for k in range(min(4, sizes[i] - 4 * used[i]))]
        used[i] += 1
    assert [(r.source, r.mix_block, r.mix_slot, r.mix_pos) for r in got] == want
    again = mix(frame.repartition(3), block_docs=4, period=16).collect()
    assert sorted(str((r.doc_id, r.text, r.mix_pos)) for r in got) == sorted(str((r.doc_id, r.text, r.mix_pos)) for r in again)
    # The order within a source is a shuffled one.
    ids = [r.doc_id for r in got if r.source == "a" and r.doc_id is not None]
    assert ids != sorted(ids) and abs(sum(ids[:80]) / 80 - 250) < 60


def test_larger_blocks_where_the_plan_would_be_too_long(spark, docs_of):
    rows = [(i, "t", None, "ab"[i % 2]) for i in range(300)]
    got = mix(docs_of(rows), block_docs=1, max_blocks=30).collect()
    assert sorted(r.mix_pos for r in got) == list(range(300)) and max(r.mix_slot for r in got) == 29


def test_weights(spark, docs_of):
    rows = [(i, "t", None, "ab"[i % 2]) for i in range(400)]
    got = sorted(mix(docs_of(rows), {"a": 3.0, "b": 1.0}, block_docs=1, period=16).collect(), key=lambda r: r.mix_pos)
    assert all(abs(sum(r.source == "a" for r in got[:n]) - 0.75 * n) < 1 for n in range(1, 250))
    assert mix(docs_of([])).count() == 0
    assert [r.mix_pos for r in mix(docs_of([(1, None)])).collect()] == [0]


def test_plan_in_a_shuffle(spark, docs_of, monkeypatch):
    keys = lambda: sorted(str((r.doc_id, r.text, r.mix_pos)) for r in mix(docs_of(rows_of()), block_docs=1, period=16).collect())
    want = keys()
    monkeypatch.setattr(mixing, "MAX_BROADCAST_SOURCES", 0)
    assert keys() == want
