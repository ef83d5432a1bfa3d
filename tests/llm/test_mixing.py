import random

import pytest

from lectern.llm import mixing as M


@pytest.mark.parametrize("shares", [[1], [1, 1], [3, 2, 1], [7, 500, 13, 1, 480], [5] * 9, [999, 1]])
def test_every_block_lies_in_its_window_and_lag_stays_under_one(shares):
    order, period = M.earliest_deadline_first(shares), sum(shares)
    seen = [0] * len(shares)
    for t, s in enumerate(order):
        i = seen[s]
        assert i * period // shares[s] <= t < -(-(i + 1) * period // shares[s])
        seen[s] += 1
        assert all(abs(n * period - q * (t + 1)) < period for n, q in zip(seen, shares))
    assert seen == shares


def test_sources_that_run_dry_leave_no_slot_empty():
    blocks, shares = [3, 40, 0, 7], [5, 3, 2, 1]
    slots, per = set(), [0] * 4
    for p in M.phases(blocks, shares):
        assert p["first"] == per[p["s"]]
        per[p["s"]] += p["n"]
        for j in range(p["n"]):
            slots.add(p["slot"] + j // p["share"] * p["period"] + p["spots"][j % p["share"]])
    assert per == blocks and slots == set(range(50))


def plain_schedule(blocks, shares):
    """Slot by slot: of the released blocks the earliest deadline; a dry source starts a new schedule.

    A source whose blocks fill whole periods lets the last of them run out.
    """
    left, used, out = list(blocks), [0] * len(blocks), []
    while any(left):
        active = [s for s, n in enumerate(left) if n]
        period, base, placed = sum(shares[s] for s in active), len(out), {s: 0 for s in active}
        cycles = min(left[s] // shares[s] for s in active)
        whole = any(left[s] == cycles * shares[s] for s in active)
        while len(out) - base < cycles * period if whole else all(left[s] for s in active):
            now = len(out) - base
            s = min((s for s in active if placed[s] * period // shares[s] <= now),
                    key=lambda s: (-(-(placed[s] + 1) * period // shares[s]), s))
            out.append((s, used[s]))
            placed[s], used[s], left[s] = placed[s] + 1, used[s] + 1, left[s] - 1
    return out


def test_schedule_equals_slot_by_slot():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(1, 9)
        blocks, shares = [rng.randint(0, 90) for _ in range(n)], [rng.randint(1, 20) for _ in range(n)]
        got = {p["slot"] + j // p["share"] * p["period"] + p["spots"][j % p["share"]]: (p["s"], p["first"] + j)
               for p in M.phases(blocks, shares) for j in range(p["n"])}
        assert [got[t] for t in range(len(got))] == plain_schedule(blocks, shares)


def test_entries_of_many_sources_stay_under_their_blocks():
    blocks = [1 + i for i in range(400)]
    plan = list(M.phases(blocks, M.whole_shares([b ** 0.5 for b in blocks], 1_600)))
    assert len(plan) <= sum(blocks) and sum(len(p["spots"]) for p in plan) <= sum(blocks)


def test_rows_equal_brute_force(documents, monkeypatch):
    """Every row: its block by the bytes before it in its source, the slot of that block, also joined by block."""
    rng = random.Random(6)
    rows = [(i, "w" * rng.randint(0, 90), rng.choice("aab")) for i in range(300)]
    rows += [(400 + i, "z" * 700, "c") for i in range(3)]
    weights, size = {"a": 5, "b": 2, "c": 1}, 200
    df = documents(rows)
    got = M.mix_sources(df, weights, block_bytes=size, period=12).orderBy("mix.slot", "mix.start").collect()
    order = {s: [] for s in "abc"}
    for r in got:
        order[r["source"]].append(r)
    begin, total = {}, {}
    for s, members in order.items():
        at = 0
        for r in members:
            begin[r["doc_id"]] = at
            at += max(1, len(r["text"]))
        total[s] = at
    slots = {b: t for t, b in enumerate(plain_schedule([-(-total[s] // size) for s in "abc"], M.whole_shares([5, 2, 1], 12)))}
    for r in got:
        block, rest = divmod(begin[r["doc_id"]], size)
        assert (r["mix"]["block"], r["mix"]["slot"]) == (block, slots["abc".index(r["source"]), block])
        assert r["mix"]["start"] == rest / size
    monkeypatch.setattr(M, "BROADCAST_NUMBERS", 0)
    by_block = M.mix_sources(df, weights, block_bytes=size, period=12).orderBy("mix.slot", "mix.start").collect()
    assert [(r["doc_id"], r["mix"]) for r in by_block] == [(r["doc_id"], r["mix"]) for r in got]


def test_all_rows_are_mixed_by_bytes(documents):
    rows = [(i, "x" * 100, "big") for i in range(3000)] + [(5000 + i, "y" * 50, "small") for i in range(1000)]
    got = M.mix_sources(documents(rows), {"big": 3, "small": 1}, block_bytes=1000).collect()
    assert len(got) == 4000
    slots = {}
    for r in got:
        m = r["mix"]
        assert m["release"] <= m["slot"] < m["deadline"] and 0 <= m["start"] < 1
        assert slots.setdefault(m["slot"], r["source"]) == r["source"]
    assert sorted(slots) == list(range(350))
    small = 0
    for t in range(160):  # before either runs dry a quarter of the blocks is small
        small += slots[t] == "small"
        assert abs(small - (t + 1) / 4) < 1


def test_hot_source_odd_rows_and_clashing_names(spark, documents, monkeypatch):
    monkeypatch.setattr(M, "PART_ROWS", 50)
    rows = [(i, f"text {i}", "hot") for i in range(700)] + [(800 + i, None, None) for i in range(20)]
    rows += [(None, "", "s"), (900, "long " * 50_000, "s"), (901, "twice", "s"), (901, "twice", "s")]
    df = documents(rows, "mix", "slot", "_c0", "block")
    got = M.mix_sources(df, block_bytes=500).collect()
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in got) == sorted((i or -1, t or "") for i, t, _ in rows)
    places = {}
    for r in got:
        places.setdefault((r["source"], r["mix"]["block"]), []).append(r["mix"]["start"])
        assert r["slot"] == "mine" and r["_c0"] == "mine"
    assert all(len(set(p)) == len(p) for p in places.values())
    ordered = M.in_order(M.mix_sources(df, block_bytes=500), 500)
    assert ordered.columns == [c for c in df.columns if c != "mix"]
    place = {(r["doc_id"], r["text"]): (r["mix"]["slot"], r["mix"]["start"]) for r in got if r["doc_id"] != 901}
    read = [place[k] for r in ordered.collect() if (k := (r["doc_id"], r["text"])) in place]
    assert read == sorted(read)


def test_empty_table_and_bad_weights(documents):
    empty = M.mix_sources(documents([]))
    assert empty.count() == 0 and "mix" in empty.columns
    assert M.in_order(empty).count() == 0
    with pytest.raises(ValueError):
        M.mix_sources(documents([(1, "a", "s")]), {"s": 0})
