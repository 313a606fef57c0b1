"""Performed order against a plain walk over random sections."""

import random

import pytest

from noteloom.operators import repeats

SCHEMA = (
    "piece_id string, section_seq bigint, measure_seq bigint, n double, left string, right string,"
    " ending_seq bigint, ending_passes array<int>, after_other boolean"
)


def random_section(rng, piece, length):
    rows, ending = [], 0
    while len(rows) < length:
        seq = len(rows) + 1
        if rng.random() < 0.25:
            ending += 1
            passes = rng.choice([[1], [2], [], [1, 2], [3]])
            after_other = rng.random() < 0.2
            for k in range(rng.choice([1, 1, 2])):
                rows.append((piece, 1, seq + k, float(seq + k), None, rng.choice([None, "rptend"]), ending, passes, after_other))
        else:
            left = rng.choice([None, None, "rptstart", "rptboth"])
            right = rng.choice([None, None, "rptend", "dbl"])
            rows.append((piece, 1, seq, float(seq), left, right, None, None, False))
    return rows


def elements_of(rows):
    """Rows as a list of measures and endings (an ending holds its measures)."""
    out = []
    for row in rows:
        seq, ending = row[2], row[6]
        if ending is None:
            out.append(("measure", [seq], row))
        elif out and out[-1][0] == "ending" and out[-1][2][6] == ending:
            out[-1][1].append(seq)
        else:
            out.append(("ending", [seq], row))
    return out


def play_region(region):
    if not any(kind == "ending" and row[7] for kind, _, row in region):
        once = [m for _, ms, _ in region for m in ms]
        return once + once
    groups, force = {None: [], 1: [], 2: []}, None
    for kind, ms, row in region:
        if kind == "ending":
            hit = next((p for p in (1, 2) if p in row[7]), None)
            if hit is None:
                continue
            force = hit
        groups[force] += ms
    return groups[None] + groups[1] + groups[None] + groups[2]


def play(rows):
    todo, out = elements_of(rows), []
    while todo:
        kind, ms, row = todo[0]
        size = None
        if kind == "measure" and row[4] == "rptstart":
            size = next((k + 1 for k, (x, _, r) in enumerate(todo) if x == "measure" and r[5] == "rptend"), None)
        if size is None:
            out += ms if kind == "measure" else []
            todo = todo[1:]
            continue
        while size < len(todo) and todo[size][0] == "ending" and not todo[size][2][8]:
            size += 1
        out += play_region(todo[:size])
        todo = todo[size:]
    return out


@pytest.mark.parametrize("block_rows", [3, 1 << 17])
def test_random_sections(spark, block_rows):
    rng = random.Random(5)
    pieces = {f"p{i}": random_section(rng, f"p{i}", rng.choice([4, 9, 17, 30])) for i in range(120)}
    df = spark.createDataFrame([r for rows in pieces.values() for r in rows], SCHEMA)
    found = {}
    for row in repeats.performed_order(df, block_rows).orderBy("piece_id", "performed_seq").collect():
        found.setdefault(row.piece_id, []).append(row.measure_seq)
    for piece, rows in pieces.items():
        assert found.get(piece, []) == play(rows), rows


def test_no_signs_no_change(spark):
    rows = [("p", 1, k, float(k), None, None, None, None, False) for k in range(1, 30)]
    order = repeats.performed_order(spark.createDataFrame(rows, SCHEMA), 4).orderBy("performed_seq").collect()
    assert [r.measure_seq for r in order] == list(range(1, 30))
    assert {r["pass"] for r in order} == {1}


def test_measures_are_dealt_by_block(spark):
    rows = [("p", 1, k, float(k), None, None, None, None, False) for k in range(1, 30)]
    regions = repeats._regions(repeats._signs(spark.createDataFrame(rows, SCHEMA), 4))
    plan = regions._jdf.queryExecution().executedPlan().toString()
    dealt = {line.split("hashpartitioning")[1].split(", ENSURE")[0] for line in plan.splitlines() if "hashpartitioning" in line}
    # Measures go by block; only the block states go by section.
    assert any("block#" in keys for keys in dealt) and all("block#" in keys or keys.count("#") == 2 for keys in dealt), plan
    assert "CartesianProduct" not in plan and "Python" not in plan


def test_nulls_and_empty_tables(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert repeats.performed_order(nothing).count() == 0
    rows = [("p", 1, 1, None, "rptstart", None, None, None, None), ("p", 1, 2, None, None, "rptend", None, None, None),
            ("p", 1, 3, None, None, None, 1, None, None), ("p", None, 4, None, "rptend", "rptstart", None, None, None)]
    order = repeats.performed_order(spark.createDataFrame(rows, SCHEMA), 2).orderBy("performed_seq").collect()
    # An ending without numbers right after the repeat belongs to it and is played both times.
    assert [r.measure_seq for r in order if r.measure_seq < 4] == [1, 2, 3, 1, 2, 3]
